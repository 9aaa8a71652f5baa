"""A small vault of our own: two clusters, a thin bridge, an index with leaves, orphans and missing targets."""

DAY = 86_400_000
NOW = 1_789_171_200_000  # 2026-09-12
LINKS = {
    "C1": ["C2", "C3", "C4", "PH1", "X"], "C2": ["C1", "C3", "C4", "PH1"], "C3": ["C1", "C2", "C4|other"], "C4": ["C1#part", "C2", "C3", "PH1", "PH2"],
    "N1": ["N2", "N3", "N4"], "N2": ["N1", "N3", "N4"], "N3": ["N1", "N2", "N4"], "N4": ["N1", "N2", "N3", "C4"], "P": ["C1", "N1", "PH1"], "X": ["C1", "C2", "L1", "L2", "L3"],
    "L1": ["X"], "L2": ["X"], "L3": ["X"], "O1": [], "O2": ["PH3"], "N2x": [], "_reports/R": ["O1"],
}


def files():
    """(path, content, mtime) of the vault."""
    return [(f"{name}.md", f"---\ntitle: {name}\ntags: [test]\n---\n# {name}\nWords with {' and '.join(f'[[{x}]]' for x in links)}.\n", NOW - (200 if name == "C1" else 3) * DAY) for name, links in LINKS.items()]
