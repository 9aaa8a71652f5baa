"""Column expressions over vault paths and document rows: what a path is, whose it is, and what may be done with it.

A null path counts as the empty one, which is no document of any kind.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import nfc

# Folders of bookkeeping, extensions that sync, and states of a tracker.
MEMBERS, AGENT, PERSONAL, SYSTEM = "_members", "_agent", "_personal", "_system"
SYNCED = r"\.(md|png|jpg|jpeg|gif|webp|svg|pdf|canvas)$"
OPEN = ("in dev", "in progress", "in-progress", "check issue", "할 일", "to do", "todo", "open", "reopened", "진행중", "진행 중")
CLOSED = ("닫힘", "closed", "done", "완료", "해결됨", "resolved", "wontfix", "won't do")


def slashed(path: Column) -> Column:
    """The path with forward slashes; empty if null."""
    return F.translate(F.coalesce(path, F.lit("")), "\\", "/")


def under(path: Column, folder: str) -> Column:
    """Is it the folder itself or anything below it? Every path is under the empty folder."""
    folder = folder.strip("/")
    return (slashed(path) == folder) | F.startswith(slashed(path), F.lit(f"{folder}/")) if folder else F.lit(True)


def hidden(path: Column) -> Column:
    """A part of the path starts with a dot."""
    return slashed(path).rlike(r"(^|/)\.")


def member(path: Column) -> Column:
    return F.startswith(slashed(path), F.lit(f"{MEMBERS}/"))


def proposal(path: Column) -> Column:
    return under(path, AGENT)


def bookkeeping(path: Column) -> Column:
    """A folder that nobody writes in by hand: a part starts with an underscore or a dot."""
    return slashed(path).rlike(r"(^|/)[_.]")


def reactable(path: Column, folders: tuple[str, ...] = ()) -> Column:
    """Markdown outside bookkeeping folders, no conflict copy, and in one of the folders if any are named."""
    p = slashed(path)
    ok = p.rlike(r"(?i)\.md$") & ~bookkeeping(path) & ~p.rlike(r"(?i)\(conflict [^)]*\)\.md$")
    named = F.lit(False)
    for f in folders:
        named = named | under(path, f)
    return ok & named if folders else ok


def enqueued(path: Column, deleted: Column, author: Column, size: Column, bot: str, least: int = 400, folders: tuple[str, ...] = ()) -> Column:
    """Does a saved row deserve a reaction: it stands, no bot wrote it, it is long enough, and its path is reactable? Nulls say no."""
    return F.coalesce(~deleted & ~author.eqNullSafe(F.lit(bot)) & (size >= least) & reactable(path, folders), F.lit(False))


def syncable(path: Column) -> Column:
    """May leave the machine: an extension of the list, no dot folder, no way upwards, no package folder."""
    p = slashed(path)
    return p.rlike(f"(?i){SYNCED}") & ~F.contains(p, F.lit("..")) & ~hidden(path) & ~p.rlike(r"(^|/)node_modules(/|$)")


def normalised(path: Column, compose: bool = True) -> Column:
    """The path as stored, or null if it isn't one: composed, no leading slash, at most 1024 characters, no control characters, no empty or dotted part, not the server's own folder."""
    p = F.regexp_replace(F.translate(nfc(path) if compose else path, "\\", "/"), "^/+", "")
    bad = (p == "") | (F.length(p) > 1024) | p.rlike("[\\x00-\\x1f\\x7f\\ufffd]") | p.rlike(r"(^|/)(\.|/|$)") | p.rlike(f"^{SYSTEM}(/|$)")
    return F.when(~bad, p)


def owner_segment(sub: Column) -> Column:
    """A subject as a part of a path."""
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(sub, "[^A-Za-z0-9._-]+", "-"), 1, 80), F.lit("")), F.lit("unknown"))


def personal_owner(path: Column) -> Column:
    """Who owns a personal path; null for the team's."""
    return F.nullif(F.regexp_extract(slashed(path), f"^{PERSONAL}/([^/]+)/(?s:.+)$", 1), F.lit(""))


def personal_rest(path: Column) -> Column:
    """The part of a personal path below its owner's folder; null for the team's."""
    return F.nullif(F.regexp_extract(slashed(path), f"^{PERSONAL}/[^/]+/((?s:.+))$", 1), F.lit(""))


def remarked_path(path: Column) -> Column:
    """The document that a member's note remarks on: the path below the member's folder; null elsewhere."""
    return F.nullif(F.regexp_extract(slashed(path), f"^{MEMBERS}/[^/]+/((?s:.+))$", 1), F.lit(""))


def mine(author: Column, author_sub: Column, name: str, sub: str = "", service: bool = False) -> Column:
    """Last saved by this viewer: by subject where there is one, by name on rows without a subject or for a service."""
    by_name = (author == name) if name else F.lit(False)
    if service or not sub:
        return F.coalesce(by_name, F.lit(False))
    return F.coalesce((author_sub == sub) | ((author_sub == "") & by_name), F.lit(False))


def addressed(to: Column, to_sub: Column, name: str, sub: str = "", service: bool = False) -> Column:
    """Sent to this viewer: equal subjects, or equal names up to case and surrounding space."""
    by_sub = (to_sub == sub) if sub and not service else F.lit(False)
    by_name = (F.lower(F.trim(to)) == name.strip().lower()) if name else F.lit(False)
    return F.coalesce(by_sub, F.lit(False)) | F.coalesce(by_name, F.lit(False))


def outdated(status: Column, folder: Column) -> Column:
    """Deprecated by its status or kept in an archive folder."""
    archived = F.concat(slashed(folder), F.lit("/")).rlike(r"(?i)(^|/)\.?archive/")
    return F.coalesce(status.isin("outdated", "deprecated"), F.lit(False)) | archived


def status_boost(status: Column) -> Column:
    """0.05 for a tracker's open states, -0.05 for its closed ones, else 0."""
    s = F.lower(F.trim(status))
    return F.when(s.isin(*OPEN), 0.05).when(s.isin(*CLOSED), -0.05).otherwise(0.0)


def described(markdown: Column) -> Column:
    """The Description section holds 20 characters or more."""
    body = F.regexp_extract(F.coalesce(markdown, F.lit("")), r"(?im)^##[ \t]+Description[ \t]*$((?s:.*?))(?=^##[ \t]|\z)", 1)
    return F.length(F.regexp_replace(body, r"\A\s+|\s+\z", "")) >= 20


def routine_due(cadence: Column, enabled: Column, last: Column, now: Column, force: bool = False) -> Column:
    """Enabled and (forced, or not manual and 0.9 of its cadence has passed since the last run in seconds; never run: due)."""
    wait = F.when(cadence == "daily", 86_400).otherwise(7 * 86_400) * 0.9
    return F.coalesce(enabled & (F.lit(force) | ((cadence != "manual") & (now - F.coalesce(last, F.lit(0)) >= wait))), F.lit(False))


def contains_term(text: Column, term: str) -> Column:
    """Containment, but a number must not be a part of a longer number."""
    t = F.coalesce(text, F.lit(""))
    return t.rlike(f"(?<![0-9]){term}(?![0-9])") if term.isdecimal() and term.isascii() else F.contains(t, F.lit(term))
