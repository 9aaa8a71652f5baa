"""One forward scan over a page's markup: its elements as a tree, and its text blocks in page order."""

from __future__ import annotations

import html as entities
import re

import xxhash

# Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
SKIPPED = frozenset("script style noscript template head title nav header footer aside menu form button select option textarea input iframe object embed svg canvas audio video dialog".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that carry a text's own parts: their names tell what the text is about, not that it is boilerplate.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr figcaption article main html body".split())
#: Words that name boilerplate when they end a class, id or role (RELATED: begin it), and words that may follow them.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adslot banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus "
    "footer gdpr header masthead menu menubar nav navbar navigation newsletter notice notices popup promo promos promotion replies respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
RELATED = frozenset("related recommended more popular trending".split())
FOLLOWING = frozenset("area articles bar block box bottom button buttons col column container content form holder inner item items left link links list main modal outer panel posts primary right secondary section slot stories thread top unit wrap wrapper".split())
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
QUOTED_END = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMING = frozenset("class id role".split())
WORD = re.compile(r"[a-z]+")
#: Deeper elements are read as siblings, as browsers do.
DEEPEST = 512


class Node:
    __slots__ = ("tag", "parent", "key", "depth", "hard", "named", "holds", "inside", "labels")

    def __init__(self, tag: str, parent: Node | None, labels: tuple[str, ...] = ()):
        self.tag, self.parent, self.labels, self.depth = tag, parent, labels, parent.depth + 1 if parent else 0
        # Inline elements and paragraphs don't tell text apart: their text's path is that of the element around.
        if parent is None:
            self.key = 0
        elif tag in INLINE or tag == "p":
            self.key = parent.key
        else:
            self.key = xxhash.xxh64_intdigest(" ".join((tag, *labels)).encode("utf-8", "surrogatepass"), seed=parent.key)
        self.hard = parent is not None and (parent.hard or tag in SKIPPED)
        self.named, self.holds, self.inside = tag not in PROSE and any(map(boilerplate_name, labels)), False, 0


def boilerplate_name(label: str) -> bool:
    """Whether a class, id or role names boilerplate: by its last word that says what it is, such as `comments` of `post-comments-list`."""
    words = WORD.findall(label)
    if words and words[0] in RELATED and len(words) > 1 and words[1] in FOLLOWING:
        return True
    while words and words[-1] in FOLLOWING:
        words.pop()
    return bool(words) and (words[-1] in BOILERPLATE or words == ["related"] or words == ["recommended"])


def labels_of(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    return tuple(sorted({x for m in ATTRIBUTE.finditer(attributes) if m[1].lower() in NAMING for x in (m[2] or m[3] or m[4] or "").lower().split()}))


class Page:
    """The elements (a parent before its children) and the text blocks (text, innermost element at its start) of a source."""

    def __init__(self, source: str):
        self.nodes, self.blocks = [Node("", None)], []
        self._now, self._where, self._top, self._open = [], None, self.nodes[0], {}
        self._scan(source)
        self._flush()
        for text, node in self.blocks:
            node.inside += len(text)
        for node in reversed(self.nodes):
            if node.parent is not None:
                node.parent.inside += node.inside

    def _text(self, text: str) -> None:
        if text:
            text = entities.unescape(text)
            if self._where is None and not text.isspace():
                self._where = self._top
            self._now.append(text)

    def _flush(self) -> None:
        if self._where is not None:
            self.blocks.append((" ".join("".join(self._now).split()), self._where))
        self._now, self._where = [], None

    def _close(self, tag: str) -> None:
        """Close the innermost open element of this kind with all inside; none: nothing happens."""
        if not self._open.get(tag):
            return
        node = self._top
        while True:
            self._open[node.tag] -= 1
            found, node = node.tag == tag, node.parent
            if found:
                break
        self._top = node

    def _end_implied(self, tag: str) -> None:
        """A new block ends an open paragraph, and an item ends its predecessor."""
        ends = tag if tag in ("li", "dt", "dd", "tr", "td", "th", "option") else "p"
        if self._open.get(ends):
            node = self._top
            while node.tag in INLINE:
                node = node.parent
            if node.tag == ends:
                self._close(ends)

    def _scan(self, source: str) -> None:
        at, n, quotes = 0, len(source), True
        while at < n:
            start = source.find("<", at)
            if start < 0:
                break
            m = TAG.match(source, start)
            if not m:
                if source.startswith("<!--", start):
                    end = source.find("-->", start + 4)
                    end = n if end < 0 else end + 3
                elif source.startswith(("<!", "<?"), start) or source.startswith("</", start):
                    end = source.find(">", start) + 1
                    if not end:
                        break
                else:  # a mere character
                    self._text(source[at : start + 1])
                    at = start + 1
                    continue
                self._text(source[at:start])
                at = end
                continue
            stop = QUOTED_END.match(source, m.end()) if quotes else None
            # Once quotes don't close, tags end at the next ">": the scan stays linear.
            quotes = quotes and stop is not None
            end = stop.end() if stop else source.find(">", m.end()) + 1
            if not end:
                break
            self._text(source[at:start])
            at = end
            tag = m[1].lower()
            if tag not in INLINE:
                self._flush()
            if source[start + 1] == "/":
                self._close(tag)
                continue
            attributes = source[m.end() : end - 1]
            if tag in RAW:
                shut = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(source, at)
                at = (source.find(">", shut.end()) + 1 or n) if shut else n
                self._flush()
                continue
            if tag in VOID or attributes.endswith("/") and tag in INLINE:
                continue
            if tag not in INLINE:
                self._end_implied(tag)
            if self._top.depth >= DEEPEST:
                self._close(self._top.tag)
            node = Node(tag, self._top, labels_of(attributes))
            self.nodes.append(node)
            self._open[tag] = self._open.get(tag, 0) + 1
            self._top = node
        self._text(source[at:])

    def main_nodes(self) -> list[Node]:
        """Elements that name the article themselves, outside menus, forms and the like if there are such."""
        found = [x for x in self.nodes if x.tag in MAIN and x.inside]
        return [x for x in found if not x.hard] or [x for x in found if not _in_aside(x)]

    def kept(self) -> list[tuple[str, Node]]:
        """The blocks outside boilerplate by kind or name; what stands around the main element is never taken for such."""
        mains = self.main_nodes()
        clean = [x for x in mains if not any(y.named for y in _around(x)) and not _own_name(x)]
        if mains and not clean:
            mains = [max(mains, key=lambda x: x.inside)]
        for x in clean or mains:
            while x is not None and not x.holds:
                x.holds = True
                x = x.parent
        off, soft = {}, {}
        for x in self.nodes:
            up = x.parent
            named = x.named or x.tag in MAIN and _own_name(x)
            off[x] = up is not None and not x.holds and (off[up] or x.tag in SKIPPED or named)
            soft[x] = up is not None and not x.holds and (soft[up] or x.tag in SKIPPED)
        return [b for b in self.blocks if not off[b[1]]] or [b for b in self.blocks if not soft[b[1]]]


def _around(node: Node):
    node = node.parent
    while node is not None:
        yield node
        node = node.parent


def _own_name(node: Node) -> bool:
    """An article may be a reader's comment or an advert by its own name."""
    return any(map(boilerplate_name, node.labels))


def _in_aside(node: Node) -> bool:
    return any(x.tag in SKIPPED and x.tag != "form" for x in _around(node))
