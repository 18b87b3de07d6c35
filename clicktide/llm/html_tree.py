"""Trees of HTML pages, and their alignment by simple tree matching."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Generator, Iterable, Iterator
from typing import Any

import numpy as np

# Elements by how they are written and laid out.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body canvas caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th "
    "thead title tr ul video".split()
)
# Opening the first closes an open one of the second, if no element of the third is in between.
_CLOSES_P = (frozenset({"p"}), frozenset({"td", "th", "button", "table"}))
_CLOSED_BY = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
} | {
    tag: _CLOSES_P
    for tag in BLOCK - frozenset("body html head li dt dd tr td th tbody thead tfoot option".split())
}

TEXT = "#text"
# Cells of the tables that an alignment holds at once; longer lists are aligned half by half.
FULL_PAIRS = 2_000_000
# Sizes of unequal subtrees that are remembered.
KNOWN_SIZES = 1_000_000

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(
    r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?"
)


class Node:
    """An element, or a piece of text."""

    __slots__ = ("tag", "attributes", "text", "kids", "label", "shape", "size", "chars", "direct")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None, text: str = "") -> None:
        self.tag, self.attributes, self.text = tag, attributes or {}, text
        self.kids: list[Node] = []
        names = self.attributes.get("class", "").split()
        self.label = f"{tag}.{'.'.join(sorted(names))}" if names else tag
        self.shape, self.size = 0, 1
        # Characters below it, and those of them that are in no block below it; set by users.
        self.chars, self.direct = 0, 0

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in the order of the page."""
        open_nodes = [self]
        while open_nodes:
            node = open_nodes.pop()
            yield node
            open_nodes.extend(reversed(node.kids))


class _Stack:
    """The open elements, with the places of each tag, so that deep pages take linear time."""

    def __init__(self, root: Node) -> None:
        self.nodes, self._places = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self._places[node.tag].append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        """Close the element at a place, and all in it."""
        for node in self.nodes[at:]:
            self._places[node.tag].pop()
        del self.nodes[at:]

    def innermost(self, tags: Iterable[str]) -> int:
        """The place of the last open element with one of the tags, or 0."""
        return max((self._places[tag][-1] for tag in tags if self._places[tag]), default=0)


class _Markup:
    """Finds where tags and comments end, in time that doesn't depend on what never ends."""

    def __init__(self, page: str) -> None:
        self.page = page
        # From here on there is no such text, as far as is known.
        self._missing: dict[str, int] = {}

    def find(self, text: str, at: int) -> int:
        """Where the next such text starts, or -1."""
        if at >= self._missing.get(text, len(self.page) + 1):
            return -1
        found = self.page.find(text, at)
        if found < 0:
            self._missing[text] = at
        return found

    def end_of_tag(self, at: int) -> int:
        """Behind the ``>`` of a tag whose name ends at a place, or -1.

        A ``>`` in quotation marks doesn't end the tag, unless a mark is never closed.
        """
        first = self.find(">", at)
        if first < 0:
            return -1
        # A tag without marks before its first ">" ends there.
        double, single = self.find('"', at), self.find("'", at)
        if not (0 <= double < first or 0 <= single < first):
            return first + 1
        while True:
            marks = [m for m in (self.find('"', at), self.find("'", at)) if m >= 0]
            end = self.find(">", at)
            if end < 0:
                return first + 1
            mark = min(marks, default=end)
            if end <= mark:
                return end + 1
            closing = self.find(self.page[mark], mark + 1)
            if closing < 0:
                return first + 1
            at = closing + 1


def parse(page: str | None) -> Node:
    """The tree of a page; anything can be parsed, and no text is lost."""
    page = page or ""
    root = Node("#page")
    stack, markup = _Stack(root), _Markup(page)
    at = 0
    while at < len(page):
        found = markup.find("<", at)
        if found < 0:
            _add_text(stack.nodes[-1], page[at:])
            break
        name = _NAME.match(page, found)
        if page.startswith("<!--", found):
            end = markup.find("-->", found + 4)
            end = end + 3 if end >= 0 else len(page)
        elif page.startswith(("<!", "<?"), found):
            end = markup.find(">", found) + 1
        else:
            end = markup.end_of_tag(name.end()) if name else -1
        if end <= 0:
            # A "<" that opens nothing is text, up to the next one.
            end = markup.find("<", found + 1)
            end = len(page) if end < 0 else end
            _add_text(stack.nodes[-1], page[at:end])
            at = end
            continue
        if found > at:
            _add_text(stack.nodes[-1], page[at:found])
        at = end
        if name is None or page[found + 1] == "!":
            continue
        tag = name.group(1).lower()
        if page[found + 1] == "/":
            _close(stack, tag)
            continue
        node = _open(stack, tag, page[name.end() : end - 1])
        if tag in RAW:
            stop = _end_of_raw(markup, tag, at)
            if stop > at:
                _add_text(node, page[at:stop])
            at = stop
    _measure(root)
    return root


def _end_of_raw(markup: _Markup, tag: str, at: int) -> int:
    """Where the end tag of an element without markup in it starts, or the page ends."""
    while (found := markup.find("</", at)) >= 0:
        end = found + 2 + len(tag)
        if markup.page[found + 2 : end].lower() == tag:
            if not markup.page[end : end + 1].isalnum() and markup.page[end : end + 1] != "_":
                return found
        at = found + 2
    return len(markup.page)


def _add_text(parent: Node, raw: str) -> None:
    text = html.unescape(raw) if "&" in raw else raw
    if text.strip():
        parent.kids.append(Node(TEXT, text=text))
    elif parent.kids and parent.kids[-1].tag == TEXT:
        # White space between elements of a line still parts words.
        parent.kids[-1].text += " "
    elif parent.tag not in BLOCK and parent.tag != "#page" or parent.kids:
        parent.kids.append(Node(TEXT, text=" "))


def _open(stack: _Stack, tag: str, attributes: str) -> Node:
    if tag in _CLOSED_BY:
        closed, fence = _CLOSED_BY[tag]
        at = stack.innermost(closed)
        if at > stack.innermost(fence):
            stack.cut(at)
    values = {}
    if attributes.strip(" /\n\t\r"):
        for name, *found in _ATTRIBUTE.findall(attributes):
            values.setdefault(name.lower(), html.unescape(next(filter(None, found), "")))
    node = Node(tag, values)
    stack.nodes[-1].kids.append(node)
    if tag not in VOID and not attributes.endswith("/") and tag not in RAW:
        stack.push(node)
    return node


def _close(stack: _Stack, tag: str) -> None:
    at = stack.innermost((tag,))
    fenced = tag not in ("table", "tr", "tbody", "body", "html")
    if at and not (fenced and stack.innermost(("td", "th", "table")) > at):
        stack.cut(at)


def _measure(root: Node) -> None:
    """Sizes, and hashes that are equal for trees of equal labels."""
    for node in reversed(list(root.walk())):
        node.size = 1 + sum(kid.size for kid in node.kids)
        node.shape = hash((node.label, *[kid.shape for kid in node.kids]))


# --- simple tree matching --------------------------------------------------------------------


# Steps of an alignment ask for the sizes of children's subtrees, as trees can be deeper than
# Python's stack.
Steps = Generator[tuple[Node, Node], int, Any]


class Matching:
    """The largest top-down alignment of two trees that keeps the order of children."""

    def __init__(self, page: Node, reference: Node) -> None:
        self._sizes: dict[tuple[int, int], int] = {}
        self.page, self.reference = page, reference

    def pairs(self) -> Iterator[tuple[Node, Node]]:
        """Aligned nodes of the page and the reference."""
        open_pairs = [(self.page, self.reference)] if self.page.label == self.reference.label else []
        while open_pairs:
            a, b = open_pairs.pop()
            yield a, b
            if a.shape == b.shape:
                open_pairs.extend(zip(a.kids, b.kids))
            else:
                open_pairs.extend(self._run(self._align(a.kids, b.kids)))

    def size(self, a: Node, b: Node) -> int:
        """The number of aligned nodes of two subtrees."""
        if a.label != b.label:
            return 0
        return a.size if a.shape == b.shape else self._run(self._measure(a, b))

    def _run(self, steps: Steps) -> Any:
        waiting, value = [steps], None
        while waiting:
            try:
                a, b = waiting[-1].send(value)
                waiting.append(self._measure(a, b))
                value = None
            except StopIteration as done:
                waiting.pop()
                value = done.value
        return value

    def _measure(self, a: Node, b: Node) -> Steps:
        """The size of the alignment of nodes with the same label and different shapes."""
        low, high = _equal_ends(a.kids, b.kids)
        total = 1 + sum(x.size for x in a.kids[:low]) + sum(x.size for x in a.kids[len(a.kids) - high :])
        mine, others = a.kids[low : len(a.kids) - high], b.kids[low : len(b.kids) - high]
        if mine and others:
            weights = _Weights(others)
            best = np.zeros(len(others) + 1, dtype=np.int64)
            for x in mine:
                best = _next_row(best, (yield from self._row(weights, x)))
            total += int(best[-1])
        if len(self._sizes) >= KNOWN_SIZES:
            self._sizes.clear()
        self._sizes[a.shape, b.shape] = total
        return total

    def _align(self, a: list[Node], b: list[Node]) -> Steps:
        """The aligned children."""
        # What is equal at both ends stays aligned.
        low, high = _equal_ends(a, b)
        pairs = list(zip(a[:low], b[:low])) + list(zip(a[len(a) - high :], b[len(b) - high :]))
        a, b = a[low : len(a) - high], b[low : len(b) - high]
        if a and b:
            weights, start = _Weights(b), np.zeros(len(b) + 1, dtype=np.int64)
            found: list[tuple[int, int]] = []
            yield from self._trace(a, weights, 0, len(a), start, found)
            pairs.extend((a[i], b[j]) for i, j in found)
        return pairs

    def _trace(
        self,
        a: list[Node],
        weights: _Weights,
        low: int,
        high: int,
        start: np.ndarray,
        found: list[tuple[int, int]],
    ) -> Steps:
        """Go back from the last column of row ``high`` to row ``low``, whose best sizes are known.

        Returns the column that is reached there.
        """
        if high - low > 1 and (high - low) * len(start) > FULL_PAIRS:
            middle, best = (low + high) // 2, start
            for x in a[low:middle]:
                best = _next_row(best, (yield from self._row(weights, x))[: len(start) - 1])
            column = yield from self._trace(a, weights, middle, high, best, found)
            return (yield from self._trace(a, weights, low, middle, start[: column + 1], found))
        best = np.zeros((high - low + 1, len(start)), dtype=np.int64)
        best[0] = start
        for at, x in enumerate(a[low:high]):
            row = yield from self._row(weights, x)
            best[at + 1] = _next_row(best[at], row[: len(start) - 1])
        i, j = high - low, len(start) - 1
        while i and j:
            if best[i, j] == best[i - 1, j]:
                i -= 1
            elif best[i, j] == best[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((low + i, j))
        return j

    def _row(self, weights: _Weights, x: Node) -> Steps:
        """The sizes of alignments of a node with each of a list."""
        row = weights.known.get(x.shape)
        if row is None:
            row = np.zeros(len(weights.kinds), dtype=np.int64)
            for at in weights.labels.get(x.label, ()):
                y = weights.kinds[at]
                if x.shape == y.shape:
                    row[at] = x.size
                elif not x.kids or not y.kids:
                    row[at] = 1
                else:
                    size = self._sizes.get((x.shape, y.shape))
                    row[at] = (yield x, y) if size is None else size
            if (len(weights.known) + 1) * len(row) > FULL_PAIRS:
                weights.known.clear()
            weights.known[x.shape] = row
        return row[weights.kind_of]


class _Weights:
    """A list of nodes by their shapes, with the rows of weights that are remembered."""

    def __init__(self, nodes: list[Node]) -> None:
        places: dict[int, int] = {}
        self.kinds: list[Node] = []
        self.labels: dict[str, list[int]] = {}
        for node in nodes:
            if node.shape not in places:
                places[node.shape] = len(self.kinds)
                self.labels.setdefault(node.label, []).append(len(self.kinds))
                self.kinds.append(node)
        self.kind_of = np.array([places[node.shape] for node in nodes])
        self.known: dict[int, np.ndarray] = {}


def _equal_ends(a: list[Node], b: list[Node]) -> tuple[int, int]:
    """How many children are equal at the start, and of the rest at the end."""
    low, high = 0, 0
    most = min(len(a), len(b))
    while low < most and a[low].shape == b[low].shape:
        low += 1
    while high < most - low and a[-1 - high].shape == b[-1 - high].shape:
        high += 1
    return low, high


def _next_row(best: np.ndarray, weights: np.ndarray) -> np.ndarray:
    taken = np.zeros_like(best)
    np.maximum(best[1:], best[:-1] + weights, out=taken[1:])
    return np.maximum.accumulate(taken)
