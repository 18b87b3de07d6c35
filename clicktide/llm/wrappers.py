"""Main text of pages by wrapper induction.

Pages of one host share a template. They are aligned with reference pages of the host by simple tree
matching of their DOM trees, and what is found at the aligned places is pooled:

- A text that is the same wherever its place is aligned belongs to the template.
- The place below which most of the host's text stands, and not in a single block, is the slot of the
  articles; what stands beside it on the pages (menus, adverts, footers) is no content, whatever its
  elements and classes are called and however its texts vary. A block before the slot that says what
  the page's title says is the article's heading.

What is left in the slot is the article, less what stands in menus, notices, adverts, forms and the
like by its own marks. If a page marks its main part or its articles, those are its slot. Names of
classes count as whole names, and never against an element with most of the page's text.

Pages are dealt out by host; a host with many pages is dealt out over as many tasks as it has parts
of ``PART`` pages, chosen by a hash, so no task and no host is too large. Only hosts above a share of
all pages are listed for that, so the list has at most ``MAX_LISTED`` rows, and is broadcast. Within
a part the slots are induced from all its pages together: they are aligned with the one of middle
size, and those that have little in common with it with one of their own, up to ``REFERENCES`` times.

A copy of the reference says nothing about the template. So a page that has the reference's content,
or most of its long texts, has no vote; nor one with its title and most of its characters, if at
least ``MIN_VOTES`` other pages have other titles. (A host can have one title for all pages.) A text
is part of the template only if ``MIN_VOTES`` pages vote so, and at least ``MIN_SAME`` of all that
vote on its place.

Defined cases: a null page counts as empty; a page without main text has an empty text; a page whose
host has no others, or that has no host, is read by its own tags alone; repeated rows get a row
each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

from clicktide.llm.arrow import Batches
from clicktide.llm.html_tree import BLOCK, TEXT, Matching, Node, parse
from clicktide.llm.url_filters import host_of

PART = 128
REFERENCES = 3
# A page is like a reference if at least this share of the smaller one's nodes are aligned.
FIT_SHARE = 0.5
MAX_LISTED = 100_000
MIN_VOTES = 3
MIN_SAME = 0.6
COPY_SHARE = 0.5
LONG_TEXT = 80
# The slot of the articles has at least this share of the text of what it stands in.
SLOT_SHARE = 0.7
# How many words the last blocks of pages begin with alike, and the share of different ones.
CLOSING_WORDS = 2
CLOSING_SHARE = 0.1
# Of a teaser's text at least this share is links; a heading has at least so many characters.
LINK_SHARE = 0.5
HEADING_CHARS = 8

# Elements, roles and names that aren't part of an article.
DROPPED = frozenset(
    "aside audio button canvas dialog embed footer form head iframe input link map menu meta nav "
    "noscript object option script select style svg template textarea title video".split()
)
DROPPED_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation "
    "search".split()
)
DROPPED_NAMES = frozenset(
    "ad ads adsense advert advertisement advertising advertorial adverts banner breadcrumb "
    "breadcrumbs comment comments consent cookie cookies discussion disqus footer login masthead "
    "menu modal nav navbar navigation newsletter notice notices notification overlay pager "
    "pagination popup promo promoted promotion recommended related replies responses share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
# Words that only say where or how large a dropped element is.
PLACES = frozenset(
    "bar block bottom box buttons items left links list page panel posts right section site slot top "
    "unit".split()
)
MARKED = ("main", "article")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _named_dropped(name: str) -> bool:
    """Whether a class or id names something that isn't part of an article, with all its words."""
    words = {word.lower() for word in _NAME.findall(name)}
    return bool(words & DROPPED_NAMES) and words <= DROPPED_NAMES | PLACES


def _tag_dropped(node: Node, in_article: bool) -> bool:
    return node.tag in DROPPED or (node.tag == "header" and not in_article)


def is_dropped(node: Node, in_article: bool, total: int) -> bool:
    """Whether an element and all below it isn't part of the article, by its own marks.

    ``total`` is the number of characters of the page.
    """
    if _tag_dropped(node, in_article):
        return True
    marks = node.attributes
    if not marks:
        return False
    if "hidden" in marks or marks.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none", marks.get("style", "")):
        return True
    if marks.get("role", "").lower() in DROPPED_ROLES:
        return True
    names = marks.get("class", "").split() + marks.get("id", "").split()
    if node.tag in ("html", "body", *MARKED) and not any("comment" in name.lower() for name in names):
        return False
    if 2 * node.chars > total:
        return False
    return any(_named_dropped(name) for name in names)


def weigh(tree: Node) -> Node:
    """Set the characters below each node, and those outside its blocks; dropped tags have none."""
    for node in reversed(list(tree.walk())):
        if node.tag == TEXT:
            node.chars = node.direct = len(node.text.strip())
        elif node.tag in DROPPED:
            node.chars = node.direct = 0
        else:
            node.chars = sum(kid.chars for kid in node.kids)
            node.direct = sum(kid.direct for kid in node.kids if kid.tag not in BLOCK)
    return tree


def article_texts(tree: Node) -> list[tuple[Node, int]]:
    """Texts that may belong to the article, each with the number of its block, in page order.

    If the page marks its main part or articles, those of all of them, else the whole page's.
    """
    return _marked_texts(tree) or _texts_below(tree, False, tree.chars)


def _marked_texts(tree: Node) -> list[tuple[Node, int]]:
    """The texts of the outermost main parts, or else articles, that aren't only teasers."""
    found: list[tuple[Node, int]] = []
    marked = list(_marked(tree))
    largest = max((node.chars for node in marked), default=0)
    for node in marked:
        if node.chars == largest or _link_chars(node) < LINK_SHARE * node.chars:
            first = found[-1][1] + 1 if found else 0
            found += [(n, first + at) for n, at in _texts_below(node, True, tree.chars)]
    return found if any(node.text.strip() for node, _ in found) else []


def _link_chars(node: Node) -> int:
    found, open_nodes = 0, [node]
    while open_nodes:
        now = open_nodes.pop()
        if now.tag == "a":
            found += now.chars
        else:
            open_nodes.extend(now.kids)
    return found


def _marked(tree: Node) -> Iterator[Node]:
    """The outermost elements that mark the main part, or else articles."""
    for tag in MARKED:
        found, open_nodes = False, [tree]
        while open_nodes:
            node = open_nodes.pop()
            if is_dropped(node, True, tree.chars):
                continue
            if node.tag == tag:
                found = found or bool(node.chars)
                yield node
            else:
                open_nodes.extend(reversed(node.kids))
        if found:
            return


def _texts_below(scope: Node, in_article: bool, total: int) -> list[tuple[Node, int]]:
    texts, block = [], 0
    # A None ends the block that its element has begun.
    open_nodes: list[Node | None] = [*reversed(scope.kids)]
    while open_nodes:
        node = open_nodes.pop()
        if node is None:
            block += 1
        elif node.tag == TEXT:
            texts.append((node, block))
        elif node.tag == "br":
            texts.append((_BREAK, block))
        elif not is_dropped(node, in_article, total):
            if node.tag in BLOCK:
                block += 1
                open_nodes.append(None)
            open_nodes.extend(reversed(node.kids))
        elif node.tag in BLOCK:
            block += 1
    return texts


_BREAK = Node(TEXT, text=" ")


def joined(texts: Iterable[tuple[Node, int]]) -> str:
    """White space within a block as one space, blocks parted by an empty line."""
    blocks: dict[int, list[str]] = {}
    for node, block in texts:
        blocks.setdefault(block, []).append(node.text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(line for line in lines if line)


def _plain(node: Node) -> str:
    return " ".join(node.text.split())


def _title(tree: Node) -> str:
    found = next((node for node in tree.walk() if node.tag == "title"), None)
    return "".join(_plain(kid) for kid in found.kids) if found else ""


# --- induction -------------------------------------------------------------------------------


@dataclass
class Aligned:
    """A page aligned with a reference: which of its nodes stand at which place."""

    pairs: list[tuple[Node, Node]]

    def __post_init__(self) -> None:
        self.place = {id(a): b for a, b in self.pairs}
        self.at = {id(b): a for a, b in self.pairs}


class Template:
    """What the pages of a part have in common with one of them, the reference."""

    def __init__(self, reference: Node) -> None:
        self.reference = reference
        self.own = {id(node): _plain(node) for node in reference.walk() if node.tag == TEXT}
        content = article_texts(reference)
        self._content, self._whole = {id(node) for node, _ in content}, joined(content)
        self._title = _title(reference)
        self._votes: list[tuple[list[tuple[Node, bool]], bool, bool]] = []
        # Per place: pages, characters, those outside of blocks, and blocks.
        self._pooled: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        self.constant: dict[int, str] = {}
        self.slot: Node | None = None

    def take(self, tree: Node, content: list[tuple[Node, int]], aligned: Aligned) -> None:
        """Pool what stands at the aligned places of a page; a copy of the reference has no vote."""
        for a, b in aligned.pairs:
            if a.tag != TEXT:
                pooled = self._pooled[id(b)]
                pooled[0] += 1
                pooled[1] += a.chars
                pooled[2] += a.direct
                pooled[3] += sum(kid.tag in BLOCK and kid.chars > 0 for kid in a.kids)
        if tree is self.reference:
            return
        texts = [(a, b) for a, b in aligned.pairs if a.tag == TEXT]
        equal = [(b, _plain(a) == self.own[id(b)]) for a, b in texts if self.own[id(b)]]
        alike = [(len(self.own[id(b)]), is_same) for b, is_same in equal if id(b) in self._content]
        long = [is_same for n, is_same in alike if n >= LONG_TEXT]
        if sum(long) > COPY_SHARE * len(long) or joined(content) == self._whole:
            return
        most = sum(n for n, is_same in alike if is_same) > COPY_SHARE * sum(n for n, _ in alike)
        self._votes.append((equal, bool(self._title) and _title(tree) == self._title, most))

    def induce(self) -> None:
        """Decide which texts are constant and which place is the articles' slot."""
        votes, same = Counter(), Counter()
        telling = sum(not titled for _, titled, _ in self._votes) >= MIN_VOTES
        for equal, titled, most in self._votes:
            if telling and titled and most:
                continue
            for node, is_same in equal:
                votes[id(node)] += 1
                same[id(node)] += is_same
        self.constant = {
            node: self.own[node]
            for node, count in same.items()
            if count >= MIN_VOTES and count >= MIN_SAME * votes[node]
        }
        self.slot = self._heaviest()

    def _heaviest(self) -> Node:
        """Go down to where most of the text stands, as long as that isn't a single block."""
        node = self.reference
        while True:
            heavy = max(node.kids, key=lambda kid: self._pooled[id(kid)][1], default=None)
            if heavy is None or heavy.tag == TEXT:
                return node
            pages, chars, direct, blocks = self._pooled[id(heavy)]
            if chars < SLOT_SHARE * self._pooled[id(node)][1] or not blocks or 2 * direct > chars:
                return node
            if blocks < 1.5 * pages and not self._deeper(heavy):
                return node
            node = heavy

    def _deeper(self, node: Node) -> bool:
        """Whether a place with about one block leads on to one with several."""
        while True:
            heavy = max(node.kids, key=lambda kid: self._pooled[id(kid)][1], default=None)
            if heavy is None or heavy.tag not in BLOCK:
                return False
            pages, chars, direct, blocks = self._pooled[id(heavy)]
            if 2 * direct > chars or not blocks:
                return False
            if blocks >= 1.5 * pages:
                return True
            node = heavy

    def text(self, tree: Node, content: list[tuple[Node, int]], aligned: Aligned, marked: bool) -> str:
        """The main text of a page."""
        if not marked:
            content = self._in_slot(tree, content, aligned)
        return joined(
            (node, block)
            for node, block in content
            if (place := aligned.place.get(id(node))) is None
            or self.constant.get(id(place)) != _plain(node)
        )

    def _in_slot(
        self, tree: Node, content: list[tuple[Node, int]], aligned: Aligned
    ) -> list[tuple[Node, int]]:
        """What of the content stands in the slot, and the heading before it."""
        slot = aligned.at.get(id(self.slot))
        if slot is None:
            return content
        inside = {id(node) for node in slot.walk()}
        kept = {block for node, block in content if id(node) in inside}
        if not kept:
            return content
        title = _title(tree)
        blocks: dict[int, list[str]] = defaultdict(list)
        for node, block in content:
            if block < min(kept) and block not in kept:
                blocks[block].append(node.text)
        for block, parts in blocks.items():
            heading = " ".join("".join(parts).split())
            if len(heading) >= HEADING_CHARS and title and (
                heading.startswith(title) or title.startswith(heading)
            ):
                kept.add(block)
        return [(node, block) for node, block in content if block in kept]


def extract_site(trees: list[Node]) -> list[str]:
    """The main text of pages of one host."""
    contents = [article_texts(weigh(tree)) for tree in trees]
    if len(trees) <= MIN_VOTES:
        return [joined(texts) for texts in contents]
    found = [""] * len(trees)
    unmarked: list[int] = []
    rest = list(range(len(trees)))
    for left in range(REFERENCES - 1, -1, -1):
        reference = trees[sorted(rest, key=lambda at: trees[at].size)[len(rest) // 2]]
        aligned = {at: Aligned(list(Matching(trees[at], reference).pairs())) for at in rest}
        unlike = [
            at
            for at in rest
            if len(aligned[at].pairs) < FIT_SHARE * min(trees[at].size, reference.size)
        ]
        if not left or len(unlike) <= MIN_VOTES:
            unlike = []
        template, apart = Template(reference), set(unlike)
        fitting = [at for at in rest if at not in apart]
        for at in fitting:
            template.take(trees[at], contents[at], aligned[at])
        template.induce()
        for at in fitting:
            marked = bool(_marked_texts(trees[at]))
            found[at] = template.text(trees[at], contents[at], aligned[at], marked)
            if not marked:
                unmarked.append(at)
        rest = unlike
        if not rest:
            break
    closings = closings_of([joined(contents[at]) for at in unmarked])
    for at in unmarked:
        found[at] = without_closing(found[at], closings)
    return found


def closings_of(pages: list[str]) -> set[tuple[str, ...]]:
    """The words that the last blocks of most pages begin with alike, if they go on differently.

    Such are footers, wherever they stand: inside the slot, if a tag before them isn't closed.
    """
    # Pages that begin with the same block are copies and have one vote.
    last_of = {page.partition("\n\n")[0]: page.rpartition("\n\n")[2] for page in pages}
    ends: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for last in last_of.values():
        ends[_opening(last)].append(last)
    return {
        words
        for words, blocks in ends.items()
        if len(words) == CLOSING_WORDS
        and len(blocks) > max(MIN_VOTES, MIN_SAME * len(last_of))
        and len(set(blocks)) >= max(MIN_VOTES, CLOSING_SHARE * len(blocks))
    }


def _opening(block: str) -> tuple[str, ...]:
    return tuple(block.split(None, CLOSING_WORDS)[:CLOSING_WORDS])


def without_closing(text: str, closings: set[tuple[str, ...]]) -> str:
    """The text without a last block that begins as a closing; a single block stays."""
    rest, _, last = text.rpartition("\n\n")
    return rest if rest and _opening(last) in closings else text


# --- on Spark --------------------------------------------------------------------------------


def _extract(batches: Batches, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Texts of pages that are sorted by host and part, a chunk of one host at a time."""
    held: list[tuple[object, str | None, str | None]] = []
    now: tuple | None = None

    def flush() -> pa.RecordBatch:
        trees = [parse(page) for _, _, page in held]
        # Without a host, pages needn't have anything in common.
        if now and now[0]:
            texts = extract_site(trees)
        else:
            texts = [joined(article_texts(weigh(tree))) for tree in trees]
        made = pa.RecordBatch.from_arrays(
            [
                pa.array([row for row, _, _ in held], type=id_type),
                pa.array([url for _, url, _ in held], type=pa.string()),
                pa.array(texts, type=pa.string()),
                pa.array([len(text) for text in texts], type=pa.int64()),
            ],
            names=["page_id", "url", "text", "n_chars"],
        )
        held.clear()
        return made

    for batch in batches:
        names = ("host", "part", "page_id", "url", "html")
        for at in range(batch.num_rows):
            host, part, row, url, page = [batch.column(name)[at].as_py() for name in names]
            if held and ((host, part) != now or len(held) == 2 * PART):
                yield flush()
            now = host, part
            held.append((row, url, page))
    if held:
        yield flush()


def main_texts(
    pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Per row: page_id, url, text (blocks parted by an empty line) and n_chars."""
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")
    ).withColumn("host", host_of(F.col("url")))
    per_host = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    total = per_host.agg(F.sum("pages")).first()[0] or 0
    # At most total / listed_from hosts can have more pages, that is MAX_LISTED.
    listed_from = max(PART, -(-total // MAX_LISTED))
    listed = per_host.where(F.col("pages") > listed_from).select(
        "host", F.ceil(F.col("pages") / PART).alias("parts")
    )
    parts = F.coalesce("parts", F.lit(1))
    dealt = rows.join(F.broadcast(listed), "host", "left").select(
        "host",
        F.pmod(F.xxhash64("page_id", "url"), parts).cast("int").alias("part"),
        "page_id",
        "url",
        "html",
    )
    schema = StructType(
        [
            rows.schema["page_id"],
            StructField("url", StringType()),
            StructField("text", StringType()),
            StructField("n_chars", LongType()),
        ]
    )
    id_type = to_arrow_type(rows.schema["page_id"].dataType)
    return (
        dealt.repartition("host", "part")
        .sortWithinPartitions("host", "part", F.xxhash64("page_id", "url"), "page_id", "url")
        .mapInArrow(lambda batches: _extract(batches, id_type), schema)
    )
