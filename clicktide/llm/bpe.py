"""Byte-pair encoding of long texts by tree concatenation, and decoding.

A text up to ``LONG_CHARS`` is encoded in one piece. A longer one is cut into pieces that are
encoded in parallel, in rows of up to ``ROW_CHARS`` characters, and joined pairwise up a tree, first
within a row and then over the rows of a text; a text that is no longer than a row isn't moved. At a
join the ids of the
two sides needn't be those of the whole text, so a window around the join is encoded again, and
grows until it begins with an id that the left side has at the same place and ends with one that
the right side has. Neighbouring ids of the result then are neighbours either in a side or in the
window. As the merges of byte-pair encoding always take the lowest rank first, a sequence of ids is
the encoding of its bytes if every two neighbours are the encoding of theirs; so the result is
exactly the encoding of the whole.

The split into words that comes before the merges is kept by where pieces may end:

- before white space that follows a character which isn't white space; no word of the split has
  white space behind another character, so nothing needs to be joined but the lists of ids;
- inside one long word of the split (letters without a space, a run of spaces); only here windows
  are encoded again, within the word.

Special tokens are found before anything else, so no piece may end within one.

Defined cases: a null text counts as empty, an empty one has no ids; repeated rows give a row each;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)
from tokenizers import Tokenizer

from clicktide.llm.arrow import Batches, groups, per_row
from clicktide.llm.words import SPACES

# Fixed value: how text is split into words before the merges.
SPLIT = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
)
# Characters beyond the Latin blocks, whose classes have changed between versions of Unicode.
RARE = re.compile("[^\\x00-\\u024f\\u2010-\\u2027]")


def _of_category(kind: str) -> str:
    return "".join(c for c in map(chr, range(0x250)) if unicodedata.category(c).startswith(kind))


# The same split for texts without such characters; what \s stands for differs between libraries.
_L, _N, _S = _of_category("L"), _of_category("N"), "\\x09-\\x0d\\x20\\x85\\xa0"
WORDS = re.compile(
    f"'(?:[sdmt]|ll|ve|re)| ?[{_L}]++| ?[{_N}]++| ?[^{_S}{_L}{_N}]++|[{_S}]+(?![^{_S}])|[{_S}]"
)
# Where a text may be cut: ASCII white space behind an ASCII letter or digit.
PLAIN_CUT = re.compile(r"[\x20\x09-\x0D](?<=[0-9A-Za-z].)", re.DOTALL)

# Characters: longer texts are cut, and this is the length of a piece.
LONG_CHARS = 65_536
PIECE_CHARS = 16_384
# Pieces that are shorter than this share a row.
ROW_CHARS = 16_384
# Ids on each side of a join that are encoded again at first.
WINDOW_IDS = 8


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def _id_bytes(path: str) -> dict[int, bytes]:
    """The bytes of every id but special ones; the file has each byte as a printable character."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in set(printable)]
    byte_of = {chr(byte): byte for byte in printable}
    byte_of |= {chr(256 + at): byte for at, byte in enumerate(others)}
    special = load(path).get_added_tokens_decoder()
    return {
        number: bytes(byte_of[character] for character in token)
        for token, number in load(path).get_vocab().items()
        if number not in special
    }


@lru_cache(maxsize=4)
def _fast(path: str) -> tiktoken.Encoding:
    """The same vocabulary for the faster of the two libraries.

    Ids rise with the rank of their merge, so they serve as ranks. Special tokens have their ids.
    """
    special = {t.content: n for n, t in load(path).get_added_tokens_decoder().items()}
    ranks = {data: number for number, data in _id_bytes(path).items()}
    return tiktoken.Encoding("bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=4)
def _specials(path: str) -> re.Pattern:
    """Any special token; a vocabulary without such has a pattern that is nowhere."""
    tokens = [re.escape(t.content) for t in load(path).get_added_tokens_decoder().values()]
    return re.compile("|".join(tokens) or r"(?!)")


def encode_whole(path: str, texts: list[str]) -> list[list[int]]:
    """The ids of each text.

    Where the two libraries may know different versions of Unicode, the slower one decides.
    """
    slow, fast, specials = load(path), _fast(path), _specials(path)
    found = []
    for text in texts:
        if _has_rare(text):
            ids = slow.encode(text, add_special_tokens=False).ids
        elif specials.search(text):
            ids = fast.encode(text, allowed_special="all")
        else:
            # Looking for special tokens would cost as much again as a short text.
            ids = fast.encode_ordinary(text)
        found.append(ids)
    return found


def _has_rare(text: str) -> bool:
    return not text.isascii() and RARE.search(text) is not None


# --- cutting ---------------------------------------------------------------------------------


def _special_cuts(path: str, text: str) -> list[tuple[int, int]]:
    """Where special tokens stand."""
    found = []
    for token in load(path).get_added_tokens_decoder().values():
        at = text.find(token.content)
        while at >= 0:
            found.append((at, at + len(token.content)))
            at = text.find(token.content, at + len(token.content))
    return sorted(found)


def _plain_cut(text: str, low: int, high: int) -> int:
    """The last place in (low, high] that is before ASCII white space and behind ASCII letters."""
    for at in range(high, low, -1):
        before = text[at - 1]
        if at < len(text) and text[at] in SPACES and before.isascii() and before.isalnum():
            return at
    return -1


def cut(path: str, text: str, piece_chars: int = PIECE_CHARS) -> list[tuple[str, bool]]:
    """Pieces of a text, each with whether it goes on within the word that the last piece ends in."""
    pieces: list[tuple[str, bool]] = []
    specials, done = _special_cuts(path, text), 0
    for start, end in [*specials, (len(text), len(text))]:
        pieces.extend(_cut_plain(path, text[done:start], piece_chars))
        if end > start:
            pieces.append((text[start:end], False))
        done = end
    return pieces


def _cut_plain(path: str, text: str, piece_chars: int) -> list[tuple[str, bool]]:
    """Pieces of a text without special tokens."""
    pieces, at = [], 0
    while len(text) - at > piece_chars:
        end = _plain_cut(text, at, at + piece_chars)
        if end < 0:
            # No such place: up to the next one, by words of the split, long ones in parts.
            following = PLAIN_CUT.search(text, at + piece_chars)
            end = following.start() if following else len(text)
            pieces.extend(_cut_words(path, text[at:end], piece_chars))
        else:
            pieces.append((text[at:end], False))
        at = end
    if at < len(text):
        pieces.append((text[at:], False))
    return pieces


def _word_ends(path: str, text: str) -> Iterable[int]:
    """Where the words of the split end."""
    if _has_rare(text):
        return [end for _, (_, end) in load(path).pre_tokenizer.pre_tokenize_str(text)]
    return accumulate(map(len, WORDS.findall(text)))


def _cut_words(path: str, text: str, piece_chars: int) -> list[tuple[str, bool]]:
    """Pieces that end at words of the split, and parts of words that are longer than a piece.

    The split looks at what follows white space, so a piece of several words doesn't end in it;
    such words are pieces by themselves.
    """
    pieces: list[tuple[str, bool]] = []
    held: list[tuple[int, int]] = []

    def flush() -> None:
        alone = []
        while held and text[held[-1][0] : held[-1][1]].isspace():
            alone.append(held.pop())
        if held:
            pieces.append((text[held[0][0] : held[-1][1]], False))
            held.clear()
        pieces.extend((text[start:end], False) for start, end in reversed(alone))

    start = 0
    for end in _word_ends(path, text):
        if held and end - held[0][0] > piece_chars:
            flush()
        if end - start > piece_chars:
            for part in range(start, end, piece_chars):
                pieces.append((text[part : min(part + piece_chars, end)], part > start))
        else:
            held.append((start, end))
        start = end
    flush()
    return pieces


def rows_of(
    pieces: list[tuple[str, bool]], row_chars: int = ROW_CHARS
) -> list[list[tuple[str, bool]]]:
    """The pieces of a text dealt out in rows: of whole words, or else of parts of one word only.

    So a row, like a piece, either begins with a word or goes on within the last row's only one.
    """
    rows: list[list[tuple[str, bool]]] = []
    row: list[tuple[str, bool]] = []
    size = at = 0
    while at < len(pieces):
        end, chars = at + 1, len(pieces[at][0])
        while end < len(pieces) and pieces[end][1]:
            chars += len(pieces[end][0])
            end += 1
        if row and size + chars > row_chars:
            rows.append(row)
            row, size = [], 0
        if chars <= row_chars:
            row.extend(pieces[at:end])
            size += chars
        else:
            for piece in pieces[at:end]:
                if row and size + len(piece[0]) > row_chars:
                    rows.append(row)
                    row, size = [], 0
                row.append(piece)
                size += len(piece[0])
            rows.append(row)
            row, size = [], 0
        at = end
    if row:
        rows.append(row)
    return rows


# --- joining ---------------------------------------------------------------------------------


Ids = list[int] | np.ndarray


def _glued(parts: list[Ids]) -> Ids:
    """Lists make a list, for short parts, where a call of numpy costs more than the ids."""
    if isinstance(parts[0], list):
        return list(chain.from_iterable(parts))
    return np.concatenate(parts, dtype=np.int32)


def join_ids(path: str, left: Ids, right: Ids) -> Ids:
    """The ids of a word, from those of its two parts."""
    size, of = WINDOW_IDS, _id_bytes(path)
    while True:
        low, high = max(0, len(left) - size), min(len(right), size)
        data = b"".join(map(of.__getitem__, [*left[low:], *right[:high]]))
        # A window may begin or end inside a character; such windows must grow.
        try:
            again = encode_part(path, data.decode())
        except UnicodeDecodeError:
            again = None
        whole = not low and high == len(right)
        if again is not None and (
            (not low or again[0] == left[low])
            and (high == len(right) or again[-1] == right[high - 1])
        ):
            return _glued([left[:low], again, right[high:]])
        if whole:
            raise ValueError("the parts of a word aren't text")
        size *= 2


def encode_part(path: str, part: str) -> list[int]:
    """The ids of a part of one word of the split, which by itself is one word of the split."""
    return encode_whole(path, [part])[0]


def join_tree(path: str, parts: list[Ids], within: list[bool]) -> Ids:
    """Join the ids of all pieces of a text; ``within``: a piece goes on in the last one's word."""
    words: list[list[Ids]] = []
    for ids, goes_on in zip(parts, within, strict=True):
        if goes_on:
            words[-1].append(ids)
        else:
            words.append([ids])
    joined = []
    for level in words:
        while len(level) > 1:
            pairs = [join_ids(path, a, b) for a, b in zip(level[::2], level[1::2])]
            level = pairs + level[len(level) - len(level) % 2 :]
        joined.append(level[0])
    return _glued(joined) if joined else np.empty(0, dtype=np.int32)


def encode_pieces(path: str, pieces: list[str], within: list[bool]) -> list[int]:
    """The ids of a row of pieces, each encoded by itself; the first may go on in an earlier row."""
    return join_tree(path, encode_whole(path, pieces), [False, *within[1:]])


def encode_text(path: str, text: str, long_chars: int, piece_chars: int) -> list[int]:
    """The ids of a text that fits a row; above ``long_chars`` by its pieces."""
    if len(text) <= long_chars:
        return encode_whole(path, [text])[0]
    pieces, within = zip(*cut(path, text, piece_chars))
    return encode_pieces(path, list(pieces), list(within))


# --- on Spark --------------------------------------------------------------------------------

Digest = Callable[[list[list[int]]], list[tuple]]


PARTS = StructType(
    [
        StructField("pieces", ArrayType(StringType())),
        StructField("within", ArrayType(BooleanType())),
    ]
)


def _pieces(long: DataFrame, path: str, piece_chars: int) -> DataFrame:
    """The pieces of every long text in rows of up to ``ROW_CHARS``, each row with its place."""
    fields = [long.schema["row"], long.schema["doc_id"]]
    schema = StructType(
        [
            *fields,
            StructField("place", IntegerType()),
            StructField("within", LongType()),
            StructField("parts", PARTS),
        ]
    )
    parts_type = to_arrow_schema(schema).field("parts").type

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = batch.column("row"), batch.column("doc_id")
            for at, text in enumerate(batch.column("text").to_pylist()):
                made = rows_of(cut(path, text, piece_chars))
                n = len(made)
                parts = [
                    {"pieces": [piece for piece, _ in row], "within": [within for _, within in row]}
                    for row in made
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(rows[at], n),
                        pa.repeat(ids[at], n),
                        pa.array(range(n), type=pa.int32()),
                        pa.array([int(row[0][1]) for row in made], type=pa.int64()),
                        pa.array(parts, type=parts_type),
                    ],
                    names=["row", "doc_id", "place", "within", "parts"],
                )

    return long.mapInArrow(run, schema)


def _rows_where(rows: DataFrame, condition: Column) -> DataFrame:
    """A filter that isn't pushed below the text's expression, which would be computed twice."""
    fields = F.struct(*rows.columns)
    return rows.select(F.inline(F.when(condition, F.array(fields))))


def encode(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text: str = "text",
    finish: Digest | None = None,
    result: StructType | None = None,
    long_chars: int = LONG_CHARS,
    piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """Per row: the id and what ``finish`` makes of the ids of its text; by default ``ids`` itself.

    ``finish`` gets lists of ids and returns as many tuples with the fields of ``result``. Ids of a
    long text meet in one task only at the end, a text at a time. Texts above ``long_chars`` are cut
    into pieces of ``piece_chars``; neither changes the result. Those of more than a row's characters
    are spread over tasks, row by row.
    """
    finish = finish or (lambda lists: [(ids,) for ids in lists])
    result = result or StructType([StructField("ids", ArrayType(IntegerType()))])
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    schema = StructType([rows.schema["doc_id"], *result.fields])
    in_task = max(long_chars, ROW_CHARS)

    def make_near() -> Callable[[list], list]:
        return lambda texts: finish([encode_text(path, t, long_chars, piece_chars) for t in texts])

    near = per_row(_rows_where(rows, F.length("text") <= in_task), "text", schema, make_near)

    ids_type = ArrayType(IntegerType())
    # Rows may repeat, ids may be null: the row's number in the scan tells texts apart.
    numbered = _rows_where(rows, F.length("text") > in_task).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "text"
    )
    pieces = _pieces(numbered, path, piece_chars).repartition("row", "place")
    kept = [pieces.schema[name] for name in ("row", "doc_id", "place", "within")]
    part_schema = StructType([*kept, StructField("ids", ids_type)])

    def make_part() -> Callable[[list], list]:
        return lambda rows: [(encode_pieces(path, r["pieces"], r["within"]),) for r in rows]

    encoded = per_row(pieces, "parts", part_schema, make_part)

    def join(batches: Batches) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["row"]):
            lists = table.column("ids").combine_chunks()
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            parts = [flat[a:b] for a, b in zip(ends, ends[1:])]
            ids = join_tree(path, parts, [bool(x) for x in table.column("within").to_pylist()])
            values = [[value] for value in finish([ids.tolist()])[0]]
            arrow = pa.schema([table.schema.field("doc_id"), *to_arrow_schema(result)])
            first = table.column("doc_id").slice(0, 1).combine_chunks()
            made = [pa.array(v, type=f.type) for v, f in zip(values, list(arrow)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([first, *made], schema=arrow)

    whole = encoded.repartition("row").sortWithinPartitions("row", "place")
    return near.unionByName(whole.mapInArrow(join, schema))


def decode(path: str, lists: list[list[int]]) -> list[str]:
    """The text of each list of ids, special tokens included."""
    fast = _fast(path)
    return [fast.decode(ids) for ids in lists]


DIGESTS = StructType(
    [
        StructField("n_tokens", LongType()),
        StructField("ids_sha256", StringType()),
        StructField("decoded_sha256", StringType()),
    ]
)


@lru_cache(maxsize=4)
def _decimals(path: str) -> list[str]:
    return [str(number) for number in range(load(path).get_vocab_size())]


def digests(path: str) -> Digest:
    """Number of ids, hash of the ids written in decimal with commas, hash of the decoded text."""

    def of(lists: list[list[int]]) -> list[tuple]:
        decimal = _decimals(path)
        return [
            (
                len(ids),
                hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest(),
                hashlib.sha256(text.encode()).hexdigest(),
            )
            for ids, text in zip(lists, decode(path, lists), strict=True)
        ]

    return of


def encode_digests(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text: str = "text",
    long_chars: int = LONG_CHARS,
    piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """Per row: the id, ``n_tokens`` and the hashes of the ids and of the decoded text."""
    return encode(docs, path, id_col, text, digests(path), DIGESTS, long_chars, piece_chars)


# What is left of a text without white space, in SQL.
UNSPLIT_SQL = """
SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS decoded_sha256,
       TRUE AS same_as_whole
FROM documents
"""
