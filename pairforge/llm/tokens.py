"""Token ids of whole texts by a public byte-level BPE.

A text is cut into overlapping chunks that are pre-tokenised independently. Boundaries at which pre-tokens surely
start, whatever comes before, are found by every chunk that sees them; neighbouring chunks are stitched at the first
such boundary both have in their overlap, and the pieces between boundaries are encoded. Ids of a piece don't depend
on its text's other pieces, so each task keeps the ids of recent pieces.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from itertools import chain
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import default_parallelism

#: Where the vocabulary lies, on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A pre-token starts at a space before a non-space: white space before it ends in a pre-token of its own, and every
#: alternative of the pattern that matches the non-space takes the space along. Python's \s contains the pattern's.
GAP = re.compile(r" (?=\S)")

#: Other places where a pre-token surely starts, whatever surrounds them: after a letter or digit whatever is neither
#: (no alternative of the pattern goes on from a letter with a mark, nor from a digit with one) and between a letter and a
#: digit. Only characters whose kind no version of Unicode changes are named: ASCII, kana, CJK ideographs and their marks.
_LETTER, _DIGIT, _MARK = "A-Za-zぁ-ゖァ-ヺ一-龥", "0-9", r" \t\r\n!-/:-@\[-`{-~、。！（），．：；？「」『』"
SURE = re.compile(f" (?=\\S)|(?<=[{_LETTER}{_DIGIT}])(?=[{_MARK}])|(?<=[{_LETTER}])(?=[{_DIGIT}])|(?<=[{_DIGIT}])(?=[{_LETTER}])")

CHUNK_CHARS = 65_536
OVERLAP_CHARS = 2_048
#: Pieces whose ids a worker keeps, and the longest that it keeps.
KEPT_PIECES = 400_000
KEPT_CHARS = 64


class PieceEncoder:
    """Encodes texts piece by piece."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.raw = {i: b for b, i in ranks.items()}
        self.raw_length = np.zeros(max(self.raw) + 1, np.int64)
        self.raw_length[list(self.raw)] = [len(b) for b in self.raw.values()]
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kept: dict[str, tuple[int, ...]] = {}

    def _miss(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.encoding.encode_ordinary(" " + piece))
        if len(piece) <= KEPT_CHARS:
            if len(self.kept) >= KEPT_PIECES:
                self.kept.clear()
            self.kept[piece] = ids
        return ids

    def pieces(self, text: str) -> list[tuple[int, ...]]:
        """The ids of each piece; joined, those of the text."""
        first, *rest = GAP.split(text)
        get, miss = self.kept.get, self._miss
        return [tuple(self.encoding.encode_ordinary(first)), *[get(p) or miss(p) for p in rest]]

    def ids(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.pieces(text))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, self.pieces(text))) if text else 0

    def decode(self, ids: list[int]) -> str:
        """Raw bytes joined; exact for ids of a whole text."""
        return b"".join(self.raw[i] for i in ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY) -> PieceEncoder:
    """One encoder per Python worker and vocabulary."""
    return PieceEncoder(path)


def chunks(text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[tuple[int, int]]:
    """Overlapping spans that cover the text. An overlap without a sure boundary grows until it has one or the text ends:
    that is a text of one pre-token, which byte-pair merges may join from end to end."""
    out, start, n = [], 0, len(text)
    while True:
        cut = start + size
        if cut + overlap >= n:
            out.append((start, n))
            return out
        # The boundary must be one that both chunks see: not at the very start of the next one, with a character after it.
        gap = SURE.search(text, cut + 1)
        if gap is None:
            out.append((start, n))
            return out
        out.append((start, min(n, max(cut + overlap, gap.end() + 1))))
        start = cut


def chunk_ids(enc: PieceEncoder, text: str, start: int, core: int, last: bool) -> tuple[list[int], list[tuple[int, int]], list[tuple[int, int]]]:
    """Ids of a chunk, and the boundaries in its head and in its tail as (place in the text, ids before it).

    `core` characters lie before the next chunk's start. The first chunk has no head, the last no tail.
    """
    at, head, tail, ids = 0, [], [], []
    edges = [m.start() for m in SURE.finditer(text) if m.start()]
    for end in [*edges, len(text)]:
        piece = text[at:end]
        if at:
            if start and len(head) < 64:
                head.append((start + at, len(ids)))
            if not last and at >= core:
                tail.append((start + at, len(ids)))
        ids.extend((enc.kept.get(piece[1:]) or enc._miss(piece[1:])) if piece.startswith(" ") else enc.encoding.encode_ordinary(piece))
        at = end
    return ids, head, tail


def stitch(parts: list[tuple[list[int], list[tuple[int, int]], list[tuple[int, int]]]]) -> list[int]:
    """Ids of a text from its chunks in order, each joined to the next at the first boundary both found."""
    begin, out = 0, []
    for k, (ids, _, tail) in enumerate(parts):
        end, following = len(ids), 0
        if k + 1 < len(parts):
            theirs = dict(parts[k + 1][1])
            place, end = next((p, n) for p, n in tail if p in theirs)
            following = theirs[place]
        out.append(ids[begin:end])
        begin = following
    return list(chain.from_iterable(out))


def _rows(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _lists(values: list[list[int]]) -> pa.Array:
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    flat = np.fromiter(chain.from_iterable(values), np.int32, int(lengths.sum()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))


def _short_encoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                yield _rows({"_key": part.column(0), "ids": _lists([enc.ids(t) for t in part.column(1).to_pylist()])})

    return run


def _chunker(size: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column(0), b.column(1)):
                spans = chunks(t := text.as_py(), size, overlap)
                n = len(spans)
                yield _rows({
                    "_key": pa.array([key.as_py()] * n, key.type),
                    "chunk": pa.array(range(n), pa.int32()),
                    "start": pa.array([s for s, _ in spans], pa.int64()),
                    "core": pa.array([(spans[k + 1][0] if k + 1 < n else e) - s for k, (s, e) in enumerate(spans)], pa.int64()),
                    "last": pa.array([k + 1 == n for k in range(n)]),
                    "body": pa.array([t[s:e] for s, e in spans]),
                })

    return run


def _chunk_encoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    pairs = pa.list_(pa.struct([("place", pa.int64()), ("before", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for key, chunk, start, core, last, body in zip(*b.columns):
                ids, head, tail = chunk_ids(enc, body.as_py(), start.as_py(), core.as_py(), last.as_py())
                named = [[{"place": p, "before": n} for p, n in x] for x in (head, tail)]
                yield _rows({"_key": pa.array([key.as_py()], key.type), "chunk": pa.array([chunk.as_py()], pa.int32()), "ids": _lists([ids]), "head": pa.array([named[0]], pairs), "tail": pa.array([named[1]], pairs)})

    return run


def _stitcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for key, parts in zip(b.column(0), b.column(1)):
            got = [(p["ids"], *([(x["place"], x["before"]) for x in p[s]] for s in ("head", "tail"))) for p in parts.as_py()]
            yield _rows({"_key": pa.array([key.as_py()], key.type), "ids": _lists([stitch(got)])})


def encode(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """`key`, `ids` (array<int>) of every row: the ids of its text, special tokens' strings being ordinary text.

    Null and empty texts give an empty list, whatever `key` is; repeated keys give a row each, unless their texts are
    longer than a chunk, for which `key` must be unique. Other columns are not read. Texts of up to `chunk_chars`
    characters are encoded where they are read; only longer ones are cut into chunks, spread over the cluster and
    stitched again. A pre-token longer than a chunk makes its chunk longer, up to the whole text.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    limit = F.lit(chunk_chars + overlap_chars)
    is_long = F.coalesce(F.char_length("_text") > limit, F.lit(False))
    plain = rows.filter(~is_long).mapInArrow(_short_encoder(vocabulary), f"_key {kind}, ids array<int>")
    cut = rows.filter(is_long).mapInArrow(_chunker(chunk_chars, overlap_chars), f"_key {kind}, chunk int, start bigint, core bigint, last boolean, body string")
    parts = cut.repartition(2 * default_parallelism(df.sparkSession), "_key", "chunk").mapInArrow(
        _chunk_encoder(vocabulary), f"_key {kind}, chunk int, ids array<int>, head array<struct<place:bigint,before:int>>, tail array<struct<place:bigint,before:int>>"
    )
    whole = parts.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids", "head", "tail"))).alias("parts"))
    stitched = whole.mapInArrow(_stitcher, f"_key {kind}, ids array<int>")
    return plain.unionByName(stitched).withColumnRenamed("_key", key)


def decode(df: DataFrame, key: str, ids: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """`key`, `text` of every row: the raw bytes of its ids joined, so ids of a whole text give the text back exactly.
    Null and empty lists give an empty text; bytes that are no UTF-8, as in a cut list, become replacement characters."""
    rows = df.select(F.col(key).alias("_key"), F.col(ids).alias("_ids"))
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            yield _rows({"_key": b.column(0), "text": pa.array([enc.decode(x.as_py() or []) for x in b.column(1)], pa.string())})

    return rows.mapInArrow(run, f"_key {kind}, text string").withColumnRenamed("_key", key)


def _counter(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            yield _rows({"_key": b.column(0), "n_tokens": pa.array([enc.count(t.as_py()) for t in b.column(1)], pa.int64())})

    return run


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """`key`, `n_tokens` of every row; null and empty texts have 0. One pass over the scan's partitions, no shuffle."""
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(_counter(vocabulary), f"_key {kind}, n_tokens bigint").withColumnRenamed("_key", key)
