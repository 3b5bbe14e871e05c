"""Splitting oversized texts at natural boundaries: structure-tree packing.

A text's headings, markup blocks, paragraphs, list items, lines, sentences and words form a tree: a node's children
lie between its strongest inner boundaries. A heading belongs to what follows it, and a fenced block's lines are only
lines. Only nodes that exceed the limit are descended into; sibling subtrees, and what such a node leaves over, are
merged bottom-up while they fit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import GAP, VOCABULARY, PieceEncoder, encoder

LIMIT = 512
OVERLAP = 64
#: Texts whose pieces are handed on together.
BATCH_TEXTS = 64

#: Boundaries, the strongest first: headings by level, blocks, list items by indentation, lines, sentences, words, and the
#: end of a heading before its own text.
HEADING, BLOCK, ITEM, LINE, SENTENCE, WORD, KEPT = 1, 7, 8, 11, 12, 13, 14
LINE_START = re.compile(
    r"(?P<hash>\#{1,6})[ \t]"
    r"|(?P<indent>[ \t]*)(?:[-*+•]|\d{1,3}[.)])[ \t]"
    r"|(?P<block>```|~~~)"
)
UNDERLINE = re.compile(r"(?:={3,}|-{3,})[ \t\r]*$")
TAG = re.compile(r"<(?:h(?P<level>[1-6])|(?P<block>p|div|section|article|table|ul|ol|pre|blockquote)|(?P<item>li|tr|dt))[ >]", re.IGNORECASE)
WIDE_STOP = re.compile("[。！？；]")
HEADING_END = re.compile(r"</h([1-6])>\s*", re.IGNORECASE)
STOPS = frozenset(".!?;。！？；")


def _opens_fence(line: str) -> str | None:
    """The marks of a fence that this line opens, if any; text in backticks on one line is none."""
    mark = line[0]
    marks = line[: len(line) - len(line.lstrip(mark))]
    return None if mark == "`" and "`" in line[len(marks) :] else marks


def outline(text: str) -> tuple[dict[int, int], set[int]]:
    """Places where a heading, block, list item or line begins, or a sentence without a space after it ends, with ranks;
    and those among them where a heading's own text begins. An unclosed fence ends with the text."""
    best: dict[int, int] = {}
    kept: set[int] = set()
    fenced: list[tuple[int, int]] = []

    def mark(place: int, rank: int) -> None:
        if 0 < place < len(text) and rank < best.get(place, 99):
            best[place] = rank

    if "\n" in text:
        lines, at, blank, before = text.split("\n"), 0, False, 0
        fence, opened, head = None, 0, None
        for k, line in enumerate(lines):
            if fence is not None:
                mark(at, LINE)
                rest = line.strip()
                if rest.startswith(fence) and not rest.strip(fence[0]):
                    fence, blank = None, True
                    fenced.append((opened, at + len(line)))
            elif not line or line.isspace():
                blank = True
            else:
                m, level = LINE_START.match(line), None
                if m is None:
                    rank = BLOCK if blank else LINE
                elif m["hash"]:
                    rank = level = HEADING - 1 + len(m["hash"])
                elif m["block"]:
                    rank = BLOCK
                    fence, opened = _opens_fence(line), at
                else:
                    rank = ITEM + min(len(m["indent"].expandtabs(4)) // 2, 2)
                mark(at, rank)
                if head is not None and not (level is not None and level <= head):
                    kept.add(at)
                head = level
                if k and line[0] in "=-" and lines[k - 1].strip() and UNDERLINE.match(line):
                    head = HEADING if line[0] == "=" else HEADING + 1
                    mark(before, head)
                    kept.add(at)
                blank = False
            before = at
            at += len(line) + 1
        if fence is not None:
            fenced.append((opened, len(text)))
    if "<" in text:
        outside = lambda place: not any(a <= place < b for a, b in fenced)
        levels = {}
        for m in TAG.finditer(text):
            if outside(m.start()):
                mark(m.start(), HEADING - 1 + int(m["level"]) if m["level"] else BLOCK if m["block"] else ITEM)
                if m["level"]:
                    levels[m.start()] = int(m["level"])
        for m in HEADING_END.finditer(text):
            if m.end() in best and levels.get(m.end(), 9) > int(m[1]) and outside(m.start()):
                kept.add(m.end())
    if not text.isascii():
        for m in WIDE_STOP.finditer(text):
            mark(m.end(), SENTENCE)
    return best, kept


def structure(text: str) -> dict[int, int]:
    """The places of `outline` with their ranks."""
    return outline(text)[0]


class TokenMap:
    """Token counts of any span of a text, from the counts of its pieces between gaps.

    A span from gap to gap has the sum of its pieces; what sticks out at either end is encoded by itself, which gives
    the span's own encoding exactly, as pre-tokens never cross a gap.
    """

    def __init__(self, enc: PieceEncoder, text: str):
        self.enc, self.text = enc, text
        first, *rest = self.parts = GAP.split(text)
        get, miss = enc.kept.get, enc._miss
        self.ids = [enc.encoding.encode_ordinary(first), *[get(p) or miss(p) for p in rest]]
        lengths = np.fromiter(map(len, self.parts), np.int64, len(self.parts))
        lengths[1:] += 1
        self.gaps = np.concatenate([[0], np.cumsum(lengths)])
        self.before = np.concatenate([[0], np.cumsum(np.fromiter(map(len, self.ids), np.int64, len(self.ids)))])

    def _raw(self, a: int, b: int) -> int:
        return len(self.enc.encoding.encode_ordinary(self.text[a:b])) if b > a else 0

    def count(self, a: int, b: int) -> int:
        i, j = np.searchsorted(self.gaps, a), np.searchsorted(self.gaps, b, "right") - 1
        if i > j:
            return self._raw(a, b)
        return int(self._raw(a, int(self.gaps[i])) + self.before[j] - self.before[i] + self._raw(int(self.gaps[j]), b))

    def nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places where a node may begin (0 first), their ranks, and the tokens before them in the text's encoding."""
        places, before = self.gaps[:-1], self.before[:-1]
        ranks = np.full(len(places), WORD)
        ranks[1:][np.fromiter((p[-1:] in STOPS for p in self.parts[:-1]), bool, len(self.parts) - 1)] = SENTENCE
        inside, kept = outline(self.text)
        if not inside:
            return places, ranks, before
        marks = np.fromiter(sorted(inside), np.int64, len(inside))
        levels = np.fromiter((inside[p] for p in marks.tolist()), np.int64, len(marks))
        piece = np.searchsorted(places, marks, "right") - 1
        on = places[piece] == marks
        ranks[piece[on]] = np.minimum(ranks[piece[on]], levels[on])
        more = np.zeros(len(marks), np.int64)
        off = np.flatnonzero(~on)
        for group in np.split(off, np.flatnonzero(np.diff(piece[off])) + 1) if len(off) else []:
            k = int(piece[group[0]])
            body = self.text[int(self.gaps[k]) : int(self.gaps[k + 1])]
            ends = np.cumsum(self.enc.raw_length[np.asarray(self.ids[k])])
            at = marks[group] - self.gaps[k]
            if not body.isascii():
                at = np.concatenate([[0], np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in body])])[at]
            more[group] = before[k] + np.searchsorted(ends, at, "right")
        places = np.concatenate([places, marks[off]])
        order = np.argsort(places, kind="stable")
        places, ranks = places[order], np.concatenate([ranks, levels[off]])[order]
        if kept:
            ranks[np.isin(places, np.fromiter(kept, np.int64, len(kept)))] = KEPT
        return places, ranks, np.concatenate([before, more[off]])[order]


def _cut_run(enc: PieceEncoder, text: str, start: int, end: int, budget: int) -> list[int]:
    """Places that cut text[start:end], a run without boundaries, into parts within the budget, between characters."""
    cuts, at = [], start
    while True:
        # A token holds at least one byte, so this part is long enough to fill the budget and bounded.
        part = text[at : min(end, at + 64 * budget)]
        ids = enc.encoding.encode_ordinary(part)
        if len(ids) <= budget and at + len(part) >= end:
            return cuts
        take = min(budget, len(ids))
        while True:
            n = len(b"".join(enc.raw[i] for i in ids[:take]).decode("utf-8", errors="ignore"))
            n = max(n, 1)
            if n == 1 or len(enc.encoding.encode_ordinary(part[:n])) <= budget:
                break
            take = max(1, take - max(1, take // 16))
        at += n
        if at >= end:
            return cuts
        cuts.append(at)


def packed(rank: np.ndarray, total: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """Consecutive runs of nodes, each of at most `budget` tokens or a single node.

    `rank` of the boundary before each node, `total` tokens before each node and at the end. An oversized node is packed
    by itself first; its parts then stand among its siblings. Neighbours are merged while they fit, but a part of an
    oversized node not across a heading: there the heading is the better place to begin.
    """

    def pack(i: int, j: int) -> list[tuple[int, int, bool]]:
        inner = rank[i + 1 : j]
        heads = [i, *(np.flatnonzero(inner == inner.min()) + i + 1).tolist(), j]
        out: list[tuple[int, int, bool]] = []
        for x, y in zip(heads, heads[1:]):
            whole = total[y] - total[x] <= budget or y - x == 1
            for p, q, part in [(x, y, False)] if whole else [(p, q, True) for p, q, _ in pack(x, y)]:
                if out and total[q] - total[out[-1][0]] <= budget and (rank[p] >= BLOCK or not (part or out[-1][2])):
                    out[-1] = (out[-1][0], q, part or out[-1][2])
                else:
                    out.append((p, q, part))
        return out

    n = len(rank)
    return [(0, n)] if n < 2 or total[n] - total[0] <= budget else [(i, j) for i, j, _ in pack(0, n)]


def spans(tokens: TokenMap, budget: int) -> list[tuple[int, int]]:
    """Consecutive spans that cover the text, cut along its tree, each of about `budget` tokens at most."""
    text = tokens.text
    places, rank, before = tokens.nodes()
    edges = np.concatenate([places, [len(text)]])
    total = np.concatenate([before, tokens.before[-1:]])
    out: list[tuple[int, int]] = []
    for i, j in packed(rank, total, budget):
        a, b = int(edges[i]), int(edges[j])
        inner = [a, b] if total[j] - total[i] <= budget else [a, *_cut_run(tokens.enc, text, a, b, budget), b]
        out += list(zip(inner, inner[1:]))
    return out


def _overlap_start(tokens: TokenMap, floor: int, start: int, overlap: int) -> int:
    """Where the words begin that hold at most `overlap` tokens before `start`, not before `floor`."""
    if overlap <= 0 or floor >= start:
        return start
    gaps, before = tokens.gaps, tokens.before
    last = int(np.searchsorted(gaps, start, "right") - 1)
    rest = tokens._raw(int(gaps[last]), start)
    first = max(int(np.searchsorted(before[: last + 1], before[last] + rest - overlap)), int(np.searchsorted(gaps, floor)))
    if first <= last and gaps[first] < start and before[last] - before[first] + rest <= overlap:
        return int(gaps[first])
    # No whole word fits: the last tokens of the run, between characters.
    low = max(floor, start - 16 * overlap)
    ids = tokens.enc.encoding.encode_ordinary(tokens.text[low:start])[-overlap:]
    return max(low, start - len(b"".join(tokens.enc.raw[i] for i in ids).decode("utf-8", errors="ignore")))


def pieces(enc: PieceEncoder, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(start, own_start, end, n_tokens) of each piece of a text of more than `limit` tokens, in order; else none.

    text[start:own_start] repeats the end of the piece before; text[own_start:end] of all pieces joined is the text.
    """
    tokens = TokenMap(enc, text)
    if tokens.before[-1] <= limit:
        return []
    out: list[tuple[int, int, int, int]] = []
    todo = spans(tokens, limit - overlap)[::-1]
    while todo:
        a, b = todo.pop()
        start = _overlap_start(tokens, out[-1][1], a, overlap) if out else a
        n = tokens.count(start, b)
        if n > limit and start < a:
            # At a seam inside a run tokens are joined differently: less overlap then.
            start = _overlap_start(tokens, start, a, overlap - 2 * (n - limit))
            n = tokens.count(start, b)
        if n > limit and start < a:
            start, n = a, tokens.count(a, b)
        if n > limit and b - a > 1:
            mid = (a + b) // 2
            todo += [(mid, b), (a, mid)]
            continue
        out.append((start, a, b, n))
    return out


def split_texts(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = VOCABULARY) -> DataFrame:
    """`key`, `piece` (from 0), `start`, `own_start`, `end` (characters), `n_tokens`, `text` of the pieces of every text
    of more than `limit` tokens.

    Pieces begin and end at headings, blocks, list items, lines, sentences or words where there are any within the
    limit, otherwise between characters, and hold at most `limit` tokens. A piece begins with the whole words of at
    most `overlap` tokens that end the piece before. Null, empty and shorter texts give no rows; other columns are not
    read; repeated keys give the pieces of each row. `overlap` must be less than `limit`.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    kind = df.schema[key].dataType.simpleString()
    # A token holds at least one byte: shorter texts cannot exceed the limit.
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.octet_length("_text") > limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, BATCH_TEXTS):
                part = b.slice(at, BATCH_TEXTS)
                rows, numbers, found, bodies = [], [], [], []
                for row, t in enumerate(part.column(1).to_pylist()):
                    got = pieces(enc, t, limit, overlap)
                    rows += [row] * len(got)
                    numbers += range(len(got))
                    found += got
                    bodies += [t[p[0] : p[2]] for p in got]
                if rows:
                    columns = [pa.array([p[i] for p in found], pa.int64()) for i in range(4)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(rows)), pa.array(numbers, pa.int32()), *columns, pa.array(bodies, pa.string())],
                        names=["_key", "piece", "start", "own_start", "end", "n_tokens", "text"],
                    )

    out = rows.mapInArrow(run, f"_key {kind}, piece int, start bigint, own_start bigint, end bigint, n_tokens bigint, text string")
    return out.withColumnRenamed("_key", key)
