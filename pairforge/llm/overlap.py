"""Same or near-same records across splits, by Aho-Corasick automata over sharded evaluation passages.

Evaluation records become normalised texts, cut into passages. Equal passages are one, and each goes to the shard of
its anchor (its first words). Every training text visits the shards of the anchors it contains, all other shards
cannot match it; a shard's automaton is built once and the shard's training texts stream through it. Matched
intervals are merged per evaluation text and training text into covered characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import Scratch, default_parallelism

#: Words of a passage, and of the anchor by which it is sharded.
PASSAGE_WORDS = 5
ANCHOR_WORDS = 2
#: Passages that one automaton holds at most on average; a shard of more than four times as many is cut into blocks.
SHARD_PASSAGES = 50_000


def _grams(words, size: int):
    """All runs of `size` words as texts with a space at either end; a shorter text is its own run."""
    n = F.size(words)
    one = lambda i: F.concat(F.lit(" "), F.array_join(F.slice(words, i, size), " "), F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), one)


def passages(texts: DataFrame, words: int = PASSAGE_WORDS) -> DataFrame:
    """`text`, `passage`, `start`: every run of `words` words of each text and where it starts; whole if shorter."""
    parts = F.split(F.trim("text"), " ")
    cut = texts.select("text", parts.alias("_w")).select("text", "_w", F.posexplode(_grams(F.col("_w"), words)).alias("_i", "passage"))
    before = F.aggregate(F.slice("_w", 1, F.col("_i")), F.lit(0), lambda acc, w: acc + F.length(w) + 1)
    return cut.select("text", "passage", before.alias("start"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, passages before texts: each shard's texts run through its automaton."""
    shard, machine, open_ = None, None, False
    for b in batches:
        texts: list[str] = []
        found: list[str] = []
        for s, is_text, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if s != shard:
                shard, machine, open_ = s, ahocorasick.Automaton(ahocorasick.STORE_LENGTH), True
            if not is_text:
                machine.add_word(value)
                continue
            if open_:
                machine.make_automaton()
                open_ = False
            if len(machine):
                hits = {value[end - n + 1 : end + 1] for end, n in machine.iter(value)}
                texts += [value] * len(hits)
                found += hits
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(found, pa.string())], names=["train_text", "passage"])


def _lanes(needles: DataFrame, visits: DataFrame, shard_passages: int) -> DataFrame:
    """`shard`, `is_text`, `value`: passages and texts by shard. A shard of too many passages becomes blocks by the hash of the
    passage, which all texts of the shard meet; at most one in 4 * `shard_passages` passages is a row on the driver."""
    large = needles.groupBy("shard").count().filter(F.col("count") > 4 * shard_passages).collect()
    if large:
        sizes = F.broadcast(needles.sparkSession.createDataFrame([(r["shard"], -(-r["count"] // shard_passages)) for r in large], "shard int, blocks int"))
        blocks = F.coalesce("blocks", F.lit(1))
        block = F.col("shard").cast("long") * 2**31
        needles = needles.join(sizes, "shard", "left").select((block + F.pmod(F.xxhash64("value", F.lit(1)), blocks)).alias("shard"), "is_text", "value")
        visits = visits.join(sizes, "shard", "left").select(F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: block + i)).alias("shard"), "is_text", "value")
    return needles.unionByName(visits)


def text_overlaps(evaluation: DataFrame, training: DataFrame, words: int = PASSAGE_WORDS, anchor_words: int = ANCHOR_WORDS, shard_passages: int = SHARD_PASSAGES) -> DataFrame:
    """`eval_text`, `train_text`, `covered`, `coverage` of every pair of distinct texts that share a passage.

    Both inputs have one column `text` of normalised texts, words between single spaces and a space at either end; repeated texts count once and null texts are skipped.
    `covered` counts the characters of the evaluation text inside matched intervals, overlapping ones merged;
    `coverage` is their share of the text. A text of fewer words than a passage is found whole or not at all. The
    number of shards follows the number of passages, and a shard whose anchor is too frequent is cut into blocks, so an
    automaton's size doesn't grow with the data.
    """
    ev = evaluation.select("text").filter(F.col("text").isNotNull()).distinct()
    tr = training.select("text").filter(F.col("text").isNotNull()).distinct()
    cut = passages(ev, words)
    # Runs of `words` words, repeated ones included.
    count = ev.agg(F.sum(F.greatest(F.size(F.split(F.trim("text"), " ")) - words + 1, F.lit(1)))).first()[0] or 0
    shards = max(default_parallelism(evaluation.sparkSession), -(-count // shard_passages))
    parts = min(shards, 2000)
    # An anchor is never longer than a passage, so a passage's anchor is among those of every text that contains it.
    anchor_words = min(anchor_words, words)
    shard_of = lambda gram: F.pmod(F.xxhash64(gram), F.lit(shards)).cast("int")
    parts_of = F.split(F.trim("value"), " ")
    anchor = _grams(parts_of, anchor_words)
    places = anchor
    if not ev.filter(F.size(F.split(F.trim("text"), " ")) < anchor_words).isEmpty():
        # Evaluation texts shorter than an anchor are anchored by all they have.
        places = F.concat(*[_grams(parts_of, i) for i in range(1, anchor_words + 1)])
    needles = cut.select(F.col("passage").alias("value")).distinct().select(shard_of(anchor[0]).alias("shard"), F.lit(False).alias("is_text"), "value")
    visits = tr.select(F.col("text").alias("value")).select(F.explode(F.array_distinct(F.transform(places, shard_of))).alias("shard"), F.lit(True).alias("is_text"), "value")
    lanes = _lanes(needles, visits, shard_passages).repartition(parts, "shard").sortWithinPartitions("shard", "is_text")
    hits = lanes.mapInArrow(_scan, "train_text string, passage string").distinct()
    spans = cut.join(hits, "passage").select(F.col("text").alias("eval_text"), "train_text", "start", (F.col("start") + F.length("passage")).alias("end"))
    seen = Window.partitionBy("eval_text", "train_text").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(seen), F.lit(0))), F.lit(0))
    merged = spans.withColumn("fresh", fresh).groupBy("eval_text", "train_text").agg(F.sum("fresh").cast("int").alias("covered"))
    return merged.withColumn("coverage", F.col("covered") / F.length("eval_text"))


#: Values of fident that differ by this or less are nearly the same; the addend is for decimal steps in binary.
FIDENT_STEP = 0.01
ROUNDING = 1e-9
#: Rows of one pair of proteins and cell that meet in one task; more are cut into blocks.
BLOCK_ROWS = 5_000


def _near(step: float) -> Column:
    return (F.abs(F.col("eval_score") - F.col("train_score")) <= step + ROUNDING) | (F.col("eval_score").isNull() & F.col("train_score").isNull())


def _cells(step: float) -> tuple[Column, Column]:
    """The cell of `score`, and the cells in which scores near to it may be; rows without a score have a cell of their own.

    Cells are a little wider than `step`, so scores that are near are never two cells apart, however the division is rounded.
    """
    cell = F.floor(F.col("score") / (step + 1e-6)).cast("long")
    none = F.lit(-(2**40)).cast("long")
    return F.coalesce(cell, none), F.when(F.col("score").isNull(), F.array(none)).otherwise(F.array(cell - 1, cell, cell + 1))


def _records(rows: DataFrame, work: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evaluation rows, training rows, and the pairs (`eval_text`, `train_text`) of texts of which the first lies whole in the second.

    A record's text is its two accessions, white space inside them aside.
    """
    word = lambda c: F.regexp_replace(c, r"\s+", "_")
    text = F.concat(F.lit(" "), word("protein_a"), F.lit(" "), word("protein_b"), F.lit(" "))
    score = F.when(~F.isnan("fident"), F.col("fident"))
    base = rows.filter(F.col("protein_a").isNotNull() & F.col("protein_b").isNotNull())
    base = base.filter(F.col("split").isin("train", "val", "test")).select("pair_id", "protein_a", "protein_b", text.alias("text"), score.alias("score"), "split", "source")
    base = work.save(base, "records")
    ev, tr = base.filter(F.col("split").isin("val", "test")), base.filter(F.col("split") == "train")
    whole = work.save(text_overlaps(ev, tr, words=2).filter("coverage = 1").select("eval_text", "train_text"), "whole")
    # Training rows of no covering text need not meet anything.
    return ev, tr.join(whole.select(F.col("train_text").alias("text")), "text", "left_semi"), whole


#: Texts that overlap may still be of other proteins: one text inside a longer one, or white space inside a name.
_SAME = "eval_a = train_a AND eval_b = train_b"


def cross_split_pairs(rows: DataFrame, step: float = FIDENT_STEP, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs of a training row and an evaluation row with the same two proteins and the same or nearly the same score.

    `rows`: `pair_id`, `protein_a`, `protein_b` (the smaller first), `fident`, `split`, `source`. A record's text is
    its two accessions. Evaluation rows meet the training rows of the texts that cover theirs whole; proteins and
    scores are then compared exactly: scores at most `step` apart, or missing (null or NaN) on both sides. Each score
    goes to a cell and visits its neighbours; of a pair of proteins with more than `block_rows` training rows in a cell
    those are cut into blocks which every evaluation row of the cell visits, so no task joins all rows of a hot pair.
    Rows with a missing end don't count, repeated rows do. Returns `eval_id`, `train_id`, `eval_split`, `eval_source`.
    """
    work = Scratch(rows.sparkSession, "overlap")
    ev, tr, whole = _records(rows, work)
    own, visited = _cells(step)
    ev = ev.select(F.col("text").alias("eval_text"), F.col("pair_id").alias("eval_id"), F.col("protein_a").alias("eval_a"), F.col("protein_b").alias("eval_b"),
                   F.col("score").alias("eval_score"), F.col("split").alias("eval_split"), F.col("source").alias("eval_source"), visited.alias("cells"))
    ev = ev.join(whole, "eval_text").withColumn("cell", F.explode("cells")).drop("cells", "eval_text")
    tr = tr.select(F.col("text").alias("train_text"), F.col("pair_id").alias("train_id"), F.col("protein_a").alias("train_a"), F.col("protein_b").alias("train_b"), F.col("score").alias("train_score"), own.alias("cell"))
    at = ["train_text", "cell"]
    full = work.save(tr.groupBy(*at).count().filter(F.col("count") > block_rows).select(*at, F.ceil(F.col("count") / block_rows).cast("int").alias("blocks")), "full")
    n_full = full.count()
    if n_full:
        # At most rows / block_rows cells are full; broadcast only when few.
        full = F.broadcast(full) if n_full <= 10_000 else full
        blocks = F.coalesce("blocks", F.lit(1))
        tr = tr.join(full, at, "left").withColumn("block", F.pmod(F.xxhash64("train_id"), blocks).cast("int")).drop("blocks")
        ev = ev.join(full, at, "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
        at = [*at, "block"]
    return ev.join(tr, at).filter(_SAME).filter(_near(step)).select("eval_id", "train_id", "eval_split", "eval_source")


def cross_split_classes(rows: DataFrame, step: float = FIDENT_STEP) -> DataFrame:
    """The same overlaps by class, without a row per link: `protein_a`, `protein_b`, `score`, `split`, `source`,
    `eval_rows` and `train_rows`, the training rows that each of the class's evaluation rows meets.

    A class is all evaluation rows of one pair of proteins with one score, split and source. Training rows count by
    score before they meet, so a hot pair costs its distinct scores, not its rows. Rows that meet none give no class.
    """
    work = Scratch(rows.sparkSession, "overlap")
    ev, tr, whole = _records(rows, work)
    own, visited = _cells(step)
    ev = ev.groupBy(F.col("text").alias("eval_text"), F.col("protein_a").alias("eval_a"), F.col("protein_b").alias("eval_b"), "score", "split", "source").agg(F.count("*").alias("eval_rows"))
    ev = ev.join(whole, "eval_text").withColumn("cell", F.explode(visited)).withColumnRenamed("score", "eval_score")
    tr = tr.groupBy(F.col("text").alias("train_text"), F.col("protein_a").alias("train_a"), F.col("protein_b").alias("train_b"), "score").agg(F.count("*").alias("train_rows"))
    tr = tr.withColumn("cell", own).withColumnRenamed("score", "train_score")
    met = ev.join(tr, ["train_text", "cell"]).filter(_SAME).filter(_near(step))
    keys = [F.col("eval_a").alias("protein_a"), F.col("eval_b").alias("protein_b"), F.col("eval_score").alias("score"), "split", "source", "eval_rows"]
    return met.groupBy(*keys).agg(F.sum("train_rows").alias("train_rows"))
