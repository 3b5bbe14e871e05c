import math
import random

import pytest

from pairforge.llm import overlap
from pairforge.llm.overlap import cross_split_pairs, text_overlaps

ROW = "pair_id bigint, protein_a string, protein_b string, fident double, split string, source string, text string, cell int"


def pairs(spark, rows):
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], ROW)
    return sorted((r.eval_id, r.train_id) for r in cross_split_pairs(df).collect())


def brute(rows):
    gone = lambda f: f is None or math.isnan(f)
    near = lambda f, g: gone(f) and gone(g) or not gone(f) and not gone(g) and abs(f - g) <= 0.01 + 1e-9
    return sorted((e[0], t[0]) for e in rows for t in rows if e[4] in ("val", "test") and t[4] == "train" and None not in (e[1], e[2]) and e[1:3] == t[1:3] and near(e[3], t[3]))


def test_against_brute_force(spark):
    rng = random.Random(1)
    names = [f"P{i}" for i in range(6)]
    rows = [(i, *sorted(rng.choices(names, k=2)), rng.choice([None, math.nan, 0.5, 0.51, 0.52, 0.505, 0.0, 1.0]), rng.choice(["train", "val", "test", "inter"]), rng.choice(["s", None])) for i in range(400)]
    rows += [(1000, None, "P1", 0.5, "val", "s"), (1001, None, "P1", 0.5, "train", "s")]
    assert pairs(spark, rows) == brute(rows) != []


def test_one_pair_with_most_rows(spark):
    rows = [(i, "A", "B", i / 1000, "train" if i % 2 else "val", "s") for i in range(600)]
    assert pairs(spark, rows) == brute(rows)


def test_scores_one_step_apart_at_cell_edges(spark):
    rows = [(i, f"A{i // 2}", "B", f / 100, "train" if i % 2 else "val", "s") for i, f in enumerate(x for k in (29, 47, 59, 94) for x in (k, k + 1, k + 1, k))]
    assert pairs(spark, rows) == brute(rows) == [(i, i + 1) for i in range(0, 16, 2)]
    steps = [(i, "A", "B", i / 200, "train" if i % 2 else "val", "s") for i in range(201)]
    steps += [(i + 1000, "A", "B", i / 100, "test" if i % 2 else "train", "s") for i in range(101)]
    assert pairs(spark, steps) == brute(steps)


def test_empty_and_one_sided(spark):
    assert pairs(spark, []) == []
    assert pairs(spark, [(1, "A", "B", 0.5, "val", None)]) == []


def covered(e, t, words):
    hit = [False] * len(e)
    w = e.split()
    for i in range(max(1, len(w) - words + 1)):
        p = " " + " ".join(w[i : i + words]) + " "
        if p in t:
            s = sum(len(x) + 1 for x in w[:i])
            hit[s : s + len(p)] = [True] * len(p)
    return sum(hit)


def test_merged_intervals_of_longer_texts(spark):
    rng = random.Random(4)
    text = lambda n: " " + " ".join(rng.choice(["ab", "c", "def", "a"]) for _ in range(n)) + " "
    ev, tr = [text(rng.randint(1, 14)) for _ in range(40)], [text(rng.randint(1, 60)) for _ in range(40)]
    want = {(e, t): covered(e, t, 5) for e in ev for t in tr if covered(e, t, 5)}
    frames = [spark.createDataFrame([(x,) for x in [*y, *y[:5], None]], "text string") for y in (ev, tr)]
    for shard in (50_000, 1):
        got = {(r.eval_text, r.train_text): (r.covered, r.coverage) for r in text_overlaps(*frames, shard_passages=shard).collect()}
        assert {k: c for k, (c, _) in got.items()} == want
        assert all(abs(s - c / len(e)) < 1e-12 for (e, _), (c, s) in got.items())


@pytest.mark.parametrize("words", [1, 2, 3, 4])
def test_merged_intervals_at_every_width(spark, words):
    """Narrow passages too: their intervals touch and overlap, and anchors are no longer than they are."""
    rng = random.Random(words)
    text = lambda n: " " + " ".join(rng.choice(["ab", "c", "def", "a", "g", "hi"]) for _ in range(n)) + " "
    ev, tr = [" a b c d ", *(text(rng.randint(1, 12)) for _ in range(25))], [" a b c d ", *(text(rng.randint(1, 50)) for _ in range(25))]
    want = {(e, t): covered(e, t, words) for e in ev for t in tr if covered(e, t, words)}
    assert want[" a b c d ", " a b c d "] == 9
    frames = [spark.createDataFrame([(x,) for x in y], "text string") for y in (ev, tr)]
    for shard in (50_000, 1):
        rows = text_overlaps(*frames, words=words, shard_passages=shard).collect()
        assert len(rows) == len(want) and {(r.eval_text, r.train_text): r.covered for r in rows} == want


def test_hot_pair_without_scores_in_blocks(spark):
    rows = [(i, "A", "B", None if i % 3 else 0.5, ["train", "train", "val", "test"][i % 4], "s") for i in range(240)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], ROW)
    got = sorted((r.eval_id, r.train_id) for r in cross_split_pairs(df, block_rows=7).collect())
    assert got == brute(rows)


def test_white_space_inside_names_makes_no_pair(spark):
    rows = [(1, "A X", "B", 0.5, "val", "s"), (2, "A", "X B", 0.5, "train", "s"), (3, "A_X", "B", 0.5, "train", "s"), (4, "A X", "B", 0.505, "train", "s")]
    assert pairs(spark, rows) == [(1, 4)]


def test_classes_count_what_pairs_list(spark):
    rng = random.Random(9)
    rows = [(i, "A", rng.choice("BC"), rng.choice([None, math.nan, 0.5, 0.51, 0.52, 0.3]), rng.choice(["train", "val", "test"]), rng.choice(["s", None])) for i in range(300)]
    want, linked = {}, {}
    for e, _ in brute(rows):
        r = rows[e]
        k = (r[1], r[2], None if r[3] is None or math.isnan(r[3]) else r[3], r[4], r[5])
        want[k] = want.get(k, 0) + 1
        linked.setdefault(k, set()).add(e)
    got = overlap.cross_split_classes(spark.createDataFrame([(*r, "t", 1) for r in rows], ROW)).collect()
    assert {(r.protein_a, r.protein_b, r.score, r.split, r.source): r.eval_rows * r.train_rows for r in got} == want
    assert {(r.protein_a, r.protein_b, r.score, r.split, r.source): r.eval_rows for r in got} == {k: len(v) for k, v in linked.items()}


def test_automata_stay_bounded(spark, monkeypatch):
    """One long text, a third of whose passages share their anchor."""
    seen = []
    monkeypatch.setattr(overlap, "_lanes", lambda *a, f=overlap._lanes: seen.append(f(*a)) or seen[-1])
    ev = " " + " ".join(f"a a x{i}" for i in range(300)) + " "
    tr = [ev, " " + " ".join(f"a a x{i}" for i in range(100, 130)) + " ", " x5 a a x6 a ", " none of them here at all "]
    frames = [spark.createDataFrame([(x,) for x in y], "text string") for y in ([ev], tr)]
    got = {r.train_text: r.covered for r in text_overlaps(*frames, shard_passages=10).collect()}
    assert got == {t: c for t in tr if (c := covered(ev, t, 5))} and len(got) == 3
    sizes = [r["count"] for r in seen[0].filter("not is_text").groupBy("shard").count().collect()]
    assert sum(sizes) == 896 and max(sizes) <= 40
