import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairforge.llm import tokens
from pairforge.llm.packing import fill_containers, pack, usage
from pairforge.llm.pieces import outline, packed, pieces, split_texts, structure
from pairforge.llm.tokens import chunk_ids, chunks, encode, encoder, stitch, token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")
ODD = ["", " ", "\n", "  \n\n  x", "a  b   c ", "don't we'LL <|endoftext|> ok", "é é ​  x \x1c y", "日本語の文。次の文！ 終", "🙂🙃 👩‍👩‍👧", "x" * 5000, "1234567890 " * 50, "\ta\r\n b\x00c", " lead", "trail ", "a\u0085 b"]


@pytest.fixture(scope="module")
def enc():
    return encoder()


def test_pieces_equal_the_whole(enc):
    for t in ODD:
        ids = enc.encoding.encode_ordinary(t)
        assert enc.ids(t) == ids and enc.count(t) == len(ids) and enc.decode(ids) == t


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sab1.。\x1c é"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(t):
    e = encoder()
    ids = e.encoding.encode_ordinary(t)
    assert e.ids(t) == ids and e.decode(ids) == t


def test_stitched_chunks(enc):
    rng = random.Random(0)
    words = ["alpha", "b", "\n", "42", "long" * 30, "   ", "。", "x'll"]
    for n in (0, 1, 50, 800):
        t = " ".join(rng.choice(words) for _ in range(n))
        for size, overlap in ((40, 10), (300, 50), (100, 100)):
            spans = chunks(t, size, overlap)
            parts = [chunk_ids(enc, t[a:b], a, (spans[k + 1][0] if k + 1 < len(spans) else b) - a, k + 1 == len(spans)) for k, (a, b) in enumerate(spans)]
            assert stitch(parts) == enc.encoding.encode_ordinary(t)
    assert chunks("x" * 1000, 100, 10) == [(0, 1000)]


def test_texts_without_spaces_have_bounded_chunks(enc):
    rng = random.Random(3)
    texts = ["\n".join("line%d" % i for i in range(3000)), "日本語の文。次の文！一二三" * 900, "".join(rng.choice(["ab", "7", "(", "）", "'s", "\t", "é", "。", "\r\n", "  "]) for _ in range(9000))]
    for t in texts:
        for size, overlap in ((400, 60), (1000, 50)):
            spans = chunks(t, size, overlap)
            assert len(spans) > len(t) // size - 2 and max(b - a for a, b in spans) <= size + overlap + 60
            parts = [chunk_ids(enc, t[a:b], a, (spans[k + 1][0] if k + 1 < len(spans) else b) - a, k + 1 == len(spans)) for k, (a, b) in enumerate(spans)]
            assert stitch(parts) == enc.encoding.encode_ordinary(t)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("  \n\t'sdab19.。、一あ(\x1cé٣"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_sure_boundaries_cut_nothing(t):
    e = encoder()
    cuts = [0, *(m.start() for m in tokens.SURE.finditer(t)), len(t)]
    assert [i for a, b in zip(cuts, cuts[1:]) for i in e.encoding.encode_ordinary(t[a:b])] == e.encoding.encode_ordinary(t)


def test_encode_in_spark(spark, enc):
    texts = [*ODD, None, "word " * 3000, "y" * 9000 + " z " * 900]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, ids int, _key string")
    want = {i: enc.encoding.encode_ordinary(t or "") for i, t in enumerate(texts)}
    for options in ({}, {"chunk_chars": 700, "overlap_chars": 40}):
        rows = encode(df, "doc_id", "text", **options).collect()
        assert len(rows) == len(texts) and {r.doc_id: r.ids for r in rows} == want
    assert {r.doc_id: r.n_tokens for r in token_counts(df, "doc_id", "text").collect()} == {k: len(v) for k, v in want.items()}
    assert encode(df.limit(0), "doc_id", "text").count() == 0
    back = {r.doc_id: r.text for r in tokens.decode(encode(df, "doc_id", "text", chunk_chars=700, overlap_chars=40), "doc_id", "ids").collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=80))
def test_packing_keeps_capacities(sizes):
    where, capacity = pack(sizes, (16, 32, 64))
    filled = [0] * len(capacity)
    for c, n in zip(where, sizes):
        filled[c] += n
    assert len(where) == len(sizes) and all(f <= c and c in (16, 32, 64) for f, c in zip(filled, capacity))
    assert all(c == 16 or f > c // 2 for f, c in zip(filled, capacity)), "downsized"
    assert sum(capacity) <= 2 * sum(sizes) + 64


def test_containers_in_spark(spark):
    sizes = [5, None, 0, 64, 65, 200, 31, 31, 2, 1, -3] + [7] * 500
    df = spark.createDataFrame([(i, n, 1, 2) for i, n in enumerate(sizes)], "doc_id bigint, n bigint, part int, length int")
    rows = fill_containers(df, "doc_id", "n", (16, 32, 64), group_items=100).collect()
    whole = {i: max(n or 0, 0) for i, n in enumerate(sizes)}
    total, by = {}, {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        assert r.offset == 64 * r.part and r.place + r.length <= r.capacity
        by.setdefault(r.container_id, []).append((r.place, r.length))
    assert total == whole and all(sum(r.doc_id == i for r in rows) == max(1, -(-n // 64)) for i, n in whole.items())
    for items in by.values():
        at = 0
        for place, n in sorted(items):
            assert place == at
            at += n
    u = usage(fill_containers(df, "doc_id", "n", (16, 32, 64))).collect()
    assert sum(r.filled for r in u) == sum(whole.values()) and sum(r.free for r in u) < 0.05 * sum(whole.values())
    assert fill_containers(df.limit(0), "doc_id", "n").count() == 0


def test_repeated_and_null_keys_are_spread(spark):
    df = spark.createDataFrame([(None if i % 2 else 1, 10) for i in range(4000)], "doc_id bigint, n bigint")
    rows = fill_containers(df, "doc_id", "n", (64,), group_items=100).collect()
    assert len(rows) == 4000 and sum(r.doc_id is None for r in rows) == 2000
    sizes = {}
    for r in rows:
        sizes[r.container_id >> 32] = sizes.get(r.container_id >> 32, 0) + 1
    assert len(sizes) == 40 and max(sizes.values()) < 200


STRUCTURED = "# One\n\nFirst part. It has sentences.\n\n- item a\n- item b\n  - nested\n\n## Two\n" + "Words and more words here. " * 40 + "\n\n# Three\nshort\n"


def test_ranks_of_structure():
    rank = {STRUCTURED[p : p + 6]: r for p, r in structure(STRUCTURED).items()}
    assert rank["# Thre"] == 1 and rank["## Two"] == 2 and rank["First "] == 7 and rank["- item"] in (8,) and rank["  - ne"] == 9 and rank["short\n"] == 11


def test_tree_is_cut_at_headings_first(enc):
    got = pieces(enc, STRUCTURED, 120, 0)
    assert STRUCTURED[got[0][2] :].startswith("## Two") and STRUCTURED[got[-1][0] :].startswith("# Three")


def test_headings_stay_with_their_text(enc):
    body = "A sentence of the body that says little. " * 30
    text = f"# A\n\n{body}\n\n## B\n\n{body}\n\nC\n===\n{body}\n<h2>D</h2>\n<p>{body}</p>\n"
    for limit in (60, 100, 256, 280, 300):
        for s, a, b, n in pieces(enc, text, limit, 0):
            own = text[a:b].strip()
            assert not own.endswith(("# A", "## B", "C\n===", "\nC", "<h2>D</h2>")) and own not in ("C", "D")
    assert outline("## A\n# B\nx")[1] == {len("## A\n# B\n")} and outline("# A\n\n## B\nx")[1] == {5, 10}


def test_fences_are_opaque():
    text = "# One\ntext\n```sh\n# no heading\n\n- no item\n<h1>no tag\n```\n# Two\n~~~\n# open to the end\n```\n"
    rank = structure(text)
    at = lambda part: rank[text.index(part)]
    assert at("```sh") == 7 and at("# no heading") == at("- no item") == at("<h1>no tag") == 11
    assert at("# Two") == 1 and at("# open to the end") == 11
    assert structure("a\n```x``` inline\n# H\n")[text.index("x") and len("a\n```x``` inline\n")] == 1


def test_no_two_neighbours_of_one_parent_fit(enc):
    """Unless a heading stands between them and one is a part of an oversized node."""
    rng = random.Random(6)
    for _ in range(200):
        n, budget = rng.randint(1, 60), rng.choice([8, 20, 50])
        rank = np.array([rng.choice([1, 2, 7, 8, 11, 12, 13, 13, 13]) for _ in range(n)])
        total = np.concatenate([[0], np.cumsum([rng.randint(1, 12) for _ in range(n)])])
        got = packed(rank, total, budget)
        assert [i for i, _ in got] == [0, *(j for _, j in got[:-1])] and got[-1][1] == n
        assert all(total[j] - total[i] <= budget or j - i == 1 for i, j in got)
        for (i, j), (_, k) in zip(got, got[1:]):
            assert total[k] - total[i] > budget or rank[j] < 7


def test_pieces_cover_and_overlap(enc):
    rng = random.Random(2)
    texts = [STRUCTURED * 3, "z" * 7000, "日本語。" * 900, " ".join(rng.choice(["a", "bb\n", "c.", "<p> d", "1"]) for _ in range(3000)), "🙂" * 800, "\n" * 3000, "ab " * 2000]
    for t in texts:
        for limit, overlap in ((100, 0), (100, 20), (64, 63)):
            got = pieces(enc, t, limit, overlap)
            assert "".join(t[a:b] for _, a, b, _ in got) == t
            for k, (s, a, b, n) in enumerate(got):
                assert n == len(enc.encoding.encode_ordinary(t[s:b])) <= limit and s <= a < b
                if k:
                    assert s >= got[k - 1][1] and (overlap == 0) <= (s == a)


def test_split_in_spark(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "short", 0), (4, "word " * 900, 0)], "doc_id bigint, text string, piece int")
    rows = split_texts(df, "doc_id", "text", 100, 10).orderBy("piece").collect()
    assert {r.doc_id for r in rows} == {4} and [r.piece for r in rows] == list(range(len(rows)))
    assert all(r.text == ("word " * 900)[r.start : r.end] and r.n_tokens <= 100 for r in rows)
    with pytest.raises(ValueError):
        split_texts(df, "doc_id", "text", 10, 10)
