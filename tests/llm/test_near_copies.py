import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import near_copies
from tracelake.llm.near_copies import MARK_BITS, mark, near_components, wide_difference, wide_mark


def similar_groups(docs, words=5):
    """docs: {id: text}; id to the smallest id that pairs of similarity 0.8 or more reach."""
    sets = {}
    for d, t in docs.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    group, ids = {d: d for d in docs}, sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    return group


def made(rng):
    """Chains and stars of edited texts, short texts, and a passage that many unlike texts hold."""
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(400))
    passage, docs = [word() for _ in range(40)], []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 8)):
            docs.append(list(base))
            for _ in range(rng.randint(1, 3)):
                base[rng.randrange(len(base))] = word()
    docs += [[word() for _ in range(rng.randint(5, 60))] + passage for _ in range(40)]
    rng.shuffle(docs)
    return dict(enumerate([" ".join(d) for d in docs] + ["", " \n", "one two", "One  two", "one two three"]))


@pytest.mark.parametrize("seed, spare", [(1, 200), (2, 3)])
def test_no_near_copy_is_lost(spark, seed, spare):
    docs = made(random.Random(seed))
    got = near_components(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spare=spare).collect()
    want = similar_groups(docs)
    assert len(set(want.values())) < len(docs) - 10
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(docs)


def test_stage_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = similar_groups({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    assert {r.doc_id for r in stage(spark, docs, sf_dir).collect()} == {d for d, g in want.items() if d == g}


def test_edges(spark):
    docs = spark.createDataFrame([(3, None), (5, ""), (None, "a b c d e f"), (7, "x y"), (7, "x y"), (8, "z " * 100_000)], "doc_id long, text string")
    got = near_components(docs).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(None, None), (3, 3), (5, 3), (7, 7), (7, 7), (8, 8)]
    assert near_components(docs.where(F.lit(False))).count() == 0


def test_mark_is_a_lower_bound():
    rng = np.random.default_rng(3)
    for n, m, both in [(0, 1, 0), (1, 1, 1), (40, 33, 30), (300, 256, 250), (3000, 2500, 100)]:
        h = np.unique(rng.integers(0, 2**63, n + m, dtype=np.uint64) * np.uint64(2))
        x, y = h[:n], h[n - both : n - both + m]
        bits = int(np.bitwise_count((mark(x) ^ mark(y)).view(np.uint64)).sum())
        assert bits <= n + m - 2 * both and (n + m - 2 * both - bits) % 2 == 0
        assert not (mark(x) ^ mark(x)).any()
    assert bits > MARK_BITS // 3


def test_rows_of_a_shingle_bear_no_whole_mark(spark, monkeypatch):
    """A text has hundreds of these rows; with 64 bytes of mark in each the stage took more disk than its limit."""
    seen, stored = {}, near_copies.stored
    monkeypatch.setattr(near_copies, "stored", lambda df, tag, *a: seen.setdefault(tag, df.schema.simpleString()) and stored(df, tag, *a))
    near_components(spark.createDataFrame(list(made(random.Random(3)).items()), "doc_id long, text string")).count()
    assert "prefix-shingles" not in seen
    assert all("array" not in seen[tag] for tag in ("shared-shingles", "shared-by-component"))


def test_wide_mark_is_a_lower_bound():
    rng = np.random.default_rng(4)
    assert wide_mark(np.arange(MARK_BITS, dtype=np.uint64)) is None
    for n, m, both in [(513, 520, 500), (1000, 1100, 900), (3000, 2500, 100), (600, 9000, 0)]:
        h = np.unique(rng.integers(0, 2**63, n + m, dtype=np.uint64) * np.uint64(2))
        x, y = wide_mark(h[:n]), wide_mark(h[n - both : n - both + m])
        assert wide_difference(x, y) == wide_difference(y, x) <= n + m - 2 * both
        assert (n + m - 2 * both - wide_difference(x, y)) % 2 == 0 and wide_difference(x, x) == 0
    assert len(x) == 128 and len(y) == 2048


def test_whole_sets_of_unlike_long_texts_do_not_move(spark, monkeypatch):
    """Marks of 512 bits bound nothing for them, so their sets of some 20 KB went through two shuffles for every such pair."""
    rng, rows, stored = random.Random(5), {}, near_copies.stored
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(4000))
    passage = [word() for _ in range(60)]
    docs = {i: [word() for _ in range(1500)] + passage for i in range(8)}
    docs[8] = docs[3][:700] + ["other"] + docs[3][701:]

    def counted(df, tag, *a):
        out = stored(df, tag, *a)
        rows[tag] = rows.get(tag, 0) + out.count()
        return out

    monkeypatch.setattr(near_copies, "stored", counted)
    got = near_components(spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: 3 if d == 8 else d for d in docs}
    assert rows["near-candidates"] == 1 and rows["likely-pairs"] > 10
