import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from brute import bytes_dedup, words_dedup

from tracelake.llm import repeats, substring_dedup, suffix_dedup


def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def by_bytes(df):
    return {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in df.collect()}


def by_words(df):
    return {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in df.collect()}


def planted(rng, n, unit):
    """Documents that share passages of many lengths."""
    shared = ["".join(rng.choice(unit) for _ in range(rng.randint(30, 400))) for _ in range(6)]
    docs = {}
    for i in range(n):
        parts = [rng.choice([*shared, "".join(rng.choice(unit) for _ in range(rng.randint(5, 200)))]) for _ in range(rng.randint(0, 6))]
        docs[i] = "".join(parts)
    docs[n] = docs[0]
    return docs


def test_queries_equal_brute_force(spark, sf_dir):
    docs = texts(spark, sf_dir)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op3_suffix_dedup(spark, sf_dir).collect()}
    assert got == bytes_dedup(docs, 400)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.op7_substring_dedup(spark, sf_dir).collect()}
    assert got == words_dedup(docs, 20)


@pytest.mark.parametrize("group", [256, 2])
def test_planted_bytes(spark, group):
    docs = planted(random.Random(2), 60, ["ab ", "c", "é", "\n"])
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for report, length in ((40, 40), (40, 130), (100, 130)) if group > 2 else ((40, 130),):
        got = suffix_dedup.suffix_dedup(df, length=length, report=report, group=group, block_bytes=5000)
        assert by_bytes(got) == bytes_dedup(docs, length)
        if report < length:
            assert {r.doc_id: r.n_repeated for r in got.collect()} == {k: v[1] for k, v in bytes_dedup(docs, report).items()}


@pytest.mark.parametrize("group", [256, 2])
def test_planted_words(spark, group):
    docs = planted(random.Random(3), 60, ["a ", "b ", "c\t", "dé\n"])
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for window in (6, 20) if group > 2 else (20,):
        assert by_words(substring_dedup.substring_dedup(df, window=window, group=group, block_bytes=5000)) == words_dedup(docs, window)


@pytest.mark.parametrize("length", [33, 95, 136, 260, 400, 509])
def test_sorted_blocks(length):
    """The difference-cover sort against all strings, in one bucket and in many."""
    rng = random.Random(length)
    pool = [bytes(rng.choice(b"ab") for _ in range(length + 80)) for _ in range(4)]
    frags, off, n = [], [], []
    for _ in range(30):
        p = bytearray(rng.choice(pool))
        if rng.random() < 0.7:
            p[rng.randrange(len(p))] ^= 3
        frags.append(bytes(p))
        off.append(40)
        n.append(81)
    seen: dict = {}
    for f in frags:
        for i in range(81):
            seen[f[i : i + length], i] = seen.get((f[i : i + length], i), 0) + 1
    want = [seen[f[i : i + length], i] > 1 for f in frags for i in range(81)]
    for bucket in (1 << 19, 100):
        (got,) = suffix_dedup.repeated_windows(frags, np.array(off), np.array(n), (length,), bucket)
        assert got.tolist() == want
        if length > 136:  # both depths at once; the shorter one's windows start at the same places
            short = [f[i : i + 120] for f in frags for i in range(81)]
            many = {(x, k % 81) for k, x in enumerate(short) if sum(short[j] == x for j in range(k % 81, len(short), 81)) > 1}
            got = suffix_dedup.repeated_windows(frags, np.array(off), np.array(n), (120, length), bucket)
            assert got[1].tolist() == want
            assert got[0].tolist() == [(x, k % 81) in many for k, x in enumerate(short)]


def test_budgets_are_met_in_production_sizes():
    """A block of the default size has more windows than a bucket or a subtree may hold, so both methods split it."""
    rng = random.Random(9)
    frags = [bytes(rng.choice(b"ab ") for _ in range(700)) for _ in range(4000)]
    n = np.full(len(frags), 301)
    off = np.full(len(frags), 300)
    lead = suffix_dedup.eight_bytes(np.frombuffer(b"".join(frags), dtype=np.uint8), ">")
    assert len(list(suffix_dedup.suffix_buckets(lead, suffix_dedup.BUCKET))) > 10
    assert not suffix_dedup.repeated_windows(frags, off, n, (400,))[0].any()
    edges = np.array([rng.randrange(50) for _ in range(300_000)])
    at = np.arange(len(edges) - 20)
    assert len(substring_dedup.prefix_groups(edges, at, 20, substring_dedup.BUDGET)) > 5


def test_small_budgets_give_the_same_trees():
    rng = random.Random(4)
    frags = [b" ".join(rng.choice([b"a", b"b"]) for _ in range(40)) for _ in range(50)]
    frags += frags[:10]
    n = np.full(len(frags), 21)
    want = substring_dedup.later_windows(frags, n, np.arange(len(frags)), 20)
    for budget in (1, 7, 100):
        assert (substring_dedup.later_windows(frags, n, np.arange(len(frags)), 20, budget) == want).all()


def test_difference_cover():
    assert {(a - b) % 31 for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(31))


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(5)
    grams = rng.integers(0, 2**63, 500, dtype=np.uint64)
    grams = np.concatenate([grams, grams[100:300], grams[::-1]])
    for pos, lo, n in repeats.window_anchors(grams, 16):
        for p, a, k in zip(pos, lo, n, strict=True):
            for s in range(a, a + k):
                assert s + int((grams[s : s + 16] & ~repeats.LOW).argmin()) == p
    assert not list(repeats.window_anchors(grams[:10], 16))


def test_edges(spark):
    long = " ".join(f"w{i % 37}" for i in range(60_000))
    rows = [(1, None, 0), (2, "", 1), (3, long, 2), (3, long, 3), (None, "x y z", 4), (None, long[:3000], 5), (7, long[1000:2000], 6), (7, "other", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    docs = {1: None, 2: "", 3: long, -1: "x y z", -2: long[:3000], 7: long[1000:2000], 8: "other"}
    want = bytes_dedup({k: v for k, v in docs.items() if k != 3}, 400) | {}
    got = sorted((r.doc_id or 0, r.n_bytes, len(r.kept)) for r in suffix_dedup.suffix_dedup(df).collect())
    assert got == sorted([(0, 5, 5), (0, 3000, 0), (1, 0, 0), (2, 0, 0), (3, len(long), 0), (3, len(long), 0), (7, 1000, 0), (7, 5, 5)])
    assert want[-2][1] == 3000
    words = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(df).collect())
    n3, n7 = len(long.split()), len(long[1000:2000].split())
    first = len(long[:3000].split())
    assert [w for w in words if w[0] in (1, 2)] == [(1, 0, 0), (2, 0, 0)]
    assert (3, n3, n3) in words and words.count((3, n3, n3)) == 2
    assert (0, 3, 0) in words and any(w[:2] == (0, first) and 0 < w[2] < first for w in words)
    assert any(w[:2] == (7, n7) and w[2] >= n7 - 2 for w in words)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.suffix_dedup(empty).count() == 0 and substring_dedup.substring_dedup(empty).count() == 0


def test_only_windows_left_need_ranks(monkeypatch):
    """Every position of the cover sample was ranked before, though most windows that share no more than an anchor differ at their ends."""
    rng = np.random.default_rng(6)
    some = lambda k: rng.integers(97, 123, k, dtype=np.uint8).tobytes()
    anchor, ranked, init = some(64), [], suffix_dedup.CoverRanks.__init__

    def counted(self, *args):
        init(self, *args)
        ranked.append(len(self.rank))

    monkeypatch.setattr(suffix_dedup.CoverRanks, "__init__", counted)
    frags = [some(200) + anchor + some(200) for _ in range(40)]
    off, n = np.full(40, 200), np.full(40, 464 - 256 + 1)
    assert not any(f.any() for f in suffix_dedup.repeated_windows(frags, off, n, (256, 400))) and not ranked
    frags[7] = frags[3][:-1] + b"!"
    near, far = suffix_dedup.repeated_windows(frags, off, n, (256, 400))
    assert near.sum() == 2 * 208 and far.sum() == 2 * 64
    assert len(ranked) == 1 and ranked[0] < 300  # of a cover sample of 3,592


def test_spans_of_rows():
    kind = pa.list_(pa.struct([("d", pa.int32()), ("a", pa.int32()), ("b", pa.int32())]))
    spans = pa.array([[{"d": 0, "a": 9, "b": 9}], None, [{"d": 0, "a": 1, "b": 4}, {"d": 1, "a": 0, "b": 2}, {"d": 0, "a": 3, "b": 6}], []], kind).slice(1)
    got = [[repeats.mask_of(6, s, d).astype(int).tolist() for d in (0, 1)] for s in repeats.rows_of_spans(spans)]
    assert got == [[[0] * 6, [0] * 6], [[0, 1, 1, 1, 1, 1], [1, 1, 0, 0, 0, 0]], [[0] * 6, [0] * 6]]
