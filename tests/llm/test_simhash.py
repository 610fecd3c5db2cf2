import random

import numpy as np
from brute import components, fingerprint

from tracelake.llm import simhash
from tracelake.operators.graph import roots


def test_result_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    prints = {d: fingerprint(t) for d, t in docs.items()}
    want = components(prints, 3)
    got = {r.doc_id: r for r in simhash.op2_simhash(spark, sf_dir).collect()}
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {d: r.component_id for d, r in got.items()} == want


def _near(rng, n):
    out = {rng.getrandbits(64) for _ in range(n)}
    for p in list(out)[: n // 3]:
        for _ in range(rng.randint(1, 6)):
            q = p
            for _ in range(rng.randint(1, 4)):
                q ^= 1 << rng.randrange(64)
            out.add(q)
    return sorted(out)


def test_no_link_is_lost(spark):
    prints = _near(random.Random(5), 300)
    want = components(dict(enumerate(prints)), 3)
    for rows in (1 << 18, 50):
        df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
        root = {r.node % (1 << 64): r.root % (1 << 64) for r in roots(simhash.links(df, block_rows=rows)).collect()}
        groups: dict = {}
        for i, p in enumerate(prints):
            groups.setdefault(root.get(p, p), []).append(i)
        assert {i: g[0] for g in groups.values() for i in g} == want


def test_lower_bound():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    bound = np.bitwise_count(simhash.unary_counts(a) ^ simhash.unary_counts(b))
    assert (bound <= np.bitwise_count(a ^ b)).all() and bound.max() > 10
    assert len(simhash.cell_masks()) == 20


def test_edges(spark):
    rows = [(3, None, 0), (5, "", 0), (5, "", 1), (None, "a b c d", 2), (8, "x " * 200_000, 3), (9, "É é A", 4)]
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string, fp long")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (3, 3), (5, 3), (5, 3), (8, 8), (9, 9)]
    assert all(r.fp % (1 << 64) == fingerprint(t) for r in got for d, t, _ in rows if d == r.doc_id)
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
