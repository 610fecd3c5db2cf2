"""Learned scores: accuracy on rows that are held out, folds, and edge cases."""

import zlib

import numpy as np
import pytest

from tracelake.llm import quality_classifier, toxicity
from tracelake.llm.folds import fold, sample_ids, sampled_texts

SF = "/root/testdata/sf0.01"


def accuracy(spark, query, label, folds, held, threshold):
    got = {r.doc_id: r for r in query(spark, SF).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % folds == held) for d, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in got.values())
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    tested = [d for d in labels if got[d].held_out]
    return np.mean([got[d].predicted == labels[d] for d in tested]), len(tested)


def test_toxicity_on_held_out_rows(spark):
    share, n = accuracy(spark, toxicity.op1_toxicity, "toxic", 5, 0, 0.5)
    assert n > 40 and share >= 0.93


def test_quality_on_held_out_rows(spark):
    share, n = accuracy(spark, quality_classifier.op10_quality_classifier, "quality", 4, 2, 0.7)
    assert n > 60 and share >= 0.93


def test_risk_is_not_overfitted_below_zero():
    rng = np.random.default_rng(1)
    p = [[0, int(rng.integers(2, 50))] for _ in range(60)]
    u = [[0, int(rng.integers(2, 50))] if k < 40 else [1, int(rng.integers(2, 50))] for k in range(400)]
    w, b = toxicity.nnpu_fit(p, u, 50, 0.1)
    g = np.array([b + sum(w[c] for c in r) for r in u])
    assert (g[:40] > 0).mean() > 0.9 and (g[40:] < 0).mean() > 0.95


@pytest.mark.parametrize("shift", [0.0, -6.0])
def test_risk_gradient(shift):
    """Against differences of the plain risk; with the negative part below zero, of that part with its sign turned."""
    rng = np.random.default_rng(2)
    gp, gu, prior = rng.normal(2, 1, 20) - shift, rng.normal(0, 1, 50) + shift, 0.3
    parts = toxicity.nnpu_risk(gp, gu, prior)
    assert (parts[1] < 0) == (shift < 0)
    want, both = [], np.append(gp, gu)
    for k in range(70):
        near = [both.copy(), both.copy()]
        near[0][k] += 1e-5
        near[1][k] -= 1e-5
        up, down = (toxicity.nnpu_risk(x[:20], x[20:], prior) for x in near)
        want.append(((up[0] - down[0]) + (up[1] - down[1]) if parts[1] >= 0 else down[1] - up[1]) / 2e-5)
    assert np.allclose(toxicity.nnpu_step(gp, gu, prior), want, atol=1e-7)


def test_score_ties(spark):
    """Equal texts, in any rows, have equal scores, and scores at the threshold are predicted positive."""
    labels = spark.createDataFrame([(i, int(i < 20), int(i < 20)) for i in range(40)], "doc_id long, toxic int, quality int")
    docs = spark.createDataFrame([(i, "one text for all of them") for i in range(40)], "doc_id long, text string")
    for module in (toxicity, quality_classifier):
        assert len({r.score for r in module.score(docs, module.train(docs, labels)).collect()}) == 1


def test_samples_are_bounded_in_rows(spark):
    """Repeated rows of a sampled id count once."""
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(500)] + [(2, "b")], "doc_id long, text string")
    ids = sample_ids(docs, 10)
    assert sorted(r.id for r in sampled_texts(docs, ids, "doc_id", "text").collect()) == [1, 2]


def test_edges_of_scores(spark):
    rows = [(i, f"good words number {i % 7} here", "x") for i in range(40)] + [(100 + i, f"awful nasty words {i % 5}", "x") for i in range(40)]
    rows += [(None, "awful nasty", "y"), (500, None, "y"), (501, "", "y"), (502, "é " * 100_000, "y"), (0, rows[0][1], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(r[0], int((r[0] or 0) >= 100), int((r[0] or 0) < 100), 1) for r in rows[:80]] + [(3, None, None, 1), (4, 0, 1, 1), (None, 1, 1, 1)], "doc_id long, toxic int, quality int, lang int")
    tox = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(tox) == len(rows)
    by = {r.doc_id: r.score for r in tox}
    assert by[None] > 0.5 > by[5] and by[500] == by[501] and 0 <= by[502] <= 1
    good = quality_classifier.score(docs, quality_classifier.train(docs, labels)).collect()
    assert len(good) == len(rows) and all(0 <= r.score <= 1 for r in good)
    by = {r.doc_id: r.score for r in good}
    assert by[500] == by[501]


@pytest.mark.parametrize("module", [toxicity, quality_classifier])
def test_without_labels_or_documents(spark, module):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    got = module.score(docs, module.train(docs, labels)).collect()
    assert len(got) == 1 and 0 <= got[0].score <= 1
    assert module.score(docs.where("false"), module.train(docs.where("false"), labels)).count() == 0


def test_fold_is_the_crc_of_the_text(spark):
    got = spark.createDataFrame([(7,), (None,)], "doc_id long").select("doc_id", fold("doc_id", 5).alias("f")).collect()
    assert {r.doc_id: r.f for r in got} == {7: zlib.crc32(b"7") % 5, None: -1}
