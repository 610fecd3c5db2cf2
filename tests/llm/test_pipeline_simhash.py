from brute import components, fingerprint, similar_groups

import corpus_pipeline


def test_near_dedup_is_by_simhash(spark):
    """A long text of repeated shingles, and the same with some words more: one fingerprint, but a Jaccard similarity below 0.8."""
    text = " ".join(f"w{i % 40}" for i in range(4000))
    docs = {0: text, 1: text + " " + " ".join(f"v{i}" for i in range(20))}
    assert components({d: fingerprint(t) for d, t in docs.items()}, 3)[1] == 0 and similar_groups(docs, 5, 0.8)[1] == 1
    rows = [(d, t, "en", "s", len(t)) for d, t in docs.items()]
    left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert [r.doc_id for r in left.collect()] == [0]
