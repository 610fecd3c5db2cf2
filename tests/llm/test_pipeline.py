from collections import defaultdict

import corpus_pipeline
import public_tokenizers
from brute import contamination, crc32_of_ids, lines, sha, similar_groups
from tokenizers import Tokenizer

import __spark_entry__
from tracelake.llm.toxicity import features, train


def test_stages_against_brute_force(spark, sf_dir):
    read = lambda df: {r.doc_id: r for r in df.collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps, frames = [read(docs)], [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frames.append(corpus_pipeline.stored(stage(spark, frames[-1], sf_dir), "test"))
        assert frames[-1].columns == docs.columns
        steps.append(read(frames[-1]))
    raw, clean, thin, single, fair = steps
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    weights, bias = train(docs.select("doc_id", "text"), labels)
    toxic = {d for d, r in raw.items() if bias + sum(weights.get(w, 0) for w in features(r.text or "")) >= 0}
    assert set(clean) == set(raw) - toxic and all(clean[d] == raw[d] for d in clean)
    want = lines({d: r.text for d, r in clean.items()}, 10)
    assert set(thin) == set(clean)
    assert {d: sha(r.text) for d, r in thin.items()} == {d: w[2] for d, w in want.items()}
    group = similar_groups({d: r.text for d, r in thin.items()}, 5, 0.8)
    assert set(single) == {d for d in thin if group[d] == d}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = contamination({d: r.text for d, r in single.items()}, items)
    assert set(fair) == {d for d in single if not hit[d][4]}
    pieces = corpus_pipeline.STAGES[-1][1](spark, frames[-1], sf_dir).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    have, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        have[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    assert set(have) == set(fair)
    for d, own in have.items():
        ids = [*tokenizer.encode(fair[d].text or "", add_special_tokens=False).ids, 0]
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))] and sum(p.length for p in own) == len(ids)
        assert all(p.ids_crc32 == crc32_of_ids(ids[p.start : p.start + p.length]) for p in own)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))] and sum(p.length for p in own) <= 1024


def test_stages_on_edges(spark, sf_dir):
    """Nulls in every column, empty and repeated texts, a long text, clashing names; then no rows at all."""
    lines_ = "\n".join(f"some line number {i} of a plain text" for i in range(3000))
    rows = [(None, None, None, None, None, 0.9, "k", True), (1, "", "en", "s", 0, 0.9, "k", True), (2, "", "en", "s", 0, 0.1, None, None), (3, lines_, "en", "s", None, None, "k", False)]
    rows += [(None, lines_ + " more", None, None, 1, 0.5, "k", None), (5, "a plain text", "xx", "s", 12, 0.9, "k", True), (5, "a plain text", "xx", "s", 12, 0.9, "k", True)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, hit boolean"
    docs = spark.createDataFrame(rows, schema)
    copies = {2}  # an empty text like that of 1
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, sf_dir), "edges")
        copies -= {2} if "SimHash" in name else set()
        assert out.dtypes == docs.dtypes
        assert {(r.score, r.kept, r.hit) for r in out.collect()} <= {r[5:] for r in rows}
        ids = [r.doc_id for r in out.collect()]
        assert ids.count(None) == 2 and ids.count(5) == 2 and 1 in ids and 3 in ids
        assert {2} & set(ids) == copies
        assert stage(spark, docs.where("false"), sf_dir).count() == 0
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= 6
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), sf_dir).count() == 0


def test_it_is_registered():
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert sum(q.startswith("op") for q in __spark_entry__.queries()) >= 10
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity"
