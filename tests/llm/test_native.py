"""The native operators against brute force, and their edge cases."""

import random
import re

import duckdb
import pytest
from brute import base_rules, contamination, lines, sha

from tracelake.llm.decontamination import decontaminate, op6_decontamination
from tracelake.llm.line_dedup import LineRuns, line_dedup, line_keys, op5_line_dedup
from tracelake.llm.quality_rules import OP9_SQL, common_words, op9_quality_rules, quality_rules


def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_line_query(spark, sf_dir):
    df = op5_line_dedup(spark, sf_dir)
    assert not re.search("Python|Pandas|Arrow", plan_of(df))
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()} == lines(texts(spark, sf_dir), 10)


@pytest.mark.parametrize("batches,fanout", [(1, 4), (5, 4), (7, 2)])
def test_lines_in_any_batches(spark, batches, fanout):
    rng = random.Random(1)
    pool = ["a", " A\t", "b", "", "É", "é", "x  y", "\x0bb\r"] + [f"line {i}" for i in range(30)]
    docs = {i: "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for i in range(40)} | {40: None, 41: "", 42: "\n\n"}
    df = spark.createDataFrame([(i, t, i, "own") for i, t in docs.items()], "doc_id long, text string, h1 int, __gone string")
    got = line_dedup(df, min_docs=4, batches=batches, fanout=fanout).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, sha(r.kept)) for r in got} == lines(docs, 4)
    assert all(r.h1 == r.doc_id and r["__gone"] == "own" for r in got)


def test_runs_are_compacted_and_settle(spark):
    runs = LineRuns(spark, 3, fanout=2)
    for k in range(5):
        runs.ingest(line_keys(spark.createDataFrame([(k, f"same\nonly {k}")], "doc_id long, text string")))
    assert sum(map(len, runs.levels)) <= 3 and len(runs.levels) >= 3
    assert runs.frequent().count() == 1
    assert sorted(r.n for r in runs.counts().collect())[:5] == [1] * 5


def test_repeated_rows_and_null_ids_of_lines(spark):
    rows = [(None, "x"), (None, "y"), (1, "x\nz"), (1, "x\nz"), (1, "q\nx")]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=3)
    assert sorted((r.doc_id or 0, r.n_dropped, r.kept) for r in got.collect()) == [(0, 0, "y"), (0, 1, ""), (1, 1, "q"), (1, 1, "z"), (1, 1, "z")]
    many = "\n".join(f"line {i}" for i in range(20_000))
    got = line_dedup(spark.createDataFrame([(i, many + f"\nown {i}") for i in range(3)], "doc_id long, text string"), min_docs=3)
    assert sorted((r.n_dropped, r.kept) for r in got.collect()) == [(20_000, f"own {i}") for i in range(3)]
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_decontamination_query(spark, sf_dir):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    df = op6_decontamination(spark, sf_dir)
    assert not re.search("Python|Pandas|Arrow", plan_of(df))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}
    assert got == contamination(texts(spark, sf_dir), items)


@pytest.mark.parametrize("rows", [100_000, 0])
def test_short_items_and_shuffled_joins(spark, rows):
    rng = random.Random(2)
    words = ["aa", "bb", "cc", "dd", "É", "9"]
    say = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(words) for _ in range(n))
    items = [(f"i{k}", say(rng.choice([1, 2, 4, 7, 10, 14]))) for k in range(25)] + [("i0", "zz"), ("n", None), ("e", "")]
    docs = {i: say(rng.randint(0, 60)) for i in range(60)} | {60: None, 61: "", 62: items[5][1].upper()}
    df = spark.createDataFrame([(i, t, 1) for i, t in docs.items()], "doc_id long, text string, items int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate(df, bench, broadcast_rows=rows).collect()
    want = contamination(docs, items)
    assert {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), sha(",".join(r["items"])), r.n_hit > 0) for r in got} == want


def test_empty_tables_of_decontamination(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id string, text string")
    assert [(r.n_words, r.n_hit) for r in decontaminate(docs, none).collect()] == [(2, 0)]
    assert decontaminate(docs.where("false"), none).count() == 0
    rows = [(None, "a b"), (None, "c"), (1, "c c"), (1, "x c"), (1, "x c")]
    got = decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("i", "c")], "item_id string, text string"))
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in got.collect()) == [(0, 1, 1), (0, 2, 0), (1, 2, 1), (1, 2, 1), (1, 2, 2)]


def test_rule_query(spark, sf_dir):
    df = op9_quality_rules(spark, sf_dir)
    assert not re.search("Python|Pandas|ArrowEval", plan_of(df))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cursor = db.sql(OP9_SQL)
    sql = {x["doc_id"]: x for x in (dict(zip(cursor.columns, v, strict=True)) for v in cursor.fetchall())}
    rows = df.collect()
    for r in rows:
        want = base_rules(texts_of(spark, sf_dir)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert r.kept == sql[r.doc_id]["kept"]
    assert any(not r.kept and not r.base_failed for r in rows)


def test_common_words_are_learned(spark):
    rows = [(f"The, cat{i} (and) a longerword", "en") for i in range(10)] + [("und die xx", "de"), ("the the the", None), (None, "en"), ("", "fr")]
    got = {r.lang: r.list for r in common_words(spark.createDataFrame(rows, "text string, lang string")).collect()}
    assert got == {"en": ["a", "and", "the"], "de": ["die", "und", "xx"], None: ["the"]}


_cache: dict = {}


def texts_of(spark, sf_dir):
    if sf_dir not in _cache:
        _cache[sf_dir] = texts(spark, sf_dir)
    return _cache[sf_dir]


def test_rules_on_edges(spark):
    rng = random.Random(3)
    plain = [" ".join(rng.choice(["the", "of", "house", "Walks", "river,", "a", "to", "seven"]) + rng.choice(["", "ing", "er"]) for _ in range(200)) for _ in range(20)]
    odd = " ".join("$$##" + str(rng.randrange(10**6)) for _ in range(200))
    rows = [(i, t, "en", 1) for i, t in enumerate(plain)] + [(50, odd, "en", 1), (51, None, "en", 1), (52, "", None, 1), (53, "a b a b a b", "xx", 1), (None, "w " * 30_000, "en", 1), (7, plain[7], "en", 1)]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, chars int")).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i in range(20)) and not any(kept[i] for i in (50, 51, 52, 53, None))
    assert {r.doc_id: r.n_repeat_words for r in got}[53] == 6 and {r.doc_id: r.n_repeat_words for r in got}[None] == 30_000
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
