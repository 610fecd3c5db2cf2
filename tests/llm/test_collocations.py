"""Phrase mining: the query against a plain version and SQL, shards and bitmaps that must not matter, edge cases."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tracelake.llm.collocations import OP13_SQL, bitmap, frequent_phrases, joined, op13_collocations, present, scored, top_phrases, words_of

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain_counts(docs):
    f, n = Counter(), Counter()
    for t, lang in docs:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    return f, n


def plain_top(docs, support=30, top=2000):
    f, n = plain_counts(docs)
    candidates = {p: a for p, a in f.items() if a >= support and len(p[1]) > 1}
    longer = {}
    for (lang, ws), a in candidates.items():
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                key = (lang, ws[i : i + m])
                longer[key] = max(a, longer.get(key, 0))
    rows = []
    for (lang, ws), a in candidates.items():
        if 100 * longer.get((lang, ws), 0) >= 80 * a:
            continue
        score, _, l, r = min((2000000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
        rows.append((lang, -score, -a, " ".join(ws).encode(), l, r))
    out, rank = [], Counter()
    for lang, score, a, phrase, l, r in sorted(rows):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return out


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_query_equals_plain_version_and_sql(spark, sf_dir):
    docs = [(r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = found(op13_collocations(spark, sf_dir))
    assert got == plain_top(docs) and len(got) > 30
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    q = con.sql(OP13_SQL)
    at = [q.columns.index(c) for c in COLUMNS]
    assert sorted(tuple(r[i] for i in at) for r in q.fetchall()) == got


def texts(seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "New", "york", "é", "É", "\x1cx", "a\xa0b", "中文"] + [f"w{i}" for i in range(25)]
    docs = []
    for i in range(120):
        t = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " ! "]) for _ in range(rng.randint(0, 60)))
        docs.append((i, t + " new york city hall" * rng.randint(0, 3), rng.choice(["en", "en", "fr", None])))
    return docs + [(None, None, "en"), (None, "", "fr"), (1, "of the of the of the", None)] + [(7, "the same text, the same text", "en")] * 20


@pytest.mark.parametrize("shards,filter_bits", [(1, 26), (4, 20), (60, 15)])
def test_shards_and_bitmaps_do_not_matter(spark, shards, filter_bits):
    docs = texts(shards)
    df = spark.createDataFrame([(i, t, lang, "own", 3) for i, t, lang in docs], "doc_id long, text string, lang string, phrase string, n int")
    assert found(top_phrases(df, 30, 5, shards=shards, filter_bits=filter_bits)) == sorted(plain_top([d[1:] for d in docs], 5, 30))
    counts, totals = frequent_phrases(df, 5, shards, filter_bits)
    f, n = plain_counts([d[1:] for d in docs])
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in counts.collect()} == {p: a for p, a in f.items() if a >= 5}
    assert {r.lang: r.n for r in totals.collect()} == dict(n)


def test_small_chunks_and_long_texts(spark, monkeypatch):
    from tracelake.llm import collocations

    monkeypatch.setattr(collocations, "SEGMENT", 50)
    monkeypatch.setattr(collocations, "CHUNK", 100)
    docs = texts(9) + [(500, "one long, text " * 3000, "en")]
    assert [w for part in words_of("Ab c\td,e " * 40) for w in part] == [b"ab", b"c", b"d", b".", b"e"] * 40
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert found(top_phrases(df, 50, 6)) == sorted(plain_top([d[1:] for d in docs], 6, 50))


def test_scores_are_exact_beyond_64_bits(spark):
    big = 4_000_000_000_000_000_000
    rows = [("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 7), ("en", 1, "c", big), ("en", 2, "b c", big // 2), ("en", 3, "a b c", big // 3)]
    got = {r.phrase: (r.score, r.l, r.r) for r in scored(spark.createDataFrame(rows, "lang string, k int, phrase string, f long")).collect()}
    assert got == {
        "a b": (2000000 * (big - 7) // (2 * big + 1), big, big + 1),
        "b c": (2000000 * (big // 2) // (2 * big + 1), big + 1, big),
        "a b c": min((2000000 * (big // 3) // (x + y), x, y) for x, y in ((big, big // 2), (big - 7, big))),
    }


def test_bitmap_has_all_and_little_else(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**63), 2**63 - 1, 500)
    bits = bitmap(spark.createDataFrame([(int(x), -5) for x in h], "h long, seed long"), "seed", 20)
    assert present(bits, h.view(np.uint64), -5).all()
    assert present(bits, joined(h.view(np.uint64), h.view(np.uint64)[::-1]), -5).sum() < 20


def test_empty_tables(spark):
    schema = "doc_id long, text string, lang string"
    assert top_phrases(spark.createDataFrame([], schema)).count() == 0
    assert top_phrases(spark.createDataFrame([(1, None, None), (2, " . ,", "en")], schema)).count() == 0
