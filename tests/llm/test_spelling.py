"""Spelling variants: the trie against all pairs, the query against a plain version, edge cases."""

import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import pytest

from tracelake.llm.spelling import OP12_SQL, Trie, count_words, grouped, heavy_nodes, near_pairs, one_edit, op12_spelling

SCHEMA = "doc_id long, text string"


def plain_counts(docs, alter=None, least=2):
    out = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if alter and h % alter == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= least}


def plain_near(words):
    holes = {}
    for w in words:
        for i in range(len(w)):
            holes.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    near = {w: set() for w in words}
    for (_, rest), ws in holes.items():
        for a in ws:
            near[a] |= {b for b in ws if b != a}
            if rest in near:
                near[a].add(rest)
                near[rest].add(a)
    return near


def plain_groups(counts, ratio=10):
    near, form = plain_near(counts), {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), form[w] and counts[form[w]]))
    return out


def found(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def many_words(seed, n):
    rng = random.Random(seed)
    words = list({"".join(rng.choice("entiaü" if rng.random() < 0.8 else "bcdfghéŁ中") for _ in range(rng.randint(7, 9))) for _ in range(n)})
    for w in words[: n // 2]:
        k = rng.randrange(len(w))
        words.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + "z" + w[k + 1 :], w[:k] + "e" + w[k:]]))
    words += ["a" * 70, "a" * 69, "b" + "a" * 69, "a" * 64, "a" * 65, "a" * 63 + "c", "x" * 5000, "x" * 4999]
    return list(dict.fromkeys(words))


def test_trie_equals_all_pairs():
    words = many_words(1, 800)
    trie, got = Trie(words), []
    for a, b in trie.search(words):
        got += [frozenset((words[i], trie.words[j])) for i, j in zip(a, b, strict=True)]
    assert len(got) == len(set(got))
    assert set(got) == {frozenset((a, b)) for i, a in enumerate(words) for b in words[:i] if one_edit(a, b)}


@pytest.mark.parametrize("node_words", [3, 40, 10_000])
def test_pairs_at_any_node_size(spark, node_words):
    words = many_words(2, 500)
    df = spark.createDataFrame([(w, k + 1) for k, w in enumerate(words)], "word string, n long")
    rows = near_pairs(df, node_words).collect()
    place = {w: k + 1 for k, w in enumerate(words)}
    assert all(place[r.a] == r.na and place[r.b] == r.nb for r in rows)
    got = [frozenset((r.a, r.b)) for r in rows]
    assert len(got) == len(set(got)) and set(got) == {frozenset((a, b)) for a, bs in plain_near(words).items() for b in bs}
    assert bool(heavy_nodes(df, node_words).heavy) == (len(words) > node_words)


def test_words_with_equal_counts_are_shared_out(spark):
    rng = random.Random(5)
    words = list({"".join(rng.sample("entiarosh", 9)) for _ in range(300)}) + ["entiarosk", "entiaros"]
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    top = heavy_nodes(df, 20)
    assert len(top.heavy) > 25 and top.shares.max() >= 15
    assert {frozenset((r.a, r.b)) for r in near_pairs(df, 20).collect()} == {frozenset((a, b)) for a, bs in plain_near(words).items() for b in bs}


def test_query_equals_plain_version(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = op12_spelling(spark, sf_dir).cache()
    want = plain_groups(plain_counts(docs, 31))
    assert found(df) == want and df.count() == len(want) and any(r[1] for r in want)


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    q = con.sql(OP12_SQL)
    at = [q.columns.index(c) for c in ("word", "form", "root", "n", "n_near", "form_n")]
    assert {tuple(r[i] for i in at) for r in q.fetchall()} == found(op12_spelling(spark, sf_dir))


def test_chains_ties_and_edges(spark):
    text = " ".join(["colourful"] * 2000 + ["colorful"] * 200 + ["colorfull"] * 20 + ["Colorfulls", "colorfulls"] + ["zzaaaab"] * 30 + ["zzaaaac"] * 30 + ["zzaaaa"] * 90 + ["zzaaaad"] * 3 + ["once-only"])
    rows = [(1, text), (2, None), (3, ""), (None, "ÀÀÀÀÀÀÀ àààààààà ÀÀÀÀÀÀÀ naïveté×÷ naïveté×÷"), (None, "straße straßes straße straßes")]
    df = spark.createDataFrame([(i, t, "own", 5) for i, t in rows], SCHEMA + ", word string, n int")
    words = count_words(df).cache()
    got = found(grouped(words, near_pairs(words)))
    assert got == plain_groups(plain_counts(rows))
    by = {r[0]: r for r in got}
    assert by["colorfulls"][2] == "colourful" and by["zzaaaad"][1] == "zzaaaab"
    assert count_words(spark.createDataFrame([], SCHEMA)).count() == 0
    none = spark.createDataFrame([], "word string, n long")
    assert grouped(none, near_pairs(none)).count() == 0
    with pytest.raises(ValueError, match="ratio"):
        grouped(words, near_pairs(words), ratio=1)


def test_null_ids_are_written_as_nothing(spark):
    rows = [(None, "abcdefgh ijklmnopq " * 2), (7, "abcdefgh rstuvwxyz " * 3)] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r.word, r.n) for r in count_words(df, alter=2).collect()} == set(plain_counts(rows, 2).items())
