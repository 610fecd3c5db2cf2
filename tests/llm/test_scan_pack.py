import random
from collections import defaultdict

import public_tokenizers
import pytest
from brute import crc32_of_ids, secrets
from tokenizers import Tokenizer

from tracelake.llm.packing import Packer, conversation_packing, op8_packing, pack, pack_examples, tokenized
from tracelake.llm.secret_scan import op4_secret_scan, secret_scan


def test_secret_spans_equal_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in op4_secret_scan(spark, sf_dir).collect()}
    assert set(got) == set(docs)
    for d, t in docs.items():
        want, listed = secrets(t)
        assert (got[d].n_assign, got[d].n_access, got[d].n_hex, got[d].base_sha256) == want
        assert [x for x in got[d].spans.split(",") if x and not x.startswith("live:")] == [x for x in listed.split(",") if x]


def test_ownership_separates_examples_from_live_values(spark):
    own, shared = "a1B2c3D4e5F6g7H8i9J0k1", "Zz9Yy8Xx7Ww6Vv5Uu4Tt3S"
    rows = [(1, f"x {own} y", "s1", "en"), (2, f"é {shared}", "s1", "en"), (3, shared, "s2", "en"), (4, None, None, None), (5, "", "s2", None), (5, "", "s2", None)]
    rows += [(None, f"password = {own}.", "s1", "en"), (7, "token=abc token:token:abcdef", "s3", "de")]
    got = secret_scan(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    found = {r.doc_id: [tuple(x) for x in r.found] for r in got}
    assert len(got) == len(rows)
    assert found[1] == [(2, 3, 24)] and found[2] == [] and found[3] == []
    assert found[4] == [] and found[5] == []
    assert found[None] == [(0, 0, 34), (11, 3, 34)] and found[7] == []
    assert {r.doc_id: r.n_example for r in got}[2] == 1 and {r.doc_id: r.n_live for r in got}[1] == 1


def test_verdict_on_base_values_and_long_texts(spark):
    """A value in three documents of one owner is an example, one in two documents is live; a value found twice has one live span."""
    filler = "plain words of a long text, " * 20_000
    rows = [(i, f"token = {'ab12' * 8}", "s1") for i in range(3)] + [(10 + i, f"{filler}key {'cd34' * 8}", "s1") for i in range(2)]
    got = {r.doc_id: [tuple(x) for x in r.found] for r in secret_scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] == got[2] == [(0, 0, 40), (8, 2, 40)]
    at = len(filler) + 4
    assert got[10] == got[11] == [(at, 2, at + 32), (at, 3, at + 32)]
    assert secret_scan(spark.createDataFrame([(1, "token = " + "ab12" * 8, "s")], "doc_id long, text string, source string")).first().n_live == 1


def test_secret_scan_of_an_empty_table(spark):
    assert secret_scan(spark.createDataFrame([], "doc_id long, text string, source string, lang string, found string")).count() == 0


def test_pieces_give_back_all_ids(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in docs.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in op8_packing(spark, sf_dir).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for d, rows in pieces.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want[d])
            assert r.ids_crc32 == crc32_of_ids(want[d][at : at + r.length])
            at += r.length
        assert at == len(want[d])
    padding = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= 0.01 * sum(map(len, want.values()))


def test_packing_edges(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a b " * 3000, "x"), (4, "ſé<|endoftext|>\n\n  x", "x")]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, start string"), path, with_ids=True).collect()
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in {(r.doc_id, r.doc_tokens): r for r in got}.values()) + 1
    want = Tokenizer.from_file(path).encode(rows[4][1], add_special_tokens=False).ids
    assert [i for r in sorted((r for r in got if r.doc_id == 4), key=lambda r: r.start) for i in r.ids] == [*want, 0]
    assert pack(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


@pytest.mark.parametrize("cut", [True, False])
def test_limits_hold(cut):
    rng = random.Random(3)
    items = [(i, n := rng.randint(1, 100), rng.randint(0, n)) for i in range(500)]
    packer = Packer(100, 4, 60, cut, 32)
    if not cut:
        items = [(i, n, min(x, 60)) for i, n, x in items]
    sequences = [*packer.add(items), *packer.finish()]
    need, seen = {i: (n, x) for i, n, x in items}, defaultdict(int)
    for s in sequences:
        assert len(s) <= 4 and sum(b - a for _, a, b in s) <= 100
        assert sum(need[k][1] * (b - a) / need[k][0] for k, a, b in s) <= 60 + 1e-6
        for k, a, b in s:
            assert a == seen[k]
            seen[k] = b
    assert seen == {i: n for i, n, _ in items}


@pytest.mark.parametrize("sizes", [[5], [40], [120], [1], [5, 5, 5, 900], [3, 2000]])
def test_short_documents_fill_sequences(sizes):
    rng = random.Random(4)
    items = [(i, n := rng.choice(sizes), n - 1) for i in range(3000)]
    packer = Packer(1024, None, 1024)
    sequences = [s for lo in range(0, 3000, 128) for s in packer.add(items[lo : lo + 128])] + [*packer.finish()]
    lengths = [sum(b - a for _, a, b in s) for s in sequences]
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in lengths)
    assert sum(lengths) == sum(n for _, n, _ in items) and padding < 0.01 * sum(lengths)
    most, mean = max(map(len, sequences)), sum(n for _, n, _ in items) / 3000
    assert most <= max(4, 3 * 1024 / mean + 1)  # the limit still binds: mixed lengths don't make sequences of short documents alone


def test_examples_stay_whole(spark):
    rows = [(i, 10 + i % 50, i % 20) for i in range(200)] + [(None, 5, None), (300, 500, 1), (301, 3, 41)]  # the last two are beyond a limit
    df = spark.createDataFrame(rows, "id long, tokens long, loss long")
    got = pack_examples(df, "id", "tokens", "loss", 100, 6, 40).collect()
    assert sorted((r.id is None, r.id or 0) for r in got) == sorted((i is None, i or 0) for i, _, _ in rows)
    need, sums = {i: (n, x or 0) for i, n, x in rows}, defaultdict(lambda: [0, 0, 0])
    for r in got:
        sums[r.sequence_id] = [a + b for a, b in zip(sums[r.sequence_id], (1, *need[r.id]), strict=True)]
    assert sum(n > 100 or x > 40 for _, n, x in sums.values()) == 2 and all(k <= 6 for k, _, _ in sums.values())


def test_three_limits_bind_on_conversations(spark):
    rows = conversation_packing(spark, "/root/testdata/sf0.01").collect()
    sums = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        sums[r.sequence_id] = [a + b for a, b in zip(sums[r.sequence_id], (1, r.tokens, r.loss), strict=True)]
    assert all(k <= 6 and (k == 1 or n <= 4096 and x <= 3072) for k, n, x in sums.values())
    assert len({r.conv_id for r in rows}) == len(rows) == spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id").distinct().count()
    assert any(k == 6 for k, _, _ in sums.values()) and any(x > 2700 for _, _, x in sums.values())


def test_ids_of_both_libraries_agree():
    """The fast path gives the ids of the tokenizers library; other files go to that library itself."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encode = Tokenizer.from_file(path), tokenized(path)
    rng = random.Random(5)
    letters = "abz AZ09\n\t  .,'\u00e9\u00df\u4e2d\U0001f600\u0301\u00a0_<|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(3000)] + ["<|endoftext|>x", "it's we'LL", " " * 300, "a" * 5000]
    for t in texts:
        assert encode(t).tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
