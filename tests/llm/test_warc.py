"""Web archives: round trips, revisits, a plain reading with gzip, damage and edge cases."""

import base64
import gzip
import hashlib
import random
import zlib

import duckdb
import pytest

from tracelake.llm.warc import OP11_SQL, judged, member, op11_warc, read_archives, read_records, record, write_archives


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def expected(rows):
    """(id, bytes, digest, type, refers_to) of (id, html) rows with ids."""
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        first[b] = min(i, first.get(b, i))
    return sorted((i, len(b), digest(b), "response" if i == first[b] else "revisit", None if i == first[b] else first[b]) for i, b in data)


def found(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_query_equals_plain_version_and_sql(spark, sf_dir):
    df = op11_warc(spark, sf_dir)
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert found(df) == sorted(expected(rows), key=str)
    assert df.where("NOT valid").count() == 0
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = con.sql(OP11_SQL)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in want.columns)) for r in df.collect())


def test_copies_edges_and_rolling(spark, tmp_path):
    rng = random.Random(3)
    texts = ["", None, "é" * 70_000, "a\r\n\r\nWARC/1.1\r\n\r\nb", "x", "<p>hot</p>"]
    rows = [(i, f"http://a/{i} b\r\nWARC-Type: x", rng.choice(texts) if i % 3 else "<p>hot</p>", i, "own") for i in range(200)]
    rows += [(200, None, "y" * 3_000_000, 0, "z"), (5, "u", rows[5][2], 0, "again")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int, first string")
    manifest = write_archives(judged(df), str(tmp_path / "w"), roll_bytes=2_000)
    assert manifest.count() > 4
    got = read_archives(manifest, manifest.archive_folder, with_payload=True).collect()
    assert sorted(((int(r.id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in got), key=str) == sorted(expected([(r[0], r[2]) for r in rows]), key=str)
    by_id = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(r.valid and (r.payload is None if r.record_type == "revisit" else bytes(r.payload) == by_id[int(r.id)]) for r in got)
    assert {r.url for r in got if int(r.id) == 200} == {None} and all("\n" not in r.url for r in got if r.url)
    # other tools read the files as plain concatenated gzip
    listed = [r.path for r in manifest.collect()]
    plain = b"".join(gzip.open(p).read() for p in listed)
    assert plain.count(b"WARC-Record-ID") == len(rows)


def test_null_ids_and_min_bytes(spark):
    rows = [(None, "u", "same"), (None, "u", "same"), (3, "u", "same"), (None, "u", "lone"), (None, "u", "lone"), (1, "u", "ab"), (2, "u", "ab")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    kinds = [(bytes(r.payload).decode(), r.id, r.refers_to) for r in judged(df, min_bytes=3).collect()]
    assert sorted(kinds, key=str) == sorted([("same", None, 3), ("same", None, 3), ("same", 3, None), ("lone", None, None), ("lone", None, None), ("ab", 1, None), ("ab", 2, None)], key=str)
    manifest = write_archives(judged(df))
    assert read_archives(manifest, manifest.archive_folder).where("valid").count() == 7


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    manifest = write_archives(judged(df))
    assert manifest.count() == 0
    assert read_archives(manifest, manifest.archive_folder).count() == 0


def cut(data, n):
    return (data[i : i + n] for i in range(0, len(data), n))


@pytest.mark.parametrize("n", [1, 7, 100, 1 << 16])
def test_pieces_of_any_size(n):
    data = member(record("response", "1", "http://a", b"p" * 1000)) + member(record("revisit", "2", "http://a", b"p" * 1000, "1")) + member(record("response", "3", None, b""))
    got = list(read_records(cut(data, n), "f", True))
    assert [(r["id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["valid"]) for r in got] == [("1", "response", None, 1000, True), ("2", "revisit", "1", 1000, True), ("3", "response", None, 0, True)]
    assert got[0]["payload_digest"] == got[1]["payload_digest"] == digest(b"p" * 1000)


def test_damage():
    good = record("response", "1", "http://a", b"payload")
    assert [r["valid"] for r in read_records(iter([member(good.replace(b"payload", b"paylaod"))]), "f")] == [False]
    for bad in (member(good)[:-3], member(good + b"x"), member(good.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9")), member(b"no record\r\n\r\n"), b"plain bytes", zlib.compress(good)):
        with pytest.raises(ValueError, match="f:"):
            list(read_records(iter([bad]), "f"))
