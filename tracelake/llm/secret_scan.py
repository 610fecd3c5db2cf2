"""Secret scan with corpus-wide ownership frequency.

Each text is scanned once, in Arrow batches, for the base patterns (assignment
of a credential, access key id, long hex run) and for further long mixed tokens.
The 128-bit hash of every candidate value is then aggregated over the corpus by
distinct owner and distinct repository: a value that many hold is a copied
example, one that stays with one owner in few repositories looks live.  Base
spans are always reported; the ownership verdict adds a span of kind ``live``
for each place of a value that looks live, base values and other tokens alike.

The scan result (spans and hashes, no texts) is written once.  Values are
reduced to distinct (hash, owner, repository) before they are counted, and
counted in two steps, so a value that a third of the rows hold is never gathered.

Defined results: a null text is an empty text; a null owner or repository is a
value of its own; every input row gets an output row, repeated rows included;
an empty table gives an empty result; other input columns are not returned.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import stored

#: The base patterns, ASCII letters of the first in either case.
ASSIGN = re.compile(
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")  # the maximal runs of [0-9a-f]+ with 24 or more
TOKEN = re.compile("[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "live")
MIN_DIFFERENT = 10  # characters of a mixed token
HINTS = ("passw", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) of the base patterns, by start, then kind."""
    out = []
    low = text.lower()  # only decides whether the pattern can match at all
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def token_spans(text: str, taken: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Long mixed tokens outside the base spans."""
    out, k = [], 0
    for m in TOKEN.finditer(text):
        v = m.group()
        if len(set(v)) < MIN_DIFFERENT or not any(c.isdigit() for c in v) or not any(c.isalpha() for c in v):
            continue
        while k < len(taken) and taken[k][2] <= m.start():
            k += 1
        if not any(t[0] < m.end() and m.start() < t[2] for t in taken[k:]):
            out.append((m.start(), 3, m.end(), m.start(), m.end()))
    return out


NAMES = ("start", "kind", "stop", "a", "b", "h1", "h2")
SPAN = "struct<start:long,kind:int,stop:long,a:long,b:long,h1:long,h2:long>"


def _scan(batches):
    span = pa.struct([(k, pa.int32() if k == "kind" else pa.int64()) for k in NAMES])
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = []
            for text in part.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                spans = []
                for start, kind, stop, a, b in base + token_spans(text, base):
                    digest = xxhash.xxh3_128_digest(text[a:b])
                    halves = (int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True))
                    spans.append(dict(zip(NAMES, (start, kind, stop, a, b, *halves), strict=True)))
                found.append(spans)
            rows = pa.array(range(row, row + part.num_rows), pa.int64())
            row += part.num_rows
            yield pa.RecordBatch.from_arrays(
                [rows, part.column("id"), part.column("owner"), part.column("repo"), pa.array(found, pa.list_(span))], ["row", "id", "owner", "repo", "found"]
            )


def secret_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "doc_id",
    max_live_owners: int = 1,
    max_live_repos: int = 2,
) -> DataFrame:
    """``(id_col, found, n_live, n_example)``: ``found`` lists (start, kind, stop) of base spans and of live values.

    A table of files would name its repository column; where each document is a
    repository of its own, as by default, that is the id.
    """
    columns = {"id": id_col, "text": text_col}
    narrow = docs.select(*(F.col(c).alias(k) for k, c in columns.items()), *(F.col(c).cast("string").alias(k) for k, c in (("owner", owner_col), ("repo", repo_col))))
    kind = narrow.schema["id"].dataType.simpleString()
    scanned = stored(narrow.mapInArrow(_scan, f"row long, id {kind}, owner string, repo string, found array<{SPAN}>"), "secret-spans")
    each = scanned.select("row", "owner", "repo", F.explode("found").alias("s")).select("row", "owner", "repo", "s.*")
    owners = each.select("h1", "h2", "owner", "repo").distinct().groupBy("h1", "h2", "owner").agg(F.count(F.lit(1)).alias("repos"))
    verdict = owners.groupBy("h1", "h2").agg(((F.count(F.lit(1)) <= max_live_owners) & (F.sum("repos") <= max_live_repos)).alias("live"))
    base = F.when(F.col("kind") < 3, F.struct("start", "kind", "stop"))
    added = F.when(F.col("live"), F.struct(F.col("a").alias("start"), F.lit(3).alias("kind"), F.col("b").alias("stop")))
    judged = (
        each.join(verdict, ["h1", "h2"])
        .groupBy("row")
        .agg(F.collect_list(base).alias("base"), F.collect_set(added).alias("live"), F.count_distinct(F.when(~F.col("live"), F.struct("a", "b"))).alias("n_example"))
        .select("row", F.size("live").cast("long").alias("n_live"), "n_example", F.sort_array(F.concat("base", "live")).alias("found"))
    )
    none = F.array().cast("array<struct<start:long,kind:int,stop:long>>")
    zero = F.lit(0).cast("long")
    return (
        scanned.select("row", F.col("id").alias(id_col))
        .join(judged, "row", "left")
        .select(id_col, F.coalesce("found", none).alias("found"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_example", zero).alias("n_example"))
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    found = secret_scan(docs)
    names = F.array(*map(F.lit, KINDS))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.stop.cast("string"))), ",")

    base = F.filter("found", lambda s: s.kind < 3)
    return found.select(
        "doc_id",
        *(_count(i).alias(f"n_{KINDS[i]}") for i in range(3)),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
        "n_live",
        "n_example",
    )


def _count(kind: int):
    return F.size(F.filter("found", lambda s: s.kind == kind)).cast("long")


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    # the patterns once more for SQL, which has no positions of matches: each is looked up after the end of the one before
    patterns = {0: ASSIGN.pattern, 1: ACCESS.pattern, 2: "[0-9a-f]+", 3: TOKEN.pattern}
    kinds = ", ".join(f"({k}, regexp_extract_all(t, {quoted(p)}))" for k, p in patterns.items())
    name = "CASE kind " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(KINDS)) + " END"
    listed = f"string_agg({name} || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, source, t, k.kind, k.ms FROM d, LATERAL (VALUES {kinds}) AS k(kind, ms) WHERE len(k.ms) > 0),
r AS (
  SELECT doc_id, source, kind, 1 AS i, t, ms, instr(t, ms[1]) - 1 AS start, instr(t, ms[1]) - 1 + length(ms[1]) AS stop FROM m
  UNION ALL
  SELECT doc_id, source, kind, i + 1, t, ms, stop + instr(substr(t, stop + 1), ms[i + 1]) - 1, stop + instr(substr(t, stop + 1), ms[i + 1]) - 1 + length(ms[i + 1]) FROM r WHERE i < len(ms)),
s AS (SELECT doc_id, source, kind, start, stop, ms[i] AS v, CASE WHEN kind = 0 THEN regexp_extract(ms[i], {quoted(ASSIGN.pattern)}, 2) ELSE ms[i] END AS value FROM r),
b AS (SELECT *, stop - length(value) AS va FROM s WHERE kind = 0 AND length(value) >= 6 OR kind = 1 AND length(v) >= 20 OR kind = 2 AND length(v) >= 24),
x AS (SELECT *, start AS va FROM s WHERE kind = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= {MIN_DIFFERENT}
  AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = s.doc_id AND b.start < s.stop AND s.start < b.stop)),
c AS (SELECT * FROM b UNION ALL SELECT * FROM x),
live AS (SELECT value FROM c GROUP BY value HAVING count(DISTINCT coalesce('=' || source, '')) <= 1 AND count(DISTINCT doc_id) <= 2),
l AS (SELECT DISTINCT doc_id, 3 AS kind, va AS start, stop FROM c WHERE value IN (SELECT value FROM live)),
e AS (SELECT doc_id, count(DISTINCT (va, stop)) AS n FROM c WHERE value NOT IN (SELECT value FROM live) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, {listed} AS base FROM b GROUP BY doc_id),
a AS (SELECT doc_id, {listed} AS spans, count(*) FILTER (WHERE kind = 3) AS n_live FROM (SELECT doc_id, kind, start, stop FROM b UNION ALL SELECT doc_id, kind, start, stop FROM l) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(e.n, 0) AS n_example
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN e USING (doc_id)
"""


OP4_SQL = _sql()
