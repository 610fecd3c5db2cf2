"""Near copies by exact Jaccard similarity of word shingles: every pair at or above the limit is linked.

Prefix filter: under one order of all shingles, two sets of similarity ``t``
share a shingle among the first ``n - ceil(t * n) + 1`` of each.  The order is
by hash, with shingles from crowded buckets of a counting sketch last, so a
passage that many texts hold hardly ever makes candidates.  A shared shingle
that is the first common one also bounds what can still be common, and a mark of
512 parity bits bounds from below what only one of two sets has. The first bound, and
the second with the bits folded to 128, are conditions of the join of all pairs; the
whole marks meet the distinct pairs that are left.  Texts of more shingles than a mark
has bits have a wide mark too, of a bit or two a shingle (a 64th of the set or less),
since 512 bits bound nothing beyond some 1,150 shingles; it meets the pairs left then,
and whole sets move for the pairs that pass it only.

Texts of one set are one node, so copies cost nothing more.  First every node is
compared with one node of each of its shingles; most of a group of near copies
becomes one component so, in linear work.  Then all pairs of different components
that share a prefix shingle are compared, so no pair at the limit is left out;
the largest component of a shingle only meets the nodes outside of it.
Pairs are judged on whole sets of 64-bit shingle hashes.

Defined results: words are split and lowered as in ``simhash``; a text of fewer
words than a shingle is one shingle; texts without words, null included, are
copies of each other; every input row gets an output row; a component of rows
with null ids only has a null component id; an empty table gives an empty result.
``docs`` is read several times, so it should be a table, or ``stored`` first.
"""

from __future__ import annotations

from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import shuffle_count, stored
from tracelake.operators.graph import roots
from tracelake.storage import release

BUCKET_BITS, CHUNKS = 20, 16
MARK_BITS, SALTS = 512, 64
BROADCAST_ROWS = 200_000  # of one long each


def shingles(text: str | None, words: int) -> np.ndarray:
    """Distinct XXH64 (seed 42) of a text's word shingles, ascending."""
    w = (text or "").encode().lower().split()
    if w and len(w) < words:
        w, words = [b" ".join(w)], 1
    digest = xxhash.xxh64_intdigest
    grams = zip(*(islice(w, i, None) for i in range(words)), strict=False)
    return np.unique(np.fromiter((digest(b" ".join(g), 42) for g in grams), dtype=np.uint64))


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64)


def prefix(hashes: np.ndarray, crowded: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first shingles of a set, of which two sets of similarity num / den share one. hashes: ascending."""
    n = len(hashes)
    late = crowded[buckets(hashes)]
    return np.concatenate([hashes[~late], hashes[late]])[: n - -(-num * n // den) + 1 if n else 0]


def node_of(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes())


def parities(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bits set where an odd number of shingles falls: two sets differ in no fewer shingles than bits. bits: a power of two."""
    spread = hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32) & np.uint64(bits - 1)
    return np.packbits(np.bincount(spread.astype(np.int64), minlength=bits).astype(np.uint8) & 1)


def mark(hashes: np.ndarray) -> np.ndarray:
    return parities(hashes, MARK_BITS).view(np.int64)


def wide_mark(hashes: np.ndarray) -> bytes | None:
    """As many bits as shingles or more, where these are more than a mark's bits."""
    n = len(hashes)
    return parities(hashes, 1 << (n - 1).bit_length()).tobytes() if n > MARK_BITS else None


def wide_difference(x: bytes, y: bytes) -> int:
    """How many bits two wide marks differ in, the longer one folded: no more than the shingles that only one set has."""
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(np.frombuffer(z, np.uint8).reshape(-1, size), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _marked(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """A row ``(id_col, th, node, mark, wide)`` for each document, and rows ``(chunk, counts)`` of each task's sketch."""
    kind = docs.schema[id_col].dataType.simpleString()
    size = MARK_BITS // 64
    schema = pa.schema([("th", pa.int64()), ("node", pa.int64()), ("mark", pa.list_(pa.int64())), ("wide", pa.binary()), ("chunk", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        count, id_type = np.zeros(1 << BUCKET_BITS, dtype=np.uint32), None
        for batch in batches:
            id_type, nodes = batch.schema.field(0), np.zeros(batch.num_rows, dtype=np.uint64)
            marks, wide = np.zeros((batch.num_rows, size), dtype=np.int64), []
            for i, t in enumerate(batch.column(2)):
                h = shingles(t.as_py(), words)
                np.add.at(count, buckets(h), np.uint32(1))
                nodes[i], marks[i] = node_of(h), mark(h)
                wide.append(wide_mark(h))
            rest = [pa.nulls(batch.num_rows, f.type) for f in schema][4:]
            listed = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * size), pa.array(marks.ravel()))
            columns = [batch.column(0), batch.column(1), pa.array(nodes.view(np.int64)), listed, pa.array(wide, pa.binary()), *rest]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([id_type, *schema]))
        if id_type is not None:
            parts = [pa.nulls(CHUNKS, f.type) for f in (id_type, *schema)][:5]
            parts += [pa.array(range(CHUNKS), pa.int32()), pa.array([c.tobytes() for c in np.split(count, CHUNKS)], pa.binary())]
            yield pa.RecordBatch.from_arrays(parts, schema=pa.schema([id_type.with_nullable(True), *schema]))

    rows = docs.select(id_col, F.xxhash64(text_col).alias("th"), text_col)
    return rows.mapInArrow(run, f"{id_col} {kind}, th long, node long, mark array<long>, wide binary, chunk int, counts binary")


def _crowded(sketch: DataFrame, spare: int) -> np.ndarray:
    """Which buckets hold far more than the mean. Summed by chunk in tasks; 4 MB reach the driver."""

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts.as_py(), dtype=np.uint32).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["chunk", "counts"])

    count = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    for r in sketch.repartition(CHUNKS, "chunk").mapInArrow(total, "chunk int, counts binary").collect():
        size = len(count) // CHUNKS
        count[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(r.counts, dtype=np.int64)
    return count > count.mean() + 8 * np.sqrt(count.mean()) + spare


def _tokens(texts: DataFrame, crowded: np.ndarray, words: int, num: int, den: int) -> DataFrame:
    """``(token, node, n, pos)``: prefix shingles with the size of their set and their place in its order."""
    packed = np.packbits(crowded)

    def run(batches):
        late = np.unpackbits(packed).astype(bool)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [shingles(t.as_py(), words) for t in batch.column(0).slice(at, 256)]
                heads = [prefix(h, late, num, den) for h in sets]
                sizes = [len(h) for h in heads]
                nodes = np.array([node_of(h) for h in sets], dtype=np.uint64).view(np.int64)
                columns = [np.concatenate(heads).view(np.int64), np.repeat(nodes, sizes)]
                columns += [np.repeat([len(h) for h in sets], sizes).astype(np.int32), np.concatenate([np.arange(s) for s in sizes]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "node", "n", "pos"])

    return texts.select("text").mapInArrow(run, "token long, node long, n int, pos int")


def _possible(a: str, b: str, num: int, den: int) -> Column:
    """Whether two sets whose first common shingle this is can reach the similarity."""
    common = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
    return common * (num + den) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * num


def _differ_little(a: list[Column], b: list[Column], sizes: Column, num: int, den: int) -> Column:
    """Whether two sets of so many shingles together can reach the similarity with these marks."""
    return sum(F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)) * (num + den) <= sizes * (den - num)


def _folded() -> list[Column]:
    """128 bits of a mark: parities again, so the bound holds with them too."""
    words = MARK_BITS // 64
    return [reduce(Column.bitwiseXOR, (F.col("mark")[k] for k in range(i, words, 2))) for i in range(2)]


def _wide_enough(pairs: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` that can reach the similarity with their wide marks. pairs: ``a, b, sizes``."""

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(k) for k in ("sizes", "wide_a", "wide_b")), strict=True)
            keep = pa.array([not (x.is_valid and y.is_valid) or wide_difference(x.as_py(), y.as_py()) * (num + den) <= s.as_py() * (den - num) for s, x, y in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in "ab"], ["a", "b"])

    for k in "ab":
        pairs = pairs.join(marks.select(F.col("node").alias(k), F.col("wide").alias(f"wide_{k}")), k)
    return pairs.mapInArrow(run, "a long, b long")


def _similar(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose whole sets have a similarity of num / den or more."""

    def sets(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [shingles(t.as_py(), words) for t in batch.column(0).slice(at, 256)]
                held = [np.array([node_of(h) for h in found], dtype=np.uint64).view(np.int64), pa.array([h.tobytes() for h in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(held[0]), held[1]], ["node", "hashes"])

    def good(x, y):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        return len(np.intersect1d(x, y, assume_unique=True)) * (num + den) >= (len(x) + len(y)) * num

    def judge(batches):
        for batch in batches:
            keep = pa.array([good(x.as_py(), y.as_py()) for x, y in zip(*batch.columns[2:], strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    needed = stored(nodes.join(needed, "node", "left_semi").groupBy("node").agg(F.min("th").alias("th")).select("th").distinct(), "needed-texts")
    few = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    one = texts.join(few, "th", "left_semi").groupBy("th").agg(F.first("text").alias("text"))
    # a text of an equal hash would be another node's, which no pair may name, or the same one's again
    held = stored(one.select("text").mapInArrow(sets, "node long, hashes binary").dropDuplicates(["node"]), "shingle-sets")
    a, b = (held.select(F.col("node").alias(k), F.col("hashes").alias(f"h_{k}")) for k in "ab")
    whole = pairs.hint("shuffle_merge").join(a, "a").join(b, "b").select("a", "b", "h_a", "h_b")
    found = stored(whole.mapInArrow(judge, "a long, b long"), "judged-pairs")
    release(held, needed)
    return found


def near_links(texts: DataFrame, nodes: DataFrame, crowded: np.ndarray, words: int, num: int, den: int) -> DataFrame:
    """``(a, b)``: links that connect the same nodes as all pairs of similarity num / den or more do. texts: ``th, text``; nodes: ``th, node, mark, wide``."""
    dealt = _tokens(texts, crowded, words, num, den).repartition(shuffle_count(texts.sparkSession), "token")
    each = dealt.groupBy("token", "node").agg(F.min("n").alias("n"), F.min("pos").alias("pos"))
    often = each.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("m > 1")
    shared = stored(often.select("token", F.struct("node", "n", "pos").alias("b")), "shared-shingles")
    marks = stored(nodes.groupBy("node").agg(F.first("mark").alias("mark"), F.first("wide").alias("wide")), "marks")
    pivots = shared.groupBy("token").agg(F.min_by("b", F.xxhash64("b.node", "token")).alias("a"))

    def linked(both: DataFrame) -> DataFrame:
        """Whole marks would make a row of a shingle three times as long, so only the distinct pairs get them."""
        first = F.col("a.node") < F.col("b.node")
        pair = both.select(*(F.when(first, F.col(f"{x}.node")).otherwise(F.col(f"{y}.node")).alias(x) for x, y in ("ab", "ba")), (F.col("a.n") + F.col("b.n")).alias("sizes"))
        pair = pair.distinct()
        for k in "ab":
            pair = pair.join(marks.select(F.col("node").alias(k), F.col("mark").alias(f"mark_{k}")), k)
        bits = ([F.col(f"mark_{k}")[i] for i in range(MARK_BITS // 64)] for k in "ab")
        likely = stored(pair.where(_differ_little(*bits, F.col("sizes"), num, den)).select("a", "b", "sizes"), "likely-pairs")
        candidates = stored(_wide_enough(likely, marks, num, den), "near-candidates")
        found = _similar(candidates, texts, nodes, words, num, den)
        release(likely, candidates)
        return found

    stars = linked(shared.join(pivots, "token").where("a.node <> b.node").where(_possible("a", "b", num, den)))
    root = roots(stars).withColumnRenamed("node", "of")
    named = shared.join(root, F.col("b.node") == F.col("of"), "left").select("token", "b", F.coalesce("root", "b.node").alias("c"))
    # the largest component of a token needs no comparing with itself; a token of one component none at all
    shares = named.groupBy("token", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("token").agg(F.max_by("c", "m").alias("top"), F.count(F.lit(1)).alias("k"))
    tops = stored(shares.where("k > 1").select("token", "top"), "top-components")
    u, v = _folded()
    short = marks.select(F.col("node").alias("of"), u.alias("u"), v.alias("v"))
    marked = named.join(tops, "token").join(short, F.col("b.node") == F.col("of"))
    several = stored(marked.select("token", F.struct("b.*", "c", "u", "v").alias("b"), (F.col("c") != F.col("top")).alias("other")), "shared-by-component")
    release(shared, tops)
    rest = several.where("other").select("token", F.col("b").alias("a"))
    near = _possible("a", "b", num, den) & _differ_little([F.col("a.u"), F.col("a.v")], [F.col("b.u"), F.col("b.v")], F.col("a.n") + F.col("b.n"), num, den)
    more = linked(rest.join(several.select("token", "b"), "token").where("a.c <> b.c").where(near))
    found = stored(stars.union(more), "near-links")
    release(stars, several, more, marks)
    return found


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: tuple[int, int] = (4, 5), spare: int = 200) -> DataFrame:
    """``(id_col, component_id)``: the smallest id that links of at least the similarity (a fraction) reach."""
    every = stored(_marked(docs, id_col, text_col, words), "shingle-nodes")
    crowded = _crowded(every.where("chunk IS NOT NULL").select("chunk", "counts"), spare)
    marked = every.where("chunk IS NULL").select(id_col, "th", "node", "mark", "wide")
    texts = docs.select(F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    root = roots(near_links(texts, marked.select("th", "node", "mark", "wide"), crowded, words, *similarity)).withColumnRenamed("node", "of")
    rooted = marked.select(id_col, "node").join(root, F.col("node") == F.col("of"), "left").select(id_col, F.coalesce("root", "node").alias("root"))
    # a large component is split by salts, and each salt that occurs gets a row with the component's smallest id
    salted = rooted.withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)))
    part = salted.groupBy("root", "salt").agg(F.min(id_col).alias("low"))
    ids = part.groupBy("root").agg(F.min("low").alias("component_id"), F.collect_set("salt").alias("salts"))
    return salted.join(ids.select("root", "component_id", F.explode("salts").alias("salt")), ["root", "salt"]).select(id_col, "component_id")
