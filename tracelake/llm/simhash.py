"""SimHash near-duplicates by a segment-popcount embedding and a grid join.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is the
vector of the segments' bit counts.  One differing bit moves one count by one,
so the Manhattan distance of two embeddings is a lower bound of the Hamming
distance.  Counts 0, 1, 2 are kept in unary code (00, 01, 11) in one 64-bit
number, where the Manhattan distance is the number of differing bits.

Grid range join: the segments form 6 blocks.  Within Manhattan distance 3 at
least three blocks are equal, for one of the 20 choices of three blocks, and the
bit counts of the other three blocks differ by 3 at most in sum.  So a choice
has a grid over (the equal blocks, that sum in steps of 4): a fingerprint is
dealt to its own cell and to the one below, and two that are near meet in a
cell.  In a cell, pairs are found by exact quarters, of which one must be equal,
and tested by the lower bound first, then exactly.

Distinct fingerprints only are joined, so copies of a text cost nothing, and a
task returns a spanning forest of the links it found, never all pairs.  Links
become components by ``graph.roots``.

Defined results: a null or empty text has fingerprint zero, linked like any
other; every input row gets an output row, repeated rows included; a component
of rows with null ids only has a null component id; an empty table gives an
empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import shuffle_count, stored
from tracelake.operators.graph import roots

BITS, SEGMENTS, BLOCKS = 64, 32, 6
LOW_OF_SEGMENT = 0x5555555555555555


def fingerprint(text: str | None, words: int = 3, chunk: int = 65536) -> int:
    """SimHash of a text's word shingles by majority over their XXH64 (seed 42)."""
    w = (text or "").encode().lower().split()  # bytes: A-Z only, the six ASCII white spaces
    if not w:
        return 0
    if len(w) < words:
        w = [b" ".join(w)]
    n = max(1, len(w) - words + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, chunk):
        if len(w) < words:
            hashes = [digest(w[0], 42)]
        else:
            part = w[at : at + chunk + words - 1]
            hashes = [digest(b" ".join(g), 42) for g in zip(*(part[i:] for i in range(words)), strict=False)]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(id_col, fp)``, the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, fp long")


def unary_counts(fp: np.ndarray) -> np.ndarray:
    """The embedding: each two-bit segment's bit count in unary code."""
    low, high = fp & np.uint64(LOW_OF_SEGMENT), (fp >> np.uint64(1)) & np.uint64(LOW_OF_SEGMENT)
    return (low | high) | ((low & high) << np.uint64(1))


def cell_masks(max_bits: int = 3) -> list[int]:
    """A mask over the embedding for each choice of blocks that must be equal."""
    edges = [round(i * SEGMENTS / BLOCKS) * 2 for i in range(BLOCKS + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(BLOCKS)]
    return [sum(c) for c in combinations(blocks, BLOCKS - max_bits)]


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining i with j; a label is the smallest index of its set."""
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
    return label


def _pairs_in_runs(run: np.ndarray):
    """Index pairs within equal, adjacent values, by distance: work is the pairs, memory one row of them."""
    ends = np.flatnonzero(np.append(run[1:] != run[:-1], True)) + 1
    last = np.repeat(ends, np.diff(np.append(0, ends)))
    left = np.flatnonzero(last - np.arange(len(run)) > 1)
    step = 1
    while len(left):
        yield left, left + step
        step += 1
        left = left[left + step < last[left]]


def spanning_links(cell: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the links within cells."""
    label = np.arange(len(fp))
    seen = unary_counts(fp)
    for q in range(max_bits + 1):  # 64 bits in max_bits + 1 parts: one must be equal
        a, b = q * BITS // (max_bits + 1), (q + 1) * BITS // (max_bits + 1)
        part = (fp >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
        order = np.lexsort((part, cell))
        at, own = part[order], cell[order]
        run = np.cumsum(np.append(True, (at[1:] != at[:-1]) | (own[1:] != own[:-1])))
        for i, j in _pairs_in_runs(run):
            i, j = order[i], order[j]
            near = np.bitwise_count(seen[i] ^ seen[j]) <= max_bits  # Manhattan distance of the embeddings
            i, j = i[near], j[near]
            near = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
            label = _merge(label, i[near], j[near])
    member = np.flatnonzero(label != np.arange(len(fp)))
    return fp[member], fp[label[member]]


def links(prints: DataFrame, max_bits: int = 3, block_rows: int = 1 << 18) -> DataFrame:
    """``(a, b)``: links that connect the same fingerprints as all links of ``max_bits`` or fewer do. prints: distinct ``fp``."""
    masks = [m - (1 << 64) if m >> 63 else m for m in cell_masks(max_bits)]
    low, high = F.col("fp").bitwiseAND(LOW_OF_SEGMENT), F.shiftrightunsigned("fp", 1).bitwiseAND(LOW_OF_SEGMENT)
    counts = low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))

    def cell(k: int, m: int):
        mask = F.lit(m).cast("long")
        step = F.floor(F.bit_count(F.col("u").bitwiseAND(F.bitwise_not(mask))) / (max_bits + 1)).cast("int")
        return F.struct(F.lit(k).alias("choice"), F.col("u").bitwiseAND(mask).alias("key"), step.alias("step"))

    grid = prints.select("fp", counts.alias("u")).select("fp", F.explode(F.array(*(cell(k, m) for k, m in enumerate(masks)))).alias("c"))
    steps = grid.select("fp", "c.choice", "c.key", F.explode(F.array("c.step", F.col("c.step") - 1)).alias("step"))
    cells = steps.select("fp", F.xxhash64("choice", "key", "step").alias("cell"))  # cells of equal hash only share comparisons

    def run(batches):
        def found(cell, fp):
            a, b = spanning_links(cell, fp.view(np.uint64), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        kept: list[np.ndarray] = [np.zeros(0, np.int64)] * 2
        for batch in batches:
            kept = [np.concatenate([k, batch.column(n).to_numpy()]) for k, n in zip(kept, ("cell", "fp"), strict=True)]
            if len(kept[0]) >= block_rows:  # all whole cells but the last one
                whole = np.flatnonzero(kept[0] != kept[0][-1])
                if len(whole):
                    n = whole[-1] + 1
                    yield found(*(k[:n] for k in kept))
                    kept = [k[n:] for k in kept]
        if len(kept[0]):
            yield found(*kept)

    dealt = cells.repartition(shuffle_count(prints.sparkSession), "cell").sortWithinPartitions("cell")
    return dealt.select("cell", "fp").mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3) -> DataFrame:
    """``(id_col, fp, component_id)``: the smallest id that links reach."""
    marked = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    first = stored(marked.groupBy("fp").agg(F.min(id_col).alias("first")), "distinct-fingerprints")
    found = stored(links(first.select("fp"), max_bits), "fingerprint-links")
    root = roots(found)
    rooted = first.join(root, first["fp"] == root["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted-fingerprints")
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(rooted.join(ids, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash_components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
