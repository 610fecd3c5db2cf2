"""Substring deduplication on words with prefix-partitioned suffix trees.

Every word covered by a window of ``window`` words that also starts earlier in
the corpus (smaller id, or earlier in the same document) is removed; the first
occurrence stays.

Candidates come from ``repeats``.  The suffixes (window starts) of a block of
candidate fragments are split by prefix into groups that fit a budget: a group
that is too large gets a prefix longer by one edge, a smaller one becomes a
subtree at once.  A subtree is built top-down, one edge of ``EDGE`` words at a
time for all its nodes together, and a suffix leaves it as soon as its prefix is
unique.  The nodes left at depth ``window`` are the repeats; each holds its
suffixes, of which the first place stays.

Defined results: null has no words; rows with equal id and equal text are one
document, and each gets the same result; null ids come before all others; texts
with one id are ordered by their hash; shorter texts lose nothing; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.repeats import covered, keyed, mask_of, rows_of_spans, with_spans

GRAM, EDGE = 8, 4
BUDGET = 1 << 15  # suffixes of a subtree
ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))


def gram_hashes(text: str, size: int = GRAM) -> np.ndarray:
    h = word_hashes(text.encode().split())
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        out = (out ^ h[i : i + n]) * ODD
        out ^= out >> np.uint64(29)
    return out


def word_cutter(data: bytes):
    words = data.split()
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.append(0, ends[:-1])
    return b" ".join(words), lambda first, end: (starts[first], ends[end - 1] - 1), len(words)


def _names(*keys: np.ndarray) -> np.ndarray:
    """Equal rows of keys get equal numbers from 0."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def _subtree(node: np.ndarray, at: np.ndarray, edges: np.ndarray, depth: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Builds a group's tree from ``depth`` on: (indexes into at, node) of the suffixes whose node at depth ``window`` has others."""
    own = np.arange(len(at))
    while len(own):
        size = np.bincount(node)
        several = size[node] > 1
        own, node = own[several], node[several]
        if depth >= window or not len(own):
            break
        node = _names(edges[at[own] + min(depth, window - EDGE)], node)
        depth += EDGE
    return own, node


def prefix_groups(edges: np.ndarray, at: np.ndarray, window: int, budget: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(suffix indexes, node, depth) of groups within the budget: suffixes that share prefixes of as many words as that takes."""
    out = []
    groups = [(np.arange(len(at)), 0)]
    while groups:
        own, depth = groups.pop()
        if len(own) <= budget or depth >= window - EDGE:
            out.append((own, np.zeros(len(own), dtype=np.int64), depth))
            continue
        node = _names(edges[at[own] + depth])
        order = np.argsort(node, kind="stable")
        own, node = own[order], node[order]
        ends = np.cumsum(np.bincount(node))
        k = 0
        while k < len(ends):  # neighbouring small prefixes share a group
            a = ends[k - 1] if k else 0
            last = max(k, int(np.searchsorted(ends, a + budget, side="right")) - 1)
            group, prefix = own[a : ends[last]], node[a : ends[last]]
            if len(group) > budget:
                groups.append((group, depth + EDGE))
            else:
                out.append((group, prefix, depth + EDGE))
            k = last + 1
    return out


def repeated_suffixes(edges: np.ndarray, at: np.ndarray, window: int, budget: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(suffix indexes, node at depth ``window``) of the repeated suffixes of each group's subtree."""
    out = []
    for own, node, depth in prefix_groups(edges, at, window, budget):
        inner, deep = _subtree(node, at[own], edges, depth, window)
        if len(inner):
            out.append((own[inner], deep))
    return out


def later_windows(frags: list[bytes], n: np.ndarray, rank: np.ndarray, window: int, budget: int = BUDGET) -> np.ndarray:
    """One flag for each window start of each fragment: does its word sequence start earlier in the block?"""
    pieces = [f.split(b" ") for f in frags]
    sizes = np.array([len(p) for p in pieces])
    hashes = np.concatenate([word_hashes(p) for p in pieces])
    code = _names(hashes)
    pairs = _names(code[:-1], code[1:])
    edges = _names(pairs[:-2], pairs[2:])  # four words
    base = np.append(0, np.cumsum(sizes)[:-1])
    total = int(n.sum())
    at = np.repeat(base - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(total)
    order = np.repeat(rank, n)
    flags = np.zeros(total, dtype=bool)
    for own, node in repeated_suffixes(edges, at, window, budget):
        first = np.full(node.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, node, order[own])
        flags[own] = order[own] != first[node]
    return flags


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, group: int = 128, block_bytes: int = 4_000_000) -> DataFrame:
    """``(id_col, n_words, n_removed, kept)``; kept has the words left, joined by one space."""
    if window < EDGE:
        raise ValueError(f"window must be {EDGE} or more")
    rows = keyed(docs, id_col, text_col)

    def marks(frags, off, n, rank, windows):
        return [later_windows(frags, n, rank, windows[0])]

    size = min(GRAM, window // 2)
    cuts = covered(rows, lambda text: gram_hashes(text, size), size, word_cutter, (window,), marks, True, group, block_bytes)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, gone, left = [], [], []
                for text, spans in zip(part.column(1), rows_of_spans(part.column(2)), strict=True):
                    words = text.as_py().encode().split()
                    mask = mask_of(len(words), spans)
                    sizes.append(len(words))
                    gone.append(int(mask.sum()))
                    left.append(b" ".join([w for w, m in zip(words, mask.tolist(), strict=True) if not m] if gone[-1] else words).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string())], [id_col, "n_words", "n_removed", "kept"])

    return with_spans(rows, cuts).mapInArrow(run, f"{id_col} {kind}, n_words long, n_removed long, kept string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x : x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS k FROM s),
g AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE k > 1) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i : NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
