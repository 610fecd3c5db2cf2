"""Substring deduplication on bytes with blockwise difference-cover suffix sorting.

Every byte covered by a ``length``-byte string that starts at two or more places
of the corpus is removed at all of them.

Candidates come from ``repeats``.  A block of candidate fragments is then sorted
as suffixes:

* the windows are dealt to buckets by their leading bytes, and one bucket at a
  time is sorted by these and by their last eight bytes; a window leaves the sort
  as soon as no other one has the same;
* the positions whose residue modulo 31 lies in a perfect difference set are
  the cover sample; the suffixes of it that the windows left need are ranked, by
  31-byte letters and prefix doubling, to a depth of ``31 * 2**q`` bytes;
* a bucket's sort goes on by the bytes up to the next sample position, then ties
  by the ranks of sample suffixes, then by the few bytes after them;
* what is left agrees in ``length`` bytes with a neighbour in that order.

Fragments are laid out with their anchors at multiples of 31, so equal windows
have equal residues.  A block holds whole anchors of about ``block_bytes``; a
bucket about ``BUCKET`` windows, which bounds the sort's memory.

Defined results: null is the empty text; texts shorter than ``length`` lose
nothing; rows with equal id and equal text are one place, and each gets the same
result; null ids are a value of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.repeats import RANGES, RANGES_ARROW, covered, keyed, mask_of, ranges, rows_of_spans, with_spans

#: A perfect difference set: every residue modulo 31 is a difference of two of these.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
GRAM = 32  # bytes; an anchor has as many of these as fit a quarter of a window, so that few repeat by chance
BUCKET = 1 << 16
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def eight_bytes(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The 8-byte number at every position, as an unaligned view."""
    return np.ndarray((max(len(data) - 7, 0),), dtype=order + "u8", buffer=data, strides=(1,))


def gram_hashes(text: str, size: int = GRAM) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes of a text; size is GRAM times a power of two."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    n = len(data) - GRAM + 1
    if len(data) < size:
        return np.zeros(0, dtype=np.uint64)
    words, h = eight_bytes(data), None
    for i, odd in enumerate(ODD):
        part = words[8 * i : 8 * i + n] * np.uint64(odd)
        h = part if h is None else h ^ part
        h ^= h >> np.uint64(31)
        h *= np.uint64(ODD[(i + 1) % 4])
    h ^= h >> np.uint64(29)
    reach = GRAM
    while reach < size:
        h = (h[:-reach] * np.uint64(ODD[0])) ^ h[reach:]
        h ^= h >> np.uint64(31)
        h *= np.uint64(ODD[1])
        h ^= h >> np.uint64(29)
        reach *= 2
    return h


def gram_size(width: int) -> int:
    """The longest size of at most a quarter of a window."""
    size = GRAM
    while 8 * size <= width:
        size *= 2
    return size


def byte_cutter(data: bytes):
    return data, lambda first, end: (first, end), len(data)


def _rank(key: np.ndarray) -> np.ndarray:
    """Ranks from 1; equal keys have equal ranks."""
    key = key.astype(key.dtype.newbyteorder("="), copy=False)
    order = np.argsort(key)
    s = key[order]
    out = np.empty(len(key), dtype=np.int64)
    out[order] = np.cumsum(np.append(True, s[1:] != s[:-1])[: len(key)])
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two ranks as one number of the same order."""
    return (a << 32) | b


class CoverRanks:
    """Ranks of the cover sample's suffixes to a depth of ``31 * 2**q`` bytes, for windows of ``lengths[0]`` bytes or more.

    The sample has the positions whose ranks ``ties`` takes for windows at ``starts``, and those that these ranks are made of.
    """

    def __init__(self, data: np.ndarray, word: np.ndarray, end: int, lengths: tuple[int, ...], starts: np.ndarray):
        self.depth = PERIOD
        while 2 * self.depth + 12 <= lengths[0]:
            self.depth *= 2
        residues = np.arange(PERIOD)
        self.to_first = np.array([min((c - r) % PERIOD for c in COVER) for r in residues])  # next sample position
        self.gap = int(self.to_first.max()) + 1
        first, taken = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
        first[starts + self.to_first[starts % PERIOD]] = True
        first = np.flatnonzero(first)
        ahead = {s + k for start, stop in zip((0, *lengths), lengths, strict=False) for s in self.steps(start, stop) for k in range(0, self.depth, PERIOD)}
        for s in sorted(ahead):
            taken[np.minimum(first + s, len(data) - 1)] = True
        sample = np.flatnonzero(taken[:end])
        self.place = np.full(len(data), -1, dtype=np.int32)
        self.place[sample] = np.arange(len(sample), dtype=np.int32)
        rank = _rank(word[sample])
        for s in (8, 16, PERIOD - 8):
            rank = _rank(_pair(rank, _rank(word[sample + s])))
        reach = PERIOD
        while reach < self.depth:
            ahead = self.place[np.minimum(sample + reach, len(data) - 1)]
            rank = _rank(_pair(rank, np.where(ahead >= 0, rank[ahead], 0)))
            reach *= 2
        self.rank, self.word = rank, word

    def lead(self) -> list[int]:
        """Where the 8-byte numbers start that cover the bytes before the next sample position."""
        return [*range(0, max(self.gap - 7, 1), 8), max(self.gap - 8, 0)]

    def steps(self, start: int, stop: int) -> list[int]:
        last = (stop - self.depth - self.gap + 1) // PERIOD * PERIOD  # the last step at which every rank ends within the window
        return [*range(max(start - self.gap, 0) // PERIOD * PERIOD, last, self.depth), last]

    def ties(self, start: int, stop: int) -> list:
        """Keys for the bytes from ``start`` (or a few before) to ``stop`` of windows at p: ranks, then the last few bytes."""
        steps = self.steps(start, stop)
        last = steps[-1]
        keys = [lambda p, s=s: self.rank[self.place[p + self.to_first[p % PERIOD] + s]] for s in steps]
        return keys + [lambda p, s=s: self.word[p + s] for s in range(stop - 8, last + self.depth - 8, -8)]


def _split(own: np.ndarray, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes told apart by one more key; windows that are alone in theirs go."""
    code = _pair(node, key if key.dtype == np.int64 else _rank(key))
    order = np.argsort(code)
    s = code[order]
    new = np.append(True, s[1:] != s[:-1])
    node = np.cumsum(new)
    several = ~(new & np.append(new[1:], True))
    return own[order[several]], node[several]


def repeated_windows(frags: list[bytes], off: np.ndarray, n: np.ndarray, lengths: tuple[int, ...], bucket: int = BUCKET) -> list[np.ndarray]:
    """For each length one flag for each window start of each fragment: does its string start at another place of the block?

    Lengths ascend; starts whose fragment ends before a longer length aren't marked to it.
    """
    base, end = np.empty(len(frags), dtype=np.int64), 0
    for i, f in enumerate(frags):
        base[i] = end + (-(end + off[i])) % PERIOD
        end = base[i] + len(f)
    data = np.zeros(end + 2 * PERIOD + 16, dtype=np.uint8)
    for b, f in zip(base, frags, strict=True):
        data[b : b + len(f)] = np.frombuffer(f, dtype=np.uint8)
    word = eight_bytes(data, ">")
    total = int(n.sum())
    start = np.repeat(base - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(total)
    room = np.repeat(base + np.array([len(f) for f in frags], dtype=np.int64), n) - start
    flags = [np.zeros(total, dtype=bool) for _ in lengths]
    left = []
    for own in suffix_buckets(word[start], bucket):  # most windows that come once differ in their first or last bytes, and need no ranks
        own, node = _split(own, start[own] % PERIOD + 1, word[start[own]])
        if len(own):
            own, node = _split(own, node, word[start[own] + lengths[0] - 8])
        if len(own):
            left.append((own, node))
    if not left:
        return flags
    ranks = None  # shorter windows have no room for sample suffixes
    if lengths[0] >= 3 * PERIOD:
        ranks = CoverRanks(data, word, end, lengths, start[np.concatenate([own for own, _ in left])])
    for own, node in left:
        done = 8
        for length, flag in zip(lengths, flags, strict=True):
            fits = room[own] >= length
            own, node = own[fits], node[fits]
            if ranks is None:
                keys = [lambda p, s=s: word[p + s] for s in [*range(done, length - 7, 8), length - 8]]
            else:
                keys = [lambda p, s=s: word[p + s] for s in (ranks.lead()[1:] if done == 8 else ())] + ranks.ties(done if done > 8 else 0, length)
            for key in keys:
                if len(own):
                    own, node = _split(own, node, key(start[own]))
            flag[own] = True
            done = length
    return flags


def suffix_buckets(lead: np.ndarray, bucket: int):
    """Indexes of the windows, one bucket of about ``bucket`` neighbours by leading bytes after the other."""
    pieces = -(-len(lead) // bucket)
    if pieces < 2:
        yield np.arange(len(lead))
        return
    sample = np.sort(lead[:: max(1, len(lead) // 65536)])
    splitters = np.unique(sample[:: max(1, len(sample) // pieces)])
    owner = np.searchsorted(splitters, lead, side="right")
    order = np.argsort(owner.astype(np.uint16) if len(splitters) < 1 << 16 else owner, kind="stable")
    bounds = np.searchsorted(owner[order], np.arange(len(splitters) + 2))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a > 1:
            yield order[a:b]


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, report: int = 256, group: int = 128, block_bytes: int = 4_000_000
) -> DataFrame:
    """``(id_col, n_bytes, spans, kept, n_repeated)``: the removed (start, stop) byte ranges, merged and sorted, and the bytes left.

    ``n_repeated`` counts the bytes that lie in repeated strings of ``report`` bytes
    or more, which are passages of some fifty words; nothing is removed for it.
    """
    if not GRAM <= report <= length:
        raise ValueError(f"report must be {GRAM} or more, length no less")
    rows = keyed(docs, id_col, text_col)
    widths = (report, length) if report < length else (length,)
    full = len(widths) - 1

    def marks(frags, off, n, rank, lengths):
        return repeated_windows(frags, off, n, lengths)

    size = gram_size(widths[0])
    cuts = covered(rows, lambda text: gram_hashes(text, size), size, byte_cutter, widths, marks, False, group, block_bytes)
    kind = rows.schema["id"].dataType.simpleString()
    names = [id_col, "n_bytes", "spans", "kept", "n_repeated"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, found, left, repeated = [], [], [], []
                for text, spans in zip(part.column(1), rows_of_spans(part.column(2)), strict=True):
                    data = text.as_py().encode()
                    sizes.append(len(data))
                    if len(spans[0]):
                        gone = mask_of(len(data), spans, full)
                        found.append(ranges(gone))
                        left.append(np.frombuffer(data, dtype=np.uint8)[~gone].tobytes())
                        repeated.append(int((gone | mask_of(len(data), spans)).sum()))
                    else:
                        found.append([])
                        left.append(data)
                        repeated.append(0)
                columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(found, RANGES_ARROW), pa.array(left, pa.binary()), pa.array(repeated, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return with_spans(rows, cuts).mapInArrow(run, f"{id_col} {kind}, n_bytes long, spans {RANGES}, kept binary, n_repeated long")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_dedup(docs).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
        "n_repeated",
    )
