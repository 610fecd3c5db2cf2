"""Finding windows that occur at more than one place of a corpus: the parts that the two substring deduplications share.

A document is a sequence of units (bytes or words).  Of every window of ``W``
units the k-gram with the smallest hash is its anchor, so equal windows have
equal anchors at equal offsets, and one anchor stands for a whole range of
window starts.  The steps, all of them Spark jobs:

1. ``anchored``: one scan gives each document's anchors.
2. ``kept``: anchors whose hash occurs once in the corpus are dropped.  This
   loses no repeated window, as its anchor repeats too.
3. ``fragments``: the units that the windows of a kept anchor cover.
4. ``classes``: equal fragments (by 128-bit hash) become one class with its
   first place, so that thousands of copies cost one row from here on.
5. ``compared``: the fragments of an anchor are compared with each other by an
   operator's own method (``marks``), in blocks of bounded size.
6. ``halved``: an anchor of more than ``group`` classes isn't compared as it is.
   Its fragments are cut into blocks of window starts; all windows of a block
   share its core, and only fragments with equal cores stay together.  Groups
   that are still too large are cut again, into quarters, which makes the core longer, down
   to single windows; equal blocks become one class.  So the number of rows that
   meet in a task is bounded for any number of fragments, and the comparison is
   the same for all.
7. ``covered``: each member of a class gets the window starts to remove, and
   each document their union.

Two depths may be asked for at once: anchors follow the shorter window, and the
comparison marks each start to both depths.

Places are ordered by (id, text hash, start).  Rows with equal id and equal text
are one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import shuffle_count, stored
from tracelake.storage import release

SEGMENT = 1 << 22  # units a step; positions within it share a number with the hash
LOW = np.uint64((1 << 24) - 1)
#: Text to its units as bytes, a function from unit positions (first, end) to byte positions, and the number of units.
Cut = Callable[[bytes], tuple[bytes, Callable[[np.ndarray, np.ndarray], tuple], int]]


def window_anchors(grams: np.ndarray, w: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor position, first window start, number of starts) for windows of w grams; ties go to the left."""
    for base in range(0, max(len(grams) - w + 1, 0), SEGMENT):
        part = grams[base : base + SEGMENT + w - 1]
        n = len(part)
        key = (part & ~LOW) | np.arange(n, dtype=np.uint64)
        padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[:n] = key
        rows = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - w + 1
        at = (np.minimum(behind[:starts], ahead[w - 1 : w - 1 + starts]) & LOW).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        yield at[first] + base, first + base, np.diff(np.append(first, starts))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def anchored(docs: DataFrame, grams_of: Callable[[str], np.ndarray], w: int) -> DataFrame:
    """``(id, th, found)`` for keyed documents; found lists (h, pos, lo, n)."""
    kind = docs.schema["id"].dataType.simpleString()
    found_type = pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("lo", pa.int32()), ("n", pa.int32())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns, offsets = [[], [], [], []], [0]
                for text in part.column(2):
                    grams = grams_of(text.as_py())
                    total = offsets[-1]
                    for pos, lo, n in window_anchors(grams, w):
                        for c, v in zip(columns, (grams[pos].view(np.int64), pos.astype(np.int32), lo.astype(np.int32), n.astype(np.int32)), strict=True):
                            c.append(v)
                        total += len(pos)
                    offsets.append(total)
                fields = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), f.type) for c, f in zip(columns, found_type, strict=True)]
                values = pa.StructArray.from_arrays(fields, fields=list(found_type))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["id", "th", "found"])

    return docs.mapInArrow(run, f"id {kind}, th long, found array<struct<h:long,pos:int,lo:int,n:int>>")


def kept(anchors: DataFrame) -> DataFrame:
    """``(kid, kth, found)``: the anchors whose hash comes again, by document."""
    each = anchors.select("id", "th", F.explode("found").alias("f")).select("id", "th", "f.*")
    # stored, so that both sides of the join are plain exchanges, which the adaptive planner splits at a hot anchor
    again = stored(each.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"), "repeated-anchors")
    out = stored(
        each.join(again.hint("shuffle_hash"), "h", "left_semi")
        .groupBy(F.col("id").alias("kid"), F.col("th").alias("kth"))
        .agg(F.collect_list(F.struct("h", "pos", "lo", "n")).alias("found")),
        "kept-anchors",
    )
    release(again)
    return out


def both_halves(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """128-bit digests as two columns of longs."""
    both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))


class Once:
    """Gives a piece's bytes the first time that a task sees its digest, then nothing."""

    def __init__(self, most: int = 500_000):
        self.seen, self.most = set(), most

    def __call__(self, digest: bytes, piece: bytes) -> bytes | None:
        if digest in self.seen:
            return None
        if len(self.seen) >= self.most:
            self.seen.clear()
        self.seen.add(digest)
        return piece


def joined(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Small batches put together."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def fragments(docs: DataFrame, kept_anchors: DataFrame, cut: Cut, widths: tuple[int, ...]) -> DataFrame:
    """``(h, c1, c2, id, th, lo, n, m, off, frag)``; a task gives a class's text with its first member only.

    A fragment has ``n`` window starts to the first width; the first ``m`` of them have room for the last one.
    """
    kind = docs.schema["id"].dataType.simpleString()
    near = docs.join(kept_anchors, docs["id"].eqNullSafe(kept_anchors["kid"]) & (docs["th"] == kept_anchors["kth"]))
    names = ["h", "c1", "c2", "id", "th", "lo", "n", "m", "off", "frag"]

    def run(batches):
        once = Once()
        for batch in batches:
            for row in range(batch.num_rows):
                data, places, total = cut(batch.column(2)[row].as_py().encode())
                found = batch.column(3)[row].values
                h, pos, lo, n = (found.field(k).to_numpy() for k in range(4))
                m = np.clip(total - widths[-1] + 1 - lo, 0, n)
                last = np.minimum(lo + n + widths[-1] - 1, total)
                for at in range(0, len(h), 8192):
                    part = slice(at, at + 8192)
                    begin, end = places(lo[part], last[part])
                    pieces = [data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                    digests = [xxhash.xxh3_128_digest(x) for x in pieces]
                    size = len(pieces)
                    columns = [pa.array(h[part]), *both_halves(digests), pa.array([batch.column(0)[row].as_py()] * size, batch.schema.field(0).type)]
                    columns += [pa.array(np.full(size, batch.column(1)[row].as_py(), dtype=np.int64)), *(pa.array(x[part].astype(np.int32)) for x in (lo, n, m, pos - lo))]
                    columns.append(pa.array([once(d, x) for d, x in zip(digests, pieces, strict=True)], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"h long, c1 long, c2 long, id {kind}, th long, lo int, n int, m int, off int, frag binary"
    return near.select("id", "th", "text", "found").mapInArrow(lambda batches: joined(run(batches)), schema)


def classes(frags: DataFrame) -> DataFrame:
    """``(h, c1, c2, off, n, m, members, place, frag)``: one row for each different fragment."""
    return frags.groupBy("h", "c1", "c2").agg(
        *(F.first(k).alias(k) for k in ("off", "n", "m")),
        F.count(F.lit(1)).alias("members"),
        F.min(F.struct("id", "th", "lo")).alias("place"),
        F.first("frag", ignorenulls=True).alias("frag"),
    )


RANGES = "array<struct<a:int,b:int>>"
RANGES_ARROW = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def ranges(mask: np.ndarray) -> list[dict]:
    """Runs of true values as half-open ranges."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"a": int(a), "b": int(b)} for a, b in edges.reshape(-1, 2)]


def row_ranges(flags: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Flags of rows of n each, one after the other: (rows with any, their ranges)."""
    edge = np.append(0, np.cumsum(n))
    on = flags.astype(bool)
    before, after = np.append(False, on[:-1]), np.append(on[1:], False)
    before[edge[:-1][n > 0]] = False
    after[edge[1:][n > 0] - 1] = False
    first, last = np.flatnonzero(on & ~before), np.flatnonzero(on & ~after) + 1
    row = np.searchsorted(edge, first, side="right") - 1
    hit, counts = np.unique(row, return_counts=True)
    fields = [pa.array((x - edge[row]).astype(np.int32)) for x in (first, last)]
    values = pa.StructArray.from_arrays(fields, fields=list(RANGES_ARROW.value_type))
    return hit, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), values)


def compared(reps: DataFrame, marks: Callable[..., list[np.ndarray]], widths: tuple[int, ...], depths: tuple[int, ...], block_bytes: int) -> DataFrame:
    """``(c1, c2, d, part)``: per class and depth (an index into widths) the marked window starts.

    ``marks(frags, off, n, rank, widths)`` gets the fragments of whole anchors and
    gives for each width one flag for each window start, all fragments' in a row;
    rank orders the classes' first places within the block.
    """
    names = ["c1", "c2", "d", "part"]

    def run(batches):
        def flush(table):
            h = table.column("h").to_numpy()
            run_of = np.cumsum(np.append(False, h[1:] != h[:-1]))
            rows = np.flatnonzero(np.bincount(run_of)[run_of] > 1)
            if not len(rows):
                return
            table = table.take(pa.array(rows))
            n, off = (table.column(k).to_numpy().astype(np.int64) for k in ("n", "off"))
            order = pc.sort_indices(table, [(k, "ascending") for k in ("id", "th", "lo")], null_placement="at_start").to_numpy()
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            found = marks(table.column("frag").to_pylist(), off, n, rank, widths)
            for d, flags in zip(depths, found, strict=True):
                hit, parts = row_ranges(flags, n)
                if len(hit):
                    own = table.take(pa.array(hit)).combine_chunks()
                    keys = [own.column(k).combine_chunks() for k in ("c1", "c2")]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(np.full(len(hit), d, dtype=np.int32)), parts.cast(RANGES_ARROW)], names)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= block_bytes:
                table = pa.Table.from_batches(held)
                h = table.column("h").to_numpy()
                whole = np.flatnonzero(h != h[-1])
                if len(whole):  # the last anchor may go on
                    yield from flush(table.slice(0, whole[-1] + 1).combine_chunks())
                    rest = table.slice(whole[-1] + 1).combine_chunks()
                    held, size = rest.to_batches(), rest.nbytes
        if held:
            yield from flush(pa.Table.from_batches(held).combine_chunks())

    rows = reps.select("h", "c1", "c2", "off", "n", "place.id", "place.th", "place.lo", "frag")
    dealt = rows.repartition(shuffle_count(reps.sparkSession), "h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, f"c1 long, c2 long, d int, part {RANGES}")


def blocks(reps: DataFrame, cut: Cut, width: int, size: int) -> DataFrame:
    """Fragments cut into blocks of ``size`` window starts: ``(h, c1, c2, p1, p2, shift, off, n, m, members, place, frag)``.

    Blocks follow the anchor's place in a window, so equal windows are in equal
    blocks; ``h`` becomes the hash of the old one and the block's core, the units
    that all its windows share; ``p1, p2`` is the class it comes from.
    """
    place = reps.schema["place"].dataType.simpleString()
    names = ["h", "c1", "c2", "p1", "p2", "shift", "off", "n", "m", "members", "place", "frag"]

    def run(batches):
        once = Once()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                off, n = (part.column(k).to_numpy().astype(np.int64) for k in ("off", "n"))
                low = (off - n + 1) // size
                k = off // size + 1 - low
                edge = np.append(0, np.cumsum(k))
                row = np.repeat(np.arange(len(k)), k)
                q, off, n = np.arange(len(row)) - (edge[:-1] - low)[row], off[row], n[row]
                first, last = np.maximum(off - (q + 1) * size + 1, 0), np.minimum(off - q * size, n - 1)
                bounds = (first, last + width), (off - q * size, off - (q + 1) * size + 1 + width)
                pieces, cores = [], []
                for i, frag in enumerate(part.column("frag")):
                    data, places, _ = cut(frag.as_py())
                    own = slice(edge[i], edge[i + 1])
                    for out, (begin, end) in zip((pieces, cores), bounds, strict=True):
                        out += [data[a:b] for a, b in zip(*(x.tolist() for x in places(begin[own], end[own])), strict=True)]
                heads = [h.to_bytes(8, "little", signed=True) for h in part.column("h").to_pylist()]
                keys = [xxhash.xxh3_64_intdigest(heads[r] + x.to_bytes(4, "little") + c) for r, x, c in zip(row.tolist(), q.tolist(), cores, strict=True)]
                digests = [xxhash.xxh3_128_digest(x.to_bytes(8, "little") + p) for x, p in zip(keys, pieces, strict=True)]
                c1, c2, members, place = (part.column(c).take(pa.array(row)) for c in ("c1", "c2", "members", "place"))
                columns = [pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), *both_halves(digests), c1, c2]
                columns += [pa.array(x.astype(np.int32)) for x in (first, off - first, last - first + 1, last - first + 1)]
                columns += [members, place, pa.array([once(d, x) for d, x in zip(digests, pieces, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"h long, c1 long, c2 long, p1 long, p2 long, shift int, off int, n int, m int, members long, place {place}, frag binary"
    out = reps.select("h", "c1", "c2", "off", "n", "members", "place", "frag").mapInArrow(lambda batches: joined(run(batches)), schema)
    moved = F.struct("place.id", "place.th", (F.col("place.lo") + F.col("shift")).alias("lo"))
    return out.withColumn("place", moved)


def crowded(reps: DataFrame, group: int) -> DataFrame:
    """The anchors of more than ``group`` classes."""
    return stored(reps.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > group).select("h"), "crowded-anchors")


def judged(reps: DataFrame, parts: DataFrame) -> DataFrame:
    """Classes with ``part``, an array with the marked ranges of each depth, where a class has any or several members."""
    found = parts.groupBy("c1", "c2", "d").agg(F.flatten(F.collect_list("part")).alias("part")).groupBy("c1", "c2").agg(F.map_from_entries(F.collect_list(F.struct("d", "part"))).alias("part"))
    rows = reps.select("c1", "c2", "members", "place").join(found, ["c1", "c2"], "left").where((F.col("members") > 1) | F.col("part").isNotNull())
    return stored(rows, "judged-classes")  # so that the next join has two exchanges and a hot class is split


def going(first, whole, part, keep_first: bool):
    """The ranges of a member of a class that go: ``whole`` where the class decides, else ``part``."""
    if keep_first:
        return F.when(~first.eqNullSafe(F.col("place")), whole).otherwise(part)
    return F.when(F.col("members") > 1, whole).otherwise(part)


def halved(reps: DataFrame, cut: Cut, marks: Callable, width: int, depth: int, size: int, keep_first: bool, group: int, block_bytes: int) -> DataFrame:
    """``(c1, c2, d, part)`` as from ``compared``, for anchors of too many classes."""
    kids = stored(blocks(reps, cut, width, size), "fragment-blocks")
    own = kids.groupBy("h", "c1", "c2").agg(
        *(F.first(k).alias(k) for k in ("off", "n", "m")), F.sum("members").alias("members"), F.min("place").alias("place"), F.first("frag", ignorenulls=True).alias("frag")
    )
    own = stored(own, "block-classes")
    many = crowded(own, group)
    if size > 1 and many.limit(1).count():
        parts = compared(own.join(many, "h", "left_anti"), marks, (width,), (depth,), block_bytes)
        parts = parts.union(halved(own.join(many, "h", "left_semi"), cut, marks, width, depth, max(size // 4, 1), keep_first, group, block_bytes))
    else:  # equal blocks of one window are one class
        parts = compared(own, marks, (width,), (depth,), block_bytes)
    parts = stored(parts, "block-windows")
    verdict = judged(own, parts)
    rows = kids.select("c1", "c2", "p1", "p2", "shift", "n", F.col("place").alias("at")).join(verdict, ["c1", "c2"])
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))
    gone = F.transform(going(F.col("at"), whole, F.col("part")[depth], keep_first), lambda g: F.struct((g.a + F.col("shift")).alias("a"), (g.b + F.col("shift")).alias("b")))
    out = stored(rows.select(F.col("p1").alias("c1"), F.col("p2").alias("c2"), F.lit(depth).alias("d"), gone.alias("part")).where("part IS NOT NULL"), "halved-windows")
    release(kids, own, many, parts, verdict)
    return out


def covered(
    docs: DataFrame,
    grams_of: Callable[[str], np.ndarray],
    grams: int,
    cut: Cut,
    widths: tuple[int, ...],
    marks: Callable[..., list[np.ndarray]],
    keep_first: bool,
    group: int,
    block_bytes: int,
) -> DataFrame:
    """``(kid, kth, spans)``: of each keyed document the units that go, as (depth, start, stop) in any order.

    With ``keep_first`` a window's first place stays; without, all places go.
    """
    anchors = stored(anchored(docs, grams_of, widths[0] - grams + 1), "anchors")
    if anchors.groupBy("id", "th").count().where("count > 1").limit(1).count():
        docs = docs.dropDuplicates(["id", "th"])
        anchors = stored(anchors.dropDuplicates(["id", "th"]), "anchors")
    again = kept(anchors)
    release(anchors)
    frags = stored(fragments(docs, again, cut, widths), "fragments")
    release(again)
    reps = stored(classes(frags), "fragment-classes")
    many = crowded(reps, group)
    every = tuple(range(len(widths)))
    if many.limit(1).count():
        hot = stored(reps.join(many, "h", "left_semi"), "crowded-classes")
        cuts = [halved(hot.withColumn("n", F.col("m")).where("n > 0") if d and d == every[-1] else hot, cut, marks, w, d, max(1, 1 << (w.bit_length() - 2)), keep_first, group, block_bytes) for d, w in enumerate(widths)]
        parts = reduce(DataFrame.union, [compared(reps.join(many, "h", "left_anti"), marks, widths, every, block_bytes), *cuts])
    else:
        parts = compared(reps, marks, widths, every, block_bytes)
    parts = stored(parts, "marked-windows")
    verdict = judged(reps, parts)
    release(reps, parts, many)
    rows = frags.select("c1", "c2", "id", "th", "lo", "n", "m").join(verdict, ["c1", "c2"])

    def spans_at(d: int, w: int):
        whole = F.array(F.struct(F.lit(0).alias("a"), F.col("m" if d else "n").alias("b")))
        gone = F.coalesce(going(F.struct("id", "th", "lo"), whole, F.col("part")[d], keep_first), F.array().cast(RANGES))
        return F.transform(F.filter(gone, lambda g: g.b > g.a), lambda g: F.struct(F.lit(d).alias("d"), (F.col("lo") + g.a).alias("a"), (F.col("lo") + g.b - 1 + w).alias("b")))

    spans = [spans_at(d, w) for d, w in enumerate(widths)]
    each = rows.select("id", "th", F.explode(F.concat(*spans)).alias("s"))
    out = stored(each.groupBy(F.col("id").alias("kid"), F.col("th").alias("kth")).agg(F.collect_list("s").alias("spans")), "repeated-spans")
    release(frags, verdict)
    return out


def with_spans(docs: DataFrame, cuts: DataFrame) -> DataFrame:
    """Keyed documents with their ``spans``, null where nothing goes."""
    return docs.join(cuts, docs["id"].eqNullSafe(cuts["kid"]) & (docs["th"] == cuts["kth"]), "left").select("id", "text", "spans")


def rows_of_spans(spans: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The depths, starts and stops of each row's spans; none where it is null. No span becomes a Python object."""
    d, a, b = (spans.values.field(k).to_numpy() for k in "dab")
    edge = spans.offsets.to_numpy()
    for i, (low, high) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
        own = slice(low, high if spans[i].is_valid else low)
        yield d[own], a[own], b[own]


def mask_of(n: int, spans: tuple[np.ndarray, np.ndarray, np.ndarray], depth: int = 0) -> np.ndarray:
    """Flags of n units that lie in any span of a depth."""
    d, a, b = spans
    own = d == depth
    return np.cumsum(np.bincount(a[own], minlength=n + 1)[:n] - np.bincount(b[own], minlength=n + 1)[:n]) > 0
