"""Spelling variants grouped by a trie of letter-group counts.

``count_words`` counts the words of all documents: Arrow batches of texts become
partial counts in the tasks, which Spark adds up.

``near_pairs`` finds all words that differ by one inserted, deleted or replaced
code point.  Words are arranged in a trie whose levels are the length and then
the counts of successive letter groups (``GROUPS``).  One edit changes these
counts by a surplus of one at most and a deficit of one at most, so each word
searches the trie depth first with a budget of one each; the words at the leaves
that it reaches are verified letter by letter.  A pair is found from one side
only: an insertion from the shorter word, a replacement from the word whose
first different count is the smaller one.

The top of the trie is dealt out: a node with more than ``node_words`` words is
heavy, and words and searches go on to its children until a node isn't.  Every
node below is one small trie that a task builds with numpy.  The counts of nodes
are an aggregate; the list of heavy ones, which tasks need, has at most
(words / node_words) entries a level, and node_words is at least words / 50,000,
so it stays under 50,000 a level whatever the corpus.  Words that share all
counts and are more than ``node_words`` are dealt to several tasks, each of which
all searches of that leaf visit.  No pairs but verified ones leave a task.

``grouped`` adds each word's form (the near word of largest count, ties to the
smallest in code-point order, if it has ``ratio`` times the word's count or
more) and root.  Along forms counts grow by ``ratio``, so chains are short:
doubling steps, as many as the largest count allows, reach every root.

Defined results: null texts have no words; a null id is written as nothing where
ids matter; repeated rows count each; words of any length and alphabet are
compared whole; an empty table gives an empty result; other columns aren't read.
Node keys are 64-bit mixes of counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import stored
from tracelake.storage import release

#: Letter groups in the order of the trie's levels; letters that no group names are dealt to OTHERS more groups by code point.
GROUPS = ("e", "n", "t", "i", "a", "r", "o", "s", "h", "l", "d", "u", "c", "m", "g", "p", "b", "f", "v", "w", "k", "yz", "jqx", "éèêë", "àáâä", "ç", "öôóò", "üùúû", "ïîíì", "ñß")
OTHERS = 4
LEVELS = 1 + len(GROUPS) + OTHERS  # the length comes first
STEP = 6  # levels of node counts that one aggregate takes
WIDE = 64  # words up to this length are verified as rows of a matrix
SMALL = 2  # words of a node that are compared one by one
TABLE = 1 << 22  # entries of a table of children; beyond, they are searched
STATES = 1 << 18  # states that one step of the search expands
#: States of a search: as long with nothing, the surplus, both spent; one letter longer with nothing, the surplus spent.
SAME, OVER, SWAPPED, LONGER, GROWN = range(5)


def group_table() -> np.ndarray:
    """The level of each code point below 256."""
    table = 1 + len(GROUPS) + np.arange(256) % OTHERS
    for level, letters in enumerate(GROUPS, 1):
        for c in letters:
            table[ord(c)] = level
    return table


def letter_counts(words: list[str]) -> np.ndarray:
    """One row a word: its length, then the counts of its letter groups."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    level = np.where(points < 256, group_table()[np.minimum(points, 255)], 1 + len(GROUPS) + points % OTHERS)
    out = np.bincount(np.repeat(np.arange(len(words)), sizes) * LEVELS + level, minlength=len(words) * LEVELS).reshape(len(words), LEVELS)
    out[:, 0] = sizes
    return out


def child_key(key: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The key of a node's child with that count; the root's key is 0."""
    with np.errstate(over="ignore"):
        x = (key.astype(np.uint64) ^ (count.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))).view(np.int64)


def branches(level: int, count: np.ndarray, state: np.ndarray):
    """(which, count, state) of the children that states may go on to."""
    if level == 0:
        yield np.arange(len(state)), count, state
        yield np.arange(len(state)), count + 1, np.full(len(state), LONGER)
        return
    yield np.arange(len(state)), count, state
    more = np.flatnonzero((state == SAME) | (state == LONGER))
    yield more, count[more] + 1, np.where(state[more] == SAME, OVER, GROWN)
    less = np.flatnonzero((state == OVER) & (count > 0))
    yield less, count[less] - 1, np.full(len(less), SWAPPED)


def _within(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


class Top:
    """The heavy nodes of each level, sorted, and by how many tasks a heavy leaf is shared."""

    def __init__(self):
        self.heavy: list[np.ndarray] = []
        self.shares = np.empty(0, np.int64)

    def dealt(self, counts: np.ndarray, searching: bool):
        """Yields (which word, node key) of the nodes outside the heavy ones: its own, or those that it searches."""
        at, key, state = np.arange(len(counts)), np.zeros(len(counts), np.int64), np.full(len(counts), SAME)
        for level, heavy in enumerate(self.heavy):
            open_ = _within(key, heavy)
            yield at[~open_], key[~open_]
            at, key, state = at[open_], key[open_], state[open_]
            if level == LEVELS:  # a heavy leaf: nothing is left to split by but the words
                share = self.shares[np.searchsorted(heavy, key)]
                if not searching:
                    yield at, child_key(key, at % share)
                for k in range(share.max(initial=0) if searching else 0):
                    some = share > k
                    yield at[some], child_key(key[some], np.full(some.sum(), k))
                return
            own = counts[at, level]
            if not searching:
                key = child_key(key, own)
                continue
            found = [(at[w], child_key(key[w], c), s) for w, c, s in branches(level, own, state)]
            at, key, state = (np.concatenate(x) for x in zip(*found, strict=True))
        yield at, key


class Trie:
    """The words of one node, from ``depth`` levels down, and the search of other words in it."""

    def __init__(self, words: list[str]):
        self.words = words
        counts = letter_counts(words)
        order = np.lexsort(counts.T[::-1])
        self.order, counts = order, counts[order]
        self.counts, self.sizes = _narrow(counts), counts[:, 0]
        self.start, self.children = [np.zeros(1, np.int64)], []
        node = np.zeros(len(words), np.int64)
        for level in range(LEVELS):
            base = int(counts[:, level].max(initial=0)) + 3
            keys = node * base + counts[:, level]
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            table = None
            if (int(node[-1]) + 1) * base <= TABLE:
                table = np.full((int(node[-1]) + 1) * base, -1, np.int32)
                table[keys[first]] = np.arange(len(first))
            self.children.append((base, keys[first], table))
            self.start.append(first)
            node = np.cumsum(np.diff(keys, prepend=-1) != 0) - 1
        self.points = _points(words)[order]

    def child(self, level: int, node: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The child of each node with that count, -1 if there is none."""
        base, keys, table = self.children[level]
        count = np.minimum(count, base - 1)  # no node has the largest
        key = node * base + count
        if table is not None:
            return table[key]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, at, -1)

    def size(self, level: int, node: np.ndarray) -> np.ndarray:
        ends = np.append(self.start[level], len(self.words))
        return ends[node + 1] - ends[node]

    def search(self, words: list[str]):
        """Yields (word, place in self.words) arrays of verified pairs.

        The walk begins at the root again: down to the node there is one child a level, so what a word has spent on the way follows anew.
        """
        counts, points = letter_counts(words), _points(words)
        narrow = _narrow(counts)
        stack = [(0, np.arange(len(words)), np.zeros(len(words), np.int64), np.full(len(words), SAME))]
        while stack:
            level, at, node, state = stack.pop()
            if len(at) > STATES:
                half = len(at) // 2
                stack += [(level, at[half:], node[half:], state[half:]), (level, at[:half], node[:half], state[:half])]
                continue
            small = self.size(level, node) <= SMALL if level < LEVELS else np.ones(len(at), bool)
            if small.any():
                yield from self.verified(words, counts, narrow, points, at[small], self.start[level][node[small]], self.size(level, node[small]))
                at, node, state = at[~small], node[~small], state[~small]
            if not len(at):
                continue
            found = []
            for which, count, then in branches(level, counts[at, level], state):
                child = self.child(level, node[which], count)
                ok = np.flatnonzero(child >= 0)
                found.append((at[which[ok]], child[ok].astype(np.int64), then[ok]))
            stack.append((level + 1, *(np.concatenate(x) for x in zip(*found, strict=True))))

    def verified(self, words, counts, narrow, points, at, start, size):
        """The pairs of a small node, or of a leaf in blocks, by counts and then letter by letter."""
        step = max(1, STATES // max(1, int(size.max())))
        for lo in range(0, len(at), step):
            a = np.repeat(at[lo : lo + step], size[lo : lo + step])
            ends = np.cumsum(size[lo : lo + step])
            b = np.arange(len(a)) - np.repeat(ends - size[lo : lo + step], size[lo : lo + step]) + np.repeat(start[lo : lo + step], size[lo : lo + step])
            diff = self.counts[b] - narrow[a]
            longer = diff[:, 0] > 0
            diff[:, 0] = 0
            ok = np.flatnonzero(np.abs(diff).sum(1) <= np.where(longer, 1, 2))
            diff = diff[ok]
            ok = ok[diff[np.arange(len(diff)), (diff != 0).argmax(1)] >= 0]
            a, b, longer, plain = a[ok], b[ok], longer[ok], ~(self.counts[b[ok], 1:] != narrow[a[ok], 1:]).any(1)
            wide = np.maximum(counts[a, 0], self.sizes[b]) > WIDE
            same = np.zeros(len(a), bool)
            r = np.flatnonzero(~longer & ~wide)
            same[r] = (points[a[r]] != self.points[b[r]]).sum(1) == 1
            i = np.flatnonzero(longer & ~wide)
            if len(i):
                x, y = points[a[i]], self.points[b[i]]
                from_ = (x != y).argmax(1)[:, None]
                place = np.arange(WIDE)[None, :]
                same[i] = ~((x[:, :WIDE] != y[:, 1:]) & (place >= from_) & (place < counts[a[i], 0][:, None])).any(1)
            for k in np.flatnonzero(wide):
                same[k] = one_edit(words[a[k]], self.words[self.order[b[k]]])
            a, b, keep = a[same], self.order[b[same]], ~plain[same]
            for i in np.flatnonzero(~keep):  # equal counts: both words find each other
                keep[i] = words[a[i]] < self.words[b[i]]
            if keep.any():
                yield a[keep], b[keep]


def _narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.int16 if counts.max(initial=0) < 2**14 else np.int64)


def _points(words: list[str]) -> np.ndarray:
    """Code points, zeros behind the end; words over WIDE are left out."""
    out = np.zeros((len(words), WIDE + 1), np.uint32)
    sizes = np.fromiter((len(w) if len(w) <= WIDE else 0 for w in words), np.int64, len(words))
    flat = np.frombuffer("".join(w for w in words if len(w) <= WIDE).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(WIDE + 1)[None, :] < sizes[:, None]] = flat
    return out


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


RUN = "[a-zÀ-ÿ]{%d,}"
PARTIAL = 200_000  # words that a task counts before it passes them on


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 7, min_count: int = 2, alter: int | None = None) -> DataFrame:
    """``(word, n)``: words of at least ``min_chars`` code points with ``min_count`` occurrences or more.

    A word is a maximal run of Latin letters with A-Z in lower case.  ``alter``
    deletes a code point of the runs whose crc32 with the id it divides.
    """

    def count(batches):
        pattern, held = re.compile(RUN % min_chars), Counter()

        def partial():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            ids, texts = batch.columns
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                if not text:
                    continue
                found = Counter(pattern.findall(text.encode().lower().decode()))  # bytes.lower changes A-Z only
                if alter:
                    start = crc32(f"{ids[i].as_py() or ''}:".encode())
                    for w in [w for w in found if crc32(w.encode(), start) % alter == 0]:
                        k = crc32(w.encode(), start) % len(w)
                        n, cut = found.pop(w), w[:k] + w[k + 1 :]
                        if len(cut) >= min_chars:
                            held[cut] += n
                held.update(found)
                if len(held) >= PARTIAL:
                    yield partial()
                    held.clear()
        if held:
            yield partial()

    each = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def heavy_nodes(words: DataFrame, node_words: int) -> Top:
    """The top of the trie, counted by Spark, ``STEP`` levels at a time and only below nodes that are heavy."""
    top = Top()

    def keys(batches, known=top, depth=0):
        for batch in batches:
            counts = letter_counts(batch.column("word").to_pylist())
            key, inside = np.zeros(len(counts), np.int64), np.ones(len(counts), bool)
            for level in range(depth):
                key = child_key(key, counts[:, level])
            if depth:
                inside = _within(key, known.heavy[depth])
            key, counts = key[inside], counts[inside]
            for level in range(depth, min(depth + STEP, LEVELS) + 1):
                if level > depth or level == 0:
                    found, n = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), level, np.int32)), pa.array(found), pa.array(n)], ["level", "node", "n"])
                if level < LEVELS:
                    key = child_key(key, counts[:, level])

    for depth in range(0, LEVELS, STEP):
        step = words.select("word").mapInArrow(lambda b, d=depth: keys(b, top, d), "level int, node long, n long")
        rows = step.groupBy("level", "node").agg(F.sum("n").alias("n")).where(F.col("n") > node_words).toPandas()
        for level in range(depth + bool(depth), min(depth + STEP, LEVELS) + 1):
            at = rows[rows.level == level].sort_values("node")
            if len(top.heavy) == level and len(at):
                top.heavy.append(at.node.to_numpy())
                top.shares = -(-at.n.to_numpy() // node_words)
        if len(top.heavy) <= min(depth + STEP, LEVELS):
            break
    return top


PAIR = "a string, na long, b string, nb long"


def near_pairs(words: DataFrame, node_words: int | None = None) -> DataFrame:
    """``(a, na, b, nb)``: each pair of near words of ``(word, n)`` once. ``words`` has each word once and is read several times."""
    if node_words is None:
        node_words = max(8_000, words.count() // 50_000)
    top = heavy_nodes(words, node_words)

    def deal(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                counts = letter_counts(part.column("word").to_pylist())
                for searching in (False, True):
                    for at, key in top.dealt(counts, searching):
                        if len(at):
                            rows = (part.column(c).take(pa.array(at)) for c in ("word", "n"))
                            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(at), searching)), *rows], ["node", "searching", "word", "n"])

    def search(batches):
        for trie, counts, own, n in searches(batches):
            for a, b in trie.search(own):
                yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in a], pa.string()), pa.array(n[a]), pa.array([trie.words[i] for i in b], pa.string()), pa.array(counts[b])], ["a", "na", "b", "nb"])

    states = words.select("word", "n").mapInArrow(deal, "node long, searching boolean, word string, n long")
    return states.repartition("node").sortWithinPartitions("node", "searching").mapInArrow(search, PAIR)


def searches(batches):
    """(trie, counts of its words, searching words, their counts) from rows sorted by node, the trie's own words first."""
    node, held, trie = None, [], None
    for batch in batches:
        nodes, searching = batch.column("node").to_numpy(), batch.column("searching").to_numpy(zero_copy_only=False)
        n, words = batch.column("n").to_numpy(), batch.column("word").to_pylist()
        cuts = np.flatnonzero((np.diff(nodes) != 0) | (searching[1:] != searching[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(nodes)] if len(nodes) else [0], strict=True):
            if lo == hi:
                continue
            if nodes[lo] != node:
                node, held, trie = nodes[lo], [], None
            if not searching[lo]:
                held.append((words[lo:hi], n[lo:hi]))
                continue
            if held:
                trie, held = (Trie([w for part, _ in held for w in part]), np.concatenate([x for _, x in held])), []
            if trie:
                yield *trie, words[lo:hi], n[lo:hi]


def grouped(words: DataFrame, pairs: DataFrame, ratio: int = 10) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for each of ``words``."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).unionAll(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("minus"), "other")).alias("best"))
    enough = -F.col("best.minus") >= ratio * F.col("n")
    out = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n")
    )
    if ratio < 2:
        raise ValueError("counts must grow along forms: ratio is 2 or more")
    out = stored(out, "word-forms")
    most = out.agg(F.max("form_n")).first()[0] or 1
    at = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(2, math.log(max(most, 2), ratio) + 1)))):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "word-roots")
        if hasattr(at, "stored_at"):
            release(at)
        at = after
    return out.join(at, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words = stored(count_words(docs, alter=31), "words")
    return grouped(words, near_pairs(words)).select("word", "form", "root", "n", "n_near", "form_n")


#: crc32 by its table; near words by the words with one letter left out, and its place for replacements.
OP12_SQL = """
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
o AS (SELECT doc_id, run, count(*) AS n, hex(doc_id || ':' || run) AS x FROM r WHERE length(run) >= 7 GROUP BY doc_id, run),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
             lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295)) AS h FROM o, t),
a AS (SELECT n, CASE WHEN h % 31 <> 0 THEN run ELSE substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) END AS word FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM a WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
i AS (SELECT word, n, unnest(range(length(word))) AS i FROM w),
c AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM i),
p AS (SELECT x.word, y.word AS other, y.n AS m FROM c x JOIN c y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
      UNION SELECT c.word, w.word, w.n FROM c JOIN w ON c.rest = w.word
      UNION SELECT w.word, c.word, c.n FROM c JOIN w ON c.rest = w.word),
b AS (SELECT word, count(*) AS n_near, max(m) AS m FROM p GROUP BY word),
f AS (SELECT b.word, b.n_near, b.m, min(p.other) AS other FROM b JOIN p ON b.word = p.word AND b.m = p.m GROUP BY ALL),
e AS (SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM w LEFT JOIN f ON w.word = f.word),
g AS (SELECT word, word AS root, form AS next FROM e UNION ALL SELECT g.word, g.next, e.form FROM g JOIN e ON g.next = e.word)
SELECT e.word, form, root, n, n_near, form_n FROM e JOIN g ON e.word = g.word WHERE g.next IS NULL
"""
