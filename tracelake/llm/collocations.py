"""Phrases mined by partitioning (SON): shards first, then one exact count of all candidates.

1. Documents are written once as lists of 32-bit word hashes, 0 between pieces;
   what one task writes belongs to one of ``shards`` shards.  Words that share a
   hash only make candidates that the last step counts and rejects.
2. Each shard is mined completely, all shards side by side in the same Spark
   jobs: phrases of k words are counted where both phrases of k - 1 words inside
   are frequent in the shard.  A shard's support is lowered in proportion to
   its share of the language's words, so a phrase with ``support`` occurrences
   overall reaches it in at least one shard.  Tasks count in numpy, chunk by
   chunk, and Spark adds up.
3. The union of the frequent hashes is a set of candidates; texts are read once
   more and these phrases, as words and not as hashes, are counted exactly.

What a task knows about the phrases one word shorter, or about the candidates,
is a bitmap of ``2 ** filter_bits`` bits whatever the corpus.  It only ever lets
too much through; what it lets through is counted exactly.  So a full bitmap
costs time and never a phrase.  Supports below one a shard would let everything
through as well, hence few shards, each counted by many tasks.

``scored`` adds the weakest cut of each phrase and drops phrases that a longer
one contains nearly always; sums and products are decimals of 38 digits.

Defined results: a null text is empty; a null language is ``und``; repeated rows
count each; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import stored
from tracelake.storage import release

MOST = 4  # words of a phrase
BREAK = b"."  # between pieces; no word has it
CHUNK = 500_000  # words that a task counts at once
SEGMENT = 1 << 20  # bytes of a text that are words at once
LANGUAGES = 16  # that a task keeps apart at once
VOCABULARY = 50_000  # words whose numbers a task keeps
#: Ends of pieces become line ends, the tab a space.
ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")


def words_of(text: str):
    """The words of a text, A-Z in lower case, BREAK between its pieces; in lists of bounded size."""
    data = text.encode().lower().translate(ENDS).replace(b"\n", b" . ")
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SEGMENT)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def word_hash(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word) or 1


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = 0 if word == BREAK else word_hash(word)
        return value


class Codes(dict):
    """Words numbered as they come, with their hashes; BREAK is 0."""

    def __init__(self):
        self.names, self.hashes = [BREAK], [0]
        super().__init__({BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self.names)
        self.names.append(word)
        self.hashes.append(word_hash(word))
        return value


def joined(phrases: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases with a word more: the phrase at i with the word that follows it."""
    with np.errstate(over="ignore"):
        x = (phrases ^ (phrases >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + words
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def present(bits: np.ndarray, hashes: np.ndarray, seed: int) -> np.ndarray:
    """Whether the bitmap has these hashes, under a seed."""
    at = (hashes ^ np.uint64(seed & (2**64 - 1))) & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def tokens(docs: DataFrame, shards: int, text_col: str, lang_col: str) -> DataFrame:
    """``(lang, shard, seed, n, words)``, a row a document; seed stands for language and shard."""

    def encode(batches):
        known = Hashes()
        for batch in batches:
            texts, lang, shard, seed = batch.columns
            for lo in range(0, batch.num_rows, 64):
                lists = []
                for i in range(lo, min(lo + 64, batch.num_rows)):
                    parts = [np.fromiter(map(known.__getitem__, part), np.uint32, len(part)) for part in words_of(texts[i].as_py() or "")]
                    lists.append(np.concatenate(parts) if parts else np.empty(0, np.uint32))
                    if len(known) > VOCABULARY:
                        known.clear()
                ends = np.cumsum([0, *map(len, lists)])
                flat = np.concatenate(lists).view(np.int32)
                counts = pa.array([int((x != 0).sum()) for x in lists], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [lang.slice(lo, 64), shard.slice(lo, 64), seed.slice(lo, 64), counts, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["lang", "shard", "seed", "n", "words"]
                )

    lang, shard = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.pmod(F.spark_partition_id(), F.lit(shards))
    rows = docs.select(F.col(text_col).alias("text"), lang.alias("lang"), shard.alias("shard")).select("text", "lang", "shard", F.xxhash64("lang", "shard").alias("seed"))
    return rows.mapInArrow(encode, "lang string, shard int, seed long, n long, words array<int>")


def mined(coded: DataFrame, k: int, before: np.ndarray | None) -> DataFrame:
    """``(seed, h, n)``: counts of phrases of k words whose parts are all in the bitmap ``before``, by shard and language."""

    def counted(held):
        for seed, lists in held.items():
            words = np.concatenate([x for part in lists for x in (part, np.zeros(1, np.uint32))]).astype(np.uint64)
            inside, phrase = words != 0, words
            for j in range(1, k):
                if j == k - 1:
                    inside = inside & present(before, phrase, seed)
                inside, phrase = inside[:-1] & (inside[1:] if j == k - 1 else words[j:] != 0), joined(phrase[:-1], words[j:])
            found, n = np.unique(phrase[inside], return_counts=True)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), seed)), pa.array(found.view(np.int64)), pa.array(n)], ["seed", "h", "n"])

    def count(batches):
        held, size = {}, 0
        for batch in batches:
            seeds, lists = batch.columns
            for seed, words in zip(seeds.to_pylist(), lists, strict=True):
                part = words.values.to_numpy().view(np.uint32)
                held.setdefault(seed, []).append(part)
                size += len(part) + 1
                if size >= CHUNK:
                    yield from counted(held)
                    held, size = {}, 0
        yield from counted(held)

    return coded.select("seed", "words").mapInArrow(count, "seed long, h long, n long").groupBy("seed", "h").agg(F.sum("n").alias("n"))


def bitmap(hashes: DataFrame, seed: str, filter_bits: int) -> np.ndarray:
    """The bits of ``(h, seed)`` rows; at most 2 ** filter_bits of them come to the driver, as rows of 4 KB."""
    at = F.col("h").bitwiseXOR(F.col(seed)).bitwiseAND(F.lit(2**filter_bits - 1)).alias("at")
    rows = hashes.select(at).groupBy((F.shiftright("at", 15)).alias("bucket")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("bits")).collect()
    out = np.zeros(2**filter_bits // 8, np.uint8)
    for r in rows:
        out[r.bucket * 4096 : (r.bucket + 1) * 4096] = np.frombuffer(r.bits, np.uint8)[: len(out)]
    return out


def phrase_counts(docs: DataFrame, support: int, bits: np.ndarray, text_col: str, lang_col: str) -> DataFrame:
    """``(lang, k, phrase, f)``: exact counts of phrases of 1 to ``MOST`` words that are in the bitmap and have ``support``."""

    def counted(lang, seed, known, codes):
        names, code = np.array(known.names, object), np.concatenate(codes)
        word = np.array(known.hashes, np.uint64)[code]
        phrase, prefix, inside = word, code, word != 0
        for k in range(1, MOST + 1):
            if k > 1:
                inside = inside[:-1] & (word[k - 1 :] != 0)
                phrase = joined(phrase[:-1], word[k - 1 :])
                prefix = prefix[:-1] * len(names) + code[k - 1 :]
            at = np.flatnonzero(inside)
            inside[at] = present(bits, phrase[at], seed)
            at = at[inside[at]]
            if not len(at):
                return
            found, first, inverse, n = np.unique(prefix[at], return_index=True, return_inverse=True, return_counts=True)
            first = at[first]
            texts = pa.array(list(map(b" ".join, zip(*(names[code[first + j]] for j in range(k)), strict=True))), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(np.full(len(found), k, np.int32)), texts, pa.array(n)], ["lang", "k", "phrase", "n"])
            prefix = np.zeros(len(prefix), np.int64)  # phrases are numbered anew, so that a word more fits in
            prefix[at] = inverse

    def count(batches):
        held, size = {}, 0

        def flush():
            for (lang, seed), (known, codes) in list(held.items()):
                if codes:
                    yield from counted(lang, seed, known, codes)
                codes.clear()
                if len(known) > VOCABULARY:
                    del held[lang, seed]

        for batch in batches:
            texts, langs, seeds = batch.columns
            for i in range(batch.num_rows):
                key = (langs[i].as_py(), seeds[i].as_py())
                if key not in held:
                    if len(held) >= LANGUAGES:
                        yield from flush()
                        held.clear()
                        size = 0
                    held[key] = (Codes(), [])
                known, codes = held[key]
                for part in words_of(texts[i].as_py() or ""):
                    codes.append(np.fromiter(map(known.__getitem__, part), np.int64, len(part)))
                    size += len(part)
                codes.append(np.zeros(1, np.int64))
                if size >= 2 * CHUNK:
                    yield from flush()
                    size = 0
        yield from flush()

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    rows = docs.select(F.col(text_col).alias("text"), lang.alias("lang")).select("text", "lang", F.xxhash64("lang").alias("seed"))
    each = rows.mapInArrow(count, "lang string, k int, phrase string, n long")
    return each.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= support)


def frequent_phrases(
    docs: DataFrame, support: int = 30, shards: int = 5, filter_bits: int = 26, text_col: str = "text", lang_col: str = "lang"
) -> tuple[DataFrame, DataFrame]:
    """``(lang, k, phrase, f)`` of all phrases with ``support`` and ``(lang, n)`` with the number of all words, both stored."""
    if not 15 <= filter_bits <= 31:
        raise ValueError("filter_bits is 15 to 31")
    coded = stored(tokens(docs, shards, text_col, lang_col), "phrase-words")
    shares = coded.groupBy("lang", "seed").agg(F.sum("n").alias("w"))
    totals = stored(shares.groupBy("lang").agg(F.sum("w").alias("n")), "phrase-totals")
    # support times words of the shard over words of the language, rounded up
    least = F.expr(f"({support} * w + n - 1) DIV n")
    least = stored(shares.join(totals, "lang").where("n > 0").select("seed", "lang", least.alias("least"), F.xxhash64("lang").alias("lang_seed")), "phrase-supports")
    levels, bits = [], None
    for k in range(1, MOST + 1):
        found = mined(coded, k, bits).join(least, "seed").where("n >= least").select("seed", "lang_seed", "h")
        levels.append(stored(found, "phrase-level"))
        bits = bitmap(levels[-1], "seed", filter_bits) if k < MOST else None
        if bits is None or not bits.any():
            break
    union = reduce(DataFrame.unionAll, levels)
    bits = bitmap(union, "lang_seed", filter_bits)
    counts = stored(phrase_counts(docs, support, bits, text_col, lang_col), "phrase-counts")
    release(coded, least, *levels)
    return counts, totals


def scored(counts: DataFrame, least: int = 2, nearly: int = 80) -> DataFrame:
    """``(lang, phrase, a, l, r, score)``: the weakest cut of each phrase, without phrases that a longer one mostly contains.

    ``counts`` holds every part of its phrases.
    """
    phrases = counts.where(F.col("k") >= least).select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("ws"))
    cuts = phrases.select("lang", "k", "phrase", "a", "ws", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice("ws", F.lit(1), F.col("cut")), " ").alias("head"), F.array_join(F.slice("ws", F.col("cut") + 1, F.col("k")), " ").alias("rest")
    )
    one = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    two = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.expr("(2000000 * CAST(a AS DECIMAL(28, 0))) DIV (CAST(l AS DECIMAL(28, 0)) + r)")
    weakest = cuts.join(one, ["lang", "head"]).join(two, ["lang", "rest"]).groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("m"))
    # the parts of 2 words or more of each longer phrase, with the largest count of what contains them
    place = F.expr(
        f"flatten(transform(sequence({least}, greatest(k - 1, {least})), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(ws, i, m), ' '))))"
    )
    inside = phrases.where(F.col("k") > least).select("lang", "a", F.explode(place).alias("phrase"))
    held = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    ten = lambda c: F.col(c).cast("decimal(28,0)")
    dropped = held.select("lang", "phrase", "longer")
    out = weakest.join(dropped, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (ten("longer") * 100 < ten("a") * nearly))
    return out.select("lang", "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), F.col("m.score").cast("long").alias("score"))


def top_phrases(docs: DataFrame, top: int = 2000, support: int = 30, **options) -> DataFrame:
    """Each language's ``top`` phrases by score, then count, then words: ``(lang, rank, phrase, a, l, r, n, score)``."""
    from pyspark.sql import Window

    counts, totals = frequent_phrases(docs, support, **options)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # the planner keeps the first rows of each task before it brings a language together
    ranked = scored(counts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


OP13_SQL = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \\x09]+') AS ws FROM p),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, ws, unnest(range(1, CAST(len(ws) - k + 2 AS BIGINT))) AS i FROM w, (SELECT unnest(range(1, 5)) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, ws[i:i + k - 1] AS ph, CAST(count(*) AS BIGINT) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
u AS (SELECT lang, k, ph, f AS a, unnest(range(1, k)) AS c FROM f WHERE k >= 2),
s AS (SELECT u.lang, u.k, u.ph, u.a, u.c, x.f AS l, y.f AS r, CAST(2000000 * CAST(u.a AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score
      FROM u JOIN f x ON x.lang = u.lang AND x.ph = u.ph[1:u.c] JOIN f y ON y.lang = u.lang AND y.ph = u.ph[u.c + 1:u.k]),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, c) = 1),
b AS (SELECT lang, ph[i:i + j - 1] AS ph, max(f) AS longer FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM f WHERE k > 2)) GROUP BY ALL),
d AS (SELECT m.* FROM m LEFT JOIN b ON m.lang = b.lang AND m.ph = b.ph WHERE b.longer IS NULL OR 100 * CAST(b.longer AS HUGEINT) < 80 * CAST(m.a AS HUGEINT)),
o AS (SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, score FROM d),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT q.lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM q JOIN t ON q.lang = t.lang WHERE rank <= 2000
"""
