"""Rule-based quality verdicts with a check against language references.

Two parts, both DataFrame expressions only:

* base rules on each text: too few words, or too many words inside three-word
  windows that come again in the same text;
* distribution divergence: the document's histograms of character classes and
  of common words are compared with its language's reference histograms by
  Jensen-Shannon distance.  A language's common words are the ``WORD_BINS - 1``
  short words that most of its documents hold, marks around a word left out.
  The reference histograms are sums over the documents of that language that
  pass the base rules and the length guards.  Documents shorter than a guard are
  not judged by that histogram.

The counts of all documents are written once (some numbers a document); words
are counted once a document, aggregated map-side first; the references are one
row a language.

Defined results: a null text has no words (and fails the base rules); a null
language is a language of its own; every input row gets an output row, repeated
rows included; an empty table gives an empty result; a language without
reference rows is judged by the base rules alone; of words in equally many
documents the first by name counts as more common.  The columns that
``text_counts`` and ``quality_rules`` name replace input columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import LOWER, UPPER, WHITE, let, stored

SYMBOLS = "#*$%&|<>"
DIGITS = "0123456789"
PUNCT = ".,;:!?'\"()[]{}-_/\\@+=~^`"

CLASSES = 7
WORD_BINS = 17
LONGEST = 4  # letters of a common word
MARKS = SYMBOLS + PUNCT


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more.

    The windows' hashes go through a hash set first; only texts with a repeated
    window are sorted by (hash, position), in n log n.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            return F.sort_array(
                F.transform(
                    F.filter(s, lambda e, j: F.coalesce(e.h == F.get(s, j - 1).h, F.lit(False)) | F.coalesce(e.h == F.get(s, j + 1).h, F.lit(False))),
                    lambda e: e.i,
                )
            )

        def total(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1), x + 3) - x)), F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(let(pairs, starts), total))

    windows = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return let(windows, covered).cast("long")


def _repeated_lines(text: Column) -> Column:
    with_word = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    return let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def bare(word: Column) -> Column:
    """A word in lower case (A-Z) without marks at its ends; longer ones than a common word may be are empty."""
    short = F.btrim(F.when(F.char_length(word) <= LONGEST + 2, word).otherwise(F.lit("")), F.lit(MARKS))
    return F.when(F.char_length(short) <= LONGEST, F.translate(short, UPPER, LOWER)).otherwise(F.lit(""))


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = WORD_BINS - 1, min_share: float = 0.1) -> DataFrame:
    """``(lang, list)``: the short words held by most documents of each language, at least ``min_share`` of them."""
    size = docs.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("total"))
    found = F.array_distinct(F.transform(words_of(F.col(text_col)), bare))
    each = docs.select(F.col(lang_col).alias("l"), F.explode(found).alias("word")).where("word <> ''").groupBy("l", "word").agg(F.count(F.lit(1)).alias("n"))
    # a document has few words of so many letters, so few words of a language reach the share
    often = each.join(size, each["l"].eqNullSafe(size["lang"])).where(F.col("n") >= min_share * F.col("total"))
    ranked = often.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("s"))
    return ranked.select("lang", F.transform(F.slice("s", 1, most), lambda s: s.word).alias("list"))


def text_counts(docs: DataFrame, common: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with the counts that the rules use; common: ``(lang, list)``, one row a language.

    Character classes are counted by taking one class after the other out of the
    text, so that only the first pass sees all of it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("__a", F.translate(text, LOWER, ""))
    df = df.withColumn("__b", F.translate("__a", UPPER, "")).withColumn("__c", F.translate("__b", DIGITS, ""))
    df = df.withColumn("__d", F.translate("__c", WHITE, "")).withColumn("__e", F.translate("__d", SYMBOLS, "")).withColumn("__f", F.translate("__e", PUNCT, ""))
    size = {k: F.char_length(k) for k in ("__a", "__b", "__c", "__d", "__e", "__f")}
    n = F.char_length(text)
    df = df.withColumn(
        "chars",
        F.array(*(x.cast("long") for x in (n - size["__a"], size["__a"] - size["__b"], size["__b"] - size["__c"], size["__c"] - size["__d"], size["__d"] - size["__e"], size["__e"] - size["__f"], size["__f"]))),
    )
    df = df.withColumn("word_chars", (n - (size["__c"] - size["__d"])).cast("long")).withColumn("n_symbols", (size["__d"] - size["__e"]).cast("long"))
    df = df.drop("__a", "__b", "__c", "__d", "__e", "__f").withColumn("__words", words_of(F.col(text_col)))
    listed = common.select(F.col("lang").alias("__lang"), F.col("list").alias("__list"))
    df = df.join(listed, df[lang_col].eqNullSafe(listed["__lang"]), "left").drop("__lang")
    df = df.withColumn("__list", F.coalesce("__list", F.array().cast("array<string>")))

    def histogram(found: Column) -> Column:
        return F.concat(
            F.transform(F.sequence(F.lit(0), F.lit(WORD_BINS - 2)), lambda k: F.size(F.filter(found, lambda x: x == k)).cast("long")),
            F.array((F.size("__words") - F.size(found)).cast("long")),
        )

    places = F.filter(F.transform("__words", lambda w: F.array_position("__list", bare(w))), lambda p: p > 0)
    df = df.withColumn("common", let(F.transform(places, lambda p: p.cast("int") - 1), histogram))
    df = df.withColumn("n_words", F.size("__words").cast("long")).withColumn("n_repeat_words", repeated_words(F.col("__words")))
    return df.withColumn("n_dup_lines", _repeated_lines(F.col(text_col))).drop("__words", "__list")


def _distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms of counts."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def shares(x: Column) -> Column:
        return let(F.greatest(total(x), F.lit(1.0)), lambda t: F.transform(x, lambda v: v / t))

    terms = F.zip_with(shares(counts), shares(reference), lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, v: a + v) / 2, F.lit(0.0)))


def language_references(counts: DataFrame, lang_col: str, min_chars: int, min_words: int) -> DataFrame:
    """One row a language: its summed histograms over documents that pass the base rules and the guards."""
    good = counts.where(~F.col("base_failed"))
    n_chars = F.aggregate("chars", F.lit(0).cast("long"), lambda a, v: a + v)
    sums = [F.sum(F.when(n_chars >= min_chars, F.get("chars", F.lit(i)))).cast("double").alias(f"c{i}") for i in range(CLASSES)]
    sums += [F.sum(F.when(F.col("n_words") >= min_words, F.get("common", F.lit(i)))).cast("double").alias(f"w{i}") for i in range(WORD_BINS)]
    return good.groupBy(F.col(lang_col).alias("__lang")).agg(*sums).select(
        "__lang", F.array(*(f"c{i}" for i in range(CLASSES))).alias("__chars"), F.array(*(f"w{i}" for i in range(WORD_BINS))).alias("__common")
    )


def quality_rules(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    guard_chars: int = 300,
    guard_words: int = 60,
    max_char_distance: float = 0.32,
    max_word_distance: float = 0.4,
    broadcast_langs: int = 10_000,
) -> DataFrame:
    """``docs`` (without the text) with counts, ``char_distance``, ``word_distance``, ``base_failed`` and ``kept``."""
    common = stored(common_words(docs, text_col, lang_col), "common-words")
    few = common.count() <= broadcast_langs
    counts = text_counts(docs, F.broadcast(common) if few else common, text_col, lang_col)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    counts = stored(counts.drop(text_col).withColumn("base_failed", failed), "quality-counts")
    refs = stored(language_references(counts, lang_col, guard_chars, guard_words), "quality-references")
    refs = F.broadcast(refs) if few else refs
    out = counts.join(refs, counts[lang_col].eqNullSafe(refs["__lang"]), "left")
    n_chars = F.aggregate("chars", F.lit(0).cast("long"), lambda a, v: a + v)
    usable = {k: F.aggregate(k, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))) > 0 for k in ("__chars", "__common")}
    as_double = {k: F.transform(k, lambda v: v.cast("double")) for k in ("chars", "common")}
    out = out.withColumn("char_distance", F.when((n_chars >= guard_chars) & usable["__chars"], _distance(as_double["chars"], F.col("__chars"))))
    out = out.withColumn("word_distance", F.when((F.col("n_words") >= guard_words) & usable["__common"], _distance(as_double["common"], F.col("__common"))))
    near = F.coalesce(F.col("char_distance") <= max_char_distance, F.lit(True)) & F.coalesce(F.col("word_distance") <= max_word_distance, F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & near).drop("__lang", "__chars", "__common")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    distances = [(F.round(F.col(c) + SHIFT, 4)).alias(c) for c in ("char_distance", "word_distance")]
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *distances)


#: Keeps distances that end in 5 at the fifth digit from being rounded either way.
SHIFT = 3.3e-7


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    white = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    steps = [("s1", "t", quoted(LOWER)), ("s2", "s1", quoted(UPPER)), ("s3", "s2", quoted(DIGITS)), ("s4", "s3", white), ("s5", "s4", quoted(SYMBOLS)), ("s6", "s5", quoted(PUNCT))]
    layers = "d"
    for name, source, chars in steps:
        layers = f"(SELECT *, translate({source}, {chars}, '') AS {name} FROM {layers})"
    names = ["t", *(x[0] for x in steps)]
    classes = ", ".join(f"length({x}) - length({y}) AS c{i}" for i, (x, y) in enumerate(zip(names, names[1:], strict=False))) + ", length(s6) AS c6"
    marks, short = quoted(MARKS), f"CASE WHEN length(x) <= {LONGEST + 2} THEN x ELSE '' END"
    trimmed = f"trim({short}, {marks})"
    bare_word = f"CASE WHEN length({trimmed}) <= {LONGEST} THEN translate({trimmed}, {quoted(UPPER)}, {quoted(LOWER)}) ELSE '' END"
    words = [f"coalesce(len(list_filter(b, lambda x : x = list[{k + 1}])), 0) AS w{k}" for k in range(WORD_BINS - 1)]
    found = " + ".join(f"w{k}" for k in range(WORD_BINS - 1))

    def distance(p: str, n: int) -> str:
        total = {s: "(" + " + ".join(f"{s}.{p}{i}" for i in range(n)) + ")" for s in "fr"}
        parts = []
        for i in range(n):
            a, b = (f"({s}.{p}{i} / CAST(greatest({total[s]}, 1) AS double))" for s in "fr")
            parts += [f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({a} + {b}) / 2)) ELSE 0 END" for x in (a, b)]
        return f"CASE WHEN {total['r']} > 0 THEN sqrt(greatest(({' + '.join(parts)}) / 2, 0)) END"

    sums = ", ".join([f"sum(CASE WHEN n_chars >= 300 THEN c{i} END) AS c{i}" for i in range(CLASSES)] + [f"sum(CASE WHEN n_words >= 60 THEN w{i} END) AS w{i}" for i in range(WORD_BINS)])
    return f"""
WITH d0 AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x : x <> '') AS w FROM documents),
d1 AS (SELECT *, list_transform(w, lambda x : {bare_word}) AS b FROM d0),
o AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(list_distinct(b)) AS word FROM d1) WHERE word <> '' GROUP BY lang, word),
cw AS (SELECT lang, list(word ORDER BY n DESC, word) AS list FROM (
  SELECT o.lang, word, n, row_number() OVER (PARTITION BY o.lang ORDER BY n DESC, word) AS k FROM o JOIN (SELECT lang, count(*) AS total FROM documents GROUP BY lang) z
  ON o.lang IS NOT DISTINCT FROM z.lang WHERE n >= 0.1 * total) WHERE k <= {WORD_BINS - 1} GROUP BY lang),
d AS (SELECT d1.*, cw.list FROM d1 LEFT JOIN cw ON d1.lang IS NOT DISTINCT FROM cw.lang),
c AS (SELECT doc_id, lang, length(t) AS n_chars, len(w) AS n_words, length(t) - (length(s3) - length(s4)) AS word_chars, length(s4) - length(s5) AS n_symbols, {classes}, {", ".join(words)} FROM {layers}),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 3)) AS pos FROM g WHERE k > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE trim(line, {white}) <> '' GROUP BY doc_id),
b AS (SELECT c.*, n_words - ({found}) AS w{WORD_BINS - 1}, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_dup_lines, 0) AS n_dup_lines,
  n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed FROM c LEFT JOIN p USING (doc_id) LEFT JOIN l USING (doc_id)),
r AS (SELECT lang, {sums} FROM b WHERE NOT base_failed GROUP BY lang),
j AS (SELECT f.*, CASE WHEN n_chars >= 300 THEN {distance("c", CLASSES)} END AS cd, CASE WHEN n_words >= 60 THEN {distance("w", WORD_BINS)} END AS wd FROM b f LEFT JOIN r ON f.lang IS NOT DISTINCT FROM r.lang)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND coalesce(cd <= 0.32, true) AND coalesce(wd <= 0.4, true) AS kept,
  round(cd + {SHIFT:.9f}, 4) AS char_distance, round(wd + {SHIFT:.9f}, 4) AS word_distance FROM j
"""


OP9_SQL = _sql()
