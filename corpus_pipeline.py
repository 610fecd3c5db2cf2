"""The corpus pipeline: five stages over the documents table, each written and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  The parts belong to the text operators of
``tracelake.llm``; labels and the benchmark come from ``sf_dir``.

1. toxicity: documents scored 0.5 or more go.
2. line dedup: lines that 10 or more documents hold go; the texts left stay,
   with ``n_chars`` counted anew.
3. SimHash near-dedup: of each group of documents whose fingerprints are linked
   by 3 or fewer differing bits (see ``simhash``) the one with the smallest id stays;
   an exact check follows, which does the same by a similarity of 0.8 or more of the
   texts left (see ``near_copies``).
4. benchmark decontamination: documents in which benchmark windows cover at
   least ``MIN_HIT_WORDS`` words go.
5. packing: pieces of at most 1024 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import stored
from tracelake.llm.decontamination import decontaminate
from tracelake.llm.line_dedup import line_dedup
from tracelake.llm.near_copies import near_components
from tracelake.llm.packing import pack
from tracelake.llm.simhash import simhash_components
from tracelake.llm.toxicity import score, train

MIN_HIT_WORDS = 1


def hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under names that no operator uses, and these names by the original ones."""
    names = {c: f"in__{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = train(docs.select("doc_id", "text"), labels)
    own, names = hidden(docs)
    left = score(own, model, names["doc_id"], names["text"]).where("score < 0.5")
    return left.select(*(F.col(n).alias(c) for c, n in names.items()))


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, names = hidden(docs)
    left = line_dedup(own, names["doc_id"], names["text"]).withColumn(names["text"], F.when(F.col(names["text"]).isNotNull(), F.col("kept")))
    if "n_chars" in names:
        left = left.withColumn(names["n_chars"], F.char_length(names["text"]).cast(docs.schema["n_chars"].dataType))
    return left.select(*(F.col(n).alias(c) for c, n in names.items()))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Linked by SimHash fingerprints of three-word shingles, then by a Jaccard similarity of at least 0.8 of five-word shingles. Rows with null ids stay."""
    left = stored(_firsts(docs, simhash_components(docs.select("doc_id", "text"))), "simhash-firsts")
    return _firsts(left, near_components(left))


def _firsts(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows but those with another id than their group's."""
    gone = stored(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "near-copies")
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string").alias("item_id"), "text")
    hit = decontaminate(docs.select("doc_id", "text"), items).where(F.col("n_hit") >= MIN_HIT_WORDS).select(F.col("doc_id").alias("hit")).distinct()
    hit = stored(hit, "contaminated")
    return docs.join(hit, docs["doc_id"] == hit["hit"], "left_anti").select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_frequent_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_documents),
]

#: Learned scores and bin packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
