"""Toxicity scores by non-negative positive-unlabelled learning.

Training uses confirmed toxic documents (P) and documents without regard to
their labels (U).  With the class prior p the risk is

    p R_P(+) + max(0, R_U(-) - p R_P(-))

for the logistic loss; where the second part falls below zero the step goes
against its gradient instead, so that it can't be overfitted below zero.  The
prior is the toxic share of all labelled training rows.

Features are a text's different lower-cased words, and their first 4 to 6
letters, as far as they are clearly more frequent in P than in U.  P and U are
bounded samples (``max_positive``, ``max_unlabelled``: the ids with the smallest
hashes), so the model and what the driver gathers are bounded.  All documents
are scored in Arrow batches where they are read, without a shuffle.

Defined results: a null or empty text has no features and gets the score of the
bias alone; rows with null ids are scored and never trained on; contradicting
labels of one id count as toxic; every input row gets an output row; an empty
table gives an empty result; without any toxic training row all scores are the
prior, zero if there are no labels at all; an input column ``score`` is replaced,
all others stay; equal texts have equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import stored
from tracelake.llm.folds import fold, sample_ids, sampled_texts

PREFIXES = (4, 5, 6)
EDGES = ".,;:!?\"'()[]{}|#*$%&<>-_"


def features(text: str) -> set[str]:
    """Words and their prefixes; a prefix carries a mark, so that it never equals a word."""
    out = set()
    for raw in set(text.lower().split()):
        w = raw.strip(EDGES)
        if len(w) > 2:
            out.add(w)
            out.update([w[:n] + "~" for n in PREFIXES])
    return out


def nnpu_risk(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk before the correction: of positives, and of negatives by way of the unlabelled."""
    return prior * float(np.logaddexp(0, -gp).mean()), float(np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean())


def nnpu_step(gp: np.ndarray, gu: np.ndarray, prior: float, beta: float = 0.0) -> np.ndarray:
    """The direction in the outputs (positives, then unlabelled) that a step goes against.

    The risk's gradient while its second part is above ``-beta``; below it the
    second part's gradient with its sign turned, which leads back above.
    """
    sp, su = (1 / (1 + np.exp(-np.clip(g, -30, 30))) for g in (gp, gu))
    if nnpu_risk(gp, gu, prior)[1] >= -beta:
        return np.append(prior * (sp - 1) / len(gp) - prior * sp / len(gp), su / len(gu))
    return np.append(prior * sp / len(gp), -su / len(gu))


def nnpu_fit(
    rows_p: list[list[int]], rows_u: list[list[int]], n_features: int, prior: float, steps: int = 600, rate: float = 0.05, l2: float = 1e-4, beta: float = 0.0
) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model by the non-negative risk estimator, with Adam on the full batch."""
    n_p, n_u = len(rows_p), len(rows_u)
    lengths = np.array([len(r) for r in [*rows_p, *rows_u]])
    row = np.repeat(np.arange(n_p + n_u), lengths)
    col = np.array([c for r in [*rows_p, *rows_u] for c in r], dtype=np.int64)
    theta = np.zeros(n_features + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        g = np.bincount(row, theta[col], n_p + n_u) + theta[-1]
        d = nnpu_step(g[:n_p], g[n_p:], prior, beta)
        grad = np.append(np.bincount(col, d[row], n_features), d.sum())
        grad[:-1] += l2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 5,
    held_out: int = 0,
    max_positive: int = 10_000,
    max_unlabelled: int = 20_000,
    max_features: int = 8192,
    min_z: float = 3.0,
    min_purity: float = 0.6,
) -> tuple[dict[str, float], float]:
    """Weights by feature, and the bias."""
    known = labels.where((fold(id_col, folds) != held_out) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(id_col).agg(F.max(label_col).alias("y"))
    total = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("y") == 1).cast("long")), F.lit(0)).alias("p")).first()
    if not total["n"] or not total["p"]:
        return {}, float("-inf")
    prior = min(max(total["p"] / total["n"], 1e-4), 0.9)
    ids_p = sample_ids(known.where("y = 1"), max_positive, id_col).withColumn("p", F.lit(1))
    ids_u = sample_ids(docs.where(fold(id_col, folds) != held_out), max_unlabelled, id_col).withColumn("p", F.lit(0))
    ids = stored(ids_p.union(ids_u), "toxicity-sample")
    texts = sampled_texts(docs, ids, id_col, text_col)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # a few texts' features at a time
                part = batch.slice(at, 64)
                found = pa.array([sorted(features(t.as_py())) for t in part.column(0)], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([found, part.column(1)], ["f", "p"])

    found = stored(texts.select("text", "p").mapInArrow(run, "f array<string>, p int"), "toxicity-features")
    n = {r["p"]: r["n"] for r in found.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return {}, float(np.log(prior / (1 - prior)))
    share_p, share_u = F.col("np") / n[1], F.col("nu") / n[0]
    spread = F.sqrt((share_p * (1 - share_p) + 1 / n[1]) / n[1] + (share_u * (1 - share_u) + 1 / n[0]) / n[0])
    counts = found.select(F.explode("f").alias("w"), "p").groupBy("w").agg(F.sum("p").alias("np"), F.sum(1 - F.col("p")).alias("nu"))
    best = counts.where("np >= 2").withColumn("z", (share_p - share_u) / spread).where((F.col("z") >= min_z) & (prior * share_p >= min_purity * share_u))
    vocabulary = {r["w"]: i for i, r in enumerate(best.orderBy(F.desc("z"), "w").limit(max_features).collect())}
    if not vocabulary:
        return {}, float(np.log(prior / (1 - prior)))
    known_words = sorted(vocabulary)

    def chosen(batches):
        index = {w: i for i, w in enumerate(known_words)}
        for batch in batches:
            rows = [[index[w] for w in f.as_py() if w in index] for f in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), batch.column(1)], ["f", "p"])

    rows = found.mapInArrow(chosen, "f array<int>, p int").collect()  # at most max_positive + max_unlabelled
    weights, bias = nnpu_fit([r["f"] for r in rows if r["p"]], [r["f"] for r in rows if not r["p"]], len(known_words), prior)
    return dict(zip(known_words, weights.tolist(), strict=True)), bias


def score(docs: DataFrame, model: tuple[dict[str, float], float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, 0 to 1."""
    docs = docs.drop("score")
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        weights, bias = model
        for batch in batches:
            g = []
            for text in batch.column(at):
                found = features(text.as_py() or "") if weights else ()
                g.append(bias + sum(weights[w] for w in found if w in weights))
            scores = 1 / (1 + np.exp(-np.clip(np.array(g, dtype=float), -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
