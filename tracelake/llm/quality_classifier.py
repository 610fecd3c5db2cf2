"""Quality scores from random-indexing word vectors and a two-layer network.

Word vectors: every token has a sparse ternary index vector drawn from its
hash; a known token's vector is its index vector plus the scaled sum of the
index vectors of its neighbours in a bounded sample (``max_rows`` labelled
documents, those with the smallest hashes).  Only the ``vocabulary`` most
frequent tokens get one.  Tokens are a text's words without the marks around
them, and for each word its shape (case, digits, marks at its end), so that new
words still say something.

A document is the mean of its tokens' vectors, the mean of its shapes' vectors
and the agreement of neighbouring tokens.  A two-layer numpy network is trained
on the sample; its temperature is fitted on a part kept out of training.

Vectors and network have a bounded size; only bounded sample rows and partial
sums of a fixed number of partitions reach the driver.  All documents are scored
in Arrow batches where they are read, without a shuffle, whole texts included.

Defined results: a null or empty text has a zero vector and is scored from
that; rows with null ids are scored and never trained on; contradicting labels
of one id count as low quality; every input row gets an output row; an empty
table gives an empty result; without training rows of both kinds all scores are
the share of good labels (0.5 without any); an input column ``score`` is
replaced, all others stay; equal texts have equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import stored
from tracelake.llm.folds import fold, sample_ids, sampled_texts

MARKS = ".,;:!?\"'()[]{}|#*$%&<>-_=+/\\~^`"
DIM = 48


def shape(word: str) -> str:
    """Case, digits and the marks at the end of a word; a mark in front keeps shapes apart from words."""
    core = word.rstrip(MARKS)
    kind = ("0" if any(c.isdigit() for c in core) else "") + ("" if not core else "A" if core.isupper() and len(core) > 1 else "Aa" if core[:1].isupper() else "a")
    size = "" if not core else "+" if len(core) > 12 else "-" if len(core) < 4 else "="
    return f"\x00{kind}{size}{word[len(core):][:4]}"


def token(word: str) -> str:
    return word.strip(MARKS).lower()


def index_vector(name: str, ones: int = 6) -> np.ndarray:
    """Sparse ternary vector from the token's hash."""
    rng = np.random.default_rng(xxhash.xxh64_intdigest(name))
    v = np.zeros(DIM, dtype=np.float32)
    v[rng.choice(DIM, ones, replace=False)] = rng.choice((-1.0, 1.0), ones)
    return v


class Pooler:
    """Texts to pooled vectors; keeps the ids of words it has seen, up to ``cache`` of them."""

    def __init__(self, vectors: dict[str, int], matrix: np.ndarray, cache: int = 200_000):
        self.vectors, self.matrix, self.cache = vectors, matrix, cache
        self.seen: dict[str, tuple[int, int]] = {}

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        seen, get = self.seen, self.vectors.get
        if len(seen) > self.cache:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = get(token(w), -1), get(shape(w), -1)
        both = np.array([seen[w] for w in words], dtype=np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def pool(self, text: str, chunk: int = 1 << 16) -> np.ndarray:
        words = text.split()
        total = np.zeros((2, DIM))
        count, repeats, n = np.zeros(2), 0, len(words)
        for at in range(0, n, chunk):
            part = words[at : at + chunk]
            for k, ids in enumerate(self.ids(part)):
                hits = np.bincount(ids[ids >= 0], minlength=1)
                used = np.flatnonzero(hits)
                total[k] += hits[used] @ self.matrix[used] if len(used) else 0
                count[k] += len(ids[ids >= 0])
            repeats += sum(a == b for a, b in zip(part, part[1:], strict=False))
        mean = total / np.maximum(count, 1)[:, None]
        extra = (np.log1p(n) / 8, repeats / max(n, 1), count[0] / max(n, 1), count[1] / max(n, 1), len(set(words)) / max(n, 1), np.log1p(len(text)) / 10)
        return np.concatenate([mean.ravel(), np.linalg.norm(mean, axis=1), extra]).astype(np.float32)


FEATURES = 2 * DIM + 8


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 120, rate: float = 0.01, l2: float = 1e-3, batch: int = 256, seed: int = 7):
    """A two-layer network with balanced classes and a temperature from rows kept out; a function of standardized features."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    keep = order[: max(1, len(x) // 5)]
    fit = order[max(1, len(x) // 5) :]
    if len(set(y[fit].tolist())) < 2:
        fit = order
    mean, scale = x[fit].mean(0), x[fit].std(0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    params = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    share = y[fit].mean()
    weight = np.where(y == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
    step = 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for at in range(0, len(fit), batch):
            b = fit[at : at + batch]
            h = np.maximum(z[b] @ params[0] + params[1], 0)
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
            d = (p - y[b]) * weight[b] / len(b)
            dh = np.outer(d, params[2]) * (h > 0)
            grads = [z[b].T @ dh + l2 * params[0], dh.sum(0), h.T @ d + l2 * params[2], d.sum(keepdims=True)]
            step += 1
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                params[k] = params[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    logit = np.maximum(z[keep] @ params[0] + params[1], 0) @ params[2] + params[3]
    shift = np.log(max(share, 1e-6) / max(1 - share, 1e-6))  # undoes the balancing for the probabilities

    def loss(t: float) -> float:
        g = (logit + shift) / t
        return float(np.mean(np.logaddexp(0, g) - y[keep] * g))

    temperature = min(np.geomspace(0.25, 8, 41), key=loss)
    return mean, scale, params, shift, temperature


def probability(x: np.ndarray, network) -> np.ndarray:
    mean, scale, params, shift, temperature = network
    z = np.clip((x - mean) / scale, -8, 8)
    logit = np.maximum(z @ params[0] + params[1], 0) @ params[2] + params[3]
    return 1 / (1 + np.exp(-np.clip((logit + shift) / temperature, -500, 500)))


def _names(text: str) -> list[str]:
    return [x for w in text.split() for x in (token(w), shape(w)) if x]


def word_vectors(texts: DataFrame, vocabulary: int, window: int = 2) -> tuple[dict[str, int], np.ndarray]:
    """Random-indexing vectors of the most frequent tokens and shapes of a bounded sample ``(text, ...)``."""

    def counted(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(set(_names(t))) for t in batch.column(0).to_pylist()], pa.list_(pa.string()))], ["names"])

    counts = texts.select("text").mapInArrow(counted, "names array<string>").select(F.explode("names").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    names = [r["w"] for r in counts.where("n >= 3").orderBy(F.desc("n"), "w").limit(vocabulary).collect()]
    vectors = {w: i for i, w in enumerate(names)}

    def summed(batches):
        base = np.array([index_vector(w) for w in names], dtype=np.float32).reshape(-1, DIM)
        total = np.zeros_like(base)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = text.split()
                for name in (token, shape):
                    ids = np.array([i for w in words if (i := vectors.get(name(w), -1)) >= 0], dtype=np.int64)
                    for k in range(1, window + 1):
                        if len(ids) > k:
                            np.add.at(total, ids[k:], base[ids[:-k]])
                            np.add.at(total, ids[:-k], base[ids[k:]])
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f4").tobytes()], pa.binary())], ["total"])

    parts = texts.select("text").mapInArrow(summed, "total binary").collect()  # one row for each of a fixed number of partitions
    context = np.zeros((len(names), DIM), dtype=np.float32)
    for r in parts:
        context += np.frombuffer(r["total"], dtype="<f4").reshape(-1, DIM)
    context /= np.linalg.norm(context, axis=1, keepdims=True) + 1e-6
    base = np.array([index_vector(w) for w in names], dtype=np.float32).reshape(-1, DIM)
    return vectors, base + 2 * context


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 4,
    held_out: int = 2,
    max_rows: int = 12_000,
    vocabulary: int = 8192,
):
    """The model: word vectors and network, or the share of good labels where both kinds aren't there."""
    known = labels.where((fold(id_col, folds) != held_out) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(id_col).agg(F.min(label_col).alias("y"))
    ids = stored(sample_ids(known, max_rows, id_col).join(known.withColumnRenamed(id_col, "id"), "id"), "quality-sample")
    texts = stored(sampled_texts(docs, ids, id_col, text_col).select("text", "y"), "quality-texts").repartition(8)
    seen = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not seen.get(0) or not seen.get(1):
        total = sum(seen.values())
        return (seen.get(1, 0) / total) if total else 0.5
    vectors, matrix = word_vectors(texts, vocabulary)

    def pooled(batches):
        pooler = Pooler(vectors, matrix)
        for batch in batches:
            rows = [pooler.pool(t).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], ["x", "y"])

    rows = texts.mapInArrow(pooled, "x binary, y int").collect()  # at most max_rows
    rows.sort(key=lambda r: (bytes(r["x"]), r["y"]))
    x = np.array([np.frombuffer(r["x"], dtype=np.float32) for r in rows], dtype=float)
    return vectors, matrix, fit_network(x, np.array([r["y"] for r in rows], dtype=float))


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, 0 to 1."""
    docs = docs.drop("score")
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    if isinstance(model, float):
        return docs.withColumn("score", F.lit(model))

    def run(batches):
        pooler = Pooler(*model[:2])
        for batch in batches:
            x = np.array([pooler.pool(t.as_py() or "") for t in batch.column(at)], dtype=float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probability(x, model[2]), pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
