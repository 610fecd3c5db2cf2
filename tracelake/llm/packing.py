"""Packing by vector bin packing with the dot-product heuristic.

An example needs tokens, one segment and some loss-bearing tokens; a sequence
has a limit on each.  A sequence is filled with the example whose need has the
largest dot product with what the sequence has left, each scaled by its limit.
Where ``cut`` is set and nothing fits whole, the longest example is cut to fill
the rest, so that sequences are full unless the segment or loss limit closes
them.  What is left at a task's end becomes sequences of powers of two, which
need no padding.

Rows are packed where they are read: no shuffle, a buffer of ``buffer``
examples a task, and a task that runs again gives the same sequences.

Defined results: a null text is an empty text, which is the closing id alone;
every input row is a document of its own, repeated rows and null ids included;
an empty table gives an empty result; a text of any length is cut as needed;
other input columns are not returned.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import stored

END_ID = 0
LEAST_SEGMENTS = 4  # of a segment limit that follows the examples' lengths


def load_encoding(path: str):
    """A byte-level BPE vocabulary file (JSON) as a tiktoken encoding with equal ids.

    The ids of such a vocabulary follow its merges, so they serve as ranks; that
    is checked here.  The file's special tokens are matched in texts, as the
    tokenizers library does.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    vocab = spec["model"]["vocab"]
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    if merged != sorted(merged):
        raise ValueError("the ids of this vocabulary don't follow its merges")
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def _is_plain(spec: dict) -> bool:
    """Whether a tokenizer file asks for nothing but byte-level BPE with its usual pattern."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    off = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    return bool(plain and model["type"] == "BPE" and not spec.get("normalizer") and not any(model.get(k) for k in off))


def tokenized(path: str) -> Callable[[str], np.ndarray]:
    """Text to its ids and the closing id.

    The ids are those of ``tokenizers.Tokenizer.from_file(path)``; a plain
    byte-level file is encoded by a faster library with equal ids.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if _is_plain(spec):
        encoding = load_encoding(path)
        return lambda text: np.append(encoding.encode_to_numpy(text, allowed_special="all"), END_ID).astype("<u4")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: np.append(tokenizer.encode(text, add_special_tokens=False).ids, END_ID).astype("<u4")


class Packer:
    """Fills sequences from a buffer of examples; ``add`` and ``finish`` give lists of (key, start, stop) a sequence."""

    def __init__(self, max_tokens: int, max_segments: int | None, max_loss: int, cut: bool = True, buffer: int = 512):
        self.limits = np.array([max_tokens, max_segments or LEAST_SEGMENTS, max_loss], dtype=float)
        self.by_length = max_segments is None
        self.max_tokens, self.cut, self.buffer = max_tokens, cut, buffer
        self.keys: list = []
        self.need = np.zeros((0, 3))  # tokens, segments and loss-bearing tokens of what is left of each example
        self.start = np.zeros(0, dtype=np.int64)

    def add(self, items: list[tuple[object, int, int]]) -> Iterator[list[tuple[object, int, int]]]:
        """items: (key, tokens, loss-bearing tokens). Without ``cut``, one beyond a limit gets a sequence of its own."""
        if not self.cut:
            wide = [(t > self.limits[0] or x > self.limits[2]) for _, t, x in items]
            for (key, tokens, _), alone in zip(items, wide, strict=True):
                if alone:
                    yield [(key, 0, tokens)]
            items = [x for x, alone in zip(items, wide, strict=True) if not alone]
        self.keys += [k for k, _, _ in items]
        self.need = np.vstack([self.need, np.array([[t, 1, x] for _, t, x in items], dtype=float).reshape(-1, 3)])
        self.start = np.append(self.start, np.zeros(len(items), dtype=np.int64))
        while len(self.keys) > self.buffer and self.need[:, 0].sum() >= self.max_tokens:
            yield self._fill(self.max_tokens)

    def finish(self) -> Iterator[list[tuple[object, int, int]]]:
        while self.keys:
            left = int(self.need[:, 0].sum())
            size = self.max_tokens
            if self.cut and left < size:
                size = 1 << (left.bit_length() - 1)
            yield self._fill(size)

    def _fill(self, size: int) -> list[tuple[object, int, int]]:
        if self.by_length:  # twice what examples of the buffer's mean length need to fill a sequence
            self.limits[1] = max(LEAST_SEGMENTS, 2 * np.ceil(self.max_tokens * len(self.need) / max(1.0, self.need[:, 0].sum())))
        room = self.limits.copy()
        room[0] = size
        out, gone = [], []
        need = self.need.copy()
        while room[0] >= 1 and room[1] >= 1:
            fits = (need <= room).all(axis=1)
            exact = self.cut and room[1] == 1  # the last segment: fill the rest if anything can
            if fits.any() and not (exact and (need[:, 0] > room[0]).any()):
                k = int(np.where(fits, (np.where(fits[:, None], need, 0.0) / self.limits) @ (room / self.limits), -1.0).argmax())
                take = int(need[k, 0])
            elif self.cut and len(need) and np.isfinite(need[:, 0]).any():
                k = int(np.where(np.isfinite(need[:, 0]), need[:, 0], -1.0).argmax())
                per_token = need[k, 2] / need[k, 0]
                take = int(min(need[k, 0], room[0], room[2] // per_token if per_token else room[0]))
                if take < 1:
                    break
            else:
                break
            share = need[k, 2] * take / need[k, 0]
            out.append((self.keys[k], int(self.start[k]), int(self.start[k]) + take))
            room -= (take, 1, share)
            if take == need[k, 0]:
                gone.append(k)
                need[k] = np.inf
            else:
                self.start[k] += take
                need[k, 0] -= take
                need[k, 2] -= share
        if not out:
            raise ValueError("the limits leave no room for any token")
        keep = np.isfinite(need[:, 0])
        self.need, self.start = need[keep], self.start[keep]
        if gone:
            dropped = set(gone)
            self.keys = [x for i, x in enumerate(self.keys) if i not in dropped]
        return out


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_tokens: int = 1024,
    max_segments: int | None = None,
    max_loss: int = 1024,
    buffer: int = 512,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece of a document.

    All ids of a document bear loss but the closing one, which is counted as a
    token only; so of documents packed by themselves the segment limit binds, the
    loss limit is as wide as the token limit, and ``conversation_packing`` is where
    all three differ.  Without ``max_segments`` the segment limit follows the mean
    length of the buffered documents (twice what these need, 4 at least), so short
    documents fill their sequences.  ``vocabulary`` is a path that every executor has.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids

    def run(batches):
        encode = tokenized(vocabulary)
        packer = Packer(max_tokens, max_segments, max_loss, True, buffer)
        held: dict[int, list] = {}  # ids of the documents that have tokens in the buffer
        sequence, row = TaskContext.get().partitionId() << 40, 0

        def rows(sequences):
            nonlocal sequence
            columns: list[list] = [[] for _ in range(7 + with_ids)]
            for pieces in sequences:
                offset = 0
                for key, a, b in pieces:
                    doc, ids, left = held[key]
                    part = ids[a:b]
                    values = (doc, a, b - a, zlib.crc32(part.tobytes()), len(ids), sequence, offset, *([part.tolist()] if with_ids else []))
                    for c, v in zip(columns, values, strict=True):
                        c.append(v)
                    offset += b - a
                    if left == b - a:
                        del held[key]
                    else:
                        held[key][2] = left - (b - a)
                sequence += 1
            return columns

        def batch_of(columns, id_type):
            types = [id_type, *[pa.int64()] * 6] + [pa.list_(pa.int64())] * with_ids
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 128):
                part, items = batch.slice(at, 128), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = encode(text.as_py() or "")
                    held[row] = [doc, ids, len(ids)]
                    items.append((row, len(ids), len(ids) - 1))
                    row += 1
                columns = rows(packer.add(items))
                if columns[0]:
                    yield batch_of(columns, id_type)
        if id_type is not None:
            columns = rows(packer.finish())
            if columns[0]:
                yield batch_of(columns, id_type)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pack_examples(
    examples: DataFrame, id_col: str, tokens_col: str, loss_col: str, max_tokens: int, max_segments: int, max_loss: int, buffer: int = 512
) -> DataFrame:
    """Packs whole examples, never cut, under all three limits: ``(id_col, sequence_id, offset)``.

    An example that is beyond a limit by itself gets a sequence of its own.
    """
    kind = examples.schema[id_col].dataType.simpleString()

    def run(batches):
        packer = Packer(max_tokens, max_segments, max_loss, False, buffer)
        sequence, id_type, held, row = TaskContext.get().partitionId() << 40, None, {}, 0

        def out(sequences):
            nonlocal sequence
            ids, seqs, offsets = [], [], []
            for pieces in sequences:
                offset = 0
                for key, a, b in pieces:
                    ids.append(held.pop(key))
                    seqs.append(sequence)
                    offsets.append(offset)
                    offset += b - a
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(seqs, pa.int64()), pa.array(offsets, pa.int64())], [id_col, "sequence_id", "offset"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            items = []
            for doc, tokens, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[row] = doc
                items.append((row, tokens or 0, loss or 0))
                row += 1
            yield out(packer.add(items))
        if id_type is not None:
            yield out(packer.finish())

    return examples.select(id_col, tokens_col, loss_col).mapInArrow(run, f"{id_col} {kind}, sequence_id long, offset long")


def turn_tokens(turns: DataFrame, vocabulary: str, text_col: str = "text", role_col: str = "role", loss_role: str = "assistant") -> DataFrame:
    """``turns`` without the text, with ``tokens`` (a closing id included) and ``loss``, the tokens of turns of ``loss_role``."""
    kept = [c for c in turns.columns if c not in (text_col, "tokens", "loss")]
    schema = ", ".join(f"`{c}` {turns.schema[c].dataType.simpleString()}" for c in kept) + ", tokens long, loss long"

    def run(batches):
        encode = tokenized(vocabulary)
        for batch in batches:
            sizes = np.array([len(encode(t.as_py() or "")) for t in batch.column(text_col)], dtype=np.int64)
            bears = np.array([r == loss_role for r in batch.column(role_col).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sizes), pa.array(sizes * bears)], [*kept, "tokens", "loss"])

    return turns.mapInArrow(run, schema)


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations, whose assistant turns bear loss, in sequences of at most 4096 tokens, 6 segments and 3072 loss-bearing tokens."""
    import public_tokenizers

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "role", "text")
    sized = turn_tokens(turns, public_tokenizers.path("byte_bpe_50k.json"))
    examples = stored(sized.groupBy("conv_id").agg(F.sum("tokens").alias("tokens"), F.sum("loss").alias("loss")), "conversation-sizes")
    packed = pack_examples(examples, "conv_id", "tokens", "loss", 4096, 6, 3072)
    return packed.join(examples, "conv_id").select("conv_id", "tokens", "loss", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
