"""Concatenate and cut: documents packed into fixed windows of tokens.

Two passes. The first encodes every text once and writes the ids with their place in the
partition; partition totals (one number for each task of the first pass) are summed to
prefix offsets. The second adds the offset and cuts each document at multiples of the
window, so pieces need no shuffle, no sort and no state between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import chunks, sliced, spread, staged
from codefacts.llm.tokens import bpe

TOKENS = "part int, doc_id {id}, start long, n long, ids binary"
PIECES = "doc_id {id}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def encoded(docs: DataFrame, tokenizer: str, end_id: int | None = 2, text: str = "text", doc_id: str = "doc_id", short: bool = False) -> DataFrame:
    """(part, doc_id, start, n, ids) of every row: ids little-endian 32-bit, ``start`` its place in its partition.

    With ``short``, ids below 65,536 are stored in 16 bits where all ids of a document are. A null text is empty. Equal rows are separate documents. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, start, part = bpe(tokenizer), 0, TaskContext.get().partitionId()
        tail = b"" if end_id is None else end_id.to_bytes(4, "little")
        for batch in sliced(batches, keep=True):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts, 4_000_000):
                ids = [x + tail for x in model.encode(texts[a:b])]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                if short:
                    ids = [y.astype("<u2").tobytes() if len(y) and y.max() < 1 << 16 else x for x, y in ((x, np.frombuffer(x, dtype="<u4")) for x in ids)]
                first = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array([part] * (b - a), pa.int32()), batch.column(0).slice(a, b - a), pa.array(first), pa.array(n), pa.array(ids, pa.binary())], names=["part", "doc_id", "start", "n", "ids"])

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return spread(d).mapInArrow(run, TOKENS.format(id=d.schema["doc_id"].dataType.simpleString()))


def packed(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int | None = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces of all documents in gapless sequences of ``length`` ids; only the last sequence can be short.

    Columns: doc_id, start (ids of its document before it), length, doc_tokens, sequence_id,
    offset (in its sequence), ids (little-endian 32-bit). An empty table gives no pieces; a
    document without ids (only where end_id is None) gives none either.
    """
    t = staged(encoded(docs, tokenizer, end_id, text, doc_id, short=True), "tokens")
    # one row for each task that wrote: bounded by the number of input partitions
    totals = {r.part: r.n for r in t.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    base, at = {}, 0
    for part in sorted(totals):
        base[part], at = at, at + totals[part]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, keep=True):
            first = np.array([base[p] for p in batch.column(0).to_pylist()], dtype=np.int64) + batch.column(2).to_numpy()
            n = batch.column(3).to_numpy()
            pieces = np.where(n > 0, (first + n - 1) // length - first // length + 1, 0)
            row = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.maximum((first[row] // length + k) * length, first[row])
            end = np.minimum((first[row] // length + k + 1) * length, first[row] + n[row])
            start = begin - first[row]
            raw = [x if len(x) == 4 * m else np.frombuffer(x, dtype="<u2").astype("<u4").tobytes() for x, m in zip(batch.column(4).to_pylist(), n.tolist(), strict=True)]
            body = [raw[i][4 * s : 4 * (s + m)] for i, s, m in zip(row.tolist(), start.tolist(), (end - begin).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(row)), pa.array(start), pa.array(end - begin), pa.array(n[row]), pa.array(begin // length), pa.array(begin % length), pa.array(body, pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return t.mapInArrow(cut, PIECES.format(id=t.schema["doc_id"].dataType.simpleString()))


def padded_length(n: int, length: int = 4096) -> int:
    """Ids that a sequence of n occupies: n itself at a power of two, else the whole window."""
    return n if n & (n - 1) == 0 else length


def boundaries(pieces: DataFrame) -> DataFrame:
    """One record for each sequence: its documents in order with their offsets (at most one window of them)."""
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length"))).alias("pieces"))
