"""BPE encoding and decoding of whole texts by speculation and verification (see tokens.py)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import chunks, sliced, spread
from codefacts.llm.tokens import bpe


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for every row: ids little-endian 32-bit, decoded the text they give.

    A null text is empty: no ids, an empty decoded text. With ``digests`` the last two columns
    are ids_sha256 and decoded_sha256 instead, computed where the ids are, so that they need
    not cross to the JVM. Rows are independent: no shuffle.
    """
    import hashlib

    last = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(tokenizer)
        for batch in sliced(batches, keep=True):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts, 4_000_000):
                ids = model.encode(texts[a:b])
                back = [model.decode(np.frombuffer(x, dtype="<u4")) for x in ids]
                one: list = ids
                two: list = back
                if digests:
                    one = [hashlib.sha256(x).hexdigest() for x in ids]
                    two = [hashlib.sha256(x.encode()).hexdigest() for x in back]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(one, pa.string() if digests else pa.binary()), pa.array(two, pa.string())], names=["doc_id", "n_tokens", *last])

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return spread(d).mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens long, {last[0]} {'string' if digests else 'binary'}, {last[1]} string")
