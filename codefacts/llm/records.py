"""Length-delimited binary records of token ids, with an offset index for shuffled reads.

A record is framed as: length (8 bytes, little-endian), masked CRC-32C of those bytes, the
payload, masked CRC-32C of the payload. The payload is a header (doc_id present, doc_id,
bytes in an id, number of ids) and the ids. Each data file has an index file of (offset,
payload length) pairs, 16 bytes a record, so that a reader can visit records in any order.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.llm.common import chunks, shared_path, sliced, staged
from codefacts.llm.storage import open_read, open_write
from codefacts.llm.tokens import bpe

HEAD = "<BqBI"
BLOCK = 64
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    """CRC-32C of each byte at each place of a block, and the effect of 64 * 2**k zero bytes on a CRC."""
    if not _TABLES:
        t = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1).astype(np.uint32)
        place = np.empty((BLOCK, 256), dtype=np.uint32)
        place[BLOCK - 1] = t
        for i in range(BLOCK - 2, -1, -1):
            place[i] = t[place[i + 1] & 0xFF] ^ (place[i + 1] >> 8)
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        one = bits.copy()
        for _ in range(BLOCK):
            one = t[one & 0xFF] ^ (one >> 8)
        init = np.full(BLOCK, 0xFFFFFFFF, dtype=np.uint32)  # the starting value after so many zero bytes
        for i in range(1, BLOCK):
            init[i] = t[init[i - 1] & 0xFF] ^ (init[i - 1] >> 8)
        _TABLES.update(place=place, init=init)
        for k in range(40):
            # four tables: the shifted CRC is the XOR of one entry for each of its bytes
            tab = np.zeros((4, 256), dtype=np.uint32)
            for byte in range(4):
                for bit in range(8):
                    tab[byte, (np.arange(256) >> bit & 1).astype(bool)] ^= one[8 * byte + bit]
            _TABLES[f"shift{k}"] = tab
            one = _shift(one, tab)
    return _TABLES


def _shift(crc: np.ndarray, tab: np.ndarray) -> np.ndarray:
    parts = crc.astype("<u4").view(np.uint8).reshape(-1, 4)
    return tab[0].take(parts[:, 0], mode="wrap") ^ tab[1].take(parts[:, 1], mode="wrap") ^ tab[2].take(parts[:, 2], mode="wrap") ^ tab[3].take(parts[:, 3], mode="wrap")


def crc32c(items: list[bytes]) -> np.ndarray:
    """CRC-32C (Castagnoli) of each item, all at once.

    Items are cut into blocks (zeros before the first change nothing), whose CRCs are looked up
    place by place; a block's share of the item's CRC is its own, shifted by the blocks after it.
    """
    t = _tables()
    n = np.array([len(x) for x in items], dtype=np.int64)
    blocks = np.maximum(-(-n // BLOCK), 1)
    pads = [bytes(BLOCK)[: k] for k in (blocks * BLOCK - n).tolist()]
    grid = np.frombuffer(b"".join([y for x in zip(pads, items, strict=True) for y in x]), dtype=np.uint8).reshape(-1, BLOCK).T.copy()
    own = np.zeros(grid.shape[1], dtype=np.uint32)
    for i in range(BLOCK):
        own ^= t["place"][i].take(grid[i], mode="wrap")
    ends = np.cumsum(blocks)
    own = _shifted(own, np.repeat(ends, blocks) - np.arange(len(own)) - 1)
    start = _shifted(t["init"][n % BLOCK], n // BLOCK)
    return np.bitwise_xor.reduceat(own, ends - blocks) ^ start ^ np.uint32(0xFFFFFFFF)


def _shifted(crc: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Each CRC after so many blocks of zeros."""
    t, k = _tables(), 0
    while (blocks >> k).any():
        at = np.flatnonzero(blocks >> k & 1)
        crc[at] = _shift(crc[at], t[f"shift{k}"])
        k += 1
    return crc


def masked(items: list[bytes]) -> np.ndarray:
    """The checksums of frames: rotated and offset, so that framed CRCs don't cancel in a CRC over them."""
    c = crc32c(items)
    return (c >> np.uint32(15) | c << np.uint32(17)) + np.uint32(0xA282EAD8)


def frames(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    one, two = (masked(x).astype("<u4").tobytes() for x in (heads, payloads))
    return [b"".join([h, one[4 * i : 4 * i + 4], p, two[4 * i : 4 * i + 4]]) for i, (h, p) in enumerate(zip(heads, payloads, strict=True))]


def unframes(records: list[bytes]) -> list[bytes]:
    """The payloads of framed records; ValueError if a length or checksum is wrong."""
    heads, payloads = [r[:8] for r in records], [r[12:-4] for r in records]
    one, two = (masked(x).astype("<u4").tobytes() for x in (heads, payloads))
    for i, (r, h, p) in enumerate(zip(records, heads, payloads, strict=True)):
        if struct.unpack("<Q", h)[0] != len(p) or r[8:12] != one[4 * i : 4 * i + 4] or r[-4:] != two[4 * i : 4 * i + 4]:
            raise ValueError("damaged record")
    return payloads


def write_records(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write all rows in ascending doc_id order (null first; of equal ones the least hash of the text first) below path; return the manifest.

    The manifest (file_no, data, index, n_records, n_tokens) has one row for each file, and
    names only files of tasks that succeeded: a repeated task writes files of another name.
    Ids take two bytes where the vocabulary allows it. Null texts are empty documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part = bpe(tokenizer), TaskContext.get().partitionId()
        width = 2 if len(model.lengths) <= 1 << 16 and (end_id or 0) < 1 << 16 else 4
        name = f"{path}/part-{part:06d}-{uuid.uuid4().hex[:12]}"
        records = tokens = at = 0
        tail = b"" if end_id is None else end_id.to_bytes(4, "little")
        data = index = None
        for batch in sliced(batches, keep=True):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            keys = batch.column(0).to_pylist()
            for a, b in chunks(texts, 4_000_000):
                if data is None:
                    data, index = open_write(f"{name}.rec"), open_write(f"{name}.idx")
                payloads, places = [], []
                for key, ids in zip(keys[a:b], model.encode(texts[a:b]), strict=True):
                    ids += tail
                    n = len(ids) // 4
                    body = np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes() if width == 2 else ids
                    payloads.append(struct.pack(HEAD, key is not None, key or 0, width, n) + body)
                    places += [at, len(payloads[-1])]
                    at, records, tokens = at + len(payloads[-1]) + 16, records + 1, tokens + n
                data.write(b"".join(frames(payloads)))
                index.write(np.array(places, dtype="<u8").tobytes())
        if data is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_pylist([{"file_no": part, "data": f"{name}.rec", "index": f"{name}.idx", "n_records": records, "n_tokens": tokens}], schema=pa.schema([("file_no", pa.int32()), ("data", pa.string()), ("index", pa.string()), ("n_records", pa.int64()), ("n_tokens", pa.int64())]))

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return staged(ordered.mapInArrow(run, "file_no int, data string, index string, n_records long, n_tokens long"), "manifest")


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every record, read by the offset index and verified.

    start counts the ids of all records before it, in file order. The manifest has a row for
    each file, so what the driver holds follows the number of files, not of records.
    """
    files = sorted(map(tuple, manifest.select("file_no", "data", "index", "n_tokens").collect()))
    base, at = [], 0
    for f in files:
        base.append(at)
        at += f[3]
    paths = [(f[1], f[2]) for f in files]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                data, index = paths[i]
                with open_read(index) as f:
                    places = np.frombuffer(f.read(), dtype="<u8").reshape(-1, 2).astype(np.int64).tolist()
                start, held, size = base[i], [], 0
                with open_read(data) as f:
                    for k, (offset, n) in enumerate(places):
                        f.seek(offset)
                        held.append(f.read(n + 16))
                        size += n
                        if size < 8_000_000 and k < len(places) - 1:
                            continue
                        rows = []
                        for payload in unframes(held):
                            known, key, width, m = struct.unpack_from(HEAD, payload)
                            ids = payload[struct.calcsize(HEAD) :]
                            if width == 2:
                                ids = np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()
                            rows.append((key if known else None, start, m, ids))
                            start += m
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "n_tokens", "ids"])
                        held, size = [], 0

    return spark.range(0, len(paths), 1, max(1, len(paths))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_records(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int | None = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write the records of docs (below path, or the shared folder) and read them back."""
    spark = docs.sparkSession
    return read_records(spark, write_records(docs, tokenizer, path or shared_path(spark, "records"), end_id, text, doc_id))
