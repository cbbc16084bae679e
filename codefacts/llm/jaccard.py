"""Near copies by exact Jaccard similarity of word shingles or equal SimHash bits, with MinHash bands to propose them.

Two texts of similarity s agree on one band of ROWS minima with probability s**ROWS, so with
BANDS bands a pair at 0.8 is missed with probability 1.3e-7, and a closer one less often. What
a band brings together is decided by its sets of 64-bit shingle hashes, never by the sketch.
Members of a bucket are linked by a spanning forest, never by all pairs, and buckets of many or
long texts are cut into pieces of which every two meet in one task. The first bands join most
near copies; the others then look only at buckets whose members are not of one component yet.
SimHash links of few bits count too: they join long texts with scattered edits below 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.llm import simhash
from codefacts.llm.common import checkpointed, components, sliced, spread, staged

SEED = 42
ROWS, BANDS = 5, 40
FIRST = 8  # bands of the first wave
SHARD, SHINGLES = 2048, 1 << 20  # members and shingles of a piece of a bucket
STEP = 2048  # shingles sketched at once
SALTS = 16  # ways in which the nodes of a component are dealt
_RANDOM = np.random.default_rng(SEED).integers(0, 1 << 64, (2, ROWS * BANDS, 1), dtype=np.uint64)
_XOR, _ODD = _RANDOM[0], _RANDOM[1] | np.uint64(1)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct XXH64 values of the word shingles, as ``simhash.fingerprint`` makes them; empty without a word."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) <= width:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    parts = [words[k : len(words) - width + 1 + k] for k in range(width)]
    return np.unique(np.fromiter((xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*parts, strict=True))), np.uint64, len(parts[0])))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set that is not empty, one for each band of ROWS minima."""
    least = None
    for at in range(0, len(hashes), STEP):
        m = ((hashes[at : at + STEP] ^ _XOR) * _ODD).min(axis=1)
        least = m if least is None else np.minimum(least, m)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Is the Jaccard similarity of two sorted sets ``least`` or more?"""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < least * len(b):
        return False
    both = np.count_nonzero(b.take(np.searchsorted(b, a), mode="clip") == a)
    return bool(both >= least * (len(a) + len(b) - both) - 1e-9)


def bucket_links(sets: list[np.ndarray], known: list[int], least: float) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of places, of the links between members that ``known`` puts in different components.

    A member is compared with those of a component until one is similar, the last that was first.
    """
    groups: dict[int, list[int]] = {}
    out: list[tuple[int, int]] = []
    home: dict[int, int] = {}  # known component: its group

    def top(g: int) -> int:
        while home.get(g, g) != g:
            g = home[g]
        return g

    for i, s in enumerate(sets):
        mine = top(known[i])
        for g in list(groups):
            if g == mine or g not in groups:
                continue
            for at in range(len(groups[g]) - 1, -1, -1):
                j = groups[g][at]
                if similar(s, sets[j], least):
                    out.append((j, i))
                    groups[g].append(groups[g].pop(at))
                    home[mine] = g
                    groups[g] = groups.pop(mine, []) + groups[g]
                    mine = g
                    break
        groups.setdefault(mine, []).append(i)
    return out


def _sketched(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_hash, size, digest, keys, fp) of every row; texts with the same set have the same digest."""
    from xxhash import xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(2).to_pylist()
            found = [shingles(t, width) for t in texts]
            fps = np.array([simhash.fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            keys = [band_keys(s) if len(s) else None for s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in found], pa.int64()), pa.array([xxh3_128_digest(s.tobytes()) for s in found], pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(fps)],
                names=["doc_id", "text_hash", "size", "digest", "keys", "fp"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return spread(docs).mapInArrow(run, f"doc_id {kind}, text_hash string, size long, digest binary, keys array<long>, fp long")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, hashes) of rows of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [shingles(t, width).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "hashes"])

    return docs.select("node", "text").mapInArrow(run, "node long, hashes binary")


def _members(nodes: DataFrame, first: int, end: int) -> DataFrame:
    """(node, component, size, key, pieces, piece) in the buckets of bands ``first`` to ``end`` that hold more than one component."""
    keyed = nodes.select("node", "component", "size", F.explode(F.slice("keys", first + 1, end - first)).alias("key"))
    sums = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("all"), F.min("component").alias("low"), F.max("component").alias("high"))
    open_ = checkpointed(sums.where("low <> high").select(F.col("key").alias("shared"), F.ceil(F.greatest(F.col("n") / SHARD, F.col("all") / SHINGLES)).cast("int").alias("pieces")))
    return keyed.join(open_, F.col("key") == F.col("shared")).drop("shared").withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))


def _links(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b) of a spanning forest in every bucket."""
    # a piece meets itself and every other piece once
    unit = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda q: F.least(F.col("piece"), q) * F.col("pieces") + F.greatest(F.col("piece"), q))
    dealt = members.select("node", "component", "key", F.explode(unit).alias("unit")).join(sets, "node")
    dealt = dealt.select("node", "component", "key", "unit", "hashes").repartition("key", "unit").sortWithinPartitions("key", "unit", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last, pairs = None, []

        def close() -> list[tuple]:
            if len(held) < 2:
                return []
            return [(held[i][0], held[j][0]) for i, j in bucket_links([h[2] for h in held], [h[1] for h in held], least)]

        for batch in sliced(batches):
            for node, component, key, unit_, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, unit_) != last:
                    pairs += close()
                    held, last = [], (key, unit_)
                held.append((node, component, np.frombuffer(hashes, dtype=np.uint64)))
            if len(pairs) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], names=["a", "b"])
                pairs = []
        pairs += close()
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _joined(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with the components that the new edges (a, b) join made one.

    Only edges between components are left to contract, so a wave's rounds follow what it adds. A
    component may hold a third of all nodes: its new name is looked up through SALTS copies.
    """
    of = nodes.select("node", "component")
    ends = edges.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    # (staged, not checkpointed: a checkpoint keeps its plan's constraints, which grow with each round)
    found = components(staged(ends.where("ca <> cb").select("ca", "cb"), "near-edges"), "ca", "cb").toDF("old", "to").where("old <> to").withColumn("salt", salts)
    salted = nodes.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    named = salted.join(found, (F.col("component") == F.col("old")) & (F.col("part") == F.col("salt")), "left")
    return staged(named.withColumn("component", F.coalesce("to", "component")).select(*nodes.columns), "near-nodes")


def near_copies(docs: DataFrame, least: float = 0.8, width: int = 5, bits: int = 3) -> DataFrame:
    """(doc_id, text_hash, digest, component) of every row of (doc_id, text); text_hash is the text's MD5.

    component names the rows reachable over links of Jaccard similarity ``least`` or more between
    sets of ``width``-word shingles (fewer words are one shingle), or of SimHash fingerprints that
    differ in at most ``bits``. Null and blank texts have the empty set and are alike; rows with a
    null doc_id link like any other.
    """
    d = docs.select("doc_id", F.md5("text").alias("text_hash"), "text")
    own = checkpointed(_sketched(d, width))
    # a node is a distinct set; the text of one of its rows stands for it
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("row")
    grouped = own.groupBy("digest").agg(first, F.first("size").alias("size"), F.first("keys").alias("keys"))
    nodes = checkpointed(grouped.withColumn("node", F.xxhash64("digest")))
    by_fp = checkpointed(own.groupBy("fp").agg(F.min(F.xxhash64("digest")).alias("node")))
    same_fp = own.select(F.xxhash64("digest").alias("a"), "fp").distinct().join(by_fp, "fp").select("a", F.col("node").alias("b"))
    nodes = _joined(nodes.withColumn("component", F.col("node")), staged(simhash.links(by_fp, bits).unionByName(same_fp), "near-edges"))
    for first_band, end in ((0, FIRST), (FIRST, BANDS)):
        members = checkpointed(_members(nodes, first_band, end))
        rows = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "row.doc_id", "row.text_hash").toDF("node", "of", "hash")
        texts = d.join(rows, F.col("doc_id").eqNullSafe(F.col("of")) & F.col("text_hash").eqNullSafe(F.col("hash"))).dropDuplicates(["node"])
        nodes = _joined(nodes, staged(_links(members, checkpointed(_sets(texts, width)), least), "near-edges"))
    return own.select("doc_id", "text_hash", "digest").join(nodes.select("digest", "component"), "digest")
