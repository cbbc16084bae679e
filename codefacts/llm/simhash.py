"""SimHash near-duplicates: fingerprints of word shingles, linked through BK-trees of shards.

Fingerprints that differ in at most ``radius`` bits agree on at least two of ``radius + 2``
blocks of bits, so a shard holds the fingerprints that agree on one pair of blocks (about
25 bits), and each shard is searched by its own BK-tree: children are keyed by their integer
Hamming distance to the parent, and only edges within the radius of the query's distance are
followed. Shards with more than SHARD members are cut into pieces and every two pieces meet
in one tree of at most two pieces, so a task's memory is bounded whatever the data. Trees
report a spanning forest of the links they find, never all pairs; equal fingerprints are one
node from the start. Trees are dealt with their shards rather than broadcast, since the set of
fingerprints grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import checkpointed, components, sliced, spread

SHARD = 2048
STEP = 1 << 16  # shingles summed at once, so that a very long text needs bounded memory


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits, each 1 if set in over half the XXH64 (seed 42) values of the word shingles.

    A-Z are lower-cased, words part at ASCII white space; fewer than ``width`` words are one
    shingle, no word gives 0, repeats count.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxh64_intdigest(b" ".join(words), 42)
    n, ones = len(words) - width + 1, np.zeros(64, dtype=np.int64)
    for at in range(0, n, STEP):
        m = min(STEP, n - at)
        parts = [words[at + k : at + k + m] for k in range(width)]
        h = np.array([xxh64_intdigest(s, 42) for s in map(b" ".join, zip(*parts, strict=True))], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            got = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return spread(d).mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp long")


class BkTree:
    """A BK-tree over 64-bit fingerprints; each node knows its children by their distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at = 0
        while self.values:
            d = (value ^ self.values[at]).bit_count()
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = len(self.values)
                break
            at = nxt
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """Places of all nodes within the radius."""
        found, todo = [], [0] if self.values else []
        values, children = self.values, self.children
        while todo:
            at = todo.pop()
            d = (value ^ values[at]).bit_count()
            if d <= radius:
                found.append(at)
            for edge, child in children[at].items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among values, as pairs of places."""
    tree, root, out = BkTree(), list(range(len(values))), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, v in enumerate(values):
        mine = i
        for j in tree.within(v, radius):
            other = top(j)
            if other != mine:
                out.append((i, j))
                root[mine] = other
                mine = other
        tree.add(v)
    return out


def _bits(blocks: int) -> list[tuple[int, int]]:
    """(lowest bit, number of bits) of each block of the 64."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _shard_keys(fp: Column, radius: int) -> Column:
    """The shards of a fingerprint: one for each pair of blocks."""
    blocks = _bits(radius + 2)
    part = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << n) - 1)) for a, n in blocks]
    keys = []
    for k, (i, j) in enumerate(combinations(range(len(blocks)), 2)):
        keys.append(F.lit(k << 56).bitwiseOR(F.shiftleft(part[i], blocks[j][1])).bitwiseOR(part[j]))
    return F.array(*keys)


def links(nodes: DataFrame, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """(a, b) of a spanning forest in every shard, for nodes (node, fp) with distinct fp."""
    keyed = nodes.select("node", "fp", F.explode(_shard_keys(F.col("fp"), radius)).alias("key"))
    sizes = checkpointed(keyed.groupBy("key").count().where("count > 1").withColumnRenamed("key", "shared"))
    member = keyed.join(sizes, F.col("key") == F.col("shared")).withColumn("pieces", F.ceil(F.col("count") / shard).cast("int"))
    member = member.withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    # a piece meets itself and every other piece once
    unit = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda q: F.least(F.col("piece"), q) * F.col("pieces") + F.greatest(F.col("piece"), q))
    dealt = member.select("node", "fp", "key", F.explode(unit).alias("unit")).repartition("key", "unit").sortWithinPartitions("key", "unit", "fp")
    kind = nodes.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def out(pairs: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], types) for k in (0, 1)], names=["a", "b"])

        pairs: list[tuple] = []
        types = None
        for batch in batches:
            types = batch.schema.field(0).type
            for node, fp, key, unit_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, unit_) != last:
                    pairs += [(held[i][0], held[j][0]) for i, j in shard_links([h[1] for h in held], radius)] if len(held) > 1 else []
                    held, last = [], (key, unit_)
                held.append((node, fp & 0xFFFFFFFFFFFFFFFF))
            if len(pairs) > 10_000:
                yield out(pairs)
                pairs = []
        if len(held) > 1:
            pairs += [(held[i][0], held[j][0]) for i, j in shard_links([h[1] for h in held], radius)]
        if pairs:
            yield out(pairs)

    return dealt.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    component_id is the least doc_id reachable over links of at most ``radius`` differing bits,
    the row's own included. Null and blank texts have fingerprint 0 and link like any other;
    rows with a null doc_id get the component of the others with their fingerprint, null if
    there are none. Repeated rows are repeated in the result.
    """
    own = checkpointed(fingerprints(docs, text, doc_id, width))
    nodes = checkpointed(own.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(links(nodes.where("node is not null"), radius))
    named = checkpointed(
        nodes.join(found, "node", "left").select(F.col("fp").alias("of"), F.coalesce("component", "node").alias("component_id"))
    )
    joined = own.join(named, F.col("fp") == F.col("of"), "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
