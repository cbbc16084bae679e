"""Embedding near-duplicates by PCA-ordered tiles.

Vectors are rotated so that the first components hold most of their energy (a rotation keeps
inner products; it is fitted on a bounded sample and decides speed only). Vectors of a label
are dealt into cells of the first component - links cross at most two cells - and cells into
tiles of bounded size. For each two tiles that can hold links, products accumulate over the
leading dimensions; the rest is bounded by the product of the suffix norms, and a pair whose
bound is below the threshold is dropped. What is left is decided on the vectors themselves in
double precision. A tile pair reports, for each vector, its number of links and one vector that
it is connected with, never the pairs. Equal vectors of a label are one node with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import components, staged
from codefacts.llm.vectors import groups, matrix, sample, usable

TILE = 1024
SAMPLE = 4096
LEADING = (8, 16, 32)


def rotation(vectors: np.ndarray) -> np.ndarray:
    """Columns: directions in order of falling energy."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.linalg.eigh(unit.T @ unit)[1][:, ::-1].copy()


def tile_links(a: np.ndarray, b: np.ndarray, turn: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rows of a and b have a cosine of at least ``threshold``."""
    ua, ub = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (a, b))
    ra, rb = ua @ turn, ub @ turn
    tail = [np.sqrt(np.maximum(1.0 - np.cumsum(r * r, axis=1), 0.0)) for r in (ra, rb)]
    rows, cols = np.arange(len(a)), np.arange(len(b))
    product, alive, done = np.zeros((len(a), len(b))), None, 0
    for k in (*(k for k in LEADING if k < a.shape[1]), a.shape[1]):
        product += ra[rows, done:k] @ rb[cols, done:k].T
        done = k
        if k == a.shape[1]:
            break
        bound = product + np.outer(tail[0][rows, k - 1], tail[1][cols, k - 1])
        alive = bound >= threshold - 1e-9
        keep_r, keep_c = alive.any(axis=1), alive.any(axis=0)
        rows, cols = rows[keep_r], cols[keep_c]
        product = product[np.ix_(keep_r, keep_c)]
        if not len(rows):
            break
    out = np.zeros((len(a), len(b)), dtype=bool)
    if len(rows):
        exact = (a[rows] @ b[cols].T) / np.outer(np.linalg.norm(a[rows], axis=1), np.linalg.norm(b[cols], axis=1))
        out[np.ix_(rows, cols)] = exact >= threshold
    return out


def roots(linked: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For the rows and columns of a link matrix, the least index of their component (columns follow the rows; ``same``: they are the rows)."""
    m, n = linked.shape
    r, c = np.arange(m), np.arange(n) + (0 if same else m)
    far = m + n
    while True:
        c2 = np.minimum(c, np.where(linked, r[:, None], far).min(axis=0))
        r2 = np.minimum(r, np.where(linked, c2[None, :], far).min(axis=1))
        if same:
            c2 = r2 = np.minimum(r2, c2)
        if (r2 == r).all() and (c2 == c).all():
            return r, c
        r, c = r2, c2


def near_duplicates(table: DataFrame, threshold: float = 0.93, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Only vectors with equal labels (not null) and lengths are compared. Rows whose vector is null,
    empty, zero or has null or non-finite components, or whose label or vec_id is null, link with
    nothing: n_links 0, component_id their own vec_id. Equal vectors link like any others. Rows that
    share a vec_id pool their links.
    """
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    rows = rows.withColumn("ok", usable("v") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    # -0.0 equals 0.0
    rows = rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0).cast("float")).otherwise(x)))
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v")})
    nodes = staged(
        rows.where("ok").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"), F.first("v").alias("v")).withColumn("d", F.size("v")),
        "nodes",
    )
    vectors = sample(nodes, "v", SAMPLE)
    turn = rotation(vectors) if len(vectors) else np.eye(1)
    d = turn.shape[0]
    reach = float(np.sqrt(2.0 - 2.0 * threshold)) / 2.0
    first = turn[:, 0].tolist()
    # place in steps of half the largest distance of a link along the first direction; other lengths: one cell
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    along = F.aggregate(F.zip_with("v", F.array(*[F.lit(x) for x in first]), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    celled = nodes.withColumn("cell", F.when(F.col("d") == d, F.floor(along / norm / reach)).otherwise(F.lit(0)).cast("int"))
    counts = staged(celled.groupBy("label", "d", "cell").count().withColumn("tiles", F.ceil(F.col("count") / tile).cast("int")), "cells").select("label", "d", "cell", "tiles")
    around = counts.groupBy("label", "d").agg(F.map_from_entries(F.collect_list(F.struct("cell", "tiles"))).alias("of"))
    # cells of a label are at most 2 / reach, so the map is small; each row meets the tiles of the cells in reach
    dealt = celled.join(around, ["label", "d"]).withColumn("mine", F.pmod(F.hash("h1", F.lit(1)), F.col("of")[F.col("cell")]).cast("int"))

    def partner(step: int) -> Column:
        other = F.col("cell") + step
        every = F.when(F.col("of")[other].isNotNull(), F.sequence(F.lit(0), F.col("of")[other] - 1)).otherwise(F.array().cast("array<int>"))
        if step > 0:
            return F.transform(every, lambda t: F.struct(F.col("cell").alias("c1"), F.col("mine").alias("t1"), other.alias("c2"), t.alias("t2"), F.lit(0).alias("side")))
        if step < 0:
            return F.transform(every, lambda t: F.struct(other.alias("c1"), t.alias("t1"), F.col("cell").alias("c2"), F.col("mine").alias("t2"), F.lit(1).alias("side")))
        return F.transform(every, lambda t: F.struct(other.alias("c1"), F.least(t, "mine").alias("t1"), other.alias("c2"), F.greatest(t, "mine").alias("t2"), (t < F.col("mine")).cast("int").alias("side")))

    units = dealt.select("label", "d", "node", "n", "v", F.explode(F.concat(*[partner(s) for s in (-2, -1, 0, 1, 2)])).alias("u")).select("label", "d", "u.*", "node", "n", "v")
    keys = ["label", "d", "c1", "t1", "c2", "t2"]
    units = units.repartition(*keys).sortWithinPartitions(*keys, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, len(keys)):
            side, node, n = (g.column(i).to_numpy() for i in (6, 7, 8))
            if len(node) < 2:
                continue
            v = matrix(g.column(9))
            one = side == 0
            same = g.column(2)[0] == g.column(4)[0] and g.column(3)[0] == g.column(5)[0]
            two = one if same else ~one
            if not one.any() or not two.any():
                continue
            basis = turn if v.shape[1] == d else np.eye(v.shape[1])
            linked = tile_links(v[one], v[two], basis, threshold)
            if same:
                np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            every = node[one] if same else np.concatenate([node[one], node[two]])
            r, c = roots(linked, same)
            counted = linked @ n[two] if same else np.concatenate([linked @ n[two], n[one] @ linked])
            root = r if same else np.concatenate([r, c])
            hit = counted > 0
            yield pa.RecordBatch.from_arrays([pa.array(every[hit]), pa.array(counted[hit].astype(np.int64)), pa.array(every[root[hit]])], names=["node", "links", "root"])

    found = staged(units.mapInArrow(run, "node long, links long, root long"), "links")
    member = components(found, "node", "root")
    total = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("label", "h1", "h2", "node", "n").join(total, "node", "left").join(member, "node", "left")
    named = staged(known.select(F.col("label").alias("l"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "node").alias("component")), "named")
    out = rows.join(named, F.col("ok") & (F.col("label") == F.col("l")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
