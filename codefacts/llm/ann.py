"""Nearest neighbours by inner product: anisotropic product quantisation, table scans, exact reranking.

Each vector becomes 4-bit codes, one for every two dimensions. Codes and codebooks minimise a
score-aware loss: the part of the residual parallel to the vector, which shifts large inner
products, weighs more than the orthogonal part. A query turns its products with the codewords
into tables, two codes to a byte, and scans all candidates of a shard by looking bytes up; the
best of the scan are ranked again by exact products. Query blocks meet every shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codefacts.llm.common import staged
from codefacts.llm.vectors import groups, matrix, sample, usable

SAMPLE = 8192  # vectors that the codebooks are fitted on
SHARD = 8192  # candidates in a shard
BLOCK = 2048  # queries in a block
SHORT = 400  # candidates of a shard that are ranked exactly
THRESHOLD = 0.2  # the share of the norm from which a product counts as large


class Quantiser:
    """Codebooks (subspaces, 16, 2) and the weight of parallel residuals over orthogonal ones."""

    def __init__(self, books: np.ndarray, eta: float) -> None:
        self.books, self.eta = books, eta

    @classmethod
    def fit(cls, x: np.ndarray, rounds: int = 8, threshold: float = THRESHOLD) -> Quantiser:
        x = _even(x)
        d = x.shape[1]
        eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
        rng = np.random.default_rng(0)
        q = cls(x[rng.choice(len(x), 16, replace=len(x) < 16)].reshape(16, -1, 2).transpose(1, 0, 2).copy(), eta)
        for _ in range(rounds):
            q._update(x, q.encode(x))
        return q

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(codes.shape[1])[None, :], codes].reshape(len(codes), -1)

    def encode(self, x: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes by nearest codeword, then coordinate descent on the score-aware loss."""
        x = _even(x)
        s = len(self.books)
        parts = x.reshape(len(x), s, 2)
        codes = np.empty((len(x), s), dtype=np.int64)
        for m in range(s):
            codes[:, m] = ((parts[:, m, None, :] - self.books[m][None]) ** 2).sum(axis=2).argmin(axis=1)
        norm = np.maximum((x * x).sum(axis=1), 1e-30)
        along = (x * (x - self.decode(codes))).sum(axis=1)  # the residual's product with the vector
        for _ in range(passes):
            for m in range(s):
                r = parts[:, m, None, :] - self.books[m][None]
                own = (parts[:, m, None, :] * r).sum(axis=2)
                rest = along - own[np.arange(len(x)), codes[:, m]]
                loss = (r * r).sum(axis=2) + (self.eta - 1) * (rest[:, None] + own) ** 2 / norm[:, None]
                codes[:, m] = loss.argmin(axis=1)
                along = rest + own[np.arange(len(x)), codes[:, m]]
        return codes

    def _update(self, x: np.ndarray, codes: np.ndarray) -> None:
        """The best codewords for given codes, one subspace after the other."""
        s = len(self.books)
        parts = x.reshape(len(x), s, 2)
        weight = (self.eta - 1) / np.maximum((x * x).sum(axis=1), 1e-30)
        along = (x * (x - self.decode(codes))).sum(axis=1)
        for m in range(s):
            p, k = parts[:, m], codes[:, m]
            rest = along - (p * (p - self.books[m][k])).sum(axis=1)
            # loss of c: |p - c|^2 + weight (rest + p.(p - c))^2
            goal = p + (weight * (rest + (p * p).sum(axis=1)))[:, None] * p
            left = np.zeros((16, 2, 2))
            right = np.zeros((16, 2))
            np.add.at(left, k, np.eye(2)[None] + weight[:, None, None] * p[:, :, None] * p[:, None, :])
            np.add.at(right, k, goal)
            used = np.bincount(k, minlength=16) > 0
            self.books[m][used] = np.linalg.solve(left[used], right[used][:, :, None])[:, :, 0]
            along = rest + (p * (p - self.books[m][k])).sum(axis=1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256): the sum of two codewords' products for each byte."""
        one = np.einsum("qsd,skd->qsk", _even(queries).reshape(len(queries), -1, 2), self.books)
        if one.shape[1] % 2:
            one = np.concatenate([one, np.zeros_like(one[:, :1])], axis=1)
        return (one[:, 0::2, None, :] + one[:, 1::2, :, None]).reshape(len(queries), -1, 256).astype(np.float32)


def _even(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.zeros((len(x), 1))], axis=1) if x.shape[1] % 2 else x


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes to a byte, a row for each byte place."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros_like(codes[:, :1])], axis=1)
    return (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8).T.copy()


def search_shard(q: Quantiser | None, queries: np.ndarray, x: np.ndarray, keep: np.ndarray, own: np.ndarray, top: int, short: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, candidates, exact products) of the best candidates for each query; keep: candidates' ids, own: the queries'. Without a quantiser all are ranked exactly."""
    if q is None:
        for i, asked in enumerate(queries):
            exact = (x * asked).sum(axis=1)
            order = np.lexsort((keep, -exact))
            order = order[keep[order] != own[i]][:top]
            yield i, order, exact[order]
        return
    codes = packed(q.encode(x))
    for a in range(0, len(queries), 64):
        tables = q.tables(queries[a : a + 64])
        for i, t in enumerate(tables):
            s = t[0][codes[0]]
            for j in range(1, len(codes)):
                s += t[j][codes[j]]
            best = np.argpartition(-s, short)[: short + 1] if len(s) > short + 1 else np.arange(len(s))
            best = best[keep[best] != own[a + i]]
            exact = (x[best] * queries[a + i]).sum(axis=1)
            order = np.lexsort((keep[best], -exact))[:top]
            yield a + i, best[order], exact[order]


def nearest(table: DataFrame, top: int = 20, every: int = 20, vector: str = "embedding", vec_id: str = "vec_id", shard: int = SHARD, block: int = BLOCK, short: int = SHORT) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` candidates of largest inner product for each query.

    Queries are the rows whose vec_id is divisible by ``every``; rows with a query's own vec_id are
    none of its candidates. Vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor do rows without vec_id. Vectors meet only those of their own length; those of
    another length than the sample's most common one are scanned exactly. Of equal vectors, those of the top + 1 least vec_ids are scanned: no other can be in a
    result. Repeated vec_ids with equal vectors count once. Ties go to the smaller vec_id.
    """
    spark = table.sparkSession
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(usable("v") & F.col("vec_id").isNotNull())
    model_on = sample(rows, "v", SAMPLE)
    kind = "query_id long, vec_id long, score double"
    if not len(model_on):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    q = Quantiser.fit(model_on)
    dims = model_on.shape[1]
    rows = staged(rows.dropDuplicates(["vec_id", "v"]).withColumn("d", F.size("v")), "vectors")
    copies = Window.partitionBy("v").orderBy("vec_id")
    least = rows.withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= top + 1)
    wanted = rows.where(F.col("vec_id") % every == 0)
    n, m = rows.count(), wanted.count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-m // block))
    # a shard's rows go to each block of queries, a block's queries to each shard
    candidates = least.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(0).alias("side"), "vec_id", "v", "d")
    asked = wanted.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("b"), F.lit(1).alias("side"), "vec_id", "v", "d")
    units = candidates.unionByName(asked).select("d", "s", "b", "side", "vec_id", "v").repartition("d", "s", "b").sortWithinPartitions("d", "s", "b", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 3):
            side, ids = g.column(3).to_numpy(), g.column(4).to_numpy()
            if not (side == 0).any() or not (side == 1).any():
                continue
            v = matrix(g.column(5))
            x, asked_ = v[side == 0], v[side == 1]
            keep, own = ids[side == 0], ids[side == 1]
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for i, best, exact in search_shard(q if v.shape[1] == dims else None, asked_, x, keep, own, top, short):
                out.append((np.full(len(best), own[i]), keep[best], exact))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(3)], names=["query_id", "vec_id", "score"])

    found = units.mapInArrow(run, kind).dropDuplicates(["query_id", "vec_id", "score"])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
