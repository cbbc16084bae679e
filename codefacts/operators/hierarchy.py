"""Closure of a hierarchy and resolution of members along it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codefacts.session import cut


def closure(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(child, ancestor, depth): semi-naive, one join of the newest pairs in each round, until none is new.

    A pair keeps its least depth, so cycles end. Rounds are cut by checkpoints and put together at the end.
    """
    base = edges.select(F.col(child).alias("child"), F.col(parent).alias("ancestor")).distinct().withColumn("depth", F.lit(1).cast("long"))
    step = base.select(F.col("child").alias("via"), F.col("ancestor").alias("up"))
    rounds = [cut(base)]
    while True:
        known = reduce(DataFrame.unionByName, rounds)
        new = cut(
            rounds[-1].join(step, F.col("ancestor") == F.col("via")).select("child", F.col("up").alias("ancestor")).distinct()
            .join(known, ["child", "ancestor"], "left_anti").withColumn("depth", F.lit(len(rounds) + 1).cast("long"))
        )
        if new.isEmpty():
            return known
        rounds.append(new)


def resolve(wanted: DataFrame, members: DataFrame, ancestors: DataFrame, ranks: list[str]) -> DataFrame:
    """For each (cls, name) the member found first.

    ancestors: (child, ancestor, depth, kind), with each class its own ancestor at depth 0. ranks: the
    kinds of edges from first to last, so methods, properties and constants differ in this list only.
    Concrete members come before abstract ones.
    """
    rank = F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col("kind"))
    found = wanted.join(ancestors, F.col("cls") == F.col("child")).join(members.withColumnRenamed("cls", "owner"), (F.col("ancestor") == F.col("owner")) & (F.lower("name") == F.lower("member")))
    w = Window.partitionBy("cls", "name").orderBy(F.col("is_abstract").cast("int"), rank, "depth", "owner")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
