"""What the llm operators share: shared storage, staged tables, batches, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codefacts.llm import tokens

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. On one machine a folder of our own will do; a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="codefacts-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        at = _OWN[app]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and safe against lost executors."""
    path = shared_path(df.sparkSession, label)
    # small row groups: what a writer holds of wide rows stays small
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage, for small tables in loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when a scan has fewer partitions than the cluster has cores (small inputs only).

    Plans with a shuffle are left alone: counting their partitions would run them.
    """
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of the rows that no model may learn from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 5 == 0, F.lit(False))


def given_back() -> None:
    """Freed memory back to the system: Arrow's and the allocator's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc can
        ctypes.CDLL(None).malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that only some rows are Python objects at a time; at the end freed memory is given back.

    Workers outlive their tasks: unless ``keep``, vocabularies that an earlier task loaded are given up first.
    """
    if not keep and tokens._LOADED:
        tokens.forget()
        given_back()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    batch = None
    given_back()


def chunks(texts: list[str], limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` characters each, one text at least."""
    at = size = 0
    for i, text in enumerate(texts):
        if i > at and size + len(text) > limit:
            yield at, i
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)


def annotated(docs: DataFrame, of: Callable[[], Callable[[list[str]], dict[str, list]]], new: str, text: str = "text", size: int = 2_000_000) -> DataFrame:
    """docs with new columns (a DDL string) computed from its texts; columns of those names are replaced.

    ``of`` is called once in each task and gives a function from texts (null: empty) to columns.
    No shuffle, and rows stay whole.
    """
    added = StructType.fromDDL(new)
    kept = [f for f in docs.schema.fields if f.name not in added.names]
    at = [f.name for f in kept].index(text) if text in [f.name for f in kept] else -1
    d = docs if at >= 0 else docs.withColumn("__text", F.col(text))
    source = spread(d.select(*[F.col(f"`{f.name}`") for f in kept], *([] if at >= 0 else ["__text"])))
    names = [*(f.name for f in kept), *added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = of()
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(at if at >= 0 else batch.num_columns - 1).to_pylist()]
            for a, b in chunks(texts, size):
                got = work(texts[a:b])
                old = [c.slice(a, b - a) for c in batch.columns[: len(kept)]]
                yield pa.RecordBatch.from_arrays([*old, *(pa.array(got[n], _ARROW[added[n].dataType.simpleString()]) for n in added.names)], names=names)

    return source.mapInArrow(run, StructType([*kept, *added.fields]))


_ARROW = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is the least node reachable.

    Each round maps a node to that of itself, its neighbours and theirs whose hash of the round is
    least, and contracts the edges along that map: a star is done in one round, and as the order is
    random, paths and trees of any numbering shrink by a constant share. The maps compose backwards
    to one root for each component, whose least member is then named. Nothing is collected: the
    rounds end when no edge is left.
    """
    e = checkpointed(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    maps: list[DataFrame] = []
    while not e.isEmpty():
        turn = F.lit(len(maps))
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", turn), "b")).alias("m"))
        own = F.struct(F.xxhash64("a", turn), F.col("a").alias("b"))
        least = checkpointed(least.select(F.col("a").alias("b"), F.least(own, "m").alias("m")))
        least = checkpointed(both.join(least, "b").groupBy("a").agg(F.min("m").alias("m")).select(F.col("a").alias("node"), F.col("m")["b"].alias("to")))
        maps.append(least)
        e = checkpointed(
            e.join(least.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
            .join(least.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
            .where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .distinct()
        )
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    found = maps.pop()
    while maps:
        up = maps.pop()
        found = checkpointed(
            up.join(found.select(F.col("node").alias("to"), F.col("to").alias("root")), "to", "left").select("node", F.coalesce("root", "to").alias("to"))
        )
    named = checkpointed(found.groupBy("to").agg(F.min("node").alias("component")))
    return found.join(named, "to").select("node", "component")
