"""Files that arrive in a directory, checked batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codefacts.operators import checks, facts
from codefacts.sources.files import decoded

BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, directory: str, sink: str, checkpoint: str, pattern: str = "*.php", once: bool = False) -> StreamingQuery:
    """Findings on single nodes of each new file, appended to the Parquet table ``sink``.

    Each file is one row of one micro-batch and its findings depend on nothing else, so there is no
    state and no watermark; the checkpoint makes every file count once.
    """
    raw = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", pattern).load(directory)
    files = raw.select("path", decoded(F.col("content")).alias("content"))
    found: DataFrame = checks.run(facts.nodes(files))
    writer = found.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
