"""Connected components of links, on Spark alone, and the cutting of long lineages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ROWS_PER_FILE = 50_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session without the setting gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="surco-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def kept(df: DataFrame, about: int | None = None) -> DataFrame:
    """The rows of `df`, computed once and checkpointed in the shared folder; with `about` so many rows, in files of some size."""
    sc = df.sparkSession.sparkContext
    if about is not None:
        df = df.coalesce(max(1, -(-about // ROWS_PER_FILE)))
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside goes to Python at most so many rows at a time; afterwards the session is as it was."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """The rows of `df`, read back from a table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/surco-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def stars(edges: DataFrame) -> DataFrame:
    """One round of large stars and small stars: every node comes nearer to the least of its component."""
    # Both ways come from one row each: unions of a side used twice would double the plan at every step.
    here, back = F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
    both = edges.select(F.inline(F.array(here, back)))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    down = large.distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    small = down.join(least, "u")
    to_least = F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))
    return small.select(F.inline(F.array(*to_least))).filter("u <> v").distinct()


def components(links: DataFrame, about: int | None = None, most: int = 40) -> DataFrame:
    """`node, component` for every node of `links(u, v)`; the component is its least node.

    `about` is the expected number of links, if known. Nulls and links of a node with itself are dropped. A component of d steps
    across takes about log d rounds; two are done before rows are kept.
    """
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    marks = F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))
    edges = kept(edges, about)
    before = edges.agg(*marks).first()
    for _ in range(most):
        edges = kept(stars(stars(edges)), 2 * before[0])
        after = edges.agg(*marks).first()
        if after == before:
            break
        before = after
    else:
        raise ValueError(f"components did not settle in {most} rounds")
    low = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(low)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of a finished run from the shared folder."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
