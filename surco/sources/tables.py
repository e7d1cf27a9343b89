"""Reading and writing fact tables, dimensions and data files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import zero_to_null
from ..functions.fixed_values import PHASE_COLUMNS
from ..session import settings
from . import schemas

# Days that a task has open at once when it writes rows in order.
OPEN_FILES = 8


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, table: str, split_on: str | None = None,
              lower: int = 0, upper: int = 0, parts: int = 1, **options) -> DataFrame:
    """A relational table; `split_on` reads it in parallel ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if split_on:
        reader = (
            reader.option("partitionColumn", split_on)
            .option("lowerBound", lower)
            .option("upperBound", upper)
            .option("numPartitions", parts)
        )
    return reader.load()


def parcel_dimension(parcels: DataFrame) -> DataFrame:
    """Parcel attributes by id; a latitude, longitude or area of 0 counts as unknown."""
    return parcels.select(
        F.col("id").cast("string").alias("entity_id"),
        "parcela_id", "cultivo", "variedad", "provincia", "municipio",
        *[zero_to_null(F.col(c).cast("double")).alias(c) for c in ("lat", "lng", "superficie")],
    )


def safe_zones(places: DataFrame, place_links: DataFrame) -> DataFrame:
    """Zones of every victim; both keys are trimmed before they meet."""
    places = places.withColumn("id_place", F.trim(F.col("id_place").cast("string")))
    links = place_links.select(
        F.trim(F.col("id_place").cast("string")).alias("id_place"),
        F.trim(F.col("id_victima").cast("string")).alias("id_victima"),
    )
    return places.join(links, "id_place").select(
        "id_victima", "id_place", "place_name", "place_coordinates",
        F.col("radius").cast("double").alias("radius"),
    )


# ---- data files -----------------------------------------------------------

def crop_reference(spark: SparkSession, path: str) -> DataFrame:
    """(cultivo, fase, kc) rows of a JSON file holding one object per crop."""
    whole = spark.read.text(path, wholetext=True)
    crops = whole.select(
        F.explode(F.from_json("value", schemas.CROP_REFERENCE)).alias("cultivo", "ref")
    )
    return melt_coefficients(crops.select("cultivo", "ref.*"))


def melt_coefficients(crops: DataFrame) -> DataFrame:
    """One row per crop and phase out of one coefficient column per phase."""
    phases = F.array(
        *[F.struct(F.lit(p).alias("fase"), F.col(c).cast("double").alias("kc")) for p, c in PHASE_COLUMNS.items()]
    )
    return crops.select("cultivo", F.inline(phases)).filter(F.col("kc").isNotNull())


def coefficient_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = "cultivo string, fase string, kc double, descripcion string"
    return spark.read.schema(schema).option("header", True).csv(path)


def parcel_config(spark: SparkSession, path: str) -> DataFrame:
    """Parcels of a JSON file holding one object per parcel."""
    value = (
        "map<string,struct<ref_catastral:string,subparcela:string,municipio:string,provincia:string,"
        "comunidad:string,cultivo:string,superficie_ha:double,superficie_total_parcela_ha:double,"
        "regadio:boolean,lat:double,lon:double,notas:string>>"
    )
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", value)).alias("parcela_id", "p")).select("parcela_id", "p.*")


def daily_series_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DAILY_SERIES).option("header", True).csv(path)


def device_states(spark: SparkSession, path: str) -> DataFrame:
    """Landed device snapshots (JSON arrays or lines)."""
    return spark.read.schema(schemas.DEVICE_STATES).option("multiLine", True).json(path)


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """PDF files below `docs/`: path, size and time only, the contents stay unread."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.pdf")
        .option("recursiveFileLookup", True)
        .load(f"{folder.rstrip('/')}/docs")
    )
    return files.select(
        F.col("path").alias("doc_path"),
        F.round(F.col("length") / 1024, 1).alias("size_kb"),
        F.col("modificationTime").alias("updated_at"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


# ---- fact tables ----------------------------------------------------------

def _same_layout(df: DataFrame, stored: T.StructType, extra: set[str]) -> list[str]:
    have = {f.name: f.dataType for f in df.schema}
    want = {f.name: f.dataType for f in stored if f.name not in extra}
    return sorted(n for n in have.keys() | want.keys() if have.get(n) != want.get(n))


def append_facts(df: DataFrame, path: str, key: str, time_col: str = "timestamp",
                 create: bool = True, batch: int | None = None, dealt: bool = False,
                 ordered: bool = False) -> None:
    """Append rows as day partitions, clustered by `key` inside each file.

    `create=False` wants the table to exist with the same columns. A `batch`
    number makes a repeated write replace its own earlier attempt, so that a
    streaming batch that is run again leaves no duplicates. Rows that lie by day
    and key already, as `dealt` says, are not dealt out again, and those that
    are `ordered` by day, key and time within their partition are not sorted.
    """
    spark = df.sparkSession
    if not create:
        try:
            stored = spark.read.parquet(path).schema
        except AnalysisException as missing:
            raise ValueError(f"table {path} does not exist") from missing
        differing = _same_layout(df, stored, {"fecha", "lote"})
        if differing:
            raise ValueError(f"columns differ from the table: {', '.join(differing)}")
    # Adaptive execution cuts a hot day or key into several files and merges small ones.
    rows = df.withColumn("fecha", F.to_date(time_col))
    if not dealt:
        rows = rows.hint("rebalance", "fecha", key)
    if not ordered:
        rows = rows.sortWithinPartitions("fecha", key, time_col)
    to, mode = (path, "append") if batch is None else (f"{path.rstrip('/')}/lote={batch}", "overwrite")
    # Without some files open at once, Spark sorts what it cannot see to be in order; beyond them it sorts the rest.
    with settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES)} if ordered else {}):
        rows.write.mode(mode).partitionBy("fecha").parquet(to)
