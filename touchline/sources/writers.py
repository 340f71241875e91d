"""Snapshot writers."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.constants import SNAPSHOT_COLUMNS
from touchline.operators.schema import keep_present
from touchline.schemas import PREDICTIONS
from touchline.session import shared_dir
from touchline.sources.readers import MANIFEST, VERSIONS, published_versions, snapshot_path


def refresh_stamp() -> Column:
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return F.date_format(now, "yyyy-MM-dd HH:mm:ss 'UTC'")


def declared(df: DataFrame, schema: T.StructType = PREDICTIONS) -> DataFrame:
    """Columns that the schema names in its types; others as they are."""
    return df.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in schema.fields if f.name in df.columns})


def _version() -> str:
    """A name that sorts after all earlier ones."""
    return f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def _declare(spark: SparkSession, folder: str, periods: Sequence[int], version: str) -> None:
    """Make a version of periods the one that counts: one small file, which appears as a whole."""
    rows = spark.createDataFrame([(period, version) for period in periods], "gameweek int, version string")
    rows.coalesce(1).write.mode("append").parquet(f"{folder}/{MANIFEST}")


def publish(df: DataFrame, folder: str, order: Sequence[Column] = ()) -> None:
    """Replace the periods that ``df`` holds (column ``gameweek``) in a published table.

    The rows are a new version in a folder of its own, and a row of the manifest then makes it the one that counts, for all of its
    periods at once. Other periods stay. Nothing is deleted or changed: readers keep the version they began with, a job that
    fails leaves a version that never counts, and running it again gives the same rows. ``superseded`` lists what may go.
    """
    spark, version = df.sparkSession, _version()
    laid_out = df.withColumn("gameweek", F.col("gameweek").cast("int"))
    laid_out = laid_out.orderBy("gameweek", *order) if order else laid_out
    path = f"{folder}/{VERSIONS}/version={version}"
    laid_out.write.partitionBy("gameweek").parquet(path)
    written = spark.read.schema(laid_out.schema).parquet(path).select("gameweek").distinct()
    periods = [row[0] for row in written.collect()]  # one value per period
    if periods:
        _declare(spark, folder, sorted(periods), version)


def publish_period(df: DataFrame, folder: str, period: int) -> None:
    """The same for rows of one period, which are written in the order they have."""
    version = _version()
    df.drop("gameweek").write.parquet(f"{folder}/{VERSIONS}/version={version}/gameweek={period}")
    _declare(df.sparkSession, folder, [period], version)


def superseded(spark: SparkSession, folder: str) -> DataFrame:
    """(gameweek, path) of the versions that count no more, for the retention of the store to remove."""
    old = published_versions(spark, folder).where(~F.col("current"))
    return old.select("gameweek", F.concat(F.lit(f"{folder}/{VERSIONS}/version="), "version", F.lit("/gameweek="), "gameweek").alias("path"))


def in_order(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows sorted once for several writes: a checkpoint in the shared folder keeps partitions and their order."""
    shared_dir(df.sparkSession)
    return df.orderBy(*order).checkpoint()


def export_csv(df: DataFrame, folder: str, period: int, order: Sequence[Column] = ()) -> str:
    """CSV snapshot of one period in the fixed column order, and the key after it; the name carries the period."""
    path = snapshot_path(folder, period)
    ordered = df.orderBy(*order) if order else df
    keep_present(ordered, [*SNAPSHOT_COLUMNS, "id"]).write.mode("overwrite").option("header", True).csv(path)
    return path


def stamp(spark: SparkSession, folder: str) -> None:
    """Note the time of refresh. The newest rows are the published table's largest period; they are not copied."""
    spark.range(1).select(refresh_stamp().alias("last_updated")).write.mode("append").parquet(f"{folder}/stamps")


def response_records(df: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def response_metadata(total: DataFrame, matching: DataFrame, period: int, file: str, limit: int = 0) -> DataFrame:
    """One row of counts beside the records; the records themselves are never gathered into it."""
    shown_rows = matching.agg(F.count(F.lit(1))).scalar()
    if limit > 0:
        shown_rows = F.least(shown_rows, F.lit(limit).cast("long"))
    return total.agg(F.count(F.lit(1)).alias("total_players")).select(
        F.lit(period).alias("gameweek"),
        F.lit(file).alias("csv_file"),
        "total_players",
        shown_rows.alias("filtered_players"),
        refresh_stamp().alias("last_updated"),
    )


def chunked(df: DataFrame, key: str, rows_per_chunk: int) -> DataFrame:
    """Rows packed as arrays (``items``) of about ``rows_per_chunk``; a hash keeps the arrays even.

    Each item carries its place among all rows as ``pos``, unless it has one. The hash is of key and place, so a key that
    repeats does not fill one array. Counting reads ``df`` once more, so stage one that is costly to compute.
    """
    if "pos" not in df.columns:
        df = df.withColumn("pos", F.monotonically_increasing_id())
    chunks = df.agg(F.greatest(F.ceil(F.count(F.lit(1)) / rows_per_chunk), F.lit(1))).scalar()
    number = F.pmod(F.xxhash64(key, "pos"), chunks)
    packed = df.select(number.alias("_chunk"), F.struct("*").alias("_row")).groupBy("_chunk")
    return packed.agg(F.collect_list("_row").alias("items"))


def write_envelopes(df: DataFrame, path: str, array: str, key: str = "id", rows_per_chunk: int = 500) -> None:
    """Land rows as snapshot documents, one per line, each with a bounded ``array``."""
    documents = chunked(df, key, rows_per_chunk).select(F.col("items").alias(array))
    documents.write.mode("append").json(path)


def write_root_arrays(df: DataFrame, path: str, key: str = "id", rows_per_chunk: int = 500) -> None:
    """Land rows as JSON arrays, one per line, each of bounded length."""
    chunked(df, key, rows_per_chunk).select(F.to_json("items")).write.mode("append").text(path)
