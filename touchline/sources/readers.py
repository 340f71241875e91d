"""Snapshot readers."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.numbers import period_in_name, whole_number
from touchline.operators.filters import NoRowsError
from touchline.schemas import ENVELOPE, EXPORTED, FIXTURE, PREDICTIONS, RESPONSE

POS = "pos"
#: Column of landed documents: time and path of the file.
LANDED = "_landed"


def read_envelopes(spark: SparkSession, path: str, one_per_line: bool = False, schema: T.StructType = ENVELOPE) -> DataFrame:
    """Snapshot documents. Files of one document per line can be split between tasks; whole documents cannot."""
    return spark.read.schema(positioned_arrays(schema)).option("multiLine", not one_per_line).json(path)


def array_rows(envelopes: DataFrame, array: str) -> DataFrame:
    """One row per array item, with an ordinal ``pos``.

    The ordinal is the item's own ``pos``, which the writers of landed documents give it, else its place in the array. It is
    total over all documents of one landing. Documents that carry ``LANDED``, the time and path of their file, put that first, so that an item of a
    later landing comes after all earlier ones.
    """
    landed = [LANDED] if LANDED in envelopes.columns else []
    exploded = envelopes.select(*landed, F.posexplode(array).alias("_at", "_item"))
    item = exploded.schema["_item"].dataType
    at = F.coalesce(F.col("_item.pos"), F.col("_at")) if POS in item.names else F.col("_at")
    pos = F.struct(F.col(LANDED), at.alias("at")) if landed else at
    return exploded.select(pos.alias(POS), *[F.col("_item")[name].alias(name) for name in item.names if name != POS])


def positioned(schema: T.StructType) -> T.StructType:
    """Schema of items that may carry their ordinal."""
    return schema if POS in schema.names else T.StructType([*schema.fields, T.StructField(POS, T.LongType())])


def positioned_arrays(schema: T.StructType) -> T.StructType:
    """Schema of documents whose items may carry their ordinal."""
    arrays = lambda f: isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)
    return T.StructType([T.StructField(f.name, T.ArrayType(positioned(f.dataType.elementType))) if arrays(f) else f for f in schema.fields])


def entities(envelopes: DataFrame) -> DataFrame:
    return array_rows(envelopes, "elements")


def teams(envelopes: DataFrame) -> DataFrame:
    return array_rows(envelopes, "teams")


def calendar(envelopes: DataFrame) -> DataFrame:
    return array_rows(envelopes, "events")


def read_fixtures(spark: SparkSession, path: str, one_per_line: bool = False, schema: T.StructType = FIXTURE) -> DataFrame:
    """Rows of files whose root is a JSON array, with their ordinal as ``pos``.

    By default a file is one array; ``one_per_line`` reads files with one array on each line, which can be split.
    """
    documents = spark.read.text(path, wholetext=not one_per_line)
    parsed = documents.select(F.from_json("value", T.ArrayType(positioned(schema))).alias("_items"))
    return array_rows(parsed, "_items")


#: Part files of one write are named alike and have one header.
_WRITE = r"([^/]*/)*part-\d+-([0-9a-f-]{36})[^/]*$"


@dataclass(frozen=True)
class Exports:
    """Files that share a header, or ``None`` for all files of what was asked for."""

    header: list[str]
    files: list[str] | None


def _exports(spark: SparkSession, path: str | list[str], options: dict) -> list[Exports]:
    """The files of a path or paths by their headers, in the order of the first file of each.

    Only names are listed, and the driver holds one row per file, as Spark's own listing does. Part files of one write have one header, so the
    smallest of them stands for all. Their first lines come from one job; without several writes one header is read.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "length", F.col("_metadata.file_path").alias("place")).where("length > 0")
    folder, write = F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.regexp_extract("path", _WRITE, 2)
    files = listed.select("path", "length", "place", F.when(write == "", F.col("path")).otherwise(F.concat(folder, F.lit("/"), write)).alias("write")).collect()
    by_write = defaultdict(list)
    for file in sorted(files):
        by_write[file["write"]].append(file)
    if len(by_write) < 2:
        header = spark.read.options(**options).csv(path).columns if files else []
        return [Exports(header, None)] if header else []
    chosen = {write: min(some, key=lambda f: (f["length"], f["path"])) for write, some in by_write.items()}
    lines = spark.read.text([f["path"] for f in chosen.values()]).select("value", F.col("_metadata.file_path").alias("place"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    first = F.min_by("value", F.struct("start", "row")).alias("line")
    line_of = {r["place"]: r["line"] for r in lines.where(F.trim("value") != "").groupBy("place").agg(first).collect()}
    by_line: dict[str, list[str]] = {}
    for write, file in chosen.items():
        if file["place"] in line_of:
            by_line.setdefault(line_of[file["place"]].rstrip("\r"), []).extend(f["path"] for f in by_write[write])
    return [Exports(spark.read.options(**options).csv(some[0]).columns, some) for some in by_line.values()]


def _merged_types(schemas: list[T.StructType]) -> dict[str, T.DataType]:
    """A type for each name: the only one, double for different numbers, else text."""
    merged: dict[str, T.DataType] = {}
    for field in (f for schema in schemas for f in schema.fields):
        kind = T.StringType() if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType, T.TimeType)) else field.dataType
        known = merged.setdefault(field.name, kind)
        if known != kind:
            merged[field.name] = T.DoubleType() if isinstance(known, T.NumericType) and isinstance(kind, T.NumericType) else T.StringType()
    return merged


def read_predictions(spark: SparkSession, path: str | list[str], infer: bool = False) -> DataFrame:
    """CSV snapshots with headers, of one path or several; blank lines are dropped and an empty cell is missing.

    Columns are taken by the names in the header of each file, in the declared types, so files may have different columns in
    different orders; declared columns that a file lacks are missing in its rows, and others follow as text. A whole number may be written
    with a fraction of 0. ``infer`` looks at the values instead of the declared schema, for numbers and booleans
    only: a text such as ``T10`` would otherwise be taken for a time.
    """
    options = {"header": True, "mode": "PERMISSIVE"}
    exports = _exports(spark, path, options)
    places = [path if e.files is None else e.files for e in exports]
    if infer:
        found = [spark.read.options(inferSchema=True, **options).csv(place).schema for place in places]
        types = _merged_types(found)
        parts = [spark.read.options(**options).schema(T.StructType([T.StructField(f.name, types[f.name]) for f in schema])).csv(place) for schema, place in zip(found, places, strict=True)]
        return _union(parts) if parts else spark.createDataFrame([], T.StructType([]))
    declared = {f.name: f.dataType for f in EXPORTED.fields}

    def part(header: list[str], place: str | list[str]) -> DataFrame:
        in_file = lambda name: T.StringType() if isinstance(declared.get(name), T.LongType) else declared.get(name, T.StringType())
        rows = spark.read.options(**options).schema(T.StructType([T.StructField(name, in_file(name)) for name in header])).csv(place)
        typed = lambda name: whole_number(F.col(name)) if isinstance(declared.get(name), T.LongType) else F.col(name)
        return rows.select(*[typed(name).alias(name) for name in header])

    parts = [part(e.header, place) for e, place in zip(exports, places, strict=True)]
    parts = parts or [spark.createDataFrame([], T.StructType([]))]
    together = _union(parts)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in PREDICTIONS.fields if f.name not in together.columns}
    further = [name for name in together.columns if name not in PREDICTIONS.names]
    return together.withColumns(missing).select(*PREDICTIONS.names, *further)


def _union(parts: list[DataFrame]) -> DataFrame:
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part, allowMissingColumns=True)
    return together


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder; nothing in it is read."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def latest_period(spark: SparkSession, folder: str) -> int | None:
    """Largest period among ``gameweek_<n>_predictions.csv`` files or folders, by number; None without any.

    Only the names of the files are read, as a Spark listing, never their content.
    """
    try:
        names = spark.read.format("binaryFile").load(f"{folder}/gameweek_*_predictions.csv").select("path")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return names.agg(F.max(period_in_name(F.col("path")))).first()[0]


def snapshot_path(folder: str, period: int) -> str:
    return f"{folder}/gameweek_{period}_predictions.csv"


def read_latest(spark: SparkSession, folder: str, infer: bool = False) -> DataFrame:
    """Rows of the latest CSV snapshot, with its period."""
    period = latest_period(spark, folder)
    if period is None:
        raise NoRowsError("No prediction CSV files found")
    return read_predictions(spark, snapshot_path(folder, period), infer).withColumn("gameweek", F.lit(period))


VERSIONS, MANIFEST = "versions", "manifest"


def published_versions(spark: SparkSession, folder: str) -> DataFrame:
    """(gameweek, version, current) of every publication of a period; of each period the last one is current."""
    manifest = spark.read.parquet(f"{folder}/{MANIFEST}")
    newest = manifest.groupBy("gameweek").agg(F.max("version").alias("_newest"))
    return manifest.join(newest, "gameweek").select("gameweek", "version", (F.col("version") == F.col("_newest")).alias("current"))


def read_published(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of every period as it was published last.

    The manifest tells which version of a period counts. A version's files are never changed, so rows can be read while a period is
    published again: the reader keeps what it began with. Versions that don't count are pruned by their folders.
    """
    rows = spark.read.parquet(f"{folder}/{VERSIONS}")
    newest = spark.read.parquet(f"{folder}/{MANIFEST}").groupBy("gameweek").agg(F.max("version").alias("version"))
    return rows.join(newest, ["gameweek", "version"]).select(*[c for c in rows.columns if c != "version"])


def read_newest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest published period with the time of the last refresh; other folders are pruned at run time."""
    table = f"{folder}/predictions"
    manifest = spark.read.parquet(f"{table}/{MANIFEST}")
    newest = lambda name: manifest.agg(F.max_by(name, F.struct("gameweek", "version"))).scalar()
    rows = spark.read.parquet(f"{table}/{VERSIONS}")
    rows = rows.where((F.col("gameweek") == newest("gameweek")) & (F.col("version") == newest("version"))).drop("version")
    stamp = spark.read.parquet(f"{folder}/stamps").agg(F.max("last_updated")).scalar()
    return rows.withColumn("last_updated", stamp)


def latest_partition(published: DataFrame, column: str = "gameweek") -> DataFrame:
    """The rows of the largest period of a published table; the other partitions are pruned at run time."""
    newest = published.agg(F.max(column)).scalar()
    return published.where(F.col(column) == newest)


def read_response(spark: SparkSession, path: str, one_per_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows and metadata of a stored response: one document, or one on each line with some of the rows each."""
    document = spark.read.schema(RESPONSE).option("multiLine", not one_per_line).json(path)
    rows = document.select(F.explode("players").alias("_player")).select("_player.*")
    return rows, document.drop("players")


def read_first_available(spark: SparkSession, places: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Rows and metadata from the first place that exists; ``places`` are (format, path) with format json, jsonl or csv."""
    for kind, path in places:
        try:
            if kind in ("json", "jsonl"):
                return read_response(spark, path, kind == "jsonl")
            rows = read_predictions(spark, path)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        counted = rows.agg(F.count(F.lit(1)).alias("total_players"))
        metadata = counted.select(
            F.lit(0).alias("gameweek"),
            F.lit(path.rstrip("/").rsplit("/", 1)[-1]).alias("csv_file"),
            "total_players",
            F.col("total_players").alias("filtered_players"),
            F.lit(None).cast("string").alias("last_updated"),
        )
        return rows, metadata
    raise NoRowsError("No prediction snapshot found")


def item_counts(envelopes: DataFrame) -> DataFrame:
    """One row per top-level array: its name and total number of items."""
    arrays = [f.name for f in envelopes.schema.fields if isinstance(f.dataType, T.ArrayType)]
    sized = envelopes.select(
        F.explode(F.array(*[F.struct(F.lit(name).alias("table"), F.size(name).alias("size")) for name in arrays])).alias("_t")
    )
    known = F.when(F.col("_t.size") >= 0, F.col("_t.size")).otherwise(0)
    return sized.groupBy(F.col("_t.table").alias("table")).agg(F.sum(known).alias("items"))


def field_profile(rows: DataFrame, table: str, ordinal: str = "pos") -> DataFrame:
    """One row per field, sorted by name: type, and its value in the first row as text."""
    fields = sorted((f for f in rows.schema.fields if f.name != ordinal), key=lambda f: f.name)
    first = rows.agg(F.min_by(F.struct(*[F.col(f.name) for f in fields]), F.col(ordinal)).alias("_first"))
    described = F.array(
        *[
            F.struct(
                F.lit(table).alias("table"),
                F.lit(f.name).alias("field"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.col("_first")[f.name].cast("string").alias("sample"),
            )
            for f in fields
        ]
    )
    return first.select(F.explode(described).alias("_field")).select("_field.*").orderBy("field")
