"""Periodic refresh: rebuild the periods for which snapshots landed since the last run."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.operators import lookups
from touchline.plans import score_job
from touchline.schemas import ENVELOPE
from touchline.session import new_folder, stage
from touchline.sources import readers, writers

PERIOD_COLUMN = "gameweek"
#: How much older than the newest file seen a file may be and still count as new.
LATE = "365d"

_SCHEME = re.compile("^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?")
_CLEANERS = "spark.sql.streaming.fileSource.cleaner.numThreads"


def landed(schema: T.StructType) -> T.StructType:
    """Schema of landed documents in one folder per period."""
    return T.StructType([*schema.fields, T.StructField(PERIOD_COLUMN, T.IntegerType())])


#: What the stream of landed files is read as: names only, never contents.
LISTED = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
        T.StructField(PERIOD_COLUMN, T.IntegerType()),
    ]
)


def process_landed(
    spark: SparkSession,
    landing: str,
    checkpoint: str,
    handle: Callable[[DataFrame, list[int]], None],
    schema: T.StructType = ENVELOPE,
    one_per_line: bool = True,
    archive: str | None = None,
    late: str = LATE,
) -> bool:
    """Hand over what landed in ``landing/gameweek=<n>/`` since the last run, and stop.

    A period may land in several files over several runs, so ``handle`` gets all documents of the touched periods, not
    only the new ones, with the list of those periods. What it writes must replace a period as a whole: the outcome then
    does not depend on how files fall into batches, and a repeated batch does no harm. The checkpoint keeps the list of
    files seen; which periods were touched is told by the folders of the new files, whose contents the stream does not read. Documents
    carry the time and path of their file, so that of several snapshots of a period the newest can win. True if anything was handed over.

    With ``archive``, a folder of the same store outside ``landing``, the files of a run move there when a later run has found new
    ones and before it reads any. So a run lists what landed since the last but one, and those handled before of the touched periods
    alone. A file that a run left in ``landing`` because it broke off is read where it is. New files need new names. A file is taken as
    handled, without a look, if its time is older by more than ``late`` than that of the newest file seen.
    """
    handled: list[bool] = []
    whole = landed(readers.positioned_arrays(schema))

    def documents_in(session: SparkSession, root: str, folders: list[str]) -> DataFrame:
        file = F.struct(
            F.col("_metadata.file_modification_time").alias("time"),
            F.substring_index("_metadata.file_path", f"/{PERIOD_COLUMN}=", -1).alias("path"),  # the same after a move
        )
        read = session.read.schema(whole).options(basePath=root, multiLine=not one_per_line).json(folders)
        return read.withColumn(readers.LANDED, file)

    def rebuild(batch: DataFrame, _batch_id: int) -> None:
        root = F.regexp_extract("path", f"^(.*)/{PERIOD_COLUMN}=[^/]*/", 1)
        touched = sorted(batch.select(PERIOD_COLUMN, root).distinct().collect())  # one row per landed period
        if not touched:
            return
        periods, session = [row[0] for row in touched], batch.sparkSession
        folders = lambda root: [f"{root}/{PERIOD_COLUMN}={period}" for period in periods]
        documents = documents_in(session, landing, folders(landing.rstrip("/")))
        if archive is not None:
            moved = archive.rstrip("/") + _SCHEME.sub("", touched[0][1])  # a moved file keeps its whole path below the archive
            earlier = [folder for folder in folders(moved) if readers.exists(session, folder)]
            documents = documents.union(documents_in(session, moved, earlier)) if earlier else documents
        handle(documents, periods)
        handled.append(True)

    stream = spark.readStream.format("binaryFile").schema(LISTED).option("maxFileAge", late)
    if archive is not None:
        stream = stream.options(cleanSource="archive", sourceArchiveDir=archive)
    batches = stream.load(landing).writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint)
    with _moved_between_batches(spark):
        query = batches.trigger(availableNow=True).start()
    query.awaitTermination()
    return bool(handled)


@contextmanager
def _moved_between_batches(spark: SparkSession) -> Iterator[None]:
    """A stream that starts in here moves handled files before its next batch, and not while that one reads them."""
    before = spark.conf.get(_CLEANERS, None)
    spark.conf.set(_CLEANERS, 0)
    try:
        yield
    finally:
        spark.conf.unset(_CLEANERS) if before is None else spark.conf.set(_CLEANERS, before)


def newest_rows(documents: DataFrame, array: str, key: str = "id") -> DataFrame:
    """Items of landed documents, one per period and key: that of the newest landing, in it the last."""
    dated = documents.select(PERIOD_COLUMN, readers.LANDED, F.transform(array, _with_period).alias(array))
    return lookups.keep_last(readers.array_rows(dated, array), [PERIOD_COLUMN, key], [readers.POS])


def landed_rows(documents: DataFrame, arrays: Sequence[str]) -> dict[str, DataFrame]:
    """The items of several arrays of landed documents, each with its period and ordinal, out of one parse.

    The arrays are one tagged union, written once by tag and period, so that who reads one array of one period reads no other.
    """
    kinds = {array: documents.schema[array].dataType.elementType for array in arrays}
    empty = {array: F.lit(None).cast(kind).alias(array) for array, kind in kinds.items()}

    def tagged(array: str) -> Column:
        held = lambda item: [item.alias(array) if name == array else empty[name] for name in arrays]
        return F.transform(F.coalesce(F.col(array), F.array().cast(documents.schema[array].dataType)), lambda item, at: F.struct(F.lit(array).alias("tag"), at.alias("at"), *held(item)))

    union = documents.select(PERIOD_COLUMN, readers.LANDED, F.explode(F.concat(*map(tagged, arrays))).alias("_row"))
    path = new_folder(documents.sparkSession, "landed")
    union.select(PERIOD_COLUMN, readers.LANDED, "_row.*").write.partitionBy("tag", PERIOD_COLUMN).parquet(path)
    schema = T.StructType([f for f in union.select(PERIOD_COLUMN, readers.LANDED, "_row.*").schema.fields])
    written = documents.sparkSession.read.schema(schema).parquet(path)

    def rows(array: str) -> DataFrame:
        own = written.where(F.col("tag") == array)
        item = F.col(array)
        at = F.coalesce(item[readers.POS], F.col("at")) if readers.POS in kinds[array].names else F.col("at").cast("long")
        pos = F.struct(F.col(readers.LANDED), at.alias("at"))
        return own.select(pos.alias(readers.POS), PERIOD_COLUMN, *[item[name].alias(name) for name in kinds[array].names if name != readers.POS])

    return {array: rows(array) for array in arrays}


def _with_period(item: Column) -> Column:
    return item.withField(PERIOD_COLUMN, F.col(PERIOD_COLUMN))


def refresh(
    spark: SparkSession,
    landing: str,
    folder: str,
    checkpoint: str,
    build: Callable[[DataFrame], DataFrame],
    order: Sequence[Column] = (),
    schema: T.StructType = ENVELOPE,
    one_per_line: bool = True,
    archive: str | None = None,
) -> None:
    """Publish what ``build`` makes of the landed documents (``gameweek`` included), and note the time.

    ``build`` takes rows by ``newest_rows`` where several snapshots of a period may land. A run for which nothing landed
    does nothing. ``archive`` takes the files that were handled, as ``process_landed`` says.
    """

    def publish(documents: DataFrame, _touched: list[int]) -> None:
        writers.publish(build(documents), f"{folder}/predictions", order)

    if process_landed(spark, landing, checkpoint, publish, schema, one_per_line, archive):
        writers.stamp(spark, folder)


def refresh_scores(
    spark: SparkSession,
    landing: str,
    fixtures: DataFrame,
    folder: str,
    checkpoint: str,
    one_per_line: bool = True,
    archive: str | None = None,
    **settings,
) -> None:
    """Run the scoring job once per period for which snapshots landed, oldest first.

    Of several snapshots of a period the newest landing of each entity, team and calendar entry counts. The landed
    documents are parsed once for all arrays and all touched periods. The calendar in a snapshot names the period that its
    scores are published under.
    """

    def score(documents: DataFrame, touched: list[int]) -> None:
        rows = landed_rows(documents, ("elements", "teams", "events"))
        parts = [stage(lookups.keep_last(some, [PERIOD_COLUMN, "id"], [readers.POS]), array) for array, some in rows.items()]
        for period in touched:
            of_period = [part.where(F.col(PERIOD_COLUMN) == period).drop(PERIOD_COLUMN) for part in parts]
            score_job.run(*of_period, fixtures, folder, **settings)

    process_landed(spark, landing, checkpoint, score, one_per_line=one_per_line, archive=archive)
