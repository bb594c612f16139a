"""Process result files once each, and keep suggestion history from run to run."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reefline import schemas
from reefline.functions.names import blank
from reefline.operators.history import first_suggestions, one_per_track
from reefline.operators.suggest import predictions
from reefline.schemas import TRACK_KEY
from reefline.sources.tables import CSV

# State that lives in files beside the executors; a batch saves only what it changed.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

# What a batch says of a track: a suggestion, a verdict, or both.
EVENTS = T.StructType(
    [
        *schemas.HISTORY.fields[:6],
        T.StructField("suggested_low", T.StringType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("species", T.StringType()),
        T.StructField("species_low", T.StringType()),
    ]
)
# What is kept of a track (see ``keep_history``).
KEPT = T.StructType(
    [
        *schemas.HISTORY.fields[:4],
        T.StructField("first", T.StructType([T.StructField("batch", T.LongType()), *EVENTS.fields[4:7]])),
        T.StructField("last", T.StructType([T.StructField("batch", T.LongType()), *EVENTS.fields[7:]])),
        T.StructField("newest", T.LongType()),
    ]
)


def new_files(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    fmt: str = "parquet",
    pattern: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """A stream of the rows of files that appear under a folder."""
    reader = spark.readStream.format(fmt).schema(schema)
    if fmt == "csv":
        reader = reader.options(**CSV)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def process_available(
    stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]
) -> None:
    """Run ``handle`` over everything that is new since the last run, then stop."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def process_new_results(
    stream: DataFrame,
    sink: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> None:
    """Transform new rows and add them to ``sink``.

    Each micro-batch owns the folder ``batch=<id>``: a batch that is run again
    after a failure replaces its own output, so no row is written twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    process_available(stream, checkpoint, write)


def track_events(batch: DataFrame, window_ms: int) -> DataFrame:
    """One row per track of a batch that suggests a species for it or settles it."""
    table = one_per_track(batch)
    verdict = F.lower(F.trim("true_detection"))
    verdicts = table.select(
        *TRACK_KEY,
        verdict.alias("verdict"),
        F.when((verdict == "true") & ~blank(F.col("species")), F.trim("species")).alias("species"),
    ).filter((F.col("verdict") == "false") | F.col("species").isNotNull())
    made = first_suggestions(predictions(table, window_ms)).select(*TRACK_KEY, "suggested_species", "suggestion_confidence")
    return (
        made.unionByName(verdicts, allowMissingColumns=True)
        .groupBy(*TRACK_KEY)
        .agg(*[F.max(c).alias(c) for c in ("suggested_species", "suggestion_confidence", "verdict", "species")])
        .withColumns({"suggested_low": F.lower("suggested_species"), "species_low": F.lower("species")})
        .select(*EVENTS.names)
    )


def keep_history(events: DataFrame) -> DataFrame:
    """Per track of a stream of events (with their ``batch``): its ``first`` suggestion, its ``last`` verdict and the ``newest`` batch.

    These three are all the state there is, and Spark's own aggregates keep
    them. Events of an earlier batch that come again change nothing.
    """
    made = F.struct("batch", "suggested_species", "suggestion_confidence", "suggested_low")
    said = F.struct("batch", "verdict", "species", "species_low")
    return events.groupBy(*TRACK_KEY).agg(
        F.min(F.when(F.col("suggested_species").isNotNull(), made)).alias("first"),
        F.max(F.when(F.col("verdict").isNotNull(), said)).alias("last"),
        F.max("batch").alias("newest"),
    )


def _history_rows(kept: DataFrame, *more: str) -> DataFrame:
    """History rows of tracks with a suggestion; a verdict counts if it came with the suggestion or later."""
    counts = F.coalesce(F.col("last.batch") >= F.col("first.batch"), F.lit(False))
    true = F.col("last.verdict") != "false"
    rows = kept.filter(F.col("first").isNotNull()).select(
        *TRACK_KEY,
        "first.suggested_species",
        "first.suggestion_confidence",
        F.when(~counts, F.lit("pending"))
        .when(~true, F.lit("incorrect_fp"))
        .when(F.col("last.species_low") == F.col("first.suggested_low"), F.lit("correct"))
        .otherwise(F.lit("incorrect"))
        .alias("outcome"),
        F.when(counts & true, F.col("last.species")).alias("validated_species"),
        F.when(counts, true).alias("validated_as_true"),
        F.when(counts, F.col("last.batch")).otherwise(F.col("first.batch")).alias("_told"),
        *more,
    )
    return rows.select(*schemas.HISTORY.names, "_told", *more)


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """Set the kind of state store for what starts inside."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def update_history_state(
    stream: DataFrame,
    state: str,
    checkpoint: str,
    window_ms: int = 120_000,
    validation: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> None:
    """Fold each micro-batch into the stored history.

    A batch may hold several validation exports; a track they share counts once.
    Batch n becomes events (``events/batch=n``: a batch that is run again
    replaces its own), and a second stream folds these into keyed state, one row
    per track. The state store looks up and saves only the tracks that a batch
    names, so the work of a batch depends neither on the number of earlier
    batches nor on the length of the history.
    """
    spark = stream.sparkSession

    def say(batch: DataFrame, batch_id: int) -> None:
        track_events(validation(batch), window_ms).write.mode("overwrite").parquet(f"{state}/events/batch={batch_id}")

    process_available(stream, checkpoint, say)
    # empty batches alone leave no folder to list
    spark.createDataFrame([], EVENTS).write.mode("append").parquet(f"{state}/events/batch=-1")
    events = T.StructType([*EVENTS.fields, T.StructField("batch", T.LongType())])
    told = spark.readStream.schema(events).parquet(f"{state}/events")
    with _state_store(spark):
        query = (
            keep_history(told)
            .writeStream.outputMode("update")
            .foreachBatch(lambda changed, n: changed.write.mode("overwrite").parquet(f"{state}/changes/batch={n}"))
            .option("checkpointLocation", f"{state}/keyed")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def read_history_state(spark: SparkSession, state: str) -> DataFrame:
    """The history: what the keyed state holds of every track."""
    with _state_store(spark):
        stored = spark.read.format("statestore").load(f"{state}/keyed")
    # the store names its columns after the aggregates, two of which are maxima
    kept = stored.select("key.*", F.col("value").cast(T.StructType(KEPT.fields[4:])).alias("value")).select(*TRACK_KEY, "value.*")
    return _history_rows(kept).drop("_told")


def read_history_changes(spark: SparkSession, state: str) -> DataFrame:
    """The rows that each run added or changed, with the run's number (``batch``).

    A run saved the tracks it heard of; changed are those whose row goes back to
    events later than any that an earlier run knew.
    """
    saved = spark.read.schema(T.StructType([*KEPT.fields, T.StructField("batch", T.LongType())])).parquet(f"{state}/changes")
    # one row per run
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    known = saved.groupBy("batch").agg(F.max("newest").alias("_end")).select("batch", F.max("_end").over(before).alias("_known"))
    rows = _history_rows(saved, "batch").join(F.broadcast(known), "batch")
    return rows.filter(F.col("_known").isNull() | (F.col("_told") > F.col("_known"))).select(*schemas.HISTORY.names, "batch")
