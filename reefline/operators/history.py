"""The memory of past suggestions and how good they were."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reefline.functions.names import blank
from reefline.functions.scores import percent
from reefline.operators.ranking import top_rows
from reefline.operators.suggest import outcome, suggested
from reefline.schemas import TRACK_KEY


def one_per_track(validation: DataFrame) -> DataFrame:
    """One row per track of tables that list a track more than once.

    The row with the lowest ``precedence`` wins where there is such a column (see
    ``read_all_reviews``); then a decided verdict before an open one, then the
    values that sort last.
    """
    order = [F.col("precedence").asc_nulls_last()] if "precedence" in validation.columns else []
    decided = F.lower(F.trim("true_detection")).isin("true", "false")
    rest = [c for c in ("true_detection", "species", "taxon_group", "notes") if c in validation.columns]
    return top_rows(
        validation, TRACK_KEY, [*order, F.coalesce(decided, F.lit(False)).desc(), *[F.col(c).desc_nulls_last() for c in rest]]
    )


def first_suggestions(predicted: DataFrame) -> DataFrame:
    """One suggestion per track: the most confident of the tracks that share its id."""
    return top_rows(suggested(predicted), TRACK_KEY, [F.col("suggestion_confidence").desc_nulls_last(), F.col("suggested_species")])


def record_new(history: DataFrame, predicted: DataFrame) -> DataFrame:
    """Add suggestions for tracks that never had one; the first suggestion stays."""
    fresh = (
        first_suggestions(predicted)
        .join(history.select(*TRACK_KEY), TRACK_KEY, "left_anti")
        .select(
            *TRACK_KEY,
            "suggested_species",
            "suggestion_confidence",
            F.lit("pending").alias("outcome"),
            F.lit(None).cast("string").alias("validated_species"),
            F.lit(None).cast("boolean").alias("validated_as_true"),
        )
    )
    return history.unionByName(fresh)


def resolve(history: DataFrame, validation: DataFrame) -> DataFrame:
    """Settle suggestions whose track has been reviewed since.

    A track has one row, whatever the number of rows the validation has for it. A
    suggestion that was settled before and is not settled by this validation
    keeps its outcome.
    """
    verdicts = one_per_track(validation).select(
        *TRACK_KEY,
        F.lower(F.trim("true_detection")).alias("_verdict"),
        F.trim("species").alias("_species"),
        F.lit(True).alias("_listed"),
    )
    joined = history.join(verdicts, TRACK_KEY, "left")
    now = outcome(F.col("_verdict"), F.col("_species"), F.col("suggested_species"))
    settled = now != "pending"
    confirmed = (F.col("_verdict") == "true") & ~blank(F.col("_species"))
    return joined.select(
        *TRACK_KEY,
        "suggested_species",
        "suggestion_confidence",
        F.when(settled, now).otherwise(F.col("outcome")).alias("outcome"),
        F.when(confirmed, F.col("_species"))
        .when(~settled, F.col("validated_species"))
        .alias("validated_species"),
        F.when(settled, confirmed).otherwise(F.col("validated_as_true")).alias("validated_as_true"),
        F.coalesce("_listed", F.lit(False)).alias("in_validation"),
        now.alias("outcome_now"),
    )


def update_history(history: DataFrame, predicted: DataFrame, validation: DataFrame) -> DataFrame:
    return resolve(record_new(history, predicted), validation)


def accuracy(resolved: DataFrame) -> DataFrame:
    """Summary over the tracks of the current validation table."""
    listed, now = F.col("in_validation"), F.col("outcome_now")
    return resolved.agg(
        F.count(F.lit(1)).alias("total_suggestions_made"),
        F.count_if(listed & (now == "correct")).alias("correct"),
        F.count_if(listed & now.isin("incorrect", "incorrect_fp")).alias("incorrect"),
        F.count_if(listed & (now == "pending")).alias("pending"),
    ).withColumn("accuracy_percent", percent(F.col("correct"), F.col("correct") + F.col("incorrect")))


def confusion(resolved: DataFrame, least: int = 1) -> DataFrame:
    """Wrong suggestions by what the track really was; ``least`` = 3 shows patterns."""
    return (
        resolved.filter(F.col("in_validation") & F.col("outcome_now").isin("incorrect", "incorrect_fp"))
        .groupBy(
            "suggested_species",
            F.when(F.col("outcome_now") == "incorrect_fp", F.lit("FALSE_POSITIVE"))
            .otherwise(F.col("validated_species"))
            .alias("actual"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= least)
    )
