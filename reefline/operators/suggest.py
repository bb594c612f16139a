"""Species suggestions for unreviewed tracks from reviewed tracks near in time.

A reviewed track with a species votes for it with weight
``(1 - |dt| / window) * confidence`` on every unreviewed track of its video that
is at most ``window`` away. Summing over pairs would be quadratic in a busy
video. But over time a vote is a tent: its weight is a broken line, whose slope
changes by c/W, -2c/W and c/W at t - W, t and t + W. So the weight of all votes
at time x is x * (sum of slope changes so far) - (sum of change * its time).

Times are cut into buckets as long as the window. A tent reaches into three of
them; in each it is its value and slope at the bucket's start plus the changes
inside, so running sums never leave a bucket. Votes and tracks of a bucket meet
in one shuffle by (video, bucket): what else is needed are windows and groups
within it. A track's own votes are the same sums over the votes of its id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reefline.functions.names import blank
from reefline.schemas import VIDEO_KEY

# Votes are compared at this many digits, so the order of summation cannot decide a tie.
WEIGHT_DIGITS = 9


def with_time_ms(validation: DataFrame) -> DataFrame:
    """``time_ms`` from the seconds of a validation file; clock strings have no finer unit."""
    return validation.withColumn("time_ms", F.round(F.col("time_seconds") * 1000).cast("bigint"))


def reviewed_true(validation: DataFrame) -> DataFrame:
    """Tracks confirmed with a species: the voters."""
    return validation.filter(
        (F.lower(F.trim("true_detection")) == "true") & ~blank(F.col("species"))
    ).withColumn("species", F.trim("species"))


def unreviewed(validation: DataFrame) -> DataFrame:
    return validation.filter(blank(F.col("true_detection")))


def _slope_changes(votes: DataFrame, video: list[str], window_ms: int) -> DataFrame:
    """What each vote adds in each bucket it reaches: at offset ``o`` a value ``v``, a change of slope ``s``
    and a change of the number of votes ``n`` (a vote still counts at the very end of its window)."""
    w = float(window_ms)
    c, k, y = F.col("c"), F.col("k"), F.col("y")
    none, zero = F.lit(0.0), F.lit(0).cast("bigint")
    rise, start = c / w, F.lit(0).cast("bigint")

    def change(side: int, o: Column, v: Column, s: Column, n: Column) -> Column:
        return F.struct(F.lit(side).alias("side"), o.alias("o"), v.alias("v"), s.alias("s"), n.alias("n"))

    changes = F.array(
        change(-1, y, none, rise, k),
        change(0, start, c * (1 - y / w), rise, k),
        change(0, y, none, -2 * rise, zero),
        change(1, start, c * y / w, -rise, k),
        change(1, y, none, rise, zero),
        change(1, y + 1, none, none, -k),
    )
    return votes.withColumn("x", F.explode(changes)).select(
        *video, (F.col("b") + F.col("x.side")).alias("b"), "track_id", F.col("species").alias("voted"), "x.o", "x.v", "x.s", "x.n"
    )


def _scored(validation: DataFrame, window_ms: int, video: list[str], least_confidence: float | None) -> DataFrame:
    """Every row of the table, the open ones once for each species voted for near them, with ``n`` and ``weight``."""
    bucket = F.floor(F.col("time_ms") / window_ms)
    offset = (F.col("time_ms") - bucket * window_ms).cast("bigint")
    rows = validation.select(*video, "track_id", "time_ms", "confidence", "true_detection", "species")
    votes = (
        reviewed_true(rows)
        .filter(F.col("time_ms").isNotNull())
        .groupBy(*video, "track_id", "species", "time_ms")
        .agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("confidence"), F.lit(0.0)).alias("c"))
        .withColumns({"b": bucket, "y": offset})
    )
    tracks = rows.withColumns({"b": bucket, "o": offset, "row": F.monotonically_increasing_id()})
    both = _slope_changes(votes, video, window_ms).unionByName(tracks, allowMissingColumns=True)
    is_track = F.col("row").isNotNull()
    open_ = is_track & blank(F.col("true_detection"))
    if least_confidence is not None:
        open_ = open_ & (F.col("confidence") >= least_confidence)
    near = F.collect_set("voted").over(Window.partitionBy(*video, "b"))
    spread = (
        both.repartition(*video, "b")
        .withColumn("near", near)
        .withColumn("vote", F.explode_outer(F.when(open_, F.col("near")).when(~is_track, F.array("voted"))))
        .drop("near", "voted")
    )

    def sums(*by: str) -> tuple[Column, Column]:
        upto = Window.partitionBy(*video, "b", "vote", *by).orderBy("o", is_track).rowsBetween(Window.unboundedPreceding, 0)
        level, slope, moment = (F.sum(x).over(upto) for x in ("v", "s", F.col("s") * F.col("o")))
        weight = level + F.col("o") * slope - moment
        return F.coalesce(F.sum("n").over(upto), F.lit(0)), F.coalesce(weight, F.lit(0.0))

    (n, weight), (own_n, own_weight) = sums(), sums("track_id")
    return (
        spread.withColumns({"_n": n, "_weight": weight, "_own_n": own_n, "_own_weight": own_weight})
        .filter(is_track)
        .withColumns(
            {
                "n": F.when(F.col("vote").isNotNull(), F.col("_n") - F.col("_own_n")),
                "weight": F.round(F.greatest(F.lit(0.0), F.col("_weight") - F.col("_own_weight")), WEIGHT_DIGITS),
            }
        )
        .drop("_n", "_weight", "_own_n", "_own_weight", "v", "s", "o")
    )


def species_votes(
    validation: DataFrame, window_ms: int = 120_000, video: Sequence[str] = VIDEO_KEY
) -> DataFrame:
    """Votes and weight per unreviewed track and species.

    A track never votes for itself: where its id was also reviewed in the same
    video, those votes are taken off again.
    """
    video = list(video)
    return (
        _scored(validation, window_ms, video, None)
        .filter(F.col("n") > 0)
        .select(*video, "track_id", "time_ms", F.col("vote").alias("species"), "n", "weight")
        .distinct()
    )


def predictions(
    validation: DataFrame,
    window_ms: int = 120_000,
    video: Sequence[str] = VIDEO_KEY,
    least_confidence: float | None = None,
) -> DataFrame:
    """Status and suggestion for every track of the validation table.

    ``suggestion_confidence`` is the track's own detector confidence,
    ``species_proportion`` the share of the winning species in the votes. A tie
    goes to the species that sorts first. ``least_confidence`` is off by default.
    """
    video = list(video)
    heard = F.col("n") > 0
    own = ["track_id", "time_ms", "confidence", "true_detection", "species"]
    votes = (
        _scored(validation, window_ms, video, least_confidence)
        .groupBy(*video, "b", "row", *own)
        .agg(
            # as many as there are species near one track
            F.sort_array(F.collect_list(F.when(heard, F.struct((-F.col("weight")).alias("w"), F.col("vote").alias("species"))))).alias("votes"),
            F.sum(F.when(heard, F.col("weight"))).alias("total"),
            F.sum(F.when(heard, F.col("n"))).cast("bigint").alias("nearby_tracks"),
        )
    )
    entry = F.transform(
        F.slice("votes", 1, 3),
        lambda v: F.struct(v["species"], F.bround(F.coalesce(F.try_divide(-v["w"], F.col("total")), F.lit(0.0)), 3).alias("share")),
    )
    reviewed = ~blank(F.col("true_detection"))
    found = ~reviewed & (F.size("votes") > 0)

    def when_reviewed(col: Column) -> Column:
        return F.when(reviewed, col)

    return votes.withColumn("first", F.when(found, entry)).select(
        *video,
        "track_id",
        F.when(reviewed, F.lit("validated"))
        .when(found, F.lit("suggested"))
        .otherwise(F.lit("unvalidated"))
        .alias("status"),
        when_reviewed(F.lower(F.trim("true_detection"))).alias("true_detection"),
        when_reviewed(F.trim("species")).alias("species"),
        F.get("first", F.lit(0))["species"].alias("suggested_species"),
        F.when(found, F.bround("confidence", 3)).otherwise(F.lit(0.0)).alias("suggestion_confidence"),
        F.get("first", F.lit(0))["share"].alias("species_proportion"),
        F.when(reviewed, F.lit("User validated"))
        .when(
            found,
            F.format_string(
                "Based on %d nearby tracks (detection conf: %.1f%%)",
                F.col("nearby_tracks"),
                F.col("confidence") * 100.0,
            ),
        )
        .otherwise(F.lit("No nearby validated tracks"))
        .alias("reason"),
        F.map_from_entries("first").alias("alternatives"),
    )


def suggested(predicted: DataFrame) -> DataFrame:
    return predicted.filter((F.col("status") == "suggested") & F.col("suggested_species").isNotNull())


def suggestion_distribution(predicted: DataFrame) -> DataFrame:
    return (
        predicted.filter(F.col("suggested_species").isNotNull())
        .groupBy("suggested_species")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def apply_suggestions(predicted: DataFrame, taxon_group: str = "shark") -> DataFrame:
    """Accept suggestions as true detections. Reviewed tracks, true or false, are left alone."""
    return suggested(predicted).select(
        *VIDEO_KEY,
        "track_id",
        F.lit(True).alias("true_detection"),
        F.lit(taxon_group).alias("taxon_group"),
        F.col("suggested_species").alias("species"),
        F.format_string(
            "Auto-suggested (%.0f%%)", F.round(F.col("suggestion_confidence") * 100.0)
        ).alias("notes"),
    )


def outcome(true_detection: Column, species: Column, suggestion: Column) -> Column:
    """What became of a suggestion: correct, incorrect, incorrect_fp or pending."""
    verdict = F.lower(F.trim(true_detection))
    confirmed = (verdict == "true") & ~blank(species)
    return (
        F.when(confirmed & (F.lower(F.trim(species)) == F.lower(suggestion)), F.lit("correct"))
        .when(confirmed, F.lit("incorrect"))
        .when(verdict == "false", F.lit("incorrect_fp"))
        .otherwise(F.lit("pending"))
    )
