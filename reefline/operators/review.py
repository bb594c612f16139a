"""Human review: the validation table, review filters and orders, facets, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefline.functions.names import blank
from reefline.functions.scores import confidence_band, percent
from reefline.operators.ranking import top_rows
from reefline.schemas import TRACK_KEY

BLANK = "__blank__"


def verdict(text: Column) -> Column:
    """'true' / 'false' in any case and padding to BOOLEAN; anything else is null."""
    word = F.lower(F.trim(text))
    return F.when(word == "true", F.lit(True)).when(word == "false", F.lit(False))


def clean_validation(raw: DataFrame) -> DataFrame:
    """Trimmed text, lower-case verdicts, numbers with 0 for blank."""
    text = {
        c: F.trim(F.coalesce(c, F.lit("")))
        for c in ("taxon_group", "species", "notes")
        if c in raw.columns
    }
    numbers = {
        c: F.coalesce(F.trim(F.col(c).cast("string")).try_cast("double"), F.lit(0.0))
        for c in ("time_seconds", "confidence")
        if c in raw.columns
    }
    return raw.withColumns(
        {
            **text,
            **numbers,
            "true_detection": F.lower(F.trim(F.coalesce("true_detection", F.lit("")))),
        }
    )


def validation_state(validation: DataFrame) -> DataFrame:
    """Reviewed tracks only, one row per track key with a BOOLEAN verdict."""
    return (
        validation.withColumn("true_detection", verdict(F.col("true_detection")))
        .filter(F.col("true_detection").isNotNull())
        .filter(~blank(F.col("bruv_station")) & ~blank(F.col("video_id")) & F.col("track_id").isNotNull())
        .select(*TRACK_KEY, "true_detection", "taxon_group", "species", "notes")
    )


def merge_states(embedded: DataFrame, newer: DataFrame) -> DataFrame:
    """Two review states; where both know a track, the newer row wins whole."""
    fields = [c for c in embedded.columns if c not in TRACK_KEY]
    old = embedded.select(*TRACK_KEY, F.struct(*fields).alias("_old"))
    new = newer.select(*TRACK_KEY, F.struct(*fields).alias("_new"))
    return (
        old.join(new, TRACK_KEY, "full")
        .withColumn("_state", F.coalesce("_new", "_old"))
        .select(*TRACK_KEY, *[F.col("_state")[c].alias(c) for c in fields])
    )


def merge_reviewers(reviews: DataFrame, precedence: str = "precedence") -> DataFrame:
    """One row per track from several reviewers' files: the file with lowest precedence wins.

    ``conflict`` tells that the files disagree on verdict, group or species.
    """
    said = F.struct(
        F.lower(F.trim("true_detection")), F.trim("taxon_group"), F.lower(F.trim("species"))
    )
    flags = reviews.groupBy(*TRACK_KEY).agg(
        F.count(F.lit(1)).alias("reviews"),
        (F.min(said) != F.max(said)).alias("conflict"),
    )
    chosen = top_rows(reviews, TRACK_KEY, [F.col(precedence).asc()])
    return chosen.join(flags, TRACK_KEY)


def export_validation(tracks: DataFrame, state: DataFrame) -> DataFrame:
    """Every track with what is known about it; text is '' where nothing is."""
    joined = tracks.drop("true_detection", "taxon_group", "species", "notes").join(
        state, TRACK_KEY, "left"
    )
    return joined.withColumns(
        {
            "true_detection": F.coalesce(F.col("true_detection").cast("string"), F.lit("")),
            **{c: F.coalesce(c, F.lit("")) for c in ("taxon_group", "species", "notes")},
        }
    )


def with_state(tracks: DataFrame, state: DataFrame, predicted: DataFrame | None = None) -> DataFrame:
    """Tracks with verdict, group, species and whether a suggestion is open."""
    out = tracks.drop("true_detection", "taxon_group", "species", "notes").join(
        state, TRACK_KEY, "left"
    )
    if predicted is None:
        return out.withColumn("has_suggestion", F.lit(False))
    open_keys = predicted.filter(F.col("status") == "suggested").select(
        *TRACK_KEY, F.lit(True).alias("_open")
    )
    return (
        out.join(open_keys, TRACK_KEY, "left")
        .withColumn("has_suggestion", F.coalesce("_open", F.lit(False)) & F.col("true_detection").isNull())
        .drop("_open")
    )


def _choice(column: str, wanted: str | None) -> Column:
    if wanted is None:
        return F.lit(True)
    if wanted == BLANK:
        return blank(F.col(column))
    return F.col(column) == wanted


def review_filter(
    tracks: DataFrame,
    collection: str | None = None,
    station: str | None = None,
    band: str | None = None,
    status: str | None = None,
    taxon_group: str | None = None,
    species: str | None = None,
) -> DataFrame:
    """Tracks that pass every chosen filter; ``__blank__`` asks for unassigned ones.

    ``status`` is unvalidated, suggested, true or false.
    """
    state = {
        None: F.lit(True),
        "unvalidated": F.col("true_detection").isNull(),
        "suggested": F.col("has_suggestion"),
        "true": F.coalesce("true_detection", F.lit(False)),
        "false": F.coalesce(~F.col("true_detection"), F.lit(False)),
    }[status]
    out = tracks
    if collection is not None:
        out = out.filter(F.col("collection") == collection)
    if station is not None:
        out = out.filter(F.col("bruv_station") == station)
    if band is not None:
        out = out.filter(confidence_band(F.col("confidence")) == band)
    return out.filter(state & _choice("taxon_group", taxon_group) & _choice("species", species))


def review_order(tracks: DataFrame, by: str = "confidence-desc") -> DataFrame:
    """Review orders, each completed by the track key."""
    ties = [F.col(c).asc() for c in TRACK_KEY]
    name = F.lower(
        F.when(~blank(F.col("species")), F.col("species")).when(
            ~blank(F.col("taxon_group")), F.col("taxon_group")
        )
    )
    orders: dict[str, Sequence[Column]] = {
        "confidence-desc": [F.col("confidence").desc()],
        "confidence-asc": [F.col("confidence").asc()],
        "species-asc": [name.asc_nulls_last(), F.col("confidence").desc()],
        "bruv-asc": [F.col("bruv_station").asc()],
        "collection-asc": [F.col("collection").asc()],
    }
    return tracks.orderBy(*orders[by], *ties)


def taxon_facet(tracks: DataFrame) -> DataFrame:
    """Taxon groups to choose from; a null row stands for reviewed tracks without one."""
    group = F.when(~blank(F.col("taxon_group")), F.col("taxon_group"))
    return (
        tracks.filter(~blank(F.col("taxon_group")) | F.col("true_detection").isNotNull())
        .groupBy(group.alias("taxon_group"))
        .agg(F.count(F.lit(1)).alias("tracks"))
    )


def species_facet(tracks: DataFrame) -> DataFrame:
    """Species to choose from; a null row stands for tracks without one."""
    name = F.when(~blank(F.col("species")), F.col("species"))
    return tracks.groupBy(name.alias("species")).agg(F.count(F.lit(1)).alias("tracks"))


def review_stats(tracks: DataFrame) -> DataFrame:
    """Counts over the listed tracks after their state is joined."""
    seen = F.col("true_detection")
    return tracks.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(seen).alias("validated"),
        F.count_if(seen).alias("true_count"),
        F.count_if(~seen).alias("false_count"),
    ).withColumns(
        {
            "precision_percent": percent(F.col("true_count"), F.col("validated")),
            "progress_percent": percent(F.col("validated"), F.col("total")),
        }
    )
