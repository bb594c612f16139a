"""Suggestions, their history, and the review of tracks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.catalogue import inputs
from reefline.catalogue.registry import query
from reefline.operators import history as h
from reefline.operators import review as r
from reefline.operators import suggest as s
from reefline.plans import reports
from reefline.schemas import TRACK_KEY
from reefline.session import checkpoint_root, reliable_checkpoint

WINDOW_MS = 5000

def votes_sql(source: str = "validation", k: str = "") -> str:
    """The votes and predictions (``pred``) of a review table, in parts whose names end in ``k``."""
    return f"""t{k} AS (SELECT *, lower(trim(true_detection)) AS td FROM {source}),
p{k} AS (SELECT a.collection, a.bruv_station, a.video_id, a.track_id, a.confidence, b.species,
  (1e0 - abs(a.time_ms - b.time_ms) / {WINDOW_MS}e0) * b.confidence AS w
  FROM t{k} a JOIN t{k} b ON a.collection = b.collection AND a.bruv_station = b.bruv_station AND a.video_id = b.video_id
    AND a.track_id <> b.track_id AND abs(a.time_ms - b.time_ms) <= {WINDOW_MS}
  WHERE a.td = '' AND b.td = 'true' AND trim(b.species) <> ''),
v{k} AS (SELECT collection, bruv_station, video_id, track_id, species, count(*) AS n, round(sum(w), 9) AS weight
  FROM p{k} GROUP BY ALL),
q{k} AS (SELECT *, row_number() OVER k AS rn, sum(weight) OVER (PARTITION BY collection, bruv_station, video_id, track_id) AS total,
  CAST(sum(n) OVER (PARTITION BY collection, bruv_station, video_id, track_id) AS BIGINT) AS nearby
  FROM v{k} WINDOW k AS (PARTITION BY collection, bruv_station, video_id, track_id ORDER BY weight DESC, species)),
a{k} AS (SELECT collection, bruv_station, video_id, track_id,
  max(species) FILTER (rn = 1) AS suggested_species,
  max(round(coalesce(weight / nullif(total, 0), 0), 3)) FILTER (rn = 1) AS species_proportion, max(nearby) AS nearby,
  string_agg(species || '=' || printf('%.3f', round(coalesce(weight / nullif(total, 0), 0), 3)), ';' ORDER BY rn) FILTER (rn <= 3) AS alternatives
  FROM q{k} GROUP BY ALL),
pred{k} AS (SELECT t.collection, t.bruv_station, t.video_id, t.track_id,
  CASE WHEN td <> '' THEN 'validated' WHEN suggested_species IS NULL THEN 'unvalidated' ELSE 'suggested' END AS status,
  suggested_species, CASE WHEN suggested_species IS NULL THEN 0e0 ELSE round(confidence, 3) END AS suggestion_confidence,
  species_proportion, alternatives, td, trim(species) AS species, nearby, confidence
  FROM t{k} t LEFT JOIN a{k} USING (collection, bruv_station, video_id, track_id))"""


_VOTES = f"\nWITH {votes_sql()}\n"


@query("species_votes", _VOTES + "SELECT collection, bruv_station, video_id, track_id, species, n, round(weight, 6) AS weight FROM v")
def species_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.species_votes(inputs.validation(spark, sf_dir), WINDOW_MS).select(
        *TRACK_KEY, "species", "n", F.bround("weight", 6).alias("weight")
    )


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation table, derived once: the plans of the history read it several times."""
    return reliable_checkpoint(inputs.validation(spark, sf_dir))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.predictions(inputs.validation(spark, sf_dir), WINDOW_MS)


@query(
    "species_predictions",
    _VOTES
    + """SELECT collection, bruv_station, video_id, track_id, status, suggested_species, suggestion_confidence,
  species_proportion, alternatives, CASE status WHEN 'validated' THEN 'User validated' WHEN 'unvalidated' THEN 'No nearby validated tracks'
  ELSE printf('Based on %d nearby tracks (detection conf: %.1f%%)', nearby, confidence * 100e0) END AS reason FROM pred""",
)
def species_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.transform(
        F.map_entries("alternatives"),
        lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.3f", e["value"])),
    )
    return _predictions(spark, sf_dir).select(
        *TRACK_KEY,
        "status",
        "suggested_species",
        "suggestion_confidence",
        "species_proportion",
        F.array_join(entries, ";").alias("alternatives"),
        "reason",
    )


@query(
    "suggestion_distribution",
    _VOTES + "SELECT suggested_species, count(*) AS n FROM pred WHERE suggested_species IS NOT NULL GROUP BY ALL",
)
def suggestion_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.suggestion_distribution(_predictions(spark, sf_dir))


@query(
    "applied_suggestions",
    _VOTES
    + """SELECT collection, bruv_station, video_id, track_id, true AS true_detection, 'shark' AS taxon_group,
  suggested_species AS species, printf('Auto-suggested (%.0f%%)', round(suggestion_confidence * 100)) AS notes
FROM pred WHERE status = 'suggested'""",
)
def applied_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.apply_suggestions(_predictions(spark, sf_dir))


# A later state of the same validation: tracks that were open have been reviewed since.
_LATER = "CASE WHEN track_id % 4 = 3 THEN CASE (track_id + video_no) % 4 WHEN 0 THEN 'false' WHEN 1 THEN '' ELSE 'true' END ELSE true_detection END"
_LATER_SPECIES = "CASE WHEN track_id % 4 = 3 THEN CASE (track_id + video_no) % 3 WHEN 0 THEN 'G. cirratum' WHEN 1 THEN 'Carcharhinus perezi' ELSE '' END ELSE species END"
# An older history: suggestions made before, for tracks with odd video numbers.
_OLD_HISTORY = "track_id % 4 = 3 AND video_no % 2 = 1 AND track_id % 8 = 3"

_HISTORY = (
    _VOTES
    + f""", later AS (SELECT collection, bruv_station, video_id, track_id, lower(trim({_LATER})) AS ltd, trim({_LATER_SPECIES}) AS lsp FROM validation),
old AS (SELECT collection, bruv_station, video_id, track_id, 'Tiger shark' AS suggested_species, 0.5e0 AS suggestion_confidence
  FROM validation WHERE {_OLD_HISTORY}),
hist AS (SELECT * FROM old UNION ALL SELECT collection, bruv_station, video_id, track_id, suggested_species, suggestion_confidence FROM pred p
  WHERE status = 'suggested' AND NOT EXISTS (SELECT 1 FROM old o WHERE o.collection = p.collection AND o.bruv_station = p.bruv_station
    AND o.video_id = p.video_id AND o.track_id = p.track_id)),
res AS (SELECT hist.*, CASE WHEN ltd = 'true' AND lsp <> '' THEN CASE WHEN lower(lsp) = lower(suggested_species) THEN 'correct' ELSE 'incorrect' END
    WHEN ltd = 'false' THEN 'incorrect_fp' ELSE 'pending' END AS outcome,
  CASE WHEN ltd = 'true' AND lsp <> '' THEN lsp END AS validated_species,
  CASE WHEN ltd = 'true' AND lsp <> '' THEN true WHEN ltd = 'false' THEN false END AS validated_as_true
  FROM hist LEFT JOIN later USING (collection, bruv_station, video_id, track_id))
"""
)


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    validation = _table(spark, sf_dir)
    old = validation.filter(_OLD_HISTORY).select(
        *TRACK_KEY,
        F.lit("Tiger shark").alias("suggested_species"),
        F.lit(0.5).alias("suggestion_confidence"),
        F.lit("pending").alias("outcome"),
        F.lit(None).cast("string").alias("validated_species"),
        F.lit(None).cast("boolean").alias("validated_as_true"),
    )
    later = validation.withColumns(
        {"true_detection": F.expr(_LATER), "species": F.expr(_LATER_SPECIES)}
    )
    return h.update_history(old, s.predictions(validation, WINDOW_MS), later)


@query("suggestion_history", _HISTORY + "SELECT * FROM res")
def suggestion_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).drop("in_validation", "outcome_now")


@query(
    "suggestion_accuracy",
    _HISTORY
    + """SELECT count(*) AS total_suggestions_made, count(*) FILTER (outcome = 'correct') AS correct,
  count(*) FILTER (outcome IN ('incorrect', 'incorrect_fp')) AS incorrect, count(*) FILTER (outcome = 'pending') AS pending,
  round(coalesce(100e0 * count(*) FILTER (outcome = 'correct') / nullif(count(*) FILTER (outcome <> 'pending'), 0), 0), 1) AS accuracy_percent FROM res""",
)
def suggestion_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.accuracy(_history(spark, sf_dir))


_CONFUSION = """SELECT suggested_species, CASE outcome WHEN 'incorrect_fp' THEN 'FALSE_POSITIVE' ELSE validated_species END AS actual, count(*) AS n
FROM res WHERE outcome IN ('incorrect', 'incorrect_fp') GROUP BY ALL"""


@query("suggestion_confusion", _HISTORY + _CONFUSION)
def suggestion_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.confusion(_history(spark, sf_dir))


@query("suggestion_patterns", _HISTORY + _CONFUSION + " HAVING count(*) >= 3")
def suggestion_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.confusion(_history(spark, sf_dir), least=3)


@query(
    "saved_suggestion_reports",
    _HISTORY
    + f""", c AS ({_CONFUSION})
SELECT suggested_species, actual, n, total_suggestions_made, correct, incorrect, pending, accuracy_percent
FROM (SELECT count(*) AS total_suggestions_made, count(*) FILTER (outcome = 'correct') AS correct,
  count(*) FILTER (outcome IN ('incorrect', 'incorrect_fp')) AS incorrect, count(*) FILTER (outcome = 'pending') AS pending,
  round(coalesce(100e0 * count(*) FILTER (outcome = 'correct') / nullif(count(*) FILTER (outcome <> 'pending'), 0), 0), 1) AS accuracy_percent FROM res) a
LEFT JOIN c ON true""",
)
def saved_suggestion_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and confusions as they come back from a run's files."""
    resolved = reliable_checkpoint(_history(spark, sf_dir))
    update = {
        "predictions": resolved.select(*TRACK_KEY, "suggested_species"),
        "history": resolved.drop("in_validation", "outcome_now"),
        "accuracy": h.accuracy(resolved),
        "confusion": h.confusion(resolved),
    }
    folder = f"{checkpoint_root(spark)}/suggestions-{uuid.uuid4().hex}"
    reports.save_suggestions(update, folder, "run 1")
    accuracy, confusion = reports.read_saved(spark, folder, "run 1")
    return confusion.join(accuracy, F.lit(True), "right")  # the summary is one row


# --- review ---------------------------------------------------------------

_STATE = """
WITH t AS (SELECT collection, bruv_station, video_id, track_id, confidence,
  CASE lower(trim(true_detection)) WHEN 'true' THEN true WHEN 'false' THEN false END AS true_detection,
  trim(taxon_group) AS taxon_group, trim(species) AS species FROM validation)
"""


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.clean_validation(
        inputs.validation(spark, sf_dir).withColumn("notes", F.lit(""))
    )


def _stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = _tracks(spark, sf_dir)
    return r.with_state(tracks, r.validation_state(tracks))


@query(
    "clean_validation",
    """SELECT collection, bruv_station, video_id, track_id, time_seconds, confidence,
  lower(trim(true_detection)) AS true_detection, trim(taxon_group) AS taxon_group, trim(species) AS species FROM validation""",
)
def clean_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracks(spark, sf_dir).select(
        *TRACK_KEY, "time_seconds", "confidence", "true_detection", "taxon_group", "species"
    )


@query(
    "review_stats",
    _STATE
    + """SELECT count(*) AS total, count(true_detection) AS validated, count(*) FILTER (true_detection) AS true_count,
  count(*) FILTER (NOT true_detection) AS false_count,
  round(coalesce(100e0 * count(*) FILTER (true_detection) / nullif(count(true_detection), 0), 0), 1) AS precision_percent,
  round(100e0 * count(true_detection) / count(*), 1) AS progress_percent FROM t""",
)
def review_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.review_stats(_stated(spark, sf_dir))


@query(
    "review_facets",
    _STATE
    + """SELECT 'taxon' AS facet, nullif(taxon_group, '') AS choice, count(*) AS tracks FROM t WHERE true_detection IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'species', CASE WHEN true_detection IS NOT NULL THEN nullif(species, '') END, count(*) FROM t
WHERE confidence >= 0.8e0 GROUP BY ALL""",
)
def review_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = _stated(spark, sf_dir)
    taxa = r.taxon_facet(stated).select(
        F.lit("taxon").alias("facet"), F.col("taxon_group").alias("choice"), "tracks"
    )
    species = r.species_facet(r.review_filter(stated, band="high")).select(
        F.lit("species").alias("facet"), F.col("species").alias("choice"), "tracks"
    )
    return taxa.unionByName(species)


@query(
    "review_blank_species",
    _STATE
    + """SELECT collection, bruv_station, video_id, track_id, confidence FROM t
WHERE confidence >= 0.8e0 AND true_detection AND species = ''""",
)
def review_blank_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = r.review_filter(_stated(spark, sf_dir), band="high", status="true", species=r.BLANK)
    return r.review_order(kept, "species-asc").select(*TRACK_KEY, "confidence")


@query(
    "review_suggested",
    _VOTES
    + """SELECT collection, bruv_station, video_id, track_id, confidence FROM pred WHERE status = 'suggested'
AND collection = 'collection_1' AND confidence >= 0.5e0 AND confidence < 0.8e0""",
)
def review_suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = reliable_checkpoint(_tracks(spark, sf_dir))
    stated = r.with_state(tracks, r.validation_state(tracks), s.predictions(tracks, WINDOW_MS))
    kept = r.review_filter(stated, collection="collection_1", band="medium", status="suggested")
    return r.review_order(kept).select(*TRACK_KEY, "confidence")


_NEWER = "track_id % 3 = 0"


@query(
    "merged_review_state",
    f"""WITH e AS (SELECT collection, bruv_station, video_id, track_id, lower(trim(true_detection)) = 'true' AS true_detection, taxon_group, species
  FROM validation WHERE lower(trim(true_detection)) IN ('true', 'false')),
n AS (SELECT collection, bruv_station, video_id, track_id, false AS true_detection, 'other' AS taxon_group, '' AS species
  FROM validation WHERE {_NEWER})
SELECT * FROM n UNION ALL SELECT e.* FROM e ANTI JOIN n USING (collection, bruv_station, video_id, track_id)""",
)
def merged_review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = _tracks(spark, sf_dir)
    newer = tracks.filter(_NEWER).select(
        *TRACK_KEY,
        F.lit(False).alias("true_detection"),
        F.lit("other").alias("taxon_group"),
        F.lit("").alias("species"),
        F.lit("").alias("notes"),
    )
    return r.merge_states(r.validation_state(tracks), newer).drop("notes")


@query(
    "exported_validation",
    _STATE
    + """SELECT collection, bruv_station, video_id, track_id, confidence, coalesce(CAST(true_detection AS VARCHAR), '') AS true_detection,
  CASE WHEN true_detection IS NULL THEN '' ELSE taxon_group END AS taxon_group,
  CASE WHEN true_detection IS NULL THEN '' ELSE species END AS species FROM t""",
)
def exported_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = _tracks(spark, sf_dir)
    return r.export_validation(tracks, r.validation_state(tracks)).select(
        *TRACK_KEY, "confidence", "true_detection", "taxon_group", "species"
    )


_SECOND = "CASE WHEN track_id % 5 = 0 THEN 'false' ELSE true_detection END"


@query(
    "merged_reviewers",
    f"""WITH a AS (SELECT collection, bruv_station, video_id, track_id, true_detection, taxon_group, species, 2 AS precedence FROM validation
UNION ALL SELECT collection, bruv_station, video_id, track_id, {_SECOND}, taxon_group, species, 1 FROM validation WHERE track_id % 2 = 0)
SELECT collection, bruv_station, video_id, track_id, lower(trim(arg_min(true_detection, precedence))) AS true_detection,
  count(*) AS reviews, count(DISTINCT lower(trim(true_detection))) > 1 AS conflict FROM a GROUP BY ALL""",
)
def merged_reviewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = inputs.validation(spark, sf_dir).withColumn("precedence", F.lit(2))
    second = (
        inputs.validation(spark, sf_dir)
        .filter("track_id % 2 = 0")
        .withColumns({"true_detection": F.expr(_SECOND), "precedence": F.lit(1)})
    )
    return r.merge_reviewers(first.unionByName(second)).select(
        *TRACK_KEY, F.lower(F.trim("true_detection")).alias("true_detection"), "reviews", "conflict"
    )
