"""Location lookup in a small band, and approximate species names."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations_with_replacement

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefline.functions import forms
from reefline.functions.forms import SHARE_DIVISOR, SHARE_WEIGHTS, may_be_near
from reefline.functions.names import blank
from reefline.operators.ranking import null_safe_join, top_rows
from reefline.session import spread

# The functions below travel to the executors whole: the package need not be installed there.
cloudpickle.register_pickle_by_value(forms)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DAY = 86_400


def scatter(lat: Column, lon: Column) -> Column:
    """A fixed number per place that is unrelated to where it lies, to order equal rows."""
    mixed = F.floor(lat * 1e7) * 7919 + F.floor(lon * 1e7) * 104729
    return F.pmod(mixed, F.lit(1_000_003))


# A cell that holds more rows of a source is crowded: it is quartered, at most this many times.
LEAF_ROWS = 128
QUARTERINGS = 8
HIT = ["lat", "lon", "source"]


def nearby_best(
    points: DataFrame,
    candidates: DataFrame,
    payload: Sequence[str],
    now: int,
    band: float = 0.01,
    days: int = 30,
) -> DataFrame:
    """Per point and source: the most confident row within ``band`` degrees both ways.

    ``points`` has (lat, lon); ``candidates`` (lat, lon, source, confidence,
    timestamp) and the payload columns. Equal confidences are ordered by
    :func:`scatter`, then by (lat, lon).

    Rows lie in cells as wide as the band. A point looks at the rows of the cells
    around it where these hold few. Crowded cells are quartered as often as the
    fullest of them needs, and every such cell keeps its best row, so a point's
    work there depends on the number of cells, not on how many rows crowd into
    them (see ``_best_of_crowded``). One number, the fullest cell's rows, is
    fetched to plan this.
    """
    fresh = candidates.filter(F.col("timestamp") > now - days * DAY)
    cell = ["cx", "cy", "source"]
    wide = [_cell("lat", band, 0).alias("cx"), _cell("lon", band, 0).alias("cy")]
    full = fresh.groupBy(*wide, "source").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LEAF_ROWS)
    fullest = full.agg(F.max("n")).first()[0]
    rows = top_rows(
        fresh,
        ["lat", "lon", "source"],
        [F.col("confidence").desc(), F.col("timestamp").desc()],
    ).select(
        *wide,
        "source",
        F.struct(
            F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
            scatter(F.col("lat"), F.col("lon")).alias("scatter"),
            (-F.col("lat")).alias("nlat"),
            (-F.col("lon")).alias("nlon"),
            *[c for c in payload if c != "confidence"],
        ).alias("hit"),
    )
    places = points.select("lat", "lon").distinct()
    if fullest is None:
        best = _best_of_sparse(places, rows, band)
    else:
        depth = min(QUARTERINGS, math.ceil(math.log(fullest / LEAF_ROWS, 4)))
        sparse, crowded = rows.join(full, cell, "left_anti"), rows.join(full, cell, "left_semi")
        both = _best_of_sparse(places, sparse, band).unionByName(_best_of_crowded(places, crowded, band, depth))
        best = both.groupBy(*HIT).agg(F.max("hit").alias("hit"))
    return best.select(
        "lat",
        "lon",
        "source",
        (-F.col("hit.nlat")).alias("match_lat"),
        (-F.col("hit.nlon")).alias("match_lon"),
        F.col("hit.confidence").alias("confidence"),
        *[F.col(f"hit.{c}").alias(c) for c in payload if c != "confidence"],
    )


def _probes(places: DataFrame, band: float) -> DataFrame:
    """Places with each cell (``cx, cy``) that their box touches."""

    def span(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - band * 1.001) / band), F.floor((F.col(c) + band * 1.001) / band))

    return places.withColumn("cx", F.explode(span("lat"))).withColumn("cy", F.explode(span("lon")))


def _near(band: float, hit: Column | None = None) -> Column:
    hit = F.col("hit") if hit is None else hit
    return (F.abs(-hit["nlat"] - F.col("lat")) < band) & (F.abs(-hit["nlon"] - F.col("lon")) < band)


def _best_of_sparse(places: DataFrame, rows: DataFrame, band: float) -> DataFrame:
    """``lat, lon, source, hit``: each place looks through the rows of its cells, best first (``LEAF_ROWS`` at most)."""
    cells = rows.groupBy("cx", "cy", "source").agg(F.sort_array(F.collect_list("hit"), asc=False).alias("hits"))
    first = F.get(F.filter("hits", lambda h: _near(band, h)), F.lit(0))
    found = _probes(places, band).join(cells, ["cx", "cy"]).withColumn("hit", first).filter(F.col("hit").isNotNull())
    return found.groupBy(*HIT).agg(F.max("hit").alias("hit"))


def _best_of_crowded(places: DataFrame, rows: DataFrame, band: float, depth: int) -> DataFrame:
    """``lat, lon, source, hit``: a cell that lies wholly in a point's box answers with its best row; one that
    the box's edge cuts is opened into its quarters, and only if its best row beats what the point has already.
    Rows themselves are looked at in the smallest cells alone."""
    unit = band
    rows = rows.select(
        F.floor(-F.col("hit.nlat") / unit * 2**depth).alias("cx"), F.floor(-F.col("hit.nlon") / unit * 2**depth).alias("cy"), "source", "hit"
    )
    cell = ["cx", "cy", "source"]
    tops = [rows.groupBy(*cell).agg(F.max("hit").alias("hit"))]
    for _ in range(depth):
        halved = [F.floor(F.col(c) / 2).alias(c) for c in ("cx", "cy")]
        tops.insert(0, tops[0].select(*halved, "source", "hit").groupBy(*cell).agg(F.max("hit").alias("hit")))
    frontier = _probes(places, band).join(tops[0], ["cx", "cy"]).withColumn("have", F.lit(None).cast(rows.schema["hit"].dataType))
    # a finished point stays as one row; its key is scattered, since no cell has it
    nowhere = -F.pmod(F.xxhash64("lat", "lon"), F.lit(1_000_003)) - 2**40
    for level in range(depth + 1):
        size = unit / 2**level
        inside = _within("cx", "lat", size, band) & _within("cy", "lon", size, band)
        opened = F.struct("cx", "cy", F.col("hit").alias("top"))
        state = (
            frontier.groupBy(*HIT)
            .agg(
                F.max(F.greatest("have", F.when(inside, F.col("hit")))).alias("have"),
                # cells along the edge of one box: a bounded list
                F.collect_list(F.when(F.col("hit").isNotNull() & ~inside, opened)).alias("cut"),
            )
            .select(
                *HIT,
                "have",
                F.filter("cut", lambda c: F.col("have").isNull() | (c["top"] > F.col("have"))).alias("cut"),
            )
        )
        if level == depth:
            break
        child = unit / 2 ** (level + 1)
        quarters = F.flatten(
            F.transform(
                "cut",
                lambda c: F.array(
                    *[F.struct((c["cx"] * 2 + i).alias("cx"), (c["cy"] * 2 + j).alias("cy")) for i in (0, 1) for j in (0, 1)]
                ),
            )
        )
        touching = F.filter(quarters, lambda c: _touches(c["cx"], F.col("lat"), child, band) & _touches(c["cy"], F.col("lon"), child, band))
        frontier = (
            state.withColumn("open", F.explode_outer(touching))
            .select(*HIT, "have", F.coalesce("open.cx", nowhere).alias("cx"), F.coalesce("open.cy", nowhere).alias("cy"))
            .join(tops[level + 1], cell, "left")
        )
    return (
        state.withColumn("open", F.explode_outer("cut"))
        .select(*HIT, "have", F.coalesce("open.cx", nowhere).alias("cx"), F.coalesce("open.cy", nowhere).alias("cy"))
        .join(rows, cell, "left")
        .groupBy(*HIT)
        .agg(F.max(F.greatest("have", F.when(_near(band), F.col("hit")))).alias("hit"))
        .filter(F.col("hit").isNotNull())
    )


def _cell(c: str, unit: float, level: int) -> Column:
    """Cell number of the level; a cell's halves have twice its number and the next."""
    return F.floor((F.col(c) / unit) * 2**level)


def _within(cell: str, at: str, size: float, band: float) -> Column:
    """Whether a cell surely lies inside the band around a point, along one axis."""
    low, slack = F.col(cell) * size, band * 1e-6
    return (low > F.col(at) - band + slack) & (low + size < F.col(at) + band - slack)


def _touches(cell: Column, at: Column, size: float, band: float) -> Column:
    """Whether a cell may reach into the band around a point, along one axis."""
    low, slack = cell * size, band * 1e-6
    return (low + size > at - band - slack) & (low < at + band + slack)


# Names up to this length are found by what is left when letters are taken out, longer ones by their length.
SHORT_NAME = 40
# Forms that a group should have, and from how many on in the fullest group a third letter deals them; groups of one length at most.
FORMS_TOGETHER, FORMS_AT_MOST = 1 << 22, 1 << 25
SHARES_AT_MOST = 1 << 16


def deletion_forms(names: DataFrame, text: str, most: int, need: Column | None = None) -> DataFrame:
    """``_form`` (a hash) of every way to take letters out of ``text``, beside the other columns.

    ``need`` lists how many letters are taken out (up to ``most``), by default
    every number from 0. Of a text with fewer letters, all go. Letters go from
    left to right, so each choice of places is made once: a text of n letters has
    at most n choose k forms with k letters out.
    """
    need = F.array(*[F.lit(k) for k in range(most + 1)]) if need is None else need
    size = F.length(F.col(text))
    none = F.array().cast("array<struct<left: string, at: int>>")

    def cut(form: Column) -> Column:
        left, at = form["left"], form["at"]
        places = F.when(at <= F.length(left), F.sequence(at, F.length(left))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(F.concat(F.left(left, i - 1), F.substr(left, i + 1)).alias("left"), i.alias("at")))

    wanted = F.transform(need, lambda k: F.least(k, F.col("_letters")))
    levels = names.withColumn("_letters", size).withColumn("_wanted", wanted).withColumn("_level0", F.array(F.struct(F.col(text).alias("left"), F.lit(1).alias("at"))))
    for k in range(most):
        deeper = F.flatten(F.transform(f"_level{k}", cut))
        levels = levels.withColumn(f"_level{k + 1}", F.when(F.array_max("_wanted") > k, deeper).otherwise(none))
    kept = [F.when(F.array_contains("_wanted", F.lit(k)), F.col(f"_level{k}")).otherwise(none) for k in range(most + 1)]
    forms = F.array_distinct(F.transform(F.concat(*kept), lambda f: F.xxhash64(f["left"])))
    return levels.select(*names.columns, F.explode(forms).alias("_form"))


def _deals(typed: DataFrame, listed: DataFrame, most: int) -> DataFrame:
    """How forms are dealt to groups: ``_typed, _size, _left, _places, _shares``, a row for each side, length
    of text and number of letters left.

    ``_places`` are two or three places of the form whose commonest letter is
    rarest among the listed names, ``_shares`` how many groups its letters there
    are dealt to, so that a group has about ``FORMS_TOGETHER`` forms.
    """
    counts = [
        side.groupBy("_size").agg(F.count(F.lit(1)).alias("_n")).select(F.struct(F.lit(side is typed).alias("typed"), "_size", "_n").alias(name))
        for side, name in ((typed, "_t"), (listed, "_l"))
    ]
    # a row for each pair of lengths
    meet = counts[0].join(F.broadcast(counts[1]), F.abs(F.col("_t._size") - F.col("_l._size")) <= most)
    form = F.greatest(F.greatest("_t._size", "_l._size") - most, F.lit(0)).alias("_left")
    sides = meet.select(form, F.explode(F.array("_t", "_l")).alias("s")).select("_left", "s.*").distinct()
    ways, out = F.lit(1.0), F.col("_size") - F.col("_left")
    for k in range(most):
        ways = F.when(out > k, ways * (F.col("_size") - k) / (k + 1)).otherwise(ways)
    sizes = sides.groupBy("_left").agg(F.sum(ways * F.col("_n")).alias("_forms"), F.max(F.when(~F.col("typed"), F.col("_n"))).alias("_most"))
    letters = listed.select("_size", F.posexplode(F.split("_name_low", "")).alias("_at", "_letter")).groupBy("_size", "_at", "_letter").agg(F.count(F.lit(1)).alias("_n"))
    moves = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(o).alias("o")) for k in range(most + 1) for o in range(k + 1)]))
    places = (
        letters.withColumn("_move", moves)
        .select((F.col("_size") - F.col("_move.k")).alias("_left"), (F.col("_at") - F.col("_move.o")).alias("_place"), "_n")
        .filter((F.col("_place") >= 0) & (F.col("_place") < F.col("_left")))
        .groupBy("_left", "_place")
        .agg(F.max("_n").alias("_n"))
        .groupBy("_left")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("_n", "_place"))), 1, len(SHARE_WEIGHTS)).alias("_best"))
    )
    fullest = F.col("_forms") * F.coalesce(F.get("_best", 0)["_n"] * F.get("_best", 1)["_n"] / F.col("_most") / F.col("_most"), F.lit(0.0))
    deals = sizes.join(F.broadcast(places), "_left", "left").select(
        "_left",
        F.array_sort(F.slice(F.col("_best._place"), 1, F.when(fullest > FORMS_AT_MOST, 3).otherwise(2))).alias("_places"),
        F.least(F.ceil(F.col("_forms") / FORMS_TOGETHER), F.lit(SHARES_AT_MOST)).cast("bigint").alias("_shares"),
    )
    return sides.join(F.broadcast(deals), "_left").select(F.col("typed").alias("_typed"), "_size", "_left", "_places", "_shares")


def _dealt(texts: DataFrame, deals: DataFrame, text: str, typed: bool, most: int) -> DataFrame:
    """``_group, _typed, _text``: each text beside every group that one of its forms is dealt to."""
    own = texts.join(F.broadcast(deals.filter(F.col("_typed") == typed)), "_size")

    def letter(k: int, moved: int) -> Column:
        return F.coalesce(F.ascii(F.substr(F.col(text), F.get("_places", k) + moved + 1, F.lit(1))).cast("bigint"), F.lit(0)) * SHARE_WEIGHTS[k]

    letters = {(k, o): f"_l{k}{o}" for k in range(len(SHARE_WEIGHTS)) for o in range(most + 1)}
    shares = [
        F.when(F.col("_out") >= moved[-1], F.pmod(F.pmod(sum(F.col(letters[k, o]) for k, o in enumerate(moved)), F.lit(SHARE_DIVISOR)), "_shares"))
        for moved in combinations_with_replacement(range(most + 1), len(SHARE_WEIGHTS))
    ]
    place = [F.coalesce(F.get("_places", k), F.lit(63)).cast("bigint") for k in range(len(SHARE_WEIGHTS))]
    group = F.col("_left").cast("bigint")
    for p in place:
        group = group * 64 + p
    group = (group * SHARES_AT_MOST + F.col("_shares") - 1) * SHARES_AT_MOST
    return (
        own.select(F.col(text).alias("_text"), group.alias("_group"), "_shares", (F.col("_size") - F.col("_left")).alias("_out"), *[letter(k, o).alias(c) for (k, o), c in letters.items()])
        .withColumn("_share", F.explode(F.array_distinct(F.array_compact(F.array(*shares)))))
        .select((F.col("_group") + F.col("_share")).alias("_group"), F.lit(typed).alias("_typed"), "_text")
    )


def _meetings(most: int) -> Callable:
    """The function that looks for texts with a common form in one group."""

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, shares_less_one = divmod(key[0].as_py() // SHARES_AT_MOST, SHARES_AT_MOST)
        places = []
        for _ in SHARE_WEIGHTS:
            left, place = divmod(left, 64)
            places = [place, *places]
        table = pa.Table.from_batches(batches)
        typed = table.column("_typed").combine_chunks()
        texts = table.column("_text").combine_chunks()
        words, names = texts.filter(typed), texts.filter(pc.invert(typed))
        yield from may_be_near(words, names, left, most, tuple(p for p in places if p < 63), key[0].as_py() % SHARES_AT_MOST, shares_less_one + 1)

    return meet


def near_names(words: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """Pairs of ``_low`` texts and listed names (``_name_low`` and more) at most ``most`` edits apart, with ``_distance``.

    Two texts at most k edits apart have a common form: the longer with k letters
    out, the shorter with as many less as it is shorter. Only names of about the
    typed letters meet, whatever the number of names of that length.

    A text has hundreds of forms, so forms never travel. They are dealt to groups
    by their letters at two or three places; taking letters out moves a place by
    ``most`` at most, so a text goes to ten or twenty groups, and each group finds
    the common forms dealt to it (``functions.forms``). Equal texts meet as they
    are, as the form with no letter out; they are joined by sorting.
    """
    close = F.levenshtein("_low", "_name_low", most)
    parts = spread(words.sparkSession)
    listed = names.select("_name_low").distinct()
    typed = words.select("_low", F.length("_low").alias("_size")).filter(F.col("_size") <= SHORT_NAME + most)
    short_names = listed.withColumn("_size", F.length("_name_low")).filter(F.col("_size") <= SHORT_NAME)
    deals = _deals(typed, short_names, most)
    short = (
        _dealt(typed, deals, "_low", True, most)
        .unionByName(_dealt(short_names, deals, "_name_low", False, most))
        .repartition(parts, "_group")
        .groupBy("_group")
        .applyInArrow(_meetings(most), "_low string, _name_low string")
        .filter(close >= 0)
        .distinct()
    )
    same = (
        typed.filter(F.col("_size") <= SHORT_NAME)
        .select("_low", F.col("_low").alias("_form"))
        .join(short_names.select("_name_low", F.col("_name_low").alias("_form")).hint("merge"), "_form")
        .select("_low", "_name_low")
    )
    long = (
        words.withColumn("_size", F.explode(F.sequence(F.length("_low") - most, F.length("_low") + most)))
        .join(listed.withColumn("_size", F.length("_name_low")).filter(F.col("_size") > SHORT_NAME), "_size")
        .select("_low", "_name_low")
    )
    pairs = short.unionByName(same).unionByName(long).withColumn("_distance", close).filter(F.col("_distance") >= 0)
    return pairs.join(names, "_name_low")


def match_species(
    inputs: DataFrame,
    lists: DataFrame | dict[str, Sequence[str]],
    text: str = "species",
    group: str = "taxon_group",
    most: int = 3,
) -> DataFrame:
    """Nearest listed species for typed names: in the track's own group, else in any.

    Adds ``match``, ``distance`` and ``scope`` ('group', 'all' or null). ``lists``
    is a table ``group, name, position`` of any length, or a dict of names by
    group; the lowest position wins a tie. Each distinct text is compared once,
    and only with names that share most of its letters (see ``near_names``).
    """
    if isinstance(lists, dict):
        listed = [(g, n) for g, names in lists.items() for n in names]
        rows = [(g, n, k) for k, (g, n) in enumerate(listed)]
        lists = inputs.sparkSession.createDataFrame(rows, "group string, name string, position bigint")
    names = lists.filter(F.col("name").isNotNull()).select(
        F.col("position").alias("_position"), F.col("group").alias("_group"), F.col("name").alias("_name"), F.lower("name").alias("_name_low")
    )
    low = F.lower(F.trim(F.col(text)))
    distinct = inputs.select(text, group).distinct().filter(~blank(F.col(text)))
    near = near_names(distinct.select(low.alias("_low")).distinct(), names, most)
    rank = F.struct(F.col("_distance").alias("distance"), F.col("_position").alias("position"), F.col("_name").alias("name"))
    by_group = near.groupBy("_low", "_group").agg(F.min(rank).alias("_own"))
    by_text = by_group.groupBy("_low").agg(F.min("_own").alias("_all"))
    hit = F.coalesce("_own", "_all")
    answers = (
        distinct.withColumn("_low", low)
        .join(by_text, "_low", "left")
        .join(by_group.withColumnRenamed("_low", "_text"), (F.col("_low") == F.col("_text")) & (F.col(group) == F.col("_group")), "left")
        .select(
            text,
            group,
            hit["name"].alias("match"),
            hit["distance"].cast("bigint").alias("distance"),
            F.when(F.col("_own").isNotNull(), F.lit("group"))
            .when(F.col("_all").isNotNull(), F.lit("all"))
            .alias("scope"),
        )
    )
    return null_safe_join(inputs, answers, [text, group], "left")
