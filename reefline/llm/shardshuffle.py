"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

Rows lie in source parts. How many rows of each part go to each shard is drawn
first: a matrix whose row sums are the parts' sizes and whose column sums are
the shards' sizes, distributed as it would be had all rows been shuffled at
once (multivariate hypergeometric). Then each part is permuted on its own and
dealt by its row of the matrix, rows are exchanged, and each shard is permuted
again. All orders of all rows are equally likely, and shard sizes are exact.

The matrix is drawn in two steps, so no task draws all of it: for at most
``BLOCKS`` blocks of parts, then within each block for its parts, with the
block's draw as what is left in the shards. Draws invert the distribution in a
window around the mode, which holds for any counts.

Parts hold at most ``PART_ROWS`` rows, and a shard is put in order in buckets of
about as many, so neither a large source partition nor a large shard meets in
one task. Which part a row belongs to and its random keys are written before
counting, so a task that runs again deals the same rows.

Law ``rows``: shard sizes differ by one at most, the first shards take what is
over. Equal texts are rows like any others and spread over the shards.

Cases: nulls, repeated rows and ties are rows with a place each; an empty table
gives no rows; fewer rows than shards leave shards empty; texts of any length
are handed on whole. Other columns are handed on; a column named like an output
(``shard``, ``slot``) is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefline.llm.common import folder, ship, written
from reefline.operators.ranking import bucketed_index

ship(__name__)

PART_ROWS = 1 << 18
BLOCKS = 1024


def draw(good: int, bad: int, n: int, u: float) -> int:
    """Good ones among ``n`` drawn from ``good + bad``: the hypergeometric quantile of ``u``."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    spread = (n * (good / total) * (bad / total) * (total - n) / max(total - 1, 1)) ** 0.5
    reach = int(40 * spread) + 40  # beyond lies less than a double can hold
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    with np.errstate(divide="ignore"):
        steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.exp(logs - logs.max()).cumsum()
    return first + min(int(np.searchsorted(mass, u * mass[-1], side="right")), last - first)


def draw_row(left: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``n`` rows go to each shard, of which ``left`` places are free."""
    out = np.zeros_like(left)
    rest = int(left.sum())
    for j, free in enumerate(left.tolist()):
        out[j] = draw(free, rest - free, n, rng.random())
        rest -= free
        n -= int(out[j])
    return out


def draw_rows(sizes: pd.DataFrame, left: np.ndarray, key: str, seed: int) -> Iterator[pd.DataFrame]:
    """Rows of the matrix for ``sizes`` (``key, n``), by key; each draws from its own stream of random numbers."""
    left = left.astype(np.int64)
    for k, n in sizes.sort_values(key)[[key, "n"]].itertuples(index=False):
        row = draw_row(left, int(n), np.random.default_rng([seed, int(k)]))
        left = left - row
        yield pd.DataFrame({key: [k], "deal": [row.tolist()]})


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes that differ by one at most."""
    return np.array([rows // shards + (j < rows % shards) for j in range(shards)], np.int64)


def communication_matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """``part, deal`` (rows for each shard) for ``counts`` (``part, n``)."""
    block = F.pmod(F.xxhash64(F.lit(seed), "part"), F.lit(BLOCKS))
    counts = counts.withColumn("block", block)
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n"))
    total = blocks.agg(F.sum("n")).first()[0] or 0

    def of_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = pd.concat([*batches, pd.DataFrame({"block": [], "n": []})])
        yield from draw_rows(sizes, shard_sizes(total, shards), "block", seed)

    def of_parts(key: tuple, sizes: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(draw_rows(sizes, np.array(given["deal"].iloc[0]), "part", seed + 1))

    # at most BLOCKS rows of two numbers
    drawn = blocks.coalesce(1).mapInPandas(of_blocks, "block bigint, deal array<bigint>")
    return counts.groupBy("block").cogroup(drawn.groupBy("block")).applyInPandas(of_parts, "part bigint, deal array<bigint>")


def shuffle_into_shards(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` with ``shard`` and ``slot`` (place within the shard, from 0)."""
    spark = docs.sparkSession
    where = folder(spark, "shards")
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    number = F.monotonically_increasing_id()  # 2^33 numbers for each partition
    staged = written(
        docs.select(F.struct(*kept).alias("row"), number.alias("number")).select(
            "row",
            F.shiftright("number", PART_ROWS.bit_length() - 1).alias("part"),
            _random("number", seed, "deal").alias("deal_key"),
            _random("number", seed, "place").alias("place_key"),
            "number",
        ),
        f"{where}/rows",
    )
    counts = written(staged.groupBy("part").agg(F.count(F.lit(1)).alias("n")), f"{where}/parts")
    matrix = written(communication_matrix(counts, shards, seed), f"{where}/matrix")
    # rows in a part's random order: the first go to shard 0, the next to shard 1, ...
    upto = matrix.select(
        "part",
        F.posexplode("deal").alias("shard", "n"),
    ).filter("n > 0")
    upto = upto.selectExpr("part", "shard", "n", "sum(n) OVER (PARTITION BY part ORDER BY shard) AS stop")
    bounds = upto.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("stop", "shard"))).alias("bounds"))
    dealt = (
        staged.join(bounds, "part")
        .selectExpr("row", "bounds", "place_key", "number", "row_number() OVER (PARTITION BY part ORDER BY deal_key, number) AS k")
        .select("row", "place_key", "number", _shard_of(F.col("k"), F.col("bounds")).alias("shard"))
    )
    rows = counts.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-rows // shards // PART_ROWS))
    placed = bucketed_index(
        dealt,
        ["shard"],
        F.floor((F.col("place_key") / 2.0**64 + 0.5) * buckets),
        [F.col("place_key"), F.col("number")],
        "slot",
    )
    return placed.select("row.*", "shard", "slot")


def _random(number: str, seed: int, use: str) -> Column:
    """64 random bits of a row's number."""
    mixed = F.xxhash64(F.lit(use), F.lit(seed), number)
    return F.xxhash64(mixed, F.lit(seed), F.lit(use))


def _shard_of(k: Column, bounds: Column) -> Column:
    """The first shard whose rows reach to the ``k``-th of the part."""
    return F.filter(bounds, lambda b: b["stop"] >= k)[0]["shard"].cast("int")
