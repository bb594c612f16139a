"""Quality classifier: logistic regression on hashed word n-grams, trained by
follow-the-regularised-leader (FTRL-proximal) updates.

Features are word pairs and single words, each twice: as written in lower case,
and as the word's shape (letters in lower, upper or title case, digits, which
marks stand beside them, whether it repeats the word before). Each is hashed to one of ``2**BITS``
places; a text is the vector of its counts, damped and scaled to length one, so
long texts weigh as much as short ones.

Training takes at most ``MOST_ROWS`` labelled rows of each class, chosen by a
hash of the id. They are dealt to ``SHARDS`` learners, each an FTRL run in one
task over its own rows; their weights are averaged (at most ``2**BITS`` rows go
to the driver) and broadcast. Scoring is a map: a sparse dot product per text.

Cases: null or empty text has no feature and scores the bias alone. Without
labelled rows every score is 0.5. Rows without a label in {0, 1} teach nothing; a
doc_id labelled twice teaches twice. Rows without doc_id are scored, not learnt
from. Other columns are handed on; ``score`` is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reefline.llm.common import ship, slices

ship(__name__)

BITS = 18
MOST_ROWS = 2_000  # of each class
SHARDS = 6
EPOCHS = 8
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-3  # of the update
CACHED_WORDS = 300_000
SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def shape(word: str) -> str:
    """The word's form: one letter for each run of a kind, other marks as they are."""
    out = []
    for c in word:
        kind = "a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else "o" if c.isalpha() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


class Features:
    """Hashed features of texts; holds a bounded cache of words."""

    def __init__(self):
        import xxhash

        self.hash = xxhash.xxh3_64_intdigest
        self.known: dict[str, tuple[int, int]] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places in order, and the weight of each."""
        words = text.split()
        if not words:
            return np.empty(0, dtype=np.int64), np.empty(0)
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = (self.hash(w.lower()), self.hash("\0" + shape(w)))
        pairs = np.array([known[w] for w in words], dtype=np.uint64)
        word, form = pairs[:, 0], pairs[:, 1].copy()
        form[1:] += np.uint64(0x51ED270B) * (word[1:] == word[:-1])  # a repeated word has a shape of its own
        parts = [word * SALTS[0], form * SALTS[1]]
        for values, salt in ((word, SALTS[2]), (form, SALTS[3])):
            parts.append((values[:-1] * salt) ^ (values[1:] * SALTS[0]))
        place = (np.concatenate(parts) * SALTS[1]) >> np.uint64(64 - BITS)
        place, count = np.unique(place.astype(np.int64), return_counts=True)
        weight = np.log1p(count)
        return place, weight / math.sqrt(float(weight @ weight))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after FTRL-proximal updates over the rows, several times in a fixed order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0
    ones = sum(y for _, _, y in rows)
    # both classes count the same, however many rows each has
    share = {1: len(rows) / (2 * max(1, ones)), 0: len(rows) / (2 * max(1, len(rows) - ones))}
    rng = np.random.default_rng(7)

    def solve(zs, ns):
        active = np.abs(zs) > L1
        return np.where(active, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2), 0.0)

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            place, value, y = rows[k]
            w = solve(z[place], n[place])
            bias = float(solve(np.array(bias_z), np.array(bias_n)))
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ value) * 8 + bias))))
            g = (p - y) * share[y]
            grad = g * value * 8
            n2 = n[place] + grad * grad
            z[place] += grad - (np.sqrt(n2) - np.sqrt(n[place])) / ALPHA * w
            n[place] = n2
            m2 = bias_n + g * g
            bias_z += g - (math.sqrt(m2) - math.sqrt(bias_n)) / ALPHA * bias
            bias_n = m2
    return solve(z, n) * 8, float(solve(np.array(bias_z), np.array(bias_n)))


def sampled(docs: DataFrame, labels: DataFrame, label: str, most: int = MOST_ROWS) -> DataFrame:
    """At most ``most`` labelled texts of each class, by a hash of the id: ``doc_id, text, y``."""
    from reefline.operators.ranking import top_rows

    wanted = labels.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")
    ).filter("doc_id is not null and y in (0, 1)")
    # A first cut by the hash leaves little more than is wanted, however many labels there are.
    wanted = wanted.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    cut = F.lit(0)
    for r in wanted.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect():  # two rows
        share = min(1.0, (1.3 * most + 100) / r["n"])
        cut = F.when(F.col("y") == r["y"], F.lit(int(share * (1 << 30)))).otherwise(cut)
    chosen = top_rows(wanted.filter(F.col("place") < cut), ["y"], [F.col("place"), F.col("doc_id")], most).drop("place")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # at most 2 * most ids: a bounded broadcast
    return texts.join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, float] | None:
    """Averaged weights and bias, or None without labelled rows. The caller leaves held-out labels out."""
    rows = sampled(docs, labels, label)

    def learn(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        features = Features()
        part = part.sort_values(["doc_id", "y"])
        w, bias = ftrl([(*features(t), int(y)) for t, y in zip(part["text"], part["y"])])
        place = np.flatnonzero(w)
        return pd.DataFrame({"place": np.r_[-1, place], "w": np.r_[bias, w[place]]})

    shard = F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(SHARDS))
    learnt = rows.groupBy(shard.alias("shard")).applyInPandas(learn, "place long, w double")
    found = learnt.groupBy("place").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).collect()
    if not found:
        return None
    weights, bias, learners = np.zeros(1 << BITS), 0.0, max((r["n"] for r in found if r["place"] < 0), default=1)
    for r in found:
        if r["place"] < 0:
            bias = r["w"] / learners
        else:
            weights[r["place"]] = r["w"] / learners
    return weights, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """The documents with ``score``: how likely label 1 is."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = docs.select(
        F.struct(*[c for c in docs.columns if c != "score"]).alias("rest"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        weights, bias = shared.value or (np.zeros(1 << BITS), 0.0)
        for batch in batches:
            for part in slices(batch, "text"):
                margin = []
                for text in part.column("text").to_pylist():
                    place, value = features(text)
                    margin.append(float(weights[place] @ value) + bias)
                scores = 1 / (1 + np.exp(-np.clip(np.array(margin), -35, 35)))
                yield pa.record_batch([part.column("rest"), pa.array(scores)], names=["rest", "score"])

    rest = held.schema["rest"].dataType.simpleString()
    return held.mapInArrow(run, f"rest {rest}, score double").select("rest.*", "score")
