"""Toxicity: a support vector machine on a subsequence string kernel, with Nyström landmarks.

The kernel compares two words by the letter triples they share in order, gaps
allowed: a triple that spans ``s`` letters counts ``DECAY**s``, up to ``SPAN``
letters. A word with letters put in or left out keeps most of its triples, and
marks inside a word are skipped, so ``i.d.i-o_t`` and ``idxiot`` stay close to
``idiot``. Words are mapped to their kernel values with landmark words, whitened by
the landmarks' own kernel matrix (Nyström), and a linear machine is trained there.
Its weights fold back into one weight per triple, so scoring a word is a sum.

Labels mark texts, not words. Training starts from words that stand in toxic
texts far more often than chance allows, then takes, in each toxic text, the word
with the highest margin as its witness (multiple-instance learning). A text's
score is a logistic function of its highest margins, fitted on other texts.

Training reads at most ``MOST_ROWS`` labelled rows of each class, chosen by a hash
of the id, of each group of near copies the one with the smallest id; what reaches the driver is bounded by
the constants below. Scoring is a map over all texts.

Cases: null or empty text has no word and gets the score of the lowest margin.
Without labelled rows of both classes every score is 0. Rows without a label in
{0, 1} teach nothing. Rows without doc_id are scored, not learnt from. Equal rows
get equal scores. Other columns are handed on; ``score`` is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reefline.llm.common import folder, remove, ship, slices, written
from reefline.llm.quality import sampled
from reefline.llm.substrings import WordHashes, mixed, rolling
from reefline.operators.ranking import top_rows

ship(__name__)

MOST_ROWS = 3_000  # labelled texts of each class
CANDIDATES, ORDINARY = 6_000, 20_000  # words looked at: over-represented in toxic texts, and from clean ones
LANDMARKS = 256
SPAN, DECAY = 7, 0.7
BITS = 22  # places of triples
ROUNDS, EPOCHS = 3, 30
LOWEST = -4.0  # margin of a text without words
CACHED_WORDS = 150_000
SLICE_BYTES = 2 * 1024 * 1024  # of texts whose words are held at once
LETTER = re.compile(r"[\W\d_]+")
SPACED = re.compile(r"(?<!\S)\w(?: \w){3,}(?!\S)")
STEPS = [(a, b, DECAY ** (b + 1)) for b in range(2, SPAN) for a in range(1, b)]


def unit(word: str) -> str:
    """A word's letters."""
    return word if word.isalpha() else LETTER.sub("", word)


def units(text: str) -> set[str]:
    """Distinct words of a text as they stand between white space; letters spaced out count as one word too."""
    low = text.lower()
    out = set(low.split())
    if " " in low:
        out.update(m[0].replace(" ", "") for m in SPACED.finditer(low))
    return out


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word's triples: the word's number, the triple's place, and its weight. Words are scaled
    by what a word of that length without repeated triples has."""
    marked = ["^" + w + "$" for w in words]
    sizes = np.array([len(m) for m in marked])
    letters = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(letters))  # letters from here to the word's end
    first = letters * np.uint64(0x9E3779B97F4A7C15)
    second = letters * np.uint64(0xC2B2AE3D27D4EB4F)
    third = letters * np.uint64(0x165667B19E3779F9)
    who, where, weight = [], [], []
    scale = np.zeros(len(words))
    for a, b, w in STEPS:
        at = np.flatnonzero(left > b)
        code = (first[at] ^ ((second[at + a] << np.uint64(21)) | (second[at + a] >> np.uint64(43)))) + third[at + b]
        who.append(owner[at])
        where.append(((code * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - BITS)).astype(np.int64))
        weight.append(np.full(len(at), w))
        scale += w * w * np.maximum(sizes - b, 0)
    who = np.concatenate(who)
    return who, np.concatenate(where), np.concatenate(weight) / np.sqrt(np.maximum(scale, 1e-9))[who]


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values of words (rows) with landmarks (columns)."""
    who, where, weight = triples(landmarks)
    places, at = np.unique(where, return_inverse=True)
    table = np.zeros((len(places), len(landmarks)), dtype=np.float32)
    np.add.at(table, (at, who), weight)
    out = np.zeros((len(words), len(landmarks)), dtype=np.float32)
    for k in range(0, len(words), 500):
        who, where, weight = triples(words[k : k + 500])
        at = np.minimum(np.searchsorted(places, where), len(places) - 1)
        hit = places[at] == where
        np.add.at(out, who[hit] + k, table[at[hit]] * weight[hit, None].astype(np.float32))
    return out


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, keep: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear support vector machine (squared hinge loss) by Newton steps on the rows inside the margin."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(EPOCHS):
        inside = y * (x @ w) < 1
        a = x[inside]
        h = (a * weight[inside, None]).T @ a / len(x) + keep * np.eye(len(w))
        new = np.linalg.solve(h, (a * weight[inside, None]).T @ y[inside] / len(x))
        if np.allclose(new, w, atol=1e-6):
            break
        w = 0.5 * (w + new)
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) of a logistic function, by a few damped Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.5 * np.eye(len(w))
        w += 0.7 * np.linalg.solve(h, x.T @ (y - p) - 0.5 * w)
    return w


def surprise(n1: np.ndarray, n0: np.ndarray, total1: int, total0: int) -> np.ndarray:
    """Log-likelihood ratio of a word's share in toxic texts against the share of toxic texts; 0 if not higher."""
    base = total1 / (total1 + total0)
    n = n1 + n0
    p = np.clip(n1 / n, 1e-9, 1 - 1e-9)
    value = n1 * np.log(p / base) + n0 * np.log((1 - p) / (1 - base))
    return np.where(p > base, value, 0.0)


# A model is a plain dict, to be broadcast: ``place`` and ``weight`` of triples, ``bias``, and ``curve`` (margins to score).
Model = dict


class Scorer:
    """Margins of texts; holds a bounded cache of words."""

    def __init__(self, model: Model):
        self.model = model
        self.table = np.zeros(1 << BITS)
        self.table[model["place"]] = model["weight"]
        self.known: dict[str, float] = {}

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.model["bias"])
        for k in range(0, len(words), 5_000):
            part = words[k : k + 5_000]
            who, where, weight = triples(part)
            out[k : k + len(part)] += np.bincount(who, self.table[where] * weight, minlength=len(part))
        return out

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > CACHED_WORDS:
            self.known = {w: self.known[w] for w in words if w in self.known}
        new = [w for w in words if w not in self.known]
        if new:
            self.known.update(zip(new, self.margins([unit(w) for w in new]).tolist()))

    def texts(self, batch: list[str]) -> np.ndarray:
        """Per text: the highest margin, the second highest, and the logarithm of the number of words."""
        words = [units(t) for t in batch]
        self.learn(set().union(*words) if words else set())
        out = np.full((len(batch), 3), LOWEST)
        out[:, 2] = 0.0
        for k, own in enumerate(words):
            if own:
                best = sorted(map(self.known.__getitem__, own))[-2:]
                out[k] = best[-1], best[0], math.log1p(len(own))
        return np.maximum(out, LOWEST)


def fingerprints(text: str, hashes: WordHashes) -> list[int]:
    """Four smallest hashes of runs of four words; near copies agree on some."""
    words = text.lower().encode().split()
    if not words:
        return [0, 0, 0, 0]
    runs = rolling(hashes(words), min(4, len(words)))
    return [int(mixed(runs ^ np.uint64(s)).min() >> np.uint64(1)) for s in range(4)]


def fit(candidates: list[tuple[str, int, int]], ordinary: list[str], bags: list[list[int]], total1: int, total0: int) -> Model | None:
    """The machine on words. ``bags`` hold the candidates (by number) of each toxic text."""
    if not candidates or not ordinary:
        return None
    words = [c[0] for c in candidates]
    llr = surprise(*(np.array([c[k] for c in candidates], dtype=float) for k in (1, 2)), total1, total0)
    strict = math.log(20 * (len(words) + len(ordinary)))  # one false word in twenty runs
    seeds = [k for k in np.argsort(-llr).tolist() if llr[k] >= strict][: LANDMARKS // 2] or np.argsort(-llr).tolist()[:20]
    step = max(1, len(ordinary) // (LANDMARKS // 2))
    landmarks = [words[k] for k in seeds] + ordinary[::step][: LANDMARKS // 2]
    own = kernel(landmarks, landmarks).astype(float)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    good = values > 1e-3 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])
    x1, x0 = kernel(words, landmarks) @ whiten, kernel(ordinary, landmarks) @ whiten
    positive = set(seeds)
    for _ in range(ROUNDS):
        pos = sorted(positive)
        x = np.r_[x1[pos], x0]
        y = np.r_[np.ones(len(pos)), -np.ones(len(x0))]
        w, bias = machine(x, y, np.where(y > 0, 0.25 * len(x0) / len(pos), 1.0))
        margin = x1 @ w + bias
        witnesses = {max(bag, key=lambda k: margin[k]) for bag in bags if bag}
        after = set(seeds) | {k for k in witnesses if margin[k] > 0}
        if after == positive:
            break
        positive = after
    per_landmark = whiten @ w
    who, where, weight = triples(landmarks)
    table = np.zeros(1 << BITS)
    np.add.at(table, where, weight * per_landmark[who])
    place = np.flatnonzero(table)
    return {"place": place, "weight": table[place], "bias": bias, "curve": None}


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Train on the given labels (the caller leaves held-out ones out); None without both classes."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                whole = part.column("text").to_pylist()
                found = [sorted({unit(w) for w in units(t)} - {""}) for t in whole]
                prints = np.array([fingerprints(t, hashes) for t in whole], dtype=np.int64).T
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("y"), part.column("text"), pa.array(found, pa.list_(pa.string())), *[pa.array(p) for p in prints]],
                    names=["doc_id", "y", "text", "words", "p0", "p1", "p2", "p3"],
                )

    where = folder(spark, "toxicity")
    rows = sampled(docs, labels, "toxic", MOST_ROWS).mapInArrow(
        run, "doc_id bigint, y int, text string, words array<string>, p0 bigint, p1 bigint, p2 bigint, p3 bigint"
    )
    for p in ("p0", "p1", "p2", "p3"):  # texts that agree on any of four smallest hashes are near copies
        rows = top_rows(rows, [p, "y"], [F.col("doc_id"), F.xxhash64("text")])
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4))
    rows = written(rows.select("doc_id", "y", "text", "words", (part == 0).alias("fits")), where)
    learn = rows.filter(~F.col("fits"))
    totals = {r["y"]: r["n"] for r in learn.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total1, total0 = totals.get(1, 0), totals.get(0, 0)
    if not total1 or not total0:
        remove(spark, where)
        return None
    counts = (
        learn.select("y", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.sum("y").cast("long").alias("n1"), F.sum(1 - F.col("y")).cast("long").alias("n0"))
    )
    more = counts.filter((F.col("n1") * total0 > 3 * F.col("n0") * total1) & (F.col("n1") >= 2))
    top = more.orderBy(F.desc(F.col("n1") / (F.col("n0") + 1)), "word").limit(CANDIDATES).collect()
    candidates = [(r["word"], r["n1"], r["n0"]) for r in top]
    common = counts.filter("n0 > 0 and 3 * n0 * %d >= n1 * %d" % (total1, total0))
    ordinary = [r["word"] for r in common.orderBy(F.xxhash64("word"), "word").limit(ORDINARY).collect()]
    number = {w: k for k, (w, _, _) in enumerate(candidates)}
    known = F.broadcast(spark.createDataFrame([(w, k) for w, k in number.items()], "word string, k int"))
    bags = (
        learn.filter("y = 1").select("doc_id", F.explode("words").alias("word")).join(known, "word")
        .groupBy("doc_id").agg(F.sort_array(F.collect_set("k")).alias("ks")).orderBy("doc_id").collect()
    )
    model = fit(candidates, ordinary, [r["ks"] for r in bags], total1, total0)
    if model is not None:
        shared = spark.sparkContext.broadcast(model)

        def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(shared.value)
            for batch in batches:
                for piece in slices(batch, "text", SLICE_BYTES):
                    m = scorer.texts(piece.column("text").to_pylist())
                    yield pa.record_batch([piece.column("y"), pa.array(m[:, 0]), pa.array(m[:, 1]), pa.array(m[:, 2])], names=["y", "m1", "m2", "n"])

        got = rows.filter("fits").select("y", "text").mapInArrow(margins, "y int, m1 double, m2 double, n double").collect()
        got.sort(key=tuple)  # sums do not depend on the order of partitions
        x = np.array([[r["m1"], r["m2"], r["n"]] for r in got]).reshape(-1, 3)
        model["curve"] = logistic(x, np.array([r["y"] for r in got], dtype=float)) if len(got) else np.array([4.0, 0.0, 0.0, 0.0])
    remove(spark, where)
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents with ``score``: how likely they are toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = docs.select(F.struct(*[c for c in docs.columns if c != "score"]).alias("rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        scorer = Scorer(own) if own is not None else None
        for batch in batches:
            text = pc.fill_null(pc.struct_field(batch.column("rest"), "text").cast(pa.string()), "")
            for part in slices(pa.record_batch([batch.column("rest"), text], names=["rest", "text"]), "text", SLICE_BYTES):
                scores = np.zeros(part.num_rows)
                if scorer is not None:
                    x = np.c_[scorer.texts(part.column("text").to_pylist()), np.ones(part.num_rows)]
                    scores = 1 / (1 + np.exp(-np.clip(x @ own["curve"], -35, 35)))
                yield pa.record_batch([part.column("rest"), pa.array(scores)], names=["rest", "score"])

    rest = held.schema["rest"].dataType.simpleString()
    return held.mapInArrow(run, f"rest {rest}, score double").select("rest.*", "score")
