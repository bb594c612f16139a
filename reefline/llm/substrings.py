"""Substring dedup: repeated windows of words, found by Rabin-Karp hashes.

Every window of ``size`` words of every document gets a rolling polynomial hash.
A window can only repeat if its anchor does (the smallest hash among the shorter
word runs inside the window, which depends on the window's words alone). Spark
therefore counts anchors first, about one for 16 windows, and then the windows
whose anchor stands in two different texts; no other window can have a partner.
A window is removed if a document with a smaller doc_id holds it; removed
windows merge into maximal intervals of words.

Exact copies of a text are settled by the text's hash: in all but the smallest
doc_id every window starts in a smaller document. So a large group of copies
costs one row a copy.

Cases: words are runs without ASCII white space, unchanged; null text has none.
Texts of fewer than ``size`` words lose nothing. A row without doc_id neither
removes nor loses words. Rows with one doc_id and different texts do not remove
each other's words; equal rows get equal results. Other columns are handed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reefline.llm.common import SLICE_BYTES, folder, remove, ship, slices, written

ship(__name__)

ANCHOR_WORDS = 20
BASE = 0x9E3779B97F4A7C15
CACHED_WORDS = 300_000


class WordHashes:
    """64-bit hashes of words, with a bounded cache."""

    def __init__(self):
        import xxhash

        self.known: dict[bytes, int] = {}
        self.hash = xxhash.xxh3_64_intdigest

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.hash(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a polynomial hash (an invertible map)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(a: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash, modulo 2**64, of each run of ``size`` values. Longer runs join shorter ones."""
    if size == 1:
        return a
    half = size // 2
    h = rolling(a, half)
    h = h[: len(h) - half] * np.uint64(pow(BASE, half, 1 << 64)) + h[half:]
    return h if size % 2 == 0 else h[:-1] * np.uint64(BASE) + a[size - 1 :]


def sliding_least(a: np.ndarray, size: int) -> np.ndarray:
    """Smallest of each run of ``size`` values."""
    width = 1
    while 2 * width <= size:
        a = np.minimum(a[: len(a) - width], a[width:])
        width *= 2
    rest = size - width
    return np.minimum(a[: len(a) - rest], a[rest:]) if rest else a


def anchors_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """The anchor of each window."""
    inner = min(ANCHOR_WORDS, size)
    return sliding_least(mixed(rolling(hashes, inner)), size - inner + 1)


def _intervals(starts: np.ndarray, size: int) -> list[dict]:
    """Maximal runs of words that windows at the sorted ``starts`` cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > size) + 1
    first = starts[np.r_[0, cut]]
    last = starts[np.r_[cut - 1, len(starts) - 1]] + size
    return [{"start": int(a), "end": int(b)} for a, b in zip(first, last)]


def drop_repeated(docs: DataFrame, size: int = 50) -> DataFrame:
    """The documents with ``text`` as the kept words joined by one space, ``n_words`` before,
    ``n_removed`` and ``removed`` (word intervals, end exclusive)."""
    spark = docs.sparkSession
    outputs = ("text", "n_words", "n_removed", "removed")
    # The texts' hashes are never null, so both joins below use one exchange of the texts.
    held = docs.select(
        F.struct(*[c for c in docs.columns if c not in outputs]).alias("rest"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).select("rest", "doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("text"), "text").alias("t2"))
    numbered = held.filter(F.col("doc_id").isNotNull())

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch, "text"):
                keys, found = [], []
                for t1, text in zip(part.column("t1").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                    words = text.split()
                    if len(words) >= size:
                        own = np.unique(anchors_of(hashes(words), size)).view(np.int64)
                        found.append(own)
                        keys.append(np.full(len(own), t1, dtype=np.int64))
                if found:
                    yield pa.record_batch([np.concatenate(found), np.concatenate(keys)], names=["anchor", "t1"])

    where = folder(spark, "substrings")
    anchors = written(
        numbered.select("t1", "text").mapInArrow(anchor_rows, "anchor bigint, t1 bigint"), f"{where}/anchors"
    )
    repeated = (
        anchors.groupBy("anchor")
        .agg(F.min("t1").alias("low"), F.max("t1").alias("high"))
        .filter(F.col("low") < F.col("high"))
        .select("anchor")
    )
    shared = written(
        anchors.join(repeated, "anchor").groupBy("t1").agg(F.collect_set("anchor").alias("anchors")),
        f"{where}/shared",
    )
    remove(spark, f"{where}/anchors")
    first = numbered.groupBy("t1", "t2").agg(F.min("doc_id").alias("first_doc"))

    def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES // 4):
                found: list[list[np.ndarray]] = [[], [], [], []]
                sought = part.column("anchors")
                for k, text in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                    own = hashes(text.split())
                    mine = np.isin(anchors_of(own, size), sought[k].values.to_numpy().view(np.uint64))
                    starts = np.flatnonzero(mine)
                    found[0].append(mixed(rolling(own, size))[starts].view(np.int64))
                    for c, name in ((1, "t1"), (2, "doc_id")):
                        found[c].append(np.full(len(starts), part.column(name)[k].as_py(), dtype=np.int64))
                    found[3].append(starts.astype(np.int32))
                if found[0]:
                    yield pa.record_batch([np.concatenate(c) for c in found], names=["window", "t1", "doc_id", "start"])

    # "at most" is "equal" here; as an equality it would become a join key and move the texts again
    windows = (
        held.join(shared.join(first, "t1"), ["t1", "t2"])
        .filter(F.col("doc_id") <= F.col("first_doc"))
        .select("rest", "t1", "doc_id", "text", "anchors")
        .mapInArrow(window_rows, "window bigint, t1 bigint, doc_id bigint, start int")
    )
    counted = (
        windows.groupBy("window")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        .filter(F.col("least") < F.col("most"))
        .select("window", "least")
    )
    starts = (
        windows.join(counted, "window")
        .filter(F.col("doc_id") > F.col("least"))
        .groupBy("t1", "doc_id")
        .agg(F.collect_set("start").alias("starts"))
    )
    removals = first.join(
        starts.select("t1", F.col("doc_id").alias("first_doc"), "starts"), ["t1", "first_doc"], "left"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text, n_words, n_removed, removed = [], [], [], []
                copies = part.column("copy").to_pylist()
                sought = part.column("starts")
                for k, t in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                    words = t.split()
                    gone: list[dict] = []
                    if copies[k] and len(words) >= size:
                        gone = [{"start": 0, "end": len(words)}]
                    elif not copies[k] and sought[k].is_valid:
                        gone = _intervals(np.sort(sought[k].values.to_numpy()), size)
                    at, kept = 0, []
                    for g in gone:
                        kept += words[at : g["start"]]
                        at = g["end"]
                    kept += words[at:]
                    text.append(b" ".join(kept))
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(kept))
                    removed.append(gone)
                yield pa.record_batch(
                    [
                        part.column("rest"),
                        pa.array(text, pa.binary()).cast(pa.string()),
                        pa.array(n_words, pa.int64()),
                        pa.array(n_removed, pa.int64()),
                        pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    ],
                    names=["rest", *outputs],
                )

    rest = held.schema["rest"].dataType.simpleString()
    return (
        held.join(removals, ["t1", "t2"], "left")
        .select(
            "rest",
            "text",
            F.when(F.col("doc_id").isNotNull(), F.col("starts")).alias("starts"),
            F.coalesce(F.col("doc_id") > F.col("first_doc"), F.lit(False)).alias("copy"),
        )
        .mapInArrow(
            cut,
            f"rest {rest}, text string, n_words bigint, n_removed bigint, removed array<struct<start:int,end:int>>",
        )
        .select("rest.*", *outputs)
    )
