"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are compared without case and without punctuation at their ends. Every
n-gram of an item is a seed, however many documents hold it: copies that keep only
n-grams that many others hold too are found like any other. The passages around
seeds are aligned with the item if they hold enough of its words for the score; an
alignment of at least ``least_score`` of the perfect score is a leak. Texts never
move: the one read of the documents is a map.

The benchmark is the stated query set. It is taken in blocks of items of bounded
size, each broadcast; more items mean more reads, not more memory.

A leak also needs ``LEAST_WORDS`` matched words along the alignment. Items that are
not longer may miss one word: end words only if four words match, inner words of
items under six words by a second kind of seed, the pair of end words at the
distances that one edit leaves. Items of two words match as they stand.

Scripts without spaces (Chinese, Japanese kana, Thai, Lao, Burmese, Khmer) are
compared by characters.

Cases: null or empty text leaks nothing; an item of a single word (or none) cannot
be told from ordinary use of that word and matches nothing. Repeated
documents and repeated items give one result each. Rows without doc_id are tested
like others. Other columns are handed on; a column named ``leaks`` is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reefline.llm.common import ship, slices
from reefline.llm.substrings import BASE, mixed, rolling

ship(__name__)

GRAM = 3
LEAST_SCORE = 0.5
LEAST_WORDS = 8  # matched words; shorter items may miss one
PAIRED = 5  # items up to this size may hold no n-gram after one inner edit
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_WORDS = 2_000_000
CACHED_WORDS = 300_000
# Letters of scripts without spaces, and their punctuation.
SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
FULL_WIDTH = re.compile("[\u3000-\u303f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
PUNCTUATION = bytes(c for c in range(128) if not chr(c).isalnum())


class Seeds:
    """Seeds in order with their places, for looking up the hashes of a text."""

    def __init__(self, seeds: np.ndarray, place: np.ndarray, offset: np.ndarray):
        self.distinct, self.start = np.unique(seeds, return_index=True)
        self.stop = np.r_[self.start[1:], len(seeds)]
        self.place, self.offset = place, offset

    def found(self, hashes: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Per item, where in the text and where in the item the seeds stand."""
        out: dict[int, list[tuple[int, int]]] = {}
        if not len(self.distinct):
            return out
        at = np.minimum(np.searchsorted(self.distinct, hashes), len(self.distinct) - 1)
        for h in np.flatnonzero(self.distinct[at] == hashes).tolist():
            for s in range(self.start[at[h]], self.stop[at[h]]):
                out.setdefault(int(self.place[s]), []).append((h, int(self.offset[s])))
        return out


class Words:
    """Hashes of the words of a text. Words of punctuation alone are left out."""

    def __init__(self):
        import xxhash

        self.known: dict[bytes, int] = {}
        self.hash = xxhash.xxh3_64_intdigest

    def __call__(self, text: str) -> np.ndarray:
        text = text.lower()
        if not text.isascii() and SPACELESS.search(text):
            text = SPACELESS.sub(r" \g<0> ", FULL_WIDTH.sub(" ", text))
        words = text.encode().split()
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in set(words).difference(known):
            bare = w.strip(PUNCTUATION)
            known[w] = (self.hash(bare) | 1) if bare else 0
        out = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        return out[out != 0]


def grams(words: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams."""
    return mixed(rolling(words, GRAM)) if len(words) >= GRAM else words[:0]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment of two word sequences: its score, and the words matched at most for that score."""
    unit = len(item) + 1  # a cell is its score times this, plus the matched words
    gap = GAP * unit
    steps = np.arange(1, len(passage) + 1, dtype=np.int64) * -gap
    row = np.zeros(len(passage) + 1, dtype=np.int64)
    best = 0
    for word in item:
        diagonal = row[:-1] + np.where(passage == word, MATCH * unit + 1, MISMATCH * unit)
        now = np.maximum(np.maximum(diagonal, row[1:] + gap), 0)
        # a gap along the passage costs the same each step, so it is a running maximum
        now = np.maximum(now, np.maximum.accumulate(now + steps) - steps)
        row[1:] = now
        best = max(best, int(now.max(initial=0)))
    return divmod(best, unit)


def pairs(first: np.ndarray, last: np.ndarray, apart: int) -> np.ndarray:
    """Hashes of pairs of words that stand ``apart`` words from each other."""
    return mixed(first * np.uint64(BASE) + last + np.uint64(apart))


def least_matched(size: int, ends: bool) -> int:
    """How many words of an item must match; ``ends``: both its end words do."""
    if size <= 3:
        return size
    return min(LEAST_WORDS, max(size - 1, 3 if ends else 4))


def passages(at: np.ndarray, offset: np.ndarray, size: int, length: int) -> list[tuple[int, int]]:
    """Stretches of a document where an item of ``size`` words with seeds at ``at`` may lie; overlaps merged."""
    slack = size // 4 + 4
    first = np.maximum(at - offset - slack, 0)
    last = np.minimum(at - offset + size + slack, length)
    order = np.argsort(first, kind="stable")
    out: list[tuple[int, int]] = []
    for a, b in zip(first[order].tolist(), last[order].tolist()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items as word hashes, in blocks of bounded size."""
    block, size = [], 0
    words = Words()
    for row in benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).toLocalIterator():
        own = words(row[1] or "")
        if len(own) < 2:
            continue
        if block and size + len(own) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row[0], own))
        size += len(own)
    if block:
        yield block


def seeds_of(items: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds in order, with the item's place in the block and the offset in the item."""
    return _sorted([grams(words) for _, words in items])


def pair_seeds(items: list[tuple[int, np.ndarray]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per distance, the pairs of end words of short items, as ``seeds_of`` gives n-grams."""
    out = {}
    for apart in range(1, PAIRED + 1):
        # short of as many words as must match, or with one word more than the item (two words: as they stand)
        fits = [least_matched(len(w), True) <= apart + 1 <= len(w) + (len(w) > 2) and len(w) <= PAIRED for _, w in items]
        if any(fits):
            out[apart] = _sorted([pairs(w[:1], w[-1:], apart) if fit else w[:0] for fit, (_, w) in zip(fits, items)])
    return out


def _sorted(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = [len(g) for g in own]
    seeds, place = np.concatenate(own), np.repeat(np.arange(len(own)), sizes)
    offset = np.concatenate([np.arange(n) for n in sizes])
    order = np.lexsort((offset, place, seeds))
    return seeds[order], place[order], offset[order]


def find_leaks(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents with ``leaks``: ``item_id``, ``score`` (share of the perfect score) and ``words`` (matched)."""
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in ("leaks", "text")]
    held = docs.select(
        F.struct(*columns).alias("rest"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.col("text").isNull().alias("empty"),
        F.expr("cast(array() as array<struct<item_id:bigint,score:double,words:int>>)").alias("leaks"),
    )
    schema = held.schema
    leak = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("words", pa.int32())]))
    for items in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast((items, seeds_of(items), pair_seeds(items)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            words = Words()
            known, seeds, ends = shared.value
            seeds, ends = Seeds(*seeds), {apart: Seeds(*s) for apart, s in ends.items()}
            for batch in batches:
                for part in slices(batch, "text"):
                    leaks = part.column("leaks").to_pylist()
                    for row, text in enumerate(part.column("text").to_pylist()):
                        own = words(text)
                        # per item, the passages and whether both end words are known to stand in them
                        by_item: dict[int, list[tuple[np.ndarray, bool]]] = {}
                        for k, at in seeds.found(grams(own)).items():
                            where, shift = (np.array(c) for c in zip(*at))
                            size = len(known[k][1])
                            by_item[k] = [(own[a:b], False) for a, b in passages(where, shift, size, len(own))]
                        for apart, pair in ends.items():
                            for k, at in pair.found(pairs(own[:-apart], own[apart:], apart)).items():
                                by_item.setdefault(k, []).extend((own[h : h + apart + 1], True) for h, _ in at)
                        for k, near in sorted(by_item.items()):
                            item_id, item = known[k]
                            found = []
                            for passage, both in near:
                                # each word of the item adds MATCH at most, and only if the passage holds it
                                if np.isin(item, passage).sum() >= least_score * len(item):
                                    best, matched = align(item, passage)
                                    if best >= least_score * MATCH * len(item) and matched >= least_matched(len(item), both):
                                        found.append((best, matched))
                            if found:
                                best, matched = max(found)
                                leaks[row].append({"item_id": item_id, "score": best / (MATCH * len(item)), "words": matched})
                    yield pa.record_batch(
                        [part.column("rest"), part.column("text"), part.column("empty"), pa.array(leaks, leak)],
                        names=["rest", "text", "empty", "leaks"],
                    )

        held = held.mapInArrow(run, schema)
    order = [("rest." + f"`{c}`") if c != "text" else F.when(~F.col("empty"), F.col("text")).alias("text") for c in docs.columns if c != "leaks"]
    return held.select(*order, "leaks")
