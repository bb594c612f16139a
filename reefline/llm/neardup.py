"""MinHash near-dedup with HyperMinHash registers.

A document's shingles (five words) are hashed once. The hash picks one of 128
buckets; the bucket keeps the smallest value, stored as its count of leading
zeros (6 bits) and the 10 bits after the leading one: 16 bits a register. Empty
buckets borrow from a fixed random order of buckets, so short sets band as well
as long ones. Bands of four registers post each distinct text; a pair at
similarity 0.75 shares none of 32 bands with probability 5e-6.

In a band's bucket one member, chosen by hash, is the hub: every other member is
compared with it, not with all. Pairs pass a collision-corrected estimate of the
Jaccard similarity, then an exact count on full shingle sets. What the hubs did
not join meets again: in a bucket that holds several components, members outside its
largest are compared with all members of other components, in blocks of bounded
size on full shingle sets, and only pairs that reach the threshold leave the task.
So no link between components is lost to the choice of hubs. Components come from
star steps over written tables in the shared folder.

Exact copies (same words in lower case) are one member with many documents.

Cases: null or empty text has no shingles, links with nothing and is kept. Texts
of fewer than five words are one shingle. Rows without doc_id take no part:
component null, kept. Rows with one doc_id share the component of the id. Other
columns are handed on; a column named like an output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reefline.llm.common import SLICE_BYTES, folder, remove, ship, slices, written
from reefline.llm.substrings import WordHashes, mixed, rolling

ship(__name__)

SHINGLE = 5
REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
ZERO_BITS, TAIL_BITS = 6, 10
# The estimate must miss the threshold by five standard errors before a pair is dropped unverified.
ERRORS = 5.0
BLOCK = 2_048  # members of a bucket that one task takes from each of two blocks
A_TO_Z = bytes(range(256)).lower()  # lower-cases A-Z, leaves all other bytes


def shingles(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = text.translate(A_TO_Z).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    return np.unique(mixed(rolling(hashes(words), min(SHINGLE, len(words))) + np.uint64(min(SHINGLE, len(words)) % SHINGLE)))


def borrow_order() -> np.ndarray:
    """For each register, the order in which it looks for a filled bucket; itself first."""
    rng = np.random.default_rng(20240229)
    order = np.argsort(rng.random((REGISTERS, REGISTERS)), axis=1)
    own = np.arange(REGISTERS)
    rest = order[order != own[:, None]].reshape(REGISTERS, REGISTERS - 1)
    return np.concatenate([own[:, None], rest], axis=1)


def registers(own: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The 16-bit registers of a non-empty set of hashes."""
    bucket = (own >> np.uint64(57)).astype(np.int64)
    value = own & np.uint64((1 << 57) - 1)
    least = np.full(REGISTERS, np.uint64(1 << 57), dtype=np.uint64)
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])  # sorted by bucket, then value
    least[bucket[start]] = value[start]
    filled = least < np.uint64(1 << 57)
    if not filled.all():
        least = least[order[np.arange(REGISTERS), filled[order].argmax(axis=1)]]
    bits = np.maximum(least, np.uint64(1)).astype(np.float64)
    length = np.frexp(bits)[1]  # bits from the leading one on; rounding up only shifts a tie
    zeros = np.minimum(57 - length, (1 << ZERO_BITS) - 1)
    shift = length - 1 - TAIL_BITS
    tail = np.where(shift >= 0, least >> np.maximum(shift, 0).astype(np.uint64), least << np.maximum(-shift, 0).astype(np.uint64))
    tail &= np.uint64((1 << TAIL_BITS) - 1)
    return ((zeros.astype(np.uint64) << np.uint64(TAIL_BITS)) | tail).astype(np.uint16)


def chance(size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Expected share of registers on which two disjoint sets agree by accident.

    A register with z leading zeros holds the least of about n/128 values. The
    agreement is the sum over all codes of the product of both probabilities.
    """
    a, b = np.maximum(size_a / REGISTERS, 1e-9), np.maximum(size_b / REGISTERS, 1e-9)
    total = np.zeros(len(a))
    cells = 1 << TAIL_BITS
    for z in range(40):
        width = 2.0 ** -(z + 1) / cells
        for part in range(8):  # eight stretches of equal codes stand for all of them
            low = 2.0 ** -(z + 1) * (1 + (part + 0.5) / 8)
            total += (cells / 8) * np.minimum(1, a * width * np.exp(-a * low)) * np.minimum(1, b * width * np.exp(-b * low))
    return np.minimum(total, 0.5)


def signatures(docs: DataFrame) -> DataFrame:
    """``member`` (hash pair of the lower-cased words), ``doc_id``, ``n_shingles``, ``sig`` and ``bands``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, order = WordHashes(), borrow_order()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES // 2):
                member, count, sig, bands = [], [], [], []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    own = shingles(text, hashes)
                    count.append(len(own))
                    if not len(own):
                        member.append(b"")
                        sig.append(None)
                        bands.append(None)
                        continue
                    member.append(xxhash.xxh3_128_digest(b" ".join(text.translate(A_TO_Z).split())))
                    regs = registers(own, order)
                    sig.append(regs.tobytes())
                    packed = regs.view(np.uint64) ^ (np.arange(BANDS, dtype=np.uint64) << np.uint64(58))
                    bands.append(mixed(packed + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        pa.array(member, pa.binary()),
                        pa.array(count, pa.int64()),
                        pa.array(sig, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "member", "n_shingles", "sig", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, member binary, n_shingles bigint, sig binary, bands array<bigint>"
    )


def likely(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose sizes allow the threshold and whose corrected estimate does not rule it out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            shape = (batch.num_rows, REGISTERS)
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(shape) for c in ("sig_a", "sig_b")
            )
            n, m = (batch.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b"))
            accident = chance(n, m)
            seen = (a == b).mean(axis=1)
            estimate = (seen - accident) / (1 - accident)
            error = np.sqrt(threshold * (1 - threshold) / np.minimum(REGISTERS, np.minimum(n, m)))
            keep = estimate >= threshold - ERRORS * error
            yield pa.record_batch([c.filter(pa.array(keep)) for c in (batch.column("a"), batch.column("b"))], names=["a", "b"])

    one = sigs.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sig").alias("sig_a"))
    two = sigs.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sig").alias("sig_b"))
    return (
        pairs.join(one, "a")
        .join(two, "b")
        .filter(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
        .select("a", "b", "n_a", "n_b", "sig_a", "sig_b")
        .mapInArrow(run, "a bigint, b bigint")
    )


def verified(pairs: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold, as whole numbers: 100 i >= 100 t u."""
    percent = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        before, left = None, np.empty(0, dtype=np.uint64)
        for batch in batches:
            for part in slices(batch, "text_b", SLICE_BYTES // 4):
                keep = []
                ids = part.column("a").to_pylist()
                texts_a, texts_b = part.column("text_a"), part.column("text_b")
                for k in range(part.num_rows):
                    if ids[k] != before:
                        before, left = ids[k], shingles(texts_a[k].as_py().encode(), hashes)
                    right = shingles(texts_b[k].as_py().encode(), hashes)
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    keep.append(100 * both >= percent * (len(left) + len(right) - both))
                keep = pa.array(keep)
                yield pa.record_batch([part.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    # The hints keep one plan at every size: what is needed grows with the data.
    used = held.join(needed.hint("shuffle_hash"), "doc_id", "left_semi")
    return (
        pairs.hint("shuffle_hash")
        .join(used.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(used.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
        .select("a", "b", "text_a", "text_b")
        .mapInArrow(run, "a bigint, b bigint")
    )


def unjoined(labelled: DataFrame) -> DataFrame:
    """Rows (``band, doc_id, part``) of buckets with several components, with the bucket's number of ``blocks``."""
    split = (
        labelled.groupBy("band")
        .agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("n"))
        .filter("low < high")
    )
    return labelled.join(split, "band").select("band", "doc_id", "part", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))


def shingle_sets(held: DataFrame, open_rows: DataFrame) -> DataFrame:
    """``doc_id`` and the packed shingle set, of the documents in unjoined buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES // 2):
                sets = [shingles(t, hashes).tobytes() for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.record_batch([part.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "packed"])

    needed = open_rows.select("doc_id").distinct().hint("shuffle_hash")
    return held.join(needed, "doc_id", "left_semi").mapInArrow(run, "doc_id bigint, packed binary")


def links_across(open_rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of one bucket in different components whose full shingle sets reach the threshold.

    A bucket is cut into blocks of bounded size; a task compares two blocks. It
    emits only pairs that pass, never all pairs.
    """
    percent = round(100 * threshold)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        ids, parts, block = (group[c].to_numpy() for c in ("doc_id", "part", "block"))
        own = [np.frombuffer(x, dtype=np.uint64) for x in group["packed"]]
        size = np.array([len(x) for x in own])
        owner = np.repeat(np.arange(len(own)), size)
        value = np.concatenate(own)
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        names, counts = np.unique(parts, return_counts=True)
        most = names[counts.argmax()]
        same_block = group["one"].iloc[0] == group["two"].iloc[0]
        found = []
        for k in np.flatnonzero(parts != most):  # the rest of the pairs lies within one component
            first, last = (np.searchsorted(value, own[k], side=s) for s in ("left", "right"))
            spans = [owner[a:b] for a, b in zip(first, last)]
            both = np.bincount(np.concatenate(spans), minlength=len(own))
            union = size[k] + size - both
            near = (100 * both >= percent * union) & (parts != parts[k])
            near &= (block == block[k]) if same_block else (block != block[k])
            found += [(min(ids[k], ids[j]), max(ids[k], ids[j])) for j in np.flatnonzero(near)]
        return pd.DataFrame(sorted(set(found)), columns=["a", "b"], dtype="int64")

    block = F.pmod(F.xxhash64("doc_id", F.lit("block")), F.col("blocks")).cast("int")
    dealt = (
        open_rows.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("band", "doc_id", "part", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    )
    return dealt.join(sets.hint("merge"), "doc_id").groupBy("band", "one", "two").applyInPandas(run, "a long, b long").distinct()


def components(nodes_of: DataFrame, where: str) -> DataFrame:
    """``doc_id`` and the smallest id of its component, for every id in the links ``a, b``.

    Large-star and small-star steps: a node's larger neighbours, then its smaller
    ones, are tied to the least neighbour, until nothing changes.
    """
    links = nodes_of.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    step, before = 0, None
    links = written(links, f"{where}/0")
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter(F.col("a") != F.col("b")).distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(floor, "a")
            .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter(F.col("a") != F.col("b"))
            .distinct()
        )
        step += 1
        links = written(small, f"{where}/{step}")
        remove(nodes_of.sparkSession, f"{where}/{step - 1}")
        # two sums over all links tell whether a step changed any
        now = links.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("doc_id"), F.col("b").alias("component_id"))


def near_duplicates(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The documents with ``n_shingles``, ``component_id`` and ``kept``."""
    spark = docs.sparkSession
    where = folder(spark, "neardup")
    outputs = ("n_shingles", "component_id", "kept")
    plain = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).filter(F.col("doc_id").isNotNull())
    signed = written(signatures(plain), f"{where}/signed")
    # One document stands for its exact copies; an id with several texts stands in several groups.
    firsts = signed.filter("n_shingles > 0").groupBy("member").agg(F.min("doc_id").alias("first"))
    member_rows = signed.filter("n_shingles > 0").select("doc_id", "member").join(firsts, "member")
    copies = member_rows.select(F.col("doc_id").alias("a"), F.col("first").alias("b")).filter("a <> b")
    sigs = written(
        signed.filter("n_shingles > 0")
        .join(firsts, "member")
        .filter(F.col("doc_id") <= F.col("first"))
        .select("doc_id", "n_shingles", "sig", "bands", "member")
        .dropDuplicates(["doc_id", "member"]),
        f"{where}/members",
    )
    posts = sigs.select(F.explode("bands").alias("band"), "doc_id")
    scatter = F.xxhash64("band", "doc_id")
    hubs = (
        posts.groupBy("band")
        .agg(F.min(F.struct(scatter.alias("s"), F.col("doc_id"))).alias("hub"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("band", F.col("hub.doc_id").alias("hub"))
    )
    crowded = written(posts.join(hubs, "band"), f"{where}/crowded")
    pairs = written(
        crowded.filter("doc_id <> hub")
        .select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b"))
        .distinct(),
        f"{where}/pairs",
    )
    links = written(verified(written(likely(pairs, sigs, threshold), f"{where}/likely"), plain, threshold), f"{where}/links")
    joined = components(links, f"{where}/first")
    labelled = crowded.select("band", "doc_id").join(joined, "doc_id", "left").withColumn(
        "part", F.coalesce("component_id", "doc_id")
    )
    open_rows = written(unjoined(labelled), f"{where}/open")
    more = links_across(open_rows, shingle_sets(plain, open_rows), threshold)
    parts = components(links.union(more).union(copies), f"{where}/second")
    sizes = signed.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    result = written(
        sizes.join(parts, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id")),
        f"{folder(spark, 'neardup-result')}",
    )
    remove(spark, where)
    held = docs.select(
        F.struct(*[c for c in docs.columns if c not in outputs]).alias("rest"), F.col("doc_id").cast("bigint").alias("doc_id")
    )
    return (
        held.join(result, "doc_id", "left")
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        .select("rest.*", F.coalesce("n_shingles", F.lit(0)).cast("bigint").alias("n_shingles"), "component_id", "kept")
    )
