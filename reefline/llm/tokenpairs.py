"""Cross-tokenizer alignment by divide and conquer at shared cuts.

Two tokenizers cut one byte string. Where a token of each ends at the same byte
lies a shared cut; between neighbouring shared cuts lies one group. An interval
that starts and ends at shared cuts is split at a shared cut near its middle,
which bisecting the other tokenizer's ends finds (leaping right from the middle,
then left), and both halves are split in turn; an interval without inner cut is
a leaf, that is, a group. All intervals of a slice of texts are split together,
one depth at a time, with numpy.

Links are the pairs of an A and a B token whose bytes overlap. Each slice keeps
one dictionary of its id pairs with their numbers of links; Spark sums these
over the corpus, finds each B id's highest count, and hands the counts back to
the slices, so a pair that every text holds is one row a slice, not one a text.

Encoding: A is a byte-level BPE (``<space>text``), B a piece BPE with byte
fallback, which puts the space itself. Texts are encoded in units that start at
a space after a character that is no white space: A's pieces never span such a
place, and neither do B's (checked when the model is read, else texts stay
whole), so units are encoded once and cached within a byte bound.

Cases: null and empty texts have no tokens, nor have texts whose joined B bytes
differ (say, ones with U+2581): zeros and an empty digest. Rows are independent
(repeated rows and ids each get a row and count in the corpus), ``doc_id`` may
be null, other columns are left out, an empty table gives no rows. A very long
text is a slice of its own and needs some 120 bytes a token; a unit without
any space is encoded in one call.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reefline.llm.bpe import byte_letters
from reefline.llm.common import folder, ship, slices, texts, written

ship(__name__)

SLICE_BYTES = 3 * 1024 * 1024
CACHE_BYTES = 80 * 1024 * 1024
# A unit starts at a space that follows a character other than white space.
UNITS = re.compile(r" \s*\S+(?:[^\S ]\s*\S+)*|\s+")
# Fixed value: the pieces that the byte-level vocabulary's merges stay within.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_models(byte_bpe: str, pieces: str) -> dict:
    """Both vocabulary files, to be broadcast: bounded by the vocabularies."""
    with open(byte_bpe, encoding="utf-8") as f:
        spec = json.load(f)
    letters = {c: b for b, c in enumerate(byte_letters())}
    special = {t["content"] for t in spec["added_tokens"] if t["special"]}
    ranks = {bytes(letters[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
    with open(pieces, "rb") as f:
        return {"ranks": ranks, "pieces": f.read()}


class Tokenizers:
    """Both tokenizers with a cache of encoded units; one per Python worker."""

    def __init__(self, models: dict):
        import sentencepiece
        import tiktoken

        self.a = tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks=models["ranks"], special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=models["pieces"])
        n = self.b.get_piece_size()
        names = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [
            bytes([int(w[1:-1], 16)]) if self.b.is_byte(i) else w.replace("▁", " ").encode() for i, w in enumerate(names)
        ]
        self.cuttable = not any(re.search("[^▁]▁", w) for w in names)
        size_a = max(models["ranks"].values()) + 1
        self.a_sizes = np.zeros(size_a, np.int64)
        for w, i in models["ranks"].items():
            self.a_sizes[i] = len(w)
        self.b_sizes = np.array([len(b) for b in self.b_bytes], np.int64)
        # what a token adds to the written groups: its id and the mark behind it
        self.words = pa.array([f"{i}{m}" for m in ",|" for i in range(size_a)] + [f"{i}{m}" for m in (",", ";", "") for i in range(n)], pa.large_string())
        self.cache: dict[str, tuple[bytes, bytes, bool]] = {}
        self.held = 0

    def learn(self, units: set[str]) -> dict[str, tuple[bytes, bytes, bool]]:
        """A's and B's ids (32-bit) of units, and whether B's bytes are the unit."""
        new = list(units)
        spelled = self.b_bytes
        found = {}
        for text, b in zip(new, self.b.encode([u[1:] for u in new], num_threads=1)):
            same = b"".join([spelled[i] for i in b]) == text.encode()
            found[text] = array("i", self.a.encode_ordinary(text)).tobytes(), array("i", b).tobytes(), same
        return found

    def units(self, text: str) -> list[str]:
        text = " " + text
        units = UNITS.findall(text) if self.cuttable else [text]
        # B's library encodes nothing for the empty text, which a lone trailing space would be
        if len(units) > 1 and units[-1].isspace():
            units[-2:] = ["".join(units[-2:])]
        return units

    def encode(self, batch: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """A's and B's ids of each text; none if the joined bytes differ."""
        cut = [self.units(t) if t else [] for t in batch]
        new = set().union(*cut).difference(self.cache)
        self.held += sum([400 + 5 * len(u) for u in new])
        if self.held > CACHE_BYTES:  # what this batch needs is looked up anew
            self.cache = {}
            new = set().union(*cut)
            self.held = sum([400 + 5 * len(u) for u in new])
        self.cache.update(self.learn(new))
        for text, units in zip(batch, cut):
            found = [self.cache[u] for u in units]
            ids_a, ids_b = b"".join([f[0] for f in found]), b"".join([f[1] for f in found])
            if not all([f[2] for f in found]):
                if b"".join([self.b_bytes[i] for i in np.frombuffer(ids_b, np.int32)]) != f" {text}".encode():
                    ids_a = ids_b = b""
            yield ids_a, ids_b
        if self.held > CACHE_BYTES:
            self.cache, self.held = {}, 0


def group_ends(a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Positions in ``a`` whose ends close a group, sorted.

    ``a`` and ``b`` are increasing end offsets; ``first`` and ``last`` are the
    first and last positions in ``a`` of intervals that end at shared cuts.
    """
    done = []
    s, e, c = first, last, last  # interval, and where its possible inner cuts stop
    while len(s):
        leaf = c <= s
        done.append(e[leaf])
        s, e, c = s[~leaf], e[~leaf], c[~leaf]
        middle = (s + c - 1) // 2
        right = _leap(a, b, middle, c, up=True)
        miss = np.flatnonzero(right < 0)
        left = _leap(a, b, middle[miss] - 1, s[miss], up=False)
        done.append(e[miss])  # behind a cut on the left, or without any, lies a leaf
        some = left >= 0
        hit = right >= 0
        at, mid = right[hit], middle[hit]
        lower = s[miss][some]
        s, e, c = (
            np.concatenate([s[hit], at + 1, lower]),
            np.concatenate([at, e[hit], left[some]]),
            np.concatenate([mid, c[hit], left[some]]),
        )
    return np.sort(np.concatenate(done)) if done else np.zeros(0, np.int64)


def _leap(a: np.ndarray, b: np.ndarray, start: np.ndarray, bound: np.ndarray, up: bool) -> np.ndarray:
    """The nearest position from ``start`` on whose end ``b`` shares, before ``bound`` (or down to it); else -1."""
    found = np.full(len(start), -1, np.int64)
    at = start.copy()
    open_ = np.flatnonzero(at < bound if up else at >= bound)
    while len(open_):
        ends = a[at[open_]]
        if up:
            near = b[np.searchsorted(b, ends)]
        else:
            k = np.searchsorted(b, ends, side="right") - 1
            near = np.where(k >= 0, b[k], -1)
        hit = near == ends
        found[open_[hit]] = at[open_[hit]]
        open_, near = open_[~hit], near[~hit]
        at[open_] = np.searchsorted(a, near) if up else np.searchsorted(a, near, side="right") - 1
        open_ = open_[at[open_] < bound[open_] if up else at[open_] >= bound[open_]]
    return found


def align_slice(tools: Tokenizers, batch: list[str | None], keep_groups: bool) -> tuple[dict, np.ndarray, np.ndarray]:
    """Columns per text, and the slice's id pairs (``a << 32 | b``) with their links."""
    pairs = list(tools.encode(batch))
    n_a = np.array([len(p[0]) // 4 for p in pairs], np.int64)
    n_b = np.array([len(p[1]) // 4 for p in pairs], np.int64)
    ids_a = np.frombuffer(b"".join([p[0] for p in pairs]), np.int32)
    ids_b = np.frombuffer(b"".join([p[1] for p in pairs]), np.int32)
    del pairs
    ends_a, ends_b = tools.a_sizes[ids_a].cumsum(), tools.b_sizes[ids_b].cumsum()
    stop_a, stop_b = n_a.cumsum(), n_b.cumsum()
    some = n_a > 0
    cuts = group_ends(ends_a, ends_b, (stop_a - n_a)[some], stop_a[some] - 1)
    last_b = np.searchsorted(ends_b, ends_a[cuts])  # the B token that ends each group
    text_of_group = np.searchsorted(stop_a, cuts, side="right")
    n_groups = np.bincount(text_of_group, minlength=len(batch))

    # each stretch between neighbouring ends, of A or B, is one link
    shared_a, shared_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    shared_a[cuts], shared_b[last_b] = True, True
    order = np.argsort(np.concatenate([ends_a, ends_b[~shared_b]]), kind="stable")
    ends_of_a = order < len(ids_a)
    ends_of_b = ~ends_of_a
    ends_of_b[ends_of_a] = shared_a
    link_a, link_b = ends_of_a.cumsum() - ends_of_a, ends_of_b.cumsum() - ends_of_b
    n_links = n_a + n_b - n_groups
    text = np.repeat(np.arange(len(batch)), n_links)
    linked = ids_a[link_a].astype(np.int64) * len(tools.b_sizes) + ids_b[link_b]
    del order, ends_of_a, ends_of_b, link_a, link_b
    known, place, weight = np.unique(linked, return_inverse=True, return_counts=True)
    held, times = np.unique(text * len(known) + place, return_counts=True)
    of_text = held // max(len(known), 1)
    stops = np.searchsorted(of_text, np.arange(len(batch) + 1)).astype(np.int32)
    del linked, place, text

    joined = _written(tools, ids_a, ids_b, cuts, last_b, stop_a, stop_b)
    columns = {
        "n_a": n_a,
        "n_b": n_b,
        "n_groups": n_groups,
        "n_links": n_links,
        "groups_sha256": [hashlib.sha256(g).hexdigest() if len(g) else "" for g in joined],
        "groups": [str(g, "ascii") for g in joined] if keep_groups else pa.nulls(len(batch), pa.string()),
        "pair_at": pa.ListArray.from_arrays(stops, pa.array((held % max(len(known), 1)).astype(np.int32))),
        "pair_n": pa.ListArray.from_arrays(stops, pa.array(times.astype(np.int32))),
    }
    a, b = np.divmod(known, len(tools.b_sizes))
    return columns, a << 32 | b, weight


def _written(tools, ids_a, ids_b, cuts, last_b, stop_a, stop_b) -> list[memoryview]:
    """``a1,a2|b1;a3|b2,b3`` per text: groups in order, A's ids before B's."""
    size_a, size_b = len(tools.a_sizes), len(tools.b_sizes)
    code = np.zeros(len(ids_a) + len(ids_b), np.int32)
    closes = np.zeros(len(ids_a), np.int32)
    closes[cuts] = size_a
    b_before = np.diff(last_b, prepend=-1)
    a_before = np.diff(cuts, prepend=-1)
    code[np.arange(len(ids_a)) + np.repeat(np.cumsum(b_before) - b_before, a_before)] = ids_a + closes
    behind = np.zeros(len(ids_b), np.int32)
    behind[last_b] = size_b
    if len(ids_b):
        behind[stop_b[stop_b > 0] - 1] = 2 * size_b  # nothing stands behind a text's last id
        code[np.arange(len(ids_b)) + np.repeat(cuts + 1, b_before)] = ids_b + behind + 2 * size_a
    taken = pc.take(tools.words, pa.array(code))  # its bytes lie one behind the other
    starts = np.frombuffer(taken.buffers()[1], np.int64)[np.concatenate([[0], stop_a + stop_b])]
    data = memoryview(taken.buffers()[2] or b"")
    return [data[i:j] for i, j in zip(starts, starts[1:])]


SCHEMA = (
    "slice bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "groups string, pair_at array<int>, pair_n array<int>, known array<bigint>, links array<bigint>"
)
ARROW = pa.schema(
    [
        ("slice", pa.int64()),
        ("doc_id", pa.int64()),
        *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
        ("groups_sha256", pa.string()),
        ("groups", pa.string()),
        ("pair_at", pa.list_(pa.int32())),
        ("pair_n", pa.list_(pa.int32())),
        ("known", pa.list_(pa.int64())),
        ("links", pa.list_(pa.int64())),
    ]
)


def _frame(**columns) -> pa.RecordBatch:
    n = len(columns["slice"])
    return pa.record_batch(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in ARROW], schema=ARROW
    )


def align(docs: DataFrame, byte_bpe: str, pieces: str, keep_groups: bool = False) -> DataFrame:
    """Alignments of texts: rows of texts, and one row per slice with its dictionary (``known`` is not null).

    A map over partitions. ``groups`` holds the written groups if ``keep_groups``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_models(byte_bpe, pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        models = shared.value
        if "tools" not in models:  # the broadcast value lives as long as the Python worker
            models["tools"] = Tokenizers(models)
        tools = models["tools"]
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                columns, known, links = align_slice(tools, part.column("text").to_pylist(), keep_groups)
                own = np.full(part.num_rows, number, np.int64)
                yield _frame(slice=own, doc_id=part.column("doc_id"), **columns)
                yield _frame(slice=[number], known=[known], links=[links])
                number += 1

    return texts(docs).mapInArrow(run, SCHEMA)


def pair_counts(dictionaries: DataFrame) -> DataFrame:
    """``pair, n, best`` of the corpus: links of each id pair, and whether no pair of its B id has more."""
    counts = dictionaries.groupBy("pair").agg(F.sum("links").alias("n"))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _summed(own: pa.Table, counts: pa.Table) -> pa.Table:
    """Add up the corpus counts of each text's pairs."""
    size = len(counts)
    n, best = np.zeros(size, np.int64), np.zeros(size, bool)
    at = counts.column("at").to_numpy()
    n[at], best[at] = counts.column("n").to_numpy(), counts.column("best").to_numpy(zero_copy_only=False)
    n_best, count_sum = [], []
    for chunk in own.select(["pair_at", "pair_n"]).to_batches():
        places, times = chunk.column("pair_at"), chunk.column("pair_n")
        text = pc.list_parent_indices(places).to_numpy()
        place = pc.list_flatten(places).to_numpy()
        times = pc.list_flatten(times).to_numpy().astype(np.int64)
        for out, value in ((n_best, times * best[place]), (count_sum, times * n[place])):
            total = np.zeros(chunk.num_rows, np.int64)
            np.add.at(total, text, value)
            out.append(total)
    return own.drop_columns(["slice", "pair_at", "pair_n"]).append_column("n_best", pa.array(np.concatenate(n_best))).append_column(
        "count_sum", pa.array(np.concatenate(count_sum))
    )


def aligned(docs: DataFrame, byte_bpe: str, pieces: str, keep_groups: bool = False) -> DataFrame:
    """Per text: ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups, n_best, count_sum``."""
    spark = docs.sparkSession
    where = folder(spark, "tokenpairs")
    rows = written(align(docs, byte_bpe, pieces, keep_groups), f"{where}/rows")
    held = (
        rows.filter(F.col("known").isNotNull())
        .select("slice", F.posexplode(F.arrays_zip("known", "links")).alias("at", "x"))
        .select("slice", "at", F.col("x.known").alias("pair"), F.col("x.links").alias("links"))
    )
    counts = written(pair_counts(held), f"{where}/counts")
    back = held.select("slice", "at", "pair").join(counts, "pair").select(F.col("slice").alias("of"), "at", "n", "best")
    own = rows.filter(F.col("known").isNull()).drop("known", "links")
    plain = own.filter("n_a = 0").drop("slice", "pair_at", "pair_n").withColumns({"n_best": F.lit(0).cast("bigint"), "count_sum": F.lit(0).cast("bigint")})
    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, n_best bigint, count_sum bigint"
    found = own.filter("n_a > 0").groupBy("slice").cogroup(back.groupBy("of")).applyInArrow(_summed, schema)
    return found.unionByName(plain)


