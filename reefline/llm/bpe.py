"""BPE encoding and decoding by a prefix-sharing walk over a trie of distinct words.

The encoding of a word is fixed by one number per prefix: the last token of the
prefix's own encoding. Of all tokens that end the prefix, exactly one forms a
valid pair with the last token of what precedes it. Distinct words go into a
trie; a depth-first walk carries these last tokens down, so a prefix that many
words share is encoded once. (Pair validity: undo the merges of both tokens from
the latest back; the pair is valid if no merge across the border came first.)

Cases: null text is empty; an empty text has no tokens and decodes to the empty
text. Rows are independent: equal rows give equal rows, any ``doc_id`` (null as
well) is handed on, other columns (also ones named like an output) are left out.
A very long text is encoded in parts cut at white space, which no piece holds,
so it needs its own size and that of its ids, not one object a word.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from reefline.llm.common import ship, slices, texts

ship(__name__)

SLICE_BYTES = 1024 * 1024
# Of a generation of cached words; a Python worker keeps two, so memory is bounded.
CACHE_BYTES = 20 * 1024 * 1024
KNOWN_PAIRS = 300_000
SPACE = re.compile("[ \n]")
END = "</w>"


def read_model(path: str) -> dict:
    """The vocabulary file as plain tables, to be broadcast: bounded by the vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    ids: dict[str, int] = model["vocab"]
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    rank = {(ids[a], ids[b]): r for r, (a, b) in enumerate(merges)}
    made = {ids[a + b]: (r, ids[a], ids[b]) for r, (a, b) in reversed(list(enumerate(merges)))}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {"ids": ids, "rank": rank, "made": made, "added": added, "longest": max(map(len, ids))}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class PairRule:
    """Whether two tokens stand next to each other in an encoding of their joined text."""

    def __init__(self, rank: dict, made: dict):
        self.rank, self.made, self.known = rank, made, {}

    def learn(self, left: int, right: int) -> bool:
        """Decide a pair that is not in ``known`` yet, and note it there under ``left << 32 | right``."""
        if len(self.known) >= KNOWN_PAIRS:
            self.known.clear()
        found = self.known[left << 32 | right] = self._holds(left, right)
        return found

    def _holds(self, x: int, y: int) -> bool:
        base = (-1, x, y)
        limit = float("inf")
        while True:
            across = self.rank.get((x, y))
            if across is not None and across < limit:
                return False
            rx, ry = self.made.get(x, base), self.made.get(y, base)
            if rx[0] < 0 and ry[0] < 0:
                return True
            if rx[0] > ry[0]:
                limit, x = rx[0], rx[2]
            else:  # equal merges run from left to right, so the border's merge also wins a tie
                limit, y = ry[0] + 1, ry[1]


def walk(words: list[str], model: dict, rule: PairRule) -> Iterator[tuple[str, list[int]]]:
    """Token ids of each distinct word, in sorted order.

    Sorted words are the trie in depth-first order: what a word shares with the
    one before it is the path from the root that stays on the stack. Where the
    last token starts is tried first at the last token of the shorter prefix,
    then from the right; only one start fits.
    """
    get, longest = model["ids"].get, model["longest"]
    known, learn = rule.known, rule.learn
    stack: list[int] = []  # last token of each proper prefix of the current path
    starts: list[int] = []  # and where it starts
    before = ""
    for word in sorted(words):
        size = len(word)
        shared = 0
        for a, b in zip(before, word):
            if a != b:
                break
            shared += 1
        shared = min(shared, len(stack), size - 1)
        del stack[shared:], starts[shared:]
        start = starts[-1] if starts else 0
        for end in range(shared + 1, size + 1):
            at, rest = start, end  # the first try, then end - 1, end - 2, ...
            while True:
                token = get(word[at:end] if end < size else word[at:] + END)
                if token is not None:
                    if not at:
                        break
                    pair = stack[at - 1] << 32 | token
                    fits = known.get(pair)
                    if learn(stack[at - 1], token) if fits is None else fits:
                        break
                rest -= 1
                if rest < 0 or end - rest > longest:
                    raise ValueError(f"no token ends {word[:end]!r}")
                at = rest
            stack.append(token)
            starts.append(at)
            start = at
        out = [stack.pop()]
        at = starts.pop()
        while at:
            out.append(stack[at - 1])
            at = starts[at - 1]
        out.reverse()
        yield word, out
        before = word


class Encoder:
    """Encodes texts; holds a bounded cache of words. One per Python worker."""

    def __init__(self, model: dict):
        import regex

        self.model = model
        self.rule = PairRule(model["rank"], model["made"])
        self.letters = byte_letters()
        # The pieces that the vocabulary's merges stay within.
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.special = regex.compile("(" + "|".join(map(regex.escape, model["added"])) + ")") if model["added"] else None
        names = {i: t for t, i in [*model["ids"].items(), *model["added"].items()]}
        # what an id adds to the decoded text: its name and a space
        self.names = pa.array([names.get(i, "") + " " for i in range(max(names) + 1)], pa.large_string())
        self.fresh: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def split(self, text: str) -> list[str]:
        """Pieces of a text. Special tokens stay whole, told apart by a leading space."""
        if self.special and "<|" in text:
            out = []
            for k, part in enumerate(self.special.split(text)):
                out += [" " + part] if k % 2 else self.split_plain(part)
            return out
        return self.split_plain(text)

    def split_plain(self, text: str) -> list[str]:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # letter by letter: no final sigma
        return self.pieces.findall(text.replace("Σ", "σ").lower())

    def learn(self, words: set[str]) -> None:
        """Encode the words that the cache lacks, all in one walk."""
        new = words.difference(self.fresh)
        if self.held > CACHE_BYTES:
            self.older, self.fresh, self.held = self.fresh, {}, 0
            new = words
        for w in new.intersection(self.older):
            self.keep(w, self.older[w])
        letters = self.letters
        spelled = {
            w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode()]): w
            for w in new.difference(self.older)
            if w[0] != " "
        }
        for w in new:
            if w[0] == " ":
                self.keep(w, array("I", [self.model["added"][w[1:]]]).tobytes())
        for w, ids in walk(list(spelled), self.model, self.rule):
            self.keep(spelled[w], array("I", ids).tobytes())

    def keep(self, word: str, ids: bytes) -> None:
        self.fresh[word] = ids
        self.held += 200 + 2 * len(word) + len(ids)  # about what the entry takes

    def encode(self, batch: list[str]) -> Iterator[bytes]:
        """Ids as little-endian 32-bit numbers, per text."""
        if len(batch) == 1:
            found = []
            for part in parts(batch[0]):
                words = self.split(part)
                self.learn(set(words))
                found.append(b"".join(map(self.fresh.__getitem__, words)))
            yield b"".join(found)
            return
        split = [self.split(t) for t in batch]
        self.learn(set().union(*split))
        for words in split:
            yield b"".join(map(self.fresh.__getitem__, words))

    def decode(self, batch: list[bytes]) -> list[str]:
        """The texts of ids: their names, joined by spaces."""
        ids = np.frombuffer(b"".join(batch), dtype="<u4")
        taken = pc.take(self.names, pa.array(ids))  # its bytes lie one behind the other
        starts = np.frombuffer(taken.buffers()[1], np.int64)[np.cumsum([0] + [len(i) // 4 for i in batch])]
        data = memoryview(taken.buffers()[2] or b"")
        return [str(data[i : max(i, j - 1)], "utf-8") for i, j in zip(starts, starts[1:])]


def parts(text: str, size: int = SLICE_BYTES) -> Iterator[str]:
    """A text in parts of about ``size`` characters, each but the first starting with white space."""
    start = 0
    while len(text) - start > size:
        cut = SPACE.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` (binary: 32-bit little-endian token ids) and ``decoded`` per document.

    A map over partitions: nothing is shuffled. The vocabulary file is read once
    and broadcast (a few megabytes, whatever the data).
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_model(path))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if "encoder" not in model:  # the broadcast value lives as long as the Python worker
            model["encoder"] = Encoder({k: v for k, v in model.items()})
        encoder = model["encoder"]
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids = list(encoder.encode(part.column("text").to_pylist()))
                decoded = encoder.decode(ids)
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                    schema=schema,
                )

    return texts(docs).mapInArrow(run, "doc_id bigint, ids binary, decoded string")
