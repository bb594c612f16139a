"""Secret scans: fixed patterns, and guess costs of what stands in a credential context.

The value after a credential word is cut into words, dates, repeats, keyboard
walks and sequences, and brute-force spans, so that the product of their guess
counts is least (dynamic programming from left to right). Values that take at
least ``2**HARD_BITS`` guesses become spans of kind ``guess`` (``2**MIXED_BITS`` if
they have letters and digits, which words do not); values of a known word, a date
or ``qwerty`` do not. Spans of the fixed patterns stay whatever
their cost.

Cases: null text is empty; whole texts are read, of any length. Spans are in code
points, end exclusive. Repeated rows give repeated results, any ``doc_id`` is
handed on, other columns are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from reefline.llm.common import ship, slices, texts

ship(__name__)

HARD_BITS = 42.0
MIXED_BITS = 36.0  # seven random small letters and digits cost 36.2
KINDS = ("assign", "access", "hex", "guess")
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
# A wider credential context, for guess costs only.
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|passcode|pwd|pass|secret|token|api_?key|access_?key|private_?key|credentials?|auth|bearer)"""
    r"""(?:[_.-][a-z0-9]+)*["']?\x20*(?:[:=]|=>)\x20*["']?([^\s"'<>,;]{6,})""",
    re.I | re.A,
)
# Fixed values for the quick test whether a text needs the patterns at all.
QUICK = r"""(?i:passw|passp|passc|pwd|pass[^a-z0-9]|secret|token|api_?key|access_?key|private_?key|credential|auth|bearer)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""

# Common parts of passwords, the most frequent first.
WORDS = (
    "password admin qwerty welcome login letmein dragon master monkey football baseball abc pass secret test user root guest hello love"
    " sunshine princess shadow superman michael jordan summer winter spring autumn monday friday january changeme default server"
    " database public private access token system oracle manager service account company example sample demo temp hunter trust"
    " freedom whatever batman starwars flower ginger pepper cookie cheese coffee orange banana apple silver golden diamond"
    " computer internet google windows linux magic happy lucky angel tiger eagle falcon killer ninja pokemon soccer hockey"
).split()
WORD_RANK = {w: k + 1 for k, w in enumerate(WORDS)}
LONGEST = max(map(len, WORDS))
LEET = str.maketrans("@4301!$57", "aaeoiisst")
# Rows of a keyboard, letters and digits in order.
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "qwertzuiop", "azertyuiop", "abcdefghijklmnopqrstuvwxyz", "1qaz2wsx3edc4rfv5tgb6yhn")
STEPS = {(a, b) for row in WALKS for a, b in zip(row, row[1:])}
STEPS |= {(b, a) for a, b in STEPS}
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d", re.A)


def alphabet(value: str) -> int:
    """How many letters a guesser must try at each place."""
    return max(
        2,
        26 * any("a" <= c <= "z" for c in value)
        + 26 * any("A" <= c <= "Z" for c in value)
        + 10 * any("0" <= c <= "9" for c in value)
        + 33 * any(c.isascii() and not c.isalnum() for c in value)
        + 100 * (not value.isascii()),
    )


def segments(value: str) -> Iterator[tuple[int, int, str, float]]:
    """Spans that a guesser knows: start, end, kind and bits of guesses."""
    low = value.lower()
    plain = low.translate(LEET)
    size = len(value)
    for k in range(size):
        for end in range(k + 3, min(size, k + LONGEST) + 1):
            for form, extra in ((low, 0.0), (plain, 1.0)):
                if rank := WORD_RANK.get(form[k:end]):
                    upper = sum(c.isupper() for c in value[k:end])
                    yield k, end, "word", math.log2(rank) + 1 + extra + (0 if not upper else 1 if upper in (1, end - k) else upper)
                    break
    for m in DATE.finditer(value):
        yield m.start(), m.end(), "date", math.log2(365 * 120) if m.end() - m.start() > 4 else math.log2(120)
    k = 0
    while k < size:  # repeats of one to four letters
        best = None
        for unit in range(1, 5):
            end = k + unit
            while low[end : end + unit] == low[k : k + unit] and end + unit <= size:
                end += unit
            if end - k >= max(3, 2 * unit) and (best is None or end > best[0]):
                best = (end, unit)
        if best:
            yield k, best[0], "repeat", best[1] * math.log2(alphabet(value[k : k + best[1]])) + math.log2((best[0] - k) / best[1])
            k = best[0]
        else:
            k += 1
    k = 0
    while k < size:  # walks over neighbouring keys
        end = k + 1
        while end < size and (low[end - 1], low[end]) in STEPS:
            end += 1
        if end - k >= 3:
            yield k, end, "walk", math.log2(47) + math.log2(end - k) + 2
        k = max(end - 1, k + 1)


def guess_bits(value: str) -> float:
    """Least number of guesses, as a power of two, over all ways to cut the value."""
    at: dict[int, list[tuple[int, float]]] = {}
    for start, end, _, bits in segments(value):
        at.setdefault(end, []).append((start, bits))
    brute = math.log2(alphabet(value))
    cost = [0.0]
    for end in range(1, len(value) + 1):
        # one more bit for each known span: where it ends
        cost.append(min([cost[end - 1] + brute, *(cost[s] + bits + 1 for s, bits in at.get(end, ()))]))
    return cost[-1]


def find(text: str) -> list[tuple[int, int, str, float | None]]:
    """All spans (start, end, kind, bits of the value) in order of start, then kind."""
    out = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= LEAST["assign"]:
            out.append((m.start(), m.end(), 0, guess_bits(m[2])))
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        least = LEAST[KINDS[kind]]
        out += [(m.start(), m.end(), kind, None) for m in pattern.finditer(text) if m.end() - m.start() >= least]
    for m in CONTEXT.finditer(text):
        mixed = any(c.isalpha() for c in m[1]) and any(c.isdigit() for c in m[1])
        if (bits := guess_bits(m[1])) >= (MIXED_BITS if mixed else HARD_BITS):
            out.append((m.start(1), m.end(1), 3, bits))
    return [(a, b, KINDS[k], bits) for a, b, k, bits in sorted(out, key=lambda s: (s[0], s[2], s[1]))]


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``found``: spans with ``kind``, ``start``, ``end`` and ``bits`` (null where no value is costed)."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                maybe = pc.match_substring_regex(part.column("text"), QUICK).to_pylist()
                found = [
                    [{"kind": k, "start": a, "end": b, "bits": bits} for a, b, k, bits in find(text.as_py())] if yes else []
                    for text, yes in zip(part.column("text"), maybe)
                ]
                yield pa.record_batch([part.column("doc_id"), pa.array(found, span)], names=["doc_id", "found"])

    return texts(docs).mapInArrow(run, "doc_id bigint, found array<struct<kind:string,start:bigint,end:bigint,bits:double>>")
