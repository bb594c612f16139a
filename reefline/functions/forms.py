"""Texts that become equal when letters are taken out, found in numpy among the texts of one group.

A form of a text is what is left when some of its letters are taken out. Forms
are hashed, never built: a hash is a sum over letters, so that of a form is a few
differences of running sums. Equal hashes make candidates, to be compared by the
caller; texts that have a form in common are always among them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Weights of up to three letters of a form, and the divisor of their sum, that deal a form to a share.
SHARE_WEIGHTS, SHARE_DIVISOR = (7_919, 104_729, 15_485_863), 1_000_003
# Multipliers of the hash; the second is odd, so it can be divided by.
MIX, BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
# Texts and forms looked at together, forms of listed texts kept at once, pairs held back to drop repeats.
TEXTS_TOGETHER, FORMS_AT_ONCE, FORMS_KEPT, PAIRS_HELD = 1 << 14, 1 << 18, 1 << 23, 1 << 21
# A kept form is one number: the upper bits of its hash and the number of its text.
TEXT_BITS = 24
TEXT_MASK = np.uint64((1 << TEXT_BITS) - 1)


def by_size(texts: pa.Array) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
    """For each length, blocks of the texts' numbers and code points (a row for each place)."""
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    out = {}
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        out[size] = []
        for start in range(0, len(at), TEXTS_TOGETHER):
            some = at[start : start + TEXTS_TOGETHER]
            taken = texts.take(pa.array(some))
            joined = taken.buffers()[2].to_pybytes()[: pc.sum(pc.binary_length(taken)).as_py()] if size else b""
            points = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32).reshape(len(some), size)
            out[size].append((some.astype(np.uint64), np.ascontiguousarray(points.T)))
    return out


def ways_out(size: int, out: int, places: tuple[int, ...]) -> list[tuple[tuple[int, ...], np.ndarray]]:
    """Every way to take ``out`` of ``size`` letters out, grouped by where the form's ``places`` come from."""
    chosen = list(combinations(range(size), out))
    ways = np.array(chosen, np.int64).reshape(len(chosen), out)
    source = np.stack([p + (ways - np.arange(out) <= p).sum(1) for p in places], 1) if places else np.zeros((len(ways), 0), np.int64)
    kinds, kind = np.unique(source, axis=0, return_inverse=True)
    return [(tuple(k.tolist()), ways[kind.ravel() == i]) for i, k in enumerate(kinds)]


def hashed_forms(
    numbers: np.ndarray, points: np.ndarray, out: int, by_source: list[tuple[tuple[int, ...], np.ndarray]], share: int, shares: int
) -> Iterator[np.ndarray]:
    """Pieces of the texts' forms with ``out`` letters out (see ``ways_out``) that fall to ``share``, as hash and text number in one."""
    size = len(points)
    x = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX)
    x ^= x >> np.uint64(29)
    powers = np.array([pow(BASE, j, 1 << 64) for j in range(size)], np.uint64)
    sums = np.zeros((size + 1, len(numbers)), np.uint64)
    np.cumsum(x * powers[:, None], axis=0, out=sums[1:])
    back = pow(BASE, -1, 1 << 64)
    runs = [sums * np.uint64(pow(back, t, 1 << 64)) for t in range(out + 1)]
    for sources, ways in by_source:
        dealt = sum((points[s].astype(np.int64) * w for s, w in zip(sources, SHARE_WEIGHTS, strict=False)), np.zeros(len(numbers), np.int64))
        mine = np.flatnonzero(dealt % SHARE_DIVISOR % shares == share)
        if not len(mine):
            continue
        own, cut = numbers[mine], [r if len(mine) == len(numbers) else r[:, mine] for r in runs]
        step = max(1, FORMS_AT_ONCE // len(mine))
        for some in (ways[k : k + step] for k in range(0, len(ways), step)):
            hashes = np.zeros((len(some), len(mine)), np.uint64)
            for t in range(out + 1):
                hashes += cut[t][some[:, t]] if t < out else cut[t][size]
                if t:
                    hashes -= cut[t][some[:, t - 1] + 1]
            hashes &= ~TEXT_MASK
            hashes |= own
            yield hashes.ravel()


def common_forms(left: list[tuple], right: list[tuple], deal: tuple) -> Iterator[np.ndarray]:
    """Pairs (a row of left, a row of right text numbers) that may share a form, in pieces; ``left`` is held in memory by parts.

    Both are blocks ``(numbers, points, letters out, ways to take them out)``; ``deal`` is the share and how many there are.
    """
    held, n = [], 0
    for block in left:
        for piece in hashed_forms(*block, *deal):
            held.append(piece)
            n += len(piece)
            if n >= FORMS_KEPT:
                kept, held, n = np.concatenate(held), [], 0
                yield from _met(kept, right, deal)
    if held:
        kept, held = np.concatenate(held), []
        yield from _met(kept, right, deal)


def _met(kept: np.ndarray, right: list[tuple], deal: tuple) -> Iterator[np.ndarray]:
    kept.sort()
    # where the forms begin that share the bits in front: hashes are even, so few forms do
    shift = np.uint64(64 - max(12, len(kept).bit_length()))
    begin = np.zeros((1 << (64 - int(shift))) + 1, np.int32)
    ends = np.flatnonzero(np.append(kept[1:] >> shift != kept[:-1] >> shift, True))
    begin[(kept[ends] >> shift).astype(np.int64) + 1] = ends + 1
    np.maximum.accumulate(begin, out=begin)
    for block in right:
        held, n = [], 0
        for piece in hashed_forms(*block, *deal):
            front = (piece >> shift).astype(np.int64)
            first = begin[front]
            many = begin[front + 1] - first
            some = np.flatnonzero(many)
            piece, first, many = piece[some], first[some], many[some]
            ends = np.cumsum(many, dtype=np.int64)
            start = 0
            while start < len(piece):
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + PAIRS_HELD, "right")))
                reps = many[start:stop]
                at = np.repeat(first[start:stop] - (ends[start:stop] - reps - done), reps) + np.arange(ends[stop - 1] - done)
                ours, theirs = kept[at], np.repeat(piece[start:stop], reps)
                equal = np.flatnonzero((ours ^ theirs) <= TEXT_MASK)
                held.append((ours[equal] & TEXT_MASK) << np.uint64(32) | (theirs[equal] & TEXT_MASK))
                n += len(equal)
                start = stop
                if n >= PAIRS_HELD:
                    held = [np.unique(np.concatenate(held))]
                    n = len(held[0])
                    if n >= PAIRS_HELD // 2:
                        yield np.stack([held[0] >> np.uint64(32), held[0] & TEXT_MASK]).astype(np.int64)
                        held, n = [], 0
        if n:
            pairs = np.unique(np.concatenate(held))
            yield np.stack([pairs >> np.uint64(32), pairs & TEXT_MASK]).astype(np.int64)


def may_be_near(words: pa.Array, names: pa.Array, form: int, most: int, places: tuple[int, ...], share: int, shares: int) -> Iterator[pa.RecordBatch]:
    """Different words and names that share a form of ``form`` letters in this share, the longer with ``most`` letters out."""
    if max(len(words), len(names)) > TEXT_MASK:
        for w in range(0, len(words), int(TEXT_MASK)):
            for n in range(0, len(names), int(TEXT_MASK)):
                yield from may_be_near(words[w : w + int(TEXT_MASK)], names[n : n + int(TEXT_MASK)], form, most, places, share, shares)
        return
    sides, ways = [], {out: ways_out(form + out, out, places) for out in range(most + 1)}
    for texts in (words, names):
        sides.append([(*block, size - form, ways[size - form]) for size, blocks in by_size(texts).items() if 0 <= size - form <= most for block in blocks])
    typed, listed = sides
    full = [[b for b in side if b[2] == most or not form] for side in sides]
    rest = [b for b in listed if b[2] < most and form]
    same = pc.index_in(words, names).fill_null(-1).to_numpy(zero_copy_only=False)
    for left, right in ((full[1], typed), (rest, full[0])):
        for name, word in common_forms(left, right, (share, shares)) if left and right else ():
            keep = same[word] != name
            if keep.any():
                yield pa.RecordBatch.from_arrays([words.take(pa.array(word[keep])), names.take(pa.array(name[keep]))], ["_low", "_name_low"])
