"""Line, substring and near dedup on hand-worked and awkward rows, against brute force."""

import random
import re

import pytest
from cases import LONG, SCHEMA, clashing, documents, empty

from reefline.llm import linededup, neardup, substrings


def make(spark, texts):
    return spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], SCHEMA)


# line dedup


def lines_by_hand(rows, min_docs=3, min_chars=20):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for doc_id, text in rows:
        for line in text.split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(doc_id)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    return {d: "\n".join(x for x in t.split("\n") if gone.get(key(x), d) == d) for d, t in rows}


def test_lines_against_brute_force(spark):
    rng = random.Random(1)
    pool = [f"line number {k} with some more words" for k in range(12)] + ["short", "", "  LINE number 3 with some more WORDS\t"]
    rows = [(k, "\n".join(rng.choices(pool, k=rng.randint(0, 6)))) for k in range(40)]
    got = {r.doc_id: r for r in linededup.drop_common_lines(make(spark, [t for _, t in rows])).collect()}
    want = lines_by_hand(rows)
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_lines - r.n_dropped == (0 if r.n_lines == r.n_dropped else r.text.count("\n") + 1) for r in got.values())


def test_runs_keep_every_key_once_and_find_fresh_keys(spark):
    from reefline.llm.common import folder

    runs = linededup.LineRuns(spark, folder(spark, "test-lines"), 2, fan_in=2)
    schema = "h1 long, h2 long, n_docs long, last_doc long"
    for k in range(5):
        batch = spark.createDataFrame([(h, -h, 1, 10 * k) for h in range(k, k + 3)], schema)
        fresh = {r.h1 for r in runs.fresh(batch).collect()} if runs.runs() else {0, 1, 2}
        assert fresh == ({0, 1, 2} if k == 0 else {k + 2})
        runs.add(batch)
    held = [r.h1 for run in runs.runs() for r in run.collect()]
    assert sorted(held) == list(range(7)) and len(runs.levels) > 1
    assert {(r.h1, r.n_docs, r.last_doc) for r in runs.common(3).collect()} == {(2, 3, 20), (3, 3, 30), (4, 3, 40)}
    runs.close()


def test_deliveries_reopen_the_levels(spark):
    """Each delivery comes in a session that knows no table; one fails before it is saved and comes again."""
    from reefline.llm.common import folder

    rng = random.Random(7)
    pool = [f"line number {k} with some more words" for k in range(15)]
    rows = [(k, "\n".join(rng.choices(pool, k=rng.randint(1, 4)))) for k in range(60)]
    where = folder(spark, "test-deliveries")
    for start in range(0, 60, 10):
        for t in spark.catalog.listTables():
            if t.name.startswith("line_run_"):
                spark.sql(f"DROP TABLE {t.name}")
        part = spark.createDataFrame(rows[start : start + 10], "doc_id long, text string")
        if start == 30:
            lost = linededup.LineRuns.open(spark, where)
            lost.add(linededup.batch_keys(part, 20))
            before = lost.version
        common = linededup.deliver(part, where, first=start == 0, fan_in=2)
        seen = {}
        for doc_id, text in rows[: start + 10]:
            for line in text.split("\n"):
                seen.setdefault(line, set()).add(doc_id)
        want = sorted((len(v), max(v)) for v in seen.values() if len(v) >= 3)
        assert sorted((r.n_docs, r.last_doc) for r in common.collect()) == want
    runs = linededup.LineRuns.open(spark, where)
    assert runs.version == 6 > before and len(runs.levels) > 1
    assert sum(r.count() for r in runs.runs()) == len(seen)
    runs.close()


def test_lines_of_awkward_rows(spark):
    for docs in (documents(spark), clashing(spark)):
        rows = linededup.drop_common_lines(docs).collect()
        assert len(rows) == docs.count()
        by_id = {r.doc_id: r for r in rows}
        assert (by_id[1].text, by_id[1].n_lines, by_id[1].n_dropped) == ("", 1, 0)
        assert by_id[3].text == LONG and by_id[4].text == LONG  # two documents only
        assert by_id[None].text.startswith("no id")
    assert linededup.drop_common_lines(empty(spark)).count() == 0


# substring dedup


def windows_by_hand(rows, size):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t) for d, t in rows}
    first = {}
    for d in sorted(words):
        for k in range(len(words[d]) - size + 1):
            first.setdefault(tuple(words[d][k : k + size]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < d:
                gone.update(range(k, k + size))
        out[d] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("size", [1, 4, 7, 30])
def test_windows_against_brute_force(spark, size):
    rng = random.Random(size)
    pieces = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 60))) for _ in range(12)]
    rows = [(k, "  ".join(rng.choices(pieces, k=rng.randint(0, 4)))) for k in range(30)]
    rows.append((30, rows[3][1]))
    got = substrings.drop_repeated(make(spark, [t for _, t in rows]), size).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == windows_by_hand(rows, size)


def test_windows_of_awkward_rows(spark):
    for docs in (documents(spark), clashing(spark)):
        rows = substrings.drop_repeated(docs).collect()
        assert len(rows) == docs.count()
        by_id = {r.doc_id: r for r in rows}
        assert (by_id[1].n_words, by_id[1].text) == (0, "")
        assert by_id[3].n_removed == 0 and by_id[4].n_removed == by_id[4].n_words == 30_000
        assert [(i.start, i.end) for i in by_id[4].removed] == [(0, 30_000)]
        assert by_id[None].n_removed == 0
    assert substrings.drop_repeated(empty(spark)).count() == 0


def test_rows_without_id_take_no_part_in_windows(spark):
    text = " ".join(map(str, range(60)))
    docs = spark.createDataFrame([(None, text), (1, text), (2, text + " x")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substrings.drop_repeated(docs).collect()}
    assert got == {None: 0, 1: 0, 2: 60}


# near dedup


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_by_hand(rows):
    sets = {d: shingle_set(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in ids}


def test_components_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for size in (5, 6, 8, 12, 40, 150, 400):
        for _ in range(4):
            base = [f"w{rng.randint(0, 10_000)}" for _ in range(size)]
            for _ in range(6):
                own = list(base)
                for _ in range(rng.randint(0, max(1, size // 30))):
                    own[rng.randrange(len(own))] = f"x{rng.randint(0, 99)}"
                if rng.random() < 0.4:
                    own = own[rng.randint(0, max(1, size // 8)) :]
                rows.append((len(rows), " ".join(own)))
    rows += [(len(rows), "a b"), (len(rows) + 1, "A  b"), (len(rows) + 2, ""), (len(rows) + 3, "")]
    got = neardup.near_duplicates(make(spark, [t for _, t in rows])).collect()
    want = components_by_hand(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_chain_of_near_copies_is_one_component(spark):
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[12 * k : 12 * k + 200]) for k in range(15)]
    got = neardup.near_duplicates(make(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_by_hand(list(enumerate(texts)))
    assert {r.component_id for r in got} == {0}


def test_a_crowd_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(300):
        own = list(base)
        for _ in range(2):
            own[rng.randrange(120)] = f"x{rng.randint(0, 10**6)}"
        texts.append(" ".join(own))
    got = neardup.near_duplicates(make(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_by_hand(list(enumerate(texts)))


def test_the_estimate_is_unbiased_enough():
    import numpy as np

    rng = np.random.default_rng(1)
    order = neardup.borrow_order()
    for size in (300, 3_000):
        for share in (0.5, 0.75, 0.9):
            both = round(2 * size * share / (1 + share))
            seen = []
            for _ in range(40):
                a = np.unique(rng.integers(0, 2**63, 2 * size - both, dtype=np.uint64) * np.uint64(2))
                x, y = np.sort(a[rng.permutation(len(a))[:0]]), None
                mixed = rng.permutation(a)
                x, y = np.sort(mixed[:size]), np.sort(mixed[len(mixed) - size :])
                regs = neardup.registers(x, order), neardup.registers(y, order)
                accident = neardup.chance(np.array([size]), np.array([size]))[0]
                seen.append(((regs[0] == regs[1]).mean() - accident) / (1 - accident))
            assert abs(np.mean(seen) - share) < 0.05


def test_near_dedup_of_awkward_rows(spark):
    for docs in (documents(spark), clashing(spark)):
        rows = neardup.near_duplicates(docs).collect()
        assert len(rows) == docs.count()
        by_id = {r.doc_id: r for r in rows}
        assert (by_id[1].n_shingles, by_id[1].component_id, by_id[1].kept) == (0, 1, True)
        assert by_id[4].component_id == 3 and not by_id[4].kept
        assert by_id[None].component_id is None and by_id[None].kept
    assert neardup.near_duplicates(empty(spark)).count() == 0
