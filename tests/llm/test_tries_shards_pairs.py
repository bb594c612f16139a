"""Conversation trie, shuffle into shards and token alignment: brute force, exact shares and awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import comb

import numpy as np
import public_tokenizers
import pytest
from cases import clashing, documents, empty

from reefline.llm import convtrie, shardshuffle, tokenpairs

TURNS = "conv_id long, turn long, role string, text string"
LETTERS = "abc"


def trie_by_hand(rebuilt):
    """``rebuilt``: conversation id to its list of (role, text)."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in sorted(rebuilt.items()):
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(str(c))
    children = Counter(p[:-1] for p in members if p)
    out = []
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        digest = hashlib.sha256(",".join(ends[p]).encode()).hexdigest()
        leaves = sum(children[q] == 0 for q in below)
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), children[p], leaves, saved, digest))
    return sorted(out)


def ordered(rows):
    """Conversations with their turns in order, nulls first; ties by digest."""
    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            found[c].append((turn is not None, turn or 0, digest, (role, text)))
    return {c: [t[-1] for t in sorted(turns)] for c, turns in found.items()}


def heads_by_hand(own, span, most):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        out[c] = own.get(c - c % span, [])[:h] + turns[h:]
    return out


def many_turns():
    rng = random.Random(5)
    rows = [(c, k, rng.choice(["user", None]), rng.choice(["one two", "three", "", None])) for c in range(1, 70) for k in range(rng.randint(1, 5))]
    rows += [(100, k, "user", f"w {k}") for k in range(40)]  # a long one
    rows += [(c, k, "user", "same words here") for c in range(200, 240) for k in range(3)]  # a large group of copies
    rows += [(300, None, "user", "no turn"), (300, None, "user", "no turn"), (300, -1, "x", "y"), (None, 1, "user", "no id"), (301, 1, "a", "b"), (301, 1, "b", "a")]
    return rows


@pytest.mark.parametrize("members", [1, 4, 1000])
def test_trie_against_brute_force(spark, members, monkeypatch):
    monkeypatch.setattr(convtrie, "POSITIONS", 8)
    rows = many_turns()
    table = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as depth", "'x' as n1").repartition(5)
    got = sorted(tuple(r) for r in convtrie.conversation_trie(table, members=members).collect())
    assert got == trie_by_hand(ordered(rows))
    if members == 4:
        got = sorted(tuple(r) for r in convtrie.conversation_trie(table, 20, 3, members).collect())
        assert got == trie_by_hand(heads_by_hand(ordered(rows), 20, 3))


def test_a_conversation_without_turns_is_a_member_of_the_root(spark):
    taken = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 2)
    out = convtrie.conversation_trie(spark.createDataFrame([(taken, 0, "user", "gone")], TURNS), 20, 3).collect()
    assert [tuple(r) for r in out] == [(taken, 0, None, 1, 0, 1, 0, hashlib.sha256(str(taken).encode()).hexdigest())]


def test_an_empty_table_has_no_trie(spark):
    assert convtrie.conversation_trie(spark.createDataFrame([], TURNS), 20, 3).collect() == []


def test_spilling_queue_keeps_the_order():
    rng = random.Random(1)
    queue, want = convtrie.SpillingQueue(held=50), []
    for step in range(5000):
        if want and rng.random() < 0.4:
            least = min(want)
            assert queue.first() == least and queue.pop() == least
            want.remove(least)
        else:
            item = (rng.randint(-9, 9), rng.randint(0, 10**6))
            want.append(item)
            queue.push(item)
    assert queue.files and [queue.pop() for _ in range(len(want))] == sorted(want)
    assert queue.first() is None
    queue.close()


def test_time_forward_with_a_spilling_queue():
    """A broad, deep tree in one shard: totals are those of a walk from the leaves."""
    rng = random.Random(2)
    parent = {i: rng.randrange(max(0, i - 40), i) for i in range(1, 3000)}
    depth = {0: 0}
    for i in parent:
        depth[i] = depth[parent[i]] + 1
    leaves, children, saved = Counter(), Counter(parent.values()), Counter()
    for i in sorted(depth, key=lambda i: -depth[i]):
        leaves[i] = leaves[i] or 1
        saved[i] += i
        if i:
            leaves[parent[i]] += leaves[i]
            saved[parent[i]] += saved[i]
    rows = sorted((0, 0, -depth[i], i, 0, parent.get(i, -1), 0, i, 0, 0) for i in depth)
    out = list(convtrie.time_forward(((s, t, -d, *rest) for s, t, d, *rest in rows), held=20))
    assert {r[3]: r[7:] for r in out} == {i: (children[i], leaves[i], saved[i]) for i in depth}


@pytest.mark.parametrize("good, bad, n", [(5, 7, 4), (3, 0, 2), (10, 10, 20), (1, 9, 3), (40, 2, 30)])
def test_draws_have_the_hypergeometric_shares(good, bad, n):
    drawn = Counter(shardshuffle.draw(good, bad, n, u) for u in np.linspace(0.0005, 0.9995, 1000))
    for k in range(n + 1):
        assert abs(drawn[k] / 1000 - comb(good, k) * comb(bad, n - k) / comb(good + bad, n)) < 0.002


def test_draws_of_very_large_counts():
    mean, drawn = 600_000, [shardshuffle.draw(10**10, 39 * 10**10, 24_000_000, u) for u in (0.0001, 0.5, 0.9999)]
    assert drawn[1] == mean and 2500 < mean - drawn[0] < 3200 and 2500 < drawn[2] - mean < 3200


def test_matrix_rows_and_columns_add_up(spark):
    sizes = [(k, (k * 37) % 100) for k in range(300)]
    counts = spark.createDataFrame(sizes, "part long, n long")
    deal = {r.part: r.deal for r in shardshuffle.communication_matrix(counts, 7, 3).collect()}
    assert {k: sum(d) for k, d in deal.items()} == dict(sizes)
    total = sum(n for _, n in sizes)
    assert np.sum(list(deal.values()), axis=0).tolist() == shardshuffle.shard_sizes(total, 7).tolist()


def test_shards_are_exact_and_uniform(spark, monkeypatch):
    monkeypatch.setattr(shardshuffle, "PART_ROWS", 64)
    rows = spark.range(3000).selectExpr("id", "if(id < 1000, 'hot', cast(id as string)) as text").repartition(9)
    out = shardshuffle.shuffle_into_shards(rows, 7, seed=4).collect()
    assert sorted(r.id for r in out) == list(range(3000))
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(map(len, slots.values())) == sorted(shardshuffle.shard_sizes(3000, 7).tolist())
    # rows that share a third of ids, shards or halves of a shard fall as chance has it
    for chosen in (lambda r: r.id < 1000, lambda r: r.id % 3 == 0):
        count = Counter(r.shard for r in out if chosen(r))
        assert sum((count[s] - 1000 / 7) ** 2 / (1000 / 7 * 6 / 7 * 2 / 3) for s in range(7)) < 25
        early = sum(chosen(r) and r.slot < 214 for r in out)
        assert abs(early - 500) < 4.5 * (3000 * 0.25 * 2 / 9) ** 0.5


def test_a_large_part_is_cut(spark, monkeypatch):
    monkeypatch.setattr(shardshuffle, "PART_ROWS", 16)
    out = shardshuffle.shuffle_into_shards(spark.range(200).coalesce(1), 3).collect()
    assert sorted(Counter(r.shard for r in out).values()) == [66, 67, 67]


def test_shards_take_awkward_rows(spark):
    for docs in (documents(spark), clashing(spark), empty(spark), documents(spark).selectExpr("*", "1 as shard", "2 as slot")):
        out = shardshuffle.shuffle_into_shards(docs, 4)
        assert out.columns == [c for c in docs.columns if c not in ("shard", "slot")] + ["shard", "slot"]
        assert out.drop("shard", "slot").exceptAll(docs.drop("shard", "slot")).isEmpty()
        assert out.count() == docs.count()


@pytest.fixture(scope="module")
def models():
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def by_hand(models):
    """Tokens of both libraries, walked side by side."""
    import sentencepiece
    from tokenizers import Tokenizer

    from reefline.llm.bpe import byte_letters

    a = Tokenizer.from_file(models[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=models[1])
    letters = {c: i for i, c in enumerate(byte_letters())}

    def piece(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def align(rows):
        seen, total = [], Counter()
        for doc_id, text in rows:
            ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
            ids_b = b.encode(text) if text else []
            bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [piece(i) for i in ids_b]
            if text and not b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
                ids_a, ids_b = [], []
            ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
            links, i, j, groups, own_a, own_b = Counter(), 0, 0, [], [], []
            while i < len(ids_a):
                links[ids_a[i], ids_b[j]] += 1
                ea, eb = ends_a[i], ends_b[j]
                if ea <= eb:
                    own_a.append(str(ids_a[i]))
                    i += 1
                if eb <= ea:
                    own_b.append(str(ids_b[j]))
                    j += 1
                if ea == eb:
                    groups.append(",".join(own_a) + "|" + ",".join(own_b))
                    own_a, own_b = [], []
            total += links
            seen.append((doc_id, len(ids_a), len(ids_b), groups, links))
        best = Counter()
        for (_, j), n in total.items():
            best[j] = max(best[j], n)
        return sorted(
            (
                repr(d), na, nb, len(groups), sum(links.values()),
                sum(n for p, n in links.items() if total[p] == best[p[1]]),
                sum(n * total[p] for p, n in links.items()),
                hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
            )
            for d, na, nb, groups, links in seen
        )

    return align


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_against_the_libraries(spark, models, by_hand, monkeypatch):
    monkeypatch.setattr(tokenpairs, "SLICE_BYTES", 4000)  # several slices share pairs
    odd = ["a\n  b \n", "x  ", " lead", "tab\t\tq \t", "a▁b", "\n\n", " ", "a \n", "<|endoftext|> <s> <0x41>", "don't  stop\r\n", "世界" * 3000, "\x00\x1c \x85x"]
    docs = documents(spark, *[(100 + k, t, "en", "s", 1) for k, t in enumerate(odd)])
    found = tokenpairs.aligned(docs.repartition(3), *models, keep_groups=True)
    rows = found.collect()
    got = sorted((repr(r.doc_id), *[r[c] for c in COLUMNS]) for r in rows)
    assert got == by_hand([(r.doc_id, r.text) for r in docs.collect()])
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in rows if r.n_a)


@pytest.mark.parametrize("text", ["x ", "a b ", " x ", "été ", "a\t "])
def test_alignment_of_a_text_that_ends_in_one_space(spark, models, by_hand, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(repr(r.doc_id), *[r[c] for c in COLUMNS]) for r in tokenpairs.aligned(docs, *models).collect()]
    assert got == by_hand([(1, text)]) and got[0][1] > 0


def test_alignment_of_the_given_texts(spark, models, by_hand):
    from reefline.llm.queries import op13_token_alignment

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = sorted((repr(r.doc_id), *[r[c] for c in COLUMNS]) for r in op13_token_alignment(spark, folder).collect())
    assert got == by_hand([(r.doc_id, r.text) for r in docs.collect()])


def test_alignment_takes_clashes_and_empty_tables(spark, models):
    assert tokenpairs.aligned(clashing(spark), *models).count() == documents(spark).count()
    assert tokenpairs.aligned(empty(spark), *models).collect() == []


def test_group_ends_against_sets():
    rng = random.Random(3)
    for _ in range(300):
        ends = [sorted({*rng.sample(range(1, 200), rng.randint(1, 120)), 200}) for _ in range(2)]
        got = tokenpairs.group_ends(*map(np.array, ends), np.array([0]), np.array([len(ends[0]) - 1]))
        assert got.tolist() == [i for i, e in enumerate(ends[0]) if e in set(ends[1])]
