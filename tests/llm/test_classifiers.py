"""Quality and toxicity: held-out accuracy and awkward rows."""

import zlib

import duckdb
import numpy as np
import pytest
from cases import clashing, documents, empty

from reefline.llm import quality, toxicity
from reefline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


def held_out(name, label, spark):
    truth = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{FOLDER}/labels.parquet' WHERE {label} IS NOT NULL").fetchall())
    rows = QUERIES[name][0](spark, FOLDER).collect()
    return rows, [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]


def test_quality_on_held_out_rows(spark):
    rows, pairs = held_out("op4_quality", "quality", spark)
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    good, bad = ([p for p, t in pairs if t == k] for k in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05


def test_toxicity_on_held_out_rows(spark):
    rows, pairs = held_out("op7_toxicity", "toxic", spark)
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    toxic, clean = ([p for p, t in pairs if t == k] for k in (1, 0))
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.02


def test_toxicity_training_does_not_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    one, two = (toxicity.train(docs.repartition(n), labels.repartition(n + 2)) for n in (3, 10))
    assert all(np.array_equal(one[k], two[k]) for k in ("place", "weight", "bias", "curve"))


def test_a_words_form_is_that_of_the_whole_word():
    assert quality.shape("Ab" + "c" * 500 + "99-xY") == "Aa9-aA"


def features_by_hand(text):
    """Places and counts of words, forms and their pairs, one by one."""
    import xxhash

    def high(x):
        return x * int(quality.SALTS[1]) % 2**64 >> 64 - quality.BITS

    words = text.split()
    hashes = [xxhash.xxh3_64_intdigest(w.lower()) for w in words]
    forms = [xxhash.xxh3_64_intdigest("\0" + quality.shape(w)) for w in words]
    forms = [f if k == 0 or hashes[k] != hashes[k - 1] else (f + 0x51ED270B) % 2**64 for k, f in enumerate(forms)]
    salts = [int(x) for x in quality.SALTS]
    found = [high(h * salts[0] % 2**64) for h in hashes] + [high(f * salts[1] % 2**64) for f in forms]
    for values, salt in ((hashes, salts[2]), (forms, salts[3])):
        found += [high((a * salt % 2**64) ^ (b * salts[0] % 2**64)) for a, b in zip(values, values[1:])]
    weight = {p: np.log1p(found.count(p)) for p in found}
    size = sum(w * w for w in weight.values()) ** 0.5
    return {p: w / size for p, w in weight.items()}


def test_features_and_scores_against_brute_force(spark):
    texts = ["One two TWO two.", "x", "a1 b2 a1 b2 " * 20, "é ß\tÉ  Ω9"]
    rng = np.random.default_rng(2)
    w = rng.normal(size=1 << quality.BITS)
    for text in texts:
        place, weight = quality.Features()(text)
        assert dict(zip(place.tolist(), weight)) == pytest.approx(features_by_hand(text))
    docs = spark.createDataFrame(list(enumerate([*texts, "", None])), "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(docs, (w, 0.25)).collect()}
    for k, text in enumerate([*texts, "", ""]):
        total = sum(w[p] * v for p, v in features_by_hand(text).items()) + 0.25 if text else 0.25
        assert got[k] == pytest.approx(1 / (1 + np.exp(-total)), rel=1e-5)


def test_ftrl_against_its_formula():
    """Two features, three rows, one pass, step by step."""
    rows = [(np.array([3]), np.array([1.0]), 1), (np.array([3, 9]), np.array([0.6, 0.8]), 0), (np.array([9]), np.array([1.0]), 1)]
    z, n = {}, {}
    share = {1: 3 / 4, 0: 3 / 2}

    def solve(k):
        if abs(z.get(k, 0.0)) <= quality.L1:
            return 0.0
        return -(z[k] - np.sign(z[k]) * quality.L1) / ((quality.BETA + n[k] ** 0.5) / quality.ALPHA + quality.L2)

    for r in np.random.default_rng(7).permutation(3):
        place, value, y = rows[r]
        # the bias is a feature of value 1 (its own step is not scaled by 8)
        parts = [(int(k), 8 * v) for k, v in zip(place, value)] + [("bias", 1.0)]
        weights = {k: solve(k) for k, _ in parts}
        p = 1 / (1 + np.exp(-sum(weights[k] * v for k, v in parts)))
        for k, v in parts:
            g = (p - y) * share[y] * v
            after = n.get(k, 0.0) + g * g
            z[k] = z.get(k, 0.0) + g - (after**0.5 - n.get(k, 0.0) ** 0.5) / quality.ALPHA * weights[k]
            n[k] = after
    w, bias = quality.ftrl(rows, epochs=1)
    assert {k: w[k] for k in (3, 9)} == pytest.approx({k: 8 * solve(k) for k in (3, 9)})
    assert bias == pytest.approx(solve("bias")) and np.count_nonzero(w) == 2


def test_ftrl_learns_a_linear_rule():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(400):
        y = int(rng.random() < 0.5)
        place = np.unique(np.r_[rng.integers(100, 5_000, 20), 7 if y else 8])
        rows.append((place, np.full(len(place), 1 / np.sqrt(len(place))), y))
    w, bias = quality.ftrl(rows)
    assert np.mean([((w[p] @ v + bias) > 0) == y for p, v, y in rows]) > 0.99
    assert (w == 0).sum() > len(w) // 2


def kernel_by_hand(a, b):
    def triples(word):
        out = {}
        w = f"^{word}$"
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    t = w[i] + w[j] + w[k]
                    out[t] = out.get(t, 0.0) + toxicity.DECAY ** (k - i + 1)
        return out

    def scale(word):
        n = len(word) + 2
        return sum(toxicity.DECAY ** (2 * (k - i + 1)) for i in range(n) for k in range(i + 2, min(n, i + toxicity.SPAN)) for _ in range(k - i - 1)) ** 0.5

    x, y = triples(a), triples(b)
    return sum(v * y.get(t, 0.0) for t, v in x.items()) / (scale(a) * scale(b))


@pytest.mark.parametrize("a, b", [("idiot", "idiot"), ("idiot", "idxiot"), ("abc", "xyz"), ("é", "été"), ("aaaaaa", "aaa"), ("loweischaft", "lowei")])
def test_kernel_against_brute_force(a, b):
    assert toxicity.kernel([a, "", b], [b])[0, 0] == pytest.approx(kernel_by_hand(a, b), abs=1e-4)


def test_gapped_and_inserted_insults(spark):
    rng = np.random.default_rng(1)
    clean = ["".join(rng.choice(list("abdehilnorst"), rng.integers(2, 9))) for _ in range(800)]
    rows, labels = [], []
    for k in range(600):
        words = list(rng.choice(clean, 40))
        if k % 4 == 0:
            words[k % 40] = ["vermin", "numskull", "halfwit"][k // 4 % 3]
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    plain = " ".join(clean[:30])
    probes = [f"{plain} {w}" for w in ("vermin", "v.e.r.m.i.n", "ver-min!", "v e r m i n", "verxmin", "Halfwit", "num_skull")] + [plain, " ".join(clean[50:90])]
    scored = toxicity.score(spark.createDataFrame(list(enumerate(probes)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.score >= 0.5 for r in scored] == [True] * 7 + [False] * 2


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, 1), (5, 1), (7, 0), (99, 1), (None, 1), (1, None), (2, 5)], "doc_id long, v int")
    for docs in (documents(spark), clashing(spark)):
        for module, label in ((quality, "quality"), (toxicity, "toxic")):
            model = module.train(docs, labels.withColumnRenamed("v", label))
            rows = module.score(docs, model).collect()
            assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
            scores = {r.doc_id: r.score for r in rows}
            assert scores[1] == scores[2]
            assert module.score(docs, module.train(docs, labels.limit(0).withColumnRenamed("v", label))).count() == docs.count()
            assert module.score(empty(spark), model).count() == 0
            assert module.train(empty(spark), labels.withColumnRenamed("v", label)) is None


def test_without_labels_scores_are_fixed(spark):
    docs = documents(spark)
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
