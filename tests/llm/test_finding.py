"""Decontamination, page text, secrets and nearest vectors against brute force."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from cases import SCHEMA, clashing, documents, empty
from pyspark.sql import functions as F

from reefline.llm import decontam, pagetext, permindex, secretscan
from reefline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"

# decontamination


def align_by_hand(item, passage):
    """Smith-Waterman cell by cell."""
    best, above = 0, [0] * (len(passage) + 1)
    for a in item:
        row = [0]
        for j, b in enumerate(passage, 1):
            row.append(max(0, above[j - 1] + (2 if a == b else -1), above[j] - 1, row[j - 1] - 1))
            best = max(best, row[j])
        above = row
    return best


def test_alignment_cell_by_cell():
    rng = random.Random(2)
    for _ in range(60):
        a, b = (np.array(rng.choices(range(4), k=rng.randint(1, 25)), dtype=np.uint64) for _ in range(2))
        assert decontam.align(a, b)[0] == align_by_hand(a.tolist(), b.tolist())


def plain_words(text):
    return [w for w in (x.strip("".join(chr(c) for c in range(128) if not chr(c).isalnum())) for x in (text or "").lower().split()) if w]


def test_whole_table_against_brute_force(spark):
    con = duckdb.connect()
    docs = con.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    items = con.sql(f"SELECT item_id, text FROM '{FOLDER}/benchmark.parquet'").fetchall()
    got = {(r.doc_id, r.item_id): r.score for r in QUERIES["op1_decontamination"][0](spark, FOLDER).collect()}
    words = {d: plain_words(t) for d, t in docs}
    for item_id, text in items:
        own = plain_words(text)
        grams = {tuple(own[k : k + 2]) for k in range(len(own) - 1)}
        for d, w in words.items():
            shared = sum(tuple(w[k : k + 2]) in grams for k in range(len(w) - 1))
            if shared < len(own) // 4:  # too few word pairs for half of the score
                assert (d, item_id) not in got
                continue
            score = align_by_hand(own, w) / (2 * len(own))
            assert ((d, item_id) in got) == (score >= 0.5), (d, item_id, score)
            if score >= 0.5:
                assert got[d, item_id] == pytest.approx(score)


def test_edited_copies_are_found_and_clean_texts_left(spark):
    rng = random.Random(4)
    vocabulary = [f"word{k}" for k in range(2_000)]
    items = [" ".join(rng.choices(vocabulary, k=rng.randint(12, 60))) for _ in range(20)]
    docs, want = [], set()
    for k in range(200):
        body = rng.choices(vocabulary, k=rng.randint(0, 300))
        if k % 4 == 0:
            j = rng.randrange(20)
            copy = items[j].split()
            for _ in range(len(copy) // 6):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], ["EDIT"], [copy[at], "added"]])
            body[len(body) // 2 : len(body) // 2] = [copy[0].upper() + ","] + copy[1:]
            want.add((k, j))
        docs.append((k, " ".join(body)))
    got = decontam.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    )
    assert {(r.doc_id, leak.item_id) for r in got.collect() for leak in r.leaks} == want


def test_an_item_that_leaked_everywhere_is_still_found(spark):
    item = "the seven grey foxes walked over nine cold bridges toward an old mill before dawn"
    docs = spark.createDataFrame([(k, f"text {k} {item} end {k}") for k in range(300)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "mill")], "item_id long, text string")
    got = decontam.find_leaks(docs, bench).collect()
    assert all([leak.item_id for leak in r.leaks] == [1] for r in got) and len(got) == 300


FIFTHS = "the seven grey foxes walked over nine cold bridges toward an old mill before dawn while every single miller slept"


@pytest.mark.parametrize("edited, exact, clean", [(300, 0, 0), (1, 0, 20), (300, 40, 0), (15, 3, 2_000)])
def test_copies_with_every_fifth_word_replaced_are_found(spark, edited, exact, clean):
    copy = " ".join("EDIT" if k % 5 == 4 else w for k, w in enumerate(FIFTHS.split()))
    texts = [f"start {copy} end"] * edited + [f"start {FIFTHS} end"] * exact + ["nothing of the kind is said in here at all"] * clean
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontam.find_leaks(docs, spark.createDataFrame([(1, FIFTHS)], "item_id long, text string")).collect()
    assert {r.doc_id for r in got if r.leaks} == set(range(edited + exact))


@pytest.mark.parametrize(
    "item, text, matched",
    [
        ("a1 a2 a3 a4 a5 a6 a7 a8 a9", "x a1 a2 a3 a4 EDIT a6 a7 a8 a9 y", 8),
        ("a1 a2 a3 a4 a5 a6 a7 a8 a9 b1 b2 b3", "x a1 a2 a3 EDIT a5 a6 EDIT a8 a9 EDIT b2 b3 y", 9),
        ("a1 a2 a3 a4 a5 a6 a7 a8", "x a1 a2 a3 a4 EDIT a6 a7 a8 y", 7),
        ("a1 a2 a3 a4 a5 a6", "x a1 a2 a3 EDIT a5 a6 y", 5),
        ("a1 a2 a3 a4 a5", "x a1 a2 EDIT a4 a5 y", 4),
        ("a1 a2 a3 a4 a5", "x a1 a2 a4 a5 y", 4),
        ("a1 a2 a3 a4", "x a1 EDIT a3 a4 y", 3),
        ("a1 a2 a3 a4", "x a1 a2 EDIT a3 a4 y", 4),
        ("a1 a2 a3", "x a1 a2 EDIT a3 y", 3),
        ("a1 a2", "x A1, a2. y", 2),
        ("a1 a2", "x a1 EDIT a2 y", None),
        ("a1 a2 a3 a4", "x a1 a2 a3 y", None),
        ("a1 a2 a3", "x a1 EDIT a3 y", None),
        ("水は零度で氷になる", "昔から水は零度で氷になると言われる。", 9),
        ("水は零度で氷になる", "水は零度に氷になる", 8),
        ("氷点", "水の氷点は零度", 2),
    ],
)
def test_edited_copies_of_short_items(spark, item, text, matched):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    leaks = decontam.find_leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()[0].leaks
    assert [leak.words for leak in leaks] == ([] if matched is None else [matched])


def test_items_in_several_blocks_give_the_same(spark, monkeypatch):
    docs, bench = documents(spark), spark.createDataFrame([(k, f"alpha beta gamma {w}") for k, w in enumerate("abcd")], "item_id long, text string")
    whole = decontam.find_leaks(docs, bench).collect()
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 5)
    assert sorted(map(str, decontam.find_leaks(docs, bench).collect())) == sorted(map(str, whole))


def test_leaks_of_awkward_rows(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    for docs in (documents(spark), clashing(spark)):
        rows = decontam.find_leaks(docs, bench).collect()
        assert len(rows) == docs.count()
        found = {r.doc_id: [leak.score for leak in r.leaks] for r in rows}
        assert found[3] == [1.0] and found[4] == [1.0] and found[1] == [] and found[None] == []
        assert {r.doc_id: r.text for r in rows}[1] is None
    assert decontam.find_leaks(empty(spark), bench).count() == 0
    assert all(r.leaks == [] for r in decontam.find_leaks(documents(spark), bench.limit(0)).collect())


# page text


def main_text(page):
    return " ".join(b.text for b in pagetext.classify(page) if b.label == "good")


def article_by_hand(page):
    """The text between the article's tags of the given pages, whose form is known."""
    import html

    start = page.index("<article>") + 9
    end = page.find("</article>")
    part = page[start : end if end >= 0 else len(page)]
    part = re.sub(r"</?(p|h1)>", "\n", part.replace("<br>", " "))
    return " ".join(html.unescape(re.sub(r"<[^>]*>|<[^>]*$", "", part)).split())


def test_pages_against_their_known_form(spark):
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{FOLDER}/pages.parquet'").fetchall())
    got = QUERIES["op2_html_extraction"][0](spark, FOLDER).collect()
    assert {r.page_id: r.text for r in got} == {k: article_by_hand(p) for k, p in pages.items()}
    assert all(r.n_chars == len(r.text) for r in got)


LOREM = "This is a sentence of the story that we have for you, and it is as long as it has to be in order to count as text. "


def test_page_without_article_is_told_by_its_blocks():
    page = f"""<html><head><title>T</title><style>p {{}}</style></head><body><header><h1>Site</h1></header>
      <ul class=menu><li><a href=/a>One</a></li></ul><div id="main"><h2>Heading</h2><p>{LOREM}</p><p>Short.</p><p>{LOREM}</p></div>
      <div class="cookie-notice"><p>{LOREM}</p></div><section id="comments"><p>{LOREM}</p></section>
      <form><p>{LOREM}</p></form><aside>{LOREM}</aside><script>var x = "<p>{LOREM}</p>";</script><footer>&copy; me</footer></body></html>"""
    assert main_text(page) == f"Heading {LOREM.strip()} Short. {LOREM.strip()}"


def test_article_drops_what_does_not_belong():
    page = f"""<nav>{LOREM}</nav><article><h1>A &amp; B</h1><p>Few words.</p><div class="ad banner"><p>{LOREM}</p></div>
      <p>{LOREM}<br>more</p><ul class="share"><li>x</li></ul><div class="comments"><p>{LOREM}</p></div><!-- <p>no</p> --></article><p>{LOREM}</p>"""
    assert main_text(page) == f"A & B Few words. {LOREM.strip()} more"


@pytest.mark.parametrize(
    "beside",
    [
        '<section id="comments"><article><p>So true.</p></article></section>',
        f'<div><article class="comment"><p>{LOREM}</p></article><article class="comment"><p>{LOREM}</p></article></div>',
        '<div class="sidebar"><article><h3>Teaser</h3><p>Few words.</p></article></div>',
        '<div><article><h3><a href="/x">Teaser</a></h3><a href="/x">Few linked words.</a></article></div>',
        f'<div><article><a href="/x">Teaser</a><p>{"Some teaser of another page that is here only for its length, as teasers are."}</p></article></div>',
    ],
)
def test_articles_beside_the_text_do_not_lose_it(beside):
    text = main_text(f"<body><div><h2>Heading</h2><p>{LOREM}</p><p>{LOREM}</p></div>{beside}</body>")
    assert text.startswith(f"Heading {LOREM.strip()} {LOREM.strip()}")
    assert text.count(LOREM.strip()) == 2


@pytest.mark.parametrize(
    "element",
    [
        '<svg viewBox="0 0 1 1"/>', "<math/>", "<object data=x>", "<select>", "<video src=v>", "<audio src=a>", "<canvas>", "<svg>", '<video src="v"/>',
        "<svg><svg><text>no</text></svg><text>no</text></svg>", "<object><object>no</object>no</object>", "<select><option>no</option></select>",
        "<video src=v><p>x</p></object>",
    ],
)
@pytest.mark.parametrize("later", ["", "<svg><title>no</title></svg><video>no</video><object>no</object>"])
def test_elements_that_close_themselves_or_never(element, later):
    want = f"{LOREM.strip()} {'x ' if '<p>x' in element else ''}{LOREM.strip()}"
    assert main_text(f"<article><p>{LOREM}</p>{element}<p>{LOREM}</p>{later}</article>") == want


@pytest.mark.parametrize("page", ["", "<", "<p", "<p>", "</p></div>", "<a href='", "<!--", "<script>", "&#x110000; &bogus; &amp", "<" * 5_000, "<p>" * 20_000, "<a '" * 3_000])
def test_broken_pages_do_not_fail(page):
    assert isinstance(main_text(page), str)


def test_awkward_pages(spark):
    pages = spark.createDataFrame(
        [(1, None, None, 1), (2, "u", "", 1), (None, "u", f"<p>{LOREM}</p>", 1), (3, "u", f"<article>{f'<p>{LOREM}</p>' * 5_000}</article>", 1), (2, "u", "", 1)],
        "page_id long, url string, html string, text int",
    )
    rows = pagetext.extract(pages).collect()
    assert len(rows) == 5
    assert {r.page_id: len(r.text) for r in rows} == {1: 0, 2: 0, None: len(LOREM) - 1, 3: 5_000 * len(LOREM) - 1}
    assert pagetext.extract(pages.limit(0)).count() == 0


SENTENCE = "The people of the town were at the market and they had all that was in it for the day. "
CHINESE = "我们在这个城市里生活了很多年，他们也都是我的朋友，所以今天大家要一起去看那一座新的桥。"


@pytest.mark.parametrize(
    "page, want",
    [
        ('<body><p class="a"">Hello "world" of the people and it is what they were in.' + SENTENCE * 2 + "</p><p>" + SENTENCE * 2 + "</p>", "Hello"),
        ("<body><article><p title='it's'>" + SENTENCE * 2 + "</p></article>", "The people"),
        ('<body><div class="post has-sidebar"><p>' + SENTENCE * 2 + "</p></div>", "The people"),
        ('<body><div class="article-share-count"><p>' + SENTENCE * 2 + "</p></div>", "The people"),
        ('<body><div class="widget"><p>' + SENTENCE * 2 + "</p></div>", "The people"),  # a name alone does not empty a page
        ("<body><div><p>" + CHINESE * 3 + "</p><p>" + CHINESE * 4 + '</p></div><div><a href="/">首页</a> <a href="/b">目录</a></div>', "我们"),
    ],
)
def test_text_that_stays(page, want):
    found = main_text(page)
    assert found.startswith(want) and "目录" not in found
    assert found.count("market") == page.count("market") and found.count("城市") == page.count("城市")


@pytest.mark.parametrize("name", ["site-header-wrap", "main-nav", "comment-list", "sidebar-left", "post-comments", "cookie-banner", "related"])
def test_names_of_what_goes(name):
    page = f'<body><div class="{name}"><p>Gone. {SENTENCE * 2}</p></div><div class="entry-header"><p>Kept. {SENTENCE * 2}</p></div><p>{SENTENCE * 2}</p>'
    assert main_text(page).startswith("Kept.") and "Gone" not in main_text(page)


def test_tags_are_read_as_browsers_read_them():
    page = f"""<body><div data-x='a > b' class = "main" hidden-not ="x" =odd="1"/ ><p>{SENTENCE * 2}</p></div><p class="x>{SENTENCE}"""
    assert main_text(page) == " ".join((SENTENCE * 3).split())  # a quote that is never closed takes no text with it


# secrets


def base_by_hand(text):
    spans = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_base_spans_against_brute_force(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall())
    got = QUERIES["op6_secret_scan"][0](spark, FOLDER).collect()
    assert {r.doc_id: r.base_sha256 for r in got} == {d: hashlib.sha256(base_by_hand(t).encode()).hexdigest() for d, t in texts.items()}


def test_quick_test_misses_no_span(spark):
    rng = random.Random(6)
    parts = ["password", "PassWd", "secret", "Token", "apikey", "API_KEY", "pass", "pwd", '"', "'", " ", "  ", "=", ":", "abc123", "xK9#mQ2$vL", "AKIA" + "Q7" * 9, "0123456789abcdef" * 2, "é", "\U0001f600", "ſecret", "\n"]
    texts = ["".join(rng.choices(parts, k=12)) for _ in range(600)]
    got = secretscan.scan(spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], SCHEMA)).collect()
    for r in got:
        own = [(s.start, s.end, s.kind, s.bits) for s in r.found]
        assert own == secretscan.find(texts[r.doc_id])
        assert ",".join(f"{k}:{a}:{b}" for a, b, k, _ in own if k != "guess") == base_by_hand(texts[r.doc_id])


def guesses_by_hand(value):
    """Least bits over every way to cut the value, by recursion."""
    import math
    from functools import lru_cache

    spans = list(secretscan.segments(value))
    brute = math.log2(secretscan.alphabet(value))

    @lru_cache(None)
    def cost(end):
        if not end:
            return 0.0
        return min([cost(end - 1) + brute, *(cost(a) + bits + 1 for a, b, _, bits in spans if b == end)])

    return cost(len(value))


@pytest.mark.parametrize("value", ["", "password1", "P@ssw0rd2020", "qwertyuiop", "aaaaaaaa", "abcabcabc", "xK9#mQ2$vL", "19991231", "dragonqwerty1984"])
def test_guess_bits(value):
    assert secretscan.guess_bits(value) == pytest.approx(guesses_by_hand(value))


def test_hard_values_become_spans_and_easy_ones_do_not():
    assert [s[2] for s in secretscan.find('pwd: "xK9#mQ2$vLw7"')] == ["guess"]
    assert secretscan.find("pwd: qwerty123") == []
    assert [s[2] for s in secretscan.find("password=qwerty123")] == ["assign"]
    text = "token = " + "a1" * 20_000
    assert secretscan.find(text)[0][:3] == (0, len(text), "assign")


@pytest.mark.parametrize(
    "text, value",
    [
        ('dbPassword: "p@55w!rdX9"', "p@55w!rdX9"),
        ("PGPASSWORD=k@3x!9q2mz", "k@3x!9q2mz"),
        ("userToken= a!b7#kQ2", "a!b7#kQ2"),
        ("pwd=k3x9q2mz", "k3x9q2mz"),
        ("pwd=kX3q9Zm", "kX3q9Zm"),
        ("pwd=k3x9q2m", "k3x9q2m"),
        ("my_db-passphrase.old: k3x9q2mz", "k3x9q2mz"),
    ],
)
def test_key_words_inside_names_and_short_random_values(spark, text, value):
    found = secretscan.scan(spark.createDataFrame([(1, text, None, None, None)], SCHEMA)).collect()[0].found
    assert [text[s.start : s.end] for s in found if s.kind == "guess"] == [value]


def test_secrets_of_awkward_rows(spark):
    for docs in (documents(spark), clashing(spark)):
        rows = secretscan.scan(docs).collect()
        assert len(rows) == docs.count() and all(r.found == [] for r in rows)
    assert secretscan.scan(empty(spark)).count() == 0


# nearest vectors


def nearest_by_hand(rows, k):
    ids = np.array([r[0] for r in rows])
    v = np.array([r[1] for r in rows], dtype=float)
    out = {}
    for q, own in zip(ids, v):
        if q % 20 == 0:
            product = (v * own).sum(axis=1)
            order = [i for i in np.lexsort((ids, -product)) if ids[i] != q][:k]
            out[int(q)] = [(int(ids[i]), product[i]) for i in order]
    return out


def recall(found, want):
    return float(np.mean([len({v for v, _ in w} & {r.vec_id for r in found if r.query_id == q}) / len(w) for q, w in want.items()]))


def test_recall_of_the_query(spark):
    folder = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{folder}/embeddings.parquet'").fetchall()
    found = QUERIES["op5_permutation_index"][0](spark, folder).collect()
    want = nearest_by_hand(rows, 20)
    assert len(found) == 20 * len(want) and recall(found, want) >= 0.9
    vectors = {i: np.array(v) for i, v in rows}
    for r in found[:300]:
        assert r.score == pytest.approx(float(vectors[r.query_id] @ vectors[r.vec_id]), abs=1e-12)


def test_many_segments_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(permindex, "SEGMENT", 300)
    monkeypatch.setattr(permindex, "QUERY_BLOCK", 20)
    monkeypatch.setattr(permindex, "LEAST_RERANK", 100)
    rng = np.random.default_rng(3)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(1_500, 16)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = permindex.nearest(df, F.col("vec_id") % 20 == 0, 10).collect()
    assert len(found) == 75 * 10 and recall(found, nearest_by_hand(rows, 10)) >= 0.9


def test_ties_and_unusable_vectors(spark):
    one, two = [1.0, 0.0, 0.5], [0.0, 1.0, 0.0]
    rows = [(k, one, 1) for k in range(30)] + [(40, two, 1), (41, None, 1), (42, [0.0, 0.0, 0.0], 1), (43, [1.0, None, 0.0], 1), (44, [float("nan"), 1.0, 0.0], 1), (45, [float("inf"), 1.0, 0.0], 1), (60, [], 1), (80, [1.0], 1), (None, one, 1), (3, one, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    found = permindex.nearest(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in found} == {0, 20, 40}
    assert [r.vec_id for r in found if r.query_id == 0] == list(range(1, 21))
    assert [r.vec_id for r in found if r.query_id == 20] == list(range(20))
    assert [r.rank for r in found if r.query_id == 40] == list(range(1, 21))
    few = spark.createDataFrame(rows[:3], df.schema)
    assert permindex.nearest(few, F.col("vec_id") % 20 == 0, 20).count() == 2
    assert permindex.nearest(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0
