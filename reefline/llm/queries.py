"""Queries of this subpackage over the whole given tables, and SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.llm import (
    bpe,
    convtrie,
    decontam,
    linededup,
    neardup,
    pagetext,
    permindex,
    quality,
    secretscan,
    shardshuffle,
    substrings,
    tokenpairs,
    toxicity,
)
from reefline.llm.common import remainder, table

VOCABULARY = "word_bpe_49k.json"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, with the alignment's score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", F.explode("leaks").alias("leak")).select(
        "doc_id", "leak.item_id", "leak.score", F.col("leak.words").alias("n_words")
    )


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = pagetext.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_blocks", "n_main")


def digests(encoded: DataFrame) -> DataFrame:
    """Token counts and digests of encoded documents."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return digests(bpe.encode(table(spark, sf_dir, "documents"), vocabulary()))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; a third of the ids teaches nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = quality.train(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return _decided(quality.score(docs.select("doc_id", "text", held_out.alias("held_out")), model))


def _decided(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors found nearest to each twentieth vector."""
    return permindex.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the secrets in every document."""
    found = secretscan.scan(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = joined(F.filter("found", lambda s: s["kind"] != "guess"))
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        count("guess").alias("n_guess"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a fifth of the ids teaches nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return _decided(toxicity.score(docs.select("doc_id", "text", held_out.alias("held_out")), model))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without words that an earlier document's windows hold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.drop_repeated(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 48, 1))) AS k FROM w),
h AS (SELECT doc_id, k, sha256(array_to_string(words[k:k + 49], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
r AS (SELECT h.doc_id, list(h.k ORDER BY h.k) AS ks FROM h JOIN f USING (h) WHERE h.doc_id > f.least GROUP BY h.doc_id),
p AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
gone AS (SELECT DISTINCT doc_id, k + unnest(range(50)) AS i FROM (SELECT doc_id, unnest(ks) AS k FROM r)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM p ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without lines that three documents share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.drop_common_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


_KEY_SQL = (
    "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),"
    " 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)
OP9_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
k AS (SELECT doc_id, i, line, {_KEY_SQL} AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
kept AS (SELECT k.doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n
  FROM k LEFT JOIN c USING (key) WHERE c.key IS NULL OR k.doc_id = c.last GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(n, 0) AS BIGINT) AS n_dropped,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_transform(range(1, len(words) - 3), lambda k: array_to_string(words[k:k + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
links AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, c.doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of conversations that share heads with the first of their twenty."""
    return convtrie.conversation_trie(table(spark, sf_dir, "conversations"), span=20, most=3)


# crc32 by its table of 256 entries, which comes from the polynomial
OP11_SQL = r"""
WITH t AS (SELECT list(list_reduce(range(n, n + 9), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) AS crc
  FROM range(256) r(n)),
own AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1),
    lambda i: CAST(ascii(CAST(conv_id AS VARCHAR)[i]) AS BIGINT))), lambda c, b: xor(c // 256, crc[CAST(xor(c % 256, b) AS INTEGER) + 1]))) % 4 AS h
  FROM own, t),
c AS (SELECT h.conv_id, list_concat(coalesce(b.turns[:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM c),
m AS (SELECT conv_id AS member, depth, turns[:depth] AS path, depth = len(turns) AS ends,
  CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(turns[depth].t, '[^ 	-
]+')) END AS words FROM p),
n AS (SELECT path, depth, min(member) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
  sha256(coalesce(string_agg(CAST(member AS VARCHAR), ',' ORDER BY member) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY path, depth),
k AS (SELECT path[:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
s AS (SELECT path[:d] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (path) LEFT JOIN n u ON f.depth > 0 AND u.path = f.path[:f.depth - 1]
"""


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a uniform shuffle over 40 shards whose numbers of rows differ by one at most."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = shardshuffle.shuffle_into_shards(docs, 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of a byte-level and a piece tokenizer in every document."""
    found = tokenpairs.aligned(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), vocabulary(PIECE_BPE))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_decontamination": (op1_decontamination, None),
    "op2_html_extraction": (op2_html_extraction, None),
    "op3_bpe": (op3_bpe, None),
    "op4_quality": (op4_quality, None),
    "op5_permutation_index": (op5_permutation_index, None),
    "op6_secret_scan": (op6_secret_scan, None),
    "op7_toxicity": (op7_toxicity, None),
    "op8_substring_dedup": (op8_substring_dedup, OP8_SQL),
    "op9_line_dedup": (op9_line_dedup, OP9_SQL),
    "op10_minhash_near_dedup": (op10_minhash_near_dedup, OP10_SQL),
    "op11_conversation_trie": (op11_conversation_trie, OP11_SQL),
    "op12_sharding": (op12_sharding, None),
    "op13_token_alignment": (op13_token_alignment, None),
}
