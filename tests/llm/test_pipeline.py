"""The pipeline against a brute-force version of its stages, and on awkward rows."""

import hashlib

import duckdb
import numpy as np
import public_tokenizers
from cases import documents, empty
from test_dedup_llm import components_by_hand, lines_by_hand
from test_finding import align_by_hand, plain_words
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from reefline.llm import toxicity
from reefline.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    con = duckdb.connect()
    rows = con.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    items = [plain_words(t) for (t,) in con.sql(f"SELECT text FROM '{FOLDER}/benchmark.parquet'").fetchall()]
    docs = table(spark, FOLDER, "documents")
    model = toxicity.train(docs, table(spark, FOLDER, "labels"))
    if model is not None:
        scorer = toxicity.Scorer(model)
        rows = [(d, t) for d, t in rows if np.r_[scorer.texts([t])[0], 1] @ model["curve"] < 0]
    texts = lines_by_hand(rows)
    component = components_by_hand(list(texts.items()))
    left = {d: t for d, t in texts.items() if component[d][1] == d}
    for d in list(left):
        words = plain_words(left[d])
        pairs = set(zip(words, words[1:]))
        for item in items:
            if sum(p in pairs for p in zip(item, item[1:])) >= len(item) // 4 and align_by_hand(item, words) >= len(item):
                left.pop(d, None)
                break
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    want = {}
    for d, t in left.items():
        ids = library.encode(t, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[d] = (len(ids), *(hashlib.sha256(b).hexdigest() for b in (np.array(ids, dtype="<u4").tobytes(), decoded.encode())))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, FOLDER).collect()}
    assert got == want


def test_stages_take_awkward_rows(spark):
    for docs in (documents(spark), empty(spark)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            assert len(out.collect()) <= docs.count()
            if name != pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns and out.dtypes == docs.dtypes
