"""BPE against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pytest
from cases import LONG, clashing, documents, empty
from tokenizers import Tokenizer

from reefline.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_model(PATH))


def same(encoder, library, texts):
    found = list(encoder.encode(texts))
    for text, ids, decoded, want in zip(texts, found, encoder.decode(found), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == want.ids, repr(text)
        assert decoded == library.decode(want.ids, skip_special_tokens=False), repr(text)


def test_random_texts(encoder, library):
    rng = random.Random(3)
    letters = "abcdeinothsr'AB $!|.é ñ9</w>́ßΣ\x1c\x85　"
    same(encoder, library, ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(4_000)])


def test_special_tokens_repeats_and_contractions(encoder, library):
    same(encoder, library, ["x<|endoftext|>y <|startoftext|>", "<|endoftext|><|endoftext|>", "", "aaaa aaaaaaa abababab", "it's THEY'LL 's", "ΑΣ Σ"])


def test_common_letters_of_the_first_plane(encoder, library):
    blocks = [range(0x20, 0x250), range(0x370, 0x400), range(0x400, 0x500), range(0x4E00, 0x4E80), range(0x1F600, 0x1F640)]
    same(encoder, library, [f"a{chr(c)}b {chr(c)}" for block in blocks for c in block])


def test_a_small_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 1_000)
    monkeypatch.setattr(bpe, "KNOWN_PAIRS", 5)
    encoder = bpe.Encoder(bpe.read_model(PATH))
    for _ in range(3):
        same(encoder, library, ["the cat sat on the mat again and again", "other words the cat"])


def test_a_long_text_is_cut_at_white_space(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_BYTES", 1)
    rng = random.Random(4)
    for size in (3, 40):
        text = "".join(rng.choices("ab'sé ́Σ\n\t\x1c.!<|endoftext|> ", k=2_000))
        pieces = list(bpe.parts(text, size))
        assert "".join(pieces) == text and len(pieces) > 10
        monkeypatch.setattr(bpe, "parts", lambda t: iter(pieces))
        same(encoder, library, [text])
        monkeypatch.undo()


def test_awkward_rows(spark, library):
    for docs in (documents(spark), clashing(spark)):
        rows = bpe.encode(docs, PATH).collect()
        assert len(rows) == docs.count()
        by_id = {r.doc_id: r for r in rows}
        assert by_id[1].ids == b"" and by_id[2].ids == b"" and by_id[1].decoded == ""
        assert len(by_id[3].ids) == 4 * len(library.encode(LONG, add_special_tokens=False).ids)
    assert bpe.encode(empty(spark), PATH).count() == 0
