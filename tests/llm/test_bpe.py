import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dossier.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Codec(file.read()), Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab the'sl\n\t  1½é<|>\x1c\x85"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_as_the_library(both, text):
    codec, library = both
    ids = library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == ids
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_special_and_long(both):
    codec, library = both
    for text in ("a<|endoftext|> b", "<|endoftext|><|endoftext|>", "ab" * 5000, " " * 300):
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_round_trip(both, odd, empty):
    codec, library = both
    for row, text in zip(bpe.round_trip(odd, PATH).collect(), [r.text for r in odd.collect()]):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(empty, PATH).count() == 0
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(odd, PATH), PATH).collect()}
    assert back[8] == "ça été 1½ \U0001f600 <|endoftext|> end"
