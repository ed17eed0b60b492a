import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlake.llm.bpe import PrefixCoder, encode_documents, load_ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return load_ranks(f.read())


@pytest.fixture(scope="module")
def coder(ranks):
    return PrefixCoder(ranks, public_tokenizers.PATTERN, memo=50)  # a small memo turns over all the time


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


BITS = ["a", "the", " ", "  ", "\n", "\r\n", "\t", "\x85", "\xa0", "　", "\x1c", "é", "ß", "日本", "😀", "12", "'s", "'ll", "!", "...", "ing", "A", "====", "aaaaaaaaaaaa"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=14).map("".join) | st.text(max_size=30))
def test_encodes_as_the_library_and_decodes_back(coder, library, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = coder.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


def test_pieces_of_random_tokens(coder, ranks, library):
    rng, tokens = random.Random(5), list(ranks)
    for _ in range(3000):
        piece = b"".join(rng.choices(tokens, k=rng.randint(1, 4)))
        assert coder.piece(piece) == library._core_bpe.encode_single_piece(piece)


def test_append_and_edit_equal_a_fresh_table(coder):
    rng = random.Random(7)
    text, table = b"theretherewithouting" * 12, []
    for cut in (3, 50, 120, len(text)):
        coder.extend(text[:cut], table)
    assert table == coder.extend(text, [])
    for _ in range(200):
        start = rng.randint(0, len(text))
        end = min(len(text), start + rng.randint(0, 5))
        text, table = coder.edit(text, table, start, end, bytes(rng.choices(b"abthe ing", k=rng.randint(0, 6))))
        assert table == coder.extend(text, [])


def test_frame(spark, library):
    rows = [(1, "Hello  world\n", "x", 5), (2, None, "y", 6), (3, "", "z", 7), (1, "Hello  world\n", "x", 5), (None, "ab " * 30000, "w", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    out = encode_documents(docs, PATH, public_tokenizers.PATTERN).collect()
    assert len(out) == 5
    for r in out:
        raw = (r.text or "").encode()
        want = np.array(library.encode_ordinary(r.text or ""), "<u4").tobytes()
        assert bytes(r.ids) == want and r.n_tokens == len(want) // 4
        assert r.ids_sha256 == hashlib.sha256(want).hexdigest() and r.decoded_sha256 == hashlib.sha256(raw).hexdigest()
    assert encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
