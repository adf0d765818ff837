import base64

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import tokenize as T
from loomgraph.llm.queries import TOKENIZERS

PATH = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
RANKS = T.load_ranks(PATH)
REFERENCE = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = T.Encoder(RANKS)
VOCABULARY = {v: k for k, v in RANKS.items()}


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    ids = ENCODER.encode(text)
    assert ids == REFERENCE.encode_ordinary(text) and T.decode(ids, VOCABULARY) == text


@pytest.mark.parametrize("text", ["", "a" * 5000, "<|endoftext|> x", "don't I'll", "  \n\n  x\r\n\t", "👩‍👩‍👧‍👦🏳️‍🌈½ ² Ⅷ", "aaaaabbbbbaaaaabbbbb" * 40, "ab" * 3000])
def test_hard_texts(text):
    assert ENCODER.encode(text) == REFERENCE.encode_ordinary(text)


def test_bounded_memory():
    small = T.Encoder(RANKS, entries=3)
    text = " ".join(f"word{i}" for i in range(50))
    assert small.encode(text) == REFERENCE.encode_ordinary(text) and len(small) <= 4


def test_corpus(spark):
    rows = [(1, "hello <|endoftext|>", "x"), (2, "", None), (3, None, "y"), (3, None, "y"), (4, "x" * 100_000, "z")]
    got = T.encode_corpus(spark.createDataFrame(rows, "id bigint, text string, ids string"), key="id", text="text", vocabulary=PATH)
    assert got.columns == ["id", "ids"] and dict(got.dtypes)["ids"] == "array<int>"
    out = sorted((r["id"], r["ids"]) for r in got.collect())
    assert out == sorted((i, REFERENCE.encode_ordinary(t) if t else []) for i, t, _ in rows)
    empty = T.encode_corpus(spark.createDataFrame([], "id string, text string"), key="id", text="text", vocabulary=PATH)
    assert empty.count() == 0


def test_vocabulary_file():
    with open(PATH, "rb") as f:
        first = f.readline().split()
    assert RANKS[base64.b64decode(first[0])] == int(first[1])
