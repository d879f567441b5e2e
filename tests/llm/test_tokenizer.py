import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from dwellscope.llm.tokenizer import Tokenizer, decoded, default_model, encoded, round_trip_digests

LIB = sentencepiece.SentencePieceProcessor(model_file=default_model())
OWN = Tokenizer(open(default_model(), "rb").read())


def same(text):
    ids = LIB.encode(text, add_eos=True)
    assert OWN.encode(text, end=True) == ids, text
    assert OWN.decode(ids) == LIB.decode(ids), text


@pytest.mark.parametrize("text", ["", " ", "  ", " " * 40 + "x", "a  b", "▁x ▁", "<s>hi</s>", "<0x41>", "a\tb\r\n\nc", "🙂 é é", "\x00", "aaaaaaaaaaaaaaaaaaaaaaaa", "ﬁ Å 漢字"])
def test_cases(text):
    same(text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="the inganrsolet\n ▁éß", max_size=80))
def test_mergeable_text(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=31999), max_size=12))
def test_decode_any_ids(ids):
    assert OWN.decode(ids) == LIB.decode(ids)


def test_long_text():
    rng = random.Random(1)
    same("".join(rng.choice("abcdeinot  .é") for _ in range(20000)))


def test_tables(spark):
    rows = [(1, "Hello  world", 9), (2, None, 9), (None, "", 9), (1, "Hello  world", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = round_trip_digests(docs, default_model()).collect()
    assert len(got) == 4 and sorted(r["n_tokens"] for r in got)[:2] == [1, 1]
    enc = encoded(docs, default_model())
    back = decoded(enc, default_model()).collect()
    assert sorted((r["decoded"]) for r in back) == ["", "", "Hello  world", "Hello  world"]
    assert round_trip_digests(docs.limit(0), default_model()).count() == 0
