"""Words, hashes, token ids and token counts."""

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from geotrail.llm import encoding, textbuf, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n", "\r\n", "\t", " ", " ", "\x85", "\x1c", "  a", "a  b", " é", "ñ ", "don't", "<|endoftext|>", "42", "\n\n", "日本", "🙂", "a.\nB", "x \n y"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return encoding.PieceEncoder(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=6)), max_size=12).map("".join), min_size=1, max_size=5))
def test_ids_are_those_of_whole_texts(tokenizer, coder, texts):
    ((_, data, offsets),) = textbuf.text_slices(pa.array(texts))
    ids, pointers = coder.encode(data, offsets)
    for k, text in enumerate(texts):
        assert ids[pointers[k] : pointers[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\x0babé ", max_size=12), min_size=1, max_size=6))
def test_words_of_rows(texts):
    ((_, data, offsets),) = textbuf.text_slices(pa.array(texts))
    starts, ends, pointers = textbuf.find_words(data, offsets)
    whole = data.tobytes()
    for k, text in enumerate(texts):
        words = [whole[a:b] for a, b in zip(starts[pointers[k] : pointers[k + 1]], ends[pointers[k] : pointers[k + 1]], strict=True)]
        assert words == text.encode().split()


def test_slices_cover_all_rows_and_take_null_as_empty():
    texts = pa.array(["ab", None, "", "c" * 50, "d"])
    seen = [(row, data.tobytes(), offsets.tolist()) for row, data, offsets in textbuf.text_slices(texts, 4)]
    assert [s[0] for s in seen] == [0, 3, 4]
    assert b"".join(s[1] for s in seen) == b"ab" + b"c" * 50 + b"d"


def counted(df):
    return {(r["doc_id"], r["section"]): tuple(r)[2:] for r in df.collect()}


def test_token_counts_by_brute_force(spark, tokenizer):
    texts = ["one two\nthree\n\nfour é日本\n", "", None, "no break", "\n\n\n", "a" * 5000 + "\n" + "b c " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = counted(token_counts.count_tokens(docs))
    want = {}
    for k, text in enumerate(texts):
        if not text:
            continue
        lines = text.splitlines(keepends=True)
        edges = [sum(map(len, lines[:i])) for i in range(len(lines) + 1)]
        counts, crossing = [0] * len(lines), [0] * len(lines)
        coded = tokenizer.encode(text, add_special_tokens=False)
        for (a, b) in coded.offsets:
            held = [max(0, min(b, edges[i + 1]) - max(a, edges[i])) for i in range(len(lines))]
            best = held.index(max(held))
            counts[best] += 1
            crossing[best] += sum(h > 0 for h in held) > 1
        for i in range(len(lines)):
            want[k, i] = (edges[i], edges[i + 1], counts[i], crossing[i])
        assert sum(counts) == len(coded.ids)
    assert got == want


def test_boundary_rule_and_given_spans(spark):
    spans = [[(0, 2), (2, 9)], None, [(0, 3), (5, 500)]]
    rows = [(1, "hello world", [{"start": a, "end": b} for a, b in spans[0]]), (None, "abc", None), (3, "the cat", [{"start": a, "end": b} for a, b in spans[2]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, s array<struct<start:int,end:int>>")
    got = counted(token_counts.count_tokens(docs, spans="s"))
    # "hello" is one token with two characters in the first span and three in the second
    assert got[1, 0][2:] == (0, 0) and got[1, 1][2:] == (2, 1)
    assert got[3, 1][:2] == (5, 7) and (None, 0) not in got


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id string, text string, section int")
    assert token_counts.count_tokens(empty).collect() == []
