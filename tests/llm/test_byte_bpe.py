import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import cases
from calibrant.llm import byte_bpe
from calibrant.llm.byte_bpe import PrefixTable, Vocabulary
from calibrant.llm.catalog import QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.encoder(PATH, PATTERN)


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), dtype=np.int32).tolist()


rng = random.Random(8)
PARTS = ["a", "b", " ", "  ", "\n", "'s", "'ll", "é", "日本", "1", "23", "!", "\t", " ", " ",
         " the", "ing", "\x1c", "\x85", "😀", "́", "==", "\r\n", "<|endoftext|>"]


def test_texts_as_the_library(encoder, library):
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(4000)]
    texts += [row[1] or "" for row in cases.ROWS] + ["ab" * 4000, " " * 999, "é" * 999]
    for text in texts:
        assert ids(encoder, text) == library.encode_ordinary(text), text


TINY = {bytes([c]): c - 97 for c in b"abcd"} | {
    token: 4 + i for i, token in enumerate(
        [b"ab", b"bc", b"aa", b"abc", b"cd", b"aab", b"bcd", b"aaaa", b"abcd", b"da"])}


def plain(ranks, data):
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1e9))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[part] for part in parts]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcd", max_size=30), st.text(alphabet="abcd", max_size=8),
       st.integers(0, 30), st.integers(0, 6))
def test_tables_under_edits(text, new, at, cut):
    vocabulary, data, new = Vocabulary(TINY), text.encode(), new.encode()
    table = PrefixTable(vocabulary, data[:len(data) // 2])
    table.append(data[len(data) // 2:])
    assert table.tokens() == plain(TINY, data)
    begin = min(at, len(data))
    end = min(begin + cut, len(data))
    table.replace(begin, end, new)
    assert table.tokens() == plain(TINY, data[:begin] + new + data[end:])
    assert table.last == PrefixTable(vocabulary, data[:begin] + new + data[end:]).last


def test_an_edit_recomputes_its_neighbourhood(encoder):
    data = b"the quick brown fox jumps over the lazy dog " * 200
    table = PrefixTable(encoder.vocabulary, data)
    assert table.replace(4000, 4001, b"z") < 200


def test_long_pieces_take_linear_work(encoder, library):
    text = "ab" * 100_000
    assert len(ids(encoder, text)) == len(library.encode_ordinary(text))


def check(rows, texts, library):
    want = sorted(
        ((doc_id, len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest(),
          hashlib.sha256((text or "").encode()).hexdigest())
         for doc_id, text in texts for found in [library.encode_ordinary(text or "")]), key=repr)
    assert rows == want


def test_query(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [(row.doc_id, row.text) for row in docs.collect()]
    check(cases.table(QUERIES["op1_byte_bpe"](spark, sf_dir)), texts, library)


@pytest.mark.parametrize("clashing", [False, True])
def test_odd_rows(spark, library, clashing):
    got = byte_bpe.round_trip(cases.docs(spark, clashing=clashing), PATH, PATTERN)
    check(cases.table(got), [row[:2] for row in cases.ROWS], library)


def test_empty_table(spark):
    assert byte_bpe.round_trip(cases.docs(spark, []), PATH, PATTERN).collect() == []


def test_long_pieces_are_not_remembered(encoder, library):
    text = "日本語" * 3000 + " " + "x" * 900
    assert ids(encoder, text) == library.encode_ordinary(text)
    assert max(map(len, encoder._known_pieces)) <= byte_bpe._LONGEST_KNOWN
