"""Token alignment against whole texts encoded by the libraries and all pairs of every group."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import cases
from calibrant.llm import token_alignment as ta

A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

EXTRA = [
    "a", " ", "  ", " a", "a ", "a  b", "\n", "a\n\nb", "\t x", "é", "é", "日本語 テキスト 😀😀", "x" * 3000,
    "日本" * 2000, "<s> </s> <unk> <0x41> <|endoftext|>", "a▁b", "▁", "nbsp here", "　wide　 blanks",
    "a\x00b \x1c x\x85 y", "﻿bom", "don't we'll I'VE", "1 234 5,678.90 !!! ??", "👩‍👩‍👧 flags 🇩🇪", "tie tie tie",
    "​ zero ‍ width", "ﬁ ligature ﬀ", "İstanbul", "𝒳𝒴 𐍈", "trailing\n", "\r\nmixed \r\n lines\n",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    letters = ta.byte_alphabet()
    bytes_a = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab().items() if letters.keys() >= set(t)}
    return a, sentencepiece.SentencePieceProcessor(model_file=B), bytes_a


def groups_of(text, libraries):
    """Groups of one whole text; None where the bytes differ."""
    if not text:
        return None
    a, b, decoded = libraries
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [decoded[i] for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
               else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    raw = b" " + text.encode()
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return None
    out, i, j, end_a, end_b, left, right = [], 0, 0, 0, 0, [], []
    while i < len(ids_a) or j < len(ids_b):
        if end_a <= end_b and i < len(ids_a):
            left.append(ids_a[i])
            end_a += len(bytes_a[i])
            i += 1
        else:
            right.append(ids_b[j])
            end_b += len(bytes_b[j])
            j += 1
        if end_a == end_b:
            out.append((left, right))
            left, right = [], []
    return out


def expected(rows, libraries):
    split = [(doc_id, groups_of(text, libraries)) for doc_id, text in rows]
    held = Counter()
    for _, groups in split:
        held.update({(x, y) for left, right in groups or [] for x in left for y in right})
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, groups in split:
        if groups is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for left, right in groups for x in left for y in right]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((
            doc_id, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links),
            sum(held[x, y] == best[x] for x, y in links), sum(held[link] for link in links),
            hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return cases.table(df.select(*NAMES))


@pytest.mark.parametrize("most_links", [4_000_000, 500])
def test_odd_texts(spark, libraries, most_links):
    rows = cases.ROWS + [(100 + i, text, None, None, None) for i, text in enumerate(EXTRA)]
    got = rows_of(ta.link_table(cases.docs(spark, rows, clashing=True), A, B, most_links))
    assert got == expected([row[:2] for row in rows], libraries)


def test_documents(spark, libraries, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(row.doc_id, row.text) for row in docs.select("doc_id", "text").collect()]
    assert rows_of(ta.link_table(docs, A, B)) == expected(rows, libraries)


def test_empty_table(spark):
    assert ta.link_table(cases.docs(spark, []), A, B).collect() == []


def test_made_up_texts(libraries):
    draw = random.Random(5)
    letters = "ab  \n\tééßЖ日😀.,'!?09▁ 　́\x1c​<s>"
    tool = ta.Aligner(A, B)
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 60))) for _ in range(4000)]
    got = ta.align_texts(texts, tool)
    for i, text in enumerate(texts):
        groups = groups_of(text, libraries)
        line = None if groups is None else ";".join(
            ",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        assert got["groups_sha256"][i] == ("" if line is None else hashlib.sha256(line.encode()).hexdigest()), repr(text)


def test_memory_is_bounded_in_bytes():
    tool = ta.Aligner(A, B, most_bytes=2 << 20)
    for i in range(12):
        tool.align({f"word{i}x{j}" for j in range(1000)} | {"日本語" * 3000 + str(i)})
        assert tool.remembered_bytes() <= 3 << 20
    assert all(len(word) <= 256 for word in tool._young)


def test_long_group_costs_its_distinct_ids():
    a, b = np.tile(np.arange(50), 400), np.tile(np.arange(60), 300)
    group, link, often = ta._links(a, np.zeros(20_000, int), np.array([20_000]), b, np.zeros(18_000, int),
                                   np.array([18_000]), 1000)
    assert often.sum() == 20_000 * 18_000 and len(link) == 3000 and set(group) == {0}


def test_small_and_large_groups_agree(monkeypatch):
    draw = np.random.default_rng(3)
    a, b = draw.integers(0, 5, 90), draw.integers(0, 4, 70)
    group_a, group_b = np.sort(draw.integers(0, 9, 90)), np.sort(draw.integers(0, 9, 70))
    sizes = np.bincount(group_a, minlength=9), np.bincount(group_b, minlength=9)
    held = []
    for limit in (1 << 16, 0):
        monkeypatch.setattr(ta, "_LARGE_GROUP", limit)
        found = Counter()
        for g, link, n in zip(*ta._links(a, group_a, sizes[0], b, group_b, sizes[1], 100)):
            found[g, link] += n
        held.append(found)
    assert held[0] == held[1] and sum(held[0].values()) == (sizes[0] * sizes[1]).sum()


def test_segments_cover_every_id(spark):
    counts = spark.range(1000).select((F.col("id") % 37).alias("a"), F.col("id").alias("link"))
    cuts = ta.segments(counts, 60)
    assert cuts[0][0] == 0 and all(x[1] == y[0] for x, y in zip(cuts, cuts[1:])) and len(cuts) == 19
