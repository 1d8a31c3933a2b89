import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import cases
from calibrant.llm import token_files
from calibrant.llm.catalog import QUERIES
from calibrant.llm.token_files import Reader, Writer

PATH = public_tokenizers.path("word_bpe_49k.json")


class Source(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


class Sink(io.BytesIO):
    def close(self):
        self.kept = self.getvalue()
        super().close()


def filed(documents, frame_tokens):
    sink = Sink()
    writer = Writer(sink, frame_tokens)
    places = [writer.append(np.asarray(d, "<u4").tobytes()) for d in documents]
    writer.close()
    return sink.kept, places


def test_only_the_frames_of_a_document_are_read():
    documents = [list(range(n, n + n % 90)) for n in range(300)]
    content, places = filed(documents, 64)
    for i, (at, ids) in enumerate(zip(places, documents)):
        reader = Reader(Source(content))
        assert np.frombuffer(reader.read(at, len(ids)), "<u4").tolist() == ids
        assert reader.frames_read <= 3


def test_a_damaged_frame_is_refused():
    content, _ = filed([list(range(1000))], 100)
    damaged = bytearray(content)
    damaged[20] ^= 255
    with pytest.raises(Exception):
        Reader(Source(bytes(damaged))).read(0, 1000)
    with pytest.raises(ValueError, match="seek table"):
        Reader(Source(content[:-1] + b"x"))


def test_an_empty_file_has_a_seek_table():
    content, _ = filed([[]], 100)
    assert Reader(Source(content)).read(0, 0) == b""


def test_frames_are_plain_zstandard():
    import zstandard

    content, _ = filed([list(range(5000))], 512)
    whole = zstandard.ZstdDecompressor().stream_reader(
        io.BytesIO(content), read_across_frames=True).read()
    assert np.array_equal(np.frombuffer(whole, "<u4"), np.arange(5000))


def expected(rows):
    library = Tokenizer.from_file(PATH)
    out, start = [], 0
    ordered = sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0))
    for doc_id, text in ordered:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(row.doc_id, row.text) for row in docs.collect()]
    got = QUERIES["op4_token_files"](spark, sf_dir)
    assert cases.table(got) == sorted(expected(rows), key=repr)


def test_words_as_the_library():
    library, words = Tokenizer.from_file(PATH), token_files.tokenizer(PATH)
    rng = np.random.default_rng(3)
    parts = ["the", "It's", "'s", " ", "\n", " ", "é", "é", "́", "…", "!?", ".", ";",
             "<|endoftext|>", "<|ENDOFTEXT|>", "日本", "1", "Σ", "İ", "\x1c", "\x85", "क़", "😀"]
    texts = ["".join(rng.choice(parts, rng.integers(10))) for _ in range(3000)]
    for text, ids in zip(texts, words.encode_all([text.encode() for text in texts])):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text


@pytest.mark.parametrize("clashing", [False, True])
def test_odd_rows(spark, clashing):
    got = cases.table(token_files.token_table(cases.docs(spark, clashing=clashing), PATH))
    want = expected([row[:2] for row in cases.ROWS])
    # The two rows without id may stand in either order; so their starts are left out.
    assert sorted(row[0::2] + row[3:] for row in got if row[0] is None) == sorted(
        row[0::2] + row[3:] for row in want if row[0] is None)
    assert [r for r in got if r[0] is not None] == sorted(
        (r for r in want if r[0] is not None), key=repr)
    spans = sorted(row[1:3] for row in got)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))


def test_chosen_documents(spark):
    index = token_files.write_tokens(cases.docs(spark), PATH, frame_tokens=16)
    some = token_files.read_tokens(index.filter(F.col("doc_id").isin(6, 10))).collect()
    want = {row[0]: row for row in expected([row[:2] for row in cases.ROWS])}
    assert {row.doc_id: zlib.crc32(row.ids) for row in some} == {i: want[i][3] for i in (6, 10)}


def test_empty_table(spark):
    assert token_files.token_table(cases.docs(spark, []), PATH).collect() == []


def test_words_are_remembered_within_bytes(monkeypatch):
    """Texts without blanks are one word each; none of them stays, and results are the library's."""
    monkeypatch.setattr(token_files, "_KNOWN_BYTES", 1 << 20)
    tool, library = token_files.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    for i in range(12):
        texts = [f"日本語テキスト{j}です" * 300 for j in range(i * 5, i * 5 + 5)]
        texts.append(" ".join(f"wörd{chr(97 + j % 26)}{'xyz'[j % 3] * (j % 11)}q, Ünï{i}é İ{j % 7} a.b" for j in range(900)))
        for text, ids in zip(texts, tool.encode_all([text.encode() for text in texts])):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert tool.remembered_bytes <= 3 << 20 and max(map(len, tool._known)) <= 200


def test_letters_that_normalising_splits():
    tool, library = token_files.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    words = "İstanbul ﬁn ǅ ß STRASSE ά ϓ k̀ ａｂｃ 𝒳𝒴 ŉ ꟸ ᵃ".split()
    for group in (words, words[::-1], *[[word] for word in words]):
        text = " ".join(group)
        got = tool.encode_all([text.encode()])[0]
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
