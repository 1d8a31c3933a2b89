"""Token ids in seekable Zstandard files: independent frames, a seek table, per-frame checksums.

A file is a run of Zstandard frames, each compressed on its own and holding at most
``frame_tokens`` little-endian unsigned 32-bit ids. Its last frame is skippable and holds the seek
table: per frame the compressed size, the decompressed size and the low half of XXH64 of the
content. A reader takes the table from the end of the file and then reads, checks and decompresses
only the frames that hold a wanted document. The index, one row per document, is a Parquet table.

Documents are ordered by id, NULL first; rows with one id by the hash of their text, which decides
nothing for equal rows. NULL text is empty and still has its end id. An empty table gives an empty
index. Other columns of the input are not carried.
"""

from __future__ import annotations

import functools
import itertools
import os
import struct
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibrant.llm import files
from calibrant.llm.columns import slices
from calibrant.llm.tables import shuffle_width, written
from calibrant.session import run_folder

# Fixed values of the seekable format.
TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A5E, 0x8F92EAB1
HAS_CHECKSUMS = 0x80

INDEX = "doc_id bigint, path string, part int, at bigint, n_tokens bigint"
TOKENS = "doc_id bigint, part int, at bigint, n_tokens bigint, ids binary"
#: Bytes of remembered words and their ids, with the objects around them; longer words are not kept.
_KNOWN_BYTES = 160 << 20
_LONGEST_KNOWN = 200
#: New words of letters that are encoded as one text.
_RUN = 2000
_MARKS = b".,;:!?"


class WordTokenizer:
    """Ids of whole texts, by way of their blank-separated words, as a tokenizer file gives them.

    For tokenizers that normalise character by character, drop blanks and never join what blanks
    separate. A word is encoded by the library once and remembered.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        vocabulary = self._library.get_vocab()
        suffix = getattr(self._library.model, "end_of_word_suffix", None)
        self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, number in vocabulary.items():
            self._ends[number] = bool(suffix) and token.endswith(suffix)
        self._known: dict[bytes, bytes] = {}
        self._size = 0

    @property
    def remembered_bytes(self) -> int:
        return sum(map(_cost, self._known.items()))

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [text.split() for text in texts]
        new = set(itertools.chain.from_iterable(split)).difference(self._known)
        if self._size > _KNOWN_BYTES:
            # Frequent words were met early, so the newer half goes.
            used = set(itertools.chain.from_iterable(split))
            for old in list(itertools.islice(reversed(self._known), len(self._known) // 2)):
                if old not in used:
                    del self._known[old]
            self._size = self.remembered_bytes
        added = self._learn(new)
        known = self._known.__getitem__
        out = [b"".join(map(known, words)) for words in split]
        for word in added:
            if len(word) > _LONGEST_KNOWN:
                del self._known[word]
            else:
                self._size += _cost((word, self._known[word]))
        return out

    def _learn(self, new: set[bytes]) -> list[bytes]:
        """Encode words; what ends a word after its last letter or digit is a token run of its own,
        so a word with marks behind it is put together from both."""
        known, apart = self._known, []
        single = set()
        for word in new:
            core = word.rstrip(_MARKS)
            if core != word and core and (core[-1:].isalnum() or _ends_in_letter(core)):
                marks = word[len(core):]
                apart.append((word, core, marks))
                single.update((core, marks))
            else:
                single.add(word)
        todo = [word for word in single if word not in known]
        letters, others = [], []
        for word in todo:
            text = word.decode("utf-8")
            (letters if len(word) <= _LONGEST_KNOWN and text.isalpha() else others).append((word, text))
        for begin in range(0, len(letters), _RUN):
            if not self._run(letters[begin:begin + _RUN]):
                others += letters[begin:begin + _RUN]
        found = self._library.encode_batch_fast([text for _, text in others], add_special_tokens=False)
        for (word, _), encoding in zip(others, found):
            known[word] = array("I", encoding.ids).tobytes()
        for word, core, marks in apart:
            known[word] = known[core] + known[marks]
        return [*todo, *(word for word, _, _ in apart)]

    def _run(self, words: list[tuple[bytes, str]]) -> bool:
        """Words of letters encoded as one text and cut where a token ends a word.

        Every word has a token that ends it; if there are more, as where normalising turns a letter
        into one with a mark, nothing is learnt.
        """
        encoding = self._library.encode_batch_fast(
            [" ".join([text for _, text in words])], add_special_tokens=False)[0]
        ids = np.array(encoding.ids, dtype=np.uint32)
        cuts = np.flatnonzero(self._ends[ids])
        if len(cuts) != len(words) or cuts[-1] != len(ids) - 1:
            return False
        data, begin = ids.tobytes(), 0
        for (word, _), end in zip(words, ((cuts + 1) * 4).tolist()):
            self._known[word] = data[begin:end]
            begin = end
        return True


def _cost(item: tuple[bytes, bytes]) -> int:
    return 170 + len(item[0]) + len(item[1])


def _ends_in_letter(word: bytes) -> bool:
    # Normalising may turn a letter into one with a mark behind it, which is no letter.
    return unicodedata.normalize("NFC", word.decode("utf-8")[-1]).lower().isalpha()


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class Writer:
    """Appends ids to one file; ``close`` writes the seek table."""

    def __init__(self, sink, frame_tokens: int, level: int = 3):
        self._sink, self._most = sink, 4 * frame_tokens
        self._zstd = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self._open = bytearray()
        self._table: list[tuple[int, int, int]] = []
        self.tokens = 0

    def append(self, ids: bytes) -> int:
        """The place of the first id in the file."""
        at = self.tokens
        self._open += ids
        self.tokens += len(ids) // 4
        while len(self._open) >= self._most:
            self._flush(self._most)
        return at

    def _flush(self, size: int) -> None:
        content = bytes(self._open[:size])
        del self._open[:size]
        frame = self._zstd.compress(content)
        self._sink.write(frame)
        self._table.append((len(frame), size, xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def close(self) -> None:
        if self._open:
            self._flush(len(self._open))
        body = b"".join(struct.pack("<III", *entry) for entry in self._table)
        body += struct.pack("<IBI", len(self._table), HAS_CHECKSUMS, FOOTER_MAGIC)
        self._sink.write(struct.pack("<II", TABLE_MAGIC, len(body)) + body)
        self._sink.close()


class Reader:
    """Ranges of ids of one file; only the frames of a range are read."""

    def __init__(self, source):
        self._source = source
        size = source.size()
        source.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != FOOTER_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        length = 12 * count
        source.seek(size - 9 - length - 8)
        head, body = source.read(8), source.read(length)
        if struct.unpack("<II", head) != (TABLE_MAGIC, length + 9):
            raise ValueError("damaged seek table")
        table = np.frombuffer(body, dtype="<u4").reshape(count, 3)
        self._sums = table[:, 2]
        self._places = np.concatenate([[0], np.cumsum(table[:, 0].astype(np.int64))])
        self._ends = np.concatenate([[0], np.cumsum(table[:, 1].astype(np.int64))])
        self._zstd = zstandard.ZstdDecompressor()
        self._held = (-1, b"")
        self.frames_read = 0

    def _frame(self, number: int) -> bytes:
        if self._held[0] != number:
            self._source.seek(int(self._places[number]))
            packed = self._source.read(int(self._places[number + 1] - self._places[number]))
            size = int(self._ends[number + 1] - self._ends[number])
            content = self._zstd.decompress(packed, max_output_size=size)
            if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self._sums[number]:
                raise ValueError(f"frame {number} does not match its checksum")
            self._held = (number, content)
            self.frames_read += 1
        return self._held[1]

    def read(self, at: int, n_tokens: int) -> bytes:
        begin, end = 4 * at, 4 * (at + n_tokens)
        number = int(np.searchsorted(self._ends, begin, side="right")) - 1
        parts = []
        while begin < end:
            start, stop = int(self._ends[number]), int(self._ends[number + 1])
            parts.append(self._frame(number)[begin - start:min(end, stop) - start])
            begin, number = stop, number + 1
        return b"".join(parts)


def write_tokens(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, frame_tokens: int = 65_536,
    folder: str | None = None,
) -> DataFrame:
    """Encode ``text`` and write the ids in order of ``doc_id``; returns the index.

    Files follow each other by ``part``. Raw text is what is shuffled, so encoding runs once.
    """
    spark = docs.sparkSession
    folder = folder or run_folder(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = tokenizer(tokenizer_path).encode_all
        end = struct.pack("<I", end_id)
        writer = path = None
        part = TaskContext.get().partitionId()
        for batch in batches:
            if writer is None and batch.num_rows:
                path = files.new_file(folder, part, ".zst")
                writer = Writer(files.open_output(path), frame_tokens)
            for rows in slices(batch, "text"):
                places, sizes = [], []
                texts = [text or b"" for text in rows.column(1).to_pylist()]
                for ids in encode_all(texts):
                    places.append(writer.append(ids + end))
                    sizes.append(len(ids) // 4 + 1)
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([path] * n, pa.string()),
                     pa.array([part] * n, pa.int32()), pa.array(places, pa.int64()),
                     pa.array(sizes, pa.int64())],
                    names=["doc_id", "path", "part", "at", "n_tokens"])
        if writer is not None:
            writer.close()

    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                    F.col("text").cast("binary").alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(shuffle_width(spark), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text"))
    return written(ordered.mapInArrow(write, INDEX), "token-index")


def read_tokens(index: DataFrame) -> DataFrame:
    """The ids of the documents of ``index``, all or a chosen few, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = held = None
        for batch in batches:
            done, found = 0, []
            for path, at, n in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4))):
                if path != held:
                    held, reader = path, Reader(files.open_input(path))
                found.append(reader.read(at, n))
                if len(found) == 512:  # a bounded batch, however long the documents
                    yield _tokens(batch, done, found)
                    done, found = done + len(found), []
            yield _tokens(batch, done, found)

    return (
        index.repartition(shuffle_width(index.sparkSession), "path")
        .sortWithinPartitions("path", "at").mapInArrow(read, TOKENS))


def _tokens(batch: pa.RecordBatch, begin: int, ids: list[bytes]) -> pa.RecordBatch:
    rows = batch.slice(begin, len(ids))
    return pa.RecordBatch.from_arrays(
        [rows.column(0), rows.column(2), rows.column(3), rows.column(4), pa.array(ids, pa.binary())],
        names=["doc_id", "part", "at", "n_tokens", "ids"])


def starts(index: DataFrame) -> DataFrame:
    """Per file (``part``) the number of ids in all files before it; one row per file."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        "part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"))


def token_table(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write, read back, and describe: doc_id, start, n_tokens, ids_crc32."""
    index = write_tokens(docs, tokenizer_path)
    return read_tokens(index).join(F.broadcast(starts(index)), "part").select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"),
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))
