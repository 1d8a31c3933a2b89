"""Byte-level BPE by prefix dynamic programming.

The encoding of a byte string ends in some token, and the encodings of its prefixes are consistent
with it: cutting the last token off the encoding of a prefix leaves the encoding of a shorter
prefix. So it is enough to store one token per prefix, the last one of its encoding. A token may be
the last one of a prefix if it is a suffix of the prefix and follows the last token of what is left
as a *stable pair*: two tokens that the merges leave alone when their bytes stand side by side.
Exactly one suffix token qualifies. The table gives exact appends (new prefixes only) and
re-encoding after an edit (old tokens are kept up to the edit, and again as soon as the table
behind it repeats).

Encoding of a text: the split pattern cuts it into pieces, each piece is encoded on its own, and a
piece that is itself in the vocabulary is one token. NULL text is empty; lone rows, repeated rows
and very long pieces need no special care, the work being linear in the bytes of a piece.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.llm.columns import slices

#: What a worker remembers, together about 150 MB.
_KNOWN_CHUNKS = 300_000
_KNOWN_PIECES = 200_000
_LONGEST_KNOWN = 200
_KNOWN_PAIRS = 400_000
IDS = "ids array<int>"


class Vocabulary:
    """Ranks of byte strings, and which pairs of tokens the merges leave alone."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        ends = defaultdict(set)
        for token in ranks:
            ends[token[-3:]].add(len(token))
        #: Lengths of the tokens that end in three given bytes, longest first. Three bytes that
        #: end no token of three or more are absent; the last two of them are looked up instead.
        self.lengths = {
            end: tuple(sorted({1} | found | ends.get(end[-2:], set()), reverse=True))
            for end, found in ends.items() if len(end) > 1}
        self.longest = max(map(len, ranks), default=1)
        self.sizes = list(map(len, self.tokens))
        self._edges: tuple[dict[int, list], dict[int, list]] = ({}, {})
        #: By (left << 32 | right); whole numbers take less memory than pairs.
        self.known: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in pairs})

    def merge(self, data: bytes, least: int = 1) -> list[bytes]:
        """Plain merging, lowest rank first and leftmost of equals, down to ``least`` parts."""
        cuts = list(range(len(data) + 1))
        while len(cuts) - 1 > least:
            best = min(
                (self.ranks.get(data[cuts[i]:cuts[i + 2]], len(self.tokens)), i)
                for i in range(len(cuts) - 2))
            if best[0] == len(self.tokens):
                break
            del cuts[best[1] + 1]
        return [data[a:b] for a, b in itertools.pairwise(cuts)]

    def reachable(self, token: int) -> bool:
        """Whether the merges make ``token`` out of its own bytes."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = len(self.merge(self.tokens[token])) == 1
        return known

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at the left (0) or right (1) edge of ``token`` while it is merged: the
        bytes, and the rank of the merge that ends it."""
        known = self._edges[side].get(token)
        if known is None:
            data = self.tokens[token]
            if len(data) == 1:
                known = [(data, len(self.tokens))]
            else:
                inner = self.merge(data, 2)[-side]
                steps = self._edge(self.ranks[inner], side)
                known = [*steps[:-1], (inner, token), (data, len(self.tokens))]
            self._edges[side][token] = known
        return known

    def stable(self, left: int, right: int) -> bool:
        """Whether the merges keep ``left`` and ``right`` apart and whole.

        They do if, while both are being built, no merge across the border comes before the next
        merge at either edge. Of equal ranks the leftmost merge is made first.
        """
        pair = left << 32 | right
        known = self.known.get(pair)
        if known is not None:
            return known
        if len(self.known) > _KNOWN_PAIRS:
            self.known.clear()
        known = self.reachable(left) and self.reachable(right)
        one, two = self._edge(left, 1), self._edge(right, 0)
        ranks, end = self.ranks, len(self.tokens)
        i = j = 0
        while known:
            (a, up_a), (b, up_b) = one[i], two[j]
            across = ranks.get(a + b, end)
            if across < up_a and across <= up_b and across < end:
                known = False
            elif up_a == end and up_b == end:
                break
            elif up_a <= up_b:
                i += 1
            else:
                j += 1
        self.known[pair] = known
        return known


class PrefixTable:
    """The last token of every prefix of a byte string (one piece of a text)."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self._vocabulary = vocabulary
        self.data = bytearray()
        self.last: list[int] = [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Adds bytes at the end; earlier prefixes stay as they are."""
        self.data += more
        self._fill(len(self.last), len(self.data) + 1)

    def replace(self, begin: int, end: int, new: bytes) -> int:
        """Puts ``new`` in place of bytes [begin, end); returns how many entries were computed.

        Behind the edit a table entry depends on the bytes and entries of at most the longest
        token before it. When that many old entries in a row come out again, the rest is the same.
        """
        old, old_tail = self.last, bytes(self.data[end:])
        shift = begin + len(new) - end
        self.data[end:] = b""
        self.data[begin:] = new + old_tail
        self.last = old[:begin + 1]
        longest = self._vocabulary.longest
        same = computed = 0
        for stop in range(begin + 1, len(self.data) + 1):
            if same >= longest and stop - longest >= begin + len(new):
                self.last += old[stop - shift:]
                break
            self._fill(stop, stop + 1)
            computed += 1
            before = stop - shift
            kept = stop > begin + len(new) and old[before] == self.last[stop]
            same = same + 1 if kept else 0
        return computed

    def tokens(self) -> list[int]:
        """The encoding, read backwards through the table."""
        return read_back(self._vocabulary, self.last)

    def _fill(self, begin: int, end: int) -> None:
        fill(self._vocabulary, bytes(self.data), self.last, begin, end)


def fill(vocabulary: Vocabulary, data: bytes, last: list[int], begin: int, end: int) -> None:
    """Appends to ``last`` the last tokens of the prefixes of ``data`` of length begin to end - 1."""
    rank_of, known, lengths_of = vocabulary.ranks.get, vocabulary.known.get, vocabulary.lengths.get
    for stop in range(begin, end):
        tail = data[stop - 3:stop] if stop > 2 else data[:stop]
        for length in lengths_of(tail) or lengths_of(tail[-2:], _ONE):
            token = rank_of(data[stop - length:stop]) if length <= stop else None
            if token is None:
                continue
            if length == stop:
                fits = vocabulary.reachable(token)
            else:
                fits = known(last[stop - length] << 32 | token)
                if fits is None:
                    fits = vocabulary.stable(last[stop - length], token)
            if fits:
                last.append(token)
                break
        else:
            raise ValueError(f"the vocabulary cannot encode byte {data[stop - 1]}")


def read_back(vocabulary: Vocabulary, last: list[int]) -> list[int]:
    """The encoding that a table of last tokens stands for."""
    sizes, out, stop = vocabulary.sizes, [], len(last) - 1
    while stop:
        token = last[stop]
        out.append(token)
        stop -= sizes[token]
    out.reverse()
    return out


class Encoder:
    """Encodes texts; what stands between single blanks is encoded once and remembered.

    No piece of the split pattern reaches over a single blank between words, and a blank before a word
    belongs to the word, so texts may be cut in front of such blanks. The chunks that a batch of texts
    brings anew are put in order, and each takes over the table of the prefix it shares with the one
    before it.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self._split = regex.compile(pattern).findall
        #: Ids of a blank and the chunk behind it; ids of pieces.
        self._known: dict[str, bytes] = {}
        self._known_pieces: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers."""
        chunks = [text.split(" ") for text in texts]
        new = set(itertools.chain.from_iterable(chunks)).difference(self._known)
        ragged = {chunk for chunk in new if _ragged(chunk)}
        if ragged:
            for i, found in enumerate(chunks):
                if not ragged.isdisjoint(found):
                    first, *rest = _EVEN.split(texts[i])
                    chunks[i] = [first, *(chunk[1:] for chunk in rest)]
            new = set(itertools.chain.from_iterable(chunks)).difference(self._known)
        _make_room(self._known, _KNOWN_CHUNKS, chunks)
        firsts = {found[0] for found in chunks}
        split = {chunk: self._split(" " + chunk) for chunk in new}
        split_first = {chunk: self._split(chunk) for chunk in firsts}
        self._learn(itertools.chain(split.values(), split_first.values()))
        piece = self._known_pieces.__getitem__
        learnt = {chunk: b"".join(map(piece, pieces)) for chunk, pieces in split.items()}
        # A chunk that ends in white space is whole only at the end of its own text.
        self._known.update((chunk, ids) for chunk, ids in learnt.items()
                           if len(chunk) <= _LONGEST_KNOWN and not _ragged(chunk))
        known, beginning = self._known, {
            chunk: b"".join(map(piece, pieces)) for chunk, pieces in split_first.items()}
        out = []
        for first, *rest in chunks:
            try:
                body = b"".join(map(known.__getitem__, rest))
            except KeyError:
                body = b"".join(known[c] if c in known else learnt[c] for c in rest)
            out.append(beginning[first] + body)
        # A piece of a text without blanks can be as long as the text: used, not remembered.
        for pieces in itertools.chain(split.values(), split_first.values()):
            for long in pieces:
                if len(long) > _LONGEST_KNOWN:
                    self._known_pieces.pop(long, None)
        return out

    def _learn(self, split: Iterable[list[str]]) -> None:
        """Encode the pieces that are not known."""
        split = list(split)
        new = set(itertools.chain.from_iterable(split)).difference(self._known_pieces)
        _make_room(self._known_pieces, _KNOWN_PIECES, split)
        ranks, before, last = self.vocabulary.ranks, b"", [-1]
        for piece in sorted(new):
            data = piece.encode("utf-8")
            whole = ranks.get(data)
            if whole is None:
                shared, most = 0, min(len(data), len(before))
                while shared < most and data[shared] == before[shared]:
                    shared += 1
                del last[shared + 1:]
                fill(self.vocabulary, data, last, shared + 1, len(data) + 1)
                before = data
                ids = array("i", read_back(self.vocabulary, last)).tobytes()
            else:
                ids = array("i", (whole,)).tobytes()
            self._known_pieces[piece] = ids


def _make_room(known: dict, most: int, used: list[list[str]]) -> None:
    """Frequent keys are met early, so the newer half goes, but for what is used now."""
    if len(known) >= most:
        now = set(itertools.chain.from_iterable(used))
        for old in list(itertools.islice(reversed(known), len(known) // 2)):
            if old not in now:
                del known[old]


#: A single blank that stands between two characters that are not white space.
_EVEN = re.compile(r"(?<=\S)(?= \S)")
_ONE = (1,)


def _ragged(chunk: str) -> bool:
    """Empty, or white space at an end: the blank beside it may be part of a longer run."""
    return not chunk or chunk[0].isspace() or chunk[-1].isspace()


@functools.lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(Vocabulary.load(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """``id_column`` and ``ids`` of every row; ``text`` NULL gives no ids."""
    kind = dict(docs.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(path, pattern).encode_all
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                found = to_ids([text or "" for text in part.column(1).to_pylist()])
                offsets = np.cumsum([0, *(len(ids) // 4 for ids in found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(np.frombuffer(b"".join(found), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_column, "ids"])

    return docs.select(id_column, F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"`{id_column}` {kind}, {IDS}")


def decode(encoded: DataFrame, path: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """``id_column``, ``ids`` and the bytes they stand for, ``decoded``; NULL ids give none."""
    kind = dict(encoded.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = encoder(path, pattern).vocabulary.tokens.__getitem__
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                ids = part.column(1)
                values = ids.flatten().to_numpy().tolist()
                ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy()).tolist()
                decoded = [
                    b"".join(map(token, values[a:b])) for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), ids, pa.array(decoded, pa.binary())],
                    names=[id_column, "ids", "decoded"])

    return encoded.select(id_column, "ids").mapInArrow(
        run, f"`{id_column}` {kind}, {IDS}, decoded binary")


def encode_checked(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """``id_column``, ``n_tokens``, ``ids`` and ``decoded_sha256``: every text is decoded again, and
    one whose bytes do not come back is an error. NULL text counts as empty."""
    kind = dict(docs.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, pattern)
        token = tool.vocabulary.tokens.__getitem__
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                texts = [text or "" for text in part.column(1).to_pylist()]
                found, digests = tool.encode_all(texts), []
                for text, ids in zip(texts, found):
                    decoded = b"".join(map(token, np.frombuffer(ids, dtype=np.int32).tolist()))
                    if decoded != text.encode("utf-8"):
                        raise ValueError("ids do not decode to the bytes of their text")
                    digests.append(hashlib.sha256(decoded).hexdigest())
                sizes = np.array([len(ids) // 4 for ids in found], dtype=np.int64)
                ids = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *sizes]).astype(np.int32)),
                    pa.array(np.frombuffer(b"".join(found), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes), ids, pa.array(digests, pa.string())],
                    names=[id_column, "n_tokens", "ids", "decoded_sha256"])

    return docs.select(id_column, F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"`{id_column}` {kind}, n_tokens bigint, {IDS}, decoded_sha256 string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return decode(encode(docs, path, pattern), path, pattern).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
