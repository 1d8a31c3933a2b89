"""Links between the tokens of two tokenizers by their spans, and how often a corpus holds each link.

Tokenizer A is a byte-level BPE of the tokenizers library, B a sentencepiece model that puts a space
in front of a text. Both cover the bytes of a space and the text. Where tokens of both end, the bytes
are cut into groups; every A token of a group is linked with every B token of it.

Ends of tokens come from the libraries: character offsets of A, spans of B's proto result. They are
coarse cuts, because a character of several bytes may belong to several tokens of A and a byte-fallback
token of B has no characters of its own; such tokens end where their decoded bytes do. The decoded
bytes of both are compared with the text; where either differs (a model that changes the text, or a
text that holds the mark B writes for a space) the document has no tokens.

A text is aligned word by word. No token of A or B reaches from a character other than white space
over a single space into the next word (pieces of B are checked for that when the model is read; if
one did, texts would be aligned whole), so the tokens and groups of a text are those of its words,
one after the other. A worker remembers words up to ``most_bytes``, the older half goes first.

Per document the distinct links are written once, with how often they occur. Their document counts
are one aggregation. Counts meet the documents again in segments of at most ``most_links`` links, one
after the other, so what is broadcast is bounded however many links a corpus has; per document the
sums over the segments add up.

Defined results: NULL and empty texts have zeros and an empty digest. Repeated rows are documents of
their own, NULL ids are kept, other columns are not read, an empty table gives an empty result. A
group of any size costs its distinct ids, not its pairs of tokens.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibrant.llm.columns import slices
from calibrant.llm.tables import written

SPACE_MARK = "▁"  # fixed: how sentencepiece writes a space
ALIGNED = ("row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
           "groups_sha256 string, links array<bigint>, times array<bigint>")
SCORED = "row bigint, n_best bigint, count_sum bigint"
#: Longer words are aligned anew each time.
_LONGEST_KNOWN = 256
_SLICE = 2 << 20
#: New words that are encoded as one text.
_RUN = 4096
#: Pairs of a group from which on its distinct ids are paired instead of its tokens.
_LARGE_GROUP = 1 << 16
#: 32-bit numbers before the links of an aligned word: tokens of A, of B, groups, distinct links, and
#: the links in two halves.
HEADER = 6
_AT = 4 * HEADER
_NOTHING = bytes(_AT)


def byte_alphabet() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable bytes are themselves,
    the others follow from U+0100 on in ascending order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(256) if byte not in set(printable)]
    return {chr(byte): byte for byte in printable} | {chr(256 + i): byte for i, byte in enumerate(hidden)}


@dataclass
class Tokens:
    """The tokens of one run of bytes: ids and the byte behind each, for A and for B."""

    a: np.ndarray
    ends_a: np.ndarray
    b: np.ndarray
    ends_b: np.ndarray


class Aligner:
    """Both tokenizers of one worker and the words it remembers.

    An aligned word is one string of bytes: HEADER, its distinct links, how often each occurs, and
    its groups as text. None stands for a word whose decoded bytes are other ones.
    """

    def __init__(self, path_a: str, path_b: str, most_bytes: int = 160 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(path_a)
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        vocabulary = self._a.get_vocab()
        self._bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            if all(c in alphabet for c in token):
                self._bytes_a[number] = bytes(alphabet[c] for c in token)
        self.width = self._b.get_piece_size()
        pieces = [self._b.id_to_piece(i) for i in range(self.width)]
        self._fallback = np.array([self._b.is_byte(i) for i in range(self.width)])
        self._bytes_b = [
            bytes([int(piece[3:5], 16)]) if byte else piece.replace(SPACE_MARK, " ").encode()
            for piece, byte in zip(pieces, self._fallback.tolist())]
        self._sizes_a = np.array([len(token) for token in self._bytes_a])
        self._sizes_b = np.array([len(token) for token in self._bytes_b])
        self._names = [str(i) for i in range(max(len(self._bytes_a), self.width))]
        self.by_word = not any(SPACE_MARK in piece.lstrip(SPACE_MARK) for piece in pieces)
        self._most = most_bytes // 2
        self._young: dict[str, bytes | None] = {}
        self._old: dict[str, bytes | None] = {}
        self._size = 0

    def remembered_bytes(self) -> int:
        return sum(_cost(word, found) for held in (self._young, self._old) for word, found in held.items())

    def split(self, texts: list[str | None]) -> list[list[str]]:
        """Per text the words that, with a space before each, make up a space and the text."""
        if not self.by_word:
            return [[text] if text else [] for text in texts]
        out = [text.split(" ") if text else [] for text in texts]
        odd = {word for word in set().union(*out) if _open(word)}
        return [words if odd.isdisjoint(words) else _joined(words) for words in out]

    def align(self, words: set[str]) -> dict[str, bytes | None]:
        found, together, alone = {}, [], []
        for word in words:
            if word in self._young:
                found[word] = self._young[word]
            elif word in self._old:
                found[word] = self._old.pop(word)
                self._remember(word, found[word])
            elif self.by_word and len(word) <= _LONGEST_KNOWN and not _open(word):
                together.append(word)
            else:
                alone.append(word)
        runs = [together[i:i + _RUN] for i in range(0, len(together), _RUN)] + [[word] for word in alone]
        for run in runs:
            for word, value in zip(run, self._run(run)):
                found[word] = value
                self._remember(word, value)
        return found

    def _remember(self, word: str, value: bytes | None) -> None:
        if len(word) > _LONGEST_KNOWN:
            return
        self._young[word] = value
        self._size += _cost(word, value)
        if self._size > self._most:
            self._old, self._young, self._size = self._young, {}, 0

    def _run(self, words: list[str]) -> list[bytes | None]:
        """Words aligned in one text, in which a space stands before each."""
        tokens = self._tokens(" ".join(words))
        if tokens is None:
            return [None] if len(words) == 1 else [value for word in words for value in self._run([word])]
        sizes = np.array([1 + len(word.encode()) for word in words])
        return self._packed(tokens, np.cumsum(sizes))

    def _tokens(self, text: str) -> Tokens | None:
        raw = b" " + text.encode()
        encoding = self._a.encode(" " + text, add_special_tokens=False)
        proto = self._b.encode(text, return_type="proto")
        a = encoding.ids
        b, spans = [], []
        for piece in proto.pieces:
            b.append(piece.id)
            spans.append(piece.end)
        if b"".join([self._bytes_a[i] for i in a]) != raw or b"".join([self._bytes_b[i] for i in b]) != raw:
            return None
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        cuts = np.array([end for _, end in encoding.offsets], dtype=np.int64)
        if len(raw) != len(text) + 1:
            points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            cuts = np.concatenate([[0, 1], 1 + np.cumsum(width)])[cuts]
        spans = np.array(spans, dtype=np.int64) + 1
        spans[self._fallback[b]] = -1
        return Tokens(a, _ends(cuts, self._sizes_a[a]), b, _ends(spans, self._sizes_b[b]))

    def _packed(self, tokens: Tokens, word_ends: np.ndarray) -> list[bytes]:
        """HEADER, links, times and text of every word of a run."""
        cuts = np.intersect1d(tokens.ends_a, tokens.ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, tokens.ends_a), np.searchsorted(cuts, tokens.ends_b)
        word = np.searchsorted(word_ends, cuts)
        n, n_groups = len(word_ends), len(cuts)
        size_a, size_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        group, link, often = _links(tokens.a, group_a, size_a, tokens.b, group_b, size_b, self.width)
        of = word[group]
        order = np.lexsort((link, of))
        of, link, often = of[order], link[order], often[order]
        first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (link[1:] != link[:-1])]))
        link, of = link[first], of[first]
        often = np.add.reduceat(often, first).astype(np.int32)
        bounds = np.searchsorted(of, np.arange(n + 1)).tolist()

        # A token's text and what follows it: the groups in order, in each A before B.
        names = self._names
        ids = np.concatenate([tokens.a, tokens.b])
        side = np.concatenate([2 * group_a, 2 * group_b + 1])
        order = np.argsort(side, kind="stable")
        side, ids = side[order], ids[order]
        step = np.diff(side, append=side[-1] + 2)
        mark = np.where(step == 0, 0, np.where(step == 1, np.where(side % 2 == 0, 1, 2), 2))
        last_of_word = np.concatenate([word[side[:-1] // 2] != word[side[1:] // 2], [True]])
        mark[last_of_word] = 3
        marks = (",", "|", ";", "")
        parts = [names[i] + marks[m] for i, m in zip(ids.tolist(), mark.tolist())]
        text = "".join(parts).encode()
        ends = np.cumsum(np.array([len(part) for part in parts]))[last_of_word].tolist()

        header = np.zeros((n, HEADER), dtype=np.int32)
        header[:, 0] = np.bincount(word[group_a], minlength=n)
        header[:, 1] = np.bincount(word[group_b], minlength=n)
        header[:, 2] = np.bincount(word, minlength=n)
        links = np.zeros(n, np.int64)
        np.add.at(links, word, size_a * size_b)
        header[:, 3] = np.diff(bounds)
        header[:, 4:6] = links.view(np.int32).reshape(n, 2)
        heads, links, times = header.tobytes(), link.astype(np.int64).tobytes(), often.tobytes()
        out, begin, wide = [], 0, 4 * HEADER
        for i in range(n):
            x, y = bounds[i], bounds[i + 1]
            out.append(b"".join((heads[wide * i:wide * i + wide], links[8 * x:8 * y], times[4 * x:4 * y],
                                 text[begin:ends[i]])))
            begin = ends[i]
        return out


def _cost(word: str, value: bytes | None) -> int:
    """Bytes that a remembered word takes, with the objects around it."""
    return 200 + 4 * len(word) + (0 if value is None else len(value))


def _open(word: str) -> bool:
    """Whether white space at its edge may join the word to its neighbour."""
    return not word or word[0].isspace() or word[-1].isspace()


def _joined(words: list[str]) -> list[str]:
    out, bare = [], False
    for word in words:
        if out and not (bare and word and not word[0].isspace()):
            out[-1] = f"{out[-1]} {word}"
        else:
            out.append(word)
        bare = bool(word) and not word[-1].isspace()
    return out


def _ends(cuts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The byte behind every token.

    ``cuts`` are the ends of spans. A span that ends where the one before it does, or goes on into the
    next token, belongs to a part of a character; such tokens, and those without a span (-1), end
    where their decoded bytes do.
    """
    decoded = np.cumsum(sizes)
    coarse = (cuts >= 0) & (np.diff(cuts, prepend=0) == sizes) & (cuts == decoded)
    return np.where(coarse, cuts, decoded)


def _links(a, group_a, size_a, b, group_b, size_b, width) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, link and number of pairs; a large group gives each pair of its distinct ids once."""
    large = size_a * size_b > _LARGE_GROUP
    first_b = np.cumsum(size_b) - size_b
    few = ~large[group_a]
    left, at = a[few], group_a[few]
    times = size_b[at]
    offset = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    group = np.repeat(at, times)
    link = np.repeat(left, times) * width + b[first_b[group] + offset]
    groups, links, often = [group], [link], [np.ones(len(link), np.int64)]
    for g in np.flatnonzero(large).tolist():
        ids_a, n_a = np.unique(a[group_a == g], return_counts=True)
        ids_b, n_b = np.unique(b[group_b == g], return_counts=True)
        links.append((ids_a[:, None] * width + ids_b).ravel())
        often.append((n_a[:, None] * n_b).ravel())
        groups.append(np.full(len(links[-1]), g))
    return np.concatenate(groups), np.concatenate(links), np.concatenate(often)


@functools.lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def align_texts(texts: list[str | None], tool: Aligner) -> dict[str, list | np.ndarray]:
    """Columns of ALIGNED for texts, without their ids; ``bounds`` cuts the links by text."""
    split = tool.split(texts)
    known = tool.align(set().union(*split))
    bad = {word for word, value in known.items() if value is None}
    valid = [bool(words) and (not bad or bad.isdisjoint(words)) for words in split]
    parts = [words if good else [] for words, good in zip(split, valid)]
    number = {word: i for i, word in enumerate(known)}
    values = [value or _NOTHING for value in known.values()]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    index = np.fromiter(
        (i for words in parts for i in map(number.__getitem__, words)), np.int64, int(counts.sum()))
    document = np.repeat(np.arange(len(parts)), counts)

    header = np.frombuffer(b"".join([value[:4 * HEADER] for value in values]), np.int32).reshape(-1, HEADER)
    sizes = header[:, 3].astype(np.int64)
    links = np.frombuffer(b"".join([v[_AT:_AT + 8 * k] for v, k in zip(values, sizes.tolist())]), np.int64)
    times = np.frombuffer(b"".join(
        [v[_AT + 8 * k:_AT + 12 * k] for v, k in zip(values, sizes.tolist())]), np.int32).astype(np.int64)
    text = [v[_AT + 12 * k:] for v, k in zip(values, sizes.tolist())]
    each = {"n_a": header[:, 0], "n_b": header[:, 1], "n_groups": header[:, 2],
            "n_links": header[:, 4:6].copy().view(np.int64).ravel()}
    totals = {}
    for name, of_word in each.items():
        totals[name] = np.zeros(len(parts), np.int64)
        np.add.at(totals[name], document, of_word[index].astype(np.int64))

    digests, at, places = [], 0, index.tolist()
    for n, good in zip(counts.tolist(), valid):
        digests.append(hashlib.sha256(
            b";".join([text[i] for i in places[at:at + n]])).hexdigest() if good else "")
        at += n
    names, dense = np.unique(links, return_inverse=True)
    per = sizes[index]
    first = (np.cumsum(sizes) - sizes)[index]
    gather = np.repeat(first - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
    key = np.repeat(document, per) * max(len(names), 1) + dense[gather]
    order = np.argsort(key)
    key, often = key[order], times[gather][order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    owner, link = np.divmod(key[starts], max(len(names), 1))
    return {
        **totals, "groups_sha256": digests,
        "links": names[link] if len(link) else np.empty(0, np.int64),
        "times": np.add.reduceat(often, starts) if len(starts) else np.empty(0, np.int64),
        "bounds": np.searchsorted(owner, np.arange(len(parts) + 1)),
    }


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document with its distinct links and how often each occurs; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(path_a, path_b)
        for batch in batches:
            for rows in slices(batch, "text", _SLICE):
                found = align_texts(rows.column("text").to_pylist(), tool)
                bounds = pa.array(found["bounds"], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    rows.column("row"), rows.column("doc_id"),
                    *[pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
                    pa.array(found["groups_sha256"], pa.string()),
                    pa.ListArray.from_arrays(bounds, pa.array(found["links"], pa.int64())),
                    pa.ListArray.from_arrays(bounds, pa.array(found["times"], pa.int64())),
                ], names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256",
                          "links", "times"])

    return written(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
        "text").mapInArrow(run, ALIGNED), "aligned")


def piece_count(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()


def link_counts(aligned: DataFrame, width: int) -> DataFrame:
    """``a``, ``link``, ``n`` (documents that hold the link) and ``best`` (no link of its A id has
    more); written. A window holds the links of one A id, at most one per id of B."""
    counts = aligned.select(F.explode("links").alias("link")).groupBy("link").agg(
        F.count(F.lit(1)).alias("n"))
    named = counts.withColumn("a", F.floor(F.col("link") / width).cast("bigint"))
    return written(named.select(
        "a", "link", "n", (F.col("n") == F.max("n").over(Window.partitionBy("a"))).alias("best")),
        "link-counts")


def segments(counts: DataFrame, most_links: int) -> list[tuple[int, int]]:
    """Ranges of A ids with at most ``most_links`` links each, but for ranges of one id.

    One row per id of A comes to the driver, whose number the vocabulary bounds.
    """
    sizes = sorted((row.a, row.n) for row in counts.groupBy("a").agg(F.count(F.lit(1)).alias("n")).collect())
    out, begin, held = [], 0, 0
    for a, n in sizes:
        if held and held + n > most_links:
            out.append((begin, a))
            begin, held = a, 0
        held += n
    return [*out, (begin, 1 << 62)]


def link_table(docs: DataFrame, path_a: str, path_b: str, most_links: int = 4_000_000) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per document."""
    spark = docs.sparkSession
    aligned = align(docs, path_a, path_b)
    counts = link_counts(aligned, piece_count(path_b))
    parts = []
    for begin, end in segments(counts, most_links):
        held = counts.where((F.col("a") >= begin) & (F.col("a") < end)).select("link", "n", "best").toArrow()
        order = np.argsort(held["link"].to_numpy())
        table = spark.sparkContext.broadcast((
            held["link"].to_numpy()[order], held["n"].to_numpy()[order],
            held["best"].to_numpy(zero_copy_only=False)[order]))
        parts.append(aligned.select("row", "links", "times").mapInArrow(
            functools.partial(_score, table=table), SCORED))
    sums = reduce(DataFrame.unionAll, parts).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.join(sums, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _score(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    """Per document the sums over those of its links that are in the table."""
    names, counts, best = table.value
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        links, times = batch.column("links"), batch.column("times")
        owner = pc.list_parent_indices(links).to_numpy(zero_copy_only=False)
        link = links.flatten().to_numpy(zero_copy_only=False)
        often = times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.searchsorted(names, link)
        place[place == len(names)] = 0
        here = names[place] == link if len(names) else np.zeros(len(link), bool)
        owner, often, place = owner[here], often[here], place[here]
        n_best, count_sum = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.add.at(n_best, owner, np.where(best[place], often, 0))
        np.add.at(count_sum, owner, often * counts[place])
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(n_best), pa.array(count_sum)],
            names=["row", "n_best", "count_sum"])
