"""Language-model scores from a log-frequency Bloom filter.

Counts of word n-grams are quantised on a log scale: a count c has level 1 + floor(log c / log b).
The filter holds, for an n-gram of level q, the q keys (n-gram, 1) ... (n-gram, q); its count is
read back by probing levels 1, 2, ... until one is absent, so a reading can be too high (a false
positive) and never too low. The probability of a word w after h is

    p(w | h) = (c(hw) + mu * p(w | h')) / (c(h) + mu),      p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))

with h' one word shorter and c(hw) at most c(h). All counts of the model are readings.

Size: every n-gram of every training document is in the filter, which takes ``bits_per_key`` bits a
key at any size, so its false positives do not depend on the size of the corpus. It is built in
segments, each holding the n-grams whose hash falls into it, by as many tasks as there are segments.
Up to ``most_bytes`` it is broadcast. A larger one stays in its segments: the documents are packed
into chunks of some megabytes, the distinct n-grams of a chunk are dealt to their segments and come
back as levels. Readings are the same either way.

The base score needs exact counts. Words are known by a 64-bit hash. Those with a share of at least
``1 / frequent`` of all tokens, at most ``frequent`` of them, are broadcast; a document's other
words are joined with the table of counts.

Defined results: NULL text is empty and has the end token alone; a NULL id counts as the empty text
in the split; repeated rows come as often as they are; without training documents every count is 0.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.llm.columns import mix, slices, split_words
from calibrant.llm.tables import id_remainder, shuffle_width, written

HELD_OUT = (10, 0)
END, BEGIN = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
_JOIN = np.uint64(0x9FB21C651E98DF25)
_LEVEL = np.uint64(0xA0761D6478BD642F)
_MOST_LEVELS = 120
CHUNK = 4 << 20         # bytes of text that ask a filter in segments together


@dataclass(frozen=True)
class Settings:
    """Parameters of the model."""

    order: int = 2
    base: float = 1.5
    mu: float = 40.0
    bits_per_key: float = 9.0
    most_bytes: int = 96 << 20
    frequent: int = 1 << 20
    segment_keys: int = 2_000_000


@functools.lru_cache(maxsize=8)
def level_values(base: float) -> np.ndarray:
    """The mean of the counts that have each level; level 0 is a count of 0."""
    edges = base ** np.arange(_MOST_LEVELS + 1)
    low = np.ceil(edges[:-1] - 1e-9)
    high = np.ceil(edges[1:] - 1e-9) - 1
    return np.concatenate([[0.0], np.where(high >= low, (low + high) / 2, low)])


def levels(counts: np.ndarray, base: float) -> np.ndarray:
    return np.minimum(
        _MOST_LEVELS, 1 + np.floor(np.log(counts) / np.log(base) + 1e-9)).astype(np.int64)


def ngrams(texts: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams that end at each token, by length, and each token's document.

    Every document gets one end token; histories start with a begin mark, which is no token.
    """
    words = split_words(texts)
    count = np.diff(words.first) + 1
    documents = np.repeat(np.arange(len(count)), count)
    last = np.cumsum(count) - 1
    one = np.full(len(documents), END)
    inner = np.ones(len(documents), dtype=bool)
    inner[last] = False
    one[inner] = words.hashes()
    found, history = [one], one
    for _ in range(order - 1):
        # The previous token's n-gram is the history; a document's first token has the begin mark.
        before = np.empty_like(history)
        before[1:] = history[:-1]
        before[last - count + 1] = BEGIN
        history = mix(before * _JOIN + one)
        found.append(history)
    return found, documents


class Filter:
    """Segments of a Bloom filter over (n-gram, level) keys."""

    def __init__(self, bits: np.ndarray, segments: int, hashes: int, base: float):
        self.bits, self.segments, self.hashes, self.base = bits, segments, hashes, base
        self.width = len(bits) * 8 // segments

    @staticmethod
    def segment_of(grams: np.ndarray, segments: int) -> np.ndarray:
        return (grams >> np.uint64(40)) % np.uint64(segments)

    @staticmethod
    def places(grams: np.ndarray, level: np.ndarray, hashes: int, width: int) -> Iterator[np.ndarray]:
        """Bit numbers inside a segment, one array per hash function."""
        start = mix(grams ^ (level.astype(np.uint64) * _LEVEL))
        step = mix(start + _JOIN) | np.uint64(1)
        for _ in range(hashes):
            yield start % np.uint64(width)
            start = start + step

    def read(self, grams: np.ndarray) -> np.ndarray:
        """The count that the levels present in the filter stand for."""
        return level_values(self.base)[self.read_levels(grams)]

    def counts(self, found: list[np.ndarray]) -> list[np.ndarray]:
        """Readings of all n-grams; each distinct one is read once."""
        out = []
        for grams in found:
            unique, back = np.unique(grams, return_inverse=True)
            out.append(self.read(unique)[back])
        return out

    def read_levels(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams), dtype=np.int64)
        base = self.segment_of(grams, self.segments) * np.uint64(self.width)
        alive = np.arange(len(grams))
        for level in range(1, _MOST_LEVELS + 1):
            if not len(alive):
                break
            here = np.full(len(alive), level)
            # A key is dropped at its first bit that is not set.
            start = mix(grams[alive] ^ (here.astype(np.uint64) * _LEVEL))
            step = mix(start + _JOIN) | np.uint64(1)
            for _ in range(self.hashes):
                bit = base[alive] + start % np.uint64(self.width)
                on = (self.bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
                on = on.astype(bool)
                alive, start, step = alive[on], start[on] + step[on], step[on]
            out[alive] = level
        return out


class Answers:
    """Levels that came back for the distinct n-grams of a chunk, segment after segment."""

    def __init__(self, levels: np.ndarray, segments: int, base: float):
        self.levels, self.segments, self.base = levels, segments, base

    def counts(self, found: list[np.ndarray]) -> list[np.ndarray]:
        """Readings of all n-grams of the chunk."""
        grams, back = np.unique(np.concatenate(found), return_inverse=True)
        values = np.empty(len(grams))
        values[_by_segment(grams, self.segments)[0]] = level_values(self.base)[self.levels]
        return np.split(values[back], len(found))


def _by_segment(grams: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of n-grams by segment, and where each segment's begin in it."""
    place = Filter.segment_of(grams, segments).astype(np.min_scalar_type(segments))
    order = np.argsort(place, kind="stable")
    return order, np.searchsorted(place[order], np.arange(segments + 1))


def is_training(column: str = "doc_id"):
    modulus, held_out = HELD_OUT
    return id_remainder(modulus, column) != held_out


def count_words(texts: DataFrame) -> DataFrame:
    """``word`` (hash) and ``n``, exact, over the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ngrams(part.column(0), 1)[0][0] for part in slices(batch, "text", 8 << 20)]
            for grams in found:
                word, n = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))],
                    names=["word", "n"])

    return texts.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def count_ngrams(texts: DataFrame, order: int, segments: int) -> DataFrame:
    """Packed counts of the n-grams of lengths 1 to ``order``: rows of one segment, as blobs of
    sorted hashes and their counts in one task's share of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                found, _ = ngrams(part.column(0), order)
                held += found
                size += sum(map(len, found))
                if size > 3_000_000:
                    yield from _packed(held, segments)
                    held, size = [], 0
        if held:
            yield from _packed(held, segments)

    return texts.mapInArrow(run, "segment int, grams binary, counts binary")


def _packed(held: list[np.ndarray], segments: int) -> Iterator[pa.RecordBatch]:
    grams, n = np.unique(np.concatenate(held), return_counts=True)
    place = Filter.segment_of(grams, segments).astype(np.int64)
    order = np.argsort(place, kind="stable")
    grams, n, place = grams[order], n[order].astype(np.uint32), place[order]
    cuts = np.searchsorted(place, np.arange(segments + 1))
    filled = np.flatnonzero(np.diff(cuts))
    yield pa.RecordBatch.from_arrays(
        [pa.array(filled.astype(np.int32)),
         pa.array([grams[cuts[s]:cuts[s + 1]].tobytes() for s in filled], pa.binary()),
         pa.array([n[cuts[s]:cuts[s + 1]].tobytes() for s in filled], pa.binary())],
        names=["segment", "grams", "counts"])


@dataclass(frozen=True)
class Layout:
    """Segments of a filter, bits of each and hash functions."""

    segments: int
    width: int
    hashes: int

    @classmethod
    def of(cls, segments: int, keys: int, bits: int) -> Layout:
        width = -(-bits // segments // 8) * 8
        return cls(segments, width, max(1, min(8, round(np.log(2) * width * segments / max(1, keys)))))


def wanted_bits(segments: int, keys: int, settings: Settings) -> int:
    return max(64 * segments, int(keys * settings.bits_per_key))


def distinct_ngrams(
    texts: DataFrame, tokens: int, settings: Settings
) -> tuple[DataFrame, int, int]:
    """segment, grams, levels of the column ``text``, which has ``tokens`` tokens; the number of
    segments, and of the keys in all."""
    spark = texts.sparkSession
    segments = max(1, -(-tokens * settings.order // settings.segment_keys))
    base = settings.base
    # Rows of a segment meet in one task, which holds one segment at a time.
    dealt = count_ngrams(texts, settings.order, segments).repartition(
        shuffle_width(spark), "segment").sortWithinPartitions("segment")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment, grams, n in _segments(batches):
            level = levels(n, base)
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment], pa.int32()), pa.array([int(level.sum())], pa.int64()),
                 pa.array([grams.tobytes()], pa.binary()),
                 pa.array([level.astype(np.uint8).tobytes()], pa.binary())],
                names=["segment", "keys", "grams", "levels"])

    merged = written(
        dealt.mapInArrow(merge, "segment int, keys bigint, grams binary, levels binary"), "ngrams")
    keys = merged.agg(F.sum("keys").alias("keys")).head().keys or 0
    return merged, segments, keys


def filled(merged: DataFrame, layout: Layout) -> DataFrame:
    """segment, bits: the segments of the filter over ``distinct_ngrams``."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                grams = np.frombuffer(batch.column(1)[i].as_py(), dtype=np.uint64)
                most = np.frombuffer(batch.column(2)[i].as_py(), dtype=np.uint8)
                on = np.zeros(layout.width, dtype=bool)
                for level in range(1, int(most.max(initial=0)) + 1):
                    here = grams[most >= level]
                    for bit in Filter.places(
                            here, np.full(len(here), level), layout.hashes, layout.width):
                        on[bit] = True
                packed = np.packbits(on, bitorder="little").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([packed], pa.binary())],
                    names=["segment", "bits"])

    return merged.select("segment", "grams", "levels").mapInArrow(fill, "segment int, bits binary")


def gathered(merged: DataFrame, layout: Layout, base: float) -> Filter:
    """The whole filter in this process."""
    bits = np.zeros(layout.segments * layout.width // 8, dtype=np.uint8)
    for row in filled(merged, layout).toLocalIterator(prefetchPartitions=True):
        begin = row.segment * layout.width // 8
        bits[begin:begin + layout.width // 8] = np.frombuffer(row.bits, dtype=np.uint8)
    return Filter(bits, layout.segments, layout.hashes, base)


def build_filter(texts: DataFrame, tokens: int, settings: Settings) -> Filter:
    """A filter of at most ``most_bytes`` (and one byte a segment), whatever its false positives."""
    merged, segments, keys = distinct_ngrams(texts, tokens, settings)
    bits = min(8 * settings.most_bytes, wanted_bits(segments, keys, settings))
    return gathered(merged, Layout.of(segments, keys, bits), settings.base)


def _asked(part: pa.RecordBatch, order: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a chunk by segment, and where each segment's begin."""
    # By hand: without counts or places, np.unique goes by a hash table, which takes longer.
    grams = np.sort(np.concatenate(ngrams(part.column(2), order)[0]))
    grams = grams[np.concatenate([[True], grams[1:] != grams[:-1]])]
    by, cuts = _by_segment(grams, segments)
    return grams[by], cuts


def _chunk(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def answered(
    rows: DataFrame, merged: DataFrame, layout: Layout, settings: Settings
) -> DataFrame:
    """chunk, segment, data: a chunk of ``rows`` (doc_id, key, text) under segment -1, and the levels
    of its n-grams under their segments, read where the segments are."""
    width = shuffle_width(rows.sparkSession)
    order, segments, base = settings.order, layout.segments, settings.base

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                sink = pa.BufferOutputStream()
                options = pa.ipc.IpcWriteOptions(compression="zstd")
                with pa.ipc.new_stream(sink, part.schema, options=options) as writer:
                    writer.write_batch(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk]), pa.array([-1], pa.int32()),
                     pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                    names=["chunk", "segment", "data"])
                chunk += 1

    kinds = "chunk bigint, segment int, data binary"
    # Written, so that every reader meets the same chunks under the same numbers.
    chunks = written(rows.mapInArrow(pack, kinds), "chunks")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                grams, cuts = _asked(_chunk(batch.column(2)[i].as_py()), order, segments)
                some = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), batch.column(0)[i].as_py())),
                     pa.array(some.astype(np.int32)),
                     pa.array([grams[cuts[k]:cuts[k + 1]].tobytes() for k in some], pa.binary())],
                    names=["chunk", "segment", "data"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, filter_ = None, None
        for batch in batches:
            who, places, data = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            begins = np.flatnonzero(np.diff(places, prepend=-1))
            for begin, end in zip(begins, [*begins[1:], batch.num_rows]):
                if places[begin] != now:
                    now, filter_ = places[begin], Filter(
                        np.zeros(layout.width // 8, dtype=np.uint8), 1, layout.hashes, base)
                if who[begin] < 0:
                    filter_ = Filter(np.frombuffer(data[begin].as_py(), np.uint8), 1, layout.hashes, base)
                    begin += 1
                if begin < end:
                    yield _told(filter_, who[begin:end], now, data.slice(begin, end - begin))

    # The segment itself sorts before those who ask it.
    bits = filled(merged, layout).select(
        F.lit(-1).cast("bigint").alias("chunk"), "segment", F.col("bits").alias("data"))
    met = bits.unionByName(chunks.mapInArrow(ask, kinds)).repartition(
        width, "segment").sortWithinPartitions("segment", "chunk")
    return chunks.unionByName(met.mapInArrow(answer, kinds)).repartition(
        width, "chunk").sortWithinPartitions("chunk", "segment")


def _told(filter_: Filter, chunks: np.ndarray, segment: int, asked: pa.Array) -> pa.RecordBatch:
    """The levels that chunks ask one segment for. They are read together: the many chunks of a large
    table ask for few n-grams each, and many of them for the same."""
    blobs = [blob.as_buffer() for blob in asked]
    grams, back = np.unique(np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in blobs]),
                            return_inverse=True)
    found = filter_.read_levels(grams).astype(np.uint8)[back]
    cuts = np.cumsum([x.size // 8 for x in blobs])[:-1]
    return pa.RecordBatch.from_arrays(
        [pa.array(chunks), pa.array(np.full(len(chunks), segment, np.int32)),
         pa.array([x.tobytes() for x in np.split(found, cuts)], pa.binary())],
        names=["chunk", "segment", "data"])


def chunks_with_answers(
    batches: Iterator[pa.RecordBatch], settings: Settings, segments: int
) -> Iterator[tuple[pa.RecordBatch, Answers]]:
    """The chunks of a sorted partition of ``answered``."""
    def told(data: bytes, found: list[bytes]) -> tuple[pa.RecordBatch, Answers]:
        return _chunk(data), Answers(np.frombuffer(b"".join(found), np.uint8), segments, settings.base)

    data, found = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            value = batch.column(2)[i].as_py()
            if batch.column(1)[i].as_py() >= 0:
                found.append(value)
                continue
            if data is not None:
                yield told(data, found)
            data, found = value, []
    if data is not None:
        yield told(data, found)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Distinct n-grams and their counts, segment after segment of a sorted partition."""
    held, counts, now = [], [], None
    for batch in batches:
        for i in range(batch.num_rows):
            segment = batch.column(0)[i].as_py()
            if segment != now and held:
                yield (now, *_summed(held, counts))
                held, counts = [], []
            now = segment
            held.append(np.frombuffer(batch.column(1)[i].as_py(), dtype=np.uint64))
            counts.append(np.frombuffer(batch.column(2)[i].as_py(), dtype=np.uint32))
    if held:
        yield (now, *_summed(held, counts))


def _summed(held: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    grams, n = np.concatenate(held), np.concatenate(counts).astype(np.int64)
    order = np.argsort(grams, kind="stable")
    grams, n = grams[order], n[order]
    begin = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[begin], np.add.reduceat(n, begin)


def log_probabilities(
    found: list[np.ndarray], documents: np.ndarray, filter_: Filter | Answers, tokens: int, distinct: int,
    mu: float,
) -> np.ndarray:
    """log10 p of every token given the words before it, from readings of the filter."""
    counts = filter_.counts(found)
    begins = np.flatnonzero(np.diff(documents, prepend=-1))
    p = (counts[0] + 0.1) / (tokens + 0.1 * (distinct + 1))
    # After the begin mark a text's first word has as many chances as there are texts: the ends.
    texts = counts[0][-1] if len(documents) else 0.0
    for n in range(1, len(found)):
        history = np.empty(len(documents))
        history[1:] = counts[n - 1][:-1]
        history[begins] = texts
        together = np.minimum(counts[n], history)
        p = (together + mu * p) / (history + mu)
    return np.log10(np.minimum(p, 1.0))


def score_texts(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = rows.filter(is_training()).select("text")
    counts = written(count_words(training), "word-counts")
    total = counts.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("distinct")).head()
    tokens, distinct = int(total.tokens or 0), int(total.distinct)
    merged, segments, keys = distinct_ngrams(training, tokens, settings)
    bits = wanted_bits(segments, keys, settings)
    layout, small = Layout.of(segments, keys, bits), bits <= 8 * settings.most_bytes
    filter_ = spark.sparkContext.broadcast(gathered(merged, layout, settings.base)) if small else None
    # A share of 1 / frequent: no more than ``frequent`` words can have it.
    least = max(1, -(-tokens // settings.frequent))
    table = counts.filter(F.col("n") >= least).toPandas().sort_values("word")
    frequent = spark.sparkContext.broadcast((table["word"].to_numpy(), table["n"].to_numpy()))
    order, mu, whole = settings.order, settings.mu, tokens + 0.1 * (distinct + 1)

    def with_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Filter]]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield part, filter_.value
            batch = part = None   # else it is held while the next one is read

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = frequent.value
        parts = with_filter(batches) if small else chunks_with_answers(batches, settings, segments)
        for part, counted in parts:
            found, documents = ngrams(part.column(2), order)
            size = part.num_rows
            place = np.minimum(np.searchsorted(words, found[0].view(np.int64)), len(words) - 1)
            usual = words[place] == found[0].view(np.int64) if len(words) else np.zeros(
                len(documents), dtype=bool)
            usual_n = np.where(usual, n[place], 0) if len(words) else np.zeros(len(documents))
            base = np.where(usual, np.log10((usual_n + 0.1) / whole if whole else 1.0), 0.0)
            p = log_probabilities(found, documents, counted, tokens, distinct, mu) if (
                tokens) else np.zeros(len(documents))
            yield _rows(part, {
                "word": None,
                "n_tokens": np.bincount(documents, minlength=size),
                "n_known": np.bincount(documents[usual], minlength=size),
                "base": np.bincount(documents, weights=base, minlength=size),
                "score": np.bincount(documents, weights=p, minlength=size)}, np.arange(size))
            rare, at = found[0][~usual], documents[~usual]
            if len(rare):
                order_ = np.lexsort((rare, at))
                rare, at = rare[order_], at[order_]
                begin = np.flatnonzero(np.concatenate(
                    [[True], (rare[1:] != rare[:-1]) | (at[1:] != at[:-1])]))
                yield _rows(part, {
                    "word": rare[begin].view(np.int64),
                    "n_tokens": np.diff(np.append(begin, len(rare))),
                    "n_known": None, "base": None, "score": None}, at[begin])
            part = None

    # Rows of a document with its sums, and one per word that is not frequent. The former carry
    # their own key in ``word`` and a kind that no count has, so none is dealt to one task.
    marked = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    source = marked if small else answered(marked, merged, layout, settings)
    seen = source.mapInArrow(
        run, "doc_id bigint, key bigint, word bigint, own boolean, n_tokens bigint, n_known bigint, "
        "base double, score double")
    known = counts.filter(F.col("n") < least).select("word", "n", F.lit(False).alias("own"))
    joined = seen.join(known, ["word", "own"], "left")
    times = F.col("n_tokens")
    rare_base = F.log10((F.coalesce(F.col("n"), F.lit(0)) + F.lit(0.1)) / F.lit(whole or 1.0))
    sums = joined.groupBy("doc_id", "key").agg(
        F.sum(F.col("own").cast("bigint")).alias("copies"),
        F.max(F.when(F.col("own"), times)).alias("n_tokens"),
        F.sum(F.when(F.col("own"), F.col("n_known")).when(F.col("n").isNotNull(), times)
              .otherwise(0)).alias("n_known"),
        F.sum(F.when(F.col("own"), F.col("base")).otherwise(times * rare_base)).alias("base_score"),
        F.max("score").alias("score"))
    each = F.col("copies")
    return sums.select(
        "doc_id", (~is_training()).alias("held_out"), "n_tokens",
        (F.col("n_known") / each).cast("bigint").alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base_score") / each).alias("base_score"), "score",
        F.explode(F.sequence(F.lit(1).cast("bigint"), each)).alias("copy")).drop("copy")


def _rows(part: pa.RecordBatch, values: dict, at: np.ndarray) -> pa.RecordBatch:
    own = values["word"] is None
    key = part.column(1).take(pa.array(at))
    n = len(at)
    kinds = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(),
             "score": pa.float64()}
    return pa.RecordBatch.from_arrays(
        [part.column(0).take(pa.array(at)), key,
         key if own else pa.array(values["word"]), pa.array([own] * n, pa.bool_()),
         *(pa.nulls(n, kind) if values[name] is None else pa.array(values[name]).cast(kind)
           for name, kind in kinds.items())],
        names=["doc_id", "key", "word", "own", *kinds])
