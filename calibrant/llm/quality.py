"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``passage_words`` words; its label says nothing about which
passage is good or bad. Every passage of the whole text is described by the shape of its bytes and
words and encoded by a small network; gated attention, learnt from document labels alone, weighs
the passages, and the weighted mean of their codes is scored by logistic regression.

The network is fitted on a bounded sample of labelled documents (``training_documents``, those with
the smallest hash of their id); scoring reads every document and uses its text alone.

Defined results: NULL or blank text is one passage without words and gets the network's score for
that; labels that are NULL or contradict each other for one id teach nothing; without labels every
score is 0.5, and with labels of one kind their smoothed share. Repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibrant.llm.columns import slices, split_words
from calibrant.llm.tables import id_remainder

HELD_OUT = (3, 1)
_CLASSES = 8
_CLASS = np.full(256, 5, dtype=np.uint8)     # other signs
_CLASS[ord("a"):ord("z") + 1] = 0
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[ord("0"):ord("9") + 1] = 2
_CLASS[list(b".,;:'\"()-")] = 3
_CLASS[list(b"!?")] = 4
_CLASS[128:] = 6
_CLASS[[*range(0x21), 0x7F]] = 7
FEATURES = _CLASSES + 7


@dataclass(frozen=True)
class Training:
    """Parameters of the fit."""

    passage_words: int = 48
    training_documents: int = 6_000
    epochs: int = 40
    bags: int = 128
    code: int = 24
    gate: int = 12
    rate: float = 5e-3
    decay: float = 1e-4
    seed: int = 9


def passage_features(texts: pa.Array, passage_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and per text the number of its first passage (one more at the
    end). A text without words has one passage whose features are 0."""
    words = split_words(texts, lower=False)
    count = np.diff(words.first)
    bags = np.maximum(1, -(-count // passage_words))
    first = np.concatenate([[0], np.cumsum(bags)])
    total = int(first[-1])
    inside = np.arange(len(words.start)) - np.repeat(words.first[:-1], count)
    passage = np.repeat(first[:-1], count) + inside // passage_words
    out = np.zeros((total, FEATURES))
    if not len(passage):
        return out, first
    n = np.bincount(passage, minlength=total).astype(float)
    filled = n > 0
    kinds = _CLASS[words.data]
    begin = np.flatnonzero(np.diff(passage, prepend=-1))
    stop = np.append(begin[1:], len(passage)) - 1
    sizes = words.end[stop] - words.start[begin]
    place = np.repeat(passage[begin], sizes)
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at += np.repeat(words.start[begin], sizes)
    shares = np.bincount(
        place * _CLASSES + kinds[at], minlength=total * _CLASSES).reshape(total, _CLASSES)
    out[:, :_CLASSES] = shares / np.maximum(shares.sum(axis=1, keepdims=True), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(passage, weights=mask, minlength=total) / np.maximum(n, 1)

    h = words.hashes()
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
    keys = np.sort((passage.astype(np.uint64) << np.uint64(36)) | (h >> np.uint64(28)))
    distinct = keys[np.flatnonzero(np.diff(keys, prepend=~keys[:1]))] >> np.uint64(36)
    last, initial = kinds[words.end - 1], kinds[words.start]
    columns = [
        share(words.end - words.start) / 10, share(same),
        np.bincount(distinct.astype(np.int64), minlength=total) / np.maximum(n, 1),
        share(initial == 1), share((last == 4) | (last == 5)), share(last == 3), np.log1p(n) / 4]
    out[:, _CLASSES:] = np.stack(columns, axis=1)
    out[~filled] = 0
    return out, first


class Network:
    """Passage encoder, gated attention and the document's score."""

    def __init__(self, parts: dict[str, np.ndarray], center: np.ndarray, scale: np.ndarray):
        self.parts, self.center, self.scale = parts, center, scale

    def forward(self, features: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.parts
        x = (features - self.center) / self.scale
        code = np.tanh(x @ p["encode"] + p["encode0"])
        content = np.tanh(code @ p["content"] + p["content0"])
        gate = _logistic(code @ p["gate"] + p["gate0"])
        raw = (content * gate) @ p["attend"]
        begin, bag = first[:-1], np.repeat(np.arange(len(first) - 1), np.diff(first))
        weight = np.exp(raw - np.maximum.reduceat(raw, begin)[bag])
        weight /= np.add.reduceat(weight, begin)[bag]
        pooled = np.add.reduceat(weight[:, None] * code, begin, axis=0)
        score = _logistic(pooled @ p["score"] + p["score0"])
        return {"x": x, "code": code, "content": content, "gate": gate, "weight": weight,
                "bag": bag, "begin": begin, "pooled": pooled, "score": score}

    def gradient(self, seen: dict[str, np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        p, bag, begin = self.parts, seen["bag"], seen["begin"]
        out = (seen["score"] - labels) / len(labels)
        pooled = out[:, None] * p["score"]
        code = seen["weight"][:, None] * pooled[bag]
        weight = (seen["code"] * pooled[bag]).sum(axis=1)
        raw = seen["weight"] * (
            weight - np.add.reduceat(seen["weight"] * weight, begin)[bag])
        both = raw[:, None] * p["attend"]
        content = both * seen["gate"] * (1 - seen["content"] ** 2)
        gate = both * seen["content"] * seen["gate"] * (1 - seen["gate"])
        code += content @ p["content"].T + gate @ p["gate"].T
        code *= 1 - seen["code"] ** 2
        return {
            "score": seen["pooled"].T @ out, "score0": np.array(out.sum()),
            "attend": (seen["content"] * seen["gate"]).T @ raw,
            "content": seen["code"].T @ content, "content0": content.sum(axis=0),
            "gate": seen["code"].T @ gate, "gate0": gate.sum(axis=0),
            "encode": seen["x"].T @ code, "encode0": code.sum(axis=0)}


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def train(bags: list[np.ndarray], labels: np.ndarray, training: Training) -> Network:
    """Adam over shuffled batches of bags."""
    everything = np.concatenate(bags)
    center, scale = everything.mean(axis=0), everything.std(axis=0) + 1e-3
    draw = np.random.default_rng(training.seed)
    shapes = {"encode": (FEATURES, training.code), "encode0": (training.code,),
              "content": (training.code, training.gate), "content0": (training.gate,),
              "gate": (training.code, training.gate), "gate0": (training.gate,),
              "attend": (training.gate,), "score": (training.code,), "score0": ()}
    parts = {name: np.zeros(shape) if name.endswith("0") else
             draw.normal(size=shape) / np.sqrt(shape[0]) for name, shape in shapes.items()}
    network = Network(parts, center, scale)
    slow = {name: np.zeros(shape) for name, shape in shapes.items()}
    fast = {name: np.zeros(shape) for name, shape in shapes.items()}
    step = 0
    for _ in range(training.epochs):
        order = draw.permutation(len(bags))
        for begin in range(0, len(order), training.bags):
            chosen = order[begin:begin + training.bags]
            first = np.cumsum([0, *(len(bags[i]) for i in chosen)])
            seen = network.forward(np.concatenate([bags[i] for i in chosen]), first)
            step += 1
            for name, g in network.gradient(seen, labels[chosen]).items():
                g = g + training.decay * parts[name]
                slow[name] = 0.9 * slow[name] + 0.1 * g
                fast[name] = 0.999 * fast[name] + 0.001 * g * g
                parts[name] = parts[name] - training.rate * (slow[name] / (1 - 0.9 ** step)) / (
                    np.sqrt(fast[name] / (1 - 0.999 ** step)) + 1e-8)
    return network


@dataclass(frozen=True)
class Model:
    """A fitted network, or the one score of all documents where there was nothing to tell."""

    network: Network | None
    constant: float
    passage_words: int

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.constant)
        found = []
        for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", 1 << 20):
            features, first = passage_features(part.column(0), self.passage_words)
            found.append(self.network.forward(features, first)["score"])
        return np.concatenate(found) if found else np.empty(0)


def fit(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> Model:
    """Learn from labelled documents that are not held out; other columns are never read."""
    modulus, held_out = HELD_OUT
    known = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality")
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)
                & (id_remainder(modulus) != held_out))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .filter("quality = most")
        .orderBy(F.xxhash64("doc_id", F.lit(training.seed)), "doc_id")
        .limit(training.training_documents).select("doc_id", "quality"))
    # At most ``training_documents`` rows are broadcast.
    chosen = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).join(F.broadcast(known), "doc_id")

    def describe(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                features, first = passage_features(
                    part.column(part.schema.get_field_index("text")), training.passage_words)
                blobs = [features[a:b].astype("<f4").tobytes() for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(blobs, pa.binary())],
                    names=["doc_id", "quality", "features"])

    rows = chosen.select("doc_id", "text", F.col("quality").cast("int").alias("quality")).mapInArrow(
        describe, "doc_id bigint, quality int, features binary")
    # A repeated id comes once; what is collected is bounded by the sample.
    seen = sorted(
        (row.doc_id, row.quality, bytes(row.features)) for row in rows.groupBy("doc_id").agg(
            F.min("quality").alias("quality"), F.min("features").alias("features")).collect())
    truth = np.array([quality for _, quality, _ in seen], dtype=float)
    if len(set(truth)) < 2:
        return Model(None, float((truth.sum() + 0.5) / (len(truth) + 1)), training.passage_words)
    bags = [np.frombuffer(blob, dtype="<f4").reshape(-1, FEATURES).astype(float)
            for _, _, blob in seen]
    return Model(train(bags, truth, training), 0.5, training.passage_words)


def score(model: Model, text: str | Column = "text") -> Column:
    """The score of a text column, 0 to 1."""

    @F.arrow_udf(T.DoubleType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts), pa.float64())

    return run((F.col(text) if isinstance(text, str) else text).cast("string"))


def quality_table(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels, training)
    modulus, held_out = HELD_OUT
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (id_remainder(modulus) == held_out).alias("held_out"), score(model).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> DataFrame:
    """The rows of ``docs`` whose score is at least 0.5."""
    return docs.filter(score(fit(docs, labels, training)) >= 0.5)
