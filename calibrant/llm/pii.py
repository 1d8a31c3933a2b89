"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The patterns (``pattern_spans``) give spans that always stay. The random field looks at zones:
stretches of blank-separated words that hold a digit or an at sign. A zone is cut into tokens, and
every run of at most ``MOST_TOKENS`` tokens that could be personal data at all is a candidate
segment, described as a whole: how many digits, which groups and separators, checksum, octets, what
stands beside it. A segmentation scores the sum of its segments' weights, tokens outside segments
score nothing, and one dynamic program over the zone chooses boundaries and kinds together.

Weights are fitted by maximum likelihood over all segmentations, on a bounded sample of the zones
in which the patterns find something (``training_zones``, an equal share of each kind, by the hash of the zone),
and on rewritten copies of them: other separators, spelt-out at signs and dots, as positives, and
broken checksums, octets and digit counts as negatives. So the field finds personal data written in
ways that the patterns do not cover. Without such zones it adds nothing.

Offsets count code points, ends are exclusive. NULL text is empty. Work is linear in the text.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
Span = tuple[str, int, int]

# Fixed patterns; atomic runs give the same matches without trying a run from its every digit.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset(
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

MOST_TOKENS = 28
_TRIGGER = re.compile(r"[0-9@]|[\[({](?:at|dot)[\])}]", re.I)
_TOKEN = re.compile(
    r"[\[({](?:at|dot)[\])}]|[\[({]\.[\])}]|[0-9]+|[A-Za-z]+|[^\S\r\n]+|\s|.", re.I | re.S)
_AT = re.compile(r"[\[({]at[\])}]", re.I)
_DOT = re.compile(r"[\[({](?:dot|\.)[\])}]", re.I)
_DIGITS = frozenset("0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        n = ord(digit) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def pattern_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind and start; leftmost and non-overlapping per kind."""
    found = list(_emails(text))
    for match in _IP.finditer(text):
        if all(map(_octet, match.groups())):
            found.append(("ip", *match.span()))
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 13:
            digits = _only_digits(match.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *match.span()))
    for match in _PHONE.finditer(text):
        if 9 <= len(_only_digits(match.group())) <= 15:
            found.append(("phone", *match.span()))
    return found


@dataclass
class Zone:
    """The tokens of a zone and its candidate segments by end token."""

    text: str
    cuts: list[int]
    segments: dict[int, list[tuple[int, str, tuple[str, ...]]]] = field(default_factory=dict)


def _segment_features(kind: str, body: str, before: str, after: str) -> tuple[str, ...]:
    """Features of a whole segment; the weights are per kind."""
    out = [f"{kind}"]
    plain = _DOT.sub(".", body)
    if before.isalnum() or before in "@._%+-" and before:
        out.append(f"{kind}:glued-left")
    if after.isalnum() or after in "@_" and after:
        out.append(f"{kind}:glued-right")
    if kind == "email":
        plain = re.sub(r"\s*(?:[\[({]at[\])}]|@)\s*", "@", plain, flags=re.I)
        plain = re.sub(r"\s*\.\s*", ".", plain)
        local, _, domain = plain.partition("@")
        labels = domain.split(".")
        out += [
            f"{kind}:local-ok={bool(local) and all(c in _LOCAL_CHARS for c in local)}",
            f"{kind}:labels={min(len(labels), 4)}",
            f"{kind}:labels-ok={all(re.fullmatch(r'[A-Za-z0-9-]+', x) is not None for x in labels)}",
            f"{kind}:ending={labels[-1].isalpha() and 2 <= len(labels[-1]) <= 10}",
            f"{kind}:blank={any(c.isspace() for c in plain)}"]
        return tuple(out)
    groups = re.findall(r"[0-9]+", plain)
    digits = "".join(groups)
    marks = "".join(sorted(set(re.sub(r"[0-9]", "", plain))))
    count = len(digits)
    if kind == "ip":
        out += [f"{kind}:groups={min(len(groups), 5)}", f"{kind}:octets={all(map(_octet, groups))}",
                f"{kind}:marks={marks if len(marks) < 2 else 'mixed'}"]
    elif kind == "card":
        out += [f"{kind}:luhn={luhn(digits)}", f"{kind}:size={count if 13 <= count <= 19 else 0}",
                f"{kind}:one-mark={len(marks) < 2}",
                f"{kind}:even={len(groups) == 1 or all(len(g) == 4 for g in groups[:-1])}"]
    else:
        out += [f"{kind}:size={9 <= count <= 15}", f"{kind}:plus={plain[:1] == '+'}",
                f"{kind}:groups={min(len(groups), 6)}", f"{kind}:last={len(groups[-1]) == 4}",
                f"{kind}:mid={len(groups) > 2 and len(groups[-2]) == 3 and len(groups[-3]) == 3}",
                f"{kind}:marks={len(marks) > 3}"]
    return tuple(out)


_NUMBER = re.compile(r"[+(]?[0-9](?:[0-9 ()./\-]|[\[({](?:dot|\.)[\])}])*[0-9]", re.I)
_FOUR = re.compile(r"[0-9]+(?: ?\. ?[0-9]+){3}")
_MAIL_CHARS = re.compile(r"(?:[A-Za-z0-9._%+-]|[\[({](?:at|dot|\.)[\])}]|@|[ \t])+", re.I)


def zone_of(text: str, start: int, end: int) -> Zone:
    """Tokens and candidate segments of text[start:end]."""
    cuts = [start, *(start + m.end() for m in _TOKEN.finditer(text[start:end]))]
    zone = Zone(text, cuts)
    n = len(cuts) - 1
    for i in range(n):
        head = text[cuts[i]]
        if not (head.isalnum() or head in "+("):
            continue
        digits = ats = 0
        for j in range(i + 1, min(n, i + MOST_TOKENS) + 1):
            token = text[cuts[j - 1]:cuts[j]]
            if "\n" in token or "\r" in token:
                break
            if token[0] in _DIGITS:
                digits += len(token)
                if digits > 40:
                    break
            if token == "@" or _AT.fullmatch(token):
                ats += 1
            if ats > 1 or not token[-1].isalnum():
                continue
            body = text[cuts[i]:cuts[j]]
            kinds: tuple[str, ...] = ()
            if ats:
                if _MAIL_CHARS.fullmatch(body):
                    kinds = ("email",)
            elif digits >= 4 and _NUMBER.fullmatch(body):
                kinds = tuple(kind for kind, fits in (
                    ("ip", digits <= 12 and _FOUR.fullmatch(_DOT.sub(".", body)) is not None),
                    ("card", 13 <= digits <= 19), ("phone", 9 <= digits <= 15)) if fits)
            before = text[cuts[i] - 1] if cuts[i] else ""
            after = text[cuts[j]] if cuts[j] < len(text) else ""
            for kind in kinds:
                zone.segments.setdefault(j, []).append(
                    (i, kind, _segment_features(kind, body, before, after)))
    return zone


def _word(text: str, start: int, end: int, least: int) -> tuple[int, int]:
    """text[start:end] grown to the white space on both sides, not below ``least``."""
    while start > least and not text[start - 1].isspace():
        start -= 1
    while end < len(text) and not text[end].isspace():
        end += 1
    return start, end


def zones(text: str) -> Iterator[tuple[int, int]]:
    """Words with a digit, an at sign or a spelt-out mark; neighbours one blank apart are joined.

    A mark that stands alone brings the words beside it.
    """
    begin = end = -1
    for match in _TRIGGER.finditer(text):
        if match.start() < end:
            continue
        start, stop = _word(text, *match.span(), max(end, 0))
        if _AT.fullmatch(text, start, stop) or _DOT.fullmatch(text, start, stop):
            if start > max(end, 0) and text[start - 1] in " \t":
                start = _word(text, start - 1, start - 1, max(end, 0))[0]
            if stop < len(text) and text[stop] in " \t":
                stop = _word(text, stop, stop + 1, stop + 1)[1]
        if end >= 0 and start - end <= 1 and text[end:start] in ("", " ", "\t"):
            end = stop
            continue
        if end >= 0:
            yield begin, end
        begin, end = start, stop
    if end >= 0:
        yield begin, end


class Field:
    """Weights of features; bounded-entity dynamic programming over the segments of a zone."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def _score(self, features: tuple[str, ...]) -> float:
        return sum(self.weights.get(name, 0.0) for name in features)

    def best(self, zone: Zone) -> list[Span]:
        """The segments of the segmentation with the highest score."""
        n = len(zone.cuts) - 1
        value, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for i, kind, features in zone.segments.get(j, ()):
                here = value[i] + self._score(features)
                if here > value[j] + 1e-12:
                    value[j], back[j] = here, (i, kind)
        found, j = [], n
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, kind = back[j]
                found.append((kind, zone.cuts[i], zone.cuts[j]))
                j = i
        return found[::-1]

    def marginals(self, zone: Zone) -> dict[tuple[int, int, str], float]:
        """The probability of every candidate segment over all segmentations of the zone."""
        n = len(zone.cuts) - 1
        ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
        scores = {(i, j, kind): self._score(features)
                  for j, found in zone.segments.items() for i, kind, features in found}
        by_end, by_start = {}, {}
        for (i, j, kind), value in scores.items():
            by_end.setdefault(j, []).append((i, value))
            by_start.setdefault(i, []).append((j, value))
        for j in range(1, n + 1):
            ahead[j] = np.logaddexp.reduce(
                [ahead[j - 1], *(ahead[i] + value for i, value in by_end.get(j, ()))])
        for i in range(n - 1, -1, -1):
            behind[i] = np.logaddexp.reduce(
                [behind[i + 1], *(behind[j] + value for j, value in by_start.get(i, ()))])
        return {(i, j, kind): float(np.exp(ahead[i] + value + behind[j] - ahead[n]))
                for (i, j, kind), value in scores.items()}


@dataclass(frozen=True)
class Training:
    """Parameters of the fit."""

    training_zones: int = 600
    epochs: int = 12
    rate: float = 0.5
    decay: float = 1e-3
    start: float = -4.0   # of every kind's own weight: no evidence, no segment
    seed: int = 7


def _rewritten(text: str, kind: str, draw: np.random.Generator) -> Iterator[tuple[str, bool]]:
    """Other ways to write a span of ``kind``, and whether they still are one."""
    digits = _only_digits(text)
    if kind == "email":
        at, dot = draw.choice(["(at)", "[at]", " (at) ", " [at] "]), draw.choice(
            [".", "[dot]", " [dot] ", "(dot)"])
        local, _, domain = text.partition("@")
        yield local + at + domain.replace(".", dot), True
        yield text.partition(".")[0].replace("@", "") + "@", False
        yield "@" + domain, False
    elif kind == "ip":
        yield text.replace(".", draw.choice(["[.]", "[dot]", "(.)"])), True
        yield ".".join(str(300 + int(draw.integers(600))) for _ in range(4)), False
        yield text.rpartition(".")[0], False
        yield text + "." + str(draw.integers(256)), False
    elif kind == "card":
        mark = draw.choice([".", "/", "-", " "])
        yield mark.join(digits[i:i + 4] for i in range(0, len(digits), 4)), True
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + int(draw.integers(9))) % 10)
        yield wrong, False
        yield "-".join(wrong[i:i + 4] for i in range(0, len(wrong), 4)), False
    else:
        mark = draw.choice(["-", ".", "/", " "])
        if len(digits) > 10:
            yield mark.join([digits[:-10], digits[-10:-7], digits[-7:-4], digits[-4:]]), True
            yield f"{digits[:-10]} ({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", True
        yield digits, False
        yield digits[:3] + "-" + digits[3:7], False
        yield "/".join([digits[:4], digits[4:6], digits[6:8], digits[:2]]), False
        yield ",".join([digits[:1], digits[1:4], digits[4:7], digits[7:10]]), False


def training_texts(samples: list[str], training: Training) -> list[tuple[str, list[Span]]]:
    """Texts with their spans: the samples as the patterns see them, and rewritten copies."""
    draw = np.random.default_rng(training.seed)
    out = []
    for text in samples:
        spans = pattern_spans(text)
        out.append((text, spans))
        for kind, start, end in spans:
            left, right = text[max(0, start - 12):start], text[end:end + 12]
            for body, good in _rewritten(text[start:end], kind, draw):
                again = left + body + right
                here = [(kind, len(left), len(left) + len(body))] if good else []
                out.append((again, here))
    return out


def fit(texts: list[tuple[str, list[Span]]], training: Training = Training()) -> Field:
    """Maximum likelihood by stochastic gradient steps with averaged weights."""
    field_ = Field({kind: training.start for kind in KINDS})
    examples = []
    for text, spans in texts:
        wanted = set(spans)
        for begin, end in zones(text):
            zone = zone_of(text, begin, end)
            if not zone.segments:
                continue
            gold = {(i, j, kind) for j, found in zone.segments.items() for i, kind, _ in found
                    if (kind, zone.cuts[i], zone.cuts[j]) in wanted}
            examples.append((zone, gold))
    draw = np.random.default_rng(training.seed)
    weights, total, steps = field_.weights, {}, 0
    for epoch in range(training.epochs):
        rate = training.rate / (1 + 0.3 * epoch)
        for number in draw.permutation(len(examples)):
            zone, gold = examples[number]
            chance = field_.marginals(zone)
            for j, found in zone.segments.items():
                for i, kind, features in found:
                    push = ((i, j, kind) in gold) - chance[i, j, kind]
                    if abs(push) > 1e-4:
                        for name in features:
                            weights[name] = weights.get(name, 0.0) * (
                                1 - rate * training.decay) + rate * push
        if 2 * epoch >= training.epochs:
            steps += 1
            for name, value in weights.items():
                total[name] = total.get(name, 0.0) + value
    return Field({name: value / steps for name, value in total.items()} if steps else weights)


def find_spans(text: str, field_: Field) -> list[tuple[str, int, int, bool]]:
    """All spans by kind and start; the last item says whether a pattern gave it."""
    if not text or not _TRIGGER.search(text):
        return []
    base = pattern_spans(text)
    found = [(*span, True) for span in base]
    taken = sorted((start, end) for _, start, end in base)
    starts = [start for start, _ in taken]
    for begin, end in zones(text):
        # Spans of one kind do not overlap, so at most one of each kind begins before the zone and reaches it.
        lowest, highest = bisect.bisect_left(starts, begin), bisect.bisect_left(starts, end)
        inside = taken[max(0, lowest - len(KINDS)):highest]
        if inside and inside[0][0] <= begin and max(e for _, e in inside) >= end:
            continue  # a pattern covers the zone
        zone = zone_of(text, begin, end)
        if not zone.segments:
            continue
        for kind, start, stop in field_.best(zone):
            if not any(a < stop and start < b for a, b in inside):
                found.append((kind, start, stop, False))
    return sorted(found, key=lambda span: (KINDS.index(span[0]), span[1]))


def learn(docs: DataFrame, training: Training = Training()) -> Field:
    """Fit the field on zones of ``text`` in which the patterns find something.

    Every kind gives the same share of ``training_zones``, distinct zones with the smallest hashes.
    A task passes on that many of a kind at most, so neither a long document nor a frequent kind
    fills the sample, and the driver gets ``training_zones`` rows whatever the input.
    """
    quota = max(1, training.training_zones // len(KINDS))
    found = (
        docs.select(F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
        .mapInArrow(functools.partial(_zone_rows, quota=quota, seed=training.seed),
                    "kind string, o bigint, zone string").dropDuplicates(["kind", "o"]))
    turn = F.row_number().over(Window.partitionBy("kind").orderBy("o"))
    sample = found.withColumn("turn", turn).where(F.col("turn") <= quota).select("kind", "o", "zone")
    zones_ = [row.zone for row in sorted(sample.collect(), key=lambda row: (row.o, row.kind))]
    return fit(training_texts(list(dict.fromkeys(zones_)), training), training)


def _zone_rows(batches: Iterator[pa.RecordBatch], quota: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Short cuts of the text around pattern spans, at most 400 characters each: per kind the
    ``quota`` distinct ones with the smallest hashes of a task."""
    held: dict[str, dict[int, str]] = {kind: {} for kind in KINDS}
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for kind, start, end in pattern_spans(text or ""):
                if end - start <= 200:
                    zone = text[max(0, start - 100):end + 100]
                    order = xxhash.xxh64_intdigest(zone.encode("utf-8", "replace"), seed) - (1 << 63)
                    held[kind][order] = zone
                    if len(held[kind]) > 4 * quota:
                        held[kind] = {o: held[kind][o] for o in sorted(held[kind])[:quota]}
    rows = [(kind, o, zones_[o]) for kind, zones_ in held.items() for o in sorted(zones_)[:quota]]
    kinds, orders, texts = zip(*rows) if rows else ((), (), ())
    yield pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.string()), pa.array(orders, pa.int64()), pa.array(texts, pa.string())],
        names=["kind", "o", "zone"])


def spans(field_: Field, text: str | Column = "text") -> Column:
    """The spans of a text column: an array of (kind, start, end, base)."""
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                      ("base", pa.bool_())])
    kind = T.ArrayType(T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        names = ("kind", "start", "end", "base")
        return pa.array(
            [[dict(zip(names, span)) for span in find_spans(value.as_py() or "", field_)]
             for value in texts], pa.list_(item))

    return run((F.col(text) if isinstance(text, str) else text).cast("string"))


def span_table(docs: DataFrame, training: Training = Training()) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans, n_added."""
    found = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        spans(learn(docs, training)).alias("found"))

    def joined(of: Column) -> Column:
        return F.array_join(F.transform(of, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(kind: str) -> Column:
        return F.filter(base, lambda s: s["kind"] == kind)

    base = F.filter("found", lambda s: s["base"])
    return found.select(
        "doc_id", *[F.size(of_kind(kind)).cast("bigint").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
        (F.size("found") - F.size(base)).cast("bigint").alias("n_added"))


def redacted(text: str, found: list[tuple[str, int, int, bool]]) -> str:
    """``text`` with its spans replaced by their kind in brackets; overlapping ones by one."""
    out, done = [], 0
    for start, end, kind in sorted((s[1], -s[2], s[0]) for s in found):
        end = -end
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(field_: Field, text: str | Column = "text") -> Column:
    """A text column without its personal data; NULL stays NULL."""

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts:
            value = value.as_py()
            found = find_spans(value or "", field_)
            out.append(redacted(value, found) if found else value)
        return pa.array(out, pa.string())

    return run((F.col(text) if isinstance(text, str) else text).cast("string"))
