"""Rows chosen by their rank in an order, without sorting or storing the table.

The columns of the order are read as digits: whole numbers that keep the order (a number is one digit,
a text one per seven bytes), with a hash of the whole row as the last one, so rows that tie in the
order still have ranks of their own. A histogram over ranges of the first digit says which ranks fall
into which range. Only ranges that a rank rule cuts through and that hold many rows are looked at
again: by narrower ranges, and by the next digit once the first has a single value. Every pass reads
the columns of the order; what comes to the driver is at most ``buckets`` counts a pass.

In the end a range is taken whole, left out, or small enough to be put in order by one task. Rows that
agree in every column are interchangeable, so a large run of them is counted, not ordered: as many
copies are given back as the rule wants.

NULL is smaller than every value, NaN larger than every number. Texts are ordered by their bytes.
Columns that have no digits here (nested ones, decimals of more than 18 places) are ordered inside a
task, however many rows tie before them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CHUNK = 7
_NODE, _STATE, _START, _HASH = "_rank_node", "_rank_state", "_rank_start", "_rank_hash"
_ALL, _NONE, _SORT, _EQUAL = "all", "none", "sort", "equal"


@dataclass(frozen=True)
class RankRule:
    """Which ranks are wanted: of one rank, how many in [start, start + count), and of a whole range."""

    keep: Callable[[Column], Column]
    kept: Callable[[Column, Column], Column]
    whole: Callable[[int, int], bool | None]  # all of a range, none of it, or some (None)


def first(n: int) -> RankRule:
    return RankRule(
        lambda rank: rank < n,
        lambda start, count: F.greatest(F.least(start + count, F.lit(n)) - start, F.lit(0)),
        lambda start, count: True if start + count <= n else False if start >= n else None)


def every(stride: int) -> RankRule:
    def up_to(end: Column) -> Column:
        return F.floor((end + (stride - 1)) / stride).cast("bigint")

    return RankRule(
        lambda rank: rank % stride == 0,
        lambda start, count: up_to(start + count) - up_to(start),
        lambda start, count: False if -(-start // stride) * stride >= start + count else (
            True if stride == 1 else None))


@dataclass(frozen=True)
class _Step:
    """One digit: its column in the order and, for texts and doubles, which part of the value."""

    column: int
    part: int = 0


@dataclass
class _Node:
    number: int
    start: int
    count: int
    step: _Step
    low: float | None = None     # least and greatest digit, if known
    high: float | None = None
    state: str | None = None     # of a node that is not split any more


@dataclass
class _Search:
    df: DataFrame
    order_by: Sequence[str]
    rule: RankRule
    leaf_rows: int
    buckets: int
    levels: list[tuple[DataFrame, DataFrame, list[_Step]]] = field(default_factory=list)
    leaves: list[_Node] = field(default_factory=list)
    nodes: int = 1

    def __post_init__(self):
        schema = self.df.schema
        self.kinds = [_kind(schema[c].dataType) for c in self.order_by] + ["long"]
        self.hashed = [f.name for f in schema.fields if not _unhashable(f.dataType)]
        self.groupable = len(self.hashed) == len(schema.fields)

    # -- digits -----------------------------------------------------------------------------------
    def digit(self, step: _Step) -> Column:
        """A bigint, or a double for the value of a double; NULL where the column is."""
        if step.column == len(self.order_by):
            return F.xxhash64(*[F.col(f"`{c}`") for c in self.hashed])
        name = self.order_by[step.column]
        column, kind = F.col(name), self.kinds[step.column]
        if kind == "text":
            raw = F.substring(column.cast("binary"), _CHUNK * step.part + 1, _CHUNK)
            return F.conv(F.rpad(F.hex(raw), 2 * _CHUNK, "0"), 16, 10).cast("bigint") * 8 + F.octet_length(raw)
        if kind == "double":
            value = column.cast("double")
            if step.part == 1:
                return value
            infinite = F.lit(math.inf)
            return F.when(F.isnan(value), 3).when(value == infinite, 2).when(value == -infinite, 0).when(
                value.isNotNull(), 1).cast("bigint")
        return _whole(column, self.df.schema[name].dataType)

    def is_double(self, step: _Step) -> bool:
        return step.column < len(self.order_by) and self.kinds[step.column] == "double" and step.part == 1

    def after(self, step: _Step, value: int | float | None) -> _Step | None:
        """The next digit of rows that have one value in this one; None where there is none."""
        if step.column == len(self.order_by):
            return None
        kind = self.kinds[step.column]
        if value is not None and kind == "text" and value % 8 == _CHUNK:
            return _Step(step.column, step.part + 1)
        if value is not None and kind == "double" and step.part == 0 and value == 1:
            return _Step(step.column, 1)
        return _Step(step.column + 1)

    # -- passes -----------------------------------------------------------------------------------
    def located(self) -> DataFrame:
        """The rows with the node they are in."""
        rows = self.df.withColumn(_NODE, F.lit(0).cast("bigint"))
        for ranges, children, steps in self.levels:
            rows = self._bucketed(rows, ranges, steps).join(
                F.broadcast(children), (F.col(_NODE) == F.col("_of")) & (F.col("_bucket") == F.col("_in")),
                "left").withColumn(_NODE, F.coalesce("_child", _NODE)).drop("_of", "_in", "_child", "_bucket")
        return rows

    def _bucketed(self, rows: DataFrame, ranges: DataFrame, steps: list[_Step]) -> DataFrame:
        """Adds ``_bucket``; -1 for NULL digits, NULL for rows of other nodes."""
        rows = rows.join(F.broadcast(ranges), F.col(_NODE) == F.col("_at"), "left")
        parts = []
        for i, step in enumerate(steps):
            digit = self.digit(step)
            if self.is_double(step):
                bucket = F.least(F.col("_fan") - 1, F.floor((digit / 2 - F.col("_low")) / F.col("_width")))
            else:
                bucket = F.call_function("shiftright", digit, F.col("_shift")) - F.col("_base")
            parts.append((F.col("_step") == i, F.coalesce(bucket.cast("bigint"), F.lit(-1).cast("bigint"))))
        chosen = reduce(lambda held, part: held.when(*part), parts[1:], F.when(*parts[0]))
        return rows.withColumn("_bucket", chosen).drop("_at", "_step", "_shift", "_base", "_low", "_width", "_fan")

    def run(self) -> list[_Node]:
        pending = [_Node(0, 0, self.df.count(), _Step(0))]
        self.leaf_rows = max(self.leaf_rows, 4 * pending[0].count // self.buckets)
        while pending:
            pending = self._measured(pending)
            pending = self._split(pending) if pending else []
        return self.leaves

    def _measured(self, nodes: list[_Node]) -> list[_Node]:
        """Give nodes the range of their digit, moving on to later digits until one has two values."""
        ready = []
        while nodes:
            unknown = [node for node in nodes if node.low is None]
            ready += [node for node in nodes if node.low is not None]
            unknown = [node for node in unknown if not self._closed(node)]
            if not unknown:
                return ready
            nodes = []
            rows = self.located()
            if len(self.levels):
                rows = rows.where(F.col(_NODE).isin([node.number for node in unknown])) if len(unknown) <= 64 \
                    else rows.join(F.broadcast(_table(rows, _of=[n.number for n in unknown])),
                                   F.col(_NODE) == F.col("_of"), "left_semi")
            steps = sorted({node.step for node in unknown}, key=lambda s: (s.column, s.part))
            columns = []
            for i, step in enumerate(steps):
                digit = self.digit(step)
                columns += [F.min(digit).alias(f"low{i}"), F.max(digit).alias(f"high{i}"),
                            F.count(digit).alias(f"known{i}")]
            found = {row[_NODE]: row for row in rows.groupBy(_NODE).agg(
                F.count(F.lit(1)).alias("rows"), *columns).collect()}
            for node in unknown:
                row, i = found.get(node.number), steps.index(node.step)
                node.count = row["rows"] if row else 0
                if self._closed(node):
                    continue
                low, high, known = row[f"low{i}"], row[f"high{i}"], row[f"known{i}"]
                if known == 0 or (low == high and known == node.count):
                    node.step = self.after(node.step, low if known else None)
                    nodes.append(node)
                else:
                    node.low, node.high = low, high
                    ready.append(node)
        return ready

    def _closed(self, node: _Node) -> bool:
        """Whether the node needs no more splitting; it is a leaf then."""
        whole = self.rule.whole(node.start, node.count) if node.count else False
        if whole is not None:
            node.state = _ALL if whole else _NONE
        elif node.count <= self.leaf_rows:
            node.state = _SORT
        elif node.step is None:
            node.state = _EQUAL if self.groupable else _SORT
        elif node.step.column < len(self.kinds) and self.kinds[node.step.column] is None:
            node.state = _SORT
        else:
            return False
        self.leaves.append(node)
        return True

    def _split(self, nodes: list[_Node]) -> list[_Node]:
        """One histogram over all nodes; its ranges become leaves or nodes to go on with."""
        fan = max(2, self.buckets // len(nodes))
        steps = sorted({node.step for node in nodes}, key=lambda s: (s.column, s.part))
        lines = []
        for node in nodes:
            shift, base, low, width = 0, 0, 0.0, 1.0
            if self.is_double(node.step):
                low = node.low / 2
                width = (node.high / 2 - low) / fan
                if width == 0:  # neighbours among the smallest doubles: ordered inside a task
                    node.state = _SORT
                    self.leaves.append(node)
                    continue
            else:
                while (node.high >> shift) - (node.low >> shift) >= fan:
                    shift += 1
                base = node.low >> shift
            lines.append((node.number, steps.index(node.step), shift, base, low, width, fan))
        if not lines:
            return []
        names = ["_at", "_step", "_shift", "_base", "_low", "_width", "_fan"]
        ranges = _table(self.df, **dict(zip(names, map(list, zip(*lines))))).withColumn(
            "_shift", F.col("_shift").cast("int"))
        rows = self._bucketed(self.located(), ranges, steps).where("_bucket is not null")
        whole = [F.when(self._at(step, i, nodes), self.digit(step)) for i, step in enumerate(steps)
                 if not self.is_double(step)]
        real = [F.when(self._at(step, i, nodes), self.digit(step)) for i, step in enumerate(steps)
                if self.is_double(step)]
        nothing = F.lit(None)
        parts = rows.groupBy(_NODE, "_bucket").agg(
            F.count(F.lit(1)).alias("rows"),
            *[agg(F.coalesce(nothing.cast(kind), *some)).alias(name) for name, agg, kind, some in (
                ("low", F.min, "bigint", whole), ("high", F.max, "bigint", whole),
                ("dlow", F.min, "double", real), ("dhigh", F.max, "double", real))]).collect()
        by_node: dict[int, list] = {}
        for part in sorted(parts, key=lambda part: (part[_NODE], part["_bucket"])):
            by_node.setdefault(part[_NODE], []).append(part)
        children, going = [], []
        for node in nodes:
            if node.state is None:
                going += self._children(node, by_node.get(node.number, []), children)
        self.levels.append((ranges, _table(
            self.df, _of=[c[0] for c in children], _in=[c[1] for c in children],
            _child=[c[2] for c in children]), steps))
        return going

    def _at(self, step: _Step, i: int, nodes: list[_Node]) -> Column:
        mine = [node.number for node in nodes if node.step == step]
        return F.lit(True) if len(mine) == len(nodes) else F.col(_NODE).isin(mine)

    def _children(self, node: _Node, parts: list, children: list) -> list[_Node]:
        going, start, last = [], node.start, None
        for part in parts:
            null = part["_bucket"] == -1
            real = self.is_double(node.step)
            low, high = (part["dlow"], part["dhigh"]) if real else (part["low"], part["high"])
            child = _Node(self.nodes, start, part["rows"], node.step)
            start += part["rows"]
            whole = self.rule.whole(child.start, child.count)
            small = whole is None and child.count <= self.leaf_rows
            state = _SORT if small else None if whole is None else _ALL if whole else _NONE
            joined = last is not None and state is not None and last.state == state and (
                state != _SORT or last.count + child.count <= self.leaf_rows)
            if joined:
                last.count += child.count
                children.append((node.number, part["_bucket"], last.number))
                continue
            self.nodes += 1
            children.append((node.number, part["_bucket"], child.number))
            last = child
            if state is not None:
                child.state = state
                self.leaves.append(child)
                continue
            if null or low == high:
                child.step = self.after(node.step, None if null else low)
                if self._closed(child):
                    continue
            else:
                child.low, child.high = low, high
            going.append(child)
        return going

    # -- rows -------------------------------------------------------------------------------------
    def rows(self) -> DataFrame:
        leaves = self.run()
        states = {leaf.state for leaf in leaves}
        names = self.df.columns
        found = _table(self.df, _of=[leaf.number for leaf in leaves],
                       **{_STATE: [leaf.state for leaf in leaves], _START: [leaf.start for leaf in leaves]})
        located = self.located().join(F.broadcast(found), F.col(_NODE) == F.col("_of"), "inner").drop("_of")
        out = []
        if _ALL in states:
            out.append(located.where(F.col(_STATE) == _ALL).select(*names))
        if _SORT in states:
            order = Window.partitionBy(_NODE).orderBy(*self.order_by, _HASH)
            ranked = located.where(F.col(_STATE) == _SORT).withColumn(
                _HASH, F.xxhash64(*[F.col(f"`{c}`") for c in self.hashed])).withColumn(
                "_rank", F.col(_START) + F.row_number().over(order) - 1)
            out.append(ranked.where(self.rule.keep(F.col("_rank"))).select(*names))
        if _EQUAL in states:
            same = located.where(F.col(_STATE) == _EQUAL).groupBy(_NODE, _START, *names).agg(
                F.count(F.lit(1)).alias("_copies"))
            # Rows of one node agree in all digits: one line, or a few whose hashes are equal.
            order = Window.partitionBy(_NODE).orderBy(*self.order_by, *[c for c in names if c not in self.order_by])
            begin = F.col(_START) + F.sum("_copies").over(order) - F.col("_copies")
            same = same.withColumn("_kept", self.rule.kept(begin, F.col("_copies"))).where("_kept > 0")
            out.append(same.select(
                *names, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_kept"))).alias("_copy")).drop("_copy"))
        return reduce(DataFrame.unionByName, out) if out else self.df.limit(0)


def select_ranks(
    df: DataFrame, order_by: Sequence[str], rule: RankRule, leaf_rows: int = 1 << 16,
    buckets: int = 1 << 16,
) -> DataFrame:
    """The rows of the ranks that ``rule`` wants, in no order. Reads ``df`` several times.

    A range that one task orders has at most ``leaf_rows`` rows, or four times the average range of a
    table with more than ``leaf_rows * buckets / 4``.
    """
    return _Search(df, list(order_by), rule, leaf_rows, buckets).rows()


def _kind(dtype: T.DataType) -> str | None:
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return "text"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(dtype, T.DecimalType):
        return "long" if dtype.precision <= 18 else None
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType, T.TimestampType)
    return "long" if isinstance(dtype, whole) else None


def _whole(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DateType):
        return F.unix_date(column).cast("bigint")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(dtype, T.DecimalType):
        return (column * F.lit(10 ** dtype.scale).cast("decimal(19,0)")).cast("bigint")
    return column.cast("bigint")


def _unhashable(dtype: T.DataType) -> bool:
    return any(word in dtype.simpleString() for word in ("map<", "variant"))


def _table(like: DataFrame, **columns: list) -> DataFrame:
    """A small table from the driver; at most ``buckets`` rows."""
    return like.sparkSession.createDataFrame(pa.table({
        name: pa.array(values, pa.string() if values and isinstance(values[0], str) else
                       pa.float64() if values and isinstance(values[0], float) else pa.int64())
        for name, values in columns.items()}))
