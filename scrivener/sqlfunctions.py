"""Ordered operators as table functions, so that SQL can call them: ``SELECT * FROM fill_down(TABLE(t), 'value', 'at', 'key')``.

Each has an analysis step: it checks its arguments against the table's columns, gives the
result's schema (the table's columns and what is added, with their types), and asks Spark
to partition and sort the table, so a call is a shuffle by key and one pass over sorted rows.

That pass is a Python call a row. :func:`declare` gives ``fill_down`` and ``islands`` a form for one table's
columns that takes Arrow batches of many keys instead: Spark's functions on batches cannot analyze, so the step runs there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import localcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import arrow_udtf, udtf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, MapType, NumericType, StringType, StructType, TimestampType, VariantType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from .operators.ladder import Ladder


def _text(name: str, arg: AnalyzeArgument) -> str:
    if not arg.isConstantExpression or not isinstance(arg.value, str) or not arg.value:
        raise ValueError(f"{name} must be a constant text")
    return arg.value


def _checked(table: AnalyzeArgument, **arguments: AnalyzeArgument) -> tuple[StructType, dict[str, str]]:
    """The table's schema and the columns that arguments name."""
    if not table.isTable:
        raise ValueError("the first argument must be TABLE(...)")
    schema, names = table.dataType, {k: _text(k, v) for k, v in arguments.items()}
    for name in (c.strip() for v in names.values() for c in v.split(",")):
        if name not in schema.names:
            raise ValueError(f"no column {name} among {schema.names}")
    return StructType(list(schema.fields)), names


def _result(schema: StructType, key: str, order: str, *added: tuple[str, object]) -> AnalyzeResult:
    for name, kind in added:
        if name in schema.names:
            raise ValueError(f"the table has a column {name}")
        schema = schema.add(name, kind)
    return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(c.strip()) for c in key.split(",")], orderBy=[OrderingColumn(c.strip()) for c in order.split(",")])


class FillDown:
    """Adds ``filled``: the row's value, or where that is null the nearest earlier one of its key."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, value: AnalyzeArgument, sort: AnalyzeArgument, key: AnalyzeArgument) -> AnalyzeResult:
        schema, names = _checked(rows, value=value, sort=sort, key=key)
        return _result(schema, names["key"], names["sort"], ("filled", schema[names["value"]].dataType))

    def __init__(self):
        self.last = None

    def eval(self, rows: Row, value: str, sort: str, key: str) -> Iterator[tuple]:
        if rows[value] is not None:
            self.last = rows[value]
        yield (*rows, self.last)


class Islands:
    """Adds ``island``: numbers the runs of rows of a key whose successive order values are at most ``gap`` apart."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, sort: AnalyzeArgument, gap: AnalyzeArgument, key: AnalyzeArgument) -> AnalyzeResult:
        schema, names = _checked(rows, sort=sort, key=key)
        if not isinstance(schema[names["sort"]].dataType, NumericType):
            raise ValueError(f"{names['sort']} is no number")
        if not gap.isConstantExpression or gap.value is None or gap.value < 0:
            raise ValueError("gap must be a constant of 0 or more")
        return _result(schema, names["key"], names["sort"], ("island", LongType()))

    def __init__(self):
        self.before, self.island = None, 0

    def eval(self, rows: Row, sort: str, gap, key: str) -> Iterator[tuple]:
        at = rows[sort]
        if self.before is None or at is None or at - self.before > gap:
            self.island += 1
        self.before = at
        yield (*rows, self.island)


class SignInLadder:
    """Adds ``outcome``, ``attempts_left`` and ``lock_seconds`` of each sign-in attempt under the usual ladder."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, sort: AnalyzeArgument, right: AnalyzeArgument, key: AnalyzeArgument) -> AnalyzeResult:
        schema, names = _checked(rows, sort=sort, right=right, key=key)
        first = schema[names["sort"].split(",")[0].strip()].dataType
        if not isinstance(first, TimestampType):
            raise ValueError("attempts are sorted by a timestamp first")
        if not isinstance(schema[names["right"]].dataType, BooleanType):
            raise ValueError(f"{names['right']} is neither true nor false")
        return _result(schema, names["key"], names["sort"], ("outcome", StringType()), ("attempts_left", IntegerType()), ("lock_seconds", LongType()))

    def __init__(self):
        self.ladder, self.state = Ladder(), None

    def eval(self, rows: Row, sort: str, right: str, key: str) -> Iterator[tuple]:
        from calendar import timegm

        at = rows[sort.split(",")[0].strip()]
        if at is None or rows[key.split(",")[0].strip()] is None:
            yield (*rows, "right" if rows[right] else "wrong", self.ladder.per_lock, 0)
            return
        now = int(at.timestamp()) * 1_000_000 + at.microsecond if at.tzinfo else timegm(at.timetuple()) * 1_000_000 + at.microsecond
        self.state, *said = self.ladder.attempt(self.state, now, bool(rows[right]))
        yield (*rows, *said)


FUNCTIONS = {"fill_down": FillDown, "islands": Islands, "sign_in_ladder": SignInLadder}


class _Batches:
    """A handler on Arrow batches of many keys, each key's rows side by side and sorted. The row before a batch is kept."""

    keys: list[str]
    names: tuple

    def __init__(self):
        self.row = None

    def _after(self, rows: pa.RecordBatch, column: str) -> pa.Array:
        """A column behind its value in the row before the batch (null at first)."""
        before = pa.nulls(1, rows[column].type) if self.row is None else self.row[column]
        return pa.concat_arrays([before, rows[column]])

    def _first(self, rows: pa.RecordBatch) -> np.ndarray:
        """Which rows are the first of their key; as in SQL, nulls are one key and NaN is another."""
        first = np.zeros(rows.num_rows, bool)
        first[0] = self.row is None
        for key in self.keys:
            both = self._after(rows, key)
            before, now = both[:-1], both[1:]
            differ = pc.not_equal(before, now)
            if pa.types.is_floating(now.type):
                differ = pc.and_(differ, pc.invert(pc.and_(pc.is_nan(before), pc.is_nan(now))))
            first |= pc.coalesce(differ, pc.xor(before.is_null(), now.is_null())).to_numpy(zero_copy_only=False)
        return first

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if rows.num_rows:
            added = self.added(rows, self._first(rows))
            self.row = rows.slice(rows.num_rows - 1)
            yield pa.RecordBatch.from_arrays([*rows.columns, added], names=[*rows.schema.names, self.name])


class FillDownBatches(_Batches):
    """:class:`FillDown` by the place of the last value before each row."""

    name, last = "filled", None

    def added(self, rows: pa.RecordBatch, first: np.ndarray) -> pa.Array:
        value = rows[self.names[0]]
        values = pa.concat_arrays([pa.nulls(1, value.type) if self.last is None else self.last, value])
        place = np.arange(len(values))
        found = np.maximum.accumulate(np.where(values.is_valid().to_numpy(zero_copy_only=False), place, 0))[1:]
        start = np.maximum.accumulate(np.where(first, place[1:], 0))
        filled = values.take(pa.array(found, mask=found < start))
        self.last = filled[-1:]
        return filled


class IslandsBatches(_Batches):
    """:class:`Islands` by running sums of the rows that begin one."""

    name, island = "island", 0

    def added(self, rows: pa.RecordBatch, first: np.ndarray) -> pa.Array:
        sort, gap, _ = self.names
        both = self._after(rows, sort)
        unknown = both.is_null().to_numpy(zero_copy_only=False)
        new = first | unknown[1:] | unknown[:-1]
        at = pc.fill_null(both, pa.scalar(0, both.type)).to_numpy(zero_copy_only=False)
        if pa.types.is_integer(both.type):
            # Rows of a key ascend, so their differences are exact as unsigned numbers.
            new |= np.diff(at.astype(np.int64).view(np.uint64)) > np.uint64(math.floor(min(gap, 2**64 - 1)))
        elif pa.types.is_floating(both.type):
            least = float(gap)
            least = math.nextafter(least, -math.inf) if least > gap else least
            with np.errstate(invalid="ignore", over="ignore"):
                new |= np.diff(at.astype(np.float64)) > least
        else:
            with localcontext(prec=40):
                new |= (np.diff(at) > gap).astype(bool)
        run = self.island + np.cumsum(new, dtype=np.int64)
        island = run - np.maximum.accumulate(np.where(first, run - 1, 0))
        self.island = int(island[-1])
        return pa.array(island)


BATCHES = {"fill_down": FillDownBatches, "islands": IslandsBatches}
#: Parts of keys that a declared function's rows are dealt out to.
PARTS = 1024


def declare(spark: SparkSession, name: str, function: str, view: str, *arguments) -> str:
    """Makes ``name`` known to SQL as one of :data:`BATCHES` for a view's columns; returns the text of its call.

    ``arguments`` are those of the function after its table: ``declare(spark, "filled", "fill_down", "t", "value", "at", "key")``.
    """
    schema = spark.table(view).schema
    said = FUNCTIONS[function].analyze(AnalyzeArgument(schema, None, True, False), *(AnalyzeArgument(StringType(), a, False, True) for a in arguments))
    keys, sort = [c.name for c in said.partitionBy], [c.name for c in said.orderBy]
    for key in keys:
        kind = schema[key].dataType
        if isinstance(kind, (ArrayType, MapType, StructType, VariantType)) or isinstance(kind, StringType) and not kind.isUTF8BinaryCollation():
            raise ValueError(f"{key} is no key of plain values")
    handler = type(BATCHES[function].__name__, (BATCHES[function],), {"keys": keys, "names": arguments})
    spark.udtf.register(name, arrow_udtf(handler, returnType=said.schema))
    quoted = ["`" + c.replace("`", "``") + "`" for c in (*keys, *sort)]
    return f"{name}(TABLE({view}) PARTITION BY pmod(hash({', '.join(quoted[: len(keys)])}), {PARTS}) ORDER BY ({', '.join(quoted)}))"


def register(spark: SparkSession) -> None:
    """Makes :data:`FUNCTIONS` known to the session's SQL."""
    for name, handler in FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler))
