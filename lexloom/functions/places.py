"""The place of a word in a corpus, (order…, pos), as one value that an aggregation can keep the least of.

Structs cannot be updated in place, so a minimum over them would make Spark sort all occurrences. A number per
place keeps the aggregation hash-based: a bigint, which also takes Spark's fastest hash map, or a wide decimal.
All classes offer `row`, to be computed before a row's words are exploded, `least`, the aggregate over words, and
`struct`, which turns the result back into the order columns and `pos`. In all of them a null order column comes
before every value, as it does in a sort, so the least place does not depend on a column's type.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
POS_BITS = 31
LONG_BITS = 63
DECIMAL_BITS = 127
DECIMAL = "decimal(38,0)"


class StructPlaces:
    """Any order columns; aggregated by sorting."""

    def __init__(self, order: Sequence[str]) -> None:
        self.order = list(order)

    def row(self) -> Column:
        return F.struct(*self.order)

    def least(self, row: Column, pos: Column) -> Column:
        return F.min(F.struct(row.alias("row"), pos.alias("pos")))

    def struct(self, place: Column) -> Column:
        row = place.getField("row")
        fields = [row.getField(name).alias(name) for name in self.order]
        return F.struct(*fields, place.getField("pos").alias("pos"))


class DecimalPlaces:
    """Integer order columns of up to 96 bits, as digits of a number; each has one digit more than values, for null."""

    def __init__(self, order: Sequence[str], types: Sequence[T.DataType]) -> None:
        self.order = list(order)
        self.types = list(types)
        self.bits = [INTEGER_BITS[type(dtype)] for dtype in types]

    @staticmethod
    def _num(value: Column | int) -> Column:
        return (F.lit(Decimal(value)) if isinstance(value, int) else value).cast(DECIMAL)

    def row(self) -> Column:
        # The first column keeps its sign, so that the number stays within a decimal; null is one below its least value.
        value = F.coalesce(self._num(F.col(self.order[0])), self._num(-(1 << (self.bits[0] - 1)) - 1))
        for name, bits in list(zip(self.order, self.bits))[1:]:
            digit = F.coalesce(self._num(F.col(name)) + self._num((1 << (bits - 1)) + 1), self._num(0)).cast(DECIMAL)
            value = ((value * self._num((1 << bits) + 1)).cast(DECIMAL) + digit).cast(DECIMAL)
        return (value * self._num(1 << POS_BITS)).cast(DECIMAL)

    def least(self, row: Column, pos: Column) -> Column:
        return F.min((row + self._num(pos)).cast(DECIMAL))

    def _split(self, value: Column, base: int) -> tuple[Column, Column]:
        """The digits above the last, and the last."""
        low = F.pmod(value, self._num(base))
        return ((value - low) / F.lit(Decimal(base))).cast(DECIMAL), low

    def struct(self, place: Column) -> Column:
        rest, pos = self._split(place, 1 << POS_BITS)
        fields = [pos.cast("int").alias("pos")]
        for name, dtype, bits in list(zip(self.order, self.types, self.bits))[:0:-1]:
            rest, digit = self._split(rest, (1 << bits) + 1)
            value = F.when(digit > 0, digit - self._num((1 << (bits - 1)) + 1))
            fields.insert(0, value.cast(dtype).alias(name))
        first = F.when(rest >= self._num(-(1 << (self.bits[0] - 1))), rest)
        return F.struct(first.cast(self.types[0]).alias(self.order[0]), *fields)


class LongPlaces:
    """Integer order columns whose values, counted from 1 at `starts`, fit 63 bits together with a position; 0 is null.

    `holds` is checked for every row, so that a corpus that changes after it was measured fails the job.
    """

    def __init__(
        self,
        order: Sequence[str],
        types: Sequence[T.DataType],
        starts: Sequence[int],
        bits: Sequence[int],
        pos_bits: int,
        holds: Column | None = None,
    ) -> None:
        self.order, self.types, self.starts, self.bits = list(order), list(types), list(starts), list(bits)
        self.pos_bits = pos_bits
        self.holds = holds

    def row(self) -> Column:
        value = F.lit(0).cast("bigint")
        for name, start, bits in zip(self.order, self.starts, self.bits):
            part = F.coalesce(F.col(name).cast("bigint") - F.lit(start - 1).cast("bigint"), F.lit(0).cast("bigint"))
            value = F.shiftleft(value, bits).bitwiseOR(part)
        value = F.shiftleft(value, self.pos_bits)
        if self.holds is None:
            return value
        changed = F.raise_error("the corpus changed after its order columns were measured").cast("bigint")
        return F.when(F.coalesce(self.holds, F.lit(True)), value).otherwise(changed)

    def least(self, row: Column, pos: Column) -> Column:
        return F.min(row.bitwiseOR(pos.cast("bigint")))

    def struct(self, place: Column) -> Column:
        fields = [place.bitwiseAND(F.lit((1 << self.pos_bits) - 1)).cast("int").alias("pos")]
        place = F.shiftrightunsigned(place, self.pos_bits)
        for name, dtype, start, bits in list(zip(self.order, self.types, self.starts, self.bits))[::-1]:
            part = place.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
            value = F.when(part > 0, part + F.lit(start - 1).cast("bigint"))
            fields.insert(0, value.cast(dtype).alias(name))
            place = F.shiftrightunsigned(place, bits)
        return F.struct(*fields)


Places = StructPlaces | DecimalPlaces | LongPlaces


def places_by_type(df: DataFrame, order: Sequence[str]) -> Places:
    """The best form that the order columns' types allow for."""
    types = [df.schema[name].dataType for name in order]
    bits = [INTEGER_BITS.get(type(dtype), DECIMAL_BITS) for dtype in types]
    if sum(bits) + len(bits) + POS_BITS <= LONG_BITS:
        return LongPlaces(order, types, [-(1 << (n - 1)) for n in bits], [n + 1 for n in bits], POS_BITS)
    return DecimalPlaces(order, types) if sum(bits) + POS_BITS <= DECIMAL_BITS else StructPlaces(order)


def _ranges(df: DataFrame, order: Sequence[str]) -> list[tuple[int, int]]:
    """The least and the greatest value of each order column; (0, -1) where all are null."""
    bounds = [bound.cast("bigint") for name in order for bound in (F.min(name), F.max(name))]
    found = tuple(df.agg(*[bound.alias(f"bound{i}") for i, bound in enumerate(bounds)]).first())
    return [(0, -1) if low is None else (low, high) for low, high in zip(found[::2], found[1::2])]


def measured_places(df: DataFrame, order: Sequence[str], max_length: int | None = None) -> Places:
    """The best form that the order columns' values allow for.

    Runs one job over the order columns alone when called, unless their types decide; texts are not read. If their
    ranges leave too little room for the position of any word, and `max_length` does not limit it, the form is the one
    that the types allow for.
    """
    by_type = places_by_type(df, order)
    types = [df.schema[name].dataType for name in order]
    if isinstance(by_type, LongPlaces) or not all(type(dtype) in INTEGER_BITS for dtype in types):
        return by_type
    ranges = _ranges(df, order)
    bits = [max(1, (high - low + 1).bit_length()) for low, high in ranges]
    pos_bits = POS_BITS
    if sum(bits) + pos_bits > LONG_BITS and max_length is not None:
        pos_bits = min(POS_BITS, max(1, max_length.bit_length()))
    if sum(bits) + pos_bits > LONG_BITS or any(low == -(1 << 63) for low, _ in ranges):
        return by_type
    holds = F.lit(True)
    for name, (low, high) in zip(order, ranges):
        holds = holds & F.coalesce(F.col(name).between(F.lit(low), F.lit(high)), F.lit(True))
    return LongPlaces(order, types, [low for low, _ in ranges], bits, pos_bits, holds)
