"""A filter of fixed size that says whether a value may be among others, before anything is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the filter's bits: 1 MB, whatever it is made from.
BITS = 23


def may_be_in(values: DataFrame, column: str, bits: int = BITS) -> Callable[[Column], Column]:
    """Test of columns against the values of a column: false is certain, true is not; NULL is in nothing.

    The filter is an array of 64-bit words, built by an aggregate with at most ``2 ** bits / 64`` rows a task and read as
    a scalar subquery, so every task gets it once and no row is joined. With very many values it lets all pass.
    """
    words = 1 << bits - 6

    def slot(value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(1 << bits))

    own = slot(F.col(column))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (own % 64).cast("int"))
    seen = values.filter(F.col(column).isNotNull()).select(F.shiftright(own, 6).alias("word"), bit.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    every = values.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    filled = seen.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    whole = filled.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words")).select(F.col("words.bits")).scalar()

    def test(value: Column) -> Column:
        place = slot(value)
        word = F.element_at(whole, (F.shiftright(place, 6) + 1).cast("int"))
        return value.isNotNull() & (F.getbit(word, (place % 64).cast("int")) == 1)

    return test
