"""Order-sensitive digests as associative aggregates: two sides are compared by one row each, without numbering or joining.

A sequence of rows x at places p has the digest sum(h(x) * B^p) over a prime field, for two bases: swapped, missing or
changed rows change it but for a chance of about length / 2^61 for each. Sums may be taken in any order and from any parts,
so the aggregate is partial before the shuffle. The bases are fixed; digests are no defence against somebody who chooses rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime below 2^31, so that products of residues fit a long; residues are combined by several bases.
PRIME = 2_147_483_647
BASES = (1_103_515_245, 1_664_525_001, 69_069_013, 1_597_334_677)


def power(base: int, exponent: Column) -> Column:
    """base^exponent modulo PRIME, by the squares at the exponent's bits: 40 of them."""
    squares = F.array(*(F.lit(pow(base, 1 << bit, PRIME)).cast("long") for bit in range(40)))
    factors = F.transform(squares, lambda x, i: F.when(F.getbit(exponent, i) == 1, x).otherwise(F.lit(1).cast("long")))
    return F.aggregate(factors, F.lit(1).cast("long"), lambda a, x: a * x % PRIME)


def order_digest(rows: DataFrame, place: str, *columns: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, n, digest: of the rows' columns (nulls told apart from all values) at their places (0, 1, ...; not null).

    Equal digests of equal n say that both sides hold the same rows in the same order.
    """
    value = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    keyed = rows.select(*by, F.col(place).cast("long").alias("__qs_p"), *(F.pmod(F.xxhash64(F.lit(b), value), F.lit(PRIME)).alias(f"__qs_h{i}") for i, b in enumerate(BASES)))
    each = [F.pmod(F.sum(F.col(f"__qs_h{i}") * power(b, F.col("__qs_p")) % PRIME), F.lit(PRIME)) for i, b in enumerate(BASES)]
    made = keyed.groupBy(*by).agg(F.count("*").alias("n"), *(e.alias(f"__qs_d{i}") for i, e in enumerate(each)))
    return made.select(*by, "n", F.concat_ws("-", *(F.lpad(F.hex(F.coalesce(f"__qs_d{i}", F.lit(0))), 8, "0") for i in range(len(BASES)))).alias("digest"))


def same_order(left: DataFrame, right: DataFrame, place: str, *columns: str) -> bool:
    """Whether both sides have the same rows at the same places: one aggregate a side."""
    return order_digest(left, place, *columns).first() == order_digest(right, place, *columns).first()


def differing_blocks(left: DataFrame, right: DataFrame, place: str, *columns: str, block: int = 4_096) -> DataFrame:
    """block, n_left, n_right: blocks of places whose digests differ or that one side lacks."""
    side = lambda rows, name: order_digest(rows.withColumn("block", F.floor(F.col(place) / block)), place, *columns, by=("block",)).select("block", F.col("n").alias(f"n_{name}"), F.col("digest").alias(name))
    both = side(left, "left").join(side(right, "right"), "block", "full_outer")
    return both.where("NOT left <=> right").select("block", F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
