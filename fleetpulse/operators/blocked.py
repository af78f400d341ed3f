"""Running aggregates over one ordered stream, computed block by block.

A window partitioned only by a feed puts the whole feed into one task. Here the
stream is cut into blocks of bounded size: windows run inside (keys, block), a
small per-block summary is scanned per key, and what earlier blocks contribute
is joined back. The result equals the plain window exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetpulse.session import written


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``op`` is sum, max, min or last (last non-null)."""

    name: str
    op: str
    expr: Column


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    keys: list[str],
    block: str,
    order: list[str],
    specs: list[Running],
    inclusive: bool = False,
    derived: bool = False,
) -> DataFrame:
    """Add one column per spec: the aggregate over all earlier rows of the key
    (and the current row when ``inclusive``), in (block, order) order.

    Sums default to 0 and the others to NULL when there is no earlier row.
    Set ``derived`` when ``df`` is the result of earlier shuffles rather than a
    scan: see ``shuffled_once``.
    """
    part = keys + [block]
    if derived:
        df = _spread(df, part)
    local = Window.partitionBy(*part).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)

    totals = shuffled_once(df, part, [_total(s, order).alias(f"__t_{s.name}") for s in specs], derived)
    carry = totals.select(
        *part, *[_over(s.op, F.col(f"__t_{s.name}"), before).alias(f"__c_{s.name}") for s in specs]
    )
    out = df.select("*", *[_over(s.op, s.expr, local).alias(f"__l_{s.name}") for s in specs]).join(carry, part)
    kept = [c for c in df.columns if c not in {s.name for s in specs}]
    return out.select(*kept, *[_merge(s).alias(s.name) for s in specs])


def shuffled_once(df: DataFrame, part: list[str], totals: list[Column], derived: bool = True) -> DataFrame:
    """Per-group totals over a frame that the caller also uses row by row.

    Both uses read the same exchange only while they need the same columns; column
    pruning would otherwise give the totals their own, second run of everything
    below. Touching every column with one cheap hash keeps the plans equal, so the
    exchange is reused.
    """
    if not derived:
        return df.groupBy(*part).agg(*totals)
    rest = [c for c in df.columns if c not in part]
    touch = F.bit_xor(F.xxhash64(*rest)).alias("__touch")
    return df.groupBy(*part).agg(*totals, touch).where(F.col("__touch").isNotNull()).drop("__touch")


def _spread(df: DataFrame, part: list[str]) -> DataFrame:
    # The null test is what a join on these columns would add to one side only.
    return not_null(df, part).repartition(*part)


FILE_BYTES = 4 << 20  # of input files to a task, as rows in a sort take over a hundred times that


def partitions_for(df: DataFrame, least: int | None = None) -> int:
    """Partitions for sorting rows made from ``df``: one for every ``FILE_BYTES`` that it reads, and at least ``least`` or the session's number.

    AQE joins partitions by their compressed size, so that what a task sorts would grow with the input.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    known = sum(n for n in sizes if n < 1 << 60)  # frames of unknown size claim the largest number there is
    return max(least or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // FILE_BYTES))


def not_null(df: DataFrame, names: list[str]) -> DataFrame:
    for n in names:
        df = df.where(F.col(n).isNotNull())
    return df


def row_numbers(
    df: DataFrame, keys: list[str], block: str, order: list[Column | str], name: str = "rn", derived: bool = False
) -> DataFrame:
    """Exact 1-based numbering per key in (block, order) order."""
    part = keys + [block]
    if derived:
        df = _spread(df, part)
    local = Window.partitionBy(*part).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        shuffled_once(df, part, [F.count(F.lit(1)).alias("__n")], derived)
        .select(*part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    )
    return (
        df.withColumn("__rn", F.row_number().over(local).cast("long"))
        .join(offsets, part)
        .withColumn(name, F.col("__rn") + F.col("__off"))
        .drop("__rn", "__off")
        .select(*[c for c in df.columns if c != name], name)
    )


def range_row_numbers(
    df: DataFrame, keys: list[str], order: list[Column], name: str = "rank"
) -> DataFrame:
    """Exact numbering per key in any order, for keys of any size.

    Range partitioning on (keys, order) yields sorted slices of even size even
    where one key holds most rows; a slice is the block. The sliced frame is
    written, so that every use sees the same slices.
    """
    sliced = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("__slice", F.spark_partition_id().cast("long"))
    return row_numbers(written(sliced, "sliced"), keys, "__slice", order, name).drop("__slice")


SALTS = 64


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every key, for keys of any size.

    Each of a fixed number of salted parts keeps its own first ``n``, so the last
    step sees at most ``SALTS * n`` rows of a key.
    """
    rest = [c for c in df.columns if c not in keys]
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*rest), F.lit(SALTS)))
    for part in (["__salt", *keys], keys):
        w = Window.partitionBy(*part).orderBy(*order)
        salted = salted.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")
    return salted.drop("__salt")


def _total(spec: Running, order: list[str]) -> Column:
    if spec.op == "last":
        return F.max_by(spec.expr, F.when(spec.expr.isNotNull(), F.struct(*order)))
    return _AGG[spec.op](spec.expr)


def _over(op: str, expr: Column, w) -> Column:
    if op == "last":
        return F.last(expr, ignorenulls=True).over(w)
    return _AGG[op](expr).over(w)


def _merge(spec: Running) -> Column:
    near, far = F.col(f"__l_{spec.name}"), F.col(f"__c_{spec.name}")
    if spec.op == "sum":
        return F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0))
    if spec.op == "max":
        return F.greatest(near, far)
    if spec.op == "min":
        return F.least(near, far)
    return F.coalesce(near, far)
