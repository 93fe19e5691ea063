"""Sharding along a Hilbert curve.

Metadata dimensions are quantised to a few levels each, by quantiles of all rows, so that a skewed dimension uses all its
levels; a row's levels give its index on the Hilbert curve, and the rows in curve order are cut into runs of equal row
counts. Rows near each other in all dimensions lie in the same or in neighbouring shards, so file statistics prune on any
of the dimensions.

All steps are DataFrame functions. A curve cell may hold any share of the rows: its rows are spread over hash slices,
which are counted first, so that no cell is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from strandwork.llm.common import apart, free_name, saved

BITS = 3
SLICES_LOG2 = 10
ACCURACY = 10_000


def _numbers(df: DataFrame, dims: Sequence[str]) -> dict[str, Column]:
    """A number for each dimension that keeps its order: numbers as they are, other values by the seven bytes behind the
    prefix that all values share, which is that of the least and the greatest."""
    plain = [d for d in dims if isinstance(df.schema[d].dataType, NumericType)]
    texts = [d for d in dims if d not in plain]
    ends = df.agg(*(f(F.col(f"`{d}`").cast("string")).alias(f"{f.__name__}{i}") for i, d in enumerate(texts) for f in (F.min, F.max))).first() if texts else None
    out = {d: F.col(f"`{d}`").cast("double") for d in plain}
    for i, d in enumerate(texts):
        low, high = ((ends[f"{f}{i}"] or "").encode() for f in ("min", "max"))
        shared = next((j for j, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
        head = F.rpad(F.hex(F.substring(F.encode(F.col(f"`{d}`").cast("string"), "UTF-8"), shared + 1, 7)), 14, "0")
        out[d] = F.conv(head, 16, 10).cast("double")
    return {d: out[d] for d in dims}


def _hilbert(df: DataFrame, axes: list[str], bits: int, into: str) -> DataFrame:
    """The Hilbert index of the levels in ``axes`` (each under 2^bits), by Skilling's transform from axes to index.

    The axes travel as one array through ``aggregate``, whose steps go over the bits from the highest and over the axes.
    """
    n = len(axes)
    state, gray, flip = f"{into}_state", f"{into}_gray", f"{into}_flip"
    i = f"cast(s % {n} as int)"
    q = f"shiftleft(1, cast({bits - 1} - s div {n} as int))"
    p = f"({q} - 1)"
    undone = (
        f"aggregate(sequence(0, {(bits - 1) * n - 1}), array({', '.join(axes)}), (a, s) -> transform(a, (x, j) -> CASE "
        f"WHEN a[{i}] & {q} != 0 THEN IF(j = 0, x ^ {p}, x) "
        f"WHEN j = 0 OR j = {i} THEN x ^ ((a[0] ^ a[{i}]) & {p}) ELSE x END))"
    )
    df = apart(df, state, F.expr(undone if bits > 1 else f"array({', '.join(axes)})"))
    df = apart(df, gray, F.expr(f"transform({state}, (x, j) -> aggregate(slice({state}, 1, j + 1), 0, (a, y) -> a ^ y))"))
    turned = f"aggregate(sequence(1, {bits - 1}), 0, (t, k) -> IF({gray}[{n - 1}] & shiftleft(1, k) != 0, t ^ (shiftleft(1, k) - 1), t))"
    df = apart(df, flip, F.expr(turned if bits > 1 else "0"))
    index = f"aggregate(sequence({bits - 1}, 0), 0, (a, k) -> aggregate({gray}, a, (c, x) -> shiftleft(c, 1) | (shiftright(x ^ {flip}, k) & 1)))"
    return df.withColumn(into, F.expr(index)).drop(*axes, state, gray, flip)


def with_curve(df: DataFrame, dims: Sequence[str], bits: int = BITS, into: str = "curve") -> DataFrame:
    """``df`` with the Hilbert index of ``dims``, each quantised into 2^bits levels of about equal numbers of rows; null is
    the lowest level. The quantiles of all rows, one row of them, reach the driver."""
    numbers = _numbers(df, dims)
    steps = [(i + 1) / (1 << bits) for i in range((1 << bits) - 1)]
    cuts = df.agg(*(F.percentile_approx(n, steps, ACCURACY).alias(f"q{i}") for i, n in enumerate(numbers.values()))).first()
    axes = {}
    for i, number in enumerate(numbers.values()):
        above = [(number > F.lit(float(c))).cast("int") for c in cuts[f"q{i}"] or ()]
        axes[f"{into}_axis{i}"] = F.coalesce(sum(above, F.lit(0)), F.lit(0))
    return _hilbert(df.withColumns(axes), list(axes), bits, into)


def cut_runs(df: DataFrame, shards: int, ties: Sequence[str], curve: str = "curve") -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1, counts at most one apart along the curve) and ``slot`` (from 0, gapless).

    Rows of one curve cell follow each other by a hash of ``ties``, then by ``ties``; rows equal in all of them are
    interchangeable. Offsets of cells come from one small table (2^(bits * dims) rows at most).
    """
    h = F.xxhash64(*ties)
    sliced = df.withColumns({"__hash": h, "__slice": F.shiftrightunsigned(h, 64 - SLICES_LOG2).cast("int")})
    counts = sliced.groupBy(curve, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(curve).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = counts.groupBy(curve).agg(F.sum("__n").alias("__cell"))
    cells = cells.select(
        curve,
        F.coalesce(F.sum("__cell").over(before), F.lit(0)).alias("__before"),
        F.sum("__cell").over(whole).alias("__rows"),
    )
    inner = Window.partitionBy(curve).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(inner), F.lit(0))).drop("__n").join(cells, curve)
    starts = starts.select(curve, "__slice", (F.col("__start") + F.col("__before")).alias("__start"), "__rows")
    order = Window.partitionBy(curve, "__slice").orderBy("__hash", *ties)
    ranked = sliced.join(starts, [curve, "__slice"]).withColumn("__rank", F.col("__start") + F.row_number().over(order) - 1)
    shard = F.expr(f"__rank * {shards} div __rows").cast("int")
    first = F.expr(f"(cast(shard as bigint) * __rows + {shards - 1}) div {shards}")
    ranked = ranked.withColumn("shard", shard).withColumn("slot", F.col("__rank") - first)
    return ranked.drop("__hash", "__slice", "__start", "__rows", "__rank")


def assign(
    docs: DataFrame,
    *,
    shards: int = 24,
    dims: Sequence[str] = ("lang", "source", "n_chars", "doc_id"),
    id_col: str = "doc_id",
    text_col: str = "text",
    bits: int = BITS,
) -> DataFrame:
    """One row per row of ``docs``: the id, ``size`` (UTF-8 bytes of the text plus 8), ``text_crc32``, ``curve``,
    ``law`` ("rows"), ``shard``, ``slot`` and ``grown_shard`` (null: this law moves rows when a shard is added).

    A null text has size 8 and the checksum of no bytes. Null ids and dimensions are allowed; so are repeated rows,
    each with a slot of its own; of equal values of a dimension all rows are in one level. Texts of any length are only
    measured. Other columns are not read. An empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    plain = {d: F.col(f"`{d}`") for d in dims if d != id_col}
    light = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        *(c.alias(f"dim_{d}") for d, c in plain.items()),
    )
    cells = with_curve(saved(light), ["doc_id" if d == id_col else f"dim_{d}" for d in dims], bits)
    cut = cut_runs(cells.drop(*(f"dim_{d}" for d in plain)), shards, ["doc_id", "text_crc32", "size"])
    return cut.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def write_shards(docs: DataFrame, path: str, *, shards: int = 24, dims: Sequence[str] = ("lang", "source", "n_chars", "doc_id"), bits: int = BITS) -> None:
    """``docs`` as Parquet in folders ``shard=N`` under ``path`` (with underscores where that is a column's name), in curve
    order within each file."""
    name = free_name(docs, "shard")
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(F.col(f"`{d}`").alias(f"dim_{d}") for d in dims))
    cells = with_curve(held, [f"dim_{d}" for d in dims], bits)
    cut = cut_runs(cells, shards, [f"`dim_{d}`" for d in dims]).repartition(shards, "shard").sortWithinPartitions("shard", "slot")
    cut.select(*(F.col("row")[c].alias(c) for c in docs.columns), F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
