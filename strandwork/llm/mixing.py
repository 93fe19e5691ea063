"""Mixing sources to target weights by Pareto order sampling.

Targets: the sources share a number of words by weight; a source stops at a multiple of its own size and the rest is
shared again, which is a water level over the sources. Within a source documents have unequal weights, and each has an
expected number of copies in proportion to its weight, up to the same multiple: a second water level, over the source's
weights, makes the expected words meet the target exactly. The whole part of a document's expectation is allocated for
certain; for the fraction p each document draws u and is ranked by (u / (1 - u)) / (p / (1 - p)), its random odds over
its inclusion odds, and documents are taken in this order until the source's words are reached. Two more rounds offer
the words still missing to documents that fit into them, in the same order. All draws are hashes of the id, so reruns
agree; all steps are DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.llm.common import n_words, saved, spread_join
from strandwork.llm.ranking import running_total

WEIGHTS = (5, 2, 1)
BUCKETS = 1024
#: Rows of a unit that are written out together.
BLOCK = 4096
ROUNDS = 3
#: Weights by size: documents of fewer words than so many, the rest last. Fragments and very long texts are taken less.
SIZE_WEIGHTS = ((16, 0.25), (64, 0.5), (2048, 1.0), (None, 0.5))
#: Weights count by powers of two, from 2^-12 to 2^12, so a source has few of them and sums are exact.
WEIGHT_BITS = 12


def size_weight(size: Column) -> Column:
    """The weight of SIZE_WEIGHTS for a number of words."""
    out = F.lit(SIZE_WEIGHTS[-1][1])
    for below, weight in reversed(SIZE_WEIGHTS[:-1]):
        out = F.when(size < below, F.lit(weight)).otherwise(out)
    return out


def _power(weight: Column) -> Column:
    """The power of two next to a weight; a weight that is missing is 1, one of zero or less the least."""
    bits = F.round(F.log2(F.greatest(weight, F.lit(2.0**-WEIGHT_BITS))))
    return F.coalesce(F.pow(F.lit(2.0), F.least(bits, F.lit(float(WEIGHT_BITS)))), F.lit(1.0))


def rates(classes: DataFrame, most: float) -> DataFrame:
    """``rate``, the expected copies, for each (source_no, weight) of ``classes``, which also has ``class_words`` and the
    source's ``target``: min(most, weight * level), where the level makes the expected words of a source its target.

    A source has at most 2 * WEIGHT_BITS + 1 weights, so its rows are few."""
    fall = Window.partitionBy("source_no").orderBy(F.desc("__w"))
    heavier = fall.rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum(F.col("class_words") * F.lit(float(most))).over(heavier), F.lit(0.0))
    left = F.sum(F.col("class_words") * F.col("__w")).over(fall.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = F.when(left > 0, (F.col("target") - full) / F.when(left > 0, left))
    whole = Window.partitionBy("source_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rate = F.least(F.col("__w") * F.max("__level").over(whole), F.lit(float(most)))
    return classes.withColumn("__level", level).withColumn("__rate", F.coalesce(rate, F.lit(0.0))).drop("__level")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sources`` (source, source_size; one row each) with ``source_no`` and ``target``.

    Sources take the weights in turn, by code point with null last. Target = min(most * size, weight * level), where the
    level makes the targets sum to share * all sizes. The table has one row per source, which is small beside documents.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    t = sources.withColumn("source_no", F.row_number().over(turn))
    t = t.withColumn("weight", F.element_at(cycle, F.col("source_no") % len(weights) + F.when(F.col("source_no") % len(weights) == 0, len(weights)).otherwise(0)))
    t = t.withColumn("most", F.col("source_size") * F.lit(float(most)))
    rise = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("most").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(rise.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    t = t.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - capped) / left)
    level = F.max("level").over(every)
    return t.withColumn("target", F.least(F.col("most"), F.col("weight") * level)).drop("weight", "most", "level")


def draw(seed: int, key: Column) -> Column:
    """A number between 0 and 1 from a key, the same in any engine with MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def plan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    most: int = 2,
    seed: int = 1,
) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id``, ``source``, ``text_md5``, ``nth`` (from 1, among the rows equal in id,
    source and text), ``size`` (words), ``source_size``, ``target`` and ``copies`` (0 to ``most``).

    ``weight_col`` makes documents of a source more or less likely, in proportion, by powers of two; without it the
    weights go by size (SIZE_WEIGHTS). Repeated rows are counted as one unit and taken one by one: each draws for itself, by id,
    text and number, and so do rows without an id; the first row of an id draws by the id alone. Null texts have no words; a
    null source is a source of its own; a null weight is 1. Texts of any length are counted whole. Other columns are not
    read. An empty table gives no rows. Sources are sorted in one task, a row each: some millions at most.
    """
    text = F.col(f"`{text_col}`").cast("string")
    weight = _power(F.col(f"`{weight_col}`").cast("double")) if weight_col else size_weight(n_words(text))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.md5(F.encode(text, "UTF-8")).alias("text_md5"),
        n_words(text).alias("size"),
        weight.alias("__w"),
    )
    units = saved(rows.groupBy("doc_id", "source", "text_md5", "size").agg(F.count(F.lit(1)).alias("rows"), F.max("__w").alias("__w")))
    words = F.col("rows") * F.col("size")
    sources = units.groupBy("source").agg(F.sum(words).alias("source_size"))
    # a source may hold a third of the rows: it is dealt by a salt too wherever sources are joined
    named = {"__null": F.col("source").isNull(), "__name": F.coalesce("source", F.lit(""))}
    goal = targets(sources, weights, share, float(most))
    sums = units.groupBy("source", "__w").agg(F.sum(words).alias("class_words")).withColumns(named)
    classes = sums.join(goal.withColumns(named).drop("source"), ["__null", "__name"])
    classes = saved(rates(classes.select("__null", "__name", "__w", "class_words", "source_no", "source_size", "target"), float(most)).drop("class_words"))
    each = ["doc_id", "text_md5", "nth"]
    # a unit of many rows becomes blocks of rows, which the join deals out, and then rows
    blocks = units.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(rows - 1) div {BLOCK}"))))
    t = spread_join(blocks.withColumns(named), classes, ["__null", "__name", "__w"], ["doc_id", "text_md5", "__block"]).drop("__null", "__name", "__w")
    in_block = F.least(F.lit(BLOCK).cast("bigint"), F.col("rows") - F.col("__block") * BLOCK)
    t = t.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), in_block)))
    t = t.withColumn("nth", F.col("nth") + F.col("__block") * BLOCK).drop("rows", "__block")
    alone = F.col("doc_id").isNotNull() & (F.col("nth") == 1)
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.when(alone, "").otherwise(F.concat_ws("|", F.lit(""), F.coalesce("text_md5", F.lit("")), F.col("nth").cast("string"))))
    t = t.withColumns({"copies": F.floor("__rate").cast("int"), "__p": F.col("__rate") - F.floor("__rate"), "__u": draw(seed, key)})
    words = F.col("size")
    odds = F.col("__u") / (1 - F.col("__u")) / (F.col("__p") / (1 - F.col("__p")))
    # without a fraction there are no odds: such rows come last, by their draw
    t = t.withColumn("__rank", F.when(F.col("__p") > 0, odds / (1 + odds)).otherwise(1 + F.col("__u")))
    t = t.withColumns({"__bucket": F.least(F.floor(F.col("__rank") * BUCKETS), F.lit(2 * BUCKETS - 1)).cast("int"), "__words": words})
    sure = t.groupBy("source_no").agg(F.sum(F.col("copies") * F.col("__words")).alias("__sure"))
    t = saved(spread_join(t, sure, ["source_no"], each).withColumn("__left", F.col("target") - F.col("__sure")).drop("__sure"))
    order = [F.col(c).asc_nulls_first() for c in ("__rank", "doc_id", "text_md5", "size", "nth")]
    for _ in range(ROUNDS):
        t = t.withColumn("__fits", (F.col("copies") < F.least(F.floor("__rate") + 1, F.lit(most))) & (F.col("__words") <= F.col("__left")))
        t = t.withColumn("__offer", F.when(F.col("__fits"), F.col("__words")).otherwise(F.lit(0)))
        t = running_total(t, "source_no", "__bucket", order, "__offer", "__total")
        taken = F.col("__fits") & (F.col("__total") <= F.col("__left"))
        t = saved(t.withColumns({"copies": F.col("copies") + taken.cast("int"), "__got": F.when(taken, F.col("__offer")).otherwise(F.lit(0))}))
        got = t.groupBy("source_no").agg(F.sum("__got").alias("__new"))
        t = spread_join(t, got, ["source_no"], each).withColumn("__left", F.col("__left") - F.col("__new")).drop("__new", "__got", "__total", "__offer", "__fits")
    return t.select("doc_id", "source", "text_md5", "nth", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it has copies, with all their columns (of any name).

    Rows equal in id, source and text share their copies as evenly as their number allows: of rows that differ elsewhere those
    of the least hash get one more. Rows equal in all columns are counted first, so no task gets them one by one.
    """
    units = plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    chosen = units.groupBy("doc_id", "source", "text_md5").agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("copies")).where("copies > 0")
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("held"))
    key = F.md5(F.encode(F.col("held")[text_col].cast("string"), "UTF-8"))
    same = F.col("held")[id_col].eqNullSafe(F.col("doc_id")) & F.col("held")[source_col].cast("string").eqNullSafe(F.col("source")) & key.eqNullSafe(F.col("text_md5"))
    joined = held.join(chosen, same)
    one = joined.where("rows = 1").select("held", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    many = joined.where("rows > 1").groupBy("held", "rows", "copies").agg(F.count(F.lit(1)).alias("n"))
    unit = F.xxhash64(F.col("held")[id_col], F.col("held")[source_col].cast("string"), F.md5(F.encode(F.col("held")[text_col].cast("string"), "UTF-8")))
    many = many.withColumns({"unit": unit, "h": F.xxhash64("held")}).withColumn("bucket", F.shiftright("h", 54))
    placed = running_total(many, "unit", "bucket", [F.col("h"), F.xxhash64(F.lit(1), "held")], "n", "upto")
    whole, more = F.expr("copies div rows"), F.col("copies") % F.col("rows")
    extra = F.greatest(F.least(F.col("upto"), more) - (F.col("upto") - F.col("n")), F.lit(0))
    placed = placed.withColumn("times", F.col("n") * whole + extra).where("times > 0")
    blocks = placed.select("held", "times", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(times - 1) div {BLOCK}"))).alias("block")).repartition(F.xxhash64("held"), F.col("block"))
    repeated = blocks.select("held", F.explode(F.sequence(F.lit(1), F.least(F.lit(BLOCK), F.col("times") - F.col("block") * BLOCK).cast("int"))).alias("copy"))
    return one.union(repeated).select(*(F.col("held")[c].alias(c) for c in docs.columns))
