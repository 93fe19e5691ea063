"""Sequences per child taxon of a root: lineage by doubling over the parent table, then zero-filled counts and lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwork.shared import release, saved


def children(nodes: DataFrame, names: DataFrame, root: int) -> DataFrame:
    """``id`` and ``name`` of the direct children of ``root`` (which is no child of its own); an error where it has none."""
    found = nodes.where((F.col("parent_id") == root) & (F.col("taxon_id") != root)).select(F.col("taxon_id").alias("id"))
    found = found.join(names.select(F.col("taxon_id").alias("id"), "name"), "id", "left")
    if found.isEmpty():
        raise ValueError(f"taxon {root} has no children")
    return found


def branch_of(nodes: DataFrame, root: int) -> DataFrame:
    """``taxon_id`` and ``branch``, the child of ``root`` that it descends from (or is), for every taxon below it.

    Each taxon points at an ancestor, its parent at first, and takes that one's pointer in each round, so a lineage of
    depth d takes log2(d) rounds, whatever the depth. Pointers stop at children of the root and at tops (taxa without a
    parent other than themselves). Those that have not stopped when no depth could be left lie in a cycle: an error.
    """
    parent = F.col("parent_id")
    start = F.when(parent == root, F.col("taxon_id")).otherwise(parent)
    links = nodes.where(parent.isNotNull() & (F.col("taxon_id") != parent) & (F.col("taxon_id") != root))
    links = saved(links.select("taxon_id", start.alias("up"), (parent == root).alias("done")).distinct())
    left = links.count()
    while True:
        ahead = links.select(F.col("taxon_id").alias("up"), F.col("up").alias("next"), F.col("done").alias("next_done"))
        moved = links.where("NOT done").join(ahead, "up", "left")
        # an ancestor without a row of its own is a top, or the root's own line: nothing below the root
        stepped = moved.where("next IS NOT NULL").select("taxon_id", F.col("next").alias("up"), F.col("next_done").alias("done"))
        before, links = links, saved(links.where("done").union(stepped))
        release(before)
        if links.where("NOT done").isEmpty():
            return links.select("taxon_id", F.col("up").alias("branch"))
        if left == 0:
            raise ValueError("the parent table has a cycle")
        left //= 2


def taxon_counts(sequences: DataFrame, acc2tax: DataFrame, nodes: DataFrame, names: DataFrame, root: int, *, min_length: int = 0) -> DataFrame:
    """``id``, ``name``, ``seq_count`` and ``seq_length`` of each child of ``root``, zero where it has no sequence.

    ``sequences``: id, seq_len; those under ``min_length`` and those whose taxon is not below the root do not count.
    """
    below = sequences.where(F.col("seq_len") >= min_length).join(acc2tax.withColumnRenamed("accession", "id"), "id")
    # summed by taxon before the lineage is joined: a taxon may hold most sequences
    by_taxon = below.groupBy("taxon_id").agg(F.count(F.lit(1)).alias("seq_count"), F.sum("seq_len").alias("seq_length"))
    sums = by_taxon.join(branch_of(nodes, root), "taxon_id").groupBy("branch").agg(F.sum("seq_count").alias("seq_count"), F.sum("seq_length").alias("seq_length"))
    joined = children(nodes, names, root).join(sums.withColumnRenamed("branch", "id"), "id", "left")
    return joined.select("id", "name", F.coalesce("seq_count", F.lit(0)).alias("seq_count"), F.coalesce("seq_length", F.lit(0)).alias("seq_length"))


def members(sequences: DataFrame, acc2tax: DataFrame, nodes: DataFrame, root: int) -> DataFrame:
    """``branch`` and ``id`` of every sequence below the root: the members of each child taxon, one row each."""
    placed = acc2tax.withColumnRenamed("accession", "id").join(branch_of(nodes, root), "taxon_id")
    return sequences.join(placed, "id").select("branch", "id")


def write_counts(counts: DataFrame, path: str) -> None:
    """Tab-separated, without a header: id, name, seq_count, seq_length."""
    counts.select("id", "name", "seq_count", "seq_length").write.mode("overwrite").csv(path, sep="\t", header=False)


def _next_sibling(children: DataFrame, buckets: int = 256) -> DataFrame:
    """``children`` (taxon_id, parent) with ``sibling``, the next child of its parent, and ``oldest``, whether it is the first.
    Siblings are in the order of a hash bucket, then of their ids; one bucket of a parent is sorted in one task."""
    dealt = children.withColumn("bucket", F.pmod(F.xxhash64("taxon_id"), F.lit(buckets)))
    order = Window.partitionBy("parent").orderBy("bucket")
    heads = dealt.groupBy("parent", "bucket").agg(F.min("taxon_id").alias("head"))
    heads = heads.select("parent", "bucket", F.lead("head").over(order).alias("later"), F.lag("head").over(order).isNull().alias("leads"))
    inside = Window.partitionBy("parent", "bucket").orderBy("taxon_id")
    joined = dealt.join(heads, ["parent", "bucket"])
    oldest = F.col("leads") & F.lag("taxon_id").over(inside).isNull()
    return joined.select("taxon_id", "parent", F.coalesce(F.lead("taxon_id").over(inside), F.col("later")).alias("sibling"), oldest.alias("oldest"))


def nested_sets(nodes: DataFrame) -> DataFrame:
    """``taxon_id``, ``enter`` and ``leave``: a taxon's number and its last descendant's in a walk of the whole tree, so a taxon
    lies below another if its number does: ``enter`` between the other's ``enter`` and ``leave``.

    The walk goes down and up each taxon's edge (an Euler tour). Each step knows the next one; the numbers come from doubling
    these pointers, so a tree of n taxa takes log2(2 n) joins, whatever its depth. Taxa without a parent, or whose parent
    is no taxon, are tops, one after another. Repeated rows are one; of two parents the lesser counts. A cycle is an error.
    """
    own = nodes.where("taxon_id IS NOT NULL").groupBy("taxon_id").agg(F.min("parent_id").alias("parent_id"))
    known = own.select(F.col("taxon_id").alias("parent_id"), F.lit(True).alias("there"))
    linked = own.join(known, "parent_id", "left")
    below = F.col("there") & (F.col("parent_id") != F.col("taxon_id"))
    children = saved(linked.select("taxon_id", F.when(below, F.col("parent_id")).alias("up")).withColumn("parent", F.coalesce("up", F.lit(-1 << 62))))
    n = children.count()
    order = saved(_next_sibling(children.select("taxon_id", "parent")))
    first = order.where("oldest").select(F.col("parent").alias("taxon_id"), F.col("taxon_id").alias("child"))
    told = order.join(first, "taxon_id", "left").join(children.select("taxon_id", "up"), "taxon_id")
    t = F.col("taxon_id")
    down = F.struct((2 * t).alias("step"), F.when(F.col("child").isNotNull(), 2 * F.col("child")).otherwise(2 * t + 1).alias("next"), F.lit(1).cast("bigint").alias("sum"))
    up = F.struct((2 * t + 1).alias("step"), F.when(F.col("sibling").isNotNull(), 2 * F.col("sibling")).otherwise(2 * F.col("up") + 1).alias("next"), F.lit(0).cast("bigint").alias("sum"))
    steps = saved(told.select(F.inline(F.array(down, up))))
    release(order, children)
    # the sum of a step counts the taxa that are entered from it on, up to where its pointer leads
    for _ in range((2 * n).bit_length() + 1):
        if steps.where("next IS NOT NULL").isEmpty():
            break
        ahead = steps.select(F.col("step").alias("next"), F.col("next").alias("beyond"), F.col("sum").alias("more"))
        moved = steps.where("next IS NOT NULL").join(ahead, "next").select("step", F.col("beyond").alias("next"), (F.col("sum") + F.col("more")).alias("sum"))
        before, steps = steps, saved(steps.where("next IS NULL").union(moved))
        release(before)
    else:
        if not steps.where("next IS NOT NULL").isEmpty():
            raise ValueError("the parent table has a cycle")
    enters = F.max(F.when(F.col("step") % 2 == 0, n - F.col("sum"))).alias("enter")
    leaves = F.max(F.when(F.col("step") % 2 != 0, n - 1 - F.col("sum"))).alias("leave")
    return steps.groupBy(F.shiftright("step", 1).alias("taxon_id")).agg(enters, leaves)


def clade_sums(sequences: DataFrame, acc2tax: DataFrame, nodes: DataFrame, *, min_length: int = 0, block: int = 1 << 16) -> DataFrame:
    """``taxon_id``, ``parent_id``, ``rank``, ``enter``, ``leave``, and ``seq_count`` and ``seq_length`` of all sequences of the taxon
    and below it, for every taxon of every rank.

    Sequences are summed by taxon, taxa by blocks of their numbers, and running totals within a block; a clade's sum is the
    difference of two running totals, so no sequence is counted once for each of its ancestors.
    """
    tree = saved(nested_sets(nodes))
    below = sequences.where(F.col("seq_len") >= min_length).join(acc2tax.withColumnRenamed("accession", "id"), "id")
    own = below.groupBy("taxon_id").agg(F.count(F.lit(1)).alias("own_count"), F.sum("seq_len").alias("own_length"))
    each = tree.join(own, "taxon_id", "left").na.fill(0, ["own_count", "own_length"]).withColumn("block", F.floor(F.col("enter") / block))
    sums = each.groupBy("block").agg(F.sum("own_count").alias("c"), F.sum("own_length").alias("l"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of taxa
    sums = sums.select("block", *(F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(x) for x in ("c", "l")))
    inside = Window.partitionBy("block").orderBy("enter").rowsBetween(Window.unboundedPreceding, 0)
    totals = each.join(sums, "block").withColumns({"c": F.col("c") + F.sum("own_count").over(inside), "l": F.col("l") + F.sum("own_length").over(inside)})
    ends = totals.select(F.col("enter").alias("leave"), F.col("c").alias("c_end"), F.col("l").alias("l_end"))
    found = totals.join(ends, "leave").select("taxon_id", "enter", "leave", (F.col("c_end") - F.col("c") + F.col("own_count")).alias("seq_count"), (F.col("l_end") - F.col("l") + F.col("own_length")).alias("seq_length"))
    named = nodes.where("taxon_id IS NOT NULL").groupBy("taxon_id").agg(F.min("parent_id").alias("parent_id"), F.min("rank").alias("rank"))
    return found.join(named, "taxon_id").select("taxon_id", "parent_id", "rank", "enter", "leave", "seq_count", "seq_length")
