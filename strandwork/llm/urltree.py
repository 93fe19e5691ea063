"""URL filters by a path-template tree.

Per host, the segments of all paths form a tree. Level by level from the root:

1. *Test*: a child keeps its name where it has labels enough of its own and its share of bad ones differs from its
   parent's by more than a two-proportion test allows for. How large its host is does not matter.
2. *Generalise*: of the others, a child with few pages or labels, or that looks like a number or a key, is a variable
   segment; all variable children of a parent are one wildcard.
3. *Merge*: what remains of a parent's children are compared with each other, in the order of their smoothed purity:
   neighbours that a two-proportion test cannot tell apart, and whose sub-trees are alike in ending there or going on,
   become one branch. Children are summed into bands of purity first, so a parent with any number of them is a few
   rows here. A band is narrower than the test could tell apart with a child's labels: BANDS of them for children of few
   labels, twice as many with each fourfold number of labels, so none are merged untested that a test would part.
4. *Judge*: a template is a leaf of the merged tree. Its purity is its share of bad labels, smoothed by its parent's,
   which is smoothed in turn up to the whole table's. A template whose purity reaches the threshold is rejected; the
   threshold is a multiple of the table's own share, since what is bad may be rare. It needs evidence of its own too:
   labels enough, and a share of bad ones whose lower confidence limit lies above the table's share.

A node that no test could divide any more (too few labels, or of one kind only) is a leaf whatever its depth, so levels
go on as far as some branch may still differ, and no further. Rules for hosts and path prefixes come before the verdict.

A level costs a grouping of partial sums and a join on (host, template so far, segment); no host is gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.llm.common import saved, spread_join

BANDS = 64
#: Segments that vary by their looks: digits with an optional file ending, hex keys, and words with digits.
VARIABLE = r"^(\d+(\.\w{1,5})?|[0-9a-fA-F]{8,}|[0-9a-fA-F-]{32,36}|\w*\d\w*\d\w*)$"
SEP = "/"
#: Labels that a rejected template has at least, and standard errors by which its share exceeds the table's.
EVIDENCE = (8, 3.0)
MIN_PAGES, MIN_LABELS, Z, SMOOTH, LIFT, MAX_PURITY = 5, 5, 2.6, 20.0, 2.0, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with A-Z in lower case.
    Path: what follows up to ``?``, ``#`` or the end. Both are empty for null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2147483647))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its action. ``rules``: (action, "host/path prefix"); a rule fits its host and
    all subdomains where the path starts with the rule's path."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # a longer rule wraps the shorter ones
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(slash + rest))
        name, action = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def _differs(bad: Column, labels: Column, other_bad: Column, other_labels: Column, z: float) -> Column:
    """Whether two shares of bad labels differ by more than ``z`` standard errors of their difference."""
    rate = (bad + other_bad) / F.greatest(labels + other_labels, F.lit(1))
    error = F.sqrt(rate * (1 - rate) * (1 / F.greatest(labels, F.lit(1)) + 1 / F.greatest(other_labels, F.lit(1))))
    apart = F.abs(bad / F.greatest(labels, F.lit(1)) - other_bad / F.greatest(other_labels, F.lit(1)))
    return (labels > 0) & (other_labels > 0) & (apart > z * error)


def _branches(child: DataFrame, min_pages: int, min_labels: int, z: float, smooth: float) -> DataFrame:
    """``child`` (host, template, segment, pages, good, bad, deep, purity) with ``name``, its branch below its parent."""
    node = ["host", "template"]
    parent = child.groupBy(*node).agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
    t = spread_join(child, parent, node, ["segment"])
    labels, others = F.col("good") + F.col("bad"), F.col("all_good") + F.col("all_bad")
    own = (labels >= min_labels) & _differs(F.col("bad"), labels, F.col("all_bad") - F.col("bad"), others - labels, z)
    variable = F.col("segment").rlike(VARIABLE) | ((F.col("pages") < min_pages) & (labels < min_labels))
    smoothed = (F.col("bad") + F.lit(smooth) * F.col("purity")) / (labels + F.lit(smooth))
    t = t.withColumn("kind", F.when(own, "own").when(variable, "variable").otherwise("alike"))
    finer = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.sqrt(F.greatest(labels, F.lit(1))) / F.lit(BANDS))), F.lit(0)))
    t = t.withColumns({"band": F.floor(smoothed * F.lit(BANDS) * finer) / finer, "ends": F.col("deep") * 2 < F.col("pages")})
    shape = [*node, "ends"]
    bands = t.where("kind = 'alike'").groupBy(*shape, "band").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.count(F.lit(1)).alias("n"), F.min("segment").alias("one"))
    order = Window.partitionBy(*shape).orderBy("band")
    near_g, near_b = F.lag("g").over(order), F.lag("b").over(order)
    opens = _differs(F.col("b"), F.col("g") + F.col("b"), near_b, near_g + near_b, z)
    bands = bands.withColumn("group", F.coalesce(F.sum(F.coalesce(opens, F.lit(False)).cast("int")).over(order), F.lit(0)))
    whole = Window.partitionBy(*shape, "group")
    label = F.when(F.sum("n").over(whole) == 1, F.col("one")).otherwise(F.concat(F.lit("+"), F.when(F.col("ends"), "").otherwise(SEP), F.col("group").cast("string")))
    names = bands.select(*shape, "band", label.alias("merged"))
    t = spread_join(t, names, [*shape, "band"], ["segment"], "left")
    name = F.when(F.col("kind") == "own", F.col("segment")).when(F.col("kind") == "variable", F.lit("*")).otherwise(F.col("merged"))
    return t.select(*node, "segment", "good", "bad", "purity", name.alias("name"))


def templates(
    paths: DataFrame, *, min_pages: int = MIN_PAGES, min_labels: int = MIN_LABELS, z: float = Z, smooth: float = SMOOTH
) -> tuple[DataFrame, float]:
    """For each (host, path) of ``paths`` its ``template``, ``purity``, ``labels`` and ``bad_labels`` (of the template), and the
    share of bad labels in the whole table.

    ``paths``: host, path, pages, good, bad (numbers of pages and of labelled ones), each (host, path) once. ``smooth`` labels
    of the parent's purity are added to each node's own.
    """
    table = paths.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    prior = (table["bad"] + 1.0) / (table["bad"] + table["good"] + 2.0)
    segments = F.split(F.regexp_replace("path", "^/", ""), SEP)
    now = paths.withColumn("segments", F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(segments))
    hosts = now.groupBy("host").agg(F.sum("good").alias("node_good"), F.sum("bad").alias("node_bad"))
    now = spread_join(now, hosts, ["host"], ["path"]).withColumns({"template": F.lit(""), "purity": F.lit(prior)})
    done, level = [], 0
    while True:
        labels = F.col("node_good") + F.col("node_bad")
        purity = (F.col("node_bad") + F.lit(smooth) * F.col("purity")) / (labels + F.lit(smooth))
        now = saved(now.withColumns({"purity": purity, "labels": labels, "open": (labels >= 2 * min_labels) & (F.col("node_good") > 0) & (F.col("node_bad") > 0) & (F.size("segments") > level)}))
        done.append(now.where("NOT open").select("host", "path", "template", "purity", "labels", F.col("node_bad").alias("bad_labels")))
        now = now.where("open").drop("open", "labels", "node_good", "node_bad").withColumn("segment", F.get("segments", F.lit(level)))
        if now.isEmpty():
            break
        sums = [F.sum(c).alias(c) for c in ("pages", "good", "bad")]
        deep = F.sum(F.when(F.size("segments") > level + 1, F.col("pages")).otherwise(0)).alias("deep")
        child = saved(now.groupBy("host", "template", "segment").agg(*sums, deep, F.first("purity").alias("purity")))
        branch = saved(_branches(child, min_pages, min_labels, z, smooth))
        node = branch.groupBy("host", "template", "name").agg(F.sum("good").alias("node_good"), F.sum("bad").alias("node_bad"))
        named = spread_join(branch.select("host", "template", "segment", "name"), node, ["host", "template", "name"], ["segment"])
        now = spread_join(now, named, ["host", "template", "segment"], ["path"])
        now = now.withColumn("template", F.concat("template", F.lit(SEP), "name")).drop("segment", "name")
        level += 1
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    return found, prior


def least_share(bad: Column, labels: Column, z: float) -> Column:
    """The lower limit of a share of bad labels, ``z`` standard errors away (Wilson's interval); 0 without labels."""
    n, z2 = F.greatest(labels, F.lit(1)).cast("double"), z * z
    share = bad / n
    low = (share + z2 / (2 * n) - F.lit(z) * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    return F.when(labels > 0, F.greatest(low, F.lit(0.0))).otherwise(F.lit(0.0))


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    lift: float = LIFT,
    max_purity: float = MAX_PURITY,
    evidence: tuple[int, float] = EVIDENCE,
    **options,
) -> DataFrame:
    """One row per row of ``pages``: ``page_id``, ``host``, ``path``, ``rule``, ``verdict`` (allow or block), ``template``,
    ``purity``, ``labels`` (of the template) and ``decided_by`` (rule or method).

    ``labels``: page_id, bad (boolean); it trains the method. The verdict is the longest fitting rule's action, or else
    block where the template's smoothed share of bad labels is over ``lift`` times the table's share, or over ``max_purity``,
    and ``evidence`` (labels, standard errors) supports it: so many labels, and a lower limit over the table's share.
    A null or odd url has an empty host and path, which are a template of their own. Null ids and labels of unknown pages
    train nothing; several labels of one page each count. Repeated rows each get the verdict. Paths of any length and
    depth are kept whole. An empty table gives no rows, and one without labels blocks nothing.
    """
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    sides = labels.where("bad IS NOT NULL").groupBy("page_id").agg(F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad"))
    counted = rows.join(sides, "page_id", "left").groupBy("host", "path")
    paths = counted.agg(F.count(F.lit(1)).alias("pages"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    found, prior = templates(saved(paths), **options)
    out = spread_join(rows, found, ["host", "path"], ["page_id"], "left")
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    known = (F.col("labels") >= evidence[0]) & (least_share(F.col("bad_labels"), F.col("labels"), evidence[1]) > prior)
    method = F.when((F.col("purity") > min(lift * prior, max_purity)) & known, F.lit("block")).otherwise(F.lit("allow"))
    decided = F.when(action.isNotNull(), F.lit("rule")).otherwise(F.lit("method"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, method).alias("verdict"), "template", "purity", "labels", decided.alias("decided_by"))
