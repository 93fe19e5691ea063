"""Near-duplicate documents by an LSH forest over MinHash signatures, with links confirmed on the full shingle sets.

1. *Sets*: each text's distinct five-word shingles, as 64-bit hashes; their MinHash values in several orders (trees);
   texts of equal sets are one class, and only the classes' representatives (least ids) go on.
2. *Regions*: in each tree the representatives that share a prefix of ``depth`` values form a region. A region's rows
   are sorted by the tree's further values, and each is a candidate with its neighbour, which is the row with the
   longest common prefix; regions with many rows are first divided by those further values and then by hash, so the
   depth grows with a region's density. Each row is also a candidate with the region's least id.
3. *Links*: candidates whose signatures come near the threshold are compared on their full sets; confirmed links give
   components.
4. *The rest*: regions that still hold more than one component are compared block by block: every pair of rows of
   different components whose signatures come near the threshold is confirmed on the full sets too. No candidate is
   dropped for a region's size; a region within one component, however large, costs nothing here.
5. *The exact way* (``exact=True``): linked sets share one of their rarest shingles, of which a set of n needs the first
   n less its least overlap plus one in any order that all sets keep. Sets that share such a shingle are one more kind
   of region, compared block by block without the signatures, so no link is left to chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwork.llm.common import release, saved, spread_join
from strandwork.llm.graph import components

WORDS = 5
TREES, DEPTH, LEVELS = 32, 4, 5
KNOWN_WORDS = 500_000
REGION, BLOCK_BYTES = 2048, 8 << 20
#: A pair is compared in full where its signature agrees in at least the threshold less five standard errors.
SLACK = 5.0
#: Counters (a power of two) that order shingles by how often they occur; the driver and each task hold one number for each.
COUNTERS = 1 << 18
_M = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(raw: bytes, known: dict, width: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text in UTF-8: A-Z in lower case, words at ASCII white space."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(known.__getitem__, words)), np.uint64)
    n = max(len(h) - width + 1, 1)
    key = np.full(n, min(len(h), width), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(len(h), width)):
            key = (key ^ (key >> np.uint64(29))) * _M + h[i : n + i]
        key = (key ^ (key >> np.uint64(32))) * _M
        key ^= key >> np.uint64(29)
    return np.unique(key)


def _class_of(keys: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(keys.tobytes()) - (1 << 63)


def _counter(keys: np.ndarray, counters: int) -> np.ndarray:
    return (keys >> np.uint64(65 - counters.bit_length())).astype(np.int64)


def _orders(trees: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    n = trees * levels
    return rng.integers(0, 1 << 63, n, np.uint64) << np.uint64(1) | np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def signature(keys: np.ndarray, mult: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions, its high 32 bits."""
    low = np.full(len(mult), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(keys), 256):
            low = np.minimum(low, (keys[i : i + 256, None] * mult + plus).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def _sets(docs: DataFrame, width: int, trees: int, levels: int) -> DataFrame:
    """``docs`` (doc_id, text_key, text) as doc_id, text_key, set size, class (a hash of the set) and signature. The last two
    are null for an empty set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        mult, plus = _orders(trees, levels)
        for batch in batches:
            if len(known) > KNOWN_WORDS:
                known.clear()
            sizes, classes, sigs = [], [], []
            for text in batch.column(2):
                keys = shingles(text.as_buffer().to_pybytes() if text.is_valid else b"", known, width)
                sizes.append(len(keys))
                classes.append(_class_of(keys) if len(keys) else None)
                sigs.append(signature(keys, mult, plus).tobytes() if len(keys) else None)
            cols = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_key", "n", "class", "sig"])

    return docs.mapInArrow(run, f"doc_id {kind}, text_key long, n long, class long, sig binary")


def _leaves(sigs: DataFrame, trees: int, depth: int, levels: int) -> DataFrame:
    """For each class and tree a ``prefix`` (a hash of the tree and its first ``depth`` values) and ``deeper``, its next two at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = np.arange(1, trees + 1, dtype=np.uint64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, trees, levels).astype(np.uint64)
            key = np.broadcast_to(tree, (n, trees)).copy()
            with np.errstate(over="ignore"):
                for i in range(depth):
                    key = (key ^ (key >> np.uint64(29))) * _M + rows[:, :, i]
                key = (key ^ (key >> np.uint64(32))) * _M
            deeper = np.zeros((n, trees), np.uint64)
            for i in range(depth, min(levels, depth + 2)):
                deeper |= rows[:, :, i] << np.uint64(32 * (depth + 1 - i))
            each = batch.column(0).take(pa.array(np.repeat(np.arange(n), trees)))
            yield pa.RecordBatch.from_arrays([each, *(pa.array(x.reshape(-1).view(np.int64)) for x in (key, deeper))], names=["class", "prefix", "deeper"])

    return sigs.mapInArrow(run, "class long, prefix long, deeper long")


def _agreeing(pairs: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) of classes whose signatures agree in at least ``least`` values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
                near = pa.array((one == two).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"])

    one = sigs.select(F.col("class").alias("a"), F.col("sig").alias("sig_a"))
    two = sigs.select(F.col("class").alias("b"), F.col("sig").alias("sig_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _common_enough(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    if 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
        return False
    at = np.searchsorted(one, two)
    both = int((one[np.minimum(at, len(one) - 1)] == two).sum())
    return 100 * both >= percent * (len(one) + len(two) - both)


def _full_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``class`` and ``keys`` (the full set) of the classes in ``wanted``; only the texts that stand for them are read.

    ``classes`` names for each class the row of ``docs`` that stands for it."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            if len(known) > KNOWN_WORDS:
                known.clear()
            rows = [shingles(t.as_buffer().to_pybytes(), known, width).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["class", "keys"])

    wanted = wanted.distinct().join(classes, "class").select("class", F.col("row.doc_id").alias("wanted_id"), F.col("row.text_key").alias("wanted_key"))
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(F.col("wanted_id")) & (docs["text_key"] == F.col("wanted_key")))
    return saved(texts.select("class", "text").mapInArrow(sets, "class long, keys binary").dropDuplicates(["class"]))


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are linked on their full sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                _common_enough(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                for x, y in zip(batch.column(2), batch.column(3))
            ]
            at = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(at), batch.column(1).filter(at)], names=["a", "b"])

    full = _full_sets(pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))), classes, docs, width)
    one = full.select(F.col("class").alias("a"), F.col("keys").alias("keys_a"))
    two = full.select(F.col("class").alias("b"), F.col("keys").alias("keys_b"))
    linked = saved(pairs.join(one, "a").join(two, "b").select("a", "b", "keys_a", "keys_b").mapInArrow(compare, "a long, b long"))
    release(full)
    return linked


def _frequencies(docs: DataFrame, width: int, counters: int) -> np.ndarray:
    """How often the shingles of each counter occur in ``docs``: counted in the tasks, added up by counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = _Hashes(), np.zeros(counters, np.int64)
        for batch in batches:
            if len(known) > KNOWN_WORDS:
                known.clear()
            for text in batch.column(0):
                if text.is_valid:
                    np.add.at(counts, _counter(shingles(text.as_buffer().to_pybytes(), known, width), counters), 1)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["counter", "n"])

    each = docs.select("text").mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(counters, np.int64)
    counts[each["counter"].to_numpy(np.int64)] = each["n"].to_numpy(np.int64)
    return counts


def _rare_shingles(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``prefix`` (a shingle) and ``class``: the rarest shingles of each class, one of which a linked class shares, if
    another class has them among its rarest."""
    counters = COUNTERS
    order = docs.sparkSession.sparkContext.broadcast(_frequencies(docs, width, counters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            if len(known) > KNOWN_WORDS:
                known.clear()
            rare, classes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for text in batch.column(0):
                keys = shingles(text.as_buffer().to_pybytes(), known, width) if text.is_valid else ()
                if len(keys):
                    least = -(-len(keys) * percent // 100)  # what a linked set shares of this one
                    rare.append(keys[np.argsort(order.value[_counter(keys, counters)], kind="stable")[: len(keys) - least + 1]])
                    classes.append(np.full(len(rare[-1]), _class_of(keys), np.int64))
            cols = [pa.array(np.concatenate(rare).view(np.int64)), pa.array(np.concatenate(classes))]
            yield pa.RecordBatch.from_arrays(cols, names=["prefix", "class"])

    each = saved(docs.select("text").mapInArrow(run, "prefix long, class long").distinct())
    shared = each.groupBy("prefix").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo != hi").select("prefix")
    kept = saved(spread_join(each, shared, ["prefix"], ["class"]))
    release(each)
    return kept


def _links_across(members: DataFrame, sigs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, least: int, percent: int, seen: int = 2) -> DataFrame:
    """Links (a, b) between components that have linked rows in a region, from all pairs of blocks of rows.

    ``members``: prefix, class, n, component. Regions of ``seen`` rows have been compared before; of regions with the same
    rows one is enough. A region of m blocks of BLOCK_BYTES of sets is dealt as m * (m + 1) / 2 block pairs. A task compares
    every pair of rows of different components: by signature, and on the full sets where that comes near. A link that
    it finds makes one component of two, whose rows need no more comparing; so its result is at most one link a row.
    """
    whole = F.expr("bit_xor(xxhash64(class))")
    mixed = members.groupBy("prefix").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("rows"), whole.alias("print"), F.sum("n").alias("size"))
    mixed = mixed.where(F.expr("lo != hi") & (F.col("rows") > seen)).groupBy("print", "rows").agg(F.min("prefix").alias("prefix"), F.min("size").alias("size"))
    mixed = saved(mixed.select("prefix", F.ceil(F.col("size") * 8 / BLOCK_BYTES).cast("int").alias("blocks")))
    held = saved(spread_join(members, mixed, ["prefix"], ["class"]))
    sets = _full_sets(held.select("class"), classes, docs, width)
    full = sets.join(sigs, "class")
    rows = held.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("prefix", "class", "component", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")).join(full, "class")

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["block", "class"], ignore_index=True)
        sig = np.frombuffer(b"".join(frame["sig"]), np.uint32).reshape(len(frame), -1)
        keys = [np.frombuffer(x, np.uint64) for x in frame["keys"]]
        size = np.array([len(x) for x in keys])
        named, block = frame["component"].to_numpy(), frame["block"].to_numpy()
        comp = named.copy()
        across = frame["one"].iat[0] != frame["two"].iat[0]
        a, b = [], []
        for i in range(len(frame) - 1):
            rest = np.arange(i + 1, len(frame))
            rest = rest[(comp[rest] != comp[i]) & (100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i]))]
            if across:
                rest = rest[block[rest] != block[i]]
            if len(rest):
                for j in rest[(sig[rest] == sig[i]).sum(axis=1) >= least]:
                    if comp[j] != comp[i] and _common_enough(keys[i], keys[j], percent):
                        a.append(named[i])
                        b.append(named[j])
                        comp[comp == comp[j]] = comp[i]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    found = saved(dealt.groupBy("prefix", "one", "two").applyInPandas(links, "a long, b long"))
    release(mixed, held, sets)
    return found


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (class, n, component) after ``links`` (a, b) between components. A component stands for its rows here, so
    the links that made it do not go round again."""
    least = components(links).select(F.col("node").alias("component"), F.col("component").alias("least"))
    moved = spread_join(labels, least, ["component"], ["class"], "left")
    return saved(moved.select("class", "n", F.coalesce("least", "component").alias("component")))


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WORDS,
    percent: int = 75,
    trees: int = TREES,
    depth: int = DEPTH,
    levels: int = LEVELS,
    exact: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``text_key`` (hash of the text), ``n_shingles``, ``component_id`` (least
    id reachable over links, itself included), ``kept`` (doc_id = component_id) and ``group_key``, which linked rows share
    whatever their ids are (null where a text has no shingle).

    Texts are linked where their shingle sets have 100 * intersection >= percent * union. A text of fewer than five
    words has its whole word sequence as one shingle; a null, empty or blank text has no shingle and no links. Rows
    that repeat an id are judged by their texts, each for itself. A null id may be linked but names no component; where
    a component has no other id, its component is null and it is kept. A text of any length has its whole set in memory,
    in the task that hashes it and in those that compare it. Other columns are not read. An empty table gives no rows.
    Recall: at similarity 0.75 a pair shares no region with probability 5e-6 for the default trees, and its signature falls
    short with 3e-7; above the threshold both fall fast. With ``exact`` no link is lost, for two more passes over the texts
    and a table of about a quarter of their shingles.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    sets = saved(_sets(rows, width, trees, levels))
    linked = sets.where("n > 0")
    row = F.struct("doc_id", "text_key")
    each = linked.groupBy("class").agg(F.min("n").alias("n"), F.min("doc_id").alias("low"), F.min(row).alias("row"), F.min("sig").alias("sig"))
    classes = saved(each)
    sigs = classes.select("class", "sig")
    total = trees * levels
    least = int(total * (percent / 100 - SLACK * (percent / 100 * (1 - percent / 100) / total) ** 0.5))

    leaves = _leaves(sigs, trees, depth, levels)
    regions = leaves.groupBy("prefix").agg(F.count(F.lit(1)).alias("rows"), F.min("class").alias("head")).where("rows > 1")
    members = saved(spread_join(leaves, regions, ["prefix"], ["class"]))
    part = (
        F.when(F.col("rows") <= REGION, F.lit(0).cast("long"))
        .when(F.col("rows") <= REGION * 16, F.shiftrightunsigned("deeper", 32))
        .otherwise(F.xxhash64("deeper", F.pmod(F.xxhash64("class"), F.ceil(F.col("rows") / REGION))))
    )
    order = Window.partitionBy("prefix", "part").orderBy("deeper", "class")
    beside = members.where("rows > 2").withColumn("part", part).withColumn("near", F.lag("class").over(order)).where("near IS NOT NULL")
    pairs = members.where("class != head").select(F.col("head").alias("a"), F.col("class").alias("b"))
    pairs = pairs.union(beside.select(F.least("near", "class").alias("a"), F.greatest("near", "class").alias("b"))).distinct()
    first = saved(_agreeing(pairs, sigs, least))
    named = classes.select("class", "row")
    edges = _confirmed(first, named, rows, width, percent)
    found = components(edges).withColumnRenamed("node", "class")
    labels = saved(classes.select("class", "n").join(found, "class", "left").withColumn("component", F.coalesce("component", "class")))

    def placed(regions: DataFrame) -> DataFrame:
        return saved(regions.select("prefix", "class").join(labels, "class"))

    known = placed(members)
    across = _links_across(known, sigs, named, rows, width, least, percent)
    labels = _joined(labels, across)
    release(known, across)
    if exact:
        rare = _rare_shingles(rows, width, percent)
        known = placed(rare)
        last = _links_across(known, sigs, named, rows, width, 0, percent, seen=1)
        labels = _joined(labels, last)
        release(rare, known, last)
    rooted = classes.select("class", "low").join(labels.select("class", F.col("component").alias("root")), "class")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    rooted = saved(spread_join(rooted, lows, ["root"], ["class"]).select("class", "component_id", F.col("root").alias("group_key")))
    release(classes, members, first, edges)
    out = spread_join(sets.select("doc_id", "text_key", "n", "class"), rooted, ["class"], ["doc_id", "text_key"], "left")
    component = F.coalesce("component_id", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), "group_key")
