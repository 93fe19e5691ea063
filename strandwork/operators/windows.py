"""From sequences to N-free chunks, k-mers and windows of k-mers on both strands.

Columns are added step by step: ``id, seq`` -> chunks (``chunk_id, chunk_offset, chunk``) -> passes (``offset, rc``) ->
windows (``window_idx, kmers, coords``). Every step is linear in a chunk's length: k-mers are cut from a strand's bytes,
where a place needs no search, by expressions that Spark compiles, and a window's row holds the window only, not its chunk.
Long chunks are cut into tiles first (``passes(..., tile=...)``), which gives the same k-mers and windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.functions.columns import SLOTS, apart, one_hot_bits, reverse_complement
from strandwork.functions.draws import draw

RUN = "N{3,}"
BLOCK = 256
#: K-mers of windows up to this size are an expression each; those of larger ones come from one regular expression.
UNROLLED = 16


def starts_of(sizes: str) -> Column:
    """The sums of all earlier elements of an array, by blocks: appending to one array would copy it each time."""
    zero = F.lit(0).cast("bigint")
    blocks = F.sequence(F.lit(0), F.expr(f"greatest(size({sizes}) - 1, 0) div {BLOCK}").cast("int"))

    def of_block(b: Column) -> Column:
        return F.slice(sizes, b * BLOCK + 1, BLOCK)

    def running(first: Column, part: Column) -> Column:
        return F.slice(F.aggregate(part, F.array(first), lambda a, n: F.array_append(a, F.element_at(a, -1) + n)), F.lit(1), F.size(part))

    sums = F.transform(blocks, lambda b: F.aggregate(of_block(b), zero, lambda a, n: a + n))
    return F.flatten(F.zip_with(running(zero, sums), blocks, lambda first, b: running(first, of_block(b))))


def split_chunks(sequences: DataFrame, *, seq_col: str = "seq", keep_case: bool = False) -> DataFrame:
    """A row for each chunk between runs of three or more N: ``chunk_id``, ``chunk_offset`` (in the sequence), ``chunk``.

    A chunk that follows a run keeps the run's last two N. Empty bodies are dropped (sequences of N alone, runs at
    either end). Lower case is raised first; with ``keep_case`` only capital N counts and case stays.
    """
    seq = F.col(seq_col) if keep_case else F.upper(seq_col)
    df = apart(sequences.where(F.col(seq_col).isNotNull()), "__seq", seq)
    df = apart(df, "__bodies", F.split("__seq", RUN, -1))
    runs = F.transform(F.regexp_extract_all("__seq", F.lit(RUN), 0), F.length)
    df = apart(df, "__sizes", F.zip_with(F.transform("__bodies", F.length), runs, lambda b, r: (b + F.coalesce(r, F.lit(0))).cast("bigint")))
    df = apart(df, "__starts", starts_of("__sizes"))
    each = df.select(*sequences.columns, F.inline(F.arrays_zip(F.col("__bodies").alias("__body"), F.col("__starts").alias("__start"), F.sequence(F.lit(0), F.size("__bodies") - 1).alias("__i"))))
    later = F.col("__i") > 0
    return each.where("__body != ''").select(
        *sequences.columns,
        F.col("__i").alias("chunk_id"),
        (F.col("__start") - F.when(later, 2).otherwise(0)).alias("chunk_offset"),
        F.concat(F.when(later, "NN").otherwise(""), "__body").alias("chunk"),
    )


def passes(chunks: DataFrame, k: int, *, sliding: bool = True, both_strands: bool = True, offset: int = 0, tile: int = 0, coded: bool = False) -> DataFrame:
    """Each chunk once for each ``offset`` (0 to k - 1, or one) and strand ``rc``, with the bases of that ``strand``: one
    job in place of 2k scans. A chunk is complemented once, not for each offset.

    With ``tile`` (a multiple of k times the window size) a strand longer than this is cut into tiles that overlap by k
    bases, so that no row below this point is larger; ``tile_start`` is a tile's place in its strand. With ``coded`` the
    strand is there as one-hot text too, once for all offsets, for ``windows`` to cut ``bits`` from.
    """
    if tile % k:
        raise ValueError("a tile is a multiple of k")
    offsets = F.sequence(F.lit(0), F.lit(k - 1)) if sliding else F.array(F.lit(offset))
    strands = [F.struct(F.lit(False).alias("rc"), F.col("chunk").alias("strand"))]
    if both_strands:
        strands.append(F.struct(F.lit(True).alias("rc"), reverse_complement(F.col("chunk")).alias("strand")))
    both = chunks.withColumn("chunk_len", F.length("chunk")).select("*", F.inline(F.array(*strands))).drop("chunk")
    if tile:
        short = F.length("strand") <= tile
        both = apart(both, "__tiles", F.when(short, F.array("strand")).otherwise(F.regexp_extract_all("strand", F.lit(f"(?s).{{1,{tile}}}"), 0)))
        lapped = F.transform("__tiles", lambda t, i: F.struct((i * tile).alias("tile_start"), F.length(t).alias("tile_len"), F.concat(t, F.coalesce(F.left(F.get("__tiles", i + 1), F.lit(k)), F.lit(""))).alias("strand")))
        both = both.select(*(c for c in both.columns if c not in ("strand", "__tiles")), F.inline(lapped))
    else:
        both = both.withColumns({"tile_start": F.lit(0), "tile_len": F.col("chunk_len")})
    if coded:
        both = apart(both, "coded", one_hot_bits(F.col("strand")))
    return both.select("*", F.explode(offsets).alias("offset"))


def _with_strand(passed: DataFrame) -> DataFrame:
    """Chunks that were given an offset and a strand by hand get the columns of ``passes``."""
    if "strand" in passed.columns:
        return passed
    bases = F.when(F.col("rc"), reverse_complement(F.col("chunk"))).otherwise(F.col("chunk"))
    return passed.withColumns({"chunk_len": F.length("chunk"), "tile_start": F.lit(0), "tile_len": F.length("chunk"), "strand": bases}).drop("chunk")


def _counted(passed: DataFrame, k: int, *, keep_last: bool = False, least: int = 1) -> DataFrame:
    """``n_kmers``: the number of k-mers of each chunk (or tile) from its offset, in steps of k, on the strand of ``rc``, and
    ``bytes``, the strand where each of its characters is one byte.

    A k-mer that ends exactly where the chunk ends is left out unless ``keep_last``. Passes of fewer than ``least``
    k-mers are left out before any is cut.
    """
    passed = _with_strand(passed)
    fits = F.length("strand") - F.col("offset") - (0 if keep_last else 1)
    n = F.greatest(F.least(F.floor(fits / k), F.floor(F.col("tile_len") / k)), F.lit(0)).cast("int")
    plain = F.when(F.octet_length("strand") == F.length("strand"), F.col("strand").cast("binary"))
    return passed.withColumns({"n_kmers": n, "bytes": plain}).where(F.col("n_kmers") >= least)


def _cut(start: Column, size: Column | int) -> Column:
    """``size`` bases of the strand from ``start`` (from 0)."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(F.col("bytes").isNotNull(), F.substring("bytes", start + 1, size).cast("string")).otherwise(F.substring("strand", start + 1, size))


def coordinates(i: Column, k: int) -> Column:
    """First and last base (from 0, both included, on the forward strand of the sequence) of k-mer ``i`` of a pass."""
    s = F.col("offset") + F.col("tile_start") + i * k
    first = F.col("chunk_offset") + F.when(F.col("rc"), F.col("chunk_len") - s - k).otherwise(s)
    return F.struct(first.alias("start"), (first + (k - 1)).alias("end"))


def kmers(passed: DataFrame, k: int, *, keep_last: bool = False) -> DataFrame:
    """A row for each k-mer: ``kmer_idx``, ``kmer``, ``start`` and ``end``."""
    df = _counted(passed, k, keep_last=keep_last)
    each = df.select("*", F.explode(F.sequence(F.lit(0), F.col("n_kmers") - 1)).alias("__i"))
    each = each.withColumn("kmer", _cut(F.col("offset") + F.col("__i") * k, k)).drop("strand", "bytes", "tile_len", "n_kmers")
    at = coordinates(F.col("__i"), k)
    each = each.withColumns({"kmer_idx": F.col("__i") + F.expr(f"tile_start div {k}").cast("int"), "start": at["start"], "end": at["end"]})
    return each.drop("__i", "tile_start", "chunk_len")


def windows(passed: DataFrame, k: int, window_size: int, *, full_only: bool = False, with_coords: bool = False, ahead: int = 0) -> DataFrame:
    """Consecutive groups of ``window_size`` k-mers of one chunk: ``window_idx``, ``kmers`` and, if asked for, ``coords``
    and ``ahead``, the next so many windows of the pass (fewer at its end; of one tile).

    The last group of a chunk may be shorter, unless ``full_only``. There are no empty windows. Passes that are ``coded`` give
    ``bits`` too: the window's bases as one-hot text.
    """
    df = _counted(passed, k, least=window_size if full_only else 1)
    n = F.col("n_kmers") / window_size
    count = (F.floor(n) if full_only else F.ceil(n)).cast("int")
    kept = [c for c in df.columns if c not in ("strand", "bytes", "coded", "tile_len", "n_kmers", "chunk_len", "tile_start")]
    if "coded" in df.columns:
        df = df.withColumn("coded", F.col("coded").cast("binary"))
    each = df.withColumn("__count", count).select("*", F.explode(F.sequence(F.lit(0), F.col("__count") - 1)).alias("__w"))
    w, span = F.col("__w"), k * window_size

    def held(w: Column) -> Column:
        return F.greatest(F.least(F.col("n_kmers") - w * window_size, F.lit(window_size)), F.lit(0))

    def several(items: list[Column], w: Column) -> Column:
        every = F.array(*items)
        return every if full_only else F.slice(every, F.lit(1), held(w))

    def cut(w: Column) -> Column:
        start = F.col("offset") + w * span
        if window_size > UNROLLED:
            return F.regexp_extract_all(_cut(start, held(w) * k), F.lit(f"(?s).{{{k}}}"), 0)
        return several([_cut(start + i * k, k) for i in range(window_size)], w)

    parts = {"kmers": cut(w)}
    if "coded" in df.columns:
        width = len(SLOTS)
        parts["bits"] = F.substring("coded", (F.col("offset") + w * span) * width + 1, held(w) * (k * width)).cast("string")
    if with_coords and window_size > UNROLLED:
        parts["coords"] = F.transform(F.sequence(w * window_size, w * window_size + held(w) - 1), lambda i: coordinates(i, k))
    elif with_coords:
        parts["coords"] = several([coordinates(w * window_size + i, k) for i in range(window_size)], w)
    if ahead:
        parts["ahead"] = F.slice(F.array(*(cut(w + s) for s in range(1, ahead + 1))), F.lit(1), F.greatest(F.least(F.col("__count") - 1 - w, F.lit(ahead)), F.lit(0)))
    idx = w + F.expr(f"tile_start div {span}").cast("int")
    return each.select(*kept, *(c.alias(name) for name, c in parts.items()), idx.alias("window_idx"))


def batches(df: DataFrame, batch_size: int, *, key: list[str], seed: int = 42, drop_last: bool = True) -> DataFrame:
    """``df`` with ``batch_idx`` and ``batch_row``: all rows in an order drawn by ``key``, cut every ``batch_size`` rows.

    One short batch may remain in all, which is dropped unless asked otherwise. The draw's upper bits are buckets, which
    are counted first, so that one bucket's rows are numbered in one task and never the whole table.
    """
    drawn = df.withColumn("__draw", draw(seed, "batch", *(F.col(c) for c in key))).withColumn("__bucket", F.shiftright("__draw", 16))
    counts = drawn.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(whole).alias("__all"))
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy("__draw", *key))
    ranked = drawn.withColumn("__at", place).join(starts, "__bucket").withColumn("__at", F.col("__at") + F.col("__start") - 1)
    if drop_last:
        ranked = ranked.where(F.expr(f"__at < __all div {batch_size} * {batch_size}"))
    numbered = ranked.withColumns({"batch_idx": F.expr(f"__at div {batch_size}"), "batch_row": F.expr(f"cast(__at % {batch_size} as int)")})
    return numbered.drop("__draw", "__bucket", "__start", "__all", "__at")
