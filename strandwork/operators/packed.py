"""K-mers as numbers: counts by packed canonical k-mers, long ones dealt as runs with one minimizer, and exact vocabularies
behind a sketch.

A k-mer is a number with a digit to the base five for each letter (A, C, G, T, and N for any other), so up to MAX_K letters
fit a long. Its canonical form is the lesser of it and its reverse complement: both strands of a place are one number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


MAX_K = 27
#: K-mers of so many letters at most repeat so often that tasks count them before they are dealt.
SHORT_K = 10
#: Letters of a minimizer, and letters that a task takes at a time.
MINIMIZER, PART = 8, 1 << 20
#: Distinct k-mers that a task counts before it gives them out.
HELD = 1 << 20
_CODES = np.full(256, 4, np.uint8)
_CODES[[ord(c) for c in "ACGT"]] = range(4)
_END = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _numbers(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The canonical numbers of the windows of k letters, which of them lie within one chunk, and which are their own reverse
    complement. Chunks are apart by an _END."""
    n = max(len(codes) - k + 1, 0)
    forward, back, power = np.zeros(n, np.int64), np.zeros(n, np.int64), 1
    other = np.where(codes < 4, 3 - codes, 4).astype(np.int64)
    for j in range(k):
        forward = forward * 5 + codes[j : j + n]
        back += other[j : j + n] * power
        power *= 5
    ends = np.append(0, np.cumsum(codes == _END))
    return np.minimum(forward, back), ends[k:][:n] == ends[:n], forward == back


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n, have = len(values) - width + 1, 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values[:n]


def _parts(chunks: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Codes of chunks, an _END behind each, about PART letters at a time; long chunks in parts that overlap by k - 1."""
    held, size = [], 0
    for chunk in chunks:
        data = np.frombuffer(chunk.as_buffer(), np.uint8) if chunk.is_valid and len(chunk.as_py()) else np.zeros(0, np.uint8)
        for at in range(0, max(len(data) - k + 1, 0), PART):
            held += [_CODES[data[at : at + PART + k - 1]], np.array([_END], np.uint8)]
            size += len(held[-2])
            if size >= PART:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _counted(chunks: DataFrame, k: int, keep=None) -> DataFrame:
    """``kmer``, ``n`` and ``own`` (its own reverse complement), counted by tasks. ``keep`` tells which numbers may count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

        for batch in batches:
            for codes in _parts(batch.column(0), k):
                kmer, inside, own = _numbers(codes, k)
                kmer, own = kmer[inside], own[inside]
                if keep is not None:
                    kept = keep(kmer)
                    kmer, own = kmer[kept], own[kept]
                held = _summed(np.append(held[0], kmer), np.append(held[1], np.ones(len(kmer), np.int64)), np.append(held[2], own))
                if len(held[0]) >= HELD:
                    yield _batch(held)
                    held = held[0][:0], held[1][:0], held[2][:0]
        yield _batch(held)

    return chunks.select("chunk").mapInArrow(run, "kmer long, n long, own boolean")


def runs(chunks: DataFrame, k: int) -> DataFrame:
    """``minimizer`` and ``bases``: runs of neighbouring k-mers with the same minimizer, as the letters that they cover, and
    ``n``, how often a task has them. Equal k-mers, of either strand, are in runs of the same minimizer.

    A k-mer's minimizer is the least of its canonical m-mers in the order of a hash, so that no simple repeat draws most runs.
    """
    m = min(MINIMIZER, k - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes in _parts(batch.column(0), k):
                _, inside, _ = _numbers(codes, k)
                short, _, _ = _numbers(codes, m)
                mixed = ((short.astype(np.uint64) * _MIX) >> np.uint64(1)).astype(np.int64)
                least = _least(mixed, k - m + 1)
                at = np.flatnonzero(inside)
                if not len(at):
                    continue
                first = np.flatnonzero(np.append([True], (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]])))
                size = np.diff(np.append(first, len(at))) + k - 1
                offsets = np.append(0, np.cumsum(size))
                where = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - at[first], size)
                letters = np.frombuffer(b"ACGTN", np.uint8)[codes[where]]
                bases = pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(letters.tobytes()))
                table = pa.table({"minimizer": least[at[first]], "bases": bases, "n": np.ones(len(size), np.int64)})
                table = table.group_by(["minimizer", "bases"]).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["minimizer", "bases", "n"])
                yield from table.combine_chunks().to_batches()

    return chunks.select("chunk").mapInArrow(run, "minimizer long, bases string, n long")


def _summed(kmer: np.ndarray, n: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, first, at = np.unique(kmer, return_index=True, return_inverse=True)
    return found, np.bincount(at, n, len(found)).astype(np.int64), own[first]


def _batch(counts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in counts], names=["kmer", "n", "own"])


def _count_runs(dealt: DataFrame, k: int) -> DataFrame:
    """The k-mers of runs that lie in the order of their minimizers: a task holds those of one batch and one minimizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)), None
        for batch in batches:
            if not batch.num_rows:
                continue
            minimizer, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            codes = np.concatenate([x for b in batch.column(1) for x in (_CODES[np.frombuffer(b.as_buffer(), np.uint8)], np.array([_END], np.uint8))])
            sizes = pc.binary_length(batch.column(1)).to_numpy() - k + 1
            kmer, inside, own = _numbers(codes, k)
            kmer, own, n, of = kmer[inside], own[inside], np.repeat(n, sizes), np.repeat(minimizer, sizes)
            if last is not None and minimizer[0] != last:
                yield _batch(held)
                held = tuple(x[:0] for x in held)
            last = minimizer[-1]
            done = of != last
            closed = _summed(*(np.append(h, x[done]) for h, x in zip(held, (kmer, n, own), strict=True))) if done.any() else None
            if closed is not None:
                yield _batch(closed)
                held = tuple(x[:0] for x in held)
            held = _summed(*(np.append(h, x[~done]) for h, x in zip(held, (kmer, n, own), strict=True)))
        yield _batch(held)

    return dealt.mapInArrow(run, "kmer long, n long, own boolean")


def packed_counts(chunks: DataFrame, k: int) -> DataFrame:
    """``kmer`` (canonical number), ``n`` (its places on one strand) and ``own`` over all starts of all chunks; letters other
    than A, C, G and T are N.

    Short k-mers are counted by tasks and summed. Long ones hardly repeat within a task: their runs are dealt by minimizer,
    which takes a few letters for each k-mer, and are taken apart where they arrive, minimizer by minimizer, so equal k-mers
    are counted in one place without another shuffle. A task holds the distinct k-mers of one minimizer at a time.
    """
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k is 1 to {MAX_K}")
    if k <= SHORT_K:
        return _counted(chunks, k).groupBy("kmer", "own").agg(F.sum("n").alias("n"))
    return _count_runs(runs(chunks, k).repartition("minimizer").sortWithinPartitions("minimizer"), k)


def letters(kmer: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(kmer.cast("string"), 10, 5), k, "0"), "01234", "ACGTN")


def both_strands(packed: DataFrame, k: int) -> DataFrame:
    """``kmer`` (letters) and ``n`` of both strands, as ``stats.kmer_counts`` gives them; a k-mer that is its own reverse
    complement has its places of both strands."""
    from strandwork.functions.columns import reverse_complement

    text = packed.select(letters(F.col("kmer"), k).alias("kmer"), "own", "n")
    other = F.struct(reverse_complement(F.col("kmer")).alias("kmer"), F.col("n"))
    each = F.when(F.col("own"), F.array(F.struct("kmer", (2 * F.col("n")).alias("n")))).otherwise(F.array(F.struct("kmer", "n"), other))
    return text.select(F.inline(each))


def sketch(chunks: DataFrame, k: int, *, bits: int = 24, most: int = 255) -> DataFrame:
    """``block`` and ``counts``: how many k-mers' places fall into each of 2^bits buckets, up to ``most``, as bytes of blocks of
    buckets. Tasks count for themselves; blocks are added up, one row each."""
    size = 1 << min(bits, 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            for codes in _parts(batch.column(0), k):
                kmer, inside, own = _numbers(codes, k)
                at, n = np.unique(_bucket(kmer[inside], bits), return_counts=True)
                twice = np.bincount(np.searchsorted(at, _bucket(kmer[inside & own], bits)), minlength=len(at)) if len(at) else n
                counts[at] = np.minimum(counts[at].astype(np.int64) + n + twice, most)
        blocks = counts.reshape(-1, size)
        used = np.flatnonzero(blocks.any(1))
        for i in range(0, len(used), 64):
            rows = used[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array([blocks[r].tobytes() for r in rows], pa.binary())], names=["block", "counts"])

    def added(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, block = np.zeros(size, np.int64), 0
        for batch in group:
            block = batch.column(0)[0].as_py()
            for counts in batch.column(1):
                total = np.minimum(total + np.frombuffer(counts.as_buffer(), np.uint8), most)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.astype(np.uint8).tobytes()], pa.binary())], names=["block", "counts"])

    kind = "block int, counts binary"
    return chunks.select("chunk").mapInArrow(run, kind).groupBy("block").applyInArrow(added, kind)


def _bucket(kmer: np.ndarray, bits: int) -> np.ndarray:
    return ((kmer.astype(np.uint64) * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def retained(chunks: DataFrame, k: int, min_count: int, *, bits: int = 24) -> DataFrame:
    """The k-mers of ``packed_counts`` with ``min_count`` places or more on both strands together (``n`` counts one strand).

    A first pass counts places by hash bucket. A k-mer has no more places than its bucket, so those of lesser buckets are
    left out before any is dealt: most singletons, while there are fewer distinct k-mers than 2^bits buckets. What passes
    is counted exactly, so the result never depends on ``bits``, which bounds the filter (2^bits bits, broadcast) and a
    task's counters (2^bits bytes).
    """
    least = min(min_count, 255)
    full = sketch(chunks, k, bits=bits, most=255).collect()  # 2^bits bytes in all
    size = 1 << min(bits, 16)
    open_ = np.zeros(1 << bits, bool)
    for r in full:
        open_[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(bytes(r["counts"]), np.uint8) >= least
    known = chunks.sparkSession.sparkContext.broadcast(np.packbits(open_))

    def keep(kmer: np.ndarray) -> np.ndarray:
        at = _bucket(kmer, bits)
        return (known.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)

    sums = _counted(chunks, k, keep).groupBy("kmer", "own").agg(F.sum("n").alias("n"))
    return sums.where(F.when(F.col("own"), 2 * F.col("n")).otherwise(F.col("n")) >= min_count)
