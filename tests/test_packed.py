"""Packed k-mers, sketches and keyed permutations against the plain operators."""

import random

import pytest
from pyspark.sql import functions as F

from strandwork.functions import permute
from strandwork.functions.columns import canonical
from strandwork.operators import packed, stats, windows


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 5, 21, 22, 400, 3000)]
    texts += ["ACGT" * 60, "A" * 200, texts[-1][:900] + "N" + texts[-1][:300] + "NNRY" + texts[4], None, "acgtnac" * 9, texts[5]]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, seq string")
    return windows.split_chunks(df).withColumn("chunk", canonical(F.col("chunk"))).persist()


@pytest.mark.parametrize("k", [1, 2, 7, 11, 13, 21, 27])
def test_counts_equal_strings(chunks, k):
    found = packed.both_strands(packed.packed_counts(chunks.repartition(3), k), k)
    assert sorted(map(tuple, found.select("kmer", "n").collect())) == sorted(map(tuple, stats.kmer_counts(chunks, k).select("kmer", "n").collect()))


def test_counts_in_small_parts(chunks, monkeypatch):
    monkeypatch.setattr(packed, "PART", 50)
    import numpy as np
    import pyarrow as pa

    texts = [r.chunk for r in chunks.select("chunk").collect()]
    for k in (3, 13):
        total = sum(int(packed._numbers(codes, k)[1].sum()) for codes in packed._parts(pa.array(texts), k))
        assert total == sum(max(len(t) - k + 1, 0) for t in texts)
    assert packed._least(np.array([3, 1, 2, 5, 4]), 3).tolist() == [1, 1, 2]
    with pytest.raises(ValueError, match="k is"):
        packed.packed_counts(chunks, 28)


def test_long_kmers_move_fewer_bytes(spark, chunks):
    """Runs hold a few letters for each k-mer, and equal k-mers lie in runs of one minimizer."""
    found = packed.runs(chunks, 21)
    sums = found.agg(F.sum(F.length("bases")).alias("letters"), F.sum(F.length("bases") - 20).alias("kmers")).first()
    assert sums.letters * 3 < 21 * sums.kmers
    plan = packed.packed_counts(chunks, 21)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(minimizer") == plan.count("Exchange hashpartitioning") == 1
    assert packed.packed_counts(chunks.limit(0), 21).isEmpty() and packed.packed_counts(chunks.limit(0), 5).isEmpty()


@pytest.mark.parametrize("min_count", [1, 2, 5, 300])
@pytest.mark.parametrize("bits", [3, 18])
def test_retained_equal_exact(chunks, min_count, bits):
    k = 13
    exact = stats.vocabulary(stats.kmer_counts(chunks, k), min_count)
    found = packed.both_strands(packed.retained(chunks, k, min_count, bits=bits), k)
    assert sorted(map(tuple, found.select("kmer", "n").collect())) == sorted(map(tuple, exact.select("kmer", "n").collect()))


def test_sketch_leaves_out_singletons(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ACGT") for _ in range(5000)) for _ in range(4)]
    df = spark.createDataFrame([(t,) for t in [*texts, texts[0][:500]]], "chunk string")
    sizes = {bits: packed.sketch(df, 15, bits=bits).count() for bits in (10, 18)}
    assert sizes[10] == 1 and sizes[18] == 4
    assert packed.retained(df, 15, 2, bits=18).count() == 486
    few = packed.sketch(df, 15, bits=18).collect()
    open_ = sum(sum(1 for x in bytes(r.counts) if x >= 2) for r in few)
    assert 486 <= open_ < 2500  # buckets that let k-mers pass, of some 20,000 distinct ones


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 12, 100, 1023])
def test_permutation_is_a_bijection(spark, n):
    rows = spark.range(n).select("id", permute.position_of(F.col("id"), n, 3, 0).alias("a"), permute.position_of(F.col("id"), n, 3, 1).alias("b"))
    back = rows.select("id", "a", "b", permute.row_at(F.col("a"), n, 3, 0).alias("id_a"), permute.row_at(F.col("b"), n, 3, 1).alias("id_b")).collect()
    assert sorted(r.a for r in back) == sorted(r.b for r in back) == list(range(n))
    assert all(r.id == r.id_a == r.id_b for r in back)
    if n >= 100:
        assert sum(r.a == r.b for r in back) < 20
        mean = sum(r.a for r in back if r.id < n // 2) / (n // 2)
        assert 0.35 * n < mean < 0.65 * n
