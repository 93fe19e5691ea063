"""Chunks, k-mers, windows and encodings on literal and synthetic sequences."""

import random

import pytest
from pyspark.sql import functions as F

from strandwork.functions import columns as C
from strandwork.operators import stats, windows
from strandwork.plans import generators


def seqs(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, seq string")


def value(spark, column, **given):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in given.items())).select(column).first()[0]


def record(seed=5):
    """670 bases: 20, then nine times 19 N and 48 bases, then 19 N and 28 bases."""
    rng = random.Random(seed)

    def bases(n, head):
        return head + "".join(rng.choice("ACGT") for _ in range(n - len(head)))

    return bases(20, "ACT") + "".join("N" * 19 + bases(48, "A") for _ in range(9)) + "N" * 19 + bases(28, "A")


def one_pass(df, offset=0, rc=False):
    return df.withColumns({"offset": F.lit(offset), "rc": F.lit(rc)})


def test_complement_and_canonical(spark):
    s = "AGTCCCNTNNNNTAAGATTTAGAGACCAAAAA"
    assert value(spark, C.complement(F.col("s")), s=s) == "TCAGGGNANNNNATTCTAAATCTCTGGTTTTT"
    assert value(spark, C.reverse_complement(F.col("s")), s=s) == "TTTTTGGTCTCTAAATCTTANNNNANGGGACT"
    assert value(spark, C.canonical(F.col("s")), s="agtcnRx") == "AGTCNNN"
    assert value(spark, C.complement(F.col("s")), s="acR") == "NNN"


def test_split_chunks_of_the_record(spark):
    rows = windows.split_chunks(seqs(spark, record())).orderBy("chunk_id").collect()
    assert [(r.chunk_offset, len(r.chunk)) for r in rows] == [(0, 20), *((37 + 67 * i, 50) for i in range(9)), (640, 30)]
    assert all(record()[r.chunk_offset :].startswith(r.chunk) for r in rows)


@pytest.mark.parametrize(
    ("seq", "expected"),
    [
        ("", []),
        ("NNNNN", []),
        ("NN", [(0, "NN")]),
        ("NNNACG", [(1, "NNACG")]),
        ("ACGNNN", [(0, "ACG")]),
        ("ACNNGT", [(0, "ACNNGT")]),
        ("acnnngt", [(0, "AC"), (3, "NNGT")]),
        ("ANNNNCNNNG", [(0, "A"), (3, "NNC"), (7, "NNG")]),
    ],
)
def test_split_chunks_edges(spark, seq, expected):
    rows = windows.split_chunks(seqs(spark, seq)).orderBy("chunk_id").collect()
    assert [(r.chunk_offset, r.chunk) for r in rows] == expected


def test_split_chunks_keeps_case_and_null(spark):
    df = windows.split_chunks(seqs(spark, "acnnngt", None), keep_case=True)
    assert [r.chunk for r in df.collect()] == ["acnnngt"]


def test_kmers_of_offsets_and_strands(spark):
    chunk = windows.split_chunks(seqs(spark, "ACTGACTGACTGACTG"))

    def first(offset, rc=False):
        return windows.kmers(one_pass(chunk, offset, rc), 3).orderBy("kmer_idx").collect()

    assert [(r.kmer, r.start, r.end) for r in first(0)][:2] == [("ACT", 0, 2), ("GAC", 3, 5)]
    assert first(1)[0].kmer == "CTG"
    assert first(2)[0].kmer == "TGA"
    assert (first(0, True)[0].start, first(0, True)[0].end) == (13, 15)


@pytest.mark.parametrize(("length", "offset", "keep", "n"), [(6, 0, False, 1), (6, 0, True, 2), (7, 0, False, 2), (4, 1, False, 0), (5, 1, False, 1), (2, 2, False, 0), (1, 2, False, 0)])
def test_last_exact_kmer(spark, length, offset, keep, n):
    df = one_pass(windows.split_chunks(seqs(spark, "ACGTACGTAC"[:length])), offset)
    assert windows.kmers(df, 3, keep_last=keep).count() == n


def test_windows_of_the_record(spark):
    chunk = windows.split_chunks(seqs(spark, record()))
    rows = windows.windows(one_pass(chunk), 3, 3).orderBy("chunk_id", "window_idx").collect()
    assert len(rows) == 59
    assert rows[0].kmers[0] == "ACT"
    assert rows[2].kmers[0] == "NNA"
    full = windows.windows(one_pass(chunk), 3, 3, full_only=True, with_coords=True).orderBy("chunk_id", "window_idx").collect()
    assert [tuple(c) for c in full[0].coords] == [(0, 2), (3, 5), (6, 8)]
    assert [tuple(c) for c in full[2].coords] == [(37, 39), (40, 42), (43, 45)]
    back = windows.windows(one_pass(chunk, 0, True), 8, 2, full_only=True, with_coords=True).orderBy("chunk_id", "window_idx").collect()
    assert [tuple(c) for c in back[0].coords] == [(12, 19), (4, 11)]
    assert [tuple(c) for c in back[1].coords] == [(79, 86), (71, 78)]


def test_all_passes_cover_all_starts(spark):
    k, df = 4, windows.split_chunks(seqs(spark, "ACGTTGCANACGTTAGC"))
    rows = windows.kmers(windows.passes(df, k), k).collect()
    assert len(rows) == 2 * (17 - k)
    for r in rows:
        part = "ACGTTGCANACGTTAGC"[r.start : r.end + 1]
        assert r.kmer == (part if not r.rc else part.translate(str.maketrans("ACGT", "TGCA"))[::-1])


def test_one_hot_pad_and_mask(spark):
    assert value(spark, C.as_bits(C.one_hot(F.col("s"), 6)), s="ATNCGa") == "100000100000100000100000100100"
    assert value(spark, C.as_bits(C.one_hot(F.col("s"), 3)), s="G") == "000010000000000"
    assert value(spark, C.one_hot_bits(F.col("s")), s="gA") == "0010010000"
    assert value(spark, C.as_bits(C.sequence_to_array(F.col("s"), 2)), s="ACGTA") == "10000000100000101000"
    short = [[True, False, False, False, False]]
    assert generators.pad_and_mask(1, 2, short) == ([[True, False, False, False, False], [False] * 5], [True, False])
    with pytest.raises(ValueError, match="more k-mers"):
        generators.pad_and_mask(1, 1, short * 2)


def test_window_reverse_complement(spark):
    assert value(spark, F.concat_ws(",", C.window_reverse_complement(F.split("s", ","))), s="ACTG,TGACTCANAN") == "NTNTGAGTCA,CAGT"
    assert value(spark, C.shown(F.col("k"), F.lit(3), F.lit(5)), k="ACT") == "ACT: 3-5"


def test_counts_against_plain_python(spark):
    texts = ["ACGTNNNACG", "TTTTT", "AC"]
    both = {r.kmer: r.n for r in stats.kmer_counts(windows.split_chunks(seqs(spark, *texts)), 3).collect()}
    plain = {}
    for chunk in ("ACGT", "NNACG", "TTTTT", "AC"):
        for i in range(len(chunk) - 2):
            kmer = chunk[i : i + 3]
            for x in (kmer, kmer.translate(str.maketrans("ACGT", "TGCA"))[::-1]):
                plain[x] = plain.get(x, 0) + 1
    assert both == plain
    counts = spark.createDataFrame(list(plain.items()), "kmer string, n long")
    assert stats.summary(counts).first().total == sum(plain.values())
    assert stats.vocabulary(counts, 3).count() == sum(n >= 3 for n in plain.values())


def test_batches_drop_one_short_end(spark):
    df = spark.createDataFrame([("a", i) for i in range(7)] + [("b", 0)], "id string, i int")
    cut = windows.batches(df, 3, key=["id", "i"])
    assert sorted((r.batch_idx, r.batch_row) for r in cut.collect()) == [(b, i) for b in range(2) for i in range(3)]
    assert windows.batches(df, 3, key=["id", "i"], drop_last=False).count() == 8
    assert windows.batches(df.limit(0), 3, key=["id", "i"]).count() == 0


def test_many_runs_of_n(spark):
    """More runs than one block of the running sum holds."""
    rng = random.Random(4)
    seq = "".join("ACGT"[rng.randrange(4)] * rng.randint(1, 4) + "N" * rng.randint(3, 9) for _ in range(2000))
    rows = windows.split_chunks(seqs(spark, seq)).orderBy("chunk_id").collect()
    assert len(rows) == 2000
    assert all(seq[r.chunk_offset :].startswith(r.chunk) for r in rows)


@pytest.mark.parametrize("keep", [False, True])
@pytest.mark.parametrize(("k", "ws", "tile"), [(3, 2, 6), (4, 3, 24), (5, 1, 5)])
def test_tiles_change_nothing(spark, k, ws, tile, keep):
    rng = random.Random(k)
    texts = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (*range(1, 40), 120, 121, 122, 123, 124, 125, 300)]
    chunks = windows.split_chunks(seqs(spark, *texts, record()))
    plain, tiled = (windows.passes(chunks, k, tile=t) for t in (0, tile))
    assert sorted(windows.kmers(plain, k, keep_last=keep).collect()) == sorted(windows.kmers(tiled, k, keep_last=keep).collect())
    for options in ({}, {"full_only": True, "with_coords": True}):
        assert sorted(windows.windows(plain, k, ws, **options).collect()) == sorted(windows.windows(tiled, k, ws, **options).collect())
    with pytest.raises(ValueError, match="multiple"):
        windows.passes(chunks, k, tile=k + 1)


def test_windows_ahead(spark):
    chunk = one_pass(windows.split_chunks(seqs(spark, "ACGTTGCAACGTTAGCACGTAC")))
    rows = windows.windows(chunk, 2, 2, full_only=True, ahead=2).orderBy("window_idx").collect()
    assert [r.ahead for r in rows] == [[x.kmers for x in rows[i + 1 : i + 3]] for i in range(len(rows))]


def test_same_rows_for_any_partitioning(spark, sf_dir):
    from strandwork.sources import tables

    df = tables.sequences(spark, sf_dir).where("id < '12'")
    plans = [generators.masked_kmers(x, 4, 3, 0.3).select("id", "chunk_id", "offset", "rc", "window_idx", F.xxhash64("kmers", "truth").alias("h")) for x in (df.repartition(1), df.repartition(7))]
    assert plans[0].exceptAll(plans[1]).isEmpty()


def plan_above_windows(df):
    """The optimized plan from the windows' explode up: what is evaluated for every window."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan[: plan.index("Generate explode(sequence(0, (__count")]


def test_windows_are_cut_by_compiled_expressions(spark):
    df = seqs(spark, record())
    made = generators.fasta_kmers(df, 3, 4, text=True)
    assert "lambda" not in plan_above_windows(made)
    assert "regexp" not in plan_above_windows(made)
    key = ["id", "chunk_id", "offset", "rc", "window_idx"]
    flags = generators.fasta_kmers(df, 3, 4).select(*key, C.as_bits(F.flatten("kmers")).alias("bits"), "coords")
    assert sorted(made.select(*key, "bits", "coords").collect()) == sorted(flags.collect())
    assert made.count() > 100


@pytest.mark.parametrize("size", [5, 20])
def test_windows_of_any_size_and_characters(spark, size):
    text = "ACGTNACGGTAC" * 9 + "AéC\U0001d11eGT" * 7
    df = windows.passes(seqs(spark, text, "ACGTACGTACGTACGGG").withColumnsRenamed({"seq": "chunk"}).withColumns({"chunk_id": F.lit(0), "chunk_offset": F.lit(0)}), 3, both_strands=False)
    found = {(r.id, r.offset, r.window_idx): r for r in windows.windows(df, 3, size, with_coords=True, ahead=2).collect()}
    seen = 0
    for i, s in enumerate([text, "ACGTACGTACGTACGGG"]):
        for offset in range(3):
            kmers = [s[p : p + 3] for p in range(offset, len(s) - 3, 3)]
            cut = [kmers[p : p + size] for p in range(0, len(kmers), size)]
            for w, one in enumerate(cut):
                r = found[str(i), offset, w]
                seen += 1
                assert (r.kmers, r.ahead) == (one, cut[w + 1 : w + 3])
                assert [(c.start, c.end) for c in r.coords] == [(offset + (w * size + j) * 3, offset + (w * size + j) * 3 + 2) for j in range(len(one))]
    assert seen == len(found)


def test_sliding_passes_make_no_arrays_of_a_tile(spark, sf_dir):
    from strandwork.plans import queries

    above = plan_above_windows(queries.sliding_passes(spark, sf_dir))
    assert "lambda" not in above and "regexp" not in above
