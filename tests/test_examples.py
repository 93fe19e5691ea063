"""Masking, pairs, triple loss, taxonomy, files and streams."""

import gzip

import pytest
from pyspark.sql import functions as F

from strandwork.functions.draws import draw
from strandwork.operators import masking, pairs, taxonomy, windows
from strandwork.plans import generators, queries
from strandwork.sources import fasta, tables
from strandwork.sources.taxonomy import read_taxonomy
from strandwork.streaming import streams

KEY = generators.WINDOW_KEY


@pytest.fixture(scope="module")
def some(spark, sf_dir):
    return tables.sequences(spark, sf_dir).where("cast(id as int) < 40").cache()


def all_windows(some, k, ws):
    return windows.windows(windows.split_chunks(some).withColumns({"offset": F.lit(0), "rc": F.lit(False)}), k, ws)


def test_mask_rate_and_letters(some):
    df = all_windows(some, 5, 4)
    kmers = masking.masked(df, 5, 0.3, key=KEY).join(df.select(*KEY, F.col("kmers").alias("old")), KEY)
    each = kmers.select(F.explode(F.arrays_zip("kmers", "old", "truth")).alias("x")).select("x.*").toPandas()
    assert abs((~each.truth).mean() - 0.3) < 0.02
    assert (each.kmers[each.truth] == each.old[each.truth]).all()
    letters = "".join(each.kmers[~each.truth])
    assert abs(letters.count("N") / len(letters) - 4 / 196) < 0.01
    assert abs(letters.count("A") / len(letters) - 48 / 196) < 0.02
    blank = masking.masked(df, 5, 1.0, blank=True, key=KEY).first()
    assert set(blank.kmers) == {"NNNNN"}
    assert not any(blank.truth)


def test_order_halves(some):
    df = all_windows(some, 4, 6)
    rows = pairs.halves(df, 3, key=KEY).join(df, KEY).collect()
    assert rows
    for r in rows:
        assert (r.kmers2 + r.kmers1 if r.order else r.kmers1 + r.kmers2) == r.kmers
    assert 0.4 < sum(r.order for r in rows) / len(rows) < 0.6
    first = pairs.halves(windows.windows(windows.passes(windows.split_chunks(some), 4), 4, 6), 3, key=KEY, first_pass_only=True)
    assert first.count() == len(rows)


def test_matched_pairs(some):
    df = all_windows(some, 5, 2).where("size(kmers) = 2")
    rows = pairs.matched_pairs(df, slot_rows=200).collect()
    assert all((r.id1 == r.id2) == r.matched for r in rows)
    assert 0.2 < sum(r.matched for r in rows) / len(rows) < 0.6
    ahead = windows.windows(windows.split_chunks(some).withColumns({"offset": F.lit(0), "rc": F.lit(False)}), 5, 2, full_only=True, ahead=2)
    assert sorted(map(tuple, pairs.matched_pairs(ahead, slot_rows=200).collect())) == sorted(map(tuple, rows))


@pytest.mark.parametrize("slot_rows", [1, 4, 5000])
def test_each_window_finds_another_sequence(spark, some, slot_rows):
    """One sequence has nearly all windows, and slots hold one row each at worst."""
    hot = some.orderBy(F.length("seq").desc()).limit(1).union(spark.createDataFrame([("x", "ACGTACGTACGTACGTA")], some.schema))
    df = all_windows(hot, 5, 2).where("size(kmers) = 2")
    drawn = pairs.matched_pairs(df, slot_rows=slot_rows).where("NOT matched")
    assert drawn.where("id1 = id2").isEmpty()
    assert drawn.count() == df.where(F.pmod(draw(42, "same", *(F.col(c) for c in KEY)), F.lit(2)) == 0).count()
    assert pairs.matched_pairs(df.where("id = 'x'")).where("NOT matched").isEmpty()
    assert pairs.matched_pairs(df.limit(0)).isEmpty()


def test_triple_loss(some):
    rows = pairs.triple_loss(some, 4, 5, 600, 0.2).collect()
    share = {t: sum(r.task == t for r in rows) / len(rows) for t in ("same", "rc", "other")}
    assert abs(share["same"] - 0.25) < 0.08
    assert abs(share["rc"] - 0.25) < 0.08
    texts = {r.id: r.seq for r in some.collect()}
    swap = str.maketrans("ACGT", "TGCA")
    for r in rows:
        assert (r.id1 == r.id2) == r.matched == (r.task != "other")
        assert r.reversecomplement == (r.task == "rc")
        one, two = "".join(r.kmers3), "".join(r.kmers4)
        assert one in texts[r.id1] or one.translate(swap)[::-1] in texts[r.id1]
        assert two in texts[r.id2] or two.translate(swap)[::-1] in texts[r.id2]
        if r.task == "rc":
            assert two == one.translate(swap)[::-1]
        assert [a == b or a == "NNNN" for a, b in zip(r.kmers1, r.kmers3)] == [True] * 5
        assert all(not t or a == b for a, b, t in zip(r.kmers1, r.kmers3, r.truth1))
    one = some.where("id = '1'")
    assert pairs.triple_loss(one, 4, 5, 50, 0.2).where("task = 'other'").isEmpty()
    assert pairs.triple_loss(some.limit(0), 4, 5, 50, 0.2).isEmpty()


def test_generators_give_encoded_rows(spark, some):
    few = some.where("cast(id as int) < 6")
    assert len(generators.fasta_kmers(few, 4, 2, sliding=False, start_rc=True).first().kmers[0]) == 20
    assert generators.matched_kmers(few, 4, 2, slot_rows=64).where("NOT matched").count() > 0
    assert set(generators.triple_loss(few, 4, 3, 10, 0.1).columns) >= {"kmers1", "kmers4", "truth2"}
    assert generators.sequence_order(few, 4, 2).count() > 0
    batch = generators.masked_batches(few, 4, 2, 8, 0.1).first()
    assert len(batch.kmers) == len(batch.id) == len(batch.truth) == 8
    assert next(generators.examples(generators.masked_kmers(few, 4, 2, 0.1), ["id", "truth"])).keys() == {"id", "truth"}
    assert generators.convert_sequence_to_array(few, 3).select(F.size("array") % 15).distinct().first()[0] == 0


def test_random_order(some):
    few = some.where("cast(id as int) < 4")
    plain, drawn = (generators.masked_kmers(few, 4, 2, 0.1, rand=r).select(*KEY).collect() for r in (False, True))
    assert plain != drawn
    assert sorted(plain) == sorted(drawn)
    assert drawn == generators.masked_kmers(few.repartition(3), 4, 2, 0.1, rand=True).select(*KEY).collect()


def test_windows_of_sequences_of_mostly_n(spark):
    """A window is drawn wherever one holds a base, and at the least length."""
    texts = {"a": "ACGTACGTA", "b": "N" * 500 + "A" + "N" * 500, "c": "A" + "N" * 800, "d": "N" * 90 + "ACG", "e": "N" * 60 + "G" + "N" * 4, "f": "ACGTACGT"}
    df = spark.createDataFrame(list(texts.items()), "id string, seq string")
    rows = {r.id: "".join(r.kmers) for r in pairs.subwindows(df, 3, 2).collect()}
    assert set(rows) == {"a", "b", "c", "e"}  # of d only the last place, which is never drawn, would do; f is short
    assert all(set(x) != {"N"} and len(x) == 6 for x in rows.values())
    one = pairs.triple_loss(df.where("id = 'a'"), 3, 2, 40, 0.0)
    assert {"".join(r.kmers3) for r in one.collect()} == {"ACGTAC", "GTACGT"}
    found = pairs.by_index(pairs.numbered(df, 9), spark.createDataFrame([(0,), (0,), (2,), (77,), (None,)], "i int"))
    assert sorted(r.seq_idx for r in found.collect()) == [0, 2]


def test_windows_of_named_and_numbered_sequences(spark, some):
    texts = {r.id: r.seq for r in some.collect()}
    swap = str.maketrans("ACGT", "TGCA")
    named = pairs.subwindows_of(some, spark.createDataFrame([(3,), (3,), (5,), (9999,)], "i int"), 4, 5).collect()
    assert {r.id for r in named} == {"3", "5"}
    pool = pairs.numbered(some, 24)
    numbers = {r.seq_idx: r.id for r in pool.collect()}
    rows = pairs.subwindows_at(pool, spark.createDataFrame([(0,), (2,), (4,)], "i int"), 4, 5, reach=300).collect()
    assert {r.id for r in rows} <= {numbers[i] for i in (0, 2, 4)}
    assert rows
    for r in [*named, *rows]:
        bases = "".join(r.kmers)
        assert len(bases) == 20
        assert (bases.translate(swap)[::-1] if r.rc else bases) in texts[r.id]
    assert all("NNN" not in "".join(r.kmers) for r in rows)


def test_deep_lineages_and_cycles(spark):
    nodes = [(1, 1), (2, 1), (3, 1), *((i, i - 1) for i in range(4, 204)), *((i, i - 1) for i in range(1001, 1010)), (5000, None), (5001, 5000), (5002, 5002), (5003, 5002)]
    nodes += [(1000, 2)]
    df = spark.createDataFrame(nodes, "taxon_id long, parent_id long")
    found = {r.taxon_id: r.branch for r in taxonomy.branch_of(df, 1).collect()}
    assert found == {2: 2, 3: 3} | {i: 3 for i in range(4, 204)} | {i: 2 for i in range(1000, 1010)}
    with pytest.raises(ValueError, match="cycle"):
        taxonomy.branch_of(df.union(spark.createDataFrame([(10_000 + i, 10_000 + (i + 1) % 5) for i in range(5)], df.schema)), 1)


def test_valid_sequences_and_numbers(spark):
    df = spark.createDataFrame([("a", "ACGTA"), ("b", "NNNNNN"), ("c", "ACG"), ("d", "ACGTT")], "id string, seq string")
    assert sorted((r.id, r.seq_idx) for r in pairs.numbered(df, 5).collect()) in ([("a", 0), ("d", 1)], [("a", 1), ("d", 0)])
    assert pairs.subwindows(df.where("id = 'a'"), 2, 1).first().kmers[0] in ("AC", "CG", "GT", "TA", "AT")


def test_taxonomy(spark, tmp_path):
    (tmp_path / "acc").write_text("s1\t11\ns2\t111\ns3\t2\ns4\t99\n")
    (tmp_path / "nodes").write_text("1\t1\troot\n10\t1\tx\n11\t10\tx\n111\t11\tx\n2\t1\tx\n3\t1\tx\n99\t98\tx\n")
    (tmp_path / "names").write_text("10\tten\n2\ttwo\n3\tthree\n")
    acc, nodes, names = read_taxonomy(spark, *(str(tmp_path / n) for n in ("acc", "nodes", "names")))
    sized = spark.createDataFrame([("s1", 5), ("s2", 7), ("s3", 2), ("s4", 9), ("s5", 1)], "id string, seq_len long")
    counts = taxonomy.taxon_counts(sized, acc, nodes, names, 1)
    assert sorted(map(tuple, counts.collect())) == [(2, "two", 1, 2), (3, "three", 0, 0), (10, "ten", 2, 12)]
    assert sorted(map(tuple, taxonomy.taxon_counts(sized, acc, nodes, names, 1, min_length=6).collect()))[0] == (2, "two", 0, 0)
    assert sorted(map(tuple, taxonomy.members(sized, acc, nodes, 1).collect())) == [(2, "s3"), (10, "s1"), (10, "s2")]
    with pytest.raises(ValueError, match="no children"):
        taxonomy.taxon_counts(sized, acc, nodes, names, 111)
    taxonomy.write_counts(counts, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).where("value = '10\tten\t2\t12'").count() == 1


FASTA = ">a first > one\nACgt\nNN\n\n>b\n>c x\nTT\r\nGG\n"


def test_fasta_files(spark, tmp_path):
    (tmp_path / "x.fa").write_text(FASTA)
    with gzip.open(tmp_path / "y.fa.gz", "wt") as f:
        f.write(FASTA)
    for name in ("x.fa", "y.fa.gz"):
        rows = fasta.read_fasta(spark, str(tmp_path / name)).collect()
        assert sorted(map(tuple, rows)) == [("a", "ACGTNN"), ("b", ""), ("c", "TTGG")]
    fasta.convert_fasta(spark, str(tmp_path / "x.fa"), str(tmp_path / "store"))
    store = fasta.read_sequences(spark, str(tmp_path / "store"))
    assert fasta.by_id(store, "c").first().seq == "TTGG"
    assert fasta.by_id(store, "a").first().seq == "ACgtNN"
    assert sorted(map(tuple, fasta.lengths(store).collect())) == [("a", 6), ("b", 0), ("c", 4)]
    assert fasta.slice_of(fasta.by_id(store, "a"), 1, 4).first().seq == "Cgt"
    order = [r.id for r in fasta.random_order(store, 1).collect()]
    assert order == [r.id for r in fasta.random_order(store.repartition(3), 1).collect()]


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.fa").write_text(">a\nACGTACGTA\n>b\nACGNNNNACGTA\n")
    stream = streams.fasta_stream(spark, str(folder))

    def run(df, name, mode):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name)

    batch = windows.windows(windows.passes(windows.split_chunks(fasta.read_fasta(spark, str(folder))), 2, sliding=False), 2, 2, full_only=True)
    assert run(streams.window_stream(stream, 2, 2), "win", "append").count() == batch.count()
    counts = {r.kmer: r.n for r in run(streams.kmer_count_stream(stream, 3), "cnt", "complete").collect()}
    assert counts["ACG"] == 4


def test_nested_sets_of_deep_and_wide_trees(spark):
    import random

    rng = random.Random(3)
    parents = {1: 1, 2: None, 3: 999_999_999_999}
    for i in range(4, 400):
        parents[i] = i - 1 if i < 150 else 5 if i < 250 else rng.randrange(1, i)
    df = spark.createDataFrame([(t, p, "x") for t, p in parents.items()] + [(7, 6, "x"), (None, 1, "x")], "taxon_id long, parent_id long, rank string")
    found = {r.taxon_id: (r.enter, r.leave) for r in taxonomy.nested_sets(df).collect()}
    assert sorted(e for e, _ in found.values()) == list(range(len(parents)))
    above = {}
    for t in parents:
        above[t], at = set(), t
        while at in parents and at not in above[t]:
            above[t].add(at)
            at = parents[at]
    for a in parents:
        low, high = found[a]
        assert {t for t, (e, _) in found.items() if low <= e <= high} == {t for t in parents if a in above[t]}
    sized = [(str(i), rng.randint(1, 50), rng.choice([*parents, 12345])) for i in range(300)]
    sequences = spark.createDataFrame([(i, n) for i, n, _ in sized], "id string, seq_len long")
    acc = spark.createDataFrame([(i, t) for i, _, t in sized], "accession string, taxon_id long")
    rows = {r.taxon_id: (r.seq_count, r.seq_length) for r in taxonomy.clade_sums(sequences, acc, df, min_length=10, block=16).collect()}
    assert rows == {a: (len(x := [n for _, n, t in sized if n >= 10 and t in above and a in above[t]]), sum(x)) for a in parents}
    assert taxonomy.nested_sets(df.limit(0)).isEmpty()
    with pytest.raises(ValueError, match="cycle"):
        taxonomy.nested_sets(df.union(spark.createDataFrame([(1000, 1001, "x"), (1001, 1000, "x")], df.schema)))


def test_endless_examples_go_on_where_they_stopped(spark, some, tmp_path):
    batch = {r.example: r for r in pairs.triple_loss(some, 4, 5, 40, 0.2).collect()}
    for turn in range(3):
        stream = pairs.triple_loss_stream(some, 4, 5, 0.2, rows_per_batch=10, partitions=2)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        seen = sorted(r.example for r in rows)
        n = max(seen) + 1
        assert len(set(seen)) == len(seen) and n <= 10 * (turn + 1)
        assert seen == [e for e in range(n) if e in batch]
        assert all(r == batch[r.example] for r in rows)
    assert n > 20


def test_balanced_windows(spark, some):
    rng = {r.id: r.seq for r in some.collect()}
    members = spark.createDataFrame([("big" if int(i) % 10 else "small", i) for i in rng] + [("gone", "x")], "branch string, id string")
    rows = pairs.balanced_windows(some, members, 4, 2, 6, 1001).collect()
    by = {b: [r for r in rows if r.branch == b] for b in ("big", "small", "gone")}
    assert abs(len(by["big"]) - len(by["small"])) <= 1 and len(rows) == 1001 and not by["gone"]
    sizes = [sum(r["size"] == s for r in rows) for s in range(2, 7)]
    assert sum(sizes) == 1001 and sum((x - 200.2) ** 2 / 200.2 for x in sizes) < 18.5  # chi-square, 4 degrees, 0.001
    swap = str.maketrans("ACGT", "TGCA")
    for r in rows:
        bases = "".join(r.kmers)
        assert len(r.kmers) == r["size"] and len(bases) == 4 * r["size"]
        assert (bases.translate(swap)[::-1] if r.rc else bases) in rng[r.id]
    again = pairs.balanced_windows(some.repartition(3), members, 4, 2, 6, 1001).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, rows), key=str)
    assert pairs.balanced_windows(some.limit(0), members, 4, 2, 6, 10).isEmpty()


@pytest.mark.parametrize("blank", [False, True])
def test_masking_behind_the_sort_and_with_compiled_digests(spark, sf_dir, blank):
    key = generators.WINDOW_KEY
    df = windows.windows(windows.passes(windows.split_chunks(tables.sequences(spark, sf_dir)), 4), 4, 8)
    plain = masking.masked(df, 4, 0.15, blank=blank, key=key).select(*key, "kmers", "truth")
    fast = masking.masked(df, 4, 0.15, blank=blank, key=key, window_size=8).select(*key, "kmers", "truth")
    assert plain.count() == fast.count() > 1000
    assert plain.exceptAll(fast).isEmpty()
    plan = queries.masked_random_order(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "'mask" not in plan[plan.index("Sort [") :] and "|mask" not in plan[plan.index("Sort [") :]


def test_a_digest_is_compared_as_its_number(spark):
    from strandwork.functions.draws import hex_number, is_under

    df = spark.range(2000).select(F.md5(F.col("id").cast("string")).alias("d"))
    for share in (0.0, 1e-9, 0.15, 0.5, 1.0, 1.5):
        assert df.where(is_under(F.col("d"), share) != (hex_number(F.col("d"), 1, 8) / F.lit(float(1 << 32)) < share)).isEmpty()
