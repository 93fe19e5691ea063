"""Spelling variants, byte-level BPE and whitening against plain versions, and on odd tables."""

import base64
import hashlib
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from strandwork.llm import bpe, queries, spelling, whitening

DOCS = "doc_id long, text string, ids int, decoded string, n_tokens int, word string, n long"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x", None, "w", 2) for i, t in texts], DOCS)


# ------------------------------------------------------------------ 11


def plain_counts(texts, least_length=6, least_count=5):
    found = Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 199 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            found[low] += 1
    return {w: n for w, n in found.items() if len(w) >= least_length and n >= least_count}


def plain_variants(counts):
    """Near words by the words with one letter out, or with one letter marked as any."""
    shapes = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            shapes[w[:i] + "?" + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in shapes.values():
        for a in group:
            near[a] |= group - {a}
    for w in counts:
        for i in range(len(w)):
            short = w[:i] + w[i + 1 :]
            if short in counts:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()), key=str)


def many_words(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeÀéÿ") for _ in range(rng.randint(5, 9))) for _ in range(40)]
    out = []
    for _ in range(n):
        w = rng.choice(base[: rng.randint(1, 40)])
        if rng.random() < 0.3:
            i, kind = rng.randrange(len(w)), rng.random()
            w = w[:i] + ("" if kind < 0.3 else rng.choice("abcdeÀéÿ")) + w[i + (0 if kind > 0.7 else 1) :]
        out.append(w.capitalize() if rng.random() < 0.1 else w)
    return " ".join(out)


@pytest.mark.parametrize("options", [{}, {"cell": 8, "sample": 10_000}, {"cell": 8, "sample": 70}])
def test_variants_equal_all_pairs(spark, options):
    chain = " ".join(["zabcde "] * 5 + ["zabcdef "] * 30 + ["zabcdefg "] * 200)
    texts = [(i, many_words(i, 5000)) for i in range(8)] + [(8, chain)]
    counts = plain_counts(texts)
    wanted = plain_variants(counts)
    assert sum(r[1] is not None for r in wanted) > 20 and sum(r[2] != r[0] and r[2] != r[1] for r in wanted) > 0
    assert rows_of(spelling.spelling_variants(docs(spark, texts), **options)) == wanted


def test_variants_of_tables(spark, sf_dir):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.op11_spelling(spark, sf_dir)) == plain_variants(plain_counts(texts))


def test_words_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PART", 7)
    long = "ABC" * 1_000
    texts = [(1, None), (2, ""), (3, " \n "), (None, "Straße straße STRAßE straße straße Straße"), (4, " ".join([long] * 5)), (4, "naïveté " * 6), (4, "naïveté " * 6), (5, "short " * 9), (6, "x×÷y--Ünder " * 5)]
    for part in (7, 1 << 20):
        spelling.PART = part
        assert list(spelling._runs("aB cÀÉ-" * 9)) == ["ab", "cÀÉ"] * 9
    got = rows_of(spelling.word_counts(docs(spark, texts)))
    assert got == sorted(plain_counts(texts).items(), key=str)
    assert rows_of(spelling.spelling_variants(docs(spark, texts))) == plain_variants(plain_counts(texts))
    assert spelling.spelling_variants(docs(spark, [])).count() == 0
    assert spelling.spelling_variants(docs(spark, [(1, "a b")])).count() == 0


def test_tree_search_finds_all_in_reach():
    rng = np.random.default_rng(5)
    points = rng.integers(0, 3, (700, spelling.LETTERS)).astype(np.int32) * (rng.random((700, spelling.LETTERS)) < 0.05)
    tree = spelling.Tree(points, 4)
    assert sorted(i for leaf in tree.leaves if leaf is not None for i in leaf) == list(range(700))
    wanted = points[:200].copy()
    wanted[np.arange(200), rng.integers(0, 90, 200)] += 1
    met = defaultdict(set)
    for node, rows, _, _ in tree.descend(wanted, np.arange(200), np.full(200, -1), np.full(200, -1)):
        for r in rows:
            met[int(r)] |= set(tree.leaves[node].tolist())
    for i in range(200):
        change = points - wanted[i]
        near = np.flatnonzero((np.maximum(change, 0).sum(1) <= 1) & (np.maximum(-change, 0).sum(1) <= 1))
        assert set(near.tolist()) <= met[i]
    assert sum(map(len, met.values())) < 0.5 * 200 * 700


# ------------------------------------------------------------------ 12


@pytest.fixture(scope="module")
def public():
    import tiktoken

    path, pattern = queries.public_ranks()
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), bpe.Vocabulary(path, pattern)


def ids_of(vocabulary, text):
    return array("i", next(vocabulary.encode([text]))).tolist()


def test_queue_gives_buckets_by_least_rank():
    rng, queue, plain = random.Random(1), bpe.RankQueue(), defaultdict(list)
    for _ in range(20_000):
        if plain and rng.random() < 0.45:
            least = min(plain)
            assert queue.pop() == (least, plain.pop(least))
        else:
            rank, at = rng.choice([rng.randrange(50_257), rng.randrange(70)]), rng.randrange(1 << 40)
            queue.push(rank, [at])
            plain[rank].append(at)
    for least in sorted(plain):
        assert queue.pop() == (least, plain[least])
    assert queue.pop() is None and not queue.buckets and not any(map(any, queue.levels))


def test_merges_of_any_ranks(tmp_path):
    """Ranks in no order that training gives: merges may lead to lesser ranks than their own."""
    import tiktoken

    rng = random.Random(9)
    for turn in range(40):
        tokens = {bytes([b]) for b in range(256)}
        while len(tokens) < 256 + 60:
            tokens.add("".join(rng.choice("abc") for _ in range(rng.randint(2, 5))).encode())
        order = sorted(tokens)
        rng.shuffle(order)
        path = tmp_path / f"{turn}"
        path.write_bytes(b"".join(base64.b64encode(t) + f" {i}\n".encode() for i, t in enumerate(order)))
        mine = bpe.Vocabulary(str(path), r"\S+|\s+")
        theirs = tiktoken.Encoding("x", pat_str=r"\S+|\s+", mergeable_ranks={t: i for i, t in enumerate(order)}, special_tokens={})
        texts = ["".join(rng.choice("aabbc  ") for _ in range(60)) for _ in range(20)]
        assert [array("i", ids).tolist() for ids in mine.encode(texts)] == [theirs.encode_ordinary(t) for t in texts]


def test_ids_equal_library(public, sf_dir, spark):
    theirs, mine = public
    rng = random.Random(3)
    texts = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    letters = "abcdefe  \n\t's1é　\x1c\x85\U0001f600ñ<|>"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(chr(c) for c in range(a, a + 500)) for a in range(0, 0xD000, 500)]
    texts += ["a" * 40_000, "ab" * 20_000, " " * 30_000 + "x", "".join(rng.choice("abcde") for _ in range(50_000)), "<|endoftext|>"]
    texts = [t for t in texts if t is not None]
    for t, found in zip(texts, mine.encode(texts), strict=True):
        ids = array("i", found).tolist()
        assert ids == theirs.encode_ordinary(t)
        assert mine.decode(ids) == t.encode()


def test_parts_do_not_change_ids(public, monkeypatch):
    theirs, mine = public
    monkeypatch.setattr(bpe, "PART", 5)
    monkeypatch.setattr(bpe, "MEMORY", 3)
    rng = random.Random(4)
    for _ in range(500):
        t = "".join(rng.choice("ab  \n　'st1.") for _ in range(80))
        assert "".join(mine.parts(t)) == t
        assert ids_of(mine, t) == theirs.encode_ordinary(t)


def test_round_trip_of_odd_tables(spark, public, monkeypatch):
    theirs, _ = public
    texts = [(1, None), (2, ""), (3, " \n"), (None, "naïve \U0001f600"), (4, "word"), (4, "word"), (5, "long text " * 20_000)]
    held = bpe.encode(docs(spark, texts), queries.public_ranks)
    assert held.columns == ["doc_id", "ids", "decoded", "n_tokens", "word", "n", "ids_"]
    assert held.schema["ids_"].dataType.simpleString() == "array<int>"
    assert rows_of(held.select("doc_id", "ids_")) == rows_of(spark.createDataFrame([(d, theirs.encode_ordinary(t or "")) for d, t in texts], "doc_id long, ids array<int>"))
    back = bpe.decode(held, queries.public_ranks, ids_col="ids_")
    assert back.columns == ["doc_id", "ids", "decoded", "n_tokens", "word", "n", "decoded_"]
    assert sorted((bytes(r["decoded_"]) for r in back.collect())) == sorted((t or "").encode() for _, t in texts)
    assert bpe.decode(bpe.encode(docs(spark, []), queries.public_ranks), queries.public_ranks, ids_col="ids_").count() == 0
    none = spark.createDataFrame([(1, None)], "k long, ids array<int>")
    assert bytes(bpe.decode(none, queries.public_ranks).first()["decoded"]) == b""


def test_query_digests_equal_library(spark, public, sf_dir):
    theirs, _ = public
    wanted = []
    for doc, text in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = theirs.encode_ordinary(text or "")
        wanted.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert rows_of(queries.op12_bpe(spark, sf_dir)) == sorted(wanted, key=str)


# ------------------------------------------------------------------ 13


def whole(vector):
    return [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in vector]


def plain_covariance(fit):
    n, dims = len(fit), len(fit[0])
    mean = [Fraction(sum(x[d] for x in fit), n) for d in range(dims)]
    return np.array([[float(sum((x[a] - mean[a]) * (x[b] - mean[b]) for x in fit) / n) for b in range(dims)] for a in range(dims)])


def check_whitened(rows, given, components=16):
    """rows: (id, component, n, deviation, whitened, explained, identity_error); given: (id, vector) of usable vectors."""
    fit = [list(x) for x in sorted({tuple(whole(v)) for _, v in given})]
    n, v = len(fit), plain_covariance(fit)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    sums = np.array(fit, dtype=object).sum(0)
    k = min(components, len(v))
    assert len(rows) == k * len(given)
    by = defaultdict(list)
    for r in rows:
        by[r[0], r[1]].append(r)
    signs = {}
    for i, vector in given:
        off = [n * a - s for a, s in zip(whole(vector), sums, strict=True)]
        for c in range(1, k + 1):
            same = [r for r in by[i, c] if int(r[3]) == sum(o * o for o in off)]
            assert same and same[0][2] == n
            if values[c - 1] > 1e-9 * values[0]:
                score = float(np.dot([o / n for o in off], axes[:, c - 1]) / np.sqrt(values[c - 1]))
                close = min(same, key=lambda r: abs(abs(r[4]) - abs(score)))
                assert abs(abs(close[4]) - abs(score)) < 1e-7
                if abs(score) > 1e-3:
                    signs.setdefault(c, set()).add(np.sign(close[4]) == np.sign(score))
                assert abs(close[5] - values[c - 1] / np.trace(v)) < 1e-9
                assert close[6] < 1e-6
    return signs


def test_whitening_equals_direct_covariance(spark):
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(6, 6))
    items = [(i, [float(np.float32(x)) for x in rng.normal(size=6) @ mix]) for i in range(150)]
    items += [(200, items[0][1]), (0, items[0][1]), (None, items[3][1])]
    bad = [(300, None), (301, [float("nan")] * 6), (302, [None, *[1.0] * 5]), (303, [float("inf"), *[0.0] * 5]), (304, []), (305, [1.0, 2.0]), (306, [1e30, *[0.0] * 5])]
    made = spark.createDataFrame([(i, v, 1, 2.0, None) for i, v in items + bad], "vec_id long, embedding array<float>, n int, whitened double, component string")
    rows = [tuple(r) for r in whitening.whiten(made, components=4).collect()]
    signs = check_whitened(rows, items, 4)
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_of_table(spark, sf_dir):
    given = [(r[0], list(r[1])) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    fit = np.array(sorted({tuple(whole(v)) for _, v in given}), float)
    rows = queries.op13_whitening(spark, sf_dir).collect()
    assert len(rows) == 16 * len(given) and rows[0]["n"] == len(fit)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    vector = dict(given)
    for r in rows[::37]:
        c = r["component"]
        score = (np.array(whole(vector[r["vec_id"]])) - fit.mean(0)) @ axes[:, -c] / np.sqrt(values[-c])
        assert abs(abs(score) - abs(r["whitened"])) < 1e-6
        assert abs(r["explained"] / (values[-c] / values.sum()) - 1) < 1e-6 and r["identity_error"] < 1e-8


def test_wide_entries_stay_exact():
    rng = np.random.default_rng(1)
    u = rng.integers(-(1 << 40), 1 << 40, (50, 3))
    flat = np.concatenate(whitening._squares(u, 1 << 41))
    pairs = [(a, b) for a in range(3) for b in range(a, 3)]
    for (a, b), got in zip(pairs, flat, strict=True):
        assert int(got) == sum((int(r[a]) + (int(r[b]) if a != b else 0)) ** 2 for r in u)


def test_whitening_of_few_or_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], kind)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0])], kind)).collect()
    assert [(r["vec_id"], r["n"], int(r["deviation"]), r["whitened"], r["explained"]) for r in one] == [(1, 1, 0, None, None)] * 4
    two = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], kind)).orderBy("vec_id", "component").collect()
    assert [abs(round(r["whitened"], 9)) if r["whitened"] is not None else None for r in two] == [1.0, None, 1.0, None]
    assert two[0]["explained"] == pytest.approx(1)
