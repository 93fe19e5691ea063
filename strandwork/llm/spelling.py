"""Spelling variants: words one edit apart, grouped under their most frequent near word.

A word is a point whose coordinates count its letters. Words that differ by one replaced letter are of equal length, and
one coordinate is one higher, another one lower; where a letter is inserted, one coordinate is one higher. So for each pair
of lengths (L, L) and (L, L + 1) a k-d tree over the words of one length answers box-pruned range searches for those of
the other, and whatever the search reaches is verified letter by letter.

1. *Words*: tasks count the runs of their texts; counts are added up by word.
2. *Cells*: for each length, the upper part of its tree is built on a bounded sample of words, and its leaves are cells of
   about ``cell`` words each. Every word is a point of one cell, and is sent as a search to each cell whose box it may
   reach, together with the steps (one up, one down) that it has used up on the way.
3. *Search*: each cell builds the lower part of the tree over all of its points and goes on with the searches.
4. *Forms*: near words are counted and the most frequent chosen; roots follow forms by doubling pointers, written each
   round. Frequencies grow at least fivefold along a chain, so chains are short.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.llm.common import release, saved

RUN, LETTER = re.compile(r"[A-Za-zÀ-ÿ]+"), re.compile(r"[A-Za-zÀ-ÿ]")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Letters of the class in lower case: a to z, then U+00C0 to U+00FF.
LETTERS = 26 + 64
#: Distinct words that a task counts before it gives them out, and characters of text that it cuts at a time.
HELD, PART = 1 << 18, 1 << 20
#: Points of a leaf, and searches that go down a cell's tree together.
LEAF, BLOCK = 16, 1 << 15
#: Letters of the words that are compared at a time.
LETTERS_AT_ONCE = 1 << 22


def _runs(text: str) -> Iterator[str]:
    """The runs of ``text`` in lower case, long texts part by part."""
    start = 0
    while start < len(text):
        end = start + PART
        while end < len(text) and LETTER.match(text, end - 1) and LETTER.match(text, end):
            end += PART  # inside a run
        for run in RUN.findall(text, start, end):
            yield run if run.islower() and run.isascii() else run.translate(LOWER)
        start = end


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5, drop_one_in: int = 199) -> DataFrame:
    """``word`` and ``n`` of all texts: runs of letters in lower case (A to Z only), of ``least_length`` letters or more and
    with ``least_count`` occurrences or more.

    Where ``drop_one_in`` divides the crc32 of ``<id>:<run>``, a letter is left out of the run, so that a corpus holds known
    misspellings; 0 turns this off. A null id is written as nothing, a null text holds no run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Counter(_runs(text.as_py() or ""))
                prefix = f"{'' if doc is None else doc}:".encode()
                begun = zlib.crc32(prefix)
                for word, n in found.items():
                    if drop_one_in:
                        h = zlib.crc32(word.encode(), begun)
                        if h % drop_one_in == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield given()
        yield given()

    each = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def letter_counts(words: list[str]) -> np.ndarray:
    """A row of LETTERS counts for each word."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    slot = np.where(points < 0xC0, points - 97, points - 0xC0 + 26)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(row * LETTERS + slot, minlength=len(words) * LETTERS).reshape(-1, LETTERS).astype(np.int32)


class Tree:
    """A k-d tree: node i has the points of its box; inner nodes have a letter and a least count that goes right."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.letter: list[int] = []
        self.least: list[int] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.leaves: list[np.ndarray | None] = []
        self.cells = 0
        self.cell: list[int] = []
        todo = [(np.arange(len(points)), self._node())]
        while todo:
            rows, node = todo.pop()
            cut = self._cut(points[rows]) if len(rows) > leaf else None
            if cut is None:
                self.leaves[node], self.cell[node] = rows, self.cells
                self.cells += 1
                continue
            self.letter[node], self.least[node] = cut
            high = points[rows, cut[0]] >= cut[1]
            self.left[node], self.right[node] = self._node(), self._node()
            todo += [(rows[~high], self.left[node]), (rows[high], self.right[node])]

    def _node(self) -> int:
        for values, x in ((self.letter, -1), (self.least, 0), (self.left, -1), (self.right, -1), (self.leaves, None), (self.cell, -1)):
            values.append(x)
        return len(self.letter) - 1

    @staticmethod
    def _cut(points: np.ndarray) -> tuple[int, int] | None:
        """The letter and count that part the points most evenly; None where all are equal."""
        best, half = None, len(points) / 2
        for least in np.unique(points)[1:].tolist():
            high = (points >= least).sum(0)
            at = int(np.abs(high - half).argmin())
            if 0 < high[at] < len(points) and (best is None or abs(high[at] - half) < best[0]):
                best = (abs(high[at] - half), at, least)
            if high.max() < half and best is not None:
                break
        return best and best[1:]

    def descend(self, points: np.ndarray, rows: np.ndarray, up: np.ndarray, down: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Leaves that the searches reach: node, rows, and the letters that each has moved up and down (-1: not yet, -2: may
        not). A search whose point lies on one side of a cut goes there, and to the other side too if one step leads
        there; a step is used once, so the box's distance is what the steps add up to."""
        todo = [(0, rows, up, down)]
        while todo:
            node, rows, up, down = todo.pop()
            letter = self.letter[node]
            if letter < 0:
                yield node, rows, up, down
                continue
            least = self.least[node]
            value = points[rows, letter] + (up == letter) - (down == letter)
            high = value >= least
            rises, falls = (value == least - 1) & (up == -1), (value == least) & (down == -1)
            for child, stays, steps in ((self.right[node], high, rises), (self.left[node], ~high, falls)):
                there = np.concatenate([np.flatnonzero(stays), np.flatnonzero(steps)])
                if len(there):
                    u, d, kept = up[there], down[there], len(there) - int(steps.sum())
                    (u if steps is rises else d)[kept:] = letter
                    todo.append((child, rows[there], u, d))


def _code_points(words: list[str], width: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, width)


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which rows differ by exactly one replaced letter (equal widths) or one that ``long`` has more."""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(1) == 1
    width = short.shape[1]
    front = np.logical_and.accumulate(short == long[:, :width], axis=1).sum(1)
    back = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(1)
    return front + back >= width


def _parities(points: np.ndarray) -> np.ndarray:
    """A bit for each letter (folded to 64), set where its count is odd: one edit changes two bits at most."""
    bits = np.zeros(len(points), np.uint64)
    for i in range(LETTERS):
        bits ^= (points[:, i] & 1).astype(np.uint64) << np.uint64(i % 64)
    return bits


def near_pairs(words: DataFrame, *, cell: int = 1 << 14, sample: int = 200_000) -> DataFrame:
    """``a``, ``na``, ``b``, ``nb``: each pair of ``words`` (word, n) one edit apart once, the shorter (or lesser) first.

    ``sample`` bounds the words on which the trees' upper parts are built (the least by hash, on the driver); all words are
    searched and found. Cells hold about ``cell`` words up to sample / 64 * cell words in all; beyond that they grow
    until ``sample`` is raised.
    """
    total = words.count()
    drawn = [r["word"] for r in words.select("word").orderBy(F.xxhash64("word"), "word").limit(sample).collect()]
    by_length: dict[int, list[str]] = {}
    for w in drawn:
        by_length.setdefault(len(w), []).append(w)
    leaf = max(64, cell * len(drawn) // max(total, 1))
    trees = {}
    for length, some in by_length.items():
        tree = Tree(letter_counts(some), leaf)
        if tree.cells > 1:
            tree.leaves = []  # only boxes are needed
            trees[length] = tree
    known = words.sparkSession.sparkContext.broadcast(trees)  # at most sample / 64 leaves

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = known.value
        for batch in batches:
            held, lengths = batch.column(0).to_pylist(), np.array([len(w) for w in batch.column(0).to_pylist()])
            n = batch.column(1)
            for length in np.unique(lengths):
                of = np.flatnonzero(lengths == length)
                for first in range(0, len(of), 8192):
                    rows = of[first : first + 8192]
                    points = letter_counts([held[i] for i in rows])
                    mine = np.arange(len(rows))
                    yield from _sent(trees.get(int(length)), int(length), batch, n, rows, points, mine, -2, -2, True)
                    yield from _sent(trees.get(int(length)), int(length), batch, n, rows, points, mine, -1, -1, False)
                    yield from _sent(trees.get(int(length) + 1), int(length) + 1, batch, n, rows, points, mine, -1, -2, False)

    routed = words.select("word", "n").mapInArrow(send, "length int, cell int, point boolean, word string, n long, up int, down int")

    def search(group: pa.Table) -> pa.Table:
        at = np.flatnonzero(group["point"].to_numpy())
        ask = np.flatnonzero(~group["point"].to_numpy())
        length = group["length"][0].as_py()
        out: dict[str, list] = {"a": [], "na": [], "b": [], "nb": []}
        if len(at) and len(ask):
            words, n = group["word"].to_pylist(), group["n"].to_numpy()
            up, down = group["up"].to_numpy(), group["down"].to_numpy()
            held = [words[i] for i in at]
            points = letter_counts(held)
            tree, parity, text = Tree(points, LEAF), _parities(points), _code_points(held, length)
            for width in (length - 1, length):
                some = np.array([i for i in ask if len(words[i]) == width], np.int64)
                for first in range(0, len(some), BLOCK):
                    rows = some[first : first + BLOCK]
                    asked = [words[i] for i in rows]
                    wanted = letter_counts(asked)
                    met = _met(tree, points, parity, wanted, up[rows], down[rows])
                    for q, p in met:
                        if width == length:
                            less = np.fromiter((asked[i] < held[j] for i, j in zip(q.tolist(), p.tolist(), strict=True)), bool, len(q))
                            q, p = q[less], p[less]
                        fits = np.zeros(len(q), bool)
                        step = max(1, LETTERS_AT_ONCE // length)
                        for i in range(0, len(q), step):
                            fits[i : i + step] = one_edit(_code_points([asked[j] for j in q[i : i + step]], width), text[p[i : i + step]])
                        q, p = q[fits], p[fits]
                        out["a"] += [asked[i] for i in q]
                        out["na"] += n[rows[q]].tolist()
                        out["b"] += [held[j] for j in p]
                        out["nb"] += n[at[p]].tolist()
        kinds = {"a": pa.string(), "na": pa.int64(), "b": pa.string(), "nb": pa.int64()}
        return pa.table({c: pa.array(out[c], t) for c, t in kinds.items()})

    return routed.groupBy("length", "cell").applyInArrow(search, "a string, na long, b string, nb long")


def _sent(tree: Tree | None, length: int, batch: pa.RecordBatch, n: pa.Array, rows: np.ndarray, points: np.ndarray, mine: np.ndarray, up: int, down: int, point: bool) -> Iterator[pa.RecordBatch]:
    """The words of ``rows`` as points or searches of the cells of a tree; a length without one is a single cell."""
    ups, downs = np.full(len(rows), up), np.full(len(rows), down)
    reached = [(0, mine, ups, downs)] if tree is None else tree.descend(points, mine, ups, downs)
    for node, at, u, d in reached:
        size, of = len(at), pa.array(rows[at])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(size, length, np.int32)),
                pa.array(np.full(size, 0 if tree is None else tree.cell[node], np.int32)),
                pa.array(np.full(size, point)),
                batch.column(0).take(of),
                n.take(of),
                pa.array(u.astype(np.int32)),
                pa.array(d.astype(np.int32)),
            ],
            names=["length", "cell", "point", "word", "n", "up", "down"],
        )


def _met(tree: Tree, points: np.ndarray, parity: np.ndarray, wanted: np.ndarray, up: np.ndarray, down: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (search, point) of the leaves reached whose letter counts are near enough, some tens of thousands at a time."""
    odd, held, size = _parities(wanted), [], 0
    for node, rows, _, _ in tree.descend(wanted, np.arange(len(wanted)), up, down):
        leaf = tree.leaves[node]
        step = max(1, (1 << 20) // max(len(leaf), 1))
        for first in range(0, len(rows), step):
            some = rows[first : first + step]
            q, p = np.nonzero(np.bitwise_count(odd[some, None] ^ parity[leaf]) <= 2)
            held.append((some[q], leaf[p]))
            size += len(q)
            if size >= 1 << 16:
                yield from _exact(held, points, wanted)
                held, size = [], 0
    yield from _exact(held, points, wanted)


def _exact(held: list, points: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if held:
        q, p = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
        near = np.abs(wanted[q] - points[p]).sum(1) <= 2
        yield q[near], p[near]


def _first(n: Column, word: Column) -> Column:
    """Orders near words: the most frequent first, then by code points (UTF-8 sorts alike)."""
    return F.struct((-n).alias("n"), word.alias("word"))


def variants(words: DataFrame, *, ratio: int = 5, **options) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of ``words`` (word, n; each word once).

    Two words are near if they differ by exactly one inserted, deleted or replaced letter; ``n_near`` counts a word's near
    words. Its form is the most frequent of them (ties: the least by code points) if that one is ``ratio`` times as frequent,
    else null. The root is where the forms end, the word itself if it has none. No words give no rows.
    """
    words = saved(words.select("word", "n"))
    pairs = near_pairs(words, **options)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), _first(F.col("nb"), F.col("b")).alias("near")), F.struct(F.col("b").alias("word"), _first(F.col("na"), F.col("a")).alias("near")))).alias("it"))
    best = both.groupBy("it.word").agg(F.count(F.lit(1)).alias("n_near"), F.min("it.near").alias("best"))
    found = words.join(best, "word", "left")
    reached = -F.col("best.n") >= ratio * F.col("n")
    found = saved(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(reached, F.col("best.word")).alias("form"), F.when(reached, -F.col("best.n")).alias("form_n")))
    links = saved(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = saved(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        release(links)
        if moved.where("moved").isEmpty():
            break
        links = moved.select("word", "root")
        links.saved_at = moved.saved_at
    out = found.join(moved.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``variants`` of the words of all texts, as ``word_counts`` counts them.

    Null, empty and blank texts have no words; texts of any length are read whole, part by part; repeated rows count each
    time; other columns are not read; an empty table gives an empty table.
    """
    return variants(word_counts(docs, id_col=id_col, text_col=text_col), **options)
