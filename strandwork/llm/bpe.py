"""Byte-level BPE: texts to token ids and back, by the ranks of a public vocabulary.

A text is cut into pre-tokens by the vocabulary's pattern, and each pre-token is merged on its own. Its bytes are a linked
list, and every neighbouring pair that the vocabulary knows waits in the bucket of its rank. A bitmap of three levels says
which buckets hold something: the lowest set bit of each level leads to the next rank in three steps, however many ranks
there are. A merge changes two neighbours, whose new pairs are queued; what they were queued for before is stale and is
skipped when it comes up. So a pre-token of n bytes takes n log n at most, also where it is as long as the text. Pairs of one
rank do not touch each other (or every other one is taken), so a bucket is merged at once, over all pre-tokens at hand.

Tasks work batch by batch without a shuffle. Short pre-tokens that were met before come from a memory of bounded size.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.common import free_name

#: Bits of a bitmap's word, and levels of words: 64^3 ranks.
BITS, LEVELS = 6, 3
#: Pre-tokens of so many characters at most are remembered, so many of them at a time.
MEMORY_CHARS, MEMORY = 64, 3 << 16
#: Characters of texts (or of a part of a long one, cut between pre-tokens) that are learnt together, and of pre-tokens that
#: are merged together; output batches are closed at so many bytes.
PART, MERGED, BATCH = 1 << 22, 1 << 20, 1 << 22


class RankQueue:
    """Positions by rank: a bucket for each rank that has some, and the bitmap of these ranks."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.levels: list[list[int]] = [[0] * (1 << BITS * (LEVELS - 1 - i)) for i in range(LEVELS)]

    def push(self, rank: int, positions: list[int]) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket += positions
            return
        self.buckets[rank] = positions
        for words in self.levels:
            before = words[rank >> BITS]
            words[rank >> BITS] = before | 1 << (rank & 63)
            if before:
                return
            rank >>= BITS

    def pop(self) -> tuple[int, list[int]] | None:
        """The least rank and its whole bucket."""
        rank = 0
        for words in reversed(self.levels):
            word = words[rank]
            if not word:
                return None
            rank = rank << BITS | (word & -word).bit_length() - 1
        at = rank
        for words in self.levels:
            words[at >> BITS] &= ~(1 << (at & 63))
            if words[at >> BITS]:
                break
            at >>= BITS
        return rank, self.buckets.pop(rank)


class Vocabulary:
    """The ranks of a file in tiktoken's form, and the pattern that cuts pre-tokens. A token's id is its rank."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        if max(self.ranks.values()) >> BITS * LEVELS:
            raise ValueError("the vocabulary has more ranks than the bitmap")
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = sorted(pairs)
        self.pair_keys, self.pair_ranks = np.array([*keys, 1 << 62], np.int64), np.array([*(pairs[k] for k in keys), -1], np.int32)
        # Unicode's white space has no information separators, unlike the regex module's \s
        self.cut = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.gap = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})")
        self.queue = RankQueue()
        self.memory: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, -1 for those that are no token."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.int32(-1))

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens, as 32-bit integers of this machine.

        One queue serves all of them: no pair spans two, so the bucket of the least rank can be merged at once. Of pairs of a
        bucket that share a byte run ("aaa") every other one is taken, from the left. Only where a merge makes a pair
        of lesser rank while others of its bucket wait (which trained vocabularies do not lead to) would the order
        within the bucket matter: such a pre-token is merged again, one position at a time.
        """
        return self._merge(pieces, False)

    def _merge(self, pieces: list[bytes], single_steps: bool) -> list[bytes]:
        sizes = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(sizes)
        n, queue, buckets = int(ends[-1]), self.queue, self.queue.buckets
        ids = np.empty(n + 1, np.int32)
        ids[:n], ids[n] = self.single[np.frombuffer(b"".join(pieces), np.uint8)], -1
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[ends - 1], before[ends - sizes] = n, n  # n stands for no neighbour
        held = np.full(n + 1, -1, np.int32)  # the rank that a position is queued for with its right neighbour
        held[: n - 1] = self._rank(ids[: n - 1], ids[1:n])
        held[ends - 1] = -1
        gone, odd = np.zeros(n + 1, bool), set()
        at = np.flatnonzero(held >= 0)
        at = at[np.argsort(held[at], kind="stable")]
        first = np.flatnonzero(np.append([True], held[at][1:] != held[at][:-1])) if len(at) else at
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=False):
            queue.push(int(held[at[lo]]), at[lo:hi].tolist())
        while (found := queue.pop()) is not None:
            rank, bucket = found
            here = np.array(bucket, np.int32)
            here = here[held[here] == rank]
            if not len(here):
                continue
            here.sort()
            if single_steps and len(here) > 1:
                queue.push(rank, here[1:].tolist())
                here = here[:1]
            right = after[here]
            if len(here) > 1 and (shared := here[1:] == right[:-1]).any():
                place = np.arange(len(here))
                start = np.maximum.accumulate(np.where(np.append([False], shared), 0, place))
                here, right = here[(place - start) % 2 == 0], right[(place - start) % 2 == 0]
            following, leading = after[right], before[here]
            if len(here) > 1:
                met = following[:-1] == here[1:]  # merges that become neighbours
                if met.any():
                    middle = here[1:][met]
                    between = self._rank(np.full(len(middle), rank, np.int32), ids[middle])
                    odd.update(np.searchsorted(ends, middle[(between >= 0) & (between < rank)], "right").tolist())
                    leading[1:][met] = n
            ids[here], after[here], before[following], gone[right], held[right] = rank, following, here, True, -1
            changed = np.concatenate([here, leading[leading < n]])
            ranks = self._rank(ids[changed], ids[after[changed]])
            held[changed] = ranks
            known = ranks >= 0
            for r, p in zip(ranks[known].tolist(), changed[known].tolist(), strict=True):
                bucket = buckets.get(r)
                if bucket is None:
                    queue.push(r, [p])
                else:
                    bucket.append(p)
                if r < rank and not single_steps:
                    odd.add(int(np.searchsorted(ends, p, "right")))
        left = ~gone[:n]
        data, stops = ids[:n][left].tobytes(), 4 * np.cumsum(left)[ends - 1]
        out = [data[lo:hi] for lo, hi in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
        for i in odd:
            out[i] = self._merge([pieces[i]], True)[0]
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Puts the ids of all ``pieces`` into the memory: whole tokens, then merges, so many bytes at a time."""
        todo: list[str] = []
        size = 0
        for piece in pieces - self.memory.keys():
            rank = self.ranks.get(piece.encode())
            if rank is not None:
                self.memory[piece] = rank.to_bytes(4, sys.byteorder)
                continue
            todo.append(piece)
            size += len(piece)
            if size >= MERGED:
                self.memory.update(zip(todo, self.merge([p.encode() for p in todo]), strict=True))
                todo, size = [], 0
        if todo:
            self.memory.update(zip(todo, self.merge([p.encode() for p in todo]), strict=True))

    def _forget(self, pieces: set[str]) -> None:
        """Bounds the memory: beyond it only the last pieces stay, and long ones never do."""
        if len(self.memory) > MEMORY:
            self.memory = {p: self.memory[p] for p in pieces} if len(pieces) <= MEMORY else {}
        for piece in [p for p in pieces if len(p) > MEMORY_CHARS]:
            self.memory.pop(piece, None)

    def parts(self, text: str) -> Iterator[str]:
        """``text`` in parts that no pre-token spans: white space behind something else always opens a pre-token."""
        start = 0
        while len(text) - start > PART and (gap := self.gap.search(text, start + PART)):
            yield text[start : gap.start()]
            start = gap.start()
        yield text[start:]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text as 32-bit integers of this machine; texts are learnt from PART characters together."""
        group: list[list[str]] = []
        size, begun = 0, b""

        def given() -> Iterator[bytes]:
            some = set().union(*group)
            self._learn(some)
            for pieces in group:
                yield b"".join(map(self.memory.__getitem__, pieces))
            self._forget(some)

        for text in texts:
            if len(text) <= PART:
                group.append(self.cut.findall(text))
                size += len(text)
                if size >= PART:
                    yield from given()
                    group, size = [], 0
                continue
            yield from given()
            group, size = [], 0
            for part in self.parts(text):
                pieces = self.cut.findall(part)
                some = set(pieces)
                self._learn(some)
                begun += b"".join(map(self.memory.__getitem__, pieces))
                self._forget(some)
            yield begun
            begun = b""
        yield from given()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def _mapped(df: DataFrame, source: str, into: str, kind: str, make: Callable, made: pa.DataType) -> DataFrame:
    """``df`` with ``into``, made of the values of ``source`` by ``make`` (an iterator of byte strings). Output batches are
    closed by size, so that a task holds one input batch and a bounded part of the output."""
    name = free_name(df, into)
    fields = [f"`{c}` {t}" for c, t in df.dtypes if c != source] + [f"`{name}` {kind}"]
    kept = [i for i, c in enumerate(df.columns) if c != source]
    names, at = [*(df.columns[i] for i in kept), name], df.columns.index(source)

    def arrays(parts: list[bytes]) -> pa.Array:
        width = 4 if pa.types.is_list(made) else 1
        ends = array("i", [0])
        for p in parts:
            ends.append(ends[-1] + len(p) // width)
        values, offsets = pa.py_buffer(b"".join(parts)), pa.py_buffer(ends.tobytes())
        if width == 1:
            return pa.Array.from_buffers(made, len(parts), [None, offsets, values])
        inner = pa.Array.from_buffers(pa.int32(), ends[-1], [None, values])
        return pa.Array.from_buffers(made, len(parts), [None, offsets], children=[inner])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, size = 0, [], 0
            for row, value in enumerate(make(batch.column(at)), 1):
                held.append(value)
                size += len(value)
                if size >= BATCH or row == batch.num_rows:
                    rest = [batch.column(i).slice(start, row - start) for i in kept]
                    yield pa.RecordBatch.from_arrays([*rest, arrays(held)], names)
                    start, held, size = row, [], 0

    return df.mapInArrow(run, ", ".join(fields))


def encode(docs: DataFrame, vocabulary: Callable[[], tuple[str, str]], *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int) in place of the text: for each pre-token what merging by least rank gives.

    ``vocabulary`` gives the path of the rank file and the pattern; it is called on the executors. Null and empty texts
    have no ids; repeated rows and ties are encoded alike; other columns stay (a clashing name gets an underscore at its
    end); an empty table stays empty. No special tokens: their strings are ordinary text.
    """

    def make(texts: pa.Array) -> Iterator[bytes]:
        known = _vocabulary(*vocabulary())
        return known.encode(x.as_py() or "" for x in texts)

    return _mapped(docs, text_col, "ids", "array<int>", make, pa.list_(pa.int32()))


def decode(df: DataFrame, vocabulary: Callable[[], tuple[str, str]], *, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the bytes that the ids stand for, in place of the ids. Null is taken as no ids; an id that
    the vocabulary does not have is an error."""

    def make(rows: pa.Array) -> Iterator[bytes]:
        known = _vocabulary(*vocabulary())
        values, ends, there = rows.values.to_numpy(), rows.offsets.to_pylist(), rows.is_valid().to_pylist()
        return (known.decode(values[lo:hi].tolist() if valid else []) for lo, hi, valid in zip(ends, ends[1:], there, strict=False))

    return _mapped(df, ids_col, "decoded", "binary", make, pa.binary())
