"""Hierarchical multi-length packing of tokenised documents.

Every document is cut into pieces that fill windows of a few context sizes (tiers) exactly:

1. *Route*: whole windows of the longest size are cut off; the rest of the document goes to the smallest tier that holds it.
2. *Long windows*: in the longest tier each rest opens a window, and its gap is filled from the shorter tiers' pools,
   largest pool first; the piece that closes the window is cut and what is left goes back to its pool.
3. *Short windows*: each shorter tier closes a window whenever its pool holds a window's worth of tokens.
4. *Remainder*: what the pools hold when the task's rows end fills windows of falling powers of two, so nothing is padded.
5. *Step groups*: windows of one size are numbered across all tasks and dealt, in order, to groups of equal token count,
   so that a training step sees one context size and the same number of tokens as any other step. Of each size one group
   in all may be short.

Packing is per task and per Arrow batch, without a shuffle: a pool never holds more than one window of its tier after a
batch, and a lost executor repeats only its own splits with the same result. The windows are written once, for step
groups need the number of windows that the tasks before made, which is a table of tasks by sizes.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwork.llm.common import saved

ID_BYTES = 4
CACHED_WORDS = 600_000
#: The table of windows by task and size is broadcast up to so many rows.
MAX_BROADCAST_ROWS = 200_000

#: White space that is rare enough to send a text to the tokenizer whole (fixed values: Unicode's beyond ASCII's six).
_RARE_SPACE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A space whose both neighbours are white space or an end.
_INNER_SPACE = re.compile(r"(?:\A|\s) (?:\s|\Z)")
_BESIDE = [f"{c} " for c in " \t\n\v\f\r"]


def _byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Known(dict):
    """Ids of a word with a space in front of it, found when first asked for."""

    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode_word = encode

    def __missing__(self, word: str) -> bytes:
        found = self[word] = array("I", self.encode_word(f" {word}")).tobytes()
        return found


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit integers, through a memory of the words seen.

    A byte-level BPE vocabulary splits a text into words before it merges bytes, and a single space always opens the
    word that follows it. So the ids of a text are the ids of its parts between spaces, each with its space in front.
    Texts with other arrangements of spaces, or with a special token, go whole to the tokenizer of the file.
    Where the merges of the file come in the order of their ids, words are merged by the same table in ``tiktoken``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel unit
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())
        self.rare = [*_RARE_SPACE, *(t["content"] for t in model["added_tokens"])]
        self.known = _Known(self._merges(model["model"]) or self._plain)

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _merges(model: dict) -> Callable[[str], list[int]] | None:
        vocab, letters = model["vocab"], _byte_letters()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [vocab["".join(p)] for p in pairs]
        if order != sorted(set(order)) or any(len(w) > 1 and vocab[w] < order[0] for w in vocab):
            return None
        import tiktoken
        from public_tokenizers import PATTERN

        ranks = {bytes(letters[c] for c in w): i for w, i in vocab.items() if i <= order[-1]}
        return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        beside = text[0] == " " or text[-1] == " " or any(x in text for x in _BESIDE)
        if any(x in text for x in self.rare) or beside and _INNER_SPACE.search(text):
            return array("I", self._plain(text)).tobytes()
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        first, *rest = text.split(" ")
        head = array("I", known.encode_word(first)).tobytes()
        return head + b"".join(map(known.__getitem__, rest))


class _Packer:
    """The windows of one task. A piece is (row, start, length); ``rows`` maps a row to its id bytes while pieces refer to it."""

    def __init__(self, tiers: list[int], task: int):
        self.tiers, self.top, self.task = tiers, tiers[-1], task
        self.pools = {t: deque() for t in tiers[:-1]}
        self.held = dict.fromkeys(tiers[:-1], 0)
        self.count = 0
        self.by_size: dict[int, int] = {}
        self.out: list[tuple] = []

    def _close(self, pieces: list[tuple], size: int) -> None:
        nth = self.by_size.get(size, 0)
        self.by_size[size] = nth + 1
        at, sequence = 0, (self.task << 33) + self.count
        self.count += 1
        for row, start, length in pieces:
            self.out.append((row, start, length, sequence, at, size, nth))
            at += length

    def _take(self, tier: int, wanted: int) -> list[tuple]:
        """Pieces of ``wanted`` tokens at most from a tier's pool; the last is cut where it must be."""
        got, pool = [], self.pools[tier]
        while wanted and pool:
            row, start, length = pool.popleft()
            use = min(length, wanted)
            got.append((row, start, use))
            if use < length:
                pool.appendleft((row, start + use, length - use))
            wanted -= use
            self.held[tier] -= use
        return got

    def add(self, row: int, tokens: int) -> None:
        start = 0
        while tokens - start >= self.top:
            self._close([(row, start, self.top)], self.top)
            start += self.top
        rest = tokens - start
        if not rest:
            return
        tier = next(t for t in self.tiers if t >= rest)
        if tier < self.top:
            self.pools[tier].append((row, start, rest))
            self.held[tier] += rest
            return
        pieces, gap = [(row, start, rest)], self.top - rest
        for t in sorted(self.held, key=self.held.get, reverse=True):
            if gap:
                more = self._take(t, gap)
                pieces += more
                gap -= sum(p[2] for p in more)
        if gap:  # the shorter pools are empty: the opener waits among them
            t = self.tiers[-2]
            self.pools[t].extendleft(reversed(pieces))
            self.held[t] += self.top - gap
        else:
            self._close(pieces, self.top)

    def close_full(self) -> None:
        for t in self.tiers[:-1]:
            while self.held[t] >= t:
                self._close(self._take(t, t), t)

    def close_rest(self) -> None:
        total = sum(self.held.values())
        left = [p for t in reversed(self.tiers[:-1]) for p in self._take(t, self.held[t])]
        pool = deque(left)
        self.pools[self.tiers[0]], self.held[self.tiers[0]] = pool, total
        size = self.top
        while total:
            if total >= size:
                self._close(self._take(self.tiers[0], size), size)
                total -= size
            else:
                size //= 2

    def waiting(self) -> set[int]:
        return {p[0] for pool in self.pools.values() for p in pool}


def pack(
    docs: DataFrame,
    tokenizer: Callable[[], str],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: tuple[int, ...] = (128, 256, 512, 1024),
    end_id: int = 0,
    step_tokens: int = 1 << 16,
    keep_ids: bool = True,
) -> DataFrame:
    """Pieces of the documents of ``docs`` packed into windows of the given ``tiers`` (powers of two).

    ``tokenizer`` returns, on an executor, the path of a tokenizer file. ``end_id`` closes each document. Every token of
    a document lies in exactly one piece. Rows: the id, ``start`` (the document's tokens before the piece), ``length``,
    ``ids`` (the piece's little-endian 32-bit ids, unless ``keep_ids`` is false), ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` (in the sequence), ``sequence_tokens`` and ``step_group``, of ``step_tokens`` tokens (a
    multiple of each tier; the last group of a size may have fewer).

    A null or empty text is a document of the end token alone. A null id is kept. Repeated rows are packed each for
    itself. Texts of any length are encoded whole; a task holds the ids of the texts of one Arrow batch, and of those
    whose pieces still wait. An empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    if any(t & (t - 1) for t in tiers) or len(tiers) < 2:
        raise ValueError("tiers are two or more powers of two")
    if step_tokens % max(tiers):
        raise ValueError("a step group holds whole windows of each tier")
    order = sorted(tiers)
    end = end_id.to_bytes(ID_BYTES, "little")
    fields = [("doc_id", docs.schema[id_col].dataType.simpleString()), ("start", "long"), ("length", "long")]
    fields += [("ids", "binary")] if keep_ids else []
    fields += [(n, "long") for n in ("ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "nth")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer())
        task = TaskContext.get().partitionId()
        packer, ids, tokens, row = _Packer(order, task), {}, {}, 0

        def emit() -> pa.RecordBatch:
            out, packer.out = packer.out, []
            parts = [memoryview(tokens[r])[s * ID_BYTES : (s + n) * ID_BYTES] for r, s, n, *_ in out]
            cols = {"doc_id": pa.array([ids[r] for r, *_ in out], type=kind), "start": [x[1] for x in out], "length": [x[2] for x in out]}
            if keep_ids:
                cols["ids"] = pa.array([bytes(p) for p in parts], type=pa.binary())
            cols["ids_crc32"] = [zlib.crc32(p) for p in parts]
            cols["doc_tokens"] = [len(tokens[x[0]]) // ID_BYTES for x in out]
            for i, n in enumerate(("sequence_id", "offset", "sequence_tokens", "nth"), 3):
                cols[n] = [x[i] for x in out]
            kept = packer.waiting()
            for r in [r for r in tokens if r not in kept]:
                del tokens[r], ids[r]
            return pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, type=pa.int64()) for c in cols.values()], names=list(cols)
            )

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            pending = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                enc = encoder.encode(text.as_py())
                ids[row], tokens[row] = key, enc + end
                packer.add(row, len(enc) // ID_BYTES + 1)
                packer.close_full()
                pending += len(enc)
                row += 1
                if pending > 8 << 20:
                    yield emit()
                    pending = 0
            yield emit()
        if kind is not None:
            packer.close_rest()
            yield emit()

    spec = ", ".join(f"`{n}` {t}" for n, t in fields)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    packed = saved(rows.mapInArrow(run, spec).withColumn("task", F.shiftright("sequence_id", 33)))
    made = packed.where("offset = 0").groupBy("task", "sequence_tokens").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("sequence_tokens").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    made = saved(made.select("task", "sequence_tokens", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    group = F.expr(f"(before + nth) * sequence_tokens div {step_tokens}").bitwiseOR(F.call_function("shiftleft", F.col("sequence_tokens"), F.lit(40)))
    # a row for each task and size: broadcast, tokens stay where they are; beyond the bound, windows are dealt by both
    few = F.broadcast(made) if made.count() <= MAX_BROADCAST_ROWS else made
    numbered = packed.join(few, ["task", "sequence_tokens"]).withColumn("step_group", group)
    return numbered.select(*(n for n, _ in fields if n != "nth"), "step_group")
