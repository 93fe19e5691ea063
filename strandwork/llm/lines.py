"""Line dedup by overlapping windows of three lines.

Each document's lines are hashed, every three lines that follow each other form a window, and windows that occur more
than once in the whole table are found. All occurrences after the first (by document id, then position) are removed:
what they cover is merged per document, so overlapping windows remove a passage as a whole. Lines that hold no word do
not count, and neither does white space around words.

A line ends at a line feed. Texts whose paragraphs are one line each can be *wrapped*: a line of more words than ``wrap``
is cut by content, after words whose hash is the least among their neighbours, five to nine words apart. Where a passage
stands in a paragraph thus does not matter, only its first and last words can fall into lines that differ.

One pass over the texts writes a narrow row for each window. All else is on these rows, and the spans to remove are
joined to the documents at the end and cut out by column functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.llm.common import free_name, saved

LINES = 3
CHUNK = 1 << 20
KNOWN_WORDS = 500_000
#: A window that is more than this part of all is dealt to tasks by a salt too, so there are fewer such windows than this.
HOT = 4096
#: Cuts by content lie more than so many words from each other and from a line's ends.
APART = 4
ROUNDS = 3
#: The wrapping of the registered query and of the pipeline: the longest line that content cuts make.
WRAP = 2 * APART + 1
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd multipliers
_MOST = np.uint64((1 << 64) - 1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    return x ^ (x >> np.uint64(29))


def _powers(n: int, factor: np.uint64) -> np.ndarray:
    return np.multiply.accumulate(np.full(max(n, 1), factor, np.uint64))


def _alone(data: np.ndarray) -> np.ndarray:
    """Where letters of scripts without blanks start; each is a word of its own."""
    second = np.append(data[1:], np.uint8(0))
    alone = (data >= 0xE3) & (data <= 0xE9)  # kana and Chinese characters
    alone |= (data == 0xE0) & (second >= 0xB8) & (second <= 0xBB)  # Thai, Lao
    alone |= (data == 0xE1) & ((second <= 0x82) | (second == 0x9E) | (second == 0x9F))  # Burmese, Khmer
    return np.flatnonzero(alone)


def _words(joined: bytes, data: np.ndarray, known: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word: runs of bytes other than the six blanks."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    begins = ~blank
    begins[1:] &= blank[:-1]
    at = _alone(data) if (data >= 0xE0).any() else ()
    if not len(at):
        words = joined.split()
        return np.flatnonzero(begins), np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    begins[at] = True
    begins[at + 3] |= ~blank[at + 3]
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(blank)
    ends = np.minimum(stops[np.searchsorted(stops, starts)], np.append(starts[1:], len(data)))
    return starts, np.fromiter((known[joined[s:e]] for s, e in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def _content_cuts(key: np.ndarray, hard: np.ndarray, wrap: int) -> np.ndarray:
    """The words that end a line: those of ``hard``, and in longer lines than ``wrap`` a largest set of words that are more
    than APART from each other and from the line's ends, chosen by least hash so that it depends on the words near by only."""
    ends = np.flatnonzero(hard)
    sizes = np.diff(ends, prepend=-1)
    if sizes.max() <= wrap:
        return hard
    last = np.repeat(ends, sizes)
    size = np.repeat(sizes, sizes)
    at = np.arange(len(hard))
    alive = (at - (last - size + 1) >= APART) & (last - at > APART) & (size > wrap)
    cut = hard.copy()
    for r in range(ROUNDS):
        if not alive.any():
            return cut
        k = np.where(alive, _mix(key + np.uint64(r) * _M2) >> np.uint64(1), _MOST)
        least = alive.copy()
        for d in range(1, APART + 1):
            least[:-d] &= k[:-d] < k[d:]
            least[d:] &= k[d:] <= k[:-d]
        cut |= least
        near = least.copy()
        for d in range(1, APART + 1):
            near[d:] |= least[:-d]
            near[:-d] |= least[d:]
        alive &= ~near
    # what rounds leave is in runs of one repeated word, mostly: at equal steps
    left = np.flatnonzero(alive)
    if len(left):
        opens = np.flatnonzero(np.diff(left, prepend=-2) > 1)
        lengths = np.diff(opens, append=len(left))
        rank = np.arange(len(left)) - np.repeat(opens, lengths)
        step = 2 * APART + 1
        take = rank % step == APART
        closes = opens + lengths - 1
        take[closes] |= rank[closes] % step < APART
        cut[left[take]] = True
    return cut


def _lines(texts: list[bytes], known: _Hashes, wrap: int) -> dict[str, np.ndarray]:
    """The lines of texts in UTF-8: text number ``owner``, ``start`` and ``end`` in bytes of the text, and two hashes.

    A line's indentation belongs to it, and so do the blank lines behind it."""
    none = np.zeros(0, np.int64)
    empty = {"owner": none, "start": none, "end": none, "one": none.astype(np.uint64), "two": none.astype(np.uint64)}
    joined = b"\n".join([*texts, b""])
    data = np.frombuffer(joined, np.uint8)
    bounds = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
    if not len(data):
        return empty
    start, word = _words(joined, data, known)
    if not len(start):
        return empty
    feeds = np.flatnonzero(data == 10)
    row = np.searchsorted(feeds, start)  # line feeds before each word
    hard = np.append(row[1:] != row[:-1], True)
    with np.errstate(over="ignore"):
        cut = _content_cuts(word, hard, wrap) if wrap else hard
        first = np.append(0, np.flatnonzero(cut)[:-1] + 1)
        words = np.diff(first, append=len(start))
        place = np.arange(len(start)) - np.repeat(first, words)
        inside = _powers(int(words.max()), _M2)[place]
        one = _mix(np.add.reduceat(_mix(word) * inside, first))
        two = _mix(np.add.reduceat(_mix(word + _M1) * inside, first) + _M2)
    owner, opens = np.searchsorted(bounds, start[first], "right") - 1, start[first]
    fresh = np.append(True, owner[1:] != owner[:-1])
    feed = np.append(-1, feeds)[row[first]] + 1
    begin = np.where(fresh | np.append(True, row[first][1:] != row[first][:-1]), np.maximum(feed, bounds[owner]), opens)
    close = np.where(np.append(fresh[1:], True), bounds[owner + 1] - 1, np.append(begin[1:], 0))
    return {"owner": owner, "start": begin - bounds[owner], "end": close - bounds[owner], "one": one, "two": two}


def line_spans(text: str, wrap: int = 0) -> list[tuple[int, int]]:
    """Start and end, in bytes of UTF-8, of each line that holds a word."""
    found = _lines([text.encode()], _Hashes(), wrap)
    return list(zip(found["start"].tolist(), found["end"].tolist()))


def _chunks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a column in parts of about CHUNK bytes, with the number of the first; null is as empty."""
    begin, size, texts = 0, 0, []
    for i, value in enumerate(column):
        texts.append(value.as_buffer().to_pybytes() if value.is_valid else b"")
        size += len(texts[-1])
        if size > CHUNK or i + 1 == len(column):
            yield begin, texts
            begin, size, texts = i + 1, 0, []


def windows(docs: DataFrame, *, id_col: str, text_col: str, wrap: int = 0) -> DataFrame:
    """A row for each window of three lines: ``__id``, ``__key`` (hash of the text), ``__span`` (its first byte in the upper
    half, the byte behind its last in the lower), and its hash in 64 bits ``__x`` and 32 more ``__y``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            for begin, texts in _chunks(batch.column(2)):
                if len(known) > KNOWN_WORDS:
                    known.clear()
                found = _lines(texts, known, wrap)
                owner, a, b = found["owner"], found["one"], found["two"]
                n = max(len(owner) - LINES + 1, 0)
                x, y = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(LINES):
                        x = (x ^ (x >> np.uint64(31))) * _M1 + a[k : n + k]
                        y = (y ^ (y >> np.uint64(29))) * _M2 + b[k : n + k]
                at = np.flatnonzero(owner[:n] == owner[LINES - 1 :][:n])
                rows = pa.array(owner[at] + begin)
                span = found["start"][at] << 32 | found["end"][at + LINES - 1]
                cols = [batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(c) for c in (span, x[at].view(np.int64), (y[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)))]
                yield pa.RecordBatch.from_arrays(cols, names=["__id", "__key", "__span", "__x", "__y"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`").cast("string")
    parts = docs.select(F.col(f"`{id_col}`").alias("__id"), F.xxhash64(text).alias("__key"), text.alias("__text")).where("__text IS NOT NULL")
    return parts.mapInArrow(run, f"__id {kind}, __key long, __span long, __x long, __y int")


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", wrap: int = 0) -> DataFrame:
    """What to remove: ``__id``, ``__key`` (hash of the text) and ``__cuts``, the sorted, disjoint spans (from, to; in bytes) of
    each document that has any. A repeat that overlaps the first occurrence leaves that one whole."""
    each = saved(windows(docs, id_col=id_col, text_col=text_col, wrap=wrap))
    # a part of the hash finds what may be repeated, all of it decides below
    often = saved(each.groupBy("__x").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1"))
    many = (often.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0] + HOT) // HOT
    # the few windows that are a large part of all repeated ones are dealt by a salt too, the more the more often they occur
    salts = F.ceil(F.col("__n") / F.lit(many)).cast("int")
    hot = F.broadcast(often.where(F.col("__n") > many).select("__x", salts.alias("__salts")))
    dealt = often.select("__x", F.explode(F.sequence(F.lit(0), salts - 1)).alias("__salt"))
    salt = F.coalesce(F.pmod(F.xxhash64("__id", "__key", "__span"), F.col("__salts")).cast("int"), F.lit(0))
    each = each.join(hot, "__x", "left").withColumn("__salt", salt).drop("__salts")
    found = saved(each.join(dealt, ["__x", "__salt"]).select("__id", "__key", "__span", "__x", "__y", "__salt"))
    here = F.struct("__id", "__key", "__span")
    first = found.groupBy("__x", "__y").agg(F.min(here).alias("__first"), F.count(F.lit(1)).alias("__n"), F.max("__salt").alias("__top")).where("__n > 1")
    first = first.select("__x", "__y", "__first", F.explode(F.sequence(F.lit(0), "__top")).alias("__salt"))
    later = found.join(first, ["__x", "__y", "__salt"]).where(~here.eqNullSafe(F.col("__first")))

    def from_of(span: Column) -> Column:
        return F.shiftrightunsigned(span, 32)

    def to_of(span: Column) -> Column:
        return span.bitwiseAND(F.lit((1 << 32) - 1))

    own = F.col("__id").eqNullSafe(F.col("__first.__id")) & (F.col("__key") == F.col("__first.__key"))
    begin = F.when(own, F.greatest(from_of(F.col("__span")), to_of(F.col("__first.__span")))).otherwise(from_of(F.col("__span")))
    spans = later.select("__id", "__key", F.struct(begin.alias("__from"), to_of(F.col("__span")).alias("__to")).alias("__it")).where("__it.__from < __it.__to")
    # rows equal in id and text have the same spans: each is one before they meet, task by task
    spans = spans.groupBy("__id", "__key").agg(F.collect_set("__it").alias("__all")).select("__id", "__key", F.inline("__all"))
    # a document's spans, which are bounded by its length, are merged in order
    order = Window.partitionBy("__id", "__key").orderBy("__from", "__to")
    reach = F.max("__to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("__new", F.when(F.col("__from") <= reach, 0).otherwise(1))
    isles = opened.withColumn("__isle", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = isles.groupBy("__id", "__key", "__isle").agg(F.min("__from").alias("from"), F.max("__to").alias("to"))
    cuts = F.sort_array(F.collect_list(F.struct(F.col("from").cast("int").alias("from"), F.col("to").cast("int").alias("to"))))
    return merged.groupBy("__id", "__key").agg(cuts.alias("__cuts"))


def remove_repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", wrap: int = 0) -> DataFrame:
    """``docs`` with the repeated lines cut out of the text, and ``removed_parts`` and ``removed_bytes``: how many passages
    and how many bytes of UTF-8 were removed, 0 where nothing was.

    ``wrap``: 0 takes lines as they are; otherwise longer lines than so many words are cut by content. Every row comes back with
    all its columns; a new column whose name is taken gets an underscore. A null text stays null; a text that loses all
    lines becomes empty. Rows equal in id and text are one document: what one of them keeps the others keep. Null ids
    come first in order. Documents of fewer than three lines have no window. Texts may be as long as a string can be;
    a task holds the lines of one text, or of about a megabyte of texts. An empty table gives an empty result.
    """
    gone, columns, at = repeated_spans(docs, id_col=id_col, text_col=text_col, wrap=wrap), docs.columns, {}
    for name in ("__id", "__key", "__cuts"):
        at[name] = free_name(docs, name)
    gone = gone.withColumnsRenamed({old: new for old, new in at.items() if old != new})
    text = F.col(f"`{text_col}`").cast("string")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(at["__id"])) & (F.xxhash64(text) == F.col(at["__key"]))
    joined = docs.join(gone, same, "left")
    cuts, raw = F.col(at["__cuts"]), text.cast("binary")

    def piece(i: Column) -> Column:
        begin = F.coalesce(F.get(cuts, i - 1)["to"], F.lit(0))
        end = F.coalesce(F.get(cuts, i)["from"], F.octet_length(text))
        return F.substring(raw, begin + 1, end - begin).cast("string")

    left = F.array_join(F.transform(F.sequence(F.lit(0), F.size(cuts)), piece), "")
    lost = F.aggregate(cuts, F.lit(0), lambda n, c: n + c["to"] - c["from"])
    new = {c: F.col(f"`{c}`") for c in columns}
    new[text_col] = F.when(cuts.isNull(), F.col(f"`{text_col}`")).otherwise(left)
    parts_name, bytes_name = free_name(docs, "removed_parts"), free_name(docs, "removed_bytes")
    new |= {parts_name: F.when(cuts.isNull(), 0).otherwise(F.size(cuts)), bytes_name: F.when(cuts.isNull(), 0).otherwise(lost)}
    return joined.select(*(c.alias(n) for n, c in new.items()))
