"""Quality rules: counts over words and lines, then distribution divergence from language references.

A document's bytes fall into character classes, its words into the common words of its language and a rest. Both
histograms are compared with the reference of the document's language by Jensen-Shannon distance. References, and which
words are common, are learned here, over all documents that pass the count rules. Short documents are not judged by a
histogram that they have too few characters or words for.

Two passes over the texts and no shuffle of them. The first sums character classes and words by language, each task by
itself, then over all. The second computes each document's counts again and gives the verdict beside the document's own
columns; its language's reference comes by a join on the language, so there may be any number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandwork.llm.common import free_name, saved, spread_join

#: So many words of a language, its most frequent ones, are its common words.
COMMON = 40
#: What surrounds a word without being part of it.
AROUND = b".,;:!?\"'()[]{}*#%$&|<>"
#: ASCII characters that count as symbols.
SYMBOLS = "#*$%&|<>"
LOWER, UPPER, DIGIT, SPACE, STOP, MARK, SYMBOL, OTHER, WIDE, TAIL = range(10)
CLASSES = 10
CHUNK = 1 << 21
KNOWN_WORDS, KNOWN_LANGUAGES = 1_000_000, 1000
#: References are broadcast up to so many languages.
MAX_BROADCAST_LANGUAGES = 1000
#: Counts of forms by language that a task holds before it hands them on.
MOST_COUNTS = 16_000_000
_BLANK = b" \t\n\v\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # 2^64 over the golden ratio


def _class_of_byte() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[ord("a") : ord("z") + 1], kind[ord("A") : ord("Z") + 1], kind[ord("0") : ord("9") + 1] = LOWER, UPPER, DIGIT
    kind[list(_BLANK)], kind[list(b".,")], kind[list(b"!?;:'\"()-")] = SPACE, STOP, MARK
    kind[list(SYMBOLS.encode())], kind[0xC0:], kind[0x80:0xC0] = SYMBOL, WIDE, TAIL
    return kind


class _Words(dict):
    """Numbers of words, with a hash (of this process) and the number of the form of each: in lower case, without marks
    around it. Words are case-folded as text, so that accented capitals count too."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.forms, self.form_list = {}, []
        self.new_hashes, self.new_forms = [], []
        self.hashes, self.form_of = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new_hashes.append(hash(word))
        form = word.strip(AROUND).decode("utf-8", "replace").lower()
        at = self.forms.setdefault(form, len(self.forms))
        if at == len(self.form_list):
            self.form_list.append(form)
        self.new_forms.append(at)
        return n

    def grow(self) -> None:
        if self.new_hashes:
            self.hashes = np.concatenate([self.hashes, np.array(self.new_hashes, np.int64)])
            self.form_of = np.concatenate([self.form_of, np.array(self.new_forms, np.int64)])
            self.new_hashes, self.new_forms = [], []


_KIND = _class_of_byte()


def _dup_lines(raw: bytes) -> int:
    seen, n = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(_BLANK):
            seen.add(line)
    return n


def _repeat_words(ids: np.ndarray, hashes: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """For each text, its words that lie in a window of words which the text has twice or more."""
    n = len(ids)
    owner = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    if n < window:
        return np.zeros(len(counts), np.int64)
    h = hashes[ids]
    key = np.zeros(n - window + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(window):
            key = (key ^ (key >> np.uint64(29))) * MULTIPLIER + h[i : n - window + 1 + i]
        key = (key ^ owner[: len(key)].astype(np.uint64)) * MULTIPLIER
    inside = owner[: len(key)] == owner[window - 1 :]
    at = np.flatnonzero(inside)
    _, back, often = np.unique(key[at], return_inverse=True, return_counts=True)
    starts = at[often[back] > 1]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.bincount(owner[np.cumsum(edge[:n]) > 0], minlength=len(counts))


def _measure(texts: list[bytes], words: _Words, window: int = 5) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The counts and character classes of some texts, and the text and the form of each of their words."""
    split = [t.split() for t in texts]
    counts = np.array([len(s) for s in split], np.int64)
    ids = np.array([i for s in split for i in map(words.__getitem__, s)], np.int64)
    words.grow()
    chars = np.array([np.bincount(_KIND[np.frombuffer(t, np.uint8)], minlength=CLASSES) for t in texts]).reshape(-1, CLASSES)
    found = {
        "n_words": counts,
        "word_chars": chars.sum(axis=1) - chars[:, SPACE] - chars[:, TAIL],
        "n_symbols": chars[:, SYMBOL],
        "n_dup_lines": np.array([_dup_lines(t) for t in texts], np.int64),
        "n_repeat_words": _repeat_words(ids, words.hashes.view(np.uint64), counts, window),
    }
    return found, chars[:, :TAIL], np.repeat(np.arange(len(texts)), counts), words.form_of[ids]


def _base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def _chunks(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with about CHUNK bytes of text each."""
    column, start, size, texts = batch.column(text), 0, 0, []
    for i, value in enumerate(column):
        raw = value.as_buffer().to_pybytes() if value.is_valid else b""
        texts.append(raw)
        size += len(raw)
        if size > CHUNK or i + 1 == len(column):
            yield batch.slice(start, len(texts)), texts
            start, size, texts = i + 1, 0, []


def _shares(h: np.ndarray) -> np.ndarray:
    return h / np.maximum(h.sum(axis=1, keepdims=True), 1)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, from 0 to 1) of the rows of two arrays of shares."""
    m = (p + q) / 2

    def kl(a: np.ndarray) -> np.ndarray:
        return np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(axis=1)

    return np.sqrt(np.maximum((kl(p) + kl(q)) / 2, 0))


def language_references(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", min_words: int = 50, common: int = COMMON) -> DataFrame:
    """A row for each language (null is one) with a document of ``min_words`` words that passes the count rules: ``lang``, ``docs``,
    ``chars`` (sums of the character classes over these documents), ``words`` (all their words), ``common`` (the most
    frequent forms, by count and then by name) and ``counts`` of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        number: dict[str | None, int] = {}
        sums, counts, trained = [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, i in number.items():
                at = np.flatnonzero(counts[i])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * (len(at) + 1), pa.string()),
                        pa.array([None, *(words.form_list[j] for j in at)], pa.string()),
                        pa.array(np.append(trained[i], counts[i][at])),
                        pa.array([sums[i].tolist(), *[None] * len(at)], pa.list_(pa.int64())),
                    ],
                    names=["lang", "form", "n", "chars"],
                )
            words.reset()
            number.clear()
            for held in (sums, counts, trained):
                held.clear()

        for batch in batches:
            for part, texts in _chunks(batch, 1):
                found, chars, owner, forms = _measure(texts, words)
                use = ~_base_failed(found) & (found["n_words"] >= min_words)
                langs = part.column(0).to_pylist()
                for lang in set(langs):
                    if lang not in number:
                        number[lang] = len(number)
                        sums.append(np.zeros(TAIL, np.int64))
                        counts.append(np.zeros(0, np.int64))
                        trained.append(0)
                    i = number[lang]
                    mine = use & np.array([x == lang for x in langs])
                    more = np.bincount(forms[mine[owner]], minlength=len(words.form_list))
                    more[: len(counts[i])] += counts[i]
                    counts[i] = more
                    sums[i] = sums[i] + chars[mine].sum(axis=0)
                    trained[i] += int(mine.sum())
                if len(words) > KNOWN_WORDS or len(words.form_list) * len(number) > MOST_COUNTS:
                    yield from flush()
        yield from flush()

    parts = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    each = parts.mapInArrow(run, "lang string, form string, n long, chars array<long>")
    char_sums = [F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(TAIL)]
    forms = saved(each.groupBy("lang", "form").agg(F.sum("n").alias("n"), *char_sums))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "form"))
    top = forms.where("form <> ''").select("lang", "form", "n", rank.alias("rank")).where(F.col("rank") <= common)
    listed = F.array_sort(F.collect_list(F.struct("rank", "form", "n")))
    top = top.groupBy("lang").agg(listed.alias("top")).select(F.col("lang").alias("of"), F.col("top.form").alias("common"), F.col("top.n").alias("counts"))
    whole = forms.where("form IS NULL AND n > 0").select("lang", F.col("n").alias("docs"), F.array(*(F.col(f"c{i}") for i in range(TAIL))).alias("chars"))
    words = forms.where("form IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("words")).select(F.col("lang").alias("its"), "words")
    met = whole.join(top, F.col("lang").eqNullSafe(F.col("of"))).join(words, F.col("lang").eqNullSafe(F.col("its")))
    return saved(met.select("lang", "docs", "chars", "words", "common", "counts"))


class _Reference:
    """Shares of character classes, and of common words and the rest, of a language."""

    def __init__(self, chars: list[int], words: int, common: list[str], counts: list[int]):
        self.chars = _shares(np.array([chars], float))[0]
        self.share = dict(zip(common, np.array(counts, float) / max(words, 1)))

    def over(self, vocabulary: list[str]) -> np.ndarray:
        own = np.array([self.share.get(w, 0.0) for w in vocabulary])
        return np.append(own, 1.0 - own.sum())


class _Judge:
    """The distances of documents of one language from its reference and from its halfway blends with others."""

    def __init__(self, own: _Reference, others: list[_Reference]):
        self.vocabulary = list(dict.fromkeys(w for r in (own, *others) for w in r.share))
        self.at = {w: i for i, w in enumerate(self.vocabulary)}
        self.chars = [(own.chars + r.chars) / 2 for r in (own, *others)]
        self.blends = []
        for r in (own, *others):
            both = list(dict.fromkeys([*own.share, *r.share]))
            self.blends.append(([self.at[w] for w in both], (own.over(both) + r.over(both)) / 2))

    def distances(self, chars: np.ndarray, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``words``: how often each document has the words of the vocabulary; ``counts``: all its words."""
        shares = _shares(chars)
        by_chars = np.min([js_distance(shares, c) for c in self.chars], axis=0)
        by_words = []
        for columns, reference in self.blends:
            own = words[:, columns] / np.maximum(counts, 1)[:, None]
            by_words.append(js_distance(np.hstack([own, 1.0 - own.sum(axis=1, keepdims=True)]), reference))
        return by_chars, np.min(by_words, axis=0)


def judge(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    max_char_distance: float = 0.3,
    joint_distances: tuple[float, float] = (0.12, 0.35),
    blend_with: int = 8,
    min_chars: int = 200,
    min_words: int = 50,
    common: int = COMMON,
    prefix: str = "",
) -> DataFrame:
    """``docs`` with the counts of COUNTS, ``base_failed``, ``js_chars``, ``js_words`` and ``kept``.

    ``kept`` is false where the count rules fail (under 10 words, or over 20 % of the words in repeated five-word
    windows), where the character classes lie further than ``max_char_distance`` from the reference (in documents of at
    least ``min_chars`` characters in words), or where characters and common words both lie further from it than
    ``joint_distances`` (in documents of at least ``min_words`` words). A distance that is not judged is null.
    A document may change its language midway: each distance is the least to its language's reference and to the
    halfway blends of that with the ``blend_with`` references of the most documents.

    Every row of ``docs`` comes back with all its columns; a verdict column whose name is taken gets an underscore.
    A null text has no words and fails. A null language has a reference of its own, apart from an empty one's; a language
    without any document to train on is judged by the count rules alone. Texts of any length are measured whole, a few
    megabytes at a time in a task, or one text. Repeated rows get the same verdict, and each trains. An empty table
    gives an empty result.
    """
    refs = language_references(docs, text_col=text_col, lang_col=lang_col, min_words=min_words, common=common)
    columns = docs.columns
    names = [free_name(docs, prefix + n) for n in (*COUNTS, "base_failed", "js_chars", "js_words", "kept")]
    kinds = ["long"] * len(COUNTS) + ["boolean", "double", "double", "boolean"]
    largest = refs.orderBy(F.desc("docs"), F.col("lang").asc_nulls_first()).limit(blend_with).collect()
    shared = docs.sparkSession.sparkContext.broadcast([(r["lang"], r["chars"], r["words"], list(r["common"]), r["counts"]) for r in largest])
    named = {"no_lang": F.col("lang").isNull(), "name": F.coalesce("lang", F.lit(""))}
    own = refs.withColumns(named).select("no_lang", "name", F.struct("chars", "words", "common", "counts").alias("reference"))
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(f"`{lang_col}`").cast("string").alias("lang")).withColumns(named)
    # texts stay where they are while references are few; else a language's rows are dealt by a salt too
    if refs.count() <= MAX_BROADCAST_LANGUAGES:
        joined = held.join(F.broadcast(own), ["no_lang", "name"], "left")
    else:
        joined = spread_join(held, own, ["no_lang", "name"], ["row"], "left")
    lang_name, reference = free_name(docs, "lang_of_row"), free_name(docs, "reference_of_row")
    joined = joined.select(*(F.col("row")[c].alias(c) for c in columns), F.col("lang").alias(lang_name), F.col("reference").alias(reference))
    text_at, n = columns.index(text_col), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        blends = [(lang, _Reference(*rest)) for lang, *rest in shared.value]
        judges: dict[str | None, _Judge] = {}
        for batch in batches:
            for part, texts in _chunks(batch, text_at):
                if len(words) > KNOWN_WORDS:
                    words.reset()
                if len(judges) > KNOWN_LANGUAGES:
                    judges.clear()
                counts, chars, owner, forms = _measure(texts, words)
                langs, references = part.column(n).to_pylist(), part.column(n + 1)
                js_chars, js_words, there = np.ones(len(texts)), np.ones(len(texts)), references.is_valid().to_numpy(zero_copy_only=False)
                for lang in set(langs):
                    mine = there & np.array([x == lang for x in langs])
                    if not mine.any():
                        continue
                    if lang not in judges:
                        r = references[int(np.flatnonzero(mine)[0])].as_py()
                        judges[lang] = _Judge(_Reference(r["chars"], r["words"], r["common"], r["counts"]), [x for name, x in blends if name != lang])
                    able = judges[lang]
                    place = np.full(len(words.form_list), -1, np.int64)
                    for w, i in able.at.items():
                        if w in words.forms:
                            place[words.forms[w]] = i
                    row = np.cumsum(mine) - 1
                    hit = place[forms]
                    use = mine[owner] & (hit >= 0)
                    size = (int(mine.sum()), len(able.vocabulary))
                    table = np.bincount(row[owner[use]] * size[1] + hit[use], minlength=size[0] * size[1]).reshape(size)
                    js_chars[mine], js_words[mine] = able.distances(chars[mine], table, counts["n_words"][mine])
                by_chars = there & (counts["word_chars"] >= min_chars)
                by_words = there & (counts["n_words"] >= min_words)
                failed = _base_failed(counts)
                far = (js_chars > joint_distances[0]) & (js_words > joint_distances[1])
                kept = ~failed & ~(by_chars & (js_chars > max_char_distance)) & ~(by_words & far)
                new = [pa.array(counts[c], pa.int64()) for c in COUNTS] + [pa.array(failed)]
                new += [pa.array(js_chars, mask=~by_chars), pa.array(js_words, mask=~by_words), pa.array(kept)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *new], names=[*columns, *names])

    schema = StructType(list(docs.schema.fields))
    for name, k in zip(names, kinds):
        schema = schema.add(name, k)
    return joined.mapInArrow(run, schema)
