"""Secret scans: candidates by shape and place, false positives removed by a random forest.

A candidate is a part of a text between blanks, quotes, brackets, commas and the like that is eight characters or more
with a digit, or is assigned to a credential's name, or is long and of mixed kinds of characters. The forest sees its
length and character classes, how likely its character transitions are among labelled secrets against labelled plain
values, how much of it dictionary words cover, and how its path and the words beside it speak for a secret.

Labels come from findings that are given, or else from known formats: published forms of keys and what is assigned to a
credential's name, against forms of addresses and numbers. A format labels a part of its values only (by hash), and the
forest judges the rest by what they are. Nothing that such a label looks at is a feature: the forest sees neither the
name nor the forms, so it can clear a named value that is a plain word and find a secret without a name.

Weights of transitions, neighbours and path parts are trained on one half of the labelled candidates, the forest on the
other. The dictionary is counted over all documents. Everything is DataFrame functions and the forest of ``pyspark.ml``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.llm.common import apart, free_name, saved, spread_join

#: Names that credentials are assigned to, in lower case.
CREDENTIAL = r"(?i)(password|passwd|passphrase|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|auth|credential|bearer|private[_-]?key)"
#: Published forms of keys.
KEY_FORMS = r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[0-9A-Za-z]{36,}$|^xox[abprs]-[0-9A-Za-z-]{10,}$|^eyJ[\w-]+\.[\w-]+\.[\w-]+$|^AIza[0-9A-Za-z_-]{35}$"
#: Forms that look like secrets and are none.
PLAIN_FORMS = {
    "mail": r"^[\w.+-]+@[\w-]+(\.[\w-]+)+$",
    "address": r"^\d{1,3}(\.\d{1,3}){3}$",
    "number": r"^[\d()+./:, -]+$",
    "url": r"^https?://\S+$",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
}
#: What parts a text: blanks, quotes, brackets and marks between values.
BREAKS = r"[\x20\x09-\x0D\"'`,;{}()\[\]<>&|]+"
#: Texts without any of these hold no candidate: a digit, a credential's name, or twenty letters and marks in a row.
HOLDS = rf"[0-9]|{CREDENTIAL}|[A-Za-z+/=_-]{{20}}"
ASSIGNED = r"^([A-Za-z][\w.-]*)[=:]+(.+)$"
MIXED = r"[a-z][A-Z]|[A-Z]{2}[a-z]|[+/=_]"
DICTIONARY = r"(?<![A-Za-z0-9])[a-z]{3,}(?![A-Za-z0-9])"
FEATURES = ("f_length", "f_changes", "f_digits", "f_capitals", "f_hex", "f_distinct", "f_transitions", "f_covered", "f_path", "f_before", "f_after")
#: Character transitions are between letters, any digit and any other mark, so there are 54 * 54 at most.
LETTERS = 54


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """The candidates of all texts: doc_id, path, ``word_at`` (number of the part in its text, from 0), ``word``, ``name``
    (what it is assigned to, or empty), ``value``, and the words ``before`` (the name not counted) and ``after``. Null
    texts have none."""
    text = F.col(f"`{text_col}`").cast("string")
    path = F.col(f"`{path_col}`").cast("string") if path_col else F.lit(None).cast("string")
    held = docs.select(F.col(f"`{id_col}`").alias("doc_id"), path.alias("path"), text.alias("text")).where(F.col("text").rlike(HOLDS))
    words = apart(held, "words", F.filter(F.split("text", BREAKS), lambda w: w != "")).drop("text")

    def beside(i: Column, by: int) -> Column:
        return F.coalesce(F.get("words", i + by), F.lit(""))

    def sure(w: Column, i: Column) -> Column:
        """Whether a part may be a candidate: what is cheap to see without taking it apart."""
        digit = w.rlike("[0-9]") & (F.length(w) >= 8)
        long = (F.length(w) >= 16) & w.rlike(MIXED)
        named = (beside(i, -1).rlike(CREDENTIAL) | beside(i, -2).rlike(CREDENTIAL) | w.rlike(CREDENTIAL)) & (F.length(w) >= 4)
        return digit | long | named

    places = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda s: sure(s["word"], s["at"]))
    around = F.transform(places, lambda s: F.struct(s["at"].alias("at"), s["word"].alias("word"), *(beside(s["at"], -j).alias(f"b{j}") for j in (1, 2, 3)), beside(s["at"], 1).alias("after")))
    each = words.select("doc_id", "path", F.inline(around))
    spaced = F.col("b1").isin("=", ":", ":=")
    sign = F.col("b1").rlike(".[=:]$")
    inside = F.regexp_extract("word", ASSIGNED, 1)
    value = F.when(inside != "", F.regexp_extract("word", ASSIGNED, 2)).otherwise(F.col("word"))
    name = F.when(inside != "", inside).when(spaced, F.col("b2")).when(sign, F.regexp_replace("b1", "[=:]+$", "")).otherwise(F.lit(""))
    before = F.when(inside != "", F.col("b1")).when(spaced, F.col("b3")).when(sign, F.col("b2")).otherwise(F.col("b1"))
    bearer = F.lower("b1") == "bearer"
    found = each.select("doc_id", "path", F.col("at").alias("word_at"), "word", name.alias("name"), F.regexp_replace(value, r"^[.!?]+|[.!?*#%$]+$", "").alias("value"), before.alias("before"), "after", bearer.alias("bearer"))
    size, v = F.length("value"), F.col("value")
    kept = ((size >= 8) & v.rlike("[0-9]")) | ((size >= 16) & v.rlike(MIXED)) | ((size >= 4) & F.col("name").rlike(CREDENTIAL)) | ((size >= 8) & F.col("bearer"))
    return found.where(kept).drop("bearer")


def dictionary(docs: DataFrame, *, text_col: str = "text", min_share: float = 1e-6) -> DataFrame:
    """The words of three letters or more in lower case that make up ``min_share`` of all such words or more, and occur twice
    at least; so the table has fewer than 1 / ``min_share`` rows."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(DICTIONARY), 0)).alias("run"))
    counts = saved(words.groupBy("run").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return counts.where(F.col("n") >= max(2, total * min_share)).select("run")


def _letters(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "[^a-z]", "")


def _transitions(value: Column) -> Column:
    """The pairs of neighbouring characters, digits as 0 and all but letters and digits as a dash."""
    plain = F.regexp_replace(F.regexp_replace(value, "[0-9]", "0"), "[^A-Za-z0]", "-")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(value) - 1, F.lit(1))), lambda i: F.substring(plain, i, F.lit(2)))


def log_odds(labelled: DataFrame, what: Column, *, kinds: int, min_count: int = 1) -> DataFrame:
    """``key`` and ``weight``: the log of how often labelled secrets have each element of the array ``what``, over how often
    other candidates have it, one added to each count. As many rows as the sample has elements at most."""
    each = labelled.select(F.explode(what).alias("key"), F.col("label").cast("int").alias("label")).where("key <> ''")
    sums = each.groupBy("key").agg(F.sum("label").alias("yes"), F.sum(1 - F.col("label")).alias("no"))
    whole = sums.agg(F.coalesce(F.sum("yes"), F.lit(0)).alias("yes"), F.coalesce(F.sum("no"), F.lit(0)).alias("no")).first()
    weight = F.log((F.col("yes") + 1) / F.lit(float(whole["yes"] + kinds))) - F.log((F.col("no") + 1) / F.lit(float(whole["no"] + kinds)))
    return sums.where(F.col("yes") + F.col("no") >= min_count).select("key", weight.alias("weight"))


def _mean_weight(keys: DataFrame, by: str, parts: Column, weights: DataFrame, into: str) -> DataFrame:
    """``by`` and ``into``: the mean weight of the elements of ``parts`` for each row of ``keys``, which has each ``by`` once."""
    each = keys.select(by, F.explode(parts).alias("key")).join(weights, "key", "left")
    return each.groupBy(by).agg(F.avg(F.coalesce("weight", F.lit(0.0))).alias(into))


def value_features(values: DataFrame, known: DataFrame) -> DataFrame:
    """``values`` (value, each once) with what only the value decides. ``known`` is the dictionary (run)."""
    runs = values.select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), 0)).alias("run"))
    covered = spread_join(runs, known, ["run"], ["value"]).groupBy("value").agg(F.sum(F.length("run")).alias("covered"))
    t = values.join(covered, "value", "left")
    value, size = F.col("value"), F.length("value")

    def count(pattern: str) -> Column:
        return F.regexp_count(value, F.lit(pattern)).cast("double")

    changes = r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^a-zA-Z0-9])[a-zA-Z0-9]"
    features = {
        "f_length": size.cast("double"),
        "f_changes": count(changes) / size,
        "f_digits": count("[0-9]") / size,
        "f_capitals": count("[A-Z]") / size,
        "f_hex": count("[0-9a-fA-F]") / size,
        "f_distinct": F.size(F.array_distinct(F.split(value, ""))).cast("double") / size,
        "f_covered": F.coalesce(F.col("covered"), F.lit(0)).cast("double") / size,
    }
    return t.withColumns(features).drop("covered")


def formats(t: DataFrame) -> DataFrame:
    """``t`` with ``format``, the known format of a candidate, or null, and ``format_label``, what the format says."""
    named = F.col("name").rlike(CREDENTIAL) & (F.length("value") >= 12) & F.col("value").rlike(r"^[\w+/=-]+$")
    kind = F.when(F.col("value").rlike(KEY_FORMS), "key").when(named, "named")
    for name, form in PLAIN_FORMS.items():
        kind = kind.when(F.col("value").rlike(form), name)
    return t.withColumn("format", kind).withColumn("format_label", F.when(F.col("format").isin("key", "named"), 1).when(F.col("format").isNotNull(), 0).cast("int"))


def format_label(t: DataFrame, *, share: float = 0.5, without: Sequence[str] = (), seed: int = 11) -> DataFrame:
    """``t`` with ``label`` by known formats: 1 a secret, 0 none, for ``share`` of each format's values, those of the least hash;
    null for the rest, for formats ``without`` labels, and where no format knows the candidate."""
    told = formats(t)
    chosen = F.pmod(F.xxhash64(F.lit(seed), F.lit("label"), "value"), F.lit(1000)) < int(share * 1000)
    label = F.when(chosen & ~F.col("format").isin(*without, ""), F.col("format_label"))
    return told.withColumn("label", label).drop("format", "format_label")


def _path_parts(path: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(path, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def scan(
    docs: DataFrame,
    labelled: DataFrame | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str | None = "source",
    train_rows: int = 20_000,
    trees: int = 30,
    depth: int = 6,
    min_score: float = 0.5,
    label_share: float = 0.5,
    without: Sequence[str] = (),
    seed: int = 11,
) -> DataFrame:
    """The candidates of ``docs`` with their features, ``label``, ``score`` (the forest's share for a secret) and
    ``secret``.

    ``labelled``: doc_id, word_at, label (0 or 1); without it known formats label ``label_share`` of their values, but for
    formats ``without`` labels. Every verdict is the forest's, on labelled candidates too. Weights and forest are fitted on
    ``train_rows`` labelled candidates of each class at most, those of the least hash. With fewer than two classes there
    is none to fit: the score is the label, and null where there is no label; an unlabelled candidate then counts as
    a secret, for none is dropped without a reason. Null texts have no candidates, null ids are kept, a null path speaks
    for nothing, repeated rows each have their candidates with the same features, other columns are not read, and an
    empty table has none. Texts of any length are taken apart whole, within a task.
    """
    found = candidates(docs, id_col=id_col, text_col=text_col, path_col=path_col)
    if labelled is None:
        found = format_label(found, share=label_share, without=without)
    else:
        marks = labelled.where("label IS NOT NULL").groupBy("doc_id", "word_at").agg(F.max("label").alias("label"))
        found = found.join(marks, ["doc_id", "word_at"], "left")
    found = saved(found)
    known = saved(dictionary(docs, text_col=text_col))
    order = F.xxhash64(F.lit(seed), "value", "before", "after", "word_at")
    parts = [found.where(F.col("label") == c).orderBy(order, "doc_id").limit(train_rows) for c in (0, 1)]
    sample = saved(parts[0].union(parts[1]).withColumn("half", F.pmod(F.xxhash64("value", F.lit(seed)), F.lit(2)).cast("int")))
    halves = {(r["label"], r["half"]) for r in sample.select("label", "half").distinct().collect()}
    if {x for x, _ in halves} != {0, 1}:
        return found.withColumns({"score": F.col("label").cast("double"), "secret": F.coalesce(F.col("label") == 1, F.lit(True))})
    one, two = (sample.where(F.col("half") == h) for h in (0, 1)) if len(halves) == 4 else (sample, sample)

    # the tables of weights are bounded by the sample
    pairs = F.broadcast(saved(log_odds(one, _transitions(F.col("value")), kinds=LETTERS * LETTERS)))
    words = log_odds(one, F.array(_letters(F.col("before")), _letters(F.col("after"))), kinds=1000, min_count=2)
    places = F.broadcast(saved(log_odds(one, _path_parts(F.col("path")), kinds=1000, min_count=2)))
    words = F.broadcast(saved(words))
    values = saved(value_features(found.select("value").distinct(), known))
    values = values.join(_mean_weight(values, "value", _transitions(F.col("value")), pairs, "f_transitions"), "value")
    paths = found.where("path IS NOT NULL").select("path").distinct()
    paths = _mean_weight(paths, "path", _path_parts(F.col("path")), places, "f_path")
    t = spread_join(spread_join(found, values, ["value"], ["doc_id", "word_at"]), paths, ["path"], ["doc_id", "word_at"], "left")
    for side in ("before", "after"):
        t = t.withColumn("key", _letters(F.col(side))).join(words.withColumnRenamed("weight", f"f_{side}"), "key", "left").drop("key")
    t = saved(t.withColumns({f: F.coalesce(f, F.lit(0.0)) for f in ("f_path", "f_before", "f_after")}))

    # the trained rows' features are found again by what makes a candidate up
    chosen = two.select("value", F.coalesce("path", F.lit("")).alias("path_key"), "before", "after", "label").distinct()
    held = t.withColumn("path_key", F.coalesce("path", F.lit(""))).dropDuplicates(["value", "path_key", "before", "after", "label"])
    train = held.join(chosen, ["value", "path_key", "before", "after", "label"])
    vector = free_name(t, "features")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol=vector)
    forest = RandomForestClassifier(labelCol="label", featuresCol=vector, numTrees=trees, maxDepth=depth, seed=seed)
    model = forest.fit(vectors.transform(saved(train.select(F.col("label").cast("double").alias("label"), *FEATURES))))
    judged = model.transform(vectors.transform(t))
    score = vector_to_array("probability")[1]
    return judged.withColumn("score", score).withColumn("secret", F.col("score") >= min_score).drop(vector, "rawPrediction", "probability", "prediction")
