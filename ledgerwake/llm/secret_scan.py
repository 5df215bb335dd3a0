"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

DataFrame operations only: candidates, their features and the forest all run on the JVM.
Features: length, how the character class changes along the candidate, how much of it is made
of dictionary words, whether it lies in a path, and the words beside it.

Labels tell by the place: the quoted value of an assignment to a credential's name is a finding,
unless it is made of common words; a run that nothing assigns is none.  How a value is quoted
and assigned is no feature.  So that the forest does not take the looks of the few
labelled values for the reason, labelled values and places are also exchanged in training.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwake.llm.shared import staged

# A run of characters that keys and tokens are made of.
RUN = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
# Names that credentials are assigned to.
NAMES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "auth", "bearer")
# An assignment to such a name, up to its value, and with it: quoted on one line, or unspaced.
ASSIGNMENT = (
    r"(?<![\w\-])[\w\-]{0,40}?(?:" + "|".join(NAMES) + r")[\w\-]{0,20}[\"']?\s{0,5}[:=]\s{0,5}"
)
VALUE = r"(?:\"[^\"\r\n]+\"|'[^'\r\n]+'|[^\s\"',;=:][^\s\"',;]*)"
CANDIDATE = f"(?i)(?:{ASSIGNMENT}{VALUE}|{RUN})"
# What stands before the value in a match.
LEAD = f"(?i)^{ASSIGNMENT}[\"']?(?=[^=:\"'])"
# Characters of context kept on each side.
BESIDE = 60
# Words in the dictionary, and their least length.
DICTIONARY, DICTIONARY_LETTERS = 150, 4
# The forest, and the most labelled findings it learns from.
TREES, DEPTH, SEED, LABELLED = 20, 6, 5, 100_000
THRESHOLD = 0.5
# Part of a quoted value that common words cover when it is no secret.
WORDY = 0.5

FEATURES = (
    "length", "changes", "distinct", "digits", "uppers", "hex", "covered", "in_path", "named",
    "word_before", "word_after",
)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, start, value, before, after: every value that could be a secret, with its context.

    These are runs of 16 characters or more that keys are made of, and whatever is assigned to
    a credential's name, of any length and characters.  `start` counts characters from 0.
    Null and empty texts have none.  Whole texts are searched, and starts come from a
    running sum over the candidates of a row.
    """
    found = docs.select("doc_id", "text").filter(F.col("text").rlike(CANDIDATE))
    items = F.transform(
        F.arrays_zip(
            F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"),
            F.split("text", CANDIDATE, -1).alias("gap"),
        ),
        lambda one: F.struct(
            one["found"].alias("found"),
            F.length(one["gap"]).alias("gap"),
            F.substring(one["gap"], -BESIDE, BESIDE).alias("before"),
            F.substring(one["gap"], 1, BESIDE).alias("after"),
        ),
    )
    rows = found.select("doc_id", F.monotonically_increasing_id().alias("row"), items.alias("items"))
    rows = rows.select("doc_id", "row", F.posexplode("items").alias("n", "one")).select("doc_id", "row", "n", "one.*")
    # The last item is the gap after the last candidate.
    in_row = Window.partitionBy("row").orderBy("n")
    size = F.col("gap") + F.coalesce(F.length("found"), F.lit(0))
    rows = rows.withColumns(
        {"end": F.sum(size).over(in_row), "after": F.lead("after").over(in_row)}
    ).filter("found is not null")
    lead = F.regexp_extract("found", LEAD, 0)
    quote = F.when(F.col("lead").rlike("[\"']$"), F.substring("lead", -1, 1)).otherwise("")
    length = F.length("found") - F.length("lead") - F.length("quote")
    rows = rows.withColumn("lead", lead).withColumn("quote", quote)
    return rows.select(
        "doc_id",
        (F.col("end") - F.length("found") + F.length("lead")).cast("int").alias("start"),
        F.substring(F.col("found"), F.length("lead") + 1, length).alias("value"),
        F.substring(F.concat("before", "lead"), -BESIDE, BESIDE).alias("before"),
        F.substring(F.concat("quote", "after"), 1, BESIDE).alias("after"),
    )


def dictionary(docs: DataFrame, words: int = DICTIONARY) -> list[str]:
    """The most frequent words of letters only, at least four long; `words` of them at most."""
    one = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\b[a-z]{4,12}\b"), F.lit(0)))
    counts = docs.select(one.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(words).collect()]


def _share(value: Column, pattern: str) -> Column:
    """Part of the characters that match."""
    return 1 - F.length(F.regexp_replace(value, pattern, "")) / F.length(value)


def described(found: DataFrame, words: list[str]) -> DataFrame:
    """The candidates with their features."""
    value, before, after = F.col("value"), F.lower("before"), F.lower("after")
    # Each character as its class: a lower case, B upper case, 0 digit, - any other.
    kinds = value
    for pattern, letter in (("[a-z]", "a"), ("[A-Z]", "B"), ("[0-9]", "0"), ("[^aB0]", "-")):
        kinds = F.regexp_replace(kinds, pattern, letter)
    runs = F.regexp_replace(kinds, r"(.)\1+", "$1")
    covered = _share(F.lower(value), "|".join(sorted(words, key=len, reverse=True))) if words else F.lit(0.0)
    named = reduce(lambda a, b: a | b, [before.contains(name) for name in NAMES])
    # Neighbouring words as numbers: equal words are equal, others are spread.
    word_before = F.regexp_extract(before, r"([a-z_]+)[^a-z_]*$", 1)
    word_after = F.regexp_extract(after, r"^[^a-z_]*([a-z_]+)", 1)
    spread = lambda word: F.pmod(F.xxhash64(word), F.lit(64)).cast("double")
    return found.withColumns(
        {
            "length": F.length(value).cast("double"),
            "changes": (F.length(runs) - 1) / F.length(value),
            "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.length(value),
            "digits": _share(value, "[0-9]"),
            "uppers": _share(value, "[A-Z]"),
            "hex": _share(value, "[0-9a-f]"),
            "covered": covered,
            "in_path": (before.rlike(r"(https?:|[/.~])\S*$") | value.rlike("/.*/")).cast("double"),
            "named": named.cast("double"),
            "word_before": spread(word_before),
            "word_after": spread(word_after),
        }
    )


def weak_label(before: Column, after: Column, covered: Column) -> Column:
    """A label where the text itself tells, else null.

    1: the quoted value of an assignment to a credential's name, 0 if common words cover it.
    0: whatever no assignment stands before.
    """
    name = "(?i)(" + "|".join(NAMES) + r")[\w\-]*[\"']?\s*[=:]\s*[\"']$"
    told = before.rlike(name) & after.rlike("^[\"']")
    plain = ~before.rlike(r"[=:]\s*[\"']?$")
    return F.when(told, F.when(covered < WORDY, 1).otherwise(0)).when(plain, 0).cast("double")


def labelled(found: DataFrame, words: list[str]) -> DataFrame:
    """The candidates with their features and, where the text tells, their label."""
    rows = described(found, words)
    return rows.withColumn("label", weak_label(F.col("before"), F.col("after"), F.col("covered")))


def exchanged(sample: DataFrame, words: list[str]) -> DataFrame:
    """Values of each label in places of the other, labelled anew: one row per row of the sample.

    The sample is bounded, so its rows can be numbered.
    """
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id", "start", "value"), "doc_id", "start")
    rows = sample.select("doc_id", "start", "value", "before", "after", "label")
    rows = rows.withColumn("n", F.row_number().over(order))
    sizes = rows.groupBy((1 - F.col("label")).alias("label")).agg(F.max("n").alias("others"))
    places = rows.drop("value").join(F.broadcast(sizes), "label")
    places = places.withColumn("n", F.pmod(F.col("n") - 1, F.col("others")) + 1)
    values = rows.select((1 - F.col("label")).alias("label"), "n", "value")
    return labelled(places.drop("others").join(values, ["label", "n"]).drop("label", "n"), words)


def classify(findings: DataFrame, words: list[str], most: int = LABELLED) -> DataFrame:
    """Adds probability and is_secret to labelled findings; `label` (0, 1 or null) trains.

    At most LABELLED labelled findings train; of more, half that many of each label (all, if
    it has fewer), those that come first by hash within the label.  Where all
    labels are alike, that is every finding's answer; without labels the probability is
    null and every finding stays a secret, so none is lost.
    """
    told = findings.filter("label is not null")
    kinds = {r.label: r.n for r in told.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        only = next(iter(kinds), None)
        return findings.withColumns(
            {
                "probability": F.lit(only).cast("double"),
                "is_secret": F.lit(only is None or only >= THRESHOLD),
            }
        )
    if sum(kinds.values()) > most:
        order = F.xxhash64("doc_id", "start", "value")
        parts = []
        for label, n in kinds.items():
            part = told.filter(F.col("label") == label)
            if n > most // 2:
                part = part.orderBy(order, "doc_id", "start").limit(most // 2)
            parts.append(part)
        told = reduce(DataFrame.unionByName, parts)
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="label", probabilityCol="_probability",
        rawPredictionCol="_raw", predictionCol="_prediction",
        numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxMemoryInMB=64,
    )
    told = staged(told, "labelled")
    told = told.select(*FEATURES, "label", "doc_id", "start", "value", "before", "after")
    both = [rows.select(*FEATURES, "label") for rows in (told, exchanged(told, words))]
    sample = staged(both[0].unionByName(both[1]).filter("label is not null"), "training")
    if sample.select("label").distinct().count() < 2:
        raise ValueError("the training sample holds one label only")
    model = forest.fit(vector.transform(sample))
    scored = model.transform(vector.transform(findings))
    return (
        scored.withColumn("probability", vector_to_array("_probability")[1])
        .withColumn("is_secret", F.col("probability") >= THRESHOLD)
        .drop("_features", "_probability", "_raw", "_prediction")
    )


def scan(docs: DataFrame) -> DataFrame:
    """Findings: doc_id, start, length, value_sha256, changes, covered, labelled, probability, is_secret.

    One row per candidate.  The value itself stays out of the result; start and length lead
    to it.  Null and empty texts have no findings; repeated rows have theirs repeated; ties
    do not arise.  An empty table gives an empty result; other columns are ignored.
    """
    words = dictionary(docs)
    found = staged(labelled(candidates(docs), words), "findings")
    return classify(found, words).select(
        "doc_id",
        "start",
        F.col("length").cast("int").alias("length"),
        F.sha2("value", 256).alias("value_sha256"),
        "changes",
        "covered",
        F.col("label").isNotNull().alias("labelled"),
        "probability",
        "is_secret",
    )
