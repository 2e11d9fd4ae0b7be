"""Secret scanning with a random forest that removes false findings.

A candidate is a run of 16 or more characters of keys, tokens, paths and numbers inside a word; the value of an assignment whatever its
length and characters: after = or := of any name, after : or => of a credential's name, in a URL after ?name= or &name=; or a whole PEM block
of a private key. A value ends at white space, a quoted one at its quote: with spaces inside it has to end on its line and hold no =, else
it ends at white space too. Such a value, and a PEM block, counts as one word. Of a block that isn't closed the lines are found as runs.

Labels and features are two views of a finding that share nothing. Labels are those of reviewed findings (`reviewed`: candidate, label), by
the majority where one was reviewed often, a tie being a secret. Where none are at hand, labels come from the name that a value is assigned
to (`assigned_name`). The forest never sees that name or its sign. Its features are the candidate's length; character
transitions (runs of one class for each character), shares of digits, upper case and vowels, share of distinct characters, hexadecimal only;
dictionary coverage (the share taken by frequent words of the whole corpus, from left to right, the longest first); path (the source, slashes and dots); neighbouring words (the two
words before name and value and the one after, whether they are dictionary words, quotes). So it can turn down what an ill-chosen name made
a finding (`password = hunter_season2`), and find what no name points to. Source and words are no numbers: each is a category, hashed to
`RATES` values, and stands for the share of secrets among the labelled findings that have it, drawn to the mean where they are few. Shares
are learned from one half of the labelled documents and the forest from the other, so that it sees shares as they are for new documents.

`sample` bounds how many findings of each label the forest is fitted on; its trees and the shares are all that is broadcast. Counts behind
the dictionary cover all documents; `dictionary` bounds its size.

Only DataFrame and SQL functions with Spark's own random forest. A null text has no candidates; a text is scanned whole, whatever its
length. A null source is a path of its own kind. Where findings of one label only are known the forest can't be fitted, and each finding gets
the share of secrets among the known ones (0.5 where none is known). A probability of 0.5 is a secret. Repeated rows give repeated
findings, rows with a null doc_id too. Empty tables give no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, spread_join, work_dir
from .op6_language import held_out

RUN = r"[A-Za-z0-9+/_=.\-]{16,}"
WORD = r"[^\x20\x09-\x0D]+"
#: Parts of names that a credential is assigned to, as db_password or githubToken; "key" counts alone and after the words in KEYS.
PARTS = ["token", "secret", "password", "passwd", "passphrase", "pwd", "apikey", "auth", "credential", "credentials"]
KEYS = ["api", "access", "secret", "private", "encryption", "signing", "account", "auth", "master", "ssh", "client", "service", "storage"]
#: A word that assigns: a name of its own before the sign, and what follows. A scheme (https://) doesn't assign.
OWN = r"""^[^\w]*(\w[\w.\-]*)["'\]]*(:=|=>|=|:(?!//))(.*)$"""
#: A word that ends a name, with the sign or without.
SIGN = r"^(?::=|=>|=|:)"
#: A closed PEM block; a quoted value with spaces after = or := of any name, or after : or => of what looks like a credential's name.
PEM = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
LIKELY = r"""(?i:token|secret|passw|passwd|passphrase|password|pwd|key|auth|credential|credentials)[\w.\-]{0,20}["'\]]{0,2}[ \t]{0,4}(?::|=>)[ \t]{0,4}"""
SPACED = rf"""(?=["'`])(?:(?<==[ \t]{{0,4}})|(?<={LIKELY}))(?:""" + "|".join(rf"{q}[^{q}= \t\r\n]*+[ \t][^{q}=\r\n]*+{q}" for q in "\"'`") + ")"
#: Stands for such a block or value in the text's words; a code point that is no character.
MARK = "\ufdd0"
PARAMETER = r"""[?&][\w.\-]+=([^&#"'<>]+)"""
NUMBERS = ["length", "transitions", "digits", "upper", "vowels", "distinct", "hexadecimal", "coverage", "slashes", "dots", "quoted", "known_before", "known_after"]
CATEGORIES = ["path", "before_1", "before_2", "after_1"]
FEATURES = [*NUMBERS, *[f"{c}_rate" for c in CATEGORIES]]
#: Values that a category is hashed to, and how many findings its mean counts for.
RATES, DRAW = 256, 10


def frequent_words(docs: DataFrame, most: int = 500) -> list[str]:
    """The most frequent words of 3 to 12 letters, counted over all texts; `most` bounds what reaches the driver."""
    # explode_outer, here and below: a plain explode also filters on the array's size, for which Spark would work it out twice
    words = docs.select(F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,12}"), F.lit(0))).alias("w")).where("w is not null")
    return [r["w"] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(most).collect()]


def candidates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, source, place (number of the word), candidate, the words around it (w1, w2, w3), and its view for
    the forest: the words before the assignment (b1, b2).
    """
    may = lambda w: w.rlike(RUN) | w.rlike(f"[=:{MARK}]")
    some = docs.where(may(F.col("text")) | F.contains("text", F.lit("-----BEGIN "))).select("doc_id", "source", F.replace("text", F.lit(MARK), F.lit(" ")).alias("text"))
    # most texts have no sign before a quote and no block, and are spared the pattern for both
    whole, may_hold = f"{PEM}|{SPACED}", F.contains("text", F.lit("-----BEGIN ")) | F.col("text").rlike(r"""[=:>][ \t]{0,4}["'`]""")
    words = F.regexp_extract_all(F.when(may_hold, F.regexp_replace("text", whole, f'"{MARK}" ')).otherwise(F.col("text")), F.lit(WORD), F.lit(0))
    near = lambda all_, i, k: F.coalesce(F.get(all_, i + k), F.lit(""))
    # only words that may hold a candidate leave the array, each with its neighbours and the block or value that it stands for
    some = some.select("doc_id", "source", words.alias("words"), F.when(may_hold, F.regexp_extract_all("text", F.lit(whole), F.lit(0))).alias("blocks"))
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: may(F.get("words", i)) | near(F.col("words"), i, -1).rlike("[=:>]$"))
    marked = lambda w: F.contains(w, F.lit(MARK))
    block = lambda i: F.when(marked(F.get("words", i)), F.get("blocks", F.size(F.filter(F.slice("words", F.lit(1), i), marked))))
    one = lambda i: F.struct(i.cast("long").alias("place"), F.get("words", i).alias("word"), block(i).alias("block_"), *[near(F.col("words"), i, k).alias(n) for n, k in (("w1", -1), ("w2", -2), ("w3", 1), ("w4", -3), ("w5", -4))])
    placed = some.select("doc_id", "source", F.explode_outer(F.transform(at, one)).alias("p")).where("p is not null").select("doc_id", "source", "p.*")
    key = F.coalesce(F.startswith("block_", F.lit("-----")), F.lit(False))
    inside = F.when(key, F.col("block_")).otherwise(F.substring(F.col("block_"), F.lit(2), F.char_length("block_") - 2))
    values = F.transform(F.filter(assigned_values(), lambda v: v != ""), lambda v: F.when(marked(v), inside).otherwise(v))
    runs = F.regexp_extract_all(F.concat_ws(" ", "word", "block_"), F.lit(RUN), F.lit(0))
    values = F.when(key, F.array(inside)).otherwise(values)
    apart = lambda r: ~F.exists(F.col("values_"), lambda v: F.contains(v, r) | F.contains(r, v))
    placed = placed.withColumn("values_", values).withColumn("candidate", F.explode_outer(F.concat("values_", F.filter(runs, apart)))).where("candidate is not null")
    taken = words_of_name()
    before = lambda k: F.element_at(F.array("w1", "w2", "w4", "w5"), (taken + k).cast("int"))
    return placed.withColumns({"b1": before(1), "b2": before(2)}).drop("values_", "block_", "w4", "w5")


def words_of_name() -> Column:
    """How many words before the candidate's own belong to the name that it is assigned to, or to its sign: 0, 1 or 2."""
    own = F.col("word").rlike(OWN) & (F.regexp_extract("word", OWN, 3) != "")
    alone, ends = F.col("w1").rlike("^(:=|=>|=|:)$"), F.col("w1").rlike("(:=|=>|=|:)$")
    return F.when(own, 0).when(F.col("word").rlike(SIGN), 1).when(alone, 2).when(ends, 1).otherwise(0)


def bare_value(v: Column) -> Column:
    """A value without its quotes, or without the marks that close what is around it."""
    quoted = F.regexp_extract(v, r"""^(["'`])(.*)\1""", 2)
    return F.when(v.rlike(r"""^(["'`]).*\1"""), quoted).otherwise(F.regexp_replace(F.regexp_replace(v, r"""^["'`]+""", ""), r"""["'`,;)\]}]+$""", ""))


def name_and_sign() -> tuple[Column, Column]:
    """Name and sign of what assigns to the word: its own prefix where it has one, else the words before; empty where nothing does."""
    own = F.col("word").rlike(OWN) & (F.regexp_extract("word", OWN, 3) != "")
    alone, ends = F.col("w1").rlike("^(:=|=>|=|:)$"), F.col("w1").rlike("(:=|=>|=|:)$")
    name = F.when(own, F.regexp_extract("word", OWN, 1)).when(F.col("word").rlike(SIGN), F.col("w1")).when(alone, F.col("w2")).when(ends, F.col("w1"))
    sign = F.when(own, F.regexp_extract("word", OWN, 2)).when(F.col("word").rlike(SIGN), F.regexp_extract("word", "^(:=|=>|=|:)", 1)).when(ends, F.regexp_extract("w1", "(:=|=>|=|:)$", 1))
    return F.coalesce(name, F.lit("")), F.coalesce(sign, F.lit(""))


def name_parts(name: Column) -> Column:
    """Lower-case parts of a name, cut at other characters than letters and where case changes."""
    apart = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(apart), "[^a-z]+"), lambda p: p != "")


def is_credential(name: Column) -> Column:
    parts = name_parts(name)
    strong = F.arrays_overlap(parts, F.array(*map(F.lit, PARTS)))
    key = F.array_contains(parts, "key") & ((F.size(parts) == 1) | F.arrays_overlap(parts, F.array(*map(F.lit, KEYS))))
    return strong | key


def assigned_values() -> Column:
    """The values that the word is given, or gives in a URL."""
    name, sign = name_and_sign()
    own = F.col("word").rlike(OWN) & (F.regexp_extract("word", OWN, 3) != "")
    raw = F.when(own, F.regexp_extract("word", OWN, 3)).otherwise(F.regexp_replace("word", SIGN, ""))
    value = F.when((sign.isin("=", ":=") & (name != "")) | ((sign != "") & is_credential(name)), bare_value(raw))
    url = F.col("word").contains("://")
    return F.when(url, F.regexp_extract_all("word", F.lit(PARAMETER), F.lit(1))).otherwise(F.array(F.coalesce(value, F.lit(""))))


def bare(w: Column) -> Column:
    return F.regexp_replace(F.lower(w), r"[^\p{L}_]", "")


def any_of(words: list[str]) -> str:
    """A pattern for the longest of some words at a place, that reads each letter once: words of one beginning share it."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[:1], []).append(w[1:])
    ways = [re.escape(c) + (any_of(rest) if any(rest) else "") for c, rest in sorted(by.items()) if c]
    return f"(?:{'|'.join(ways)}){'?' if '' in by else ''}" if ways else ""


def featured(found: DataFrame, dictionary: list[str]) -> DataFrame:
    """found with the numbers, and the categories as hashes; nothing here reads the name or sign of an assignment."""
    c, low = F.col("candidate"), F.lower("candidate")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / F.char_length(c)
    rest = F.regexp_replace(low, any_of(dictionary), "") if dictionary else low
    bucket = lambda w: F.pmod(F.xxhash64(w), F.lit(RATES)).cast("int")
    known = lambda w: bare(F.col(w)).isin(dictionary).cast("double")
    columns: dict[str, Column] = {
        "length": F.char_length(c).cast("double"),
        "transitions": F.regexp_count(c, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+")) / F.char_length(c),
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "vowels": share("[aeiouAEIOU]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.char_length(c),
        "hexadecimal": c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "coverage": 1 - F.char_length(rest) / F.char_length(c),
        "slashes": share("/"),
        "dots": share(r"\."),
        "quoted": F.col("word").rlike("[\"']").cast("double"),
        "known_before": known("b1"),
        "known_after": known("w3"),
        "path": bucket(F.coalesce("source", F.lit(""))),
        "before_1": bucket(bare(F.col("b1"))),
        "before_2": bucket(bare(F.col("b2"))),
        "after_1": bucket(bare(F.col("w3"))),
    }
    return found.withColumns(columns)


def rated(found: DataFrame, labelled: DataFrame) -> DataFrame:
    """found with each category's share of secrets among the findings of labelled, drawn to the mean: RATES numbers a category reach the driver."""
    rows = labelled.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in CATEGORIES])).alias("x"), "label").groupBy("x.c", "x.v")
    got = {(r["c"], r["v"]): (r["s"], r["n"]) for r in rows.agg(F.sum("label").alias("s"), F.count("*").alias("n")).collect()}
    mean = lambda c: sum(s for (k, _), (s, _) in got.items() if k == c) / max(1, sum(n for (k, _), (_, n) in got.items() if k == c))
    rates = {}
    for c in CATEGORIES:
        m = mean(c)
        rates[c] = [(s + DRAW * m) / (n + DRAW) for s, n in (got.get((c, v), (0.0, 0)) for v in range(RATES))]
    return found.withColumns({f"{c}_rate": F.get(F.lit(rates[c]), F.col(c)) for c in CATEGORIES})


def judged(found: DataFrame, labelled: DataFrame, sample: int = 10_000, trees: int = 30, depth: int = 6, seed: int = 5) -> DataFrame:
    """found with probability; labelled has the same columns and label 0.0 or 1.0."""
    half = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2))
    n = {(r["label"], r["half"]): r["count"] for r in labelled.groupBy("label", half.alias("half")).count().collect()}
    known = {y: n.get((y, 0), 0) + n.get((y, 1), 0) for y in (0.0, 1.0)}
    if not all(known.values()):
        return found.withColumn("probability", F.lit(known[1.0] / sum(known.values()) if sum(known.values()) else 0.5))
    apart = all(n.get((y, h)) for y in (0.0, 1.0) for h in (0, 1))  # both labels in both halves; else all are used twice
    fitted = rated(labelled.where(half == 1) if apart else labelled, labelled.where(half == 0) if apart else labelled)
    order = [F.xxhash64("candidate", "doc_id", "place"), "candidate", "doc_id", "place"]
    parts = [fitted.where(F.col("label") == y).orderBy(*order).limit(sample) for y in (0.0, 1.0)]
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(parts[0].union(parts[1])).select("label", "x").coalesce(1)  # at most 2 * sample rows
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)
    out = forest.transform(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rated(found, labelled.where(half == 0) if apart else labelled)))
    return out.withColumn("probability", vector_to_array("probability")[1]).drop("x", "rawPrediction", "prediction")


def verdicts(reviewed: DataFrame) -> DataFrame:
    """reviewed (candidate, label 0.0 or 1.0, null: undecided) -> candidate, label: one row a candidate, by the majority, a tie being a secret."""
    told = reviewed.where("candidate is not null and label is not null").groupBy("candidate").agg(F.avg("label").alias("share"))
    return told.select("candidate", (F.col("share") >= 0.5).cast("double").alias("label"))


def scan(docs: DataFrame, label: Column | None = None, known: Column | None = None, reviewed: DataFrame | None = None, **options) -> DataFrame:
    """docs (doc_id, text, source) -> findings with candidate, features, probability and is_secret.

    `reviewed` (candidate, label) are findings that were looked at; `label` (0.0 or 1.0, null: unknown) is a column over findings. Without either
    names label them. `known` says which may be learned from.
    """
    dictionary = frequent_words(docs)
    found = save(featured(candidates(docs), dictionary), f"{work_dir(docs.sparkSession, 'secrets')}/findings")
    if reviewed is not None:
        labelled = spread_join(found, save(verdicts(reviewed), f"{work_dir(docs.sparkSession, 'reviewed')}/labels"), ["candidate"], "doc_id")
    else:
        labelled = found.withColumn("label", assigned_name() if label is None else label).where("label is not null")
    out = judged(found, labelled.where(known) if known is not None else labelled, **options)
    return out.withColumn("is_secret", F.col("probability") >= 0.5)


def assigned_name() -> Column:
    """Labels where no reviewed findings are at hand, by names and signs alone: 1.0 for a PEM block and what is assigned to a credential's name; 0.0 for what is
    assigned to another name, or to none and has no such name beside it; null (unknown) for the doubtful rest.
    """
    name, sign = name_and_sign()
    given = (sign != "") & (name != "")
    parameter = F.col("word").contains("://") & F.contains(F.col("word"), F.concat(F.lit("="), F.col("candidate")))
    near = is_credential(F.concat_ws(" ", "w2", "w1", "word", "w3"))
    doubtful_key = F.array_contains(name_parts(name), "key")
    return (
        F.when(F.startswith("candidate", F.lit("-----BEGIN ")), 1.0)
        .when(parameter, F.lit(None).cast("double"))
        .when(given & is_credential(name), 1.0)
        .when(given & ~doubtful_key & ~near, 0.0)
        .when(~given & ~near, 0.0)
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    found = scan(docs, known=~held_out("doc_id"))
    return found.select(
        "doc_id", "place", F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), F.col("length").cast("long").alias("length"), F.round("probability", 9).alias("probability"), "is_secret"
    )
