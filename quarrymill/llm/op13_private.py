"""Personal data by bootstrapped contextual extraction.

The base finds e-mail addresses, IP numbers, payment cards and phone numbers by their form alone. They are the seeds. Every seed induces
lexical patterns from the words around it: the two words before it (`L`), and the word before with the word after (`M`). Other runs that
look like identifiers but fail the base's forms (slots) stand in the same contexts as unknown instances. Patterns and instances make a graph
with an edge for each pattern and distinct value, so that copies of a document count once. Spark scores it in rounds: a pattern's
confidence in a kind is the share of that kind's scores among all its instances, smoothed by one; an unknown instance's score is the noisy-or of
the patterns that trust a kind by half or more. Only patterns with `support` distinct seeds of the kind are scored. Slots under a pattern
whose final confidence is `trust` or more become spans of its kind; base spans stay as they are, and slots that overlap one are none.

One pass over the texts gives every match with the length of the text before it and `CONTEXT` characters on either side; positions are
running sums over the matches of a row. Only matches are shuffled, texts never. Patterns and values that over a thousandth of all edges
share are dealt to several tasks where edges meet scores. The forms are written with possessive runs and start only where a run starts, so
that a text of one long run takes linear time.

Only DataFrame and SQL functions. A null text counts as empty and gives a row without spans. Repeated rows and null or repeated doc_ids give
a row each. Texts of any length are searched whole. Of equal confidences the kind that comes first in KINDS counts. Empty tables give no rows,
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, spread_join, work_dir

#: Kinds in the order in which spans of one start are listed.
KINDS = ["email", "ip", "card", "phone"]
#: Starts where a run of the class starts, or where the match before ended.
_EDGE = r"(?:\G|(?<![{0}]))"
FORMS = {
    "email": _EDGE.format(r"A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])" + _EDGE.format("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What else may be an identifier: words around an @, and digits parted by two marks at most.
SLOTS = {
    "at": _EDGE.format(r"\p{L}\p{N}._%+-") + r"[\p{L}\p{N}._%+-]++@[\p{L}\p{N}.-]++",
    "digits": r"\+?\(?[0-9](?:[\x20().:/-]{0,2}+[0-9])++",
}
#: Kinds that an unknown instance may turn out to be.
OPEN_TO = {"at": ["email"], "digits": ["ip", "card", "phone"]}
#: Digits that a slot of digits has at least, and characters of context on either side.
LEAST_DIGITS, CONTEXT = 6, 48


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Whether a string of 19 digits at most has the check digit of payment cards."""
    plain = F.reverse(digits)
    doubled = F.translate(plain, "0123456789", "0246813579")
    at = lambda s, i: F.coalesce(F.substring(s, i + 1, F.lit(1)).try_cast("int"), F.lit(0))
    total = F.aggregate(F.sequence(F.lit(0), F.lit(18)), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, at(doubled, i)).otherwise(at(plain, i)))
    return total % 10 == 0


def is_valid(form: Column, value: Column) -> Column:
    """Whether a match of a form is one of its kind: parts, digits and check digits as they must be."""
    digits = _digits(value)
    n = F.char_length(digits)
    byte = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return (
        F.when(form == "ip", value.rlike(rf"^{byte}(?:\.{byte}){{3}}$"))
        .when(form == "card", n.between(14, 19) & passes_luhn(digits))
        .when(form == "phone", n.between(10, 15))
        .when(form == "digits", n >= LEAST_DIGITS)
        .otherwise(True)
    )


def matches(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) -> row, doc_id and, for each form, its matches in order: gap (characters since the match before), value, left, right.

    Written under path: the one pass over the texts. A form that a text can't hold for want of its sign isn't tried.
    """
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    forms = FORMS | SLOTS
    may = {"email": t.contains("@"), "at": t.contains("@"), "phone": t.contains("+"), "ip": t.rlike(r"[0-9]\.[0-9]")}
    out = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", t.alias("t"), *[may.get(f, F.lit(True)).alias(f"may_{f}") for f in forms])
    for f, form in forms.items():
        out = out.withColumns({f"between_{f}": F.when(F.col(f"may_{f}"), F.split("t", form, -1)), f"values_{f}": F.when(F.col(f"may_{f}"), F.regexp_extract_all("t", F.lit(form), F.lit(0)))})

    def hits(f: str) -> Column:
        between, values = F.col(f"between_{f}"), F.col(f"values_{f}")
        one = lambda v, i: F.struct(F.char_length(F.get(between, i)).cast("long").alias("gap"), v.alias("value"), F.right(F.get(between, i), F.lit(CONTEXT)).alias("left"), F.left(F.get(between, i + 1), F.lit(CONTEXT)).alias("right"))
        return F.when(F.size(values) > 0, F.transform(values, one)).alias(f)

    return save(out.select("row", "doc_id", *[hits(f) for f in forms]), path)


def placed(found: DataFrame) -> DataFrame:
    """matches -> one row for each valid match: row, form, start, end (code points), value, left, right."""
    forms = [*FORMS, *SLOTS]

    def numbered_hits(f: str) -> Column:
        return F.transform(F.coalesce(F.col(f), F.array().cast(found.schema[f].dataType)), lambda h, i: F.struct(F.lit(f).alias("form"), i.alias("i"), h.alias("h")))

    some = found.where(" or ".join(f"`{f}` is not null" for f in forms))
    one = some.select("row", F.explode_outer(F.concat(*map(numbered_hits, forms))).alias("m")).where("m is not null").select("row", "m.form", "m.i", "m.h.*")
    own = F.char_length("value").cast("long")
    so_far = Window.partitionBy("row", "form").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + own).over(so_far)
    return one.withColumn("end", end).withColumn("start", F.col("end") - own).where(is_valid(F.col("form"), F.col("value"))).select("row", "form", "start", "end", "value", "left", "right")


def patterns() -> Column:
    """The lexical patterns of a match: `L` and the two words before, `M` and the words on either side."""
    before = F.regexp_extract_all(F.lower("left"), F.lit(r"[^\s]+"), F.lit(0))
    near = lambda k: F.try_element_at(before, F.lit(-k))
    after = F.nullif(F.regexp_extract(F.lower("right"), r"^\s*([^\s]+)", 1), F.lit(""))
    return F.array_compact(F.array(F.concat(F.lit("L "), F.coalesce(near(2), F.lit("^")), F.lit(" "), near(1)), F.concat(F.lit("M "), near(1), F.lit(" "), after)))


def without_overlaps(spans: DataFrame) -> DataFrame:
    """spans with is_base; slots that overlap a base span are left out."""
    base = F.col("form").isin(*KINDS)
    here = Window.partitionBy("row").orderBy("start", "end")
    before = F.max(F.when(base, F.col("end"))).over(here.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(here.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    return spans.withColumns({"is_base": base, "free": free}).where("is_base or free").drop("free")


def trusted_patterns(spans: DataFrame, path: str, support: int = 3, trust: float = 0.8, half: float = 0.5, rounds: int = 3) -> DataFrame:
    """spans (form, value, is_base, patterns) -> pattern, kind, confidence of the patterns that are trusted after the last round.

    Every table of a round is written under path. Rows travel as (pattern, digest of the value), pre-aggregated.
    """
    value = F.unhex(F.md5(F.lower("value").cast("binary")))
    edges = save(spans.select(F.explode("patterns").alias("pattern"), value.alias("value"), "form", "is_base").distinct(), f"{path}/edges")
    known = [F.count_if(F.col("form") == k).alias(f"known_{k}") for k in KINDS]
    sums = edges.groupBy("pattern").agg(F.count("*").alias("all"), *known).where(F.greatest(*[F.col(f"known_{k}") for k in KINDS]) >= support)
    sums = save(sums, f"{path}/patterns")
    if sums.isEmpty():
        return sums.select("pattern", F.lit(KINDS[0]).alias("kind"), F.lit(0.0).alias("confidence"))
    open_ = save(spread_join(save(edges.where("not is_base"), f"{path}/unknown"), sums.select("pattern"), ["pattern"], "value"), f"{path}/open")

    def confidence(extra: DataFrame | None) -> DataFrame:
        rows = sums if extra is None else sums.join(extra, "pattern", "left")
        more = {k: F.lit(0.0) if extra is None else F.coalesce(F.col(f"sum_{k}"), F.lit(0.0)) for k in KINDS}
        share = lambda k: F.when(F.col(f"known_{k}") >= support, (F.col(f"known_{k}") + more[k]) / (F.col("all") + 1)).otherwise(0.0)
        return rows.select("pattern", *[share(k).alias(k) for k in KINDS])

    trusts = save(confidence(None), f"{path}/confidence-0")
    for r in range(1, rounds + 1 if not open_.isEmpty() else 1):
        doubt = lambda k: F.sum(F.when((F.col(k) >= half) & F.col("form").isin(*[s for s, kinds in OPEN_TO.items() if k in kinds]), F.log1p(-F.col(k))).otherwise(0.0))
        scores = save(spread_join(open_, trusts, ["pattern"], "value").groupBy("value").agg(*[F.round(1 - F.exp(doubt(k)), 9).alias(k) for k in KINDS]), f"{path}/scores-{r}")
        extra = spread_join(open_, scores, ["value"], "pattern").groupBy("pattern").agg(*[F.round(F.sum(k), 6).alias(f"sum_{k}") for k in KINDS])
        trusts = save(confidence(extra), f"{path}/confidence-{r}")
    best = F.array_max(F.array(*[F.struct(F.col(k).alias("confidence"), F.lit(-i).alias("order"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS)]))
    return save(trusts.select("pattern", best.alias("b")).where(F.col("b.confidence") >= trust).select("pattern", "b.kind", "b.confidence"), f"{path}/trusted")


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text) -> row, doc_id and spans: start, end, kind, value, is_base, in order of start and kind."""
    work = work_dir(docs.sparkSession, "private")
    found = matches(docs, f"{work}/matches")
    spans = save(without_overlaps(placed(found)).withColumn("patterns", patterns()), f"{work}/spans")
    trusted = trusted_patterns(spans, work, **options)
    slots = save(spans.where("not is_base").select("row", "start", "end", "value", "form", F.explode("patterns").alias("pattern")), f"{work}/slots")
    fits = F.coalesce(*[F.when(F.col("form") == s, F.col("kind").isin(*kinds)) for s, kinds in OPEN_TO.items()])
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    added = spread_join(slots, trusted, ["pattern"], "row").where(fits).groupBy("row", "start", "end", "value").agg(F.max(F.struct("confidence", (-order).alias("order"), "kind")).alias("b"))
    base = spans.where("is_base").select("row", "start", "end", "value", F.col("form").alias("kind"), F.lit(True).alias("is_base"))
    rows = base.unionByName(added.select("row", "start", "end", "value", F.col("b.kind").alias("kind"), F.lit(False).alias("is_base")))
    one = F.struct("start", order.alias("order"), "end", "kind", "value", "is_base")
    own = rows.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("spans"))
    none = F.array().cast(own.schema["spans"].dataType)
    return found.select("row", "doc_id").join(own, "row", "left").withColumn("spans", F.coalesce("spans", none))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_* and base_sha256 are of the base; spans and n_added tell what the patterns found beyond it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = F.filter("spans", lambda s: s["is_base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["is_base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    out = personal_data(docs)
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["is_base"])).cast("long").alias("n_added"))
