"""Requests to letter types, recipients, search queries and styles, by a catalogue table (type, ord, label, keywords, fields)."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import exploded

#: What may stand before and after a keyword, besides white space and the ends of a text.
LEFT, RIGHT = "،,:;", "،,:;."
GENERAL = "general"
#: Styles that may be set by default.
MOST_TYPES = 1000
#: Keywords of one automaton. A catalogue of more is looked up by several, one after the other.
BLOCK = 200_000

HITS = "array<struct<n: int, ord: int, type: string, label: string, hits: array<string>>>"


def _automata(catalogue: DataFrame, block: int) -> Iterator[tuple[list, ahocorasick.Automaton]]:
    """The entries of a catalogue (ord, type, label), and an Aho-Corasick automaton over their keywords, in blocks of so many keywords.

    A keyword's value is the list of (entry, place in its list).
    """

    def made(entries: list, words: dict) -> tuple[list, ahocorasick.Automaton]:
        automaton = ahocorasick.Automaton()
        for word, places in words.items():
            automaton.add_word(word, (len(word), places))
        automaton.make_automaton()
        return entries, automaton

    entries: list = []
    words: dict[str, list[tuple[int, int]]] = {}
    for r in catalogue.orderBy("ord").select("ord", "type", "label", "keywords").toLocalIterator():
        entries.append((r["ord"], r["type"], r["label"]))
        for place, word in enumerate(r["keywords"] or []):
            if word:
                words.setdefault(word, []).append((len(entries) - 1, place))
            if len(words) >= block:
                yield made(entries, words)
                entries, words = [entries[-1]], {}
    if words:
        yield made(entries, words)


def found_keywords(text: str, automaton: ahocorasick.Automaton) -> dict[int, dict[int, str]]:
    """Of each entry the keywords, by their place, that stand in the text as whole words."""
    out: dict[int, dict[int, str]] = {}
    for end, (size, places) in automaton.iter(text):
        start = end - size + 1
        if (start == 0 or text[start - 1].isspace() or text[start - 1] in LEFT) and (end + 1 == len(text) or text[end + 1].isspace() or text[end + 1] in RIGHT):
            for entry, place in places:
                out.setdefault(entry, {})[place] = text[start : end + 1]
    return out


def _scored(text: Column, catalogue: DataFrame, block: int = BLOCK) -> Column:
    """HITS: the types with keywords that stand in the text as whole words, in the order of the list. A text is read once for each automaton."""
    models = [catalogue.sparkSession.sparkContext.broadcast(m) for m in _automata(catalogue, block)]

    @F.arrow_udf(HITS)
    def look(column: pa.Array) -> pa.Array:
        rows = []
        for t in column.to_pylist():
            hits: dict[tuple, dict[int, str]] = {}
            for model in models if t else []:
                entries, automaton = model.value
                for entry, places in found_keywords(t, automaton).items():
                    hits.setdefault(entries[entry], {}).update(places)
            rows.append([{"n": len(h), "ord": e[0], "type": e[1], "label": e[2], "hits": [h[k] for k in sorted(h)]} for e, h in hits.items()])
        return pa.array(rows, pa.list_(pa.struct([("n", pa.int32()), ("ord", pa.int32()), ("type", pa.string()), ("label", pa.string()), ("hits", pa.list_(pa.string()))])))

    return look(text)


def keyword_hits(requests: DataFrame, catalogue: DataFrame, block: int = BLOCK) -> DataFrame:
    """(request_id, type, ord, label, hits) for every type with a hit. No shuffle: the catalogue travels as automata, and the plan is the same whatever its size."""
    rows = exploded(requests, ["request_id"], _scored(F.col("text"), catalogue, block), "place", "e")
    return rows.select("request_id", "e.type", "e.ord", "e.label", "e.hits")


def detect_intent(requests: DataFrame, catalogue: DataFrame, block: int = BLOCK) -> DataFrame:
    """The type with most hits, the later entry on a tie; without hits general with confidence 0, else min(1, 0.5 + 0.1 * hits)."""
    scored = requests.withColumn("_hits", _scored(F.col("text"), catalogue, block))
    out = scored.withColumn("best", F.array_max(F.filter("_hits", lambda e: e["type"] != GENERAL)))
    none = F.array().cast("array<string>")
    return out.select(
        "request_id",
        "text",
        F.coalesce("best.type", F.lit(GENERAL)).alias("type"),
        F.col("best.label").alias("label"),
        F.coalesce("best.hits", none).alias("hits"),
        F.when(F.col("best").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.round(0.5 + 0.1 * F.col("best.n"), 10))).alias("confidence"),
    )


#: X after "to" up to a stop word, punctuation or the end.
RECIPIENTS = [r"(?iU)(?:^|\s)to\s+((?:the\s+)?[\p{L} ]{3,80}?)(?=\s+(?:about|for|on|regarding)\b|[.,:;\n]|$)", r"(?iU)(?:^|\s)for\s+([\p{L} ]{3,80}?)(?=\s+(?:about|on|regarding)\b|[.,:;\n]|$)"]


def extract_recipient(text: Column, patterns: list[str] = RECIPIENTS) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns])


def refine_queries(intents: DataFrame, prefixes: dict[str, str] = {"templates": "template", "internal_policies": "policy", "national_regulations": "regulation"}, patterns: list[str] = RECIPIENTS) -> DataFrame:
    """Three search texts for each request: prefix and label, the recipient for templates and regulations, topics for policies and regulations.

    Topics are the first six distinct hits. A general request is searched by its own text, or by the prefix if it is blank.
    """
    who = F.coalesce(extract_recipient(F.col("text"), patterns), F.lit(""))
    topics = F.array_join(F.slice(F.array_distinct("hits"), 1, 6), " ")
    raw = F.nullif(F.trim(F.coalesce("text", F.lit(""))), F.lit(""))

    def query(section: str) -> Column:
        parts = [F.lit(prefixes[section]), F.col("label")]
        parts += [who] if section != "internal_policies" else []
        parts += [topics] if section != "templates" else []
        full = F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])
        return F.when(F.col("type") == GENERAL, F.coalesce(raw, F.lit(prefixes[section]))).otherwise(full)

    return intents.select("request_id", "type", F.explode(F.array(*[F.struct(F.lit(s).alias("section"), query(s).alias("query")) for s in prefixes])).alias("q")).select("request_id", "type", "q.section", "q.query")


def resolve_style(requests: DataFrame, defaults: DataFrame, fallback: str = GENERAL) -> DataFrame:
    """requests (request_id, type, overrides map) with defaults (type, style map): known keys overridden, unknown ones reported as rejected."""
    if defaults.limit(MOST_TYPES + 1).count() > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} default styles")
    d = F.broadcast(defaults.select(F.col("type").alias("_t"), "style"))
    rest = defaults.where(F.col("type") == fallback).select(F.col("style").alias("_fallback")).limit(1)
    rows = requests.join(d, requests["type"] == F.col("_t"), "left").join(F.broadcast(rest), how="left")
    base = F.coalesce("style", "_fallback")
    over = F.coalesce("overrides", F.create_map().cast("map<string,string>"))
    known = F.map_filter(over, lambda k, v: F.array_contains(F.map_keys(base), k) & v.isNotNull())
    kept = F.map_filter(base, lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(known), k), F.lit(False)))
    return rows.select("request_id", "type", F.map_concat(kept, known).alias("style"), F.array_sort(F.array_except(F.map_keys(over), F.map_keys(base))).alias("rejected"))
