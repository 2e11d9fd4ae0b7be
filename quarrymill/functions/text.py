"""Columns over texts: blocks and headings, citations, drafts, fields and JSON answers. Patterns and phrases are parameters."""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAG = r"\[source:\s*[^\]]+\]"


# blocks ---------------------------------------------------------------------------------------------------------------------


#: Every white space character.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def split_blocks(text: Column) -> Column:
    """Paragraphs parted by blank lines, each on one line, without control characters."""
    blocks = F.filter(F.transform(F.split(_spaced(text), r"(?U)\n\s*\n"), _strip), lambda b: b != "")
    one_line = lambda b: F.when(F.contains(b, F.lit("\n")), F.regexp_replace(b, r"(?U)\s*\n\s*", " ")).otherwise(b)
    return F.coalesce(F.transform(blocks, one_line), F.array().cast("array<string>"))


def _spaced(text: Column) -> Column:
    """Control characters and tabs are spaces, and of spaces in a row one stays. A single space, as between words, matches nothing."""
    other = r"\x00-\x09\x0B\x0C\x0E-\x1F\x7F"
    return F.regexp_replace(text, f"[{other}][{other} ]*| [{other} ]+", " ")


def clean_line(line: Column) -> Column:
    """One line as `split_blocks` has it in a block; an empty one parts blocks, and those of a block are joined by spaces."""
    return _strip(_spaced(line))


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


#: Characters of a heading at most, number signs and digits that it starts with, and marks after a number.
HEADING_CHARS, SIGNS, DIGITS, MARKS = 200, 6, 3, [".", "-", "/"]


def is_heading(block: Column, chapters: list[str] | None = ()) -> Column:
    """Whether a short block starts with a chapter word, with number signs and a space, or with a number (after a parenthesis or not) and a mark.

    Without a list of chapter words (None) nothing is a heading.
    """
    if chapters is None:
        return F.lit(False)
    white = F.lit(WHITE)
    after = lambda s, n: F.substring(s, n + 1, F.char_length(s))
    t = F.ltrim(block, white)
    signs = F.char_length(t) - F.char_length(F.ltrim(t, F.lit("#")))
    titled = signs.between(1, SIGNS) & F.contains(white, F.left(after(t, signs), F.lit(1))) & (F.char_length(t) > signs)
    inner = F.when(t.startswith("("), F.ltrim(after(t, F.lit(1)), white)).otherwise(t)
    figures = F.char_length(F.regexp_extract(inner, r"^\p{Nd}+", 0))
    numbered = figures.between(1, DIGITS) & F.left(F.ltrim(after(inner, figures), white), F.lit(1)).isin(MARKS)
    named = [t.startswith(w) for w in chapters]
    return (block != "") & (F.char_length(block) <= HEADING_CHARS) & reduce(operator.or_, [titled, numbered, *named])


def heading_of(chapters: list[str] | None = ()) -> Callable[[str], bool]:
    """`is_heading` for a text at a time."""

    def run(block: str) -> bool:
        t = block.lstrip(WHITE)
        rest = t.lstrip("#")
        titled = 1 <= len(t) - len(rest) <= SIGNS and rest[:1] in WHITE and rest != ""
        inner = t[1:].lstrip(WHITE) if t.startswith("(") else t
        figures = len(re.match(r"\d*", inner)[0])
        numbered = 1 <= figures <= DIGITS and inner[figures:].lstrip(WHITE)[:1] in MARKS
        return block != "" and len(block) <= HEADING_CHARS and (titled or numbered or t.startswith(tuple(chapters)))

    return run if chapters is not None else lambda block: False


def glue(heading: str, following: str) -> str:
    """A heading and the block that it takes up."""
    return re.sub(r"[ :.\-]+\Z", "", heading) + "\n" + following


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def exploded(df: DataFrame, keep: list[str], array: Column, place: str, value: str) -> DataFrame:
    """keep, place (from 0) and value of each element of array. The array is worked out once: a plain explode also filters on its size first."""
    return df.select(*keep, F.posexplode_outer(array).alias(place, value)).where(F.col(place).isNotNull())


def attach_headings(blocks: Column, chapters: list[str] | None = ()) -> Column:
    """A heading with a block after it is glued to it, and both are used up; the last one stays.

    Blocks become a string of one letter each, in which every heading takes up its successor, from left to right.
    """
    letters = lambda all_: F.array_join(F.transform(all_, lambda b: F.when(is_heading(b, chapters), "h").otherwise("t")), "")
    glued = lambda x: F.concat(F.regexp_replace(x["block"], r"[ :.\-]+$", ""), F.lit("\n"), x["following"])
    one = lambda x: F.when(x["role"] == "O", glued(x)).when(x["role"] != "U", x["block"])

    def whole(all_: Column) -> Column:
        roles = F.split(F.regexp_replace(letters(all_), "h.", "OU"), "")
        rows = F.arrays_zip(all_.alias("block"), roles.alias("role"), F.slice(all_, 2, 1 << 30).alias("following"))
        return F.filter(F.transform(rows, one), lambda b: b.isNotNull())

    return F.when(F.size(blocks) > 0, let(blocks, whole)).otherwise(blocks)


def probe_phrase(content: Column) -> Column:
    """A phrase of at most 60 characters from the middle of a text, for looking the text up; null for nothing."""
    t = F.trim(F.regexp_replace(content, r"(?U)\s+", " "))
    n = F.char_length(t)
    phrase = F.when(n < 30, t).when(n > 600, F.substring(t, 201, 200)).otherwise(F.substring(t, F.floor(n / 2).cast("int") + 1, n))
    return F.nullif(F.left(phrase, F.lit(60)), F.lit(""))


# fields ----------------------------------------------------------------------------------------------------------------------


def parse_fields(text: Column) -> Column:
    """map of `key: value` lines, the last of a key winning; lines without a colon are joined under notes."""
    lines = F.transform(F.split(text, r"\r?\n"), _strip)
    with_colon = F.filter(lines, lambda x: F.contains(x, F.lit(":")))
    pair = lambda x: F.struct(_strip(F.substring_index(x, ":", 1)).alias("k"), _strip(F.substring(x, F.instr(x, ":") + 1, F.char_length(x))).alias("v"))
    pairs = F.filter(F.transform(with_colon, pair), lambda p: (p["k"] != "") & (p["v"] != ""))
    notes = _strip(F.array_join(F.filter(lines, lambda x: (x != "") & ~F.contains(x, F.lit(":"))), "\n"))
    pairs = F.when(notes != "", F.array_append(pairs, F.struct(F.lit("notes").alias("k"), notes.alias("v")))).otherwise(pairs)
    last = lambda all_: F.map_from_entries(F.filter(all_, lambda p, i: ~F.exists(F.slice(all_, i + 2, F.size(all_) + 1), lambda q: q["k"] == p["k"])))
    return let(pairs, last)


# fixed values: the fields of a file's progress, in order
COUNTERS = ["total_chunks", "processed_chunks", "failed_chunks", "current_batch"]
PROGRESS = [*COUNTERS, "retry_count", "last_error", "started_at", "updated_at"]


def merge_progress(existing: Column, updates: Column, error: Column, now: Column) -> Column:
    """A file's progress: defaults, over them what is stored, over it the updates (the counters and started_at) that aren't null.

    A new error takes the place of the last one, cut to 500 characters; one that isn't empty counts a retry. updated_at is now.
    """
    pick = lambda name, *default: F.coalesce(updates[name], existing[name], *default)
    return F.struct(
        *[pick(c, F.lit(0)).alias(c) for c in COUNTERS],
        (F.coalesce(existing["retry_count"], F.lit(0)) + F.coalesce((error != "").cast("int"), F.lit(0))).alias("retry_count"),
        F.coalesce(F.left(error, F.lit(500)), existing["last_error"]).alias("last_error"),
        pick("started_at").alias("started_at"),
        now.alias("updated_at"),
    )


# citations -------------------------------------------------------------------------------------------------------------------


def strip_citation_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s*" + TAG, ""))


def citation_labels(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[source:\s*([^\]]+)\]"), F.lit(1)), lambda x: F.trim(x))


def claim_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TAG))


def has_unverified(text: Column, marker: str) -> Column:
    return F.contains(text, F.lit(marker))


def split_sources_block(text: Column, heading: str = "Sources") -> Column:
    """struct(body, block), parted at the first line that is the heading: `##` and its words."""
    at = F.regexp_instr(text, F.lit(rf"(?Umd)^##\s*{re.escape(heading)}\s*$"))
    found = at > 0
    return F.struct(
        F.when(found, F.regexp_replace(F.left(text, at - 1), r"(?U)\s+\z", "")).otherwise(text).alias("body"),
        F.when(found, _strip(F.substring(text, at, F.char_length(text)))).otherwise("").alias("block"),
    )


# fixed values: what stands before a cited line, what parts it, and how its last two parts begin
BULLETS, DASHES = "\u2022*-", "\u2014-"
PLACE, NEARNESS = "chunk", "similarity="


def parse_citations(block: Column) -> Column:
    """array<struct(label, title, chunk_index, similarity)> of the lines `[label]: title - chunk #n - similarity=s`, bullets before them or not.

    A line is cut at its dashes; the first two parts in a row that tell place and nearness end the title, which may hold dashes itself.
    """
    white, cut = F.lit(WHITE), lambda s, n: F.substring(s, n, F.char_length(s))

    def headed(line: Column) -> Column:
        bare = F.ltrim(line, F.lit(WHITE + BULLETS))
        shut = F.instr(bare, "]")
        tail = F.ltrim(cut(bare, shut + 1), white)
        return F.struct(
            F.when(bare.startswith("[") & (shut > 2), F.substring(bare, F.lit(2), shut - 2)).alias("label"), F.when(tail.startswith(":"), F.ltrim(cut(tail, F.lit(2)), white)).otherwise(tail).alias("rest")
        )

    def named(h: Column) -> Column:
        parts = F.split(F.translate(h["rest"], DASHES, "--"), "-")
        told = F.transform(parts, lambda p: F.btrim(p, white))
        place = lambda i: F.ltrim(cut(F.get(told, i), F.lit(len(PLACE) + 1)), white)
        fits = lambda i: F.get(told, i).startswith(PLACE) & place(i).rlike("^#[0-9]+$") & F.get(told, i + 1).rlike(f"^{NEARNESS}[0-9.]")
        at = F.when(F.size(parts) > 2, F.get(F.filter(F.sequence(F.lit(1), F.size(parts) - 2), fits), F.lit(0)))
        title = F.left(h["rest"], F.char_length(F.array_join(F.slice(parts, F.lit(1), at), "-")))
        return F.when(
            at.isNotNull() & (title != ""),
            F.struct(
                F.trim(h["label"]).alias("label"),
                F.trim(title).alias("title"),
                cut(place(at), F.lit(2)).try_cast("int").alias("chunk_index"),
                F.regexp_extract(F.get(told, at + 1), "[0-9.]+", 0).try_cast("double").alias("similarity"),
            ),
        )

    lines = F.filter(F.transform(F.split(block, "\n"), headed), lambda h: h["label"].isNotNull())
    return F.filter(F.transform(lines, named), lambda c: c.isNotNull())


# drafts ----------------------------------------------------------------------------------------------------------------------

# fixed values: lines that say nothing
FILLERS = {"...", "…", ". . .", "-", "*", "•"}


def compared_form(line: Column, odd: Column) -> Column:
    """The form in which lines are compared: without citation tags and extra spaces. `odd`: whether there may be white space that isn't a space."""
    untagged = F.when(F.contains(line, F.lit("[source:")), F.regexp_replace(line, TAG, "")).otherwise(line)
    plain = lambda t: F.trim(F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " +", " ")).otherwise(t))
    return let(untagged, lambda t: F.when(odd, F.trim(F.regexp_replace(t, f"[{WHITE}]+", " "))).otherwise(plain(t)))


def dedupe_lines(text: Column, window: int = 12, prefix: int = 40) -> Column:
    """Lines of generated text without repeats, compared without citation tags and extra spaces.

    Runs of blank lines keep their first; lines of dots and bare bullets go; a line goes if it equals one of the last `window` kept or starts
    with the first `prefix` characters of the last one kept. Lines of citation tags only stay and count for nothing. Outer blank lines go.

    A fold along the lines, whose state is the forms of the last lines kept and a mark for each line seen; null stays null. Texts whose
    only white space is spaces and line ends, found by plain searches, are spared patterns of all white space.
    """

    def formed(lines: Column, odd: Column) -> Column:
        """line and form: null where a line goes whatever was kept, empty where it stays and counts for nothing."""
        again = lambda i: (i > 0) & (F.get(lines, i - 1) == "")
        form = lambda x, i: F.when(x == "", F.when(~again(i), F.lit(""))).when(~F.when(odd, _strip(x)).otherwise(F.trim(x)).isin(*sorted(FILLERS)), compared_form(x, odd))
        return F.transform(lines, lambda x, i: F.struct(x.alias("line"), form(x, i).alias("form")))

    def fold(state: Column, form: Column) -> Column:
        forms, head = state["forms"], F.left(F.try_element_at(state["forms"], F.lit(-1)), F.lit(prefix))
        counts = F.coalesce(form, F.lit("")) != ""
        seen = F.array_contains(forms, form) | F.coalesce((F.char_length(head) == prefix) & F.startswith(form, head), F.lit(False))
        stays = F.when(counts, ~seen).otherwise(form.isNotNull())
        added = lambda: F.when(F.size(forms) < window, F.array_append(forms, form)).otherwise(F.array_append(F.slice(forms, 2, window - 1), form))
        return let(stays, lambda ok: F.struct(F.when(ok & counts, added()).otherwise(forms).alias("forms"), F.concat(state["marks"], F.when(ok, F.lit("1")).otherwise(F.lit("0"))).alias("marks")))

    def kept(rows: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("forms"), F.lit("").alias("marks"))
        marks = F.aggregate(rows, start, lambda state, row: fold(state, row["form"]), lambda state: F.split(state["marks"], ""))
        stay = let(marks, lambda m: F.filter(rows, lambda _, i: F.get(m, i) == "1"))
        return F.btrim(F.array_join(F.transform(stay, lambda row: row["line"]), "\n"), F.lit("\n"))

    ended = lambda x, odd: F.when(odd, F.rtrim(x, F.lit(WHITE))).otherwise(F.rtrim(x))
    odd = reduce(operator.or_, [F.contains(text, F.lit(c)) for c in WHITE if c not in " \n"])
    rows = let(odd, lambda o: let(F.transform(F.split(text, "\n"), lambda x: ended(x, o)), lambda lines: formed(lines, o)))
    return let(rows, kept)


@dataclass(frozen=True)
class LetterForm:
    """The phrases of a letter; defaults are placeholders of our own, deployments pass theirs."""

    to_person: str = "To {name}"
    to_organization: str = "To the company / {name}"
    legal_forms: list[str] = field(default_factory=lambda: ["company", "association"])
    # fixed values: what the field entity_type may say, and the fields that a subject may stand in
    persons: list[str] = field(default_factory=lambda: ["individual", "person"])
    organizations: list[str] = field(default_factory=lambda: ["organization", "company", "entity"])
    subject_keys: list[str] = field(default_factory=lambda: ["subject", "letter_subject", "project_name"])
    titles: list[str] = field(default_factory=lambda: ["Dr.", "Prof."])
    subject_label: str = "Subject:"
    greeting: str = "Greetings,"
    transition: str = "To the matter,"
    transition_pattern: str = r"(?i)to the matter\s*,?"
    closing_pattern: str = r"(?i)with kind regards"
    closing: str = "With kind regards"
    footer: str = "The office"
    no_content: str = "> No source supports this."
    no_subject: str = "{{subject}}"
    no_recipient: str = "{{recipient_name}}"


def _given(text: Column) -> Column:
    """text without outer spaces, or null where nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def _first_of(words: list[str], fits: Callable[[Column], Column]) -> Column:
    """The first of some words that fits, or null."""
    return F.get(F.filter(F.array(*map(F.lit, words)), fits), F.lit(0)) if words else F.lit(None).cast("string")


def entity_type(fields: Column, form: LetterForm = LetterForm()) -> Column:
    """individual or organization: by the field of that name, else by a personal title in the recipient's name."""
    kinds = F.create_map(*[F.lit(x) for words, kind in ((form.organizations, "organization"), (form.persons, "individual")) for w in words for x in (w, kind)])
    titled = _first_of(form.titles, lambda title: F.contains(fields["recipient_name"], title))
    return F.coalesce(F.try_element_at(kinds, F.coalesce(F.lower(F.trim(fields["entity_type"])), F.lit(""))), F.when(titled.isNotNull(), "individual"), F.lit("organization"))


def recipient_line(fields: Column, form: LetterForm = LetterForm()) -> Column:
    """The opening: an organization's name comes without the legal form that it starts with, since the opening has one."""
    into = lambda phrase, name: F.replace(F.lit(phrase), F.lit("{name}"), name)
    name = F.coalesce(_given(fields["recipient_name"]), F.when(fields["recipient_name"] != "", F.lit("")), F.lit(form.no_recipient))

    def bare(n: Column) -> Column:
        form_of = _first_of(form.legal_forms, lambda w: F.startswith(n, w))
        rest = F.ltrim(F.substring(n, F.coalesce(F.char_length(form_of), F.lit(0)) + 1, F.char_length(n)))
        return F.coalesce(_given(F.when(form_of.isNotNull() & rest.startswith("/"), F.substring(rest, 2, 1 << 30)).otherwise(rest)), F.lit(form.no_recipient))

    return let(name, lambda n: F.when(entity_type(fields, form) == "individual", into(form.to_person, n)).otherwise(into(form.to_organization, bare(n))))


def letter_subject(text: Column, fields: Column, form: LetterForm = LetterForm(), fallback: Column | None = None) -> Column:
    """The subject that a field gives, else that of the first line with the label (bold or not), else the fallback."""
    label = form.subject_label

    def told(line: Column) -> Column:
        t = F.btrim(line, F.lit(WHITE))
        t = F.when(t.startswith("**"), F.substring(t, 3, 1 << 30)).otherwise(t)
        own = F.btrim(F.substring(t, len(label) + 1, 1 << 30), F.lit(WHITE))
        own = F.when(own.endswith("**") & (F.char_length(own) > 2), F.rtrim(F.left(own, F.char_length(own) - 2), F.lit(WHITE))).otherwise(own)
        return F.when(t.startswith(label) & (own != ""), own)

    line = F.get(F.array_compact(F.transform(F.split(text, "\n"), told)), F.lit(0))
    ways = [*(fields[k] for k in form.subject_keys), strip_citation_tags(line), *([] if fallback is None else [fallback])]
    return F.coalesce(*map(_given, ways), F.lit(form.no_subject))


def main_content(text: Column, form: LetterForm = LetterForm()) -> Column:
    """Lines between the first transition and the closing after it, without those that belong to the envelope."""
    begun = F.split(text, form.transition_pattern, 2)
    ended = F.split(F.coalesce(F.get(begun, F.lit(1)), F.get(begun, F.lit(0))), form.closing_pattern, 2)
    envelope = [*(phrase.partition("{")[0] for phrase in (form.to_person, form.to_organization)), form.subject_label, form.greeting, form.transition, form.closing, form.footer]
    outer = lambda line: _first_of(envelope, lambda p: F.startswith(F.trim(line), p)).isNotNull()
    lines = F.filter(F.split(F.get(ended, F.lit(0)), "\r?\n"), lambda line: (F.trim(line) != "") & ~outer(line))
    return F.coalesce(F.nullif(_strip(F.array_join(F.transform(lines, lambda x: F.rtrim(x, F.lit(WHITE))), "\n")), F.lit("")), F.lit(form.no_content))


def enforce_structure(text: Column, fields: Column, form: LetterForm = LetterForm(), fallback_subject: Column | None = None) -> Column:
    """Exactly seven parts: opening, subject, greeting, transition, content, closing, footer."""
    subject = F.concat(F.lit(f"{form.subject_label} "), letter_subject(text, fields, form, fallback_subject))
    return F.concat_ws("\n\n", recipient_line(fields, form), subject, *map(F.lit, (form.greeting, form.transition)), main_content(text, form), *map(F.lit, (form.closing, form.footer)))


def markdown_lines(text: Column) -> Column:
    """array<struct(style, text)>: h1, h2, list or normal."""
    def one(line: Column) -> Column:
        t = F.trim(line)
        style = F.when(t.rlike(r"^##\s+"), "h2").when(t.rlike(r"^#\s+"), "h1").when(t.rlike(r"^[-*•]\s+"), "list").otherwise("normal")
        return F.struct(style.alias("style"), F.trim(F.regexp_replace(t, r"^(?:##?|[-*•])\s+", "")).alias("text"))

    return F.transform(F.split(text, r"\r?\n"), one)


ARABIC = r"[\x{0600}-\x{06FF}]"


def template_profile(paragraphs: Column) -> Column:
    """Of array<struct(text, align)>: whether {{body}} is marked, the other names in braces, right-to-left, and how many paragraphs."""
    text = F.array_join(F.transform(paragraphs, lambda p: p["text"]), "\n")
    names = F.regexp_extract_all(text, F.lit(r"\{\{\s*([A-Za-z0-9_\-\x{0600}-\x{06FF}]+)\s*\}\}"), F.lit(1))
    return F.struct(
        F.array_contains(names, "body").alias("has_body"),
        F.array_sort(F.array_distinct(names)).alias("names"),
        (F.exists(paragraphs, lambda p: p["align"] == "right") | text.rlike(ARABIC)).alias("rtl"),
        F.size(paragraphs).alias("paragraphs"),
    )


# answers of a model, as JSON -----------------------------------------------------------------------------------------------------


def coerce_content(value: Column) -> Column:
    """Text of a JSON string, or of a list of parts joined by line ends; null is empty, anything else its JSON.

    A part is a string, an object of type text or without type that has a text, or one whose content is a string; other parts say nothing.
    """

    def part(p: Column) -> Column:
        kind, text, content = F.try_variant_get(p, "$.type", "string"), F.try_variant_get(p, "$.text", "string"), F.try_variant_get(p, "$.content", "variant")
        own = F.when(kind.isNull() | (kind == "text"), text)
        return F.when(F.schema_of_variant(p) == "STRING", p.try_cast("string")).otherwise(F.coalesce(own, F.when(F.schema_of_variant(content) == "STRING", content.try_cast("string"))))

    def text(v: Column) -> Column:
        listed = F.array_join(F.filter(F.transform(v.try_cast("array<variant>"), part), lambda t: t.isNotNull()), "\n")
        kind = F.schema_of_variant(v)
        return F.when(v.isNull(), F.coalesce(value, F.lit(""))).when(kind == "VOID", "").when(kind == "STRING", v.try_cast("string")).when(kind.startswith("ARRAY"), listed).otherwise(value)

    return let(F.try_parse_json(value), text)


# fixed values: the lists of findings in a review, in order
FINDINGS = [
    "unverified_claims", "dangling_citations", "placeholder_claims", "duplicate_segments", "incomplete_sentences",
    "unintended_placeholders", "contradictions", "wrong_names", "unsupported_facts", "unprofessional_phrasing",
]
REVIEW = "struct<verdict:string," + ",".join(f"{f}:array<string>" for f in FINDINGS) + ",suggested_corrections:string,summary_ar:string>"


FENCE = "```"


def unfenced(text: Column) -> Column:
    """An answer without the fence around it, and the name of its language."""
    white = F.lit(WHITE)
    t = F.btrim(text, white)
    inner = F.when(t.startswith(FENCE), F.substring(t, len(FENCE) + 1, 1 << 30)).otherwise(t)
    inner = F.when(t.startswith(FENCE) & inner.startswith("json"), F.substring(inner, 5, 1 << 30)).otherwise(inner)
    return F.btrim(F.when(inner.endswith(FENCE), F.left(inner, F.char_length(inner) - len(FENCE))).otherwise(inner), white)


def parse_review(text: Column) -> Column:
    """A review's verdict, its ten lists of findings, suggested_corrections and summary_ar; what isn't JSON, or has no verdict, is unverifiable."""
    none = F.array().cast("array<string>")
    return let(
        F.from_json(unfenced(text), REVIEW),
        lambda got: F.struct(
            F.coalesce(got["verdict"], F.lit("unverifiable")).alias("verdict"),
            *[F.coalesce(got[f], none).alias(f) for f in FINDINGS],
            *[F.coalesce(got[f], F.lit("")).alias(f) for f in ("suggested_corrections", "summary_ar")],
        ),
    )


DRAFT = "struct<title:string,body_markdown:string,placeholders:array<struct<field:string,required:boolean,hint:string>>,sources:array<struct<document_id:string,title:string,category:string,contribution:string>>>"


def parse_draft_json(text: Column) -> Column:
    """The JSON object in a fenced or wrapped answer; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")), DRAFT)
