"""Goldens for text columns, chunking and embedding, in Arabic and Latin script; all sentences are our own."""

import hashlib
import io
import random
import re
import zipfile
from collections import deque
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import paths as P
from quarrymill.functions import text as T
from quarrymill.operators import catalog as C
from quarrymill.operators import chunking as K
from quarrymill.operators import embedding as E
from quarrymill.operators import intent as N
from quarrymill.operators import retrieval as R


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'map<string,string>' if isinstance(v, dict) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_blocks_headings(spark):
    text = "First line\r\nnext\x07line\n \n# Head :-\n\n\n\nbody  text\n\n(2) not one\n\n12/04/1440 is\n\nlast"
    blocks = one(spark, T.split_blocks(F.col("t")), t=text)
    assert blocks == ["First line next line", "# Head :-", "body text", "(2) not one", "12/04/1440 is", "last"]
    assert one(spark, T.attach_headings(T.split_blocks(F.col("t"))), t=text) == ["First line next line", "# Head\nbody text", "(2) not one", "12/04/1440 is\nlast"]
    assert one(spark, T.attach_headings(F.col("b")), b=["# a", "# b", "c", "# d"]) == ["# a\n# b", "c", "# d"]
    assert one(spark, T.is_heading(F.col("t")), t="١٢. عنوان") is True
    assert one(spark, T.split_blocks(F.col("t")), t=" \n ") == []


def words(n, mark="w"):
    return " ".join(f"{mark}{i}" for i in range(n))


def packed(blocks, *limits):
    w = K.Words(blocks)
    return [w.text(*r) for r in w.packed(K.Limits(*limits))]


def test_packing():
    assert packed([words(5), words(4), words(3)], 10, 12, 0) == [words(5) + " " + words(4), words(3)]
    big = packed([words(3, "a"), words(25, "b")], 10, 12, 5)
    assert big[0] == words(3, "a") and [len(c.split()) for c in big[1:]] == [10, 10, 5]
    led = packed([words(2, "a"), words(25, "b")], 10, 12, 5)
    assert led[1] == words(2, "a") + " " + words(10, "b")
    assert [c for c, _ in K.Words(["a b", "c d", "e"]).chunks(K.Limits(2, 4, 5))] == ["a b", "a b c d", "c d e"]
    w = K.Words(["one " + "x" * 900 + " two"])
    assert [w.text(*r) for r in w.cut(0, 3, 1)] == ["one", "x" * 900, "two"]
    twice = K.Words(["a b c d"], lambda ws: [2] * len(ws))
    assert twice.chunks(K.Limits(4, 4, 0)) == [("a b", 4), ("c d", 4)]
    with pytest.raises(ValueError):
        K.chunker(target=300, hard_max=256)


def plain_chunks(blocks, target, hard_max, overlap):
    """The rules as they are told, with texts that are counted anew each time."""
    count = lambda t: len(t.split())

    def cut(text):
        out = [[]]
        for w in text.split(" "):
            if out[-1] and count(" ".join([*out[-1], w])) > target:
                out.append([])
            out[-1].append(w)
        return [p for p in (" ".join(x).strip() for x in out) if p]

    chunks, held = [], []
    for block in [*blocks, None]:
        if held and (block is None or count(" ".join([*held, block])) > target):
            chunks.append(" ".join(held))
            held = []
        if block is not None and count(block) <= target:
            held.append(block)
        elif block is not None:
            pieces = cut(block)
            led = " ".join([*(chunks[-1].split(" ")[-60:] if chunks else []), pieces[0]])
            if chunks and overlap and count(led) <= hard_max:
                pieces[0] = led
            chunks += pieces
    out = chunks[:1]
    for before, chunk in zip(chunks, chunks[1:]):
        tail = before.split(" ")[-80:] if overlap else []
        while tail and count(" ".join([*tail, chunk])) > hard_max:
            tail = tail[1:]
        out.append(" ".join([*tail, chunk]))
    return [(c, count(c)) for c in out]


def test_chunks_equal_plain_ones(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(300):
        blocks = [" ".join(rnd.choice(["a", "bb", "ccc", "é"]) for _ in range(rnd.choice([1, 3, 8, 20, 60]))) for _ in range(rnd.randint(0, 8))]
        rows.append((i, blocks))
    for limits in ((200, 256, 40), (12, 15, 4), (10, 30, 4), (7, 7, 0)):
        got = [K.Words(b).chunks(K.Limits(*limits)) for _, b in rows]
        assert got == [plain_chunks(b, *limits) for _, b in rows]


def test_chunks_of_a_text(spark):
    """A text with headings, chunk by chunk."""
    text = "# Part one :\n\n" + words(6, "a") + "\n\n2. Second\n\n" + words(14, "b") + "\n\n" + words(3, "c") + "\n\n# End"
    docs = spark.createDataFrame([(1, text), (2, None), (3, " \n ")], "document_id long, content string")
    got = [(r.document_id, r.chunk_index, r.content, r.n_tokens) for r in K.chunk_documents(docs, target=10, hard_max=13, overlap=3).collect()]
    one, two = "# Part one\n" + words(6, "a"), "2. Second\n" + words(14, "b")
    first, second = two.split(" ")[:9], two.split(" ")[9:]
    assert got == [
        (1, 0, one, 9),
        (1, 1, " ".join([*one.split(" ")[-3:], *first]), 13),
        (1, 2, " ".join([*first[-7:], *second]), 13),
        (1, 3, " ".join([*second, *words(3, "c").split(" "), "# End"]), 11),
    ]


def test_chunk_invariants(spark):
    rnd = random.Random(1)
    rows = [(i, "\n\n".join(words(rnd.randint(1, 90), f"p{k}x") for k in range(rnd.randint(0, 12)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "document_id long, content string")
    got = K.chunk_documents(docs, target=30, hard_max=40, overlap=5).collect()
    by = {}
    for r in got:
        assert r.n_tokens <= 40 or len(r.content.split()) == 1
        by.setdefault(r.document_id, []).append(r.chunk_index)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    for i, text in rows:
        assert [w for c in packed(text.split("\n\n") if text else [], 30, 40, 0) for w in c.split()] == text.split()
    stats = {r.document_id: r for r in K.chunk_stats(docs, K.chunk_documents(docs, target=30, hard_max=40, overlap=5)).collect()}
    assert len(stats) == len(rows) and all(stats[i].num_chunks == len(by.get(i, [])) for i, _ in rows)


class Lately:
    """The last lines that were kept, in the form in which lines are compared: without citation tags and extra spaces."""

    def __init__(self, window: int, prefix: int):
        self.forms: deque[str] = deque(maxlen=window)
        self.prefix = prefix

    def keeps(self, line: str) -> bool:
        form = " ".join(re.sub(T.TAG, "", line).split())
        if not form:
            return True
        head = self.forms[-1][: self.prefix] if self.forms else ""
        if form in self.forms or (len(head) == self.prefix and form.startswith(head)):
            return False
        self.forms.append(form)
        return True


def tidy_lines(text: str, window: int = 12, prefix: int = 40) -> str:
    """The plain form of `dedupe_lines`."""
    lately, out = Lately(window, prefix), []
    for blank, run in groupby(map(str.rstrip, text.split("\n")), lambda line: not line):
        out += [""] if blank else [line for line in run if line.strip() not in T.FILLERS and lately.keeps(line)]
    return "\n".join(out).strip("\n")


def test_lines_without_repeats(spark):
    same = "a line that is longer than forty characters, surely"
    text = "\n\nx [source: a]\nx\n- \n...\n\n\ny\nx\n" + same + " one\n" + same + " two\n[source: b]\n\n-\n\nend\n\n"
    many = "\n".join([f"l{i}" for i in range(13)] + ["l0", "l12", "l5"])
    rnd = random.Random(7)
    parts = ["a", "b", "a  b", "\u00a0a", "a\u3000\tb", "a\x1cb ", "", " ", "-", "\u00a0…\t", "[source: x]", "a [source:\u2003y] b", "[source: ]", same, same + " z", same[:40], "سطر", "\r"]
    texts = [text, many, "", "\n\n", "x", *("\n".join(rnd.choices(parts, k=rnd.randint(1, 60))) for _ in range(300)), *("\n".join(f"l{rnd.randint(0, 15)}" for _ in range(80)) for _ in range(50))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    dedupe = T.dedupe_lines(F.col("t"))
    got = {r.i: r.x for r in df.select("i", dedupe.alias("x")).collect()}
    assert got[0] == "x [source: a]\n\ny\n" + same + " one\n[source: b]\n\n\nend" and got[2] == got[3] == ""
    assert got[1].split("\n") == [f"l{i}" for i in range(13)] + ["l0"]
    assert got == {i: tidy_lines(t) for i, t in enumerate(texts)}
    assert one(spark, T.dedupe_lines(F.col("t"), window=2, prefix=3), t="a\nb\nc\na\nabcd\nabcx\nb\nc") == tidy_lines("a\nb\nc\na\nabcd\nabcx\nb\nc", 2, 3)
    assert df.select(T.dedupe_lines(F.lit(None).cast("string")).alias("x")).first().x is None and df.limit(0).select(dedupe).count() == 0
    assert "Python" not in df.select(dedupe)._jdf.queryExecution().toString()


def test_fields_and_names(spark):
    assert one(spark, T.parse_fields(F.col("t")), t="a: 1\nnote one\na : 2\n: x\nb:\nhttp://x: y\n\nnote two") == {"a": "2", "http": "//x: y", "notes": "note one\nnote two"}
    assert one(spark, P.derive_title(F.col("p")), p="a\\b/.hidden") == ".hidden"
    assert one(spark, P.derive_title(F.col("p")), p="a/report.v2.docx") == "report.v2"
    assert one(spark, P.safe_storage_name(F.col("p")), p="تقرير 2024 (a).PDF") == "2024_a.pdf"
    assert one(spark, P.safe_storage_name(F.col("p")), p="تقرير") == "file.bin"
    assert one(spark, P.slug(F.col("p")), p="  تقرير   جديد! ") == "تقرير-جديد"
    assert one(spark, P.infer_category(F.col("p")), p="x\\Policies\\templates\\f.txt") == "templates"
    assert one(spark, P.storage_path(F.lit("d"), F.lit(3), F.col("p"), F.lit("0123456789")), p="a b.txt") == "d/v3/a_b-01234567.txt"


def test_letters(spark):
    form = T.LetterForm()
    line = T.recipient_line(F.col("f"), form)
    assert one(spark, line, f={"entity_type": "person", "recipient_name": "Sam"}) == "To Sam"
    assert one(spark, line, f={"recipient_name": "company / Acme"}) == "To the company / Acme"
    assert one(spark, line, f={"recipient_name": ""}) == "To the company / {{recipient_name}}"
    letter = one(spark, T.enforce_structure(F.col("t"), F.col("f"), form), t="**Subject: Roads [source: a]**\nTo the matter, \nWe build.\n\nWith kind regards\nx", f={"recipient_name": "Dr. Sam"})
    assert letter.split("\n\n") == ["To Dr. Sam", "Subject: Roads", "Greetings,", "To the matter,", "We build.", "With kind regards", "The office"]
    assert "> No source supports this." in one(spark, T.enforce_structure(F.col("t"), F.col("f"), form), t="", f={})


def test_citations(spark):
    block = "## Sources\n• [doc v1 #2]: A title — chunk #2 — similarity=0.91\nnoise\n* [x] B - C - chunk #0 - similarity=1.0\n[y]: - chunk #1 - similarity=1\n- [z]: no origin"
    got = one(spark, T.parse_citations(F.col("t")), t=block)
    assert [(c.label, c.title, c.chunk_index, c.similarity) for c in got] == [("doc v1 #2", "A title", 2, 0.91), ("x", "B - C", 0, 1.0)]
    split = one(spark, T.split_sources_block(F.col("t")), t="intro\nSources\nmore body\n\n##  Sources \n- [a]: b\n")
    assert (split.body, split.block) == ("intro\nSources\nmore body", "##  Sources \n- [a]: b")
    split = one(spark, T.split_sources_block(F.col("t")), t="a\nSources\n### Sources\nb")
    assert (split.body, split.block) == ("a\nSources\n### Sources\nb", "")


REVIEW = """{
  "verdict": "fixable",
  "unverified_claims": ["no source for the date", "second"], "dangling_citations": ["[source: doc v9 #1]"], "placeholder_claims": [],
  "duplicate_segments": ["twice"], "incomplete_sentences": ["and then..."], "unintended_placeholders": ["{{name}}"], "contradictions": ["ادعاء"],
  "wrong_names": ["Sam"], "unsupported_facts": ["1440"], "unprofessional_phrasing": ["hey"],
  "suggested_corrections": "name the source", "summary_ar": "ملخص"
}"""


@pytest.mark.parametrize("fence", ["{}", "```json\n{}\n```", "```\n{}```", "  {}  "])
def test_real_reviews(spark, fence):
    from quarrymill.operators import review as H

    df = spark.createDataFrame([(1, fence.format(REVIEW))], "draft_id long, t string").select("draft_id", T.parse_review(F.col("t")).alias("r")).select("draft_id", "r.*")
    got = df.first()
    assert (got.verdict, got.suggested_corrections, got.summary_ar) == ("fixable", "name the source", "ملخص")
    assert got.unverified_claims == ["no source for the date", "second"] and got.placeholder_claims == [] and got.unprofessional_phrasing == ["hey"]
    found = H.all_findings(df).first().findings
    assert found == ["no source for the date", "second", "[source: doc v9 #1]", "twice", "and then...", "{{name}}", "ادعاء", "Sam", "1440", "hey"]
    assert {r.kind: r.n for r in H.findings_by_kind(df).collect()} == {f: 2 if f == "unverified_claims" else 1 for f in T.FINDINGS if f != "placeholder_claims"}
    status = H.final_status(F.lit("fixable"), F.lit("corrected"), F.lit("ok"), F.size(F.lit(found)))
    assert df.select(status.alias("s")).first().s == "needs_review"


def test_answers(spark):
    bad = one(spark, T.parse_review(F.col("t")), t="{broken")
    assert bad.verdict == "unverifiable" and all(bad[f] == [] for f in T.FINDINGS) and bad.summary_ar == ""
    assert one(spark, T.parse_review(F.col("t")), t='{"wrong_names": ["a"]}').verdict == "unverifiable"
    assert one(spark, T.parse_draft_json(F.col("t")), t="no json") is None
    for value, text in {
        '[{"type":"text","text":"a"},{"content":"b"}]': "a\nb", '["a","b"]': "a\nb", '["a",{"type":"text","text":"b"},{"type":"image","text":"no"},{"type":"x","content":"c"},{"content":5},{"text":7}]': "a\nb\nc\n7",
        '"plain"': "plain", "null": "", None: "", "[]": "", "5": "5",
    }.items():
        assert one(spark, T.coerce_content(F.col("t")), t=value) == text


def test_progress(spark):
    old = F.struct(F.lit(9).alias("total_chunks"), F.lit(4).alias("processed_chunks"), F.lit(None).cast("int").alias("failed_chunks"), F.lit(1).alias("current_batch"), F.lit(2).alias("retry_count"), F.lit("before").alias("last_error"), F.lit("t0").alias("started_at"))
    new = F.struct(*[F.lit(v).cast("int").alias(k) for k, v in (("total_chunks", None), ("processed_chunks", 6), ("failed_chunks", None), ("current_batch", 2))], F.lit(None).cast("string").alias("started_at"))
    row = lambda error: tuple(spark.range(1).select(T.merge_progress(old, new, F.lit(error).cast("string"), F.lit("t1")).alias("p")).first().p)
    assert row(None) == (9, 6, 0, 2, 2, "before", "t0", "t1")
    assert row("x" * 600) == (9, 6, 0, 2, 3, "x" * 500, "t0", "t1")
    assert row("") == (9, 6, 0, 2, 2, "", "t0", "t1")


def test_intent(spark):
    catalogue = spark.createDataFrame([("a", 1, "A", ["طلب", "x.y"], []), ("b", 2, "B", ["دعم"], []), ("general", 3, "G", [], [])], "type string, ord int, label string, keywords array<string>, fields array<string>")
    rows = spark.createDataFrame([(1, "هذا طلب، دعم"), (2, "x.y: طلب"), (3, "xzy"), (4, None)], "request_id long, text string")
    got = {r.request_id: (r.type, r.confidence) for r in N.detect_intent(rows, catalogue).collect()}
    assert got == {1: ("b", 0.6), 2: ("a", 0.7), 3: ("general", 0.0), 4: ("general", 0.0)}


def test_embedding_rules():
    embed = E.hashing_embedder(8)
    assert E.embed_texts(["a b", "c"] * 30, embed, 8, 20)[0] == embed(["a b"])[0]

    def fussy(texts):
        if any(len(t) > 4000 for t in texts):
            raise RuntimeError("too long")
        return embed(texts)

    assert E.embed_texts(["x " * 3000, "b"], fussy, 8)[0] == [0.0] * 8
    for bad in (lambda t: embed(t)[:-1], lambda t: [v[:-1] for v in embed(t)]):
        with pytest.raises(ValueError):
            E.embed_texts(["a", "b"], bad, 8)
    with pytest.raises(ValueError):
        E.embed_texts([" "], embed, 8)


def docx(paragraphs, header=None):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        table = f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr><w:tr><w:tc>{p('')}</w:tc></w:tr></w:tbl>"
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p(paragraphs[0])}{table}{p(paragraphs[1])}</w:body></w:document>")
        if header:
            z.writestr("word/header1.xml", f"<w:hdr {w}>{p(header)}</w:hdr>")
            z.writestr("word/header2.xml", f"<w:hdr {w}>{p(header)}</w:hdr>")
    return out.getvalue()


def test_files(spark, tmp_path):
    from quarrymill.sources import files as S

    (tmp_path / "policies").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "policies/a b.MD").write_text("نص عربي", "utf-8")
    (tmp_path / "bad.txt").write_bytes(b"ok \xff end")
    (tmp_path / "blank.txt").write_text(" \n")
    (tmp_path / "x.docx").write_bytes(docx(["first", "second"], "top"))
    (tmp_path / "fake.docx").write_bytes(b"no zip")
    (tmp_path / "old.doc").write_bytes(b"x")
    (tmp_path / "scan.pdf").write_bytes(b"%PDF")
    (tmp_path / "image.png").write_bytes(b"x")
    (tmp_path / ".git/c.txt").write_text("hidden")
    found = S.read_corpus(spark, str(tmp_path))
    got = {r.rel_path: r for r in S.extract_text(found, {".pdf": lambda b: "short"}).collect()}
    assert {k: r.status for k, r in got.items()} == {
        "policies/a b.MD": "ok", "bad.txt": "ok", "blank.txt": "empty", "x.docx": "ok", "fake.docx": "needs_doc_conversion", "old.doc": "needs_doc_conversion", "scan.pdf": "needs_ocr"
    }
    assert got["bad.txt"].text == "ok � end"
    assert got["x.docx"].text == "[HEADER] top\n\nfirst\n\na | b\n\nsecond"

    index = spark.createDataFrame([(1, "templates"), (2, "other")], "document_id long, category string")
    S.write_index(index, str(tmp_path / "index"))
    S.write_index(spark.createDataFrame([(3, "other")], "document_id long, category string"), str(tmp_path / "index"))
    assert sorted((r.document_id, r.category) for r in S.read_index(spark, str(tmp_path / "index")).collect()) == [(1, "templates"), (3, "other")]
    S.write_status_report(spark.createDataFrame([(1, "t", "other", "failed", "e")], "document_id long, title string, category string, status string, error_message string"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/files")).first().error_message == "e"
    assert spark.read.text(str(tmp_path / "report/summary")).count() == 4


def test_streams(spark, tmp_path):
    import json

    from quarrymill.streaming import events as S

    record = lambda n, bucket="policies", **more: {"id": n, "bucket_id": bucket, "name": n, **more}
    kept = [record("1/v1/a.txt", metadata={"size": 5, "mimetype": "text/plain"}), record("1/v1/a.txt", metadata={"size": 5, "mimetype": "text/plain"}), record("2/V2/b/c.tar.gz"), record("1/v3/new.txt", "regulations", metadata={})]
    events = [{"type": "INSERT", "table": "objects", "record": r} for r in [*kept, record("bad"), record("3/x/a.txt"), record("8/v1/a.txt", "none")]]
    events += [{"type": "UPDATE", "table": "objects", "record": record("9/v1/a.txt")}, {"type": "INSERT", "table": "buckets", "record": record("9/v1/a.txt")}]
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    write = lambda name, some: (inbox / name).write_text("\n".join(map(json.dumps, some)))
    write("1.json", events[:2] + events[4:])
    run = lambda: S.run_storage_events(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "ck"), "2024-01-31 00:00:00")
    run()
    write("2.json", events)  # the same events again, and more
    run()
    run()
    stored = lambda name: {tuple(r[k] for k in S.KEYS[name]): r for r in S.stored_rows(spark, str(tmp_path / "out"), name).collect()}
    files = stored("files")
    assert {k: (r.storage_bucket, r.storage_path, r.mime_type, r.size_bytes, r.original_filename, r.status) for k, r in files.items()} == {
        ("1", 1): ("policies", "1/v1/a.txt", "text/plain", 5, "a.txt", "pending"), ("2", 2): ("policies", "2/V2/b/c.tar.gz", None, None, "b/c.tar.gz", "pending"), ("1", 3): ("regulations", "1/v3/new.txt", None, None, "new.txt", "pending")
    }
    p = files["1", 1].processing_progress
    assert list(p.asDict()) == T.PROGRESS and (p.total_chunks, p.retry_count, p.last_error, p.started_at) == (0, 0, None, None) and str(p.updated_at) == "2024-01-31 00:00:00"
    assert {k: (r.title, r.category, r.bucket, r.is_active, r.content, r.source_uri) for k, r in stored("documents").items()} == {
        ("1",): ("new", "national_regulations", "regulations", True, "", "storage://regulations/1/v3/new.txt"), ("2",): ("b/c.tar", "internal_policies", "policies", True, "", "storage://policies/2/V2/b/c.tar.gz")
    }
    assert {k: (r.status, r.priority) for k, r in stored("jobs").items()} == {(r.file_id,): ("pending", 100) for r in files.values()}
    skips = S.parsed_events(spark.read.schema(S.EVENT).json(str(inbox / "2.json"))).groupBy("skip").count().collect()
    assert {r.skip: r["count"] for r in skips} == {None: 4, "bad path": 1, "bad version segment": 1, "unknown bucket": 1, "not an insert": 1, "other table": 1}

    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text(words(50))
    go = lambda: S.ingest_stream(spark, str(docs), str(tmp_path / "chunks"), str(tmp_path / "ck2"), E.hashing_embedder(8), 8, target=20, hard_max=25, overlap=0)
    go()
    go()
    (docs / "b.txt").write_text(words(10))
    go()
    got = S.stored_chunks(spark, str(tmp_path / "chunks"))
    assert got.count() == 4 and got.select("file_id", "chunk_index").distinct().count() == 4


def test_d1_embeds_whole_texts(spark, tmp_path):
    from quarrymill.plans import queries

    texts = [words(1000), words(30), "", words(300) + "\n" + words(20)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in enumerate(texts):
        for k, (c, _) in enumerate(K.Words([b for b in t.split("\n") if b]).chunks(K.Limits(200, 256, 0))):
            x = [0] * 64
            for w in c.lower().split():
                h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
                x[h // 2 % 64] += 1 if h % 2 else -1
            want.append((i, k, "".join("+" if v > 0 else "-" if v < 0 else "0" for v in x)))
    assert len(want) > 7 and sorted(map(tuple, queries.d1(spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize("ids", ["long", "string"])
def test_matches_in_blocks_equal_expressions(spark, ids):
    rng = random.Random(3)
    vector = lambda: [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(6)]  # noqa: E731  ties abound
    rows = [(i, vector(), rng.choice("ab")) for i in range(400)]
    chunks = spark.createDataFrame([*rows, (900, [0.0] * 6, "a"), (901, None, "b")], "chunk_id long, embedding array<float>, category string").withColumn("chunk_id", F.format_string("%04d", "chunk_id") if ids == "string" else F.col("chunk_id"))
    queries = spark.createDataFrame([(i, vector()) for i in range(60)], "request_id long, embedding array<float>").withColumn("request_id", F.col("request_id").cast(ids))
    spec = [("a", 3, 0.2), ("b", 5, 0.1), ("c", 2, 0.0)]
    want = R.match_batch_expression(queries, chunks, spark.createDataFrame(spec, "category string, k int, threshold double"), 6)
    key = lambda df: sorted((r.request_id, r.category, r["rank"], r.chunk_id, round(r.similarity, 9)) for r in df.collect())
    for block in (R.BLOCK_BYTES, 800):  # beside the chunks, and in blocks of 16 vectors
        got = R.match_batch(queries, chunks.repartition(5), spec, 6, block)
        assert key(got) == key(want) and got.schema["chunk_id"].dataType.simpleString() == chunks.schema["chunk_id"].dataType.simpleString()
    every = R.match_batch(queries, chunks, [(None, 4, -1.0)], 6, 800)
    assert every.groupBy("request_id").count().where("count = 4").count() == every.select("request_id").distinct().count()
    assert R.match_batch(queries.limit(0), chunks, spec, 6).count() == 0


def test_backfill_of_text_ids(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "document_id string")
    files = spark.createDataFrame([("x", "a", 1, "indexed")], "file_id string, document_id string, version int, status string")
    assert sorted(map(tuple, C.backfill_files(docs, files).collect())) == [("b-v1", "b", 1, "pending"), ("x", "a", 1, "indexed")]


def test_too_many_styles_are_an_error(spark):
    many = spark.range(1001).select(F.col("id").cast("string").alias("type"), F.create_map(F.lit("a"), F.lit("b")).alias("style"))
    with pytest.raises(ValueError):
        N.resolve_style(spark.createDataFrame([(1, "x", None)], "request_id long, type string, overrides map<string,string>"), many)
