"""Upserts, versions, evidence, events and ingest: null, repeated and missing keys, any cut into batches, broken runs."""

import itertools
import json
import os
import random
import re
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quarrymill.operators import catalog as C
from quarrymill.operators import chunking as K
from quarrymill.operators import embedding as E
from quarrymill.operators import intent as N
from quarrymill.operators import retrieval as R
from quarrymill.operators import review as H
from quarrymill.operators.resume import ingest_resumable
from quarrymill.sources import files as A
from quarrymill.sources import shared
from quarrymill.sources.parts import PartedTable, hashed, ranged
from quarrymill.streaming import events as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])
NOW = "2024-01-31 00:00:00"
DOC = "document_id long, source_uri string, title string"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_upsert_with_null_and_repeated_keys(spark):
    target = spark.createDataFrame([(1, None, "a"), (2, "u2", "b"), (3, "u3", None), (4, None, "d")], DOC)
    batch = spark.createDataFrame([(7, None, "n", 1), (8, None, "n", 1), (9, "u2", "first", 1), (10, "u2", "last", 2), (11, "new", "x", 5), (12, "new", "y", 4), (13, "u3", None, 1)], DOC + ", n int")
    got = rows(C.upsert_documents(target, batch, order=("n",)), "document_id", "source_uri", "title", "action")
    assert got == sorted([(1, None, "a", "kept"), (4, None, "d", "kept"), (2, "u2", "last", "updated"), (3, "u3", None, "updated"), (7, None, "n", "inserted"), (8, None, "n", "inserted"), (11, "new", "x", "inserted")], key=repr)
    assert rows(C.upsert_documents(target, batch.limit(0)), "document_id", "action") == [(k, "kept") for k in (1, 2, 3, 4)]
    assert rows(C.upsert_documents(target.limit(0), batch.where("source_uri is null")), "document_id", "action") == [(7, "inserted"), (8, "inserted")]


def test_next_version_with_null_ids_and_shared_titles(spark):
    documents = spark.createDataFrame([(1, 4, "alpha"), (2, 9, "ALPHA"), (3, 1, None)], "document_id long, current_version int, title string")
    files = spark.createDataFrame([(1, 5)], "document_id long, version int")
    up = spark.createDataFrame([(10, None), (11, None), (12, 1), (13, 1), (14, 99)], "upload_id long, document_id long")
    got = rows(C.next_version(up, documents, files), "upload_id", "version", "is_new", "conflict")
    assert got == [(10, 1, True, False), (11, 1, True, False), (12, 5, False, True), (13, 6, False, False), (14, 1, True, False)]
    titles = spark.createDataFrame([(20, "Alpha"), (21, "alphA"), (22, "beta"), (23, None), (24, None)], "upload_id long, title string")
    got = rows(C.next_version(titles, documents, files, by_title=True), "upload_id", "existing_document_id", "version")
    assert got == [(20, 1, 5), (21, 1, 6), (22, None, 1), (23, None, 1), (24, None, 1)]


def test_dedupe_content_of_a_hash_that_most_documents_share(spark, monkeypatch):
    monkeypatch.setattr(shared, "LEAST", 5)
    some = [(i, None if i % 10 == 0 else "hot" if i % 3 else f"h{i % 40}", i * 37 % 100) for i in range(600)]
    docs = spark.createDataFrame(some, "document_id long, content_hash string, updated_at int")
    first = {}
    for i, h, at in some:
        if h is not None:
            first[h] = min(first.get(h, (at, i)), (at, i))
    want = sorted((i, first[h][1] if h else i, bool(h) and first[h][1] != i) for i, h, _ in some)
    assert rows(C.dedupe_content(docs), "document_id", "keeper", "is_duplicate") == sorted(want, key=repr)
    assert C.dedupe_content(docs.limit(0)).count() == 0


def test_hot_values_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(shared, "LEAST", 50)
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    sizes = left.groupBy("k").agg(F.count("*").alias("n"))
    hot = shared.hot_values(sizes, "k")
    assert hot == [("hot", 20)]
    right = sizes.select("k", F.lit(1).alias("v")).where("k <> '1'")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for k, v in zip(before, ("-1", "false", "16"), strict=True):
        spark.conf.set(k, v)
    try:
        out = shared.dealt_left_join(left, right, "k", "id", hot)
        assert out.count() == 3000 and out.where("v is null").count() == 1
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 600  # a third of all rows under one key would be 1,000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_requests_without_hits_are_answered(spark):
    hit = "request_id long, section string, rank int, chunk_id long, document_id long, file_id long, version int, chunk_index int, title string, category string, similarity double, content string"
    hits = spark.createDataFrame([(1, "templates", 1, 5, 2, 21, 1, 0, "T", "templates", 0.9, " x "), (2, "internal_policies", 1, 6, 3, 31, 1, 1, None, "internal_policies", 0.5, "y")], hit)
    requests = spark.createDataFrame([(1,), (2,), (3,), (3,)], "request_id long")
    got = {r.request_id: r for r in R.grouped_context(hits, R.SECTIONS, requests).collect()}
    assert [(k, got[k].total, got[k].is_empty, got[k].templates) for k in sorted(got)] == [(1, 1, False, [5]), (2, 1, False, []), (3, 0, True, [])]
    evidence = R.build_evidence(hits, [(s, 3) for s in R.SECTIONS])
    bundles = {r.request_id: (r.best_template, r.has_template, r.templates, r.internal_policies) for r in R.evidence_bundles(evidence, requests).collect()}
    assert bundles == {1: (5, True, 1, 0), 2: (None, False, 0, 1), 3: (None, False, 0, 0)}
    texts = dict(rows(R.render_evidence(evidence, requests=requests), "request_id", "text"))
    assert texts[3] == "## Templates\n\n_No template was found._" and texts[2].startswith(texts[3]) and "### T v1 #0  (similarity=0.900)\nx" in texts[1]
    assert dict(rows(R.render_evidence(evidence, drop_templates=True, requests=requests), "request_id", "text"))[3] == ""
    assert {r.request_id: len(r.chunks_used) for r in R.provenance(evidence, requests).collect()} == {1: 1, 2: 1, 3: 0}
    assert R.grouped_context(hits.limit(0), R.SECTIONS, requests).where("is_empty").count() == 3


def event(name, at=None, bucket="policies"):
    return json.dumps({"type": "INSERT", "table": "objects", "record": {"id": name, "bucket_id": bucket, "name": name} | ({"updated_at": at} if at else {})})


def replay(spark, path, cuts):
    os.makedirs(path / "inbox")
    for k, cut in enumerate(cuts):
        (path / "inbox" / f"{k}.json").write_text("\n".join(cut))
        S.run_storage_events(spark, str(path / "inbox"), str(path / "out"), str(path / "ck"), NOW)
    read = lambda: [rows(S.stored_rows(spark, str(path / "out"), t), *c) for t, c in (("documents", ("document_id", "title", "source_uri")), ("files", ("file_id", "storage_path", "storage_bucket")), ("jobs", ("file_id", "priority")))]
    got = read()
    S.run_storage_events(spark, str(path / "inbox"), str(path / "out"), str(path / "ck-new"), NOW)  # everything again, without the old checkpoint
    assert read() == got
    for table in S.KEYS:
        S.compact_rows(spark, str(path / "out"), table, str(path / "folded"))
    assert rows(S.stored_rows(spark, str(path / "folded"), "documents"), "document_id", "title", "source_uri") == got[0]
    return got


def test_events_give_the_same_tables_however_they_are_cut(spark, tmp_path):
    e = [event("7/v2/new.txt"), event("7/v1/old.txt"), event("8/v1/a.txt", "2024-01-02T00:00:00"), event("8/v1/b.txt", "2024-01-01T00:00:00"), event("9/v3/x.txt", "2024-01-05T00:00:00"), event("9/v4/y.txt", "2024-01-04T00:00:00")]
    cuts = [[e], [e[:1], e[1:]], [e[1:3], e[3:], e[:1]], [e[::-1][:4], e[::-1][4:]]]
    got = [replay(spark, tmp_path / str(k), cut) for k, cut in enumerate(cuts)]
    assert all(g == got[0] for g in got)
    assert got[0][0] == [("7", "new", "storage://policies/7/v2/new.txt"), ("8", "a", "storage://policies/8/v1/a.txt"), ("9", "x", "storage://policies/9/v3/x.txt")]
    assert len(got[0][1]) == len(got[0][2]) == 5


def test_events_without_times_merge_in_any_order(spark):
    e = [event("7/v2/b.txt"), event("7/v2/a.txt"), event("7/v2/b.txt", bucket="examples"), event("7/v1/z.txt")]
    want = None
    for order in itertools.islice(itertools.permutations(e), 0, 24, 5):
        parts = [S.storage_rows(spark.read.schema(S.EVENT).json(spark.sparkContext.parallelize(list(some))), NOW)["documents"] for some in (order[:1], order[1:])]
        got = rows(S._merged(parts[0].unionByName(parts[1]), "documents"), "document_id", "title", "bucket")
        want = want or got
        assert got == want == [("7", "b", "policies")]


def words(n, seed=0):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randint(0, 99)}" for _ in range(n))


@pytest.fixture
def corpus(spark, tmp_path):
    docs = tmp_path / "docs"
    (docs / "in/ner").mkdir(parents=True)
    (docs / "a.txt").write_text(words(50))
    (docs / "in/ner/b.md").write_text(words(30, 1))
    (docs / "empty.txt").write_text(" ")
    (docs / "skip.png").write_bytes(b"\x89PNG")

    def go(checkpoint="ck", embed=E.hashing_embedder(8)):
        S.ingest_stream(spark, str(docs), str(tmp_path / "out"), str(tmp_path / checkpoint), embed, 8, target=20, hard_max=25, overlap=0)
        got = S.stored_chunks(spark, str(tmp_path / "out"))
        assert got.count() == got.select("file_id", "chunk_index").distinct().count()
        return " ".join(r.content for r in got.orderBy("file_id", "chunk_index").collect()).split()

    return docs, go


def test_ingest_by_content(spark, tmp_path, corpus):
    docs, go = corpus
    first = go()
    assert sorted(first) == sorted((words(50) + " " + words(30, 1)).split())
    assert go() == first and go("another") == first  # nothing new; a new checkpoint
    (docs / "a.txt").write_text(words(20, 7))  # fewer chunks than before
    assert sorted(go("another")) == sorted((words(20, 7) + " " + words(30, 1)).split())
    os.utime(docs / "a.txt", (1, 1))  # touched, not changed
    before = spark.read.parquet(str(tmp_path / "out/files")).select(F.max("modified")).first()
    assert sorted(go("another")) == sorted((words(20, 7) + " " + words(30, 1)).split()) and before
    (docs / "a.txt").write_text("  ")  # no text any more
    (docs / "c.txt").write_text(words(5, 3))
    assert sorted(go("another")) == sorted((words(5, 3) + " " + words(30, 1)).split())


def test_ingest_after_a_broken_run(spark, tmp_path, corpus, monkeypatch):
    docs, go = corpus
    go()
    (docs / "a.txt").write_text(words(60, 8))
    whole, calls = S._rewrite, []

    def breaks(spark_, path, *rest):
        calls.append(path)
        if path.endswith("/files"):
            raise RuntimeError("lost")
        whole(spark_, path, *rest)

    monkeypatch.setattr(S, "_rewrite", breaks)
    with pytest.raises(RuntimeError, match="lost"):
        go()
    monkeypatch.setattr(S, "_rewrite", whole)
    assert [os.path.basename(c) for c in calls] == ["chunks", "files"]
    assert sorted(go()) == sorted((words(60, 8) + " " + words(30, 1)).split())


def test_files_of_other_kinds_are_not_opened(spark, tmp_path):
    for name in ("a.TXT", "b.Md", "deep/er/c.docx", ".hidden/d.txt", "__pycache__/e.txt", "f.png", "letter.txt.bak", "Letter x.pdf", "odd[1].txt"):
        path = tmp_path / "docs" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    (tmp_path / "docs/empty").mkdir()
    names = lambda **k: sorted(r.rel_path for r in A.read_corpus(spark, str(tmp_path / "docs"), **k).collect())
    assert names() == ["Letter x.pdf", "a.TXT", "b.Md", "deep/er/c.docx", "odd[1].txt"]
    assert names(name_contains="etter") == ["Letter x.pdf"] and names(name_contains="[1]") == ["odd[1].txt"] and names(name_contains=".T") == ["a.TXT"]
    assert names(name_contains="d") == ["Letter x.pdf", "b.Md", "deep/er/c.docx", "odd[1].txt"]
    listed = A.listed_files(spark.read, str(tmp_path / "docs")).select("path")
    assert listed.count() == 5  # what the source itself gives


def test_drafts_by_template(spark):
    drafts = spark.createDataFrame([(1, 5, "ok", 1, 7, 2), (2, 5, "ok", 3, 7, 2), (3, 6, "fixable", 2, 7, 1), (4, 6, "ok", 9, None, None)], "draft_id long, user_id long, final_status string, generated_at int, template_document_id long, template_version int")
    assert [r.draft_id for r in H.drafts_listing(drafts, template=(7, 2)).collect()] == [2, 1]
    assert rows(H.drafts_listing(drafts, by_template=True), "draft_id", "rank") == [(1, 2), (2, 1), (3, 1)]
    assert [r.draft_id for r in H.drafts_listing(drafts, user=6, final_status="ok").collect()] == [4]


def test_a_catalogue_of_many_keywords(spark):
    """Hits equal a search for each keyword by a pattern; the plan doesn't grow with the catalogue."""
    rng = random.Random(11)
    bits = ["طلب", "a", "a b", "a.b", "b", "x*y", "c", "ab", "(", "b c a", "."]
    words = [*bits, *(" ".join(rng.choice(bits) for _ in range(rng.randint(1, 3))) for _ in range(120))]
    types = [(f"t{k}", k, f"L{k}", [rng.choice(words) for _ in range(rng.randint(0, 30))] + ["", "a"][: k % 3], []) for k in range(12)] + [("general", 99, "G", ["a"], []), ("none", 100, None, None, [])]
    schema = "type string, ord int, label string, keywords array<string>, fields array<string>"
    texts = ["".join(rng.choice([*bits, " ", " ", "،", ",", ".", ";", "\u00a0", "\n"]) for _ in range(rng.randint(0, 25))) for _ in range(150)] + [None, ""]
    rows_ = spark.createDataFrame(list(enumerate(texts)), "request_id long, text string")
    catalogue = spark.createDataFrame(types, schema)
    whole = lambda w, t: re.search(r"(?:^|[\s،,:;])" + re.escape(w) + r"(?:$|[\s،,:;.])", t or "")
    want = sorted((i, name, tuple(w for w in keywords or [] if w and whole(w, t))) for i, t in enumerate(texts) for name, _, _, keywords, _ in types)
    for block in (200_000, 7):
        got = sorted((r.request_id, r.type, tuple(r.hits)) for r in N.keyword_hits(rows_, catalogue, block).collect())
        assert got == [w for w in want if w[2]]
        best = {r.request_id: r.type for r in N.detect_intent(rows_, catalogue, block).collect()}
        for i in range(len(texts)):
            scores = [(len(h), next(o for n, o, *_ in types if n == name), name) for k, name, h in want if k == i and h and name != "general"]
            assert best[i] == (max(scores)[2] if scores else "general")
    many = spark.createDataFrame([("big", 1, "B", [f"word{k}" for k in range(100_000)], [])], schema)
    plan = lambda c: len(N.detect_intent(rows_, c)._jdf.queryExecution().toString())
    assert plan(many) < 1.2 * plan(catalogue)
    got = N.keyword_hits(spark.createDataFrame([(1, "see word99999, word7 wordx word12")], "request_id long, text string"), many).first()
    assert got.hits == ["word7", "word12", "word99999"]


def test_ingest_is_taken_up_where_it_broke_off(spark, tmp_path):
    sizes = {1: 53, 2: 7, 3: 0, 4: 25}
    rows_ = [(f, k, f"file {f} chunk {k}" if k != 3 else "x" * 5000) for f, n in sizes.items() for k in range(n)]
    chunks = spark.createDataFrame(rows_, "file_id long, chunk_index int, content string").repartition(3)
    documents = spark.createDataFrame([(f, 1, False, f"t{f}", "pending") for f in sizes], "document_id long, current_version int, is_active boolean, title string, status string")
    files = documents.select(F.col("document_id").alias("file_id"), "document_id", F.lit(2).alias("version"), F.col("title").alias("original_filename"), F.lit("examples").alias("storage_bucket"))
    log, breaks = tmp_path / "log", tmp_path / "breaks"
    log.mkdir()
    inner = E.hashing_embedder(8)

    def embed(texts):
        if os.path.exists(breaks) and any(t.startswith("file 4") for t in texts):
            raise RuntimeError("lost")
        if len(texts) == 1 and len(texts[0]) > 4000:
            raise ValueError("too long")
        with open(log / f"{os.getpid()}", "a") as out:
            out.writelines(t + "\n" for t in texts)
        return inner(texts)

    go = lambda **k: ingest_resumable(documents, files, chunks, str(tmp_path / "out"), embed, 8, budget=10, batch=4, **k)
    status = lambda got: {r.file_id: (r.saved_chunks, r.status) for r in got["progress"].collect()}
    assert status(go(rounds=1)) == {1: (10, "processing"), 2: (7, "indexed"), 4: (10, "processing")}
    breaks.touch()
    with pytest.raises(Exception, match="lost"):
        go()
    assert status(go(rounds=0)) == {1: (10, "processing"), 2: (7, "indexed"), 4: (10, "processing")}
    lost = {line for p in log.iterdir() for line in p.read_text().split("\n")[:-1]}
    breaks.unlink()
    for p in log.iterdir():
        p.unlink()
    got = go()
    assert status(got) == {1: (53, "indexed"), 2: (7, "indexed"), 4: (25, "indexed")}
    assert got["chunks"].count() == got["chunks"].select("file_id", "chunk_index").distinct().count() == 85
    assert {r.chunk_index for r in got["chunks"].where("failed").collect()} == {3}
    again = [line for p in log.iterdir() for line in p.read_text().split("\n")[:-1]]
    first = {f"file {f} chunk {k}" for f, n in sizes.items() for k in range(min(n, 10))}
    assert len(again) == len(set(again)) and not first & set(again) and set(again) | first == {f"file {f} chunk {k}" for f, n in sizes.items() for k in range(n)} | {f"file {f} chunk 3" for f in (1, 2, 4)} and lost <= set(again) | first
    assert {r.document_id: (r.current_version, r.is_active) for r in got["documents"].collect()} == {1: (2, True), 2: (2, True), 3: (1, False), 4: (2, True)}
    before = sorted(os.listdir(tmp_path / "out"))
    assert status(go()) == status(got) and sorted(os.listdir(tmp_path / "out")) == before


def test_blocks_go_on_through_arrow_batches(spark):
    sizes = []

    def batches():
        for a in range(0, 50, 3):
            yield pa.record_batch({"t": pa.array(["x" * 5000 if k % 10 == 9 else f"t{k}" for k in range(a, min(a + 3, 50))]), "k": pa.array(range(a, min(a + 3, 50)))})

    keys = []
    for part in E.whole_blocks(batches(), "t", 20):
        sizes.append(sum(len(t) < 4000 for t in part.column("t").to_pylist()))
        keys += part.column("k").to_pylist()
    assert keys == list(range(50)) and sizes == [20, 20, 5]
    assert list(E.whole_blocks(iter([]), "t", 20)) == []


def test_a_large_word_file_is_read_piece_by_piece():
    import io
    import tracemalloc
    import zipfile

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    padding = "<w:rPr>" + "<w:b/>" * 200 + "</w:rPr>"
    one = f"<w:p><w:r>{padding}<w:t>word</w:t></w:r></w:p>"
    row = f"<w:tr><w:tc>{one}</w:tc><w:tc>{one}</w:tc></w:tr>"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>' + one * 3000 + "<w:tbl>" + row * 2000 + "<w:tr><w:tc/></w:tr></w:tbl>" + one + "</w:body></w:document>")
        z.writestr("word/header1.xml", f'<w:hdr xmlns:w="{w}">{one}</w:hdr>')
    data = buffer.getvalue()
    tracemalloc.start()
    text = A.docx_text(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert text.split("\n\n") == ["[HEADER] word", *["word"] * 3000, "\n".join(["word | word"] * 2000), "word"]
    assert peak < 8 << 20  # the tree of all of it takes over a hundred


def merging(text):
    """Two letters a token, one less where a word that ends in a comes before one that starts with b: tokens reach across words."""
    w = text.split()
    return sum(-(-len(x) // 2) for x in w) - sum(x[-1] == "a" and y[0] == "b" for x, y in zip(w, w[1:]))


def plain_chunks(blocks, measure, target, hard_max, overlap):
    """Chunking as it is described, word by word and text by text."""

    def cut(text, most):
        out, held = [], []
        for w in text.split(" "):
            if held and measure(" ".join([*held, w]).strip()) > most:
                out.append(" ".join(held).strip())
                held = []
            held.append(w)
        return [p for p in [*out, " ".join(held).strip()] if p]

    chunks, held, n = [], [], 0
    for block in [*blocks, None]:
        size = measure(block) if block is not None else 0
        if block is not None and n + size <= target:
            held.append(block)
            n += size
            continue
        if held:
            chunks.append(" ".join(held).strip())
        held, n = ([block], size) if block is not None and size <= target else ([], 0)
        if block is not None and size > target:
            parts = cut(block, target)
            if chunks and overlap and measure(" ".join(chunks[-1].split(" ")[-60:]) + " " + parts[0]) <= hard_max:
                parts[0] = " ".join(chunks[-1].split(" ")[-60:]) + " " + parts[0]
            chunks += parts
    out = chunks[:1]
    for before, own in zip(chunks, chunks[1:]):
        tail = before.split(" ")[-80:] if overlap else []
        while tail and measure(" ".join([*tail, own])) > hard_max:
            tail.pop(0)
        out.append(" ".join([*tail, own]))
    return [(p, measure(p)) for c in out for p in (cut(c, hard_max) if measure(c) > hard_max else [c]) if p]


@pytest.mark.parametrize("measure", [merging, lambda t: -(-len(t) // 4), lambda t: len(t.split())])
def test_chunks_by_counters_that_reach_across_words(spark, measure):
    rng = random.Random(6)
    for _ in range(120):
        blocks = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, rng.choice([3, 3, 30])))) for _ in range(rng.randint(1, rng.choice([4, 60])))) for _ in range(rng.randint(0, 8))]
        for target, hard_max, overlap in ((20, 30, 0), (20, 30, 5), (8, 8, 3), (40, 200, 9)):
            assert K.Measured(blocks, measure).chunks(K.Limits(target, hard_max, overlap)) == plain_chunks(blocks, measure, target, hard_max, overlap)
    docs = spark.createDataFrame([(1, "\n\n".join(blocks or ["a b"])), (2, None), (3, "")], "document_id long, content string")
    got = K.chunk_documents(docs, headings=None, text_counter=measure, target=20, hard_max=30, overlap=5)
    assert [(r.content, r.n_tokens) for r in got.orderBy("document_id", "chunk_index").collect()] == plain_chunks(blocks or ["a b"], measure, 20, 30, 5)


def parts_of(table):
    """Each file of a table with the time of its last change."""
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, files in os.walk(table.path) for f in files if f.startswith("part-")}


def parted(spark, folder, rows, key="document_id", part=None):
    table = PartedTable(spark, str(folder), rows.schema, key, part or ranged(10))
    table.create(rows)
    return table


def test_a_small_batch_rewrites_a_small_part(spark, tmp_path):
    docs = spark.range(10_000).select(F.col("id").alias("document_id"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("source_uri"), F.lit("old").alias("title"))
    table = parted(spark, tmp_path / "t", docs, part=ranged(100))
    before = parts_of(table)
    batch = docs.where("document_id between 4200 and 4299").withColumn("title", F.lit("new"))
    assert C.upsert_into(table, batch, 1) == ["42"]
    after = parts_of(table)
    same = {f for f, t in before.items() if after.get(f) == t}
    assert {f for f in before if "/part=42/" not in f} == same and len(before) - len(same) <= 4
    assert table.rows().groupBy("title").count().orderBy("title").collect() == [("new", 100), ("old", 9900)]
    read = table._read().where(F.col("part").isin(["42"]))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*part#\d+ (=|IN)", read)


def test_changes_of_tables_in_parts_equal_those_of_whole_tables(spark, tmp_path):
    rnd = random.Random(5)
    uri = lambda: rnd.choice([None, *map("u{}".format, range(30))])
    target = spark.createDataFrame([(i, None if i % 9 == 0 else f"u{i}", "t") for i in range(25)], DOC)
    batches = [spark.createDataFrame([(100 * k + i, uri(), f"b{k}-{i}") for i in range(20)], DOC) for k in (1, 2)]
    table = parted(spark, tmp_path / "u", target, "source_uri", hashed(7))
    for number in (0, 1, 1):  # the last comes again
        C.upsert_into(table, batches[number], number + 1)
    want = target
    for b in batches:
        want = C.upsert_documents(want, b).drop("action")
    assert rows(table.rows(), *table.schema.names) == rows(want, *table.schema.names)

    chunk = "chunk_id long, file_id long, chunk_index int, document_id long"
    old = spark.createDataFrame([(i, i // 4, i % 4, i // 8) for i in range(200)] + [(900, None, 0, None)], chunk)
    new = spark.createDataFrame([(1000 + i, 40 + i // 5, i % 5, 20 + i // 10) for i in range(70)] + [(2000, 45, 0, 22), (3000, None, 0, None), (3000, None, 0, None)], chunk)
    for name, key, into, whole in (("r", "document_id", C.replace_chunks_in, C.replace_chunks), ("i", "file_id", C.insert_chunks_into, C.insert_chunks_idempotent)):
        table = parted(spark, tmp_path / name, old, key, ranged(3))
        for _ in range(2):
            into(table, new, 1)
        assert rows(table.rows(), *old.columns) == rows(whole(old, new).select(*old.columns), *old.columns)


def test_deleting_from_tables_in_parts(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"u{i}", "t") for i in range(40)] + [(50, None, "t")], DOC)
    files = spark.createDataFrame([(10 * i + v, i) for i in range(40) for v in (1, 2)] + [(7, None)], "file_id long, document_id long")
    chunks = files.select((F.col("file_id") * 2).alias("chunk_id"), "document_id")
    jobs = files.select("file_id", F.lit("pending").alias("status"))
    gone = spark.createDataFrame([(f"u{i}",) for i in range(20, 30)] + [("none",), (None,)], "source_uri string")
    tables = dict(documents=parted(spark, tmp_path / "d", docs, "source_uri", hashed(8)), files=parted(spark, tmp_path / "f", files), chunks=parted(spark, tmp_path / "c", chunks), jobs=parted(spark, tmp_path / "j", jobs, "file_id", ranged(100)))
    touched = C.delete_documents_from(gone, **tables)
    assert touched["chunks"] == ["2"] and touched["jobs"] == ["2"] and not (tmp_path / "c/part=2").exists()  # a part without rows goes
    for name, want in C.delete_documents(gone, docs, files, chunks, jobs).items():
        assert rows(tables[name].rows(), *want.columns) == rows(want, *want.columns)
    assert all(not t for t in C.delete_documents_from(gone, **tables).values())  # nothing left to do
    C.delete_documents_from(docs.select("document_id"), **tables)
    assert tables["files"].rows().collect() == [(7, None)] and tables["documents"].rows().count() == 0
    C.upsert_into(tables["documents"], docs, 1)  # an empty table takes rows again
    assert rows(tables["documents"].rows(), "document_id") == rows(docs, "document_id")


@pytest.mark.parametrize("step", ["rows", "in place", "parts"])
def test_a_change_that_breaks_off(spark, tmp_path, monkeypatch, step):
    """Broken off before or after it was written whole, or while it is put in place, a change is forgotten or carried through."""
    table = parted(spark, tmp_path / "t", spark.createDataFrame([(i, f"u{i}", "old") for i in range(30)], DOC))
    batch = spark.createDataFrame([(i, f"u{i}", "new") for i in range(5, 15)], DOC)

    def write(self, rows, path, *how):
        raise RuntimeError("lost")

    def apply(self):
        if step == "parts":
            self._at(f"{self._staged()}/rows").where("part = '0'").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        if step == "rows":
            m.setattr(PartedTable, "_write", write)
        else:
            m.setattr(PartedTable, "_apply", apply)
        with pytest.raises(RuntimeError, match="lost"):
            C.upsert_into(table, batch, 1)
    table.recover()
    new = [i for i in range(30) if 5 <= i < 15] if step in ("in place", "parts") else []
    assert rows(table.rows().where("title = 'new'"), "document_id") == [(i,) for i in sorted(new, key=lambda i: repr((i,)))]
    C.upsert_into(table, batch, 1)
    assert rows(table.rows(), *table.schema.names) == sorted([(i, f"u{i}", "new" if 5 <= i < 15 else "old") for i in range(30)], key=repr)
    assert not os.path.exists(table._staged())
