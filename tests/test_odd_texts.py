"""Queries over documents of odd texts give the rows of their SQL."""

import hashlib
import itertools
import random
import sys

import duckdb
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quarrymill import registry
from quarrymill.functions import text as T
from quarrymill.operators import chunking as K
from quarrymill.operators import embedding as E
from quarrymill.plans import queries as Q
from quarrymill.sources import files as A
from quarrymill.streaming import events as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rows_of(table):
    return sorted((tuple(r) for r in table), key=repr)


def differing(spark, folder, name, texts):
    """The rows that only the query gives and those that only its SQL gives, over documents of texts."""
    folder.mkdir(parents=True, exist_ok=True)
    table = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in found.description]
    want = rows_of(found.fetchall())
    got = rows_of([r[c] for c in columns] for r in registry.QUERIES[name](spark, str(folder)).collect())
    return [r for r in got if r not in want], [r for r in want if r not in got]


def test_a_chunk_whose_words_cancel_out_has_a_vector(spark, tmp_path):
    h = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
    some = [f"w{k}" for k in range(300)]
    a, b = next((x, y) for x, y in itertools.combinations(some, 2) if h(x) // 2 % 64 == h(y) // 2 % 64 and h(x) % 2 != h(y) % 2)
    assert differing(spark, tmp_path / "t", "i11_resumable_ingest", [f"{a} {b}", "plain words here", "", f"{a}\n{b}\n{a}"]) == ([], [])


@pytest.mark.parametrize("texts", [["", "  \n ", "　"], [None, "after"], ["a\tb\t", "\t\n\tc"], ["a\r\nb", "\r"], ["a\x01b\x00", "\x1f\x0c", "x￿y￾"], ["_x0041_ _x", "_x0041\x01", "__x0001_"], ["\xa0a\xa0\n b\x85", "<&>]]>", "x" * 100_000]])
def test_a_word_file_holds_any_text(spark, tmp_path, texts):
    assert differing(spark, tmp_path / "t", "a3_docx_text", texts) == ([], [])


def test_want_of_memory_is_no_status_of_a_file():
    def greedy(content):
        raise MemoryError

    with pytest.raises(MemoryError):
        A._load(".docx", Q.docx_file(1, "t", "f", ["a"]), {".docx": greedy})


def test_batches_are_cut_by_bytes():
    batch = pa.record_batch({"k": pa.array(range(6)), "t": pa.array(["aaaa", None, "bb", "c" * 20, "", "dddd"])})
    assert [b.column("k").to_pylist() for b in A.by_bytes(iter([batch]), "t", 6)] == [[0, 1, 2], [3], [4, 5]]
    assert [b.column("k").to_pylist() for b in A.by_bytes(iter([batch.slice(2)]), "t", 100)] == [[2, 3, 4, 5]]
    assert list(A.by_bytes(iter([batch.slice(0, 0)]), "t")) == []


WORDS = ["a", "bb", "Of", "#", "##", "1.", "(2)", "3 -", "and.", "end :", "　", "\x85", "wwwwww", "long" * 30]


def some_lines(rng, n):
    """Lines of a text, of which some are blank, some headings and some many words."""
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.35:
            out.append(rng.choice(["", " ", "\t", "　 ", "\x01"]))
        else:
            out.append(rng.choice(["", " ", "\t"]) + " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 5, 60]))) + rng.choice(["", " ", "\r", "\x0c"]))
    return out


def merging(text):
    """Two letters a token, one less where a word that ends in a comes before one that starts with b."""
    w = text.split()
    return sum(-(-len(x) // 2) for x in w) - sum(x[-1] == "a" and y[0] == "b" for x, y in zip(w, w[1:]))


@pytest.mark.parametrize("headings", [None, ["Of"]])
@pytest.mark.parametrize("counter", [{}, {"token_counter": lambda words: [len(w) // 3 for w in words]}, {"text_counter": merging}])
def test_chunks_of_lines_equal_those_of_whole_texts(spark, headings, counter):
    rng = random.Random(5)
    texts = {i: some_lines(rng, rng.choice([0, 1, 3, 40, 200])) for i in range(40)}
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in texts.items()], "document_id long, content string")
    lines = spark.createDataFrame([(i, n, line) for i, x in texts.items() for n, line in enumerate(x)], "document_id long, n int, line string").repartition(5, "line")
    for limits in ({"target": 20, "hard_max": 25, "overlap": 0}, {"target": 30, "hard_max": 45, "overlap": 10}, {"target": 70, "hard_max": 150}, {}):
        want = sorted(map(tuple, K.chunk_documents(docs, headings=headings, **counter, **limits).collect()))
        assert sorted(map(tuple, K.chunk_lines(lines, headings=headings, **counter, **limits).collect())) == want
        assert len(want) > 100 or not limits


def test_a_heading_of_a_text_is_one_of_a_column(spark):
    rng = random.Random(6)
    blocks = ["", "Of", "1", "#a", "# a", "####### a", "( 12 . x", "1234. x", "x" * 200, "1." + "x" * 200, "1." + "x" * 198, *(" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 30]))) for _ in range(300))]
    for chapters in (None, [], ["Of", "bb a"]):
        got = spark.createDataFrame([(b,) for b in blocks], "b string").select("b", T.is_heading(F.col("b"), chapters).alias("h")).collect()
        assert [r.h for r in got] == [T.heading_of(chapters)(r.b) for r in got]


def ingested(spark, docs, out, **options):
    S.ingest_stream(spark, str(docs), str(out), str(out) + "-ck", E.hashing_embedder(8), 8, target=20, hard_max=25, **options)
    rows = S.stored_chunks(spark, str(out)).select("file_id", "chunk_index", "content", "n_tokens", F.col("embedding").cast("string")).collect()
    return sorted(map(tuple, rows)), {r.rel_path: r.digest for r in spark.read.parquet(f"{out}/files").collect()}


def test_large_files_go_by_lines(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    docs = tmp_path / "docs"
    (docs / "in").mkdir(parents=True)
    names = ["a b.txt", "in/odd[1].md", "in/plus+{x}.TXT", "st*r,?.markdown"]
    for name in names:
        (docs / name).write_bytes("\n".join(some_lines(rng, 150)).encode() + rng.choice([b"", b"\n", b"\n \xff x"]))
    (docs / "small.txt").write_text("x")
    whole, digests = ingested(spark, docs, tmp_path / "whole")
    monkeypatch.setattr(S, "WHOLE", 100)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # a file is read in several parts
    try:
        lines, others = ingested(spark, docs, tmp_path / "lines")
        assert lines == whole and len(whole) > 50 and set(digests) == set(others) == {*names, "small.txt"}
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        again = ingested(spark, docs, tmp_path / "again")
        assert again == (lines, others)  # digests don't tell how a file was read
        (docs / names[0]).write_text("\n".join(some_lines(rng, 80)))
        changed, now = ingested(spark, docs, tmp_path / "lines")
        assert {n for n in now if now[n] != others[n]} == {names[0]}
        monkeypatch.setattr(S, "WHOLE", 1 << 20)
        assert changed == ingested(spark, docs, tmp_path / "last")[0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_row_holds_a_large_file(spark, tmp_path):
    """The source may give no file over 1 MB as a row, and none of the queries asks for one."""
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1 << 20)
    try:
        text = "\n".join(f"w{k % 97} " * 30 for k in range(30_000))
        assert differing(spark, tmp_path / "t", "k2_ingest_stream", [text[: 1 << 20], "b\nc", text, "", "d\r\n\r\ne", text[:2000]]) == ([], [])
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
