"""Collocations, periodic runs and personal data against brute force, with nulls, ties, repeats, empty and long texts and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import op11_phrases, op12_runs, op13_private

DOCS = "doc_id long, text string, lang string, row int, symbols string, spans string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, 7, "x", "y") for i, t, lang in rows], DOCS)


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


# collocations ----------------------------------------------------------------------------------------------------------------


def brute_collocations(rows, least=10, percent=50, most=2000):
    f, total = Counter(), Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    candidates = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    covered = set()
    for (lang, g), a in candidates.items():
        if len(g) == 3:
            covered |= {(lang, p) for p in (g[:2], g[1:]) if 100 * a >= percent * candidates[lang, p]}
    out = {}
    for (lang, g), a in candidates.items():
        if (lang, g) not in covered:
            cuts = [(1_000_000 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return sorted((lang, rank + 1, p.decode(), -a, l, r, total[lang], -s) for lang, found in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:most]))


def phrase_rows():
    rng = random.Random(3)
    fixed = ["new york city", "new york", "à la carte", "ice cream", "hot hot hot", "One Two three"]
    rows = []
    for i in range(300):
        words = [rng.choice(fixed) if rng.random() < 0.3 else f"w{int(rng.paretovariate(0.7)) % 60}{rng.choice(['', '', '.', ',', '!', chr(10)])}" for _ in range(rng.randint(0, 40))]
        rows.append((i, " ".join(words), rng.choice(["en", "en", "fr", None, "und", ""])))
    return rows + [(900, None, "en"), (901, "", None), (902, " \t ..;; \n", "fr"), (None, "ice cream " * 2000, "en"), (None, "ice cream " * 2000, "en"), (903, "x\x85y \x0bz q " * 30, "fr")]


@pytest.mark.parametrize("options", [{}, {"run": 500, "size": 300}])
def test_collocations_equal_brute_force(spark, options, monkeypatch):
    monkeypatch.setattr(op11_phrases, "MARK", 20)
    monkeypatch.setattr(op11_phrases, "STEP", 64 if options else 1 << 19)
    rows = phrase_rows()
    got = op11_phrases.collocations(docs(spark, rows).repartition(5), **options)
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows)


def test_collocations_of_few_and_of_none(spark):
    rows = phrase_rows()
    got = op11_phrases.collocations(docs(spark, rows), least=3, percent=90, most=7)
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, 3, 90, 7)
    assert op11_phrases.collocations(docs(spark, []).limit(0)).count() == 0
    assert op11_phrases.collocations(docs(spark, [(1, "never twice", "en")])).count() == 0


def test_scores_are_exact_beyond_64_bits():
    symbols = pa.array([b"en\xffa", b"en\xffb"], pa.large_binary())
    column = lambda *x: np.array(x, np.int64)
    big = 5_000_000_000_000
    grams = op11_phrases.Grams(symbols, [column(1, 1, 2), column(0, 2, 0), column(0, 0, 0)], column(big + 7, big, big + 1))
    automaton = op11_phrases.Automaton.load(op11_phrases.Automaton.build(grams).dump())
    back = automaton.grams()
    assert back.weight.tolist() == [big + 7, big, big + 1]
    assert automaton.follow(pa.array([b"en\xffb", b"en\xffz"], pa.large_binary()), [column(1, 2), column(0, 0), column(0, 0)]).tolist() == [big + 1, 0]


def test_automata_share_states_and_unite():
    rng = np.random.default_rng(4)
    symbols = pa.array([f"en\xff{k:02d}".encode("latin-1") for k in range(12)], pa.large_binary())

    def some(n):
        rows = sorted({(a, b, c if b else 0) for a, b, c in zip(rng.integers(1, 13, n).tolist(), rng.integers(0, 13, n).tolist(), rng.integers(0, 13, n).tolist(), strict=True)})
        return op11_phrases.Grams(symbols, [np.array(c, np.int64) for c in zip(*rows, strict=True)], rng.integers(1, 3, len(rows)))

    def as_dict(g):
        names = [None, *g.symbols.to_pylist()]
        return Counter({tuple(names[k] for k in row): w for *row, w in zip(*(c.tolist() for c in g.columns), g.weight.tolist(), strict=True)})

    parts = [some(n) for n in (1, 5, 300, 300)]
    for p in parts:
        built = op11_phrases.Automaton.build(p)
        assert as_dict(op11_phrases.Automaton.load(built.dump()).grams()) == as_dict(p)
        assert len(built.levels[2][0]) <= len(p)
    cuts = [[b"en\xff03", b"", b""], [b"en\xff05", b"en\xff07", b""], [b"en\xff055", b"", b""], [b"en\xff09", b"en\xff01", b"en\xff02"]]
    pieces = [x for p in parts for _, x in p.cut(cuts)]
    assert as_dict(op11_phrases.united(pieces)) == sum(map(as_dict, parts), Counter())
    for p in parts:
        for k, x in p.cut(cuts):
            for gram in as_dict(x):
                key = [w or b"" for w in gram]
                assert (k == 0 or key >= cuts[k - 1]) and (k == len(cuts) or key < cuts[k])
    alike = [(a, b, c) for a in range(1, 13) for b in range(1, 13) for c in range(1, 13)]
    whole = op11_phrases.Automaton.build(op11_phrases.Grams(symbols, [np.array(c, np.int64) for c in zip(*alike, strict=True)], np.ones(len(alike), np.int64)))
    assert [len(level[0]) for level in whole.levels] == [12, 12, 12]  # one state for all equal continuations


# periodic runs ---------------------------------------------------------------------------------------------------------------


def brute_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            t = []
            while len(t) < rng.randint(0, 90):
                unit = [bytes([97 + rng.randint(0, rng.choice([1, 2, 5]))]) for _ in range(rng.randint(1, 7))]
                t += (unit * rng.randint(1, 9))[: rng.randint(1, 40)]
            texts.append(t)
        for t, found in zip(texts, op12_runs.find_runs(texts), strict=True):
            assert list(zip(*(x.tolist() for x in found), strict=True)) == brute_runs(t)


def expected_runs(i, t, change=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if change and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = brute_runs(w)
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    dropped = {k for s, n, q in found for k in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(x for k, x in enumerate(w) if k not in dropped)
    return (i, len(found), *(top + (1000 * top[1] // top[2],) if top else (None,) * 4), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_periodic_runs_of_documents(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefgh") + rng.choice(["", "é", "X"]) for _ in range(rng.randint(0, 120))), "en") for i in range(120)]
    rows += [(500, None, "en"), (501, "", "en"), (502, " \n\t ", "en"), (503, "spam " * 400, "fr"), (None, "a b c " * 9, None), (504, "one two one two one", "en"), (504, "one two one two one", "en")]
    rows += [(505, "x y " + "line of a poem\n" * 60 + "z " + "a b " * 300, "en")]
    table = docs(spark, rows)
    got = [tuple(r) for r in op12_runs.periodic_runs(table, op12_runs.planted).drop("runs").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(got, key=key) == sorted((expected_runs(i, t) for i, t, _ in rows), key=key)
    plain = {r["doc_id"]: r for r in op12_runs.periodic_runs(table).collect()}
    assert [tuple(x) for x in plain[503]["runs"]] == [(0, 400, 1)] and plain[503]["exponent_milli"] == 400_000
    table.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    assert op12_runs.op12_periodic_runs(spark, str(tmp_path)).count() == len(rows)
    assert op12_runs.periodic_runs(table.limit(0)).count() == 0


def test_runs_of_a_long_text():
    rng = random.Random(9)
    text = [b"w%d" % rng.randint(0, 5000) for _ in range(60_000)]
    text[1000:1000] = [b"p", b"q", b"r"] * 5000
    text += [b"z"] * 20_000
    start, length, period = op12_runs.find_runs([text])[0]
    found = list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    assert (1000, 15_000, 3) in found and (75_000, 20_000, 1) in found


# personal data ---------------------------------------------------------------------------------------------------------------

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def is_kind(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "phone":
        return 10 <= len(d) <= 15
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    return True


def base_spans(t):
    found = [(m.start(), k, m.end(), kind) for k, (kind, form) in enumerate(FORMS.items()) for m in re.finditer(form, t or "") if is_kind(kind, m.group())]
    return [(s, e, kind) for s, _, e, kind in sorted(found)]


def test_base_spans_equal_plain_search(spark, tmp_path):
    rng = random.Random(5)
    marks = ["a@b.co", "a@b.cx@d.e", "a@b.c_x@d.ef", "@", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4.5.6.7.8", "999.1.1.1", "010.0.0.255", "+1 (743) 555-3824", "+12", "+1 2 3 4 5 6 7 8 9 0 ", "é", "\U0001f600", "x", "7", "..", " ", " ", "+", "-", "379", "\n", "user@localhost", "1" * 30]
    rows = [(i, "".join(rng.choice(marks) for _ in range(rng.randint(0, 40))), "en") for i in range(400)]
    rows += [(900, None, None), (901, "", "en"), (901, "", "en"), (None, "mail a@b.co", "en"), (None, "mail a@b.co", "en"), (902, "a" * 3000 + " " + "1." * 1500 + " " + "5" * 3000 + " x@y" + ".z" * 1500, "en")]
    table = docs(spark, rows)
    got = op13_private.personal_data(table).collect()
    own = lambda r: [(s["start"], s["end"], s["kind"]) for s in r["spans"] if s["is_base"]]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r["doc_id"], own(r)) for r in got), key=key) == sorted(((i, base_spans(t)) for i, t, _ in rows), key=key)
    for r in got:  # what the patterns add overlaps no base span
        for s in r["spans"]:
            assert s["is_base"] or not any(b["is_base"] and s["start"] < b["end"] and b["start"] < s["end"] for b in r["spans"])
    table.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in op13_private.op13_personal_data(spark, str(tmp_path)).collect()}
    for i, t, _ in rows[:50]:
        spans = base_spans(t)
        text = ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        assert out[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [out[i][f"n_{k}"] for k in FORMS] == [sum(x[2] == k for x in spans) for k in FORMS]
    assert op13_private.personal_data(table.limit(0)).count() == 0


def test_long_runs_take_linear_time(spark):
    rows = [(1, "a" * 200_000 + " " + "1." * 50_000 + " " + "5" * 100_000 + " x@y" + ".z" * 30_000 + " @" * 1000, "en")]
    spans = op13_private.personal_data(docs(spark, rows)).first()["spans"]
    assert [s["kind"] for s in spans if s["is_base"]] == ["ip"] * 12_500 + ["email"]


def test_patterns_discover_what_the_forms_miss(spark):
    rows = [(i, f"please write to agent{i}@mail.example.com today about order {100200300 + i} of may", "en") for i in range(12)]
    rows += [(100 + i, f"please write to agent{i}@localhost today", "en") for i in range(3)]  # no base form, a trusted context
    rows += [(200 + i, f"card number 4111 1111 1111 1111 expires in {i} years", "en") for i in range(9)]  # one value in many copies: no support
    rows += [(300 + i, f"see shelf {500600700 + i} or 10.0.0.{i} or ask", "en") for i in range(6)] + [(400, "see shelf 500600799 or else", "en")]
    rows += [(500 + i, f"call us at +1 (743) 555-38{i:02d} for help", "en") for i in range(20)] + [(600, "call us at (743) 555-3899 for help", "en"), (601, "nothing here but 1999 and 2024", "en")]
    got = {r["doc_id"]: r for r in op13_private.personal_data(docs(spark, rows)).collect()}
    added = lambda i: [(s["kind"], s["value"]) for s in got[i]["spans"] if not s["is_base"]]
    for i in range(3):
        assert added(100 + i) == [("email", f"agent{i}@localhost")]
    assert added(600) == [("phone", "(743) 555-3899")]
    assert not any(added(i) for i, *_ in rows if i not in (100, 101, 102, 600))


def test_rounds_raise_patterns_by_what_they_share(spark):
    """A value that a trusted context vouches for counts for another context, which then discovers more; one round doesn't reach as far."""
    seeds = [(i, f"call us at +1 743 555 38{i:02d} for help", "en") for i in range(30)]
    known = [(100 + i, f"reach me via +1 743 556 38{i:02d} at night", "en") for i in range(5)]
    bridge = [(200 + i, f"{w} 743 557 38{i:02d} {e}", "en") for i in range(4) for w, e in (("call us at", "for help"), ("reach me via", "at night"))]
    rows = seeds + known + bridge + [(300, "reach me via 743 558 3899 at night", "en")]
    added = lambda n: {s["value"] for r in op13_private.personal_data(docs(spark, rows), rounds=n).collect() for s in r["spans"] if not s["is_base"]}
    assert "743 558 3899" not in added(0)
    assert "743 558 3899" in added(4)


def test_a_hub_that_most_pairs_share_is_dealt(spark, monkeypatch):
    """Most documents share most words with one: its text meets theirs in several tasks, and the links are the same."""
    from quarrymill.llm import common, op7_minhash

    monkeypatch.setattr(common, "LEAST_HOT", 10)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(200)]
    texts = [(0, " ".join(base))] + [(i, " ".join(base[: 100 + i % 100] + [f"x{i}"] + base[100 + i % 100 :])) for i in range(1, 160)] + [(i, " ".join(rng.choice(base) for _ in range(80))) for i in range(160, 200)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 200)] + [(1, 2), (170, 171)], "a long, b long")
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts}
    want = sorted((a, b) for a, b in [(0, i) for i in range(1, 200)] + [(1, 2), (170, 171)] if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for k, v in zip(before, ("-1", "false", "16"), strict=True):
        spark.conf.set(k, v)
    try:
        out = op7_minhash.confirmed(pairs, table)
        assert sorted(map(tuple, out.collect())) == want and len(want) > 100
        joined = common.dealt_join(pairs, table.withColumnRenamed("doc_id", "a"), ["a"], "b", [(0, 20)])
        assert max(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()) < 60
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
