"""Small fixtures with nulls, ties, repeats, empty and long texts, empty tables and extra columns, against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import op1_embeddings, op2_mixing, op3_warc, op4_chat, op5_secrets, op6_language, op7_minhash, op8_pieces, op9_quality, op10_exact
from quarrymill.llm.graph import connected_components

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, component int, size string, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, "x", "y") for i, t, s in rows], DOCS)


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.integers(0, vocabulary, n))


def corpus():
    rows = [(i, prose(i, 60), f"s{i % 3}") for i in range(40)]
    base = prose(1000, 120).split()
    for i in range(60):  # a group of near copies, some of them too far apart
        copy = list(base)
        for k in range(i % 12):
            copy[(i * 7 + k * 11) % len(copy)] = f"e{i}x{k}"
        rows.append((100 + i, " ".join(copy), "s0"))
    rows += [(200, None, None), (201, "", "s1"), (202, "  \t\n", "s1"), (203, "one two three", "s2"), (204, "ONE two\nthree", None), (205, "é É", "s2"), (206, prose(5, 60), "s2"), (207, prose(5, 60).upper(), "s2"), (208, prose(77, 30_000), "s0"), (209, prose(77, 30_000) + " end", "s0")]
    return rows


def brute_components(rows, percent=75):
    sets = {}
    for i, t, *_ in rows:
        w = WORDS.findall((t or "").encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i in sorted(sets):
        near = defaultdict(int)
        for g in sets[i]:
            for j in where[g]:
                near[j] += 1
            where[g].append(i)
        for j, n in near.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_op7_equals_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: r for r in op7_minhash.near_duplicates(docs(spark, rows)).collect()}
    want = brute_components(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert len({c for _, c in want.values()}) < len(rows)


def test_op7_empty_repeated_and_null_ids(spark):
    assert op7_minhash.near_duplicates(docs(spark, [])).count() == 0
    rows = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (None, "a b c d e f", "s"), (2, "a b c d e f", "s")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in op7_minhash.near_duplicates(docs(spark, rows)).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)]


def test_components(spark):
    pairs = [(9, 8), (8, 7), (7, 3), (20, 21), (21, 22), (22, 20), (5, 5), (None, 4)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), op1_embeddings.work_dir(spark, "t")).collect()}
    assert got == {9: 3, 8: 3, 7: 3, 3: 3, 20: 20, 21: 20, 22: 20} | {100 + i: 100 for i in range(41)}


def test_op1_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 24))
    group = rng.standard_normal(24)
    x = np.concatenate([x, group + rng.standard_normal((700, 24)) * np.linspace(0.02, 0.33, 700)[:, None], x[:20], x[:20] * 3])
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    rows += [(5000, None, 1), (5001, [0.0] * 24, 1), (5002, [float("nan")] + [1.0] * 23, 1), (5003, [], 1), (5004, [None] + [1.0] * 23, 1), (5005, [1.0, 2.0], 1)]
    got = {r.vec_id: r for r in op1_embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    assert [got[i].n_links for i in range(len(x))] == near.sum(axis=1).tolist()
    comp = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(comp[i], comp[near[i]].min(initial=len(x))) for i in range(len(x))])
        if (new == comp).all():
            break
        comp = new
    assert [got[i].component_id for i in range(len(x))] == comp.tolist()
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(5000, 5006))


def test_op1_empty(spark):
    assert op1_embeddings.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_op2_targets_and_reruns(spark):
    rows = [(i, prose(i, 5 + i % 40), None if i % 11 == 0 else f"s{i % 4}") for i in range(300)] + [(900, prose(1, 4000), "big"), (901, None, "big"), (902, "", "none")]
    table = docs(spark, rows)
    got = op2_mixing.mix(table).collect()
    assert len(got) == len(rows)
    again = op2_mixing.mix(table.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r.size == len(WORDS.findall((dict((i, t) for i, t, _ in rows)[r.doc_id] or "").encode()))
        assert 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    weights = dict(zip(sorted(s for s in sizes if s is not None) + [None], (5, 2, 1) * 5, strict=False))
    want, free, left = {}, set(sizes), sum(sizes.values())
    while True:  # reshare until none is above
        share = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / share >= 3 * sizes[s]]
        if not over:
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            free.discard(s)
        left = sum(sizes.values()) - sum(want.values())
    want |= {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        biggest = max((r.size for r in got if r.source == s), default=0)
        assert abs(taken[s] - target[s]) <= biggest


def test_op2_mixed_rows_and_empty(spark):
    table = docs(spark, [(1, "a b", "s"), (2, "c", "t"), (3, "", "t")])
    out = op2_mixing.mixed(table)
    assert out.columns == table.columns
    times = {r.doc_id: r.copies for r in op2_mixing.mix(table).collect()}
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: v for k, v in times.items() if v}
    assert op2_mixing.mix(docs(spark, [])).count() == 0


def test_op3_round_trip(spark):
    long = "x" * 100
    tricky = "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 5
    rows = [(3, "http://a/ b\n", long), (1, "http://b", long), (2, None, long), (4, "u", "short"), (5, "u", "short"), (6, "v", None), (7, "é", tricky), (8, "w", tricky + "é"), (None, "n", long), (9, "q", "x" * 200_000)]
    path = op1_embeddings.work_dir(spark, "warc")
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, refers_to int")
    op3_warc.write_archives(pages, path, archive_bytes=50_000)
    got = {r.page_id: r for r in op3_warc.read_archives(spark, path).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        r, data = got[i], (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        revisit = i in (2, 3)
        assert (r.record_type, r.refers_to) == (("revisit", 1) if revisit else ("response", None))
        assert r.payload is None if revisit else r.payload == data


def test_op4_round_trip(spark):
    rows = [
        (1, 0, "system", "be <|kind|>"), (1, 1, "user", None), (1, 2, "assistant", "<|im_end|>\n<|im_start|>user\nhi <\\| <\\\\|"), (1, 3, "user", "more"), (1, 4, "assistant", "ok"), (1, 5, "user", "left over"),
        (2, 0, "user", "no reply"), (3, 1, "assistant", ""), (3, None, "we\\n\nird", "t"), (None, 0, "assistant", "lone"), (4, 0, None, "x" * 5000),
    ]
    turns = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, target string")
    examples = op4_chat.expand(turns)
    got = {r.conv_id: r for r in op4_chat.read_back(examples).collect()}
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        by[r[0]].append(r)
    for c, ts in by.items():
        text = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in ts)
        loss = "".join(t or "" for _, _, r, t in ts if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(ts), hashlib.sha256(text.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    ex = [r for r in examples.where("conv_id = 1").collect() if r.target is not None]
    assert sorted(r.target for r in ex) == [2, 4]
    first = min(ex, key=lambda r: r.target)
    assert first.text.endswith("<|im_end|>\n") and "more" not in first.text and first.text.count("<|im_start|>") == 3
    assert sum(r.formatted_chars for r in got.values()) == examples.agg(F.sum(F.length("text"))).first()[0]
    assert op4_chat.read_back(op4_chat.expand(turns.limit(0))).count() == 0


def test_op4_rows_without_conversation_repeats_and_many_turns(spark):
    """Rows without conv_id stand alone; repeated rows are turns of their own; hundreds of turns and long texts come back whole."""
    alone = [(None, 0, "assistant", "a"), (None, 0, "assistant", "a"), (None, 1, "user", "b")]
    long = [(7, i, ("user", "assistant")[i % 2], f"t{i} <|im_end|> " + "y" * (9000 if i == 3 else 5)) for i in range(300)]
    twice = [(8, 0, "assistant", "same")] * 3
    got = op4_chat.read_back(op4_chat.expand(spark.createDataFrame(alone + long + twice, "conv_id long, turn long, role string, text string"))).collect()
    digest = lambda ts: hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in ts).encode()).hexdigest()
    assert sorted((r.n_turns, r.turns_sha256, r.loss_chars) for r in got if r.conv_id is None) == sorted((1, digest([t]), len(t[3]) * (t[2] == "assistant")) for t in alone)
    one = {r.conv_id: r for r in got}
    assert (one[7].n_turns, one[7].turns_sha256) == (300, digest(long)) and (one[8].n_turns, one[8].turns_sha256) == (3, digest(twice))
    assert one[7].loss_sha256 == hashlib.sha256("".join(t for _, _, r, t in long if r == "assistant").encode()).hexdigest()


def test_op5_findings(spark):
    rows = []
    for i in range(60):
        digest = hashlib.sha1(str(i).encode()).hexdigest()
        rows.append((i, f'{prose(i, 20)} token = "{digest}" {prose(i + 1, 5)} card 98079157628{i:05d} see mail{i}.example.com/path/to/file', f"s{i % 3}"))
    rows += [(900, None, None), (901, "", "s"), (902, "plain words only", "s")]
    got = op5_secrets.scan(docs(spark, rows), known=F.col("doc_id") % 3 != 1).collect()
    secrets = {r.candidate for r in got if r.is_secret}
    assert secrets == {hashlib.sha1(str(i).encode()).hexdigest() for i in range(60)}
    assert op5_secrets.scan(docs(spark, [])).count() == 0
    one = op5_secrets.scan(docs(spark, [(1, "card 9807915762811111 here", "s")])).collect()
    assert [(r.probability, r.is_secret) for r in one] == [(0.0, False)]


def test_op5_glued_compound_and_short(spark):
    d = hashlib.sha1(b"x").hexdigest()
    real = ["the api_key=" + d, "see token:" + d, "aws_secret_access_key = " + d, 'db_password: "p4ss!w0rd#x"', "githubToken := Ab3$9zQ1", "export GITHUB_TOKEN=Ab3xY9zQ17", "password = hunter"]
    other = ["card 9807915762811111 here", "see mail1.example.com/path/to/file", "commit_id=" + d, "order = 12345678", d]
    doubtful = ["primary_key = " + d, "the token " + d, "http://a.example/x?token=" + d]
    texts = real + other + doubtful
    found = op5_secrets.candidates(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    got = {r.doc_id: (r.candidate, r.label) for r in found.withColumn("label", op5_secrets.assigned_name()).collect()}
    assert [got[i][1] for i in range(len(texts))] == [1.0] * len(real) + [0.0] * len(other) + [None] * len(doubtful)
    assert [got[i][0] for i in range(len(real))] == [d, d, d, "p4ss!w0rd#x", "Ab3$9zQ1", "Ab3xY9zQ17", "hunter"]


def test_op6_accuracy_and_edges(spark):
    rng = np.random.default_rng(1)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["schu", "ber", "tz"], "cc": ["ção", "eau", "ñi"]}
    make = lambda lang, n: " ".join("".join(rng.choice(syllables[lang], 3)) for _ in range(n))
    rows = [(i, make(lang, 1 + i % 30), lang) for i in range(200) for lang in syllables]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, matrix = op6_language.train(table.where("doc_id < 150").select("text", "lang"))
    assert langs == ["aa", "bb", "cc"]
    got = op6_language.identify(table.where("doc_id >= 150"), langs, matrix).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98 and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34!"), (4, make("bb", 300_000))], "doc_id long, text string")
    assert [(r.lang_pred, round(r.score, 3)) for r in op6_language.identify(odd, langs, matrix).orderBy("doc_id").collect()] == [("und", 0.0)] * 3 + [("bb", 1.0)]
    none = op6_language.train(table.limit(0).select("text", "lang"))
    assert {r.lang_pred for r in op6_language.identify(odd, *none).collect()} == {"und"}


@pytest.fixture(scope="module")
def pieces():
    return op8_pieces.Pieces(op8_pieces.MODEL)


TEXTS = ["Hello  world", " a", "", "x" * 500, "日本 é\tq  \n\n z", "a ▁ b", "\x00\x7f", "the the the " * 40, "supercalifragilistic " * 3, "🙂🙂 naïve", "\r\n", "   "]


def test_op8_plain_equals_library(pieces):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=op8_pieces.MODEL)
    texts = [t for t in TEXTS if "▁" not in t]
    ids, n = op8_pieces.encode_texts(pieces, texts, 1, 0.0, 4)
    at = np.append(0, np.cumsum(n))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [model.encode(t) for t in texts]


def test_op8_lockstep_equals_agenda(pieces):
    rng = np.random.default_rng(2)
    for k in range(200):
        symbols = pieces.char[np.frombuffer((" " + "".join(rng.choice(list("theinagorst日"), 12))).encode("utf-32-le"), np.uint32)]
        key = np.array([op8_pieces._mix(k)], np.uint64)
        limit = int(0.3 * 2**64)
        s, _ = op8_pieces.lockstep(pieces, symbols, np.array([len(symbols)]), key, limit)
        assert s.tolist() == op8_pieces.agenda(pieces, symbols.tolist(), int(key[0]), limit)


def test_op8_runs_grow_in_place():
    none = op8_pieces.Runs(np.zeros(0, np.int64), np.zeros(0, np.int64))
    kept, want = none, []
    for k in range(1, 40):
        more = [list(range(j)) for j in range(k % 5)]
        want += more
        grown = kept + op8_pieces.Runs(np.array(sum(more, []), np.int64), np.array([len(m) for m in more], np.int64))
        aside = grown + op8_pieces.Runs(np.array([-k, -k]), np.array([2]))  # put behind what is kept, lost at the next sum
        values, n = aside.take(np.array([len(want), *range(len(want))]))
        assert values.tolist() == [-k, -k, *sum(want, [])] and n.tolist() == [2, *map(len, want)]
        kept = grown
    few = lambda n: op8_pieces.Runs(np.arange(n), np.array([n]))
    kept = none + few(80)
    assert np.shares_memory((kept + few(9)).values, kept.values)  # nothing is copied while there is room


def test_op8_dropout_is_lossless_and_varied(spark):
    table = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "doc_id int, text string")
    encode = lambda rate, seed: {r.doc_id: r for r in op8_pieces.encode_documents(table.repartition(3), rate=rate, seed=seed).collect()}
    a, b, c, plain = encode(0.3, 1), encode(0.3, 1), encode(0.3, 2), encode(0.0, 1)
    assert all(r.lossless for x in (a, c, plain) for r in x.values())
    assert {i: r.ids for i, r in a.items()} == {i: r.ids for i, r in b.items()}
    assert a[7].ids != c[7].ids and a[7].n_ids > plain[7].n_ids
    assert a[2].ids == [] and a[len(TEXTS)].ids == []


def test_op8_encodes_each_row_once(spark, monkeypatch):
    seen, encode = spark.sparkContext.accumulator(0), op8_pieces.encode_texts

    def counted(p, texts, *a, **b):
        seen.add(len(texts))
        return encode(p, texts, *a, **b)

    monkeypatch.setattr(op8_pieces, "encode_texts", counted)
    table = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "_coded int, text string")
    rows = op8_pieces.encode_documents(table).collect()
    assert seen.value == len(rows) == len(TEXTS) + 1
    assert all(r.lossless and r.n_ids == len(r.ids) for r in rows) and sorted(r._coded for r in rows) == list(range(len(rows)))


def test_op8_merged_units_take_little_memory(pieces):
    import tracemalloc

    texts = [" ".join(f"w{i}a{j}" for j in range(100)) for i in range(300)]
    known = op8_pieces.Merged()
    op8_pieces.encode_texts(pieces, texts[:1], 8, 0.1, known=known)
    tracemalloc.start()
    op8_pieces.encode_texts(pieces, texts, 8, 0.1, known=known)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    n = len(known.place)
    assert n == 30_000 and held < 8 * len(known.terms.room[0]) + 4 * len(known.ids.room[0]) + 50 * n


def test_op8_every_occurrence_decides(pieces):
    word = "internationalization"
    texts = [" ".join([word] * 100) + f" {i}" for i in range(20)]
    found = set()
    for kept in (0, 10, 400_000):  # full or not, the cache changes nothing
        known = op8_pieces.Merged()
        got = [op8_pieces.encode_texts(pieces, texts[i : i + 5], 8, 0.1, kept, known) for i in range(0, 20, 5)]
        found.add(tuple(np.concatenate([ids for ids, _ in got]).tolist()))
    (flat,) = found
    place = np.cumsum(pieces.sizes[list(flat)])
    seen, a = [], 0
    for t in texts:
        for _ in range(100):
            b = int(np.searchsorted(place, place[a - 1] + len(word) + 1 if a else len(word) + 1)) + 1
            seen.append(flat[a:b])
            a = b
        a = int(np.searchsorted(place, sum(len(x) + 1 for x in texts[: texts.index(t) + 1]))) + 1
    symbols = pieces.char[np.frombuffer((" " + word).encode("utf-32-le"), np.uint32)].tolist()
    brute = [tuple(op8_pieces.agenda(pieces, symbols, op8_pieces._mix(k + 1), int(0.1 * 2**64))) for k in range(2000)]
    plain = tuple(op8_pieces.agenda(pieces, symbols, 0, 0))
    assert len(set(seen)) > 100 and abs(seen.count(plain) - brute.count(plain)) < 150
    assert 0.8 < len(set(seen)) / len(set(brute)) < 1.25


def test_op9_ranks_junk_below_prose(spark):
    rng = np.random.default_rng(4)
    good = lambda n: " ".join("".join(rng.choice(list("aeioulnrst"), 5)) for _ in range(n)).capitalize() + "."
    rows = [(i, good(5 + i % 50), 1) for i in range(300)] + [(1000 + i, good(5 + i % 50).upper().replace(" ", "!! "), 0) for i in range(60)] + [(2000 + i, good(5 + i % 50).replace(" ", "### "), 0) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    train = table.where("doc_id % 3 <> 1")
    score = op9_quality.scorer(spark, op9_quality.train(train.select("doc_id", "text"), train.select("doc_id", "quality")))
    got = table.where("doc_id % 3 = 1").withColumn("s", score(op9_quality.whole())).collect()
    assert np.mean([(r.s >= 0.5) == (r.quality == 1) for r in got]) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a" * 500_000)], "doc_id long, text string").withColumn("s", score(op9_quality.whole())).collect()
    assert all(0 <= r.s <= 1 for r in odd)
    assert op9_quality.train(train.select("doc_id", "text"), train.where("quality = 1").select("doc_id", "quality")) is None


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_op10_equals_brute_force(spark, digest_bytes):
    rows = [(i, f"Text {i % 40}", "s") for i in range(300)] + [(900, None, "s"), (901, "", "s"), (902, "É", "s"), (903, "é", "s"), (904, "ABC", "s"), (905, "abc", "s"), (906, "x" * 100_000, "s"), (907, "X" * 100_000, "s")]
    got = {r.doc_id: r for r in op10_exact.exact_duplicates(docs(spark, rows), digest_bytes=digest_bytes).collect()}
    group = defaultdict(list)
    for i, t, _ in rows:
        group[fold(t)].append(i)
    for i, t, _ in rows:
        g = group[fold(t)]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(g), len(g), i == max(g), hashlib.sha256(fold(t).encode()).hexdigest())


def test_op10_repeats_nulls_empty(spark):
    rows = [(1, "a", "s"), (1, "a", "s"), (None, "A", "s"), (None, "b", "s"), (None, "b", "s")]
    out = op10_exact.keep_first_copies(docs(spark, rows))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == [(1, "a"), (None, "b")]
    assert out.columns == docs(spark, rows).columns
    assert op10_exact.exact_duplicates(docs(spark, [])).count() == 0
