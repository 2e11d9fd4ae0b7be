"""Phrase collocations from weighted acyclic automata.

Every task counts the word n-grams of its texts (one to `LONGEST` words, within pieces) and, a bounded run at a time, sorts them and builds
a transducer: an acyclic automaton whose arcs carry a word and the count of the n-gram that ends there. It is built in order of the
n-grams: a state whose arcs are all known is looked up in a register of states, so that equal continuations with equal counts are
one state. Every thousandth n-gram of the runs says where to cut all n-grams into prefix ranges of about `RANGE` entries; runs are cut at these
places, and each range unites its pieces of all runs, adding up the weights of equal paths. A hot word is no hot range, since ranges are cut between
n-grams of its own too, and a hot n-gram is one path in each run.

Counts of parts are looked up by composition: every range asks for the parts of its candidates by a request automaton, cut at the same
places, whose paths are followed in the count transducer of the range that they belong to; the answers go back as weights. What is under the least
count is dropped after the union only, as no part counts less than its phrase. Candidates, requests and answers travel as automata of bounded
blocks, so no word gathers the phrases that hold it.

Symbols are lang, 0xFF and word, so that n-grams of different languages share nothing. Null texts count as empty, a null lang as
`und`. Texts of any length are counted whole, repeated rows as often as they come. An empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _LOWER, byte_batches, save, work_dir

LONGEST = 3
#: Places of a run that a task holds, distinct words of a run, words that are counted at once (with WORDS under 2^21), and entries of a range.
RUN, WORDS, STEP, RANGE = 1_000_000, 1 << 20, 1 << 19, 1_000_000
#: Of how many entries of a run one is told to where ranges are cut; phrases that a first ranking keeps to.
MARK, SALTED = 1000, 20_000
_SPACE, _CUT = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[0x20, 0x09]] = True
_CUT[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
NONE = np.zeros(0, np.int64)


class Grams:
    """Distinct n-grams in order: columns of numbers into sorted symbols (from 1; 0 for no word), and their weights."""

    def __init__(self, symbols: pa.Array, columns: list[np.ndarray], weight: np.ndarray):
        self.symbols, self.columns, self.weight = symbols, columns, weight

    def __len__(self) -> int:
        return len(self.weight)

    def slice(self, a: int, b: int) -> Grams:
        """The n-grams from place a to b with the symbols that they use."""
        used = np.unique(np.concatenate([c[a:b] for c in self.columns]))
        used = used[used > 0]
        return Grams(self.symbols.take(pa.array(used - 1)), [np.where(c[a:b] > 0, np.searchsorted(used, c[a:b]) + 1, 0).astype(np.int32) for c in self.columns], self.weight[a:b])

    def place(self, gram: list[bytes]) -> int:
        """How many of the n-grams come before gram."""
        low, high = 0, len(self)
        for c, word in zip(self.columns, gram, strict=True):
            n = _before(self.symbols, word) + 1 if word else 0
            own = word and n <= len(self.symbols) and self.symbols[n - 1].as_py() == word
            part = c[low:high]
            low, high = low + int(np.searchsorted(part, n)), low + int(np.searchsorted(part, n, "right"))
            if word and not own:
                return low
        return low

    def cut(self, cuts: list[list[bytes]]) -> Iterator[tuple[int, Grams]]:
        """(range, its n-grams) of the ranges that hold any."""
        at = [0, *(self.place(c) for c in cuts), len(self)]
        for k, (a, b) in enumerate(pairwise(at)):
            if b > a:
                yield k, self.slice(a, b)


def _before(symbols: pa.Array, word: bytes) -> int:
    return bisect_left(range(len(symbols)), word, key=lambda i: symbols[i].as_py())


def _order(columns: list[np.ndarray], top: int) -> np.ndarray:
    bits = max(top, 1).bit_length()
    if bits * len(columns) > 63:
        return np.lexsort(columns[::-1])
    key = columns[0].astype(np.int64)
    for c in columns[1:]:
        key = (key << bits) | c
    return np.argsort(key, kind="stable")


def _named(parts: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """The distinct symbols of several lists in order, and the number (from 1) of each in it."""
    coded = pa.concat_arrays(parts).dictionary_encode()
    by_name = pc.sort_indices(coded.dictionary).to_numpy(zero_copy_only=False)
    rank = np.empty(len(by_name), np.int32)
    rank[by_name] = np.arange(1, len(by_name) + 1)
    return coded.dictionary.take(pa.array(by_name)), rank[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else NONE


def united(parts: list[Grams], least: int = 0) -> Grams:
    """The union of several, weights of equal n-grams added up; those under least are left out."""
    symbols, codes = _named([p.symbols for p in parts])
    base = np.cumsum([0, *(len(p.symbols) for p in parts)])
    own = [np.append(np.int32(0), codes[a:b]) for a, b in pairwise(base)]
    columns = [np.concatenate([o[p.columns[k]] for o, p in zip(own, parts, strict=True)]) for k in range(LONGEST)]
    order = _order(columns, len(symbols))
    columns = [c[order] for c in columns]
    first = np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)) if len(order) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    weight = np.add.reduceat(np.concatenate([p.weight for p in parts])[order], at) if len(at) else NONE
    keep = weight >= least
    out = Grams(symbols, [c[at][keep] for c in columns], weight[keep])
    return out.slice(0, len(out)) if least else out


class Automaton:
    """A weighted acyclic automaton of n-grams: levels of (words, weights, next states) with the places where each state's arcs begin.

    State 0 of a level has no arcs. Arcs of a level are in order of state, then word.
    """

    def __init__(self, symbols: pa.Array, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.symbols, self.levels = symbols, levels

    @staticmethod
    def build(grams: Grams) -> Automaton:
        """From n-grams in order. Prefixes that aren't n-grams of it get arcs of weight 0."""
        size = np.sum([c > 0 for c in grams.columns], axis=0)
        # the distinct prefixes of each length, the place of each in its own prefix, and its weight
        first, head = [], np.zeros(len(grams), bool)
        head[:1] = True
        for c in grams.columns:
            head = head.copy()
            head[1:] |= c[1:] != c[:-1]
            first.append(head)
        levels, target = [], NONE
        for k in range(LONGEST - 1, -1, -1):
            here = np.flatnonzero(first[k] & (grams.columns[k] > 0))
            word = grams.columns[k][here]
            weight = np.where(size[here] == k + 1, grams.weight[here], 0)
            up = first[k - 1] & (grams.columns[k - 1] > 0) if k else np.arange(len(grams)) == 0
            owner = np.cumsum(up)[here] - 1  # of a prefix one word shorter, or of the root
            owners = int(up.sum()) if k else 1
            to = target if len(target) else np.zeros(len(here), np.int64)
            state, arcs, begin = _registered(np.stack([word, weight, to], axis=1), np.bincount(owner, minlength=owners))
            levels.append((arcs[:, 0], arcs[:, 1], arcs[:, 2], begin))
            target = state
        return Automaton(grams.symbols, levels[::-1])

    def grams(self) -> Grams:
        """Every path of weight over 0, in order."""
        state = np.array([1 if len(self.levels[0][0]) else 0])
        held, found = [], []
        for word, weight, to, begin in self.levels:
            n = begin[state + 1] - begin[state]
            arc = np.repeat(begin[state], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            held = [np.repeat(h, n) for h in held] + [word[arc]]
            some = weight[arc] > 0
            found.append(([h[some] for h in held] + [np.zeros(int(some.sum()), np.int32)] * (LONGEST - len(held)), weight[arc][some].astype(np.int64)))
            state = to[arc]
        columns = [np.concatenate([f[0][k] for f in found]) for k in range(LONGEST)]
        order = _order(columns, len(self.symbols))
        return Grams(self.symbols, [c[order] for c in columns], np.concatenate([f[1] for f in found])[order])

    def follow(self, symbols: pa.Array, columns: list[np.ndarray]) -> np.ndarray:
        """The weights of n-grams over other symbols, 0 where there is no such path."""
        known = pc.index_in(symbols, value_set=self.symbols)
        own = np.append(0, pc.fill_null(known, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        out, state = np.zeros(len(columns[0]), np.int64), np.full(len(columns[0]), 1 if len(self.levels[0][0]) else 0)
        width = len(self.symbols) + 1
        for (word, weight, to, begin), c in zip(self.levels, columns, strict=True):
            key = np.repeat(np.arange(len(begin) - 1), np.diff(begin)) * width + word
            wanted = state * width + own[c]
            at = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
            hit = (key[at] == wanted) & (own[c] > 0) if len(key) else np.zeros(len(c), bool)
            out = np.where(c > 0, np.where(hit, weight[at], 0), out) if len(key) else np.where(c > 0, 0, out)
            state = np.where(hit, to[at], np.where(c > 0, 0, state)) if len(key) else np.zeros(len(c), np.int64)
        return out

    def dump(self) -> bytes:
        small = lambda x: pa.array(x, pa.int32() if not len(x) or x.max() < 1 << 31 else pa.int64())
        columns = [self.symbols, *(small(x) for level in self.levels for x in level)]
        lists = [pa.LargeListArray.from_arrays(pa.array([0, len(c)], pa.int64()), c) for c in columns]
        batch = pa.record_batch(lists, names=[str(i) for i in range(len(lists))])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    @staticmethod
    def load(blob: bytes) -> Automaton:
        columns = [c.chunk(0).values for c in pa.ipc.open_stream(blob).read_all().columns]
        numbers = [c.to_numpy(zero_copy_only=False) for c in columns[1:]]
        return Automaton(columns[0], [tuple(numbers[4 * k : 4 * k + 4]) for k in range(LONGEST)])


def _registered(arcs: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States with `count` arcs each -> the number of each in the register, and the register: arcs and where each state's begin. 0 has none.

    States of one arc are looked up all at once where an arc fits a number, others one after the other.
    """
    begin = np.cumsum(count) - count
    state = np.zeros(len(count), np.int64)
    kept, sizes = [], [0]
    bits = [int(x).bit_length() for x in arcs.max(axis=0)] if len(arcs) else [0, 0, 0]
    single = np.flatnonzero(count == 1) if sum(bits) < 63 else NONE
    if len(single):
        word, weight, to = arcs[begin[single]].T
        distinct, number = np.unique((word << (bits[1] + bits[2])) | (weight << bits[2]) | to, return_inverse=True)
        state[single] = number + 1
        kept.append(np.stack([distinct >> (bits[1] + bits[2]), (distinct >> bits[2]) & ((1 << bits[1]) - 1), distinct & ((1 << bits[2]) - 1)], axis=1))
        sizes += [1] * len(distinct)
    register: dict[bytes, int] = {}
    others = np.flatnonzero((count > 0) & (state == 0))
    for s, a, n in zip(others.tolist(), begin[others].tolist(), count[others].tolist(), strict=True):
        own = arcs[a : a + n]
        name = own.tobytes()
        number = register.get(name)
        if number is None:
            number = register[name] = len(sizes)
            kept.append(own)
            sizes.append(n)
        state[s] = number
    return state, np.concatenate(kept) if kept else np.zeros((0, 3), np.int64), np.cumsum([0, *sizes])


class Counter:
    """Counts n-grams of texts until a run is full."""

    def __init__(self, run: int = RUN):
        self.run = run
        self.clear()

    def clear(self) -> None:
        self.symbols: list[pa.Array] = []
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.words = self.held = 0

    def add(self, data: np.ndarray, offsets: np.ndarray, langs: list[bytes]) -> Iterator[None]:
        """Takes texts as bytes with their limits, and the lang of each; stops after every STEP words, when the run may be taken."""
        cut = _CUT[data]
        solid = ~(_SPACE[data] | cut)
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        edge = offsets[:-1][offsets[:-1] < len(data)]
        begin[edge] = solid[edge]
        starts = np.flatnonzero(begin)
        if not len(starts):
            return
        kept = np.cumsum(solid, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
        limits = np.append(kept[starts] - 1, kept[-1])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(limits.astype(np.int64)), pa.py_buffer(_LOWER[data[solid]])]).dictionary_encode()
        row = np.searchsorted(offsets, starts, "right") - 1
        # no cut and no row's limit lies between a word and the next
        cuts = np.flatnonzero(cut)
        piece = np.searchsorted(cuts, starts)
        same = np.append((row[1:] == row[:-1]) & (piece[1:] == piece[:-1]), False)
        names = sorted(set(langs))
        number = {x: k for k, x in enumerate(names)}
        size = len(words.dictionary)
        both = np.array([number[x] for x in langs], np.int64)[row] * size + words.indices.to_numpy(zero_copy_only=False)
        lang = pa.array(names, pa.large_binary())
        for s in range(0, len(both), STEP):
            # n-grams that start here, and the words after that they go on with
            distinct, which = np.unique(both[s : s + STEP + LONGEST - 1], return_inverse=True)
            self.symbols.append(pc.binary_join_element_wise(lang.take(pa.array(distinct // size)), words.dictionary.take(pa.array(distinct % size)), pa.scalar(b"\xff", pa.large_binary())))
            ids = np.append(which + (self.words + 1), np.zeros(LONGEST, np.int64))
            self.words += len(distinct)
            n = min(STEP, len(both) - s)
            goes_on = np.append(same[s : s + STEP + LONGEST - 1], np.zeros(LONGEST, bool))
            key, going = ids[:n], np.ones(n, bool)
            for k in range(1, LONGEST):  # every place gives its longest n-gram; the shorter ones are its prefixes
                going = going & goes_on[k - 1 : k - 1 + n]
                key = (key << 21) | np.where(going, ids[k : k + n], 0)
            key, count = np.unique(key, return_counts=True)
            self.keys.append(key)
            self.counts.append(count)
            self.held += len(key)
            yield

    def full(self) -> bool:
        return self.held >= self.run or self.words > WORDS

    def take(self) -> Grams | None:
        """All n-grams of the run in order, prefixes with their own counts."""
        if not self.keys:
            return None
        symbols, rank = _named(self.symbols)
        rank = np.append(np.int32(0), rank)
        keys, count = np.concatenate(self.keys), np.concatenate(self.counts)
        self.clear()
        columns = [rank[(keys >> (21 * (LONGEST - 1 - k))) & ((1 << 21) - 1)] for k in range(LONGEST)]
        order = _order(columns, len(symbols))
        columns, count = [c[order] for c in columns], count[order]
        parts = []
        head = np.zeros(len(order), bool)
        head[:1] = True
        for k in range(LONGEST):
            head = head.copy()
            head[1:] |= columns[k][1:] != columns[k][:-1]
            at = np.flatnonzero(head)
            sums = np.add.reduceat(count, at)
            some = columns[k][at] > 0
            at = at[some]
            parts.append(([c[at] if j <= k else np.zeros(len(at), np.int32) for j, c in enumerate(columns)], sums[some]))
        columns = [np.concatenate([p[0][k] for p in parts]) for k in range(LONGEST)]
        order = _order(columns, len(symbols))
        return Grams(symbols, [c[order] for c in columns], np.concatenate([p[1] for p in parts])[order])


GRAM = ["a", "b", "c"]


def shard_transducers(docs: DataFrame, run: int = RUN) -> DataFrame:
    """docs (text, lang) -> a row for each run: blob, entries, totals (words of each lang), marks (every MARK-th n-gram)."""
    mark = pa.struct([(g, pa.binary()) for g in GRAM])

    def rows(counter: Counter) -> Iterator[pa.RecordBatch]:
        grams = counter.take()
        if grams is None:
            return
        alone = np.flatnonzero(grams.columns[1] == 0)
        totals: dict[str, int] = {}
        for s, n in zip(grams.symbols.take(pa.array(grams.columns[0][alone] - 1)).to_pylist(), grams.weight[alone].tolist(), strict=True):
            lang = s.split(b"\xff", 1)[0].decode()
            totals[lang] = totals.get(lang, 0) + n
        at = np.arange(MARK // 2, len(grams), MARK)
        name = lambda n: grams.symbols[n - 1].as_py() if n else b""
        marks = [dict(zip(GRAM, (name(int(c[i])) for c in grams.columns), strict=True)) for i in at.tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([Automaton.build(grams).dump()], pa.binary()), pa.array([len(grams)]), pa.array([list(totals.items())], pa.map_(pa.string(), pa.int64())), pa.array([marks], pa.list_(mark))],
            names=["blob", "entries", "totals", "marks"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(run)
        for batch in batches:
            langs = [b"und" if x is None else x.encode() for x in batch.column(1).to_pylist()]
            for first, data, offsets in byte_batches(batch.column(0)):
                for _ in counter.add(data, offsets, langs[first : first + len(offsets) - 1]):
                    if counter.full():
                        yield from rows(counter)
        yield from rows(counter)

    return docs.select(F.col("text").cast("string").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(count, "blob binary, entries long, totals map<string,bigint>, marks array<struct<a:binary,b:binary,c:binary>>")


def range_cuts(runs: DataFrame, size: int = RANGE) -> list[list[bytes]]:
    """N-grams at which to cut all n-grams into ranges of about `size` entries: as many as there are ranges, from marks that Spark sorts."""
    ranges = -(-(runs.agg(F.sum("entries")).first()[0] or 0) // size)
    if ranges <= 1:
        return []
    marks = runs.select(F.explode("marks").alias("m")).select("m.*").repartitionByRange(ranges, *GRAM)
    firsts = marks.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*GRAM)).alias("m")).select("m.*").collect()
    return sorted([bytes(x) for x in r] for r in firsts)[1:]


def _loaded(column) -> list[Automaton]:
    return [Automaton.load(b.as_py()) for b in column]


def _pieces(rows: Iterator[tuple[int, int, Grams]], names: list[str]) -> Iterator[pa.RecordBatch]:
    for *numbers, grams in rows:
        yield pa.RecordBatch.from_arrays([*(pa.array([n], pa.int32()) for n in numbers), pa.array([Automaton.build(grams).dump()], pa.binary())], names=names)


def count_transducers(runs: DataFrame, cuts: list[list[bytes]], least: int) -> DataFrame:
    """Of each range (part) the union of all runs, without n-grams that count less than least -> part, blob."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for automaton in (Automaton.load(b.as_py()) for b in batch.column(0)):
                yield from _pieces(automaton.grams().cut(cuts), ["part", "blob"])

    def unite(pieces: pa.Table) -> pa.Table:
        whole = united([a.grams() for a in _loaded(pieces.column("blob"))], least)
        blobs = [Automaton.build(whole).dump()] if len(whole) else []
        return pa.table({"part": pa.array(pieces.column("part").to_pylist()[: len(blobs)], pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return runs.select("blob").mapInArrow(cut, "part int, blob binary").groupBy("part").applyInArrow(unite, "part int, blob binary")


def part_counts(counts: DataFrame, cuts: list[list[bytes]]) -> DataFrame:
    """For each range the counts of all parts of its candidates -> back (the range that asked), blob (an automaton of parts)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for back, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grams = Automaton.load(blob.as_py()).grams()
                a, b, c = (x[grams.columns[1] > 0] for x in grams.columns)
                zero, long = np.zeros(len(a), np.int64), c > 0
                wanted = [(a, zero), (np.where(long, 0, b), zero), (np.where(long, a, 0), np.where(long, b, 0)), (np.where(long, b, 0), np.where(long, c, 0)), (c, zero)]
                first, second = (np.concatenate([w[k] for w in wanted]) for k in range(2))
                some = first > 0
                parts = Grams(grams.symbols, [first[some], second[some], np.zeros(int(some.sum()), np.int64)], np.ones(int(some.sum()), np.int64))
                if len(parts):
                    yield from _pieces(((k, back, g) for k, g in united([parts]).cut(cuts)), ["part", "back", "blob"])

    def compose(count: pa.Table, asked: pa.Table) -> pa.Table:
        known = _loaded(count.column("blob"))
        back, blobs = [], []
        for who, blob in zip(asked.column("back").to_pylist(), asked.column("blob"), strict=True):
            wanted = Automaton.load(blob.as_py()).grams()
            weight = np.sum([k.follow(wanted.symbols, wanted.columns) for k in known], axis=0) if known else np.zeros(len(wanted), np.int64)
            back.append(who)
            blobs.append(Automaton.build(Grams(wanted.symbols, wanted.columns, weight)).dump())
        return pa.table({"back": pa.array(back, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    asked = counts.mapInArrow(ask, "part int, back int, blob binary")
    return counts.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(compose, "back int, blob binary")


def scored(counts: DataFrame, parts: DataFrame, percent: int = 50) -> DataFrame:
    """Candidates with their lowest-scoring cut, and the phrases that a longer candidate covers (covered; of them only lang and phrase)."""
    schema = "lang string, phrase string, a long, l long, r long, score long, covered boolean"
    names = [c.split()[0] for c in schema.split(", ")]

    def score(count: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[list] = [[] for _ in names]
        answered = united([a.grams() for a in _loaded(answers.column("blob"))]) if len(answers) else None
        for automaton in _loaded(count.column("blob")):
            grams = automaton.grams()
            some = np.flatnonzero(grams.columns[1] > 0)
            if not len(some) or answered is None:
                continue
            a, b, c = (x[some] for x in grams.columns)
            f = grams.weight[some].astype(object)
            zero, long = np.zeros(len(a), np.int64), c > 0
            lookup = Automaton.build(answered)
            of = lambda *columns: lookup.follow(grams.symbols, [*columns, zero]).astype(object)
            l1, r1 = of(a, zero), of(b, c)
            l2, r2 = of(a, np.where(long, b, 0)), of(np.where(long, c, b), zero)
            s1, s2 = (1_000_000 * f * f // (x * y) for x, y in ((l1, r1), (l2, r2)))
            second = long & (s2 < s1).astype(bool)
            pick = lambda x, y: np.where(second, y, x).tolist()
            texts = [s.split(b"\xff", 1) for s in grams.symbols.to_pylist()]
            words = ["", *(w.decode() for _, w in texts)]
            langs = [texts[k - 1][0].decode() for k in a.tolist()]
            phrase = [" ".join(words[k] for k in g if k) for g in zip(a.tolist(), b.tolist(), c.tolist(), strict=True)]
            for into, values in zip(rows, (langs, phrase, f.tolist(), pick(l1, l2), pick(r1, r2), pick(s1, s2), [False] * len(a)), strict=True):
                into += values
            for x, y, whole in ((a, b, l2), (b, c, r1)):
                hit = np.flatnonzero(long & (100 * f >= percent * whole).astype(bool))
                for into, values in zip(rows, ([langs[i] for i in hit], [f"{words[x[i]]} {words[y[i]]}" for i in hit], *[[None] * len(hit)] * 4, [True] * len(hit)), strict=True):
                    into += values
        return pa.table({n: pa.array(v, t) for n, v, t in zip(names, rows, [pa.string(), pa.string(), *[pa.int64()] * 4, pa.bool_()], strict=True)})

    return counts.groupBy("part").cogroup(parts.groupBy("back")).applyInArrow(score, schema)


def collocations(docs: DataFrame, least: int = 10, percent: int = 50, most: int = 2000, run: int = RUN, size: int = RANGE) -> DataFrame:
    """docs (text, lang) -> the first `most` phrases of each lang: lang, rank, phrase, a, l, r, n, score.

    Fewer entries a run or range (`run`, `size`) give the same rows from more automata.
    """
    work = work_dir(docs.sparkSession, "phrases")
    runs = save(shard_transducers(docs, run), f"{work}/runs", "uncompressed")  # blobs are compressed
    cuts = range_cuts(runs, size)
    counts = save(count_transducers(runs, cuts, least), f"{work}/counts", "uncompressed")
    found = save(scored(counts, part_counts(counts, cuts), percent), f"{work}/scored")
    covered = found.where("covered").select("lang", "phrase").distinct()
    rows = found.where("not covered").join(covered, ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # a lang may hold most phrases: its parts are ranked first, so that each sends on its best only
    salts = found.count() // SALTED + 1
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase", F.lit(17)), F.lit(salts)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    n = runs.select(F.explode("totals").alias("lang", "n")).groupBy("lang").agg(F.sum("n").alias("n"))
    return rows.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS g FROM words, (VALUES (1), (2), (3)) AS v(k) WHERE len(w) >= k
), f AS (SELECT lang, g, k, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, g, k, f AS a, string_split(g, ' ') AS w FROM f WHERE k >= 2 AND f >= 10),
cuts AS (
  SELECT lang, g, k, a, c, array_to_string(w[1:c], ' ') AS first, array_to_string(w[c + 1:k], ' ') AS rest FROM candidates, (VALUES (1), (2)) AS v(c) WHERE c < k
), scores AS (
  SELECT u.lang, u.g, u.k, u.a, x.f AS l, y.f AS r, c, ((1000000::HUGEINT * u.a * u.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts u JOIN f x ON x.lang = u.lang AND x.g = u.first JOIN f y ON y.lang = u.lang AND y.g = u.rest
), best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
covered AS (
  SELECT t.lang, p.g FROM candidates t, unnest([array_to_string(t.w[1:2], ' '), array_to_string(t.w[2:3], ' ')]) AS p(g)
  JOIN candidates s ON s.lang = t.lang AND s.g = p.g WHERE t.k = 3 AND 100 * t.a >= 50 * s.a
), ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.g) AS rank, b.g AS phrase, a, l, r, n, score
  FROM best b JOIN total USING (lang) WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.lang = b.lang AND c.g = b.g)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
