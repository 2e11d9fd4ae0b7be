"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

A text gets one leading space, its spaces become the piece mark, and neighbouring symbols whose concatenation is a piece are merged,
best score first and leftmost among equals. With dropout a candidate merge is skipped when a keyed hash of (seed, text, place of the unit
in it, position, left piece, right piece) falls under the rate; a merge that makes a new neighbour makes a new candidate. Characters without a piece, and
a literal piece mark, become their UTF-8 byte pieces, so that decoding gives back every text exactly.

Pieces never hold a space after another character, so a text falls into units (a run of spaces with what follows) that are merged on
their own. Every occurrence decides each of its candidates. Equal units of a batch are merged without dropout once, with the candidates
that this offers; an occurrence that skips none of them has those ids, every other is merged on its own. Short units run their agendas in
lockstep over numpy arrays, long ones on a heap; both skip the same candidates. Seed, rate, text and row key fix the ids: reruns agree.
Without a row key equal texts have equal ids; with one (an epoch, a copy's number) each row has its own.

Null texts are empty; empty texts have no ids. Texts of any length are encoded whole, repeated rows each on their own. The vocabulary file
is read on the driver and its tables are broadcast (its size is fixed by the file). Empty tables give no rows. Other columns are kept, but
for ids, n_ids and lossless, which are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, mix64, segment_hash

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
_MASK = (1 << 64) - 1
_FREE = np.uint32(2**32 - 1)
LONG = 48
TABLE_BITS = 19
NEVER = np.int32(2**31 - 1)
#: Units merged without dropout that a task keeps for reuse.
KEPT = 400_000


def _mix(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


class Pieces:
    """Tables of one vocabulary."""

    @classmethod
    def of(cls, tables: dict) -> Pieces:
        """From the tables of vars(); they travel by broadcast."""
        p = cls.__new__(cls)
        vars(p).update(tables)
        return p

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        normal = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        self.byte0 = next(i for i in range(n) if model.is_byte(i))
        ids = {p: i for i, p in enumerate(pieces) if normal[i]}
        if any("▁" in p.lstrip("▁") for p in ids):
            raise ValueError("pieces with a space after another character are not supported")
        self.base = n  # symbols from here on are characters without a piece
        self.char = np.arange(0x110000, dtype=np.int32) + np.int32(n)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[0x20] = ids["▁"]
        self.char[MARK] = n + MARK
        ranks = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in ids.values()}, reverse=True))}
        self.merges = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                if p[:k] in ids and p[k:] in ids:
                    self.merges[(ids[p[:k]] << 16) | ids[p[k:]]] = (ranks[model.get_score(i)], i)
        if n > 1 << 16:
            raise ValueError("more than 65536 pieces are not supported")
        self.rank = np.zeros(n, np.int32)
        for i in ids.values():
            self.rank[i] = ranks[model.get_score(i)]
        keys = np.array(list(self.merges), np.uint32)
        self.keys, self.to = np.full(1 << TABLE_BITS, _FREE, np.uint32), np.zeros(1 << TABLE_BITS, np.int32)
        for key, slot in zip(keys.tolist(), self.slots(keys).tolist(), strict=True):
            while self.keys[slot] != _FREE:
                slot = (slot + 1) % (1 << TABLE_BITS)
            self.keys[slot], self.to[slot] = key, self.merges[key][1]
        raw = [bytes([i - self.byte0]) if model.is_byte(i) else p.replace("▁", " ").encode() if normal[i] else b"" for i, p in enumerate(pieces)]
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.sizes = np.array([len(b) for b in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    @staticmethod
    def slots(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - TABLE_BITS)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair merges to, or -1. Symbols without a piece are never in a pair."""
        key = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        slot = self.slots(key)
        there = self.keys[slot]
        to = np.where(there == key, self.to[slot], np.int32(-1))
        at = np.flatnonzero((there != key) & (there != _FREE))
        while len(at):
            slot[at] = (slot[at] + np.uint32(1)) & np.uint32((1 << TABLE_BITS) - 1)
            there = self.keys[slot[at]]
            hit = at[there == key[at]]
            to[hit] = self.to[slot[hit]]
            at = at[(there != key[at]) & (there != _FREE)]
        return to


_LEFT, _RIGHT, _AT = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def _terms(left, right, at) -> np.ndarray:
    """What a candidate adds to its occurrence's key before the skip hash."""
    return left.astype(np.uint64) * np.uint64(_LEFT) + right.astype(np.uint64) * np.uint64(_RIGHT) + at.astype(np.uint64) * np.uint64(_AT)


def _candidates(p: Pieces, left, right, at, key, limit: int):
    """Packed rank and position of each candidate (the least goes first), and the merged pieces; a skipped one is NEVER."""
    to = p.find(left, right)
    value = np.where(to < 0, NEVER, (p.rank[to] << np.int32(6)) | at)
    if limit:
        some = np.flatnonzero(to >= 0)
        value[some[mix64(key[some] + _terms(left[some], right[some], at[some])) < np.uint64(limit)]] = NEVER
    return value, to


def lockstep(p: Pieces, symbols: np.ndarray, size: np.ndarray, keys: np.ndarray, limit: int, offered: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Merges many short units at once: symbols of units of `size` -> the symbols that are left, and how many each unit has.

    A step makes the next merge of every unit that has one. `offered` takes the unit numbers and terms of all candidates.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(size), np.int64)
    first = np.cumsum(size) - size
    s = symbols.astype(np.int32)
    at = (np.arange(n) - np.repeat(first, size)).astype(np.int32)
    after, before = at + np.int32(1), at - np.int32(1)
    alive = np.ones(n, bool)
    value, to = np.full(n, NEVER), np.zeros(n, np.int32)
    owner = np.repeat(np.arange(len(size)), size)

    def offer(place: np.ndarray, right: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The candidates of symbols `place` with their neighbours `right`: packed rank and position."""
        found, to[place] = _candidates(p, s[place], s[right], at[place], keys[u], limit)
        if offered is not None:
            some = np.flatnonzero(to[place] >= 0)
            offered.append((u[some], _terms(s[place[some]], s[right[some]], at[place[some]])))
        return found

    same = np.flatnonzero(owner[1:] == owner[:-1])
    value[same] = offer(same, same + 1, owner[same])
    unit, begin = np.arange(len(size)), first  # units in value, and where they begin there
    while len(unit):
        least = np.minimum.reduceat(value, begin)
        go = least != NEVER
        if 3 * np.count_nonzero(go) < 2 * len(go):  # leave out those that are done
            value, unit, least = value[np.repeat(go, size[unit])], unit[go], least[go]
            begin = np.cumsum(size[unit]) - size[unit]
            u, b = unit, begin
        else:
            u, b, least = unit[go], begin[go], least[go]
        if not len(u):
            break
        place = (least & np.int32(63)).astype(np.int64)
        here = first[u] + place
        next_ = after[here]
        gone = first[u] + next_
        s[here] = to[here]
        alive[gone] = False
        value[b + next_] = NEVER
        rest = after[gone]
        after[here] = rest
        right = np.flatnonzero(rest < size[u])
        before[(first[u] + rest)[right]] = place[right]
        back = before[here]
        left = np.flatnonzero(back >= 0)
        found = offer(np.concatenate([here[right], (first[u] + back)[left]]), np.concatenate([(first[u] + rest)[right], here[left]]), np.concatenate([u[right], u[left]]))
        value[b + place] = NEVER
        value[np.concatenate([(b + place)[right], (b + back)[left]])] = found
    return s[alive].astype(np.int64), np.add.reduceat(alive, first, dtype=np.int64)


def agenda(p: Pieces, symbols: list[int], key: int, limit: int, offered: list[int] | None = None) -> list[int]:
    """One unit on a heap of candidates; `offered` takes the terms of all of them."""
    n = len(symbols)
    s, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and s[i] < p.base and s[j] < p.base and (m := p.merges.get((s[i] << 16) | s[j])):
            term = (s[i] * _LEFT + s[j] * _RIGHT + i * _AT) & _MASK
            if offered is not None:
                offered.append(term)
            if not limit or _mix((key + term) & _MASK) >= limit:
                heapq.heappush(heap, (m[0], i, m[1], s[i], s[j]))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    while heap:
        _, i, new, a, b = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or s[i] != a or s[j] != b:
            continue
        s[i], alive[j], after[i] = new, False, after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [x for x, ok in zip(s, alive, strict=True) if ok]


def to_bytes(p: Pieces, s: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replaces characters without a piece by the pieces of their bytes."""
    odd = s >= p.base
    if not odd.any():
        return s, owner
    c = np.where(odd, s - p.base, 0)
    n = np.where(odd, 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000), 1)
    start = np.cumsum(n) - n
    c, wide, k = np.repeat(c, n), np.repeat(n, n), np.arange(n.sum()) - np.repeat(start, n)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[wide]
    byte = np.where(k == 0, lead | (c >> (6 * (wide - 1))), 0x80 | ((c >> (6 * (wide - 1 - k))) & 0x3F))
    return np.where(np.repeat(odd, n), p.byte0 + byte, np.repeat(s, n)), np.repeat(owner, n)


def merge_units(p: Pieces, symbols: np.ndarray, start: np.ndarray, size: np.ndarray, keys: np.ndarray, limit: int, offered: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each unit symbols[start:start+size], one after another, and how many each has; `offered` as in lockstep."""
    long = (size > LONG) | (symbols[start] >= p.base)
    short, rest = np.flatnonzero(~long), np.flatnonzero(long)
    place = np.arange(size[short].sum()) - np.repeat(np.cumsum(size[short]) - size[short], size[short])
    own: list = []
    s, count = lockstep(p, symbols[np.repeat(start[short], size[short]) + place], size[short], keys[short], limit, None if offered is None else own)
    u = np.repeat(short, count)
    if offered is not None:
        offered += [(short[i], terms) for i, terms in own]
    if len(rest):
        terms: list[list[int]] = [[] for _ in rest]
        more = [agenda(p, symbols[start[i] : start[i] + size[i]].tolist(), int(keys[i]), limit, None if offered is None else t) for i, t in zip(rest, terms, strict=True)]
        if offered is not None:
            offered.append((np.repeat(rest, [len(t) for t in terms]), np.array([x for t in terms for x in t], np.uint64)))
        s, u = np.concatenate([s, *(np.array(m, np.int64) for m in more)]), np.concatenate([u, np.repeat(rest, [len(m) for m in more])])
        order = np.argsort(u, kind="stable")
        s, u = s[order], u[order]
    s, u = to_bytes(p, s, u)
    return s, np.bincount(u, minlength=len(start))


class Runs:
    """Runs of values, one after another."""

    def __init__(self, values: np.ndarray, count: np.ndarray):
        self.values, self.count = values, count
        self.first = np.cumsum(count) - count
        self.room: list[np.ndarray] = []

    def __add__(self, other: Runs) -> Runs:
        """Both in the memory behind self, if it has room (else in more of it): what another sum with self has put there is lost."""
        out = Runs.__new__(Runs)
        parts = [(self.values, other.values), (self.count, other.count), (self.first, other.first + len(self.values))]
        out.room = list(self.room) or [a for a, _ in parts]
        for k, (a, b) in enumerate(parts):
            n = len(a) + len(b)
            if len(out.room[k]) < n:
                out.room[k] = np.empty(n + n // 4, a.dtype)
                out.room[k][: len(a)] = a
            out.room[k][len(a) : n] = b
        out.values, out.count, out.first = (room[: len(a) + len(b)] for room, (a, b) in zip(out.room, parts, strict=True))
        return out

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of those runs, and how many each has."""
        n = self.count[which]
        total = np.cumsum(n)
        return self.values[np.repeat(self.first[which] - (total - n), n) + np.arange(total[-1] if len(n) else 0)], n


def merged_plain(p: Pieces, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[Runs, Runs]:
    """Ids of each unit without dropout, and the terms of the candidates that were offered."""
    offered: list[tuple[np.ndarray, np.ndarray]] = []
    ids, count = merge_units(p, symbols, start, size, np.zeros(len(start), np.uint64), 0, offered)
    u, terms = (np.concatenate(x) for x in zip(*offered, strict=True)) if offered else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return Runs(ids, count), Runs(terms[np.argsort(u, kind="stable")], np.bincount(u, minlength=len(start)))


class Merged:
    """Units merged before without dropout, by key: their ids and the terms of their candidates. Keys are sorted, here and in calls."""

    def __init__(self):
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.terms = Runs(np.zeros(0, np.int32), np.zeros(0, np.int32)), Runs(np.zeros(0, np.uint64), np.zeros(0, np.int32))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The places of keys, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[i] == keys, self.place[i], -1).astype(np.int64)

    def add(self, keys: np.ndarray, ids: Runs, terms: Runs) -> None:
        n, i = len(self.place), np.searchsorted(self.keys, keys)
        self.ids, self.terms = ids, terms
        self.keys, self.place = np.insert(self.keys, i, keys), np.insert(self.place, i, np.arange(n, n + len(keys)))


def encode_texts(p: Pieces, texts: list[str], seed: int, rate: float, kept: int = KEPT, known: Merged | None = None, row_keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and the number of each text's ids. `known` grows to `kept` units."""
    limit = min(int(rate * 2**64), _MASK)
    points = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    if not len(points):
        return np.zeros(0, np.int64), lengths
    row = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    symbols = p.char[points]
    odd, space = symbols >= p.base, points == 0x20
    cut = np.ones(len(points), bool)
    cut[1:] = (row[1:] != row[:-1]) | (space[1:] & ~space[:-1]) | odd[1:] | odd[:-1]
    start = np.flatnonzero(cut)
    size = np.diff(np.append(start, len(points)))
    keys = segment_hash(points, start, size)
    different, pick, back = np.unique(keys, return_index=True, return_inverse=True)
    known = Merged() if known is None else known
    at = known.find(different)
    new = np.flatnonzero(at < 0)
    more_ids, more_terms = merged_plain(p, symbols, start[pick[new]], size[pick[new]])
    ids, terms = known.ids + more_ids, known.terms + more_terms
    at[new] = len(known.place) + np.arange(len(new))
    if len(known.place) + len(new) <= kept:
        known.add(different[new], ids, terms)
    which = at[back]
    if limit:
        owner = row[start]
        text_first = np.searchsorted(owner, np.arange(len(texts)))
        nth = (np.arange(len(start)) - text_first[owner]).astype(np.uint64)
        salt = np.zeros(len(texts), np.uint64)
        filled = np.flatnonzero(lengths)
        salt[filled] = np.add.reduceat(keys * (nth * np.uint64(2) + np.uint64(1)), text_first[filled])
        if row_keys is not None:
            salt += mix64(row_keys)
        own = mix64(keys + mix64(salt[owner] + nth * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)))
        offered, n = terms.take(which)
        hit = mix64(np.repeat(own, n) + offered) < np.uint64(limit)
        skips = np.unique(np.repeat(np.arange(len(start)), n)[hit])
        some, count = merge_units(p, symbols, start[skips], size[skips], own[skips], limit)
        which[skips] = len(ids.count) + np.arange(len(skips))
        ids += Runs(some, count)
    ids, n = ids.take(which)
    total = np.cumsum(n)
    bounds = np.append(0, total)[np.searchsorted(np.flatnonzero(cut), np.append(0, np.cumsum(lengths)))]
    return ids, np.diff(bounds)


def slices(column: pa.Array, most: int = 1 << 18) -> Iterator[pa.Array]:
    """A column of strings without nulls in slices of up to `most` characters, or of one text."""
    total = np.append(0, np.cumsum(pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)))
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
        yield column.slice(i, j - i)
        i = j


def utf8(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings between `ends` in data; bytes that are no UTF-8, which no encoded text gives, are replaced."""
    try:
        data.tobytes().decode()
        if ends[-1] < 1 << 31:
            return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))
    except UnicodeDecodeError:
        pass
    return pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.large_string())


def encoded(p: Pieces, column: pa.Array, salts: np.ndarray, seed: int, rate: float) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Slices of a column without nulls, with the ids of all texts in one array and the number of each text's ids."""
    known, at = Merged(), 0
    for part in slices(column):
        ids, n = encode_texts(p, part.to_pylist(), seed, rate, known=known, row_keys=salts[at : at + len(part)])
        yield part, ids.astype(np.int32, copy=False), n
        at += len(part)


def decoded(p: Pieces, ids: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts whose ids lie between `limits`, which begin at 0, and the number of each text's bytes."""
    n = p.sizes[ids]
    total = np.append(0, np.cumsum(n))
    got = p.bytes[np.repeat(p.starts[ids] - total[:-1], n) + np.arange(total[-1])]
    ends = total[limits]
    length = np.diff(ends)
    led = np.flatnonzero(length)  # texts that aren't empty have one space in front
    led = led[got[ends[led]] == 0x20]
    length[led] -= 1
    return np.delete(got, ends[led]), length


def coders(spark: SparkSession, path: str = MODEL, seed: int = 8, rate: float = 0.1):
    """Functions encode and decode of coder(), and both(text, row key) -> struct of ids and lossless (they decode to the text), in one pass."""
    shared = spark.sparkContext.broadcast(vars(Pieces(path)))

    def salted(keys: pa.Array) -> np.ndarray:
        return keys.fill_null(0).to_numpy().view(np.uint64)

    def lists(ids: list[np.ndarray], count: list[np.ndarray]) -> pa.Array:
        limits = np.cumsum(np.concatenate([np.zeros(1, np.int64), *count]), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(limits), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))

    @F.arrow_udf("array<int>")
    def encode_rows(column: pa.Array, keys: pa.Array) -> pa.Array:
        ids, count = [], []
        for _, some, n in encoded(Pieces.of(shared.value), column.fill_null(""), salted(keys), seed, rate):
            ids.append(some)
            count.append(n)
        return lists(ids, count)

    @F.arrow_udf("struct<ids: array<int>, lossless: boolean>")
    def both_rows(column: pa.Array, keys: pa.Array) -> pa.Array:
        p = Pieces.of(shared.value)
        ids, count, same = [], [], [pa.array([], pa.bool_())]
        for part, some, n in encoded(p, column.fill_null(""), salted(keys), seed, rate):
            ids.append(some)
            count.append(n)
            data, length = decoded(p, some, np.append(0, np.cumsum(n)))
            back = utf8(data, np.append(0, np.cumsum(length)))
            same.append(pc.equal(back, part.cast(back.type)))
        return pa.StructArray.from_arrays([lists(ids, count), pa.concat_arrays(same)], ["ids", "lossless"])

    def keyed(f):
        return lambda text, key=None: f(text, F.lit(0).cast("long") if key is None else key.cast("long"))

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        p = Pieces.of(shared.value)
        limits, ids = column.offsets.to_numpy(), column.values.to_numpy()
        flat, size = [np.zeros(0, np.uint8)], [np.zeros(1, np.int64)]
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(limits, limits[i] + (1 << 17), "right")) - 1)
            data, length = decoded(p, ids[limits[i] : limits[j]], limits[i : j + 1] - limits[i])
            flat.append(data)
            size.append(length)
            i = j
        return utf8(np.concatenate(flat), np.cumsum(np.concatenate(size)))

    return keyed(encode_rows), decode, keyed(both_rows)


def coder(spark: SparkSession, path: str = MODEL, seed: int = 8, rate: float = 0.1):
    """Column functions encode(text, row key) -> array<int>, where a null row key is none, and decode(ids) -> string for one vocabulary."""
    return coders(spark, path, seed, rate)[:2]


def encode_documents(docs: DataFrame, path: str = MODEL, seed: int = 8, rate: float = 0.1, text: str = "text", key: Column | None = None) -> DataFrame:
    """Adds ids, n_ids and lossless (the ids decode to the text). key, a long, is the row key.

    Both come from one function: Spark would run encode a second time inside decode(encode(text)).
    """
    *_, both = coders(docs.sparkSession, path, seed, rate)
    name = fresh(docs, "_coded")
    out = docs.withColumn(name, both(F.coalesce(F.col(text).cast("string"), F.lit("")), key))
    ids = F.col(name)["ids"]
    return out.withColumns({"ids": ids, "n_ids": F.size(ids).cast("long"), "lossless": F.col(name)["lossless"]}).drop(name)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs).select("doc_id", "n_ids", "lossless", "ids")
