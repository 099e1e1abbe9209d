"""Operator 9: removal of repeated word windows, found by recompression.

Each text's words are symbols. A first step names maximal runs of a word, each further step names pairs: every symbol
falls on the left or right by a bit of its name and the step's number, and a left one followed by a right one becomes one
symbol. A name is a hash of what it stands for, so all documents, wherever they are processed, agree on it: equal
passages have equal symbols inside, and only near their ends does the text around them matter. For each symbol the parse
keeps how far the words that decided it reach.

Spark rounds make the names global: a round's job counts the symbols of its step over all documents and leaves a filter
of fixed size of those that stand in several places; the next round counts only symbols all of whose parts are repeated.
A window of a repeated passage holds repeated symbols only, so a window in which some round finds a symbol that stands
nowhere else is unique. The others go, for each place of the highest symbol that is decided inside them, to one block by
that symbol, where they are compared with all windows around its other places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Blocks, arrow_schema, carried, destroyed, dropped, give_back, grid, saved, slices, spread, two_columns
from .jaccard import mixed, row_key

WINDOW, ROUNDS = 35, 6
#: The steps after which a Spark round counts the symbols; -1 are the words.
NAMED = (-1, 1, 3, 5)
#: Bits of each round's filter of repeated symbols, 4 MB: large enough to be selective, and of one size whatever the input's.
FILTER = 1 << 25
_M = np.uint64(0x9E3779B97F4A7C15)
_P = (np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5))
_INVERSE = tuple(np.uint64(pow(int(p), -1, 1 << 64)) for p in _P)


def words_of(text: str) -> list[bytes]:
    """bytes.split() separates at space and \\x09-\\x0d only."""
    return text.encode().split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All documents' words in one row, a symbol that stands nowhere else after each; and each document's beginning."""
    parts, at = [], [0]
    for i, d in enumerate(docs):
        parts += [d, mixed(np.array([i + 1], np.uint64) * _M)]
        at.append(at[-1] + len(d) + 1)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(at, np.int64)


def steps(h: np.ndarray, n: int = ROUNDS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The step's number (-1: the words), its symbols, the first word and the end of the words that decided each, and
    whether it is alive: the caller may clear that for some, and then it is cleared for what they become part of."""
    live = np.ones(len(h), np.bool_)
    yield -1, h, np.arange(len(h)), np.arange(1, len(h) + 1), live
    with np.errstate(over="ignore"):
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        size = np.diff(np.append(at, len(h)))
        s = np.where(size > 1, mixed(h[at] + _M * size.astype(np.uint64)), h[at])
        lo, hi, live = at - 1, at + size + 1, live[at]  # that a run ends is seen from the words beside it
        for r in range(n):
            bit = mixed(s + np.uint64(r + 1) * _M) & np.uint64(1) > 0
            pair = np.flatnonzero(~bit[:-1] & bit[1:])
            second = np.zeros(len(s), np.bool_)
            second[pair + 1] = True
            t, e, f, both = s.copy(), lo.copy(), hi.copy(), live.copy()
            # a left symbol alone was decided by the next one, a right symbol alone by the one before
            left = np.flatnonzero(~bit[:-1])
            f[left] = hi[left + 1]
            right = np.flatnonzero(bit[1:] & ~second[1:]) + 1
            e[right] = lo[right - 1]
            t[pair] = mixed(mixed(s[pair] ^ np.uint64(r)) + _M * s[pair + 1])
            both[pair] &= live[pair + 1]
            if len(s):
                if bit[0]:
                    e[0] = -1
                if not bit[-1]:
                    f[-1] = len(h) + 1
            keep = ~second
            s, lo, hi, live = t[keep], e[keep], f[keep], both[keep]
            yield r, s, lo, hi, live


def slot(name: np.ndarray) -> np.ndarray:
    return (name % np.uint64(FILTER)).astype(np.int64)


def repeated(bits: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Whether each name is in the filter."""
    at = slot(name)
    return bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 > 0


def candidates(h: np.ndarray, at: np.ndarray, filters: dict[int, np.ndarray], window: int = WINDOW, n: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Beginnings of the windows without a unique symbol, their documents' numbers, and for each the name of a symbol
    decided inside it, of the highest step that has one: that with the lowest hash, so equal windows take equal ones."""
    starts, doc = window_starts(at, window)
    edge = np.zeros(len(h) + 2, np.int64)
    levels = []
    for r, s, lo, hi, live in steps(h, n):
        if r in filters:
            live &= repeated(filters[r], s)
            dead = np.flatnonzero(~live & (lo >= 0) & (hi - lo <= window) & (hi <= len(h)))  # no window that begins here may stay
            np.add.at(edge, np.maximum(hi[dead] - window, 0), 1)
            np.add.at(edge, lo[dead] + 1, -1)
        levels.append((s, lo, hi))
    fine = np.cumsum(edge)[:-1][starts] == 0
    starts, doc = starts[fine], doc[fine]
    name, todo = np.zeros(len(starts), np.uint64), np.arange(len(starts))
    for level in range(len(levels) - 1, -1, -1):
        if not len(todo):
            break
        s, lo, hi = levels[level]
        begin = starts[todo]
        first, last = np.searchsorted(lo, begin, "left"), np.searchsorted(hi, begin + window, "right") - 1
        ok = first <= last
        where, first, last = todo[ok], first[ok], last[ok]
        with np.errstate(over="ignore"):
            rank = mixed(s + np.uint64(level) * _M)
        got = rank[first] if len(first) else rank[:0]
        for k in range(1, int((last - first).max()) + 1 if len(first) else 0):
            got = np.minimum(got, rank[np.minimum(first + k, last)])
        name[where] = got
        todo = todo[~ok]
    return starts, doc, name


def window_starts(at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings of all windows that lie in one document, and the documents' numbers."""
    count = np.maximum(np.diff(at) - window, 0)  # a document of n words takes n + 1 places and has n - window + 1 windows
    doc = np.repeat(np.arange(len(count)), count)
    return np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + at[:-1][doc], doc


def window_hashes(h: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window's word sequence, from running sums."""
    out = []
    with np.errstate(over="ignore"):
        for p, q in zip(_P, _INVERSE, strict=True):
            power = np.cumprod(np.append(np.uint64(1), np.full(len(h), p, np.uint64)), dtype=np.uint64)
            back = np.cumprod(np.append(np.uint64(1), np.full(len(h), q, np.uint64)), dtype=np.uint64)
            total = np.append(np.uint64(0), np.cumsum(mixed(h ^ p) * power[:-1], dtype=np.uint64))
            out.append(mixed((total[starts + window] - total[starts]) * back[starts]))
    return out[0], out[1]


def repeated_symbols(texts: DataFrame, step: int, sent, n_rounds: int) -> np.ndarray:
    """One Spark round: a filter, FILTER bits, of the symbols of this step that stand in two places or more, by the rounds
    before (sent: a broadcast of their filters). Each task sends a symbol once, with a mark if it met it twice."""
    n_blocks = min(1 << max(6, 2 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length(), 1024)
    width = FILTER // n_blocks

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, held, size = sent.value, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            name, n = np.unique(np.concatenate(held), return_counts=True)
            once, twice = name[n == 1], name[n > 1]
            every = np.arange(n_blocks)
            for b in Blocks.pack((every, []), (slot(once) // width, [(once, "<u8")]), (slot(twice) // width, [(twice, "<u8")])):
                yield b

        for b in slices(batches):
            h, _ = joined([hashes(words_of(t)) for t in b.column(1).to_pylist()])
            for r, s, _, _, live in steps(h, step + 1):
                if r in filters:
                    live &= repeated(filters[r], s)
                if r == step:
                    held.append(s[live])
                    size += len(held[-1])
            if size >= 1_000_000:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def count(keys: tuple[pa.Scalar, ...], tab: pa.Table) -> pa.Table:
        once, twice = Blocks.unpack(tab, ["<u8", "<u8"])
        once = np.sort(once)
        marks = np.zeros(width, np.bool_)
        marks[slot(once[1:][once[1:] == once[:-1]]) % width] = True
        marks[slot(twice) % width] = True
        out = pa.table({"block": pa.array([keys[0].as_py()], pa.int64()), "c0": pa.array([np.packbits(marks).tobytes()], pa.binary())})
        give_back()
        return out

    rows = texts.mapInArrow(emit, Blocks.schema(2)).groupBy("block").applyInArrow(count, Blocks.schema(1)).toArrow()
    out = np.zeros(FILTER // 8, np.uint8)
    for k, c in zip(rows.column("block").to_pylist(), rows.column("c0").to_pylist(), strict=True):
        out[k * width // 8 : (k + 1) * width // 8] = np.frombuffer(c, np.uint8)
    return out


COVERED = "key binary, places binary"
#: Runs of windows: the row's key, the first window's place, how many, and what they are; then the windows' hashes.
_RUN, _HASH = ["<u8", "<u8", "<i4", "<i4", "<u1"], ["<u8", "<u4"]
_PLACE = ["<u8", "<u8", "<i4", "<i4"]
OPEN, SETTLED, KNOWN = 0, 1, 2


def runs_of(first: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and lengths of the runs in which `first` goes up by one and the other columns stay."""
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = first[1:] != first[:-1] + 1
    for c in same:
        cut |= c[1:] != c[:-1]
    at = np.flatnonzero(np.append(True, cut))
    return at, np.diff(np.append(at, len(first)))


class Windows:
    """A task's candidate windows. Those that it meets twice are settled here: only their places, and one window for all
    of them, leave, so a window that very many rows share sends two rows' worth for each flush."""

    def __init__(self, n_blocks: int, most: int = 400_000):
        self.n, self.most, self.held, self.keys, self.size = n_blocks, most, [], [], 0

    def add(self, keys: list[bytes], doc: np.ndarray, start: np.ndarray, name: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        used, own = np.unique(doc, return_inverse=True)
        self.held.append((own + len(self.keys), start, (name % np.uint64(self.n)).astype(np.int64), x, y.astype(np.uint32)))
        self.keys += [keys[i] for i in used.tolist()]
        self.size += len(doc)
        if self.size >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        doc, start, block, x, y = (np.concatenate(c) for c in zip(*self.held, strict=True))
        key = np.frombuffer(b"".join(self.keys), "<u8").reshape(-1, 2)
        self.held, self.keys, self.size = [], [], 0
        order = np.lexsort((y, x))
        new = np.append(True, (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1]))
        n = np.diff(np.append(np.flatnonzero(new), len(order)))
        many = np.zeros(len(order), np.bool_)
        many[order] = np.repeat(n > 1, n)
        known = np.sort(order[new][n > 1])
        alone = np.flatnonzero(~many)
        at, size = runs_of(start[alone], doc[alone], block[alone])
        open_run = alone[at]
        twice = np.flatnonzero(many)
        at2, size2 = runs_of(start[twice], doc[twice], block[twice])
        done = np.stack([key[doc[twice[at2]], 0], key[doc[twice[at2]], 1], start[twice[at2]].astype(np.uint64), size2.astype(np.uint64), block[twice[at2]].astype(np.uint64)], 1)
        done = np.unique(done, axis=0) if len(done) else done  # equal rows
        per_block, count = np.unique(block[known], return_counts=True)
        zero = np.zeros(len(per_block), np.uint64)
        join = lambda *c: np.concatenate([v.astype(np.uint64) for v in c])
        runs = (
            join(block[open_run], done[:, 4], per_block).astype(np.int64),
            [(join(key[doc[open_run], 0], done[:, 0], zero), "<u8"), (join(key[doc[open_run], 1], done[:, 1], zero), "<u8"), (join(start[open_run], done[:, 2], zero), "<i4"),
             (join(size, done[:, 3], count), "<i4"), (np.repeat([OPEN, SETTLED, KNOWN], [len(open_run), len(done), len(zero)]), "<u1")],
        )
        sent = np.append(alone, known)
        yield from Blocks.pack(runs, (block[sent], [(x[sent], "<u8"), (y[sent], "<u4")]))


def verified(tab: pa.Table, n_groups: int) -> Iterator[pa.RecordBatch]:
    """The places of one block's windows that stand somewhere else too, packed by groups of rows."""
    k0, k1, start, size, kind = Blocks.unpack(tab, _RUN)
    x, y = (np.frombuffer(b"".join(tab.column(f"c{len(_RUN) + i}").to_pylist()), t) for i, t in enumerate(_HASH))
    hashed = np.where(kind == SETTLED, 0, size)
    owner = np.repeat(np.arange(len(size)), hashed)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(hashed) - hashed, hashed)
    order = np.lexsort((y, x))
    new = np.append(True, (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])) if len(order) else np.zeros(0, np.bool_)
    first = np.flatnonzero(new)
    weight = np.add.reduceat(np.where(kind[owner[order]] == KNOWN, 2, 1), first) if len(first) else first
    there = np.zeros(len(order), np.bool_)
    there[order] = np.repeat(weight > 1, np.diff(np.append(first, len(order))))
    got = np.flatnonzero(there & (kind[owner] == OPEN))
    at, length = runs_of(place[got], owner[got])
    run, begin = owner[got][at], start[owner[got][at]] + place[got][at]
    done = np.flatnonzero(kind == SETTLED)
    a, b = np.append(k0[run], k0[done]), np.append(k1[run], k1[done])
    s, n = np.append(begin, start[done]), np.append(length, size[done])
    return Blocks.pack(((a % np.uint64(n_groups)).astype(np.int64), list(zip((a, b, s, n), _PLACE, strict=True))))


def gathered(tab: pa.Table) -> pa.Table:
    """COVERED rows of one group: for each key the merged intervals of its windows' beginnings, as pairs of 32-bit numbers."""
    k0, k1, start, size = Blocks.unpack(tab, _PLACE)
    order = np.lexsort((start, k1, k0))
    k0, k1, start, end = k0[order], k1[order], start[order], start[order].astype(np.int64) + size[order]
    edge = np.flatnonzero(np.append(True, (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1]))) if len(k0) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(k0))))
    reach = np.maximum.accumulate(end + (owner << 33)) - (owner << 33) if len(k0) else end  # the farthest end of this key so far
    new = np.append(True, (owner[1:] != owner[:-1]) | (start[1:] > reach[:-1])) if len(k0) else np.zeros(0, np.bool_)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(k0)) - 1 if len(at) else at
    pairs = np.stack([start[at].astype("<i4"), reach[last].astype("<i4")], 1)
    cuts = np.searchsorted(owner[at], np.arange(len(edge) + 1))
    keys = np.stack([k0[edge], k1[edge]], 1).astype("<u8")
    return pa.table({"key": pa.array([k.tobytes() for k in keys], pa.binary()), "places": pa.array([pairs[i:j].tobytes() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())})


def repeated_windows(texts: DataFrame, window: int = WINDOW, n_rounds: int = ROUNDS) -> DataFrame:
    """COVERED, saved: the beginnings of each row's windows whose word sequence begins anywhere else too. Rows without
    any don't come; equal rows come once."""
    total = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_blocks, sc = grid(texts, total // 20), texts.sparkSession.sparkContext
    sent = sc.broadcast({})
    for step in (s for s in NAMED if s < n_rounds):
        filters = sent.value | {step: repeated_symbols(texts, step, sent, n_rounds)}
        destroyed(sent)
        sent = sc.broadcast(filters)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, held = sent.value, Windows(n_blocks)
        for b in slices(batches):
            data = [t.encode() for t in b.column(1).to_pylist()]
            h, at = joined([hashes(d.split()) for d in data])
            starts, doc, name = candidates(h, at, filters, window, n_rounds)
            if len(starts):
                x, y = window_hashes(h, starts, window)
                ids = b.column(0).to_pylist()
                keys = {i: row_key(ids[i], data[i].decode()) for i in np.unique(doc).tolist()}
                yield from held.add([keys.get(i, b"") for i in range(len(data))], doc, starts - at[:-1][doc], name, x, y)
        yield from held.flush()

    n_groups = 2 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def verify(keys: tuple[pa.Scalar, ...], tab: pa.Table) -> pa.Table:
        rows = list(verified(tab, n_groups))
        give_back()
        return pa.Table.from_batches(rows) if rows else pa.table({"block": pa.array([], pa.int64()), **{f"c{i}": pa.array([], pa.binary()) for i in range(len(_PLACE))}})

    def gather(keys: tuple[pa.Scalar, ...], tab: pa.Table) -> pa.Table:
        out = gathered(tab)
        give_back()
        return out

    found = texts.mapInArrow(emit, Blocks.schema(len(_RUN) + len(_HASH))).groupBy("block").applyInArrow(verify, Blocks.schema(len(_PLACE)))
    out = saved(found.groupBy("block").applyInArrow(gather, COVERED))
    destroyed(sent)
    return out


def remove_repeats(df: DataFrame, window: int = WINDOW, n_rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, keep_layout: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one space) of each row, and the columns in carry.

    A word goes if a window of `window` words that covers it stands anywhere else too, in another place of the same
    text or in another row; equal rows are two places. Null, empty and short texts lose nothing. Only the places of
    repeated windows meet their text, in one join by id; the text travels compressed. keep_layout: texts that lose no
    word stay as they are.
    """
    docs, rest = carried(df, id_col, text_col, carry or [])
    docs = spread(docs)
    places = repeated_windows(docs.select("doc_id", "text"), window, n_rounds)
    schema = f"doc_id long, key binary, z binary, rest {rest}"
    packed = arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in slices(batches):
            data = [t.encode() for t in b.column(1).to_pylist()]
            keys = [row_key(i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array([press.compress(d) for d in data], pa.binary()), b.column(2)], schema=packed)

    result = f"doc_id long, n_words long, n_removed long, kept string, rest {rest}"
    out = arrow_schema(result)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = zstandard.ZstdDecompressor()
        for b in slices(batches):
            rows = []
            for z, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                text = back.decompress(z).decode()
                words = words_of(text)
                n = len(words)
                if spans:
                    edge = np.zeros(n + 1, np.int64)
                    start, end = np.frombuffer(spans, "<i4").reshape(-1, 2).T
                    np.add.at(edge, start, 1)
                    np.add.at(edge, end - 1 + window, -1)
                    covered = np.cumsum(edge)[:-1] > 0
                    words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                same = keep_layout and len(words) == n
                rows.append((n, n - len(words), text if same else b" ".join(words).decode()))
            cols = (pa.array(c, out.field(i + 1).type) for i, c in enumerate(zip(*rows, strict=True)))
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, b.column(3)], schema=out)

    done = docs.mapInArrow(pack, schema).join(places, "key", "left").select("doc_id", "z", "places", "rest").mapInArrow(cut, result)
    return done.select("doc_id", "n_words", "n_removed", "kept", *(F.col("rest")[c].alias(c) for c in carry or []))
