"""Operator 8: n-gram Jaccard join as a blocked product of the document by n-gram incidence with its transpose.

1. A document's set of shingles is hashed; documents with equal sets are one class.
2. Shingles are ordered by how common they are (by a count table of fixed size), then by hash. Two sets that are
   alike enough share a shingle among the first n - ceil(3n/4) + 1 of each, so only these columns enter the product.
3. Columns are dealt into blocks. A block's task sorts its entries and multiplies column by column: pairs within the
   size bound get a count, and the last places of shared columns bound what can still come. Columns of more than `run`
   classes give no pairs; a few pivots of theirs are paired with the others instead.
4. Pairs whose bound falls short go. Of the rest, each class's best partner and the pivots are held against the whole
   sets first; then, from what is left, only pairs (and pairs within long columns) whose classes aren't joined yet.
   Within a long column the places bound what two sets can share if this column is the first that they share; sets whose
   first one is short, but which share long ones too, are kept by their number of long columns (`beside`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Blocks, arrow_schema, carried, destroyed, dropped, give_back, grid, saved, slices, spread, summed_counts, two_columns
from .components import components, salted

WORDS, COUNTERS = 5, 1 << 22
_M = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: str, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence if there are fewer words; none without words."""
    words = text.encode().lower().split()  # bytes: only A-Z change, and only space and \x09-\x0d separate
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        k = min(k, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out + h[i : len(h) - k + 1 + i]) * _M
        return np.unique(mixed(out))


def set_key(s: np.ndarray) -> bytes:
    """16 bytes that stand for the set."""
    return xxhash.xxh3_128_digest(s.tobytes())


def row_key(doc: int | None, text: str) -> bytes:
    """16 bytes that stand for a row: rows with one id and different texts have different ones."""
    return xxhash.xxh3_128_digest(f"{doc}:".encode() + text.encode())


def number_of(key: bytes, clash: frozenset[int] = frozenset()) -> int:
    """A class's number: the first half of its key; the second half where two keys have one first half."""
    cid = int.from_bytes(key[:8], "little", signed=True)
    return int.from_bytes(key[8:], "little", signed=True) if cid in clash else cid


#: 64-bit numbers of a set's signature.
SIGNATURE = 4


def signature(s: np.ndarray) -> list[int]:
    """Whether an even or odd number of shingles falls on each of 64 * SIGNATURE bits; two sets' signatures differ in no
    more bits than the sets do in shingles."""
    return np.packbits(np.bincount((s >> np.uint64(20)).astype(np.int64) % (64 * SIGNATURE), minlength=64 * SIGNATURE) & 1 > 0).view("<i8").tolist()


def prefix_length(n: int) -> int:
    """The first so many of n shingles, in any one order, meet those of every set that is 3/4 alike."""
    return n - -(-3 * n // 4) + 1


def ordered(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Keys that sort rare shingles first: the logarithm of the count in the top byte, then the hash."""
    seen = counts[(s >> np.uint64(42)).astype(np.int64)]
    return np.sort(np.floor(np.log2(np.maximum(seen, 1))).astype(np.uint64) << np.uint64(56) | s >> np.uint64(8))


def run_pairs(at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within the runs that begin at `at`."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(length).tolist():
        i, j = np.triu_indices(n, 1)
        some = at[length == n][:, None]
        left.append((some + i).ravel())
        right.append((some + j).ravel())
    return np.concatenate(left), np.concatenate(right)


PAIR = "kind int, a long, b long, na int, nb int, n int, pa int, pb int, qa int, qb int, key long"
PIVOTS = 2
_TYPES = ["<i8", "<i4", "<u8", "<i4"]


#: Pairs of one block that are looked at together.
MOST_PAIRS = 1_000_000


def added_up(c: list[np.ndarray]) -> list[np.ndarray]:
    """One row for each pair (columns 0 and 1): sizes, the sum of the counts, the last and the first places."""
    order = np.lexsort((c[1], c[0]))
    c = [v[order] for v in c]
    if not len(order):
        return c
    first = np.flatnonzero(np.append(True, (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])))
    return [*(v[first] for v in c[:4]), np.add.reduceat(c[4], first), *(np.maximum.reduceat(v, first) for v in c[5:7]), *(np.minimum.reduceat(v, first) for v in c[7:])]


def product(tab: pa.Table, run: int) -> pa.Table:
    """One block of the product: kind 0, pairs with counts and last places; 1, members of long columns with their places; 2, pairs with pivots.

    pa, pb: the last places of the columns that a pair shares; qa, qb: the first."""
    cid, n, key, place = Blocks.unpack(tab, _TYPES)
    order = np.lexsort((cid, key))
    cid, n, key, place = cid[order], n[order], key[order], place[order]
    fresh = np.append(True, (key[1:] != key[:-1]) | (cid[1:] != cid[:-1]))
    cid, n, key, place = cid[fresh], n[fresh].astype(np.int64), key[fresh], place[fresh]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    length = np.diff(np.append(at, len(key)))
    out = []
    short = np.flatnonzero((length > 1) & (length <= run))
    sums: list[np.ndarray] = []
    part = np.cumsum(length[short] * (length[short] - 1) // 2) // MOST_PAIRS  # so many pairs are looked at together
    for k in np.unique(part).tolist():
        i, j = run_pairs(at[short[part == k]], length[short[part == k]])
        fits = 4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j])
        i, j = i[fits], j[fits]
        new = [cid[i], cid[j], n[i], n[j], np.ones(len(i), np.int64), *(place[x].astype(np.int64) for x in (i, j, i, j))]
        sums = added_up([np.concatenate(c) for c in zip(sums, new, strict=True)] if sums else new)
    if sums and len(sums[0]):
        out.append((np.zeros(len(sums[0]), np.int64), *sums, np.zeros(len(sums[0]), np.int64)))
    for s, m in zip(at[length > run].tolist(), length[length > run].tolist(), strict=True):
        c, size, at_c = cid[s : s + m], n[s : s + m], place[s : s + m].astype(np.int64)
        zero = np.zeros(m, np.int64)
        out.append((zero + 1, c, c, size, size, zero, at_c, at_c, at_c, at_c, np.full(m, key[s : s + 1].view(np.int64)[0])))
        band = np.floor(np.log(size) / np.log(4 / 3)).astype(np.int64)
        luck = mixed(c.astype(np.uint64))
        for x in np.unique(band).tolist():
            inside = np.flatnonzero(band == x)
            for p in inside[np.argsort(luck[inside])[:PIVOTS]].tolist():
                q = np.flatnonzero((np.abs(band - x) <= 1) & (7 * np.minimum(size - at_c, size[p] - at_c[p]) >= 3 * (size + size[p])) & (c != c[p]))
                z = np.zeros(len(q), np.int64)
                a, b = np.minimum(c[q], c[p]), np.maximum(c[q], c[p])
                na, nb = np.where(c[q] < c[p], size[q], size[p]), np.where(c[q] < c[p], size[p], size[q])
                out.append((z + 2, a, b, na, nb, z, z, z, z, z, z))
    schema = arrow_types(PAIR)
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * len(schema)
    got = pa.Table.from_arrays([pa.array(c, pa.int64()).cast(schema.field(i).type) for i, c in enumerate(cols)], schema=schema)
    two = got.filter(pa.compute.equal(got["kind"], 2)).group_by(schema.names).aggregate([])
    return pa.concat_tables([got.filter(pa.compute.not_equal(got["kind"], 2)), two.select(schema.names).cast(schema)])


def arrow_types(ddl: str) -> pa.Schema:
    """The Arrow schema of int, long and binary columns, without a session."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[t]) for name, t in (x.split() for x in ddl.split(", "))])


def document_sets(texts: DataFrame) -> DataFrame:
    """doc_id, row_key, n (size of the set), cid and other (numbers for the set), k (16 bytes for it; null for an empty set), its signature."""
    marks = [f"s{i}" for i in range(SIGNATURE)]
    schema = "doc_id long, row_key binary, n int, cid long, other long, k binary, " + ", ".join(f"{m} long" for m in marks)
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            keys = [set_key(s) if len(s) else None for s in sets]
            other = [None if k is None else int.from_bytes(k[8:], "little", signed=True) for k in keys]
            cids = [None if k is None else number_of(k) for k in keys]
            signs = [pa.array(x, pa.int64()) for x in zip(*map(signature, sets), strict=True)] or [pa.array([], pa.int64())] * SIGNATURE
            rows = pa.array(map(row_key, b.column(0).to_pylist(), b.column(1).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), rows, pa.array(map(len, sets), pa.int32()), pa.array(cids, pa.int64()), pa.array(other, pa.int64()), pa.array(keys, pa.binary()), *signs], schema=out)

    return texts.mapInArrow(run, schema)


def _fresh(seen: set, cid: int, most: int = 100_000) -> bool:
    """Whether a task meets this set for the first time, as far as it remembers."""
    if cid in seen:
        return False
    if len(seen) >= most:
        seen.clear()
    seen.add(cid)
    return True


def candidate_pairs(texts: DataFrame, n_blocks: int, run: int, clash: frozenset[int]) -> DataFrame:
    """PAIR rows of all blocks, saved."""

    def count(c: np.ndarray, b: pa.RecordBatch) -> None:
        got = np.concatenate([shingles(t) for t in b.column(1).to_pylist()] or [np.zeros(0, np.uint64)])
        c += np.bincount((got >> np.uint64(42)).astype(np.int64), minlength=COUNTERS)

    sent = texts.sparkSession.sparkContext.broadcast(summed_counts(texts, count, COUNTERS).astype(np.uint32))  # 16 MB, whatever the input

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, blocks = sent.value, set(), Blocks(n_blocks, _TYPES)
        for b in slices(batches):
            got = []
            for t in b.column(1).to_pylist():
                s = shingles(t)
                if not len(s):
                    continue
                cid = number_of(set_key(s), clash)
                if _fresh(seen, cid):
                    keys = ordered(s, counts)[: prefix_length(len(s))]
                    got.append((np.full(len(keys), cid, np.int64), np.full(len(keys), len(s), np.int32), keys, np.arange(len(keys), dtype=np.int32)))
            if got:
                cols = [np.concatenate(c) for c in zip(*got, strict=True)]
                with np.errstate(over="ignore"):
                    yield from blocks.add((mixed(cols[2]) % np.uint64(n_blocks)).astype(np.int64), *cols)
        yield from blocks.flush()

    def multiply(keys: tuple[pa.Scalar, ...], tab: pa.Table) -> pa.Table:
        out = product(tab, run)
        give_back()
        return out

    out = saved(texts.mapInArrow(emit, Blocks.schema(4)).groupBy("block").applyInArrow(multiply, PAIR))
    destroyed(sent)
    return out


#: Bits of the filter that tells which sets to gather: 1 MB.
FILTER = 1 << 23


def gathered_texts(texts: DataFrame, wanted: DataFrame, clash: frozenset[int]) -> DataFrame:
    """cid, s, saved: a text, compressed, for each set in wanted (column cid). It takes a third of the room of its shingles' hashes.
    A filter of fixed size goes to the scan, so other texts (but few) aren't shuffled."""

    def mark(c: np.ndarray, b: pa.RecordBatch) -> None:
        c[b.column(0).to_numpy().view(np.uint64) % np.uint64(FILTER // 8)] = 1

    bits = np.packbits(summed_counts(wanted.select("cid"), mark, FILTER // 8) > 0)
    sent = texts.sparkSession.sparkContext.broadcast(bits)
    schema = "cid long, s binary"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, seen, press = np.unpackbits(sent.value), set(), zstandard.ZstdCompressor(level=3)
        for b in slices(batches):
            ids, sets = [], []
            for t in b.column(1).to_pylist():
                s = shingles(t)
                if len(s):
                    cid = number_of(set_key(s), clash)
                    if there[(cid & 0xFFFFFFFFFFFFFFFF) % (FILTER // 8)] and _fresh(seen, cid):
                        ids.append(cid)
                        sets.append(press.compress(t.encode()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], schema=out)

    out = saved(texts.mapInArrow(run, schema).join(wanted.select("cid"), "cid").groupBy("cid").agg(F.first("s").alias("s")))
    destroyed(sent)
    return out


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose whole sets satisfy 100 |A and B| >= 75 |A or B|."""
    both = pairs.select("a", "b").join(sets.withColumnsRenamed({"cid": "a", "s": "sa"}), "a").join(sets.withColumnsRenamed({"cid": "b", "s": "sb"}), "b")
    out = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = zstandard.ZstdDecompressor()
        seen: dict[int, np.ndarray] = {}

        def whole(cid: int, z: bytes) -> np.ndarray:
            if cid not in seen:
                if len(seen) >= 64:
                    seen.clear()
                seen[cid] = shingles(back.decompress(z).decode())
            return seen[cid]

        for b in slices(batches):
            keep = []
            for i, j, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, y = whole(i, x), whole(j, y)
                n = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * n >= 75 * (len(x) + len(y) - n))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], schema=out)

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def linked_documents(df: DataFrame, run: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row: the smallest doc_id that links reach, itself included.

    Null or empty texts have no shingles, no links and their own id. Equal rows are linked like any equal texts. Rows
    with a null id take part, and have a null component only if no row of theirs has an id.
    """
    docs = document_classes(df, run, id_col, text_col)
    least = docs.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"))
    return salted(docs, least, "c", "row", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(df: DataFrame, carry: list[str], run: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the columns in carry: of each group of linked documents the row with the smallest doc_id (without
    ids, or of rows with one id, that with the smallest row key; of equal ones the smallest in the other columns). Rows
    without words are linked with nothing and all stay. Texts move once, compressed.
    """
    docs = document_classes(df, run, id_col, text_col)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    kept = docs.where("c is not null").groupBy("c").agg(F.min_by("row_key", first).alias("row_key")).select("row_key", F.lit(True).alias("kept"))
    texts, rest = carried(df, id_col, text_col, carry)
    out, back_to = arrow_schema(schema := f"doc_id long, row_key binary, empty boolean, z binary, rest {rest}"), arrow_schema(plain := f"doc_id long, text string, rest {rest}")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, part, n = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0
        for b in slices(batches):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            empty = [not t.encode().split(None, 1) for t in texts]
            keys = [f"{part}:{n + i}".encode() if e else row_key(d, t) for i, (d, t, e) in enumerate(zip(ids, texts, empty, strict=True))]  # empty rows have keys of their own
            n += len(ids)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(empty, pa.bool_()), pa.array([press.compress(t.encode()) for t in texts], pa.binary()), b.column(2)], schema=out)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = zstandard.ZstdDecompressor()
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([back.decompress(z).decode() for z in b.column(1).to_pylist()], pa.string()), b.column(2)], schema=back_to)

    packed = texts.mapInArrow(pack, schema).join(kept, "row_key", "left").where("empty or kept")
    one = packed.groupBy("row_key").agg(F.min(F.struct("rest", "doc_id", "z")).alias("r")).select("r.doc_id", "r.z", "r.rest")
    return one.mapInArrow(unpack, plain).select("doc_id", "text", *(F.col("rest")[c].alias(c) for c in carry))


def document_classes(df: DataFrame, run: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row_key, n, c (a number for the component; null for an empty set), row, saved."""
    texts = spread(two_columns(df, id_col, text_col))
    sets = saved(document_sets(texts))
    marks = [f"s{i}" for i in range(SIGNATURE)]
    full = sets.where("n > 0")
    per = full.groupBy("cid").agg(F.first("n").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    # two of n sets share a 64-bit number with odds of n^2 / 2^65, so the list of such numbers is empty or very short
    said = per.agg(F.sum(F.col("n") - F.ceil(F.col("n") * 0.75) + 1).alias("t"), F.collect_list(F.when(F.col("lo") != F.col("hi"), F.col("cid"))).alias("clash")).first()
    entries, clash = said["t"] or 0, frozenset(said["clash"])
    number = F.when(F.col("cid").isin(*clash), F.col("other")).otherwise(F.col("cid")) if clash else F.col("cid")
    sets_at, sets = sets, sets.withColumn("cid", number)
    signs = sets.where("n > 0").groupBy("cid").agg(*(F.first(m).alias(m) for m in marks))
    found = candidate_pairs(texts, grid(df, entries, 600_000) // 2 + 1, run, clash)
    sums = found.where("kind = 0").groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("n").alias("n"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.min("qa").alias("qa"), F.min("qb").alias("qb"))
    enough = lambda overlap: 7 * overlap >= 3 * (F.col("na") + F.col("nb"))
    bound = F.col("n") + F.least(F.col("na") - 1 - F.col("pa"), F.col("nb") - 1 - F.col("pb"))
    from_first = F.least(F.col("na") - F.col("qa"), F.col("nb") - F.col("qb"))  # nothing is shared before the first
    possible = saved(sums.where(enough(from_first)).withColumn("sure", enough(bound)).withColumn("bound", bound).select("a", "b", "na", "nb", "n", "bound", "sure"))
    pairs = possible.where("sure").select("a", "b", "n")
    long_columns = found.where("kind = 1").select("key", F.col("a").alias("cid"), F.col("na").alias("n"), F.col("qa").alias("q"))
    of_long = long_columns.groupBy("cid").agg(F.count("*").alias("m"))
    held = lambda side: of_long.withColumnsRenamed({"cid": side, "m": f"m{side}"})
    beside = possible.where("not sure").join(held("a"), "a").join(held("b"), "b").where(enough(F.col("bound") + F.least("ma", "mb"))).select("a", "b")

    best = lambda x, y: pairs.groupBy(x).agg(F.max_by(y, F.struct("n", y)).alias(y))
    first = saved(best("a", "b").select("a", "b").union(best("b", "a").select("a", "b")).union(found.where("kind = 2").select("a", "b")).distinct())
    ends = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).union(long_columns.select("cid")).distinct()
    whole = gathered_texts(texts, ends, clash)
    links = saved(alike(first, whole))
    label, tried = components(links), first
    apart = sum((F.bit_count(F.col(f"{m}a").bitwiseXOR(F.col(f"{m}b"))) for m in marks), F.lit(0))  # no more than the shingles of one of the two
    fits = enough(F.least(F.col("na") - F.col("qa"), F.col("nb") - F.col("qb"))) & (7 * apart <= F.col("na") + F.col("nb"))
    named = lambda df, side: df.withColumnsRenamed({"n": f"n{side}", "q": f"q{side}", "c": f"c{side}"} | {m: f"{m}{side}" for m in marks})

    def open_columns() -> DataFrame:
        """Members of the long columns in which not all are joined yet, with their components."""
        members = long_columns.join(label.withColumnRenamed("v", "cid"), "cid", "left").select("key", "cid", "n", "q", F.coalesce("c", "cid").alias("c"))
        split = members.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
        return saved(members.join(split, "key").join(signs, "cid"))

    def verified(some: DataFrame) -> DataFrame:
        """The labels after the pairs that haven't been tried are held against the whole texts."""
        nonlocal links, tried
        new = saved(some.distinct().join(tried, ["a", "b"], "left_anti"))
        more = saved(alike(new, whole))
        links, tried = links.union(more), tried.union(new)
        return components(links) if more.limit(1).count() else label

    for turn in range(2):  # a few other pivots join most of what a long column has left, at a cost linear in it
        left = open_columns()
        if not left.limit(1).count():
            break
        lucky = lambda k: F.min(F.struct(F.xxhash64("cid", F.lit(k)), "cid", "n", "q", "c", *marks)).alias(f"p{k}")  # noqa: E731, B023
        pivots = left.groupBy("key").agg(*(lucky(4 * turn + k) for k in range(4)))
        pivots = pivots.select("key", F.explode(F.array(*(f"p{4 * turn + k}" for k in range(4)))).alias("p")).select("key", F.col("p.cid").alias("y"), *(F.col(f"p.{x}").alias(x) for x in ("n", "q", "c", *marks)))
        near = named(left, "a").join(named(pivots, "b"), "key").where((F.col("ca") != F.col("cb")) & fits)
        label = verified(near.select(F.least("cid", "y").alias("a"), F.greatest("cid", "y").alias("b")))

    of = lambda side: label.withColumnsRenamed({"v": side, "c": f"c{side}"})
    rest = pairs.select("a", "b").union(beside).join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    left = open_columns()
    label = verified(rest.union(column_pairs(left, named).where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fits).select("a", "b")))

    docs = salted(sets.withColumn("row", F.monotonically_increasing_id()), label.withColumnRenamed("v", "cid"), "cid", "row", "left")
    docs = saved(docs.select("doc_id", "row_key", "n", F.coalesce("c", "cid").alias("c"), "row"))
    dropped(sets_at, found, possible, first, whole)
    return docs


def column_pairs(left: DataFrame, named: Callable[[DataFrame, str], DataFrame], part: int = 2048) -> DataFrame:
    """Pairs within long columns whose sizes are close enough (a band of sizes and its neighbours), each way round. A
    column's band of more than `part` members is cut in parts, and each pair of parts is a task's key of its own."""
    band = left.withColumn("band", F.floor(F.log(F.col("n")) / F.log(F.lit(4 / 3))))
    size = band.groupBy("key").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    band = band.join(size, "key").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    x = named(band.withColumn("pb_", every).withColumnRenamed("own", "pa_").drop("parts"), "a").withColumnRenamed("cid", "a")
    y = named(band.withColumn("pa_", every).withColumnRenamed("own", "pb_").drop("parts").withColumn("band", F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1))))), "b").withColumnRenamed("cid", "b")
    return x.join(y, ["key", "band", "pa_", "pb_"])
