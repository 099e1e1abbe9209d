"""Operator 12: near copies by 64-bit fingerprints, met in the middle of the ball around each.

1. A text's fingerprint has the majority of each bit over the hashes of its shingles. Equal fingerprints are one class.
2. Two fingerprints with at most r different bits (r even) share a variant, a number with at most r / 2 bits changed, and
   all that share a variant have at most r different bits. So fingerprints meet at variants, and no pair is missed.
3. Variants are dealt by k parities, each over every k-th bit. A change of two bits changes at most two parities, so the
   2081 variants (r = 4) of a fingerprint lie in 1 + k + k (k - 1) / 2 blocks. It goes to each of those blocks once, and
   the block makes the variants that belong to it: some hundred bytes a fingerprint are shuffled in place of 16 KB.
4. A block sorts its variants. All members of a run link to its first, checked bit by bit; pairs of a run, which grow with
   its square, are not made. Of a block's links a forest stays: each class and the root that it reaches there. A class
   that has several roots, from different blocks, keeps the smallest, to which the others are linked. So about one link
   a class comes to the components, and whatever links connect stays connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Blocks, arrow_schema, dropped, give_back, saved, slices, spread, two_columns, word_lists
from .components import components, salted

WORDS, SEED, RADIUS, BITS = 4, 42, 4, 64
#: Variants of a block that are held at once.
HELD = 2_000_000


def shingle_hashes(text: str, words: int = WORDS) -> Iterator[np.ndarray]:
    """XXH64 of each shingle, repeats included, in pieces; of the whole sequence if there are fewer words."""
    last: list[bytes] = []
    some = False
    for part in word_lists(text.encode().lower()):  # bytes: only A-Z change
        got = last + part
        if len(got) < words:
            last = got
            continue
        ends = np.cumsum([len(w) + 1 for w in got])
        starts = (ends - [len(w) + 1 for w in got])[: len(got) - words + 1].tolist()
        line = memoryview(b" ".join(got))
        yield np.array([xxhash.xxh64_intdigest(line[a:z], SEED) for a, z in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)
        some, last = True, got[len(got) - words + 1 :]
    if not some and last:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(last), SEED)], np.uint64)


def fingerprint(text: str) -> int:
    """The signed 64-bit number whose bits are 1 where over half of the hashes have a 1; 0 without words."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text):
        n += len(h)
        for i in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(texts: DataFrame) -> DataFrame:
    """doc_id, fp of columns doc_id, text."""
    out = arrow_schema(schema := "doc_id long, fp long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.int64())], schema=out)

    return texts.mapInArrow(run, schema)


def parities(x: np.ndarray, k: int) -> np.ndarray:
    """k bits for each number: bit i is the parity of the bits i, i + k, i + 2k, ..."""
    out = np.zeros(len(x), np.int64)
    for i in range(k):
        every = np.uint64(sum(1 << j for j in range(i, BITS, k)))
        out |= (np.bitwise_count(x & every).astype(np.int64) & 1) << i
    return out


def changes(most: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All masks of at most `most` bits, in the order of their parities, and these parities."""
    masks = np.array([sum(1 << i for i in c) for n in range(most + 1) for c in combinations(range(BITS), n)], np.uint64)
    key = parities(masks, k)
    order = np.argsort(key, kind="stable")
    return masks[order], key[order]


def meetings(block: int, codes: np.ndarray, masks: np.ndarray, key: np.ndarray, radius: int, k: int, held: int = HELD) -> tuple[np.ndarray, np.ndarray]:
    """The links, a < b as signed numbers, among codes that share a variant of this block."""
    codes = np.unique(codes.view(np.int64)).view(np.uint64)  # the first of a run is the smallest signed number
    apart = parities(codes, k) ^ block
    lo, n = np.searchsorted(key, apart, "left"), np.searchsorted(key, apart, "right") - np.searchsorted(key, apart, "left")
    parts = int(-(-n.sum() // held)) or 1
    pairs = [np.zeros((0, 2), np.int64)]
    for part in range(parts):  # a very full block is looked at by a share of its variants after the other
        found = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]]
        for i in range(0, len(codes), step := max(1, held // len(masks))):
            count = n[i : i + step]
            who = np.repeat(np.arange(i, i + len(count)), count)
            at = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count) + lo[who]
            v = codes[who] ^ masks[at]
            if parts > 1:
                mine = (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(parts) == np.uint64(part)
                v, who = v[mine], who[mine]
            found[0].append(v)
            found[1].append(who)
        v, who = map(np.concatenate, found)
        order = np.argsort(v, kind="stable")
        v, who = v[order], who[order]
        same = np.flatnonzero(v[1:] == v[:-1]) + 1
        if not len(same):
            continue
        starts = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        first = who[starts[np.searchsorted(starts, same, "right") - 1]]
        links = np.unique(first * len(codes) + who[same])
        a, b = codes[links // len(codes)], codes[links % len(codes)]
        near = np.bitwise_count(a ^ b) <= radius
        pairs.append(np.stack([a[near].view(np.int64), b[near].view(np.int64)], axis=1))
    return tuple(np.unique(np.concatenate(pairs), axis=0).T)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same numbers, each to the smallest one that it reaches."""
    every, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(every))
    while True:
        new, least = low.copy(), np.minimum(low[x], low[y])
        for side in (x, y, low[x], low[y]):
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    child = np.flatnonzero(low != np.arange(len(every)))
    return every[low[child]], every[child]


def block_bits(n: int, variants: int, least: int, per_block: int = 400_000) -> int:
    """How many parities keep a block's variants near per_block and give `least` blocks."""
    return max(1, min(30, int(np.ceil(np.log2(max(n * variants / per_block, least))))))


def near_links(codes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: pairs of different numbers of column fp that connect whatever numbers of at most `radius` (even) different bits
    connect; saved. Repeated and null numbers are met once or not at all."""
    if radius % 2 or radius < 0:
        raise ValueError("the radius is an even number")
    spark = codes.sparkSession
    k = block_bits(codes.count(), len(changes(radius // 2, 1)[0]), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways, blocks = np.unique(changes(radius // 2, k)[1]), Blocks(1 << k, ["<i8"])
        for b in slices(batches):
            c = b.column(0).drop_null().to_numpy().astype(np.int64)
            for i in range(0, len(c), step := max(1, 200_000 // len(ways))):
                some = c[i : i + step]
                yield from blocks.add((parities(some.view(np.uint64), k)[:, None] ^ ways).ravel(), np.repeat(some, len(ways)))
        yield from blocks.flush()

    def meet(keys: tuple[pa.Scalar, ...], tab: pa.Table) -> pa.Table:
        (c,) = Blocks.unpack(tab, ["<i8"])
        a, b = forest(*meetings(keys[0].as_py(), c.view(np.uint64), *changes(radius // 2, k), radius, k))
        give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    met = codes.select("fp").mapInArrow(emit, Blocks.schema(1)).groupBy("block").applyInArrow(meet, "a long, b long")
    roots = met.groupBy("b").agg(F.collect_set("a").alias("roots")).select("b", "roots", F.array_min("roots").alias("a"))  # one for each of its blocks at most
    return saved(roots.select("a", F.explode(F.array_union("roots", F.array("b"))).alias("b")).where("a <> b").distinct())


def near_copies(df: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of each row: the smallest doc_id that links reach.

    Null texts are empty; texts without words have the fingerprint zero, which links like any other. Equal rows share a
    fingerprint and stay as many rows. Rows with a null id take part; they have a null component only if no row of theirs
    has an id. Columns of other names don't matter; an empty table gives no rows.
    """
    docs = saved(fingerprints(spread(two_columns(df, id_col, text_col))))
    codes = saved(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = near_links(codes, radius)
    joined = components(links)
    members = saved(codes.join(joined.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "least", F.coalesce("c", "fp").alias("c")))
    low = members.groupBy("c").agg(F.min("least").alias("low"))
    of_code = salted(members.select("fp", "c"), low, "c", "fp").select("fp", "low")
    got = salted(docs.withColumn("row", F.monotonically_increasing_id()), of_code, "fp", "row")
    out = saved(got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("low").alias("component_id")))
    dropped(docs, codes, links, members)
    return out
