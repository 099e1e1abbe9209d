"""Operator 11: how filters interact, as a product of histograms with incidence matrices.

1. Each text gets a mask: bit i is 1 if it fails filter i. Four filters look at the text alone; the fifth, "equal to an
   earlier row's text", needs the smallest id of each text, which is taken per digest and part, then per digest.
2. Each part has three histograms over the 2^k masks: all rows, the good ones, the toxic ones.
3. What an order of filters does at a step to a row depends on its mask only. So all orders and steps are columns of
   integer matrices of 0 and 1 (32 by 600 for five filters), and every count is a histogram times a matrix.

No text is shuffled, and no count is taken more than once: after the masks the work doesn't depend on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, spread

#: The last letter is the filter on repeated texts.
LETTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
#: Over so many tasks rows without an id are dealt.
SALTS = 64


def text_failures(text: Column, words: Column) -> list[Column]:
    """Filters A to D: whether a text (and its array of words) fails each."""
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    return [n < 50, 100 * distinct < 65 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]


def mask_histograms(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: the rows of each part with each mask.

    Null texts and parts are empty strings. A null id is not smaller or larger than any: such rows never fail E and have no
    labels. Of several rows that label one id, one with a 1 suffices. Repeated rows with one id count each; none is earlier
    than the other. A text's group holds one row for each of its parts when E is settled, whatever its number of copies.
    """
    column = lambda name: F.col(f"`{name}`")
    some = spread(df.select(column(id_col).cast("long").alias("doc_id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(column(part_col).cast("string"), F.lit("")).alias("part")))
    words = some.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    mask = sum((F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(text_failures(F.col("text"), F.col("words")))), F.lit(0))
    rows = words.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("h")).groupBy("doc_id", "h", "part", "mask").agg(F.count("*").alias("n"))
    one = lambda name: F.max(F.when(F.col(name) == 1, F.lit(1)).otherwise(F.lit(0))).cast("long").alias(name)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality"), one("toxic"))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("h"), F.lit(SALTS))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("salt", salt).join(known.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
    times = lambda name: (F.col("n") * F.coalesce(name, F.lit(0))).alias(name)
    rows = rows.select("doc_id", "h", "part", "mask", "n", times("quality"), times("toxic"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n", "quality", "toxic"))).alias("first")
    parts = rows.groupBy("h", "part").agg(F.first("mask").alias("mask"), F.sum("n").alias("n"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), first)
    parts = parts.withColumn("here", F.coalesce(F.col("first.doc_id") == F.min("first.doc_id").over(Window.partitionBy("h")), F.lit(False)))
    held = lambda name: F.when(F.col("here"), F.col(f"first.{name}")).otherwise(0)
    passed = F.struct("mask", (F.col("no_id") + held("n")).alias("n"), held("quality").alias("good"), held("toxic").alias("toxic"))
    failed = F.struct((F.col("mask") + F.lit(1 << 4)).alias("mask"), (F.col("n") - F.col("no_id") - held("n")).alias("n"), (F.col("quality") - held("quality")).alias("good"), (F.col("toxic") - held("toxic")).alias("toxic"))
    both = parts.select("part", F.explode(F.array(passed, failed)).alias("x")).select("part", "x.*").where("n > 0")
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def outcome_matrices(letters: str = LETTERS) -> tuple[list[str], dict[str, np.ndarray], np.ndarray]:
    """The orders; for kept, removed, redundant and unique a matrix with a row for each mask and a column for each order and
    step; and the filter of each column."""
    k = len(letters)
    orders = ["".join(p) for p in permutations(letters)]
    own = np.array([[letters.index(x) for x in o] for o in orders])  # order by step
    before = np.cumsum(1 << own, axis=1) - (1 << own)
    own, before = own.ravel(), before.ravel()
    masks = np.arange(1 << k)[:, None]
    fails, gone = masks >> own & 1 > 0, masks & before > 0
    cells = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": masks == 1 << own}
    return orders, {name: m.astype(np.int64) for name, m in cells.items()}, own


def audit(histograms: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The columns of SCHEMA for each part, order and step, from part, mask, n, good, toxic."""
    k, out = len(letters), arrow_schema(SCHEMA)
    packed = histograms.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 2^k for a part

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, matrices, own = outcome_matrices(letters)
        per_filter = (own[:, None] == np.arange(k)).astype(np.int64)
        steps = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)))
        names = pa.array(np.repeat(np.array(orders, object), k), pa.string())
        for b in batches:
            for part, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = np.zeros((3, 1 << k), np.int64)  # all, good and toxic rows by mask
                for c in cells:
                    h[:, c["mask"]] += (c["n"], c["good"], c["toxic"])
                got = {name: h @ m for name, m in matrices.items()}
                of_orders = (got["removed"][0] @ per_filter)[own]
                cols = [got["kept"][0], got["removed"][0], got["redundant"][0], got["unique_fails"][0], got["removed"][1], got["removed"][2], of_orders]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(names), pa.string()), names, steps, *map(pa.array, cols)], schema=out)

    return packed.mapInArrow(multiply, SCHEMA)


def audit_documents(df: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """What each of the five filters does to each part in each order; no row for an empty table."""
    return audit(mask_histograms(df, labels, **columns))
