"""Operator 13: phrases of two to four words that stand together more often than their parts do.

1. Words are counted per language. A word is known by a 64-bit hash from there on; a second seed is tried should two words
   share one.
2. A bit table of fixed size says which words reach the least count, a counter table of fixed size which pairs of such words
   can. No phrase that is asked for crosses what can't, so the windows of four words end there.
3. Each shard keeps its windows as a count trie of depth four: sorted rows of four hashes, those after the end zero, and how
   often each is there. A node is a run of rows with one prefix, its count the run's sum.
4. A trie leaves its shard serialised, cut into ranges of prefixes of two words (by a hash of these, so a common word's
   phrases are in all ranges). A range's sorted pieces from all shards are merged, and a walk over the merged rows gives
   its nodes; only those that are frequent enough come out.
5. A node's parent is what is left without its last word, its suffix link leads to what is left without its first. The
   counts along the parents are the left parts of its cuts, those along the links the right parts. A phrase inside a
   longer one that is nearly as frequent goes; it suffices to look at phrases one word longer, as these hold the others.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Blocks, arrow_schema, destroyed, dropped, give_back, grid, kept, saved, slices, spread, summed_counts, word_lists
from .components import salted
from .jaccard import mixed

DEPTH, LEAST, TOP, SHARE = 4, 30, 2000, 80
#: Bits of the table of frequent words (1 MB) and counters of the table of pairs (64 MB in a task).
WORD_BITS, COUNTERS = 1 << 23, 1 << 24
#: Words whose codes a task remembers.
REMEMBERED = 300_000
#: A mark that no word can hold stands for each place where a text is split; line ends of all kinds are such places.
BREAK = b"."
_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", BREAK * 10)
#: Windows that a task keeps before it writes its trie.
HELD = 2_000_000
NODE = "lang string, depth int, g array<bigint>, f long"
#: Words of the corpus for a range: the windows of a range are far fewer.
RANGE_WORDS = 4_000_000


def marked_words(texts: list[str]) -> Iterator[list[bytes]]:
    """The lower-cased words of texts, with a break between pieces and around each text."""
    line = BREAK.join(t.encode() for t in texts).lower().translate(_BREAKS)  # of bytes: only A-Z change
    yield [BREAK]
    yield from word_lists(line.replace(BREAK, b" " + BREAK + b" "))
    yield [BREAK]


def by_language(b: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    """The texts of each language of a batch of lang and text."""
    got: dict[str, list[str]] = {}
    for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
        got.setdefault(lang, []).append(text)
    yield from got.items()


def codes(words: list[bytes], seed: int) -> np.ndarray:
    """A number for each word; 0 for a break."""
    h = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], np.uint64)
    h[h == np.uint64(xxhash.xxh3_64_intdigest(BREAK, seed))] = 0
    return h


def salt_of(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def word_slots(c: np.ndarray, lang: str) -> np.ndarray:
    return (mixed(c ^ salt_of(lang)) % np.uint64(WORD_BITS)).astype(np.int64)


def slots(h: np.ndarray, lang: str) -> np.ndarray:
    """The counter of each two neighbours."""
    with np.errstate(over="ignore"):
        return (mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] ^ salt_of(lang)) % np.uint64(COUNTERS)).astype(np.int64)


def set_bits(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of these bits of a packed table are set."""
    return bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 > 0


class Coder(dict):
    """Words of a language to codes, 0 for breaks and for words whose bit isn't set; remembers REMEMBERED of them, or a list's."""

    def __init__(self, lang: str, seed: int, bits: np.ndarray):
        self.lang, self.seed, self.bits = lang, seed, bits

    def learn(self, words: list[bytes]) -> None:
        new = [w for w in set(words) if w not in self]
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list(set(words))
        if new:
            c = codes(new, self.seed)
            c[~set_bits(self.bits, word_slots(c, self.lang))] = 0
            self.update(zip(new, c.tolist(), strict=True))

    def of(self, texts: list[str]) -> np.ndarray:
        parts = []
        for words in marked_words(texts):
            self.learn(words)
            parts.append(np.fromiter(map(self.__getitem__, words), np.uint64, len(words)))
        return np.concatenate(parts)


def coder(lang: str, seed: int, bits: np.ndarray) -> Coder:
    """This task's coder; `slices` clears what tasks before it kept."""
    held = kept("codes")
    if sum(map(len, held.values())) > REMEMBERED:
        held.clear()
    if lang not in held:
        held[lang] = Coder(lang, seed, bits)
    return held[lang]


def count_words(texts: DataFrame, seed: int) -> DataFrame:
    """lang, code, word, other, f: other is another word with this code, else the same; saved."""
    out = arrow_schema(schema := "lang string, code long, word string, f long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                c.pop(BREAK, None)
                words = list(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(codes(words, seed).view(np.int64)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(list(c.values()), pa.int64())], schema=out)
            held.clear()

        for b in slices(batches):
            for lang, some in by_language(b):
                c = held.setdefault(lang, Counter())
                for words in marked_words(some):
                    c.update(words)
            if sum(map(len, held.values())) > 400_000:
                yield from emptied()
        yield from emptied()

    rows = texts.mapInArrow(run, schema)
    return saved(rows.groupBy("lang", "code").agg(F.min("word").alias("word"), F.max("word").alias("other"), F.sum("f").alias("f")))


def bits_of(frequent: DataFrame) -> np.ndarray:
    """A bit for each word of frequent (lang, code), packed: 1 MB whatever their number."""

    def mark(c: np.ndarray, b: pa.RecordBatch) -> None:
        langs, h = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy().view(np.uint64)
        for lang in set(langs.tolist()):
            c[word_slots(h[langs == lang], lang)] = 1

    return np.packbits(summed_counts(frequent.select("lang", "code"), mark, WORD_BITS) > 0)


def pair_bits(texts: DataFrame, seed: int, bits: np.ndarray, least: int) -> np.ndarray:
    """A bit for each counter of pairs that reaches least, packed: 2 MB. Pairs share counters, so none that reaches it is lost."""
    sent = texts.sparkSession.sparkContext.broadcast(bits)

    def count(c: np.ndarray, b: pa.RecordBatch) -> None:
        for lang, some in by_language(b):
            h = coder(lang, seed, sent.value).of(some)
            np.add.at(c, slots(h, lang)[(h[:-1] != 0) & (h[1:] != 0)], 1)

    out = np.packbits(summed_counts(texts, count, COUNTERS) >= least)
    destroyed(sent)
    return out


def windows(h: np.ndarray, go_on: np.ndarray) -> np.ndarray:
    """DEPTH columns: from each place that can go on, the words up to where they can't, at most DEPTH."""
    at = np.flatnonzero(go_on)
    out = np.zeros((len(at), DEPTH), np.uint64)
    open_ = np.ones(len(at), bool)
    out[:, 0] = h[at]
    for d in range(1, DEPTH):
        before = at + d - 1
        open_ &= (before < len(go_on)) & go_on[np.minimum(before, len(go_on) - 1)]
        out[open_, d] = h[at[open_] + d]
    return out


def trie_rows(w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct windows in order and their counts, of rows that may be sorted in pieces; the sort goes through such
    pieces as runs."""
    order = np.arange(len(w))
    for d in reversed(range(DEPTH)):
        order = order[np.argsort(w[order, d], kind="stable")]
    w, n = w[order], n[order]
    first = np.flatnonzero(np.append(True, (w[1:] != w[:-1]).any(axis=1))) if len(w) else np.zeros(0, np.int64)
    return w[first], np.add.reduceat(n, first) if len(first) else n


_TYPES = ["<u8"] * DEPTH + ["<i8"]


def shard_tries(texts: DataFrame, seed: int, bits: np.ndarray, pairs: np.ndarray, n_ranges: int) -> DataFrame:
    """lang, block and the packed pieces of all shards' sorted tries."""
    sent = texts.sparkSession.sparkContext.broadcast((bits, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        word_bits, pair_bits_ = sent.value

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang in sorted(held):
                w = np.concatenate(held[lang])
                w, n = trie_rows(w, np.ones(len(w), np.int64))
                with np.errstate(over="ignore"):
                    block = (mixed(w[:, 0] * np.uint64(0xC2B2AE3D27D4EB4F) + w[:, 1]) % np.uint64(n_ranges)).astype(np.int64)
                for b in Blocks.pack((block, list(zip([*w.T, n], _TYPES, strict=True)))) if len(n) else ():
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * b.num_rows, pa.string()), *b.columns], ["lang", *b.schema.names])
            held.clear()

        for b in slices(batches):
            for lang, some in by_language(b):
                h = coder(lang, seed, word_bits).of(some)
                go_on = (h[:-1] != 0) & (h[1:] != 0)
                go_on[go_on] = set_bits(pair_bits_, slots(h, lang)[go_on])
                held.setdefault(lang, []).append(windows(h, go_on))
            if sum(len(w) for x in held.values() for w in x) > HELD:
                yield from emptied()
        yield from emptied()

    return texts.mapInArrow(run, "lang string, " + Blocks.schema(len(_TYPES)))


def walk(w: np.ndarray, n: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Depth, keys and counts of the nodes of depth 2 and more of sorted rows that reach least."""
    changed = np.append(True, w[1:, 0] != w[:-1, 0]) if len(w) else np.zeros(0, bool)
    for depth in range(2, DEPTH + 1):
        changed[1:] |= w[1:, depth - 1] != w[:-1, depth - 1]
        starts = np.flatnonzero(changed)
        f = np.add.reduceat(n, starts) if len(starts) else n
        some = (f >= least) & (w[starts, depth - 1] != 0)
        yield depth, w[starts[some], :depth], f[some]


def frequent_nodes(tries: DataFrame, least: int) -> DataFrame:
    """NODE rows: the nodes of depth 2 and more that reach least, saved."""
    out = arrow_schema(NODE)

    def merge(keys: tuple[pa.Scalar, ...], tab: pa.Table) -> pa.Table:
        *c, n = Blocks.unpack(tab, _TYPES)
        found = list(walk(*trie_rows(np.stack(c, axis=1), n), least))
        g = pa.chunked_array([pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(k).view(np.int64).ravel()), d).cast(pa.list_(pa.int64())) for d, k, _ in found])
        f, depth = np.concatenate([x for *_, x in found]), np.concatenate([np.full(len(x), d, np.int32) for d, _, x in found])
        give_back()
        return pa.table({"lang": pa.array([keys[0].as_py()] * len(f), pa.string()), "depth": pa.array(depth), "g": g, "f": pa.array(f)}).cast(out)

    return saved(tries.groupBy("lang", "block").applyInArrow(merge, NODE))


def score(a: Column, parts: Column) -> Column:
    """floor(2000000 a / parts); products pass 64 bits."""
    return F.call_function("div", a.cast("decimal(19,0)") * F.lit(2_000_000).cast("decimal(7,0)"), parts.cast("decimal(20,0)"))


def phrases(frequent_words: DataFrame, nodes: DataFrame) -> DataFrame:
    """lang, g, phrase, f, lefts, rights of each node: the counts of its left parts from one word on, and of the right parts
    that go with them. frequent_words: lang, code, word, f."""
    level = frequent_words.select(F.struct("lang", F.array("code").alias("g")).alias("node"), F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array().cast("array<bigint>").alias("lefts"), F.array().cast("array<bigint>").alias("rights"))
    levels = []
    for depth in range(2, DEPTH + 1):
        above = level.select(F.col("node").alias("parent"), F.col("phrase").alias("begin"), F.array_append("lefts", F.col("f")).alias("lefts"))
        linked = level.select(F.col("node").alias("link"), "last", F.array_prepend("rights", F.col("f")).alias("rights"))
        some = nodes.where(F.col("depth") == depth).select(F.struct("lang", "g").alias("node"), "f")
        some = some.withColumn("parent", F.struct("node.lang", F.slice("node.g", 1, depth - 1).alias("g"))).withColumn("link", F.struct("node.lang", F.slice("node.g", 2, depth - 1).alias("g")))
        level = salted(salted(some, above, "parent", "link", merged=True), linked, "link", "parent", merged=True)  # no level goes through the driver
        level = saved(level.select("node", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "f", "lefts", "rights"))
        levels.append(level)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.select("node.lang", "node.g", "phrase", "f", "lefts", "rights")


def top_phrases(df: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE, text_col: str = "text", lang_col: str = "lang", seed: int = 0) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the first `top` phrases of those found `least` times.

    A phrase scores by its lowest cut, the first of equal ones. One inside a longer phrase that is found at least `share`
    hundredths as often is left out. Null texts are empty, a null language is `und`; repeated rows count each; words and
    texts may be of any length. Other columns don't matter, and an empty table gives no rows.
    """
    texts = spread(df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")))
    words = count_words(texts, seed)
    while words.where("word <> other or code = 0").limit(1).count():
        dropped(words)
        seed += 1
        words = count_words(texts, seed)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= least)
    bits = bits_of(frequent)
    n_ranges = grid(texts, totals.agg(F.sum("n").alias("n")).first()["n"] or 0, RANGE_WORDS)
    nodes = frequent_nodes(shard_tries(texts, seed, bits, pair_bits(texts, seed, bits, least), n_ranges), least)
    found = phrases(frequent, nodes)
    longer = nodes.where("depth > 2").select("lang", F.explode(F.array(F.expr("slice(g, 1, depth - 1)"), F.expr("slice(g, 2, depth - 1)"))).alias("g"), "f").groupBy("lang", "g").agg(F.max("f").alias("longer"))
    left = found.join(longer.hint("merge"), ["lang", "g"], "left").where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(19,0)") < share * F.col("f").cast("decimal(19,0)")))
    cuts = F.zip_with("lefts", "rights", lambda x, y: F.struct(x.alias("l"), y.alias("r")))
    cuts = F.transform(cuts, lambda x, k: F.struct(score(F.col("f"), x["l"].cast("decimal(19,0)") + x["r"].cast("decimal(19,0)")).alias("score"), k.alias("k"), x["l"].alias("l"), x["r"].alias("r")))
    scored = left.withColumn("cut", F.array_min(cuts)).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    first = scored.withColumn("rank", rank).where(F.col("rank") <= top)  # Spark keeps the first of each task before it shuffles
    out = saved(first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    dropped(words, nodes)
    return out
