"""Operator 5: personal data, by pattern and by information-theoretic disclosure.

Patterns give the protected entities: e-mail addresses, IP addresses, card and phone numbers, and secrets (strings with the
entropy of random ones, values named as secret, cards within other digits). The corpus then says which terms in the same texts reveal them: a
term t discloses an entity e if PMI(e; t) is at least `disclosure` times the entity's information content IC(e), that is
if p(e|t) is at least p(e)^(1 - disclosure). For p(e|t) stands a lower bound of what has been counted, so a word that was
seen once with an entity seen once says nothing. Such terms, wherever they stand in a text that holds the entity, become
spans of kind `term`: removed if the entity stands in every text of theirs, else generalised to a placeholder.

All counts are numbers of distinct texts, so that copies of a text add no evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, carried, destroyed, dropped, saved, slices, spread, summed_counts, two_columns

KINDS = ("email", "ip", "card", "phone", "secret", "term")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local_end = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is tried from its first digit only: if that fails, so do the others. Hence linear time.
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_long = re.compile(r"[A-Za-z0-9]{20,}")
_joined = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9]++(?:[_-][A-Za-z0-9]++)+")
_social = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
# What names a secret, and how issued ones begin: fixed values.
NAMES = ("password", "passwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "access_key", "access-key", "private_key")
BEGINNINGS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "sk-", "sk_live_", "sk_test_", "pk_live_", "rk_live_", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")
_named = re.compile(r"(?i:(?<![A-Za-z])(?:" + "|".join(NAMES) + r"))[\x22\x27]?[\x20\x09]*+[:=][\x20\x09]*+[\x22\x27]?([^\s\x22\x27,;]{6,})")
_issued = re.compile(r"(?<![A-Za-z0-9_-])(?:" + "|".join(BEGINNINGS) + r")[A-Za-z0-9_-]{12,}")
_word = re.compile(r"[^\W_]+")
_digits = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _local:
            start -= 1
        m = _domain.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind and start, in code points; matches are leftmost and don't overlap within a kind, and failing ones are dropped."""
    out = [("email", *s) for s in _emails(text)]
    out += [("ip", *m.span()) for m in _ip.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _card.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(d := _digits.sub("", m[0])) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _phone.finditer(text) if 9 <= len(_digits.sub("", m[0])) <= 15]
    return out


def cards_within(text: str, m: re.Match) -> Iterator[tuple[int, int]]:
    """Cards in a match of digits that is none as a whole: from one border of its groups of digits to another, 13 to 19
    digits that pass Luhn, in groups of three or more (so no dates); the leftmost first, of those from one border the longest."""
    groups = [(m.start() + g.start(), m.start() + g.end()) for g in re.finditer("[0-9]+", m[0])]
    i = 0
    while i < len(groups):
        n, last = 0, None
        for j in range(i, len(groups)):
            size = groups[j][1] - groups[j][0]
            n += size
            if n > 19 or size < 3:
                break
            if n >= 13 and _luhn(_digits.sub("", text[groups[i][0] : groups[j][1]])):
                last = j
        if last is not None:
            yield groups[i][0], groups[last][1]
            i = last
        i += 1


def random_looking(s: str, least_bits: float) -> bool:
    """Whether s has 4 digits and 4 letters at least, and so much entropy a letter or digit."""
    c = Counter(x for x in s if x.isalnum())
    n, digits = c.total(), sum(v for k, v in c.items() if k <= "9")
    return 4 <= digits <= n - 4 and -sum(v / n * math.log2(v / n) for v in c.values()) >= least_bits


def secrets(text: str, base: list[tuple[str, int, int]], least_bits: float = 3.0) -> list[tuple[str, int, int]]:
    """What the patterns leave out, by start and apart from base spans and each other:

    strings of 20 or more letters and digits that look random; such strings joined by - or _ with a piece of 8 that has
    both; the value after the name of a secret and : or =; tokens by their beginnings; social security numbers; and cards
    beside other numbers, which a whole match of digits hides.
    """
    found = [m.span() for m in _long.finditer(text) if random_looking(m[0], least_bits)]
    if "_" in text or "-" in text:
        for m in _joined.finditer(text):
            if m.end() - m.start() >= 20 and random_looking(m[0], least_bits) and any(len(p) >= 8 and random_looking(p, 2.0) for p in re.split("[_-]", m[0])):
                found.append(m.span())
        found += [m.span() for m in _issued.finditer(text)]
        found += [m.span() for m in _social.finditer(text)]
    low = text.lower()
    if any(x in low for x in NAMES):
        found += [m.span(1) for m in _named.finditer(text)]
    hold = {(s, e) for k, s, e in base if k == "card"}
    for m in _card.finditer(text):
        if m.end() - m.start() > 13 and m.span() not in hold:
            found += cards_within(text, m)
    out: list[tuple[str, int, int]] = []
    taken = sorted((s, e) for _, s, e in base)
    at = i = 0
    for s, e in sorted(found, key=lambda x: (x[0], -x[1])):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if s >= at and not (i < len(taken) and taken[i][0] < e):
            out.append(("secret", s, e))
            at = e
    return out


def all_spans(text: str) -> list[tuple[str, int, int]]:
    base = base_spans(text)
    return base + secrets(text, base)


def entity(kind: str, found: str) -> int:
    """A number for the protected value, whatever its writing."""
    value = found.lower() if kind == "email" else _digits.sub("", found) if kind in ("card", "phone") else found
    return xxhash.xxh3_64_intdigest(f"{kind}:{value}") - (1 << 63)


def outside(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(term, start, end) of each word, of letters or digits, that touches no span, wherever it stands in the text."""
    taken, i = sorted((s, e) for _, s, e in spans), 0
    for m in _word.finditer(text):
        a, b = m.span()
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if not (i < len(taken) and taken[i][0] < b):
            yield term(m[0]), a, b


def term(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.lower()) - (1 << 63)


FOUND = "doc_id long, row_key string, n_email long, n_ip long, n_card long, n_phone long, base string, more string, entities array<bigint>, text string"


def _told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_base(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's base spans, its secrets (more) and distinct entities, with the text where there are any. row_key tells rows with equal ids and different texts apart."""
    out = arrow_schema(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                base = base_spans(text)
                more = secrets(text, base)
                n = Counter(k for k, *_ in base)
                who = sorted({entity(k, text[s:e]) for k, s, e in base + more})
                rows.append((doc, row_key(doc, text), n["email"], n["ip"], n["card"], n["phone"], _told(base), _told(more), who, text if who else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, out.field(i).type) for i, c in enumerate(zip(*rows, strict=True))], schema=out)

    return two_columns(df, id_col, text_col).mapInArrow(run, FOUND)


def _spans(told: str) -> list[tuple[str, int, int]]:
    return [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in told.split(",") if x)]


def row_key(doc: int | None, text: str) -> str:
    return f"{doc}:{xxhash.xxh3_128_hexdigest(text)}"


#: Bits of the filter of texts that stand in several rows: 1 MB.
COPIES = 1 << 23


def _slot(h: pa.Array) -> np.ndarray:
    return np.array([int(x[:12], 16) % COPIES for x in h.to_pylist()], np.int64)


def term_counts(texts: DataFrame, copied: DataFrame, least: int, most: int = 100_000) -> DataFrame:
    """t, n_t: how many distinct texts hold each term outside their spans, where that is `least` or more.

    copied: h of the texts that stand in several rows. A filter of fixed size tells them from the others at the scan;
    they meet by h, compressed, one a task at most, and count once. Tasks add up locally, about `most` terms at a time.
    """
    out, packed = arrow_schema("t long, n long"), arrow_schema("h string, z binary")

    def mark(c: np.ndarray, b: pa.RecordBatch) -> None:
        c[_slot(b.column(0))] = 1

    sent = texts.sparkSession.sparkContext.broadcast(np.packbits(summed_counts(copied, mark, COPIES) > 0))

    def several(text: str, there: np.ndarray) -> str | None:
        h = xxhash.xxh3_128_hexdigest(text)
        at = int(h[:12], 16) % COPIES
        return h if there[at >> 3] >> (7 - (at & 7)) & 1 else None

    def counted(texts: Iterator[list[str]]) -> Iterator[pa.RecordBatch]:
        c: Counter[int] = Counter()
        known: dict[str, tuple[int, ...]] = {}  # terms of what stands between spaces

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()), pa.array(list(c.values()), pa.int64())], schema=out)
            c.clear()
            known.clear()
            return done

        def terms(text: str) -> set[int]:
            if spans := all_spans(text):
                return {t for t, *_ in outside(text, spans)}
            got: set[int] = set()
            for w in set(text.split()):
                if (ts := known.get(w)) is None:
                    ts = known[w] = tuple(map(term, _word.findall(w)))
                got.update(ts)
            return got

        for some in texts:
            for text in some:
                c.update(terms(text))
                if max(len(c), len(known)) > most:
                    yield flush()
        yield flush()

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from counted([t for t in b.column(1).to_pylist() if several(t, sent.value) is None] for b in slices(batches))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, seen = zstandard.ZstdCompressor(level=3), set()
        for b in slices(batches):
            rows = []
            for t in b.column(1).to_pylist():
                h = several(t, sent.value)
                if h and h not in seen:
                    if len(seen) > most:
                        seen.clear()
                    seen.add(h)
                    rows.append((h, press.compress(t.encode())))
            yield pa.RecordBatch.from_arrays([pa.array(c, packed.field(i).type) for i, c in enumerate(zip(*rows, strict=True) if rows else ([], []))], schema=packed)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = zstandard.ZstdDecompressor()
        yield from counted([back.decompress(z).decode() for z in b.column(0).to_pylist()] for b in slices(batches))

    groups = texts.mapInArrow(pack, "h string, z binary").groupBy("h").agg(F.first("z").alias("z")).select("z")
    both = texts.mapInArrow(alone, "t long, n long").union(groups.mapInArrow(once, "t long, n long"))
    done = saved(both.groupBy("t").agg(F.sum("n").alias("n_t")).where(F.col("n_t") >= least))
    destroyed(sent)
    return done


SALTS = 8


def _salted(many: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """many joined to few; the rows of one key are dealt by their text over SALTS tasks, each with its copy of few."""
    salt = F.pmod(F.xxhash64("h"), F.lit(SALTS))
    return many.withColumn("salt", salt).join(few.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [*keys, "salt"]).drop("salt")


def _terms_of(texts: DataFrame) -> DataFrame:
    """h, t: the distinct terms of each text outside its spans."""
    out = arrow_schema("h string, t long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for h, base, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ts = {t for t, *_ in outside(text, _spans(base))}
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(ts), pa.string()), pa.array(list(ts), pa.int64())], schema=out)

    return texts.select("h", "base", "text").mapInArrow(run, "h string, t long")


def disclosing(held: DataFrame, counts: DataFrame, n_all: int, disclosure: float, certainty: float, doubt: float) -> DataFrame:
    """h, marks: the terms (t, whole) of each text that disclose an entity it holds. held: h, base (all spans), entities,
    text of each distinct text with entities.

    Probabilities are shares of all n_all distinct texts: n_e of them hold the entity, n_t the term, n_et both. The
    lower bound of p(e|t) is n_et / (n_t + doubt^2); it must reach p(e)^(1 - disclosure), and `certainty`. Only pairs
    that can't reach that are left out before they are counted: n_et is n_e at most, so n_t must not exceed `room`.
    """
    mentions = held.select("h", F.explode("entities").alias("e"))
    least = F.greatest(F.pow(F.col("n_e") / n_all, F.lit(1 - disclosure)), F.lit(certainty))
    known = saved(mentions.groupBy("e").agg(F.count("*").alias("n_e")).withColumn("least", least).withColumn("room", F.col("n_e") / F.col("least") * (1 + 1e-9) - doubt**2).where("room >= 1"))
    holders = _salted(mentions, known, ["e"])
    texts = held.select("h", "base", "text").join(holders.select("h").distinct(), "h", "left_semi")
    rare = counts.join(F.broadcast(known.agg(F.max("room").alias("most"))), F.col("n_t") <= F.col("most")).select("t", "n_t")
    pairs = saved(_salted(_terms_of(texts), rare, ["t"]).join(holders, "h").where("n_t <= room").select("h", "e", "t", "n_t", "least"))
    got = pairs.groupBy("e", "t", "n_t", "least").agg(F.count("*").alias("n_et"))
    flagged = got.where(F.col("n_et") / (F.col("n_t") + doubt**2) >= F.col("least") * (1 - 1e-9)).select("e", "t", (F.col("n_et") >= F.col("n_t")).alias("whole"))
    # max whole: a term of two entities is removed if either is wholly determined by it
    marks = _salted(pairs.select("h", "e", "t"), flagged, ["e", "t"]).groupBy("h", "t").agg(F.max("whole").alias("whole"))
    return marks.groupBy("h").agg(F.collect_list(F.struct("t", "whole")).alias("marks"))


PLACED = "doc_id long, row_key string, n_email long, n_ip long, n_card long, n_phone long, base string, more string, terms array<struct<s:int,x:int,whole:boolean>>"


def _places(marked: DataFrame) -> DataFrame:
    """The marked terms at all their places in the text outside its spans."""
    out = arrow_schema(PLACED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for base, more, text, marks in zip(*(b.column(i).to_pylist() for i in (6, 7, 8, 9)), strict=True):
                whole = {p["t"]: p["whole"] for p in marks or []}
                rows.append([{"s": s, "x": x, "whole": whole[t]} for t, s, x in outside(text, _spans(base) + _spans(more)) if t in whole] if whole else [])
            yield pa.RecordBatch.from_arrays([*b.columns[:8], pa.array(rows, out.field(8).type)], schema=out)

    return marked.mapInArrow(run, PLACED)


def find_personal_data(df: DataFrame, disclosure: float = 0.9, certainty: float = 0.25, doubt: float = 2.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key, n_email, n_ip, n_card, n_phone, base (the pattern spans), more (secrets), terms (array of s, x, whole).

    A null text is empty and has no spans. Rows with equal texts have equal spans, whatever their ids, and repeating
    rows changes nothing: all counts are of distinct texts, over all rows, and of words anywhere outside the spans.
    """
    texts = spread(two_columns(df, id_col, text_col))
    found = saved(find_base(texts)).withColumn("h", F.substring_index("row_key", ":", -1))
    groups = saved(found.groupBy("h").agg(F.count("*").alias("n")))
    least = max(1, math.ceil(certainty * doubt**2 / (1 - certainty)))  # rarer terms can't reach certainty
    counts = term_counts(texts, groups.where("n > 1").select("h"), least)
    some = found.where("size(entities) > 0")
    held = some.dropDuplicates(["h"]).select("h", F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.col("more") != "", F.col("more"))).alias("base"), "entities", "text")
    marks = saved(disclosing(held, counts, max(groups.count(), 1), disclosure, certainty, doubt))
    dropped(groups, counts)
    plain = ["doc_id", "row_key", "n_email", "n_ip", "n_card", "n_phone", "base", "more"]
    placed = _places(some.join(marks, "h", "left").select(*plain, "text", "marks"))
    none = F.expr("cast(array() as array<struct<s:int,x:int,whole:boolean>>)")
    return found.where("size(entities) = 0").select(*plain, none.alias("terms")).unionByName(placed)


def span_digests(found: DataFrame) -> DataFrame:
    """doc_id, counts, base_sha256, spans (kind:start:end by kind as listed, then start) and n_spans, how many these are."""
    terms = F.array_join(F.transform("terms", lambda p: F.concat(F.lit("term:"), p["s"].cast("string"), F.lit(":"), p["x"].cast("string"))), ",")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.col("more") != "", F.col("more")), F.when(F.size("terms") > 0, terms))
    n_spans = F.when(spans == "", F.lit(0)).otherwise(F.size(F.split(spans, ","))).cast("long")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base"), 256).alias("base_sha256"), spans.alias("spans"), n_spans.alias("n_spans"))


def redact(text: str, told: str, terms: list) -> str:
    """The text with each span that is told as [KIND]; disclosing terms as [TERM], or taken out if they determine the entity. Of overlapping spans the first, then the longest, counts."""
    marks = [(s, -e, f"[{k.upper()}]") for k, s, e in _spans(told)]
    marks += [(p["s"], -p["x"], "" if p["whole"] else "[TERM]") for p in terms]
    out, at = [], 0
    for s, e, put in sorted(marks):
        if s >= at:
            out += [text[at:s], put]
            at = -e
        else:
            at = max(at, -e)  # an overlapping rest goes too
    return "".join([*out, text[at:]])


def redact_documents(df: DataFrame, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, text without its personal data, and the columns in carry, for each row of df; null texts become empty."""
    found = find_personal_data(df, id_col=id_col, text_col=text_col, **options).where("base <> '' or more <> ''").select("row_key", F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.col("more") != "", F.col("more"))).alias("base"), "terms").dropDuplicates(["row_key"])
    texts, rest = carried(df, id_col, text_col, carry or [])
    keyed = arrow_schema(schema := f"doc_id long, text string, rest {rest}, row_key string")

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys = [row_key(d, t) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.string())], schema=keyed)

    out = arrow_schema(result := f"doc_id long, text string, rest {rest}")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            new = [t if base is None else redact(t, base, terms or []) for t, base, terms in zip(*(b.column(i).to_pylist() for i in (1, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string()), b.column(2)], schema=out)

    done = texts.mapInArrow(key, schema).join(found, "row_key", "left").select("doc_id", "text", "rest", "base", "terms").mapInArrow(put, result)
    return done.select("doc_id", "text", *(F.col("rest")[c].alias(c) for c in carry or []))
