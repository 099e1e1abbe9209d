"""Operators 11, 12 and 13 against brute force."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import xxhash

from strideline.llm import collocations, common, filter_audit, simhash

SPACE = "[^\x20\x09-\x0d]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def plain_audit(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    fails = []
    for d, t, _ in rows:
        t = t or ""
        w = re.findall(SPACE, t)
        out = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t))]
        out.append(d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in rows))
        fails.append({x for x, f in zip("ABCDE", out) if f})
    want = {}
    for part in {s or "" for _, _, s in rows}:
        mine = [(d, f) for (d, _, s), f in zip(rows, fails) if (s or "") == part]
        total = Counter()
        for order in permutations("ABCDE"):
            for step, x in enumerate(order):
                before = set(order[:step])
                lost = [d for d, f in mine if x in f and not f & before]
                total[x] += len(lost)
                want[part, "".join(order), step + 1] = [
                    sum(not f & (before | {x}) for _, f in mine), len(lost), sum(x in f and bool(f & before) for _, f in mine), sum(f == {x} for _, f in mine), sum(d in good for d in lost), sum(d in toxic for d in lost)
                ]
        for k in [k for k in want if k[0] == part]:
            want[k].append(total[k[1][k[2] - 1]])
    return want


def test_audit_equals_counting_row_by_row(spark):
    random.seed(1)
    words = ["the", "of", "Hea", "ILL", "tion", "x#y", "é|", "plain", "more", "text"] + [f"w{i}" for i in range(80)]
    texts = [None, "", "  \t", "A" * 10, "é" * 99 + "ABCDE", "é" * 94 + "ABCDE", " ".join(f"u{i}" for i in range(50)), " ".join(f"u{i}" for i in range(49)), " ".join(["a"] * 35 + [f"u{i}" for i in range(64)]), " ".join(["a"] * 36 + [f"u{i}" for i in range(64)]), "z\x1cy " * 60, " ".join(f"long{i}" for i in range(60_000))]
    texts += [" ".join(random.choices(words, k=random.choice([5, 60, 200]))) for _ in range(15)]
    rows = [(random.choice([None, *range(60)]), random.choice(texts), random.choice([None, "", "s1", "s2", "s3"])) for _ in range(250)]
    rows += [(500 + i, "one text of many", "hot") for i in range(300)] + [(3, "one text of many", "s1"), (3, "one text of many", "s2"), (3, "one text of many", "s2")]
    labels = [(i, random.choice([None, 0, 1]), random.choice([None, 0, 1])) for i in [*range(70), *range(20), 3, 500, 501]] + [(None, 1, 1)]
    df = spark.createDataFrame([(*r, 7, "h") for r in rows], "doc_id long, text string, source string, mask int, h string").repartition(5)
    known = spark.createDataFrame([(*x, "q") for x in labels], "doc_id long, quality int, toxic int, n string")
    got = {(r.part, r.filter_order, r.step): [r[c] for c in filter_audit.COUNTS] for r in filter_audit.audit_documents(df, known).collect()}
    assert got == plain_audit(rows, labels)
    assert filter_audit.audit_documents(df.limit(0), known).count() == 0
    bare = filter_audit.audit_documents(df, known.limit(0))
    assert bare.where("good_lost > 0 or toxic_lost > 0").count() == 0 and bare.count() == len(got)


def plain_fingerprint(text):
    w = lower(text).encode()
    w = re.findall(rb"[^\x20\x09-\x0d]+", w)
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def plain_groups(items, linked):
    up = list(range(len(items)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                up[top(i)] = top(j)
    return [top(i) for i in range(len(items))]


def test_near_copies_equal_all_pairs(spark):
    random.seed(2)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(random.choices(words, k=200)) for _ in range(6)]
    rows = [(None, None), (4, ""), (3, " \n"), (9, "One two"), (8, "one TWO"), (7, "a b c d"), (7, "a b c d"), (6, "É é é É x"), (5, "é É É é X")]
    for k in range(150):
        w = random.choice(base).split()
        for _ in range(random.choice([0, 1, 2, 5])):
            w[random.randrange(len(w))] = f"x{random.randrange(50)}"
        rows.append((random.choice([None, 100 + k, 100 + k]), " ".join(w)))
    rows += [(None, "no id of mine at all"), (400, " ".join(random.choices(words, k=70_000)))]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, fp string").repartition(5)
    fps = [plain_fingerprint(t) for _, t in rows]
    of = plain_groups(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    assert len(set(fps)) > len(set(of)) > 10  # some link, some don't
    low = {g: min((d for (d, _), x in zip(rows, of) if x == g and d is not None), default=None) for g in of}
    want = sorted((str(d), f"{f:016x}", str(low[g])) for (d, _), f, g in zip(rows, fps, of))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_copies(df).collect()) == want
    assert simhash.near_copies(df.limit(0)).count() == 0


def test_no_link_is_lost_whatever_the_blocks(spark):
    rng = random.Random(3)
    codes = [0, 2**64 - 1]
    for _ in range(40):
        c = rng.getrandbits(64)
        codes += [c ^ sum(1 << i for i in rng.sample(range(64), n)) for n in (0, 1, 2, 3, 4, 5, 6)]
    want = plain_groups(codes, lambda a, b: (a ^ b).bit_count() <= 4)
    signed = np.array(codes, np.uint64)
    for k in (1, 5, 9):
        masks, key = simhash.changes(2, k)
        ways = np.unique(key)
        assert len(masks) == 2081 and len(ways) == 1 + k + k * (k - 1) // 2
        home = simhash.parities(signed, k)
        links = set()
        for block in range(1 << k):
            some = signed[np.isin(home ^ block, ways)]
            for held in (500, 10**7):
                a, b = simhash.meetings(block, some, masks, key, 4, k, held)
                links |= {(x % 2**64, y % 2**64) for x, y in zip(a.tolist(), b.tolist())}
        assert all((a ^ b).bit_count() <= 4 and a != b for a, b in links)
        got = plain_groups(codes, lambda a, b: a == b or (a, b) in links or (b, a) in links)
        thin = {(x % 2**64, y % 2**64) for x, y in zip(*(v.tolist() for v in simhash.forest(*(np.array([p[i] for p in sorted(links)], np.uint64).view(np.int64) for i in (0, 1)))))}
        assert len(thin) == len(codes) - len(set(plain_groups(codes, lambda a, b: a == b or (a, b) in links or (b, a) in links))) - (len(codes) - len(set(codes)))
        same = lambda g: sorted(sorted(i for i in range(len(codes)) if g[i] == x) for x in set(g))
        assert same(got) == same(want) == same(plain_groups(codes, lambda a, b: a == b or (a, b) in thin or (b, a) in thin))


def plain_phrases(rows, least, top, share):
    f, n = Counter(), Counter()
    for t, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(t)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    long = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, w), a in long.items():
        if any(x == lang and len(v) > len(w) and 100 * b >= share * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (x, v), b in long.items()):
            continue
        s, _, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-s, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


def test_phrases_equal_counting_all(spark, monkeypatch):
    random.seed(4)
    vocabulary = ["the", "of", "The", "é", "É", "x\x1cy", "a", "b", "c", "und", "🙂"] + [f"w{i}" for i in range(30)]
    rows = [(None, "en"), ("", None), ("...,,\n\x0b", "en"), ("a b" * 3, "de")]
    for _ in range(200):
        w = random.choices(vocabulary, weights=[9] * 11 + [1] * 30, k=random.randint(0, 80))
        text = "".join(x + random.choice([" ", " ", " ", "\t", "  ", ", ", "\r\n", ".", "\x0c"]) for x in w) + random.choice(["", "in the long run of things", "new new new new york"])
        rows.append((text, random.choice(["en", "en", "de", None, "und"])))
    rows += [("hot phrase here now", "hot")] * 300 + [(" ".join(f"only{i}" for i in range(200_000)), "long")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, f int").repartition(6)
    cells = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    monkeypatch.setattr(common, "BATCH_CHARS", 20_000)
    for least, top, share, held, ranges in ((3, 40, 80, 2_000_000, 1_000_000), (2, 5000, 60, 300, 150)):
        monkeypatch.setattr(collocations, "HELD", held)
        monkeypatch.setattr(collocations, "RANGE_WORDS", ranges)
        got = collocations.top_phrases(df, least=least, top=top, share=share)
        assert sorted(tuple(r[c] for c in cells) for r in got.collect()) == plain_phrases(rows, least, top, share)
    assert collocations.top_phrases(df.limit(0)).count() == 0


def test_scores_beyond_64_bits_are_exact(spark):
    a, l, r = 4 * 10**12 + 7, 5 * 10**12 + 1, 9 * 10**12 + 3
    words = spark.createDataFrame([("x", 1, "p", l), ("x", 2, "q", r)], "lang string, code long, word string, f long")
    nodes = spark.createDataFrame([("x", 2, [1, 2], a)], "lang string, depth int, g array<long>, f long")
    (got,) = collocations.phrases(words, nodes).withColumn("s", collocations.score(collocations.F.col("f"), collocations.F.lit(l + r).cast("decimal(20,0)"))).collect()
    assert got.s == 2_000_000 * a // (l + r) and (got.phrase, got.lefts, got.rights) == ("p q", [l], [r])


def test_no_level_of_phrases_is_broadcast(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(" ".join(rng.choices("abcdefgh", k=40)), "x") for _ in range(60)]
    plans = []
    keep = collocations.saved
    monkeypatch.setattr(collocations, "saved", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    top = collocations.top_phrases(spark.createDataFrame(rows, "text string, lang string"), least=3, top=9)
    levels = [p for p in plans if "link" in p]
    assert len(levels) == collocations.DEPTH - 1 and not any("BroadcastHashJoin" in p for p in levels)
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in top.collect()) == plain_phrases(rows, 3, 9, collocations.SHARE)


def test_two_words_with_one_code_are_told_apart(spark, monkeypatch):
    whole = collocations.codes
    monkeypatch.setattr(collocations, "codes", lambda words, seed: whole([b"same" if seed == 0 and w in (b"p", b"q") else w for w in words], seed))
    df = spark.createDataFrame([("p r q r", "x")] * 5, "text string, lang string")
    assert {r.phrase for r in collocations.top_phrases(df, least=5).collect()} == {"p r q r"}
