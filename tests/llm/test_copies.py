"""Operators 2, 8 and 9 against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np

from strideline.llm import fingerprints, jaccard, substrings

SPACE = "[^\x20\x09-\x0d]+"


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                up[top(i)] = top(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[top(i)].append(d)
    least = lambda i: min((d for d in groups[top(i)] if d is not None), default=None)
    return sorted((str(d), len(sets[i]), str(least(i))) for i, (d, _) in enumerate(rows))


def test_components_equal_all_pairs_with_long_columns(spark):
    random.seed(4)
    base = [f"w{i}" for i in range(100)]
    rows = [(None, None), (3, ""), (4, " \t\n"), (5, "One two"), (6, "one TWO"), (7, "a b c d e"), (7, "a b c d e")]
    for k in range(70):
        w = list(base)
        for _ in range(random.randint(0, 4)):
            w[random.randrange(100)] = f"x{random.randrange(10**6)}"
        rows.append((100 + k, " ".join(w)))
    rows += [(300 + k, " ".join(random.choices(base, k=30)) + " " + " ".join(base[:40])) for k in range(30)]
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, component_id string")
    for run in (4, 32):
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.linked_documents(df, run=run).collect())
        assert got == brute_components(rows)


def test_one_row_of_each_group_stays(spark):
    words = [f"w{i}" for i in range(60)]
    text, near = " ".join(words), " ".join([*words[:59], "other"])
    rows = [(5, text, "b"), (5, text, "a"), (5, near, "c"), (3, "alone in the world here", "x"), (None, text, "n"), (None, "null one two three four", "n"), (None, "null one two three four", "m"), (None, "", "e"), (None, "", "e"), (8, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_key string").repartition(3)
    got = sorted(map(str, jaccard.one_of_each(df, ["row_key"]).collect()))
    kept = [r for r in rows[:3] if f"Row(doc_id=5, text='{r[1]}', row_key='{r[2]}')" in got]
    assert len(kept) == 1 and kept[0][2] in "ac"
    assert sum("alone" in g for g in got) == 1 and [g for g in got if "null one" in g] == ["Row(doc_id=None, text='null one two three four', row_key='m')"]
    assert sum("text=''" in g for g in got) == 3 and len(got) == 6
    assert jaccard.one_of_each(df.limit(0), ["row_key"]).count() == 0 and jaccard.linked_documents(df.limit(0)).count() == 0


def test_classes_that_share_half_a_key_stay_apart(spark, monkeypatch):
    assert jaccard.number_of(b"a" * 16) == jaccard.number_of(b"a" * 8 + b"b" * 8) and jaccard.number_of(b"a" * 8 + b"b" * 8, frozenset([jaccard.number_of(b"a" * 16)])) == int.from_bytes(b"b" * 8, "little", signed=True)


def test_prefixes_of_similar_sets_always_meet():
    random.seed(5)
    counts = np.random.default_rng(1).integers(0, 100, jaccard.COUNTERS)
    for _ in range(300):
        n = random.randint(1, 60)
        a = {random.getrandbits(60) for _ in range(n)}
        b = set(a)
        for x in random.sample(sorted(a), random.randint(0, n // 3)):
            b.discard(x)
            b.add(random.getrandbits(60)) if random.random() < 0.5 else None
        if b and 100 * len(a & b) >= 75 * len(a | b):
            p, q = (set(jaccard.ordered(np.array(sorted(s), np.uint64), counts)[: jaccard.prefix_length(len(s))].tolist()) for s in (a, b))
            assert p & q


def test_repeats_equal_counting_all_windows(spark):
    random.seed(6)
    rows = [(None, "a b c " * 9), (1, None), (2, ""), (3, "x y"), (8, "q w e r t y u i o p"), (8, "q w e r t y u i o p")]
    for k in range(120):
        v = random.choice([["a"], ["a", "b"], ["a", "b", "c"], list("abcdefghij")])
        rows.append((100 + k, " ".join(random.choices(v, k=random.randint(0, 90)))))
    w = 9
    want = repeats_by_counting(rows, w)
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, places int")
    got = substrings.remove_repeats(df, window=w, carry=["places"])
    assert sorted((str(r[0]), *r[1:4]) for r in got.collect()) == want
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_equal_windows_get_equal_symbols():
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 2**63, 35).astype(np.uint64)
    names = []
    for n in (40, 77):
        h = np.concatenate([rng.integers(0, 2**63, n).astype(np.uint64), passage, rng.integers(0, 2**63, 50).astype(np.uint64)])
        starts, _, name = substrings.candidates(h, np.array([0, len(h) + 1]), {})
        names.append(name[starts == n][0])
    assert names[0] == names[1]


def test_windows_with_a_unique_symbol_are_no_candidates():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 60).astype(np.uint64)
    bits = np.zeros(substrings.FILTER // 8, np.uint8)
    for w in h[np.arange(60) != 20]:
        i = int(substrings.slot(np.array([w]))[0])
        bits[i >> 3] |= 128 >> (i & 7)
    starts, _, _ = substrings.candidates(h, np.array([0, 61]), {-1: bits}, window=10)
    assert starts.tolist() == [*range(0, 11), *range(21, 51)]


def repeats_by_counting(rows, w):
    seen, words = Counter(), [re.findall(SPACE, t or "") for _, t in rows]
    for x in words:
        seen.update(tuple(x[i : i + w]) for i in range(len(x) - w + 1))
    out = []
    for (d, _), x in zip(rows, words):
        gone = {j for i in range(len(x) - w + 1) if seen[tuple(x[i : i + w])] > 1 for j in range(i, i + w)}
        out.append((str(d), len(x), len(gone), " ".join(a for j, a in enumerate(x) if j not in gone)))
    return sorted(out)


def test_rows_with_one_id_keep_their_own_places(spark, monkeypatch):
    """Many rows without an id, some equal, some long, some whose 32-bit hashes would meet; small flushes, so that windows
    are settled in tasks, across tasks and in both."""
    random.seed(16)
    words = [f"v{i}" for i in range(3000)]
    shared = " ".join(random.choices(words, k=60))
    rows = [(None, " ".join(random.choices(words, k=random.randint(0, 120))) + (" " + shared if i % 3 == 0 else "")) for i in range(300)]
    rows += [(None, "short text"), (None, " ".join(random.choices(words, k=9000)) + " " + shared), (7, None)] + [(None, "eq " + shared)] * 40
    monkeypatch.setattr(substrings.Windows.__init__, "__defaults__", (500,))
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == repeats_by_counting(rows, 35)


def test_peeling_recovers_the_difference_and_grows_when_stuck():
    rng = np.random.default_rng(3)
    for n, m, k in ((0, 0, 0), (5, 0, 0), (30, 2, 3), (500, 40, 60), (10, 900, 800), (3, 0, 2000)):
        common, a, b = (rng.integers(0, 2**63, x).astype(np.uint64) for x in (n, m, k))
        one, two = fingerprints.Fingerprints([np.append(common, a)]), fingerprints.Fingerprints([np.append(common, b)])
        apart, retries = fingerprints.differing(one, [0], two, [0])
        assert apart.tolist() == [m + k] and (retries[0] > 0) == (m + k > 500)  # nothing in common: one table was too small


def plain_likeness(x, y):
    """Shared parts over all parts, by counting the parts' digests as a multiset."""
    a, b = (set(fingerprints.digests([t.encode()])[0].tolist()) for t in (x, y))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likeness_of_returned_fingerprints_equals_counting_for_all_lengths(spark):
    random.seed(8)
    words = "the of hentat thing ouble and ingst".split()
    rows = [(i, " ".join(random.choices([*words, f"w{i}", "x\ny"], k=n))) for i, n in enumerate([*range(0, 30), 50, 100, 300, 301, 2000, 20000])]
    rows += [(1000, rows[-1][1][:-200]), (1001, None), (1002, "é" * 5000)]
    got = {r.doc_id: r for r in fingerprints.fingerprint(spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, fingerprint string")).collect()}
    order = sorted(rows, reverse=True)
    for (d, t), (e, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + u[:m]
        assert abs(got[d].near_next - plain_likeness(t, u)) < 1e-12 and abs(got[d].near_edited - plain_likeness(t, edited)) < 1e-12
        assert got[d].near_next == fingerprints.likeness(got[d].fingerprint, got[e].fingerprint)
        assert got[d].near_edited == fingerprints.likeness(got[d].fingerprint, got[d].edited_fingerprint)
    twelve = " ".join(f"v{i}" for i in range(60))
    assert plain_likeness(twelve, twelve + " more") > 0.7


def test_hot_ids_and_equal_rows_have_their_doubles_next(spark, monkeypatch):
    random.seed(9)
    rows = [(None, f"text {i} of no one " * 20) for i in range(60)] + [(5, "equal rows " * 30)] * 40 + [(5, "other")] + [(100 + i, f"t{i} " * 40) for i in range(20)]
    whole = fingerprints.with_next
    monkeypatch.setattr(fingerprints, "with_next", lambda d, i, t: whole(d, i, t, range_bytes=2000))
    got = fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    five = [r for r in got if r.doc_id == 5]
    assert sum(r.near_next == 1.0 for r in five) >= 39 and len({r.fingerprint for r in five}) == 2
    assert fingerprints.fingerprint(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (one,) = fingerprints.fingerprint(spark.createDataFrame([(3, "alone here")], "doc_id long, text string")).collect()
    assert one.near_next == 1.0


def test_next_documents_across_ranges(spark, monkeypatch):
    random.seed(7)
    rows = [(i * 3, " ".join(random.choices("abcdefgh ijk lm\n".split(" "), k=random.randint(0, 60)))) for i in range(80)] + [(None, "null id text here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = fingerprints.with_next
    monkeypatch.setattr(fingerprints, "with_next", lambda d, i, t: whole(d, i, t, range_bytes=500))
    got = {r.doc_id: r for r in fingerprints.fingerprint(df).collect()}
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    for (d, t), (_, u) in zip(order, order[1:] + order[:1]):
        m = len(t) // 3
        assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - m] + u[:m]).encode()).hexdigest() and got[d].n_chars == len(t)
        assert 0 <= got[d].near_next <= 1 and 0 <= got[d].near_edited <= 1
