"""Operators 5, 6, 7 and 10, and the pipeline."""

import base64
import hashlib
import io
import re

import numpy as np
import pytest

import corpus_pipeline
from strideline.llm import media, pii, toxicity, warc

DATA = "/root/testdata/sf0.001"
TEXTS = ["mail a.b@c-d.org, x@y.z@w.v @ no@dot 1.2.3.4.5.6.7.8 256.1.1.1 4111 1111-1111 1111 +1 (555) 010-9999", "", "a" * 5000 + "@", "1" * 5000 + ".2.3.4", "+1 2 3", "é x@y.de 10.0.0.1", "5500-0000-0000-0004 12345678901234567890", "+49 30 1234567 and +1234567890123456"]


def plain_base(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_the_plain_patterns(spark):
    texts = [t for t in TEXTS if len(t) < 3000] + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    assert [pii.base_spans(t) for t in texts] == [plain_base(t) for t in texts]
    assert pii.base_spans(TEXTS[2]) == [] and [s[0] for s in pii.base_spans("1" * 200_000 + ".2.3.4" + "a" * 200_000)] == []


def test_a_term_that_stands_only_by_an_address_is_found(spark):
    rows = [(i, f"the zorgon wrote me@corp.org about the thing x{i}") for i in range(12)] + [(100 + i, f"the thing about wrote y{i}") for i in range(500)] + [(None, None), (70, "")]
    df = spark.createDataFrame([(d, t, "q") for d, t in rows], "doc_id long, text string, terms string")
    got = {r.doc_id: r for r in pii.span_digests(pii.find_personal_data(df)).collect()}
    assert "term:4:10" in got[0].spans and got[0].n_email == 1 and "term" not in got[100].spans and len(got) == len({d for d, _ in rows})
    clean = {r.doc_id: r.text for r in pii.redact_documents(df).collect()}
    assert "corp.org" not in clean[0] and "zorgon" not in clean[0] and clean[100] == rows[12][1]


def test_terms_anywhere_in_the_documents_are_found_and_removed_everywhere(spark):
    far = " ".join(f"pad{i} of the text" for i in range(60))
    rows = [(i, f"write to me@corp.org {far} zorgon {far} Zorgon, not zorgonia{i} the text") for i in range(12)] + [(100 + i, f"of the text {far} not write to other o{i}") for i in range(500)]
    rows += [(9000, "zorgons of the text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.redact_documents(df).collect()}
    assert all("zorgon " not in clean[i].lower() and "zorgon," not in clean[i].lower() and f"not zorgonia{i} the text" in clean[i] for i in range(12))
    assert all(clean[i] == t for i, t in rows if i >= 100)


def test_disclosing_terms_equal_plain_counting(spark):
    rng = np.random.default_rng(3)
    who = [f"u{i}@x.org" for i in range(6)]
    rows = []
    for i in range(120):
        mine = [int(x) for x in rng.choice(6, rng.integers(0, 3), replace=False)]
        words = [f"w{chr(97 + int(x))}" for x in rng.integers(0, 20, 8)] + [f"name{chr(97 + j)}" for j in mine if rng.random() < 0.9] + [who[j] for j in mine]
        words += [f"name{chr(97 + int(rng.integers(0, 6)))}"] * (rng.random() < 0.03)
        rows.append((i, " ".join(str(w) for w in rng.permutation(words))))
    rows += [(120 + i, f"other text z{i}") for i in range(3000)]
    held = {i: {w for w in t.split() if "@" in w} for i, t in rows}
    terms = {i: {w for w in t.split() if "@" not in w} for i, t in rows}
    want = {i: set() for i, _ in rows}
    for e in who:
        n_e = sum(e in h for h in held.values())
        for t in set().union(*terms.values()):
            n_t, n_et = sum(t in x for x in terms.values()), sum(t in terms[i] and e in held[i] for i in held)
            if n_et / (n_t + 4) >= max((n_e / len(rows)) ** 0.1, 0.25):
                for i, _ in rows:
                    want[i] |= {t} if e in held[i] and t in terms[i] else set()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: {rows[r.doc_id][1][p.s : p.x] for p in r.terms} for r in pii.find_personal_data(df).collect()}
    assert got == want and any(want.values())


def test_repeating_rows_changes_nothing(spark):
    rows = [(None if i < 2 else i, f"zorgon has zorgon@corp.org as the thing x{i}") for i in range(12)] + [(100 + i, f"has as the thing y{i}") for i in range(500)]
    rows += [(9000, "zorgon@other.org has the thing")]
    seen = []
    for times, ids in ((1, 0), (3, 0), (2, 50_000)):
        more = [(d if d is None else d + k * ids, t) for k in range(times) for d, t in rows]
        got = pii.find_personal_data(spark.createDataFrame(more, "doc_id long, text string").repartition(3)).where("size(terms) > 0").collect()
        assert len(got) == 12 * times and all(p.whole for r in got for p in r.terms)
        seen.append({(r.row_key.split(":")[1], tuple((p.s, p.x) for p in r.terms)) for r in got})
    assert seen[0] == seen[1] == seen[2] and {t for _, t in seen[0]} == {((0, 6),)}
    few = [(i, f"zorgon has me@corp.org as the thing x{i}") for i in range(1)] * 40 + rows[12:]
    assert pii.find_personal_data(spark.createDataFrame(few, "doc_id long, text string")).where("size(terms) > 0").count() == 0


def test_texts_with_any_personal_data_or_secret_are_found(spark):
    kinds = ["mail a{}@b.org", "call +1 (555) 010-{:04d}", "at 10.0.{}.1", "card 4111111111111111 {}", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b9{:04d}"', "key AKx{:04d}aZ9qW8eR7tY6uI5oP"]
    bad = [(i, "words before " + kinds[i % 6].format(i) + " and after") for i in range(120)]
    clean = [(1000 + i, t) for i, t in enumerate(["", "plain words only", "2024-01-02 at 12.5", "a" * 60, "1" * 60, "Donaudampfschifffahrtsgesellschaft12", "words before and after"] * 5)]
    got = {r.doc_id: r for r in pii.span_digests(pii.find_personal_data(spark.createDataFrame(bad + clean, "doc_id long, text string"))).collect()}
    assert all(got[i].n_spans > 0 for i, _ in bad) and all(got[i].n_spans == 0 and got[i].spans == "" for i, _ in clean)
    assert "secret:" in got[4].spans and got[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_secrets_of_all_forms_and_cards_beside_numbers():
    card = "4111111111111111"
    there = {
        f"card {card} 12/27": card, f"{card} {card[:-1]}2 x": card, "4111 1111 1111 1111 2027 123": "4111 1111 1111 1111", "7 4111-1111-1111-1111": "4111-1111-1111-1111", f"1234567 {card} 12": card,
        "ghp_abcdefghijklmnopqrst": "ghp_abcdefghijklmnopqrst", "Password: hunter-two": "hunter-two", 'api_key="correct,horse"': "correct", "my ssn 123-45-6789.": "123-45-6789",
        "id AKx1-9aZ9qW8eR7tY_6uI5oP": "AKx1-9aZ9qW8eR7tY_6uI5oP", "k = x1y2z3a4b5c6d7e8f9g0": "x1y2z3a4b5c6d7e8f9g0",
    }
    for text, want in there.items():
        base = pii.base_spans(text)
        assert [text[s:e] for _, s, e in pii.secrets(text, base)] == [want], text
    for text in ("4111111111111112 12", "1" * 60, "2024-01-02-2024-01-03-2024", "some-long-page-title-of-2024-05", "a token of love", "password is short: no", "123-45-67890", "000-12-3456", "4111111111111111", "tokens: 12"):
        assert pii.secrets(text, pii.base_spans(text)) == [], text


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train_on(docs, labels)
    few = docs.join(labels.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out(labels["doc_id"]))
    got = toxicity.predictions(toxicity.score_documents(few, model)).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    assert all(r.held_out for r in got)
    hit = [r.predicted for r in got if r.toxic == 1]
    false = [r.predicted for r in got if r.toxic == 0]
    assert np.mean(hit) > 0.75 and np.mean(false) < 0.01


def test_toxicity_without_both_classes(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", None, ""])], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_documents(docs, toxicity.train_on(docs, none)).collect()} == {0.5}


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "same"), (2, None, "same"), (3, "http://b\r\nX: y", "other é"), (None, "u", "same"), (4, "u", None), (5, "u", ""), (6, "u", "x" * 300_000)]
    got = sorted(map(tuple, warc.round_trip(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")).drop("url").collect()), key=str)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), i or -1)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = last[h or ""]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    assert got == sorted(want, key=str)


def test_damaged_archives_are_refused():
    record = warc._record(1, "u", b"hello", None)
    assert warc.parse(record)[1] == b"hello"
    for bad in (record[:-1], record.replace(b"hello", b"jello"), record.replace(b"Content-Length: 5", b"Content-Length: 4"), b"x" + record):
        with pytest.raises(warc.BadArchive):
            warc.parse(bad)
    with pytest.raises(warc.BadArchive):
        list(warc.frames(io.BytesIO(b"\0" * 20)))


def test_media_round_trip_and_member_retry(spark):
    rows = [(1, "hello"), (1, "hello"), (None, None), (2, ""), (3, "é" * 500), (4, "x" * 192)]
    got = media.describe(media.store(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, media int"))).collect()
    want = []
    for d, t in rows:
        b = (t or "").encode()
        p = b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))
        want.append((str(d), len(b), len(p), hashlib.sha256(p).hexdigest()))
    assert sorted((str(r[0]), *r[1:4]) for r in got) == sorted(want)

    class Flaky:
        def __init__(self, data):
            self.data, self.opened = data, 0

        def open_input_file(self, _):
            self.opened += 1
            return io.BytesIO(b"" if self.opened < 2 else self.data)

    import tarfile

    png = media.encode_media(b"abc")
    info = tarfile.TarInfo("9.png")
    info.size = len(png)
    fs = Flaky(info.tobuf(tarfile.USTAR_FORMAT) + png)
    assert media.read_member(fs, "x", 0, len(fs.data)) == (9, png) and fs.opened == 2


def test_pipeline_stages_keep_their_promises(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    n = []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.saved(stage(spark, docs, DATA))
        n.append(docs.count())
        if len(n) < 5:
            assert docs.columns == corpus_pipeline.COLUMNS
        if len(n) == 2:
            from test_copies import brute_components

            rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
            assert all(d == c for d, _, c in brute_components(rows))
    assert n[0] >= n[1] == n[2] == n[3] <= n[4]
