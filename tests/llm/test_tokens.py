"""Operators 1, 3 and 4 against tiktoken, tokenizers and whole recounts."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from strideline.llm import bpe, packing, token_counts

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
ODD = ["", " ", "  \n x", "a" * 3000, "ab" * 2000, "\n" * 700 + "y", "é中\x1c\x85 'ſ's 12½", "the cat's  hat \n\nsat", "<|endoftext|> x", "=" * 999]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_tiktoken_on_odd_and_random_texts(reference):
    _, memo = bpe.encoder(RANKS, P.PATTERN)
    random.seed(1)
    texts = ODD + ["".join(random.choices(list(" \n\tabcdethins'é.,12"), k=random.randint(0, 60))) for _ in range(2000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in memo.encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_memo_overflow_changes_nothing(reference):
    enc, _ = bpe.encoder(RANKS, P.PATTERN)
    memo = bpe.Memo(lambda cs: [np.array(reference.encode_ordinary(c), "<u4").tobytes() for c in cs], size=5)
    texts = ["one two three four five six seven", "two three", "eight nine ten one two", ""]
    for _ in range(3):
        assert [enc.decode(np.frombuffer(x, "<u4").tolist()).decode() for x in memo.encode(texts)] == texts


def test_documents_with_nulls_repeats_and_clashing_columns(spark, reference):
    rows = [(1, "a b", 7), (1, "a b", 8), (None, None, 9), (2, "", 1)] + [(10 + i, t, i) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = bpe.digests(bpe.encode_documents(df, RANKS, P.PATTERN)).collect()
    want = sorted((str(d), len(i := reference.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _ in rows)
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    assert bpe.encode_documents(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_packing_places_every_piece_and_wastes_little(spark):
    random.seed(2)
    words = "the of and hentat thing ouble".split()
    rows = [(i, " ".join(random.choices(words, k=random.choice([0, 3, 200, 700, 2500])))) for i in range(120)] + [(5, "x"), (None, None), (999, ODD[8])]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), JSON).collect()
    tok = Tokenizer.from_file(JSON)
    want = []
    for d, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        want += [(str(d), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r[0]), *r[1:5]) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 1024
    assert len(bins) <= 1.03 * -(-sum(r.length for r in got) // 1024) + 1


def test_closing_the_fullest_bin_keeps_the_limit():
    b = packing.OpenBins(10, 2, 0)
    assert [b.take(x) for x in (6, 7, 8, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6)]
    assert b.n <= 2


def test_edits_give_the_counts_of_a_whole_recount(reference, monkeypatch):
    count = lambda xs: [len(reference.encode_ordinary(x)) for x in xs]
    pieces = regex.compile(P.PATTERN)
    random.seed(3)
    for k in range(900):
        monkeypatch.setattr(token_counts, "LEAF", (2, 6, 15)[k % 3])
        some = (["the", "ing", " ", "  ", "\n", "'s", "é", "12", "!", " foo"], ["中文", "。", "字", "\n", "\t"], [" ", "\n", "  ", "x"], ["a,b", ";", "'", "s", "\t", "\x1c", "7"])[k % 4]
        text = "".join(random.choices(some, k=random.randint(0, 30)))
        doc = token_counts.CountedText(text, count, pieces)
        for _ in range(5):
            a = random.randint(0, len(text))
            b, new = random.randint(a, min(len(text), a + 8)), "".join(random.choices([" ", "a", "'s", "\n", "中", "long words in here "], k=random.randint(0, 3)))
            doc.replace(a, b, new)
            text = text[:a] + new + text[b:]
            assert doc.text == text and doc.n_tokens == len(reference.encode_ordinary(text))
            doc = token_counts.CountedText(text, count, pieces, doc.state)
            assert doc.text == text and doc.n_tokens == len(reference.encode_ordinary(text))


def test_texts_without_spaces_are_cut_and_leaves_that_grow_too(reference):
    count = lambda xs: [len(reference.encode_ordinary(x)) for x in xs]
    for unit in ("中文字句子，", "a\tbc\t", "x,y;"):
        text = unit * 3000
        doc = token_counts.CountedText(text, count, regex.compile(P.PATTERN))
        doc.encoded_chars = 0
        for at in (9000, 100, 5000):
            doc.replace(at, at + 3, "新 new")
            text = text[:at] + "新 new" + text[at + 3 :]
        assert doc.encoded_chars < 15_000 and doc.n_tokens == len(reference.encode_ordinary(text))
        doc.encoded_chars = 0
        for _ in range(200):
            doc.replace(6000, 6000, " more words")
            text = text[:6000] + " more words" + text[6000:]
        assert doc.n_tokens == len(reference.encode_ordinary(text)) and max(doc.state[0]) < 4 * token_counts.LEAF and doc.encoded_chars < 200 * 4 * token_counts.LEAF


def test_edits_encode_only_what_they_touch(spark, reference):
    text = "hello there world " * 3000
    df = spark.createDataFrame([(1, text), (2, None), (3, "ab")], "doc_id long, text string")
    got = {r.doc_id: r for r in token_counts.count_edits(df, RANKS, P.PATTERN).collect()}
    assert got[1].n_tokens == len(reference.encode_ordinary(text)) and got[1].n_chars_encoded < len(text) / 10
    trees = token_counts.keep_trees(df, RANKS, P.PATTERN)
    twice = token_counts.follow_edits(token_counts.follow_edits(trees, RANKS, P.PATTERN, token_counts.sample_edits), RANKS, P.PATTERN, lambda t: [(0, 3, "new start"), (len(t), len(t), " end")])
    assert all(r.n_tokens_edited == len(reference.encode_ordinary(r.text)) and sum(r.leaf_chars) == len(r.text) for r in twice.collect())
    assert token_counts.count_edits(df.limit(0), RANKS, P.PATTERN).count() == 0
    assert got[2].n_tokens == 0


def test_chunks_give_the_ids_of_whole_texts():
    import random

    import pyarrow as pa

    path = P.path("byte_bpe_50k.json")
    parts = [" ", "  ", "\n", "\n\n", "\r\n", "\t", "\x1c", "\x85", "\u3000", "\xa0", "a", " x", "b c", "'s", "1", ".", ",", "%%%", "é", "ß.", "×", "÷", "²", "\u0301", "中", "😀", "<|endoftext|>", ""]
    rng = random.Random(8)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)]
    whole, chunks, _ = packing._tokenizer(path)
    want, coded = whole(texts), []
    missing, chunks.missing = chunks.missing, lambda new: coded.extend(new) or missing(new)
    assert packing.document_ids(pa.array(texts).slice(5), path) == want[5:]
    chunks.missing = missing
    assert b" x" in coded and all(not c.endswith((b"a.", b"1,")) for c in coded)  # signs are chunks of their own
    small = packing.Chunks(missing, size=9)
    assert [small.encode(pa.array([t]))[0] for t in texts if "<|" not in t] == [w for t, w in zip(texts, want, strict=True) if "<|" not in t]
