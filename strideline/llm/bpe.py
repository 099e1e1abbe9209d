"""Operator 1: byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 so that an Aho-Corasick automaton over the vocabulary finds all tokens in a piece. The
encoder walks from longest match to longest match; a token may follow another only if BPE would never merge across
their border, which is a property of the two tokens alone and is memoised. Where no token fits, it takes one token
back; each position is given up at most once, so the time is linear in the piece.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, kept, slices, spread, two_columns

#: A bound on the entries of each memo of a worker.
MEMO = 300_000


class BytePairEncoder:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.lengths = [len(t) for t in self.tokens]
        self.halves = {r: self._last_merge(t) for t, r in self.ranks.items() if len(t) > 1}
        self.merged = {ab: r for r, ab in self.halves.items() if ab}
        self.find = ahocorasick.Automaton()
        for t, r in self.ranks.items():
            self.find.add_word(t.decode("latin-1"), r)
        self.find.make_automaton()
        self.by_chars = {t.decode("latin-1"): r for t, r in self.ranks.items()}
        self.longest_token = max(map(len, self.ranks))
        self.shorter = [-1] * len(self.tokens)
        for t, r in self.ranks.items():
            self.shorter[r] = next((self.ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ranks), -1)
        self.fits: dict[int, bool] = {}

    def _last_merge(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens from whose merge this one arises, by plain merging in rank order."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 40))
            if parts[best] + parts[best + 1] not in self.ranks:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if all(p in self.ranks for p in parts) else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves the border between the two tokens alone.

        Both are taken apart in reverse order of merging, the later merge first; if at some time the parts at the
        border form a token that would have been merged earlier than the merges undone so far, the border goes.
        """
        if len(self.fits) > 4 * MEMO:
            self.fits.clear()
        got = self.fits[left << 32 | right] = self._compatible(left, right)
        return got

    def _compatible(self, left: int, right: int) -> bool:
        a, b, before = left, right, 1 << 40
        while True:
            if self.merged.get((a, b), 1 << 40) < before:
                return False
            pa_, pb_ = self.halves.get(a), self.halves.get(b)
            if not pa_ and not pb_:
                return True
            # at equal ranks the left occurrence was merged first, so the right one is undone first
            if pa_ and (not pb_ or a > b):
                before, a = a, pa_[1]
            else:
                before, b = b + 1, pb_[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, lengths, shorter, fits = len(piece), self.lengths, self.shorter, self.fits
        chars, get, reach, most = piece.decode("latin-1"), self.by_chars.get, self.find.longest_prefix, self.longest_token

        def longest(at: int) -> int:
            """The longest token from here: the automaton's longest path, shortened to its last token."""
            ahead = chars[at : at + most]
            k = reach(ahead)
            r = get(ahead[:k], -1)
            while r < 0:
                k -= 1
                r = get(ahead[:k], -1)
            return r

        out: list[int] = []
        dead: set[int] = set()
        at, last, token = 0, -1, longest(0)
        while at < n:
            while token >= 0:
                if at + lengths[token] not in dead:
                    if last < 0:
                        break
                    fit = fits.get(last << 32 | token)
                    if self.compatible(last, token) if fit is None else fit:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = at + lengths[token], token
                token = longest(at) if at < n else -1
            else:
                if not out:
                    raise ValueError("the vocabulary can't express these bytes")
                dead.add(at)  # no encoding has a border here, so go on with a shorter token before it
                token = shorter[out.pop()]
                at -= lengths[last]
                last = out[-1] if out else -1
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Memo:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes, from memoised chunks.

    A piece always begins at a space that a non-space follows, so text is cut there first; a chunk's ids depend on
    nothing outside it. Chunks are kept in a bounded dictionary; what isn't there goes to `missing` together.
    """

    def __init__(self, missing: Callable[[list[str]], list[bytes]], size: int = MEMO):
        self.missing, self.size, self.known, self.older = missing, size, {}, {}
        self.odd, self.cut = re.compile(r" (?:\s|\Z)"), re.compile(r"(?= \S)")

    def chunks(self, text: str) -> list[str]:
        if self.odd.search(text) or not text:
            return [c for c in self.cut.split(text) if c]
        first, *rest = text.split(" ")
        return [*([first] if first else []), *map(" ".__add__, rest)]

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        parts = [self.chunks(t) for t in texts]
        new = {c for p in parts for c in p if c not in known}
        over = {}
        if new:
            if len(known) + len(new) > self.size:  # what is used again comes back from the older half
                self.older, self.known = known, {}
                known = self.known
                new = {c for p in parts for c in p}
            found = new & self.older.keys()
            known.update((c, self.older[c]) for c in found)
            new = list(new - found)
            for c, ids in zip(new, self.missing(new), strict=True):
                if len(known) < self.size and len(c) <= 64:
                    known[c] = ids
                else:
                    over[c] = ids
        if over:
            return [b"".join([over[c] if c in over else known[c] for c in p]) for p in parts]
        return [b"".join(map(known.__getitem__, p)) for p in parts]


def encoder(path: str, pattern: str) -> tuple[BytePairEncoder, Memo]:
    """One encoder and memo for each worker process and vocabulary."""
    key, made = f"{path}\0{pattern}", kept("bpe")
    if key not in made:
        enc, split = BytePairEncoder(path), regex.compile(pattern)

        pieces: dict[str, bytes] = {}

        def missing(chunks: list[str]) -> list[bytes]:
            one, out = enc.encode_piece, []
            if len(pieces) > MEMO:
                pieces.clear()
            for c in chunks:
                got = []
                for p in split.findall(c):
                    ids = pieces.get(p)
                    if ids is None:
                        ids = array("I", one(p.encode())).tobytes()
                        if len(p) <= 32:
                            pieces[p] = ids
                    got.append(ids)
                out.append(b"".join(got))
            return out

        made[key] = enc, Memo(missing)
    return made[key]


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded binary: each text's token ids, and the bytes that decoding these ids gives.

    Null or empty texts have no ids and decode to no bytes. Equal rows give equal rows; a null id stays null; other
    columns are ignored. One pass without a shuffle: each text is encoded where it is read.
    """
    schema = "doc_id long, ids array<int>, decoded binary"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, memo = encoder(path, pattern)
        for b in slices(batches, "bpe"):
            coded = memo.encode(b.column(1).to_pylist())
            ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
            flat = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)).cast(out.field("ids").type)
            words = flat.tolist()
            decoded = [enc.decode(words[s:e]) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(decoded, pa.binary())], schema=out)

    return spread(two_columns(df, id_col, text_col)).mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode_documents' rows, by Spark functions."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
