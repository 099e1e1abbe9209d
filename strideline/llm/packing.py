"""Operator 3: best-fit packing of token sequences into windows of a fixed length.

Tokenising cuts only documents longer than a window; the first piece takes the remainder. Pieces are dealt evenly into
groups of about `group_rows`, whatever they are, and each group is packed online, in the order it is read, by best fit: the
open bins are kept in a bitset keyed by free space, so the fullest bin that still takes a piece is a shift and a
lowest-set-bit away. At most `open_bins` bins are open; when one more is needed, the fullest one closes. A piece gets its
place when it is read, without a look at later ones; that a group is read longest first only sets the order of arrival.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, kept, saved, slices, spread, two_columns

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


#: A bound on the chunks that a worker keeps in each of two generations, and on the bytes of one.
MEMO, MOST_BYTES = 150_000, 64
#: Bytes that no character of white space begins with; ASCII letters and digits; ASCII signs.
_SOLID = np.array([c > 0x20 and c not in (0x7F, 0x85, 0xA0, 0xC2, 0xE1, 0xE2, 0xE3) for c in range(256)])
_WORD = np.array([c < 128 and chr(c).isalnum() for c in range(256)])
_SIGN = np.array([0x20 < c < 0x7F and not chr(c).isalnum() for c in range(256)])
#: A chunk that is one piece of the tokenizer's: letters up to U+00FF, digits or signs.
_PIECE = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-/:-@\[-`{-~]+)")


def _cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where chunks of texts (their bytes, the first of which are at `at`, and the end) begin.

    Pieces begin at a space that a non-space follows, at a sign after a letter or digit, at a line end after one of these and,
    where just one line end stands there, after it; coded by itself, what lies between gives the same ids. Places that
    aren't sure are no cuts.
    """
    begins = np.zeros(len(data), bool)
    begins[:-1] = (data[:-1] == 0x20) & _SOLID[data[1:]]
    begins[at[1:][at[1:] > 0] - 1] = False  # a text's last space has nothing after it
    word, sign = _WORD[data], _SIGN[data]
    word[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    begins[1:] |= word[:-1] & sign[1:]
    line = (data[1:] == 0x0A) & (word[:-1] | sign[:-1])
    begins[1:] |= line
    begins[2:] |= line[:-1] & _SOLID[data[2:]]
    begins[at[:-1][at[:-1] < at[1:]]] = True
    return np.flatnonzero(begins)


class Chunks:
    """Ids of whole texts, many at once, from chunks that are coded once: Arrow numbers the distinct chunks of a batch, only
    these are looked up, and numpy lays their ids out."""

    def __init__(self, missing: Callable[[list[bytes]], list[bytes]], size: int = MEMO):
        self.missing, self.size, self.known, self.older = missing, size, {}, {}

    def ids_of(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of distinct chunks; what was used in this generation or the one before is known."""
        get, older = self.known.get, self.older.get
        got = [get(c) for c in chunks]
        open_ = [i for i, ids in enumerate(got) if ids is None]
        for i in open_:
            got[i] = older(chunks[i])
        new = [i for i in open_ if got[i] is None]
        for i, ids in zip(new, self.missing([chunks[i] for i in new]), strict=True):
            got[i] = ids
        for i in open_:
            if len(chunks[i]) <= MOST_BYTES:
                if len(self.known) >= self.size:
                    self.older, self.known = self.known, {}
                self.known[chunks[i]] = got[i]
        return got

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit bytes."""
        texts = texts.cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or ends[0] == ends[-1]:
            return [b""] * len(texts)
        data, at = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]
        first = _cuts(data, at)
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.append(first, len(data))), pa.py_buffer(data)]).dictionary_encode()
        of = chunks.indices.to_numpy()
        ids = self.ids_of(chunks.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start, each = np.cumsum(size) - size, size[of]
        laid = np.append(0, np.cumsum(each))
        out = np.frombuffer(b"".join(ids), "<u4")[np.arange(laid[-1]) + np.repeat(start[of] - laid[:-1], each)].tobytes()
        cuts = (4 * laid[np.searchsorted(first, at)]).tolist()
        return [out[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]


def _tokenizer(path: str):
    made = kept("packing")
    if path not in made:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        special = [a.content.encode() for a in tok.get_added_tokens_decoder().values()]
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # the vocabulary's characters for bytes
        chars = {b: chr(0x100 + k) for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        piece = tok.model.tokenize

        def whole(texts: list[str]) -> list[bytes]:
            return [array("I", e.ids).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

        def missing(chunks: list[bytes]) -> list[bytes]:
            one = [_PIECE.fullmatch(c) is not None for c in chunks]
            others = iter(whole([c.decode() for c, o in zip(chunks, one, strict=True) if not o]))
            return [array("I", [k.id for k in piece(c.decode("latin-1").translate(chars))]).tobytes() if o else next(others) for c, o in zip(chunks, one, strict=True)]

        made[path] = whole, Chunks(missing), special
    return made[path]


def document_ids(texts: pa.Array, path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit bytes; texts with a special token's string go in whole."""
    whole, chunks, special = _tokenizer(path)
    got = chunks.encode(texts)
    odd = [i for i, t in enumerate(texts.cast(pa.large_binary()).to_pylist()) if any(s in t for s in special)]
    for i, ids in zip(odd, whole([texts[i].as_py() for i in odd]), strict=True):
        got[i] = ids
    return got


def cut_pieces(df: DataFrame, path: str, end_id: int = 2, window: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut into windows; a null text is empty."""
    out = arrow_schema(PIECES)
    tail = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "packing"):
            rows: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), document_ids(b.column(1), path), strict=True):
                ids += tail
                n = len(ids) // 4
                first = n % window or window
                for k, at in enumerate([0, *range(first, n, window)]):
                    end = first if k == 0 else at + window
                    rows.append((doc, k, at, end - at, zlib.crc32(ids[4 * at : 4 * end])))
            yield pa.RecordBatch.from_arrays([pa.array(c, out.field(i).type) for i, c in enumerate(zip(*rows, strict=True))], schema=out)

    return spread(two_columns(df, id_col, text_col)).mapInArrow(run, PIECES)


class OpenBins:
    """Open bins in a bitset keyed by free space; `take` gives the bin and the offset for a length."""

    def __init__(self, window: int, limit: int, first_number: int):
        self.window, self.limit, self.next = window, limit, first_number
        self.free, self.bins, self.n = 0, [[] for _ in range(window + 1)], 0

    def _pop(self, space: int) -> int:
        number = self.bins[space].pop()
        if not self.bins[space]:
            self.free &= ~(1 << space)
        self.n -= 1
        return number

    def take(self, length: int) -> tuple[int, int]:
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._pop(space)
        else:
            if self.n == self.limit:
                self._pop((self.free & -self.free).bit_length() - 1)  # the fullest closes
            number, space, self.next = self.next, self.window, self.next + 1
        if space > length:
            self.bins[space - length].append(number)
            self.free |= 1 << space - length
            self.n += 1
        return number, self.window - space


def pack(pieces: DataFrame, window: int = 1024, open_bins: int = 8192, group_rows: int = 50_000) -> DataFrame:
    """The pieces with sequence_id and offset.

    Every row gets a place, equal rows too (each its own). Rows are dealt to the groups in turn, so no key gathers in one; a
    group is sorted by all columns, so a group that is packed again gets the same places. A sequence holds pieces of one
    group only, which costs less than one open bin a group. No rows give no rows.
    """
    n_groups = max(1, -(-pieces.count() // group_rows))
    out = arrow_schema(PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(window, open_bins, TaskContext.get().partitionId() << 32)
        for b in batches:
            got = [bins.take(length) for length in b.column(3).to_pylist()]
            number, offset = zip(*got, strict=True) if got else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(number, pa.int64()), pa.array(offset, pa.int64())], schema=out)

    return pieces.repartition(n_groups).sortWithinPartitions(F.desc("length"), "ids_crc32", "doc_id", "piece", "start").mapInArrow(run, PACKED)


def pack_documents(df: DataFrame, path: str, end_id: int = 2, window: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """cut_pieces, written once since packing needs their number, then pack."""
    return pack(saved(cut_pieces(df, path, end_id, window, id_col, text_col)), window)
