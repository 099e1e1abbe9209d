"""Operator 4: token counts that follow edits.

A document's text is kept in leaves of whole pre-tokens under a segment tree that sums characters and tokens; the leaves'
lengths and counts are columns, so a document's tree stays with it from one edit to the next. An edit finds its leaves by
descending the tree; only these are pre-tokenised and encoded again, with a leaf of context before them, and the sums
above them are updated. Going on at the right ends where a pre-token of the new text ends at an old leaf's end: from there
on pre-tokens are the old ones. A leaf that an edit makes long is cut again. All other leaves keep their counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import encoder
from .common import arrow_schema, slices, spread, two_columns

#: Characters of a leaf, about.
LEAF = 512
_gap = re.compile(r" (?=\S)")
_solid = re.compile(r"\S")


class CountedText:
    """A text and its tree. count gives token counts of some texts, pieces is the pre-token pattern.

    A leaf ends before a space that a non-space follows, where a pre-token always ends (a hard border), or, in stretches
    without one, at the end of any pre-token that doesn't end with white space (such a one may depend on what follows).
    """

    def __init__(self, text: str, count: Callable[[list[str]], list[int]], pieces: regex.Pattern, state: tuple[list[int], list[int]] | None = None):
        self.count, self.pieces, self.encoded_chars = count, pieces, 0
        if state is None:
            leaves = self._cut(text)
            self._build(leaves, self._counts(leaves))
        else:
            at, leaves = 0, []
            for n in state[0]:
                leaves.append(text[at : at + n])
                at += n
            self._build(leaves, state[1])

    def _build(self, leaves: list[str], tokens: list[int]) -> None:
        self.size = 1
        while self.size < len(leaves):
            self.size *= 2
        blank = self.size - len(leaves)
        self.leaves = leaves + [""] * blank
        self.chars = [0] * self.size + [len(x) for x in self.leaves]
        self.tokens = [0] * self.size + tokens + [0] * blank
        for i in range(self.size - 1, 0, -1):
            self._add_up(i)

    def _cut(self, text: str) -> list[str]:
        """Leaves of about LEAF characters; text begins where a pre-token does."""
        at, out = 0, []
        while len(text) - at > LEAF:
            m = _gap.search(text, at + LEAF, min(len(text), at + 2 * LEAF))
            end = m.start() if m else self._piece_end(text, at)
            if end >= len(text):
                break
            out.append(text[at:end])
            at = end
        return [*out, text[at:]]

    def _piece_end(self, text: str, at: int) -> int:
        """The first such end of a pre-token LEAF or more characters from `at`, where one begins."""
        for m in self.pieces.finditer(text, at):
            if m.end() - at >= LEAF and not text[m.end() - 1].isspace():
                return m.end()
        return len(text)

    def _counts(self, texts: list[str]) -> list[int]:
        self.encoded_chars += sum(map(len, texts))
        return self.count(texts)

    def _add_up(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character, and the character's place in it; past the end: the last leaf with text."""
        if self.chars[1] == 0:
            return 0, 0
        over = at >= self.chars[1]
        at, i = min(at, self.chars[1] - 1), 1
        while i < self.size:
            i *= 2
            if at >= self.chars[i]:
                at -= self.chars[i]
                i += 1
        return i - self.size, at + over

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    @property
    def state(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves."""
        kept = [i for i in range(self.size, 2 * self.size) if self.chars[i]]
        return [self.chars[i] for i in kept], [self.tokens[i] for i in kept]

    def _next(self, leaf: int, step: int) -> int | None:
        leaf += step
        while 0 <= leaf < self.size and not self.leaves[leaf]:
            leaf += step
        return leaf if 0 <= leaf < self.size else None

    def replace(self, start: int, end: int, new: str) -> None:
        """Put new for the characters from start to end (both are held within the text)."""
        start = min(max(start, 0), self.chars[1])
        end = min(max(end, start), self.chars[1])
        first, a = self._leaf_at(start)
        last, b = self._leaf_at(max(end - 1, start)) if end > start else (first, a - 1)
        b += 1
        before = self.leaves[first : last]
        b += sum(map(len, before))
        joined = "".join([*before, self.leaves[last]])
        joined = joined[:a] + new + joined[b:]
        # context: a pre-token may look ahead over white space to the next solid character, so one must lie before the edit
        while (earlier := self._next(first, -1)) is not None:
            if a > 1 and _gap.match(joined[:2]) and _solid.search(joined[1:a]):
                break  # this leaf begins with a hard border that the edit doesn't touch
            context = self.leaves[earlier]
            joined, a, first = context + joined, a + len(context), earlier
            if _solid.search(context):
                break
        while (after := self._next(last, 1)) is not None:
            right = self.leaves[after]
            if _gap.match(right[:2]):
                break
            if joined and not joined[-1].isspace() and any(m.end() == len(joined) for m in self.pieces.finditer(joined + right)):
                break
            joined, last = joined + right, after
        parts = self._cut(joined)
        counts = self._counts(parts)
        if len(parts) > last - first + 1:
            left = [i for i in range(first) if self.leaves[i]]
            right = [i for i in range(last + 1, self.size) if self.leaves[i]]
            tokens = [self.tokens[self.size + i] for i in (*left, *right)]
            self._build([self.leaves[i] for i in left] + parts + [self.leaves[i] for i in right], tokens[: len(left)] + counts + tokens[len(left) :])
            return
        for k, i in enumerate(range(first, last + 1)):
            self.leaves[i], n = (parts[k], counts[k]) if k < len(parts) else ("", 0)
            self.chars[self.size + i], self.tokens[self.size + i] = len(self.leaves[i]), n
        lo, hi = (self.size + first) // 2, (self.size + last) // 2
        while lo >= 1:
            for i in range(lo, hi + 1):
                self._add_up(i)
            lo, hi = lo // 2, hi // 2


def sample_edits(text: str) -> list[tuple[int, int, str]]:
    """The edits that the query makes: one replacement, one deletion and one insertion, each of at most 40 characters, at a quarter, a half and three quarters of the text, in this order."""
    n = len(text)
    return [(n // 4, n // 4 + min(40, n // 8), text[-min(40, n // 8) :] if n >= 8 else "x"), (n // 2, n // 2 + min(24, n // 16), ""), (3 * n // 4, 3 * n // 4, " " + text[: min(32, n)])]


def _tools(path: str, pattern: str) -> tuple[Callable[[list[str]], list[int]], regex.Pattern]:
    _, memo = encoder(path, pattern)
    return lambda xs: [len(c) // 4 for c in memo.encode(xs)], regex.compile(pattern)


TREE = "doc_id long, text string, leaf_chars array<int>, leaf_tokens array<int>"


def keep_trees(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """TREE rows: each text with its tree. Null texts are empty; each row stands alone. One pass, no shuffle."""
    out = arrow_schema(TREE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, pieces = _tools(path, pattern)
        for b in slices(batches, "bpe"):
            state = [CountedText(t, count, pieces).state for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([s[k] for s in state], out.field(2 + k).type) for k in (0, 1))], schema=out)

    return spread(two_columns(df, id_col, text_col)).mapInArrow(run, TREE)


def follow_edits(trees: DataFrame, path: str, pattern: str, edits: Callable[[str], Iterable[tuple[int, int, str]]]) -> DataFrame:
    """TREE rows after the edits, with n_tokens before and n_tokens_edited after, and n_chars_encoded, how many characters
    were encoded again for them.

    edits gives (start, end, new) in code points, each on the text as the edits before left it. No tree is built anew.
    """
    schema = TREE + ", n_tokens long, n_tokens_edited long, n_chars_encoded long"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, pieces = _tools(path, pattern)
        for b in slices(batches, "bpe"):
            rows = []
            for doc, text, chars, tokens in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                tree = CountedText(text, count, pieces, (chars, tokens))
                before = tree.n_tokens
                for e in edits(text):
                    tree.replace(*e)
                rows.append((doc, tree.text, *tree.state, before, tree.n_tokens, tree.encoded_chars))
            yield pa.RecordBatch.from_arrays([pa.array(c, out.field(i).type) for i, c in enumerate(zip(*rows, strict=True))], schema=out)

    return trees.select("doc_id", "text", "leaf_chars", "leaf_tokens").mapInArrow(run, schema)


def count_edits(df: DataFrame, path: str, pattern: str, edits: Callable[[str], Iterable[tuple[int, int, str]]] = sample_edits, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens before and n_tokens_edited after the edits, n_chars_encoded again for them, edited_sha256.

    Null texts are empty; each row stands alone, so repeated rows and null ids need no rule. One pass, no shuffle: what
    keep_trees and follow_edits do, with the trees passed on within the task instead of as columns.
    """
    schema = "doc_id long, n_tokens long, n_tokens_edited long, n_chars_encoded long, edited_sha256 string"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, pieces = _tools(path, pattern)
        for b in slices(batches, "bpe"):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tree = CountedText(text, count, pieces)
                before, tree.encoded_chars = tree.n_tokens, 0
                for e in edits(text):
                    tree.replace(*e)
                rows.append((doc, before, tree.n_tokens, tree.encoded_chars, hashlib.sha256(tree.text.encode()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, out.field(i).type) for i, c in enumerate(zip(*rows, strict=True))], schema=out)

    return spread(two_columns(df, id_col, text_col)).mapInArrow(run, schema)
