"""Token counts that follow edits: a segment tree of pre-tokens per document.

Leaves hold up to `LEAF` pre-tokens; each node of the tree has the characters and the tokens below it.
An edit goes down by character offsets to its first leaf. Pre-tokens are found again from the last one
that ends far enough before the edit not to have seen it, until a border of a new pre-token meets a
border of an old one behind the edit: from there on all pre-tokens are the old ones. Only those between
are encoded again; the sums on the paths above the changed leaves are updated.

Where a pre-token ends may hang on the blanks behind it, however many, and on CONTEXT characters from the
first other one on, as in all patterns of this family; patterns that look behind or further ahead don't fit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.llm.bpe import Counts, codec
from pliego.llm.words import slices

LEAF = 64
#: Pre-tokens after which a worker's counts start anew.
MEMO = 500_000
#: Characters that may decide where a pre-token ends, from the first one behind its end that isn't blank.
CONTEXT = 4


def settled(text: str) -> int:
    """The last place of a text up to which borders of pre-tokens stay, whatever is behind the text (-1: none)."""
    return len(text[: max(0, len(text) - CONTEXT + 1)].rstrip()) - 1


class TokenTree:
    """The pre-tokens of one text, with token counts that stay right under edits."""

    def __init__(self, text: str, known: Counts):
        self.known, self.split = known, known.own.split
        if len(known) > MEMO:
            known.clear()
        self.encoded = 0
        self._grow([[]] if not text else self._leaves(self.split(text)))

    def _leaves(self, pieces: list[str]) -> list[list[str]]:
        return [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]

    def _sums(self, leaf: list[str]) -> tuple[int, int]:
        return sum(map(len, leaf)), sum(map(self.known.__getitem__, leaf))

    def _grow(self, leaves: list[list[str]], known: list[tuple[int, int]] | None = None) -> None:
        """Build the tree above the leaves; node i has the children 2i and 2i + 1."""
        self.leaves = leaves
        self.width = 1 << max(0, len(leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (c, t) in enumerate(known or map(self._sums, leaves)):
            self.chars[self.width + i], self.tokens[self.width + i] = c, t
        for i in range(self.width - 1, 0, -1):
            self._add(i)

    def _add(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def count(self) -> int:
        return self.tokens[1]

    def _find(self, offset: int) -> tuple[int, int]:
        """The leaf with a character, and the characters before that leaf."""
        i, before = 1, 0
        while i < self.width:
            i *= 2
            if offset >= before + self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return i - self.width, before

    def edit(self, start: int, length: int, insert: str) -> None:
        """Replace `length` characters from `start` on by `insert`; what lies outside the text is clipped."""
        total = self.chars[1]
        start = min(max(start, 0), total)
        stop = min(start + max(length, 0), total)
        first, before = self._find(max(0, start - CONTEXT))
        # the pre-tokens that can't have seen the edit stay
        while (sure := settled("".join(self.leaves[first])[: max(0, start - before)])) < 0 and first:
            first -= 1
            before -= self.chars[self.width + first]
        kept, at = 0, before
        leaf = self.leaves[first]
        while kept < len(leaf) and at + len(leaf[kept]) <= before + sure:
            at += len(leaf[kept])
            kept += 1
        old = leaf[kept:]
        last, end = first, at + sum(map(len, old))
        while True:
            while end < stop + CONTEXT and last + 1 < len(self.leaves):
                last += 1
                old += self.leaves[last]
                end += self.chars[self.width + last]
            text = "".join(old)
            text = text[: start - at] + insert + text[stop - at :]
            shift = len(insert) - (stop - start)
            borders, place = {}, at
            for i, piece in enumerate(old):
                if place >= stop:
                    borders[place + shift] = i
                place += len(piece)
            new, place, meets = [], at, len(old)
            final = last + 1 == len(self.leaves)
            sure = len(text) if final else settled(text)
            for piece in self.split(text):
                if place in borders and place - at <= sure:
                    meets = borders[place]
                    break
                new.append(piece)
                place += len(piece)
            else:
                if not final:
                    stop_at = last
                    end_goal = end + 1
                    while end < end_goal and last + 1 < len(self.leaves):
                        last += 1
                        old += self.leaves[last]
                        end += self.chars[self.width + last]
                    if last > stop_at:
                        continue
            break
        self.encoded += len(new)
        self._put(first, last, leaf[:kept] + new + old[meets:])

    def _put(self, first: int, last: int, pieces: list[str]) -> None:
        """Put pre-tokens in the place of some leaves."""
        count = last - first + 1
        if len(pieces) <= 2 * LEAF * count and (pieces or len(self.leaves) == 1 or count < len(self.leaves)):
            size = max(1, -(-len(pieces) // count))
            for k in range(count):
                part = pieces[k * size : (k + 1) * size]
                self.leaves[first + k] = part
                i = self.width + first + k
                self.chars[i], self.tokens[i] = self._sums(part)
                while i > 1:
                    i //= 2
                    self._add(i)
            return
        known = [(self.chars[self.width + i], self.tokens[self.width + i]) for i in range(len(self.leaves))]
        fresh = self._leaves(pieces)
        known[first : last + 1] = [self._sums(p) for p in fresh]
        self._grow(self.leaves[:first] + fresh + self.leaves[last + 1 :], known)


EDIT = "array<struct<start:int,length:int,insert:string>>"


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """`docs` with a column edits, from a table (doc_id, seq, start, length, insert), in order of seq and then of the rest.

    One document's edits meet in its row; documents without edits have null.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "start", "length", "insert"))), lambda e: F.struct(e["start"].alias("start"), e["length"].alias("length"), e["insert"].alias("insert")))
    return docs.drop("edits").join(edits.groupBy("doc_id").agg(ordered.alias("edits")), "doc_id", "left")


COUNTED = "doc_id long, n_before long, n_tokens long, n_pieces long, n_reencoded long"


def count_tokens(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id, n_before, n_tokens, n_pieces and n_reencoded of each row of `docs` (doc_id, text, edits).

    Edits apply one after another: `length` characters (code points) from `start` on give way to
    `insert`. Offsets outside the text are clipped, nulls in an edit are 0 or empty, null edits are
    none, a null text is empty. n_before counts the text's tokens, n_tokens those after all edits;
    n_pieces counts its pre-tokens and n_reencoded those that edits made the tree encode again.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Counts(codec(shared.value, pattern))
        for batch in slices(batches):
            out = []
            for text, edits in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist(), strict=True):
                tree = TokenTree(text or "", known)
                before, pieces = tree.count, sum(map(len, tree.leaves))
                for e in edits or ():
                    if e is not None:
                        tree.edit(e["start"] or 0, e["length"] or 0, e["insert"] or "")
                out.append((before, tree.count, pieces, tree.encoded))
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=[c.split()[0] for c in COUNTED.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("edits").cast(EDIT))
    return rows.mapInArrow(work, COUNTED)
