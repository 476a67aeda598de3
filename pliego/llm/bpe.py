"""Byte-level BPE encoding and decoding.

Every byte of a pre-token becomes the Latin-1 character of the same number, so that one Aho-Corasick
automaton over strings (pyahocorasick) finds the vocabulary's byte strings. The encoder then takes
the longest match at each place and keeps it if it is compatible with the token before it, that is,
if the merges of the two joined byte strings would stop at this very pair. Otherwise it tries the
next shorter match, and at the last it takes the token before back. Places known to be dead ends are
never entered again, so the work is linear in the length. Compatibility is memoised by pair.

Results equal those of tiktoken's `encode_ordinary` for the same ranks and pattern: a pre-token that
is itself in the vocabulary is one token, all others follow the merges in order of rank.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.llm.words import give_back, slices

def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


#: Entries after which a worker's memo starts anew; the one before is kept beside it, so that frequent pre-tokens stay.
MEMO = 200_000
#: Bytes up to which longest matches are found by trying each length in a dictionary.
SHORT = 32


class Codec:
    """One vocabulary. `ranks`: from byte strings to ids; every single byte must be among them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.texts = ranks, {i: b for b, i in ranks.items()}
        self.sizes = {i: len(b) for b, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.halves: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int] = {}
        self.fits: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = {}, {}
        self.memo = Packed(self)
        self.known: dict[bytes, int] = {}
        automaton = ahocorasick.Automaton()
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            parts = [i] if len(token) == 1 else self._halve(token, i)
            if parts:
                self.known[token] = i
                automaton.add_word(token.decode("latin-1"), (len(token), i))
        automaton.make_automaton()
        self.matches = automaton.iter
        for token in (w.encode("latin-1") for w in automaton.keys()):
            for size in range(len(token) - 1, 0, -1):
                if token[:size].decode("latin-1") in automaton:
                    self.shorter[ranks[token]] = ranks[token[:size]]
                    break

    def _halve(self, token: bytes, own: int) -> bool:
        """Find the last merge that makes a token; False if the merges never make it."""
        parts = self.merge(token, own)
        if len(parts) != 2:
            return False
        self.halves[own] = (parts[0], parts[1])
        return True

    def merge(self, text: bytes, below: float = float("inf")) -> list[int]:
        """Tokens after all merges of ranks under `below`, by the definition. Only for short texts."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _edge(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """The tokens that stand at one edge while `token` grows, each with the rank that ends it."""
        known = self.edges[side].get(token)
        if known is None:
            ends, at, known = float("inf"), token, []
            while True:
                known.append((self.texts[at], ends))
                if at not in self.halves:
                    break
                ends, at = at, self.halves[at][side]
            self.edges[side][token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before the two tokens are complete.

        Of two merges of one rank the left one comes first: a merge across the border beats one
        inside the right token, and loses against one inside the left token.
        """
        rank_of, rights = self.ranks.get, self._edge(right, 0)
        for a, a_ends in self._edge(left, 1):
            for b, b_ends in rights:
                rank = rank_of(a + b)
                if rank is not None and rank < a_ends and rank <= b_ends:
                    return False
        return True

    def fit(self, left: int, right: int) -> bool:
        """`compatible`, memoised."""
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            known = self.fits[key] = self.compatible(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """The tokens of one pre-token."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        count = len(piece)
        longest = [-1] * count
        if count > SHORT:
            sizes = [0] * count
            for end, (size, token) in self.matches(piece.decode("latin-1")):
                if size > sizes[end - size + 1]:
                    sizes[end - size + 1], longest[end - size + 1] = size, token
        length, shorter, fits, known = self.sizes, self.shorter, self.fits, self.known
        alive = bytearray(b"\x01") * (count + 1)
        out: list[int] = []
        at, token = 0, -1
        while at < count:
            if token < 0:
                token = longest[at]
                if token < 0:
                    end = count
                    while (token := known.get(piece[at:end], -1)) < 0:
                        end -= 1
                    longest[at] = token
            end = at + length[token]
            fit = alive[end]
            if fit and out:
                fit = fits.get(out[-1] << 32 | token)
                if fit is None:
                    fit = self.fit(out[-1], token)
            if fit:
                out.append(token)
                at, token = end, -1
            elif token in shorter:
                token = shorter[token]
            else:
                # nothing fits here: never come back to this place, and shorten the token before it
                alive[at] = 0
                token = out.pop()
                at -= length[token]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        pieces, out = self.split(text), []
        for start in range(0, len(pieces), MEMO):
            if len(self.memo) > MEMO:
                self.memo = Packed(self, dict(self.memo))
            if len(self.fits) > 2 * MEMO:
                self.fits.clear()
            out += map(self.memo.__getitem__, pieces[start : start + MEMO])
        return b"".join(out)

    def forget(self) -> None:
        """Drop what was learnt from texts; the vocabulary stays."""
        self.memo = Packed(self)
        self.fits.clear()
        for known in self.edges:
            known.clear()


class Packed(dict):
    """Packed ids of pre-tokens, taken from the memo before or made when they are first asked for."""

    def __init__(self, own: Codec, before: dict[str, bytes] | None = None):
        self.own, self.before = own, before or {}

    def __missing__(self, piece: str) -> bytes:
        found = self.before.get(piece)
        if found is None:
            found = pack(self.own.encode_piece(piece.encode("utf-8")))
        self[piece] = found
        return found


class Counts(dict):
    """Token counts of pre-tokens, made when they are first asked for."""

    def __init__(self, own: Codec):
        self.own = own

    def __missing__(self, piece: str) -> int:
        found = self[piece] = len(self.own.encode_piece(piece.encode("utf-8")))
        return found


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from a file of lines of a base64 byte string and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


_CODECS: dict[tuple[int, str], Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """A worker's codec for a vocabulary, made once."""
    key = (hash(data), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _TEXTS.clear()
        _CODECS[key] = Codec(parse_ranks(data), pattern)
    return _CODECS[key]


def forget() -> None:
    """Drop what this worker's codecs learnt from texts: workers live on after their task, beside those of later stages."""
    for own in _CODECS.values():
        own.forget()
    give_back()


_TEXTS: dict[int, dict[int, bytes]] = {}


def token_texts(data: bytes) -> dict[int, bytes]:
    """A worker's byte strings of all ids: all that decoding needs. A codec of the same data that it holds has them, and stays for the tasks to come."""
    key = hash(data)
    for (held, _), own in _CODECS.items():
        if held == key:
            return own.texts
    if key not in _TEXTS:
        _TEXTS.clear()
        _TEXTS[key] = {i: b for b, i in parse_ranks(data).items()}
    return _TEXTS[key]


def decode_ids(packed: bytes, texts: dict[int, bytes]) -> bytes:
    """The bytes of ids as `Codec.encode` packs them."""
    return b"".join(map(texts.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def _with_column(frame: DataFrame, name: str, column: str, convert) -> DataFrame:
    """The frame with one binary column more (or in place of one of that name), made row by row from another."""
    rest = [c for c in frame.columns if c != name]
    others = [F.col(f"`{c}`") for c in rest if c != column]
    # the column itself goes to Python and back once, beside the others
    packed = frame.select((F.struct(*others) if others else F.lit(True)).alias("row"), F.col(f"`{column}`").alias("text"))
    schema = packed.select("row", "text", F.lit(b"").alias("made")).schema

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = convert(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(made, pa.binary())], names=["row", "text", "made"])
        forget()

    made = packed.mapInArrow(work, schema)
    return made.select(*[(F.col("text") if c == column else F.col("row")[c]).alias(c) for c in rest], F.col("made").alias(name))


def encode(frame: DataFrame, ranks: bytes, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Add the ids of each whole text as one binary column of little-endian unsigned 32-bit integers.

    `ranks`: the content of a rank file; about a megabyte for 50,000 tokens, sent to executors as a
    broadcast whatever the size of the input. Null and empty texts have no ids (an empty binary);
    repeated rows stay; other columns stay as they are, one named like `out` is replaced.
    """
    shared = frame.sparkSession.sparkContext.broadcast(ranks)

    def convert(texts: list[str | None]) -> list[bytes]:
        own = codec(shared.value, pattern)
        return [own.encode(t) if t else b"" for t in texts]

    return _with_column(frame, out, text, convert)


def decode(frame: DataFrame, ranks: bytes, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that ids from `encode` stand for. Null ids give no bytes; an unknown id is an error."""
    shared = frame.sparkSession.sparkContext.broadcast(ranks)

    def convert(rows: list[bytes | None]) -> list[bytes]:
        texts = token_texts(shared.value)
        return [decode_ids(r, texts) if r else b"" for r in rows]

    return _with_column(frame, out, ids, convert)
