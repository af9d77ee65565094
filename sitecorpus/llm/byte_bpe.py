"""Byte-level BPE: text to token ids and back.

The bytes of a token map to Latin-1 characters, so that an Aho-Corasick
automaton over the vocabulary finds the longest token at any place.  A piece is
encoded by taking longest matches, all in one pass of the automaton as long as they fit; where a token cannot stand beside the one
before it (the merges would have joined other parts across their border), the
next shorter token is tried, and if none is left the one before is given up.
Places found to lead nowhere are marked, so no place is tried twice with the same
outcome, and the result is that of the merges in rank order.  Whether two tokens
can be neighbours is kept in a bounded memory.

Defined cases: NULL and empty texts have no tokens and decode to nothing; texts
of any length are encoded whole (a piece without a break too); repeated rows are
encoded each; an empty table gives an empty table.  The output column replaces a
column of that name, other columns are untouched.
"""

from __future__ import annotations

import base64
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from sitecorpus.llm.common import as_bytes, groups, kept, releasing, ship

#: Entries of each generation of a worker's cache of words and their pieces, and of neighbours.
WORDS = 500_000
NEIGHBOURS = 500_000
#: Bytes of the longest word that is kept; bytes of text whose words are looked up in one go.
LONGEST = 64
GROUP = 1 << 20
#: Ids that are decoded at once.
PART = 1 << 18

#: A space and what follows it up to white space, or white space as the pattern of the ranks cuts it.
CHUNK = re.compile(rb" ?[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]")
#: The pattern (a fixed value) under which a chunk of Latin letters is one piece, and ASCII marks up to its end another.
LETTER_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Such chunks in UTF-8: letters of ASCII and from U+00C0 to U+024F but the signs of times and division, then marks.
LETTERS = re.compile(rb"( ?(?:[A-Za-z]+|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+)([!-/:-@\[-`{-~]*)")
#: White space beyond ASCII: such texts are cut by the pattern alone.
FAR_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A byte that no UTF-8 text holds, put between pieces.
BORDER = b"\xff"


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by id; ids are 0, 1, 2, ... without a gap."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ids have gaps")
    return tokens


def halves(tokens: list[bytes]) -> np.ndarray:
    """For each token the two tokens whose merge makes it; itself twice if it is one byte."""
    rank = {t: i for i, t in enumerate(tokens)}
    out = np.empty((len(tokens), 2), np.int32)
    for i, token in enumerate(tokens):
        parts = [rank[token[k : k + 1]] for k in range(len(token))]
        while len(parts) > 2:
            best, at = i, -1
            for k in range(len(parts) - 1):
                made = rank.get(tokens[parts[k]] + tokens[parts[k + 1]], i)
                if made < best:
                    best, at = made, k
            if at < 0:
                raise ValueError(f"token {i} is not made by merges")
            parts[at : at + 2] = [best]
        out[i] = parts if len(parts) == 2 else (i, i)
    return out


class Codec:
    """Encodes and decodes; one per worker."""

    def __init__(self, tokens: list[bytes], parts: np.ndarray, pattern: str, words: int = WORDS):
        self.tokens, self.pattern = tokens, regex.compile(pattern)
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.left, self.right = parts[:, 0].tolist(), parts[:, 1].tolist()
        self.merged = {a << 20 | b: i for i, (a, b) in enumerate(zip(self.left, self.right, strict=True)) if a != i}
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(tokens):
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [self._prefix(t) for t in tokens]
        self.sizes = [len(t) for t in tokens]
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array(self.sizes)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.packed = [i.to_bytes(4, "little") for i in range(len(tokens))]
        self.by_letter = pattern == LETTER_PATTERN
        self.border = self.rank[BORDER] if [t for t in tokens if BORDER in t] == [BORDER] else -1
        self.neighbours: dict[int, bool] = {}
        self.size = words
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _prefix(self, token: bytes) -> int:
        return next((self.rank[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in self.rank), -1)

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges leave the border between ``a`` and ``b`` alone.

        Merges are undone from the last to the first on either side; a merge
        across the border that would have come before the one undone breaks it.
        """
        bound, x, y = len(self.tokens), a, b
        while True:
            across = self.merged.get(x << 20 | y)
            if across is not None and across < bound:
                return False
            x_whole, y_whole = self.right[x] == x, self.left[y] == y
            if x_whole and y_whole:
                return True
            if not x_whole and (x > y or y_whole):
                bound, x = x, self.right[x]
            else:  # of two merges of one rank the left one comes first
                bound, y = y + 1, self.left[y]

    def _beside(self, a: int, b: int) -> bool:
        known = self.neighbours.get(a << 20 | b)
        if known is None:
            if len(self.neighbours) >= NEIGHBOURS:
                self.neighbours.clear()
            known = self.neighbours[a << 20 | b] = self.fits(a, b)
        return known

    def piece_ids(self, piece: bytes, begun: list[int] = []) -> list[int]:
        """Ids of a piece; ``begun`` are longest matches from its start that fit."""
        text, size = piece.decode("latin-1"), len(piece)
        longest, shorter, sizes, known = self.automaton.iter_long, self.shorter, self.sizes, self.neighbours.get
        out = list(begun)
        dead = None
        at, last = sum(map(sizes.__getitem__, out)), out[-1] if out else -1
        while at < size:
            for _, token in longest(text, at):
                end = at + sizes[token]
                if dead and dead[end]:
                    break
                if last >= 0:
                    fits = known(last << 20 | token)
                    if not (self._beside(last, token) if fits is None else fits):
                        break
                out.append(token)
                at, last = end, token
            else:
                break
            dead = dead or bytearray(size + 1)
            while True:
                token = shorter[token]
                while token < 0:
                    dead[at] = 1
                    token = out.pop()
                    at -= sizes[token]
                    token = shorter[token]
                end = at + sizes[token]
                if not dead[end] and (not out or self._beside(out[-1], token)):
                    out.append(token)
                    at, last = end, token
                    break
        return out

    def _pack(self, ids: list[int]) -> bytes:
        return b"".join(map(self.packed.__getitem__, ids))

    def _encoded(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of every piece: longest matches of all in one pass of the automaton, gone on with one by one where two do not fit."""
        if self.border < 0 or not pieces:
            return [self._pack(self.piece_ids(p)) for p in pieces]
        found = self.automaton.iter_long(BORDER.join(pieces).decode("latin-1"))
        tokens = np.array([token for _, token in found], np.int64)
        borders = np.flatnonzero(tokens == self.border)
        inside = np.flatnonzero((tokens[:-1] != self.border) & (tokens[1:] != self.border))
        pairs, which = np.unique(tokens[inside] << 20 | tokens[inside + 1], return_inverse=True)
        known = self.neighbours.get
        fits = [self._beside(k >> 20, k & 0xFFFFF) if (fit := known(k)) is None else fit for k in pairs.tolist()]
        wrong = inside[~np.array(fits, bool)[which]] + 1
        broken, first = np.unique(np.searchsorted(borders, wrong), return_index=True)
        starts = [0, *(borders + 1).tolist()]
        raw = tokens.astype("<u4").tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip(starts, [*borders.tolist(), len(tokens)], strict=True)]
        for i, at in zip(broken.tolist(), wrong[first].tolist(), strict=True):
            out[i] = self._pack(self.piece_ids(pieces[i], tokens[starts[i] : at].tolist()))
        return out

    def _pieces(self, word: bytes) -> list[bytes]:
        """A word cut by the pattern; if that is not the one whose words are chunks, it is a piece."""
        if not self.by_letter:
            return [word]
        match = LETTERS.fullmatch(word)
        if match is None:
            return [p.encode() for p in self.pattern.findall(word.decode())]
        letters, marks = match.groups()
        return [letters, marks] if marks else [word]

    def _learn(self, new: set[bytes]) -> None:
        """Put the ids of these words, and of their pieces, among the known ones; a word of one piece has the ids of that piece."""
        known, old, rank, cuts, todo = self.known, self.old, self.rank, [], {}
        for word in new:
            if (ids := old.get(word)) is not None:
                known[word] = ids
                continue
            pieces = self._pieces(word)
            if len(pieces) > 1:
                cuts.append((word, pieces))
            for piece in pieces:
                if piece not in known:
                    whole = rank.get(piece)  # its own longest match, and what its merges end in
                    if whole is not None:
                        known[piece] = self.packed[whole]
                    elif (ids := old.get(piece)) is not None:
                        known[piece] = ids
                    else:
                        todo[piece] = None
        pieces = list(todo)
        known.update(zip(pieces, self._encoded(pieces), strict=True))
        for word, pieces in cuts:
            known[word] = b"".join(map(known.__getitem__, pieces))
        self.long = [w for w in [*new, *pieces] if len(w) > LONGEST]

    def _words(self, text: bytes) -> list[bytes]:
        if not self.by_letter or not text.isascii() and FAR_SPACE.search(text.decode()):
            return [p.encode() for p in self.pattern.findall(text.decode())]
        return CHUNK.findall(text)

    def _group(self, texts: list[bytes]) -> list[bytes]:
        words = [self._words(t) for t in texts]
        self._learn(set().union(*words).difference(self.known))
        ids = self.known.__getitem__
        out = [b"".join(map(ids, found)) for found in words]
        for word in self.long:
            self.known.pop(word, None)
        if len(self.known) >= self.size:  # a text with very many words of its own leaves none behind
            self.old, self.known = self.known if len(self.known) < 2 * self.size else {}, {}
        return out

    def encode(self, text: bytes) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, in order."""
        return [ids for a, b in groups(texts, GROUP) for ids in self._group(texts[a:b])]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self._bytes(np.frombuffer(ids, "<u4", min(PART, len(ids) // 4 - at), 4 * at)) for at in range(0, len(ids) // 4, PART))

    def _bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of some ids, gathered from all tokens' bytes one after the other."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(self.first[ids] - (ends - sizes), sizes)
        return self.data[places + np.arange(len(places))].tobytes()


class Shared:
    """What the driver reads once and every worker gets: tokens, their halves and the pattern."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        tokens = read_ranks(path)
        self.value = spark.sparkContext.broadcast((path, pattern, tokens, halves(tokens).tobytes()))


def _codec(value) -> Codec:
    path, pattern, tokens, parts = value
    return kept(("codec", path, pattern), lambda: Codec(tokens, np.frombuffer(parts, np.int32).reshape(-1, 2), pattern))


_SHARED: dict[tuple[str, str, str], Shared] = {}


def _shared(spark: SparkSession, path: str, pattern: str):
    key = (spark.sparkContext.applicationId, path, pattern)
    if key not in _SHARED:
        _SHARED[key] = Shared(spark, path, pattern)
    return _SHARED[key].value


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``: the ids of ``text`` as little-endian unsigned 32-bit integers, never NULL."""
    ship(df.sparkSession)
    shared = _shared(df.sparkSession, path, pattern)

    def ids(column: pa.Array) -> pa.Array:
        codec = _codec(shared.value)
        return pa.array(codec.encode_all(as_bytes(column)), pa.binary())

    return df.withColumn(out, F.arrow_udf(releasing(ids), BinaryType())(F.col(text)))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the bytes that ``ids`` stand for, never NULL."""
    ship(df.sparkSession)
    shared = _shared(df.sparkSession, path, pattern)

    def texts(column: pa.Array) -> pa.Array:
        codec = _codec(shared.value)
        return pa.array([codec.decode(x) for x in as_bytes(column)], pa.binary())

    return df.withColumn(out, F.arrow_udf(releasing(texts), BinaryType())(F.col(ids)))
