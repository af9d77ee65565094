"""Token counts without moving words.

Two tiers, both on the side of the tasks.  First every task sums up its own words
in a table of bounded size (those met seldom fall out), the tables meet in a tree
and the most frequent words are encoded once; their lengths go to all workers as
one compact table of at most ``FREQUENT`` words.  Then each task looks up the words
of its texts there, and after that in a cache of its worker; what neither has is
encoded by the library in batches.  The only thing that leaves a task before the
result is its bounded summary.  The tables are there for speed: any contents give
the same counts.

A word here is an optional space and what follows up to white space, or a run of
white space as the tokenizer's own rule ends it: no pre-token crosses its borders.
Texts with white space beyond ASCII go to the library whole, and so do all texts of a
tokenizer whose set-up is not byte-level without a normalizer.

Defined cases: a NULL or empty text has 0 tokens and 0 bytes; texts are counted
whole; repeated rows each count; the output column replaces a column of its name.
"""

from __future__ import annotations

import json
import os
import pickle
import re
from collections import Counter
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from tokenizers import Tokenizer

from sitecorpus.llm.byte_bpe import CHUNK, FAR_SPACE
from sitecorpus.llm.common import Cache, as_bytes, byte_letters, ship

#: Words of the shared table; words a task's summary holds; entries of each generation of a worker's cache.
FREQUENT = 50_000
SUMMARY = 20_000
CACHED = 250_000
#: Bytes of the longest word that a table holds.
LONGEST = 64
#: Latin letters, then marks: two pre-tokens at most.
LETTERS = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?]*)")


def pruned(counts: Counter, size: int) -> Counter:
    """At most ``size`` words: the count of the first one left out is taken off all (heavy hitters stay)."""
    if len(counts) <= size:
        return counts
    cut = sorted(counts.values(), reverse=True)[size]
    return Counter({w: n - cut for w, n in counts.items() if n > cut})


def summary(batches, size: int) -> Counter:
    """Heavy words of a task's texts, in bounded memory."""
    counts: Counter = Counter()
    for texts in batches:
        for text in texts:
            counts.update(w for w in CHUNK.findall(text) if len(w) <= LONGEST)
            if len(counts) > 10 * size:
                counts = pruned(counts, size)
    return pruned(counts, size)


class Counts:
    """Counts tokens; one per worker."""

    def __init__(self, setup: str, frequent: dict[bytes, int], cached: int = CACHED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(setup)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        parts = json.loads(setup)
        before = parts.get("pre_tokenizer") or {}
        added = parts.get("added_tokens") or []
        self.cuts = [a["content"].encode() for a in added]
        self.plain = (
            parts.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex")
            and not before.get("add_prefix_space")
            and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added)
        )
        self.cache = Cache(self._one, cached, LONGEST)
        self.parts = Cache(None, cached, LONGEST)
        self.frequent = frequent

    def lengths(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text by the library alone."""
        return [len(e) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _one(self, word: bytes) -> int:
        return self.lengths([word])[0]

    def _letters(self, match) -> int:
        """Length of letters before marks, each one pre-token: straight from the library's model."""
        word, marks = match.groups()
        total = 0
        for part in (word, marks):
            if part:
                n = self.parts.get(part)
                if n is None:
                    n = len(self.tokenizer.model.tokenize(byte_letters(part)))
                    self.parts.put(part, n)
                total += n
        return total

    def count(self, texts: list[bytes]) -> list[int]:
        out, words, where = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            if not self.plain or any(c in text for c in self.cuts) or not text.isascii() and FAR_SPACE.search(text.decode()):
                out[i] = self.lengths([text])[0]
            else:
                words.append(CHUNK.findall(text))
                where.append(i)
                if sum(map(len, words[-64:])) > 200_000 or len(words) >= 512:
                    self._counted(words, where, out)
                    words, where = [], []
        self._counted(words, where, out)
        return out

    def _counted(self, words: list[list[bytes]], where: list[int], out: list[int]) -> None:
        known, cache, old = self.frequent, self.cache, self.cache.old
        new: dict[bytes, int] = {}
        for found in words:
            new.update((w, 0) for w in found if w not in known and w not in cache and w not in old)
        hard = []
        for w in new:
            if len(w) <= LONGEST and (match := LETTERS.fullmatch(w.decode())):
                new[w] = self._letters(match)
            else:
                hard.append(w)
        todo = iter(hard)
        while some := list(islice(todo, 4096)):
            new.update(zip(some, self.lengths(some), strict=True))
        for i, found in zip(where, words, strict=True):
            total = 0
            for w in found:
                n = known.get(w)
                if n is None:
                    n = new.get(w)
                    if n is None:
                        n = cache[w]
                total += n
            out[i] = total
        for w, n in new.items():
            if len(w) <= LONGEST:
                cache.put(w, n)


_COUNTS: dict[int, Counts] = {}


def frequent_words(df: DataFrame, text: str = "text", size: int = FREQUENT, each: int = SUMMARY) -> list[bytes]:
    """The most frequent words of all texts, at most ``size``; tasks' summaries hold ``each`` and meet in a tree."""

    def summaries(batches):
        found = summary((as_bytes(b.column(0)) for b in batches), each)
        yield pa.RecordBatch.from_pydict({"summary": pa.array([pickle.dumps(dict(found))], pa.binary())})

    def joined(a: bytes, b: bytes) -> bytes:
        return pickle.dumps(dict(pruned(Counter(pickle.loads(a)) + Counter(pickle.loads(b)), size)))

    rows = df.select(text).mapInArrow(summaries, "summary binary").rdd.map(lambda r: bytes(r[0]))
    found = pickle.loads(rows.treeAggregate(pickle.dumps({}), joined, joined, depth=3))
    return [w for w, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:size]]


def token_counts(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens", size: int = FREQUENT) -> DataFrame:
    """Add ``out``: the number of tokens of the whole text."""
    spark = df.sparkSession
    ship(spark)
    with open(path, encoding="utf-8") as f:
        setup = f.read()
    words = frequent_words(df, text, size)
    maker = Counts(setup, {})
    table = dict(zip(words, maker.lengths(words), strict=True)) if words else {}
    shared = spark.sparkContext.broadcast((setup, table))
    key = shared._jbroadcast.id() if shared._jbroadcast is not None else id(shared)

    def counted(column: pa.Array) -> pa.Array:
        if key not in _COUNTS:
            _COUNTS.clear()
            _COUNTS[key] = Counts(*shared.value)
        return pa.array(_COUNTS[key].count(as_bytes(column)), pa.int64())

    return df.withColumn(out, F.arrow_udf(counted, LongType())(F.col(text)))
