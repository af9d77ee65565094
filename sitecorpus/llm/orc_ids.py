"""Token ids in ORC files.

Texts are put in the order of their document ids (range partitioning, then a sort
in each partition), encoded, closed with an end id and written as ORC: ids as lists
of integers under the format's run-length encoding, a row index every ``STRIDE`` rows
and Bloom filters on the document id, so that readers take stripes in parallel and
look up documents by metadata alone.  Next to the ids each row holds the number of
its partition and how many ids come before it there; the place of a document in the
whole sequence is that plus the totals of the partitions before.

Defined cases: a NULL or empty text is its end id alone; NULL document ids come first;
rows with one document id are ordered by their text, and each is written; texts are
encoded whole; an empty table gives files without rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from tokenizers import Tokenizer

from sitecorpus.llm.common import Cache, as_bytes, byte_letters, kept, ship

STRIDE = 1000
STRIPE_BYTES = 16 << 20
#: Entries of each generation of a worker's cache, and its longest word.
CACHED = 300_000
LONGEST = 64
#: Latin letters before a mark: for a lower-casing tokenizer that cuts letters from marks, two words of its model.
#: None of these letters has another NFC form, and each lower-cases alone.
LETTERS = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,;:]?)")
#: The marks of that pattern, each as bytes.
MARKS = {b".", b",", b";", b":"}
#: The rules under which white space in ASCII ends every word.
FIXED_RULES = ["NFC", "Replace", "Lowercase"]


class Encoder:
    """Ids of whole texts by the library; words between ASCII white space are kept in a cache."""

    def __init__(self, setup: str, end: int, cached: int = CACHED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(setup)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.end = np.array([end], "<u4").tobytes()
        self.cached = cached
        self.cache: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.parts = Cache(self._part, cached, LONGEST)
        parts = json.loads(setup)
        rules = [r["type"] for r in (parts.get("normalizer") or {}).get("normalizers", [])]
        cuts = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_word = (
            rules == FIXED_RULES
            and cuts[0].get("type") == "Split"
            and cuts[0].get("behavior") == "Removed"
            and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in parts.get("added_tokens") or [])
        )

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _part(self, part: bytes) -> bytes:
        letters = part.decode()
        return array("I", [t.id for t in self.tokenizer.model.tokenize(letters if part.isascii() else byte_letters(letters))]).tobytes()

    def _latin(self, word: bytes) -> bytes | None:
        """The ids of Latin letters and at most one mark; None for any other word."""
        if word.isascii():
            if word.isalpha():
                return self.parts[word.lower()]
            letters, mark = word[:-1], word[-1:]
            return self.parts[letters.lower()] + self.parts[mark] if letters.isalpha() and mark in MARKS else None
        match = LETTERS.fullmatch(word.decode())
        if match is None:
            return None
        letters, mark = match.groups()
        return self.parts[letters.lower().encode()] + (self.parts[mark.encode()] if mark else b"")

    def _learn(self, words: set[bytes]) -> None:
        """Put the ids of all these words into the cache."""
        cache, old, hard = self.cache, self.old, []
        for w in words:
            ids = old.get(w)
            if ids is None and len(w) <= LONGEST:
                ids = self._latin(w)
            if ids is None:
                hard.append(w)
            else:
                cache[w] = ids
        todo = iter(hard)
        while some := list(islice(todo, 4096)):
            cache.update(zip(some, self._ids(some), strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return [x + self.end for x in self._ids(texts)]
        out: list[bytes] = []
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= 1 << 20:
                out += self._some(texts[start : i + 1])
                start, size = i + 1, 0
        return out + self._some(texts[start:])

    def _some(self, texts: list[bytes]) -> list[bytes]:
        words = [t.split() for t in texts]
        new = set().union(*words).difference(self.cache)
        self._learn(new)
        ids = self.cache.__getitem__
        out = [b"".join([*map(ids, found), self.end]) for found in words]
        for w in new:
            if len(w) > LONGEST:
                del self.cache[w]
        if len(self.cache) >= self.cached:  # a text with very many words of its own leaves none behind
            self.old, self.cache = self.cache if len(self.cache) < 2 * self.cached else {}, {}
        return out


def _lists(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) // 4 for p in packed])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def _in_order(column: Column) -> Column:
    return column.asc_nulls_first()


def _encoder(setup, end: int) -> Encoder:
    """The worker's encoder; its cache lasts from task to task."""
    return kept(("encoder", setup.value, end), lambda: Encoder(setup.value, end))


def write_ids(df: DataFrame, tokenizer: str, path: str, end: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of every text, and ``end``, to ORC files under ``path`` in ascending order of ``doc_id``."""
    spark = df.sparkSession
    ship(spark)
    with open(tokenizer, encoding="utf-8") as f:
        setup = spark.sparkContext.broadcast(f.read())

    def encoded(batches):
        encoder = _encoder(setup, end)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            step = 2000
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                ids = encoder.encode(as_bytes(some.column(1)))
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                places = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                columns = [some.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(places), pa.array(sizes.astype(np.int32)), _lists(ids)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "before", "n_tokens", "ids"])

    kind = df.schema[doc_id].dataType.simpleString()
    (
        df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        .repartitionByRange(_in_order(F.col("doc_id")))
        .sortWithinPartitions(_in_order(F.col("doc_id")), _in_order(F.col("text")))
        .mapInArrow(encoded, f"doc_id {kind}, part int, before long, n_tokens int, ids array<int>")
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(STRIDE))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("compression", "zstd")
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the files under ``path``."""
    rows = spark.read.orc(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("offset") + F.col("before")).alias("start"), F.col("n_tokens").cast("long"), "ids"
    )


def ids_of(spark: SparkSession, path: str, doc_id) -> DataFrame:
    """The rows of one document; stripes whose Bloom filters or statistics rule it out are not read."""
    return spark.read.orc(path).where(F.col("doc_id") == F.lit(doc_id))


def ids_crc32(ids: str = "ids") -> Column:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def sums(column: pa.Array) -> pa.Array:
        values = np.ascontiguousarray(column.values.to_numpy(zero_copy_only=False), "<i4")
        ends = column.offsets.to_numpy()
        return pa.array([zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64())

    return F.arrow_udf(sums, LongType())(F.col(ids))
