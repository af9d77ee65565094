"""Benchmark decontamination by winnowing.

Words are folded to lower case (A-Z) and stand for 64-bit hashes.  A benchmark item
gives its windows of ``WINDOW`` words (a shorter item gives itself as one window).
Of every window only the smallest hash of its k-grams is kept: the fingerprint.  In a
document the smallest k-gram hash of each window is the same function of the words, so
every window that the document shares with an item meets a fingerprint of the item;
hits are then extended to whole windows by comparing the words themselves, and
neighbouring windows merge into spans.

The windows of all items are grouped and cut into blocks of at most ``BLOCK`` windows,
whose number comes from a count.  One block at a time goes to the tasks; documents
pass it in one narrow scan, without a shuffle, and between blocks they are written.
So a benchmark of any size is compared whole, with a bounded table in each task.

Defined cases: NULL or empty texts have no words and no hits; items without words have
no windows; items with equal texts are each reported; NULL item ids are reported as
NULL texts are not joined (left out of the list, their spans still count); repeated
documents are each reported; texts are searched whole; empty tables give no hits.
Columns of the documents stay; the output column replaces one of its name.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from sitecorpus.checkpoints import cut
from sitecorpus.llm.common import PLAIN, as_bytes, drop_kept, free_name, groups, mix, releasing, ship

#: Words of a window, and of the k-grams whose smallest hash stands for a window.
WINDOW = 10
GRAM = 5
#: Windows that one block holds.
BLOCK = 200_000

SPAN = StructType([StructField("start", IntegerType(), False), StructField("end", IntegerType(), False)])
RESULT = StructType(
    [
        StructField("n_words", LongType(), False),
        StructField("spans", ArrayType(SPAN, False), False),
        StructField("item_ids", ArrayType(StringType(), False), False),
    ]
)


def grams(hashes: np.ndarray, texts: np.ndarray, k: int) -> np.ndarray:
    """A hash for every k words that follow each other; the largest value where they leave their text."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out + hashes[i : n + i] + np.uint64(i + 1))
    out[texts[:n] != texts[k - 1 : n + k - 1]] = np.iinfo(np.uint64).max
    return out


def minima(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` values that follow each other."""
    n = max(0, len(values) - width + 1)
    out = values[:n].copy()
    for i in range(1, width):
        np.minimum(out, values[i : n + i], out=out)
    return out


def shape(length: int) -> tuple[int, int]:
    """Words of a k-gram, and k-grams of a window, for windows of ``length`` words."""
    k = min(GRAM, length)
    return k, length - k + 1


def window_prints(hashes: np.ndarray, texts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts of the windows that lie in one text, and their fingerprints."""
    k, width = shape(length)
    prints = minima(grams(hashes, texts, k), width)
    inside = texts[: len(prints)] == texts[length - 1 : length - 1 + len(prints)]
    starts = np.flatnonzero(inside)
    return starts, prints[starts]


class Index:
    """The windows of one block: by length, fingerprints and the windows' words with the items that hold them."""

    def __init__(self, rows: list[tuple[bytes, list[str]]]):
        """``rows``: the words of a window joined by spaces, and the ids of its items."""
        by_length: dict[int, dict[bytes, list[str]]] = defaultdict(dict)
        for words, items in rows:
            by_length[words.count(b" ") + 1][words] = items
        self.windows = dict(by_length)
        self.prints = {}
        for length, windows in self.windows.items():
            _, texts, _, _, hashes = PLAIN.of_texts(list(windows))
            self.prints[length] = np.unique(window_prints(hashes, texts, length)[1])

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text the number of its words, the hit spans (word numbers, end exclusive) and the items."""
        out = []
        for a, b in groups(texts):
            data, of, starts, ends, hashes = PLAIN.of_texts(texts[a:b])
            counts = np.bincount(of, minlength=b - a)
            first = np.cumsum(counts) - counts
            hits: list[list[tuple[int, int]]] = [[] for _ in range(b - a)]
            items: list[set[str]] = [set() for _ in range(b - a)]
            for length, windows in self.windows.items():
                places, prints = window_prints(hashes, of, length)
                known = self.prints[length]
                at = np.searchsorted(known, prints)
                at[at == len(known)] = 0
                for place in places[known[at] == prints].tolist():
                    words = b" ".join([data[x:y] for x, y in zip(starts[place : place + length], ends[place : place + length], strict=True)]).lower()
                    if (found := windows.get(words)) is not None:
                        doc = int(of[place])
                        hits[doc].append((place - int(first[doc]), place - int(first[doc]) + length))
                        items[doc].update(found)
            out += [(int(n), merged(h), i) for n, h, i in zip(counts, hits, items, strict=True)]
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch, as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``words, item_ids``: every window of the items, once."""
    words = F.regexp_extract_all(F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    last = F.greatest(F.size("words") - F.lit(window), F.lit(0))
    return (
        items.select(F.col(item_id).cast("string").alias("item_id"), words.alias("words"))
        .where(F.size("words") > 0)
        .select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", F.slice("words", i + 1, window)))).alias("words"))
        .groupBy("words")
        .agg(F.collect_set("item_id").alias("item_ids"))
    )


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", out: str = "contamination", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Add ``out``: ``n_words``, the hit ``spans`` in word numbers, and the ``item_ids`` of the items found."""
    spark = docs.sparkSession
    ship(spark)
    windows = cut(item_windows(items, item_id, item_text, window), "windows")
    blocks = max(1, -(-windows.count() // max(1, block // 2)))  # twice as many as needed, as hashes spread unevenly
    state = free_name(docs, "__found")
    frame = docs
    for i in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == i).toArrow().to_pydict()
        index = spark.sparkContext.broadcast(Index([(w.encode(), ids) for w, ids in zip(rows["words"], rows["item_ids"], strict=True)]))
        here = F.arrow_udf(releasing(_scanner(index)), RESULT)(F.col(text))
        if i == 0:
            frame = frame.withColumn(state, here)
        else:
            both = free_name(frame, "__here")
            frame = cut(frame, "scanned").withColumn(both, here)
            both_spans = F.array_sort(F.concat(F.col(state)["spans"], F.col(both)["spans"]))
            ids = F.array_sort(F.array_union(F.col(state)["item_ids"], F.col(both)["item_ids"]))
            joined = F.struct(F.col(state)["n_words"].alias("n_words"), both_spans.alias("spans"), ids.alias("item_ids"))
            frame = frame.withColumn(state, joined).drop(both)
    if blocks > 1:
        frame = frame.withColumn(state, F.col(state).withField("spans", _merged(F.col(state)["spans"])))
    if out.lower() in {c.lower() for c in docs.columns}:
        frame = frame.drop(out)
    return frame.withColumnRenamed(state, out)


def _scanner(index):
    def scan(column: pa.Array) -> pa.Array:
        drop_kept()
        found = index.value.scan(as_bytes(column))
        rows = [{"n_words": n, "spans": [{"start": s, "end": e} for s, e in spans], "item_ids": sorted(ids)} for n, spans, ids in found]
        return pa.array(rows, ARROW)

    return scan


def _merged(spans):
    """Sorted spans, those that overlap or touch as one."""
    none = F.array().cast(ArrayType(SPAN, False))

    def add(done, span):
        last = F.element_at(done, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (span["start"] <= F.try_element_at(done, F.lit(-1))["end"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, none, add)


ARROW = pa.struct(
    [
        pa.field("n_words", pa.int64(), False),
        pa.field("spans", pa.list_(pa.struct([pa.field("start", pa.int32(), False), pa.field("end", pa.int32(), False)])), False),
        pa.field("item_ids", pa.list_(pa.string()), False),
    ]
)
