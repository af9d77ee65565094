"""Fill-in-middle: a text is cut twice at unit boundaries and its middle moved to the end.

The units are lines, each with its line feed.  The boundaries of a text, as offsets
into its UTF-8 bytes, are kept in a compressed set: offsets are split by their upper
bits into containers of 65,536, and each container is a sorted array, a bitmap or a
list of runs, whichever is smallest.  Cumulative cardinalities say which container
holds the k-th boundary, and a select inside that container gives the offset, so both
cuts of a text come from two look-ups and no list of its lines is made.

A draw is a 32-bit number from the digest of seed and document id, so a text is cut in
the same way wherever and whenever it is met.

Defined cases: a NULL or empty text, and one that holds a sentinel, stays plain; a NULL
document id draws as an empty one; rows with one id and one text, and so all ties, get
the same form; texts are cut whole, whatever their length, with one container of
boundaries built at a time; an empty table gives an empty table; a column with the name
of the result is replaced.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sitecorpus.llm.common import as_bytes, free_name, ship, whole_text

WIDTH = 1 << 16
#: A sorted array of 16-bit values is smaller than a bitmap up to here.
MOST_IN_ARRAY = 4096
BITMAP_BYTES = WIDTH // 8
LINE_FEED = 10


class Sentinels(NamedTuple):
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


class ArrayContainer:
    """Sorted 16-bit values."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.values[k])


class BitmapContainer:
    """One bit for each value, with the number of values before each 64-bit word."""

    def __init__(self, values: np.ndarray):
        bits = np.zeros(WIDTH, np.uint8)
        bits[values] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)))

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, "right")) - 1
        inside = np.unpackbits(self.words[word : word + 1].view(np.uint8), bitorder="little")
        return word * 64 + int(np.flatnonzero(inside)[k - self.before[word]])


class RunContainer:
    """Runs of consecutive values, with the number of values before each."""

    def __init__(self, values: np.ndarray, first: np.ndarray):
        self.starts = values[first].astype(np.uint16)
        self.before = first

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


def container(values: np.ndarray):
    """The smallest container of sorted values below ``WIDTH``."""
    first = np.flatnonzero(np.concatenate(([True], np.diff(values) != 1)))
    plain = min(2 * len(values) if len(values) <= MOST_IN_ARRAY else BITMAP_BYTES, BITMAP_BYTES)
    if 2 + 4 * len(first) < plain:
        return RunContainer(values, first)
    return ArrayContainer(values) if len(values) <= MOST_IN_ARRAY else BitmapContainer(values)


class Boundaries:
    """The offsets at which the units of ``data`` end, ascending."""

    def __init__(self, data: bytes):
        array = np.frombuffer(data, np.uint8)
        self.keys: list[int] = []
        self.containers: list = []
        totals = [0]
        for key in range(len(data) // WIDTH + 1):
            # An offset is one more than the place of the unit's last byte.
            at, end = max(0, key * WIDTH - 1), min(len(data), (key + 1) * WIDTH - 1)
            ends = np.flatnonzero(array[at:end] == LINE_FEED) + (at + 1 - key * WIDTH)
            if end == len(data) and end > at and array[-1] != LINE_FEED:
                ends = np.append(ends, len(data) - key * WIDTH)
            if len(ends):
                self.keys.append(key)
                self.containers.append(container(ends))
                totals.append(totals[-1] + len(ends))
        self.totals = np.array(totals)

    def __len__(self) -> int:
        return int(self.totals[-1])

    def select(self, k: int) -> int:
        """The k-th offset, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        which = int(np.searchsorted(self.totals, k, "right")) - 1
        return self.keys[which] * WIDTH + self.containers[which].select(k - int(self.totals[which]))

    def end_of(self, units: int) -> int:
        """Where the first ``units`` units end."""
        return self.select(units - 1) if units else 0


def _checked(sentinels: Sentinels) -> Sentinels:
    """Sentinels none of which can be met across the edge of another."""
    for a in sentinels:
        for b in sentinels:
            if any(a[-i:] == b[:i] for i in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError(f"sentinels {a!r} and {b!r} overlap")
    if len(set(sentinels)) < 3 or "" in sentinels or any(a in b for a in sentinels for b in sentinels if a != b):
        raise ValueError("sentinels must differ, and none may hold another")
    return sentinels


RESULT = StructType(
    [
        StructField("n", LongType(), False),
        StructField("form", StringType(), False),
        StructField("prefix_chars", LongType()),
        StructField("middle_chars", LongType()),
        StructField("output", StringType(), False),
    ]
)


def _former(sentinels: Sentinels, rate: int, spm: int):
    names = list(RESULT.names)
    marks = [s.encode() for s in sentinels]

    def form(digest: str, data: bytes) -> tuple:
        ends = Boundaries(data)
        n = len(ends)
        h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
        if not data or any(m in data for m in marks) or h3 % 100 >= rate:
            return n, "plain", None, None, data
        a, b = (ends.end_of(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        prefix, middle, suffix = data[:a], data[a:b], data[b:]
        p, s, m = marks
        if h4 % 100 < spm:
            name, parts = "spm", (s, suffix, p, prefix, m, middle)
        else:
            name, parts = "psm", (p, prefix, s, suffix, m, middle)
        return n, name, len(prefix.decode()), len(middle.decode()), b"".join(parts)

    def formed(digests: pa.Array, texts: pa.Array) -> pa.Array:
        rows = [form(d, t) for d, t in zip(digests.to_pylist(), as_bytes(texts), strict=True)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        whole = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())]
        whole.append(pa.array(columns[4], pa.binary()).cast(pa.string()))
        fields = [pa.field(f, c.type, f in ("prefix_chars", "middle_chars")) for f, c in zip(names, whole, strict=True)]
        return pa.StructArray.from_arrays(whole, fields=fields)

    return formed


def fill_in_middle(
    df: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, sentinels: Sentinels = Sentinels(), doc_id: str = "doc_id", text: str = "text", out: str = "fim"
) -> DataFrame:
    """Add ``out``: number of units, form (``plain``, ``psm`` or ``spm``), code points of prefix and middle, and the output text.

    Of 100 texts about ``rate`` are cut, and of these about ``spm`` in 100 have the suffix first.
    """
    ship(df.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    made = F.arrow_udf(_former(_checked(sentinels), rate, spm), RESULT)(digest, whole_text(text))
    name = free_name(df, "__formed")
    frame = df.withColumn(name, made)
    if out.lower() in {c.lower() for c in df.columns}:
        frame = frame.drop(out)
    return frame.withColumnRenamed(name, out)


def restored(form: Column, output: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text again, read from an output and its form alone."""
    p, s, m = (F.lit(x) for x in sentinels)

    def between(text: Column, left: Column, right: Column) -> Column:
        return F.split_part(F.split_part(text, left, F.lit(2)), right, F.lit(1))

    middle = F.split_part(output, m, F.lit(2))
    psm = F.concat(between(output, p, s), middle, between(output, s, m))
    spm = F.concat(between(output, p, m), middle, between(output, s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
