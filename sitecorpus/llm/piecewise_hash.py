"""Context-triggered piecewise hashing.

A rolling hash over the last seven bytes decides where a text is cut: at block size
``3 * 2 ** k`` wherever the hash, plus one, is a multiple of it.  Each chunk gives one
letter, and a fingerprint is the block size, the letters at that size, and the letters
at twice that size, parted by colons.  As a cut depends on seven bytes alone, an edit
changes the letters around it and no others.  The block size follows the length of the
text (the smallest with 64 blocks), halved until there are 32 chunks.  A signature has 64
letters at most, at the double size 32; its last letter stands for all that is left.

Fingerprints are compared by edit distance where their block sizes are equal or one is
twice the other, at the sizes that both have: 1 less the edits as a share of the longer
signatures.  Otherwise their likeness is 0.

Defined cases: a NULL text is an empty one, with the fingerprint ``3::``; equal texts
have equal fingerprints and likeness 1; texts of any length are read whole, in blocks of
1 MiB; an empty table gives an empty table; a column with the name of the result is
replaced.  ``edited_pairs`` states its own cases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitecorpus.checkpoints import cut
from sitecorpus.llm.common import GROUP_BYTES, as_bytes, free_name, groups, ship

ROLLED = 7
SMALLEST = 3
#: Letters of a signature, and of the one at the double block size.
LETTERS = 64
FEWER = LETTERS // 2
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
LEVELS = 33

PRIME = (1 << 31) - 1
BASE = 1_103_515_245
_VALUES = np.array([(b + 1) * 69_069_069 % PRIME for b in range(256)], np.uint64)


def _table(base: int) -> np.ndarray:
    """Powers of ``base`` for the places of one block."""
    powers = np.ones(1, np.uint64)
    while len(powers) < GROUP_BYTES:
        powers = np.concatenate((powers, powers * np.uint64(pow(base, len(powers), PRIME)) % np.uint64(PRIME)))
    return powers[:GROUP_BYTES]


_TABLES: dict[int, np.ndarray] = {}


def _powers(base: int, places: np.ndarray) -> np.ndarray:
    """``base ** place`` modulo the prime, for places of any size."""
    if base not in _TABLES:
        _TABLES[base] = _table(base)
    low = _TABLES[base][places % GROUP_BYTES]
    blocks = places // GROUP_BYTES
    if not blocks.any():
        return low
    kinds, which = np.unique(blocks, return_inverse=True)
    high = np.array([pow(base, int(k) * GROUP_BYTES, PRIME) for k in kinds], np.uint64)[which]
    return low * high % np.uint64(PRIME)


def _sums_before(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For ascending ``places``, the polynomial sum of all bytes before each, modulo the prime."""
    prime = np.uint64(PRIME)
    out, total = np.zeros(len(places), np.uint64), 0
    weights = _powers(BASE, np.arange(min(len(data), GROUP_BYTES)))
    for at in range(0, len(data) + 1, GROUP_BYTES):
        first, last = np.searchsorted(places, [at, at + GROUP_BYTES])
        if first == len(places):
            break
        block = data[at : at + GROUP_BYTES]
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(_VALUES[block] * weights[: len(block)] % prime, out=sums[1:])
        scale = pow(BASE, at, PRIME)
        out[first:last] = (sums[places[first:last] - at] % prime * np.uint64(scale) + np.uint64(total)) % prime
        total = (total + int(sums[-1]) % PRIME * scale) % PRIME
    return out


def _letters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One letter for each chunk; equal chunks give equal letters wherever they stand."""
    places = np.unique(np.concatenate((starts, ends)))
    sums = _sums_before(data, places)
    prime = np.uint64(PRIME)
    spans = (sums[np.searchsorted(places, ends)] + prime - sums[np.searchsorted(places, starts)]) % prime
    hashes = spans * _powers(pow(BASE, -1, PRIME), starts) % prime
    return ALPHABET[(hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58)).astype(np.int64)]


def _triggers(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Block by block, the places after which a cut can fall, and the highest ``k`` of a block size that cuts there."""
    for at in range(0, len(data), GROUP_BYTES):
        before = min(at, ROLLED - 1)
        block = np.zeros(ROLLED - 1 + min(GROUP_BYTES, len(data) - at), np.uint32)
        block[ROLLED - 1 - before :] = data[at - before : at + GROUP_BYTES]
        n = len(block) - ROLLED + 1
        total = np.zeros(n, np.uint32)
        mixed = np.zeros(n, np.uint32)
        for back in range(ROLLED):  # the sum, the sum weighted by nearness, and the shifted bytes
            seen = block[ROLLED - 1 - back : ROLLED - 1 - back + n]
            total += seen * np.uint32(1 + ROLLED - back)
            mixed ^= seen << np.uint32(5 * back)
        total += mixed + np.uint32(1)
        found = np.flatnonzero((total % np.uint32(SMALLEST) == 0) & (total != 0))
        values = total[found]
        lowest = values & (~values + np.uint32(1))
        yield found + at + 1, np.log2(lowest).astype(np.int8)


def _level(size: int, counts: np.ndarray) -> int:
    """The ``k`` to use for a text of ``size`` bytes with ``counts[k]`` cuts at level ``k`` or above."""
    k = 0
    while SMALLEST * LETTERS << k < size:
        k += 1
    while k and counts[min(k, LEVELS - 1)] < FEWER:
        k -= 1
    return k


def _counts(levels: np.ndarray) -> np.ndarray:
    return np.cumsum(np.bincount(levels, minlength=LEVELS)[::-1])[::-1]


def _chunks(places: np.ndarray, start: int, end: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks between the cuts; the last takes all that is left."""
    ends = places[: most - 1]
    if end > start and (not len(ends) or ends[-1] != end):
        ends = np.append(ends, end)
    return np.concatenate((np.full(min(1, len(ends)), start), ends[:-1])), ends


def _cuts_of_group(data: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each text its level, and its cuts at that level and at the next."""
    found = list(_triggers(data))
    places = np.concatenate([p for p, _ in found]) if found else np.zeros(0, np.int64)
    levels = np.concatenate([v for _, v in found]) if found else np.zeros(0, np.int8)
    bounds = zip(np.searchsorted(places, firsts, "right"), np.searchsorted(places, firsts + sizes, "right"), strict=True)
    for size, (a, b) in zip(sizes.tolist(), bounds, strict=True):
        here, high = places[a:b], levels[a:b]
        k = _level(size, _counts(high))
        yield k, here[high >= k], here[high > k]


def _cuts_of_long(data: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """The same for a text of several blocks; no more cuts are held than a signature takes."""
    k = _level(len(data), sum(_counts(levels) for _, levels in _triggers(data)))
    cuts = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for places, levels in _triggers(data):
        for i, most in enumerate((LETTERS, FEWER)):
            cuts[i] = np.concatenate((cuts[i], places[levels >= k + i][: most - len(cuts[i])]))
        if len(cuts[0]) == LETTERS and len(cuts[1]) == FEWER:
            break
    return k, *cuts


def _of_group(texts: list[bytes]) -> list[str]:
    """Fingerprints of texts of one block in all, or of one longer text."""
    gap = b"\0" * (ROLLED - 1)  # as before the first byte of a text
    data = np.frombuffer(gap.join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    firsts = np.concatenate(([0], np.cumsum(sizes[:-1] + len(gap))))
    cuts = [_cuts_of_long(data)] if len(texts) == 1 and len(data) > GROUP_BYTES else list(_cuts_of_group(data, firsts, sizes))
    parts = []
    for first, size, (_, once, twice) in zip(firsts.tolist(), sizes.tolist(), cuts, strict=True):
        parts += [_chunks(once, first, first + size, LETTERS), _chunks(twice, first, first + size, FEWER)]
    letters = _letters(data, np.concatenate([s for s, _ in parts]), np.concatenate([e for _, e in parts])).tobytes().decode()
    out, at = [], 0
    for (k, _, _), one, two in zip(cuts, parts[::2], parts[1::2], strict=True):
        middle, end = at + len(one[1]), at + len(one[1]) + len(two[1])
        out.append(f"{SMALLEST << k}:{letters[at:middle]}:{letters[middle:end]}")
        at = end
    return out


def fingerprints_of(texts: list[bytes]) -> list[str]:
    out: list[str] = []
    for a, b in groups(texts, GROUP_BYTES - (1 << 16)):
        out += _of_group(texts[a:b])
    return out


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add ``out``, the fingerprint of every whole text."""
    ship(df.sparkSession)
    made = F.arrow_udf(lambda column: pa.array(fingerprints_of(as_bytes(column)), pa.string()), "string")(F.col(text))
    name = free_name(df, "__fingerprint")
    frame = df.withColumn(name, made)
    if out.lower() in {c.lower() for c in df.columns}:
        frame = frame.drop(out)
    return frame.withColumnRenamed(name, out)


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are, from 0 to 1."""

    def part(x: Column, i: int) -> Column:
        return F.split_part(x, F.lit(":"), F.lit(i))

    def alike(*both: tuple[Column, Column]) -> Column:
        edits = sum((F.levenshtein(x, y) for x, y in both), F.lit(0))
        return 1 - edits / F.greatest(sum((F.greatest(F.length(x), F.length(y)) for x, y in both), F.lit(0)), F.lit(1))

    size_a, size_b = part(a, 1).cast("long"), part(b, 1).cast("long")
    return (
        F.when(a == b, 1.0)
        .when(size_a == size_b, alike((part(a, 2), part(b, 2)), (part(a, 3), part(b, 3))))
        .when(size_a == 2 * size_b, alike((part(a, 2), part(b, 3))))
        .when(size_b == 2 * size_a, alike((part(b, 2), part(a, 3))))
        .otherwise(0.0)
    )


def replaced_tail(text: str, other: str, share: int = 4) -> str:
    """The last ``len(text) // share`` code points replaced by as many from the start of ``other``, or all it has."""
    n = len(text) // share
    return text[: len(text) - n] + other[:n]


def _compared(ids: list, texts: list[str], nexts: list[str], share: int) -> list[list]:
    """``n_chars, edited_sha256, fingerprint, edited_fingerprint`` of texts and what follows them."""
    edited = [replaced_tail(t, o, share).encode() for t, o in zip(texts, nexts, strict=True)]
    return [[len(t) for t in texts], [hashlib.sha256(e).hexdigest() for e in edited], fingerprints_of([t.encode() for t in texts]), fingerprints_of(edited)]


def edited_pairs(df: DataFrame, share: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of the text with its end replaced by the start of the next document, and of that document.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint``, a row for each of ``df``.
    Documents follow each other by ascending id, NULL first; rows of one id by a hash of their text, then the text; the first
    document follows the last, and a single one follows itself.  Whole texts are shuffled once, into ranges of ids and hashes,
    and read in order as a stream.  What crosses from one range to the next is one text for each range, joined on its number.
    """
    ship(df.sparkSession)
    kind = df.schema[doc_id].dataType.simpleString()

    def streamed(batches):
        part, held, opened = TaskContext.get().partitionId(), None, False
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                ids, texts = some.column(0).to_pylist(), [t or "" for t in some.column(1).to_pylist()]
                if held is not None:
                    ids, texts = [held[0], *ids], [held[1], *texts]
                if not opened:
                    opened = True
                    yield _rows([None], [part], ["head"], [texts[0]], [[None]] * 4, [None], some.schema.field(0).type)
                held = ids[-1], texts[-1]
                prints = _compared(ids[:-1], texts[:-1], texts[1:], share)
                following = [*prints[2][1:], *fingerprints_of([texts[-1].encode()])] if len(ids) > 1 else []
                yield _rows(ids[:-1], [part] * (len(ids) - 1), ["row"] * (len(ids) - 1), [None] * (len(ids) - 1), prints, following, some.schema.field(0).type)
        if held is not None:
            yield _rows([held[0]], [part], ["tail"], [held[1]], [[None]] * 4, [None], some.schema.field(0).type)

    ordered = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    found = cut(
        df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .repartitionByRange(*ordered)
        .sortWithinPartitions(*ordered, F.col("text"))
        .mapInArrow(streamed, f"doc_id {kind}, part int, role string, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"),
        "edited",
    )
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"]
    heads = found.where(F.col("role") == "head").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    parts = found.where(F.col("role") == "head").select("part")  # a row for each range that is not empty
    order = Window.orderBy("part")
    first = F.min("part").over(Window.partitionBy())
    follows = parts.select("part", F.coalesce(F.lead("part").over(order), first).alias("next_part"))
    tails = found.where(F.col("role") == "tail").select("doc_id", "part", "text").join(follows, "part").join(heads, "next_part")

    def closed(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                ids, texts, nexts = (batch.column(i).slice(at, 1).to_pylist() for i in range(3))
                prints = _compared(ids, texts, nexts, share)
                yield _rows(ids, [0], ["row"], [None], prints, fingerprints_of([nexts[0].encode()]), batch.schema.field(0).type)

    last = tails.select("doc_id", "text", "next_text").mapInArrow(closed, found.schema)
    return found.where(F.col("role") == "row").select(*columns).unionByName(last.select(*columns))


def _rows(ids, parts, roles, texts, prints, following, kind: pa.DataType) -> pa.RecordBatch:
    columns = [pa.array(ids, kind), pa.array(parts, pa.int32()), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array(prints[0], pa.int64())]
    columns += [pa.array(x, pa.string()) for x in (*prints[1:], following)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "role", "text", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"])
