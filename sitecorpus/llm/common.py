"""What several operators share: columns, shipping of code, hashing of words in numpy."""

from __future__ import annotations

import ctypes
import functools
import io
import os
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import sitecorpus

#: Bytes of text that numpy code handles at once.
GROUP_BYTES = 1 << 20

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(sitecorpus.__file__))
    archive = os.path.join(tempfile.mkdtemp(), "sitecorpus.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def whole_text(name: str = "text") -> Column:
    """The text; NULL counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each value; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def release() -> None:
    """Give free memory back to the system: a worker lives on from stage to stage and would keep the most that any of them took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def releasing(made):
    """The function of Arrow columns, after each batch of which free memory is given back."""

    @functools.wraps(made)
    def called(*columns):
        out = made(*columns)
        release()
        return out

    return called


#: What a worker keeps from task to task: the tables of one operator.
_KEPT: dict = {}


def kept(key, make):
    """What ``make()`` gave for ``key`` in this worker, without which what was kept for another key goes first."""
    if key not in _KEPT:
        drop_kept()
        _KEPT[key] = make()
    return _KEPT[key]


def drop_kept() -> None:
    """Leave what other operators kept in this worker."""
    if _KEPT:
        _KEPT.clear()
        release()


def groups(texts: list[bytes], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` that hold about ``limit`` bytes each; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


#: Primes and multipliers of the two polynomials that make a span's hash.
_FIELDS = [((1 << 31) - 1, 0x4F1BBCDC), ((1 << 31) - 19, 0x2545F491)]
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _series(base: int, prime: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo ``prime``."""
    out = np.ones(n, np.uint32)
    done = 1
    while done < n:
        more = out[: min(done, n - done)].astype(np.uint64) * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        out[done : done + len(more)] = more
        done += len(more)
    return out


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each field the powers of its multiplier and of the inverse."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, GROUP_BYTES + 1024)
        _POWERS[:] = [(_series(base, prime, size), _series(pow(base, -1, prime), prime, size)) for prime, base in _FIELDS]
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 62-bit hash of each span of ``values`` (64-bit, already spread), its bits spread; equal content gives equal hashes.

    Two polynomials modulo primes; modulo a power of two, regular words of two letters would collide for any multiplier.
    """
    out = np.zeros(len(starts), np.uint64)
    sums = np.zeros(len(values) + 1, np.uint64)
    for (prime, _), (up, down) in zip(_FIELDS, _powers(len(values) + 1), strict=True):
        p = np.uint64(prime)
        np.cumsum(values % p * up[: len(values)] % p, out=sums[1:])
        out = (out << np.uint64(31)) | ((sums[ends] - sums[starts]) % p * down[starts] % p)
    return mix(out)


class Alphabet:
    """Which bytes make words, and what each counts as."""

    def __init__(self, separators: set[int]):
        """``separators`` and letters as they are, but A-Z as a-z."""
        codes = np.arange(256, dtype=np.uint8)
        codes[65:91] += 32
        self.fold = codes
        self.is_word = np.array([b not in separators for b in codes.tolist()])
        self.values = mix(codes.astype(np.uint64) + np.uint64(0x51ED))
        self.separators = bytes(sorted(b for b in range(256) if not self.is_word[b]))

    def _piece(self, data: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = self.is_word[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        return starts + at, ends + at, span_hashes(self.values[data], starts, ends)

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of every word, in order."""
        array = np.frombuffer(data, np.uint8)
        if len(array) <= GROUP_BYTES * 2:
            return self._piece(array, 0)
        parts, at = [], 0
        while at < len(array):
            end = min(len(array), at + GROUP_BYTES)
            if end < len(array):  # go on to the end of a word
                step = 4096
                while end < len(array):
                    gaps = np.flatnonzero(~self.is_word[array[end : end + step]])
                    if len(gaps):
                        end += int(gaps[0])
                        break
                    end = min(len(array), end + step)
                    step *= 2
            parts.append(self._piece(array[at:end], at))
            at = end
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    def of_texts(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The joined texts, and text number, start, end and hash of every word."""
        data = self.separators[-1:].join(texts) if self.separators[-1] < 128 else b"\0".join(texts)
        first = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        starts, ends, hashes = self.words(data)
        return data, np.searchsorted(first, starts, "right") - 1, starts, ends, hashes


#: Words of digits, letters and whatever lies beyond ASCII.
PLAIN = Alphabet({b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)})
#: Words between white space.
SPACED = Alphabet({0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D})


def _byte_alphabet() -> dict[int, int]:
    """The character by which byte-level vocabularies write each byte: itself if visible, else the next free one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


_BYTE_ALPHABET = _byte_alphabet()


def byte_letters(text: str) -> str:
    """The text's UTF-8 bytes in the alphabet of byte-level vocabularies."""
    return text.encode().decode("latin-1").translate(_BYTE_ALPHABET)


class Cache(dict):
    """What ``make(key)`` gives, kept for keys asked for lately: two generations of ``limit`` entries."""

    def __init__(self, make, limit: int, longest: int = 64):
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays as bytes, for a broadcast of known size."""
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as arrays:
        return {k: arrays[k] for k in arrays.files}
