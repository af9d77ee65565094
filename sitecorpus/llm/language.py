"""Language of texts by segmentation-marginalised unigrams.

A fixed public vocabulary cuts words into pieces.  Each language has a probability for
every piece, and the probability of a word is the sum over all ways of cutting it, by
the forward algorithm; no single best cut is chosen.  The piece probabilities are
fitted by expectation and maximisation (the backward pass gives each piece's share in
all cuts).  A text's score is the sum over its words; the prediction is the language that
makes the text likeliest, and ``score`` its share under equal priors.

The fit takes about ``SAMPLE`` labelled documents of each language (all if there are
fewer), chosen by hash of id and text.  Words count from white space to white space, at any
length: those of over ``SHORT`` characters are summed in a window of the longest piece whose
values are scaled as it moves on, so nothing underflows.  In the fit alone, words are cut
every ``LONGEST`` characters.  Characters outside the vocabulary have a fixed small probability.

Defined cases: a NULL text or one without a letter is ``und`` with score 0; without
labelled documents every text is; documents whose language is NULL are not learnt from;
equal scores go to the language first in order; texts are scored whole; repeated rows are
each scored; rows without an id are learnt from in the same share as others (rows equal in id and text
together or not at all); an empty table gives an empty table; the output column replaces one of its name.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sitecorpus.llm.common import as_bytes, groups, mix, ship

SAMPLE = 600
ROUNDS = 3
LONGEST = 40
#: Characters up to which a product of probabilities needs no scaling; steps between two scalings; characters of long words handled at once.
SHORT = 30
SCALED = 8
AT_ONCE = 1 << 16
UNKNOWN = 1e-7
SMOOTHING = 0.02
#: Words that a worker's table holds.
CACHED = 400_000
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
SPACE_MARK = "▁"  # the vocabulary's sign for the start of a word

RESULT = StructType([StructField("lang_pred", StringType(), False), StructField("score", DoubleType(), False)])


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model, without its control, unknown and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Pieces:
    """Finds pieces in words of equal length, many words at a time."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        by_length = defaultdict(list)
        for i, piece in enumerate(pieces):
            by_length[len(piece)].append((i, piece))
        self.tables = {}
        for length, some in by_length.items():
            keys = self._keys(codes([p for _, p in some], length))
            order = np.argsort(keys)
            self.tables[length] = keys[order], np.array([i for i, _ in some])[order]

    @staticmethod
    def _keys(matrix: np.ndarray) -> np.ndarray:
        out = np.zeros(len(matrix), np.uint64)
        for column in matrix.T:
            out = mix(out + column + np.uint64(1))
        return out

    def found(self, matrix: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """Start, end and piece of each word (``size`` for an unknown character, ``size + 1`` for none)."""
        out = []
        length = matrix.shape[1]
        for i in range(length):
            keys = np.zeros(len(matrix), np.uint64)
            for j in range(i + 1, min(length, i + self.longest) + 1):
                keys = mix(keys + matrix[:, j - 1] + np.uint64(1))
                if j - i not in self.tables:
                    continue
                ids, hit = self._looked_up(keys, j - i)
                if j == i + 1 or hit.any():
                    out.append((i, j, ids))
        return out

    def _looked_up(self, keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The piece of each key among those of this length, and whether there is one."""
        known, ids = self.tables[length]
        at = np.searchsorted(known, keys)
        at[at == len(known)] = 0
        hit = known[at] == keys
        return np.where(hit, ids[at], self.size + (length > 1)), hit

    def starting(self, matrix: np.ndarray, count: int) -> list[list[tuple[int, np.ndarray]]]:
        """For each of the first ``count`` places the lengths of pieces that start there in any word, with the piece of each word."""
        out: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(count)]
        keys = np.zeros((len(matrix), count), np.uint64)
        for length in range(1, min(self.longest, matrix.shape[1]) + 1):
            wide = min(count, matrix.shape[1] - length + 1)
            keys = mix(keys[:, :wide] + matrix[:, length - 1 : length - 1 + wide] + np.uint64(1))
            if length not in self.tables:
                if length == 1:
                    for place in range(wide):
                        out[place].append((1, np.full(len(matrix), self.size)))
                continue
            ids, hit = self._looked_up(keys, length)
            for place in range(wide) if length == 1 else np.flatnonzero(hit.any(axis=0)).tolist():
                out[place].append((length, ids[:, place]))
        return out


def codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length).astype(np.uint64)


def by_length(words: list[str]) -> dict[int, list[int]]:
    out = defaultdict(list)
    for i, w in enumerate(words):
        out[len(w)].append(i)
    return out


def marked(word: str) -> list[str]:
    """The word with the sign of its start, cut after every ``LONGEST`` characters for the fit."""
    word = SPACE_MARK + word
    return [word[i : i + LONGEST] for i in range(0, len(word), LONGEST)]


class Model:
    """Piece probabilities of each language: one row for each piece, then unknown characters, then none."""

    def __init__(self, pieces: list[str], langs: list[str], table: np.ndarray):
        self.pieces, self.langs, self.table = Pieces(pieces), langs, table
        self.rows: dict[bytes, int] = {}
        self.logs = np.zeros((0, len(langs)))

    def word_logs(self, words: list[str]) -> np.ndarray:
        """The log probability of every word in every language."""
        words = [SPACE_MARK + w for w in words]
        out = np.zeros((len(words), len(self.langs)))
        long = []
        for length, where in by_length(words).items():
            if length > SHORT:
                long += where
                continue
            for k in range(0, len(where), 4096):
                some = where[k : k + 4096]
                ways = [None] * (length + 1)
                ways[0] = np.ones((len(some), len(self.langs)))
                for i, j, ids in self.pieces.found(codes([words[x] for x in some], length)):
                    more = ways[i] * self.table[ids]
                    ways[j] = more if ways[j] is None else ways[j] + more
                out[some] = np.log(ways[length])
        long.sort(key=lambda i: len(words[i]))
        start = 0
        for k in range(1, len(long) + 1):
            if k == len(long) or (k + 1 - start) * len(words[long[k]]) > AT_ONCE:
                some = long[start:k]
                out[some] = self._long_logs([words[i] for i in some])
                start = k
        return out

    def _long_logs(self, words: list[str]) -> np.ndarray:
        """The same for words of any length, all places from left to right at once; a shorter word is read off where it ends."""
        sizes = np.array([len(w) for w in words])
        most, ring = int(sizes.max()), self.pieces.longest + 1
        ways = np.zeros((ring, len(words), len(self.langs)))
        ways[0] = 1
        scale = np.zeros(ways.shape[1:])
        out = np.empty_like(scale)
        step = max(1, AT_ONCE // len(words))
        starting: list = []
        for place in range(most + 1):
            if place % step == 0 and place < most:
                some = [w[place : place + step + ring] for w in words]
                wide = max(map(len, some))
                matrix = np.frombuffer("".join(w.ljust(wide, "\0") for w in some).encode("utf-32-le"), np.uint32)
                starting = self.pieces.starting(matrix.reshape(len(words), wide).astype(np.uint64), min(step, most - place))
            if place % SCALED == 0:
                top = ways.max(axis=0)
                ways /= top
                scale += np.log(top)
            now = ways[place % ring].copy()
            ended = sizes == place
            if ended.any():
                out[ended] = np.log(now[ended]) + scale[ended]
            ways[place % ring] = 0
            if place < most:
                for length, ids in starting[place % step]:
                    ways[(place + length) % ring] += now * self.table[ids]
        return out

    def text_logs(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.langs)))
        for a, b in groups(texts):
            if len(self.rows) > CACHED:
                self.rows, self.logs = {}, np.zeros((0, len(self.langs)))
            words = [t.split() for t in texts[a:b]]
            flat = [w for found in words for w in found]
            rows = self.rows
            new = list(dict.fromkeys(w for w in flat if w not in rows))
            if new:
                logs = self.word_logs([w.decode() for w in new])
                if len(rows) + len(new) > len(self.logs):
                    bigger = np.zeros((max(2 * len(self.logs), len(rows) + len(new)), len(self.langs)))
                    bigger[: len(rows)] = self.logs[: len(rows)]
                    self.logs = bigger
                self.logs[len(rows) : len(rows) + len(new)] = logs
                rows.update(zip(new, range(len(rows), len(rows) + len(new)), strict=True))
            at = np.fromiter(map(rows.__getitem__, flat), np.int64, len(flat))
            ends = np.cumsum([0] + [len(w) for w in words])
            sums = np.zeros((len(flat) + 1, len(self.langs)))
            np.cumsum(self.logs[at], axis=0, out=sums[1:])
            out[a:b] = sums[ends[1:]] - sums[ends[:-1]]
        return out

    def predicted(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        logs = self.text_logs(texts)
        best = logs.argmax(axis=1)
        shares = 1 / np.exp(np.clip(logs - logs.max(axis=1, keepdims=True), -700, 0)).sum(axis=1)
        lettered = [LETTER.search(t.decode()) is not None for t in texts]
        return [self.langs[i] if ok else UNDETERMINED for i, ok in zip(best.tolist(), lettered, strict=True)], [s if ok else 0.0 for s, ok in zip(shares.tolist(), lettered, strict=True)]


def fit(pieces: list[str], words: list[tuple[str, str, int]], rounds: int = ROUNDS) -> Model:
    """Piece probabilities from ``(lang, word, count)`` by expectation and maximisation."""
    langs = sorted({lang for lang, _, _ in words})
    number = {lang: i for i, lang in enumerate(langs)}
    parts, lang_of, weight = [], [], []
    for lang, word, count in words:
        for part in marked(word):
            parts.append(part)
            lang_of.append(number[lang])
            weight.append(count)
    lang_of, weight = np.array(lang_of, np.int64), np.array(weight, np.float64)
    finder, width = Pieces(pieces), len(pieces) + 2
    cuts = []
    for length, where in by_length(parts).items():
        for k in range(0, len(where), 4096):
            some = np.array(where[k : k + 4096])
            cuts.append((length, some, [(i, j, ids.astype(np.int32)) for i, j, ids in finder.found(codes([parts[x] for x in some], length))]))
    table = np.full((max(1, len(langs)), width), 1 / max(1, len(pieces)))
    for _ in range(rounds):
        table[:, -2], table[:, -1] = UNKNOWN, 0
        shares = np.zeros(table.size)
        for length, some, found in cuts:
            rows = lang_of[some] * width
            flat = table.ravel()
            chances = [flat[rows + ids] for _, _, ids in found]
            forward = np.zeros((length + 1, len(some)))
            forward[0] = 1
            for (i, j, _), chance in zip(found, chances, strict=True):
                forward[j] += forward[i] * chance
            backward = np.zeros((length + 1, len(some)))
            backward[length] = weight[some] / np.maximum(forward[length], 1e-300)
            for (i, j, ids), chance in zip(reversed(found), reversed(chances), strict=True):
                share = chance * backward[j]
                backward[i] += share
                shares += np.bincount(rows + ids, forward[i] * share, len(shares))
        shares = shares.reshape(table.shape)
        table = shares + SMOOTHING
        table[:, :-2] /= table[:, :-2].sum(axis=1, keepdims=True)
    table[:, -2], table[:, -1] = UNKNOWN, 0
    return Model(pieces, langs, np.ascontiguousarray(table[: len(langs)].T))


def train(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from about ``sample`` of the documents of each language."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return fit(vocabulary(path), [])
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, sample / n))), F.col("lang"))
    words = (
        rows.where(place < share)
        .select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word"))
        .groupBy("lang", "word")
        .count()
        .toArrow()
        .to_pydict()
    )
    return fit(vocabulary(path), sorted(zip(words["lang"], words["word"], words["count"], strict=True)))


_MODELS: dict[int, Model] = {}


def predict(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """Add ``out``: ``lang_pred`` and ``score``."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    key = shared._jbroadcast.id()

    def languages(column: pa.Array) -> pa.Array:
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = shared.value
        langs, scores = _MODELS[key].predicted(as_bytes(column))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], fields=[pa.field("lang_pred", pa.string(), False), pa.field("score", pa.float64(), False)])

    return docs.withColumn(out, F.arrow_udf(languages, RESULT)(F.col(text)))
