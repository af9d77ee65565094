"""Similarity join on word shingles by chosen paths.

A document is the set of its ``WORDS``-word shingles (words folded to lower case; a shorter
document is one shingle).  Documents with equal sets are one class, and only classes
are compared.  A class is embedded as ``SIZE`` minimum hashes, so that two classes agree on a
share of places near their Jaccard similarity.

Chosen paths: in each run a path is a sequence of places sampled at random, and the values
there; the sample depends on the path alone, each place that is not yet in it being taken with probability
``1 / (similarity * SIZE - length)``, so similar classes go the same ways (a place drawn twice would split nothing, and
its bucket count as dense).  Classes that share a path are a bucket.  A bucket of at most ``LIMIT`` classes is compared by brute force; a larger one is
split further along its paths.  One whose share of its parent shows that its members agree
nearly everywhere cannot be split by that: all its members become candidates of each
other.  ``runs`` follows from the recall wanted and the longest path met: where buckets had to be split
beyond ``LENGTH`` places, more runs follow until their number holds for the length really reached.

Candidates (buckets' pairs whose embeddings agree on ``LEAST_AGREED`` of their places) are
joined to clusters, and within a cluster every pair is compared exactly, on the whole
sets, in blocks of about ``BLOCK`` classes and ``BLOCK_SHINGLES`` shingles: a pair lies in one cluster and one pair of blocks, so it
counts once.  A cluster of several blocks is cut into bands by the size of the sets; linked sets lie in one band or in
two neighbours, so no others meet.  Blocks return each class's links and a spanning forest, never all pairs.

Defined cases: NULL and empty texts have no shingles, no links, and are groups of their
own; repeated rows are copies; texts are read whole; an empty table gives an empty
result.  Rows without an id have a group without one unless it holds a row with an id.  Of equal
sets the smallest id names the class; other columns, whatever their names, are not read or returned.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructField, StructType

from sitecorpus.checkpoints import cut_passing as cut
from sitecorpus.checkpoints import drop
from sitecorpus.llm.common import PLAIN, as_bytes, drop_kept, groups, mix, release, releasing, ship
from sitecorpus.llm.components import components
from sitecorpus.llm.decontaminate import grams

#: Words of a shingle; the similarity from which classes are linked, as a fraction.
WORDS = 5
SIMILAR = (4, 5)
#: Places of the embedding; the share of them on which candidates agree at least.
SIZE = 64
LEAST_AGREED = 0.62
#: Classes of a bucket that is compared by brute force, and of a block in exact comparison.
LIMIT = 200
BLOCK = 256
#: Shingles of all classes of a block, so that its memory does not follow the length of texts (one longer text is a block).
BLOCK_SHINGLES = 1 << 20
#: Sizes of the sets in one band; more than 5 / 4, so that linked sets are at most one band apart.
BAND = 1.26
#: Shingles sent to pairs of blocks in one round of comparison, unless twice those of all sets are more: a set goes to every block of its cluster.
ROUND_SHINGLES = 1 << 26
#: Bytes of a pair of blocks after which a worker gives memory back.
LARGE = 1 << 22
#: Share of its parent from which a bucket counts as dense, and the longest path.
DENSE = 0.64
DEEPEST = 12
#: Bits of the largest filter of members.
MOST_BITS = 1 << 29
#: The recall wanted at the least similarity, and the length of paths that the first runs are made for.
RECALL = 0.99
LENGTH = 4

SIGNATURE = StructType([StructField("digest", BinaryType()), StructField("n", LongType()), StructField("places", BinaryType())])


def runs(recall: float = RECALL, length: int = LENGTH) -> int:
    """Runs after which a pair at the least similarity has met with this probability, paths being ``length`` places long."""
    met = 1.0
    for _ in range(length):
        met = 1 - math.exp(-met)
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


def shingles(texts: list[bytes], words: int = WORDS):
    """For each text its distinct shingles, sorted."""
    for a, b in groups(texts):
        _, of, _, _, hashes = PLAIN.of_texts(texts[a:b])
        counts = np.bincount(of, minlength=b - a)
        ends = np.cumsum(counts)
        made = grams(hashes, of, words)
        for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
            if n >= words:
                yield np.unique(made[end - n : end - words + 1])
            elif n:
                yield grams(hashes[end - n : end], np.zeros(n, np.int64), n)
            else:
                yield np.empty(0, np.uint64)


_FACTORS = mix(np.arange(1, SIZE + 1, dtype=np.uint64)) | np.uint64(1)
_BITS = np.uint64(1) << np.arange(SIZE, dtype=np.uint64)


def embedded(sets: list[np.ndarray]) -> np.ndarray:
    """The ``SIZE`` minimum hashes of every set, as 32 bits of the spread minimum; sets are not empty.

    Minima are small, so their own upper bits would often be equal by chance, and buckets of unlike classes grow with the square of the input.
    """
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), SIZE), np.uint32)
    for i, factor in enumerate(_FACTORS):
        out[:, i] = mix(np.minimum.reduceat((flat ^ (factor >> np.uint64(7))) * factor, starts)) >> np.uint64(32)
    return out


def digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, digest, n, places`` of every row; the last three are NULL without shingles."""
    ship(docs.sparkSession)

    def signed(column: pa.Array) -> pa.Array:
        drop_kept()
        digests, sizes, places = [], [], []
        held, size = [], 0

        def flush():
            full = [s for s in held if len(s)]
            rows = iter(embedded(full)) if full else iter(())
            places.extend(next(rows).tobytes() if len(s) else None for s in held)
            held.clear()

        for found in shingles(as_bytes(column)):
            digests.append(digest(found))
            sizes.append(len(found) or None)
            held.append(found)
            size += len(found)
            if size > 1 << 18:
                flush()
                size = 0
        flush()
        kinds = [pa.binary(), pa.int64(), pa.binary()]
        arrays = [pa.array(x, k) for x, k in zip((digests, sizes, places), kinds, strict=True)]
        return pa.StructArray.from_arrays(arrays, names=["digest", "n", "places"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.arrow_udf(releasing(signed), SIGNATURE)(F.col(text)).alias("s")).select("doc_id", "s.*")


def children(parents: np.ndarray, places: np.ndarray, similarity: float, used: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The paths by which every row's parent path goes on, and the places in each; ``used`` are those in the parent, as bits."""
    taken = (used[:, None] >> np.arange(SIZE, dtype=np.uint64)) & np.uint64(1)
    left = similarity * SIZE - taken.sum(axis=1)
    chance = np.ldexp(1 / np.maximum(left, 2), 64).astype(np.uint64)
    steps = mix(parents[:, None] + _FACTORS[None, :])
    went = mix(steps ^ mix(places.astype(np.uint64) + np.uint64(7)))
    drawn = (steps < chance[:, None]) & (taken == 0)
    return [(w[c], u | _BITS[c]) for w, c, u in zip(went, drawn, used, strict=True)]


def _places(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(as_bytes(column)), np.uint32).reshape(-1, SIZE)


#: A path goes with the places in it, so that none is drawn twice.
PATHS = ArrayType(StructType([StructField("path", LongType()), StructField("used", LongType())]))


def _as_paths(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    ends = np.cumsum([0] + [len(path) for path, _ in found]).astype(np.int32)
    path, used = (np.concatenate([f[k] for f in found] + [np.empty(0, np.uint64)]).view(np.int64) for k in (0, 1))
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(path), pa.array(used)], names=["path", "used"]))


def _first_paths(similarity: float, numbers: range):
    def paths(column: pa.Array) -> pa.Array:
        places = _places(column)
        found = [children(np.full(len(places), mix(np.array([r + 1], np.uint64))[0]), places, similarity, np.zeros(len(places), np.uint64)) for r in numbers]
        return _as_paths([tuple(np.concatenate(x) for x in zip(*of, strict=True)) for of in zip(*found, strict=True)])

    return F.arrow_udf(releasing(paths), PATHS)


def _next_paths(similarity: float):
    def paths(column: pa.Array, parents: pa.Array, used: pa.Array) -> pa.Array:
        parents, used = (x.to_numpy(zero_copy_only=False).view(np.uint64) for x in (parents, used))
        return _as_paths(children(parents, _places(column), similarity, used))

    return F.arrow_udf(releasing(paths), PATHS)


class Forest:
    """Joined sets of numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, rows: np.ndarray, columns: np.ndarray) -> None:
        for i, j in zip(rows.tolist(), columns.tolist(), strict=True):
            a, b = self.root(i), self.root(j)
            if a != b:
                self.up[max(a, b)] = min(a, b)


def _forest(linked: np.ndarray) -> Forest:
    """Components of a symmetric matrix, row by row."""
    forest = Forest(len(linked))
    for i in range(len(linked)):
        near = np.flatnonzero(linked[i, i + 1 :]) + i + 1
        roots = {forest.root(i)} | {forest.root(j) for j in near.tolist()}
        least = min(roots)
        for r in roots:
            forest.up[r] = least
    return forest


def _bucket_edges(batches):
    for batch in batches:
        a, b = [], []
        for row in range(batch.num_rows):  # one bucket at a time, as a batch may hold many large ones
            digests, places = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
            matrix = np.frombuffer(b"".join(places), np.uint32).reshape(-1, SIZE)
            agreed = np.zeros((len(matrix), len(matrix)), np.int16)
            for column in matrix.T:
                agreed += column[:, None] == column[None, :]
            forest = _forest(agreed >= LEAST_AGREED * SIZE)
            for i in range(len(digests)):
                if (r := forest.root(i)) != i:
                    a.append(digests[i])
                    b.append(digests[r])
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})
        del batch
        release()


def _met(classes: DataFrame, n_classes: int, similarity: float, numbers: range) -> tuple[list[DataFrame], int]:
    """Edges from the runs of these numbers, and the length of the longest path that was followed."""
    first = _first_paths(similarity, numbers)
    paths = classes.select("digest", F.explode(first("places")).alias("at")).select("digest", "at.*", F.lit(n_classes).alias("parent_size"))
    found, vectors = [], classes.select("digest", "places")
    for depth in range(1, DEEPEST + 1):
        paths, old = cut(paths, "paths"), None if depth == 1 else rows
        if old is not None:
            drop(old)
        sizes = paths.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        rows = cut(paths.join(sizes, "path"), "buckets")
        drop(paths)
        small = rows.where(F.col("size") <= LIMIT).join(vectors, "digest")
        found.append(cut(small.groupBy("path").agg(F.collect_list("digest"), F.collect_list("places")).drop("path").mapInArrow(_bucket_edges, "a binary, b binary").distinct(), "edges"))
        dense = (F.col("size") >= DENSE * F.col("parent_size")) | F.lit(depth == DEEPEST)
        large = rows.where((F.col("size") > LIMIT) & dense)
        least = large.groupBy("path").agg(F.min("digest").alias("b"))
        found.append(cut(large.join(least, "path").select(F.col("digest").alias("a"), "b").where("a != b").distinct(), "edges"))
        rest = rows.where((F.col("size") > LIMIT) & ~dense)
        if rest.isEmpty():
            break
        going = rest.join(vectors, "digest")
        paths = going.select("digest", F.explode(_next_paths(similarity)("places", "path", "used")).alias("at"), "size").select("digest", "at.*", F.col("size").alias("parent_size"))
    drop(rows)
    return found, depth


def candidates(classes: DataFrame, similarity: float = SIMILAR[0] / SIMILAR[1], recall: float = RECALL) -> DataFrame:
    """``a, b``: edges that join candidates to clusters; ``classes`` has ``digest`` and ``places``."""
    n_classes, found, done, wanted = classes.count(), [], 0, runs(recall)
    while done < wanted:
        more, depth = _met(classes, n_classes, similarity, range(done, wanted))
        found += more
        done, wanted = wanted, max(wanted, runs(recall, depth))
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values every set on the left shares with every set on the right."""
    flat = np.concatenate(left + right)
    values, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    wide = int((counts > 1).sum())
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    keep = counts[inverse] > 1
    owner, column = owner[keep], column[inverse[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    step = 4096
    bounds = np.searchsorted(column, np.arange(0, wide + step, step))
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        matrix = np.zeros((len(left) + len(right), step), np.float32)
        matrix[owner[a:b], column[a:b] - k * step] = 1
        out += matrix[: len(left)] @ matrix[len(left) :].T
    return out.astype(np.int64)


def _views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The 64-bit values of each binary value, where they lie."""
    out = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        kind = np.int64 if pa.types.is_large_binary(chunk.type) else np.int32
        ends = np.frombuffer(offsets, kind)[chunk.offset : chunk.offset + len(chunk) + 1].tolist()
        values = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        out += [values[a:b].view(np.uint64) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return out


def _compared(table: pa.Table) -> pa.Table:
    """Links and a spanning forest of one pair of blocks; after a large one free memory is given back."""
    found = _links(table)
    if table.nbytes > LARGE:
        release()
    return found


def _links(table: pa.Table) -> pa.Table:
    side = table.column("side").to_numpy()
    digests = table.column("digest").to_pylist()
    copies = table.column("copies").to_numpy()
    sets = _views(table.column("shingles"))
    sizes = np.array([len(s) for s in sets])
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = len(second) == 0 and bool(table.column("same")[0].as_py())
    if alone:
        second = first
    links, forest = np.zeros(len(sets), np.int64), Forest(len(sets))
    if len(first) and len(second):
        both = shared([sets[i] for i in first], [sets[i] for i in second])
        union = sizes[first][:, None] + sizes[second][None, :] - both
        linked = both * SIMILAR[1] >= union * SIMILAR[0]
        if alone:
            np.fill_diagonal(linked, False)
            links[first] = linked @ copies[first]
        else:
            links[first] = linked @ copies[second]
            links[second] = linked.T @ copies[first]
        for i in range(len(first)):
            near = second[linked[i]]
            roots = {forest.root(int(first[i]))} | {forest.root(j) for j in near.tolist()}
            least = min(roots)
            for r in roots:
                forest.up[r] = least
    roots = [digests[forest.root(i)] for i in range(len(digests))]
    return pa.table({"digest": pa.array(digests, pa.binary()), "root": pa.array(roots, pa.binary()), "links": pa.array(links, pa.int64())})


def _sets(words: int):
    def sets(column: pa.Array) -> pa.Array:
        found = list(shingles(as_bytes(column), words))
        digests = pa.array([digest(s) for s in found], pa.binary())
        ends = np.cumsum([0] + [s.nbytes for s in found])
        values = np.concatenate(found) if found else np.empty(0, np.uint64)
        del found
        sets = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(values)]).cast(pa.binary())
        return pa.StructArray.from_arrays([digests, sets], names=["digest", "shingles"])

    # Not deterministic for the planner only, which would else move it below the join and make the sets of all documents.
    return F.arrow_udf(releasing(sets), StructType([StructField("digest", BinaryType()), StructField("shingles", BinaryType())])).asNondeterministic()


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """The four bits of each hash in a Bloom filter of ``size`` bits."""
    return np.concatenate([mix(hashes + np.uint64(k)) % np.uint64(size) for k in range(1, 5)])


def maybe_members(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The documents but for most that are no members, by a Bloom filter of their ids, so that few texts are shuffled."""
    size = min(MOST_BITS, 1 << max(16, math.ceil(math.log2(16 * max(1, members.count())))))

    def bits(batches):
        table = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = _bits(batch.column(0).to_numpy().view(np.uint64), size)
            np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7)).astype(np.int64)).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"bits": pa.array([zlib.compress(table.tobytes(), 1)], pa.binary())})

    def either(a: bytes, b: bytes) -> bytes:
        if not a or not b:
            return a or b
        both = np.frombuffer(zlib.decompress(a), np.uint8) | np.frombuffer(zlib.decompress(b), np.uint8)
        return zlib.compress(both.tobytes(), 1)

    rows = members.select(F.xxhash64("doc_id")).coalesce(64).mapInArrow(bits, "bits binary").rdd.map(lambda r: bytes(r[0]))
    made = rows.treeAggregate(b"", either, either, depth=2)
    shared = docs.sparkSession.sparkContext.broadcast(made)
    unpacked: list[np.ndarray] = []  # filled in the worker, once for all batches of a task

    def held(column: pa.Array) -> pa.Array:
        if not shared.value:
            return pa.array(np.zeros(len(column), bool))
        if not unpacked:
            unpacked.append(np.frombuffer(zlib.decompress(shared.value), np.uint8))
        table = unpacked[0]
        at = _bits(column.to_numpy(zero_copy_only=False).view(np.uint64), size)
        found = (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
        return pa.array(found.reshape(4, -1).all(axis=0))

    return docs.where(F.arrow_udf(held, BooleanType())(F.xxhash64("doc_id")))


def compared(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``digest, root, links`` from all pairs of blocks of all clusters, written in rounds; ``members`` has ``digest, doc_id, n, copies, cluster``."""
    def blocks(rows: DataFrame, *keys: str) -> DataFrame:
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n_shingles"))
        return sizes.select(*keys, F.greatest(F.ceil(F.col("size") / BLOCK), F.least("size", F.ceil(F.col("n_shingles") / BLOCK_SHINGLES))).cast("int").alias("blocks"))

    band = F.when(F.col("blocks") > 1, F.floor(F.log(F.col("n")) / math.log(BAND)).cast("int")).otherwise(0)
    banded = members.join(blocks(members, "cluster"), "cluster").select("digest", F.col("doc_id").alias("rep"), "n", "copies", "cluster", band.alias("band"))
    sizes = cut(blocks(banded, "cluster", "band"), "sizes")
    placed = banded.join(sizes, ["cluster", "band"])
    for side, step in (("below", 1), ("above", -1)):
        placed = placed.join(sizes.select("cluster", (F.col("band") + step).alias("band"), F.col("blocks").alias(side)), ["cluster", "band"], "left")
    placed = placed.fillna(0, ["below", "above"])
    once, sent = placed.agg(F.sum("n"), F.sum(F.col("n") * (F.col("blocks") + F.col("below") + F.col("above")))).first()
    rounds = max(1, -(-(sent or 0) // max(ROUND_SHINGLES, 2 * (once or 0))))
    texts = maybe_members(docs, members).join(placed.drop("n"), docs["doc_id"].eqNullSafe(placed["rep"]))
    kept = ("copies", "cluster", "band", "blocks", "below", "above")
    made = cut(texts.withColumn("made", _sets(WORDS)("text")).where("made.digest = digest").select("digest", *kept, F.col("made.shingles").alias("shingles")).dropDuplicates(["digest"]), "sets")

    def others(n: str, step: int):
        return F.transform(F.slice(F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1), F.lit(1), F.col(n)), lambda x: F.struct(F.lit(step).alias("step"), x.alias("block")))

    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    pairs = made.withColumn("block", block).withColumn("other", F.explode(F.concat(others("blocks", 0), others("below", -1), others("above", 1))))
    step, other = F.col("other.step"), F.col("other.block")
    first = F.when(step == 0, F.col("block") <= other).otherwise(step > 0)
    rows = pairs.select(
        "cluster",
        F.least(F.col("band"), F.col("band") + step).alias("low"),
        F.greatest(F.col("band"), F.col("band") + step).alias("high"),
        F.when(first, F.col("block")).otherwise(other).alias("i"),
        F.when(first, other).otherwise(F.col("block")).alias("j"),
        F.when(first, 0).otherwise(1).alias("side"),
        ((step == 0) & (F.col("block") == other)).alias("same"),
        "digest",
        "copies",
        "shingles",
    )
    found = None
    for r in range(rounds):
        some = rows.where((F.col("i") + F.col("j")) % rounds == r).groupBy("cluster", "low", "high", "i", "j").applyInArrow(_compared, "digest binary, root binary, links long")
        done = cut(some, "compared")
        found = found.unionByName(done) if found is not None else done
    drop(made, sizes)
    return found


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", recall: float = RECALL) -> DataFrame:
    """``doc_id, group_id, n_links`` of every row: the smallest id among the documents it is linked to, directly or through others, and its number of links."""
    ship(docs.sparkSession)
    rows = cut(signatures(docs, doc_id, text), "signatures")
    classes = cut(
        rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("places").alias("places")), "classes"
    )
    clusters = components(candidates(classes, recall=recall))
    placed = clusters.select(F.col("node").alias("digest"), F.col("root").alias("cluster")).unionByName(clusters.select(F.col("root").alias("digest"), F.col("root").alias("cluster")).distinct())
    members = cut(classes.select("digest", "doc_id", "n", "copies").join(placed, "digest"), "members")
    found = compared(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), members)
    drop(members)
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    near = classes.select("digest", "doc_id", "copies").join(linked.select(F.col("node").alias("digest"), "root"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = near.groupBy("root").agg(F.min("doc_id").alias("group_id"))
    known = near.join(least, "root").join(links, "digest", "left").select("digest", "group_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return rows.select("doc_id", "digest").join(known, "digest", "left").select(
        "doc_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
