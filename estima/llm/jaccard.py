"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

Two sets of shingles with Jaccard similarity >= g and sizes a <= b differ in at most (1 - g) / (1 + g) * (a + b)
shingles. Sizes are cut into bands, so that within a band this is at most a number K. The domain of shingles is dealt by a
hash into partitions on two levels. K differences leave one of n1 first-level partitions with at most k2 of them if n1 * (k2 + 1) > K; it
is dealt into n2 second-level ones, of which at most k2 then differ, so two similar sets agree on one of the subsets of n2 - k2. A signature
is a band, a first-level partition, such a subset and a digest of the set's shingles in it; all subsets are enumerated:

- K = 0: the whole set; K = 1: n1 = 1, each shingle its own partition, so the whole set and the set without each one;
- K = 2, 3: n1 = 1, 5 or 6 partitions, all subsets of 3;
- above: k2 = 1, n2 = 3, the three subsets of 2 in each of K / 2 + 1 partitions and some spare. Spare partitions allow to leave out
  signatures of too few shingles to tell anything: while more than K / 2 partitions have none such, one of them is agreed on. Else the set
  emits all.

A set meets larger ones of the next band under that band's K, if its size allows a link there.

Equal sets are one node. Signatures travel once, 13 bytes each (half of the signature's hash, the other half tells where it goes, the
node, and how many signatures a link of it shares at least), in blobs. Nodes with a signature in common are compared exactly: in a small bucket all pairs that share enough signatures; in a larger
one each member with the bucket's pivot, the member that shares most. Then, in those large buckets that still hold members of different
components, the pairs of different components: in buckets of some thousands those that sketches don't rule out; in larger ones those whose differences to
the pivot have enough in common for a link. So no link is lost between
components, and no bucket is turned into all its pairs.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estima.llm.common import drop_stored, lean_worker, release, row_chunks, stored

BAND = 1.3  # ratio of a band's sizes
ROUNDS = 1  # of leaving out buckets of one component and nodes that share too little with others; more would leave out very little more
SMALL = 6  # most nodes of a bucket that are compared pair by pair at once
SPARE = 5  # quarters: partitions of the first level for each four that are needed
MEDIUM = 24  # most nodes of a bucket of which pairs of different components are compared by sketches; pairs in larger ones by differences to the pivot
MANY = 8192  # most members of a pivot that are compared by sketches, block by block, so that a member goes to 16 blocks at most
PAGE = 512  # members of half a block, about
MOST_BITS = 26  # of the bitmap that spares most sets that nothing asks for a shuffle: 2^26 bits, 8 MB as it is sent
PART = 1 << 15  # signatures, about, that are brought together at a time; so few that what a signature costs is the same at every size
TASK = 1 << 22  # signatures, about, of a task
HELD = 1 << 23  # most signatures that are held at a time, but for a part's that are in small buckets
BLOB = 128  # signatures of a blob: Spark sends 10,000 blobs at a time to Python
BROADCAST_ROWS = 100_000  # a table of two longs a row with at most so many rows is broadcast

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


PIECE = 1 << 20  # bytes of text that are hashed at a time
_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be divided by

_TABLES: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """A value for each byte (A-Z have those of a-z), which bytes are space, powers of the base and of its inverse."""
    if not _TABLES:
        value = mix(np.arange(1, 257, dtype=np.uint64) << np.uint64(32))
        value[65:91] = value[97:123]
        space = np.zeros(256, bool)
        space[[32, 9, 10, 11, 12, 13]] = True
        _TABLES.extend([value, space, np.ones(1, np.uint64), np.ones(1, np.uint64)])
    if len(_TABLES[2]) < n:
        for k, base in ((2, _BASE), (3, pow(_BASE, -1, 1 << 64))):
            _TABLES[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, np.uint64))])
    return _TABLES


def _pieces(data: bytes) -> Iterator[bytes]:
    """data cut at white space into pieces of about PIECE bytes; a longer word stays whole."""
    at = 0
    while len(data) - at > PIECE:
        cut = max(data.rfind(b" ", at, at + PIECE), data.rfind(b"\n", at, at + PIECE))
        if cut <= at:
            m = _SPACE.search(data, at + PIECE)
            cut = m.start() if m else len(data)
        yield data[at:cut]
        at = cut
    yield data[at:]


_SPACE = re.compile(rb"[ \t\n\v\f\r]")


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The words' 64-bit hashes and where they start. A word's hash is a polynomial in the base over its bytes' values,
    taken as a difference of running sums and moved to the word's start."""
    raw = np.frombuffer(data, np.uint8)
    value, space, power, inverse = _tables(len(raw) + 1)
    blank = space[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[raw] * power[: len(raw)])])
    return mix((run[ends] - run[starts]) * inverse[starts]), starts


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its runs of width words, A-Z taken as a-z; of a shorter text,
    the one of all its words."""
    out: list[np.ndarray] = []
    small: list[bytes] = []

    def flush() -> None:
        if small:
            words, starts = _words(b" ".join(small))
            first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in small])])
            bounds = np.searchsorted(starts, first)
            out.extend(_shingles(words, bounds, width))
            small.clear()

    held = 0
    for t in texts:
        t = t or b""
        if len(t) > PIECE:
            flush()
            words = np.concatenate([_words(x)[0] for x in _pieces(t)])
            out.extend(_shingles(words, np.array([0, len(words)]), width))
            held = 0
            continue
        if held + len(t) > PIECE:
            flush()
            held = 0
        small.append(t)
        held += len(t) + 1
    flush()
    return out


def _chain(words: np.ndarray, n: int) -> np.ndarray:
    h = np.full(max(0, len(words) - n + 1), n, np.uint64)
    for i in range(n):
        h = mix(h * np.uint64(_BASE) + words[i : len(words) - n + 1 + i])
    return h


def _shingles(words: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    whole = _chain(words, width)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out.append(np.unique(whole[a : b - width + 1]) if b - a >= width else _chain(words[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out


def shingles(text: str | None, width: int) -> np.ndarray:
    return shingle_sets([text.encode("utf-8", "surrogatepass") if text else None], width)[0]


def node_of(s: np.ndarray) -> int:
    """The set's 64-bit id, signed."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


@functools.cache
def band_edges(percent: int) -> list[int]:
    edges = [1]
    ratio = max(BAND, 100 / percent)
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, math.ceil(edges[-1] * ratio)))
    return edges


def band_of(size: int, percent: int) -> int:
    return int(np.searchsorted(band_edges(percent), size, side="right")) - 1


@functools.cache
def scheme(band: int, percent: int) -> tuple[int, int, int]:
    """K, number of partitions (of the first level, if K is 4 or more) and least shingles of a signature. Partitions beyond those that are needed
    raise the number of signatures that a link shares at least, which rules out more."""
    edges = band_edges(percent)
    top = edges[band + 1] - 1
    k = (100 - percent) * 2 * top // (100 + percent)
    if k < 2:
        return k, 0, 0
    if k < 4:
        return k, 3 + k, 1
    low = edges[band] * percent // 100  # the smallest set that meets others in this band
    for least in (3, 2, 1):
        for n in range(k // 2 + 1, (k // 2 + 1) * 13 // 10 + 3):
            mean = 2 * low / (3 * n)
            few = min(1.0, 3 * sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(least)))
            if 2 * (n * (1 - few) - 3 * math.sqrt(n * few * (1 - few))) > k:  # as good as all sets have more than K / 2 telling partitions
                return k, n * SPARE // 4, least
    return k, (k // 2 + 2 + k // 10) * SPARE // 4, 1


@functools.cache
def _subsets(n: int, size: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), size)))


def bands_of(size: int, percent: int) -> list[int]:
    """A set's own band and, if it can be linked there, the next."""
    band, edges = band_of(size, percent), band_edges(percent)
    return [band] + [band + 1] * (size * 100 // percent >= edges[band + 1])


def signature_count(size: int, percent: int) -> int:
    """Signatures of a set of that size at most."""
    total = 0
    for band in bands_of(size, percent):
        k, n, _ = scheme(band, percent)
        total += 1 if k == 0 else size + 1 if k == 1 else len(_subsets(n, 3)) if k < 4 else 3 * n
    return total


def signatures(s: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Signed 64-bit signatures of a set, for all its bands, and how many of them a linked set has in common with it at least."""
    if not len(s):
        return np.empty(0, np.int64), 0
    found = [_in_band(s, b, percent) for b in bands_of(len(s), percent)]
    return np.concatenate([x for x, _ in found]), min(need for _, need in found)


def _in_band(s: np.ndarray, band: int, percent: int) -> tuple[np.ndarray, int]:
    """The band's signatures, and how many of them a linked set shares."""
    k, n, least = scheme(band, percent)
    tag = mix(np.array([band + 1], np.uint64) << np.uint64(40))
    value = mix(s ^ tag)
    total = value.sum(dtype=np.uint64)
    if k == 0:
        return mix(np.array([total], np.uint64) ^ tag).view(np.int64), 1
    if k == 1:
        return np.unique(mix(np.concatenate([[total], total - value]) ^ tag)).view(np.int64), 1
    cells = n if k < 4 else 3 * n
    cell = ((mix(value) >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    count = np.bincount(cell, minlength=cells)
    ends = np.cumsum(count)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[order], dtype=np.uint64)])
    sums = run[ends] - run[ends - count]
    if k < 4:
        out = mix(mix(sums[_subsets(n, 3)].sum(1, dtype=np.uint64)) + tag + np.arange(len(_subsets(n, 3)), dtype=np.uint64))
        return out.view(np.int64), 1
    # in each partition the subset of all cells but one, for each one
    sums, count = sums.reshape(n, 3), count.reshape(n, 3)
    sums, count = sums.sum(1, dtype=np.uint64)[:, None] - sums, count.sum(1)[:, None] - count
    out = mix(mix(sums.reshape(-1)) + tag + np.arange(cells, dtype=np.uint64)).view(np.int64)
    enough = count >= least
    telling = int(enough.all(1).sum())
    if 2 * telling <= k:
        return out, 1
    # a partition with one difference keeps one of its three signatures, one without all; one difference in each spoils most
    return out[enough.reshape(-1)], 2 * telling - k if telling <= k else 3 * telling - 2 * k


SEEN = 1 << 18  # nodes that a task remembers so as to send equal sets once


def _nodes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, node (null for the empty set) and signs (number of signatures), a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_chunks(batches):
            sets = shingle_sets(part.column(1).cast(pa.binary()).to_pylist(), width)
            nodes = pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())
            signs = pa.array([signature_count(len(s), percent) if len(s) else 0 for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), nodes, signs], names=["doc_id", "n_shingles", "node", "signs"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, node long, signs long")


def _distinct_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[dict[int, np.ndarray]]:
    """The sets of a task by node, each once as far as the task remembers."""
    seen: set[int] = set()
    for part in row_chunks(batches):
        sets = shingle_sets(part.column(0).cast(pa.binary()).to_pylist(), width)
        once = {}
        for s in sets:
            if len(s) and (n := node_of(s)) not in seen:
                once[n] = s
        if len(seen) + len(once) > SEEN:
            seen.clear()
        seen.update(once)
        if once:
            yield once


def _sets(docs: DataFrame, width: int, percent: int, bitmap) -> DataFrame:
    """node, items, size and sketch of the sets whose nodes the broadcast bitmap doesn't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for once in _distinct_sets(batches, width):
            keys = np.array(list(once), np.int64)
            keys = keys[_in_bitmap(bitmap.value, keys)]
            if len(keys):
                sets = [once[n] for n in keys.tolist()]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                items = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
                sketches = pa.array([sketch_of(s, percent) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys), items, pa.array(np.diff(offsets)), sketches], names=["node", "items", "size", "sketch"])

    return docs.select("text").mapInArrow(run, "node long, items array<long>, size int, sketch binary")


_ENTRY = np.dtype([("key", "<u4"), ("need", "u1"), ("node", "<i8")])  # 13 bytes


def _blobs(docs: DataFrame, width: int, percent: int, parts: int) -> DataFrame:
    """part, entries: the signatures of all sets with their nodes. A signature's upper half tells its part, the lower is its key there."""

    def packed(signs: list[np.ndarray], needs: list[int], nodes: list[int]) -> Iterator[pa.RecordBatch]:
        n = [len(x) for x in signs]
        entries = np.empty(sum(n), _ENTRY)
        every = np.concatenate(signs).view(np.uint64)
        part = (every >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        order = np.argsort(part, kind="stable")
        entries["key"], entries["node"] = every[order].astype(np.uint32), np.repeat(np.array(nodes, np.int64), n)[order]
        entries["need"] = np.repeat(np.minimum(needs, 255).astype(np.uint8), n)[order]
        part = part[order]
        first = np.flatnonzero(np.diff(part, prepend=part[:1] + np.uint64(1)))
        size = np.diff(np.append(first, len(part)))
        pieces = -(-size // BLOB)
        cuts = np.repeat(first, pieces) + BLOB * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        offsets = np.append(cuts, len(part))
        for a in range(0, len(cuts), 4096):
            z = min(a + 4096, len(cuts))
            data = entries[offsets[a] : offsets[z]].tobytes()
            at = ((offsets[a : z + 1] - offsets[a]) * _ENTRY.itemsize).astype(np.int32)
            blob = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts[a:z]].astype(np.int64)), blob], names=["part", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs, needs, nodes, held = [], [], [], 0
        for once in _distinct_sets(batches, width):
            for n, s in once.items():
                found, need = signatures(s, percent)
                signs.append(found)
                needs.append(need)
                nodes.append(n)
                held += len(signs[-1])
            if held > max(1 << 19, min(HELD, 16 * parts)):
                yield from packed(signs, needs, nodes)
                signs, needs, nodes, held = [], [], [], 0
        if held:
            yield from packed(signs, needs, nodes)

    return docs.select("text").mapInArrow(run, "part long, entries binary")


class _Part:
    """The entries of one part as they come; settle() makes of them pairs (small buckets) and members (large ones).

    Memory is bounded by what is in small buckets: when HELD entries are held, members of large buckets are given out and only their keys kept.
    """

    def __init__(self, part: int):
        self.part, self.held, self.n, self.large = part, [], 0, np.empty(0, np.uint32)

    def add(self, entries: np.ndarray) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        self.held.append(entries)
        self.n += len(entries)
        if self.n > HELD:
            yield from self.settle(last=False)

    def settle(self, last: bool) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(is it pairs, a or bucket, b or node, shared signatures or fellows, need), arrays of the same length."""
        every = np.concatenate(self.held)
        order = np.lexsort((every["node"], every["key"]))
        key, node, need = every["key"][order], every["node"][order], every["need"][order]
        own = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))  # copies of one text come once
        key, node, need = key[own], node[own], need[own]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        large = (size > SMALL) | np.isin(key[first], self.large)
        fellows = np.repeat(np.where(large, size, 0), size)
        if large.any():
            yield False, (self.part << 32) + key[fellows > 0].astype(np.int64), node[fellows > 0], fellows[fellows > 0], need[fellows > 0]
            self.large = np.union1d(self.large, key[first][large])
        if not last:
            rest = np.empty(int((fellows == 0).sum()), _ENTRY)
            rest["key"], rest["node"], rest["need"] = key[fellows == 0], node[fellows == 0], need[fellows == 0]
            # as many again before the next time, so that a part of nothing but small buckets isn't sorted over and over
            self.held, self.n = [rest], min(len(rest), HELD // 2)
            return
        found = []
        for k in range(2, SMALL + 1):
            at = first[(size == k) & ~large]
            found += [(node[at + i], node[at + j], np.maximum(need[at + i], need[at + j])) for i, j in itertools.combinations(range(k), 2)]
        a, b, need = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(a):
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            yield True, a[first], b[first], np.diff(np.append(first, len(a))), need[order][first]


def _met(docs: DataFrame, width: int, percent: int, total: int) -> DataFrame:
    """Who shares signatures: pair true: nodes a < b that share n signatures in small buckets of one part, while a link
    shares at least need; false: node b in the large bucket a, with about n fellows. total: the number of signatures."""
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK))
    parts = max(8 * tasks, -(-total // PART))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found) -> Iterator[pa.RecordBatch]:
            for pair, *columns in found:
                for k in range(0, len(columns[0]), 1 << 16):
                    some = [c[k : k + (1 << 16)].astype(np.int64) for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some[0]), pair)), *map(pa.array, some)], names=["pair", "a", "b", "n", "need"])

        lean_worker()
        now = None
        for batch in batches:
            for part, entries in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if now is None or now.part != part:
                    if now is not None:
                        yield from out(now.settle(last=True))
                    now = _Part(part)
                yield from out(now.add(np.frombuffer(entries.as_buffer(), _ENTRY)))
        if now is not None:
            yield from out(now.settle(last=True))

    blobs = _blobs(docs, width, percent, parts).repartition(tasks, "part").sortWithinPartitions("part")
    return blobs.mapInArrow(run, "pair boolean, a long, b long, n long, need long")


def _in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    shift = np.uint64(62 - len(bits).bit_length())  # 2^b bytes: the leading b + 3 bits
    at = values.view(np.uint64) >> shift
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _checked(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it has few rows; else Spark shuffles and splits skewed keys."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def compared(pairs: DataFrame, sets: DataFrame, percent: int, differences: bool = False) -> DataFrame:
    """pairs (a, b) of nodes with linked, the exact answer; if asked for, with what _others() needs of b's difference to a:
    the difference, differ and size (numbers of shingles), and how many of its first shingles matter: half of it against any, long
    against members that are linked with the pivot."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    both = both.withColumn("linked", 100 * F.col("common") >= percent * (F.size("x") + F.size("y") - F.col("common")))
    if not differences:
        return both.select(*pairs.columns, "linked")
    both = both.withColumn("size", F.size("y")).withColumn("differ", F.size("x") + F.size("y") - 2 * F.col("common"))
    half = F.col("differ") - F.floor(((100 + percent) * F.col("differ") + (100 - percent) * (F.size("x") - F.size("y"))) / F.lit(2 * (100 + percent)))
    most = F.floor((100 - percent) * F.col("size") / F.lit(percent))  # differences of b to any set that is linked with it: c |b| (1 + 1 / g)
    long = F.when(F.col("linked"), 0).otherwise(F.col("differ") - F.greatest(F.lit(1), F.col("differ") - most) + 1)
    own = F.concat(F.array_except("y", "x"), F.array_except("x", "y"))
    return both.select(*pairs.columns, "linked", "size", "differ", half.cast("int").alias("half"), F.greatest(half, long).cast("int").alias("long"), own.alias("difference"))


def _others(stars: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of a pivot, of different components, at least one not linked with it, that can be linked. stars: compared() with
    differences, and label (b's component).

    Let D(x) be the difference of x to the pivot p and c = (1 - g) / (1 + g); two sets are linked if they differ in at most c times the
    sum of their sizes. x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)|. One of the two, x, isn't linked with p, so |D(x)| > c (|x| + |p|); then a link of x and y needs |D(x) & D(y)| > (|D(y)| + c (|p| - |y|)) / 2; by the triangle inequality it also needs
    |D(x) & D(y)| >= |D(x)| - c |x| (1 + 1 / g). In any common order of shingles, sets with so much in common have one in common among the first
    |D| - overlap + 1 of each (prefix filter), and at their first common place enough is left of both (positional filter).
    Shingles come in the order of how many of the pivot's members have them in their difference, the rarest first, so unrelated edits
    don't meet in what many members have lost or gained alike.
    """
    items = stars.select("a", "b", "linked", "label", "size", "differ", "half", "long", F.explode("difference").alias("item"))
    often = items.groupBy("a", "item").agg(F.count("*").alias("often"))
    placed = items.join(often, ["a", "item"]).withColumn("at", F.row_number().over(Window.partitionBy("a", "b").orderBy("often", "item")) - 1)
    placed = stored(placed.where((F.col("at") < F.col("long")) & (F.col("often") > 1)).drop("often"), "placed")  # what one member has alone meets nothing
    one = placed.where(~F.col("linked")).alias("x")
    two = placed.where(F.col("at") < F.col("half")).alias("y")
    left = F.least(F.col("x.differ") - F.col("x.at"), F.col("y.differ") - F.col("y.at"))
    enough = (100 + percent) * (F.col("x.differ") + F.col("y.differ") - 2 * left) <= (100 - percent) * (F.col("x.size") + F.col("y.size"))
    fits = 100 * F.least("x.size", "y.size") >= percent * F.greatest("x.size", "y.size")
    once = (F.col("x.label") != F.col("y.label")) & (F.col("y.linked") | ((F.col("x.b") < F.col("y.b")) & (F.col("x.at") < F.col("x.half"))))
    met = one.join(two, (F.col("x.a") == F.col("y.a")) & (F.col("x.item") == F.col("y.item")) & once & enough & fits)
    return met.select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct()


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """edges (a, b) -> node, label: the smallest node of its component, for all nodes with an edge.

    Each round every node takes the smallest label among its neighbours and itself and then the label of that label;
    it ends when a round changes nothing. Labels only fall and stay within a component.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{name}-edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), name)
    while True:
        old = labels
        near = both.join(old.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = old.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        # a label of many nodes isn't shuffled by if labels are few; else Spark splits it
        jump = old.join(old.select(F.col("label").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = stored(step.join(_checked(jump), "label").select("node", F.least("label", "further").alias("label"), "was"), name)
        done = labels.where("label < was").limit(1).count() == 0
        drop_stored(old)
        labels = labels.drop("was")
        if done:
            drop_stored(both)
            return labels


def _bitmap(values: DataFrame):
    """A broadcast bitmap of a column of hashes: bits at their leading bits, 2^16 to 2^MOST_BITS of them, however many hashes there are."""
    n = values.count()
    bits = min(MOST_BITS, max(16, (16 * n).bit_length()))
    (name,) = values.columns
    at = values.select(F.shiftrightunsigned(name, 64 - bits).alias("at"))
    words = at.groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 AS INT)))").alias("bits"))
    blocks = words.groupBy(F.expr("shiftright(word, 10)").alias("block")).agg(F.collect_list(F.struct("word", "bits")).alias("words"))  # 1024 at most

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for words in batch.column(1):
                word, own = (words.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                block = np.zeros(1024, np.int64)
                block[word & 1023] = own
                packed.append(block.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["block", "bits"])

    out = np.zeros(max(1 << (bits - 6), 1024), np.int64)
    for r in blocks.mapInArrow(pack, "block long, bits binary").collect():  # 8 MB at most
        out[1024 * r["block"] : 1024 * (r["block"] + 1)] = np.frombuffer(r["bits"], np.int64)
    return values.sparkSession.sparkContext.broadcast(out.view(np.uint8))


def _large(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """bucket, node, need and small, the number of signatures that it shares in small buckets at most, of those members of large buckets that share
    as many signatures as a link needs; and bucket, pivot: the member with most fellows, since copies that were edited share more with their
    origin than with each other, so the buckets of a group have one pivot in common, as a rule."""
    large = met.where("not pair").select(F.col("a").alias("bucket"), F.col("b").alias("node"), F.col("n").alias("fellows"), "need")
    small = met.where("pair").select("a", "b", "n")
    each = large.select("node", "fellows", "need", F.lit(1).alias("large"), F.lit(0).cast("long").alias("small"))
    for x in ("a", "b"):
        each = each.union(small.select(x, F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(0), "n"))
    known = each.groupBy("node").agg(F.sum("fellows").alias("all_fellows"), F.max("need").alias("need"), F.sum("large").alias("large"), F.sum("small").alias("small"))
    known = known.where("need is not null and large + small >= need").drop("large")
    large = stored(large.select("bucket", "node").join(known, "node"), "large")
    pivots = stored(large.groupBy("bucket").agg(F.max(F.struct("all_fellows", "node")).alias("top")).select("bucket", F.col("top.node").alias("pivot")), "pivots")
    return large, pivots


def _star_rows(large: DataFrame, pivots: DataFrame) -> DataFrame:
    """a, b, n: each member b of large buckets with the pivot a, and how many buckets they have in common."""
    rows = large.select("bucket", "node").join(_checked(pivots), "bucket").where("node <> pivot")
    return rows.groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("n"))


def _still_open(large: DataFrame, labels: DataFrame) -> DataFrame:
    """large with label, without buckets of one component and without nodes that share less with other components than a link needs."""
    rows = stored(large.join(_checked(labels), "node", "left").withColumn("label", F.coalesce("label", "node")), "open")
    for _ in range(ROUNDS):
        mixed = rows.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
        left = rows.join(mixed, "bucket", "left_semi")
        enough = left.groupBy("node").agg(F.count("*").alias("n"), F.first("small").alias("small"), F.first("need").alias("need")).where("n + small >= need").select("node")
        left = stored(left.join(enough, "node", "left_semi"), "open")
        drop_stored(rows)
        rows = left
    return rows


def _by_sketches(counted: DataFrame, small: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in buckets of few nodes, without those that share fewer signatures than a link needs or whose sketches
    tell that they differ too much. counted: rows with k, the nodes of the bucket; small: a, b, n, the signatures that pairs share in small buckets."""
    own = counted.withColumn("wide", F.sum((F.col("k") > MEDIUM).cast("int")).over(Window.partitionBy("node"))).where(F.col("k") <= MEDIUM)
    own = own.select("bucket", "node", "label", "need", "wide")
    x, y = own.alias("x"), own.alias("y")
    met = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")))
    # in buckets of many nodes they share as many as either has at most
    met = met.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count("*").alias("n"), F.max(F.greatest("x.need", "y.need")).alias("need"), F.max(F.least("x.wide", "y.wide")).alias("wide"))
    met = met.join(small.withColumnRenamed("n", "more"), ["a", "b"], "left").where(F.col("n") + F.coalesce("more", F.lit(0)) + F.col("wide") >= F.col("need"))
    return _near(met.select("a", "b"), sets, percent)


def _sets_of(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets that stored pairs (a, b) ask for."""
    asked = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "asked")
    return sets.join(_checked(asked), "node", "left_semi")


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that sizes and sketches don't rule out.

    A sketch cuts a set's domain into cells and has a byte for each, of all the shingles in it; sets that differ in d shingles differ in d cells at most.
    Bytes of neighbouring cells fold into one by exclusive or, so sketches of different lengths can be compared.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for batch in batches:
            sizes = batch.column(2).to_numpy().astype(np.int64) + batch.column(4).to_numpy()
            differ = np.array([cells_apart(x, y) for x, y in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array((100 + percent) * differ <= (100 - percent) * sizes))

    for k in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(k), F.col("size").alias(f"size_{k}"), F.col("sketch").alias(f"sketch_{k}")), k)
    fits = 100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")
    return pairs.where(fits).select("a", "b", "size_a", "sketch_a", "size_b", "sketch_b").mapInArrow(near, "a long, b long")


def sketch_of(s: np.ndarray, percent: int) -> bytes:
    """A byte for each cell: 2.5 to 5 cells for each shingle that a linked set may differ in."""
    bits = max(3, (5 * (100 - percent) * len(s) // (100 + percent)).bit_length())
    value = mix(s ^ np.uint64(_BASE))
    cell = (value >> np.uint64(64 - bits)).astype(np.int64)
    out = np.zeros(1 << bits, np.uint8)
    np.bitwise_xor.at(out, cell, value.astype(np.uint8))
    return out.tobytes()


def cells_apart(x: bytes, y: bytes) -> int:
    """How many cells of two sketches differ, the longer one folded to the shorter."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    b = np.bitwise_xor.reduce(b.reshape(len(a), -1), axis=1)
    return int(np.count_nonzero(a != b))


def _by_differences(rows: DataFrame, nearest: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a, b) of different components in buckets of many nodes, and the links of the buckets' pivots. nearest:
    a, b: the pivot that b was compared with first. A bucket's pivot is here the one that most of its members were, so a node has few. Members of
    a pivot of some thousands are compared by sketches, block by block; those of a larger one by their differences to it."""
    if not rows.limit(1).count():
        return rows.select(F.col("node").alias("a"), F.col("node").alias("b")), None
    votes = rows.join(nearest.select(F.col("b").alias("node"), "a"), "node", "left").groupBy("bucket", F.coalesce("a", "node").alias("a")).agg(F.count("*").alias("n"))
    pivots = stored(votes.groupBy("bucket").agg(F.max(F.struct("n", "a")).alias("top")).select("bucket", F.col("top.a").alias("a")), "pivots")
    told = stored(rows.select("bucket", F.col("node").alias("b"), "label").join(_checked(pivots), "bucket").where("a <> b").select("a", "b", "label").distinct(), "told")
    drop_stored(pivots)
    sized = told.join(told.groupBy("a").agg(F.count("*").alias("m")), "a")
    blocks = _in_blocks(sized.where(F.col("m") <= MANY), sets, percent)
    # a pivot itself is one of the nodes that are to be compared with its members
    own_links = stored(compared(near_pivots := stored(_near(told.select("a", "b"), sets, percent), "near"), _sets_of(near_pivots, sets), percent).where("linked").select("a", "b"), "own")
    drop_stored(near_pivots)
    wide = stored(sized.where(F.col("m") > MANY).select("a", "b", "label"), "wide")
    if not wide.limit(1).count():
        return blocks, own_links
    differing = stored(compared(wide, _sets_of(wide, sets), percent, differences=True), "differing")
    return blocks.union(_others(differing, percent)), own_links


def _in_blocks(told: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one pivot, of different components, that sizes and sketches don't rule out. told: a (the pivot), b, label, m (its
    members). Members are dealt to pages of about PAGE, and each two pages of a pivot meet in a group of their own."""
    own = told.join(sets.select(F.col("node").alias("b"), "size", "sketch"), "b").withColumn("pages", F.ceil(F.col("m") / PAGE).cast("int"))
    own = own.withColumn("page", F.pmod(F.xxhash64("b"), F.col("pages")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)))
    own = own.select("a", F.least("page", "other").alias("i"), F.greatest("page", "other").alias("j"), "page", "b", "label", "size", "sketch")

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        lean_worker()
        i, j, page = (pdf[x].to_numpy() for x in ("i", "j", "page"))
        node, label, size = (pdf[x].to_numpy(np.int64) for x in ("b", "label", "size"))
        sketches, a, b = pdf["sketch"].tolist(), [], []
        for at in np.flatnonzero(page == i):
            fits = (label != label[at]) & (100 * np.minimum(size, size[at]) >= percent * np.maximum(size, size[at]))
            fits &= (page == j) if i[0] != j[0] else node > node[at]
            for k in np.flatnonzero(fits).tolist():
                if (100 + percent) * cells_apart(sketches[at], sketches[k]) <= (100 - percent) * (size[at] + size[k]):
                    a.append(min(node[at], node[k]))
                    b.append(max(node[at], node[k]))
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return own.groupBy("a", "i", "j").applyInPandas(near, "a long, b long")


def node_components(docs: DataFrame, own: DataFrame, width: int, percent: int) -> DataFrame:
    """node, label for the nodes that are linked with another. own: _nodes() of docs, stored."""
    met = stored(_met(docs, width, percent, own.agg(F.sum("signs")).first()[0] or 0), "met")
    release(docs.sparkSession)
    large, pivots = _large(met)
    # a node is first compared with the pivot that it shares most with; links that this leaves are between different components and found below
    most = F.row_number().over(Window.partitionBy("b").orderBy(F.col("n").desc(), "a"))
    stars = stored(_star_rows(large, pivots).withColumn("at", most).where("at = 1").select("a", "b"), "stars")
    # linked nodes that meet in no large bucket have all that they share in small ones, where it must be enough
    small = stored(met.where("pair").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need")), "small")
    pairs = small.where("n >= need").select("a", "b")
    small = small.select("a", "b", "n")
    drop_stored(met)
    both = stars.union(pairs)
    wanted = stored(both.select(F.col("a").alias("node")).union(both.select("b")).distinct(), "wanted")
    sets = stored(_sets(docs, width, percent, _bitmap(wanted)).join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")
    drop_stored(wanted)
    release(docs.sparkSession)

    near = stored(_near(both, sets, percent), "near")
    first = stored(compared(near, _sets_of(near, sets), percent).where("linked"), "first")
    labels = components(first.select("a", "b"))
    drop_stored(near, first)
    release(docs.sparkSession)
    # large buckets that hold more than one component still
    rows = _still_open(large, labels)
    drop_stored(large)
    if not rows.limit(1).count():
        drop_stored(rows, pivots, small, stars, sets)
        return labels
    counted = rows.join(rows.groupBy("bucket").agg(F.count("*").alias("k")), "bucket")
    others, own_links = _by_differences(counted.where(F.col("k") > MEDIUM), stars, labels, sets, percent)
    rest = stored(_by_sketches(counted, small, sets, percent).union(others).distinct(), "rest")
    drop_stored(rows, pivots, small, stars)
    release(docs.sparkSession)
    label = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    tested = compared(rest, _sets_of(rest, sets), percent).where("linked").select("a", "b")
    tested = (tested if own_links is None else tested.union(own_links)).join(_checked(label("a")), "a", "left").join(_checked(label("b")), "b", "left")
    tested = stored(tested.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")), "tested")
    drop_stored(rest, sets)
    over = components(tested, "over")
    every = labels.union(over.select("node", F.col("node").alias("label"))).distinct()
    found = every.join(_checked(over.select(F.col("node").alias("label"), F.col("label").alias("further"))), "label", "left")
    found = stored(found.select("node", F.coalesce("further", "label").alias("label")), "labels")
    drop_stored(tested, over, labels)
    return found


def join_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id; a row for each row.

    component_id is the smallest doc_id that is reachable by links, where two documents are linked if 100 * |intersection| >=
    percent * |union| of their sets of width-word shingles. Null, empty and wordless texts have no shingles and are
    linked with nothing: their component_id is their doc_id. Repeated rows and equal texts are in one component. Whole texts
    are read; other columns are ignored. Shingles and sets are told apart by 64-bit hashes.
    """
    return _component_rows(docs, width, percent).select("doc_id", "n_shingles", "component_id")


def _component_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, node, label (of the component, as two may have one smallest doc_id), component_id."""
    own = stored(_nodes(docs, width, percent), "nodes")
    labels = node_components(docs, own, width, percent)
    classes = own.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    classes = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    by_label = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = stored(classes.join(by_label, "label").select("node", "label", "component_id"), "components")
    out = own.join(of_node, "node", "left")
    return out.select("doc_id", "n_shingles", "node", "label", F.coalesce("component_id", "doc_id").alias("component_id"))


def _with_node(docs: DataFrame, width: int, name: str) -> DataFrame:
    """docs and the node of each row's set, null for the empty one."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_chunks(batches):
            sets = shingle_sets(part.column(at).cast(pa.binary()).to_pylist(), width)
            nodes = pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns, nodes], names=[*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs, same columns, with one row, of the smallest doc_id, for each component; rows with no shingles all stay.

    Of repeated rows with that doc_id one stays. Where rows of one doc_id differ in their texts, each counts by its own text.
    """
    found = _component_rows(docs.select("doc_id", "text"), width, percent)
    gone = stored(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    each = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.count("node").alias("nodes"), F.min("node").alias("least"), F.max("node").alias("most"))
    again = stored(each.where("n > 1 and nodes > 0").select("doc_id", F.expr("least <> most or nodes < n").alias("mixed")), "again")
    rest = docs.join(_checked(gone), "doc_id", "left_anti")
    if not again.limit(1).count():
        return rest
    same, mixed = again.where("not mixed").select("doc_id"), again.where("mixed").select("doc_id")
    # rows that repeat a doc_id are few or copies of each other: one of each is kept
    one = rest.join(_checked(same), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    out = rest.join(_checked(again.select("doc_id")), "doc_id", "left_anti").unionByName(one)
    if not mixed.limit(1).count():
        return out
    node, label = "_estima_node", "_estima_label"
    own = _with_node(docs.join(_checked(mixed), "doc_id", "left_semi"), width, node)
    kept = found.where("node is not null and doc_id = component_id").join(_checked(mixed), "doc_id", "left_semi")
    kept = kept.select("doc_id", F.col("node").alias(node), F.col("label").alias(label)).distinct()
    by_text = own.join(kept, ["doc_id", node]).dropDuplicates(["doc_id", label]).drop(node, label)
    return out.unionByName(by_text).unionByName(own.where(F.col(node).isNull()).drop(node))
