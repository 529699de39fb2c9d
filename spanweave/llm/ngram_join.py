"""N-gram Jaccard self-join: documents whose word 5-gram sets overlap by 80 % or more, and what such links connect.

Links hold where 100 * |A & B| >= 80 * |A | B|, exactly. The way there:

1. Equal sets are one node (their digest says so); only one document of each goes on.
2. Blocks, with no loss: in one order of all shingles, two sets that link share one of the first n - ceil(0.8 n) + 1 of
   each. The order is by how often all documents fill the hash bucket of a shingle (a table of fixed size), rare before
   frequent, so a passage that many documents share does not bring them together. Keys of one document alone go; hot
   keys are salted while that is decided.
3. In each block every member is a point: its shingle counts by hash group, as many groups as its size asks for. An
   R-tree over these points, whose nodes bound the overlap by the summed minima with their coordinate maxima, gives
   each member the others that it may link with. Every pair that is verified comes from such a search.
4. Of what a search leaves, a block gives no more pairs than join its components (a forest, the greatest bounds first);
   they are verified on whole sets. Blocks that links connect are done: more links in them would change no component.
   The others are searched again for further forests until no pair is left. The first turn searches only by the first
   keys of each set, which most linking pairs share; the second searches all blocks that are still open.
5. Blocks larger than a tile are dealt by a hash, in two turns, each tile with the block's least member as well, so a
   large group of copies costs as much as it has members; only what is then open is compared tile by tile.
6. Components are spread by alternating star contractions in the shared folder, never on the driver.

Defined cases: null and empty text, and white space alone, have no shingles and link with nothing; fewer than five
words are one shingle. Every row is a node of its own: where ids repeat or are null, rows are numbered first (and staged
with their texts), and a component is named by its least id, by null if it has none. An empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, forget, map_arrow, numbered, release_shuffles, ship_package, stage

WIDTH = 5
#: Bits of a shingle's bucket in the table of frequencies, and slices that the table is summed in.
BUCKET_BITS, SLICES = 22, 64
#: A bucket so many times as full as the mean is hot; its keys are salted.
HOT_TIMES, HOT_LEAST, SALTS = 16, 256, 64
#: Pairs with one centre that one task verifies, about.
STAR = 1024
#: Keys of a set that the first turn searches by.
FIRST = 2
#: The coordinates of a set's finest vector are 2 ** FINE_BITS times those that its neighbour class searches by.
FINE_BITS = 1
TILE = 1024
#: Bytes of text that are hashed at once; longer words are hashed as a whole.
BLOCK = 1 << 18
_PLAIN = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


_TABLE = np.array([xxhash.xxh64_intdigest(bytes([b]), seed=11) | 1 for b in range(256)], dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15
_UP, _DOWN = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers(n: int) -> None:
    """Powers of an odd number and of its inverse modulo 2^64, up to the n-th at least."""
    global _UP, _DOWN
    if len(_UP) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _UP, _DOWN = (np.concatenate([[np.uint64(1)], np.full(size - 1, f, np.uint64)]) for f in (_STEP, pow(_STEP, -1, 1 << 64)))
        np.multiply.accumulate(_UP, out=_UP)
        np.multiply.accumulate(_DOWN, out=_DOWN)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of plain text: the sum of its bytes' numbers times powers of their places.

    All words at once: sums over the text up to a word's ends, their difference moved back to the word's start.
    """
    a = np.frombuffer(data, np.uint8)
    ink = np.zeros(len(a) + 2, np.int8)
    ink[1:-1] = a != 32
    edges = np.flatnonzero(ink[1:] != ink[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    _powers(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_TABLE[a] * _UP[: len(a)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _DOWN[starts]
    h ^= h >> np.uint64(31)
    h *= _MIX[0]
    return h ^ (h >> np.uint64(29))


def shingles(data: bytes | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word 5-grams of a text."""
    data = (data or b"").translate(_PLAIN)
    if len(data) <= BLOCK:
        h = word_hashes(data)
    else:  # long texts in blocks of whole words
        parts, at = [], 0
        while at < len(data):
            end = data.find(b" ", at + BLOCK)
            end = len(data) if end < 0 else end
            last = data.rfind(b" ", at, at + BLOCK) + 1 or at
            if end - last > BLOCK:
                parts += [word_hashes(data[at:last]), np.frombuffer(hashlib.blake2b(data[last:end], digest_size=8).digest(), np.uint64)]
            else:
                parts.append(word_hashes(data[at:end]))
            at = end
        h = np.concatenate(parts)
    if not len(h):
        return h
    if len(h) < WIDTH:
        return np.frombuffer(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), np.uint64).copy()
    n = len(h) - WIDTH + 1
    out = h[:n] * _MIX[0]
    for k in range(1, WIDTH):
        out ^= out >> np.uint64(29)
        out += h[k : k + n]
        out *= _MIX[k]
    out ^= out >> np.uint64(32)
    out.sort()
    new = np.ones(n, bool)
    np.not_equal(out[1:], out[:-1], out=new[1:])
    return out[new]


def size_class(n):
    """Sizes of one class differ by a factor of 2 at most; a class and the next hold all partners of a size."""
    return np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)


def groups(cls: int) -> int:
    """Coordinates of the points of a class: two to four shingles in each group."""
    return 1 << max(0, int(cls) - 1)


def count_vector(s: np.ndarray) -> bytes:
    """Shingle counts by hash group, packed; FINE times as many groups as the next higher class needs."""
    bits = _bits(len(s))
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return zlib.compress(counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32).tobytes(), 1)


def _bits(n: int) -> int:
    return max(0, int(size_class(n)) - 1) + 1 + FINE_BITS


def unpack(vector: bytes, n: int) -> np.ndarray:
    data = zlib.decompress(vector)
    return np.frombuffer(data, np.uint8 if len(data) == 1 << _bits(n) else np.uint32)


def coarse(counts: np.ndarray, cls: int) -> np.ndarray:
    """A count vector with the coordinates of a class: its own, the next lower or the next higher."""
    return counts.reshape(groups(cls), -1).sum(axis=1, dtype=np.int32)


def fine_bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The summed minima of an unpacked vector with each row of a matrix of others, on the coordinates of the coarser."""
    n = min(len(a), b.shape[1])
    a = a if len(a) == n else a.reshape(n, -1).sum(axis=1)
    b = b if b.shape[1] == n else b.reshape(len(b), n, -1).sum(axis=2)
    return np.minimum(a, b).sum(axis=1, dtype=np.int64)


def needed(a, b):
    """The least overlap that links sets of these sizes: 100 i >= 80 (a + b - i)."""
    return (80 * (a + b) + 179) // 180


def prefix(s: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The first keys of a set: by the level of their bucket, and by hash among equals."""
    n = len(s)
    size = n - (4 * n + 4) // 5 + 1 if n else 0
    often = level[s >> np.uint64(64 - BUCKET_BITS)]
    return s[np.argsort(often, kind="stable")[:size]] if often.any() else s[:size]


def _id_bytes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))


def _base(docs: DataFrame) -> DataFrame:
    """id, n, digest of each row; and from each task rows with slice and counts: how full its buckets are."""
    schema = "id bigint, n bigint, digest binary, slice int, counts binary"
    fields = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("slice", pa.int32()), ("counts", pa.binary())])
    wide = (1 << BUCKET_BITS) // SLICES

    def run(batches):
        forget()
        total = np.zeros(1 << BUCKET_BITS, np.uint32)
        waiting: list[np.ndarray] = []
        for batch in batches:
            n, digest = [], []
            for value in batch.column(1):
                s = shingles(value.as_py())
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                waiting.append((s >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
            if sum(map(len, waiting)) > 1 << 20:
                total += np.bincount(np.concatenate(waiting), minlength=len(total)).astype(np.uint32)
                waiting = []
            none = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), *none], schema=fields)
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=len(total)).astype(np.uint32)
        if total.any():
            parts = [zlib.compress(_narrow(total[k * wide : (k + 1) * wide]), 1) for k in range(SLICES)]
            none = [pa.nulls(SLICES, t) for t in (pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], schema=fields)

    ship_package(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def _narrow(counts: np.ndarray) -> bytes:
    """Counts as bytes of the least width, which comes first."""
    kind = next(k for k, most in (("u1", 1 << 8), ("u2", 1 << 16), ("u4", 1 << 32), ("u8", 1 << 64)) if int(counts.max(initial=0)) < most)
    return kind.encode() + counts.astype(kind).tobytes()


def _widen(data: bytes) -> np.ndarray:
    data = zlib.decompress(data)
    return np.frombuffer(data, data[:2].decode(), offset=2).astype(np.uint64)


def _levels(base: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket's level of frequency, 0 where it is no fuller than chance makes it, and whether it is hot.

    The tables of all tasks are summed slice by slice, first in 32 parts of each, so no task holds many of them; what
    comes to the driver has the size of one table.
    """
    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(_widen(x) for x in pdf["counts"])
        return pd.DataFrame({"slice": [key[0]], "counts": [zlib.compress(_narrow(total), 1)]})

    rows = base.where("slice is not null").select("slice", "counts", F.pmod(F.xxhash64("counts"), F.lit(32)).alias("part"))
    once = rows.groupBy("slice", "part").applyInPandas(add, "slice int, counts binary")
    parts = {r["slice"]: _widen(r["counts"]) for r in once.groupBy("slice").applyInPandas(add, "slice int, counts binary").collect()}
    if not parts:
        return np.zeros(1 << BUCKET_BITS, np.uint8), np.zeros(1 << BUCKET_BITS, bool)
    # Slice by slice: the driver holds one table of bytes, not several of wide numbers.
    mean = sum(int(x.sum()) for x in parts.values()) / (1 << BUCKET_BITS)
    level, hot = [], []
    for k in range(SLICES):
        full = parts.pop(k).astype(np.float64)
        over = full - (mean + 4 * np.sqrt(mean) + 2)
        level.append(np.where(over > 0, 1 + np.floor(4 * np.log2(np.maximum(over, 1))), 0).astype(np.uint8))
        hot.append(full > max(HOT_LEAST, HOT_TIMES * mean))
    return np.concatenate(level), np.concatenate(hot)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64), pa.int64()))


def _blocks(docs: DataFrame, level: np.ndarray, hot: np.ndarray) -> DataFrame:
    """key, id, n, first (whether the key is among a set's FIRST) for keys of two documents (a hot key counts as such)."""
    shared = docs.sparkSession.sparkContext.broadcast((level, hot))

    def keys(batch: pa.RecordBatch) -> dict:
        level, hot = shared.value
        parts, sizes = [], []
        for value in batch.column(1):
            s = shingles(value.as_py())
            sizes.append(len(s))
            parts.append(prefix(s, level))
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        owner = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(ends)) if len(parts) else np.empty(0, np.int64)
        salt = np.where(hot[flat >> np.uint64(64 - BUCKET_BITS)], 1 + owner % SALTS, 0).astype(np.int32)
        # The sign of a salt says whether the key is among the first.
        head = np.arange(len(flat)) - np.repeat(ends[:-1], np.diff(ends)) < FIRST
        salt = np.where(head, salt, -1 - salt)
        return {"id": batch.column(0), "n": sizes, "keys": _lists(parts), "salts": pa.ListArray.from_arrays(pa.array(ends), pa.array(salt.astype(np.int32)))}

    rows = map_arrow(docs, keys, "id bigint, n bigint, keys array<bigint>, salts array<int>")
    rows = rows.select("id", "n", F.inline(F.arrays_zip("keys", "salts"))).withColumnsRenamed({"keys": "key", "salts": "salt"})
    rows = rows.select("id", "n", "key", F.when(F.col("salt") < 0, -1 - F.col("salt")).otherwise(F.col("salt")).alias("salt"), (F.col("salt") >= 0).alias("first"))
    dealt = rows.repartition("key", "salt").sortWithinPartitions("key", "salt")

    def several(batches):
        """Rows whose key the row before or after has too, or is hot; a run may go on in the next batch."""
        names = ["id", "n", "key", "salt", "first"]
        held: dict | None = None  # the last row, if it is not yet known to have company
        last = None  # key of the last row, if that row was given out
        for batch in batches:
            c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
            if not len(c["key"]):
                continue
            if held is not None:
                c = {k: np.concatenate([held[k], c[k]]) for k in names}
            key = c["key"]
            same = key[1:] == key[:-1]
            keep = c["salt"] > 0
            keep[1:] |= same
            keep[:-1] |= same
            if last is not None and held is None:
                keep |= (np.cumsum(np.concatenate([[False], ~same])) == 0) & (key[0] == last)
            if keep[-1]:
                held, last = None, key[-1]
            else:
                held, last = {k: v[-1:] for k, v in c.items()}, None
            yield pa.RecordBatch.from_arrays([pa.array(c[k][keep]) for k in ("key", "id", "n", "first")], names=["key", "id", "n", "first"])

    return dealt.mapInArrow(several, "key bigint, id bigint, n bigint, first boolean")


class Searcher:
    """An R-tree over count vectors: leaves of points and inner nodes, each with the coordinate maxima below it."""

    FAN = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        spread = int(np.argmax(points.var(axis=0))) if len(points) else 0
        self.order = np.lexsort((points[:, spread], sizes))
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > self.FAN:
            top, low, high = self.levels[-1]
            cut = np.arange(0, len(top), self.FAN)
            self.levels.append((np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def search(self, point: np.ndarray, size: int, wanted: np.ndarray) -> np.ndarray:
        """Positions of the wanted points whose overlap with this one may reach what a link needs."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            fits = (100 * high[at] >= 80 * size) & (80 * low[at] <= 100 * size)
            if not depth:
                fits &= wanted[self.order[at]]
            at = at[fits]
            bound = np.minimum(top[at], point).sum(axis=1)
            at = at[bound >= needed(size, np.maximum(low[at], (4 * size + 4) // 5))]
            if depth:
                at = (at[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at]


def _candidates(ids: np.ndarray, sizes: np.ndarray, comps: np.ndarray, sides: np.ndarray, vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Places of each two members in different components that a tree search leaves, those of the greatest bounds first.

    sides: 0 queries and points, 1 queries, 2 points.
    """
    classes = size_class(sizes)
    fine = [unpack(v, int(n)) for v, n in zip(vectors, sizes, strict=True)]
    each = bool((sides == 0).all())
    one, two, far = [], [], []
    for cls in np.unique(classes[sides != 1]).tolist():
        points = np.flatnonzero((classes == cls) & (sides != 1))
        wide = np.stack([fine[k] for k in points])
        tree = Searcher(wide.reshape(len(points), groups(cls), -1).sum(axis=2, dtype=np.int32), sizes[points])
        for q in np.flatnonzero((np.abs(classes - cls) <= 1) & (sides != 2)).tolist():
            wanted = comps[points] != comps[q]
            if each:  # a pair is found from its lesser end
                wanted &= ids[points] > ids[q]
            if not wanted.any():
                continue
            if not len(near := tree.search(coarse(fine[q], cls), int(sizes[q]), wanted)):
                continue
            bound = fine_bounds(fine[q], wide[near])
            fits = bound >= needed(int(sizes[q]), sizes[points[near]])
            near = points[near[fits]]
            one.append(np.full(len(near), q))
            two.append(near)
            far.append(bound[fits] / (sizes[near] + int(sizes[q])))
    if not one:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    one, two, far = (np.concatenate(x) for x in (one, two, far))
    order = np.lexsort((ids[two], ids[one], -far))
    return one[order], two[order]


def _search_group(ids: np.ndarray, sizes: np.ndarray, comps: np.ndarray, sides: np.ndarray, vectors: list, forests: int) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of one tile in different components that may link, in so many forests, and whether there are others.

    A forest takes the pairs of the greatest bounds that join components; the next one does so with what is left.
    """
    one, two = _candidates(ids, sizes, comps, sides, vectors)
    label = np.unique(comps, return_inverse=True)[1].tolist()
    left = list(zip(one.tolist(), two.tolist(), strict=True))
    out: list[tuple[int, int]] = []
    for _ in range(forests):
        if not left:
            break
        up = list(range(len(ids)))
        rest = []
        for pair in left:
            x, y = label[pair[0]], label[pair[1]]
            while up[x] != x:
                up[x] = x = up[up[x]]
            while up[y] != y:
                up[y] = y = up[up[y]]
            if x == y:
                rest.append(pair)
            else:
                up[x] = y
                out.append(pair)
        left = rest
    number = ids.tolist()
    return [(min(number[q], number[k]), max(number[q], number[k])) for q, k in out], bool(left)


def _grouped(rows: DataFrame, keys: list[str], function, schema: str) -> DataFrame:
    """Rows dealt and sorted by keys; function gets each group's columns. Many small groups cost little this way."""
    names = rows.columns
    target = pa.schema([(f.split()[0], pa.int64()) for f in schema.split(", ")])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            held = yield from give(table, False)
        if held is not None:
            yield from give(held, True)

    def give(table: pa.Table, final: bool):
        at = [table.column(k).to_numpy() for k in keys]
        if not table.num_rows:
            return table
        new = np.flatnonzero(np.any([a[1:] != a[:-1] for a in at], axis=0)) + 1
        cuts = [0, *new.tolist(), table.num_rows]
        out: list[tuple] = []
        for a, b in zip(cuts[: None if final else -1], cuts[1 : None if final else -1], strict=False):
            out += function({n: table.column(n).slice(a, b - a) for n in names})
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=target)
        return table.slice(cuts[-2]).combine_chunks()

    ship_package(rows.sparkSession)
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _search(rows: DataFrame, forests: int) -> DataFrame:
    """a, b: pairs to verify; rows with a null b name a block (its key in a) that has others."""

    def tile(c: dict) -> list[tuple[int, int | None]]:
        number = {k: c[k].to_numpy() for k in ("id", "n", "comp", "side")}
        pairs, more = _search_group(number["id"], number["n"], number["comp"], number["side"], c["vec"].to_pylist(), forests)
        return [*pairs, (c["key"][0].as_py(), None)] if more else pairs

    return _grouped(rows, ["key", "i", "j"], tile, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, comp (the least id reachable) of each id in edges (a, b): alternating large and small stars."""
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def settled(df: DataFrame) -> bool:
        """Whether each id has one edge and none has edges to and from it: stars."""
        ends = df.select(F.col("a").alias("id"), F.lit(1).alias("n")).unionByName(df.select(F.col("b").alias("id"), F.lit(0).alias("n")).distinct())
        return ends.groupBy("id").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).where("n > 1 OR (n > 0 AND rows > n)").isEmpty()

    while not settled(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stage(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select("b", "m").toDF("a", "b").unionByName(least.toDF("a", "b"))
        edges = stage(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "small")
    leaves = edges.groupBy("a").agg(F.min("b").alias("comp")).withColumnRenamed("a", "id")
    return stage(leaves.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct()).groupBy("id").agg(F.min("comp").alias("comp")), "components")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. Each set is sent once for each pair, to the set of the pair's other end.

    a is the centre of its pairs; centres with many go to several tasks, each with the centre's set.
    """
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(STAR)).cast("int").alias("parts"))
    degree = stage(degree, "degree")
    dealt = pairs.join(degree, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("id"))
    wants = dealt.select("id", F.struct(F.col("a"), "part", F.lit(1).alias("side")).alias("to"))
    own = degree.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    wants = wants.unionByName(own.select("id", F.struct("a", "part", F.lit(0).alias("side")).alias("to")))
    targets = bounded(wants.groupBy("id").agg(F.collect_list("to").alias("to")), "targets", 200_000)

    def sets(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column(0), "to": batch.column(1), "s": [shingles(v.as_py()).tobytes() for v in batch.column(2)]}

    kind = "array<struct<a:bigint,part:int,side:int>>"
    found = docs.join(targets, "id").select("id", "to", "text")
    sent = map_arrow(found, sets, f"id bigint, to {kind}, s binary").select("id", "s", F.inline("to"))
    rows = sent.repartition("a", "part").sortWithinPartitions("a", "part", "side", "id")

    def run(batches):
        centre, own = None, None
        for batch in batches:
            a, b = [], []
            key = list(zip(batch.column("a").to_pylist(), batch.column("part").to_pylist(), strict=True))
            for k, side, i, data in zip(key, batch.column("side").to_pylist(), batch.column("id").to_pylist(), batch.column("s"), strict=True):
                s = np.frombuffer(data.as_py(), np.uint64)
                if side == 0:
                    centre, own = k, s
                    continue
                if centre != k:
                    raise ValueError(f"the set of {k[0]} is missing")
                if 100 * min(len(s), len(own)) < 80 * max(len(s), len(own)):
                    continue
                at = np.searchsorted(own, s)
                common = int(np.count_nonzero(own[np.minimum(at, len(own) - 1)] == s))
                if 100 * common >= 80 * (len(s) + len(own) - common):
                    a.append(k[0])
                    b.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.select("a", "part", "side", "id", "s").mapInArrow(run, "a bigint, b bigint")


def _tiles(here: DataFrame, docs: DataFrame, tile: int, turn: int, cross: bool) -> DataFrame:
    """Members of blocks with their points, dealt in tiles; blocks with the same members are taken once.

    cross: every two tiles of a block meet; else each meets the block's least member alone.
    """
    same = here.groupBy("key").agg(F.count("*").alias("size"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sum"), F.min("id").alias("least"), F.max("id").alias("most"))
    one = same.where("size > 1").groupBy("size", "sum", "least", "most").agg(F.min("key").alias("key")).select("key", "size", "least")
    members = here.join(bounded(one, "one"), "key")
    shards = F.ceil(F.col("size") / F.lit(tile)).cast("int")
    rows = members.withColumn("shards", shards).withColumn("mine", F.pmod(F.xxhash64("id", F.lit(turn)), F.col("shards")).cast("int"))
    every = F.sequence(F.lit(0), F.col("shards") - 1)
    if cross:
        rows = rows.withColumn("other", F.explode(every))
        side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    else:
        rows = rows.withColumn("other", F.explode(F.when(F.col("id") == F.col("least"), every).otherwise(F.array("mine")))).withColumn("mine", F.col("other"))
        side = F.lit(0)
    to = F.struct("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "n", "comp", side.alias("side"))
    targets = bounded(rows.groupBy("id").agg(F.collect_list(to).alias("to")), "wanted", 200_000)

    def vectors(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column(0), "to": batch.column(1), "vec": [count_vector(shingles(v.as_py())) for v in batch.column(2)]}

    kind = "array<struct<key:bigint,i:int,j:int,n:bigint,comp:bigint,side:int>>"
    points = map_arrow(docs.join(targets, "id").select("id", "to", "text"), vectors, f"id bigint, to {kind}, vec binary")
    return points.select("id", "vec", F.inline("to"))


def _core(docs: DataFrame, tile: int) -> DataFrame:
    """id, n, comp (the least id reachable) of each row; docs: id, text, with unique ids."""
    base = stage(_base(docs), "base")
    level, hot = _levels(base)
    base = base.where("slice is null").select("id", "n", "digest")
    sets = stage(base.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "sets")
    several = bounded(sets.where("copies > 1").select("digest", "rep"), "several")
    extra = base.where("n > 0").join(several, "digest").where("id <> rep").select("id")
    # A document that repeats another's set has no part in the search; so does one that is too short to have partners.
    out = bounded(extra.unionByName(base.where("n < 4").select("id")).distinct(), "out")
    docs = docs.join(out, "id", "left_anti").select("id", "text")
    blocks = stage(_blocks(docs, level, hot), "blocks")
    release_shuffles(docs.sparkSession)

    here = blocks.where("first").select("key", "id", "n", F.col("id").alias("comp"))
    comps: DataFrame | None = None
    tried: DataFrame | None = None
    turn = 0
    while True:
        found = stage(_search(_tiles(here, docs, tile, turn, cross=turn > 1), 1 if turn < 2 else 8 ** (turn - 1)), "found")
        pairs = found.where("b is not null")
        fresh = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        links = _verified(fresh, docs)
        tried = pairs if tried is None else tried.unionByName(pairs)
        # What is known is carried on as one star for each component.
        if comps is not None:
            links = links.unionByName(comps.where("id <> comp").select(F.col("id").alias("a"), F.col("comp").alias("b")))
        comps = components(links)
        release_shuffles(docs.sparkSession)
        if turn == 0:
            here = blocks
        else:  # blocks with further pairs, and those whose tiles have not met
            again = found.where("b is null").select(F.col("a").alias("key"))
            if turn == 1:
                again = again.unionByName(here.groupBy("key").count().where(F.col("count") > tile).select("key")).distinct()
            here = here.join(bounded(again, "again"), "key")
        here = here.drop("comp").join(bounded(comps, "comps"), "id", "left").select("key", "id", "n", F.coalesce("comp", "id").alias("comp"))
        open_keys = here.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        here = stage(here.join(bounded(open_keys, "keys"), "key"), "open")
        turn += 1
        if here.isEmpty():
            break
    named = sets.join(comps, sets["rep"] == comps["id"], "left").select("digest", F.coalesce("comp", "rep").alias("component"), "copies", "rep")
    named = bounded(named.where("copies > 1 or component <> rep").select("digest", "component"), "named")
    # Without shingles a row is a component of its own.
    named = base.join(named, "digest", "left")
    return named.select("id", "n", F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).alias("comp"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """One row per input row: its id, n_shingles and component_id."""
    rows, row = numbered(df.select(id_col, text_col), id_col)
    found = _core(_id_bytes(rows, row, text_col), tile)
    if row == id_col:
        return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))
    found = stage(found.join(rows.select(F.col(row).alias("id"), F.col(id_col).alias("own")), "id"), "classes")
    least = found.groupBy("comp").agg(F.min("own").alias("component_id"))
    return found.join(least, "comp").select(F.col("own").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """The rows of df without those that another of their component stands for: that with the least id (null: last)."""
    rows, row = numbered(df, id_col)
    found = _core(_id_bytes(rows, row, text_col), tile)
    if row == id_col:
        drop = found.where("id <> comp").select(F.col("id").alias(row))
    else:
        found = stage(found.join(rows.select(F.col(row).alias("id"), F.col(id_col).alias("own")), "id"), "classes")
        order = F.struct(F.col("own").isNull().alias("none"), "own", "id")
        best = found.groupBy("comp").agg(F.min(order).alias("best")).select("comp", F.col("best.id").alias("stays"))
        drop = found.join(best, "comp").where("id <> stays").select(F.col("id").alias(row))
    return rows.join(bounded(drop, "dropped"), row, "left_anti").select(*df.columns)
