"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has 64 bits: bit *b* is set when it is set in over half of the XXH64 values (seed
42) of the text's 4-word shingles, repeats included. Two fingerprints are linked when they
differ in at most ``RADIUS`` bits; components of linked documents are groups of near-duplicates.

Comparison is exact. Distinct fingerprints are dealt to ``RADIUS + 1`` bands of bits: two that
differ in at most RADIUS bits agree on at least one whole band, so only fingerprints with an
equal band value can be linked. What shares a band value is ordered by population count, cut
into tiles, and tile pairs are compared by numpy exclusive-or and bit counts; a tile pair whose
population counts differ by more than the radius is skipped. A band value with more
fingerprints than ``BLOCK`` is banded again by its other bits, of which close fingerprints agree
on a band as well; so the work stays near the number of fingerprints. What still has more than
``BLOCK`` then is split into blocks, and each pair of blocks is a task of its own,
so no group has to fit in one task. A task returns a spanning forest of what it has linked (at
most one row for each fingerprint), never pairs.

Components then come from alternating large-star and small-star steps over that forest, each
written to the shared folder.

Texts are lower-cased in A-Z only; words are maximal runs without 0x20 and 0x09-0x0D. A text of
one to three words is one shingle; a text without words (null, empty, white space) has
fingerprint zero, which is linked like any other. Equal texts are one fingerprint, however
often they occur. A null doc_id never is a component's id unless the component has no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posthorn.llm.arrow import slices, utf8
from posthorn.llm.rows import numbered, row_id
from posthorn.operators.components import connected_components, join_by_key
from posthorn.plans.scratch import materialise

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints of one side of a comparison that a single task holds.
BLOCK = 16_384
#: Rows and columns of a tile.
TILE = 512

_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes) -> int:
    """The fingerprint of one UTF-8 text as an unsigned integer."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    each = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)],
        np.uint64,
    )
    ones = np.unpackbits(each.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.left_shift(np.uint64(1), _BITS[2 * ones > each.size]).sum(dtype=np.uint64))


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        values = np.array([fingerprint(x) for x in utf8(batch.column(batch.num_columns - 1))], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(values.view(np.int64), pa.int64())], [*batch.schema.names[:-1], "fp"]
        )


def fingerprints(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and ``fp``, the fingerprint's 64 bits as a signed long, one row for each row of ``docs``."""
    return hashed(docs.select(*keys, docs[text].cast("string").alias("__text")))


def hashed(picked: DataFrame) -> DataFrame:
    """The columns of ``picked`` with its last one, a text, replaced by ``fp``."""
    kept = picked.schema.fields[:-1]
    names = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(kept))
    plain = picked.toDF(*(f"k{i}" for i in range(len(kept))), "t")
    return plain.mapInArrow(_hash, f"{names}, fp long").toDF(*(f.name for f in kept), "fp")


def _bands(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 bands that cover all 64 bits."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


class _Forest:
    """Union of indices by numpy; every root is the smallest index of its tree."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, i: np.ndarray) -> np.ndarray:
        r = self.parent[i]
        while not np.array_equal(up := self.parent[r], r):
            r = up
        self.parent[i] = r
        return r

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while a.size:
            a, b = self.roots(a), self.roots(b)
            open_ = a != b
            a, b = a[open_], b[open_]
            if a.size:
                np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def link_block(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Links of a block with itself (``right`` is None) or with another block, as a forest.

    Returns two equally long arrays of fingerprints: a member and its tree's root.
    """
    values = left if right is None else np.concatenate((left, right))
    side = np.zeros(values.size, bool)
    if right is not None:
        side[left.size :] = True
    pop = np.bitwise_count(values).astype(np.int16)
    order = np.lexsort((values, pop))
    values, side, pop = values[order], side[order], pop[order]
    forest = _Forest(values.size)
    cuts = range(0, values.size, tile)
    for i in cuts:
        a, most = values[i : i + tile], pop[min(i + tile, values.size) - 1]
        for j in range(i, values.size, tile):
            if pop[j] - most > radius:  # and all later tiles are as far away or farther
                break
            near = np.bitwise_count(a[:, None] ^ values[None, j : j + tile]) <= radius
            if right is not None:
                near &= side[i : i + tile, None] != side[None, j : j + tile]
            x, y = np.nonzero(near)
            x, y = x + i, y + j
            apart = x < y
            if apart.any():
                forest.link(x[apart], y[apart])
    root = forest.roots(np.arange(values.size))
    child = np.flatnonzero(root != np.arange(values.size))
    return values[child], values[root[child]]


def _compare(radius: int, tile: int, n_keys: int):
    """Links within each group of a partition that is sorted by its first ``n_keys`` columns, the last two of which are blocks i and j."""

    def group(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        fp = np.concatenate([r.column(n_keys).to_numpy(zero_copy_only=False) for r in rows]).astype(np.int64).view(np.uint64)
        i, j = (rows[0].column(n_keys - k)[0].as_py() for k in (2, 1))
        if i == j:
            return link_block(fp, None, radius, tile)
        own = np.concatenate([r.column(n_keys + 1).to_numpy(zero_copy_only=False) for r in rows])
        return link_block(fp[own == i], fp[own == j], radius, tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(n_keys)])
            starts = np.concatenate(([0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1, [batch.num_rows]))
            child, root = [], []
            for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False):
                now = tuple(k[:, a].tolist())
                if now != key:
                    if sum(x.num_rows for x in held) > 1:
                        c, r = group(held)
                        child.append(c), root.append(r)
                    held, key = [], now
                held.append(batch.slice(a, b - a))
            yield from out(child, root)
        if sum(x.num_rows for x in held) > 1:
            c, r = group(held)
            yield from out([c], [r])

    def out(child: list[np.ndarray], root: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if child and sum(map(len, child)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x).view(np.int64), pa.int64()) for x in (child, root)], ["src", "dst"]
            )

    return run


def _banded(fp: Column, radius: int) -> Column:
    """Each band with its value and the other bits, moved together: array<struct<band, value, rest>>."""
    out = []
    for n, (at, bits) in enumerate(_bands(radius)):
        low = fp.bitwiseAND(F.lit((1 << at) - 1).cast("long"))
        rest = low if at + bits == 64 else low.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, at + bits), at))
        value = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        out.append(F.struct(F.lit(n).cast("long").alias("band"), value.alias("value"), rest.alias("rest")))
    return F.array(*out)


def _banded_again(rest: Column, radius: int) -> Column:
    """Each band of the other bits as one long that tells it apart: its value and number."""
    out = []
    bits = 64 - min(b for _, b in _bands(radius))
    for n in range(radius + 1):
        at, end = bits * n // (radius + 1), bits * (n + 1) // (radius + 1)
        out.append(F.shiftrightunsigned(rest, at).bitwiseAND(F.lit((1 << (end - at)) - 1).cast("long")) * (radius + 1) + n)
    return F.array(*out)


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """A spanning forest (``src``, ``dst``) of all links among the distinct longs of ``fps``.

    Rows are first counted by band value with partial aggregation. There are less than 41,000 band
    values for a radius of 4, whatever the corpus, so their counts are broadcast.
    """
    first = fps.select("fp", F.explode(_banded(F.col("fp"), radius)).alias("b")).select("fp", "b.*")
    counts = first.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    counts = materialise(counts, "simhash-bands")
    counted = first.join(F.broadcast(counts), ["band", "value"])
    none = F.lit(-1).cast("long")
    small = counted.where(F.col("n") <= block).select("band", "value", none.alias("sub"), "fp", F.lit(1).cast("long").alias("blocks"))
    keys, shared = ["band", "value", "sub"], small
    if (counts.agg(F.max("n")).first()[0] or 0) > block:
        large = counted.where(F.col("n") > block).select("band", "value", F.explode(_banded_again(F.col("rest"), radius)).alias("sub"), "fp")
        again = large.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
        shared = small.unionByName(join_by_key(large, again, keys, "n").withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("long")).drop("n"))
    dealt = shared.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks"))).select(
        *keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"), "own", "fp"
    )
    keyed = dealt.select(*keys, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "own")
    keys += ["i", "j"]
    return (
        keyed.repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(_compare(radius, tile, len(keys)), "src long, dst long")
    )


def groups(fp: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp`` and ``root`` for every distinct fingerprint; equal roots are one component."""
    distinct = materialise(fp.select("fp").distinct(), "simhash-distinct")
    roots = connected_components(links(distinct, radius))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def components(fp: DataFrame, radius: int = RADIUS, key: str = "doc_id") -> DataFrame:
    """The rows of ``fp`` (``key``, ``fp``) with ``component_id``, the smallest key of the component.

    Documents are reduced to one row for each fingerprint before anything is joined. Components of
    many fingerprints and fingerprints of many documents are joined by a broadcast of these few keys, so none is one task.
    """
    by_fp = groups(fp, radius)
    smallest = fp.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("docs"))
    ids = materialise(by_fp.join(smallest, "fp").select("fp", "root", "least", "docs"), "simhash-ids")
    per_root = ids.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = join_by_key(ids, per_root, ["root"], "n").select("fp", "component_id", "docs")
    return join_by_key(fp, named, ["fp"], "docs").drop("docs")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` for every row of ``docs``."""
    fp = materialise(fingerprints(docs, text, (key,)), "simhash")
    return components(fp, radius, key).select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, radius: int = RADIUS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest key.

    Rows are known by their key and a hash of all columns, so equal keys with different texts
    stay apart. Texts are shuffled once: the join with the kept rows and the merging of rows that
    are equal in every column use the same partitioning.
    """
    ident = row_id(docs, key)
    slim = materialise(
        hashed(docs.select(docs[key].alias("k"), ident.alias("id"), docs[text].cast("string").alias("__text"))), "simhash-keep"
    )
    by_fp = groups(slim, radius)
    least = slim.groupBy("fp").agg(F.min(F.struct(F.col("k").isNull(), "k", "id")).alias("least"))
    kept = by_fp.join(least, "fp").groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.id").alias("__id"))
    plain, names = numbered(docs, ident)
    last = names.pop()
    return plain.join(kept, plain[last] == kept["__id"], "left_semi").dropDuplicates([last]).select(*names).toDF(*docs.columns)
