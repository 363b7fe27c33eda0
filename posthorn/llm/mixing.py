"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: the mix has ``share`` times the words of the corpus; sources, in order of their code
points with null last, have the given weights in turn, and a target stops at ``most`` times its
source's size while the excess is shared out again by weight.

Schedule: slot *t* of the mix is the point frac((t + 1) * golden ratio), mapped through the
cumulative shares of the targets to a source. Any stretch of slots holds each source almost in
its exact proportion. A source's documents are shuffled, laid end to end and cut into blocks of
equally many words (the last one may be shorter). Slots are ranked per source; rank *r* takes
block *r*, counting on from the first block again after the last one. The schedule alone decides
what is taken: a source gives a block for each of its slots, which is its target but for a few
blocks (the discrepancy of the points), and no more than ``most`` rounds over its blocks, so a
document gives at most that many times its words. A document has the slots at which the mix
takes its first word; the first of them orders the mixed corpus.

Ranks and positions are prefix sums in two levels (within a chunk of slots or a bucket of the
shuffled order, then over the small table of chunk or bucket totals), so a source with a third
of all rows is never one task. The shuffle is a hash of seed, key and size, so reruns agree.

Words are maximal runs without 0x20 and 0x09-0x0D; a null or blank text has size 0, belongs to
the result and is never taken. A null source is a source. Sources are a table, however
many. Repeated rows are separate rows. A corpus without words has targets of zero. An empty table
gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from posthorn.llm.rows import numbered, row_id
from posthorn.plans.scratch import materialise

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SEED = 20_240_229
#: Words of a block.
BLOCK = 32
#: Slots of a chunk.
CHUNK = 65_536
#: Documents of a bucket of a source's shuffled order, about.
BUCKET = 1_024
#: The golden ratio as a fraction of 2**64: products wrap around, so points are exact for any slot.
_GOLDEN = 0x9E3779B97F4A7C15
#: Sources whose shares a task holds (16 bytes each); for more of them, points and sources are joined.
EDGES = 1_000_000
#: Slots whose documents are one part of an ordered mix, about.
PART = 250_000


def words(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running(table: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``table`` in the given order, with a sum over all rows in front of each row under the keys of ``sums``.

    The sorted table is written once, rows numbered by part; sums are taken within a part and over
    the parts' totals, so no task sees more than a part of it.
    """
    now = materialise(table.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()), name).withColumn("__p", F.shiftright("__m", 33))
    totals = now.groupBy("__p").agg(*(F.sum(c).alias(f"__{k}") for k, c in sums.items()))
    above = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    inside = Window.partitionBy("__p").orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__p", *(F.coalesce(F.sum(f"__{k}").over(above), F.lit(0)).alias(f"__{k}") for k in sums))
    both = now.withColumns({f"__i{k}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()}).join(F.broadcast(before), "__p")
    return both.select(*table.columns, *((F.col(f"__{k}") + F.col(f"__i{k}")).alias(k) for k in sums))


def source_table(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``src``, ``sid`` (its place in the order), ``docs``, ``source_size`` and ``target`` of every source, written once.

    A source is full at its own level, ``most * size / weight`` words for a weight of 1. The water
    level is the one at which the sources below it are full and the others share what is left, so
    sums over the sources in the order of their levels give it, without an iteration.
    """
    own = sized.groupBy(F.col("source").alias("src")).agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    own = running(own, [F.col("src").isNull(), F.col("src")], {"sid": F.lit(1).cast("long")}, "mix-sources")
    full = F.col("source_size") * F.lit(float(most))
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod("sid", F.lit(len(weights))).cast("int"))
    table = materialise(own.withColumn("weight", weight).withColumn("level", full / F.col("weight")), "mix-levels")
    # Sources of one level fill together and are one row here.
    levels = table.where("source_size > 0").groupBy("level").agg(F.sum("weight").alias("w"), F.sum(full).alias("full"))
    every = table.agg(F.sum("source_size").alias("size"), F.sum(F.when(F.col("source_size") > 0, F.col("weight"))).alias("w")).first()
    below = running(levels, [F.col("level")], {"w_below": F.col("w"), "full_below": F.col("full")}, "mix-water")
    water = (F.lit(float(share * (every["size"] or 0))) - F.col("full_below")) / (F.lit(every["w"] or 1.0) - F.col("w_below"))
    lowest = below.select("level", water.alias("water")).where("level >= water").agg(F.min(F.struct("level", "water")).alias("m")).first().m
    goal = full if lowest is None else F.least(full, F.col("weight") * F.lit(lowest.water))
    return materialise(table.select("src", "sid", "docs", "source_size", F.when(F.col("source_size") > 0, goal).otherwise(0.0).alias("target")), "mix-targets")


def _with_sources(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """``rows`` with the columns of their source; adaptive execution splits a hot source if sources are too many for a broadcast."""
    return rows.join(F.broadcast(sources) if few else sources.hint("merge"), rows["source"].eqNullSafe(sources["src"])).drop("src")


def lay_out(sized: DataFrame, sources: DataFrame, few: bool, seed: int = SEED) -> DataFrame:
    """``sized`` with the columns of ``sources`` and ``start``, a document's place in its source's shuffled order."""
    placed = (
        _with_sources(sized, sources, few)
        .withColumn("ord", F.xxhash64(F.lit(seed), "key", "size"))
        .withColumn("bucket", F.pmod(F.shiftright("ord", 20), F.col("buckets")))
    )
    per_bucket = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("sid", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("sid", "bucket").orderBy("ord", "key", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets.hint("merge"), ["sid", "bucket"])
        .withColumn("start", F.col("offset") + F.col("inner"))
        .drop("ord", "bucket", "buckets", "inner", "offset")
    )


def _points(first: int, last: int) -> np.ndarray:
    """The points in [0, 1) of slots first to last - 1."""
    t = np.arange(first + 1, last + 1, dtype=np.uint64) * np.uint64(_GOLDEN)
    return (t >> np.uint64(11)) * 2.0**-53


def slots(sources: DataFrame, number: int, total: float, few: bool) -> tuple[DataFrame, DataFrame]:
    """The slots 0 to ``number`` - 1 and their number by source.

    The first table has ``sid``, ``blocks``, ``slot`` and ``rank`` (among its source's slots), the second ``sid`` and
    ``given``. ``sources`` has ``sid``, ``target`` and ``blocks``; ``total`` is the sum of the targets.
    """
    spark = sources.sparkSession
    if not number:
        return spark.createDataFrame([], "sid long, blocks long, slot long, rank long"), spark.createDataFrame([], "sid long, given long")
    real = sources.where("target > 0").select("sid", "target", "blocks")
    chunks = spark.range(0, math.ceil(number / CHUNK), 1, min(4096, math.ceil(number / CHUNK)))
    size = CHUNK

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for batch in batches:
            for c in batch.column(0).to_pylist():
                yield c, _points(c * size, min(number, (c + 1) * size))

    if few:
        rows = sorted(map(tuple, real.collect()))
        sid, blocks = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
        edges = np.cumsum([r[1] for r in rows])[:-1] / total  # the last one is 1

        def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for c, x in each(batches):
                at, n = np.unique(np.searchsorted(edges, x, side="right"), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(sid[at]), pa.array(np.full(at.size, c)), pa.array(n)], ["sid", "chunk", "n"])

        def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for c, x in each(batches):
                at = np.searchsorted(edges, x, side="right")
                order = np.argsort(at, kind="stable")
                at = at[order]
                r = np.arange(at.size) - np.searchsorted(at, at)  # a source's slots of this chunk, in their order
                columns = [sid[at], blocks[at], np.full(at.size, c), order + c * size, r]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["sid", "blocks", "chunk", "slot", "r"])

        per_chunk = chunks.mapInArrow(counts, "sid long, chunk long, n long")
        drawn = chunks.mapInArrow(ranks, "sid long, blocks long, chunk long, slot long, r long")
    else:
        # As many cells of [0, 1) as sources: a source is in each cell that it touches, so a point meets two of them on average.
        # Shares and points are whole numbers of 2**-53, so the intervals of the sources leave nothing out.
        last = real.agg(F.count("*").alias("n"), F.max("sid").alias("sid")).first()
        cell = lambda v: F.floor(v / F.lit(2.0**53) * last.n)
        share = F.floor(F.col("target") / F.lit(total) * F.lit(2.0**53))
        spans = running(real.withColumn("share", share), [F.col("sid")], {"low": F.col("share")}, "mix-edges")
        spans = spans.withColumn("high", F.when(F.col("sid") == last.sid, F.lit(2**53)).otherwise(F.col("low") + F.col("share")))
        spans = spans.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))

        def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for c, x in each(batches):
                columns = [np.full(x.size, c), np.arange(x.size) + c * size, (x * 2.0**53).astype(np.int64)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["chunk", "slot", "x"])

        drawn = (
            chunks.mapInArrow(points, "chunk long, slot long, x long").withColumn("cell", cell(F.col("x")))
            .join(spans.hint("merge"), "cell").where("x >= low AND x < high")
            .withColumn("r", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1)
        )
        per_chunk = drawn.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    per_chunk = materialise(per_chunk, "mix-chunks")
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select("sid", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # Both sides grow with the corpus, and slots compress so well that their size would let them be broadcast.
    ranked = drawn.join(offsets.hint("merge"), ["sid", "chunk"]).select("sid", "blocks", "slot", (F.col("r") + F.col("offset")).alias("rank"))
    return ranked, per_chunk.groupBy("sid").agg(F.sum("n").alias("given"))


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", mark: Column | None = None) -> DataFrame:
    """``key``, ``source``, ``size``, ``mark`` and a row number, written once; the texts are not needed any more."""
    return materialise(
        docs.select(
            docs[key].alias("key"), docs[source].cast("string").alias("source"), words(docs[text]).alias("size"),
            (F.lit("") if mark is None else mark).alias("mark"), F.monotonically_increasing_id().alias("row"),
        ),
        "mix-sizes",
    )


def mix(
    sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = SEED, edges: int = EDGES,
) -> DataFrame:
    """What the mix takes of each document of ``measured``.

    Adds ``source_size``, ``target``, ``taken`` (words, repeats counted), ``slots`` (those at
    which the mix takes the document's first word, at most ``most`` of them, in order) and ``copies``, their number.
    """
    found = source_table(sized, weights, share, most)
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    buckets = F.greatest(F.lit(1).cast("long"), F.floor(F.col("docs") / BUCKET))
    sources = found.select("src", "sid", "source_size", "target", blocks.alias("blocks"), buckets.alias("buckets"))
    every = found.agg(F.count("*").alias("n"), F.sum("target").alias("total")).first()
    few, total = every.n <= edges, every.total or 0.0
    ranked, given = slots(sources, math.ceil(total / block), total, few)
    most_ranks = F.floor(F.col("blocks") * F.lit(float(most)))
    at = (
        ranked.where(F.col("rank") < most_ranks).groupBy("sid", F.pmod("rank", "blocks").alias("block"))
        .agg(F.array_sort(F.collect_list("slot")).alias("slots"))  # one for each round
    )
    # Ranks have no gaps: a source's blocks are all taken ``rounds`` times, and those of its first ``more`` words once again.
    n = F.least(F.coalesce("given", F.lit(0)), most_ranks)
    rounds = F.when(F.col("blocks") > 0, F.floor(n / F.col("blocks"))).otherwise(0)
    table = sources.join(given, "sid", "left").withColumn("rounds", rounds).withColumn("more", (n - F.col("rounds") * F.col("blocks")) * block)
    laid = lay_out(sized, materialise(table.drop("blocks", "given"), "mix-rounds"), few, seed)
    again = F.greatest(F.lit(0), F.least("size", F.col("more") - F.col("start")))
    # The block where a document begins; documents without words meet none, and are dealt evenly.
    first = F.when(F.col("size") > 0, F.floor(F.col("start") / block)).otherwise(-1 - F.pmod("row", F.lit(4096)))
    return (
        laid.withColumn("taken", (F.col("rounds") * F.col("size") + again).cast("long")).withColumn("block", first)
        .join(at.hint("merge"), ["sid", "block"], "left")
        .select("row", "key", "mark", "source", "size", "source_size", "target", "taken", F.coalesce("slots", F.array().cast("array<bigint>")).alias("slots"))
        .withColumn("copies", F.size("slots").cast("long"))
    )


def mixed_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", slot: str | None = None, ordered: bool = False, **options
) -> DataFrame:
    """The rows of ``docs`` that the mix takes, once for each of their slots.

    ``slot`` names a column for the slot. ``ordered`` puts the rows in the order of their slots, within and across
    partitions, so that what is written or read in that order holds the sources in their proportions everywhere.
    """
    ident = row_id(docs, key)
    plan = mix(measured(docs, key, text, source, ident), **options)
    plan = materialise(plan.select(F.col("mark").alias("__id"), F.explode("slots").alias("__slot")), "mix-plan")
    plain, names = numbered(docs, ident)
    last = names.pop()
    # Rows that are equal in every column are one row with the slots of all of them.
    once = plain.dropDuplicates([last])
    out = once.join(plan.hint("merge"), once[last] == plan["__id"])
    if ordered:
        end = (plan.agg(F.max("__slot")).first()[0] or 0) + 1
        parts = math.ceil(end / PART)
        out = out.repartitionById(parts, F.floor(F.col("__slot") * parts / end).cast("int")).sortWithinPartitions("__slot")
    out = out.select(*names, "__slot").toDF(*docs.columns, slot or "__slot")
    return out if slot else out.drop("__slot")
