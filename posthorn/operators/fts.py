"""Full-text search: an inverted index as a table, prefix AND queries and weighted BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posthorn.plans.scratch import materialise

K1, B = 1.2, 0.75
#: Weights of the catalogue's columns. Fixed values.
CATALOGUE_WEIGHTS = {"article": 1.0, "brand": 1.2, "product_name": 1.5, "description": 0.8, "synonyms": 0.6}


def index(docs: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """``key``, ``token``, ``tf`` (weighted by field): rebuild it whenever ``docs`` changes."""
    each = None
    for field, weight in weights.items():
        words = F.split(F.lower(F.coalesce(F.col(field).cast("string"), F.lit(""))), "[^a-z0-9]+")
        one = docs.select(F.col(key), F.explode(F.filter(words, lambda w: w != "")).alias("token"), F.lit(weight).alias("w"))
        each = one if each is None else each.unionByName(one)
    return each.groupBy(key, "token").agg(F.sum("w").alias("tf"))


def stored(index: DataFrame) -> DataFrame:
    """An index written once, sorted by token, so that a query reads the row groups of its terms only."""
    return materialise(index.repartition("token").sortWithinPartitions("token"), "fts")


def terms(query: str) -> list[str]:
    """The words of a query; everything else is a separator."""
    return [t for t in "".join(c if c.isalnum() else " " for c in query.lower()).split() if t]


def prefix_and(index: DataFrame, query: str) -> DataFrame:
    """Keys with a token for every term's prefix; the prefixes are pushed into the index's scan."""
    wanted = terms(query)
    key = index.columns[0]
    if not wanted:
        return index.select(key).distinct()
    hit = F.lit(False)
    for t in wanted:
        hit = hit | F.startswith("token", F.lit(t))
    has = [F.max(F.startswith("token", F.lit(t)).cast("int")) for t in wanted]
    return index.where(hit).groupBy(key).agg(sum(has[1:], has[0]).alias("n")).where(F.col("n") == len(wanted)).select(key)


def bm25(index: DataFrame, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """``key`` and ``score`` of documents with any of the terms.

    Lengths and document frequencies are aggregates of the index; only the postings of the terms
    are joined with them, and two scalars (documents and mean length) are subqueries.
    """
    key = index.columns[0]
    lengths = index.groupBy(key).agg(F.sum("tf").alias("dl"))
    total = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    wanted = index.where(F.col("token").isin(terms(query)))
    df = wanted.groupBy("token").agg(F.count("*").alias("df"))
    n, avgdl = total.select("n").scalar(), total.select("avgdl").scalar()
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    return wanted.join(df, "token").join(lengths, key).groupBy(key).agg(F.sum(part).alias("score"))
