"""Brand detection by a dictionary.

Texts become words with positions; aliases of one word are found by an equi-join, longer ones
by a join on their first word and a comparison of what follows. Long lists of brands, which are
catalogues and not requests, are found as islands of mentions and removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from posthorn.functions.arrays import before, let

#: Words that are aliases of some brand and nearly always something else. Fixed values.
FALSE_POSITIVES = ("the", "for", "new", "plus", "pro", "air", "set")
GAP, CLUSTER = 18, 10


def mentions(docs: DataFrame, aliases: DataFrame, key: str, text: str) -> DataFrame:
    """(key, canonical, alias, pos, ends): every alias in every text; positions are characters from 0.

    ``aliases`` has canonical and alias. Words are ASCII letters and digits, so a boundary is any
    other character. A word is joined with the aliases that begin with it and carries only as much
    of the text behind it as the longest alias has words, never the text itself.
    """
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", " ")
    low = F.lower(clean)
    a = aliases.select("canonical", F.lower("alias").alias("alias"), F.regexp_extract(F.lower("alias"), "[a-z0-9]+", 0).alias("word")).where(
        ~F.lower("alias").isin(*FALSE_POSITIVES) & (F.col("word") != "")
    ).distinct()
    ahead = a.agg(F.max(F.size(F.regexp_extract_all("alias", F.lit("[a-z0-9]+"), F.lit(0))))).first()[0] or 1
    gaps, words = F.split(low, "[a-z0-9]+", -1), F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))

    def placed(g: Column, w: Column) -> Column:
        """Each word with its place and the words and gaps from it on; ``g`` has one gap more than there are words."""
        lengths = F.zip_with(F.slice(g, F.lit(1), F.size(w)), w, lambda x, y: F.length(x) + F.length(y))
        follows = F.zip_with(w, F.slice(g, F.lit(2), F.size(w)), lambda x, y: F.concat(x, F.coalesce(y, F.lit(""))))
        pos = F.zip_with(before(lengths, lambda x, y: x + y), F.slice(g, F.lit(1), F.size(w)), lambda x, y: x + F.length(y))
        return F.transform(w, lambda x, i: F.struct(F.get(pos, i).alias("pos"), x.alias("word"), F.array_join(F.slice(follows, i + 1, F.lit(ahead + 1)), "").alias("tail")))

    each = docs.select(F.col(key), F.explode(let(gaps, lambda g: let(words, lambda w: placed(g, w)))).alias("p")).select(key, "p.*")
    after = F.substring(F.col("tail"), F.length("alias") + 1, F.lit(1))
    return each.join(a, "word").where(F.startswith("tail", F.col("alias")) & ~after.rlike("^[a-z0-9]")).select(key, "canonical", "alias", "pos", (F.col("pos") + F.length("alias")).alias("ends"))


def without_clusters(found: DataFrame, key: str, gap: int = GAP, most: int = CLUSTER) -> DataFrame:
    """Without the brands that only occur within runs of ``most`` or more distinct brands."""
    w = Window.partitionBy(key).orderBy("pos", "ends", "canonical")
    far = F.when(F.col("pos") - F.lag("ends").over(w) <= gap, 0).otherwise(1)
    island = found.withColumn("far", far).withColumn("island", F.sum("far").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("far")
    size = island.groupBy(key, "island").agg(F.count_distinct("canonical").alias("kinds"))
    return island.join(size, [key, "island"]).where(F.col("kinds") < most).select(key, "canonical").distinct()


def detect(docs: DataFrame, aliases: DataFrame, own: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The brands of each text; where a brand of the project itself is found, all others are dropped."""
    found = without_clusters(mentions(docs, aliases, key, text), key).join(own.select("canonical", F.lit(True).alias("own")).distinct(), "canonical", "left")
    any_own = found.groupBy(key).agg(F.bool_or(F.coalesce("own", F.lit(False))).alias("any_own"))
    return found.join(any_own, key).where(~F.col("any_own") | F.coalesce("own", F.lit(False))).select(key, "canonical")


def infer(evidence: DataFrame, least: int = 3) -> DataFrame:
    """The brand with the most votes of a message, if it has ``least``. Input: message, brand, score."""
    votes = evidence.groupBy("message", "brand").agg(F.sum("score").alias("votes")).where(F.col("votes") >= least)
    return votes.groupBy("message").agg(F.min_by("brand", F.struct(-F.col("votes"), F.col("brand"))).alias("brand"), F.max("votes").alias("votes"))
