"""The product catalogue: rollup of import rows, brand aliases, brand spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from posthorn.plans.scratch import materialise

SYNONYMS, DEALS = 12, 20


def article_key(c: Column) -> Column:
    """Letters and digits in upper case."""
    return F.upper(F.regexp_replace(c, "[^A-Za-zА-ЯЁа-яё0-9]+", ""))


def _first_few(rows: DataFrame, column: str, name: str, n: int) -> DataFrame:
    """The ``n`` smallest distinct values of each article. Ranks up to ``n`` are cut before the shuffle, so a hot article sends few rows."""
    once = rows.where(F.col(column).isNotNull()).select("key", column).distinct()
    rank = F.row_number().over(Window.partitionBy("key").orderBy(column))
    return once.withColumn("rank", rank).where(F.col("rank") <= n).groupBy("key").agg(F.array_sort(F.collect_list(column)).alias(name))


def rollup(rows: DataFrame) -> DataFrame:
    """One catalogue row for each normalised article.

    Input: article, brand, product_name, synonym, deal_id, quantity, price. Prices count if
    positive; the longest name wins, the first one of equally long ones.
    """
    price = F.when(F.col("price") > 0, F.col("price"))
    longest = F.max_by("product_name", F.struct(F.length("product_name"), "product_name"))
    # Three aggregates read it: what ``rows`` is made of is computed once.
    keyed = materialise(rows.withColumn("key", article_key(F.col("article"))), "catalogue")
    totals = keyed.groupBy("key").agg(
        F.count("*").alias("source_rows"),
        F.round(F.sum("quantity"), 3).alias("total_quantity"),
        F.min(F.nullif(F.trim("brand"), F.lit(""))).alias("brand"),
        longest.alias("product_name"),
        F.round(F.min(price), 2).alias("min_price"),
        F.round(F.max(price), 2).alias("max_price"),
        F.round(F.avg(price), 2).alias("avg_price"),
    )
    joined = totals.join(_first_few(keyed, "synonym", "synonyms", SYNONYMS), "key", "left").join(_first_few(keyed, "deal_id", "deals", DEALS), "key", "left")
    return joined.withColumnRenamed("key", "article")


def brand_aliases(lines: DataFrame, name: str = "line") -> DataFrame:
    """``canonical`` and the aliases of a brand line: spellings, parts around separators and brackets, a slug, a long first word."""
    c = F.trim(F.col(name))
    outer = F.trim(F.regexp_replace(c, r"\s*\([^)]*\)", ""))
    inner = F.trim(F.regexp_extract(c, r"\(([^)]*)\)", 1))
    first = F.split(outer, r"\s+")[0]
    all_ = F.concat(
        F.array(c, F.lower(c), F.upper(c), outer, inner, F.regexp_replace(F.lower(outer), "[^a-z0-9]+", "-"), F.when(F.length(first) >= 4, first)),
        F.transform(F.split(outer, r"\s*[/|,]\s*"), lambda a: F.trim(a)),
    )
    kept = F.filter(F.array_distinct(all_), lambda a: a.isNotNull() & (a != ""))
    return lines.where(c != "").select(c.alias("canonical"), F.explode(kept).alias("alias")).distinct()


def representative(forms: DataFrame, name: str = "brand") -> DataFrame:
    """Spellings by their key and the best one: mixed case before lower before upper, shorter before longer."""
    f = F.col(name)
    score = F.when((f != F.upper(f)) & (f != F.lower(f)), 10).when(f == F.lower(f), 3).otherwise(1) - 0.01 * F.length(f)
    return forms.groupBy(F.lower(F.regexp_replace(f, "[^A-Za-z0-9А-Яа-яЁё]+", "")).alias("key")).agg(F.max_by(f, F.struct(score, f)).alias("shown"), F.count("*").alias("n"))
