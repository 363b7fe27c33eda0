"""Rows known by one column, so that joins and deduplication share a partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def fingerprint(docs: DataFrame) -> Column:
    """128 bits of all columns as a text: rows differ in it if they differ in any column, also in where a null is.

    Hash functions of Spark skip nulls, so each column goes in with a flag that says whether it is one; nested
    columns, whose own nulls would be skipped as well, and maps, which can't be hashed, go in as JSON.
    """
    parts: list[Column] = []
    for field in docs.schema.fields:
        c = docs[field.name]
        if isinstance(field.dataType, (ArrayType, MapType, StructType)):
            c = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
        parts += [c.isNull(), c]
    return F.concat_ws(".", F.xxhash64(F.lit(1), *parts).cast("string"), F.xxhash64(F.lit(2), *parts).cast("string"))


def row_id(docs: DataFrame, key: str) -> Column:
    """A text that is equal for rows that are equal in every column: the key (nulls told apart) and their fingerprint.

    It is never null, so a join needs no null-safe comparison, and what is hashed by it for a join
    needs no other exchange to be made distinct.
    """
    own = F.coalesce(F.concat(F.lit("="), docs[key].cast("string")), F.lit(""))
    return F.concat_ws("#", fingerprint(docs), own)


def numbered(docs: DataFrame, *more: Column) -> tuple[DataFrame, list[str]]:
    """``docs`` and ``more`` columns over it as c0, c1, ..., whatever the columns are called, and these names."""
    names = [f"c{i}" for i in range(len(docs.columns) + len(more))]
    return docs.select("*", *more).toDF(*names), names
