"""Line items of mails and tables.

Rows of tables, numbered lists and quantity blocks are read line by line by Column expressions;
attachment tables have their columns found by header or by voting on the first rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posthorn.functions.text import UNITS

_UNIT = "|".join(sorted(UNITS, key=len, reverse=True))
_CODE = r"(?=[A-Z0-9./-]*[0-9])[A-Z0-9][A-Z0-9./-]{2,}"
#: A numbered or plain line: an article, a description and a quantity with a unit.
_ITEM = rf"(?iu)^\s*(?:[0-9]{{1,3}}[.)]\s+)?({_CODE})\s+(?:(.*?)\s*[-–:,]?\s*)?([0-9]+(?:[.,][0-9]+)?)\s*({_UNIT})?\.?\s*$"
#: A line of free text that ends in a quantity.
_FREE = rf"(?iu)^\s*(?:[0-9]{{1,3}}[.)]\s+|[-•*]\s+)?(\p{{L}}.{{4,80}}?)\s*[-–:,]?\s+([0-9]+(?:[.,][0-9]+)?)\s*({_UNIT})\.?\s*$"
#: Free-text items of a mail.
MAX_FREE = 30


def _number(c: Column) -> Column:
    return F.try_to_number(F.replace(c, F.lit(","), F.lit(".")), F.lit("999999999.999")).cast("double")


def _unit(c: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))
    return F.coalesce(F.element_at(table, F.lower(c)), F.lit("pcs"))


def line_items(body: Column) -> Column:
    """array<struct<article, quantity, unit, description, source, line>> of the lines that name an article.

    Tab-separated rows and lists are the same to the pattern, as tabs count as white space.
    """
    lines = F.split(F.coalesce(body, F.lit("")), r"\r?\n", -1)
    hits = F.filter(F.transform(lines, lambda l: F.trim(l)), lambda l: F.regexp_like(l, F.lit(_ITEM)))
    pick = lambda l, n: F.regexp_extract(l, _ITEM, n)
    return F.transform(
        hits,
        lambda l: F.struct(
            F.upper(pick(l, 1)).alias("article"), _number(pick(l, 3)).alias("quantity"), _unit(pick(l, 4)).alias("unit"),
            F.nullif(F.trim(pick(l, 2)), F.lit("")).alias("description"), F.lit("body").alias("source"), l.alias("line"),
        ),
    )


def free_text_items(body: Column) -> Column:
    """Items without an article get a code made of their description; at most MAX_FREE of a mail, as the feature has it."""
    lines = F.transform(F.split(F.coalesce(body, F.lit("")), r"\r?\n", -1), lambda l: F.trim(l))
    hits = F.filter(lines, lambda l: F.regexp_like(l, F.lit(_FREE)) & ~F.regexp_like(l, F.lit(_ITEM)))
    pick = lambda l, n: F.regexp_extract(l, _FREE, n)
    code = lambda d: F.concat(F.lit("DESC:"), F.regexp_replace(F.upper(d), r"[^\p{L}0-9]+", "-"))
    each = F.transform(
        hits,
        lambda l: F.struct(code(pick(l, 1)).alias("article"), _number(pick(l, 2)).alias("quantity"), _unit(pick(l, 3)).alias("unit"), pick(l, 1).alias("description"), F.lit("free_text").alias("source"), l.alias("line")),
    )
    return F.slice(each, 1, MAX_FREE)


#: Header words of the columns of an attachment table. Fixed values.
HEADERS = {
    "article": r"(?i)^(article|sku|code|part ?n|артикул|код)",
    "quantity": r"(?i)^(qty|quantity|amount|кол)",
    "unit": r"(?i)^(unit|uom|ед)",
    "description": r"(?i)^(name|description|product|наименование|описание)",
}
_IS_CODE, _IS_NUMBER = re.compile(rf"^{_CODE}$", re.IGNORECASE), re.compile(r"^\d+([.,]\d+)?$")


def table_items(rows: list[list[str]]) -> list[dict]:
    """Items of one table: columns by their header, else by voting on up to five rows."""
    places: dict[str, int] = {}
    start = 0
    for n, row in enumerate(rows[:10]):
        found = {name: i for name, p in HEADERS.items() for i, cell in enumerate(row) if re.match(p, cell.strip())}
        if len(found) >= 2:
            places, start = found, n + 1
            break
    if not places and rows:
        width = max(map(len, rows))
        votes = lambda test: [sum(bool(test(r[i].strip())) for r in rows[:5] if i < len(r)) for i in range(width)]
        number, code = votes(_IS_NUMBER.match), votes(lambda s: _IS_CODE.match(s) and not _IS_NUMBER.match(s))
        if max(code, default=0):
            places["article"] = code.index(max(code))
        if max(number, default=0):
            places["quantity"] = max(i for i, v in enumerate(number) if v == max(number))
        words = votes(lambda s: len(s.split()) > 1)
        if max(words, default=0):
            places["description"] = words.index(max(words))
    out = []
    for row in rows[start:]:
        cell = {k: row[i].strip() if i < len(row) else "" for k, i in places.items()}
        if cell.get("article"):
            quantity = cell.get("quantity", "").replace(",", ".")
            out.append({"article": cell["article"].upper(), "quantity": float(quantity) if _IS_NUMBER.match(quantity) else None, "unit": UNITS.get(cell.get("unit", "").lower(), "pcs"), "description": cell.get("description") or None})
    return out


def attachment_items(texts: DataFrame) -> DataFrame:
    """E29 for a table of attachment texts (path, text): one row for each item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (p, i["article"], i["quantity"], i["unit"], i["description"])
                for p, t in zip(pdf["path"], pdf["text"], strict=True)
                for i in table_items([re.split(r"\t|;", x) for x in (t or "").split("\n") if x.strip()])
            ]
            yield pd.DataFrame(rows, columns=["path", "article", "quantity", "unit", "description"])

    return texts.select("path", "text").mapInPandas(run, "path string, article string, quantity double, unit string, description string")
