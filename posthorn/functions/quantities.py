"""Quantities that are counts, and what only looks like one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_N = r"\d+(?:[.,]\d+)?"
#: What a number with a unit is if it is no count, in the order in which it is tried. Fixed values.
TECHNICAL: tuple[tuple[str, str], ...] = (
    ("dimension", rf"(?iu)^(?:{_N}\s*(?:mm|мм|cm|см|m|м|ft|in|inch|\"|')$|(?:DN|Ду|DU)\s*\d+)"),
    ("weight", rf"(?iu)^{_N}\s*(?:кг|kg|г|g|т|tons?|lbs?|gram|грамм|тонн)\s*\.?$"),
    ("power", rf"(?iu)^{_N}\s*(?:W|Вт|kW|кВт|мВт|mW|л\.?\s*с\.?|hp)\s*\.?$"),
    ("voltage", rf"(?iu)^{_N}\s*(?:V|В|kV|кВ|mV|мВ|VDC|VAC)\s*\.?$"),
    ("pressure", rf"(?iu)^{_N}\s*(?:bars?|МПа|МРа|mpa|kpa|кПа|Pa|Па|atm|атм|psi|бар)\s*\.?$"),
    ("frequency", r"(?iu)^\d+(?:\s*/\s*\d+)?\s*(?:Hz|Гц|kHz|кГц|MHz|МГц)\s*\.?$"),
    ("rpm", rf"(?iu)^{_N}\s*(?:rpm|об/мин|min-?1|мин-?1)\s*\.?$"),
    ("temperature", rf"(?iu)^-?{_N}\s*°?\s*(?:C|F|К|Цельсия)\s*\.?$"),
    ("date", r"^(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{1,2}-\d{1,2})$"),
    ("phone", r"(?:\+\d[\d\s\-()]{6,}|\(\d{3,4}\)\s*\d|(?<!\w)\d{2,4}[\s\-]\d{2,4}[\s\-]\d{2,4}(?:[\s\-]\d{2,4})?(?!\w))"),
    ("hours", r"\d{1,2}[.:]\d{2}\s*[-–—]\s*\d{1,2}[.:]\d{2}"),
)
#: Units of counts and their common form. Fixed values.
COUNT_UNITS = {"шт": "шт", "штук": "шт", "pcs": "шт", "pc": "шт", "компл": "компл", "комплект": "компл", "к-т": "компл", "пар": "пар", "уп": "уп", "упак": "уп", "рул": "рул", "бух": "бух", "ед": "ед"}
_UNIT = r"(штук|шт|pcs|pc|комплект|компл|к-т|пар|упак|уп|рул|бух|ед)[а-яё]*"


def technical_reason(value: Column) -> Column:
    """Why a number with what follows it is no count, or null. A phone has seven digits or more."""
    v = F.trim(F.coalesce(value, F.lit("")))
    enough = F.length(F.regexp_replace(v, r"\D", "")) >= 7
    out = F.when(F.lit(False), "")
    for name, pattern in TECHNICAL:
        out = out.when(v.rlike(pattern) & (enough if name == "phone" else F.lit(True)), name)
    return out


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def _unit(c: Column) -> Column:
    table = F.create_map(*(F.lit(x) for p in COUNT_UNITS.items() for x in p))
    return F.try_element_at(table, F.lower(c))


def stated(line: Column, article: Column | None = None) -> Column:
    """struct<quantity, unit, how> of a line, or null: packs (``2 компл по 5 шт``), the number behind the line's
    article (``9226513-4 шт``), a label (``кол-во: 10``), a number with a unit of count. The first of these decides."""
    say = lambda q, u, how: F.struct(q.alias("quantity"), u.alias("unit"), F.lit(how).alias("how"))
    text = F.coalesce(line, F.lit(""))
    pack = rf"(?iu)(\d+)\s*{_UNIT}\s+по\s+(\d+)\s*(?:{_UNIT})?"
    part = lambda p, g: F.regexp_extract(text, p, g)
    out = F.when(text.rlike(pack), say(_number(part(pack, 1)) * _number(part(pack, 3)), F.coalesce(_unit(F.nullif(part(pack, 4), F.lit(""))), F.lit("шт")), "pack"))
    if article is not None:
        rest = F.trim(F.substring(text, F.instr(text, article) + F.length(article), F.length(text)))
        bound = rf"(?iu)^[-–—]\s*({_N})\s*{_UNIT}"
        out = out.when((F.length(F.coalesce(article, F.lit(""))) > 0) & F.contains(text, article) & rest.rlike(bound), say(_number(F.regexp_extract(rest, bound, 1)), _unit(F.regexp_extract(rest, bound, 2)), "article"))
    label = rf"(?iu)(?:кол(?:ичеств[оаеу]|-?в[оеау]|\.)?|quantity|qty)\s*[:=]?\s*({_N})\s*(?:{_UNIT})?"
    out = out.when(text.rlike(label), say(_number(part(label, 1)), F.coalesce(_unit(F.nullif(part(label, 2), F.lit(""))), F.lit("шт")), "label"))
    plain = rf"(?iu)(?:^|[^\d.,])({_N})\s*{_UNIT}(?![A-Za-z])"
    return out.when(text.rlike(plain), say(_number(part(plain, 1)), _unit(part(plain, 2)), "unit"))
