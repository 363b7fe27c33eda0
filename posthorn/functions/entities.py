"""Entities by zone: candidates with confidences, the best one and its alternate.

All extractors have one shape: every zone of a mail offers candidates with the zone's base
confidence, rejected ones carry a reason, and the best candidate is the one with the highest
confidence, the earliest zone first among equals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from posthorn.functions import text as T

#: Base confidences by zone, in the order of the zones. Fixed values.
BASE: dict[str, dict[str, float]] = {
    "phone": {"form": 0.95, "signature": 0.9, "body": 0.8, "contact": 0.75, "company": 0.6, "quoted": 0.55, "footer": 0.4, "header": 0.35},
    "email": {"header": 0.9, "signature": 0.6, "body": 0.5},
    "company": {"form": 0.9, "signature": 0.85, "body": 0.8, "sender": 0.7, "domain": 0.35},
    "person": {"form": 0.9, "signature": 0.85, "body": 0.8, "sender": 0.75, "local": 0.45},
    "position": {"form": 0.95, "signature": 0.9, "body": 0.8, "sender": 0.6},
}
#: Words that make a candidate something else. Fixed values.
DEPARTMENTS = r"(?iu)^(sales|purchasing|accounting|support|отдел|бухгалтерия|служба)(?![\p{L}\d_])"
NO_PERSON = r"(?iu)(regards|dear|hello|company|street|request|order|уважением|добрый|заявка)"
NO_COMPANY = r"(?iu)^(re|fwd?|dear|order|request|invoice|заявка|заказ)(?![\p{L}\d_])"
GENERIC_BRANDS = ("other", "various", "original", "analog", "no name", "аналог")


def candidates(kind: str, zones: dict[str, Column], values: Callable[[Column], Column], reject: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<value, confidence, zone, seq, reason>> of all zones; ``values`` maps a text to an array."""
    parts = []
    for seq, (zone, base) in enumerate(BASE[kind].items()):
        if zone in zones:
            why = reject or (lambda v: F.lit(None).cast("string"))
            parts.append(_zone(values(F.coalesce(zones[zone], F.lit(""))), base, zone, seq, why))
    return F.concat(*parts)


def _zone(values: Column, base: float, zone: str, seq: int, why: Callable[[Column], Column]) -> Column:
    def one(v: Column, i: Column) -> Column:
        return F.struct(
            v.alias("value"), F.lit(base).alias("confidence"), F.lit(zone).alias("zone"), (F.lit(seq * 1000) + i).alias("seq"), why(v).alias("reason")
        )

    return F.transform(values, one)


def ranked(found: Column) -> Column:
    """Accepted candidates, the best first: W1."""
    kept = F.filter(found, lambda c: c["reason"].isNull())
    keyed = F.transform(kept, lambda c: F.struct((-c["confidence"]).alias("o"), c["seq"].alias("seq"), c["value"].alias("value"), c["confidence"].alias("confidence"), c["zone"].alias("zone")))
    return F.array_sort(keyed)


def best(found: Column) -> Column:
    """The best candidate and the next one with another value."""
    order = ranked(found)
    first = F.get(order, F.lit(0))
    other = F.get(F.filter(order, lambda c: c["value"] != first["value"]), F.lit(0))
    return F.struct(first["value"].alias("value"), first["confidence"].alias("confidence"), first["zone"].alias("zone"), other["value"].alias("alternate"))


def _one(c: Column) -> Column:
    return F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))


def find_phone(zones: dict[str, Column]) -> Column:
    """E7-E9."""
    shape = r"\+?[0-9][0-9 ()./-]{5,18}[0-9]"
    written = lambda t: F.regexp_extract_all(t, F.lit(shape), F.lit(0))
    found = candidates("phone", zones, written, T.phone_reject)
    return best(F.transform(found, lambda c: c.withField("value", F.coalesce(T.normal_phone(c["value"]), c["value"]))))


def find_email(zones: dict[str, Column]) -> Column:
    """Generic and service addresses are held to a confidence of 0.4."""
    found = candidates("email", zones, T.emails)
    capped = lambda c: F.when(T.local_kind(c["value"]).isin("generic", "service"), F.least(c["confidence"], F.lit(0.4))).otherwise(c["confidence"])
    return best(F.transform(found, lambda c: c.withField("confidence", capped(c))))


def find_company(zones: dict[str, Column]) -> Column:
    """Names with a legal form; a domain's label is the last resort."""
    named = {k: v for k, v in zones.items() if k != "domain"}
    reject = lambda v: F.when(F.length(v) < 2, "short").when(v.rlike(NO_COMPANY), "not a company").when(v.rlike(DEPARTMENTS), "department")
    found = candidates("company", named, lambda t: _one(T.company(t)), reject)
    if "domain" in zones:
        label = F.initcap(F.substring_index(zones["domain"], ".", 1))
        found = F.concat(found, candidates("company", {"domain": zones["domain"]}, lambda t: F.when(t != "", F.array(label)).otherwise(F.array().cast("array<string>"))))
    return best(found)


def find_person(zones: dict[str, Column]) -> Column:
    """E14, E15."""
    reject = lambda v: F.when(v.rlike(NO_PERSON), "not a person").when(v.rlike("[0-9]"), "digits")
    named = {k: v for k, v in zones.items() if k != "local"}
    found = candidates("person", named, lambda t: _one(T.person(t)), reject)
    if "local" in zones:
        name = F.initcap(F.translate(zones["local"], "._", "  "))
        found = F.concat(found, candidates("person", {"local": zones["local"]}, lambda t: F.when(t.rlike("^[a-z]+[._][a-z]+$"), F.array(name)).otherwise(F.array().cast("array<string>"))))
    return best(found)


def find_position(zones: dict[str, Column]) -> Column:
    """A role; its department is split off by ``department_of``."""
    return best(candidates("position", zones, lambda t: _one(T.position(t)), lambda v: F.when(v.rlike(DEPARTMENTS), "department")))


def department_of(position: Column) -> Column:
    """The department behind a role."""
    return F.nullif(F.regexp_extract(position, r"(?iu)((?:sales|purchasing|supply|technical|отдела?|снабжени[яе]|продаж)[\p{L} ]*)$", 1), F.lit(""))


def product_name(c: Column) -> Column:
    """A cleaned product name: marks, list numbers, quantities and article tails go; at most 120 characters."""
    out = T.hygiene(c)
    out = F.regexp_replace(out, r"^\s*[0-9]{1,3}[.)]\s+|^\s*[-•*]\s+", "")
    out = F.regexp_replace(out, r"(?iu)[\s,;:–-]+[0-9]+(?:[.,][0-9]+)?\s*(?:шт|штук|pcs|pc|кг|kg|компл|set)\.?\s*$", "")
    out = F.regexp_replace(out, r"[\s,;:–-]+(?=[A-Z0-9./-]*[0-9])[A-Z0-9]+(?:[-./][A-Z0-9]+)+\s*$", "")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.nullif(F.substring(out, 1, 120), F.lit(""))


def product_reject(name: Column) -> Column:
    """Why a text is no product name, or null."""
    return (
        F.when(name.isNull(), "empty").when(F.length(name) < 3, "short").when(name.rlike("^[0-9 .,/-]+$"), "number").when(name.rlike(NO_PERSON), "phrase")
        .when(name.rlike(T.EMAIL), "email")
    )


def product_names(items: Column) -> Column:
    """Cleaned names of an array, split at semicolons, distinct by their letters and digits."""
    split = F.flatten(F.transform(items, lambda i: F.split(i, r"\s*;\s*", -1)))
    clean = F.filter(F.transform(split, product_name), lambda n: product_reject(n).isNull())
    key = lambda n: F.translate(F.regexp_replace(F.upper(n), r"[^\p{L}0-9]+", ""), "АВЕКМНОРСТУХ", "ABEKMHOPCTYX")
    keys = F.transform(clean, key)
    return F.filter(clean, lambda n, i: F.array_position(keys, key(n)) == i + 1)


def brands(raw: Column) -> Column:
    """Brands of an array: bundles split at `` / ``, generic words gone, first spelling of each."""
    split = F.filter(F.transform(F.flatten(F.transform(raw, lambda b: F.split(b, r"\s+/\s+", -1))), lambda b: F.trim(b)), lambda b: (b != "") & ~F.lower(b).isin(*GENERIC_BRANDS))
    low = F.transform(split, F.lower)
    return F.filter(split, lambda b, i: F.array_position(low, F.lower(b)) == i + 1)
