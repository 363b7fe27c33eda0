"""The message query: parameters in, one Catalyst predicate out.

``MessageQuery`` is the whole filter surface. Every parameter is optional and the ones that are
given are combined with AND; ``predicate`` turns them into a single Column, so Catalyst prunes
columns and pushes what it can into the scan.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posthorn.plans.messages import AS_OF, PRIORITIES, RISKS, SLA_HOURS, SLA_OTHER, STATUSES

_TRUE, _FALSE = {"true", "1", "yes"}, {"false", "0", "no"}


def tri_state(value: str | bool | None) -> bool | None:
    """true/1/yes, false/0/no, and anything else is no condition."""
    if isinstance(value, bool) or value is None:
        return value
    v = value.strip().lower()
    return True if v in _TRUE else False if v in _FALSE else None


def choice(value: str | None, domain: tuple[str, ...] | None = None) -> list[str] | None:
    """A comma-separated list, without tokens outside ``domain``; an empty one is no condition."""
    if not value:
        return None
    found = [x.strip().lower() for x in value.split(",") if x.strip()]
    found = [x for x in found if domain is None or x in domain]
    return found or None


@dataclass(frozen=True)
class MessageQuery:
    """All parameters of the message query surface."""

    status: str | None = None
    exported: str | bool | None = None
    since: str | None = None
    brand: str | None = None
    article: str | None = None
    label: str | None = None
    q: str | None = None
    has_attachments: str | bool | None = None
    attachment_ext: str | None = None
    min_attachments: int = 0
    product_type: str | None = None
    confirmed: str | bool | None = None
    priority: str | None = None
    risk: str | None = None
    has_conflicts: str | bool | None = None
    company_present: str | bool | None = None
    inn_present: str | bool | None = None
    phone_present: str | bool | None = None
    article_present: str | bool | None = None
    sla_overdue: str | bool | None = None
    preset: str | None = None


def filled(c: str | Column) -> Column:
    """Neither null nor blank."""
    return F.coalesce(F.trim(F.col(c) if isinstance(c, str) else c) != "", F.lit(False))


def age_hours(as_of: str = AS_OF) -> Column:
    """Hours between a message's creation and ``as_of``."""
    return (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 3_600_000_000


def sla_overdue(as_of: str = AS_OF) -> Column:
    """Older than its priority allows; false without a priority."""
    limit = F.lit(SLA_OTHER)
    for name, hours in SLA_HOURS.items():
        limit = F.when(F.col("priority") == name, hours).otherwise(limit)
    return F.coalesce(F.col("priority").isNotNull() & (age_hours(as_of) > limit), F.lit(False))


def issue_conditions(as_of: str = AS_OF) -> dict[str, Column]:
    """What makes a message a problem, by name and in order."""
    return {
        "no_article": F.size("articles") == 0,
        "no_brand": F.size("brands") == 0,
        "no_name": F.size("names") == 0,
        "no_phone": ~filled("phone"),
        "no_company": ~filled("company"),
        "no_inn": ~filled("inn"),
        "attachments_unparsed": (F.col("n_attachments") > 0) & ~F.col("parsed_attachment"),
        "weak_detection": F.coalesce(F.col("risk").isin("high", "medium"), F.lit(False)) | F.coalesce(F.col("confidence") < 0.75, F.lit(False)),
        "has_conflicts": F.col("has_conflicts"),
        "sla_overdue": sla_overdue(as_of),
    }


def issues(as_of: str = AS_OF) -> Column:
    """The names of a message's issues."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in issue_conditions(as_of).items())))


#: Parameters of the global presets; explicit parameters win. Fixed values.
PRESETS: dict[str, dict] = {
    "problem_queue": {"confirmed": "false"},
    "max_parsed": {"article_present": "true", "company_present": "true", "inn_present": "true", "phone_present": "true", "risk": "low"},
    "sla_overdue": {"sla_overdue": "true"},
    "needs_review": {"confirmed": "false"},
    "high_priority_open": {"confirmed": "false", "priority": "high,critical"},
}


def preset_rule(name: str, as_of: str = AS_OF) -> Column:
    """The condition that a preset adds to its parameters, whatever parameters are given (Q7)."""
    if name == "problem_queue":
        return F.size(issues(as_of)) > 0
    if name == "needs_review":
        return (F.size(issues(as_of)) > 0) | F.coalesce(F.col("risk").isin("high", "medium"), F.lit(False)) | F.col("has_conflicts")
    if name == "max_parsed":
        parsed = [F.size(c) > 0 for c in ("articles", "brands", "names")] + [filled(c) for c in ("phone", "company", "inn")]
        return reduce(lambda a, b: a & b, parsed) & ~F.col("has_conflicts")
    if name == "high_priority_open":
        return F.col("confirmed_at").isNull() & F.coalesce(F.col("priority").isin("high", "critical"), F.lit(False))
    if name == "sla_overdue":
        return sla_overdue(as_of)
    return F.lit(True)


def with_preset(query: MessageQuery, saved: dict[str, dict] | None = None) -> MessageQuery:
    """A query with its preset's parameters filled in; ``saved`` presets come before global ones."""
    given = {**PRESETS, **(saved or {})}.get(query.preset or "", {})
    known = {f.name for f in fields(MessageQuery)}
    return replace(query, **{k: v for k, v in given.items() if k in known and getattr(query, k) in (None, 0)})


#: Presets of one client in one project; more are an error, none is dropped.
MAX_PRESETS = 1000


def saved_presets(rows: DataFrame, client: str, project: str) -> dict[str, dict]:
    """a client's saved presets, those of the project before general ones, the newest first.

    ``rows``: client_id, project_id (null: general), preset_key, query_json, id. A client's
    presets are a handful of rows of configuration.
    """
    mine = rows.where((F.col("client_id") == client) & (F.col("project_id").isNull() | (F.col("project_id") == project)))
    first = mine.groupBy("preset_key").agg(F.min_by("query_json", F.struct(F.col("project_id").isNull(), -F.col("id"))).alias("q"))
    found = first.limit(MAX_PRESETS + 1).collect()
    if len(found) > MAX_PRESETS:
        raise ValueError(f"more than {MAX_PRESETS} presets of one client")
    return {r.preset_key: json.loads(r.q) for r in found}


#: Names of the recognition filters of the inbox. Fixed values.
RECOGNITION = (
    "missing_article", "missing_brand", "missing_name", "missing_phone", "missing_company", "missing_inn", "attachments_unparsed", "weak_detection",
    "has_conflicts", "unconfirmed", "high_priority", "sla_overdue", "all_key_fields", "fully_parsed",
)


def recognition(name: str, as_of: str = AS_OF) -> Column:
    """one of the inbox's recognition filters; an unknown one is no condition."""
    has = {"article": F.size("articles") > 0, "brand": F.size("brands") > 0, "name": F.size("names") > 0, "phone": filled("phone"), "company": filled("company"), "inn": filled("inn")}
    unparsed = (F.col("n_attachments") > 0) & ~F.col("parsed_attachment")
    if name.startswith("missing_"):
        return ~has[name.removeprefix("missing_")]
    key = has["article"] & has["brand"] & has["name"] & has["phone"]
    return {
        "attachments_unparsed": unparsed,
        "weak_detection": (F.coalesce("completeness", F.lit(0)) < 70) | (F.coalesce("confidence", F.lit(0.0)) < 0.72),
        "has_conflicts": F.col("has_conflicts"),
        "unconfirmed": F.col("confirmed_at").isNull(),
        "high_priority": F.coalesce(F.col("priority").isin("high", "critical"), F.lit(False)),
        "sla_overdue": sla_overdue(as_of),
        "all_key_fields": key,
        "fully_parsed": key & has["company"] & has["inn"] & ~unparsed,
    }.get(name, F.lit(True))


def predicate(query: MessageQuery, as_of: str = AS_OF) -> Column:
    """The conjunction of a query's conditions."""
    conditions: list[Column] = []
    if query.preset:
        query = with_preset(query)
        if query.preset in PRESETS:
            conditions.append(preset_rule(query.preset, as_of))

    def flag(value: str | bool | None, c: Column) -> None:
        if (v := tri_state(value)) is not None:
            conditions.append(c if v else ~c)

    if s := choice(query.status):
        conditions.append(F.col("status").isin(s))
    flag(query.exported, F.col("acked_crm").isNotNull())
    if query.since:
        t = F.try_to_timestamp(F.lit(query.since))
        conditions.append(t.isNull() | F.coalesce(F.col("updated_at").cast("timestamp") >= t, F.lit(False)))
    if query.brand:
        conditions.append(F.exists("brands", lambda b: F.contains(F.lower(b), F.lit(query.brand.lower()))))
    if query.article:
        conditions.append(F.exists("articles", lambda a: F.contains(F.upper(a), F.lit(query.article.upper()))))
    if query.label:
        conditions.append(F.coalesce("label", F.lit("unknown")) == query.label.strip().lower())
    if query.q:
        hay = F.lower(F.concat_ws(" ", "subject", "preview", "sender_email", "company", "brands"))
        conditions += [F.contains(hay, F.lit(t)) for t in query.q.lower().split()]
    flag(query.has_attachments, F.col("n_attachments") > 0)
    if e := choice(query.attachment_ext):
        conditions.append(F.arrays_overlap("attachment_exts", F.array(*map(F.lit, e))))
    if query.min_attachments:
        conditions.append(F.col("n_attachments") >= query.min_attachments)
    if query.product_type:
        conditions.append(F.arrays_overlap("product_types", F.array(*(F.lit(x.strip()) for x in query.product_type.split(",")))))
    flag(query.confirmed, F.col("confirmed_at").isNotNull())
    if p := choice(query.priority, PRIORITIES):
        conditions.append(F.coalesce(F.col("priority").isin(p), F.lit(False)))
    if r := choice(query.risk, RISKS):
        conditions.append(F.coalesce(F.col("risk").isin(r), F.lit(False)))
    flag(query.has_conflicts, F.col("has_conflicts"))
    flag(query.company_present, filled("company"))
    flag(query.inn_present, filled("inn"))
    flag(query.phone_present, filled("phone"))
    if tri_state(query.article_present) is not None:
        flag(query.article_present, F.size("articles") > 0)
    flag(query.sla_overdue, sla_overdue(as_of))
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def from_params(params: dict[str, str]) -> MessageQuery:
    """A query from request parameters; unknown names are ignored."""
    known = {f.name for f in fields(MessageQuery)}
    given = {k: v for k, v in params.items() if k in known and v != ""}
    if "min_attachments" in given:
        given["min_attachments"] = max(0, int(given["min_attachments"])) if str(given["min_attachments"]).isdigit() else 0
    return MessageQuery(**given)


def search(messages: DataFrame, query: MessageQuery, as_of: str = AS_OF) -> DataFrame:
    """The messages that a query asks for."""
    return messages.where(predicate(query, as_of))


# Pages


def encode_cursor(updated_at: str, key: str) -> str:
    """base64url of the JSON of a position."""
    return base64.urlsafe_b64encode(json.dumps({"updatedAt": updated_at, "key": key}).encode()).decode().rstrip("=")


def decode_cursor(cursor: str | None) -> tuple[str, str] | None:
    """The position of a cursor; an invalid one is none."""
    try:
        raw = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        return str(raw["updatedAt"]), str(raw["key"])
    except (TypeError, ValueError, KeyError):
        return None


def page_limit(limit: int | None, default: int = 50, most: int = 200) -> int:
    return min(most, max(1, limit or default))


def newest_first(at: str = "updated_at", key: str = "message_key") -> list[Column]:
    return [F.col(at).desc_nulls_last(), F.col(key).desc()]


def keyset_page(rows: DataFrame, cursor: str | None, limit: int | None = None, at: str = "updated_at", key: str = "message_key") -> DataFrame:
    """The page behind a cursor, newest first: a range predicate and a top-k, however far the page is."""
    position = decode_cursor(cursor)
    if position:
        t = F.lit(position[0]).cast(rows.schema[at].dataType)
        rows = rows.where((F.col(at) < t) | ((F.col(at) == t) & (F.col(key) < position[1])) | F.col(at).isNull())
    return rows.orderBy(*newest_first(at, key)).limit(page_limit(limit))


def offset_page(rows: DataFrame, page: int = 1, limit: int | None = None, at: str = "updated_at", key: str = "message_key") -> DataFrame:
    """Page ``page`` (from 1) by offset."""
    n = page_limit(limit)
    return rows.orderBy(*newest_first(at, key)).offset((max(1, page) - 1) * n).limit(n)


def known_statuses() -> tuple[str, ...]:
    return STATUSES
