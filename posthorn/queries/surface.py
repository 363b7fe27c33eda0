"""The message query surface: filters, presets, pages, summaries, exports (F, L, A1-A5, P, S14-S17)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posthorn.operators import summaries
from posthorn.plans import messages as M
from posthorn.plans import query_spec as Q
from posthorn.sources import exports
from posthorn.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_LIGHT = ["message_key", "status", "priority", "risk", "created_at"]


def _filter(name: str, sql: str, lines: bool = False, **params) -> None:
    """Register a filtered list of messages and its SQL condition."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Q.search(M.from_orders(spark, sf_dir, lines), Q.MessageQuery(**params)).select(*_LIGHT)

    QUERIES[name] = run
    ORACLE[name] = f"WITH {M.SQL if lines else M.SQL_BASE} SELECT {', '.join(_LIGHT)} FROM {'m' if lines else 'b'} WHERE {sql}"


_AGE = "date_diff('hour', created_at, TIMESTAMP '2001-08-02 00:00:00')"
_OVERDUE = f"(priority IS NOT NULL AND {_AGE} > CASE priority WHEN 'critical' THEN 2 WHEN 'high' THEN 8 WHEN 'medium' THEN 24 ELSE 48 END)"
_COMPANY, _INN, _PHONE = ("coalesce(trim({0}) <> '', false)".format(c) for c in ("company", "inn", "phone"))

_filter("msg_filter_status_since", "status IN ('review', 'ready_for_crm') AND updated_at >= TIMESTAMP '1998-06-01'", status="review, Ready_for_crm", since="1998-06-01 00:00:00")
_filter("msg_filter_since_unparsable", "true", since="not a date")
_filter("msg_filter_exported", "acked_crm IS NULL", exported="no")
_filter("msg_filter_priority_confirmed", "priority IN ('critical', 'high') AND confirmed_at IS NOT NULL", priority="critical,HIGH,bogus", confirmed="yes")
_filter("msg_filter_priority_all_invalid", "true", priority="bogus,none")
_filter("msg_filter_risk", "risk IN ('high')", risk="high")
_filter("msg_filter_label", "coalesce(label, 'unknown') = 'unknown'", label="unknown")
_filter("msg_search_terms", "lower(concat_ws(' ', subject, preview, sender_email, company, array_to_string(brands, ' '))) LIKE '%building%' AND lower(concat_ws(' ', subject, preview, sender_email, company, array_to_string(brands, ' '))) LIKE '%1-urgent%'", lines=True, q="BUILDING 1-urgent")
_filter("msg_array_contains", "len(list_filter(brands, lambda x: contains(lower(x), '#1'))) > 0 AND len(list_filter(articles, lambda x: contains(x, 'ART-1'))) > 0", lines=True, brand="#1", article="art-1")
_filter("msg_filter_attachment_ext", "list_contains(attachment_exts, 'xlsx') OR list_contains(attachment_exts, 'doc')", lines=True, attachment_ext="xlsx,doc")
_filter("msg_filter_has_attachments", "n_attachments > 0", lines=True, has_attachments="1")
_filter("msg_min_children", "n_attachments >= 5", lines=True, min_attachments=5)
_filter("msg_filter_conflicts", "NOT has_conflicts", lines=True, has_conflicts="false")
_filter("msg_filter_presence", f"{_COMPANY} AND NOT {_INN} AND {_PHONE}", company_present="true", inn_present="0", phone_present="1")
_filter("msg_filter_article_present", "len(articles) > 0", lines=True, article_present="true")
_filter("sla_overdue", _OVERDUE, sla_overdue="true")
_ISSUES = {
    "no_article": "len(articles) = 0", "no_brand": "len(brands) = 0", "no_name": "len(names) = 0", "no_phone": f"NOT {_PHONE}", "no_company": f"NOT {_COMPANY}",
    "no_inn": f"NOT {_INN}", "attachments_unparsed": "n_attachments > 0 AND NOT parsed_attachment",
    "weak_detection": "coalesce(risk IN ('high', 'medium'), false) OR coalesce(confidence < 0.75, false)", "has_conflicts": "has_conflicts", "sla_overdue": _OVERDUE,
}
_ANY = "(" + " OR ".join(f"({c})" for c in _ISSUES.values()) + ")"
_HIGH = "confirmed_at IS NULL AND coalesce(priority IN ('high', 'critical'), false)"
_filter("preset_high_priority_open", _HIGH, lines=True, preset="high_priority_open")
_filter("preset_explicit_wins", f"{_HIGH} AND priority = 'critical'", lines=True, preset="high_priority_open", priority="critical")
_filter("preset_problem_queue", f"confirmed_at IS NULL AND {_ANY}", lines=True, preset="problem_queue")
_filter("preset_needs_review", f"confirmed_at IS NULL AND ({_ANY} OR coalesce(risk IN ('high', 'medium'), false) OR has_conflicts)", lines=True, preset="needs_review")
_filter("preset_max_parsed", f"{_COMPANY} AND {_INN} AND {_PHONE} AND len(articles) > 0 AND len(brands) > 0 AND len(names) > 0 AND coalesce(risk = 'low', false) AND NOT has_conflicts", lines=True, preset="max_parsed")
_filter("preset_sla_overdue", _OVERDUE, lines=True, preset="sla_overdue")
_filter("preset_unknown_is_no_filter", "true", preset="no such preset")


def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11 with the two first types of the catalogue, whatever they are called."""
    two = [r.p_type for r in table(spark, sf_dir, "part").select("p_type").distinct().orderBy("p_type").limit(2).collect()]
    return Q.search(M.from_orders(spark, sf_dir), Q.MessageQuery(product_type=",".join(two))).select(*_LIGHT)


QUERIES["msg_filter_product_type"] = _types
ORACLE["msg_filter_product_type"] = f"""WITH {M.SQL}, w AS (SELECT DISTINCT p_type FROM part ORDER BY p_type LIMIT 2)
SELECT {", ".join(_LIGHT)} FROM m WHERE id IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type IN (SELECT p_type FROM w))"""

_CURSOR = Q.encode_cursor("1998-01-01 00:00:00", "m500")


def page_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: the page behind a cursor."""
    return Q.keyset_page(M.from_orders(spark, sf_dir, lines=False), _CURSOR, 75).select("message_key", "updated_at")


def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: the third page by offset, the limit held to 200."""
    return Q.offset_page(M.from_orders(spark, sf_dir, lines=False), 3, 500).select("message_key", "updated_at")


def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total, pages and next_since of a filtered page."""
    rows = Q.search(M.from_orders(spark, sf_dir, lines=False), Q.MessageQuery(status="review"))
    page = Q.offset_page(rows, 1, 50).agg(F.max("updated_at").alias("next_since"))
    return rows.agg(F.count("*").alias("total")).withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / 50))).withColumn("next_since", page.scalar())


QUERIES |= {"page_keyset": page_keyset, "page_offset": page_offset, "page_meta": page_meta}
ORACLE["page_keyset"] = f"""WITH {M.SQL_BASE} SELECT message_key, updated_at FROM b
WHERE updated_at < TIMESTAMP '1998-01-01' OR (updated_at = TIMESTAMP '1998-01-01' AND message_key < 'm500') OR updated_at IS NULL
ORDER BY updated_at DESC NULLS LAST, message_key DESC LIMIT 75"""
ORACLE["page_offset"] = f"WITH {M.SQL_BASE} SELECT message_key, updated_at FROM b ORDER BY updated_at DESC NULLS LAST, message_key DESC LIMIT 200 OFFSET 400"
ORACLE["page_meta"] = f"""WITH {M.SQL_BASE}, f AS (SELECT * FROM b WHERE status = 'review')
SELECT (SELECT count(*) FROM f) AS total, CAST(greatest(1, ceil((SELECT count(*) FROM f) / 50.0)) AS BIGINT) AS total_pages,
  (SELECT max(updated_at) FROM (SELECT updated_at FROM f ORDER BY updated_at DESC NULLS LAST, message_key DESC LIMIT 50) p) AS next_since"""


def sla_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overdue first, then by priority and age."""
    m = M.from_orders(spark, sf_dir, lines=False)
    weight = F.when(F.col("priority") == "critical", 0).when(F.col("priority") == "high", 1).when(F.col("priority") == "medium", 2).otherwise(3)
    return m.select("message_key", Q.sla_overdue().alias("overdue"), weight.alias("weight"), F.floor(Q.age_hours()).alias("age")).orderBy(
        F.desc("overdue"), "weight", F.desc("age"), "message_key"
    ).limit(100)


def quality_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By risk, then confidence; the first 20."""
    m = M.from_orders(spark, sf_dir, lines=False)
    weight = F.when(F.col("risk") == "high", 0).when(F.col("risk") == "medium", 1).when(F.col("risk") == "low", 2).otherwise(3)
    return m.select("message_key", weight.alias("weight"), "confidence").orderBy("weight", "confidence", "message_key").limit(20)


QUERIES |= {"sla_queue": sla_queue, "quality_queue": quality_queue}
ORACLE["sla_queue"] = f"""WITH {M.SQL_BASE} SELECT message_key, {_OVERDUE} AS overdue,
  CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS weight, {_AGE} AS age
FROM b ORDER BY overdue DESC, weight, age DESC, message_key LIMIT 100"""
ORACLE["quality_queue"] = f"""WITH {M.SQL_BASE} SELECT message_key, CASE risk WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS weight, confidence
FROM b ORDER BY weight, confidence, message_key LIMIT 20"""

# Summaries


QUERIES["summary_kpis"] = lambda spark, sf: summaries.kpis(M.from_orders(spark, sf))
ORACLE["summary_kpis"] = f"""WITH {M.SQL} SELECT count(*) AS total, count(confirmed_at) AS confirmed, count(*) - count(confirmed_at) AS unconfirmed,
  count(*) FILTER (WHERE has_conflicts) AS conflicts, count(acked_crm) AS exported, count(*) FILTER (WHERE n_attachments > 0) AS with_attachments,
  count(*) FILTER (WHERE {_OVERDUE}) AS overdue, round(avg(confidence), 4) AS avg_confidence, round(avg(completeness), 2) AS avg_completeness,
  max(created_at) AS last_message_at FROM m"""


def _by(name: str, column: str, other: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf: summaries.histogram(M.from_orders(spark, sf, lines=False), column, other)
    value = f"coalesce({column}, '{other}')" if other else column
    ORACLE[name] = f"WITH {M.SQL_BASE} SELECT {value} AS value, count(*) AS n FROM b {'' if other else f'WHERE {column} IS NOT NULL'} GROUP BY 1"


_by("summary_by_status", "status")
_by("summary_by_label", "label", "unknown")
_by("summary_by_priority", "priority")
_by("summary_by_risk", "risk")

_COVERAGE = ("company", "inn", "phone", "thread_id", "priority", "updated_at", "sender_email")
QUERIES["coverage_fields"] = lambda spark, sf: summaries.coverage(M.from_orders(spark, sf, lines=False), _COVERAGE)
ORACLE["coverage_fields"] = f"WITH {M.SQL_BASE} " + " UNION ALL ".join(
    f"SELECT '{c}' AS field, count(*) FILTER (WHERE p) AS present, count(*) FILTER (WHERE NOT p) AS missing, round(count(*) FILTER (WHERE p) / count(*), 4) AS rate "
    f"FROM (SELECT coalesce(trim(CAST({c} AS VARCHAR)) <> '', false) AS p FROM b) x"
    for c in _COVERAGE
)
QUERIES["coverage_extremes"] = lambda spark, sf: summaries.extremes(summaries.coverage(M.from_orders(spark, sf, lines=False), _COVERAGE))
ORACLE["coverage_extremes"] = f"""WITH {M.SQL_BASE}, c AS (SELECT * FROM (
  {" UNION ALL ".join(f"SELECT '{c}' AS field, round(count(*) FILTER (WHERE coalesce(trim(CAST({c} AS VARCHAR)) <> '', false)) / count(*), 4) AS rate FROM b" for c in _COVERAGE)}) u)
SELECT (SELECT field FROM c ORDER BY rate DESC, field LIMIT 1) AS strongest, (SELECT field FROM c ORDER BY rate, field LIMIT 1) AS weakest, (SELECT count(*) FROM c WHERE rate < 0.5) AS gaps"""

QUERIES["problems_by_issue"] = lambda spark, sf: summaries.problems(M.from_orders(spark, sf))
ORACLE["problems_by_issue"] = f"WITH {M.SQL}, i AS (" + " UNION ALL ".join(f"SELECT message_key, '{n}' AS issue FROM m WHERE {c}" for n, c in _ISSUES.items()) + ") SELECT issue, count(*) AS messages FROM i GROUP BY issue"


def recognition_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how many messages each recognition filter shows, from one scan."""
    m = M.from_orders(spark, sf_dir)
    counted = m.agg(F.count("*").alias("total"), *(F.count_if(Q.recognition(n)).alias(n) for n in Q.RECOGNITION))
    return counted.unpivot("total", list(Q.RECOGNITION), "filter", "n").select("filter", "n")


_KEY = f"len(articles) > 0 AND len(brands) > 0 AND len(names) > 0 AND {_PHONE}"
_RECOGNITION = {
    "missing_article": "len(articles) = 0", "missing_brand": "len(brands) = 0", "missing_name": "len(names) = 0", "missing_phone": f"NOT {_PHONE}",
    "missing_company": f"NOT {_COMPANY}", "missing_inn": f"NOT {_INN}", "attachments_unparsed": "n_attachments > 0 AND NOT parsed_attachment",
    "weak_detection": "completeness < 70 OR confidence < 0.72", "has_conflicts": "has_conflicts", "unconfirmed": "confirmed_at IS NULL",
    "high_priority": "priority IN ('high', 'critical')", "sla_overdue": _OVERDUE, "all_key_fields": _KEY,
    "fully_parsed": f"{_KEY} AND {_COMPANY} AND {_INN} AND (n_attachments = 0 OR parsed_attachment)",
}
QUERIES["recognition_filters"] = recognition_filters
ORACLE["recognition_filters"] = f"WITH {M.SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS filter, count(*) FILTER (WHERE {c}) AS n FROM m" for n, c in _RECOGNITION.items())
QUERIES["threads_rollup"] = lambda spark, sf: summaries.threads(M.from_orders(spark, sf, lines=False))
ORACLE["threads_rollup"] = f"""WITH {M.SQL_BASE}, t AS (SELECT *, coalesce(thread_id, 'message:' || message_key) AS tid FROM b)
SELECT tid AS thread_id, count(*) AS messages, min(created_at) AS first_at, max(coalesce(updated_at, created_at)) AS last_at,
  array_to_string(list_sort(list(DISTINCT status)), '|') AS statuses, coalesce(array_to_string(list_sort(list(DISTINCT priority) FILTER (WHERE priority IS NOT NULL)), '|'), '') AS priorities,
  count(DISTINCT sender_email) AS participants, bool_or(confirmed_at IS NOT NULL) AS any_confirmed,
  array_to_string(list_sort(list(message_key)), '|') AS keys FROM t GROUP BY tid"""


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as webhook deliveries: one row with key, status, attempts, response and times."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "pending").otherwise("delivered")
    return e.select(
        F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("key"), F.concat(F.lit("m"), (F.col("user_id") % 50).cast("string")).alias("message_key"),
        F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("client_id"), status.alias("status"), (F.col("event_id") % 6).cast("int").alias("attempts"),
        F.when(status == "delivered", 200).when(status == "failed", F.when(F.col("event_id") % 2 == 0, 500).otherwise(404)).alias("response_status"),
        F.when(status == "failed", F.concat(F.lit("HTTP "), F.when(F.col("event_id") % 2 == 0, "500").otherwise("404"))).alias("last_error"),
        F.col("ts").alias("created_at"),
    )


_DELIVERIES = """d AS (
  SELECT 'd' || CAST(event_id AS VARCHAR) AS key, 'm' || CAST(user_id % 50 AS VARCHAR) AS message_key, 'c' || CAST(user_id % 3 AS VARCHAR) AS client_id,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'delivered' END AS status, CAST(event_id % 6 AS INTEGER) AS attempts,
    CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 500 ELSE 404 END WHEN 'signup' THEN NULL ELSE 200 END AS response_status,
    CASE WHEN event_type = 'error' THEN 'HTTP ' || CASE WHEN event_id % 2 = 0 THEN '500' ELSE '404' END END AS last_error, ts AS created_at FROM events)"""
QUERIES["deliveries_stats"] = lambda spark, sf: summaries.delivery_stats(deliveries(spark, sf))
ORACLE["deliveries_stats"] = f"""WITH {_DELIVERIES} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'delivered') AS delivered, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status = 'pending') AS backlog, round(count(*) FILTER (WHERE status = 'delivered') / count(*) FILTER (WHERE status IN ('delivered', 'failed')), 4) AS success_rate,
  max(created_at) AS latest_at, min(created_at) FILTER (WHERE status = 'pending') AS oldest_pending_at FROM d"""
QUERIES["deliveries_by_failure"] = lambda spark, sf: summaries.histogram(deliveries(spark, sf), "last_error")
ORACLE["deliveries_by_failure"] = f"WITH {_DELIVERIES} SELECT last_error AS value, count(*) AS n FROM d WHERE last_error IS NOT NULL GROUP BY 1"
QUERIES["deliveries_filter"] = lambda spark, sf: (
    deliveries(spark, sf).where((F.col("client_id") == "c1") & F.col("status").isin("failed", "pending")).orderBy(F.desc("created_at"), "key").limit(500).select("key", "status", "created_at")
)
ORACLE["deliveries_filter"] = f"WITH {_DELIVERIES} SELECT key, status, created_at FROM d WHERE client_id = 'c1' AND status IN ('failed', 'pending') ORDER BY created_at DESC, key LIMIT 500"
QUERIES["deliveries_due"] = lambda spark, sf: exports.due(deliveries(spark, sf), "2024-01-20 00:00:00").select("key", "attempts", "next_attempt_at")
ORACLE["deliveries_due"] = f"""WITH {_DELIVERIES}, n AS (SELECT key, attempts, created_at + to_seconds(CASE attempts WHEN 0 THEN 0 WHEN 1 THEN 60 WHEN 2 THEN 300 WHEN 3 THEN 900 WHEN 4 THEN 3600 ELSE 21600 END) AS next_attempt_at FROM d WHERE status = 'pending' AND attempts < 5)
SELECT * FROM n WHERE next_attempt_at <= TIMESTAMP '2024-01-20' ORDER BY next_attempt_at, key LIMIT 20"""


def events_feed_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of filtered messages behind a (time, id) cursor."""
    e = deliveries(spark, sf_dir)
    wanted = M.from_orders(spark, sf_dir, lines=False).where(F.col("label") == "client").select("message_key")
    rows = e.join(wanted, "message_key", "left_semi").where(F.col("status").isin("delivered", "failed"))
    t = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return rows.where((F.col("created_at") > t) | ((F.col("created_at") == t) & (F.col("key") > "d0"))).orderBy("created_at", "key").limit(100).select("key", "message_key", "created_at")


QUERIES["events_feed_keyset"] = events_feed_keyset
ORACLE["events_feed_keyset"] = f"""WITH {_DELIVERIES}, {M.SQL_BASE} SELECT key, message_key, created_at FROM d
WHERE message_key IN (SELECT message_key FROM b WHERE label = 'client') AND status IN ('delivered', 'failed')
  AND (created_at > TIMESTAMP '2024-01-10' OR (created_at = TIMESTAMP '2024-01-10' AND key > 'd0')) ORDER BY created_at, key LIMIT 100"""

# Exports and projections

QUERIES["csv_export_shape"] = lambda spark, sf: exports.csv_lines(M.from_orders(spark, sf))
_CSV = ("message_key", "project_id", "status", "priority", "risk", "label", "company", "inn", "phone", "sender_email", "subject")
ORACLE["csv_export_shape"] = f"""WITH {M.SQL} SELECT message_key, concat_ws(',', {", ".join(
    f"CASE WHEN regexp_matches(coalesce({c}, ''), '[\",\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE coalesce({c}, '') END" for c in _CSV
)}, array_to_string(brands, '|'), array_to_string(articles, '|'), CAST(n_attachments AS VARCHAR)) AS line FROM m"""
_PAYLOAD = {"generic": ("external_id", "tax_id", "amount"), "1c": ("Number", "INN", "Sum"), "amocrm": ("request_id", "PHONE", "price"), "bitrix24": ("ORIGIN_ID", "EMAIL", "OPPORTUNITY")}


def crm_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON for each target, read back: its key, one of its texts, its amount and its articles."""
    m = M.from_orders(spark, sf_dir)
    out = None
    for target, (key, text, amount) in _PAYLOAD.items():
        get = lambda name: F.get_json_object("payload", f"$.{name}")  # noqa: B023, E731
        one = exports.crm_payloads(m, target).select(
            "message_key", F.lit(target).alias("target"), get(key).alias("key"), get(text).alias("text"), get(amount).cast("double").alias("amount"),
            F.array_join(F.from_json(get("articles"), "array<string>"), "|").alias("articles"), F.json_object_keys("payload").getItem(0).alias("first"),
        )
        out = one if out is None else out.unionByName(one)
    return out


QUERIES["crm_payloads"] = crm_payloads
ORACLE["crm_payloads"] = f"WITH {M.SQL} " + " UNION ALL ".join(
    f"SELECT message_key, '{t}' AS target, message_key AS key, {c} AS text, CAST(total AS DOUBLE) AS amount, array_to_string(articles, '|') AS articles, '{k}' AS first FROM m"
    for t, c, k in (("generic", "inn", "external_id"), ("1c", "inn", "Number"), ("amocrm", "phone", "request_id"), ("bitrix24", "sender_email", "ORIGIN_ID"))
)
QUERIES["crm_sync_batch"] = lambda spark, sf: exports.sync_batch(M.from_orders(spark, sf, lines=False)).select("message_key", "created_at")
ORACLE["crm_sync_batch"] = f"WITH {M.SQL_BASE} SELECT message_key, created_at FROM b WHERE status = 'ready_for_crm' AND acked_crm IS NULL ORDER BY created_at, message_key LIMIT 50"
QUERIES["message_meta"] = lambda spark, sf: M.from_orders(spark, sf).select(
    "message_key", F.floor(Q.age_hours()).alias("age"), Q.sla_overdue().alias("overdue"), "has_conflicts", "priority", "risk",
    F.coalesce("updated_at", "created_at").alias("changed_at"), F.coalesce("thread_id", F.concat(F.lit("message:"), F.col("message_key"))).alias("thread"),
    F.nullif(F.trim("company"), F.lit("")).alias("company_or_null"),
)
ORACLE["message_meta"] = f"""WITH {M.SQL} SELECT message_key, {_AGE} AS age, {_OVERDUE} AS overdue, has_conflicts, priority, risk,
  coalesce(updated_at, created_at) AS changed_at, coalesce(thread_id, 'message:' || message_key) AS thread, nullif(trim(company), '') AS company_or_null FROM m"""
QUERIES["manager_inbox"] = lambda spark, sf: Q.offset_page(
    M.from_orders(spark, sf, lines=False).where(F.col("status").isin("ready_for_crm", "review")), 2, 40, at="created_at"
).select("project_id", "message_key", F.substring(F.concat_ws(" ", "subject", "preview"), 1, 20).alias("preview20"))
ORACLE["manager_inbox"] = f"""WITH {M.SQL_BASE} SELECT project_id, message_key, substr(subject || ' ' || preview, 1, 20) AS preview20 FROM b
WHERE status IN ('ready_for_crm', 'review') ORDER BY created_at DESC, message_key DESC LIMIT 40 OFFSET 40"""
