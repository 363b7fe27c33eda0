"""The desk over the driver's tables: inbox, reports, exports, audit, retention, scopes and backlogs (A1, A3-A5, A15, A23, F27, F29, F33, F34, L9, L14, P2, P4, R10, S15, S16, S22, U1, U13, U15, U18, 2.17)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posthorn.operators import desk as D
from posthorn.plans import messages as M
from posthorn.plans.query_spec import sla_overdue
from posthorn.plans.scratch import new_path
from posthorn.queries.surface import _AGE, _DELIVERIES, _ISSUES, _OVERDUE, deliveries
from posthorn.sources import exports as E
from posthorn.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Register a function under its own name."""

    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _inbox_messages(spark, sf):
    """Messages with a mailbox, attachment names, the weight of the best rule and whether a model has read them."""
    k = F.col("id")
    names = F.transform("attachment_exts", lambda x: F.concat(F.lit("File."), F.upper(x)))
    return M.from_orders(spark, sf).withColumns({
        "mailbox": F.when(k % 19 != 0, F.concat(F.lit("box"), (F.col("customer_id") % 3).cast("string"))), "attachments": names, "weight": F.when(k % 4 != 0, k % 5), "llm_done": F.when(k % 7 != 0, k % 3 == 0),
    })


_INBOX = f"""{M.SQL}, x AS (SELECT *, CASE WHEN id % 19 <> 0 THEN 'box' || CAST(customer_id % 3 AS VARCHAR) END AS mailbox, CASE WHEN id % 4 <> 0 THEN id % 5 END AS weight, CASE WHEN id % 7 <> 0 THEN id % 3 = 0 END AS llm_done FROM m)"""
_REQUEST = "coalesce(weight >= 3, false)"
_MODERATION = f"status <> 'ignored_spam' AND NOT {_REQUEST} AND (coalesce(label = 'client', false) OR status IN ('ready_for_crm', 'needs_clarification', 'review'))"


def _tab(name: str, condition: str, **filters) -> None:
    """Register a list of the inbox and its SQL condition."""
    QUERIES[name] = lambda spark, sf: D.inbox(_inbox_messages(spark, sf), **filters).select("message_key", "status", "mailbox")
    ORACLE[name] = f"WITH {_INBOX} SELECT message_key, status, mailbox FROM x WHERE {condition}"


_tab("inbox_requests", _REQUEST, tab="requests")
_tab("inbox_moderation", _MODERATION, tab="moderation")
_tab("inbox_spam_pdf", "status = 'ignored_spam' AND list_contains(attachment_exts, 'pdf')", tab="spam", attachment="pdf")
_tab("inbox_mailbox_llm", "status <> 'ignored_spam' AND mailbox = 'box1' AND coalesce(llm_done, false)", mailbox="box1", llm="llm_done")
_tab("inbox_status_pending", "status = 'review' AND NOT coalesce(llm_done, false) AND n_attachments > 0", tab="spam", status="review", llm="llm_pending", attachment="has")
_tab("inbox_search_xls", "status <> 'ignored_spam' AND list_contains(attachment_exts, 'xlsx') AND (contains(lower(subject), 'urgent') OR contains(lower(concat_ws(' ', sender_email, mailbox, company, preview)), 'urgent'))", attachment="xls", text="URGENT")
_ORDERS = {"date": "created_at DESC", "date-asc": "created_at", "confidence-asc": "confidence", "confidence-desc": "confidence DESC", "mailbox": "coalesce(mailbox, '')"}


def inbox_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 messages in each order of the inbox."""
    m = D.inbox(_inbox_messages(spark, sf_dir)).select("message_key", "created_at", "confidence", "mailbox")
    out = None
    for name in _ORDERS:
        one = m.orderBy(*D.inbox_order(name)).limit(40).select(F.lit(name).alias("sort"), "message_key")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES["inbox_orders"] = inbox_orders
ORACLE["inbox_orders"] = f"WITH {_INBOX}, o AS (SELECT * FROM x WHERE status <> 'ignored_spam') " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{n}' AS sort, message_key FROM o ORDER BY {o}, message_key LIMIT 40) q{i}" for i, (n, o) in enumerate(_ORDERS.items()))


def _with_heavy(spark, sf):
    m = M.from_orders(spark, sf, lines=False)
    return m.select("message_key", "status", F.concat("subject", F.lit("\n"), "preview").alias("body"), F.concat(F.lit("audit "), "message_key").alias("audit"), F.upper("preview").alias("attachments_analysis"), F.col("confidence").alias("extraction_meta"))


_HEAVY = f"WITH {M.SQL_BASE} SELECT message_key, status"
for _name, _spec, _sql in (
    ("include_none", "unknown", ""), ("include_some", " Body , AUDIT,other", ", subject || chr(10) || preview AS body, 'audit ' || message_key AS audit"),
    ("include_all", "all", ", subject || chr(10) || preview AS body, 'audit ' || message_key AS audit, upper(preview) AS attachments_analysis, confidence AS extraction_meta"),
):
    QUERIES[_name] = lambda spark, sf, spec=_spec: D.included(_with_heavy(spark, sf), spec)
    ORACLE[_name] = f"{_HEAVY}{_sql} FROM b"


@query(f"""WITH {M.SQL}, e AS (SELECT 'status' AS section, status AS value FROM m UNION ALL SELECT 'classification', coalesce(label, 'unknown') FROM m UNION ALL SELECT 'priority', coalesce(priority, 'unknown') FROM m UNION ALL SELECT 'risk', coalesce(risk, 'unknown') FROM m
UNION ALL SELECT 'count', 'total' FROM m UNION ALL SELECT 'count', 'confirmed' FROM m WHERE confirmed_at IS NOT NULL UNION ALL SELECT 'count', 'unconfirmed' FROM m WHERE confirmed_at IS NULL UNION ALL SELECT 'count', 'conflicts' FROM m WHERE has_conflicts
UNION ALL SELECT 'count', 'exported' FROM m WHERE acked_crm IS NOT NULL UNION ALL SELECT 'count', 'with_attachments' FROM m WHERE n_attachments > 0 UNION ALL SELECT 'count', 'parsed_attachments' FROM m WHERE parsed_attachment UNION ALL SELECT 'count', 'sla_overdue' FROM m WHERE {_OVERDUE})
SELECT section, value, count(*) AS n FROM e GROUP BY 1, 2""")
def message_report(spark, sf):
    """A1: all counts and histograms of the summary in one pass."""
    return D.message_report(M.from_orders(spark, sf))


_PROBLEMS = f"i AS ({' UNION ALL '.join(f"SELECT message_key, '{n}' AS issue FROM m WHERE {c}" for n, c in _ISSUES.items())})"


@query(f"WITH {M.SQL}, {_PROBLEMS} SELECT issue, count(*) AS messages FROM i GROUP BY issue UNION ALL SELECT 'any', count(DISTINCT message_key) FROM i")
def problem_report(spark, sf):
    """Issues with their messages, and the number of messages with any."""
    return D.problem_report(M.from_orders(spark, sf))


@query(f"""WITH {M.SQL}, {_PROBLEMS} SELECT message_key, status, coalesce(updated_at, created_at) AS changed_at, coalesce({_OVERDUE}, false) AS sla_overdue FROM m WHERE message_key IN (SELECT message_key FROM i) ORDER BY coalesce(updated_at, created_at) DESC, message_key DESC LIMIT 20""")
def problem_sample(spark, sf):
    """A3: the newest messages with a problem."""
    return D.problem_sample(M.from_orders(spark, sf)).select("message_key", "status", "changed_at", F.coalesce("sla_overdue", F.lit(False)).alias("sla_overdue"))


@query(f"""WITH {M.SQL}, t AS (SELECT *, coalesce(thread_id, 'message:' || message_key) AS tid FROM m)
SELECT tid AS thread_id, count(*) AS messages, min(created_at) AS first_at, max(coalesce(updated_at, created_at)) AS last_at, array_to_string(list_sort(list(DISTINCT sender_email)), '|') AS participants, array_to_string(list_sort(list(DISTINCT subject)), '|') AS subjects,
 array_to_string(list_sort(list(DISTINCT status)), '|') AS statuses, coalesce(array_to_string(list_sort(list(DISTINCT priority) FILTER (WHERE priority IS NOT NULL)), '|'), '') AS priorities, coalesce(array_to_string(list_sort(list(DISTINCT risk) FILTER (WHERE risk IS NOT NULL)), '|'), '') AS risks,
 bool_or(has_conflicts) AS has_conflicts, bool_or({_OVERDUE}) AS sla_overdue, array_to_string(list_sort(list(message_key)), '|') AS keys FROM t GROUP BY tid""")
def thread_report(spark, sf):
    """A4: threads with all of their lists and flags."""
    return D.threads(M.from_orders(spark, sf))


@query(f"""WITH {_DELIVERIES} SELECT 'status' AS section, status AS value, count(*) AS n FROM d GROUP BY 2 UNION ALL SELECT 'response', CAST(response_status AS VARCHAR), count(*) FROM d WHERE response_status IS NOT NULL GROUP BY 2
UNION ALL SELECT 'failure', last_error, count(*) FROM d WHERE last_error IS NOT NULL GROUP BY 2""")
def delivery_report(spark, sf):
    """A5: statuses, response codes and reasons."""
    return D.delivery_report(deliveries(spark, sf))


@query(f"WITH {_DELIVERIES} SELECT key, last_error, created_at FROM d WHERE status = 'failed' ORDER BY created_at DESC, key LIMIT 5")
def delivery_failures(spark, sf):
    """A5: the latest failures."""
    return D.recent_failures(deliveries(spark, sf).withColumn("updated_at", F.col("created_at"))).select("key", "last_error", "created_at")


@query("""WITH f AS (SELECT l_orderkey, CASE l_linenumber % 4 WHEN 0 THEN upper(p_brand) WHEN 1 THEN ' ' || replace(p_brand, '#', ' # ') || ' ' WHEN 2 THEN lower(replace(p_brand, '#', '-#')) ELSE CASE l_linenumber % 3 WHEN 0 THEN 'N/A' WHEN 1 THEN '12-3' ELSE 'x@y.com' END END AS b
 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 13 <> 0),
t AS (SELECT regexp_replace(regexp_replace(trim(regexp_replace(b, '\\s+', ' ', 'g')), '\\s*/\\s*', ' / ', 'g'), '\\s*-\\s*', '-', 'g') AS b FROM f WHERE NOT regexp_matches(b, '^(12-3|x@y.com)$')),
g AS (SELECT regexp_replace(upper(b), '[.\\s/_-]+', '', 'g') AS k, b, count(*) AS n FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY b <> upper(b), -length(b), b) AS rn, CAST(sum(n) OVER (PARTITION BY k) AS BIGINT) AS total FROM g)
SELECT b AS brand, total AS n FROM r WHERE rn = 1 AND k <> 'BRAND#13'""")
def brand_dashboard(spark, sf):
    """Brands in several spellings, under a representative one; own names, numbers and addresses are none ("N/A" is one, as slashes are spaced before it is looked up)."""
    li, p, n = table(spark, sf, "lineitem"), table(spark, sf, "part"), F.col("l_linenumber")
    noise = F.when(n % 3 == 0, "N/A").when(n % 3 == 1, "12-3").otherwise("x@y.com")
    spelled = F.when(n % 4 == 0, F.upper("p_brand")).when(n % 4 == 1, F.concat(F.lit(" "), F.replace("p_brand", F.lit("#"), F.lit("  # ")), F.lit(" "))).when(n % 4 == 2, F.lower(F.replace("p_brand", F.lit("#"), F.lit(" - #")))).otherwise(noise)
    m = li.join(p, li.l_partkey == p.p_partkey).select(F.when(F.col("l_orderkey") % 13 == 0, "ignored_spam").otherwise("review").alias("status"), F.array(spelled).alias("brands"))
    return D.brand_counts(m, ("Brand#13", "brand # 13", "brand-#13"))


def _kept(spark, sf):
    """Messages, deliveries, runs, analyses and keys of projects, as one table."""
    row = lambda df, kind, project, at, key: df.select(F.lit(kind).alias("kind"), project.alias("project_id"), at.alias("created_at"), key.cast("string").alias("key"))
    o, e = table(spark, sf, "orders"), table(spark, sf, "events")
    out = row(o, "message", F.lit("p"), F.col("o_orderdate"), F.col("o_orderkey"))
    for kind, mod in (("delivery", 1), ("run", 3), ("idempotency_key", 50), ("note", 2)):
        out = out.unionByName(row(e, kind, F.concat(F.lit("p"), (F.col("event_id") % mod).cast("string")), F.col("ts"), F.col("event_id")))
    return out


@query("""WITH r AS (SELECT 'message' AS kind, 'p' AS project_id, o_orderdate AS created_at, CAST(o_orderkey AS VARCHAR) AS key FROM orders UNION ALL
 SELECT kind, 'p' || CAST(event_id % mod AS VARCHAR), ts, CAST(event_id AS VARCHAR) FROM events, (VALUES ('delivery', 1), ('run', 3), ('idempotency_key', 50), ('note', 2)) v(kind, mod)),
n AS (SELECT *, row_number() OVER (PARTITION BY kind, project_id ORDER BY created_at DESC, key) AS rn FROM r) SELECT kind, project_id, key FROM n WHERE rn <= CASE kind WHEN 'message' THEN 5000 WHEN 'delivery' THEN 5000 WHEN 'run' THEN 10 WHEN 'idempotency_key' THEN 20 ELSE 1000000000 END""")
def project_retention(spark, sf):
    """The caps of a project's store; kinds without a cap stay."""
    return D.retained(_kept(spark, sf)).select("kind", "project_id", "key")


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderdate AS t FROM orders UNION ALL SELECT -event_id, ts FROM events), n AS (SELECT *, row_number() OVER (ORDER BY t DESC, CAST(k AS VARCHAR)) AS rn FROM a) SELECT k, t FROM n WHERE rn <= 5000""")
def newest_messages(spark, sf):
    """New and existing messages together, the newest 5,000 of the project."""
    new = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("t"))
    both = new.unionByName(table(spark, sf, "events").select((-F.col("event_id")).alias("k"), F.col("ts").alias("t")))
    return D.retained(both.withColumns({"project_id": F.lit("p"), "kind": F.lit("message"), "key": F.col("k").cast("string")}), at="t").select("k", "t")


def _audit(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("m"), (F.col("event_id") % 40).cast("string")).alias("email_id"), F.col("user_id"), F.col("event_type").alias("action"), F.col("ts").alias("created_at"))


_AUDIT = "a AS (SELECT event_id AS id, 'm' || CAST(event_id % 40 AS VARCHAR) AS email_id, user_id, event_type AS action, ts AS created_at FROM events)"
for _name, _filter, _sql in (
    ("audit_of_mail", {"email": "m7", "skip": 3, "take": 20}, "email_id = 'm7' ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 3"),
    ("audit_of_user", {"user": 12}, "user_id = 12 ORDER BY created_at DESC, id DESC LIMIT 50"),
    ("audit_of_action", {"action": "error", "since": "2024-01-12 00:00:00", "take": 30}, "action = 'error' AND created_at >= TIMESTAMP '2024-01-12' ORDER BY created_at DESC, id DESC LIMIT 30"),
):
    QUERIES[_name] = lambda spark, sf, f=_filter: D.audit_page(_audit(spark, sf), **f)
    ORACLE[_name] = f"WITH {_AUDIT} SELECT * FROM a WHERE {_sql}"


def _rules(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    return p.select(k.alias("id"), F.when(k % 2 == 0, "subject").otherwise("body").alias("scope"), F.get(F.array(*map(F.lit, ("client", "spam", "vendor"))), (k % 3).cast("int")).alias("classifier"), F.col("p_size").alias("weight"), (k % 5 != 0).alias("is_active"))


_RULES = "r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'subject' ELSE 'body' END AS scope, ['client', 'spam', 'vendor'][1 + p_partkey % 3] AS classifier, p_size AS weight, p_partkey % 5 <> 0 AS is_active FROM part)"
for _name, _filter, _sql in (
    ("templates_all", {}, "true"), ("templates_filtered", {"scope": "subject", "classifier": "spam", "is_active": True, "skip": 5, "take": 25}, "scope = 'subject' AND classifier = 'spam' AND is_active"), ("templates_inactive", {"is_active": False}, "NOT is_active"),
):
    QUERIES[_name] = lambda spark, sf, f=_filter: D.templates(_rules(spark, sf), **f)
    ORACLE[_name] = f"WITH {_RULES} SELECT *, (SELECT count(*) FROM r WHERE {_sql}) AS total FROM r WHERE {_sql} ORDER BY classifier, weight DESC, id LIMIT {_filter.get('take', 50)} OFFSET {_filter.get('skip', 0)}"


def _clients(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    return c.select(k.alias("id"), F.col("c_name").alias("legal_name"), F.when(k % 3 != 0, F.lpad(k.cast("string"), 10, "7")).alias("inn"), F.concat(F.lower("c_mktsegment"), F.lit(".example")).alias("domain"))


_CLIENTS = "c AS (SELECT c_custkey AS id, c_name AS legal_name, CASE WHEN c_custkey % 3 <> 0 THEN lpad(CAST(c_custkey AS VARCHAR), 10, '7') END AS inn, lower(c_mktsegment) || '.example' AS domain FROM customer)"
for _name, _filter, _sql in (
    ("clients_with_inn", {"has_inn": True}, "inn IS NOT NULL"), ("clients_without_inn", {"search": "BUILD", "has_inn": False}, "inn IS NULL AND (contains(lower(legal_name), 'build') OR contains(domain, 'build'))"),
    ("clients_search", {"search": "77712"}, "contains(lower(legal_name), '77712') OR coalesce(contains(inn, '77712'), false) OR contains(domain, '77712')"),
):
    QUERIES[_name] = lambda spark, sf, f=_filter: D.clients(_clients(spark, sf), **f)
    ORACLE[_name] = f"WITH {_CLIENTS} SELECT * FROM c WHERE {_sql}"


_SUBSCRIBERS = (("c1", True, "https://a.example", ["p1", "p2"], ["review", "ready_for_crm"]), ("c2", True, "https://b.example", [], ["ignored_spam"]), ("c3", False, "https://c.example", [], ["review"]), ("c4", True, "", ["p1"], ["review"]), ("c5", True, "https://d.example", None, ["review", "review"]), ("c6", True, "https://e.example", ["p9"], ["review"]))


@query(f"""WITH {M.SQL_BASE}, s(client_id, project, st) AS (VALUES ('c1', 'p1', 'review'), ('c1', 'p1', 'ready_for_crm'), ('c1', 'p2', 'review'), ('c1', 'p2', 'ready_for_crm'), ('c2', NULL, 'ignored_spam'), ('c5', NULL, 'review'), ('c6', 'p9', 'review'))
SELECT message_key, client_id FROM b JOIN s ON st = status AND (project IS NULL OR project = project_id)""")
def webhook_scope(spark, sf):
    """2.17: which client is told of which message."""
    subscribers = spark.createDataFrame(list(_SUBSCRIBERS), "client_id string, enabled boolean, url string, projects array<string>, statuses array<string>")
    return D.webhook_targets(M.from_orders(spark, sf, lines=False), subscribers)


@query(f"""WITH {_INBOX}, n AS (SELECT project_id, message_key, CAST(row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, message_key) AS INTEGER) AS place FROM x WHERE status <> 'ignored_spam' AND coalesce(label, '') <> 'spam' AND NOT coalesce(llm_done, false))
SELECT * FROM n WHERE place <= 30""")
def llm_backlog(spark, sf):
    """30 unread messages of each project."""
    return D.backlog(_inbox_messages(spark, sf)).select("project_id", "message_key", "place")


_LONG = (
    ("sender_email", "sender_email"), ("sender_name", "CASE WHEN id % 2 = 0 THEN 'P ' || company ELSE '' END"), ("sender_position", "CASE WHEN id % 5 = 0 THEN 'buyer' END"), ("company_name", "company"), ("website", "'w' || CAST(id % 3 AS VARCHAR)"), ("city_phone", "NULL"),
    ("mobile_phone", "phone"), ("inn", "inn"), ("request_type", "CASE WHEN id % 3 = 0 THEN 'order' ELSE '' END"), ("articles", "array_to_string(articles, '|')"), ("brands", "array_to_string(brands, '|')"),
)


@query(f"""WITH {M.SQL}, g AS (SELECT * FROM m WHERE status <> 'ignored_spam'), l AS ({" UNION ALL ".join(f"SELECT message_key, '{n}' AS field_name, CAST({c} AS VARCHAR) AS field_value, confidence FROM g" for n, c in _LONG)})
SELECT * FROM l WHERE coalesce(field_value, '') <> '' UNION ALL SELECT message_key, 'inn', 'old', 0.5 FROM m WHERE status = 'ignored_spam'""")
def extracted_long(spark, sf):
    """All eleven fields as rows; old rows of a message that comes again are replaced."""
    m, k = M.from_orders(spark, sf), F.col("id")
    named = m.select(
        "message_key", "status", "confidence", "sender_email", F.when(k % 2 == 0, F.concat(F.lit("P "), "company")).otherwise("").alias("sender_name"), F.when(k % 5 == 0, "buyer").alias("sender_position"), F.col("company").alias("company_name"),
        F.concat(F.lit("w"), (k % 3).cast("string")).alias("website"), F.lit(None).cast("string").alias("city_phone"), F.col("phone").alias("mobile_phone"), "inn", F.when(k % 3 == 0, "order").otherwise("").alias("request_type"),
        F.array_join("articles", "|").alias("articles"), F.array_join("brands", "|").alias("brands"),
    )
    old = m.select("message_key", F.lit("inn").alias("field_name"), F.lit("old").alias("field_value"), F.lit(0.5).alias("confidence"))
    return D.extracted_fields(named, old)


@query("""WITH i AS (SELECT l_orderkey AS message, l_linenumber * 1000000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS pos, CASE WHEN l_linenumber % 2 = 0 THEN 'art' ELSE 'ART' END || CAST(l_suppkey % 3 AS VARCHAR) AS article, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 'Bolt' END AS description,
 CASE CAST(l_quantity AS INTEGER) % 4 WHEN 0 THEN 1.0 WHEN 1 THEN NULL ELSE l_quantity END AS quantity FROM lineitem),
k AS (SELECT *, upper(article || '|' || coalesce(description, '')) AS k FROM i),
f AS (SELECT message, k, min(pos) AS pos, min(pos) FILTER (WHERE quantity <> 1) AS other, bool_or(quantity = 1) AS one FROM k GROUP BY 1, 2)
SELECT f.message, a.article, a.description, CASE WHEN a.quantity <> 1 THEN a.quantity WHEN b.quantity IS NOT NULL THEN b.quantity WHEN f.one THEN 1.0 ELSE a.quantity END AS quantity
FROM f JOIN k a ON a.message = f.message AND a.k = f.k AND a.pos = f.pos LEFT JOIN k b ON b.message = f.message AND b.k = f.k AND b.pos = f.other""")
def attachment_item_dedup(spark, sf):
    """Items by article and description in any case."""
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    article = F.concat(F.when(n % 2 == 0, "art").otherwise("ART"), (s % 3).cast("string"))
    q = F.col("l_quantity").cast("int") % 4
    quantity = F.when(q == 0, 1.0).when(q == 1, None).otherwise(F.col("l_quantity"))
    return D.merged_items(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("message"), (n * F.lit(10**12) + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("pos"), article.alias("article"), F.when(s % 5 != 0, "Bolt").alias("description"), quantity.alias("quantity")))


_CHANGES = (("status", "id % 3 = 0"), ("brands", "id % 4 = 0 AND len(brands) > 0"), ("articles", "false"), ("inn", "inn IS NOT NULL AND id % 5 = 0"), ("kpp", "id % 7 = 0"), ("ogrn", "id % 11 = 0"), ("city_phone", "phone IS NOT NULL AND id % 6 = 0"), ("mobile_phone", "id % 9 = 0"))


@query(f"WITH {M.SQL} SELECT message_key, array_to_string(list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _CHANGES)}], lambda x: x IS NOT NULL), '|') AS changed FROM m")
def analysis_changes(spark, sf):
    """Which of the eight fields an analysis changes."""
    m, k = M.from_orders(spark, sf), F.col("id")
    none = F.lit(None).cast("string")
    first = m.select("message_key", "status", "brands", "articles", "inn", none.alias("kpp"), F.lit("o").alias("ogrn"), F.col("phone").alias("city_phone"), F.col("message_key").alias("mobile_phone"))
    then = m.select(
        "message_key", F.when(k % 3 == 0, "changed").otherwise(F.col("status")).alias("status"), F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.col("brands")).alias("brands"), "articles",
        F.when(k % 5 != 0, F.col("inn")).alias("inn"), F.when(k % 7 == 0, "k").alias("kpp"), F.when(k % 11 != 0, "o").alias("ogrn"), F.when(k % 6 != 0, F.col("phone")).alias("city_phone"), F.when(k % 9 == 0, "x").otherwise(F.col("message_key")).alias("mobile_phone"),
    )
    return D.analysis_diff(first, then).select("message_key", F.array_join("changed", "|").alias("changed"))


def _csv_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches(coalesce({c}, ''), '[\",\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE coalesce({c}, '') END"


_EXPORT = (
    "project_id", "message_key", "coalesce(thread_id, 'message:' || message_key)", "strftime(created_at, '%Y-%m-%dT%H:%M:%S')", "strftime(updated_at, '%Y-%m-%dT%H:%M:%S')", "status", "brands[1]", "subject || ', \"q\"'", "sender_email", "label", "CAST(CAST(confidence AS DOUBLE) AS VARCHAR)",
    "company", "inn", "phone", "array_to_string(articles, '|')", "array_to_string(names, '|')", "priority", "risk", f"CAST({_OVERDUE} AS VARCHAR)", "CAST(has_conflicts AS VARCHAR)", "CAST(confirmed_at IS NOT NULL AS VARCHAR)", "CAST(acked_crm IS NOT NULL AS VARCHAR)",
    "CAST(customer_id AS VARCHAR)", "company",
)


@query(f"WITH {M.SQL} SELECT message_key AS key, concat_ws(',', {', '.join(map(_csv_sql, _EXPORT))}) AS line FROM m")
def csv_messages(spark, sf):
    """All 24 columns."""
    m = M.from_orders(spark, sf)
    rows = m.select(
        "project_id", "message_key", F.coalesce("thread_id", F.concat(F.lit("message:"), F.col("message_key"))).alias("thread_id"), "created_at", "updated_at", F.col("status").alias("pipeline_status"), F.get("brands", F.lit(0)).alias("brand"),
        F.concat("subject", F.lit(', "q"')).alias("subject"), F.col("sender_email").alias("from"), F.col("label").alias("classification_label"), F.col("confidence").alias("classification_confidence"), F.col("company").alias("company_name"), "inn", "phone", "articles",
        F.col("names").alias("product_names"), "priority", F.col("risk").alias("risk_level"), F.coalesce(sla_overdue(), F.lit(False)).alias("sla_overdue"), "has_conflicts", F.col("confirmed_at").isNotNull().alias("recognition_confirmed"), F.col("acked_crm").isNotNull().alias("exported"),
        F.col("customer_id").alias("crm_company_id"), F.col("company").alias("crm_company_name"),
    )
    return E.csv_rows(rows, E.MESSAGE_COLUMNS, "message_key")


@query(f"""WITH {_DELIVERIES} SELECT key, concat_ws(',', 'delivery:' || key, strftime(created_at, '%Y-%m-%dT%H:%M:%S'), 'delivery', 'webhook', '', message_key, '', key, status, '', client_id, '', {_csv_sql("last_error || ', \"' || status || '\"'")}) AS line FROM d""")
def csv_events(spark, sf):
    """All 13 columns of the event export."""
    d = deliveries(spark, sf)
    rows = d.select(
        F.concat(F.lit("delivery:"), "key").alias("id"), F.col("created_at").alias("at"), F.lit("delivery").alias("scope"), F.lit("webhook").alias("type"), "message_key", F.col("key").alias("delivery_id"), "status",
        F.col("client_id").alias("consumer"), F.concat("last_error", F.lit(', "'), "status", F.lit('"')).alias("summary"),
    )
    return E.csv_rows(rows, E.EVENT_COLUMNS, "delivery_id")


@query(f"""WITH {_DELIVERIES} SELECT key AS id, client_id, CAST(NULL AS VARCHAR) AS client_name, key, CAST(NULL AS VARCHAR) AS event, message_key, CAST(NULL AS VARCHAR) AS pipeline_status, status, attempts, created_at, CAST(NULL AS VARCHAR) AS updated_at, CAST(NULL AS VARCHAR) AS next_attempt_at,
 CAST(NULL AS VARCHAR) AS last_attempt_at, CAST(NULL AS VARCHAR) AS delivered_at, last_error, response_status, CAST(NULL AS VARCHAR) AS last_manual_action FROM d""")
def delivery_names(spark, sf):
    """Deliveries under the interface's names."""
    d = deliveries(spark, sf)
    back = {v: k for k, v in E.DELIVERY_NAMES.items()}
    stored = d.select(F.col("key").alias("id"), *(F.col(c).alias(back[c]) for c in d.columns))
    return E.delivery_names(stored)


@query("""SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'purchase')""")
def sheet_sink(spark, sf):
    """A stream's batches are appended row by row once, also if a batch comes again."""
    path, state = new_path(spark, "sheet"), new_path(spark, "sheet-state")
    e = table(spark, sf, "events")
    files = new_path(spark, "sheet-in")
    e.where("event_type IN ('error', 'purchase')").select("event_id", "event_type").repartition(3).write.parquet(files)

    def sink(batch: DataFrame, n: int) -> None:
        E.append_new(batch, path, "event_id", 1000)
        E.append_new(batch, path, "event_id", 1000)  # the same batch again

    stream = spark.readStream.schema("event_id long, event_type string").option("maxFilesPerTrigger", 1).parquet(files)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)
