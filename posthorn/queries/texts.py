"""Text structure, extraction, classification and search over documents and pages (T, E, K, X)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posthorn.functions import articles as A
from posthorn.functions import text as T
from posthorn.operators import classify as C
from posthorn.operators import fts
from posthorn.operators import matching as X
from posthorn.plans import messages as M
from posthorn.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_T = "coalesce(text, '')"


@query("""SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages""")
def html_title(spark, sf):
    """The title of each page."""
    return table(spark, sf, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


@query("""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<head[^>]*>.*?</head>', ' ', 'gs'), '<!--.*?-->', ' ', 'gs') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '<br */?>|</(p|div|tr|li|h[1-6]|table|ul|ol|nav|footer|article) *>', chr(10), 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM b),
d AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda l: trim(regexp_replace(l, '[ \t\r]+', ' ', 'g'))), lambda l: l <> '') AS ls FROM c)
SELECT page_id, array_to_string(ls, chr(10)) AS text FROM d""")
def html_strip(spark, sf):
    """Pages as plain text."""
    return table(spark, sf, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query("""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') AS host FROM pages), p AS (SELECT *, string_split(host, '.') AS a FROM h)
SELECT page_id, CASE WHEN len(a) < 2 THEN host ELSE a[len(a) - 1] || '.' || a[len(a)] END AS root FROM p""")
def url_root_domain(spark, sf):
    """The registrable domain of each url."""
    return table(spark, sf, "pages").select("page_id", X.root_domain(F.parse_url("url", F.lit("HOST"))).alias("root"))


@query(f"""WITH c AS (SELECT doc_id, length({_T}) - length(regexp_replace({_T}, '[А-Яа-яЁё]', '', 'g')) AS cy, length({_T}) - length(regexp_replace({_T}, '[A-Za-z]', '', 'g')) AS la FROM documents)
SELECT doc_id, CASE WHEN cy + la = 0 THEN 'unknown' WHEN cy / (cy + la) > 0.3 THEN 'ru' ELSE 'en' END AS language FROM c""")
def lang_detect_ratio(spark, sf):
    """T13."""
    return table(spark, sf, "documents").select("doc_id", T.language(F.coalesce("text", F.lit(""))).alias("language"))


@query(f"""SELECT doc_id, array_to_string(list_distinct_in_order, '|') AS emails FROM (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_in_order FROM
(SELECT doc_id, list_transform(regexp_extract_all({_T}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{{2,}}'), lambda x: lower(x)) AS l FROM documents) a) b WHERE len(list_distinct_in_order) > 0""")
def email_extract(spark, sf):
    """Addresses in documents."""
    d = table(spark, sf, "documents").select("doc_id", T.emails(F.col("text")).alias("e"))
    return d.where(F.size("e") > 0).select("doc_id", F.array_join("e", "|").alias("emails"))


@query("""WITH e AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'info' WHEN 1 THEN 'noreply' WHEN 2 THEN 'user7' WHEN 3 THEN 'anna.k' ELSE 'zakaz' END || '@' || CASE WHEN c_custkey % 2 = 0 THEN 'gmail.com' ELSE 'firm.example' END AS email FROM customer)
SELECT id, CASE WHEN split_part(email, '@', 1) IN ('info', 'sales', 'office', 'admin', 'support', 'order', 'zakaz') THEN 'generic' WHEN regexp_matches(email, '^(no-?reply|robot|mailer)') THEN 'service' WHEN regexp_matches(split_part(email, '@', 1), '[0-9]') THEN 'numbered' ELSE 'personal' END AS local_kind,
split_part(email, '@', 2) IN ('gmail.com', 'mail.ru', 'yandex.ru', 'outlook.com', 'yahoo.com', 'hotmail.com') AS free FROM e""")
def email_classify_parts(spark, sf):
    """Kind of the local part and of the domain."""
    k = F.col("c_custkey") % 5
    local = F.when(k == 0, "info").when(k == 1, "noreply").when(k == 2, "user7").when(k == 3, "anna.k").otherwise("zakaz")
    email = F.concat_ws("@", local, F.when(F.col("c_custkey") % 2 == 0, "gmail.com").otherwise("firm.example"))
    e = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), email.alias("email"))
    return e.select("id", T.local_kind(F.col("email")).alias("local_kind"), F.substring_index("email", "@", -1).isin(*X.FREE_DOMAINS).alias("free"))


@query(f"""SELECT doc_id, p AS phone FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all({_T}, '\\+1 \\([0-9]{{3}}\\) [0-9]{{3}}-[0-9]{{4}}'))) AS p FROM documents) x""")
def phone_extract(spark, sf):
    """Telephone numbers in documents."""
    return table(spark, sf, "documents").select("doc_id", F.explode(T.phones(F.col("text"))).alias("phone"))


@query("""WITH n AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '8' || lpad(CAST(c_custkey AS VARCHAR), 10, '4') WHEN 1 THEN '9' || lpad(CAST(c_custkey AS VARCHAR), 9, '1') WHEN 2 THEN '+44 ' || lpad(CAST(c_custkey AS VARCHAR), 8, '2') ELSE '12' END AS raw FROM customer),
d AS (SELECT id, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM n), o AS (SELECT *, CASE WHEN regexp_matches(d, '^[78][0-9]{10}$') THEN substr(d, 2, 10) WHEN regexp_matches(d, '^9[0-9]{9}$') THEN d END AS o FROM d)
SELECT id, CASE WHEN o IS NOT NULL THEN '+7 (' || substr(o, 1, 3) || ') ' || substr(o, 4, 3) || '-' || substr(o, 7, 2) || '-' || substr(o, 9, 2) WHEN length(d) BETWEEN 7 AND 15 THEN '+' || d END AS phone FROM o""")
def phone_normalise(spark, sf):
    """One written form."""
    k, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    raw = F.when(k % 4 == 0, F.concat(F.lit("8"), F.lpad(s, 10, "4"))).when(k % 4 == 1, F.concat(F.lit("9"), F.lpad(s, 9, "1"))).when(k % 4 == 2, F.concat(F.lit("+44 "), F.lpad(s, 8, "2"))).otherwise("12")
    return table(spark, sf, "customer").select(k.alias("id"), T.normal_phone(raw).alias("phone"))


@query("""WITH r AS (SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN '01.02.2024' WHEN 1 THEN '123456' WHEN 2 THEN '1234567890123' WHEN 3 THEN '123456789' WHEN 4 THEN '12' ELSE '4951234567' END AS raw FROM customer)
SELECT id, CASE WHEN raw = '01.02.2024' THEN 'date' WHEN length(raw) = 6 THEN 'postal' WHEN length(raw) = 13 THEN 'ogrn' WHEN length(raw) = 9 THEN 'kpp' WHEN length(raw) = 2 THEN 'length' END AS reason FROM r""")
def phone_rejects(spark, sf):
    """Why a digit group is no telephone number."""
    k = F.col("c_custkey") % 6
    raw = F.when(k == 0, "01.02.2024").when(k == 1, "123456").when(k == 2, "1234567890123").when(k == 3, "123456789").when(k == 4, "12").otherwise("4951234567")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), T.phone_reject(raw).alias("reason"))


@query("""WITH t AS (SELECT c_custkey AS id, 'Firma INN: ' || lpad(CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 2 = 0 THEN 10 ELSE 12 END, '7') || ', KPP ' || lpad(CAST(c_custkey AS VARCHAR), 9, '5') AS body FROM customer),
x AS (SELECT id, nullif(regexp_extract(body, 'INN: ([0-9]+)', 1), '') AS inn, nullif(regexp_extract(body, 'KPP ([0-9]+)', 1), '') AS kpp FROM t) SELECT id, inn, kpp, CASE length(inn) WHEN 10 THEN 'RU_ORG' WHEN 12 THEN 'RU_IP' END AS kind FROM x""")
def requisites(spark, sf):
    """Tax numbers behind their labels, and the kind by length."""
    k, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    body = F.concat(F.lit("Firma INN: "), F.when(k % 2 == 0, F.lpad(s, 10, "7")).otherwise(F.lpad(s, 12, "7")), F.lit(", KPP "), F.lpad(s, 9, "5"))
    r = table(spark, sf, "customer").select(k.alias("id"), T.requisites(body).alias("r"))
    return r.select("id", "r.inn", "r.kpp", T.tax_kind(F.col("r.inn")).alias("kind"))


@query()
def article_extract(spark, sf):
    """Articles of whole documents, and what was rejected and why; see article_reasons and articles_of_mails for SQL."""
    a = table(spark, sf, "documents").select("doc_id", A.extract({"current": F.col("text")}).alias("a")).select("doc_id", "a.*")
    kept = a.select("doc_id", F.explode("articles").alias("value"), F.lit(None).cast("string").alias("reason"))
    return kept.unionByName(a.select("doc_id", F.explode("rejected").alias("r")).select("doc_id", "r.value", "r.reason"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS quantity, 'pcs' AS unit FROM lineitem""")
def quantity_extract(spark, sf):
    """Quantities read back from all written line items."""
    return _quantities(table(spark, sf, "lineitem"))


def _quantities(li):
    body = F.concat(F.lit("Pos "), F.col("l_linenumber").cast("string"), F.lit(": ART-"), F.col("l_partkey").cast("string"), F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit(" шт"))
    q = li.select("l_orderkey", "l_linenumber", "l_partkey", F.get(T.quantities(body), F.lit(0)).alias("q"))
    return q.select("l_orderkey", "l_linenumber", "l_partkey", "q.quantity", "q.unit")


@query(f"""WITH t AS (SELECT doc_id, {_T} AS own, CASE WHEN doc_id % 2 = 0 THEN chr(10) || '> ' || replace({_T}, chr(10), chr(10) || '> ') ELSE '' END AS q FROM documents)
SELECT doc_id, len(string_split(own || q, chr(10))) AS lines, length(own) AS current_chars, CASE WHEN q = '' THEN 0 ELSE length(q) - 1 END AS quoted_chars FROM t""")
def mail_zones(spark, sf):
    """Every second document answers itself, its own text quoted below."""
    own = F.coalesce("text", F.lit(""))
    quoted = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n> "), F.replace(own, F.lit("\n"), F.lit("\n> ")))).otherwise("")
    whole = F.concat(own, quoted)
    z = table(spark, sf, "documents").select("doc_id", F.size(T.lines(whole)).cast("long").alias("lines"), T.split_quoted(whole).alias("z"))
    return z.select("doc_id", "lines", F.length("z.current").cast("long").alias("current_chars"), F.length("z.quoted").cast("long").alias("quoted_chars"))


@query(f"""WITH {M.SQL_BASE} SELECT message_key, lower(trim(regexp_replace(CASE WHEN id % 2 = 0 THEN 'Re: Fwd: ' ELSE '' END || subject, '^(Re: Fwd: )', ''))) AS topic FROM b""")
def subject_normalise(spark, sf):
    """Subjects without reply marks."""
    m = M.from_orders(spark, sf, lines=False)
    s = F.concat(F.when(F.col("id") % 2 == 0, "Re: Fwd: ").otherwise(""), F.col("subject"))
    return m.select("message_key", T.plain_subject(s).alias("topic"))


_RULES = (
    (1, "client", "contains", "order", 3), (2, "client", "contains", "furniture", 2), (3, "spam", "contains", "5-low", 4), (4, "spam", "regex", "order [0-9]*7 ", 3),
    (5, "vendor", "contains", "machinery", 5), (6, "vendor", "regex", "building p$", 9), (7, "client", "exact", "order 1 1-urgent building o", 50),
)


@query(f"""WITH {M.SQL_BASE}, t AS (SELECT message_key, lower(concat_ws(' ', subject, preview)) AS t FROM b),
s AS (SELECT message_key, CASE WHEN contains(t, 'order') THEN 3 ELSE 0 END + CASE WHEN contains(t, 'furniture') THEN 2 ELSE 0 END + CASE WHEN t = 'order 1 1-urgent building o' THEN 50 ELSE 0 END AS c,
 CASE WHEN contains(t, '5-low') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, 'order [0-9]*7 ') THEN 3 ELSE 0 END AS s, CASE WHEN contains(t, 'machinery') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(t, 'building p$') THEN 9 ELSE 0 END AS v FROM t),
g AS (SELECT *, greatest(c, s, v) AS top, c + s + v AS total, CAST(c = greatest(c, s, v) AS INTEGER) + CAST(s = greatest(c, s, v) AS INTEGER) + CAST(v = greatest(c, s, v) AS INTEGER) AS w FROM s)
SELECT message_key, CASE WHEN top <= 0 OR (w > 1 AND top < 4) THEN 'unknown' WHEN c = top THEN 'client' WHEN s = top THEN 'spam' ELSE 'vendor' END AS label,
 CASE WHEN top = 0 THEN 0.35 ELSE least(0.99, round(0.45 + 0.5 * top / greatest(total, 1), 2)) END AS confidence FROM g""")
def rule_classify(spark, sf):
    """Rules as a table, scores, label and confidence."""
    rules = spark.createDataFrame(list(_RULES), "rule_id int, classifier string, match_type string, pattern string, weight int")
    m = M.from_orders(spark, sf, lines=False).select("message_key", F.concat_ws(" ", "subject", "preview").alias("text"))
    label, confidence = C.decide(C.class_scores(F.col("hits")))
    return C.rule_hits(m, rules).select("message_key", label.alias("label"), confidence.alias("confidence"))


_MAILS = """ml AS (SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN 'Re: Запрос' WHEN 1 THEN 'Заказ № 12' WHEN 2 THEN 'price list' WHEN 3 THEN 'x' ELSE 'hello' END AS subject,
 CASE o_orderkey % 8 WHEN 0 THEN 'Просим выставить счет срочно' WHEN 1 THEN 'purchase order attached' WHEN 2 THEN 'Предлагаем сотрудничество' WHEN 3 THEN 'рекламация' WHEN 4 THEN 'нужен ремонт, планируем на год' WHEN 5 THEN 'Подскажите, пожалуйста' ELSE 'nothing' END AS body,
 o_orderkey % 11 = 0 AS spam FROM orders)"""


@query(f"""WITH {_MAILS} SELECT id, CASE WHEN spam THEN 'spam' WHEN id % 9 = 0 THEN 'quotation' WHEN id % 9 = 1 THEN 'order' WHEN id % 9 = 2 OR id % 8 = 0 THEN 'quotation' WHEN id % 8 = 1 THEN 'order' WHEN id % 8 = 2 THEN 'vendor_offer'
WHEN id % 8 = 3 THEN 'complaint' WHEN id % 8 = 4 THEN 'service_request' WHEN id % 8 = 5 THEN 'info_request' END AS request_type, CASE id % 8 WHEN 0 THEN 'urgent' WHEN 4 THEN 'planned' ELSE 'normal' END AS urgency FROM ml""")
def request_type(spark, sf):
    """Request types of written subjects and bodies, and urgency."""
    k = F.col("o_orderkey")
    pick = lambda n, values, other: F.coalesce(F.get(F.array(*map(F.lit, values)), (k % n).cast("int")), F.lit(other))
    subject = pick(9, ("Re: Запрос", "Заказ № 12", "price list", "x"), "hello")
    bodies = ("Просим выставить счет срочно", "purchase order attached", "Предлагаем сотрудничество", "рекламация", "нужен ремонт, планируем на год", "Подскажите, пожалуйста")
    body = pick(8, bodies, "nothing")
    label = F.when(k % 11 == 0, "spam").otherwise("client")
    return table(spark, sf, "orders").select(k.alias("id"), C.request_type_of(subject, body, label).alias("request_type"), C.urgency_of(body).alias("urgency"))


@query(f"""WITH {M.SQL_BASE} SELECT message_key, CASE WHEN label = 'spam' THEN 'ignored_spam' WHEN label = 'client' AND (coalesce(risk = 'high', false) OR completeness < 20) THEN 'review' WHEN label = 'client' THEN 'ready_for_crm' WHEN inn IS NULL THEN 'needs_clarification' ELSE 'review' END AS server,
CASE WHEN id % 19 = 0 THEN 'fetch_error' WHEN label = 'spam' THEN 'ignored_spam' WHEN inn IS NULL THEN 'needs_clarification' WHEN label = 'client' THEN 'ready_for_crm' ELSE 'review' END AS runner,
CASE WHEN label = 'spam' THEN 'ignored_spam' WHEN label = 'client' THEN 'ready_for_crm' WHEN inn IS NULL THEN 'needs_clarification' ELSE 'review' END AS stored FROM b""")
def pipeline_status(spark, sf):
    """The three status functions."""
    m = M.from_orders(spark, sf, lines=False)
    facts = (F.col("label"), F.col("inn").isNull(), F.coalesce(F.col("risk") == "high", F.lit(False)), F.col("completeness") >= 20, F.col("id") % 19 == 0)
    return m.select("message_key", *(C.pipeline_status(*facts, v).alias(v) for v in ("server", "runner", "stored")))


@query(f"""WITH {M.SQL} SELECT message_key, CASE WHEN id % 17 = 0 THEN 'critical' WHEN priority = 'critical' OR n_attachments >= 5 OR total > 50000 THEN 'high' WHEN parsed_attachment OR len(articles) > 0 OR len(brands) > 0 THEN 'medium' ELSE 'low' END AS derived_priority,
CASE WHEN has_conflicts OR completeness < 50 OR confidence < 0.65 OR (inn IS NULL AND phone IS NULL) THEN 'high' WHEN completeness < 80 OR confidence < 0.8 OR inn IS NULL THEN 'medium' ELSE 'low' END AS derived_risk,
CASE WHEN len(brands) < 6 THEN 'normal' WHEN len(brands) <= 7 THEN 'warning' WHEN len(brands) <= 12 THEN 'suspicious' ELSE 'catalog' END AS brand_context FROM m""")
def risk_priority(spark, sf):
    """K13-K15."""
    m = M.from_orders(spark, sf)
    urgency = F.when(F.col("priority") == "critical", "urgent").otherwise("normal")
    no_inn, no_phone = F.col("inn").isNull(), F.col("phone").isNull()
    return m.select(
        "message_key",
        C.priority_of(F.col("id") % 17 == 0, urgency, F.col("n_attachments"), F.col("total"), F.col("parsed_attachment"), F.size("articles"), F.size("brands")).alias("derived_priority"),
        C.risk_of(F.col("has_conflicts"), F.col("completeness"), F.col("confidence"), no_inn & no_phone, no_inn).alias("derived_risk"),
        C.brand_context(F.size("brands")).alias("brand_context"),
    )


@query(f"""WITH {M.SQL}, g AS (SELECT message_key, CASE WHEN id % 2 = 0 THEN 'quotation' ELSE 'other' END AS rt, CASE WHEN id % 23 = 0 THEN '12x' ELSE inn END AS inn, CASE WHEN id % 29 = 0 THEN 'see www.x.example' ELSE company END AS company, phone, len(articles) AS products, confidence FROM m),
p AS (SELECT *, coalesce(trim(inn) <> '', false) AS hi, coalesce(trim(company) <> '', false) AS hc, coalesce(trim(phone) <> '', false) AS hp FROM g)
SELECT message_key, array_to_string(list_filter([CASE WHEN hi AND NOT regexp_matches(inn, '^([0-9]{{9}}|[0-9]{{10}}|[0-9]{{12}})$') THEN 'invalid_inn_format' END, CASE WHEN hc AND contains(company, 'www.') THEN 'dirty_company_name' END,
 CASE WHEN rt = 'quotation' AND NOT hc AND NOT hp THEN 'no_contact_info' END, CASE WHEN rt = 'quotation' AND products = 0 THEN 'no_product_signal' END, CASE WHEN confidence > 0 AND confidence < 0.5 AND NOT hi AND NOT hc THEN 'low_confidence_no_requisites' END], lambda x: x IS NOT NULL), '|') AS errors,
 CASE WHEN NOT hi AND NOT hp THEN 'no_phone_no_inn' ELSE '' END AS warnings FROM p""")
def quality_gate(spark, sf):
    """K17."""
    m = M.from_orders(spark, sf)
    inn = F.when(F.col("id") % 23 == 0, "12x").otherwise(F.col("inn"))
    company = F.when(F.col("id") % 29 == 0, "see www.x.example").otherwise(F.col("company"))
    request = F.when(F.col("id") % 2 == 0, "quotation").otherwise("other")
    errors, warnings = C.quality_gate(request, inn, company, F.lit(None).cast("string"), F.col("phone"), F.size("articles"), F.col("confidence"))
    return m.select("message_key", F.array_join(errors, "|").alias("errors"), F.array_join(warnings, "|").alias("warnings"))


@query(f"""WITH {M.SQL_BASE}, x AS (SELECT message_key, coalesce(label, 'unknown') AS l, confidence AS c, id FROM b)
SELECT message_key, CASE WHEN l = 'unknown' AND id % 3 = 0 THEN 'client' WHEN l = 'unknown' AND id % 3 = 1 THEN 'vendor' WHEN id % 3 = 2 AND l IN ('client', 'vendor') AND id % 5 <> 0 AND c < 0.85 THEN 'unknown' WHEN id % 3 = 1 AND l = 'client' THEN 'vendor' ELSE l END AS label,
CASE WHEN l = 'unknown' AND id % 3 <> 2 THEN 'raised' WHEN id % 3 = 2 AND l IN ('client', 'vendor') AND id % 5 <> 0 AND c < 0.85 THEN 'lowered' WHEN id % 3 = 2 AND l IN ('client', 'vendor') THEN 'disagreed' WHEN id % 3 = 1 AND l = 'client' THEN 'flipped' END AS change FROM x""")
def llm_relabel(spark, sf):
    """Labels after a cached language model's request type."""
    request = F.when(F.col("id") % 3 == 0, "order").when(F.col("id") % 3 == 1, "vendor_offer").otherwise("other")
    m = M.from_orders(spark, sf, lines=False)
    cache = m.select("message_key", request.alias("request"))  # stands for the cache's table
    r = C.relabel(F.coalesce("label", F.lit("unknown")), F.col("confidence"), F.col("request"), F.col("id") % 5 == 0)
    return m.join(cache, "message_key", "left").select("message_key", r.alias("r")).select("message_key", "r.label", "r.change")


@query(f"""WITH {M.SQL_BASE}, x AS (SELECT message_key, coalesce(label, 'unknown') AS l, confidence AS c, id, id % 31 = 0 AS auto, id % 37 = 0 AS resume, id % 7 = 0 AS form, id % 12 = 0 AS news, id % 12 = 1 AS outreach FROM b),
a AS (SELECT *, CASE WHEN auto THEN 'spam' ELSE l END AS l1, CASE WHEN auto THEN greatest(c, 0.92) ELSE c END AS c1 FROM x),
b2 AS (SELECT *, CASE WHEN resume AND l1 <> 'spam' THEN 'spam' ELSE l1 END AS l2, CASE WHEN resume AND l1 <> 'spam' THEN greatest(c1, 0.95) ELSE c1 END AS c2 FROM a),
c3 AS (SELECT *, CASE WHEN form AND NOT resume AND l2 = 'spam' THEN 'client' ELSE l2 END AS l3, CASE WHEN form AND NOT resume AND l2 = 'spam' THEN greatest(c2, 0.75) ELSE c2 END AS c3 FROM b2)
SELECT message_key, CASE WHEN NOT form AND l3 <> 'spam' AND news THEN 'spam' WHEN NOT form AND l3 = 'client' AND outreach THEN 'vendor' ELSE l3 END AS label,
round(CASE WHEN NOT form AND l3 <> 'spam' AND news THEN greatest(c3, 0.85) WHEN NOT form AND l3 = 'client' AND outreach THEN least(c3, 0.75) ELSE c3 END, 4) AS confidence FROM c3""")
def label_overrides(spark, sf):
    """K4: the override cascade."""
    k = F.col("id")
    text = F.when(k % 12 == 0, "please unsubscribe here").when(k % 12 == 1, "готовы сотрудничать").otherwise("a request")
    no = F.lit(False)
    r = C.overrides(F.coalesce("label", F.lit("unknown")), F.col("confidence"), text, k % 31 == 0, k % 37 == 0, k % 7 == 0, no, no)
    m = M.from_orders(spark, sf, lines=False).select("message_key", r.alias("r"))
    return m.select("message_key", "r.label", F.round("r.confidence", 4).alias("confidence"))


@query(f"""WITH {M.SQL_BASE} SELECT message_key, CASE WHEN id % 3 = 0 THEN 'ready_for_crm' WHEN id % 3 = 1 AND id % 2 = 0 THEN 'review' ELSE status END AS status FROM b""")
def moderation(spark, sf):
    """K21."""
    k = F.col("id")
    verdict = F.when(k % 3 == 0, "approved").when(k % 3 == 1, "needs_rework")
    comment = F.when(k % 2 == 0, "please check")
    return M.from_orders(spark, sf, lines=False).select("message_key", C.moderated(F.col("status"), verdict, comment).alias("status"))


@query(f"""WITH b AS (SELECT doc_id, lower({_T}) AS t FROM documents), s AS (SELECT doc_id, t, CAST(contains(t, 'unsubscribe') AS INTEGER) + CAST(contains(t, 'casino') AS INTEGER) + CAST(contains(t, 'winner') AS INTEGER) + CAST(contains(t, 'free money') AS INTEGER) AS spam,
CAST(contains(t, 'complain') AS INTEGER) + CAST(contains(t, 'defect') AS INTEGER) + CAST(contains(t, 'refund') AS INTEGER) AS co, CAST(contains(t, 'order') AS INTEGER) + CAST(contains(t, 'invoice') AS INTEGER) + CAST(contains(t, 'delivery') AS INTEGER) AS o,
CAST(contains(t, 'price') AS INTEGER) + CAST(contains(t, 'quote') AS INTEGER) + CAST(contains(t, 'question') AS INTEGER) AS i FROM b)
SELECT doc_id, CASE WHEN spam >= 2 THEN 'spam' WHEN regexp_matches(t, 'newsletter|digest') THEN 'newsletter' WHEN co >= 2 THEN 'complaint' WHEN o >= 2 THEN 'order' WHEN i >= 1 THEN 'inquiry' ELSE 'other' END AS label FROM s""")
def worker_classify(spark, sf):
    """K6."""
    return table(spark, sf, "documents").select("doc_id", C.worker_class(F.col("text"))[0].alias("label"))


@query(f"""WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower({_T}), '[^a-z0-9]+'), lambda w: w <> '')) AS ws FROM documents), a(alias, brand) AS (VALUES ('the', 'B1'), ('disgusting', 'B2'), ('pathetic', 'B2'), ('token', 'B3'))
SELECT doc_id, brand, count(*) AS aliases FROM (SELECT doc_id, unnest(ws) AS w FROM t) u JOIN a ON alias = w GROUP BY 1, 2""")
def dictionary_match(spark, sf):
    """Aliases of one word by an equi-join with the distinct words of a document."""
    a = spark.createDataFrame([("the", "B1"), ("disgusting", "B2"), ("pathetic", "B2"), ("token", "B3")], "alias string, brand string")
    w = table(spark, sf, "documents").select("doc_id", F.explode(X.word_set(F.col("text"))).alias("alias"))
    return w.join(F.broadcast(a), "alias").groupBy("doc_id", "brand").agg(F.count("*").alias("aliases"))  # four rows


@query(f"""WITH {M.SQL_BASE} SELECT message_key, CASE WHEN id % 31 = 0 THEN 'subject' WHEN id % 29 = 0 THEN 'sender' END AS auto_reply FROM b""")
def auto_reply(spark, sf):
    """T8."""
    m = M.from_orders(spark, sf, lines=False)
    subject = F.when(F.col("id") % 31 == 0, F.concat(F.lit("Automatic reply: "), F.col("subject"))).otherwise(F.col("subject"))
    sender = F.when(F.col("id") % 29 == 0, "No-Reply@x.example").otherwise(F.col("sender_email"))
    return m.select("message_key", C.auto_reply(subject, F.col("preview"), sender).alias("auto_reply"))


@query("""SELECT v.id, v.category FROM (SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'requisites' WHEN 1 THEN 'price_list' WHEN 2 THEN 'table' WHEN 3 THEN 'image' WHEN 4 THEN 'document' WHEN 5 THEN 'archive' ELSE 'other' END AS category FROM customer) v""")
def attachment_category(spark, sf):
    """T18."""
    names = ("Requisites.pdf", "price 2024.xlsx", "items.XLSX", "photo.jpeg", "letter.docx", "all.7z", "noext")
    name = F.get(F.array(*map(F.lit, names)), (F.col("c_custkey") % 7).cast("int"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), T.attachment_category(name).alias("category"))


# Full-text search

_WORDS = f"tk AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower({_T}), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM documents)"


@query(f"WITH {_WORDS} SELECT doc_id FROM tk WHERE starts_with(w, 'disg') OR starts_with(w, 'path') GROUP BY doc_id HAVING count(DISTINCT CASE WHEN starts_with(w, 'disg') THEN 1 ELSE 2 END) = 2")
def fts_prefix_and(spark, sf):
    """Documents with words that begin with each term."""
    return fts.prefix_and(fts.index(table(spark, sf, "documents"), "doc_id", {"text": 1.0}), "disg path").select("doc_id")


@query(f"""WITH {_WORDS}, dl AS (SELECT doc_id, count(*) AS dl FROM tk GROUP BY 1), n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, w, count(*) AS tf FROM tk WHERE w IN ('disgusting', 'pathetic', 'token') GROUP BY 1, 2), df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1)
SELECT tf.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 4) AS score FROM tf JOIN df ON df.w = tf.w JOIN dl ON dl.doc_id = tf.doc_id, n GROUP BY 1""")
def fts_bm25(spark, sf):
    """BM25 of three terms."""
    return fts.bm25(fts.stored(fts.index(table(spark, sf, "documents"), "doc_id", {"text": 1.0})), "disgusting pathetic token").select("doc_id", F.round("score", 4).alias("score"))


@query("""SELECT p_partkey AS id, p_size AS relevance FROM part ORDER BY p_size DESC, p_retailprice DESC, p_partkey LIMIT 10""")
def fts_empty_query(spark, sf):
    """No query lists the top of the catalogue."""
    p = table(spark, sf, "part")
    return p.orderBy(F.desc("p_size"), F.desc("p_retailprice"), "p_partkey").limit(10).select(F.col("p_partkey").alias("id"), F.col("p_size").alias("relevance"))


@query("""SELECT p_partkey AS id, CASE WHEN lower(p_name) = 'red bolt' THEN 1000.0 ELSE CAST(10 AS DOUBLE) END AS relevance FROM part WHERE lower(p_name) = 'red bolt' OR (contains(lower(p_name), 'red') AND contains(lower(p_name), 'bolt'))""")
def fts_exact_first(spark, sf):
    """An exact name short-circuits the relevance."""
    n = F.lower("p_name")
    both = F.contains(n, F.lit("red")) & F.contains(n, F.lit("bolt"))
    return table(spark, sf, "part").where((n == "red bolt") | both).select(F.col("p_partkey").alias("id"), F.when(n == "red bolt", 1000.0).otherwise(10.0).alias("relevance"))
