"""Dashboards, catalogue statistics and quality audits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posthorn.operators import catalog
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


@query("""WITH u AS (SELECT user_id, bool_or(event_type = 'view') AS v, bool_or(event_type = 'click') AS c, bool_or(event_type = 'signup') AS s, bool_or(event_type = 'purchase') AS p FROM events GROUP BY 1),
f AS (SELECT count(*) AS users, count(*) FILTER (WHERE v) AS viewed, count(*) FILTER (WHERE c) AS clicked, count(*) FILTER (WHERE s) AS signed, count(*) FILTER (WHERE p) AS bought FROM u)
SELECT *, round(clicked / nullif(viewed, 0), 4) AS click_rate, round(signed / nullif(clicked, 0), 4) AS signup_rate, round(bought / nullif(signed, 0), 4) AS purchase_rate, round(bought / nullif(users, 0), 4) AS total_rate FROM f""")
def conversion_funnel(spark, sf):
    """Users at each stage and guarded ratios, from one scan."""
    saw = lambda k: F.bool_or(F.col("event_type") == k)
    u = table(spark, sf, "events").groupBy("user_id").agg(saw("view").alias("v"), saw("click").alias("c"), saw("signup").alias("s"), saw("purchase").alias("p"))
    f = u.agg(F.count("*").alias("users"), *(F.count_if(a).alias(b) for a, b in (("v", "viewed"), ("c", "clicked"), ("s", "signed"), ("p", "bought"))))
    rate = lambda a, b: F.round(F.try_divide(a, b), 4)
    return f.select("*", rate("clicked", "viewed").alias("click_rate"), rate("signed", "clicked").alias("signup_rate"), rate("bought", "signed").alias("purchase_rate"), rate("bought", "users").alias("total_rate"))


@query(f"WITH {M.SQL_BASE} SELECT coalesce(label, 'unknown') AS label, status, count(*) AS n FROM b GROUP BY 1, 2")
def dashboard_counts(spark, sf):
    """Messages by label and status in one pass."""
    return M.from_orders(spark, sf, lines=False).groupBy(F.coalesce("label", F.lit("unknown")).alias("label"), "status").agg(F.count("*").alias("n"))


_HEAT = """h AS (SELECT n_name AS mailbox, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)"""


@query(f"WITH {_HEAT} SELECT mailbox, n, CASE WHEN n / (SELECT max(n) FROM h) > 0.5 THEN 'hot' WHEN n / (SELECT max(n) FROM h) > 0.15 THEN 'warm' ELSE 'cold' END AS heat FROM h")
def inbox_heatmap(spark, sf):
    """Messages of each mailbox and their share of the largest; the maximum is a scalar subquery."""
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    n = table(spark, sf, "nation")
    h = n.join(c, n.n_nationkey == c.c_nationkey, "left").select(F.col("n_name").alias("mailbox"), F.coalesce("n", F.lit(0)).alias("n"))
    share = F.col("n") / h.agg(F.max("n").alias("m")).scalar()
    return h.select("mailbox", "n", F.when(share > 0.5, "hot").when(share > 0.15, "warm").otherwise("cold").alias("heat"))


@query("""SELECT source, count(*) AS reviewed, sum(quality) AS approved, round(avg(quality), 4) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def review_accuracy(spark, sf):
    """Share of approved reviews by source."""
    d, lab = table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels")
    return lab.join(d, "doc_id").groupBy("source").agg(F.count("*").alias("reviewed"), F.sum("quality").cast("long").alias("approved"), F.round(F.avg("quality"), 4).alias("accuracy"))


@query("SELECT count(*) AS articles, count(DISTINCT p_brand) AS brands, CAST(sum(p_size) AS BIGINT) AS total_rows, count(*) FILTER (WHERE p_size > 25) AS big, count(*) FILTER (WHERE p_retailprice > 1000) AS dear FROM part")
def kb_stats_distinct(spark, sf):
    """A10, A11."""
    return table(spark, sf, "part").agg(
        F.count("*").alias("articles"), F.count_distinct("p_brand").alias("brands"), F.sum("p_size").cast("long").alias("total_rows"),
        F.count_if(F.col("p_size") > 25).alias("big"), F.count_if(F.col("p_retailprice") > 1000).alias("dear"),
    )


@query("""WITH e AS (SELECT upper(regexp_replace(p_name, '[^A-Za-z0-9]+', '', 'g')) AS article, p_name, p_brand, p_type, l_orderkey, l_quantity, l_extendedprice / nullif(l_quantity, 0) AS price FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT article, count(*) AS source_rows, round(sum(l_quantity), 3) AS total_quantity, min(p_brand) AS brand, array_to_string(list_slice(list_sort(list(DISTINCT p_type)), 1, 12), '|') AS synonyms,
 array_to_string(list_slice(list_sort(list(DISTINCT l_orderkey)), 1, 20), '|') AS deals, round(min(price), 2) AS min_price, round(max(price), 2) AS max_price, round(avg(price), 2) AS avg_price FROM e GROUP BY 1""")
def catalog_rollup(spark, sf):
    """The catalogue by normalised article."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    e = li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("p_name").alias("article"), F.col("p_brand").alias("brand"), F.col("p_name").alias("product_name"), F.col("p_type").alias("synonym"),
        F.col("l_orderkey").alias("deal_id"), F.col("l_quantity").alias("quantity"), F.try_divide("l_extendedprice", "l_quantity").alias("price"),
    )
    r = catalog.rollup(e)
    return r.select("article", "source_rows", "total_quantity", "brand", F.array_join("synonyms", "|").alias("synonyms"), F.array_join("deals", "|").alias("deals"), "min_price", "max_price", "avg_price")


@query("SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, brand LIMIT 8")
def brand_frequency(spark, sf):
    """The most frequent brands."""
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "brand").limit(8)


@query("SELECT c_name AS company, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 ORDER BY n DESC, company LIMIT 12")
def top_customers(spark, sf):
    """Orders are counted by key before names are joined."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("company"))
    return o.join(c, o.o_custkey == c.c_custkey).select("company", "n", F.round("s", 2).alias("total")).orderBy(F.desc("n"), "company").limit(12)


@query(f"""WITH {M.SQL} SELECT 'brand' AS kind, value, count(*) AS n FROM (SELECT unnest(brands) AS value FROM m) x GROUP BY 2 UNION ALL
SELECT 'type', value, count(*) FROM (SELECT unnest(product_types) AS value FROM m) y GROUP BY 2 UNION ALL SELECT 'attachment', value, count(*) FROM (SELECT unnest(attachment_exts) AS value FROM m) z GROUP BY 2""")
def request_analytics(spark, sf):
    """Frequencies of brands, types and attachment types from one scan of the messages."""
    tag = lambda k, c: F.transform(c, lambda v: F.struct(F.lit(k).alias("kind"), v.alias("value")))
    m = M.from_orders(spark, sf)
    each = m.select(F.explode(F.concat(tag("brand", "brands"), tag("type", "product_types"), tag("attachment", "attachment_exts"))).alias("x"))
    return each.groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


@query("SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 14")
def daily_volume(spark, sf):
    """A17, W10."""
    return table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day")).limit(14)


@query("""SELECT CAST(year(ts) AS VARCHAR) || '-W' || lpad(CAST(CAST(ceil((dayofyear(ts) - 1 + dayofweek(date_trunc('year', ts)) + 1) / 7.0) AS BIGINT) AS VARCHAR), 2, '0') AS week,
 count(*) AS total, count(*) FILTER (WHERE event_type = 'purchase') AS client, count(*) FILTER (WHERE event_type = 'error') AS spam, count(DISTINCT user_id) AS brands FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 8""")
def weekly_trends(spark, sf):
    """The week formula of the dashboard, in UTC."""
    first = F.date_trunc("year", F.col("ts").cast("timestamp"))
    week = F.ceil((F.dayofyear("ts") - 1 + F.dayofweek(first)) / 7)  # Sunday is 1 here
    key = F.concat(F.year("ts").cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
    is_ = lambda k: F.count_if(F.col("event_type") == k)
    return table(spark, sf, "events").groupBy(key.alias("week")).agg(F.count("*").alias("total"), is_("purchase").alias("client"), is_("error").alias("spam"), F.count_distinct("user_id").alias("brands")).orderBy(F.desc("week")).limit(8)


@query("SELECT isoyear(ts) AS year, week(ts) AS week, count(*) AS total FROM events GROUP BY 1, 2")
def weekly_trends_iso(spark, sf):
    """A18 by ISO weeks (extension)."""
    return table(spark, sf, "events").groupBy(F.expr("extract(yearofweek from ts)").cast("long").alias("year"), F.weekofyear("ts").cast("long").alias("week")).agg(F.count("*").alias("total"))


@query("""WITH c AS (SELECT event_type AS stage, count(*) AS n FROM events GROUP BY 1) SELECT stage, n, round(100.0 * n / (SELECT max(n) FROM c), 2) AS percent FROM c""")
def funnel_percent(spark, sf):
    """Each stage relative to the largest."""
    c = table(spark, sf, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"))
    return c.select("stage", "n", F.round(100.0 * F.col("n") / c.agg(F.max("n").alias("m")).scalar(), 2).alias("percent"))


@query("""WITH l AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type IN ('signup', 'purchase', 'error'))
SELECT count(*) AS decided, count(*) FILTER (WHERE event_type = 'purchase') AS right_ones, round(count(*) FILTER (WHERE event_type = 'purchase') / count(*), 4) AS accuracy FROM l WHERE rn = 1""")
def accuracy_from_audit(spark, sf):
    """The last status change of each message decides."""
    last = table(spark, sf, "events").where(F.col("event_type").isin("signup", "purchase", "error")).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("s"))
    good = F.count_if(F.col("s") == "purchase")
    return last.agg(F.count("*").alias("decided"), good.alias("right_ones"), F.round(F.try_divide(good, F.count("*")), 4).alias("accuracy"))


@query("""WITH g AS (SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, count(*) AS positions FROM lineitem GROUP BY 1)
SELECT l_orderkey, cents, positions, cents > 5000000 AS valuable, positions >= 5 AS large FROM g""")
def estimated_value(spark, sf):
    """The value of an order from its lines, summed in cents."""
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.count("*").alias("positions"))
    return g.withColumns({"valuable": F.col("cents") > 5_000_000, "large": F.col("positions") >= 5})


@query("""SELECT message, CAST((2 * sum(c) + count(c)) // nullif(2 * count(c), 0) AS DOUBLE) / 100 AS mean_confidence, CAST(round(100.0 * count(c) / count(*)) AS BIGINT) AS completeness FROM (SELECT l_orderkey AS message, CASE WHEN l_discount > 0.03 THEN CAST(round(l_discount * 100) AS BIGINT) END AS c FROM lineitem) x GROUP BY 1""")
def mean_confidence(spark, sf):
    """The mean of positive confidences, rounded half up to 2 digits, and the share of filled fields."""
    c = F.when(F.col("l_discount") > 0.03, F.round(F.col("l_discount") * 100).cast("long"))
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("message")).agg((F.floor(F.try_divide(2 * F.sum(c) + F.count(c), 2 * F.count(c))) / 100).alias("mean_confidence"), F.round(100.0 * F.count(c) / F.count("*")).cast("long").alias("completeness"))


@query("""SELECT doc_group, count(DISTINCT k) AS ids, count(DISTINCT k) > 1 AND bool_and(NOT is_primary) AS conflict FROM (SELECT l_orderkey AS doc_group, l_suppkey AS k, l_linenumber = 1 AND l_orderkey % 2 = 0 AS is_primary FROM lineitem) x GROUP BY 1""")
def tax_id_conflict(spark, sf):
    """Several ids and no primary one."""
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_group"), F.col("l_suppkey").alias("k"), ((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 2 == 0)).alias("is_primary"))
    return x.groupBy("doc_group").agg(F.count_distinct("k").alias("ids"), ((F.count_distinct("k") > 1) & ~F.bool_or("is_primary")).alias("conflict"))


_BUCKETS = {
    "empty": ("trim(coalesce(text, '')) = ''", lambda: F.trim(F.coalesce("text", F.lit(""))) == ""),
    "short": ("length(coalesce(text, '')) < 200", lambda: F.length(F.coalesce("text", F.lit(""))) < 200),
    "has_email": ("contains(coalesce(text, ''), '@')", lambda: F.contains(F.coalesce("text", F.lit("")), F.lit("@"))),
    "shouting": ("regexp_matches(coalesce(text, ''), '!!')", lambda: F.coalesce("text", F.lit("")).rlike("!!")),
    "table": ("regexp_matches(coalesce(text, ''), ' \\| .* \\| ')", lambda: F.coalesce("text", F.lit("")).rlike(" \\| .* \\| ")),
    "wrong_length": ("length(coalesce(text, '')) <> n_chars", lambda: F.length(F.coalesce("text", F.lit(""))) != F.col("n_chars")),
}


@query("WITH x AS (" + " UNION ALL ".join(f"SELECT doc_id, source, '{n}' AS bucket FROM documents WHERE {s}" for n, (s, _) in _BUCKETS.items()) + ") SELECT bucket, count(*) AS instances, count(DISTINCT source) AS sources FROM x GROUP BY 1")
def audit_buckets(spark, sf):
    """Every check once, as an array of bucket names."""
    names = F.array_compact(F.array(*(F.when(c(), F.lit(n)) for n, (_, c) in _BUCKETS.items())))
    return table(spark, sf, "documents").select("source", F.explode(names).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("instances"), F.count_distinct("source").alias("sources"))


@query("SELECT lang, count(*) AS n, " + ", ".join(f"round(100.0 * count(*) FILTER (WHERE {s}) / count(*), 2) AS {n}" for n, (s, _) in _BUCKETS.items()) + " FROM documents GROUP BY 1")
def audit_metrics(spark, sf):
    """Shares of each check by language."""
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), *(F.round(100.0 * F.count_if(c()) / F.count("*"), 2).alias(n) for n, (_, c) in _BUCKETS.items()))


@query("SELECT count(DISTINCT doc_id) AS affected FROM (" + " UNION ALL ".join(f"SELECT doc_id FROM documents WHERE {s}" for n, (s, _) in _BUCKETS.items() if n != "has_email") + ") x")
def audit_any_error(spark, sf):
    """Documents in any error bucket."""
    anyone = F.lit(False)
    for n, (_, c) in _BUCKETS.items():
        anyone = anyone | (c() if n != "has_email" else F.lit(False))
    return table(spark, sf, "documents").where(anyone).agg(F.count_distinct("doc_id").alias("affected"))


@query("""WITH e AS (SELECT l_orderkey AS id, 'Brand#' || CAST(1 + l_orderkey % 25 AS VARCHAR) AS brand FROM lineitem GROUP BY 1),
a AS (SELECT DISTINCT l_orderkey AS id, p_brand AS brand FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT e.brand, count(*) AS claimed, count(*) FILTER (WHERE a.id IS NULL) AS ghosts FROM e LEFT JOIN a ON a.id = e.id AND a.brand = e.brand GROUP BY 1""")
def ghost_brands(spark, sf):
    """Claimed brands without evidence among the order's parts."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    e = li.select(F.col("l_orderkey").alias("id")).distinct().withColumn("brand", F.concat(F.lit("Brand#"), (1 + F.col("id") % 25).cast("string")))
    a = li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("id"), F.col("p_brand").alias("brand")).distinct().withColumn("known", F.lit(1))
    return e.join(a, ["id", "brand"], "left").groupBy("brand").agg(F.count("*").alias("claimed"), F.count_if(F.col("known").isNull()).alias("ghosts"))


@query("""WITH x AS (SELECT doc_id, quality, CASE WHEN length(text) >= 500 THEN 1 ELSE 0 END AS found FROM labels JOIN documents USING (doc_id))
SELECT count(*) AS cases, count(*) FILTER (WHERE found = quality) AS passed, round(count(*) FILTER (WHERE found = quality) / count(*), 4) AS pass_rate, count(*) FILTER (WHERE found < quality) AS missed, count(*) FILTER (WHERE found > quality) AS extra FROM x""")
def detection_scorecard(spark, sf):
    """Expected against found."""
    d = table(spark, sf, "documents").select("doc_id", (F.length("text") >= 500).cast("int").alias("found"))
    x = table(spark, sf, "labels").join(d, "doc_id")
    same = F.count_if(F.col("found") == F.col("quality"))
    return x.agg(F.count("*").alias("cases"), same.alias("passed"), F.round(same / F.count("*"), 4).alias("pass_rate"), F.count_if(F.col("found") < F.col("quality")).alias("missed"), F.count_if(F.col("found") > F.col("quality")).alias("extra"))


@query("""SELECT status, count(*) AS n, round(avg(attempts), 4) AS avg_attempts, max(attempts) AS max_attempts FROM (SELECT CASE event_type WHEN 'error' THEN 'failed' ELSE 'done' END AS status, event_id % 6 AS attempts FROM events) x GROUP BY 1""")
def run_telemetry(spark, sf):
    """Counters and averages of a run."""
    x = table(spark, sf, "events").select(F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"), (F.col("event_id") % 6).alias("attempts"))
    return x.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("attempts"), 4).alias("avg_attempts"), F.max("attempts").alias("max_attempts"))


@query("""SELECT doc_id, value, occurrences, occurrences >= 2 AS bonus FROM (SELECT l_orderkey AS doc_id, l_suppkey AS value, count(*) AS occurrences FROM lineitem GROUP BY 1, 2) x""")
def repeated_candidate_bonus(spark, sf):
    """A32."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("value")).agg(F.count("*").alias("occurrences")).withColumn("bonus", F.col("occurrences") >= 2)


@query("SELECT event_type AS action, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND user_id < 20 GROUP BY 1")
def audit_log_counts(spark, sf):
    """actions of some users since a date; the range reaches the scan."""
    e = table(spark, sf, "events").where((F.col("ts") >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")) & (F.col("user_id") < 20))
    return e.groupBy(F.col("event_type").alias("action")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%BOLT%' OR p_brand ILIKE '%#1%' OR p_type ILIKE 'small' ORDER BY p_retailprice DESC, p_partkey LIMIT 40 OFFSET 20")
def rest_list_ilike(spark, sf):
    """OR of case-blind patterns, a sort column and skip/take."""
    p = table(spark, sf, "part").where(F.col("p_name").ilike("%BOLT%") | F.col("p_brand").ilike("%#1%") | F.col("p_type").ilike("small"))
    return p.orderBy(F.desc("p_retailprice"), "p_partkey").offset(20).limit(40).select("p_partkey", "p_name")


@query("""SELECT p_brand, p_type, count(*) AS source_rows FROM part GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY source_rows DESC, p_brand, p_type LIMIT 100""")
def routing_candidates(spark, sf):
    """F35."""
    return table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("source_rows")).where("source_rows >= 3").orderBy(F.desc("source_rows"), "p_brand", "p_type").limit(100)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, s""")
def event_windows(spark, sf):
    """Extension: sessions of a user with gaps of at most half an hour."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", "w.start", "w.end", "n")

