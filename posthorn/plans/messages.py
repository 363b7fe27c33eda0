"""The canonical message: one row with every field that the query surface asks for.

The driver's order tables stand for a mailbox: an order is a message, its customer the sender,
its line items attachments and articles. ``from_orders`` builds that table; everything else in
the library works on any table with these columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posthorn.sources.tables import table

#: Ages are measured against this instant, never against the clock.
AS_OF = "2001-08-02 00:00:00"
PRIORITIES = ("critical", "high", "medium", "low")
RISKS = ("high", "medium", "low")
STATUSES = ("fetch_error", "ignored_spam", "ignored_duplicate", "needs_clarification", "ready_for_crm", "review")
LABELS = ("client", "spam", "vendor", "unknown")
#: Hours until a message of a priority is overdue; a message without a priority never is.
SLA_HOURS = {"critical": 2, "high": 8, "medium": 24}
SLA_OTHER = 48


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands, articles, types, extensions and conflicts of each order, sorted and distinct."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    ext = F.when(F.col("l_returnflag") == "N", "pdf").when(F.col("l_returnflag") == "R", "xlsx").otherwise("doc")
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey, "left")
        .groupBy("l_orderkey")
        .agg(
            F.array_sort(F.collect_set("p_brand")).alias("brands"),
            F.array_sort(F.collect_set(F.concat(F.lit("ART-"), F.col("l_partkey").cast("string")))).alias("articles"),
            F.array_sort(F.collect_set("p_type")).alias("product_types"),
            F.array_sort(F.collect_set(ext)).alias("attachment_exts"),
            F.array_sort(F.collect_set("p_name")).alias("names"),
            F.count("*").alias("n_attachments"),
            F.bool_or(F.col("l_linestatus") == "F").alias("parsed_attachment"),
            (F.count("*") > F.count_distinct("l_partkey")).alias("repeated_article"),
        )
    )


def from_orders(spark: SparkSession, sf_dir: str, lines: bool = True) -> DataFrame:
    """Messages of the order tables; without ``lines`` the columns that need line items are left out."""
    k = F.col("o_orderkey")
    cust = F.col("o_custkey")
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    base = o.join(c, o.o_custkey == c.c_custkey, "left").select(
        k.alias("id"),
        F.concat(F.lit("m"), k.cast("string")).alias("message_key"),
        F.concat(F.lit("p"), (cust % 5).cast("string")).alias("project_id"),
        F.col("o_orderdate").alias("created_at"),
        F.when(k % 97 != 0, F.col("o_orderdate") + F.make_dt_interval(hours=(k % 72).cast("int"))).alias("updated_at"),
        F.when(k % 13 == 0, "ignored_spam").when(F.col("o_orderstatus") == "F", "ready_for_crm").when(F.col("o_orderstatus") == "O", "review")
        .otherwise("needs_clarification").alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "high")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "medium").when(F.col("o_orderpriority") == "5-LOW", "low").alias("priority"),
        F.when(k % 11 == 0, None).when(F.col("o_totalprice") > 300000, "high").when(F.col("o_totalprice") > 150000, "medium").otherwise("low").alias("risk"),
        F.when(k % 10 == 0, "spam").when(k % 10 == 1, "vendor").when(k % 10 == 2, None).otherwise("client").alias("label"),
        F.when(cust % 7 == 0, None).when(cust % 9 == 0, "").otherwise(F.col("c_name")).alias("company"),
        F.when(cust % 3 != 0, F.lpad(cust.cast("string"), 10, "7")).alias("inn"),
        F.when(cust % 4 != 0, F.concat(F.lit("+7"), F.lpad(cust.cast("string"), 10, "9"))).alias("phone"),
        F.concat(F.lit("user"), cust.cast("string"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example")).alias("sender_email"),
        F.concat_ws(" ", F.lit("Order"), k.cast("string"), F.col("o_orderpriority")).alias("subject"),
        F.concat_ws(" ", F.col("c_mktsegment"), F.col("o_orderstatus")).alias("preview"),
        F.when((F.col("o_orderstatus") == "F") & (k % 2 == 0), F.col("o_orderdate")).alias("confirmed_at"),
        ((k % 100) / 100.0).alias("confidence"),
        (k % 101).alias("completeness"),
        F.when(k % 5 == 0, F.col("o_orderdate")).alias("acked_crm"),
        F.when(k % 4 != 0, F.concat(F.lit("thread-"), cust.cast("string"))).alias("thread_id"),
        F.col("o_totalprice").alias("total"),
        cust.alias("customer_id"),
    )
    if not lines:
        return base
    own = order_lines(spark, sf_dir)
    empty = F.array().cast("array<string>")
    return base.join(own, base.id == own.l_orderkey, "left").select(
        *base.columns,
        *(F.coalesce(c, empty).alias(c) for c in ("brands", "articles", "product_types", "attachment_exts", "names")),
        F.coalesce("n_attachments", F.lit(0)).cast("long").alias("n_attachments"),
        F.coalesce("parsed_attachment", F.lit(False)).alias("parsed_attachment"),
        (F.coalesce("repeated_article", F.lit(False)) | (F.col("id") % 17 == 0)).alias("has_conflicts"),
    )


#: The same table in SQL, as common table expressions named ``m`` (all columns) and ``b`` (without lines).
SQL_BASE = """
b AS (
  SELECT o_orderkey AS id, 'm' || CAST(o_orderkey AS VARCHAR) AS message_key, 'p' || CAST(o_custkey % 5 AS VARCHAR) AS project_id,
    o_orderdate AS created_at,
    CASE WHEN o_orderkey % 97 <> 0 THEN o_orderdate + to_hours(CAST(o_orderkey % 72 AS INTEGER)) END AS updated_at,
    CASE WHEN o_orderkey % 13 = 0 THEN 'ignored_spam' WHEN o_orderstatus = 'F' THEN 'ready_for_crm' WHEN o_orderstatus = 'O' THEN 'review'
      ELSE 'needs_clarification' END AS status,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' END AS priority,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 150000 THEN 'medium' ELSE 'low' END AS risk,
    CASE o_orderkey % 10 WHEN 0 THEN 'spam' WHEN 1 THEN 'vendor' WHEN 2 THEN NULL ELSE 'client' END AS label,
    CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_custkey % 9 = 0 THEN '' ELSE c_name END AS company,
    CASE WHEN o_custkey % 3 <> 0 THEN lpad(CAST(o_custkey AS VARCHAR), 10, '7') END AS inn,
    CASE WHEN o_custkey % 4 <> 0 THEN '+7' || lpad(CAST(o_custkey AS VARCHAR), 10, '9') END AS phone,
    'user' || CAST(o_custkey AS VARCHAR) || '@' || lower(c_mktsegment) || '.example' AS sender_email,
    'Order ' || CAST(o_orderkey AS VARCHAR) || ' ' || o_orderpriority AS subject, c_mktsegment || ' ' || o_orderstatus AS preview,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN o_orderdate END AS confirmed_at,
    (o_orderkey % 100) / 100.0 AS confidence, o_orderkey % 101 AS completeness,
    CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate END AS acked_crm,
    CASE WHEN o_orderkey % 4 <> 0 THEN 'thread-' || CAST(o_custkey AS VARCHAR) END AS thread_id,
    o_totalprice AS total, o_custkey AS customer_id
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey
)"""
SQL = (
    SQL_BASE
    + """, ln AS (
  SELECT l_orderkey, list_sort(list(DISTINCT p_brand)) AS brands, list_sort(list(DISTINCT 'ART-' || CAST(l_partkey AS VARCHAR))) AS articles,
    list_sort(list(DISTINCT p_type)) AS product_types,
    list_sort(list(DISTINCT CASE l_returnflag WHEN 'N' THEN 'pdf' WHEN 'R' THEN 'xlsx' ELSE 'doc' END)) AS attachment_exts,
    list_sort(list(DISTINCT p_name)) AS names, bool_or(l_linestatus = 'F') AS parsed_attachment, count(*) AS n_attachments, count(*) > count(DISTINCT l_partkey) AS repeated_article
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey
), m AS (
  SELECT b.*, coalesce(brands, []) AS brands, coalesce(articles, []) AS articles, coalesce(product_types, []) AS product_types,
    coalesce(attachment_exts, []) AS attachment_exts, coalesce(names, []) AS names, coalesce(parsed_attachment, false) AS parsed_attachment, coalesce(n_attachments, 0) AS n_attachments,
    coalesce(repeated_article, false) OR id % 17 = 0 AS has_conflicts
  FROM b LEFT JOIN ln ON l_orderkey = id
)"""
)
