"""Joins, matching, sets and upserts over the driver's tables (J, U, W)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from posthorn.operators import knowledge as K
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


@query("""SELECT n_name, r_name, coalesce(c, 0) AS customers FROM nation LEFT JOIN region ON r_regionkey = n_regionkey
LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) x ON c_nationkey = n_nationkey""")
def include_counts(spark, sf):
    """Parents with their lookup row and the number of their children."""
    n, r, c = (table(spark, sf, t) for t in ("nation", "region", "customer"))
    counts = c.groupBy("c_nationkey").agg(F.count("*").alias("c"))
    return (
        n.join(r, n.n_regionkey == r.r_regionkey, "left").join(counts, n.n_nationkey == counts.c_nationkey, "left")
        .select("n_name", "r_name", F.coalesce("c", F.lit(0)).alias("customers"))
    )


@query("""SELECT c_custkey, array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY rn) FILTER (WHERE rn IS NOT NULL), '|') AS top3 FROM customer
LEFT JOIN (SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) x WHERE rn <= 3) y ON o_custkey = c_custkey GROUP BY 1""")
def include_top3(spark, sf):
    """Each parent with its three first children."""
    o = table(spark, sf, "orders")
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    top = o.select("o_custkey", "o_orderkey", rn.alias("rn")).where("rn <= 3").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("rn", "o_orderkey"))).alias("t"))
    c = table(spark, sf, "customer").select("c_custkey")
    joined = F.array_join(F.transform("t", lambda x: x["o_orderkey"].cast("string")), "|")
    return c.join(top, c.c_custkey == top.o_custkey, "left").select("c_custkey", joined.alias("top3"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_join_new(spark, sf):
    """Rows whose key is not known yet."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return X.insert_missing(table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), c, "c_custkey")


@query("""WITH n AS (SELECT o_custkey AS k, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'F')
SELECT k, v FROM n WHERE rn = 1 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT k FROM n)""")
def upsert_last_wins(spark, sf):
    """The last update of a key replaces its row."""
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderdate", "o_orderkey")
    return X.upsert(old, new, "k", [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("""WITH q AS (SELECT o_orderkey AS id, o_custkey AS ck, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS k1, o_custkey % 25 AS nk FROM orders),
a AS (SELECT id, c_custkey AS company FROM q JOIN customer ON c_custkey = k1),
d AS (SELECT id, min(s_suppkey) AS company FROM q JOIN supplier ON s_nationkey = nk GROUP BY id)
SELECT q.id, CASE WHEN a.id IS NOT NULL THEN 'key' WHEN d.id IS NOT NULL THEN 'nation' END AS stage, coalesce(a.company, d.company) AS company
FROM q LEFT JOIN a ON a.id = q.id LEFT JOIN d ON d.id = q.id""")
def company_lookup_cascade(spark, sf):
    """Exact key first, then the first company of the same nation."""
    q = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("k1"), (F.col("o_custkey") % 25).alias("nk")
    )
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    exact = q.join(c, q.k1 == c.c_custkey).select("id", F.col("c_custkey").alias("company"))
    # The first supplier of each nation is found before the join, which then keeps its row number.
    first = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("company"))
    nation = q.join(first, q.nk == first.s_nationkey).select("id", "company")
    return X.cascade(q.select("id"), "id", [("key", exact), ("nation", nation)], ("company",))


_SIGNALS = """sg AS (SELECT DISTINCT l_orderkey AS message, 'brand' AS kind, p_brand AS value FROM lineitem JOIN part ON p_partkey = l_partkey
  UNION SELECT DISTINCT l_orderkey, 'article', CAST(l_partkey AS VARCHAR) FROM lineitem),
hs AS (SELECT DISTINCT l_suppkey AS company, 'article' AS kind, CAST(l_partkey AS VARCHAR) AS value FROM lineitem WHERE l_returnflag = 'R'
  UNION SELECT DISTINCT s_suppkey, 'brand', 'Brand#' || CAST(1 + s_suppkey % 25 AS VARCHAR) FROM supplier)"""


@query(f"""WITH {_SIGNALS}, sc AS (SELECT message, company, sum(w) AS score, max(w) AS top FROM (
  SELECT message, company, CASE sg.kind WHEN 'article' THEN 32 ELSE 18 END AS w FROM sg JOIN hs ON hs.kind = sg.kind AND hs.value = sg.value) x GROUP BY 1, 2 HAVING sum(w) >= 35),
r AS (SELECT *, row_number() OVER (PARTITION BY message ORDER BY score DESC, company) AS rn, count(*) OVER (PARTITION BY message) AS c FROM sc)
SELECT message, company, CAST(least(score, 95) AS BIGINT) AS confidence, CASE WHEN top = 32 THEN 'article' ELSE 'brand' END AS method, c > 1 AS multi_company FROM r WHERE rn = 1""")
def crm_match_scored(spark, sf):
    """Companies by shared brands and articles."""
    li, p, s = (table(spark, sf, t) for t in ("lineitem", "part", "supplier"))
    signals = (
        li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("message"), F.lit("brand").alias("kind"), F.col("p_brand").alias("value"))
        .unionByName(li.select(F.col("l_orderkey").alias("message"), F.lit("article").alias("kind"), F.col("l_partkey").cast("string").alias("value")))
    )
    history = (
        li.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("company"), F.lit("article").alias("kind"), F.col("l_partkey").cast("string").alias("value"))
        .unionByName(s.select(F.col("s_suppkey").alias("company"), F.lit("brand").alias("kind"), F.concat(F.lit("Brand#"), (1 + F.col("s_suppkey") % 25).cast("string")).alias("value")))
    )
    out = X.scored_matches(signals, history)
    return out.withColumn("confidence", F.col("confidence").cast("long"))


@query("""WITH i AS (SELECT l_orderkey AS message, l_linenumber AS pos, p_brand AS value FROM lineitem JOIN part ON p_partkey = l_partkey),
o AS (SELECT DISTINCT p_brand AS value, 'mop-' || CAST(length(p_brand) AS VARCHAR) || right(p_brand, 1) AS owner FROM part WHERE right(p_brand, 1) IN ('1', '3', '5')),
h AS (SELECT message, owner, row_number() OVER (PARTITION BY message ORDER BY owner IS NULL, pos, owner) AS rn FROM i LEFT JOIN o ON o.value = i.value)
SELECT message, coalesce(owner, 'default') AS owner FROM h WHERE rn = 1""")
def owner_resolution(spark, sf):
    """The owner of the first owned brand, else the default."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    items = li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("message"), F.col("l_linenumber").alias("pos"), F.col("p_brand").alias("value"))
    last = F.right(F.col("p_brand"), F.lit(1))
    owners = p.where(last.isin("1", "3", "5")).select(F.col("p_brand").alias("value"), F.concat(F.lit("mop-"), F.length("p_brand").cast("string"), last).alias("owner")).distinct()
    return X.first_owner(items, owners, "default")


@query("""SELECT o_orderkey, CASE WHEN (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 3 = 0 THEN 'anna' WHEN (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 3 = 1 THEN 'boris' ELSE 'clara' END AS assignee FROM orders""")
def assignment_round_robin(spark, sf):
    """Assignees in turn within each customer."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return X.round_robin(o, "o_orderkey", ("anna", "boris", "clara"), "o_custkey").select("o_orderkey", "assignee")


@query("""WITH t AS (SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 'curator-' || CAST(c_nationkey AS VARCHAR) END AS curator, CASE WHEN c_mktsegment = 'BUILDING' THEN 'brand-owner' END AS by_brand,
  r_name AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey)
SELECT c_custkey, coalesce(curator, by_brand, CASE WHEN region IN ('ASIA', 'EUROPE') THEN 'region-' || region END, 'fallback') AS assignee,
  CASE WHEN curator IS NOT NULL THEN 'curator' WHEN by_brand IS NOT NULL THEN 'brand_rule' WHEN region IN ('ASIA', 'EUROPE') THEN 'region' ELSE 'fallback' END AS rule FROM t""")
def assignment_cascade(spark, sf):
    """Curator, brand rule, region, fallback."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    t = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    curator = F.when(F.col("c_nationkey") < 5, F.concat(F.lit("curator-"), F.col("c_nationkey").cast("string")))
    brand = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("brand-owner"))
    region = F.when(F.col("r_name").isin("ASIA", "EUROPE"), F.concat(F.lit("region-"), F.col("r_name")))
    rule = F.when(curator.isNotNull(), "curator").when(brand.isNotNull(), "brand_rule").when(region.isNotNull(), "region").otherwise("fallback")
    return t.select("c_custkey", F.coalesce(curator, brand, region, F.lit("fallback")).alias("assignee"), rule.alias("rule"))


@query("""WITH f AS (SELECT 'a' AS x), p AS (SELECT p_partkey, lower(p_name) AS n, p_size, p_retailprice FROM part), r AS (
  SELECT p_partkey, CASE WHEN n = 'bolt' THEN 0 WHEN starts_with(n, 'bolt') THEN 1 WHEN contains(n, 'bolt') THEN 2 END AS rank, p_size, p_retailprice FROM p)
SELECT p_partkey, rank FROM r WHERE rank IS NOT NULL ORDER BY rank, p_size DESC, p_retailprice DESC, p_partkey LIMIT 25""")
def article_fragment_lookup(spark, sf):
    """Exact, prefix, inner fragment, then by volume."""
    n = F.lower("p_name")
    rank = F.when(n == "bolt", 0).when(F.startswith(n, F.lit("bolt")), 1).when(F.contains(n, F.lit("bolt")), 2)
    return table(spark, sf, "part").select("p_partkey", rank.alias("rank"), "p_size", "p_retailprice").where("rank IS NOT NULL").orderBy("rank", F.desc("p_size"), F.desc("p_retailprice"), "p_partkey").limit(25).select("p_partkey", "rank")


@query("""WITH s AS (SELECT p_partkey AS id, lower(p_name) AS name FROM part), c AS (SELECT name, min(id) AS rep FROM s GROUP BY 1),
w AS (SELECT rep, name, list_distinct(list_filter(regexp_split_to_array(name, '[^a-z0-9]+'), lambda w: w <> '')) AS ws FROM c),
p AS (SELECT x.rep AS a, y.rep AS b, len(list_intersect(x.ws, y.ws)) AS i, len(list_distinct(list_concat(x.ws, y.ws))) AS u FROM w x JOIN w y ON x.rep < y.rep)
SELECT a, b, round(i / u, 4) AS similarity FROM p WHERE i > 0 AND i * 2 >= u UNION ALL SELECT rep, id, 1.0::DOUBLE FROM s JOIN w ON w.name = s.name WHERE id <> rep AND len(ws) > 0""")
def jaccard_names(spark, sf):
    """Classes of equal names of all parts with their members, and classes with a word-set similarity of a half or more."""
    return X.similar_name_classes(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@query("""WITH n AS (SELECT DISTINCT lower(p_type) AS t FROM part), w AS (SELECT t, list_distinct(list_filter(regexp_split_to_array(t, '[^a-z0-9]+'), lambda w: w <> '')) AS ws FROM n),
h AS (SELECT p_partkey AS id, lower(p_type) || ' ' || CAST(p_size AS VARCHAR) AS name FROM part)
SELECT id, t, round(least(length(t), length(name)) / greatest(length(t), length(name)), 4) AS ratio FROM h JOIN n ON contains(name, t) WHERE length(t) >= 6 AND least(length(t), length(name)) / greatest(length(t), length(name)) >= 0.65""")
def fuzzy_containment(spark, sf):
    """Names contained in longer ones, found by their rarest letters."""
    p = table(spark, sf, "part")
    h = p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", F.lower("p_type"), F.col("p_size").cast("string")).alias("name"))
    n = p.select(F.lower("p_type").alias("name")).distinct().withColumn("id", F.col("name"))
    named = n.select(F.col("id").alias("a"), F.col("name").alias("name_a"))
    pairs = K.contained(named, h.select(F.col("id").alias("b"), F.col("name").alias("name_b"))).withColumn("ratio", X.contains_ratio(F.col("name_a"), F.col("name_b")))
    return pairs.where((F.length("name_a") >= 6) & (F.col("ratio") >= 0.65)).select(F.col("b").alias("id"), F.col("a").alias("t"), "ratio")


@query("""SELECT message_key, coalesce(o_orderstatus, 'not_found') AS outcome FROM (SELECT 'm' || CAST(p_partkey * 3 AS VARCHAR) AS message_key, p_partkey * 3 AS k FROM part) r LEFT JOIN orders ON o_orderkey = k""")
def batch_status_lookup(spark, sf):
    """A batch of keys with their row or not_found."""
    r = table(spark, sf, "part").select((F.col("p_partkey") * 3).alias("k"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return r.join(o, r.k == o.o_orderkey, "left").select(F.concat(F.lit("m"), F.col("k").cast("string")).alias("message_key"), F.coalesce("o_orderstatus", F.lit("not_found")).alias("outcome"))


@query(f"""WITH {M.SQL_BASE} SELECT o_orderkey AS id, coalesce(b.status, 'new') AS status, acked_crm FROM orders LEFT JOIN b ON b.id = o_orderkey AND o_orderkey % 2 = 0""")
def merge_preserving_exports(spark, sf):
    """Replaced messages keep the export state of the stored ones."""
    new = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    old = M.from_orders(spark, sf, lines=False).where("id % 2 = 0").select("id", "status", "acked_crm")
    return new.join(old, "id", "left").select("id", F.coalesce("status", F.lit("new")).alias("status"), "acked_crm")


@query("""SELECT s.event_type AS canonical, count(*) AS hits FROM (SELECT event_id, lower(event_type) AS t FROM events) e JOIN (SELECT DISTINCT event_type FROM events WHERE event_type <> 'click') s ON s.event_type = e.t GROUP BY 1""")
def profile_match(spark, sf):
    """Rows joined to profiles by a normalised key."""
    e = table(spark, sf, "events").select(F.lower("event_type").alias("t"))
    s = table(spark, sf, "events").where("event_type <> 'click'").select(F.col("event_type").alias("canonical")).distinct()
    return e.join(s, e.t == s.canonical).groupBy("canonical").agg(F.count("*").alias("hits"))


@query("""SELECT c_mktsegment AS domain, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS corrections, round(count(*) FILTER (WHERE c_acctbal < 0) / count(*), 4) AS rate FROM customer GROUP BY 1 HAVING count(*) FILTER (WHERE c_acctbal < 0) >= 3""")
def correction_rate(spark, sf):
    """Corrections by domain where there are at least three."""
    bad = F.count_if(F.col("c_acctbal") < 0)
    return (
        table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("domain"))
        .agg(F.count("*").alias("n"), bad.alias("corrections"), F.round(F.try_divide(bad, F.count("*")), 4).alias("rate")).where("corrections >= 3")
    )


# Sets and dedup


@query("""WITH f AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(p_brand) WHEN 1 THEN lower(p_brand) ELSE p_brand END AS b FROM part) SELECT lower(b) AS key, arg_min(b, p_partkey) AS shown, count(*) AS n FROM f GROUP BY 1""")
def dedup_case_insensitive(spark, sf):
    """U4: one row for each spelling regardless of case, in its first casing."""
    k = F.col("p_partkey") % 3
    b = F.when(k == 0, F.upper("p_brand")).when(k == 1, F.lower("p_brand")).otherwise(F.col("p_brand"))
    f = table(spark, sf, "part").select("p_partkey", b.alias("b"))
    return f.groupBy(F.lower("b").alias("key")).agg(F.min_by("b", "p_partkey").alias("shown"), F.count("*").alias("n"))


@query("""SELECT upper(regexp_replace(p_name, '[^A-Za-z0-9]+', '', 'g')) AS key, min(p_partkey) AS first_id, count(*) AS n FROM part GROUP BY 1""")
def dedup_alnum_key(spark, sf):
    """Articles by their letters and digits."""
    return table(spark, sf, "part").groupBy(F.upper(F.regexp_replace("p_name", "[^A-Za-z0-9]+", "")).alias("key")).agg(F.min("p_partkey").alias("first_id"), F.count("*").alias("n"))


@query("""SELECT md5(coalesce(text, '')) AS text_md5, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1""")
def dedup_exact(spark, sf):
    """Equal texts by digest."""
    return table(spark, sf, "documents").groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("text_md5")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


@query("""SELECT c_custkey, sha1(concat(coalesce(c_mktsegment, ''), '|', coalesce(c_name, ''), '|', CAST(c_nationkey AS VARCHAR))) AS message_key, sha256(c_name) AS idempotency_key FROM customer""")
def message_key_hash(spark, sf):
    """Digests of joined fields; a null is an empty slot."""
    slot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return table(spark, sf, "customer").select("c_custkey", F.sha1(F.concat_ws("|", slot("c_mktsegment"), slot("c_name"), slot("c_nationkey"))).alias("message_key"), F.sha2("c_name", 256).alias("idempotency_key"))


@query("""SELECT c_name AS name FROM customer UNION SELECT s_name FROM supplier UNION SELECT p_name FROM part""")
def union_names(spark, sf):
    """Distinct union of the names of all customers, suppliers and parts."""
    c, s, p = (table(spark, sf, t) for t in ("customer", "supplier", "part"))
    return c.select(F.col("c_name").alias("name")).union(s.select("s_name")).union(p.select("p_name")).distinct()


@query("""SELECT message_key, array_to_string(list_filter(['company', 'inn', 'phone', 'priority'], lambda f: CASE f WHEN 'company' THEN NOT coalesce(trim(company) <> '', false) WHEN 'inn' THEN inn IS NULL WHEN 'phone' THEN phone IS NULL ELSE priority IS NULL END), '|') AS missing FROM (WITH """ + M.SQL_BASE + """ SELECT * FROM b) x""")
def missing_fields(spark, sf):
    """Asked for and not present."""
    present = F.array_compact(F.array(*(F.when(F.trim(F.col(c)) != "", F.lit(c)) for c in ("company", "inn", "phone", "priority"))))
    asked = F.array_union(F.array(F.lit("company"), F.lit("inn")), F.array(F.lit("inn"), F.lit("phone"), F.lit("priority")))
    return M.from_orders(spark, sf, lines=False).select("message_key", F.array_join(F.array_except(asked, present), "|").alias("missing"))


@query("""WITH g AS (SELECT l_orderkey, l_partkey, count(*) AS lines, count(DISTINCT l_quantity) AS quantities, sum(l_quantity) AS total FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_partkey, lines, quantities, total, quantities > 1 AS conflict FROM g WHERE lines > 1""")
def line_item_merge(spark, sf):
    """Repeated articles of an order; different quantities are a conflict."""
    g = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("lines"), F.count_distinct("l_quantity").alias("quantities"), F.sum("l_quantity").alias("total"))
    return g.where("lines > 1").withColumn("conflict", F.col("quantities") > 1)


@query("""SELECT n_name AS value, length(n_name) AS n FROM nation a WHERE NOT EXISTS (SELECT 1 FROM nation b WHERE b.n_name <> a.n_name AND contains(b.n_name, a.n_name) AND length(b.n_name) - length(a.n_name) <= 4)""")
def absorption_dedup(spark, sf):
    """Names that no slightly longer name contains, found by their rarest letters."""
    names = table(spark, sf, "nation").select("n_name").distinct()
    short, long = names.select(F.col("n_name").alias("a"), F.col("n_name").alias("name_a")), names.select(F.col("n_name").alias("b"), F.col("n_name").alias("name_b"))
    gone = K.contained(short, long).where((F.col("a") != F.col("b")) & (F.length("b") - F.length("a") <= 4)).select(F.col("a").alias("n_name"))
    return names.join(gone, "n_name", "left_anti").select(F.col("n_name").alias("value"), F.length("n_name").cast("long").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice * 2 <> o_totalprice + o_custkey THEN 1 ELSE 0 END + CASE WHEN o_orderstatus IS DISTINCT FROM CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'F' END THEN 1 ELSE 0 END AS changed FROM orders""")
def analysis_diff(spark, sf):
    """How many of two fields differ, nulls being values."""
    other = F.when(F.col("o_orderkey") % 4 != 0, F.lit("F"))
    changed = (F.col("o_totalprice") * 2 != F.col("o_totalprice") + F.col("o_custkey")).cast("int") + (~F.col("o_orderstatus").eqNullSafe(other)).cast("int")
    return table(spark, sf, "orders").select("o_orderkey", changed.alias("changed"))


@query("""SELECT * FROM (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS message_key, field_name, field_value FROM customer
  CROSS JOIN LATERAL (VALUES ('name', c_name), ('segment', nullif(c_mktsegment, 'BUILDING')), ('nation', CAST(c_nationkey AS VARCHAR))) v(field_name, field_value)) x WHERE field_value IS NOT NULL""")
def extracted_fields_long(spark, sf):
    """Fields as rows, empty ones dropped."""
    c = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("message_key"), F.col("c_name").alias("name"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.col("c_nationkey").cast("string").alias("nation"),
    )
    return c.unpivot("message_key", ["name", "segment", "nation"], "field_name", "field_value").where("field_value IS NOT NULL")


# Windows


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) x WHERE rn = 1")
def best_candidate(spark, sf):
    """The best row of each group."""
    return X.best_of(table(spark, sf, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")]).select("p_brand", "p_partkey", "p_retailprice")


@query("SELECT p_brand, p_partkey, rn AS rank, rn = 1 AS is_selected FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) x WHERE rn <= 2")
def second_candidate(spark, sf):
    """Candidates with their rank."""
    rn = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return table(spark, sf, "part").select("p_brand", "p_partkey", rn.alias("rank")).where("rank <= 2").withColumn("is_selected", F.col("rank") == 1)


@query("SELECT p_type, p_brand, max(p_retailprice) AS confidence FROM part GROUP BY 1, 2")
def max_per_value(spark, sf):
    """The largest confidence of a (type, value)."""
    return table(spark, sf, "part").groupBy("p_type", "p_brand").agg(F.max("p_retailprice").alias("confidence"))


@query("SELECT user_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) x WHERE rn = 1")
def latest_status(spark, sf):
    """The last event of each user, without a sort."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


@query("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 59 SECONDS PRECEDING AND CURRENT ROW) AS attempts FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events) e""")
def rate_limit_window(spark, sf):
    """Attempts of a user in the last 60 seconds, the lower end excluded."""
    sec = F.unix_seconds(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("sec").rangeBetween(-59, 0)
    return table(spark, sf, "events").select("event_id", "user_id", sec.alias("sec")).select("event_id", "user_id", F.count("*").over(w).alias("attempts"))


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) > 3600 THEN 1 ELSE 0 END AS first FROM events),
i AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS mentions, count(DISTINCT event_type) AS kinds FROM i GROUP BY 1, 2""")
def mention_islands(spark, sf):
    """Runs of events with gaps of at most an hour."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(w).cast("timestamp"))
    g = table(spark, sf, "events").withColumn("first", F.when(gap.isNull() | (gap > 3600), 1).otherwise(0))
    i = g.withColumn("island", F.sum("first").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return i.groupBy("user_id", "island").agg(F.count("*").alias("mentions"), F.count_distinct("event_type").alias("kinds"))


@query("""WITH t AS (SELECT DISTINCT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM conversations),
f AS (SELECT conv_id, w, min(turn) AS first_turn FROM t GROUP BY 1, 2)
SELECT c.conv_id, c.turn, (SELECT count(*) FROM f WHERE f.conv_id = c.conv_id AND f.first_turn = c.turn) AS new_signals FROM (SELECT DISTINCT conv_id, turn FROM conversations) c""")
def thread_new_signal(spark, sf):
    """Words that no earlier turn of the thread has; each word's first turn is a minimum, not a cumulative set."""
    c = table(spark, sf, "conversations")
    words = c.select("conv_id", "turn", F.explode(X.word_set(F.col("text"))).alias("w"))
    first = words.groupBy("conv_id", "w").agg(F.min("turn").alias("turn")).groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
    return c.select("conv_id", "turn").distinct().join(first, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("n", F.lit(0)).alias("new_signals"))


@query("""SELECT project_id, message_key FROM (SELECT *, row_number() OVER (PARTITION BY project_id, id % 64 ORDER BY created_at DESC, id DESC) AS rn FROM (WITH """ + M.SQL_BASE + """ SELECT * FROM b) z) y WHERE rn <= 20""")
def retention_caps(spark, sf):
    """The newest rows of each store shard."""
    w = Window.partitionBy("project_id", F.col("id") % 64).orderBy(F.desc("created_at"), F.desc("id"))
    m = M.from_orders(spark, sf, lines=False)
    return m.withColumn("rn", F.row_number().over(w)).where("rn <= 20").select("project_id", "message_key")
