"""Record linkage: staged lookups, scored matches, owners, assignment.

Stages are equi-joins wherever the semantics allow; a later stage only sees the rows that the
stages before left open. Containment joins use shared words as join keys, so none of them is a
nested loop over both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from posthorn.plans.scratch import drop, materialise, new_path, release

#: Two-part public suffixes that count as one. Fixed values.
TWO_PART = ("co.uk", "com.tr", "com.ua", "com.au", "com.br")
#: Mail hosts that say nothing about a company. Fixed values.
FREE_DOMAINS = ("gmail.com", "mail.ru", "yandex.ru", "outlook.com", "yahoo.com", "hotmail.com")
WEIGHTS = {"brand": 18, "article": 32, "domain": 12}
THRESHOLD, CAP = 35, 95
#: Rows of messages, companies and shared articles that are on disk at a time.
SLICE_ROWS = 50_000_000


def root_domain(host: Column) -> Column:
    """The registrable part of a host without ``www.``."""
    parts = F.split(F.regexp_replace(F.lower(host), "^www\\.", ""), "\\.")
    n = F.size(parts)
    two = F.concat_ws(".", F.slice(parts, -2, 2))
    three = F.when(n >= 3, F.concat_ws(".", F.slice(parts, F.greatest(F.lit(1), n - 2), 3))).otherwise(F.concat_ws(".", parts))
    return F.when(n < 2, F.concat_ws(".", parts)).when(two.isin(*TWO_PART), three).otherwise(two)


def best_of(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group: W1."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def cascade(left: DataFrame, key: str, stages: list[tuple[str, DataFrame]], columns: tuple[str, ...]) -> DataFrame:
    """``left`` with the row of the first stage that has one.

    A stage is a name and a table of ``key`` and ``columns`` with at most one row for a key.
    """
    found = None
    for rank, (name, rows) in enumerate(stages):
        one = rows.select(key, *columns).withColumns({"stage": F.lit(name), "rank": F.lit(rank)})
        found = one if found is None else found.unionByName(one)
    first = found.groupBy(key).agg(F.min_by(F.struct("stage", *columns), "rank").alias("m"))
    return left.join(first, key, "left").select(*left.columns, "m.*")


def scored_matches(signals: DataFrame, history: DataFrame, threshold: int = THRESHOLD, cap: int = CAP, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The best company for each message by shared signals.

    ``signals`` has message, kind and value; ``history`` has company, kind and value. A score of
    more than a brand and a domain needs a shared article or two shared brands, so only companies
    of an article or of a pair of brands are candidates: both are far rarer than a brand, which
    may have a share of all messages and of all companies. Of a message and a company that share
    an article the number of articles is counted, and whether 64-bit signatures of their other
    signals have a bit in common; the other signals are only joined where these can reach the
    threshold. Messages are done in slices of about ``slice_rows`` shared articles each, so that
    the intermediate rows of one slice at a time are on disk.
    """
    if threshold <= WEIGHTS["brand"] + WEIGHTS["domain"]:
        raise ValueError("a brand and a domain would do, so pairs of brands don't find all candidates")
    spark = signals.sparkSession
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64("kind", "value"), F.lit(64)).cast("int"))
    signature = F.coalesce(F.bit_or(F.when(F.col("kind") != "article", bit)), F.lit(0).cast("long")).alias("bits")

    def pairs(rows: DataFrame, owner: str) -> DataFrame:
        own = rows.where("kind = 'brand'").select(owner, "value")
        return own.join(own.select(owner, F.col("value").alias("second")), owner).where("value < second")

    h = materialise(history.distinct(), "history")
    h_article = h.where("kind = 'article'").select("company", "value").join(h.groupBy("company").agg(signature), "company")
    h_article, h_other, h_pairs = materialise(h_article, "history"), h.where("kind <> 'article'"), materialise(pairs(h, "company"), "history")
    per_value = lambda rows, n: rows.where("kind = 'article'").groupBy("value").agg(F.count("*").alias(n))
    shared = per_value(signals, "n").join(per_value(h, "m"), "value").agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]
    slices = max(1, -(-shared // slice_rows))
    path = new_path(spark, "signals")
    signals.select("message", "kind", "value", F.pmod(F.xxhash64("message"), F.lit(slices)).alias("slice")).write.partitionBy("slice").parquet(path)
    stored = spark.read.schema(signals.select("message", "kind", "value").schema.add("slice", "long")).parquet(path)
    weight = F.lit(0)
    for kind, w in WEIGHTS.items():
        weight = F.when(F.col("kind") == kind, w).otherwise(weight)
    out = None
    for n in range(slices):
        s = stored.where(F.col("slice") == n).drop("slice").distinct()
        bits = s.groupBy("message").agg(signature, F.collect_list(F.when(F.col("kind") == "article", F.col("value"))).alias("values"))
        articles = bits.select("message", F.col("bits").alias("own"), F.explode("values").alias("value"))
        both = articles.join(h_article, "value").select("message", "company", (F.col("own").bitwiseAND(F.col("bits")) != 0).alias("more"))
        by_article = both.repartition("message").groupBy("message", "company").agg(F.count("*").alias("articles"), F.first("more").alias("more"))
        by_article = by_article.where(F.col("more") | (F.col("articles") * WEIGHTS["article"] >= threshold)).select("message", "company", "articles")
        by_brands = pairs(s, "message").join(h_pairs, ["value", "second"]).select("message", "company", F.lit(0).cast("long").alias("articles"))
        candidates = materialise(by_article.unionByName(by_brands), "candidates")
        top = F.struct(weight.alias("w"), "kind")
        others = (
            candidates.select("message", "company").distinct().join(h_other, "company").join(s.where("kind <> 'article'"), ["message", "kind", "value"])
            .groupBy("message", "company").agg(F.sum(weight).alias("score"), F.max(top).alias("top"))
        )
        counted = candidates.where("articles > 0").withColumn("kind", F.lit("article")).select("message", "company", (F.col("articles") * WEIGHTS["article"]).alias("score"), top.alias("top"))
        scored = counted.unionByName(others).groupBy("message", "company").agg(F.sum("score").alias("score"), F.max("top").alias("top")).where(F.col("score") >= threshold)
        best = scored.groupBy("message").agg(
            F.min_by(F.struct("company", "score", F.col("top.kind").alias("method")), F.struct(-F.col("score"), F.col("company"))).alias("b"),
            (F.count("*") > 1).alias("multi_company"),
        )
        done = materialise(best.select("message", "b.company", F.least(F.col("b.score"), F.lit(cap)).alias("confidence"), "b.method", "multi_company"), "matches")
        out = done if out is None else out.unionByName(done)
        drop(spark, candidates)
        del s, bits, articles, both, by_article, by_brands, candidates, others, counted, scored, best
        release(spark)
    return out


def first_owner(items: DataFrame, owners: DataFrame, default: str) -> DataFrame:
    """The owner of a message's first owned item by position, else ``default``."""
    order = F.when(F.col("owner").isNotNull(), F.struct("pos", "owner"))
    hits = items.join(owners, "value", "left").groupBy("message").agg(F.min(order).alias("first")).select("message", "first.owner")
    return hits.select("message", F.coalesce("owner", F.lit(default)).alias("owner"))


def round_robin(rows: DataFrame, order: str, names: tuple[str, ...], group: str) -> DataFrame:
    """Names in turn within each ``group``, which should be a fine one: a group is ranked as a whole."""
    turn = F.pmod(F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1, F.lit(len(names)))
    return rows.withColumn("assignee", F.get(F.array(*map(F.lit, names)), turn))


def word_set(c: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words of two word sets, 4 digits."""
    return F.round(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), 4)


def shared_word_pairs(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Pairs (a, b) of names that share a word, by an equi-join on words: the candidates of J10, J11 and J14."""
    l = left.select(F.col("id").alias("a"), F.col(name).alias("name_a"), F.explode(word_set(F.col(name))).alias("word"))  # noqa: E741
    r = right.select(F.col("id").alias("b"), F.col(name).alias("name_b"), F.explode(word_set(F.col(name))).alias("word"))
    return l.join(r, "word").select("a", "b", "name_a", "name_b").distinct()


def similar_name_classes(rows: DataFrame) -> DataFrame:
    """A, b and similarity of names with half of their words in common, over all of ``rows`` (id, name).

    Equal names are a class, represented by its smallest id: a class has a row (representative,
    member, 1) for each other member, and two classes a row of their representatives, so all pairs
    follow without being written. Names are compared once; a pair with a half in common shares one
    of the rarest n // 2 + 1 of n words, so common words alone make no candidates. Null names and
    names without words have no class.
    """
    named = rows.select("id", F.lower("name").alias("name")).where(F.size(word_set(F.col("name"))) > 0)
    classes = named.groupBy("name").agg(F.min("id").alias("rep")).withColumn("words", word_set(F.col("name")))
    words = classes.select("rep", F.explode("words").alias("word"))
    ranked = words.join(words.groupBy("word").agg(F.count("*").alias("n")), "word").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("w"))
    rare = ranked.select("rep", F.explode(F.slice("w", F.lit(1), F.floor(F.size("w") / 2).cast("int") + 1)).alias("w")).select("rep", "w.word")
    pairs = rare.select(F.col("rep").alias("a"), "word").join(rare.select(F.col("rep").alias("b"), "word"), "word").where("a < b").select("a", "b").distinct()
    sets = classes.select("rep", "words")
    both = pairs.join(sets.toDF("a", "words_a"), "a").join(sets.toDF("b", "words_b"), "b")
    shared, every = F.size(F.array_intersect("words_a", "words_b")), F.size(F.array_union("words_a", "words_b"))
    near = both.where(shared * 2 >= every).select("a", "b", F.round(shared / every, 4).alias("similarity"))
    members = named.join(classes.select("name", "rep"), "name").where(F.col("id") != F.col("rep"))
    return near.unionByName(members.select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")))


def contains_ratio(a: Column, b: Column) -> Column:
    """Shorter over longer if one contains the other, else null."""
    inside = F.contains(a, b) | F.contains(b, a)
    return F.when(inside, F.round(F.try_divide(F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))), 4))


def upsert(old: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last new row of a key replaces the old one; other old rows stay."""
    last = best_of(new, [key], order)
    return old.join(last.select(key), key, "left_anti").unionByName(last.select(*old.columns))


def insert_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of ``new`` whose key is not in ``old``."""
    return new.join(old.select(key), key, "left_anti")


def client_candidates(entities: DataFrame, clients: DataFrame, contacts: DataFrame, top: int = 5) -> DataFrame:
    """The best clients for each message: tax number 95, name 85/70 or 40 + 45 * similarity, contact 80, domain 60.

    ``entities``: message, inn, company, email; ``clients``: client, inn, name, domain;
    ``contacts``: client, email. Confidence is the score over 100, at most 0.99.
    """
    e, c = entities, clients.select("client", F.col("inn").alias("c_inn"), F.lower("name").alias("c_name"), F.lower("domain").alias("c_domain"))
    hit = lambda rows, method, score: rows.select("message", "client", F.lit(method).alias("method"), score.cast("double").alias("score"))
    by_inn = hit(e.join(c, e.inn == c.c_inn), "inn", F.lit(95))
    name = F.lower(F.trim("company"))
    words = e.select("message", name.alias("n"), F.explode(word_set(name)).alias("w"))
    pairs = words.join(c.select("client", "c_name", F.explode(word_set(F.col("c_name"))).alias("w")), "w").select("message", "n", "client", "c_name").distinct()
    similar = jaccard(word_set(F.col("n")), word_set(F.col("c_name")))
    score = F.when(F.col("n") == F.col("c_name"), 85).when(F.contains("n", F.col("c_name")) | F.contains("c_name", F.col("n")), 70).when(similar > 0.5, 40 + 45 * similar)
    by_name = hit(pairs.withColumn("s", score).where("s IS NOT NULL"), "name", F.col("s"))
    mails = contacts.select("client", F.lower("email").alias("c_email"))
    by_mail = hit(e.join(mails, F.lower(e.email) == mails.c_email), "email", F.lit(80))
    domain = F.lower(F.substring_index("email", "@", -1))
    known = e.where(F.col("email").isNotNull() & ~domain.isin(*FREE_DOMAINS)).withColumn("d", domain)
    by_domain = hit(known.join(c, known.d == c.c_domain), "domain", F.lit(60))
    best = by_inn.unionByName(by_name).unionByName(by_mail).unionByName(by_domain).groupBy("message", "client").agg(
        F.max(F.struct("score", "method")).alias("b")
    )
    rn = F.row_number().over(Window.partitionBy("message").orderBy(F.desc("b.score"), "client"))
    ranked = best.withColumn("rank", rn).where(F.col("rank") <= top)
    return ranked.select("message", "client", "rank", F.col("b.method").alias("method"), F.least(F.lit(0.99), F.round(F.col("b.score") / 100, 4)).alias("confidence"))


def worker_match(entities: DataFrame, clients: DataFrame, contacts: DataFrame) -> DataFrame:
    """Tax number .95, one client of that name .8 or several .5, contact .9, one client of that domain .75."""
    e = entities
    inn = e.join(clients.select("client", F.col("inn").alias("k")), e.inn == F.col("k")).select("message", "client", F.lit(0.95).alias("confidence"), F.lit("inn").alias("method"))
    names = clients.groupBy(F.lower("name").alias("k")).agg(F.min("client").alias("client"), F.count("*").alias("n"))
    name = e.join(names, F.lower(F.trim("company")) == F.col("k")).select("message", "client", F.when(F.col("n") == 1, 0.8).otherwise(0.5).alias("confidence"), F.lit("name").alias("method"))
    contact = e.join(contacts.select("client", F.lower("email").alias("k")), F.lower("email") == F.col("k")).select("message", "client", F.lit(0.9).alias("confidence"), F.lit("contact").alias("method"))
    domains = clients.groupBy(F.lower("domain").alias("k")).agg(F.min("client").alias("client"), F.count("*").alias("n")).where("n = 1")
    domain = e.join(domains, F.lower(F.substring_index("email", "@", -1)) == F.col("k")).select("message", "client", F.lit(0.75).alias("confidence"), F.lit("domain").alias("method"))
    found = inn.unionByName(name).unionByName(contact).unionByName(domain)
    return found.groupBy("message").agg(F.min_by(F.struct("client", "confidence", "method"), F.struct(-F.col("confidence"), F.col("client"))).alias("b")).select("message", "b.*")


def overlap_gate(query: Column, entry: Column, brand: Column, body: Column, least: int = 3) -> Column:
    """Three shared words or the brand in the query, and the entry's brand in the body."""
    shared = F.size(F.array_intersect(word_set(query), word_set(entry))) >= least
    named = F.contains(F.lower(query), F.lower(brand))
    return F.coalesce((shared | named) & F.contains(F.lower(body), F.lower(brand)), F.lit(False))


def first_seen(rows: DataFrame, by: list[str], value: Column, pos: str) -> DataFrame:
    """Values regardless of case, in order of first appearance, first casing kept."""
    once = rows.groupBy(*by, F.lower(value).alias("key")).agg(F.min_by(value, pos).alias("shown"), F.min(pos).alias("first"))
    return once.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "shown"))), lambda x: x["shown"]).alias("values"))


def shadow_pruned(items: Column) -> Column:
    """U16: articles of an array that are no part of a longer one."""
    return F.filter(items, lambda x: ~F.exists(items, lambda y: (F.length(y) > F.length(x)) & F.contains(y, x)))
