"""What a desk of managers sees: the inbox with its tabs, dashboards, audit lists, retention, scopes and backlogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from posthorn.plans.query_spec import issues, sla_overdue

IGNORED = ("ignored_spam", "fetch_error", "ignored_duplicate")
#: What an attachment filter asks of the file names. Fixed values.
ATTACHMENTS = {"pdf": r"(?i)\.pdf$", "xls": r"(?i)\.xlsx?$", "doc": r"(?i)\.docx?$", "img": r"(?i)\.(jpe?g|png|gif|bmp|webp|tiff?)$"}
#: Columns that a list of messages has only on request, and what ``all`` stands for. Fixed values.
OPTIONAL = ("body", "audit", "attachments_analysis", "extraction_meta")
#: Rows that are kept for a project. Fixed values.
CAPS = {"message": 5000, "delivery": 5000, "run": 10, "analysis": 10, "idempotency_key": 20}
#: Names that are no brands. Fixed values.
NO_BRANDS = r"(?iu)^(?:РОССИЯ|RUSSIA|ITEM|N/A|NA|NONE|UNKNOWN|БРЕНД|BRAND|МУЛЬТИБРЕНДОВАЯ|МОНОБРЕНДОВАЯ)$"


def included(m: DataFrame, include: str | None, optional: tuple[str, ...] = OPTIONAL) -> DataFrame:
    """``m`` without the optional columns that a comma list does not name; ``all`` names them all, other names are ignored."""
    asked = {x.strip().lower() for x in (include or "").split(",")}
    return m.select(*(c for c in m.columns if c not in optional or "all" in asked or c in asked))


def is_request(weight: Column) -> Column:
    return F.coalesce(weight >= 3, F.lit(False))


def inbox(m: DataFrame, tab: str = "all", status: str | None = None, mailbox: str | None = None, attachment: str | None = None, llm: str | None = None, text: str | None = None) -> DataFrame:
    """messages of a tab (requests, moderation, spam, all) or, instead of it, of a status, narrowed by the other filters.

    ``m`` has status, label, weight (the largest of a matched rule), mailbox, attachments, llm_done, subject,
    sender_email, company and preview. Unknown values of a filter are no filter.
    """
    s, request = F.col("status"), is_request(F.col("weight"))
    open_ = ~s.isin(*IGNORED)
    tabs = {"requests": request, "spam": s == "ignored_spam", "moderation": open_ & ~request & ((F.col("label") == "client") | s.isin("ready_for_crm", "needs_clarification", "review"))}
    out = m.where(F.coalesce(s == status if status else tabs.get(tab, open_), F.lit(False)))
    if mailbox:
        out = out.where(F.col("mailbox") == mailbox)
    if attachment in ("has", "none"):
        out = out.where((F.size(F.coalesce("attachments", F.array().cast("array<string>"))) > 0) == (attachment == "has"))
    elif attachment in ATTACHMENTS:
        out = out.where(F.exists("attachments", lambda a: a.rlike(ATTACHMENTS[attachment])))
    if llm in ("llm_done", "llm_pending"):
        out = out.where(F.coalesce("llm_done", F.lit(False)) == (llm == "llm_done"))
    if text:
        out = out.where(F.contains(F.lower(F.concat_ws(" ", "subject", "sender_email", "mailbox", "company", "preview")), F.lit(text.lower())))
    return out


def inbox_order(by: str | None) -> list[Column]:
    """Newest first, or date-asc, confidence-asc, confidence-desc or mailbox; ties by the message key."""
    confidence = F.coalesce("confidence", F.lit(0.0))
    orders = {"date-asc": F.asc("created_at"), "confidence-asc": confidence.asc(), "confidence-desc": confidence.desc(), "mailbox": F.coalesce("mailbox", F.lit("")).asc()}
    return [orders.get(by or "", F.desc("created_at")), F.asc("message_key")]


def message_report(m: DataFrame) -> DataFrame:
    """A1: ``section``, ``value`` and ``n`` of all counts of the message summary, from one pass with partial counts."""
    dim = lambda name, c: F.struct(F.lit(name).alias("section"), F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("unknown")).alias("value"))
    flag = lambda name, c: F.struct(F.lit("count").alias("section"), F.when(c, name).alias("value"))
    confirmed = F.col("confirmed_at").isNotNull()
    entries = [
        dim("status", "status"), dim("classification", "label"), dim("priority", "priority"), dim("risk", "risk"), flag("total", F.lit(True)), flag("confirmed", confirmed),
        flag("unconfirmed", ~confirmed), flag("conflicts", F.col("has_conflicts")), flag("exported", F.col("acked_crm").isNotNull()), flag("with_attachments", F.col("n_attachments") > 0),
        flag("parsed_attachments", F.col("parsed_attachment")), flag("sla_overdue", sla_overdue()),
    ]
    each = m.select(F.explode(F.array(*entries)).alias("e")).where(F.col("e.value").isNotNull())
    return each.groupBy("e.section", "e.value").agg(F.count("*").alias("n"))


def problem_report(m: DataFrame) -> DataFrame:
    """``issue`` and ``messages``, the most frequent first; the issue ``any`` counts messages with a problem."""
    found = m.select(issues().alias("issues")).where(F.size("issues") > 0)
    return found.select(F.explode(F.array_append("issues", F.lit("any"))).alias("issue")).groupBy("issue").agg(F.count("*").alias("messages")).orderBy(F.desc("messages"), "issue")


def problem_sample(m: DataFrame, top: int = 20) -> DataFrame:
    """A3: the newest messages with a problem, 100 at most."""
    found = m.withColumn("issues", issues()).where(F.size("issues") > 0)
    at = F.coalesce("updated_at", "created_at")
    return found.orderBy(F.desc(at), F.desc("message_key")).limit(min(top, 100)).select("message_key", "status", at.alias("changed_at"), F.array_join("issues", "|").alias("issues"), sla_overdue().alias("sla_overdue"))


def threads(m: DataFrame) -> DataFrame:
    """A4: all of a thread: times, participants, subjects, statuses, priorities, risks, flags and keys; lists are distinct and sorted."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))), "|")
    return m.groupBy(F.coalesce("thread_id", F.concat(F.lit("message:"), F.col("message_key"))).alias("thread_id")).agg(
        F.count("*").alias("messages"), F.min("created_at").alias("first_at"), F.max(F.coalesce("updated_at", "created_at")).alias("last_at"),
        *(joined(c).alias(a) for c, a in (("sender_email", "participants"), ("subject", "subjects"), ("status", "statuses"), ("priority", "priorities"), ("risk", "risks"))),
        F.bool_or("has_conflicts").alias("has_conflicts"), F.bool_or(F.coalesce(sla_overdue(), F.lit(False))).alias("sla_overdue"), F.array_join(F.array_sort(F.collect_list("message_key")), "|").alias("keys"),
    )


def delivery_report(d: DataFrame) -> DataFrame:
    """A5: ``section``, ``value`` and ``n`` of statuses, response codes and reasons of failure, from one pass."""
    pair = lambda name, c: F.struct(F.lit(name).alias("section"), c.cast("string").alias("value"))
    failed = (F.col("status") == "failed") | F.col("last_error").isNotNull()
    reason = F.when(failed, F.trim(F.coalesce("last_error", F.lit("Unknown error"))))
    entries = F.array(pair("status", F.coalesce("status", F.lit("unknown"))), pair("response", F.col("response_status")), pair("failure", reason))
    return d.select(F.explode(entries).alias("e")).where("e.value IS NOT NULL").groupBy("e.section", "e.value").agg(F.count("*").alias("n"))


def recent_failures(d: DataFrame, top: int = 5) -> DataFrame:
    """A5: the failed deliveries that changed last, 20 at most."""
    return d.where((F.col("status") == "failed") | F.col("last_error").isNotNull()).orderBy(F.desc("updated_at"), "key").limit(min(top, 20))


def brand_counts(m: DataFrame, own: tuple[str, ...] = ()) -> DataFrame:
    """``brand`` and ``n``: mentions of brands in messages that are not ignored, whatever their spelling.

    ``m`` has status and brands. Spellings that agree in letters and digits are one brand, shown in capitals if it occurs
    so, else by its longest spelling (the first of these in order). Own and generic names, numbers and addresses are none.
    """
    tidy = F.trim(F.regexp_replace("brand", "[\"'`]+", ""))
    for pattern, by in ((r"\s+", " "), (r"\s*/\s*", " / "), (r"\s*-\s*", "-")):
        tidy = F.regexp_replace(tidy, pattern, by)
    each = m.where(~F.coalesce(F.col("status").isin("ignored_spam", "ignored_duplicate"), F.lit(False))).select(F.explode("brands").alias("brand")).select(tidy.alias("brand"))
    key = F.regexp_replace(F.upper("brand"), r"[.\s/_-]+", "")
    noise = (F.length("brand") < 2) | F.col("brand").rlike(NO_BRANDS) | F.col("brand").rlike(r"^[0-9.-]+$") | F.col("brand").rlike(r"(?i)@|\.(?:RU|COM|NET|ORG|SU|ONLINE|PRO)\b")
    kept = each.withColumn("key", key).where((F.col("key") != "") & ~noise & ~F.lower("brand").isin(*(o.lower() for o in own), ""))
    forms = kept.groupBy("key", "brand").agg(F.count("*").alias("n"))
    rank = F.struct((F.col("brand") != F.upper("brand")).cast("int"), -F.length("brand"), F.col("brand"))
    return forms.groupBy("key").agg(F.min_by("brand", rank).alias("brand"), F.sum("n").alias("n")).drop("key")


def retained(rows: DataFrame, by: str = "project_id", at: str = "created_at", key: str = "key", kind: str = "kind", caps: dict[str, int] | None = None) -> DataFrame:
    """Of each project and kind the newest rows, as many as ``caps`` says; kinds without a cap stay whole."""
    caps = CAPS if caps is None else caps
    limit = F.element_at(F.create_map(*(F.lit(x) for p in caps.items() for x in p)), F.col(kind))
    rank = F.row_number().over(Window.partitionBy(by, kind).orderBy(F.desc(at), F.asc(key)))
    # Ranks beyond every cap are cut before rows are shuffled; the cap of the kind decides afterwards.
    capped = rows.where(F.col(kind).isin(*caps)).withColumn("__n", rank).where(F.col("__n") <= max(caps.values())).where(F.col("__n") <= limit).drop("__n")
    return capped.unionByName(rows.where(~F.coalesce(F.col(kind).isin(*caps), F.lit(False))))


def audit_page(log: DataFrame, email: str | None = None, user: str | None = None, action: str | None = None, since: str | None = None, skip: int = 0, take: int = 50) -> DataFrame:
    """entries of a mail, a user or an action since a time, the newest first."""
    for column, value in (("email_id", email), ("user_id", user), ("action", action)):
        if value is not None:
            log = log.where(F.col(column) == value)
    if since is not None:
        log = log.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    return log.orderBy(F.desc("created_at"), F.desc("id")).offset(skip).limit(take)


def templates(rules: DataFrame, scope: str | None = None, classifier: str | None = None, is_active: bool | None = None, skip: int = 0, take: int = 50) -> DataFrame:
    """rules by optional equalities, ordered by class and falling weight, with the number of all that fit."""
    for column, value in (("scope", scope), ("classifier", classifier), ("is_active", is_active)):
        if value is not None:
            rules = rules.where(F.col(column) == value)
    total = rules.agg(F.count("*").alias("total"))
    return rules.orderBy("classifier", F.desc("weight"), "id").offset(skip).limit(take).withColumn("total", total.scalar())


def clients(rows: DataFrame, search: str | None = None, has_inn: bool | None = None) -> DataFrame:
    """clients whose name, tax id or domain holds ``search``, with or without a tax id."""
    if search:
        low = search.lower()
        rows = rows.where(F.contains(F.lower("legal_name"), F.lit(low)) | F.contains("inn", F.lit(search)) | F.contains(F.lower("domain"), F.lit(low)))
    return rows if has_inn is None else rows.where(F.col("inn").isNotNull() == has_inn)


def webhook_targets(messages: DataFrame, subscribers: DataFrame) -> DataFrame:
    """2.17: (message_key, client_id) for enabled clients with a url, the message's project in their scope (none: all) and its status subscribed.

    ``subscribers``: client_id, enabled, url, projects, statuses; it is exploded to one row for each project (or all) and status and joined by status.
    """
    s = subscribers.where(F.col("enabled") & (F.coalesce("url", F.lit("")) != ""))
    scope = F.when(F.size(F.coalesce("projects", F.array().cast("array<string>"))) > 0, F.col("projects")).otherwise(F.array(F.lit("*")))
    wanted = s.select("client_id", F.explode(scope).alias("project"), "statuses").select("client_id", "project", F.explode("statuses").alias("status")).distinct()
    m = messages.select("message_key", F.trim("status").alias("status"), F.explode(F.array(F.col("project_id"), F.lit("*"))).alias("project"))
    return m.join(wanted, ["status", "project"]).select("message_key", "client_id").distinct()


def backlog(m: DataFrame, batch: int = 30) -> DataFrame:
    """Of each project the newest messages that no model has read yet, ``batch`` at most; spam and duplicates are left out."""
    todo = m.where(~F.col("status").isin("ignored_spam", "ignored_duplicate") & (F.coalesce("label", F.lit("")) != "spam") & ~F.coalesce("llm_done", F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("created_at"), "message_key"))
    return todo.withColumn("place", rank).where(F.col("place") <= batch)


#: Fields of a message's long form. Fixed values.
FIELDS = ("sender_email", "sender_name", "sender_position", "company_name", "website", "city_phone", "mobile_phone", "inn", "request_type", "articles", "brands")


def extracted_fields(m: DataFrame, old: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """message_key, field_name, field_value and confidence; the rows of messages that are in ``m`` replace their old ones.

    Empty values have no row; ignored messages and those with an error are not taken.
    """
    good = m.where(~F.coalesce(F.col("status").isin(*IGNORED), F.lit(False)) & (F.coalesce("message_key", F.lit("")) != ""))
    long = good.unpivot(["message_key", "confidence"], list(fields), "field_name", "field_value").where(F.coalesce("field_value", F.lit("")) != "")
    return old.join(good.select("message_key"), "message_key", "left_anti").unionByName(long.select("message_key", "field_name", "field_value", F.coalesce("confidence", F.lit(0.0)).alias("confidence")))


def merged_items(items: DataFrame) -> DataFrame:
    """One item for each (message, article, description in any case): the first by ``pos``, with the last real quantity if its own is missing or one."""
    key = F.upper(F.concat_ws("|", F.coalesce("article", F.lit("")), F.coalesce("description", F.lit(""))))
    real = F.when(F.col("quantity") != 0, F.col("quantity"))
    first = F.min_by(F.struct("pos", "article", "description", "quantity"), "pos")
    # A first quantity other than one stays; else quantities are taken over until one is not one.
    other = F.min_by("quantity", F.when(real.isNotNull() & (real != 1), F.col("pos")))
    one = F.max(F.when(real == 1, 1))
    kept = items.withColumn("k", key).groupBy("message", "k").agg(first.alias("f"), other.alias("other"), one.alias("one"))
    own = F.when((F.col("f.quantity") != 0) & (F.col("f.quantity") != 1), F.col("f.quantity"))
    return kept.select("message", "f.article", "f.description", F.coalesce(own, "other", F.col("one").cast("double"), "f.quantity").alias("quantity"))


#: Fields whose change an analysis shows. Fixed values.
DIFF = ("status", "brands", "articles", "inn", "kpp", "ogrn", "city_phone", "mobile_phone")


def analysis_diff(before: DataFrame, after: DataFrame, key: str = "message_key", fields: tuple[str, ...] = DIFF) -> DataFrame:
    """``key`` and the names of fields that differ between two analyses of a message; a null equals a null."""
    b = before.select(key, *(F.col(f).alias(f"b_{f}") for f in fields))
    both = after.select(key, *fields).join(b, key)
    changed = F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields)))
    return both.select(key, changed.alias("changed"))
