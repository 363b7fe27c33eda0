"""The document store: project files in, flat tables out, and changes as append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posthorn.operators.matching import best_of

#: The parts of a stored message that are read; files may miss any of them.
MESSAGE = (
    "struct<id:string,messageKey:string,createdAt:string,updatedAt:string,mailbox:string,brand:string,subject:string,`from`:string,bodyPreview:string,pipelineStatus:string,"
    "threadId:string,error:string,attachments:array<string>,attachmentFiles:array<struct<filename:string,contentType:string,size:bigint>>,"
    "auditLog:array<struct<at:string,action:string,`from`:string,`to`:string,consumer:string,externalId:string,note:string>>,"
    "integrationExports:map<string,struct<acknowledgedAt:string,consumer:string,externalId:string,note:string>>,recognitionConfirmed:struct<at:string>,detectedBrands:array<string>,"
    "analysis:struct<classification:struct<label:string,confidence:double>,detectedBrands:array<string>,sender:struct<email:string,companyName:string,inn:string,mobilePhone:string,cityPhone:string>,"
    "lead:struct<articles:array<string>,urgency:string,requestType:string>>>"
)
PROJECT = f"id string, name string, type string, brands array<string>, recentMessages array<{MESSAGE}>"


def load(spark: SparkSession, path: str) -> DataFrame:
    """Projects of JSON files, one project or an array of them a file; unknown fields are ignored and missing ones null."""
    return spark.read.schema(PROJECT).option("multiLine", "true").json(path)


def blank(c: str | Column) -> Column:
    """Null for null and blank texts."""
    return F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit(""))


def export_state(exports: Column, consumer: str | None) -> Column:
    """The state for a consumer, else the only one, else the first by name."""
    keys = F.array_sort(F.map_keys(exports))
    first = F.element_at(exports, F.get(keys, F.lit(0)))
    return F.coalesce(F.try_element_at(exports, F.lit(consumer)), first) if consumer else first


def messages(projects: DataFrame, consumer: str | None = None) -> DataFrame:
    """One flat row for each message, aliases settled once."""
    m = projects.select(F.col("id").alias("project_id"), F.explode("recentMessages").alias("m"))
    at = lambda f: F.col(f"m.{f}")
    key = F.coalesce(blank(at("messageKey")), at("id"))
    files = F.when(F.size(at("attachmentFiles")) > 0, F.transform(at("attachmentFiles"), lambda f: f["filename"])).otherwise(at("attachments"))
    audited = F.array_max(F.transform(at("auditLog"), lambda a: a["at"]))
    return m.select(
        "project_id",
        key.alias("message_key"),
        F.try_to_timestamp(at("createdAt")).alias("created_at"),
        F.try_to_timestamp(F.coalesce(audited, blank(at("updatedAt")), at("createdAt"))).alias("updated_at"),
        F.coalesce(blank(at("threadId")), F.concat(F.lit("message:"), key)).alias("thread_id"),
        at("mailbox").alias("mailbox"), at("subject").alias("subject"), at("from").alias("sender"), at("pipelineStatus").alias("status"), at("error").alias("error"),
        F.coalesce(files, F.array().cast("array<string>")).alias("attachments"),
        F.array_distinct(F.filter(F.concat(F.coalesce(at("detectedBrands"), F.array().cast("array<string>")), F.coalesce(at("analysis.detectedBrands"), F.array().cast("array<string>"))), lambda b: F.trim(b) != "")).alias("brands"),
        F.coalesce(at("analysis.lead.articles"), F.array().cast("array<string>")).alias("articles"),
        at("analysis.classification.label").alias("label"), at("analysis.classification.confidence").alias("confidence"),
        blank(at("analysis.sender.companyName")).alias("company"), blank(at("analysis.sender.inn")).alias("inn"),
        F.coalesce(blank(at("analysis.sender.mobilePhone")), blank(at("analysis.sender.cityPhone"))).alias("phone"),
        at("recognitionConfirmed.at").alias("confirmed_at"),
        export_state(at("integrationExports"), consumer).alias("export"),
        F.transform(at("auditLog"), lambda a: F.struct(a["action"].alias("action"), a["at"].alias("at"), a["from"].alias("from_status"), a["to"].alias("to_status"))).alias("audit"),
    )


def events(found: DataFrame) -> DataFrame:
    """The change feed: audit entries of messages and, for threads, the same with the thread's scope."""
    each = found.select("message_key", "thread_id", F.posexplode("audit").alias("n", "a"))
    row = lambda scope, key: each.select(F.concat_ws(":", F.lit(scope), key, F.col("n").cast("string")).alias("id"), F.lit(scope).alias("scope"), F.col("a.action").alias("type"), F.col("a.at").alias("at"), "message_key")
    return row("message", F.col("message_key")).unionByName(row("thread", F.col("thread_id")))


def current_status(found: DataFrame, changes: DataFrame) -> DataFrame:
    """2.16: the status of each message after an append-only table of changes (message_key, at, to_status): the last one holds."""
    last = changes.groupBy("message_key").agg(F.max_by("to_status", F.struct("at", "to_status")).alias("to_status"))
    return found.join(last, "message_key", "left").withColumn("status", F.coalesce("to_status", "status")).drop("to_status")


def acknowledge(acks: DataFrame, batch: DataFrame) -> DataFrame:
    """Bulk acknowledgements (message_key, consumer, external_id, at), once for each message and consumer: the first one stays."""
    both = acks.withColumn("__old", F.lit(0)).unionByName(batch.withColumn("__old", F.lit(1)))
    return best_of(both, ["message_key", "consumer"], [F.col("__old"), F.col("at"), F.col("external_id")]).drop("__old")


def append_suggestions(rows: DataFrame, path: str) -> None:
    """Append JSON lines."""
    rows.write.mode("append").json(path)


def with_cache(found: DataFrame, cache: DataFrame, key: str = "message_key") -> tuple[DataFrame, DataFrame]:
    """Rows with their cached result, and the rows that have none yet."""
    return found.join(cache, key), found.join(cache.select(key), key, "left_anti")


def merge_gaps(found: DataFrame) -> DataFrame:
    """Results of a language model fill what rules left empty: lists are united regardless of case, scalars only fill nulls.

    Input columns: articles, brands, company, phone and the same with the prefix ``llm_``.
    """
    def united(a: str) -> Column:
        known = F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.lower(x))
        fresh = F.filter(F.coalesce(f"llm_{a}", F.array().cast("array<string>")), lambda x: ~F.array_contains(known, F.lower(x)))
        return F.concat(F.coalesce(a, F.array().cast("array<string>")), fresh)

    return found.withColumns({"articles": united("articles"), "brands": united("brands"), "company": F.coalesce(blank("company"), "llm_company"), "phone": F.coalesce(blank("phone"), "llm_phone")})


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A relational table in parallel ranges of a numeric key; filters and columns are pushed down."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.options(**options).load()
