"""Sinks and what they send: CSV and JSON exports, CRM payloads, the webhook outbox."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds to wait after an attempt; the last one holds for all later attempts.
BACKOFF_S = (60, 300, 900, 3600, 21_600)
MAX_ATTEMPTS = 5
CSV_COLUMNS = ("message_key", "project_id", "status", "priority", "risk", "label", "company", "inn", "phone", "sender_email", "subject")


def csv_value(c: str) -> Column:
    """Quoted only if it holds a quote, comma or line feed; null is empty."""
    v = F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.when(v.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_lines(m: DataFrame) -> DataFrame:
    """``message_key`` and its CSV line; arrays are joined by ``|``."""
    arrays = [F.array_join(c, "|") for c in ("brands", "articles")]
    return m.select("message_key", F.concat_ws(",", *map(csv_value, CSV_COLUMNS), *arrays, F.col("n_attachments").cast("string")).alias("line"))


def write_export(m: DataFrame, path: str, kind: str = "jsonl") -> None:
    """The whole filtered set as JSON lines, CSV or Parquet."""
    if kind == "jsonl":
        m.write.json(path)
    elif kind == "csv":
        flat = m.select(*(F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in m.dtypes))
        flat.write.csv(path, header=True, quote='"', escape='"')
    elif kind == "parquet":
        m.write.parquet(path)
    else:
        raise ValueError(f"no export {kind}")


#: Field names of each target: ours to theirs. Fixed values.
CRM_FIELDS: dict[str, dict[str, str]] = {
    "generic": {"message_key": "external_id", "company": "company", "inn": "tax_id", "phone": "phone", "sender_email": "email", "subject": "title", "total": "amount"},
    "amocrm": {"message_key": "request_id", "company": "company_name", "phone": "PHONE", "sender_email": "EMAIL", "subject": "name", "total": "price"},
    "bitrix24": {"message_key": "ORIGIN_ID", "company": "COMPANY_TITLE", "phone": "PHONE", "sender_email": "EMAIL", "subject": "TITLE", "total": "OPPORTUNITY"},
    "1c": {"message_key": "Number", "company": "Counterparty", "inn": "INN", "subject": "Comment", "total": "Sum"},
}


def crm_payloads(m: DataFrame, target: str) -> DataFrame:
    """``m`` with ``payload``, the JSON that a CRM target takes (S19, S21); nulls are left out."""
    own = [F.col(a).alias(b) for a, b in CRM_FIELDS[target].items()]
    return m.withColumn("payload", F.to_json(F.struct(*own, *([F.col("articles").alias("articles")] if "articles" in m.columns else []))))


def sync_batch(m: DataFrame, limit: int = 50) -> DataFrame:
    """Ready messages that the consumer hasn't acknowledged, oldest first."""
    return m.where((F.col("status") == "ready_for_crm") & F.col("acked_crm").isNull()).orderBy("created_at", "message_key").limit(limit)


def backoff(attempts: Column) -> Column:
    """Seconds until the next attempt."""
    wait = F.lit(BACKOFF_S[-1])
    for n, s in reversed(list(enumerate(BACKOFF_S[:-1], 1))):
        wait = F.when(attempts == n, s).otherwise(wait)
    return F.when(attempts == 0, 0).otherwise(wait)


def due(d: DataFrame, now: str, limit: int = 20) -> DataFrame:
    """Pending deliveries whose next attempt is due at ``now``."""
    when = F.col("created_at") + F.make_dt_interval(secs=backoff(F.col("attempts")).cast("decimal(18,6)"))
    return (
        d.where((F.col("status") == "pending") & (F.col("attempts") < MAX_ATTEMPTS)).withColumn("next_attempt_at", when)
        .where(F.col("next_attempt_at") <= F.lit(now).cast(d.schema["created_at"].dataType)).orderBy("next_attempt_at", "key").limit(limit)
    )


def signature(body: bytes, secret: bytes) -> str:
    """HMAC-SHA256 of a webhook body."""
    return hmac.new(secret, body, hashlib.sha256).hexdigest()


def deliver(d: DataFrame, post: Callable[[str, dict[str, str]], int], secret: bytes) -> DataFrame:
    """Send each payload with its signature; ``key``, ``response_status`` and ``last_error``.

    ``post`` (payload, headers) -> status runs on the executors, a partition at a time.
    """
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = []
            for key, payload in zip(pdf["key"], pdf["payload"], strict=True):
                try:
                    rows.append((key, post(payload, {"X-Signature": signature(payload.encode(), secret)}), None))
                except Exception as e:
                    rows.append((key, None, str(e)))
            out = pd.DataFrame(rows, columns=["key", "response_status", "last_error"])
            yield out.astype({"response_status": "Int32"})

    return d.select("key", "payload").mapInPandas(run, "key string, response_status int, last_error string")


#: Columns of the export of messages and of events. Fixed values.
MESSAGE_COLUMNS = (
    "project_id", "message_key", "thread_id", "created_at", "updated_at", "pipeline_status", "brand", "subject", "from", "classification_label", "classification_confidence", "company_name",
    "inn", "phone", "articles", "product_names", "priority", "risk_level", "sla_overdue", "has_conflicts", "recognition_confirmed", "exported", "crm_company_id", "crm_company_name",
)
EVENT_COLUMNS = ("id", "at", "scope", "type", "project_id", "message_key", "thread_id", "delivery_id", "status", "action", "consumer", "external_id", "summary")
#: Deliveries as the store names them, and as the interface does. Fixed values.
DELIVERY_NAMES = {
    "id": "id", "clientId": "client_id", "clientName": "client_name", "key": "key", "event": "event", "messageKey": "message_key", "pipelineStatus": "pipeline_status", "status": "status", "attempts": "attempts",
    "createdAt": "created_at", "updatedAt": "updated_at", "nextAttemptAt": "next_attempt_at", "lastAttemptAt": "last_attempt_at", "deliveredAt": "delivered_at", "lastError": "last_error", "responseStatus": "response_status",
    "lastManualAction": "last_manual_action",
}


def csv_rows(rows: DataFrame, columns: tuple[str, ...], key: str) -> DataFrame:
    """``key`` and ``line``: the given columns of a row as CSV; arrays are joined by a bar, missing columns and nulls are empty."""

    def value(name: str) -> Column:
        if name not in rows.columns:
            return F.lit("")
        kind = rows.schema[name].dataType.typeName()
        c = F.array_join(name, "|") if kind == "array" else F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss") if kind.startswith("timestamp") else F.col(name).cast("string")
        c = F.coalesce(c, F.lit(""))
        return F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(c)

    return rows.select(F.col(key).alias("key"), F.concat_ws(",", *(value(c) for c in columns)).alias("line"))


def delivery_names(rows: DataFrame) -> DataFrame:
    """Deliveries with the interface's names and all of its columns; missing ones are null."""
    return rows.select(*((F.col(old) if old in rows.columns else F.lit(None).cast("string")).alias(new) for old, new in DELIVERY_NAMES.items()))


def append_new(batch: DataFrame, path: str, key: str, flush: int = 50) -> int:
    """Append the rows of a batch whose key the table does not have yet, one file for about ``flush`` of them; their number.

    A sink for ``foreachBatch``: a batch that comes again adds nothing.
    """
    spark = batch.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    new = batch.dropDuplicates([key])
    if there:
        new = new.join(spark.read.schema(batch.schema).parquet(path).select(key), key, "left_anti").select(*batch.columns)
    new = new.persist()
    n = new.count()
    if n:
        new.write.option("maxRecordsPerFile", flush).mode("append").parquet(path)
    new.unpersist()
    return n
