"""Summaries of messages and deliveries: one pass each, counted with partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posthorn.plans.query_spec import filled, issues, sla_overdue


def kpis(m: DataFrame) -> DataFrame:
    """All scalar figures of the message summary in one aggregate (A1)."""
    return m.agg(
        F.count("*").alias("total"),
        F.count("confirmed_at").alias("confirmed"),
        (F.count("*") - F.count("confirmed_at")).alias("unconfirmed"),
        F.count_if("has_conflicts").alias("conflicts"),
        F.count("acked_crm").alias("exported"),
        F.count_if(F.col("n_attachments") > 0).alias("with_attachments"),
        F.count_if(sla_overdue()).alias("overdue"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        F.round(F.avg("completeness"), 2).alias("avg_completeness"),
        F.max("created_at").alias("last_message_at"),
    )


def histogram(df: DataFrame, column: str, other: str | None = None) -> DataFrame:
    """``value`` and ``n``; nulls are left out or counted as ``other``."""
    rows = df.where(F.col(column).isNotNull()) if other is None else df
    value = F.col(column) if other is None else F.coalesce(F.col(column), F.lit(other))
    return rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"))


def coverage(m: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Present, missing and rate of each column (A2): one aggregate, then unpivoted. Rates of no rows are null."""
    counted = m.agg(F.count("*").alias("total"), *(F.count_if(filled(F.col(c).cast("string"))).alias(c) for c in columns))
    long = counted.unpivot("total", list(columns), "field", "present")
    return long.select("field", "present", (F.col("total") - F.col("present")).alias("missing"), F.round(F.try_divide("present", "total"), 4).alias("rate"))


def extremes(c: DataFrame) -> DataFrame:
    """Strongest and weakest field and the number of gaps."""
    return c.agg(
        F.min_by("field", F.struct(-F.col("rate"), F.col("field"))).alias("strongest"),
        F.min_by("field", F.struct("rate", "field")).alias("weakest"),
        F.count_if(F.col("rate") < 0.5).alias("gaps"),
    )


def problems(m: DataFrame) -> DataFrame:
    """Messages by issue (A3)."""
    return m.select(F.explode(issues()).alias("issue")).groupBy("issue").agg(F.count("*").alias("messages"))


def threads(m: DataFrame) -> DataFrame:
    """One row for each thread (A4); a message without a thread is one of its own."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    return (
        m.groupBy(F.coalesce("thread_id", F.concat(F.lit("message:"), F.col("message_key"))).alias("thread_id"))
        .agg(
            F.count("*").alias("messages"),
            F.min("created_at").alias("first_at"),
            F.max(F.coalesce("updated_at", "created_at")).alias("last_at"),
            joined("status").alias("statuses"),
            joined("priority").alias("priorities"),
            F.count_distinct("sender_email").alias("participants"),
            F.bool_or(F.col("confirmed_at").isNotNull()).alias("any_confirmed"),
            F.array_join(F.array_sort(F.collect_list("message_key")), "|").alias("keys"),
        )
    )


def delivery_stats(d: DataFrame) -> DataFrame:
    """Counts, success rate and times of deliveries (A5)."""
    is_ = lambda s: F.col("status") == s
    done = F.count_if(is_("delivered") | is_("failed"))
    return d.agg(
        F.count("*").alias("total"),
        F.count_if(is_("delivered")).alias("delivered"),
        F.count_if(is_("failed")).alias("failed"),
        F.count_if(is_("pending")).alias("backlog"),
        F.round(F.try_divide(F.count_if(is_("delivered")), done), 4).alias("success_rate"),
        F.max("created_at").alias("latest_at"),
        F.min(F.when(is_("pending"), F.col("created_at"))).alias("oldest_pending_at"),
    )
