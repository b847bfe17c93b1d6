"""SMS and email campaigns rolled up to days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftfield.functions.scalars import local_day
from liftfield.sources.landed import in_window, number, whole

COST_PER_SMS = 0.01
COST_PER_EMAIL = 0.02


def _first_text(a: str, b: str):
    return F.coalesce(F.nullif(F.col(a), F.lit("")), F.nullif(F.col(b), F.lit("")))


def sms_daily(campaigns: DataFrame, analytics: DataFrame, start, end) -> DataFrame:
    """Daily SMS totals; the day is ``sent_at``, else ``created_at``."""
    dated = campaigns.select(
        "campaign_id", local_day(_first_text("sent_at", "created_at")).alias("date")
    )
    rows = in_window(dated, start, end).join(analytics, "campaign_id").select(
        "date",
        whole("sent").alias("sends"),
        whole("clicked").alias("clicks"),
        number("revenue_attributed").alias("revenue"),
        whole("unsubscribes").alias("unsubscribes"),
    )
    return rows.groupBy("date").agg(
        F.count("*").alias("campaigns_sent"),
        F.sum("sends").alias("total_sends"),
        F.sum("clicks").alias("clicks"),
        F.sum("revenue").alias("revenue"),
        F.sum("unsubscribes").alias("unsubscribes"),
        (F.sum("sends") * COST_PER_SMS).alias("estimated_spend"),
    )


def email_campaign_totals(messages: DataFrame) -> DataFrame:
    """Message counts summed per campaign."""
    return messages.groupBy("campaign_id").agg(
        F.sum(whole("delivered")).alias("delivered"),
        F.sum(whole("opened_unique")).alias("opened"),
        F.sum(whole("clicked_unique")).alias("clicked"),
        F.sum(number("revenue")).alias("revenue"),
        F.sum(whole("unsubscribed")).alias("unsubscribed"),
    )


def email_daily(campaigns: DataFrame, messages: DataFrame, start, end) -> DataFrame:
    """Campaign totals summed per send day; a campaign without messages counts with zeros."""
    dated = campaigns.select(
        "campaign_id", local_day(_first_text("send_time", "scheduled_at")).alias("date")
    )
    rows = in_window(dated, start, end).join(email_campaign_totals(messages), "campaign_id", "left")
    measures = ("delivered", "opened", "clicked", "revenue", "unsubscribed")
    rows = rows.fillna(0, subset=list(measures))
    return rows.groupBy("date").agg(
        F.count("*").alias("campaigns_sent"),
        *[F.sum(m).alias(m) for m in measures],
        (F.sum("delivered") * COST_PER_EMAIL).alias("estimated_spend"),
    )
