"""Event health run and the mailing that reports it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zealmark.operators.health import event_grade, event_ratios, event_score, headline_percent
from zealmark.operators.outreach import outreach_messages, percent_text
from zealmark.session import stage


def event_health(events: DataFrame, implementation: DataFrame, as_of: str | datetime, zero_range: str = "reference") -> DataFrame:
    """Events with ratios, score and grade."""
    rated = stage(event_ratios(events, implementation, as_of), "event-ratios")
    return event_grade(event_score(rated, zero_range), as_of)


def weekly_messages(
    graded: DataFrame,
    recipients: DataFrame,
    as_of: str | datetime,
    template: str,
    subject: str,
    sender_address: str,
    sender_name: str,
    address: str = "emailaddress",
    user_name: str = "firstname",
) -> DataFrame:
    """One message per recipient with the week's percentage of events that are not graded C."""
    percent = headline_percent(graded, as_of).first()["percent"]
    tags = F.create_map(
        F.lit("PERCENT"), percent_text(F.lit(percent).cast("double")), F.lit("USER_NAME"), F.col(user_name)
    )
    return outreach_messages(recipients, tags, template, subject, sender_address, sender_name, address)
