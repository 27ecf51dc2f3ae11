"""Message rows for a mailing. Sending them is left to the mail provider's own client."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent_text(percent: Column) -> Column:
    """83.3 becomes '83.3%'."""
    return F.format_string("%s%%", percent)


def merge_vars(tags: Column) -> Column:
    """Map of tag and content as the list of {name, content} that mail templates take."""
    return F.transform(F.map_entries(tags), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("content")))


def outreach_messages(
    recipients: DataFrame,
    tags: Column,
    template: str,
    subject: str,
    sender_address: str,
    sender_name: str,
    address: str = "emailaddress",
) -> DataFrame:
    """One message per recipient row, with the merge variables of ``tags``."""
    return recipients.select(
        F.col(address).alias("recipient"),
        F.lit(sender_address).alias("from_email"),
        F.lit(sender_name).alias("from_name"),
        F.lit(subject).alias("subject"),
        F.lit(template).alias("template"),
        F.array(F.lit(template)).alias("tags"),
        merge_vars(tags).alias("vars"),
        F.lit(True).alias("track_clicks"),
        F.lit(True).alias("track_opens"),
    )
