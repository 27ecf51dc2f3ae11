"""Column expressions: keys, time, safe arithmetic, job titles, reproducible draws."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_RANGE = 4503599627370496.0  # 2**52: thirteen hex digits, exact in a double


def item_id(metadata: str = "metadata") -> Column:
    """Item id carried in the JSON metadata of a fact; NULL where absent or not a number."""
    return F.get_json_object(F.col(metadata), "$.ItemId").try_cast("bigint")


def parse_as_of(as_of: str | datetime) -> datetime:
    return as_of if isinstance(as_of, datetime) else datetime.fromisoformat(as_of)


def moment(value: str | datetime) -> Column:
    """Constant timestamp without time zone, folded before the scan so that it is pushed down."""
    return F.lit(str(value)).cast("timestamp_ntz")


def hours_before(as_of: str | datetime, hours: float) -> Column:
    return moment(parse_as_of(as_of) - timedelta(hours=hours))


def micros_between(start: Column, end: Column) -> Column:
    """Whole microseconds between two timestamps without zone; no clock change of the session's zone enters."""
    seconds = (end - start).cast("interval second").cast("decimal(24,6)")
    return (seconds * 1_000_000).cast("bigint")


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def unit_draw(seed: int | str, *keys: str) -> Column:
    """Number in [0, 1) that depends only on the seed and the row's own keys.

    A retried task draws the same number again, which ``rand()`` cannot promise
    after a shuffle.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(DRAW_RANGE)


# Title words and the bucket each one stands for.
# The first matching rule wins; "any case" words are looked up in the lowercased title.
INDIVIDUAL = "Individual Contributor"
TITLE_RULES = (
    # (words in any case, words in capitals only, bucket)
    (("specialist",), (), INDIVIDUAL),
    (("vice president",), ("VP",), "Vice President"),
    (("manager",), (), "Manager"),
    (("director",), (), "Director"),
    (("engineer",), (), "Engineer"),
    (("chief",), ("CEO", "CMO", "CCO", "COO", "CRO", "CTO", "CFO"), "C-Level exec"),
)


def title_bucket(title: str | Column) -> Column:
    """Seniority bucket of a job title; unknown and missing titles are individual contributors."""
    title = F.col(title) if isinstance(title, str) else title
    lowered = F.lower(title)
    bucket = F.lit(INDIVIDUAL)
    for any_case, capitals, name in reversed(TITLE_RULES):
        hit = F.lit(False)
        for word in any_case:
            hit = hit | lowered.contains(word)
        for word in capitals:
            hit = hit | title.contains(word)
        bucket = F.when(hit, F.lit(name)).otherwise(bucket)
    return bucket
