"""What must never be stored: decided from names, before a payload is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values
FILENAME = (
    r"(?iu)pay[\s_-]?slip|payroll|wage[\s_-]?slip|salary[\s_-]?statement|"
    r"(?<![a-z0-9])p60(?!\d)|(?<![a-z0-9])p45(?!\d)|(?<![a-z0-9])w[-_ ]?2(?!\d)|"
    r"form[\s_-]?16|severance|attendance[\s_-]?sheet|timesheet"
)
SUBJECT = (
    r"(?iu)payslip|payroll|salary|salaries|wages|severance|new\s+hire|onboarding|resignation|dismissal|termination|"
    r"sick\s+leave|maternity|paternity|injury\s+report|employment\s+contract|payroll\s+consultant|"
    r"attendance|clock[\s_-]?in|hours\s+worked"
)
OUR_DOMAIN = r"(?iu)@example\."


def is_confidential(filename: Column, subject: Column | None = None, sender: Column | None = None, patterns: tuple[str, str, str] = (FILENAME,
    SUBJECT, OUR_DOMAIN)) -> Column:
    """True by the file's name alone, or by the subject of a message that we
    wrote; never null. Bodies are not looked at."""
    text = lambda c: F.lit("") if c is None else F.coalesce(c, F.lit(""))
    by_name, by_subject, ours = patterns
    return text(filename).rlike(by_name) | (text(sender).rlike(ours) & text(subject).rlike(by_subject))


def gate(attachments: DataFrame, useful: str | None = None, **names: str) -> tuple[DataFrame, DataFrame]:
    """``(kept, held_back)``. Attachments without a name, and those whose name
    ``useful`` (a pattern) does not find, are in neither."""
    column = lambda n: F.col(names.get(n, n))
    rows = attachments.where(F.coalesce(column("filename"), F.lit("")) != "")
    if useful:
        rows = rows.where(column("filename").rlike(useful))
    secret = is_confidential(column("filename"), column("subject"), column("sender"))
    return rows.where(~secret), rows.where(secret)


def held_back_counts(held_back: DataFrame, by: str = "mailbox") -> DataFrame:
    """How many were held back, to be looked at after every run."""
    return held_back.groupBy(by).agg(F.count("*").alias("held_back"))
