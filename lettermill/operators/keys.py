"""Job references in the full text of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.operators.distinct import distinct_on

# Fixed values
WRITTEN_PREFIX, PREFIX = "100", "842."
KIND, CONFIDENCE = "job", 99
TARGET = ["email_id", "kind", "value"]


def reference_pattern(prefix: str = WRITTEN_PREFIX) -> str:
    return rf"{prefix}[.\s]?([0-9]{{3}})\s*[/-]\s*(2[0-9])"


def references(text: Column, written: str = WRITTEN_PREFIX, prefix: str = PREFIX) -> Column:
    """All references in a text, in their canonical form."""
    pattern = reference_pattern(written)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda m: F.concat(F.lit(prefix), F.regexp_extract(m, pattern, 1), F.lit("/"), F.regexp_extract(m, pattern, 2)))


def candidates(messages: DataFrame, since: Column | None = None, written: str = WRITTEN_PREFIX, prefix: str = PREFIX) -> DataFrame:
    """``(id, msg, late, spare, value)``: each reference of each stored copy of
    a message, and how the copy ranks (false before true)."""
    rows = messages if since is None else messages.where(F.col("sent_at") >= since)
    flag = lambda c: ~F.coalesce(F.col(c), F.lit(False)) if c in messages.columns else F.lit(False)
    text = F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))
    same = F.coalesce(F.nullif(F.col("message_id").cast("string"), F.lit("")), F.col("id").cast("string"))
    return rows.select("id", same.alias("msg"), flag("has_key").alias("late"), flag("kept_by_engine").alias("spare"), F.explode(references(text,
        written, prefix)).alias("value"))


def extract_keys(messages: DataFrame, since: Column | None = None, written: str = WRITTEN_PREFIX, prefix: str = PREFIX) -> DataFrame:
    """``(email_id, kind, value, confidence)``, one for each message and reference.

    A message may be stored several times (copies share ``message_id``; without
    one the row's id stands for it). The key goes to the copy that has it
    already (``has_key``), else to the one the engine kept
    (``kept_by_engine``), else to the smallest id; both flags are optional
    columns. Subject and body are read whole.
    """
    picked = distinct_on(candidates(messages, since, written, prefix), [F.col("msg"), F.col("value")], F.struct("late", "spare", "id"))
    return picked.select(F.col("id").alias("email_id"), F.lit(KIND).alias("kind"), "value", F.lit(CONFIDENCE).alias("confidence"))


def new_keys(keys: DataFrame, target: DataFrame, on: list[str] | None = None) -> DataFrame:
    """The keys that ``target`` does not hold; appending them is idempotent."""
    on = on or TARGET
    return keys.dropDuplicates(on).join(target.select(*on), on, "left_anti").select(*keys.columns)
