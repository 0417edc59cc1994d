"""The document archive: one row per document, however often it was received."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.operators.distinct import distinct_on, newest_first

COLUMNS = ["id", "name", "kind", "draft_or_final", "happened_on", "received_at", "subject", "counterparty", "job_ref", "openable", "copies"]


def counterparty(sender: Column, recipients: Column, own_domain: str) -> Column:
    """The other side of a message: the first recipient's domain if we wrote
    it (our own if none can be read), else the sender's domain."""
    addressed = F.nullif(F.regexp_extract(recipients, r"@([A-Za-z0-9._-]+)", 1), F.lit(""))
    ours = sender.ilike(f"%@{own_domain}")
    return F.when(ours, F.coalesce(addressed, F.lit(own_domain))).otherwise(F.split_part(sender, F.lit("@"), F.lit(2)))


def received(attachments: DataFrame, messages: DataFrame, message_files: DataFrame, files: DataFrame, jobs: DataFrame, own_domain: str) -> DataFrame:
    """Attachments with what their messages and jobs say; an attachment without
    a message is left out, one without a job stays."""
    a, m, b, f, j = attachments.alias("a"), messages.alias("m"), message_files.alias("b"), files.alias("f"), jobs.alias("j")
    rows = a.join(m, F.col("m.id") == F.col("a.message_id"))
    rows = rows.join(b, F.col("b.message_id") == F.col("m.id"), "left").join(f, F.col("f.id") == F.col("b.file_id"), "left").join(j,
        F.col("j.id") == F.col("f.job_id"), "left")
    return _shown(rows, own_domain, F.col("j.reference"))


def received_once(attachments: DataFrame, messages: DataFrame, message_files: DataFrame, files: DataFrame, jobs: DataFrame, own_domain: str) -> DataFrame:
    """As ``received``, but one row for each attachment and message, however
    often the message is filed: with its smallest job reference (nulls last) and
    ``filed``, how many rows it stands for. Filings are reduced by message
    before they meet the wide rows."""
    a, m, b, f, j = attachments.alias("a"), messages.alias("m"), message_files.alias("b"), files.alias("f"), jobs.alias("j")
    filed = b.join(f, F.col("f.id") == F.col("b.file_id"), "left").join(j, F.col("j.id") == F.col("f.job_id"), "left")
    filed = filed.groupBy("b.message_id").agg(F.count("*").alias("filed"), F.min("j.reference").alias("reference")).alias("n")
    rows = a.join(m, F.col("m.id") == F.col("a.message_id")).join(filed, F.col("n.message_id") == F.col("m.id"), "left")
    return _shown(rows, own_domain, F.col("n.reference"), F.coalesce("n.filed", F.lit(1)).alias("filed"))


def _shown(rows: DataFrame, own_domain: str, reference: Column, *more: Column) -> DataFrame:
    return rows.select(
        "a.fingerprint", "a.id", "a.name", "a.kind", "a.draft_or_final",
        F.coalesce("a.document_date", F.to_date("m.received_at")).alias("happened_on"), "m.received_at", "m.subject",
        counterparty(F.col("m.sender"), F.col("m.recipients"), own_domain).alias("counterparty"),
        reference.alias("job_ref"), F.col("a.stored_path").isNotNull().alias("openable"), *more,
    )


def archive(attachments: DataFrame, messages: DataFrame, message_files: DataFrame, files: DataFrame, jobs: DataFrame, own_domain: str,
    filters: list[Column] | None = None, copies: str = "rows") -> DataFrame:
    """One row per fingerprint (null is one fingerprint): an openable copy if
    there is one, then the newest, then the smallest id and job reference.

    ``filters`` are applied before copies are counted. ``copies="rows"`` counts
    joined rows, so a message filed in three files counts three times;
    ``copies="attachments"`` counts attachments.
    """
    if filters:  # which may ask for any job of a message
        rows = received(attachments, messages, message_files, files, jobs, own_domain).where(reduce(lambda x, y: x & y, filters)).withColumn("filed", F.lit(1))
    else:
        rows = received_once(attachments, messages, message_files, files, jobs, own_domain)
    count = F.sum("filed") if copies == "rows" else F.count_distinct("id")
    rank = F.struct((~F.col("openable")).alias("a"), newest_first(F.col("received_at")).alias("b"), F.col("id").alias("c"),
        F.col("job_ref").isNull().alias("d"), F.col("job_ref").alias("e"))
    return distinct_on(rows, [F.col("fingerprint")], rank, copies=count).select(*COLUMNS)


def page(documents: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Newest day first (unknown days first of all), then name, then id."""
    return documents.orderBy(F.col("happened_on").desc_nulls_first(), F.col("name").asc_nulls_last(), "id").offset(offset).limit(limit)
