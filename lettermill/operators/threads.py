"""Messages that belong together: guarded edges and their components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions.text import falsy, strip
from lettermill.operators.components import connected_components

# Fixed values
STRONG = ["job", "rfq", "ref", "customs", "booking", "container", "at", "so"]
MAX_PER_KEY = 120
MAX_PER_SUBJECT = 60
MIN_SUBJECT_LEN = 12
GENERIC_SUBJECTS = [
    "documenti", "documents", "fattura", "invoice", "ddt", "info", "aggiornamento", "update",
    "conferma", "confirmation", "buongiorno", "richiesta", "preventivo", "quotation", "urgente", "",
]


def star_edges(members: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``(a, b)`` from the smallest member of each group to every other;
    groups of more than ``most`` members give none."""
    centre = members.groupBy(*keys).agg(F.min("id").alias("centre"), F.count("*").alias("n")).where(F.col("n").between(2, most)).drop("n")
    return members.join(centre, keys).where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b"))


def single_values(keys: DataFrame, strong: list[str] = STRONG) -> DataFrame:
    """``(id, kind, value)`` of the strong references of which ``id`` has one value only."""
    known = keys.select(F.col("email_id").alias("id"), "kind", F.coalesce("value", F.lit("")).alias("value")).where(F.col("kind").isin(strong))
    single = known.groupBy("id", "kind").agg(F.min("value").alias("value"), F.max("value").alias("other")).where("value = other")
    return single.select("id", "kind", "value")


def single_references(emails: DataFrame, keys: DataFrame, strong: list[str] = STRONG) -> DataFrame:
    """``(id, kind, value)`` of the strong references that count: a message that
    names several of one kind is a round-up, and none of these does."""
    return single_values(keys, strong).join(emails.select("id"), "id", "left_semi")


def reference_edges(emails: DataFrame, keys: DataFrame, strong: list[str] = STRONG, most: int = MAX_PER_KEY) -> DataFrame:
    """Messages that share a strong reference."""
    return star_edges(single_references(emails, keys, strong), ["kind", "value"], most)


def own_ids(emails: DataFrame) -> DataFrame:
    """``(id, mid, ingest_order)`` of the messages that have a message id."""
    ident = strip(F.col("message_id"))
    return emails.where(~falsy(ident)).select("id", ident.alias("mid"), "ingest_order")


def ids_in(header: str) -> Column:
    """The message ids that a header names, an array."""
    h = F.col(header)
    bracketed = F.regexp_extract_all(h, F.lit("<[^>]+>"), F.lit(0))
    named = F.when(F.size(bracketed) > 0, bracketed).otherwise(F.array(strip(h)))
    return F.when(falsy(h), F.array().cast("array<string>")).otherwise(F.transform(named, strip))


def named_ids(emails: DataFrame) -> DataFrame:
    """``(id, mid)``: the message ids that a message's headers name."""
    return emails.select("id", F.explode(F.concat(ids_in("in_reply_to"), ids_in("references"))).alias("mid")).distinct()


def link_edges(named: DataFrame, own: DataFrame) -> DataFrame:
    """Messages and those they name. Of messages with one message id the last
    received is meant (those without ``ingest_order`` came first; among equals
    the largest id)."""
    target = own.groupBy("mid").agg(F.max(F.struct("ingest_order", "id"))["id"].alias("parent"))
    return named.join(target, "mid").where("parent <> id").select(F.col("parent").alias("a"), F.col("id").alias("b"))


def reply_edges(emails: DataFrame) -> DataFrame:
    """Messages and those their headers answer."""
    return link_edges(named_ids(emails), own_ids(emails))


def telling(subject: Column, least: int = MIN_SUBJECT_LEN) -> Column:
    """Whether a subject (not null) tells messages apart."""
    return (F.length(subject) >= least) & ~subject.isin(GENERIC_SUBJECTS)


def told_subjects(emails: DataFrame, least: int = MIN_SUBJECT_LEN) -> DataFrame:
    """``(id, s)`` of the messages with a telling subject."""
    return emails.select("id", F.coalesce("subject_key", F.lit("")).alias("s")).where(telling(F.col("s"), least))


def subject_edges(emails: DataFrame, most: int = MAX_PER_SUBJECT, least: int = MIN_SUBJECT_LEN) -> DataFrame:
    """Messages with one telling subject."""
    return star_edges(told_subjects(emails, least), ["s"], most)


def cluster(emails: DataFrame, keys: DataFrame, strong_only: bool = False) -> DataFrame:
    """``(email_id, cluster_id)`` for every message, alone or not.

    ``emails``: id, message_id, in_reply_to, references, subject_key,
    ingest_order; ``keys``: email_id, kind, value. The cluster's id is its
    smallest message id. All rules' edges are joined at once: none depends on
    the clusters found by another. Blank message ids are ignored and a null
    subject is empty.
    """
    rules = [reference_edges(emails, keys), reply_edges(emails)] + ([] if strong_only else [subject_edges(emails)])
    parts = connected_components(reduce(DataFrame.unionByName, rules))
    return emails.select(F.col("id").alias("email_id")).join(parts.withColumnRenamed("node", "email_id"), "email_id", "left").select("email_id",
        F.coalesce("component", "email_id").alias("cluster_id"))


def members(clusters: DataFrame, most: int = 1000) -> DataFrame:
    """``(cluster_id, part, n_members, members)``: each cluster's messages as
    sorted lists. One of more than ``most`` is dealt by the message's MD5 into
    parts of about ``most``, so that no list grows with the corpus."""
    size = clusters.groupBy("cluster_id").agg(F.count("*").alias("n_members"))
    parts = F.ceil(F.col("n_members") / most)
    place = F.conv(F.substring(F.md5(F.col("email_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    rows = clusters.join(size, "cluster_id").withColumn("part", F.pmod(place, parts).cast("int"))
    return rows.groupBy("cluster_id", "part", "n_members").agg(F.array_sort(F.collect_list("email_id")).alias("members"))
