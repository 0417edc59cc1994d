"""Clusters of messages kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions.text import falsy, strip
from lettermill.operators.components import connected_components
from lettermill.operators.threads import MAX_PER_KEY, MAX_PER_SUBJECT, ids_in, single_values, telling
from lettermill.session import durable
from lettermill.sources.versioned import VersionedTable, upsert

#: A message stands under the references that count, its own id, the ids it names and its subject.
REFERENCE, OWN, NAMES, SUBJECT = 0, 1, 2, 3
POSTING = ["k", "id", "role", "seq"]


def postings(emails: DataFrame, keys: DataFrame) -> DataFrame:
    """``(id, posts)``: all that can link each message with others, as structs
    ``(k, role, seq)``. References are dealt by message once."""
    order = emails.schema["ingest_order"].dataType.simpleString()
    kind = f"struct<k:string,role:int,seq:{order}>"
    post = lambda role, *k, seq=None: F.struct(F.concat_ws("\0", *k).alias("k"), F.lit(role).alias("role"), F.lit(seq).alias("seq")).cast(kind)
    refs = single_values(keys.repartition("email_id")).groupBy("id").agg(F.collect_list(post(REFERENCE, F.lit("r"), "kind", "value")).alias("refs"))
    none, own, subject = F.array().cast(f"array<{kind}>"), strip(F.col("message_id")), F.coalesce("subject_key", F.lit(""))
    posts = [
        F.when(~falsy(own), F.array(post(OWN, F.lit("m"), own, seq=F.col("ingest_order")))),
        F.transform(F.array_distinct(F.concat(ids_in("in_reply_to"), ids_in("references"))), lambda mid: post(NAMES, F.lit("m"), mid)),
        F.when(telling(subject), F.array(post(SUBJECT, F.lit("s"), F.sha2(subject, 256)))),
    ]
    rows = emails.select("id", F.concat(*[F.coalesce(p, none) for p in posts]).alias("posts"))
    return rows.join(refs, "id", "left").select("id", F.concat("posts", F.coalesce("refs", none)).alias("posts"))


class GrowingClusters:
    """Two versioned tables below ``path``: ``postings`` by what is shared
    (batches are appended), and ``mails`` (``id, cluster_id``) by message.

    A batch only works on the keys that its messages share: their links join
    messages and the clusters so far, each of which counts as one node. Links
    are also withdrawn, by a key that the batch takes over its cap, a copy that
    no longer gets the replies, or a message that comes again with other keys.
    Only clusters in which that happens are taken apart and made anew of all
    their messages' links.
    """

    def __init__(self, spark: SparkSession, path: str, most: int = MAX_PER_KEY, most_subject: int = MAX_PER_SUBJECT) -> None:
        self.spark = spark
        self.postings, self.mails = VersionedTable(spark, f"{path}/postings"), VersionedTable(spark, f"{path}/mails")
        self.cap = F.when(F.col("role") == SUBJECT, most_subject).otherwise(most)

    def clusters(self) -> DataFrame:
        """``(email_id, cluster_id)`` as ``threads.cluster`` has it of all messages so far."""
        return self.mails.read().select(F.col("id").alias("email_id"), "cluster_id")

    def _links(self, rows: DataFrame) -> DataFrame:
        """``(a, b)`` of what links messages now by the keys of ``rows`` (postings,
        ``new`` if of the batch) that have new ones; and, with a null ``b``, a
        message of each cluster that loses a link."""
        shared = rows.where(F.col("role").isin(REFERENCE, SUBJECT))
        was = lambda c: F.when(~F.col("new"), c)
        sizes = shared.groupBy("k", "role").agg(F.count("*").alias("n"), F.count(was(F.lit(1))).alias("n_was"), F.min("id").alias("a"),
            F.min(was(F.col("id"))).alias("a_was")).where("n > n_was and n > 1")
        stars = shared.join(sizes.where(F.col("n") <= self.cap).select("k", "role", "a"), ["k", "role"]).where("a <> id").select("a", F.col("id").alias("b"))
        parted = sizes.where((F.col("n") > self.cap) & F.col("n_was").between(2, self.cap)).select(F.col("a_was").alias("a"))

        # of messages with one id the last is meant, as in threads.link_edges
        named, late = rows.where(F.col("role") == NAMES).select("k", "id", "new"), F.struct("seq", "id")
        own = rows.where(F.col("role") == OWN).join(named.select("k").distinct().hint("shuffle_hash"), "k", "left_semi")
        meant = own.groupBy("k").agg(F.max(late)["id"].alias("a"), F.max(was(late))["id"].alias("a_was"))
        answers = named.join(meant, "k").where("new or not a <=> a_was")
        left = F.when(~F.col("new") & (F.col("a_was") != F.col("id")), F.array(F.struct(F.col("a_was").alias("a"), F.lit(None).cast(own.schema["id"].dataType).alias("b"))))
        now = F.when(F.col("a") != F.col("id"), F.array(F.struct("a", F.col("id").alias("b"))))
        answered = answers.select(F.explode(F.array_compact(F.array(now, left))).alias("l")).select(F.inline("l"))
        return stars.unionByName(answered).unionByName(parted.withColumn("b", F.lit(None).cast(own.schema["id"].dataType)))

    def add(self, run: str, emails: DataFrame, keys: DataFrame) -> None:
        """Take in a batch of messages with all their keys. ``run`` names it: a
        batch that is added again, after a failure or whole, changes nothing.
        A message of an earlier batch is replaced."""
        if self.mails.exists() and run in self.mails.manifest().runs:
            return
        batch = durable(postings(emails, keys), "batch")
        ids, posts = batch.select("id"), batch.select("id", F.inline("posts")).select(*POSTING)
        labels = ids.withColumn("cluster_id", F.col("id"))
        if not self.postings.exists():
            self.postings.create(posts.limit(0), ["k", "id", "role"], by=["k"])
        if not self.mails.exists():
            self.mails.create(labels.limit(0), ["id"])

        mails = self.mails.read()
        had = durable(mails.join(ids.hint("shuffle_hash"), "id", "left_semi"), "had")
        resent = run in self.postings.manifest().runs or not had.isEmpty()
        before = lambda rows: (rows.join(ids, "id", "left_anti") if resent else rows).select(*POSTING, F.lit(False).alias("new"))
        new = posts.withColumn("new", F.lit(True))
        found = durable(self._links(before(self.postings.near(posts)).unionByName(new)), "found")
        links, lost = found.where("b is not null"), found.where("b is null").select(F.col("a").alias("id"))

        apart = None
        if not had.isEmpty() or not lost.isEmpty():
            torn = mails.join(lost.distinct(), "id", "left_semi").unionByName(had).select("cluster_id").distinct()
            torn = durable(torn, "torn")
            apart = durable(mails.join(torn, "cluster_id", "left_semi").select("id").join(ids, "id", "left_anti"), "apart")
            every = self.postings.read()
            open_ = every.join(apart.unionByName(ids), "id", "left_semi").select("k").distinct()
            # with all rows as new ones every link counts
            there = before(every).unionByName(new).withColumn("new", F.lit(True))
            links = links.unionByName(durable(self._links(there.join(open_, "k", "left_semi")), "links"))
            mails = mails.join(torn, "cluster_id", "left_anti").select("id", "cluster_id")

        ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
        held = mails.join(ends.hint("shuffle_hash"), "id", "left_semi").select(F.col("cluster_id").alias("a"), F.col("id").alias("b"))
        parts = connected_components(links.unionByName(held))
        moved = mails.join(parts.withColumnRenamed("node", "cluster_id").where("cluster_id <> component").hint("shuffle_hash"), "cluster_id")
        fresh = (ids if apart is None else ids.unionByName(apart)).join(parts.withColumnRenamed("node", "id"), "id", "left")
        labels = moved.select("id", F.col("component").alias("cluster_id")).unionByName(fresh.select("id", F.coalesce("component", "id").alias("cluster_id")))
        labels = durable(labels, "labels")

        if resent:
            stale = self.postings.read().join(ids, "id", "left_semi").select(*POSTING).join(posts, ["k", "id", "role"], "left_anti")
            changes = posts.withColumn("stale", F.lit(False)).unionByName(stale.select(*POSTING, F.lit(True).alias("stale")))
            merged = upsert(["k", "id", "role"])
            self.postings.update(run, changes, lambda rows, c: merged(rows, c).join(c.where("stale").select("k", "id", "role"), ["k", "id", "role"], "left_anti"))
        else:
            self.postings.append(run, posts)
        self.mails.update(run, labels, upsert(["id"]))
