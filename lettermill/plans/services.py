"""Queries of sources, sinks and paid services, with the SQL that checks them.

Services are stood in for by functions of their requests, so that SQL can say
what they answer.
"""

from __future__ import annotations

import datetime
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.operators import extraction, retrieval, threads
from lettermill.operators.growing import GrowingClusters
from lettermill.operators.privacy import held_back_counts
from lettermill.plans import catalogue
from lettermill.plans.catalogue import NOW
from lettermill.session import new_path
from lettermill.sources import imap, mailbox
from lettermill.sources.mail import payloads
from lettermill.sources.stores import read_bytes, write_files
from lettermill.sources.tables import append, cut_bodies, table
from lettermill.sources.versioned import VersionedTable
from lettermill.streaming import keyed
from lettermill.streaming.mail import arriving

BIG, SMALL = "big-model", "small-model"
CAP = 0.002
LATER = datetime.datetime(2026, 2, 1)
#: Messages in a file of the server that stands in.
SERVED = 50
USEFUL = r"(?i)list|sheet|form"


# Sources and sinks.


def mail_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies cut to 4,000 characters, of mail since February."""
    day = F.expr("cast(date_add(DATE'2026-01-01', cast(doc_id % 90 as int)) as timestamp)")
    messages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), day.alias("sent_at"), F.col("text").alias("body"))
    cut = cut_bodies(messages, since=F.lit("2026-02-01").cast("timestamp"))
    return cut.select("id", F.length("body").cast("long").alias("n_chars"), F.md5("body").alias("digest"))


def mail_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments of useful names, read only if they may be stored; a file
    holds its own path."""
    metadata = catalogue.mail_rows(spark, sf_dir).withColumn("path", F.concat(F.lit("store/"), "filename"))
    stored, _ = payloads(metadata, lambda path: path.encode(), useful=USEFUL)
    return stored.select("id", "filename", F.md5("payload").alias("digest"))


NAMES = ["notes.txt", "payslip.txt", "packing list.txt", "P60 form.txt", "rate sheet.pdf"]
SUBJECTS = ["delivery", "sick leave", "ETA", "salary"]
WALKED = r"(?i)\.(txt|pdf)$"


def _pick(names: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))


def landed_mail(spark: SparkSession, sf_dir: str) -> str:
    """A folder with documents as attachments in mailboxes, a message each, and
    every turn of a conversation as a file of its own with the turn attached
    behind two versions of the body."""
    folder = new_path(spark, "mail")
    n = F.col("doc_id")
    head = lambda ident, subject, sender: F.concat(F.lit("Message-ID: <"), ident, F.lit(">\nFrom: "), sender, F.lit("\nSubject: "), subject,
        F.lit("\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=outer\n\n--outer\n"))
    attached = lambda name, how: F.concat(F.lit("Content-Type: application/octet-stream\nContent-Disposition: attachment; filename=\""), name,
        F.lit(f"\"\nContent-Transfer-Encoding: {how}\n\n"))
    docs = table(spark, sf_dir, "documents").select(F.concat(
        F.lit("From mill Thu Jan  1 00:00:00 2026\n"), head(F.concat(F.lit("d"), n.cast("string")), _pick(SUBJECTS, F.expr("doc_id div 3")),
            F.when(n % 2 == 0, "ops@example.com").otherwise("x@y.org")), F.lit("\nsee below\n--outer\n"), attached(_pick(NAMES, n), "base64"),
        F.base64(F.coalesce("text", F.lit("")).cast("binary")), F.lit("\n--outer--\n")).alias("value"))
    docs.write.text(f"{folder}/boxes")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).distinct()
    ident = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"), F.lit("."), F.md5("text"))
    inner = "Content-Type: multipart/alternative; boundary=inner\n\n--inner\n\nplain\n--inner\nContent-Type: text/html\n\n<p>\n--inner--\n--outer\n"
    mail = F.concat(head(ident, _pick(SUBJECTS, F.col("turn")), F.lit("ops@example.com")), F.lit(inner), attached(_pick(NAMES, F.col("conv_id")), "8bit"),
        F.col("text"), F.lit("\n--outer--\n"))
    write_files(turns.select(F.concat(ident, F.lit(".eml")).alias("name"), mail.cast("binary").alias("content")), f"{folder}/files")
    return folder


def mail_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments of landed mail that may be stored: their place and content."""
    stored, _ = mailbox.attachments(spark, landed_mail(spark, sf_dir), WALKED)
    return stored.select("message_id", "part", "filename", F.octet_length("payload").cast("long").alias("n_bytes"), F.md5("payload").alias("digest"))


def mail_held_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was held back of the same mail, by sender; nothing of it is decoded."""
    _, held_back = mailbox.attachments(spark, landed_mail(spark, sf_dir), WALKED)
    return held_back_counts(held_back, "sender")


class FolderServer:
    """A mail server stood in for by a folder of files, ``<k>.json`` with the
    messages from ``k * SERVED + 1`` on, which knows what number comes next."""

    def __init__(self, folder: str, next_uid: int) -> None:
        self.folder, self.next = folder, next_uid

    def select(self, mailbox: str, readonly: bool) -> tuple:
        return ("OK", [b""]) if readonly else ("NO", [b"read only"])

    def response(self, code: str) -> tuple:
        return code, [b"1" if code == "UIDVALIDITY" else str(self.next).encode()]

    def uid(self, command: str, *args: str) -> tuple:
        lo, hi = map(int, args[0].split(":"))
        out = []
        for k in range((lo - 1) // SERVED, (hi - 1) // SERVED + 1):
            try:
                kept = json.loads(read_bytes(f"{self.folder}/{k}.json"))
            except FileNotFoundError:
                continue
            for raw, uid in ((m["mail"].encode(), m["uid"]) for m in kept if lo <= m["uid"] <= hi):
                out += [(f"{uid} (UID {uid} BODY[] {{{len(raw)}}}".encode(), raw), b")"]
        return "OK", out

    def logout(self) -> tuple:
        return "BYE", []


def mail_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages of a live mailbox, landed by several tasks and read again."""
    kept, landed = new_path(spark, "server"), new_path(spark, "landed")
    n = F.col("doc_id").cast("string")
    mail = F.concat(F.lit("Message-ID: <"), n, F.lit(">\nSubject: s\nContent-Transfer-Encoding: base64\n\n"), F.base64(F.coalesce("text",
        F.lit("")).cast("binary")))
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("uid"), mail.alias("mail"))
    served = docs.groupBy(F.expr(f"(uid - 1) div {SERVED}").alias("k")).agg(F.to_json(F.sort_array(F.collect_list(F.struct("uid", "mail")))).alias("mail"))
    write_files(served.select(F.concat(F.col("k").cast("string"), F.lit(".json")).alias("name"), F.col("mail").cast("binary").alias("content")), kept)
    last = docs.agg(F.max("uid").alias("uid")).first()["uid"] or 0
    imap.land(spark, lambda: FolderServer(kept, last + 1), ["INBOX"], landed)
    found = mailbox.with_payload(mailbox.parts(spark, landed))
    return found.select("message_id", F.octet_length("payload").cast("long").alias("n_bytes"), F.md5("payload").alias("digest"))


def log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log after two runs, of which the second repeats every tenth job."""
    path, rows = new_path(spark, "log"), catalogue.observations(spark, sf_dir)
    append(rows, path)
    append(rows.where("entity_id % 10 = 0"), path)
    return spark.read.schema(rows.schema).parquet(path)


# Embedding services.


def _lengths(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(len(t) % 7)] for t in texts]


def vec_hosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents embedded by a service that answers in reverse order, under a cap."""

    def post(request: dict) -> dict:
        found = [{"index": k, "embedding": v} for k, v in enumerate(_lengths(request["input"]))]
        return {"data": found[::-1], "usage": {"total_tokens": sum(map(len, request["input"])) // 4}}

    texts = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = retrieval.embed(texts, retrieval.hosted(post, BIG), "passage", BIG, cap=retrieval.Cap(1000.0, 0.02), order="doc_id")
    return rows.select("doc_id", "model", F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y"))


def vec_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items embedded by a service of our own, which puts the kind before the text."""
    service = retrieval.local(lambda request: {"vectors": _lengths([f"{request['kind']}: {t}" for t in request["texts"]])})
    rows = retrieval.embed(table(spark, sf_dir, "benchmark"), service, "query", SMALL)
    return rows.select("item_id", "model", F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y"))


def vec_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a cap lets a run over all documents come."""
    calls = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.length("text") / 4).alias("tokens"))
    return retrieval.charged(calls, retrieval.Cap(CAP, 0.02), "doc_id").select("doc_id", "tokens", F.round("spent_usd", 9).alias("spent_usd"))


def vec_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors kept as JSON text, some of them cut, null or empty."""
    n = F.col("vec_id")
    told = F.when(n % 11 == 0, F.lit(None)).when(n % 11 == 1, "[").when(n % 11 == 2, "[]").when(n % 11 == 3, "no vector").otherwise(F.to_json("embedding"))
    index = table(spark, sf_dir, "embeddings").select("vec_id", told.alias("embedding"))
    return retrieval.readable(index).select("vec_id", F.size("embedding").cast("long").alias("n_dims"))


def vec_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index for each label, of one model or of two, and the queries that may be asked of it."""
    n = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("index"), F.when(F.col("label") % 3 == 0,
        F.when(n % 2 == 0, BIG).otherwise(SMALL)).when(F.col("label") % 3 == 1, BIG).otherwise(SMALL).alias("model"))
    queries = rows.where("vec_id % 20 = 0").select(n.alias("query_id"), "index", F.when(n % 3 == 0, SMALL).otherwise(BIG).alias("asked_by"))
    built = retrieval.models_of(rows, "index")
    return queries.join(built, "index").select("query_id", "index", "built_by", F.coalesce(F.col("asked_by") == F.col("built_by"), F.lit(False)).alias("allowed"))


def provider_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provider by each supplier's probe: its key, status and code."""
    n = F.col("s_suppkey")
    status = F.when(n % 5 == 0, 200).when(n % 5 < 3, 429).when(n % 5 == 3, 500)
    code = F.when(n % 5 == 1, retrieval.NO_CREDIT[0]).when(n % 5 == 2, "slow_down")
    said = retrieval.provider_of(n % 7 > 0, status, code, BIG, SMALL)
    return table(spark, sf_dir, "supplier").select(n, said.alias("p")).select("s_suppkey", "p.provider", "p.model", "p.warning")


# Facts from a model.


def _answer(thread: str) -> tuple[str, int, int]:
    n = len(thread)
    if n % 5 == 0:
        raise OSError("down")
    said = "no answer" if n % 7 == 0 else f'So: {{"origin": "port {n % 9}", "confidence": {n % 100}}} it is'
    return said, n // 4 + 400, 220


def _run(spark: SparkSession, sf_dir: str, **options) -> extraction.Run:
    """Jobs are the conversations whose number 3 does not divide."""
    texts = catalogue.thread_text(spark, sf_dir)
    jobs = table(spark, sf_dir, "conversations").where("conv_id % 3 <> 0").select(F.col("conv_id").alias("job_id")).distinct()
    return extraction.ask(jobs, texts, options.pop("model", _answer), **options)


def ask_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = _run(spark, sf_dir, cap=1000.0, apply=True).replies
    return replies.select("job_id", "reply", "error", F.round("cost", 9).alias("cost"))


def ask_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = _run(spark, sf_dir, cap=1000.0, apply=True).replies
    return extraction.run_summary(replies).withColumn("spent_usd", F.round("spent_usd", 6))


def _dear(thread: str) -> tuple[str, int, int]:
    """A service that charges more than was estimated."""
    return "none", len(thread) // 2 + 400, 380


def ask_leased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a cap of a tenth over the estimate lets a dear service come."""
    texts = catalogue.thread_text(spark, sf_dir)
    plan = extraction.estimate(texts).first()["estimate_usd"]
    replies = extraction.ask(texts, texts, _dear, cap=round(plan * 1.1, 6), apply=True).replies
    return replies.select("job_id", F.round("cost", 9).alias("cost"))


def ask_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that make no call, told apart."""
    runs = [_run(spark, sf_dir, model=None), _run(spark, sf_dir, cap=0.0, apply=True), _run(spark, sf_dir, cap=1000.0)]
    return spark.createDataFrame([(r.outcome, r.n_threads, r.replies is None) for r in runs], "outcome string, n_threads long, no_call boolean")


def answers_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after two answers each, of which the surer one counts."""
    a = catalogue.answers(spark, sf_dir)
    other = a.withColumns({"origin": F.lit("elsewhere"), "confidence": (100 - F.coalesce("confidence", F.lit(0))).cast("int")})
    jobs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        *[F.lit(None).cast("string").alias(c) for c in ("origin", "destination", "carrier", "route_source")],
        F.lit(None).cast("timestamp").alias("ai_seen_at"),
        F.lit(False).alias("verified"),
    )
    done = extraction.guarded_update(jobs, a.unionByName(other), catalogue.NOW)
    return done.select("id", "origin", "route_source", F.col("ai_seen_at").isNotNull().alias("seen"))


def update_thrice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of jobs after three runs, of which the third repeats the first."""
    jobs = catalogue.job_rows(spark, sf_dir)
    held = VersionedTable(spark, new_path(spark, "jobs")).create(jobs, ["id"])
    a = catalogue.answers(spark, sf_dir)
    other = a.where("id % 3 <> 1").withColumns({"origin": F.lit("elsewhere"), "confidence": (100 - F.coalesce("confidence", F.lit(0))).cast("int")})
    for run, said, now in (("first", a, NOW), ("second", other, LATER), ("first", a, LATER)):
        extraction.update_jobs(held, said, now, run)
    return held.read()


# Streams.


def key_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of messages that arrive in three parts, their copies in any."""
    messages = catalogue.key_messages(spark, sf_dir).where(F.col("sent_at") >= F.lit(catalogue.SINCE).cast("timestamp_ntz"))
    source, target = new_path(spark, "arriving"), new_path(spark, "keys")
    for k in range(3):
        messages.where(F.pmod(F.hash("id"), F.lit(3)) == k).write.mode("append").parquet(source)
        keyed.keep_keys(arriving(spark, source, messages.schema), target, f"{target}-check").awaitTermination()
    return keyed.kept_keys(spark, target)


def state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments that are told of once, and what time alone has made of them by today."""
    source, out = new_path(spark, "shipments"), new_path(spark, "verdicts")
    began = F.lit("2001-07-01").cast("timestamp")
    rows = catalogue.shipments(spark, sf_dir).withColumn("as_of", F.coalesce("last_message", began))
    rows.write.parquet(source)
    noon = F.lit(catalogue.TODAY).cast("timestamp") + F.expr("interval 12 hours")
    clock = spark.range(1).select(*[F.lit(-1).cast(f.dataType).alias("id") if f.name == "id" else noon.alias("as_of") if f.name == "as_of" else F.lit(
        None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    clock.write.mode("append").parquet(source)

    keyed.keep_verdicts(arriving(spark, source, rows.schema), new_path(spark, "plans"), out, f"{out}-check").awaitTermination()
    told = spark.read.parquet(out).where("id >= 0")
    return told.groupBy("id").agg(F.max_by("state", F.struct("batch", "day")).alias("state"))


# Clusters batch by batch, and as lists.


def cluster_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters of ``cluster_all`` after three batches of messages."""
    emails, refs = catalogue.cluster_frames(spark, sf_dir)
    made = GrowingClusters(spark, new_path(spark, "clusters"))
    for k in range(3):
        mine = lambda c, k=k: F.pmod(F.hash(c), F.lit(3)) == k
        made.add(f"batch {k}", emails.where(mine("id")), refs.where(mine("email_id")))
    return made.clusters()


def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = threads.members(catalogue.cluster_all(spark, sf_dir))
    return found.select("cluster_id", "part", "n_members", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


LENGTHS = "length({t})::double as x, (length({t}) % 7)::double as y"
REPLIES = f"""with {catalogue.THREAD_CTE},
n as (select job_id, length(thread) as n from threads where job_id % 3 <> 0),
r as (select job_id, n,
    case when n % 5 = 0 then null when n % 7 = 0 then 'no answer' else 'So: {{"origin": "port ' || (n % 9) || '", "confidence": ' || (n % 100)
      || '}} it is' end as reply,
    case when n % 5 = 0 then 'down' end as error,
    case when n % 5 = 0 then 0 else (n // 4 + 400) * 1e-6 + 220 * 5e-6 end as cost
  from n)"""

MAIL = f"""with rows_ as (
  select '<d' || doc_id || '>' as message_id, {NAMES}[(doc_id % 5 + 1)::int] as filename, {SUBJECTS}[((doc_id // 3) % 4 + 1)::int] as subject,
    case when doc_id % 2 = 0 then 'ops@example.com' else 'x@y.org' end as sender, coalesce(text, '') as text from documents
  union all
  select distinct '<c' || conv_id || '.' || turn || '.' || md5(coalesce(text, '')) || '>', {NAMES}[(conv_id % 5 + 1)::int], {SUBJECTS}[(turn % 4 + 1)::int],
    'ops@example.com', coalesce(text, '') from conversations),
judged as (select *, {catalogue.CONFIDENTIAL} as confidential from rows_)"""

QUERIES = {
    f.__name__: f
    for f in (
        mail_cut, mail_payloads, mail_walk, mail_held_back, mail_fetch, log_append, vec_hosted, vec_local, vec_budget, vec_readable, vec_model, provider_choice,
        ask_replies, ask_summary, ask_leased, ask_outcomes, answers_twice, update_thrice, key_stream, state_stream, cluster_batches, cluster_members,
    )
}

ORACLE_SQL = {
    "mail_cut": """select doc_id as id, length(left(text, 4000)) as n_chars, md5(left(text, 4000)) as digest
      from documents where date '2026-01-01' + (doc_id % 90)::int >= date '2026-02-01'""",
    "mail_walk": f"""{MAIL} select message_id, '2' as part, filename, strlen(text) as n_bytes, md5(text) as digest from judged where not confidential""",
    "mail_held_back": f"{MAIL} select sender, count(*) as held_back from judged where confidential group by sender",
    "mail_fetch": "select '<' || doc_id || '>' as message_id, strlen(coalesce(text, '')) as n_bytes, md5(coalesce(text, '')) as digest from documents",
    "mail_payloads": f"""with {catalogue.PRIVACY_CTE}
      select id, filename, md5('store/' || filename) as digest
      from judged where not confidential and coalesce(filename, '') <> '' and regexp_matches(filename, '{USEFUL}')""",
    "log_append": f"""with log as ({catalogue.ORACLE_SQL["observations"]})
      select * from log union all select * from log where entity_id % 10 = 0""",
    "vec_hosted": f"select doc_id, '{BIG}' as model, {LENGTHS.format(t="coalesce(text, '')")} from documents",
    "vec_local": f"""select item_id, '{SMALL}' as model, {LENGTHS.format(t="('query: ' || text)")} from benchmark""",
    "vec_budget": f"""with c as (select doc_id, length(text) // 4 as tokens from documents),
      r as (select *, sum(tokens) over (order by doc_id) as used from c)
      select doc_id, tokens, round(used * (0.02 / 1000000.0), 9) as spent_usd from r where (used - tokens) * (0.02 / 1000000.0) <= {CAP}""",
    "vec_readable": "select vec_id, len(embedding) as n_dims from embeddings where vec_id % 11 > 3 and len(embedding) > 0",
    "vec_model": f"""with r as (select vec_id, label::varchar as index, case when label % 3 = 0 then case when vec_id % 2 = 0 then '{BIG}' else '{SMALL}' end
      when label % 3 = 1 then '{BIG}' else '{SMALL}' end as model from embeddings),
      b as (select index, case when count(distinct model) = 1 then min(model) end as built_by from r group by index)
      select vec_id as query_id, index, built_by, coalesce(built_by = case when vec_id % 3 = 0 then '{SMALL}' else '{BIG}' end, false) as allowed
      from r join b using (index) where vec_id % 20 = 0""",
    "provider_choice": f"""with p as (select s_suppkey, s_suppkey % 7 > 0 as keyed, s_suppkey % 5 as k from supplier)
      select s_suppkey, case when keyed and k = 0 then 'hosted' else 'local' end as provider, case when keyed and k = 0 then '{BIG}' else '{SMALL}' end as model,
        case when not keyed or k = 0 then '' else 'Indexing with the local model, since the hosted service ' || case k
          when 1 then 'is out of credit; pay and index anew to use it again' when 2 then 'replied with status 429 slow_down'
          when 3 then 'replied with status 500' else 'is unreachable' end || '.' end as warning from p""",
    "ask_replies": f"{REPLIES} select job_id, reply, error, round(cost, 9) as cost from r",
    "ask_summary": f"""{REPLIES} select count(*) filter (where reply like 'So%') as n_read, count(*) filter (where reply is null or reply not like 'So%') as n_errors,
      round(sum(cost), 6) as spent_usd, 0.0::double as lost_usd from r""",
    "ask_leased": f"""with {catalogue.THREAD_CTE},
      c as (select job_id, (length(thread) // 2 + 400) * 1000 + 380 * 5000 as cost, (strlen(thread) + 400) * 1000 + 400 * 5000 as most from threads),
      e as (select round(1.1 * (sum(length(thread) / 3.5 + 400) * 1e-6 + count(*) * 220 * 5e-6), 6) * 1e9 as cap from threads),
      r as (select *, coalesce(sum(cost) over (order by job_id rows between unbounded preceding and 1 preceding), 0) as spent from c)
      select job_id, round(cost / 1e9, 9) as cost from r where job_id < coalesce((select min(job_id) from r, e where spent + most > cap + 0.5),
        9223372036854775807)""",
    "ask_outcomes": f"""with {catalogue.THREAD_CTE}, n as (select count(*) as n from threads where job_id % 3 <> 0)
      select 'no key' as outcome, 0::bigint as n_threads, true as no_call union all select 'refused', n, true from n union all select 'dry run', n,
        true from n""",
    "answers_twice": f"""with {catalogue.ANSWER_CTE}, s as (select id, origin, coalesce(confidence, 0) as sure from a),
      b as (select c_custkey as id, case when sure is null then null when sure > 50 then origin when sure < 50 then 'elsewhere' else least(origin,
        'elsewhere') end as origin,
        greatest(sure, 100 - sure) >= 70 as ok, sure is not null as seen from customer left join s on s.id = c_custkey)
      select id, case when ok then origin end as origin, case when ok then 'ai' end as route_source, seen from b""",
    "update_thrice": f"""with {catalogue.ANSWER_CTE}, {catalogue.JOB_CTE},
      b as (select id, 'elsewhere' as origin, destination, carrier, 100 - coalesce(confidence, 0) as confidence from a where id % 3 <> 1),
      one as ({catalogue.UPDATE.format(jobs='j', answers='a', now="'2026-01-01'")}),
      two as ({catalogue.UPDATE.format(jobs='one', answers='b', now="'2026-02-01'")})
      select * from two""",
    "key_stream": catalogue.ORACLE_SQL["key_extract"],
    "cluster_batches": catalogue.ORACLE_SQL["cluster_all"],
    "state_stream": f"with {catalogue.STATE_CTE} select id, state from verdicts",
    "cluster_members": f"""with c as ({catalogue.ORACLE_SQL["cluster_all"]}), n as (select cluster_id, count(*) as n from c group by 1),
      p as (select c.*, n.n, ('0x' || substr(md5(email_id::varchar), 1, 8))::bigint % ((n.n + 999) // 1000) as part from c join n using (cluster_id))
      select cluster_id, part::int as part, n as n_members, string_agg(email_id::varchar, ',' order by email_id) as members from p group by all""",
}
