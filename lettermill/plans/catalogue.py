"""Queries over the supplied tables, with the SQL that checks them.

There are no mail or freight tables among these, so each operator runs on a
stand-in that is derived from them; the SQL derives the same.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.operators import archive, extraction, keys, long_transcripts, pages, privacy, retrieval, state, threads, transcripts
from lettermill.sources.tables import table

OWN_DOMAIN = "mail5.example.com"
TODAY = datetime.date(2001, 8, 1)
NOW = datetime.datetime(2026, 1, 1)


# The archive: documents as attachments, two to a message.


def archive_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality").dropDuplicates(["doc_id"])
    rows = docs.join(labels, "doc_id", "left")
    attachments = rows.select(
        F.col("doc_id").alias("id"), F.expr("doc_id div 2").alias("message_id"), F.md5("text").alias("fingerprint"), F.col("source").alias("name"),
        F.when(F.col("doc_id") % 9 > 1, F.col("lang")).alias("kind"), F.lit("final").alias("draft_or_final"),
        F.when(F.col("doc_id") % 3 == 0, F.expr("date_add(DATE'2026-03-01', cast(doc_id % 40 as int))")).alias("document_date"),
        F.when(F.col("quality").isNotNull(), F.concat(F.lit("/data/"), F.col("doc_id").cast("string"))).alias("stored_path"),
    )
    mail = docs.where("doc_id % 2 = 0")
    messages = mail.select(
        F.expr("doc_id div 2").alias("id"), F.expr("cast(date_add(DATE'2026-01-01', cast(doc_id % 90 as int)) as timestamp)").alias("received_at"),
        F.col("source").alias("subject"),
        F.when(F.col("doc_id") % 4 == 0, F.lit(f"Ops@{OWN_DOMAIN.upper()}")).otherwise(F.concat(F.lit("agent@"), "source", F.lit(".co.uk"))).alias("sender"),
        F.when(F.col("doc_id") % 8 == 0, F.lit("no address")).otherwise(F.concat(F.lit("<a@"), "lang", F.lit(".org>, b@x.net"))).alias("recipients"),
    )
    numbers = spark.range(60)
    return {
        "attachments": attachments,
        "messages": messages,
        "message_files": messages.where("id % 5 <> 0").select(F.col("id").alias("message_id"), (F.col("id") % 60).alias("file_id")),
        "files": numbers.select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 20).alias("job_id")),
        "jobs": numbers.where("id < 20").select("id", F.concat(F.lit("842."), F.col("id").cast("string")).alias("reference")),
    }


ARCHIVE_CTE = f"""
labels1 as (select distinct doc_id, 1 as q from labels),
attachments as (select d.doc_id as id, d.doc_id // 2 as message_id, md5(text) as fingerprint, source as name,
    case when d.doc_id % 9 > 1 then lang end as kind, 'final' as draft_or_final,
    case when d.doc_id % 3 = 0 then date '2026-03-01' + (d.doc_id % 40)::int end as document_date,
    case when q is not null then '/data/' || d.doc_id end as stored_path from documents d left join labels1 l on l.doc_id = d.doc_id),
messages as (select doc_id // 2 as id, (date '2026-01-01' + (doc_id % 90)::int)::timestamp as received_at, source as subject,
    case when doc_id % 4 = 0 then 'Ops@{OWN_DOMAIN.upper()}' else 'agent@' || source || '.co.uk' end as sender,
    case when doc_id % 8 = 0 then 'no address' else '<a@' || lang || '.org>, b@x.net' end as recipients from documents where doc_id % 2 = 0),
message_files as (select id as message_id, id % 60 as file_id from messages where id % 5 <> 0),
files as (select i as id, case when i % 7 > 0 then i % 20 end as job_id from range(60) t(i)),
jobs as (select i as id, '842.' || i as reference from range(20) t(i)),
joined as (select a.fingerprint, a.id, a.name, a.kind, a.draft_or_final, coalesce(a.document_date, m.received_at::date) as happened_on, m.received_at,
  m.subject,
    case when m.sender ilike '%@{OWN_DOMAIN}' then coalesce(nullif(regexp_extract(m.recipients, '@([A-Za-z0-9._-]+)', 1), ''), '{OWN_DOMAIN}')
         else split_part(m.sender, '@', 2) end as counterparty,
    j.reference as job_ref, a.stored_path is not null as openable
  from attachments a join messages m on m.id = a.message_id left join message_files mf on mf.message_id = m.id
  left join files f on f.id = mf.file_id left join jobs j on j.id = f.job_id)"""
ARCHIVE_PICK = """select * exclude (fingerprint, r) from (select *, count(*) over (partition by fingerprint) as copies,
  row_number() over (partition by fingerprint order by openable desc, received_at desc nulls first, id, job_ref nulls last) as r from joined {where})
    where r = 1"""


def archive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archive(**archive_tables(spark, sf_dir), own_domain=OWN_DOMAIN)


def archive_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archive(**archive_tables(spark, sf_dir), own_domain=OWN_DOMAIN, filters=[F.col("kind") == "en",
        F.col("happened_on") >= F.lit("2026-02-01").cast("date")])


PAGE_SQL = """
select id, name, happened_on, counterparty, job_ref, copies from archive
order by happened_on desc nulls first, name, id limit :limit offset :offset"""


def archive_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 25, as SQL text with bound parameters. The table is
    bound too: no view of ours stays in the session or replaces a user's."""
    rows = archive_dedup(spark, sf_dir)
    return spark.sql("with archive as (select * from {rows})" + PAGE_SQL, args={"limit": 25, "offset": 25}, rows=rows)


def archive_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of 25 three quarters down, of an archive that is laid out once."""
    rows = archive_dedup(spark, sf_dir).select("id", "name", "happened_on", "counterparty", "job_ref", "copies")
    made = pages.lay_out(rows, [F.col("happened_on").desc_nulls_first(), F.col("name"), F.col("id")])
    return made.page(len(made) * 3 // 4, 25)


def archive_counterparty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each counterparty wrote or was written to."""
    rows = archive.received(**archive_tables(spark, sf_dir), own_domain=OWN_DOMAIN)
    return rows.groupBy("counterparty").agg(F.count("*").alias("n"))


def fanout_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders as messages with one attachment each, filed once for each line."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    attachments = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("message_id"), F.concat("o_orderpriority",
        F.col("o_custkey").cast("string")).alias("fingerprint"), F.lit("f").alias("name"), F.lit(None).cast("string").alias("kind"),
        F.lit("final").alias("draft_or_final"), F.lit(None).cast("date").alias("document_date"), F.lit("/x").alias("stored_path"))
    messages = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("received_at"),
        F.lit("s").alias("subject"), F.lit("a@b.c").alias("sender"), F.lit("").alias("recipients"))
    bridge = lines.select(F.col("l_orderkey").alias("message_id"), F.col("l_suppkey").alias("file_id"))
    files = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("job_id"))
    jobs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("reference"))
    return {"attachments": attachments, "messages": messages, "message_files": bridge, "files": files, "jobs": jobs}


def archive_copies_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archive(**fanout_tables(spark, sf_dir), own_domain="x.y").select("id", "received_at", "job_ref", "copies")


def archive_copies_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archive(**fanout_tables(spark, sf_dir), own_domain="x.y", copies="attachments").select("id", "received_at", "job_ref", "copies")


FANOUT_SQL = """select id, received_at, job_ref, {copies} as copies from (
  select o_orderkey as id, o_orderpriority || o_custkey as f, o_orderdate as received_at, n_name as job_ref, count(*)
    over (partition by o_orderpriority || o_custkey) as rows_,
    row_number() over (partition by o_orderpriority || o_custkey order by o_orderdate desc nulls first, o_orderkey, n_name nulls last) as r
  from orders left join lineitem on l_orderkey = o_orderkey left join supplier on s_suppkey = l_suppkey left join nation on n_nationkey = s_nationkey) x
  {join} where r = 1"""


# References: the digits in documents and page addresses.


def key_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order comments: a job number and a year, split over subject and body."""
    orders = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    return orders.select(
        n.alias("id"), F.when(n % 4 > 0, F.concat(F.lit("<"), (F.expr("o_orderkey div 3")).cast("string"), F.lit(">"))).otherwise("").alias("message_id"),
        F.concat(F.lit("Re: 100."), F.lpad((n % 1000).cast("string"), 3, "0"), F.lit(" / 2"), (n % 7).cast("string")).alias("subject"),
        F.when(n % 5 > 0, F.concat(F.lit("see 100 "), F.lpad((F.col("o_custkey") % 40).cast("string"), 3, "0"), F.lit("-245 and 100"),
            F.lpad((n % 1000).cast("string"), 3, "0"), F.lit("/2"), (n % 7).cast("string"))).alias("body"),
        F.col("o_orderdate").alias("sent_at"), (n % 6 == 1).alias("has_key"), (n % 2 == 1).alias("kept_by_engine"),
    )


KEYS_CTE = r"""
msgs as (select o_orderkey as id, case when o_orderkey % 4 > 0 then '<' || (o_orderkey // 3) || '>' else '' end as message_id,
    'Re: 100.' || lpad((o_orderkey % 1000)::varchar, 3, '0') || ' / 2' || (o_orderkey % 7) as subject,
    case when o_orderkey % 5 > 0 then 'see 100 ' || lpad((o_custkey % 40)::varchar, 3, '0') || '-245 and 100' || lpad((o_orderkey % 1000)::varchar, 3,
      '0') || '/2' || (o_orderkey % 7) end as body,
    o_orderdate as sent_at, o_orderkey % 6 = 1 as has_key, o_orderkey % 2 = 1 as kept from orders),
hits as (select id, coalesce(nullif(message_id, ''), id::varchar) as msg, has_key, kept,
    unnest(regexp_extract_all(coalesce(subject, '') || ' ' || coalesce(body, ''), '100[.\s]?([0-9]{3})\s*[/-]\s*(2[0-9])')) as m from msgs
      where sent_at >= timestamp '1996-01-01'),
refs as (select *, '842.' || regexp_extract(m, '100[.\s]?([0-9]{3})\s*[/-]\s*(2[0-9])', 1) || '/' || regexp_extract(m,
  '100[.\s]?([0-9]{3})\s*[/-]\s*(2[0-9])', 2) as value from hits),
email_keys as (select id as email_id, 'job' as kind, value, 99 as confidence from
  (select *, row_number() over (partition by msg, value order by has_key desc, kept desc, id) as r from refs) where r = 1)"""
SINCE = datetime.datetime(1996, 1, 1)


def key_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.extract_keys(key_messages(spark, sf_dir), since=F.lit(SINCE).cast("timestamp_ntz"))


def key_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a rerun adds to a table that holds the keys of odd messages."""
    found = key_extract(spark, sf_dir)
    return keys.new_keys(found, found.where("email_id % 2 = 1"))


# Clusters: orders that name parts, turns that answer turns, texts that begin alike.


def cluster_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    n = F.col("o_orderkey")
    emails = orders.select(
        n.alias("id"), F.concat(F.lit(" <"), n.cast("string"), F.lit("> ")).alias("message_id"),
        F.when(n % 10 == 0, F.concat(F.lit("<"), (n - 1).cast("string"), F.lit(">"))).alias("in_reply_to"),
        F.when(n % 50 == 0, F.concat(F.lit("<"), (n - 10).cast("string"), F.lit("> <0>"))).alias("references"),
        F.when(F.col("o_custkey") % 97 == 0, F.concat(F.lit("shipment of "), F.col("o_custkey").cast("string"))).when(n % 31 == 0,
            "confirmation").otherwise("info").alias("subject_key"),
        n.alias("ingest_order"),
    )
    return emails, lines.select(F.col("l_orderkey").alias("email_id"), F.lit("ref").alias("kind"), F.col("l_partkey").cast("string").alias("value"))


def _clusters(spark: SparkSession, sf_dir: str, strong_only: bool) -> DataFrame:
    emails, refs = cluster_frames(spark, sf_dir)
    return threads.cluster(emails, refs, strong_only)


def cluster_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only shared references: no headers."""
    emails, refs = cluster_frames(spark, sf_dir)
    none = F.lit(None).cast("string")
    return threads.cluster(emails.withColumns({"in_reply_to": none, "references": none}), refs, strong_only=True)


def cluster_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir, False)


def cluster_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, each answering the one before."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    name = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit("."), F.lpad(t.cast("string"), 6, "0"))
    emails = turns.select(name(F.col("turn")).alias("id"), F.concat(F.lit("<"), name(F.col("turn")), F.lit(">")).alias("message_id"),
        F.concat(F.lit("<"), name(F.col("turn") - 1), F.lit(">")).alias("in_reply_to"), F.lit(None).cast("string").alias("references"),
        F.lit("").alias("subject_key"), F.col("turn").alias("ingest_order"))
    return threads.cluster(emails, spark.createDataFrame([], "email_id string, kind string, value string"))


def cluster_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    emails = docs.select(F.col("doc_id").alias("id"), none.alias("message_id"), none.alias("in_reply_to"), none.alias("references"),
        F.lower("text").alias("subject_key"), F.col("doc_id").alias("ingest_order"))
    return threads.cluster(emails, spark.createDataFrame([], "email_id long, kind string, value string"))


COMPONENTS = """
both_ as (select a, b from edges where a <> b union select b, a from edges where a <> b),
walk(n, m) as (select id, id from nodes union select w.n, e.b from walk w join both_ e on e.a = w.m)
select n as email_id, min(m) as cluster_id from walk group by n"""
STRONG_EDGES = """
keys1 as (select distinct l_orderkey as id, l_partkey::varchar as v from lineitem where l_orderkey in (select o_orderkey from orders)),
one as (select id, min(v) as v from keys1 group by id having count(*) = 1),
strong as (select c.a, o.id as b from one o join (select v, min(id) as a from one group by v having count(*) <= 120) c using (v))"""
HEADERS = """
heads as (select o_orderkey as id, o_orderkey - 1 as a from orders where o_orderkey % 10 = 0 union all select o_orderkey, o_orderkey - 10 from orders
  where o_orderkey % 50 = 0 union all select o_orderkey, 0 from orders where o_orderkey % 50 = 0),
replies as (select a, id as b from heads where a in (select o_orderkey from orders)),
subj as (select o_orderkey as id, case when o_custkey % 97 = 0 then 'shipment of ' || o_custkey when o_orderkey % 31 = 0 then 'confirmation'
  else 'info' end as s from orders),
told as (select * from subj where length(s) >= 12 and s not in ('confirmation', 'aggiornamento')),
subs as (select c.a, t.id as b from told t join (select s, min(id) as a from told group by s having count(*) <= 60) c using (s))"""


# Privacy: names of parts and customers as file names.


def mail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ["payslip", "Pay_Slip", "W-2_2025", "w2025", "P60", "xp60", "form 16", "timesheet", "packing list", "FORM-16", "p455", "salary statement"]
    subjects = ["New  hire", "delivery", "sick leave", "ETA", "clock-in", "quotation"]
    senders = ["admin@example.com", "ops@haulier.co.uk", "x@example.evil.org"]
    pick = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (c % len(xs) + 1).cast("int"))
    n = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        n.alias("id"), F.when(n % 13 > 0, F.concat(pick(words, n), F.lit("_"), F.col("p_name"), F.lit(".pdf"))).alias("filename"),
        F.when(n % 11 > 0, pick(subjects, F.expr("p_partkey div 2"))).alias("subject"), F.when(n % 17 > 0, pick(senders,
            F.expr("p_partkey div 5"))).alias("sender"), F.col("p_brand").alias("mailbox"),
    )


CONFIDENTIAL = r"""regexp_matches(coalesce(filename, ''),
  '(?i)pay[\s_-]?slip|payroll|wage[\s_-]?slip|salary[\s_-]?statement|(^|[^a-z0-9])p60([^0-9]|$)|(^|[^a-z0-9])p45([^0-9]|$)|(^|[^a-z0-9])w[-_ ]?2([^0-9]|$)|form[\s_-]?16|severance|attendance[\s_-]?sheet|timesheet')
  or (regexp_matches(coalesce(sender, ''), '(?i)@example\.') and regexp_matches(coalesce(subject, ''),
    '(?i)payslip|payroll|salary|salaries|wages|severance|new\s+hire|onboarding|resignation|dismissal|termination|sick\s+leave|maternity|paternity|injury\s+report|employment\s+contract|payroll\s+consultant|attendance|clock[\s_-]?in|hours\s+worked'))"""
PRIVACY_CTE = r"""
rows_ as (select p_partkey as id, case
  when p_partkey % 13 > 0 then ['payslip','Pay_Slip','W-2_2025','w2025','P60','xp60','form 16','timesheet','packing list','FORM-16','p455','salary statement'][(p_partkey % 12 + 1)::int]
  || '_' || p_name || '.pdf' end as filename,
  case when p_partkey % 11 > 0 then ['New  hire','delivery','sick leave','ETA','clock-in','quotation'][((p_partkey // 2) % 6 + 1)::int] end as subject,
  case when p_partkey % 17 > 0 then ['admin@example.com','ops@haulier.co.uk','x@example.evil.org'][((p_partkey // 5) % 3 + 1)::int] end as sender,
    p_brand as mailbox from part),
judged as (select *, {confidential} as confidential from rows_)""".format(confidential=CONFIDENTIAL)


def privacy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mail_rows(spark, sf_dir)
    return rows.select("id", "filename", privacy.is_confidential(F.col("filename"), F.col("subject"), F.col("sender")).alias("confidential"))


def privacy_held_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.held_back_counts(privacy.gate(mail_rows(spark, sf_dir))[1])


# Shipments: orders with the sums of their lines.


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("line_count"), F.max("l_returnflag").alias("flag"),
        F.min("l_shipdate").alias("ship"), F.min("l_linestatus").alias("line"))
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    words = {"R": "delivered", "A": "departed", "N": "loaded"}
    travel = F.when(n % 3 == 0, F.element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), F.col("flag")))
    return o.join(lines, n == F.col("l_orderkey"), "left").select(
        n.alias("id"), F.when(n % 29 == 0, F.to_date("o_orderdate")).alias("proof_date"), F.when(n % 58 == 0, "cmr").alias("proof_kinds"),
            travel.alias("travel_state"),
        F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("job_status"), F.when(n % 4 > 0, F.concat(F.lit("842."),
            n.cast("string"))).when(n % 8 == 0, "").alias("job_ref"),
        F.when(n % 5 > 1, 0).when(n % 5 == 1, (n % 3 - 1)).cast("decimal(18,2)").alias("revenue_to_invoice"), F.when(n % 7 > 0,
            F.lit(0)).otherwise(F.lit(12)).cast("decimal(18,2)").alias("cost_to_receive"),
        (n % 6 == 0).alias("fully_settled"), F.when(n % 2 == 0,
            F.expr("cast(DATE'2001-08-01' as timestamp) - make_dt_interval(cast(o_orderkey % 20 as int), 3)")).alias("last_message"),
        F.when(n % 3 == 1, F.to_date("ship")).alias("pickup_date"), F.when(n % 9 == 2, F.lit(TODAY)).alias("goods_ready_date"), F.when(n % 9 == 5,
            F.date_add(F.lit(TODAY), 9)).alias("departure_date"),
        F.when(n % 10 > 0, F.col("line_count")).alias("line_count"),
    )


STATE_CTE = """
lines as (select l_orderkey, count(*) as n, max(l_returnflag) as flag, min(l_shipdate) as ship from lineitem group by 1),
s as (select o_orderkey as id, case when o_orderkey % 29 = 0 then o_orderdate::date end as proof_date, case when o_orderkey % 58 = 0 then 'cmr' end as kinds,
  case when o_orderkey % 3 = 0 then case flag when 'R' then 'delivered' when 'A' then 'departed' when 'N' then 'loaded' end end as travel,
  o_orderstatus = 'F' as closed, case when o_orderkey % 4 > 0 then '842.' || o_orderkey when o_orderkey % 8 = 0 then '' end as ref,
  case when o_orderkey % 5 > 1 then 0 when o_orderkey % 5 = 1 then o_orderkey % 3 - 1 end as rev, case when o_orderkey % 7 > 0 then 0
    else 12 end as cost, o_orderkey % 6 = 0 as paid,
  case when o_orderkey % 2 = 0 then timestamp '2001-08-01' - to_hours(((o_orderkey % 20) * 24 + 3)::int) end as heard,
  case when o_orderkey % 3 = 1 then ship::date when o_orderkey % 9 = 2 then date '2001-08-01' when o_orderkey % 9 = 5 then date '2001-08-10' end as due,
  case when o_orderkey % 10 > 0 then n end as n from orders left join lines on l_orderkey = o_orderkey),
t as (select *, coalesce(rev, 0) = 0 and coalesce(cost, 0) = 0 as even, date_diff('day', heard::date, date '2001-08-01') as quiet from s),
verdicts as (select id, case when proof_date is not null then 'delivered' when travel = 'delivered' then 'delivered' when closed and even then 'settled'
    when quiet > 15 and coalesce(ref, '') = '' then 'archived' when quiet > 15 then 'unclear' when paid and even then 'settled'
      when travel in ('departed', 'loaded') then 'in_transit'
    when due < date '2001-08-01' then 'loading_overdue' else 'awaiting_loading' end as state,
  case when proof_date is not null then 'arrival document (' || coalesce(kinds, 'None') || ') dated ' || proof_date
    when travel = 'delivered' then 'the correspondence says delivered'
    when closed and even then 'job closed, fully invoiced and paid' when quiet > 15 and coalesce(ref,
      '') = '' then 'no job reference, nothing heard for ' || quiet || ' days'
    when quiet > 15 then 'job open, nothing heard for ' || quiet || ' days' || case when travel is null then '' else ', last we heard: ' || travel end
    when paid and even then 'collected and paid: the job is closed' when travel in ('departed', 'loaded') then 'the correspondence says ' || travel
    when due < date '2001-08-01' then 'loading due ' || due || ', no departure recorded' when due is not null then 'loading due ' || due
    when coalesce(n, 0) = 0 then 'job just opened, nothing filled in yet' else 'no loading date yet' end as reason from t)"""

# The portal counts whole periods of 24 hours, here one fewer than calendar days as all mail came at 21:00.
PORTAL_CTE = STATE_CTE.replace("date_diff('day', heard::date, date '2001-08-01') as quiet", "date_diff('day', heard::date, date '2001-08-01') - 1 as quiet")
for _old, _new in (("the correspondence says", "correspondence says"), ("fully invoiced", "invoiced"), ("no job reference", "no job ref"),
    ("collected and paid: the job is closed", "collected and paid"), ("'None'", "'null'")):
    PORTAL_CTE = PORTAL_CTE.replace(_old, _new)


def state_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shipments(spark, sf_dir).select("id", state.shipment_state(TODAY).alias("v")).select("id", "v.state", "v.reason")


def state_portal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts in the portal's words."""
    return shipments(spark, sf_dir).select("id", state.shipment_state(TODAY, dialect=state.PORTAL).alias("v")).select("id", "v.state", "v.reason")


def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_verdict(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


# Passages and vectors.

#: The queries' passages lose blanks at their ends, other white space stays, as their SQL says.
EDGES = " "


def chunk_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = transcripts.with_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), edges=EDGES)
    return docs.select("doc_id", F.inline("passages"))


def chunk_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of a source as one transcript, cut in blocks of 200,000 characters."""
    parts = table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("seq"), F.concat("text", F.lit("\n")).alias("text"))
    return long_transcripts.long_passages(parts, block_chars=200_000, edges=EDGES).withColumnRenamed("doc", "source")


def chunk_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each document and their longest."""
    units = transcripts.sentences(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", units.alias("u"))
    longest = F.array_max(F.transform("u", F.length))
    return rows.select("doc_id", F.size("u").cast("long").alias("n_units"), F.coalesce(longest, F.lit(0)).cast("long").alias("longest"))


def search(spark: SparkSession, sf_dir: str, limit: int, floor: float) -> DataFrame:
    """The vectors closest to each of those whose number 20 divides."""
    index = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", F.col("vec_id").alias("ordinal"), F.lit("m").alias("model"))
    queries = index.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")  # the stated query set
    return retrieval.nearest_each(index, queries, limit, floor, model="m")


def vec_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, sf_dir, retrieval.LIMIT, 0.0).select("query_id", "rank", "vec_id", "label", "score")


def vec_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 vectors closest to the mean of all (to three places): one query, as a column expression."""
    index = table(spark, sf_dir, "embeddings").withColumn("ordinal", F.col("vec_id"))
    numbers = index.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.round(F.avg(F.col("x").cast("double")), 3).alias("x"))
    query = [r["x"] for r in numbers.orderBy("i").collect()]  # a row a dimension
    return retrieval.nearest(index, query, limit=50).select("vec_id", "label", "score")


def vec_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 closest to each query that score 0.1 or more, by label."""
    found = search(spark, sf_dir, 50, 0.1)
    rows = found.select(
        "query_id", F.col("label").alias("meeting_id"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("title"),
        F.col("ordinal").cast("int").alias("ordinal"), F.lit("").alias("text"), F.lit(0).alias("from_char"), "score", "rank",
    )
    grouped = retrieval.group_by_meeting(rows, by=["query_id"])
    ordinals = F.array_join(F.transform("passages", lambda p: p["ordinal"].cast("string")), ",")
    return grouped.select("query_id", "meeting_id", "title", "score", F.size("passages").cast("long").alias("n_passages"), ordinals.alias("ordinals"))


VEC_SQL = """scored as (
  select q.vec_id as query_id, e.vec_id, e.label,
    case when len(e.embedding) = len(q.embedding) then list_cosine_similarity(e.embedding::double[], q.embedding::double[]) else 0 end as s
  from embeddings e, (select vec_id, embedding from embeddings where vec_id % 20 = 0) q where len(e.embedding) > 0),
ranked as (select query_id, vec_id, label, round(s, 4) as score, row_number() over (partition by query_id order by round(s, 4) desc, vec_id) as rank
  from scored where s >= {floor})"""


# Threads and facts from a model.


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        F.col("conv_id").alias("job_id"), F.col("turn").alias("ordinal"),
            F.expr("cast(date_add(DATE'2026-01-01', cast(turn as int)) as timestamp)").alias("sent_at"),
        F.col("role").alias("sender"), F.when(F.col("turn") % 3 > 0, F.concat(F.lit("turn "), F.col("turn").cast("string"))).alias("subject"),
            F.col("text").alias("body"),
        F.when(F.col("turn") % 4 == 1, F.repeat("text", 3)).alias("attachment_text"),
    )


THREAD_CTE = r"""
m as (select conv_id as job_id, turn, date '2026-01-01' + turn::int as d, role, case when turn % 3 > 0 then 'turn ' || turn end as subject,
  text as body, case when turn % 4 = 1 then repeat(text, 3) end as att,
  row_number() over (partition by conv_id order by turn, text) as up, count(*) over (partition by conv_id) as n from conversations),
b as (select *, '--- ' || strftime(d, '%d/%m/%Y') || ' from ' || coalesce(role, 'None') || chr(10) || 'Subject: ' || coalesce(subject, 'None') || chr(10)
    || regexp_replace(regexp_replace(coalesce(body, ''), '^\s+|\s+$', '', 'g'), '\n{3,}', chr(10), 'g') || case when coalesce(att, '') = '' then ''
      else chr(10) || '[ATTACHMENTS]' || chr(10) || substr(att, 1, 1800) end as block
  from m where up <= 3 or up > n - 5),
threads as (select job_id, substr(string_agg(block, chr(10) || chr(10) order by turn, block), 1, 9000) as thread from b group by job_id)"""


def thread_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.build_threads(extraction.ends_of_threads(mails(spark, sf_dir)))


def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.estimate(thread_text(spark, sf_dir)).select("n_threads", F.round("estimate_usd", 6).alias("estimate_usd"))


def cost_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which calls a cap of five cents lets through, at 220 tokens an answer."""
    calls = thread_text(spark, sf_dir).select("job_id", extraction.cost_of(F.floor(F.length("thread") / 4) + 400, F.lit(220)).alias("cost"))
    return extraction.within_cap(calls, "job_id", 0.05).select("job_id", F.round("cost", 8).alias("cost"), F.round("spent_before", 8).alias("spent_before"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply for each customer, with its JSON between other words."""
    n = F.col("c_custkey")
    said = F.to_json(F.struct(
        F.when(n % 3 > 0, F.concat(F.lit("port "), (n % 9).cast("string"))).otherwise("null").alias("origin"), F.when(n % 4 > 0,
            F.col("c_mktsegment")).alias("destination"),
        F.when(n % 5 > 0, "unknown").otherwise(F.repeat(F.lit("x"), 300)).alias("carrier"), F.lit("to_load").alias("phase"), F.when(n % 7 > 0,
            (n % 100).cast("int")).alias("confidence"), F.lit("because").alias("why"),
    ))
    reply = F.when(n % 19 > 0, F.concat(F.lit("Here: "), said, F.lit(" done"))).otherwise("no answer")
    return table(spark, sf_dir, "customer").select(n.alias("id"), extraction.parse_answer(reply).alias("a")).where("a is not null").select("id", "a.*")


ANSWER_CTE = """
a as (select c_custkey as id, case when c_custkey % 3 > 0 then 'port ' || (c_custkey % 9) else 'null' end as origin, case
  when c_custkey % 4 > 0 then c_mktsegment end as destination,
  case when c_custkey % 5 > 0 then 'unknown' else repeat('x', 300) end as carrier, 'to_load' as phase, case
    when c_custkey % 7 > 0 then (c_custkey % 100)::int end as confidence from customer where c_custkey % 19 > 0)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.observations(answers(spark, sf_dir))


def job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        n.alias("id"), F.when(n % 2 == 0, "typed").alias("origin"), F.when(n % 8 == 0, "typed").alias("destination"),
            F.lit(None).cast("string").alias("carrier"),
        F.when(n % 9 == 0, "hand").alias("route_source"), F.lit(None).cast("timestamp").alias("ai_seen_at"), F.when(n % 6 > 0, n % 6 == 1).alias("verified"),
    )


def guarded_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.guarded_update(job_rows(spark, sf_dir), answers(spark, sf_dir), NOW)


JOB_CTE = """j as (select c_custkey as id, case when c_custkey % 2 = 0 then 'typed' end as origin, case when c_custkey % 8 = 0 then 'typed' end as destination,
  null::varchar as carrier, case when c_custkey % 9 = 0 then 'hand' end as route_source, null::timestamp as ai_seen_at,
  case when c_custkey % 6 > 0 then c_custkey % 6 = 1 end as verified from customer)"""
UPDATE = """select id, case when sure and origin is null then o else origin end as origin, case when sure and destination is null then d else destination end
    as destination, case when sure and carrier is null then c else carrier end as carrier,
    case when sure and route_source is null then 'ai' else route_source end as route_source,
    case when hit then timestamp {now} else ai_seen_at end as ai_seen_at, verified
  from (select x.*, y.origin as o, y.destination as d, y.carrier as c, y.id is not null and coalesce(not verified, false) as hit,
      y.id is not null and coalesce(not verified, false) and coalesce(y.confidence, 0) >= 70 as sure from {jobs} x left join {answers} y on y.id = x.id)"""


CHUNK_SQL = r"""with recursive
d as (select doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') as s from {texts}),
m as (select doc_id, string_split(regexp_replace(s, '([.!?])(\s+)([A-ZÀÈÉÌÒÙ0-9])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g'), chr(1)) as p
  from d where s <> ''),
e as (select doc_id, unnest(p) as x, generate_subscripts(p, 1) as i from m),
w as (select doc_id, i, greatest(strpos(x, chr(2)) - 1, 0) as gap, length(replace(x, chr(2), '')) as len from e),
o as (select doc_id, i, sum(len) over (partition by doc_id order by i) - len + gap as a, len - gap as n from w),
pieces as (select doc_id, a + k * 1200 as a, least(1200, n - k * 1200) as n from (select *, unnest(range((n + 1199) // 1200)) as k from o where n > 0)),
q as (select doc_id, a, n, sum(n + 1) over (partition by doc_id order by a) as w from pieces),
l as (select doc_id, list(a order by a) as a, list(n order by a) as n, list_concat([0], list(w order by a)) as w, count(*) as c from q group by doc_id),
r(doc_id, lo, hi, ordinal) as (
  select doc_id, 0::bigint, list_min(list_filter(range(1, c + 1), lambda h: w[h + 1] - w[1] - 1 >= 1200)), 0 from l
  union all
  select doc_id, lo, list_min(list_filter(range(hi + 1, c + 1), lambda h: w[h + 1] - w[lo + 1] - 1 >= 1200)), ordinal + 1 from (
    select r.doc_id, r.hi, r.ordinal, l.w, l.c, coalesce(list_max(list_filter(range(r.lo + 1, r.hi + 1),
      lambda k: l.w[r.hi + 1] - l.w[k + 1] >= 200)), r.lo + 1) as lo
    from r join l on l.doc_id = r.doc_id where r.hi is not null)),
t as (select r.*, r.hi is null as rest, l.a[lo + 1] as from_char, trim(array_to_string(list_transform(range(lo, coalesce(hi, c)),
  lambda k: substr(d.s, (l.a[k + 1] + 1)::bigint, l.n[k + 1]::bigint)), ' ')) as text
  from r join l using (doc_id) join d using (doc_id) where lo < coalesce(hi, c)),
z as (select *, lead(text) over (partition by doc_id order by ordinal) as after, lead(rest) over (partition by doc_id order by ordinal) as last from t),
y as (select doc_id, ordinal, from_char, case when last and length(after) < 120 then text || ' ' || after else text end as text from z where not (rest
  and length(text) < 120 and ordinal > 0))
select doc_id, ordinal, text, from_char::int as from_char, (from_char + length(text))::int as to_char from y"""

QUERIES = {
    f.__name__: f
    for f in (
        archive_dedup, archive_filtered, archive_page, archive_deep_page, archive_counterparty, archive_copies_fanout, archive_copies_attachments,
        key_extract, key_upsert, cluster_strong, cluster_reply, cluster_subject, cluster_all, privacy_gate, privacy_held_back,
        state_verdict, state_portal, state_counts, chunk_passages, chunk_long, chunk_units, vec_nearest, vec_single, vec_group, thread_text, cost_estimate,
            cost_cap, observations, guarded_update,
    )
}

ORACLE_SQL = {
    "archive_dedup": f"with {ARCHIVE_CTE} {ARCHIVE_PICK.format(where='')}",
    "archive_filtered": f"with {ARCHIVE_CTE} {ARCHIVE_PICK.format(where="where kind = 'en' and happened_on >= date '2026-02-01'")}",
    "archive_page": f"with {ARCHIVE_CTE} select id, name, happened_on, counterparty, job_ref, copies from ({ARCHIVE_PICK.format(where='')}) order by happened_on desc nulls first, name, id limit 25 offset 25",
    "archive_deep_page": f"""with {ARCHIVE_CTE}, r as (select *, count(*) over () as n,
      row_number() over (order by happened_on desc nulls first, name, id) - 1 as place from ({ARCHIVE_PICK.format(where='')}))
      select id, name, happened_on, counterparty, job_ref, copies from r where place >= n * 3 // 4 and place < n * 3 // 4 + 25""",
    "archive_counterparty": f"with {ARCHIVE_CTE} select counterparty, count(*) as n from joined group by 1",
    "archive_copies_fanout": FANOUT_SQL.format(copies="rows_", join=""),
    "archive_copies_attachments": FANOUT_SQL.format(copies="n",
        join="join (select o_orderpriority || o_custkey as g, count(distinct o_orderkey) as n from orders group by 1) y on y.g = x.f"),
    "key_extract": f"with {KEYS_CTE} select * from email_keys",
    "key_upsert": f"with {KEYS_CTE} select * from email_keys where email_id % 2 = 0",
    "cluster_strong": f"with recursive {STRONG_EDGES}, nodes as (select o_orderkey as id from orders), edges as (select a, b from strong), {COMPONENTS}",
    "cluster_all": f"with recursive {STRONG_EDGES}, {HEADERS}, nodes as (select o_orderkey as id from orders), edges as (select a, b from strong union all select a, b from replies union all select a, b from subs), {COMPONENTS}",
    "cluster_reply": """with t as (select distinct conv_id, turn from conversations), g as (select *, turn - row_number() over (partition by conv_id order by turn) as run from t)
      select conv_id || '.' || lpad(turn::varchar, 6, '0') as email_id, conv_id || '.' || lpad((min(turn) over (partition by conv_id, run))::varchar,
        6, '0') as cluster_id from g""",
    "cluster_subject": """with s as (select doc_id, coalesce(lower(text), '') as k from documents), n as (select k, count(*) as n, min(doc_id) as least from s group by k)
      select doc_id as email_id, case when n.n between 2 and 60 and length(k) >= 12 then least else doc_id end as cluster_id from s join n using (k)""",
    "privacy_gate": f"with {PRIVACY_CTE} select id, filename, confidential from judged",
    "privacy_held_back": f"with {PRIVACY_CTE} select mailbox, count(*) as held_back from judged where confidential and coalesce(filename, '') <> '' group by 1",
    "state_verdict": f"with {STATE_CTE} select * from verdicts",
    "state_portal": "with " + PORTAL_CTE + " select * from verdicts",
    "state_counts": f"with {STATE_CTE} select state, count(*) as n from verdicts group by 1",
    "chunk_passages": CHUNK_SQL.format(texts="documents"),
    "chunk_long": "select doc_id as source, * exclude (doc_id) from (" + CHUNK_SQL.format(
        texts="(select source as doc_id, string_agg(text || chr(10), '' order by doc_id) as text from documents group by source)") + ")",
    "chunk_units": r"""with d as (select doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') as text from documents),
      u as (select doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+([A-ZÀÈÉÌÒÙ0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)),
        lambda s: s <> '') as u from d)
      select doc_id, len(u)::bigint as n_units, coalesce(list_max(list_transform(u, lambda s: length(s))), 0)::bigint as longest from u""",
    "vec_nearest": f"with {VEC_SQL.format(floor=0)} select query_id, rank::int as rank, vec_id, label, score from ranked where rank <= 8",
    "vec_single": """with n as (select unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
      q as (select list(x order by i) as q from (select i, round(avg(x), 3) as x from n group by i)),
      s as (select vec_id, label, case when len(embedding) = len(q) then list_cosine_similarity(embedding::double[], q) else 0 end as s from embeddings, q
        where len(embedding) > 0)
      select vec_id, label, round(s, 4) as score from s where s >= 0 order by round(s, 4) desc, vec_id limit 50""",
    "vec_group": f"""with {VEC_SQL.format(floor=0.1)}
      select query_id, label::varchar as meeting_id, 'v' || arg_min(vec_id, rank) as title, greatest(max(score), 0.0) as score, count(*) as n_passages,
        string_agg(vec_id::varchar, ',' order by rank) as ordinals
      from ranked where rank <= 50 group by query_id, label""",
    "thread_text": f"with {THREAD_CTE} select job_id, thread from threads",
    "cost_estimate": f"with {THREAD_CTE} select count(*) as n_threads, round(sum(length(thread) / 3.5 + 400) * 1e-6 + count(*) * 220 * 5e-6, 6) as estimate_usd from threads",
    "cost_cap": f"""with {THREAD_CTE}, c as (select job_id, (length(thread) // 4 + 400) * 1e-6 + 220 * 5e-6 as cost from threads),
      r as (select *, coalesce(sum(cost) over (order by job_id rows between unbounded preceding and 1 preceding), 0) as spent from c) select job_id,
        round(cost, 8) as cost, round(spent, 8) as spent_before from r where spent < 0.05""",
    "observations": f"""with {ANSWER_CTE}, p as (select id, confidence, unnest(['origin', 'destination', 'carrier', 'phase']) as field, unnest([origin, destination, carrier, phase]) as value from a)
      select 'job' as entity, id as entity_id, field, substr(value, 1, 200) as value, 5 as source_level, 'ai' as source, confidence,
        'because' as rationale from p where coalesce(value, '') not in ('', 'null', 'unknown')""",
    "guarded_update": f"""with {ANSWER_CTE}, {JOB_CTE} {UPDATE.format(jobs='j', answers='a', now="'2026-01-01'")}""",
}
