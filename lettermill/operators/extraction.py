"""Facts from a model, under a cost cap, that never overwrite what people entered."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, MapType, StringType, StructField, StructType
from pyspark.sql.window import Window

from lettermill.functions.text import falsy, first_chars, shown, strip
from lettermill.operators.paid import BILLION, Journal, Lease, billionths, in_leases, key_of
from lettermill.operators.running import running_total
from lettermill.session import new_path, ship
from lettermill.sources.versioned import Manifest, VersionedTable

# Fixed values
PRICE_IN, PRICE_OUT = 1.0 / 1_000_000, 5.0 / 1_000_000
CAP = 0.50
MIN_CONFIDENCE = 70
CHARS_PER_TOKEN, PROMPT_TOKENS, ANSWER_TOKENS = 3.5, 400, 220
MAX_TOKENS = 400
FIELDS = ["origin", "destination", "carrier", "phase"]
FILLED = ["origin", "destination", "carrier"]
MEANINGLESS = ["", "null", "unknown"]
SOURCE_LEVEL, SOURCE = 5, "ai"
ANSWER = "origin string, destination string, departed string, actually_departed boolean, eta string, actually_arrived boolean, carrier string, phase string, confidence int, why string"


def ends_of_threads(mails: DataFrame, by: str = "job_id", first: int = 3, last: int = 5) -> DataFrame:
    """The first and last mails of each thread, by ``sent_at`` (then
    ``ordinal``, if there is one, then the other columns in turn, so equal rows
    alone can stand for each other); the middle mostly quotes them.

    Either end is a window whose rank is limited, so each task keeps ``first``
    or ``last`` mails of a thread before the shuffle, and a thread of all rows
    is no more work than another. How long a thread is says which of its last
    mails are not among the first.
    """
    names = mails.columns
    order = ["sent_at", *[c for c in ("ordinal",) if c in names]]
    order += [c for c in names if c not in (by, *order) and not isinstance(mails.schema[c].dataType, MapType)]
    end = lambda columns, most: mails.withColumn("__place", F.row_number().over(Window.partitionBy(by).orderBy(*columns))).where(
        F.col("__place") <= most)
    size = mails.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("__n"))
    late = end([F.col(c).desc() for c in order], last)
    late = late.join(size, late[by].eqNullSafe(size["__by"])).where(F.col("__n") - F.col("__place") >= first)
    return end(order, first).select(*names).unionByName(late.select(*names))


def _tie(mails: DataFrame) -> list[str]:
    return ["ordinal"] if "ordinal" in mails.columns else []


def mail_block() -> Column:
    """One mail as the model reads it."""
    c = F.col
    body = F.regexp_replace(strip(F.coalesce("body", F.lit(""))), r"\n{3,}", "\n")
    head = F.concat(F.lit("--- "), F.date_format("sent_at", "dd/MM/yyyy"), F.lit(" from "), shown(c("sender")), F.lit("\nSubject: "),
        shown(c("subject")), F.lit("\n"), body)
    return F.when(falsy(c("attachment_text")), head).otherwise(F.concat(head, F.lit("\n[ATTACHMENTS]\n"), first_chars(c("attachment_text"), 1800)))


def build_threads(mails: DataFrame, by: str = "job_id") -> DataFrame:
    """``(job_id, thread)``: a thread's mails in order, 9,000 characters at most."""
    item = F.struct("sent_at", *_tie(mails), mail_block().alias("block"))
    blocks = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["block"])
    return mails.groupBy(by).agg(first_chars(F.array_join(blocks, "\n\n"), 9000).alias("thread"))


def estimate(threads: DataFrame) -> DataFrame:
    """One row: number of threads and expected cost in USD."""
    tokens = F.sum(F.length("thread") / CHARS_PER_TOKEN + PROMPT_TOKENS)
    return threads.agg(F.count("*").alias("n_threads"), (F.coalesce(tokens,
        F.lit(0.0)) * PRICE_IN + F.count("*") * (ANSWER_TOKENS * PRICE_OUT)).alias("estimate_usd"))


def within_cap(calls: DataFrame, order: str, cap: float = CAP, cost: str = "cost") -> DataFrame:
    """The calls that are made when each is preceded by a look at what has been
    spent: those before which it was below ``cap``. Adds ``spent_before``, a
    running total over ranges of ``order``."""
    return running_total(calls, order, F.col(cost), "spent_before").where(F.col("spent_before") < cap)


def cost_of(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in * PRICE_IN + tokens_out * PRICE_OUT


def parse_answer(reply: Column) -> Column:
    """The JSON object in a reply, from its first to its last brace; null if none."""
    found = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.from_json(F.nullif(found, F.lit("")), ANSWER)


def request(thread: str, model: str, system: str, max_tokens: int = MAX_TOKENS) -> dict:
    """What the service is asked about one thread."""
    return {"model": model, "max_tokens": max_tokens, "system": system, "messages": [{"role": "user", "content": thread}]}


@dataclass(frozen=True)
class Run:
    """How a run ended: ``no key``, ``refused`` (the estimate was over the cap),
    ``dry run`` or ``done``. Only what was done has replies, ``(job_id, reply,
    error, cost, lost)``, in tables that later actions read without new calls."""

    outcome: str
    n_threads: int = 0
    estimate_usd: float = 0.0
    replies: DataFrame | None = None

    def report(self) -> str:
        """What to tell whoever started it."""
        planned = f"{self.n_threads} threads, about {self.estimate_usd:.2f} USD"
        if self.replies is None:
            return f"{self.outcome}: {planned}" if self.outcome != "no key" else "no key: nothing was started"
        got = run_summary(self.replies).first()
        return f"{self.outcome}: {planned}; {got['n_read']} read, {got['n_errors']} errors, {got['spent_usd']:.3f} USD spent"


def most_of(thread: Column) -> Column:
    """The most that a call about a thread can cost: no token is shorter than a
    byte, and the answer has a limit."""
    return F.octet_length(thread) * billionths(PRICE_IN) + PROMPT_TOKENS * billionths(PRICE_IN) + MAX_TOKENS * billionths(PRICE_OUT)


def ask(jobs: DataFrame, threads: DataFrame, model: Callable[[str], tuple[str, int, int]] | None, by: str = "job_id", cap: float = CAP,
    apply: bool = False, most: Callable[[Column], Column] = most_of, journal: Journal | None = None) -> Run:
    """Ask ``model`` about the thread of every job that has one.

    ``model`` is a function of a thread (see ``request``) that returns the
    reply and the tokens in and out; None means that there is no key. Without a
    key, with an estimate over ``cap`` and unless ``apply`` is true nothing is
    called. A call that fails is a row with an error.

    All tasks call at once, in waves whose calls together cannot cost more than
    what is left of ``cap`` (``most`` bounds each: see ``paid.in_leases``), so
    spending never passes it; in the order of ``by``, what no longer fits is
    missing from the replies. Each reply is journalled before the next call. A
    task whose worker died makes one call again, and what the first may have
    cost is its row's ``lost``. A run that failed goes on where it stopped if it
    is given the ``journal`` of the first; speculative tasks would ask twice.
    """
    if model is None:
        return Run("no key")
    asked = threads.join(jobs.select(by).distinct(), by).select(by, "thread")
    plan = estimate(asked).first()
    planned = (plan["n_threads"], plan["estimate_usd"])
    if plan["estimate_usd"] > cap:
        return Run("refused", *planned)
    if not apply:
        return Run("dry run", *planned)
    spark = threads.sparkSession
    ship(spark)
    journal = journal or Journal(new_path(spark, "journal"))
    schema = StructType([threads.schema[by], StructField("thread", StringType()), StructField("most", LongType()), StructField("reply", StringType()),
        StructField("error", StringType()), StructField("cost", LongType()), StructField("lost", LongType()), StructField("deferred", BooleanType())])

    def priced(thread: str) -> tuple[str, int]:
        reply, tokens_in, tokens_out = model(thread)
        return reply, tokens_in * billionths(PRICE_IN) + tokens_out * billionths(PRICE_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lease = Lease(journal)
        for batch in batches:
            idents, texts, bounds = (batch.column(k).to_pylist() for k in range(3))
            told = [lease.call(key_of(str(i), t or ""), m, lambda t=t: priced(t)) for i, t, m in zip(idents, texts, bounds, strict=True)]
            columns = [("reply", pa.string()), ("error", pa.string()), ("cost", pa.int64()), ("lost", pa.int64()), ("deferred", pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([getattr(x, c) for x in told], t) for c, t in columns)], schema.names)

    waves, _, _ = in_leases(asked, by, most(F.col("thread")), billionths(cap), lambda wave: wave.select(by, "thread", "most").mapInArrow(run, schema))
    empty = spark.createDataFrame([], schema).drop("deferred")
    usd = lambda c: (F.col(c) / BILLION).alias(c)
    return Run("done", *planned, reduce(DataFrame.unionByName, waves, empty).select(by, "reply", "error", usd("cost"), usd("lost")))


def run_summary(replies: DataFrame) -> DataFrame:
    """One row: replies with an answer in them, failed or unreadable ones, what
    was spent (calls that were lost counted at the most they can have cost), and
    what of it was lost."""
    read = F.col("error").isNull() & parse_answer(F.col("reply")).isNotNull()
    lost = F.coalesce(F.sum("lost"), F.lit(0.0))
    return replies.agg(F.count_if(read).alias("n_read"), F.count_if(~read).alias("n_errors"), (F.coalesce(F.sum("cost"),
        F.lit(0.0)) + lost).alias("spent_usd"), lost.alias("lost_usd"))


def answers_of(replies: DataFrame, by: str = "job_id") -> DataFrame:
    """The readable answers, one for each job, as ``observations`` and
    ``guarded_update`` take them."""
    return replies.select(F.col(by).alias("id"), parse_answer(F.col("reply")).alias("a")).where("a is not null").select("id", "a.*")


def observations(answers: DataFrame, ident: str = "id") -> DataFrame:
    """Everything the model said of the four fields, trusted or not, as log rows."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])
    rows = answers.select(F.lit("job").alias("entity"), F.col(ident).alias("entity_id"), "confidence", first_chars(F.coalesce("why", F.lit("")),
        400).alias("rationale"), F.explode(pairs).alias("p"))
    rows = rows.where(~F.coalesce(F.col("p.value"), F.lit("")).isin(MEANINGLESS))
    return rows.select("entity", "entity_id", "p.field", first_chars(F.col("p.value"), 200).alias("value"), F.lit(SOURCE_LEVEL).alias("source_level"),
        F.lit(SOURCE).alias("source"), "confidence", "rationale")


def guarded_update(jobs: DataFrame, answers: DataFrame, now: datetime.datetime, ident: str = "id") -> DataFrame:
    """``jobs`` after the answers: empty fields filled by confident answers,
    never on a job that was verified (or of which that is unknown). Of several
    answers for a job the most confident one counts, and of equally confident
    ones the first in the order of their fields."""
    best = F.struct(F.coalesce("confidence", F.lit(0)).alias("sure"), F.struct(*[F.struct(F.col(f).isNull().alias("none"),
        F.col(f).alias("value")) for f in FILLED]).alias("said"))
    rank = F.struct((-best["sure"]).alias("s"), best["said"].alias("f"))
    answers = answers.groupBy(F.col(ident).alias(ident)).agg(F.min(rank).alias("r")).select(ident, (-F.col("r.s")).alias("confidence"),
        *[F.col(f"r.f.col{k}.value").alias(f) for k, f in enumerate(FILLED, 1)])
    a = answers.select(F.col(ident).alias("__id"), *[F.col(f).alias(f"__{f}") for f in FILLED], (F.coalesce("confidence",
        F.lit(0)) >= MIN_CONFIDENCE).alias("__ok"))
    rows = jobs.join(a, F.col(ident) == F.col("__id"), "left")
    reached = F.col("__id").isNotNull() & F.coalesce(~F.col("verified"), F.lit(False))
    sure = reached & F.col("__ok")
    new = {f: F.when(sure & F.col(f).isNull(), F.col(f"__{f}")).otherwise(F.col(f)) for f in FILLED}
    new["route_source"] = F.when(sure & F.col("route_source").isNull(), F.lit(SOURCE)).otherwise(F.col("route_source"))
    new["ai_seen_at"] = F.when(reached, F.lit(now).cast("timestamp")).otherwise(F.col("ai_seen_at"))
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in jobs.columns])


def update_jobs(jobs: VersionedTable, answers: DataFrame, now: datetime.datetime, run: str, ident: str = "id") -> Manifest:
    """``guarded_update`` of a table of jobs, in place: only the buckets that
    hold a job with an answer are written anew, no other writer's update is
    lost, and a ``run`` that is in the table already changes nothing."""
    return jobs.update(run, answers, lambda rows, said: guarded_update(rows, said, now, ident))
