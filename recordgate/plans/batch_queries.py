"""Queries of what lasts from batch to batch: keyed state of streams, the ledger of commits, indexes of keys."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import dates
from ..operators.keyindex import KeyIndex
from ..sources.ledger import Ledger
from ..streaming import stream, unique
from . import staging
from .file_queries import _event_files, scratch
from .registry import Source, query


@query("STR04", "SELECT CAST(user_id AS BIGINT) AS user_id, CAST(CASE WHEN user_id IS NULL THEN 0 ELSE count(*) - 1 END AS BIGINT) AS rejected FROM events GROUP BY user_id")
def str04(t):
    folder = scratch(t, "str04")
    unique.write_marked(unique.marked(_event_files(t, folder), ["user_id"], "event_id"), f"{folder}/out", f"{folder}/checkpoint")
    return unique.read_marked(t.spark, f"{folder}/out").groupBy("user_id").agg(F.count_if(~F.col("accepted")).alias("rejected"))


@query("STR08", "SELECT CAST(event_id AS BIGINT) AS event_id, user_id IS NULL OR event_id = min(event_id) OVER (PARTITION BY user_id) AS accepted FROM events")
def str08(t):
    """Half of the events come, the stream stops, the others come and it goes on: keys of the first half are still known."""
    folder = scratch(t, "str08")
    rows = t.events.select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"))
    middle = rows.agg((F.min("event_id") + F.max("event_id")) / 2).first()[0]
    for early in (True, False):
        half = rows.where(F.col("event_id") <= middle) if early else rows.where(F.col("event_id") > middle)
        half.write.mode("append").parquet(f"{folder}/in")
        source = stream.files(t.spark, f"{folder}/in", rows.schema, files_per_batch=10_000)
        unique.write_marked(unique.marked(source, ["user_id"], "event_id"), f"{folder}/out", f"{folder}/checkpoint")
    return unique.read_marked(t.spark, f"{folder}/out").select("event_id", "accepted")


@query("STR06", "SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)")
def str06(t):
    folder = scratch(t, "str06")
    source = _event_files(t, folder).select("user_id", "event_type")
    ledger = Ledger(t.spark, f"{folder}/table", ("user_id", "event_type"))
    stream.run_batches(source, ledger.consumer("job-a"), f"{folder}/checkpoint-a")
    stream.run_batches(source, ledger.consumer("job-b"), f"{folder}/checkpoint-b")  # all of it again: nothing is new
    return ledger.rows().agg(F.count("*").alias("n"))


class _Stopped(Ledger):
    """A ledger whose job is killed after the rows are written and before they are committed."""

    def _commit(self, job, number, name, rows, touched):
        raise InterruptedError(name)


@query("STR09", """SELECT o_custkey % 3 AS batch, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1""")
def str09(t):
    """Three batches of orders; each is killed between write and commit, and run again, the second one twice."""
    folder = scratch(t, "str09")
    rows = t.orders.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), (F.col("o_custkey") % 3).alias("batch"))
    ledger, stopped = Ledger(t.spark, folder, ("o_orderkey",)), _Stopped(t.spark, folder, ("o_orderkey",))
    for number, tries in ((0, 1), (1, 2), (2, 1)):
        batch = rows.where(F.col("batch") == number)
        try:
            stopped.write(batch, "job", number)
        except InterruptedError:
            for _ in range(tries):
                ledger.write(batch, "job", number)
    return ledger.rows().groupBy("batch").agg(F.count("*").alias("n"))


def _index(t: Source, name: str, facts, key: tuple[str, ...]) -> KeyIndex:
    """An index of facts in a folder of its own, for as many keys as there are."""
    made = KeyIndex(t.spark, f"{name}_{uuid.uuid4().hex[:12]}", scratch(t, name), key, expected=max(1, facts.count()), buckets=8)
    made.add(facts)
    return made


@query("JON16", """SELECT row_num FROM case_norm n WHERE EXISTS (SELECT 1 FROM fact_codes k WHERE k.unit_code = n.unit_code AND k.box_code = n.box_code
  AND k.doc_date = TRY_CAST(n.doc_date AS DATE) AND k.quantity = TRY_CAST(n.quantity AS INT))""")
def jon16(t):
    """JON08 on an index of the facts' keys: batches by job, the facts are dealt once."""
    index = _index(t, "jon16", staging.resolved_facts(t), staging.KEY)
    rows = staging.accepted(t.stg_case).select(
        "job_id", "row_num", "unit_code", "box_code", dates.two_forms(F.col("doc_date")).alias("doc_date"), F.col("quantity").try_cast("int").alias("quantity")
    )
    one, other = (index.existing(rows.where(F.col("job_id") == job)).select("row_num") for job in ("JOB-1", "JOB-2"))
    return one.unionByName(other)


@query("JON17", "SELECT row_num FROM stg_case WHERE upper(box_code) IN (SELECT code FROM m_box)")
def jon17(t):
    """JON09 on an index that is the union of two, one of active boxes and one of the others."""
    active, others = (_index(t, f"jon17_{n}", t.m_box.where(F.col("is_active") == n), ("code",)) for n in (True, False))
    if active.blocks == others.blocks:
        active.merge(others)
    else:
        active.add(t.m_box.where(~F.col("is_active")))
    return active.existing(t.stg_case.withColumn("code", F.upper("box_code"))).select("row_num")


@query("JON18", """SELECT o_orderkey FROM orders o WHERE o_orderdate >= DATE '1996-01-01'
  AND NOT EXISTS (SELECT 1 FROM orders e WHERE e.o_orderdate < DATE '1996-01-01' AND e.o_custkey = o.o_custkey AND e.o_orderpriority = o.o_orderpriority)""")
def jon18(t):
    """Orders of a customer and priority that no earlier year had: what an index calls fresh."""
    key = ("o_custkey", "o_orderpriority")
    early = F.col("o_orderdate").cast("date") < F.lit("1996-01-01").cast("date")
    index = _index(t, "jon18", t.orders.where(early).select(*key), key)
    return index.fresh(t.orders.where(~early)).select("o_orderkey")
