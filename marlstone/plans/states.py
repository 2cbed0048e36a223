"""Queues and state machines as pure functions of their tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lift
from ..session import table
from .registry import query

NOW = "1998-06-01 00:00:00"
_Q = f"""SELECT o_orderkey AS id, o_custkey AS owner, o_orderdate AS created, CASE o_orderstatus WHEN 'O' THEN 'offen' WHEN 'P' THEN 'laeuft' ELSE 'fertig' END AS state FROM orders"""


@query(f"""WITH q AS ({_Q}), r AS (SELECT *, CASE WHEN state = 'laeuft' AND created < TIMESTAMP '{NOW}' - INTERVAL 30 MINUTE THEN 'offen' ELSE state END AS s FROM q),
n AS (SELECT *, row_number() OVER (PARTITION BY owner, s ORDER BY created, id) AS k FROM r)
SELECT id, CASE WHEN s = 'offen' AND k = 1 THEN 'laeuft' ELSE s END AS state, s <> state AS released, s = 'offen' AND k = 1 AS claimed FROM n""")
def oldest_open_claim(spark, sf_dir):
    """Stale work is released, then every owner's oldest open work is claimed."""
    state = F.when(F.col("o_orderstatus") == "O", "offen").when(F.col("o_orderstatus") == "P", "laeuft").otherwise("fertig")
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("created"), state.alias("was"))
    stale = (F.col("was") == "laeuft") & (F.col("created") < F.lit(NOW).cast("timestamp_ntz") - F.expr("INTERVAL 30 MINUTES"))
    r = q.withColumn("s", F.when(stale, "offen").otherwise(F.col("was")))
    first = (F.col("s") == "offen") & (F.row_number().over(Window.partitionBy("owner", "s").orderBy("created", "id")) == 1)
    r = r.withColumn("claimed", first)
    return r.select("id", F.when(F.col("claimed"), "laeuft").otherwise(F.col("s")).alias("state"), (F.col("s") != F.col("was")).alias("released"), "claimed")


@query(f"""WITH q AS ({_Q}), r AS (SELECT owner, id, row_number() OVER (PARTITION BY owner ORDER BY created, id) AS a, row_number() OVER (PARTITION BY owner ORDER BY created DESC, id DESC) AS z FROM q WHERE state = 'offen')
SELECT owner, max(CASE WHEN a = 1 THEN id END) AS oldest_open, max(CASE WHEN z = 1 THEN id END) AS newest_open, count(*) AS n FROM r GROUP BY owner""")
def open_work(spark, sf_dir):
    """Oldest and newest open work of owners, both named; ties go by id."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("owner")).agg(
        F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("oldest_open"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest_open"), F.count("*").alias("n")
    )


def lift_samples(events):
    """Events of a user as a lift's samples: the kind of event is the command."""
    kind, up = F.col("event_type"), F.col("value") > 50
    return events.select(
        F.col("user_id").alias("lift"), "ts", F.col("event_id").alias("seq"), up.alias("up"), (~up & (F.col("value") > 20)).alias("down"),
        kind.isin("click", "login").alias("open"), kind.isin("view", "logout").alias("close"),
    )


@query()
def lift_replay(spark, sf_dir):
    """Heights, doors and sensors of every lift."""
    return lift.replay(lift_samples(table(spark, sf_dir, "events")))


_CODES = ", ".join(f"({k}, '{v}')" for k, v in lift.STATE_NAMES.items())


@query(f"SELECT event_id, coalesce(n.name, 'State' || (event_id % 100)::VARCHAR) AS state FROM events LEFT JOIN (VALUES {_CODES}) n(code, name) ON n.code = event_id % 100")
def state_names(spark, sf_dir):
    """Q13: codes to names, all eleven, others by number."""
    names = F.create_map(*(F.lit(x) for kv in lift.STATE_NAMES.items() for x in kv))
    code = (F.col("event_id") % 100).cast("int")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(names, code), F.concat(F.lit("State"), code.cast("string"))).alias("state"))
