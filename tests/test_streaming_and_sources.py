"""Streams give their batch rows; readers parse their shapes."""

import datetime as dt
import json

from marlstone.operators import lift
from marlstone.plans.states import lift_samples
from marlstone.sources import files
from marlstone.streaming import events
from pyspark.sql import functions as F


def drain(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def parts(spark, data, tmp_path):
    folder = tmp_path / "events"
    e = spark.read.parquet(f"{data}/events.parquet").withColumn("_p", F.ntile(3).over(__import__("pyspark").sql.Window.orderBy("ts")))
    for i in (1, 2, 3):
        e.where(F.col("_p") == i).drop("_p").coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder), e.drop("_p")


def test_streams_equal_batches(spark, data, tmp_path):
    folder, e = parts(spark, data, tmp_path)
    stream = events.event_stream(spark, folder, 10)
    batch = e.withColumn("ts", F.col("ts").cast("timestamp"))
    hourly = {tuple(r) for r in drain(events.hourly_usage(stream), "hourly", tmp_path, "complete").collect()}
    assert hourly == {tuple(r) for r in events.hourly_usage(batch).collect()}
    end = batch.agg(F.max("ts")).first()[0] - dt.timedelta(hours=3)
    closed = {tuple(r) for r in drain(events.sessions(stream), "closed", tmp_path).collect()}
    every = {tuple(r) for r in events.sessions(batch).collect()}
    assert closed <= every and {r for r in every if r[2] < end} <= closed
    twice = stream.unionByName(events.event_stream(spark, folder, 10))
    assert drain(events.unseen(twice), "unseen", tmp_path).count() == e.count()
    states = {(r["lift"], r["seq"]): (round(r["height"], 6), round(r["door"], 6)) for r in drain(events.lift_states(lift_samples(stream)), "lifts", tmp_path).collect()}
    want = {(r["lift"], r["seq"]): (round(r["height"], 6), round(r["door"], 6)) for r in lift.replay(lift_samples(e)).collect()}
    assert states == want


def test_upserts(spark, data, tmp_path):
    folder, e = parts(spark, data, tmp_path)
    events.upsert_latest(events.event_stream(spark, folder, 1), str(tmp_path / "log"), str(tmp_path / "cp")).start().awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log"))
    got = {(r["user_id"], r["event_type"]): r["e"] for r in log.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e")).collect()}
    want = {(r["user_id"], r["event_type"]): r["e"] for r in e.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e")).collect()}
    assert got == want


def test_readers(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"course": "C", "module": " ", "url": "u", "note": None, "transcript": "T"}]))
    r = files.lessons(spark, str(tmp_path / "l.json")).first()
    assert r["content"] == "# C\n\n## Unknown module\n\nT" and r["corrupt"] is None
    (tmp_path / "bad.json").write_text("{broken")
    assert files.lessons(spark, str(tmp_path / "bad.json")).first()["corrupt"] is not None
    (tmp_path / "app.log").write_text("2026-01-02 03:04:05 ERROR [main] failed\nTraceback\n  line\n2026-01-02 03:04:06 INFO [w-1] fine\n")
    got = files.log_lines(spark, str(tmp_path / "app.log")).orderBy("seq").collect()
    assert [(g["level"], g["thread"], g["message"]) for g in got] == [("ERROR", "main", "failed\nTraceback\n  line"), ("INFO", "w-1", "fine")]
    shows = [{"artist": "A", "eventDate": "05-02-2026", "sets": {"set": [{"song": [{"name": "x"}, {"name": "y", "cover": {"name": "B"}}]}, {"encore": 1, "song": [{"name": "z"}]}]}}, {"artist": "A", "eventDate": "bad", "sets": {"set": []}}]
    (tmp_path / "s.json").write_text("\n".join(map(json.dumps, shows)))
    got = files.setlists(spark, str(tmp_path / "s.json")).collect()
    assert [(g["song"], g["place"], g["encore"], g["cover"]) for g in got if g["song"]] == [("x", 1, False, False), ("y", 2, False, True), ("z", 1, True, False)]
    assert {str(g["day"]) for g in got} == {"2026-02-05", "None"}
    (tmp_path / "a.md").write_text("# hi")
    (tmp_path / "b.exe").write_text("no")
    t = files.texts(spark, str(tmp_path / "*.*"))
    assert [r["content"] for r in t.collect()] == ["# hi"]
    chunks = files.chunk_ids(spark.createDataFrame([("f", "h", None, 0, None, "c"), ("f", "h", 1, 0, None, "c")], files.CHUNK.split(", ", 1)[1]))
    assert chunks.select("id").distinct().count() == 2
    files.write_chunks(chunks, str(tmp_path / "store"))
    files.write_chunks(chunks.limit(1), str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 1
    assert files.without_known(chunks, chunks).count() == 0
