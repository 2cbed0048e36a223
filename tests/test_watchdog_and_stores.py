"""The dead-source alarm as stream and batch, and stores that delete, fold and read anew."""

import datetime as dt
import random

import pytest

from marlstone.sources import files
from marlstone.streaming import events, watchdog
from pyspark.sql import functions as F

START = dt.datetime(2026, 1, 1)


def at(ms):
    return START + dt.timedelta(milliseconds=ms)


def plain(samples, end):
    """Changes of state by looking at every tenth of a second's change points in order."""
    out = []
    for source in {s for s, _, _ in samples}:
        rows = {}
        for s, t, v in samples:
            if s == source:
                rows[t] = rows.get(t, False) or bool(v)
        times = sorted(rows)
        points = sorted({x for t in times for x in (t, t + 3000)} | {t + 3000 for t in times})
        state, signal, data = "alive", None, None
        for p in points:
            if p > end:
                break
            if p in rows:
                data, signal = p, p if rows[p] or signal is None else signal
                now = "only zeros" if p - signal >= 3000 else "alive"
            else:
                now = "no data" if p - data >= 3000 else "only zeros" if p - signal >= 3000 else "alive"
            if now != state:
                out.append((source, at(p), now))
                state = now
    return sorted(out)


def samples(seed):
    rng = random.Random(seed)
    rows = []
    for source in "abc":
        t = rng.randrange(500)
        for _ in range(60):
            t += rng.choice([100, 400, 900, 1500, 3000, 3500, 8000])
            rows.append((source, t, rng.choice([0.0, 0.0, 0.0, 1.0, None])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_tells_both_causes(spark, seed):
    rows = samples(seed)
    df = spark.createDataFrame([(s, at(t), v) for s, t, v in rows] + [("a", None, 1.0), (None, at(5), 1.0)], "source string, ts timestamp, value double")
    got = sorted(tuple(r) for r in watchdog.changes(df).collect())
    want = plain(rows, 10**9)
    assert got == want and {x[2] for x in want} == {"alive", "no data", "only zeros"}


def test_stream_equals_batch(spark, tmp_path):
    rows = samples(3)
    rng, order = random.Random(1), sorted(rows, key=lambda r: r[1])
    folder = tmp_path / "in"
    last = max(t for _, t, _ in rows)
    parts = [order[: len(order) // 2], order[len(order) // 2 :], [("z", last + 60_000, 1.0)], [("z", last + 61_000, 1.0)]]
    for part in parts:
        rng.shuffle(part)
        spark.createDataFrame([(s, at(t), v) for s, t, v in part], "source string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(str(folder))
    for k, v in watchdog.STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema("source string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(folder))
        q = watchdog.watch(stream).writeStream.format("memory").queryName("watch").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k in watchdog.STATE_STORE:
            spark.conf.unset(k)
    got = sorted(tuple(r) for r in spark.table("watch").collect() if r["source"] != "z")
    want = plain(rows, last + 50_000)
    assert got == want == sorted(tuple(r) for r in watchdog.changes(spark.createDataFrame([(s, at(t), v) for s, t, v in rows], "source string, ts timestamp, value double")).collect())


def test_latest_table_folds_and_replays(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(30), rng.choice(["x", "y"]), START + dt.timedelta(seconds=i), i, float(i), rng.random() < 0.2) for i in range(300)]
    schema = "user_id long, event_type string, ts timestamp, event_id long, value double, deleted boolean"
    t = events.LatestTable(spark, str(tmp_path / "latest"))
    assert t.rows() is None and t.fold() == 0

    def want(n):
        newest = {}
        for r in rows[:n]:
            newest[r[:2]] = r
        return {r[:5] for r in newest.values() if not r[5]}

    for i in range(6):
        t.append(spark.createDataFrame(rows[i * 50 : (i + 1) * 50], schema), i)
        assert {tuple(r) for r in t.rows().collect()} == want((i + 1) * 50)
        if i == 3:
            assert t.fold() == 4 and {tuple(r) for r in t.rows().collect()} == want(200)
            t.append(spark.createDataFrame(rows[50:100], schema), 1)  # a batch that is delivered again
            assert {tuple(r) for r in t.rows().collect()} == want(200)
    assert t.fold() == 3 and t.fold() == 0 and {tuple(r) for r in t.rows().collect()} == want(300)


def test_stream_into_latest_table(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value", (F.col("value") < 5).alias("deleted"))
    for part in e.randomSplit([1.0, 1.0, 1.0], 7):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    t = events.LatestTable(spark, str(tmp_path / "latest"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    t.follow(stream, str(tmp_path / "cp"), every=2).start().awaitTermination()
    newest = e.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "deleted"), F.struct("ts", "event_id")).alias("r")).where("not r.deleted")
    assert {r["event_id"] for r in t.rows().collect()} == {r["r"]["event_id"] for r in newest.collect()}


def test_delete_and_reindex(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for name, text in (("a b.txt", "one\n\ntwo"), ("c.md", "three"), ("d.txt", "four")):
        (tmp_path / "docs" / name).write_text(text)
    store = str(tmp_path / "store")
    from marlstone.operators import chunking

    read = files.texts(spark, str(tmp_path / "docs"))
    cut = chunking.chunk_documents(read, "file_name", "content").join(read.select("file_name", "file_hash"), "file_name").withColumn("lesson_index", F.lit(None).cast("int")).withColumn("id", F.lit(""))
    files.write_chunks(files.chunk_ids(cut).select(*(c.split()[0] for c in files.CHUNK.split(", "))), store)
    held = lambda: {r["file_name"].rsplit("/", 1)[1]: r["content"] for r in spark.read.parquet(store).collect()}
    assert set(held()) == {"a b.txt", "c.md", "d.txt"}
    name = next(r["file_name"] for r in spark.read.parquet(store).collect() if r["file_name"].endswith("a b.txt"))
    assert files.delete_files(spark, store, [name, "nothing"]) == 1 and files.delete_files(spark, store, [name]) == 0
    assert set(held()) == {"c.md", "d.txt"}
    (tmp_path / "docs" / "c.md").write_text("changed")
    (tmp_path / "docs" / "d.txt").unlink()
    got = {r["name"]: r["action"] for r in files.reindex(spark, store, ["c.md", "d.txt", "e.txt"]).collect()}
    assert got == {"c.md": "stored", "d.txt": "gone", "e.txt": "unknown"} and held() == {"c.md": "changed", "d.txt": "four"}
