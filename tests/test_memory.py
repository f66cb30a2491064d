import datetime
import random

from pyspark.sql import functions as F

from stagehand.streaming import memory

T0 = datetime.datetime(2026, 9, 1, tzinfo=datetime.UTC)


def judge(row):
    return f"{row.kind}!"


def rows(n=400, seed=4):
    rng = random.Random(seed)
    return [(i, rng.randrange(9), T0 + datetime.timedelta(minutes=rng.randrange(3000)), rng.choice("abc")) for i in range(n)]


def plain(data, ttl):
    seen, out = {}, []
    for i, user, ts, kind in sorted(data, key=lambda r: (r[2], r[0])):
        verdict, last = seen.get(user, (None, None))
        judged = last is None or (ts - last).total_seconds() > ttl
        verdict = f"{kind}!" if judged else verdict
        seen[user] = (verdict, ts)
        out.append((user, i, memory_us(ts), verdict, judged))
    return sorted(out), seen


def memory_us(ts):
    return (ts - datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)) // datetime.timedelta(microseconds=1)


def test_stream_equals_batch_and_forgets(spark, tmp_path):
    data, ttl = rows(), 7200
    data += [(1000, 99, T0, "a"), (1001, 99, T0 + datetime.timedelta(hours=40), "b")]
    table = spark.createDataFrame(data, "id bigint, user bigint, ts timestamp, kind string")
    want, seen = plain(data, ttl)
    batch = memory.remembered_batch(table, ["user"], "ts", "id", F.concat("kind", F.lit("!")), ttl)
    assert sorted(tuple(r) for r in batch.collect()) == want
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    stream = memory.remembered(memory.replay(table, "ts", str(tmp_path / "in"), 5), ["user"], "ts", "id", judge, ttl)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination(300)
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == want
    end = max(r[2] for r in data)
    kept = {r["key"][0]: r["verdict"] for r in memory.held(spark, mark).collect()}
    fresh = {u: v for u, (v, ts) in seen.items() if ts >= end - datetime.timedelta(seconds=ttl)}
    assert kept == fresh and len(fresh) < len(seen)


def test_empty_table(spark):
    none = spark.createDataFrame([], "id bigint, user bigint, ts timestamp, kind string")
    assert memory.remembered_batch(none, ["user"], "ts", "id", F.col("kind"), 60).collect() == []
