"""The limiter with timers against a plain one."""

import json
import os
import random
import uuid

import pytest


def plain(rows, seconds, most_requests, most_tokens):
    out, seen = {}, {}
    for t, n, i, key in sorted((t, n, i, key) for i, t, key, n in rows):
        mine = seen.setdefault(key, [])
        inside = [x for x in mine if t - x[0] <= seconds]
        wait = seconds - (t - inside[-most_requests][0]) if len(inside) >= most_requests else 0
        used = n
        for s, m in reversed(inside):
            used += m
            if used >= most_tokens:
                wait = max(wait, seconds - (t - s))
                break
        out[i] = wait
        mine.append((t, n))
    return out


@pytest.fixture
def provider(spark):
    from quarry.streaming.limiter import PROVIDER

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    yield
    spark.conf.set(name, before)


def test_order_across_batches_and_state_that_goes_away(spark, provider, tmp_path):
    from pyspark.sql import functions as F

    from quarry.streaming.limiter import limited_in_order

    rng = random.Random(3)
    start = 1_700_000_000
    rows = [(i, start + rng.randrange(0, 3000), rng.randrange(3), rng.randrange(1, 60)) for i in range(120)]
    rows += [(200 + k, start + 9000 + k, 9, 1) for k in range(3)] + [(300, start + 50_000, 7, 1)]  # the last two move the watermark on
    batches = [sorted(rows[:120:2]), sorted(rows[1:120:2]), rows[120:123], rows[123:]]  # the second's times lie among the first's
    os.makedirs(tmp_path / "in")
    for k, some in enumerate(batches):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"i": i, "s": s, "u": u, "n": n}) for i, s, u, n in some))
        os.utime(tmp_path / "in" / f"{k}.json", (start + k, start + k))
    stream = spark.readStream.schema("i long, s long, u long, n long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    found = limited_in_order(stream.withColumn("ts", F.timestamp_seconds("s")), "ts", "u", "i", "n", 120, 4, 150, "2 hours")
    name = f"q{uuid.uuid4().hex}"
    run = found.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "log")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r["id"]: r["wait"] for r in spark.table(name).collect()}
    want = plain(rows[:123], 120, 4, 150)
    assert got == pytest.approx(want)
    assert any(want.values()) and not all(want.values())
    left = [p for p in run.recentProgress if p["stateOperators"]][-1]["stateOperators"][0]
    waiting = spark.read.format("statestore").option("stateVarName", "recent").load(str(tmp_path / "log"))
    assert waiting.count() == 0 and left["numRowsTotal"] < 10
