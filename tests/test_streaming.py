"""Tailing, live merging, alerts and supervision."""

import json


from spanledger.schema import USAGE_SCHEMA, total_tokens
from spanledger.streaming import state, tail
from spanledger.streaming.supervisor import RESTARTS, Supervisor


def run(stream, out, checkpoint, mode="append"):
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", str(checkpoint)).foreachBatch(lambda df, n: df.write.mode("append").json(str(out))).trigger(availableNow=True).start()
    q.awaitTermination()


def test_tail_resumes_and_waits_for_line_ends(spark, tmp_path):
    log, out, mark = tmp_path / "a.jsonl", tmp_path / "out", tmp_path / "mark"
    lines = lambda: sorted(r["line"] for r in spark.read.json(str(out)).collect())
    log.write_text("one\ntwo\nthr")
    run(tail.tail(spark, str(tmp_path / "*.jsonl"), 5), out, mark)
    assert lines() == ["one", "two"]
    log.write_text("one\ntwo\nthree\n")
    (tmp_path / "b.jsonl").write_text("other\n")
    run(tail.tail(spark, str(tmp_path / "*.jsonl"), 5), out, mark)
    assert lines() == ["one", "other", "three", "two"]
    log.write_text("new\n")
    run(tail.tail(spark, str(tmp_path / "*.jsonl"), 5), out, mark)
    assert lines() == ["new", "one", "other", "three", "two"]


def usage_row(seq, event_id, tokens):
    return (seq, event_id, "p", "m", "PAID", "reported", "per_token", 1, tokens, 0, 0, 0, 0, 1.0, None, 5, "s", None, False)


def test_live_usage_supersedes(spark, tmp_path):
    source, updates = tmp_path / "in", tmp_path / "updates"
    source.mkdir()
    rows = spark.readStream.schema(USAGE_SCHEMA).json(str(source))
    for batch in ([usage_row(1, "a", 5), usage_row(2, "b", 5)], [usage_row(3, "a", 9), usage_row(4, "b", 5)]):
        spark.createDataFrame(batch, USAGE_SCHEMA).write.mode("append").json(str(source))
        q = state.live_usage(rows).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(state.write_state(str(updates))).trigger(availableNow=True).start()
        q.awaitTermination()
    got = state.latest_state(spark.read.parquet(str(updates))).select("seq", "event_id", total_tokens().alias("t")).orderBy("seq").collect()
    assert [tuple(r) for r in got] == [(1, "a", 9), (2, "b", 5)]


def test_alerts_are_quiet_for_an_hour(spark, tmp_path):
    source = tmp_path / "alerts"
    source.mkdir()
    stream = state.quiet_alerts(spark.readStream.schema(state.ALERT).json(str(source)))
    times = [(0, "warn"), (600, "warn"), (700, "critical"), (800, "critical"), (4400, "critical"), (4500, "ok"), (4600, "critical")]
    for i, half in enumerate((times[:3], times[3:])):
        (source / f"{i}.json").write_text("\n".join(json.dumps({"scope": "g", "period": "daily", "level": lv, "pct": 1.0, "at": at}) for at, lv in half))
        run(stream, tmp_path / "out", tmp_path / "cp")
    got = spark.read.json(str(tmp_path / "out")).orderBy("at").select("at", "level").collect()
    assert [tuple(r) for r in got] == [(0, "warn"), (700, "critical"), (4400, "critical"), (4600, "critical")]


class Failing:
    isActive = False

    def exception(self):
        return RuntimeError("gone")


def test_supervisor_backs_off_and_gives_up():
    now, starts = [0.0], []
    s = Supervisor(lambda: now[0])
    s.add("a", lambda: starts.append(now[0]) or Failing())
    while now[0] < 300:
        s.poll()
        now[0] += 1
    assert len(starts) == RESTARTS and s.health()[0]["state"] == "dead"
    gaps = [b - a for a, b in zip(starts, starts[1:])]
    assert gaps == sorted(gaps) and gaps[0] >= 2


def test_health_states():
    now = [0.0]
    s = Supervisor(lambda: now[0])

    class Running:
        isActive = True

    s.add("a", Running, 10)
    assert s.health()[0]["state"] == "waiting"
    s.poll()
    s.progressed("a", 3)
    now[0] = 1
    s.progressed("a", 3)
    assert s.health()[0]["state"] == "ok"
    now[0] = 100
    assert s.health()[0] | {"warnings": []} == {"source": "a", "state": "stale", "rows": 6, "failures": 0, "warnings": []}
