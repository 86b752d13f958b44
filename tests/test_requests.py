"""Requests in streams: replaced results, restarts, idle state, and an evaluator that breaks off half-way."""

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tagloom.operators import evaluate
from tagloom.sources import sinks
from tagloom.streaming import events as streams
from tagloom.streaming import requests


def event(kind, request, lens, tag=None, num=None, at="2026-01-01T00:00:00Z"):
    return {"type": kind, "request_id": request, "lens": lens, "tag_id": tag, "primitive": "score", "num": num, "at": at}


def write(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write("\n".join(map(json.dumps, rows)) + "\n")
    at = 1_760_000_000 + int(name.split(".")[0])  # streams read the oldest file first
    os.utime(f"{folder}/{name}", (at, at))


def replay(spark, tmp_path, cache, **options):
    requests.results_into_cache(streams.read_events(spark, str(tmp_path / "in"), 1), cache, str(tmp_path / "cp"), **options).awaitTermination(180)
    return {(r.lens, r.tag_id): r.num for r in cache.load().collect()}


def test_late_results_of_replaced_requests(spark, tmp_path):
    """An old result in a later file, with the latest time, loses; so does one after a restart. Another lens isn't touched."""
    cache = sinks.EvalCache(spark, str(tmp_path / "cache"))
    write(tmp_path / "in", "1.json", [event("start", 1, "kids"), event("result", 1, "kids", "a=b", 1.0), event("result", 1, "kids", "c=d", 1.5), event("result", 5, "quiet", "a=b", 4.0), event("result", None, "kids", "x=y", 1.0), event("result", 1, None, "x=y", 1.0)])
    write(tmp_path / "in", "2.json", [event("result", 2, "kids", "a=b", 2.0, "2026-01-01T00:00:05Z"), event("start", 2, "kids", at="2026-01-01T00:00:05Z"), event("result", 1, "kids", "e=f", 9.0, "2026-01-01T00:00:04Z")])
    write(tmp_path / "in", "3.json", [event("result", 1, "kids", "a=b", 9.0, "2026-01-01T00:00:09Z"), event("result", 1, "quiet", "c=d", 3.0, "2026-01-01T00:00:09Z")])
    want = {("kids", "a=b"): 2.0, ("kids", "c=d"): 1.5, ("quiet", "a=b"): 4.0, ("quiet", "c=d"): 3.0}
    assert replay(spark, tmp_path, cache) == want
    # a second run of the query: what was read stays read, and the state is there
    write(tmp_path / "in", "4.json", [event("result", 1, "kids", "a=b", 9.0, "2026-01-01T00:01:00Z"), event("result", 3, "kids", "g=h", 0.5, "2026-01-01T00:01:00Z")])
    assert replay(spark, tmp_path, cache) == want | {("kids", "g=h"): 0.5}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != requests.ROCKSDB


def test_state_of_an_idle_lens_ends(spark, tmp_path):
    """After its idle time a lens is as new: an old request counts again. One that is still used keeps its state."""
    cache = sinks.EvalCache(spark, str(tmp_path / "cache"))
    day = lambda n: f"2026-01-{n:02}T00:00:00Z"
    files = [
        [event("start", 7, "kids", at=day(1)), event("start", 7, "quiet", at=day(1))],
        [event("result", 7, "quiet", "a=b", 1.0, day(3)), event("start", 7, "quiet", at=day(3))],
        [event("result", 7, "quiet", "b=c", 1.0, day(5)), event("start", 7, "quiet", at=day(5))],
        [event("result", 7, "quiet", "c=d", 1.0, day(5))],
        [event("result", 1, "kids", "old=1", 2.0, day(6)), event("result", 1, "quiet", "old=1", 2.0, day(6))],
    ]
    for i, rows in enumerate(files):
        write(tmp_path / "in", f"{i}.json", rows)
    got = replay(spark, tmp_path, cache, late="2 days", idle_ms=2 * 24 * 3_600_000)
    assert got == {("quiet", "a=b"): 1.0, ("quiet", "b=c"): 1.0, ("quiet", "c=d"): 1.0, ("kids", "old=1"): 2.0}


class Breaking:
    """A client that logs what it is asked and breaks at one request until the file ``fixed`` is there."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, request):
        tags = sorted(request["questions"])
        if any("k11=" in t for t in tags) and not os.path.exists(f"{self.folder}/fixed"):
            raise RuntimeError("broken off")
        kind = next(iter(request["questions"].values()))["type"]
        with open(f"{self.folder}/asked", "a") as f:
            f.write("".join(f"{kind} {t}\n" for t in tags))
        return evaluate.stub_client(request)


def test_a_restart_asks_nothing_twice(spark, tmp_path):
    tags = spark.createDataFrame([(f"k{i}=v", 100 - i) for i in range(20)], "tag_id string, count long")
    ranked = tags.select((100 - F.col("count")).alias("ord"), "tag_id")
    plan = evaluate.plan_batches(ranked, "kids", most=1)
    assert plan.count() == 60
    requests.write_plan(plan, str(tmp_path / "plan"))
    client, out, cp = Breaking(str(tmp_path)), str(tmp_path / "out"), str(tmp_path / "cp")
    run = lambda: requests.evaluate_stream(spark, str(tmp_path / "plan"), "kids", client, out, cp, sleep=lambda s: None).awaitTermination(180)
    with pytest.raises(Exception, match="broken off"):
        run()
    half = evaluate.answered(spark, out)
    done = half.select("tag_id", "primitive").distinct().count()
    assert 0 < done < 60  # answers are there before the rest is asked, the most frequent tags first
    assert {r.tag_id for r in half.where("request < 3").collect()} == {f"k{i}=v" for i in range(8)}
    (tmp_path / "fixed").write_text("")
    run()
    rows = evaluate.answered(spark, out).collect()
    assert Counter((r.primitive, r.tag_id) for r in rows) == Counter((p, f"k{i}=v") for p in ("noul", "score", "choice") for i in range(20))
    asked = Counter((tmp_path / "asked").read_text().splitlines())
    assert set(asked.values()) == {1} and len(asked) == 60
    run()  # nothing is left
    assert len((tmp_path / "asked").read_text().splitlines()) == 60


def test_failures_are_a_table(spark, tmp_path):
    cache = sinks.EvalCache(spark, str(tmp_path / "cache"))
    rows = lambda *r: spark.createDataFrame([("kids", *x) for x in r], "lens string, tag_id string, primitive string, kind string")
    assert cache.failed("kids").count() == 0
    assert cache.put_failed(rows(("a=b", "score", "server"), ("c=d", "noul", "timeout"))) and cache.put_failed(rows(("a=b", "score", "network")))
    assert {(r.tag_id, r.kind) for r in cache.failed("kids").collect()} == {("a=b", "network"), ("c=d", "timeout")} and cache.failed("other").count() == 0
    assert cache.clear_failed("kids") and cache.failed("kids").count() == 0
    assert cache.put_failed(rows(("e=f", "score", "server"))) and [r.tag_id for r in cache.failed("kids").collect()] == ["e=f"]
