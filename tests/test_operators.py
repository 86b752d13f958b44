"""Operators that the SQL comparison doesn't reach, by hand-worked cases."""

import json
import math
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tagloom import model
from tagloom.functions import geo, style, text
from tagloom.operators import analytics, evaluate, lens, profile, tags
from tagloom.plans import queries as plans
from tagloom.sources import poi, sinks
from tagloom.streaming import events as streams


def evals(spark, rows):
    return spark.createDataFrame(rows, "tag_id string, confidence double, score double, choice array<double>")


def lists(spark, *ids):
    return spark.createDataFrame([(i, list(x)) for i, x in enumerate(ids)], "id long, tag_ids array<string>")


def plain_fold(ids, ev):
    """The rules of the fold, one list at a time."""
    known = [ev[t] for t in ids if t in ev]
    conf = [c for c, _, _ in known if c is not None]
    top = max(conf, default=0)
    w = [(c if c is not None else sum(conf) / len(conf)) / top if top > 0 else 1.0 for c, _, _ in known]
    sw = sum(x for x, (_, s, _) in zip(w, known) if s is not None)
    done = sum(s is not None or ch is not None for _, s, ch in known)
    return len(ids), done, sum(x * s for x, (_, s, _) in zip(w, known) if s is not None) / sw if sw else None


def test_fold(spark):
    rows = {"info": (0.69, 3.9, None), "board": (0.2, 1.6, [0.1] * 5), "zero": (0.0, 3.0, None), "half": (0.5, None, None), "bare": (None, 1.0, [1.0, 0.0, 0.0, 0.0, 0.0]), "only": (0.9, None, None)}
    ev = evals(spark, [(k, *v) for k, v in rows.items()])
    cases = [["info", "board"], ["zero", "half"], [], ["unknown"], ["only"], ["bare", "info"], ["zero"], ["bare", "bare", "info"], ["info", "unknown", "board"]]
    got = {r.id: r for r in lens.style_pois(lists(spark, *cases), ev).collect()}
    assert got[0].score == pytest.approx(3.383, abs=1e-3) and got[0].state == "full"
    for i, c in enumerate(cases):
        total, done, score = plain_fold(c, rows)
        assert (got[i].total, got[i].evaluated) == (total, done)
        assert got[i].score == (pytest.approx(score) if score is not None and done else None)
    assert got[1].evaluated == 1 and got[1].score is None and got[1].radius == 3.0  # its weights are all zero
    assert [got[i].state for i in (2, 3, 4, 8)] == ["none", "none", "none", "partial"]
    assert got[0].color != model.UNEVALUATED and got[6].color == model.UNEVALUATED


def test_style_values(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,), (4.0,), (None,)], "s double")
    got = df.select(style.radius_for(F.col("s")).alias("r"), style.opacity_for(F.col("s")).alias("o")).collect()
    assert [r.r for r in got] == [1.5, 2.25, 3.0, 4.5, 6.0, 3.0]
    assert [r.o for r in got] == pytest.approx([0.3, 0.525, 0.9, 0.9, 0.9, 0.75])
    one = lambda *w: spark.range(1).select(style.mix_colour([F.lit(float(x)) for x in w]).alias("c")).first().c
    for i, c in enumerate(model.PALETTE):
        assert one(*[3.0 * (i == k) for k in range(5)]) == c.lower()
    assert one(0, 0, 0, 0, 0) == one(-1, 0, 0, 0, -2) == "#333333" and one(1, 1, 0, 0, 0) == one(2, 2, -1, 0, 0)
    top = spark.range(1).select(style.top_choice(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4), F.lit(0.0), F.lit(0.0))).alias("t")).first().t
    assert (top.name, top.percent) == ("脇役", 40)


def test_tag_ids(spark):
    m = {"amenity": " Cafe ;BAR;; bar", "brand": " A;b ", "cuisine": "　Sushi\t; ", "capacity": "5", "shop": ""}
    df = spark.createDataFrame([(m,), ({},), (None,)], "tags map<string,string>")
    got = [r[0] for r in df.select(text.tag_ids(F.col("tags"))).collect()]
    assert sorted(got[0]) == ["amenity=bar", "amenity=bar", "amenity=cafe", "brand=A;b", "cuisine=sushi"] and got[1:] == [[], None]


def test_brands_count_once(spark):
    df = spark.createDataFrame([({"brand": "A;B ", "amenity": "x;y"}, 0.0, 0.0)], "tags map<string,string>, lon double, lat double")
    got = tags.build_allowlist(df, 1, 1).select("tag_id", "count").collect()
    assert sorted(map(tuple, got)) == [("amenity=x", 1), ("amenity=y", 1), ("brand=A;B", 1)]


def test_geo(spark):
    box = geo.viewport_bbox(139.7, 35.6, 14, 1280, 800)
    assert box[2] - box[0] == pytest.approx(1280 * geo.degrees_per_pixel(14)) and box[1] < 35.6 < box[3]
    assert geo.viewport_bbox(0, 0, 0, 512, 512) == pytest.approx((-180, -85.0511287, 180, 85.0511287))
    levels = [geo.level_resolution(i) for i in range(17)]
    assert [geo.resolve_level(levels, geo.degrees_per_pixel(z)) for z in (0, 1, 10, 14, 30)] == [0, 0, 9, 13, 16]
    assert geo.resolve_level(levels, geo.degrees_per_pixel(14), 1) == 14 and geo.resolve_level(levels, 1e9) == 0 == geo.resolve_level(levels, geo.degrees_per_pixel(1), -1)
    pts = [(1, 139.75, 35.5), (2, -0.5, -89.25), (3, 0.0, 1e-300)]
    df = spark.createDataFrame([(i, geo.point_wkb(x, y)) for i, x, y in pts] + [(4, None)], "i int, g binary")
    got = {r.i: r.p for r in df.select("i", geo.point_of(F.col("g")).alias("p")).collect()}
    assert got[4] is None and all(tuple(got[i]) == pytest.approx((x, y)) for i, x, y in pts)
    r = spark.range(1).select(*[geo.screen_radius(F.lit(3.0), z).alias(f"z{z}") for z in (5, 10, 12, 14, 18, 20)]).first()
    assert list(r) == pytest.approx([1.599, 1.599, 2.2995, 3.0, 5.001, 5.001])


def test_lens_text():
    assert text.normalise_lens("  ｋｉｄｓ   play。. ") == "kids play"
    assert text.utf16_units("a😀") == 3 and evaluate.request_chars({"é": 1}) == 7
    for bad in (("", ["score"]), ("x", ["other"]), ("x", [])):
        with pytest.raises(ValueError):
            evaluate.validate(*bad)


def test_request_in_batches():
    assert evaluate.validate_batches(" kids. ", [{"primitive": "noul", "tags": ["a=b"]}]) == "kids"
    for bad in ([], [{"primitive": "noul", "tags": []}], [{"primitive": "x", "tags": ["a"]}], [{"primitive": "score", "tags": [1]}], [{"primitive": "score", "tags": ["a"]}] * 9, ["x"]):
        with pytest.raises(ValueError):
            evaluate.validate_batches("kids", bad)
    assert set(evaluate.question("a=b", "score", "full")) - set(evaluate.question("a=b", "score")) == {"criteria"}


def test_batches(spark):
    t = spark.createDataFrame([(i, f"amenity=t{i:03d}") for i in range(500)], "ord long, tag_id string")
    got = evaluate.plan_batches(t, "kids", budget=10**9).orderBy("batch").collect()
    assert [(b.primitive, b.first, len(b.tags)) for b in got[:3]] == [("noul", 0, 190), ("score", 0, 190), ("choice", 0, 190)]
    assert [b.first for b in got] == sorted(b.first for b in got) and got[-1].batch == 8 and got[-1].request == 1
    frame = evaluate.request_chars({"model": "", "state": evaluate.state("kids"), "questions": {}})
    one = evaluate.request_chars({"amenity=t000": evaluate.question("amenity=t000", "score")})
    small = evaluate.plan_batches(t, "kids", ["score"], budget=frame + 3 * one).collect()
    assert {len(b.tags) for b in small} == {3, 2} and sum(len(b.tags) for b in small) == 500
    assert all(len(b.tags) == 1 for b in evaluate.plan_batches(t, "kids", ["score"], budget=1).collect())


def test_retry():
    waits, replies = [], iter([(503, {}, {}), (429, {"Retry-After": "2"}, {}), (200, {}, {"answers": {"a": {"score": 1}}, "model": "m"})])
    kind, reply, log = evaluate.call_with_retry(lambda r: next(replies), {}, waits.append, lambda: 0.5)
    assert (kind, reply["answers"], reply["model"]) == ("ok", {"a": {"score": 1}}, "m") and waits == [0.3, 2.0]
    assert [(x["attempt"], x["status"], x["kind"]) for x in log] == [(1, 503, "server"), (2, 429, "rate_limit"), (3, 200, "ok")]
    told = []
    evaluate.call_with_retry(lambda r: (529, {"retry-after": "1"}, {}), {}, told.append, lambda: 1.0)
    assert told == pytest.approx([1.3] * 5)  # a told wait has jitter too
    for status, kind, tries in ((400, "invalid", 1), (408, "invalid", 1), (401, "auth", 1), (200, "invalid", 1), (evaluate.NETWORK, "network", 6), (evaluate.TIMEOUT, "timeout", 6), (529, "overloaded", 6)):
        got = evaluate.call_with_retry(lambda r: (status, {}, {"body": "x" * 400}), {}, waits.append)  # noqa: B023
        assert (got[0], len(got[2]), len(got[2][0]["body"])) == (kind, tries, 301) and got[1] == {}
    now = datetime(2026, 1, 1, tzinfo=timezone.utc)
    assert evaluate.retry_after_ms("Thu, 01 Jan 2026 00:00:05 GMT", now) == 5000 and evaluate.retry_after_ms("-3") == 0
    assert evaluate.retry_after_ms("Wed, 31 Dec 2025 23:00:00 GMT", now) == 0 and evaluate.retry_after_ms("soon") is None is evaluate.retry_after_ms(None)


def test_parse_answer():
    assert evaluate.parse_answer("noul", {"probability": 1}) == (1.0, None) and evaluate.parse_answer("score", {"score": "3"}) is None
    assert evaluate.parse_answer("choice", {"probabilities": {"主役": 0.5, "無関係": math.nan}}) == (None, [0.5, 0, 0, 0, 0])
    assert evaluate.parse_answer("choice", {}) is evaluate.parse_answer("score", None) is evaluate.parse_answer("score", {"score": True}) is None


def test_session_and_cache(spark, tmp_path):
    cache = sinks.EvalCache(spark, str(tmp_path / "cache"))
    cache.clear()
    t = spark.createDataFrame([("amenity=cafe", 5), ("brand=A", 3), ("x" * 11, 1)], "tag_id string, count long")
    session = evaluate.LensSession(cache)
    session.set_lens(" kids。")
    n = session.ensure(t)
    assert n == cache.count("kids") == session.evals().count() * 3 - session.missing(t).join(session.evals(), "tag_id", "left_semi").count() and n > 0
    assert session.ensure(t) == 0 and cache.count("other") == 0
    again = cache.load("kids").where("primitive = 'score'").limit(1).withColumn("num", F.lit(9.0)).withColumn("at", F.col("at") + F.expr("interval 1 day"))
    cache.put(again)
    assert cache.count("kids") == n and cache.load("kids").where("num = 9.0").count() == 1
    assert sinks.EvalCache(spark, str(tmp_path / "cache"), version=3).count() == 0


def test_failed_evaluator(spark):
    t = spark.createDataFrame([(1, "a=b"), (2, "c=d")], "ord long, tag_id string")
    got = evaluate.evaluate(evaluate.plan_batches(t, "kids"), "kids", lambda r: (503, {}, {}), sleep=lambda s: None).collect()
    assert len(got) == 6 and all(r.kind == "server" and r.attempts == 6 and r.num is None for r in got)
    log = evaluate.attempt_log(spark.createDataFrame(got, evaluate.EVENTS)).collect()
    assert len(log) == 18 and {r.status for r in log} == {503} and {r.questions for r in log} == {2}


def test_only_what_is_missing_is_asked(spark):
    """Cached pairs and failed ones are no question; batches of the same tags run together."""
    t = spark.createDataFrame([("a=b", 5), ("c=d", 9), ("e=f", 1)], "tag_id string, count long")
    cache = spark.createDataFrame([("a=b", "noul"), ("c=d", "score")], "tag_id string, primitive string")
    failed = spark.createDataFrame([("e=f", "choice")], "tag_id string, primitive string")
    got = [(r.batch, r.primitive, r.tags) for r in evaluate.planned(t, "kids", cache, failed).orderBy("batch").collect()]
    assert got == [(0, "noul", ["c=d", "e=f"]), (1, "score", ["a=b", "e=f"]), (2, "choice", ["c=d", "a=b"])]
    assert evaluate.planned(t, "kids", cache, failed, ["noul"]).count() == 1


def test_session_keeps_failures_apart(spark, tmp_path):
    cache = sinks.EvalCache(spark, str(tmp_path / "cache"))
    assert cache.count() == 0  # the path isn't there yet
    t = spark.createDataFrame([("amenity=cafe", 5), ("brand=A", 3)], "tag_id string, count long")
    session = evaluate.LensSession(cache, lambda r: (503, {"retry-after": "0"}, {}))
    session.set_lens("kids")
    assert session.ensure(t) == 0 and session.progress["tally"] == {"server": 3} and session.progress["retryable"] == 6 == session.count_retryable(t)
    session.client = evaluate.stub_client
    assert session.ensure(t) == 0 and cache.count() == 0  # failed ones are not asked again by themselves
    token = session.set_lens(" kids。")
    assert token == session.token and session.count_retryable(t) == 6  # the same lens
    n = session.retry(t)
    assert n == cache.count("kids") > 0 and session.count_retryable(t) == 6 - n and not session.progress["running"]
    assert cache.load("kids").where("model = 'stub'").count() == n
    session.set_lens("quiet")
    assert session.evals().count() == 0 and session.count_retryable(t) == 0
    small = cache.compact(str(tmp_path / "compact"))
    assert small.count("kids") == n
    session.clear()
    assert cache.count() == 0
    assert not sinks.EvalCache(spark, "nosuch://x/y").put(cache.spark.createDataFrame([("k", "a=b", "score", 1.0, None, "m", None)], "lens string, tag_id string, primitive string, num double, dist array<double>, model string, at timestamp"))


def test_stream_replay(spark, tmp_path):
    rows = [
        {"type": "start", "request_id": 1, "lens": "kids"},
        {"type": "result", "request_id": 1, "lens": "kids", "tag_id": "a=b", "primitive": "score", "num": 1.0, "at": "2026-01-01T00:00:00Z"},
        {"type": "result", "request_id": 2, "lens": "kids", "tag_id": "a=b", "primitive": "score", "num": 3.0, "at": "2026-01-01T00:00:01Z"},
        {"type": "error", "request_id": 2, "lens": "kids", "kind": "timeout"},
        {"type": "result", "request_id": 2, "lens": "kids", "tag_id": "c=d", "primitive": "choice", "dist": [1, 0, 0, 0, 0], "at": "2026-01-01T00:00:02Z"},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows[:3])) + "\n")
    (tmp_path / "in" / "b.json").write_text("\n".join(map(json.dumps, rows[3:])) + '\n{"type": "res')
    cache = sinks.EvalCache(spark, str(tmp_path / "cache"))
    streams.replay_into_cache(streams.read_events(spark, str(tmp_path / "in"), 1), cache, str(tmp_path / "cp")).awaitTermination(120)
    assert {(r.tag_id, r.num) for r in cache.load("kids").collect()} == {("a=b", 3.0), ("c=d", None)}
    sinks.stream_json(streams.read_events(spark, str(tmp_path / "in"), 1), str(tmp_path / "log"), str(tmp_path / "cp2")).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "log")).count() == 5
    batch = spark.read.schema(streams.EVENT_SCHEMA).json(str(tmp_path / "in")).where("type is not null")
    assert streams.current(batch).where("type = 'result'").count() == 2
    assert [tuple(r) for r in streams.failure_tally(batch).collect()] == [("timeout", 1)]


def test_windowed_stream(spark, tmp_path):
    src = spark.read.parquet(f"{plans_dir()}/events.parquet").select("ts", "event_type", "value")
    src.coalesce(2).write.parquet(str(tmp_path / "ev"))
    q = streams.windowed(spark.readStream.schema(src.schema).parquet(str(tmp_path / "ev")), size="1 hour").writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("win").collect())) == sorted(map(tuple, streams.windowed(src, size="1 hour").collect()))


def plans_dir():
    return "/root/testdata/sf0.001"


def test_tiered_file(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 100
    t = pa.table({"id": list(range(n)), "bbox": [{"xmin": float(i), "ymin": 0.0, "xmax": float(i), "ymax": 0.0} for i in range(n)]})
    meta = {b"geo": json.dumps({"lod": {"levels": [{"resolution": 1.0, "row_group_end": 0}, {"resolution": 0.5, "row_group_end": 3}, {"resolution": 0.1, "row_group_end": 9}]}}).encode()}
    path = str(tmp_path / "t.parquet")
    pq.write_table(t.replace_schema_metadata(meta), path, row_group_size=10)
    geo_meta, groups = poi.footer(path)
    assert poi.level_ends(geo_meta, groups) == [10, 40, 100]
    got = poi.read_tiered(spark, path).groupBy("lod_level").count().collect()
    assert sorted(map(tuple, got)) == [(0, 10), (1, 30), (2, 60)]
    (tmp_path / "slim.json").write_text('{"roles": {"amenity": "category"}, "entries": ["amenity=cafe"]}')
    p, roles, ids, levels = poi.open_sources(spark, path, str(tmp_path / "slim.json"))
    assert p.count() == n and roles.count() == ids.count() == 1 and [x["row_group_end"] for x in levels] == [0, 3, 9]
    assert poi.open_sources(spark, path, str(tmp_path / "none.json"))[2].count() == 0
    poi.ingest_tiered(spark, path, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == n and back.where("lod_level <= 1").count() == 40
    bytes_ = {r.column: r.bytes for r in plans.viewport.row_group_bytes(spark.createDataFrame(groups), (15.0, -1.0, 24.0, 1.0)).collect()}
    assert bytes_["id"] == sum(g["bytes"] for g in groups if g["column"] == "id" and g["row_group"] in (1, 2))


def test_scan_is_pruned(spark, tmp_path):
    plans.pois(spark, plans_dir()).select("id", "tags", "bbox", "lod_level").write.partitionBy("lod_level").parquet(str(tmp_path / "p"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    df = plans.viewport.inside(spark.read.parquet(str(tmp_path / "p")).select("bbox", "lod_level"), plans.VIEW)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(bbox.xmax" in plan and "PartitionFilters: [isnotnull(lod_level" in plan and "tags" not in plan


def test_documents(spark, tmp_path):
    fs = [json.loads(r.feature) for r in plans.QUERIES["geojson_features"](spark, plans_dir()).collect()]
    assert all(f["type"] == "Feature" and isinstance(json.loads(f["properties"]["tags"]), dict) for f in fs)
    whole = json.loads(sinks.feature_collection(tags.with_tag_ids(plans.pois(spark, plans_dir()).where("id < 0"))).first().document)
    assert whole["type"] == "FeatureCollection" and {f["properties"]["name"] for f in whole["features"]} >= {"one", "two", ""}
    full = json.loads(sinks.full_allowlist(spark.createDataFrame(list(model.ROLES.items()), "key string, role string"), plans.allow(spark, plans_dir()), 100, 20).first().document)
    counts = [e["count"] for e in full["entries"]]
    assert full["pairs"] == len(counts) and counts == sorted(counts, reverse=True) and full["min_count"] == 100
    big = sinks.features(tags.with_tag_ids(plans.pois(spark, plans_dir()).where("id > 9007199254740991"))).first()
    assert json.loads(big.feature)["id"] == "9007199254740993"
    doc = plans.QUERIES["allowlist_slim"](spark, plans_dir()).first().document
    (tmp_path / "slim.json").write_text(doc)
    roles, ids = poi.read_allowlist(spark, str(tmp_path / "slim.json"))
    assert roles.count() == len(model.ROLES) and ids.count() == plans.allow(spark, plans_dir()).count()
    sinks.write_csv(profile.tags_per_row(plans.pois(spark, plans_dir())), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["ntags", "rows"]
    sinks.append_json(roles, str(tmp_path / "log"))
    sinks.append_json(roles, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2 * len(model.ROLES)


def test_invariants(spark):
    p = plans.pois(spark, plans_dir())
    n = p.count()
    total = lambda df, c="rows": df.agg(F.sum(c)).first()[0]
    assert total(profile.tags_per_row(p)) == total(profile.geo_grid(p)) == total(profile.levels(p)) == total(profile.primary_key_count(p)) == n
    assert profile.tags_per_row(p).agg(F.sum(F.col("ntags") * F.col("rows"))).first()[0] == profile.pairs(p).count()
    c = profile.pair_counts(profile.pair_levels(p))
    b = profile.reuse_buckets(c)
    assert total(b, "occurrences") == total(c, "n") and total(b, "pairs") == c.count()
    cov = [r.coverage for r in profile.coverage_curve(c).orderBy("top_n_pairs").collect()]
    assert cov == sorted(cov)


def test_analytics(spark):
    assert analytics.lcg(1, 1) == [1103527590] and len(set(analytics.lcg(100))) == 100
    df = spark.createDataFrame([(1, 5.0), (1, 1.0), (1, 3.0), (1, 2.0), (2, None)], "g int, x double")
    assert [tuple(r) for r in analytics.index_quantiles(df, "g", "x").collect()] == [(1, 4, 3.0, 5.0)]
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0), (None, 9.0)], "a double, b double")
    assert flat.agg(analytics.pearson("a", "b")).first()[0] is None
    mixed = spark.range(1).select(analytics.pair_mix(F.lit(4.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)), analytics.pair_mix(F.lit(4.0), F.lit(0.0), F.lit(0.3), F.lit(0.1))).first()
    assert list(mixed) == pytest.approx([2.0, 3.0])
