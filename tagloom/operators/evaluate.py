"""Tag evaluation: missing work, request batches, the evaluator, and merging of answers."""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise_lens, utf16_units
from ..model import BACKOFF_MS, BUDGET_CHARS, CHOICES, MAX_ATTEMPTS, MAX_BATCHES, MAX_QUESTIONS, PRIMITIVES, RETRYABLE
from .distribute import cut, global_rank

# The text of requests is configuration.
QUESTIONS = {
    "noul": "Does the tag {tag} alone settle how a place looks through the lens?",
    "score": "From 0 (sink) over 2 (no change) to 4 (raise): how should {tag} be treated through the lens?",
    "choice": "Through the lens, is {tag} main, support, background, hindrance or unrelated?",
}


#: What the full form of a question adds to the slim one; configuration like the texts themselves.
CRITERIA = {
    "noul": {"true": "the tag alone is enough", "false": "it depends on what else the place is"},
    "score": {str(i): text for i, text in enumerate(("runs against the lens", "rather against it", "no matter", "rather along with it", "what the lens looks for"))},
    "choice": dict.fromkeys(CHOICES, "as the name says"),
}


def state(lens: str) -> dict:
    return {"lens": lens, "task": "judge tags of places"}


def question(tag: str, primitive: str, form: str = "slim") -> dict:
    """A tag's question; the ``full`` form also spells out the criteria of each answer."""
    q = {"type": primitive, "text": QUESTIONS[primitive].format(tag=tag)}
    if primitive == "choice":
        q["options"] = list(CHOICES)
    return q | {"criteria": CRITERIA[primitive]} if form == "full" else q


def request_chars(value) -> int:
    """UTF-16 units of compact JSON."""
    return utf16_units(json.dumps(value, ensure_ascii=False, separators=(",", ":")))


def validate(lens: str, primitives, tags=None) -> str:
    """The normalised lens; raises ValueError for a blank lens, unknown primitives or tags that aren't text."""
    lens = normalise_lens(lens)
    if not lens:
        raise ValueError("the lens is blank")
    if not primitives or set(primitives) - set(PRIMITIVES):
        raise ValueError(f"primitives must be some of {PRIMITIVES}")
    if tags is not None and not all(isinstance(t, str) for t in tags):
        raise ValueError("tags must be text")
    return lens


def validate_batches(lens: str, batches: list[dict]) -> str:
    """The normalised lens of a request in batches; raises ValueError unless there are 1 to ``MAX_BATCHES``, each of one known primitive and of tags."""
    if not isinstance(batches, list) or not 0 < len(batches) <= MAX_BATCHES:
        raise ValueError(f"a request has 1 to {MAX_BATCHES} batches")
    for b in batches:
        if not isinstance(b, dict) or not isinstance(b.get("tags"), list) or not b["tags"]:
            raise ValueError("a batch has a primitive and tags")
        lens = validate(lens, [b.get("primitive")], b["tags"])
    return lens


def missing(tags: DataFrame, cache: DataFrame, failed: DataFrame | None = None, primitives=PRIMITIVES) -> DataFrame:
    """``tag_id, primitive`` without a value in ``cache``; those in ``failed`` are left out until they are retried."""
    want = tags.select("tag_id").distinct().select("tag_id", F.explode(F.array(*map(F.lit, primitives))).alias("primitive"))
    want = want.join(cache.select("tag_id", "primitive"), ["tag_id", "primitive"], "left_anti")
    return want if failed is None else want.join(failed.select("tag_id", "primitive"), ["tag_id", "primitive"], "left_anti")


def unanswered(requested: DataFrame, answered: DataFrame) -> DataFrame:
    """What was asked and not answered."""
    return requested.select("primitive", "tag_id").distinct().join(answered.select("primitive", "tag_id"), ["primitive", "tag_id"], "left_anti")


def hydrate(memory: DataFrame, stored: DataFrame) -> DataFrame:
    """Both sides by tag; where both have a field, memory wins."""
    m, s = memory.alias("m"), stored.alias("s")
    pick = lambda c: F.coalesce(F.col(f"m.{c}"), F.col(f"s.{c}")).alias(c)
    return m.join(s, F.col("m.tag_id") == F.col("s.tag_id"), "full_outer").select(*map(pick, ("tag_id", "confidence", "score", "choice")))


def tag_chars(tag: Column) -> Column:
    """UTF-16 units of a tag inside JSON text, without its quotes."""
    beyond = F.regexp_count(tag, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return F.length(F.to_json(F.struct(tag.alias("t")))) - len('{"t":""}') + beyond


def question_chars(tag: Column, primitive: Column, form: str = "slim", primitives=PRIMITIVES) -> Column:
    """UTF-16 units of ``{tag: question}`` in compact JSON, where the tag stands twice."""
    bare = F.create_map(*[x for p in primitives for x in (F.lit(p), F.lit(request_chars({"": question("", p, form)})))])
    return F.element_at(bare, primitive) + 2 * tag_chars(tag)


#: Tags of a block of the plan; at least as many as a request has questions.
PLAN_BLOCK = 4096


def plan_batches(tags: DataFrame, lens: str, primitives=PRIMITIVES, budget: int = BUDGET_CHARS, most: int = MAX_QUESTIONS) -> DataFrame:
    """``batch, request, primitive, first, tags``: tags (``ord, tag_id``) cut into requests by size.

    With a column ``primitive`` only those pairs are asked; without it every tag is asked for all
    ``primitives``. A request starts at the size of its frame and closes when the next question
    would pass the budget or the number of questions; a question larger than the budget goes alone.
    Primitives that ask for the same tags run together, in the order of their batches' first tags,
    so that frequent tags are complete first; ``MAX_BATCHES`` batches share a request group.

    Where a request ends depends on where it starts, so on all tags before it. Tags are ranked globally and dealt to
    blocks of ``PLAN_BLOCK``, each with the first ``most`` tags of the next. In a block sums of sizes give every tag the end of a request that would start there,
    and so, for each tag at which the first request of the block may start, the tag of the next block at which its first one starts.
    These maps of ``most`` numbers are composed over the blocks, in rounds over blocks twice as far apart each time; then each block
    knows its first request and cuts the others.
    """
    frame = request_chars({"model": "", "state": state(lens), "questions": {}})
    size = max(PLAN_BLOCK, most)
    each = tags.select("ord", "tag_id", "primitive" if "primitive" in tags.columns else F.explode(F.array(*map(F.lit, primitives))).alias("primitive"))
    place = (F.array_position(F.array(*map(F.lit, primitives)), F.col("primitive")) - 1).cast("int")
    each = each.select(place.alias("place"), "ord", "tag_id", question_chars(F.col("tag_id"), F.col("primitive"), primitives=primitives).cast("long").alias("chars"))
    ranked = cut(global_rank(each, F.col("place"), F.col("ord"), F.col("tag_id")))
    starts = {r["place"]: r["start"] for r in ranked.groupBy("place").agg(F.min("rank").alias("start")).collect()}  # a row for each primitive
    pos = F.col("rank") - F.element_at(F.create_map(*[F.lit(x) for kv in (starts or {0: 0}).items() for x in kv]), F.col("place"))
    ranked = ranked.select("place", pos.alias("pos"), "tag_id", "chars")
    digest = [F.sum(F.xxhash64(F.lit(seed), "pos", "tag_id").cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)]
    lists = {r["place"]: (r["n"], r["h1"], r["h2"]) for r in ranked.groupBy("place").agg(F.count("*").alias("n"), *digest).collect()}
    group = {p: min(q for q in lists if lists[q] == lists[p]) for p in lists}

    block = F.floor(F.col("pos") / size)
    before = F.when((F.col("pos") % size < most) & (block > 0), block - 1)
    rows = ranked.select("place", F.explode(F.array_compact(F.array(block.cast("long"), before.cast("long")))).alias("block"), "pos", "tag_id", "chars")

    def ends(f: pd.DataFrame):
        """Sorted rows, how many are the block's own, and where a request that starts at each of them ends."""
        f = f.sort_values("pos")
        own = int((f["pos"] // size == f["block"].iloc[0]).sum())
        upto = f["chars"].cumsum().to_numpy()
        i = np.arange(own)
        end = np.searchsorted(upto, upto[:own] - f["chars"].to_numpy()[:own] + budget - frame, side="right")
        return f, own, np.maximum(i + 1, np.minimum(end, i + most))

    def exits(f: pd.DataFrame) -> pd.DataFrame:
        f, own, end = ends(f)
        out = [0] * own
        for i in reversed(range(own)):
            out[i] = int(end[i]) - own if end[i] >= own else out[end[i]]
        return pd.DataFrame({"place": f["place"].iloc[:1], "block": f["block"].iloc[:1], "to": [(out + [0] * most)[:most]]})

    def batches(f: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(f):  # the last block's exit leads nowhere
            f, own, end = ends(f)
            ids, first = f["tag_id"].tolist(), int(f["pos"].iloc[0])
            at = int(entry["entry"].iloc[0]) if len(entry) else 0
            while at < own:
                out.append((int(f["place"].iloc[0]), first + at, ids[at : end[at]]))
                at = int(end[at])
        return pd.DataFrame(out, columns=["place", "first", "tags"]).astype({"place": "int32", "first": "int64", "tags": object})

    maps = cut(rows.groupBy("place", "block").applyInPandas(exits, "place int, block long, to array<int>"))
    last, step = max((n - 1 for n, *_ in lists.values()), default=0) // size, 1
    while step <= last:  # after this round a map goes back over twice as many blocks
        prior = maps.select("place", (F.col("block") + step).alias("block"), F.col("to").alias("prior"))
        both = maps.join(prior, ["place", "block"], "left")
        maps = cut(both.select("place", "block", F.when(F.col("prior").isNull(), F.col("to")).otherwise(F.transform("prior", lambda x: F.get("to", x))).alias("to")))
        step *= 2
    entries = maps.select("place", (F.col("block") + 1).alias("block"), F.get("to", F.lit(0)).alias("entry"))
    keys = ("place", "block")
    parts = rows.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInPandas(batches, "place int, first long, tags array<string>")
    parts = parts.withColumn("group", F.element_at(F.create_map(*[F.lit(x) for kv in (group or {0: 0}).items() for x in kv]), F.col("place")))
    parts = global_rank(parts, F.col("group"), F.col("first"), F.col("place"), name="batch")
    primitive = F.element_at(F.array(*map(F.lit, primitives)), F.col("place") + 1)
    return parts.select("batch", F.floor(F.col("batch") / MAX_BATCHES).cast("int").alias("request"), primitive.alias("primitive"), "first", "tags")


#: Statuses of calls without an answer from the other side.
NETWORK, TIMEOUT = 0, -1


def failure_kind(status: Column, answered: Column | None = None) -> Column:
    """The kind of a status; ``ok`` for 200, unless it came without answers."""
    answered = F.lit(True) if answered is None else answered
    kind = F.when(status == NETWORK, "network").when(status == TIMEOUT, "timeout").when(status.between(200, 299), F.when(answered, "ok").otherwise("invalid"))
    return kind.when(status == 429, "rate_limit").when(status == 529, "overloaded").when(status.isin(401, 403), "auth").when(status >= 500, "server").otherwise("invalid")


def kind_of(status: int, answered: bool = True) -> str:
    """``failure_kind`` of one call."""
    known = {NETWORK: "network", TIMEOUT: "timeout", 429: "rate_limit", 529: "overloaded", 401: "auth", 403: "auth"}
    if 200 <= status < 300:
        return "ok" if answered else "invalid"
    return known.get(status) or ("server" if status >= 500 else "invalid")


def retry_after_ms(header: str | None, now: datetime | None = None) -> int | None:
    """Milliseconds from seconds or an HTTP date, 0 at least; None if it is neither."""
    if not header:
        return None
    try:
        return max(0, round(float(header) * 1000))
    except ValueError:
        pass
    try:
        when = parsedate_to_datetime(header)
    except (TypeError, ValueError):
        return None
    return max(0, round((when - (now or datetime.now(timezone.utc))).total_seconds() * 1000))


Client = Callable[[dict], tuple[int, dict, dict]]
"""Takes a request; gives status, headers, and the reply: ``answers`` by tag, ``model``, ``usage.inputTokens``. It must pickle, as it runs on executors."""


def stub_client(request: dict) -> tuple[int, dict, dict]:
    """A pure function of the tag's length, for tests and offline runs."""
    out = {}
    for tag, q in request["questions"].items():
        n = len(tag)
        if n % 11 == 0:
            continue
        if q["type"] == "noul" and n % 3:
            out[tag] = {"probability": n * 13 % 10 / 10}
        if q["type"] == "score" and n % 5:
            out[tag] = {"score": n * 7 % 41 / 10}
        if q["type"] == "choice" and n % 4:
            out[tag] = {"probabilities": {c: (n * (i + 3) % 7 + 1) / 10 for i, c in enumerate(CHOICES)}}
    return 200, {}, {"answers": out, "model": "stub", "usage": {"inputTokens": request_chars(request) // 4}}


def http_client(url: str, key: str, timeout: float = 30) -> Client:
    """A client for a JSON endpoint. A time-out and a broken connection have statuses of their own."""

    def call(request: dict):
        import urllib.error
        import urllib.request

        r = urllib.request.Request(url, json.dumps(request).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        try:
            with urllib.request.urlopen(r, timeout=timeout) as reply:
                try:
                    return reply.status, dict(reply.headers), json.load(reply)
                except ValueError:
                    return reply.status, dict(reply.headers), {}
        except urllib.error.HTTPError as e:
            return e.code, dict(e.headers), {"body": e.read().decode("utf-8", "replace")}
        except OSError as e:
            late = isinstance(e, TimeoutError) or isinstance(getattr(e, "reason", None), TimeoutError)
            return TIMEOUT if late else NETWORK, {}, {"body": str(e)}

    return call


def parse_answer(primitive: str, answer) -> tuple[float | None, list[float] | None] | None:
    """``(number, distribution)``; None for an answer of the wrong type. Missing or non-finite shares are 0."""
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and x == x and abs(x) != float("inf")
    if not isinstance(answer, dict):
        return None
    if primitive == "choice":
        p = answer.get("probabilities")
        return (None, [float(p[c]) if number(p.get(c)) else 0.0 for c in CHOICES]) if isinstance(p, dict) else None
    x = answer.get("probability" if primitive == "noul" else "score")
    return (float(x), None) if number(x) else None


def call_with_retry(client: Client, request: dict, sleep=time.sleep, jitter=random.random) -> tuple[str, dict, list[dict]]:
    """Kind, reply and a log entry for each attempt; waits as told by Retry-After or by the growing backoff, both with jitter."""
    log: list[dict] = []
    chars, questions = request_chars(request), len(request.get("questions", {}))
    for i in range(MAX_ATTEMPTS):
        began = time.perf_counter()
        status, headers, reply = client(request)
        reply = reply if isinstance(reply, dict) else {}
        kind = kind_of(status, isinstance(reply.get("answers"), dict))
        body = None if kind == "ok" else short(str(reply.get("body", "")))
        log.append({"attempt": i + 1, "status": status, "kind": kind, "questions": questions, "request_chars": chars, "elapsed_ms": round((time.perf_counter() - began) * 1000), "body": body})
        if kind not in RETRYABLE or i + 1 == MAX_ATTEMPTS:
            break
        told = retry_after_ms(next((v for k, v in headers.items() if k.lower() == "retry-after"), None))
        sleep((told if told is not None else BACKOFF_MS[i]) * (0.7 + 0.6 * jitter()) / 1000)
    return kind, reply if kind == "ok" else {}, log


def short(text: str, most: int = 300) -> str:
    return text[:most] + "…" if len(text) > most else text


LOG = "array<struct<attempt:int,status:int,kind:string,questions:int,request_chars:long,elapsed_ms:long,body:string>>"
EVENTS = f"batch long, request int, primitive string, tag_id string, kind string, attempts int, num double, dist array<double>, model string, input_tokens long, log {LOG}"


def evaluate(batches: DataFrame, lens: str, client: Client = stub_client, concurrency: int | None = 2, sleep=time.sleep) -> DataFrame:
    """A row for each asked tag: its answer, or nulls. ``concurrency`` tasks call the evaluator at a time; None leaves the batches in the tasks they are in.

    The first row of a batch also has its input tokens and its log.
    """
    lens = validate(lens, PRIMITIVES)
    columns = [f.name for f in _parse(EVENTS)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for b in f.itertuples():
                request = {"model": "", "state": state(lens), "questions": {t: question(t, b.primitive) for t in b.tags}}
                kind, reply, log = call_with_retry(client, request, sleep)
                answers, usage = reply.get("answers", {}), reply.get("usage") or {}
                for i, t in enumerate(dict.fromkeys(b.tags)):
                    value = parse_answer(b.primitive, answers.get(t)) or (None, None)
                    out.append((b.batch, b.request, b.primitive, t, kind, len(log), *value, reply.get("model"), None if i else usage.get("inputTokens"), None if i else log))
            yield pd.DataFrame(out, columns=columns).astype({"input_tokens": "Int64", "num": "float64"})

    return (batches.repartition(concurrency) if concurrency else batches).mapInPandas(run, EVENTS)


def answered(spark: SparkSession, path: str) -> DataFrame:
    """What has been answered so far; empty before the first answer."""
    try:
        return spark.read.schema(EVENTS).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], EVENTS)


def ask_once(batches: DataFrame, lens: str, client: Client, path: str, concurrency: int = 2, sleep=time.sleep) -> None:
    """Asks what ``path`` has no answer for, ``concurrency`` requests at a time, and appends the answers as they come.

    Each request is a task, and a task's answers count when it ends, whatever becomes of the others (the committer of version 2). So after a
    failure only requests that were under way are asked again. Failed requests have rows too, without values, with their kind and log.
    """
    spark = batches.sparkSession
    span = batches.agg(F.min("batch"), F.max("batch")).first()
    if span[0] is None:
        return
    have = answered(spark, path).where(F.col("batch").between(*span)).select("batch").distinct()
    todo = sorted(r[0] for r in batches.join(have, "batch", "left_anti").select("batch").collect())  # a request group's numbers
    for i in range(0, len(todo), concurrency):
        some = batches.where(F.col("batch").isin(todo[i : i + concurrency])).repartitionByRange(concurrency, "batch")
        rows = evaluate(some, lens, client, None, sleep)
        rows.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)


def _parse(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def question_sizes(tags: DataFrame, forms=("slim", "full")) -> DataFrame:
    """``form, primitive, tags, mean_chars``: how long the questions of ``tag_id`` are in each form. Tags are measured once; what a form and primitive add doesn't depend on them."""
    n = tags.agg(F.count("*").alias("tags"), F.avg(tag_chars(F.col("tag_id"))).alias("mean"))
    bare = [F.struct(F.lit(f).alias("form"), F.lit(p).alias("primitive"), F.lit(request_chars({"": question("", p, f)})).alias("chars")) for f in forms for p in PRIMITIVES]
    each = n.where("tags > 0").withColumn("q", F.explode(F.array(*bare)))
    return each.select("q.form", "q.primitive", "tags", F.round(F.col("q.chars") + 2 * F.col("mean"), 4).alias("mean_chars"))


def attempt_log(evaluated: DataFrame) -> DataFrame:
    """``batch, primitive`` and each attempt of each batch."""
    return evaluated.where("log is not null").select("batch", "primitive", F.explode("log").alias("l")).select("batch", "primitive", "l.*")


def wide(answers: DataFrame) -> DataFrame:
    """``tag_id, confidence, score, choice`` from long answers; null where there is none."""
    one = lambda p, c: F.max(F.when(F.col("primitive") == p, F.col(c)))
    return answers.groupBy("tag_id").agg(one("noul", "num").alias("confidence"), one("score", "num").alias("score"), one("choice", "dist").alias("choice"))


def planned(tags: DataFrame, lens: str, cache: DataFrame | None = None, failed: DataFrame | None = None, primitives=PRIMITIVES) -> DataFrame:
    """The batches of what is missing of ``tags`` (``tag_id, count``), the most frequent first: no pair that the cache has or that has failed is asked."""
    empty = tags.sparkSession.createDataFrame([], "tag_id string, primitive string")
    todo = missing(tags, empty if cache is None else cache, failed, primitives)
    totals = tags.groupBy("tag_id").agg(F.sum("count").alias("count"))
    order = global_rank(totals, F.desc("count"), F.col("tag_id"), name="ord").drop("count")
    return plan_batches(todo.join(order, "tag_id").select("ord", "tag_id", "primitive"), lens, primitives)


def evaluate_tags(tags: DataFrame, lens: str, client: Client = stub_client, cache: DataFrame | None = None, primitives=PRIMITIVES, failed: DataFrame | None = None) -> DataFrame:
    """Answers for what the cache lacks of tags (``tag_id, count``)."""
    lens = validate(lens, primitives)
    return evaluate(planned(tags, lens, cache, failed, primitives), lens, client)


class LensSession:
    """One lens at a time: cached answers first, then what is missing, failures apart until they are retried.

    Request groups run one after another; a new lens or ``abort`` stops before the next one, and
    what comes back for an older lens is not stored.
    """

    def __init__(self, cache, client: Client = stub_client):
        self.cache, self.client, self.lens, self.token = cache, client, "", 0
        self.progress = self._idle()

    def _idle(self) -> dict:
        return {"lens": self.lens, "running": False, "batches": 0, "ok": 0, "failed": 0, "tally": {}, "retryable": 0, "stored": True}

    def set_lens(self, lens: str) -> int:
        """A new lens makes all earlier requests stale; the same one changes nothing."""
        lens = normalise_lens(lens)
        if lens != self.lens:
            self.abort()
            self.lens = lens
            self.progress = self._idle()
        return self.token

    def abort(self) -> None:
        self.token += 1

    def clear(self) -> None:
        """Forgets all answers and failures."""
        self.abort()
        self.cache.clear()
        self.progress = self._idle()

    def ensure(self, tags: DataFrame) -> int:
        """Evaluates and stores what is missing and hasn't failed; the number of new answers."""
        if not self.lens:
            return 0
        lens, token, new = self.lens, self.token, 0
        plan = planned(tags, lens, self.cache.load(lens), self.cache.failed(lens))
        plan = cut(plan)
        requests = {r["request"]: (r["low"], r["high"]) for r in plan.groupBy("request").agg(F.min("batch").alias("low"), F.max("batch").alias("high")).orderBy("request").collect()}
        self.progress = self._idle() | {"running": True, "batches": plan.count()}
        folder = f"{self.cache.path}_asked/{uuid.uuid4().hex}"
        for request, span in requests.items():
            if token != self.token:
                break
            ask_once(plan.where(F.col("request") == request), lens, self.client, folder)
            new += self._store(answered(self.cache.spark, folder).where(F.col("batch").between(*span)), lens, token)
        if token == self.token:
            self.progress |= {"running": False, "retryable": self.count_retryable(tags)}
        return new

    def _store(self, asked: DataFrame, lens: str, token: int) -> int:
        """Answers go to the cache, what has none to its failures; both are read from where they were written as they came."""
        if token != self.token:
            return 0
        has = F.col("num").isNotNull() | F.col("dist").isNotNull()
        kinds = {r["kind"]: r["n"] for r in asked.where("log is not null").groupBy("kind").agg(F.count("*").alias("n")).collect()}
        rows = asked.where(has).select(F.lit(lens).alias("lens"), "tag_id", "primitive", "num", "dist", F.coalesce("model", F.lit("")).alias("model"), F.current_timestamp().alias("at"))
        n = rows.count()
        stored = not n or self.cache.put(rows)
        lost = asked.where(~has).select(F.lit(lens).alias("lens"), "tag_id", "primitive", "kind")
        stored = (lost.isEmpty() or self.cache.put_failed(lost)) and stored
        self.progress["ok"] += kinds.pop("ok", 0)
        self.progress["failed"] += sum(kinds.values())
        self.progress["tally"] = {k: self.progress["tally"].get(k, 0) + kinds.get(k, 0) for k in {*self.progress["tally"], *kinds}}
        self.progress["stored"] = self.progress["stored"] and stored
        return n

    def retry(self, tags: DataFrame) -> int:
        """Asks again for what has failed."""
        self.cache.clear_failed(self.lens)
        return self.ensure(tags)

    def count_retryable(self, tags: DataFrame) -> int:
        """Failed pairs among these tags."""
        return self.cache.failed(self.lens).join(tags.select("tag_id").distinct(), "tag_id", "left_semi").count()

    def evals(self) -> DataFrame:
        return wide(self.cache.load(self.lens))

    def missing(self, tags: DataFrame) -> DataFrame:
        return missing(tags, self.cache.load(self.lens))
