"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words, pick, row_key

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Buckets that a length's pieces are numbered in, so that one very common length is spread over many tasks.
BUCKETS = 256


def bin_cost(size: int, overhead: float = 48.0, quadratic: float = 1 / 65536) -> float:
    """What a sequence of ``size`` costs: a fixed part, a part for each token, and attention's square."""
    return overhead + size + quadratic * size * size


def plan_bins(hist: dict[int, int], capacities=CAPACITIES, cost=bin_cost) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing over the counts of each length, all capacities at once.

    Works on runs of equal bins, so its time and its result depend on the number of lengths (at
    most the largest capacity) and not on the number of documents. Returns the segments, a row
    (length, first rank, pieces a bin, first bin, offset in the bin) each, sorted by length and
    rank, and the bins' runs (first bin, tokens, capacity), sorted by first bin.

    A length goes to the fullest open bin that takes it. If none does, the capacity is opened
    that costs least for each token it will carry, which is found by filling one bin of each
    capacity greedily from the lengths still to come. At the end every bin shrinks to the least
    capacity that holds its contents.
    """
    caps = sorted(capacities)
    lengths = sorted(n for n, c in hist.items() if c > 0 and n > 0)
    if lengths and lengths[-1] > caps[-1]:
        raise ValueError("a piece is longer than the largest capacity")
    left = dict(hist)
    rooms: list[int] = []  # the open residual sizes, sorted
    open_bins: dict[int, list[tuple[int, int, int]]] = {}  # residual -> runs (first bin, bins, size opened)
    segments, bins = [], 0

    def put(room: int, run: tuple[int, int, int]) -> None:
        if run[1] > 0:
            if room not in open_bins:
                open_bins[room] = []
                insort(rooms, room)
            open_bins[room].append(run)

    def carried(size: int, n: int) -> int:
        """Tokens in one bin of ``size`` that takes as many of length ``n`` as fit, and then the largest others."""
        k = min(size // n, left[n])
        full, rest = k * n, size - k * n
        i = bisect_left(lengths, n)
        while rest and (i := bisect_right(lengths, rest, 0, i) - 1) >= 0:
            k = min(rest // lengths[i], left[lengths[i]])
            full, rest = full + k * lengths[i], rest - k * lengths[i]
        return full

    for n in reversed(lengths):
        rank, c = 0, left[n]
        while c:
            at = bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                first, many, size = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
                k = room // n
            else:
                left[n] = c
                size = min((s for s in caps if s >= n), key=lambda s: (cost(s) / carried(s, n), s))
                room, k = size, size // n
                first, many = bins, max(1, c // k)  # what is left of a bin chooses again
                bins += many
            used = min(many, c // k)
            if used:
                segments.append((n, rank, k, first, size - room))
                put(room - k * n, (first, used, size))
                rank, c = rank + used * k, c - used * k
            if used < many and c:  # one bin takes the rest
                segments.append((n, rank, k, first + used, size - room))
                put(room - c * n, (first + used, 1, size))
                used, rank, c = used + 1, rank + c, 0
            put(room, (first + used, many - used, size))
        left[n] = 0
    runs = sorted((first, size - room) for room, found in open_bins.items() for first, _, size in found)
    capacity = [caps[bisect_left(caps, used)] for _, used in runs]
    return (
        np.array(sorted(segments), dtype=np.int64).reshape(-1, 5),
        np.array([(f, u, s) for (f, u), s in zip(runs, capacity, strict=True)], dtype=np.int64).reshape(-1, 3),
    )


def pack(docs: DataFrame, capacities=CAPACITIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each piece of each document with its place: ``doc_id, piece, start, n_tokens, bin_id, bin_offset, bin_tokens, bin_capacity``.

    A document longer than the largest capacity is cut into pieces of that size and a rest;
    nothing is dropped. Tokens are words. The histogram of piece lengths, one row for each length
    up to the largest capacity, is all that reaches the driver, and the plan made from it is what
    the tasks get. A piece finds its place by its rank among the pieces of its length.

    Null or empty text: one row with piece 0, no tokens and a null bin. Null ids stay null.
    Repeated rows are packed once for each row. An empty table gives no rows. Other columns are
    not read. Equal lengths are numbered by a hash of id and text, so reruns agree.
    """
    top = max(capacities)
    t = pick(docs, id=id_col, text=text_col)
    base = cut(t.select("id", n_words(F.col("text")).alias("n"), *row_key(F.col("id"), F.col("text"))))
    count = F.greatest(F.ceil(F.col("n") / top), F.lit(1)).cast("long")
    pieces = base.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    pieces = pieces.withColumn("start", F.col("piece") * top).withColumn("len", F.least(F.col("n") - F.col("start"), F.lit(top)))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("_k1", "piece"), F.lit(BUCKETS)))
    cells = cut(pieces.groupBy("len", "bucket").agg(F.count("*").alias("c")))
    hist = {int(r["len"]): int(r["c"]) for r in cells.groupBy("len").agg(F.sum("c").alias("c")).collect()}
    plan = plan_bins({n: c for n, c in hist.items() if n}, capacities)
    before = Window.partitionBy("len").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("len", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("len", "bucket").orderBy("_k1", "_k2", "piece")
    ranked = pieces.withColumn("rank", F.row_number().over(own).cast("long") - 1).join(offsets, ["len", "bucket"])
    ranked = ranked.select("id", "piece", "start", F.col("len").alias("n_tokens"), (F.col("rank") + F.col("offset")).alias("rank"))
    sent = docs.sparkSession.sparkContext.broadcast(plan)

    def place(batches):
        seg, runs = sent.value
        key = (seg[:, 0] << 48) + seg[:, 1]
        for b in batches:
            n, rank = (b.column(x).to_numpy(zero_copy_only=False) for x in ("n_tokens", "rank"))
            if len(seg):
                s = seg[np.maximum(np.searchsorted(key, (n << 48) + rank, side="right") - 1, 0)]
                k = rank - s[:, 1]
                bin_id = s[:, 3] + k // s[:, 2]
                offset = s[:, 4] + k % s[:, 2] * n
                run = runs[np.maximum(np.searchsorted(runs[:, 0], bin_id, side="right") - 1, 0)]
            else:
                bin_id, offset, run = n, n, np.zeros((len(n), 3), np.int64)
            none = n == 0
            yield pa.RecordBatch.from_arrays(
                [*(b.column(x) for x in ("id", "piece", "start", "n_tokens")), *(pa.array(x, mask=none) for x in (bin_id, offset, run[:, 1], run[:, 2]))],
                names=["id", "piece", "start", "n_tokens", "bin_id", "bin_offset", "bin_tokens", "bin_capacity"],
            )

    kind = dict(t.dtypes)["id"]
    out = ranked.mapInArrow(place, f"id {kind}, piece long, start long, n_tokens long, bin_id long, bin_offset long, bin_tokens long, bin_capacity long")
    return out.withColumnRenamed("id", "doc_id")
