"""Substring dedup: word passages that occur elsewhere, found by blocks at fixed places and extended to whole repeats."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, pick

WINDOW = 35
#: Bytes of text of a chunk, about.
CHUNK = 8 << 20
#: Multipliers of the rolling hashes, odd.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_ALL = (1 << 64) - 1


def rolling(w: np.ndarray, n: int, base: int) -> np.ndarray:
    """A 64-bit hash of each ``n`` consecutive values of ``w``, put together from hashes of lengths of powers of two."""

    def join(a, la, b, lb):
        m = max(0, len(w) - la - lb + 1)
        return a[:m] * np.uint64(pow(base, lb, 1 << 64)) + b[la : la + m]

    out, done, power, width = None, 0, w, 1
    while True:
        if n & width:
            out, done = (power, width) if out is None else (join(out, done, power, width), done + width)
        if width * 2 > n:
            break
        power, width = join(power, width, power, width), width * 2
    x = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def within(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``among``."""
    if not len(among):
        return np.zeros(len(x), bool)
    at = np.searchsorted(among, x)
    at[at == len(among)] = 0
    return among[at] == x


class Chunk:
    """The different texts of a chunk as one line of word hashes. Texts of fewer words than ``window`` have no windows and are left out of it."""

    def __init__(self, table: pa.Table, window: int):
        self.window, self.block = window, (window + 1) // 2
        self.keys: dict[tuple[int, int], int] = Counter()
        text: dict[tuple[int, int], bytes] = {}
        for k1, k2, n, t in zip(*(table.column(c).to_pylist() for c in ("t1", "t2", "n", "text")), strict=True):
            self.keys[k1, k2] += n
            if t is not None:
                text[k1, k2] = t
        self.texts = [text[k] for k in self.keys]
        self.sizes = np.zeros(len(self.texts), np.int64)
        parts = [np.zeros(0, np.uint64)]
        for i, t in enumerate(self.texts):
            words = t.split()
            self.sizes[i] = len(words)
            if len(words) >= window:
                parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        self.w = np.concatenate(parts)
        self.long = np.flatnonzero(self.sizes >= window)
        size = self.sizes[self.long]
        self.start = np.cumsum(size) - size
        self.rel = np.arange(len(self.w)) - np.repeat(self.start, size)
        self.left = np.repeat(size, size) - self.rel  # words from here to the end of the text

    def blocks(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and 32 bits of the hash of each block of words, as one number, and their places."""
        at = np.flatnonzero(self.left >= self.block)
        h = rolling(self.w, self.block, _BASES[0])[at] if len(at) else np.zeros(0, np.uint64)
        return ((h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)), at

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two hashes of each window and their places."""
        at = np.flatnonzero(self.left >= self.window)
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), at
        a, b = (rolling(self.w, self.window, x) for x in _BASES)
        return a[at], b[at], at


def _by_bucket(bucket: np.ndarray):
    """The runs of equal numbers in the sorted ``bucket``."""
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist()
    return [(int(bucket[i]), slice(i, j)) for i, j in zip(edges, edges[1:], strict=False)]


def repeats(docs: DataFrame, window: int = WINDOW, keep: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with ``doc_id, n_words, n_removed, spans, kept``.

    A window is ``window`` consecutive words; a word goes if a window over it starts anywhere else too, in the same
    document or another. ``spans`` are the runs of words that go (``start``, ``end``), the largest exact repeats joined where they meet.
    ``kept`` is the words that stay, joined by a space; with ``keep="sha256"`` its hash (hex, of UTF-8), so that texts needn't move again.

    Half as long a block, rounded up, stands at every multiple of its length in each text, so every window holds exactly one.
    These anchors are the index. Every run of as many words, at any place, probes it; an anchor is live if
    another place has its words. Only the windows over live anchors are compared, by 128 bits, which extends a hit as
    far as the repeat goes. Texts are dealt to chunks once, and read there three times from the same shuffle. Chunks send different hashes only, by 32 bits
    in the probe (an error costs a few comparisons, no result), and get back what they need to know, so a passage that a third of the documents share costs one
    entry a chunk. Equal texts meet as one with a count.

    Null text has no words. Repeated rows and copies are documents like any other: all their windows occur elsewhere.
    Texts of fewer words than a window stay whole. Null ids are ids. An empty table gives no rows. Other columns are not read.
    """
    t = pick(docs, id=id_col, text=text_col)
    t = t.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t1"), F.xxhash64(F.lit("t2"), F.coalesce("text", F.lit(""))).alias("t2"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    size = t.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = 1 + size // CHUNK
    buckets = 1 + chunks // 2

    def once(batches):
        """A text that occurs again in the task is counted and not sent again."""
        seen: set[tuple[int, int]] = set()
        for b in batches:
            keys = list(zip(b.column("t1").to_pylist(), b.column("t2").to_pylist(), strict=True))
            first = {k: i for i, k in reversed(list(enumerate(keys)))}
            count, at = Counter(keys), pa.array([first[k] for k in first], pa.int64())
            new = pa.array([k not in seen for k in first], pa.bool_())
            seen.update(first)
            text = pc.if_else(new, b.column("text").take(at), pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column("t1").take(at), b.column("t2").take(at), pa.array([count[k] for k in first], pa.int64()), text], names=["t1", "t2", "n", "text"])

    # one shuffle of the texts, which all three steps read
    dealt = t.select("t1", "t2", "text").mapInArrow(once, "t1 long, t2 long, n long, text binary").withColumn("g", F.pmod("t1", F.lit(chunks))).repartition("g")
    sent = "bucket long, g long, once binary, twice binary"

    def packed(g, rows):
        names, types = ["bucket", "g", "once", "twice"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        if rows and len(rows[0]) == 5:
            names, types = [*names, "anchors"], [*types, pa.binary()]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], names=names)

    def probe(table: pa.Table) -> pa.Table:
        c = Chunk(table, window)
        key, at = c.blocks(buckets)
        anchors = np.unique(key[c.rel[at] % c.block == 0])
        key, n = np.unique(key, return_counts=True)
        g, rows = table.column("g")[0].as_py(), []
        for bucket, part in _by_bucket((key >> np.uint64(32)).astype(np.int64)):
            low, twice = key[part].astype(np.uint32), n[part] > 1
            mine = slice(*np.searchsorted(anchors, np.array([bucket << 32, (bucket + 1) << 32], np.uint64)))
            rows.append((bucket, g, low[~twice].tobytes(), low[twice].tobytes(), anchors[mine].astype(np.uint32).tobytes()))
        return packed(g, rows) if rows else packed(g, rows).append_column("anchors", pa.array([], pa.binary()))

    def match(table: pa.Table) -> pa.Table:
        each = [[np.frombuffer(x, np.uint32) for x in table.column(c).to_pylist()] for c in ("once", "twice", "anchors")]
        every = np.sort(np.concatenate(each[0] + each[1]))
        live = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *each[1]]))
        found = [a[within(a, live)].tobytes() for a in each[2]]
        return pa.table({"bucket": table.column("bucket"), "g": table.column("g"), "live": pa.array(found, pa.binary())}).filter(pa.array([bool(x) for x in found], pa.bool_()))

    def extend(table: pa.Table, hits: pa.Table) -> pa.Table:
        c = Chunk(table, window)
        g, rows = table.column("g")[0].as_py(), []
        live = [np.frombuffer(x, np.uint32).astype(np.uint64) | np.uint64(k << 32) for k, x in zip(hits.column("bucket").to_pylist(), hits.column("live").to_pylist(), strict=True)]
        if live and len(c.w):
            key, at = c.blocks(buckets)
            anchor = np.zeros(len(c.w), bool)
            anchor[at] = (c.rel[at] % c.block == 0) & within(key, np.sort(np.concatenate(live)))
            a, b, at = c.windows()
            over = anchor[at + (-c.rel[at]) % c.block]  # the one anchor in the window
            a, b = a[over], b[over]
            order = np.lexsort((b, a, a % np.uint64(buckets)))
            a, b = a[order], b[order]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
            n = np.diff(np.flatnonzero(np.concatenate((new, [True]))))
            a, b = a[new], b[new]
            for bucket, part in _by_bucket((a % np.uint64(buckets)).astype(np.int64)):
                both, twice = np.stack((a[part], b[part]), axis=1), n[part] > 1
                rows.append((bucket, g, both[~twice].tobytes(), both[twice].tobytes()))
        return packed(g, rows)

    def compare(table: pa.Table) -> pa.Table:
        each = [[np.frombuffer(x, np.uint64).reshape(-1, 2) for x in table.column(c).to_pylist()] for c in ("once", "twice")]
        both = np.concatenate(each[0] + each[1])
        row = np.concatenate([np.full(len(x), i % len(each[0]), np.int64) for i, x in enumerate(each[0] + each[1])])
        times = np.repeat([1, 2], [sum(map(len, x)) for x in each])
        order = np.lexsort((both[:, 1], both[:, 0]))
        both, row, times = both[order], row[order], times[order]
        new = np.concatenate(([True], (both[1:] != both[:-1]).any(axis=1)))
        total = np.add.reduceat(times, np.flatnonzero(new))
        again = total[np.cumsum(new) - 1] > 1
        row, a = row[again], both[again, 0]
        order = np.argsort(row, kind="stable")
        edges = np.searchsorted(row[order], np.arange(len(each[0]) + 1))
        a = a[order]
        found = [a[i:j].tobytes() for i, j in zip(edges, edges[1:], strict=False)]
        return pa.table({"g": table.column("g"), "found": pa.array(found, pa.binary())}).filter(pa.array([bool(x) for x in found], pa.bool_()))

    def finish(table: pa.Table, found: pa.Table) -> pa.Table:
        c = Chunk(table, window)
        times = np.array(list(c.keys.values()))
        cover = np.zeros(len(c.w) + 1, np.int64)
        if len(c.w):
            a, _, at = c.windows()
            copies = np.repeat(times[c.long] > 1, c.sizes[c.long])
            hit = at[copies[at] | within(a, np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in found.column("found").to_pylist())])))]
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        start = dict(zip(c.long.tolist(), c.start.tolist(), strict=True))
        removed, spans, kept = [], [], []
        for i, text in enumerate(c.texts):
            words, runs = text.split(), []
            if i in start:
                edges = np.flatnonzero(np.diff(gone[start[i] : start[i] + len(words)].astype(np.int8), prepend=0, append=0)).tolist()
                runs = list(zip(edges[::2], edges[1::2], strict=True))
                for x, y in reversed(runs):
                    del words[x:y]
            removed.append(sum(y - x for x, y in runs))
            spans.append([{"start": x, "end": y} for x, y in runs])
            rest = b" ".join(words)
            kept.append(hashlib.sha256(rest).hexdigest() if keep == "sha256" else rest.decode("utf-8", "replace"))
        k1, k2 = zip(*c.keys, strict=True)
        return pa.table({"t1": pa.array(k1, pa.int64()), "t2": pa.array(k2, pa.int64()), "n_words": pa.array(c.sizes), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), "kept": pa.array(kept, pa.string())})

    live = dealt.groupBy("g").applyInArrow(probe, f"{sent}, anchors binary").groupBy("bucket").applyInArrow(match, "bucket long, g long, live binary")
    windows = dealt.groupBy("g").cogroup(live.groupBy("g")).applyInArrow(extend, sent)
    found = windows.groupBy("bucket").applyInArrow(compare, "g long, found binary")
    out = dealt.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(finish, "t1 long, t2 long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string")
    out = cut(out)
    rows = cut(t.select(F.col("id").alias("doc_id"), "t1", "t2"))
    return join_hot(rows, out, "t1", "t2").drop("t1", "t2")
