"""SimHash near-duplicates by a grid join on per-segment bit counts."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT, cut, join_hot, pick, row_key

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_EVEN = 0x5555555555555555


def simhash(text: str, shingle: int = 4, seed: int = 42) -> int:
    """64 bits of which each is set if it is set in over half the shingles' XXH64; 0 if there are no words."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        digests, n = xxhash.xxh64_digest(joined, seed), 1
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(words) - shingle + 1
        h = xxhash.xxh64_digest
        digests = b"".join([h(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)])
    d = np.frombuffer(digests, np.uint8).reshape(n, 8)
    if n < 1000:
        ones = np.unpackbits(d, axis=1).sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(d[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _shingles(text: str, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the different shingles of a text, in order; of all its words if they are fewer than a shingle."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)], np.uint64))


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, _k1, _k2, fp``: the SimHash (as a signed long) of each whole text; null text is empty."""
    t = pick(docs, id=id_col, text=text_col)
    t = t.select("id", *row_key(F.col("id"), F.col("text")), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        for b in batches:
            fp = np.array([simhash(x, shingle) for x in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("_k1"), b.column("_k2"), pa.array(fp)], names=["id", "_k1", "_k2", "fp"])

    return t.mapInArrow(run, f"id {dict(t.dtypes)['id']}, _k1 long, _k2 long, fp long")


def embed(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, in unary (0, 01, 11).

    In this code the Manhattan distance of two vectors of counts is the number of differing bits.
    It is at most the Hamming distance of the fingerprints.
    """
    x, even = fp.view(np.uint64), np.uint64(_EVEN)
    low, high = x & even, (x >> np.uint64(1)) & even
    return (low | high) | ((low & high) << np.uint64(1))


def cells(distance: int, blocks: int) -> list[int]:
    """Masks of the blocks of segments that each cell key keeps: all choices of ``blocks - distance`` of them."""
    edges = [round(i * 32 / blocks) * 2 for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [(m - (1 << 64) if (m := sum(keep)) >> 63 else m) for keep in combinations(masks, blocks - distance)]


def near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Where fingerprints link: first the Manhattan distance of the embeddings, then the exact distance of what is left."""
    ok = np.bitwise_count(embed(a) ^ embed(b)) <= distance
    ok[ok] = np.bitwise_count((a[ok] ^ b[ok]).view(np.uint64)) <= distance
    return ok


def cell_links(fp: np.ndarray, cell: np.ndarray, distance: int, small: int = 16):
    """Links between the fingerprints of each run of equal ``cell``: all in small cells, a spanning forest in larger ones.

    Never emits more than ``small`` links a fingerprint; links that are left out join fingerprints
    that the emitted ones join already.
    """
    first = np.concatenate(([0], np.flatnonzero(cell[1:] != cell[:-1]) + 1)) if len(cell) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((first, [len(cell)])))
    of = np.repeat(size, size)
    for shift in range(1, small):
        at = np.flatnonzero((of > shift) & (of <= small))
        at = at[at + shift < len(cell)]
        at = at[cell[at] == cell[at + shift]]
        if not len(at):
            break
        at = at[near(fp[at], fp[at + shift], distance)]
        yield fp[at], fp[at + shift]
    for start, n in zip(first[size > small], size[size > small], strict=True):
        rest = fp[start : start + n]
        while len(rest):
            front, rest = [rest[:1]], rest[1:]
            while front and len(rest):
                seed = front.pop()
                for x in seed:
                    ok = near(np.full(len(rest), x), rest, distance)
                    if ok.any():
                        found = rest[ok]
                        yield np.full(len(found), x), found
                        front.append(found)
                        rest = rest[~ok]
                    if not len(rest):
                        break


def links(distinct: DataFrame, distance: int = 4, blocks: int = 8) -> DataFrame:
    """``a, b``: links between different fingerprints, enough to join all that are joined.

    ``distinct`` has each fingerprint once (``fp``). ``distance`` flipped bits touch at most as many
    of the ``blocks``, so two linked fingerprints have equal segment counts in some choice of the
    others: each choice is a grid, its counts are a cell. Only cells with company are compared.
    """
    masks = cells(distance, blocks)
    x = F.col("fp")
    low, high = x.bitwiseAND(_EVEN), F.shiftrightunsigned(x, 1).bitwiseAND(_EVEN)
    code = low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))
    keys = distinct.select("fp", code.alias("code")).select("fp", "code", F.posexplode(F.lit(masks)).alias("grid", "mask"))
    keys = keys.select(F.xxhash64("grid", F.col("code").bitwiseAND(F.col("mask"))).alias("cell"), "fp")
    keys = keys.repartition("cell").sortWithinPartitions("cell", "fp")

    def run(batches):
        fp, cell = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            new_cell, new_fp = (b.column(i).to_numpy() for i in (0, 1))
            cell, fp = np.concatenate((cell, new_cell)), np.concatenate((fp, new_fp))
            if not len(cell):
                continue
            keep = np.searchsorted(cell, cell[-1])  # the last cell may go on
            yield from pairs(fp[:keep], cell[:keep])
            cell, fp = cell[keep:], fp[keep:]
        yield from pairs(fp, cell)

    def pairs(fp, cell):
        for a, b in cell_links(fp, cell, distance):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return keys.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: each node of ``edges`` (``a, b``) and the smallest node it is joined to.

    Alternating large and small stars; each round is cut off by a checkpoint, and the driver sees
    only a count and a sum.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u != v").distinct())
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


#: Different shingles' hashes are mixed with these for 256 bits.
_WIDE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD], dtype=np.uint64)
#: Cells of a text: the segment counts of ``BANDS`` SimHashes, each of a sample of ``PER_BAND`` of its shingles.
BANDS, PER_BAND = 20, 6
_MINIMA = np.random.default_rng(7).integers(1, 1 << 63, BANDS * PER_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Of 256 bits a similarity of 0.8 flips 39 on average with a deviation of 5.7; random texts differ in 128 (deviation 8).
FLIPS = 62
#: Documents of a block of a large component, which is compared block by block.
BLOCK = 400
#: Texts of a large component that all of it is compared with first.
PIVOTS = 16
#: Texts of a part of a hot cell.
CELL = 4096
#: Segments of a set's own bits, as a part of the largest set of its class.
SPREAD = 0.4
#: Bits of a parity of a set.
PARITY = 1024


def samples(s: np.ndarray) -> np.ndarray:
    """``BANDS`` SimHashes of a set of different hashes, each of the ``PER_BAND`` shingles that are least in as many orders of all shingles.

    The bits of a SimHash of the whole set flip everywhere when a part of the set changes; those of a sample stay as they are
    when the sample does, which for sets of similarity j has a probability of ``j ** PER_BAND``.
    """
    low = np.full(BANDS * PER_BAND, ~np.uint64(0))
    for i in range(0, len(s), 512):
        low = np.minimum(low, (s[i : i + 512, None] * _MINIMA).min(axis=0))
    low = (low ^ (low >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)  # the highest bits of minima are zeros
    low = (low ^ (low >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    ones = np.unpackbits((low ^ (low >> np.uint64(31))).view(np.uint8).reshape(BANDS, PER_BAND, 8), axis=2).sum(axis=1)
    return np.packbits(2 * ones > PER_BAND, axis=1).view(np.uint64).ravel()


def bands(s: np.ndarray) -> np.ndarray:
    """The cells of a set of different hashes: the segment counts (``embed``) of each of its ``samples``, which sets share if they have them all in common."""
    key = (np.arange(1, BANDS + 1, dtype=np.uint64) ^ embed(samples(s))) * np.uint64(0x9E3779B97F4A7C15)
    return key ^ (key >> np.uint64(29))


def differing(sizes, similarity: float):
    """How many elements two sets of so many elements together may have that the other lacks, if their Jaccard similarity is ``similarity`` or more."""
    return np.floor(sizes * ((1 - similarity) / (1 + similarity)) + 1e-6).astype(np.int64)


def segments(s: np.ndarray, similarity: float) -> tuple[np.ndarray, bool]:
    """Cells of which sets (different hashes, in order) of ``similarity`` or more have one in common, without exception; and whether the set has too few for that.

    A set is a fingerprint of 2**64 bits, one for each hash, cut in segments. So few bits differ that a set agrees with a similar one in all its segments but
    ``most``. A cell is a segment with its bits and their count. Both sets have the same order of cells, those of most bits first, so
    the first ``most`` + 1 of each meet. The number of segments is that of the class of the larger set (up to a power of two), so a set may have cells of two classes.
    """
    n, found, short = len(s), [np.zeros(0, np.uint64)], False
    largest = int(n / similarity + 1e-6)
    bits = _mixed(s)
    for c in range(max(n - 1, 0).bit_length(), max(largest - 1, 0).bit_length() + 1) if n else ():
        most = int(differing(n + min(1 << c, largest), similarity))
        if not most:  # only an equal set is similar
            continue
        of = ((s >> np.uint64(32)) * np.uint64(max(1, round(SPREAD * (1 << c)), min(1 << c, 64)))) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        count = np.diff(np.append(first, n))
        cell = _mixed(np.add.reduceat(bits, first) + _mixed(of[first] + (np.uint64(c + 1) << np.uint64(48)))) | np.uint64(1)
        short |= len(cell) <= most
        found.append(cell[np.lexsort((cell, -count))[: most + 1]])
    return np.concatenate(found), short


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parity(s: np.ndarray) -> bytes:
    """``PARITY`` bits, of which each is set if an odd number of a set's hashes fall on it: two sets' parities differ in no more bits than the sets in elements."""
    return np.packbits((np.bincount((s & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)).tobytes()


def wide_simhash(s: np.ndarray) -> np.ndarray:
    """256 bits, as 4 words, of which each is set if it is set in over half the different shingles."""
    if not len(s):
        return np.zeros(4, np.uint64)
    x = s[:, None] ^ _WIDE[None, :]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    d = np.ascontiguousarray(x ^ (x >> np.uint64(31))).view(np.uint8)
    if len(s) < 1000:
        ones = np.unpackbits(d, axis=1).sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(d[:, i], minlength=256) @ _BITS for i in range(32)])
    return np.packbits(2 * ones > len(s)).view(np.uint64)


def near_wide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where fingerprints of four words differ in ``FLIPS`` bits or fewer: first the Manhattan distance of their segment counts, then the exact distance of what is left."""
    ok = np.bitwise_count(embed(a) ^ embed(b)).sum(axis=1, dtype=np.int64) <= FLIPS
    ok[ok] = np.bitwise_count(a[ok] ^ (b[ok] if len(b) == len(ok) else b)).sum(axis=1, dtype=np.int64) <= FLIPS
    return ok


def forest(cell: np.ndarray, node: np.ndarray, fp: np.ndarray, small: int = 256):
    """Links (x, y) between nodes of each run of equal ``cell`` whose ``fp`` (four words a row) differ in ``FLIPS`` bits or fewer.

    At most one link a node, enough to join all that such nodes join. Cells of up to ``small`` nodes are
    compared all at once; larger ones one node after the other, so that memory stays in proportion to the nodes.
    """
    first = np.concatenate(([0], np.flatnonzero(cell[1:] != cell[:-1]) + 1)) if len(cell) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((first, [len(cell)])))
    end = np.repeat(first + size, size)
    live = np.flatnonzero(np.repeat(size, size) <= small)
    label, found = np.arange(len(cell)), []
    for shift in range(1, small):
        live = live[live + shift < end[live]]
        if not len(live):
            break
        at = live[near_wide(fp[live], fp[live + shift])]
        found.append((at, at + shift))
    x, y = (np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in (0, 1))
    while len(x):  # the least place that links reach
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    joined = np.flatnonzero(label != np.arange(len(label)))
    yield node[label[joined]], node[joined]
    for start, n in zip(first[size > small], size[size > small], strict=True):
        rest = np.arange(start, start + n)
        while len(rest):
            front, rest = [rest[:1]], rest[1:]
            while front and len(rest):
                for i in front.pop():
                    ok = near_wide(fp[rest], fp[i][None, :])
                    if ok.any():
                        yield np.full(np.count_nonzero(ok), node[i]), node[rest[ok]]
                        front.append(rest[ok])
                        rest = rest[~ok]
                    if not len(rest):
                        break


def similar(sets: list[np.ndarray], others: list[np.ndarray], similarity: float, columns: int = 4096) -> np.ndarray:
    """Which of ``sets`` have a Jaccard similarity of ``similarity`` or more with which of ``others``, as a matrix. Sets hold different hashes each."""
    every = [*sets, *others]
    sizes = np.array([len(s) for s in every])
    of, h = np.repeat(np.arange(len(every)), sizes), np.concatenate(every)
    _, column, times = np.unique(h, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    _, column = np.unique(column[shared], return_inverse=True)
    of = of[shared]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    same, n = np.zeros((len(sets), len(others)), np.float32), len(sets)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        part = slice(*np.searchsorted(column, (c, c + columns)))
        m = np.zeros((len(every), columns), np.float32)
        m[of[part], column[part] - c] = 1
        same += m[:n] @ m[n:].T
    return same >= similarity * (sizes[:n, None] + sizes[None, n:] - same)


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links enough to join all that the symmetric matrix joins."""
    out, rest = [], np.arange(len(linked))
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            i = front.pop()
            ok = linked[i, rest]
            out += ((i, j) for j in rest[ok])
            front += rest[ok].tolist()
            rest = rest[~ok]
    return out


def verify_blocks(batches, similarity: float):
    """Links among the documents of each run of equal ``comp, first, second``, which are one block or two (``block``); at most one a document."""

    def links(rows: list[dict]):
        sets = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
        linked = np.zeros((len(rows), len(rows)), bool)
        if rows[0]["first"] == rows[0]["second"]:
            linked = similar(sets, sets, similarity)
        else:
            mine = np.array([r["block"] == r["first"] for r in rows])
            a, b = np.flatnonzero(mine), np.flatnonzero(~mine)
            if len(a) and len(b):
                linked[np.ix_(a, b)] = similar([sets[i] for i in a], [sets[i] for i in b], similarity)
                linked |= linked.T
        return [(rows[i]["node"], rows[j]["node"]) for i, j in spanning(linked)]

    held: list[dict] = []
    for b in batches:
        out = []
        for r in b.to_pylist():
            if held and any(held[0][c] != r[c] for c in ("comp", "first", "second")):
                out += links(held)
                held = []
            held.append(r)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
    if held and (out := links(held)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])


def similar_documents(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with ``doc_id, component_id, root`` and the keys ``_k1, _k2`` of its row.

    Texts link if their sets of word shingles have a Jaccard similarity of ``similarity`` or more, computed
    from the texts. Candidates meet by the segment counts of SimHashes, as in ``near_duplicates``, but of samples: a text has ``BANDS`` SimHashes of
    ``PER_BAND`` shingles each, and a cell is the counts of the 32 two-bit segments of one of them. Those that meet are held against each other by the segment
    counts of a SimHash of 256 bits over all different shingles, and then by its bits, of which ``FLIPS`` may differ. The cells aren't counts of
    that SimHash: at this distance those that keep recall also join a fixed share of all pairs, while samples of unlike texts have
    no counts in common, however many there are. A pair of similarity 0.8 shares a cell with a probability of 0.998, and what is left
    out here is found without exception by ``segments`` of all shingles (``_missed``). Cells pass on spanning forests only; those that hold over a thousandth of all places
    are dealt to parts of about ``CELL`` texts, and one text of each tree of a part meets those of the other parts.

    All texts that candidates join are then compared with one another where they are together. More than ``BLOCK`` meet ``PIVOTS`` of
    them first; whatever these join is one group. Then blocks of ``BLOCK`` texts are compared with each other, but for blocks of one
    group, which are known to be joined. So a template with many variants isn't copied again and again, no list
    of pairs is made, and no link among texts that candidates join is lost or capped.
    Texts of equal shingles are one node. ``component_id`` and ``root`` as in ``near_duplicates``.

    Texts without words link with each other. Repeated rows give repeated results, an empty table gives
    no rows, other columns are not read.
    """
    t = pick(docs, id=id_col, text=text_col)
    t = t.select("id", *row_key(F.col("id"), F.col("text")), F.coalesce("text", F.lit("")).alias("text"))
    words = [f"w{i}" for i in range(4)]

    def sketch(batches):
        for b in batches:
            sets = [_shingles(x, shingle) for x in b.column("text").to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            w = np.array([wide_simhash(s) for s in sets], np.uint64).reshape(-1, 4).view(np.int64)
            cells = pa.array([bands(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
            size, odd = pa.array([len(s) for s in sets], pa.int64()), pa.array([parity(s) for s in sets], pa.binary())
            cols = [b.column("id"), b.column("_k1"), b.column("_k2"), pa.array(node), *(pa.array(w[:, i].copy()) for i in range(4)), cells, size, odd]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "_k1", "_k2", "node", *words, "cells", "size", "odd"])

    kind = dict(t.dtypes)["id"]
    fps = cut(t.mapInArrow(sketch, f"id {kind}, _k1 long, _k2 long, node long, " + ", ".join(f"{w} long" for w in words) + ", cells array<long>, size long, odd binary"))
    nodes = cut(fps.groupBy("node").agg(F.min("id").alias("least"), F.min(F.struct("_k1", "_k2")).alias("k"), *[F.first(c).alias(c) for c in (*words, "cells", "size", "odd")]))
    dealt = nodes.select(F.explode("cells").alias("cell"), "node", *words)
    hot = dealt.groupBy("cell").agg(F.count("*").alias("n")).where((F.col("n") * HOT > nodes.count() * BANDS) & (F.col("n") > CELL)).collect()  # less than HOT cells
    parts = F.lit(None).cast("int")
    if hot:
        of = F.broadcast(nodes.sparkSession.createDataFrame([(r["cell"], -(-r["n"] // CELL)) for r in hot], "cell long, parts int"))
        dealt, parts = dealt.join(of, "cell", "left"), F.col("parts")
    dealt = dealt.select("cell", F.coalesce(F.pmod(F.xxhash64("cell", "node"), parts).cast("int"), F.lit(-1)).alias("part"), "node", *words)
    edges = _cell_forests(dealt)
    if hot:
        trees = cut(edges)
        tops = trees.where("b is null").select("cell", F.lit(-1).alias("part"), F.col("a").alias("node"))
        edges = trees.unionByName(_cell_forests(tops.join(nodes.select("node", *words).hint("merge"), "node").select("cell", "part", "node", *words)))

    groups = cut(components(edges.where("b is not null").select("a", "b")).select("node", F.col("root").alias("comp")))
    rest = cut(_missed(t.select("text"), nodes.select("node", "size", "odd"), groups, similarity, shingle))
    if not rest.isEmpty():
        groups = cut(components(rest.unionByName(groups.select(F.col("node").alias("a"), F.col("comp").alias("b")))).select("node", F.col("root").alias("comp")))
    members = groups.unionByName(groups.select(F.col("comp").alias("node"), "comp").distinct())  # roots are members too
    sizes = members.groupBy("comp").agg(F.count("*").alias("n"))
    members = members.join(sizes.hint("merge"), "comp")
    owners = cut(nodes.join(members.hint("merge"), "node").select("k._k1", "k._k2", "node", "comp", "n"))

    def hashed(batches):
        for b in batches:
            sets = pa.array([_shingles(x, shingle).tobytes() for x in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "comp", "n")), sets], names=["node", "comp", "n", "hashes"])

    # one text for each node
    texts = t.select("_k1", "_k2", "text").join(owners.hint("merge"), ["_k1", "_k2"]).dropDuplicates(["node"])
    sets = cut(texts.select("node", "comp", "n", "text").mapInArrow(hashed, "node long, comp long, n long, hashes binary"))
    together = sets.where(F.col("n") <= BLOCK).select("comp", F.lit(0).alias("first"), F.lit(0).alias("second"), F.lit(0).alias("block"), "node", "hashes")
    found = _verified(together, similarity)
    large = sets.where(F.col("n") > BLOCK).drop("n")
    if not large.isEmpty():
        found = found.unionByName(_large_components(large, similarity))
    roots = components(found)
    owned = cut(nodes.join(roots.withColumnRenamed("node", "m").hint("merge"), F.col("node") == F.col("m"), "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    ids = cut(owned.groupBy("root").agg(F.min("least").alias("component_id")))  # a row from each task for a root, and only then the join
    named = cut(owned.join(ids.hint("merge"), "root").select("node", "component_id", "root"))
    return join_hot(fps.select("id", "node", "_k1", "_k2"), named, "node").select(F.col("id").alias("doc_id"), "component_id", "root", "_k1", "_k2")


def _cell_forests(dealt: DataFrame) -> DataFrame:
    """``a, b, cell``: links of a spanning forest of each part of a cell (``cell, part, node, w0`` to ``w3``). A part of a hot cell (``part`` from 0) also
    gives the smallest node of each tree, as ``a`` without ``b``."""

    def run(batches):
        key, rest = np.zeros((0, 2), np.int64), np.zeros((0, 5), np.int64)
        for b in batches:
            key = np.concatenate((key, np.stack([b.column(i).to_numpy().astype(np.int64) for i in (0, 1)], axis=1)))
            rest = np.concatenate((rest, np.stack([b.column(i).to_numpy() for i in range(2, 7)], axis=1)))
            if len(key):  # the last part may go on
                ends = np.flatnonzero((key != key[-1]).any(axis=1))
                done = int(ends[-1]) + 1 if len(ends) else 0
                yield from trees(key[:done], rest[:done])
                key, rest = key[done:], rest[done:]
        yield from trees(key, rest)

    def trees(key, rest):
        if not len(key):
            return
        number = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).any(axis=1).astype(np.int64))))
        node, at = rest[:, 0], np.arange(len(key))
        found = list(forest(number, at, rest[:, 1:].copy().view(np.uint64)))  # signed words would count the bits of their absolute value
        x, y = (np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in (0, 1))
        out = [(np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), key[x, 0], np.zeros(len(x), bool))]
        label = at.copy()
        while len(x):  # nodes are sorted within a part, so the smallest place is the smallest node
            before, low = label.copy(), np.minimum(label[x], label[y])
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            label = label[label]
            if (label == before).all():
                break
        top = np.flatnonzero((key[:, 1] >= 0) & (label == at))
        out.append((node[top], node[top], key[top, 0], np.ones(len(top), bool)))
        a, b, cell, alone = (np.concatenate([o[i] for o in out]) for i in range(4))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=alone), pa.array(cell)], names=["a", "b", "cell"])

    return dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "node").mapInArrow(run, "a long, b long, cell long")


def _company(dealt: DataFrame, by: str) -> DataFrame:
    """The rows (``cell, node`` and maybe others) of cells that have more than one ``by``, once each, and those of cell 0."""
    names = dealt.columns
    place = names.index(by)

    def run(batches):
        held = np.zeros((0, len(names)), np.int64)
        for b in batches:
            held = np.concatenate((held, np.stack([b.column(i).to_numpy() for i in range(len(names))], axis=1)))
            done = int(np.searchsorted(held[:, 0], held[-1, 0])) if len(held) else 0  # the last cell may go on
            yield from kept(held[:done])
            held = held[done:]
        yield from kept(held)

    def kept(rows):
        rows = rows[np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))] if len(rows) else rows
        if not len(rows):
            return
        first = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0])))
        many = np.minimum.reduceat(rows[:, place], first) != np.maximum.reduceat(rows[:, place], first)
        rows = rows[np.repeat(many | (rows[first, 0] == 0), np.diff(np.append(first, len(rows))))]
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, i].copy()) for i in range(len(names))], names=names)

    return dealt.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _missed(texts: DataFrame, nodes: DataFrame, groups: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """``a, b``: links of candidates (``nodes``: ``node, size, odd``) that ``groups`` (``node, comp``) have not joined, enough to join all that can be similar.

    Texts meet in the cells of ``segments``, which lose no link. Those that are in one group already are compared with each other anyway, so only cells of more
    groups are left, and there texts that ``parity`` can't tell apart are candidates. A cell of more than ``CELL`` texts is cut in parts, each two of which meet.
    Texts with too few segments meet all others.
    """

    def deal(batches):
        seen: set[int] = set()  # copies once for each task, or for so many texts
        for b in batches:
            for k in range(0, b.num_rows, 500):
                cells, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for x in b.column("text").slice(k, 500).to_pylist():
                    s = _shingles(x, shingle)
                    node = np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64)
                    if node not in seen:
                        found, short = segments(s, similarity)
                        cells += [found.view(np.int64), np.zeros(int(short), np.int64)]
                        of.append(np.full(len(found) + short, node))
                        if len(seen) >= 100_000:
                            seen.clear()
                        seen.add(node)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(of))], names=["cell", "node"])

    met = cut(_company(texts.mapInArrow(deal, "cell long, node long"), "node"))
    named = met.where("cell <> 0").join(groups.hint("merge"), "node", "left").select("cell", "node", F.coalesce("comp", "node").alias("comp"))
    apart = cut(_company(named, "comp"))
    parts = apart.groupBy("cell").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: (F.col("parts") == 1) | (j != F.col("part")))
    blocks = apart.join(parts.hint("merge"), "cell").withColumn("part", mine).withColumn("other", F.explode(others))
    blocks = blocks.select("cell", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"), "node", "comp").join(nodes.hint("merge"), "node")

    def link(batches):
        key, rest, odd = np.zeros((0, 3), np.int64), np.zeros((0, 3), np.int64), np.zeros((0, PARITY // 64), np.uint64)
        for b in batches:
            key = np.concatenate((key, np.stack([b.column(c).to_numpy() for c in ("cell", "first", "second")], axis=1)))
            rest = np.concatenate((rest, np.stack([b.column(c).to_numpy() for c in ("node", "comp", "size")], axis=1)))
            odd = np.concatenate((odd, np.frombuffer(b"".join(b.column("odd").to_pylist()), np.uint64).reshape(-1, PARITY // 64)))
            if len(key):  # the last block may go on
                ends = np.flatnonzero((key != key[-1]).any(axis=1))
                done = int(ends[-1]) + 1 if len(ends) else 0
                yield from linked(key[:done], rest[:done], odd[:done])
                key, rest, odd = key[done:], rest[done:], odd[done:]
        yield from linked(key, rest, odd)

    def linked(key, rest, odd):
        if len(key):
            first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
            out = [x for a, z in zip(first, np.append(first[1:], len(key)), strict=True) for x in apart_links(*rest[a:z].T, odd[a:z], similarity)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["a", "b"])

    blocks = blocks.select("cell", F.col("first").cast("long").alias("first"), F.col("second").cast("long").alias("second"), "node", "comp", "size", "odd")
    out = blocks.repartition("cell", "first", "second").sortWithinPartitions("cell", "first", "second", "node").mapInArrow(link, "a long, b long").distinct()
    short = met.where("cell = 0").select("node").distinct()
    if short.isEmpty():
        return out

    def every(batches):
        for b in batches:
            m, o = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(-1, PARITY // 64) for c in ("odd", "other"))
            ok = np.bitwise_count(m ^ o).sum(axis=1, dtype=np.int64) <= differing(b.column("size").to_numpy() + b.column("n").to_numpy(), similarity)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok)) for c in ("node", "b")], names=["a", "b"])

    few = F.broadcast(nodes.join(short, "node").select(F.col("node").alias("b"), F.col("size").alias("n"), F.col("odd").alias("other")))
    near_size = (F.col("size") >= F.col("n") * similarity - 1e-6) & (F.col("n") >= F.col("size") * similarity - 1e-6)
    return out.unionByName(nodes.join(few, near_size & (F.col("node") != F.col("b"))).mapInArrow(every, "a long, b long")).distinct()


def apart_links(node: np.ndarray, comp: np.ndarray, size: np.ndarray, odd: np.ndarray, similarity: float):
    """Links enough to join all nodes of one cell whose sets can have the similarity, by their sizes and parities; nodes of one ``comp`` are joined already."""
    rest = np.arange(len(node))
    while len(rest):
        front, rest = [rest[:1]], rest[1:]
        while front and len(rest):
            for i in front.pop():
                small, large = np.minimum(size[rest], size[i]), np.maximum(size[rest], size[i])
                ok = np.bitwise_count(odd[rest] ^ odd[i]).sum(axis=1, dtype=np.int64) <= differing(small + large, similarity)
                ok &= (small >= large * similarity - 1e-6) & (comp[rest] != comp[i])
                if ok.any():
                    yield np.full(np.count_nonzero(ok), node[i]), node[rest[ok]]
                ok |= comp[rest] == comp[i]
                if ok.any():
                    front.append(rest[ok])
                    rest = rest[~ok]
                if not len(rest):
                    break


def _verified(blocks: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: links of each ``comp, first, second`` (``block, node, hashes``), as ``verify_blocks`` gives them."""
    sets = blocks.repartition("comp", "first", "second").sortWithinPartitions("comp", "first", "second")
    return sets.mapInArrow(lambda batches: verify_blocks(batches, similarity), "a long, b long")


def _large_components(large: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: links enough to join all that links join among the texts (``comp, node, hashes``) of each large candidate component."""
    rank = F.row_number().over(Window.partitionBy("comp").orderBy("node"))
    first = large.select("comp", "node").withColumn("r", rank).where(F.col("r") <= PIVOTS).select("node", (F.col("r") - 1).alias("pivot"))
    parts = large.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    pivots = large.join(first.hint("merge"), "node").join(parts.hint("merge"), "comp")
    pivots = pivots.select("comp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "pivot", "node", "hashes")
    # parts of a component by their tasks' own numbers: each has all of the component's pivots
    members = large.join(parts.hint("merge"), "comp").select("comp", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(-1).alias("pivot"), "node", "hashes")

    def link(table: pa.Table) -> pa.Table:
        """The pivots that each member links to, as bits."""
        table = table.sort_by("pivot")
        sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        pivot = table.column("pivot").to_numpy()
        n = int((pivot < 0).sum())
        bits = similar(sets[:n], sets[n:], similarity).astype(np.int64) @ (1 << pivot[n:].astype(np.int64)) if n else np.zeros(0, np.int64)
        return pa.table({"comp": table.column("comp")[:n], "node": table.column("node")[:n], "bits": pa.array(bits, pa.int64())})

    linked = cut(members.unionByName(pivots).groupBy("comp", "part").applyInArrow(link, "comp long, node long, bits long"))

    def join(table: pa.Table) -> pa.Table:
        """Groups of pivots that members join: each different set of bits once."""
        merged: list[int] = []
        for b in table.column("bits").to_pylist():
            for m in [m for m in merged if m & b]:
                merged.remove(m)
                b |= m
            merged.append(b)
        comp = table.column("comp")[0].as_py()
        return pa.table({"comp": pa.array([comp] * len(merged), pa.int64()), "group": pa.array(merged, pa.int64())})

    # at most 2 ** PIVOTS different sets of bits, and PIVOTS groups, for a component
    joined = linked.where("bits > 0").select("comp", "bits").distinct().groupBy("comp").applyInArrow(join, "comp long, group long")
    joined = joined.groupBy("comp").agg(F.collect_list("group").alias("groups"))
    label = linked.join(joined.hint("merge"), "comp", "left").select("comp", "node", F.get(F.filter("groups", lambda g: g.bitwiseAND(F.col("bits")) > 0), F.lit(0)).alias("label"))
    label = cut(label.select("comp", "node", F.coalesce("label", F.lit(0)).alias("label")))  # 0: no pivot

    # groups have blocks of their own, whose texts are joined already; what pivots leave is mixed, and small groups with it
    sizes = label.groupBy("comp", "label").agg(F.count("*").alias("n"), F.min("node").alias("root"))
    sizes = sizes.withColumn("own", F.when((F.col("label") > 0) & (F.col("n") >= BLOCK // 4), F.col("label")).otherwise(0))
    blocks = sizes.groupBy("comp", "own").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("k"), F.collect_list(F.struct("label", "root")).alias("labels"))
    blocks = blocks.groupBy("comp").agg(F.sort_array(F.collect_list(F.struct("own", "k", "labels"))).alias("all"))
    of = label.join(blocks.hint("merge"), "comp")
    mine = F.filter("all", lambda x: F.exists(x.labels, lambda y: y.label == F.col("label")))[0]
    of = of.select("comp", "node", "label", "all", mine.alias("mine"))
    # blocks are numbered in the order of ``all``
    before = F.aggregate(F.filter("all", lambda x: x.own < F.col("mine.own")), F.lit(0), lambda a, x: a + x.k)
    every = F.aggregate("all", F.lit(0), lambda a, x: a + x.k)
    of = of.select("comp", "node", "label", F.col("mine.own").alias("own"), F.col("mine.k").alias("k"), F.filter("mine.labels", lambda y: y.label == F.col("label"))[0].root.alias("root"), before.alias("before"), every.alias("every"))
    others = F.filter(F.sequence(F.lit(0), F.col("every") - 1), lambda j: (F.col("own") == 0) | (j < F.col("before")) | (j >= F.col("before") + F.col("k")))
    of = cut(of.select("node", "label", "root", (F.col("before") + F.pmod(F.xxhash64("node"), F.col("k"))).cast("int").alias("block"), others.alias("others")))
    rest = large.join(of.select("node", "block", "others").hint("merge"), "node").withColumn("other", F.explode("others"))
    rest = rest.select("comp", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "node", "hashes")
    stars = of.where((F.col("label") > 0) & (F.col("node") != F.col("root"))).select(F.col("node").alias("a"), F.col("root").alias("b"))
    return stars.unionByName(_verified(rest, similarity))


def near_duplicates(docs: DataFrame, distance: int = 4, blocks: int = 8, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with ``doc_id, fingerprint, component_id, root`` and the keys ``_k1, _k2`` of its row.

    ``fingerprint`` is the SimHash of the whole text in 16 hex digits. Fingerprints that differ in
    ``distance`` bits or fewer link; ``component_id`` is the smallest id that links reach. ``root``
    is the component itself (its smallest fingerprint): components may share an id or have none.
    Copies share a fingerprint, so only different fingerprints are compared.

    Null and empty texts have the fingerprint zero and link like any other. Repeated rows give
    repeated results. Null ids are no candidates for the smallest id; a component of null ids only
    has a null id. An empty table gives no rows. Other columns are not read.
    """
    fps = cut(fingerprints(docs, shingle, id_col, text_col))
    distinct = cut(fps.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(distinct.select("fp"), distance, blocks))
    owned = cut(distinct.join(roots.hint("merge"), distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = cut(owned.groupBy("root").agg(F.min("least").alias("component_id")))  # a row from each task for a root, and only then the join
    named = cut(owned.join(ids.hint("merge"), "root").select("fp", "component_id", "root"))
    return join_hot(fps, named, "fp").select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root", "_k1", "_k2")
