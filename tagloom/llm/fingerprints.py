"""Order-free document fingerprints: a homomorphic hash of the multiset of paragraphs."""

from __future__ import annotations

from hashlib import blake2b, sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

STRONG, LANES = 4, 128
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD], dtype=np.uint64)


class Fingerprint:
    """The sum of the vectors of a text's paragraphs (its lines).

    A paragraph's vector has 4 lanes modulo 2**64 cut from its BLAKE2b digest, which decide
    equality, and 128 lanes modulo 2**32 that add up signed hashes of its word triples, whose
    cosine is the likeness. Sums don't depend on the order of paragraphs; ``+`` inserts the
    paragraphs of another fingerprint and ``-`` deletes them.
    """

    __slots__ = ("lanes", "strong")

    def __init__(self, strong: np.ndarray, lanes: np.ndarray):
        self.strong, self.lanes = strong, lanes

    @classmethod
    def of(cls, text: str) -> Fingerprint:
        digests, hashes = [], []
        for p in text.encode("utf-8", "surrogatepass").split(b"\n"):
            digests.append(blake2b(p, digest_size=8 * STRONG).digest())
            hashes += (0, 0)  # stand before the first word, so that each word ends one triple
            hashes += map(crc32, p.split())
        strong = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, STRONG).sum(axis=0, dtype=np.uint64)
        h = np.array(hashes, dtype=np.uint64)
        x = h[:-2] * _MUL[0] + h[1:-1] * _MUL[1] + h[2:] * _MUL[2]
        x = (x ^ (x >> np.uint64(29)))[h[2:] > 0] * _MUL[3]
        sign = ((x >> np.uint64(56)) & np.uint64(1)).astype(np.float64) * 2 - 1
        lanes = np.bincount((x >> np.uint64(57)).astype(np.int64), weights=sign, minlength=LANES).astype(np.int64)
        return cls(strong, lanes.astype(np.int32))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.strong + other.strong, self.lanes + other.lanes)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.strong - other.strong, self.lanes - other.lanes)

    def __eq__(self, other) -> bool:
        return bool((self.strong == other.strong).all() and (self.lanes == other.lanes).all())

    __hash__ = None

    def __str__(self) -> str:
        return self.strong.astype(">u8").tobytes().hex() + self.lanes.astype(">i4").tobytes().hex()

    def likeness(self, other: Fingerprint) -> float:
        """0 to 1: 1 for equal fingerprints, else the cosine of the word-triple lanes, 0 at least."""
        if self == other:
            return 1.0
        a, b = self.lanes.astype(np.float64), other.lanes.astype(np.float64)
        norm = float(np.sqrt((a @ a) * (b @ b)))
        return min(1.0, max(0.0, float(a @ b) / norm)) if norm else 0.0


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_a_range: int = 1000, max_ranges: int = 65_536, prefix: int = 64) -> DataFrame:
    """``id, text, next``: each document's text and that of the next one by descending id; after the last comes the first.

    Rows, in the order of ids of any type that has one and then of texts, are cut into ranges of about equal row counts, by a sample of
    some 20 rows a range. Rows of one id, or without one, are cut by the first ``prefix`` characters of their texts. The first document of each range also goes to
    the range before it, so no task sees more than a range and the text moves once. The driver holds a bound and a first row's id and prefix for each
    range, so there are ``max_ranges`` at most; beyond ``max_ranges * rows_a_range`` rows they get
    longer, which changes no result (a range is sorted by Spark, which spills).
    """
    t = pick(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    n = t.count()
    k = max(1, min(max_ranges, n // rows_a_range))
    head = F.substring("text", 1, prefix)
    some = t.where(F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("null")), "text"), F.lit(max(1, n // (20 * k)))) == 0)
    some = [tuple(r) for r in some.select("id", head).collect()] if k > 1 else []
    # the order of results: ids descend, null ones last, and texts ascend by their bytes
    some.sort(key=lambda r: r[1].encode())
    some = [*sorted((r for r in some if r[0] is not None), key=lambda r: r[0], reverse=True), *(r for r in some if r[0] is None)]
    bounds = list(dict.fromkeys(some[len(some) * i // k] for i in range(1, k))) if some else []
    at = F.lit(0)
    if bounds:  # the number of bounds up to the row, by halving steps
        steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
        of = lambda i, part: F.element_at(F.lit([b[part] for b in bounds]) if part else F.lit([b[0] for b in bounds]).cast(f"array<{dict(t.dtypes)['id']}>"), F.least(i, F.lit(len(bounds))))

        def passed(i):
            bid, text = of(i, 0), of(i, 1)
            alike = text <= head
            here = F.when(F.col("id").isNull(), bid.isNotNull() | alike).otherwise(bid.isNotNull() & ((bid > F.col("id")) | ((bid == F.col("id")) & alike)))
            return (i <= len(bounds)) & here

        at = F.aggregate(F.lit(steps), F.lit(0), lambda pos, step: F.when(passed(pos + step), pos + step).otherwise(pos))
    t = t.withColumn("range", at)
    firsts = {r["range"]: r["first"] for r in t.groupBy("range").agg(F.max("id").alias("first")).collect()}
    if not firsts:
        return t.select("id", "text", F.lit("").alias("next"))
    kind = dict(t.dtypes)["id"]
    by_range = lambda values, cast: F.element_at(F.lit([values.get(r) for r in range(max(firsts) + 1)]).cast(f"array<{cast}>"), F.col("range") + 1)
    leads = F.col("id").eqNullSafe(by_range(firsts, kind))
    texts = {r["range"]: r["text"] for r in t.where(leads).groupBy("range").agg(F.min(head).alias("text")).collect()}
    present = sorted(firsts)
    before = {r: present[i - 1] for i, r in enumerate(present)}  # the last range takes the first one's head
    goes = lambda r, lent: F.struct(r.alias("r"), F.lit(lent).alias("lent"))
    own = goes(F.col("range"), 0)
    is_head = leads & (head == by_range(texts, "string"))
    t = t.withColumn("to", F.explode(F.when(is_head, F.array(own, goes(by_range(before, "int"), 1))).otherwise(F.array(own))))
    t = t.select("id", "text", "to.r", "to.lent")
    w = Window.partitionBy("r").orderBy("lent", F.col("id").desc_nulls_last(), "text")
    return t.select("id", "text", "lent", F.lead("text").over(w).alias("next")).where("lent = 0").select("id", "text", F.coalesce("next", F.lit("")).alias("next"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, the last half of whose code points are replaced.

    The replacement is as many first code points (or all) of the next document by descending id.
    Columns: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    Null text is empty; a text of one code point isn't edited. Ties of ids are ordered by text,
    null ids come last. A single document is its own next one. An empty table gives no rows.
    Other columns are not read.
    """
    t = with_next(docs, id_col, text_col)

    def run(batches):
        known = ("", Fingerprint.of(""))
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text, following in zip(b.column("text").to_pylist(), b.column("next").to_pylist(), strict=True):
                own = known[1] if known[0] == text else Fingerprint.of(text)
                nxt = own if following == text else Fingerprint.of(following)
                known = (following, nxt)  # rows come in order, so this is the next row's own
                n = len(text)
                edited = text[: n - n // 2] + following[: n // 2]
                ed = own if edited == text else Fingerprint.of(edited)
                for c, x in zip(cols, (n, sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), str(own), str(ed), own.likeness(ed), own.likeness(nxt)), strict=True):
                    c.append(x)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("id"), *map(pa.array, cols, kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return t.mapInArrow(run, f"doc_id {dict(t.dtypes)['id']}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
