"""Vector code compression: product codes whose nearest entries are found by exact integer matrix products."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, pick

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that are coded at a time.
ROWS = 2048


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """``x`` as digits of ``bits`` bits, lowest first; the last one has the sign. As many as the largest integer needs."""
    out, most = [], int(max(x.max(initial=0), -x.min(initial=0)))
    while most >> bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
        most = (most >> bits) + 1  # a negative rest is rounded away from zero
    return [*out, x.astype(np.float64)]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All dot products of the rows of two int64 matrices, as int64.

    Each limb product is a float64 matrix product whose sums stay below 2**53, hence exact; they are shifted
    and added as integers. Right wherever the true product fits in 63 bits.
    """
    bits = (52 - max(1, a.shape[1]).bit_length()) // 2
    out = np.zeros((len(a), len(b)), np.int64)
    right = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            out += (x @ y.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each row and its squared distance."""
    d = (book * book).sum(axis=1) - 2 * exact_products(x, book)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at] + (x * x).sum(axis=1)


@dataclass
class Codebooks:
    """``books`` has a matrix of entries for each part; ``dims`` is the length of the vectors, ``edges`` cut them into parts."""

    dims: int
    edges: list[int]
    books: list[np.ndarray]
    scale: int = SCALE

    @property
    def limit(self) -> int:
        """Larger components are set to this, so that an error fits in 63 bits."""
        return math.isqrt((1 << 62) // max(1, self.dims)) // 2

    def whole(self, values: np.ndarray, n: int) -> np.ndarray:
        """``n`` vectors of floats as rows of integers."""
        return np.clip(np.floor(values.reshape(n, self.dims) * self.scale), -self.limit, self.limit).astype(np.int64)

    def assign(self, x: np.ndarray):
        """For each part its number, the rows' entries and squared distances."""
        for p, (a, b) in enumerate(zip(self.edges, self.edges[1:], strict=False)):
            yield p, *nearest(x[:, a:b], self.books[p])

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for book in self.books for v in book.ravel().tolist()).encode()).hexdigest()


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """``id, label, v``: rows whose vector is there and holds finite numbers only."""
    t = pick(vectors, id=id_col, label=label_col, v=vector_col).withColumn("v", F.col("v").cast("array<double>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return t.where(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))


def _matrix(batch: pa.RecordBatch, books: Codebooks):
    """The batch's vectors as integers, some ``ROWS`` at a time, and the rows they are."""
    for i in range(0, len(batch), ROWS):
        c = batch.slice(i, ROWS)
        fits = pc.equal(pc.list_value_length(c.column("v")), books.dims)
        part = c.filter(fits)
        yield c.filter(pc.invert(fits)), part, books.whole(part.column("v").flatten().to_numpy(zero_copy_only=False), len(part))


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks:
    """Codebooks of all kept vectors.

    A codebook starts as that part of the ``entries`` vectors of the smallest ids. Each round assigns all vectors
    and replaces entries by the floor of their parts' means. A task passes on one sum for each part and entry,
    these are added up by Spark, and only the new codebooks come to the driver.

    Vectors are as long as most are (the longer, if two lengths tie); others aren't learned from. Null ids come last,
    equal ids go by their vectors. Fewer vectors give smaller codebooks, none give empty ones.
    """
    kept = _kept(vectors, id_col, vector_col, None)
    common = kept.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = common["dims"] if common else 0
    edges = [round(i * dims / parts) for i in range(parts + 1)]
    books = Codebooks(dims, edges, [], scale)
    first = kept.where(F.size("v") == dims).orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    x = books.whole(np.array([r["v"] for r in first], np.float64), len(first))
    books.books = [x[:, a:b].copy() for a, b in zip(edges, edges[1:], strict=False)]
    if not first:
        return books

    for _ in range(rounds):
        sums = kept.mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>")
        each = sums.select("part", "entry", "n", F.posexplode("sums").alias("pos", "s"))
        each = each.groupBy("part", "entry", "pos").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        new = [b.copy() for b in books.books]
        for r in each.collect():  # a number for each component of the codebooks
            new[r["part"]][r["entry"], r["pos"]] = int(r["s"]) // int(r["n"])
        books = Codebooks(dims, edges, new, scale)
    return books


def _sums(books: Codebooks):
    def run(batches):
        n = [np.zeros(len(b), np.int64) for b in books.books]
        s = [np.zeros_like(b) for b in books.books]
        for b in batches:
            for _, _, x in _matrix(b, books):
                for p, at, _ in books.assign(x):
                    n[p] += np.bincount(at, minlength=len(n[p]))
                    np.add.at(s[p], at, x[:, books.edges[p] : books.edges[p + 1]])
        rows = [(p, e, int(n[p][e]), s[p][e].tolist()) for p in range(len(n)) for e in np.flatnonzero(n[p]).tolist()]
        if rows:
            types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["part", "entry", "n", "sums"])

    return run


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """Each kept vector with ``vec_id, label, code, error``; vectors of another length than the codebooks' have a null code and error."""
    t = _kept(vectors, id_col, vector_col, label_col)
    kinds = dict(t.dtypes)

    def run(batches):
        for b in batches:
            for other, rows, x in _matrix(b, books):
                code, error = np.zeros((len(x), len(books.books)), np.uint8), np.zeros(len(x), np.int64)
                for p, at, d in books.assign(x) if len(x) else ():
                    code[:, p], error = at, error + d
                cols = [pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)]
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("label"), *cols], names=["vec_id", "label", "code", "error"])
                if len(other):
                    yield pa.RecordBatch.from_arrays([other.column("id"), other.column("label"), pa.nulls(len(other), pa.string()), pa.nulls(len(other), pa.int64())], names=["vec_id", "label", "code", "error"])

    return t.mapInArrow(run, f"vec_id {kinds['id']}, label {kinds['label']}, code string, error long")


def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """Each kept vector with ``vec_id, label, code, error, label_error, codebooks_sha256``.

    Components become integers (the floor of ``scale`` times the component); vectors are cut into ``parts`` parts, as equal as
    their length allows, and each is replaced by the number of its codebook's nearest entry, ties to the lower. Distances are exact (``exact_products``).
    ``code`` has two hex digits a part, so ``entries`` is 256 at most. ``label_error`` is the sum of the errors of equal labels, nulls together;
    null if it doesn't fit in a long.

    Null vectors and those with null or non-finite components are dropped. Components whose squared distances wouldn't fit in
    a long (some 10**8 in 64 dimensions) are set to the largest that do. Empty vectors have an error of 0. Vectors of another
    length than most have a null code and error. Repeated rows give repeated results and count each time. An empty table
    gives no rows. Other columns are not read.
    """
    if entries > 256:
        raise ValueError("two hex digits hold 256 entries at most")
    books = train(vectors, parts, entries, rounds, scale, id_col, vector_col)
    coded = cut(encode(vectors, books, id_col, vector_col, label_col))
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s")).select("label", F.col("s").try_cast("long").alias("label_error"))
    return join_hot(coded, sums, "label").withColumn("codebooks_sha256", F.lit(books.sha256()))
