"""Most similar vectors by score-aware anisotropic quantisation.

Unit vectors are cut into pairs of dimensions, each coded in four bits by the nearest of 16
codewords, where nearest is not by squared error alone: an error parallel to the vector changes
the high inner products, which are the ones that matter, so it weighs
eta = (d - 1) T^2 / (1 - T^2) times an orthogonal one. Codes are chosen by coordinate descent and
codebooks by the normal equations of the same loss, in turn, on a bounded sample. Every row is
coded; two codes share a byte.

Rows lie in cells around centres, and neighbouring cells in parts, one to a task. A query visits the
cells whose centres are nearest to it: as many as the neighbours of sampled rows within the sample
ask for at the wanted recall. (They are farther away than those among all rows, so this errs on the
safe side.) It travels once to each part that has such a cell; queries stay on the executors throughout.

A scan keeps a table of 256 partial inner products per query and byte, adds them up over the
codes of the visited cells for many queries at once, and hands the best rows to exact reranking, with
every other row that by its code's error could still be among the best. A task returns k rows a
query; they are merged by query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaverlake.llm.common import one_row_per_key, ragged
from quaverlake.session import parallelism, stored

CODEWORDS = 16
#: Rows of the sample that codebooks and centres are fitted to (for centres PER_CENTRE each, if that is more); the index is of all rows.
SAMPLE = 8192
PER_CENTRE = 32
#: Inner products from this one on are what the loss cares about.
THRESHOLD = 0.2
#: Rows of a cell, about; CELLS is the largest number of them, so that centres are a small table.
CELL = 1024
CELLS = 4096
#: Rows of a part.
PART = 65536
#: Queries scanned together.
TOGETHER = 64
#: Sampled queries that settle how many cells are visited.
TRIED = 1024

_PACKED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("ids", pa.list_(pa.string())), ("cells", pa.binary()), ("vectors", pa.binary())])
_PACKED_SQL = "part int, kind int, ids array<string>, cells binary, vectors binary"
_HITS = pa.schema([("query_id", pa.string()), ("neighbour_id", pa.string()), ("score", pa.float64())])


class Quantiser:
    """Codebooks (pairs of dimensions, codewords, 2) and the weight of parallel error."""

    def __init__(self, books: np.ndarray, eta: float):
        self.books, self.eta = books, eta

    @staticmethod
    def pad(x: np.ndarray) -> np.ndarray:
        """To a multiple of four dimensions, so that codes fill bytes."""
        return np.pad(x, ((0, 0), (0, -x.shape[1] % 4))).astype(np.float32, copy=False)

    @classmethod
    def fit(cls, sample: np.ndarray, threshold: float = THRESHOLD, rounds: int = 5) -> Quantiser:
        """``sample``: unit vectors, padded. Without any row the codewords are zero."""
        n, d = sample.shape
        eta = (d - 1) * threshold**2 / (1 - threshold**2)
        books = np.zeros((d // 2, CODEWORDS, 2), np.float32)
        if not n:
            return cls(books, eta)
        rng = np.random.default_rng(7)
        for s in range(d // 2):
            x = sample[:, 2 * s : 2 * s + 2]
            c = x[rng.choice(n, CODEWORDS, replace=n < CODEWORDS)].copy()
            for _ in range(8):
                near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
                size = np.bincount(near, minlength=CODEWORDS)
                for k in (0, 1):
                    c[:, k] = np.where(size > 0, np.bincount(near, x[:, k], CODEWORDS) / np.maximum(size, 1), c[:, k])
            books[s] = c
        own = cls(books, eta)
        width = books.size
        for _ in range(rounds):
            codes = own.encode(sample)
            at = (np.arange(d // 2) * CODEWORDS + codes) * 2
            v = np.zeros((n, width), np.float32)
            rows = np.arange(n)[:, None]
            v[rows, at], v[rows, at + 1] = sample[:, 0::2], sample[:, 1::2]
            count = np.repeat(np.bincount((at // 2).ravel(), minlength=width // 2), 2)
            left = (eta - 1) * (v.T @ v).astype(np.float64)
            left[np.diag_indices(width)] += count + 1e-3
            right = eta * v.sum(0, dtype=np.float64) + 1e-3 * own.books.ravel()
            own.books = np.linalg.solve(left, right).astype(np.float32).reshape(books.shape)
        return own

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """A code per pair of dimensions, by coordinate descent on the anisotropic loss."""
        pairs = x.shape[1] // 2
        inner = [x[:, 2 * s : 2 * s + 2] @ self.books[s].T for s in range(pairs)]
        square = (self.books**2).sum(2)
        codes = np.stack([np.argmin(square[s] - 2 * inner[s], axis=1) for s in range(pairs)], axis=1)
        rows = np.arange(len(x))
        total = (x * x).sum(1) - sum(inner[s][rows, codes[:, s]] for s in range(pairs))
        for _ in range(sweeps):
            for s in range(pairs):
                rest = total + inner[s][rows, codes[:, s]]
                codes[:, s] = np.argmin(square[s] - 2 * inner[s] + (self.eta - 1) * (rest[:, None] - inner[s]) ** 2, axis=1)
                total = rest - inner[s][rows, codes[:, s]]
        return codes

    def pack(self, x: np.ndarray) -> np.ndarray:
        codes = self.encode(x).astype(np.uint8)
        return codes[:, 0::2] | (codes[:, 1::2] << 4)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Rows of what ``codes`` (bytes of a code, rows) stand for."""
        halves = np.stack([codes & 15, codes >> 4], axis=1).reshape(-1, codes.shape[1])
        return np.concatenate([self.books[s][c] for s, c in enumerate(halves)], axis=1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(bytes of a code, 256, queries): partial inner products."""
        part = np.einsum("qsk,sck->scq", queries.reshape(len(queries), -1, 2), self.books)
        low, high = part[0::2], part[1::2]
        return np.ascontiguousarray((high[:, :, None] + low[:, None, :]).reshape(len(low), 256, len(queries)))


def _unit(lists: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Raw vectors of the rows that have one, and which these are."""
    flat, lengths = ragged(lists)
    good = lengths == dims
    x = flat[np.repeat(good, lengths)].reshape(-1, dims)
    wide = x.astype(np.float64)
    norm = np.sqrt((wide * wide).sum(1))
    fine = np.isfinite(norm) & (norm > 0)
    good[np.flatnonzero(good)[~fine]] = False
    return x[fine], good


def _normal(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double; multiples of one vector by a power of two, or exact ones, become the same."""
    wide = x.astype(np.float64)
    wide = wide / np.abs(wide).max(1, initial=0, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(1, keepdims=True))


def centres_of(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; a centre that nothing is near to stays where it was."""
    rng = np.random.default_rng(13)
    c = sample[rng.choice(len(sample), cells, replace=len(sample) < cells)].copy()
    for _ in range(rounds):
        near = nearest(sample, c)
        order = np.argsort(near, kind="stable")
        edges = np.flatnonzero(np.diff(near[order], prepend=-1))
        if len(edges):
            sums = np.add.reduceat(sample[order], edges, axis=0)
            norm = np.sqrt((sums * sums).sum(1, keepdims=True))
            c[near[order][edges]] = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c[near[order][edges]])
    return _in_line(c)


def _in_line(c: np.ndarray) -> np.ndarray:
    """Centres in an order in which near ones are together: halved again and again along the longest axis."""
    if len(c) <= 2:
        return c
    spread = c - c.mean(0)
    axis = np.linalg.svd(spread, full_matrices=False)[2][0] if len(c) > 8 else spread[0]
    order = np.argsort(spread @ axis, kind="stable")
    half = len(c) // 2
    return np.concatenate([_in_line(c[order[:half]]), _in_line(c[order[half:]])])


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def cells_to_visit(sample: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """How many of the nearest cells hold ``recall`` of the k nearest sampled neighbours of sampled rows."""
    if len(sample) <= k or len(centres) < 2:
        return len(centres)
    near, needed = nearest(sample, centres), []
    for i in range(0, min(TRIED, len(sample)), 256):
        q = sample[i : min(i + 256, TRIED)]
        score = q @ sample.T
        score[np.arange(len(q)), i + np.arange(len(q))] = -2
        best = np.argpartition(score, -k, axis=1)[:, -k:]
        rank = np.argsort(np.argsort(-(q @ centres.T), axis=1), axis=1)
        needed.append(np.take_along_axis(rank, near[best], axis=1).ravel())
    return min(len(centres), int(np.quantile(np.concatenate(needed), recall, method="higher")) + 1)


class Plan:
    """Which parts a cell's rows are dealt to: several cells to a part, or a large cell to several parts."""

    def __init__(self, rows: np.ndarray, parts: int):
        quota = max(1, math.ceil(rows.sum() / max(1, parts)))
        self.first, self.split = np.zeros(len(rows), np.int64), np.ones(len(rows), np.int64)
        part, filled = 0, 0
        for c, n in enumerate(rows.tolist()):
            if filled and filled + n > 1.25 * quota:
                part, filled = part + 1, 0
            self.first[c], filled = part, filled + n
            self.split[c] = max(1, math.ceil(n / (1.25 * quota)))
            if self.split[c] > 1:
                part, filled = part + int(self.split[c]), 0
        self.parts = int((self.first + self.split).max()) if len(rows) else 1


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)


def _placed(centres: np.ndarray, dims: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(centres), np.int64)
        for batch in source:
            x, _ = _unit(batch.column("vec"), dims)
            counts += np.bincount(nearest(_normal(x), centres), minlength=len(centres))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres)), pa.int32()), pa.array(counts)], names=["cell", "rows"])

    return run


def _deal_rows(centres: np.ndarray, plan: Plan, dims: int):
    """All rows to their parts, a batch's rows of a part in one (kind 0)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in source:
            x, good = _unit(batch.column("vec"), dims)
            if not len(x):
                continue
            ids = batch.column("id").filter(pa.array(good))
            cell = nearest(_normal(x), centres)
            part = plan.first[cell] + (np.arange(len(x)) + turn) % plan.split[cell]
            turn += len(x)
            order = np.argsort(part, kind="stable")
            edges = [*np.flatnonzero(np.diff(part[order], prepend=-1)).tolist(), len(order)]
            yield _packed([(int(part[o[0]]), 0, ids.take(pa.array(o)).to_pylist(), cell[o].astype(np.int32).tobytes(), x[o].astype(np.float32).tobytes()) for o in (order[lo:hi] for lo, hi in zip(edges, edges[1:], strict=False))])

    return run


def _deal_queries(centres: np.ndarray, plan: Plan, visit: int, dims: int):
    """Each query to every part with a cell that it visits, with a mark for each cell of the part (kind 1)."""
    own = [np.flatnonzero((plan.first <= p) & (p < plan.first + plan.split)) for p in range(plan.parts)]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            x, good = _unit(batch.column("vec"), dims)
            if not len(x):
                continue
            ids = batch.column("id").filter(pa.array(good))
            near = _normal(x) @ centres.T
            visited = np.zeros(near.shape, bool)
            np.put_along_axis(visited, np.argpartition(-near, visit - 1, axis=1)[:, :visit], True, axis=1)
            rows = []
            for p, cells in enumerate(own):
                marks = visited[:, cells]
                o = np.flatnonzero(marks.any(1))
                if len(o):
                    rows.append((p, 1, ids.take(pa.array(o)).to_pylist(), np.packbits(marks[o], axis=1).tobytes(), x[o].astype(np.float32).tobytes()))
            if rows:
                yield _packed(rows)

    return run


class _Part:
    """Rows of one part, coded, in order of their cells."""

    def __init__(self, quantiser: Quantiser, packs: list[tuple], cells: np.ndarray, dims: int):
        ids = np.array([i for p in packs for i in p[0]], object)
        cell = np.concatenate([np.frombuffer(p[1], np.int32) for p in packs])
        raw = np.concatenate([np.frombuffer(p[2], np.float32) for p in packs]).reshape(-1, dims)
        order = np.argsort(cell, kind="stable")
        self.ids, self.exact = ids[order], _normal(raw[order])
        self.codes = np.concatenate([quantiser.pack(Quantiser.pad(self.exact[i : i + 8192])).T for i in range(0, len(ids), 8192)], axis=1).astype(np.intp)
        self.error = np.sqrt(((Quantiser.pad(self.exact) - quantiser.decode(self.codes)) ** 2).sum(1)) + 1e-5
        self.edges = np.searchsorted(cell[order], np.stack([cells, cells + 1]))

    def rows(self, marks: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(a, b) for a, b in self.edges[:, marks].T] or [np.zeros(0, np.int64)])


def _extended(scan: np.ndarray, error: np.ndarray, rows: np.ndarray, value: np.ndarray, k: int, exactly) -> tuple[np.ndarray, np.ndarray]:
    """The candidates of one query and their exact scores, with all other scanned rows that may be among the k + 1
    best (one of them may be the query itself): an exact score is at most ``error``, the length of what the code
    leaves out, above the scan's."""
    at = len(value) - min(k + 1, len(value))
    wanted = scan + error >= np.partition(value, at)[at]
    wanted[rows] = False
    more = np.flatnonzero(wanted)
    return (np.concatenate([rows, more]), np.concatenate([value, exactly(more)])) if len(more) else (rows, value)


def _together(quantiser: Quantiser, part: _Part, at: np.ndarray, names: np.ndarray, queries: np.ndarray, k: int, rerank: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The best rows among ``at`` for each of some queries, by table scan and exact reranking."""
    codes, error, n, width = part.codes[:, at], part.error[at], len(at), len(names)
    table = quantiser.tables(Quantiser.pad(queries))
    score = np.empty((n, width), np.float32)
    for lo in range(0, n, 1024):
        piece = score[lo : lo + 1024]
        np.take(table[0], codes[0, lo : lo + 1024], axis=0, out=piece, mode="clip")
        step = np.empty_like(piece)
        for j in range(1, len(codes)):
            np.take(table[j], codes[j, lo : lo + 1024], axis=0, out=step, mode="clip")
            piece += step
    take = min(n, rerank)
    score = np.ascontiguousarray(score.T)
    chosen = np.argpartition(score, n - take, axis=1)[:, n - take :] if take < n else np.broadcast_to(np.arange(n), (width, n))
    for q in range(width):
        x = queries[q]
        exactly = lambda rows, x=x: (part.exact[at[rows]] * x).sum(1)
        rows, value = chosen[q], exactly(chosen[q])
        if take < n:
            rows, value = _extended(score[q], error, rows, value, k, exactly)
        who = part.ids[at[rows]]
        other = who != names[q]
        who, value = who[other], value[other]
        if len(value) > k:
            floor = np.partition(value, len(value) - k)[len(value) - k]
            who, value = who[value >= floor], value[value >= floor]
            best = np.lexsort((who, -value))[:k]
            who, value = who[best], value[best]
        yield names[q], who, value


def _scan(quantiser: Quantiser, plan: Plan, dims: int, k: int, rerank: int):
    """Rows of one part sorted by kind: its vectors, then the queries that visit it."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: list[tuple] = []
        part: _Part | None = None
        cells = np.zeros(0, np.int64)
        for batch in source:
            for p, kind, ids, marks, vectors in zip(*[batch.column(f.name).to_pylist() for f in _PACKED], strict=True):
                if kind == 0:
                    packs.append((ids, marks, vectors))
                    continue
                if not packs and part is None:
                    continue
                if part is None:
                    cells = np.flatnonzero((plan.first <= p) & (p < plan.first + plan.split))
                    part, packs = _Part(quantiser, packs, cells, dims), []
                names = np.array(ids, object)
                x = _normal(np.frombuffer(vectors, np.float32).reshape(len(ids), dims))
                visits = np.unpackbits(np.frombuffer(marks, np.uint8).reshape(len(ids), -1), axis=1, count=len(cells)).astype(bool)
                order = np.lexsort(visits.T[::-1])
                found = []
                for lo in range(0, len(order), TOGETHER):
                    o = order[lo : lo + TOGETHER]
                    at = part.rows(visits[o].any(0))
                    if len(at):
                        found += _together(quantiser, part, at, names[o], x[o], k, rerank)
                if found:
                    name = [q for q, who, _ in found for _ in who]
                    yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array([w for _, who, _ in found for w in who], pa.string()), pa.array(np.concatenate([v for _, _, v in found]), pa.float64())], schema=_HITS)

    return run


def most_similar(
    vectors: DataFrame,
    queries: DataFrame,
    id_column: str,
    vector: str,
    query_id: str = "query_id",
    k: int = 5,
    dims: int = 64,
    rerank: int = 256,
    sample: int = SAMPLE,
    recall: float = 0.999,
) -> DataFrame:
    """(query_id, neighbour_id, score): for each distinct id in ``queries`` that has a vector, the
    ``k`` other ids with the highest cosine among the visited cells, equal scores by the smaller id.

    Each non-null id counts once (if its vectors differ, the largest in array order). Null and
    all-zero vectors, those with another length than ``dims`` and those with a null, NaN or infinite
    element take no part, neither as query nor as neighbour; a query without a vector has no rows.
    Of vectors of one direction (equal once divided by their largest element) the k + 1 smallest ids are
    indexed, which is all that a result can hold, so copies and multiples don't crowd a cell. ``recall`` is what the
    visited cells shall hold of the true neighbours (1.0: of the sampled rows' neighbours all); within them the
    result is exact: the ``rerank`` best by the codes are compared exactly, and then every other row that by its
    code's error may still be among the best. The driver holds the sample, at most CELLS centres and the
    number of rows of each; no query comes to it. An empty table gives no rows."""
    spark = vectors.sparkSession
    usable = F.col("vec").isNotNull() & (F.size("vec") == dims) & ~F.exists("vec", lambda x: x.isNull())
    base = vectors.select(F.col(id_column).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vec")).where(usable)
    largest = F.array_max(F.transform("vec", lambda x: F.abs(x))).cast("double")
    once = one_row_per_key(base, "id", "vec").withColumn("m", largest)
    direction = F.when((F.col("m") > 0) & (F.col("m") < float("inf")), F.transform(F.col("vec").cast("array<double>"), lambda x: x / F.col("m"))).otherwise(F.col("vec").cast("array<double>"))
    once = stored(once.select("id", "vec", F.xxhash64(direction).alias("towards"), "m"))
    n = once.count()
    cells = max(1, min(CELLS, n // CELL))

    wanted = max(sample, PER_CENTRE * cells)
    first = once.select("id", "vec").orderBy(F.xxhash64("id")).limit(wanted).toArrow()
    train = _normal(_unit(first.column("vec").combine_chunks(), dims)[0]) if first.num_rows else np.zeros((0, dims))
    if not len(train):
        return spark.createDataFrame([], "query_id string, neighbour_id string, score double")
    quantiser = Quantiser.fit(Quantiser.pad(train[:sample]))
    centres = centres_of(train, cells)
    visit = cells_to_visit(train[: max(sample, 4 * TRIED)], centres, k, recall)

    # only directions that more than k + 1 rows share, by their hashes, have to be told apart
    crowded = stored(once.groupBy("towards").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("towards"))
    rank = F.row_number().over(Window.partitionBy("same").orderBy("id"))
    many = once.join(crowded, "towards", "left_semi").withColumn("same", direction).withColumn("copy", rank).where(F.col("copy") <= k + 1)
    distinct = once.join(crowded, "towards", "left_anti").select("id", "vec").unionByName(many.select("id", "vec"))

    counts = np.zeros(cells, np.int64)
    for r in distinct.mapInArrow(_placed(centres, dims), "cell int, rows long").groupBy("cell").agg(F.sum("rows").alias("rows")).collect():
        counts[r.cell] = r.rows
    plan = Plan(counts, max(parallelism(spark), math.ceil(n / PART)))
    asked = queries.select(F.col(query_id).cast("string").alias("id")).where(F.col("id").isNotNull()).distinct()
    # few queries may lie in one file; over all tasks each pack is small
    found = once.join(asked, "id", "left_semi").select("id", "vec")
    dealt = distinct.mapInArrow(_deal_rows(centres, plan, dims), _PACKED_SQL).unionByName(found.mapInArrow(_deal_queries(centres, plan, visit, dims), _PACKED_SQL))
    gathered = dealt.repartitionById(plan.parts, F.col("part")).sortWithinPartitions("kind")
    hits = gathered.mapInArrow(_scan(quantiser, plan, dims, k, rerank), "query_id string, neighbour_id string, score double")
    top = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbour_id"))
    return hits.withColumn("r", top).where(F.col("r") <= k).select("query_id", "neighbour_id", "score")
