"""Exact vector search and selection.

Searches compare a stated query set with every row in blocks: both sides are packed into bounded
matrices, and a product of two packs runs in NumPy. Nothing is compared row by row, and only the k
best of a product leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaverlake.functions import vec
from quaverlake.session import spread

#: Rows in one pack.
PACK = 4096


def _matrix(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Names and unit vectors of a bounded table."""
    rows = df.toArrow()
    x = np.array(rows.column("v").to_pylist(), float)
    x = x / np.sqrt((x * x).sum(1, keepdims=True)) if len(x) else x.reshape(0, 1)
    return np.array(rows.column("name").to_pylist(), object), x


def _packs(side: DataFrame, names: str, vectors: str) -> DataFrame:
    """Rows (name, v) as unit vectors, up to PACK of them in one row: names in order, and the matrix."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at in range(0, batch.num_rows, PACK):
                part = batch.slice(at, PACK)
                own = np.array(part.column("name").to_pylist(), object)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                order = np.argsort(own, kind="stable")
                x = x[order] / np.sqrt((x[order] * x[order]).sum(1, keepdims=True))
                yield pa.RecordBatch.from_arrays([pa.array([own[order].tolist()], pa.list_(pa.string())), pa.array([x.tobytes()], pa.binary())], names=[names, vectors])

    return side.mapInArrow(run, f"{names} array<string>, {vectors} binary")


def _best(query_names: np.ndarray, q: np.ndarray, names: np.ndarray, x: np.ndarray, k: int, digits: int, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a product of two packs the k best of each query; equal scores by the smaller name, as names are in order."""
    score = np.round(q @ x.T, digits) + 0.0
    if exclude_self:
        score[query_names[:, None] == names[None, :]] = -np.inf
    if score.shape[1] > 4 * k:
        # rows that can't be among the k best are left out before sorting
        floor = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        rows, columns = np.nonzero((score >= floor[:, None]) & np.isfinite(score))
        value = score[rows, columns]
        order = np.lexsort((columns, -value, rows))
        rows, columns, value = rows[order], columns[order], value[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < k
        return query_names[rows[keep]], names[columns[keep]], value[keep]
    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
    rows = np.repeat(np.arange(len(query_names)), best.shape[1])
    value = score[rows, best.ravel()]
    keep = np.isfinite(value)
    return query_names[rows[keep]], names[best.ravel()[keep]], value[keep]


def exact_topk(catalogue: DataFrame, queries: DataFrame, k: int, key: str = "item_id", vector: str = "emb", query_key: str = "query_id", query_vector: str = "qvec", dims: int = 64, exclude_self: bool = False, digits: int = 6) -> DataFrame:
    """(query_id, item, score, rank): the ``k`` rows of highest cosine for each query, scores rounded half
    to even to ``digits``, equal ones by the smaller key. Unusable vectors (null, zero, not finite, other
    length) take no part on either side. Both sides are packed into matrices where they lie, packs of
    one meet those of the other on a grid, and a product of two packs gives k rows a query; nothing
    passes through the driver."""
    q = queries.where(vec.usable(query_vector, dims)).select(F.col(query_key).cast("string").alias("name"), vec.doubles(query_vector).alias("v")).dropDuplicates(["name"])
    c = catalogue.where(vec.usable(vector, dims)).select(F.col(key).cast("string").alias("name"), vec.doubles(vector).alias("v"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in range(batch.num_rows):
                own, names = (np.array(batch.column(n)[row].as_py(), object) for n in ("q_names", "c_names"))
                y, x = (np.frombuffer(batch.column(n)[row].as_py(), float).reshape(len(m), -1) for n, m in (("q", own), ("c", names)))
                for at in range(0, len(own), 512):
                    a, b, s = _best(own[at : at + 512], y[at : at + 512], names, x, k, digits, exclude_self)
                    yield pa.RecordBatch.from_arrays([pa.array(a.tolist(), pa.string()), pa.array(b.tolist(), pa.string()), pa.array(s, pa.float64())], names=["query_id", "item", "score"])

    grid = _packs(spread(q), "q_names", "q").crossJoin(_packs(c, "c_names", "c"))
    hits = grid.mapInArrow(run, "query_id string, item string, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def mean_vector(vector: Column | str, dims: int) -> list[Column]:
    """Aggregates of the mean, one per dimension: each is summed on the map side first."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return [F.avg(F.try_element_at(v, F.lit(i + 1)).cast("double")).alias(f"m{i}") for i in range(dims)]


def centroids(members: DataFrame, group: str, vector: str, dims: int = 64) -> DataFrame:
    """(group, mu, sigma2, n): mean of a group's vectors and the mean squared distance from it, as
    E|x|^2 - |E x|^2. A vector per row; unusable ones are left out."""
    ok = members.where(vec.usable(vector, dims))
    square = F.aggregate(vec.doubles(vector), F.lit(0.0), lambda s, x: s + x * x)
    agg = ok.groupBy(group).agg(*mean_vector(vector, dims), F.avg(square).alias("sq"), F.count("*").alias("n"))
    mu = F.array(*[F.col(f"m{i}") for i in range(dims)])
    out = agg.select(group, mu.alias("mu"), "sq", "n")
    return out.select(group, "mu", F.greatest(F.lit(0.0), F.col("sq") - F.aggregate("mu", F.lit(0.0), lambda s, x: s + x * x)).alias("sigma2"), "n")


def diversity(members: DataFrame, group: str, vector: str, dims: int = 64) -> DataFrame:
    """(group, n, diversity): 1 - mean cosine over all pairs of a group, in closed form from the sum of
    its unit vectors; groups of one have none."""
    units = members.where(vec.usable(vector, dims)).select(group, vec.l2(vector).alias("u"))
    agg = units.groupBy(group).agg(*[F.sum(F.element_at("u", i + 1)).alias(f"s{i}") for i in range(dims)], F.count("*").alias("n"))
    square = sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(1, dims)), F.col("s0") * F.col("s0"))
    n = F.col("n").cast("double")
    return agg.where("n > 1").select(group, "n", (1 - (square - n) / (n * (n - 1))).alias("diversity"))


def gather(lists: DataFrame, key: str, ids: str, table: DataFrame, table_key: str, value: str) -> DataFrame:
    """(key, pos, id, value): each list element with its value, in order of pos from 0; ids without a row
    are left out."""
    exploded = lists.select(key, F.posexplode(ids).alias("pos", "id"))
    return exploded.join(table.select(F.col(table_key).alias("id"), F.col(value).alias("value")), "id").select(key, "pos", "id", "value")


def mean_pairwise_cosine(members: DataFrame, group: str, vector: str, dims: int = 64) -> DataFrame:
    """(group, n, intra_cosine): mean cosine over all pairs of a group's usable vectors, groups of one left out: what
    ``diversity`` lacks to one."""
    return diversity(members, group, vector, dims).select(group, "n", (1 - F.col("diversity")).alias("intra_cosine"))


def whitened(vectors: DataFrame, key: str, vector: str, dims: int, keep: int | None = None) -> DataFrame:
    """(key, white): usable vectors turned to their principal axes, the ``keep`` widest of them (default all), and scaled to
    variance one on each. Moments are summed in matrices per partition; dims x dims numbers come to the driver."""
    ok = vectors.where(vec.usable(vector, dims)).select(F.col(key), vec.doubles(vector).alias("v"))

    def moments(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, m = 0, np.zeros(dims), np.zeros((dims, dims))
        for pdf in source:
            x = np.stack(pdf["v"].to_numpy())
            n, s, m = n + len(x), s + x.sum(0), m + x.T @ x
        yield pd.DataFrame({"i": range(-1, dims), "v": [np.append(s, n), *np.pad(m, ((0, 0), (0, 1)))]})

    rows = ok.select("v").mapInPandas(moments, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((dims + 1, dims + 1))
    for r in rows:
        total[r.i + 1, r.j] = r.x
    n = max(1.0, total[0, dims])
    mean = total[0, :dims] / n
    values, axes = np.linalg.eigh(total[1:, :dims] / n - np.outer(mean, mean))
    wide = np.argsort(-values)[: keep or dims]
    turn = axes[:, wide] / np.sqrt(np.maximum(values[wide], 1e-12))

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in source:
            yield pd.DataFrame({key: pdf[key], "white": list((np.stack(pdf["v"].to_numpy()) - mean) @ turn)})

    return ok.mapInPandas(run, f"`{key}` {vectors.schema[key].dataType.simpleString()}, white array<double>")


def cluster_representatives(vectors: DataFrame, key: str, vector: str, weight: str, clusters: int, dims: int, rounds: int = 10, sample: int = 20_000, seed: int = 42) -> DataFrame:
    """(key, cluster): of k-means clusters of the vectors the row nearest to each centre, ties by key; an empty cluster has none. Centres
    are fitted, with rows weighing ``weight``, to at most ``sample`` rows chosen by hash; every row is assigned."""
    ok = vectors.where(vec.usable(vector, dims)).select(F.col(key).alias("k"), vec.doubles(vector).alias("v"), F.col(weight).cast("double").alias("w"))
    few = ok.orderBy(F.xxhash64("k", F.lit(seed)), "k").limit(sample).toArrow()
    x, w = np.array(few.column("v").to_pylist(), float).reshape(-1, dims), np.array(few.column("w").to_pylist(), float)
    c = x[:clusters].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1) if len(c) else np.zeros(0, int)
        mass = np.bincount(near, w, len(c))
        for d in range(dims):
            c[:, d] = np.where(mass > 0, np.bincount(near, w * x[:, d], len(c)) / np.where(mass > 0, mass, 1), c[:, d])

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in source:
            y = np.stack(pdf["v"].to_numpy())
            far = (y * y).sum(1)[:, None] - 2 * y @ c.T + (c * c).sum(1)
            near = far.argmin(1)
            yield pd.DataFrame({"k": pdf["k"], "cluster": near.astype(np.int32), "far": np.round(far[np.arange(len(y)), near], 9)})

    kind = vectors.schema[key].dataType.simpleString()
    if not len(c):
        return vectors.sparkSession.createDataFrame([], f"`{key}` {kind}, cluster int")
    placed = ok.select("k", "v").mapInPandas(run, f"k {kind}, cluster int, far double")
    return placed.groupBy("cluster").agg(F.min(F.struct("far", "k")).alias("r")).select(F.col("r.k").alias(key), "cluster")


def coverage_selection(members: DataFrame, group: str, ordinal: str, item: str, vector: str, k: int) -> DataFrame:
    """(group, place, item): greedy farthest points of a group: the first one by ordinal, then again and
    again the one least similar to its nearest chosen one, ties by ordinal. Sequential by nature, so a
    group is one Arrow batch; groups are playlists, whose length the caller bounds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o", kind="stable").drop_duplicates("i")
        x = np.stack(pdf["v"].to_numpy()).astype(float)
        x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), vec.EPS)
        chosen, near = [0], x @ x[0]
        while len(chosen) < min(k, len(x)):
            rest = near.copy()
            rest[chosen] = np.inf
            nxt = int(np.argmin(np.round(rest, 9)))
            chosen.append(nxt)
            near = np.maximum(near, x @ x[nxt])
        return pd.DataFrame({group: pdf["g"].iloc[0], "place": range(len(chosen)), "item": pdf["i"].to_numpy()[chosen]})

    kind = members.schema[group].dataType.simpleString()
    rows = members.select(F.col(group).alias("g"), F.col(ordinal).alias("o"), F.col(item).cast("string").alias("i"), vec.doubles(vector).alias("v"))
    return rows.groupBy("g").applyInPandas(run, f"`{group}` {kind}, place int, item string")


def diverse_selection(candidates: DataFrame, group: str, item: str, relevance: str, vector: str, n: int, weight: float = 0.7) -> DataFrame:
    """(group, place, item): maximal marginal relevance over each group's candidates (at most a pool of
    64 or so, as a search gives them): weight * relevance - (1 - weight) * the highest similarity to
    what is chosen; ties by higher relevance, then smaller item."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "i"], ascending=[False, True], kind="stable")
        x = np.stack(pdf["v"].to_numpy()).astype(float)
        x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), vec.EPS)
        r = pdf["r"].to_numpy()
        chosen: list[int] = []
        near = np.zeros(len(r))
        while len(chosen) < min(n, len(r)):
            score = np.round(weight * r - (1 - weight) * near, 9)
            score[chosen] = -np.inf
            nxt = int(np.argmax(score))
            near = x @ x[nxt] if not chosen else np.maximum(near, x @ x[nxt])
            chosen.append(nxt)
        return pd.DataFrame({group: pdf["g"].iloc[0], "place": range(len(chosen)), "item": pdf["i"].to_numpy()[chosen]})

    kind = candidates.schema[group].dataType.simpleString()
    rows = candidates.select(F.col(group).alias("g"), F.col(item).cast("string").alias("i"), F.col(relevance).cast("double").alias("r"), vec.doubles(vector).alias("v"))
    return rows.groupBy("g").applyInPandas(run, f"`{group}` {kind}, place int, item string")


def _sorted_matrix(catalogue: DataFrame, key: str, vector: str, dims: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Names in order and unit vectors of a vocabulary of at most ``limit`` usable rows."""
    rows = catalogue.where(vec.usable(vector, dims)).select(F.col(key).cast("string").alias("name"), vec.doubles(vector).alias("v"))
    names, x = _matrix(rows.limit(limit + 1))
    if len(names) > limit:
        raise ValueError(f"the searched side is a vocabulary of at most {limit} rows")
    order = np.argsort(names, kind="stable")
    return names[order], x[order]


def _scores(pdf: pd.DataFrame, x: np.ndarray, digits: int) -> np.ndarray:
    y = np.stack(pdf["v"].to_numpy())
    return np.round(y / np.sqrt((y * y).sum(1, keepdims=True)) @ x.T, digits) + 0.0


def diverse_topk(catalogue: DataFrame, queries: DataFrame, n: int, pool: int = 64, weight: float = 0.7, key: str = "item_id", vector: str = "emb", query_key: str = "query_id", query_vector: str = "qvec", dims: int = 64, digits: int = 6, limit: int = 50_000) -> DataFrame:
    """(query_id, place, item): ``exact_topk`` with k = ``pool`` and ``diverse_selection`` of ``n`` in one pass over
    the queries: the catalogue is a vocabulary of at most ``limit`` rows and goes to the tasks, so neither hits nor
    their vectors are shuffled."""
    names, x = _sorted_matrix(catalogue, key, vector, dims, limit)
    asked = queries.where(vec.usable(query_vector, dims)).select(F.col(query_key).cast("string").alias("name"), vec.doubles(query_vector).alias("v")).dropDuplicates(["name"])
    schema = "query_id string, place int, item string"
    if not len(names):
        return catalogue.sparkSession.createDataFrame([], schema)

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in source:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                score = _scores(part, x, digits)
                best = np.argsort(-score, axis=1, kind="stable")[:, :pool]
                r, v, b = np.take_along_axis(score, best, 1), x[best], np.arange(len(part))
                near, left, chosen = np.zeros(r.shape), np.ones(r.shape, bool), []
                for _ in range(min(n, r.shape[1])):
                    nxt = np.where(left, np.round(weight * r - (1 - weight) * near, 9), -np.inf).argmax(1)
                    similar = (v @ v[b, nxt][:, :, None])[:, :, 0]
                    near = np.maximum(near, similar) if chosen else similar
                    left[b, nxt] = False
                    chosen.append(best[b, nxt])
                picked = np.stack(chosen, axis=1)
                yield pd.DataFrame({"query_id": np.repeat(part["name"].to_numpy(), picked.shape[1]), "place": np.tile(np.arange(picked.shape[1]), len(part)), "item": names[picked.ravel()]})

    return asked.mapInPandas(run, schema)


def rank_of(catalogue: DataFrame, queries: DataFrame, item: str, key: str = "item_id", vector: str = "emb", query_key: str = "query_id", query_vector: str = "qvec", dims: int = 64, digits: int = 6, limit: int = 50_000) -> DataFrame:
    """(query_id, item, rank): the place of each query's own ``item`` among all rows of the catalogue, in the order of
    ``exact_topk``. The catalogue is a vocabulary of at most ``limit`` rows; queries whose item it lacks have no row."""
    names, x = _sorted_matrix(catalogue, key, vector, dims, limit)
    asked = queries.where(vec.usable(query_vector, dims)).select(F.col(query_key).cast("string").alias("name"), vec.doubles(query_vector).alias("v"), F.col(item).cast("string").alias("item"))
    place = {name: i for i, name in enumerate(names)}

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in source:
            known = pdf[pdf["item"].isin(place)]
            for at in range(0, len(known), 1024):
                part = known.iloc[at : at + 1024]
                score = _scores(part, x, digits)
                own = part["item"].map(place).to_numpy()[:, None]
                value = np.take_along_axis(score, own, 1)
                before = (score > value) | ((score == value) & (np.arange(len(names)) < own))
                yield pd.DataFrame({"query_id": part["name"].to_numpy(), "item": part["item"].to_numpy(), "rank": before.sum(1) + 1})

    return asked.mapInPandas(run, "query_id string, item string, rank int")


def assigned(hits: DataFrame, slots: int, empty: int = 0) -> DataFrame:
    """(query_id, ids, scores): the hits of each query by rank, filled up to ``slots`` with ``empty`` and null."""
    ordered = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item", "score"))).alias("h"))
    ids = F.transform("h", lambda x: x["item"].cast("int"))
    scores = F.transform("h", lambda x: x["score"])
    missing = F.greatest(F.lit(slots) - F.size("h"), F.lit(0))
    return ordered.select("query_id", F.concat(F.slice(ids, 1, slots), F.array_repeat(F.lit(empty), missing)).alias("ids"), F.concat(F.slice(scores, 1, slots), F.array_repeat(F.lit(None).cast("double"), missing)).alias("scores"))


def _removed(edges: DataFrame) -> DataFrame:
    """(k): what a greedy pass takes away, given the close pairs (a, b), a before b. Rounds over their graph give the same
    as the sequential pass: a row without an undecided earlier neighbour stays, and its later neighbours go."""
    from quaverlake.session import cut

    removed = edges.select(F.col("b").alias("k")).limit(0)
    while not edges.isEmpty():
        stay = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = cut(edges.join(stay, "a", "left_semi").select(F.col("b").alias("k")).distinct())
        removed = removed.unionByName(gone)
        edges = cut(edges.join(gone.withColumnRenamed("k", "a"), "a", "left_anti").join(gone.withColumnRenamed("k", "b"), "b", "left_anti"))
    return removed


def greedy_distinct(vectors: DataFrame, key: str, order: str, vector: str, threshold: float, limit: int = 50_000) -> DataFrame:
    """(key) of the rows that survive greedy near-duplicate removal: in ``order`` (unique), a row stays if
    no row that stays before it has a cosine above ``threshold``. The table is a vocabulary of at most ``limit``
    rows; its close pairs come from block products and stay distributed. ``sparse_distinct`` has no such bound."""
    from quaverlake.session import cut, stored

    rows = stored(vectors.select(F.col(key).cast("string").alias("k"), F.col(order).alias("o"), vec.doubles(vector).alias("v")))
    if threshold >= 1:
        return rows.select(F.col("k").alias(key))
    table = rows.limit(limit + 1).toArrow()
    if table.num_rows > limit:
        raise ValueError(f"greedy removal is for vocabularies of at most {limit} rows")
    y = np.array(table.column("v").to_pylist(), float).reshape(table.num_rows, -1)
    y = y / np.maximum(np.sqrt((y * y).sum(1, keepdims=True)), vec.EPS)
    o, names = np.array(table.column("o").to_pylist()), np.array(table.column("k").to_pylist(), object)

    def close(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in source:
            x = np.stack(pdf["v"].to_numpy())
            x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), vec.EPS)
            i, j = np.nonzero((x @ y.T > threshold) & (pdf["o"].to_numpy()[:, None] < o[None, :]))
            yield pd.DataFrame({"a": pdf["k"].to_numpy()[i], "b": names[j]})

    removed = _removed(cut(rows.mapInPandas(close, "a string, b string")))
    return rows.select("k").join(removed, "k", "left_anti").select(F.col("k").alias(key))


def _dense(at: pa.Array, w: pa.Array, dims: int) -> np.ndarray:
    """Rows of sparse vectors, their places and weights packed as bytes."""
    out = np.zeros((len(at), dims))
    for i, (a, x) in enumerate(zip(at, w, strict=True)):
        out[i, np.frombuffer(a.as_py(), np.int32)] = np.frombuffer(x.as_py())
    return out


def sparse_pairs(rows: DataFrame, threshold: float, dims: int, block: int = PACK) -> DataFrame:
    """(a, b): every pair of ``o`` (unique, whole numbers), the smaller first, whose cosine is above ``threshold`` (0 to 1). Rows (o, at, w) are
    vectors of ``dims`` places, ``at`` the places of weights ``w`` over 0, the others 0. Places are ordered from the rarest. What follows a vector's first places is
    soon no longer than the threshold, so a close pair shares one of the first places of both: rows meet only at these, the first that
    they share counts, and a place of many rows is divided into blocks that meet on a grid. Nothing but the order goes to the driver."""
    from quaverlake.session import stored

    counts = dict(rows.select(F.explode("at").alias("p")).groupBy("p").agg(F.count("*")).toPandas().itertuples(index=False, name=None))
    rank = np.zeros(dims, np.int32)
    rank[sorted(range(dims), key=lambda p: (counts.get(p, 0), p))] = np.arange(dims)

    def led(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ats, ws, firsts = [], [], []
            for at, w in zip(batch.column("at"), batch.column("w"), strict=True):
                a, x = rank[np.asarray(at.values)], np.asarray(w.values, float)
                order = np.argsort(a)
                a, x = a[order], x[order] / max(np.sqrt((x * x).sum()), vec.EPS)
                rest = 1 - np.concatenate([[0], np.cumsum(x * x)[:-1]])
                ats.append(a.tobytes())
                ws.append(x.tobytes())
                firsts.append(a[rest >= threshold * threshold - 1e-9])  # a little more, for rounding
            yield pa.RecordBatch.from_arrays([batch.column("o"), pa.array(ats, pa.binary()), pa.array(ws, pa.binary()), pa.array(firsts, pa.list_(pa.int32()))], names=["o", "at", "w", "first"])

    lead = stored(rows.where(F.size("at") > 0).select(F.col("o").cast("long"), "at", "w").mapInArrow(led, "o long, at binary, w binary, first array<int>"))
    sizes = lead.select(F.explode("first").alias("p")).groupBy("p").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = lead.select("o", "at", "w", F.explode("first").alias("p")).join(F.broadcast(sizes), "p").withColumn("own", F.pmod(F.xxhash64("o"), "blocks").cast("int"))
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"))))
    met = own.select("p", "own", "o", "at", "w", cell.alias("c")).select("p", "c.i", "c.j", "own", "o", "at", "w")

    def close(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        p, i, j = (k.as_py() for k in key)
        own, a, b = np.asarray(table.column("own")), [], []
        left, right = (table.filter(pa.array(own == side)).combine_chunks() for side in (i, j))
        for r in range(0, right.num_rows, 1024):
            there = right.slice(r, 1024)
            y, oy = _dense(there.column("at"), there.column("w"), dims), np.asarray(there.column("o"))
            y32 = y.astype(np.float32).T
            for q in range(0, min(left.num_rows, r + 1024) if i == j else left.num_rows, 1024):
                here = left.slice(q, 1024)
                x, ox = _dense(here.column("at"), here.column("w"), dims), np.asarray(here.column("o"))
                m, n = np.nonzero(x.astype(np.float32) @ y32 > threshold - 1e-4)
                if i == j and q == r:
                    m, n = m[m < n], n[m < n]
                for at in range(0, len(m), 1024):
                    u, v = m[at : at + 1024], n[at : at + 1024]
                    both = x[u] * y[v]
                    ok = (both.sum(1) > threshold) & ((both > 0).argmax(1) == p)
                    a.append(np.minimum(ox[u], oy[v])[ok])
                    b.append(np.maximum(ox[u], oy[v])[ok])
        none = [np.zeros(0, np.int64)]
        return pa.table({"a": np.concatenate(a or none), "b": np.concatenate(b or none)})

    return met.groupBy("p", "i", "j").applyInArrow(close, "a long, b long")


def sparse_distinct(rows: DataFrame, key: str, threshold: float, dims: int) -> DataFrame:
    """(key) as ``greedy_distinct`` has it, of rows (key, o, at, w) as ``sparse_pairs`` takes them, in order of ``o``, however many there are."""
    from quaverlake.session import stored

    if threshold >= 1:
        return rows.select(key)
    if threshold < 0:  # no cosine is so low
        return rows.orderBy("o").limit(1).select(key)
    rows = stored(rows)
    removed = _removed(stored(sparse_pairs(rows, threshold, dims)))
    return rows.select(key, F.col("o").alias("k")).join(removed, "k", "left_anti").select(key)
