"""Ranking, multiset, assignment and distribution metrics."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaverlake.session import cut


def ranking(predictions: DataFrame, truth: DataFrame, key: str, item: str, rank: str, ks: list[int]) -> DataFrame:
    """(key, recall_k and precision_k for each k, reciprocal_rank, n_truth): predictions with ranks from 1
    against the set of true items of each key; keys without predictions count as misses."""
    t = truth.select(key, F.col(item).alias("item")).distinct()
    n = t.groupBy(key).agg(F.count("*").alias("n_truth"))
    hits = predictions.select(key, F.col(item).alias("item"), F.col(rank).alias("r")).groupBy(key, "item").agg(F.min("r").alias("r")).join(t, [key, "item"])
    per = hits.groupBy(key).agg(F.min("r").alias("first"), *[F.count(F.when(F.col("r") <= k, 1)).alias(f"h{k}") for k in ks])
    joined = n.join(per, key, "left")
    cols = [c for k in ks for c in ((F.coalesce(F.col(f"h{k}"), F.lit(0)) / F.col("n_truth")).alias(f"recall_{k}"), (F.coalesce(F.col(f"h{k}"), F.lit(0)) / F.lit(k)).alias(f"precision_{k}"))]
    return joined.select(key, *cols, F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), "n_truth")


def places(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds ``rank`` from 1 in an order without ties. Ranges of the order are sorted apart and the counts of those
    before them added, so no task sorts all rows."""
    parted = cut(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = parted.groupBy("part").agg(F.count("*").alias("c"))
    before = counts.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n0"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parted.withColumn("place", place).join(F.broadcast(before), "part").withColumn("rank", F.col("place") + F.col("n0")).drop("part", "place", "n0")


def percentiles(df: DataFrame, column: str, fractions: list[float]) -> DataFrame:
    """One row (p0, p1, ...): linear percentiles of the values that aren't null, null if there are none. The
    values are ranked by ranges; only the two beside each wanted place come together."""
    ranked = places(df.select(F.col(column).cast("double").alias("v"), F.monotonically_increasing_id().alias("i")).where("v IS NOT NULL"), F.asc("v"), F.asc("i"))
    n = ranked.agg(F.count("*").alias("n"))
    wanted = n.select("n", F.posexplode(F.array(*[F.lit(float(f)) for f in fractions])).alias("k", "f")).where("n > 0").withColumn("at", F.col("f") * (F.col("n") - 1))
    beside = wanted.select("k", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("place"))
    met = ranked.join(F.broadcast(beside), F.col("rank") == F.col("place") + 1)
    low, high = F.min_by("v", "place"), F.max_by("v", "place")
    per = met.groupBy("k").agg((low + (high - low) * (F.first("at") - F.floor(F.first("at")))).alias("p"))
    return per.agg(*[F.max(F.when(F.col("k") == i, F.col("p"))).alias(f"p{i}") for i in range(len(fractions))])


def rank_summary(ranks: DataFrame, rank: str, ks: list[int]) -> DataFrame:
    """One row: share of ranks within each k, mean reciprocal rank, mean and median rank."""
    r = F.col(rank)
    means = ranks.agg(*[F.avg((r <= k).cast("int")).alias(f"recall_{k}") for k in ks], F.avg(1.0 / r).alias("mrr"), F.avg(r).alias("mean_rank"), F.count("*").alias("n"))
    return means.crossJoin(percentiles(ranks, rank, [0.5]).withColumnRenamed("p0", "median_rank"))


def mean_rounded(batches: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """One row: the mean of each column over all batches, rounded half to even; null where no batch has a value. A column may be a
    list of a batch's values, which are taken one by one."""
    wide = {f.name: f.dataType.typeName() for f in batches.schema}
    one = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))
    total = lambda c: F.sum(one(c)) / F.sum(F.size(F.filter(c, lambda x: x.isNotNull()))) if wide[c] == "array" else F.avg(c)
    return batches.agg(*[F.bround(total(c), digits).alias(c) for c in columns])


def counts_of(items: Column) -> Column:
    """Distinct elements of a list; their counts are taken in place."""
    return F.array_distinct(items)


def count_in(items: Column, x: Column) -> Column:
    return F.size(F.filter(items, lambda y: y == x))


def multiset_common(a: Column, b: Column) -> Column:
    """Sum over elements of the smaller count: what two lists share as multisets."""
    return F.aggregate(counts_of(a), F.lit(0), lambda s, x: s + F.least(count_in(a, x), count_in(b, x)))


def multiset_either(a: Column, b: Column) -> Column:
    """Sum over elements of the larger count."""
    return F.size(a) + F.size(b) - multiset_common(a, b)


def multiset_metrics(rows: DataFrame, key: str, predicted: str, target: str) -> DataFrame:
    """(key, matches, recall, precision, f1, hit, unique_ratio, jaccard) of two short lists as multisets: an element
    earns credit as often as both have it. The lists are rows' own, of a few elements."""
    p, t = F.col(predicted), F.col(target)
    c = multiset_common(p, t)
    recall, precision = c / F.greatest(F.size(t), F.lit(1)), c / F.greatest(F.size(p), F.lit(1))
    either = multiset_either(p, t)
    out = rows.select(key, c.alias("matches"), recall.alias("recall"), precision.alias("precision"), (c > 0).cast("int").alias("hit"), (F.size(F.array_distinct(p)) / F.greatest(F.size(p), F.lit(1))).alias("unique_ratio"), F.when(either == 0, 1.0).otherwise(c / F.greatest(either, F.lit(1))).alias("jaccard"))
    return out.withColumn("f1", 2 * F.col("recall") * F.col("precision") / F.greatest(F.col("recall") + F.col("precision"), F.lit(1.1920929e-7)))


def hits_at(rows: DataFrame, key: str, predicted: str, target: str, ks: list[int], multiset: bool = False) -> DataFrame:
    """(key, hit_1 to hit_5, hit_full, recall, precision and jaccard at each k): hit_j is whether the first max(ks) hold at
    least j targets, hit_full whether they are just the targets in any order. Elements count once, or with
    ``multiset`` as often as both sides have them."""
    p, t = F.col(predicted), F.col(target) if multiset else F.array_distinct(F.col(target))

    def at(k: int) -> tuple[Column, Column]:
        top = F.slice(p, 1, k)
        top = top if multiset else F.array_distinct(top)
        return top, multiset_common(top, t) if multiset else F.size(F.array_intersect(top, t))

    widest, most = at(max(ks))
    cols = [(most >= j).cast("int").alias(f"hit_{j}") for j in range(1, 6)]
    cols.append(((most == F.size(t)) & (most == F.size(widest))).cast("int").alias("hit_full"))
    for k in ks:
        top, common = at(k)
        share = lambda n, common=common: common / F.greatest(n, F.lit(1))
        cols += [share(F.size(t)).alias(f"recall_{k}"), share(F.size(top)).alias(f"precision_{k}"), share(F.size(top) + F.size(t) - common).alias(f"jaccard_{k}")]
    return rows.select(key, *cols)


def bundle_metrics(bundles: DataFrame, key: str, predicted: str, target: str) -> DataFrame:
    """``multiset_metrics`` of lists of lists: what all items of a bundle hold, one after the other, as one multiset."""
    flat = bundles.select(key, F.flatten(predicted).alias("p"), F.flatten(target).alias("t"))
    return multiset_metrics(flat, key, "p", "t")


def code_hits(predicted: DataFrame, key: str, codes: str, catalogue: DataFrame, item_codes: str) -> DataFrame:
    """One row (predictions, hits, misses, hit_share): how many predicted codes the catalogue has. Codes are counted
    before they are joined."""
    counts = predicted.select(F.col(codes).alias("codes")).groupBy("codes").agg(F.count("*").alias("n"))
    known = catalogue.select(F.col(item_codes).alias("codes")).distinct().withColumn("known", F.lit(1))
    joined = counts.join(known, "codes", "left")
    hits = F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return joined.agg(total.alias("predictions"), hits.alias("hits"), (total - hits).alias("misses"), F.when(total > 0, hits / total).otherwise(0.0).alias("hit_share"))


def top_gaps(hits: DataFrame, key: str, score: str, rank: str) -> DataFrame:
    """One row (queries, mean_top, mean_gap, least_gap): score of each query's first hit, and how far the second is behind."""
    two = hits.where(F.col(rank) <= 2).groupBy(key).agg(F.max(F.when(F.col(rank) == 1, F.col(score))).alias("a"), F.max(F.when(F.col(rank) == 2, F.col(score))).alias("b"))
    return two.agg(F.count("*").alias("queries"), F.avg("a").alias("mean_top"), F.avg(F.col("a") - F.col("b")).alias("mean_gap"), F.min(F.col("a") - F.col("b")).alias("least_gap"))


def positional(rows: DataFrame, key: str, predicted: str, target: str) -> DataFrame:
    """(key, matches, share, all_match): elements equal at the same place."""
    same = F.size(F.filter(F.zip_with(predicted, target, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))
    longest = F.greatest(F.size(predicted), F.size(target))
    return rows.select(key, same.alias("matches"), (same / F.greatest(longest, F.lit(1))).alias("share"), (same == longest).alias("all_match"))


def best_assignment(scores: DataFrame, key: str, row: str, column: str, score: str, n: int = 5) -> DataFrame:
    """(key, best): the highest mean score of a one-to-one assignment of ``n`` rows to ``n`` columns (numbered
    from 0), exact over the n! permutations; n is small (120 for five)."""
    flat = scores.groupBy(key).agg(*[F.max(F.when((F.col(row) == i) & (F.col(column) == j), F.col(score))).alias(f"c{i}_{j}") for i in range(n) for j in range(n)])
    totals = [sum((F.col(f"c{i}_{j}") for i, j in list(enumerate(p))[1:]), F.col(f"c0_{p[0]}")) for p in permutations(range(n))]
    return flat.select(key, (F.greatest(*totals) / n).alias("best"))


def assignment_any_size(matrices: DataFrame, key: str, matrix: str) -> DataFrame:
    """(key, best): as ``best_assignment`` for a score matrix (array of rows) of any size, by shortest augmenting
    paths; a matrix is one row."""

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in source:
            yield pd.DataFrame({key: pdf[key], "best": [_assignment(np.array([list(r) for r in m], float)) for m in pdf["m"]]})

    kind = matrices.schema[key].dataType.simpleString()
    return matrices.select(key, F.col(matrix).alias("m")).mapInPandas(run, f"`{key}` {kind}, best double")


def _assignment(score: np.ndarray) -> float:
    """Mean score of the best assignment; rows are no more than columns."""
    if score.shape[0] > score.shape[1]:
        score = score.T
    n, m = score.shape
    cost = score.max() - score
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        dist, prev, done = cost[start] - row_price[start] - col_price, np.full(m, start), np.zeros(m, bool)
        while True:
            j = int(np.argmin(np.where(done, np.inf, dist)))
            done[j] = True
            if owner[j] < 0:
                break
            i, shortest = owner[j], dist[j]
            better = shortest + cost[i] - row_price[i] - col_price
            improve = ~done & (better < dist)
            dist[improve], prev[improve] = better[improve], i
        end = dist[j]
        closed = done & (np.arange(m) != j)
        for q in np.flatnonzero(closed):
            row_price[owner[q]] += end - dist[q]
            col_price[q] -= end - dist[q]
        row_price[start] += end
        while True:
            i = prev[j]
            before = np.flatnonzero(owner == i)
            owner[j] = i
            if i == start:
                break
            j = int(before[before != j][0])
    used = np.flatnonzero(owner >= 0)
    return float(score[owner[used], used].mean())


def draws(scores: DataFrame, key: str, score: str) -> DataFrame:
    """(key, best, worst, mean, variance) of a score over several draws; one draw has no variance."""
    return scores.groupBy(key).agg(F.max(score).alias("best"), F.min(score).alias("worst"), F.avg(score).alias("mean"), F.when(F.count(score) > 1, F.var_samp(score)).alias("variance"))


def entropy(counts: DataFrame, n: str, group: list[str] | None = None, base: float = 2.0) -> DataFrame:
    """Per group (or one row): entropy of the distribution with the counts ``n``, number of values, total."""
    group = group or []
    total = counts.groupBy(*group).agg(F.sum(n).alias("t"))
    joined = counts.join(F.broadcast(total), group) if group else counts.crossJoin(F.broadcast(total))
    p = F.col(n) / F.col("t")
    return joined.groupBy(*group).agg((-F.sum(p * F.log(p)) / F.log(F.lit(base))).alias("entropy"), F.count("*").alias("values"), F.max("t").alias("total"))


def weighted_mean(rows: DataFrame, rate: str, weight: str) -> DataFrame:
    """One row: mean of batch rates weighted by the size of the batches."""
    return rows.agg((F.sum(F.col(rate) * F.col(weight)) / F.sum(weight)).alias("mean"), F.sum(weight).alias("n"))


def bootstrap_interval(values: DataFrame, value: str, samples: int = 1000, seed: int = 42, level: float = 0.95, key: str | None = None, slices: int = 4096) -> DataFrame:
    """One row: mean, low, high of the mean by a Poisson bootstrap: each value counts in each of ``samples``
    resamples a Poisson number of times. Rows are dealt to slices by ``key`` (unique; else by the value and its place, where equal rows
    may change places) and drawn in blocks of 512 of a slice, each with its own generator, whatever the Arrow batches
    and partitions. A task adds up (samples) weights and sums, so nothing is gathered; the interval is
    the linear percentile of the resampled means."""

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, weights = np.zeros(samples), np.zeros(samples)
        own, block, held = -1, 0, np.zeros(0)

        def draw(v: np.ndarray) -> None:
            nonlocal block
            n = np.random.default_rng([seed, own, block]).poisson(1.0, (samples, len(v)))
            sums[:] += n @ v
            weights[:] += n.sum(1)
            block += 1

        for pdf in source:
            for h, rows in pdf.groupby("h", sort=False):
                if h != own:
                    if len(held):
                        draw(held)
                    own, block, held = int(h), 0, np.zeros(0)
                held = np.concatenate([held, rows["v"].to_numpy()])
                while len(held) >= 512:
                    draw(held[:512])
                    held = held[512:]
        if len(held):
            draw(held)
        yield pd.DataFrame({"b": range(samples), "s": sums, "w": weights})

    own = F.col(key) if key else F.struct(F.col(value), F.monotonically_increasing_id())
    rows = values.where(F.col(value).isNotNull()).select(F.pmod(F.xxhash64(own), F.lit(slices)).cast("int").alias("h"), F.col(value).cast("double").alias("v"), own.alias("k"))
    parts = rows.repartition("h").sortWithinPartitions("h", "k").drop("k").mapInPandas(run, "b int, s double, w double")
    means = parts.groupBy("b").agg((F.sum("s") / F.sum("w")).alias("m"))
    tail = (1 - level) / 2
    # of ``samples`` numbers, not of rows
    band = means.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))
    return rows.agg(F.avg("v").alias("mean"), F.count("*").alias("n")).crossJoin(band)


def frechet(a: DataFrame, b: DataFrame, vector: str, dims: int) -> DataFrame:
    """One row (distance): between the Gaussians of two sets of vectors. Means and second moments are summed in
    NumPy per partition and then added up; only dims x dims numbers come to the driver."""

    def moments(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(dims), np.zeros((dims, dims))
        for pdf in source:
            x = np.stack(pdf["v"].to_numpy())
            n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s], "q": [q.ravel()]})

    def gaussian(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = df.select(F.col(vector).cast("array<double>").alias("v")).where(F.size("v") == dims)
        parts = rows.mapInPandas(moments, "n long, s array<double>, q array<double>")
        each = parts.agg(F.sum("n").alias("n"), *[F.sum(F.element_at("s", i + 1)).alias(f"s{i}") for i in range(dims)]).first()
        cross = parts.select(F.posexplode("q").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toArrow().column("v").to_numpy()
        n = each["n"]
        mu = np.array([each[f"s{i}"] for i in range(dims)]) / n
        return mu, (cross.reshape(dims, dims) - n * np.outer(mu, mu)) / (n - 1)

    (m1, c1), (m2, c2) = gaussian(a), gaussian(b)
    values, vectors = np.linalg.eigh(c1)
    root = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
    cross = np.linalg.eigvalsh(root @ c2 @ root)
    d = float(((m1 - m2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * np.sqrt(np.maximum(cross, 0)).sum())
    return a.sparkSession.createDataFrame([(d,)], "distance double")


def longest_common(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, rouge_l_recall, rouge_l_precision): longest common subsequence of the words of two texts. Sequential by
    nature, so Arrow-batched Python."""

    def length(x: list[str], y: list[str]) -> int:
        row = np.zeros(len(y) + 1, int)
        words = np.array(y, object)
        for w in x:
            same = np.concatenate([[0], np.where(words == w, row[:-1] + 1, 0)]) if len(y) else row
            row = np.maximum.accumulate(np.maximum(row, same))
        return int(row[-1])

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in source:
            out = [(length(x, y), len(x), len(y)) for x, y in ((p.lower().split(), q.lower().split()) for p, q in zip(pdf["a"].fillna(""), pdf["b"].fillna(""), strict=True))]
            yield pd.DataFrame({key: pdf["k"], "rouge_l_recall": [c / max(1, n) for c, _, n in out], "rouge_l_precision": [c / max(1, m) for c, m, _ in out]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("k"), F.col(a).alias("a"), F.col(b).alias("b")).mapInPandas(run, f"`{key}` {kind}, rouge_l_recall double, rouge_l_precision double")


def bold_best(table: DataFrame, columns: dict[str, bool], digits: int = 4) -> DataFrame:
    """Each metric as text, the best in bold (ties all); ``columns``: name -> whether more is better."""
    best = table.agg(*[(F.max(c) if more else F.min(c)).alias(f"best_{c}") for c, more in columns.items()])
    joined = table.crossJoin(F.broadcast(best))
    show = lambda c: F.format_string(f"%.{digits}f", F.col(c).cast("double"))
    rest = [c for c in table.columns if c not in columns]
    return joined.select(*rest, *[F.when(F.col(c) == F.col(f"best_{c}"), F.concat(F.lit("**"), show(c), F.lit("**"))).otherwise(show(c)).alias(c) for c in columns])
