"""Items that appear together: exact pair counts and lift by heavy-light decomposition.

Items are numbered by how many records hold them, rarest first. The at most ``max_heavy`` most
frequent ones are *heavy*: a bit matrix (item x record) is filled block by block and pairs
of its rows are counted by popcount, so that the work and the result of a task don't depend
on how often a heavy item occurs. The rest are *light*. Every other pair is led by its rarer item.
Leaders are cut into ranges of about the same number of pairs; a record goes once to each range
that it has a leader in, as what follows the first of these in its numbers. There pairs of two light
items are counted in hash tables, and the (short) list of records of a light item is probed for heavy
ones. A range that is too large even as one item is dealt out by record, and its counts are added up.
No pair ever crosses a shuffle before it is counted.

Two prunings, both lossless: a pair in at least ``min_pair`` records needs two items in at
least ``min_pair`` records, and as n(a,b) <= n(a), a lift of ``min_lift`` needs
n(b) <= N / min_lift.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaverlake.llm.common import batches, clean_ids, one_row_per_key, ragged, with_dense_id
from quaverlake.session import cut, parallelism, stored

_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
_SQL = "a long, b long, n long"
#: Records in one block of the bit matrix.
BLOCK = 8192
#: Pairs that one task counts, about; its memory is some eight bytes a pair.
RANGE = 6_000_000
#: Numbers are counted in at most so many slices to find the ranges.
SLICES = 1 << 16
#: Longer lists are paired leader by leader.
LONG = 256
#: Characters of item ids that may ride along with the tasks; beyond, records meet their numbers in a join.
DICTIONARY = 16_000_000


def _popcounts(heavy: int, first: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((heavy, heavy), np.int64)
        bits = np.zeros((heavy, BLOCK), bool)
        filled = 0

        def count_block() -> None:
            used = np.flatnonzero(bits[:, :filled].any(axis=1))
            packed = np.packbits(bits[used], axis=1).view(np.uint64)
            for i in range(len(used) - 1):
                both = np.bitwise_count(packed[i] & packed[i + 1 :])
                counts[used[i], used[i + 1 :]] += both.sum(axis=1, dtype=np.int64)
            bits[:] = False

        for batch in source:
            flat, whole = ragged(batch.column("ids"))
            record = np.repeat(np.arange(len(whole)), whole)[flat >= first]
            ids, lengths = flat[flat >= first] - first, np.bincount(record, minlength=len(whole))
            ends = np.cumsum(lengths)
            row = 0
            while row < len(lengths):
                take = min(BLOCK - filled, len(lengths) - row)
                lo, hi = (ends[row - 1] if row else 0), ends[row + take - 1]
                bits[ids[lo:hi], np.repeat(np.arange(filled, filled + take), lengths[row : row + take])] = True
                filled, row = filled + take, row + take
                if filled == BLOCK:
                    count_block()
                    filled = 0
        if filled:
            count_block()
        a, b = np.nonzero(counts)
        yield from batches({"a": a + first, "b": b + first, "n": counts[a, b]}, _PAIRS)

    return run


def _numbered(items: pa.Array):
    """Lists of items to ascending numbers, the place of each in ``items``; others are left out."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            lists = batch.column("items")
            lengths = np.diff(lists.offsets.to_numpy(zero_copy_only=False))
            found = pc.fill_null(pc.index_in(lists.flatten(), value_set=items), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            record = np.repeat(np.arange(len(lengths)), lengths)[found >= 0]
            found = found[found >= 0]
            order = np.lexsort((found, record))
            counts = np.bincount(record, minlength=len(lengths))
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[order]))
            yield pa.RecordBatch.from_arrays([out.filter(pa.array(counts > 1))], names=["ids"])

    return run


def _loads(width: int, slices: int):
    """Pairs that each slice of numbers leads."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slices)
        for batch in source:
            ids, lengths = ragged(batch.column("ids"))
            after = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(ids)) - 1
            total += np.bincount(ids // width, after, slices)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some].astype(np.int64))], names=["slice", "pairs"])

    return run


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def _dealt(range_of: np.ndarray, width: int, first_task: np.ndarray, salts: np.ndarray, heavy_from: int, kind: type):
    """Every record's numbers to the tasks of its ranges: one row per batch and task, of lists one after
    the other. Bytes of one place lie together, as the high ones are mostly alike."""
    places = np.dtype(kind).itemsize

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in source:
            ids, lengths = ragged(batch.column("ids"))
            if not len(ids):
                continue
            ends = np.cumsum(lengths)
            record = np.repeat(np.arange(len(lengths)), lengths)
            own = range_of[ids // width]
            opens = np.ones(len(ids), bool)
            opens[1:] = (own[1:] != own[:-1]) | (record[1:] != record[:-1])
            left = ends[record] - np.arange(len(ids))
            start = np.flatnonzero(opens & (ids < heavy_from) & (left > 1))
            if not len(start):
                continue
            task = first_task[own[start]] + (record[start] + turn) % salts[own[start]]
            turn += len(lengths)
            order = np.argsort(task, kind="stable")
            start, task = start[order], task[order]
            size = left[start]
            edges = [*np.flatnonzero(np.diff(task, prepend=-1)).tolist(), len(task)]
            rows = []
            for lo, hi in zip(edges, edges[1:], strict=False):
                part = ids[_runs(start[lo:hi], size[lo:hi])].astype(kind)
                planes = lambda x, n: x.view(np.uint8).reshape(-1, n).T.tobytes()
                rows.append((int(task[lo]), planes(part, places), planes(size[lo:hi].astype(np.int32), 4)))
            t, i, s = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(i, pa.binary()), pa.array(s, pa.binary())], names=["task", "ids", "sizes"])

    return run


class _Counter:
    """Counts of int64 keys, added up whenever many are held."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held, self.limit = 0, 1 << 23

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.keys.append(keys)
        self.counts.append(np.ones(len(keys), np.int32) if counts is None else counts)
        self.held += len(keys)
        if self.held > self.limit:
            key, n = self.total()
            self.keys, self.counts, self.held = [key], [n], len(key)
            self.limit = max(1 << 23, 2 * len(key))

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, n = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(key)
        key, n = key[order], n[order]
        edges = np.flatnonzero(np.diff(key, prepend=-1))
        return key[edges], np.add.reduceat(n, edges, dtype=np.int64) if len(edges) else n


def _counted(bounds: np.ndarray, range_of_task: np.ndarray, salted: np.ndarray, m: int, heavy_from: int, min_pair: int, kind: type):
    """All rows of one task, which is one range of leaders or a part of its records."""
    places, heavy = np.dtype(kind).itemsize, m - heavy_from

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, own = _Counter(), None
        for batch in source:
            for task, ids, sizes in zip(*[batch.column(c).to_pylist() for c in ("task", "ids", "sizes")], strict=True):
                own = range_of_task[task]
                lo, hi = int(bounds[own]), min(int(bounds[own + 1]), heavy_from)
                size = np.frombuffer(sizes, np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel().astype(np.int64)
                flat = np.frombuffer(ids, np.uint8).reshape(places, -1).T.copy().view(kind).ravel().astype(np.int64)
                begin = np.cumsum(size) - size
                record = np.repeat(np.arange(len(size)), size)
                is_heavy = flat >= heavy_from
                light = size - np.bincount(record, is_heavy, len(size)).astype(np.int64)
                # pairs of two light items, all lists of a length together
                for length in np.unique(light[light > 1]).tolist():
                    rows = np.flatnonzero(light == length)
                    if length <= LONG:
                        i, j = np.triu_indices(length, 1)
                        step = max(1, (1 << 21) // len(i))
                        for k in range(0, len(rows), step):
                            x = flat[begin[rows[k : k + step], None] + np.arange(length)]
                            a = x[:, i]
                            counter.add(((a - lo) * m + x[:, j])[a < hi])
                    else:
                        for r in rows.tolist():
                            x = flat[begin[r] : begin[r] + length]
                            for k in range(int(np.searchsorted(x, hi))):
                                counter.add((x[k] - lo) * m + x[k + 1 :])
                # light leaders, sorted, with the heavy ones of each of their records
                lead = np.flatnonzero(flat < hi)
                if heavy and len(lead):
                    lead = lead[np.argsort(flat[lead], kind="stable")]
                    who = flat[lead]
                    for k in range(lo, hi, 4096):
                        x, y = np.searchsorted(who, [k, k + 4096])
                        if x < y:
                            r = record[lead[x:y]]
                            n = size[r] - light[r]
                            cells = np.repeat((who[x:y] - k) * heavy, n) + flat[_runs(begin[r] + light[r], n)] - heavy_from
                            table = np.bincount(cells, minlength=1)
                            some = np.flatnonzero(table)
                            counter.add((k - lo + some // heavy) * m + heavy_from + some % heavy, table[some])
        if own is not None:
            key, n = counter.total()
            if not salted[own]:
                key, n = key[n >= min_pair], n[n >= min_pair]
            yield from batches({"a": key // m + int(bounds[own]), "b": key % m, "n": n}, _PAIRS)

    return run


def cooccurring_pairs(
    df: DataFrame,
    key: str = "prefix_id",
    items: str = "item_ids",
    min_pair: int = 1,
    min_lift: float | None = None,
    max_heavy: int = 512,
    heavy_share: float = 1 / 512,
    range_pairs: int | None = None,
) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n_records, lift) for every two items, item_a < item_b in
    byte order, that are together in at least ``min_pair`` records; with ``min_lift`` only those
    with n_ab * N >= min_lift * n_a * n_b.

    A record is a distinct non-null ``key``; its items are the set of its trimmed ids without null
    and blank ones; N counts records with at least one item. A null list, an empty one or an empty
    table adds nothing; repeated rows of a key count once (if their lists differ, the largest in
    array order counts); other columns, whatever their names, aren't read. An item is heavy if it
    is in at least ``heavy_share`` of the records and among the ``max_heavy`` most frequent ones
    (ties by id); ``range_pairs`` is the number of pairs a task counts. These only steer the work. The
    driver holds SLICES sums, a bound per range and, up to DICTIONARY characters, the ids of the
    items that may be in a pair; past that these meet the records in a join."""
    spark = df.sparkSession
    records = stored(one_row_per_key(df.select(F.col(key).alias("key"), clean_ids(items).alias("items")), "key", "items").where(F.size("items") > 0).select("items"))
    total = records.count()
    counts = records.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    wanted = F.col("n") >= min_pair
    if min_lift is not None:
        wanted &= F.col("n") * F.lit(float(min_lift)) <= F.lit(float(total))
    # sorted, and written with its order, so that numbers go by frequency
    names = cut(with_dense_id(cut(counts.where(wanted).orderBy("n", "item")), "id"))
    is_heavy = F.col("n") >= max(2, total * heavy_share)
    m, letters, frequent = names.agg(F.count("*"), F.sum(F.octet_length("item")), F.count(F.when(is_heavy, 1))).first()
    heavy = min(max_heavy, frequent)
    heavy_from, kind = m - heavy, np.int32 if m < 1 << 31 else np.int64

    if (letters or 0) <= DICTIONARY:
        listed = names.select("id", "item").toArrow().sort_by("id").column("item").combine_chunks().cast(pa.string())
        numbered = records.mapInArrow(_numbered(listed), "ids array<long>")
    else:
        spread = records.withColumn("r", F.monotonically_increasing_id()).select("r", F.explode("items").alias("item"))
        lists = spread.join(names.select("item", "id"), "item").groupBy("r").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        numbered = lists.where(F.size("ids") > 1).select("ids")
    coded = stored(numbered)

    width = max(1, math.ceil(m / SLICES))
    slices = math.ceil(m / width) + 1
    load = np.zeros(slices, np.int64)
    for r in coded.mapInArrow(_loads(width, slices), "slice long, pairs long").groupBy("slice").agg(F.sum("pairs").alias("pairs")).collect():
        load[r.slice] = r.pairs
    quota = range_pairs or max(1, min(RANGE, math.ceil(int(load.sum()) / (2 * parallelism(spark)))))
    range_of, salts, filled = np.zeros(slices, np.int64), [1], 0
    for s, n in enumerate(load.tolist()):
        if filled and filled + n > quota:
            salts.append(1)
            filled = 0
        filled += n
        range_of[s] = len(salts) - 1
        salts[-1] = max(1, math.ceil(filled / quota))
    salts_of = np.array(salts)
    first_task = np.cumsum(salts_of) - salts_of
    bounds = np.concatenate([np.flatnonzero(np.diff(range_of, prepend=-1)) * width, [m]])
    if int(np.diff(bounds).max()) * m >= 1 << 62:
        raise ValueError("a range of leaders times all items must fit into 62 bits: lower range_pairs")

    dense = coded.mapInArrow(_popcounts(heavy, heavy_from), _SQL).groupBy("a", "b").agg(F.sum("n").alias("n")) if heavy > 1 else None
    dealt = coded.mapInArrow(_dealt(range_of, width, first_task, salts_of, heavy_from, kind), "task int, ids binary, sizes binary")
    tasks = int(salts_of.sum())
    gathered = dealt.repartitionById(tasks, F.col("task"))
    rest = gathered.mapInArrow(_counted(bounds, np.repeat(np.arange(len(salts)), salts_of), salts_of > 1, m, heavy_from, min_pair, kind), _SQL)
    if tasks > len(salts):
        # the ranges that were dealt out by record; the others' pairs are whole already and pass through
        rest = rest.groupBy("a", "b").agg(F.sum("n").alias("n"))
    summed = (rest if dense is None else rest.unionByName(dense)).where(F.col("n") >= min_pair)

    side = lambda c, x, n: names.select(F.col("id").alias(c), F.col("item").alias(x), F.col("n").alias(n))
    pairs = summed.withColumnRenamed("n", "n_ab").join(side("a", "x", "nx"), "a").join(side("b", "y", "ny"), "b")
    swap = F.col("x") > F.col("y")
    out = pairs.select(
        F.least("x", "y").alias("item_a"),
        F.greatest("x", "y").alias("item_b"),
        "n_ab",
        F.when(swap, F.col("ny")).otherwise(F.col("nx")).alias("n_a"),
        F.when(swap, F.col("nx")).otherwise(F.col("ny")).alias("n_b"),
        F.lit(total).cast("long").alias("n_records"),
        (F.col("n_ab") * F.lit(float(total)) / (F.col("nx").cast("double") * F.col("ny"))).alias("lift"),
    )
    if min_lift is None:
        return out
    exact = F.lit(str(min_lift)).cast("decimal(10,4)")
    big = lambda c: F.col(c).cast("decimal(14,0)")
    return out.where(big("n_ab") * big("n_records") >= exact * big("n_a") * big("n_b"))
