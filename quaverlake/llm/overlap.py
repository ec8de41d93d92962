"""Records of evaluation splits that also stand, wholly or nearly, in the training split.

Records count as sets of items, so each is normalised to a sequence of item codes (some bits of a
hash) in one order for all: by hash, with the items of very many records last, rarest of them first.
If two sets A, B have |A & B| >= t |A | B|, they differ in at most d = (1 - t) |A| / t items. Each of
these breaks at most one of d + 1 passages into which the sequence of A is cut; so one passage at
least stands unbroken in the sequence of B. Evaluation passages go into Aho-Corasick automata,
which scan the training texts. Matched intervals are merged into a coverage per pair of records,
pairs that can't reach t are dropped by length and position, and what is left is checked exactly. No
overlap is lost; a hash collision only costs a check.

All passages go into as few automata as memory allows; if there are several, a passage lies in the
shard of its first (rarest) item, and a text goes once to each shard that it has an item of. The
passages and texts of every shard are counted first: a shard with too many passages is split by
evaluation record, one with too many texts by text, so no item, however frequent, fills one task.

Equal sets are scanned once: the work is on classes of equal sets, and so is the result, with a
table of members beside it; pairs of records are a view of the two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaverlake.llm.common import clean_ids, one_row_per_key, ragged
from quaverlake.session import parallelism, stored

CODE_BITS = 20
#: A code is four letters of five bits; each place has its own alphabet, so no match starts inside a code.
_PLACES = np.array([[15, 0x0100], [10, 0x0200], [5, 0x0300], [0, 0x0400]])
_END = "\x01"
#: Items in this share of the sets (but at least LEAST) come last in a sequence: at most (mean length) / FREQUENT items.
FREQUENT = 1 / 1000
LEAST = 64
_FOUND = pa.schema([("eval_set", pa.int64()), ("train_set", pa.int64()), ("covered", pa.int32())])
_PACKED_SQL = "task int, kind int, sets binary, sizes binary, codes binary"


def _letters(codes: np.ndarray) -> str:
    text = np.empty((len(codes), 4), np.uint32)
    for k, (shift, base) in enumerate(_PLACES):
        text[:, k] = ((codes >> shift) & 31) + base
    return text.tobytes().decode("utf-32-le")


def passages(length: int, threshold: float) -> list[tuple[int, int]]:
    """Bounds of the passages of a sequence, one more than the changes that the threshold allows."""
    parts = min(length, math.floor(length * (1 - threshold) / threshold + 1e-9) + 1)
    return [(length * k // parts, length * (k + 1) // parts) for k in range(parts)]


def _heads(lengths: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first items of all passages of all sequences, one after the other, and the sequence of each."""
    parts = np.minimum(lengths, np.floor(lengths * (1 - threshold) / threshold + 1e-9).astype(np.int64) + 1)
    row = np.repeat(np.arange(len(lengths)), parts)
    k = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    return (np.cumsum(lengths) - lengths)[row] + lengths[row] * k // parts[row], row


def _sequences(batch: pa.RecordBatch, frequent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all sequences in order, and their lengths. ``frequent``: sorted hashes of frequent items."""
    hashes, lengths = ragged(batch.column("hashes"))
    row = np.repeat(np.arange(len(lengths)), lengths)
    late = np.zeros(len(hashes), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        late = np.where(frequent[at] == hashes, rank[at] + 1, 0)
    return (hashes & ((1 << CODE_BITS) - 1))[np.lexsort((hashes, late, row))], lengths.astype(np.int64)


def _distinct(row: np.ndarray, shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(row * shards + shard)
    return both // shards, both % shards


def _loads(frequent: np.ndarray, rank: np.ndarray, threshold: float, shards: int):
    """Passages and texts of each shard."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, shards), np.int64)
        for batch in source:
            codes, lengths = _sequences(batch, frequent, rank)
            is_eval, is_train = (batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("is_eval", "is_train"))
            at, row = _heads(lengths, threshold)
            counts[0] += np.bincount(codes[at[is_eval[row]]] % shards, minlength=shards)
            row, shard = _distinct(np.repeat(np.arange(len(lengths)), lengths), codes % shards, shards)
            counts[1] += np.bincount(shard[is_train[row]], minlength=shards)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shards), pa.int32()), pa.array(counts[0]), pa.array(counts[1])], names=["shard", "passages", "texts"])

    return run


def _planes(x: np.ndarray, kind: type) -> bytes:
    """Bytes of one place together, as the high ones are mostly alike."""
    return x.astype(kind).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unplaned(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _dealt(frequent: np.ndarray, rank: np.ndarray, threshold: float, first: np.ndarray, splits: np.ndarray, salts: np.ndarray):
    """Every sequence to its tasks: evaluation sets (kind 0) to all salts of one split of each shard of their
    passages, texts (1) to one salt of all splits of each shard of their items."""
    shards = len(first)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            codes, lengths = _sequences(batch, frequent, rank)
            begin, place = np.cumsum(lengths) - lengths, np.abs(ids >> CODE_BITS)
            flags = [batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("is_eval", "is_train")]
            at, owner = _heads(lengths, threshold)
            rows = []
            for kind, row, shard, copies in (
                (0, *_distinct(owner, codes[at] % shards, shards), salts),
                (1, *_distinct(np.repeat(np.arange(len(lengths)), lengths), codes % shards, shards), splits),
            ):
                keep = flags[kind][row]
                row, shard = row[keep], shard[keep]
                n = copies[shard]
                row, shard, copy = np.repeat(row, n), np.repeat(shard, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                split, salt = (place[row] % splits[shard], copy) if kind == 0 else (copy, place[row] % salts[shard])
                task = first[shard] + split * salts[shard] + salt
                order = np.argsort(task, kind="stable")
                row, task = row[order], task[order]
                edges = [*np.flatnonzero(np.diff(task, prepend=-1)).tolist(), len(task)]
                for lo, hi in zip(edges, edges[1:], strict=False):
                    r = row[lo:hi]
                    size = lengths[r]
                    flat = codes[np.repeat(begin[r] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                    rows.append((int(task[lo]), kind, _planes(ids[r], np.int64), _planes(size, np.int32), _planes(flat, np.int32)))
            if rows:
                t, k, *packed = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(k, pa.int32()), *[pa.array(p, pa.binary()) for p in packed]], names=["task", "kind", "sets", "sizes", "codes"])

    return run


class _Shard:
    def __init__(self, threshold: float, shards: int, shard: int):
        self.threshold, self.shards, self.shard = threshold, shards, shard
        self.patterns: dict[str, list[tuple[int, int, int]]] = {}
        self.keys: list[int] = []
        self.codes: list[np.ndarray] = []
        self.automaton = None

    def add(self, key: int, codes: np.ndarray) -> None:
        self.keys.append(key)
        self.codes.append(codes)
        text = _letters(codes)
        for lo, hi in passages(len(codes), self.threshold):
            if codes[lo] % self.shards == self.shard:
                self.patterns.setdefault(text[4 * lo : 4 * hi], []).append((len(self.keys) - 1, lo, hi))

    def scan(self, keys: list[int], codes: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, int]]:
        import ahocorasick

        if not self.patterns:
            return
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for pattern, where in self.patterns.items():
                self.automaton.add_word(pattern, (len(pattern) // 4, where))
            self.automaton.make_automaton()
        starts = np.cumsum(lengths) - lengths
        letters = _letters(codes)
        text = _END.join(letters[4 * s : 4 * (s + n)] for s, n in zip(starts.tolist(), lengths.tolist(), strict=True))
        begins = starts * 4 + np.arange(len(starts))
        hits = list(self.automaton.iter(text))
        if not hits:
            return
        rows = np.searchsorted(begins, np.fromiter((h[0] for h in hits), np.int64, len(hits)), side="right") - 1
        pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for (end, (size, where)), row in zip(hits, rows.tolist(), strict=True):
            n = int(lengths[row])
            at = (end + 1 - int(begins[row])) // 4 - size
            for e, lo, hi in where:
                m = len(self.codes[e])
                best = min(lo, at) + size + min(m - hi, n - at - size)
                if best >= self.threshold * (m + n - best) - 1e-9:
                    pairs.setdefault((e, row), []).append((lo, hi))
        for (e, row), spans in pairs.items():
            covered = end = 0
            for lo, hi in sorted(spans):
                covered += max(0, hi - max(lo, end))
                end = max(end, hi)
            mine, other = self.codes[e], codes[starts[row] : starts[row] + lengths[row]]
            common = _common(mine, other)
            if common >= self.threshold * (len(mine) + len(other) - common) - 1e-9:
                yield self.keys[e], keys[row], covered


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the multiset intersection; a collision inside a record can only make it larger."""
    x, y = a.tolist(), b.tolist()
    if len(set(x)) == len(x) and len(set(y)) == len(y):
        return len(set(x).intersection(y))
    return sum(min(x.count(v), y.count(v)) for v in set(x))


def _scan(threshold: float, shards: int, shard_of: np.ndarray):
    """Rows of one task sorted by kind: its evaluation sets, then the texts."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in source:
            for task, kind, sets, sizes, codes in zip(*[batch.column(c).to_pylist() for c in ("task", "kind", "sets", "sizes", "codes")], strict=True):
                shard = shard or _Shard(threshold, shards, int(shard_of[task]))
                keys, lengths, flat = _unplaned(sets, np.int64).tolist(), _unplaned(sizes, np.int32).astype(np.int64), _unplaned(codes, np.int32)
                if kind == 0:
                    for key, codes_of in zip(keys, np.split(flat, np.cumsum(lengths)[:-1]), strict=True):
                        shard.add(key, codes_of)
                else:
                    found = list(shard.scan(keys, flat, lengths))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found, strict=True), _FOUND, strict=True)], schema=_FOUND)

    return run


def _normalised(df: DataFrame, key: str, split: str, items: str, train: list[str], evaluation: list[str], carry: tuple[str, ...]) -> DataFrame:
    """(key, split, is_eval, items, class_key, *carry) of every row of a known split with a key and an item."""
    base = df.select(F.col(key).alias("key"), F.col(split).alias("split"), F.array_sort(clean_ids(items)).alias("items"), *[F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)])
    exact = F.concat_ws("", F.transform("items", lambda x: F.concat(F.length(x), F.lit(":"), x)))
    known = base.where(F.col("key").isNotNull() & F.col("split").isin([*train, *evaluation]) & (F.size("items") > 0))
    return known.withColumn("is_eval", F.col("split").isin(evaluation)).withColumn("class_key", F.unhex(F.md5(exact)))


def overlap_classes(
    df: DataFrame,
    key: str = "prefix_id",
    split: str = "split_name",
    items: str = "item_ids",
    train: tuple[str, ...] = ("train",),
    evaluation: tuple[str, ...] = ("val", "test"),
    threshold: float = 0.8,
    carry: tuple[str, ...] = (),
    shard_passages: int = 250_000,
    text_rows: int = 500_000,
) -> tuple[DataFrame, DataFrame]:
    """Members (key, split, is_eval, class_key, carried_0, ...) and links (eval_class, train_class, common,
    covered): every record with the class of records of equal item sets that it belongs to, and every
    class with evaluation records beside every class with training records whose sets have an
    intersection of at least ``threshold`` of their union (a class of both beside itself too).

    Ids are trimmed, null and blank ones dropped, order and repeats ignored. Records with another
    or a null split, a null key, or no item are in neither. Repeated rows of a key count once (if
    they differ, the one with the largest digest, then split). Only the named columns are read. An empty
    table gives no rows. ``shard_passages`` and ``text_rows`` bound a task; the driver holds the frequent
    items and two counts per shard."""
    spark = df.sparkSession
    rows = stored(_normalised(df, key, split, items, list(train), list(evaluation), carry))
    carried = [f"carried_{i}" for i in range(len(carry))]
    members = stored(one_row_per_key(rows, "key", "class_key", "split", "is_eval", *carried))
    side = lambda flag: F.max(F.when(F.col("is_eval") == flag, True).otherwise(False))
    # a class that only a losing row of a key has links to nobody's member, so it does no harm
    sets = rows.groupBy("class_key").agg(F.max("items").alias("items"), side(True).alias("is_eval"), side(False).alias("is_train"))
    sets = stored(sets.withColumn("id", F.conv(F.hex(F.substring("class_key", 1, 7)), 16, 10).cast("long")))

    m = F.size("items")
    sizes = sets.agg(F.count("*").alias("n"), F.sum(F.when(F.col("is_eval"), F.floor(m * F.lit((1 - threshold) / threshold) + F.lit(1e-9)) + 1)).alias("passages")).first()
    often = max(LEAST, sizes.n * FREQUENT)
    hot = sorted((r.n, r.h) for r in sets.select(F.explode("items").alias("item")).groupBy(F.xxhash64("item").alias("h")).agg(F.count("*").alias("n")).where(F.col("n") >= often).collect())
    hashes = np.array([h for _, h in hot], np.int64)
    order = np.argsort(hashes)
    frequent, rank = hashes[order], np.arange(len(hot))[order]

    shards = max(1, math.ceil((sizes.passages or 0) / shard_passages))
    texts = sets.select("id", "is_eval", "is_train", F.transform("items", lambda x: F.xxhash64(x)).alias("hashes"))
    counted = texts.mapInArrow(_loads(frequent, rank, threshold, shards), "shard int, passages long, texts long")
    loads = np.zeros((2, shards), np.int64)
    for r in counted.groupBy("shard").agg(F.sum("passages").alias("passages"), F.sum("texts").alias("texts")).collect():
        loads[:, r.shard] = r.passages, r.texts
    splits = np.maximum(1, -(-loads[0] // (2 * shard_passages)))
    salts = np.maximum(1, -(-loads[1] // text_rows))
    salts = np.maximum(salts, -(-parallelism(spark) // shards))
    first = np.cumsum(splits * salts) - splits * salts
    tasks = int((splits * salts).sum())
    dealt = texts.mapInArrow(_dealt(frequent, rank, threshold, first, splits, salts), _PACKED_SQL)
    groups = dealt.repartitionById(tasks, F.col("task")).sortWithinPartitions("kind")
    found = groups.mapInArrow(_scan(threshold, shards, np.repeat(np.arange(shards), splits * salts)), "eval_set long, train_set long, covered int")
    pairs = found.groupBy("eval_set", "train_set").agg(F.max("covered").alias("covered"))
    of = lambda flag, name: sets.where(flag).select(F.col("id").alias(f"{name}_set"), F.col("class_key").alias(f"{name}_class"), F.col("items").alias(f"{name}_items"))
    both = pairs.join(of("is_eval", "eval"), "eval_set").join(of("is_train", "train"), "train_set")
    common = F.size(F.array_intersect("eval_items", "train_items"))
    union = F.size("eval_items") + F.size("train_items") - common
    links = both.where(common >= F.lit(threshold) * union - F.lit(1e-9)).select("eval_class", "train_class", common.alias("common"), "covered")
    return members, stored(links)


def split_overlaps(df: DataFrame, key: str = "prefix_id", split: str = "split_name", items: str = "item_ids", train: tuple[str, ...] = ("train",), evaluation: tuple[str, ...] = ("val", "test"), threshold: float = 0.8) -> DataFrame:
    """(eval_key, train_key): every record of an evaluation split and every record of a training
    split whose item sets have an intersection of at least ``threshold`` of their union: the view of
    ``overlap_classes`` by pairs of records, where the cases are defined."""
    members, links = overlap_classes(df, key, split, items, train, evaluation, threshold)
    left = members.where("is_eval").select(F.col("class_key").alias("eval_class"), F.col("key").alias("eval_key"))
    right = members.where("NOT is_eval").select(F.col("class_key").alias("train_class"), F.col("key").alias("train_key"))
    return links.join(left, "eval_class").join(right, "train_class").select("eval_key", "train_key")


def overlapping_records(df: DataFrame, key: str = "prefix_id", split: str = "split_name", items: str = "item_ids", train: tuple[str, ...] = ("train",), evaluation: tuple[str, ...] = ("val", "test"), threshold: float = 0.8) -> DataFrame:
    """(key, split_name, class_id, links, most_common): each evaluation record that some training record
    overlaps, the class of its equals, how many training records overlap it, and the most items it has in
    common with one. Rows grow with the records, however large the classes are."""
    members, links = overlap_classes(df, key, split, items, train, evaluation, threshold)
    sizes = members.where("NOT is_eval").groupBy(F.col("class_key").alias("train_class")).agg(F.count("*").alias("n"))
    per = links.join(sizes, "train_class").groupBy(F.col("eval_class").alias("class_key")).agg(F.sum("n").alias("links"), F.max("common").alias("most_common"))
    return members.where("is_eval").join(per, "class_key").select("key", F.col("split").alias("split_name"), F.lower(F.hex("class_key")).alias("class_id"), "links", "most_common")


def overlap_report(df: DataFrame, key: str = "prefix_id", split: str = "split_name", items: str = "item_ids", source: str = "source", train: tuple[str, ...] = ("train",), evaluation: tuple[str, ...] = ("val", "test"), threshold: float = 0.8) -> DataFrame:
    """(split_name, source, records, overlapping): per evaluation split and source, the records and
    those of them that some training record overlaps. Cases as in ``overlap_classes``."""
    members, links = overlap_classes(df, key, split, items, train, evaluation, threshold, (source,))
    hit = links.select(F.col("eval_class").alias("class_key")).distinct().withColumn("hit", F.lit(1))
    own = members.where("is_eval").groupBy("class_key", F.col("split").alias("split_name"), F.col("carried_0").alias("source")).agg(F.count("*").alias("n"))
    joined = own.join(hit, "class_key", "left")
    return joined.groupBy("split_name", "source").agg(F.sum("n").alias("records"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("overlapping"))
