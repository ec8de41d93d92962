"""Item lists as offset-coded token sequences, and back."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# The token layout of the data.
@dataclass(frozen=True)
class Layout:
    bos: int = 0
    levels: int = 3
    codes: int = 256
    conflict: int = 769
    conflicts: int = 74
    boi: int = 843
    eos: int = 844
    cue: int = 845
    cues: int = 2048
    mask: int = 2893
    active_cues: int = 8

    @property
    def stride(self) -> int:
        return 1 + self.levels + 1 + self.active_cues

    def length(self, items: int) -> int:
        return 2 + items * self.stride


LAYOUT = Layout()


def code_token(level: int, code: Column) -> Column:
    """Codes of level l are 0..255; null outside the range."""
    return F.when(code.between(0, LAYOUT.codes - 1), code + 1 + level * LAYOUT.codes)


def conflict_token(code: Column) -> Column:
    return F.when(code.between(0, LAYOUT.conflicts - 1), code + LAYOUT.conflict)


def cue_token(cue: Column) -> Column:
    return F.when(cue.between(0, LAYOUT.cues - 1), cue + LAYOUT.cue)


def encode_item(semantic: Column, cues: Column) -> Column:
    """``[BOI, z0, z1, z2, conflict, cue x 8]`` from four semantic tokens and raw cue ids (0 fills up)."""
    padded = F.slice(F.concat(cues, F.array_repeat(F.lit(0), LAYOUT.active_cues)), 1, LAYOUT.active_cues)
    return F.concat(F.array(F.lit(LAYOUT.boi)), semantic, F.transform(padded, lambda c: c + LAYOUT.cue))


def encode_lists(lists: DataFrame, key: str, items: str, encoded: DataFrame, item_key: str, tokens: str) -> DataFrame:
    """(key, input_ids, n_items): BOS, the blocks of the list's items in order, EOS. Items without a block are
    left out."""
    rows = lists.select(key, F.posexplode(items).alias("pos", "item"))
    blocks = rows.join(encoded.select(F.col(item_key).alias("item"), F.col(tokens).alias("block")), "item")
    back = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("b"))
    ids = F.concat(F.array(F.lit(LAYOUT.bos)), F.flatten(F.transform("b", lambda x: x["block"])), F.array(F.lit(LAYOUT.eos)))
    return back.select(key, ids.alias("input_ids"), F.size("b").alias("n_items"))


def masks(references: int, items: Column) -> tuple[Column, Column]:
    """(attention, target) masks of a sequence of ``items`` blocks of which the first are references."""
    length = 2 + items * LAYOUT.stride
    first = 1 + references * LAYOUT.stride
    target = F.transform(F.sequence(F.lit(0), length - 1), lambda i: (i >= first) & (i < length - 1))
    return F.array_repeat(F.lit(True), length), target


def encode_playlist(blocks: DataFrame, key: str, pos: str, block: str, references: int, vector: str | None = None, dims: int = 64) -> DataFrame:
    """(key, input_ids, attention_mask, target_mask[, mu, sigma2]): from one row per item of each list, with its
    place from 0, its block of tokens and its vector. Attention is on all but BOS, BOI and EOS; targets are
    the tokens, but for BOI, of the items after the first ``references``; mu and sigma2 are the mean of the references' vectors
    and their mean squared distance from it. Lists of fewer than three items, or not longer than ``references``, have no row."""
    rows = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(block).alias("b"), *([F.col(vector).cast("array<double>").alias("v")] if vector else [])))).alias("x"))
    rows = rows.where((F.size("x") >= 3) & (F.size("x") > references) & F.lit(references >= 2))
    ids = F.concat(F.array(F.lit(LAYOUT.bos)), F.flatten(F.transform("x", lambda r: r["b"])), F.array(F.lit(LAYOUT.eos)))
    item = F.transform("x", lambda r, i: F.concat(F.array(F.lit(False)), F.array_repeat(i >= references, F.size(r["b"]) - 1)))
    out = rows.select(key, ids.alias("input_ids"), F.concat(F.array(F.lit(False)), F.flatten(item), F.array(F.lit(False))).alias("target_mask"), "x")
    attention = F.transform("input_ids", lambda t: ~t.isin(LAYOUT.bos, LAYOUT.boi, LAYOUT.eos))
    columns = [key, "input_ids", attention.alias("attention_mask"), "target_mask"]
    if vector:
        out = out.withColumn("r", F.transform(F.slice("x", 1, references), lambda r: r["v"]))
        total = F.aggregate("r", F.array_repeat(F.lit(0.0), dims), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
        out = out.withColumn("mu", F.transform(total, lambda a: a / references))
        far = F.aggregate(F.transform("r", lambda v: F.aggregate(F.zip_with(v, F.col("mu"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)), F.lit(0.0), lambda s, x: s + x)
        columns += ["mu", (far / references).alias("sigma2")]
    return out.select(*columns)


def tokenised_splits(encoded: DataFrame, key: str, split: str, ids: str, references: int, targets: int, test: str = "test") -> DataFrame:
    """(key, split, input_ids, target_mask, labels): train rows as they are, without labels; rows of split ``test`` cut to
    their references and EOS, nothing in the mask, the semantic tokens of their targets as labels. Rows of another
    number of items than both together have no row."""
    whole = encoded.where(F.size(ids) == LAYOUT.length(references + targets))
    held = F.col(split) == test
    context = F.concat(F.slice(ids, 1, 1 + references * LAYOUT.stride), F.array(F.lit(LAYOUT.eos)))
    label = F.array(*[F.slice(ids, (references + i) * LAYOUT.stride + 3, LAYOUT.levels + 1) for i in range(targets)])
    first = 1 + references * LAYOUT.stride
    mask = F.transform(F.sequence(F.lit(0), F.size(ids) - 1), lambda i: (i > first) & (i < F.size(ids) - 1) & (F.pmod(i - 1, F.lit(LAYOUT.stride)) != 0))
    return whole.select(key, split, F.when(held, context).otherwise(F.col(ids)).alias("input_ids"), F.when(held, F.transform(context, lambda t: F.lit(False))).otherwise(mask).alias("target_mask"), F.when(held, label).alias("labels"))


def completion(context: Column, n: int) -> tuple[Column, Column]:
    """A context (ending in EOS) with ``n`` blocks to fill in before its EOS, and the mask of what to fill:
    all of a block but its BOI."""
    block = F.concat(F.array(F.lit(LAYOUT.boi)), F.array_repeat(F.lit(LAYOUT.mask), LAYOUT.stride - 1))
    body = F.slice(context, F.lit(1), F.size(context) - 1)
    ids = F.concat(body, F.flatten(F.array_repeat(block, n)), F.array(F.lit(LAYOUT.eos)))
    holes = F.transform(ids, lambda t: t == LAYOUT.mask)
    return ids, holes


def legacy_type_ranges(spark, items: int, levels: int = 4, codes: int = 256, boi: int | None = None) -> DataFrame:
    """(pos, low, high): tokens allowed at each position of an older sequence of ``items`` blocks of a BOI and ``levels`` codes, without
    BOS, cues or EOS; code c of level l is l * codes + c + 1, and BOI the next id after all of them unless given."""
    stride = levels + 1
    role = F.pmod(F.col("id"), F.lit(stride))
    mark = levels * codes + 1 if boi is None else boi
    low = F.when(role == 0, mark).otherwise((role - 1) * codes + 1)
    high = F.when(role == 0, mark).otherwise(role * codes)
    return spark.range(items * stride).select(F.col("id").cast("int").alias("pos"), low.cast("int").alias("low"), high.cast("int").alias("high"))


def legacy_encode(lists: DataFrame, key: str, items: str, codes: DataFrame, item_key: str, code_column: str, boi: int | None = None, width: int = 256) -> DataFrame:
    """(key, tokens): older token lists: every item's codes as l * width + c + 1, after a BOI if one is given; items without codes are left out."""
    level = F.transform(code_column, lambda c, i: i * width + c + 1)
    table = codes.select(F.col(item_key).alias("item"), (F.concat(F.array(F.lit(boi)), level) if boi is not None else level).alias("block"))
    rows = lists.select(key, F.posexplode(items).alias("pos", "item")).join(table, "item")
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("b")).select(key, F.flatten(F.transform("b", lambda x: x["block"])).alias("tokens"))


def type_ranges(spark, items: int) -> DataFrame:
    """(pos, low, high): tokens allowed at each position of a sequence of ``items`` blocks."""
    length = LAYOUT.length(items)
    role = F.pmod(F.col("id") - 1, F.lit(LAYOUT.stride))
    edge = F.when(F.col("id") == 0, LAYOUT.bos).when(F.col("id") == length - 1, LAYOUT.eos)
    inner = lambda lo, level, conflict, cue: F.when(role == 0, LAYOUT.boi).when(role <= LAYOUT.levels, level).when(role == LAYOUT.levels + 1, conflict).otherwise(cue)
    low = inner(0, (role - 1) * LAYOUT.codes + 1, LAYOUT.conflict, LAYOUT.cue)
    high = inner(0, role * LAYOUT.codes, LAYOUT.conflict + LAYOUT.conflicts - 1, LAYOUT.cue + LAYOUT.cues - 1)
    return spark.range(length).select(F.col("id").cast("int").alias("pos"), F.coalesce(edge, low).cast("int").alias("low"), F.coalesce(edge, high).cast("int").alias("high"))


def decode(sequences: DataFrame, key: str, ids: str) -> DataFrame:
    """(key, slot, codes, conflict, cues): the whole blocks of each sequence, from its first BOI to its EOS;
    a remainder is dropped. Codes are raw; a token outside its range gives null."""
    tokens = F.col(ids)
    end = F.array_position(tokens, F.lit(LAYOUT.eos))
    upto = F.when(end > 0, end - 1).otherwise(F.size(tokens))
    begin = F.array_position(tokens, F.lit(LAYOUT.boi))
    n = F.floor((upto - begin + 1) / LAYOUT.stride).cast("int")
    some = sequences.where((begin > 0) & (n > 0)).select(key, tokens.alias("t"), begin.cast("int").alias("b"), F.explode(F.sequence(F.lit(0), n - 1)).alias("slot"))
    block = some.select(key, "slot", F.slice("t", F.col("b") + F.col("slot") * LAYOUT.stride, LAYOUT.stride).alias("x"))
    at = lambda i: F.element_at("x", i + 1)
    code = lambda level: F.when((at(1 + level) > level * LAYOUT.codes) & (at(1 + level) <= (level + 1) * LAYOUT.codes), at(1 + level) - 1 - level * LAYOUT.codes)
    conflict = at(1 + LAYOUT.levels) - LAYOUT.conflict
    cues = F.transform(F.slice("x", 3 + LAYOUT.levels, LAYOUT.active_cues), lambda t: F.when(t.between(LAYOUT.cue, LAYOUT.cue + LAYOUT.cues - 1), t - LAYOUT.cue))
    return block.select(key, "slot", F.array(*[code(level) for level in range(LAYOUT.levels)]).alias("codes"), F.when(conflict.between(0, LAYOUT.conflicts - 1), conflict).alias("conflict"), cues.alias("cues"))


def conflict_digits(coded: DataFrame, key: str, codes: str, order: str) -> DataFrame:
    """(key, digit): the row's place among those with the same codes, from 1, by ``order``. Tens of rows share
    codes in a sound codebook; the window is by code, not over all rows."""
    return coded.select(key, F.row_number().over(Window.partitionBy(codes).orderBy(order, key)).alias("digit"))


def conflict_levels(digits: DataFrame, digit: str, levels: int = LAYOUT.levels, codes: int = LAYOUT.codes) -> DataFrame:
    """(most, codes, rows, space_share): how many codes are shared by ``most`` rows, the rows they have, and the share
    of all codes * levels combinations that they are. ``digits`` has one row per row, numbered within its code."""
    again = digits.groupBy(F.col(digit).alias("at")).agg(F.count("*").alias("n"))
    # n rows have place d, so n(d) - n(d + 1) codes end there
    after = again.select((F.col("at") - 1).alias("at"), F.col("n").alias("more"))
    ends = again.join(after, "at", "left").select(F.col("at").alias("most"), (F.col("n") - F.coalesce("more", F.lit(0))).alias("codes")).where("codes > 0")
    return ends.select("most", "codes", (F.col("most") * F.col("codes")).alias("rows"), (F.col("codes") / F.lit(float(codes**levels))).alias("space_share"))


def allowed_next(coded: DataFrame, codes: str, used: DataFrame) -> DataFrame:
    """(prefix, next): as ``prefix_index``, without the tokens under which every code is in ``used`` (a table of codes,
    column ``codes``): a prefix whose codes are all used up leads nowhere."""
    rows = coded.select(F.col(codes).alias("c")).where(F.size("c") > 0).distinct()
    return prefix_index(rows.join(used.select(F.col("codes").alias("c")).distinct(), "c", "left_anti"), "c")


def prefix_index(coded: DataFrame, codes: str) -> DataFrame:
    """(prefix, next): for every prefix of a code, empty one included, the tokens that may follow, sorted."""
    rows = coded.select(F.col(codes).alias("c")).where(F.size("c") > 0).distinct()
    steps = rows.select("c", F.explode(F.sequence(F.lit(0), F.size("c") - 1)).alias("i"))
    pairs = steps.select(F.slice("c", F.lit(1), F.col("i")).alias("prefix"), F.element_at("c", F.col("i") + 1).alias("n"))
    return pairs.groupBy("prefix").agg(F.array_sort(F.collect_set("n")).alias("next"))


def chunks(lists: DataFrame, order: str, tokens: str, block: int, bos: int = LAYOUT.bos, eos: int = LAYOUT.eos, slices: int = 1024) -> DataFrame:
    """(chunk, tokens): all lists one after the other in ``order`` (unique), cut into blocks of ``block`` - 2 and
    framed by BOS and EOS; the remainder is dropped. Places come from counts per slice of the order, so
    neither the ranking nor the cutting gathers everything in a task."""
    inner = block - 2
    sized = lists.where(F.size(tokens) > 0).select(F.col(order).alias("o"), F.col(tokens).alias("t"))
    bounds = sized.agg(F.min("o").alias("lo"), F.max("o").alias("hi"))
    width = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1) / slices))
    parted = sized.crossJoin(F.broadcast(bounds)).select("o", "t", F.floor((F.col("o") - F.col("lo")) / width).alias("s"))
    counts = parted.groupBy("s").agg(F.sum(F.size("t")).alias("n"))
    offsets = counts.select("s", F.coalesce(F.sum("n").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n0"), F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    before = F.coalesce(F.sum(F.size("t")).over(Window.partitionBy("s").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parted.withColumn("b", before).join(F.broadcast(offsets), "s").select((F.col("b") + F.col("n0")).alias("at"), "t", "total")
    # a list gives each chunk one piece
    first, last = F.floor(F.col("at") / inner), F.floor((F.col("at") + F.size("t") - 1) / inner)
    pieces = placed.select("at", "t", "total", F.explode(F.sequence(first, last)).alias("chunk"))
    lo = F.greatest(F.lit(0), F.col("chunk") * inner - F.col("at"))
    hi = F.least(F.size("t"), (F.col("chunk") + 1) * inner - F.col("at"))
    cut_pieces = pieces.where((F.col("chunk") + 1) * inner <= F.col("total")).select("chunk", F.struct("at", F.slice("t", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("p")).alias("x"))
    whole = cut_pieces.groupBy("chunk").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return whole.select("chunk", F.concat(F.array(F.lit(bos)), F.flatten(F.transform("x", lambda p: p["p"])), F.array(F.lit(eos))).alias("tokens"))


def padded(sequences: DataFrame, batch: str, tokens: str, fill: int = 0) -> DataFrame:
    """The sequences of each batch filled up to its longest one, with ``mask``: what is a token."""
    longest = sequences.groupBy(batch).agg(F.max(F.size(tokens)).alias("__n"))
    joined = sequences.join(longest, batch)
    missing = F.col("__n") - F.size(tokens)
    mask = F.concat(F.array_repeat(F.lit(True), F.size(tokens)), F.array_repeat(F.lit(False), missing))
    return joined.withColumn("mask", mask).withColumn(tokens, F.concat(tokens, F.array_repeat(F.lit(fill), missing))).drop("__n")


def remap_pairs(spark, source_size: int, source_boi: int, source_eos: int) -> DataFrame:
    """(source, target): ids of an older vocabulary without cues in this layout."""
    same = spark.range(0, LAYOUT.conflict + LAYOUT.conflicts).select(F.col("id").cast("int").alias("source"), F.col("id").cast("int").alias("target")).where(~F.col("source").isin(source_boi, source_eos) & (F.col("source") < source_size))
    marks = spark.createDataFrame([(source_boi, LAYOUT.boi), (source_eos, LAYOUT.eos)], "source int, target int")
    return same.unionByName(marks)


def rvq_encode(vectors: DataFrame, key: str, vector: str, books: np.ndarray) -> DataFrame:
    """(key, codes): greedy residual codes: at each level the nearest codeword, first on a tie, subtracted
    before the next. ``books`` (levels, codes, dims) is a bounded codebook that goes to the tasks."""

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in source:
            r = np.stack(pdf["v"].to_numpy())
            out = []
            for book in books:
                d = (r * r).sum(1)[:, None] - 2 * r @ book.T + (book * book).sum(1)
                near = np.argmin(np.round(d, 9), axis=1)
                out.append(near)
                r = r - book[near]
            yield pd.DataFrame({key: pdf["k"], "codes": list(np.stack(out, axis=1).astype(np.int32))})

    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInPandas(run, f"`{key}` {kind}, codes array<int>")


def rvq_decode(coded: DataFrame, key: str, codes: str, books: DataFrame, dims: int) -> DataFrame:
    """(key, vector): sum of the codewords. ``books`` has (level, code, vec) and is small enough to broadcast:
    levels x codes rows."""
    rows = coded.select(key, F.posexplode(codes).alias("level", "code"))
    joined = rows.join(F.broadcast(books), ["level", "code"])
    sums = [F.sum(F.element_at("vec", i + 1).cast("double")).alias(f"s{i}") for i in range(dims)]
    return joined.groupBy(key).agg(*sums).select(key, F.array(*[F.col(f"s{i}") for i in range(dims)]).alias("vector"))


def books_table(spark, books: np.ndarray) -> DataFrame:
    rows = [(level, code, [float(x) for x in v]) for level, book in enumerate(books) for code, v in enumerate(book)]
    return spark.createDataFrame(rows, "level int, code int, vec array<double>")


def rvq_fit(vectors: DataFrame, vector: str, levels: int = 3, codes: int = 256, sample: int = 20_000, seed: int = 7) -> np.ndarray:
    """Codebooks by k-means on the residuals of at most ``sample`` rows, chosen by hash."""
    rows = vectors.select(F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL").orderBy(F.xxhash64("v")).limit(sample).toArrow()
    r = np.array(rows.column("v").to_pylist(), float)
    rng = np.random.default_rng(seed)
    books = []
    for _ in range(levels):
        c = r[rng.permutation(len(r))[:codes]].copy()
        for _ in range(10):
            near = np.argmin((c * c).sum(1) - 2 * r @ c.T, axis=1)
            for k in range(len(c)):
                if (near == k).any():
                    c[k] = r[near == k].mean(0)
        near = np.argmin((c * c).sum(1) - 2 * r @ c.T, axis=1)
        r = r - c[near]
        books.append(c)
    return np.stack(books)
