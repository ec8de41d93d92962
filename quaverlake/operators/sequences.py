"""Event logs to gap-bounded, fixed-length windows, with hashed splits and capped sampling.

A user may hold a third of a log, so no step gathers a user in one task. Positions come from
counts of (user, slice of time), summed up over slices, plus a rank within the slice; windows
are cut in blocks of consecutive mapped events that overlap by a window's length less one; run
numbers and run starts are summed up over blocks. Only the sums, a row per user and slice or
block, are ordered by user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaverlake.functions import hashing

#: Mapped events in a block.
BLOCK = 4096


def clean_log(log: DataFrame, key: str = "source_row", user: str = "user_id", item: str = "item_id", ts: str = "played_at") -> DataFrame:
    """(user, ts, source_row, item): one row per non-null ``key`` with a user; items trimmed, null and
    blank ones null (unmapped). Rows delivered twice are equal; should they differ, the largest counts."""
    row = F.struct(F.col(user).cast("string").alias("user"), F.col(ts).alias("ts"), F.nullif(F.trim(F.col(item).cast("string")), F.lit("")).alias("item"))
    once = log.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("source_row")).agg(F.max(row).alias("r"))
    return once.select("r.user", "r.ts", "source_row", "r.item").where("user IS NOT NULL AND ts IS NOT NULL")


def _before(column: str) -> Column:
    return F.coalesce(F.sum(column).over(Window.partitionBy("user").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def positions(log: DataFrame, slice_unit: str = "DAY") -> DataFrame:
    """Mapped events with rn, the place among all events of the user in (ts, source_row) order, and
    mrn, the place among the mapped ones, both from 1."""
    sliced = log.withColumn("slice", F.date_trunc(slice_unit, F.col("ts").cast("timestamp")))
    counts = sliced.groupBy("user", "slice").agg(F.count("*").alias("n"), F.count("item").alias("m"))
    offsets = counts.select("user", "slice", _before("n").alias("n0"), _before("m").alias("m0"))
    order = Window.partitionBy("user", "slice").orderBy("ts", "source_row")
    ranked = sliced.withColumn("rn", F.row_number().over(order)).withColumn("mrn", F.count("item").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = ranked.where("item IS NOT NULL").join(offsets, ["user", "slice"])
    return placed.select("user", "ts", "source_row", "item", (F.col("rn") + F.col("n0")).alias("rn"), (F.col("mrn") + F.col("m0")).alias("mrn"))


def _blocks(mapped: DataFrame, window: int, block: int, *extra: str) -> DataFrame:
    """Each mapped event in its own block, and the last window - 1 of a block also before the next."""
    at = F.col("mrn") - 1
    home = F.floor(at / block)
    homes = F.when(at % block >= block - (window - 1), F.array(home, home + 1)).otherwise(F.array(home))
    return mapped.withColumn("block", F.explode(homes)).withColumn("own", F.col("block") == home)


def windows(mapped: DataFrame, gap: int | None, window: int = 20, block: int = BLOCK) -> DataFrame:
    """(user, run_index, start_index, end_ts, items) of every ``window`` consecutive mapped events
    without more than ``gap`` unmapped ones between neighbours (None: any number). Runs and starts
    count from 0 per user; ``mapped`` is what ``positions`` gives."""
    if window < 2 or block < window:
        raise ValueError("a window has at least two events and fits into a block")
    parted = _blocks(mapped, window, block)
    order = Window.partitionBy("user", "block").orderBy("mrn")
    skipped = F.col("rn") - F.lag("rn").over(order) - 1
    broken = F.col("mrn") == 1 if gap is None else (F.col("mrn") == 1) | (skipped > gap)
    flagged = parted.withColumn("starts", F.coalesce(broken, F.lit(False)).cast("int"))
    over = order.rowsBetween(-(window - 1), 0)
    inner = order.rowsBetween(-(window - 2), 0)
    own_runs = F.sum(F.when(F.col("own"), F.col("starts")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    own_start = F.max(F.when(F.col("own") & (F.col("starts") == 1), F.col("mrn"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    seen = flagged.select("user", "block", "own", "mrn", "ts", "starts", own_runs.alias("runs"), own_start.alias("start"), F.sum("starts").over(inner).alias("breaks"), F.count("*").over(over).alias("length"), F.collect_list("item").over(over).alias("items"))
    own = seen.where("own")
    summary = flagged.where("own").groupBy("user", "block").agg(F.sum("starts").alias("r"), F.max(F.when(F.col("starts") == 1, F.col("mrn"))).alias("s"))
    earlier = Window.partitionBy("user").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select("user", "block", F.coalesce(F.sum("r").over(earlier), F.lit(0)).alias("r0"), F.max("s").over(earlier).alias("s0"))
    full = own.where((F.col("length") == window) & (F.col("breaks") == 0)).drop("length", "breaks", "starts", "own")
    joined = full.join(carried, ["user", "block"])
    run = F.col("runs") + F.col("r0") - 1
    start = F.col("mrn") - F.coalesce("start", "s0") - (window - 1)
    return joined.select("user", run.alias("run_index"), start.alias("start_index"), F.col("ts").alias("end_ts"), "items")


def with_verdict(wins: DataFrame, references: int = 15, min_references: int = 8, min_targets: int = 3) -> DataFrame:
    """Adds unique_references, unique_targets and verdict: ``references`` if too few distinct ones, else
    ``targets`` if too few of those, else ``kept``."""
    refs, targets = F.slice("items", 1, references), F.slice("items", F.lit(references + 1), F.size("items"))
    out = wins.withColumn("unique_references", F.size(F.array_distinct(refs))).withColumn("unique_targets", F.size(F.array_distinct(targets)))
    verdict = F.when(F.col("unique_references") < min_references, "references").when(F.col("unique_targets") < min_targets, "targets").otherwise("kept")
    return out.withColumn("verdict", verdict)


def sampled(kept: DataFrame, seed: int = 42, test_fraction: float = 0.2, cap: int = 16) -> DataFrame:
    """Of each test user the latest window, of each train user the ``cap`` windows (0: all) with the
    lowest hashed priority; ties by run and start. Adds split_name."""
    test = F.col("split_name") == "test"
    labelled = kept.withColumn("split_name", hashing.split_of(F.col("user"), seed, test_fraction))
    # one ranking serves both: test users by latest run and start, train users by priority
    priority = F.when(test, "").otherwise(hashing.window_priority(F.col("user"), F.col("run_index"), F.col("start_index"), seed))
    turned = [F.when(test, -F.col(c)).otherwise(F.col(c)).alias(f"by_{c}") for c in ("run_index", "start_index")]
    ranked = labelled.select("*", priority.alias("priority"), *turned)
    place = F.row_number().over(Window.partitionBy("user").orderBy("priority", "by_run_index", "by_start_index"))
    if not cap:
        latest = ranked.where(test).withColumn("place", place).where("place <= 1")
        chosen = latest.unionByName(ranked.where(~test).withColumn("place", F.lit(1)))
    else:
        # the literal bound lets Spark cut each user's rows before the shuffle
        chosen = ranked.withColumn("place", place).where(F.col("place") <= cap).where(~test | (F.col("place") == 1))
    return chosen.select("user", "run_index", "start_index", "end_ts", "items", "split_name")


def record_lines(chosen: DataFrame, seed: int = 42, prefix: str = "m4a") -> DataFrame:
    """split_name, record_id and the line that a text sink writes."""
    record = F.format_string(f"{prefix}-%s-%s-r%04d-s%08d", F.col("split_name"), hashing.pseudonym(F.col("user"), seed), F.col("run_index"), F.col("start_index"))
    out = chosen.select("split_name", record.alias("record_id"), "items")
    return out.select("split_name", "record_id", F.concat_ws(",", F.col("record_id"), F.concat_ws(",", "items")).alias("line"))


def repeat_stats(kept: DataFrame, references: int = 15) -> DataFrame:
    """One row: windows with any repeat, with a target among the references, with equal targets, and
    how many targets are among the references."""
    refs, targets = F.slice("items", 1, references), F.slice("items", F.lit(references + 1), F.size("items"))
    again = F.size(F.filter(targets, lambda x: F.array_contains(refs, x)))
    return kept.select(
        (F.size(F.array_distinct("items")) < F.size("items")).cast("long").alias("r"), (again > 0).cast("long").alias("o"), again.cast("long").alias("n"), (F.size(F.array_distinct(targets)) < F.size(targets)).cast("long").alias("d")
    ).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("r", "windows_with_repeat"), ("o", "windows_with_overlap"), ("n", "overlapping_targets"), ("d", "windows_with_equal_targets"))])


def capped_counts(kept: DataFrame, caps: list[int], seed: int, test_fraction: float) -> DataFrame:
    """(cap, windows): what each cap would leave of the train users' windows."""
    per_user = kept.where(hashing.split_of(F.col("user"), seed, test_fraction) == "train").groupBy("user").agg(F.count("*").alias("n"))
    grid = per_user.select("n", F.explode(F.array(*[F.lit(c) for c in caps])).alias("cap"))
    return grid.groupBy("cap").agg(F.sum(F.least("n", "cap")).cast("long").alias("windows"))


def gap_audit(mapped: DataFrame, thresholds: list[int | None], window: int = 20, references: int = 15) -> DataFrame:
    """(threshold, windows, users, unique_window_share, five_target_share) for each gap; -1 stands for
    any gap. One pass over the mapped events: a window is one at every threshold that its widest gap doesn't exceed."""
    parted = _blocks(mapped, window, BLOCK)
    order = Window.partitionBy("user", "block").orderBy("mrn")
    skipped = parted.withColumn("skipped", F.coalesce(F.col("rn") - F.lag("rn").over(order) - 1, F.lit(0)))
    over = order.rowsBetween(-(window - 1), 0)
    seen = skipped.select("user", "own", F.max("skipped").over(order.rowsBetween(-(window - 2), 0)).alias("widest"), F.count("*").over(over).alias("length"), F.collect_list("item").over(over).alias("items"))
    full = seen.where(F.col("own") & (F.col("length") == window)).select("user", "widest", (F.size(F.array_distinct("items")) == window).cast("int").alias("u"), (F.size(F.array_distinct(F.slice("items", references + 1, window - references))) == window - references).cast("int").alias("f"))
    # the widest gap only matters as the first threshold that allows it
    limits = sorted(g for g in thresholds if g is not None)
    least = F.coalesce(*[F.when(F.col("widest") <= g, F.lit(g)) for g in limits], F.lit(1 << 30)) if limits else F.lit(1 << 30)
    few = full.groupBy("user", least.alias("least")).agg(F.count("*").alias("n"), F.sum("u").alias("u"), F.sum("f").alias("f"))
    every = few.select("*", F.explode(F.array(*[F.lit((1 << 31) - 1 if g is None else g).cast("long") for g in thresholds])).alias("limit")).where("least <= limit")
    per_user = every.groupBy(F.when(F.col("limit") == (1 << 31) - 1, -1).otherwise(F.col("limit")).cast("int").alias("threshold"), "user").agg(F.sum("n").alias("n"), F.sum("u").alias("u"), F.sum("f").alias("f"))
    return per_user.groupBy("threshold").agg(F.sum("n").alias("windows"), F.count("*").alias("users"), (F.sum("u") / F.sum("n")).alias("unique_window_share"), (F.sum("f") / F.sum("n")).alias("five_target_share"))


def interaction_stats(log: DataFrame, window: int = 20) -> DataFrame:
    """One row over a cleaned log: events, mapped ones, their share, users, and the windows that the mapped
    events alone would give, sum of max(0, n - window + 1)."""
    per_user = log.groupBy("user").agg(F.count("*").alias("n"), F.count("item").alias("m"))
    return per_user.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("events"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("mapped"),
        F.coalesce(F.sum("m") / F.sum("n"), F.lit(0.0)).alias("mapped_share"),
        F.count("*").alias("users"),
        F.count(F.when(F.col("m") > 0, 1)).alias("mapped_users"),
        F.coalesce(F.sum(F.greatest(F.lit(0), F.col("m") - (window - 1))), F.lit(0)).alias("filtered_windows"),
    )


def users_at_least(log: DataFrame, thresholds: list[int]) -> DataFrame:
    """(threshold, users) with at least so many mapped events."""
    per_user = log.groupBy("user").agg(F.count("item").alias("m"))
    grid = per_user.select("m", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    return grid.groupBy("threshold").agg(F.count(F.when(F.col("m") >= F.col("threshold"), 1)).alias("users"))


def file_order_streaks(log: DataFrame, window: int = 20, block: int = 1 << 16) -> DataFrame:
    """One row: in the order of source_row, the windows of uninterrupted mapped events of one user, steps
    in time up and down within a user, and users_together: whether each user's rows lie together, so that there are as
    many stretches of one user as users. Worked in blocks of source_row: of each block only its first and last stretch are carried over."""
    b = log.withColumn("block", F.floor(F.col("source_row") / block))
    order = Window.partitionBy("block").orderBy("source_row")
    prev_user, prev_item, prev_ts = F.lag("user").over(order), F.lag(F.col("item").isNotNull()).over(order), F.lag("ts").over(order)
    marked = b.select("block", "source_row", "user", "ts", F.col("item").isNotNull().alias("mapped"), F.coalesce((prev_user != F.col("user")) | (prev_item != F.col("item").isNotNull()), F.lit(True)).cast("int").alias("cut"), (prev_user == F.col("user")).alias("same"), prev_ts.alias("before"))
    island = marked.withColumn("stretch", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = island.groupBy("block", "stretch").agg(F.min("source_row").alias("at"), F.max("source_row").alias("until"), F.min("user").alias("user"), F.first("mapped").alias("mapped"), F.count("*").alias("n"), F.min_by("ts", "source_row").alias("first_ts"), F.max_by("ts", "source_row").alias("last_ts"), F.sum(F.when(F.col("same") & (F.col("ts") > F.col("before")), 1).otherwise(0)).alias("up"), F.sum(F.when(F.col("same") & (F.col("ts") < F.col("before")), 1).otherwise(0)).alias("down"))
    last = F.max("stretch").over(Window.partitionBy("block"))
    edged = stretches.withColumn("edge", (F.col("stretch") == 1) | (F.col("stretch") == last))
    gain = lambda n: F.greatest(F.lit(0), n - (window - 1))
    inner = edged.where("NOT edge").agg(F.coalesce(F.sum(F.when(F.col("mapped"), gain(F.col("n")))), F.lit(0)).alias("w"), F.coalesce(F.sum("up"), F.lit(0)).alias("u"), F.coalesce(F.sum("down"), F.lit(0)).alias("d"), F.count("*").alias("rows"))
    # at most two stretches a block are left; blocks are few
    whole = Window.orderBy("at")
    ends = edged.where("edge").select("*", F.lag("user").over(whole).alias("pu"), F.lag("mapped").over(whole).alias("pm"), F.lag("last_ts").over(whole).alias("pt"), F.lag("block").over(whole).alias("pb"))
    touching = F.coalesce(F.col("pb") != F.col("block"), F.lit(False))
    joined = touching & (F.col("pu") == F.col("user")) & (F.col("pm") == F.col("mapped"))
    numbered = ends.withColumn("chain", F.sum((~F.coalesce(joined, F.lit(False))).cast("int")).over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    stepped = numbered.withColumn("eu", (touching & (F.col("pu") == F.col("user")) & (F.col("first_ts") > F.col("pt"))).cast("int")).withColumn("ed", (touching & (F.col("pu") == F.col("user")) & (F.col("first_ts") < F.col("pt"))).cast("int"))
    chains = stepped.groupBy("chain").agg(F.first("mapped").alias("mapped"), F.sum("n").alias("n"), F.sum(F.col("up") + F.coalesce("eu", F.lit(0))).alias("u"), F.sum(F.col("down") + F.coalesce("ed", F.lit(0))).alias("d"))
    outer = chains.agg(F.coalesce(F.sum(F.when(F.col("mapped"), gain(F.col("n")))), F.lit(0)).alias("w2"), F.coalesce(F.sum("u"), F.lit(0)).alias("u2"), F.coalesce(F.sum("d"), F.lit(0)).alias("d2"))
    # stretches of one user: changes within blocks, and block borders with another user on the other side
    borders = b.groupBy("block").agg(F.min_by("user", "source_row").alias("first"), F.max_by("user", "source_row").alias("last"))
    crossed = borders.withColumn("before", F.lag("last").over(Window.orderBy("block"))).agg(F.count(F.when(F.coalesce(F.col("before") != F.col("first"), F.lit(True)), 1)).alias("crossed"))
    changes = marked.agg(F.count(F.when(~F.col("same"), 1)).alias("changes"), F.count_distinct("user").alias("users"))
    together = changes.crossJoin(crossed).select((F.col("changes") + F.col("crossed") == F.col("users")).alias("users_together"))
    return inner.crossJoin(outer).crossJoin(together).select((F.col("w") + F.col("w2")).alias("contiguous_windows"), (F.col("u") + F.col("u2")).alias("increases"), (F.col("d") + F.col("d2")).alias("decreases"), "users_together")


def rolling(playlists: DataFrame, key: str, items: str, window: int = 20) -> DataFrame:
    """(key, start_index, items) for each ``window`` neighbouring items of a list, stride one; shorter lists
    have none."""
    n = F.size(items)
    starts = F.sequence(F.lit(0), n - window)
    long = playlists.where(n >= window)
    return long.select(key, items, F.explode(starts).alias("start_index")).select(key, "start_index", F.slice(items, F.col("start_index") + 1, window).alias("items"))


def first_window(playlists: DataFrame, key: str, items: str, references: int = 15, targets: int = 5) -> DataFrame:
    """(key, references, targets): the first items of every list that is long enough."""
    return playlists.where(F.size(items) >= references + targets).select(key, F.slice(items, 1, references).alias("references"), F.slice(items, references + 1, targets).alias("targets"))


def suffix_transitions(firsts: DataFrame, key: str, targets: int = 5) -> DataFrame:
    """(key, step, history, target): each target with all that comes before it."""
    stepped = firsts.select(key, "references", "targets", F.explode(F.sequence(F.lit(1), F.lit(targets))).alias("step"))
    return stepped.select(key, "step", F.concat("references", F.slice("targets", F.lit(1), F.col("step") - 1)).alias("history"), F.element_at("targets", F.col("step")).alias("target"))


def split_index(length: Column, ratio: Column | float) -> Column:
    """Where a list of ``length`` is split by ``ratio``: at least half of it, rounded up, and no end empty."""
    half = F.ceil(length / 2)
    at = F.greatest(F.floor(length * ratio), half)
    return F.greatest(F.lit(1), F.least(at, length - 1)).cast("int")
