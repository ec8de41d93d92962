"""Mixing sources to target weights, in tokens of a public tokenizer, by temperature.

A source's weight is its share of all tokens to the power of an exponent. One exponent for all sources is
bisected until the weights have the entropy of the target shares. It can't meet each of them, so each
source's own exponent is bisected on from there, until its weight is its target or as much as its documents
give when used as often as allowed, whichever comes first. (With ``mix_by_temperature`` one exponent is
all there is: bisected to an entropy, then raised as far as the repetition limits ask.)

Weights times the total are budgets, realised by block permutations: the order of a source's documents is
that of their hashes, a pass uses each once. Whole passes come first; the last one takes blocks of hashes
in order until one no longer fits, which is divided into blocks in turn, until the one at the edge is
small; of that one the documents that fit are used, largest first.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaverlake.llm.encoding import count_tokens
from quaverlake.session import stored

#: A source is divided into at most so many blocks at a time, and all of them into SUMS, which the driver holds.
BLOCKS = 4096
SUMS = 1 << 20
#: Documents of a block at the edge that is no longer divided.
BLOCK_ROWS = 2000
HASHES = 1 << 62


def weight(share: float, exponent: float) -> float:
    """A share of tokens to the power of its exponent; a source that has them all counts as just short of that."""
    return min(share, 1 - 2**-20) ** exponent if share > 0 else 0.0


def exponent_for_share(share: float, target: float, start: float, limit: float = 1.0, steps: int = 200) -> float:
    """The exponent whose weight is ``target``, or ``limit`` if that is less, bisected on from ``start``; the weight
    falls as the exponent grows."""
    wanted = min(target, limit)
    if not 0 < share <= 1 or not 0 < wanted <= 1:
        return start
    lo, hi = 0.0, max(start, 1.0)
    while weight(share, hi) > wanted:
        hi *= 2
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if weight(share, mid) > wanted else (lo, mid)
    return (lo + hi) / 2


def tempered(sizes: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares proportional to size ** exponent of the sources that have any tokens."""
    top = max(sizes.values(), default=0)
    raw = {s: (n / top) ** exponent for s, n in sizes.items() if n > 0}
    total = math.fsum(raw.values())
    return {s: raw.get(s, 0.0) / total if total else 0.0 for s in sizes}


def entropy(shares: dict[str, float]) -> float:
    return -math.fsum(p * math.log(p) for p in shares.values() if p > 0)


def exponent_for_entropy(sizes: dict[str, float], target: float, steps: int = 60) -> float:
    """The exponent in [0, 8] whose shares have the entropy ``target`` (it falls as the exponent
    grows); an entropy out of reach gives the nearer end."""
    lo, hi = 0.0, 8.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if entropy(tempered(sizes, mid)) > target else (lo, mid)
    return (lo + hi) / 2


def exponent_for_repeats(sizes: dict[str, float], repeats: dict[str, int], total: float, start: float = 0.0, steps: int = 60) -> float:
    """The smallest exponent in [start, 1] whose budgets of ``total`` tokens need no source more
    often than its limit; 1, natural shares, needs each once."""

    def fits(e: float) -> bool:
        return all(p * total <= sizes[s] * repeats[s] * (1 + 1e-12) for s, p in tempered(sizes, e).items())

    if start >= 1 or fits(start):
        return start
    lo, hi = start, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if fits(mid) else (mid, hi)
    return hi


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one source's last block the documents that fit into what is left, largest first."""
    rows = rows.sort_values(["n_tokens", "doc"], ascending=[False, True], kind="stable")
    left = int(rows["rest"].iloc[0])
    taken = []
    for n in rows["n_tokens"]:
        fits = 0 < n <= left
        left -= n if fits else 0
        taken.append(int(fits))
    rows["uses"] = rows["uses"] + taken
    return rows[["doc", "source", "n_tokens", "uses"]]


def tokens_by_source(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(doc, source, n_tokens) of every document, written once."""
    return stored(count_tokens(df.select(F.col(key).alias("doc"), F.col(source).alias("source"), F.col(text).alias("text")), "text", ["doc", "source"]))


def _edges(placed: DataFrame, rest: dict[str, int], rows: dict[str, int]) -> dict[str, tuple[int, int, int]]:
    """Per source (first, end, left): documents with a hash before ``first`` have their place in the last pass; of those
    from there to before ``end``, few, as many as fit into ``left`` tokens."""
    spark = placed.sparkSession
    edges = {s: (0, HASHES, n) for s, n in rest.items()}
    todo = {s: rows[s] for s, n in rest.items() if n > 0}
    while todo:
        width = {}
        for s, n in todo.items():
            first, end, _ = edges[s]
            blocks = max(2, min(BLOCKS, SUMS // len(todo), math.ceil(n / BLOCK_ROWS)))
            width[s] = max(1, math.ceil((end - first) / blocks))
        table = spark.createDataFrame([(s, edges[s][0], edges[s][1], width[s]) for s in todo], "source string, first long, end long, width long")
        inside = placed.join(F.broadcast(table), "source").where("h >= first AND h < end")
        sums = inside.groupBy("source", F.expr("(h - first) div width").alias("block")).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).collect()
        by_source: dict[str, list[tuple[int, int, int]]] = {}
        for r in sums:
            by_source.setdefault(r.source, []).append((r.block, r.tokens, r.n))
        for s in list(todo):
            first, end, left = edges[s]
            for block, tokens, n in sorted(by_source.get(s, [])):
                if tokens > left:
                    lo = first + block * width[s]
                    edges[s], todo[s] = (lo, min(end, lo + width[s]), left), n
                    break
                left -= tokens
            else:
                edges[s], todo[s] = (end, end, left), 0
            if todo[s] <= BLOCK_ROWS or edges[s][1] - edges[s][0] <= 1:
                del todo[s]
    return edges


def use_documents(tokens: DataFrame, budgets: dict[str, int], repeats: dict[str, int], seed: int = 42) -> DataFrame:
    """(doc, source, n_tokens, uses) of the documents that are used: per source at most its budget
    of tokens, short of it by less than the smallest document left out of the block at the edge, or
    because all its documents are used as often as allowed. Documents without tokens, of a null
    source or of one without a budget aren't used. Rows are documents, equal ones too (those of one key
    share a hash, so they are filled in together)."""
    spark = tokens.sparkSession
    known = tokens.where(F.col("source").isin(list(budgets)) & (F.col("n_tokens") > 0)) if budgets else tokens.limit(0)
    sizes = {r.source: (r.n, r.tokens) for r in known.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")).collect()}
    passes = {s: min(repeats[s], budgets[s] // size) for s, (_, size) in sizes.items()}
    rest = {s: 0 if passes[s] == repeats[s] else budgets[s] - passes[s] * size for s, (_, size) in sizes.items()}
    placed = known.withColumn("h", F.xxhash64("doc", F.lit(seed)).bitwiseAND(F.lit(HASHES - 1)))
    edges = _edges(placed, rest, {s: n for s, (n, _) in sizes.items()})
    plan = [(s, passes[s], *edges[s]) if rest[s] else (s, passes[s], 0, 0, 0) for s in sizes]
    table = spark.createDataFrame(plan, "source string, passes long, first long, end long, rest long")
    cutoff = placed.join(F.broadcast(table), "source")
    uses = (F.col("passes") + F.when(F.col("h") < F.col("first"), 1).otherwise(0)).alias("uses")
    plain = cutoff.where("h < first OR h >= end").select("doc", "source", "n_tokens", uses)
    kind = tokens.schema["doc"].dataType.simpleString()
    last = cutoff.where("h >= first AND h < end").select("doc", "source", "n_tokens", F.col("passes").alias("uses"), "rest")
    filled = last.groupBy("source").applyInPandas(_fill, f"doc {kind}, source string, n_tokens long, uses long")
    return plain.unionByName(filled).where("uses > 0")


def plan_mixture(sizes: dict[str, int], targets: list[tuple[str, float, int]], total: int) -> dict[str, dict]:
    """Per source the one exponent's share (``tempered``), its own ``exponent``, its ``weight`` and its ``budget``."""
    own = {s: float(sizes.get(s, 0)) for s, _, _ in targets}
    wanted = {s: share for s, share, _ in targets}
    common = exponent_for_entropy(own, entropy({s: p for s, p in wanted.items() if own[s] > 0}))
    tempered_shares = tempered(own, common)
    out = {}
    for s, target, repeats in targets:
        share = own[s] / total if total else 0.0
        exponent = exponent_for_share(share, target, common, limit=share * repeats)
        w = min(weight(share, exponent), share * repeats) if target > 0 else 0.0
        out[s] = {"tempered": tempered_shares[s], "exponent": exponent if share > 0 and target > 0 else None, "weight": w, "budget": int(round(w * total))}
    return out


def read_targets(targets: DataFrame, limit: int = 10_000) -> list[tuple[str, float, int]]:
    """(source, target_share, max_repeats) on the driver; a mixture has at most ``limit`` sources.
    Repeated rows count once; a null source, share or limit isn't a target."""
    rows = targets.select("source", "target_share", "max_repeats").dropna().distinct().limit(limit + 1).collect()
    if len(rows) > limit or len({r.source for r in rows}) < len(rows):
        raise ValueError("mixture targets need one row per source, and at most the documented number of sources")
    return sorted((r.source, float(r.target_share), int(r.max_repeats)) for r in rows)


def _mixture(documents: DataFrame, targets: DataFrame, key: str, text: str, source: str, seed: int) -> tuple:
    wanted = read_targets(targets)
    tokens = tokens_by_source(documents, key, text, source)
    known = tokens.where(F.col("source").isin([s for s, _, _ in wanted])) if wanted else tokens.limit(0)
    sizes = {r.source: r.n for r in known.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    plan = plan_mixture(sizes, wanted, total)
    chosen = use_documents(tokens, {s: p["budget"] for s, p in plan.items()}, {s: r for s, _, r in wanted}, seed)
    return tokens, total, wanted, plan, chosen


def mix_sources(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42) -> DataFrame:
    """(doc_id, source, n_tokens, uses): a choice of documents in which each source of ``targets``
    has its ``target_share`` of a total equal to the tokens of all documents (also of those with a
    null or unknown source), and no document is used more than ``max_repeats`` times. A source too
    small for its share is used up to its limit, one without documents not at all, and the others
    keep their own shares. Empty documents are never used. An empty table gives no rows."""
    return _mixture(documents, targets, key, text, source, seed)[-1].withColumnRenamed("doc", key)


def mix_report(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42) -> DataFrame:
    """(source, target_share, actual_share, available, used, total, documents, most_uses, deviation, tempered_share,
    exponent) of each source of ``targets`` for the choice of ``mix_sources``; shares are of the total,
    deviation is the actual share less the target, tempered_share what one exponent for all would give; a
    source without documents has no exponent."""
    tokens, total, wanted, plan, chosen = _mixture(documents, targets, key, text, source, seed)
    report = _report(tokens, chosen, {s: share for s, share, _ in wanted}, total)
    table = tokens.sparkSession.createDataFrame([(s, p["tempered"], p["exponent"]) for s, p in plan.items()], "source string, tempered_share double, exponent double")
    return report.join(table, "source").withColumn("deviation", F.col("actual_share") - F.col("target_share"))


def _report(tokens: DataFrame, chosen: DataFrame, shares: dict[str, float], total: int) -> DataFrame:
    spark = tokens.sparkSession
    table = spark.createDataFrame(sorted(shares.items()), "source string, target_share double")
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("used"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
    available = tokens.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    share = F.when(F.lit(total) > 0, F.coalesce(F.col("used"), F.lit(0)) / F.lit(max(total, 1))).otherwise(0.0)
    joined = table.join(available, "source", "left").join(used, "source", "left")
    return joined.select("source", "target_share", share.alias("actual_share"), zero("available"), zero("used"), F.lit(total).cast("long").alias("total"), zero("documents"), zero("most_uses"))


def mix_by_temperature(documents: DataFrame, targets: DataFrame, entropy_of_targets: bool = True, budget: float = 1.0, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42) -> DataFrame:
    """The report of a mixture by temperature over the sources of ``targets``: the exponent is
    bisected to the entropy of their target shares, then raised as far as their ``max_repeats``
    ask; with it off, the flattest mixture that the limits allow. The total is ``budget`` times the
    tokens of those sources; with all of them and a source that may be used once, only natural shares
    (exponent 1) fit. One more column: exponent."""
    tokens = tokens_by_source(documents, key, text, source)
    wanted = read_targets(targets)
    repeats = {s: r for s, _, r in wanted}
    per = {r.source: r.n for r in tokens.where(F.col("source").isin(list(repeats))).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    sizes = {s: float(per.get(s, 0)) for s in repeats}
    total = int(sum(sizes.values()) * budget)
    start = exponent_for_entropy(sizes, entropy({s: share for s, share, _ in wanted})) if entropy_of_targets else 0.0
    exponent = exponent_for_repeats(sizes, repeats, total, start)
    shares = tempered(sizes, exponent)
    chosen = use_documents(tokens, {s: int(round(p * total)) for s, p in shares.items()}, repeats, seed)
    return _report(tokens, chosen, shares, total).withColumn("exponent", F.lit(exponent))
