"""How often every distinct value occurs and in how many records, by burst-trie counting.

A worker counts the terms of its records in a burst trie: inner nodes branch on one byte, after the
bytes that all below have in common, and leaves are small tables of (rest of the term -> occurrences,
records) that burst into a node when they hold more than ``burst`` terms. It gives up its subtrees,
each a prefix and its table, whenever it holds ``held`` terms and at its end.

Subtrees are routed by adaptive prefixes. From the empty prefix on, one with more than ``load`` terms
under it, over all workers, is taken as far as all of these agree and then divided by the next byte,
again and again until no part is larger; neighbouring small parts share a route. So routes are long
where terms crowd, whatever the terms begin with, short elsewhere, and about 2 n / ``load`` in number.
Matching subtrees meet at one worker, which merges them in a trie again, one route at a time. A term's
occurrences are one counter on each worker by then, so a term that fills a third of all rows is no
heavier than another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.llm.common import one_row_per_key
from quaverlake.session import stored

_SUBTREES = pa.schema([("prefix", pa.binary()), ("rests", pa.list_(pa.binary())), ("occurrences", pa.list_(pa.int64())), ("records", pa.list_(pa.int64()))])
_SUBTREES_SQL = "prefix binary, rests array<binary>, occurrences array<long>, records array<long>"
_ROUTED = pa.schema([("route", pa.int32()), *_SUBTREES])
_ROUTED_SQL = f"route int, {_SUBTREES_SQL}"
_PARTS = pa.schema([("prefix", pa.binary()), ("step", pa.int32()), ("n", pa.int64()), ("least", pa.binary()), ("most", pa.binary())])
_TERMS = pa.schema([("term", pa.binary()), ("occurrences", pa.int64()), ("records", pa.int64())])
#: Where a term ends, instead of a next byte.
END = -1


def _agree(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


class BurstTrie:
    """Byte strings with two counters each. A node is {"leaf": table} or {"skip": common bytes, next byte: node, ...,
    "end": table of the term that ends here}."""

    def __init__(self, burst: int = 512):
        self.burst, self.size = burst, 0
        self.root: dict = {"leaf": {}}

    def add(self, term: bytes, occurrences: int, records: int) -> None:
        node, at = self.root, 0
        while "leaf" not in node:
            skip = node["skip"]
            if skip:
                same = _agree(skip, term[at : at + len(skip)])
                if same < len(skip):
                    self._fork(node, same)
                at += same
            if at == len(term):
                break
            node, at = node.setdefault(term[at], {"leaf": {}}), at + 1
        table = node["leaf"] if "leaf" in node else node.setdefault("end", {})
        rest = term[at:]
        had = table.get(rest)
        if had is None:
            table[rest] = [occurrences, records]
            self.size += 1
            if len(table) > self.burst:
                self._split(node)
        else:
            had[0] += occurrences
            had[1] += records

    def _fork(self, node: dict, same: int) -> None:
        """Part the skipped bytes of a node after the first ``same`` of them."""
        skip = node["skip"]
        below = dict(node, skip=skip[same + 1 :])
        node.clear()
        node.update({"skip": skip[:same], skip[same]: below})

    def _split(self, node: dict) -> None:
        table = node.pop("leaf")
        first, last = min(table), max(table)
        same = _agree(first, last)
        node["skip"] = first[:same]
        for rest, counters in table.items():
            if len(rest) > same:
                node.setdefault(rest[same], {"leaf": {}})["leaf"][rest[same + 1 :]] = counters
            else:
                node["end"] = {b"": counters}

    def subtrees(self) -> Iterator[tuple[bytes, dict[bytes, list[int]]]]:
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            if "leaf" in node:
                if node["leaf"]:
                    yield prefix, node["leaf"]
                continue
            prefix += node["skip"]
            for step, child in node.items():
                if step == "end":
                    yield prefix, child
                elif step != "skip":
                    stack.append((prefix + bytes([step]), child))


def _emit(trie: BurstTrie) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for prefix, table in trie.subtrees():
        rows.append((prefix, list(table), [c[0] for c in table.values()], [c[1] for c in table.values()]))
        if len(rows) == 256:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _SUBTREES, strict=True)], schema=_SUBTREES)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _SUBTREES, strict=True)], schema=_SUBTREES)


def _count(burst: int, held: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie(burst)
        for batch in source:
            lists = batch.column("terms")
            flat = lists.flatten().dictionary_encode()
            codes = flat.indices.to_numpy(zero_copy_only=False)
            if not len(codes):
                continue
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy(zero_copy_only=False)))
            words = len(flat.dictionary)
            occurrences = np.bincount(codes, minlength=words)
            records = np.bincount(np.unique(row * words + codes) % words, minlength=words)
            for term, o, r in zip(pc.cast(flat.dictionary, pa.binary()).to_pylist(), occurrences.tolist(), records.tolist(), strict=True):
                trie.add(term, o, r)
            if trie.size > held:
                yield from _emit(trie)
                trie = BurstTrie(burst)
        yield from _emit(trie)

    return run


class Routes:
    """Prefixes with what follows them: by the next byte (or END) a deeper prefix or the number of a route."""

    def __init__(self) -> None:
        self.steps: dict[bytes, dict[int, bytes | int]] = {}
        self.count = 1

    def of(self, term: bytes) -> int:
        at: bytes | int = b""
        if not self.steps:
            return 0
        while isinstance(at, bytes):
            at = self.steps[at][term[len(at)] if len(term) > len(at) else END]
        return at

    def of_subtree(self, prefix: bytes) -> int | None:
        """The route of all terms that begin with ``prefix``, if it is one."""
        at: bytes | int = b""
        if not self.steps:
            return 0
        while isinstance(at, bytes):
            if len(prefix) <= len(at):
                return None
            at = self.steps[at][prefix[len(at)]]
        return at


def _parts(open_prefixes: list[bytes]):
    """Terms under each of the prefixes by their next byte, with the least and the greatest beginning of them."""
    known = frozenset(open_prefixes)
    lengths = sorted({len(p) for p in known}, reverse=True)

    def above(term: bytes) -> bytes | None:
        return next((term[:n] for n in lengths if n <= len(term) and term[:n] in known), None)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[bytes, int], list] = {}

        def count(p: bytes, begin: bytes, n: int) -> None:
            step = begin[len(p)] if len(begin) > len(p) else END
            had = sums.setdefault((p, step), [0, begin, begin])
            had[0] += n
            had[1], had[2] = min(had[1], begin), max(had[2], begin)

        for batch in source:
            for prefix, rests in zip(batch.column("prefix").to_pylist(), batch.column("rests"), strict=True):
                p = above(prefix)
                if p is not None and len(prefix) > len(p):
                    count(p, prefix, len(rests))
                else:  # a worker with few terms here: its table reaches into several parts
                    for rest in rests.as_py():
                        p = above(prefix + rest)
                        if p is not None:
                            count(p, prefix + rest, 1)
        if sums:
            rows = [(p, step, *v) for (p, step), v in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _PARTS, strict=True)], schema=_PARTS)

    return run


def find_routes(subtrees: DataFrame, total: int, load: int) -> Routes:
    """Routes of at most ``load`` terms (or one term), as counted with repeats over the workers."""
    routes = Routes()
    if total <= load:
        return routes
    routes.count = 0
    todo = [b""]
    while todo:
        parts = subtrees.select("prefix", "rests").mapInArrow(_parts(todo), "prefix binary, step int, n long, least binary, most binary")
        found = parts.groupBy("prefix", "step").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("prefix", "step").collect()
        todo, filled, before = [], load, None
        for r in found:
            prefix, least, most = bytes(r.prefix), bytes(r.least), bytes(r.most)
            steps = routes.steps.setdefault(prefix, {})
            if prefix != before:
                filled, before = load, prefix
            deeper = least[: max(len(prefix) + 1, _agree(least, most))]
            if r.n > load and r.step != END and deeper not in routes.steps:
                steps[r.step] = deeper
                todo.append(deeper)
                continue
            if filled + r.n > load:
                routes.count, filled = routes.count + 1, 0
            filled += r.n
            steps[r.step] = routes.count - 1
    return routes


def _route(routes: Routes):
    """Cut every subtree into the parts that belong to each route."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = []
            for prefix, rests, o, r in zip(*[batch.column(f.name).to_pylist() for f in _SUBTREES], strict=True):
                whole = routes.of_subtree(prefix)
                if whole is not None:
                    rows.append((whole, prefix, rests, o, r))
                    continue
                parts: dict[int, tuple[list, list, list]] = {}
                for rest, x, y in zip(rests, o, r, strict=True):
                    part = parts.setdefault(routes.of(prefix + rest), ([], [], []))
                    part[0].append(rest)
                    part[1].append(x)
                    part[2].append(y)
                rows += [(route, prefix, *part) for route, part in parts.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _ROUTED, strict=True)], schema=_ROUTED)

    return run


def _merge(burst: int):
    """Rows sorted by route: one trie at a time."""

    def terms(trie: BurstTrie) -> Iterator[pa.RecordBatch]:
        out = [(prefix + rest, c[0], c[1]) for prefix, table in trie.subtrees() for rest, c in table.items()]
        for i in range(0, len(out), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out[i : i + 65536], strict=True), _TERMS, strict=True)], schema=_TERMS)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, trie = None, BurstTrie(burst)
        for batch in source:
            for route, prefix, rests, o, r in zip(*[batch.column(f.name).to_pylist() for f in _ROUTED], strict=True):
                if route != own:
                    yield from terms(trie)
                    own, trie = route, BurstTrie(burst)
                for rest, x, y in zip(rests, o, r, strict=True):
                    trie.add(prefix + rest, x, y)
        yield from terms(trie)

    return run


def term_frequencies(
    df: DataFrame,
    key: str,
    terms: Column | str,
    min_records: int = 5,
    max_share: float = 0.3,
    burst: int = 512,
    held: int = 500_000,
    load: int = 200_000,
) -> DataFrame:
    """(term STRING, occurrences, records, n_records, band) of every distinct non-null term in the
    list ``terms``, counted over distinct non-null ``key`` with a non-null list (these are
    ``n_records``; an empty list counts). A term twice in a list is two occurrences in one record.
    band: ``rare`` below ``min_records`` records, ``common`` above ``max_share`` of n_records,
    else ``useful``; ``rare`` goes before ``common`` where both hold.

    Terms are compared by their bytes as text; the empty string is a term. Repeated rows of a key
    count once (if their lists differ, the largest in array order). An empty table gives no rows.
    ``burst``, ``held`` and ``load`` only steer the work: a task merges ``load`` terms at a time. The driver
    holds the routes, about 2 n / ``load`` prefixes for n terms (each counted once per worker that has it)."""
    rows = df.select(F.col(key).alias("key"), (F.col(terms) if isinstance(terms, str) else terms).cast("array<string>").alias("terms")).where(F.col("terms").isNotNull())
    once = one_row_per_key(rows, "key", "terms")
    lists = stored(once.select(F.filter("terms", lambda x: x.isNotNull()).alias("terms")))
    total = lists.count()
    subtrees = stored(lists.mapInArrow(_count(burst, held), _SUBTREES_SQL))
    routes = find_routes(subtrees, subtrees.agg(F.coalesce(F.sum(F.size("rests")), F.lit(0))).first()[0], load)
    routed = subtrees.mapInArrow(_route(routes), _ROUTED_SQL)
    merged = routed.repartition("route").sortWithinPartitions("route").mapInArrow(_merge(burst), "term binary, occurrences long, records long")
    band = F.when(F.col("records") < min_records, "rare").when(F.col("records") > F.lit(total) * F.lit(max_share), "common").otherwise("useful")
    return merged.select(F.col("term").cast("string").alias("term"), "occurrences", "records", F.lit(total).cast("long").alias("n_records"), band.alias("band"))
