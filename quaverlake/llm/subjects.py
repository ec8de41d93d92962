"""Subject areas of documents by seeded, anchored non-negative factorisation.

The document-term matrix is factored with a row for each sentence of a document, weighted by how much a
term tells over all documents. Its factors are W (how much of a row each component explains) and H (the
terms of a component), found by alternating multiplicative updates of the Kullback-Leibler divergence.
They are seeded: a zero stays zero under such updates, so in a labelled document only the components of
its own subjects, which are anchored to a subject each, and the background components may explain a row.
The anchored components therefore come out as the subjects themselves, and need no naming afterwards;
a document's mixture is the mean over its rows.

Updates run where the rows are: executors hold H, update W and sum up what H needs. First they alternate
on a bounded sample of labelled documents, then over all documents, in which the labelled ones stay
anchored and the others count for little, as there are so many more of them. A document has the
subjects that explain at least ``share`` of its sentences.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaverlake.llm.common import ragged
from quaverlake.session import parallelism, spread, stored

#: Labelled documents that the first alternations run on, chosen by hash.
LABELLED = 6_000
#: Subjects that a call may name.
SUBJECTS = 1_000
#: Terms are hashed to so many columns.
COLUMNS = 1 << 15
#: Components that belong to no subject.
BACKGROUND = 12
#: What a sentence of a document with subjects counts for the background, in the fit.
OUTSIDE = 0.07
#: What a sentence without a label counts for H, in passes over all documents.
UNLABELLED = 0.02
#: Weight spread over all columns of a component.
SMOOTH = 20.0
EPS = 1e-9

_BREAK = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+|[\r\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_TAG = re.compile(r"<[/!?a-zA-Z][^<>]*>|&[a-z]{2,6};|https?://\S+")
_MARKS = re.compile("[̀-ͯ]+")


class Terms:
    """Words to numbers of 32 bits, and texts to columns."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 500_000:
                self.known.clear()
            got = self.known[word] = zlib.crc32(word.encode("utf-8", "replace"))
        return got

    def columns(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Columns of the words and neighbouring words of every sentence that has any word, one sentence after the
        other; how many each has; and how many sentences each text has."""
        numbers: list[int] = []
        words: list[int] = []
        counts: list[int] = []
        word = self.word
        for text in texts:
            before = len(words)
            if text:
                for sentence in _BREAK.split(_TAG.sub(" ", text)):
                    if not sentence.isascii():
                        sentence = _MARKS.sub("", unicodedata.normalize("NFKD", sentence))
                    found = _WORD.findall(sentence.casefold())
                    if found:
                        numbers += map(word, found)
                        words.append(len(found))
            counts.append(len(words) - before)
        one = np.array(numbers, np.int64)
        size = np.array(words, np.int64)
        row = np.repeat(np.arange(len(size)), size)
        same = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
        two = ((one[:-1] * 0x9E3779B1) ^ one[1:])[same] if len(one) else one
        two = ((two ^ (two >> 15)) * 0x85EBCA6B) >> 7
        rows = np.concatenate([row, row[1:][same]]) if len(row) else row
        columns = np.concatenate([one, two]) % COLUMNS
        order = np.argsort(rows, kind="stable")
        return columns[order].astype(np.int32), (2 * size - 1).astype(np.int32), np.array(counts, np.int32)


class Rows:
    """Sparse rows: columns and weights of each sentence that has any weight, one after the other. Rows of about the
    same length are ``blocks``: their numbers, and columns and weights as arrays filled up with weight 0."""

    def __init__(self, columns: np.ndarray, sizes: np.ndarray, term_weight: np.ndarray):
        value = term_weight[columns]
        keep = value > 0
        size = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[keep], minlength=len(sizes))
        self.n = len(sizes)
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        column, value, start = columns[keep], value[keep], np.cumsum(size) - size
        wide = np.where(size > 32, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), -(-size // 4) * 4)
        order = np.argsort(wide, kind="stable")
        edges = [*np.flatnonzero(np.diff(wide[order], prepend=-1)).tolist(), len(order)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            width = int(wide[order[lo]])
            step = max(1, (1 << 16) // max(1, width))
            for at in range(lo, hi if width else lo, step):
                rows = order[at : min(at + step, hi)]
                place = np.arange(width)
                inside = place < size[rows, None]
                take = np.minimum(start[rows, None] + place, len(column) - 1)
                self.blocks.append((rows, column[take], np.where(inside, value[take], 0).astype(np.float32)))


def _unit_rows(w: np.ndarray) -> np.ndarray:
    return w / np.maximum(w.sum(1, keepdims=True), EPS)


def explain(x: Rows, h: np.ndarray, allowed: np.ndarray | None = None, steps: int = 12, still: float = 0.01) -> np.ndarray:
    """W for fixed H (columns, components): multiplicative updates from even values, of each row until none of its
    values moves by more than ``still``, at most ``steps``. A row without weight is all zero."""
    out = np.zeros((x.n, h.shape[1]), np.float32)
    for rows, column, value in x.blocks:
        terms = h[column]
        w = _unit_rows(np.ones((len(rows), h.shape[1]), np.float32) if allowed is None else allowed[rows].astype(np.float32))
        for step in range(steps):
            part = np.matmul(terms, w[:, :, None])[:, :, 0]
            new = _unit_rows(w * np.matmul((value / np.maximum(part, EPS))[:, None, :], terms)[:, 0])
            moving = np.abs(new - w).max(1) > still
            w = new
            if step % 3 == 2 and moving.mean() < 0.6:
                out[rows] = w
                rows, w, terms, value = rows[moving], w[moving], terms[moving], value[moving]
                if not len(rows):
                    break
        out[rows] = w
    return out


def gathered(x: Rows, w: np.ndarray, h: np.ndarray, scale: np.ndarray, least: float = 1e-3) -> np.ndarray:
    """What the update of H sums up (columns, components); ``scale``: how much each row counts for each component.
    Components that explain less than ``least`` of a row count for nothing in it."""
    k = h.shape[1]
    total = np.zeros(h.size)
    cells, amounts, held = [], [], 0
    for rows, column, value in x.blocks:
        own = w[rows]
        terms = h[column]
        ratio = value / np.maximum(np.matmul(terms, own[:, :, None])[:, :, 0], EPS)
        r, c = np.nonzero(own > least)
        cells.append((column[r].astype(np.int64) * k + c[:, None]).ravel())
        amounts.append((h[column[r], c[:, None]] * ratio[r] * (own * scale[rows])[r, c][:, None]).ravel())
        held += cells[-1].size
        if held > 1 << 21:
            total += np.bincount(np.concatenate(cells), np.concatenate(amounts), h.size)
            cells, amounts, held = [], [], 0
    if cells:
        total += np.bincount(np.concatenate(cells), np.concatenate(amounts), h.size)
    return total.reshape(h.shape)


def smoothed(counts: np.ndarray) -> np.ndarray:
    """H (columns, components) of the sums, a component's weights adding up to 1."""
    h = counts + SMOOTH / COLUMNS
    return (h / h.sum(0)).astype(np.float32)


def _documents(batch: pa.RecordBatch, at: int, rows: int, term_weight: np.ndarray) -> tuple[Rows, np.ndarray]:
    """Some documents of a batch as rows, and how many rows each has."""
    part = batch.slice(at, rows)
    columns, _ = ragged(part.column("columns"))
    sizes, counts = ragged(part.column("sizes"))
    return Rows(columns, sizes, term_weight), counts


def _tokens(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Terms()
    for whole in source:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            columns, sizes, counts = terms.columns(batch.column(1).to_pylist())
            ends = np.concatenate([[0], np.cumsum(counts)])
            places = np.concatenate([[0], np.cumsum(sizes)])
            lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(places[ends], columns), lists(ends, sizes)], names=["doc", "columns", "sizes"])


def _frequencies(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COLUMNS, np.int64)
    for batch in source:
        columns, lengths = ragged(batch.column("columns"))
        row = np.repeat(np.arange(len(lengths)), lengths)
        for lo in range(0, len(lengths), 256):
            # a table of documents by columns is quicker than sorting
            a, b = np.searchsorted(row, [lo, lo + 256])
            held = np.zeros((min(256, len(lengths) - lo), COLUMNS), bool)
            held[row[a:b] - lo, columns[a:b]] = True
            counts += held.sum(0)
    some = np.flatnonzero(counts)
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some])], names=["c", "n"])


def term_weights(tokens: DataFrame, documents: int) -> np.ndarray:
    """Of each column: 0 in fewer than two documents, else the logarithm of documents / frequency, at
    most 4, so that neither common words nor names decide. Counted over all documents; the driver
    holds COLUMNS numbers."""
    counted = tokens.mapInArrow(_frequencies, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    weight = np.zeros(COLUMNS, np.float32)
    for r in counted:
        weight[r.c] = min(4.0, np.log((documents + 1) / r.n)) if r.n > 1 else 0.0
    return weight


def _columns_of(sums: np.ndarray) -> pa.RecordBatch:
    """A (columns, components) array as a row per component."""
    return pa.RecordBatch.from_arrays([pa.array(range(sums.shape[1]), pa.int32()), pa.array([c.astype(np.float32).tobytes() for c in sums.T], pa.binary())], names=["k", "sums"])


def _added(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of equal components added up."""
    total: dict[int, np.ndarray] = {}
    for batch in source:
        for k, sums in zip(batch.column("k").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            x = np.frombuffer(sums, np.float32).astype(np.float64)
            total[k] = total[k] + x if k in total else x
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in total.values()], pa.binary())], names=["k", "sums"])


def _summed(parts: DataFrame, components: int) -> np.ndarray:
    """Added up on executors, in two steps; the driver gets a row per component."""
    schema = "k int, sums binary"
    few = parts.repartition(parallelism(parts.sparkSession), "k").mapInArrow(_added, schema)
    out = np.zeros((COLUMNS, components))
    for r in few.collect():
        out[:, r.k] += np.frombuffer(r.sums, np.float32)
    return out


def _allowed(batch: pa.RecordBatch, at: int, rows: int, counts: np.ndarray, subjects: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Which components may explain each row, and whether its document is labelled."""
    own = batch.column("own").slice(at, rows).to_pylist()
    allowed = np.ones((len(own), components), bool)
    labelled = np.array([s is not None for s in own])
    allowed[labelled, :subjects] = False
    for i, numbers in enumerate(own):
        if numbers:
            allowed[i, numbers] = True
    return np.repeat(allowed, counts, axis=0), np.repeat(labelled, counts)


def _seed(term_weight: np.ndarray, subjects: int):
    """Weights of all labelled rows by column: of each subject's documents, and of all."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((COLUMNS, subjects + 1))
        for batch in source:
            x, counts = _documents(batch, 0, batch.num_rows, term_weight)
            allowed, _ = _allowed(batch, 0, batch.num_rows, counts, subjects, subjects)
            for rows, column, value in x.blocks:
                for s in range(subjects):
                    mine = allowed[rows, s]
                    total[:, s] += np.bincount(column[mine].ravel(), value[mine].ravel(), COLUMNS)
                total[:, subjects] += np.bincount(column.ravel(), value.ravel(), COLUMNS)
        yield _columns_of(total)

    return run


def _update(h: np.ndarray, term_weight: np.ndarray, subjects: int, steps: int):
    """One alternation: W of all rows with H fixed, and what H is updated from."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(h.shape)
        for batch in source:
            for at in range(0, batch.num_rows, 2048):
                x, counts = _documents(batch, at, 2048, term_weight)
                if not x.n:
                    continue
                allowed, labelled = _allowed(batch, at, 2048, counts, subjects, h.shape[1])
                scale = np.where(labelled, 1.0, UNLABELLED).astype(np.float32)[:, None].repeat(h.shape[1], 1)
                # what a document with subjects says beside them isn't the background's to learn, lest it take what they are about
                scale[np.ix_(labelled & allowed[:, :subjects].any(1), np.arange(subjects, h.shape[1]))] = OUTSIDE
                total += gathered(x, explain(x, h, allowed, steps), h, scale)
        yield _columns_of(total)

    return run


def _assign(h: np.ndarray, term_weight: np.ndarray, names: list[str], share: float, sure: float):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at in range(0, batch.num_rows, 2048):
                x, counts = _documents(batch, at, 2048, term_weight)
                some = np.flatnonzero(counts)
                if not len(some):
                    continue
                about = (explain(x, h)[:, : len(names)] >= sure).astype(np.float64)
                found = np.add.reduceat(about, (np.cumsum(counts) - counts)[some], axis=0) / counts[some, None]
                d, s = np.nonzero(found >= share - EPS)
                ids = batch.column("doc").slice(at, 2048).take(pa.array(some[d]))
                yield pa.RecordBatch.from_arrays([ids, pa.array([names[i] for i in s], pa.string()), pa.array(found[d, s])], names=["doc", "subject", "share"])

    return run


def subject_areas(
    documents: DataFrame,
    labels: DataFrame,
    areas: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    share: float = 0.16,
    sure: float = 0.4,
    rounds: int = 8,
    refinements: int = 1,
    labelled: int = LABELLED,
) -> DataFrame:
    """(doc, subject, share): the subjects of every document, and the share of its sentences
    that each explains; doc has the type of ``key``. Null, empty and blank texts, and texts of which no
    part is about a subject, have no row; neither has a null key. Rows are documents, equal ones too; repeated
    labels count once, labels that are no subject of ``areas`` (``none``) say that a document has no other. Without
    labels only the descriptions seed the components. An empty table gives no rows.

    ``rounds`` alternations run over ``labelled`` documents, chosen by hash, then ``refinements`` over all. The
    driver holds at most SUBJECTS subjects (more raise an error) and COLUMNS x components numbers."""
    rows = areas.select("subject", "description").where(F.col("subject").isNotNull()).distinct().limit(SUBJECTS + 1).collect()
    if len(rows) > SUBJECTS:
        raise ValueError(f"more than {SUBJECTS} subjects")
    described = sorted((r.subject, r.description or "") for r in rows)
    names = list(dict.fromkeys(s for s, _ in described))
    k, subjects = len(names) + BACKGROUND, len(names)
    base = documents.select(F.col(key).alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull())
    kind = documents.schema[key].dataType.simpleString()
    tokens = stored(spread(base).mapInArrow(_tokens, f"doc {kind}, columns array<int>, sizes array<int>"))
    weight = term_weights(tokens, tokens.count())

    number = F.array_position(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.col("subject")).cast("int") - 1
    marked = labels.select(F.col(key).cast(kind).alias("doc"), "subject").dropna().groupBy("doc").agg(F.array_sort(F.collect_set(number)).alias("own"))
    marked = marked.select("doc", F.filter("own", lambda x: x >= 0).alias("own"))
    sample = stored(tokens.join(marked, "doc").orderBy(F.xxhash64("doc"), "doc").limit(labelled).repartition(parallelism(tokens.sparkSession)))

    seen = _summed(sample.mapInArrow(_seed(weight, subjects), "k int, sums binary"), subjects + 1)
    everything = seen[:, subjects] + EPS
    rng = np.random.default_rng(11)
    h = rng.random((COLUMNS, k)) * 0.5 + 0.75
    h[:, subjects:] *= everything[:, None]
    for s, name in enumerate(names):
        # seeded with what its documents hold more of than all documents do
        own = seen[:, s] + EPS
        h[:, s] *= own * (own / own.sum()) / (everything / everything.sum())
        seeds = np.unique(Terms().columns([f"{name}. {d}" for n, d in described if n == name])[0])
        if len(seeds):
            h[seeds, s] += h[:, s].sum() / 50
    h = (h / h.sum(0)).astype(np.float32)
    for _ in range(rounds):
        h = smoothed(_summed(sample.mapInArrow(_update(h, weight, subjects, 4), "k int, sums binary"), k))
    for _ in range(refinements):
        every = tokens.join(marked, "doc", "left")
        h = smoothed(_summed(every.mapInArrow(_update(h, weight, subjects, 4), "k int, sums binary"), k))
    return tokens.mapInArrow(_assign(h, weight, names, share, sure), f"doc {kind}, subject string, share double")
