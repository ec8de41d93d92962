"""Encoding of a corpus with a public byte-level BPE by forced-boundary splitting.

Two neighbouring bytes that stand side by side inside no token of the vocabulary can't be
joined by any merge, for each result of a merge is a token. A text may be cut between them, the
fragments encoded on their own and the ids concatenated. The tokenizer first splits a text by
a pattern, so a cut must also leave that split as it is: it is made only between whole
characters, not after white space (the pattern looks ahead from there) and not before an
apostrophe (which may begin a contraction).

All cuts of a batch are found at once by a table over byte pairs; fragments repeat so often
that most are looked up instead of encoded.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fragments remembered by a worker before it starts anew.
REMEMBERED = 300_000
#: Bytes of text handled at once.
WINDOW = 1 << 22


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[bytes, str]:
    """The file of ranks and the split pattern of a public byte-level tokenizer."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def read_ranks(file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file.splitlines() if line.strip())}


class _Fragments(dict):
    """Fragment -> place of its ids in the store."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode, self.store, self.first, self.count = encode, array("i"), array("q"), array("q")

    def __missing__(self, fragment: bytes) -> int:
        ids = self.encode(fragment.decode("utf-8", "replace"))
        self[fragment] = place = len(self.first)
        self.first.append(len(self.store))
        self.count.append(len(ids))
        self.store.extend(ids)
        return place


class ForcedBoundaryEncoder:
    def __init__(self, file: bytes, pattern: str):
        import tiktoken

        ranks = read_ranks(file)
        self.whole = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        inside = np.zeros(1 << 16, bool)
        for token in ranks:
            b = np.frombuffer(token, np.uint8).astype(np.int64)
            inside[(b[:-1] << 8) | b[1:]] = True
        self.forced = ~inside
        right = np.arange(1 << 16) & 255
        left = np.arange(1 << 16) >> 8
        self.forced &= ((right & 0xC0) != 0x80) & (right != 0x27) & (left > 32)
        self.known = _Fragments(self.whole.encode_ordinary)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Positions before which ``data`` (bytes of valid UTF-8) may be cut; three bytes of context are enough."""
        out = []
        for at in range(0, len(data), WINDOW):
            lo = max(0, at - 4)
            b = data[lo : at + WINDOW]
            ok = np.zeros(len(b), bool)
            ok[1:] = self.forced[(b[:-1].astype(np.uint16) << 8) | b[1:]]
            places = np.flatnonzero(ok)
            last = b[places - 1]
            high = places[last >= 0x80]
            if len(high):  # white space of two or three bytes
                z, y, x = b[high - 1], b[np.maximum(high - 2, 0)], b[np.maximum(high - 3, 0)]
                blank = (y == 0xC2) & ((z == 0x85) | (z == 0xA0))
                blank |= (x == 0xE1) & (y == 0x9A) & (z == 0x80)
                blank |= (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
                blank |= (x == 0xE2) & (y == 0x81) & (z == 0x9F)
                blank |= (x == 0xE3) & (y == 0x80) & (z == 0x80)
                ok[high[blank]] = False
                places = np.flatnonzero(ok)
            places = places + lo
            out.append(places[places >= at])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each; null counts as empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        all_ids, counts = [], np.zeros(len(texts), np.int64)
        row = 0
        while row < len(texts):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + WINDOW, side="right")) - 1)
            lo, hi = int(offsets[row]), int(offsets[end])
            if hi > lo:
                part = raw.slice(lo, hi - lo).to_pybytes()
                begins = offsets[row : end + 1] - lo
                starts = np.union1d(self.cuts(np.frombuffer(part, np.uint8)), begins[:-1][begins[:-1] < hi - lo])
                if len(self.known) > REMEMBERED:
                    self.known = _Fragments(self.whole.encode_ordinary)
                bounds = [*starts.tolist(), hi - lo]
                place = np.fromiter(map(self.known.__getitem__, map(part.__getitem__, map(slice, bounds, bounds[1:]))), np.int64, len(starts))
                first, count = np.array(self.known.first), np.array(self.known.count)
                n = count[place]
                total = np.concatenate([[0], np.cumsum(n)])
                all_ids.append(np.array(self.known.store, dtype=np.int32)[np.repeat(first[place] - total[:-1], n) + np.arange(total[-1])])
                counts[row:end] = np.diff(total[np.searchsorted(starts, begins)])
            row = end
        return (np.concatenate(all_ids) if all_ids else np.zeros(0, np.int32)), counts


@lru_cache(2)
def _encoder(file: bytes, pattern: str) -> ForcedBoundaryEncoder:
    return ForcedBoundaryEncoder(file, pattern)


def encode_corpus(df: DataFrame, key: str, text: str, tokenizer: tuple[bytes, str] | None = None) -> DataFrame:
    """(``key``, ids ARRAY<INT>): the token ids of the whole ``text`` of every row, without special
    tokens; strings that look like special tokens are plain text. A null and an empty text both
    give an empty list. Rows are neither merged nor dropped, a null key stays null; other columns
    aren't read. An empty table gives no rows. ``tokenizer`` is a vocabulary file's content (the
    driver reads it; about a megabyte) and its pattern. No shuffle."""
    file, pattern = tokenizer or vocabulary()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(file, pattern)
        for batch in source:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, counts = encoder.encode(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, text: str, keep: list[str], tokenizer: tuple[bytes, str] | None = None) -> DataFrame:
    """``keep`` and n_tokens, the number of ids that ``encode_corpus`` gives; the ids stay with the worker."""
    file, pattern = tokenizer or vocabulary()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(file, pattern)
        for batch in source:
            _, counts = encoder.encode(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{schema}, n_tokens long")
