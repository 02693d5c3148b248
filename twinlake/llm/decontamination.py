"""Benchmark decontamination with an FM-index for each shard of the documents.

A benchmark item's windows are its runs of 13 consecutive words, or all its words if there are fewer.  Each task cuts its
documents into shards of bounded size and maps words to the benchmark's vocabulary.  Windows only consist of that vocabulary,
so the shard's index holds every run of such words that is as long as the shortest window; no other place can hold an
occurrence.  All windows are searched backward through the index at once, their occurrences located by sampled suffix
positions, and overlapping ones merged to spans.

The benchmark is written in blocks of bounded size to the shared folder and read by the tasks block by block, so its size is
bounded neither on the driver nor on an executor.

Cases: null or empty text has no words and no hit; an item without words has no window; null item_id counts as the item "";
several items of one id count once; repeated documents are judged alike; an empty benchmark hits nothing; other columns of the
documents pass through ``clean`` untouched and are not read by ``find``.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .suffix import FMIndex

SPANS = "doc_id long, n_words long, spans array<struct<first:long,last:long>>, item_ids array<string>"

#: a-z, digits and all bytes of non-ASCII characters are parts of words; A-Z as a-z; the rest separates.
WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

_blocks: dict[str, _Block] = {}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class _Block:
    """Benchmark items: vocabulary, distinct windows by length, and the items of each window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.ids = sorted({i for i, _ in items})
        number = {x: i for i, x in enumerate(self.ids)}
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            symbols = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            length = min(window, len(symbols))
            for i in range(len(symbols) - length + 1 if length else 0):
                found.setdefault(length, {}).setdefault(tuple(symbols[i : i + length]), set()).add(number[item])
        self.windows = []
        for length, group in sorted(found.items()):
            of = [np.array(sorted(x)) for x in group.values()]
            self.windows.append((length, np.array(list(group), np.int64), np.concatenate(of), np.cumsum([0, *map(len, of)])))
        self.shortest = min(found, default=0)

    def occurrences(self, documents: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """(document, first word, end word) of each occurrence of a window, and distinct (document, item) pairs."""
        none = np.zeros(0, np.int64)
        text, firsts, owners, starts, size = [], [], [], [], 0
        for d, symbols in enumerate(documents):
            known = np.concatenate([[False], symbols > 0, [False]])
            edge = np.flatnonzero(known[1:] != known[:-1])
            for a, b in zip(edge[::2], edge[1::2], strict=True):
                if b - a >= self.shortest:
                    text += [symbols[a:b], [0]]
                    firsts.append(size)
                    owners.append(d)
                    starts.append(a)
                    size += b - a + 1
        if not text:
            return none, none, none, none, none
        firsts, owners, starts = (np.array(x, np.int64) for x in (firsts, owners, starts))
        index = FMIndex(np.concatenate(text).astype(np.int64), firsts, len(self.vocabulary))
        out: list[list] = [[], [], [], [], []]
        for length, phrases, items, bounds in self.windows:
            lo, hi = index.search(phrases)
            hit = np.flatnonzero(hi > lo)
            n = (hi - lo)[hit]
            rows = np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            of = np.repeat(hit, n)
            place = index.locate(rows)
            run = np.searchsorted(firsts, place, "right") - 1
            first = starts[run] + place - firsts[run]
            for to, x in zip(out, (owners[run], first, first + length), strict=False):
                to.append(x)
            pair = np.unique(np.stack([owners[run], of], 1), axis=0)
            m = bounds[pair[:, 1] + 1] - bounds[pair[:, 1]]
            out[3].append(np.repeat(pair[:, 0], m))
            out[4].append(items[np.repeat(bounds[pair[:, 1]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)])
        return tuple(np.concatenate(x) for x in out)


def merged(owner: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching spans within each owner, in order."""
    if not len(owner):
        return owner, first, end
    order = np.lexsort((first, owner))
    owner, first, end = owner[order], first[order], end[order]
    room = int(end.max()) + 2
    reach = np.maximum.accumulate(owner * room + end)
    head = np.append(True, owner[1:] * room + first[1:] > reach[:-1])
    at = np.flatnonzero(head)
    return owner[at], first[at], reach[np.append(at[1:], len(owner)) - 1] - owner[at] * room


def write_blocks(benchmark: DataFrame, window: int, block_bytes: int = 16 << 20) -> list[str]:
    """Distinct benchmark items as ready-made blocks, each built and written by a task from texts of bounded size; the driver sees only
    their paths.  A file has a name of its own, so what a lost attempt wrote is never read."""
    spark = benchmark.sparkSession
    common.small_batches(spark)
    folder = common.new_folder(spark, "benchmark")
    fs, at = common.file_system(folder)
    fs.create_dir(at, recursive=True)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    number = size // block_bytes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = common.file_system(folder)
        for batch in common.gathered(batches, size=block_bytes):
            data, offsets = common.text_bytes(batch.column(1))
            for a, b in common.slices(offsets, block_bytes):
                texts = (data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b))
                block, name = _Block(list(zip(batch.column(0).slice(a, b - a).to_pylist(), texts, strict=True)), window), uuid.uuid4().hex
                if block.windows:
                    with fs.open_output_stream(f"{at}/{name}") as sink:
                        sink.write(pickle.dumps(block))
                    yield pa.record_batch([pa.array([f"{folder}/{name}"])], names=["path"])

    bucket = F.pmod(F.xxhash64("item", "text"), F.lit(number))
    return sorted(r.path for r in items.repartition(number, bucket).mapInArrow(run, "path string").collect())


def _block(path: str) -> _Block:
    if path not in _blocks:
        _blocks.clear()  # one at a time
        fs, at = common.file_system(path)
        with fs.open_input_stream(at) as source:
            _blocks[path] = pickle.loads(source.read())
    return _blocks[path]


def _shards(batch: pa.RecordBatch, column: int, paths: list[str], shard_bytes: int) -> Iterator[tuple]:
    """Rows a to b of each shard, and for its documents words, merged spans and sorted item ids.

    A block is read once for all shards of the batch.  Words live as numbers; a text's own go at once."""
    data, offsets = common.text_bytes(batch.column(column))
    cuts = list(common.slices(offsets, shard_bytes))
    n = np.zeros(len(batch), np.int64)
    spans, items = [[] for _ in cuts], [set() for _ in range(len(batch))]
    for path in paths or [None]:
        block = _block(path) if path else None
        for shard, (a, b) in enumerate(cuts):
            symbols = []
            for i in range(a, b):
                words = words_of(data[offsets[i] : offsets[i + 1]].tobytes())
                n[i] = len(words)
                if block:
                    symbols.append(np.fromiter(map(block.vocabulary.get, words, repeat(0)), np.int32, len(words)))
            if block:
                owner, first, end, who, which = block.occurrences(symbols)
                spans[shard].append((owner, first, end))
                for d, i in zip(who.tolist(), which.tolist(), strict=True):
                    items[a + d].add(block.ids[i])
    for (a, b), found in zip(cuts, spans, strict=True):
        whole = merged(*(np.concatenate([x[i] for x in found]) for i in range(3))) if found else (np.zeros(0, np.int64),) * 3
        yield a, b, n[a:b], whole, [sorted(x) for x in items[a:b]]


def _held(paths: list[str], shard_bytes: int) -> int:
    """Bytes of text that a task holds: one shard, or four where more than one block is read again for every batch."""
    return shard_bytes * (4 if len(paths) > 1 else 1)


def find(docs: DataFrame, benchmark: DataFrame, window: int = 13, shard_bytes: int = 8 << 20) -> DataFrame:
    """A row for each document: its words, the merged spans of words that lie in a window, and the items with occurring windows."""
    paths = write_blocks(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("first", pa.int64()), ("last", pa.int64())])
        for batch in common.gathered(batches, size=_held(paths, shard_bytes)):
            for a, b, n, (owner, first, end), items in _shards(batch, 1, paths, shard_bytes):
                offsets = pa.array(np.searchsorted(owner, np.arange(b - a + 1)), pa.int32())
                spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(first), pa.array(end - 1)], fields=list(span)))
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(n), spans, pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "spans", "item_ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SPANS)


def n_hit(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def report(docs: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20) -> DataFrame:
    """``find`` with its digests; contaminated: some word is hit, and one in ``one_in`` at least."""
    found = find(docs, benchmark, window).withColumn("n_hit", n_hit())
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20, shard_bytes: int = 8 << 20) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    paths, column = write_blocks(benchmark, window), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.gathered(batches, size=_held(paths, shard_bytes)):
            for a, b, n, (owner, first, end), _ in _shards(batch, column, paths, shard_bytes):
                hit = np.bincount(owner, end - first, b - a).astype(np.int64)
                yield batch.slice(a, b - a).filter(pa.array(~((hit > 0) & (one_in * hit >= n))))

    return docs.mapInArrow(run, docs.schema)
