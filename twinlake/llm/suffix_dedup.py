"""Removal of repeated byte strings with suffix arrays.

A byte goes if some string of ``length`` bytes that covers it also starts earlier: in a smaller document, or earlier in the same
one.  Three steps find all such strings without sorting all suffixes:

1. Every position's string has a key, the least hash of the 32-byte grams in it.  Equal strings have equal keys, and neighbouring
   positions mostly share theirs, so a document falls into runs of positions that share the first gram of that hash: (key, digest
   of all bytes the run's strings cover).
   Runs meet by key; a key that stands alone holds no repeat, and a run of equal digest repeats the first one whole.
2. Runs of one key but different bytes (the edges of repeats) are cut from their texts and gathered by key into shards.  Each shard
   gets a suffix array (Larsson-Sadakane) and common prefixes (Kasai's, by predecessor in text order); suffixes that agree in
   ``length`` bytes form classes whose earliest member stays.  A key of many bytes is dealt to several tasks by document; their
   shards' distinct strings, sorted, then meet in buckets by hash, where each shard's are looked up in those of the others before it by
   binary search.  So no task holds more than a shard, or a bucket of one, whatever the key.
3. The repeats' byte ranges go back to their documents.

Texts move once, the runs once, and only edges are sorted.  A task drops repeats it knows before they move, so a hot passage sends
a row for each slice of input and not for each copy.

Cases: null text is empty; null doc_id comes first; rows of one doc_id are told apart by a hash of the text, and of rows equal in
both the first stays; texts shorter than ``length`` stay whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .suffix import larsson_sadakane, neighbours

_GRAM = 32
_SLICE = 1 << 19
_PIECE = 4 << 20
_FIRST = -(1 << 63)
_BROADCAST_KEYS = 100_000
#: place: start * length + positions, in one number as fewer columns make fewer bytes in a shuffle; a run has less than length positions
_RUNS = "repeat boolean, key long, digest long, doc long, version long, place long"
_MET = "repeat boolean, key long, doc long, version long, place long"
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each position."""
    table = common.mix(np.arange(1, 257, dtype=np.uint64))
    h, step = table[data], 1
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        h = h[:-step] * np.uint64(m) + h[step:]
        step *= 2
    return common.mix(h)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each so many neighbours."""
    done = 1
    while 2 * done <= width:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    return np.minimum(h[: len(h) - (width - done)], h[width - done :]) if width > done else h


def runs(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs over texts laid end to end: text number, first position within the buffer, positions, key, digest."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    starts = np.append(0, ends[:-1])
    stop = ends - length + 1  # of the positions where a string starts
    has = stop > starts
    if not has.any():
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    h = _hashes(data)
    key = _least(h, length - _GRAM + 1)
    new = np.append(True, (key[1:] != key[:-1]) | (h[: len(key) - 1] == key[:-1]))  # or the gram of that hash stands first and leaves
    new[starts[has]] = True
    step = np.zeros(len(key) + 1, np.int8)
    step[starts[has]] += 1
    step[stop[has]] -= 1
    first = np.flatnonzero(new & (np.cumsum(step[:-1], dtype=np.int8) > 0))
    text = np.searchsorted(ends, first, "right")
    n = np.minimum(np.append(first[1:], len(key)), stop[text]) - first
    power = np.cumprod(np.full(len(h), _P, np.uint64))
    total = np.append(np.uint64(0), np.cumsum(h * power))
    back = np.cumprod(np.full(len(h) + 1, _P_INVERSE, np.uint64))
    digest = (total[first + n + length - _GRAM] - total[first]) * back[first]
    return text, first, n, key[first], common.mix(digest + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _sources(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """doc (doc_id, or the least number for null), version (tells rows of one doc_id apart, 0 if none have the same), text; and the
    columns that tell rows apart.  A version of 0 is a constant, which Spark takes out of a join's keys but not out of a repartition's,
    so texts dealt by it would move again for each join."""
    ids = docs.select("doc_id").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST))).alias("d")).first()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sources = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("doc"), (F.xxhash64(text) if ids.n != ids.d else F.lit(0).cast("long")).alias("version"), text.alias("text"))
    return sources, ["doc", "version"] if ids.n != ids.d else ["doc"]


def _find_runs(sources: DataFrame, length: int) -> DataFrame:
    def rows(doc, version, start, n, key, digest) -> pa.RecordBatch:
        """repeat: a run of the same bytes stands earlier in this slice; such rows move by a key of their own."""
        place = start * length + n
        order = np.lexsort((place, version, doc, digest, key))
        doc, version, place, key, digest = (x[order] for x in (doc, version, place, key, digest))
        same = np.append(False, (key[1:] == key[:-1]) & (digest[1:] == digest[:-1]))
        twin = same & np.append(False, (doc[1:] == doc[:-1]) & (version[1:] == version[:-1]) & (place[1:] == place[:-1]))
        key = np.where(same, common.mix(key ^ common.mix(doc.view(np.uint64) + place.view(np.uint64))), key)
        keep = ~twin
        return pa.record_batch([pa.array(same[keep]), *(pa.array(x[keep].view(np.int64)) for x in (key, digest, doc, version, place))], names=["repeat", "key", "digest", "doc", "version", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, version = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = common.text_bytes(batch.column(2))
            for a, b in common.slices(offsets, _SLICE):
                if offsets[b] - offsets[a] <= _PIECE:
                    text, first, n, key, digest = runs(data[offsets[a] : offsets[b]], offsets[a + 1 : b + 1] - offsets[a], length)
                    begins = offsets[a:b] - offsets[a]
                    if len(first):
                        yield rows(doc[a + text], version[a + text], first - begins[text], n, key, digest)
                else:  # one very long text
                    for p in range(offsets[a], offsets[b], _PIECE - length + 1):
                        piece = data[p : min(p + _PIECE, offsets[b])]
                        _, first, n, key, digest = runs(piece, np.array([len(piece)]), length)
                        if len(first):
                            yield rows(np.full(len(first), doc[a]), np.full(len(first), version[a]), first + (p - offsets[a]), n, key, digest)

    return sources.select("doc", "version", "text").mapInArrow(run, _RUNS)


def _meet(found: DataFrame, partitions: int) -> DataFrame:
    """Rows with repeat: every string of the run starts earlier elsewhere; the others: runs whose key has other bytes too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = pending = None  # the row before; the first row of an open key whose runs so far are all alike
        for batch in common.gathered(batches, rows=20_000):
            if not len(batch):
                continue
            repeat, key, digest, doc, version, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            was = [repeat[:1], *(np.zeros(1, np.int64),) * 5] if last is None else last
            now = [repeat, key, digest, doc, version, place]
            before = [np.concatenate([w, x[:-1]]) for w, x in zip(was, now, strict=True)]
            same_key = (key == before[1]) & ~repeat & ~before[0]
            if last is None:
                same_key[0] = False
            same = same_key & (digest == before[2])
            twin = same & (doc == before[3]) & (version == before[4]) & (place == before[5])
            other = same_key & ~same  # another digest under the key of the row before
            group = np.cumsum(~same_key)
            varied = np.bincount(group, other, group[-1] + 1) > 0
            check = ~repeat & ~same & varied[group]
            check[0] |= bool(other[0])
            if same_key[0] and pending is None:  # its key was varied before this batch
                check |= other & (group == 0)
            out = (repeat | same) & ~twin | check
            if pending is not None:
                if varied[0] and same_key[0]:
                    yield pending
                if varied[0] or group[-1] > 0 or not same_key[0]:
                    pending = None
            if not varied[group[-1]] and not (group[-1] == 0 and same_key[0]):
                head = int(np.flatnonzero(group == group[-1])[0])
                if not repeat[head]:
                    pending = pa.record_batch([pa.array([False]), *(batch.column(i).slice(head, 1) for i in (1, 3, 4, 5))], names=["repeat", "key", "doc", "version", "place"])
            last = [x[-1:] for x in now]
            batch = batch.drop_columns("digest")
            if out.any():
                kept = batch.filter(pa.array(out))
                yield pa.record_batch([pa.array((repeat | same)[out]), *kept.columns[1:]], names=batch.schema.names)

    return found.repartition(partitions, "key").sortWithinPartitions("repeat", "key", "digest", "doc", "version", "place").mapInArrow(run, _MET)


def _shard(segments: list[bytes], n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of suffixes that agree in so many bytes, over segments in the documents' order.

    Returns the joined bytes, each segment's start in them, the class (by sorted order) of every position where a string starts, and
    those positions; -1 elsewhere."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    begins = np.cumsum(sizes + 1) - sizes - 1
    data = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    symbols = data.astype(np.int64) + len(segments)
    symbols[begins + sizes] = np.arange(len(segments))  # separators differ
    sa, rank = larsson_sadakane(symbols)
    common_ = neighbours(symbols, sa, rank)
    head = common_ < length
    order = np.cumsum(head) - 1
    class_ = np.empty(len(sa), np.int64)
    class_[sa] = order
    at = np.repeat(begins, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return data, begins, class_, at


def repeats(segments: list[bytes], n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The strings of one shard's segments, in their order: segment, place in it, whether the string starts earlier in the shard; then
    the distinct strings in sorted order and which string of the list is the first of each."""
    data, begins, class_, at = _shard(segments, n, length)
    _, first = np.unique(class_[at], return_index=True)
    again = np.ones(len(at), bool)
    again[first] = False
    segment = np.repeat(np.arange(len(segments)), n)
    strings = np.lib.stride_tricks.sliding_window_view(data, length)[at[first]] if len(data) >= length else np.zeros((0, length), np.uint8)
    return segment, at - begins[segment], again, np.ascontiguousarray(strings).view(f"S{length}").ravel(), first


def merge(shards: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Places (rows of the shards' second arrays) whose string starts earlier in another shard; a shard has its sorted distinct strings
    and a row (doc, version, start) for each.  Every shard is looked up in the strings of those before it by binary search."""
    before, at, late = shards[0][0][:0], shards[0][1][:0], []
    for strings, places in shards:
        if not len(before):
            before, at = strings, places
            continue
        place = np.minimum(np.searchsorted(before, strings), len(before) - 1)
        known = before[place] == strings
        old, new = at[place[known]], places[known]
        sooner = np.lexsort(np.stack([np.concatenate([old, new])[:, c] for c in (2, 1, 0)]))
        rank = np.empty(len(sooner), np.int64)
        rank[sooner] = np.arange(len(sooner))
        first = rank[len(old) :] < rank[: len(old)]
        late.append(np.where(first[:, None], old, new))
        at = at.copy()
        at[place[known]] = np.where(first[:, None], new, old)
        into = np.searchsorted(before, strings[~known])
        before, at = np.insert(before, into, strings[~known]), np.insert(at, into, places[~known], axis=0)
    return np.concatenate([np.zeros((0, 3), np.int64), *late])


_FOUND = "doc long, version long, first long, end long, key long, bucket long, shard long, strings binary, places binary"


def _resolve(segments: DataFrame, length: int, shard_bytes: int, partitions: int) -> DataFrame:
    """Byte ranges that repeat within a shard (doc, version, first, end), from (key, salt, doc, version, start, n, shards, bytes); and
    for keys of several shards each shard's distinct strings by bucket, with the place where each is first, for ``_merged``.

    A task holds a shard's bytes at a time, whatever the key: only keys of one shard are sure to be held whole."""
    schema = pa.schema([*((c, pa.int64()) for c in ("doc", "version", "first", "end", "key", "bucket", "shard")), ("strings", pa.binary()), ("places", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, task, nth = 0, TaskContext.get().partitionId() << 32, 0

        def out() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda x: x[2:5])  # strings of several keys never meet, so all can be in the documents' order
            number = np.array([x[:7] for x in held], np.int64)
            segment, where, again, strings, first = repeats([x[7] for x in held], number[:, 5], length)
            s, w = segment[again], where[again]
            head = np.append(True, (s[1:] != s[:-1]) | (np.diff(w) > length)) if len(s) else np.zeros(0, bool)
            last = np.append(head[1:], True) if len(s) else head
            begin = number[s, 4]
            ranges = [number[s[head], 2], number[s[head], 3], (w + begin)[head], (w + begin)[last] + length]
            none = pa.nulls(int(head.sum()), pa.int64())
            yield pa.record_batch([*map(pa.array, ranges), none, none, none, *(pa.nulls(len(none), pa.binary()),) * 2], schema=schema)
            shared = number[segment[first], 6] > 1
            of, text = segment[first[shared]], strings[shared]
            if not len(of):
                return
            bucket = np.array([zlib.crc32(x) for x in text.tolist()], np.int64) % (16 * number[of, 6])
            places = np.stack([number[of, 2], number[of, 3], where[first[shared]] + number[of, 4]], 1)
            order = np.lexsort((bucket, number[of, 0]))  # strings stay sorted within a bucket
            cut = np.flatnonzero(np.append(True, np.diff(number[of[order], 0]) != 0) | np.append(True, np.diff(bucket[order]) != 0))
            for i, j in zip(cut, np.append(cut[1:], len(order)), strict=True):
                x = order[i:j]
                yield pa.RecordBatch.from_pylist([{"key": int(number[of[x[0]], 0]), "bucket": int(bucket[x[0]]), "shard": task + nth, "strings": text[x].tobytes(), "places": places[x].tobytes()}], schema=schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:5] == held[-1][:5]:
                    continue  # a row alike in doc_id and text
                if size >= shard_bytes and (row[:2] != held[-1][:2] or row[6] > 1):
                    yield from out()
                    held, size, nth = [], 0, nth + 1
                held.append(row)
                size += len(row[7])
        if held:
            yield from out()

    return segments.repartition(partitions, "key", "salt").sortWithinPartitions("key", "salt", "doc", "version", "start").mapInArrow(run, _FOUND)


def _merged(found: DataFrame, length: int, partitions: int) -> DataFrame:
    """Ranges of the strings that start earlier in another shard of their key.  Strings are dealt to buckets by a hash, so a bucket has
    a fraction of a shard's strings from each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shards = None, []

        def out() -> pa.RecordBatch:
            late = merge(shards) if shards else np.zeros((0, 3), np.int64)
            return pa.record_batch([pa.array(late[:, 0]), pa.array(late[:, 1]), pa.array(late[:, 2]), pa.array(late[:, 2] + length)], names=["doc", "version", "first", "end"])

        for batch in batches:
            for *now, strings, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now[:2]:
                    yield out()
                    key, shards = now[:2], []
                shards.append((np.frombuffer(strings, f"S{length}"), np.frombuffer(places, np.int64).reshape(-1, 3)))
        yield out()

    rows = found.where("strings IS NOT NULL").select("key", "bucket", "shard", "strings", "places")
    return rows.repartition(partitions, "key", "bucket").sortWithinPartitions("key", "bucket", "shard").mapInArrow(run, "doc long, version long, first long, end long")


def find(docs: DataFrame, length: int = 100, shard_bytes: int = 2 << 20, key_bytes: int = 2 << 20) -> DataFrame:
    """doc, version, text, and ranges: the byte ranges that repeat, in any order and perhaps overlapping; a row for each document.

    shard_bytes: what a suffix array is built over; key_bytes: what one key may bring to a task, beyond which it is dealt to several."""
    if length < _GRAM:
        raise ValueError(f"strings of {_GRAM} bytes at least")
    common.small_batches(docs.sparkSession)
    sources, by = _sources(docs)
    partitions = common.partitions_for(docs)
    met = common.checkpoint(_meet(_find_runs(sources, length), partitions))
    met = met.select("repeat", "key", "doc", "version", F.expr(f"place div {length}").alias("start"), (F.col("place") % length).alias("n"))
    texts = sources.repartition(partitions, *by)
    edges = met.where("NOT repeat").select("doc", "version", "key", "start", "n")
    hot = edges.groupBy("key").agg(F.sum(F.col("n") + (length - 1)).alias("bytes")).where(F.col("bytes") > key_bytes)
    hot = common.checkpoint(hot.select("key", F.ceil(F.col("bytes") / key_bytes).cast("long").alias("shards")))
    shared = hot.count()
    edges = edges.join(F.broadcast(hot) if shared <= _BROADCAST_KEYS else hot, "key", "left").withColumn("shards", F.coalesce("shards", F.lit(1).cast("long")))
    salt = F.pmod(F.xxhash64("doc", "version", F.col("start").bitwiseAND(F.lit(-4096).cast("long"))), F.col("shards"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, version, cuts = (batch.column(i) for i in (0, 1, 3))
            data, offsets = common.text_bytes(batch.column(2))
            of = np.repeat(np.arange(len(batch)), np.diff(cuts.offsets.to_numpy()))
            key, start, n, salt, shards = (x.to_numpy() for x in cuts.flatten().flatten())
            a = offsets[of] + start
            for i in range(0, len(of), 5000):
                part = slice(i, i + 5000)
                yield pa.record_batch([pa.array(key[part]), pa.array(salt[part]), doc.take(pa.array(of[part])), version.take(pa.array(of[part])), pa.array(start[part]), pa.array(n[part]), pa.array(shards[part]), pa.array([data[x:y].tobytes() for x, y in zip(a[part], (a + n + length - 1)[part], strict=True)], pa.binary())], names=["key", "salt", "doc", "version", "start", "n", "shards", "bytes"])

    def resolved(some: DataFrame) -> DataFrame:
        wanted = some.withColumn("salt", salt).groupBy(*by).agg(F.collect_list(F.struct("key", "start", "n", "salt", "shards")).alias("cuts"))
        segments = texts.select("doc", "version", "text").join(wanted, by).mapInArrow(cut, "key long, salt long, doc long, version long, start long, n long, shards long, bytes binary")
        return _resolve(segments, length, shard_bytes, partitions)

    ends = resolved(edges.where("shards = 1")).select("doc", "version", "first", "end")
    if shared:
        parts = resolved(edges.where("shards > 1"))  # computed for either use from one exchange, as its strings are too many to keep
        ends = ends.unionByName(parts.where("strings IS NULL").select("doc", "version", "first", "end")).unionByName(_merged(parts, length, partitions))
    ranges = met.where("repeat").select("doc", "version", F.col("start").alias("first"), (F.col("start") + F.col("n") + (length - 1)).alias("end")).unionByName(ends)
    gathered = ranges.groupBy(*by).agg(F.collect_list(F.struct("first", "end")).alias("ranges"))
    return texts.join(gathered, by, "left")


def remove(docs: DataFrame, length: int = 100, shard_bytes: int = 2 << 20, key_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (what is left) and its SHA-256."""
    from pyspark.sql import Window

    found = find(docs, length, shard_bytes, key_bytes)
    # rows alike in doc_id and text: the later ones repeat the first
    found = found.withColumn("copy", F.when(F.col("version") == 0, F.lit(1)).otherwise(F.row_number().over(Window.partitionBy("doc", "version").orderBy(F.lit(0)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.text_bytes(batch.column(1))
            ranges, copies = batch.column(2), batch.column(3).to_pylist()
            bounds, (first, end) = ranges.offsets.to_numpy(), (x.to_numpy() for x in ranges.flatten().flatten())
            bounds = bounds - bounds[0]
            for a, b in common.slices(offsets, 4 << 20):
                out = []
                for i in range(a, b):
                    text = data[offsets[i] : offsets[i + 1]]
                    p, q = first[bounds[i] : bounds[i + 1]], end[bounds[i] : bounds[i + 1]]
                    if copies[i] > 1 and len(text) >= length:
                        p, q = np.array([0]), np.array([len(text)])
                    if len(p):
                        step = np.zeros(len(text) + 1, np.int32)
                        np.add.at(step, p, 1)
                        np.add.at(step, q, -1)
                        gone = np.cumsum(step)[:-1] > 0
                        kept = text[~gone].tobytes()
                        out.append((len(text), len(text) - len(kept), int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]), hashlib.sha256(kept).hexdigest(), kept))
                    else:
                        out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), text.tobytes()))
                columns = list(zip(*out, strict=True))
                yield pa.record_batch([batch.column(0).slice(a, b - a), *(pa.array(x, pa.int64()) for x in columns[:3]), pa.array(columns[3]), pa.array(columns[4], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    ranges = F.coalesce("ranges", F.array().cast("array<struct<first:long,end:long>>"))
    return found.select(F.nullif("doc", F.lit(_FIRST)).alias("doc_id"), "text", ranges.alias("ranges"), "copy").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
