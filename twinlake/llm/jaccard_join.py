"""Set similarity join on word shingles by universe partition and pigeonhole.

Two sets r and s of Jaccard similarity t or more differ in at most H = (1 - t) / (1 + t) * (|r| + |s|) elements.  Sizes fall into
bands; within a band all sets cut the universe of hashes into the same segments, more than H of them, so similar sets agree in some
segment.  A set indexes segments under its own band and probes those of the bands that hold sizes down to t times its own.
Allocation by cost: segments that are empty or whose signature is frequent are passed over, in favour of later ones; a set that runs
out of cheap segments adds one-deletion neighbourhoods of some (sets also meet there if the segments differ in one element), and
only if these don't reach the sum that the pigeonhole needs, the costly ones.  What is frequent is estimated from a bounded sample
of documents; it steers cost only, as every allocation keeps that sum.

Sets equal to each other are one node.  Sets give a tenth more segments than the pigeonhole needs, so similar ones share as many
signatures more, and pairs that share fewer are dropped.  Signatures meet by a shuffle.  A small bucket gives its pairs, a large one
those with its hub.  Each node is verified against its likeliest partner first; pairs within a component are settled by then, the
others are verified in a second round.  Large buckets that still hold several components are compared in blocks, all sets of two
blocks at once, from one file a block.  Verification is exact on the hashed shingles of whole texts, so links are lost nowhere, and pairs within a group of
copies aren't written out.

Cases: text without words (or null) has an empty set and its own doc_id as component; null doc_id rows take part, and a component
of such rows only has a null component_id; rows of one doc_id are each represented; repeated rows share a node; other columns are
not read by ``link`` and pass through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from . import common
from .components import components
from .shingles import identity, sets

_SLICE = 1 << 19
_SMALL = 16  # members of a bucket that gives all its pairs
_FREQUENT = 3  # documents of the sample that share a frequent signature
_BLOCK = 256  # nodes
_NO_NEED = 0x7FFF
_MOST_FREQUENT = 200_000
_BROADCAST_ROWS = 200_000  # of some 100 bytes at most
_STRIP = 16  # blocks
_K1, _K2 = np.uint64(0x94D049BB133111EB), np.uint64(0xBF58476D1CE4E5B9)
INDEX, PROBE = 1, 2

_hot: dict[str, np.ndarray] = {}


class Bands:
    """Size bands and numbers of segments for a threshold of ``num`` / ``den``."""

    def __init__(self, num: int = 4, den: int = 5) -> None:
        self.num, self.den, self.first = num, den, [1]

    def difference(self, sizes: int) -> int:
        """Elements in which two sets of that total size may differ."""
        return (self.den - self.num) * sizes // (self.den + self.num)

    def reach(self, up_to: int) -> None:
        while self.first[-1] <= up_to:
            self.first.append(self.first[-1] * self.den**2 // self.num**2 + 1)

    def of(self, size: int) -> int:
        self.reach(size)
        return int(np.searchsorted(self.first, size, "right")) - 1

    def last(self, band: int) -> int:
        return self.first[band + 1] - 1

    def index_segments(self, size: int) -> int:
        return self.difference(size + size * self.den // self.num) + 1

    def segments(self, band: int) -> int:
        """A quarter more than any set of the band needs, as some will be empty or frequent."""
        return (self.index_segments(self.last(band)) + self.extra(self.last(band))) * 5 // 4 + 2

    def extra(self, size: int) -> int:
        """Segments that a set gives beyond the least number, so that similar sets agree in as many more."""
        return self.difference(2 * size) // 10

    def deletions(self, band: int) -> int:
        return max(1, self.segments(band) // 16)

    def probes(self, size: int) -> Iterator[tuple[int, int]]:
        """(band, segments) to probe for partners of at most this size."""
        own, least = self.of(size), -(-size * self.num // self.den)
        for band in range(own, -1, -1):
            if self.last(band) < least:
                break
            yield band, self.difference(size + min(size, self.last(band))) + 1


def signatures(x: np.ndarray, bands: Bands, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, roles, need) rows of one set; hot: sorted frequent signatures.

    need: a similar set has so many of them at least (above the lowest 16 bits; a set short of cheap segments leaves it to its partner),
    and the least that any partner's size can make of it (below).

    Equal segments have equal signatures, so what is costly to one set is so to the other.  For a pair, take the set whose wanted
    number of cheap segments ends first: more than H of them stand there (by ``extra`` more), so one (and as many more) is equal, and
    the other set gives it too.  A set
    short of cheap segments gives all of them and the deletions of a fixed few, which count twice; if that isn't enough either, it
    gives everything, and then the argument holds by its partner's segments or by their whole number."""
    n = len(x)
    own, mixed, out, roles, need = bands.of(n), common.mix(x ^ _K2), [], [], []
    extra = bands.extra(n)
    with np.errstate(over="ignore"):
        for band, wanted in bands.probes(n):
            m = bands.segments(band)
            segment = ((mixed >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            total = np.zeros(m, np.uint64)
            np.add.at(total, segment, mixed)
            salt = common.mix(np.arange(m, dtype=np.uint64) * _K1 + np.uint64(band + 1))
            exact = common.mix(total + salt)
            cheap = np.bincount(segment, minlength=m) > 0
            if len(hot):
                cheap &= hot[np.minimum(np.searchsorted(hot, exact), len(hot) - 1)] != exact
            nth = np.cumsum(cheap)
            most = bands.index_segments(n) if band == own else wanted
            short = nth[-1] < most + extra
            role = np.where(cheap & (nth <= wanted + extra), PROBE, 0) + np.where(cheap & (nth <= most + extra) & (band == own), INDEX, 0)
            if nth[-1] < most:
                few = np.arange(m) < bands.deletions(band)
                enough = nth[-1] + (cheap & few).sum() >= most
                role = np.where(cheap | few | (not enough), PROBE + INDEX, 0)
                deleted = np.flatnonzero(few[segment])
                out.append(common.mix(total[segment[deleted]] - mixed[deleted] + salt[segment[deleted]]))
                roles.append(np.full(len(deleted), PROBE + INDEX))
            used = np.flatnonzero(role)
            out.append(exact[used])
            roles.append(role[used])
            need.append(np.full(sum(map(len, out)) - sum(map(len, need)), _NO_NEED << 16 | 1 if short else min(1 + extra, _NO_NEED - 1) << 16 | min(1 + bands.extra(-(-n * bands.num // bands.den)), _NO_NEED - 1)))
    return np.concatenate(out), np.concatenate(roles), np.concatenate(need)


def _frequent(path: str) -> np.ndarray:
    if path not in _hot:
        _hot.clear()
        if path:
            fs, at = common.file_system(path)
            with fs.open_input_stream(at) as source:
                _hot[path] = np.frombuffer(source.read(), np.uint64)
        else:
            _hot[path] = np.zeros(0, np.uint64)
    return _hot[path]


def _slices(batch: pa.RecordBatch, column: int, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    data, offsets = common.text_bytes(batch.column(column))
    for a, b in common.slices(offsets, _SLICE):
        yield a, sets(data[offsets[a] : offsets[b]], offsets[a + 1 : b + 1] - offsets[a], width)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def measure(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, node (the name of its set; null if empty), n_shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, found in _slices(batch, 1, width):
                yield pa.record_batch([batch.column(0).slice(a, len(found)), pa.array([identity(x) if len(x) else None for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64())], names=["doc_id", "node", "n_shingles"])

    return _texts(docs).mapInArrow(run, "doc_id long, node long, n_shingles long")


def _signature_rows(docs: DataFrame, width: int, bands: Bands, hot: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, seen = _frequent(hot), set()
        for batch in batches:
            for _, found in _slices(batch, 1, width):
                keys, roles, needs, nodes, counts = [], [], [], [], []
                for x in found:
                    if not len(x) or (node := identity(x)) in seen:
                        continue  # a copy within this task
                    if len(seen) < 200_000:
                        seen.add(node)
                    key, role, need = signatures(x, bands, frequent)
                    keys.append(key)
                    roles.append(role)
                    needs.append(need)
                    nodes.append(node)
                    counts.append(len(key))
                if nodes:
                    role = np.concatenate(roles)
                    yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array((role & PROBE == 0).astype(np.int8)), pa.array(np.repeat(np.array(nodes, np.int64), counts)), pa.array(np.concatenate(needs).astype(np.int32))], names=["signature", "mute", "node", "need"])

    return _texts(docs).mapInArrow(run, "signature long, mute byte, node long, need int")


def _find_frequent(docs: DataFrame, width: int, bands: Bands, total: int, sample: int = 40_000) -> str:
    """Signatures that many documents of a bounded sample share, in a file of the shared folder."""
    part = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < 1_000_003 * min(1, sample / max(1, total)))
    rows = _signature_rows(part, width, bands, "").select("signature", "node").distinct().groupBy("signature").agg(F.count("*").alias("n")).where(F.col("n") >= _FREQUENT)
    found = rows.orderBy(F.desc("n"), "signature").limit(_MOST_FREQUENT).select("signature").toArrow()["signature"].to_numpy().view(np.uint64)
    folder = common.new_folder(docs.sparkSession, "frequent")
    fs, at = common.file_system(folder)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/signatures") as sink:
        sink.write(np.sort(found).tobytes())
    return f"{folder}/signatures"


def _buckets(rows: DataFrame) -> DataFrame:
    """For a small bucket the pairs (a, b) of nodes that share its signature and of which one probes it; need: signatures that the two
    must share.  For a large one its signature, each node (a) and that node's need as ``signatures`` gives it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [None, [], False]  # the open bucket: signature, its first rows, whether large

        def out(signature: np.ndarray, node: np.ndarray, mute: np.ndarray, need: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            """All buckets of these rows; the last one stays open unless it is the end."""
            lead = held[1] if held[0] is not None else []
            was = bool(lead) and held[2]
            if lead:
                signature = np.concatenate([np.full(len(lead), held[0]), signature])
                node, mute, need = (np.concatenate([np.array(x, own.dtype), own]) for x, own in zip(zip(*lead, strict=True), (node, mute, need), strict=True))
            if not len(signature):
                return
            head = np.append(True, signature[1:] != signature[:-1])
            first = np.flatnonzero(head)
            size = np.diff(np.append(first, len(head)))
            group = np.cumsum(head) - 1
            large = size > _SMALL
            large[0] |= was
            open_, done = len(first) - 1, np.ones(len(first), bool)
            if not last and not large[open_]:
                done[open_] = False  # too early to say
            a, b = [], []
            rank = np.arange(len(node)) - first[group]
            for gap in range(1, _SMALL):
                i = np.flatnonzero(rank[gap:] >= gap) if len(rank) > gap else np.zeros(0, np.int64)
                i = i[done[group[i + gap]] & ~large[group[i + gap]] & (mute[i] == 0)]
                a.append(i)
                b.append(i + gap)
            member = np.flatnonzero(large[group] & (mute[first[group]] == 0))
            if was:
                member = member[member >= len(lead)]  # those are given already
            if last:
                held[0] = None
            else:
                keep = slice(first[open_], first[open_] + (1 if large[open_] else size[open_]))
                held[:] = [signature[keep.start], list(zip(node[keep].tolist(), mute[keep].tolist(), need[keep].tolist(), strict=True)), bool(large[open_])]
            a, b = np.concatenate(a), np.concatenate(b)
            least = np.minimum(need[a], need[b]) >> 16
            least[least == _NO_NEED] = 1
            a, b = node[a], node[b]
            two = a != b
            lo, hi = np.minimum(a, b)[two], np.maximum(a, b)[two]
            if len(lo) or len(member):
                columns = [pa.array(np.concatenate([lo, node[member]])), pa.array([*hi, *[None] * len(member)], pa.int64()) if len(member) else pa.array(hi), pa.array([*[None] * len(lo), *signature[member]], pa.int64()), pa.array(np.concatenate([least[two], need[member]]))]
                yield pa.record_batch(columns, names=["a", "b", "signature", "need"])

        for batch in common.gathered(batches, rows=20_000):
            yield from out(batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy(), False)
        yield from out(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int32), True)

    dealt = rows.repartition(common.shuffle_partitions(rows.sparkSession), "signature").sortWithinPartitions("signature", "mute", "node")
    return dealt.mapInArrow(run, "a long, b long, signature long, need int")


def _stars(members: DataFrame) -> DataFrame:
    """signature, node, need, hub, hub_need: the hub is the node of the bucket that is in the most large buckets, as the original of
    many near copies is."""
    degree = members.groupBy("node").agg(F.count_distinct("signature").alias("degree"))
    each = members.join(degree, "node")
    hub = each.groupBy("signature").agg(F.max(F.struct("degree", "node", "need")).alias("h")).select("signature", F.col("h.node").alias("hub"), F.col("h.need").alias("hub_need"))
    return each.join(hub, "signature").select("signature", "node", "need", "degree", "hub", "hub_need")


def verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The (a, b) pairs whose sets are similar; nodes: (node, doc_id of a document that has it).

    Every pair is settled where its first node's text meets the other's; a node with many partners is spread over several groups,
    each with a copy of its text."""
    partners = pairs.groupBy("a").agg(F.count("*").alias("n"))
    members = common.checkpoint(pairs.join(partners, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.floor(F.col("n") / 1000) + 1).alias("salt")))
    orders = members.select(F.col("b").alias("node"), "a", "salt", F.lit(1).alias("second")).unionByName(members.select(F.col("a").alias("node"), "a", "salt", F.lit(0).alias("second")).distinct())
    orders = common.checkpoint(orders.join(nodes, "node").groupBy("doc_id", "node").agg(F.collect_list(F.struct("a", "salt", "second")).alias("orders")))
    if orders.count() <= _BROADCAST_ROWS and members.count() <= _BROADCAST_ROWS:
        orders = F.broadcast(orders)
    texts = _texts(docs).where("doc_id IS NOT NULL").join(orders, "doc_id").select("node", "text", F.explode("orders").alias("o")).select("o.a", "o.salt", "o.second", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, salt, second, node = (batch.column(i).to_numpy() for i in range(4))
            links = [[], []]
            for at, found in _slices(batch, 4, width):
                for i, x in enumerate(found, at):
                    if identity(x) != node[i]:
                        continue  # another text of the same doc_id
                    if not second[i]:
                        first, mine = (a[i], salt[i]), x
                    elif first == (a[i], salt[i]):
                        place = np.minimum(np.searchsorted(mine, x), len(mine) - 1)
                        shared = int((mine[place] == x).sum())
                        if den * shared >= num * (len(x) + len(mine) - shared):
                            links[0].append(a[i])
                            links[1].append(node[i])
            yield pa.record_batch([pa.array(x, pa.int64()) for x in links], names=["a", "b"])

    dealt = texts.repartition(common.partitions_for(docs), "a", "salt").sortWithinPartitions("a", "salt", "second", "node")
    return common.checkpoint(dealt.mapInArrow(run, "a long, b long"))


def _with_ids(docs: DataFrame) -> tuple[DataFrame, int | None]:
    """Rows without an id get one below all others, by their text, to find it by; and the least real id if there are such rows."""
    seen = docs.agg(F.min(F.col("doc_id").cast("long")).alias("least"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("without")).first()
    if not seen.without:
        return docs, None
    below = (seen.least if seen.least is not None else 0) - 1
    named = F.coalesce(F.col("doc_id").cast("long"), F.lit(below) - F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 40)))
    return docs.withColumn("doc_id", named), seen.least if seen.least is not None else 1 << 62


def link(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links of similarity num / den or more) of each document."""
    named, least = _with_ids(docs)
    ids = _named(*_found(named, width, num, den))
    return ids if least is None else _renamed(ids.withColumn("doc_id", F.when(F.col("doc_id") >= least, F.col("doc_id"))))


def _found(docs: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``measure`` gives, (node, doc_id) with the least document of each, and (node, label) of those in links."""
    common.small_batches(docs.sparkSession)
    bands = Bands(num, den)
    measured = common.checkpoint(measure(docs, width))
    nodes = common.checkpoint(measured.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    hot = _find_frequent(docs, width, bands, measured.count())
    met = common.checkpoint(_buckets(_signature_rows(docs, width, bands, hot)))
    stars = common.checkpoint(_stars(met.where("signature IS NOT NULL").select("signature", F.col("a").alias("node"), "need").distinct()))
    rays = stars.where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"), _pair_need("need", "hub_need").alias("need"))
    pairs = met.where("signature IS NULL").select("a", "b", "need").unionByName(rays).groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("need").alias("need"))
    pairs = common.checkpoint(pairs)
    enough = pairs.where("shared >= need").select("a", "b", "shared")
    # round 1: each node and its likeliest partner
    halves = enough.select(F.col("a").alias("node"), F.col("b").alias("other"), "shared").unionByName(enough.select(F.col("b").alias("node"), F.col("a").alias("other"), "shared"))
    likely = common.checkpoint(halves.groupBy("node").agg(F.max(F.struct("shared", "other")).alias("m")).select(F.least("node", "m.other").alias("a"), F.greatest("node", "m.other").alias("b")).distinct())
    links = verify(docs, nodes, likely, width, num, den)
    found = components(links)
    # round 2: the other pairs that components leave open, and those that may share more in large buckets
    large = stars.groupBy("node").agg(F.count_distinct("signature").alias("large"))
    by = lambda side: large.select(F.col("node").alias(side), F.col("large").alias(f"large_{side}"))
    may = pairs.where("shared < need").join(by("a"), "a").join(by("b"), "b").where("shared + least(large_a, large_b) >= need")
    left = _apart(enough.select("a", "b").unionByName(may.select("a", "b")).join(likely, ["a", "b"], "left_anti"), found)
    links = links.unionByName(verify(docs, nodes, left, width, num, den))
    found = components(links)
    # round 3: large buckets that hold several components, by blocks
    more = _blocks(docs, nodes, stars, found, width, num, den)
    if more is not None:
        found = components(links.unionByName(more))
    return measured, nodes, found


def _pair_need(a: str, b: str):
    """Signatures that two nodes must share if they are similar."""
    least = F.least(F.shiftright(a, 16), F.shiftright(b, 16))
    return F.when(least == _NO_NEED, F.lit(1)).otherwise(least)


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    label = lambda side: found.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
    joined = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left")
    return joined.where("label_a IS NULL OR label_b IS NULL OR label_a <> label_b").select("a", "b")


def _blocks(docs: DataFrame, nodes: DataFrame, stars: DataFrame, found: DataFrame, width: int, num: int, den: int) -> DataFrame | None:
    """Links across the components of large buckets, between nodes that share nothing but large buckets (so each is in as many of them
    as its least need; other pairs are verified before).

    Buckets that hold several components and share nodes form a cluster.  Its nodes, in the order of their components, are cut into
    blocks; each text moves once, to the file of its block's sets in the shared folder.  Every two blocks are then compared by a task
    that reads both files, one against a strip of others, by counting common elements of all sets at once; nothing is shuffled for it
    but the blocks' numbers, and no pairs are written out but the links that join components."""
    several = stars.where(F.col("degree") >= F.col("need").bitwiseAND(F.lit(0xFFFF)))
    labelled = several.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = labelled.groupBy("signature").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.min("node").alias("lead")).where("least <> most").select("signature", "lead")
    open_ = common.checkpoint(labelled.join(mixed, "signature").select("node", "lead", "label").distinct())
    if not open_.limit(1).count():
        return None
    cluster = components(open_.select(F.col("lead").alias("a"), F.col("node").alias("b"))).withColumnRenamed("label", "cluster")
    each = numbered(common.checkpoint(open_.select("node", "label").distinct().join(cluster, "node")), [F.col("cluster"), F.col("label"), F.col("node")], "nth")
    each = common.checkpoint(each)
    first = each.groupBy("cluster").agg(F.min("nth").alias("first"))
    placed = common.checkpoint(each.join(first, "cluster").select("node", "label", "cluster", F.floor((F.col("nth") - F.col("first")) / _BLOCK).cast("int").alias("block")))
    orders = placed.join(nodes, "node")
    if placed.count() <= _BROADCAST_ROWS:
        orders = F.broadcast(orders)
    texts = _texts(docs).where("doc_id IS NOT NULL").join(orders, "doc_id").select("cluster", "block", "node", "label", "text")
    spark = docs.sparkSession
    folder = common.new_folder(spark, "blocks")
    fs, at = common.file_system(folder)
    fs.create_dir(at, recursive=True)
    schema = pa.schema([("node", pa.int64()), ("label", pa.int64()), ("elements", pa.list_(pa.uint64()))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = common.file_system(folder)
        key, sink, out, last, count = None, None, None, None, 0

        def close() -> pa.RecordBatch:
            out.close()
            sink.close()
            name = f"{at}/{key[0]}_{key[1]}"
            fs.move(f"{name}.{TaskContext.get().taskAttemptId()}", name)  # a repeated task leaves one whole file
            return pa.record_batch([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([count], pa.int32())], names=["cluster", "block", "n"])

        for batch in batches:
            clusters, blocks, node, label = (batch.column(c).to_numpy() for c in range(4))
            for start, some in _slices(batch, 4, width):
                for r, x in enumerate(some, start):
                    if identity(x) != node[r]:
                        continue  # another text of the same doc_id
                    if key != (now := (int(clusters[r]), int(blocks[r]))):
                        if key is not None:
                            yield close()
                        key, last, count = now, None, 0
                        sink = fs.open_output_stream(f"{at}/{key[0]}_{key[1]}.{TaskContext.get().taskAttemptId()}")
                        out = pa.ipc.new_file(sink, schema)
                    if last != node[r]:
                        last, count = node[r], count + 1
                        out.write_batch(pa.record_batch([pa.array([node[r]], pa.int64()), pa.array([label[r]], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.uint64()))], schema=schema))
        if key is not None:
            yield close()

    partitions = common.partitions_for(docs)
    dealt = texts.repartition(partitions, "cluster", "block").sortWithinPartitions("cluster", "block", "node")
    written = common.checkpoint(dealt.mapInArrow(write, "cluster long, block int, n int"))
    ends = written.groupBy("cluster").agg(F.max("block").alias("last"))
    strips = written.join(ends, "cluster").select("cluster", "block", "last", F.explode(F.sequence(F.floor(F.col("block") / _STRIP), F.floor(F.col("last") / _STRIP))).alias("strip"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = common.file_system(folder)

        def read(cluster: int, block: int) -> list[tuple]:
            with fs.open_input_file(f"{at}/{cluster}_{block}") as source:
                t = pa.ipc.open_file(source).read_all()
            return [(block, int(n), int(l), e.values.to_numpy()) for n, l, e in zip(t["node"].to_numpy(), t["label"].to_numpy(), t["elements"], strict=True)]

        for batch in batches:
            for cluster, i, last, strip in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = read(cluster, i)
                for j in range(max(i, strip * _STRIP), min(last, (strip + 1) * _STRIP - 1) + 1):
                    other = read(cluster, j) if j > i else []
                    if len({h[2] for h in mine} | {h[2] for h in other}) > 1:
                        yield _compared(mine + other, num, den)

    return common.checkpoint(strips.repartition(4 * partitions).mapInArrow(compare, "a long, b long"))


def _compared(held: list[tuple], num: int, den: int) -> pa.RecordBatch:
    """Links between the sets of two blocks (or within one) that join components; a row (block, node, label, set) for each set."""
    a, b, label = [], [], {int(h[2]): int(h[2]) for h in held}

    def top(x: int) -> int:
        while label[x] != x:
            x = label[x]
        return x

    if len(held) > 1:
        two = held[0][0] != held[-1][0]
        cut = next(i for i, h in enumerate(held) if h[0] != held[0][0]) if two else len(held)
        left, right = held[:cut], held[cut:] if two else held
        sizes = [np.array([len(h[3]) for h in side]) for side in (left, right)]
        shared = np.intersect1d(np.concatenate([h[3] for h in left]), np.concatenate([h[3] for h in right]))
        count = np.zeros((len(left), len(right)), np.float32)
        for c in range(0, len(shared), 4096):
            part = shared[c : c + 4096]
            count += _matrix(left, part) @ _matrix(right, part).T
        common_ = count.astype(np.int64)
        similar = den * common_ >= num * (sizes[0][:, None] + sizes[1][None] - common_)
        for x, y in np.argwhere(similar):
            p, q = top(int(left[x][2])), top(int(right[y][2]))
            if p != q:
                label[max(p, q)] = min(p, q)
                a.append(int(left[x][1]))
                b.append(int(right[y][1]))
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _matrix(side: list[tuple], part: np.ndarray) -> np.ndarray:
    out = np.zeros((len(side), len(part)), np.float32)
    for i, h in enumerate(side):
        at = np.minimum(np.searchsorted(part, h[3]), len(part) - 1)
        out[i, at[part[at] == h[3]]] = 1
    return out


def _named(measured: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    labelled = nodes.join(found, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    least = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of = labelled.join(least, "label").select("node", "component_id")
    with_words = measured.where("node IS NOT NULL").join(of, "node").select("doc_id", "n_shingles", "component_id")
    return with_words.unionByName(measured.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _renamed(ids: DataFrame) -> DataFrame:
    """component_id anew as the least real doc_id."""
    least = ids.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    return ids.join(least, "component_id").select("doc_id", "n_shingles", F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row of each component, that of least doc_id (rows without one come last), with all its columns; rows without words all stay.

    Where doc_ids are unique, the others go by doc_id.  Else a row is told by doc_id and set: of the rows that are alike in both one
    stays, and a different text under the same doc_id stands for itself."""
    ids = docs.agg(F.count("*").alias("n"), F.count_distinct(F.col("doc_id").cast("long")).alias("d")).first()
    if ids.n == ids.d:
        gone = common.checkpoint(link(docs, width, num, den).where("n_shingles > 0 AND doc_id <> component_id").select(F.col("doc_id").alias("_gone")))
        gone = F.broadcast(gone) if gone.count() <= _BROADCAST_ROWS else gone
        return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti").select(*docs.columns)
    node = next(c for c in (f"_node{i}" for i in range(len(docs.columns) + 1)) if c not in {x.lower() for x in docs.columns})
    named, least = _with_ids(docs)
    measured, _, found = _found(named, width, num, den)
    each = measured.where("node IS NOT NULL").select("doc_id", "node").distinct().join(found, "node", "left").select("doc_id", "node", F.coalesce("label", "node").alias("label"))
    real = F.col("doc_id") >= F.lit(least if least is not None else -(1 << 63))
    first = each.groupBy("label").agg(F.min(F.struct((~real).alias("without"), "doc_id", "node")).alias("m")).select(F.col("m.node").alias(node), F.col("m.without").alias("_without"), F.col("m.doc_id").alias("_id"))
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, some in _slices(batch, text, width):
                part = batch.slice(a, len(some))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([identity(x) if len(x) else None for x in some], pa.int64())], [*part.schema.names, node])

    schema = docs.select(*docs.columns, F.lit(None).cast("long").alias(node)).schema
    rows = docs.select(*(F.col(c).cast("string").alias(c) if c == "text" else F.col(c) for c in docs.columns)).mapInArrow(run, schema)
    same = F.col("_without") & F.col("doc_id").isNull() | ~F.col("_without") & (F.col("doc_id").cast("long") == F.col("_id"))
    kept = rows.join(first, node).where(F.coalesce(same, F.lit(False))).dropDuplicates([node])
    return kept.select(*docs.columns).unionByName(rows.where(F.col(node).isNull()).select(*docs.columns))
