"""Known answers and plain-Python models of kernels, ranking, grouping, catalogs and partial matches."""

from __future__ import annotations

import random
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from twinlake.functions import kernels, text, vectorized
from twinlake.operators import candidates, catalog, explain, grouping, partial, rank, results, scope, verdict
from twinlake.plans import match_queries
from twinlake.sources import readers, sinks


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(("other", "similarity"), [(0, 1), (1, 63 / 64), (3, 62 / 64), (255, 56 / 64), (-1, 0)])
def test_hamming_similarity(spark, other, similarity):
    assert one(spark, kernels.hamming_similarity(F.lit(0).cast("long"), F.lit(other).cast("long"))) == (similarity,)


def test_max_bits():
    assert [kernels.max_bits(p / 100) for p in (90, 92, 94, 96, 98)] == [6, 5, 3, 2, 1]


def _longs(*values):
    return F.array(*(F.lit(v).cast("long") for v in values))


def test_quorum(spark):
    same, far = _longs(5, 6, 7, 8), _longs(5, 6, 7, ~8)
    ok, mean = kernels.hash_quorum(same, far, 4, 6, 0.6)
    assert one(spark, ok, mean) == (True, 0.25)
    a, b = _longs(1, 2, 3, 4, 5), _longs(1, 2, ~3, ~4, ~5)
    assert one(spark, kernels.hash_quorum(a, b, 5, 6, 0.6)[0], kernels.hash_quorum(a, b, 5, 6, 0.4)[0]) == (False, True)
    assert one(spark, kernels.hash_quorum(_longs(0, 0), _longs(0, 0xFFFF), 2, 16, 0.6)[1]) == (0.125,)


def test_sliding_window(spark):
    clip = _longs(0xDEADBEEF, 0xCAFEBABE)
    whole = _longs(1, 2, 0xDEADBEEF, 0xCAFEBABE, 3)
    w = kernels.sliding_window(clip, whole, 4, 5)
    assert one(spark, w["bits"], w["offset"]) == (0, 2)
    assert one(spark, kernels.sliding_window(_longs(0, 0), _longs(*[0xFFFFFFFF] * 4), 4, 5)) == (None,)
    rng = random.Random(3)
    long = [rng.getrandbits(32) for _ in range(40)]
    short = long[15:35]
    short[4] ^= 0b1111
    w = kernels.sliding_window(_longs(*short), _longs(*long), 4, 5)
    assert one(spark, 1 - w["bits"] / 640, w["offset"]) == (0.99375, 15)


def test_masked_difference_without_pixels_is_null(spark):
    black = F.array_repeat(F.lit(0), 4)
    assert one(spark, kernels.masked_difference(black, black), kernels.gray_difference(black, F.array_repeat(F.lit(255), 4))) == (None, 255 / 256)


def test_double_flip(spark):
    frame = F.array(*map(F.lit, range(16)))
    assert one(spark, kernels.flip(kernels.flip(frame, 4), 4), kernels.flip(frame, 4)[0]) == (list(range(16)), 3)


def test_frame_hash_agrees_with_definition():
    rng = np.random.default_rng(7)
    g = rng.integers(0, 256, 1024, dtype=np.uint8)
    c = np.cos((2 * np.arange(32)[None] + 1) * np.arange(32)[:, None] * np.pi / 64)
    block = (c @ g.reshape(32, 32) @ c.T)[1:9, 1:9].ravel()
    bits = block > np.median(block)
    assert vectorized.frame_hash(g.tobytes()) & (1 << 64) - 1 == sum(1 << i for i in range(64) if bits[i])


def test_content_hash():
    data = np.arange(65536 * 2, dtype=np.uint32).astype("u1").tobytes()
    words = lambda b: sum(int.from_bytes(b[i : i + 8], "little") for i in range(0, 65536, 8))
    assert vectorized.content_hash(data) == f"{(len(data) + words(data[:65536]) + words(data[-65536:])) % (1 << 64):016x}"
    assert vectorized.content_hash(data[:100]) is None


def test_fingerprint_tells_tones_apart_and_repeats():
    t = np.arange(11025 * 4) / 11025
    a, b = (np.sin(2 * np.pi * f * t) * 9000 for f in (440, 660))
    assert vectorized.fingerprint(a) == vectorized.fingerprint(a) != vectorized.fingerprint(b)
    assert vectorized.fingerprint(a[:100]) == []


def test_difference_regions():
    a = np.random.default_rng(1).integers(90, 110, (64, 64)).astype(float)
    b = a.copy()
    b[20:32, 40:52] += 140
    boxes = vectorized.difference_regions(a, b)
    assert boxes and boxes[0][0] <= 40 <= boxes[0][0] + boxes[0][2] and boxes[0][1] <= 20 <= boxes[0][1] + boxes[0][3]
    assert vectorized.difference_regions(a, a) == []


@pytest.mark.parametrize(("bytes_", "said"), [(0, "0 B"), (1023, "1023.0 B"), (1536, "1.5 KB"), (2 * 1024**3, "2.0 GB")])
def test_size_text(spark, bytes_, said):
    assert one(spark, text.size_text(F.lit(bytes_).cast("long"))) == (said,)


def test_text_functions(spark):
    assert one(spark, text.message_key(F.lit("file 'a b' 12 of 300")), text.frame_rate(F.lit("30000/1001")), text.frame_rate(F.lit("25/0")), text.duration_seconds(F.lit("01:02:03.9"))) == ("file '*' # of #", 30000 / 1001, -1.0, 3723)
    assert one(spark, text.error_cause(F.lit("x MOOV atom not found")), text.hdr_format(F.lit("SMPTE2084"), F.lit("a|DOVI x")), text.moved(F.lit("/ab/c"), "/a", "/z")) == ("CorruptOrTruncated", "Dolby Vision", "/ab/c")


def _items(spark, rows, **fixed):
    base = {"group_id": 1, "size": 1, "similarity": 100.0, "duration_s": 10.0, "width": 1280, "height": 720, "frame_size_int": 2000, "fps": 25.0, "bitrate_kbs": 1000, "audio_bitrate_kbs": 128, "sample_rate": 44100, "is_image": False, "flags": 0, "checked": False, "file_exists": True, "root_ready": True, "hdr_rank": 0, "st_dev": 1}
    full = [base | {"seq": i, "path": f"/a/{i}", "st_ino": i, "date_created": pd.Timestamp("2020-01-01") + pd.Timedelta(days=i)} | fixed | r for i, r in enumerate(rows)]
    return spark.createDataFrame(pd.DataFrame(full))


def _cascade(rows, steps):
    """The cascade as it is told: best, those tied with it, next step."""
    alive, keep = list(rows), rows[0]
    for name, up, ties, video in steps:
        if len(alive) <= 1:
            break
        if video and keep["is_image"]:
            continue
        keep = (min if up else max)(alive, key=lambda r: r[name])
        tied = [r for r in alive if ties(r[name], keep[name])]
        if len(tied) <= 1:
            return keep
        alive = tied
    return keep


def test_keeper_cascade_against_model(spark):
    rng = random.Random(5)
    near = lambda a, b: abs(a - b) <= max(a, b) * 0.05
    steps = [("duration_s", False, lambda a, b: abs(a - b) <= 1 or abs(a - b) <= max(a, b) * 0.01, True), ("frame_size_int", False, lambda a, b: a == b, False), ("bitrate_kbs", False, near, True), ("fps", False, lambda a, b: abs(a - b) <= 0.5, True), ("size", True, lambda a, b: a == b, False)]
    groups = {g: [{"group_id": g, "seq": i, "size": rng.randint(1, 4), "duration_s": float(rng.randint(100, 104)), "frame_size_int": rng.choice([1000, 2000]), "bitrate_kbs": rng.choice([1000, 1030, 1070, 1200]), "fps": rng.choice([25.0, 25.4, 26.0]), "is_image": rng.random() < 0.2} for i in range(rng.randint(1, 5))] for g in range(40)}
    df = _items(spark, [r for rows in groups.values() for r in rows])
    c = rank.criteria()
    got = rank.keepers(df, [c[n] for n in ("Duration", "Resolution", "Bitrate", "FPS", "Size")]).where("is_keeper").select("group_id", "seq").collect()
    assert sorted(map(tuple, got)) == [(g, _cascade(rows, steps)["seq"]) for g, rows in groups.items()]


def test_strategies(spark):
    df = _items(spark, [{"size": 1000}, {"size": 5000}, {"size": 3000}])
    assert sorted(r.size for r in rank.deletions(df, "Smallest File").collect()) == [1000, 3000]
    with pytest.raises(ValueError):
        rank.strategy_name("prettiest")
    assert rank.deletions(_items(spark, [{"similarity": 99.0}, {}]), "hundred-percent-only").count() == 0


def test_headers_clamp_sizes(spark):
    h = results.headers(_items(spark, [{"size": -5}, {"size": 200}, {"size": 100}])).first()
    assert (h.total_bytes, h.wasted_bytes) == (300, 100)


@pytest.mark.parametrize("partitions", [1, 5])
def test_group_numbers_do_not_depend_on_partitions(spark, partitions):
    df = _items(spark, [{"group_id": i % 7, "size": (i * 37) % 11} for i in range(50)]).repartition(partitions)
    got = {r.group_id: r.group_no for r in results.numbered(results.headers(df), "WastedSpace").collect()}
    head = sorted(results.headers(df).collect(), key=lambda r: (-r.wasted_bytes, r.group_id))
    assert got == {r.group_id: i + 1 for i, r in enumerate(head)}


def test_blacklist_needs_one_set_for_all(spark):
    df = _items(spark, [{"group_id": 1}, {"group_id": 1}, {"group_id": 2}, {"group_id": 2}])
    sets = spark.createDataFrame([(1, ["/a/0", "/a/1"]), (2, ["/a/2"]), (3, ["/a/3"])], "bl_id long, paths array<string>")
    assert {r.group_id for r in results.drop_blacklisted(df, sets).collect()} == {2}


def test_prune_star_and_clique():
    star = {(0, 1), (0, 2), (0, 3)}
    assert grouping.prune([0, 1, 2, 3], star) == [0, 2, 3]
    clique = {(a, b) for a in range(5) for b in range(a + 1, 5)}
    assert grouping.split(list(range(5)), clique) == [list(range(5))]


def test_groups_against_replay(spark):
    rng = random.Random(11)
    n = 60
    emitted = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.03}
    plain = emitted | {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.05}
    rows = [(a, b, 0.1, 8, (a, b) in emitted, True) for a, b in sorted(plain)]
    edges = spark.createDataFrame(rows, "a long, b long, difference double, flags int, emitted boolean, plain boolean").repartition(3)
    got = {}
    for r in grouping.groups(edges).collect():
        got.setdefault(r.group_id, set()).add(r.node)
    group, _, how, _ = grouping.merge_greedily([(a, b, 0.1, 8) for a, b in sorted(emitted)], plain)
    members: dict = {}
    for x in sorted(group, key=lambda x: how[x][2]):
        members.setdefault(group[x], []).append(x)
    want = [set(p) for order in members.values() for p in (grouping.split(order, plain) if len(order) >= 3 else [order])]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    assert sum(map(len, got.values())) == len(set().union(*got.values()))  # every node once


@pytest.mark.parametrize("chunk", [3, 1000])
def test_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(grouping, "_CHUNK", chunk)
    rng = random.Random(3)
    pairs = [(rng.randrange(50), rng.randrange(50)) for _ in range(35)] + [(200 + i, 201 + i) for i in range(25)]
    want = {x: x for e in pairs for x in e}
    for _ in want:
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    got = {r.node: r.component for r in grouping.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want


def test_over_budget_components_stay(spark):
    edges = spark.createDataFrame([(i, i + 1, 0.0, 0, True, False) for i in range(10)], "a long, b long, difference double, flags int, emitted boolean, plain boolean")
    assert {(r.group_id, r.skipped) for r in grouping.groups(edges, budget=5).collect()} == {(0, True)}


@pytest.mark.parametrize("daisy", [False, True])
def test_large_components_are_merged(spark, daisy):
    """A chain of unlike items beyond 131,000 nodes is cut into pairs by the greedy merge."""
    n = 131_010
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(0.25).alias("difference"), F.lit(8).alias("flags"), F.lit(True).alias("emitted"), F.lit(False).alias("plain"))
    got = grouping.groups(edges, daisy=daisy).toPandas()
    assert len(got) == n and got.groupby("group_id").size().eq(2).all() and not got.skipped.any()
    assert (got.difference == 0.25).all() and (got["flags"] == np.where(got.node % 2, 8, 0)).all() and (got.blocked == n // 2 - 1).all()


def test_groups_over_the_split_budget_keep_their_facts(spark):
    star = [(0, i, i / 100, 8, True, True) for i in range(1, 8)] + [(20, 21, 0.5, 8, True, True), (20, 22, 0.5, 8, True, True), (21, 22, 0.5, 8, True, True)]
    edges = spark.createDataFrame(star, "a long, b long, difference double, flags int, emitted boolean, plain boolean")
    got = {(r.group_id, r.node, r.difference, r.flags, r.skipped) for r in grouping.groups(edges, split_budget=5).collect()}
    assert got == {(0, 0, 0.01, 0, True), *((0, i, i / 100, 8, True) for i in range(1, 8)), (20, 20, 0.5, 0, False), (20, 21, 0.5, 8, False), (20, 22, 0.5, 8, False)}


@pytest.mark.parametrize("daisy", [False, True])
def test_streamed_merge_against_replay(spark, daisy):
    rng = random.Random(5)
    n = 300
    emitted = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.02}
    plain = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4}
    rows = [(a, b, (a * n + b) / 1e6, (a + b) % 8, (a, b) in emitted, (a, b) in plain) for a, b in sorted(emitted | plain)]
    edges = spark.createDataFrame(rows, "a long, b long, difference double, flags int, emitted boolean, plain boolean").repartition(5)
    group, rep, how, blocked = grouping.merge_greedily([r[:4] for r in rows if r[4]], plain)
    members: dict = {}
    for x in sorted(group, key=lambda x: how[x][2]):
        members.setdefault(group[x], []).append(x)
    want = {(min(part), x, rep[g] if rep[g] in part else part[0], *how[x], blocked, False) for g, order in members.items() for part in (grouping.split(order, plain) if daisy and len(order) >= 3 else [order]) for x in part}
    assert {tuple(r) for r in grouping.groups(edges, daisy=daisy).collect()} == want


@pytest.mark.parametrize(("percent", "least", "most"), [(20, 0, 0), (5, 10, 0), (20, 2, 30), (0, 5, 0)])
def test_duration_band_against_loop(spark, percent, least, most):
    rng = random.Random(2)
    d = [float(rng.randint(1, 400)) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(d)), "idx long, duration_s double")

    def tolerance(x):
        if percent <= 0:
            return least
        t = x * (percent / 100)
        t = max(t, least) if least > 0 else t
        return min(t, most) if most > 0 else t

    want = {(i, j) for i in range(len(d)) for j in range(i + 1, len(d)) if abs(d[i] - d[j]) <= min(tolerance(d[i]), tolerance(d[j]))}
    got = [(r.idx_a, r.idx_b) for r in candidates.duration_band(df, percent, least, most).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("most", [1, 7, 128])
def test_duration_band_ids_against_loop(spark, most):
    """Partners at exactly the tolerance, equal durations, repeated and null ids and keys; blocks of a row, small ones, and one a bucket."""
    rng = random.Random(3)
    rows = [(i, float(rng.choice([5, 6, 10, 12, 100, 120, rng.randint(1, 400)])), rng.choice("xy")) for i in range(250)]
    rows += [(7, 100.0, "x"), (7, 100.0, "x"), (8, 0.0, "x"), (9, -3.0, "y"), (9, None, "y"), (None, 100.0, "x"), (10, 100.0, None)]
    df = spark.createDataFrame(rows, "idx long, duration_s double, k string").repartition(3)
    known = [r for r in rows if None not in r and r[1] > 0]
    want = sorted((a, b) for a, x, k in known for b, y, m in known if a < b and k == m and abs(x - y) <= min(x * 0.2, y * 0.2))
    got = candidates.duration_band_ids(df, keys=("k",), most=most)
    assert got.dtypes == [("idx_a", "bigint"), ("idx_b", "bigint")] and sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, candidates.duration_band(df, keys=("k",)).select("idx_a", "idx_b").collect())) == want
    assert candidates.duration_band_ids(df.where("duration_s < 0"), keys=("k",)).count() == 0


def test_duration_band_pairs_pack(spark, tmp_path):
    """Written pairs take under half a byte each; they took 1.7 where a row's partners came in no order."""
    df = spark.range(6000).select((F.col("id") * 1361 % 6000).alias("idx"), (F.col("id") * 7919 % 4001 + 1000).cast("double").alias("duration_s"), F.lit("en").alias("lang"))
    df.withColumns({"doc_id": F.col("idx"), "n_chars": F.col("duration_s").cast("long"), "source": F.lit("web")}).write.parquet(str(tmp_path / "documents.parquet"))
    out = tmp_path / "out"
    match_queries.duration_band(spark, str(tmp_path)).write.parquet(str(out))
    n = spark.read.parquet(str(out)).count()
    assert n > 3_000_000 and sum(f.stat().st_size for f in out.glob("*.parquet")) < n / 2


def test_blocks_make_each_pair_once(spark):
    """Every two rows meet once, in blocks of bounded size; null vectors and an empty table have no pairs."""
    df = spark.createDataFrame([(i * 3, [i % 5, 1, -i % 7]) for i in range(200)], "idx long, q array<int>")
    met = candidates.block_pairs(df, most=30).select("idx_a", "idx_b")
    assert met.count() == met.distinct().count() == 200 * 199 // 2
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    rows = {r.idx: r.q for r in df.collect()}
    dot = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True))
    want = {(a, b, dot(x, y)) for a, x in rows.items() for b, y in rows.items() if a < b and dot(x, y) / 16129 >= 10 / 16129}
    assert {tuple(r) for r in candidates.vector_pairs(df.union(spark.createDataFrame([(7, None)], df.schema)), 10 / 16129).collect()} == want
    assert candidates.vector_pairs(df.limit(0), 0.5).count() == candidates.block_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [0, 2, 9, 14, 20, 64])
def test_hash_pairs_of_all_widths(spark, bits):
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(6)]
    rows = [(i, (v - (1 << 64) if v >= 1 << 63 else v)) for i, v in enumerate(h ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 12))) for h in base for _ in range(15))]
    got = {(r.idx_a, r.idx_b) for r in candidates.hash_pairs(spark.createDataFrame(rows, "idx long, phash long"), bits).collect()}
    assert got == {(i, j) for i, x in rows for j, y in rows if i < j and bin((x ^ y) & ((1 << 64) - 1)).count("1") <= bits}


def test_hash_pairs_against_loop(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(20)]
    h = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(4)] + base
    h = [x - (1 << 64) if x >> 63 else x for x in h]
    df = spark.createDataFrame(list(enumerate(h)), "idx long, phash long")
    want = {(i, j) for i in range(len(h)) for j in range(i + 1, len(h)) if ((h[i] ^ h[j]) & (1 << 64) - 1).bit_count() <= 3}
    got = [(r.idx_a, r.idx_b) for r in candidates.hash_pairs(df, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_partial_ratio_against_loop(spark):
    rng = random.Random(9)
    d = [float(rng.randint(1, 500)) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(d)), "idx long, duration_s double")
    want = {(i, j) for i in range(80) for j in range(80) if d[i] >= 1 and d[j] < d[i] * 0.95 and d[j] >= d[i] * 0.1}
    assert {(r.idx_src, r.idx_clip) for r in candidates.partial_ratio(df).select("idx_src", "idx_clip").collect()} == want


def test_relink_takes_unique_content_once(spark):
    kind = "path string, size long, os_hash string"
    new = spark.createDataFrame([("/n1", 1, "h"), ("/n2", 1, "h"), ("/n3", 2, "x"), ("/n4", 3, None)], kind)
    gone = spark.createDataFrame([("/o1", 1, "h"), ("/o2", 2, "x"), ("/o3", 2, "x"), ("/o4", 3, None)], kind)
    assert {r.path: r.old_path for r in catalog.relink(new, gone).collect()} == {"/n1": "/o1", "/n2": None, "/n3": None, "/n4": None}


def test_merge_is_idempotent_and_keeps_features(spark):
    kind = "path string, size long, date_created timestamp, date_modified timestamp, os_hash string"
    t0, t1 = datetime(2020, 1, 1), datetime(2021, 1, 1)
    old = spark.createDataFrame([("/a", 1, t0, t0, "h1", 10), ("/b", 2, t0, t0, "h2", 20), ("/c", 3, t0, t0, "h3", 30)], kind + ", feature int")
    new = spark.createDataFrame([("/a", 1, t0, t1, "h1"), ("/b", 9, t0, t0, "h9"), ("/d", 3, t0, t0, "h3")], kind)
    got = {r.path: (r.feature, r.file_exists) for r in catalog.merge(old, new).collect()}
    assert got == {"/a": (10, True), "/b": (None, True), "/d": (30, True)}  # /c moved to /d
    again = catalog.merge(catalog.merge(old, new).drop("file_exists"), new)
    assert {r.path: r.feature for r in again.collect()} == {"/a": 10, "/b": None, "/d": 30}


def test_timeline_matches(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(30, 8)) * 40).astype(int).clip(-127, 127)
    unit = lambda x: [int(round(127 * t)) for t in x / np.linalg.norm(x)]
    rows = [("src", float(10 * k), unit(v[k])) for k in range(30)] + [("clip", float(10 * k), unit(v[k + 12])) for k in range(10)]
    frames = spark.createDataFrame(rows, "path string, t_sec double, emb array<int>").withColumn("sign", kernels.sign_bits(F.col("emb")))
    pairs = spark.createDataFrame([("src", "clip")], "source string, clip string")
    for bits in (None, 4):
        r = partial.timeline_matches(pairs, frames, hit=0.97, bits=bits).first()
        assert (r.hits, r.offset_s) == (10, 120.0)


def test_explain_agrees_with_verdict(spark):
    m = verdict.Matching(percent=90, positions=1, side=2)
    rows = [([[10, 20, 30, 40]], [[12, 20, 30, 40]], 10.0, 11.0), ([[10, 20, 30, 40]], [[200, 20, 30, 40]], 10.0, 30.0)]
    df = spark.createDataFrame(rows, "frames_a array<array<int>>, frames_b array<array<int>>, duration_s_a double, duration_s_b double")
    for side in "ab":
        df = df.withColumns({f"is_image_{side}": F.lit(False), f"entry_flags_{side}": F.lit(0), f"folder_{side}": F.lit("/x")})
    got = [(r.verdict, r.hint) for r in explain.explain(df, m).collect()]
    assert got == [("match", None), ("no match", "raise the duration tolerance")]


def test_expression_is_checked(spark):
    df = _items(spark, [{}, {"size": 7}])
    assert df.where(explain.expression(df, "size > 5")).count() == 1
    for bad in ("nothing > 5", "size + 1", "size > (SELECT 1)", "rand() > 0"):
        with pytest.raises(Exception):  # noqa: B017  Spark's or ours
            explain.expression(df, bad)


def test_longest_root(spark):
    paths = spark.createDataFrame([("/a/b/c",), ("/ab/c",), ("/z",)], "path string")
    roots = spark.createDataFrame([("/a",), ("/a/b",)], "root string")
    assert {r.path: r.root for r in scope.longest_root(paths, roots).collect()} == {"/a/b/c": "/a/b", "/ab/c": None, "/z": None}


def test_files_and_catalog_round_trip(spark, tmp_path):
    for name in ("a.mp4", "b.JPG", "c.txt"):
        (tmp_path / name).write_bytes(b"x" * 10)
    got = {(r.path.rsplit("/", 1)[1], r.size, r.is_image) for r in readers.list_files(spark, str(tmp_path)).collect()}
    assert got == {("a.mp4", 10, False), ("b.JPG", 10, True)}
    store = str(tmp_path / "catalog")
    for v in (1, 2):
        sinks.write_catalog(spark.createDataFrame([(f"/p{v}",)], "path string"), store, v)
    assert [r.path for r in readers.read_catalog(spark, store).select("path").collect()] == ["/p2"]


def test_blacklist_versions(spark, tmp_path):
    for name, said in (("v0", '[["/a","/b"],["/c"]]'), ("v1", '{"version":1,"groups":[["/a","/b"],["/c"]]}'), ("bad", "{")):
        (tmp_path / name).write_text(said)
        n = [r.paths for r in readers.read_blacklist(spark, str(tmp_path / name)).collect()]
        assert n == ([["/a", "/b"], ["/c"]] if name != "bad" else [])


def test_result_shapes(spark, tmp_path):
    item = '{"groupId":"g","path":"/a","sizeLong":1,"similarity":99.5,"isImage":false,"flags":0}'
    for name, said in (("array", f"[{item}]"), ("envelope", f'{{"version":1,"items":[{item}]}}')):
        (tmp_path / name).write_text(said)
        assert [r.path for r in readers.read_results(spark, str(tmp_path / name)).collect()] == ["/a"]


def test_damaged_files_do_not_end_a_scan(spark):
    def decoder(path, times):
        if "bad" in path:
            raise OSError("broken")
        return [bytes([7]) * 1024 for _ in times]

    df = spark.createDataFrame([("/ok", 10.0), ("/bad", 10.0)], "path string, duration_s double")
    got = {(r.path, r.pos_idx): r.gray for r in readers.sample_frames(df, decoder, positions=2).collect()}
    assert got["/ok", 1] is not None and got["/bad", 0] is None and len(got) == 4


def test_streamed_rescan_equals_batch(spark, tmp_path):
    from twinlake.streaming import rescan

    kind = "path string, size long, date_created timestamp, date_modified timestamp, os_hash string"
    t = datetime(2020, 1, 1)
    for i in range(3):
        spark.createDataFrame([(f"/f{j}", i + j, t, t, f"h{i + j}") for j in range(i, i + 4)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = str(tmp_path / "out")
    read = lambda v: spark.read.parquet(f"{store}/v={v}") if v else None
    stream = rescan.stream_table(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
    rescan.rescan(stream, store, str(tmp_path / "work"), read).awaitTermination()
    assert {r.path for r in read(3).collect()} == {f"/f{j}" for j in range(6)}


def test_export_files(spark, tmp_path):
    row = (1, 2, 'a "b", c', 10, 90061.25, 640, 360, 29.97, 800.0, None, 44100, 99.0, datetime(2024, 1, 2, 3, 4, 5), False, True)
    df = spark.createDataFrame([row], "group_id long, seq long, path string, size long, duration_s double, width int, height int, fps double, bitrate_kbs double, audio_format string, sample_rate int, similarity double, date_created timestamp, is_image boolean, checked boolean")
    sinks.write_export(df, str(tmp_path / "all"))
    text_ = next((tmp_path / "all").glob("*.csv")).read_bytes()
    assert text_.startswith(b"\xef\xbb\xbfGroupId,Path,SizeBytes,")
    assert text_.decode("utf-8-sig").splitlines()[1] == '1,"a ""b"", c",10,1.01:01:01.2500000,640x360,29.97,800,,44100,99,2024-01-02 03:04:05,False,True'
    assert sinks.export_rows(df, marks=False).columns[-1] == "IsImage" and len(sinks.export_rows(df, marks=False).columns) == 12
    assert sinks.export_rows(df.limit(0)).count() == 0


def test_too_dark_needs_every_new_frame(spark):
    df = spark.createDataFrame([("a", [0] * 9 + [200]), ("a", [0] * 10), ("b", [0] * 10), ("b", [200] * 10), ("c", None)], "path string, gray array<int>")
    assert {r.path: r.too_dark for r in scope.too_dark(df).collect()} == {"a": True, "b": False}


def test_frames_at_any_time(spark):
    df = spark.createDataFrame([("/a", [9.0, 0.5]), ("/bad", [1.0]), ("/none", None), ("/empty", [])], "path string, seconds array<double>")

    def decoder(path, times):
        if "bad" in path:
            raise OSError("broken")
        return [str(t).encode() for t in times]

    got = {(r.path, r.pos_idx, r.t_sec): r.gray and bytes(r.gray) for r in readers.frames_at(df, decoder).collect()}
    assert got == {("/a", 0, 9.0): b"9.0", ("/a", 1, 0.5): b"0.5", ("/bad", 0, 1.0): None}


@pytest.mark.parametrize("one_file", [True, False])
def test_envelope_round_trip(spark, tmp_path, one_file):
    rows = [(g, f'/a "{g}"/{i},\n', 10 * i, 100.0 - i, i % 2 == 0, i) for g in range(40) for i in range(3)]
    df = spark.createDataFrame(rows, "group_id long, path string, size long, similarity double, is_image boolean, flags int")
    at = str(tmp_path / "envelope")
    sinks.write_envelope(df.repartition(5), at, one_file)
    got = {(int(r.groupId), r.path, r.sizeLong, r.similarity, r.isImage, r.flags) for r in readers.read_results(spark, at).collect()}
    assert got == set(rows)
    assert not one_file or len(list((tmp_path / "envelope").glob("part-*"))) == 1
    sinks.write_envelope(df.limit(0), at, one_file)
    assert readers.read_results(spark, at).count() == 0


def test_culling_against_walk(spark):
    rng = random.Random(3)
    rows = [(g, s, rng.random() < 0.5, rng.choice(["left", "right", None])) for g in range(200) for s in range(1 + g % 7)]
    df = spark.createDataFrame(rows, "group_id long, seq long, checked boolean, decision string")
    got = {(r.group_id, r.seq): (r.left_seq, r.checked_after) for r in rank.culled(df.repartition(7)).collect()}
    for g in range(200):
        mine = [r for r in rows if r[0] == g]
        marks, left, met = {r[1]: r[2] for r in mine}, 0, {0: None}
        for right in range(1, len(mine)):
            met[right] = left
            if mine[right][3] == "left":
                marks[right], marks[left] = True, False
            elif mine[right][3] == "right":
                marks[left], marks[right], left = True, False, right
        assert {r[1]: got[g, r[1]] for r in mine} == {s: (met[s], marks[s]) for s in marks}


def test_projection_of_images_and_entries_without_streams(spark):
    kind = "group_id long, path string, folder string, size long, is_image boolean, duration_s double, streams array<struct<codec_name:string,codec_type:string,width:int,height:int,sample_rate:int,channel_layout:string,bit_rate:bigint,frame_rate:float,channels:int,hdr_format:string>>, date_created timestamp, difference double, match_flags int"
    video = lambda w, h, name: (name, "VIDEO", w, h, None, None, 1500, 25.0, None, None)
    rows = [
        (1, "/a/x.PNG", "/a", 1, True, 5.0, [video(30, 20, "png")], None, 0.0, 0),
        (1, "/a/noending", "/a", 1, True, 5.0, [], None, 0.0, 0),
        (2, "/a/b.mp4", "/a", 1, False, 5.0, None, None, 0.5, 8),
        (3, "/a/c.mp4", "/a", 1, False, 5.0, [video(None, 9, "first"), video(4, 4, "second"), video(2, 8, "third")], None, 0.5, 8),
        (4, "/a/d.mp4", "/a", 1, None, 5.0, [("aac", "audio", None, None, None, None, None, None, None, None)], None, 0.5, 8),
    ]
    got = {r.path: r for r in results.projected(spark.createDataFrame(rows, kind)).collect()}
    assert (got["/a/x.PNG"].format, got["/a/x.PNG"].frame_size, got["/a/x.PNG"].duration_s, got["/a/x.PNG"].similarity) == ("PNG", "30x20", 0.0, 100.0)
    assert (got["/a/noending"].format, got["/a/noending"].frame_size, got["/a/noending"].frame_size_int) == (None, None, 0)
    assert (got["/a/b.mp4"].format, got["/a/b.mp4"].fps, got["/a/b.mp4"].duration_s) == (None, 0.0, 0.0)
    assert (got["/a/c.mp4"].format, got["/a/c.mp4"].frame_size_int, int(got["/a/c.mp4"].bitrate_kbs)) == ("second", 8, 2)
    assert (got["/a/d.mp4"].audio_format, got["/a/d.mp4"].audio_channel, got["/a/d.mp4"].sample_rate, got["/a/d.mp4"].format) == ("aac", "<Unknown>", 0, None)


def test_sign_words_and_cache_key(spark):
    values = [(-1) ** (i * i // 3) * (i + 1) for i in range(130)]
    words = one(spark, kernels.sign_words(F.lit(values), 130))[0]
    assert [w % (1 << 64) for w in words] == [sum(1 << i for i, x in enumerate(values[k : k + 64]) if x < 0) for k in (0, 64, 128)]
    assert one(spark, kernels.words_hamming(F.array(F.lit(-1).cast("long"), F.lit(3).cast("long")), F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))) == (65,)
    a, b, none = one(spark, text.cache_key(F.lit("/a/ä")), text.cache_key(F.lit("/a/b")), text.cache_key(F.lit(None).cast("string")))
    assert len(a) == len(b) == 16 and a != b and int(a, 16) >= 0 and none is None


def test_cleared_entries_keep_their_identity(spark):
    df = spark.createDataFrame([("/a", 5, 1023, 9.0, [(0, b"x", 1)], [1, 2])], "path string, size long, flags int, duration_s double, frames array<struct<pos_idx:int,gray:binary,phash:bigint>>, audio_fp array<bigint>")
    r = catalog.clear_hashes(df).first()
    assert (r.path, r.size, r.duration_s, r.frames, r.audio_fp) == ("/a", 5, None, [], None)
    assert r.flags == scope.IS_IMAGE | scope.EXCLUDED | scope.REPARSE | scope.REPARSE_CHECKED


def test_damaged_catalog_is_an_error(spark, tmp_path):
    at = str(tmp_path / "catalog")
    sinks.write_catalog(spark.createDataFrame([], readers.schema.MEDIA_ENTRY), at, 1)
    sinks.write_catalog(spark.createDataFrame([("/a",)], "path string"), at, 2)
    for part in (tmp_path / "catalog" / "v=2").glob("*.parquet"):
        part.write_bytes(b"damaged")
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="(?i)parquet"):
        readers.read_catalog(spark, at).collect()
    assert readers.read_catalog(spark, at, 1).count() == readers.read_catalog(spark, at, 7).count() == 0


def test_snapshot_fills_hashes_and_leaves_out_dark_vectors(spark):
    rng = random.Random(5)
    frame, dark = [rng.randrange(256) for _ in range(1024)], [0] * 1024
    kind = "path string, is_image boolean, frames array<array<int>>, hashes array<bigint>, vectors array<array<int>>"
    rows = [("video", False, [frame, dark], [5, None], [[1], [2]]), ("image", True, [frame], None, [[1]]), ("short", False, [frame], None, None), ("bare", False, [frame, frame], None, None)]
    m = verdict.Matching(positions=2, combine=True, flipped=True, use_ai=True)
    got = {r.path: r for r in verdict.snapshot(spark.createDataFrame(rows, kind), m).collect()}
    assert set(got) == {"video", "image", "bare"}
    assert got["video"].hashes == [5, vectorized.frame_hash(bytes(dark))] and got["video"].vectors == [[1], None]
    assert got["image"].hashes == [vectorized.frame_hash(bytes(frame))] and got["bare"].vectors is None
    mirrored = bytes(np.array(frame, np.uint8).reshape(32, 32)[:, ::-1].tobytes())
    assert got["bare"].hashes_flip == [vectorized.frame_hash(mirrored)] * 2


def test_all_timelines_as_by_pairs(spark):
    """Matrices of blocks give what pairs of rows give; uneven paths, frames without a vector and a path that has none."""
    rng = random.Random(5)
    rows = [(p, float(k * 5), [rng.randint(-127, 127) for _ in range(8)] if rng.random() < 0.9 and p != 6 else None) for p, n in enumerate((30, 3, 12, 1, 25, 9, 4, 18)) for k in range(n)]
    df = spark.createDataFrame(rows, "path long, t_sec double, emb array<int>").withColumn("sign", kernels.sign_bits(F.col("emb")))
    pairs = df.select(F.col("path").alias("source")).distinct().crossJoin(df.select(F.col("path").alias("clip")).distinct()).where("source <> clip")
    shown = lambda d: sorted((r.source, r.clip, r.hits, round(r.sim, 12), r.offset_s) for r in d.collect())
    for bits in (None, 3):
        want = shown(partial.timeline_matches(pairs, df, hit=0.3, bits=bits))
        assert want and all(shown(partial.all_timeline_matches(df, hit=0.3, bits=bits, paths=n)) == want for n in (3, 200))
    assert partial.all_timeline_matches(df.limit(0)).count() == 0


def test_prefilter_makes_no_row_of_two_frames(spark, sf):
    plan = match_queries.sign_prefilter(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "CoGroupsInArrow" in plan
