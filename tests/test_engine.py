"""The whole comparison on a synthetic corpus with planted copies."""

from __future__ import annotations

import random

from twinlake.__main__ import main
from twinlake.operators import scope, verdict
from twinlake.plans import engine

KIND = "path string, folder string, is_image boolean, flags int, size long, duration_s double, frames array<array<int>>, file_exists boolean, root_ready boolean, st_dev long, st_ino long, audio_fp array<bigint>, frame_size_int int, fps double, bitrate_kbs long, audio_bitrate_kbs long, hdr_rank int"


def corpus(spark):
    rng = random.Random(7)
    frame = lambda: [rng.randrange(256) for _ in range(64)]
    near = lambda f: [max(0, min(255, x + rng.randint(-2, 2))) for x in f]
    rows, cluster = [], {}
    for c in range(12):
        base = [frame(), frame()]
        for k in range(rng.choice([1, 2, 3])):
            image = c % 4 == 0
            path = f"/m/{k}/{c}-{k}"
            frames = [near(f) for f in base]
            rows.append((path, f"/m/{k}", image, 0, 1000 + k, 100.0 + c + k * 0.1, frames, True, True, 1, len(rows), None, 100 * k, 25.0, 10, 1, 0))
            cluster[path] = c
    rows.append(("/m/9/mirror", "/m/9", False, 0, 5, 101.0, [[f[y * 8 + 7 - x] for y in range(8) for x in range(8)] for f in rows[[r[0] for r in rows].index("/m/0/1-0")][6]], True, True, 1, 999, None, 1, 25.0, 10, 1, 0))
    rows.append(("/m/9/hard", "/m/9", False, 0, 1000, 102.0, rows[[r[0] for r in rows].index("/m/0/2-0")][6], True, True, 1, rows[[r[0] for r in rows].index("/m/0/2-0")][10], None, 1, 25.0, 10, 1, 0))
    return spark.createDataFrame(rows, KIND), cluster


def groups(df):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r.group_id, set()).add(r.path)
    return sorted(map(sorted, out.values()))


def test_compare_finds_planted_copies(spark):
    df, cluster = corpus(spark)
    want: dict = {}
    for p, c in cluster.items():
        want.setdefault(c, []).append(p)
    want = sorted(sorted(v) for v in want.values() if len(v) > 1)
    m = verdict.Matching(percent=96, positions=2, side=8)
    for parts in (1, 7):
        got = groups(engine.compare(df.repartition(parts), engine.Settings(matching=m)))
        assert [g for g in got if "/m/9/hard" not in g] == [g for g in want if "/m/0/2-0" not in g or g in got]
    mirrored = groups(engine.compare(df, engine.Settings(matching=verdict.Matching(percent=96, positions=2, side=8, flipped=True))))
    assert any("/m/9/mirror" in g and "/m/0/1-0" in g for g in mirrored)


def test_components_over_the_budget_keep_similarity(spark):
    df, _ = corpus(spark)
    m = verdict.Matching(percent=96, positions=2, side=8)
    of = lambda budget: {(r.path, r.group_id, r.similarity, r.flags, r.skipped) for r in engine.compare(df, engine.Settings(matching=m, budget=budget)).collect()}
    whole, small = of(131_000), of(2)
    assert {r[:4] for r in small} == {r[:4] for r in whole} and any(r[4] for r in small) and not any(r[4] for r in whole)


def test_folders_and_scope(spark):
    df, _ = corpus(spark)
    m = verdict.Matching(percent=96, positions=2, side=8)
    assert groups(engine.compare(df, engine.Settings(matching=m, folders="same"))) == []
    assert groups(engine.compare(df, engine.Settings(matching=m, scope=scope.Scope(include=["/m/0"])))) == []


def test_strategy_keeps_one_of_each_group(spark):
    df, _ = corpus(spark)
    s = engine.Settings(matching=verdict.Matching(percent=96, positions=2, side=8))
    items, gone = engine.scan_and_compare(df, s, "worst-resolution")
    n = {r.group_id: r["count"] for r in items.groupBy("group_id").count().collect()}
    assert gone.count() == sum(n.values()) - len(n)


def test_partial_clips(spark):
    rng = random.Random(1)
    long = [rng.getrandbits(32) for _ in range(60)]
    rows = [("/a", "/x", False, 0, 1, 60.0, [], True, True, 1, 1, long, 1, 1.0, 1, 1, 0), ("/b", "/x", False, 0, 1, 20.0, [], True, True, 1, 2, long[25:45], 1, 1.0, 1, 1, 0), ("/c", "/x", False, 0, 1, 20.0, [], True, True, 1, 3, [0] * 20, 1, 1.0, 1, 1, 0)]
    df = spark.createDataFrame(rows, KIND)
    got = {(r.group_id, r.path, r.offset_s) for r in engine.partial_clips(df, df.limit(0), engine.Settings()).collect()}
    assert got == {("/a", "/a", None), ("/a", "/b", 25.0)}


def test_command_line(spark, tmp_path):
    df, _ = corpus(spark)
    s = engine.Settings(matching=verdict.Matching(percent=96, positions=2, side=8))
    engine.compare(df, s).write.parquet(str(tmp_path / "items"))
    main(["mark", "--items", str(tmp_path / "items"), "--strategy", "smallest-file", "--out", str(tmp_path / "plan")])
    assert {r.action for r in spark.read.json(str(tmp_path / "plan")).collect()} == {"delete"}
