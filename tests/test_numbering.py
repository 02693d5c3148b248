"""Numbers over ranges hold where the ranges of a plan's two sides would be sampled and joined differently."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlake.operators import candidates, grouping, numbering, results

ROWS = 40_000


def _wide(spark, rows: int = ROWS):
    """Rows in no order: idx and a text of no order to be carried along."""
    return spark.range(rows, numPartitions=8).select((F.col("id") * 7919 % rows).alias("idx"), F.sha2(F.col("id").cast("string"), 512).alias("text"))


def test_numbers_are_places(uneven):
    got = numbering.numbered(_wide(uneven), [F.col("idx").desc()], "nth", first=1)
    assert got.where(F.length("text") == 128).count() == ROWS and got.where((F.col("nth") != ROWS - F.col("idx")) | (F.length("text") != 128)).count() == 0


def _vectors(spark, rows: int):
    """Each vector is equal to the one half the table further and at right angles to all others of its block."""
    at = F.col("idx") % (rows // 2)
    return spark.range(rows, numPartitions=8).select((F.col("id") * 7919 % rows).alias("idx")).withColumn("q", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when((F.shiftright(at, 6) % 64 == i) | (at % 64 == i), 127).otherwise(0)))


def test_blocks_keep_every_vector(uneven):
    got = candidates.vector_pairs(_vectors(uneven, 8192), 1.9)
    assert {(a, b) for a, b, _ in got.collect()} >= {(a, a + 4096) for a in range(4096) if a // 64 != a % 64}


def test_degrees_count_every_vector(uneven):
    pairs = candidates.vector_pairs(_vectors(uneven, 8192), 1.9).select(F.col("idx_a").alias("a"), F.col("idx_b").alias("b"))
    assert grouping.degrees(pairs).where("degree > 0").count() >= 2 * (4096 - 64)


def _log(spark):
    """A session starts at every tenth entry; every fourth is an error; messages are of one shape a severity."""
    seq = F.col("idx")
    return _wide(spark).select(seq.alias("seq"), F.when(seq % 4 == 3, "error").otherwise("info").alias("severity"), F.concat(F.lit("entry "), seq.cast("string"), F.lit(' of "'), "text", F.lit('"')).alias("message"), (seq % 10 == 0).alias("is_session_start"))


def test_log_sessions_are_whole(uneven):
    got = {(r.session, r.severity): (r.n, r.first_seq) for r in results.log_rows(_log(uneven)).collect()}
    want: dict = {}
    for seq in range(ROWS):
        key = seq // 10 + 1, "error" if seq % 4 == 3 else "info"
        n, first = want.get(key, (0, seq))
        want[key] = n + 1, first
    assert got == want


def test_log_filter_finds_every_session(uneven):
    got = {(r.session, r.n) for r in results.log_rows(_log(uneven), severity="error", search="ENTRY 7").collect()}
    errors = [seq for seq in range(ROWS) if seq % 4 == 3]
    hit = {seq // 10 + 1 for seq in errors if str(seq).startswith("7")}
    assert got == {(s, sum(q % 4 == 3 for q in range(s * 10 - 10, s * 10))) for s in hit}
