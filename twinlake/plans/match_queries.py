"""Kernels, candidate joins, grouping and containment over vectors (embeddings), lengths (documents) and timelines (events)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import candidates, explain, grouping, partial, rank, scope, verdict
from ..streaming import rescan
from .adapters import TIMED, adapted, sql, table, timed
from .registry import query

_Q = "SELECT vec_id AS idx, label, list_transform(embedding, lambda x: greatest(-127, least(127, CAST(round_even(CAST(x AS DOUBLE) * 127, 0) AS INT)))) AS q FROM embeddings"
#: The rank of the median decides, as in the kernel: the mean of the 32nd and 33rd of 64 numbers.
_HASH = f"SELECT idx, list_transform(q, lambda x: CAST(x * 2 > list_sort(q)[32] + list_sort(q)[33] AS INT)) AS bits FROM ({_Q})"


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), "label", kernels.quantize(F.col("embedding")).alias("q"))


def _next(df):
    """Each row beside the next one by idx."""
    return candidates.renamed(df, "a").join(candidates.renamed(df, "b"), F.col("idx_a") + 1 == F.col("idx_b"))


@query("p14_quantize", f"SELECT idx, CAST(list_sum(q) AS BIGINT) AS total, CAST(list_min(q) AS INT) AS least, CAST(list_max(q) AS INT) AS most FROM ({_Q})")
def quantize(spark, sf):
    return vectors(spark, sf).select("idx", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_min("q").alias("least"), F.array_max("q").alias("most"))


@query("p13_int8_cosine_pairs", f"WITH v AS ({_Q}) SELECT a.idx AS idx_a, b.idx AS idx_b, CAST(list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[]) AS BIGINT) AS dot FROM v a JOIN v b ON a.idx < b.idx AND CAST(list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[]) AS BIGINT) / 16129::DOUBLE >= 0.3::DOUBLE")
def cosine_pairs(spark, sf):
    return candidates.vector_pairs(vectors(spark, sf), 0.3)


_SAD = f"WITH v AS (SELECT idx, list_transform(q, lambda x: x + 128) AS g FROM ({_Q})) SELECT a.idx, "


def _frames(spark, sf):
    return _next(vectors(spark, sf).select("idx", F.transform("q", lambda x: x + 128).alias("g")))


@query("p01_gray_sad", _SAD + "CAST(list_sum(list_transform(range(1, 65), lambda i: abs(a.g[i] - b.g[i]))) AS BIGINT) AS sad FROM v a JOIN v b ON b.idx = a.idx + 1")
def gray_sad(spark, sf):
    return _frames(spark, sf).select(F.col("idx_a").alias("idx"), kernels.gray_sad(F.col("g_a"), F.col("g_b")).alias("sad"))


@query("p02_masked_difference", _SAD + "list_sum(list_transform(list_filter(range(1, 65), lambda i: a.g[i] > 32 AND b.g[i] > 32 AND a.g[i] < 240 AND b.g[i] < 240), lambda i: abs(a.g[i] - b.g[i])))::DOUBLE / len(list_filter(range(1, 65), lambda i: a.g[i] > 32 AND b.g[i] > 32 AND a.g[i] < 240 AND b.g[i] < 240)) / 256 AS difference FROM v a JOIN v b ON b.idx = a.idx + 1")
def masked(spark, sf):
    return _frames(spark, sf).select(F.col("idx_a").alias("idx"), kernels.masked_difference(F.col("g_a"), F.col("g_b")).alias("difference"))


@query("p03_flip", f"WITH v AS ({_Q}) SELECT idx, array_to_string(list_transform(range(0, 64), lambda i: q[i // 8 * 8 + 7 - i % 8 + 1]), ' ') AS mirrored FROM v")
def flip(spark, sf):
    return vectors(spark, sf).select("idx", F.array_join(kernels.flip(F.col("q"), 8).cast("array<string>"), " ").alias("mirrored"))


@query("f09_dark", f"SELECT idx, len(list_filter(q, lambda x: x + 128 <= 120)) * 100 / 64::DOUBLE AS percent FROM ({_Q})")
def dark(spark, sf):
    # the frames of unit vectors are mid grey, so the level is moved up to exercise both sides
    return vectors(spark, sf).select("idx", kernels.dark_percent(F.transform("q", lambda x: x + 128 - 88)).alias("percent"))


@query("f10_too_dark", f"SELECT idx % 300 AS path, bool_and(len(list_filter(q, lambda x: x + 128 <= 120)) * 100 / 64::DOUBLE >= 30) AS too_dark FROM ({_Q}) GROUP BY 1")
def too_dark(spark, sf):
    # the vectors are the new frames of 300 files; the level is moved up as above, and the percentage to where files differ
    return scope.too_dark(vectors(spark, sf).select((F.col("idx") % 300).alias("path"), F.transform("q", lambda x: x + 128 - 88).alias("gray")), 30)


@query("p04_median_hash", f"SELECT idx, CAST(list_sum(list_transform(range(1, 33), lambda i: bits[i]::BIGINT << (i - 1))) AS BIGINT) AS low, CAST(list_sum(list_transform(range(33, 65), lambda i: bits[i]::BIGINT << (i - 33))) AS BIGINT) AS high FROM ({_HASH})")
def median_hash(spark, sf):
    h = vectors(spark, sf).select("idx", kernels.median_hash(F.col("q")).alias("h"))
    return h.select("idx", F.col("h").bitwiseAND(F.expr("4294967295L")).alias("low"), F.shiftrightunsigned("h", 32).alias("high"))


@query("p05_hash_pairs", f"WITH h AS ({_HASH}) SELECT a.idx AS idx_a, b.idx AS idx_b, CAST(list_sum(list_transform(range(1, 65), lambda i: abs(a.bits[i] - b.bits[i]))) AS BIGINT) AS distance FROM h a JOIN h b ON a.idx < b.idx AND list_sum(list_transform(range(1, 65), lambda i: abs(a.bits[i] - b.bits[i]))) <= 18")
def hash_pairs(spark, sf):
    h = vectors(spark, sf).select("idx", kernels.median_hash(F.col("q")).alias("phash"))
    return candidates.hash_pairs(h, 18).select("idx_a", "idx_b", kernels.hamming(F.col("phash_a"), F.col("phash_b")).cast("long").alias("distance"))


@query("p05_hash_pairs_near", f"WITH h AS ({_HASH}) SELECT a.idx AS idx_a, b.idx AS idx_b FROM h a JOIN h b ON a.idx < b.idx AND list_sum(list_transform(range(1, 65), lambda i: CASE WHEN i <= 40 THEN abs(a.bits[i] - b.bits[i]) ELSE 0 END)) <= 9")
def hash_pairs_near(spark, sf):
    """The pigeonhole join, on the first 40 bits of the hashes so that some are near."""
    h = vectors(spark, sf).select("idx", kernels.median_hash(F.col("q")).bitwiseAND(F.lit((1 << 40) - 1).cast("long")).alias("phash"))
    return candidates.hash_pairs(h, 9).select("idx_a", "idx_b")


@query("p15_sign_distance", f"WITH v AS ({_Q}) SELECT a.idx, CAST(len(list_filter(range(1, 65), lambda i: (a.q[i] < 0) <> (b.q[i] < 0))) AS BIGINT) AS distance FROM v a JOIN v b ON b.idx = a.idx + 1")
def sign_distance(spark, sf):
    df = _next(vectors(spark, sf).select("idx", kernels.sign_bits(F.col("q")).alias("s")))
    return df.select(F.col("idx_a").alias("idx"), kernels.hamming(F.col("s_a"), F.col("s_b")).cast("long").alias("distance"))


#: 384 components in six words: the vector, mirrored, negated, and each moved by one.
_WIDE = "list_concat(list_concat(list_concat(q, list_reverse(q)), list_concat(list_transform(q, lambda x: -x), list_transform(q, lambda x: x - 1))), list_concat(list_transform(q, lambda x: x + 1), list_transform(list_reverse(q), lambda x: 1 - x)))"


@query("p15_signature_words", f"WITH v AS (SELECT idx, {_WIDE} AS w FROM ({_Q})) SELECT a.idx, len(a.w) // 64 AS words, CAST(len(list_filter(range(1, 385), lambda i: (a.w[i] < 0) <> (b.w[i] < 0))) AS BIGINT) AS distance, array_to_string(list_transform(range(0, 6), lambda k: CAST(len(list_filter(range(1, 65), lambda i: a.w[64 * k + i] < 0)) AS VARCHAR)), ' ') AS bits FROM v a JOIN v b ON b.idx = a.idx + 1")
def signature_words(spark, sf):
    moved = lambda c, f: F.transform(c, f)
    q, back = F.col("q"), F.reverse("q")
    wide = F.concat(q, back, moved(q, lambda x: -x), moved(q, lambda x: x - 1), moved(q, lambda x: x + 1), moved(back, lambda x: 1 - x))
    df = _next(vectors(spark, sf).select("idx", kernels.sign_words(wide).alias("s")))
    bits = F.array_join(F.transform("s_a", lambda w: F.bit_count(w).cast("string")), " ")
    return df.select(F.col("idx_a").alias("idx"), F.size("s_a").cast("long").alias("words"), kernels.words_hamming(F.col("s_a"), F.col("s_b")).alias("distance"), bits.alias("bits"))


_FOUR = "list_transform([0, 16, 32, 48], lambda k: CAST(list_sum(list_transform(range(1, 17), lambda i: a.q[k + i] * b.q[k + i])) AS BIGINT))"


@query("p12_mean_cosine", f"WITH v AS ({_Q}) SELECT a.idx, list_sum({_FOUR}) / 4.0::DOUBLE / 16129::DOUBLE AS cosine FROM v a JOIN v b ON b.idx = a.idx + 1")
def mean_cosine(spark, sf):
    four = F.transform(F.array(F.lit(1), F.lit(17), F.lit(33), F.lit(49)), lambda k: F.slice("q", k, 16))
    df = _next(vectors(spark, sf).select("idx", four.alias("v")))
    return df.select(F.col("idx_a").alias("idx"), kernels.mean_cosine(F.col("v_a"), F.col("v_b"), 4).alias("cosine"))


@query("p06_hash_quorum", f"""WITH h AS ({_HASH}), d AS (SELECT a.idx, list_transform([0, 16, 32, 48], lambda k: len(list_filter(range(1, 17), lambda i: a.bits[k + i] <> b.bits[k + i]))) AS d FROM h a JOIN h b ON b.idx = a.idx + 1)
SELECT idx, len(list_filter(d, lambda x: x <= 7)) >= 3 AS similar, CAST(list_sum(d) AS BIGINT) / 256::DOUBLE AS difference FROM d""")
def hash_quorum(spark, sf):
    h = vectors(spark, sf).select("idx", kernels.median_hash(F.col("q")).alias("h"))
    four = F.array(*(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(0xFFFF).cast("long")) for k in (0, 16, 32, 48)))
    ok, mean = kernels.hash_quorum(F.col("hashes_a"), F.col("hashes_b"), 4, 7, 0.6)
    return _next(h.select("idx", four.alias("hashes"))).select(F.col("idx_a").alias("idx"), ok.alias("similar"), mean.alias("difference"))


def _pairs_for_verdict(spark, sf):
    """Four 4x4 frames and 16-bit hashes of each vector, by the median hash of the whole; neighbours are compared."""
    v = vectors(spark, sf).withColumn("h", kernels.median_hash(F.col("q")))
    frames = F.transform(F.array(F.lit(1), F.lit(17), F.lit(33), F.lit(49)), lambda k: F.transform(F.slice("q", k, 16), lambda x: x + 128))
    df = v.select("idx", F.transform(F.array(F.lit(1), F.lit(17), F.lit(33), F.lit(49)), lambda k: F.slice("q", k, 16)).alias("vectors"), frames.alias("frames"), F.array(*(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(0xFFFF).cast("long")) for k in (0, 16, 32, 48))).alias("hashes"))
    return _next(df.withColumn("frames_flip", F.transform("frames", lambda f: kernels.flip(f, 4))).withColumn("hashes_flip", F.col("hashes")))


_M = verdict.Matching(percent=90, positions=4, side=4)
_MEAN = "list_sum(list_transform([0, 16, 32, 48], lambda k: CAST(list_sum(list_transform(range(1, 17), lambda i: abs(a.q[k + i] - b.q[k + i]))) AS BIGINT) / 16 / 256.0::DOUBLE)) / 4"


@query("p07_gray_verdict", f"WITH v AS ({_Q}), d AS (SELECT a.idx, {_MEAN} AS m FROM v a JOIN v b ON b.idx = a.idx + 1) SELECT idx, m <= 0.1 AS similar, CASE WHEN m <= 0.1 THEN m END AS difference, CASE WHEN m <= 0.1 THEN 8 ELSE 0 END AS flags FROM d")
def gray_verdict(spark, sf):
    return verdict.judged(_pairs_for_verdict(spark, sf), _M).select(F.col("idx_a").alias("idx"), "similar", "difference", "flags")


_PAIRS = f"""WITH h AS ({_HASH}), v AS (SELECT q.idx, q.q, h.bits FROM ({_Q}) q JOIN h USING (idx)), x AS (SELECT a.idx, a.q AS qa, b.q AS qb, a.bits AS ha, b.bits AS hb FROM v a JOIN v b ON b.idx = a.idx + 1),
y AS (SELECT idx, list_transform([0, 16, 32, 48], lambda k: CAST(list_sum(list_transform(range(1, 17), lambda i: abs(qa[k + i] - qb[k + i]))) AS BIGINT) / 16 / 256.0::DOUBLE) AS d,
list_transform([0, 16, 32, 48], lambda k: CAST(list_sum(list_transform(range(0, 16), lambda i: abs(qa[k + i // 4 * 4 + 3 - i % 4 + 1] - qb[k + i + 1]))) AS BIGINT) / 16 / 256.0::DOUBLE) AS f,
list_transform([0, 16, 32, 48], lambda k: len(list_filter(range(1, 17), lambda i: ha[k + i] <> hb[k + i]))) AS n,
list_transform([0, 16, 32, 48], lambda k: CAST(list_sum(list_transform(range(1, 17), lambda i: qa[k + i] * qb[k + i])) AS BIGINT)) AS c FROM x),
z AS (SELECT idx, (0.0::DOUBLE + d[1] + d[2] + d[3] + d[4]) / 4 AS g, (0.0::DOUBLE + f[1] + f[2] + f[3] + f[4]) / 4 AS gf, CAST(list_sum(n) AS BIGINT) / 256.0::DOUBLE AS h, len(list_filter(n, lambda b: b <= BITS)) >= 3 AS ph, CAST(list_sum(c) AS BIGINT) / 4.0::DOUBLE / 16129.0::DOUBLE AS m FROM y)"""


def _either(g: str) -> tuple[str, str, str]:
    """similar, difference and flags of grey frames or hashes."""
    return f"({g} <= LIMIT OR ph)", f"CASE WHEN {g} <= LIMIT AND ph THEN least({g}, h) WHEN {g} <= LIMIT THEN {g} ELSE h END", f"CASE WHEN {g} <= LIMIT THEN 8 ELSE 0 END + CASE WHEN ph THEN 16 ELSE 0 END"


def _combined() -> str:
    (plain, d, f), (flip, fd, ff) = _either("g"), _either("gf")
    rows = f"w AS (SELECT idx, {plain} OR m >= 0.1::DOUBLE AS ok, CASE WHEN {plain} THEN {d} WHEN m >= 0.1::DOUBLE THEN 1 - m END AS d, CASE WHEN {plain} THEN {f} WHEN m >= 0.1::DOUBLE THEN 4 ELSE 0 END AS f, {flip} AS ok2, {fd} AS d2, ({ff}) | 1 AS f2 FROM z)"
    use = "ok2 AND (NOT ok OR d2 < d)"
    m = verdict.Matching(percent=92)
    return f"{_PAIRS}, {rows} SELECT idx, ok OR ok2 AS similar, CASE WHEN {use} THEN d2 ELSE d END AS difference, CASE WHEN {use} THEN f2 ELSE f END AS flags FROM w".replace("LIMIT", f"{m.limit!r}::DOUBLE").replace("BITS", str(m.max_bits))


@query("p09_combined_verdict", _combined())
def combined_verdict(spark, sf):
    m = verdict.Matching(percent=92, positions=4, side=4, combine=True, flipped=True, use_ai=True, ai_percent=10)
    return verdict.judged(_pairs_for_verdict(spark, sf), m).select(F.col("idx_a").alias("idx"), "similar", "difference", "flags")


_GATES = f"""WITH v AS ({_Q}), d AS (SELECT a.idx, {_MEAN} <= 0.1 AS content FROM v a JOIN v b ON b.idx = a.idx + 1),
e AS (SELECT idx, (idx % 3 = 0) = ((idx + 1) % 3 = 0) AS kind, idx % 4 * 2 AS fa, (idx + 1) % 4 * 2 AS fb, idx % 3 = 0 OR abs((idx % 50) - ((idx + 1) % 50)) <= least(((idx % 50) + 10) * 0.2::DOUBLE, (((idx + 1) % 50) + 10) * 0.2::DOUBLE) AS duration, content FROM d),
w AS (SELECT idx, kind, ((fa | fb) & ERRORS) = 0 AS errors, duration, content FROM e)
SELECT idx, CASE WHEN kind AND errors AND duration AND content THEN 'match' ELSE 'no match' END AS verdict, CASE WHEN NOT kind THEN 'images never match videos' WHEN NOT errors THEN 'an entry has errors; clear its flags and scan again' WHEN NOT duration THEN 'raise the duration tolerance' WHEN NOT content THEN 'lower the similarity percentage' END AS hint, 5 AS n_gates FROM w""".replace("ERRORS", str(scope.ALL_ERRORS))


@query("d01_explain_pairs", _GATES)
def explain_pairs(spark, sf):
    df = _pairs_for_verdict(spark, sf)
    for side in ("a", "b"):
        i = F.col(f"idx_{side}")
        df = df.withColumns({f"is_image_{side}": i % 3 == 0, f"duration_s_{side}": (i % 50 + 10).cast("double"), f"entry_flags_{side}": (i % 4 * 2).cast("int"), f"folder_{side}": F.concat(F.lit("/m/"), (i % 4).cast("string"))})
    return explain.explain(df, _M, folders="different").select(F.col("idx_a").alias("idx"), "verdict", "hint", F.size("gates").alias("n_gates"))


_T = sql("documents", TIMED)
_TOL = "least(a.duration_s * 0.2::DOUBLE, b.duration_s * 0.2::DOUBLE)"


@query("j04_duration_band", f"WITH t AS (SELECT * FROM ({_T}) WHERE duration_s > 0) SELECT a.idx AS idx_a, b.idx AS idx_b FROM t a JOIN t b ON a.lang = b.lang AND a.idx < b.idx AND abs(a.duration_s - b.duration_s) <= {_TOL}")
def duration_band(spark, sf):
    return candidates.duration_band_ids(timed(spark, sf), keys=("lang",))


@query("j04_duration_band_limits", f"WITH t AS (SELECT * FROM ({_T}) WHERE duration_s > 0) SELECT a.idx AS idx_a, b.idx AS idx_b FROM t a JOIN t b ON a.source = b.source AND a.idx < b.idx AND abs(a.duration_s - b.duration_s) <= least(greatest(a.duration_s * 0.05::DOUBLE, 10::DOUBLE), greatest(b.duration_s * 0.05::DOUBLE, 10::DOUBLE))")
def duration_band_limits(spark, sf):
    return candidates.duration_band(timed(spark, sf).select("idx", "duration_s", "source"), percent=5, least=10, keys=("source",)).select("idx_a", "idx_b")


_CLIPS = f"t AS (SELECT * FROM ({_T}) WHERE duration_s > 0), c AS (SELECT s.idx AS source, k.idx AS clip, s.duration_s AS ds FROM t s JOIN t k ON s.source = k.source AND s.lang = k.lang AND s.duration_s >= 1 AND k.duration_s < s.duration_s * 0.95::DOUBLE AND k.duration_s >= s.duration_s * 0.1::DOUBLE)"


@query("j09_partial_ratio", f"WITH {_CLIPS} SELECT source, clip FROM c")
def partial_ratio(spark, sf):
    return _clips(spark, sf).select("source", "clip")


def _clips(spark, sf):
    return candidates.partial_ratio(timed(spark, sf).withColumn("k", F.concat_ws("/", "source", "lang")).select("idx", "duration_s", "k"), keys=("k",)).select(F.col("idx_src").alias("source"), F.col("idx_clip").alias("clip"), F.col("duration_s_src").alias("ds"))


@query("a04_partial_assignment", f"WITH {_CLIPS} SELECT source, clip FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY ds DESC, source) AS n FROM c) WHERE n = 1")
def partial_assignment(spark, sf):
    return partial.assign(_clips(spark, sf), F.desc("ds")).select("source", "clip")


@query("a05_partial_rows", f"WITH {_CLIPS}, k AS (SELECT source, clip FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY ds DESC, source) AS n FROM c) WHERE n = 1) SELECT DISTINCT source AS group_id, source AS path, 0::DOUBLE AS difference, 0 AS flags, NULL::DOUBLE AS offset_s FROM k UNION ALL SELECT source, clip, 0.25::DOUBLE, 2, 7::DOUBLE FROM k")
def partial_rows(spark, sf):
    return partial.emitted(partial.assign(_clips(spark, sf), F.desc("ds")).withColumns({"sim": F.lit(0.75), "offset_s": F.lit(7)}), verdict.PARTIAL)


@query("j05_equal_content", "SELECT md5(text) AS content, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def equal_content(spark, sf):
    return table(spark, sf, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("content")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


_CODE = "CASE event_type WHEN 'view' THEN 1 WHEN 'signup' THEN 6 WHEN 'purchase' THEN 28 WHEN 'click' THEN 120 ELSE 4294967295 END"
_BLOCKS = f"b AS (SELECT user_id, list({_CODE} ORDER BY ts)::BIGINT[] AS fp FROM events GROUP BY user_id)"


def _timelines(spark, sf):
    code = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "signup", 6).when(F.col("event_type") == "purchase", 28).when(F.col("event_type") == "click", 120).otherwise(F.lit(4294967295)).cast("long")
    return table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", code.alias("c")))), lambda x: x["c"]).alias("fp"))


@query("p19_sliding_window", f"""WITH {_BLOCKS}, p AS (SELECT s.user_id AS source, c.user_id AS clip, s.fp AS l, c.fp AS k FROM b s JOIN b c ON c.user_id = s.user_id + 1 AND len(c.fp) < len(s.fp) AND len(c.fp) >= 2),
o AS (SELECT source, clip, len(k) AS n, unnest(range(0, len(l) - len(k) + 1)) AS off, l, k FROM p),
d AS (SELECT source, clip, n, off, CAST(list_sum(list_transform(range(1, n + 1), lambda i: bit_count(xor(l[off + i], k[i])))) AS BIGINT) AS bits FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY source, clip ORDER BY bits, off) AS nth FROM d)
SELECT source, clip, 1 - bits / (n * 32)::DOUBLE AS sim, off::DOUBLE AS offset_s FROM r WHERE nth = 1 AND bits * 5 <= n * 32 * 3""")
def sliding_window(spark, sf):
    t = _timelines(spark, sf)
    s, c = t.select(F.col("user_id").alias("source"), F.col("fp").alias("audio_fp_src")), t.select(F.col("user_id").alias("clip"), F.col("fp").alias("audio_fp_clip"))
    return partial.audio_matches(s.join(c, F.col("clip") == F.col("source") + 1), num=2, den=5).select("source", "clip", "sim", "offset_s")


@query("p16_sign_prefilter", f"""WITH v AS (SELECT idx // 20 AS path, (idx % 20) * 5 AS t, q, list_transform(q, lambda x: x < 0) AS s FROM ({_Q})),
h AS (SELECT s.path AS source, c.path AS clip, CAST(list_dot_product(s.q::DOUBLE[], c.q::DOUBLE[]) AS BIGINT) / 16129::DOUBLE AS cosine, s.t - c.t AS off FROM v s JOIN v c ON c.path <> s.path AND len(list_filter(range(1, 65), lambda i: s.s[i] <> c.s[i])) <= {kernels.signature_bound(64, 0.3)} AND CAST(list_dot_product(s.q::DOUBLE[], c.q::DOUBLE[]) AS BIGINT) / 16129::DOUBLE >= 0.1::DOUBLE),
r AS (SELECT *, count(*) OVER (PARTITION BY source, clip) AS n, row_number() OVER (PARTITION BY source, clip ORDER BY off) AS r FROM h), m AS (SELECT *, max(CASE WHEN r = n // 2 + 1 THEN off END) OVER (PARTITION BY source, clip) AS median FROM r WHERE n >= 4)
SELECT source, clip, count(*) AS hits, avg(cosine) AS sim, greatest(0, max(median))::DOUBLE AS offset_s FROM m WHERE abs(off - median) <= 30 GROUP BY source, clip HAVING count(*) >= 4""")
def sign_prefilter(spark, sf):
    """Timelines against all others, with the sign bits of vectors as a filter before their products."""
    v = vectors(spark, sf).select(F.floor(F.col("idx") / 20).cast("long").alias("path"), (F.col("idx") % 20 * 5).cast("double").alias("t_sec"), F.col("q").alias("emb"), kernels.sign_bits(F.col("q")).alias("sign"))
    return partial.all_timeline_matches(v, hit=0.1, bits=kernels.signature_bound(64, 0.3))


@query("p20_timeline_matches", f"""WITH v AS (SELECT idx // 20 AS path, (idx % 20) * 5 AS t, q FROM ({_Q})), h AS (SELECT s.path AS source, c.path AS clip, CAST(list_dot_product(s.q::DOUBLE[], c.q::DOUBLE[]) AS BIGINT) / 16129::DOUBLE AS cosine, s.t - c.t AS off FROM v s JOIN v c ON c.path = s.path + 1 AND CAST(list_dot_product(s.q::DOUBLE[], c.q::DOUBLE[]) AS BIGINT) / 16129::DOUBLE >= 0.1::DOUBLE),
r AS (SELECT *, count(*) OVER (PARTITION BY source, clip) AS n, row_number() OVER (PARTITION BY source, clip ORDER BY off) AS r FROM h), m AS (SELECT *, max(CASE WHEN r = n // 2 + 1 THEN off END) OVER (PARTITION BY source, clip) AS median FROM r WHERE n >= 4)
SELECT source, clip, count(*) AS hits, avg(cosine) AS sim, greatest(0, max(median))::DOUBLE AS offset_s FROM m WHERE abs(off - median) <= 30 GROUP BY source, clip HAVING count(*) >= 4""")
def timeline_matches(spark, sf):
    v = vectors(spark, sf).select(F.floor(F.col("idx") / 20).cast("long").alias("path"), (F.col("idx") % 20 * 5).cast("double").alias("t_sec"), F.col("q").alias("emb"), kernels.sign_bits(F.col("q")).alias("sign"))
    paths = v.select(F.col("path").alias("source")).distinct()
    return partial.timeline_matches(paths.withColumn("clip", F.col("source") + 1), v, hit=0.1)


@query("flagship_embedding_groups", f"""WITH RECURSIVE v AS ({_Q}), p AS (SELECT a.idx AS a, b.idx AS b, CAST(list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[]) AS BIGINT) / 16129::DOUBLE AS cosine FROM v a JOIN v b ON a.idx < b.idx AND CAST(list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[]) AS BIGINT) / 16129::DOUBLE >= 0.3::DOUBLE),
e AS (SELECT a, b, cosine FROM p UNION ALL SELECT b, a, cosine FROM p), reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
g AS (SELECT a AS idx, least(a, min(b)) AS group_id FROM reach GROUP BY a), t AS (SELECT a AS idx, max(cosine) AS similarity, count(*) AS partners FROM e GROUP BY a)
SELECT group_id, idx, similarity, partners, row_number() OVER (PARTITION BY group_id ORDER BY partners DESC, similarity DESC, idx) = 1 AS is_best FROM g JOIN t USING (idx)""")
def flagship(spark, sf):
    """Quantise, compare, group, and flag the best of each group."""
    pairs = grouping.checkpoint(candidates.vector_pairs(vectors(spark, sf), 0.3).withColumn("cosine", F.col("dot") / F.lit(16129.0)))
    groups = grouping.components(pairs.select(F.col("idx_a").alias("a"), F.col("idx_b").alias("b")))
    best = pairs.select(F.col("idx_a").alias("node"), "cosine").union(pairs.select("idx_b", "cosine")).groupBy("node").agg(F.max("cosine").alias("similarity"), F.count("*").alias("partners"))
    df = groups.join(best, "node").select(F.col("component").alias("group_id"), F.col("node").alias("idx"), "similarity", "partners")
    return df.withColumn("is_best", F.row_number().over(rank.group().orderBy(F.desc("partners"), F.desc("similarity"), "idx")) == 1)


def _edges(spark, sf):
    pairs = candidates.vector_pairs(vectors(spark, sf), 0.32)
    return pairs.select(F.col("idx_a").alias("a"), F.col("idx_b").alias("b"), (1 - F.col("dot") / F.lit(16129.0)).alias("difference"), F.lit(verdict.AI).alias("flags"), F.lit(True).alias("emitted"), F.lit(True).alias("plain"))


@query("a01_greedy_groups")
def greedy_groups(spark, sf):
    return grouping.groups(_edges(spark, sf), daisy=False)


@query("a02_daisy_split")
def daisy_split(spark, sf):
    return grouping.groups(_edges(spark, sf), daisy=True)


@query("a03_degrees", f"WITH v AS ({_Q}), p AS (SELECT a.idx AS a, b.idx AS b FROM v a JOIN v b ON a.idx < b.idx AND CAST(list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[]) AS BIGINT) / 16129::DOUBLE >= 0.32::DOUBLE) SELECT node, count(*) AS degree FROM (SELECT a AS node FROM p UNION ALL SELECT b FROM p) GROUP BY node")
def degrees(spark, sf):
    return grouping.degrees(_edges(spark, sf))


@query("a14_majority_bits", "WITH e AS (SELECT user_id, hash_bit.i AS bit, count(*) AS n, count(*) FILTER (WHERE (event_id >> hash_bit.i) & 1 = 1) AS ones FROM events, (SELECT unnest(range(0, 16)) AS i) hash_bit GROUP BY 1, 2) SELECT user_id, CAST(sum(CASE WHEN ones >= n // 2 + 1 THEN 1::BIGINT << bit ELSE 0 END) AS BIGINT) AS bits FROM e GROUP BY 1")
def majority_bits(spark, sf):
    e = table(spark, sf, "events")
    ones = [F.sum(F.shiftright("event_id", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(16)]
    total = e.groupBy("user_id").agg(F.count("*").alias("n"), *ones)
    bits = F.lit(0).cast("long")
    for i in range(16):
        bits = bits + F.when(F.col(f"b{i}") >= F.floor(F.col("n") / 2) + 1, F.lit(1 << i)).otherwise(F.lit(0))
    return total.select("user_id", bits.alias("bits"))


@query("a15_bucketed_frames", "SELECT user_id, event_id * 1365 // 11025 AS second, count(*) AS frames FROM events GROUP BY 1, 2")
def bucketed_frames(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", F.floor(F.col("event_id") * 1365 / 11025).cast("long").alias("second")).agg(F.count("*").alias("frames"))


@query("w15_smoothing", "SELECT event_id, (0.25 * lag(value, 4) OVER w + 0.5 * lag(value, 3) OVER w + lag(value, 2) OVER w + 0.5 * lag(value, 1) OVER w + 0.25 * value) / 2.5 AS smooth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts) QUALIFY lag(value, 4) OVER w IS NOT NULL")
def smoothing(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts")
    lag = lambda n: F.lag("value", n).over(w)
    return table(spark, sf, "events").select("event_id", ((0.25 * lag(4) + 0.5 * lag(3) + lag(2) + 0.5 * lag(1) + 0.25 * F.col("value")) / 2.5).alias("smooth")).where("smooth IS NOT NULL")


@query("f11_usable_frames", "SELECT event_id, NOT (value < 20) AND (lag(event_type) OVER w IS NULL OR lag(event_type) OVER w <> event_type) AS usable FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def usable_frames(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("k"), F.col("event_type").alias("raw"), (F.col("value") < 20).alias("dark"))
    return partial.usable_frames(e).select(F.col("k").alias("event_id"), "usable")


@query("f13_silent", f"WITH {_BLOCKS} SELECT user_id, len(fp) > 0 AND len(list_filter(fp, lambda x: x <> 1)) = 0 AS silent FROM b")
def silent(spark, sf):
    return _timelines(spark, sf).select("user_id", kernels.is_silent(F.transform("fp", lambda x: x - 1)).alias("silent"))


@query("t10_hourly", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly(spark, sf):
    return table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("t11_smoothed_rate", "WITH l AS (SELECT user_id, list(value ORDER BY ts, value) AS v FROM events GROUP BY user_id) SELECT user_id, list_reduce(v, lambda s, x: s * 0.5::DOUBLE + x * 0.5::DOUBLE) AS rate FROM l")
def smoothed_rate(spark, sf):
    per = table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "value"))), lambda x: x["value"]).alias("v"))
    return per.select("user_id", rescan.smoothed_rate(F.col("v")).alias("rate"))


@query("j08_hard_links", "SELECT a.l_suppkey AS k, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE NOT (a.l_partkey % 3 = b.l_partkey % 3 AND a.l_suppkey % 2 = b.l_suppkey % 2 AND a.l_quantity = b.l_quantity AND a.l_partkey % 5 = b.l_partkey % 5) GROUP BY 1")
def hard_links(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr("l_orderkey AS o", "l_linenumber AS n", "l_suppkey AS k", "l_partkey % 3 AS size", "l_suppkey % 2 AS st_dev", "l_partkey % 5 AS st_ino", "l_quantity AS duration_s")
    pairs = candidates.renamed(df, "a").join(candidates.renamed(df, "b"), (F.col("o_a") == F.col("o_b")) & (F.col("n_a") < F.col("n_b")))
    return pairs.where(candidates.not_hard_linked()).groupBy(F.col("k_a").alias("k")).agg(F.count("*").alias("n"))


@query("j07_folder_gate", f"WITH t AS ({_T}) SELECT a.lang, count(*) AS n FROM t a JOIN t b ON a.source = b.source AND a.idx < b.idx AND a.lang = b.lang GROUP BY 1")
def folder_gate(spark, sf):
    df = adapted(spark, sf, "documents", TIMED).withColumn("folder", F.concat(F.lit("/M/"), F.upper("source"), F.lit("/"), "lang"))
    pairs = candidates.renamed(df, "a").join(candidates.renamed(df, "b"), (F.col("source_a") == F.col("source_b")) & (F.col("idx_a") < F.col("idx_b")))
    return pairs.where(scope.folder_gate(F.col("folder_a"), F.col("folder_b"), "same", 1)).groupBy(F.col("lang_a").alias("lang")).agg(F.count("*").alias("n"))


@query("p22_sampling_interval", f"SELECT idx, greatest(least(greatest(duration_s / 60, 5), 15), duration_s / 400) AS step FROM ({_T})")
def sampling_interval(spark, sf):
    return adapted(spark, sf, "documents", TIMED).select("idx", kernels.sampling_interval(F.col("duration_s")).alias("step"))


@query("p21_visual_gate", "WITH a AS (SELECT l_orderkey AS source, l_partkey AS clip, avg(l_discount * 10) AS m FROM lineitem WHERE l_linenumber > 1 GROUP BY 1, 2), k AS (SELECT DISTINCT l_orderkey AS source, l_partkey AS clip FROM lineitem) SELECT k.source, k.clip FROM k LEFT JOIN a USING (source, clip) WHERE a.m IS NULL OR a.m >= 0.45::DOUBLE")
def visual_gate(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("clip"), "l_linenumber", (F.col("l_discount") * 10).alias("similarity"))
    return partial.visually_gated(li.select("source", "clip").distinct(), li.where("l_linenumber > 1"), 0.45)
