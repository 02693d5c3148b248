"""Ranking, selection and result lists over items (groups of lineitem)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import explain, rank, results, verdict
from ..sources import sinks
from .adapters import ITEMS_SQL, items, table
from .registry import query

_W = "OVER (PARTITION BY group_id)"


@query("w01_best_flags", f"""{ITEMS_SQL} SELECT group_id, seq, size = min(size) {_W} AS is_best_size, duration_s = max(duration_s) {_W} AND NOT is_image AS is_best_duration,
frame_size_int = max(frame_size_int) {_W} AS is_best_frame_size, fps = max(fps) {_W} AND NOT is_image AS is_best_fps, bitrate_kbs = max(bitrate_kbs) {_W} AND NOT is_image AS is_best_bitrate_kbs,
audio_bitrate_kbs = max(audio_bitrate_kbs) {_W} AND NOT is_image AS is_best_audio_bitrate_kbs, hdr_rank = max(hdr_rank) {_W} AND NOT is_image AS is_best_hdr_format FROM items""")
def best_flags(spark, sf):
    return rank.best_flags(items(spark, sf)).select("group_id", "seq", *rank.BEST)


def _cascade_sql(rows: str, steps: list[tuple[str, str, bool, bool, str]]) -> str:
    """CTEs that run the keeper cascade over the rows of a relation, a step (name, value, video only, less is better, tie of a and b)
    each; the last is ``cascade`` with is_keeper and decided_by."""
    out, at = [f"k0 AS (SELECT *, true AS alive, min(seq) {_W} AS keep, CAST(NULL AS VARCHAR) AS decided_by FROM {rows})"], "k0"
    for i, (name, value, videos, least, ties) in enumerate(steps):
        sign = "-" if least else ""
        runs = "n > 1 AND NOT image" if videos else "n > 1"
        out.append(f"v{i} AS (SELECT * EXCLUDE (value), value AS b_own, count(*) FILTER (WHERE alive) {_W} AS n, bool_or(is_image AND seq = keep) {_W} AS image, first_value(seq) OVER o AS best_seq, first_value(value) OVER o AS b FROM (SELECT *, {value} AS value FROM {at}) WINDOW o AS (PARTITION BY group_id ORDER BY alive DESC, {sign}value DESC, seq))")
        out.append(f"t{i} AS (SELECT *, alive AND ({ties.replace('$a', 'b_own').replace('$b', 'b')}) AS tied FROM v{i})")
        out.append(f"l{i} AS (SELECT *, count(*) FILTER (WHERE tied) {_W} AS still, {runs} AS runs FROM t{i})")
        out.append(f"k{i + 1} AS (SELECT * EXCLUDE (alive, keep, decided_by, b_own, n, image, best_seq, b, tied, still, runs), CASE WHEN runs THEN tied OR (still <= 1 AND seq = best_seq) ELSE alive END AS alive, CASE WHEN runs THEN best_seq ELSE keep END AS keep, coalesce(decided_by, CASE WHEN runs AND still <= 1 THEN '{name}' END) AS decided_by FROM l{i})")
        at = f"k{i + 1}"
    return ", ".join([*out, f"cascade AS (SELECT *, seq = keep AS is_keeper FROM {at})"])


def _near(share: float) -> str:
    return f"abs($a - $b) <= greatest($a, $b) * CAST({share} AS DOUBLE)"


_EQUAL = "$a = $b"
_PIXELS = "(CAST(width AS DOUBLE) * height * fps)"
_STEPS = [
    ("Duration", "duration_s", True, False, f"abs($a - $b) <= 1 OR {_near(0.01)}"),
    ("Resolution", "frame_size_int", False, False, _EQUAL),
    ("Bitrate", "bitrate_kbs", True, False, _near(0.05)),
    ("FPS", "fps", True, False, "abs($a - $b) <= CAST(0.5 AS DOUBLE)"),
    ("Bits per pixel", f"CASE WHEN bitrate_kbs > 0 AND {_PIXELS} > 0 THEN bitrate_kbs * 1000 / {_PIXELS} ELSE CAST(0 AS DOUBLE) END", True, False, _near(0.05)),
    ("Audio Bitrate", "audio_bitrate_kbs", True, False, _near(0.05)),
    ("Size", "size", False, True, _EQUAL),
]
_WEB_STEPS = [("Duration", "duration_s", True, False, _EQUAL), ("Resolution", "frame_size_int", False, False, _EQUAL), ("Bitrate", "bitrate_kbs", True, False, _EQUAL), ("FPS", "fps", True, False, _EQUAL), ("Audio Bitrate", "sample_rate", True, False, _EQUAL), ("Size", "size", False, True, _EQUAL)]


@query("w02_keeper_cascade", f"{ITEMS_SQL}, {_cascade_sql('items', _STEPS)} SELECT group_id, seq, is_keeper, decided_by FROM cascade")
def keeper_cascade(spark, sf):
    return rank.keepers(items(spark, sf), list(rank.criteria().values())).select("group_id", "seq", "is_keeper", "decided_by")


#: A lexicographic cascade without tolerances, over videos only (SQL can say that much of a cascade).
@query("w03_keeper_exact", f"{ITEMS_SQL} SELECT group_id, seq, row_number() OVER (PARTITION BY group_id ORDER BY duration_s DESC, frame_size_int DESC, bitrate_kbs DESC, fps DESC, sample_rate DESC, size, seq) = 1 AS is_keeper FROM items WHERE NOT is_image")
def keeper_exact(spark, sf):
    return rank.keepers(items(spark, sf).where("NOT is_image"), rank.web_criteria()).select("group_id", "seq", "is_keeper")


@query("w04_bits_per_pixel", f"{ITEMS_SQL} SELECT group_id, seq, bitrate_kbs * 1000 / (CAST(width AS DOUBLE) * height * fps) AS bits_per_pixel FROM items")
def bits_per_pixel(spark, sf):
    return items(spark, sf).select("group_id", "seq", rank.bits_per_pixel().alias("bits_per_pixel"))


def _strategy_sql(order: str, more: str = "") -> str:
    return f"""{ITEMS_SQL}, flagged AS (SELECT *, bitrate_kbs = max(bitrate_kbs) {_W} AND NOT is_image AS best_rate, frame_size_int = max(frame_size_int) {_W} AS best_frame FROM items),
has AS (SELECT *, max(CAST(best_rate AS INT)) {_W} AS some_rate FROM flagged)
SELECT group_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {order}, seq) AS nth, count(*) {_W} AS n, min(similarity) {_W} AS least FROM has) WHERE n >= 2 AND nth > 1 {more}"""


_QUALITY = "CASE WHEN some_rate = 1 THEN CAST(best_rate AS INT) ELSE CAST(best_frame AS INT) END DESC"
for _name, _order, _more in (("lowest-quality", _QUALITY, ""), ("smallest-file", "size DESC", ""), ("shortest-duration", "duration_s DESC", ""), ("worst-resolution", "frame_size_int DESC", ""), ("100-percent-only", _QUALITY, "AND least >= 100")):

    @query(f"w05_delete_{_name.replace('-', '_')}", _strategy_sql(_order, _more))
    def _delete(spark, sf, name=_name):
        return rank.deletions(items(spark, sf), name).select("group_id", "seq")


for _mode, _order, _more in (("SmallestFile", "size DESC", ""), ("Oldest", "date_created DESC", ""), ("Newest", "date_created", ""), ("HundredPercentEqual", "seq", "AND least >= 100")):

    @query(f"w06_auto_{_mode.lower()}", f"{ITEMS_SQL} SELECT group_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {_order}, seq) AS nth, count(*) {_W} AS n, min(similarity) {_W} AS least FROM items) WHERE nth > 1 AND n >= 2 {_more}")
    def _auto(spark, sf, mode=_mode):
        return rank.auto_select(items(spark, sf), mode).select("group_id", "seq")


@query("w06_auto_lowestquality", f"{ITEMS_SQL}, {_cascade_sql('items', _WEB_STEPS)} SELECT group_id, seq FROM (SELECT *, count(*) {_W} AS members FROM cascade) WHERE NOT is_keeper AND members >= 2")
def auto_lowest(spark, sf):
    return rank.auto_select(items(spark, sf), "LowestQuality").select("group_id", "seq")


_CLASS = {k: ", ".join(["group_id", *v]) for k, v in rank.EQUALITY.items()}


def _select_sql(kind: str, order: str) -> str:
    c = _CLASS[kind]
    return f"""{ITEMS_SQL}, c AS (SELECT *, min(seq) OVER (PARTITION BY {c}) AS class_seq, count(*) OVER (PARTITION BY {c}) AS class_size, min(seq) {_W} AS first_seq FROM items)
SELECT group_id, seq, CASE WHEN class_seq = first_seq AND class_size > 1 THEN row_number() OVER (PARTITION BY group_id, class_seq ORDER BY {order}, seq) > 1 ELSE checked END AS checked_after FROM c"""


for _cmd, _kind, _order in (("identical", "full", "seq"), ("identical-but-size", "but_size", "size"), ("oldest", "but_size", "date_created DESC"), ("newest", "but_size", "date_created")):

    @query(f"w07_select_{_cmd.replace('-', '_')}", _select_sql(_kind, _order))
    def _select(spark, sf, cmd=_cmd):
        return rank.selection(items(spark, sf), cmd).select("group_id", "seq", "checked_after")


@query("w07_select_lowest_quality", f"""{ITEMS_SQL}, c AS (SELECT *, min(seq) OVER (PARTITION BY {_CLASS["but_size"]}) AS class_seq, count(*) OVER (PARTITION BY {_CLASS["but_size"]}) AS class_size, min(seq) {_W} AS first_seq FROM items),
inside AS (SELECT * FROM c WHERE class_seq = first_seq AND class_size > 1), {_cascade_sql("inside", _STEPS)}
SELECT c.group_id, c.seq, CASE WHEN k.is_keeper IS NULL THEN c.checked ELSE NOT k.is_keeper END AS checked_after FROM c LEFT JOIN cascade k USING (group_id, seq)""")
def select_lowest(spark, sf):
    return rank.selection(items(spark, sf), "lowest-quality").select("group_id", "seq", "checked_after")


@query("w08_equality_class", f"{ITEMS_SQL} SELECT group_id, seq, min(seq) OVER (PARTITION BY {_CLASS['length']}) AS class_seq, count(*) OVER (PARTITION BY {_CLASS['length']}) AS class_size FROM items")
def equality_class(spark, sf):
    return rank.equality_class(items(spark, sf), "length").select("group_id", "seq", "class_seq", "class_size")


@query("w09_custom_selection", f"""{ITEMS_SQL}, c AS (SELECT *, size > 3000000 AND similarity >= 95 AS hit, max(CAST(checked AS INT)) {_W} = 1 AS busy, count(*) {_W} AS class_size FROM items),
d AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY CAST(hit AS INT) DESC, date_created DESC, seq) AS nth FROM c)
SELECT group_id, seq, CASE WHEN hit AND NOT busy AND class_size > 1 AND nth <> 1 THEN true ELSE checked END AS checked_after FROM d""")
def custom_selection(spark, sf):
    return rank.custom_selection(items(spark, sf), (F.col("size") > 3000000) & (F.col("similarity") >= 95), "group", keep_newest=True).select("group_id", "seq", "checked_after")


@query("w10_expression_groups", f"{ITEMS_SQL} SELECT group_id, count(*) FILTER (WHERE size > 2000000 AND fps < 28) AS hits, count(*) AS members, CASE WHEN count(*) FILTER (WHERE size > 2000000 AND fps < 28) = 0 THEN 'none' WHEN count(*) FILTER (WHERE size > 2000000 AND fps < 28) = count(*) THEN 'whole' ELSE 'part' END AS match FROM items GROUP BY group_id")
def expression_groups(spark, sf):
    df = items(spark, sf)
    return rank.expression_groups(df, explain.expression(df, "size > 2000000 AND fps < 28"))


@query("w11_deltas", f"{ITEMS_SQL} SELECT group_id, seq, (size - min(size) {_W}) / CAST(min(size) {_W} AS DOUBLE) * 100 AS size_delta, (bitrate_kbs - max(bitrate_kbs) {_W}) / CAST(max(bitrate_kbs) {_W} AS DOUBLE) * 100 AS bitrate_kbs_delta FROM items")
def deltas(spark, sf):
    return rank.deltas(items(spark, sf), {"size": True, "bitrate_kbs": False}).select("group_id", "seq", "size_delta", "bitrate_kbs_delta")


@query("w12_hdr_upgrade", f"{ITEMS_SQL} SELECT group_id, seq, hdr_rank > min(hdr_rank) {_W} AS is_hdr_upgrade FROM items")
def hdr_upgrade(spark, sf):
    return rank.hdr_upgrades(items(spark, sf)).select("group_id", "seq", "is_hdr_upgrade")


_HEAD = """SELECT group_id, count(*) AS file_count, sum(greatest(size, 0)) AS total_bytes, sum(greatest(size, 0)) - max(greatest(size, 0)) AS wasted_bytes, max(greatest(size, 0)) AS largest, min(similarity) AS similarity_min, max(similarity) AS similarity_max,
count(*) FILTER (WHERE file_exists) AS on_disk, bool_or(NOT file_exists AND root_ready) AS has_tombstone, bool_or(NOT root_ready) AS has_offline, bool_or(checked) AS has_checked, bool_or((flags & 8) <> 0) AS has_grayscale, bool_or((flags & 16) <> 0) AS has_phash,
max(date_created) AS newest, max(duration_s) AS longest, max(frame_size_int) AS largest_frame, arg_min(path, seq) AS first_path FROM items GROUP BY group_id"""


@query("a08_group_headers", f"{ITEMS_SQL} SELECT * REPLACE (CAST(total_bytes AS BIGINT) AS total_bytes, CAST(wasted_bytes AS BIGINT) AS wasted_bytes) FROM ({_HEAD})")
def group_headers(spark, sf):
    return results.headers(items(spark, sf))


@query("w13_group_numbers", f"{ITEMS_SQL} SELECT group_id, row_number() OVER (ORDER BY wasted_bytes DESC, group_id) AS group_no FROM ({_HEAD})")
def group_numbers(spark, sf):
    return results.numbered(results.headers(items(spark, sf)), "WastedSpace").select("group_id", "group_no")


@query("w14_chips", f"""{ITEMS_SQL}, b AS (SELECT *, lag(size) OVER w AS bs, lag(fps) OVER w AS bf FROM items WINDOW w AS (PARTITION BY group_id ORDER BY seq))
SELECT group_id, seq, CASE WHEN bs IS NULL OR size = bs THEN 'neutral' WHEN size < bs THEN 'better' ELSE 'worse' END AS size_chip, CASE WHEN bf IS NULL OR fps = bf THEN 'neutral' WHEN fps > bf THEN 'better' ELSE 'worse' END AS fps_chip FROM b""")
def chips(spark, sf):
    return rank.chips(items(spark, sf), {"size": True, "fps": False}).select("group_id", "seq", "size_chip", "fps_chip")


_DECISION = "CASE CAST(floor(size / 7) AS BIGINT) % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' END"


@query("w14_culling", f"""{ITEMS_SQL}, n AS (SELECT group_id, seq, checked, row_number() OVER o AS nth, CASE WHEN row_number() OVER o > 1 THEN {_DECISION} END AS d FROM items WINDOW o AS (PARTITION BY group_id ORDER BY seq)),
m AS (SELECT r.group_id, r.nth, r.seq, r.d, max(l.nth) AS standing FROM n r JOIN n l ON l.group_id = r.group_id AND l.nth < r.nth AND (l.nth = 1 OR l.d = 'right') GROUP BY ALL),
e AS (SELECT group_id, nth, nth AS step, d = 'left' AS mark FROM m WHERE d IS NOT NULL UNION ALL SELECT group_id, standing, nth, d = 'right' FROM m WHERE d IS NOT NULL),
f AS (SELECT group_id, nth, arg_max(mark, step) AS mark FROM e GROUP BY ALL)
SELECT n.group_id, n.seq, l.seq AS left_seq, coalesce(f.mark, n.checked) AS checked_after FROM n LEFT JOIN f USING (group_id, nth) LEFT JOIN m USING (group_id, nth) LEFT JOIN n l ON l.group_id = m.group_id AND l.nth = m.standing""")
def culling(spark, sf):
    return rank.culled(items(spark, sf).withColumn("decision", F.expr(_DECISION))).select("group_id", "seq", "left_seq", "checked_after")


#: An order's lines as the streams of a file.
_STREAM = {
    "codec_name": "CASE WHEN l_partkey % 10 > 0 THEN concat('c', l_suppkey % 9) END",
    "codec_type": "CASE l_partkey % 3 WHEN 0 THEN 'Video' WHEN 1 THEN 'audio' ELSE 'subtitle' END",
    "width": "CAST(640 + 320 * (l_partkey % 4) AS INT)",
    "height": "CAST(360 + 180 * (l_suppkey % 3) AS INT)",
    "sample_rate": "CAST(44100 + l_partkey % 2 * 3900 AS INT)",
    "channel_layout": "CASE WHEN l_suppkey % 4 > 0 THEN 'stereo' END",
    "bit_rate": "l_partkey * 137 + l_suppkey * 500",
    "frame_rate": "CAST(24 + l_linenumber % 7 AS FLOAT)",
    "channels": "CAST(l_suppkey % 3 AS INT)",
    "hdr_format": "CASE l_suppkey % 3 WHEN 0 THEN 'HDR10' WHEN 1 THEN '' END",
}


@query("f19_projection", f"""WITH s AS (SELECT l_orderkey AS k, {', '.join(f'{e} AS {c}' for c, e in _STREAM.items())}, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nth FROM lineitem),
v AS (SELECT * FROM s WHERE lower(codec_type) = 'video' AND k % 7 > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY width * height DESC, nth) = 1),
a AS (SELECT * FROM s WHERE lower(codec_type) = 'audio' AND k % 7 > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY channels DESC, nth) = 1),
w AS (SELECT k, width, height FROM v UNION ALL SELECT k, width, height FROM s WHERE nth = 1 AND k % 7 = 0), e AS (SELECT DISTINCT k FROM s)
SELECT e.k AS group_id, concat(w.width, 'x', w.height) AS frame_size, coalesce(w.width + w.height, 0) AS frame_size_int, CASE WHEN e.k % 7 = 0 THEN 'Jpg' WHEN v.k IS NOT NULL THEN coalesce(v.codec_name, '<Unknown>') END AS format, coalesce(v.frame_rate, 0)::DOUBLE AS fps, coalesce(CAST(round_even(v.bit_rate / 1000::DOUBLE, 0) AS BIGINT), 0) AS bitrate_kbs,
CASE WHEN a.k IS NOT NULL THEN coalesce(a.codec_name, '<Unknown>') END AS audio_format, CASE WHEN a.k IS NOT NULL THEN coalesce(a.channel_layout, '<Unknown>') END AS audio_channel, coalesce(a.sample_rate, 0) AS sample_rate, coalesce(CAST(round_even(a.bit_rate / 1000::DOUBLE, 0) AS BIGINT), 0) AS audio_bitrate_kbs, CASE WHEN v.k IS NOT NULL THEN coalesce(v.hdr_format, '') END AS hdr_format, CASE WHEN v.hdr_format = 'HDR10' THEN 2 ELSE 0 END AS hdr_rank, CASE WHEN e.k % 7 > 0 THEN 90.5 ELSE 0 END::DOUBLE AS duration_s, 75::DOUBLE AS similarity
FROM e LEFT JOIN v USING (k) LEFT JOIN a USING (k) LEFT JOIN w USING (k)""".replace("concat(w.width, 'x', w.height)", "CASE WHEN w.k IS NOT NULL THEN concat(w.width, 'x', w.height) END"))
def projection(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.struct(*(F.expr(e).alias(c) for c, e in _STREAM.items())).alias("stream"))
    files = lines.groupBy(F.col("l_orderkey").alias("group_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "stream"))), lambda x: x["stream"]).alias("streams"))
    image = F.col("group_id") % 7 == 0
    path = F.concat(F.lit("/f.d/"), F.col("group_id").cast("string"), F.when(image, ".Jpg").otherwise(".mkv"))
    members = files.withColumns({"path": path, "folder": F.lit("/f.d"), "size": F.lit(1).cast("long"), "is_image": image, "duration_s": F.lit(90.5), "date_created": F.lit(None).cast("timestamp"), "difference": F.lit(0.25), "match_flags": F.lit(8)})
    rows = results.projected(members).withColumns({c: F.col(c).cast("long") for c in ("bitrate_kbs", "audio_bitrate_kbs")})
    return rows.select("group_id", "frame_size", "frame_size_int", "format", "fps", "bitrate_kbs", "audio_format", "audio_channel", "sample_rate", "audio_bitrate_kbs", "hdr_format", "hdr_rank", "duration_s", "similarity")


@query("w18_invert_visible", f"{ITEMS_SQL} SELECT group_id, seq, CASE WHEN size > 2000000 THEN NOT checked ELSE checked END AS checked_after FROM items")
def invert_visible(spark, sf):
    return rank.toggles(items(spark, sf), F.col("size") > 2000000, "invert").select("group_id", "seq", "checked_after")


@query("w18_check_missing", f"{ITEMS_SQL} SELECT group_id, seq, checked OR NOT file_exists AS checked_after FROM items")
def check_missing(spark, sf):
    return rank.toggles(items(spark, sf), F.lit(True), "missing").select("group_id", "seq", "checked_after")


for _mode, _key in results.SORTS.items():

    @query(f"o01_sort_{_mode.lower()}", f"{ITEMS_SQL} SELECT group_id, row_number() OVER (ORDER BY {'lower(first_path)' if _mode == 'FolderPath' else _key} DESC, group_id) AS group_no FROM ({_HEAD})")
    def _sorted(spark, sf, mode=_mode):
        return results.numbered(results.headers(items(spark, sf)), mode).select("group_id", "group_no")


@query("o02_member_sort_best_first", f"{ITEMS_SQL} SELECT group_id, seq, row_number() OVER (PARTITION BY group_id ORDER BY best DESC, size DESC, seq) AS nth FROM (SELECT *, CAST(size = min(size) {_W} AS INT) AS best FROM items)")
def member_sort(spark, sf):
    return results.member_order(rank.best_flags(items(spark, sf)), "size", best_first=F.col("is_best_size")).select("group_id", "seq", F.col("nth").cast("long").alias("nth"))


@query("o03_member_sort_name", f"{ITEMS_SQL} SELECT group_id, seq, row_number() OVER (PARTITION BY group_id ORDER BY lower(path), seq) AS nth FROM items")
def member_sort_name(spark, sf):
    return results.member_order(items(spark, sf), "name", descending=False).select("group_id", "seq", F.col("nth").cast("long").alias("nth"))


@query("f15_results_filter", f"""{ITEMS_SQL}, h AS (SELECT *, max(CAST(regexp_matches(path, '(?i)lib3.*_2') AS INT)) {_W} = 1 AS hit, max(CAST(checked AS INT)) {_W} = 1 AS any_checked FROM items), k AS (SELECT * FROM h WHERE hit AND any_checked AND NOT is_image AND similarity BETWEEN 93 AND 100)
SELECT group_id, seq FROM (SELECT *, count(*) {_W} AS n FROM k) WHERE n >= 2""")
def results_filter(spark, sf):
    return results.visible(items(spark, sf), "lib3*_2", "video", (93, 100), checked_groups=True).select("group_id", "seq")


@query("f16_hit_groups", f"{ITEMS_SQL} SELECT group_id, seq FROM items WHERE group_id IN (SELECT group_id FROM items WHERE contains(lower(path), '_77.mp4'))")
def hit_groups(spark, sf):
    return results.hit_groups(items(spark, sf), "_77.MP4").select("group_id", "seq")


@query("f18_criteria", f"{ITEMS_SQL} SELECT group_id, seq FROM items WHERE NOT is_image AND size // 1048576 BETWEEN 1 AND 4 AND regexp_matches(path, '(?i)^.*lib2.*$') AND NOT regexp_matches(path, '(?i)^.*_9[.]mp4$') AND similarity BETWEEN 95 AND 100")
def criteria_filter(spark, sf):
    keep = ~F.col("is_image") & text.megabytes(F.col("size")).between(1, 4) & text.matches_any(F.col("path"), ["*lib2*"]) & ~text.matches_any(F.col("path"), ["*_9.mp4"]) & F.col("similarity").between(95, 100)
    return items(spark, sf).where(keep).select("group_id", "seq")


@query("f26_expression", f"{ITEMS_SQL} SELECT group_id, seq FROM items WHERE size > 2500000 AND (fps >= 29 OR NOT is_image) AND path LIKE '%/p1%'")
def user_expression(spark, sf):
    df = items(spark, sf)
    return df.where(explain.expression(df, "size > 2500000 AND (fps >= 29 OR NOT is_image) AND path LIKE '%/p1%'")).select("group_id", "seq")


@query("a06_statistics", f'{ITEMS_SQL} SELECT count(*) AS "groups", CAST(sum(n) AS BIGINT) AS items, avg(n) AS mean, max(n) AS largest, count(*) FILTER (WHERE n > 5) AS over_5, count(*) FILTER (WHERE n > 10) AS over_10 FROM (SELECT group_id, count(*) AS n FROM items GROUP BY group_id)')
def statistics(spark, sf):
    return results.statistics(items(spark, sf))


@query("a07_totals", f'{ITEMS_SQL} SELECT CAST(sum(n) AS BIGINT) AS items, count(*) AS "groups", CAST(sum(b) AS BIGINT) AS total_bytes, CAST(sum(b - m) AS BIGINT) AS savings FROM (SELECT group_id, count(*) AS n, sum(greatest(size, 0)) AS b, max(greatest(size, 0)) AS m FROM items GROUP BY group_id)')
def totals(spark, sf):
    return results.totals(items(spark, sf))


@query("a09_visible_groups", f"{ITEMS_SQL} SELECT group_id, seq FROM (SELECT *, count(*) {_W} AS n FROM items WHERE file_exists) WHERE n >= 2")
def visible_groups(spark, sf):
    return results.visible(items(spark, sf).where("file_exists")).select("group_id", "seq")


@query("a10_contributions", f"{ITEMS_SQL} SELECT count(*) FILTER (WHERE (flags & 24) = 24) AS both, count(*) FILTER (WHERE (flags & 24) = 8) AS gray_only, count(*) FILTER (WHERE (flags & 24) = 16) AS phash_only FROM items")
def contributions(spark, sf):
    return results.contributions(items(spark, sf))


@query("a12_checked_summary", f"{ITEMS_SQL} SELECT count(*) AS checked, CAST(sum(greatest(size, 0)) AS BIGINT) AS checked_bytes, count(DISTINCT group_id) AS groups_with_checked FROM items WHERE checked")
def checked_summary(spark, sf):
    return results.checked_summary(items(spark, sf))


@query("a16_all_equal", f"{ITEMS_SQL} SELECT group_id, count(DISTINCT fps) <= 1 AS fps_equal, count(DISTINCT sample_rate) <= 1 AS sample_rate_equal FROM items GROUP BY group_id")
def all_equal(spark, sf):
    return results.all_equal(items(spark, sf), ["fps", "sample_rate"])


@query("a17_redownloads", f"{ITEMS_SQL} SELECT group_id, seq FROM (SELECT *, max(CAST(NOT file_exists AND root_ready AS INT)) {_W} AS t FROM items) WHERE t = 1 AND file_exists")
def redownloads(spark, sf):
    return results.redownloads(items(spark, sf)).select("group_id", "seq")


@query("a18_drop_hard_links", f"{ITEMS_SQL}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id, st_dev, st_ino % 3 ORDER BY seq) AS nth FROM items) WHERE nth = 1) SELECT group_id, seq FROM (SELECT *, count(*) {_W} AS n FROM k) WHERE n >= 2")
def drop_hard_links(spark, sf):
    return results.drop_hard_links(items(spark, sf).withColumns({"size": F.lit(1), "st_ino": F.col("st_ino") % 3})).select("group_id", "seq")


@query("j14_blacklist", f"""{ITEMS_SQL}, bl AS (SELECT DISTINCT group_id % 500 AS bl_id, path FROM items WHERE group_id % 4 < 3 AND NOT (group_id % 8 = 1 AND seq % 5 = 0)),
m AS (SELECT DISTINCT group_id, path FROM items), t AS (SELECT group_id, count(*) AS n FROM m GROUP BY group_id),
cov AS (SELECT m.group_id, bl_id, count(*) AS k FROM m JOIN bl USING (path) GROUP BY 1, 2), gone AS (SELECT DISTINCT group_id FROM cov JOIN t USING (group_id) WHERE k = n)
SELECT group_id, seq FROM items WHERE group_id NOT IN (SELECT group_id FROM gone)""")
def blacklist(spark, sf):
    df = items(spark, sf)
    sets = df.where("group_id % 4 < 3 AND NOT (group_id % 8 = 1 AND seq % 5 = 0)").groupBy((F.col("group_id") % 500).alias("bl_id")).agg(F.collect_set("path").alias("paths"))
    return results.drop_blacklisted(df, sets).select("group_id", "seq")


@query("j15_prune_blacklist", f"{ITEMS_SQL} SELECT bl_id FROM (SELECT group_id AS bl_id, bool_and(file_exists) AS whole FROM items GROUP BY 1) WHERE whole")
def prune_blacklist(spark, sf):
    df = items(spark, sf)
    return results.prune_blacklist(df.groupBy(F.col("group_id").alias("bl_id")).agg(F.collect_set("path").alias("paths")), df.where("file_exists")).select("bl_id")


@query("k10_cleanup_report", f'{ITEMS_SQL} SELECT * FROM (SELECT group_id, count(*) FILTER (WHERE checked) AS remove, count(*) FILTER (WHERE NOT checked) AS keep, CAST(coalesce(sum(CASE WHEN checked THEN greatest(size, 0) END), 0) AS BIGINT) AS savings FROM items GROUP BY group_id) WHERE remove > 0')
def cleanup_report(spark, sf):
    return results.cleanup_report(items(spark, sf))


@query("k11_link_plan", f"""{ITEMS_SQL}, k AS (SELECT group_id, arg_max(path, {{'a': size, 'b': -seq}}) AS target FROM (SELECT * FROM items WHERE NOT checked) GROUP BY group_id)
SELECT i.group_id, i.path, 'hardlink' AS action, k.target FROM items i JOIN k USING (group_id) WHERE checked""")
def link_plan(spark, sf):
    return results.action_plan(items(spark, sf), "hardlink")


@query("k11_move_plan", f"{ITEMS_SQL} SELECT group_id, path, 'move' AS action, concat('/out/', regexp_extract(path, '[^/]*$')) AS target FROM items WHERE checked")
def move_plan(spark, sf):
    return results.action_plan(items(spark, sf), "move", "/out/")


@query("k04_result_rows", f"""{ITEMS_SQL} SELECT CAST(group_id AS VARCHAR) AS group_id, path, CAST(size AS VARCHAR) AS size, printf('%.2f', similarity) AS similarity, printf('%02d:%02d:%02d', CAST(duration_s AS BIGINT) // 3600, CAST(duration_s AS BIGINT) % 3600 // 60, CAST(duration_s AS BIGINT) % 60) AS duration,
concat(width, 'x', height) AS frame_size, printf('%.2f', fps) AS fps, CAST(bitrate_kbs AS VARCHAR) AS bitrate_kbs, strftime(date_created, '%Y-%m-%d %H:%M:%S') AS date_created, CASE WHEN checked THEN 'true' ELSE 'false' END AS checked FROM items""")
def result_rows(spark, sf):
    return sinks.result_rows(items(spark, sf))


@query("k05_export_rows", f"""{ITEMS_SQL} SELECT CAST(group_id AS VARCHAR) AS "GroupId", path AS "Path", CAST(size AS VARCHAR) AS "SizeBytes", printf('%02d:%02d:%02d', CAST(duration_s AS BIGINT) // 3600, CAST(duration_s AS BIGINT) % 3600 // 60, CAST(duration_s AS BIGINT) % 60) AS "Duration", concat(width, 'x', height) AS "Resolution",
CAST(CAST(fps AS BIGINT) AS VARCHAR) AS "Fps", CAST(bitrate_kbs AS VARCHAR) AS "BitrateKbs", CASE WHEN is_image THEN '' ELSE 'aac' END AS "AudioFormat", CAST(sample_rate AS VARCHAR) AS "AudioSampleRate", CAST(CAST(similarity AS BIGINT) AS VARCHAR) AS "Similarity", strftime(date_created, '%Y-%m-%d %H:%M:%S') AS "DateCreated", CASE WHEN is_image THEN 'True' ELSE 'False' END AS "IsImage", CASE WHEN checked THEN 'True' ELSE 'False' END AS "Checked" FROM items""")
def export_rows(spark, sf):
    return sinks.export_rows(items(spark, sf).withColumn("audio_format", F.when(~F.col("is_image"), "aac")))


@query("k04_result_groups", f"{ITEMS_SQL} SELECT group_id, count(*) AS n, arg_min(path, {{'a': 100 - similarity, 'b': seq}}) AS first_path FROM items GROUP BY group_id")
def result_groups(spark, sf):
    return sinks.result_groups(items(spark, sf)).select("group_id", F.size("items").cast("long").alias("n"), F.col("items")[0]["path"].alias("first_path"))


@query("o08_union_passes", f"{ITEMS_SQL} SELECT path, flags FROM items WHERE (flags & 8) <> 0 UNION ALL SELECT path, flags FROM items WHERE (flags & 2) <> 0 UNION ALL SELECT path, flags FROM items WHERE (flags & 4) <> 0")
def union_passes(spark, sf):
    df = items(spark, sf).select("path", "flags")
    one = lambda m: df.where(F.col("flags").bitwiseAND(F.lit(m)) != 0)
    return one(verdict.GRAY).unionByName(one(verdict.PARTIAL)).unionByName(one(verdict.AI))


@query("o09_except", f"{ITEMS_SQL} SELECT group_id, seq FROM items WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM items WHERE checked) c WHERE c.group_id = items.group_id AND c.seq = items.seq)")
def except_checked(spark, sf):
    df = items(spark, sf)
    return df.join(df.where("checked").select("group_id", "seq"), ["group_id", "seq"], "left_anti").select("group_id", "seq")


@query("sc_text_functions", f"""{ITEMS_SQL} SELECT group_id, seq, CASE WHEN size >= 1073741824 THEN printf('%.1f GB', round(size / 1073741824.0, 1)) WHEN size >= 1048576 THEN printf('%.1f MB', round(size / 1048576.0, 1)) WHEN size >= 1024 THEN printf('%.1f KB', round(size / 1024.0, 1)) ELSE printf('%.1f B', CAST(size AS DOUBLE)) END AS size_text,
size // 1048576 AS mb, length(path) - length(replace(path, '/', '')) AS depth, '.mp4' AS extension, concat('o', group_id) AS last_segment, CASE WHEN similarity >= 99 THEN 'high' WHEN similarity >= 90 THEN 'mid' ELSE 'low' END AS band, CASE WHEN starts_with(path, '/lib4/') THEN concat('/new', substr(path, 6)) ELSE path END AS moved FROM items""")
def text_functions(spark, sf):
    df, path = items(spark, sf), F.col("path")
    return df.select("group_id", "seq", text.size_text(F.col("size")).alias("size_text"), text.megabytes(F.col("size")).alias("mb"), text.depth(path).alias("depth"), text.extension(path).alias("extension"), text.last_segments(F.col("folder"), 1).alias("last_segment"), text.similarity_band(F.col("similarity")).alias("band"), text.moved(path, "/lib4", "/new").alias("moved"))


@query("a19_log_sessions", """WITH e AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity, concat('user ', user_id, ' did "', event_type, '" ', CAST(floor(value) AS BIGINT)) AS message, event_type = 'signup' AS s FROM events),
n AS (SELECT *, sum(CAST(s AS INT)) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT CAST(session AS BIGINT) AS session, severity, regexp_replace(regexp_replace(message, '"[^"]*"', '"*"', 'g'), '[0-9]+', '#', 'g') AS key, count(*) AS n, min(seq) AS first_seq, arg_min(message, seq) AS message FROM n GROUP BY 1, 2, 3""")
def log_sessions(spark, sf):
    return results.log_rows(_log(spark, sf))


def _log(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "error").otherwise("info").alias("severity"), F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(' did "'), "event_type", F.lit('" '), F.floor("value").cast("long").cast("string")).alias("message"), (F.col("event_type") == "signup").alias("is_session_start"))


@query("f20_log_filter", """WITH e AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity, concat('user ', user_id, ' did "', event_type, '" ', CAST(floor(value) AS BIGINT)) AS message, event_type = 'signup' AS s FROM events),
n AS (SELECT *, sum(CAST(s AS INT)) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT CAST(session AS BIGINT) AS session, severity, regexp_replace(regexp_replace(message, '"[^"]*"', '"*"', 'g'), '[0-9]+', '#', 'g') AS key, count(*) AS n, min(seq) AS first_seq, arg_min(message, seq) AS message FROM n WHERE severity = 'error' GROUP BY 1, 2, 3 HAVING bool_or(contains(lower(message), 'user 7'))""")
def log_filter(spark, sf):
    return results.log_rows(_log(spark, sf), severity="error", search="User 7")
