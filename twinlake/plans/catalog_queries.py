"""Scope gates, catalog upserts, relocation, probe results and rescans over entries (customers) and files (parts, orders)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import kernels, text
from ..operators import catalog, grouping, scope
from ..sources import readers, sinks
from ..streaming import rescan
from .adapters import ENTRIES_SQL, entries, table
from .registry import query

_SCOPE = scope.Scope(include=["/m0", "/m1", "/m2", "/m3/n3"], blacklist=["/m0/n5", "n1?", "/m2/*7"], size_mb=(1, 900), must_match=["*customer*"], must_not_match=["*99.*"], reparse_points=False)
_REASON = """CASE WHEN lower(folder) = '/m0/n5' OR starts_with(lower(folder), '/m0/n5/') OR regexp_matches(folder, '(^|/)n1[^/](/|$)') OR regexp_matches(folder, '^/m2/.*7$') THEN 'folder is blacklisted'
WHEN NOT (folder = '/m0' OR starts_with(folder, '/m0/') OR folder = '/m1' OR starts_with(folder, '/m1/') OR folder = '/m2' OR starts_with(folder, '/m2/') OR folder = '/m3/n3' OR starts_with(folder, '/m3/n3/')) THEN 'outside the included folders'
WHEN (flags & 2) <> 0 THEN 'manually excluded' WHEN (flags & 16) <> 0 THEN 'too dark' WHEN NOT file_exists THEN 'file is missing' WHEN NOT (size // 1048576 BETWEEN 1 AND 900) THEN 'size is out of range'
WHEN NOT contains(lower(path), 'customer') THEN 'path matches no required pattern' WHEN (flags & 256) <> 0 THEN 'reparse point' WHEN regexp_matches(path, '99[.]') THEN 'path matches a forbidden pattern' END"""


@query("f01_exclusion_reasons", f"{ENTRIES_SQL} SELECT idx, {_REASON} AS reason FROM entries")
def exclusion_reasons(spark, sf):
    return entries(spark, sf).select("idx", scope.exclusion(_SCOPE).alias("reason"))


@query("f07_exclusion_summary", f"{ENTRIES_SQL}, r AS (SELECT *, {_REASON} AS reason FROM entries), k AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY path) AS nth FROM r WHERE reason IS NOT NULL) SELECT reason, count(*) AS n, string_agg(path, ',' ORDER BY path) FILTER (WHERE nth <= 5) AS examples FROM k GROUP BY reason")
def exclusion_summary(spark, sf):
    return scope.exclusion_summary(entries(spark, sf), _SCOPE)


@query("f02_eligible", f"{ENTRIES_SQL} SELECT idx FROM entries WHERE idx % 7 <> 0 AND (flags & 4) = 0 AND idx % 5 >= 2")
def eligible(spark, sf):
    df = entries(spark, sf).withColumns({"has_info": F.col("idx") % 7 != 0, "frames": F.array_repeat(F.lit(0), (F.col("idx") % 5).cast("int"))})
    return scope.eligible(df, 2).select("idx")


@query("s03_folder_stats", f"{ENTRIES_SQL} SELECT folder, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM entries GROUP BY folder")
def folder_stats(spark, sf):
    return scope.folder_stats(entries(spark, sf))


@query("a11_flag_histogram", f"{ENTRIES_SQL} SELECT {', '.join(f'count(*) FILTER (WHERE (flags & {m}) <> 0) AS {chr(34)}{n}{chr(34)}' for n, m in scope.FLAG_NAMES.items())}, count(*) FILTER (WHERE (flags & 28) <> 0) AS errors FROM entries")
def flag_histogram(spark, sf):
    return scope.flag_histogram(entries(spark, sf))


@query("f17_edit_filter", f"{ENTRIES_SQL} SELECT idx FROM entries WHERE NOT is_image AND (flags & 28) <> 0 AND (flags & 8) <> 0 AND contains(lower(path), 'n1')")
def edit_filter(spark, sf):
    return scope.edit_filter(entries(spark, sf), "video", True, 8, "N1").select("idx")


@query("f21_presence", f"{ENTRIES_SQL} SELECT idx, CASE WHEN file_exists THEN 'live' WHEN root_ready THEN 'tombstone' ELSE 'offline' END AS presence, NOT file_exists AND root_ready AND NOT idx % 2 = 0 AS ghost FROM entries")
def presence(spark, sf):
    return scope.presence(entries(spark, sf)).select("idx", "presence", scope.is_ghost(F.col("idx") % 2 == 0).alias("ghost"))


@query("f23_cleaned", f"{ENTRIES_SQL} SELECT idx FROM entries WHERE (folder = '/m1' OR starts_with(folder, '/m1/') OR folder = '/m4' OR starts_with(folder, '/m4/')) AND NOT (folder = '/m4/n9' OR starts_with(folder, '/m4/n9/')) AND (file_exists OR NOT root_ready OR idx % 2 = 1)")
def cleaned(spark, sf):
    df = entries(spark, sf).withColumn("frames", F.array_repeat(F.lit(0), (F.col("idx") % 2).cast("int")))
    return scope.cleaned(df, scope.Scope(include=["/m1", "/m4"], blacklist=["/m4/n9"]), keep_tombstones=True).select("idx")


@query("f25_prefix_count", f"{ENTRIES_SQL} SELECT count(*) AS n FROM entries WHERE starts_with(path, '/m3/n1')")
def prefix_count(spark, sf):
    return entries(spark, sf).where(F.col("path").startswith("/m3/n1")).agg(F.count("*").alias("n"))


@query("o04_catalog_sort", f"{ENTRIES_SQL} SELECT idx, (flags & 8) <> 0 AS flagged, row_number() OVER (PARTITION BY folder ORDER BY (flags & 8) <> 0 DESC, size, lower(path)) AS nth FROM entries")
def catalog_sort(spark, sf):
    from pyspark.sql import Window

    flagged = kernels.has_any(F.col("flags"), scope.METADATA_ERROR)
    return entries(spark, sf).select("idx", flagged.alias("flagged"), F.row_number().over(Window.partitionBy("folder").orderBy(flagged.desc(), "size", F.lower("path"))).cast("long").alias("nth"))


@query("f12_fingerprint_needed", f"{ENTRIES_SQL} SELECT idx, idx % 4 <> 0 AND (flags & 224) = 0 AND NOT is_image AS needed FROM entries")
def fingerprint_needed(spark, sf):
    df = entries(spark, sf).withColumn("audio_fp", F.when(F.col("idx") % 4 == 0, F.array(F.lit(1).cast("long"))))
    return df.select("idx", scope.needs_fingerprint().alias("needed"))


_OLD = "old AS (SELECT concat('/f/', c_custkey) AS path, c_nationkey AS size, concat('h', CAST(floor(c_acctbal / 50) AS BIGINT)) AS os_hash, c_custkey % 4 AS dated FROM customer WHERE c_custkey % 5 <> 0)"
_NEW = "new AS (SELECT concat('/f/', CASE WHEN c_custkey % 6 = 0 THEN c_custkey + 1000000 ELSE c_custkey END) AS path, CASE WHEN c_custkey % 11 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS size, CASE WHEN c_custkey % 13 = 0 THEN 'x' ELSE concat('h', CAST(floor(c_acctbal / 50) AS BIGINT)) END AS os_hash, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 4 + 1 ELSE c_custkey % 4 END AS dated FROM customer WHERE c_custkey % 7 <> 0)"
_STATUS = "CASE WHEN old.path IS NULL THEN 'new' WHEN new.path IS NULL THEN 'missing' WHEN old.size <> new.size THEN 'changed' WHEN old.dated = new.dated THEN 'unchanged' WHEN old.os_hash = new.os_hash THEN 'touched' ELSE 'changed' END"
_STATE = f"state AS (SELECT coalesce(old.path, new.path) AS path, {_STATUS} AS status FROM old FULL JOIN new ON old.path = new.path)"


def _sides(spark, sf):
    c = table(spark, sf, "customer")
    h, stamp = "concat('h', CAST(floor(c_acctbal / 50) AS BIGINT))", "timestamp_seconds({})"
    old = c.where("c_custkey % 5 <> 0").selectExpr("concat('/f/', c_custkey) AS path", "CAST(c_nationkey AS BIGINT) AS size", f"{stamp.format('c_custkey % 4')} AS date_created", f"{stamp.format('c_custkey % 4')} AS date_modified", f"{h} AS os_hash", "c_custkey AS feature")
    changed = "CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 4 + 1 ELSE c_custkey % 4 END"
    new = c.where("c_custkey % 7 <> 0").selectExpr("concat('/f/', CASE WHEN c_custkey % 6 = 0 THEN c_custkey + 1000000 ELSE c_custkey END) AS path", "CAST(CASE WHEN c_custkey % 11 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS BIGINT) AS size", f"{stamp.format(changed)} AS date_created", f"{stamp.format(changed)} AS date_modified", f"CASE WHEN c_custkey % 13 = 0 THEN 'x' ELSE {h} END AS os_hash")
    return old, new


@query("j01_upsert_status", f"WITH {_OLD}, {_NEW}, {_STATE} SELECT * FROM state")
def upsert_status(spark, sf):
    return catalog.upsert(*_sides(spark, sf))


@query("j02_relink", f"""WITH {_OLD}, {_NEW}, {_STATE}, n AS (SELECT new.* FROM new JOIN state USING (path) WHERE status = 'new'), m AS (SELECT old.* FROM old JOIN state USING (path) WHERE status = 'missing'),
lone AS (SELECT size, os_hash, min(path) AS old_path FROM m GROUP BY 1, 2 HAVING count(*) = 1), f AS (SELECT size, os_hash, min(path) AS path FROM n GROUP BY 1, 2)
SELECT n.path, x.old_path FROM n LEFT JOIN (SELECT f.path, old_path FROM f JOIN lone USING (size, os_hash)) x USING (path)""")
def relink(spark, sf):
    old, new = _sides(spark, sf)
    state = catalog.upsert(old, new)
    return catalog.relink(new.join(state.where("status = 'new'"), "path", "left_semi"), old.join(state.where("status = 'missing'"), "path", "left_semi"))


@query("j03_merged_catalog", f"""WITH {_OLD}, {_NEW}, {_STATE}, m AS (SELECT old.* FROM old JOIN state USING (path) WHERE status = 'missing'), lone AS (SELECT size, os_hash, min(path) AS old_path FROM m GROUP BY 1, 2 HAVING count(*) = 1),
links AS (SELECT path, old_path FROM (SELECT size, os_hash, min(new.path) AS path FROM new JOIN state USING (path) WHERE status = 'new' GROUP BY 1, 2) JOIN lone USING (size, os_hash)),
merged AS (SELECT new.path, size, old_path AS source, true AS file_exists FROM new JOIN state USING (path) LEFT JOIN links USING (path) WHERE status IN ('new', 'changed')
UNION ALL SELECT new.path, size, new.path, true FROM new JOIN state USING (path) WHERE status IN ('unchanged', 'touched')
UNION ALL SELECT m.path, size, m.path, false FROM m WHERE path NOT IN (SELECT old_path FROM links))
SELECT path, CAST(size AS BIGINT) AS size, CAST(substr(source, 4) AS BIGINT) AS feature, file_exists FROM merged""")
def merged_catalog(spark, sf):
    old, new = _sides(spark, sf)
    return catalog.merge(old, new).select("path", "size", "feature", "file_exists")


@query("j16_quarantine", f"{ENTRIES_SQL} SELECT idx, CASE WHEN idx % 10 = 1 THEN flags | 64 WHEN idx % 10 = 2 THEN flags | 4 ELSE flags END AS flags FROM entries")
def quarantine(spark, sf):
    df = entries(spark, sf)
    suspects = df.where("idx % 10 IN (1, 2)").select("path", F.when(F.col("idx") % 10 == 1, "audio").otherwise("frames").alias("phase"))
    return catalog.quarantine(df, suspects).select("idx", "flags")


_MISSING = "m AS (SELECT o_orderkey AS path, CAST(floor(o_totalprice / 20) AS BIGINT) AS size, o_orderdate AS date_modified FROM orders WHERE o_orderkey % 3 = 0), f AS (SELECT o_orderkey AS path, CAST(floor(o_totalprice / 20) AS BIGINT) AS size, o_orderdate AS date_modified FROM orders WHERE o_orderkey % 3 <> 0)"


@query("j17_relocate", f"""WITH {_MISSING}, s AS (SELECT size, count(*) AS n, min(path) AS lone FROM f GROUP BY size), l AS (SELECT m.path, count(*) AS k, min(f.path) AS found FROM m JOIN f USING (size) JOIN s USING (size) WHERE s.n > 1 AND abs(epoch_us(m.date_modified) - epoch_us(f.date_modified)) <= 2000000 GROUP BY m.path)
SELECT m.path, CASE WHEN n = 1 THEN lone WHEN n > 1 AND coalesce(k, 0) = 1 THEN found END AS new_path, CASE WHEN n IS NULL THEN 'NotFound' WHEN n = 1 THEN 'SizeOnly' WHEN coalesce(k, 0) = 1 THEN 'SizeAndModified' WHEN coalesce(k, 0) > 1 THEN 'Ambiguous' ELSE 'NotFound' END AS confidence, CASE WHEN n = 1 THEN 1 ELSE coalesce(k, 0) END AS candidates FROM m LEFT JOIN s USING (size) LEFT JOIN l USING (path)""")
def relocate(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey AS path", "CAST(floor(o_totalprice / 20) AS BIGINT) AS size", "o_orderdate AS date_modified")
    return catalog.relocate(o.where("path % 3 = 0"), o.where("path % 3 <> 0"))


@query("j21_longest_root", f"{ENTRIES_SQL}, r AS (SELECT unnest(['/m0', '/m1/n1', '/m1', '/m2/n2', '/m3']) AS root), k AS (SELECT path, root, row_number() OVER (PARTITION BY path ORDER BY length(root) DESC) AS nth FROM entries JOIN r ON path = root OR starts_with(path, root || '/')) SELECT e.path, k.root FROM entries e LEFT JOIN (SELECT * FROM k WHERE nth = 1) k USING (path)")
def longest_root(spark, sf):
    roots = spark.createDataFrame([(r,) for r in ("/m0", "/m1/n1", "/m1", "/m2/n2", "/m3")], "root string")
    return scope.longest_root(entries(spark, sf).select("path"), roots)


@query("j13_cache_lookup", f"{ENTRIES_SQL} SELECT idx, CASE WHEN idx % 4 <> 1 AND idx % 6 <> 0 THEN idx * 3 END AS vector FROM entries")
def cache_lookup(spark, sf):
    df = entries(spark, sf).withColumn("date_modified", F.timestamp_seconds("idx"))
    cache = df.where("idx % 4 <> 1").select("path", F.when(F.col("idx") % 6 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "date_modified", (F.col("idx") * 3).alias("vector"))
    return catalog.cached(df, cache).select("idx", "vector")


@query("a13_roots", f"{ENTRIES_SQL} SELECT split_part(path, '/', 2) AS root, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (WHERE file_exists) AS done FROM entries GROUP BY 1")
def roots(spark, sf):
    return catalog.roots_summary(entries(spark, sf).withColumns({"root": F.split_part("path", F.lit("/"), F.lit(2)), "done": F.col("file_exists")}))


@query("a20_middle_value", f"{ENTRIES_SQL}, r AS (SELECT folder, size, row_number() OVER (PARTITION BY folder ORDER BY size) AS r, count(*) OVER (PARTITION BY folder) AS n FROM entries) SELECT folder, size AS median FROM r WHERE r = n // 2 + 1")
def middle_value(spark, sf):
    return catalog.middle_value(entries(spark, sf), ["folder"], F.col("size"))


_PROBE = """concat('{"streams":[{"index":"0","codec_type":"video","codec_name":"h264","width":"', (event_id % 7 + 1) * 160, '","height":"', (event_id % 5 + 1) * 90, '","r_frame_rate":"', CASE WHEN event_id % 9 = 0 THEN '25/0' ELSE concat(event_id % 30 + 1, '/1') END, '","color_transfer":"', CASE event_id % 4 WHEN 0 THEN 'smpte2084' WHEN 1 THEN 'arib-std-b67' ELSE 'bt709' END, '"}],"format":{"duration":"', CASE WHEN event_id % 3 = 0 THEN '01:02:03.5' ELSE concat(event_id % 1000, '.75') END, '","bit_rate":"', event_id * 700 + 500, '"}}')"""


@query("sc20_probe", f"""WITH p AS (SELECT event_id, {_PROBE} AS j FROM events) SELECT event_id, CAST(json_extract_string(j, '$.streams[0].width') AS INT) AS width, CASE WHEN event_id % 9 = 0 THEN -1 ELSE event_id % 30 + 1 END::DOUBLE AS fps, CASE WHEN event_id % 3 = 0 THEN 3723 ELSE event_id % 1000 END AS seconds,
CASE event_id % 4 WHEN 0 THEN 'HDR10' WHEN 1 THEN 'HLG' ELSE '' END AS hdr, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS hdr_rank, CAST(round_even((event_id * 700 + 500) / 1000::DOUBLE, 0) AS BIGINT) AS kbs FROM p""")
def probe(spark, sf):
    p = table(spark, sf, "events").selectExpr("event_id", f"{_PROBE} AS j").withColumn("p", text.probed(F.col("j")))
    s = F.get("p.streams", F.lit(0))
    hdr = text.hdr_format(s["color_transfer"], F.array_join(F.transform(s["side_data_list"], lambda x: x["side_data_type"]), "|"))
    return p.select("event_id", s["width"].try_cast("int").alias("width"), text.frame_rate(s["r_frame_rate"]).alias("fps"), text.duration_seconds(F.col("p.format.duration")).alias("seconds"), hdr.alias("hdr"), text.hdr_rank(hdr).alias("hdr_rank"), text.kilobits(F.col("p.format.bit_rate").cast("long")).cast("long").alias("kbs"))


_MESSAGE = "CASE event_id % 6 WHEN 0 THEN 'Failed setup for format cuda: 12' WHEN 1 THEN 'moov atom NOT found' WHEN 2 THEN 'Decoder not found' WHEN 3 THEN 'x: Permission denied' WHEN 4 THEN 'Generic error in an external library' ELSE 'odd' END"


@query("sc12_error_cause", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'HardwareAcceleration' WHEN 1 THEN 'CorruptOrTruncated' WHEN 2 THEN 'UnsupportedCodec' WHEN 3 THEN 'FileAccess' WHEN 4 THEN 'HardwareAcceleration' ELSE 'Unknown' END AS cause FROM events")
def error_cause(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id", f"{_MESSAGE} AS m").select("event_id", text.error_cause(F.col("m")).alias("cause"))


@query("sc14_span_text", """WITH s AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice * 7) AS BIGINT) AS s FROM orders), p AS (SELECT k, s, s // 86400 AS d, s % 86400 // 3600 AS h, s % 3600 // 60 AS m, s % 60 AS r FROM s)
SELECT k, CASE WHEN d > 0 THEN CASE WHEN h > 0 THEN concat(d, 'd, ', h, 'h') ELSE concat(d, 'd') END WHEN h > 0 THEN CASE WHEN m > 0 THEN concat(h, 'h, ', m, 'm') ELSE concat(h, 'h') END WHEN m > 0 THEN concat(m, 'm, ', r, 's') ELSE concat(r, 's') END AS span, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS clock FROM p""")
def span_text(spark, sf):
    s = table(spark, sf, "orders").selectExpr("o_orderkey AS k", "CAST(floor(o_totalprice * 7) AS BIGINT) AS s")
    return s.select("k", text.span_text(F.col("s")).alias("span"), text.clock_text(F.col("s")).alias("clock"))


@query("sc25_flags", f"{ENTRIES_SQL} SELECT idx, (flags & 28) <> 0 AS some, (flags & 12) = 12 AS whole, CASE WHEN idx % 2 = 0 THEN flags | 2 ELSE flags & ~2 END AS changed FROM entries".replace("AS some,", "AS any_error,"))
def flags(spark, sf):
    f = F.col("flags")
    return entries(spark, sf).select("idx", kernels.has_any(f, scope.ALL_ERRORS).alias("any_error"), kernels.has_all(f, 12).alias("whole"), kernels.set_flag(f, 2, F.col("idx") % 2 == 0).alias("changed"))


@query("sc10_shortened", f"{ENTRIES_SQL} SELECT idx, CASE WHEN length(path) > 15 THEN concat(substr(path, 1, 7), '…', right(path, 7)) ELSE path END AS short FROM entries")
def shortened(spark, sf):
    return entries(spark, sf).select("idx", text.shortened(F.col("path"), 15).alias("short"))


@query("s01_page_globs", "SELECT page_id FROM pages WHERE regexp_matches(url, '(?i)^.*example.com/en/.*$') AND NOT regexp_matches(url, '(?i)^https://blog.*$')")
def page_globs(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").where(text.matches_any(url, ["*example.com/en/*"]) & ~text.matches_any(url, ["https://blog*"])).select("page_id")


@query("k03_diagnostic", f"{ENTRIES_SQL} SELECT row_number() OVER (ORDER BY path) - 1 AS id, is_image, flags, size FROM entries")
def diagnostic(spark, sf):
    frame = "array(struct(0 AS pos_idx, CAST(0 AS DOUBLE) AS t_sec, CAST('g' AS BINARY) AS gray, CAST(1 AS BIGINT) AS phash))"
    df = entries(spark, sf).withColumns({"duration_s": F.lit(0.0), "frames": F.expr(frame)})
    return sinks.diagnostic(df).select("id", "is_image", "flags", "size")


@query("s19_synthetic")
def synthetic(spark, sf):
    return readers.synthetic(spark, 1000).select("path", "size", "duration_s", "cluster")


@query("t01_streaming_rescan", "SELECT user_id, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY user_id")
def streaming_rescan(spark, sf):
    """Events as a file stream, merged batch by batch into a table by user: the answer of a whole run."""
    store, work = (f"{grouping.shared_folder(spark)}/stream-{uuid.uuid4().hex}-{n}" for n in ("store", "work"))
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events.parquet").parquet(sf)
    seen: list[int] = []

    def step(batch, n):
        part = batch.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))
        if seen:
            part = spark.read.parquet(f"{store}/v={seen[-1]}").unionByName(part).groupBy("user_id").agg(F.sum("n").alias("n"), F.min("first_event").alias("first_event"))
        part.write.mode("overwrite").parquet(f"{store}/v={n}")
        seen.append(n)

    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", work).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{store}/v={seen[-1]}")


@query("t01_pending", f"{ENTRIES_SQL} SELECT idx FROM entries WHERE NOT (idx % 3 = 0) AND NOT (idx % 10 = 1)")
def pending(spark, sf):
    df = entries(spark, sf).withColumn("date_modified", F.timestamp_seconds("idx"))
    return rescan.pending(df, df.where("idx % 3 = 0"), df.where("idx % 10 = 1")).select("idx")


@query("w16_excluded", f"{ENTRIES_SQL} SELECT idx, CASE WHEN idx % 8 = 3 THEN flags | 2 ELSE flags END AS flags FROM entries")
def excluded(spark, sf):
    df = entries(spark, sf)
    return catalog.exclude(df, df.where("idx % 8 = 3")).select("idx", "flags")


@query("a21_distinct_segments", f"{ENTRIES_SQL} SELECT folder, count(DISTINCT segment) AS segments FROM entries GROUP BY folder")
def distinct_segments(spark, sf):
    return entries(spark, sf).groupBy("folder").agg(F.count_distinct("segment").alias("segments"))


_AUDIO = "CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 3 END"
_HELD = f"SELECT path, is_image, flags, {_AUDIO} AS blocks, 1 + c % 3 AS n_frames, c % 5 = 0 AS small FROM (SELECT *, idx AS c, idx AS c_custkey FROM entries)"


@query("d09_migrations", f"""{ENTRIES_SQL}, h AS ({_HELD}) SELECT path, (flags & ~{scope.AUDIO_ERROR}) & CASE WHEN is_image THEN ~{scope.TOO_DARK} ELSE -1 END AS flags,
CASE WHEN blocks = 0 AND flags & {scope.AUDIO_ERROR} > 0 AND flags & {scope.NO_AUDIO | scope.SILENT} = 0 THEN NULL ELSE blocks END AS blocks, CASE WHEN is_image THEN 0 WHEN small THEN n_frames - 1 ELSE n_frames END AS n_frames FROM h""")
def migrations(spark, sf):
    """Every migration on entries whose first frame may have the old size, with fingerprints of all three kinds."""
    e = entries(spark, sf).withColumns({"c_custkey": F.col("idx"), "c": F.col("idx")})
    blocks = F.expr(_AUDIO)
    frame = lambda i: F.struct(i.cast("int").alias("pos_idx"), F.lit(0.0).alias("t_sec"), F.repeat(F.lit("x"), F.when((F.col("c") % 5 == 0) & (i == 1), 256).otherwise(1024)).cast("binary").alias("gray"), F.lit(7).cast("long").alias("phash"))
    fp = F.when(blocks.isNotNull(), F.slice(F.array(*(F.lit(k).cast("long") for k in range(3))), F.lit(1), F.coalesce(blocks, F.lit(0))))
    held = e.withColumns({"audio_fp": fp, "frames": F.transform(F.sequence(F.lit(1).cast("long"), 1 + F.col("c") % 3), frame)})
    return catalog.migrate(held, 0).select("path", "flags", F.when(F.col("audio_fp").isNotNull(), F.size("audio_fp")).alias("blocks"), F.size("frames").cast("long").alias("n_frames"))
