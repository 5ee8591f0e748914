"""Subtitles, packets, sequences, detections and small formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..functions import timecode as t
from ..operators import detection as d
from ..operators import subtitles as s
from ..operators import timeline as v
from . import query

PKT = ["source", "i", "pts"]


def packets(name: str, sql: str, f, *args):
    @query(name, sql)
    def run(spark, sf_dir):
        return f(model.packets(spark, sf_dir), *args).select(*PKT)


FIRST = "(SELECT *, min(CASE WHEN is_keyframe AND pts >= 45000 THEN pts END) OVER (PARTITION BY source) AS first, count(*) OVER (PARTITION BY source) AS n FROM {pkt})"
packets("trim_packets", f"SELECT source, i, pts FROM {FIRST} WHERE pts >= first AND pts < 135000", v.trim, 0.5, 1.5)
packets("cut_packets", "SELECT source, i, pts FROM {pkt} WHERE NOT (pts >= 45000 AND pts < 90000)", v.cut_out, 0.5, 1.0)
packets("speed_up", "SELECT source, i, pts FROM {pkt} WHERE floor((i + 1) / 1.5::DOUBLE + 1e-9) > floor(i / 1.5::DOUBLE + 1e-9)", v.speed_up, 1.5)
packets("slow_down", "SELECT source, i, pts FROM {pkt}, (SELECT unnest(range(3)))", v.slow_down, 0.35)
packets("every_nth", "SELECT source, i, pts FROM {pkt} WHERE i % 5 = 0 AND i // 5 < 4", v.every_nth, 5, 4)
packets("thumbnail_pick", f"SELECT source, i, pts FROM {FIRST} WHERE i = n // 2", v.thumbnail, "middle")
packets("concat_packets", "SELECT source, i, pts + coalesce(b, 0) AS pts FROM {pkt} JOIN (SELECT source, CAST(sum(l) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS b FROM (SELECT source, max(pts + duration) AS l FROM {pkt} GROUP BY 1)) USING (source)", lambda p: v.concat(p, F.col("source")))


@query("segment_concat", "SELECT source, segment, i, pts FROM {pkt} JOIN (VALUES (1, 0.2::DOUBLE, 0.6::DOUBLE), (2, 0.5::DOUBLE, 1.1::DOUBLE)) AS r(segment, a, b) ON pts >= floor(a * 90000) AND pts < floor(b * 90000)")
def segment_concat(spark, sf_dir):
    p = model.packets(spark, sf_dir)
    ranges = p.select("source").distinct().withColumn("r", F.explode(F.array(F.struct(F.lit(1).alias("segment"), F.lit(0.2).alias("start"), F.lit(0.6).alias("end")), F.struct(F.lit(2).alias("segment"), F.lit(0.5).alias("start"), F.lit(1.1).alias("end")))))
    return v.segments(p, ranges.select("source", "r.*")).select("source", "segment", "i", "pts")


@query("keyframe_asof", "SELECT source, min(pts) AS pts, arg_min(size, pts) AS size FROM {pkt} WHERE is_keyframe AND pts >= 72000 GROUP BY source")
def keyframe_asof(spark, sf_dir):
    return v.keyframe_at(model.packets(spark, sf_dir), 0.8)


@query("source_info", "SELECT source, count(*) AS frames, max(pts + duration) / 90000.0::DOUBLE AS duration, CAST(sum(CAST(is_keyframe AS BIGINT)) AS BIGINT) AS keyframes, CAST(sum(size) AS BIGINT) AS bytes FROM {pkt} GROUP BY source")
def source_info(spark, sf_dir):
    return v.source_info(model.packets(spark, sf_dir))


@query("transcode_fade_gain", "SELECT source, i, round(least(CASE WHEN i / 30.0::DOUBLE < 0.4 THEN i / 30.0::DOUBLE / 0.4 ELSE 1 END, CASE WHEN i / 30.0::DOUBLE > n / 30.0::DOUBLE - 0.7 THEN (n / 30.0::DOUBLE - i / 30.0::DOUBLE) / 0.7 ELSE 1 END), 6) AS gain FROM " + FIRST)
def transcode_fade_gain(spark, sf_dir):
    return v.fade_gain(model.packets(spark, sf_dir), 30, 0.4, 0.7).select("source", "i", F.round("gain", 6).alias("gain"))


@query("sequence_missing", "SELECT CAST(f AS BIGINT) AS frame_no FROM (SELECT unnest(range(min(frame_no), max(frame_no) + 1)) AS f FROM {seq}) WHERE f NOT IN (SELECT frame_no FROM {seq})")
def sequence_missing(spark, sf_dir):
    return v.missing_frames(model.sequence(spark, sf_dir))


@query("sequence_info", "SELECT count(*) AS frames, min(frame_no) AS first, max(frame_no) AS last, arg_min(width, frame_no) AS width, arg_min(height, frame_no) AS height FROM {seq}")
def sequence_info(spark, sf_dir):
    return v.sequence_info(model.sequence(spark, sf_dir))


@query("sequence_mismatch", "SELECT frame_no, width, height FROM {seq} WHERE width <> (SELECT arg_min(width, frame_no) FROM {seq})")
def sequence_mismatch(spark, sf_dir):
    return v.mismatched_frames(model.sequence(spark, sf_dir))


@query("sequence_runs", "SELECT min(frame_no) AS first, max(frame_no) AS last, count(*) AS frames FROM (SELECT frame_no, frame_no - row_number() OVER (ORDER BY frame_no) AS k FROM {seq}) GROUP BY k")
def sequence_runs(spark, sf_dir):
    return v.contiguous_runs(model.sequence(spark, sf_dir))


@query("p95_timing", "SELECT event_type, round(avg(value), 6) AS mean, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.95::DOUBLE + 0.5) AS BIGINT) + 1] AS p95 FROM events GROUP BY event_type")
def p95_timing(spark, sf_dir):
    return v.p95(model.table(spark, sf_dir, "events"), "event_type", "value")


def clock(column: str, units: int, form: str, sep: str, width: int) -> str:
    n = f"CAST(floor({column} * {units}) AS BIGINT)"
    return f"printf('{form}:%02d:%02d{sep}%0{width}d', {n} // {units} // 3600, {n} // {units} // 60 % 60, {n} // {units} % 60, {n} % {units})"


SRT, VTT, ASS = (lambda c: clock(c, 1000, "%02d", ",", 3)), (lambda c: clock(c, 1000, "%02d", ".", 3)), (lambda c: clock(c, 100, "%d", ".", 2))


@query("cue_times", f"SELECT track_id, idx, {SRT('\"start\"')} AS srt, {VTT('\"end\"')} AS vtt, {ASS('\"end\" * 97')} AS ass FROM {{cue}}")
def cue_times(spark, sf_dir):
    c = model.cues(spark, sf_dir)
    return c.select("track_id", "idx", t.srt_time(F.col("start")).alias("srt"), t.vtt_time(F.col("end")).alias("vtt"), t.ass_time(F.col("end") * 97).alias("ass"))


@query("parse_srt_time", f"SELECT track_id, idx, round(floor(\"end\" * 1000) / 1000, 3) AS seconds FROM {{cue}}")
def parse_srt_time(spark, sf_dir):
    return model.cues(spark, sf_dir).select("track_id", "idx", F.round(t.parse_time(t.srt_time(F.col("end"))), 3).alias("seconds"))


@query("cues_at", "SELECT track_id, 20.0::DOUBLE AS time, idx FROM {cue} WHERE \"start\" <= 20 AND \"end\" > 20")
def cues_at(spark, sf_dir):
    c = model.cues(spark, sf_dir)
    times = c.select("track_id").distinct().withColumn("time", F.lit(20.0))
    return s.cues_at(c, times).select("track_id", "time", "idx")


@query("text_at", "SELECT c.track_id, time, string_agg(text, chr(10) ORDER BY idx) AS text FROM {cue} c, (VALUES (3.5::DOUBLE), (20.0::DOUBLE)) AS q(time) WHERE \"start\" <= time AND \"end\" > time GROUP BY 1, 2")
def text_at(spark, sf_dir):
    c = model.cues(spark, sf_dir)
    times = c.select("track_id").distinct().withColumn("time", F.explode(F.array(F.lit(3.5), F.lit(20.0))))
    return s.text_at(c, times)


@query("cue_shift", "SELECT track_id, idx, greatest(0, \"start\" - 7.25::DOUBLE) AS \"start\", greatest(0, \"end\" - 7.25::DOUBLE) AS \"end\" FROM {cue}")
def cue_shift(spark, sf_dir):
    return s.shift(model.cues(spark, sf_dir), -7.25).select("track_id", "idx", "start", "end")


@query("cue_scale", "SELECT track_id, idx, \"start\" * 1.5::DOUBLE AS \"start\", \"end\" * 1.5::DOUBLE AS \"end\" FROM {cue}")
def cue_scale(spark, sf_dir):
    return s.scale(model.cues(spark, sf_dir), 1.5).select("track_id", "idx", "start", "end")


@query("track_duration", "SELECT track_id, max(\"end\") AS duration, count(*) AS n FROM {cue} GROUP BY track_id")
def track_duration(spark, sf_dir):
    return s.duration(model.cues(spark, sf_dir))


TO_SRT = f"string_agg(CAST(n AS VARCHAR) || chr(10) || {SRT('\"start\"')} || ' --> ' || {SRT('\"end\"')} || chr(10) || text || chr(10) || chr(10), '' ORDER BY n)"
ORDERED = "(SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY idx) AS n FROM {cue})"


@query("to_srt", f"SELECT track_id, {TO_SRT} AS content FROM {ORDERED} GROUP BY track_id")
def to_srt(spark, sf_dir):
    return s.to_srt(model.cues(spark, sf_dir))


@query("to_vtt", f"SELECT track_id, 'WEBVTT' || chr(10) || chr(10) || {TO_SRT.replace(SRT('\"start\"'), VTT('\"start\"')).replace(SRT('\"end\"'), VTT('\"end\"'))} AS content FROM {ORDERED} GROUP BY track_id")
def to_vtt(spark, sf_dir):
    return s.to_vtt(model.cues(spark, sf_dir))


@query("to_ass", f"SELECT track_id, '{s.ASS_HEAD.format(title='Untitled')}' || string_agg('Dialogue: 0,' || {ASS('\"start\"')} || ',' || {ASS('\"end\"')} || ',Default,,,0,0,,' || replace(text, chr(10), '\\N') || chr(10), '' ORDER BY n) AS content FROM {ORDERED} GROUP BY track_id")
def to_ass(spark, sf_dir):
    return s.to_ass(model.cues(spark, sf_dir))


FLAT = "(SELECT track_id, idx, round(floor(\"start\" * {0}) / {0}, 3) AS \"start\", round(floor(\"end\" * {0}) / {0}, 3) AS \"end\", {1} AS text FROM {{cue}})"


def round_trip(name: str, write, read, units: int):
    @query(name, f"SELECT * FROM {FLAT.format(units, 'rtrim(regexp_replace(text, chr(10) || chr(43), chr(32), chr(103)))')}".replace("chr(10) || chr(43)", "'\\n+'").replace("chr(103)", "'g'").replace("chr(32)", "' '"))
    def run(spark, sf_dir):
        c = model.cues(spark, sf_dir).withColumn("text", F.rtrim(F.regexp_replace("text", r"\n+", " ")))
        out = read(write(c))
        return out.select("track_id", "idx", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")


round_trip("parse_srt_roundtrip", s.to_srt, s.parse_srt, 1000)
round_trip("parse_vtt_roundtrip", s.to_vtt, s.parse_vtt, 1000)
round_trip("parse_ass_roundtrip", s.to_ass, s.parse_ass, 100)


@query("strip_tags", "SELECT page_id, replace(regexp_replace(html, '<[^>]*(>|$)', '', 'gs'), '>', '') AS text FROM pages")
def strip_tags(spark, sf_dir):
    return model.table(spark, sf_dir, "pages").select("page_id", t.strip_tags(F.col("html")).alias("text"))


IOU = "CASE WHEN least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1) THEN (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))) ELSE 0 END"


@query("iou_pairs", f"SELECT a.image_id, a.det_id AS a, b.det_id AS b, round({IOU}, 6) AS iou FROM {{det}} a JOIN {{det}} b ON a.image_id = b.image_id AND a.det_id < b.det_id WHERE round({IOU}, 6) > 0")
def iou_pairs(spark, sf_dir):
    return d.iou_pairs(model.boxes(spark, sf_dir))


NMS = f"""WITH RECURSIVE {model.SQL['det']}, ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS k FROM det),
step AS (SELECT image_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT image_id FROM det)
UNION ALL SELECT s.image_id, s.k + 1, CASE WHEN EXISTS (SELECT 1 FROM ranked a, ranked b WHERE a.image_id = s.image_id AND a.k = s.k + 1 AND b.image_id = s.image_id AND list_contains(s.kept, b.k) AND {IOU} >= 0.2) THEN s.kept ELSE list_append(s.kept, s.k + 1) END FROM step s WHERE s.k < (SELECT max(k) FROM ranked r WHERE r.image_id = s.image_id))
SELECT r.image_id, det_id, score FROM ranked r JOIN (SELECT image_id, arg_max(kept, k) AS kept FROM step GROUP BY 1) f ON f.image_id = r.image_id AND list_contains(f.kept, r.k)"""


@query("nms", NMS)
def nms(spark, sf_dir):
    return d.nms(model.boxes(spark, sf_dir), 0.2).select("image_id", "det_id", "score")


@query("softmax_topn", "SELECT vec_id AS id, CAST(r - 1 AS INTEGER) AS rank, CAST(k AS INTEGER) AS label, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k DESC) AS r FROM (SELECT vec_id, k, exp(e) / sum(exp(e)) OVER (PARTITION BY vec_id) AS p FROM (SELECT vec_id, unnest(range(7)) AS k, CAST(unnest(embedding[1:7]) AS DOUBLE) AS e FROM embeddings))) WHERE r <= 3")
def softmax_topn(spark, sf_dir):
    df = model.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 7).alias("e"))
    return d.softmax_top(df, F.col("e"), 3)


@query("ctc_collapse", "SELECT vec_id AS id, list(token ORDER BY pos) AS tokens FROM (SELECT *, lag(token) OVER (PARTITION BY vec_id ORDER BY pos) AS before FROM (SELECT image_id AS vec_id, y * 8 + x AS pos, v // 64 AS token FROM {gray8})) WHERE token <> 2 AND (before IS NULL OR before <> token) GROUP BY vec_id")
def ctc_collapse(spark, sf_dir):
    px = model.pixels(model.gray8(spark, sf_dir))
    return d.ctc_collapse(px.select(F.col("image_id").alias("id"), (F.col("y") * 8 + F.col("x")).alias("pos"), F.floor(F.col("v") / 64).cast("int").alias("token")), 2)


POSE = "(SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS ax, CAST(embedding[2] AS DOUBLE) AS ay, CAST(embedding[3] AS DOUBLE) AS bx, CAST(embedding[4] AS DOUBLE) AS \"by\", CAST(embedding[5] AS DOUBLE) AS cx, CAST(embedding[6] AS DOUBLE) AS cy FROM embeddings)"


@query("pose_angle", f"SELECT vec_id, round(degrees(acos(greatest(-1, least(1, ((ax - bx) * (cx - bx) + (ay - \"by\") * (cy - \"by\")) / (sqrt((ax - bx) * (ax - bx) + (ay - \"by\") * (ay - \"by\")) * sqrt((cx - bx) * (cx - bx) + (cy - \"by\") * (cy - \"by\"))))))), 5) AS angle FROM {POSE}")
def pose_angle(spark, sf_dir):
    e = F.col("embedding")
    p = lambda k: F.struct(e[k].cast("double").alias("x"), e[k + 1].cast("double").alias("y"))
    return model.table(spark, sf_dir, "embeddings").select("vec_id", F.round(d.joint_angle(p(0), p(2), p(4)), 5).alias("angle"))


@query("pose_facing", "SELECT vec_id, CASE WHEN c0 < 0 OR c1 < 0 OR c2 < 0 THEN 'unknown' WHEN abs(rs - ls) < 0.05 THEN CASE WHEN nx - (ls + rs) / 2 > 0 THEN 'right' ELSE 'left' END WHEN abs(nx - (ls + rs) / 2) < 0.3::DOUBLE * abs(rs - ls) THEN CASE WHEN e1 >= 0 AND e2 >= 0 THEN 'front' ELSE 'back' END WHEN nx - (ls + rs) / 2 > 0 THEN 'right' ELSE 'left' END AS facing FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS nx, CAST(embedding[2] AS DOUBLE) AS ls, CAST(embedding[3] AS DOUBLE) AS rs, embedding[4] AS c0, embedding[5] AS c1, embedding[6] AS c2, embedding[7] AS e1, embedding[8] AS e2 FROM embeddings)")
def pose_facing(spark, sf_dir):
    e = lambda k: F.col("embedding")[k].cast("double")
    p = lambda x, c: F.struct(e(x).alias("x"), e(c).alias("confidence"))
    points = {"nose": p(0, 3), "left_shoulder": p(1, 4), "right_shoulder": p(2, 5), "left_eye": p(0, 6), "right_eye": p(0, 7)}
    return model.table(spark, sf_dir, "embeddings").select("vec_id", d.facing(points, 0.0).alias("facing"))


@query("depth_gray", "SELECT vec_id, list(CAST(floor((e - lo) / (hi - lo) * 255) AS INTEGER) ORDER BY p) AS gray FROM (SELECT vec_id, p, CAST(embedding[p] AS DOUBLE) AS e, CAST(list_min(embedding) AS DOUBLE) AS lo, CAST(list_max(embedding) AS DOUBLE) AS hi FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS p FROM embeddings)) GROUP BY vec_id")
def depth_gray(spark, sf_dir):
    df = model.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("depth"))
    return d.depth_gray(df).select("vec_id", "gray")


@query("hex_color", "SELECT o_orderkey, CAST(o_orderkey * 7919 % 256 AS INTEGER) AS r, CAST(o_orderkey * 104729 % 256 AS INTEGER) AS g, CAST(o_custkey % 256 AS INTEGER) AS b, 255 AS a FROM orders")
def hex_color(spark, sf_dir):
    o = model.table(spark, sf_dir, "orders")
    text = F.format_string("#%02x%02X%02x", F.col("o_orderkey") * 7919 % 256, F.col("o_orderkey") * 104729 % 256, F.col("o_custkey") % 256)
    return o.select("o_orderkey", t.hex_color(text).alias("c")).select("o_orderkey", "c.*")


@query("format_size", "SELECT o_orderkey, CASE WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824.0::DOUBLE) WHEN n >= 1048576 THEN printf('%.2f MB', n / 1048576.0::DOUBLE) WHEN n >= 1024 THEN printf('%.2f KB', n / 1024.0::DOUBLE) ELSE printf('%d bytes', n) END AS text FROM (SELECT o_orderkey, o_orderkey * o_orderkey * (o_custkey + 1) // 3 AS n FROM orders)")
def format_size(spark, sf_dir):
    o = model.table(spark, sf_dir, "orders")
    # k * k * d leaves the range of bigint from keys of some millions on, and div gives a bigint for decimals too:
    # with k = 3 * m + s, k * k is 3 * (m * (k + s) + s * s div 3) + s * s % 3, so that only small numbers are divided.
    o = o.selectExpr("o_orderkey", "cast(o_orderkey AS decimal(19,0)) AS k", "o_orderkey div 3 AS m", "o_orderkey % 3 AS s", "o_custkey + 1 AS d")
    n = F.expr("(m * (k + s) + s * s div 3) * d + s * s % 3 * d div 3")
    return o.select("o_orderkey", t.format_size(n).alias("text"))


@query("format_duration", "SELECT o_orderkey, CASE WHEN n >= 3600000 THEN printf('%d:%02d:%02d', n // 3600000, n // 60000 % 60, n // 1000 % 60) WHEN n >= 60000 THEN printf('%d:%02d', n // 60000, n // 1000 % 60) ELSE printf('%d.%03ds', n // 1000, n % 1000) END AS text FROM (SELECT o_orderkey, o_orderkey * o_custkey * 13 AS n FROM orders)")
def format_duration(spark, sf_dir):
    return model.table(spark, sf_dir, "orders").select("o_orderkey", t.format_duration(F.col("o_orderkey") * F.col("o_custkey") * 13).alias("text"))


@query("yuv_to_rgb", "SELECT image_id, x, y, " + ", ".join(f"CAST(floor(greatest(0, least(255, {e})) + 1e-9) AS INTEGER) AS {n}" for n, e in (("r", "r + 1.5748::DOUBLE * (b - 128)"), ("g", "r - 0.1873::DOUBLE * (g - 128) - 0.4681::DOUBLE * (b - 128)"), ("b", "r + 1.8556::DOUBLE * (g - 128)"))) + " FROM {rgb8}")
def yuv_to_rgb(spark, sf_dir):
    px = model.pixels(model.rgb8(spark, sf_dir), "r", "g", "b")
    return px.select("image_id", "x", "y", t.yuv_to_rgb(F.col("r"), F.col("g"), F.col("b")).alias("c")).select("image_id", "x", "y", "c.*")


@query("rgb_to_yuv", "SELECT image_id, x, y, " + ", ".join(f"CAST(floor(greatest(0, least(255, {e})) + 1e-9) AS INTEGER) AS {n}" for n, e in (("luma", "0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b"), ("u", "128 - 0.169::DOUBLE * r - 0.331::DOUBLE * g + 0.5 * b"), ("v", "128 + 0.5 * r - 0.419::DOUBLE * g - 0.081::DOUBLE * b"))) + " FROM {rgb8}")
def rgb_to_yuv(spark, sf_dir):
    px = model.pixels(model.rgb8(spark, sf_dir), "r", "g", "b")
    return px.select("image_id", "x", "y", t.rgb_to_yuv(F.col("r"), F.col("g"), F.col("b")).alias("c")).select("image_id", "x", "y", F.col("c.y").alias("luma"), "c.u", "c.v")


@query("frame_rates", "SELECT o_orderkey, num, den FROM (SELECT o_orderkey, CASE WHEN f = 23.976 THEN 24000 WHEN f = 29.97 THEN 30000 WHEN f = 59.94 THEN 60000 ELSE floor(f + 0.5) END::BIGINT AS num, CASE WHEN f IN (23.976, 29.97, 59.94) THEN 1001 ELSE 1 END::BIGINT AS den FROM (SELECT o_orderkey, [23.976, 24.0, 29.97, 59.94, 12.3, 60.0][o_orderkey % 6 + 1]::DOUBLE AS f FROM orders))")
def frame_rates(spark, sf_dir):
    fps = F.get(F.array(*map(F.lit, (23.976, 24.0, 29.97, 59.94, 12.3, 60.0))), (F.col("o_orderkey") % 6).cast("int"))
    return model.table(spark, sf_dir, "orders").select("o_orderkey", t.frame_rate(fps).alias("f")).select("o_orderkey", "f.*")


@query("auto_bitrate", "SELECT frame_no, CAST(floor(CASE WHEN width * height <= 307200 THEN 1000 ELSE 2500 END * sqrt((frame_no % 60 + 1) / 30.0::DOUBLE)) AS BIGINT) AS kbps FROM {seq}")
def auto_bitrate(spark, sf_dir):
    return model.sequence(spark, sf_dir).select("frame_no", t.auto_bitrate(F.col("width"), F.col("height"), (F.col("frame_no") % 60 + 1)).alias("kbps"))


@query("container_types", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'mp4' WHEN 1 THEN 'mkv' WHEN 2 THEN 'avi' END AS kind FROM pages")
def container_types(spark, sf_dir):
    ext = F.get(F.array(F.lit("MOV"), F.lit("mkv"), F.lit("Avi"), F.lit("txt")), (F.col("page_id") % 4).cast("int"))
    return model.table(spark, sf_dir, "pages").select("page_id", t.container_type(F.concat(F.lit("/a.b/c."), ext)).alias("kind"))
