"""Subtitle tracks as cue rows: parsers and writers of SRT, VTT and ASS, and operators on time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import timecode as t

#: The head of an ASS file.
ASS_HEAD = """[Script Info]
Title: {title}
ScriptType: v4.00+
WrapStyle: 0
ScaledBorderAndShadow: yes

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding
Style: Default,Arial,48,&H00FFFFFF,&H000000FF,&H00000000,&H80000000,-1,0,0,0,100,100,0,0,1,2,1,2,10,10,10,1

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
"""


def _content() -> Column:
    return F.regexp_replace("content", "^﻿+", "")


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, "\n$", ""), "\n"), lambda s: F.regexp_replace(s, "\r$", ""))


def _checked(v: Column, what: str, raw: Column) -> Column:
    return F.coalesce(v, F.raise_error(F.concat(F.lit(f"invalid {what} time: "), raw)).cast("double"))


def parse_srt(files: DataFrame) -> DataFrame:
    """track_id, idx, start, end, text of each block of (track_id, content); a bad time fails the job, a bad block is left out."""
    blocks = files.select("track_id", F.posexplode(F.split(_content(), "\n\n")).alias("ord", "block")).where(F.trim(F.col("block")) != "")
    rows = blocks.withColumn("l", _lines(F.col("block"))).where(F.size("l") >= 3)
    rows = rows.withColumn("times", F.split(F.col("l")[1], "-->")).where(F.size("times") == 2)
    start, end = F.col("times")[0], F.col("times")[1]
    text = t.strip_tags(F.array_join(F.slice("l", F.lit(3), F.size("l")), "\n"))
    return rows.select("track_id", F.coalesce(F.trim(F.col("l")[0]).try_cast("bigint"), F.lit(0)).alias("idx"), _checked(t.parse_time(start), "SRT start", start).alias("start"), _checked(t.parse_time(end), "SRT end", end).alias("end"), text.alias("text"))


def parse_vtt(files: DataFrame) -> DataFrame:
    """The same for VTT; what follows the end time is ignored, cues are numbered from 1."""
    body = F.when(F.startswith(_content(), F.lit("WEBVTT")), F.regexp_replace(_content(), r"^[^\n]*\n?", "")).otherwise(_content())
    blocks = files.select("track_id", F.posexplode(F.split(body, "\n\n")).alias("ord", "block")).where(F.trim(F.col("block")) != "")
    rows = blocks.withColumn("l", _lines(F.col("block"))).withColumn("at", F.array_position(F.transform("l", lambda s: F.contains(s, F.lit("-->"))), True).cast("int")).where("at > 0")
    rows = rows.withColumn("times", F.split(F.element_at("l", F.col("at")), "-->")).where(F.size("times") == 2)
    start, end = F.trim(F.col("times")[0]), F.split(F.trim(F.col("times")[1]), r"\s+")[0]
    text = t.strip_tags(F.array_join(F.slice("l", F.col("at") + 1, F.size("l")), "\n"))
    idx = F.row_number().over(W.partitionBy("track_id").orderBy("ord")).cast("bigint")
    return rows.select("track_id", idx.alias("idx"), _checked(t.parse_time(start), "VTT start", start).alias("start"), _checked(t.parse_time(end), "VTT end", end).alias("end"), text.alias("text"))


def parse_ass(files: DataFrame) -> DataFrame:
    """The same for ASS, with style; columns come from the Format line, the last one keeps its commas, bad times are 0."""
    rows = files.select("track_id", F.posexplode(_lines(_content())).alias("ord", "line")).withColumn("line", F.trim("line"))
    w = W.partitionBy("track_id").orderBy("ord")
    low = F.lower("line")
    rows = rows.withColumn("section", F.last(F.when(F.startswith("line", F.lit("[")), low), True).over(w)).where("section = '[events]'")
    fields = F.transform(F.split(F.substr(F.col("line"), F.lit(8)), ","), lambda s: F.lower(F.trim(s)))
    rows = rows.withColumn("fields", F.last(F.when(F.startswith(F.lower("line"), F.lit("format:")), fields), True).over(w))
    rows = rows.where(F.startswith(F.lower("line"), F.lit("dialogue:")) & F.col("fields").isNotNull())
    rows = rows.withColumn("values", F.expr("split(substr(line, 10), ',', size(fields))")).where("size(values) >= size(fields)")
    field = lambda name: F.get("values", F.array_position("fields", name).cast("int") - 1)
    number = lambda name: F.coalesce(t.parse_time(F.replace(field(name), F.lit(","), F.lit(" "))), F.lit(0.0))
    idx = F.row_number().over(w).cast("bigint")
    return rows.select("track_id", idx.alias("idx"), number("start").alias("start"), number("end").alias("end"), F.coalesce(t.strip_ass_tags(field("text")), F.lit("")).alias("text"), field("style").alias("style"))


def load(files: DataFrame) -> DataFrame:
    """Cues of (track_id, path, content) files by extension, else by what they begin with."""
    ext = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    kind = F.when(ext.isin("srt", "vtt"), ext).when(ext.isin("ass", "ssa"), "ass").when(F.startswith(_content(), F.lit("WEBVTT")), "vtt").when(F.contains(_content(), F.lit("[Script Info]")), "ass").otherwise("srt")
    rows = files.withColumn("kind", kind)
    out = [f(rows.where(F.col("kind") == k)).select("track_id", "idx", "start", "end", "text") for k, f in (("srt", parse_srt), ("vtt", parse_vtt), ("ass", parse_ass))]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _joined(cues: DataFrame, line: Column, head: str) -> DataFrame:
    """One text for each track, its cues in order of idx; a track is one file, so it is one row."""
    rows = cues.withColumn("n", F.row_number().over(W.partitionBy("track_id").orderBy("idx", "start"))).withColumn("line", line)
    parts = F.array_sort(F.collect_list(F.struct("n", "line")))
    return rows.groupBy("track_id").agg(F.concat(F.lit(head), F.array_join(F.transform(parts, lambda p: p["line"]), "")).alias("content"))


def to_srt(cues: DataFrame) -> DataFrame:
    return _joined(cues, F.concat(F.col("n").cast("string"), F.lit("\n"), t.srt_time(F.col("start")), F.lit(" --> "), t.srt_time(F.col("end")), F.lit("\n"), "text", F.lit("\n\n")), "")


def to_vtt(cues: DataFrame) -> DataFrame:
    return _joined(cues, F.concat(F.col("n").cast("string"), F.lit("\n"), t.vtt_time(F.col("start")), F.lit(" --> "), t.vtt_time(F.col("end")), F.lit("\n"), "text", F.lit("\n\n")), "WEBVTT\n\n")


def to_ass(cues: DataFrame, title: str = "Untitled") -> DataFrame:
    style = F.coalesce("style", F.lit("Default")) if "style" in cues.columns else F.lit("Default")
    line = F.concat(F.lit("Dialogue: 0,"), t.ass_time(F.col("start")), F.lit(","), t.ass_time(F.col("end")), F.lit(","), style, F.lit(",,,0,0,,"), F.replace("text", F.lit("\n"), F.lit("\\N")), F.lit("\n"))
    return _joined(cues, line, ASS_HEAD.format(title=title))


def cues_at(cues: DataFrame, times: DataFrame, width: float = 10.0) -> DataFrame:
    """Cues active at each (track_id, time): start <= time < end.

    Cues are dealt to the time slots of width seconds they touch, so the interval join is an equi-join on track and slot.
    """
    slots = cues.withColumn("slot", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    points = times.withColumn("slot", F.floor(F.col("time") / width))
    return points.join(slots, ["track_id", "slot"]).where("start <= time and time < end").drop("slot")


def text_at(cues: DataFrame, times: DataFrame) -> DataFrame:
    found = cues_at(cues, times).groupBy("track_id", "time").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("p"))
    return found.select("track_id", "time", F.array_join(F.transform("p", lambda p: p["text"]), "\n").alias("text"))


def shift(cues: DataFrame, offset: float) -> DataFrame:
    return cues.withColumns({c: F.greatest(F.lit(0.0), F.col(c) + F.lit(float(offset))) for c in ("start", "end")})


def scale(cues: DataFrame, factor: float) -> DataFrame:
    return cues.withColumns({c: F.col(c) * F.lit(float(factor)) for c in ("start", "end")})


def duration(cues: DataFrame) -> DataFrame:
    return cues.groupBy("track_id").agg(F.coalesce(F.max("end"), F.lit(0.0)).alias("duration"), F.count(F.lit(1)).alias("n"))
