"""Column functions: frame numbers, names, times, sizes, GPS text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def parent_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)


def sibling(path: Column, name: str) -> Column:
    """Path of `name` beside `path`."""
    return F.concat(F.regexp_extract(path, r"^(.*/)?", 1), F.lit(name))


def frame_no(path: Column) -> Column:
    """Number after the first underscore of the stem; 0 if there is none or it is not a number."""
    return F.coalesce(F.get(F.split(stem(path), "_"), F.lit(1)).try_cast("bigint"), F.lit(0).cast("bigint"))


def frame_no_strict(path: Column) -> Column:
    """As frame_no, but a bad name fails the query."""
    number = F.get(F.split(stem(path), "_"), F.lit(1)).try_cast("bigint")
    return F.when(number.isNull(), F.raise_error(F.concat(F.lit("not a frame name: "), path)).cast("bigint")).otherwise(number)


def frame_time(number: Column, source_fps: float = 1.0) -> Column:
    """Seconds from the start; frame 1 is at 0."""
    return (number - 1) / F.lit(float(source_fps))


def video_id(path: Column, modified: Column) -> Column:
    """`<stem>_<epoch>`: repeatable, as the time is the file's and not the clock's."""
    return F.concat_ws("_", stem(path), F.unix_timestamp(modified).cast("string"))


def out_name(seq_no: Column) -> Column:
    return F.format_string("frame_%07d.jpg", seq_no.cast("bigint"))


def size_mb(length: Column) -> Column:
    return F.bround(length / F.lit(1048576.0), 2)


def image_estimate(length: Column) -> Column:
    """How many images a model's image file of this size is likely to hold."""
    return F.floor(length / 100).cast("bigint")


def gps_degrees(text: Column) -> Column:
    """`37 deg 46' 30.00" S` to signed degrees; plain decimals pass; anything else is null."""
    dms = r"^\s*([0-9.]+) deg ([0-9.]+)' ([0-9.]+)\" ?([NSEW])\s*$"
    part = lambda i: F.regexp_extract(text, dms, i).try_cast("double")
    value = part(1) + part(2) / 60 + part(3) / 3600
    signed = F.when(F.regexp_extract(text, dms, 4).isin("S", "W"), -value).otherwise(value)
    return F.coalesce(signed, text.try_cast("double"))


def gps_altitude(text: Column) -> Column:
    """`123.4 m Above Sea Level` to metres, negative below sea level."""
    value = F.regexp_extract(text, r"^\s*(-?[0-9.]+)", 1).try_cast("double")
    return F.when(F.lower(text).contains("below"), -value).otherwise(value)


def mentions_location(text: Column) -> Column:
    return F.lower(text).rlike("location|gps")


def path_if(keep: Column, path: Column) -> Column:
    """The path, or null where there is nothing behind it."""
    return F.when(keep, path)


def iso_now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def run_result(video: Column, source: Column, demux: Column, filtered: Column, sfm: Column, outputs: Column) -> Column:
    """The nested record of a finished run."""
    return F.struct(
        F.lit("success").alias("status"), video.alias("video_id"), source.alias("source_video"),
        F.struct(demux.alias("demux"), filtered.alias("filter"), sfm.alias("sfm")).alias("stages"),
        outputs.alias("final_outputs"),
    )
