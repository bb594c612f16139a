"""Path pieces as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def strip_extension(path: Column) -> Column:
    """Drop the last extension; a leading dot does not start one."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(?<=[^/])(\.[^./]*)$", 1))


def stem(path: Column) -> Column:
    return strip_extension(basename(path))


def strip_prefix(path: Column, prefix: Column | str) -> Column:
    """Path relative to the input folder, without a leading slash."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    rest = F.when(path.startswith(p), F.substring(path, F.length(p) + 1, F.length(path))).otherwise(
        path
    )
    return F.regexp_replace(rest, "^/", "")


def folders(path: Column) -> Column:
    """Directory names above the file, outermost first, empty levels dropped."""
    parts = F.split(path, "/")
    return F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: x != "")


def with_folder_columns(df: DataFrame, depth: int, path: str = "video_path") -> DataFrame:
    """Add ``folder1`` .. ``folder<depth>``; levels a path does not have stay null."""
    parts = folders(F.col(path))
    return df.withColumns(
        {f"folder{i + 1}": F.get(parts, F.lit(i)) for i in range(depth)}
    )


def folder_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("folder")]


def video_key(path: Column, chapters: bool = False) -> Column:
    """Path without extension; with chapters, its parent folder."""
    bare = strip_extension(path)
    return dirname(bare) if chapters else bare


def natural_number(name: Column) -> Column:
    """First number in a name, 0 when it has none or is too long to be one."""
    return F.coalesce(F.regexp_extract(name, r"(\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def deployment_id(path: Column, marker: str = "BRUV") -> Column:
    """``<marker folder>_<next part>``, or the parent folder when no folder has the marker."""
    parts = F.split(path, "/")
    above = F.slice(parts, F.lit(1), F.size(parts) - 1)
    at = F.array_position(F.transform(above, lambda x: x.contains(marker)), F.lit(True)).cast("int")
    return F.when(
        at > 0, F.concat(F.get(parts, at - 1), F.lit("_"), F.get(parts, at))
    ).otherwise(F.coalesce(F.get(parts, F.size(parts) - 2), F.lit("")))


def zero_pad(text: Column, width: int) -> Column:
    """Left pad with zeros; longer text is kept whole."""
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def zero_pad_number(number: Column, width: int) -> Column:
    """Whole number with leading zeros; a minus sign comes first and counts."""
    text = number.cast("string")
    return F.when(number < 0, F.concat(F.lit("-"), zero_pad(F.ltrim(text, F.lit("-")), width - 1))).otherwise(
        zero_pad(text, width)
    )


def thumbnail_name(station: Column, video_id: Column, track_id: Column) -> Column:
    number = zero_pad(F.replace(station, F.lit("BRUV "), F.lit("")), 3)
    return F.concat(
        F.lit("BRUV_"), number, F.lit("_"), video_id, F.lit("_"), track_id.cast("string"), F.lit(".jpg")
    )


def station_folder(station: Column) -> Column:
    """``BRUV 007`` as the folder is written on disk: ``BRUV 7``."""
    number = F.replace(station, F.lit("BRUV "), F.lit("")).try_cast("bigint")
    return F.concat(F.lit("BRUV "), number.cast("string"))
