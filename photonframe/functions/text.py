"""Names, codes and formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(s: Column) -> Column:
    """Lower case without anything but letters and digits."""
    return F.regexp_replace(F.lower(s), "[^a-z0-9]", "")


def slug(path: Column) -> Column:
    """Last path element, sanitised, and six hexadecimal digits of the whole path's SHA-1."""
    name = F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)
    return F.concat(F.trim(F.regexp_replace(name, r"[^A-Za-z0-9_.-]+", "_"), F.lit("_")), F.lit("-"), F.substring(F.sha1(path), 1, 6))


def split_folders(folders: Column) -> Column:
    """Distinct folders of a list, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(folders, "[|;]"), F.trim), lambda x: x != "")))


#: Dual-band filters by normalised name (fixed values).
DUALBAND = ("duoband", "dualband", "lp", "lextreme", "lenhance", "lultimate", "hao3", "hao", "alpt", "antliaalpt", "nbz", "hoo")


def is_dualband(name: Column) -> Column:
    return F.coalesce(norm(name).isin(*DUALBAND), F.lit(False))


def filter_code(name: Column) -> Column:
    """Code of the smart telescope's internal filters: VIS 0, Astro 1, Duo-Band 2; others null."""
    n = norm(name)
    return F.when(n == "vis", 0).when(n == "astro", 1).when(n == "duoband", 2)


FRAME_NAME = r"^(failed_)?(.+?)_(\d+(?:\.\d+)?)s(\d+)_([^_]+)_(\d{8}-\d{9})_(-?\d+)C\.[A-Za-z]+$"


def frame_name(name: Column) -> dict[str, Column]:
    """Fields of a frame's file name: rejected by the device, target, exposure, gain, filter, time and temperature; null where it is no such name."""
    part = lambda k, kind: F.when(name.rlike(FRAME_NAME), F.regexp_extract(name, FRAME_NAME, k)).cast(kind)
    return {"device_rejected": name.startswith("failed_"), "target": part(2, "string"), "exptime": part(3, "double"), "gain": part(4, "double"), "filter": part(5, "string"), "stamp": part(6, "string"), "temp": part(7, "double")}


def stage_key(message: Column) -> Column:
    """A progress message without its numbers and its bracketed end."""
    return F.regexp_replace(F.element_at(F.split(message, r" \("), 1), r"\d+(\.\d+)?", "#")


def version_key(version: Column) -> Column:
    """Numbers of a dotted version, to be ordered by."""
    return F.transform(F.split(F.regexp_replace(version, "[^0-9.]", ""), r"\."), lambda x: F.coalesce(x.cast("int"), F.lit(0)))


def common_names(ids: Column) -> dict[str, Column]:
    """Of pipe-separated identifiers: common names, the Messier number and the first catalogue number."""
    each = F.transform(F.split(ids, r"\|"), lambda x: F.regexp_replace(F.trim(x), r"\s+", " "))
    first = lambda pattern: F.get(F.filter(each, lambda x: x.rlike(pattern)), 0)
    return {"names": F.transform(F.filter(each, lambda x: x.startswith("NAME ")), lambda x: F.substring(x, 6, 2**31 - 1)), "messier": first(r"^M \d+$"), "ngc": first(r"^(NGC|IC) \d+")}


def shown(low: Column, high: Column) -> Column:
    """The fewest decimals (2 to 11) at which two numbers print differently."""
    scaled = lambda x, d: F.round(x * F.pow(F.lit(10.0), d), 0)
    return F.coalesce(F.get(F.filter(F.sequence(F.lit(2), F.lit(11)), lambda d: scaled(low, d) != scaled(high, d)), 0), F.lit(11))


def sexagesimal(hours: Column) -> Column:
    """Right ascension in degrees as hours, minutes and seconds."""
    total = F.round(F.pmod(hours, F.lit(360.0)) / 15 * 36000, 0).cast("long") % 864000
    return F.format_string("%02dh%02dm%04.1fs", F.floor(total / 36000), F.floor(total / 600) % 60, (total % 600) / 10.0)
