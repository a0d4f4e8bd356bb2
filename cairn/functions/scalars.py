"""Scalar expressions: safe paths, sizes for people, labels, ratios and goals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))


def is_safe_path(path: Column) -> Column:
    """Relative, without NUL, backslash, parent steps or a drive in its first part; null is unsafe."""
    bad = (
        (path == "") | F.contains(path, F.char(F.lit(0))) | F.contains(path, F.lit("\\")) | F.startswith(path, F.lit("/"))
        | (F.size(parts(path)) == 0) | F.array_contains(F.split(path, "/"), "..") | F.contains(F.get(parts(path), F.lit(0)), F.lit(":"))
    )
    return ~F.coalesce(bad, F.lit(True))


def is_safe_member(name: Column) -> Column:
    """Member of a foreign container: backslashes count as separators."""
    return is_safe_path(F.replace(name, F.lit("\\"), F.lit("/")))


def human_bytes(n: Column) -> Column:
    """1024 steps with two decimals, exact halves to even; plain bytes with dots between thousands."""
    out = F.concat(F.replace(F.format_number(n, 0), F.lit(","), F.lit(".")), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        scaled = F.bround(n.cast("decimal(20,0)") / F.lit(1024**k).cast("decimal(18,0)"), 2)
        out = F.when(n >= 1024**k, F.concat(scaled.cast("decimal(20,2)").cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def codec_label(name: Column, level: Column) -> Column:
    return F.concat_ws(":", name, level.cast("string"))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def size_goal(megabytes: float | None) -> int | None:
    return _goal(megabytes, 1024 * 1024)


def decode_goal(milliseconds: float | None) -> int | None:
    return _goal(milliseconds, 1_000_000)


def _goal(value: float | None, unit: int) -> int | None:
    if value is not None and value <= 0:
        raise ValueError("a goal must be above zero")
    return None if value is None else int(value * unit)


def container_kind(path: Column, head: Column) -> Column:
    """Native by suffix, ZIP by its first bytes, 7z and RAR by suffix, else null."""
    low = F.lower(path)
    return (
        F.when(F.endswith(low, F.lit(".qbx")), "qbx").when(F.startswith(F.hex(head), F.lit("504B0304")), "zip")
        .when(F.endswith(low, F.lit(".7z")), "7z").when(F.endswith(low, F.lit(".rar")), "rar")
    )
