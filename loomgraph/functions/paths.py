"""Column expressions on file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def module_key(file: Column) -> Column:
    """The first two segments, the only one, or 'root' for an empty path."""
    seg = F.split(file, "/")
    return F.when((file == "") | file.isNull(), F.lit("root")).when(F.size(seg) >= 2, F.concat_ws("/", seg[0], seg[1])).otherwise(file)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1))
