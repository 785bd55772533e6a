"""Path functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent_dir(path: Column) -> Column:
    """Directory of a path: `.` without one, `/` at the root; repeated and trailing slashes don't count."""
    plain = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "(?<=.)/$", "")
    head = F.regexp_extract(plain, r"^(.*)/[^/]*$", 1)
    return F.when(plain == "/", F.lit("/")).when(~F.contains(plain, F.lit("/")), F.lit(".")).otherwise(F.when(head == "", F.lit("/")).otherwise(head))


def file_stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot belongs to the name."""
    name = F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"([^/]*)$", 1)
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")
