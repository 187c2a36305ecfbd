"""Column functions on dotted names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def final_name(dotted: Column) -> Column:
    return F.substring_index(dotted, ".", -1)


def head_name(dotted: Column) -> Column:
    return F.substring_index(dotted, ".", 1)


def resolved(dotted: Column, target: Column) -> Column:
    """A dotted name whose head is an alias of ``target``: the target in the head's place; without a target as it is."""
    rest = F.regexp_extract(dotted, r"^[^.]*(\..*)?$", 1)
    return F.coalesce(F.concat(target, rest), dotted)


def is_core_test_path(path: Column) -> Column:
    return path.rlike(r"(^|/)tests/|(^|/)test_[^/]*$|(^|/)conftest\.py$")


def is_text_test_path(path: Column) -> Column:
    """The wider rule of text ratchets."""
    return path.rlike(r"(^|/)tests?/|(^|/)test_[^/]*$|(^|/)conftest\.py$|_test\.(py|dart)$")
