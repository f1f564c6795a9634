"""Repository URL → (owner, repo)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sanitize(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "-")


def owner_repo(url: Column) -> tuple[Column, Column]:
    """Drop ``.git`` (any case) then trailing slashes; last two of the parts split on ``/`` and ``:``."""
    clean = F.regexp_replace(F.regexp_replace(url, r"(?i)\.git\z", ""), r"/+\z", "")
    parts = F.filter(F.split(clean, "[/:]"), lambda p: p != "")
    n = F.size(parts)
    repo = F.when(n >= 1, F.element_at(parts, F.greatest(n, F.lit(1)))).otherwise(F.lit("repo"))
    owner = F.when(n >= 2, F.element_at(parts, F.greatest(n - 1, F.lit(1)))).otherwise(F.lit("owner"))
    return _sanitize(owner), _sanitize(repo)
