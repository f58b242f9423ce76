"""Comparing a snapshot with its base."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def annotate(head: DataFrame, base: DataFrame) -> DataFrame:
    """(target_id, status): added, modified or unchanged; removed targets and views of whole files are not reported."""
    head = head.where(~F.col("target_id").cast("string").startswith("file:"))
    b = base.select("target_id", F.col("source").alias("base_source"), F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "added").when(F.col("source").eqNullSafe(F.col("base_source")), "unchanged").otherwise("modified")
    return head.join(b, "target_id", "left").select("target_id", status.alias("status"))


def lines_outside_lcs(base: str | None, head: str | None, cap: int = 3000) -> list[int]:
    """0-based lines of ``head`` outside a longest common subsequence of lines.

    On equal lengths the base line is skipped first. An empty text is one
    empty line. Nothing is reported if the product of the line counts is over
    ``cap``, which bounds the table that is filled.
    """
    a, b = (base or "").split("\n"), (head or "").split("\n")
    if len(a) * len(b) > cap:
        return []
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i = [], 0
    for j in range(len(b)):
        while i < len(a) and a[i] != b[j] and best[i + 1][j] >= best[i][j + 1]:
            i += 1
        if i < len(a) and a[i] == b[j]:
            i += 1
        else:
            out.append(j)
    return out


def added_lines(base, head, cap: int = 3000):
    """Column of ``lines_outside_lcs``; a dynamic programme, so a pandas UDF."""

    @F.pandas_udf("array<int>")
    def run(b: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([lines_outside_lcs(x, y, cap) for x, y in zip(b, h, strict=True)])

    return run(base, head)


def annotated(head: DataFrame, base: DataFrame, language: str = "go", cap: int = 3000) -> DataFrame:
    """``annotate`` with the lines that are new in modified targets; for projects in Go only, else no rows."""
    if language != "go":
        return annotate(head, base).withColumn("added_lines", F.array().cast("array<int>")).limit(0)
    found = annotate(head, base).join(head.select("target_id", "source"), "target_id").join(base.select("target_id", F.col("source").alias("base_source")), "target_id", "left")
    modified = found.where("status = 'modified'").withColumn("added_lines", added_lines(F.col("base_source"), F.col("source"), cap))
    rest = found.where("status <> 'modified'").withColumn("added_lines", F.array().cast("array<int>"))
    return modified.unionByName(rest).select("target_id", "status", "added_lines")
