"""Extraction templates: one projection per field, compiled to native expressions."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def java_pattern(pattern: str) -> str:
    """A template's pattern under Java's rules: lines count for ^ and $, digits and white space are Unicode, \\Z is the very end."""
    return "(?mU)" + re.sub(r"(\\\\)|\\Z", lambda m: m[1] or r"\z", pattern)


def _blank_as_null(c: Column) -> Column:
    c = F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")
    return F.when(c != "", c)


def field(text: Column, spec: dict) -> Column:
    """struct(label, value array, confidence, passed) of one field of a template.

    A string field holds the first group with text of the first match, else the match: 0.9 sure if
    longer than 3 characters, else 0.75. A list field holds all distinct matches in order: 0.7 sure and
    0.1 more for each of at most 3.
    """
    pattern, groups = spec["pattern"], re.compile(spec["pattern"], re.MULTILINE).groups
    rx = F.lit(java_pattern(pattern))
    if spec.get("type", "string") == "list":
        columns = [F.regexp_extract_all(text, rx, F.lit(g)) for g in (range(1, groups + 1) if groups else [0])]
        if groups > 1:
            joined = F.transform(F.arrays_zip(*[c.alias(f"g{i}") for i, c in enumerate(columns)]), lambda z: F.concat_ws(" ", *[_blank_as_null(z[f"g{i}"]) for i in range(groups)]))
        else:
            joined = columns[0]
        value = F.array_distinct(F.filter(F.transform(joined, _blank_as_null), lambda v: v.isNotNull()))
        sure = F.when(F.size(value) > 0, F.round(F.lit(0.7) + F.lit(0.1) * F.least(F.size(value), F.lit(3)), 2)).otherwise(0.0)
    else:
        found = F.coalesce(*[_blank_as_null(F.regexp_extract(text, java_pattern(pattern), g)) for g in [*range(1, groups + 1), 0]])
        value = F.when(found.isNotNull(), F.array(found)).otherwise(F.array().cast("array<string>"))
        sure = F.when(found.isNull(), 0.0).when(F.length(found) > 3, 0.9).otherwise(0.75)
    return F.struct(
        F.lit(spec.get("label", spec["name"])).alias("label"), F.coalesce(value, F.array().cast("array<string>")).alias("value"),
        F.coalesce(sure, F.lit(0.0)).alias("confidence"), F.coalesce(sure >= spec.get("confidence_threshold", 0.7), F.lit(False)).alias("passed"),
    )


def extract(docs: DataFrame, template: dict, column: str = "text") -> DataFrame:
    """docs with fields (a map by name) and overall_confidence, the share of fields found."""
    specs = template["fields"]
    pairs = [x for s in specs for x in (F.lit(s["name"]), field(F.col(column), s))]
    out = docs.withColumn("fields", F.create_map(*pairs))
    found = F.size(F.filter(F.map_values("fields"), lambda f: F.size(f["value"]) > 0))
    return out.withColumn("overall_confidence", F.round(found / F.lit(max(1, len(specs))), 2))


def summary(fields: Column, title: str) -> Column:
    """A Markdown table of extracted fields."""
    safe = lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    row = lambda f: F.concat(F.lit("| **"), f["label"], F.lit("** | "), F.when(F.size(f["value"]) > 0, safe(F.array_join(f["value"], ", "))).otherwise("—"), F.lit(" | "), F.floor(f["confidence"] * 100 + 1e-9).cast("string"), F.lit("% |"))
    head = F.array(F.lit(f"## {title}"), F.lit("| Field | Value | Confidence |"), F.lit("| :--- | :--- | :---: |"))
    return F.array_join(F.concat(head, F.transform(F.map_values(fields), row)), "\n")
