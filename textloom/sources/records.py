"""Sources of glossaries, memories, sentence pairs, templates and folder trees."""

from __future__ import annotations

import glob
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import templates

TEMPLATES = os.path.join(os.path.dirname(__file__), "templates")
#: Folders that a tree leaves out; fixed values.
IGNORED = [".git", "__pycache__", ".venv", "node_modules", ".idea", ".vscode"]


def glossary(spark: SparkSession, paths: str | list[str], domain: str | None = None) -> DataFrame:
    """term, translation, domain, case_sensitive, file of CSV glossaries (header row; UTF-8 with or without a mark). Rows without a term or a translation go."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(paths)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    cell = lambda c, other="": F.trim(F.coalesce(F.col(c), F.lit(other))) if c in rows.columns else F.lit(other)
    out = rows.select(
        cell("term").alias("term"), cell("translation").alias("translation"), (F.lit(domain) if domain else cell("domain", "general")).alias("domain"),
        F.lower(cell("case_sensitive", "false")).isin("true", "1", "yes").alias("case_sensitive"), F.col("_metadata.file_path").alias("file"),
    )
    return out.where("term != '' and translation != ''")


def merged(entries: DataFrame, order: list[Column]) -> DataFrame:
    """One entry a key (the term, lower-cased unless its case counts): the last by order."""
    key = F.when(F.col("case_sensitive"), F.col("term")).otherwise(F.lower("term"))
    return entries.groupBy(key.alias("key")).agg(F.max_by(F.struct("term", "translation", "domain", "case_sensitive"), F.struct(*order)).alias("e")).select("key", "e.*")


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """Translation memory of a JSON array: source_text, target_text, direction ('en->bn' if absent), approved_by."""
    schema = "source_text string, target_text string, direction string, approved_by string, timestamp string"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.where("source_text is not null and target_text is not null").select(
        "source_text", "target_text", F.coalesce("direction", F.lit("en->bn")).alias("direction"), F.coalesce("approved_by", F.lit("import")).alias("approved_by"), "timestamp"
    )


def write_memory(memory: DataFrame, path: str) -> None:
    """Memory rows as JSON lines, which read_memory reads too."""
    memory.write.mode("overwrite").json(path)


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """id, domain, bn, en of tab-separated lines with three or four and more columns; blank lines, comments and the header go."""
    rows = spark.read.text(path).select(F.trim("value").alias("line")).where("line != '' and not startswith(line, '#') and not startswith(line, 'id\t')")
    rows = rows.select(F.split("line", "\t", -1).alias("c")).where("size(c) >= 3")
    four = F.size("c") > 3
    at = lambda i: F.get("c", F.lit(i))
    return rows.select(at(0).alias("id"), F.when(four, at(1)).otherwise("general").alias("domain"), F.when(four, at(2)).otherwise(at(1)).alias("bn"), F.when(four, at(3)).otherwise(at(2)).alias("en"))


def list_templates(folder: str = TEMPLATES) -> list[dict]:
    """Extraction templates of a folder, by name of their files."""
    return [templates.load(f) for f in sorted(glob.glob(os.path.join(folder, "*.json")))]


def template(name: str, folder: str = TEMPLATES) -> dict:
    """The template of this id or file name."""
    for f in sorted(glob.glob(os.path.join(folder, "*.json"))):
        got = templates.load(f)
        if name in (got.get("template_id"), os.path.splitext(os.path.basename(f))[0]):
            return got
    raise KeyError(name)


def tree(files: DataFrame, root: str, depth: int = 5) -> DataFrame:
    """path, name, parent, is_dir, depth, size, place of files (path, length) below a root and of their folders.

    Ignored folders and their content go, as does what lies deeper than depth folders. place orders a folder's entries: folders first, then by lower-cased name.
    """
    inside = F.regexp_replace(F.substring(F.col("path"), F.lit(len(root.rstrip("/")) + 2), F.length("path")), "/+$", "")
    rows = files.where(F.startswith("path", F.lit(root.rstrip("/") + "/"))).select(F.split(inside, "/").alias("p"), F.col("length").alias("size"))
    rows = rows.where(~F.arrays_overlap("p", F.array(*[F.lit(x) for x in IGNORED])))
    levels = F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.struct(F.array_join(F.slice(F.col("p"), F.lit(1), i), "/").alias("path"), F.element_at("p", i).alias("name"), (i - 1).alias("depth"), (i < F.size("p")).alias("is_dir")))
    rows = rows.select(F.explode(levels).alias("e"), "size").select("e.*", F.when(~F.col("e.is_dir"), F.col("size")).alias("size")).where(F.col("depth") <= depth)
    rows = rows.groupBy("path", "name", "depth", "is_dir").agg(F.max("size").alias("size"))
    rows = rows.withColumn("parent", F.regexp_replace("path", "/?[^/]*$", ""))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("parent").orderBy(~F.col("is_dir"), F.lower("name"), "name"))
    return rows.select("path", "name", "parent", "is_dir", "depth", "size", place.cast("long").alias("place"))


def inside_root(path: Column, root: str) -> Column:
    """Whether a path stays below a root once its dots are resolved."""
    step = lambda a, p: F.when(p == "..", F.when(F.size(a) > 0, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array(F.lit("..")))).when(p.isin("", "."), a).otherwise(F.concat(a, F.array(p)))
    resolved = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    base = root.strip("/")
    return (resolved == base) | F.startswith(resolved, F.lit(base + "/"))
