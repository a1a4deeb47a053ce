"""Files of any supported kind as rows of Markdown."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.slices import slices
from textloom.sources import formats, info, registry

SLICE_BYTES = 1 << 20  # of pages that are held as Python objects at once
SCHEMA = "path string, name string, size long, markdown string, title string, success boolean, error string"


def scan(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, content and length of files, subfolders included."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "content", "length")


def convert(files: DataFrame, readers: registry.Registry | None = None, **options) -> DataFrame:
    """One row a file (path, content, length; where present also url, mimetype, charset): Markdown and title, or success = false and the error.

    Readers are tried in rank over the guesses of what the file is. Never raises for a file; a null content is empty.
    """
    use = readers or registry.default()
    facts = [c for c in ("url", "mimetype", "charset") if c in files.columns]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                path = row["path"]
                name = path.rsplit("/", 1)[-1]
                known = info.of_path(name).merge(info.Info(**{k: v for k in facts if isinstance(v := row[k], str)}))
                try:
                    text, title, _ = use.convert(bytes(row["content"] or b""), known, **options)
                    out.append((path, name, row["length"], text, title, True, None))
                except ValueError as e:
                    kind = "unsupported" if isinstance(e, formats.Unsupported) else "failed"
                    out.append((path, name, row["length"], None, None, False, f"{kind}: {e}"))
            yield pd.DataFrame(out, columns=["path", "name", "size", "markdown", "title", "success", "error"])

    return files.select("path", "content", "length", *facts).mapInPandas(run, SCHEMA)


def html_to_markdown(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with markdown and title of an HTML column; null stays null. Columns of these names are replaced."""
    own = [f for f in pages.schema if f.name.lower() not in ("markdown", "title")]
    names = [f.name for f in own]

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.schema.names.index("__html"), SLICE_BYTES):
                got = [(None, None) if h is None else formats.read_html(h.encode()) for h in part.column("__html").to_pylist()]
                made = [pa.array([formats.normalize(m) if m is not None else None for m, _ in got], pa.string()), pa.array([t for _, t in got], pa.string())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *made], names=[*names, "markdown", "title"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + ", markdown string, title string"
    return pages.select(*[F.col(f"`{c}`") for c in names], F.col(column).cast("string").alias("__html")).mapInArrow(run, schema)


def route(names: DataFrame) -> DataFrame:
    """names (name) with extension and reader: the rank-1 entry of the registry, null for unsupported."""
    table = F.create_map(*[F.lit(x) for e, r in formats.READERS.items() for x in (e, r[0].__name__)])
    ext = F.lower(F.regexp_extract("name", "(\\.[^./]+)$", 1))
    return names.withColumn("extension", ext).withColumn("reader", table[F.col("extension")])
