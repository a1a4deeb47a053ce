"""Table functions: one document to many rows."""

from __future__ import annotations

import io
import re
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BinaryType, LongType, StringType, StructType


@udtf(returnType=StructType().add("line", LongType()).add("level", LongType()).add("title", StringType()).add("body", StringType()))
class Sections:
    """Sections of a Markdown text: its headings with the lines below them; text before the first has level 0."""

    def eval(self, text: str):
        if text is None:
            return
        at, level, title, body = 0, 0, "", []
        for n, line in enumerate(text.split("\n")):
            m = re.match(r"(#{1,6}) (.*)", line)
            if m:
                if level or any(x.strip() for x in body):
                    yield at, level, title, "\n".join(body)
                at, level, title, body = n, len(m[1]), m[2].strip(), []
            else:
                body.append(line)
        if level or any(x.strip() for x in body):
            yield at, level, title, "\n".join(body)


@udtf(returnType=StructType().add("place", LongType()).add("name", StringType()).add("size", LongType()).add("content", BinaryType()))
class Members:
    """Files of an archive in order; nothing for other bytes."""

    def eval(self, content: bytes):
        try:
            with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                for n, entry in enumerate(e for e in z.infolist() if not e.is_dir()):
                    yield n, entry.filename, entry.file_size, z.read(entry)
        except zipfile.BadZipFile:
            return


def register(spark: SparkSession) -> None:
    """The table functions under SQL names: markdown_sections(text), archive_members(content)."""
    spark.udtf.register("markdown_sections", Sections)
    spark.udtf.register("archive_members", Members)
