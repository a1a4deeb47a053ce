"""Results as Markdown files and as archives of them."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_markdown(results: DataFrame, folder: str) -> None:
    """Successful results (name, markdown) as text files, one folder a name, and failed ones' names and errors in _errors as JSON lines.

    Spark writes both, so any shared file system will do.
    """
    good = F.coalesce(F.col("success"), F.lit(False))
    results.where(good).select(F.regexp_replace("name", "\\.[^.]+$", "").alias("name"), F.col("markdown").alias("value")).write.mode("overwrite").option("lineSep", "\n").partitionBy("name").text(f"{folder}/markdown")
    results.where(~good).select("name", "error").write.mode("overwrite").json(f"{folder}/_errors")


def zip_bundles(results: DataFrame, per_bundle: int = 1000) -> DataFrame:
    """bundle, converted, errors, content: archives of at most about per_bundle results (name, markdown, success, error).

    A bundle holds a .md file for each success (a second one of a name gets a number) and, where some but not all failed, _errors.txt;
    its content is null where nothing was converted. Results are dealt by hash of their name.
    """
    n = results.count()
    bundles = max(1, -(-n // per_bundle))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name")
        out, used, errors = io.BytesIO(), {}, []
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for row in pdf.itertuples():
                if row.success and row.markdown:
                    stem = row.name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                    used[stem] = used.get(stem, 0) + 1
                    z.writestr(zipfile.ZipInfo(f"{stem}{'' if used[stem] == 1 else f'_{used[stem]}'}.md"), row.markdown)
                else:
                    errors.append(f"{row.name}: {row.error or 'Conversion failed'}")
            done = sum(used.values())
            if errors and done:
                z.writestr(zipfile.ZipInfo("_errors.txt"), "\n".join(errors))
        return pd.DataFrame({"bundle": [pdf["__b"].iloc[0]], "converted": [done], "errors": [len(errors)], "content": [out.getvalue() if done else None]})

    rows = results.select("name", "markdown", "success", "error").withColumn("__b", F.pmod(F.xxhash64("name"), F.lit(bundles)).cast("int"))
    return rows.groupBy("__b").applyInPandas(pack, "bundle int, converted long, errors long, content binary")
