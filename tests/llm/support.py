"""Small tables for tests of the pipeline."""

from __future__ import annotations

import random

from pyspark.sql import SparkSession


def write_tables(spark: SparkSession, folder: str, seed: int = 7, n: int = 400) -> str:
    """documents, labels and benchmark with copies, toxic words, leaks and personal data; returns the folder."""
    r = random.Random(seed)
    syl = ["an", "er", "tion", "the", "of", "re", "st", "and", "ing", "ble"]
    word = lambda: "".join(r.choice(syl) for _ in range(r.randint(1, 4)))
    say = lambda k: [word() for _ in range(k)]
    items = [(i, " ".join(say(30))) for i in range(10)]
    docs, labels = [], []
    for i in range(n):
        w = say(r.randint(10, 120))
        kind = i % 10
        if kind == 1:
            w[3:3] = ["moron", "scum"]
        elif kind == 2 and docs:
            w = docs[r.randrange(len(docs))][1].split()
            w[0] = word()
        elif kind == 3:
            w[5:5] = items[i % 7][1].split()
        elif kind == 4:
            w[2:2] = ["mail", f"x.{i}@mail8.example.com"]
        text = " ".join(w)
        docs.append((i, text, "en", f"s{i % 4}", len(text)))
        if i % 2:
            labels.append((i, 1, int("moron" in w)))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder
