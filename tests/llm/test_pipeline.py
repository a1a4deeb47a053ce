import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as C
from tests.llm.test_decontam import brute as leaks_by_table
from tests.llm.test_ngram_join import brute as groups_by_pairs
from textloom.llm import pii, toxicity
from tests.llm.support import write_tables


def test_stages_equal_a_plain_version(spark, tmp_path):
    sf = write_tables(spark, str(tmp_path))
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = [r.asDict() for r in C.run(spark, sf).collect()]
    model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    ids = sorted(docs)
    scores = model.score_column(pa.array([docs[i].text for i in ids], pa.string()), model.reader())
    left = [i for i, s in zip(ids, np.asarray(scores)) if s < 0.5]
    groups = groups_by_pairs([(i, docs[i].text) for i in left], 5, 80, 100)
    left = [i for i in left if groups[i][1] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {d for d, _ in leaks_by_table(items, [(i, docs[i].text) for i in left])}
    left = [i for i in left if i not in bad]
    assert 0 < len(left) < len(docs) and bad
    crf = pii.trained()
    for r in out:
        want = docs[r["doc_id"]].text
        for s, e, k in sorted(((s, e, k) for k, s, e in pii.find_spans(crf, want or "")[1]), reverse=True):
            want = want[:s] + f"<{k.upper()}>" + want[e:]
        assert r["text"] == want and r["n_chars"] == len(want)
    assert {r["doc_id"] for r in out} <= set(left)
    assert [r["position"] for r in out] == sorted(r["position"] for r in out)
    words = {i: len((docs[i].text or "").split()) for i in left}
    assert sum(len(r["text"].split()) for r in out) == pytest.approx(sum(words.values()), rel=0.2)


def test_each_stage_keeps_the_columns(spark, tmp_path):
    sf = write_tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_each_stage_scores_each_row_once(spark, tmp_path, monkeypatch):
    sf = write_tables(spark, str(tmp_path))
    seen = spark.sparkContext.accumulator(0)
    stage = C.STAGES[0][1]

    def counted(spark, docs, sf_dir):
        def rows(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return stage(spark, docs, sf_dir).mapInArrow(rows, docs.schema)

    monkeypatch.setattr(C, "STAGES", [("toxicity", counted), *C.STAGES[1:]])
    C.run(spark, sf).collect()
    assert seen.value == stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).count()
