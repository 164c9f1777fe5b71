from __future__ import annotations

import corpus_pipeline
from marquee.llm.common import table
from tests.llm.conftest import junk, prose


def test_stages_on_planted_rows(spark, labelled, docs, tmp_path):
    base, labels = labelled
    extra = spark.createDataFrame(
        [(2000, prose(1, 60), "en", "s1", 1), (2001, prose(1, 60), "en", "s2", 1),
         (2002, junk(77, 80), "en", "s1", 1), (2003, "too short", "en", None, 1)], base.schema)
    whole = base.unionByName(extra).unionByName(docs.select(*base.columns))
    whole.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = table(spark, str(tmp_path), "documents")
    after = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, str(tmp_path))
        assert rows.columns == base.columns
        path = f"{tmp_path}/{name}"
        rows.write.parquet(path)
        rows = spark.read.parquet(path)
        after.append([r["doc_id"] for r in rows.collect()])
    rules, classified, single, mixed = after
    assert {1, 2000, 2001} <= set(rules) and not {2002, 2003, 0, None} & set(rules)
    assert set(classified) <= set(rules) and len(classified) > 0.9 * len(rules)
    assert {1, 2000, 2001} & set(single) == {1}
    assert set(mixed) <= set(single)
    coded = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in coded) == sorted(mixed)
    assert all(r["round_trip"] and r["n_tokens"] * 4 == len(r["ids"]) for r in coded)
