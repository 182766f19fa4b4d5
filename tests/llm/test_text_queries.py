import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import connect, difference  # noqa: E402

from gridloom.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


def test_pipeline_keeps_its_word(spark):
    import corpus_pipeline
    from gridloom.llm import line_dedup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SF).cache()
    assert kept.columns == docs.columns
    bad = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").select("doc_id")
    assert kept.join(bad, "doc_id", "left_semi").count() <= bad.count() / 4 and kept.count() > 0.7 * docs.count()
    lines = corpus_pipeline.STAGES[1][1](spark, kept, SF)
    assert lines.columns == docs.columns and lines.count() <= kept.count()
    assert line_dedup.dedup(lines).agg({"__n_dropped": "sum"}).first()[0] == 0
    pieces = corpus_pipeline.run(spark, SF)
    total = pieces.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert total and all(r[1] == r[2] for r in total)
