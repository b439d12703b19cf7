"""The corpus pipeline stage by stage against brute force."""

from collections import Counter

import pytest
from test_operators import SCHEMA, corpus, cut_lines, slow_keep, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    now = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        done = stage(spark, docs, str(tmp_path))
        assert k == 4 or done.columns == docs.columns
        done.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        now[name] = docs.collect()
    kept = [r for r in rows if len(words(r[1])) >= 50]
    assert set(r.doc_id for r in now["quality_rules"]) <= {r[0] for r in kept}
    inputs = [tuple(r) for r in now["quality_rules"]]
    assert Counter((r.doc_id, r.text) for r in now["line_dedup"]) == Counter({(a, b): n for (a, b, _), n in cut_lines(inputs).items()})
    near = [tuple(r) for r in now["line_dedup"]]
    assert {r.doc_id for r in now["simhash_near_dedup"] if r.doc_id is not None} == slow_keep(near)
    mixed = {r.doc_id for r in now["temperature_mixing"]}
    assert mixed == {r.doc_id for r in now["simhash_near_dedup"]}
    packed = Counter(r.doc_id for r in now["best_fit_packing"] if r.piece == 0)
    assert packed == Counter(r.doc_id for r in now["temperature_mixing"])
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in ran.collect()) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in now["best_fit_packing"])
