

import brute
import corpus_pipeline
from dispensa.llm import quality


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage on what its predecessor kept; the fences are the operator's own, as they come from sketches."""
    rows = [r for r in brute.corpus(8, 150) if r[0] is not None]
    spark.createDataFrame(rows, brute.SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_duplicates", "suffix_dedup", "packing"]

    got = stages["quality_rules"](spark, docs, str(tmp_path))
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    rows = [r for r in rows if r[0] in kept]
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)

    got = stages["line_dedup"](spark, got, str(tmp_path))
    want = {d: x[2] for d, x in brute.op4(rows).items()}
    now = {r.doc_id: r for r in got.collect()}
    assert got.columns == docs.columns and {d: brute.sha(r.text or "") for d, r in now.items()} == want
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in now.values()]
    assert all(r[4] == len(r[1] or "") for r in rows)

    got = stages["near_duplicates"](spark, got, str(tmp_path))
    parts = brute.op10(rows)
    rows = [r for r in rows if parts[r[0]][1] == r[0]]
    assert {r.doc_id for r in got.collect()} == {r[0] for r in rows} and got.columns == docs.columns

    got = stages["suffix_dedup"](spark, got, str(tmp_path))
    removed = brute.op1(rows)
    for r in got.collect():
        n = len(r.text.encode())
        assert 0 <= n - (removed[r.doc_id][0] - removed[r.doc_id][1]) <= 6 * max(1, removed[r.doc_id][2])
    ids = {r.doc_id for r in got.collect()}

    packed = stages["packing"](spark, got, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == ids
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda x: {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in x}
    assert key(run) == key(packed)

