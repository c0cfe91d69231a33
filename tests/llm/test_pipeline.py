"""The pipeline's stages against brute force, each on its own input."""

import corpus_pipeline
from tests.llm.test_operators import _components, _cut, _hits


def test_stages(spark, small):
    from findwell.llm.simhash import fingerprint
    from findwell.session import saved

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "source_mixing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = saved(stage(spark, before, small), "test-stage")
        old = {r["doc_id"]: r["text"] for r in before.collect()}
        new = {r["doc_id"]: r["text"] for r in after.collect()}
        if name == "language_id":
            assert new == old  # every text is in a learnt language
        elif name == "simhash_near_dedup":
            import numpy as np

            ids = np.array(list(old))
            prints = np.array([fingerprint(t.encode()) for t in old.values()], np.uint64)
            assert set(new) == set(_components(prints, ids).tolist())
        elif name == "suffix_array_dedup":
            cut = {r[0]: r for r in _cut(list(old.items()), 200)}
            assert all(len(t.encode()) - (cut[d][1] - cut[d][2]) in range(0, 8) for d, t in new.items())
            assert all(cut[d][1] == cut[d][2] or cut[d][1] - cut[d][2] < 8 for d in set(old) - set(new))
        elif name == "benchmark_decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            assert set(new) == {r[0] for r in _hits(list(old.items()), items) if not r[-1]}
        else:
            assert after.columns == [*columns, "copy"] and set(new) <= set(old)
            continue
        assert after.columns == columns
        before = after


def test_stages_on_odd_rows(spark, small):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(1, None, None, None, None), (None, "the of and", "en", "a", 3), (2, "", "en", "a", 0), (2, "the of and by", "en", None, 3), (2, "the of and by", "en", None, 3)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, small).collect() or [], schema + (", copy long" if stage is corpus_pipeline.source_mix else ""))
        assert docs.count() >= 0
