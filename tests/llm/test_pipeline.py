"""The pipeline's stages in order, each held against its operator's own results."""

import corpus_pipeline as C
from kestrel.llm import decontaminate, mixing, neardup, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    assert [n for n, _ in C.STAGES] == ["quality_rules", "near_dedup", "decontamination", "source_mix", "token_shards"]
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    a = C.STAGES[0][1](spark, docs, SF).cache()
    assert ids(a) == ids(quality.judge(docs, labels).where("kept"))
    b = C.STAGES[1][1](spark, a, SF).cache()
    assert ids(b) == ids(neardup.near_duplicates(a).where("kept"))
    c = C.STAGES[2][1](spark, b, SF).cache()
    leaked = {r[0] for r in decontaminate.leaks(b, bench).select("doc_id").collect()}
    assert ids(c) == [i for i in ids(b) if i not in leaked]
    d = C.STAGES[3][1](spark, c, SF).cache()
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(c).collect()}
    assert ids(d) == sorted(i for i, n in copies.items() for _ in range(n))
    assert a.columns == b.columns == c.columns == d.columns == docs.columns
    e = C.STAGES[4][1](spark, d, SF)
    assert ids(e) == ids(d)
    assert ids(C.run(spark, SF)) == ids(e)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, SF).collect() == []
