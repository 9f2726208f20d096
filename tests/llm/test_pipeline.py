import random

import corpus_pipeline
from llm.samples import docs
from llm.test_packing import contract
from llm.test_quality import brute
from tidemark.llm import queries
from tidemark.llm.components import components


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 5), (5, 1000), (3, 3), (20, 21), (21, 20)] + [(k, k + 1) for k in range(100, 140)] + [(300, k) for k in range(301, 340)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 1 for k in (1, 2, 3)) and all(got[k] == 5 for k in (5, 7, 8, 9, 1000)) and got[21] == got[20] == 20
    assert all(got[k] == 100 for k in range(100, 141)) and all(got[k] == 300 for k in range(300, 340))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stages(spark, tmp_path):
    rnd = random.Random(3)
    good = [" ".join(f"w{rnd.randrange(14)}" for _ in range(100)) for _ in range(40)]
    junk = [" ".join(f"w{rnd.randrange(14)}###" for _ in range(100)) for _ in range(10)]
    near = [" ".join([*t.split()[:99], "changed"]) for t in good[:5]]
    texts = good + junk + [t.replace(" ", "  ") for t in good[5:9]] + near + ["too short", None, ""]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(0, 40, 2)] + [(k, 0, 0) for k in range(40, 50)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf_dir, at = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, sf_dir)
        if k < 4:
            assert out.columns == at.columns
            out.write.parquet(str(tmp_path / f"stage-{k}"))
            at = spark.read.parquet(str(tmp_path / f"stage-{k}"))
            seen.append({r.doc_id for r in at.collect()})
    clean = {k for k, t in enumerate(texts) if not brute(t)[5]}
    assert seen[0] == clean - set(range(40, 50))
    assert seen[1] == seen[0] - {50, 51, 52, 53}
    assert seen[2] == set(range(40))
    assert seen[3] <= seen[2] and len(seen[3]) >= 36
    kept = sorted(seen[3])
    contract(out.collect(), [texts[k] for k in kept], kept, 4096)
    rows = queries.pipeline(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == seen[3]


def test_empty_documents(spark, tmp_path):
    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
