"""The pipeline's stages on a small folder, each held against its own input."""

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tidemark.llm import mixing, near_copies, toxicity  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, make, prose, tmp_path_factory):
    rng, rows, labels = np.random.default_rng(1), [], []
    for i, t in enumerate(prose(20, 260, 30, 80)):
        toxic = i % 6 == 0
        rows.append((i, t + " moron moron moron" * toxic))
        if i % 8:
            labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[7 * i + 1][1]) for i in range(20)] + [(2000, None), (2001, ""), (2002, "")]
    path = tmp_path_factory.mktemp("sf")
    make(rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "mixing", "bpe"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if name != "bpe" else before
        docs = corpus_pipeline.written(stage(spark, docs, folder))
        rows = docs.collect()
        seen[name] = [r.doc_id for r in rows]
        if name == "bpe":
            assert sorted(seen["bpe"]) == sorted(seen["mixing"]) and docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            break
        assert docs.columns == columns and all(before[r.doc_id] == r.text for r in rows)
        if name == "toxicity":
            toxic = [i for i in before if i < 260 and i % 6 == 0]
            clean = [i for i in before if i < 260 and i % 6]
            assert sum(i in seen[name] for i in toxic) <= 0.05 * len(toxic) and sum(i in seen[name] for i in clean) >= 0.97 * len(clean)
        if name == "exact_dedup":
            assert sorted(seen[name]) == sorted({t or "": i for i, t in sorted(before.items())}.values())
        if name == "simhash_dedup":
            sets = {i: near_copies.shingles(t, 5) for i, t in before.items()}
            lowest = [i for i in sets if not any(j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in sets)]
            assert sorted(seen[name]) == sorted(lowest)
    assert len(seen["mixing"]) > 20


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 20 and "ids_sha256" in out.columns and corpus_pipeline.ORACLE_SQL is None
    assert mixing.PLAN.budget_num < mixing.PLAN.budget_den and toxicity.THRESHOLD == 0.3
