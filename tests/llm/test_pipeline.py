import os
import subprocess
import sys

import corpus_pipeline
from tests.llm import edge

REPO = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


def planted(spark, folder):
    """Tables with an exact copy, a near copy, a benchmark passage, toxic texts and a secret among clean documents."""
    clean = [(1000 + i, edge.words(10_000 + i, 80), "en", "ab"[i % 2], 0) for i in range(120)]
    toxic = [(2000 + i, edge.words(300 + i, 30) + " zgrobl wuffpack zgrobl " + edge.words(400 + i, 30), "en", "a", 0) for i in range(40)]
    near = edge.words(10_003, 80).split()
    near[40] = "changed"
    item = edge.words(900, 30)
    more = [(3000, edge.words(10_002, 80), "en", "a", 0), (3001, " ".join(near), "en", "b", 0), (3002, edge.words(500, 40) + " " + item + " " + edge.words(501, 40), "en", "a", 0), (3003, edge.words(502, 60) + " password=hunter2hunter2", "en", "b", 0)]
    edge.docs(spark, clean + toxic + more).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    edge.labels(spark, [(r[0], 1, int(r[0] >= 2000)) for r in clean + toxic]).write.parquet(f"{folder}/labels.parquet")
    return clean


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    clean = planted(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, columns = {}, docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{i}")
        docs = spark.read.parquet(f"{tmp_path}/out{i}")
        kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert name == "mix_sources" or docs.columns == columns
    ids = {r[0] for r in clean}
    assert not any(2000 <= (x or 0) < 3000 for x in kept["toxicity"]) and ids <= set(kept["toxicity"])
    assert not {3000, 3001} & set(kept["near_dedup"]) and ids <= set(kept["near_dedup"])
    assert set(kept["near_dedup"]) - set(kept["decontamination"]) == {3002}
    assert sorted(kept["secret_scan"], key=str) == sorted(kept["decontamination"], key=str)
    masked = spark.read.parquet(f"{tmp_path}/out3").filter("doc_id = 3003").collect()[0]
    assert masked["text"].endswith(" [SECRET]") and masked["n_chars"] == len(masked["text"])


def test_empty_documents(spark, tmp_path):
    planted(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_run_equals_its_stages(spark, tmp_path):
    planted(spark, tmp_path)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns[-1] == "copy" and out.count() > 100


def test_workers_need_no_package(tmp_path):
    """A session started elsewhere, whose Python workers can't import the repository."""
    code = f"""
import sys
sys.path.insert(0, {REPO!r})
from tidewater.session import local_session
import __spark_entry__ as E
spark = local_session(cores="2", shuffle_partitions=2)
for name in ("op2_quality_knn", "op10_secrets", "recommend_products"):
    print(name, E.queries()[name](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "op10_secrets 200" in done.stdout
