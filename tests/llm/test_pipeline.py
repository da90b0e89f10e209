import importlib
import subprocess
import sys
from pathlib import Path

from fixtures import empty_documents, odd_documents

from siftline.llm.common import written

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"


def pipeline():
    return importlib.import_module("corpus_pipeline")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(pipeline().STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    sizes = {}
    for name, stage in stages.items():
        before, docs = docs, written(stage(spark, docs, SF), name)
        sizes[name] = docs.count()
        if name != "packing":
            assert docs.columns == columns
        if name == "near_dedup":
            assert docs.join(before, columns, "left_anti").count() == 0 and docs.select("doc_id").distinct().count() == sizes[name]
    assert sizes["language_id"] == sizes["line_dedup"] >= sizes["near_dedup"]
    assert pipeline().run(spark, SF).count() == sizes["packing"]


def test_odd_and_empty_documents(spark):
    for docs in (odd_documents(spark), empty_documents(spark)):
        for name, stage in pipeline().STAGES:
            docs = written(stage(spark, docs, SF), name)
        docs.count()


def test_the_rest_works_without(tmp_path):
    """A copy without this subpackage and the pipeline still imports, and has the other queries."""
    import shutil

    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
