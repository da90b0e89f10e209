"""The run store's files: as many for a save as there are folders, however many sites."""

from pathlib import Path

from pyspark.sql import functions as F

from siftline.sources import runs


def test_files_do_not_grow_with_sites(spark, tmp_path):
    folder = f"file://{tmp_path}/runs"
    n = F.col("id")
    audits = spark.range(0, 3000, 1, 8).select(n.cast("string").alias("run_id"), F.lit("2").alias("saved_at"), F.lit("1").alias("completed_at"), F.concat(F.lit("S"), (n % 600).cast("string")).alias("site"))
    runs.save(audits.where("id % 2 = 0"), folder)
    runs.save(audits, folder)
    assert len(list(Path(tmp_path, "runs").rglob("*.parquet"))) <= 2 * 256
    assert runs.read(spark, folder).columns == runs.as_runs(audits).columns
    assert runs.checked(runs.read(spark, folder)).where("warning IS NULL").select("run_id").distinct().count() == runs.read(spark, folder).count() == 3000
    assert sorted(r.run_id for r in runs.of_site(spark, folder, "s7").collect()) == sorted(str(x) for x in range(7, 3000, 600))
