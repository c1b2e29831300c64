import json

import pytest
from pyspark.sql import functions as F

from quarkflow.sources import readers, sinks


@pytest.fixture
def folder(spark, tmp_path):
    for name, n in (("qcd_a", 3), ("qcd_b", 4), ("wjet", 5)):
        spark.range(n).withColumn("PFCands_pt", F.array(F.col("id") * 1.0)).withColumn("PFCands_eta", F.array(F.lit(0.5))).coalesce(1).write.parquet(str(tmp_path / "raw" / name))
    return str(tmp_path)


def test_listing_and_reading(spark, folder):
    path = f"{folder}/raw"
    assert readers.list_files(spark, path, "parquet").count() == 3
    assert readers.read_tables(spark, path, recursive=True).count() == 12
    df = readers.read_tables(spark, path, recursive=True, name_part="part-")
    assert sorted(r.n for r in readers.entry_counts(df, 4).collect()) == [3, 4, 4] and readers.capped(df, 2, "id").count() == 6
    assert readers.branch(df, "PFCands_pt").count() == 12 and readers.branches(df, "PFCands_") == ["PFCands_pt", "PFCands_eta"]
    z = readers.collection(df, "PFCands", "parts", ("pt",)).where("id = 2").first()
    assert z.parts[0]["pt"] == 2.0 and z.parts[0]["eta"] == 0.5
    with pytest.raises(ValueError):
        readers.collection(df, "PFCands", "parts", ("phi",))
    with pytest.raises(ValueError):
        readers.read_tables(spark, path, extension="pkl")


def test_paths_and_ranges(folder):
    assert readers.default_path(None, "x") == "x" and readers.default_path("raw", folder).endswith("raw")
    with pytest.raises(FileNotFoundError):
        readers.default_path("nothing", folder)
    assert readers.entry_ranges(10, 4) == [(0, 2), (2, 5), (5, 7), (7, 10)] and readers.entry_ranges(1, 4) == [(0, 1)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 0.5), (2, 1, 0.7)], "id long, label int, score double")
    out = str(tmp_path / "t")
    assert sinks.write_once(df, out) and not sinks.write_once(df, out)
    (tmp_path / "half").mkdir()
    with pytest.raises(FileExistsError):
        sinks.write_once(df, str(tmp_path / "half"))
    sinks.write_table(df, str(tmp_path / "parts"), "label", sort_by="score")
    assert spark.read.parquet(str(tmp_path / "parts")).where("label = 1").count() == 1
    sinks.write_csv(df, str(tmp_path / "c"))
    assert readers.read_sweep(spark, str(tmp_path / "c"), "id long, label int, score double").count() == 2
    sinks.write_scores(df, str(tmp_path / "s"), "id", "label", "score")
    for i in (1, 2):
        sinks.write_summary(spark, {"auc": 0.5 + i, "epochs": i} | ({"extra": True} if i == 2 else {}), str(tmp_path / "runs" / f"r{i}" / "summary.json"))
    assert json.loads((tmp_path / "runs/r1/summary.json").read_text())["epochs"] == 1
    assert readers.read_summaries(spark, str(tmp_path / "runs")).where("extra is null").count() == 1
    moved = sinks.move_used(spark, str(tmp_path / "runs" / "r1" / "summary.json"))
    assert moved.endswith("r1/used/summary.json") and sinks.exists(spark, moved)
