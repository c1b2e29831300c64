from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from quarkflow.llm import common


def test_tables_go_to_the_shared_folder(spark, tmp_path, monkeypatch):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: {"spark.checkpoint.dir": f"{tmp_path}/"}.get(key, default)), sparkContext=spark.sparkContext)
    where = common.shared_dir(session)
    assert where == f"{tmp_path}/quarkflow-{spark.sparkContext.applicationId}"
    assert common.shared_dir(spark) == common.shared_dir(spark) != where
    monkeypatch.setattr(common, "shared_dir", lambda _: where)
    df = common.materialise(spark.range(5), "numbers")
    assert df.inputFiles()[0].startswith(f"file://{where}/numbers-") and df.count() == 5


def test_folds_and_hashes(spark):
    import zlib

    rows = spark.range(50).select("id", common.fold_of(F.col("id"), 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in rows)
    x = common.mix64(np.arange(10_000, dtype=np.uint64))
    assert len(np.unique(x)) == 10_000 and abs(np.unpackbits(x.view(np.uint8)).mean() - 0.5) < 0.01
