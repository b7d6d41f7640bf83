"""The store that fs_write makes holds every feature."""

from tidemark.operators import features as fs
from tidemark.plans import named_queries as nq

D = "/root/testdata/sf0.001"


def test_all_features_are_written(spark, monkeypatch):
    paths, write = [], fs.write_values
    monkeypatch.setattr(fs, "write_values", lambda values, path, rules: paths.append(path) or write(values, path, rules))
    assert nq.fs_write(spark, D).count() == 2
    names = lambda df: {r["feature_name"] for r in df.select("feature_name").distinct().collect()}
    assert names(spark.read.parquet(paths[0])) == names(spark.read.parquet(f"{D}/feature_values.parquet"))
