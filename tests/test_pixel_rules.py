"""The watched cubes draw their bytes by the same arithmetic as the SQL."""

import duckdb
import numpy as np

import __spark_entry__


def test_bytes_of_values_at_hundredths(spark, tmp_path):
    """0.29 as a 32-bit float is below 0.29, but its 32-bit product with 100 is 29."""
    at = (np.arange(-320, 320) / 100).astype(np.float32)
    assert (np.floor(at * np.float32(100)) != np.floor(at.astype(np.float64) * 100)).any()
    vectors = np.concatenate((at, np.nextafter(at, np.float32(9)), np.nextafter(at, np.float32(-9)))).reshape(-1, 64)
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").write.parquet(path)
    found = duckdb.connect()
    found.execute(f"CREATE VIEW embeddings AS FROM '{path}/*.parquet'")
    for name in ("t10_incremental_pyramids", "s5_read_raster"):
        got = __spark_entry__.queries()[name](spark, str(tmp_path))
        want = found.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
