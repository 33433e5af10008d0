"""What a worker keeps when its task is over."""

import pyarrow as pa
from pyspark.sql import functions as F

from bandlake import session


def test_a_worker_gives_freed_memory_back(spark):
    def own_mb() -> int:
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(line.split()[1]) for line in f if line.startswith(("Pss_Anon:", "Pss_Shmem:"))) // 1024

    def heavy(batches):
        for batch in batches:
            held = [pa.array(["y" * 1000] * 1000) for _ in range(300)]
            yield pa.RecordBatch.from_arrays([pa.array([own_mb()] * batch.num_rows, pa.int64()), pa.array([len(held)] * batch.num_rows, pa.int64())], names=["mb", "n"])

    def light(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([own_mb()] * batch.num_rows, pa.int64()), pa.array([0] * batch.num_rows, pa.int64())], names=["mb", "n"])

    one = spark.range(1, numPartitions=1)
    during = one.transform(session.in_tasks, heavy, "mb long, n long").agg(F.max("mb")).first()[0]
    after = max(one.transform(session.in_tasks, light, "mb long, n long").agg(F.max("mb")).first()[0] for _ in range(4))
    assert during > 300 and after < during - 200
