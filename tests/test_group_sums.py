import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tileflow.operators import group_sums, priors


@pytest.mark.parametrize("held", [0, 200, 1 << 20])
def test_sums_of_a_hot_group_null_keys_and_null_vectors(spark, held):
    """``held`` of 0 sends the sums after every batch."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        key = rng.choice(["hot", "hot", None, f"k{rng.randrange(40)}"])
        vec = None if key == "k7" or rng.random() < 0.1 else [float(rng.randrange(9)) for _ in range(5)]
        rows.append((key, rng.choice([1.5, math.nan]), vec))
    want = defaultdict(lambda: [0, [0.0] * 5])
    for key, number, vec in rows:
        group = want[key, str(number)]
        if vec:
            group[0] += 1
            group[1] = [a + b for a, b in zip(group[1], vec)]
    df = spark.createDataFrame(rows, "name string, n double, total array<float>").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = group_sums.sums_by_group(df.withColumnRenamed("n", "number"), ["name", "number"], F.col("total"), held).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want)
    for r in got:
        n, total = want[r["name"], str(r["number"])]
        assert (r["n"], r["total"]) == (n, total if n else [])


def test_mean_vectors_odd_input(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, None), (None, [3.0, 5.0]), (2, None)], "key int, v array<double>")
    got = {r["key"]: r["mean_vector"] for r in priors.mean_vector_by_group(df, ["key"], "v").collect()}
    assert got == {1: [1.0, 2.0], None: [3.0, 5.0], 2: None}
    assert priors.mean_vector_by_group(df.limit(0), ["key"], "v").collect() == []
    nested = df.select(F.struct("key").alias("key"), F.coalesce("v", F.array(F.lit(0.0), F.lit(0.0))).alias("v"))
    assert priors.mean_vector_by_group(nested, ["key"], "v").count() == 3
    ragged = spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "key int, v array<double>").coalesce(1)
    with pytest.raises(Exception, match="one length"):
        priors.mean_vector_by_group(ragged, ["key"], "v").collect()
