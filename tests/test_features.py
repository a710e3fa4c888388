import json
import os

import pytest
from pyspark.sql import functions as F

from calibrium.sources import features


def rows(spark, n=900, width=3, at=0):
    return spark.range(at, at + n, 1, 4).select("id", F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: (i * F.col("id") / 7).cast("float")).alias("features"))


def load(spark, path):
    return sorted((r.id, tuple(r.features)) for r in spark.read.format("features").load(path).collect())


def plain(df):
    return sorted((r.id, tuple(r.features)) for r in df.collect())


def test_round_trip_in_blocks_append_and_overwrite(spark, tmp_path):
    features.register(spark)
    path, one, two = f"{tmp_path}/f", rows(spark), rows(spark, 50, 3, 5000)
    one.write.format("features").option("block_rows", 64).mode("append").save(path)
    assert load(spark, path) == plain(one)
    assert spark.read.format("features").load(path).rdd.getNumPartitions() >= 15
    two.write.format("features").mode("append").save(path)
    assert load(spark, path) == plain(one.union(two))
    two.write.format("features").mode("overwrite").save(path)
    assert load(spark, path) == plain(two)
    assert sum(x.startswith("index-") for x in os.listdir(path)) == 1 and not [x for x in os.listdir(path) if x.startswith("_writing")]
    one.limit(0).write.format("features").mode("overwrite").save(path)
    assert load(spark, path) == []


@pytest.mark.parametrize("how", ["byte", "cut", "gone"])
def test_spoilt_blocks_are_refused(spark, tmp_path, how):
    features.register(spark)
    path = f"{tmp_path}/f"
    rows(spark).write.format("features").option("block_rows", 64).mode("append").save(path)
    name = f"{path}/{next(x for x in sorted(os.listdir(path)) if x.startswith('block-'))}"
    data = open(name, "rb").read()
    os.remove(name)
    if how != "gone":
        with open(name, "wb") as f:
            f.write(data[:-4] if how == "cut" else data[:9] + bytes([data[9] ^ 1]) + data[10:])
    with pytest.raises(Exception, match="digest|No such file|not found"):
        load(spark, path)


def test_shapes_and_unfinished_writes(spark, tmp_path):
    features.register(spark)
    path = f"{tmp_path}/f"
    with pytest.raises(Exception, match="no index"):
        load(spark, path)
    rows(spark, 20).write.format("features").mode("append").save(path)
    mixed = rows(spark, 10).union(rows(spark, 10, 5)).coalesce(1)
    for bad in (mixed, rows(spark, 5).withColumn("features", F.when(F.col("id") != 3, F.col("features")))):
        with pytest.raises(Exception, match="widths|null"):
            bad.write.format("features").mode("append").save(path)
    assert load(spark, path) == plain(rows(spark, 20))
    index = next(f"{path}/{x}" for x in os.listdir(path) if x.startswith("index-"))
    said = json.loads(open(index).read())
    said["blocks"][0]["rows"] += 1
    open(index, "w").write(json.dumps(said))
    with pytest.raises(Exception, match="shape"):
        load(spark, path)
