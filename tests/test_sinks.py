"""The bzip2 dump sink: what Spark's own writer gives, compressed in the tasks by libbz2."""

import bz2
import json

import pytest
from pyspark.sql import functions as F

from tribewise.plans import q_sources
from tribewise.sources import readers as R
from tribewise.sources import sinks as K

SCHEMA = "id string, parent_id string, score bigint, link_id string, author string, subreddit string, body string, created_utc bigint"
ROWS = [("1", None, 5, "t3_1", "a", "s", 'x "q"\n\\ é中\U0001f600', 10), ("2", None, None, None, None, None, None, None),
        ("2", None, None, None, None, None, None, None), (None, "p", -1, "", "b", "s", "", 1 << 40)]


def _files(path):
    return sorted(p for p in path.iterdir() if p.name.startswith("part-"))


def test_dump_is_that_of_sparks_writer(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumn("undeclared", F.lit(1))
    K.write_dump(df, str(tmp_path / "new"))
    df.write.option("compression", "bzip2").json(str(tmp_path / "old"))
    lines = [sorted(line for p in _files(tmp_path / d) for line in bz2.decompress(p.read_bytes()).splitlines()) for d in ("new", "old")]
    assert lines[0] == lines[1] and len(lines[0]) == len(ROWS) and all(json.loads(x)["undeclared"] == 1 for x in lines[0])
    assert all(p.name.endswith(".json.bz2") for p in _files(tmp_path / "new"))
    assert not (tmp_path / "new" / "_temporary").exists() and (tmp_path / "new" / "_SUCCESS").exists()
    got = sorted(map(tuple, R.read_dump(spark, str(tmp_path / "new")).select(*SCHEMA.replace(" string", "").replace(" bigint", "").split(", ")).collect()), key=repr)
    assert got == sorted(ROWS, key=repr)


def test_a_dump_of_many_blocks_is_split_by_its_readers(spark, tmp_path):
    df = spark.range(60_000, numPartitions=2).select(F.col("id").cast("string").alias("id"), F.sha2(F.col("id").cast("string"), 512).alias("body"))
    K.write_dump(df, f"file://{tmp_path}/many")
    assert len(_files(tmp_path / "many")) == 2
    spark.conf.set("spark.sql.files.maxPartitionBytes", 500_000)
    try:
        back = R.read_dump(spark, str(tmp_path / "many"))
        assert back.rdd.getNumPartitions() > 4
        assert back.select("id", "body").exceptAll(df).isEmpty() and back.count() == 60_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_dump_of_no_rows_and_failures(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    K.write_dump(none, str(tmp_path / "none"))
    assert R.read_dump(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileExistsError):
        K.write_dump(none, str(tmp_path / "none"))
    bad = spark.createDataFrame(ROWS, SCHEMA).withColumn("body", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        K.write_dump(bad, str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").iterdir())


def test_dump_queries_compress_with_libbz2(spark):
    path = q_sources._dumped(spark, spark.createDataFrame(ROWS, SCHEMA), "comments")
    heads = {r.content[:4] for r in spark.read.format("binaryFile").load(path).select("content").collect()}
    assert {bytes(h) for h in heads} == {b"BZh1"}  # Java's codec only writes BZh9
