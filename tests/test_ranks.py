from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from evalmill.operators import ranks


def hashes(n, seed):
    return {i: hashlib.sha256(json.dumps({"seed": seed, "source_index": i, "source_row_id": i}, sort_keys=True, separators=(",", ":")).encode()).hexdigest() for i in range(n)}


def test_row_hash_tells_numbers_from_strings_and_writes_null(spark):
    df = spark.createDataFrame([(1, "7"), (1, '"7"'), (1, None)], "i long, r string")
    got = [r.h for r in df.select(ranks.row_hash(5, F.col("i"), F.col("r")).alias("h")).collect()]
    want = [hashlib.sha256(f'{{"seed":5,"source_index":1,"source_row_id":{x}}}'.encode()).hexdigest() for x in ("7", '"7"', "null")]
    assert got == want


def test_split_is_exact_and_the_same_for_any_partitions(spark):
    want = sorted(hashes(90, 123).items(), key=lambda x: x[1])
    for parts in (1, 7):
        df = spark.range(90).repartition(parts).select("id", ranks.row_hash(123, F.col("id"), F.col("id").cast("string")).alias("h"))
        rows = ranks.split_by_hash(df, "h", "id").collect()
        assert {r.id: (r.split, r.pos) for r in rows} == {
            i: ("train", k) if k < 62 else ("validation", k - 62) if k < 80 else ("test", k - 80) for k, (i, _) in enumerate(want)
        }  # int(90 * 0.7) is 62


def test_ten_rows_split_seven_two_one(spark):
    df = spark.range(10).select("id", ranks.row_hash(123, F.col("id"), F.col("id").cast("string")).alias("h"))
    assert {r.split: r["count"] for r in ranks.split_by_hash(df, "h", "id").groupBy("split").count().collect()} == {"train": 7, "validation": 2, "test": 1}


def test_sample_is_stable_and_capped(spark):
    df = spark.range(20).withColumnRenamed("id", "source_index")
    a, b = ([r.source_index for r in ranks.sample_rows(df.repartition(p), "source_index", 5, 9).collect()] for p in (1, 5))
    assert a == b == sorted(a) and len(a) == 5
    few = ranks.sample_rows(df, "source_index", 10, 9, max_rows=3).collect()
    assert [r.source_index for r in few] == [0, 1, 2] and few[0].seen == 3


def test_json_string(spark):
    value = 'q" é \x01 /   \\'
    got = spark.createDataFrame([(value,)], "v string").select(ranks.json_string(F.col("v"))).first()[0]
    assert json.loads(got) == value
