from pyspark.sql import functions as F

from timeloom.operators.catalogue import places
from timeloom.queries import library_places


def test_places_of_all_rows(spark):
    rows = [(i, i * 37 % 11) for i in range(500)]
    got = places(spark.createDataFrame(rows, "id bigint, k bigint").repartition(5), F.desc("k"), F.col("id")).collect()
    assert {x.id: x.place for x in got} == {i: n for n, (_, i) in enumerate(sorted((-k, i) for i, k in rows), 1)}


def test_every_video_has_a_place(spark, data):
    n = spark.read.parquet(f"{data}/orders.parquet").count()
    assert sorted(x.place for x in library_places(spark, data).collect()) == list(range(1, n + 1))
