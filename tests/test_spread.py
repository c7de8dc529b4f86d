"""Work that a small file must not put into one task, one broadcast or one buffer."""

from pyspark.sql import functions as F

from terrashift import catalog
from terrashift.operators import batches, spatial
from terrashift.operators import geometry as R

QUERIES = catalog.queries()
RINGS = "k long, rings array<array<struct<x:double,y:double>>>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_repair_broadcasts_nothing(spark):
    bow = lambda k: (k, [[(float(x), float(y)) for x, y in ((k, 0), (k + 9, 0), (k, 9), (k + 9, 9))]])
    df = spark.createDataFrame([bow(k) for k in range(30)], RINGS)
    sides = R._sides(df, "k", "rings", 9)
    pieces = R._pieces(sides, R._cuts(sides))
    fixed = R.repair(df, "k", "rings")
    assert all("Broadcast" not in plan(x) for x in (sides, pieces, R._directed(pieces), fixed))
    assert {r.k: (len(r.rings), round(r.area, 6)) for r in fixed.collect()} == {k: (2, 40.5) for k in range(30)}


def test_polygons_that_meet_look_once_at_equal_rings(spark, monkeypatch):
    seen, exact = spark.sparkContext.accumulator(0), spatial.G.rings_meet

    @F.udf("boolean")
    def looked(_):
        seen.add(1)
        return True

    monkeypatch.setattr(spatial.G, "rings_meet", lambda a, b: exact(a, b) & looked(a))
    shape = lambda x: [(x, 0.0), (x + 4.0, 0.0), (x, 4.0)]
    # Shapes at 0 and 3 meet, the one at 20 meets itself only; a row without a ring meets nothing.
    rows = [(i, shape((0.0, 3.0, 20.0)[i % 3])) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "k long, r array<struct<x:double,y:double>>")
    a, b = (df.select(F.col("k").alias(f"k{i}"), F.col("r").alias(f"r{i}")) for i in (1, 2))
    got = sorted((r.k1, r.k2) for r in spatial.polygons_that_meet(a, b, "r1", "r2", 5.0).select("k1", "k2").collect())
    assert got == [(i, j) for i in range(60) for j in range(60) if (i % 3 == 2) == (j % 3 == 2)]
    assert seen.value <= 9


def test_scanline_spreads_one_file(spark, tmp_path):
    one = spark.range(200).select(F.col("id").alias("c_custkey")).coalesce(1)
    one.write.parquet(f"{tmp_path}/customer.parquet")
    assert batches.spread(one, "c_custkey", each=10).rdd.getNumPartitions() == max(20, spark.sparkContext.defaultParallelism)
    # Numbered parts are not joined again by adaptive execution.
    assert "REPARTITION_BY_NUM" in plan(QUERIES["geo11_scanline"](spark, str(tmp_path)))
