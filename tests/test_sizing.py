import pytest
from pyspark.sql import functions as F

from auditlake.functions import sizing
from auditlake.session import shared_dir


@pytest.fixture(scope="module")
def sides(spark):
    hot = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)  # one key holds a third of all rows
    left = spark.range(900).select(F.col("id").alias("row"), hot.alias("k"))
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    return left, right


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join_with_a_hot_key(sides, how):
    left, right = sides
    plain = left.join(right, ["k"], how)
    for joined in (
        sizing.salted_join(left, right, ["k"], F.col("row"), how),
        sizing.sized_join(left, right, ["k"], F.col("row"), how, max_bytes=1),
        sizing.sized_join(left, right, ["k"], F.col("row"), how),
    ):
        assert joined.columns == plain.columns
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, plain.collect()))


def test_salting_spreads_the_hot_key(sides):
    left, right = sides
    salted = sizing.salted_join(left, right, ["k"], F.col("row"), "left")
    plan = salted._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan
    salts = left.filter("k = 0").select(F.pmod(F.xxhash64("row"), F.lit(sizing.SALTS)).alias("s")).distinct().count()
    assert salts == sizing.SALTS


def test_fits(sides):
    left, _ = sides
    assert sizing.measure(left).rows == 900 and sizing.fits(left)
    assert not sizing.fits(left, max_rows=899) and not sizing.fits(left, max_bytes=100)
    plan = left.select(sizing.payload_bytes(left).alias("b")).agg(F.sum("b"))._jdf.queryExecution().executedPlan().toString()
    assert "Limit" not in plan and "partial_sum" in plan  # one row per task reaches the last one
    assert sizing.measure(left.limit(0)) == sizing.Size(0, 0)


def test_shared_dir_uses_the_cluster_setting(spark):
    first, second = shared_dir(spark), shared_dir(spark)
    assert first != second and first.startswith(spark.conf.get("spark.checkpoint.dir"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_a_side_not_measured_to_be_small_is_never_broadcast(sides, how):
    left, right = sides  # Spark's own estimate would broadcast either
    for joined in (
        sizing.salted_join(left, right, ["k"], F.col("row"), how),
        sizing.sized_join(left, right, ["k"], F.col("row"), how, max_bytes=1),
        sizing.sized_join(left, right, ["k"], how=how, max_bytes=1),
    ):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, left.join(right, ["k"], how).collect()))


def test_known_only_drops_rows_no_join_would_keep(sides, monkeypatch):
    left, right = sides
    assert sizing.known_only(left, right, ["k"]).count() == left.filter("k < 40").count()
    monkeypatch.setattr(sizing, "MAX_FEW_KEYS", 39)
    assert sizing.known_only(left, right, ["k"]).count() == 900


def test_short_rows_count_as_a_hashed_relation_holds_them(spark):
    many = spark.range(400_000).select(F.col("id").alias("k"), F.lit("n").alias("name"))
    assert sizing.measure(many).bytes < sizing.MAX_BROADCAST_BYTES / 8  # it is the rows, not their payload
    assert not sizing.fits(many) and sizing.fits(many.limit(50_000))
    joined = spark.range(10).select(F.col("id").alias("k")).join(many, "k")
    sized = sizing.sized_join(spark.range(10).select(F.col("id").alias("k")), many, ["k"])
    assert "BroadcastHashJoin" not in sized._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, sized.collect())) == sorted(map(tuple, joined.collect()))
