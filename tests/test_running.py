from pyspark.sql import Window, functions as F

from tidemark.operators import manifest as man, pacing, sessions
from tidemark.operators.running import Ordered, count_before, max_before, previous, sum_before, with_running


def values():
    return {
        "n": count_before(),
        "s": sum_before(F.col("v")),
        "m": max_before(F.col("v")),
        "p": previous(F.when(F.col("v") % 2 == 0, F.col("v"))),
    }


def skewed(spark, rows=6000):
    """A third of the rows in one group, a tenth in the NULL group, the rest spread out."""
    return spark.range(rows).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 10 == 1, None)
        .otherwise((F.col("id") % 97).cast("string"))
        .alias("g"),
        (F.col("id") * 7919 % 1009).alias("v"),
    )


def brute_force(rows):
    seen, out = {}, set()
    for row in sorted(rows, key=lambda r: r["id"]):
        before = seen.setdefault(row["g"], [])
        last = before[-1] if before else None
        out.add(
            (
                row["id"],
                len(before),
                sum(before),
                max(before) if before else None,
                last if last is not None and last % 2 == 0 else None,
            )
        )
        before.append(row["v"])
    return out


def test_blocks_agree_with_brute_force(spark):
    df = skewed(spark)
    expected = brute_force(df.collect())
    for rows_per_block in (10_000, 1_000, 97):
        got = with_running(df, ["g"], [F.col("id")], values(), rows_per_block)
        assert {tuple(r) for r in got.select("id", "n", "s", "m", "p").collect()} == expected


def test_groups_of_several_columns(spark):
    df = skewed(spark).withColumn("h", F.when(F.col("id") % 2 == 0, F.array(F.lit("x"))))
    plain = with_running(df, ["g", "h"], [F.col("id")], values())
    for rows_per_block in (400, 90):
        got = with_running(df, ["g", "h"], [F.col("id")], values(), rows_per_block)
        assert got.exceptAll(plain).count() == 0 and got.count() == 6000
    by_array = with_running(df, ["h"], [F.col("id")], values(), 300)
    assert by_array.exceptAll(with_running(df, ["h"], [F.col("id")], values())).count() == 0


def test_only_groups_in_several_blocks_are_carried(spark):
    cut = Ordered.cut(skewed(spark), ["g"], [F.col("id")], 200)
    blocks = cut.df.groupBy("g").agg(F.count_distinct("__block").alias("n")).filter("n > 1")
    split = {r["__s_g"] for r in cut.split.collect()}
    assert split == {r["g"] for r in blocks.collect()} and {"hot", None} <= split
    assert cut.df.groupBy("__block").count().agg(F.max("count")).first()[0] < 800
    whole = Ordered.cut(spark.range(50).withColumn("g", F.lit(1)), ["g"], [F.col("id")])
    assert whole.split.count() == 0


def test_rounds_read_the_input_once(spark, tmp_path):
    folder = str(tmp_path / "log")
    skewed(spark).withColumnRenamed("v", "ts_us").write.parquet(folder)
    log = spark.read.parquet(folder)
    for plan in (
        sessions.idle_sessions(log, ["g"], [F.col("ts_us"), F.col("id")], 5, 200),
        pacing.pace(log.withColumn("bytes", F.lit(9)), ["g"], [F.col("ts_us"), F.col("id")], 50, 200),
    ):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert folder not in text and "BroadcastHashJoin" in text
        assert text.count("Location:") <= 4


def test_many_rows_agree_with_a_plain_window(spark):
    df = spark.range(1_000_000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50_021).alias("g"), (F.col("id") * 7919 % 1009).alias("v")
    )
    before = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    plain = df.select(
        F.count("*").over(before).alias("n"), F.coalesce(F.sum("v").over(before), F.lit(0)).alias("s"), "id"
    )
    got = with_running(df, ["g"], [F.col("id")], {"n": count_before(), "s": sum_before(F.col("v"))}, 50_000)
    mark = F.sum(F.xxhash64("id", "n", "s").cast("decimal(38,0)"))
    assert got.agg(F.count("*"), mark).first() == plain.agg(F.count("*"), mark).first()


def test_global_order_with_ties_on_the_leading_key(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 != 0, F.lit(0)).otherwise(F.col("id") % 50).cast("bigint").alias("size"),
        F.array(F.lit("d"), F.col("id").cast("string")).alias("path"),
    )
    wanted = sorted(df.collect(), key=lambda r: (-r["size"], r["path"]))
    for rows_per_block in (5000, 250):
        got = man.assign_ids(df, rows_per_block).orderBy("file_id").collect()
        assert [r["file_id"] for r in got] == list(range(3000))
        assert [r["path"] for r in got] == [r["path"] for r in wanted]


def test_components_are_compared_one_by_one(spark):
    df = spark.createDataFrame([(5, ["a-x"]), (5, ["a", "b"]), (9, ["z"])], "size bigint, path array<string>")
    got = man.assign_ids(df).orderBy("file_id").collect()
    assert [r["path"] for r in got] == [["z"], ["a", "b"], ["a-x"]]
