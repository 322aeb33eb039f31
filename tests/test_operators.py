from pyspark.sql import functions as F

from quern.operators.joins import anti_not_in, cover_counts, interval_join, salted_join, theta_join, window_totals
from quern.plans import joins
from quern.streaming import ingest


def most_rows(df):
    """Rows of the result, and the most rows that any step of its plan puts out."""
    rows, found, todo = df.collect(), [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        step = todo.pop()
        if step.metrics().contains("numOutputRows"):
            found.append(step.metrics().apply("numOutputRows").value())
        kind = step.getClass().getSimpleName()
        under = [step.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [step.plan()] if kind.endswith("QueryStageExec") else [step.children().apply(i) for i in range(step.children().size())]
        todo += under
    return rows, max(found)


def dense_events(spark, folder, n=1500):
    """Events within 150 seconds, so that nearly all of them lie in every range."""
    spark.range(n).selectExpr("id AS event_id", "CAST(timestamp_micros(id * 100000) AS TIMESTAMP_NTZ) AS ts", "id % 7 + 0.25D AS value").write.parquet(f"{folder}/events.parquet")


def test_cover_counts_equals_counted_pairs(spark):
    ts = "CAST(timestamp_micros({}) AS TIMESTAMP_NTZ)"
    points = spark.range(-50, 400).selectExpr("id AS p", f"if(id % 9 = 0, NULL, {ts.format('id * 37000000')}) AS at").unionAll(spark.sql("SELECT 7L, TIMESTAMP_NTZ'9990-01-01'"))
    spans = spark.range(60).selectExpr(f"if(id = 9, NULL, {ts.format('id * 185000000')}) AS low", f"{ts.format('id * 185000000 + (id % 7 - 1) * 333000000')} AS high")
    want = spark.sql("SELECT p, at, count(*) AS n FROM {p} JOIN {s} ON at >= low AND at < high GROUP BY p, at", p=points, s=spans)
    far = spans.unionAll(spark.sql("SELECT TIMESTAMP_NTZ'0001-01-01', TIMESTAMP_NTZ'0001-01-02'"))
    for given, width in ((spans, 600), (spans, 1), (spans, 10**6), (far, 600)):
        assert sorted(map(str, cover_counts(points, given, "at", "low", "high", width).collect())) == sorted(map(str, want.collect()))
    assert cover_counts(points, spans.where("low >= high"), "at", "low", "high", 600).count() == 0


def test_ranges_of_mixed_lengths_are_counted_without_pairs(spark, tmp_path):
    dense_events(spark, tmp_path)
    rows, most = most_rows(joins.join_range_mixed_lengths(spark, str(tmp_path)))
    longer = sum(i % 500 > 0 for i in range(1500))
    assert len(rows) == 1499 and max(r["n"] for r in rows) > longer // 2 and most < 10_000


def test_interval_join_meets_each_pair_once(spark):
    ts = "cast(timestamp_seconds({}) as timestamp_ntz)"
    points = spark.range(0, 500).select(F.expr(ts.format("id * 37")).alias("at"), F.col("id").alias("p"))
    spans = spark.range(0, 40).select(F.expr(ts.format("id * 400")).alias("low"), F.expr(ts.format("id * 400 + (id % 7) * 333")).alias("high"), F.col("id").alias("s"))
    want = {(p, s) for s in range(40) for p in range(500) if s * 400 <= p * 37 < s * 400 + (s % 7) * 333}
    got = [(r["p"], r["s"]) for r in interval_join(points, spans, "at", "low", "high", 500).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_window_totals_equal_sums_of_pairs(spark):
    at = "timestampadd(MICROSECOND, {}, {})"
    for base in ("TIMESTAMP_NTZ'1970-01-01 00:00:50'", "TIMESTAMP_NTZ'9990-01-01'", "TIMESTAMP'2024-01-01'"):
        points = spark.range(-300, 300).selectExpr(
            f"if(id = 8, NULL, {at.format('id * 9999999', base)}) AS at", "CASE WHEN id = -70 THEN DOUBLE('NaN') WHEN id = 60 THEN DOUBLE('inf') WHEN id > 160 THEN NULL ELSE id + 0.25D END AS v"
        ).unionAll(spark.range(90).selectExpr(at.format("id div 3 * 100000000 - 1 + id % 3", base), "1D"))
        windows = spark.range(120).selectExpr("if(id = 5, NULL, id div 2) AS k", f"if(id = 9, NULL, {at.format('(id - 60) * 50000000', base)}) AS lo")
        want = spark.sql("SELECT k, count(*) AS n, sum(v) AS total FROM {p} JOIN {w} ON at >= lo AND at < lo + INTERVAL 100 SECONDS GROUP BY k", p=points, w=windows)
        assert sorted(map(str, window_totals(points, windows, "k", "at", "lo", "v", 100).collect())) == sorted(map(str, want.collect()))


def test_ranges_of_one_length_are_summed_without_pairs(spark, tmp_path):
    dense_events(spark, tmp_path, 3000)
    rows, most = most_rows(joins.join_range(spark, str(tmp_path)))
    assert {r["k"]: r["n"] for r in rows} == {k: 3000 - k for k in range(0, 3000, 20)} and most < 10_000


def test_theta_join_equals_the_plain_one(spark):
    left = spark.range(90).selectExpr("id AS a", "if(id % 10 = 0, NULL, id % 40) AS x").unionAll(spark.sql("SELECT 5L, 5L"))
    right = spark.range(70).selectExpr("id AS b", "if(id % 9 = 0, NULL, id % 30) AS y")
    for r, meets in ((right, F.col("y") < F.col("x") / 2), (right.limit(0), F.col("y") < F.col("x"))):
        want = sorted(map(str, left.crossJoin(r).where(meets).collect()))
        for rows in (7, 1000):
            assert sorted(map(str, theta_join(left, r, meets, rows).collect())) == want


def test_theta_query_deals_pairs_over_tasks(spark, tmp_path):
    spark.range(13000).selectExpr("id AS s_suppkey", "CAST(id % 100 AS DOUBLE) AS s_acctbal").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(13000).selectExpr("id AS p_partkey", "1 AS p_size", "CAST(id % 1000 AS DOUBLE) AS p_retailprice").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    sizes = [r["count"] for r in joins.join_theta(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    want = sum((s % 100 / 8 > p) * 13 for s in range(13000) for p in range(13))
    assert sum(sizes) == want and max(sizes) < 0.7 * want


def test_salted_join_equals_the_plain_one(spark):
    big = spark.range(0, 300).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(0, "a"), (0, "b"), (2, "c"), (9, "d")], "k long, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(str, big.join(small, "k", how).collect()))
        assert sorted(map(str, salted_join(big, small, "k", how, 5).collect())) == plain


def test_streamed_files_become_rows(spark, tmp_path):
    from quern.engine import Engine

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.csv").write_text("1,x\n2,y\n")
    engine = Engine(spark, warehouse=str(tmp_path / "w"))
    engine.sql("CREATE TABLE s (id INT PRIMARY KEY, name TEXT)")
    for name, text in (("b.csv", "3,z\n"), (None, None)):
        ingest(engine, "s", str(source), str(tmp_path / "cp")).awaitTermination(60)
        if name:
            (source / name).write_text(text)
    assert [tuple(r) for r in engine.query("SELECT id, name FROM s ORDER BY id").collect()] == [(1, "x"), (2, "y"), (3, "z")]


def test_not_in_has_three_values(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    for right in ([], [(2,)], [(2,), (None,)], [(None,)]):
        r = spark.createDataFrame(right, "b int")
        want = spark.sql("SELECT a FROM {l} WHERE a NOT IN (SELECT b FROM {r})", l=left, r=r)
        assert sorted(map(str, anti_not_in(left, r, "a", "b").collect())) == sorted(map(str, want.collect()))
