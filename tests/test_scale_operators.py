"""The operators built for uneven data, against brute force, with their limits turned down."""

import random

import pytest
from pyspark.sql import functions as F

from statwarden.operators import catalog, prefix, profile, skew


def hot_rows(spark, n=3000):
    """A third of the rows share one key."""
    rng = random.Random(5)
    rows = [(i, 7 if rng.random() < 0.34 else rng.randrange(200), rng.randrange(50)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, key long, weight long")


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("hot", [1, 500, 10**9])
def test_lookup_equals_plain_join(spark, how, hot):
    rows, left = hot_rows(spark)
    right = spark.createDataFrame([(k, f"v{k}", None if k % 3 else k) for k in range(0, 200, 2)] + [(7, "hot", 70)], "key long, name string, n long")
    got = skew.lookup(left, right, ["key"], ["id"], how=how, hot_rows=hot)
    want = left.join(right, "key", how)
    assert got.columns == want.columns
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)


def test_lookup_spreads_a_hot_key(spark):
    _, left = hot_rows(spark)
    right = spark.createDataFrame([(7, "hot")], "key long, name string")
    plan = skew.lookup(left, right, ["key"], ["id"], hot_rows=1)._jdf.queryExecution().toString()
    assert "xxhash64(id" in plan


@pytest.mark.parametrize("per_bucket", [10**6, 500, 20, 1])
def test_rows_before_equals_brute_force(spark, per_bucket):
    rows, df = hot_rows(spark)
    got = {r.id: r.rows_before for r in prefix.rows_before(df, ["key"], ["id"], "weight", rows_per_bucket=per_bucket).collect()}
    running, want = {}, {}
    for i, key, weight in rows:
        want[i] = running.get(key, 0)
        running[key] = want[i] + weight
    assert got == want


def alike_texts(n=2000):
    """Most texts of a group share a beginning of hundreds of characters, half of these a second one."""
    rng = random.Random(11)
    rows = []
    for i in range(n):
        beginning = "L" * 500 if rng.random() < 0.6 else "é" * 70
        rows.append((i % 3 == 0, None, beginning + ("M" * 200 if rng.random() < 0.5 else "") + str(rng.random()), rng.randrange(9)))
    rows += [(True, k, None, 2) for k in range(n // 4)] + [(True, None, t, 5) for t in ("L" * 500, "L" * 499, "é" * 64, "")]
    return rows


def test_texts_with_common_beginnings_are_cut_by_the_characters_that_differ(spark, tmp_path):
    rows = alike_texts()
    df = spark.createDataFrame(rows, "key boolean, n long, t string, weight long")
    out = prefix.rows_before(df, ["key"], ["n", "t"], "weight", rows_per_bucket=20, folder=str(tmp_path))
    running, want = {}, {}
    for key, n, t, weight in sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1], (r[2] or "").encode())):
        want[key, n, t] = running.get(key, 0)
        running[key] = want[key, n, t] + weight
    assert {(r.key, r.n, r.t): r.rows_before for r in out.collect()} == want
    levels = len(list(tmp_path.glob("cuts_*")))
    assert levels >= 2
    # the written cut points part the rows: no bucket, and so no task, holds a multiple of what it should
    placed, within = df, ["key"]
    first = F.struct(F.col("n"), F.substring("t", 1, prefix.CUT_CHARACTERS).alias("t"))
    for level in range(levels):
        cuts = spark.read.parquet(f"{tmp_path}/cuts_{level}")
        key = first if level == 0 else prefix._next_characters("t")
        placed = placed.join(cuts, within, "left").select(*placed.columns, prefix._bucket(key).alias(f"__bucket_{level}"))
        within.append(f"__bucket_{level}")
    sizes = sorted(r["count"] for r in placed.groupBy(*within).count().collect())
    assert sizes[-1] <= 10 * 20 and len(sizes) > 30


@pytest.mark.parametrize("beginning", ["", "B" * 300])
def test_few_long_texts_are_cut_by_their_bytes(spark, tmp_path, beginning):
    """Fewer texts than the rows of a bucket, but more bytes than a task should read."""
    rng = random.Random(3)
    rows = [(beginning + str(rng.random()) + "x" * rng.randrange(2000), i) for i in range(400)] + [(None, 3), ("z" * 60000, 5)]
    df = spark.createDataFrame([("t", t, w) for t, w in rows], "key string, t string, weight long")
    out = prefix.rows_before(df, ["key"], ["t"], "weight", folder=str(tmp_path), bytes_per_bucket=8000)
    running, want = 0, {}
    for t, weight in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "")):
        want[t], running = running, running + weight
    assert {r.t: r.rows_before for r in out.collect()} == want
    cuts = [spark.read.parquet(str(p)).select(F.size("__cuts")).collect() for p in tmp_path.glob("cuts_*")]
    # 400 kB of texts: some fifty buckets of 8 kB, at the first characters or after the common beginning
    assert sum(r[0] for level in cuts for r in level) >= 20


def test_common_length_of_two_texts(spark):
    pairs = [("abcxyz", "abcd", 3), ("", "a", 0), ("éé", "ééé", 2), ("x" * 5000 + "a", "x" * 5000 + "b", 5000), ("same", "same", 4), ("a", "b", 0)]
    df = spark.createDataFrame(pairs, "a string, b string, want int")
    assert [r.got for r in df.select(prefix._common_length(F.col("a"), F.col("b")).alias("got")).collect()] == [p[2] for p in pairs]


def test_histogram_of_alike_texts_is_the_same_with_and_without_refinement(spark, tmp_path):
    df = spark.createDataFrame([(t,) for _, _, t, _ in alike_texts()], "t string")
    profile.value_counts(profile.tall(df, "x", ["t"])).write.parquet(f"{tmp_path}/counts")
    counts = spark.read.schema(profile.COUNTS_SCHEMA).parquet(f"{tmp_path}/counts")
    refined = profile.histogram(counts, rows_per_bucket=20, folder=f"{tmp_path}/placing").collect()
    assert sorted(refined, key=repr) == sorted(profile.histogram(counts).collect(), key=repr)


@pytest.mark.parametrize("per_bucket", [10**6, 100, 3])
def test_histogram_does_not_depend_on_buckets(spark, sf_dir, per_bucket):
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    columns = ["l_partkey", "l_quantity", "l_returnflag", "l_shipdate"]
    counts = profile.value_counts(profile.tall(table, "lineitem", columns))
    got = {tuple(r) for r in profile.histogram(counts, rows_per_bucket=per_bucket).collect()}
    assert got == {tuple(r) for r in profile.histogram(counts).collect()}


def test_histogram_keeps_rows_and_dominant_counts(spark):
    values = [None] * 40 + [5] * 700 + list(range(10, 310)) + ["x"] * 0
    df = spark.createDataFrame([(v,) for v in values], "a long")
    counts = profile.value_counts(profile.tall(df, "t", ["a"]))
    summary = profile.histogram_summary(profile.histogram(counts)).head()
    assert (summary.estimated_rows, summary.max_equal_rows) == (1000, 700)
    assert profile.histogram(counts).count() <= profile.STEPS + 1


def test_empty_column_has_no_histogram(spark):
    df = spark.createDataFrame([(None,)], "a string")
    counts = profile.value_counts(profile.tall(df, "t", ["a"]))
    status = profile.skew(
        spark.createDataFrame([("t", "a", True)], "table_name string, column_name string, properties_available boolean"),
        profile.histogram(counts),
        F.lit(True),
    ).head()
    assert (status.histogram_status, status.observed_steps) == ("NO_HISTOGRAM_ROWS", 0)


def test_modification_counts_with_hot_key(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stats = events.select("event_type").distinct().withColumn("last_updated", F.lit("2024-01-02").cast("timestamp_ntz"))
    got = profile.modification_counts(events, stats, ["event_type"], "event_id", hot_rows=1)
    want = events.where("ts > timestamp_ntz'2024-01-02'").groupBy("event_type").count()
    assert {(r.event_type, r.modification_counter) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_generated_rows(spark):
    total = spark.createDataFrame([(25,)], "n long")
    assert sorted(r.id for r in catalog.generated_rows(total, block=7).collect()) == list(range(1, 26))
    assert catalog.generated_rows(spark.createDataFrame([(0,)], "n long")).count() == 0


def test_sampling_is_repeatable_and_near_its_share(spark, sf_dir):
    from statwarden.functions.hashing import percent_threshold, row_hash

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    sample = orders.where(row_hash(F.col("o_orderkey")) < percent_threshold(F.lit(20)))
    first, second = {r.o_orderkey for r in sample.collect()}, {r.o_orderkey for r in sample.repartition(7).collect()}
    assert first == second and 0.15 < len(first) / orders.count() < 0.25


def test_refresh_of_two_thousand_planned_tables(spark, sf_dir, tmp_path):
    """Job by job: the plan that is built does not grow with the number of tables."""
    region = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey")
    plan = spark.range(2000).selectExpr(
        "'t' || id AS table_name", "'r_regionkey' AS column_name", "'AUTO' AS collection_method", "CAST(NULL AS DECIMAL(19,6)) AS requested_sample_percent",
        "CAST(NULL AS BIGINT) AS requested_sample_rows", "CAST(5 AS BIGINT) AS current_rows",
    )
    due = plan.where("table_name IN ('t3', 't1500')")
    tables = {f"t{i}": region for i in range(2000)}
    keys = {f"t{i}": ["r_regionkey"] for i in range(2000)}
    got = profile.refresh_batch(due, tables, keys, f"{tmp_path}/few", tables_per_job=500)
    assert {(r.table_name, r.after_rows_sampled, r.after_steps) for r in got.collect()} == {("t3", 5, 5), ("t1500", 5, 5)}
    parts = len(got._jdf.queryExecution().optimizedPlan().toString())
    some = {n: tables[n] for n in list(tables)[:64]}
    wide = profile.refresh_batch(plan.where("CAST(substring(table_name, 2) AS INT) < 64"), some, keys, f"{tmp_path}/wide", tables_per_job=16)
    assert wide.where("after_rows_sampled = 5").count() == 64
    assert len(wide._jdf.queryExecution().optimizedPlan().toString()) < 1.2 * parts


def test_default_method_reads_all_rows_or_the_amount_of_the_policy(spark, sf_dir, tmp_path):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    total = orders.count()
    plan = spark.sql(f"""SELECT 'orders' AS table_name, 'o_custkey' AS column_name, 'AUTO' AS collection_method, CAST(NULL AS DECIMAL(19,6)) AS requested_sample_percent,
      CAST(NULL AS BIGINT) AS requested_sample_rows, CAST({total} AS BIGINT) AS current_rows""")
    read = lambda p, name: profile.refresh_batch(p, {"orders": orders}, {"orders": ["o_orderkey"]}, f"{tmp_path}/{name}").head().after_rows_sampled
    assert read(plan, "all") == total
    assert read(plan.withColumn("auto_sample_rows", F.lit(None).cast("bigint")), "null") == total
    assert 0.3 * total < read(plan.withColumn("auto_sample_rows", F.lit(total // 2).cast("bigint")), "half") < 0.7 * total


def test_decimals_keep_their_digits_and_arrays_have_no_histogram(spark):
    df = spark.sql("SELECT CAST(v AS DECIMAL(20,2)) AS d, array(v) AS a FROM VALUES (9007199254740992.01), (9007199254740992.02), (-1.5), (NULL) t(v)")
    assert profile.profiled(df) == ["d"]
    counts = profile.value_counts(profile.tall(df, "t", profile.profiled(df)))
    steps = profile.histogram(counts).orderBy("step").collect()
    assert [str(s.high_decimal.normalize()) for s in steps] == ["-1.5", "9007199254740992.01", "9007199254740992.02"]
    assert profile.properties(counts).head().distinct_values == 3


def test_numbers_are_dealt_out_by_ranges_without_a_search(spark, tmp_path):
    """Every row is placed once and written; a search of the cut points per row grew with the rows."""
    rows, df = hot_rows(spark)
    out = prefix.rows_before(df, ["key"], ["id"], "weight", rows_per_bucket=400, folder=str(tmp_path))
    running, want = {}, {}
    for i, key, weight in rows:
        want[i] = running.get(key, 0)
        running[key] = want[i] + weight
    assert {r.id: r.rows_before for r in out.collect()} == want
    sizes = [r["count"] for r in spark.read.parquet(f"{tmp_path}/placed").groupBy("__range").count().collect()]
    assert len(sizes) > 20 and max(sizes) <= 400 and not list(tmp_path.glob("cuts_*"))


def mixed_rows(spark):
    return spark.createDataFrame(
        [(i % 4 or None, float(i % 3), None if i % 5 == 0 else f"t{i % 7}", i, i % 2 == 0) for i in range(60)] + [(None, None, None, None, None)] * 2,
        "a long, d double, t string, n int, b boolean",
    ).withColumn("m", F.col("n").cast("decimal(9,2)"))


def test_values_counted_by_kind_are_the_counts_of_tall_rows(spark):
    df = mixed_rows(spark)
    columns = ["a", "d", "t", "n", "b", "m"]
    keep = {"a": F.col("n") < 30, "t": F.col("n") % 2 == 0}
    for some in (None, keep):
        want = profile.value_counts(profile.tall(df, "x", columns, some).unionByName(profile.tall(df, "y", ["d"])))
        got = profile.column_counts([profile.Counted(df, "x", columns, some), profile.Counted(df, "y", ["d"])])
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)


def test_counts_keys_are_plain_and_numbers_are_never_sorted(spark, tmp_path):
    df = mixed_rows(spark)
    counts = profile.column_counts([profile.Counted(df, "x", ["a", "d", "n"])])
    plan = profile.properties(counts)._jdf.queryExecution().executedPlan().toString()
    assert "keys=[column" in plan and "long_value" not in plan.split("keys=[column")[-1].split("]")[0]
    counts.write.parquet(f"{tmp_path}/counts")
    written = spark.read.schema(profile.COUNTS_SCHEMA).parquet(f"{tmp_path}/counts")
    numbers = profile._steps(written.where("text_value IS NULL"), profile.VALUE[:-1], f"{tmp_path}/placing", 200, 10**6, 1 << 25)
    assert "SortAggregate" not in numbers._jdf.queryExecution().executedPlan().toString()
    got = {r.column_name: (r.stats_rows, r.known_rows, r.distinct_values, r.min_long, r.max_long, r.max_double, r.max_text) for r in profile.properties(written).collect()}
    assert got == {"a": (62, 45, 3, 1, 3, None, None), "d": (62, 60, 3, None, None, 2.0, None), "n": (62, 60, 60, 0, 59, None, None)}
