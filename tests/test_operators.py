import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scoreloom.operators import filters, percentiles, staging
from scoreloom.operators.numbering import first_per_group, number_rows
from scoreloom.operators.percentiles import Percentile, exact_percentiles
from scoreloom.session import settle
from scoreloom.sources.tables import results, table
from tests import brute

WANTED = [Percentile(f"p{int(p * 100)}", "v", p) for p in (0.0, 0.05, 0.25, 0.5, 0.95, 0.99, 1.0)]


def skewed(seed=7):
    """One group holds most rows, one value many copies; tiny and empty groups too."""
    rng = random.Random(seed)
    groups = {
        "hot": [rng.choice([1.0, 1.0, rng.gauss(5, 2), rng.random()]) for _ in range(6000)],
        "one": [3.5],
        "two": [1.0, 2.0],
        "same": [4.0] * 50,
        "wide": [rng.uniform(-1e6, 1e6) for _ in range(900)],
    }
    rows = [(g, v) for g, values in groups.items() for v in values]
    return groups, [*rows, ("empty", None), ("one", None)]


@pytest.mark.parametrize("interpolate", [True, False])
@pytest.mark.parametrize("options", [{}, {"kept": 10}, {"kept": 10, "accuracy": 100}])
def test_percentiles_are_exact(spark, interpolate, options):
    groups, rows = skewed()
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    found = exact_percentiles(
        df, ["g"], WANTED, [F.count("*").alias("n")], interpolate=interpolate, **options
    )
    found = {r["g"]: r for r in found.collect()}
    assert set(found) == {*groups, "empty"}
    assert found["hot"]["n"] == 6000 and found["empty"]["p50"] is None
    for group, values in groups.items():
        for w in WANTED:
            expected = brute.quantile(values, w.p, interpolate)
            assert found[group][w.name] == pytest.approx(expected), (group, w.name)


def test_counting_shuffles_only_partial_counts(spark, sf_dir):
    wanted = [Percentile("p95", "throughput", 0.95)]
    ends = settle(results(spark, sf_dir).groupBy(F.struct("policy_name").alias("_group")).agg(F.lit(1).alias("_gid"), F.lit(150.0).alias("_low_0"), F.lit(190.0).alias("_high_0")))
    found = percentiles._counted(results(spark, sf_dir), F.struct("policy_name").alias("_group"), ends, wanted)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = plan[: plan.index("FileScan")].splitlines()
    # From the scan up: broadcast join, explode, partial count, and only then an exchange.
    last_exchange = max(i for i, line in enumerate(scan) if "Exchange hashpartitioning" in line)
    below = "\n".join(scan[last_exchange:])
    assert "partial_count" in below and "BroadcastHashJoin" in below and "Generate" in below


def test_nine_values_are_nine_rows_and_need_no_narrowing(spark, monkeypatch):
    """However many rows stand at a value, a bracket holds it once."""
    rows = spark.range(200_000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 9).cast("double").alias("v"))
    monkeypatch.setattr(percentiles, "_narrowed", None)
    found = exact_percentiles(rows, ["g"], WANTED, kept=5000).first()
    values = sorted(k * 7919 % 9 for k in range(200_000))
    assert [found[w.name] for w in WANTED] == [brute.quantile(values, w.p) for w in WANTED]


def test_counted_values_are_narrowed_until_they_fit(spark):
    rng = random.Random(11)
    counts = {(g, v): rng.randint(1, 50) for g in (1, 2) for v in {round(rng.gauss(0, 9), 3) for _ in range(3000)}}
    spread = {g: sorted(v for (h, v), n in counts.items() if h == g for _ in range(n)) for g in (1, 2)}
    values = spark.createDataFrame([(g, 0, v, n) for (g, v), n in counts.items()], "_gid long, want int, value double, copies long")
    ranks = {g: (len(spread[g]) // 3, len(spread[g]) // 3 + 1) for g in (1, 2)}
    targets = spark.createDataFrame([(g, 0, a + 10, b + 10, 10) for g, (a, b) in ranks.items()], "_gid long, want int, first long, last long, skip long")
    for kept in (20, 10**6):
        found = {r["_gid"]: (r["low"], r["high"]) for r in percentiles.ranked_values(values, targets, kept=kept).collect()}
        assert found == {g: (spread[g][a], spread[g][b]) for g, (a, b) in ranks.items()}


def test_percentiles_without_keys_and_with_null_keys(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(101)], "g string, v double")
    assert exact_percentiles(df, [], WANTED).first()["p95"] == 95.0
    row = exact_percentiles(df, ["g"], WANTED).first()
    assert row["g"] is None and row["p50"] == 50.0


def test_numbering_matches_a_window_on_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.8 else rng.choice("abc"), rng.randint(0, 20), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, k int, id long")
    plain = F.row_number().over(Window.partitionBy("g").orderBy("k", "id"))
    expected = {r["id"]: r["m"] for r in df.select("id", plain.alias("m")).collect()}
    numbered = number_rows(df, ["g"], ["k", "id"]).collect()
    assert {r["id"]: r["n"] for r in numbered} == expected


def test_numbering_without_groups_and_empty(spark):
    df = spark.range(100)
    numbered = number_rows(df, [], ["id"]).orderBy("id").collect()
    assert [r["n"] for r in numbered] == list(range(1, 101))
    assert number_rows(df.where("id < 0"), [], ["id"]).count() == 0


def test_numbering_spreads_a_hot_group(spark):
    df = spark.range(5000).withColumn("g", F.lit("all"))
    numbered = number_rows(df, ["g"], ["id"]).withColumn("part", F.spark_partition_id())
    sizes = [r["count"] for r in numbered.groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * 5000 / 4


def test_first_per_group(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    first = first_per_group(df, ["g"], ["id"], 5)
    assert sorted(r["id"] for r in first.collect()) == list(range(15))
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_filters_reach_the_scan(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_tax").where("l_tax > 0.05")
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_tax,0.05)" in plan and "l_discount" not in plan


def test_partition_pruning_on_a_stored_table(spark, sf_dir, tmp_path):
    from scoreloom.sources.results import scan_results, write_results

    write_results(results(spark, sf_dir), str(tmp_path))
    stored = scan_results(spark, str(tmp_path))
    chosen = filters.filter_results(stored, ["early_exit_28"], ["crmarena"], ("1996-01-01", "1996-12-31"))
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "benchmark" in plan.split("PartitionFilters: [")[1][:200]
    assert "GreaterThanOrEqual(timestamp" in plan
    expected = results(spark, sf_dir).where(
        "policy_name = 'early_exit_28' AND benchmark = 'crmarena' AND year(timestamp_seconds(timestamp)) = 1996"
    )
    assert chosen.count() == expected.count() > 0


def test_tiers_put_null_last(spark):
    df = spark.createDataFrame(
        [(None, None, None, "x"), (0.09, 101.0, 0.81, "dynamicXpruning_a"), (0.1, 100.0, 0.8, "early_exit_9")],
        "first_token_latency double, throughput double, f1 double, policy_name string",
    )
    tiers = df.select(
        staging.latency_tier(), staging.throughput_tier(), staging.quality_tier(), staging.policy_category()
    )
    assert [tuple(r) for r in tiers.collect()] == [
        ("Slow", "Low", "Low", "Other"),
        ("Fast", "High", "High", "Dynamic Token Pruning"),
        ("Medium", "Medium", "Medium", "Early Exit"),
    ]


def test_round_display_is_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r[0] for r in df.select(filters.round_display(F.col("x"), 0)).collect()] == [0, 2, 2]
