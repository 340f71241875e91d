"""Plans: what reaches the scan, what is shuffled, and what happens to hot keys."""

import glob
import re

import pytest
from pyspark.sql import functions as F

from driver_queries import bindings
from touchline.operators import lookups, pairings, ranking, stats
from touchline.operators.features import feature_matrix, prepare_entities
from touchline.operators.ranking import best_first
from touchline.plans.read_query import predictions_query
from touchline.session import stage
from touchline.sources import readers, writers


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def settings(spark):
    """Change session settings for one test."""
    changed = {}

    def change(**values):
        for name, value in values.items():
            key = "spark.sql." + name.replace("__", ".")
            changed.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield change
    for key, value in changed.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_hot_key_of_a_large_lookup_is_split(spark, settings):
    """Both sides too large to broadcast, and one name on a third of the rows."""
    settings(
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="100KB",
        adaptive__advisoryPartitionSizeInBytes="100KB",
        adaptive__skewJoin__skewedPartitionFactor="1.5",
        shuffle__partitions="16",
    )
    name = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("n"), F.col("id")))
    payload = F.sha2(F.col("id").cast("string"), 256).alias("payload")
    rows = spark.range(0, 300_000, 1, 16).select("id", name.alias("name"), F.lit(-1).cast("long").alias("player_code"), payload)
    source = rows.select(F.col("name").alias("full_name"), F.col("id").alias("code"), F.col("id").alias("pos"))
    enriched = lookups.enrich_by_name(rows, lookups.name_table(source))
    plan = _final_plan(enriched)
    assert "skew=true" in plan
    hot = enriched.where("name = 'hot'").agg(F.count(F.lit(1)), F.min("player_code"), F.max("player_code")).first()
    assert tuple(hot) == (100_000, 299_997, 299_997)
    assert enriched.where("name != 'hot' and player_code != id").isEmpty()


def test_fixture_info_is_broadcast_by_its_written_size(spark, settings):
    entities = stage(spark.range(1000).select("id", F.concat(F.lit("T"), F.col("id") % 5).alias("team")), "entities")
    info = spark.createDataFrame([("T1", "T2", True, 3, "x")], "team string, opponent string, is_home boolean, difficulty int, fixture string")
    info = stage(info, "info")
    assert "BroadcastHashJoin" in _plan(pairings.attach_fixture(entities, info))
    settings(autoBroadcastJoinThreshold="10")
    joined = pairings.attach_fixture(entities, info)
    assert "BroadcastHashJoin" not in _plan(joined)
    assert joined.where("next_opponent = 'T2'").count() == 200


def _published(spark, tmp_path):
    rows = spark.range(300).select(
        "id", F.concat(F.lit("n"), "id").alias("name"), F.lit("T").alias("team"), F.lit("MID").alias("position"),
        F.rand(3).alias("predicted_points"), F.rand(4).alias("form"), (F.col("id") % 3 + 8).cast("int").alias("gameweek"),
    )
    writers.publish(rows, str(tmp_path / "t"))
    return readers.read_published(spark, str(tmp_path / "t"))


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    table = _published(spark, tmp_path).where("gameweek = 9").select("id", "position", "predicted_points")
    plan = _plan(predictions_query(table, position="MID", limit=5))
    assert "EqualTo(position,MID)" in plan
    assert "TakeOrderedAndProject" in plan
    assert "PartitionFilters: [isnotnull(gameweek" in plan
    assert "form" not in plan


def test_latest_partition_is_pruned(spark, tmp_path):
    latest = readers.latest_partition(_published(spark, tmp_path))
    assert {r["gameweek"] for r in latest.collect()} == {10}
    scan = next(line for line in _plan(latest).splitlines() if "PartitionFilters: [isnotnull(gameweek" in line)
    assert "subquery" in scan.lower()


def test_features_are_one_projection(spark):
    df = stage(spark.range(200).select("id", F.lit("3").alias("form"), (F.col("id") * 9).alias("minutes")), "rows")
    plan = _plan(feature_matrix(prepare_entities(df)).select("*"))
    main = plan.split("Subquery")[0]
    assert "Exchange" not in main and "Python" not in plan and "CartesianProduct" not in plan


def test_no_shuffle_of_rows_for_a_normalised_column(spark):
    df = stage(spark.range(200).select("id", F.rand(1).alias("v")), "rows")
    plan = _final_plan(stats.scaled_by_maximum(df, "v", "s"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_last_per_key_combines_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    plan = _plan(lookups.keep_last(df, ["k"], ["id"]))
    assert plan.index("partial_max_by") > plan.index("Exchange") > plan.index("max_by")


def test_top_k_does_not_sort_everything(spark):
    df = spark.range(100).withColumn("v", F.col("id"))
    assert "TakeOrderedAndProject" in _plan(ranking.take_sorted(df, ranking.best_first("v"), 3))


def test_target_fixtures_read_each_table_few_times(spark):
    from driver_queries import fixture_queries

    made = fixture_queries.target_fixtures(spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("o_orderpriority") > 0
    assert sum("Relation" in line and "o_orderkey" in line for line in plan.splitlines()) <= 3


def test_operators_write_nothing(spark, monkeypatch):
    """Lookups, context and the read query build plans; only their callers write dimensions."""
    from pyspark.sql.readwriter import DataFrameWriter

    def refuse(*_args, **_kwargs):
        raise AssertionError("an operator wrote a table")

    monkeypatch.setattr(DataFrameWriter, "parquet", refuse)
    teams = spark.createDataFrame([(1, "A", 3), (2, "B", 4)], "id long, name string, strength int")
    fixtures = spark.createDataFrame([(0, 1, 1, 2, False)], "pos long, event long, team_h long, team_a long, finished boolean")
    calendar = spark.createDataFrame([(0, 1, "n", False, True, False)], "pos long, id long, name string, is_current boolean, is_next boolean, finished boolean")
    named = pairings.with_team_names(pairings.fixtures_of_target(calendar, fixtures), teams)
    info = pairings.fixture_info(named, pairings.difficulty_table(teams))
    rows = spark.createDataFrame([("x", "A", "MID", 1.0, 5)], "name string, team string, position string, predicted_points double, id long")
    joined = pairings.attach_fixture(rows, info)
    names = spark.createDataFrame([("x", 9)], "full_name string, code long")
    shown = predictions_query(lookups.enrich_by_name(joined, names), limit=5)
    assert [(r["player_code"], r["next_opponent"]) for r in shown.collect()] == [(9, "B")]


def test_large_limits_end_in_no_single_task(spark, monkeypatch):
    """Half of the rows: counts per part tell where the limit falls, and no exchange brings rows to one partition."""
    rows = spark.range(30_000).select("id", (F.col("id") * 7919 % 1009).alias("v"))
    order = [F.desc("v"), F.asc("id")]
    want = [r["id"] for r in rows.orderBy(*order).collect()]
    for limit in (ranking.LARGE_LIMIT + 1, 15_000, 29_999, 30_000, 50_000):
        taken = ranking.take_sorted(rows, order, limit)
        assert [r["id"] for r in taken.collect()] == want[:limit]
    plan = _plan(ranking.take_sorted(rows, order, 15_000))
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan and "rangepartitioning" in plan
    assert "SinglePartition" not in plan[: plan.index("Subquery")]  # below is the table of one row for each part
    assert "TakeOrderedAndProject" in _plan(ranking.take_sorted(rows, order, 10))
    monkeypatch.setattr(ranking, "LARGE_K", 5)
    grouped = rows.withColumn("g", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")))
    top = ranking.top_per_group(grouped, ["g"], order, 6)
    hot = [r["id"] for r in top.where("g = 'hot'").orderBy("rank").collect()]
    assert hot == [i for i in want if i % 3 > 0][:6] and top.count() == 10_000 + 6
    assert "Window" not in _plan(top).split("Join")[0] and "hashpartitioning(g" not in _plan(top)


def test_lines_are_summed_in_shuffled_parts(spark, tmp_path):
    """No scan task holds a table of the orders in its part of the file, which grows with the file; rows stay the same."""
    day = F.lit("2001-02-03").cast("timestamp")
    spark.range(3).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(8).select(F.when(F.col("id") < 7, F.col("id")).alias("o_orderkey"), (F.col("id") % 2).alias("o_custkey"), day.alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.range(40).select(
        F.when(F.col("id") % 10 < 7, F.col("id") % 10).alias("l_orderkey"), F.lit(2.0).alias("l_quantity"), F.lit("R").alias("l_returnflag"),
        F.lit(0.09).alias("l_discount"), F.lit("F").alias("l_linestatus"), F.lit(10.5).alias("l_extendedprice"),
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    totals = bindings._order_totals(spark, str(tmp_path))
    scan = re.search(r"Exchange hashpartitioning\(l_orderkey[^\n]*REPARTITION_BY_COL.*?FileScan parquet \[l_", _plan(totals), re.S)
    assert scan and "Aggregate" not in scan.group()
    found = {r["customer"]: (r["starts"], r["minutes"], r["goals_scored"], r["bonus"], float(r["value"])) for r in totals.collect()}
    assert found == {0: (4, 32, 16, 16, 168.0), 1: (3, 24, 12, 12, 126.0)}


def test_statistics_read_each_table_once(spark, tmp_path):
    rows = spark.range(2000).selectExpr(
        "CASE WHEN id % 7 = 0 THEN NULL ELSE concat('T', id % 90) END AS team", "CASE WHEN id % 11 = 0 THEN NULL ELSE concat('P', id % 4) END AS position",
        "CASE WHEN id % 13 > 0 THEN CAST(id % 50 AS DECIMAL(10, 2)) END AS predicted_points",
    )
    rows.write.parquet(str(tmp_path / "rows"))
    read = spark.read.parquet(str(tmp_path / "rows"))
    made = stats.prediction_statistics(read)
    assert _plan(made).count("FileScan") + _plan(made).count("Scan parquet") <= 2  # one scan, shown in the tree and in its details
    assert "ubquer" not in _plan(made)
    got, all_rows = made.first(), read.collect()
    known = [float(r["predicted_points"]) for r in all_rows if r["predicted_points"] is not None]
    assert got["total_players"] == 2000 and abs(got["avg_predicted_points"] - sum(known) / len(known)) < 1e-9 and got["max_predicted_points"] == max(known)
    assert got["teams"] == len({r["team"] for r in all_rows}) and got["positions"] == {p: sum(r["position"] == p for r in all_rows) for p in ("P0", "P1", "P2", "P3")}


def test_sinks_share_one_sort(spark, tmp_path):
    rows = spark.range(5000).select("id", (F.col("id") * 37 % 997).cast("double").alias("predicted_points"), F.lit("n").alias("name"), F.lit(3).alias("gameweek"))
    ordered = writers.in_order(rows.repartition(7), best_first("predicted_points"))
    assert "Exchange" not in _plan(ordered.select("id"))
    path = writers.export_csv(ordered, str(tmp_path), 3)
    writers.publish_period(ordered, str(tmp_path / "t"), 3)
    lines = [line.split(",") for file in sorted(glob.glob(f"{path}/part-*")) for line in open(file).read().splitlines()[1:]]
    want = sorted(((i * 37 % 997, i) for i in range(5000)), key=lambda p: (-p[0], p[1]))
    assert [(float(line[1]), int(line[2])) for line in lines] == [(float(p), i) for p, i in want]
    published = readers.read_published(spark, str(tmp_path / "t"))
    assert published.count() == 5000 and {r[0] for r in published.select("gameweek").distinct().collect()} == {3}


def test_landed_arrays_are_parsed_once(spark, tmp_path):
    from touchline.streaming import refresh

    documents = spark.createDataFrame(
        [(1, ("2020", "a"), [(7, "x", None), (8, "y", None)], [(1, "T", 2)]), (2, ("2021", "b"), [(7, "z", None)], None)],
        "gameweek int, _landed struct<time:string,path:string>, elements array<struct<id:long,form:string,pos:long>>, teams array<struct<id:long,name:string,strength:long>>",
    )
    documents.write.json(str(tmp_path / "landed"))
    read = spark.read.schema(documents.schema).json(str(tmp_path / "landed"))
    rows = refresh.landed_rows(read, ("elements", "teams"))
    assert all("json" not in _plan(some).lower() for some in rows.values())
    found = sorted((r["gameweek"], r["id"], r["form"], r["pos"]["at"]) for r in rows["elements"].collect())
    assert found == [(1, 7, "x", 0), (1, 8, "y", 1), (2, 7, "z", 0)]
    assert [(r["gameweek"], r["name"]) for r in rows["teams"].collect()] == [(1, "T")]
    assert "PartitionFilters: [isnotnull(tag" in _plan(rows["teams"].where("gameweek = 1"))
