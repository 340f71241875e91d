import json
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from driver_queries import file_queries
from touchline import session
from touchline.operators.filters import NoRowsError
from touchline.operators.ranking import best_first
from touchline.plans import read_query
from touchline.schemas import ENTITY as ENTITY_SCHEMA
from touchline.schemas import FIXTURE as FIXTURE_SCHEMA
from touchline.schemas import PREDICTIONS
from touchline.sources import documents, readers, writers
from touchline.streaming.refresh import newest_rows, process_landed, refresh

ENVELOPE = {
    "elements": [{"id": 5, "first_name": "A", "second_name": "B", "code": 7, "form": "1.0"}, {"id": 4, "first_name": "C"}],
    "teams": [{"id": 1, "name": "T", "strength": 3}],
    "events": [{"id": 9, "name": "Gameweek 9", "is_next": True}, {"id": 8, "name": "Gameweek 8"}],
}


def test_envelope(spark, tmp_path):
    path = tmp_path / "snapshot.json"
    path.write_text(json.dumps(ENVELOPE, indent=2))
    envelope = readers.read_envelopes(spark, str(path))
    assert [(r["pos"], r["id"]) for r in readers.entities(envelope).collect()] == [(0, 5), (1, 4)]
    assert readers.teams(envelope).first()["strength"] == 3
    assert [r["id"] for r in readers.calendar(envelope).collect()] == [9, 8]
    assert {r["table"]: r["items"] for r in readers.item_counts(envelope).collect()} == {"elements": 2, "teams": 1, "events": 2}
    profile = readers.field_profile(readers.teams(envelope), "teams").collect()
    assert [(r["field"], r["type"], r["sample"]) for r in profile] == [("id", "bigint", "1"), ("name", "string", "T"), ("strength", "bigint", "3")]


def test_root_array_keeps_order(spark, tmp_path):
    path = tmp_path / "fixtures.json"
    path.write_text(json.dumps([{"event": n, "team_h": 1, "team_a": 2} for n in (3, None, 1)], indent=1))
    assert [(r["pos"], r["event"]) for r in readers.read_fixtures(spark, str(path)).collect()] == [(0, 3), (1, None), (2, 1)]


def test_landed_chunks_hold_every_row_once(spark, tmp_path):
    rows = spark.range(2300).withColumn("event", F.col("id") % 5)
    writers.write_envelopes(rows, str(tmp_path / "e"), "elements", rows_per_chunk=100)
    envelopes = readers.read_envelopes(spark, str(tmp_path / "e"), one_per_line=True)
    assert sorted(r["id"] for r in readers.entities(envelopes).select("id").collect()) == list(range(2300))
    assert envelopes.agg(F.max(F.size("elements"))).first()[0] < 160
    for folder, files in (("f", 1), ("h", 7)):
        writers.write_root_arrays(rows.repartition(files, "id").withColumn("pos", F.lit(5000) - F.col("id")), str(tmp_path / folder), rows_per_chunk=100)
        read = readers.read_fixtures(spark, str(tmp_path / folder), one_per_line=True)
        assert sorted((r["pos"], r["id"], r["event"]) for r in read.collect()) == [(5000 - i, i, i % 5) for i in range(2299, -1, -1)]
    given = [row["id"] for row in rows.orderBy(F.desc("id")).collect()]
    writers.write_root_arrays(spark.createDataFrame([(i,) for i in given], "id long"), str(tmp_path / "o"), rows_per_chunk=100)
    read = readers.read_fixtures(spark, str(tmp_path / "o"), one_per_line=True)
    assert [r["id"] for r in read.orderBy("pos").collect()] == given and read.select("pos").distinct().count() == 2300
    empty = rows.limit(0)
    writers.write_envelopes(empty, str(tmp_path / "g"), "elements")


def test_repeated_keys_do_not_fill_one_chunk(spark, tmp_path):
    writers.write_envelopes(spark.range(2000).withColumn("id", F.lit(1).cast("long")), str(tmp_path / "e"), "elements", rows_per_chunk=100)
    envelopes = readers.read_envelopes(spark, str(tmp_path / "e"), one_per_line=True)
    assert envelopes.agg(F.max(F.size("elements"))).first()[0] < 160
    assert readers.entities(envelopes).count() == 2000


def test_csv_columns_are_taken_by_name(spark, tmp_path):
    """Other order, absent columns, further ones, and whole numbers written as fractions."""
    (tmp_path / "gameweek_2_predictions.csv").write_text("minutes,extra,name,is_home,assists,points_per_game,id\n74.0,x,N,True,bad,1.5,8\n\n9,,M,,3,,\n")
    read = readers.read_latest(spark, str(tmp_path))
    assert [f for f in read.columns if f in PREDICTIONS.names] == PREDICTIONS.names
    kinds = {f.name: f.dataType for f in read.schema.fields}
    assert all(kinds[f.name] == f.dataType for f in PREDICTIONS.fields)
    rows = {r["name"]: r for r in read.collect()}
    assert (rows["N"]["minutes"], rows["N"]["is_home"], rows["N"]["assists"], rows["N"]["points_per_game"]) == (74, True, None, 1.5)
    assert (rows["N"]["extra"], rows["N"]["id"], rows["N"]["team"], rows["N"]["gameweek"]) == ("x", 8, None, 2)
    assert (rows["M"]["minutes"], rows["M"]["extra"], rows["M"]["assists"]) == (9, None, 3)


def test_period_is_that_of_the_file(spark, tmp_path):
    folder = tmp_path / "gameweek_99_old"
    folder.mkdir()
    _csv(folder, 3)
    assert readers.latest_period(spark, str(folder)) == 3


def _csv(folder, period, rows=1):
    lines = "\n".join(f"P{n},T{period},MID,,,{n + period}.5,4.5" for n in range(rows))
    (folder / f"gameweek_{period}_predictions.csv").write_text(
        f"name,team,position,next_opponent,fixture,predicted_points,now_cost\n{lines}\n\n"
    )


def test_latest_period_is_numeric(spark, tmp_path):
    assert readers.latest_period(spark, str(tmp_path)) is None
    with pytest.raises(NoRowsError):
        readers.read_latest(spark, str(tmp_path))
    for serve in (read_query.serve_predictions, read_query.serve_statistics, read_query.serve_teams):
        with pytest.raises(NoRowsError):
            serve(spark, str(tmp_path))
    for period in (2, 9, 10):
        _csv(tmp_path, period, rows=2)
    assert readers.latest_period(spark, str(tmp_path)) == 10
    read = readers.read_latest(spark, str(tmp_path), infer=True)
    assert read.count() == 2  # the blank line at the end is no row
    assert {(r["team"], r["gameweek"]) for r in read.collect()} == {("T10", 10)}
    assert dict(read.dtypes)["predicted_points"] == "double"


def test_serve_predictions(spark, tmp_path):
    _csv(tmp_path, 3, rows=5)
    source = spark.createDataFrame([("P", "x", 1, 0), ("P1", "", 5, 1)], "first_name string, second_name string, code long, pos int")
    source = source.withColumn("second_name", F.when(F.col("second_name") == "", None).otherwise(F.col("second_name")))
    shown, metadata = read_query.serve_predictions(spark, str(tmp_path), source, limit=2, sort_order="asc")
    assert [r["name"] for r in shown.collect()] == ["P0", "P1"]
    row = metadata.first()
    assert (row["gameweek"], row["csv_file"]) == (3, "gameweek_3_predictions.csv")
    assert (row["total_players"], row["filtered_players"]) == (5, 2)
    assert re.fullmatch(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d UTC", row["last_updated"])
    prepared, metadata = read_query.serve_predictions(spark, str(tmp_path), read_query.names_of(source), limit=1000, sort_order="asc")
    assert [r["player_code"] for r in prepared.collect()][:2] == [r["player_code"] for r in shown.collect()]
    assert metadata.first()["filtered_players"] == 5
    without, _ = read_query.serve_predictions(spark, str(tmp_path), None)
    assert all(r["image_url"] is None for r in without.collect())


def test_declared_csv_schema(spark, tmp_path):
    rows = spark.createDataFrame(
        [("N", "T", "", True, 1.5, 3)], "name string, team string, fixture string, is_home boolean, predicted_points double, minutes long"
    )
    from touchline.constants import SNAPSHOT_COLUMNS

    full = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in SNAPSHOT_COLUMNS])
    path = writers.export_csv(full, str(tmp_path), 7)
    row = readers.read_predictions(spark, path).first()
    assert (row["is_home"], row["predicted_points"], row["minutes"], row["fixture"]) == (True, 1.5, 3, None)


def test_first_available(spark, tmp_path):
    _csv(tmp_path, 4, rows=3)
    places = [("json", str(tmp_path / "predictions.json")), ("csv", str(tmp_path / "gameweek_4_predictions.csv"))]
    rows, metadata = readers.read_first_available(spark, places)
    assert rows.count() == 3
    assert tuple(metadata.first())[:4] == (0, "gameweek_4_predictions.csv", 3, 3)
    (tmp_path / "predictions.json").write_text(
        json.dumps({"gameweek": 6, "csv_file": "x.csv", "total_players": 9, "filtered_players": 1, "players": [{"name": "N"}]}, indent=1)
    )
    rows, metadata = readers.read_first_available(spark, places)
    assert [r["name"] for r in rows.collect()] == ["N"]
    assert metadata.first()["gameweek"] == 6
    with pytest.raises(NoRowsError):
        readers.read_first_available(spark, places[:0])


def test_publish_replaces_only_its_period(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = lambda period, n: spark.range(n).withColumns({"predicted_points": F.rand(1), "gameweek": F.lit(period)})
    for period, n in ((1, 5), (2, 7), (1, 3), (1, 3)):
        writers.publish(rows(period, n), table, best_first("predicted_points"))
    published = readers.read_published(spark, table)
    assert {r["gameweek"]: r["count"] for r in published.groupBy("gameweek").count().collect()} == {1: 3, 2: 7}
    assert readers.latest_partition(published).count() == 7 and published.columns == rows(1, 1).columns
    writers.publish(rows(1, 0), table)  # no rows, no period
    assert readers.read_published(spark, table).count() == 10


def test_readers_keep_what_they_began_with(spark, tmp_path):
    """A period is published again while it is read: nothing of the version in use goes, and old versions are listed."""
    table, rows = str(tmp_path / "t"), lambda n, at: spark.range(n).withColumns({"predicted_points": F.lit(float(at)), "gameweek": F.lit(4)})
    writers.publish(rows(50, 1).repartition(5), table)
    begun = readers.read_published(spark, table)
    halfway = begun.toLocalIterator()
    first = next(halfway)
    files = [f for f in begun.inputFiles() if "/versions/" in f]
    writers.publish(rows(7, 2), table)
    assert 1 + len(list(halfway)) == 50 and first["predicted_points"] == 1.0
    assert begun.where("predicted_points = 1").count() == 50  # a new query over the old files
    assert {r["predicted_points"] for r in readers.read_published(spark, table).collect()} == {2.0}
    old = [r["path"] for r in writers.superseded(spark, table).collect()]
    assert len(old) == 1 and files and all(old[0] in f for f in files)
    left = spark.read.parquet(old[0])
    assert left.count() == 50
    found = readers.published_versions(spark, table).collect()
    assert [r["current"] for r in sorted(found, key=lambda r: r["version"])] == [False, True]


def test_failed_publication_does_not_count(spark, tmp_path):
    table = str(tmp_path / "t")
    writers.publish(spark.range(3).withColumn("gameweek", F.lit(1)), table)
    broken = spark.range(5).withColumn("gameweek", F.when(F.col("id") < 4, 1).otherwise(F.raise_error(F.lit("broken"))))
    with pytest.raises(Exception, match="broken"):
        writers.publish(broken, table)
    assert readers.read_published(spark, table).count() == 3


def test_csv_files_with_other_headers(spark, tmp_path):
    """Each file by its own header, as a list and as a folder."""
    one, two, three = (tmp_path / "exports" / f"{n}.csv" for n in ("b", "a", "c"))
    one.parent.mkdir()
    one.write_text("name,team,minutes,predicted_points\nA,T1,45,2.5\n\n")
    two.write_text("\nname,predicted_points,team,minutes,note\r\nB,3.5,T2,90,x\r\n")
    three.write_text("id,name\n8,C\n")
    (tmp_path / "exports" / "empty.csv").write_text("")
    (tmp_path / "exports" / "_hidden").write_text("what,ever\n1,2\n")
    want = {("A", "T1", 45, 2.5, None, None), ("B", "T2", 90, 3.5, "x", None), ("C", None, None, None, None, 8)}
    for path in ([str(p) for p in (one, two, three)], [str(three), str(two), str(one)], str(tmp_path / "exports")):
        read = readers.read_predictions(spark, path)
        assert [c for c in read.columns if c in PREDICTIONS.names] == PREDICTIONS.names
        assert {tuple(r) for r in read.select("name", "team", "minutes", "predicted_points", "note", "id").collect()} == want
    inferred = readers.read_predictions(spark, [str(one), str(two)], infer=True)
    assert {(r["name"], r["minutes"], r["note"]) for r in inferred.collect()} == {("A", 45, None), ("B", 90, "x")}
    assert dict(inferred.dtypes)["minutes"] == "int"
    clash = tmp_path / "clash.csv"
    clash.write_text("minutes,team\n1.5,7\n")
    mixed = readers.read_predictions(spark, [str(one), str(clash)], infer=True)
    assert dict(mixed.dtypes)["minutes"] == "double" and {r["team"] for r in mixed.collect()} == {"T1", "7"}
    (tmp_path / "none").mkdir()
    assert readers.read_predictions(spark, str(tmp_path / "none")).count() == 0


def test_headers_of_many_part_files(spark, tmp_path):
    """Part files of a write share a header, so one of them is looked at for each write."""
    for n, columns in enumerate((["id", "name", "minutes"], ["minutes", "id"], ["name", "id", "minutes"])):
        spark.range(n * 100, n * 100 + 100).selectExpr("id", "concat('n', id) AS name", "id * 2 AS minutes").select(*columns).repartition(6).write.mode("append").option(
            "header", True
        ).csv(str(tmp_path / "out"))
    read = readers.read_predictions(spark, str(tmp_path / "out"))
    rows = {r["id"]: (r["name"], r["minutes"]) for r in read.collect()}
    assert rows == {n: (None if 100 <= n < 200 else f"n{n}", 2 * n) for n in range(300)}
    exports = readers._exports(spark, str(tmp_path / "out"), {"header": True})
    assert sorted(len(e.files) for e in exports) == [6, 6, 6]


def test_response_records(spark):
    df = spark.createDataFrame([(1, None)], "id int, name string")
    assert writers.response_records(df).first()["record"] == '{"id":1,"name":null}'


def test_image_sources_of_rows(spark):
    df = spark.createDataFrame(
        [("A B", "MID", "p", "", None, 3), ("C", None, None, None, None, None)],
        "name string, position string, image_url_primary string, image_url_secondary string, image_url_tertiary string, player_code long",
    )
    rows = {r["name"]: r for r in read_query.with_image_sources(df).collect()}
    assert len(rows["A B"]["image_sources"]) == 2 and rows["A B"]["image_sources"][0] == "p"
    assert len(rows["C"]["image_sources"]) == 1
    assert rows["A B"]["initials"] == "AB"


def _build(documents):
    return documents.select("gameweek", F.explode("elements").alias("e")).select(
        "gameweek", "e.id", F.col("e.minutes").cast("double").alias("predicted_points")
    )


def test_refresh(spark, tmp_path):
    landing, out, state = (str(tmp_path / name) for name in ("landing", "out", "state"))
    land = lambda period, low, high: writers.write_envelopes(
        spark.range(low, high).withColumn("minutes", F.col("id") * period), f"{landing}/gameweek={period}", "elements", rows_per_chunk=10
    )

    def run():
        refresh(spark, landing, out, state, _build, best_first("predicted_points"))
        table = readers.read_published(spark, f"{out}/predictions")
        latest = readers.read_newest(spark, out)
        return {r["gameweek"]: r["count"] for r in table.groupBy("gameweek").count().collect()}, latest.select("gameweek").distinct().collect()

    (tmp_path / "landing").mkdir()
    refresh(spark, landing, out, state, _build)  # nothing landed yet
    assert not (tmp_path / "out").exists()
    land(9, 0, 30)
    assert run()[0] == {9: 30}
    land(9, 30, 50)
    land(10, 0, 7)
    counts, latest = run()
    assert counts == {9: 50, 10: 7}
    assert [r[0] for r in latest] == [10]
    files = lambda: sorted(str(p) for p in (tmp_path / "out").rglob("*.parquet"))
    before = files()
    assert run()[0] == {9: 50, 10: 7}  # nothing new landed
    assert files() == before


@pytest.mark.parametrize("chunk", [5, 1000])
def test_newest_landing_wins(spark, tmp_path, chunk):
    """Three overlapping snapshots of a period, in many files or few: of each key the last one counts."""
    landing, out, state = (str(tmp_path / name) for name in ("landing", "out", "state"))
    build = lambda documents: newest_rows(documents, "elements").select("gameweek", "id", F.col("minutes").alias("predicted_points"))
    for low, high, minutes in ((0, 30, 1), (20, 40, 2), (10, 22, 3)):
        rows = spark.range(low, high).withColumn("minutes", F.lit(minutes).cast("long"))
        writers.write_envelopes(rows, f"{landing}/gameweek=4", "elements", rows_per_chunk=chunk)
        refresh(spark, landing, out, state, build)
        time.sleep(1.1)  # file times may be whole seconds
    got = {r["id"]: r["predicted_points"] for r in readers.read_published(spark, f"{out}/predictions").collect()}
    assert got == {i: 3 if 10 <= i < 22 else 2 if i >= 20 else 1 for i in range(40)}


def _landed_files(folder):
    return sorted(p.name for p in folder.rglob("*.json"))


def test_handled_files_move_to_the_archive(spark, tmp_path):
    """Of many handled files only those of the last run are listed again; a period that is touched later still has all of its rows."""
    landing, out, state, archive = (str(tmp_path / name) for name in ("landing", "out", "state", "kept"))
    build = lambda documents: newest_rows(documents, "elements").select("gameweek", "id", F.col("minutes").alias("predicted_points"))

    def land(period, low, high, minutes):
        rows = spark.range(low, high).withColumn("minutes", F.lit(minutes).cast("long"))
        writers.write_envelopes(rows, f"{landing}/gameweek={period}", "elements", rows_per_chunk=2)

    def run():
        refresh(spark, landing, out, state, build, archive=archive)
        read = readers.read_published(spark, f"{out}/predictions")
        return {(r["gameweek"], r["id"]): r["predicted_points"] for r in read.collect()}

    before = spark.conf.get("spark.sql.streaming.fileSource.cleaner.numThreads")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 1)
    try:
        land(1, 0, 40, 1)
        land(2, 0, 40, 2)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    first = _landed_files(tmp_path / "landing")
    assert len(first) >= 20
    want = {(period, n): period for period in (1, 2) for n in range(40)}
    assert run() == want
    for minutes, low in ((7, 30), (8, 45), (9, 0)):
        time.sleep(1.1)  # file times may be whole seconds
        land(2, low, low + 20, minutes)
        handled = _landed_files(tmp_path / "kept")
        waiting = _landed_files(tmp_path / "landing")
        want |= {(2, n): minutes for n in range(low, low + 20)}
        assert run() == want
        left = _landed_files(tmp_path / "landing")
        assert 0 < len(left) < len(first) and sorted(_landed_files(tmp_path / "kept") + left) == sorted(handled + waiting)
    assert set(first) <= set(_landed_files(tmp_path / "kept"))
    files = sorted(str(p) for p in (tmp_path / "out").rglob("*.parquet"))
    assert run() == want  # nothing new landed
    assert sorted(str(p) for p in (tmp_path / "out").rglob("*.parquet")) == files
    assert spark.conf.get("spark.sql.streaming.fileSource.cleaner.numThreads") == before


def test_run_that_breaks_off_moves_nothing(spark, tmp_path):
    """The files of a batch whose handling failed stay, and the next run hands them over with what landed since."""
    landing, state, archive = (str(tmp_path / name) for name in ("land ing", "state", "kept"))
    seen, fail = [], [True]

    def handle(documents, periods):
        if fail[0]:
            raise ValueError("broken off")
        rows = documents.select("gameweek", F.explode("elements").alias("e")).groupBy("gameweek").count()
        seen.append({r["gameweek"]: r["count"] for r in rows.collect()})

    land = lambda period, count: writers.write_envelopes(spark.range(count), f"{landing}/gameweek={period}", "elements", rows_per_chunk=3)
    land(1, 8)
    with pytest.raises(Exception, match="broken off"):
        process_landed(spark, landing, state, handle, archive=archive)
    names = _landed_files(tmp_path / "land ing")
    assert names and _landed_files(tmp_path / "kept") == []
    fail[0] = False
    land(2, 5)
    assert process_landed(spark, landing, state, handle, archive=archive)
    assert seen == [{1: 8}, {2: 5}]
    land(1, 4)
    assert process_landed(spark, landing, state, handle, archive=archive)
    assert seen[2:] == [{1: 12}]
    assert not process_landed(spark, landing, state, handle, archive=archive)
    before = set((tmp_path / "land ing").rglob("*.json"))
    land(2, 2)
    month_ago = time.time() - 30 * 86400
    for late in set((tmp_path / "land ing").rglob("*.json")) - before:
        os.utime(late, (month_ago, month_ago))  # as of a copy that keeps the time of its original
    assert process_landed(spark, landing, state, handle, archive=archive)
    assert seen[3:] == [{2: 7}]


def test_shared_folder_comes_from_the_session(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    staged = session.stage(spark.range(5), "t")
    assert staged.count() == 5
    assert session.shared_dir(spark) in staged.inputFiles()[0]


TRICKY = [
    {"id": 0, "form": "a } b { c [ d ] \" e \\", "web_name": "}"},
    {"id": 1, "first_name": "\\\\\"}", "nested": {"a": [{"b": {}}, {}], "c": "]}"}},
    {"id": 2, "web_name": "é🙂 [{ \u007d"},
    {},
    {"id": 4, "teams": [{"id": 9}], "web_name": "\"teams\": [{"},
]


@pytest.fixture
def small_blocks(spark):
    """Files are cut into blocks of a few bytes, as large ones are into blocks of many."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {key: spark.conf.get(key, None) for key in keys}

    def cut(size):
        for key, value in zip(keys, (size, 1, 1), strict=True):
            spark.conf.set(key, value)

    yield cut
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("size", [40, 150, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_one_document_is_read_by_many_tasks(spark, tmp_path, small_blocks, size, indent):
    elements = TRICKY + [{"id": 10 + n, "web_name": f"n{n}" + "}" * (n % 3), "minutes": n} for n in range(60)]
    document = {"note": "[{", "empty": [], "elements": elements, "total": {"x": [1, 2]}, "other": [{"id": 5}, {"id": 6}], "teams": [{"id": n, "name": f"T{n}"} for n in range(5)], "events": []}
    (tmp_path / "one.json").write_text(json.dumps(document, indent=indent, ensure_ascii=False))
    (tmp_path / "two.json").write_text(json.dumps({"teams": [{"id": 77}]}))
    small_blocks(size)
    pieces = documents._pieces(spark, str(tmp_path))
    if size < 1000:
        assert pieces.rdd.getNumPartitions() > 10
    split = documents.split_documents(spark, str(tmp_path), ["elements", "teams", "events"])
    small_blocks(1 << 27)
    got = {(r["array"], r["file"].rsplit("/", 1)[-1], r["at"]): json.loads(r["item"]) for r in split.collect()}
    want = {("elements", "one.json", n): e for n, e in enumerate(elements)} | {("teams", "one.json", n): t for n, t in enumerate(document["teams"])}
    assert got == want | {("teams", "two.json", 0): {"id": 77}} and split.count() == len(got)
    rows = documents.document_rows(split, ENTITY_SCHEMA, "elements").orderBy("pos").collect()
    assert [(r["pos"], r["id"], r["web_name"]) for r in rows] == [(n, e.get("id"), e.get("web_name")) for n, e in enumerate(elements)]


@pytest.mark.parametrize("size", [30, 1 << 20])
def test_root_array_is_read_by_many_tasks(spark, tmp_path, small_blocks, size):
    given = [{"id": n, "event": n % 3, "note": "}" * (n % 2)} for n in range(40)] + TRICKY
    (tmp_path / "f.json").write_text("  \n" + json.dumps(given, indent=1, ensure_ascii=False) + "\n")
    (tmp_path / "none.json").write_text("[]")
    small_blocks(size)
    split = documents.split_documents(spark, str(tmp_path))
    small_blocks(1 << 27)
    assert [json.loads(r["item"]) for r in split.orderBy("at").collect()] == given
    rows = documents.document_rows(split, FIXTURE_SCHEMA)
    assert [(r["pos"], r["id"], r["event"]) for r in rows.orderBy("pos").collect()] == [(n, g.get("id"), g.get("event")) for n, g in enumerate(given)]


def test_the_task_that_writes_one_document_does_not_sort(spark, tmp_path, monkeypatch):
    rows = spark.range(0, 3000, 1, 9).select((F.col("id") * 37 % 3000).alias("id"), F.lit('a"}').alias("note"))
    teams = spark.range(2).select("id", F.lit("T").alias("note"))
    plans, coalesce = [], type(rows).coalesce

    def gathered(df, parts):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return coalesce(df, parts)

    monkeypatch.setattr(type(rows), "coalesce", gathered)
    file_queries._one_document(spark, [("elements", rows, "id"), ("teams", teams, "id")], str(tmp_path / "one"))
    assert len(plans) == 1 and "Sort" not in plans[0] and "Exchange" not in plans[0]
    (path,) = (tmp_path / "one").glob("part-*")
    assert json.loads(path.read_text()) == {"elements": [{"id": n, "note": 'a"}'} for n in range(3000)], "teams": [{"id": n, "note": "T"} for n in range(2)]}
