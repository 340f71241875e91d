"""Snapshots written and read again, and the refresh."""

from pyspark.sql import functions as F

from driver_queries import bindings as b
from driver_queries.read_queries import CLAUSES
from driver_queries.registry import query
from touchline.operators import lookups, ranking
from touchline.operators.ranking import best_first
from touchline.plans import read_query
from touchline.schemas import ENTITY, FIXTURE, PERIOD, TEAM
from touchline.session import new_folder, stage
from touchline.sources import documents, readers, writers
from touchline.streaming.refresh import newest_rows, refresh

KEPT = ["name", "team", "position", "predicted_points", "now_cost", "form", "minutes"]


def _rows(spark, sf_dir):
    """Written once, for each of these queries writes them several times over."""
    return stage(b.snapshot(spark, sf_dir, "id", *KEPT), "snapshot")


@query("snapshot_roundtrip", b.with_(*CLAUSES, f"SELECT 9 AS gameweek, id, {', '.join(KEPT)} FROM snapshot"))
def snapshot_roundtrip(spark, sf_dir):
    """Published as a table partition twice, the second time over the first."""
    folder = new_folder(spark, "published")
    rows = _rows(spark, sf_dir).withColumn("gameweek", F.lit(9))
    writers.publish(rows.withColumn("minutes", F.lit(0).cast("long")), folder)
    writers.publish(rows, folder, best_first("predicted_points"))
    return readers.read_published(spark, folder).select("gameweek", "id", *KEPT)


LATEST = """SELECT 10 AS gameweek, name, team, position, predicted_points + 10 AS predicted_points, now_cost, form, minutes
  FROM snapshot"""


@query("latest_snapshot", b.with_(*CLAUSES, LATEST))
def latest_snapshot(spark, sf_dir):
    """Periods 2, 9 and 10 exported as CSV; the latest by number is read."""
    folder = new_folder(spark, "exports")
    rows = _rows(spark, sf_dir)
    for period in (2, 9, 10):
        shifted = rows.withColumn("predicted_points", F.col("predicted_points") + period)
        writers.export_csv(shifted, folder, period)
    return readers.read_latest(spark, folder).select("gameweek", *KEPT)


@query("latest_partition", b.with_(*CLAUSES, LATEST))
def latest_partition(spark, sf_dir):
    """The same on the partitioned table, where only the newest partition is read."""
    folder = new_folder(spark, "published")
    rows = _rows(spark, sf_dir)
    for period in (2, 9, 10):
        shifted = rows.withColumns({"predicted_points": F.col("predicted_points") + period, "gameweek": F.lit(period)})
        writers.publish(shifted, folder)
    return readers.latest_partition(readers.read_published(spark, folder)).select("gameweek", *KEPT)


@query(
    "csv_snapshot_schema",
    b.with_(*CLAUSES, "SELECT name, team, position, round(predicted_points, 4) AS predicted_points, minutes FROM snapshot"),
)
def csv_snapshot_schema(spark, sf_dir):
    """A CSV snapshot without most of its columns, read by the names in its header."""
    folder = new_folder(spark, "exports")
    writers.export_csv(_rows(spark, sf_dir), folder, 3)
    read = readers.read_latest(spark, folder)
    return read.select("name", "team", "position", F.round("predicted_points", 4).alias("predicted_points"), "minutes")


MANY_HEADERS = """SELECT id, name, team, position, round(predicted_points, 4) AS predicted_points, minutes, CAST(NULL AS BIGINT) AS total_points, NULL AS note
  FROM snapshot WHERE position = 'MID'
  UNION ALL SELECT id, name, NULL, position, round(predicted_points, 4), NULL, NULL, NULL FROM snapshot WHERE position = 'DEF'
  UNION ALL SELECT id, name, team, position, NULL, minutes, id, 'n' || id FROM snapshot WHERE position NOT IN ('MID', 'DEF')"""


@query("csv_many_headers", b.with_(*CLAUSES, MANY_HEADERS))
def csv_many_headers(spark, sf_dir):
    """Three exports with different columns in different orders: one folder holds two of them, and it is read with the third."""
    folder = new_folder(spark, "exports")
    rows = _rows(spark, sf_dir)
    points = F.round("predicted_points", 4).alias("predicted_points")
    own = [F.col("id").alias("total_points"), F.concat(F.lit("n"), "id").alias("note")]
    made = [
        rows.where("position = 'MID'").select("name", "team", "position", points, "minutes", "id"),
        rows.where("position = 'DEF'").select("id", points, "position", "name"),
        rows.where("position NOT IN ('MID', 'DEF')").select(own[1], "minutes", "team", "position", own[0], "name", "id"),
    ]
    for part, place in zip(made, ("first", "first", "second"), strict=True):
        part.write.mode("append").option("header", True).csv(f"{folder}/{place}")
    read = readers.read_predictions(spark, [f"{folder}/first", f"{folder}/second"])
    return read.select("id", "name", "team", "position", "predicted_points", "minutes", "total_points", "note")


@query(
    "first_available",
    b.with_(*CLAUSES, "SELECT team, count(*) AS rows, max(predicted_points) AS best FROM snapshot GROUP BY team"),
)
def first_available(spark, sf_dir):
    """The first source does not exist, so the rows come from the CSV copy."""
    folder = new_folder(spark, "exports")
    path = writers.export_csv(_rows(spark, sf_dir), folder, 4)
    found, _ = readers.read_first_available(spark, [("json", f"{folder}/predictions.json"), ("csv", path)])
    return found.groupBy("team").agg(F.count(F.lit(1)).alias("rows"), F.max("predicted_points").alias("best"))


def _entity_rows(spark, sf_dir):
    rows = b.players(spark, sf_dir).withColumn("team", F.col("team_id"))
    known = [f for f in ENTITY.fields if f.name in rows.columns]
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in known])


@query(
    "latest_copy",
    b.with_(*CLAUSES, f"SELECT id, {', '.join(KEPT)}, true AS stamped FROM snapshot"),
)
def latest_copy(spark, sf_dir):
    """The newest published rows, of a period published twice after an older one, with the time of refresh."""
    folder = new_folder(spark, "copies")
    rows = _rows(spark, sf_dir)
    stale = rows.withColumn("minutes", F.lit(0).cast("long"))
    for period, published in ((9, stale), (10, stale), (10, rows)):
        writers.publish(published.withColumn("gameweek", F.lit(period)), f"{folder}/predictions")
        writers.stamp(spark, folder)
    read = readers.read_newest(spark, folder)
    stamped = F.col("last_updated").rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d UTC$")
    return read.select("id", *KEPT, stamped.alias("stamped"))


@query(
    "serve_predictions",
    b.with_(
        *CLAUSES,
        """SELECT 5 AS gameweek, name, team, position, predicted_points, COALESCE(form, 0) AS form, id AS player_code,
                  'https://resources.premierleague.com/premierleague/photos/players/110x140/p' || id || '.png' AS image_url,
                  (SELECT count(*) FROM snapshot) AS total_players, 30 AS filtered_players
           FROM snapshot WHERE regexp_matches(team, 'nation', 'i') AND position = 'MID'
           ORDER BY predicted_points DESC, id LIMIT 30""",
    ),
)
def serve_predictions(spark, sf_dir):
    """Latest CSV, codes looked up by name, filtered, sorted and limited, with its counts."""
    folder = new_folder(spark, "exports")
    writers.export_csv(_rows(spark, sf_dir), folder, 5, best_first("predicted_points"))
    source = b.players(spark, sf_dir, "first_name", "second_name", "code").withColumn("pos", F.col("code"))
    names = read_query.names_of(source)
    shown, metadata = read_query.serve_predictions(spark, folder, names, team="nation", position="MID", limit=30)
    counts = metadata.select("gameweek", "total_players", "filtered_players")
    number = lambda name: counts.select(name).scalar().alias(name)
    return shown.select(
        number("gameweek"), "name", "team", "position", "predicted_points", "form", "player_code", "image_url",
        number("total_players"), number("filtered_players").cast("int").alias("filtered_players"),
    )


@query(
    "serve_statistics",
    b.with_(
        *CLAUSES,
        """SELECT 10 AS gameweek, count(*) AS total_players, round(avg(predicted_points + 10), 6) AS avg_predicted_points,
                  max(predicted_points) + 10 AS max_predicted_points, count(DISTINCT team) AS teams,
                  (SELECT string_agg(position || ':' || n, ',' ORDER BY position) FROM
                     (SELECT position, count(*) AS n FROM snapshot WHERE position IS NOT NULL GROUP BY position)) AS positions
           FROM snapshot""",
    ),
)
def serve_statistics(spark, sf_dir):
    """The latest of two exports is found by its name and summed up."""
    served = read_query.serve_statistics(spark, _two_exports(spark, sf_dir))
    entry = lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))
    positions = F.array_join(F.transform(F.map_entries("positions"), entry), ",")
    mean = F.round("avg_predicted_points", 6).alias("avg_predicted_points")
    return served.select("gameweek", "total_players", mean, "max_predicted_points", "teams", positions.alias("positions"))


@query("serve_teams", b.with_(*CLAUSES, "SELECT DISTINCT team FROM snapshot WHERE team <> ''"))
def serve_teams(spark, sf_dir):
    """The teams of the latest of two exports; the older one has others."""
    return read_query.serve_teams(spark, _two_exports(spark, sf_dir))


def _two_exports(spark, sf_dir):
    folder = new_folder(spark, "exports")
    rows = _rows(spark, sf_dir)
    writers.export_csv(rows.withColumn("team", F.lit("older")), folder, 9)
    writers.export_csv(rows.withColumn("predicted_points", F.col("predicted_points") + 10), folder, 10)
    return folder


@query(
    "serve_repeated_names",
    b.with_(
        *CLAUSES,
        """SELECT team AS name, position, predicted_points, minutes, (SELECT count(*) FROM snapshot) AS total_players,
                  (SELECT count(*) FROM snapshot WHERE position = 'FWD') AS filtered_players
           FROM snapshot WHERE position = 'FWD' ORDER BY minutes ASC, id LIMIT 1000000""",
    ),
)
def serve_repeated_names(spark, sf_dir):
    """Twenty-five names for all rows: the key in the export settles ties, and the limit exceeds the matches."""
    folder = new_folder(spark, "exports")
    writers.export_csv(_rows(spark, sf_dir).withColumn("name", F.col("team")), folder, 5, best_first("predicted_points"))
    shown, metadata = read_query.serve_predictions(spark, folder, position="FWD", sort_by="minutes", sort_order="asc", limit=1_000_000)
    number = lambda name: metadata.select(name).scalar().alias(name)
    return shown.select("name", "position", "predicted_points", "minutes", number("total_players"), number("filtered_players"))


@query(
    "first_available_json",
    b.with_(
        *CLAUSES,
        """SELECT 12 AS gameweek, name, team, position, predicted_points, form, minutes, count(*) OVER () AS total_players,
                  count(*) FILTER (WHERE position = 'MID') OVER () AS filtered_players FROM snapshot""",
    ),
)
def first_available_json(spark, sf_dir):
    """Stored response documents, each with some of the rows and all of the metadata, come before the CSV copy."""
    folder = new_folder(spark, "responses")
    rows = _rows(spark, sf_dir)
    counts = writers.response_metadata(rows, rows.where("position = 'MID'"), 12, "gameweek_12_predictions.csv")
    documents = writers.chunked(rows, "id", 500).select(F.col("items").alias("players"))
    number = lambda name: counts.select(name).scalar().alias(name)
    documents = documents.select(*[number(name) for name in counts.columns], "players")
    documents.write.json(f"{folder}/predictions.json")
    found, metadata = readers.read_first_available(spark, [("jsonl", f"{folder}/predictions.json"), ("csv", f"{folder}/none.csv")])
    one = lambda name: metadata.select(F.max(name)).scalar().alias(name)
    return found.select(
        one("gameweek"), "name", "team", "position", "predicted_points", "form", "minutes", one("total_players"), one("filtered_players")
    )


@query(
    "calendar_roundtrip",
    b.with_(
        b.FIXTURES_SQL,
        b.CALENDAR_SQL,
        "SELECT id, name, is_current, is_next, finished FROM calendar",
    ),
)
def calendar_roundtrip(spark, sf_dir):
    """The calendar landed as snapshot documents and read again."""
    folder = new_folder(spark, "landing")
    days = b.calendar(spark, sf_dir).select(*[F.col(f.name).cast(f.dataType) for f in PERIOD.fields])
    writers.write_envelopes(days, folder, "events")
    read = readers.calendar(readers.read_envelopes(spark, folder, one_per_line=True))
    return read.select("id", "name", "is_current", "is_next", "finished")


@query(
    "envelope_roundtrip",
    b.with_(
        b.PLAYERS_SQL,
        b.TEAMS_SQL,
        """SELECT p.id, t.name AS team, t.strength, minutes, form, points_per_game, starts
           FROM players p LEFT JOIN teams t ON t.id = team_id""",
    ),
)
def envelope_roundtrip(spark, sf_dir):
    """Players and teams landed as snapshot documents, read and joined again."""
    folder = new_folder(spark, "landing")
    writers.write_envelopes(stage(_entity_rows(spark, sf_dir), "entities"), folder, "elements")
    team_rows = b.teams(spark, sf_dir).select(*[F.col(f.name).cast(f.dataType) for f in TEAM.fields])
    writers.write_envelopes(team_rows, folder, "teams")
    envelopes = readers.read_envelopes(spark, folder, one_per_line=True)
    joined = lookups.look_up(
        readers.entities(envelopes), readers.teams(envelopes), {"team": "id"}, {"team": "name", "strength": "strength"}
    )
    return joined.select("id", "team", F.col("strength").cast("int").alias("strength"), "minutes", "form", "points_per_game", "starts")


@query(
    "fixtures_roundtrip",
    b.with_(
        b.FIXTURES_SQL,
        """SELECT pos AS id, CAST(event AS BIGINT) AS event, team_h, team_a, finished, row_number() OVER (ORDER BY pos) AS place
           FROM fixtures""",
    ),
)
def fixtures_roundtrip(spark, sf_dir):
    """Fixtures landed in their order as root-level arrays, and read again with that order."""
    folder = new_folder(spark, "landing")
    rows = b.fixtures(spark, sf_dir).withColumnRenamed("pos", "id").select(*[F.col(f.name).cast(f.dataType) for f in FIXTURE.fields])
    writers.write_root_arrays(stage(rows.orderBy("id").withColumn("pos", F.monotonically_increasing_id()), "fixtures"), folder)
    read = ranking.rank_rows(readers.read_fixtures(spark, folder, one_per_line=True), [F.asc("pos")], alias="place")
    return read.select(
        "id", "event", F.col("team_h").cast("int").alias("team_h"), F.col("team_a").cast("int").alias("team_a"), "finished", "place"
    )


def _one_document(spark, arrays, path):
    """One JSON document of these tables, an array each, written as a single file; without a name it is the array.

    Many tasks sort the lines; the one that writes the file takes their sorted parts one after another and holds a line at a time.
    """
    line = lambda part, at, value: [F.lit(part).alias("part"), at.alias("at"), value.alias("value")]
    end = "]}" if arrays[0][0] else "]"
    lines = spark.range(1).select(*line(1000, F.lit(0).cast("long"), F.lit(end)))
    for place, (name, rows, key) in enumerate(arrays):
        opened = ("{" if place == 0 else "], ") + f'"{name}": [' if name else "["
        comma = F.when(F.col(key) > rows.agg(F.min(key)).scalar(), ",").otherwise("")
        lines = lines.union(spark.range(1).select(*line(2 * place, F.lit(0).cast("long"), F.lit(opened))))
        lines = lines.union(rows.select(*line(2 * place + 1, F.col(key).cast("long"), F.concat(comma, F.to_json(F.struct("*"))))))
    writers.in_order(lines, [F.col("part"), F.col("at")]).coalesce(1).select("value").write.text(path)


@query(
    "envelope_whole",
    b.with_(
        b.PLAYERS_SQL,
        b.TEAMS_SQL,
        """SELECT p.id, row_number() OVER (ORDER BY p.id) - 1 AS place, t.name AS team, t.strength, minutes, form, points_per_game, starts
           FROM players p LEFT JOIN teams t ON t.id = team_id""",
    ),
)
def envelope_whole(spark, sf_dir):
    """Players and teams as one document, which several tasks read by its blocks."""
    folder = new_folder(spark, "landing")
    team_rows = b.teams(spark, sf_dir).select(*[F.col(f.name).cast(f.dataType) for f in TEAM.fields])
    _one_document(spark, [("elements", _entity_rows(spark, sf_dir), "id"), ("teams", team_rows, "id")], folder)
    items = documents.split_documents(spark, folder, ["elements", "teams"])
    found = documents.document_rows(items, ENTITY, "elements").withColumnRenamed("pos", "place")
    joined = lookups.look_up(found, documents.document_rows(items, TEAM, "teams"), {"team": "id"}, {"team": "name", "strength": "strength"})
    return joined.select("id", "place", "team", F.col("strength").cast("int").alias("strength"), "minutes", "form", "points_per_game", "starts")


@query(
    "fixtures_whole",
    b.with_(
        b.FIXTURES_SQL,
        """SELECT pos AS id, CAST(event AS BIGINT) AS event, team_h, team_a, finished, row_number() OVER (ORDER BY pos) - 1 AS place
           FROM fixtures""",
    ),
)
def fixtures_whole(spark, sf_dir):
    """Fixtures as one root-level array in one file, which several tasks read by its blocks."""
    folder = new_folder(spark, "landing")
    rows = b.fixtures(spark, sf_dir).withColumnRenamed("pos", "id").select(*[F.col(f.name).cast(f.dataType) for f in FIXTURE.fields])
    _one_document(spark, [("", rows, "id")], folder)
    read = documents.document_rows(documents.split_documents(spark, folder), FIXTURE)
    return read.select(
        "id", "event", F.col("team_h").cast("int").alias("team_h"), F.col("team_a").cast("int").alias("team_a"), "finished", F.col("pos").alias("place")
    )


@query(
    "array_sizes",
    "SELECT 'elements' AS \"table\", count(*) AS items FROM customer UNION ALL SELECT 'teams', count(*) FROM nation UNION ALL SELECT 'events', 0",
)
def array_sizes(spark, sf_dir):
    """Number of items per top-level array of the landed documents."""
    folder = new_folder(spark, "landing")
    key = F.col("c_custkey").alias("id")
    writers.write_envelopes(b.table(spark, sf_dir, "customer").select(key), folder, "elements")
    writers.write_envelopes(b.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id")), folder, "teams")
    return readers.item_counts(readers.read_envelopes(spark, folder, one_per_line=True))


@query(
    "field_profile",
    """WITH first_row AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1)
       SELECT 'orders' AS "table", field, type, sample FROM (
         SELECT 'o_custkey' AS field, 'bigint' AS type, CAST(o_custkey AS VARCHAR) AS sample FROM first_row
         UNION ALL SELECT 'o_orderdate', 'date', CAST(CAST(o_orderdate AS DATE) AS VARCHAR) FROM first_row
         UNION ALL SELECT 'o_orderkey', 'bigint', CAST(o_orderkey AS VARCHAR) FROM first_row
         UNION ALL SELECT 'o_orderpriority', 'string', o_orderpriority FROM first_row
         UNION ALL SELECT 'o_orderstatus', 'string', o_orderstatus FROM first_row)""",
)
def field_profile(spark, sf_dir):
    """Fields of a table by name, with type and the first row's value."""
    orders = b.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("date").alias("o_orderdate")
    )
    return readers.field_profile(orders.withColumn("pos", F.col("o_orderkey")), "orders")


@query(
    "refresh_stream",
    b.with_(
        *CLAUSES,
        """SELECT w AS gameweek, id, team_id, minutes, round(COALESCE(TRY_CAST(points_per_game AS DOUBLE), 0) * 0.6E0, 6) AS predicted_points
           FROM players, (VALUES (9), (10)) v(w)""",
    ),
)
def refresh_stream(spark, sf_dir):
    """Two runs of the refresh: the first sees period 9 in part, the second the rest of it and period 10."""
    rows, land, run, published = _refreshed(spark, sf_dir)
    land(rows.where("minutes <= 100"), 9)
    run()
    land(rows.where("minutes > 100"), 9)
    land(rows, 10)
    run()
    return published()


@query(
    "refresh_same_period",
    b.with_(
        *CLAUSES,
        """SELECT 9 AS gameweek, id, CASE WHEN id % 3 = 0 THEN 24 - team_id ELSE team_id END AS team_id,
                  CASE WHEN id % 3 = 0 THEN minutes + 1 ELSE minutes END AS minutes,
                  round(COALESCE(TRY_CAST(points_per_game AS DOUBLE), 0) * 0.6E0, 6) AS predicted_points FROM players""",
    ),
)
def refresh_same_period(spark, sf_dir):
    """A second snapshot of a period, with changed values for a third of the entities: of each entity the newest counts."""
    rows, land, run, published = _refreshed(spark, sf_dir)
    land(rows, 9)
    run()
    changed = {"team": F.lit(24) - F.col("team"), "minutes": F.col("minutes") + 1}
    land(rows.where("id % 3 = 0").withColumns(changed), 9)
    run()
    return published()


@query(
    "refresh_archived",
    b.with_(
        *CLAUSES,
        """SELECT w AS gameweek, id, CASE WHEN w = 9 AND id % 5 = 0 THEN 24 - team_id ELSE team_id END AS team_id,
                  CASE WHEN w = 9 AND id % 5 = 0 THEN minutes + 2 ELSE minutes END AS minutes,
                  round(COALESCE(TRY_CAST(points_per_game AS DOUBLE), 0) * 0.6E0, 6) AS predicted_points
           FROM players, (VALUES (9), (10)) v(w)""",
    ),
)
def refresh_archived(spark, sf_dir):
    """Handled files go to an archive; a period that is touched after that is made of archived and new files."""
    rows, land, run, published = _refreshed(spark, sf_dir, archived=True)
    land(rows, 9)
    run()
    land(rows, 10)
    run()
    changed = {"team": F.lit(24) - F.col("team"), "minutes": F.col("minutes") + 2}
    land(rows.where("id % 5 = 0").withColumns(changed), 9)
    run()
    return published()


def _refreshed(spark, sf_dir, archived=False):
    """Entities, and how to land them, to run the refresh and to read what it published."""
    base = new_folder(spark, "refresh")
    archive = f"{base}/handled" if archived else None
    landing, published, checkpoint = f"{base}/landing", f"{base}/published", f"{base}/state"

    def build(documents):
        items = newest_rows(documents, "elements")
        points = F.coalesce(F.col("points_per_game").try_cast("double"), F.lit(0.0)) * 0.6
        return items.select("gameweek", "id", F.col("team").alias("team_id"), "minutes", F.round(points, 6).alias("predicted_points"))

    def land(rows, period):
        writers.write_envelopes(rows, f"{landing}/gameweek={period}", "elements")

    def run():
        refresh(spark, landing, published, checkpoint, build, best_first("predicted_points"), archive=archive)

    def read():
        table = readers.read_published(spark, f"{published}/predictions")
        return table.select("gameweek", "id", F.col("team_id").cast("int").alias("team_id"), "minutes", "predicted_points")

    return stage(_entity_rows(spark, sf_dir), "entities"), land, run, read
