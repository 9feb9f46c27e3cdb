"""Tables, statements, jobs and sessions on small literal rows."""

import datetime as dt
from decimal import Decimal

import pytest

from basalt import results, types
from basalt.errors import AlreadyExists, BasaltError, Conflict, Invalid, NotFound, OutOfRange, Precondition, Unsupported

from .conftest import rows

UTC = dt.timezone.utc


@pytest.fixture
def gauges(engine):
    """Water levels by gauge, and readings that came in: two of known gauges, one of a new one, one without a gauge."""
    engine.query("CREATE TABLE levels (gauge STRING NOT NULL, cm FLOAT64, seen DATE, flags ARRAY<STRING>)")
    engine.query("CREATE TABLE readings (gauge STRING, cm FLOAT64, seen DATE)")
    engine.query("INSERT INTO levels VALUES ('elbe', 211.5, DATE '2019-05-04', ['ok']), ('oder', NULL, NULL, NULL), ('saale', 98.25, DATE '2019-05-01', ['ok', 'ice']), ('spree', 40.0, NULL, NULL)")
    engine.query("INSERT readings VALUES ('elbe', 220.0, DATE '2019-05-06'), ('oder', 305.75, DATE '2019-05-06'), ('weser', 12.5, NULL), (NULL, 1.0, NULL)")
    return engine


def affected(e, sql):
    return e.query(sql).first()[0]


def levels(e):
    return {r.gauge: r.cm for r in e.table("levels").collect()}


BEFORE = {"elbe": 211.5, "oder": None, "saale": 98.25, "spree": 40.0}


def test_merge_changes_what_it_names_and_keeps_the_rest(gauges):
    n = affected(gauges, "MERGE INTO levels USING readings ON levels.gauge = readings.gauge WHEN MATCHED AND readings.cm > 300 THEN UPDATE SET cm = readings.cm, seen = readings.seen WHEN NOT MATCHED AND readings.gauge IS NOT NULL THEN INSERT (gauge, cm) VALUES (CONCAT(readings.gauge, '-new'), readings.cm * 2)")
    assert n == 2
    assert levels(gauges) == BEFORE | {"oder": 305.75, "weser-new": 25.0}
    assert {r.gauge: r.flags for r in gauges.table("levels").collect()}["saale"] == ["ok", "ice"]


def test_merge_takes_the_first_clause_that_holds(gauges):
    n = affected(gauges, "MERGE levels l USING readings r ON l.gauge = r.gauge WHEN MATCHED AND l.cm IS NULL THEN DELETE WHEN MATCHED THEN UPDATE SET cm = -1 WHEN MATCHED THEN DELETE WHEN NOT MATCHED BY SOURCE AND l.cm < 50 THEN DELETE WHEN NOT MATCHED BY SOURCE THEN UPDATE SET cm = l.cm + 1")
    assert n == 4 and levels(gauges) == {"elbe": -1.0, "saale": 99.25}


def test_merge_of_many_for_one_is_an_error(gauges):
    gauges.query("INSERT readings (gauge, cm) VALUES ('elbe', 0)")
    with pytest.raises(Invalid, match="several source rows"):
        gauges.query("MERGE levels l USING readings r ON l.gauge = r.gauge WHEN MATCHED THEN UPDATE SET cm = r.cm")
    assert levels(gauges) == BEFORE
    # Several that change nothing are no error: the row stands once.
    assert affected(gauges, "MERGE levels l USING readings r ON l.gauge = r.gauge WHEN MATCHED AND r.cm > 300 THEN UPDATE SET cm = r.cm") == 1
    assert levels(gauges) == BEFORE | {"oder": 305.75} and gauges.table("levels").count() == 4


def test_merge_inserts_equal_source_rows_each(gauges):
    gauges.query("INSERT readings (gauge, cm) VALUES ('main', 3), ('main', 3)")
    assert affected(gauges, "MERGE levels l USING (SELECT gauge, cm, seen, ARRAY<STRING>[] AS flags FROM readings WHERE gauge IS NOT NULL) r ON l.gauge = r.gauge WHEN NOT MATCHED THEN INSERT ROW") == 3
    assert sorted(levels(gauges)) == ["elbe", "main", "oder", "saale", "spree", "weser"] and gauges.table("levels").count() == 7


def test_merge_on_null_matches_nothing(gauges):
    assert affected(gauges, "MERGE levels l USING readings r ON l.gauge = r.gauge AND NULL WHEN MATCHED THEN DELETE") == 0


def test_update_from(gauges):
    assert affected(gauges, "UPDATE levels l SET cm = COALESCE(l.cm, 0) + r.cm FROM readings r WHERE l.gauge = r.gauge") == 2
    assert levels(gauges) == BEFORE | {"elbe": 431.5, "oder": 305.75}
    gauges.query("INSERT readings (gauge, cm) VALUES ('elbe', 0)")
    with pytest.raises(Invalid, match="several source rows"):
        gauges.query("UPDATE levels l SET cm = r.cm FROM readings r WHERE l.gauge = r.gauge")


def test_delete_keeps_unknown(gauges):
    assert affected(gauges, "DELETE FROM levels WHERE cm < 100") == 2
    assert levels(gauges) == {"elbe": 211.5, "oder": None}


def test_statements_rewrite_only_folders_with_hits(gauges):
    gauges.query("INSERT INTO levels (gauge, cm) VALUES ('rhein', 500.0), ('isar', 30.0)")
    folders = lambda: {d["name"] for d in gauges.catalog.table(gauges.ref("levels")).state["data"]}
    before = folders()
    assert len(before) == 2
    assert affected(gauges, "UPDATE levels SET cm = 501 WHERE gauge = 'rhein'") == 1
    assert len(folders() & before) == 1
    kept = folders()
    assert affected(gauges, "DELETE FROM levels WHERE gauge = 'nil'") == 0 and folders() == kept
    assert affected(gauges, "MERGE levels l USING readings r ON l.gauge = r.gauge WHEN MATCHED AND r.cm > 300 THEN DELETE") == 1
    assert len(folders() & kept) == 1
    assert levels(gauges) == {"elbe": 211.5, "saale": 98.25, "spree": 40.0, "rhein": 501.0, "isar": 30.0}


@pytest.mark.parametrize("sql", ["DELETE FROM levels", "UPDATE levels SET cm = 1", "SELECT 1; SELECT 2", "INSERT INTO levels (gauge, gauge) VALUES ('a', 'b')", "INSERT INTO levels (gauge, nothing) VALUES ('a', 2)", "UPDATE levels SET nothing = 1 WHERE TRUE", "SELECT (1", "EXPLODE"])
def test_bad_statements(gauges, sql):
    with pytest.raises(Invalid):
        gauges.query(sql)


def test_required_is_enforced_and_nothing_shows(gauges):
    with pytest.raises(Invalid, match="REQUIRED"):
        gauges.query("INSERT INTO levels (cm) VALUES (7)")
    assert levels(gauges) == BEFORE


def test_static_overwrite_and_template_drift(gauges):
    n = affected(gauges, "MERGE levels d USING (SELECT gauge, cm, seen, ['fresh'] AS flags FROM readings WHERE seen IS NOT NULL) s ON FALSE WHEN NOT MATCHED THEN INSERT ROW WHEN NOT MATCHED BY SOURCE THEN DELETE")
    assert n == 6 and levels(gauges) == {"elbe": 220.0, "oder": 305.75}
    with pytest.raises(Precondition):
        gauges.overwrite("levels", gauges.spark.createDataFrame([("a",)], "gauge string"))
    assert gauges.table("levels").count() == 2


def test_dispositions(gauges):
    gauges.query("SELECT cm FROM levels", destination="d")
    with pytest.raises(AlreadyExists):
        gauges.query("SELECT cm FROM levels", destination="d")
    assert gauges.query("SELECT cm FROM readings", destination="d", write="WRITE_APPEND").count() == 8
    with pytest.raises(Precondition):
        gauges.query("SELECT gauge FROM readings", destination="d", write="WRITE_APPEND")
    assert gauges.query("SELECT gauge FROM readings", destination="d", write="WRITE_TRUNCATE").columns == ["gauge"]
    with pytest.raises(NotFound):
        gauges.query("SELECT 1 AS x", destination="none", create="CREATE_NEVER")


def test_anonymous_results_expire(spark, tmp_path):
    from basalt.engine import Engine

    now = [1000.0]
    e = Engine(spark, f"file://{tmp_path}/w", "proj-a", "main", clock=lambda: now[0])
    e.catalog.create_project("proj-a")
    e.catalog.create_dataset("proj-a", "main")
    job = e.submit("SELECT 1 AS x")
    assert e.catalog.datasets("proj-a") == ["main"]
    assert e.page(job.id)["rows"] == [{"f": [{"v": "1"}]}]
    now[0] += 25 * 3600
    with pytest.raises(NotFound):
        e.page(job.id)


def test_jobs(gauges):
    gauges.submit("SELECT 1 AS x", job_id="j")
    with pytest.raises(AlreadyExists):
        gauges.submit("SELECT 1 AS x", job_id="j")
    with pytest.raises(Conflict):
        gauges.submit("SELECT 2 AS x", job_id="j")
    bad = gauges.submit("SELECT * FROM missing", job_id="k")
    assert bad.state == "DONE" and isinstance(bad.error, NotFound)
    assert gauges.submit("SELECT cm FROM levels", dry_run=True).destination is None
    waiting = gauges.submit("SELECT COUNT(cm) AS n FROM levels", wait=False)
    assert gauges.catalog.read(waiting.result().destination).first().n == 3


def test_pages(gauges):
    job = gauges.submit("SELECT gauge FROM levels UNION ALL SELECT gauge FROM readings")
    seen, token, sizes = [], None, []
    while True:
        page = gauges.page(job.id, page_token=token, limit=3)
        seen += [r["f"][0]["v"] for r in page["rows"]]
        sizes.append(len(page["rows"]))
        if (token := page.get("page_token")) is None:
            break
    assert page["total"] == 8 and sizes == [3, 3, 2]
    assert sorted(seen, key=str) == sorted(["elbe", "oder", "saale", "spree", "elbe", "oder", "weser", None], key=str)
    other = gauges.submit("SELECT gauge FROM levels")
    with pytest.raises(Invalid):
        gauges.page(other.id, page_token=gauges.page(job.id, limit=3)["page_token"])
    assert gauges.page(job.id, limit=0)["rows"] == []


def test_table_pages_follow_the_stored_order(engine):
    engine.query("CREATE TABLE long (k INT64)")
    for at in (0, 40):
        engine.insert("long", engine.spark.range(at, at + 40).withColumnRenamed("id", "k").repartition(3))
    whole = [r["f"][0]["v"] for r in engine.table_page("long", 0, 100)]
    assert sorted(map(int, whole)) == list(range(80)) and set(map(int, whole[:40])) == set(range(40))
    assert [r["f"][0]["v"] for at in range(0, 80, 7) for r in engine.table_page("long", at, 7)] == whole
    assert engine.table_page("long", 80, 5) == [] and len(engine.table_page("long", 78, 5)) == 2


def test_ddl(gauges):
    gauges.query("ALTER TABLE readings ADD COLUMN notes ARRAY<STRING>")
    assert rows(gauges.table("readings").select("cm", "notes").where("cm > 200")) == [(220.0, []), (305.75, [])]
    gauges.query("ALTER TABLE readings RENAME COLUMN seen TO day")
    gauges.query("ALTER TABLE readings ALTER COLUMN cm SET DATA TYPE NUMERIC(8, 1)")
    gauges.query("ALTER TABLE readings DROP COLUMN notes")
    got = gauges.table("readings")
    assert got.columns == ["gauge", "cm", "day"] and {r.cm for r in got.collect()} == {Decimal("220.0"), Decimal("305.8"), Decimal("12.5"), Decimal("1.0")}
    for sql in ("CREATE TABLE levels (x INT64)", "ALTER TABLE levels ADD COLUMN cm STRING"):
        with pytest.raises(AlreadyExists):
            gauges.query(sql)
    gauges.query("TRUNCATE TABLE levels")
    assert levels(gauges) == {}
    gauges.query("DROP TABLE levels")
    with pytest.raises(NotFound):
        gauges.table("levels")
    for sql in ("CREATE TABLE IF NOT EXISTS t (x INT64)", "CREATE VIEW v AS SELECT 1", "DECLARE x INT64", "ALTER TABLE readings ADD COLUMN a INT64, ADD COLUMN b INT64"):
        with pytest.raises((Unsupported, Invalid)):
            gauges.query(sql)


def test_nested_types(engine):
    engine.query("CREATE TABLE t (id INT64 NOT NULL, who STRUCT<name STRING, ranks ARRAY<INT64>>, parts ARRAY<STRUCT<k STRING, v NUMERIC(5,2)>>)")
    kinds = [(f.name, f.type, f.mode) for f in engine.catalog.table(engine.ref("t")).fields]
    assert kinds == [("id", "INT64", "REQUIRED"), ("who", "RECORD", "NULLABLE"), ("parts", "RECORD", "REPEATED")]
    with pytest.raises((Invalid, Unsupported)):
        engine.query("CREATE TABLE u (x ARRAY<ARRAY<INT64>>)")


def test_every_type_round_trips(engine):
    fields = [{"name": n, "type": t} for n, t in (("a", "BOOL"), ("b", "INT64"), ("c", "FLOAT64"), ("d", "NUMERIC"), ("e", "BIGNUMERIC"), ("f", "STRING"), ("g", "BYTES"), ("h", "DATE"), ("i", "DATETIME"), ("j", "TIME"), ("k", "TIMESTAMP"), ("l", "JSON"))]
    engine.create_table("t", fields)
    engine.insert("t", engine.spark.sql("SELECT true a, 1L b, 1.5D c, CAST('1.25' AS DECIMAL(38,9)) d, CAST('1.000000000000000001' AS DECIMAL(38,18)) e, 's' f, X'00ff' g, DATE'2024-02-29' h, TIMESTAMP_NTZ'2024-02-29 01:02:03.5' i, TIME'01:02:03.5' j, TIMESTAMP'1969-12-31 23:59:59.5' k, '{\"x\":1.10}' l"))
    assert [c["v"] for c in engine.table_page("t")[0]["f"]] == ["true", "1", 1.5, "1.250000000", "1.000000000000000001", "s", "AP8=", "2024-02-29", "2024-02-29T01:02:03.5", "01:02:03.5", "-0.500000", '{"x":1.10}']


def test_evolution():
    old = types.schema({"name": "a", "type": "INT64"}, {"name": "r", "type": "RECORD", "fields": [{"name": "x", "type": "STRING"}]})
    types.evolved(old, types.schema({"name": "a", "type": "INT64"}, {"name": "r", "type": "RECORD", "fields": [{"name": "x", "type": "STRING"}, {"name": "y", "type": "INT64"}]}, {"name": "b", "type": "STRING"}))
    for bad in ([{"name": "a", "type": "STRING"}], [{"name": "a", "type": "INT64"}, {"name": "r", "type": "RECORD", "fields": [{"name": "x", "type": "STRING"}]}, {"name": "n", "type": "INT64", "mode": "REQUIRED"}]):
        with pytest.raises(Precondition):
            types.evolved(old, types.schema(*bad))


@pytest.mark.parametrize("spec", [{"name": "a", "type": "GEOGRAPHY"}, {"name": "a", "type": "MAP"}, {"name": "1a", "type": "INT64"}, {"name": "a", "type": "NUMERIC", "precision": 40}, {"name": "a", "type": "NUMERIC", "precision": 38, "scale": 2}, {"name": "a", "type": "RECORD"}, {"name": "a", "type": "STRING", "precision": 3}])
def test_bad_fields(spec):
    with pytest.raises((Invalid, Unsupported)):
        types.schema(spec)


@pytest.mark.parametrize(("mode", "want"), [("ROUND_HALF_AWAY_FROM_ZERO", ["-2.5", "-0.1", "0.1", "2.5", "2.6"]), ("ROUND_HALF_EVEN", ["-2.4", "0.0", "0.0", "2.4", "2.6"])])
def test_rounding(engine, mode, want):
    engine.create_table("t", [{"name": "x", "type": "NUMERIC", "precision": 5, "scale": 1, "rounding": mode}])
    engine.insert("t", engine.spark.sql("SELECT CAST(x AS DECIMAL(38,9)) AS x FROM VALUES ('-2.45'), ('-0.05'), ('0.05'), ('2.45'), ('2.55') AS v(x)"))
    assert sorted(map(Decimal, (str(r.x) for r in engine.table("t").collect()))) == sorted(map(Decimal, want))
    with pytest.raises(Exception, match="OUT_OF_RANGE|out of range"):
        engine.insert("t", engine.spark.sql("SELECT CAST('9999.95' AS DECIMAL(38,9)) AS x"))


def test_two_writers(engine):
    engine.create_table("t", [{"name": "x", "type": "INT64"}])
    stale = engine.catalog.table(engine.ref("t"))
    engine.insert("t", engine.spark.range(3).toDF("x"))
    with pytest.raises(Conflict):
        engine.catalog.publish(stale, engine.spark.range(5).toDF("x"))
    assert engine.table("t").count() == 3


def test_write_streams(engine):
    engine.create_table("t", [{"name": "x", "type": "INT64"}])
    make, ref = lambda a, b: engine.spark.range(a, b).toDF("x"), engine.ref("t")
    w, s = engine.writer, engine.write_stream("t")
    assert w.append(s, make(0, 5), 0) == 0 and w.append(s, make(0, 5), 0) == 0
    with pytest.raises(AlreadyExists):
        w.append(s, make(1, 6), 0)
    with pytest.raises(OutOfRange):
        w.append(s, make(9, 10), 7)
    assert w.append(s, make(5, 8)) == 5
    with pytest.raises(Precondition):
        w.commit(ref, [s])
    assert engine.table("t").count() == 0
    assert w.finalize(s) == 8
    with pytest.raises(Precondition):
        w.append(s, make(8, 9), 8)
    other = engine.write_stream("t")
    with pytest.raises(Precondition):
        w.commit(ref, [s, other])
    assert engine.table("t").count() == 0
    assert w.commit(ref, [s]) == 8 == w.commit(ref, [s])
    assert rows(engine.table("t")) == [(i,) for i in range(8)]
    with pytest.raises(Unsupported):
        w.create(ref, "BUFFERED")
    with pytest.raises(Invalid):
        w.append_default(ref, make(0, 1), 0)


def test_read_sessions(engine):
    engine.query("CREATE TABLE t (id INT64 NOT NULL, name STRING, score FLOAT64, who STRUCT<rank INT64>)")
    engine.query("INSERT INTO t VALUES (1, 'one', 1.5, NAMED_STRUCT('rank', 7)), (2, 'skip', 2.5, NULL), (3, 'three', 3.5, NAMED_STRUCT('rank', 1)), (4, 'four', 4.5, NAMED_STRUCT('rank', 9))")
    s = engine.read_session("t", ["score", "id"], "id >= 2 AND name != 'skip'")
    assert [f.name for f in s.fields] == ["id", "score"] and s.rows == 2
    engine.query("TRUNCATE TABLE t")  # the session keeps its version
    assert sorted(tuple(r) for x in s.streams for r in engine.reader.frame(x.name).collect()) == [(3, 3.5), (4, 4.5)]
    with pytest.raises(NotFound):
        engine.reader.frame("none/0")


@pytest.mark.parametrize(("text", "want"), [("who.rank >= 7", [1, 4]), ("NOT (id = 1 OR id = 2)", [3, 4]), ("who.rank IS NULL", [2]), ("score < 2 OR name == 'four' AND TRUE_ = FALSE", [1]), ("name = 'o''ne'", []), ("`name` <> \"one\" AND score > -1.5", [2, 3, 4])])
def test_restrictions(engine, text, want):
    engine.query("CREATE TABLE t (id INT64, name STRING, score FLOAT64, who STRUCT<rank INT64>, TRUE_ BOOL)")
    engine.query("INSERT INTO t VALUES (1, 'one', 1.5, NAMED_STRUCT('rank', 7), TRUE), (2, 'skip', 2.5, NULL, TRUE), (3, 'three', 3.5, NAMED_STRUCT('rank', 1), TRUE), (4, 'four', 4.5, NAMED_STRUCT('rank', 9), TRUE)")
    s = engine.read_session("t", ["id"], text, 2)
    assert sorted(r.id for x in s.streams for r in engine.reader.frame(x.name).collect()) == want


@pytest.mark.parametrize("text", ["id LIKE 'a'", "id IN (1)", "id = NULL", "nothing = 1", "id = 'x'", "id =", "(id = 1", "id = 1 id", "tags = 'a'", "id = 1 AND", "abs(id) = 1", "name = 'a\\'b'"])
def test_bad_restrictions(text):
    from basalt.sources.restriction import parse

    with pytest.raises(Invalid):
        parse(text, types.schema({"name": "id", "type": "INT64"}, {"name": "name", "type": "STRING"}, {"name": "tags", "type": "STRING", "mode": "REPEATED"}))


def test_dynamic_overwrite(engine):
    engine.create_table("visits", [{"name": "who", "type": "STRING"}, {"name": "at", "type": "DATETIME"}], time_partitioning={"type": "MONTH", "field": "at"})
    when = lambda text: dt.datetime.fromisoformat(text) if text else None
    make = lambda **r: engine.spark.createDataFrame([(k, when(v)) for k, v in r.items()], "who string, at timestamp_ntz")
    engine.insert("visits", make(ada="2011-11-30T23:59:59", bo="2011-12-01T00:00:00", cy="2011-12-31T12:00:00", di=None))
    engine.insert("visits", make(ed="2012-02-29T08:00:00"))
    # December goes (bo, cy) and takes two new rows; a row without a month is added beside the old one.
    assert engine.overwrite_partitions("visits", make(flo="2011-12-24T18:00:00", gus="2011-12-05T07:30:00", hal=None)) == 5
    assert sorted(r.who for r in engine.table("visits").collect()) == ["ada", "di", "ed", "flo", "gus", "hal"]
    assert engine.overwrite_partitions("visits", make(ivo="2020-01-01T00:00:00")) == 1  # a new month: nothing goes


SCRIPT = "DECLARE p DEFAULT (SELECT ARRAY_AGG(DISTINCT(date_trunc(`day`, DAY)) IGNORE NULLS) FROM `main.fresh`); \nMERGE `main.sums` AS `x`\nUSING `main.fresh` AS `y`\nON FALSE\nWHEN NOT MATCHED BY SOURCE AND (TRUE) AND date_trunc(`x`.`day`, DAY) IN UNNEST(p) THEN DELETE\nWHEN NOT MATCHED BY TARGET THEN\nINSERT(`total`,`day`) VALUES(`y`.`total`,`y`.`day`)"


def test_partition_overwrite_script(engine):
    for t in ("sums", "fresh"):
        engine.query(f"CREATE TABLE {t} (total FLOAT64, day DATE)")
    engine.query("INSERT INTO sums VALUES (0.5, DATE '2003-07-09'), (0.25, DATE '2003-07-09'), (7.5, DATE '2003-08-01'), (9.0, NULL)")
    engine.query("INSERT INTO fresh VALUES (1.5, DATE '2003-07-09'), (11.0, NULL)")
    assert engine.query(SCRIPT).first()[0] == 4
    assert sorted(r.total for r in engine.table("sums").collect()) == [1.5, 7.5, 9.0, 11.0]
    for near in (SCRIPT.replace("(TRUE)", "(FALSE)"), SCRIPT.replace("`y`.`total`", "`y`.`day`"), SCRIPT.replace("date_trunc(`x`", "lower(`x`"), "DECLARE a DEFAULT 1; SELECT a", SCRIPT.replace("date_trunc", "RANGE_BUCKET")):
        with pytest.raises((Invalid, Unsupported)):
            engine.query(near)
    assert engine.table("sums").count() == 4


def test_load(engine, tmp_path):
    engine.spark.createDataFrame([(2, "two"), (3, "three")], "id long, name string").write.parquet(f"{tmp_path}/in")
    engine.query("CREATE TABLE t (id INT64 NOT NULL, name STRING)")
    engine.query("INSERT INTO t VALUES (1, 'one')")
    uri = [f"file://{tmp_path}/in/*.parquet"]
    engine.load("t", uri)
    assert rows(engine.table("t")) == [(1, "one"), (2, "two"), (3, "three")]
    with pytest.raises(Precondition):
        engine.load("t", uri, write="WRITE_EMPTY")
    engine.load("t", uri, write="WRITE_TRUNCATE")
    assert engine.table("t").count() == 2
    with pytest.raises(NotFound):
        engine.load("t", [f"file://{tmp_path}/none/*.parquet"])
    with pytest.raises(Invalid):
        engine.load("t", [f"file://{tmp_path}/**"])
    with pytest.raises(Unsupported):
        engine.load("t", uri, "AVRO")
    engine.query("CREATE TABLE u (id STRING)")
    with pytest.raises(Precondition):
        engine.load("u", uri)


def test_catalog(engine):
    c = engine.catalog
    with pytest.raises(Invalid):
        c.create_project("Bad Name")
    with pytest.raises(AlreadyExists):
        c.create_dataset("proj-a", "main")
    c.create_dataset("proj-a", "other", location="EU", default_expiration_ms=0 or None, labels={"a": "b"})
    assert c.update_dataset("proj-a", "other", labels={})["labels"] == {}
    engine.create_table("other.t", [{"name": "x", "type": "INT64"}])
    engine.create_table("t", [{"name": "x", "type": "INT64"}])
    with pytest.raises(Invalid, match="locations"):
        engine.query("SELECT a.x FROM t a JOIN other.t b ON a.x = b.x")
    with pytest.raises(Precondition):
        c.delete_dataset("proj-a", "other")
    c.delete_dataset("proj-a", "other", contents=True)
    assert c.datasets("proj-a") == ["main"]
    assert c.tables("proj-a", "main") == ["t"]
    engine.insert("t", engine.spark.range(3).toDF("x"))
    engine.query("TRUNCATE TABLE t")
    assert c.vacuum(engine.ref("t")) == 1


def test_names():
    assert results.portable(["a", "count(1)", "a", "f1_", "A"]) == ["a", "f1_1", "f2_", "f1_", "f4_"]


def test_cells():
    f = lambda kind, **k: types.Field("x", kind, **k)
    assert results.cell(float("inf"), f("FLOAT64")) == "Infinity"
    assert results.cell(dt.datetime(1970, 1, 1, 0, 0, 1, 5, tzinfo=UTC), f("TIMESTAMP"), micros=True) == "1000005"
    assert results.cell(None, f("INT64", mode="REPEATED")) == []
    assert results.cell([1, 2], f("INT64", mode="REPEATED")) == [{"v": "1"}, {"v": "2"}]


def test_packed_datetime(spark):
    packed = ((((((2024 << 4) | 2) << 5 | 29) << 5 | 13) << 6 | 5) << 6 | 7) << 20 | 250000
    got = spark.createDataFrame([(packed,)], "p long").select(results.packed_datetime("p")).first()[0]
    assert got == dt.datetime(2024, 2, 29, 13, 5, 7, 250000)


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT CAST(2.5 AS INT64) AS a, CAST(-2.5 AS INT64) AS b, SAFE_CAST('x' AS INT64) AS c", (3, -3, None)),
        ("SELECT 0x1F AS a, 'it''s' AS b, \"q\" AS c, '\\n' AS d", (31, "it's", "q", "\n")),
        ("SELECT NULL IN UNNEST([1]) AS a, 2 NOT IN UNNEST([1, NULL]) AS b", (False, True)),
        ("SELECT EXTRACT(YEAR FROM DATE '2024-05-06') AS a, DATE_TRUNC(DATE '2024-05-06', WEEK) AS b", (2024, dt.date(2024, 5, 6))),
        ("SELECT ARRAY_LENGTH([1, 2]) AS a, CEIL(1.2) AS b, DIV(7, 2) AS c", (2, 2.0, 3)),
        ("SELECT (SELECT MAX(x) FROM UNNEST([3, 9]) AS x) AS a -- comment", (9,)),
        ("WITH RECURSIVE t AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM t WHERE n < 4) SELECT SUM(n) AS s FROM t", (10,)),
        ("SELECT 1 AS x UNION DISTINCT SELECT 1", (1,)),
    ],
)
def test_spelling(engine, sql, want):
    assert rows(engine.query(sql)) == [want]


def test_left_join_unnest_keeps_rows_without_elements(engine):
    engine.query("CREATE TABLE bags (bag INT64, things ARRAY<STRING>)")
    engine.query("INSERT INTO bags VALUES (1, ['rope', 'lamp']), (2, ARRAY<STRING>[]), (3, NULL)")
    got = engine.frame("SELECT b.bag, x, place FROM bags AS b LEFT JOIN UNNEST(b.things) AS x WITH OFFSET AS place")
    assert rows(got) == [(1, "lamp", 1), (1, "rope", 0), (2, None, None), (3, None, None)]
    assert rows(engine.frame("SELECT bag, x, n FROM bags, UNNEST(things) AS x, UNNEST([7]) AS n WHERE bag = 1")) == [(1, "lamp", 7), (1, "rope", 7)]


def test_text_that_looks_like_syntax_stays(engine):
    assert rows(engine.frame("SELECT 'a UNION DISTINCT b' AS v, 'IGNORE NULLS' AS w")) == [("a UNION DISTINCT b", "IGNORE NULLS")]


def test_nulls_in_arrays_and_json(engine):
    engine.query("CREATE TABLE marks (k INT64, v INT64)")
    engine.query("INSERT INTO marks VALUES (1, 4), (2, NULL), (3, 9)")
    got = engine.frame("SELECT ARRAY_AGG(v RESPECT NULLS ORDER BY k) AS a, ARRAY_AGG(v IGNORE NULLS ORDER BY k DESC LIMIT 1) AS b, ARRAY_AGG(v IGNORE NULLS ORDER BY k) AS c FROM marks").collect()[0]
    assert (got.a, got.b, got.c) == ([4, None, 9], [9], [4, 9])
    assert engine.frame("SELECT ARRAY_AGG(v) AS a FROM marks WHERE k > 3").collect()[0].a is None
    assert [r.j for r in engine.frame("SELECT TO_JSON(STRUCT(k, v)) AS j FROM marks ORDER BY k").collect()] == ['{"k":1,"v":4}', '{"k":2,"v":null}', '{"k":3,"v":9}']
    one = engine.frame("SELECT TO_JSON(5) AS a, TO_JSON('x') AS b, TO_JSON([1, 2]) AS c, TO_JSON(NULL) AS d").collect()[0]
    assert tuple(one) == ("5", '"x"', "[1,2]", "null")


def test_typed_literals_and_star_replace(engine):
    got = engine.frame("SELECT ARRAY<STRUCT<k INT64, tags ARRAY<STRING>>>[STRUCT(1, ['u'])] AS a, STRUCT<INT64, STRING>(2, 'q') AS b, ARRAY<INT64>[] AS c").collect()[0]
    assert (got.a[0].k, got.a[0].tags, tuple(got.b), got.c) == (1, ["u"], (2, "q"), [])
    engine.query("CREATE TABLE pens (id INT64, ink STRING, ml NUMERIC)")
    engine.query("INSERT INTO pens VALUES (1, 'blue', 2), (2, 'red', 3)")
    got = engine.frame("SELECT * EXCEPT (ml) REPLACE (UPPER(ink) AS ink) FROM pens WHERE id = 1 ORDER BY id")
    assert got.columns == ["id", "ink"] and rows(got) == [(1, "BLUE")]
    assert rows(engine.frame("SELECT REPLACE(ink, 'b', 'g') AS x, id * 2 AS y FROM pens")) == [("glue", 2), ("red", 4)]


def test_an_update_finds_its_own_tables(engine):
    engine.query("CREATE TABLE top (k INT64, v INT64)")
    engine.query("CREATE TABLE low (k INT64, v INT64)")
    engine.query("INSERT INTO top VALUES (1, 10), (2, 20)")
    engine.query("INSERT INTO low VALUES (1, 0), (2, 0), (3, 0)")
    assert engine.submit("UPDATE low SET v = (SELECT MAX(v) FROM top) FROM (SELECT k AS other FROM top) s WHERE low.k = s.other").result().affected == 2
    assert rows(engine.frame("SELECT * FROM low")) == [(1, 20), (2, 20), (3, 0)]
    jobs = [engine.submit("SELECT COUNT(*) AS n FROM top JOIN low USING (k)", wait=False) for _ in range(4)]
    assert [engine.catalog.read(j.result(60).destination).collect()[0].n for j in jobs] == [2] * 4
    assert not [t.name for t in engine.spark.catalog.listTables() if t.name.startswith("basalt_")]


def test_update_of_a_field_in_a_record(engine):
    engine.query("CREATE TABLE homes (id INT64, at STRUCT<city STRING, geo STRUCT<lat FLOAT64, lon FLOAT64>>)")
    engine.query("INSERT INTO homes VALUES (1, STRUCT('Oslo', STRUCT(59.9, 10.7))), (2, NULL)")
    assert engine.submit("UPDATE homes SET at.geo.lat = 60.0, homes.at.city = UPPER('bergen') WHERE TRUE").result().affected == 2
    got = {r.id: r["at"] for r in engine.frame("SELECT * FROM homes").collect()}
    assert (got[1].city, got[1].geo.lat, got[1].geo.lon, got[2].city, got[2].geo.lon) == ("BERGEN", 60.0, 10.7, "BERGEN", None)
    for bad in ("at.street = 'x'", "id.part = 1", "at = NULL, at.city = 'x'"):
        with pytest.raises(BasaltError):
            engine.query(f"UPDATE homes SET {bad} WHERE TRUE")
