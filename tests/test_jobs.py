"""Jobs on small frames: properties, edges and batch against stream."""

import datetime as dt

from pyspark.sql import functions as F

import __spark_entry__
from tallyspark.operators import dashboard as D
from tallyspark.operators import extraction as E
from tallyspark.operators import ideas as I
from tallyspark.operators import mail as M
from tallyspark.operators import reconcile as R
from tallyspark.plans.adapters import with_position
from tallyspark.sources import tables as T
from tallyspark.sources.scratch import scratch_path
from tallyspark.streaming import jobs as J

SF = "/root/testdata/sf0.001"
IDEAS = "id string, category string, roi double, created_date string, status string, assigned_engineer string, parent_id string, idea_name string"


def ideas(spark, rows):
    return spark.createDataFrame(rows, IDEAS)


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queue_is_a_chain(spark):
    df = ideas(spark, [(str(i), ["Internal", "Customer Requirement", "?"][i % 3], [1.0, None, 0.0][i % 3], "2024", "WIP", "e" if i % 4 else "", "", "") for i in range(20)])
    rows = sorted(I.engineer_queue(df, "2024-03-09").collect(), key=lambda r: r.priority_rank)
    assert [r.priority_rank for r in rows] == list(range(1, 16)) and rows[0].sprint_start == dt.date(2024, 3, 11)
    assert all(a.sprint_end == b.sprint_start for a, b in zip(rows, rows[1:]))
    assert I.engineer_queue(df.limit(0), "2024-03-09").count() == 0


def test_rank_all_equals_a_window(spark):
    df = ideas(spark, [(str(i), ["Internal", "Customer Requirement"][i % 2], float(i % 5), str(i % 7), "WIP", "", "", "") for i in range(300)])
    ranks = {r.id: r.priority_rank for r in I.rank_all(df, 5).collect()}
    order = sorted(df.collect(), key=lambda r: (r.category != "Customer Requirement", -r.roi, r.created_date, r.id))
    assert [ranks[r.id] for r in order] == list(range(1, 301))


def test_delivery_counts_without_pairing_a_group(spark):
    rows = [(str(n), ("Customer Requirement", "Internal", "")[n % 3], float(n * 7 % 5), f"2024-01-{1 + n % 9:02d}", ("Assigned", "WIP", "Rejected")[n * 5 % 7 % 3], f"e{n % 2}" if n % 11 else "", "", "x") for n in range(120)]
    df = ideas(spark, rows)
    asked = df.filter("status = 'Assigned'").withColumn("roi", F.when(F.col("id") % 4 == 0, F.lit(9.0)).otherwise(F.col("roi")))
    got = I.compute_delivery(df, asked, "2024-03-07", 5)
    key = lambda r: ({"Customer Requirement": 0, "Internal": 1}.get(r[1], 2), -(r[2] or 0.0), r[3], r[0])
    want = {r[0]: 1 + sum(o[0] != r[0] and o[5] == r[5] and key(o) < key(r) for o in rows if o[4] in ("Assigned", "WIP")) for r in map(tuple, asked.collect())}
    assert len(want) > 30 and {r.id: r.priority_rank for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # Every join is on the id or on partition and engineer, none on the engineer alone.
    joins = [x for x in plan.split("\n") if "Join" in x]
    assert joins and all("id#" in x or "_p#" in x for x in joins)


def test_best_candidate_prefers_the_first_accepted(spark):
    rules = (("a", "ra", "exact", False), ("b", "rb", "exact", False))
    reports = spark.createDataFrame([(1, "4600000001", "x", "y"), (2, "", "x", "y"), (3, "9", "x", "y"), (4, "4600000004", "x", "q")], "report_id long, po string, ra string, rb string")
    dump = spark.createDataFrame([(1, "4600000001", "x", "n"), (2, "4600000001", "x", ""), (3, "4600000001", "x", "y"), (4, "", "x", "y"), (5, "4600000004", "z", "z"), (6, "4600000004", "x", "z"), (7, "4600000004", "x", "w")], "ord long, rr_po_number string, a string, b string")
    got = {r.report_id: (r.status, r.ord) for r in R.match_reports(reports, R.load_dump(dump), rules).collect()}
    assert got == {1: ("matched", 2), 2: ("no_po_rows", None), 3: ("no_po_rows", None), 4: ("mismatch", 6)}


def test_triage_and_windows(spark):
    assert M.domains_of(("Vendor A", "?")) == ("vendor-a.example",)
    rows = [("gbr.vendor-a.example", True), ("notvendor-a.example", False), ("", False)]
    df = spark.createDataFrame(rows, "d string, want boolean").withColumn("got", M.from_domains(F.col("d"), ("vendor-a.example",)))
    assert all(r.want == r.got for r in df.collect())
    times = spark.createDataFrame([(dt.datetime(2024, 1, 5),), (dt.datetime(2024, 1, 20, 23, 59),), (dt.datetime(2024, 1, 21),), (None,)], "t timestamp")
    count = lambda a, b: times.filter(M.date_window(F.col("t"), a, b)).count()
    assert (count("2024-01-20", "2024-01-05"), count(None, None), count("junk", None), count("2024-01-21", None)) == (2, 4, 4, 1)
    assert [spark.range(1).select(M.read_state(F.lit(True), a, b)).first()[0] for a, b in ((True, True), (False, True), (True, False), (False, False))] == [True, True, False, False]


def cells(spark, grid):
    return spark.createDataFrame([("d", 0, r, c, t) for r, row in enumerate(grid) for c, t in enumerate(row)], "doc_id string, sheet int, r int, c int, text string")


def test_a_blank_cell_does_not_take_its_neighbour(spark):
    t = (E.Template("V", "R", (E.Field("tsn", ("TSN",)), E.Field("tsi", ("TSI",)), E.Field("tso", ("TSO",)))),)
    docs = spark.createDataFrame([("d", 0)], "doc_id string, template int")
    got = {r.field: r.value for r in E.grid_label_values(cells(spark, [["TSN: 37452.29", "TSI:", "TSO: 0:00"]]), docs, t).collect()}
    assert got == {"tsn": "37452.29", "tso": "0:00"}


def test_upright_grid(spark):
    stack = ["Serial #", "CSN", "TSN", "CSO", "CSR", "TSO", "TSR", "TSCMP", "BX560625", "1273", "10248.88", "UNKNOWN", "1", "7"]
    got = {r.field: r.value for r in E.grid_positional_vertical(cells(spark, [[x] for x in stack])).collect()}
    assert got == {"csn": "1273", "tsn": "10248.88", "tso": "7"}


def test_template_order_and_aliases(spark):
    ts = (E.Template("Big Maker", "REPORT", ()), E.Template("Maker", "REPORT", (), report_aliases=("NOTE",)))
    df = spark.createDataFrame([("big  maker report",), ("maker note",), ("maker",), (None,)], "t string").select(E.identify_template(F.col("t"), ts).alias("k"))
    assert [r.k for r in df.collect()] == [0, 1, None, None]


def test_csv_with_mark_and_aliases(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('﻿OTP,PROJECT,SPLPL\n 1 ,"a\nb",x\n,none,y\n', encoding="utf-8")
    rows = [tuple(r) for r in T.master_csv_import(spark, str(path)).collect()]
    assert rows == [("1", "a\nb", "", "", "x")]


def test_sessions_stream_equals_batch(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=s), u, "view", 0.0, "") for i, (u, s) in enumerate([(1, 0), (1, 599), (1, 1199), (2, 5), (9, 10**6)])]
    events = spark.createDataFrame(rows, J.EVENTS)
    key = lambda df: sorted((r.user_id, r.start, r.events) for r in df.collect())
    assert key(J.sessions_exact(events)) == key(J.user_sessions(events))
    assert [x[2] for x in key(J.user_sessions(events))][:2] == [2, 1]  # a gap of 600 seconds ends a session
    folder = scratch_path(spark, "test-events")
    events.write.parquet(folder)
    done = J.run_to_table(J.user_sessions(J.event_stream(spark, folder)), "test_sessions")
    assert key(done) == [x for x in key(J.user_sessions(events)) if x[0] != 9]


def test_a_label_inside_a_word_is_passed_over(spark):
    t = E.Template("V", "R", (E.Field("tsn", ("TSN",)), E.Field("csn", ("CSN",)), E.Field("note", ("Note",), multiline=True)))
    rows = [(1, "CTSN: 5\nTSN: 6"), (2, "TSN #. - 7 CSN 8"), (3, "CTSN 4"), (4, None), (5, "Note: two\nlines TSN 3")]
    got = {r.k: (r.tsn, r.note) for r in spark.createDataFrame(rows, "k int, text string").select("k", *[E.text_label_value(F.col("text"), f, t).alias(f.column) for f in t.fields]).collect()}
    assert got == {1: ("6", ""), 2: ("7", ""), 3: ("", ""), 4: ("", ""), 5: ("3", "two lines")}


def test_dashboard_keeps_empty_rows_and_bands(spark):
    rows = [(str(i), "Internal", 1.0, "2024", "WIP", f"e{i // 6}", "", "x") for i in range(18)] + [("t", "Internal", 1.0, "2024", "WIP", "e1", "", "x"), ("u", "Internal", 1.0, "2024", "WIP", "e1", "", "x")]
    df = ideas(spark, rows[:6] + rows[6:9] + rows[12:]).withColumn("automation_category", F.lit("AI-Process Improvement")).withColumn("feasibility_data", F.lit(None).cast("string"))
    counts = {r.status: r.n for r in D.status_counts(df).collect()}
    assert len(counts) == 7 and counts["WIP"] == df.count() and sum(counts.values()) == df.count()
    panel = {r.automation_category: (r.total, r.success) for r in D.automation_category_panel(df).collect()}
    assert len(panel) == 7 and panel["AI-Personal Productivity"] == (0, 0.0)
    users = spark.createDataFrame([(e, "automation engineer") for e in ("e0", "e1", "e2", "idle")], "email string, role string")
    more = df.unionByName(ideas(spark, [(f"m{i}", "Internal", 1.0, "2024", "UAT", "e2", "", "x") for i in range(9)]), allowMissingColumns=True)
    assert {r.email: (r.tasks, r.load, r.band) for r in D.engineer_load(users, more).collect()} == {"e0": (6, 60.0, "amber"), "e1": (5, 50.0, "amber"), "e2": (15, 100.0, "red"), "idle": (0, 0.0, "green")}


def test_sprint_meetings_and_recipients(spark):
    rows = [("1", "a@b.example", "no address", None, "2024-03-01", "2024-03-04 10:00", ""), ("2", "", None, "pl@b.example", "", "bad", "2024-03-09")]
    df = spark.createDataFrame(rows, "id string, submitter_email string, assigned_engineer string, pl_name string, vsm_meeting_date string, sprint_meeting_date string, delivery_date string")
    got = sorted((r.id, r.kind, r.date, r.time, r.recipients) for r in I.meeting_schedule(df).collect())
    assert got == [("1", "sprint", "2024-03-04", "11:00", "a@b.example"), ("1", "vsm", "2024-03-01", "10:00", "a@b.example"), ("2", "delivery", "2024-03-09", "15:00", "pl@b.example")]


def test_eligible_parents(spark):
    df = ideas(spark, [("1", "", 0.0, "", "WIP", "", "", "a"), ("2", "", 0.0, "", "WIP", "", "1", "b"), ("3", "", 0.0, "", "WIP", "", None, "c")])
    assert sorted(tuple(r) for r in I.eligible_parents(df, ("1", "2")).collect()) == [("1", "3"), ("2", "1"), ("2", "3")]
    assert {r.id: r.n_parents for r in I.eligible_parent_counts(df, df).collect()} == {"1": 1, "2": 2, "3": 1}


def test_positions_follow_the_sort(spark):
    df = spark.range(1000).withColumn("k", F.col("id") * 7919 % 1000).repartition(9)
    assert [r.k for r in with_position(df.orderBy(F.desc("k"))).orderBy("position").collect()] == list(range(999, -1, -1))
    assert with_position(df.limit(0).orderBy("k")).count() == 0


def test_oracles_of_whole_inputs_have_no_empty_result(spark):
    for name in ("column_union", "phase_summary", "stream_active_users"):
        assert __spark_entry__.queries()[name](spark, SF).count() > 0
