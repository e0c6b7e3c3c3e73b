"""Similarity, terms in texts, matching in two phases, users' change log and growing tables."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.similarity import most_similar, ratios
from tallyspark.functions.terms import prefix_pattern, term_hits
from tallyspark.operators import extraction as E
from tallyspark.operators import ideas as I
from tallyspark.operators import reconcile as R
from tallyspark.operators import scoring as S
from tallyspark.sources import tables as T
from tallyspark.sources.scratch import scratch_path


def plain_ratio(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_ratios_match_the_library():
    rng = random.Random(1)
    text = lambda: "".join(rng.choice("abc1é🎉") for _ in range(rng.randrange(0, 30)))
    pairs = [(text(), text()) for _ in range(1500)] + [("", ""), ("", "a"), ("a" * 300, "a" * 299), ("abcabcabc", "cabcab")]
    assert max(abs(r - plain_ratio(a, b)) for r, (a, b) in zip(ratios(*zip(*pairs)), pairs)) < 1e-15


def test_most_similar_token_is_the_least_of_the_best():
    rng = random.Random(2)
    text = lambda: "".join(rng.choice("ab1") for _ in range(rng.randrange(5, 12)))
    values, tokens = [text() for _ in range(200)], [[text() for _ in range(rng.randrange(0, 9))] for _ in range(200)]
    for v, ts, ratio, token in zip(values, tokens, *most_similar(values, tokens)):
        best = max((plain_ratio(v, t) for t in ts), default=0.0)
        assert ratio == best and token == min((t for t in ts if best and plain_ratio(v, t) == best), default="")
    assert most_similar([], [])[1] == []


def test_terms_are_found_in_one_pass(spark):
    terms = ["Serial #", "serial", "Input Serial", "TSN", "a.b", "x", "Vendor  Z"]
    texts = ["Input Serial: 5 serial # 7 TSN", "", None, "nothing", "xx a.b axb", "SERIAL", "vendor\n z Vendor Z"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", term_hits(F.lower("t"), terms).alias("h")).collect()
    pattern = re.compile("(?=(" + "|".join(re.escape(" ".join(t.lower().split())).replace(r"\ ", r"\s+") for t in sorted(terms, key=len, reverse=True)) + "))")
    for r in got:
        assert [(h.at - 1, h.term) for h in r.h] == [(m.start(), m.group(1)) for m in pattern.finditer((texts[r.i] or "").lower())]
    assert prefix_pattern(["tsn", "tso"]) == "ts(?:n|o)" and prefix_pattern([]) == ""


def test_header_columns_mind_the_labels_of_their_own_template(spark):
    fields = (E.Field("tsn", ("TSN",), tabular=True),)
    templates = (E.Template("Maker", "REPORT", fields), E.Template("Other", "REPORT", (*fields, E.Field("state", ("Fresh",)))))
    texts = spark.createDataFrame([(1, "Maker REPORT\nName  Unit TSN\nX1  Fresh", ""), (2, "Other REPORT\nName  Unit TSN\nX1  Fresh", "")], "doc_id int, text string, subject string")
    cells = spark.createDataFrame([], "doc_id int, sheet int, r int, c int, text string")
    got = {r.doc_id: r["values"]["tsn"] for r in E.extract_fields(texts, cells, templates).collect()}
    assert got[1] == "Fresh" and got[2] != "Fresh"


def test_cells_meet_labels_by_their_first_letters(spark):
    labels = tuple(f"Field {i:02d}" for i in range(50))
    template = E.Template("V", "R", tuple(E.Field(f"f{i}", (x,)) for i, x in enumerate(labels)) + (E.Field("po", ("PO",)), E.Field("any", ("TSN", "T"))))
    cells = spark.createDataFrame([(1, 0, i, 0, f"Field {i:02d}: v{i}") for i in range(50)] + [(1, 0, 60, 0, "PO 7"), (1, 0, 61, 0, "T 5"), (1, 0, 62, 0, "tsn 6"), (1, 0, 63, 0, "po")], "doc_id int, sheet int, r int, c int, text string")
    docs = spark.createDataFrame([(1, 0)], "doc_id int, template int")
    got = {r.field: r.value for r in E.grid_label_values(cells, docs, (template,)).collect()}
    assert got == {f"f{i}": f"v{i}" for i in range(50)} | {"po": "7", "any": "6"}


REPORTS = "report_id long, po string, input_part string, input_serial string, tsn string, csn string, esn string, reason_for_removal string, tail_no string, vendor string"
DUMP = "ord long, rr_po_number string, core_oem_part_number string, core_serial_number string, core_tsn string, core_csn string, engine_serial_number string, reason_for_removal string, aircraft_tail_number string"


def test_best_candidate_in_two_phases(spark):
    good = ("P1", "S1", "10", "5", "7", "valve jammed", "N1")
    reports = spark.createDataFrame([(1, "4000000001", *good, "V"), (2, "4000000002", *good, "V"), (3, "", *good, "V"), (4, "4999999999", *good, "V")], REPORTS)
    rows = [
        (9, "4000000001", *good), (3, "4000000001", *good), (1, "4000000001", "P1", "S9", "10", "5", "7", "valve jammed", "N1"),  # accepted ones in dump order before better ones
        (20, "4000000002", "P9", "S9", "10", "5", "7", "valve jammed", "N1"), (12, "4000000002", "P1", "S9", "10", "5", "7", "valve jammed", "N1"), (15, "4000000002", "P1", "S9", "10", "5", "7", "valve jammed", "N1"),
    ]
    dump = R.load_dump(spark.createDataFrame(rows, DUMP))
    got = {r.report_id: r for r in R.match_reports(reports, dump).collect()}
    assert {k: (r.status, r.ord, r.matched, r.differed) for k, r in got.items()} == {1: ("matched", 3, 7, 0), 2: ("mismatch", 12, 6, 1), 3: ("no_po_rows", None, 0, 0), 4: ("no_po_rows", None, 0, 0)}
    assert got[2].checks[1].outcome == "unequal" and got[2].row.core_serial_number == "S9"
    plan = R.match_reports(reports, dump)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    none = R.comparison_wide(reports, R.match_reports(reports, None)).collect()
    assert {r.match_status for r in none} == {"NO DUMP FILE"} and {r.core_tsn_result for r in none} == {"NOT CHECKED"}
    assert R.phase_summary(spark.createDataFrame([(True,)], "converted boolean"), spark.createDataFrame([(1,)], "template int"), R.match_reports(reports, None)).first().compared == 0


def test_numbers_within_a_tolerance(spark):
    reports = spark.createDataFrame([(1, "4000000001", "P1", "S1", "10.4", "5", "7", "valve", "N1", "V")], REPORTS)
    dump = R.load_dump(spark.createDataFrame([(1, "4000000001", "P1", "S1", "10", "5", "7", "valve", "N1")], DUMP))
    assert R.match_reports(reports, dump).first().status == "mismatch" and R.match_reports(reports, dump, tolerance=0.5).first().status == "matched"
    matches, texts = R.match_reports(reports, dump, tolerance=0.5), spark.createDataFrame([(1, "TSN 10.4 CSN 5")], "report_id long, text string")
    found = lambda **o: {r.field: r.found for r in S.reverse_check(reports, texts, matches, **o).collect()}["core_tsn"]
    assert not found() and found(tolerance=0.5)


def test_user_changes_fold_to_the_last(spark):
    users = spark.createDataFrame([("a@x", "r0"), ("b@x", "r0"), ("c@x", "r0")], "email string, role string")
    changes = spark.createDataFrame([("a@x", "r1", 1, None), ("A@x", "r3", 3, False), ("a@x", "r2", 2, False), ("B@X", None, 4, True), ("new@x", "r", 1, False), ("c@x", "r", 1, True), ("c@x", "again", 2, False), ("d@x", "r", 5, False), ("d@x", "r", 5, True)], "email string, role string, seq int, deleted boolean")
    assert sorted(tuple(r) for r in I.upsert_users(users, changes).collect()) == [("a@x", "r3"), ("c@x", "again"), ("new@x", "r")]
    assert sorted(tuple(r) for r in I.upsert_users(users, changes.drop("deleted").filter("seq = 1")).collect()) == [("a@x", "r1"), ("b@x", "r0"), ("c@x", "r"), ("new@x", "r")]


def test_growing_table_reads_by_its_log(spark):
    path = scratch_path(spark, "growing")
    T.append_parquet(spark.createDataFrame([(1, "x")], "a long, day string"), path, "day")
    T.append_parquet(spark.createDataFrame([(2, "y", 2.5, ["k"])], "a long, day string, `b.c` double, list array<string>"), path, "day")
    T.append_parquet(spark.createDataFrame([(3, "y")], "A long, day string"), path, "day")
    df = T.read_growing(spark, path)
    assert df.columns == ["a", "b.c", "list", "day"] and sorted(tuple(r) for r in df.collect()) == [(1, None, None, "x"), (2, 2.5, ["k"], "y"), (3, None, None, "y")]  # a partition column comes last
    with pytest.raises(ValueError, match="other types"):
        T.append_parquet(spark.createDataFrame([("4", "y")], "a string, day string"), path, "day")
    old = scratch_path(spark, "unlogged")
    spark.range(1).write.parquet(old)
    assert T.read_growing(spark, old).columns == ["id"]


def test_level_bands_and_sorting(spark):
    assert [r.b for r in spark.createDataFrame([(3,), (2,), (1,), (0,)], "x int").select(S.level_band(F.col("x")).alias("b")).collect()] == ["green", "amber", "red", "red"]
    rows = spark.createDataFrame([(1, "10", "b"), (2, "9", "A"), (3, None, None)], "report_id int, score string, vendor string")
    ids = lambda *a, **o: [r.report_id for r in S.sort_extractions(rows, *a, **o).collect()]
    assert ids("score", ascending=False) == [1, 2, 3] and ids("score", numbers=()) == [3, 1, 2] and ids("vendor") == [3, 2, 1]


def test_fields_stop_at_labels_of_their_own_template(spark):
    texts = spark.createDataFrame([(1, "ACME - NOTE\nFindings worn Result good\nState fine", ""), (2, "Other - NOTE\nFindings worn Result good\nState fine", "")], "doc_id long, text string, subject string")
    field = lambda c, label: E.Field(c, (label,))
    acme = E.Template("ACME", "NOTE", (field("findings", "Findings"), field("result", "Result")))
    other = E.Template("Other", "NOTE", (field("findings", "Findings"), field("state", "State")))
    cells = spark.createDataFrame([], "doc_id long, sheet int, r int, c int, text string")
    got = {r.doc_id: r["values"] for r in E.extract_fields(texts, cells, (acme, other)).collect()}
    assert got == {1: {"findings": "worn", "result": "good"}, 2: {"findings": "worn Result good", "state": "fine"}}
