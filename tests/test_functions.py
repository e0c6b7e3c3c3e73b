"""Scalar rules on golden cases, with nulls and blanks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import calendar as C
from tallyspark.functions import text as X
from tallyspark.operators import reconcile as R
from tallyspark.operators import scoring as S


def run(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("o")).collect()
    return [r.o for r in sorted(rows)]


CASES = [
    (X.norm_ws, [("a   b \n c ", "a b c"), (None, ""), ("  ", "")]),
    (X.mx_number, [("12,433", 12433.0), ("1539", 1539.0), ("ESN11433", 11433.0), ("none", None), (None, None), ("ESN-11433", -11433.0)]),
    (X.numeric_only, [("CSN 2648", "2648"), ("23530.08", "23530.08"), ("1,539", "1539"), ("HAP19-040", ""), ("ESN 26259", ""), ("ISSUE 1 AUG", ""), (None, "")]),
    (X.post_digits, [("ESN12345", "12345"), ("none", "none"), ("", "")]),
    (X.post_schedule, [("Un-scheduled", "Unscheduled"), ("✓", "Scheduled"), ("was scheduled", "Scheduled"), ("no", "no"), (None, "")]),
    (X.post_date, [("2.1.2024", "2024-01-02"), ("03/04/2024", "2024-04-03"), ("12/25/2023", "2023-12-25"), ("5 march 2021", "2021-03-05"), ("Mar 5, 2021", "2021-03-05"), ("1.2.70", "1970-02-01"), ("1.2.20", "2020-02-01"), ("soon", "soon"), (None, "")]),
    (X.post_po10, [("PO 4600317870", "4600317870"), ("46003 17870", "4600317870"), ("5600317870", ""), (None, "")]),
    (X.po_from_subject, [("RE: 4600317870 x", "4600317870"), ("46003178701", None), (None, None)]),
    (X.sender_domain, [("A@b@C.example ", "c.example"), ("none", ""), (None, "")]),
    (X.display_name, [("ann.lee@x.example", "Ann Lee")]),
    (lambda c: X.trim_at_embedded_label(c, F.array(F.lit("input serial"), F.lit("qty"))), [("BPU200MK2 Input Serial B1151 Qty 1.000", "BPU200MK2"), ("Qty", "Qty"), (None, ""), ("plain", "plain")]),
    (lambda c: F.array_join(X.mx_words(c), "|"), [("The Valve, and valve 2", "valve|valve|2"), (None, "")]),
    (X.any_date, [("on 1 Feb 2020 or 2.3.2021", "1 Feb 2020"), ("none", "")]),
    (lambda c: X.org_email_ok(c, ("gmail.com",)), [("a@gmail.com", False), ("a@firm.example", True), ("none", False), (None, False)]),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_scalars(spark, k):
    f, pairs = CASES[k]
    assert run(spark, f, [p[0] for p in pairs]) == [p[1] for p in pairs]


def test_scan_fold(spark):
    assert run(spark, lambda c: X.scan_fold(X.mx_text(c)), ["G5020FPUO2", "G5020FPU02"])[0] == run(spark, lambda c: X.scan_fold(X.mx_text(c)), ["G5020FPU02"])[0]


def test_workdays_match_a_calendar(spark):
    start = dt.date(2024, 3, 1)
    days = [start + dt.timedelta(days=i) for i in range(14)]
    n = range(0, 25, 3)

    def walk(d, k):
        while d.weekday() > 4:
            d += dt.timedelta(days=1)
        while k:
            d += dt.timedelta(days=1)
            k -= d.weekday() < 5
        return d

    rows = spark.createDataFrame([(d, k) for d in days for k in n], "d date, k int").select("d", "k", C.add_workdays(F.col("d"), F.col("k")).alias("o")).collect()
    assert all(r.o == walk(r.d, r.k) for r in rows)
    assert run(spark, C.vsm_date, [dt.date(2024, 3, 8)], "date") == [dt.date(2024, 3, 11)]


@pytest.mark.parametrize("mode,a,b,status", [
    ("words", "jam", "it jammed", "match"), ("words", "jammed", "jam", "differ"), ("number", "12,433", "12433.0", "match"), ("number", "x", "1", "blank"),
    ("exact", "G5020FPUO2", "g5020 fpu02", "match"), ("exact", "", "x", "blank"), ("exact", "--", "x", "blank"), ("number", "1", "2", "differ"), ("words", "the", "x", "blank"),
])
def test_compare_cell(spark, mode, a, b, status):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(R.compare_cell(mode, F.col("a"), F.col("b")).alias("c")).first()
    assert row.c.status == status


def test_contradiction_scores_zero_without_review(spark):
    df = spark.createDataFrame([(1, "valve jammed", "No fault found", "", ""), (2, "odd smell", "No fault found", "", ""), (3, "valve jammed", "jammed valve confirmed", "", ""), (4, "odd smell", "replaced", "", "")], "report_id long, reason_for_removal string, fault_outcome string, findings string, actions_taken string")
    level, review = S.score_correctness()
    got = {r.report_id: (r.level, r.review) for r in S.prepare(df).select("report_id", level.alias("level"), review.alias("review")).collect()}
    assert got == {1: (0, False), 2: (3, False), 3: (3, False), 4: (0, True)}


def test_best_similar_token(spark):
    import difflib
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc12") for _ in range(rng.randrange(7, 12)))
    rows = [("abcdefgh", ["abcdefgx", "zzzzzzzz"]), ("abcdefgh", []), ("", ["abc"]), ("zzzzzzzz", ["aaaaaaaa"])] + [(word(), [word() for _ in range(9)]) for _ in range(60)]
    df = spark.createDataFrame(rows, "value string, tokens array<string>").select("value", "tokens", S.best_similar("value", "tokens").alias("best"))
    for r in df.collect():
        every = [(difflib.SequenceMatcher(None, r.value, t).ratio(), t) for t in r.tokens]
        most = max((x for x, _ in every), default=0.0)
        assert (r.best.ratio, r.best.token) == (most, min((t for x, t in every if x == most), default="") if most else "")


def test_reverse_check_codes(spark):
    text = "Unit BPU9OO1 SN-77/123 seen 2.3.2021, TSN 1,234.0 hours; unscheduled. Valve jammed"
    row = ("SN-77/129", "BPU9001", "88", "1234", "x", "4600000001", "jammed valve slow", "N1")
    names = [f for f, _, _ in S.REVERSE_FIELDS]
    order = ("core_serial_number", "core_oem_part_number", "engine_serial_number", "core_tsn", "core_csn", "rr_po_number", "reason_for_removal", "aircraft_tail_number")
    assert tuple(names) == order
    matches = spark.createDataFrame([(1, row)], "report_id int, row struct<" + ",".join(f"{n}:string" for n in names) + ">")
    texts = spark.createDataFrame([(1, text)], "report_id int, text string")
    got = {(r.field or r.detail): (r.found, r.score, r.code, r.evidence) for r in S.reverse_check(texts, texts, matches).collect()}
    assert got["core_serial_number"] == (True, 0.857, "near", "sn77123") and got["core_oem_part_number"] == (True, 1.0, "folded", "")
    assert got["engine_serial_number"] == (False, 0.0, "absent", "") and got["core_tsn"] == (True, 1.0, "exact", "") and got["core_csn"][2] == "not_comparable"
    assert got["rr_po_number"][0] is False and got["rr_po_number"][2] == "absent" and got["aircraft_tail_number"][2] == "short"
    assert got["reason_for_removal"] == (False, 0.667, "share", "slow") and got["Date of Removal"] == (True, 1.0, "exact", "2.3.2021") and got["Scheduled/Unscheduled"][0]


def test_completeness_by_vendor(spark):
    from tallyspark.operators import extraction as E

    ts = (E.Template("Big Maker", "R", (E.Field("a", ("A",)), E.Field("b", ("B",)), E.Field("c", ("C",)))),)
    rows = [(1, "big  MAKER", {"a": "1", "b": " "}), (2, "Other", {"a": "1"}), (3, None, {}), (4, "Big Maker", {"a": "1", "b": "2", "c": "3", "d": "4"})]
    df = spark.createDataFrame(rows, "k int, vendor string, m map<string,string>")
    assert [r.s for r in df.orderBy("k").select(S.completeness(F.col("m"), S.expected_fields(F.col("vendor"), ts)).alias("s")).collect()] == [33, 0, 0, 100]
