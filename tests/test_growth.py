"""What a step costs by row: plans that must not shuffle twice, search by row or repeat work."""

from pyspark.sql import functions as F

from tallyspark.functions import text as X
from tallyspark.operators import extraction as E
from tallyspark.operators import ideas as I
from tallyspark.operators import reconcile as R
from tallyspark.operators import scoring as S


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_label_value_searches_without_lists_of_hits(spark):
    t = E.Template("m", "r", (E.Field("note", ("Note", "Remark"), multiline=True), E.Field("tsn", ("TSN",), stop_at=("end",))), neighbours=("Serial #",))
    texts = ["note : # a\nb\tSERIAL # 4 TSN# - 5 END 6\nx", "ATSN 1 tsn\n\n 2", "Remark TSN", "Note a  SERIAL  # b\r\nTSN x\nNOTE q", "Noted Note: \u00fc \u2713 tsn: 1tsn2 tsn", "", None]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    got = df.select(*[E.text_label_value(F.col("text"), f, t).alias(f.column) for f in t.fields])
    assert [tuple(r) for r in got.collect()] == [("a b", "5"), ("", "2"), ("", ""), ("a SERIAL # b", "x"), ("\u00fc \u2713", "1tsn2 tsn"), ("", ""), ("", "")]
    assert "lambda" not in plan(got)


def test_cells_are_shuffled_once(spark):
    rows = [(1, s, r, c, f" {s}{r}{c} " if (r + c) % 3 else None) for s in (0, 1) for r in range(3) for c in range(3)] + [(2, 0, 0, 0, " ")]
    cells = spark.createDataFrame(rows, "doc_id long, sheet int, r int, c int, text string")
    text = E.cells_to_text(cells)
    assert [tuple(r) for r in text.collect()] == [(1, "001   002\n010   011\n020   022\n\n101   102\n110   111\n120   122\n")]
    around = E.neighbour_cells(cells)
    got = {(r.sheet, r.r, r.c): (r.right, r.below) for r in around.filter("doc_id = 1").collect()}
    assert got[0, 0, 0] == ([" 001 ", " 002 "], [" 010 ", " 020 "]) and got[1, 1, 1] == ([None], [None])
    for df in (E.cells_to_text(cells), around, E.grid_positional(cells)):
        assert plan(df).count("Exchange ") == 1


def test_outcomes_are_worked_out_once_behind_a_filter(spark):
    reports = spark.createDataFrame([(1, "41", "ab 1"), (2, "41", "x"), (3, "", "")], "report_id long, po string, v string")
    dump = spark.createDataFrame([(7, "41", "AB-1"), (8, "41", "q")], "ord long, po_key string, w string")
    rules = (("w", "v", "exact", False),)
    matched = R.match_reports(reports, dump, rules).filter("status = 'matched'")
    # Outcomes of candidates and of winners each come out of a generator, which no filter is pushed through.
    assert plan(matched).count("Generate inline") == 2
    assert [(r.report_id, r.ord) for r in matched.collect()] == [(1, 7)]
    assert [(r.report_id, r.ord, r.accepted) for r in R.checked(reports, dump, rules).filter("row is not null").orderBy("report_id", "ord").collect()] == [(1, 7, True), (1, 8, False), (2, 7, False), (2, 8, False)]


def test_a_report_is_searched_once_whatever_is_asked_of_it(spark):
    names = [f for f, _, _ in S.REVERSE_FIELDS]
    row = ("SN-77/129", "BPU9001", "88", "1234", "x", "4600000001", "jammed valve slow", "N1")
    matches = spark.createDataFrame([(1, row), (2, None)], "report_id int, row struct<" + ",".join(f"{n}:string" for n in names) + ">")
    texts = spark.createDataFrame([(1, "BPU9OO1 SN-77/123, TSN 1,234.0 scheduled"), (2, "x")], "report_id int, text string")
    results = S.reverse_results(texts, matches)
    for df in (S.reverse_check(texts, texts, matches), S.hit_rate(results), S.reverse_summary(results)):
        # One call of Python, no filter that repeats the searches, no shuffle but the join's.
        assert plan(df).count("ArrowEvalPython") == 1 and "HashAggregate" not in plan(df) and plan(df).count("Exchange ") <= 2
        assert "size(array(" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in S.hit_rate(results).collect()] == [(1, 4, 10)]
    summary = S.reverse_summary(results).first()
    assert summary.seen == ["LRU SN", "LRU PN", "TSN", "Scheduled/Unscheduled"] and summary.in_report_core_csn == "NOT FOUND"


def test_lines_of_tokens_and_joint_patterns_equal_the_plain_forms(spark):
    texts = ["a-b/c._D --x -5 \u212a9 \u0130z. 1,2.5,6 -,5 1,,3 ._-", "no  fault\u00a0found NFF", "noise xnoisy noisyx unserviceable", "", None, "\u00a0\u2007", "-7 .5 2,000.0,"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    c = F.col("t")
    for r in df.select(X.report_tokens(c).alias("a"), F.split(F.trim(X.token_line(c)), " ").alias("b"), X.report_numbers(c).alias("c"), X.number_list(c).alias("d"), X.is_blank(c).alias("e"), (X.norm_ws(c) == "").alias("f")).collect():
        assert set(r.a) == set(r.b) - {""} and set(r.c) == set(r.d) - {None} and r.e == r.f
    for patterns in (S.NO_FAULT, S.FAULT, S.ROOT_CAUSE, S.SYMPTOM, (r"a\|b", "[|]", r"\(x|y")):
        assert all(r.a == r.b for r in df.select(X.matches_any(c, patterns).alias("a"), X.norm_ws(c).rlike("(?i)(?:" + "|".join(patterns) + ")").alias("b")).collect())
    assert X.any_pattern((r"\ba", r"\bno|is\b")) == r"\b(?:a|no)|is\b"


def test_rules_of_candidates_stay_small_enough_to_be_compiled(spark):
    import contextlib
    import io
    import re

    names = ("core_oem_part_number", "core_serial_number", "core_tsn", "core_csn", "engine_serial_number", "reason_for_removal", "aircraft_tail_number")
    reports = spark.createDataFrame([(1, "41", *"abcdefg")], "report_id long, po string, " + ", ".join(f"{r[1]} string" for r in R.RULES))
    dump = spark.createDataFrame([(7, "41", *"abcdefg")], "ord long, rr_po_number string, " + ", ".join(f"{n} string" for n in names))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        R.best_candidates(reports, R.load_dump(dump)).explain("codegen")
    # The JVM never compiles a method beyond 8,000 bytes.
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]
    assert max(sizes, default=0) < 8000


def test_tools_without_idea_spread_over_tasks(spark):
    tools = spark.range(4000).selectExpr("cast(id as string) id", "'t' tool_name", "case when id % 4 = 0 then cast(id as string) when id % 4 = 1 then null else '' end idea_id")
    ideas = spark.createDataFrame([("0", "a", "Completed"), ("4", "b", "WIP"), ("", "c", "Completed")], "id string, idea_name string, status string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = I.tools_with_idea(tools, ideas).select("*", F.spark_partition_id().alias("p")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 4000 and max(sum(r.p == p for r in rows) for p in range(4)) < 1300
    said = {r.id: (r.idea_id, r.idea_name) for r in rows}
    assert [said[k] for k in "01234"] == [("0", "a"), (None, "-"), ("", "-"), ("", "-"), ("4", "(idea not found)")]


def test_batches_of_patches_come_from_many_tasks(spark, monkeypatch):
    from pathlib import Path

    from tallyspark.plans import flow_queries

    made, path = {}, flow_queries.scratch_path
    monkeypatch.setattr(flow_queries, "scratch_path", lambda s, name: made.setdefault(name, path(s, name)))
    flow_queries.QUERIES["stream_latest_state"](spark, "/root/testdata/sf0.001")
    files = list(Path(made["patches"]).glob("*.parquet"))
    # Three micro-batches, each of as many files as there are tasks.
    assert len(files) == 3 * int(spark.conf.get("spark.sql.shuffle.partitions")) and len(list(Path(made["cp"]).glob("commits/[0-9]*"))) == 3


def test_similarity_of_pairs_without_lists(spark):
    df = spark.createDataFrame([("abcdefgh", "abcdefgx"), ("", ""), ("", "abc"), ("zz", "aa")], "value string, token string")
    got = df.select(S.similarity("value", "token").alias("a"), S.best_similar("value", F.array("token")).ratio.alias("b"))
    assert all(r.a == r.b for r in got.collect()) and "array(" not in plan(df.select(S.similarity("value", "token")))


def test_a_text_is_searched_without_patterns_over_it(spark):
    names = [f for f, _, _ in S.REVERSE_FIELDS]
    texts = ["a-b/c._D K9x İz. 1,2.5,6 -,5 1,,3 ._- -7 .5 2,000.0, valveéjammed", "sche duled O1L5 9-8,1. 😀-44", "", None, "x valve 3-٣ -12"]
    sought = [("ABCD", "9X", "-7", "2000", "44", "zz", "valve jammed", "01L5"), ("oils", "k9x", "-8", "81", "-44", "9", "9 z", "o1l5"), ("13", "x", "13", "0", "3", "01ls", "x the valve", "iz"), ("12", "valve", "-12", "12", "7", "x", "3", "n")]
    rows = [(i * 10 + j, t, v) for i, t in enumerate(texts) for j, v in enumerate(sought)]
    matches = spark.createDataFrame([(i, v) for i, _, v in rows], "report_id int, row struct<" + ",".join(f"{n}:string" for n in names) + ">")
    reports = spark.createDataFrame([(i, t) for i, t, _ in rows], "report_id int, text string")
    results = S.reverse_results(reports, matches)
    # Python gets the text; the only pattern that runs over it looks for a date.
    assert "translate(" not in results._jdf.queryExecution().optimizedPlan().toString()
    plain = reports.withColumns({"tokens": X.report_tokens(F.col("text")), "numbers": X.report_numbers(F.col("text")), "words": F.regexp_extract_all(F.lower(X.blank_to_empty(F.col("text"))), F.lit("[a-z0-9]+"), 0)}).join(matches, "report_id").join(results, "report_id")
    for r in plain.collect():
        for i, (field, _, mode) in enumerate(S.REVERSE_FIELDS):
            value, got = r.row[field], r.results[i]
            if mode == "number":
                assert got.found == (float(value) in r.numbers), (r.text, value)
            elif mode == "words":
                lacking = [w for w in value.lower().split() if w != "the" and w not in r.words]
                assert got.evidence == " ".join(lacking), (r.text, value)
            else:
                fold = lambda t: t.translate(str.maketrans("oilsbzgq", "01158260"))
                want = "exact" if value.lower() in r.tokens else "folded" if fold(value.lower()) in map(fold, r.tokens) else "short"
                assert got.code == want, (r.text, value)
        assert r.results[-1].found == ("scheduled" in "".join(r.words))


def test_reasons_become_words_once(spark):
    reports = spark.createDataFrame([(1, "valve jammed", "x", "worn", "")], "report_id int, reason_for_removal string, actions_taken string, findings string, fault_outcome string")
    matches = spark.createDataFrame([(1, ("Valve jammed",))], "report_id int, row struct<reason_for_removal:string>")
    scores = S.score_report(reports, matches)
    # Lists of words: three of the report's columns, what it declares, and the dump's reason.
    assert scores._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 5
    assert scores.first().rfr == 3


def test_batches_of_mail_come_from_many_files(spark, monkeypatch):
    import os

    from tallyspark.plans import flow_queries
    from tallyspark.plans.adapters import Inputs

    asked = []
    plain = flow_queries.J.event_stream
    monkeypatch.setattr(flow_queries.J, "event_stream", lambda session, folder, **o: asked.append((len([f for f in os.listdir(folder) if f.startswith("part-")]), o)) or plain(session, folder, **o))
    inputs = Inputs(spark, "/root/testdata/sf0.001")
    flow_queries._streamed(inputs, 4)
    (names, options), files = asked[0], int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A file a batch was one task's.
    assert names == 4 * files and options == {"files_per_batch": files}


def test_winners_shuffle_each_side_once_and_rank_as_the_rules_do(spark):
    import random

    rng = random.Random(3)
    some = lambda: rng.choice(["P1", "p-1", "PI", "", None, "5", "5.0", "-6", "the", "valve jammed", "jammed", "-", "K9", " "])
    ours, theirs = list(dict.fromkeys(r[0] for r in R.RULES)), [r[1] for r in R.RULES]
    reports = spark.createDataFrame([(i, rng.choice(["41", "42", "43", "44", "", "x"]), *[some() for _ in theirs]) for i in range(300)], "report_id long, po string, " + ", ".join(f"{c} string" for c in theirs))
    dump = R.load_dump(spark.createDataFrame([(i, rng.choice(["41", "4-2", "43", "45"]), i / 2, *[some() for _ in ours]) for i in range(200)], "ord long, rr_po_number string, extra double, " + ", ".join(f"{c} string" for c in ours)))
    for options in ({}, {"blank_blocks": True}, {"tolerance": 1.0}):
        won = {tuple(r) for r in R.winners(reports, dump, **options).collect()}
        assert won == {(r.report_id, r.ord, r.row) for r in R.match_reports(reports, dump, **options).filter("row is not null").collect()}
    # Both sides by order, few winners by report; a second join would shuffle the dump again.
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = plan(R.winners(reports, dump))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert made.count("Exchange hashpartitioning") == 3 and made.count("SortMergeJoin") == 1


def test_columns_are_cleaned_as_single_values_are(spark):
    import random

    import pyarrow as pa

    from tallyspark.functions import columns as C

    rng = random.Random(4)
    texts = ["".join(rng.choice("aAoOl01-,.. 97KKİé ٣\U0001f600\tthe ") for _ in range(rng.randrange(0, 9))) for _ in range(2000)] + ["", "-", "--5", "5.", "5.5.5", "-5,000.25x", "9" * 400, "007", "1,,2", "-,5", "\x1c", "THE the of", "other the"]
    c = F.col("v")
    rows = spark.createDataFrame([(x,) for x in texts], "v string").select("v", X.mx_text(c).alias("t"), X.scan_fold(X.mx_text(c)).alias("f"), X.mx_number(c).alias("n"), X.mx_words(c).alias("w"), X.is_blank(c).alias("b")).collect()
    column = pa.array(["cut", *[r.v for r in rows]]).slice(1)
    low, folded = C.letters(column)
    for r, t, f, n in zip(rows, low.to_pylist(), folded.to_pylist(), C.numbers(column).tolist()):
        assert (t.decode(), f.decode(), n if n == n else None) == (r.t, r.f, r.n)
        assert C.words(r.v) == r.w and (r.v.strip(C.BLANKS) == "") == r.b


def test_similar_words_of_lines_equal_similar_tokens():
    import random

    from tallyspark.functions.similarity import most_similar, most_similar_words

    rng = random.Random(5)
    text = lambda: "".join(rng.choice("ab1z") for _ in range(rng.randrange(4, 13)))
    values, tokens = [text() for _ in range(300)], [[text() for _ in range(rng.randrange(0, 9))] for _ in range(300)]
    lines = [b" " + " ".join(ts).encode() + b" " for ts in tokens]
    ratio, token = most_similar(values, [[t for t in ts if abs(len(t) - len(v)) <= 3] for v, ts in zip(values, tokens)])
    assert [(a, b) for a, b in zip(*most_similar_words(values, lines, 3))] == list(zip(ratio, token))
    # With a least ratio only what reaches it must be told.
    assert [(a, b) if a >= 0.8 else () for a, b in zip(*most_similar_words(values, lines, 3, 0.8))] == [(a, b) if a >= 0.8 else () for a, b in zip(ratio, token)]
    assert most_similar_words([], [], 3)[1] == []


def report_inputs(spark):
    """Reports, texts and dump rows: report 0 has no dump row, 2 no text, 3 a null row."""
    names = [f for f, _, _ in S.REVERSE_FIELDS]
    fields = ["input_serial", "input_part", "esn", "tsn", "csn", "failure_date", "po", "removal_type"]
    reports = spark.createDataFrame([(i, "valve jammed", "x", "worn", None, *["v" if (i + k) % 2 else "" for k in range(7)], None) for i in range(4)], "report_id int, reason_for_removal string, actions_taken string, findings string, fault_outcome string, " + ", ".join(f"{c} string" for c in fields))
    row = ("SN-77/129", "BPU9001", "88", "1234", "x", "4600000001", "Valve  jammed", "N1")
    matches = spark.createDataFrame([(1, row), (2, row), (3, None)], "report_id int, row struct<" + ",".join(f"{n}:string" for n in names) + ">")
    texts = spark.createDataFrame([(0, "BPU9001"), (1, "BPU9OO1 SN-77/123, TSN 1,234.0 scheduled valve"), (3, "x")], "report_id int, text string")
    return reports, texts, matches


def test_scores_come_from_one_join_by_report(spark):
    reports, texts, matches = report_inputs(spark)
    reverse = S.reverse_summary(S.reverse_results(texts, matches))
    scores = S.scored_reports(reports, texts, matches)
    assert plan(scores).count("ArrowEvalPython") == 1 and plan(scores).count("Exchange ") <= 3
    assert sorted(scores.collect()) == sorted(S.score_report(reports, matches, reverse).collect())


def test_wide_rows_come_with_the_scores(spark):
    reports, texts, matches = report_inputs(spark)
    reverse = S.reverse_summary(S.reverse_results(texts, matches))
    wide = S.scored_reports(reports, texts, matches, ("po", "tsn"))
    # One search and a shuffle of each input: neither scores nor verdicts are joined again.
    assert plan(wide).count("ArrowEvalPython") == 1 and plan(wide).count("Exchange ") <= 3
    assert sorted(wide.collect()) == sorted(S.scored_details_wide(reports, S.score_report(reports, matches, reverse), reverse, ("po", "tsn")).collect())


def odd_cells(rng, spark, n=60):
    """Sparse sheets of cells that are, begin with or stand beside labels, with blanks of all kinds, and two cells at one place."""
    some = ["TSN", "tsn:", "TSN: 5", " Serial #", "serial no  7", "CSN", "CSN - 1,2", "CSO.", "csoX", "9", "1\t2", "", None, "\u00a0", "İnf", "INF", "Note", "NOTE x y", "worn", " ", "Qty 3", "qty", "x" * 400]
    rows = [(d, rng.randrange(2), rng.choice((0, 1, 2, 3, 5, 9)), rng.choice((0, 1, 2, 4)), rng.choice(some)) for d in range(n) for _ in range(rng.randrange(14))]
    return rows, spark.createDataFrame(rows, "doc_id int, sheet int, r int, c int, text string")


def odd_templates():
    fields = (E.Field("tsn", ("TSN", "Qty"), tabular=True, expect="number"), E.Field("csn", ("CSN",)), E.Field("serial", ("Serial no", "Serial #")), E.Field("note", ("Note",)))
    return E.Template("A", "R", fields, neighbours=("CSO",), positional=True), E.Template("B", "R", fields[:2])


def test_values_at_labels_are_those_of_the_plain_rule(spark):
    import random
    import re

    rows, cells = odd_cells(random.Random(6), spark)
    templates = odd_templates()
    tidy = lambda t: " ".join(x for x in re.split("[\\s\u00a0\u2007\u202f]+", t or "", flags=re.A) if x)
    key = lambda t: tidy(t).lower().rstrip(" :#.")

    def first(texts, known, own):
        for t in texts:
            if not tidy(t):
                continue
            if any(key(t).startswith(k) and k != own and (key(t) + ":")[len(k)] in ":-= ." for k in known):
                return ""
            if key(t) not in known:
                return tidy(t)[:300]
        return ""

    want = {}
    for d, s, r, c, t in rows:
        template = templates[d % 2]
        for f in template.fields:
            for order, label in enumerate(f.labels):
                if not tidy(t) or not key(t).startswith(E.label_key(label)):
                    continue
                near = lambda test: [x[1] for x in sorted(((p, u or "") for q, s2, r2, c2, u in rows if q == d and s2 == s for p in test(r2, c2)))]  # noqa: B023, E731
                side = lambda: first(near(lambda r2, c2: [c2] if r2 == r and c < c2 <= c + 3 else []), template.labels(), E.label_key(label))  # noqa: B023, E731
                under = lambda: first(near(lambda r2, c2: [r2] if c2 == c and r < r2 <= r + 2 else []), template.labels(), E.label_key(label))  # noqa: B023, E731
                rest = tidy(t)[len(label) :].strip(" :-#./\t")[:300]
                value = rest or ((under() or side()) if f.tabular else (side() or under()))
                if value:
                    want.setdefault((d, f.column), []).append((order, s, r, c, value))
    docs = spark.createDataFrame([(d, d % 2) for d in range(60)], "doc_id int, template int")
    got = {(x.doc_id, x.field): x.value for x in E.grid_label_values(cells, docs, templates).collect()}
    assert len(got) > 40 and got == {k: min(v)[-1] for k, v in want.items()}


def test_fields_are_found_without_a_shuffle(spark):
    templates = E.sample_templates()
    texts = spark.createDataFrame([(1, "Vendor A - STRIP REPORT\nCust PO   4000000001   Input Part   \nFindings: worn   Qty   1\nSerial #   CSN   TSN   CSO\nINF   7\t   5      2", ""), (2, "Vendor B STRIP REPORT\nPart No In   x\nESN: ESN7", "PO 4000000002"), (3, "other", "")], "doc_id int, text string, subject string")
    made = E.extract_documents(texts, templates)
    # Cells stand in their document's row: nothing is exploded, sorted or joined, and Python sees a text once.
    assert not any(x in plan(made) for x in ("Exchange", "Window", "Join", "explode")) and plan(made).count("ArrowEvalPython") == 1
    cells = E.cells_of(texts.withColumnRenamed("doc_id", "report_id"))
    assert sorted(map(str, made.collect())) == sorted(map(str, E.extract_fields(texts, cells, templates).collect()))
    got = {r.doc_id: r["values"] for r in made.collect()}
    assert (got[1]["po"], got[1]["csn"], got[1]["tsn"], got[1]["findings"], got[1]["input_part"]) == ("4000000001", "7", "5", "worn", "1") and (got[2]["po"], got[2]["input_part"], got[2]["esn"]) == ("4000000002", "x", "7")


def test_columns_are_counted_without_working_values_out_twice(spark):
    templates = E.sample_templates()
    texts = spark.createDataFrame([(1, "Vendor A STRIP REPORT\nCust PO   4000000001   Input Part   x", ""), (2, "Vendor B STRIP REPORT\nPart No In    ", "")], "doc_id int, text string, subject string")
    counted = E.filled_columns(E.extract_documents(texts, templates), templates)
    made = counted._jdf.queryExecution().optimizedPlan().toString()
    # The map of values is made in one place; a filter before an explode made it once more.
    assert made.count("map_filter(") == 1
    assert [(r.column, r.n) for r in counted.orderBy("ord").collect()][:3] == [("po", 1), ("input_part", 1), ("input_serial", 0)]


def test_saved_extractions_are_stored_without_their_texts(spark, monkeypatch):
    from tallyspark.plans import flow_queries

    kept, plain = [], flow_queries.stored
    monkeypatch.setattr(flow_queries, "stored", lambda df, name: kept.append(df.columns) or plain(df, name))
    flow_queries.QUERIES["extraction_save"](spark, "/root/testdata/sf0.001")
    assert kept == [["doc_id", "vendor", "report", "values"]]


def matched_inputs(spark):
    """Reports and dump rows of a few orders; one order has more rows than a batch holds."""
    import random

    rng = random.Random(8)
    some = lambda: rng.choice(["P1", "p-1", "PI", "", None, "5", "5.0", "the", "valve jammed", "jammed", " "])
    ours, theirs = list(dict.fromkeys(r[0] for r in R.RULES)), [r[1] for r in R.RULES]
    reports = spark.createDataFrame([(i, rng.choice(["41", "42", "43", "44", "", None]), "V", *[some() for _ in theirs]) for i in range(120)], "report_id long, po string, vendor string, " + ", ".join(f"{c} string" for c in theirs))
    rows = [(i, rng.choice(["41", "42", "43"]), *[some() for _ in ours]) for i in range(150)] + [(1000 + i, "45", *[some() for _ in ours]) for i in range(300)]
    return reports.unionByName(reports.limit(1).withColumns({"report_id": F.lit(500).cast("long"), "po": F.lit("45")})), R.load_dump(spark.createDataFrame(rows, "ord long, rr_po_number string, " + ", ".join(f"{c} string" for c in ours)))


def exchanges(spark, make) -> list[str]:
    """Shuffles of a plan without broadcasts."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return [x for x in plan(make()).split("\n") if "Exchange hashpartitioning" in x]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_the_dump_is_shuffled_once_for_matches(spark):
    reports, dump = matched_inputs(spark)
    # Reports and dump by order, winners and reports by report; fetching winners by a second join shuffled the dump again.
    assert len(exchanges(spark, lambda: R.match_reports(reports, dump))) == 4
    got = {r.report_id: r for r in R.match_reports(reports, dump).collect()}
    for options in ({}, {"blank_blocks": True}, {"tolerance": 1.0}):
        best = {r.report_id: r.ord for r in R.best_candidates(reports, dump, **options).collect()}
        assert {r.report_id: r.ord for r in R.match_reports(reports, dump, **options).filter("ord is not null").collect()} == best and 500 in best
    # Checks and counts of the winner are those of its candidate.
    for r in R.checked(reports, dump).filter("row is not null").collect():
        if got[r.report_id].ord == r.ord:
            won = got[r.report_id]
            assert (r.matched, r.differed, r.blank, r.row) == (won.matched, won.differed, won.blank, won.row)
            assert [R.OUTCOMES[x] for x in r.outcomes] == [c.outcome for c in won.checks]


def test_statuses_take_no_dump_column_beyond_the_join(spark):
    reports, dump = matched_inputs(spark)
    made = exchanges(spark, lambda: R.match_statuses(reports, dump))
    # The order's own text is not shuffled with the dump, and winners are an id and a number.
    assert len(made) == 4
    assert R.ranked(reports, dump).columns == ["report_id", "ord", "misses"]
    for options in ({}, {"blank_blocks": True}):
        assert sorted(R.match_statuses(reports, dump, **options).collect()) == sorted(R.match_reports(reports, dump, **options).select("report_id", "status").collect())
