"""Reports against a system-of-record dump: candidate rows, rules, best candidate and wide outputs.

Two phases: reports and dump meet in one join by order, and candidates are ranked there by batches of columns, so that an order with
very many dump rows leaves few behind; the best of a report, with its columns, then goes to the report, and checks are made and named for that one row alone.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tallyspark.functions import columns as C
from tallyspark.functions.text import blank_to_empty, is_blank, let, mx_number, mx_text, mx_words, scan_fold, worked_out

#: (dump column, report column, mode, optional): exact text, equal number, or every word of the dump in the report.
RULES = (
    ("core_oem_part_number", "input_part", "exact", False),
    ("core_serial_number", "input_serial", "exact", False),
    ("core_tsn", "tsn", "number", False),
    ("core_csn", "csn", "number", False),
    ("engine_serial_number", "esn", "number", False),
    ("reason_for_removal", "reason_for_removal", "words", False),
    ("aircraft_tail_number", "tail_no", "exact", True),
)


def po_key(c: Column, strip_decimal: bool = False) -> Column:
    """Digits of an order number; ``4600317870.0`` keeps its last digit unless ``strip_decimal``."""
    v = F.regexp_replace(blank_to_empty(c), r"\.0+$", "") if strip_decimal else blank_to_empty(c)
    return F.regexp_replace(v, "[^0-9]+", "")


def load_dump(raw: DataFrame, po_column: str = "rr_po_number") -> DataFrame:
    """Trimmed text rows with ``po_key``: empty rows and blank keys dropped; a missing order column is an error."""
    if po_column not in raw.columns:
        raise ValueError(f"the dump has no column {po_column}")
    text = [c for c, kind in raw.dtypes if kind == "string"]
    rows = raw.select(*[F.trim(blank_to_empty(F.col(c))).alias(c) if c in text else F.col(c) for c in raw.columns])
    if po_column not in text:
        rows = rows.filter(F.exists(F.array(*text), lambda x: x != ""))
    # An order text with a digit isn't blank, so its row isn't empty either.
    return rows.filter(blank_to_empty(F.col(po_column)).rlike("[0-9]")).withColumn("po_key", po_key(F.col(po_column)))


def dump_preview(dump: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows, different orders, and which rule columns are there or missing."""
    have = F.array(*[F.lit(c) for c in dump.columns])
    want = F.array(*[F.lit(c) for c in columns])
    counted = dump.agg(F.count("*").alias("rows"), F.count_distinct("po_key").alias("orders"))
    return counted.select("rows", "orders", F.array_join(F.array_intersect(want, have), ",").alias("present"), F.array_join(F.array_except(want, have), ",").alias("missing"))


def prepared(mode: str, c: Column) -> Column:
    """What a comparison needs of one side, made once by row before any join: struct(e: whether blank, and by mode t, x, w, j).

    What holds a letter or a number isn't blank, so only the rest is looked at for that.
    """
    if mode == "number":
        x = mx_number(c)
        return F.struct((x.isNull() & is_blank(c)).alias("e"), x.alias("x"))
    if mode == "words":
        w = mx_words(c)
        return F.struct(((F.size(w) == 0) & is_blank(c)).alias("e"), w.alias("w"), F.array_join(w, " ").alias("j"))
    t = mx_text(c)
    return F.struct(((t == "") & is_blank(c)).alias("e"), t.alias("t"))


def worded(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``prepared`` words of texts: lists in one step, what is made from them in a generator, so that each list is made once."""
    lists = df.withColumns({f"{name}_list": mx_words(c) for name, c in columns.items()})
    made = {name: F.struct(((F.size(f"{name}_list") == 0) & is_blank(c)).alias("e"), F.col(f"{name}_list").alias("w"), F.array_join(f"{name}_list", " ").alias("j")) for name, c in columns.items()}
    return worked_out(lists, made)


#: Outcomes of a comparison, by number: tens tell the status, 1 match, 2 differ, 3 blank.
OUTCOMES = {10: "equal", 11: "equal_folded", 20: "unequal", 21: "words_absent", 30: "no_dump_value", 31: "no_report_value", 32: "not_comparable"}
STATUSES = ("match", "differ", "blank")


def outcome_of(mode: str, a: Column, b: Column, tolerance: float = 0.0) -> Column:
    """The outcome's number for a dump side and a report side, both prepared."""
    if mode == "number":
        empty, hits, miss = a.x.isNull() | b.x.isNull(), [(F.abs(a.x - b.x) <= tolerance, 10)], 20
    elif mode == "words":
        empty, hits, miss = F.size(a.w) == 0, [(F.forall(a.w, lambda w: F.contains(b.j, w)), 10)], 21
    else:
        empty, hits, miss = (a.t == "") | (b.t == ""), [(a.t == b.t, 10), ((F.octet_length(a.t) == F.octet_length(b.t)) & (scan_fold(a.t) == scan_fold(b.t)), 11)], 20
    chain = [(a.e, 30), (b.e, 31), (empty, 32), *hits]
    return reduce(lambda out, rule: F.when(rule[0], rule[1]).otherwise(out), reversed(chain), F.lit(miss)).cast("int")


def _tens(outcome: Column) -> Column:
    return F.floor(outcome / 10).cast("int")


def status_name(outcome: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in STATUSES]), _tens(outcome))


def outcome_name(outcome: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair]), outcome)


def compare_cell(mode: str, dump: Column, report: Column, tolerance: float = 0.0) -> Column:
    """struct(status, outcome) of two plain columns."""
    k = outcome_of(mode, prepared(mode, dump), prepared(mode, report), tolerance)
    return F.struct(status_name(k).alias("status"), outcome_name(k).alias("outcome"))


def candidates(reports: DataFrame, dump: DataFrame) -> DataFrame:
    """Every report with each dump row of its order; reports without one keep null; blank orders never meet, nor do they enter the join."""
    made = [c for c in dump.columns if c.startswith("_")]
    rows = dump.select("po_key", "ord", F.struct(*[F.col(c) for c in dump.columns if c not in ("po_key", "ord", *made)]).alias("row"), *made)
    keyed = reports.withColumn("po_key", F.nullif(po_key(F.col("po")), F.lit("")))
    met = keyed.filter("po_key is not null").join(rows, "po_key", "left")
    return met.unionByName(keyed.filter("po_key is null"), allowMissingColumns=True)


def checked(reports: DataFrame, dump: DataFrame, rules=RULES, blank_blocks: bool = False, tolerance: float = 0.0) -> DataFrame:
    """Candidates with an outcome by rule (array ``outcomes``), counts and acceptance.

    A row is accepted where no rule that must hold is contradicted; blanks block only if told to.
    """
    for i, (field, report, mode, _) in enumerate(rules):
        dump, reports = dump.withColumn(f"_d{i}", prepared(mode, F.col(field))), reports.withColumn(f"_r{i}", prepared(mode, F.col(report)))
    found = F.array(*[outcome_of(mode, F.col(f"_d{i}"), F.col(f"_r{i}"), tolerance) for i, (_, _, mode, _) in enumerate(rules)])
    rows = worked_out(candidates(reports, dump), {"outcomes": F.when(F.col("row").isNotNull(), found)})
    tens = [_tens(F.col("outcomes")[i]) for i in range(len(rules))]
    counts = {name: sum((F.when(t == k, 1).otherwise(0) for t in tens), F.lit(0)) for k, name in enumerate(("matched", "differed", "blank"), 1)}
    return rows.withColumns(counts | {"accepted": accepted(rules, blank_blocks)})


def accepted(rules=RULES, blank_blocks: bool = False) -> Column:
    """Acceptance of a row with ``outcomes``."""
    against = (2, 3) if blank_blocks else (2,)
    return ~reduce(lambda a, b: a | b, [_tens(F.col("outcomes")[i]).isin(*against) for i, r in enumerate(rules) if not r[3]], F.lit(False))


#: A candidate's rank is a decimal: the misses of one that isn't accepted, then its place in the dump.
_PLACES, _MANY = 10**19, 1 + 99


def best_candidates(reports: DataFrame, dump: DataFrame, rules=RULES, blank_blocks: bool = False, tolerance: float = 0.0) -> DataFrame:
    """(report_id, po_key, ord): the winning dump row of each report that has candidates.

    The first accepted row in dump order wins, else the row with most matches, ties to the earliest.
    """
    slim = reports.select("report_id", "po", *dict.fromkeys(r[1] for r in rules))
    rows = checked(slim, dump.select("po_key", "ord", *dict.fromkeys(r[0] for r in rules)), rules, blank_blocks, tolerance).filter("row is not null")
    misses = F.when(F.col("accepted"), 0).otherwise(_MANY - F.col("matched")).cast("decimal(4,0)")
    rank = (misses * F.lit(str(_PLACES)).cast("decimal(20,0)") + F.col("ord").cast("decimal(19,0)")).cast("decimal(38,0)")
    best = rows.groupBy("report_id", "po_key").agg(F.min(rank).alias("rank"))
    return best.select("report_id", "po_key", (F.col("rank") % F.lit(str(_PLACES)).cast("decimal(20,0)")).cast("long").alias("ord"))


def candidate_misses(rows: pa.RecordBatch, modes: tuple[str, ...], optional: tuple[bool, ...], blank_blocks: bool, tolerance: float) -> np.ndarray:
    """A rank's first part of candidates ``d<i>``, ``r<i>``: 0 where accepted, else greater the fewer rules match."""
    matched, against = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
    for i, mode in enumerate(modes):
        ours, theirs = rows.column(f"d{i}"), rows.column(f"r{i}")
        if mode == "number":
            a, b = C.numbers(ours), C.numbers(theirs)
            blank = np.isnan(a) | np.isnan(b)
            with np.errstate(invalid="ignore"):
                match = np.abs(a - b) <= tolerance
        elif mode == "words":
            status = C.by_pair(_words_status, ours, theirs)
            blank, match = status == 3, status == 1
        else:
            (a, a_folded), (b, b_folded) = C.letters(ours), C.letters(theirs)
            blank = (pc.binary_length(a).to_numpy() == 0) | (pc.binary_length(b).to_numpy() == 0)
            match = pc.equal(a_folded, b_folded).to_numpy(zero_copy_only=False)
        matched += match & ~blank
        if not optional[i]:
            against |= blank if blank_blocks else False
            against |= ~match & ~blank
    return np.where(against, _MANY - matched, 0)


def _words_status(ours: str, theirs: str) -> int:
    """1 every word of ours in theirs, 2 not, 3 nothing to compare."""
    want, have = C.words(ours), " ".join(C.words(theirs))
    return 3 if not want or not theirs.strip(C.BLANKS) else 1 if all(w in have for w in want) else 2


def candidate_outcomes(rows: pa.RecordBatch, modes: tuple[str, ...], tolerance: float) -> pa.Array:
    """Lists of a candidate's outcomes by rule, as ``outcome_of`` numbers them."""
    found = []
    for i, mode in enumerate(modes):
        ours, theirs = rows.column(f"d{i}"), rows.column(f"r{i}")
        if mode == "number":
            a, b = C.numbers(ours), C.numbers(theirs)
            with np.errstate(invalid="ignore"):
                told = np.where(np.isnan(a) | np.isnan(b), 32, np.where(np.abs(a - b) <= tolerance, 10, 20))
        elif mode == "words":
            told = np.array([0, 10, 21, 32])[C.by_pair(_words_status, ours, theirs)]
        else:
            (a, a_folded), (b, b_folded) = C.letters(ours), C.letters(theirs)
            same, folded = (pc.equal(*x).to_numpy(zero_copy_only=False) for x in ((a, b), (a_folded, b_folded)))
            empty = (pc.binary_length(a).to_numpy() == 0) | (pc.binary_length(b).to_numpy() == 0)
            told = np.where(empty, 32, np.where(same, 10, np.where(folded, 11, 20)))
        blank = [pc.equal(pc.utf8_trim(x, characters=C.BLANKS), "").to_numpy(zero_copy_only=False) for x in (ours, theirs)]
        found.append(np.where(blank[0], 30, np.where(blank[1], 31, told)))
    each = np.stack(found, axis=1).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(each) + 1, dtype=np.int32) * len(modes)), pa.array(each.ravel()))


def ranked(reports: DataFrame, dump: DataFrame, rules=RULES, blank_blocks: bool = False, tolerance: float = 0.0, kept: tuple[str, ...] = (), told: bool = False) -> DataFrame:
    """(report_id, ord, row, misses): of each report's candidates the best of each batch, with dump columns ``kept`` as ``row`` (no such column without any), and with ``outcomes`` if ``told``.

    Each side is shuffled once, as it is, and a batch of candidates is ranked as columns. Few rows of a report are left to compare across batches.
    """
    modes, optional = tuple(r[2] for r in rules), tuple(r[3] for r in rules)
    slim = reports.select("report_id", F.nullif(po_key(F.col("po")), F.lit("")).alias("po_key"), *[blank_to_empty(F.col(r[1])).alias(f"r{i}") for i, r in enumerate(rules)]).filter("po_key is not null")
    asked = list(dict.fromkeys([*kept, *(r[0] for r in rules)]))
    met = slim.join(dump.select("po_key", "ord", *[F.col(c).alias(f"c{k}") for k, c in enumerate(asked)]), "po_key")
    met = met.select("report_id", "ord", *[f"c{k}" for k in range(len(kept))], *[blank_to_empty(F.col(f"c{asked.index(r[0])}")).alias(f"d{i}") for i, r in enumerate(rules)], *[f"r{i}" for i in range(len(rules))])
    keep = ["report_id", "ord", *[f"c{k}" for k in range(len(kept))]]

    def best_of_batches(batches):
        for batch in batches:
            if not len(batch):
                continue
            misses, ids = candidate_misses(batch, modes, optional, blank_blocks, tolerance), batch.column("report_id")
            run = np.concatenate([np.zeros(1, np.int64), np.cumsum(pc.fill_null(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)), True).to_numpy(zero_copy_only=False))])
            order = np.lexsort((batch.column("ord").to_numpy(zero_copy_only=False), misses, run))
            first = order[np.unique(run[order], return_index=True)[1]]
            best = batch.take(pa.array(first))
            outcomes = {"outcomes": candidate_outcomes(best, modes, tolerance)} if told else {}
            yield pa.RecordBatch.from_pydict({c: best.column(c) for c in keep} | {"misses": pa.array(misses[first])} | outcomes)

    more = [StructField("outcomes", ArrayType(IntegerType()))] if told else []
    best = met.mapInArrow(best_of_batches, StructType([*[met.schema[c] for c in keep], StructField("misses", LongType()), *more]))
    row = [F.struct(*[F.col(f"c{k}").alias(c) for k, c in enumerate(kept)]).alias("row")] if kept else []
    return best.select("report_id", "ord", *row, "misses", *(["outcomes"] if told else []))


def _columns(dump: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in dump.columns if c not in ("po_key", "ord"))


def winners(reports: DataFrame, dump: DataFrame, rules=RULES, blank_blocks: bool = False, tolerance: float = 0.0) -> DataFrame:
    """(report_id, ord, row): the dump row of ``best_candidates`` of each report that has candidates, for what needs no checks.

    The best of ``ranked`` rows, with its columns, so no row is fetched by a second join.
    """
    best = ranked(reports, dump, rules, blank_blocks, tolerance, _columns(dump))
    return best.groupBy("report_id").agg(F.min_by(F.struct("ord", "row"), F.struct("misses", "ord")).alias("best")).select("report_id", "best.ord", "best.row")


def match_statuses(reports: DataFrame, dump: DataFrame, rules=RULES, blank_blocks: bool = False, tolerance: float = 0.0) -> DataFrame:
    """(report_id, status) of ``match_reports``, for what only counts: no column of the dump goes beyond the join."""
    best = ranked(reports, dump, rules, blank_blocks, tolerance).groupBy("report_id").agg(F.min("misses").alias("misses"))
    status = F.when(F.col("misses").isNull(), "no_po_rows").when(F.col("misses") == 0, "matched").otherwise("mismatch")
    return reports.select("report_id").join(best, "report_id", "left").select("report_id", status.alias("status"))


def match_reports(reports: DataFrame, dump: DataFrame | None, rules=RULES, blank_blocks: bool = False, tolerance: float = 0.0) -> DataFrame:
    """A row by report: status, ord, row, checks and counts of the best candidate; without a dump every report says so.

    ``report_id`` names a report, ``ord`` (not negative) a dump row.
    """
    if dump is None:
        nothing = "cast(null as array<struct<field:string,mode:string,dump_value:string,report_value:string,status:string,outcome:string,absent:array<string>,optional:boolean>>)"
        dumped = F.struct(*[F.lit(None).cast("string").alias(r[0]) for r in rules])
        return reports.select("report_id", F.lit("no_dump").alias("status"), F.lit(None).cast("long").alias("ord"), F.when(F.lit(False), dumped).alias("row"), F.expr(nothing).alias("checks"), *[F.lit(0).alias(c) for c in ("matched", "differed", "blank")])
    # Winners come with their columns and outcomes: the dump is shuffled once, by order. Lists of a report's few ranked rows are hashed; a least struct would be sorted for.
    best = ranked(reports, dump, rules, blank_blocks, tolerance, _columns(dump), told=True)
    best = best.groupBy("report_id").agg(F.array_min(F.collect_list(F.struct("misses", "ord", "row", "outcomes"))).alias("best"))
    said = F.struct(*[F.col(r[1]).alias(f"v{i}") for i, r in enumerate(rules)])
    won = worked_out(reports.select("report_id", said.alias("said")).join(best, "report_id", "left"), {c: F.col(f"best.{c}") for c in ("misses", "ord", "row", "outcomes")})
    # Words are only made of a winner that lacks some.
    won = worked_out(won, {"absent": F.array(*[_absent(i, *rule[:3]) for i, rule in enumerate(rules)])})
    status = F.when(F.col("row").isNull(), "no_po_rows").when(F.col("misses") == 0, "matched").otherwise("mismatch")
    checks = F.when(F.col("row").isNotNull(), F.array(*[_check(i, *rule) for i, rule in enumerate(rules)]))
    counts = [sum((F.when(_tens(F.col("outcomes")[i]) == k, 1).otherwise(0) for i in range(len(rules))), F.lit(0)).alias(name) for k, name in enumerate(("matched", "differed", "blank"), 1)]
    return won.select("report_id", status.alias("status"), "ord", "row", checks.alias("checks"), *counts)


def _absent(i: int, dump: str, report: str, mode: str) -> Column:
    """The winner's words that the report lacks, if rule ``i`` is about words."""
    none = F.array().cast("array<string>")
    if mode != "words":
        return none
    joined = F.array_join(mx_words(F.col(f"said.v{i}")), " ")
    return F.when(F.col("outcomes")[i] == 21, let(joined, lambda have: F.filter(mx_words(F.col(f"row.{dump}")), lambda w: ~F.contains(have, w)))).otherwise(none)


def _check(i: int, dump: str, report: str, mode: str, optional: bool) -> Column:
    """One rule of the best candidate; ``absent`` are the dump's words that the report lacks."""
    outcome, ours, theirs = F.col("outcomes")[i], F.col(f"row.{dump}"), F.col(f"said.v{i}")
    parts = {"field": F.lit(dump), "mode": F.lit(mode), "dump_value": blank_to_empty(ours), "report_value": blank_to_empty(theirs), "status": status_name(outcome), "outcome": outcome_name(outcome), "absent": F.col("absent")[i], "optional": F.lit(optional)}
    return F.struct(*[c.alias(name) for name, c in parts.items()])


STATUS_LABELS = {"matched": "MATCHED", "mismatch": "NOT MATCHED", "no_po_rows": "PO NOT IN DUMP", "no_dump": "NO DUMP FILE"}


def status_label(c: Column) -> Column:
    return reduce(lambda out, kv: F.when(c == kv[0], kv[1]).otherwise(out), STATUS_LABELS.items(), c)


def comparison_wide(reports: DataFrame, matches: DataFrame, rules=RULES) -> DataFrame:
    """One row by report: lead columns, three by rule, counts and notes."""
    body = []
    for i, (field, _, _, _) in enumerate(rules):
        c = F.try_element_at("checks", F.lit(i + 1))
        body += [blank_to_empty(c.report_value).alias(f"{field}_report"), blank_to_empty(c.dump_value).alias(f"{field}_dump"), F.coalesce(F.upper(c.status), F.lit("NOT CHECKED")).alias(f"{field}_result")]
    noted = F.filter("checks", lambda c: c.outcome != "equal")
    note = lambda c: F.concat(c.field, F.lit("="), c.outcome, F.when(F.size(c.absent) > 0, F.concat(F.lit(":"), F.array_join(c.absent, "+"))).otherwise(""))
    notes = blank_to_empty(F.array_join(F.transform(noted, note), ";"))
    return reports.select("report_id", "po", "vendor").join(matches, "report_id").select("report_id", status_label(F.col("status")).alias("match_status"), "po", "vendor", *body, "matched", "differed", "blank", notes.alias("notes"))


def matched_tracker(reports: DataFrame, matches: DataFrame) -> DataFrame:
    """Dump rows of accepted reports with where they came from and the rules that matched."""
    rules = F.array_join(F.transform(F.filter("checks", lambda c: c.status == "match"), lambda c: c.field), ", ")
    won = matches.filter("status = 'matched'").select("report_id", "row", rules.alias("matched_rules"))
    return won.join(reports.select("report_id", F.col("po").alias("matched_po"), "vendor"), "report_id").select("report_id", "row.*", "matched_po", "vendor", "matched_rules")


def phase_summary(attachments: DataFrame, extracted: DataFrame, matches: DataFrame) -> DataFrame:
    """Counters of a run in one row.

    ``attachments`` are the queued files with ``converted`` (boolean); ``extracted`` has the converted ones with a
    template place or null; ``matches`` the extracted ones.
    """
    s, count = F.col("status"), lambda c, name: F.count_if(c).alias(name)
    files = attachments.agg(F.count("*").alias("queued"), count(F.col("converted"), "converted"), count(~F.col("converted"), "errors"))
    read = extracted.agg(F.count("template").alias("extracted"), count(F.col("template").isNull(), "unmatched"))
    met = matches.agg(count(s == "matched", "matched"), count(s == "mismatch", "mismatch"), count(s == "no_po_rows", "po_missing"), count(s.isin("matched", "mismatch"), "compared"))
    rows = files.unionByName(read, allowMissingColumns=True).unionByName(met, allowMissingColumns=True)
    return rows.agg(*[F.sum(c).alias(c) for c in rows.columns])
