"""Idea pipeline: savings, ranking, sprint plans, lookups and state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.calendar import sprint, vsm_date
from tallyspark.functions.text import blank_to_empty, is_address, let, parse_stamp, to_double
from tallyspark.operators.constants import ACTIVE, CUSTOMER, FREQUENCY, INTERNAL, MEETINGS
from tallyspark.sources.scratch import stored

FEASIBILITY = "baseline_process_time string, new_process_time string, manual string, fte string, eng string, freq string"


def feasibility(c: Column) -> Column:
    """The feasibility JSON as a struct of texts; bad JSON has no field."""
    return F.from_json(blank_to_empty(c), FEASIBILITY)


def load(ideas: DataFrame) -> DataFrame:
    """Ideas with their JSON parsed, newest first."""
    return ideas.withColumn("feasibility", feasibility(F.col("feasibility_data"))).orderBy(F.desc(blank_to_empty(F.col("created_date"))), "id")


def _number(text: Column) -> Column:
    """A number, 0 for a blank, null if it can't be read."""
    return F.when(blank_to_empty(text) == "", 0.0).otherwise(to_double(text))


def _multiplier(freq: Column, unknown: int) -> Column:
    table = F.create_map(*[F.lit(x) for pair in FREQUENCY.items() for x in pair])
    return F.coalesce(F.element_at(table, freq), F.lit(unknown)).cast("double")


def savings_fields(json: Column) -> Column:
    """What savings are worked out from, as a struct: numbers base, new, manual, fte, eng; the same of base, new and eng without a
    zero for blanks; and freq, Daily if the key is absent, blank if it is null.

    The JSON is parsed once and each number read once, however often the result is used.
    """

    def read(x: Column) -> Column:
        f, names = x.f, {"base": "baseline_process_time", "new": "new_process_time", "manual": "manual", "fte": "fte", "eng": "eng"}
        has = F.coalesce(F.array_contains(x.keys, "freq"), F.lit(False))
        given = {f"{k}_given": F.when(blank_to_empty(f[names[k]]) != "", to_double(f[names[k]])) for k in ("base", "new", "eng")}
        parts = {k: _number(f[name]) for k, name in names.items()} | given | {"freq": F.when(has, F.coalesce(f.freq, F.lit(""))).otherwise("Daily")}
        return F.struct(*[c.alias(k) for k, c in parts.items()])

    return let(F.struct(feasibility(json).alias("f"), F.json_object_keys(json).alias("keys")), read)


def _hours(x: Column) -> Column:
    saved = F.when((x.base != 0) & (x.base > x.new), x.base - x.new).otherwise(x.manual)
    return F.when(x.base.isNotNull() & x.new.isNotNull(), F.coalesce(saved * x.fte * _multiplier(x.freq, 1), F.lit(0.0))).otherwise(0.0)


def idea_hours(json: Column) -> Column:
    """Yearly hours saved; 0 as soon as a field that counts can't be read; an unknown frequency counts once."""
    return let(savings_fields(json), _hours)


def savings_table(ideas: DataFrame) -> DataFrame:
    """Savings by idea, field by field: an unreadable field falls back alone; an unknown frequency counts as daily."""

    def row(x: Column) -> Column:
        per = F.when(x.base_given.isNotNull() & x.new_given.isNotNull() & (x.base_given > x.new_given), x.base_given - x.new_given).otherwise(F.coalesce(x.manual, F.lit(0.0)))
        yearly = per * F.coalesce(x.fte, F.lit(0.0)) * _multiplier(x.freq, FREQUENCY["Daily"])
        parts = {"baseline": x.base_given, "new_time": x.new_given, "savings_per_occ": F.round(per, 2), "annual_hours": F.round(yearly, 1), "effort": F.round(x.eng_given, 1), "saving_hours": F.round(_hours(x), 1)}
        return F.struct(*[c.alias(k) for k, c in parts.items()])

    return ideas.select("id", let(savings_fields(F.col("feasibility_data")), row).alias("x")).select("id", "x.*")


def compute_roi(baseline: Column, new: Column, fte: Column, freq: Column, effort: Column) -> Column:
    """Yearly hours saved per hour of effort, two places; 0 without effort or saving."""
    per = F.when((baseline != 0) & (baseline > new), baseline - new).otherwise(0.0)
    return F.when(effort == 0, 0.0).otherwise(F.round(per * fte * _multiplier(freq, FREQUENCY["Daily"]) / effort, 2))


def category_rank(c: Column) -> Column:
    return F.when(c == CUSTOMER, 0).when(c == INTERNAL, 1).otherwise(2)


def _order() -> list[Column]:
    """Category, then return, then age as text, then id."""
    return [category_rank(F.col("category")), F.desc(F.coalesce("roi", F.lit(0.0))), blank_to_empty(F.col("created_date")), F.col("id")]


def priority_label(rank: Column) -> Column:
    roi = F.coalesce("roi", F.lit(0.0))
    head = F.when(F.col("category") == CUSTOMER, "P1-Customer").otherwise("P2-Internal")
    return F.concat(head, F.when(roi != 0, F.concat(F.lit(" (ROI "), F.format_string("%.1f", roi), F.lit(")"))).otherwise(""), F.lit(" #"), rank.cast("string"))


def rank_ideas(ideas: DataFrame, queue: str | None = "status", parts: int | None = None) -> DataFrame:
    """Rank 1..n and label of each idea in its queue, or of all ideas where ``queue`` is None.

    A queue may hold most ideas, so none is sorted in one task: rows are dealt by range of queue and order, and ranks within
    a part go on from the queue's number of ideas in earlier parts.
    """
    group = [] if queue is None else [queue]
    keys = [*group, "_c", "_r", "_d", "id"]
    keyed = ideas.withColumns({"_c": category_rank(F.col("category")), "_r": -F.coalesce("roi", F.lit(0.0)), "_d": blank_to_empty(F.col("created_date"))})
    # Written once with its part, so that counting and ranking see one and the same assignment.
    n = parts or ideas.sparkSession.sparkContext.defaultParallelism
    dealt = stored(keyed.repartitionByRange(n, *keys).withColumn("_p", F.spark_partition_id()), "rank")
    sizes = dealt.groupBy("_p", *[F.col(g).alias("_q") for g in group]).agg(F.count("*").alias("_n"))
    # A row for each part and queue in it.
    earlier = Window.partitionBy(*["_q" for _ in group]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("_p").alias("_o"), *["_q" for _ in group], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_p") == F.col("_o")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col("_q"))
    inside = F.row_number().over(Window.partitionBy("_p", *group).orderBy(*keys[len(group) :]))
    rank = (F.col("_before") + F.col("_k")).cast("int" if queue else "long")
    ranked = dealt.withColumn("_k", inside).join(before, same).withColumn("priority_rank", rank)
    return ranked.withColumn("priority_label", priority_label(F.col("priority_rank"))).drop("_c", "_r", "_d", "_p", "_k", "_o", "_before", *["_q" for _ in group])


def rank_all(ideas: DataFrame, parts: int | None = None) -> DataFrame:
    """One ranking over all ideas."""
    return rank_ideas(ideas, None, parts).drop("priority_label")


def engineer_queue(ideas: DataFrame, as_of: str) -> DataFrame:
    """Active ideas of each engineer in rank order with consecutive sprints from ``as_of``; blank engineers have no queue."""
    active = ideas.filter(F.col("status").isin(*ACTIVE) & (blank_to_empty(F.col("assigned_engineer")) != ""))
    ranked = rank_ideas(active, "assigned_engineer")
    start, end = sprint(F.lit(as_of).cast("date"), F.col("priority_rank"))
    return ranked.withColumn("sprint_start", start).withColumn("sprint_end", end)


def compute_delivery(ideas: DataFrame, requests: DataFrame, as_of: str, parts: int | None = None) -> DataFrame:
    """Slot of each request (an idea with its engineer) in that engineer's queue; an older row of the same idea is taken out.

    A request's rank is 1 plus the engineer's active ideas that sort before it.
    """
    keys = [category_rank(F.col("category")).alias("_c"), (-F.coalesce("roi", F.lit(0.0))).alias("_r"), blank_to_empty(F.col("created_date")).alias("_d")]
    fields = ["id", "assigned_engineer", "category", "roi", "created_date"]
    # An active idea counts for the rows after it: _more is 1 for active ideas, 0 for requests.
    active = ideas.filter(F.col("status").isin(*ACTIVE) & F.col("assigned_engineer").isNotNull()).select("id", "assigned_engineer", *keys, F.lit(1).alias("_more"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("double").alias("roi"))
    asked = requests.select(*fields, *keys)
    rows = asked.select("id", "assigned_engineer", "_c", "_r", "_d", F.lit(0).alias("_more"), "category", "roi").unionByName(active)
    order = ["assigned_engineer", "_c", "_r", "_d", "id", "_more"]
    n = parts or ideas.sparkSession.sparkContext.defaultParallelism
    # Written once with its partition, as in rank_all.
    dealt = stored(rows.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "delivery")
    # One row a partition and engineer: active ideas of the engineer in earlier partitions.
    counts = dealt.groupBy("_p", "assigned_engineer").agg(F.sum("_more").alias("_n"))
    earlier = Window.partitionBy("assigned_engineer").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_p").alias("_q"), F.col("assigned_engineer").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # Within a partition and engineer, rows are counted in order; the sort is by partition, so no group lands in one task.
    inside = F.sum("_more").over(Window.partitionBy("_p", "assigned_engineer").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = dealt.withColumn("_seen", inside).filter("_more = 0")
    placed = counted.join(offsets, (F.col("_p") == F.col("_q")) & F.col("assigned_engineer").eqNullSafe(F.col("_of"))).drop("_q", "_of")
    # An older row of the request itself does not count: it is one less where that row sorts earlier.
    own = active.select("id", F.col("assigned_engineer").alias("_e"), F.struct("_c", "_r", "_d").alias("_k"))
    own = placed.select("id", "assigned_engineer", "_c", "_r", "_d").distinct().join(own, "id").filter((F.col("_e") == F.col("assigned_engineer")) & (F.col("_k") < F.struct("_c", "_r", "_d")))
    own = own.groupBy("id", "assigned_engineer", "_c", "_r", "_d").agg(F.count("*").alias("_own"))
    same = ["id", "assigned_engineer", "_c", "_r", "_d"]
    ranked = placed.join(own, same, "left").withColumn("priority_rank", (1 + F.col("_before") + F.col("_seen") - F.coalesce("_own", F.lit(0))).cast("int"))
    start, end = sprint(F.lit(as_of).cast("date"), F.col("priority_rank"))
    return ranked.select("id", "assigned_engineer", "priority_rank", start.alias("sprint_start"), end.alias("sprint_end"), priority_label(F.col("priority_rank")).alias("priority_label"))


def feasibility_submit(ideas: DataFrame, submissions: DataFrame, as_of: str) -> DataFrame:
    """New values of submitted ideas: WIP, return, JSON, review date and schedule.

    ``submissions``: id, baseline, new_time, fte, effort (numbers), freq.
    """
    roi = compute_roi(F.col("baseline"), F.col("new_time"), F.col("fte"), F.col("freq"), F.col("effort"))
    asked = ideas.drop("roi").join(submissions, "id").withColumn("roi", roi)
    slot = compute_delivery(ideas, asked, as_of).select("id", "priority_label", "sprint_start", "sprint_end")
    json = F.to_json(F.struct(F.col("baseline").alias("baseline_process_time"), F.col("new_time").alias("new_process_time"), "fte", F.col("effort").alias("eng"), "freq"))
    out = asked.withColumn("new_json", json).join(slot, "id")
    return out.select("id", F.lit("WIP").alias("status"), "roi", F.col("new_json").alias("feasibility_data"), vsm_date(F.lit(as_of).cast("date")).alias("vsm_meeting_date"), "priority_label", "sprint_start", "sprint_end", F.col("sprint_end").alias("delivery_date"))


def decision_apply(ideas: DataFrame, decisions: DataFrame, as_of: str) -> DataFrame:
    """GO moves an idea to WIP with a first sprint from ``as_of``; NO-GO rejects it with a reason."""
    start, end = sprint(F.lit(as_of).cast("date"), F.lit(1))
    go = F.col("decision") == "GO"
    return ideas.drop("decision", "rejection_reason").join(decisions, "id").select(
        "id", F.when(go, "WIP").otherwise("Rejected").alias("status"), F.when(go, start).alias("sprint_start"), F.when(go, end).alias("sprint_end"), F.when(go, "").otherwise(blank_to_empty(F.col("reason"))).alias("rejection_reason"))


def status_move(moves: DataFrame, stamp: str) -> DataFrame:
    """Moves (id, new_status, reason): Completed stamps the date, Hold/Park needs a reason, any other move clears it."""
    hold = F.col("new_status") == "Hold/Park"
    reason = F.trim(blank_to_empty(F.col("reason")))
    return moves.select("id", "new_status", F.when(F.col("new_status") == "Completed", stamp).alias("completion_date"), F.when(hold, reason).otherwise("").alias("hold_reason"), (~hold | (reason != "")).alias("valid"))


def approval_queue(ideas: DataFrame, email: str) -> DataFrame:
    """WIP ideas of a lead, ranked."""
    return rank_ideas(ideas.filter((F.col("status") == "WIP") & (F.lower("pl_name") == email.lower())))


def master_lookup(ideas: DataFrame, master: DataFrame) -> DataFrame:
    """Ideas with project, unit, lead and line from the project master; blank where unmatched. Spark broadcasts a small master."""
    m = master.select("otp", "project_name", "business_unit", F.col("pd").alias("pd_name"), "spl_pl")
    filled = [blank_to_empty(F.col(c)).alias(c) for c in ("project_name", "business_unit", "pd_name", "spl_pl")]
    return ideas.select("id", "otp").join(m, "otp", "left").select("id", "otp", *filled)


def tools_with_idea(tools: DataFrame, ideas: DataFrame) -> DataFrame:
    """Tools with the name of their completed idea.

    Tools without idea have a key part of their own, so that they spread over all tasks and meet nothing.
    """
    blank = blank_to_empty(F.col("idea_id")) == ""
    # An idea's part is no constant, which Spark would compare in place of the key.
    done = ideas.filter("status = 'Completed'").select(F.col("id").alias("idea_id"), "idea_name").withColumn("_apart", F.when(blank, 2).otherwise(0).cast("long"))
    keyed = tools.withColumn("_apart", F.when(blank, F.xxhash64("id").bitwiseOR(F.lit(1))).otherwise(0))
    text = F.when(blank, "-").otherwise(F.coalesce("idea_name", F.lit("(idea not found)")))
    return keyed.join(done, ["idea_id", "_apart"], "left").select("id", "tool_name", "idea_id", text.alias("idea_name"))


def latest_state(ideas: DataFrame, patches: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Current row by key: a later patch replaces only the fields that it carries. Combined before the shuffle."""
    rows = ideas.select("id", F.lit(0).alias("seq"), *fields).unionByName(patches.select("id", "seq", *fields))
    return rows.groupBy("id").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields])


def upsert_last_wins(batch: DataFrame, key: str, seq: str) -> DataFrame:
    """One row by key, the last of it in order."""
    rest = [c for c in batch.columns if c not in (key, seq)]
    return batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r")).select(key, "r.*")


def user_log(users: DataFrame, changes: DataFrame) -> DataFrame:
    """(email, seq, deleted, role): users as the log's beginning, without seq, and then changes; emails in lower case.

    ``changes``: email, role, seq, and ``deleted`` where users may go.
    """
    key = F.lower(F.trim("email")).alias("email")
    gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in changes.columns else F.lit(False)
    before = users.select(key, F.lit(None).cast("long").alias("seq"), F.lit(False).alias("deleted"), "role")
    return before.unionByName(changes.select(key, F.col("seq").cast("long").alias("seq"), gone.alias("deleted"), "role"))


def fold_users(log: DataFrame) -> DataFrame:
    """(email, role) as the log's last entry of each email leaves it; a deletion is last among entries of one seq. Combined before the shuffle."""
    last = log.groupBy("email").agg(F.max(F.struct("seq", "deleted", "role")).alias("x"))
    return last.filter("not x.deleted").select("email", "x.role")


def upsert_users(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Users after changes in order of seq: added, given a new role, or deleted; repeated changes fold to the last."""
    return fold_users(user_log(users, changes))


def children(ideas: DataFrame) -> DataFrame:
    """(parent, child) pairs; blank parents never meet."""
    kids = ideas.filter(blank_to_empty(F.col("parent_id")) != "").select(F.col("id").alias("child_id"), F.col("parent_id").alias("id"), F.col("status").alias("child_status"))
    return ideas.select("id", "idea_name").join(kids, "id")


def parent_rollup(ideas: DataFrame) -> DataFrame:
    """Children, completed share, return and hours by parent; parents without child are absent."""
    kids = ideas.filter(blank_to_empty(F.col("parent_id")) != "").withColumn("hours", idea_hours(F.col("feasibility_data")))
    agg = kids.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"), F.count_if(F.col("status") == "Completed").alias("done"), F.sum(F.coalesce("roi", F.lit(0.0)).cast("decimal(18,4)")).alias("roi"), F.sum(F.col("hours").cast("decimal(18,4)")).alias("hours"))
    return ideas.select("id").join(agg, "id").select("id", "children", F.round(F.col("done") * 100.0 / F.col("children"), 1).cast("double").alias("completion"), F.col("roi").cast("double").alias("roi"), F.col("hours").cast("double").alias("hours"))


def kanban_layout(ideas: DataFrame) -> DataFrame:
    """Depth of each card in its lane: 1 under a parent in the same lane, else 0."""
    parents = ideas.select(F.col("id").alias("parent_id"), "status", F.col("idea_name").alias("parent_name"))
    placed = ideas.filter(blank_to_empty(F.col("parent_id")) != "").select("id", "parent_id", "status").join(parents, ["parent_id", "status"]).select("id", "parent_name")
    out = ideas.select("id", "status").join(placed, "id", "left")
    return out.select("id", "status", F.when(F.col("parent_name").isNull(), 0).otherwise(1).alias("depth"), blank_to_empty(F.col("parent_name")).alias("parent_name"))


def nestable_cards(ideas: DataFrame) -> DataFrame:
    """Cards without a child in their lane, of lanes with two cards or more."""
    busy = ideas.groupBy("status").agg(F.count("*").alias("n")).filter("n > 1").select("status")
    kids = ideas.filter(blank_to_empty(F.col("parent_id")) != "").select(F.col("parent_id").alias("id"), "status").distinct()
    return ideas.select("id", "status").join(kids, ["id", "status"], "left_anti").join(busy, "status", "left_semi").select("id", "status")


def eligible_parents(ideas: DataFrame, requested: Sequence[str]) -> DataFrame:
    """(id, parent_id): the ideas that each requested one may be put under, all those without parent but itself.

    ``requested`` are the ids on one screen.  An idea with a parent is never offered, so no child of a requested one is.
    """
    top = ideas.filter(blank_to_empty(F.col("parent_id")) == "")
    pairs = top.select(F.explode(F.array(*[F.lit(x) for x in requested])).alias("id"), F.col("id").alias("parent_id"))
    return pairs.filter("id <> parent_id")


def eligible_parent_counts(ideas: DataFrame, requested: DataFrame) -> DataFrame:
    """The number of possible parents of each requested idea; counts do without pairs, so all ideas may be requested."""
    top = ideas.filter(blank_to_empty(F.col("parent_id")) == "")
    total = top.count()
    own = top.select("id", F.lit(1).alias("own"))
    return requested.select("id").join(own, "id", "left").select("id", (F.lit(total) - F.coalesce("own", F.lit(0))).cast("long").alias("n_parents"))


def meeting_schedule(ideas: DataFrame) -> DataFrame:
    """A row for each idea and kind of meeting that has a date."""
    have = [m for m in MEETINGS if m[1] in ideas.columns]
    meetings = F.array(*[F.struct(F.lit(kind).alias("kind"), F.substring(blank_to_empty(F.col(c)), 1, 10).alias("date"), F.lit(time).alias("time")) for kind, c, time in have])
    people = F.array_join(F.filter(F.array("submitter_email", "assigned_engineer", "pl_name"), is_address), ",")
    out = ideas.select("id", people.alias("recipients"), F.explode(meetings).alias("m"))
    return out.filter(parse_stamp(F.col("m.date")).isNotNull()).select("id", "m.kind", "m.date", "m.time", "recipients")
