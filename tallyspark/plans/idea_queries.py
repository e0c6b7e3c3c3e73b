"""Registered queries over ideas, each with SQL written from the rule for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import dashboard as D
from tallyspark.operators import ideas as I
from tallyspark.operators.constants import ACTIVE, AI, AUTOMATION
from tallyspark.plans.adapters import Inputs, with_clause, with_position

AS_OF, WEEKEND = "2024-03-07", "2024-03-09"
_IN = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
_ACTIVE = _IN(ACTIVE)
_NUM = lambda f: f"CASE WHEN regexp_full_match(trim({f}), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN CAST(trim({f}) AS DOUBLE) END"
_FIELD = lambda k: f"coalesce(json_extract_string(feasibility_data, '$.{k}'), '')"
_ZERO = lambda k: f"CASE WHEN {_FIELD(k)} = '' THEN 0 ELSE {_NUM(_FIELD(k))} END"
_MULT = lambda other: f"CASE json_extract_string(feasibility_data, '$.freq') WHEN 'Daily' THEN 260 WHEN 'Weekly' THEN 52 WHEN 'Monthly' THEN 12 WHEN 'Yearly' THEN 1 ELSE CASE WHEN json_exists(feasibility_data, '$.freq') THEN {other} ELSE 260 END END"
#: Yearly hours by idea.
_HOURS = f""", fields AS (SELECT *, {_ZERO("baseline_process_time")} AS fb, {_ZERO("new_process_time")} AS fn, {_ZERO("manual")} AS fm, {_ZERO("fte")} AS ff, {_MULT(1)} AS fq FROM ideas),
timed AS (SELECT *, CASE WHEN fb IS NULL OR fn IS NULL THEN 0 ELSE coalesce(CASE WHEN fb <> 0 AND fb > fn THEN fb - fn ELSE fm END * ff * fq, 0) END AS hours, coalesce(roi, 0) AS r FROM fields)
"""
_DEC = lambda x: f"CAST(coalesce(sum(CAST({x} AS DECIMAL(18,4))), 0) AS DOUBLE)"
_RANK = "CASE category WHEN 'Customer Requirement' THEN 0 WHEN 'Internal' THEN 1 ELSE 2 END"
_ORDER = f"{_RANK}, coalesce(roi, 0) DESC, created_date, id"
_LABEL = "CASE WHEN category = 'Customer Requirement' THEN 'P1-Customer' ELSE 'P2-Internal' END || CASE WHEN coalesce(roi, 0) <> 0 THEN ' (ROI ' || printf('%.1f', roi) || ')' ELSE '' END || ' #' || CAST(priority_rank AS VARCHAR)"


def _workdays(as_of: str) -> str:
    """Numbered working days from a date on, by a calendar rather than a formula."""
    return f"workdays AS (SELECT CAST(d AS VARCHAR) AS d, row_number() OVER (ORDER BY d) - 1 AS k FROM (SELECT CAST(unnest(generate_series(DATE '{as_of}', DATE '{as_of}' + INTERVAL 40000 DAY, INTERVAL 1 DAY)) AS DATE) AS d) WHERE isodow(d) <= 5)"


QUERIES, SQL = {}, {}


def dates_as_text(df: DataFrame) -> DataFrame:
    """Dates as text, so that both engines give the same values."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) if kind == "date" else F.col(f"`{c}`") for c, kind in df.dtypes])


def query(name: str, sql: str | None, *views: str):
    """Register a query over Inputs, with SQL over the named views."""

    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: dates_as_text(f(Inputs(spark, sf_dir)))
        if sql is not None:
            SQL[name] = (with_clause(*views) if views else "") + sql
        return f

    return keep


def _add(name: str, f, sql: str | None, *views: str) -> None:
    query(name, sql, *views)(f)


_add("ideas_load", lambda v: with_position(I.load(v.ideas.withColumn("feasibility_data", F.when(F.expr("CAST(id AS BIGINT) % 17 = 3"), F.lit('{"fte": 1, ')).otherwise(F.col("feasibility_data")))).select("id", "created_date", F.coalesce("feasibility.freq", F.lit("")).alias("freq"), F.coalesce("feasibility.fte", F.lit("")).alias("fte"))),
     f"SELECT id, created_date, CASE WHEN CAST(id AS BIGINT) % 17 = 3 THEN '' ELSE {_FIELD('freq')} END AS freq, CASE WHEN CAST(id AS BIGINT) % 17 = 3 THEN '' ELSE {_FIELD('fte')} END AS fte, row_number() OVER (ORDER BY created_date DESC, id) AS position FROM ideas", "ideas")
_add("idea_hours", lambda v: v.ideas.select("id", I.idea_hours(F.col("feasibility_data")).alias("hours")), _HOURS + "SELECT id, CAST(hours AS DOUBLE) AS hours FROM timed", "ideas")
_add("idea_savings_table", lambda v: I.savings_table(v.ideas),
     _HOURS + f""", local AS (SELECT *, CASE WHEN {_FIELD('baseline_process_time')} <> '' THEN {_NUM(_FIELD('baseline_process_time'))} END AS b, CASE WHEN {_FIELD('new_process_time')} <> '' THEN {_NUM(_FIELD('new_process_time'))} END AS n,
        CASE WHEN {_FIELD('eng')} <> '' THEN {_NUM(_FIELD('eng'))} END AS e, {_MULT(260)} AS q FROM timed),
     per AS (SELECT *, CASE WHEN b IS NOT NULL AND n IS NOT NULL AND b > n THEN b - n ELSE coalesce(fm, 0) END AS p FROM local)
     SELECT id, CAST(b AS DOUBLE) AS baseline, CAST(n AS DOUBLE) AS new_time, CAST(round(p, 2) AS DOUBLE) AS savings_per_occ, CAST(round(p * coalesce(ff, 0) * q, 1) AS DOUBLE) AS annual_hours, CAST(round(e, 1) AS DOUBLE) AS effort, CAST(round(hours, 1) AS DOUBLE) AS saving_hours FROM per""", "ideas")
_roi = lambda v: v.table("lineitem").selectExpr("l_orderkey", "l_linenumber", "CAST(l_quantity AS DOUBLE) AS b", "CAST(l_linenumber * 3 AS DOUBLE) AS n", "CASE l_linenumber % 5 WHEN 0 THEN 'Daily' WHEN 1 THEN 'Weekly' WHEN 2 THEN 'Monthly' WHEN 3 THEN 'Yearly' ELSE 'Hourly' END AS freq", "CAST(l_partkey % 4 AS DOUBLE) AS effort")
_add("compute_roi", lambda v: _roi(v).select("l_orderkey", "l_linenumber", I.compute_roi(F.col("b"), F.col("n"), F.lit(1.5), F.col("freq"), F.col("effort")).alias("roi")),
     """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 4 = 0 THEN 0 ELSE round(CASE WHEN l_quantity <> 0 AND l_quantity > l_linenumber * 3 THEN CAST(l_quantity AS DOUBLE) - l_linenumber * 3 ELSE 0 END * 1.5
        * CASE l_linenumber % 5 WHEN 0 THEN 260 WHEN 1 THEN 52 WHEN 2 THEN 12 WHEN 3 THEN 1 ELSE 260 END / CAST(l_partkey % 4 AS DOUBLE), 2) END AS roi FROM lineitem""")
_add("rank_ideas", lambda v: I.rank_ideas(v.ideas).select("id", "status", "priority_rank", "priority_label"),
     f"SELECT id, status, priority_rank, {_LABEL} AS priority_label FROM (SELECT *, CAST(row_number() OVER (PARTITION BY status ORDER BY {_ORDER}) AS INT) AS priority_rank FROM ideas)", "ideas")
_add("rank_all_ideas", lambda v: I.rank_all(v.ideas).select("id", "priority_rank"), f"SELECT id, row_number() OVER (ORDER BY {_ORDER}) AS priority_rank FROM ideas", "ideas")
for _name, _day in (("engineer_queue", AS_OF), ("engineer_queue_weekend", WEEKEND)):
    _add(_name, lambda v, d=_day: I.engineer_queue(v.ideas, d).select("id", "assigned_engineer", "priority_rank", "sprint_start", "sprint_end"),
         f""", {_workdays(_day)}, q AS (SELECT id, assigned_engineer, CAST(row_number() OVER (PARTITION BY assigned_engineer ORDER BY {_ORDER}) AS INT) AS priority_rank FROM ideas WHERE status IN {_ACTIVE} AND assigned_engineer <> '')
         SELECT id, assigned_engineer, priority_rank, s.d AS sprint_start, e.d AS sprint_end FROM q JOIN workdays s ON s.k = 9 * (priority_rank - 1) JOIN workdays e ON e.k = 9 * priority_rank""", "ideas")
_SLOT = f"""requests AS (SELECT id, assigned_engineer, category, roi, created_date FROM ideas WHERE status = 'Assigned'),
slots AS (SELECT r.id, r.assigned_engineer, r.category, r.roi, CAST(1 + count(CASE WHEN o.id <> r.id AND ({_RANK.replace('category', 'o.category')}, -coalesce(o.roi, 0), o.created_date, o.id) < ({_RANK.replace('category', 'r.category')}, -coalesce(r.roi, 0), r.created_date, r.id) THEN 1 END) AS INT) AS priority_rank
  FROM requests r LEFT JOIN (SELECT * FROM ideas WHERE status IN {_ACTIVE}) o ON o.assigned_engineer = r.assigned_engineer GROUP BY r.id, r.assigned_engineer, r.category, r.roi)"""
_add("compute_delivery", lambda v: I.compute_delivery(v.ideas, v.ideas.filter("status = 'Assigned'"), AS_OF),
     f""", {_workdays(AS_OF)}, {_SLOT} SELECT id, assigned_engineer, priority_rank, s.d AS sprint_start, e.d AS sprint_end, {_LABEL} AS priority_label FROM slots JOIN workdays s ON s.k = 9 * (priority_rank - 1) JOIN workdays e ON e.k = 9 * priority_rank""", "ideas")
def _json_read(df):
    """The submitted JSON by field."""
    read = lambda k: F.get_json_object("feasibility_data", f"$.{k}")
    out = df.withColumns({f"json_{k}": read(k).try_cast("double") for k in _JSON} | {"json_freq": read("freq"), "json_fields": F.size(F.json_object_keys("feasibility_data"))})
    return out.drop("feasibility_data")


_JSON = {"baseline_process_time": 8, "new_process_time": 2, "fte": 1, "eng": 4}
_add("feasibility_submit", lambda v: _json_read(I.feasibility_submit(v.ideas, v.ideas.filter("status = 'Assigned'").selectExpr("id", "CAST(8 AS DOUBLE) AS baseline", "CAST(2 AS DOUBLE) AS new_time", "CAST(1 AS DOUBLE) AS fte", "CAST(4 AS DOUBLE) AS effort", "'Weekly' AS freq"), AS_OF)),
     f""", {_workdays(AS_OF)}, {_SLOT.replace('category, roi, created_date FROM', 'category, CAST(78 AS DOUBLE) AS roi, created_date FROM')}
     SELECT id, 'WIP' AS status, CAST(78 AS DOUBLE) AS roi, {', '.join(f'CAST({x} AS DOUBLE) AS json_{k}' for k, x in _JSON.items())}, 'Weekly' AS json_freq, 5 AS json_fields, '2024-03-08' AS vsm_meeting_date, {_LABEL} AS priority_label, s.d AS sprint_start, e.d AS sprint_end, e.d AS delivery_date FROM slots JOIN workdays s ON s.k = 9 * (priority_rank - 1) JOIN workdays e ON e.k = 9 * priority_rank""", "ideas")
_add("decision_apply", lambda v: I.decision_apply(v.ideas, v.ideas.filter("status = 'UAT'").selectExpr("id", "CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'GO' ELSE 'NO-GO' END AS decision", "'Business Rejection' AS reason"), WEEKEND),
     "SELECT id, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'WIP' ELSE 'Rejected' END AS status, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN '2024-03-11' END AS sprint_start, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN '2024-03-22' END AS sprint_end, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN '' ELSE 'Business Rejection' END AS rejection_reason FROM ideas WHERE status = 'UAT'", "ideas")
_MOVES = "SELECT id, CASE CAST(id AS BIGINT) % 4 WHEN 0 THEN 'Completed' WHEN 1 THEN 'Hold/Park' WHEN 2 THEN 'Hold/Park' ELSE 'UAT' END AS new_status, CASE WHEN CAST(id AS BIGINT) % 4 = 2 THEN ' ' ELSE 'waiting' END AS reason FROM ideas"
_add("status_move", lambda v: I.status_move(v.ideas.selectExpr(*[x.strip() for x in ("id", "CASE CAST(id AS BIGINT) % 4 WHEN 0 THEN 'Completed' WHEN 1 THEN 'Hold/Park' WHEN 2 THEN 'Hold/Park' ELSE 'UAT' END AS new_status", "CASE WHEN CAST(id AS BIGINT) % 4 = 2 THEN ' ' ELSE 'waiting' END AS reason")]), "2024-03-07 09:00"),
     f", m AS ({_MOVES}) SELECT id, new_status, CASE new_status WHEN 'Completed' THEN '2024-03-07 09:00' END AS completion_date, CASE new_status WHEN 'Hold/Park' THEN trim(reason) ELSE '' END AS hold_reason, new_status <> 'Hold/Park' OR trim(reason) <> '' AS valid FROM m", "ideas")
_add("approval_queue", lambda v: I.approval_queue(v.ideas, "pl3@CORP.example").select("id", "priority_rank"), f"SELECT id, CAST(row_number() OVER (ORDER BY {_ORDER}) AS INT) AS priority_rank FROM ideas WHERE status = 'WIP' AND lower(pl_name) = 'pl3@corp.example'", "ideas")
_add("idea_master_lookup", lambda v: I.master_lookup(v.ideas, v.otp_list),
     "SELECT i.id, i.otp, coalesce(project_name, '') AS project_name, coalesce(m.business_unit, '') AS business_unit, coalesce(pd, '') AS pd_name, coalesce(m.spl_pl, '') AS spl_pl FROM ideas i LEFT JOIN otp_list m ON i.otp = m.otp", "ideas", "otp_list")
_add("tools_with_idea", lambda v: I.tools_with_idea(v.deployed_tools, v.ideas),
     "SELECT t.id, tool_name, t.idea_id, CASE WHEN t.idea_id = '' THEN '-' ELSE coalesce(i.idea_name, '(idea not found)') END AS idea_name FROM deployed_tools t LEFT JOIN ideas i ON t.idea_id = i.id AND i.status = 'Completed'", "ideas", "deployed_tools")
_add("engineers_left_counts", lambda v: D.engineer_load(v.users, v.ideas).select("email", "tasks"), f"SELECT u.email, count(i.id) AS tasks FROM users u LEFT JOIN ideas i ON u.email = i.assigned_engineer AND i.status IN {_ACTIVE} WHERE role = 'automation engineer' GROUP BY u.email", "ideas", "users")
_add("engineer_load", lambda v: D.engineer_load(v.users, v.ideas),
     f"SELECT email, tasks, CAST(least(tasks * 10.0, 100) AS DOUBLE) AS load, CASE WHEN tasks < 4 THEN 'green' WHEN tasks * 10 < 75 THEN 'amber' ELSE 'red' END AS band FROM (SELECT u.email, count(i.id) AS tasks FROM users u LEFT JOIN ideas i ON u.email = i.assigned_engineer AND i.status IN {_ACTIVE} WHERE role = 'automation engineer' GROUP BY u.email)", "ideas", "users")
_add("latest_state", lambda v: I.latest_state(v.ideas, v.patches, ("status", "assigned_engineer", "roi")),
     ", rows AS (SELECT id, 0 AS seq, status, assigned_engineer, roi FROM ideas UNION ALL SELECT id, seq, status, assigned_engineer, roi FROM patches) SELECT id, arg_max(status, seq) FILTER (status IS NOT NULL) AS status, arg_max(assigned_engineer, seq) FILTER (assigned_engineer IS NOT NULL) AS assigned_engineer, arg_max(roi, seq) FILTER (roi IS NOT NULL) AS roi FROM rows GROUP BY id", "ideas", "patches")
_add("upsert_last_wins", lambda v: I.upsert_last_wins(v.otp_batch, "otp", "seq"), "SELECT otp, project_name, business_unit, pd, spl_pl FROM (SELECT *, row_number() OVER (PARTITION BY otp ORDER BY seq DESC) AS k FROM otp_batch) WHERE k = 1", "otp_batch")
#: Changes of users: each supplier's lead in other letters, first to one role and then to another; orders' engineers go, but those whose last order is even come back; new users.
_CHANGES = """SELECT 'pL' || CAST(s_suppkey AS STRING) || '@CORP.example' AS email, 1 AS seq, false AS deleted, 'super user' AS role FROM supplier
UNION ALL SELECT 'PL' || CAST(s_suppkey AS STRING) || '@corp.example', 2, false, 'normal user' FROM supplier
UNION ALL SELECT ' Eng' || CAST(o_custkey AS STRING) || '@corp.example', 10 + o_orderkey, o_orderkey % 2 = 1, 'back' || CAST(o_orderkey % 3 AS STRING) FROM orders
UNION ALL SELECT 'new' || CAST(r_regionkey AS STRING) || '@corp.example', 3, false, 'super user' FROM region"""


def _changed_users(v):
    for t in ("supplier", "orders", "region"):
        v.table(t).createOrReplaceTempView(t)
    return I.upsert_users(v.users, v.spark.sql(_CHANGES))


_add("upsert_users", _changed_users, f""", log AS (SELECT lower(email) AS email, 0 AS seq, false AS deleted, role FROM users UNION ALL SELECT lower(trim(email)), seq, deleted, role FROM ({_CHANGES}))
     SELECT email, role FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY seq DESC, deleted DESC, role DESC) AS k FROM log) WHERE k = 1 AND NOT deleted""", "users")
_add("parent_child_self_join", lambda v: I.children(v.ideas).select("id", "child_id", "child_status"), "SELECT p.id, c.id AS child_id, c.status AS child_status FROM ideas p JOIN ideas c ON c.parent_id = p.id WHERE c.parent_id <> ''", "ideas")
_add("parent_rollup", lambda v: I.parent_rollup(v.ideas), _HOURS + f"SELECT p.id, count(*) AS children, CAST(round(count(CASE WHEN c.status = 'Completed' THEN 1 END) * 100.0 / count(*), 1) AS DOUBLE) AS completion, {_DEC('c.r')} AS roi, {_DEC('c.hours')} AS hours FROM ideas p JOIN timed c ON c.parent_id = p.id GROUP BY p.id", "ideas")
_add("kanban_layout", lambda v: I.kanban_layout(v.ideas), "SELECT c.id, c.status, CASE WHEN p.id IS NULL THEN 0 ELSE 1 END AS depth, coalesce(p.idea_name, '') AS parent_name FROM ideas c LEFT JOIN ideas p ON c.parent_id = p.id AND c.status = p.status AND c.parent_id <> ''", "ideas")
_add("nestable_cards", lambda v: I.nestable_cards(v.ideas), "SELECT id, status FROM ideas i WHERE NOT EXISTS (SELECT 1 FROM ideas c WHERE c.parent_id = i.id AND c.status = i.status) AND (SELECT count(*) FROM ideas x WHERE x.status = i.status) > 1", "ideas")
_add("eligible_parents", lambda v: I.eligible_parents(v.ideas, ("1", "2", "4")), "SELECT r.id, p.id AS parent_id FROM (VALUES ('1'), ('2'), ('4')) r(id) JOIN ideas p ON p.parent_id = '' AND p.id <> r.id", "ideas")
_add("eligible_parent_counts", lambda v: I.eligible_parent_counts(v.ideas, v.ideas), "SELECT id, (SELECT count(*) FROM ideas WHERE parent_id = '') - CASE WHEN parent_id = '' THEN 1 ELSE 0 END AS n_parents FROM ideas", "ideas")
_add("meeting_schedule", lambda v: I.meeting_schedule(v.ideas),
     """, people AS (SELECT *, array_to_string(list_filter([submitter_email, assigned_engineer, pl_name], lambda a: a <> ''), ',') AS recipients FROM ideas)
     SELECT id, 'vsm' AS kind, vsm_meeting_date AS date, '10:00' AS time, recipients FROM people WHERE vsm_meeting_date <> '' UNION ALL SELECT id, 'delivery', delivery_date, '15:00', recipients FROM people WHERE delivery_date <> ''""", "ideas")

_add("dashboard_filter", lambda v: D.dashboard_filter(v.ideas, ("Internal",), ("PL1@corp.example", "PL2@corp.example"), ("ASIA", "EUROPE")).select("id"), "SELECT id FROM ideas WHERE category = 'Internal' AND pl_name IN ('PL1@corp.example', 'PL2@corp.example') AND region IN ('ASIA', 'EUROPE')", "ideas")
_add("filter_options", lambda v: with_position(D.filter_options(v.ideas, "region")), "SELECT value, row_number() OVER (ORDER BY value) AS position FROM (SELECT DISTINCT region AS value FROM ideas WHERE coalesce(region, '') <> '')", "ideas")
_add("table_search", lambda v: D.table_search(v.ideas, "idea 1[0-9]+3$|building").select("id"),
     "SELECT id FROM ideas WHERE " + " OR ".join(f"coalesce(regexp_matches(CAST({c} AS VARCHAR), '(?i)idea 1[0-9]+3$|building'), FALSE)" for c in "id name submitter_email idea_name project category automation_category pl_name status roi assigned_engineer feasibility_data rejection_reason customer region parent_id otp created_date vsm_meeting_date delivery_date".split()), "ideas")
_add("tool_search", lambda v: D.literal_search(v.deployed_tools, "1HANDLES", ("tool_name", "description", "project")).select("id"), "SELECT id FROM deployed_tools WHERE contains(lower(tool_name || description || project), '1handles')", "deployed_tools")
_add("rename_for_display", lambda v: D.rename_for_display(v.otp_list, {"otp": "OTP", "project_name": "Project Name", "pd": "PD", "owner": "Owner"}), "SELECT coalesce(otp, '') AS \"OTP\", coalesce(project_name, '') AS \"Project Name\", coalesce(pd, '') AS \"PD\", '' AS \"Owner\" FROM otp_list", "otp_list")
def _kpi_within(v):
    """Whether the approximate number of projects lies within 5 % of the exact one, or 1 of it."""
    both = D.kpi_totals(v.ideas).select("total", "projects").crossJoin(D.kpi_totals(v.ideas, approximate=True).select(F.col("projects").alias("about")))  # one row each
    return both.select("total", "projects", (F.abs(F.col("about") - F.col("projects")) <= F.greatest(F.lit(1.0), 0.05 * F.col("projects"))).alias("within"))


_add("kpi_totals_approximate", _kpi_within, "SELECT count(*) AS total, count(DISTINCT nullif(project, '')) AS projects, true AS within FROM ideas", "ideas")
_add("kpi_totals", lambda v: D.kpi_totals(v.ideas),
     _HOURS + f"""SELECT count(*) AS total, count(CASE WHEN status = 'Completed' THEN 1 END) AS completed, round({_DEC("CASE WHEN category = 'Customer Requirement' THEN hours END")}, 1) AS hours_customer, round({_DEC("CASE WHEN category = 'Internal' THEN hours END")}, 1) AS hours_internal,
     round({_DEC("CASE WHEN category = 'Customer Requirement' THEN r END")}, 2) AS roi_customer, round({_DEC("CASE WHEN category = 'Internal' THEN r END")}, 2) AS roi_internal,
     count(CASE WHEN automation_category LIKE 'Automation-%' THEN 1 END) AS n_automation, count(CASE WHEN automation_category LIKE 'AI-%' THEN 1 END) AS n_ai, round({_DEC("CASE WHEN automation_category LIKE 'Automation-%' THEN r END")}, 2) AS roi_automation, round({_DEC("CASE WHEN automation_category LIKE 'AI-%' THEN r END")}, 2) AS roi_ai,
     count(DISTINCT nullif(project, '')) AS projects, CAST(round(count(CASE WHEN status = 'Completed' THEN 1 END) * 100.0 / count(*), 1) AS DOUBLE) AS completed_percent FROM timed""", "ideas")
_STATUSES = "(VALUES ('New Idea', 0), ('Assigned', 1), ('WIP', 2), ('UAT', 3), ('Completed', 4), ('Hold/Park', 5), ('Rejected', 6)) s(status, ord)"
_add("status_counts", lambda v: D.status_counts(v.ideas), f"SELECT s.status, ord, count(i.id) AS n FROM {_STATUSES} LEFT JOIN ideas i ON s.status = i.status GROUP BY s.status, ord", "ideas")
_add("status_share", lambda v: D.status_share(v.ideas), "SELECT status, count(*) AS n, CAST(round(count(*) * 100.0 / (SELECT count(*) FROM ideas), 2) AS DOUBLE) AS share FROM ideas GROUP BY status", "ideas")
_add("category_status_counts", lambda v: D.category_status_counts(v.ideas), "SELECT category, sum(CASE status WHEN 'New Idea' THEN 1 ELSE 0 END)::BIGINT AS new_idea, sum(CASE status WHEN 'Assigned' THEN 1 ELSE 0 END)::BIGINT AS assigned, sum(CASE WHEN status IN ('WIP', 'UAT') THEN 1 ELSE 0 END)::BIGINT AS in_progress, sum(CASE status WHEN 'Completed' THEN 1 ELSE 0 END)::BIGINT AS completed, sum(CASE status WHEN 'Hold/Park' THEN 1 ELSE 0 END)::BIGINT AS hold, sum(CASE status WHEN 'Rejected' THEN 1 ELSE 0 END)::BIGINT AS rejected FROM ideas GROUP BY category", "ideas")
_add("category_automation_matrix", lambda v: D.counts_by(v.ideas, "category", "automation_category"), "SELECT category, automation_category, count(*) AS n FROM ideas GROUP BY ALL", "ideas")
_PANEL = ", ".join(f"('{c}')" for c in (*AUTOMATION, *AI))
_add("automation_category_panel", lambda v: D.automation_category_panel(v.ideas),
     _HOURS + f"""SELECT c.automation_category, count(t.id) AS total, count(CASE WHEN status = 'Completed' THEN 1 END) AS completed, count(CASE WHEN status = 'WIP' THEN 1 END) AS wip, count(CASE WHEN status = 'UAT' THEN 1 END) AS uat, round({_DEC('hours')}, 1) AS hours, round({_DEC('r')}, 2) AS roi,
     CASE WHEN count(t.id) = 0 THEN 0 ELSE CAST(round(count(CASE WHEN status = 'Completed' THEN 1 END) * 100.0 / count(t.id), 1) AS DOUBLE) END AS success FROM (VALUES {_PANEL}) c(automation_category) LEFT JOIN timed t ON c.automation_category = t.automation_category GROUP BY c.automation_category""", "ideas")
_add("automation_family_totals", lambda v: D.automation_family_totals(v.ideas), _HOURS + f"SELECT split_part(automation_category, '-', 1) AS family, count(*) AS total, count(CASE WHEN status = 'Completed' THEN 1 END) AS done, count(CASE WHEN status = 'WIP' THEN 1 END) AS wip, round({_DEC('r')}, 2) AS roi FROM timed WHERE automation_category <> '' GROUP BY 1", "ideas")
_add("hours_roi_by_category", lambda v: D.hours_roi_by_category(v.ideas), _HOURS + f"SELECT category, round({_DEC('hours')}, 1) AS hours, round({_DEC('r')}, 2) AS roi FROM timed GROUP BY category", "ideas")
_add("project_counts", lambda v: D.project_counts(v.ideas), "SELECT project, count(*) AS n FROM ideas WHERE project <> '' GROUP BY project", "ideas")
_add("project_hours", lambda v: D.project_hours(v.ideas), _HOURS + f"SELECT project, round({_DEC('hours')}, 1) AS hours FROM timed WHERE project <> '' AND hours > 0 GROUP BY project", "ideas")
_add("customer_totals", lambda v: D.customer_totals(v.ideas), _HOURS + f"SELECT CASE WHEN coalesce(customer, '') = '' THEN 'Unknown' ELSE customer END AS customer, count(*) AS n, round({_DEC('r')}, 2) AS roi FROM timed GROUP BY 1", "ideas")
_CP = "SELECT customer, CASE WHEN project = '' THEN 'Unassigned' ELSE project END AS project, count(*) AS n, 0 AS level FROM ideas GROUP BY ALL"
_add("customer_project_rollup", lambda v: D.customer_project_rollup(v.ideas), f"{_CP} UNION ALL SELECT customer, NULL, count(*), 1 FROM ideas GROUP BY customer", "ideas")
_add("top_n_per_group", lambda v: D.top_n_per_group(D.customer_project_rollup(v.ideas).filter("level = 0"), "customer", "project", 2).select("customer", "project", "n", "rank"), f", c AS ({_CP}) SELECT customer, project, n, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY n DESC, project) AS k FROM c) WHERE k <= 2", "ideas")
_REGIONS = f", tidy AS (SELECT *, CASE WHEN trim(coalesce(region, '')) = '' THEN '(blank)' ELSE upper(trim(region)) END AS rg FROM timed), totals AS (SELECT coalesce(f.region, t.rg) AS region, coalesce(n, 0) AS n, coalesce(roi, 0) AS roi FROM (VALUES ('ASIA'), ('EUROPE'), ('AFRICA'), ('AMERICA'), ('(blank)')) f(region) FULL JOIN (SELECT rg, count(*) AS n, round({_DEC('r')}, 2) AS roi FROM tidy GROUP BY rg) t ON f.region = t.rg) "
_add("region_totals", lambda v: D.region_totals(v.ideas), _HOURS + _REGIONS + "SELECT * FROM totals", "ideas")
_add("region_intensity", lambda v: D.region_intensity(D.region_totals(v.ideas)), _HOURS + _REGIONS + "SELECT region, n, CAST(CASE WHEN n = 0 THEN 60 ELSE 90 + round(n * 70.0 / (SELECT max(n) FROM totals WHERE region <> '(blank)')) END AS INT) AS size FROM totals WHERE region <> '(blank)'", "ideas")
_FUNNEL = {"ideation": "TRUE", "queued": "status IN ('New Idea', 'Assigned', 'Hold/Park')", "accepted": "status IN ('WIP', 'UAT', 'Completed')", "rejected": "status = 'Rejected'"}
for _n, _k in (("customer", "Customer Requirement"), ("internal", "Internal")):
    _FUNNEL |= {f"accepted/{_n}": f"category = '{_k}' AND status IN ('WIP', 'UAT', 'Completed')", f"accepted/{_n}/wip": f"category = '{_k}' AND status IN ('WIP', 'UAT')", f"accepted/{_n}/deployed": f"category = '{_k}' AND status = 'Completed'"}
_FUNNEL |= {f"rejected/{_r}": f"status = 'Rejected' AND rejection_reason = '{_r}'" for _r in ("Technical Rejection", "Business Rejection")}
_add("funnel_tree", lambda v: D.funnel_tree(v.ideas), " UNION ALL ".join(f"SELECT '{p}' AS path, count(*) AS n FROM ideas WHERE {w}" for p, w in _FUNNEL.items()), "ideas")
_add("registered_users", lambda v: D.registered_users(v.users), "SELECT role, count(*) AS n FROM users GROUP BY role", "users")
