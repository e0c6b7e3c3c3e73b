"""Dashboards over ideas: filters, counters, roll-ups and searches. Group keys have few values, combined before any shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import blank_to_empty
from tallyspark.operators.constants import ACTIVE, AI, AUTOMATION, CUSTOMER, INTERNAL, REGIONS, REJECTIONS, STATUSES
from tallyspark.operators.ideas import idea_hours


def roi() -> Column:
    return F.coalesce("roi", F.lit(0.0)).cast("decimal(18,4)")


def hours() -> Column:
    return idea_hours(F.col("feasibility_data")).cast("decimal(18,4)")


def total(value: Column, places: int | None = None) -> Column:
    """A sum that doesn't depend on order, 0 if nothing is summed."""
    s = F.coalesce(F.sum(value), F.lit(0)).cast("double")
    return s if places is None else F.round(s, places)


def dimension(df: DataFrame, name: str, values: tuple[str, ...]) -> DataFrame:
    """A table of fixed values in their order."""
    return df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)], f"{name} string, ord int")


def dashboard_filter(ideas: DataFrame, categories: tuple[str, ...] = (), leads: tuple[str, ...] = (), regions: tuple[str, ...] = ()) -> DataFrame:
    """Ideas that pass all given lists; an empty list passes all."""
    for c, chosen in (("category", categories), ("pl_name", leads), ("region", regions)):
        ideas = ideas.filter(F.col(c).isin(*chosen)) if chosen else ideas
    return ideas


def filter_options(df: DataFrame, column: str) -> DataFrame:
    """Sorted different values of a column but blanks."""
    return df.select(F.col(column).alias("value")).filter(blank_to_empty(F.col("value")) != "").distinct().orderBy("value")


def table_search(df: DataFrame, pattern: str) -> DataFrame:
    """Rows of which some column, as text, matches a pattern in any case."""
    return df.filter(reduce(lambda a, b: a | b, [F.coalesce(F.col(c).cast("string").rlike("(?i)" + pattern), F.lit(False)) for c in df.columns]))


def literal_search(df: DataFrame, text: str, columns: tuple[str, ...], joint: str = "") -> DataFrame:
    """Rows whose columns, put together with ``joint`` between, hold the text in any case."""
    return df.filter(F.lower(F.concat_ws(joint, *[blank_to_empty(F.col(c)) for c in columns])).contains(text.lower()))


def extraction_search(df: DataFrame, text: str = "", columns: tuple[str, ...] = (), **equal: str) -> DataFrame:
    """Rows that equal each given value and hold the text."""
    for c, v in equal.items():
        df = df.filter(F.col(c) == v) if v else df
    return literal_search(df, text, columns, " ") if text else df


def rename_for_display(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under the names they are shown with, in that order; nulls and columns that are absent are blank."""
    return df.select(*[(blank_to_empty(F.col(f"`{c}`")) if c in df.columns else F.lit("")).alias(shown) for c, shown in names.items()])


def list_sorted(df: DataFrame, *keys: str, last: str | None = None) -> DataFrame:
    """Rows by keys, each rising, or falling with a minus before it; ties by ``last``."""
    order = [F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in keys]
    return df.orderBy(*order, *([F.asc(last)] if last else []))


def kpi_totals(ideas: DataFrame, approximate: bool = False) -> DataFrame:
    """All counters of the first row of the dashboard in one pass; ``approximate`` sketches the number of projects instead of collecting them."""
    different = F.approx_count_distinct if approximate else F.count_distinct
    done, cat, auto = F.col("status") == "Completed", F.col("category"), F.col("automation_category")
    rows = ideas.withColumn("h", hours()).withColumn("r", roi())
    when = lambda test, value: F.when(test, value)
    out = rows.agg(
        F.count("*").alias("total"), F.count_if(done).alias("completed"),
        *[total(when(cat == k, F.col("h")), 1).alias(f"hours_{n}") for n, k in (("customer", CUSTOMER), ("internal", INTERNAL))],
        *[total(when(cat == k, F.col("r")), 2).alias(f"roi_{n}") for n, k in (("customer", CUSTOMER), ("internal", INTERNAL))],
        *[F.count_if(auto.isin(*k)).alias(f"n_{n}") for n, k in (("automation", AUTOMATION), ("ai", AI))],
        *[total(when(auto.isin(*k), F.col("r")), 2).alias(f"roi_{n}") for n, k in (("automation", AUTOMATION), ("ai", AI))],
        different(F.when(F.col("project") != "", F.col("project"))).alias("projects"),
    )
    share = F.when(F.col("total") == 0, 0.0).otherwise(F.round(F.col("completed") * 100.0 / F.col("total"), 1).cast("double"))
    return out.withColumn("completed_percent", share)


def status_counts(ideas: DataFrame) -> DataFrame:
    """Ideas by status, every status kept."""
    n = ideas.groupBy("status").agg(F.count("*").alias("n"))
    return dimension(ideas, "status", STATUSES).join(n, "status", "left").select("status", "ord", F.coalesce("n", F.lit(0)).alias("n"))


def status_share(ideas: DataFrame) -> DataFrame:
    n = ideas.groupBy("status").agg(F.count("*").alias("n"))
    return n.select("status", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2).cast("double").alias("share"))


def category_status_counts(ideas: DataFrame) -> DataFrame:
    s = F.col("status")
    return ideas.groupBy("category").agg(F.count_if(s == "New Idea").alias("new_idea"), F.count_if(s == "Assigned").alias("assigned"), F.count_if(s.isin("WIP", "UAT")).alias("in_progress"), F.count_if(s == "Completed").alias("completed"), F.count_if(s == "Hold/Park").alias("hold"), F.count_if(s == "Rejected").alias("rejected"))


def counts_by(ideas: DataFrame, *keys: str) -> DataFrame:
    return ideas.groupBy(*keys).agg(F.count("*").alias("n"))


def automation_category_panel(ideas: DataFrame) -> DataFrame:
    """Counters by automation category, all of them kept; success is completed over all."""
    s = F.col("status")
    agg = ideas.withColumn("h", hours()).withColumn("r", roi()).groupBy("automation_category").agg(
        F.count("*").alias("total"), F.count_if(s == "Completed").alias("completed"), F.count_if(s == "WIP").alias("wip"), F.count_if(s == "UAT").alias("uat"), total(F.col("h"), 1).alias("hours"), total(F.col("r"), 2).alias("roi"))
    out = dimension(ideas, "automation_category", (*AUTOMATION, *AI)).join(agg, "automation_category", "left").fillna(0)
    return out.withColumn("success", F.when(F.col("total") == 0, 0.0).otherwise(F.round(F.col("completed") * 100.0 / F.col("total"), 1).cast("double"))).drop("ord")


def automation_family_totals(ideas: DataFrame) -> DataFrame:
    c, s = F.col("automation_category"), F.col("status")
    family = F.when(c.isin(*AUTOMATION), "Automation").when(c.isin(*AI), "AI")
    return ideas.withColumn("family", family).filter("family is not null").groupBy("family").agg(F.count("*").alias("total"), F.count_if(s == "Completed").alias("done"), F.count_if(s == "WIP").alias("wip"), total(roi(), 2).alias("roi"))


def hours_roi_by_category(ideas: DataFrame) -> DataFrame:
    return ideas.groupBy("category").agg(total(hours(), 1).alias("hours"), total(roi(), 2).alias("roi"))


def project_counts(ideas: DataFrame) -> DataFrame:
    return counts_by(ideas.filter(blank_to_empty(F.col("project")) != ""), "project")


def project_hours(ideas: DataFrame) -> DataFrame:
    """Yearly hours by project, of ideas with a project and some hours."""
    rows = ideas.withColumn("h", hours()).filter((blank_to_empty(F.col("project")) != "") & (F.col("h") > 0))
    return rows.groupBy("project").agg(total(F.col("h"), 1).alias("hours"))


def or_else(column: str, other: str) -> Column:
    return F.when(blank_to_empty(F.col(column)) == "", other).otherwise(F.col(column))


def customer_totals(ideas: DataFrame) -> DataFrame:
    return ideas.groupBy(or_else("customer", "Unknown").alias("customer")).agg(F.count("*").alias("n"), total(roi(), 2).alias("roi"))


def customer_project_rollup(ideas: DataFrame) -> DataFrame:
    """Counts by customer and project and by customer; level 1 is the customer's own row."""
    rows = ideas.select(or_else("customer", "Unknown").alias("customer"), or_else("project", "Unassigned").alias("project"))
    return rows.rollup("customer", "project").agg(F.count("*").alias("n"), F.grouping("project").cast("int").alias("level")).filter("customer is not null")


def top_n_per_group(counts: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """The ``n`` largest items of each group of a table of counts, ties by name."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), item))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= n)


def region_totals(ideas: DataFrame, regions: tuple[str, ...] = REGIONS) -> DataFrame:
    """Counts and return by trimmed upper-case region: given ones kept, blank ones apart as ``(blank)``."""
    name = F.upper(F.trim(blank_to_empty(F.col("region"))))
    agg = ideas.groupBy(F.when(name == "", "(blank)").otherwise(name).alias("region")).agg(F.count("*").alias("n"), total(roi(), 2).alias("roi"))
    fixed = dimension(ideas, "region", (*regions, "(blank)")).select("region")
    return fixed.join(agg, "region", "full_outer").select("region", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("roi", F.lit(0.0)).alias("roi"))


def region_intensity(regions: DataFrame) -> DataFrame:
    """Bubble size by share of the largest count; blanks don't count."""
    rows = regions.filter("region <> '(blank)'")
    top = F.max("n").over(Window.partitionBy())
    return rows.select("region", "n", F.when(F.col("n") == 0, 60).otherwise(90 + F.round(F.col("n") * 70.0 / top)).cast("int").alias("size"))


def funnel_tree(ideas: DataFrame) -> DataFrame:
    """(path, n) of the funnel's nodes, in one pass."""
    s, c, why = F.col("status"), F.col("category"), F.col("rejection_reason")
    moving = s.isin("WIP", "UAT")
    nodes = {"ideation": F.lit(True), "queued": s.isin("New Idea", "Assigned", "Hold/Park"), "accepted": s.isin("WIP", "UAT", "Completed"), "rejected": s == "Rejected"}
    for n, k in (("customer", CUSTOMER), ("internal", INTERNAL)):
        nodes |= {f"accepted/{n}": (c == k) & s.isin("WIP", "UAT", "Completed"), f"accepted/{n}/wip": (c == k) & moving, f"accepted/{n}/deployed": (c == k) & (s == "Completed")}
    nodes |= {f"rejected/{r}": (s == "Rejected") & (why == r) for r in REJECTIONS}
    one = ideas.agg(*[F.count_if(test).alias(f"n{i}") for i, test in enumerate(nodes.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.col(f"n{i}").alias("n")) for i, p in enumerate(nodes)])).alias("x")).select("x.*")


def engineer_load(users: DataFrame, ideas: DataFrame, full: int = 10) -> DataFrame:
    """Active tasks and load of every engineer, those without task included."""
    tasks = ideas.filter(F.col("status").isin(*ACTIVE)).groupBy(F.col("assigned_engineer").alias("email")).agg(F.count("*").alias("tasks"))
    out = users.filter("role = 'automation engineer'").select("email").join(tasks, "email", "left").fillna(0, ["tasks"])
    load = F.least(F.col("tasks") * 100.0 / full, F.lit(100.0)).cast("double")
    return out.select("email", "tasks", load.alias("load"), F.when(load < 40, "green").when(load < 75, "amber").otherwise("red").alias("band"))


def registered_users(users: DataFrame) -> DataFrame:
    return counts_by(users, "role")
