"""Logical inputs of the operational jobs, derived from the given tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.sources.scratch import stored

#: View -> SQL over the given tables and earlier views.
VIEWS: dict[str, str] = {
    "lines": """
SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS rn
FROM lineitem
""",
    "ideas": """
SELECT CAST(o.o_orderkey AS STRING) AS id,
       c.c_name AS name,
       'user' || CAST(o.o_custkey % 40 AS STRING) || '@corp.example' AS submitter_email,
       'Idea ' || CAST(o.o_orderkey AS STRING) AS idea_name,
       CASE WHEN o.o_orderkey % 9 = 0 THEN '' ELSE c.c_mktsegment END AS project,
       CASE WHEN o.o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'Customer Requirement'
            WHEN o.o_orderpriority IN ('3-MEDIUM','5-LOW') THEN 'Internal' ELSE '' END AS category,
       CASE CAST(floor(o.o_orderkey / 7.0) AS BIGINT) % 8
            WHEN 0 THEN 'Automation-Personal Productivity' WHEN 1 THEN 'Automation-Process Improvement'
            WHEN 2 THEN 'Automation-Defined Product and Sales' WHEN 3 THEN 'Automation-Quality Enhancement'
            WHEN 4 THEN 'AI-Personal Productivity' WHEN 5 THEN 'AI-Process Improvement'
            WHEN 6 THEN 'AI-Defined Product and Sales' ELSE '' END AS automation_category,
       'PL' || CAST(o.o_custkey % 11 AS STRING) || '@corp.example' AS pl_name,
       CASE o.o_orderkey % 7 WHEN 0 THEN 'New Idea' WHEN 1 THEN 'Assigned' WHEN 2 THEN 'WIP' WHEN 3 THEN 'UAT'
            WHEN 4 THEN 'Completed' WHEN 5 THEN 'Hold/Park' ELSE 'Rejected' END AS status,
       CASE WHEN o.o_orderkey % 13 = 0 THEN NULL WHEN o.o_orderkey % 13 = 1 THEN CAST(0 AS DOUBLE)
            ELSE CAST(floor(o.o_totalprice / 1000) AS DOUBLE) END AS roi,
       CASE WHEN o.o_orderkey % 7 = 0 THEN '' ELSE 'eng' || CAST(o.o_custkey AS STRING) || '@corp.example' END AS assigned_engineer,
       CASE o.o_orderkey % 6
            WHEN 0 THEN '{}'
            WHEN 1 THEN '{"manual":' || CAST(o.o_custkey % 9 AS STRING) || ',"fte":2,"eng":4,"freq":"Weekly"}'
            WHEN 2 THEN '{"baseline_process_time":' || CAST(5 + o.o_custkey % 4 AS STRING) || '.5,"new_process_time":1.25,"fte":1.5,"eng":8,"freq":"Daily"}'
            WHEN 3 THEN '{"baseline_process_time":1,"new_process_time":3,"manual":2,"fte":1,"eng":2,"freq":"Monthly"}'
            WHEN 4 THEN '{"baseline_process_time":"n/a","new_process_time":"","fte":"2","eng":"","freq":"Yearly"}'
            ELSE '{"baseline_process_time":4,"new_process_time":1,"fte":1,"eng":1,"freq":"Hourly"}' END AS feasibility_data,
       CASE WHEN o.o_orderkey % 7 <> 6 THEN '' WHEN o.o_custkey % 2 = 0 THEN 'Technical Rejection' ELSE 'Business Rejection' END AS rejection_reason,
       n.n_name AS customer,
       CASE o.o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' ' || lower(r.r_name) ELSE r.r_name END AS region,
       CASE WHEN o.o_orderkey % 4 = 1 THEN CAST(o.o_orderkey - 1 AS STRING)
            WHEN o.o_orderkey % 4 = 3 AND o.o_orderkey >= 7 THEN CAST(o.o_orderkey - 7 AS STRING) ELSE '' END AS parent_id,
       'OTP' || lpad(CAST(o.o_custkey AS STRING), 9, '0') AS otp,
       substr(CAST(o.o_orderdate AS STRING), 1, 16) AS created_date,
       CASE WHEN o.o_orderkey % 7 IN (2,3,4) THEN substr(CAST(o.o_orderdate AS STRING), 1, 10) ELSE '' END AS vsm_meeting_date,
       CASE WHEN o.o_orderkey % 7 IN (3,4) THEN substr(CAST(o.o_orderdate AS STRING), 1, 10) ELSE '' END AS delivery_date
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
     JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
""",
    "users": """
SELECT 'eng' || CAST(c_custkey AS STRING) || '@corp.example' AS email, 'automation engineer' AS role FROM customer
UNION ALL SELECT 'PL' || CAST(s_suppkey AS STRING) || '@corp.example', 'pl/spl' FROM supplier
""",
    "otp_list": """
SELECT 'OTP' || lpad(CAST(2 * p_partkey AS STRING), 9, '0') AS otp, p_name AS project_name, p_brand AS business_unit,
       p_type AS pd, 'PL' || CAST(p_partkey % 11 AS STRING) AS spl_pl
FROM part
""",
    "deployed_tools": """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(rn AS STRING) AS id,
       'Tool ' || CAST(l_partkey AS STRING) AS tool_name, 'Handles ' || l_returnflag || l_linestatus AS description,
       CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN CAST(l_orderkey AS STRING) ELSE 'gone-' || CAST(l_orderkey AS STRING) END AS idea_id,
       CASE l_suppkey % 2 WHEN 0 THEN 'Controls' ELSE '' END AS project,
       substr(CAST(l_shipdate AS STRING), 1, 16) AS created_date
FROM lines
""",
    "mails": """
SELECT event_id AS seq,
       'M' || CAST(event_id - CASE WHEN event_id % 10 = 9 THEN 1 ELSE 0 END AS STRING) AS entry_id,
       CASE WHEN event_id % 5 = 0 THEN 'Query about shipment' ELSE 'RE: PO 4' || lpad(CAST(event_id % 5000 AS STRING), 9, '0') || ' report' END AS subject,
       CASE user_id % 7 WHEN 0 THEN 'Desk@Vendor-A.example' WHEN 1 THEN 'qa@gbr.vendor-a.example' WHEN 2 THEN 'x@notvendor-a.example'
            WHEN 3 THEN 'shop@vendor-b.example' WHEN 4 THEN 'me@gmail.com' WHEN 5 THEN '/O=EXCH/CN=NOBODY' ELSE 'odd@name@vendor-b.example' END AS sender,
       ts AS received, event_type IN ('view','click') AS unread,
       CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'report.PDF' WHEN 2 THEN 'a.pdf;logo.png' ELSE 'logo.png' END AS attachments
FROM events
""",
    "processed": """
SELECT 'M' || CAST(event_id AS STRING) AS entry_id, 'user' || CAST(user_id % 5 AS STRING) AS downloaded_by, ts AS processed_at,
       CAST(event_id % 4 AS INT) AS file_count
FROM events WHERE event_type = 'purchase'
""",
    "dump": """
SELECT l_orderkey * 1000 + rn AS ord,
       '4' || lpad(CAST(l_orderkey AS STRING), 9, '0') AS rr_po_number,
       'BPU' || CAST(l_partkey AS STRING) || 'MK20' AS core_oem_part_number,
       'SN-' || CAST(l_suppkey AS STRING) || '/' || CAST(l_partkey AS STRING) AS core_serial_number,
       CAST(1 + CAST(l_quantity AS INT) AS STRING) || ',' || lpad(CAST(l_partkey % 1000 AS STRING), 3, '0') AS core_tsn,
       CAST(CAST(l_quantity AS INT) AS STRING) AS core_csn,
       'ESN' || CAST(10000 + l_suppkey AS STRING) AS engine_serial_number,
       CASE l_returnflag WHEN 'A' THEN 'Valve jammed and slow to move' WHEN 'N' THEN 'Leakage at the flange' ELSE 'Scheduled overhaul' END AS reason_for_removal,
       CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'N' || CAST(l_partkey % 900 AS STRING) END AS aircraft_tail_number
FROM lines
""",
    "extractions": """
SELECT l_orderkey AS report_id,
       CASE l_orderkey % 8 WHEN 4 THEN '4999' || lpad(CAST(l_orderkey AS STRING), 6, '0') WHEN 7 THEN ''
            ELSE '4' || lpad(CAST(l_orderkey AS STRING), 9, '0') END AS po,
       CASE l_suppkey % 3 WHEN 0 THEN 'Vendor A' WHEN 1 THEN 'Vendor B' ELSE 'Vendor C' END AS vendor,
       CASE WHEN l_orderkey % 8 = 1 THEN 'BPU' || CAST(l_partkey AS STRING) || 'MK2O' ELSE 'bpu ' || CAST(l_partkey AS STRING) || '-MK20' END AS input_part,
       'SN ' || CAST(l_suppkey AS STRING) || '-' || CAST(l_partkey AS STRING) AS input_serial,
       CASE WHEN l_orderkey % 8 = 2 THEN '' ELSE CAST((1 + CAST(l_quantity AS INT)) * 1000 + l_partkey % 1000 AS STRING) || '.0' END AS tsn,
       CASE WHEN l_orderkey % 8 = 3 THEN CAST(7 + CAST(l_quantity AS INT) AS STRING) ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS csn,
       CAST(10000 + l_suppkey AS STRING) AS esn,
       CASE WHEN l_orderkey % 8 = 6 THEN 'faulty'
            WHEN l_returnflag = 'A' THEN 'Unit removed: valve jammed, slow to move' WHEN l_returnflag = 'N' THEN 'leakage seen at flange' ELSE 'scheduled overhaul' END AS reason_for_removal,
       CASE WHEN l_orderkey % 8 = 5 THEN 'G-XXXX' ELSE 'N' || CAST(l_partkey % 900 AS STRING) END AS tail_no,
       CASE l_orderkey % 4 WHEN 0 THEN 'Strip and test of valve and flange done on bench' WHEN 1 THEN 'strip' WHEN 2 THEN '' ELSE 'Cleaned housing, replaced seals, retested' END AS actions_taken,
       CASE l_orderkey % 5 WHEN 0 THEN 'Valve seized due to corrosion' WHEN 1 THEN '' WHEN 2 THEN 'worn' WHEN 3 THEN 'Flange leakage confirmed' ELSE 'Unit within limits' END AS findings,
       CASE l_orderkey % 3 WHEN 0 THEN 'Fault confirmed' WHEN 1 THEN 'No fault found' ELSE '' END AS fault_outcome,
       CASE WHEN l_orderkey % 2 = 0 THEN '12.03.2024' ELSE '' END AS failure_date
FROM lines WHERE rn = 2
""",
    "report_text": """
SELECT report_id,
       CASE report_id % 6 WHEN 5 THEN 'Unknown Maker Note' ELSE upper(vendor) || ' - STRIP REPORT' END
       || chr(10) || 'Cust PO   ' || po || CASE vendor WHEN 'Vendor B' THEN '   Part No In   ' ELSE '   Input Part   ' END || input_part
       || chr(10) || 'Input Serial: ' || input_serial || '   Qty   1.000'
       || chr(10) || 'Serial #   CSN   TSN   CSO' || chr(10) || 'INF   ' || csn || '   ' || tsn || '   0'
       || chr(10) || 'ESN: ESN' || esn || '   Failure Date: ' || failure_date
       || chr(10) || 'Reason For Removal: ' || reason_for_removal
       || chr(10) || 'Actions Taken: ' || actions_taken
       || chr(10) || 'Findings: ' || findings || chr(10) || CASE vendor WHEN 'Vendor C' THEN 'Outcome: ' ELSE 'Conclusion: ' END || fault_outcome AS text
FROM extractions
""",
    "vendor_table": """
SELECT s_name AS vendor, lower(replace(n_name, ' ', '-')) || CAST(s_suppkey % 9 AS STRING) || '.example' AS domain FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT s_name, 'mail' || CAST(s_suppkey % 5 AS STRING) || '.example' FROM supplier
""",
    "chosen_vendors": """
SELECT s_name AS vendor FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT c_name FROM customer
""",
    "activity": """
SELECT event_id AS seq, ts, CASE event_type WHEN 'view' THEN 'SAVED-MSG' WHEN 'click' THEN 'SAVED-ATT' WHEN 'purchase' THEN 'COMPLETED' WHEN 'signup' THEN 'SKIP-NOPO' ELSE 'EXTRACTED' END AS event,
       'M' || CAST(event_id AS STRING) AS entry_id, 'user' || CAST(user_id % 5 AS STRING) AS done_by, user_id
FROM events
""",
    "otp_batch": """
SELECT otp, project_name, business_unit, pd, spl_pl, 1 AS seq FROM otp_list
UNION ALL
SELECT 'OTP' || lpad(CAST(3 * p_partkey AS STRING), 9, '0'), 'New ' || p_name, p_brand, p_type, 'PL0', 2 FROM part
""",
    "patches": """
SELECT id, 1 AS seq, 'WIP' AS status, CAST(NULL AS STRING) AS assigned_engineer, CAST(NULL AS DOUBLE) AS roi FROM ideas WHERE status <> 'Rejected'
UNION ALL
SELECT id, 2, CAST(NULL AS STRING), 'eng1@corp.example', CAST(7 AS DOUBLE) FROM ideas WHERE status IN ('Assigned', 'WIP', 'UAT')
UNION ALL
SELECT id, 3, 'UAT', CAST(NULL AS STRING), CAST(NULL AS DOUBLE) FROM ideas WHERE status IN ('UAT', 'Completed', 'Rejected')
""",
}
_NEEDS = {"ideas": (), "otp_batch": ("otp_list",), "patches": ("ideas",), "deployed_tools": ("lines",), "dump": ("lines",), "extractions": ("lines",), "report_text": ("lines", "extractions")}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def with_position(ordered: DataFrame) -> DataFrame:
    """Rows of a sorted frame with their place, 1..n, taken from the order in which the sort gives them.

    Rows are numbered within their partition as they are written; a table of a row by partition says how many stand before it.
    """
    dealt = stored(ordered.withColumn("_m", F.monotonically_increasing_id()), "ordered")
    part, within = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return dealt.withColumn("_p", part).join(before, "_p").withColumn("position", F.col("_before") + within + 1).drop("_m", "_p", "_before")


def with_clause(*names: str) -> str:
    """WITH clause that defines the views and what they are made from."""
    needed = [n for name in names for n in (*_NEEDS.get(name, ()), name)]
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in dict.fromkeys(needed)) + "\n"


class Inputs:
    """The views over one folder of tables, as DataFrames by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _numbered_lines(self) -> str:
        """Name of a view over ``lines`` in a table of the shared folder: several inputs read it, and its window is worked out once. It has the columns that a view over it names."""
        rows = self.spark.sql(with_clause("lines") + "SELECT * FROM lines")
        asked = set(re.findall(r"\w+", " ".join(VIEWS[n] for n, needs in _NEEDS.items() if "lines" in needs)))
        rows = stored(rows.select(*[c for c in rows.columns if c in asked]), "lines")
        name = f"lines_{uuid.uuid4().hex}"
        rows.createOrReplaceTempView(name)
        return name

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        return self._view(name)

    def dealt(self, name: str) -> DataFrame:
        """A view over reports, made from lines that are dealt over as many tasks as a shuffle has: files are read by tasks too large for what costs much by row."""
        parts = self.spark.conf.get("spark.sql.shuffle.partitions")
        return self._view(name, f"/*+ REPARTITION({parts}, l_orderkey) */", " WHERE rn = 2")

    def _view(self, name: str, hint: str = "", rows: str = "") -> DataFrame:
        for t in _TABLES:
            self.table(t).createOrReplaceTempView(t)
        query = with_clause(name) + f"SELECT * FROM {name}"
        if "lines" in (name, *_NEEDS.get(name, ())):
            query = query.replace(VIEWS["lines"].strip(), f"SELECT {hint} * FROM {self._numbered_lines}{rows}")
        return self.spark.sql(query)
