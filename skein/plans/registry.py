"""The registry of queries, and the domain tables in SQL for their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.sources.domain import Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The domain tables in DuckDB's words; a query names those it needs.
TABLES = {
    "jobs": """SELECT o_orderkey AS job_id, c_name AS job_name, 'Account ' || o_custkey AS account_name, o_orderpriority AS salesperson, n_name AS city,
        c_mktsegment AS process_name, o_orderstatus AS job_status_name, CAST(o_orderdate AS DATE) AS creation_date
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "lines": """SELECT l_orderkey AS job_id, l_suppkey AS crew_id, l_partkey, l_suppkey, l_linestatus AS status_name,
        CASE l_partkey % 5 WHEN 0 THEN 'Quote' WHEN 1 THEN 'Measure' WHEN 2 THEN 'Template' WHEN 3 THEN 'Follow Up'
             ELSE CASE l_suppkey % 3 WHEN 0 THEN 'Install' WHEN 1 THEN 'Invoice' ELSE 'Repair' END END AS type_name, CASE WHEN l_linenumber % 4 = 0 THEN 'Phase ' || l_linenumber END AS phase,
        CASE WHEN l_returnflag <> 'A' THEN CAST(l_shipdate AS DATE) END AS activity_date,
        CASE WHEN l_partkey % 97 = 0 THEN 'Payment received — invoice #' || l_orderkey
             WHEN l_partkey % 89 = 0 THEN 'check-bot: order ' || l_orderkey || ' paid'
             WHEN l_partkey % 7 = 0 THEN 'invoice ' || l_orderkey || ' for $ ' || l_partkey || ' on ' || strftime(l_shipdate, '%Y-%m-%d') || ', see # ' || (l_orderkey + 1) || '.'
             WHEN l_partkey % 11 = 0 THEN '' WHEN l_partkey % 13 <> 0 THEN 'Spoke with the client about part ' || l_partkey || '/' || l_suppkey END AS notes,
        l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS activity_id
        FROM lineitem""",
    "areas": """SELECT l_orderkey AS job_id, 'Area ' || l_linenumber AS area_name, l_quantity AS sq_ft, p_type AS room_type, p_name AS material_name, s_name AS supplier, p_brand AS edge,
        CASE WHEN p_size % 2 = 0 THEN p_size || ' in' END AS backsplash, CASE WHEN p_size % 3 <> 0 THEN 'sink ' || p_size END AS sink
        FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey""",
    "invoices": """SELECT CAST(o_orderkey AS VARCHAR) AS doc_number, c_name AS customer_name, CAST(o_orderdate AS DATE) AS txn_date, CAST(o_totalprice AS DECIMAL(18,2)) AS total_amt,
        CAST(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END AS DECIMAL(18,2)) AS balance, o_orderstatus AS status FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "facts": """SELECT job_id, min(activity_date) FILTER (WHERE signal > 0) AS first_signal_date, max(activity_date) FILTER (WHERE signal > 0) AS last_signal_date,
        lower(arg_max(type_name, date_diff('day', DATE '1970-01-01', activity_date) * 4 + signal) FILTER (WHERE signal > 0)) AS signal_source,
        count(*) FILTER (WHERE signal = 3) > 0 AS had_dated_quote, count(*) FILTER (WHERE signal = 2) > 0 AS had_dated_measure, count(*) FILTER (WHERE signal = 1) > 0 AS had_dated_template,
        min(activity_date) FILTER (WHERE signal = -1) AS first_move_date FROM (SELECT *, CASE WHEN type_name IN ('Install', 'Removal') THEN -1 WHEN activity_date > DATE '2000-12-31' THEN 0
        ELSE coalesce(list_position(['Template', 'Measure', 'Quote'], type_name), 0) END AS signal FROM lines WHERE activity_date IS NOT NULL) GROUP BY job_id""",
    "status": """SELECT j.job_id, j.job_name, last_signal_date IS NOT NULL AS is_quoted, first_signal_date, last_signal_date, signal_source, coalesce(had_dated_quote, false) AS had_dated_quote,
        coalesce(had_dated_measure, false) AS had_dated_measure, coalesce(had_dated_template, false) AS had_dated_template, first_move_date IS NOT NULL AS moved_forward, first_move_date,
        coalesce(first_move_date > DATE '2000-12-31', false) AS move_is_future, CASE WHEN first_move_date IS NULL THEN CAST(DATE '2000-12-31' - last_signal_date AS INTEGER) END AS days_silent,
        CASE WHEN last_signal_date IS NULL THEN 'not_quoted' WHEN first_move_date IS NOT NULL THEN 'moved' WHEN DATE '2000-12-31' - last_signal_date <= 30 THEN 'pending' ELSE 'quiet' END AS status
        FROM jobs j LEFT JOIN facts f ON f.job_id = j.job_id""",
    "paid": "SELECT DISTINCT job_id FROM lines WHERE (type_name IN ('Install', 'Removal') AND activity_date IS NOT NULL) OR notes ILIKE '%payment received —%' OR notes ILIKE '%payment recorded —%' OR notes ILIKE '%check-bot%'",
    "sqft": "SELECT l_orderkey AS job_id, sum(l_quantity) AS total_sq_ft, count(*) AS area_count FROM lineitem GROUP BY 1",
    "masked": r"SELECT job_id, activity_id, regexp_replace(regexp_replace(notes, '[0-9]+([.,/-][0-9]+)+', 'x', 'g'), '\$\s*[0-9]+', 'x', 'g') AS note FROM lines WHERE notes <> '' AND type_name = 'Invoice'",
    "numbers": "SELECT job_id, activity_id, unnest(regexp_extract_all(note, '(?:# ?)?[0-9]+')) AS s FROM masked",
    "links": """SELECT job_id, CAST(n AS VARCHAR) AS doc_number, min(activity_id) AS activity_id FROM (SELECT job_id, activity_id, s LIKE '#%' AS tagged, TRY_CAST(ltrim(s, '# ') AS BIGINT) AS n FROM numbers)
        WHERE n BETWEEN 1002 AND 19999 AND (tagged OR n NOT BETWEEN 2018 AND 2031) GROUP BY ALL""",
    "documents_words": "SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents",
}
TABLES["assignee"] = """SELECT DISTINCT activity_id, s_name AS assignee_name FROM (SELECT activity_id, unnest(CASE WHEN crew_id % 2 = 0 THEN [crew_id, crew_id % 10] ELSE [crew_id] END) AS s FROM lines) JOIN supplier ON s = s_suppkey"""
NEEDS = {
    "facts": ["lines"], "status": ["jobs", "facts"], "paid": ["lines"],
    "masked": ["lines"], "numbers": ["masked"], "links": ["numbers"], "assignee": ["lines"],
}
PCT = "CAST(round(100.0 * {} / {}, 1) AS DOUBLE)"


def with_tables(names: str, select: str) -> str:
    """``select`` with the tables it needs, and those that they need, before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n]})" for n in order) + " " + select if order else select


def query(sql: str | None = None, tables: str = ""):
    """Registers a function of Domain under its name, with its SQL over ``tables``."""

    def add(f: Callable[[Domain], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = with_tables(tables, sql)
        return f

    return add
