"""DuckDB SQL for each registered query (the correctness oracle).

The planning views are common table expressions over the driver's tables,
equal to ``sources/fixtures.py``.  The queries state the reference semantics
directly (plain windows, UNION DISTINCT, ...) rather than the parallel plan
used on Spark, so the two are independent formulations.
"""

from __future__ import annotations

import re

from . import registry as R

_PROJECT = "concat('Brand#', CAST(1 + o_orderkey % 25 AS VARCHAR))"
_MONTH = "CAST(month(o_orderdate) AS INTEGER)"
_YEAR = "CAST(year(o_orderdate) AS INTEGER)"
_DED = "CAST((o_orderkey * 7) % 101 AS DOUBLE) / 100"

VIEWS: dict[str, str] = {
    "time_entries": """
        SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS project, s_name AS employee,
               l_returnflag AS activity, l_quantity % 9 AS hours
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",
    "forecast": f"""
        SELECT o_orderkey AS id, s_name AS employee, {_PROJECT} AS project,
               o_orderstatus AS remarks, {_MONTH} AS month, {_YEAR} AS year, {_DED} AS dedication
        FROM orders JOIN supplier ON s_suppkey = o_custkey % 10""",
    "cost": f"""
        SELECT o_orderkey AS id, o_orderpriority AS concept, {_PROJECT} AS project,
               o_orderstatus AS remarks, {_MONTH} AS month, {_YEAR} AS year,
               CAST(floor(o_totalprice) AS INTEGER) AS cost
        FROM orders""",
    "posts": """
        SELECT event_id AS id, concat(event_type, ' ', props) AS body, ts AS timestamp, user_id,
               CASE event_id % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'es' WHEN 2 THEN 'it'
                                 WHEN 3 THEN 'de' ELSE '' END AS language
        FROM events""",
    "followers": """
        SELECT DISTINCT o_custkey AS follower_id, o_orderkey % 150 AS followed_id
        FROM orders WHERE o_custkey <> o_orderkey % 150""",
    "users": """
        SELECT c_custkey AS id, c_name AS username, CAST(c_custkey % 3 AS INTEGER) AS access,
               ls.last_seen
        FROM customer LEFT JOIN (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id) ls
             ON c_custkey = ls.user_id""",
    "tracker_projects": "SELECT p_partkey AS id, p_name AS name, p_size % 6 AS status FROM part",
    "tracker_users": "SELECT s_suppkey AS id, s_name AS name, 1 + s_nationkey % 3 AS status FROM supplier",
    "profile_map": """
        SELECT s_name AS employee,
               CASE WHEN s_suppkey % 4 = 0 THEN ''
                    ELSE concat('Profile ', CAST(s_nationkey % 5 AS VARCHAR)) END AS profile
        FROM supplier WHERE s_suppkey % 3 <> 0""",
    "uploaded_map": """
        SELECT s_name AS employee, concat('Team ', CAST(s_nationkey % 4 AS VARCHAR)) AS profile
        FROM supplier WHERE s_suppkey % 4 = 1""",
    "changelog": f"""
        SELECT o_orderkey * 2 AS id,
               CASE WHEN o_orderkey % 3 = 0 THEN 'add' ELSE 'update' END AS action,
               concat('Customer#', CAST(o_custkey % 20 AS VARCHAR)) AS author,
               s_name AS employee, {_PROJECT} AS project, {_MONTH} AS month, {_YEAR} AS year,
               CASE WHEN o_orderkey % 3 = 0 THEN CAST(0 AS DOUBLE)
                    ELSE CAST((o_orderkey * 11) % 101 AS DOUBLE) / 100 END AS dedication_old,
               {_DED} AS dedication_new,
               CAST(NULL AS VARCHAR) AS concept, CAST(NULL AS INTEGER) AS cost_old,
               CAST(NULL AS INTEGER) AS cost_new,
               CASE WHEN o_orderstatus = 'O' THEN '' ELSE concat('status ', o_orderstatus) END AS remarks,
               o_orderdate AS timestamp
        FROM orders JOIN supplier ON s_suppkey = o_custkey % 10
        UNION ALL
        SELECT o_orderkey * 2 + 1,
               CASE WHEN o_orderkey % 3 = 0 THEN 'add' ELSE 'update' END,
               concat('Customer#', CAST(o_custkey % 20 AS VARCHAR)),
               CAST(NULL AS VARCHAR), {_PROJECT}, {_MONTH}, {_YEAR},
               CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), o_orderpriority,
               CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE CAST(floor(o_totalprice * 0.9) AS INTEGER) END,
               CAST(floor(o_totalprice) AS INTEGER),
               CASE WHEN o_orderstatus = 'O' THEN '' ELSE concat('status ', o_orderstatus) END,
               o_orderdate
        FROM orders""",
    "tasks": """
        SELECT CAST(event_id AS VARCHAR) AS id, event_type AS name, props AS description,
               user_id, value > 20 AS complete
        FROM events WHERE event_type = 'signup'""",
    "spent_time": f"""
        SELECT employee, project, 'Imported from time tracker at {R.RUN_STAMP}' AS remarks,
               month, year, hours / 140.0 AS dedication,
               sum(hours) OVER (PARTITION BY year, month, employee) AS total_hours
        FROM (SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
                     project, employee, coalesce(sum(hours), CAST(0 AS DOUBLE)) AS hours
              FROM time_entries
              WHERE hours IS DISTINCT FROM 0 AND date IS NOT NULL AND project IS NOT NULL
                    AND employee IS NOT NULL
              GROUP BY ALL) m""",
    "fbase": "SELECT * FROM forecast WHERE id % 2 = 0",
    "fbatch": """SELECT id AS seq, employee, project, remarks, month, year, dedication
                 FROM forecast WHERE id % 2 = 1""",
    "cbase": "SELECT * FROM cost WHERE id % 2 = 0",
    "cbatch": """SELECT id AS seq, concept, project, remarks, month, year, cost
                 FROM cost WHERE id % 2 = 1""",
    "plan_text": """
        SELECT seq, employee, project, CAST(month AS VARCHAR) AS month, CAST(year AS VARCHAR) AS year,
               CAST(dedication AS VARCHAR) AS dedication, coalesce(remarks, '') AS remarks
        FROM fbatch""",
    "username_requests": """
        SELECT event_id AS seq,
               CASE WHEN event_id % 2 = 0
                    THEN concat('Customer#', lpad(CAST(user_id AS VARCHAR), 9, '0'))
                    ELSE concat('user', CAST(user_id AS VARCHAR)) END AS username
        FROM events WHERE event_type = 'signup'""",
    "follow_requests": """
        SELECT event_id AS seq, user_id AS follower_id, (user_id + event_id) % 150 AS followed_id,
               CASE WHEN event_type = 'click' THEN 'follow' ELSE 'unfollow' END AS op
        FROM events WHERE event_type IN ('click', 'error')""",
    "doc_changes": """
        SELECT 'delete' AS op, doc_id AS id, CAST(NULL AS VARCHAR) AS body FROM documents WHERE doc_id % 10 = 0
        UNION ALL
        SELECT 'update', doc_id, concat(text, ' amended entry') FROM documents WHERE doc_id % 10 = 1
        UNION ALL
        SELECT 'add', -(item_id + 1), text FROM benchmark""",
    "post_postings": """
        SELECT term, doc_id, count(*) AS tf
        FROM (SELECT id AS doc_id, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS term FROM posts)
        GROUP BY term, doc_id""",
    "postings": """
        SELECT term, doc_id, count(*) AS tf
        FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)
        GROUP BY term, doc_id""",
    "cells": """
        SELECT employee, project, year, month, avg(dedication) AS value FROM forecast
        WHERE employee IS NOT NULL AND project IS NOT NULL AND year IS NOT NULL
              AND month IS NOT NULL AND dedication IS NOT NULL
        GROUP BY ALL""",
    "spent_cells": """
        SELECT employee, project, year, month, avg(dedication) AS value FROM spent_time
        WHERE employee IS NOT NULL AND project IS NOT NULL AND year IS NOT NULL
              AND month IS NOT NULL AND dedication IS NOT NULL
        GROUP BY ALL""",
    "merged_map": """
        SELECT employee, arg_max(profile, prio) AS profile FROM (
            SELECT name AS employee, '' AS profile, 0 AS prio FROM tracker_users WHERE status = 1
            UNION ALL SELECT employee, profile, 1 FROM profile_map
            UNION ALL SELECT employee, profile, 2 FROM uploaded_map) u
        WHERE employee IS NOT NULL GROUP BY employee""",
}

MONTHS = range(1, 13)
MCOLS = [f"m{m}" for m in MONTHS]
_TOTAL = " + ".join(MCOLS)


def _wide(value_expr: str, agg: str = "avg") -> str:
    return ", ".join(f"coalesce({agg}(CASE WHEN month = {m} THEN {value_expr} END), CAST(0 AS DOUBLE)) AS m{m}"
                     for m in MONTHS)


def _round(cols: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def _mean_matrix(table: str, keys: list[str], value: str) -> str:
    k = ", ".join(keys)
    nn = " AND ".join(f"{c} IS NOT NULL" for c in keys + ["year", "month", value])
    return f"""SELECT year, {k}, {_wide(f'CAST({value} AS DOUBLE)')} FROM {table}
               WHERE {nn} GROUP BY year, {k}"""


def _summary(cells: str, item: str) -> str:
    return f"""SELECT year, {item}, {', '.join(MCOLS)}, {_TOTAL} AS total FROM (
                 SELECT year, {item}, {_wide('value', 'sum')} FROM (
                   SELECT {item}, year, month, sum(value) AS value FROM {cells} GROUP BY ALL) p
                 GROUP BY year, {item}) w"""


def _profile_matrix(cells: str, pmap: str) -> str:
    return f"""SELECT year, project, profile, {_wide('value', 'sum')} FROM (
                 SELECT project, profile, year, month, sum(value) AS value FROM (
                   SELECT c.*, CASE WHEN pm.employee IS NOT NULL THEN pm.profile ELSE c.employee END AS profile
                   FROM {cells} c LEFT JOIN {pmap} pm ON c.employee = pm.employee) x
                 GROUP BY ALL) p
               GROUP BY year, project, profile"""


def _rounded(sql: str, cols: list[str]) -> str:
    return f"SELECT * REPLACE ({_round(cols)}) FROM ({sql}) q"


def _upsert_log(batch: str, base: str, keys: list[str], value: str) -> str:
    k = ", ".join(keys)
    return f"""
      WITH b AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY seq) AS rn,
                           lag({value}) OVER (PARTITION BY {k} ORDER BY seq) AS prev FROM {batch}),
           t AS (SELECT {k}, min(id) AS target_id, arg_min({value}, id) AS base_value FROM {base} GROUP BY ALL)
      SELECT b.seq,
             CASE WHEN b.rn > 1 OR t.target_id IS NOT NULL THEN 'update' ELSE 'add' END AS action,
             '{R.AUTHOR}' AS author, {', '.join('b.' + c for c in keys)},
             CASE WHEN b.rn > 1 THEN b.prev WHEN t.target_id IS NOT NULL THEN t.base_value
                  ELSE 0 END AS {value}_old,
             b.{value} AS {value}_new, b.remarks
      FROM b LEFT JOIN t ON {' AND '.join(f'b.{c} = t.{c}' for c in keys)}"""


def _upsert_state(batch: str, base: str, keys: list[str], value: str, cols: list[str]) -> str:
    k = ", ".join(keys)
    on_t = " AND ".join(f"t.{c} = l.{c}" for c in keys)
    upd = ", ".join(
        f"CASE WHEN tc.id IS NOT NULL THEN tc.v ELSE b.{c} END AS {c}" if c == value else
        f"CASE WHEN tc.id IS NOT NULL THEN tc.r ELSE b.{c} END AS {c}" if c == "remarks" else
        f"b.{c}" for c in cols)
    ins = ", ".join(
        "mx.max_id + l.first_seq" if c == "id" else "l.v" if c == value else
        "l.r" if c == "remarks" else f"l.{c}" for c in cols)
    return f"""
      WITH l AS (SELECT {k}, arg_max({value}, seq) AS v, arg_max(remarks, seq) AS r, min(seq) AS first_seq
                 FROM {batch} GROUP BY ALL),
           t AS (SELECT {k}, min(id) AS target_id FROM {base} GROUP BY ALL),
           tc AS (SELECT t.target_id AS id, l.v, l.r FROM l JOIN t ON {on_t}),
           mx AS (SELECT coalesce(max(id), 0) AS max_id FROM {base})
      SELECT {upd} FROM {base} b LEFT JOIN tc ON b.id = tc.id
      UNION ALL
      SELECT {ins} FROM l, mx WHERE NOT EXISTS (SELECT 1 FROM t WHERE {on_t})"""


def _sentence() -> str:
    pct = "CAST(round_even({c} * 100, 0) AS INTEGER)"
    ded = (f"concat(author, ' changed the dedication of ', employee, ' in ', project, ' - ', "
           f"concat_ws('/', CAST(month AS VARCHAR), CAST(year AS VARCHAR)), ' from ', "
           f"coalesce(CAST({pct.format(c='dedication_old')} AS VARCHAR), ''), '% to ', "
           f"coalesce(CAST({pct.format(c='dedication_new')} AS VARCHAR), ''), '%.')")
    cst = (f"concat(author, ' changed the cost of ', concept, ' in ', project, ' - ', "
           f"concat_ws('/', CAST(month AS VARCHAR), CAST(year AS VARCHAR)), ' from ', "
           f"coalesce(CAST(cost_old AS VARCHAR), 'None'), '€ to ', coalesce(CAST(cost_new AS VARCHAR), 'None'), '€.')")
    return (f"concat(CASE WHEN employee IS NOT NULL AND employee <> '' THEN {ded} "
            f"WHEN concept IS NOT NULL AND concept <> '' THEN {cst} ELSE coalesce(author, '') END, "
            f"CASE WHEN remarks IS NOT NULL AND remarks <> '' THEN concat(' Motivation: ', remarks) ELSE '' END)")


def _bm25(query: str, page: int, per_page: int, table: str = "documents", id_col: str = "doc_id",
          text_col: str = "text", postings: str = "postings") -> str:
    from ..functions.text import query_terms
    from .. import config
    terms = ", ".join("('" + t.replace("'", "''") + "')" for t in query_terms(query)) or "(NULL)"
    k1, b = config.BM25_K1, config.BM25_B
    off = (page - 1) * per_page
    return f"""
      WITH q(term) AS (VALUES {terms}),
           lens AS (SELECT {id_col} AS doc_id,
                           CAST(len(regexp_extract_all(lower({text_col}), '[a-z0-9]+')) AS BIGINT) AS doc_len
                    FROM {table}),
           st AS (SELECT count(*) AS n_docs, avg(doc_len) AS avg_len FROM lens),
           h AS (SELECT p.* FROM {postings} p JOIN q ON p.term = q.term),
           dfq AS (SELECT term, count(*) AS df FROM h GROUP BY term),
           s AS (SELECT h.doc_id,
                        sum(ln(1 + (st.n_docs - dfq.df + 0.5) / (dfq.df + 0.5))
                            * h.tf * {k1 + 1} / (h.tf + {k1} * ({1 - b} + {b} * lens.doc_len / st.avg_len))) AS score
                 FROM h JOIN dfq ON h.term = dfq.term JOIN lens ON h.doc_id = lens.doc_id, st
                 GROUP BY h.doc_id),
           r AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rn FROM s)
      SELECT CAST(rn AS INTEGER) AS rank, doc_id, round(score, 6) AS score,
             (SELECT count(*) FROM s) AS total_hits
      FROM r WHERE rn > {off} AND rn <= {off + per_page}"""


def _stop_words_values() -> str:
    from ..functions.text import STOP_WORDS
    return ", ".join(f"('{w}', '{lang}')" for lang, ws in STOP_WORDS.items() for w in ws)


_NEWEST = "timestamp DESC NULLS LAST, id DESC"

SQL: dict[str, str] = {
    "scan_forecast": "SELECT * FROM forecast",
    "scan_time_entries": "SELECT date, project, employee, hours FROM time_entries",
    "scan_plan_batch": "SELECT * FROM plan_text",
    "scan_profile_map": "SELECT employee, profile FROM profile_map",
    "open_projects": "SELECT name, max(id) AS id FROM tracker_projects WHERE status IS DISTINCT FROM 5 GROUP BY name",
    "active_users": "SELECT name FROM tracker_users WHERE status = 1",
    "time_entries_slice": f"""
        SELECT date, project, employee, hours FROM time_entries
        WHERE employee = '{R.SLICE['employee']}' AND project = '{R.SLICE['project']}'
          AND date BETWEEN DATE '{R.SLICE['from_date']}' AND DATE '{R.SLICE['to_date']}'""",
    "quarantined_time_entries": """
        SELECT employee, violations, count(*) AS n_rows FROM (
          SELECT employee, concat_ws(',', CASE WHEN date IS NULL OR day(date) = 13 THEN 'date_invalid' END,
                                          CASE WHEN hours = 5 THEN 'hours_invalid' END) AS violations
          FROM time_entries) x GROUP BY ALL""",
    "time_entries_since": f"""
        SELECT date, project, employee, hours FROM time_entries
        WHERE employee = '{R.SLICE['employee']}' AND date >= DATE '{R.SLICE['from_date']}'""",
    "time_entries_first": f"""
        SELECT date, project, employee, hours FROM time_entries
        WHERE employee = '{R.SLICE['employee']}' AND project = '{R.SLICE['project']}'
        ORDER BY date, project, hours LIMIT {R.ENTRIES_SHOWN}""",
    "resolve_ids": """
        SELECT p.employee, p.project, e.employee_id, o.project_id
        FROM (SELECT DISTINCT employee, project FROM forecast) p
        LEFT JOIN (SELECT name, min(id) AS employee_id FROM tracker_users GROUP BY name) e ON p.employee = e.name
        LEFT JOIN (SELECT name, max(id) AS project_id FROM tracker_projects
                   WHERE status IS DISTINCT FROM 5 GROUP BY name) o ON p.project = o.name""",
    "resolve_tracker_ids": """
        SELECT p.employee, p.project, e.employee_id, o.project_id
        FROM (SELECT DISTINCT s_name AS employee, p_name AS project FROM lineitem
              JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey) p
        LEFT JOIN (SELECT name, min(id) AS employee_id FROM tracker_users GROUP BY name) e ON p.employee = e.name
        LEFT JOIN (SELECT name, max(id) AS project_id FROM tracker_projects
                   WHERE status IS DISTINCT FROM 5 GROUP BY name) o ON p.project = o.name""",
    "spent_time_refresh": _rounded("SELECT * FROM spent_time", ["dedication", "total_hours"]),
    "nonzero_entries": _rounded("SELECT date, project, employee, hours FROM time_entries "
                                "WHERE hours IS DISTINCT FROM 0", ["hours"]),
    "monthly_hours": _rounded("""
        SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, project, employee,
               coalesce(sum(hours), CAST(0 AS DOUBLE)) AS hours
        FROM time_entries WHERE hours IS DISTINCT FROM 0 AND date IS NOT NULL AND project IS NOT NULL
             AND employee IS NOT NULL GROUP BY ALL""", ["hours"]),
    "dedication_matrix": _rounded(_mean_matrix("forecast", ["employee", "project"], "dedication"), MCOLS),
    "spent_time_matrix": _rounded(_mean_matrix("spent_time", ["employee", "project"], "dedication"), MCOLS),
    "cost_matrix": _rounded(f"SELECT *, {_TOTAL} AS total FROM ("
                            + _mean_matrix("cost", ["project", "concept"], "cost") + ") w", MCOLS + ["total"]),
    "summary_by_project": _rounded(_summary("cells", "project"), MCOLS + ["total"]),
    "summary_by_employee": _rounded(_summary("cells", "employee"), MCOLS + ["total"]),
    "spent_summary_by_project": _rounded(_summary("spent_cells", "project"), MCOLS + ["total"]),
    "spent_summary_by_employee": _rounded(_summary("spent_cells", "employee"), MCOLS + ["total"]),
    "summary_all_years": _rounded(
        f"SELECT year, 'project' AS dimension, project AS item, {', '.join(MCOLS)}, total FROM ({_summary('cells', 'project')}) a "
        f"UNION ALL SELECT year, 'employee', employee, {', '.join(MCOLS)}, total FROM ({_summary('cells', 'employee')}) b",
        MCOLS + ["total"]),
    "profile_matrix": _rounded(_profile_matrix("cells", "profile_map"), MCOLS),
    "profile_matrix_spent": _rounded(_profile_matrix("spent_cells", "profile_map"), MCOLS),
    "profile_map_merge": "SELECT employee, profile FROM merged_map",
    "profile_map_file": "SELECT employee, profile FROM merged_map",
    "load_bands": _rounded("""
        WITH per AS (SELECT employee, year, month, sum(value) AS value FROM cells GROUP BY ALL),
             x AS (SELECT year, employee, CAST(month AS VARCHAR) AS cell, value FROM per
                   UNION ALL SELECT year, employee, 'TOTAL', sum(value) FROM per GROUP BY year, employee)
        SELECT year, employee, cell, value,
               CASE WHEN value > 1 AND value <= 3 THEN 'over'
                    WHEN value > 0.5 AND value <= 0.8 THEN 'light'
                    WHEN value <= 0.5 THEN 'low' ELSE 'none' END AS band
        FROM x""", ["value"]),
    "total_bar_fraction": _rounded(f"""
        SELECT c.*, CASE WHEN mx - mn = 0 THEN NULL ELSE (total - mn) / (mx - mn) END AS bar_fraction
        FROM (SELECT *, {_TOTAL} AS total FROM ({_mean_matrix('cost', ['project', 'concept'], 'cost')}) w) c
        JOIN (SELECT year, min(total) AS mn, max(total) AS mx FROM
               (SELECT year, {_TOTAL} AS total FROM ({_mean_matrix('cost', ['project', 'concept'], 'cost')}) w2) t
              GROUP BY year) s USING (year)""", MCOLS + ["total", "bar_fraction"]),
    "available_years": "SELECT DISTINCT year FROM forecast",
    "available_projects": "SELECT DISTINCT year, project FROM forecast",
    "available_employees": "SELECT DISTINCT year, employee FROM forecast",
    "available_concepts": "SELECT DISTINCT year, concept FROM cost",
    "employee_projects": "SELECT DISTINCT employee, project FROM forecast",
    "project_chart_series": _rounded("""
        SELECT year, project, month, employee AS series, 'Forecast' AS stack, value FROM cells
        UNION ALL SELECT year, project, month, employee, 'Spent Time', value FROM spent_cells""", ["value"]),
    "employee_chart_series": _rounded("""
        SELECT year, employee, month, project AS series, 'Forecast' AS stack, value FROM cells
        UNION ALL SELECT year, employee, month, project, 'Spent Time', value FROM spent_cells""", ["value"]),
    "stack_totals": _rounded("""
        SELECT year, project, stack, month, sum(value) AS stack_total FROM (
          SELECT *, 'Forecast' AS stack FROM cells UNION ALL SELECT *, 'Spent Time' FROM spent_cells) u
        GROUP BY ALL""", ["stack_total"]),
    "forecast_vs_actual": _rounded("""
        SELECT coalesce(f.employee, s.employee) AS employee, coalesce(f.project, s.project) AS project,
               coalesce(f.year, s.year) AS year, coalesce(f.month, s.month) AS month,
               coalesce(f.value, 0) AS forecast, coalesce(s.value, 0) AS spent,
               coalesce(s.value, 0) - coalesce(f.value, 0) AS diff
        FROM cells f FULL OUTER JOIN spent_cells s
          ON f.employee = s.employee AND f.project = s.project AND f.year = s.year AND f.month = s.month""",
                                   ["forecast", "spent", "diff"]),
    "upsert_forecast_log": _rounded(_upsert_log("fbatch", "fbase", ["employee", "project", "month", "year"],
                                                "dedication"), ["dedication_old", "dedication_new"]),
    "upsert_forecast_state": _rounded(_upsert_state(
        "fbatch", "fbase", ["employee", "project", "month", "year"], "dedication",
        ["id", "employee", "project", "remarks", "month", "year", "dedication"]), ["dedication"]),
    "upsert_cost_log": _upsert_log("cbatch", "cbase", ["concept", "project", "month", "year"], "cost"),
    "upsert_cost_state": _upsert_state(
        "cbatch", "cbase", ["concept", "project", "month", "year"], "cost",
        ["id", "concept", "project", "remarks", "month", "year", "cost"]),
    "validate_plan_batch": _rounded(f"""
        SELECT seq, employee, project, TRY_CAST(trim(month) AS INTEGER) AS month,
               TRY_CAST(trim(year) AS INTEGER) AS year, TRY_CAST(trim(dedication) AS DOUBLE) AS dedication,
               remarks, v AS violations, v = '' AS is_valid
        FROM (SELECT *, concat_ws(',',
                CASE WHEN employee IS NULL OR trim(employee) = '' THEN 'employee_required' END,
                CASE WHEN project IS NULL OR trim(project) = '' THEN 'project_required' END,
                CASE WHEN TRY_CAST(trim(month) AS INTEGER) IS NULL OR TRY_CAST(trim(month) AS INTEGER) < 1
                          OR TRY_CAST(trim(month) AS INTEGER) > 12 THEN 'month_invalid' END,
                CASE WHEN TRY_CAST(trim(year) AS INTEGER) IS NULL
                          OR TRY_CAST(trim(year) AS INTEGER) < {R.VALID_YEARS[0]}
                          OR TRY_CAST(trim(year) AS INTEGER) > {R.VALID_YEARS[1]} THEN 'year_invalid' END,
                CASE WHEN TRY_CAST(trim(dedication) AS DOUBLE) IS NULL OR TRY_CAST(trim(dedication) AS DOUBLE) < 0
                          OR TRY_CAST(trim(dedication) AS DOUBLE) > 1 THEN 'dedication_invalid' END) AS v
              FROM plan_text) x""", ["dedication"]),
    "validate_cost_batch": f"""
        SELECT *, violations = '' AS is_valid FROM (
          SELECT seq, concept, project, remarks, month, year, cost, concat_ws(',',
            CASE WHEN concept IS NULL OR concept NOT IN ({', '.join(repr(c) for c in R.VALID_CONCEPTS)})
                 THEN 'concept_invalid' END,
            CASE WHEN project IS NULL OR trim(project) = '' THEN 'project_required' END,
            CASE WHEN month IS NULL OR month < 1 OR month > 12 THEN 'month_invalid' END,
            CASE WHEN year IS NULL OR year < {R.VALID_YEARS[0]} OR year > {R.VALID_YEARS[1]} THEN 'year_invalid' END,
            CASE WHEN cost IS NULL OR cost < 0 THEN 'cost_invalid' END) AS violations
          FROM cbatch) x""",
    "changelog_top_n_per_year": _rounded(f"""
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY year ORDER BY {_NEWEST}) AS INTEGER) AS rank
                       FROM changelog) r
        WHERE rank <= 120""", ["dedication_old", "dedication_new"]),
    "changelog_year_top_n": _rounded(f"SELECT * FROM changelog WHERE year = {R.TOP_YEAR} "
                                     f"ORDER BY {_NEWEST} LIMIT 120", ["dedication_old", "dedication_new"]),
    "changelog_page": _rounded(f"SELECT * FROM changelog ORDER BY {_NEWEST} "
                               f"LIMIT 50 OFFSET {(R.CHANGELOG_PAGE - 1) * 50}",
                               ["dedication_old", "dedication_new"]),
    "changelog_sentences": f"SELECT id, {_sentence()} AS sentence FROM changelog",
    "changelog_text_filter": f"""SELECT * FROM (SELECT id, {_sentence()} AS sentence FROM changelog) s
                                WHERE contains(lower(sentence), '{R.CHANGELOG_QUERY.lower()}')""",
    "changelog_retention": _rounded(
        "SELECT * FROM changelog WHERE timestamp IS NULL OR timestamp >= TIMESTAMP '"
        + (R.RETENTION_AS_OF - __import__('datetime').timedelta(days=365)).strftime('%Y-%m-%d %H:%M:%S') + "'",
        ["dedication_old", "dedication_new"]),
    "forecast_year_filter": f"SELECT * FROM forecast WHERE year = {R.YEAR}",
    "user_feed": """
        SELECT f.follower_id AS viewer_id, p.id, p.user_id, p.body, p.timestamp
        FROM posts p JOIN followers f ON p.user_id = f.followed_id
        UNION
        SELECT user_id, id, user_id, body, timestamp FROM posts""",
    "viewer_feed": f"""
        SELECT * FROM (
          SELECT f.follower_id AS viewer_id, p.id, p.user_id, p.body, p.timestamp
          FROM posts p JOIN followers f ON p.user_id = f.followed_id
          UNION
          SELECT user_id, id, user_id, body, timestamp FROM posts) u
        WHERE viewer_id IN {tuple(R.FEED_VIEWERS)}""",
    "user_feed_page": f"""
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY viewer_id ORDER BY {_NEWEST}) AS INTEGER)
                              AS rank FROM (
          SELECT f.follower_id AS viewer_id, p.id, p.user_id, p.body, p.timestamp
          FROM posts p JOIN followers f ON p.user_id = f.followed_id
          UNION SELECT user_id, id, user_id, body, timestamp FROM posts) u) r
        WHERE rank <= 25""",
    "followers_of": """SELECT f.followed_id AS user_id, f.follower_id, u.username AS follower_username
                       FROM followers f JOIN users u ON u.id = f.follower_id""",
    "followed_by": """SELECT f.follower_id AS user_id, f.followed_id, u.username AS followed_username
                      FROM followers f JOIN users u ON u.id = f.followed_id""",
    "apply_follow_batch": """
        WITH last AS (SELECT follower_id, followed_id, arg_max(op, seq) AS op FROM follow_requests
                      WHERE follower_id <> followed_id GROUP BY ALL)
        SELECT follower_id, followed_id FROM (SELECT DISTINCT follower_id, followed_id FROM followers) e
        WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.follower_id = e.follower_id AND l.followed_id = e.followed_id)
        UNION ALL SELECT follower_id, followed_id FROM last WHERE op = 'follow'""",
    "posts_with_author": """SELECT p.id, p.user_id, u.username, p.body, p.timestamp
                            FROM posts p LEFT JOIN users u ON u.id = p.user_id""",
    "user_profile_counts": """
        SELECT u.id, u.username,
               CAST(coalesce((SELECT count(*) FROM posts p WHERE p.user_id = u.id), 0) AS BIGINT) AS post_count,
               CAST(coalesce((SELECT count(*) FROM followers f WHERE f.followed_id = u.id), 0) AS BIGINT) AS follower_count,
               CAST(coalesce((SELECT count(*) FROM followers f WHERE f.follower_id = u.id), 0) AS BIGINT) AS followed_count
        FROM users u""",
    "last_seen": "SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id",
    "posts_page": f"SELECT id, user_id, body, timestamp FROM posts ORDER BY {_NEWEST} "
                  f"LIMIT 25 OFFSET {(R.POSTS_PAGE - 1) * 25}",
    "user_posts_page": f"""
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY {_NEWEST}) AS INTEGER) AS rank
                       FROM posts) r
        WHERE rank > {(R.USER_POSTS_PAGE - 1) * 25} AND rank <= {R.USER_POSTS_PAGE * 25}""",
    "page_envelope": f"""
        WITH t AS (SELECT count(*) AS total_items FROM users),
             pg AS (SELECT id FROM users ORDER BY id LIMIT {R.ENVELOPE_PER_PAGE}
                    OFFSET {(R.ENVELOPE_PAGE - 1) * R.ENVELOPE_PER_PAGE})
        SELECT {R.ENVELOPE_PAGE} AS page, {R.ENVELOPE_PER_PAGE} AS per_page, total_items,
               CAST(CASE WHEN total_items = 0 THEN 0 ELSE ceil(total_items / {R.ENVELOPE_PER_PAGE}) END AS BIGINT)
                 AS total_pages,
               {R.ENVELOPE_PAGE} < CAST(CASE WHEN total_items = 0 THEN 0
                                        ELSE ceil(total_items / {R.ENVELOPE_PER_PAGE}) END AS BIGINT) AS has_next,
               {R.ENVELOPE_PAGE} > 1 AS has_prev,
               (SELECT count(*) FROM pg) AS n_items, (SELECT min(id) FROM pg) AS first_id,
               (SELECT max(id) FROM pg) AS last_id
        FROM t""",
    "export_posts": """
        SELECT user_id, id, body,
               CASE WHEN timestamp IS NULL THEN NULL
                    WHEN strftime(timestamp, '%f') = '000000' THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || 'Z'
                    ELSE strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' END AS timestamp
        FROM posts""",
    "avatar_hash": "SELECT id, username, md5(lower(username)) AS avatar_md5 FROM users",
    "posts_needing_translation": f"""SELECT id, user_id, language FROM posts
        WHERE language IS NOT NULL AND language <> '' AND language <> '{R.LOCALE}'""",
    "open_tasks_by_user": "SELECT user_id, id, name, description FROM tasks WHERE complete = false",
    "reject_duplicate_usernames": """
        SELECT r.seq, r.username,
               CASE WHEN EXISTS (SELECT 1 FROM users u WHERE u.username = r.username) THEN 'exists'
                    WHEN r.seq <> min(r.seq) OVER (PARTITION BY r.username) THEN 'duplicate'
                    ELSE 'ok' END AS status
        FROM username_requests r""",
    "text_index": "SELECT term, doc_id, tf FROM postings",
    "text_search": _bm25(R.SEARCH_QUERY, 1, 10),
    "text_index_apply_changes": """
        SELECT term, doc_id, tf FROM postings WHERE doc_id NOT IN (SELECT id FROM doc_changes)
        UNION ALL
        SELECT term, id AS doc_id, count(*) AS tf FROM (
          SELECT id, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS term FROM doc_changes
          WHERE op IN ('add', 'update')) t GROUP BY term, id""",
    "text_index_updated": """
        WITH n AS (SELECT doc_id, term, tf FROM postings WHERE doc_id NOT IN (SELECT id FROM doc_changes)
                   UNION ALL
                   SELECT id, term, count(*) FROM (
                     SELECT id, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS term FROM doc_changes
                     WHERE op IN ('add', 'update')) t GROUP BY term, id)
        SELECT term, doc_id, tf, CAST(sum(tf) OVER (PARTITION BY doc_id) AS BIGINT) AS doc_len FROM n""",
    "language_tags": f"""
        WITH sw(term, lang) AS (VALUES {_stop_words_values()}),
             t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
             c AS (SELECT doc_id, lang, count(*) AS n FROM t JOIN sw USING (term) GROUP BY ALL),
             b AS (SELECT doc_id, lang FROM (
                     SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) AS rn FROM c) x
                   WHERE rn = 1)
        SELECT d.doc_id, CASE WHEN length(coalesce(b.lang, '')) > 5 THEN '' ELSE coalesce(b.lang, '') END AS lang_tag,
               d.lang, (CASE WHEN length(coalesce(b.lang, '')) > 5 THEN '' ELSE coalesce(b.lang, '') END) = d.lang
                 AS agrees
        FROM documents d LEFT JOIN b ON d.doc_id = b.doc_id""",
}


SQL["text_search_rows"] = f"""
    SELECT h.rank, h.doc_id, d.lang, d.source, d.n_chars, h.score, h.total_hits
    FROM ({_bm25(R.SEARCH_QUERY, 1, 10)}) h JOIN documents d ON d.doc_id = h.doc_id"""
SQL["project_chart_one"] = (f"SELECT * FROM ({SQL['project_chart_series']}) c "
                            f"WHERE year = {R.CHART_YEAR} AND project = '{R.CHART_PROJECT}'")
SQL["employee_chart_one"] = (f"SELECT * FROM ({SQL['employee_chart_series']}) c "
                             f"WHERE year = {R.CHART_YEAR} AND employee = '{R.CHART_EMPLOYEE}'")
SQL["first_open_task"] = (f"SELECT user_id, min(id) AS id FROM tasks WHERE complete = false "
                          f"AND name = '{R.TASK_NAME}' GROUP BY user_id")
SQL["spent_summary_all_years"] = _rounded(
    f"SELECT year, 'project' AS dimension, project AS item, {', '.join(MCOLS)}, total "
    f"FROM ({_summary('spent_cells', 'project')}) a "
    f"UNION ALL SELECT year, 'employee', employee, {', '.join(MCOLS)}, total "
    f"FROM ({_summary('spent_cells', 'employee')}) b", MCOLS + ["total"])
SQL["available_cost_years"] = "SELECT DISTINCT year FROM cost"
SQL["available_cost_projects"] = "SELECT DISTINCT year, project FROM cost"
SQL["distinct_employees"] = "SELECT DISTINCT employee FROM forecast"
SQL["formatted_dedication_matrix"] = (
    "SELECT year, employee, project, "
    + ", ".join(f"CAST(CAST(round_even(round(m{m}, 6) * 100, 0) AS INTEGER) AS VARCHAR) || '%' AS m{m}"
                for m in MONTHS)
    + f" FROM ({_mean_matrix('forecast', ['employee', 'project'], 'dedication')}) w")

SQL["formatted_summary"] = (
    "SELECT year, employee, "
    + ", ".join(f"printf('%.1f', round(m{m}, 6)) AS m{m}" for m in MONTHS)
    + ", printf('%.1f', round(total, 6)) || ' PM' AS total"
    + f" FROM ({_summary('cells', 'employee')}) s")

SQL["post_search"] = f"""
    SELECT p.id, p.user_id, p.body, p.timestamp, h.rank, h.score, h.total_hits
    FROM ({_bm25(R.POST_QUERY, 1, 25, 'posts', 'id', 'body', 'post_postings')}) h JOIN posts p ON p.id = h.doc_id"""

SQL["formatted_cost_matrix"] = (
    "SELECT year, project, concept, "
    + ", ".join(f"CAST(m{m} AS VARCHAR) || ' €' AS m{m}" for m in MONTHS)
    + ", CAST(total AS VARCHAR) || ' €' AS total"
    + f" FROM (SELECT *, {_TOTAL} AS total FROM ({_mean_matrix('cost', ['project', 'concept'], 'cost')}) w) c")

SQL["user_records"] = f"""
    SELECT c.*, CASE WHEN u.last_seen IS NULL THEN NULL
                     WHEN strftime(u.last_seen, '%f') = '000000'
                       THEN strftime(u.last_seen, '%Y-%m-%dT%H:%M:%S') || 'Z'
                     ELSE strftime(u.last_seen, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' END AS last_seen,
           md5(lower(u.username)) AS avatar_md5
    FROM ({SQL['user_profile_counts']}) c JOIN users u ON u.id = c.id"""
SQL["followers_page"] = """
    SELECT * FROM (SELECT f.followed_id AS user_id, f.follower_id, u.username AS follower_username,
                          CAST(row_number() OVER (PARTITION BY f.followed_id ORDER BY f.follower_id) AS INTEGER)
                            AS rank
                   FROM followers f JOIN users u ON u.id = f.follower_id) r
    WHERE rank <= 10"""

SQL["chart_series_json"] = f"""
    SELECT year, project, stack, series,
           CAST(to_json({{'name': series, 'stack': stack,
                          'data': list([CAST(month AS DOUBLE), value] ORDER BY month)}}) AS VARCHAR) AS json
    FROM ({SQL['project_chart_series']}) s
    GROUP BY year, project, stack, series"""

# The form path converts whole percent to the same fractions as the batch.
SQL["upsert_form_log"] = SQL["upsert_forecast_log"]

# Streaming queries must equal their batch counterparts.
SQL["stream_last_seen"] = SQL["last_seen"]
SQL["stream_monthly_hours"] = SQL["monthly_hours"]
SQL["stream_quarantined_hours"] = """
    SELECT employee, concat_ws(',', CASE WHEN day(date) = 13 THEN 'date_invalid' END,
                                    CASE WHEN hours = 5 THEN 'hours_invalid' END) AS violations,
           count(*) AS n_rows, CAST(NULL AS DOUBLE) AS hours
    FROM time_entries WHERE day(date) = 13 OR hours = 5 GROUP BY ALL
    UNION ALL
    SELECT employee, '', NULL, round(sum(hours), 6) FROM time_entries
    WHERE NOT (day(date) = 13 OR hours = 5) AND hours IS DISTINCT FROM 0
      AND project IS NOT NULL AND employee IS NOT NULL GROUP BY employee"""
SQL["stream_spent_time"] = SQL["spent_time_refresh"]


def _sheet(report: str, sql: str, keys: list[str], numbers: list[str], texts: tuple[str, ...] = ()) -> str:
    """Cells of one report in the bundles' long form, for the years that have forecasts."""
    cells = [f"{{'c': '{c.capitalize()}', 'n': CAST({c} AS DOUBLE), 't': CAST(NULL AS VARCHAR)}}" for c in numbers]
    cells += [f"{{'c': '{c.capitalize()}', 'n': CAST(NULL AS DOUBLE), 't': {c}}}" for c in texts]
    key = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"""SELECT '{report}' AS report, year, row_key, u.c AS "column", round(u.n, 6) AS number, u.t AS "text" FROM (
        SELECT year, concat_ws('|', {key}) AS row_key, unnest([{', '.join(cells)}]) AS u FROM ({sql}) s
        WHERE year IN (SELECT year FROM forecast)) x"""


VIEWS["faulty_text"] = """
    SELECT seq, CASE WHEN seq % 11 = 0 THEN ' ' ELSE employee END AS employee, CASE WHEN seq % 13 = 0 THEN '' ELSE project END AS project,
           CASE WHEN seq % 7 = 0 THEN '13' ELSE month END AS month, CASE WHEN seq % 17 = 0 THEN 'soon' ELSE year END AS year,
           CASE WHEN seq % 5 = 0 THEN 'half' WHEN seq % 19 = 0 THEN '1.5' ELSE dedication END AS dedication, remarks
    FROM plan_text"""
SQL["validate_faulty_batch"] = SQL["validate_plan_batch"].replace("FROM plan_text", "FROM faulty_text")
SQL["load_bands_by_project"] = _rounded("""
    SELECT year, concat(employee, '|', project) AS employee, CAST(month AS VARCHAR) AS cell, value,
           CASE WHEN value > 1 AND value <= 3 THEN 'over' WHEN value > 0.5 AND value <= 0.8 THEN 'light'
                WHEN value <= 0.5 THEN 'low' ELSE 'none' END AS band FROM cells""", ["value"])
SQL["report_bundle"] = " UNION ALL ".join([
    _sheet("changelog", f"""SELECT * REPLACE (CASE WHEN timestamp IS NULL THEN NULL
                 WHEN strftime(timestamp, '%f') = '000000' THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || 'Z'
                 ELSE strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' END AS timestamp)
               FROM ({SQL["changelog_top_n_per_year"]}) t""", ["id"],
           ["month", "dedication_old", "dedication_new", "cost_old", "cost_new", "rank"],
           ("action", "author", "employee", "project", "concept", "remarks", "timestamp")),
    _sheet("personnel_forecasts", SQL["dedication_matrix"], ["employee", "project"], MCOLS),
    _sheet("cost_forecasts", SQL["cost_matrix"], ["project", "concept"], MCOLS + ["total"]),
    _sheet("spent_time", SQL["spent_time_matrix"], ["employee", "project"], MCOLS),
    _sheet("summary_projects", SQL["summary_by_project"], ["project"], MCOLS + ["total"]),
    _sheet("summary_employees", SQL["summary_by_employee"], ["employee"], MCOLS + ["total"])])
SQL["profile_bundle"] = " UNION ALL ".join([
    _sheet("forecast_profile", _rounded(_profile_matrix("cells", "merged_map"), MCOLS), ["project", "profile"], MCOLS),
    _sheet("spent_time_profile", _rounded(_profile_matrix("spent_cells", "merged_map"), MCOLS), ["project", "profile"], MCOLS),
    _sheet("costs", SQL["cost_matrix"], ["project", "concept"], MCOLS + ["total"])])
SQL["export_posts_file"] = f"""
    SELECT user_id, body, timestamp,
           row_number() OVER (PARTITION BY user_id ORDER BY posted NULLS FIRST, id) AS place
    FROM (SELECT e.*, p.timestamp AS posted FROM ({SQL['export_posts']}) e JOIN posts p USING (id)) x"""
# an inserted row's id depends on its micro-batch: only that it is new counts
SQL["stream_forecast_upsert_state"] = f"""
    SELECT CASE WHEN id <= (SELECT max(id) FROM fbase) THEN id END AS id, * EXCLUDE (id)
    FROM ({SQL['upsert_forecast_state']}) s"""
SQL["stream_forecast_upsert_log"] = SQL["upsert_forecast_log"]


VIEWS["fbatch_valid"] = f"SELECT * FROM fbatch WHERE year BETWEEN {R.VALID_YEARS[0]} AND {R.VALID_YEARS[1]}"
VIEWS["cbatch_valid"] = f"""SELECT * FROM cbatch WHERE year BETWEEN {R.VALID_YEARS[0]} AND {R.VALID_YEARS[1]}
    AND concept IN ({', '.join(repr(c) for c in R.VALID_CONCEPTS)}) AND cost >= 0"""
_FORECAST_KEYS = ["employee", "project", "month", "year"]
SQL["stream_ordered_upsert_log"] = _rounded(_upsert_log("fbatch_valid", "fbase", _FORECAST_KEYS, "dedication"), ["dedication_old", "dedication_new"])
SQL["stream_ordered_upsert_state"] = f"""
    SELECT s.* REPLACE (CASE WHEN s.id <= (SELECT max(id) FROM fbase) THEN s.id END AS id, round(s.dedication, 6) AS dedication)
    FROM ({_upsert_state("fbatch_valid", "fbase", _FORECAST_KEYS, "dedication",
                         ["id", "employee", "project", "remarks", "month", "year", "dedication"])}) s"""
SQL["read_plan_batch_file"] = "SELECT seq, employee, project, month, year, dedication, remarks FROM plan_text"
_STAMP = f"TIMESTAMP '{R.IMPORT_TIME:%Y-%m-%d %H:%M:%S}'"
SQL["import_audit_log"] = _rounded(f"""
    SELECT action, author, employee, project, month, year, dedication_old, dedication_new, CAST(NULL AS VARCHAR) AS concept,
           CAST(NULL AS INTEGER) AS cost_old, CAST(NULL AS INTEGER) AS cost_new, remarks, {_STAMP} AS timestamp
    FROM ({_upsert_log("fbatch_valid", "fbase", _FORECAST_KEYS, "dedication")}) f
    UNION ALL
    SELECT action, author, NULL, project, month, year, NULL, NULL, concept, cost_old, cost_new, remarks, {_STAMP}
    FROM ({_upsert_log("cbatch_valid", "cbase", ["concept", "project", "month", "year"], "cost")}) c""", ["dedication_old", "dedication_new"])


VIEWS["documents_updated"] = """
    SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT id FROM doc_changes)
    UNION ALL SELECT id, body FROM doc_changes WHERE op IN ('add', 'update')"""
VIEWS["postings_updated"] = """
    SELECT doc_id, term, count(*) AS tf FROM (
      SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents_updated) t GROUP BY ALL"""
SQL["segment_search"] = SQL["text_search"]
SQL["segment_search_past_end"] = f"""
    SELECT CAST(NULL AS INTEGER) AS rank, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS DOUBLE) AS score, max(total_hits) AS total_hits
    FROM ({SQL['text_search']}) s"""
SQL["segment_search_updated"] = _bm25(R.SEARCH_QUERY, 2, 10, "documents_updated", postings="postings_updated")
SQL["segment_postings_updated"] = SQL["text_index_updated"]


SQL["posts_page_deep"] = (f"SELECT id, user_id, body, timestamp FROM posts ORDER BY {_NEWEST} "
                          f"LIMIT 25 OFFSET {(R.DEEP_PAGE - 1) * 25}")
SQL["changelog_page_deep"] = _rounded(f"SELECT * FROM changelog ORDER BY {_NEWEST} LIMIT 50 OFFSET {(R.DEEP_PAGE - 1) * 50}",
                                      ["dedication_old", "dedication_new"])
SQL["changelog_day_retention"] = _rounded(
    f"SELECT * FROM changelog WHERE timestamp IS NULL OR timestamp >= TIMESTAMP '{R.RETENTION_MOMENT:%Y-%m-%d %H:%M:%S}' - INTERVAL 365 DAY",
    ["dedication_old", "dedication_new"])
SQL["stored_user_counts"] = f"""
    WITH e AS ({SQL['apply_follow_batch']})
    SELECT id, CAST(sum(post) AS BIGINT) AS post_count, CAST(sum(follower) AS BIGINT) AS follower_count, CAST(sum(followed) AS BIGINT) AS followed_count
    FROM (SELECT user_id AS id, 1 AS post, 0 AS follower, 0 AS followed FROM posts
          UNION ALL SELECT followed_id, 0, 1, 0 FROM e UNION ALL SELECT follower_id, 0, 0, 1 FROM e) x GROUP BY id"""
# ---- learned language tags: words, trigrams of padded words, add-1/2 smoothing
VIEWS["tag_docs"] = """
    SELECT doc_id, text, lang, substring(md5(CAST(doc_id AS VARCHAR)), 1, 1) IN ('0', '1', '2') AS held_out FROM documents"""
VIEWS["tag_words"] = r"""
    SELECT doc_id, word, count(*) AS n FROM (
      SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents) t GROUP BY ALL"""
VIEWS["tag_grams"] = """
    SELECT word, substring('^' || word || '$', CAST(i AS INTEGER), 3) AS gram FROM (
      SELECT word, unnest(generate_series(1, length(word))) AS i FROM (SELECT DISTINCT word FROM tag_words) v) x"""
VIEWS["tag_counts"] = """
    SELECT lang, gram, sum(n) AS n FROM (
      SELECT lang, word, sum(n) AS n FROM tag_words JOIN tag_docs USING (doc_id)
      WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL) w JOIN tag_grams USING (word) GROUP BY ALL"""
VIEWS["tag_langs"] = """
    SELECT lang, sum(n) AS total, (SELECT count(DISTINCT gram) FROM tag_counts) AS kinds FROM tag_counts GROUP BY lang"""
VIEWS["tag_scores"] = """
    SELECT word, l.lang, sum(ln((coalesce(c.n, 0) + 0.5) / (l.total + 0.5 * l.kinds))) AS score
    FROM tag_grams g CROSS JOIN tag_langs l LEFT JOIN tag_counts c ON c.gram = g.gram AND c.lang = l.lang GROUP BY ALL"""
VIEWS["tag_best"] = """
    SELECT doc_id, lang FROM (
      SELECT doc_id, s.lang, row_number() OVER (PARTITION BY doc_id ORDER BY sum(n * score) DESC, s.lang) AS rn
      FROM tag_words w JOIN tag_scores s USING (word) GROUP BY doc_id, s.lang) x WHERE rn = 1"""
SQL["learned_language_tags"] = """
    SELECT d.doc_id, d.lang, d.held_out, coalesce(CASE WHEN length(b.lang) <= 5 THEN b.lang END, '') AS lang_tag
    FROM tag_docs d LEFT JOIN tag_best b USING (doc_id)"""
SQL["language_accuracy"] = f"""
    SELECT lang, held_out, count(*) AS n_docs, count(*) FILTER (lang_tag = lang) AS n_right
    FROM ({SQL['learned_language_tags']}) t GROUP BY ALL"""


def _with_views(sql: str) -> str:
    """Prefix the views the statement uses (transitively) as CTEs."""
    needed: list[str] = []
    visiting: set[str] = set()

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name in needed or name in visiting:
                continue
            if re.search(rf"\b{name}\b", text):
                visiting.add(name)
                visit(body)
                visiting.discard(name)
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    return f"WITH {ctes}\nSELECT * FROM ({sql}) oracle_result"


def oracle_sql() -> dict[str, str]:
    return {name: _with_views(sql) for name, sql in SQL.items()}
