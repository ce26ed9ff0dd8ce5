"""Distinct value lists and tracker dimensions (form choices, lookups)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def available_years(table: DataFrame) -> DataFrame:
    return table.select("year").distinct()


def available_by_year(table: DataFrame, col: str) -> DataFrame:
    """(year, col) distinct: projects / employees / concepts of each year."""
    return table.select("year", col).distinct()


def employee_projects(table: DataFrame) -> DataFrame:
    """Distinct (employee, project) pairs."""
    return table.select("employee", "project").distinct()


def open_projects(projects: DataFrame) -> DataFrame:
    """(name, id) of projects whose status is not 5 (a null status counts as
    open); when a name repeats, the last one listed (highest id) wins."""
    return (projects.filter(~F.col("status").eqNullSafe(5))
            .groupBy("name").agg(F.max("id").alias("id")))


def active_users(users: DataFrame) -> DataFrame:
    """Names of tracker users with status 1."""
    return users.filter(F.col("status") == 1).select("name")


def resolve_ids(pairs: DataFrame, tracker_users: DataFrame, open_projs: DataFrame) -> DataFrame:
    """(employee, project, employee_id, project_id): bulk name -> id lookup.

    employee: first tracker user with that name (lowest id); project: the
    open-project map.  Unknown names give null.  Both lookups are aggregated
    to one row per name before the join, so they cannot multiply rows.
    """
    emp = tracker_users.groupBy(F.col("name").alias("employee")).agg(F.min("id").alias("employee_id"))
    prj = open_projs.select(F.col("name").alias("project"), F.col("id").alias("project_id"))
    return (pairs.join(emp, "employee", "left").join(prj, "project", "left")
            .select("employee", "project", "employee_id", "project_id"))
