"""Explicit schemas of the planning tables and landed inputs (no inference)."""

from pyspark.sql import types as T

FORECAST = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("employee", T.StringType()),
    T.StructField("project", T.StringType()),
    T.StructField("remarks", T.StringType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("dedication", T.DoubleType()),
])

COST = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("concept", T.StringType()),
    T.StructField("project", T.StringType()),
    T.StructField("remarks", T.StringType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("cost", T.IntegerType()),
])

SPENT_TIME = T.StructType([
    T.StructField("employee", T.StringType()),
    T.StructField("project", T.StringType()),
    T.StructField("remarks", T.StringType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("dedication", T.DoubleType()),
    T.StructField("total_hours", T.DoubleType()),
])

CHANGELOG = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("action", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("employee", T.StringType()),
    T.StructField("project", T.StringType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("dedication_old", T.DoubleType()),
    T.StructField("dedication_new", T.DoubleType()),
    T.StructField("concept", T.StringType()),
    T.StructField("cost_old", T.IntegerType()),
    T.StructField("cost_new", T.IntegerType()),
    T.StructField("remarks", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
])

USERS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("username", T.StringType()),
    T.StructField("access", T.IntegerType()),
    T.StructField("last_seen", T.TimestampNTZType()),
])

FOLLOWERS = T.StructType([
    T.StructField("follower_id", T.LongType()),
    T.StructField("followed_id", T.LongType()),
])

POSTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("body", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("language", T.StringType()),
])

TASKS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("complete", T.BooleanType()),
])

LAST_SEEN = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("last_seen", T.TimestampNTZType()),
])

# Time-tracker CSV export as landed on shared storage (header row present).
TIME_ENTRY_CSV = T.StructType([
    T.StructField("Date", T.StringType()),
    T.StructField("Project", T.StringType()),
    T.StructField("User", T.StringType()),
    T.StructField("Activity", T.StringType()),
    T.StructField("Issue", T.StringType()),
    T.StructField("Comment", T.StringType()),
    T.StructField("Hours", T.StringType()),
])

# Batch of forecast rows as read from a landed file: text until validated.
PLAN_BATCH = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("employee", T.StringType()),
    T.StructField("project", T.StringType()),
    T.StructField("month", T.StringType()),
    T.StructField("year", T.StringType()),
    T.StructField("dedication", T.StringType()),
    T.StructField("remarks", T.StringType()),
])

COST_BATCH = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("concept", T.StringType()),
    T.StructField("project", T.StringType()),
    T.StructField("month", T.StringType()),
    T.StructField("year", T.StringType()),
    T.StructField("cost", T.StringType()),
    T.StructField("remarks", T.StringType()),
])

TRACKER_DIM = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("status", T.IntegerType()),
])

PROFILE_MAP = T.StructType([
    T.StructField("employee", T.StringType()),
    T.StructField("profile", T.StringType()),
])
