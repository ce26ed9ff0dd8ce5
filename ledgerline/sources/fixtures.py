"""Planning views derived from the driver's tables.

Each function takes ``(spark, data_dir)`` and returns a lazy DataFrame whose
work grows with the underlying tables.  The DuckDB oracle builds the same
views in ``plans/oracle.py``; the two definitions must stay equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from .tables import read_table


def _project_of(orderkey: Column) -> Column:
    return F.concat(F.lit("Brand#"), (F.lit(1) + orderkey % 25).cast("string"))


def _forecast_dedication(orderkey: Column) -> Column:
    return ((orderkey * 7) % 101).cast("double") / 100


def _orders_with_employee(spark: SparkSession, d: str) -> DataFrame:
    """orders joined to the supplier whose key is ``o_custkey % 10``.

    Only suppliers 0-9 can match, so the supplier side is filtered to that key
    range first; with ``s_suppkey`` a key it holds at most ten rows and is safe
    to broadcast whatever the table size.
    """
    orders = read_table(spark, d, "orders")
    sup = (read_table(spark, d, "supplier").select("s_suppkey", "s_name")
           .filter((F.col("s_suppkey") >= 0) & (F.col("s_suppkey") < 10)))
    return orders.join(F.broadcast(sup), F.col("s_suppkey") == F.col("o_custkey") % 10)


def time_entries(spark: SparkSession, d: str) -> DataFrame:
    """date, project, employee, activity, hours (lineitem x supplier x part)."""
    li = read_table(spark, d, "lineitem").select(
        "l_suppkey", "l_partkey", "l_returnflag", "l_quantity", "l_shipdate")
    sup = read_table(spark, d, "supplier").select("s_suppkey", "s_name")
    part = read_table(spark, d, "part").select("p_partkey", "p_brand")
    return (li.join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("l_shipdate").cast("date").alias("date"),
                    F.col("p_brand").alias("project"),
                    F.col("s_name").alias("employee"),
                    F.col("l_returnflag").alias("activity"),
                    (F.col("l_quantity") % 9).alias("hours")))


def tracker_csv_rows(spark: SparkSession, d: str) -> DataFrame:
    """The time entries as the tracker exports them (text date M/d/yyyy)."""
    from .files import tracker_date_text
    te = time_entries(spark, d)
    return te.select(tracker_date_text(F.col("date")).alias("Date"),
                     F.col("project").alias("Project"),
                     F.col("employee").alias("User"),
                     F.col("activity").alias("Activity"),
                     F.lit(None).cast("string").alias("Issue"),
                     F.lit(None).cast("string").alias("Comment"),
                     F.col("hours").alias("Hours"))


def forecast(spark: SparkSession, d: str) -> DataFrame:
    o = _orders_with_employee(spark, d)
    return o.select(F.col("o_orderkey").alias("id"),
                    F.col("s_name").alias("employee"),
                    _project_of(F.col("o_orderkey")).alias("project"),
                    F.col("o_orderstatus").alias("remarks"),
                    F.month("o_orderdate").alias("month"),
                    F.year("o_orderdate").alias("year"),
                    _forecast_dedication(F.col("o_orderkey")).alias("dedication"))


def cost(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"),
                    F.col("o_orderpriority").alias("concept"),
                    _project_of(F.col("o_orderkey")).alias("project"),
                    F.col("o_orderstatus").alias("remarks"),
                    F.month("o_orderdate").alias("month"),
                    F.year("o_orderdate").alias("year"),
                    F.floor("o_totalprice").cast("int").alias("cost"))


def posts(spark: SparkSession, d: str) -> DataFrame:
    ev = read_table(spark, d, "events")
    lang = (F.when(F.col("event_id") % 5 == 0, "en").when(F.col("event_id") % 5 == 1, "es")
            .when(F.col("event_id") % 5 == 2, "it").when(F.col("event_id") % 5 == 3, "de")
            .otherwise(""))
    return ev.select(F.col("event_id").alias("id"),
                     F.concat(F.col("event_type"), F.lit(" "), F.col("props")).alias("body"),
                     F.col("ts").alias("timestamp"),
                     F.col("user_id"),
                     lang.alias("language"))


def followers(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    return (o.select(F.col("o_custkey").alias("follower_id"),
                     (F.col("o_orderkey") % 150).alias("followed_id"))
            .filter(F.col("follower_id") != F.col("followed_id"))
            .distinct())


def users(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer")
    seen = (read_table(spark, d, "events").groupBy("user_id")
            .agg(F.max("ts").alias("last_seen")))
    return (c.join(seen, F.col("c_custkey") == F.col("user_id"), "left")
            .select(F.col("c_custkey").alias("id"),
                    F.col("c_name").alias("username"),
                    (F.col("c_custkey") % 3).cast("int").alias("access"),
                    F.col("last_seen")))


def tracker_projects(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
                    (F.col("p_size") % 6).alias("status"))


def tracker_users(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                    (F.lit(1) + F.col("s_nationkey") % 3).alias("status"))


def profile_map(spark: SparkSession, d: str) -> DataFrame:
    """Stored employee -> profile map (some profiles deliberately empty)."""
    s = read_table(spark, d, "supplier").filter(F.col("s_suppkey") % 3 != 0)
    prof = (F.when(F.col("s_suppkey") % 4 == 0, F.lit(""))
            .otherwise(F.concat(F.lit("Profile "), (F.col("s_nationkey") % 5).cast("string"))))
    return s.select(F.col("s_name").alias("employee"), prof.alias("profile"))


def uploaded_profile_map(spark: SparkSession, d: str) -> DataFrame:
    """A newly uploaded map that overrides part of the stored one."""
    s = read_table(spark, d, "supplier").filter(F.col("s_suppkey") % 4 == 1)
    return s.select(F.col("s_name").alias("employee"),
                    F.concat(F.lit("Team "), (F.col("s_nationkey") % 4).cast("string")).alias("profile"))


def profile_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """The stored map as landed JSON text, one object per line."""
    pm = profile_map(spark, d)
    return pm.select(F.to_json(F.create_map(F.col("employee"), F.col("profile"))).alias("value"))


def changelog(spark: SparkSession, d: str) -> DataFrame:
    """Audit rows: a dedication row and a cost row per order.

    ids: ``2 * o_orderkey`` for dedication rows, ``2 * o_orderkey + 1`` for cost rows.
    Both rows come from one scan of orders: a left join to the (at most ten)
    matching suppliers, then an explode of the two row variants.
    """
    orders = read_table(spark, d, "orders")
    sup = (read_table(spark, d, "supplier").select("s_suppkey", "s_name")
           .filter((F.col("s_suppkey") >= 0) & (F.col("s_suppkey") < 10)))
    o = orders.join(F.broadcast(sup), F.col("s_suppkey") == F.col("o_custkey") % 10, "left")
    add = F.col("o_orderkey") % 3 == 0
    null_s, null_d, null_i = (F.lit(None).cast(t) for t in ("string", "double", "int"))
    ded = F.struct(
        (F.col("o_orderkey") * 2).alias("id"), F.col("s_name").alias("employee"),
        F.when(add, F.lit(0.0)).otherwise(((F.col("o_orderkey") * 11) % 101).cast("double") / 100)
        .alias("dedication_old"),
        _forecast_dedication(F.col("o_orderkey")).alias("dedication_new"),
        null_s.alias("concept"), null_i.alias("cost_old"), null_i.alias("cost_new"))
    cst = F.struct(
        (F.col("o_orderkey") * 2 + 1).alias("id"), null_s.alias("employee"),
        null_d.alias("dedication_old"), null_d.alias("dedication_new"),
        F.col("o_orderpriority").alias("concept"),
        F.when(add, F.lit(0)).otherwise(F.floor(F.col("o_totalprice") * 0.9).cast("int")).alias("cost_old"),
        F.floor("o_totalprice").cast("int").alias("cost_new"))
    # the dedication row exists only for orders whose supplier exists
    variants = F.when(F.col("s_name").isNotNull(), F.array(ded, cst)).otherwise(F.array(cst))
    remarks = (F.when(F.col("o_orderstatus") == "O", F.lit(""))
               .otherwise(F.concat(F.lit("status "), F.col("o_orderstatus"))))
    rows = o.select(F.explode(variants).alias("v"),
                    F.when(add, "add").otherwise("update").alias("action"),
                    F.concat(F.lit("Customer#"), (F.col("o_custkey") % 20).cast("string")).alias("author"),
                    _project_of(F.col("o_orderkey")).alias("project"),
                    F.month("o_orderdate").alias("month"), F.year("o_orderdate").alias("year"),
                    remarks.alias("remarks"), F.col("o_orderdate").alias("timestamp"))
    return rows.select(F.col("v.id").alias("id"), "action", "author", F.col("v.employee").alias("employee"),
                       "project", "month", "year",
                       F.col("v.dedication_old").alias("dedication_old"),
                       F.col("v.dedication_new").alias("dedication_new"),
                       F.col("v.concept").alias("concept"), F.col("v.cost_old").alias("cost_old"),
                       F.col("v.cost_new").alias("cost_new"), "remarks", "timestamp")


def tasks(spark: SparkSession, d: str) -> DataFrame:
    ev = read_table(spark, d, "events").filter(F.col("event_type") == "signup")
    return ev.select(F.col("event_id").cast("string").alias("id"),
                     F.col("event_type").alias("name"),
                     F.col("props").alias("description"),
                     F.col("user_id"),
                     (F.col("value") > 20).alias("complete"))


def forecast_base(spark: SparkSession, d: str) -> DataFrame:
    """Upsert base: forecast rows with even id."""
    return forecast(spark, d).filter(F.col("id") % 2 == 0)


def forecast_batch(spark: SparkSession, d: str) -> DataFrame:
    """Upsert batch: forecast rows with odd id, in id order (seq = id)."""
    return (forecast(spark, d).filter(F.col("id") % 2 == 1)
            .withColumnRenamed("id", "seq"))


def cost_base(spark: SparkSession, d: str) -> DataFrame:
    return cost(spark, d).filter(F.col("id") % 2 == 0)


def cost_batch(spark: SparkSession, d: str) -> DataFrame:
    return cost(spark, d).filter(F.col("id") % 2 == 1).withColumnRenamed("id", "seq")


def plan_batch_text(spark: SparkSession, d: str) -> DataFrame:
    """The forecast batch as landed text: every cell a string, blanks ''."""
    b = forecast_batch(spark, d)
    return b.select("seq", "employee", "project",
                    F.col("month").cast("string").alias("month"),
                    F.col("year").cast("string").alias("year"),
                    scalars.fraction_text(F.col("dedication")).alias("dedication"),
                    F.coalesce("remarks", F.lit("")).alias("remarks"))


def username_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requested user names from sign-up events (seq = event id)."""
    ev = read_table(spark, d, "events").filter(F.col("event_type") == "signup")
    name = (F.when(F.col("event_id") % 2 == 0,
                   F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")))
            .otherwise(F.concat(F.lit("user"), F.col("user_id").cast("string"))))
    return ev.select(F.col("event_id").alias("seq"), name.alias("username"))


def follow_requests(spark: SparkSession, d: str) -> DataFrame:
    """follow / unfollow requests from click / error events, seq = event id."""
    ev = read_table(spark, d, "events").filter(F.col("event_type").isin("click", "error"))
    return ev.select(F.col("event_id").alias("seq"),
                     F.col("user_id").alias("follower_id"),
                     ((F.col("user_id") + F.col("event_id")) % 150).alias("followed_id"),
                     F.when(F.col("event_type") == "click", "follow").otherwise("unfollow").alias("op"))


def document_changes(spark: SparkSession, d: str) -> DataFrame:
    """Index change batch: delete / update some documents, add benchmark items.

    Added items get ids ``-(item_id + 1)``, disjoint from the non-negative doc ids.
    """
    docs = read_table(spark, d, "documents")
    dele = docs.filter(F.col("doc_id") % 10 == 0).select(
        F.lit("delete").alias("op"), F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("body"))
    upd = docs.filter(F.col("doc_id") % 10 == 1).select(
        F.lit("update").alias("op"), F.col("doc_id").alias("id"),
        F.concat(F.col("text"), F.lit(" amended entry")).alias("body"))
    bench = read_table(spark, d, "benchmark").select(
        F.lit("add").alias("op"), (-(F.col("item_id") + 1)).alias("id"), F.col("text").alias("body"))
    return dele.unionByName(upd).unionByName(bench)


def form_submissions(spark: SparkSession, d: str) -> DataFrame:
    """The forecast batch as form submissions: dedication in whole percent."""
    b = forecast_batch(spark, d)
    return b.select("seq", "employee", "project", "remarks", "month", "year",
                    F.round(F.col("dedication") * 100).cast("int").alias("dedication_pct"))
