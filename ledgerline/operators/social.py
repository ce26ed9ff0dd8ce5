"""Posts, follower graph, feeds, pages and per-user counts.

The follower graph is an edge DataFrame (follower_id, followed_id); every
per-user question is answered for all users at once with joins and grouped
counts instead of one lookup per user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import scalars
from .seek import page_newest_first
from .topn import top_n


def newest_first() -> list:
    """timestamp desc (nulls last), id desc as tie-break."""
    return [F.col("timestamp").desc_nulls_last(), F.col("id").desc()]


POST_COLS = ["id", "user_id", "body", "timestamp"]


def clean_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges without self-follows (self-follow is refused)."""
    return (edges.select("follower_id", "followed_id")
            .filter(F.col("follower_id") != F.col("followed_id")).distinct())


#: An author with more than this part of all posts, or of all edges, is split.  At most this many
#: authors have more of the posts, and as many more of the edges, whatever the tables' sizes.
SPLIT_SHARES = 1024


def _shares(df: DataFrame, author: str, name: str) -> DataFrame:
    """(author, name): the authors with more than one of SPLIT_SHARES shares of all rows, and into
    how many parts their rows go; at most SPLIT_SHARES rows."""
    counts = df.groupBy(F.col(author).alias("_a")).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar()
    return (counts.withColumn("_all", total).filter(F.col("_n") * SPLIT_SHARES > F.col("_all"))
            .select("_a", F.ceil(F.col("_n") * SPLIT_SHARES / F.col("_all")).alias(name)))


def fan_out(posts: DataFrame, pairs: DataFrame, split_posts: bool = True, floor: str | None = None) -> DataFrame:
    """(viewer_id, id, user_id, body, timestamp): every post for every viewer paired with its
    author.  ``pairs`` holds (viewer_id, _author), and maybe a column ``floor``: posts with an older or no
    time are left out for this pair (none are where it is null).

    A row of pairs gives as many rows as its author has posts, so with ``floor`` the two sides keep the
    session's number of partitions: sized by their input, tasks would grow with what comes out.

    An author of whom one task could not hold the posts or the pairs is split: posts go to parts by
    their hash, pairs by their viewer's, and each meets every part of the other, so that a join key is
    (author, part of posts, part of pairs) and no key has more than a 1/SPLIT_SHARES of either side.
    With ``split_posts`` off (each author has few posts) only the pairs are split.  A pair or a post
    of any other author is one row, as in a plain join.  Null authors match nothing."""
    plan = _shares(pairs, "_author", "_fs")
    if split_posts:
        plan = plan.join(_shares(posts, "user_id", "_ps"), "_a", "full_outer")
    else:
        plan = plan.withColumn("_ps", F.lit(1))
    plan = F.broadcast(plan)  # 2 * SPLIT_SHARES rows at most
    part = lambda of, *key: F.pmod(F.xxhash64(*key), F.coalesce(of, F.lit(1).cast("long")))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(of, F.lit(1)).cast("long") - 1))
    left = (posts.select(*POST_COLS).join(plan, F.col("user_id") == F.col("_a"), "left")
            .withColumn("_p", part(F.col("_ps"), *POST_COLS)).withColumn("_f", every(F.col("_fs")))
            .drop("_a", "_ps", "_fs"))
    floors = [floor] if floor else []
    right = (pairs.select("viewer_id", "_author", *floors).join(plan, F.col("_author") == F.col("_a"), "left")
             .withColumn("_f", part(F.col("_fs"), "viewer_id")).withColumn("_p", every(F.col("_ps")))
             .drop("_a", "_ps", "_fs"))
    met = (left["user_id"] == right["_author"]) & (left["_p"] == right["_p"]) & (left["_f"] == right["_f"])
    if floor:
        n = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left, right = left.repartition(n, "user_id", "_p", "_f"), right.repartition(n, "_author", "_p", "_f")
        met = met & (right[floor].isNull() | (left["timestamp"] >= right[floor]))
    return left.join(right, met).select("viewer_id", *POST_COLS)


def user_feed(posts: DataFrame, edges: DataFrame, split_posts: bool = True) -> DataFrame:
    """(viewer_id, id, user_id, body, timestamp) for every viewer: posts of
    followed users plus own posts.

    With distinct, non-self edges the two branches are disjoint (followed
    posts have user_id != viewer), so UNION ALL is already duplicate-free and
    the whole feed never needs a distinct shuffle.  An author followed by a
    third of everyone, or with a third of all posts, is split (:func:`fan_out`).
    """
    pairs = clean_edges(edges).select(F.col("follower_id").alias("viewer_id"), F.col("followed_id").alias("_author"))
    # a post without an author belongs to no feed; stating the filter once
    # keeps both branches identical, so the posts are read once
    p = posts.select(*POST_COLS).filter(F.col("user_id").isNotNull())
    return fan_out(p, pairs, split_posts).unionByName(_own_posts(p))


def _own_posts(posts: DataFrame) -> DataFrame:
    return posts.select(F.col("user_id").alias("viewer_id"), *POST_COLS)


def viewer_feed(posts: DataFrame, edges: DataFrame, viewers: list[int] | tuple[int, ...] | DataFrame) -> DataFrame:
    """(viewer_id, id, user_id, body, timestamp) for the given viewers (ids, or
    a DataFrame with ``viewer_id``): posts of followed users plus own posts.

    The viewers' edges and the viewers themselves are one list of (viewer,
    author) pairs, so the posts are read once and only pairs of the viewers
    asked for are ever made.  A table of viewers may be of any size, so its
    hot authors are split (:func:`fan_out`)."""
    listed = not isinstance(viewers, DataFrame)
    if listed:
        viewers = posts.sparkSession.createDataFrame([(int(v),) for v in viewers], "viewer_id bigint")
    asked = viewers.select(F.col("viewer_id").cast("long").alias("viewer_id")).distinct()
    pairs = (clean_edges(edges).join(asked, F.col("follower_id") == F.col("viewer_id"), "left_semi")
             .select(F.col("follower_id").alias("viewer_id"), F.col("followed_id").alias("_author"))
             .unionByName(asked.select("viewer_id", F.col("viewer_id").alias("_author"))))
    if not listed:
        return fan_out(posts, pairs)
    return posts.select(*POST_COLS).join(pairs, F.col("user_id") == F.col("_author")).select("viewer_id", *POST_COLS)


def feed_page(posts: DataFrame, edges: DataFrame, page_no: int,
              per_page: int = config.POSTS_PER_PAGE) -> DataFrame:
    """Page ``page_no`` of every viewer's feed, newest first, with ``rank``.

    A post on rank <= k of a viewer's feed is within the newest k posts of
    its author, so each author's posts are cut to their newest k before the
    fan-out to followers (exact, and the join no longer grows with the
    authors' full history).  Each author with k posts or more also tells a
    viewer how old a post on the page can be; the fan-out leaves out older ones.
    """
    k = max(int(page_no), 1) * per_page
    ranked = per_key_page(posts.select(*POST_COLS).filter(F.col("user_id").isNotNull()), "user_id", 1, k)
    # an author's k-th newest post: nothing older is on the page of a viewer of this author
    last = ranked.filter((F.col("rank") == k) & F.col("timestamp").isNotNull()).select(F.col("user_id").alias("_author"), F.col("timestamp").alias("_last"))
    pairs = clean_edges(edges).select(F.col("follower_id").alias("viewer_id"), F.col("followed_id").alias("_author"))
    own = last.select(F.col("_author").alias("viewer_id"), "_last")
    floors = (pairs.join(last, "_author").select("viewer_id", "_last").unionByName(own)
              .groupBy("viewer_id").agg(F.max("_last").alias("_floor")))
    recent = ranked.drop("rank")
    seen = _own_posts(recent).unionByName(fan_out(recent, pairs.join(floors, "viewer_id", "left"), split_posts=False, floor="_floor"))
    return per_key_page(seen, "viewer_id", page_no, per_page)


def per_key_page(df: DataFrame, key: str, page_no: int, per_page: int,
                 order: list | None = None) -> DataFrame:
    """Page of each key's rows (newest first unless ``order`` is given; rows
    have an ``id``).  However deep the page, no key meets in one task whole
    (see :func:`topn.top_n`)."""
    p = max(int(page_no), 1)
    lo, hi = (p - 1) * per_page, p * per_page
    return top_n(df, [key], order or newest_first(), hi, "id").filter(F.col("rank") > lo)


def followers_of(users: DataFrame, edges: DataFrame) -> DataFrame:
    """(user_id, follower_id, follower_username) for every user."""
    u = users.select(F.col("id").alias("follower_id"), F.col("username").alias("follower_username"))
    e = edges.select(F.col("followed_id").alias("user_id"), "follower_id")
    return e.join(u, "follower_id").select("user_id", "follower_id", "follower_username")


def followed_by(users: DataFrame, edges: DataFrame) -> DataFrame:
    """(user_id, followed_id, followed_username) for every user."""
    u = users.select(F.col("id").alias("followed_id"), F.col("username").alias("followed_username"))
    e = edges.select(F.col("follower_id").alias("user_id"), "followed_id")
    return e.join(u, "followed_id").select("user_id", "followed_id", "followed_username")


def apply_follow_requests(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """New edge table after (seq, follower_id, followed_id, op) requests.

    Applied in seq order, follow adds a missing edge and unfollow removes a
    present one, so for each pair only its last request decides; self-follows
    are refused.  The last request per pair is an aggregate (``max_by``); one
    full outer join with the current edges decides every pair.
    """
    pair = ["follower_id", "followed_id"]
    req = (requests.filter(F.col("follower_id") != F.col("followed_id"))
           .groupBy(*pair).agg(F.max_by("op", "seq").alias("op")))
    e = edges.select(*pair).distinct().withColumn("_present", F.lit(True))
    j = e.join(req, pair, "full_outer")
    keep = F.when(F.col("op").isNull(), F.col("_present")).otherwise(F.col("op") == "follow")
    return j.filter(keep).select(*pair)


def posts_with_author(posts: DataFrame, users: DataFrame) -> DataFrame:
    u = users.select(F.col("id").alias("user_id"), "username")
    return posts.join(u, "user_id", "left").select("id", "user_id", "username", "body", "timestamp")


def user_profile_counts(users: DataFrame, posts: DataFrame, edges: DataFrame,
                        extra: list | None = None) -> DataFrame:
    """(id, username, [extra...], post_count, follower_count, followed_count).

    The three counts come from one aggregation over a union of tagged ids
    (one shuffle, map-side combined, so a user with a third of all
    followers is absorbed by the partial counts), then one join to users.
    Each edge yields its two tagged ids from a single read of the edges.
    """
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("followed_id").alias("id"), F.lit(1).alias("kind")),
        F.struct(F.col("follower_id").alias("id"), F.lit(2).alias("kind")))).alias("e")).select("e.*")
    tagged = posts.select(F.col("user_id").alias("id"), F.lit(0).alias("kind")).unionByName(ends)
    counts = tagged.groupBy("id").agg(
        *[F.count(F.when(F.col("kind") == k, F.lit(1))).alias(name)
          for k, name in enumerate(("post_count", "follower_count", "followed_count"))])
    out = users.select("id", "username", *(extra or [])).join(counts, "id", "left")
    names = [c for c in out.columns if c not in ("post_count", "follower_count", "followed_count")]
    return out.select(*names,
                      *[F.coalesce(c, F.lit(0)).cast("long").alias(c)
                        for c in ("post_count", "follower_count", "followed_count")])


COUNTS = ["post_count", "follower_count", "followed_count"]


def count_deltas(old_edges: DataFrame, new_edges: DataFrame, posts: DataFrame) -> DataFrame:
    """(id, post_count, follower_count, followed_count): what a batch adds to, or takes from, the counts of the
    users it touches: new posts, and edges that are in one of the two tables only."""
    pair = ["follower_id", "followed_id"]
    gained = new_edges.select(*pair).exceptAll(old_edges.select(*pair)).withColumn("by", F.lit(1))
    lost = old_edges.select(*pair).exceptAll(new_edges.select(*pair)).withColumn("by", F.lit(-1))
    return _signed(gained.unionByName(lost), posts.select("user_id", F.lit(1).alias("by")))


def follow_deltas(edges: DataFrame, requests: DataFrame, posts: DataFrame) -> DataFrame:
    """As :func:`count_deltas`, straight from a follow batch: only the pairs it asks for are looked up."""
    pair = ["follower_id", "followed_id"]
    asked = (requests.filter(F.col("follower_id") != F.col("followed_id"))
             .groupBy(*pair).agg(F.max_by("op", "seq").alias("op")))
    there = edges.select(*pair).distinct().withColumn("there", F.lit(True))
    by = F.when((F.col("op") == "follow") & F.col("there").isNull(), 1).when((F.col("op") != "follow") & F.col("there"), -1)
    changed = asked.join(there, pair, "left").select(*pair, by.alias("by")).filter(F.col("by").isNotNull())
    return _signed(changed, posts.select("user_id", F.lit(1).alias("by")))


def _signed(edges: DataFrame, posts: DataFrame) -> DataFrame:
    ends = edges.select("by", F.explode(F.array(
        F.struct(F.col("followed_id").alias("id"), F.lit(1).alias("kind")),
        F.struct(F.col("follower_id").alias("id"), F.lit(2).alias("kind")))).alias("e")).select("e.*", "by")
    tagged = posts.select(F.col("user_id").alias("id"), F.lit(0).alias("kind"), "by").unionByName(ends)
    return tagged.groupBy("id").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("by"))), F.lit(0)).cast("long").alias(name)
                                      for k, name in enumerate(COUNTS)])


def last_seen(events: DataFrame, user_col: str = "user_id", ts_col: str = "ts") -> DataFrame:
    return events.groupBy(user_col).agg(F.max(ts_col).alias("last_seen"))


def posts_page(posts: DataFrame, page_no: int, per_page: int = config.POSTS_PER_PAGE) -> DataFrame:
    """A page of all posts, newest first; deep pages are sought (see :mod:`seek`)."""
    return page_newest_first(posts.select(*POST_COLS), page_no, per_page)


def user_posts_page(posts: DataFrame, page_no: int, per_page: int = config.POSTS_PER_PAGE) -> DataFrame:
    """The same page of every user's own posts."""
    return per_key_page(posts, "user_id", page_no, per_page)


def export_posts(posts: DataFrame) -> DataFrame:
    """(user_id, id, body, timestamp text) for every user; readers order a
    user's export by (timestamp, id), oldest first."""
    return posts.select("user_id", "id", "body", scalars.iso_utc(F.col("timestamp")).alias("timestamp"))


def avatar_hashes(users: DataFrame) -> DataFrame:
    return users.select("id", "username", scalars.avatar_digest(F.col("username")).alias("avatar_md5"))


def posts_needing_translation(posts: DataFrame, locale: str) -> DataFrame:
    return posts.filter(scalars.needs_translation(F.col("language"), locale)).select(
        "id", "user_id", "language")


def open_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks whose ``complete`` flag is false (a null flag is not false)."""
    return tasks.filter(F.col("complete") == F.lit(False)).select(
        "user_id", "id", "name", "description")


def first_open_task(tasks: DataFrame, name: str) -> DataFrame:
    """Per user, the first (lowest id) open task with the given name."""
    return (open_tasks(tasks).filter(F.col("name") == name).groupBy("user_id")
            .agg(F.min("id").alias("id")))


def user_records(users: DataFrame, posts: DataFrame, edges: DataFrame) -> DataFrame:
    """The user record of the API: id, username, last_seen (ISO-8601 + Z),
    avatar digest and the three counts (one read of the users)."""
    return user_profile_counts(users, posts, edges, extra=[
        scalars.iso_utc(F.col("last_seen")).alias("last_seen"),
        scalars.avatar_digest(F.col("username")).alias("avatar_md5")])


def followers_page(users: DataFrame, edges: DataFrame, page_no: int,
                   per_page: int = config.API_PER_PAGE_DEFAULT) -> DataFrame:
    """The same page of every user's follower list, by follower id."""
    per = min(int(per_page), config.API_PER_PAGE_MAX)
    return per_key_page(followers_of(users, edges), "user_id", page_no, per, [F.col("follower_id")])
