"""Feed, follow graph and per-user counts (the reference's own test cases)."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.operators import social

from conftest import rows

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def _world(spark):
    users = spark.createDataFrame(
        [(1, "john", 0, None), (2, "susan", 0, None), (3, "mary", 0, None), (4, "david", 0, None)],
        schemas.USERS)
    # one post each at +1, +4, +3, +2 seconds
    posts = spark.createDataFrame(
        [(1, "post from john", T0 + dt.timedelta(seconds=1), 1, ""),
         (2, "post from susan", T0 + dt.timedelta(seconds=4), 2, ""),
         (3, "post from mary", T0 + dt.timedelta(seconds=3), 3, ""),
         (4, "post from david", T0 + dt.timedelta(seconds=2), 4, "")], schemas.POSTS)
    edges = spark.createDataFrame([(1, 2), (1, 4), (2, 3), (3, 4)], schemas.FOLLOWERS)
    return users, posts, edges


def test_feed_content_and_order(spark):
    users, posts, edges = _world(spark)
    page = social.feed_page(posts, edges, 1)
    got = {}
    for r in page.orderBy("viewer_id", "rank").collect():
        got.setdefault(r.viewer_id, []).append(r.id)
    assert got == {1: [2, 4, 1], 2: [2, 3], 3: [3, 4], 4: [4]}


def test_feed_has_no_duplicates_even_with_duplicate_and_self_edges(spark):
    users, posts, edges = _world(spark)
    noisy = edges.unionByName(edges).unionByName(spark.createDataFrame([(1, 1)], schemas.FOLLOWERS))
    feed = social.user_feed(posts, noisy)
    assert feed.count() == feed.select("viewer_id", "id").distinct().count() == 8


def test_follow_then_unfollow_counts(spark):
    users, posts, _ = _world(spark)
    empty = spark.createDataFrame([], schemas.FOLLOWERS)
    req = spark.createDataFrame([(1, 1, 2, "follow")], "seq long, follower_id long, followed_id long, op string")
    after = social.apply_follow_requests(empty, req)
    c = {r.id: (r.followed_count, r.follower_count) for r in
         social.user_profile_counts(users, posts, after).collect()}
    assert c[1] == (1, 0) and c[2] == (0, 1)
    req2 = req.unionByName(spark.createDataFrame([(2, 1, 2, "unfollow")], req.schema))
    after2 = social.apply_follow_requests(empty, req2)
    c2 = {r.id: (r.followed_count, r.follower_count) for r in
          social.user_profile_counts(users, posts, after2).collect()}
    assert c2[1] == (0, 0) and c2[2] == (0, 0)


def test_self_follow_refused_and_follow_is_idempotent(spark):
    _, _, edges = _world(spark)
    req = spark.createDataFrame([(1, 1, 1, "follow"), (2, 1, 2, "follow"), (3, 1, 2, "follow")],
                                "seq long, follower_id long, followed_id long, op string")
    out = rows(social.apply_follow_requests(edges, req))
    assert out == sorted([(1, 2), (1, 4), (2, 3), (3, 4)])


def test_avatar_hash_uses_lowercased_username(spark):
    users = spark.createDataFrame([(1, "John", 0, None)], schemas.USERS)
    (h,) = [r.avatar_md5 for r in social.avatar_hashes(users).collect()]
    assert h == "527bd5b5d689e2c32ae974c6229ff785"  # md5("john")


def test_export_iso_timestamps(spark):
    posts = spark.createDataFrame(
        [(1, "a", dt.datetime(2024, 1, 2, 3, 4, 5), 9, ""),
         (2, "b", dt.datetime(2024, 1, 2, 3, 4, 5, 120000), 9, "")], schemas.POSTS)
    got = {r.id: r.timestamp for r in social.export_posts(posts).collect()}
    assert got == {1: "2024-01-02T03:04:05Z", 2: "2024-01-02T03:04:05.120000Z"}


def test_translation_predicate(spark):
    posts = spark.createDataFrame(
        [(1, "a", T0, 1, "en"), (2, "b", T0, 1, "es"), (3, "c", T0, 1, ""), (4, "d", T0, 1, None)],
        schemas.POSTS)
    assert [r.id for r in social.posts_needing_translation(posts, "en").collect()] == [2]


def test_posts_page_and_per_user_page(spark):
    _, posts, _ = _world(spark)
    assert [r.id for r in social.posts_page(posts, 1, per_page=3).collect()] == [2, 3, 4]
    assert [r.id for r in social.posts_page(posts, 2, per_page=3).collect()] == [1]
    assert social.user_posts_page(posts, 2, per_page=1).count() == 0


def test_open_tasks_excludes_null_flag(spark):
    tasks = spark.createDataFrame([("a", "x", "", 1, False), ("b", "x", "", 1, True), ("c", "x", "", 1, None)],
                                  schemas.TASKS)
    assert [r.id for r in social.open_tasks(tasks).collect()] == ["a"]


def test_last_seen(spark):
    ev = spark.createDataFrame([(1, T0), (1, T0 + dt.timedelta(hours=1)), (2, T0)], "user_id long, ts timestamp_ntz")
    assert rows(social.last_seen(ev)) == [(1, T0 + dt.timedelta(hours=1)), (2, T0)]


def test_feed_page_equals_paging_the_whole_feed(spark):
    users, posts, edges = _world(spark)
    for p, n in [(1, 1), (2, 1), (1, 2), (3, 1)]:
        fast = rows(social.feed_page(posts, edges, p, n).select("viewer_id", "id", "rank"))
        slow = rows(social.per_key_page(social.user_feed(posts, edges), "viewer_id", p, n)
                    .select("viewer_id", "id", "rank"))
        assert fast == slow, (p, n)


def test_feed_of_given_viewers(spark):
    """Own posts and those of followed users, for the viewers asked for only; repeated and self edges add nothing."""
    t = dt.datetime(2024, 1, 1)
    posts = spark.createDataFrame([(i, u, f"p{i}", t + dt.timedelta(seconds=i)) for i, u in enumerate((1, 2, 3, 4, None))],
                                  "id long, user_id long, body string, timestamp timestamp_ntz")
    edges = spark.createDataFrame([(1, 2), (1, 4), (1, 2), (2, 3), (3, 4), (4, 4)], "follower_id long, followed_id long")
    got = {(r.viewer_id, r.id) for r in social.viewer_feed(posts, edges, [1, 4, 1, 9]).collect()}
    assert got == {(1, 0), (1, 1), (1, 3), (4, 3)}
    assert social.viewer_feed(posts, edges, [1]).count() == 3
    whole = {(r.viewer_id, r.id) for r in social.user_feed(posts, edges).collect()}
    every = {(r.viewer_id, r.id) for r in social.viewer_feed(posts, edges, [1, 2, 3, 4]).collect()}
    assert every == whole


def _hot_world(spark):
    """A third of all edges lead to author 1, who also wrote a third of all posts; some columns are null."""
    posts = [(i, f"p{i}", T0 + dt.timedelta(seconds=i % 50), 1 if i % 3 == 0 else 2 + i % 40, "") for i in range(600)]
    posts += [(9001, None, None, 1, None), (9002, "lost", T0, None, "")]
    edges = [(100 + v, 1) for v in range(900)] + [(100 + v, 2 + (v * 7 + j) % 40) for v in range(900) for j in range(2)]
    return spark.createDataFrame(posts, schemas.POSTS), spark.createDataFrame(edges, schemas.FOLLOWERS)


def test_hot_author_is_split_and_the_feed_is_whole(spark):
    posts, edges = _hot_world(spark)
    by = {}
    for p in posts.collect():
        by.setdefault(p.user_id, []).append(p.id)
    pairs = {(e.follower_id, e.followed_id) for e in edges.collect()}
    expected = sorted([(v, i) for v, a in pairs for i in by.get(a, [])]
                      + [(a, i) for a, ids in by.items() if a is not None for i in ids])
    assert sorted((r.viewer_id, r.id) for r in social.user_feed(posts, edges).collect()) == expected
    viewers = spark.createDataFrame([(100 + v,) for v in range(0, 900, 2)] + [(1,)], "viewer_id bigint")
    asked = {r.viewer_id for r in viewers.collect()}
    assert sorted((r.viewer_id, r.id) for r in social.viewer_feed(posts, edges, viewers).collect()) == \
        [x for x in expected if x[0] in asked]


def test_no_task_holds_a_hot_author(spark):
    """Without Spark's own splitting of skewed joins, no task of the join has twice the median's rows."""
    posts, edges = _hot_world(spark)
    pairs = social.clean_edges(edges).select(F.col("follower_id").alias("viewer_id"), F.col("followed_id").alias("_author"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for split in (True, False):
            sizes = sorted(r["count"] for r in social.fan_out(posts, pairs, split).groupBy(F.spark_partition_id()).count().collect())
            assert len(sizes) > 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2], sizes
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_feed_page_fans_out_only_posts_that_can_be_on_the_page(spark):
    """Ties at an author's last place, posts without a time, authors of few posts: the page is that of the
    whole feed; a post older than the viewer's floor is never paired with the viewer."""
    rng = random.Random(5)
    at = [None, *[dt.datetime(2024, 1, 1) + dt.timedelta(hours=h) for h in range(12)]]
    data = [(i, rng.choice([1, 2, 3, 4, 5, None]), f"b{i}", rng.choice(at)) for i in range(150)] + [(900, 6, "few", None)]
    posts = spark.createDataFrame(data, "id bigint, user_id bigint, body string, timestamp timestamp")
    pairs = {(rng.randrange(1, 9), rng.randrange(1, 7)) for _ in range(25)} | {(7, 6)}
    edges = spark.createDataFrame(sorted(pairs), "follower_id bigint, followed_id bigint")
    for page, per in ((1, 1), (1, 4), (3, 4), (2, 60)):
        got = sorted((r.viewer_id, r["rank"], r.id) for r in social.feed_page(posts, edges, page, per).collect())
        whole = social.per_key_page(social.user_feed(posts, edges), "viewer_id", page, per)
        assert got == sorted((r.viewer_id, r["rank"], r.id) for r in whole.collect())
    floors = spark.createDataFrame([(1, 2, at[6]), (2, 2, None)], "viewer_id bigint, _author bigint, _floor timestamp")
    out = social.fan_out(posts, floors, split_posts=False, floor="_floor").collect()
    assert {(r.viewer_id, r.id) for r in out} == {(v, p[0]) for p in data if p[1] == 2 for v in (1, 2)
                                                   if v == 2 or (p[3] is not None and p[3] >= at[6])}
