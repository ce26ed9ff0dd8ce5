"""Empty input -> empty result with the full schema, never an error (F8, Q10)."""

from ledgerline import schemas
from ledgerline.operators import changelog, compare, matrix, social, summary, timesheets, upsert


def test_empty_inputs_give_empty_frames(spark):
    fc = spark.createDataFrame([], schemas.FORECAST)
    spent = spark.createDataFrame([], schemas.SPENT_TIME)
    entries = spark.createDataFrame([], "date date, project string, employee string, hours double")
    log = spark.createDataFrame([], schemas.CHANGELOG)
    posts = spark.createDataFrame([], schemas.POSTS)
    edges = spark.createDataFrame([], schemas.FOLLOWERS)
    users = spark.createDataFrame([], schemas.USERS)
    batch = spark.createDataFrame(
        [], "seq long, employee string, project string, remarks string, month int, year int, dedication double")
    frames = {
        "matrix": matrix.dedication_matrix(fc),
        "summary": summary.summary(fc, "project"),
        "all_years": summary.summary_all_years(fc),
        "spent": timesheets.spent_time(entries, "x"),
        "vs": compare.forecast_vs_actual(fc, spent),
        "top": changelog.top_n_per_year(log),
        "feed": social.feed_page(posts, edges, 1),
        "counts": social.user_profile_counts(users, posts, edges),
        "log": upsert.forecast_upsert(fc, batch, "me")[0],
        "state": upsert.forecast_upsert(fc, batch, "me")[1],
    }
    for name, df in frames.items():
        assert df.count() == 0, name
        assert len(df.columns) > 0, name
    assert frames["summary"].columns[-1] == "total"
