"""Property: the parallel upsert equals the row-by-row loop for any input."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerline import schemas
from ledgerline.operators import upsert

from test_upsert import none_safe, row_by_row

emp = st.sampled_from(["a", "b", None])
prj = st.sampled_from(["P", "Q"])
month = st.integers(1, 2)
value = st.integers(0, 100).map(lambda v: v / 100)

base_rows = st.lists(st.tuples(emp, prj, month, value), max_size=8)
batch_rows = st.lists(st.tuples(emp, prj, month, value), min_size=1, max_size=25)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(base=base_rows, batch=batch_rows, width=st.sampled_from([1, 3, 1 << 20]),
       seq_start=st.integers(0, 50), seq_step=st.integers(1, 7))
def test_parallel_upsert_equals_loop(spark, base, batch, width, seq_start, seq_step):
    b = [(i + 1, e, p, "", m, 2024, v) for i, (e, p, m, v) in enumerate(base)]
    seqs = [seq_start + seq_step * i for i in range(len(batch))]
    t = [(s, e, p, f"r{s}", m, 2024, v) for s, (e, p, m, v) in zip(seqs, batch)]
    exp_log, exp_state = row_by_row(b, t)
    base_df = spark.createDataFrame(b, schemas.FORECAST)
    batch_df = spark.createDataFrame(
        t, "seq long, employee string, project string, remarks string, month int, year int, dedication double")
    log, state = upsert.forecast_upsert(base_df, batch_df, "me", bucket_width=width)
    got_log = sorted((r.seq, r.action, r.dedication_old, r.dedication_new) for r in log.collect())
    assert got_log == exp_log
    got_state = sorted(((r.employee, r.project, r.month, r.year, r.dedication) for r in state.collect()),
                       key=none_safe)
    assert got_state == exp_state
