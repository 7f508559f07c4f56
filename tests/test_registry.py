"""Every query has its twin but those named here, and the entry works without the training-data subpackage."""

import subprocess
import sys

import duckdb
import pytest

from conftest import ROOT
from plumbline import registry

#: Queries that no SQL expresses.
ROWS_ONLY: set[str] = set()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_query_has_an_oracle():
    assert set(registry.queries()) - set(registry.oracle_sql()) == ROWS_ONLY
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_without_the_subpackage():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert out == [str(len(registry.queries())), str(len(registry.oracle_sql()))]


@pytest.mark.parametrize("name", ["m_accuracy", "m_aurc", "m_conformal_threshold", "m_temperature_fit", "bs_ece_ci", "bs_aurc_ci", "bs_corr_ci", "bs_weights", "cmp_envelope", "alarm_judge", "split_make", "q_sqnr", "q_range_entropy", "dq_record", "dq_build_match", "cond_label", "src_parquet_positions", "src_folder_labels", "lat_rows_sorted", "st_count_alarm", "st_time_windows", "st_running_accuracy", "st_dedup", "st_keyed_alarm", "sink_scores", "cache_keyed", "cache_parts", "work_grid_resume", "src_parquet_chosen", "q_range_percentile_sketch", "lat_summarise_sketch", "q_ranges", "q_top_tensors", "dq_json_diff", "dq_allowed_changes", "cmp_speed_ratio", "bs_e_aurc_diff_ci", "bs_paired_diff", "m_agreement"])
def test_query_equals_its_twin(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    rel = db.execute(registry.oracle_sql()[name])
    cols = sorted(d[0] for d in rel.description)
    want = sorted(str([None if v is None else round(v, 7) if isinstance(v, float) else v for v in (dict(zip([d[0] for d in rel.description], r))[c] for c in cols)]) for r in rel.fetchall())
    df = registry.queries()[name](spark, SF)
    assert sorted(df.columns) == cols
    got = sorted(str([None if v is None else round(v, 7) if isinstance(v, float) else v for v in (r[c] for c in cols)]) for r in df.collect())
    assert got == want and got
