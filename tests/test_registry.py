"""Registered queries beside their SQL on DuckDB, and the driver contract."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = (
    "ag00_level_table", "ag04a_disagreement_extracted", "ag11_std_cosine_distance", "prj03_label_near", "wn05_trailing_tau", "wn09_pct_rank_avg", "jn04_violated_edges", "jn05_extend_chains",
    "jn08_tolerance_match", "sc03_extract_free_answer", "sc16_extract_claims", "src01_read_envelope", "sta02_kendall_pvalue", "sta12_wasserstein", "inf04_bootstrap_lead_time",
    "alm07_alarm_metrics", "rt03_pareto_front", "ser04_lead_time_summary", "ind04_kmeans2", "ml04_tune_c", "ml08_compare_variants", "ml09_threshold_baselines", "ml10b_forward_select", "ml11_permutation_control", "ml12_few_shot_curve", "ml13_noise_sensitivity", "ml15_alternative_labels", "ml16_pooled_cv_small", "ml19_task_scaled_lr", "fit03_fold", "au02_ci_anomalies", "va02_graph_connected", "gen03_k_colourable",
)
NAMES = sorted(entry.oracle_sql()) if os.environ.get("LEVELSCAN_ALL") else QUICK


def norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows(data, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def test_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 190 and len(o) > 160


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = entry.queries()[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(got, df.columns) == rows(cur.fetchall(), cols)
