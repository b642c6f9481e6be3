"""Spark queries against their DuckDB oracle on the smallest scale factor."""

import pytest

from conftest import SMALL

FAST = """normalize_columns drop_all_null_columns extract_number coerce_numeric decimal_comma map_labels
drop_duplicates_full_row drop_null_rows clean_assay validate_assay drift_report null_counts describe histogram
min_max_scale one_hot column_transformer correlation_matrix drop_high_correlation vif positional_split
stratified_split stratified_kfold class_weights confusion_matrix classification_metrics classification_report
roc_auc roc_curve threshold_balanced_acc threshold_f1_cv threshold_pr_candidates knn_self_join knn_query_join
k_distance estimate_eps radius_join connected_components dbscan cluster_profile intra_cluster_knn_graph
attention_layer attention_propagation cluster_quality score_knn_vote fn_json fn_softmax_argmax scan_csv_sniffed
latest_valid_run""".split()


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    from oracle_check import compare

    r = compare(spark, duck, SMALL, name, E.queries()[name], E.oracle_sql()[name])
    assert r["ok"], r


def test_every_query_has_a_docstring_and_most_have_sql():
    import __spark_entry__ as E

    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(s) >= 100


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 200
    assert df.columns == ["row_id", "n_pos", "n_nbrs", "prediction", "prediction_text", "confidence"]
