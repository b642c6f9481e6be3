"""End-to-end properties: stream == batch scoring, partition invariance,
the batch scorer's error on a file without valid rows."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL


def _sorted(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    """A bundle fitted on most rows, saved and loaded."""
    from assaygraph.operators.training import fit_graph_classifier, load_model, save_model
    from assaygraph.sources.tables import assay_base

    gm, rec = fit_graph_classifier(assay_base(spark, SMALL).where("row_id < 800"), seed=43)
    path = str(tmp_path_factory.mktemp("run") / "final")
    save_model(gm, path)
    return gm, load_model(spark, path), rec.first()


ROWS = [("5", "click", "12,5", "3"), ("5", "view", "1", "4"), (None, "click", "40.0", "20"), ("6", "no such", "3", "1"),
        ("7", "click", None, "3"), ("8", None, "1", "2"), ("9", "click", "x", "1"), ("x y", "click", "7", "0")]
COLS = "row_id string, `Material type` string, `Exposure dose (ug/mL)` string, `Exposure time` string"


def test_loaded_model_scores_like_the_fitted_one(spark, model):
    from assaygraph.streaming.score_stream import score_batch_frame

    batch = spark.createDataFrame(ROWS, COLS)
    a, b = (_sorted(score_batch_frame(batch, m), "material", "dose", "hr", "prediction", "confidence") for m in model[:2])
    assert a == b and model[0].threshold == model[1].threshold


def test_repeated_absent_and_bad_ids_lose_nothing(spark, model):
    from assaygraph.streaming.score_stream import score_batch_frame

    out = score_batch_frame(spark.createDataFrame(ROWS, COLS), model[1]).collect()
    assert sorted(str(r.row_id) for r in out) == ["5", "5", "6", "None", "x y"]      # invalid rows are dropped
    plain = spark.createDataFrame([r[1:] for r in ROWS], COLS.split(", ", 1)[1])
    assert score_batch_frame(plain, model[1]).count() == 5
    assert all(r.prediction in ("Toxic", "Non-Toxic") and 0.5 <= r.confidence <= 1 for r in out)


def test_stream_scoring_equals_batch_scoring(spark, model, tmp_path):
    from assaygraph.sources.io import read_table
    from assaygraph.streaming.score_stream import score_batch_frame, score_stream

    spark.createDataFrame(ROWS, COLS).repartition(2).write.option("header", True).csv(str(tmp_path / "in"))
    cols = ["material", "dose", "hr", "prediction", "confidence"]
    batch = _sorted(score_batch_frame(read_table(spark, str(tmp_path / "in"), as_string=True), model[1]), *cols)
    q = score_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), model[1],
                     extra_cols=("row_id",))
    q.awaitTermination()
    assert _sorted(spark.read.parquet(str(tmp_path / "out")), *cols) == batch and len(batch) == 5


def test_no_valid_rows_is_an_error(spark, model):
    from assaygraph.streaming.score_stream import INPUT_COLS, score_batch_frame

    bad = spark.createDataFrame([("click", "x", None)], ", ".join(f"`{c}` string" for c in INPUT_COLS))
    with pytest.raises(ValueError, match="can be scored"):
        score_batch_frame(bad, model[1])
    with pytest.raises(ValueError, match="missing columns"):
        score_batch_frame(bad.drop(INPUT_COLS[0]), model[1])


def test_dropped_rows_are_reported(spark):
    from assaygraph.operators.clean import drop_null_rows_report

    df = spark.createDataFrame([(1, None), (2, 1.0), (3, None)], "id int, v double")
    kept, rep = drop_null_rows_report(df, ["v"])
    assert kept.count() == 1
    assert rep == {"rows_in": 3, "rows_dropped": 2}


def test_knn_is_partition_invariant(spark):
    from assaygraph.operators.similarity import knn
    from assaygraph.sources.tables import vectors

    v = vectors(spark, SMALL)
    a = _sorted(knn(v, v, k=4, exclude_self=True), "query_id", "rank", "neighbor_id", "dist")
    w = v.repartition(7, "label")
    b = _sorted(knn(w, w, k=4, exclude_self=True, block_rows=300), "query_id", "rank", "neighbor_id", "dist")
    assert a == b


def test_graph_classifier_beats_majority_on_planted_target(spark, model):
    from assaygraph.operators.training import score_rows
    from assaygraph.sources.tables import assay_base

    gm, _, rec = model
    assert rec["balanced_accuracy"] > 0.6           # planted target: dose above the material median
    unseen = assay_base(spark, SMALL).where("row_id >= 950")
    assert gm.nodes.where("row_id >= 800").count() == 0
    assert score_rows(gm, unseen).count() == 50
