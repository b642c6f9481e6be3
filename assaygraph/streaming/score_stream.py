"""Score three-column CSV files with a saved graph model, at once or as they land.

Rows with an empty or unreadable required value are dropped; rows that the
model cannot score stay as ``Error`` with confidence 0.  Rows are told apart
by a generated number, so repeated or absent ids lose nothing.  As a stream
each micro-batch is scored by the same function and overwrites its own
``batch_id=<n>`` folder, so a replayed batch yields the same output once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clean as C
from ..operators import training as TR
from ..plans.session import cut_lineage
from ..sources.tables import DOSE, MATERIAL, TIME

INPUT_COLS = [MATERIAL, DOSE, TIME]


def valid_rows(batch: DataFrame) -> DataFrame:
    """The scorable rows of an all-text batch: typed, numbered, other columns kept."""
    missing = [c for c in INPUT_COLS if c not in batch.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    typed = C.decimal_comma(batch, [DOSE, TIME])
    return C.drop_null_rows(typed, INPUT_COLS)


def score_batch_frame(batch: DataFrame, model: TR.GraphModel, allow_empty: bool = False) -> DataFrame:
    """``material, dose, hr, prediction, confidence`` and the batch's other columns, one row for each valid row."""
    ok = valid_rows(batch)
    extra = [c for c in batch.columns if c not in INPUT_COLS]
    ok = ok.select(F.monotonically_increasing_id().alias("_rid"), F.col(f"`{MATERIAL}`").alias("material"),
                   F.col(f"`{DOSE}`").alias("dose"), F.col(f"`{TIME}`").alias("hr"), *[F.col(f"`{c}`") for c in extra])
    ok = cut_lineage(ok)                                    # the numbers stay what they are
    if not allow_empty and ok.isEmpty():
        raise ValueError("no row of this file can be scored")
    scored = TR.score_rows(model, ok, "_rid").select("_rid", "prediction", "confidence")
    out = ok.join(scored, "_rid", "left")
    return out.select(*extra, "material", "dose", "hr", F.coalesce("prediction", F.lit("Error")).alias("prediction"),
                      F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def score_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, model: TR.GraphModel,
                 available_now: bool = True, extra_cols: tuple[str, ...] = ()):
    """Start the streaming query; returns the ``StreamingQuery``.

    ``extra_cols`` are further text columns of the files, ahead of the three
    required ones, that go through to the output.
    """
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in [*extra_cols, *INPUT_COLS]])
    src = (spark.readStream.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
                .option("enforceSchema", False).csv(in_dir))

    def each(batch: DataFrame, epoch: int) -> None:
        # one folder per micro-batch, overwritten on a retry: a batch re-run
        # after a failure replaces its own output instead of appending twice
        out = score_batch_frame(batch, model, allow_empty=True)
        out.write.mode("overwrite").parquet(f"{out_dir}/batch_id={epoch}")

    w = src.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
