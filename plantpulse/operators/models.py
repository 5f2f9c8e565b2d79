"""Classifiers: efficiency status (multi-class) and failure risk (binary).

MLlib pipelines -- string indexing, vector assembly and a 50-tree random
forest -- train and score distributed; scoring is ``model.transform`` over a
table, never one form at a time.  The label encoding and the train/test split
also exist as plain column expressions so they can be checked by SQL.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.functions.columns import risk_label, safe_ratio as try_ratio
from plantpulse.operators.ranking import positions
from plantpulse.schema import FEATURES, MEASURES

N_TREES = 50
SEED = 42
MAX_DEPTH = 10          # MLlib caps depth at 30; 10 keeps 50 trees small
TEST_FRACTION = 0.2
_SPLIT_SALT = "42:"     # the split seed, as text


def label_codes(readings: DataFrame, cols: tuple[str, ...] = ("operation_mode", "efficiency_status")) -> DataFrame:
    """(kind, label, code): each category's labels numbered 0.. alphabetically.
    One scan emits every (kind, label) pair; the ranking runs over the
    distinct labels only (a handful of rows)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("label")) for c in cols])
    labels = readings.select(F.inline(pairs)).where(F.col("label").isNotNull()).distinct()
    return labels.withColumn("code", F.dense_rank().over(Window.partitionBy("kind").orderBy("label")) - 1)


def is_test_row(id_col: str = "reading_id", test_fraction: float = TEST_FRACTION) -> Column:
    """Deterministic split by a hash of the row id: independent of partitioning
    and of the engine (md5 of text), unlike ``randomSplit``."""
    cut = format(int((1.0 - test_fraction) * 0xFFFFFFFF + 0.5), "08x")
    return F.substring(F.md5(F.concat(F.lit(_SPLIT_SALT), F.col(id_col).cast("string"))), 1, 8) >= F.lit(cut)


def split_flags(readings: DataFrame) -> DataFrame:
    return readings.select("reading_id", is_test_row().alias("is_test"))


def failure_labels(readings: DataFrame) -> DataFrame:
    return readings.select("reading_id", risk_label().alias("failure_label"))


def _complete() -> Column:
    """Whether a row has every feature, as a number (NaN is none) or a mode."""
    cond = F.col("operation_mode").isNotNull()
    for c in MEASURES:
        cond = cond & F.col(c).isNotNull() & ~F.isnan(c)
    return cond


def incomplete_inputs(rows: DataFrame) -> DataFrame:
    """Scoring answers 'incomplete' for a row with any missing feature: status per row."""
    return rows.select("reading_id", F.when(_complete(), "ready").otherwise("incomplete").alias("status"))


def _to_score(rows: DataFrame) -> DataFrame:
    """Every row with its ``status``; missing features get a stand-in, so that
    no stage of the model drops the row (its answer is blanked afterwards)."""
    marked = rows.withColumn("status", F.when(_complete(), "scored").otherwise("incomplete"))
    return marked.withColumns({
        "operation_mode": F.coalesce("operation_mode", F.lit("")),
        **{c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)) for c in MEASURES}})


def _if_scored(answer) -> Column:
    return F.when(F.col("status") == "scored", answer)


def _stages(label_col: str | None, label_out: str):
    mode_idx = StringIndexer(inputCol="operation_mode", outputCol="operation_mode_code",
                             stringOrderType="alphabetAsc", handleInvalid="keep")
    asm = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="skip")
    rf = RandomForestClassifier(featuresCol="features", labelCol=label_out, numTrees=N_TREES,
                                maxDepth=MAX_DEPTH, seed=SEED)
    stages = [mode_idx]
    if label_col is not None:
        stages.append(StringIndexer(inputCol=label_col, outputCol=label_out, stringOrderType="alphabetAsc"))
    return stages + [asm, rf]


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` in no fewer partitions than the cluster has cores: a tree ensemble costs far more per row than a
    shuffle, and one input file must not mean one task.  Rows already spread out are left where they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, "reading_id") if rows.rdd.getNumPartitions() < cores else rows


def _to_fit(train: DataFrame, label: str) -> DataFrame:
    """Complete rows with a label, dealt out."""
    return _dealt(train.where(_complete() & F.col(label).isNotNull()).select("reading_id", "operation_mode", *MEASURES, label))


def train_efficiency(train: DataFrame) -> PipelineModel:
    """Rows without a status are not learned from."""
    return Pipeline(stages=_stages("efficiency_status", "label")).fit(_to_fit(train, "efficiency_status"))


def train_failure(train: DataFrame) -> PipelineModel:
    """Binary forest on the failure label.  Note the label is a function of
    two of the features, so a near-perfect score here proves nothing."""
    return Pipeline(stages=_stages(None, "failure_label")).fit(
        _to_fit(train.withColumn("failure_label", risk_label().cast("double")), "failure_label"))


def _scored(eff_model: PipelineModel, fail_model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with both models' answers: the modes are coded and the features assembled once, then
    either forest adds ``predicted_status`` and ``risk`` (the probability of a failure)."""
    out = rows
    modes, forest = eff_model.stages[0], eff_model.stages[-1]
    risk = fail_model.stages[-1]
    same_codes = list(modes.labels) == list(fail_model.stages[0].labels)
    out = eff_model.stages[-2].transform(modes.transform(out))
    code = F.get(F.lit(list(eff_model.stages[1].labels)), F.col("prediction").cast("int"))
    out = forest.transform(out).withColumn("predicted_status", code).drop("rawPrediction", "probability", "prediction")
    if not same_codes:  # fitted on rows with other modes
        out = fail_model.stages[-2].transform(fail_model.stages[0].transform(out.drop("features", "operation_mode_code")))
    p = vector_to_array("probability")
    return risk.transform(out).withColumn("risk", F.when(F.size(p) > 1, F.get(p, F.lit(1))).otherwise(0.0)) \
        .drop("features", "rawPrediction", "probability", "prediction")


def score_efficiency(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """One row per input row: status 'scored' with the predicted label, or 'incomplete' with none."""
    out = model.transform(_to_score(_dealt(rows.select("reading_id", "operation_mode", *MEASURES))))
    label = F.get(F.lit(list(model.stages[1].labels)), F.col("prediction").cast("int"))
    return out.select("reading_id", "status", _if_scored(label).alias("predicted_status"))


def score_failure(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Failure probability in percent with one decimal (class 1 of the forest),
    NULL for incomplete rows."""
    out = model.transform(_to_score(_dealt(rows.select("reading_id", "operation_mode", *MEASURES))))
    p = vector_to_array("probability")
    prob = F.when(F.size(p) > 1, F.get(p, F.lit(1))).otherwise(F.lit(0.0))
    return out.select("reading_id", "status", _if_scored(F.round(prob * 100.0, 1)).alias("failure_probability_pct"))


def score(eff_model: PipelineModel, fail_model: PipelineModel, rows: DataFrame) -> DataFrame:
    """One row per input row, from one scan: status 'scored' with the predicted label and the failure probability
    in percent with one decimal, or 'incomplete' with neither."""
    out = _scored(eff_model, fail_model, _to_score(_dealt(rows.select("reading_id", "operation_mode", *MEASURES))))
    return out.select("reading_id", "status", _if_scored(F.col("predicted_status")).alias("predicted_status"),
                      _if_scored(F.round(F.col("risk") * 100.0, 1)).alias("failure_probability_pct"))


def evaluate(eff_model: PipelineModel, fail_model: PipelineModel, test: DataFrame) -> DataFrame:
    """Held-out quality of both models as (model, metric, value) rows, from the scored complete rows of ``test``."""
    rows = _dealt(test.where(_complete()).select("reading_id", "operation_mode", *MEASURES, "efficiency_status"))
    scored = _scored(eff_model, fail_model, rows.withColumn("failure_label", risk_label()))
    return metrics(scored.select("efficiency_status", "predicted_status", "failure_label", "risk"))


def metrics(scored: DataFrame) -> DataFrame:
    """(model, metric, value) from ``efficiency_status, predicted_status, failure_label, risk``.

    Accuracy and F1 (weighted by a class's true rows) follow from the confusion matrix, one aggregate.
    The area under the ROC curve is the rank sum of the positive rows, ties by half: positions among all rows are found
    range by range, so no task sorts them all.  Rows without a status count for the failure model only;
    a metric without its rows (or without both classes) is NULL.
    """
    known = scored.where(F.col("efficiency_status").isNotNull())
    cells = known.groupBy(F.col("efficiency_status").alias("t"), F.col("predicted_status").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("t").alias("c"), hit.alias("hit"), F.col("n").alias("true"), F.lit(0).cast("bigint").alias("called")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("bigint").alias("hit"), F.lit(0).cast("bigint").alias("true"), F.col("n").alias("called")))))
    classes = sides.groupBy("c").agg(*[F.sum(x).alias(x) for x in ("hit", "true", "called")])
    f1 = F.col("true") * 2.0 * F.col("hit") / (F.col("true") + F.col("called"))
    efficiency = classes.agg(try_ratio(F.sum("hit"), F.sum("true")).alias("accuracy"), try_ratio(F.sum(f1), F.sum("true")).alias("f1"))
    placed = positions(scored, ["failure_label"], {"risk": F.col("risk")})
    positive = F.col("failure_label") == 1
    middle = F.col("before") + (F.col("ties") + 1) / 2
    n1, n0 = F.sum(F.when(positive, 1).otherwise(0)), F.sum(F.when(positive, 0).otherwise(1))
    auc = try_ratio(F.sum(F.when(positive, middle)) - n1 * (n1 + 1) / 2, n1 * n0)
    failure = placed.agg(auc.alias("area_under_roc"))
    return efficiency.select(F.lit("efficiency").alias("model"), F.inline(F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("accuracy", "f1")]))) \
        .unionByName(failure.select(F.lit("failure").alias("model"), F.lit("area_under_roc").alias("metric"), F.col("area_under_roc").alias("value")))
