"""Tree models: training with class weights, scoring, importances, explanation, and runs with their baseline."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, fields, replace

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import evaluate, registry, report, split
from gridloom.plans.shared import drop_path, workdir
from gridloom.sources.schema import available_features, check_features


@dataclass(frozen=True)
class TrainRequest:
    features: list[str] = field(default_factory=list)
    model_type: str = "forest"
    trees: int = 100
    depth: int = 10
    min_leaf: int = 2
    min_split: int = 5
    test_tenths: int = 2
    spatial_split: bool = True
    buffer_km: float = 0.0
    seed: int = 42


#: Training rows of a core from which on they are dealt out evenly, and rows that a task then has at most.
LEARN_FROM, LEARN_ROWS = 20_000, 600_000


def _evenly(train: DataFrame, rows: int, key: str) -> DataFrame:
    """``train`` in as many even parts as there are cores, or twice, three times as many where it has many ``rows``. A learner keeps its rows where they are and goes over them once for each level of
    its trees, so that by files, one part more than there are cores makes every level last twice as long. Parts are by ``key`` and in its order: learners draw by a row's place, and so
    reruns on as many cores draw the same."""
    cores = train.sparkSession.sparkContext.defaultParallelism
    if key not in train.columns or rows < cores * LEARN_FROM:
        return train
    return train.repartition(cores * -(-rows // (cores * LEARN_ROWS)), key).sortWithinPartitions(key)


def fit(train: DataFrame, features: list[str], request: TrainRequest, label: str = "high_risk", key: str = "cell_id") -> PipelineModel:
    """A weighted forest or boosted trees; rows of a class weigh rows / (2 * the class's rows)."""
    classes = evaluate.class_weights(train, label).collect()  # two rows
    weights = {r.label: r.weight for r in classes}
    train = _evenly(train, sum(r.n for r in classes), key)
    weight = F.when(F.col(label) == 1, weights.get(1, 1.0)).otherwise(weights.get(0, 1.0))
    assembled = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    common = {"featuresCol": "features", "labelCol": label, "weightCol": "__weight", "seed": request.seed, "minInstancesPerNode": request.min_leaf}
    if request.model_type == "boosted":
        model = GBTClassifier(maxIter=request.trees, maxDepth=min(request.depth, 6), stepSize=0.1, **common)
    else:
        model = RandomForestClassifier(numTrees=request.trees, maxDepth=request.depth, featureSubsetStrategy="sqrt", impurity="gini", **common)
    fitted = Pipeline(stages=[assembled, model]).fit(train.withColumn("__weight", weight))
    return fitted if request.model_type == "boosted" else PipelineModel([fitted.stages[0], least_split(fitted.stages[1], request.min_split)])


def _kept_nodes(tree: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one tree that are left once splits marked ``cut`` are leaves, numbered anew in the order that a saved tree has: a node, its left side, its right side."""
    nodes = {r.id: r for r in tree.itertuples()}
    order, below = [], [0]
    while below:
        node = nodes[below.pop()]
        order.append(node.id)
        if node.left >= 0 and not node.cut:
            below += [node.right, node.left]
    new = {old: k for k, old in enumerate(order)}
    child = lambda n, side: -1 if n.cut or getattr(n, side) < 0 else new[getattr(n, side)]
    return pd.DataFrame([(nodes[i].treeID, i, new[i], child(nodes[i], "left"), child(nodes[i], "right")) for i in order], columns=["treeID", "id", "new", "left", "right"])


def least_split(forest: RandomForestClassificationModel, least: int) -> RandomForestClassificationModel:
    """``forest`` without splits that fewer than ``least`` rows of their tree's sample (repeats counted) reach. Spark's learner has no such limit; as trees grow
    from the top and a node's rows depend on the splits above it alone, it would have left out these splits and what is below them, and nothing else. The saved node
    table is rewritten, a task a tree (a tree has 2^(depth + 1) nodes at most), and loaded as a model."""
    if least <= 2:
        return forest
    spark = SparkSession.active()
    source, target = workdir(spark, "forest"), workdir(spark, "forest")
    forest.write().save(source)
    forest.write().save(target)
    nodes = spark.read.parquet(f"{source}/data")
    cut = (F.col("nodeData.leftChild") >= 0) & (F.col("nodeData.rawCount") < least)
    flat = nodes.select("treeID", F.col("nodeData.id").alias("id"), F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"), cut.alias("cut"))
    kept = flat.groupBy("treeID").applyInPandas(_kept_nodes, "treeID int, id int, new int, left int, right int")
    leaf = F.struct(F.lit(-1).alias("featureIndex"), F.array().cast("array<double>").alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    data, gone = F.col("nodeData"), F.col("left") < 0
    data = data.withField("id", F.col("new")).withField("leftChild", F.col("left")).withField("rightChild", F.col("right"))
    data = data.withField("split", F.when(gone, leaf).otherwise(F.col("nodeData.split"))).withField("gain", F.when(gone, -1.0).otherwise(F.col("nodeData.gain")))
    joined = nodes.withColumn("id", F.col("nodeData.id")).join(kept, ["treeID", "id"])
    joined.select("treeID", data.alias("nodeData")).write.mode("overwrite").parquet(f"{target}/data")
    pruned = RandomForestClassificationModel.load(target)
    for path in (source, target):
        drop_path(spark, path)
    return pruned


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with p, the probability of high risk, p6 in millionths, and predicted (p over a half)."""
    out = model.transform(df).withColumn("p", vector_to_array("probability")[1])
    out = out.withColumn("p6", F.round(F.col("p") * 1e6).cast("long")).withColumn("predicted", (F.col("p") > 0.5).cast("int"))
    return out.select(*df.columns, "p", "p6", "predicted")


def importances(model: PipelineModel, features: list[str], spark) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, values)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def train(cells: DataFrame, request: TrainRequest) -> dict:
    """Validate, mask to forest, split, fit, evaluate: the model, its test rows scored, metrics, sweep and importances (lazy tables)."""
    features = check_features(request.features or available_features(cells))
    features = [f for f in features if f in cells.columns]
    wooded = report.forest(cells)
    if request.spatial_split:
        flagged = split.buffer_exclusion(split.spatial(wooded, test_tenths=request.test_tenths), request.buffer_km)
    else:
        flagged = split.stratified(wooded, test_tenths=request.test_tenths)
    model = fit(flagged.where("NOT is_test"), features, request)
    tested = score(model, flagged.where("is_test"))
    return {"model": model, "features": features, "flagged": flagged, "tested": tested, "metrics": evaluate.metrics(tested), "sweep": evaluate.threshold_sweep(tested), "importances": importances(model, features, cells.sparkSession)}


def train_run(cells: DataFrame, request: TrainRequest, root: str) -> dict:
    """``train``, kept: the model and a row of the run table under ``root``, with parameters, metrics, the dataset's hash, the table of its test rows, the other
    kind of model on the same split, and which of the two its f1 speaks for. ``cells`` should be a written table, as it is read several times."""
    run = train(cells, request)
    other = replace(request, model_type="forest" if request.model_type == "boosted" else "boosted")
    rival = evaluate.metrics(score(fit(run["flagged"].where("NOT is_test"), run["features"], other), run["flagged"].where("is_test"))).first()
    names = ("accuracy", "precision", "recall", "f1")
    own, best = run["metrics"].first(), run["sweep"].where("best").first()
    found = {n: float(own[n]) for n in names} | {f"other_{n}": float(rival[n]) for n in names} | {"best_threshold": best.threshold / 100 if best else 0.5}
    recommended = "primary" if own.f1 >= rival.f1 else "alternative"
    hash_ = registry.fingerprint(report.forest(cells), "cell_id", *run["features"], "high_risk").first().hash
    path = f"{root}/models/{uuid.uuid4().hex}"
    save(run["model"], path)
    params = {f.name: getattr(request, f.name) for f in fields(request)} | {"recommended": recommended}
    run_id = registry.save_run(cells.sparkSession, f"{root}/runs", params, found, run["features"], path, run["tested"].select("cell_id"), hash_)
    return run | {"run_id": run_id, "recommended": recommended, "dataset_hash": hash_}


def calibrate_run(cells: DataFrame, root: str, run_id: str) -> DataFrame:
    """(cell_id, p6, outcome) of the rows that a kept run was tested on, scored by its model."""
    run = registry.get_run(cells.sparkSession, f"{root}/runs", run_id)
    scored = score(load(run.model_path), registry.test_rows(cells, f"{root}/runs", run_id))
    return scored.select("cell_id", "p6", evaluate.outcome(F.col("high_risk"), F.col("predicted")).alias("outcome"))


def retrain(cells: DataFrame, labelled: DataFrame, request: TrainRequest) -> DataFrame:
    """(accuracy, precision, recall, f1 of a run with reviewers' labels) less those of the same run without: same rows, same split, same settings."""
    old, new = train(cells, request)["metrics"], train(labelled, request)["metrics"]
    return metric_delta(new, old)


def metric_delta(new: DataFrame, old: DataFrame) -> DataFrame:
    names = ("accuracy", "precision", "recall", "f1")
    return new.select(*(F.col(n).alias(f"n_{n}") for n in names)).crossJoin(old.select(*names)).select(*((F.col(f"n_{n}") - F.col(n)).alias(f"{n}_delta") for n in names))  # one row


def hold_out_region(cells: DataFrame, region: str, request: TrainRequest) -> DataFrame:
    """Metrics on one region of a model fitted on the others."""
    features = [f for f in check_features(request.features or available_features(cells)) if f in cells.columns]
    model = fit(cells.where(F.col("region") != region), features, request)
    return evaluate.metrics(score(model, cells.where(F.col("region") == region)))


# -- explanation ----------------------------------------------------------------------------------------------------


def leaf_paths(model: PipelineModel) -> tuple[list[tuple[float, list[tuple[int, float, float, float]]]], float, bool]:
    """Every leaf as (value, path), its path one (feature, low, high, share) for each feature on it: the leaf holds low < x <= high, and ``share`` of the rows
    that reach the feature's splits go its way. Also the sum of tree weights, and whether values are probabilities. The nodes are read from the model as it is
    saved: one table instead of a call for each."""
    stage, spark = model.stages[-1], SparkSession.active()
    boosted = "GBT" in type(stage).__name__
    weights = list(stage.treeWeights)
    total = 1.0 if boosted else float(sum(weights))
    path = workdir(spark, "model")
    stage.write().save(path)
    node = "nodeData."
    saved = spark.read.parquet(f"{path}/data").select("treeID", *(F.col(node + c).alias(c) for c in ("id", "prediction", "impurityStats", "leftChild", "rightChild")), F.col("nodeData.split.featureIndex").alias("feature"), F.col("nodeData.split.leftCategoriesOrThreshold").alias("at"))
    nodes = {(r.treeID, r.id): r for r in saved.collect()}
    drop_path(spark, path)
    leaves = []

    def reached(r) -> float:
        return r.impurityStats[0] if boosted else sum(r.impurityStats)

    def walk(tree: int, r, scale: float, path: dict[int, tuple[float, float, float]]) -> None:
        if r.leftChild < 0:
            value = r.prediction if boosted else r.impurityStats[1] / max(sum(r.impurityStats), 1e-300)
            leaves.append((scale * value, [(f, *b) for f, b in path.items()]))
            return
        at, f = r["at"][0], r.feature
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        for child, lo, hi in ((nodes[tree, r.leftChild], low, min(high, at)), (nodes[tree, r.rightChild], max(low, at), high)):
            walk(tree, child, scale, path | {f: (lo, hi, share * reached(child) / reached(r))})

    for tree, weight in enumerate(weights):
        walk(tree, nodes[tree, 0], weight / total, {})
    return leaves, total, not boosted


def group_leaves(leaves: list) -> tuple[float, list[tuple]]:
    """(base, groups): the leaves by the number of features on their path, as arrays of a group's leaves: values, features, lows, highs, shares."""
    base, by = 0.0, {}
    for value, path in leaves:
        base += value * float(np.prod([p[3] for p in path]))
        if path and value:
            by.setdefault(len(path), []).append((value, path))
    groups = []
    for found in by.values():
        part = lambda k: np.array([[p[k] for p in path] for _, path in found])  # noqa: B023, E731
        groups.append((np.array([v for v, _ in found]), part(0).astype(np.int64), part(1), part(2), np.maximum(part(3), 1e-300)))
    return base, groups


#: Numbers that an array of the explanation has at most, and rows that are explained at once (their codes are 16 bits).
EXPLAIN_CELLS, EXPLAIN_ROWS = 1 << 19, 1 << 14


def _adds(value: np.ndarray, share: np.ndarray, keeps: list[np.ndarray]) -> np.ndarray:
    """(features, leaves, cases): what each feature of a leaf's path adds in each case, ``keeps`` telling by feature whether the case keeps to its bounds. A leaf of m features is
    a product game: with o_j for that and z_j for feature j's share, feature i gets value * (o_i - z_i) times the sum over k of k! (m-k-1)! / m! times the coefficient of t^k in the
    product over the others of (z_j + o_j t), which is the integral from 0 to 1 of the product over the others of (z_j (1 - t) + o_j t): a polynomial of
    degree m - 1, so that Gauss's rule with half as many nodes gives it exactly."""
    m, shares = share.shape[1], [share[:, j, None] for j in range(share.shape[1])]
    node, weight = np.polynomial.legendre.leggauss(m // 2 + 1)
    out = np.zeros((m, len(value), keeps[0].shape[-1]))
    for t, w in zip((node + 1) / 2, weight / 2):
        factors = [z * (1 - t) + o * t for z, o in zip(shares, keeps)]
        whole = factors[0] * w
        for factor in factors[1:]:
            whole = whole * factor
        for j, factor in enumerate(factors):
            out[j] += whole / factor
    for j, (z, o) in enumerate(zip(shares, keeps)):
        out[j] *= (o - z) * value[:, None]
    return out


def shap_values(grouped: tuple[float, list[tuple]], x: np.ndarray) -> tuple[float, np.ndarray]:
    """(base, values): path-dependent Shapley values of rows ``x``. What a leaf's features add depends on nothing but which of its bounds a row keeps to: of a path of m features
    that is one of 2^m cases, worked out once for all rows that are explained together, or row by row where rows are fewer. Every value is the same sum in the same order either way."""
    base, groups = grouped
    out = np.zeros(x.shape[::-1])
    ends = [[] for _ in range(x.shape[1])]
    for _, feature, low, high, _ in groups:
        for f in np.unique(feature):
            ends[f] += [low[feature == f], high[feature == f]]
    ends = [np.unique(np.concatenate(e)) if e else np.zeros(0) for e in ends]
    kind = np.min_scalar_type(max(map(len, ends), default=0))  # unsigned: what lies below an interval wraps around to above it
    for start in range(0, len(x), EXPLAIN_ROWS):
        rows = x[start : start + EXPLAIN_ROWS]
        total = out[:, start : start + EXPLAIN_ROWS]
        places = [np.searchsorted(e, rows[:, f]).astype(kind) for f, e in enumerate(ends)]  # ends below a row's value; NaN is past all of them
        for value, feature, low, high, share in groups:
            m = feature.shape[1]
            by_case = 1 << m < len(rows)
            cases = 1 << m if by_case else len(rows)
            after, width = np.zeros(feature.shape, kind), np.zeros(feature.shape, kind)
            for f in np.unique(feature):
                here = feature == f
                lo, hi = np.searchsorted(ends[f], low[here]), np.searchsorted(ends[f], high[here])
                after[here], width[here] = lo + 1, np.maximum(hi - lo, 0)
            keeps = lambda k, j: places[feature[k, j]] - after[k, j] < width[k, j]  # noqa: B023, E731
            bits = [(np.arange(cases) >> j & 1)[None].astype(float) for j in range(m)]
            step = max(1, EXPLAIN_CELLS // (cases * m))
            for first in range(0, len(value), step):
                some = range(first, min(first + step, len(value)))
                known = bits if by_case else [np.stack([keeps(k, j) for k in some]).astype(float) for j in range(m)]
                adds = _adds(value[some.start : some.stop], share[some.start : some.stop], known)
                for i, k in enumerate(some):
                    if by_case:
                        code = np.zeros(len(rows), np.uint16)
                        for j in range(m):
                            code |= keeps(k, j).astype(np.uint16) << j
                        code = code.astype(np.intp)
                    for j in range(m):
                        total[feature[k, j]] += adds[j, i].take(code) if by_case else adds[j, i]
    return base, out.T


def _gathered(batches, rows: int):
    """Arrow batches joined until they have ``rows`` rows."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def explain(model: PipelineModel, df: DataFrame, features: list[str], key: str = "cell_id") -> DataFrame:
    """(key, predicted, base, drivers): what each feature adds to the probability of the class that the model predicts (to the margin of high risk for boosted
    trees), by falling size. The leaves go to each task; their number is bounded by the model's trees and depth. Rows, few bytes and much work each, are dealt to as many
    tasks as a shuffle has, or cores if there are more."""
    leaves, _, is_probability = leaf_paths(model)
    shared = df.sparkSession.sparkContext.broadcast(group_leaves(leaves))

    def run(batches):
        import pyarrow as pa

        names = pa.array(features, pa.string())
        for batch in _gathered(batches, EXPLAIN_ROWS):
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[1:]], axis=1) if batch.num_rows else np.empty((0, len(features)))
            base, values = shap_values(shared.value, x)
            total = base + values.sum(axis=1)
            high = total > (0.5 if is_probability else 0.0)
            bases = np.full(len(x), base)
            if is_probability:  # of the other class, everything turns about
                values = np.where(high[:, None], values, -values)
                bases = np.where(high, base, 1 - base)
            order = np.argsort(-np.abs(values), axis=1, kind="stable")
            flat = order.ravel()
            entries = [names.take(pa.array(flat)), pa.array(np.take_along_axis(x, order, 1).ravel()), pa.array(np.take_along_axis(values, order, 1).ravel())]
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(features), pa.int32())
            rows = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(entries, ["feature", "value", "shap"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(high.astype(np.int32)), pa.array(bases), rows], names=[key, "predicted", "base", "drivers"])

    kind, spark = dict(df.dtypes)[key], df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.select(key, *(F.col(f).cast("double") for f in features)).repartition(tasks, key).mapInArrow(run, f"{key} {kind}, predicted int, base double, drivers array<struct<feature:string,value:double,shap:double>>")


def site_drivers(explained: DataFrame, sites: DataFrame) -> DataFrame:
    """(name, driver, share): of each site (name, cell_id) the feature of the largest sum of absolute contributions; of equals the first by name."""
    long = sites.join(explained, "cell_id").select("name", F.inline("drivers"))
    sums = long.groupBy("name", "feature").agg(F.sum(F.abs("shap")).alias("s"))
    top = sums.groupBy("name").agg(F.min_by("feature", F.struct(-F.col("s"), F.col("feature"))).alias("driver"), F.max("s").alias("s"), F.sum("s").alias("total"))
    return top.select("name", "driver", F.coalesce(F.try_divide("s", "total"), F.lit(0.0)).alias("share"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
