import datetime as dt
import threading

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from kerbwise.learning import encoding, evaluation, models, scoring, search
from kerbwise.learning import features as feat
from kerbwise.operators import filters, spatial, temporal
from kerbwise.plans import registry
from kerbwise.session import new_path, written
from kerbwise.sources import warehouse as wh
from tests.rows import make


@pytest.fixture(scope="module")
def past(incidents):
    return feat.history(temporal.time_features(filters.model_base(incidents)))


@pytest.fixture(scope="module")
def table(incidents, past):
    return feat.feature_table(incidents, past).cache()


@pytest.fixture(scope="module")
def severity(table):
    return models.train_severity_model(table, numTrees=5, maxDepth=4)


def test_feature_rows_match_the_fact(table, incidents):
    assert table.count() == incidents.count()
    assert table.where("cell_density < 1 OR neighbor_density <= 0").count() == 0
    direct = incidents.groupBy("city").agg(F.stddev_samp("severity").alias("s"))
    gap = table.join(direct, "city").where("abs(s - city_severity_std) > 1e-9")
    assert gap.count() == 0


def test_single_incident_has_no_deviation(spark):
    rows = feat.feature_table(make(spark, {"city": "A"}, {"city": "B"}, {"city": "B"})).collect()
    got = {r.city: r.city_severity_std for r in rows}
    assert got["A"] is None and got["B"] == 0.0


def test_codes_are_ranks(spark):
    words = ["b", "a", "ab", "aa", "abc", "Z", "é", "", "ba", "a b"]
    df = spark.createDataFrame([(w,) for w in words * 3] + [(None,)], "w string")
    codes = {r.value: r.code for r in encoding.fit_encoders(df, ["w"]).collect()}
    assert codes == {w: i for i, w in enumerate(sorted({*words, "None"}, key=lambda s: s.encode()))}
    unseen = encoding.encode(spark.createDataFrame([("zz",), ("b",)], "w string"), encoding.fit_encoders(df, ["w"]), ["w"])
    assert {r.w: r.w_encoded for r in unseen.collect()} == {"zz": 0, "b": codes["b"]}


def test_standardised_columns(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 5), (None, 5), (3.0, 5)], "a double, b int")
    z = encoding.scale(df, encoding.fit_scaler(df, ["a", "b"]))
    row = z.agg(F.avg("a_z").alias("m"), F.stddev_pop("a_z").alias("s"), F.max(F.abs("b_z")).alias("b")).first()
    assert row.m == pytest.approx(0, abs=1e-12) and row.s == pytest.approx(1.0) and row.b == 0.0


@pytest.mark.parametrize("fraction", [0.8, 0.0, 1.0])
def test_split_is_exact_in_each_stratum(spark, fraction):
    df = spark.range(2000).select(
        F.col("id"), F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").otherwise("low").alias("c")
    )
    rows = (
        encoding.stratified_split(df, "id", "c", fraction)
        .groupBy("c").agg(F.count("*").alias("n"), F.count_if("is_train").alias("t")).collect()
    )
    assert {r.c: r.t for r in rows} == {r.c: int(r.n * fraction) for r in rows} and len(rows) == 3


@pytest.mark.parametrize("most", [1, 40, 100_000])
def test_split_narrows_to_the_same_rows_whatever_its_bound(spark, most, monkeypatch):
    import hashlib

    monkeypatch.setattr(encoding, "DIGEST_LEVEL", 1)  # buckets of a sixteenth: several narrowings
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.lit("one")).alias("c"))  # null is a stratum too
    got = {r.id for r in encoding.stratified_split(df, "id", "c", 0.8, most).where("is_train").collect()}
    want = set()
    for group in ([i for i in range(3000) if i % 3], [i for i in range(3000) if i % 3 == 0]):
        want |= set(sorted(group, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[: int(len(group) * 0.8)])
    assert got == want


def test_split_counts_repeated_ids_before_it_orders_them(spark):
    df = spark.range(1000).select(F.lit(7).alias("id"), F.lit("only").alias("c")).union(spark.range(10).select("id", F.lit("few").alias("c")))
    rows = encoding.stratified_split(df, "id", "c", 0.5, most=10).groupBy("c", "is_train").count().collect()
    assert {(r.c, r.is_train): r["count"] for r in rows} == {("only", True): 1000, ("few", True): 5, ("few", False): 5}
    empty = encoding.stratified_split(df.where("false"), "id", "c")
    assert empty.count() == 0 and encoding.stratified_split(df, "id", "c", 0.0).where("is_train").count() == 0


def test_report_of_a_fixed_table(spark):
    pairs = [(0, 0)] * 6 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(1, 0)] + [(2, 0)] * 2  # class 2 is never predicted
    df = spark.createDataFrame(pairs, "label int, prediction int")
    got = {r["class"]: r for r in evaluation.classification_report(df, models.CLASS_NAMES).collect()}
    assert (got["Minor"].precision, got["Minor"].recall, got["Minor"].support) == (6 / 9, 6 / 8, 8)
    assert (got["Fatal"].precision, got["Fatal"].recall, got["Fatal"].f1, got["Fatal"].support) == (0, 0, 0, 2)
    assert got["accuracy"].f1 == 9 / 14 == evaluation.accuracy(df)
    assert got["macro avg"].recall == pytest.approx((6 / 8 + 3 / 4 + 0) / 3)
    assert got["weighted avg"].recall == pytest.approx(9 / 14)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0)], "label double, prediction double")
    row = evaluation.regression_metrics(df).first()
    assert row.mse == pytest.approx(2 / 3) and row.r2 == pytest.approx(0.0)


def test_severity_model(severity, table):
    model, matrix = severity
    assert len(model.features) == 21
    out = model.apply(matrix)
    p = out.select(F.explode(F.array(F.lit(0))).alias("_"), "probability", "prediction").collect()
    assert all(abs(sum(r.probability) - 1) < 1e-9 and r.prediction in (0.0, 1.0, 2.0) for r in p)
    split = {r.is_train: r["count"] for r in matrix.groupBy("is_train").count().collect()}
    assert abs(split[True] - 0.8 * table.count()) <= 3
    assert 0 <= model.metrics["test_accuracy"] <= 1
    names = [r.feature for r in model.importance().collect()]
    assert sorted(names) == sorted(model.features)
    report = {r["class"] for r in models.severity_report(model, matrix).collect()}
    assert {"accuracy", "macro avg", "weighted avg"} <= report


def test_boosted_model_and_reload(table, spark):
    model, matrix = models.train_severity_model(table, "boosted", maxIter=2, maxDepth=2)
    path = new_path(spark, "model")
    model.save(path)
    back = models.FittedModel.load(spark, path)
    assert back.features == model.features and back.metrics == model.metrics
    key = ["accident_id", "prediction"]
    assert back.apply(matrix).select(key).exceptAll(model.apply(matrix).select(key)).count() == 0
    assert back.predict(table).select(key).exceptAll(model.apply(matrix).select(key)).count() == 0
    sums = model.apply(matrix).select("probability").limit(20).collect()
    assert all(abs(sum(r.probability) - 1) < 1e-9 for r in sums)
    with pytest.raises(ValueError):
        models.train_severity_model(table, "nearest")


def test_fits_run_one_at_a_time_where_one_keeps_every_core_busy(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(models, "PARTITION_ROWS", 10)
    few, busy = 10 * models.TRAIN_PARTITIONS, 10 * (models.TRAIN_PARTITIONS + cores)
    assert [models.fits_at_once(spark, rows, 3) for rows in (0, few, busy)] == [3, 3, 1]
    monkeypatch.setattr(models, "TRAIN_PARTITIONS", 0)
    assert models.fits_at_once(spark, 10, 3) == min(3, cores)  # a fit of one task leaves cores for others


@pytest.mark.parametrize("many", [False, True])
def test_many_rows_are_boosted_class_by_class(table, monkeypatch, many):
    running, most, lock = set(), [], threading.Lock()
    fit = models.GBTClassifier.fit

    def watched(self, rows, *args):
        with lock:
            running.add(threading.get_ident())
            most.append(len(running))
        try:
            assert "InMemoryTableScan" in rows._jdf.queryExecution().executedPlan().toString()  # the kept layout
            return fit(self, rows, *args)
        finally:
            with lock:
                running.discard(threading.get_ident())

    monkeypatch.setattr(models.GBTClassifier, "fit", watched)
    if many:
        monkeypatch.setattr(models, "PARTITION_ROWS", 20)
    model, matrix = models.train_severity_model(table, "boosted", maxIter=2, maxDepth=2)
    assert len(model.stages) == 3 and (max(most) == 1 if many else max(most) > 1)


def test_many_rows_are_searched_with_one_forest_at_a_time(table, monkeypatch):
    pools = []
    search_ = models.search_forests
    monkeypatch.setattr(models, "search_forests", lambda *args: pools.append(args[-1]) or search_(*args))
    forest = RandomForestClassifier(seed=1, numTrees=2, maxDepth=1)
    grid = [{forest.maxDepth: d} for d in (1, 2)]
    results = [models.tune_severity_model(table, grid, forest, folds=2, parallelism=2)[2].collect()]
    monkeypatch.setattr(models, "fits_at_once", lambda *_: 1)
    results.append(models.tune_severity_model(table, grid, forest, folds=2, parallelism=2)[2].collect())
    assert pools == [2, 1] and results[0] == results[1]


def test_search(table):
    forest = RandomForestClassifier(seed=1, numTrees=2)
    grid = [{forest.maxDepth: d} for d in (1, 2)]
    model, _, results = models.tune_severity_model(table, grid, forest, folds=2, parallelism=2)
    assert results.count() == 2 and model.metrics["test_accuracy"] > 0
    grid = models.severity_grid(forest)
    plan = search.structures(forest, grid)
    assert len(grid) == 24 and len(plan) == 4
    assert all(sorted(one.sizes) == [(t, d) for t in (100, 200) for d in (3, 5, 7)] for one in plan)
    assert {p.name: v for p, v in plan[0].params.items()}["numTrees"] == 200


@pytest.fixture(scope="module")
def planted(spark):
    """Four features; the class follows from two of them, with noise."""
    cols = [F.rand(k).alias(f"x{k}") for k in range(4)]
    rows = spark.range(0, 1500, 1, 4).select("id", *cols)
    label = (F.floor(F.col("x1") * 2) + (F.col("x3") > 0.6).cast("int") + (F.rand(9) > 0.9).cast("int")) % 3
    rows = rows.withColumn("label", label.cast("double"))
    rows = VectorAssembler(inputCols=["x0", "x1", "x2", "x3"], outputCol="features").transform(rows)
    return written(rows.select("id", "label", "features"), "planted").repartition(4, "id").sortWithinPartitions("id")


def folded(train, seed, folds):
    return train.withColumn("fold", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(folds)).cast("int"))


def test_forests_cut_in_depth_equal_forests_grown_to_that_depth(planted):
    forest = RandomForestClassifier(seed=5, numTrees=7, featureSubsetStrategy="all")  # no draw of features to differ
    grid = [{forest.maxDepth: d} for d in (1, 2, 3, 5)]
    best, results = search.search_forests(planted, forest, grid, folds=3, parallelism=2)
    got = {int(r.params["maxDepth"]): r.accuracy for r in results.collect()}
    rows = folded(planted, 5, 3)
    for params in grid:
        shares = []
        for k in range(3):
            fitted = forest.fit(rows.where(F.col("fold") != k), params)
            shares.append(evaluation.accuracy(fitted.transform(rows.where(F.col("fold") == k))))
        assert got[list(params.values())[0]] == pytest.approx(sum(shares) / 3, abs=1e-12)
    assert best.getMaxDepth() == max(sorted(got), key=lambda d: got[d]) and len(set(got.values())) > 1


def test_forests_cut_in_number_vote_with_their_first_trees(spark, planted):
    forest = RandomForestClassifier(seed=6, numTrees=9, maxDepth=4, featureSubsetStrategy="sqrt", subsamplingRate=0.8)
    fitted = forest.fit(planted)
    rows = planted.orderBy("id").limit(300).collect()
    x = np.array([r.features.toArray() for r in rows])
    sizes = [(1, 4), (3, 4), (9, 4)]
    got = search.Nodes.of(fitted, spark).predictions(x, sizes)
    for (trees, _), classes in zip(sizes, got):
        votes = [sum(t.predictProbability(r.features).toArray() for t in fitted.trees[:trees]) for r in rows]
        assert classes.tolist() == [int(v.argmax()) for v in votes]
    assert got[2].tolist() == [int(r.prediction) for r in fitted.transform(planted).orderBy("id").limit(300).collect()]


def test_single_trees_and_missing_folds(spark, planted):
    forest = RandomForestClassifier(seed=2, maxDepth=2)
    grid = [{forest.numTrees: n} for n in (1, 4, 2)]
    assert [sorted(one.sizes) for one in search.structures(forest, grid)] == [[(1, 2)], [(2, 2), (4, 2)]]
    few = planted.limit(3).repartition(1, "id")
    _, results = search.search_forests(few, forest, grid[1:], folds=7, parallelism=3)  # most folds hold no row
    assert results.count() == 2 and all(0 <= r.accuracy <= 1 for r in results.collect())
    one_class = planted.withColumn("label", F.lit(0.0)).limit(50).repartition(2, "id")
    _, results = search.search_forests(one_class, forest, grid, folds=2)
    assert [r.accuracy for r in results.collect()] == [1.0, 1.0, 1.0]


def test_top_features_name_what_the_label_follows(table):
    outcome = table.withColumn("severity", F.when(F.col("hour") >= 12, 3).otherwise(1) + F.lit(0))
    model, _ = models.train_severity_model(outcome, numTrees=12, maxDepth=3)
    top = model.top_features().orderBy("position").collect()
    assert [r.position for r in top] == [1, 2, 3, 4, 5] and top[0].feature == "hour"
    assert [r.importance for r in top] == sorted((r.importance for r in top), reverse=True)
    assert {r.feature for r in top} <= set(model.features)


def test_hotspot_model_leaves_out_the_label(incidents):
    profiles = spatial.cell_profile(incidents)
    model, matrix = models.train_hotspot_model(profiles, maxIter=2, maxDepth=2)
    assert "density_score" not in model.features and matrix.count() == profiles.count()
    least = profiles.where("is_hotspot = 1").agg(F.min("accident_count")).first()[0]
    path = new_path(incidents.sparkSession, "hotspot-model")
    model.save(path)
    assert models.FittedModel.load(incidents.sparkSession, path).settings == {"hotspot_incidents": least}
    leaky, _ = models.train_hotspot_model(profiles, include_density=True, maxIter=2, maxDepth=2)
    assert "density_score" in leaky.features and len(leaky.features) == 7
    assert leaky.metrics["test_accuracy"] >= model.metrics["test_accuracy"]


def test_casualty_model(table):
    model, _ = models.train_casualty_model(table, numTrees=3, maxDepth=3)
    assert len(model.features) == 17 and model.metrics["mse"] > 0


def test_scoring(spark, small, severity, past):
    model, _ = severity
    requests = wh.trip_requests(spark, small)
    rows = scoring.score_requests(requests, model, past, dt.date(2001, 8, 1)).collect()
    assert len(rows) == requests.count() and len({r.request_id for r in rows}) == len(rows)
    invalid = [r for r in rows if r.reasons]
    assert len(rows) - len(invalid) == scoring.valid_requests(requests).count() < len(rows)
    assert all(r.risk_score is None and r.severity_probabilities is None for r in invalid)
    for r in (r for r in rows if not r.reasons):
        p = r.severity_probabilities
        assert list(sorted(p)) == ["Fatal", "Minor", "Serious"] and sum(p.values()) == pytest.approx(1)
        assert 1 <= r.risk_score <= 3 and r.predicted_severity in (1, 2, 3) and r.recommendations
        assert r.risk_score == pytest.approx(p["Minor"] + 2 * p["Serious"] + 3 * p["Fatal"])


def test_evidence_boosts_beside_its_forests_and_fills_few_histograms_at_a_time(spark, small, monkeypatch):
    begun, beside, passes = threading.Event(), [], []
    forest, boosting, casualty = models.train_severity_model, models.train_hotspot_model, models.train_casualty_model

    def severity_forest(rows, **params):
        begun.set()
        out = forest(rows, numTrees=3, maxDepth=2, **params)
        passes.append(out[0].stages[0].getMaxMemoryInMB())
        beside.append(ended.wait(120))  # the boosted model needs nothing of the forests
        return out

    def boosted(rows):
        assert begun.wait(120)
        out = boosting(rows, maxIter=2, maxDepth=2)
        ended.set()
        return out

    def casualties(rows, **params):
        out = casualty(rows, numTrees=3, maxDepth=2, **params)
        passes.append(out[0].stages[0].getMaxMemoryInMB())
        return out

    ended = threading.Event()
    monkeypatch.setattr(models, "train_severity_model", severity_forest)
    monkeypatch.setattr(models, "train_hotspot_model", boosted)
    monkeypatch.setattr(models, "train_casualty_model", casualties)
    rows = registry.learning_evidence(spark, small).collect()
    assert beside == [True] and len(passes) == 2 and max(passes) < 256
    assert {r.subject for r in rows} >= {"severity", "hotspot", "casualty", "score"} and all(r.unsound == 0 for r in rows)


def test_request_defaults_where_nothing_is_known(spark, past):
    request = spark.createDataFrame(
        [(1, -40.0, 10.0, 18, "Hovercraft", "Canal", None)],
        "request_id long, latitude double, longitude double, hour int, vehicle_type string, road_type string, weather string",
    )
    row = scoring.request_features(request, past, dt.date(2024, 1, 6)).first()
    assert (row.cell_density, row.city_avg_severity, row.city_severity_std, row.city_avg_casualties) == (0, 2.0, 0.5, 1.5)
    assert (row.road_type_risk, row.vehicle_type_risk, row.city, row.weather) == (2.0, 2.0, "Unknown", "Clear")
    assert (row.is_weekend, row.is_rush_hour, row.season) == (1, 1, "Winter")


def test_unseen(spark, incidents):
    codes = encoding.fit_encoders(incidents, ["vehicle_type"])
    df = make(spark, {"vehicle_type": "Tractor"}, {"vehicle_type": "Tractor"}, {"vehicle_type": None}, {})
    got = {r.value: r["rows"] for r in encoding.unseen_values(df, codes, ["vehicle_type"]).collect()}
    assert got == {"Tractor": 2, "None": 1}


def test_many_labels_of_one_prefix_are_ranked_over_many_ranges(spark):
    from pyspark.sql import functions as F

    from kerbwise.learning.encoding import fit_encoders

    rows = spark.range(100_000).select(F.format_string("same-%06d", (F.col("id") * 7919) % 100_000).alias("a"), F.lit(None).cast("string").alias("b"))
    codes = fit_encoders(rows, ["a", "b"])
    assert codes.where("feature = 'a' and cast(substring(value, 6) as int) != code").count() == 0
    assert codes.count() == 100_001 and codes.where("feature = 'b'").first().code == 0
