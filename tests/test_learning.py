import itertools

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ontime.operators import evaluate, features, models, rejects, sampling, score
from ontime.plans import training
from ontime.sources import catalog, shared
from tests.conftest import plan_of


@pytest.fixture(scope="module")
def flights(spark):
    """Flights whose weather delay follows the wind and the weather code."""
    i = F.col("id")
    wind = (F.xxhash64(i, F.lit("wind")) % 100 + 100) % 100
    code = F.when((F.xxhash64(i, F.lit("code")) % 4 == 0), "RA").otherwise("0")
    table = spark.range(6000).select(
        F.lit(2006).alias("Year"), (i % 12 + 1).cast("int").alias("Month"), (i % 28 + 1).cast("int").alias("Day"),
        (i % 7 + 1).cast("int").alias("DayOfWeek"), (i % 24).cast("int").alias("CRSDepHour"),
        F.element_at(F.array(*map(F.lit, ["AA", "UA", "aa", "09"])), (i % 4 + 1).cast("int")).alias("UniqueCarrier"),
        F.concat(F.lit("A"), i % 10).alias("Origin"), F.concat(F.lit("B"), i % 8).alias("Dest"),
        wind.cast("int").alias("MaxWindSpeed"), F.lit(1000).alias("MinCeilingHeight"), F.lit(500).alias("MinVisibility"),
        F.lit(10000).alias("MaxPressure"), F.when(i % 5 != 0, 1.5).alias("MaxPrecipitation48"), code.alias("MaxPresentWeatherCode"),
        F.col("id").cast("string").alias("FlightNum"),
    )
    delay = F.when((F.col("MaxWindSpeed") > 60) | (F.col("MaxPresentWeatherCode") == "RA"), F.col("MaxWindSpeed") + 1).otherwise(0)
    return shared.materialize(table.withColumn("WeatherDelay", delay.cast("int")), "flights")


@pytest.fixture(scope="module")
def domain(flights):
    return features.fit_domain_index(flights, features.categories(True))


@pytest.fixture(scope="module")
def parts(flights):
    return [shared.materialize(p, "part") for p in sampling.split(features.delay_examples(flights), [0.7, 0.3], 3)]


def test_examples(spark, flights):
    examples = features.delay_examples(flights)
    assert examples.count() == 6000 and examples.where("MaxPrecipitation48 = 9999").count() == 1200
    assert examples.where("label = 1").count() == flights.where("WeatherDelay > 0").count()
    unknown = flights.withColumn("WeatherDelay", F.lit(None).cast("int"))
    assert features.delay_examples(unknown).count() == features.minutes_examples(unknown).count() == 0
    holes = flights.withColumn("MinVisibility", F.lit(None).cast("int"))
    assert features.delay_examples(holes).count() == 0
    assert features.minutes_examples(holes).select("MinVisibility").distinct().collect()[0][0] == 999999
    buckets = {r.delayCat for r in features.bucket_examples(flights).select("delayCat").distinct().collect()}
    assert len(buckets) == 4 and None not in buckets


def test_domain_index(spark, flights, domain):
    assert [list(labels) for labels in domain.labelsArray][0] == ["09", "AA", "UA", "aa"]
    odd = spark.createDataFrame([("AA", "A0", "B0", "0"), ("??", None, "B0", None)], "UniqueCarrier string, Origin string, Dest string, MaxPresentWeatherCode string")
    rows = domain.transform(odd).collect()
    assert (rows[0].UniqueCarrierIndex, rows[1].UniqueCarrierIndex, rows[1].OriginIndex, rows[1].MaxPresentWeatherCodeIndex) == (1.0, 4.0, 10.0, 2.0)


def test_label_index_and_decoder(spark):
    table = spark.createDataFrame([("b",), ("b",), ("a",), ("c",), ("c",), ("c",)], "delayCat string")
    model = features.fit_label_index(table, "delayCat")
    assert list(model.labelsArray[0]) == ["c", "b", "a"]
    predicted = spark.createDataFrame([(0.0,), (2.0,)], "prediction double")
    decoded = features.label_decoder(model).transform(predicted).collect()
    assert [r.predictedLabel for r in decoded] == ["c", "a"]


@pytest.mark.parametrize("with_weather, size", [(False, 4 + 4 + 10 + 8), (True, 4 + 4 + 10 + 8 + 5 + 2)])
def test_vectors(flights, domain, with_weather, size):
    one = flights.orderBy("FlightNum").limit(1)
    index = domain if with_weather else features.fit_domain_index(flights, features.categories(False))
    table = features.delay_examples(one)
    for stage in features.feature_stages(index, with_weather):
        table = (stage.fit(table) if hasattr(stage, "fit") else stage).transform(table)
    vector = table.select(vector_to_array("features")).first()[0]
    assert len(vector) == size and vector[:4] == [1.0, 1.0, 1.0, 0.0]


def test_sampling(flights):
    by_key = sampling.sample_by_key(flights, F.col("FlightNum").cast("bigint"), 10, 3)
    assert by_key.count() == 1800
    labelled = flights.withColumn("label", F.when(F.col("WeatherDelay") > 0, 1).otherwise(0))
    late = labelled.where("label = 1").count()
    kept = sampling.balance_by_key(labelled, "label", {0: (50, 1)}, F.col("FlightNum").cast("bigint"))
    assert kept.where("label = 1").count() == late and 0 < kept.where("label = 0").count() < 200
    drawn = sampling.balance(labelled, "label", {1: 1.0, 0: 0.1}, seed=5)
    assert drawn.where("label = 1").count() == late
    assert 0.05 < drawn.where("label = 0").count() / (6000 - late) < 0.15
    assert 400 < sampling.sample_rows(flights, 0.1, seed=1).count() < 800
    first, second = sampling.split(flights, [0.8, 0.2], seed=10)
    assert first.count() + second.count() == 6000 and first.intersect(second).count() == 0
    both = sampling.stack(sampling.with_label(flights, 1), sampling.with_label(flights, 0))
    assert both.count() == 12000


def test_weather_helps_the_forest_and_the_regression(flights, domain, parts):
    training, test = parts
    plain = features.fit_domain_index(flights, features.categories(False))
    for fit in (models.fit_delay_forest, models.fit_delay_logistic):
        alone = evaluate.auroc(fit(training, False, plain).transform(test))
        model = fit(training, True, domain)
        made = model.transform(test)
        informed, hard = evaluate.auroc(made), evaluate.auroc(made, "prediction")
        assert informed > 0.85 and informed > alone + 0.2 and 0.5 <= hard <= informed
    assert evaluate.training_auroc(model) > 0.85
    curve = evaluate.roc_curve(model).collect()
    assert (curve[0].FPR, curve[0].TPR, curve[-1].FPR, curve[-1].TPR) == (0.0, 0.0, 1.0, 1.0)
    assert all(a.FPR <= b.FPR and a.TPR <= b.TPR for a, b in zip(curve, curve[1:]))


def test_grid_search(domain, parts):
    training, test = parts
    best, validated = models.cross_validate(training, True, domain, folds=2)
    assert len(validated.avgMetrics) == 9 and max(validated.avgMetrics) > 0.85
    assert evaluate.auroc(best.transform(test)) > 0.85


def test_bucket_forest(flights, domain):
    examples = features.bucket_examples(flights)
    model = models.fit_bucket_forest(examples, True, domain, num_trees=5, max_depth=6)
    made = model.transform(examples)
    assert evaluate.accuracy(made, "delayCat", "predictedLabel").first().accuracy > 0.7
    by_index = evaluate.accuracy(made, "delayCatInd").first()
    assert by_index.accuracy == evaluate.accuracy(made, "delayCat", "predictedLabel").first().accuracy
    assert by_index.test_error == pytest.approx(1 - by_index.accuracy)


def test_minutes_models(flights, domain):
    examples = shared.materialize(features.minutes_examples(flights), "minutes")
    linear = models.fit_minutes_linear(examples, domain)
    fit = evaluate.training_fit(linear)
    made = linear.transform(examples)
    assert fit["training_r2"] > 0.5
    assert evaluate.rmse(made, "LogWeatherDelay").first().rmse == pytest.approx(fit["training_rmse"])
    forest = models.fit_minutes_forest(examples, domain).transform(examples)
    data = forest.select("WeatherDelay", "prediction").toPandas()
    want = ((data.WeatherDelay - 10**data.prediction) ** 2).mean() ** 0.5
    assert evaluate.rmse_minutes(forest).first().rmse_minutes == pytest.approx(want)


def test_clusters(spark):
    rows = [(0,)] * 50 + [(10,)] * 40 + [(100,)] * 30 + [(1000,)] * 20 + [(None,)] * 5
    table = spark.createDataFrame(rows, "WeatherDelay int")
    costs = {r.k: r.cost for r in models.elbow(table, range(2, 5)).collect()}
    assert costs[2] > costs[3] > costs[4] == pytest.approx(0, abs=1e-9)
    centres = models.cluster_minutes(models.fit_delay_clusters(table, 4), spark).collect()
    assert [round(r.minutes, 6) for r in centres] == [1, 10, 100, 1000]


def test_requests(spark):
    lines = ["9,1,6,6,AA,SFO,JFK", "9,1,6,6,AA,SFO,JFK,10,1000,1200,10250,0, FG ", "12,24,1", "x,1,6,6,AA,SFO,JFK", "9,1,6,6,AA,SFO,JFK,10,y,1200,10250,0,FG"]
    requests = catalog.request_frame(spark, lines)
    parsed = score.parse_requests(requests)
    assert parsed.count() == 2
    assert score.parse_requests(requests, on_bad="keep").where("not valid").count() == 3
    short, full = score.fill_missing_weather(parsed).collect()
    assert tuple(short)[1:] == (9.0, 1.0, 6.0, 6.0, "AA", "SFO", "JFK", 9999.0, 99999.0, 999999.0, 99999.0, 9999.0, "0")
    assert tuple(full)[1:] == (9.0, 1.0, 6.0, 6.0, "AA", "SFO", "JFK", 10.0, 1000.0, 1200.0, 10250.0, 0.0, "FG")
    with pytest.raises(ValueError):
        score.parse_requests(requests, on_bad="other")


def test_two_stage_scores(spark, tmp_path, flights, domain, parts):
    classifier = models.fit_delay_logistic(parts[0], True, domain)
    regressor = models.fit_minutes_linear(features.minutes_examples(flights), domain)
    lines = ["9,1,6,6,AA,A1,B1", "9,1,6,6,AA,A1,B1,95,1000,500,10000,2,RA", "9,1,6,6,AA,A1,B1,1,1000,500,10000,2,0", "9,1,6,6,??,??,??,95,1000,500,10000,2,??"]
    requests = score.fill_missing_weather(score.parse_requests(catalog.request_frame(spark, lines)))
    scored = score.score(requests, classifier, regressor)
    assert scored.columns == requests.columns + ["predicted_delay", "result"]
    rows = {r.request: r for r in scored.collect()}
    assert rows[lines[1]].predicted_delay == 1.0 and rows[lines[1]].result > 20
    assert (rows[lines[2]].predicted_delay, rows[lines[2]].result) == (0.0, 0.0)
    # The batch gives what the two models give one after the other.
    one = requests.where(F.col("request") == lines[1])
    minutes = 10 ** regressor.transform(one).first().prediction
    assert rows[lines[1]].result == pytest.approx(minutes)
    # Saved and loaded models score the same.
    catalog.save_model(classifier, str(tmp_path / "c"))
    catalog.save_model(classifier, str(tmp_path / "c"))
    catalog.save_model(regressor, str(tmp_path / "r"))
    again = score.score(requests, catalog.load_model(str(tmp_path / "c")), catalog.load_model(str(tmp_path / "r")))
    assert {r.request: r.result for r in again.collect()} == {r.request: r.result for r in rows.values()}


def test_requests_are_assembled_once(spark, flights, domain, parts):
    classifier = models.fit_delay_logistic(parts[0], True, domain)
    regressor = models.fit_minutes_forest(features.minutes_examples(flights), features.fit_domain_index(flights, features.categories(True)))
    requests = score.fill_missing_weather(score.parse_requests(catalog.request_frame(spark, ["9,1,6,6,AA,A1,B1,95,1000,500,10000,2,RA"])))
    assert score.same_features(classifier, regressor)
    both = score.score(requests, classifier, regressor)
    # Three indexes, three encoders and one assembler are functions of the plan; two passes would have twice as many.
    plan = plan_of(both)
    assert plan.count("UDF(struct(") == 1
    one_by_one = classifier.transform(requests).select("prediction").first()[0], 10 ** regressor.transform(requests).first().prediction
    assert (both.first().predicted_delay, both.first().result) == (one_by_one[0], pytest.approx(one_by_one[1]))
    other = models.fit_minutes_linear(features.minutes_examples(flights), features.fit_domain_index(flights.where("Month < 3 and Origin <> 'A1'"), features.categories(True)))
    assert not score.same_features(classifier, other)
    assert score.score(requests, classifier, other).first().predicted_delay == one_by_one[0]
    with pytest.raises(ValueError):
        score.two_stage(classifier, other)


def test_rejected_requests_are_counted(spark):
    session = rejects.counting_session(spark)
    seen = rejects.Counted("requests")
    lines = ["9,1,6,6,AA,SFO,JFK", "12,24,1", "x,1,6,6,AA,SFO,JFK", ""]
    assert score.parse_requests(catalog.request_frame(session, lines), counted=seen).count() == 1
    assert seen.metrics() == {"requests_read": 4, "requests_rejected": 3}


def test_models_are_fitted_after_rows_were_counted(spark, domain, parts):
    """The session that counts is another one, so this one still fits."""
    test_rejected_requests_are_counted(spark)
    assert evaluate.auroc(models.fit_delay_forest(parts[0], True, domain).transform(parts[1])) > 0.8


def test_folds_do_not_depend_on_the_layout(spark, domain, parts):
    columns = parts[0].columns
    fold = models.fold_of_row(3, columns).alias("fold")

    def folds(table):
        return sorted(tuple(r) for r in table.select(*columns, fold).collect())

    assert folds(parts[0].repartition(7)) == folds(parts[0].coalesce(1))
    sizes = [r["count"] for r in parts[0].groupBy(fold).count().collect()]
    assert len(sizes) == 3 and min(sizes) > 0.8 * max(sizes)
    first, second = (models.cross_validate(p, True, domain, folds=2, grid=[{}])[1].avgMetrics for p in (parts[0].repartition(5), parts[0].coalesce(1)))
    assert first == pytest.approx(second, abs=1e-6)


def test_grid_search_makes_features_once(domain, parts, monkeypatch):
    made = []

    def written(table, name):
        made.append((name, table.columns))
        return shared.materialize(table, name)

    monkeypatch.setattr(models, "materialize", written)
    models.cross_validate(parts[0], True, domain, folds=2, grid=[{}])
    assert made == [("vectors", ["features", "label", "fold"])]


def test_exact_clusters_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = rng.integers(1, 8)
        values, weights = np.sort(rng.random(n)), rng.integers(1, 5, n).astype(float)
        found = {k: (cost, centres) for k, cost, centres in models.interval_clusters(values, weights, 5)}
        assert set(found) == set(range(1, min(5, n) + 1))
        for k, (cost, centres) in found.items():
            least = np.inf
            for cuts in itertools.combinations(range(1, n), k - 1):
                spans = list(itertools.pairwise([0, *cuts, n]))
                means = [np.average(values[a:b], weights=weights[a:b]) for a, b in spans]
                least = min(least, sum((weights[a:b] * (values[a:b] - m) ** 2).sum() for (a, b), m in zip(spans, means)))
            nearest = ((values[:, None] - np.array(centres)) ** 2).min(1)
            assert cost == pytest.approx(least, abs=1e-9) == pytest.approx((nearest * weights).sum(), abs=1e-9)


def test_k_means_costs_no_less_than_the_optimum(spark):
    rows = [(m,) for m in range(1, 90) for _ in range(90 - m)] + [(0,)] * 500 + [(None,)] * 50
    table = spark.createDataFrame(rows, "WeatherDelay int")
    exact = {r.k: r for r in models.exact_elbow(table).collect()}
    for row in models.elbow(table, range(2, 6)).collect():
        assert exact[row.k].cost * (1 - 1e-9) <= row.cost <= exact[row.k].cost * 1.5
    assert models.centre_cost(table, exact[4].centres).first().cost == pytest.approx(exact[4].cost)
    assert models.exact_elbow(table.limit(0)).count() == 0
    with pytest.MonkeyPatch.context() as patch, pytest.raises(ValueError):
        patch.setattr(models, "EXACT_MINUTES", 5)
        models.exact_elbow(table)


def test_draw_part(spark):
    sizes = spark.range(40_000).groupBy(sampling.draw_part([1, 2, 1], 3).alias("part")).count().collect()
    shares = {r.part: r["count"] / 40_000 for r in sizes}
    assert shares == {0: pytest.approx(0.25, abs=0.02), 1: pytest.approx(0.5, abs=0.02), 2: pytest.approx(0.25, abs=0.02)}


def test_training_runs(spark, tmp_path, flights):
    parts = training.delay_parts(flights, on_time_share=0.5)
    late = flights.where("WeatherDelay > 0").count()
    rows = parts.training.unionByName(parts.test)
    assert "Sort" not in plan_of(parts.training) and "Sample" not in plan_of(parts.training)
    assert parts.index(True) is parts.index(True)
    assert rows.where("label = 1").count() == late and rows.where("label = 0").count() < (6000 - late) * 0.6
    informed = training.train_delay(parts, "forest").metrics
    assert informed["auroc"] > training.train_delay(parts, "forest", with_weather=False).metrics["auroc"]
    assert set(training.train_delay(parts, "logistic").metrics) == {"auroc", "auroc_hard_label", "training_auroc"}
    minutes = training.minutes_parts(flights)
    assert training.train_minutes(minutes, "linear").metrics["training_r2"] > 0.5
    assert set(training.train_minutes(minutes, "forest").metrics) == {"rmse_log10", "rmse_minutes"}
    for call in (lambda: training.train_delay(parts, "x"), lambda: training.train_minutes(minutes, "x")):
        with pytest.raises(ValueError):
            call()
    catalog.ensure_database(spark, "ontime_experiment")
    try:
        trained = training.bucket_experiment(spark, flights, "ontime_experiment.runs", "first", 5, 6, str(tmp_path / "m"))
        assert trained.metrics["accuracy"] > 0.5
        logged = {r.metric: r.value for r in spark.table("ontime_experiment.runs").collect()}
        assert logged == trained.metrics
        again = catalog.load_model(str(tmp_path / "m")).transform(features.bucket_examples(flights))
        assert again.where("predictedLabel is null").count() == 0
    finally:
        catalog.drop_outputs(spark, "ontime_experiment", ["runs"], with_database=True)


def test_auroc_of_ties(spark):
    table = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "label int, score double")
    assert evaluate.auroc(table, "score") == pytest.approx(0.625)


def test_roc_points_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(float(s), int(y)) for s, y in zip(rng.integers(0, 40, 500) / 40, rng.integers(0, 2, 500))]
    got = evaluate.roc_points(spark.createDataFrame(rows, "score double, label int"), "score").collect()
    p, n = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    assert len(got) == len({s for s, _ in rows})
    for r in got:
        above = [y for s, y in rows if s >= r.threshold]
        assert r.TPR == pytest.approx(sum(above) / p) and r.FPR == pytest.approx((len(above) - sum(above)) / n)


def test_requests_are_split_once(spark):
    lines = [",".join(["9", "1", "6", "6", "AA", "SFO", f"J{k}"]) for k in range(3)] + ["x,1,6,6,AA,SFO,JFK", "", "a", None]
    requests = spark.createDataFrame([(k, line, "old") for k, line in enumerate(lines)], "id int, text string, Origin string")
    # A request that is made in the same query isn't made again for each value.
    made = requests.select("id", "Origin", F.concat_ws("", "text", F.lit("")).alias("request"))
    parsed = score.parse_requests(made)
    assert parsed.columns[:3] == ["id", "Origin", "request"]
    assert [(r.id, r.Origin, r.Dest) for r in parsed.orderBy("id").collect()] == [(0, "SFO", "J0"), (1, "SFO", "J1"), (2, "SFO", "J2")]
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert sorted(score.parse_requests(made, on_bad="keep").where("valid").drop("valid").collect()) == sorted(parsed.collect())


def test_figures_are_measured_when_asked_for(flights, monkeypatch):
    seen = []
    auroc = evaluate.auroc
    monkeypatch.setattr(evaluate, "auroc", lambda *given: seen.append(given) or auroc(*given))
    trained = training.train_delay(training.delay_parts(flights, on_time_share=1.0))
    assert not seen
    assert trained.metrics["auroc"] > 0.5 and trained.metrics is trained.metrics and len(seen) == 2


@pytest.mark.filterwarnings("ignore:no examples")
def test_models_of_no_examples_predict_null(spark, tmp_path, flights, domain, parts):
    none = flights.where("Month > 12")
    fits = [
        (lambda t: models.fit_delay_forest(t, True, domain), parts[0]), (lambda t: models.fit_delay_logistic(t, True), parts[0]),
        (lambda t: models.fit_bucket_forest(t, True), features.bucket_examples(flights)), (lambda t: models.fit_minutes_linear(t), features.minutes_examples(flights)),
        (lambda t: models.fit_minutes_forest(t), features.minutes_examples(flights)), (lambda t: models.cross_validate(t, True)[0], parts[0]),
    ]
    for fit, examples in fits:
        model = fit(examples.where("Month > 12"))
        assert not models.is_trained(model)
        catalog.save_model(model, str(tmp_path / "m"))
        made = catalog.load_model(str(tmp_path / "m")).transform(examples)
        assert made.count() == examples.count() > made.where("prediction is not null").count() == 0
    assert models.is_trained(models.fit_delay_logistic(parts[0], True, domain))
    assert evaluate.roc_curve(model).count() == 0 and set(evaluate.training_fit(model).values()) == {None}
    assert "predictedLabel" in fits[2][0](features.bucket_examples(none)).transform(features.bucket_examples(none)).columns
    assert training.train_delay(training.delay_parts(none), "grid").metrics == {}
    assert set(training.train_minutes(training.minutes_parts(none)).metrics.values()) == {None}
    with pytest.warns(UserWarning, match="no examples"):
        assert set(training.train_buckets(training.bucket_parts(none)).metrics.values()) == {None}


@pytest.mark.filterwarnings("ignore:no examples")
def test_two_stages_without_examples(spark, flights, domain, parts):
    classifier, regressor = models.fit_delay_logistic(parts[0], True, domain), models.fit_minutes_linear(features.minutes_examples(flights), domain)
    no_classes = models.fit_delay_logistic(parts[0].where("Month > 12"), True, domain)
    no_minutes = models.fit_minutes_linear(features.minutes_examples(flights.where("Month > 12")), domain)
    lines = ["9,1,6,6,AA,A1,B1,95,1000,500,10000,2,RA", "9,1,6,6,AA,A1,B1,1,1000,500,10000,2,0"]
    requests = score.fill_missing_weather(score.parse_requests(catalog.request_frame(spark, lines)))
    for made in (no_classes, regressor), (no_classes, no_minutes):
        assert [(r.predicted_delay, r.result) for r in score.score(requests, *made).collect()] == [(None, None)] * 2
    assert [(r.predicted_delay, r.result) for r in score.score(requests, classifier, no_minutes).collect()] == [(1.0, None), (0.0, 0.0)]


def test_no_flights_have_no_clusters(spark):
    none = spark.createDataFrame([], "WeatherDelay int")
    assert models.fit_delay_clusters(none, 4) is None
    assert models.elbow(none).count() == models.cluster_minutes(None, spark).count() == 0
    assert models.centre_cost(none, []).first().cost is None
