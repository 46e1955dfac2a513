import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.operators import balance
from packetloom.operators import explain as X
from packetloom.operators.balance import (
    nearest_in_class,
    smote,
    smote_plan,
    split_quotas,
    stratified_split,
)
from packetloom.operators.batches import map_batches
from packetloom.operators.model import (
    BOOSTED,
    FOREST,
    FlowModel,
    ModelMissing,
    _boosted_margins,
    fit_classifier,
    load_model,
    save_model,
    score_flows,
    train_classifier,
    with_vector,
)
from packetloom.plans.detection import detect
from packetloom.plans.evaluation import evaluate_csv, score_table
from packetloom.plans.training import train_from_csv
from packetloom.schemas import FEATURE_HEADERS, FEATURES, LABELS
from packetloom.sources.csv import write_flows_csv

SIZES = {0: 260, 1: 60, 2: 50, 3: 40, 4: 30}
RAW = ("BENIGN", "DDoS", "PortScan", "FTP-Patator", "Bot")
# mean packets per second by class; the other features follow it loosely
LEVEL = (50.0, 2000.0, 20.0, 60.0, 120.0)


@pytest.fixture(scope="module")
def flows(spark):
    rng = np.random.default_rng(42)
    rows = []
    for c, n in SIZES.items():
        for _ in range(n):
            x = rng.exponential(100, len(FEATURES))
            x[10] = LEVEL[c] * (0.9 + 0.2 * rng.random())
            x[22] = 0.2 * c + 0.1 * rng.random()
            rows.append((len(rows), c, RAW[c], *[float(v) for v in x]))
    columns = ", ".join(f"{f} double" for f in FEATURES)
    return spark.createDataFrame(rows, f"flow_id long, y int, Label string, {columns}").cache()


@pytest.fixture(scope="module")
def forest(flows):
    return FlowModel(fit_classifier(flows, "y", algorithm=FOREST, rounds=5, depth=4), FOREST)


@pytest.fixture(scope="module")
def boosted(flows):
    weighted = flows.withColumn("w", F.lit(2.0) - F.col("y") / 4)
    fitted = fit_classifier(weighted, "y", algorithm=BOOSTED, weight="w", rounds=3, depth=3)
    return FlowModel(fitted, BOOSTED)


def test_split_is_exhaustive_and_stratified(flows):
    assert split_quotas({0: 10, 1: 6}, 0.25) == {0: 3, 1: 1}
    counts = {
        (r["y"], r["is_test"]): r["count"]
        for r in stratified_split(flows, "flow_id", "y").groupBy("y", "is_test").count().collect()
    }
    for c, n in SIZES.items():
        assert counts[(c, True)] + counts[(c, False)] == n
        assert counts[(c, True)] == n * 0.2
    with pytest.raises(ValueError):
        split_quotas({0: 1}, 1.5)


def test_smote_plan():
    assert smote_plan({0: 100, 1: 10, 2: 1}) == ({1: 90}, 1)
    assert smote_plan({0: 100, 1: 10, 2: 6}, target=50) == ({1: 40, 2: 44}, 5)
    assert smote_plan({0: 20, 1: 30}, target=15)[0] == {0: 10}
    assert smote_plan({0: 20, 1: 30}, target=15, when_empty="skip")[0] == {}


def test_neighbours_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 4)).round(2)
    label = np.where(np.arange(150) % 3 == 0, 1, 0)
    frame = spark.createDataFrame(
        [(i, int(c), [float(v) for v in row]) for i, (c, row) in enumerate(zip(label, x))],
        "id long, c int, x array<double>",
    )
    got = {(r["id"], r["rank"]): r["neighbour"] for r in nearest_in_class(frame, "id", "c", "x", 3, block_rows=20).collect()}
    for i in range(150):
        mine = [j for j in range(150) if j != i and label[j] == label[i]]
        best = sorted(mine, key=lambda j: (((x[i] - x[j]) ** 2).sum(), j))[:3]
        assert [got[(i, r)] for r in (1, 2, 3)] == best


def test_pruned_neighbours_give_the_same_rows(flows):
    rows = flows.select("flow_id", "y", F.array("flow_packets_per_sec", "down_up_ratio").alias("x"))
    exact = smote(rows, "flow_id", "y", "x").filter("synthetic")
    pruned = smote(rows, "flow_id", "y", "x", neighbours="pruned").filter("synthetic")
    assert exact.count() and exact.exceptAll(pruned).isEmpty() and pruned.exceptAll(exact).isEmpty()


@pytest.mark.parametrize("seed, extra", [(0, 9), (17, 9), (5, 50)])
def test_smote_asks_for_the_neighbours_of_its_slots_only(spark, monkeypatch, seed, extra):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(51, 3))
    rows = [(100 - i, 1 if i < 30 else 2, x[i].tolist()) for i in range(51)]  # the second class has 21
    frame = spark.createDataFrame(rows, "id long, c int, x array<double>").repartition(3)
    asked = []

    def search(df, *args, **options):
        asked.append(df.filter(options["asked"]).count() if "asked" in options else df.count())
        return nearest_in_class(df, *args, **options)

    monkeypatch.setattr(balance, "nearest_in_class", search)
    made = balance.synthetic_rows(frame, "id", "c", "x", {2: extra}, 4, seed).collect()
    assert asked == [min(extra, 21)]
    mine = sorted((i, np.array(v)) for i, c, v in rows if c == 2)
    want = {}
    for slot in range(1, extra + 1):
        i, a = mine[(slot + seed) % 21]
        others = sorted(((b - a) @ (b - a), j, b) for j, b in mine if j != i)
        b = others[(slot * 7919 + 2 * 104729 + seed) % 4][2]
        want[slot] = a + ((slot * 15485863 + 2 * 32452843 + seed) % 1000) / 1000 * (b - a)
    assert len(made) == extra
    for r in made:
        assert r["c"] == 2 and np.allclose(r["x"], want[r["slot"]], atol=1e-12)


def test_smote_rows_lie_between_rows_of_their_class(flows):
    rows = flows.select("flow_id", "y", F.array("flow_packets_per_sec", "down_up_ratio").alias("x"))
    out = smote(rows, "flow_id", "y", "x")
    counts = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert set(counts.values()) == {260}
    old = {c: np.array([r["x"] for r in rows.filter(f"y = {c}").collect()]) for c in SIZES}
    for r in out.filter("synthetic").limit(40).collect():
        p, x = np.array(r["x"]), old[r["y"]]
        a = x[:, None, :] - p
        b = x[None, :, :] - p
        cross = np.abs(a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0])
        assert (cross < 1e-6).any()


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_scores_are_probabilities(request, flows, kind):
    model = request.getfixturevalue(kind)
    rows = score_flows(model, flows).collect()
    for r in rows:
        p = r["probabilities"]
        assert set(p) == set(LABELS)
        assert sum(p.values()) == pytest.approx(1)
        assert r["confidence"] == max(p.values()) == p[r["prediction"]]
    assert sum(r["prediction_id"] == r["y"] for r in rows) / len(rows) > 0.9


def test_unfitted_model_is_an_error(flows):
    with pytest.raises(ModelMissing):
        score_flows(None, flows)
    with pytest.raises(ModelMissing):
        score_table(None, flows)


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_save_and_load(request, spark, flows, tmp_path, kind):
    model = request.getfixturevalue(kind)
    again = load_model(save_model(model, str(tmp_path / "m"), spark), spark)
    assert (again.algorithm, again.labels) == (model.algorithm, list(LABELS))
    a = score_flows(model, flows).select("flow_id", "confidence").orderBy("flow_id").collect()
    b = score_flows(again, flows).select("flow_id", "confidence").orderBy("flow_id").collect()
    assert a == b
    model.path = None
    with pytest.raises(FileNotFoundError):
        load_model(str(tmp_path / "nothing"), spark)


def _expected(nodes, at, x, known, value):
    node = nodes[at]
    if node["left"] < 0:
        return node["values"][value]
    left, right = node["left"], node["right"]
    if node["feature"] in known:
        return _expected(nodes, left if x[node["feature"]] <= node["threshold"] else right, x, known, value)
    share = nodes[left]["cover"] / node["cover"]
    return share * _expected(nodes, left, x, known, value) + (1 - share) * _expected(
        nodes, right, x, known, value
    )


def test_attributions_of_a_tree_against_the_definition():
    def split(f, t, left, right, cover):
        return {"feature": f, "threshold": t, "left": left, "right": right, "cover": cover, "values": None}

    def leaf(v, cover):
        return {"left": -1, "right": -1, "cover": cover, "values": np.array([v])}

    nodes = {
        0: split(0, 0.5, 1, 2, 10.0),
        1: split(1, 0.3, 3, 4, 6.0),
        2: split(0, 0.8, 5, 6, 4.0),
        3: leaf(1.0, 2.5),
        4: split(2, 0.6, 7, 8, 3.5),
        5: leaf(-2.0, 1.0),
        6: leaf(4.0, 3.0),
        7: leaf(0.5, 0.5),
        8: leaf(7.0, 3.0),
    }
    trees = X.TreeEnsemble([X._leaves(nodes)], shared=False)
    rng = np.random.default_rng(5)
    x = rng.random((30, 4))
    got = trees.attributions(x, 0)
    for row, phi in zip(x, got):
        for j in range(4):
            others, want = [f for f in range(4) if f != j], 0.0
            for size in range(4):
                for s in itertools.combinations(others, size):
                    w = math.factorial(size) * math.factorial(3 - size) / math.factorial(4)
                    want += w * (
                        _expected(nodes, 0, row, {*s, j}, 0) - _expected(nodes, 0, row, set(s), 0)
                    )
            assert phi[j] == pytest.approx(want)
    assert trees.base_value(0) == pytest.approx(_expected(nodes, 0, x[0], set(), 0))


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_attributions_sum_to_the_score(request, spark, flows, kind):
    model = request.getfixturevalue(kind)
    scored = score_flows(model, flows)
    full = X.explain_flows(model, scored, k=len(FEATURES), attacks_only=False)
    if kind == "forest":
        target = F.col("confidence")
        rows = full.withColumn("target", target).collect()
    else:
        with_margins, margins = _boosted_margins(model.model, with_vector(full, FEATURES))
        rows = with_margins.withColumn("target", F.get(margins, F.col("prediction_id"))).collect()
    for r in rows:
        total = sum(t["importance"] for t in r["top_features"]) + r["base_value"]
        assert total == pytest.approx(r["target"], abs=1e-9)
        sizes = [t["abs_importance"] for t in r["top_features"]]
        assert sizes == sorted(sizes, reverse=True)


def test_only_attacks_are_explained(flows, forest):
    scored = score_flows(forest, flows)
    out = X.explain_flows(forest, scored)
    assert out.filter("prediction = 'Normal' and top_features is not null").count() == 0
    assert out.filter("prediction <> 'Normal' and size(top_features) <> 3").count() == 0
    only = X.explain_alerts(forest, scored)
    assert only.filter("prediction = 'Normal'").count() == 0


def test_importance_fallback(spark, flows, forest):
    scored = score_flows(forest, flows)
    row = X.explain_alerts(forest, scored, method=X.IMPORTANCE).first()
    best = X.top_importances(spark, forest, 3).collect()
    assert [t["feature"] for t in row["top_features"]] == [b["feature"] for b in best]
    assert row["fallback"] and row["base_value"] == 0 and row["error"] is None
    blank = X.explain_alerts(FlowModel(object(), FOREST), scored, method=X.IMPORTANCE).first()
    assert blank["top_features"] == [] and "no feature importances" in blank["error"]
    short = X.explain_alerts(forest, scored, features=["flow_duration"], method=X.IMPORTANCE).first()
    assert short["top_features"] == [] and "do not match" in short["error"]


def test_train_keeps_a_quality_floor(flows):
    training = train_classifier(flows, "flow_id", "y", algorithm=FOREST, rounds=8, depth=5)
    assert training.metrics().first()["f1_macro"] > 0.9
    assert training.report().count() == 5
    assert training.model.scale_pos_weight == 1.0


def test_csv_to_alerts(spark, flows, tmp_path):
    path = str(tmp_path / "raw")
    raw = flows.select(
        F.col("Label"),
        F.lit("2024-01-01T00:00:00").alias("Timestamp"),
        F.lit("10.1.1.1").alias("Source IP"),
        *[F.col(f).alias(h) for f, h in FEATURE_HEADERS.items()],
    )
    write_flows_csv(raw, path)
    model = str(tmp_path / "model")
    training = train_from_csv(spark, path, model, algorithm=FOREST, rounds=15, depth=5)
    assert training.metrics().first()["f1_macro"] > 0.9
    loaded = load_model(model, spark)
    assert loaded.feature_names == list(FEATURES)
    result = evaluate_csv(spark, loaded, path)
    assert result["metrics"].first()["accuracy"] > 0.9
    assert result["rejected"].count() == 0 and training.rejected.count() == 0
    found = detect(spark.read.csv(path, header=True), loaded)
    alerts = found.alerts()
    assert alerts.columns == [
        "id", "timestamp", "src_ip", "dst_ip", "attack_type", "confidence", "top_3_features", "severity"
    ]
    attacks = found.scored.filter("prediction <> 'Normal'").count()
    assert alerts.count() == attacks == found.events().filter("alert is not null").count()
    assert found.rejected.count() == 0
    row = alerts.first()
    assert row["src_ip"] == "10.1.1.1" and row["dst_ip"] == "0.0.0.0"
    assert row["severity"] == ("high" if row["confidence"] > 0.8 else "medium")


def test_batches_are_at_most_the_size(spark):
    def size(rows):
        return rows.assign(n=len(rows))[["n"]]

    got = [r["n"] for r in map_batches(spark.range(1000).coalesce(1), size, "n long", 300).collect()]
    assert got == [300] * 900 + [100] * 100

    def broken(rows):
        raise RuntimeError("no")

    with pytest.raises(Exception, match="no"):
        map_batches(spark.range(10), broken, "n long").collect()
