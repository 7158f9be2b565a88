"""Stored relations joined without a shuffle and exported to a database, gates before modelling, and the model job with all five models."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofledger.operators import boosting, features, integrity, modelling, validation
from asofledger.plans import catalog, pipelines, store
from asofledger.sources import artifact
from asofledger.sources.adapter import numbered, transactions


@pytest.fixture(scope="module")
def loaded(spark, sf):
    """A database with the transactions' relations."""
    rows = numbered(transactions(spark, sf, True)).drop("score").withColumnRenamed("txn_key", "transaction_id").cache()
    made = features.features_by_rollup(rows, ["transaction_id", "initiator_balance_before", "recipient_balance_before"])
    spark.sql("DROP DATABASE IF EXISTS ledger_bucketed CASCADE")
    old, store.BUCKET_ROWS = store.BUCKET_ROWS, 1000
    store.store(spark, "ledger_bucketed", rows, made)
    store.BUCKET_ROWS = old
    yield rows
    spark.sql("DROP DATABASE ledger_bucketed CASCADE")


def test_relations_meet_without_an_exchange(spark, loaded):
    joined = store.read_back(spark, "ledger_bucketed")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
    assert joined.count() == loaded.where("transaction_type = 'TRANSFER'").count() and joined.where("amount <> canonical_amount").isEmpty()


def test_relations_survive_another_database(spark, loaded, tmp_path):
    url, properties = f"jdbc:derby:{tmp_path}/ledger;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    counts = store.export(spark, "ledger_bucketed", url, properties)
    n = loaded.where("transaction_type = 'TRANSFER'").count()
    assert counts == {"canonical_transaction": loaded.count(), "feature_lineage": n, "core_feature": n, "enhanced_feature": n}
    assert store.read_jdbc(spark, url, "core_feature", properties, fetch=7).count() == n
    with pytest.raises(integrity.IntegrityError, match="differs"):
        store.export(spark, "ledger_bucketed", url, properties)  # rows are there twice now
    with pytest.raises(ValueError):
        store.write_jdbc(loaded, url, "x", properties, batch=0)


def test_rows_read_back_are_held_against_the_source(spark):
    text = spark.createDataFrame([(2, False, "+1", "TRANSFER", "01.50", "a", "1", "2", "b", "-3.0", "4", "1"), (3, False, "1", "DEBIT", "2", "b", "1", "2", "c", "3", "4", "0")], "source_row_number long, malformed boolean, step string, transactionType string, amount string, initiator string, oldBalInitiator string, newBalInitiator string, recipient string, oldBalRecipient string, newBalRecipient string, isFraud string")
    money, sums = validation.checked(text, artifact.row_sums)
    typed = validation.canonical(text, "0" * 64, money)
    validation.require_as_read(typed, "0" * 64, artifact.row_sums, sums)
    first = F.col("source_row_number") == 2
    for column, value in {"amount": F.lit(1.51).cast(money), "step": F.lit(2), "is_fraud": F.lit(0), "recipient_id": F.lit("c"), "amount_literal": F.lit("1.5"), "transaction_id": F.lit("x"), "recipient_balance_after": F.lit(None).cast(money)}.items():
        with pytest.raises(integrity.IntegrityError, match="differ from the source"):
            validation.require_as_read(typed.withColumn(column, F.when(first, value).otherwise(F.col(column))), "0" * 64, artifact.row_sums, sums)
    for rows in (typed.where(~first), typed.unionByName(typed.where(first))):
        with pytest.raises(integrity.IntegrityError, match="differ from the source"):
            validation.require_as_read(rows, "0" * 64, artifact.row_sums, sums)


def _data(spark, changes=None):
    rows = []
    for step in (3, 100, 130):
        for k in range(4):
            rows.append({"step": step, "is_fraud": k % 2, **{c: float(k) for c in modelling.ENHANCED_FEATURES}, **{c: None for c in modelling.NULLABLE_FEATURES if k == 0}} | ((changes or {}) if (step, k) == (100, 1) else {}))
    schema = "step int, is_fraud int, " + ", ".join(f"{c} double" for c in modelling.ENHANCED_FEATURES)
    return modelling.model_data(spark.createDataFrame(rows, schema))


def test_gates_before_modelling(spark):
    found = modelling.require_model_data(_data(spark), {"train": 4, "validation": 4, "test": 4})
    assert found["rows"] == 12 and found["partitions"] == {"train": 4, "validation": 4, "test": 4} and found["matrix_bytes"] == 12 * 11 * 8
    assert {c: n for c, n in found["missing"].items() if n} == dict.fromkeys(modelling.NULLABLE_FEATURES, 3)
    for changes, message in [({"is_fraud": 2}, "1 labels"), ({"amount": None}, "1 missing values of amount"), ({"amount": float("nan")}, "1 missing values of amount"), ({"initiator_balance_before": float("-inf")}, "1 infinities of initiator_balance_before")]:
        with pytest.raises(integrity.IntegrityError, match=message):
            modelling.require_model_data(_data(spark, changes))
    with pytest.raises(integrity.IntegrityError, match="partition train: 4 rows, not 5"):
        modelling.require_model_data(_data(spark), {"train": 5, "validation": 4, "test": 4})
    with pytest.raises(integrity.IntegrityError, match="partition test: 0 rows"):
        modelling.require_model_data(_data(spark).where("step < 120"))


def test_all_five_models_are_fitted_selected_and_scored(spark, sf, tmp_path, monkeypatch):
    """The whole job, with trees as many as a test has time for; their full number is held by another test."""
    monkeypatch.setattr(modelling, "boosting", lambda: boosting.Boosting(iterations=8))
    rows = catalog.QUERIES["pit_enhanced_features"](spark, sf)
    facts = pipelines.run_modelling(spark, rows, str(tmp_path / "model"))
    names = [s.name for s in modelling.SPECS]
    assert list(facts["test"]) == names and facts["selection"]["selected"] in names and facts["population"]["rows"] == rows.count()
    for name in names:
        seen = facts["test"][name]["at_threshold"]
        assert 0 <= seen["average_precision"] <= 1 and 0 <= seen["roc_auc"] <= 1 and 0 <= seen["brier"] <= 1
    gain = facts["explained"]["enhanced_boosting"]["validation_ap_decrease"]
    assert set(gain) == set(modelling.ENHANCED_FEATURES) and max(v["mean"] for v in gain.values()) > 0
    assert json.loads((tmp_path / "model/selection.json").read_text())["seed"] == modelling.SEED


def _grown_in_memory(x, y, made, edges):
    """Brute force of the trees on binned rows: leaves split one after the other, the largest gain first."""
    prior = np.log(y.mean() / (1 - y.mean()))
    raw = np.full(len(y), prior)
    score = lambda g, h: g * g / (h + made.l2)
    for _ in range(made.iterations):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)

        def best(rows, g=g, h=h):
            found = (0.0, None)
            for c in range(x.shape[1]):
                for b in range(len(edges[c]) + 1):
                    for missing_left in (False, True):
                        left = np.where(x[rows, c] == boosting.MISSING, missing_left, x[rows, c] <= b)
                        a, o = rows[left], rows[~left]
                        if min(len(a), len(o)) >= made.least_rows:
                            gain = score(g[a].sum(), h[a].sum()) + score(g[o].sum(), h[o].sum()) - score(g[rows].sum(), h[rows].sum())
                            if gain > found[0] + 1e-9:
                                found = (gain, (a, o))
            return found

        leaves = [(*best(np.arange(len(y))), np.arange(len(y)))]
        while len(leaves) < made.leaves:
            i = max(range(len(leaves)), key=lambda k: leaves[k][0])
            if leaves[i][1] is None:
                break
            a, o = leaves.pop(i)[1]
            leaves += [(*best(a), a), (*best(o), o)]
        for _, _, rows in leaves:
            raw[rows] -= made.rate * g[rows].sum() / (h[rows].sum() + made.l2)
    return 1 / (1 + np.exp(-raw))


def test_trees_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    values = np.column_stack([rng.integers(0, 6, 400), rng.normal(size=400).round(1), rng.integers(0, 3, 400)]).astype(float)
    values[rng.random(400) < 0.2, 1] = np.nan
    y = ((values[:, 0] > 2) ^ (np.nan_to_num(values[:, 1], nan=-9) > 0) ^ (rng.random(400) < 0.1)).astype(float)
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in row], int(t)) for i, (row, t) in enumerate(zip(values, y))], "i int, a double, b double, c double, label int").repartition(3)
    made = boosting.Boosting(iterations=12, leaves=6, least_rows=15, rate=0.3, bins=12)
    model = made.fit(df, ["a", "b", "c"])
    want = _grown_in_memory(boosting._bins(model.edges, list(values.T)), y, made, model.edges)
    got = {r["i"]: r["score"] for r in model.score(df, ["a", "b", "c"]).collect()}
    assert [got[i] for i in range(400)] == pytest.approx(want.tolist(), abs=1e-9)
    assert model.score(df.limit(0), ["a", "b", "c"]).count() == 0


def test_trees_rank_as_well_as_the_librarys(spark):
    """A checkerboard with missing values, against Spark ML's trees with as many iterations."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = [(float(i % 20), float(i // 20 % 20), None if i % 9 == 0 else float(i % 7), int((i % 20 < 10) != (i // 20 % 20 < 10))) for i in range(2000)]
    names = ["initiator_prior_outgoing_count", "recipient_prior_incoming_count", "initiator_prior_outgoing_amount_mean"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip([*names, "label"], ["double"] * 3 + ["int"])))
    scored = boosting.Boosting(iterations=10).fit(df, names).score(df, names)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(df.fillna(3.0))
    other = GBTClassifier(labelCol="label", maxIter=10, maxDepth=4, seed=1).fit(vectors).transform(vectors).select("label", vector_to_array("probability")[1].alias("score"))
    ours, theirs = (modelling.metrics.average_precision(s).first()[0] for s in (scored, other))
    assert ours > 0.95 and ours >= theirs - 0.01
