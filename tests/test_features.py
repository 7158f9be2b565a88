"""Hand-made histories with known results, for both plans."""

import hashlib
import itertools
import random
import re
from decimal import ROUND_HALF_EVEN, Context, Decimal, localcontext

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from asofledger.functions.decimals import numeric_token
from asofledger.functions.wide import exact_sums, with_quotient
from asofledger.operators import audit, digest, features, quantiles
from asofledger.schema import CORE_FEATURES

SCHEMA = "step int, amount decimal(18,2), initiator_id string, recipient_id string, transaction_type string, k int"
PLANS = [features.features_by_rollup, features.features_by_range, features.history_features]


def run(spark, plan, rows):
    df = spark.createDataFrame([(s, Decimal(a), i, r, t, k) for k, (s, a, i, r, t) in enumerate(rows)], SCHEMA)
    return {x["k"]: [None if x[c] is None else float(x[c]) for c in CORE_FEATURES] for x in plan(df, ["k"]).collect()}


@pytest.mark.parametrize("plan", PLANS)
def test_all_types_make_history_and_only_transfers_are_emitted(spark, plan):
    rows = [(0, 10, "A", "B", "TRANSFER"), (0, 20, "A", "C", "PAYMENT"), (0, 7, "D", "B", "DEPOSIT"), (1, 5, "A", "B", "WITHDRAWAL"), (1, 9, "A", "B", "DEBIT"), (2, 100, "A", "B", "TRANSFER"), (2, 1, "A", "B", "transfer")]
    got = run(spark, plan, rows)
    assert set(got) == {0, 5}
    assert got[5] == [100, 4, 1, 44, 11, 20, 4, 2, 2]
    assert got[0] == [10, 0, 0, 0, None, None, 0, 0, 0]


@pytest.mark.parametrize("plan", PLANS)
def test_rows_of_one_step_do_not_see_each_other(spark, plan):
    same = [(5, 1, "A", "A", "TRANSFER"), (5, 2, "A", "B", "TRANSFER"), (5, 3, "C", "B", "TRANSFER"), (5, 4, "A", "C", "PAYMENT")]
    results = set()
    for order in list(itertools.permutations(same))[::7]:
        got = run(spark, plan, [(0, 9, "A", "B", "TRANSFER"), *order, (6, 5, "A", "B", "TRANSFER")])
        last = got[5]
        assert last[1] == 4 and last[7] == 3 and last[8] == 2
        results.add(tuple(sorted((order[k - 1][1], tuple(v)) for k, v in got.items() if 1 <= k <= 4)))
    assert len(results) == 1


@pytest.mark.parametrize("plan", PLANS)
def test_repeated_pairs_partitions_and_gaps(spark, plan):
    got = run(spark, plan, [(s, 1, "A", "B", "TRANSFER") for s in range(20)])
    assert got[19][1] == 19 and got[19][7:] == [1, 1]
    got = run(spark, plan, [(s, a, "A", "B", t) for s, a, t in [(95, 1, "TRANSFER"), (96, 2, "TRANSFER"), (97, 3, "TRANSFER"), (119, 4, "PAYMENT"), (120, 5, "TRANSFER"), (121, 6, "TRANSFER")]])
    assert [got[k][1] for k in (0, 1, 2, 4, 5)] == [0, 1, 2, 4, 5] and [got[k][3] for k in (4, 5)] == [10, 15]
    got = run(spark, plan, [(0, 1, "A", "B", "TRANSFER"), (100, 1, "A", "B", "TRANSFER"), (100, 1, "A", "B", "TRANSFER"), (0, 1, "B", "A", "TRANSFER")])
    assert [got[k][1] for k in (0, 1, 2, 3)] == [0, 1, 1, 0]


def test_random_history_equals_the_theta_join(spark):
    rng = random.Random(904)
    rows = [(s, rng.randint(1, 9), rng.choice("ABC"), rng.choice("ABC"), rng.choice(["TRANSFER", "PAYMENT", "DEBIT"])) for s in range(5) for _ in range(20)]
    df = spark.createDataFrame([(s, Decimal(a), i, r, t, k) for k, (s, a, i, r, t) in enumerate(rows)], SCHEMA)
    cols = ["k", *[c for c in CORE_FEATURES if not c.endswith("mean")]]
    theta = sorted(map(tuple, features.features_by_theta_join(df, ["k"]).select(cols).collect()))
    for plan in PLANS:
        assert sorted(map(tuple, plan(df, ["k"]).select(cols).collect())) == theta


def test_history_reads_only_its_five_columns(spark):
    df = spark.createDataFrame([(0, Decimal(1), "A", "B", "TRANSFER", 1)], SCHEMA).withColumn("is_fraud", F.lit(1))
    assert "is_fraud" not in features.features_by_rollup(df, ["k"]).columns
    with pytest.raises(AnalysisException):
        features.behavioural(df.drop("amount"), []).collect()


def test_means_have_28_digits_half_even(spark):
    """Against the decimal module: ties, exact quotients, trailing zeros, exponents, negative and wide totals."""
    rng = random.Random(28)
    pairs = [("1", 3), ("2", 3), ("1.0000000000000000000000000005", 1), ("1.0000000000000000000000000015", 1), ("0", 7), ("0.00", 7), ("10.00", 4), ("100", 10), ("1000.00", 1000), ("-2", 3), ("0.01", 10**9), ("9" * 40, 1), ("9" * 28 + "5", 1), ("9" * 28 + ".5", 1), ("12345678901234567890123456789.5", 2**62), ("7" * 60 + ".123", 2**63 - 1)]
    pairs += [(f"{rng.choice(['', '-'])}{rng.randrange(10 ** rng.randint(1, 30))}.{rng.randrange(10**6):06d}"[: rng.randint(4, 40)].rstrip("."), rng.choice([1, 2, 5, 7, 64, 1000, rng.randrange(1, 10**12)])) for _ in range(200)]
    context = Context(prec=28, rounding=ROUND_HALF_EVEN)
    df = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate([*pairs, ("5", 0), (None, 3), ("5", None)])], "i int, t string, n long")
    got = {r["i"]: r["q"] for r in with_quotient(df, "q", F.col("t"), F.col("n")).collect()}
    for i, (t, n) in enumerate(pairs):
        assert got[i] == str(context.divide(Decimal(t), Decimal(n))), (t, n)
    assert [got[len(pairs) + k] for k in range(3)] == [None] * 3
    with pytest.raises(Exception, match="too many digits"):
        with_quotient(spark.createDataFrame([("9" * 80, 1)], "t string, n long"), "q", F.col("t"), F.col("n")).collect()


def test_quotients_are_jvm_side(spark):
    made = with_quotient(spark.createDataFrame([("1", 3)], "t string, n long").repartition(2), "q", F.col("t"), F.col("n"))
    assert not re.search("Python|Arrow", made._jdf.queryExecution().executedPlan().toString())


def test_sums_of_any_width_are_exact(spark):
    rng = random.Random(39)
    groups = {"issue": ["123456789012345678901234567890.123456789", "0.000000001", "0.01"], "zero": ["-0.50", "+0.5"], "small": ["-0.03", "0.01"], "borrow": ["-1000000000000000000000000000000000000000.0", "0.001"], "one": ["007"], "nulls": [None]}
    groups |= {f"r{k}": [f"{rng.choice('+-')}{rng.randrange(10 ** rng.randint(1, 60))}.{rng.randrange(10 ** 30):030d}"[: rng.randint(5, 80)].rstrip(".") for _ in range(rng.randint(1, 30))] for k in range(40)}
    df = spark.createDataFrame([(g, t) for g, ts in groups.items() for t in ts], "g string, t string").repartition(5)
    got = {r["g"]: r["s"] for r in exact_sums(df, ["g"], "t", "s").collect()}
    with localcontext() as context:
        context.prec = 400
        for g, ts in groups.items():
            want = None if ts == [None] else sum(map(Decimal, ts), Decimal(0))
            assert got[g] == (None if want is None else f"{want:f}".replace("-0.00", "0.00") if want == 0 else f"{want:f}"), g
    assert got["issue"] == "123456789012345678901234567890.133456790"
    assert exact_sums(df.limit(0), ["g"], "t", "s").count() == 0


def test_digest_is_of_the_order(spark):
    """Against a tree of hashes in Python, for several sizes; two rows that change places change it."""

    def tree(texts, first):
        level = {first + i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts)}
        for _ in range(digest.LEVELS):
            up = {}
            for k in sorted(level):
                up[k >> digest.FAN_BITS] = up.get(k >> digest.FAN_BITS, "") + level[k]
            level = {k: hashlib.sha256(v.encode()).hexdigest() for k, v in up.items()}
        return level.get(0, hashlib.sha256(b"").hexdigest())

    for n in (0, 1, 1023, 2500):
        texts = [f"={i}\x1f{'-' if i % 3 == 0 else '=v' + str(i % 7)}" for i in range(n)]
        df = spark.createDataFrame([(i + 2, i, None if i % 3 == 0 else f"v{i % 7}") for i in range(n)], "k long, i long, v string").repartition(3)
        made = digest.ordered_digest(df, "k", digest.row_text("i", "v")).collect()
        assert [r[0] for r in made] == [tree(texts, 2)]
        if n > 3:
            swapped = df.withColumn("k", F.when(F.col("k") == 2, 3).when(F.col("k") == 3, 2).otherwise(F.col("k")))
            assert digest.ordered_digest(swapped, "k", digest.row_text("i", "v")).first()[0] != made[0][0]


@pytest.mark.parametrize(("accuracy", "few"), [(10_000, 4096), (20, 3), (100, 10)])
def test_quantiles_equal_percentile(spark, monkeypatch, accuracy, few):
    """Small sketches and brackets too, so that they are narrowed several times: skewed, tied, constant, extreme, half-empty and empty columns."""
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = random.Random(accuracy)
    rows = [(rng.random() ** 20 * 1e9, float(rng.randrange(4)), 7.5, rng.choice([-1e300, 1e300, 0.0, 5e-324]) * rng.random(), rng.random() if i % 2 else None, None, float("nan") if i % 5 == 0 else rng.gauss(0, 1)) for i in range(3000)]
    names = list("abcdefg")
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(4)
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = quantiles.quantiles(df, names, shares)
    clean = df.withColumn("g", F.when(~F.isnan("g"), F.col("g")))
    want = clean.agg(*[F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in names]).first().asDict()
    for c in names:
        assert got[c] == (want[c] if want[c] is not None else [None] * len(shares)), c


def test_numeric_tokens(spark):
    texts = {"1.20": "1.2", "+0001.200": "1.2", "-0.00": "0", "0": "0", "100": "100", "-5.10": "-5.1", "000": "0"}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", numeric_token(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in got} == texts


def test_repeated_rows_stay_apart_and_steps_meet_in_the_theta_join(spark):
    """Ten equal rows are ten rows; what the theta join joins are an entity's steps, whatever its rows."""
    rows = [(s, Decimal(1), "A", "B", "TRANSFER", 0) for s in (1, 2, 3) for _ in range(10)]
    made = features.features_by_theta_join(spark.createDataFrame(rows, SCHEMA), ["k"])
    counts = sorted(r["initiator_prior_outgoing_count"] for r in made.collect())
    assert counts == [0] * 10 + [10] * 10 + [20] * 10


def test_hubs_choose_the_rollup_and_change_no_result(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.randrange(6), rng.randrange(1, 99), rng.choice("AAB"), rng.choice("WXY"), rng.choice(["TRANSFER", "DEBIT"])) for _ in range(60)]
    used, want = [], run(spark, features.features_by_range, rows)
    for name in ("features_by_rollup", "features_by_range"):
        plan = getattr(features, name)
        monkeypatch.setattr(features, name, lambda *a, plan=plan, name=name: used.append(name) or plan(*a))
    for most in (10, 1 << 20):
        monkeypatch.setattr(features, "HUB", most)
        assert run(spark, features.history_features, rows) == want
    assert used == ["features_by_rollup", "features_by_range"]


def test_entities_with_unexpected_labels_only_have_neither_label(spark):
    df = spark.createDataFrame([(0, 2, "A", "X"), (1, 2, "A", "X"), (1, 0, "B", "X"), (2, 1, "C", "Y")], "step int, is_fraud int, initiator_id string, recipient_id string")
    cols = ["role", "entities", "multi_row", "multi_step", "legitimate_only", "fraud_only", "mixed", "unexpected"]
    assert sorted(map(tuple, audit.entity_label_profile(df).select(cols).collect())) == [("initiator", 3, 1, 1, 2, 2, 0, 1), ("recipient", 2, 1, 1, 1, 1, 0, 1)]
