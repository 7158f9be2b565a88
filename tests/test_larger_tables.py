"""Work that must not grow faster than the tables: plans and parts of the canonical pipeline, the store's load, the lineage check and the ordered digest, with results by brute force."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from asofledger.durable import in_order
from asofledger.operators import digest, features, integrity, validation
from asofledger.plans import catalog
from asofledger.schema import SOURCE_COLUMNS
from asofledger.sources import adapter, artifact, csv_source


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_source_line_is_no_buffer_of_an_aggregate(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",".join(SOURCE_COLUMNS) + "\n1,2\n")
    source = csv_source._blocks.__code__.co_names
    assert "min_by" not in source  # of lines, which an aggregate would sort
    made = csv_source._blocks(spark, str(tmp_path), ",".join(SOURCE_COLUMNS)).collect()
    assert [(r["n"], r["headed"], r["odd"]) for r in made] == [(2, True, 0)]
    assert not csv_source._blocks(spark, str(tmp_path), "1,2").first()["headed"]  # there, but not first


@pytest.mark.parametrize("line", ["a,b,c", "a,b", "a,b,c,", ",,", "", 'a,"b,""x""",c', 'a,"b",c"', 'a"b,c,d', '"a,b,c', '"a","b\n,","c"', "a,b\rc,d", 'a,"b"x,c', "é, ,\t"])
def test_lines_with_and_without_quotes_have_one_grammar(spark, line):
    record = rf"^{csv_source.FIELD}(?:,{csv_source.FIELD}){{2}}+\z"
    rows = spark.createDataFrame([(line, 2)], "value string, line_number long")
    good = rows.select(F.col("value").rlike(record)).first()[0]
    made = csv_source.read_lines_strict(spark, rows, ["x", "y", "z"]).first()
    assert made["malformed"] == (not good)
    if good and '"' not in line:
        assert [made[c] for c in "xyz"] == line.split(",")
    if line.startswith('a,"b,'):
        assert made["y"] == 'b,"x"'


def test_reconciliation_counts_numbers_without_a_row_each(spark):
    def tally(numbers, steps):
        rows = spark.createDataFrame([(n, s, "TRANSFER", 0) for n, s in zip(numbers, steps)], "source_row_number long, step int, transaction_type string, is_fraud int")
        return validation.reconciliation(rows), validation.tallied(rows)

    expands = [line for line in _plan(tally([2, 3], [0, 0])[0]).split("\n") if "Expand" in line]
    assert not any("source_row_number" in line for line in expands)
    for numbers, right in [(range(2, 200), True), ([2, 3, 3, 5], False), ([2, 4], False), ([63, 64, 65, 127, 128], False), ([-1, 0, 1], True)]:
        assert tally(list(numbers), [1] * len(list(numbers)))[0].first()["contiguous"] is right
    random.seed(3)
    for steps in [[1, 1, 2, 5], [1, 2, 1], [2, 1], [1, 1, 3, 2, 4], [7], *[sorted(random.choices(range(5), k=9)) for _ in range(2)], *[random.choices(range(3), k=4) for _ in range(4)]]:
        falls = any(b < a for a, b in zip(steps, steps[1:]))
        assert validation.steps_fall(tally(range(2, 2 + len(steps)), steps)[1]) == falls


def test_sums_of_rows_are_longs_that_differ(spark):
    rows = spark.range(100).select(F.struct("id").alias("r"))
    assert all(t in ("bigint", "int") for _, t in rows.agg(*artifact.row_sums(F.col("r"))).dtypes)
    other = spark.range(100).select(F.struct((F.col("id") % 99).alias("id")).alias("r"))
    assert rows.agg(*artifact.row_sums(F.col("r"))).first() != other.agg(*artifact.row_sums(F.col("r"))).first()


def test_incomplete_lineage_shuffles_each_relation_once(spark):
    random.seed(5)
    some = lambda: [(random.choice(["a", "b", "c", "d", "e", None]),) for _ in range(7)]
    due, *parts = [some() for _ in range(4)]
    frame = lambda rows: spark.createDataFrame(rows, "transaction_id string")
    canonical = frame(due).withColumn("transaction_type", F.lit("TRANSFER")).unionByName(frame([("z",)]).withColumn("transaction_type", F.lit("DEBIT")))
    made = integrity.incomplete_lineage(frame(parts[0]), canonical, [frame(p) for p in parts[1:]])
    assert "Join" not in _plan(made)
    expected = Counter()
    for name, part in zip(["lineage", "child 1", "child 2"], parts):
        for (k,) in due:
            expected[k, f"no {name}"] += k is None or (k,) not in part
        for (k,) in part:
            expected[k, f"stray {name}"] += k is None or (k,) not in due
    assert {(r[0], r["problem"]): r["n_rows"] for r in made.collect()} == dict(+expected)


def test_nodes_of_rows_in_order_are_made_before_the_shuffle():
    ks = list(range(2, 5000))
    hashes = {k: hashlib.sha256(str(k).encode()).digest() for k in ks}

    def batches(order, size):
        for i in range(0, len(order), size):
            part = order[i : i + size]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([hashes[k] for k in part], pa.binary())], names=["k", "h"])

    shuffled = random.Random(1).sample(ks, len(ks))
    for order, size, whole in [(ks, 700, 3), (ks, 5000, 3), (ks, 1, 3), (ks[3000:] + ks[:3000], 512, 2), (shuffled, 900, 0)]:
        rows = [tuple(r.values()) for b in digest._nodes_within(batches(order, size)) for r in b.to_pylist()]
        nodes = {k: h for k, w, h in rows if w}
        assert len(nodes) == whole
        for k, h in nodes.items():
            assert h == hashlib.sha256("".join(hashes[i].hex() for i in range(k << 10, (k + 1) << 10)).encode()).digest()
        rest = {k: h for k, w, h in rows if not w}
        assert sorted(rest) == [k for k in ks if k >> 10 not in nodes] and all(hashes[k] == h for k, h in rest.items())


def _stages(spark):
    """Stage, and bytes shuffled, spilled and written by it, of all stages that are known."""
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    found = spark._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return {x.stageId(): x.shuffleWriteBytes() + x.diskBytesSpilled() + x.outputBytes() for x in (found.apply(i) for i in range(found.size()))}


@pytest.mark.parametrize("name, most", [("catalog_views", 260), ("read_back_join", 260)])
def test_a_load_moves_few_bytes_a_row(spark, sf, name, most):
    last = max(_stages(spark), default=-1)
    catalog.QUERIES[name](spark, sf).collect()
    moved = sum(n for k, n in _stages(spark).items() if k > last)
    assert 0 < moved / spark.read.parquet(f"{sf}/lineitem.parquet").count() < most


def test_late_columns_order_rows_and_are_not_shuffled(spark):
    rows = spark.range(300).select((F.col("id") % 7).alias("step"), F.col("id").alias("a"), (F.col("id") * 37 % 11).alias("b"))
    key = F.concat_ws("-", "a", "b")
    made = in_order(rows, ["step", "key"], {"key": key})
    above, below = _plan(made).rsplit("Exchange rangepartitioning", 1)
    assert "AS key" in above and "AS key" not in below
    assert [tuple(r) for r in made.collect()] == sorted(((i % 7, i, i * 37 % 11, f"{i}-{i * 37 % 11}") for i in range(300)), key=lambda r: (r[0], r[3]))


def test_transactions_of_odd_lines_are_the_tables_own(spark, tmp_path):
    lines = [
        (1, 1, 5, 7, 0.285, 0.0, "R", "F", "1996-01-01"), (1, None, 5, 7, 1.005, 0.1, "N", "O", "1997-01-01"), (2, 3, None, 7, 64.1, None, None, None, None), (-3, -2, -5, 8, None, 0.0, "R", "O", "1994-01-01"),
        (3, 2147483647, 6, 8, -12.345, 0.2, "R", "F", "1995-01-01"), (4, -2147483648, 6, 8, 1e15 / 3, 0.0, "R", "F", "1990-05-05"), (9, 1, 1, 7, 1.0, 0.0, "R", "F", "1996-01-01"), (2, 1, 1, 99, 1.0, 0.0, "R", "F", "1996-01-01"),
    ]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_tax double, l_returnflag string, l_linestatus string, day string"),
        "orders": ([(1, 10, "1-URGENT"), (2, 11, "6-NEW"), (-3, 10, None), (3, 11, "5-LOW"), (4, 10, "1-URGENT")], "o_orderkey long, o_custkey long, o_orderpriority string"),
        "customer": ([(10, -5.5), (11, 7.25)], "c_custkey long, c_acctbal double"), "supplier": ([(7, 1.0), (8, -2.5)], "s_suppkey long, s_acctbal double"),
    }
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema)
        (df.withColumn("l_shipdate", F.col("day").cast("timestamp")).drop("day") if name == "lineitem" else df).write.parquet(f"{tmp_path}/{name}.parquet")
        spark.read.parquet(f"{tmp_path}/{name}.parquet").createOrReplaceTempView(f"odd_{name}")
    want = spark.sql("""SELECT CAST(floor(datediff(to_date(l_shipdate), DATE '1995-01-01') * 144 / 2500) AS INT) AS step, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS txn_key,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'TRANSFER' WHEN '5-LOW' THEN 'DEBIT' END AS transaction_type, CAST(l_extendedprice AS DECIMAL(18, 2)) AS amount, CAST(o_custkey AS STRING) AS initiator_id, CAST(l_suppkey AS STRING) AS recipient_id,
        CASE WHEN o_orderpriority = '1-URGENT' AND l_returnflag = 'R' THEN 1 ELSE 0 END AS is_fraud, CAST(round(l_extendedprice * 100) AS BIGINT) % 1000 / 1000.0D AS score, CAST(c_acctbal AS DECIMAL(18, 2)) AS initiator_balance_before, CAST(s_acctbal AS DECIMAL(18, 2)) AS recipient_balance_before,
        CASE WHEN l_tax = 0 THEN 3 WHEN l_linestatus = 'F' THEN 1 ELSE 0 END * CAST(l_extendedprice AS DECIMAL(18, 2)) AS moved FROM odd_lineitem JOIN odd_orders ON l_orderkey = o_orderkey JOIN odd_customer ON o_custkey = c_custkey JOIN odd_supplier ON l_suppkey = s_suppkey""")
    want = want.selectExpr("* except (moved)", "CAST(initiator_balance_before - moved AS DECIMAL(18, 2))", "CAST(recipient_balance_before + moved AS DECIMAL(18, 2))")
    got = adapter.transactions(spark, str(tmp_path), True)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr) and got.count() == 6
    numbers = adapter.numbered(got)
    narrow = adapter.typed(adapter.numbered_rows(spark, str(tmp_path), True), True, "source_row_number")
    assert sorted(map(tuple, narrow.select(numbers.columns).collect()), key=repr) == sorted(map(tuple, numbers.collect()), key=repr)
    assert adapter.transactions(spark, str(tmp_path)).count() == 7  # no supplier is met


def test_stored_relations_are_checked_without_a_shuffle(spark):
    random.seed(6)
    some = lambda n: [(random.choice(["a", "b", "c", "d", "e", "f", None]),) for _ in range(n)]
    spark.sql("DROP DATABASE IF EXISTS ledger_checked CASCADE")
    spark.sql("CREATE DATABASE ledger_checked")
    names = ["canonical", "lineage", "core", "enhanced"]
    for name in names:
        rows = spark.createDataFrame(some(6), "transaction_id string").withColumn("transaction_type", F.lit("TRANSFER"))
        more = spark.createDataFrame([("z",)], "transaction_id string").withColumn("transaction_type", F.lit("DEBIT"))
        (rows.unionByName(more) if name == "canonical" else rows).repartition(3, "transaction_id").write.bucketBy(3, "transaction_id").sortBy("transaction_id").saveAsTable(f"ledger_checked.{name}")
    canonical, lineage, *children = [spark.table(f"ledger_checked.{n}") for n in names]
    stored = integrity.incomplete_lineage(lineage, canonical, children, stored=True)
    assert "Exchange" not in _plan(stored)
    assert Counter(map(tuple, stored.collect())) == Counter(map(tuple, integrity.incomplete_lineage(lineage, canonical, children).collect())) and not stored.isEmpty()
    spark.sql("DROP DATABASE ledger_checked CASCADE")


def test_hubs_are_found_by_cells(spark, monkeypatch):
    random.seed(7)
    monkeypatch.setattr(features, "CELLS", 4)
    for most in (1, 2, 5, 9):
        monkeypatch.setattr(features, "HUB", most)
        for n in (0, 5, 40):
            held = [(random.choice("abcdefghijklm"),) for _ in range(n)] + [(None,)]
            rows = spark.createDataFrame(held, "initiator_id string")
            assert features.has_hub(rows, "initiator_id") == (max(Counter(held).values()) > most)


def test_what_is_passed_on_is_shuffled_for_transfers_only(spark):
    rows = spark.createDataFrame([(0, "TRANSFER", 1, "A", "B", "x", 7), (1, "DEBIT", 2, "A", "B", "y", 8), (2, "TRANSFER", 3, "A", "B", "z", None)], "step int, transaction_type string, amount int, initiator_id string, recipient_id string, k string, j int")
    made = features.features_by_range(rows.withColumn("amount", F.col("amount").cast("decimal(18,2)")), ["k", "j"])
    shuffled = [line for line in _plan(made).split("\n") if "Exchange hashpartitioning" in line]
    assert len(shuffled) == 2 and made.columns[:7] == ["step", "transaction_type", "amount", "initiator_id", "recipient_id", "k", "j"]
    assert sorted((r["k"], r["j"], r["transaction_type"], r["initiator_prior_outgoing_count"], r["recipient_prior_incoming_count"]) for r in made.collect()) == [("x", 7, "TRANSFER", 0, 0), ("z", None, "TRANSFER", 2, 2)]
    second = _plan(made).split("Exchange hashpartitioning(recipient_id")[1].split("Exchange hashpartitioning")[0]
    assert "__sent" in second
