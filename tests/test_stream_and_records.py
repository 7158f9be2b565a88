"""The ledger stream against the batch features, and records that span lines against Python's csv."""

import csv
import random
from decimal import Decimal

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from asofledger.operators.features import features_by_rollup
from asofledger.schema import CORE_FEATURES
from asofledger.sources import csv_source
from asofledger.streaming import ledger

SCHEMA = "k long, step int, transaction_type string, amount decimal(18,2), initiator_id string, recipient_id string"


def transactions(n, seed):
    """Rows with a hub on either side, self-transfers and repeated pairs, in the order of steps."""
    rng = random.Random(seed)
    party = lambda hub: hub if rng.random() < 0.4 else f"p{rng.randrange(12)}"
    return [(i, i * 10 // n, rng.choice(["TRANSFER", "TRANSFER", "PAYMENT", "DEBIT"]), Decimal(rng.randrange(1, 10**6)) / 100, party("hub"), party("sink")) for i in range(n)]


def arrive(spark, rows, work, name):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{work}/in/{name}")


def stream(spark, work):
    return spark.readStream.schema(SCHEMA).parquet(f"{work}/in/*")


def facts(df):
    return sorted((r["k"], *[r[c] for c in CORE_FEATURES]) for r in df.collect())


def test_stream_equals_batch(spark, tmp_path, monkeypatch):
    """Arrivals that split steps between them, one that is empty, and state that is written anew in between."""
    monkeypatch.setattr(ledger, "COMPACT", 3)
    rows, work = transactions(400, 5), str(tmp_path / "w")
    for name, (a, b) in enumerate([(0, 90), (90, 90), (90, 170), (170, 171), (171, 400)]):
        arrive(spark, rows[a:b], work, name)
        ledger.run_available(stream(spark, work), work, ["k"])
    whole = spark.createDataFrame(rows, SCHEMA)
    made = ledger.publish(spark, work, str(tmp_path / "out/features"))
    assert facts(made) == facts(features_by_rollup(whole, ["k"]))
    assert ledger.statistics(spark, work) == {"initiators": whole.select("initiator_id").distinct().count(), "recipients": whole.select("recipient_id").distinct().count(), "pairs": whole.select("initiator_id", "recipient_id").distinct().count(), "last_step": 9}
    with pytest.raises(FileExistsError):
        ledger.publish(spark, work, str(tmp_path / "out/features"))


def test_late_rows_end_the_query(spark, tmp_path):
    rows, work = transactions(100, 1), str(tmp_path / "w")
    arrive(spark, rows[50:], work, "late")
    ledger.run_available(stream(spark, work), work, ["k"])
    arrive(spark, rows[:20], work, "early")
    with pytest.raises(StreamingQueryException, match="chronological regression: step 0 after step 9"):
        ledger.run_available(stream(spark, work), work, ["k"])
    assert {r["epoch"] for r in spark.read.parquet(f"{work}/staged").select("epoch").distinct().collect()} == {0}


def test_a_query_that_dies_leaves_no_target_and_a_rerun_gives_each_row_once(spark, tmp_path):
    rows, work, target = transactions(200, 2), str(tmp_path / "w"), tmp_path / "out/features"

    def die(epoch):
        if epoch == 1:
            raise RuntimeError("killed before the commit")

    for name, (a, b) in enumerate([(0, 80), (80, 200)]):
        arrive(spark, rows[a:b], work, name)
        if name == 0:
            ledger.run_available(stream(spark, work), work, ["k"], after=die)
            continue
        for _ in range(2):
            with pytest.raises(StreamingQueryException, match="killed before the commit"):
                ledger.run_available(stream(spark, work), work, ["k"], after=die)
            assert not target.exists()
    ledger.run_available(stream(spark, work), work, ["k"])
    ledger.run_available(stream(spark, work), work, ["k"])  # nothing is left
    assert facts(ledger.publish(spark, work, str(target))) == facts(features_by_rollup(spark.createDataFrame(rows, SCHEMA), ["k"]))


@pytest.fixture
def small_blocks(spark):
    """Files are split every 700 bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_records_over_blocks_equal_csv(spark, tmp_path, small_blocks):
    rng, columns, want = random.Random(7), ["a", "b", "c"], []
    cells = ["x", "", "a,b", 'q"q', "l1\nl2", "c\r\nd", "é\n\n\nz", "r\rs", "tail\r", "\n"]
    for f in range(3):
        rows = [[rng.choice(cells) * rng.choice([1, 1, 1, 40 if rng.random() < 0.1 else 1]) for _ in columns] for _ in range(250)]
        rows += [["wide\n" * 500, "", '"']] * (f + 1)  # records longer than several blocks
        end = ["\n", "\r\n"][f % 2]
        with open(tmp_path / f"{f}.csv", "w", newline="") as out:
            out.write(",".join(columns) + end)
            csv.writer(out, lineterminator=end).writerows(rows)
        want += rows
    got = csv_source.read_strict(spark, str(tmp_path), columns).orderBy("source_row_number").collect()
    assert [r["source_row_number"] for r in got] == list(range(2, len(want) + 2)) and not any(r["malformed"] for r in got)
    assert [[r[c] for c in columns] for r in got] == want


def test_unclosed_and_stray_quotes_over_blocks(spark, tmp_path, small_blocks):
    lines = ["a,b,c", '"x\ny",1,2', "1,2,3", 'st"ray,1,2', '4,"5"x,6', *["7,8,9"] * 300]
    (tmp_path / "f.csv").write_text("\n".join([*lines, '"open,1,2', "9,9,9"]) + "\n")
    got = {r["source_row_number"]: r for r in csv_source.read_strict(spark, str(tmp_path / "f.csv"), ["a", "b", "c"]).collect()}
    assert not got[2]["malformed"] and got[2]["a"] == "x\ny" and not got[3]["malformed"] and got[4]["malformed"]
    assert sorted(got) == list(range(2, max(got) + 1))
    (tmp_path / "g.csv").write_text('a,b,c\n"never closed,1,2\n' + "1,2,3\n" * 400)
    only = csv_source.read_strict(spark, str(tmp_path / "g.csv"), ["a", "b", "c"]).collect()
    assert [(r["source_row_number"], r["malformed"]) for r in only] == [(2, True)]
