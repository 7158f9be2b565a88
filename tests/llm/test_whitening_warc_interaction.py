import base64
import gzip
import hashlib
import itertools
import json
import math
import random
import re
from glob import glob

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from asofledger.llm import interaction, queries, warc, whitening


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", ["op12_warc", "op13_interaction", "secrets_base", "licenses_base"])
def test_queries_equal_sql(spark, sf, name):
    con = duckdb.connect()
    for path in glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rpartition('/')[2].removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    got = queries.QUERIES[name](spark, sf)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert rows_of(got) == sorted(map(tuple, want), key=repr)


# whitening


def whitened_by_eigh(vectors, most=4):
    """Brute force of the fit, and whitened values up to sign."""
    x = [tuple(math.floor(256 * c) for c in v) for v in vectors]
    fit = np.array(sorted(set(x)), dtype=float)
    n, mean = len(fit), fit.mean(axis=0)
    cov = (fit - mean).T @ (fit - mean) / n
    e, c = np.linalg.eigh(cov)
    e, c = e[::-1][:most], c[:, ::-1][:, :most]
    sums = [sum(int(v[i]) for v in set(x)) for i in range(len(x[0]))]
    return n, [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x], (np.array(x, dtype=float) - mean) @ c / np.sqrt(e), e / np.trace(cov)


def test_whitening_of_the_table_equals_eigh(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    n, deviation, want, explained = whitened_by_eigh(table["embedding"])
    at = {v: i for i, v in enumerate(table["vec_id"])}
    got = queries.op11_whitening(spark, sf).toPandas()
    assert len(got) == 4 * len(table) and (got["n"] == n).all() and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    made = np.zeros_like(want)
    for r in got.itertuples():
        assert r.deviation == deviation[at[r.vec_id]] and r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        made[at[r.vec_id], r.component - 1] = r.whitened
    for k in range(4):
        assert min(np.abs(made[:, k] - want[:, k]).max(), np.abs(made[:, k] + want[:, k]).max()) < 1e-7


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [7, 7, 7, 1, 0], [1, 1 - 1e-9, 1 - 2e-9, 0.5], [3, 0, 0], [2], [1e-30, 1e-31], [1e12, 1, 1e-3], [4.0] * 6])
def test_leading_components(values):
    rng = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    matrix = (q * np.array(values, dtype=float)) @ q.T
    matrix = (matrix + matrix.T) / 2
    got, vectors = whitening.leading(matrix, 4)
    want = [v for v in values if v > whitening.RANK * sum(values)][:4]
    assert got == pytest.approx(want, rel=1e-6, abs=1e-12 * max(values))
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-8
    assert np.abs(matrix @ vectors - vectors * got).max() <= 1e-12 * max(values)


def test_inertia_counts_equal_eigenvalues():
    rng = np.random.default_rng(3)
    for d in (1, 2, 3, 9, 40):
        a = rng.standard_normal((d, d))
        a = a + a.T
        parts = whitening.tridiagonal(a)
        e = np.linalg.eigvalsh(a)
        for shift in [*rng.uniform(-8, 8, 20), 0.0]:
            assert whitening.above(*parts, shift) == (e > shift).sum()


def test_whitening_cases(spark):
    rng = random.Random(1)
    good = [(i, [rng.uniform(-1, 1) for _ in range(6)], "a") for i in range(40)]
    odd = [(100, None, "n"), (101, [0.1, None, 0.2, 0.3, 0.4, 0.5], "n"), (102, [float("nan")] * 6, "n"), (103, [float("-inf")] + [0.0] * 5, "n"), (104, [0.5] * 3, "short"), (105, [], "empty"), (None, good[3][1], "null id")]
    df = spark.createDataFrame([*good, *odd, good[7], good[7]], "vec_id long, embedding array<double>, n string")
    got = whitening.whiten(df).toPandas()
    n, deviation, want, _ = whitened_by_eigh([v for _, v, _ in good])
    assert list(got.columns) == ["vec_id", *[f for f, _ in whitening.FIELDS]] and len(got) == 4 * 43 and (got["n"] == n).all()
    assert sorted(got["vec_id"].dropna().unique()) == list(range(40)) and (got["vec_id"] == 7).sum() == 12 and got["vec_id"].isna().sum() == 4
    for r in got[got["vec_id"] == 7].itertuples():
        assert int(r.deviation) == deviation[7] and abs(abs(r.whitened) - abs(want[7, r.component - 1])) < 1e-7
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.limit(0)).columns == list(got.columns)
    assert whitening.whiten(df.where("vec_id = 7")).count() == 0  # one distinct vector: no eigenvalue
    two = whitening.whiten(df.where("vec_id in (7, 8)")).toPandas()
    assert set(two["component"]) == {1} and sorted(two["whitened"].round(9).unique()) == [-1.0, 1.0]


def test_wide_integers_are_exact(spark):
    df = spark.createDataFrame([(1, [1e15, 2.0]), (2, [-3e15, 5.5]), (3, [7e14, 1.25])], "vec_id long, embedding array<double>")
    x = [[math.floor(256 * c) for c in v] for v in ([1e15, 2.0], [-3e15, 5.5], [7e14, 1.25])]
    sums = [sum(c) for c in zip(*x)]
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(df).where("component = 1").collect()}
    assert got == {i + 1: sum((3 * a - s) ** 2 for a, s in zip(row, sums)) for i, row in enumerate(x)}


# WARC

HOSTILE = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n"
PAGES = [
    (5, "http://a.example/x?y=1#z", "<p>one</p>"), (2, "http://b.example/", "<p>one</p>"), (9, None, "<p>one</p>"), (3, "http://c.example/ü\r\nWARC-Type: x", HOSTILE), (None, "http://d.example", "<p>one</p>"), (None, None, "only null ids"),
    (None, "u", "only null ids"), (7, "u", None), (6, "u", ""), (8, "u", "\n\r\n퟿\n"), (2, "http://b.example/", "<p>one</p>"), (11, "u", "long " * 400_000), (12, "u", "no end\r\n"), (13, "\u0085\t", "\r"),
]


def digest_of(html):
    return base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()


def expected_pages(rows, least):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        h = h or ""
        again = h in first and i != first[h] and len(h.encode()) >= least
        out.append((i, len(h.encode()), digest_of(h), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_pages_survive_archives(spark, least):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    got = warc.round_trip(df, least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == expected_pages(PAGES, least)
    assert sorted((r["url"] for r in got.collect()), key=repr) == sorted((u for _, u, _ in PAGES), key=repr)


def test_archives_are_warc(spark, tmp_path):
    """Archives cut by a reader of its own: record ends, lengths, links, payloads."""
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    warc.write_archives(df, f"{tmp_path}/a")
    found = []
    for path in glob(f"{tmp_path}/a/*.gz"):
        data = gzip.open(path).read()
        while data:
            assert data.startswith(b"WARC/1.1\r\n")
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            size = int(fields[b"Content-Length"])
            assert rest[size : size + 4] == b"\r\n\r\n"
            found.append((fields, rest[:size]))
            data = rest[size + 4 :]
    assert len(found) == 3 * len(PAGES) and len({f[b"WARC-Record-ID"] for f, _ in found}) == len(found)
    ids = {f[b"WARC-Record-ID"] for f, _ in found if f[b"WARC-Type"] in (b"response", b"revisit")}
    assert sorted(f[b"WARC-Concurrent-To"] for f, _ in found if f[b"WARC-Type"] == b"metadata") == sorted(ids) == sorted(f[b"WARC-Concurrent-To"] for f, _ in found if f[b"WARC-Type"] == b"request")
    bodies = [b.partition(b"\r\n\r\n")[2].decode() for f, b in found if f[b"WARC-Type"] == b"response"]
    kinds = expected_pages(PAGES, 0)
    assert sorted(map(digest_of, bodies)) == sorted(d for _, _, d, k, _ in kinds if k == "response")
    urls = [json.loads(m[1]).get("url") for f, b in found if f[b"WARC-Type"] == b"metadata" for m in [re.search(r"url: (.*)\r\n", b.decode())]]
    assert sorted(urls, key=repr) == sorted((u for _, u, _ in PAGES), key=repr)


def test_nested_captures_and_broken_archives(spark, tmp_path):
    df = spark.createDataFrame(PAGES[:4], "page_id long, url string, html string")
    warc.write_archives(df, f"{tmp_path}/a")
    records = warc.read_records(spark, f"{tmp_path}/a")
    made = {r["metadata"]["fields"]["page_id"]: r for r in warc.captures(records).collect()}
    assert set(made) == {"5", "2", "9", "3"} and bytes(made["3"]["capture"]["payload"]).decode() == HOSTILE and made["2"]["capture"]["http_status"] == 200 and made["5"]["capture"]["record_type"] == "revisit"
    assert all(r["request"]["record_type"] == "request" and r["request"]["concurrent_to"] == r["record_id"] for r in made.values())
    bare = records.where("record_type <> 'request'")
    assert warc.captures(bare).where("request is null and metadata is not null").count() == 4
    assert warc.resolve(warc.captures(records.where("record_type = 'response'"))).where("page_id is null").count() == 2
    for name, data in {"cut": b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 9\r\n\r\nabc", "stray": b"hello\r\n\r\n", "digest": b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 5\r\n\r\n\r\n\r\nx\r\n\r\n"}.items():
        (tmp_path / name).mkdir()
        with gzip.open(f"{tmp_path}/{name}/x.warc.gz", "wb") as out:
            out.write(data)
        with pytest.raises(PySparkException):
            warc.read_records(spark, f"{tmp_path}/{name}").count()


def test_records_of_many_members_and_batches(spark, tmp_path):
    """Archives of one gzip member a record, with records longer than a batch of lines and without, in one task."""
    bodies = [b"\n" * 25_000, b"", b"x\r\n" * 12_000, *[b"%d" % i for i in range(300)]]
    for k in range(2):
        with open(tmp_path / f"{k}.warc.gz", "wb") as out:
            for i, body in enumerate(bodies):
                out.write(gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <%d-%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k, i, len(body), body)))
    got = {r["record_id"]: bytes(r["payload"]) for r in warc.read_records(spark, str(tmp_path)).coalesce(1).collect()}
    assert got == {f"<{k}-{i}>": b for k in range(2) for i, b in enumerate(bodies)}


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# filter interaction


def audited(docs, labels):
    """Brute force: filters applied one after the other."""
    fails = []
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        f = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), smaller]
        own = [x for x in labels if x[0] == i and i is not None]
        fails.append((part or "", {c for c, bad in zip("ABCDE", f) if bad}, any(q == 1 for _, q, _ in own), any(x == 1 for _, _, x in own)))
    out = {}
    for part in {p for p, *_ in fails}:
        rows, share = [x[1:] for x in fails if x[0] == part], {c: 0 for c in "ABCDE"}
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[0]]
                earlier = [x for x in rows if c in x[0] and x[0] & set(order[: step - 1])]
                left = [x for x in left if c not in x[0]]
                out[part, "".join(order), step] = [len(left), len(gone), len(earlier), sum(x[0] == {c} for x in rows), sum(x[1] for x in gone), sum(x[2] for x in gone)]
                share[c] += len(gone)
        for (p, order, step), v in out.items():
            if p == part:
                v.append(share[order[step - 1]])
    return out


def test_audit_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "DELTA", "x#y", "50%", " ", "z z", "ü"]
    docs = [(i, " ".join(rng.choice(words[: rng.choice([2, 5, 9])]) + (str(j) if rng.random() < 0.5 else "") for j in range(rng.choice([5, 198, 200, 230]))), rng.choice(["en", "de", None, ""])) for i in range(60)]
    docs += [(100 + i, docs[i % 7][1], docs[i][2]) for i in range(20)] + [(3, docs[3][1], "en"), (None, docs[3][1], "en"), (None, None, "fr"), (200, "", "fr"), (201, None, "fr"), (202, "w " * 5000, "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 120, 2), 4, 4, 8, None]]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("n", F.lit(1)).repartition(3)
    got = interaction.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", *interaction.COUNTS]
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got.collect()} == audited(docs, labels)


def test_audit_of_nothing(spark):
    assert interaction.audit(spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 64, 65, 1000, 12_345])
def test_positional_counts(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    words[: n // 3] = 0xFFFFFFFF
    assert interaction.positional_counts(words).tolist() == [int((words >> np.uint32(b) & np.uint32(1)).sum()) for b in range(32)]


def test_survivors_of_other_filters(spark):
    """Three filters of one's own, by the general interface."""
    rows = [("p", f, f % 2 == 0, f > 5) for f in range(8) for _ in range(f + 1)]
    df = spark.createDataFrame(rows, "part string, fails int, good boolean, toxic boolean")
    got = {r["subset"]: (r["n"], r["good"], r["toxic"]) for r in interaction.survivors(df, 3).collect()}
    assert got == {s: tuple(sum(k for _, f, *x in rows if not f & s for k in [[1, x[0], x[1]][i]]) for i in range(3)) for s in range(8)}
    assert interaction.by_order(interaction.survivors(df, 3), "XYZ").count() == 18


def test_text_failures_of_empty_batch():
    assert [len(a) for a in interaction.text_failures(pa.array([], pa.string()))] == [0, 0]
