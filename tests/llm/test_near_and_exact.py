import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from asofledger.llm import exact, pieces, queries, similar, simhash
from asofledger.llm.components import components

ROWS = [
    (7, "a  b\tc", "en"), (3, "a b c", None), (9, "A b c", "x"), (None, "a b c", "y"), (4, None, "z"), (5, "", "z"),
    (6, " ", "z"), (3, "a b c", None), (8, "word " * 5000, "long"), (10, "word  " * 5000, "long"), (11, "▁ \n\nx\r", None),
]
SCHEMA = "doc_id long, text string, fp string"


def test_exact_matches_brute_force(spark):
    got = sorted(map(tuple, exact.verdicts(spark.createDataFrame(ROWS, SCHEMA)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)
    sha = {i: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() for i, (_, t, _) in enumerate(ROWS)}
    want = []
    for i, (d, _, _) in enumerate(ROWS):
        ids = [ROWS[j][0] for j in sha if sha[j] == sha[i]]
        keep = min((x for x in ids if x is not None), default=None)
        want.append((d, keep, len(ids), d == keep, sha[i]))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("cut", [-1, 5, 100])
def test_exact_does_not_depend_on_the_cut(spark, cut):
    df = spark.createDataFrame(ROWS, SCHEMA)
    cols = ["doc_id", "keep_id", "group_size", "kept"]
    assert sorted(map(str, exact.verdicts(df, cut=cut).select(cols).collect())) == sorted(map(str, exact.verdicts(df).select(cols).collect()))


def test_keep_first_leaves_one_row_of_each_text(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = exact.keep_first(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [3, 4, 6, 8, 9, 11]
    assert exact.keep_first(df.limit(0)).count() == 0


def test_perfect_hash_is_minimal_and_refuses_others():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 2**63, (20_000, 4), dtype=np.int64).view(np.uint64)
    index = exact.PerfectHash(keys)
    assert sorted(index.slots(keys)) == list(range(len(keys)))
    assert len(exact.PerfectHash(keys[:0]).slots(keys[:5])) == 5


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(rows):
    """Brute force: ids and fingerprints, linked at 3 or fewer bits."""
    label = list(range(len(rows)))
    fps = np.array([f for _, f in rows], dtype=np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3):
            a, b = label[i], label[int(j)]
            if a != b:
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {x: min((rows[i][0] for i in range(len(rows)) if label[i] == x and rows[i][0] is not None), default=None) for x in set(label)}
    return [(rows[i][0], f"{rows[i][1]:016x}", least[label[i]]) for i in range(len(rows))]


def test_simhash_query_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in queries.op8_simhash(spark, sf).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got) == sorted(classes([(r[0], fingerprint(r[1])) for r in docs]))


def test_simhash_edge_cases(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = [(r[0], f"{r[1] & (2**64 - 1):016x}", r[2]) for r in simhash.near_classes(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, classes([(d, fingerprint(t)) for d, t, _ in ROWS])))
    assert simhash.near_classes(df.limit(0)).count() == 0
    assert sorted(str(r[0]) for r in simhash.keep_one(df).collect()) == sorted({str(x[2]) for x in got})


def test_keep_one_leaves_a_row_of_each_component_whatever_its_id(spark):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    assert len({x[2] for x in classes([(i, fingerprint(t)) for i, t in enumerate(texts)])}) == len(texts)
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (2, texts[5]), (7, texts[5]), (None, texts[5])]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [*((None, t) for t in texts[:3]), (7, texts[3]), (7, texts[4]), (2, texts[5])]))


def test_every_distance_up_to_three_shares_a_key():
    rng = np.random.default_rng(1)
    masks = simhash.ball_keys()
    for _ in range(300):
        a = int(rng.integers(0, 2**63))
        b = a
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b ^= 1 << int(bit)
        keys = [{((x - (1 << 64) if x >> 63 else x) & k) ^ f for k, f in masks} for x in (a, b)]
        assert keys[0] & keys[1]


def linked(fps, radius=3):
    """Brute force: the first of the rows (of one or more words) that each one reaches."""
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]).reshape(len(fps), -1).sum(axis=1) <= radius):
            a, b = sorted((label[i], label[int(j)]))
            label = [a if x == b else x for x in label]
    return label


@pytest.mark.parametrize("spread", [12, 20])
def test_large_groups_keep_all_links(monkeypatch, spread):
    rng = np.random.default_rng(spread)
    fps = np.unique(rng.integers(0, 1 << spread, 400, dtype=np.int64).astype(np.uint64) << np.uint64(3))[:, None]
    want = linked(fps)
    for most in (2, 100, 1000):
        monkeypatch.setattr(simhash, "MATRIX_ROWS", most)
        assert simhash.classes(fps, 3).tolist() == want


def test_crowded_keys_are_passed_on_and_keep_all_links(spark, monkeypatch):
    rng = np.random.default_rng(8)
    fps = np.unique(rng.integers(0, 1 << 16, 600, dtype=np.int64) | rng.choice([0, *[1 << b for b in range(16, 62)]], 600) | 5 << 40)
    want = linked(fps.view(np.uint64))
    monkeypatch.setattr(simhash, "KEY_MOST", 20)
    nodes = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    root = {r["node"]: r["root"] for r in components(simhash.fingerprint_edges(nodes)).collect()}
    got = {}
    for f, w in zip(fps.tolist(), want):
        assert got.setdefault(w, root.get(f, f)) == root.get(f, f)
    assert len(set(got.values())) == len(got)


def test_no_task_holds_more_of_a_key_than_it_may():
    """Batches of one key: beyond `most` rows they are passed on as they come."""
    import pyarrow as pa

    fps = np.arange(5000, dtype=np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.full(500, 7)), pa.array(fps[i : i + 500])], names=["key", "fp"]) for i in range(0, 5000, 500)]
    after = pa.RecordBatch.from_arrays([pa.array([8, 8]), pa.array([1, 3])], names=["key", "fp"])
    made = list(simhash.collide(3, 600, step=400)([*batches, after]))
    out = [(u, v) for b in made for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert out == [(i, i) for i in range(5000)] + [(1, 3)]


def shingles(text):
    """The set of a text's runs of five words, or its words if it has fewer."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar_links(rows):
    """Brute force: pairs of rows (id, text) whose shingle sets have a Jaccard similarity of 0.8 or more, or are equal."""
    sets, holders, pairs = [shingles(t) for _, t in rows], {}, []
    for i, own in enumerate(sets):
        common = Counter(j for s in own for j in holders.get(s, ()))
        pairs += [(j, i) for j, n in common.items() if 5 * n >= 4 * (len(own) + len(sets[j]) - n)]
        pairs += [] if own else [(j, i) for j in range(i) if not sets[j]]
        for s in own:
            holders.setdefault(s, []).append(i)
    return pairs


def similar_classes(rows):
    """Brute force: the first row that each row reaches over similar_links()."""
    label = list(range(len(rows)))
    for i, j in similar_links(rows):
        a, b = sorted((label[i], label[j]))
        label = [a if x == b else x for x in label]
    return label


def test_similar_texts_leave_one_row_of_each_group(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    label = similar_classes(rows)
    least = {min(d for (d, _), y in zip(rows, label) if x == y) for x in set(label)}
    got = similar.keep_dissimilar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r[0] for r in got.collect()} == least


def changed(rng, words, n, mark):
    other = list(words)
    for at in rng.choice(len(words), n, replace=False):
        other[at] = f"{mark}{rng.integers(0, 10**6)}"
    return " ".join(other)


@pytest.mark.parametrize(("most", "last", "part", "pivots"), [(1 << 14, 48, 512, 3), (30, 48, 40, 3), (30, 12, 40, 1), (8, 30, 16, 2)])
def test_planted_near_copies_are_met_and_others_stay(spark, monkeypatch, most, last, part, pivots):
    """Against true similarities: pairs just above 0.8 and just below it, one large close group, one large loose one, one of texts below 0.8, with small keys, few levels and small parts as well."""
    for name, value in {"KEY_MOST": most, "LAST_BITS": last, "PART": part, "PIVOTS": pivots}.items():
        monkeypatch.setattr(similar, name, value)
    rng = np.random.default_rng(4)
    draw = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    rows = []
    for i in range(120):
        words = draw(300)
        rows.append((10 * i, " ".join(words)))
        if i < 80:  # of the shingles 0.82 are shared, or 0.76
            rows.append((10 * i + 1, changed(rng, words, 6 if i < 60 else 9, "x")))
    for base, n, size in ((100_000, 1, 150), (200_000, 4, 100), (300_000, 11, 100)):
        words = draw(300)
        rows += [(base, " ".join(words)), *[(base + k, changed(rng, words, n, "y")) for k in range(1, size)]]
    rows += [(400_000, None), (400_001, ""), (400_002, "one two"), (400_003, "One  TWO"), (400_004, "one two"), (None, rows[0][1])]
    links = similar_links(rows)
    label = similar_classes(rows)
    ids = [d for d, _ in rows]
    least = {x: min(ids[i] for i in range(len(rows)) if label[i] == x and ids[i] is not None) for x in set(label)}
    assert 0.7 < len({label[i] for i in range(len(rows)) if 300_000 <= (ids[i] or 0) < 400_000}) / 100
    got = [r[0] for r in similar.keep_dissimilar(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(set(got)) and None not in got
    assert set(least.values()) <= set(got)  # nothing goes but for a text that it is connected to
    still = [p for p in links if ids[p[0]] in got and ids[p[1]] in got]
    pairs = [p for p in links if (ids[p[0]] or 0) < 100_000]
    assert len([p for p in still if p in pairs]) <= 0.1 * len(pairs) and len(still) <= 0.02 * len(links)


def test_links_of_sets_equal_brute_force():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    sets = [np.unique(rng.choice(base, rng.integers(0, 40), replace=False)) for _ in range(60)] + [base[:0]]
    near = lambda a, b: len(np.intersect1d(a, b)) >= similar.SIMILAR * len(np.union1d(a, b)) - 1e-9 and len(np.intersect1d(a, b)) > 0
    a, b = similar.similar_pairs(sets[:20], sets)
    assert sorted(zip(a.tolist(), b.tolist())) == [(i, j) for i in range(20) for j in range(61) if near(sets[i], sets[j])]
    label = list(range(61))
    for i in range(61):
        for j in range(i):
            if near(sets[i], sets[j]):
                x, y = sorted((label[i], label[j]))
                label = [x if k == y else k for k in label]
    assert similar.set_classes(sets).tolist() == label


@pytest.mark.parametrize("pivots", [1, 2, 3, 5])
def test_links_of_a_large_component_equal_brute_force(spark, monkeypatch, pivots):
    """Three chains: stars of later pivots are linked to the first one's only by nodes that are no pivots."""
    monkeypatch.setattr(similar, "PIVOTS", pivots)
    sets = {}
    for chain in range(3):
        words = np.random.default_rng(chain).integers(0, 2**63, 200).astype(np.uint64)
        for k in (1, 0, 3, 2, 5, 4, 7, 6):  # neighbours share 95 of 105, those two apart 90 of 110
            sets[1000 * chain + 10 * (k % 2) + k // 2] = np.unique(words[5 * k : 5 * k + 100])
        sets |= {1000 * chain + 500 + k: np.unique(words[35 + 5 * k : 135 + 5 * k]) for k in range(1, 9)}
    rows = [(root, node + (0 if root == 5 else 10_000), bytearray(s.tobytes()), 3) for root in (5, 6) for node, s in sets.items()]
    found = similar.large_links(spark.createDataFrame(rows, "root long, node long, hashes binary, parts long"))
    got = {r["node"]: r["root"] for r in components(found).collect()}
    nodes, label = [r[1] for r in rows], {r[1]: r[1] for r in rows}
    own = {r[1]: set(np.frombuffer(bytes(r[2]), dtype=np.uint64).tolist()) for r in rows}
    for a in nodes:
        for b in nodes:
            if a < b and (a < 10_000) == (b < 10_000) and len(own[a] & own[b]) >= similar.SIMILAR * len(own[a] | own[b]):
                x, y = sorted((label[a], label[b]))
                label = {n: x if c == y else c for n, c in label.items()}
    assert len(set(label.values())) == 6
    assert {n: got.get(n, n) for n in nodes} == label


def test_crowded_keys_are_handed_on_row_by_row():
    import pyarrow as pa

    def batch(keys, nodes):
        return pa.RecordBatch.from_arrays([pa.array(np.array(c, dtype=np.int64)) for c in (keys, nodes, [0] * len(keys), [0] * len(keys))], names=["key", "node", "w0", "w1"])

    batches = [batch([1, 1, 7], [50, 51, 0]), *[batch([7] * 500, range(a, a + 500)) for a in range(1, 2001, 500)], batch([8, 8, 9], [1, 3, 4])]
    out = lambda last: [x for b in similar._met(600, last)(iter(batches)) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert out(False) == [(50, 51), *[(i, i) for i in range(2001)], (1, 3)]
    assert out(True) == [(50, 51), *[(0, i) for i in range(2001)], (1, 3)]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(200, 199), (5, 5)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 199: 199, 200: 199}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    hub = spark.range(1, 100_001).selectExpr("id as u", "cast(0 as long) as v")
    assert components(hub).where("root = 0").count() == 100_001


def test_pieces_match_the_library(spark):
    model = queries.tokenizer_file()
    sp = pieces.processor(model)
    df = spark.createDataFrame([(*r[:2], "clash") for r in ROWS], "doc_id long, text string, ids string")
    made = pieces.decode(pieces.encode(df, model), model)
    assert made.columns == ["doc_id", "text", "ids", "decoded"]
    for r in made.collect():
        assert r["ids"] == sp.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["decoded"] == sp.decode(r["ids"])
    assert pieces.encode(df.limit(0), model).count() == 0


def test_pieces_query_matches_the_library(spark, sf):
    sp = pieces.processor(queries.tokenizer_file())
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in queries.op1_sentencepiece(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = sp.encode(text or "", add_bos=True, add_eos=True)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
