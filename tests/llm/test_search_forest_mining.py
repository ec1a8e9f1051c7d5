"""Ranked search, the MinHash forest and hard-negative mining against plain versions."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import forest, mining, queries, ranked
from tidemark.llm.common import table

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _prose(dice, words, n):
    return " ".join(dice.choice(words) for _ in range(n))


def _corpus():
    dice = random.Random(5)
    words = ["".join(dice.choice("abcdeé") for _ in range(dice.randint(1, 7))) for _ in range(250)]
    docs = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE Two"), (5, "one,two!"), (6, _prose(dice, words, 9000)), (None, "null id é1 x")]
    docs += [(10 + i, _prose(dice, words, dice.randint(1, 120))) for i in range(120)]
    base = _prose(dice, words, 140).split()
    for i in range(60):  # a chain and a crowd of near copies, at and around the threshold
        copy = list(base)
        for _ in range(i % 9):
            copy[dice.randrange(len(copy))] = dice.choice(words)
        docs.append((200 + i, " ".join(copy)))
    docs += [(300 + i, " ".join(base)) for i in range(25)] + [(10, docs[8][1]), (301, " ".join(base))]
    return docs


CORPUS = _corpus()


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with columns whose names the operators use themselves."""
    rows = [(i, t, "x", 1, 2, "b", 3) for i, t in CORPUS]
    return spark.createDataFrame(rows, "doc_id long, text string, SCORE string, row int, n int, _key string, rank int").repartition(3)


def _terms(text):
    return [t for t in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if t]


def _ranked(docs, items):
    held = [(i, Counter(_terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(size for _, _, size in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for i, c, size in held:
            m = 75 + (25 * size * n) // total
            score = sum(ranked.weight(n, df[t]) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in _terms(text) if t in c)
            if score > 0:
                scored.append((-score, 2**63 if i is None else i, i))
        out += [(item_id, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: x[:2])[:20], 1)]
    return sorted(out, key=str)


ITEMS = [
    (1, CORPUS[20][1]), (2, None), (3, "nothing of it qqq"), (4, "one ONE two é1 x"), (5, CORPUS[60][1] + " " + CORPUS[70][1]), (None, "one"),
    (6, " ".join(t for _, t in CORPUS[10:40])), (6, "two"), (4, "one ONE two é1 x"),
]


@pytest.mark.parametrize("sizes", [(8192, 1 << 20, 8 << 20), (16, 50, 400)])
def test_ranked_search(spark, docs, monkeypatch, sizes):
    for name, value in zip(("CHUNK_DOCS", "CHUNK_POSTINGS", "BLOCK_BYTES"), sizes, strict=True):
        monkeypatch.setattr(ranked, name, value)
    items = spark.createDataFrame([(i, t, 7) for i, t in ITEMS], "item_id long, text string, doc_id int")
    got = ranked.search(docs, items).select("item_id", "rank", "doc_id", "score")
    assert sorted(map(tuple, got.collect()), key=str) == _ranked(CORPUS, list(dict.fromkeys(ITEMS)))


def test_ranked_search_of_nothing(spark, docs):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert ranked.search(docs.where("false"), items).collect() == []
    assert ranked.search(docs, items.where("false")).collect() == []
    assert ranked.search(docs.where("doc_id < 3"), items).collect() == []


def _set(text):
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    return frozenset(" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))) if found else frozenset()


def _near(docs):
    sets = [_set(t) for _, t in docs]
    label = list(range(len(docs)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                label[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(docs):
        groups[root(i)].append(2**63 if doc_id is None else doc_id)
    out = []
    for i, (doc_id, _) in enumerate(docs):
        least = min(groups[root(i)])
        least = None if least == 2**63 else least
        out.append((doc_id, len(sets[i]), least, doc_id == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("region", [1024, 8])
def test_forest(docs, monkeypatch, region):
    monkeypatch.setattr(forest, "REGION", region)
    found = forest.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, found.collect()), key=str) == _near(CORPUS)


def test_forest_keeps_one(docs):
    kept = forest.keep_one(docs)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _, _, stays in _near(CORPUS) if stays), key=str)
    assert kept.columns == [c for c in docs.columns if c != "_key"]


def test_forest_of_nothing(docs):
    assert forest.near_duplicates(docs.where("false")).collect() == []
    assert forest.keep_one(docs.where("text is null")).count() == 1


def test_minima_and_cut_hashes():
    hashes = forest.shingle_hashes(" ".join(map(str, range(2000))).encode())
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    assert all(m == (low * f).min() for m, f in list(zip(forest.minima(hashes), forest._FACTORS, strict=True))[::40])
    assert (forest._opened(forest._brief(hashes)) == (hashes >> np.uint64(40))).all()
    assert forest._is_linked(hashes, hashes) and not forest._is_linked(hashes[:800], hashes[200:])


def test_neighbours_on_the_curve_differ_by_one_step():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    places = [p.tobytes() for p in mining.curve_place(grid, 3)]
    assert len(set(places)) == len(grid)
    walk = grid[sorted(range(len(grid)), key=places.__getitem__)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def _mined(rows):
    held = []
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        held.append((i, [int(np.floor(256 * float(x))) for x in vector], (label + 1) % 10 if i % 7 == 0 else label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, a, label in {(i, tuple(v), k) for i, v, k in held if i % 50 == 0}:
        scored = sorted((-dot(a, v), j, k) for j, v, k in held if j != i)
        for p, j, _ in [x for x in scored if x[2] == label][:5]:
            p = -p
            inside = [(j2, -s) for s, j2, k in scored if k != label and 50 * p <= -100 * s <= 95 * p][:3]
            out += [(i, j, r, n, p, s) for r, (n, s) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(256, 1 << 21, 1 << 20), (8, 40, 16)])
def test_hard_negatives(spark, monkeypatch, sizes):
    for name, value in zip(("BLOCK_ROWS", "SLICE_VALUES", "HELD"), sizes, strict=True):
        monkeypatch.setattr(mining, name, value)
    dice = np.random.default_rng(2)
    rows = [(int(i), dice.normal(0.05, 0.2, 6).astype(np.float32).tolist(), int(dice.integers(0, 3))) for i in range(700)]
    rows += [(700 + i, [0.25] * 6, i % 2) for i in range(200)]  # one vector many times
    rows += [(950, None, 1), (1000, [0.5, None, 1.0, 0.0, 0.0, 0.0], 1), (1050, [float("nan")] * 6, 1), (1100, [float("inf")] * 6, 2), (None, [1.0] * 6, 1)]
    rows += [(1150, [0.5, 0.5], 1), (1200, [], 1), (1250, [0.1] * 6, None), (50, rows[50][1], rows[50][2]), (650, [0.3] * 6, 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, score int, block string").repartition(4)
    got = mining.hard_negatives(df)
    assert sorted(map(tuple, got.collect())) == _mined(rows)


def test_hard_negatives_of_nothing_and_of_large_numbers(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert mining.hard_negatives(spark.createDataFrame([], schema)).collect() == []
    rows = [(i, [1e5 * (i % 11) + 1.0, 3.5], i % 3) for i in range(120)]
    assert sorted(map(tuple, mining.hard_negatives(spark.createDataFrame(rows, schema)).collect())) == _mined(rows)


@pytest.mark.parametrize("name", ["op11_ranked_search", "op13_hard_negatives"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SMALL).toPandas()[list(want.columns)]
    key = list(want.columns)
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want[key].to_numpy().tolist())) and len(got)


def test_forest_on_a_given_table(spark):
    rows = table(spark, SMALL, "documents")
    pairs = [(r.doc_id, r.text) for r in rows.collect()]
    found = queries.QUERIES["op12_lsh_forest"](spark, SMALL).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, found.collect()), key=str) == _near(pairs)
    assert found.where(F.col("kept") != (F.col("doc_id") == F.col("component_id"))).isEmpty()


def test_a_bitmap_keeps_all_rows_of_the_keys_and_few_others(spark):
    from tidemark.llm.common import likely

    rows = spark.range(-5000, 45000).select((F.col("id") * 7919).alias("k"), F.col("id").cast("string").alias("text"))
    keys = rows.where("text % 50 = 3").select(F.col("k").alias("key")).unionByName(spark.sql("SELECT CAST(NULL AS LONG) AS key"))
    kept = likely(rows, "k", keys)
    assert kept.columns == rows.columns and "hashpartitioning(k" not in kept._jdf.queryExecution().executedPlan().toString()
    wanted = {r.text for r in rows.join(keys, F.col("k") == F.col("key")).collect()}
    found = [r.text for r in kept.collect()]
    assert wanted and wanted <= set(found) and len(found) == len(set(found)) < len(wanted) + 1000
    assert likely(rows, "k", keys.where("false")).count() == 0


def test_texts_without_a_partner_do_not_move(spark, monkeypatch):
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    texts = [words(i) for i in range(60)] + [f"{words(0)} more", f"{words(1)} more"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    seen, likely = [], forest.likely
    monkeypatch.setattr(forest, "likely", lambda rows, *given: seen.append(likely(rows, *given)) or seen[-1])
    found = {r.doc_id: r.component_id for r in forest.near_duplicates(docs).collect()}
    assert found == {**{i: i for i in range(60)}, 60: 0, 61: 1}
    (moved,) = [x for x in seen if "text" in x.columns]
    assert {r.doc_id for r in moved.collect()} >= {0, 1, 60, 61} and moved.count() < 10
