"""Top-k search and embedding near-duplicates against brute force."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumetrics.llm import embedding_dedup, topk_search
from plumetrics.llm.common import table
from plumetrics.llm.queries import ORACLES

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, key int"
ODD = [(900, None, 1, "", 0), (901, [1.0, None], 1, "", 0), (902, [float("nan"), 1.0], 1, "", 0),
       (903, [float("inf"), 1.0], 1, "", 0), (904, [0.0, 0.0], 1, "", 0), (905, [], 1, "", 0), (906, [1.0, 1.0], None, "", 0)]


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_top(rows, k=20, step=20):
    v = {i: [math.floor(64 * float(x)) for x in e] for i, e, *_ in rows if good(e) and i is not None}
    out = []
    for q in v:
        if q % step == 0:
            scores = sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def brute_links(rows, least=0.98):
    """vec_id -> (links, component) for rows with distinct ids."""
    ids = [r[0] for r in rows]
    links = {i: set() for i in ids}
    by = {}
    for i, e, label, *_ in rows:
        if label is not None and good(e) and any(e):
            by.setdefault((label, len(e)), []).append((i, np.array(e, np.float64)))
    for group in by.values():
        m = np.stack([e for _, e in group])
        n = np.linalg.norm(m, axis=1)
        c = (m @ m.T) / np.outer(n, n)
        for a, b in zip(*np.nonzero(c >= least)):
            if a != b:
                links[group[a][0]].add(group[b][0])
    comp = {}
    for i in sorted(ids):
        if i not in comp:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = i
                    todo += links[x]
    return {i: (len(links[i]), comp[i]) for i in ids}


@pytest.mark.parametrize("scale, width", [(1.0, 8), (1e4, 6), (5e6, 4)])
def test_top_k(frame, rows, scale, width):
    rnd = random.Random(width)
    data = [(i, [float(np.float32(rnd.gauss(0, scale))) for _ in range(width)], 1, "", 0) for i in range(300)]
    data += [(300 + i, data[i % 7][1], 1, "", 0) for i in range(60)] + ODD + [(907, [2.0 * scale], 1, "", 0), (None, [1.0], 1, "", 0)]
    df = frame([*data, *data[:30]], SCHEMA).repartition(4)
    for lists, qb, rb in ((4, 7, 50), (1, 512, 4096), (3, 5, 11)):
        got = topk_search.top_k(df, F.col("vec_id") % 20 == 0, lists=lists, query_block=qb, row_block=rb)
        assert rows(got) == brute_top(data)


def test_top_k_few_rows_and_none(frame, rows):
    data = [(0, [1.0, 0.5], 1, "", 0), (1, [1.0, 0.5], 1, "", 0), (2, [-1.0, 0.0], 1, "", 0)]
    assert rows(topk_search.top_k(frame(data, SCHEMA), F.col("vec_id") % 20 == 0)) == brute_top(data)
    assert rows(topk_search.top_k(frame(data[:1], SCHEMA), F.col("vec_id") % 20 == 0)) == []
    assert rows(topk_search.top_k(frame([], SCHEMA), F.col("vec_id") % 20 == 0)) == []


def test_top_k_sends_no_copies_through_the_driver(spark, frame, rows, monkeypatch):
    """The copies of tiles or blocks for each other one are far more than the stored tables, by whose size the planner broadcasts."""
    rnd = random.Random(9)
    data = [(i, [rnd.gauss(0, 1) for _ in range(4)], 1, "", 0) for i in range(600)]
    plans = []
    explained = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    cut = topk_search.cut_lineage
    monkeypatch.setattr(topk_search, "cut_lineage", lambda df, label="step": explained(df) or cut(df, label))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        got = topk_search.top_k(frame(data, SCHEMA), F.col("vec_id") % 20 == 0, query_block=2, row_block=5)
        explained(got)
        assert len(plans) > 2 and not [p for p in plans if "Broadcast" in p]
        assert rows(got) == brute_top(data)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("count, width, number", [
    (0, 0, 1), (3000, 64, 1), (51282, 64, 13), (615384, 64, 19), (10**7, 64, 306), (10**6, 768, 184), (10**5, 1 << 20, 25)])
def test_tiles_are_bounded_and_enough(count, width, number):
    """Tiles hold at most eight blocks and 32 MB of numbers, down to one block; few rows make up to 16 of them."""
    assert topk_search.tile_count(count, width, 4096, topk_search.ROW_TILE, topk_search.ROW_TILES) == number


def test_near_vectors(frame, rows):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    data = [(i, base[i % 40] + rng.standard_normal(16) * rng.choice([0.0, 0.03, 0.3]), i % 3) for i in range(500)]
    data = [(i, [float(np.float32(x)) for x in e], label, "", 0) for i, e, label in data]
    data += [(600 + i, data[0][1], data[0][2], "", 0) for i in range(40)] + ODD + [(908, [-0.0, 1.0], 4, "", 0), (909, [0.0, 1.0], 4, "", 0)]
    df = frame(data, SCHEMA).repartition(5)
    want = brute_links(data)
    for window in (1024, 64):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df, window=window).collect()}
        assert got.keys() == want.keys()
        # Bounded windows may miss a link, never invent one.
        assert all(got[i][0] <= want[i][0] for i in want)
        assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())
        if window == 1024:
            assert got == want


@pytest.mark.parametrize("others", [0, 200])
def test_dense_group_beyond_the_window(frame, others):
    """A group of many windows keeps every link, each counted once, and stays one component."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    data = [(i, [float(x) for x in centre + 0.01 * rng.standard_normal(16)], 1, "", 0) for i in range(600)]
    data += [(600 + i, [float(x) for x in rng.standard_normal(16)], 1, "", 0) for i in range(others)]
    got = embedding_dedup.near_duplicates(frame(data, SCHEMA), window=32).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == brute_links(data)


def test_sparse_group_beyond_the_window(frame):
    """A group of many windows, each vector linked with few of a window, keeps its links."""
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(64)
    data = [(i, [float(np.float32(x)) for x in centre + 0.17 * rng.standard_normal(64)], 1, "", 0) for i in range(400)]
    want = brute_links(data)
    n_links = [n for n, _ in want.values()]
    assert 5 < np.mean(n_links) < 0.2 * len(data)
    got = embedding_dedup.near_duplicates(frame(data, SCHEMA), passes=3, window=32).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want


def test_pairs_are_compared_once():
    """A pair belongs to the first step and pass that compare it, whatever the blocks and their reach."""
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 9, (200, 3)), rng.integers(0, 9, (200, 3))
    reach = rng.integers(0, 4, 9)
    for x, y in zip(a, b):
        compared = []
        for p in range(3):
            gap = abs(int(x[p]) - int(y[p]))
            step = next(s for s in range(5) if gap <= 2 ** s)
            if step <= reach[min(x[p], y[p])]:
                compared.append((step, p))
        first = [c for c in compared if not embedding_dedup.compared_before(
            x[None], reach[x][None], y[None], reach[y][None], *c)[0]]
        assert first == sorted(compared)[:1]


def test_vectors_repeated_ids_and_empty(frame, rows):
    data = [(1, [1.0, 0.0], 1, "", 0)] * 3 + [(None, [1.0, 0.0], 1, "", 0), (None, None, 1, "", 0)]
    assert rows(embedding_dedup.near_duplicates(frame(data, SCHEMA))) == sorted(
        [(1, 3, 1, True)] * 3 + [(None, 3, 1, False), (None, 0, None, True)], key=repr)
    assert rows(embedding_dedup.near_duplicates(frame([], SCHEMA))) == []


def test_whole_tables(spark, rows, sf_dir):
    from plumetrics.llm.queries import QUERIES
    data = [tuple(r) for r in table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").collect()]
    assert rows(QUERIES["op2_topk_search"](spark, sf_dir)) == brute_top(data)
    want = brute_links(data)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in QUERIES["op4_embedding_dedup"](spark, sf_dir).collect()}
    assert got == want


def test_top_k_keeps_rows_that_repeat_an_id(spark, frame, rows):
    data = [(1, [0.5, 0.0]), (1, [1.0, 0.0]), (2, [0.75, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (3, [-1.0, 2.0])]
    df = frame([(i, v, 1, "", 0) for i, v in data], SCHEMA)
    got = topk_search.top_k(df, F.col("vec_id") % 20 == 0, query_rows=True)
    assert (20, 1, 1, 4096) in rows(got.drop("query_row")) and got.select("query_row").distinct().count() == 2
    connection = duckdb.connect()
    connection.register("embeddings", pa.table({"vec_id": [i for i, _ in data], "embedding": [v for _, v in data]}))
    assert rows(got.drop("query_row")) == sorted(connection.execute(ORACLES["op2_topk_search"]).fetchall(), key=repr)


def test_links_of_tiny_and_huge_vectors(frame):
    data = [(1, [1e-200, 0.0]), (2, [3e-200, 1e-202]), (3, [1e200, 0.0]), (4, [2e200, 1e198]), (5, [0.0, 1e-200]), (6, [5e-324, 0.0]), (7, [0.0, 1.7e308])]
    got = embedding_dedup.near_duplicates(frame([(i, v, 1) for i, v in data], "vec_id long, embedding array<double>, label int")).collect()
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}
    assert found == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 6: (4, 1), 5: (1, 5), 7: (1, 5)}
