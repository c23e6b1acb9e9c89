import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.operators import balls, cell_index, knn, metrics


def unit_rows(n, d, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, **columns):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    for name, values in columns.items():
        extra = spark.createDataFrame(list(enumerate(values)), f"id long, {name} string")
        df = df.join(extra, "id")
    return df


def brute(x, ids, k, groups=None):
    """(query, rank, neighbour) by score, then id; self excluded."""
    s = x.astype(np.float64) @ x.astype(np.float64).T
    out = []
    for i, q in enumerate(ids):
        order = sorted(
            (j for j in range(len(ids)) if ids[j] != q and (groups is None or groups[j] == groups[i])),
            key=lambda j: (-round(s[i, j], 12), ids[j]),
        )
        out += [(q, r, ids[j]) for r, j in enumerate(order[:k])]
    return sorted(out)


def collected(df):
    return sorted((r["query_id"], r["rank"], r["neighbor_id"]) for r in df.collect())


def test_self_ranks_first_and_scores_fall(spark):
    x = unit_rows(10, 8)
    hits = knn.cosine_topk(frame(spark, x), x[3].tolist(), 5, id_col="id").orderBy("rank").collect()
    assert hits[0]["id"] == 3 and abs(hits[0]["score"] - 1) < 1e-6
    scores = [h["score"] for h in hits]
    assert scores == sorted(scores, reverse=True) and [h["rank"] for h in hits] == [0, 1, 2, 3, 4]


def test_exclusion_removes_rows(spark):
    x = unit_rows(10, 8)
    hits = knn.cosine_topk(frame(spark, x), x[3].tolist(), 20, id_col="id", exclude=[3, 4]).collect()
    assert len(hits) == 8 and {3, 4}.isdisjoint({h["id"] for h in hits})


def test_bad_arguments(spark):
    df = frame(spark, unit_rows(3, 4))
    with pytest.raises(ValueError):
        knn.cosine_topk(df, [1.0, 0, 0, 0], 0, id_col="id")
    with pytest.raises(ValueError):
        knn.cosine_topk(df, [], 1, id_col="id")
    with pytest.raises(Exception, match="mismatch"):
        knn.cosine_topk(df, [1.0, 0.0], 1, id_col="id").collect()


def test_unknown_seed(spark):
    store = frame(spark, unit_rows(3, 4)).withColumn("track_id", F.col("id").cast("string"))
    with pytest.raises(KeyError):
        knn.search_by_id(store, "nobody")


def test_empty_store_gives_no_hits(spark):
    empty = spark.createDataFrame([], "track_id string, path string, embedding array<float>")
    assert knn.search(empty, [1.0, 0.0], 5).count() == 0


@pytest.mark.parametrize("block_rows", [None, 16, 40])
@pytest.mark.parametrize("partitions", [1, 5])
def test_join_equals_brute_force(spark, block_rows, partitions):
    x = unit_rows(120, 12, seed=1)
    x[100:] = x[7]  # copies: ties go to the smaller id
    df = frame(spark, x).repartition(partitions)
    got = knn.knn_join(df, df, 6, exclude_self=True, block_rows=block_rows)
    assert collected(got) == brute(x, list(range(120)), 6)


@pytest.mark.parametrize("block_rows", [None, 16])
def test_join_by_key_equals_brute_force(spark, block_rows):
    x = unit_rows(120, 12, seed=2)
    groups = ["hot" if i % 3 == 0 else f"g{i % 25}" for i in range(120)]
    df = frame(spark, x, label=groups)
    got = knn.knn_join(df, df, 4, key="label", exclude_self=True, block_rows=block_rows)
    assert collected(got) == brute(x, list(range(120)), 4, groups)


def test_large_keys_are_cut_into_few_parts(spark, monkeypatch):
    """What is sent to the scoring tasks grows with the rows, not with their square; many blocks in a part change no answer."""
    sent, scored = [], knn._score_units

    def counted(left, right, plan, pairs):
        sent.append(left.count() + right.count())
        return scored(left, right, plan, pairs)

    monkeypatch.setattr(knn, "_score_units", counted)
    for n in (200, 800):
        x = unit_rows(n, 8, seed=n)
        groups = ["hot" if i % 4 else f"g{i % 3}" for i in range(n)]
        df = frame(spark, x, label=groups)
        got = knn.knn_join(df, df, 3, key="label", exclude_self=True, block_rows=4)
        assert collected(got) == brute(x, list(range(n)), 3, groups)
    assert sent[1] <= 4 * sent[0] and sent[0] <= 2 * knn.CUTS * 200
    # parts past their bytes are cut further, with the same answer
    monkeypatch.setattr(knn, "PART_BYTES", 4 * 8 * 20)
    assert collected(knn.knn_join(df, df, 3, key="label", exclude_self=True, block_rows=4)) == brute(x, list(range(n)), 3, groups)
    assert sent[2] > sent[1]


def test_vectors_travel_in_their_own_width(spark, monkeypatch):
    """32 bits stay 32 bits on the way to the tasks, and 64 bits stay exact."""
    packed, sizes = balls._packed, []

    def measured(*args):
        out = packed(*args)
        sizes.append(out.agg(F.sum(F.length("vectors"))).first()[0])
        return out

    monkeypatch.setattr(balls, "_packed", measured)
    x = unit_rows(90, 8, seed=31)
    single = frame(spark, x)
    assert collected(knn.knn_join(single, single, 3, exclude_self=True, block_rows=16)) == brute(x, list(range(90)), 3)
    wide = x.astype(np.float64) + 1e-9 * np.random.default_rng(1).standard_normal(x.shape)
    double = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(wide)], "id long, embedding array<double>")
    assert collected(knn.knn_join(single, double, 3, block_rows=16)) == sorted(
        (i, r, int(j)) for i, row in enumerate(x.astype(np.float64) @ wide.T) for r, j in enumerate(np.argsort(-row)[:3])
    )
    assert sizes == [4 * 90 * 8, 4 * 90 * 8, 8 * 90 * 8, 4 * 90 * 8]


def test_batches_of_visits_are_small_and_settings_come_back(spark, monkeypatch):
    key, seen, written = "spark.sql.execution.arrow.maxBytesPerBatch", {}, balls.materialize

    def noted(df, name):
        seen[name] = int(spark.conf.get(key))
        return written(df, name)

    monkeypatch.setattr(balls, "materialize", noted)
    before = spark.conf.get(key)
    df = frame(spark, unit_rows(90, 8, seed=32))
    knn.knn_join(df, df, 3, exclude_self=True, block_rows=16).collect()
    assert seen["ball-wave-0"] == balls.VISIT_BYTES and spark.conf.get(key) == before


def test_scoring_a_block_takes_little_memory():
    import tracemalloc

    rng = np.random.default_rng(0)
    q, c = rng.standard_normal((1024, 64)), rng.standard_normal((16_384, 64))
    tracemalloc.start()
    for _ in knn._block_topk(q, c, np.ones(len(c), np.int64), np.arange(len(c)), 21, np.full(len(q), 0.0)):
        pass
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()


def test_cells_prune_and_stay_exact(spark):
    """Tight clusters, vectors of different lengths, many equal ones, text ids."""
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((6, 16)) * 3
    x = np.concatenate([c + 0.05 * rng.standard_normal((50, 16)) for c in centers]).astype(np.float32)
    x[10:40] = x[10]
    rows = [(f"t{i:03d}", [float(v) for v in row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    got = knn.knn_join(df, df, 5, exclude_self=True, block_rows=32, pivots=8)
    assert collected(got) == brute(x, [r[0] for r in rows], 5)


@pytest.mark.parametrize("way", [{}, {"block_rows": 16}, {"key": "label", "block_rows": 16}])
def test_bad_vectors_and_repeated_ids_raise_in_every_way(spark, way):
    x = unit_rows(60, 8, seed=6)
    good = frame(spark, x, label=["a"] * 60)
    x[11, 3] = np.nan
    bad = frame(spark, x, label=["a"] * 60)
    with pytest.raises(Exception, match="NaN"):
        knn.knn_join(good, bad, 3, **way).collect()
    with pytest.raises(ValueError, match="repeats"):
        knn.knn_join(good, good.union(good), 3, exclude_self=True, **way)


def test_a_large_block_size_does_not_broadcast_more_bytes(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_BYTES", 1)
    x = unit_rows(300, 8, seed=7)
    sent = []
    monkeypatch.setattr(knn, "_one_block", lambda *a: sent.append(1))
    assert collected(knn.knn_join(frame(spark, x), frame(spark, x), 2, exclude_self=True, block_rows=10**6)) == brute(x, list(range(300)), 2)
    assert not sent


def test_two_tables(spark):
    c, q = unit_rows(90, 8, 4), unit_rows(7, 8, 5)
    for block_rows in (None, 16):
        got = knn.knn_join(frame(spark, q), frame(spark, c), 3, block_rows=block_rows)
        s = q.astype(np.float64) @ c.astype(np.float64).T
        want = sorted((i, r, int(j)) for i in range(7) for r, j in enumerate(np.argsort(-s[i])[:3]))
        assert collected(got) == want


def test_k_beyond_the_table_and_null_vectors(spark):
    df = frame(spark, unit_rows(4, 3)).unionByName(
        spark.createDataFrame([(9, None)], "id long, embedding array<float>")
    )
    got = knn.knn_join(df, df, 50, exclude_self=True).toPandas()
    assert len(got) == 12 and 9 not in set(got["query_id"]) | set(got["neighbor_id"])


def test_ragged_width_is_an_error(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "id long, embedding array<float>")
    with pytest.raises(Exception, match="mismatch"):
        knn.knn_join(df, df, 1).collect()


def test_clustered_vectors_visit_few_blocks(spark):
    """On clusters the ball bounds leave most pairs unscored; the answer is that of brute force."""
    rng = np.random.default_rng(8)
    centers = rng.standard_normal((24, 16)) * 4
    x = np.concatenate([c + 0.05 * rng.standard_normal((50, 16)) for c in centers])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df, stats = frame(spark, x), {}
    got = knn.knn_join(df, df, 5, exclude_self=True, block_rows=40, stats=stats)
    assert collected(got) == brute(x, list(range(len(x))), 5)
    assert stats["pairs"] < 0.25 * len(x) ** 2 and stats["leaves"] == 30


def test_a_crowded_leaf_is_many_parts(spark, monkeypatch):
    """Near-copies of one vector are dealt to blocks of bounded size, and exact copies are one row."""
    monkeypatch.setattr(balls, "PART_BLOCKS", 2)
    rng = np.random.default_rng(9)
    base = unit_rows(1, 8, 10)
    x = np.concatenate([base + 1e-4 * rng.standard_normal((300, 8)), np.repeat(base, 100, axis=0), unit_rows(100, 8, 11)]).astype(np.float32)
    df, stats = frame(spark, x), {}
    got = knn.knn_join(df, df, 4, exclude_self=True, block_rows=20, stats=stats)
    assert collected(got) == brute(x, list(range(len(x))), 4)
    assert stats["waves"] <= 5


def test_queries_far_from_the_corpus(spark):
    """A chunk whose own leaf has no rows of the corpus still finds its neighbours."""
    c, q = unit_rows(80, 4, 12), -3 * unit_rows(30, 4, 13)
    got = knn.knn_join(frame(spark, q), frame(spark, c), 3, block_rows=8)
    s = q.astype(np.float64) @ c.astype(np.float64).T
    assert collected(got) == sorted((i, r, int(j)) for i in range(30) for r, j in enumerate(np.argsort(-s[i], kind="stable")[:3]))


# ---- stored index


def test_index_reaches_the_recall_it_measures(spark, tmp_path):
    x = unit_rows(600, 8, 6)
    df, path = frame(spark, x), str(tmp_path / "index")
    assert cell_index.build_index(df, path, 20, id_col="id") == 1
    index = cell_index.open_index(spark, path)
    assert index.rows.count() == 600 and index.sizes.sum() == 600 and len(index.centers) == 20
    with pytest.raises(ValueError, match="isn't measured"):
        cell_index.search_index(index, df, 5, query_id="id")
    kept = cell_index.calibrate(index, df.where("id % 3 = 0"), 5, 0.9, "id", exclude_self=True)
    assert kept["recall"] >= 0.9 and kept["n_queries"] == 200 and kept["cells"] < 20
    exact = knn.knn_join(df, df, 5, exclude_self=True)
    near = cell_index.search_index(index, df, 5, query_id="id", exclude_self=True)
    share = metrics.neighbour_overlap(exact, near, 600, [5]).first()[0]
    assert 0.87 <= share < 1.0
    curve = {r["cells"]: r["recall"] for r in cell_index.recall_by_cells(index, df, 5, "id", exclude_self=True).collect()}
    assert curve[kept["cells"]] == pytest.approx(share) and curve[20] == 1.0  # the measure is what a search gives
    everywhere = cell_index.search_index(index, df, 5, cells=20, query_id="id", exclude_self=True)
    assert collected(everywhere) == collected(exact)
    few = cell_index.search_index(index, df, 3, query_id="id", exclude_self=True)  # measured at 5, good for 3
    assert few.groupBy("query_id").count().agg(F.min("count")).first()[0] == 3
    assert collected(cell_index.ann_topk(df, df, 5, target=1.0, exclude_self=True)) == collected(exact)


@pytest.mark.parametrize("cells", [1, 2, 3, 9, 30, 39, 40])
def test_search_of_some_cells_finds_what_they_hold(spark, tmp_path, monkeypatch, cells):
    """Against a plain search of the first cells; small parts and runs, a large cell, copies, and a centre that is never used."""
    monkeypatch.setattr(cell_index, "PART_ROWS", 40)
    monkeypatch.setattr(cell_index, "RUN_ROWS", 24)
    x = unit_rows(500, 6, 21)
    x[300:420] = x[3] + 0.01 * x[300:420]
    x[430:440] = x[5]
    centers = np.concatenate([x[:40], x[:1]])
    given = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centers)], "cell int, center array<float>")
    path = str(tmp_path / "index")
    cell_index.build_index(frame(spark, x), path, centers=given, id_col="id")
    index = cell_index.open_index(spark, path)
    got = cell_index.search_index(index, frame(spark, x), 5, cells=cells, query_id="id", exclude_self=True)
    y, c = x.astype(np.float64), centers.astype(np.float64)
    own = (y @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
    filled = np.unique(own)
    near, s, want = y @ c[filled].T, y @ y.T, []
    for i in range(len(x)):
        visited = filled[np.argsort(-near[i].round(12), kind="stable")[:cells]]
        order = sorted((j for j in np.flatnonzero(np.isin(own, visited)) if j != i), key=lambda j: (-round(s[i, j], 12), j))
        want += [(i, r, int(j)) for r, j in enumerate(order[:5])]
    assert len(filled) == 40 and collected(got) == sorted(want)


def test_search_sends_rows_a_bounded_number_of_times(spark, tmp_path, monkeypatch):
    """With a centre for every 8 rows, of which most are visited, nothing holds a row or a number for each visit."""
    sent, kept, scored, materialized = [], [], cell_index._score_cells, cell_index.materialize

    def counted(asked, offered, *rest):
        sent.append(asked.count() + offered.count())
        return scored(asked, offered, *rest)

    def written(df, name):
        out = materialized(df, name)
        numbers = [F.coalesce(F.size(f.name), F.lit(0)) for f in out.schema if f.dataType.typeName() == "array" and f.name != "seen"]
        total = F.sum(sum(numbers, F.lit(1)))
        kept.append((name, out.agg(total).first()[0]))
        return out

    monkeypatch.setattr(cell_index, "_score_cells", counted)
    monkeypatch.setattr(cell_index, "materialize", written)
    monkeypatch.setattr(cell_index, "PART_ROWS", 32)
    for n in (400, 1600):
        x, path = unit_rows(n, 6, n), str(tmp_path / f"index-{n}")
        df = frame(spark, x)
        cell_index.build_index(df, path, n // 8, id_col="id")
        index = cell_index.open_index(spark, path)
        cell_index.calibrate(index, df, 3, 0.95, "id", exclude_self=True)
        got = cell_index.search_index(index, df, 3, cells=n // 10, query_id="id", exclude_self=True)
        assert got.count() == 3 * n
    assert sent[1] <= 4 * sent[0] and sent[0] <= 2 * cell_index.CUTS * 400
    half = len(kept) // 2
    assert all(b[1] <= 6 * a[1] for a, b in zip(kept[:half], kept[half:])), kept


class Caught:
    """Stands for a session and its tables: keeps the function that would run in the tasks."""

    def __getattr__(self, name):
        return self

    def __call__(self, *args, **kwargs):
        return self

    def __int__(self):
        return 1

    def broadcast(self, value):
        return SimpleNamespace(value=value)

    def mapInArrow(self, function, schema):
        return function

    def applyInArrow(self, function, schema):
        return function


def most_bytes(job):
    """What numpy holds at most while ``job`` runs."""
    tracemalloc.start()
    try:
        job()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def vector_column(x):
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.astype(np.float32).ravel()))


def test_nearest_centre_in_bounded_memory():
    """A batch against all centres is never held at once."""
    x, centers = unit_rows(4000, 8, 50), unit_rows(3000, 8, 51).astype(np.float64)
    rows = Caught()
    rows.schema = T.StructType([T.StructField("v", T.ArrayType(T.FloatType()))])
    assign, got = knn._nearest(rows, centers, 8), []
    batch = pa.RecordBatch.from_arrays([vector_column(x)], names=["v"])
    assert most_bytes(lambda: got.extend(assign(iter([batch, batch.slice(0, 0)])))) < 4000 * 3000 * 8 / 4
    y = x.astype(np.float64)
    want = (y @ centers.T - (centers * centers).sum(axis=1) / 2).argmax(axis=1)
    assert got[0].column("cell").to_pylist() == want.tolist() and got[1].num_rows == 0
    assert got[0].column("away").to_pylist() == pytest.approx(np.sqrt(((y - centers[want]) ** 2).sum(axis=1)).tolist())


def test_parts_are_scored_in_bounded_memory(monkeypatch):
    """What a task holds for its queries doesn't grow with their number; a query comes back as one row."""
    monkeypatch.setattr(cell_index, "QUERY_ROWS", 500)
    monkeypatch.setattr(cell_index, "RUN_ROWS", 256)
    c, centers = unit_rows(3000, 8, 52), unit_rows(100, 8, 53).astype(np.float64)
    cell = np.arange(3000) * 7 % 100
    plan = knn._Plan(3, True, T.LongType(), T.LongType())
    plan.dim = 8
    index = SimpleNamespace(centers=centers, radius=np.full(100, 3.0))
    score = cell_index._score_cells(Caught(), Caught(), index, plan, 1.0, 1)
    ids = pa.ListArray.from_arrays(np.arange(3001, dtype=np.int32), pa.array(np.arange(3000)))
    right, peaks, got = pa.table({"cell": pa.array(cell.astype(np.int32)), "v": vector_column(c), "ids": ids}), [], []
    for n in (2000, 16_000):
        q = unit_rows(n, 8, 54)
        near = q.astype(np.float64) @ centers.T
        last = np.argsort(-near, axis=1)[:, 49]  # half of the cells, of which the first two were visited before
        first = pa.array(np.argsort(-near, axis=1)[:, :2].astype(np.int32).tolist(), pa.list_(pa.int32()))
        left = {"vid": pa.array([f"q{i}" for i in range(n)]), "v": vector_column(q), "floor": pa.array(np.full(n, -np.inf)), "first": first}
        left |= {"last_cell": pa.array(last.astype(np.int32)), "last_near": pa.array(near[np.arange(n), last])}
        peaks.append(most_bytes(lambda: got.append(score(pa.table(left), right))))  # noqa: B023
    assert peaks[1] < 1.5 * peaks[0], peaks
    hits = {r["vid"]: [(h["neighbor_id"], h["below"]) for h in r["hits"]] for r in got[1].to_pylist()}
    assert got[1].num_rows == len(hits) == 16_000
    s, place = q.astype(np.float64) @ c.astype(np.float64).T, np.argsort(np.argsort(-near, axis=1), axis=1)
    for i in range(0, 16_000, 997):
        mine = np.where((place[i, cell] >= 2) & (place[i, cell] < 50), s[i], -np.inf)
        top = np.argsort(-mine)[:4]
        assert [j for j, _ in hits[f"q{i}"]] == top.tolist() and [-b for _, b in hits[f"q{i}"]] == pytest.approx(mine[top].tolist())
    empty = score(pa.table(left).slice(0, 0), right.slice(0, 0))
    assert empty.num_rows == 0 and empty.schema == got[1].schema


def test_index_takes_deltas_and_keeps_versions(spark, tmp_path):
    x = unit_rows(200, 6, 14)
    path = str(tmp_path / "index")
    old = frame(spark, x[:150])
    cell_index.build_index(old.unionByName(spark.createDataFrame([(None, [1.0] * 6), (999, None)], "id long, embedding array<float>")), path, 8, id_col="id")
    moved = x.copy()
    moved[5] = -x[5]
    added = frame(spark, moved).where("id >= 150 OR id = 5")
    cell_index.add_to_index(added, path, id_col="id")

    def answers(version=None, rows=moved, n=200):
        index = cell_index.open_index(spark, path, version)
        q = frame(spark, rows).where(f"id < {n}")
        return collected(cell_index.search_index(index, q, 4, cells=99, query_id="id", exclude_self=True)), brute(rows[:n], list(range(n)), 4)

    got, want = answers()
    assert got == want
    got, want = answers(1, x, 150)
    assert got == want
    cell_index.calibrate(cell_index.open_index(spark, path), frame(spark, moved), 4, 0.8, "id", exclude_self=True)
    cell_index.compact_index(spark, path)
    got, want = answers()
    assert got == want
    assert len(cell_index.drop_unused(spark, path, 0)) == 4  # rows and cell counts of two versions
    with pytest.raises(ValueError, match="isn't measured"):  # the cells' radii are new
        cell_index.search_index(cell_index.open_index(spark, path), old, 4, query_id="id")
    cell_index.compact_index(spark, path, refit=True)
    got, want = answers()
    assert got == want


def test_copies_in_an_index(spark, tmp_path):
    x = np.concatenate([np.repeat(unit_rows(1, 4, 3), 120, axis=0), unit_rows(40, 4, 4)])
    path = str(tmp_path / "index")
    cell_index.build_index(frame(spark, x), path, id_col="id")
    index = cell_index.open_index(spark, path)
    got = cell_index.search_index(index, frame(spark, x), 3, cells=99, query_id="id", exclude_self=True)
    assert collected(got) == brute(x, list(range(160)), 3)
    with pytest.raises(ValueError, match="no vectors"):
        cell_index.build_index(frame(spark, x).limit(0), str(tmp_path / "none"), id_col="id")


def test_pairwise_similarity(spark):
    x = unit_rows(5, 4)
    got = knn.pairwise_similarity(frame(spark, x)).toPandas().pivot(index="id_a", columns="id_b", values="score")
    assert np.allclose(got.to_numpy(), x @ x.T, atol=1e-6)
    with pytest.raises(Exception, match="more than 3"):
        knn.pairwise_similarity(frame(spark, x), max_items=3).collect()


def test_format_hits(spark):
    hits = spark.createDataFrame(
        [(0, "a", "/p", "T", "", None, 0.5), (1, "b", "/q", None, None, "", -0.25)],
        "rank int, track_id string, path string, title string, artist string, album string, score double",
    )
    got = {r["track_id"]: (r["label"], r["line"]) for r in knn.format_hits(hits).collect()}
    assert got == {"a": ("T", "  0  +0.5000  a  T"), "b": ("/q", "  1  -0.2500  b  /q")}


# ---- metrics


def recall(spark, x, labels, ks):
    df = frame(spark, x, label=labels)
    near = knn.knn_join(df, df, max(ks), exclude_self=True)
    return metrics.recall_at_k(near, df, ks).first().asDict()


def test_recall_of_separated_clusters(spark):
    x = np.array([[1, 0], [0.99, 0.01], [0, 1], [0.01, 0.99]], dtype=np.float32)
    assert recall(spark, x, list("aabb"), [1])["recall_at_1"] == 1.0


def test_recall_of_random_labels_is_near_the_baseline(spark):
    rng = np.random.default_rng(0)
    labels = [str(v) for v in rng.integers(0, 4, 50)]
    got = recall(spark, unit_rows(50, 16), labels, [10])["recall_at_10"]
    assert 0.1 < got < 0.45
    base = metrics.random_baseline(spark.createDataFrame([(v,) for v in labels], "label string")).first()
    assert base["n_labels"] == 4 and base["baseline"] == 0.25


def test_recall_clamps_k(spark):
    got = recall(spark, unit_rows(4, 3), list("aabb"), [3, 9])
    assert got["recall_at_3"] == got["recall_at_9"] == pytest.approx(1 / 3)


def test_jaccard_skips_empty_seeds(spark):
    df = frame(spark, np.array([[1, 0], [0.9, 0.1], [0, 1]], dtype=np.float32))
    tags = spark.createDataFrame([(0, ["x", "y"]), (1, ["x"]), (2, [])], "id long, tags array<string>")
    near = knn.knn_join(df, df, 2, exclude_self=True)
    got = metrics.tag_jaccard_at_k(near, tags, [1, 2]).first()
    assert got["n_seeds"] == 2 and got["jaccard_at_1"] == 0.5 and got["jaccard_at_2"] == 0.25
    none = metrics.tag_jaccard_at_k(near, tags.withColumn("tags", F.array().cast("array<string>")), [1]).first()
    assert none["jaccard_at_1"] == 0.0


def cohesion_brute(x, albums, least=4):
    keep = [i for i, a in enumerate(albums) if a is not None and albums.count(a) >= least]
    s = x.astype(np.float64) @ x.astype(np.float64).T
    inside = [
        np.mean([s[i, j] for i in keep for j in keep if i != j and albums[i] == albums[j] == a])
        for a in {albums[i] for i in keep}
    ]
    across = [s[i, j] for i in keep for j in keep if albums[i] != albums[j]]
    return np.mean(inside), np.mean(across) if across else 0.0


def test_cohesion(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.eye(8)[0] + 0.05 * rng.standard_normal((6, 8)), np.eye(8)[1] + 0.05 * rng.standard_normal((6, 8)), rng.standard_normal((3, 8))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    albums = ["a"] * 6 + ["b"] * 6 + ["c"] * 2 + [None]
    got = metrics.group_cohesion(frame(spark, x, album=albums)).first()
    intra, cross = cohesion_brute(x, albums)
    assert got["intra_mean"] == pytest.approx(intra) and got["cross_mean"] == pytest.approx(cross, abs=1e-9)
    assert got["gap"] > 0.5 and got["n_albums"] == 2 and got["n_tracks"] == 12


def test_cohesion_without_eligible_groups(spark):
    got = metrics.group_cohesion(frame(spark, unit_rows(2, 2), album=["a", "a"])).first()
    assert tuple(got) == (0.0, 0.0, 0.0, 0, 0)


def test_overlap_identity_and_small_tables(spark):
    df = frame(spark, np.eye(4, dtype=np.float32))
    near = knn.knn_join(df, df, 2, exclude_self=True)
    got = metrics.neighbour_overlap(near, near, 4, [1, 2]).first()
    assert got["overlap_at_1"] == 1.0 and got["overlap_at_2"] == 1.0
    assert metrics.neighbour_overlap(near, near, 1, [1]).first()[0] == 0.0


def test_confusion_rows_sum_to_one(spark):
    df = frame(spark, unit_rows(30, 4), label=[str(i % 3) for i in range(30)])
    near = knn.knn_join(df, df, 5, exclude_self=True)
    got = metrics.label_confusion(near, df, 5).toPandas()
    assert got.groupby("seed_label")["share"].sum().round(9).eq(1).all() and got["n"].sum() == 150
    assert isinstance(got, pd.DataFrame)
