"""Hard negatives, packing and the dataset manifest against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vecloom.llm import manifest, negatives, packing, queries

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

# ---- hard negatives


def mined(rows, is_anchor, n_positives=5, n_negatives=10, low=30, high=90):
    """``rows``: id -> (label, whole numbers)."""
    out = []
    for a, (label, v) in rows.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(map(int.__mul__, v, w)), o, l) for o, (l, w) in rows.items() if o != a and len(w) == len(v))
        for s, p, l in [x for x in scored if x[2] == label][:n_positives]:
            hits = [(o, -t) for t, o, m in scored if m != label and low * -s <= 100 * -t <= high * -s][:n_negatives]
            out += [(a, p, k, o, -s, t) for k, (o, t) in enumerate(hits, 1)]
    return sorted(out)


def steps(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


@pytest.mark.parametrize("block_rows", [4096, 7])
def test_hard_negatives(spark, monkeypatch, block_rows):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(negatives, "CHUNK_ROWS", 5)
    rng = random.Random(5)
    rows, known = [], {}
    for i in range(120):
        v = [rng.choice([0.0, 0.25, -0.5, 0.7]) for _ in range(3 if i % 40 else 2)]
        label = rng.choice(["rock", "jazz", "folk"])
        rows.append((i, v, label))
        known[i] = (label, steps(v))
    for i in range(60, 90):  # one vector that many tracks have
        rows[i] = (i, [0.7, 0.7, 0.25], rows[i][2])
        known[i] = (rows[i][2], steps(rows[i][1]))
    nowhere = [(200, None, "rock"), (201, [0.7, None, 0.7], "rock"), (202, [0.7, math.nan, 0.7], "jazz"), (203, [math.inf, 0.0, 0.0], "jazz"), (204, [0.7, 0.7, 0.7], None)]
    nowhere += [(None, [0.7, 0.7, 0.7], "jazz"), *rows[:30]]
    store = spark.createDataFrame(rows + nowhere, "track_id long, embedding array<float>, genre string")
    store = store.select("*", F.lit("x").alias("_id"), F.lit(1).alias("_anchor"), F.lit(2).alias("rank"), F.lit(3).alias("_block"))
    got = negatives.mine_hard_negatives(store, F.col("track_id") % 10 == 0).collect()
    want = mined(known, lambda i: i % 10 == 0)
    assert sorted(map(tuple, got)) == want and len(want) > 100
    assert negatives.mine_hard_negatives(store.limit(0), F.col("track_id") % 10 == 0).count() == 0
    assert negatives.mine_hard_negatives(store, F.col("track_id") < 0).count() == 0


def test_hard_negatives_of_hashed_ids(spark):
    """Ids of the store are text; all tracks of one label have no negatives, an id that is repeated with another genre counts once."""
    rows = [(f"{i:016x}", [1.0, i / 8], "rock" if i % 2 else "jazz") for i in range(12)]
    store = spark.createDataFrame(rows + [(rows[3][0], [9.0, 9.0], "zydeco")], "track_id string, embedding array<float>, genre string")
    got = negatives.mine_hard_negatives(store, F.col("track_id").endswith("4"), n_positives=2, n_negatives=3)
    want = mined({i: (g, steps(v)) for i, v, g in rows}, lambda i: i.endswith("4"), 2, 3)
    assert sorted(map(tuple, got.collect())) == want and want
    assert negatives.mine_hard_negatives(store.withColumn("genre", F.lit("x")), F.lit(True)).count() == 0


def test_windows_hold_no_more_than_their_count():
    def keys():
        for k, s in enumerate(range(1000, 0, -1)):
            yield (1, -s, 0 if k % 10 == 0 else 1, k), None

    out = list(negatives.open_windows(keys(), 5, 3, 30, 90))
    assert Counter(r[1] for r in out) == {0: 3, 10: 3, 20: 3, 30: 3, 40: 3}
    assert out[0] == (1, 0, 1, 101, 1000, 899)


# ---- packing


def by_document(lengths, capacity):
    """Best-fit decreasing one piece at a time; the number of sequences."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_tightest_room():
    rng = random.Random(1)
    tree, rooms = packing.CapacityTree(100), Counter()
    for _ in range(3000):
        room = rng.randint(0, 100)
        if rooms[room] and rng.random() < 0.6:
            rooms[room] -= 1
            tree.add(room, -1)
        elif rng.random() < 0.3:
            rooms[room] += 1
            tree.add(room, 1)
        need = rng.randint(1, 100)
        assert tree.tightest(need) == min((r for r, n in rooms.items() if n and r >= need), default=None)


def test_runs_of_equal_pieces_go_where_single_ones_would():
    rng = random.Random(2)
    for capacity in (1, 2, 7, 64, 100):
        for _ in range(40):
            lengths = [min(capacity, max(1, int(rng.expovariate(3 / capacity)))) for _ in range(rng.randint(0, 300))]
            histogram = Counter(lengths)
            moves = packing.best_fit(histogram, capacity)
            places, numbers = defaultdict(list), defaultdict(list)
            for length, first, last, each, sequence, offset in moves:
                numbers[length] += range(first, last)
                for p in range(first, last):
                    places[sequence + (p - first) // each].append((offset + (p - first) % each * length, length))
            assert {n: sorted(x) for n, x in numbers.items()} == {n: list(range(c)) for n, c in histogram.items()}
            assert sorted(places) == list(range(by_document(lengths, capacity)))
            for pieces in places.values():
                at = 0
                for offset, length in sorted(pieces):
                    assert offset == at
                    at += length
                assert at <= capacity


def test_ids_are_those_of_the_vocabulary():
    from tokenizers import Tokenizer

    with open(VOCABULARY, encoding="utf-8") as file:
        source = file.read()
    encode, plain = packing.Encoder(source), Tokenizer.from_str(source)
    assert encode.fast is not None
    rng = random.Random(3)
    signs = [*map(chr, range(0, 0x250)), *" 　́٠Ⅷ漢字ัひ🎵﻿‍", "<|endoftext|>", "'s", "  ", "\r\n", " 7"]
    texts = ["", "<|endoftext|>", "a" * 3000, *("".join(rng.choices(signs, k=60)) for _ in range(400))]
    for text in texts:
        assert encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids
    # a file that is no plain byte-level BPE goes to the library itself
    lower = packing.Encoder(source.replace('"normalizer":null', '"normalizer":{"type":"Lowercase"}').replace('"normalizer": null', '"normalizer": {"type": "Lowercase"}'))
    assert lower.fast is None and lower("ABC").tolist() == encode("abc").tolist()


def test_pieces_are_full_but_for_the_first():
    assert packing.cut(1, 4) == [0] and packing.cut(4, 4) == [0] and packing.cut(5, 4) == [0, 1] and packing.cut(8, 4) == [0, 4] and packing.cut(11, 4) == [0, 3, 7]


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_packed_tracks(spark, broadcast_rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(4)
    titles = [" ".join(rng.choices(["one", "two", "Überfall", "n'est", "7"], k=rng.randint(0, 60))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(titles)] + [(900, None), (901, ""), (902, "long " * 3000), (5, titles[5]), (5, titles[5]), (None, "null id"), (None, None)]
    tracks = spark.createDataFrame(rows, "track_id long, title string").repartition(7)
    tracks = tracks.select("*", F.lit(1).alias("length"), F.lit(2).alias("_part"), F.lit("x").alias("_id"), F.lit("y").alias("ids"))
    packed = packing.pack_best_fit(tracks, VOCABULARY, 2, capacity=64, broadcast_rows=broadcast_rows).collect()
    want = Counter()
    lengths = []
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        edges = [*packing.cut(len(ids), 64), len(ids)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[i, k, a, b - a, np.array(ids[a:b], "<u4").tobytes()] += 1
            lengths.append(b - a)
    assert Counter((r["track_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in packed) == want
    filled = defaultdict(list)
    for r in packed:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(filled) == list(range(by_document(lengths, 64)))
    for pieces in filled.values():
        assert [o for o, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 64


def test_sequences_and_empty_tables(spark):
    tracks = spark.createDataFrame([(1, "one two"), (2, "three"), (3, None)], "track_id long, title string")
    packed = packing.pack_best_fit(tracks, VOCABULARY, 2, capacity=4)
    joined = {r["sequence_id"]: (bytes(r["ids"]), r["lengths"]) for r in packing.sequences(packed).collect()}
    whole = b"".join(bytes(r["ids"]) for r in packed.orderBy("sequence_id", "offset").collect())
    assert b"".join(joined[k][0] for k in sorted(joined)) == whole and all(sum(n) * 4 == len(b) for b, n in joined.values())
    none = packing.pack_best_fit(tracks.limit(0), VOCABULARY, 2)
    assert none.count() == 0 and packing.sequences(none).count() == 0


def test_documents_fill_no_more_sequences_than_one_by_one(spark):
    got = queries.op12(spark, "/root/testdata/sf0.001")
    lengths = [r["length"] for r in got.select("length").collect()]
    assert got.agg(F.count_distinct("sequence_id")).first()[0] == by_document(lengths, 1024)


# ---- manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """Levels of nodes, the given ones first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        j = at ^ 1
        out.append(("none", None) if j >= len(level) else ("left" if j < at else "right", level[j]))
        at >>= 1
    return out


def framed(*fields):
    return h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def expected(rows):
    """(group, id) -> leaf, position, siblings, subroot; and the root."""
    leaves = defaultdict(dict)
    for i, group, name in rows:
        leaf = framed(i, group, name)
        leaves[group][i] = min(leaf, leaves[group].get(i, leaf))
    order = sorted(leaves, key=lambda g: (g is not None, (g or "").encode()))
    trees, out = {}, {}
    for g in order:
        ids = sorted(leaves[g], key=lambda i: (i is not None, i or 0))
        trees[g] = ids, tree([leaves[g][i] for i in ids])
    upper = tree([trees[g][1][-1][0] for g in order])
    for k, g in enumerate(order):
        ids, levels = trees[g]
        for at, i in enumerate(ids):
            out[g, i] = (levels[0][at], at, path(levels, at) + path(upper, k), levels[-1][0])
    return out, upper[-1][0]


FIELDS = ("fma_track_id", "split", "path")


def described(spark, rows):
    table = spark.createDataFrame(rows, "fma_track_id long, split string, path string")
    return table.select("*", *(F.lit("x").alias(c) for c in ("_g", "_i", "_leaf", "_pos", "_size", "leaf", "root", "siblings")))


def test_manifest(spark):
    rng = random.Random(6)
    rows = [(i, "training", f"/a/{i}") for i in range(9000)]  # dense ids: two bitmaps of bits, three rounds of slots
    rows += [(70_000 + 3 * i, "training", "é" * (i % 3)) for i in range(500)]
    rows += [(rng.randint(-(2**63), 2**63 - 1), "test", None) for _ in range(300)]  # ids far apart
    rows += [(i, g, "x" * 5000) for g in (None, "", "validation", "ünder") for i in (-1, 0, None)]
    rows += [(7, "alone", "p"), (3, "test", "a"), (3, "test", "b"), (3, "test", "a")]
    rng.shuffle(rows)
    table = described(spark, rows).repartition(5)
    proofs = manifest.merkle_manifest(table, fields=FIELDS)
    want, root = expected(rows)
    got = {(r["split"], r["fma_track_id"]): (r["leaf"], r["position"], [(s["side"], s["hash"]) for s in r["siblings"]], r["subroot"]) for r in proofs.collect()}
    assert got == want
    assert {r["root"] for r in proofs.select("root").distinct().collect()} == {root}
    changed = F.when(F.col("fma_track_id") % 5 == 0, "changed").otherwise(F.col("path"))
    suspects = table.withColumn("path", changed).unionByName(described(spark, [(12345678, "training", "unlisted")]))
    checked = manifest.verify_rows(proofs, suspects, fields=FIELDS).collect()
    assert len(checked) == len(rows) + 1
    least = {(g, i): want[g, i][0] for g, i in want}
    good = Counter((r["split"], r["fma_track_id"]) for r in checked if r["verified"])
    assert good == Counter((g, i) for i, g, p in rows if framed(i, g, "changed" if i is not None and i % 5 == 0 else p) == least[g, i])
    assert all(r["folded_root"] == root for r in checked if r["verified"]) and sum(r["root"] is None for r in checked) == 1


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_small_manifests(spark, n):
    rows = [(k, f"s{k}", "p") for k in range(n)]
    got = manifest.merkle_manifest(described(spark, rows), fields=FIELDS).collect()
    assert len(got) == n
    if n:
        want, root = expected(rows)
        assert {r["root"] for r in got} == {root} and all(want[r["split"], r["fma_track_id"]][3] == r["subroot"] for r in got)


def test_manifest_of_the_default_fields(spark):
    row = (1, "small", "test", "rock", 4, None, "/a/b.mp3")
    table = spark.createDataFrame([row], "fma_track_id int, subset string, split string, genre_top string, artist_id int, artist_name string, path string")
    got = manifest.merkle_manifest(table).first()
    assert got["leaf"] == got["root"] == framed(*row) and got["siblings"] == []


def test_compressed_bitmaps():
    rng = np.random.default_rng(0)
    size = 1 << manifest.BITS
    for n in (1, 5, manifest.SPARSE - 1, manifest.SPARSE, size // 2, size):
        places = np.sort(rng.choice(size, n, replace=False))
        packed = manifest.pack_bits(places)
        assert (manifest.unpack_bits(packed) == places).all() and len(packed) <= size // 8
        asked = rng.integers(0, size, 500)
        assert (manifest.ranks(packed, manifest.popcounts(packed), asked) == np.searchsorted(places, asked)).all()
