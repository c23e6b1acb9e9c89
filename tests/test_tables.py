import json
import os
import pathlib
import random
import threading
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from vecloom import fixed_values as fixed
from vecloom.operators import compare, curation, inference, linking, reports, sampling
from vecloom.operators import labels as L
from vecloom.operators.quantiles import exact_quantiles
from vecloom.operators.ranking import global_positions, group_positions, salt_bucket, sequence_positions
from vecloom.functions import hashing, windows
from vecloom.functions.hashing import manifest_digest, video_id_from_url
from vecloom.functions.titles import title_dedup_key
from vecloom.session import materialize
from vecloom.sources import commits, files, remote, store, tables
from vecloom.sources import lines as lines_source
from vecloom.streaming import ingest
from vecloom.streaming.ingest import ingest_stream, write_batch

TRACK = "track_id string, path string, title string, embedding array<float>"


def track(spark, *rows):
    return spark.createDataFrame(list(rows), TRACK)


# ---- files and lists


def test_scan_files(spark, tmp_path):
    names = ["a.flac", "a/b.MP3", "sub/b.mp3", "sub/deeper/c.opus", "ignored.txt", "cover.jpg", ".hidden/x.flac", "sub/.dot.flac"]
    for name in names:
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"12345")
    got = files.scan_files(spark, str(tmp_path)).orderBy(files.scan_order()).collect()
    assert [os.path.relpath(r["path"], tmp_path) for r in got] == ["a/b.MP3", "a.flac", "sub/b.mp3", "sub/deeper/c.opus"]
    assert {r["length"] for r in got} == {5}
    with pytest.raises(NotADirectoryError):
        files.scan_files(spark, str(tmp_path / "nowhere"))
    with pytest.raises(NotADirectoryError):
        files.scan_files(spark, got[0]["path"])
    assert files.scan_files(spark, f"file://{tmp_path}/").count() == len(got)


def reference_walk(root, suffixes):
    """What a recursive walk of the folder gives: sorted by parts, without dot names below the root."""
    found = []
    for p in sorted(pathlib.Path(root).rglob("*")):
        if p.is_file() and not any(x.startswith(".") for x in p.relative_to(root).parts) and p.suffix.lower() in suffixes:
            found.append(str(p))
    return found


def test_listing_by_tasks_keeps_underscores(spark, tmp_path):
    names = ["_x/a.flac", "_b.mp3", "a/_y/_z.Opus", ".dot/a.flac", "a/.dot/_x/b.mp3", "a/.c.wav", "a b/ü %41#.m4a", "a/b/c/d/e/f.ogg", "_x/a.txt", "noext"]
    for name in names:
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x" * len(name))
    (tmp_path / "empty/deeper").mkdir(parents=True)
    os.symlink(tmp_path, tmp_path / "a/loop")
    os.symlink(tmp_path / "_b.mp3", tmp_path / "a/link.mp3")
    got = files.scan_files(spark, str(tmp_path)).orderBy(files.scan_order()).collect()
    assert [r["path"] for r in got] == reference_walk(tmp_path, {".flac", ".wav", ".ogg", ".opus", ".mp3", ".m4a"})
    assert {r["path"]: r["length"] for r in got}[str(tmp_path / "_x/a.flac")] == 9
    whole = remote.list_tree(spark, str(tmp_path))
    assert whole.where("path LIKE '%/.dot/%'").count() == 3 and whole.where("reason IS NOT NULL").isEmpty()
    gone = remote.list_tree(spark, str(tmp_path / "nowhere")).collect()
    assert len(gone) == 1 and "FileNotFound" in gone[0]["reason"]


def test_fingerprints_of_files(spark, tmp_path):
    """Ids from the ends of files equal those of whole contents; size doesn't matter; what can't be read has a reason."""
    mib = 1 << 20
    contents = {"a": b"x" * 12288, "b": b"\0" * 100, "c": b"\0" * 101, "d": bytes(3 * mib), "e": b"\1" + bytes(3 * mib - 1), "f": bytes(3 * mib - 1) + b"\1", "g": b"", "h": bytes(2 * mib), "i": b"x" * 12288}
    for name, data in contents.items():
        (tmp_path / f"{name}.flac").write_bytes(data)
    with open(tmp_path / "sparse.flac", "wb") as file:  # 3 GiB that take no disk
        file.truncate(3 << 30)
    listing = files.scan_files(spark, str(tmp_path)).select("path", "length").union(spark.createDataFrame([(str(tmp_path / "gone.flac"), 5), (None, 5)], "path string, length long"))
    for seed in (42, 0):
        got = {os.path.basename(r["path"] or "none"): r for r in remote.fingerprint_files(listing, seed=seed).collect()}
        assert len(got) == len(contents) + 3
        for name, data in contents.items():
            body = data if len(data) <= 2 * mib else data[:mib] + data[-mib:]
            assert got[f"{name}.flac"]["track_id"] == xxhash.xxh64(len(data).to_bytes(8, "little") + body, seed=seed).hexdigest()
        whole = xxhash.xxh64((3 << 30).to_bytes(8, "little") + bytes(2 * mib), seed=seed).hexdigest()
        assert got["sparse.flac"]["track_id"] == whole and got["sparse.flac"]["length"] == 3 << 30
        assert got["gone.flac"]["track_id"] is None and "FileNotFound" in got["gone.flac"]["reason"] and got["none"]["reason"] == "no path"
    assert len({r["track_id"] for r in got.values() if r["track_id"]}) == len(contents)  # a and i are one content
    short = spark.createDataFrame([(k, v) for k, v in contents.items()], "name string, content binary")
    by_content = {r["name"]: r["id"] for r in short.select("name", hashing.content_fingerprint(F.col("content")).alias("id")).collect()}
    by_file = {os.path.basename(r["path"])[:1]: r["track_id"] for r in remote.fingerprint_files(listing.where("path NOT LIKE '%sparse%'")).collect() if r["track_id"]}
    assert by_file == by_content
    sha = {r["name"]: r["id"] for r in short.select("name", hashing.content_fingerprint_sha(F.col("content")).alias("id")).collect()}
    assert {os.path.basename(r["path"])[:1]: r["track_id"] for r in remote.fingerprint_files(listing, algorithm="sha256").where("length < 4000000 AND track_id IS NOT NULL").collect()} == sha
    assert remote.fingerprint_files(listing.limit(0)).count() == 0
    with pytest.raises(ValueError):
        remote.fingerprint_files(listing, algorithm="md5")


def test_dot_names_above_the_root_do_not_hide(spark):
    df = spark.createDataFrame([("/.x/lib/a.ogg",), ("/.x/lib/.b/a.ogg",), ("/.x/lib/_c.wav",), ("/.x/lib/.mp3",)], "path string")
    got = {r["path"] for r in files.select_audio(df, "/.x/lib").collect()}
    assert got == {"/.x/lib/a.ogg", "/.x/lib/_c.wav"}


def test_input_list(spark, tmp_path):
    (tmp_path / "in.txt").write_text("# note\n\n  one \r\ntwo\n  # x\nthree")
    got = files.read_input_list(spark, str(tmp_path / "in.txt")).orderBy("file", "line_no").collect()
    assert [r["raw"] for r in got] == ["one", "two", "three"]


# ---- CSV


def test_label_csv(spark, tmp_path):
    path = tmp_path / "tracks.csv"
    path.write_text(
        ',set,set,track,track,artist,artist\n,subset,split,genre_top,title,id,name\ntrack_id,,,,,,\n'
        '2,small,training,Rock,"a ""b"", c\nd",7,X\n5,medium,test,,t,8,Y\n10,large,validation,Pop,t,,\n'
    )
    df = tables.label_index(tables.read_label_csv(spark, str(path)))
    rows = {r["fma_track_id"]: r for r in df.collect()}
    assert set(rows) == {2, 5, 10} and rows[2]["genre_top"] == "Rock" and rows[10]["artist_name"] is None
    kept = L.load_manifest(df, "/lib", "medium").collect()
    assert [(r["fma_track_id"], r["split"], r["path"]) for r in kept] == [(2, "training", "/lib/000/000002.mp3")]
    with pytest.raises(FileNotFoundError):
        tables.read_label_csv(spark, str(tmp_path / "no.csv"))


def test_list_files_of_many_splits_keep_their_numbers(spark, tmp_path):
    rng = random.Random(3)
    lines = [rng.choice(["", "# note", "  x ", "https://e.example/" + "y" * rng.randint(0, 80), '"', "a\tb"]) for _ in range(3000)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    (tmp_path / "b.txt").write_text("\r\n".join(lines[:50]) + "\n")
    (tmp_path / "none.txt").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = lines_source.numbered_lines(spark, str(tmp_path / "*.txt")).collect()
        assert len({r["file"] for r in got}) == 2 and spark.read.text(str(tmp_path / "a.txt")).rdd.getNumPartitions() >= 8
        quotes = 0
        for k, r in enumerate(sorted((r for r in got if r["file"].endswith("a.txt")), key=lambda r: r["line_no"])):
            assert (r["line_no"], r["raw"], r["open"]) == (k, lines[k], quotes % 2 == 1)
            quotes += lines[k].count('"')
        kept = files.read_input_list(spark, str(tmp_path / "b.txt")).orderBy("line_no").collect()
        assert [(r["line_no"], r["raw"]) for r in kept] == [(k, x.strip()) for k, x in enumerate(lines[:50]) if x.strip() and not x.startswith("#")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_label_csv_of_many_splits_keeps_quoted_fields(spark, tmp_path):
    import csv
    import io

    rng = random.Random(4)
    rows = [[k, rng.choice(["small", "medium", "large"]), "training", rng.choice(["Rock", 'a "b", c\nd', "x\n\ny\n", "", "é,\u2028;"]), "t" * rng.randint(0, 90)] for k in range(1, 600)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["", "set", "set", "track", "track"], ["", "subset", "split", "genre_top", "title"], ["track_id", "", "", "", ""], *rows])
    path = tmp_path / "tracks.csv"
    path.write_text(out.getvalue(), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        got = {r["fma_track_id"]: r for r in tables.read_label_csv(spark, str(path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {k: (r["set.subset"], r["track.genre_top"] or "", r["track.title"] or "") for k, r in got.items()} == {k: (s, g, t) for k, s, _, g, t in rows}


def test_a_long_sequence_is_many_pieces(spark):
    """Positions of a crowded group come from counted ranges; its windows lie whole in pieces that overlap."""
    n = 30_000
    df = spark.range(n).select(F.lit("busy").alias("u"), (F.col("id") * 7 % 1000).alias("at"), "id", (F.col("id") % 11).cast("double").alias("x"))
    df = df.unionByName(spark.range(40).select(F.concat(F.lit("u"), F.col("id") % 3).alias("u"), F.col("id").alias("at"), "id", F.lit(1.0).alias("x")))
    placed = sequence_positions(df, ["u"], "at", ["id"], "pos", "n", rows_per_bucket=1000)
    rows = placed.toPandas()
    for _, part in rows.groupby("u"):
        part = part.sort_values(["at", "id"])
        assert list(part["pos"]) == list(range(len(part))) and (part["n"] == len(part)).all()
    for window, hop, piece in ((16, 8, 64), (10, 3, 10), (5, 9, 50), (64, 1, 1 << 16)):
        made = windows.long_windows(placed, ["u"], window, hop, {"c": F.count(F.lit(1)), "s": F.sum("x")}, piece=piece).toPandas()
        for u, part in rows.groupby("u"):
            x = part.sort_values("pos")["x"].to_numpy()
            count = 1 if len(x) <= window else 1 + -(-(len(x) - window) // hop)
            want = [(w, min(window, len(x) - w * hop), x[w * hop : w * hop + window].sum()) for w in range(count) if w * hop < len(x)]
            got = made[made["u"] == u].sort_values("w")
            assert np.allclose(got[["w", "c", "s"]].to_numpy(float), want)
    with pytest.raises(ValueError):
        windows.long_windows(placed, ["u"], 0, 1, {})


def test_manifest_without_optional_columns(spark):
    df = spark.createDataFrame([(1, "small", "x")], "fma_track_id long, subset string, genre_top string")
    row = L.load_manifest(df, "/r").first()
    assert row["split"] == "training" and row["artist_id"] is None
    with pytest.raises(ValueError):
        L.subset_levels("huge")
    assert L.subset_levels("LARGE") == ("small", "medium", "large")


def test_tag_csv(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.read_tag_csv(spark, str(tmp_path))
    (tmp_path / "annotations_final.tsv").write_text("clip_id\tno voice\todd\trock\tmp3_path\n1\t1\t1\t0\ta/x.mp3\n2\t1\t0\t1\tb/y.mp3\n")
    wide, tags = tables.read_tag_csv(spark, str(tmp_path))
    assert tags == ("rock", "no voice")
    got = {r["mp3_path"]: r["tags"] for r in tables.tag_sets(wide, tags).collect()}
    assert got == {"a/x.mp3": ["no voice"], "b/y.mp3": ["rock", "no voice"]}
    assert tables.read_tag_csv(spark, str(tmp_path), 2)[1] == ("no voice", "odd")
    assert len(set(fixed.BENCHMARK_TAGS)) == 50
    paths = spark.createDataFrame([("a/x.mp3",), ("zz",)], "mp3_path string")
    matrix = {r["mp3_path"]: (r["rock"], r["no voice"]) for r in L.tag_matrix_for(paths, wide, tags).collect()}
    assert matrix == {"a/x.mp3": (0, 1), "zz": (0, 0)}


def test_targets(spark, tmp_path):
    df = spark.createDataFrame([(i, 0, "training" if i else "test", [0.5]) for i in range(5)], "fma_track_id long, window_index int, split string, teacher_embedding array<float>")
    tables.write_targets(df, str(tmp_path / "t"))
    got = tables.read_targets(spark, str(tmp_path / "t"), "training", 2).collect()
    assert [r["fma_track_id"] for r in got] == [1, 2]
    with pytest.raises(ValueError):
        tables.read_targets(spark, str(tmp_path / "t"), "validation")
    with pytest.raises(ValueError):
        tables.read_targets(df.drop("split"), split="training")


def test_cached_arrays(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0]), (2, None)], "id int, clip array<float>")
    first = tables.cached_arrays(df, str(tmp_path), "val", "d")
    assert {r["id"]: r["clip"] for r in first.collect()} == {1: [1.0], 2: None}
    changed = df.withColumn("clip", F.array(F.lit(9.0).cast("float")))
    again = tables.cached_arrays(changed, str(tmp_path), "val", "d")
    assert {r["id"]: r["clip"] for r in again.collect()} == {1: [1.0], 2: None}
    more = tables.cached_arrays(changed.limit(1), str(tmp_path), "val", "d")
    assert more.count() == 1


def test_manifest_digest_sees_every_change(spark):
    def digest(paths):
        df = spark.createDataFrame(list(enumerate(paths)), "o long, path string")
        return manifest_digest(df, "o").first()["digest"]

    base = digest(["a", "b", "c"])
    assert len(base) == 16 and base == digest(["a", "b", "c"])
    assert len({base, digest(["b", "a", "c"]), digest(["a", "b"]), digest(["a", "b", "d"])}) == 4


# ---- store


def test_store_round_trip_and_deltas(spark, tmp_path):
    path = str(tmp_path / "s")
    assert store.scan_store(spark, path).count() == 0
    store.write_store(track(spark, ("1", "/a", "x", [0.25, 0.5]), ("2", "/b", "y", [1.0, 0.0])), path)
    store.write_delta(track(spark, ("2", "/b", None, [0.0, 1.0]), ("3", "/c", "z", [0.5, 0.5])), path)
    store.write_delta(track(spark, ("3", "/c2", "z", [0.5, 0.5])), path)

    def check():
        rows = {r["track_id"]: r for r in store.scan_store(spark, path).collect()}
        assert set(rows) == {"1", "2", "3"} and rows["1"]["embedding"] == [0.25, 0.5]
        assert rows["2"]["title"] is None and rows["2"]["embedding"] == [0.0, 1.0]
        assert rows["3"]["path"] == "/c2" and rows["3"]["embedding_dim"] == 2 and rows["1"]["year"] is None

    check()
    store.compact(spark, path)
    check()
    commits.write_folder(track(spark, ("9", "/x", "x", [1.0])), path, "delta")  # a writer that never committed is not seen
    check()
    assert [r["kind"] for r in store.history(spark, path).orderBy("version").collect()] == ["base", "delta", "delta", "base"]
    assert {r["track_id"] for r in store.scan_store(spark, path, version=1).collect()} == {"1", "2"}
    assert {r["path"] for r in store.scan_store(spark, path, version=2).collect()} == {"/a", "/b", "/c"}
    with pytest.raises(ValueError, match="no version 9"):
        store.scan_store(spark, path, version=9)
    os.remove(f"{path}/_log/_last_base")  # only a hint
    check()
    gone = store.drop_superseded(spark, path, 0)
    assert len(gone) == 4
    check()
    assert store.scan_store(spark, path).columns == [f.name for f in store.STORE.fields]


def test_upsert_replaces_with_nulls(spark):
    old = track(spark, ("1", "/a", "x", [1.0]), ("2", "/b", "y", [2.0]))
    new = track(spark, ("2", "/b", "mid", [2.0]), ("2", "/b", None, [3.0]), ("9", "/n", "n", [4.0]))
    new = new.withColumn("seq", F.when(F.col("title").isNull(), 2).otherwise(1))
    got = {r["track_id"]: (r["title"], r["embedding"]) for r in store.upsert(old, new).collect()}
    assert got == {"1": ("x", [1.0]), "2": (None, [3.0]), "9": ("n", [4.0])}


def test_width_checks(spark):
    old = track(spark, ("1", "/a", "x", [1.0, 2.0]))
    assert store.validate_dim(old, old).count() == 1
    with pytest.raises(Exception, match="store has 2, got 1"):
        store.validate_dim(old, track(spark, ("2", "/b", "y", [1.0]))).select("embedding").collect()
    with pytest.raises(ValueError, match="store has 1, got 2"):
        store.validate_dim(old.limit(0), old.unionByName(track(spark, ("2", "/b", "y", [1.0]))))
    mixed = old.unionByName(track(spark, ("2", "/b", "y", [1.0]), ("3", "/c", "z", None), ("4", "/d", "w", [1.0, float("nan")])))
    good, bad = store.split_bad_vectors(mixed, 2)
    assert [r["track_id"] for r in good.collect()] == ["1"]
    assert {r["track_id"]: r["reason"] for r in bad.collect()} == {"2": "width is not 2: 1", "3": "null vector", "4": "not a number"}


def test_ingest_matches_the_sequential_rule(spark):
    rng = random.Random(5)
    for limit in (None, 3):
        rows = []
        for i in range(60):
            tid = None if rng.random() < 0.1 else f"i{rng.randrange(20)}"
            rows.append((tid, f"/m/{rng.choice('abc')}{rng.choice(['', '.x'])}/{i:02d}.mp3", "t", [1.0] if rng.random() < 0.7 else None))
        known = {"i1", "i2", "i3"}
        seen, want, new = set(known), {}, 0
        for tid, path, _, emb in sorted(rows, key=lambda r: r[1].split("/")):
            if tid is None:
                want[path] = "failed"
            elif tid in seen:
                want[path] = "skipped_existing"
            elif emb is None:
                want[path] = "failed"
            else:
                want[path], new = "new", new + 1
                seen.add(tid)
                if limit is not None and new >= limit:
                    break
        known_df = spark.createDataFrame([(k,) for k in known], "track_id string")
        got = store.ingest_incremental(track(spark, *rows), known_df, limit)
        assert {r["path"]: r["status"] for r in got.collect()} == want


def test_stream_is_resumable_and_idempotent(spark, tmp_path):
    src, path, mark = str(tmp_path / "in"), str(tmp_path / "s"), str(tmp_path / "c")
    a = track(spark, ("1", "/a", "x", [1.0]), ("2", "/b", "y", [2.0]))
    a.coalesce(1).write.mode("append").parquet(src)
    run = lambda: ingest_stream(spark, src, path, mark, schema=a.schema, files_per_trigger=1).awaitTermination()
    run()
    b = track(spark, ("2", "/late", "other", [9.0]), ("3", "/c", "z", [3.0]))
    b.coalesce(1).write.mode("append").parquet(src)
    run()
    run()

    def rows():
        return {r["track_id"]: r["path"] for r in store.scan_store(spark, path).collect()}

    assert rows() == {"1": "/a", "2": "/b", "3": "/c"}
    write_batch(b, path, "ingest.1")  # the same batch once more
    assert rows() == {"1": "/a", "2": "/b", "3": "/c"}
    write_batch(b, path, "fix.0", replace=True)
    assert rows() == {"1": "/a", "2": "/late", "3": "/c"}


def test_a_delta_committed_during_compaction_stays(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    store.write_store(track(spark, ("1", "/a", "x", [1.0])), path)
    store.write_delta(track(spark, ("2", "/b", "y", [2.0])), path)
    read, wait = threading.Event(), threading.Event()
    write = commits.write_folder

    def slow(df, path, kind, **options):
        name = write(df, path, kind, **options)
        if kind == "base":
            read.set()
            assert wait.wait(60)
        return name

    monkeypatch.setattr(commits, "write_folder", slow)
    compaction = threading.Thread(target=store.compact, args=(spark, path))
    compaction.start()
    assert read.wait(60)
    # the base is written but not committed: another writer adds a row and changes one that the base holds
    store.write_delta(track(spark, ("3", "/c", "z", [3.0]), ("1", "/a", "newer", [9.0])), path)
    wait.set()
    compaction.join()
    now = commits.state(spark, path)
    assert now.base.version > now.deltas[0].version > now.base.covers and len(now.deltas) == 1
    assert {r["track_id"]: r["title"] for r in store.scan_store(spark, path).collect()} == {"1": "newer", "2": "y", "3": "z"}
    assert len(store.drop_superseded(spark, path, 0)) == 2  # the folders before it, the late delta not among them
    assert store.scan_store(spark, path).count() == 3


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    failed = []

    def add(k):
        try:
            for i in range(3):
                store.write_delta(track(spark, (f"{k}-{i}", f"/{k}/{i}", "t", [float(i)])), path)
            if k % 2:
                store.compact(spark, path)
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=add, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    assert {r["track_id"] for r in store.scan_store(spark, path).collect()} == {f"{k}-{i}" for k in range(4) for i in range(3)}
    numbers = commits.versions(spark, path)
    assert numbers == list(range(1, 15))  # twelve deltas, two bases, each with a number of its own


def test_a_number_is_taken_once(spark, tmp_path):
    name = f"{tmp_path}/_log/00000000000000000001.json"
    wins = []
    threads = [threading.Thread(target=lambda k=k: wins.append(commits.create_absent(spark, name, f"writer {k}")) ) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sum(wins) == 1 and len(os.listdir(tmp_path / "_log")) == 1
    assert commits.create_absent(spark, f"{tmp_path}/_log/00000000000000000002.json", "x")


def test_a_tag_written_again_keeps_its_place(spark, tmp_path):
    path = str(tmp_path / "s")
    store.write_delta(track(spark, ("1", "/a", "batch 0", [1.0]), ("2", "/b", "batch 0", [1.0])), path, "run.0")
    store.write_delta(track(spark, ("1", "/a", "later", [1.0])), path)
    store.write_delta(track(spark, ("1", "/a", "batch 0 again", [1.0]), ("2", "/b", "batch 0 again", [1.0])), path, "run.0")
    titles = lambda: {r["track_id"]: r["title"] for r in store.scan_store(spark, path).collect()}
    assert titles() == {"1": "later", "2": "batch 0 again"}
    store.compact(spark, path)
    assert store.write_delta(track(spark, ("1", "/a", "too late", [1.0])), path, "run.0") is None
    assert titles() == {"1": "later", "2": "batch 0 again"}
    assert store.write_delta(track(spark, ("1", "/a", "batch 1", [1.0])), path, "run.1")
    assert titles()["1"] == "batch 1"


def _scanned(df):
    """Rows that the scans of a plan gave out."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        else:
            children = node.children()
            todo += [children.apply(k) for k in range(children.size())]
            if node.nodeName().startswith("Scan parquet"):
                total += node.metrics().apply("numOutputRows").value()
    return total


def test_looking_up_few_ids_reads_few_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "ROW_GROUP_BYTES", 1 << 18)
    path, n = str(tmp_path / "s"), 60_000
    rows = spark.range(n).select(
        F.md5(F.col("id").cast("string")).alias("track_id"), F.lit("/p").alias("path"),
        F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: F.rand(1).cast("float") + k).alias("embedding"),
    )
    store.write_store(rows, path)
    asked = spark.createDataFrame([(hashing_md5(k),) for k in range(0, n, n // 10)][:10], "track_id string")
    got = store.get_embeddings(store.scan_store(spark, path), asked)
    assert _scanned(got) <= n // 4 and got.count() == 10
    absent = spark.createDataFrame([("0" * 31 + f"{k}",) for k in range(10)] + [("5" * 32,), (None,)], "track_id string")
    none = store.get_embeddings(store.scan_store(spark, path), absent)
    assert _scanned(none) == 0 and none.count() == 0  # inside the ranges, but the Bloom filters know better
    many = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("track_id"))
    assert store.get_embeddings(store.scan_store(spark, path), many).count() == 3000


def hashing_md5(k):
    import hashlib

    return hashlib.md5(str(k).encode()).hexdigest()


def test_stream_state_knows_ids_without_reading_the_store(spark, tmp_path, monkeypatch):
    src, path, mark = str(tmp_path / "in"), str(tmp_path / "s"), str(tmp_path / "c")
    store.write_store(track(spark, ("1", "/old", "x", [1.0])), path)
    batch = track(spark, ("1", "/new", "x", [2.0]), ("2", "/z", "y", [2.0]), ("2", "/b/c", "first", [2.0]), ("2", "/b.c", "y", [2.0]), ("3", "/c", "y", None), (None, "/n", "y", [1.0]))
    batch.coalesce(1).write.mode("append").parquet(src)
    reads = []
    read = ingest.scan_store
    monkeypatch.setattr(ingest, "scan_store", lambda *a, **k: reads.append(a) or read(*a, **k))
    plans = []
    write = ingest.write_delta
    monkeypatch.setattr(ingest, "write_delta", lambda df, *a: plans.append(df._jdf.queryExecution().toString()) or write(df, *a))
    run = lambda: ingest_stream(spark, src, path, mark, schema=batch.schema, files_per_trigger=1).awaitTermination()
    run()
    rows = lambda: {r["track_id"]: r["path"] for r in store.scan_store(spark, path).collect()}
    assert rows() == {"1": "/old", "2": "/b/c"}
    assert len(reads) == 1  # to announce the ids at the start
    track(spark, ("3", "/late", "now it can be read", [3.0]), ("2", "/a", "too late", [3.0])).coalesce(1).write.mode("append").parquet(src)
    track(spark, ("4", "/d", "y", [4.0])).coalesce(1).write.mode("append").parquet(src)
    store.write_delta(track(spark, ("4", "/other", "of another writer", [4.0])), path)
    run()
    assert rows() == {"1": "/old", "2": "/b/c", "3": "/late", "4": "/other"}
    assert len(reads) == 1  # the other writer's ids came from its delta alone
    assert plans and not any("/s/base-" in p or "/s/delta-" in p for p in plans)
    run()
    assert rows() == {"1": "/old", "2": "/b/c", "3": "/late", "4": "/other"}


# ---- positions and quantiles


def test_positions(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"))
    got = group_positions(df, ["k"], salt_bucket(F.col("id"), 16), ["id"], "p", "n").toPandas()
    for _, part in got.groupby("k"):
        assert sorted(part["p"]) == list(range(len(part))) and (part["n"] == len(part)).all()
    placed = global_positions(df, "id", buckets=7).orderBy("id").toPandas()
    assert list(placed["position"]) == list(range(500))


def test_quantiles_of_large_groups_come_from_brackets(spark):
    """Rows beyond the tight and the loose margin, a value that a third of a group has, and groups of every size."""
    n = 1_200_000
    x = F.when(F.col("id") % 3 == 0, 0.25).otherwise((F.xxhash64("id") % 100_003).cast("double"))
    key = F.when(F.col("id") < 1_050_000, "tight").when(F.col("id") < 1_190_000, "loose").otherwise(F.concat(F.lit("k"), F.floor(F.col("id") / 900)))
    df = spark.range(n).select(key.alias("k"), x.alias("x"))
    points = (0.0, 0.001, 0.25, 0.3333, 0.5, 0.95, 1.0)
    got = {r["k"]: r["q"] for r in exact_quantiles(df, "x", points, ["k"]).collect()}
    for k, part in df.toPandas().groupby("k"):
        assert got[k] == pytest.approx(list(np.quantile(part["x"], points)), rel=1e-12), k


def test_exact_quantiles(spark):
    rng = np.random.default_rng(0)
    x = np.round(np.concatenate([rng.standard_normal(700), np.full(400, 0.5)]), 2)
    keys = [None if i % 5 == 0 else "hot" if i % 2 else f"k{i % 3}" for i in range(len(x))]
    df = spark.createDataFrame(list(zip(keys, x.tolist())), "k string, x double")
    points = (0.0, 0.25, 0.5, 0.901, 1.0)
    got = {r["k"]: r["q"] for r in exact_quantiles(df, "x", points, ["k"]).collect()}
    for k in set(keys):
        mine = x[[i for i, v in enumerate(keys) if v == k]]
        assert got[k] == pytest.approx([np.percentile(mine, 100 * p) for p in points])
    whole = exact_quantiles(df, "x", points).first()["q"]
    assert whole == pytest.approx([np.percentile(x, 100 * p) for p in points])


# ---- curation and linkage


def greedy(rows):
    """The sequential rule: the last word on dedup."""
    ids, keys, out = set(), set(), {}
    for seq, vid, key in rows:
        if vid is None:
            out[seq] = "no_id"
        elif vid in ids:
            out[seq] = "id_dupe"
        elif key and key in keys:
            out[seq] = "title_dupe"
        else:
            out[seq] = "kept"
            ids.add(vid)
            if key:
                keys.add(key)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dedup_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    words = ["red", "blue", "green", "gold", ""]
    rows = []
    for seq in range(150):
        vid = rng.randrange(40)
        url = "https://x/none" if rng.random() < 0.05 else f"https://x/watch?v={vid:011d}"
        title = " ".join(rng.sample(words, 2)) if rng.random() < 0.9 else "x"
        rows.append((seq, url, title))
    df = spark.createDataFrame(rows, "seq long, url string, title string").repartition(5)
    keyed = df.select("seq", video_id_from_url(F.col("url")), title_dedup_key(F.col("title"))).orderBy("seq").collect()
    got = {r["seq"]: r["status"] for r in curation.dedup_first_wins(df).collect()}
    assert got == greedy([tuple(r) for r in keyed])
    kept = [s for s, v in sorted(got.items()) if v == "kept"][:4]
    assert [r["seq"] for r in curation.keep_tracks(curation.dedup_first_wins(df), 4).orderBy("seq").collect()] == kept


def test_chains_of_copies_end_in_few_rounds(spark, monkeypatch):
    """A row that waits for a row that waits ...: 2,000 links are settled by jumps, with the result of the sequential rule."""
    calls = []
    cut = curation.cut_lineage
    monkeypatch.setattr(curation, "cut_lineage", lambda df: calls.append(1) or cut(df))
    url = lambda k: f"https://x.example/watch?v={k:011d}"
    rows = [(n, url((n + 1) // 2), f"song number{n // 2}") for n in range(2000)]
    rng = random.Random(8)
    rows += [(5000 + n, url(5000 + rng.randint(0, 150)), f"other title{rng.randint(0, 150)}") for n in range(300)]  # with forks
    df = spark.createDataFrame(rows, "seq long, url string, title string").repartition(4)
    got = {r["seq"]: r["status"] for r in curation.dedup_first_wins(df).collect()}
    assert got == greedy([(n, u[-11:], t.replace("number", "number")) for n, u, t in [(n, u, " ".join(sorted(t.split()))) for n, u, t in rows]])
    assert sum(s == "kept" for n, s in got.items() if n < 2000) == 1000
    assert len(calls) < 60


def test_resolve_caches_failures_and_keeps_order(spark):
    inputs = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "bad")], "pos long, raw string")
    empty = spark.createDataFrame([], "cache_key string, entries array<struct<url:string,title:string>>")
    asked = []

    def resolve(missing):
        asked.append(sorted(r["raw"] for r in missing.collect()))
        entry = F.array(F.struct(F.col("raw").alias("url"), F.lit("t").alias("title")))
        return missing.where("raw <> 'bad'").select("cache_key", entry.alias("entries"))

    flat, cache = curation.resolve_incremental(inputs, empty, resolve, search_limit=3)
    assert [r["url"] for r in flat.orderBy("pos", "entry_pos").collect()] == ["b", "a", "b"]
    assert cache.count() == 3
    curation.resolve_incremental(inputs, cache, resolve, search_limit=3)
    curation.resolve_incremental(inputs, cache, resolve, search_limit=4)
    assert asked == [["a", "b", "bad"], [], ["a", "b", "bad"]]


def test_duration_rules(spark):
    df = spark.createDataFrame([(None,), (59.0,), (60.0,), (600.0,), (601.0,)], "d double")
    d = F.col("d")
    got = [tuple(r) for r in df.coalesce(1).select(curation.duration_filter(d, 60, 600), curation.duration_verdict(d), curation.duration_verdict(d, 0, 0)).collect()]
    assert [g[0] for g in got] == [True, False, True, True, False]
    assert [g[1] for g in got] == ["ok", "too_short", "ok", "ok", "too_long"] and {g[2] for g in got} == {"ok"}


def link_brute(tracks, recs):
    import re

    norm = lambda s: re.sub("[^0-9a-z]+", " ", (s or "").casefold()).strip()
    toks = lambda s: {t for t in norm(s).split() if len(t) >= 3}
    out = {}
    for src, title, artist, album, ms in tracks:
        stages = [
            lambda r: artist and album and norm(artist) and norm(album) and norm(r[2]) == norm(artist) and norm(album) in [norm(x) for x in r[3]],
            lambda r: artist and norm(artist) and norm(r[2]) == norm(artist),
            lambda r: True,
        ]
        for stage, ok in enumerate(stages, 1):
            best = None
            for r in recs:
                if norm(r[1]) != norm(title) or not norm(title) or not ok(r):
                    continue
                am = bool(toks(artist) & toks(r[2]))
                bm = bool(norm(album)) and any(norm(album) in norm(x) for x in r[3])
                score = r[5] - (min(abs(r[4] - ms) / 1000, 30) if r[4] and ms else 0) + 20 * am + 20 * bm
                if (artist or album) and not (am or bm):
                    score = -999
                if best is None or (score, -r[0]) > best:
                    best = (score, -r[0])
            if best and best[0] >= 60:
                out[src] = (stage, -best[1], round(best[0], 3))
                break
    return out


def test_best_match_equals_brute_force(spark):
    rng = random.Random(11)
    artists = ["The Cats", "Cats & Dogs", "A B", "", None, "Dogs"]
    albums = ["Best", "best of", "Gold (Deluxe)", "", None, "ol"]
    tracks = [(i, rng.choice(["Song", "Other!", "Lone", ""]), rng.choice(artists), rng.choice(albums), rng.choice([None, 0, rng.randrange(1, 200_000)])) for i in range(120)]
    recs = [(i, rng.choice(["song", "Other", "else"]), rng.choice(artists) or "x", rng.sample(["Best of", "Gold", "Gold deluxe", "Old"], 2), rng.choice([0, rng.randrange(1, 200_000)]), rng.randrange(30, 100)) for i in range(150)]
    left = spark.createDataFrame(tracks, "src long, title string, artist string, album string, ms long")
    right = spark.createDataFrame(recs, "cand long, title string, artist_names string, releases array<string>, length long, base int")
    got = {r["src"]: (r["stage"], r["cand"], round(r["score"], 3)) for r in linking.best_match(left, right).collect()}
    want = link_brute(tracks, recs)
    assert got == want and {v[0] for v in want.values()} == {1, 2, 3}


# ---- sampling


def test_partners(spark):
    df = spark.range(900).select("id", F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("a"), F.col("id") % 200)).alias("artist"))
    owner = {r["id"]: r["artist"] for r in df.collect()}
    got = sampling.positive_pairs(df, 0.5, "s").collect()
    assert len(got) == 900
    for r in got:
        if r["is_mate"]:
            assert r["partner_id"] != r["id"] and owner[r["partner_id"]] == owner[r["id"]] is not None
        else:
            assert r["partner_id"] == r["id"]
    lone = sum(1 for a in owner.values() if a is None)
    share = sum(r["is_mate"] for r in got) / (900 - lone)
    assert 0.4 < share < 0.6
    assert not any(r["is_mate"] for r in sampling.positive_pairs(df, 0.0, "s").collect())
    again = sampling.positive_pairs(df.repartition(3), 0.5, "s").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    other = {r["id"]: r["partner_id"] for r in sampling.positive_pairs(df, 0.5, sampling.draw_seed("s", 1)).collect()}
    assert any(other[r["id"]] != r["partner_id"] for r in got)


def test_partners_are_uniform(spark):
    df = spark.range(300).select("id", F.floor(F.col("id") / 5).alias("artist"))
    counts = {}
    for r in sampling.positive_pairs(df, 1.0, "u").collect():
        pair = r["id"] % 5, r["partner_id"] % 5
        counts[pair] = counts.get(pair, 0) + 1
    cells = [counts.get((i, j), 0) for i in range(5) for j in range(5) if i != j]
    chi = sum((c - 15) ** 2 / 15 for c in cells)
    assert chi < 45  # 15 degrees of freedom


def test_pool_size(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "artist string")
    assert sampling.artist_pool_size(df).first()[0] == 2 and sampling.artist_pool_size(df, prob=0).first()[0] == 0


def test_epoch_batches(spark):
    df = spark.range(103)
    got = sampling.epoch_batches(df, 10, "e").toPandas()
    assert len(got) == 100 and (got.groupby("batch_id").size() == 10).all()
    full = sampling.epoch_batches(df, 10, "e", drop_last=False, buckets=8).toPandas()
    assert sorted(full["place"]) == list(range(103))
    assert list(full.sort_values("place")["id"]) != list(range(103))
    assert sampling.validation_batch_size(64, 1) == 2 and sampling.validation_batch_size(4, 9) == 4


def test_sample_views(spark):
    df = spark.createDataFrame([(i, [float(x) for x in range(n)]) for i, n in enumerate((5, 8, 12, 30))], "id long, clip array<float>")
    got = sampling.sample_views(df, 6, 8, 4, "s").collect()
    assert len(got) == 6 and {len(r["window"]) for r in got} == {8}
    assert all(r["start"] == 4 for r in got if r["part"] == 1)
    with pytest.raises(ValueError, match="only collected 6"):
        sampling.sample_views(df, 7, 8, 4, "s")


def test_splits(spark):
    df = spark.createDataFrame([(i, "training") for i in range(25)], "id long, split string")
    tail = L.split_or_fallback(df, "validation", "id")
    assert sorted(r["id"] for r in tail.collect()) == [23, 24]  # round(2.5) is 2
    train, val = L.prepare_splits(df, "id")
    assert train.count() == 23 and val.count() == 2
    assert L.split_or_fallback(df.limit(1), "validation", "id").count() == 1
    both = df.withColumn("split", F.when(F.col("id") < 3, "validation").otherwise("training"))
    train, val = L.prepare_splits(both, "id")
    assert train.count() == 22 and val.count() == 3


# ---- comparison, reports, inference


def two_views(spark, n=40, d=6):
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((n, d)), rng.standard_normal((n, d))
    rows = [(i, a[i].tolist(), b[i].tolist(), f"k{i % 3}" if i else "lone") for i in range(n)]
    return a, b, spark.createDataFrame(rows, "id long, a array<double>, b array<double>, k string")


def test_relational_mse_forms_agree(spark, monkeypatch):
    a, b, pairs = two_views(spark)
    gap = (a @ a.T - b @ b.T) ** 2
    want = (gap.sum() - np.trace(gap)) / (40 * 39)
    assert compare.relational_mse(pairs).first()["relational_mse"] == pytest.approx(want)
    small = {r["key"]: (r["n_rows"], r["relational_mse"]) for r in compare.relational_mse(pairs, F.col("k")).collect()}
    monkeypatch.setattr(compare, "SMALL_KEY_ROWS", 0)
    large = {r["key"]: (r["n_rows"], r["relational_mse"]) for r in compare.relational_mse(pairs, F.col("k")).collect()}
    assert set(small) == set(large) == {"k0", "k1", "k2", "lone"} and small["lone"] == (1, 0.0)
    for k in small:
        assert small[k] == pytest.approx(large[k])


def test_redundancy_forms_agree(spark, monkeypatch):
    a, b, pairs = two_views(spark)
    small = {r["key"]: tuple(r)[1:] for r in compare.redundancy_report(pairs, F.col("k")).collect()}
    monkeypatch.setattr(compare, "SMALL_KEY_ROWS", 0)
    large = {r["key"]: tuple(r)[1:] for r in compare.redundancy_report(pairs, F.col("k")).collect()}
    assert set(small) == {"k0", "k1", "k2"} == set(k for k in large if large[k][0] > 1)
    for k in small:
        assert small[k] == pytest.approx(large[k])
    got = compare.redundancy_report(pairs).first()
    assert got["sim"] == pytest.approx(((a - b) ** 2).mean())
    with pytest.raises(Exception, match="two rows"):
        compare.redundancy_report(pairs.limit(1)).collect()


def test_rotation_keeps_relations(spark):
    rng = np.random.default_rng(4)
    a = rng.standard_normal((30, 5)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r], str(i % 3)) for i, r in enumerate(a)], "id long, embedding array<float>, label string")
    turned = df.withColumn("embedding", F.reverse("embedding"))
    row = compare.compare_report(df, turned, k_values=(5, 10, 99)).first().asDict()
    assert row["overlap_at_5"] == row["overlap_at_10"] == 1.0 and "overlap_at_99" not in row
    assert compare.relational_mse(compare.pair_views(df, turned)).first()["relational_mse"] == pytest.approx(0, abs=1e-9)
    one_label = compare.compare_report(df.withColumn("label", F.lit("x")), turned, k_values=(5,))
    assert "overlap_at_5" not in one_label.columns


def test_flatten_report(spark):
    df = spark.createDataFrame([Row(a=Row(b=1, c=Row(d=2.5)), e=3, s="x", f=True, n=None, l=[1])], "a struct<b:int,c:struct<d:double>>, e int, s string, f boolean, n double, l array<int>")
    assert {tuple(r) for r in reports.flatten_report(df).collect()} == {("a/b", 1.0), ("a/c/d", 2.5), ("e", 3.0)}
    text = reports.json_report(df).first()["json"]
    assert list(json.loads(text)) == sorted(json.loads(text)) and json.loads(text)["a"] == {"b": 1, "c": {"d": 2.5}}


def test_best_checkpoint(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.7), ("a", 3, 0.7), ("b", 1, -2.0)], "run string, epoch int, m double")
    assert [tuple(r) for r in reports.best_checkpoint(df, "run", "epoch", "m").collect()] == [("a", 2, 0.7)]
    got = {(r["run"], r["epoch"]): (r["best_so_far"], r["improved"]) for r in reports.running_best(df, "run", "epoch", "m").collect()}
    assert got == {("a", 1): (0.5, True), ("a", 2): (0.7, True), ("a", 3): (0.7, False), ("b", 1): (-1.0, False)}


def test_quality_gates_warn(spark):
    df = spark.createDataFrame([("recall_at_10", 0.5), ("cosine_mean_int8", 0.9999), ("other", 1.0)], "metric string, value double")
    got = {r["metric"]: r["status"] for r in reports.quality_gates(df).collect()}
    assert got == {"recall_at_10": "warn", "cosine_mean_int8": "pass"}


def test_inference_counts_failures(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id int, window array<float>")
    got = {r["id"]: r for r in inference.batched_inference(df, inference.projection_model(2, 3), 2).collect()}
    weights = np.cos(1 + 7 * np.arange(2)[:, None] + 13 * np.arange(3)[None, :])
    assert got[1]["embedding"] == pytest.approx(np.array([1.0, 2.0]) @ weights, abs=1e-6)
    assert got[2]["status"] == got[3]["status"] == "failed" and got[2]["embedding"] is None


def test_log_mel(spark):
    t = np.arange(fixed.WINDOW_SAMPLES) / fixed.TARGET_SR
    tone = (0.25 * np.sin(2 * np.pi * 440 * t)).astype(np.float32)
    df = spark.createDataFrame([(1, tone[:24000].tolist()), (2, None)], "id int, wave array<float>")
    got = {r["id"]: np.array(r["m"]) for r in df.select("id", inference.log_mel(F.col("wave")).alias("m")).collect()}
    assert got[1].shape == (96, 251) and np.isfinite(got[1]).all()
    assert got[1].mean() == pytest.approx(0, abs=1e-4) and got[1].std(ddof=1) == pytest.approx(1, abs=1e-3)
    filters = inference.mel_filters(24_000, 1024, 96, 20.0, 12_000.0)
    loudest = got[1][:, 10].argmax()
    assert filters[:, loudest].argmax() * 24_000 / 1024 == pytest.approx(440, abs=40)
    assert np.abs(got[2]).max() < 1e-6


def test_scratch_tables_can_be_dropped(spark):
    from vecloom import session

    df = session.materialize(spark.range(3).toDF("id"), "t")
    assert df.count() == 3 and session.drop_scratch(spark) >= 1 and session.drop_scratch(spark) == 0


def test_one_bad_window_fails_alone(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [13.0, 0.0]), (5, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "id int, window array<double>").coalesce(1)

    def unlucky():
        def model(batch):
            if (batch[:, 0] == 13).any():
                raise RuntimeError("unlucky")
            return batch * 2

        return model

    got = {r["id"]: (r["status"], r["embedding"]) for r in inference.batched_inference(df, unlucky, 2).collect()}
    assert got == {1: ("ok", [2.0, 4.0]), 2: ("failed", None), 3: ("failed", None), 4: ("failed", None), 5: ("ok", [6.0, 8.0])}


def test_many_offers_of_one_title_and_length_bucket(spark):
    """Both windows of a bucket take time in proportion to its rows."""
    n = 20_000
    offers = spark.range(n).selectExpr("'t' AS key", "60000 + id AS length", "CAST(id % 97 AS bigint) AS base", "id AS cand")
    asks = spark.range(n).selectExpr("'t' AS key", "60000 + (id * 7) % 20000 AS ms").distinct()
    start = time.time()
    assert linking.best_by_duration(asks, offers).filter("cand IS NOT NULL").count() == n
    assert time.time() - start < 60


@pytest.mark.parametrize("n", [2000, 20_000])
def test_albums_are_looked_up_by_their_rarest_run(spark, n):
    """One title with thousands of tracks and recordings: the index lists no pairs that aren't nearly matches."""
    left = spark.range(n).selectExpr("'t' AS t", "CASE WHEN id % 50 = 0 THEN substr('ab cd', 1 + id % 4, 2) WHEN id % 7 = 0 THEN '' ELSE concat('the greatest hits ', id) END AS b").distinct()
    right = spark.range(n).selectExpr("'t' AS t", "array(concat('the greatest hits ', id, ' live'), 'x ab cd', '') AS rel")
    start = time.time()
    got = {(r["b"], r["r"]) for r in linking._album_pairs(left, right).collect()}
    assert time.time() - start < 60
    if n == 2000:
        have = {f"the greatest hits {i} live" for i in range(n)} | {"x ab cd"}
        assert got == {(b, r) for b in {r["b"] for r in left.collect()} if b for r in have if b in r}


def test_a_long_stream_leaves_few_folders(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "store")
    for k in range(12):
        track(spark, (f"{k:02d}", f"/{k:02d}", "t", [1.0])).coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    ingest_stream(
        spark, src, path, str(tmp_path / "mark"), schema=schema, files_per_trigger=1, compact_every=4, grace_seconds=0
    ).awaitTermination()
    assert {r["track_id"] for r in store.scan_store(spark, path).collect()} == {f"{k:02d}" for k in range(12)}
    assert len([n for n in os.listdir(path) if not n.startswith(".")]) <= 5
