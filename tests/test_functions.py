import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vecloom.functions import hashing as H
from vecloom.functions import linkage as K
from vecloom.functions import titles as T
from vecloom.functions import vectors as V
from vecloom.functions import windows as W


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*xs):
    return F.array(*[F.lit(float(x)).cast("float") for x in xs]) if xs else F.array().cast("array<float>")


def test_zero_vector_stays(spark):
    assert one(spark, V.l2_normalize(arr(0, 0))) == [0.0, 0.0]
    assert one(spark, V.l2_normalize(arr(3, 4))) == pytest.approx([0.6, 0.8])
    assert one(spark, V.cosine(arr(0, 0), arr(1, 0))) == 0.0


def test_standardize(spark):
    x = np.array([1.0, 2.0, 4.0])
    assert one(spark, V.standardize(arr(*x))) == pytest.approx((x - x.mean()) / (x.std(ddof=1) + 1e-7))
    assert one(spark, V.standardize(arr(5))) is None
    assert one(spark, V.standardize(arr(5, 5), floor=1e-5)) == [0.0, 0.0]


def test_pad_or_trim(spark):
    assert one(spark, V.pad_or_trim(arr(*[1] * 10), 12)) == [1.0] * 10 + [0.0, 0.0]
    assert one(spark, V.pad_or_trim(arr(*range(20)), 8)) == list(map(float, range(8)))
    assert one(spark, V.pad_or_trim(arr(1, 2, 3), 2, -5)) == [1.0, 2.0]
    assert one(spark, V.pad_or_trim(arr(1, 2, 3), 2, 2)) == [3.0, 0.0]
    assert one(spark, V.pad_or_trim(arr(1, 2, 3), 2, 9)) == [0.0, 0.0]
    assert one(spark, V.pad_or_trim(arr(), 2)) == [0.0, 0.0]


def test_layer_pool(spark):
    x = np.random.default_rng(0).standard_normal((13, 5, 4)).astype(np.float32)
    df = spark.createDataFrame([(x.tolist(),)], "l array<array<array<float>>>")
    got = df.select(V.layer_pool(F.col("l"), (5, 6, 7, 8)).alias("v")).first()["v"]
    want = x[5:9].mean(axis=0).mean(axis=0)
    assert got == pytest.approx(want / np.linalg.norm(want), abs=1e-6)


def test_random_ops_off(spark):
    v = arr(1, 2)
    assert one(spark, V.random_gain(v, F.lit(1), "s", 0)) == [1.0, 2.0]
    assert one(spark, V.random_polarity(v, F.lit(1), "s", 0)) == [1.0, 2.0]
    assert one(spark, V.random_polarity(v, F.lit(1), "s", 1.1)) == [-1.0, -2.0]


def test_gain_stays_in_range(spark):
    got = spark.range(500).select(V.random_gain(arr(1), F.col("id"), "s", 3.0)[0].alias("g")).toPandas()["g"]
    db = 20 * np.log10(got)
    assert db.abs().max() <= 3.0 and db.min() < -2.5 and db.max() > 2.5


def test_mask_bands_are_shared_by_a_batch(spark):
    grid = F.array(*[arr(*[1] * 30) for _ in range(12)])
    df = spark.range(40).select("id", V.mask_bands(grid, F.col("id") % 2, "s", freq_mask_max=3, time_mask_max=5).alias("m"))
    rows = df.collect()
    masks = {b: {str(r["m"]) for r in rows if r["id"] % 2 == b} for b in (0, 1)}
    assert len(masks[0]) == len(masks[1]) == 1
    m = np.array(rows[0]["m"])
    assert 1 <= (m.sum(axis=1) == 0).sum() <= 6 and 1 <= (m.sum(axis=0) == 0).sum() <= 10
    assert one(spark, V.mask_bands(grid, F.lit(1), "s", freq_masks=0, time_masks=0)) == [[1.0] * 30] * 12


def test_mean_pool(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [0.0, 2.0]), ("b", None)], "k string, embedding array<float>")
    got = {r["k"]: r["embedding"] for r in V.mean_pool(df, ["k"]).collect()}
    assert got["a"] == pytest.approx([0.5**0.5] * 2) and got["b"] == pytest.approx([0.0, 1.0])


# ---- windows


def test_sliding_windows(spark):
    got = one(spark, W.sliding_windows(arr(*[1] * 10), 120, 60))
    assert len(got) == 1 and got[0] == [1.0] * 10 + [0.0] * 110
    x = np.arange(300, dtype=float)
    got = one(spark, W.sliding_windows(arr(*x), 120, 60))
    assert len(got) == 4 and got[1][0] == 60.0 and got[3] == list(x[180:300])
    assert len(one(spark, W.sliding_windows(arr(), 4, 2))) == 1
    with pytest.raises(ValueError):
        W.sliding_windows(arr(1), 0, 1)


def test_long_form_agrees(spark):
    for n in (1, 15, 16, 17, 24, 25, 40):
        held = spark.range(n).select("id", F.explode(W.windows_of_position(F.col("id"), F.lit(n), 16, 8)).alias("w")).toPandas()
        whole = one(spark, W.sliding_windows(arr(*range(1, n + 1)), 16, 8))
        sums = held.groupby("w")["id"].apply(lambda s: (s + 1).sum()).to_dict()
        assert sums == {i: sum(w) for i, w in enumerate(whole)}


def test_plan_windows_equals_linspace(spark):
    assert one(spark, W.plan_windows(300_000, 3)) == [0, 90_000, 180_000]
    assert one(spark, W.plan_windows(10, 2)) == [0, 0]
    assert one(spark, W.plan_windows(300_001, 1)) == [90_000]
    for count in (2, 3, 5, 7):
        got = spark.range(17, 2000).select("id", W.plan_windows(F.col("id"), count, 16).alias("s")).collect()
        assert all(r["s"] == [int(v) for v in np.linspace(0, r["id"] - 16, count)] for r in got)
    with pytest.raises(ValueError):
        W.plan_windows(10, 0)


def test_rounding_half_to_even(spark):
    assert one(spark, W.estimate_samples(F.lit(5), F.lit(2), 1)) == round(2.5)
    assert one(spark, W.rescale_offset(F.lit(3))) == 6


def test_crop_starts_cover_the_range(spark):
    got = {r["s"] for r in spark.range(400).select(W.crop_start(F.lit(10), 6, F.col("id"), "c").alias("s")).collect()}
    assert got == {0, 1, 2, 3, 4}
    assert one(spark, W.random_crop(arr(1, 2), 4, F.lit(1), "c")) == [1.0, 2.0, 0.0, 0.0]


# ---- ids


def fingerprint(data, head_tail=1 << 20, seed=0):
    n = len(data)
    body = data if n <= 2 * head_tail else data[:head_tail] + data[-head_tail:]
    return xxhash.xxh64(n.to_bytes(8, "little") + body, seed=seed).hexdigest()


def test_content_fingerprint(spark):
    big = bytearray(3 << 20)
    first, last, middle = bytearray(big), bytearray(big), bytearray(big)
    first[0], last[-1], middle[3 << 19] = 1, 1, 1
    data = [b"", b"x" * 51, b"abc" * 4096, bytes(100), bytes(101), bytes(2 << 20), bytes(big), bytes(first), bytes(last), bytes(middle)]
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "i int, c binary")
    got = df.select(H.content_fingerprint(F.col("c")).alias("a"), H.content_fingerprint_seed0(F.col("c")).alias("b")).collect()
    assert [r["a"] for r in got] == [fingerprint(d, seed=42) for d in data]
    assert [r["b"] for r in got] == [fingerprint(d) for d in data]
    ids = [r["a"] for r in got]
    assert len(ids[1]) == 16 and ids[6] == ids[9] and len({ids[6], ids[7], ids[8], ids[3], ids[4]}) == 5


def test_paths(spark):
    rows = [("/a/000/000002.mp3",), ("000002",), ("/a/00002.mp3",), ("/a/0000021.mp3",), ("/a/000002.x.mp3",), ("/ab/000002.mp3",)]
    got = values(spark, rows, "p string", H.path_to_id(F.col("p")), H.relative_path(F.col("p"), "/a/"))
    assert got == [(2, "000/000002.mp3"), (2, None), (None, "00002.mp3"), (None, "0000021.mp3"), (None, "000002.x.mp3"), (2, None)]
    assert one(spark, H.id_to_path("/r/50%", F.lit(1234567))) == "/r/50%/1234/1234567.mp3"


def test_video_ids(spark):
    urls = ["https://y/watch?v=abcdefghijk", "https://y/watch?a=1&v=abc-efg_ijkZ", "https://youtu.be/abcdefghijk?t=1", "https://y/embed/abcdefghijk", "https://y/shorts/abcdefghijk", "https://y/watch?v=short", ""]
    got = [r[0] for r in values(spark, [(u,) for u in urls], "u string", H.video_id_from_url(F.col("u")))]
    assert got == ["abcdefghijk", "abc-efg_ijk", "abcdefghijk", "abcdefghijk", "abcdefghijk", None, None]


def test_cache_key_spells_none(spark):
    import hashlib

    for lo, hi in ((None, 600.0), (60.0, None), (1.5, 2.0)):
        want = hashlib.sha256(f"q\0{10}\0{lo}\0{hi}".encode()).hexdigest()[:16]
        assert one(spark, H.resolution_cache_key(F.lit("q"), F.lit(10), F.lit(lo), F.lit(hi))) == want


def test_uniform(spark):
    got = spark.range(2000).select(H.uniform(F.col("id"), "s").alias("u")).toPandas()["u"]
    assert 0 <= got.min() and got.max() < 1 and abs(got.mean() - 0.5) < 0.03


# ---- text

TITLES = {
    "Song (Official Music Video Remastered 2011)": "song",
    "Song [HD Lyric Video]": "song",
    "Song (feat. Wizkid & Kyla)": "song",
    "Song ft. Wizkid": "song",
    "Song [Extended Mix] (10 hours loop) [Looped]": "song",
    "Song - Topic": "song",
    "Song | Some Channel": "song",
    "Artist – Song, Live!": "artist song live",
    "Song (Slowed)": "song slowed",
    "Déjà VU  STRASSE": "déjà vu strasse",
    "Straße ẞ": "strasse ss",
    "ΣΟΦΟΣ": "σοφοσ",
    "ﬁre": "fire",
    "": "",
    "Без названия (аудио)": "без названия аудио",
}


def test_normalize_title(spark):
    got = values(spark, [(t,) for t in TITLES], "t string", F.col("t"), T.normalize_title(F.col("t")))
    assert dict(got) == TITLES
    assert one(spark, T.normalize_title(F.lit(None).cast("string"))) == ""


def test_dedup_key_ignores_order(spark):
    rows = [("Drake - One Dance",), ("One Dance - Drake (Audio)",), ("a b",), ("Go Go go",)]
    got = [r[0] for r in values(spark, rows, "t string", T.title_dedup_key(F.col("t")))]
    assert got == ["dance drake one", "dance drake one", "", "go"]


def test_casefold_follows_python(spark):
    words = ["ß", "ẞ", "ς", "ǰ", "ΐ", "ﬀ", "Å", "ſ", "µ", "İ", "Ꭰ", "ԱՒ", "և"]
    got = values(spark, [(w,) for w in words], "w string", T.casefold(F.col("w")))
    assert [g[0] for g in got] == [w.casefold() for w in words]


def test_safe_filename(spark):
    names = ["a/b: c", "  ", "x\ty\nz", "end. . ", " pad ", "n" * 300]
    got = [r[0] for r in values(spark, [(n,) for n in names], "n string", T.safe_filename(F.col("n")))]
    assert got == ["a-b - c", "track", "x y z", "end", "pad", "n" * 180]


def test_clean_value(spark):
    got = [r[0] for r in values(spark, [(None,), (" NA ",), ("\t x ",)], "v string", T.clean_value(F.col("v")))]
    assert got == ["", "", "x"]


def test_classify_input(spark):
    rows = [" # note", "", "https://y/playlist?list=1", "https://y/watch?v=1&list=2", "ytsearch3:q", "free text"]
    kind, target = T.classify_input(F.col("r"), 10)
    got = values(spark, [(r,) for r in rows], "r string", kind, target)
    assert got == [(None, None), (None, None), ("playlist", rows[2]), ("single", rows[3]), ("search", "ytsearch3:q"), ("search", "ytsearch10:free text")]


def test_years_and_dates(spark):
    texts = ["℗ 2012 X", "no 12345", "a1999 2001-02-03", "", "Released on: 2015-06-07"]
    got = [r[0] for r in values(spark, [(t,) for t in texts], "t string", T.first_year(F.col("t")))]
    want = [(m.group(1) if (m := re.search(r"(?:℗|©|Released on:|\b)(\d{4})(?:-\d{2}-\d{2})?", t)) else "") for t in texts]
    assert got == want
    rows = [("20120304", ""), ("2012-03-04", ""), ("2012", ""), ("x", "a Released on:  2015-06-07"), (None, "℗2011"), ("NA", "")]
    got = [r[0] for r in values(spark, rows, "r string, d string", T.release_date(F.col("r"), F.col("d")))]
    assert got == ["2012-03-04", "2012-03-04", "2012", "2015-06-07", "2011", ""]


def test_copyright_and_note(spark):
    text = "Provided to YouTube by Label\r\n\n  ℗ 2010 L \n© x"
    assert one(spark, T.copyright_line(F.lit(text))) == "℗ 2010 L"
    assert one(spark, T.copyright_line(F.lit("x © y\n © z"))) == "© z"
    assert one(spark, T.source_note(F.lit(text))) == "Provided to YouTube by Label. Auto-generated by YouTube."
    assert one(spark, T.source_note(F.lit("")))== "Auto-generated by YouTube."


def test_artist_title(spark):
    rows = [
        ("A, B", "T", "x"), (None, None, "Ann - Song (Official Video) HD"), ("NA", "Given", "Ann - Song - Live"),
        (None, "Given", "plain"), (None, None, "Ann - official audio"),
    ]
    got = values(spark, rows, "a string, t string, raw string", *T.infer_artist_title(F.col("a"), F.col("t"), F.col("raw")))
    assert got == [
        ("A, B", "T", "A"), ("Ann", "SongHD", "Ann"), ("Ann", "Song - Live", "Ann"), ("", "plain", ""),
        ("Ann", "Ann - official audio", "Ann"),
    ]


def test_genre_rules(spark):
    rows = [("Lost", "", "", None), ("Montagem X", "", "", None), ("Hajimemashita", "", "", None), ("grape", "", "", "Folk"), ("calm", None, "", "Folk"), ("calm", "", "", " NA")]
    cols = [F.col(c) for c in "tlag"]
    got = [r[0] for r in values(spark, rows, "t string, l string, a string, g string", T.infer_genre(*cols))]
    assert got == ["Soundtrack", "Brazilian Funk", "Anime", "Hip-Hop/Rap", "Folk", "Pop"]
    got = [r[0] for r in values(spark, rows, "t string, l string, a string, g string", T.infer_genre(*cols, whole_words=True))]
    assert got == ["Pop", "Brazilian Funk", "Anime", "Folk", "Folk", "Pop"]


def test_tags(spark):
    rows = [({"title": [" T "], "artist": [], "albumartist": ["AA"], "date": ["1999-01-02"]},), ({"title": [""], "year": ["2101"], "artist": [" "]},), (None,)]
    parsed = T.parse_tags(F.col("m"))
    got = values(spark, rows, "m map<string,array<string>>", *parsed.values())
    assert got == [("T", "AA", None, None, 1999), (None, None, None, None, None), (None,) * 5]
    years = [("1899",), ("1900x",), ("19a0",), ("2100-1",), ("210",)]
    assert [r[0] for r in values(spark, years, "y string", T.parse_year(F.col("y")))] == [None, 1900, None, 2100, None]


def test_tag_merge(spark):
    rows = [({"a": "1", "b": ""}, {"a": "x", "b": "y", "c": ""}), (None, {"k": "v"})]
    got = values(spark, rows, "i map<string,string>, l map<string,string>", T.tag_merge(F.col("i"), F.col("l")))
    assert [g[0] for g in got] == [{"a": "1", "b": "y"}, {"k": "v"}]


# ---- linkage


def test_norm_and_matches(spark):
    assert one(spark, K.norm_text(F.lit("  Beyoncé & JAY-Z!"))) == "beyonc jay z"
    assert one(spark, K.norm_text(F.lit("Княzz"))) == "zz"
    assert sorted(one(spark, K.tokens(F.lit("The the a cat")))) == ["cat", "the"]
    assert one(spark, K.artist_match(F.lit(""), F.lit("x"))) is False
    assert one(spark, K.artist_match(F.lit("The Cat"), F.lit("cat dog"))) is True
    releases = F.array(F.lit(None).cast("string"), F.lit("Best Of (Deluxe)"))
    assert one(spark, K.album_match(F.lit("best of"), releases)) is True
    assert one(spark, K.album_match(F.lit("!"), releases)) is False
    assert one(spark, K.album_match(F.lit("x"), F.lit(None).cast("array<string>"))) is False


def test_release_scores(spark):
    score = lambda *a: one(spark, K.release_score(*[F.lit(x).cast("string") for x in a]))
    assert score("Album", "Official", "2001", "album") == 52.0
    assert score("Album deluxe", "pseudo-release", "NA", "album") == -5.0
    assert score(None, None, None, "") == 0.0


def test_credit_fold(spark):
    from vecloom.schemas import ARTIST_CREDIT

    text = '[{"name":"","artist":{"name":"B","sort-name":"B, x","id":"1"}},{"name":"C","artist":null}]'
    got = one(spark, K.artist_credit_fold(F.from_json(F.lit(text), ARTIST_CREDIT)))
    assert tuple(got) == ("B; C", "B, x", "1")
    assert tuple(one(spark, K.artist_credit_fold(F.lit(None).cast(ARTIST_CREDIT)))) == ("", "", "")
