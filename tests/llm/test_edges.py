"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecloom.llm import chat, fixity, language, minhash, mixing, ngram, pii, rules, suffix, winnow

LONG = "the long and winding tale of word" + " again and again it goes on number 7" * 4000
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, LONG),
    (7, "A.B. c"),
    (None, "mail a.b@example.org or 10.0.0.1 and so on for ever and ever, amen said the one who wrote it"),
    (None, None),
]
# columns that clash with names the operators use inside or return
EXTRA = ["_id", "_text", "_key", "n_words", "kept", "score", "spans", "rank", "hash", "node", "_mark", "component", "source", "lang"]


@pytest.fixture(scope="module")
def tracks(spark):
    rows = spark.createDataFrame(ROWS, "track_id long, title string")
    return rows.select("*", *(F.lit(k).alias(c) for k, c in enumerate(EXTRA[:-1])), F.lit("xx").alias("lang"))


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, "rock"), (6, 0, "jazz"), (None, 1, "rock"), (3, None, None), (99, 0, "jazz"), (1, 1, "rock")]
    return spark.createDataFrame(rows, "track_id long, quality int, genre_top string")


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in ("track_id", *columns)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("empty", [False, True])
def test_language(tracks, empty):
    known = tracks.filter("track_id IS NOT NULL").withColumn("lang", F.when(F.col("track_id") == 6, "en").when(F.col("track_id") < 3, "zz"))
    given = tracks.limit(0) if empty else tracks
    found = language.identify_language(given, known)
    got = by_id(found, "lang_pred", "score")
    assert len(got) == (0 if empty else len(ROWS))
    if not empty:
        und = [g for g in got if g[1] == "und"]
        assert {g[0] for g in und} == {3, 4, 5, None} and all(g[2] == 0 for g in und)
        assert all(0 <= g[2] <= 1 for g in got) and (6, "en") in [g[:2] for g in got]


def test_language_without_labels(tracks):
    assert {r["lang_pred"] for r in language.identify_language(tracks, tracks.limit(0)).collect()} == {"und"}


def test_rules(tracks, labels):
    got = by_id(rules.apply_quality_rules(tracks, labels), "n_words", "word_chars", "base_failed", "kept")
    assert len(got) == len(ROWS)
    assert (3, 0, 0, True, False) in got and (4, 0, 0, True, False) in got and (5, 0, 0, True, False) in got
    assert [g for g in got if g[0] == 6][0][1] == len(LONG.split())
    assert rules.apply_quality_rules(tracks.limit(0), labels).count() == 0
    assert by_id(rules.apply_quality_rules(tracks, labels.limit(0)), "n_words", "word_chars", "base_failed", "kept") == got


def test_near_duplicates(tracks):
    got = by_id(minhash.near_duplicates(tracks), "n_shingles", "component_id", "kept")
    assert len(got) == len(ROWS)
    assert (1, 10, 1, True) in got and got.count((2, 10, 1, False)) == 2
    assert (3, 0, 3, True) in got and (4, 0, 4, True) in got and (7, 1, 7, True) in got
    assert sorted(g[1:] for g in got if g[0] is None) == [(0, None, True), (14, None, True)]
    assert minhash.near_duplicates(tracks.limit(0)).count() == 0


def test_one_id_with_two_texts_links_both(spark):
    a, b = "a b c d e f g", "p q r s t u v"
    rows = spark.createDataFrame([(3, a), (3, b), (1, b), (2, a)], "track_id long, title string")
    assert {r["component_id"] for r in minhash.near_duplicates(rows).collect()} == {1}


def test_near_dedup_judges_rows_not_ids(spark):
    from corpus_pipeline import COLUMNS, near_dedup

    a, b = ROWS[0][1], "an altogether different text of ten words stands here alone"
    rows = [(1, a), (5, a), (5, b), (6, b), (7, b + " x"), (7, None), (7, ""), (8, "u v"), (8, "u v"), (None, a), (None, a)]
    docs = spark.createDataFrame([(d, t, "xx", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = near_dedup(spark, docs, "")
    assert got.columns == list(COLUMNS)
    want = [(1, a), (5, b), (7, None), (7, ""), (8, "u v"), (None, a), (None, a)]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_perplexity(tracks):
    got = by_id(ngram.judge_perplexity(tracks, tracks.filter("track_id = 6")), "n_signs", "perplexity", "kept")
    assert len(got) == len(ROWS) and (3, 0, None, False) in got and (4, 0, None, False) in got
    assert min(g[2] for g in got if g[2]) == [g for g in got if g[0] == 6][0][2]
    assert ngram.judge_perplexity(tracks.limit(0), tracks).count() == 0
    uniform = by_id(ngram.judge_perplexity(tracks, tracks.limit(0)), "n_signs", "perplexity")
    assert all(p == pytest.approx(1.0) for _, n, p in uniform if n)


def test_perplexity_of_equal_rows_over_shards(tracks):
    """Rows equal in id, language and text stay rows of their own, whatever the number of shards."""
    given = tracks.union(tracks).union(tracks.filter("track_id IS NULL OR track_id = 1"))
    one = by_id(ngram.judge_perplexity(given, tracks), "n_signs", "perplexity", "threshold", "kept")
    few = by_id(ngram.judge_perplexity(given, tracks, shard_rows=250), "n_signs", "perplexity", "threshold", "kept")
    assert len(few) == len(one) == given.count()
    assert [(g[0], g[1], g[4]) for g in few] == [(g[0], g[1], g[4]) for g in one]
    for k in (2, 3):
        assert [g[k] or 0.0 for g in few] == pytest.approx([g[k] or 0.0 for g in one], rel=1e-5)


def test_fixity(spark, tracks):
    files = tracks.select("track_id", F.col("title").alias("path"), F.col("title").alias("content"), "hash", "node", "_key")
    packed = fixity.pack_records(files, records_per_volume=3)
    assert packed.count() == len(ROWS)
    assert fixity.audit_fixity(packed, packed).count() == 0
    none = packed.limit(0)
    assert {r["kind"] for r in fixity.audit_fixity(packed, none).collect()} == {"missing"}
    assert {r["kind"] for r in fixity.audit_fixity(none, packed).collect()} == {"extra"}
    assert fixity.audit_fixity(none, none).count() == 0


def test_suffixes(tracks):
    got = by_id(suffix.remove_repeats(tracks), "n_bytes", "removed", "kept")
    size = len(ROWS[0][1])
    assert len(got) == len(ROWS) and (1, size, [], None) in got
    assert sum(g[0] == 2 and g[3] == b"" and [tuple(s) for s in g[2]] == [(0, size)] for g in got) == 2
    assert [g[2] for g in got if g[0] in (None, 3, 4, 5, 6, 7)] == [[]] * 7
    assert suffix.remove_repeats(tracks.limit(0)).count() == 0


def test_mixture(tracks, labels):
    got = mixing.mix_to_targets(tracks, labels, {"rock": 0.5, "jazz": 0.5})
    rows = got.collect()
    assert {r["track_id"] for r in rows} == {1, 2, 3, 4, 5, 6, 7, None}
    assert all(r["rate"] >= 0 and abs(sum(r["posterior"].values()) - 1) < 1e-9 for r in rows)
    assert [r["posterior"] for r in rows if r["track_id"] == 3] == [{"rock": 0.5, "jazz": 0.5}]
    assert mixing.mix_to_targets(tracks.limit(0), labels, {"rock": 1.0}).count() == 0
    assert mixing.mix_to_targets(tracks, labels.limit(0), {"rock": 1.0, "jazz": 1.0}).count() == 8
    with pytest.raises(ValueError):
        mixing.mix_to_targets(tracks, labels, {})


def test_contamination(spark, tracks):
    held_out = spark.createDataFrame(
        [(8, ROWS[0][1]), (9, "amen said the one"), (9, "amen said the one"), (10, None), (11, ""), (None, "b c")], "track_id long, title string"
    )
    got = by_id(winnow.mark_contamination(tracks, held_out, carry=("kept",)), "n_words", "n_hit", "hit_items", "contaminated", "kept")
    assert len(got) == len(ROWS)
    assert (1, 14, 14, [8], True, 4) in got and got.count((2, 14, 14, [8], True, 4)) == 2
    assert (3, 0, 0, [], False, 4) in got and (7, 3, 2, [], True, 4) in got
    assert [g[2:4] for g in got if g[0] is None and g[1]] == [(4, [9])]
    assert winnow.mark_contamination(tracks.limit(0), held_out).count() == 0
    assert winnow.mark_contamination(tracks, held_out.limit(0)).filter("n_hit > 0 OR contaminated").count() == 0


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, "assistant", None), (2, 1, None, "</turn>\n### User: x"),
        (None, 0, "assistant", "\\"), (3, 0, "User", "a" * 500_000),
    ]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1)).withColumn("in_loss", F.lit(1))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(given)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, 2: 1, None: 1, 3: 1}
    assert got[None]["loss_chars"] == 1 and got[1]["loss_chars"] == 0
    assert chat.read_back(chat.format_conversations(given.limit(0))).count() == 0
    with pytest.raises(chat.TemplateError):
        chat.format_conversations(given, "{% for turn in turns %}")


def test_personal_data(tracks):
    got = by_id(pii.personal_data(tracks, carry=("score",)), "spans", "masked", "score")
    assert len(got) == len(ROWS) and (3, [], None, 5) in got and (4, [], "", 5) in got
    found = [g for g in got if g[0] is None and g[2]][0]
    assert [s["kind"] for s in found[1]] == ["email", "ip"] and found[2].startswith("mail <EMAIL> or <IP> and")
    assert pii.personal_data(tracks.limit(0)).count() == 0


@pytest.mark.parametrize("stage", ["language", "near_dedup", "decontaminate", "personal_data", "mixture"])
def test_pipeline_stages(spark, stage):
    """Nulls in every column, empty and long texts, repeated rows, clashing columns and no rows at all."""
    import corpus_pipeline

    sf_dir, run = "/root/testdata/sf0.001", dict(corpus_pipeline.STAGES)[stage]
    rows = [(d, t, None if (d or 0) % 2 else "en", None if d == 2 else "s", None if d == 3 else len(t or "")) for d, t in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *(F.lit(1).alias(c) for c in ("_id", "_text", "_key", "score", "lang_pred", "spans", "masked", "contaminated", "rate")))
    got = run(spark, docs, sf_dir)
    ids = sorted((r["doc_id"] for r in got.collect()), key=lambda i: (i is None, i or 0))
    if stage != "mixture":
        assert got.columns == list(corpus_pipeline.COLUMNS)
    want = {
        "language": [1, 2, 2, 6, 7, None],  # the others have no letter
        "near_dedup": [1, 3, 4, 5, 6, 7, None, None],
        "decontaminate": [1, 2, 2, 3, 4, 5, 6, 7, None, None],
        "personal_data": [1, 2, 2, 3, 4, 5, 6, 7, None, None],
        "mixture": [1, 2, 3, 4, 5, 6, 7, None],  # rows of one id are one
    }
    assert ids == want[stage]
    assert run(spark, docs.limit(0), sf_dir).count() == 0


def test_remove_repeats_by_text_ids(spark):
    """Ids of the store are text: order is theirs, hot passages and copies included."""
    passage = "a passage of well over fifty bytes that many of the tracks have in common, word for word"
    rows = [(f"{k:03x}", f"{k} before {passage} after {k * 7}") for k in range(40)] + [("zz", passage), (None, passage), ("001", passage[:49]), ("002", None)]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "track_id string, title string").repartition(5))
    by = {(r["track_id"], r["n_bytes"]): r for r in got.collect()}
    assert len(by) == len(rows)
    first = by["000", len(rows[0][1])]
    assert first["removed"] == [] and by[None, len(passage)]["removed"] == []
    for k in range(1, 40):
        (span,) = by[f"{k:03x}", len(rows[k][1])]["removed"]
        assert passage in rows[k][1][span["start"] : span["end"]] and len(rows[k][1]) - len(passage) - 20 < len(rows[k][1]) - (span["end"] - span["start"])
    assert by["zz", len(passage)]["kept"] == b"" and by["001", 49]["removed"] == [] and by["002", 0]["removed"] == []


def test_shared_fingerprints_dont_grow_with_the_buckets(monkeypatch):
    monkeypatch.setattr(suffix, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    words = np.random.default_rng(5).integers(0, 10**6, 300).astype(str)
    texts = [" ".join(words[k * 10 :]) for k in range(20)]

    def met(n_buckets):
        # two batches, so that texts meet in the buckets too
        batches = [pa.record_batch([pa.array(range(k, 20, 2), pa.int64()), pa.array(texts[k::2])], names=["_key", "_text"]) for k in (0, 1)]
        marks = pa.Table.from_batches(suffix._marks(n_buckets)(iter(batches))).sort_by("bucket")
        return list(suffix._met(iter(marks.to_batches())))

    few, many = met(1), met(500)
    assert sum(b.num_rows for b in few) == sum(b.num_rows for b in many)
    table = pa.Table.from_batches(many).sort_by("_key")
    want = {(k, h, p) for b in few for k, h, p in zip(*(c.to_pylist() for c in b.columns))}
    assert set(zip(*(c.to_pylist() for c in table.columns))) == want
    # a text of many batches is one row
    for size in (1, 7, 10**6):
        rows = [r for b in suffix._by_text(iter(table.to_batches(size))) for r in b.to_pylist()]
        assert [r["_key"] for r in rows] == sorted({k for k, _, _ in want})
        got = {(r["_key"], h, p) for r in rows for h, p in zip(np.frombuffer(r["_hashes"], np.int64).tolist(), np.frombuffer(r["_places"], np.uint32).tolist(), strict=True)}
        assert got == want and sum(len(r["_places"]) // 4 for r in rows) == table.num_rows


def test_what_remains_of_a_text_is_not_shuffled(spark, tracks):
    got = suffix.remove_repeats(tracks)
    above = got._jdf.queryExecution().executedPlan().toString().split("_removed(")[0]
    assert "MapInArrow" in above and "Exchange" not in above
