"""The operators against brute force, round trips and held-out labels."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.llm import bytesets, chat, language, minhash, mixing, ngram, pii, queries, rules, suffix, winnow

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


# ---- language


def test_language_of_held_out_tracks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = queries.op1(spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out AND lang_pred <> 'und'")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_machines_are_the_same_each_time():
    rng = np.random.default_rng(1)
    x, y = rng.random((40, 8)).astype(np.float32), np.where(np.arange(40) % 2, 1, -1).astype(np.float32)
    x[y > 0, 0] += 1
    w, b = language.train_machine(x, y)
    assert ((x @ w + b > 0) == (y > 0)).mean() > 0.9
    assert (language.train_machine(x, y)[0] == w).all()


# ---- quality rules


def base_statistics(text):
    words = spaced(text)
    windows = list(zip(words, words[1:], words[2:]))
    often, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [line for line in text.split("\n") if spaced(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_statistics(spark, texts):
    got = queries.op2(spark, SF).collect()
    assert {r["doc_id"]: tuple(r[c] for c in rules.BASE) for r in got} == {d: base_statistics(t) for d, t in texts.items()}
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_rules_find_a_threshold(spark):
    rows = [(k, " ".join(["word"] + [f"w{k}x{i}" for i in range(60)] + [("#" if k % 4 == 0 else "n") * 5]), int(k % 4 > 0)) for k in range(400)]
    given = spark.createDataFrame(rows, "track_id long, title string, quality int")
    got = rules.apply_quality_rules(given, given).collect()
    assert {r["track_id"] for r in got if not r["kept"]} == {k for k in range(400) if k % 4 == 0}
    assert all((r["rule"] is None) == r["kept"] for r in got)


def test_rules_are_learned_from_few_labels(spark):
    """At sf0.01 some 27 labelled poor documents pass the base: they are caught, and no good one is lost."""
    sf = "/root/testdata/sf0.01"
    got = queries.op2(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("NOT base_failed").collect()
    poor, good = [r for r in got if r["quality"] == 0], [r for r in got if r["quality"] == 1]
    assert len(poor) > 20 and not any(r["kept"] for r in poor) and all(r["rule"] for r in poor)
    assert len(good) > 300 and all(r["kept"] for r in good)


def test_sure_precision():
    assert rules.sure_precision(0, 0) == 0 and rules.sure_precision(4, 0) < rules.LEAST_SURE < rules.sure_precision(5, 0)
    assert rules.sure_precision(700, 300) == pytest.approx(0.7, abs=0.03)


# ---- near-duplicates


def shingle_sets(texts):
    out = {}
    for d, t in texts.items():
        w = spaced(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        out[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute_components(texts):
    sets, parent = shingle_sets(texts), {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_chains_and_hot_groups_in_small_blocks(spark, monkeypatch):
    """Edits of edits: most pairs of a group aren't linked, and the blocks are far smaller than the group."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "FAMILY_BLOCK", 4)
    rng = random.Random(5)
    texts, last = {}, []
    for d in range(150):
        if d % 50 == 0:
            last = [[f"w{rng.randrange(10**6)}" for _ in range(60)]]
        words = list(rng.choice(last[-6:]))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"w{rng.randrange(10**6)}"
        last.append(words)
        texts[d * 7919 % 1009] = " ".join(words)
    rows = spark.createDataFrame(list(texts.items()), "track_id long, title string")
    got = {r["track_id"]: r["component_id"] for r in minhash.near_duplicates(rows).collect()}
    assert got == brute_components(texts)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 1400).astype(np.uint64)
    a, b = np.unique(pool[:1000]), np.unique(pool[400:])
    share = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(share - 600 / 1400) < 0.15
    assert (minhash.signature(a) == minhash.signature(a[::-1].copy())).all()


# ---- perplexity


def test_probabilities_sum_to_one(spark):
    given = spark.createDataFrame([("abracadabra",), ("a cab, a bar",), (None,), ("é",)], "_text string")
    probabilities, weights, alphabet = ngram.train(given)
    p = {r["gram"]: r["p"] for r in probabilities.collect()}
    back = {r["gram"]: r["back"] for r in weights.collect()}
    signs = [g for g in p if len(g) == 1]
    assert alphabet == len(signs) + 1

    def probability(history, sign):
        left = 1.0
        for k in range(len(history) + 1):
            if history[k:] + sign in p:
                return left * p[history[k:] + sign]
            left *= back.get(history[k:], 1.0)
        return left / alphabet

    for history in ("abra", "cada", "zzzz", "", " ca"):
        assert sum(probability(history, s) for s in [*signs, "?"]) == pytest.approx(1.0)


def test_shards_give_the_same_perplexity(spark, documents):
    given = documents.select(F.col("doc_id").alias("track_id"), F.col("text").alias("title"), "lang").limit(60)
    few = {r["track_id"]: r["perplexity"] for r in ngram.judge_perplexity(given, given, shard_rows=3000).collect()}
    one = {r["track_id"]: r["perplexity"] for r in ngram.judge_perplexity(given, given).collect()}
    assert few.keys() == one.keys() and all(few[k] == pytest.approx(one[k], rel=1e-5) for k in one)


# ---- suffixes


def test_suffix_order():
    rng = random.Random(3)
    for _ in range(150):
        top = 96 + rng.choice([1, 2, 3, 26])
        base = bytes(rng.randint(97, top) for _ in range(rng.randint(0, 200)))
        text = base + bytes(rng.randint(97, top) for _ in range(rng.randint(0, 80))) + base
        order = suffix.sort_suffixes(np.frombuffer(text, np.uint8).astype(np.int64) + 1).tolist()
        assert sorted(order) == list(range(len(text)))
        heads = [text[k : k + 50] for k in order]
        assert heads == sorted(heads)


def test_every_fifty_bytes_hold_a_common_fingerprint():
    rng = random.Random(4)
    for _ in range(300):
        top = 96 + rng.choice([1, 2, 26])
        shared = bytes(rng.randint(97, top) for _ in range(50))
        found = []
        for _ in range(2):
            around = [bytes(rng.randint(97, top) for _ in range(rng.randint(0, 70))) for _ in range(2)]
            hashes, places = suffix.fingerprints(np.frombuffer(around[0] + shared + around[1], np.uint8))
            at = len(around[0])
            found.append(set(hashes[(places >= at) & (places <= at + 50 - suffix.GRAM)].tolist()))
        assert found[0] & found[1]


@pytest.mark.parametrize("rows_of_a_shard", [4096, 3])
def test_removed_bytes(spark, texts, monkeypatch, rows_of_a_shard):
    monkeypatch.setattr(suffix, "SHARD_ROWS", rows_of_a_shard)
    raw = {d: t.encode() for d, t in texts.items()}
    first = {}
    for d in sorted(raw):
        for k in range(len(raw[d]) - 49):
            first.setdefault(raw[d][k : k + 50], d)
    want = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < d:
                gone[k : k + 50] = b"\1" * 50
        left = bytes(x for x, g in zip(b, gone) if not g)
        want[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest())
    got = {r["doc_id"]: tuple(r[1:]) for r in queries.op6(spark, SF).collect()}
    assert got == want


# ---- mixture


def test_totals_match_targets(spark):
    got = queries.op7(spark, SF)
    n, rate = F.col("n_tokens"), F.col("rate")
    sums = got.agg(F.sum(n).alias("n"), *(F.sum(n * rate * F.col(f"p_{d}")).alias(d) for d in queries.MIXTURE)).first()
    for domain, share in queries.MIXTURE.items():
        assert sums[domain] == pytest.approx(share * sums["n"], rel=1e-3)
    assert got.filter("rate < 0 OR rate IS NULL").count() == 0


def test_targets_out_of_reach_give_the_nearest_rates(spark):
    table = spark.createDataFrame([(10, 1.0, 0.0), (10, 0.5, 0.5)], "n_tokens long, _p0 double, _p1 double")
    rates = [r[0] for r in table.select(mixing.fit_rates(table, [0.0, 10.0])).collect()]
    assert rates[0] == pytest.approx(0.0, abs=1e-6) and rates[1] > 0


def test_posteriors_are_those_of_naive_bayes(spark):
    rows = [(1, "a a b c"), (2, "b b d"), (3, "c d d d e"), (4, "x y"), (5, ""), (6, "A b " * 90)]
    labels = [(1, "rock"), (2, "jazz"), (3, "jazz"), (4, "zydeco"), (4, "rock")]
    got = {r["track_id"]: r["posterior"] for r in mixing.mix_to_targets(
        spark.createDataFrame(rows, "track_id long, title string"), spark.createDataFrame(labels, "track_id long, genre_top string"), {"rock": 0.5, "jazz": 0.5}
    ).collect()}
    words = {d: [w for i, t in rows for w in t.lower().split() for j, g in labels if i == j and g == d] for d in ("rock", "jazz")}
    known = set(words["rock"]) | set(words["jazz"])
    for i, t in rows:
        own = t.lower().split()
        score = {d: sum(np.log((words[d].count(w) + 1) / (len(words[d]) + mixing.BUCKETS)) for w in own if w in known) for d in words}
        share = min(mixing.EVIDENCE, len(own)) / max(1, len(own))
        top = max(score.values())
        raised = {d: np.exp((v - top) * share) for d, v in score.items()}
        assert got[i] == pytest.approx({d: v / sum(raised.values()) for d, v in raised.items()}, abs=1e-9)


@pytest.mark.parametrize("share", [0.1, 0.02, 0.002])
def test_hard_cuts_of_soft_domains_match(spark, share):
    part = (F.col("id") + 0.5) / 1000
    table = spark.range(1000).select(F.lit(10).alias("n_tokens"), part.alias("_p0"), (1 - part).alias("_p1")).cache()
    rate = mixing.fit_rates(table, [10000 * share, 10000 * (1 - share)])
    got = table.agg(F.sum(rate * F.col("n_tokens") * F.col("_p0")), F.sum(rate * F.col("n_tokens") * F.col("_p1")), F.min(rate)).first()
    assert list(got)[:2] == pytest.approx([10000 * share, 10000 * (1 - share)], abs=0.2) and got[2] >= 0


def test_a_miss_is_told(spark):
    table = spark.createDataFrame([(10, 0.8, 0.2), (10, 0.2, 0.8), (0, 0.0, 1.0)], "n_tokens long, _p0 double, _p1 double")
    with pytest.warns(UserWarning, match="miss the target tokens"):
        mixing.fit_rates(table, [1.0, 19.0])


# ---- winnowing


def test_shared_spans_share_a_fingerprint():
    rng = np.random.default_rng(6)
    for _ in range(200):
        shared = rng.integers(0, 4, 13).astype(np.uint64)
        kept = []
        for _ in range(2):
            around = [rng.integers(0, 4, rng.integers(0, 20)).astype(np.uint64) for _ in range(2)]
            words = np.concatenate([around[0], shared, around[1]])
            grams = bytesets.combine(words, np.arange(len(words) - winnow.GRAM + 1), winnow.GRAM)
            at = winnow.keep_minima(grams, np.zeros(len(grams), int), winnow.SPAN - winnow.GRAM + 1)
            lo = len(around[0])
            kept.append(set(grams[at[(at >= lo) & (at <= lo + 13 - winnow.GRAM)]].tolist()))
        assert kept[0] & kept[1]


# ---- chat


def test_formatted_text_reads_back():
    render, rng = chat.compile_template(chat.TEMPLATE), random.Random(0)
    bits = ["\\", "#", "##", "###", " ", "</turn>", "</turn>\n", "### Assistant: ", "a", ": ", "\n", "<", "/", "é"]
    for _ in range(3000):
        roles = ["user", "assistant", "system", "tool", "User", "x: y", "a\\###", ": ", ""]
        turns = [(rng.choice(roles), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(1, 4))]
        pieces = list(render(chat._turns([(0, k, role, text) for k, (role, text) in enumerate(turns)])))
        n, digest, chars, loss, size = chat._digest(pieces)
        learned = "".join(text for role, text in turns if role == "assistant")
        assert (n, chars, size) == (len(turns), len(learned), sum(len(p) for p, _ in pieces))
        assert digest == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert loss == hashlib.sha256(learned.encode()).hexdigest() and chat.loss_text(pieces) == learned


def test_constants_fold():
    tree = chat.fold(chat.parse("{% if 'a' == 'a' and not false %}x{{ 'y' + 'z' | upper }}{% elif b %}n{% endif %}{# c #}w"))
    assert tree == chat.Block((chat.Write(chat.Constant("xyZw")),))
    pieces = chat.compile_template("{% for t in turns %}{% if loop.last %}!{% else %}{{ t.text }}{% endif %}{% endfor %}")([{"text": "a"}, {"text": "b"}])
    assert "".join(p for p, _ in pieces) == "a!"


@pytest.mark.parametrize("bad", ["{{ a.b.c }}", "{{ f(1) }}", "{% endif %}", "{% import os %}", "{{ 'a }}", "{{ a | exec }}", "{% if a %}"])
def test_what_the_sandbox_refuses(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)


# ---- personal data


def base_spans(text):
    out = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(part) <= 255 for part in m[0].split(".")):
            out.append((m.start(), "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(digits[::-1]))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[1])))


def test_base_kinds(spark, texts):
    rng = random.Random(1)
    for _ in range(20000):
        text = "".join(rng.choice("0123456789@..++ -()a1b9%") for _ in range(rng.randint(0, 60)))
        assert [s for s in pii.find_spans(text) if s[1] in pii.BASE] == base_spans(text)
    got = {r["doc_id"]: r["base_sha256"] for r in queries.op10(spark, SF).collect()}
    assert got == {d: hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in base_spans(t)).encode()).hexdigest() for d, t in texts.items()}


def test_added_kinds_and_masks():
    text = "IBAN: DE89 3704 0044 0532 0130 00 and acct no. 123-456-789, see http://u:p@h.com/x?q=1. Token of love; call +1 (017) 555-7713!"
    assert [(k, text[a:b]) for a, k, b in pii.find_spans(text)] == [
        ("account", "DE89 3704 0044 0532 0130 00"), ("account", "123-456-789"), ("url", "http://u:p@h.com/x?q=1"), ("email", "p@h.com"),
        ("phone", "+1 (017) 555-7713"),
    ]
    assert pii.mask(text, pii.find_spans(text)).endswith("Token of love; call <PHONE>!")


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ('{"token": "abcd1234efgh5678"}', "secret", "abcd1234efgh5678"),
        ("{'password' : 'hunter2hunter2hunter2'}", "secret", "hunter2hunter2hunter2"),
        ("API Key: abcd1234efgh5678", "secret", "abcd1234efgh5678"),
        ("apiKey=abcd1234efgh5678;", "secret", "abcd1234efgh5678"),
        ("the ApI_kEy is API-KEY = x9x9x9x9x9x9", "secret", "x9x9x9x9x9x9"),
        ("Social Security number 123-45-6789", "account", "123-45-6789"),
        ("SOCIAL SECURITY NO. 123-45-6789", "account", "123-45-6789"),
        ('token = "' + "a1b2" * 200 + '"', "secret", "a1b2" * 200),
        ("Account ID: 00112233", "account", "00112233"),
        ("İİ Token: abcd1234efgh5678", "secret", "abcd1234efgh5678"),
    ],
)
def test_spellings_of_cues(text, kind, value):
    assert [(k, text[a:b]) for a, k, b in pii.find_spans(text)] == [(kind, value)]


@pytest.mark.parametrize("text", ["token 1/" * 50_000, "account 1 2 3 4 5 6 " * 20_000, "token=" * 50_000, "Token: a-" * 50_000, "1" * 200_000, "a" * 200_000 + "@", "+1" + "(" * 200_000, "1.2.3." * 60_000, "a@b" * 60_000, "1 " * 100_000])
def test_awkward_texts_take_linear_time(text):
    pii.find_spans(text)


# ---- pipeline


def test_pipeline_stages_do_their_work(spark, texts):
    import corpus_pipeline

    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name != "mixture":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "personal_data":
            for r in docs.collect():
                want = pii.mask(texts[r["doc_id"]], pii.find_spans(texts[r["doc_id"]]))
                assert (r["text"], r["n_chars"]) == (want, len(want))
    assert kept[0] == {d for d in texts if re.search(r"[^\W\d_]", texts[d])}
    assert kept[1] == {d for d, c in brute_components({d: texts[d] for d in kept[0]}).items() if d == c}
    items = [
        re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    ]
    windows = {tuple(w[k : k + 13]) for w in items for k in range(max(1, len(w) - 12)) if w}
    clean = set()
    for d in kept[1]:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[d]))
        hit = {j for k in range(len(w)) for n in (13,) if tuple(w[k : k + n]) in windows for j in range(k, k + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean.add(d)
    assert kept[2] == kept[3] == kept[4] == clean
