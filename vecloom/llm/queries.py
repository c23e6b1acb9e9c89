"""The queries of the numbered operators: the given tables in, digest columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import chat, fixity, language, manifest, minhash, mixing, negatives, ngram, packing, pii, rules, suffix, winnow
from vecloom.llm.lookup import rows_of
from vecloom.plans.registry import table
from vecloom.session import materialize

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def tracks(documents: DataFrame, *others: str) -> DataFrame:
    """Documents as track records: their text stands for the title."""
    return documents.select(F.col("doc_id").alias("track_id"), F.col("text").alias("title"), *others)


@query(
    "op8_decontaminate",
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
       FROM b, range(1, len(w) - least(13, len(w)) + 2) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM d, sizes, range(1, len(w) - n + 2) AS r(i) WHERE len(w) >= n),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hits), range(0, 13) AS s(k)
            WHERE k < n GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    items = benchmark.select(F.col("item_id").alias("track_id"), F.col("text").alias("title"))
    marked = winnow.mark_contamination(tracks(documents), items)
    listed = F.array_join(F.array_sort(F.transform("hit_items", lambda x: x.cast("string"))), ",")
    return marked.select(
        F.col("track_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        "contaminated",
    )


@query(
    "op3_near_duplicates",
    r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x{20}\x{09}-\x{0D}]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM w, range(1, greatest(len(w) - 4, least(len(w), 1)) + 1) AS r(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id
          JOIN n nb ON nb.doc_id = b.doc_id GROUP BY 1, 2, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)
""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = minhash.near_duplicates(tracks(table(spark, sf_dir, "documents")))
    return groups.withColumnRenamed("track_id", "doc_id")


@query("op10_personal_data")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(tracks(table(spark, sf_dir, "documents")))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [number(kind).alias(f"n_{kind}") for kind in pii.BASE]
    return found.select(
        F.col("track_id").alias("doc_id"), *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


@query("op1_language")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    found = language.identify_language(tracks(documents), tracks(documents.filter(~held_out), "lang"))
    return found.select(
        F.col("track_id").alias("doc_id"),
        (F.crc32(F.col("track_id").cast("string").cast("binary")) % 3 == 1).alias("held_out"),
        "lang_pred",
        "score",
    )


#: shares of the label classes in the mixture
MIXTURE = {"good": 0.85, "poor": 0.13, "toxic": 0.02}


def label_domains(labels: DataFrame) -> DataFrame:
    """Labels as track records: toxic, else good or poor by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select(F.col("doc_id").alias("track_id"), domain.alias("genre_top"))


def mixture(documents: DataFrame, labels: DataFrame) -> DataFrame:
    mixed = mixing.mix_to_targets(tracks(documents), label_domains(labels), MIXTURE)
    shares = [F.col("posterior")[d].alias(f"p_{d}") for d in MIXTURE]
    return mixed.select(F.col("track_id").alias("doc_id"), "n_tokens", *shares, "rate")


@query("op7_mixture")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("track_id"), "quality")
    return rules.apply_quality_rules(tracks(table(spark, sf_dir, "documents")), labels).withColumnRenamed("track_id", "doc_id")


_AWKWARD = r"\### Assistant: </turn> ok"


@query(
    "op9_chat_format",
    rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{_AWKWARD}' UNION ALL SELECT -7, 1, 'assistant', '{_AWKWARD}'),
sizes AS (SELECT *, CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role) ELSE 2 * length(role) END
            + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</', '\</')) + length('### : </turn>') + 1 AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sizes GROUP BY conv_id
""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", _AWKWARD), (-7, 1, "assistant", _AWKWARD)], given.schema)
    return chat.read_back(chat.format_conversations(given.unionByName(added)))


@query("op4_perplexity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = tracks(table(spark, sf_dir, "documents"), "lang")
    good = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select(F.col("doc_id").alias("track_id"))
    judged = ngram.judge_perplexity(documents, rows_of(documents, good, "track_id"))
    return judged.withColumnRenamed("track_id", "doc_id")


@query("op6_remove_repeats")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix.remove_repeats(tracks(table(spark, sf_dir, "documents")))
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return left.select(
        F.col("track_id").alias("doc_id"), "n_bytes", lost.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256"
    )


@query(
    "op5_fixity",
    r"""
WITH p AS (SELECT page_id, CAST('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 8) AS BIGINT)
             % greatest(1, (SELECT (count(*) + 9999) // 10000 FROM pages)) AS volume, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
r AS (SELECT *, CAST(strlen('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
        || 'Content-Type: application/octet-stream' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10)
        || html || chr(13) || chr(10) || chr(13) || chr(10)) AS BIGINT) AS length FROM p),
o AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY volume ORDER BY page_id NULLS FIRST, url, html
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM r)
SELECT page_id, volume, "offset", length, CASE WHEN page_id % 97 = 13 THEN 'missing' ELSE 'changed' END AS kind
FROM o WHERE page_id % 97 = 13 OR page_id % 89 = 7
""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files, against a replica in which some records are lost and some have one more byte."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("track_id"), F.col("url").alias("path"), F.col("html").alias("content"))
    packed = materialize(fixity.pack_records(pages), "warc")
    lost, damaged = F.col("track_id") % 97 == 13, F.col("track_id") % 89 == 7
    replica = packed.filter(~F.coalesce(lost, F.lit(False))).withColumn(
        "record", F.when(damaged, F.concat("record", F.lit(b"x"))).otherwise(F.col("record"))
    )
    return fixity.audit_fixity(packed, replica).withColumnRenamed("track_id", "page_id")


@query(
    "op11_hard_negatives",
    r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) <= 10
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    genre = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    store = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track_id"), "embedding", genre.alias("genre"))
    return negatives.mine_hard_negatives(store, F.col("track_id") % 100 == 0)


#: id that follows each document, and ids that a sequence holds
END_ID, SEQUENCE_IDS = 2, 1024


@query("op12_best_fit")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack_best_fit(tracks(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.json"), END_ID, capacity=SEQUENCE_IDS)
    return packed.select(F.col("track_id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


_LEAF = "sha256(" + " || ".join(
    f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "{n}", "text")
) + ")"


# CRC-32 of a decimal number: its signs one after the other, eight shifts each
_CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""


@query(
    "op13_manifest",
    rf"""
WITH RECURSIVE leaves AS (SELECT doc_id, lang, {_LEAF.format(n="n_chars")} AS leaf, CASE WHEN crc % 7 = 0 THEN {_LEAF.format(n="(n_chars + 1)")} ELSE {_LEAF.format(n="n_chars")} END AS now,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM (SELECT *, {_CRC} AS crc FROM documents)),
tree(level, lang, pos, hash, n) AS (SELECT 0, lang, pos, leaf, n FROM leaves
    UNION ALL SELECT level + 1, lang, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY level, lang, pos // 2, n),
subroots AS (SELECT lang, hash AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
upper_tree(level, pos, hash, n) AS (SELECT 0, pos, subroot, n FROM subroots
    UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), (n + 1) // 2 FROM upper_tree WHERE n > 1 GROUP BY level, pos // 2, n),
low_steps AS (SELECT l.doc_id, l.lang, v.level AS depth, (l.pos >> v.level) & 1 AS odd, t.hash FROM leaves l
    JOIN (SELECT DISTINCT lang, level FROM tree WHERE n > 1) v ON l.lang IS NOT DISTINCT FROM v.lang
    LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM l.lang AND t.level = v.level AND t.pos = xor(l.pos >> v.level, 1)),
high_steps AS (SELECT s.lang, 1000 + v.level AS depth, (s.pos >> v.level) & 1 AS odd, t.hash FROM subroots s
    CROSS JOIN (SELECT DISTINCT level FROM upper_tree WHERE n > 1) v LEFT JOIN upper_tree t ON t.level = v.level AND t.pos = xor(s.pos >> v.level, 1)),
steps AS (SELECT doc_id, depth, odd, hash FROM low_steps UNION ALL SELECT l.doc_id, h.depth, h.odd, h.hash FROM leaves l JOIN high_steps h ON l.lang IS NOT DISTINCT FROM h.lang),
paths AS (SELECT doc_id, sha256(coalesce(string_agg(hash, '' ORDER BY depth), '')) AS proof_sha256,
    list(CASE WHEN hash IS NULL THEN '=' WHEN odd = 1 THEN 'l' || hash ELSE 'r' || hash END ORDER BY depth) AS way FROM steps GROUP BY doc_id),
folded AS (SELECT l.*, coalesce(proof_sha256, sha256('')) AS proof_sha256, list_reduce(list_concat(['n' || now], coalesce(way, [])), lambda a, s:
    'n' || sha256(CASE s[1] WHEN 'l' THEN s[2:] || a[2:] WHEN 'r' THEN a[2:] || s[2:] ELSE a[2:] END))[2:] AS folded_root FROM leaves l LEFT JOIN paths USING (doc_id))
SELECT f.doc_id, f.leaf, s.subroot, r.hash AS root, f.proof_sha256, f.folded_root, f.folded_root = r.hash AS verified
FROM folded f JOIN subroots s ON f.lang IS NOT DISTINCT FROM s.lang CROSS JOIN (SELECT hash FROM upper_tree WHERE n = 1) r
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against their own manifest, after some have had one added to ``n_chars``."""
    documents = table(spark, sf_dir, "documents")
    described = {"id_col": "doc_id", "group_col": "lang", "fields": ("doc_id", "source", "lang", "n_chars", "text")}
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = documents.withColumn("n_chars", F.when(changed, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    checked = manifest.verify_rows(manifest.merkle_manifest(documents, **described), tampered, **described)
    siblings = F.transform(F.filter("siblings", lambda s: s["hash"].isNotNull()), lambda s: s["hash"])
    proof = F.sha2(F.array_join(siblings, ""), 256)
    return checked.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")
