"""The queries of this subpackage: name, callable and, where SQL can say it, the SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm import (
    bpe,
    covertree,
    decontamination,
    linkgraph,
    mixing,
    negatives,
    quality,
    repeats,
    sharding,
    simhash,
    spelling,
    tokenstore,
    toxicity,
)

# Target weights of languages; domains and sources weigh 1 each.
WEIGHTS = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}

# Fixed values of the contract: host, path prefix, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict of every document; trusted are those labelled quality 1."""
    docs = _table(spark, sf_dir, "documents")
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.judge(docs, quality.ratios(docs, trusted))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the public multilingual ranks, and the text they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks).select(
        "doc_id",
        F.expr("length(ids) DIV 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned outside the held-out third."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        F.coalesce(toxicity.remainder() == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at a cosine of 0.98 or more."""
    return covertree.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to a store and read back through its index."""
    docs = _table(spark, sf_dir, "documents")
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        store = tokenstore.write_store(docs, file.read(), vocabulary=49_408, end_id=2)
    found = tokenstore.read_ids(spark, store, docs.select("doc_id"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    found = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict for every page."""
    judged = linkgraph.judge_pages(_table(spark, sf_dir, "pages"), RULES)
    return judged.drop("trust", "distrust")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are taken how often, so that languages and sources meet their weights."""
    return mixing.select_mix(_table(spark, sf_dir, "documents"), WEIGHTS)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that no earlier document's passage covers."""
    return repeats.find_repeats(_table(spark, sf_dir, "documents")).drop("kept", "mark")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh takes the next label first."""
    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of the corpus."""
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and benchmark items that every document has in common with the benchmark."""
    found = decontamination.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _mix_level(level: str, path: str, above: str) -> str:
    """One level of the budget tree: children of `path` share what their parent was given."""
    keys = f"{path}, {level}" if path else level
    by = f"PARTITION BY {path}" if path else ""
    names = " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in WEIGHTS.items())
    return f"""
    {level}_nodes AS (
        SELECT {keys}, sum(2 * tokens) AS held, CAST(CASE {names} ELSE 1 END AS DOUBLE) AS weight
        FROM leaf GROUP BY {keys}),
    {level}_ranked AS (
        SELECT *,
            coalesce(sum(held) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
            sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unfilled
        FROM {level}_nodes JOIN {above} {f"USING ({path})" if path else "ON true"}
        WINDOW w AS ({by} ORDER BY held / weight, {keys})),
    {level}_told AS (
        SELECT *, greatest(0, given - filled) / unfilled AS level FROM {level}_ranked),
    {level}_given AS (
        SELECT {keys}, CASE WHEN held <= level * weight THEN CAST(held AS DOUBLE) ELSE weight * coalesce(
            min(CASE WHEN held > level * weight THEN {{'f': filled, 'u': unfilled, 'l': level}} END) OVER ({by}).l, 0)
            END AS given
        FROM {level}_told)"""


MIX_SQL = f"""
WITH numbered AS (
    SELECT *, regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS n FROM documents),
d AS (
    SELECT doc_id, CASE WHEN n = '' THEN 'other' ELSE 'domain' || (CAST(n AS INT) // 5) END AS domain,
        coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
        CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens
    FROM numbered),
leaf AS (
    SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),
root AS (SELECT CAST(sum(tokens) AS DOUBLE) AS given FROM leaf),
{_mix_level("domain", "", "root")},
{_mix_level("lang", "domain", "domain_given")},
{_mix_level("source", "domain, lang", "lang_given")},
plan AS (
    SELECT domain, lang, source, tokens, CAST(floor(given + 1e-6) AS BIGINT) AS leaf_budget,
        CASE WHEN tokens > 0 THEN CAST(floor(given + 1e-6) AS BIGINT) // tokens ELSE 1 END AS epochs
    FROM leaf JOIN source_given USING (domain, lang, source)),
placed AS (
    SELECT d.*, epochs, leaf_budget, leaf_budget - epochs * tokens AS rest,
        sum(n_tokens) OVER (PARTITION BY domain, lang, source
            ORDER BY md5('7/' || epochs || '/' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, n_tokens
            ROWS UNBOUNDED PRECEDING) AS upto
    FROM d JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(epochs)) AS INT) AS epoch, leaf_budget FROM placed
UNION ALL
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs AS INT), leaf_budget FROM placed WHERE rest > 0 AND upto <= rest
"""

def _url_sql() -> str:
    fits = lambda h, p: f"(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')"
    longest = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in longest)
    said = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in longest)
    host = lambda rest: (
        f"coalesce(translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{linkgraph.UPPER}', '{linkgraph.LOWER}'), '')"
    )
    patterns = [x.replace("'", "''") for x in (linkgraph.QUOTED, linkgraph.BARE)]
    found = ", ".join(f"regexp_extract_all(html, '{x}', 1)" for x in patterns)
    every = linkgraph.CUT_EVERY
    walks = []
    for name, seed, source, target in (("trust", "allow", "source", "target"), ("distrust", "block", "target", "source")):
        # What each round adds; the rounds counted end where the operator ends them.
        walks.append(f"""
    {name}_seed AS (
        SELECT host, count(*) FILTER (said = '{seed}') / CAST(count(*) AS DOUBLE) AS mass
        FROM judged GROUP BY host HAVING mass > 0),
    {name}_part AS (
        SELECT {source} AS s, {target} AS t, links / sum(links) OVER (PARTITION BY {source}) AS part FROM links),
    {name}_added AS (
        SELECT 0 AS round, host, mass FROM {name}_seed
        UNION ALL
        SELECT round + 1, t, sum(mass * part * {linkgraph.DAMPING})
        FROM (SELECT *, sum(mass) OVER () AS whole FROM {name}_added) JOIN {name}_part ON host = s
        WHERE whole > {linkgraph.TOLERANCE / 1000} GROUP BY ALL),
    {name}_block AS (
        SELECT (round + {every - 1}) // {every} AS block, sum(mass) AS mass FROM {name}_added WHERE round > 0 GROUP BY ALL),
    {name} AS (
        SELECT host, sum(mass) AS mass FROM {name}_added WHERE round <= {every} * coalesce(
            (SELECT min(block) FROM {name}_block WHERE mass < {linkgraph.TOLERANCE}), 1_000_000) GROUP BY host)""")
    return f"""
WITH RECURSIVE rests AS (
    SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
placed AS (
    SELECT page_id, html, {host("rest")} AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rests),
judged AS (
    SELECT page_id, host, path, CASE {rule} END AS rule, CASE {said} END AS said FROM placed),
found AS (
    SELECT host AS source, unnest(list_concat({found})) AS link FROM placed),
whole AS (SELECT source, CASE WHEN starts_with(link, '//') THEN 'same:' || link ELSE link END AS link FROM found),
links AS (
    SELECT source, target, count(*) AS links FROM (
        SELECT source, {host("substr(link, instr(link, '://') + 3)")} AS target FROM whole)
    WHERE source <> target AND source <> '' AND target <> '' GROUP BY ALL),
{",".join(walks)}
SELECT page_id, j.host, path, rule, coalesce(said, CASE
    WHEN round(coalesce(b.mass, 0) - coalesce(a.mass, 0), {linkgraph.DIGITS}) > {linkgraph.LIMIT}
    THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN trust a ON a.host = j.host LEFT JOIN distrust b ON b.host = j.host
"""


EMBEDDING_SQL = """
WITH RECURSIVE sound AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
        ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
found AS (
    SELECT vec_id,
        (SELECT count(*) FROM links WHERE a = vec_id) AS n_links,
        least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id
    FROM embeddings)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM found
"""

REPEATS_SQL = """
WITH d AS (
    SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents),
windows AS (
    SELECT doc_id, k, sha256(array_to_string(words[k:k + 12], ' ')) AS w
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS k FROM d)),
firsts AS (SELECT w, min(doc_id) AS doc_id FROM windows GROUP BY w),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS k
    FROM (SELECT a.doc_id, a.k FROM windows a JOIN firsts b ON a.w = b.w AND a.doc_id > b.doc_id)),
left_over AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS n
    FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM d) ANTI JOIN gone USING (doc_id, k)
    GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)
"""

NEGATIVES_SQL = """
WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""

SPELLING_SQL = f"""
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8),
        lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
runs AS (
    SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{linkgraph.UPPER}', '{linkgraph.LOWER}') AS run
        FROM documents)
    GROUP BY ALL),
hashed AS (
    SELECT run, n, xor(4294967295, list_reduce(
        flatten(list_transform(regexp_extract_all(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, '.'),
            lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 + (ord(c) >> 6), 128 + (ord(c) & 63)] END)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) AS h
    FROM runs, crc),
words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
            ELSE run END AS word, n FROM hashed)
    GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
cut AS (
    SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
    SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, v.word, v.n FROM cut a JOIN words v ON a.rest = v.word
    UNION SELECT v.word, a.word, a.n FROM cut a JOIN words v ON a.rest = v.word),
best AS (
    SELECT word, other, n AS other_n, count(*) OVER (PARTITION BY word) AS n_near
    FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1),
placed AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form,
        CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
    FROM words LEFT JOIN best USING (word)),
walk AS (
    SELECT word, word AS root FROM words
    UNION ALL SELECT walk.word, placed.form FROM walk JOIN placed ON walk.root = placed.word WHERE placed.form IS NOT NULL)
SELECT placed.word, placed.form, walk.root, placed.n, placed.n_near, placed.form_n
FROM placed JOIN walk USING (word) JOIN placed ends ON ends.word = walk.root WHERE ends.form IS NULL
"""

_PLAIN_WORDS = f"""coalesce(regexp_extract_all(translate(text, '{linkgraph.UPPER}', '{linkgraph.LOWER}'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"""

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN_WORDS} AS w FROM documents),
items AS (SELECT item_id, w, least(10, len(w)) AS z FROM (SELECT item_id, {_PLAIN_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
grams AS (
    SELECT DISTINCT item_id, z, array_to_string(w[k:k + z - 1], ' ') AS g
    FROM (SELECT *, unnest(range(1, len(w) - z + 2)) AS k FROM items)),
windows AS (
    SELECT r, k, z, array_to_string(w[k:k + z - 1], ' ') AS g
    FROM (SELECT r, w, z, unnest(range(1, len(w) - z + 2)) AS k FROM d JOIN (SELECT DISTINCT z FROM grams) ON len(w) >= z)),
hits AS (SELECT r, k, z, item_id FROM windows JOIN grams USING (z, g)),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + z)) AS p FROM hits) GROUP BY r),
hit_items AS (
    SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_token_store": op5_token_store,
    "op6_sharding": op6_sharding,
    "op7_simhash": op7_simhash,
    "op8_url_filters": op8_url_filters,
    "op9_mixing": op9_mixing,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_decontamination": op13_decontamination,
}

SQL = {
    "op4_embedding_dedup": EMBEDDING_SQL,
    "op8_url_filters": _url_sql(),
    "op9_mixing": MIX_SQL,
    "op10_substring_dedup": REPEATS_SQL,
    "op11_hard_negatives": NEGATIVES_SQL,
    "op12_spelling_variants": SPELLING_SQL,
    "op13_decontamination": DECONTAMINATION_SQL,
}
