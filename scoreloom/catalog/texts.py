"""Queries of the text operators over whole documents and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.catalog import twins
from scoreloom.catalog.registry import query, rounded, rounded_sql
from scoreloom.functions import coverage, overlap, registry, rouge, sentences, text
from scoreloom.functions.quality import score_pairs
from scoreloom.functions.vocabulary import stemmed_by_vocabulary
from scoreloom.schemas import CRM_COLUMNS, WORF_COLUMNS
from scoreloom.sources.tables import text_pairs, text_sides

def _pred() -> Column:
    return F.col("response")


def _ref() -> Column:
    return F.col("ground_truth")


def _text() -> Column:
    return F.col("text")


def _sides(spark, sf_dir, column: Column) -> DataFrame:
    return text_sides(spark, sf_dir).select("sample_id", "side", column)


def _keyed(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    return rounded(df.select("sample_id", *(c.alias(n) for n, c in metrics.items())))


def _tokenised(spark, sf_dir) -> DataFrame:
    return text_pairs(spark, sf_dir).select(
        "sample_id",
        text.normalized_tokens(text.normalize_text(_pred())).alias("p"),
        text.normalized_tokens(text.normalize_text(_ref())).alias("r"),
    )


def _counted(spark, sf_dir, count) -> DataFrame:
    return _tokenised(spark, sf_dir).select("sample_id", count("p", "r").alias("counts"))


_TOKENISED = f"""{twins.PAIRS},
tokenised AS (SELECT sample_id, {twins.tokens_sql("response")} AS p,
                     {twins.tokens_sql("ground_truth")} AS r FROM pairs)"""
_GRAMMED = f"""{twins.PAIRS},
grammed AS (SELECT sample_id, {twins.words_sql(twins.rouge_text_sql("response"))} AS p,
                   {twins.words_sql(twins.rouge_text_sql("ground_truth"))} AS r FROM pairs),
doubled AS (SELECT sample_id,
    list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1]) AS p,
    list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1]) AS r FROM grammed)"""


def _f_sql(shared: str, predicted: str, expected: str) -> str:
    p = f"({shared} / CAST(greatest({predicted}, 1) AS DOUBLE))"
    r = f"({shared} / CAST(greatest({expected}, 1) AS DOUBLE))"
    return f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0::DOUBLE END"


@query(
    "normalize_text",
    f"WITH {twins.SIDES} SELECT sample_id, side, {twins.normalize_sql('text')} AS normalized FROM sides",
)
def normalize_text(spark, sf_dir):
    return _sides(spark, sf_dir, text.normalize_text(_text()).alias("normalized"))


@query(
    "exact_match",
    f"""WITH {twins.PAIRS} SELECT sample_id,
    CAST({twins.normalize_sql('response')} = {twins.normalize_sql('ground_truth')} AS DOUBLE) AS exact_match
    FROM pairs""",
)
def exact_match(spark, sf_dir):
    normalized = text_pairs(spark, sf_dir).select(
        "sample_id",
        text.normalize_text(_pred()).alias("p"),
        text.normalize_text(_ref()).alias("r"),
    )
    return _keyed(normalized, {"exact_match": overlap.exact_match("p", "r")})


@query(
    "token_overlap",
    rounded_sql(
        f"""WITH {_TOKENISED},
        sizes AS (SELECT sample_id, len(list_intersect(list_distinct(p), list_distinct(r))) AS s,
                         len(list_distinct(p)) AS np, len(list_distinct(r)) AS nr FROM tokenised),
        pr AS (SELECT sample_id, {twins.ratio_sql('s', 'np')} AS precision,
                      {twins.ratio_sql('s', 'nr')} AS recall FROM sizes)
        SELECT *, CASE WHEN precision + recall > 0
                       THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1
        FROM pr""",
        "precision recall f1",
    ),
)
def token_overlap(spark, sf_dir):
    return _keyed(_counted(spark, sf_dir, overlap.set_counts), overlap.token_overlap("counts"))


@query(
    "semantic_similarity",
    rounded_sql(
        f"""WITH {_TOKENISED}, {twins.multiset_sql('common', 'tokenised', 'p', 'r')}
        SELECT sample_id, CASE WHEN len(p) > 0 AND len(r) > 0
          THEN coalesce(shared, 0) / sqrt(CAST(len(p) AS DOUBLE) * len(r)) ELSE 0.0::DOUBLE END AS semantic_similarity
        FROM tokenised LEFT JOIN common USING (sample_id)""",
        "semantic_similarity",
    ),
)
def semantic_similarity(spark, sf_dir):
    score = overlap.semantic_similarity("counts")
    return _keyed(_counted(spark, sf_dir, overlap.copy_counts), {"semantic_similarity": score})


@query(
    "rouge_tokens",
    f"WITH {twins.SIDES} SELECT sample_id, side, {twins.rouge_text_sql('text')} AS rouge_text FROM sides",
)
def rouge_tokens(spark, sf_dir):
    return _sides(spark, sf_dir, F.array_join(text.rouge_tokens(_text()), " ").alias("rouge_text"))


@query(
    "rouge_n",
    rounded_sql(
        f"""WITH {_GRAMMED}, {twins.multiset_sql('ones', 'grammed', 'p', 'r')},
        {twins.multiset_sql('twos', 'doubled', 'p', 'r')}
        SELECT g.sample_id, {_f_sql('coalesce(ones.shared, 0)', 'len(g.p)', 'len(g.r)')} AS rouge_1,
          {_f_sql('coalesce(twos.shared, 0)', 'len(d.p)', 'len(d.r)')} AS rouge_2
        FROM grammed g JOIN doubled d USING (sample_id)
        LEFT JOIN ones USING (sample_id) LEFT JOIN twos USING (sample_id)""",
        "rouge_1 rouge_2",
    ),
)
def rouge_n(spark, sf_dir):
    pairs = text_pairs(spark, sf_dir).select(
        "sample_id", text.rouge_tokens(_pred()).alias("p"), text.rouge_tokens(_ref()).alias("r")
    )
    counted = pairs.select(
        "sample_id",
        overlap.gram_counts("p", "r", 1).alias("ones"),
        overlap.gram_counts("p", "r", 2).alias("twos"),
    )
    return _keyed(
        counted, {"rouge_1": overlap.rouge_n("ones"), "rouge_2": overlap.rouge_n("twos")}
    )


_SUBSEQUENCE = f"""{_GRAMMED}, {twins.subsequence_sql("longest", "grammed")}"""


@query(
    "rouge_l",
    rounded_sql(
        f"""WITH {_SUBSEQUENCE} SELECT sample_id, {_f_sql("coalesce(lcs, 0)", "len(p)", "len(r)")} AS rouge_l
        FROM grammed LEFT JOIN longest USING (sample_id)""",
        "rouge_l",
    ),
)
def rouge_l(spark, sf_dir):
    p, r = F.col("p"), F.col("r")
    counted = (
        text_pairs(spark, sf_dir)
        .select("sample_id", text.rouge_text(_pred()).alias("p"), text.rouge_text(_ref()).alias("r"))
        .select(
            "sample_id",
            rouge.common_subsequence(p, r).alias("lcs"),
            text.word_count(p).alias("np"),
            text.word_count(r).alias("nr"),
        )
    )
    return _keyed(counted, {"rouge_l": F.expr(overlap.f_measure("lcs", "np", "nr"))})


_STEMMED = f"""{_GRAMMED.split("doubled AS")[0].rstrip().rstrip(",")},
tokens AS (
    SELECT sample_id, 'p' AS side, i, p[i] AS token FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM grammed)
    UNION ALL SELECT sample_id, 'r', i, r[i] FROM (SELECT *, unnest(range(1, len(r) + 1)) AS i FROM grammed)),
vocabulary AS (SELECT DISTINCT token FROM tokens), {twins.stems_sql("vocabulary")},
sided AS (SELECT sample_id, side, list(stem ORDER BY i) AS l FROM tokens JOIN stems USING (token) GROUP BY sample_id, side),
stemmed AS (
    SELECT g.sample_id, coalesce(a.l, []) AS p, coalesce(b.l, []) AS r FROM grammed g
    LEFT JOIN sided a ON a.sample_id = g.sample_id AND a.side = 'p' LEFT JOIN sided b ON b.sample_id = g.sample_id AND b.side = 'r'),
paired AS (SELECT sample_id,
    list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1]) AS p,
    list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1]) AS r FROM stemmed),
{twins.multiset_sql("ones", "stemmed", "p", "r")}, {twins.multiset_sql("twos", "paired", "p", "r")},
{twins.subsequence_sql("longest", "stemmed")},
rouge AS (
    SELECT s.sample_id, {_f_sql("coalesce(ones.shared, 0)", "len(s.p)", "len(s.r)")} AS rouge_1,
      {_f_sql("coalesce(twos.shared, 0)", "len(d.p)", "len(d.r)")} AS rouge_2,
      {_f_sql("coalesce(lcs, 0)", "len(s.p)", "len(s.r)")} AS rouge_l
    FROM stemmed s JOIN paired d USING (sample_id) LEFT JOIN ones USING (sample_id)
    LEFT JOIN twos USING (sample_id) LEFT JOIN longest USING (sample_id))"""


@query("rouge_stemmed", rounded_sql(f"WITH {_STEMMED} SELECT * FROM rouge", "rouge_1 rouge_2 rouge_l"))
def rouge_stemmed(spark, sf_dir):
    matched = text_pairs(spark, sf_dir).withColumn(
        "m", rouge.stemmed_matches(text.rouge_text(_pred()), text.rouge_text(_ref()))
    )
    return _keyed(matched, rouge.rouge_scores("m"))


@query(
    "porter_stem",
    f"""WITH {twins.SIDES},
    tokens AS (SELECT unnest({twins.words_sql(twins.rouge_text_sql("text"))}) AS token FROM sides),
    vocabulary AS (SELECT token, count(*) AS occurrences FROM tokens GROUP BY token), {twins.stems_sql("vocabulary")}
    SELECT token, occurrences, stem FROM vocabulary JOIN stems USING (token)""",
)
def porter_stem(spark, sf_dir):
    """Stems of the vocabulary of both sides with their frequencies: each distinct token is stemmed once."""
    words = text_sides(spark, sf_dir).select(F.explode(text.rouge_tokens(_text())).alias("token"))
    counted = words.groupBy("token").agg(F.count("*").alias("occurrences"))
    return counted.withColumn("stem", rouge.stem_tokens("token"))


@query(
    "stemmed_texts",
    f"""WITH {twins.SIDES},
    split AS (SELECT sample_id, side, text, {twins.words_sql(twins.rouge_text_sql("text"))} AS l FROM sides),
    tokens AS (SELECT sample_id, side, i, l[i] AS token FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM split)),
    vocabulary AS (SELECT DISTINCT token FROM tokens), {twins.stems_sql("vocabulary")},
    joined AS (
      SELECT sample_id, side, string_agg(stem, ' ' ORDER BY i) AS line FROM tokens JOIN stems USING (token) GROUP BY sample_id, side)
    SELECT sample_id, side, CASE WHEN text IS NOT NULL THEN coalesce(line, '') END AS stemmed
    FROM split LEFT JOIN joined USING (sample_id, side)""",
)
def stemmed_texts(spark, sf_dir):
    """Whole texts of both sides with every token stemmed, by one vocabulary for all of them."""
    stems = stemmed_by_vocabulary(text_sides(spark, sf_dir), ["sample_id", "side"], text.rouge_tokens(_text()))
    return stems.select("sample_id", "side", F.array_join("stems", " ").alias("stemmed"))


@query(
    "word_tokens",
    f"""WITH {twins.SIDES} SELECT sample_id, side,
    array_to_string({twins.word_tokens_sql('text')}, ' ') AS tokens FROM sides""",
)
def word_tokens(spark, sf_dir):
    return _sides(spark, sf_dir, F.array_join(text.word_tokens(_text()), " ").alias("tokens"))


def _core_sql(piece: str) -> str:
    opened = f"regexp_replace({piece}, {twins.quoted(sentences.OPENING)}, '')"
    return f"lower(regexp_replace({opened}, {twins.quoted(sentences.CLOSING)}, ''))"


def _type_sql(piece: str) -> str:
    return f"regexp_replace({_core_sql(piece)}, {twins.quoted(sentences.PERIODS)}, '')"


_SCORED = f"""{twins.SIDES},
placed AS (
    SELECT sample_id, side, text, unnest(words) AS piece, generate_subscripts(words, 1) AS i, len(words) AS last
    FROM (SELECT *, {twins.words_sql("text", text.SPACES)} AS words FROM sides)),
typed AS (
    SELECT *, {_type_sql("piece")} AS type, regexp_matches({_core_sql("piece")}, {twins.quoted(sentences.ONE_PERIOD)}) AS ends
    FROM placed),
counted AS (
    SELECT type, count(*) FILTER (ends) AS n_period, count(*) FILTER (NOT ends) AS n_plain
    FROM typed WHERE regexp_matches(type, '\\p{{L}}') GROUP BY type),
scored AS (
    SELECT type, n_period, n_plain, length(replace(type, '.', '')) AS letters,
      2 * (n_period * (ln({sentences.KEPT_PERIOD}) - ln(share)) + n_plain * (ln({1 - sentences.KEPT_PERIOD}) - ln(1 - share)))
        * exp(-letters) * (length(type) - letters + 1) * pow(letters, -n_plain) AS score
    FROM counted, (SELECT sum(n_period) / sum(2 * n_period + n_plain) AS share FROM counted) WHERE n_period > 0)"""


@query(
    "abbreviations",
    rounded_sql(
        f"""WITH {_SCORED} SELECT type, n_period, n_plain, score, score >= {sentences.THRESHOLD} AS abbreviation FROM scored""",
        "score",
    ),
)
def abbreviations(spark, sf_dir):
    """How much every word that stands before a period looks like an abbreviation."""
    scores = sentences.abbreviation_scores(text_sides(spark, sf_dir))
    return rounded(scores.withColumn("abbreviation", F.col("score") >= sentences.THRESHOLD))


_GUARDED = f"regexp_replace(piece, {twins.quoted(rf'[.]({sentences.CLOSERS})$')}, '{sentences.GUARD}' || {twins.quoted(chr(92) + '1')})"


@query(
    "sentence_ends",
    f"""WITH {_SCORED},
    judged AS (
      SELECT sample_id, side, i, last, piece, regexp_matches(piece, {twins.quoted(sentences.PLAIN_END)})
        AND type IN (SELECT type FROM scored WHERE score >= {sentences.THRESHOLD}) AS short FROM typed),
    joined AS (
      SELECT sample_id, side, string_agg(CASE WHEN short AND i < last THEN {_GUARDED} ELSE piece END, ' ' ORDER BY i) AS line,
        count(*) FILTER (i = last OR (NOT short AND regexp_matches(piece, {twins.quoted(sentences.SENTENCE_END)}))) AS sentences
      FROM judged GROUP BY ALL)
    SELECT s.sample_id, s.side, CASE WHEN text IS NOT NULL THEN coalesce(sentences, 0) END AS sentences,
      CASE WHEN text IS NOT NULL THEN coalesce(replace(array_to_string({twins.word_tokens_sql("line")}, ' '), '{sentences.GUARD}', '.'), '') END AS tokens
    FROM sides s LEFT JOIN joined USING (sample_id, side)""",
)
def sentence_ends(spark, sf_dir):
    """Sentences and word tokens of whole texts, by the abbreviations these texts teach."""
    texts = text_sides(spark, sf_dir).select("sample_id", "side", "text")
    known = sentences.with_abbreviations(texts, ["sample_id", "side"], sentences.learn_abbreviations(texts))
    return known.select(
        "sample_id",
        "side",
        sentences.sentence_count(_text(), F.col("abbreviations")).alias("sentences"),
        F.array_join(sentences.sentence_word_tokens(_text(), F.col("abbreviations")), " ").alias("tokens"),
    )


@query(
    "length_metrics",
    rounded_sql(
        f"""WITH {twins.PAIRS}, sized AS (
          SELECT sample_id, len({twins.word_tokens_sql('response')}) AS prediction_length,
                 len({twins.word_tokens_sql('ground_truth')}) AS reference_length FROM pairs)
        SELECT *, {twins.ratio_sql('prediction_length', 'reference_length')} AS length_ratio,
               abs(prediction_length - reference_length) AS length_difference FROM sized""",
        "length_ratio",
    ),
)
def length_metrics(spark, sf_dir):
    pairs = text_pairs(spark, sf_dir).select(
        "sample_id",
        F.array_size(text.word_tokens(_pred())).alias("p"),
        F.array_size(text.word_tokens(_ref())).alias("r"),
    )
    return _keyed(pairs, overlap.length_metrics("p", "r"))


@query(
    "word_count",
    f"""WITH {twins.SIDES} SELECT sample_id, side,
    len({twins.words_sql('text', text.SPACES)}) AS words FROM sides""",
)
def word_count(spark, sf_dir):
    return _sides(spark, sf_dir, text.word_count(_text()).cast("long").alias("words"))


def _hits_sql(column: str, words: list[str]) -> str:
    return " + ".join(f"CAST(contains(lower({column}), {twins.quoted(w)}) AS INTEGER)" for w in words)


def _covered_sql(words: list[str]) -> str:
    top, bottom = f"({_hits_sql('response', words)})", f"({_hits_sql('ground_truth', words)})"
    return f"least({twins.ratio_sql(top, bottom)}, 1.0::DOUBLE)"


def _structure_sql(column: str) -> str:
    return " + ".join(
        f"CAST(regexp_matches(lower({column}), {twins.quoted(p)}) AS INTEGER)"
        for p in coverage.STRUCTURE_PATTERNS
    )


_FAMILIES = {f"{k}_coverage": v for k, v in coverage.CRM_KEYWORDS.items()} | {
    "overall_keyword_coverage": [w for ws in coverage.CRM_KEYWORDS.values() for w in ws]
}
_CRM_SQL = ", ".join(f"{_covered_sql(words)} AS {name}" for name, words in _FAMILIES.items())
_STRUCTURE_RATIO = twins.ratio_sql(
    f"({_structure_sql('response')})", f"({_structure_sql('ground_truth')})"
)
_WORF_SQL = f"""{_covered_sql(coverage.ANALYSIS_WORDS)} AS analytical_coverage,
    least({_STRUCTURE_RATIO}, 1.0::DOUBLE) AS structure_coverage"""


def _hits(spark, sf_dir, count) -> DataFrame:
    return text_pairs(spark, sf_dir).select(
        "sample_id", count("response").alias("p"), count("ground_truth").alias("r")
    )


@query(
    "crm_coverage",
    rounded_sql(f"WITH {twins.PAIRS} SELECT sample_id, {_CRM_SQL} FROM pairs", " ".join(CRM_COLUMNS)),
)
def crm_coverage(spark, sf_dir):
    return _keyed(
        _hits(spark, sf_dir, coverage.crm_hits), coverage.crm_coverage("p", "r")
    )


@query(
    "worf_coverage",
    rounded_sql(
        f"""WITH {twins.PAIRS}, covered AS (SELECT sample_id, {_WORF_SQL} FROM pairs)
        SELECT *, (analytical_coverage + structure_coverage) / 2 AS reasoning_depth FROM covered""",
        " ".join(WORF_COLUMNS),
    ),
)
def worf_coverage(spark, sf_dir):
    return _keyed(
        _hits(spark, sf_dir, coverage.worf_hits), coverage.worf_coverage("p", "r")
    )


def _inside(suite: str, columns: list[str], source: str) -> str:
    return ", ".join(f"CASE WHEN benchmark = '{suite}' THEN {source}.{c} END AS {c}" for c in columns)


_QUALITY_DOUBLES = " ".join(
    ["exact_match precision recall f1 rouge_1 rouge_2 rouge_l semantic_similarity length_ratio", *CRM_COLUMNS, *WORF_COLUMNS]
)


@query(
    "quality_metrics",
    rounded_sql(
        f"""WITH {_STEMMED}, tokenised AS (
          SELECT sample_id, {twins.tokens_sql("response")} AS p, {twins.tokens_sql("ground_truth")} AS r FROM pairs),
        {twins.multiset_sql("common", "tokenised", "p", "r")},
        sizes AS (SELECT sample_id, len(list_intersect(list_distinct(p), list_distinct(r))) AS s,
          len(list_distinct(p)) AS np, len(list_distinct(r)) AS nr,
          CASE WHEN len(p) > 0 AND len(r) > 0 THEN coalesce(shared, 0) / sqrt(CAST(len(p) AS DOUBLE) * len(r)) ELSE 0.0::DOUBLE END
            AS semantic_similarity FROM tokenised LEFT JOIN common USING (sample_id)),
        shares AS (SELECT *, {twins.ratio_sql("s", "np")} AS precision, {twins.ratio_sql("s", "nr")} AS recall FROM sizes),
        sized AS (SELECT sample_id, len({twins.word_tokens_sql("response")}) AS prediction_length,
          len({twins.word_tokens_sql("ground_truth")}) AS reference_length FROM pairs),
        crm AS (SELECT sample_id, {_CRM_SQL} FROM pairs),
        covered AS (SELECT sample_id, {_WORF_SQL} FROM pairs),
        worf AS (SELECT *, (analytical_coverage + structure_coverage) / 2 AS reasoning_depth FROM covered)
        SELECT sample_id, benchmark,
          CAST({twins.normalize_sql("response")} = {twins.normalize_sql("ground_truth")} AS DOUBLE) AS exact_match,
          precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1,
          rouge_1, rouge_2, rouge_l, semantic_similarity, prediction_length, reference_length,
          {twins.ratio_sql("prediction_length", "reference_length")} AS length_ratio,
          abs(prediction_length - reference_length) AS length_difference,
          {_inside("crmarena", CRM_COLUMNS, "crm")}, {_inside("worfbench", WORF_COLUMNS, "worf")}
        FROM pairs JOIN shares USING (sample_id) JOIN rouge USING (sample_id) JOIN sized USING (sample_id)
        JOIN crm USING (sample_id) JOIN worf USING (sample_id)""",
        _QUALITY_DOUBLES,
    ),
)
def quality_metrics(spark, sf_dir):
    """Every metric of every pair, stemmed ROUGE included."""
    return rounded(score_pairs(text_pairs(spark, sf_dir)).drop("response", "ground_truth"))


def _strip_sql(column: str) -> str:
    return f"regexp_replace({column}, {twins.quoted(text.EDGES)}, '', 'g')"


def _extract_sql(column: str, pattern: str) -> str:
    return f"nullif({_strip_sql(f'regexp_extract({column}, {twins.quoted(pattern)}, 1)')}, '')"


_ANSWER_SQL = f"""coalesce({_extract_sql('s', text.ANSWER_AFTER_LABEL)},
    {_extract_sql('s', text.ANSWER_AFTER_PHRASE)}, {_extract_sql('s', text.FIRST_LINE)}, s)"""
_CLEAN_CRM_SQL = (
    f"lower(regexp_replace(regexp_replace({_ANSWER_SQL}, {twins.quoted(text.SPACES)}, ' ', 'g'), "
    r"'\.+\z', ''))"
)
_CLEAN_MARKDOWN_SQL = "s"
for _rule in text.MARKDOWN:
    _CLEAN_MARKDOWN_SQL = twins.replace_all(_CLEAN_MARKDOWN_SQL, _rule)
_CLEAN_MARKDOWN_SQL = twins.replace_all(_CLEAN_MARKDOWN_SQL, (text.SPACES, " "))
_STRIPPED = f"{twins.SIDES}, stripped AS (SELECT sample_id, benchmark, side, {_strip_sql('text')} AS s FROM sides)"


@query(
    "clean_crm_answer",
    f"WITH {_STRIPPED} SELECT sample_id, side, {_CLEAN_CRM_SQL} AS answer FROM stripped",
)
def clean_crm_answer(spark, sf_dir):
    return _sides(spark, sf_dir, text.clean_crm_answer(_text()).alias("answer"))


@query(
    "clean_markdown",
    f"WITH {_STRIPPED} SELECT sample_id, side, {_CLEAN_MARKDOWN_SQL} AS plain FROM stripped",
)
def clean_markdown(spark, sf_dir):
    return _sides(spark, sf_dir, text.clean_markdown(_text()).alias("plain"))


@query(
    "suite_preprocessing",
    f"""WITH {_STRIPPED} SELECT sample_id, side, CASE WHEN benchmark = 'crmarena' THEN {_CLEAN_CRM_SQL}
    ELSE {_CLEAN_MARKDOWN_SQL} END AS cleaned FROM stripped""",
)
def suite_preprocessing(spark, sf_dir):
    return _sides(spark, sf_dir, registry.clean_response(F.col("benchmark"), _text()).alias("cleaned"))


@query(
    "registered_metric",
    f"""WITH {twins.PAIRS} SELECT sample_id,
    CAST(starts_with(response, left(ground_truth, 1)) AS DOUBLE) AS same_start FROM pairs""",
)
def registered_metric(spark, sf_dir):
    """A user metric given as an expression, applied by name."""
    registry.register_metric(
        "same_start",
        lambda p, r: F.startswith(p, F.left(r, F.lit(1))).cast("double"),
    )
    metric = registry.registered_metrics()["same_start"]
    registry.unregister_metric("same_start")
    return text_pairs(spark, sf_dir).select("sample_id", metric(_pred(), _ref()).alias("same_start"))


_LIMIT = 2000


def _length_share(prediction: str, reference: str) -> float:
    """A user's metric that cannot do long texts."""
    if len(prediction) > _LIMIT:
        raise ValueError("too long")
    return len(reference) / max(len(prediction), 1)


@query(
    "python_metric",
    rounded_sql(
        f"""WITH {twins.PAIRS} SELECT sample_id,
        CASE WHEN length(response) <= {_LIMIT} THEN length(ground_truth) / CAST(greatest(length(response), 1) AS DOUBLE) END AS length_share,
        CASE WHEN length(response) > {_LIMIT} THEN 'length_share: ValueError' ELSE '' END AS failed FROM pairs""",
        "length_share",
    ),
)
def python_metric(spark, sf_dir):
    """A user's Python metric through the scorer; where it fails the score is NULL and the failure is noted."""
    registry.register_python_metric("length_share", _length_share)
    try:
        scored = score_pairs(text_pairs(spark, sf_dir))
    finally:
        registry.unregister_metric("length_share")
    return rounded(scored.select("sample_id", "length_share", F.concat_ws(",", "metric_errors").alias("failed")))
