"""Registered queries of the core operators and their SQL counterparts.

Each query takes (spark, sf_dir) and runs over its whole tables. Where SQL has no counterpart, or would be too slow on whole
tables, there is none, and the tests compare the operator with a brute-force model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


from loamworks.operators import annotate, budget, decontam, dedup, masking, minhash, quality, semantic, slices, urls
from loamworks.plans import attribution, evals, policy, search
from loamworks.session import materialize, step_path, table
from loamworks.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: White space as in ``functions.text.SPACE``, for RE2.
_WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NWS = _WS.replace("[", "[^", 1)
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda w: w <> '')"
_LINES = f"list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{_NWS}'))"
_NORM = f"trim(regexp_replace(lower(coalesce(text, '')), '{_WS}+', ' ', 'g'))"
_LAST = "(SELECT * FROM doc_records WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY fetched_at DESC, record_id DESC, ingested_at DESC) = 1)"


def _grams_sql(words: str, n: int) -> str:
    return f"(CASE WHEN len({words}) = 0 THEN [] WHEN len({words}) < {n} THEN [array_to_string({words}, ' ')] ELSE list_transform(range(1, len({words}) - {n} + 2), lambda i: array_to_string(list_slice({words}, i, i + {n} - 1), ' ')) END)"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _latest(spark, sf_dir):
    """The latest record of each document."""
    records = table(spark, sf_dir, "doc_records").where("doc_id IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc_nulls_last("fetched_at"), F.desc("record_id"), F.desc_nulls_last("ingested_at")))
    return records.withColumn("_r", rank).where("_r = 1").drop("_r")


# --- quality, masks, language ----------------------------------------------------------------------------

_SCORES = f"""
SELECT doc_id, n,
  CASE WHEN n < 10 THEN 0.0 ELSE list_max(map_values(counts))::DOUBLE / n END AS word_rep,
  CASE WHEN len(ls) < 3 THEN 0.0 ELSE (len(ls) - len(list_distinct(ls)))::DOUBLE / len(ls) END AS line_rep,
  CASE WHEN n = 0 THEN 0.0 ELSE list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / n END AS avg_word_length,
  CASE WHEN len(ls) = 0 THEN 0.0 ELSE len(list_filter(ls, lambda l: regexp_matches(l, '[.!?]{_WS}*\\z')))::DOUBLE / len(ls) END AS sentence_end,
  CASE WHEN len(ls) = 0 THEN 0.0 ELSE len(list_filter(ls, lambda l: contains(l, '...') OR contains(l, '…')))::DOUBLE / len(ls) END AS ellipsis,
  CASE WHEN len(ls) = 0 THEN 0.0 ELSE len(list_filter(ls, lambda l: regexp_matches(l, '^{_WS}*[-*•◦▪▸►]')))::DOUBLE / len(ls) END AS bullet,
  CASE WHEN length(t) = 0 THEN 0.0 ELSE (length(t) - length(replace(replace(t, '{{', ''), '}}', '')))::DOUBLE / length(t) END AS curly_brace,
  CASE WHEN length(t) = 0 THEN 0.0 ELSE length(regexp_replace(t, '[^\\p{{Nd}}]', '', 'g'))::DOUBLE / length(t) END AS digit_ratio,
  CASE WHEN length(t) = 0 THEN 0.0 ELSE length(regexp_replace(t, '[^\\p{{L}}]', '', 'g'))::DOUBLE / length(t) END AS alpha_ratio,
  length(t) AS size, len(ls) AS n_lines
FROM (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, len({_WORDS}) AS n, {_LINES} AS ls, list_aggregate({_WORDS}, 'histogram') AS counts FROM documents)
"""

@query(
    "SELECT doc_id, n AS n_words, round(word_rep, 6) AS word_rep, round(line_rep, 6) AS line_rep, round(avg_word_length, 6) AS avg_word_length, round(sentence_end, 6) AS sentence_end, "
    "round(ellipsis, 6) AS ellipsis, round(bullet, 6) AS bullet, round(curly_brace, 6) AS curly_brace, round(digit_ratio, 6) AS digit_ratio, round(alpha_ratio, 6) AS alpha_ratio FROM (" + _SCORES + ")"
)
def quality_scores(spark, sf_dir):
    """F8 to F19 without char_rep, whose back-reference SQL lacks."""
    out = quality.with_quality(_docs(spark, sf_dir))
    names = [r for r in quality.RULES if r not in ("char_rep", "min_words", "max_words")]
    return out.select("doc_id", F.col("quality_scores.min_words").cast("bigint").alias("n_words"), *[F.round(f"quality_scores.{r}", 6).alias(r) for r in names])


@query(
    "SELECT doc_id FROM (" + _SCORES + ") WHERE word_rep <= 0.2 AND line_rep <= 0.3 AND n BETWEEN 50 AND 100000 AND (n = 0 OR avg_word_length BETWEEN 3 AND 10) "
    "AND (n_lines = 0 OR sentence_end >= 0.1) AND ellipsis <= 0.1 AND bullet <= 0.9 AND curly_brace <= 0.05 AND digit_ratio <= 0.3 AND (size = 0 OR alpha_ratio >= 0.6)"
)
def quality_filter(spark, sf_dir):
    rules = tuple(r for r in quality.RULES if r != "char_rep")
    return quality.quality_filter(_docs(spark, sf_dir), quality.QualityConfig(rules=rules)).select("doc_id")


#: Characters of runs of ten or more equal ones, none a line feed: each maximal run counts once.
_CHAR_REP = """(WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE length(text) >= 100),
  r AS (SELECT doc_id, count(*) AS k FROM (SELECT doc_id, ch, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS run FROM c WHERE ch <> chr(10)) GROUP BY doc_id, ch, run HAVING count(*) >= 10)
  SELECT d.doc_id, CASE WHEN length(coalesce(text, '')) < 100 THEN 0.0 ELSE coalesce(n, 0) * 10.0 / length(text) END AS char_rep FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id) USING (doc_id))"""


@query(f"SELECT doc_id, round(char_rep, 6) AS char_rep, char_rep <= 0.2 AS passes FROM {_CHAR_REP}")
def quality_char_rep(spark, sf_dir):
    out = quality.with_quality(_docs(spark, sf_dir), quality.QualityConfig(rules=("char_rep",)))
    return out.select("doc_id", F.round("quality_scores.char_rep", 6).alias("char_rep"), (F.size("quality_failed") == 0).alias("passes"))


@query(f"""SELECT doc_id, round((word_rep + line_rep + char_rep + n + n + avg_word_length + sentence_end + ellipsis + bullet + curly_brace + digit_ratio + alpha_ratio) / 12, 4) AS mean_all,
  round((word_rep + n + alpha_ratio) / 3, 4) AS mean_three FROM ({_SCORES}) JOIN {_CHAR_REP} USING (doc_id)""")
def quality_mean(spark, sf_dir):
    """The mean over all rules, and over the enabled ones."""
    out = quality.with_quality(_docs(spark, sf_dir))
    return out.select("doc_id", F.round(quality.mean_quality(), 4).alias("mean_all"), F.round(quality.mean_quality(rules=("word_rep", "min_words", "alpha_ratio")), 4).alias("mean_three"))


@query(f"""SELECT doc_id, round(CASE WHEN len(p) < 3 THEN 0.0 ELSE (len(p) - len(list_distinct(p)))::DOUBLE / len(p) END, 6) AS paragraph_rep
FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\n{_WS}*\n'), lambda x: regexp_matches(x, '{_NWS}')) AS p FROM documents)""")
def paragraph_repetition(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(quality.paragraph_repetition(F.coalesce("text", F.lit(""))), 6).alias("paragraph_rep"))


@query(r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b'))::BIGINT AS pii_emails_masked,
  md5(regexp_replace(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b', '[EMAIL]', 'g')) AS masked FROM documents""")
def mask_emails(spark, sf_dir):
    return masking.mask_addresses(_docs(spark, sf_dir), ips=False).select("doc_id", "pii_emails_masked", F.md5("text").alias("masked"))


_OCT = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_EMAIL_SQL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
_IPV4_SQL = rf"\b(?:{_OCT}\.){{3}}{_OCT}\b"


def _masked_sql(text: str) -> str:
    """The text with emails masked and, of addresses of private networks, the first dot set aside (as chr(2)), so that they don't match; RE2 cannot look ahead."""
    mail = f"regexp_replace({text}, '{_EMAIL_SQL}', '[EMAIL]', 'g')"
    return rf"regexp_replace({mail}, '(^|[^0-9.])(10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.', '\1\2' || chr(2), 'g')"


def _all_masked_sql(text: str) -> str:
    return f"replace(regexp_replace({_masked_sql(text)}, '{_IPV4_SQL}', '[IP_ADDRESS]', 'g'), chr(2), '.')"


@query(f"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{_EMAIL_SQL}'))::BIGINT AS pii_emails_masked, len(regexp_extract_all(coalesce({_masked_sql("text")}, ''), '{_IPV4_SQL}'))::BIGINT AS pii_ips_masked,
  md5({_all_masked_sql("text")}) AS masked FROM documents""")
def mask_all(spark, sf_dir):
    return masking.mask_addresses(_docs(spark, sf_dir)).select("doc_id", "pii_emails_masked", "pii_ips_masked", F.md5("text").alias("masked"))


@query("SELECT record_id, ingested_at FROM doc_records WHERE language = 'en' AND coalesce(round(language_score, 4), 0) >= 0.65")
def language_filter(spark, sf_dir):
    records = table(spark, sf_dir, "doc_records").withColumn("language_score", F.round("language_score", 4))
    return annotate.language_filter(records).select("record_id", "ingested_at")


@query(
    "SELECT coalesce(reject_reason, 'passes') AS reason, count(*)::BIGINT AS n FROM (SELECT CASE WHEN language IS NULL OR language <> 'en' THEN 'language:' || coalesce(language, 'unknown') "
    "WHEN coalesce(language_score, 0) < 0.65 THEN 'low_language_score' END AS reject_reason FROM doc_records) GROUP BY 1"
)
def language_reasons(spark, sf_dir):
    marked = annotate.language_filter(table(spark, sf_dir, "doc_records"), reason=True)
    return marked.groupBy(F.coalesce("reject_reason", F.lit("passes")).alias("reason")).agg(F.count("*").alias("n"))


_MASK_TEXT = "CASE WHEN doc_id % 3 = 0 THEN text || ' from 10.1.2.3 and 8.8.4.4, ' || (doc_id % 256) || '.20.30.40 or 172.31.0.9' ELSE text END"


@query(f"""SELECT sum(len(regexp_extract_all(coalesce(text, ''), '{_EMAIL_SQL}')))::BIGINT AS emails_masked, sum(len(regexp_extract_all(coalesce({_masked_sql("t")}, ''), '{_IPV4_SQL}')))::BIGINT AS ips_masked
FROM (SELECT text, {_MASK_TEXT} AS t FROM documents)""")
def mask_totals(spark, sf_dir):
    """The numbers of masks, on texts of which a third has addresses of public and private networks added."""
    return masking.mask_totals(masking.mask_addresses(_docs(spark, sf_dir).withColumn("text", F.expr(_MASK_TEXT))))


def _language_sql(rows: str) -> str:
    counts = ", ".join("{'n': len(list_filter(lw, lambda x: x IN (" + ", ".join(f"'{w}'" for w in words.split()) + f"))), 'l': '{lang}'}}" for lang, words in annotate.STOP_WORDS.items())
    return f"""(SELECT * EXCLUDE (lw, ls, best, tot), CASE WHEN tot > 0 THEN best.l ELSE 'unknown' END AS language, CASE WHEN tot > 0 THEN round(best.n::DOUBLE / tot, 4) ELSE 0.0 END AS language_score
  FROM (SELECT *, list_aggregate(ls, 'max') AS best, list_sum(list_transform(ls, lambda x: x.n)) AS tot FROM (SELECT *, [{counts}] AS ls FROM (SELECT *, {_LOW} AS lw FROM {rows}))))"""


_LOW = f"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_WS}+'), lambda w: w <> '')"


@query(f"SELECT doc_id, language, language_score FROM {_language_sql('documents')}")
def language_detect(spark, sf_dir):
    return annotate.with_language(_docs(spark, sf_dir)).select("doc_id", "language", "language_score")


@query(f"SELECT doc_id, len({_WORDS})::BIGINT AS token_count FROM documents")
def token_count(spark, sf_dir):
    return annotate.with_token_count(_docs(spark, sf_dir)).select("doc_id", "token_count")


@query(f"SELECT doc_id FROM documents WHERE len({_WORDS}) BETWEEN 20 AND 500")
def length_filter(spark, sf_dir):
    return quality.length_filter(_docs(spark, sf_dir), 20, 500).select("doc_id")


@query(
    "SELECT DISTINCT doc_id FROM (SELECT doc_id, CASE WHEN quality_scores['overall'] >= 0.7 THEN 0.9 WHEN quality_scores['overall'] >= 0.4 THEN 0.5 WHEN quality_scores['overall'] IS NULL THEN 0.5 ELSE 0.2 END AS s "
    f"FROM {_LAST}) WHERE s >= 0.5"
)
def label_quality(spark, sf_dir):
    """F23 with labels made of the stored overall score."""
    overall = F.try_element_at("quality_scores", F.lit("overall"))
    label = F.when(overall >= 0.7, "high").when(overall >= 0.4, "medium").when(overall.isNotNull(), "low")
    return quality.label_quality_filter(_latest(spark, sf_dir).withColumn("quality_label", label), 0.5).select("doc_id")


# --- URLs and slices -------------------------------------------------------------------------------------

_CASES = " ".join(f"WHEN regexp_matches(u, '{p}') THEN 'pattern:{p}'" for p in ("adult", "crack", "news", "forum", r"\.html$"))
_HOST = "nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), '')"


@query(f"SELECT record_id, ingested_at, CASE WHEN coalesce(url, '') = '' THEN NULL {_CASES} END AS reject_reason FROM (SELECT *, lower(url) AS u FROM doc_records)")
def url_patterns(spark, sf_dir):
    patterns = ("adult", "crack", "news", "forum", r"\.html$")
    return urls.with_url_reason(table(spark, sf_dir, "doc_records"), patterns=patterns).select("record_id", "ingested_at", "reject_reason")


_BLOCKED = f"SELECT DISTINCT regexp_extract(lower({_HOST}), '([^.]+\\.[^.]+)$', 1) AS domain FROM doc_records WHERE language = 'fr' AND {_HOST} IS NOT NULL"


@query(f"""WITH b AS ({_BLOCKED}), h AS (SELECT record_id, ingested_at, url, lower({_HOST}) AS host FROM doc_records)
SELECT record_id, ingested_at, CASE WHEN coalesce(url, '') = '' THEN NULL WHEN host IN (SELECT domain FROM b) THEN 'blocklist_domain'
WHEN EXISTS (SELECT 1 FROM b WHERE ends_with(h.host, '.' || b.domain)) THEN 'blocklist_parent_domain' END AS reject_reason FROM h""")
def url_blocklist(spark, sf_dir):
    """F4 and F5 with a block list of the domains of French records."""
    records = table(spark, sf_dir, "doc_records")
    host = F.lower(urls.authority(F.col("url")))
    blocked = records.where((F.col("language") == "fr") & host.isNotNull()).select(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain")).distinct()
    return urls.with_url_reason(records, blocked, patterns=()).select("record_id", "ingested_at", "reject_reason")


def _sliced(spark, sf_dir):
    rows = _latest(spark, sf_dir).withColumn("mean_quality", F.try_element_at("quality_scores", F.lit("overall")))
    return slices.assign_slices(rows.drop("slice_tags"))


_TAGS = f"""(SELECT doc_id, token_count, dedup_cluster_id, quality_scores['overall'] AS q, list_sort(list_distinct(list_filter([
  CASE WHEN coalesce(dump, '') <> '' THEN 'dump=' || dump END, CASE WHEN coalesce(language, '') <> '' THEN 'lang=' || language END,
  'domain=' || {_HOST}, CASE WHEN ends_with(lower({_HOST}), '.edu') THEN 'domain_type=edu' WHEN ends_with(lower({_HOST}), '.gov') THEN 'domain_type=gov' END,
  CASE WHEN token_count IS NULL THEN NULL WHEN token_count < 128 THEN 'token_bin=tiny' WHEN token_count < 512 THEN 'token_bin=small' WHEN token_count < 2048 THEN 'token_bin=medium' ELSE 'token_bin=large' END,
  CASE WHEN quality_scores['overall'] IS NULL THEN NULL WHEN quality_scores['overall'] >= 0.8 THEN 'quality_bin=high' WHEN quality_scores['overall'] >= 0.5 THEN 'quality_bin=medium' ELSE 'quality_bin=low' END,
  CASE WHEN language_score IS NULL THEN NULL WHEN language_score >= 0.95 THEN 'lang_score_bin=very_high' WHEN language_score >= 0.85 THEN 'lang_score_bin=high' WHEN language_score >= 0.7 THEN 'lang_score_bin=medium' ELSE 'lang_score_bin=low' END,
  CASE WHEN toxicity_score IS NULL THEN NULL WHEN toxicity_score < 0.1 THEN 'toxicity_bin=safe' WHEN toxicity_score < 0.3 THEN 'toxicity_bin=low_risk' WHEN toxicity_score < 0.5 THEN 'toxicity_bin=medium_risk' ELSE 'toxicity_bin=high_risk' END
  ], lambda t: t IS NOT NULL))) AS tags FROM {_LAST})"""


@query(f"SELECT doc_id, list_aggregate(tags, 'string_agg', '|') AS tags FROM {_TAGS}")
def slice_tags(spark, sf_dir):
    return _sliced(spark, sf_dir).select("doc_id", F.array_join("slice_tags", "|").alias("tags"))


#: Every tenth document counts as dropped by deduplication, every fifteenth by decontamination.
_KEPT = "(doc_id % 10 <> 0 AND doc_id % 15 <> 0)"
_STATS = f"""count(*) FILTER ({_KEPT})::BIGINT AS doc_count, coalesce(sum(token_count) FILTER ({_KEPT}), 0)::BIGINT AS token_count,
  CASE WHEN count(*) FILTER ({_KEPT}) > 0 THEN round(coalesce(sum(q) FILTER ({_KEPT}), 0) / count(*) FILTER ({_KEPT}), 4) ELSE 0.0 END AS avg_quality_score,
  count(*) FILTER (doc_id % 10 = 0)::BIGINT AS dedup_dropped, count(*) FILTER (doc_id % 15 = 0)::BIGINT AS decontam_dropped,
  CASE WHEN count(*) FILTER (doc_id % 10 = 0) + count(*) FILTER ({_KEPT}) > 0 THEN round(count(*) FILTER (doc_id % 10 = 0)::DOUBLE / (count(*) FILTER (doc_id % 10 = 0) + count(*) FILTER ({_KEPT})), 4) ELSE 0.0 END AS dedup_drop_rate,
  CASE WHEN count(*) FILTER (doc_id % 15 = 0) + count(*) FILTER ({_KEPT}) > 0 THEN round(count(*) FILTER (doc_id % 15 = 0)::DOUBLE / (count(*) FILTER (doc_id % 15 = 0) + count(*) FILTER ({_KEPT})), 4) ELSE 0.0 END AS decontam_drop_rate"""


def _marked(spark, sf_dir):
    # qualities in eighths: their sums are exact, so no mean depends on the order of summation
    rows = _sliced(spark, sf_dir).withColumn("mean_quality", F.floor(F.coalesce(F.nanvl("mean_quality", F.lit(0.0)), F.lit(0.0)) * 8) / 8)
    return rows.withColumn("dedup_dropped", F.col("doc_id") % 10 == 0).withColumn("decontam_dropped", F.col("doc_id") % 15 == 0)


_MARKED = f"(SELECT * REPLACE (CASE WHEN q IS NULL OR isnan(q) THEN 0 ELSE floor(q * 8) / 8 END AS q) FROM {_TAGS})"


@query(f"SELECT slice, {_STATS} FROM (SELECT doc_id, unnest(tags) AS slice, token_count, q FROM {_MARKED}) GROUP BY slice")
def slice_stats(spark, sf_dir):
    return slices.slice_stats(_marked(spark, sf_dir))


@query(f"SELECT {_STATS} FROM {_MARKED}")
def total_stats(spark, sf_dir):
    return slices.total_stats(_marked(spark, sf_dir))


@query(f"""WITH s AS (SELECT slice, {_STATS} FROM (SELECT doc_id, unnest(tags) AS slice, token_count, q FROM {_MARKED}) GROUP BY slice), a AS (SELECT {_STATS} FROM {_MARKED})
SELECT slice, round(s.token_count::DOUBLE / a.token_count, 6) AS token_fraction, round(s.doc_count::DOUBLE / a.doc_count, 6) AS doc_fraction, s.avg_quality_score AS avg_quality FROM s, a""")
def composition(spark, sf_dir):
    rows = materialize(_marked(spark, sf_dir))
    out = slices.composition(slices.slice_stats(rows), slices.total_stats(rows))
    return out.select("slice", F.round("token_fraction", 6).alias("token_fraction"), F.round("doc_fraction", 6).alias("doc_fraction"), "avg_quality")


@query("""WITH s AS (SELECT source, sum(n_chars)::DOUBLE AS t FROM documents WHERE source IS NOT NULL AND n_chars > 0 GROUP BY source)
SELECT round(-sum(t / w * ln(t / w)) / ln(count(*)), 6) AS diversity_score FROM (SELECT t, sum(t) OVER () AS w FROM s)""")
def diversity(spark, sf_dir):
    """Q30: entropy of the shares of sources."""
    stats = _docs(spark, sf_dir).where("source IS NOT NULL AND n_chars > 0").groupBy("source").agg(F.sum("n_chars").alias("token_count"))
    return slices.diversity(stats).select(F.round("diversity_score", 6).alias("diversity_score"))


@query("""SELECT domain, n::BIGINT AS n, round(n::DOUBLE / sum(n) OVER (), 6) AS share FROM (SELECT coalesce(split_part(source, '_', 1), 'unknown') AS domain, count(*) AS n FROM documents GROUP BY 1)""")
def composition_ratios(spark, sf_dir):
    """A13."""
    docs = _docs(spark, sf_dir).select(F.split("source", "_")[0].alias("domain"))
    return slices.composition_ratios(docs, "domain").select("domain", "n", F.round("share", 6).alias("share"))


@query("SELECT language, dump, count(*)::BIGINT AS n_docs, coalesce(sum(token_count), 0)::BIGINT AS n_tokens FROM " + _LAST + " GROUP BY ROLLUP (language, dump)")
def slice_rollup(spark, sf_dir):
    return _latest(spark, sf_dir).rollup("language", "dump").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("n_tokens"))


# --- deduplication ---------------------------------------------------------------------------------------

_EXACT = "SELECT doc_id, substr(h, 1, 16) AS dedup_cluster_id FROM (SELECT doc_id, {scope} AS scope, sha256({text}) AS h FROM documents) QUALIFY row_number() OVER (PARTITION BY scope, h ORDER BY doc_id) = 1"


@query(_EXACT.format(scope="1", text=_NORM))
def exact_dedup(spark, sf_dir):
    return dedup.exact_dedup(_docs(spark, sf_dir)).select("doc_id", "dedup_cluster_id")


@query(_EXACT.format(scope="coalesce(nullif(dump, ''), 'unknown')", text=_NORM))
def exact_dedup_per_dump(spark, sf_dir):
    return dedup.exact_dedup(_docs(spark, sf_dir), scope="per_dump").select("doc_id", "dedup_cluster_id")


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) = 1")
def raw_dedup(spark, sf_dir):
    return dedup.raw_dedup(_docs(spark, sf_dir)).select("doc_id")


@query(f"""SELECT scope AS dedup_scope, count(*)::BIGINT AS n_docs, count(DISTINCT h)::BIGINT AS n_clusters, count(DISTINCT h)::BIGINT AS kept, (count(*) - count(DISTINCT h))::BIGINT AS dropped
FROM (SELECT coalesce(nullif(dump, ''), 'unknown') AS scope, substr(sha256({_NORM}), 1, 16) AS h FROM documents) GROUP BY scope""")
def dedup_stats(spark, sf_dir):
    return dedup.dedup_stats(dedup.mark_exact(_docs(spark, sf_dir), scope="per_dump")).drop("dedup_method")


_RULE_SQL = {
    "first": "doc_id ASC",
    "longest": "length(text) DESC NULLS LAST, doc_id DESC",
    "most_tokens": f"coalesce(token_count, len({_WORDS})) DESC, doc_id DESC",
    "highest_quality": "coalesce(q, 0) DESC, doc_id DESC",
    "lowest_toxicity": "coalesce(tox, 0) ASC, doc_id DESC",
    "most_recent": "coalesce(ts, TIMESTAMPTZ '1970-01-01 00:00:00+00') DESC, doc_id DESC",
}
_RULE_BASE = f"""(SELECT d.doc_id, d.text, r.token_count, CASE WHEN isnan(r.quality_scores['overall']) THEN NULL ELSE r.quality_scores['overall'] END AS q, r.toxicity_score AS tox, r.fetched_at AS ts, lower(trim(r.dedup_cluster_id)) AS cluster
  FROM documents d JOIN {_LAST} r ON d.doc_id = r.doc_id WHERE coalesce(trim(r.dedup_cluster_id), '') <> '')"""


@query(" UNION ALL ".join(f"(SELECT '{r}' AS rule, cluster, doc_id AS kept_id, (count(*) OVER (PARTITION BY cluster))::BIGINT AS cluster_size FROM {_RULE_BASE} QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY {o}) = 1)" for r, o in _RULE_SQL.items()))
def keep_rules(spark, sf_dir):
    """D9 to D16 on the stored clusters."""
    records = _latest(spark, sf_dir).select("doc_id", "token_count", F.nanvl(F.try_element_at("quality_scores", F.lit("overall")), F.lit(None).cast("double")).alias("mean_quality"), "toxicity_score", F.col("fetched_at").alias("timestamp"), F.lower(F.trim("dedup_cluster_id")).alias("cluster"))
    base = materialize(_docs(spark, sf_dir).select("doc_id", "text").join(records.where("cluster <> ''"), "doc_id").withColumn("quality_score", F.lit(None).cast("double")))
    out = [dedup.keep_one(base, r, "cluster").select(F.lit(r).alias("rule"), "cluster", "kept_id", "cluster_size") for r in dedup.KEEP_RULES]
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


@query()
def minhash_dedup(spark, sf_dir):
    return minhash.minhash_marks(_docs(spark, sf_dir))


@query()
def minhash_dedup_per_dump(spark, sf_dir):
    return minhash.minhash_marks(_docs(spark, sf_dir), scope="per_dump")


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4""")
def embedding_pairs(spark, sf_dir):
    return semantic.similar_embeddings(table(spark, sf_dir, "embeddings"), 0.4).select("a", "b", F.round("cosine", 4).alias("cosine"))


def _greedy_sql(nodes: str, edges: str) -> str:
    """The greedy rule gone through one by one: nodes with an earlier neighbour in order, each kept if none of these neighbours is."""
    return f"""e AS MATERIALIZED ({edges}), later AS MATERIALIZED (SELECT b, list(a) AS near, row_number() OVER (ORDER BY b) AS k FROM e GROUP BY b),
start AS (SELECT DISTINCT a FROM e WHERE a NOT IN (SELECT b FROM later)),
r AS (SELECT 0::BIGINT AS k, (SELECT coalesce(list(a), []) FROM start) AS kept UNION ALL
  SELECT later.k, CASE WHEN list_has_any(r.kept, later.near) THEN r.kept ELSE list_append(r.kept, later.b) END FROM r JOIN later ON later.k = r.k + 1),
done AS (SELECT kept FROM r ORDER BY k DESC LIMIT 1)
SELECT node, node NOT IN (SELECT b FROM later) OR list_contains((SELECT kept FROM done), node) AS kept FROM ({nodes})"""


_COSINE = "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4 - 1e-12"


@query("WITH RECURSIVE " + _greedy_sql("SELECT vec_id AS node FROM embeddings", _COSINE))
def semantic_dedup(spark, sf_dir):
    return semantic.semantic_dedup(table(spark, sf_dir, "embeddings"), 0.4, exact=True)


@query()
def semantic_dedup_indexed(spark, sf_dir):
    return semantic.semantic_dedup(table(spark, sf_dir, "embeddings"), 0.4, exact=False)


_SHINGLES = f"""SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k, any_value(x.n) AS n, any_value(y.n) AS m FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2) WHERE k >= 0.8 * (n + m - k) - 1e-9"""


@query(
    f"WITH RECURSIVE sh AS MATERIALIZED (SELECT doc_id, unnest(gs) AS g, len(gs) AS n FROM (SELECT doc_id, list_distinct({_grams_sql('w', 3)}) AS gs FROM (SELECT doc_id, {_LOW} AS w FROM documents))), "
    + _greedy_sql("SELECT doc_id AS node FROM documents", _SHINGLES)
)
def shingle_dedup(spark, sf_dir):
    return semantic.shingle_dedup(_docs(spark, sf_dir))


# --- decontamination -------------------------------------------------------------------------------------


def _evaluation(spark, sf_dir):
    return table(spark, sf_dir, "eval_items").select("item_id", F.lower(F.trim("target")).alias("source"), F.col("question").alias("text"))




def _overlap_sql(n: int, rows: str = "documents") -> str:
    """CTEs idx, dg and o: the index of evaluation questions, the runs of the documents, and their overlap."""
    return f"""idx AS (SELECT g, arg_min(source, (item_id, source)) AS eval_source FROM (SELECT item_id, lower(trim(target)) AS source, unnest({_grams_sql("w", n)}) AS g FROM (SELECT *, {_LOW.replace("text", "question")} AS w FROM eval_items)) GROUP BY g),
dg AS (SELECT doc_id, unnest(gs) AS g, generate_subscripts(gs, 1) - 1 AS pos, len(gs) AS total FROM (SELECT doc_id, {_grams_sql("w", n)} AS gs FROM (SELECT doc_id, {_LOW} AS w FROM {rows}))),
o AS (SELECT doc_id, count(DISTINCT g)::DOUBLE / max(total) AS overlap_score, count(DISTINCT g)::BIGINT AS matched, arg_min(eval_source, pos) AS eval_source, list_slice(list(g ORDER BY pos), 1, 10) AS grams FROM dg JOIN idx USING (g) GROUP BY doc_id)
"""


_OVERLAP = f"WITH {_overlap_sql(8)}"
_TEN = decontam.DecontamConfig(n=8, threshold=0.05)


def _index(spark, sf_dir, config):
    return decontam.build_index(_evaluation(spark, sf_dir), config)


@query(_OVERLAP + "SELECT doc_id, round(overlap_score, 6) AS overlap_score, matched, eval_source, array_to_string(grams, '|') AS grams FROM o")
def decontam_overlap(spark, sf_dir):
    """C1 to C5 with runs of 8 words."""
    found = decontam.overlaps(_docs(spark, sf_dir), _index(spark, sf_dir, _TEN), _TEN)
    return found.select("doc_id", F.round("overlap_score", 6).alias("overlap_score"), "matched", "eval_source", F.array_join("matched_ngrams", "|").alias("grams"))


@query(f"WITH {_overlap_sql(13)} SELECT doc_id, round(overlap_score, 6) AS overlap_score, matched, eval_source, overlap_score >= 0.8 AS is_contaminated FROM o")
def decontam_default(spark, sf_dir):
    """C3 with the default run length and threshold."""
    c = decontam.DecontamConfig()
    found = decontam.overlaps(_docs(spark, sf_dir), _index(spark, sf_dir, c), c)
    return found.select("doc_id", F.round("overlap_score", 6).alias("overlap_score"), "matched", "eval_source", (F.col("overlap_score") >= c.threshold).alias("is_contaminated"))


@query(f"WITH {_overlap_sql(13)} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM o WHERE overlap_score >= 0.8)")
def decontam_default_drop(spark, sf_dir):
    c = decontam.DecontamConfig()
    return decontam.decontaminate(_docs(spark, sf_dir), _index(spark, sf_dir, c), c).select("doc_id")


@query(_OVERLAP + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM o WHERE overlap_score >= 0.05)")
def decontam_drop(spark, sf_dir):
    return decontam.decontaminate(_docs(spark, sf_dir), _index(spark, sf_dir, _TEN), _TEN).select("doc_id")


@query(_OVERLAP + "SELECT doc_id, CASE WHEN overlap_score >= 0.05 THEN round(greatest(0.1, 1 - overlap_score), 6) ELSE 1.0 END AS sample_weight FROM documents LEFT JOIN o USING (doc_id)")
def decontam_downweight(spark, sf_dir):
    config = decontam.DecontamConfig(n=8, threshold=0.05, mode="downweight")
    out = decontam.decontaminate(_docs(spark, sf_dir), _index(spark, sf_dir, config), config)
    return out.select("doc_id", F.round("sample_weight", 6).alias("sample_weight"))


@query(_OVERLAP + "SELECT doc_id, CASE WHEN overlap_score >= 0.05 THEN 'tag' END AS action, CASE WHEN overlap_score >= 0.05 THEN eval_source END AS eval_source FROM documents LEFT JOIN o USING (doc_id)")
def decontam_tag(spark, sf_dir):
    config = decontam.DecontamConfig(n=8, threshold=0.05, mode="tag")
    out = decontam.decontaminate(_docs(spark, sf_dir), _index(spark, sf_dir, config), config)
    return out.select("doc_id", "contamination.action", "contamination.eval_source")


@query(_OVERLAP + "SELECT doc_id, md5(CASE WHEN overlap_score >= 0.05 THEN list_reduce(list_prepend(text, grams), lambda t, g: replace(t, g, '[REDACTED]')) ELSE text END) AS redacted FROM documents LEFT JOIN o USING (doc_id)")
def decontam_redact(spark, sf_dir):
    config = decontam.DecontamConfig(n=8, threshold=0.05, mode="redact")
    return decontam.decontaminate(_docs(spark, sf_dir), _index(spark, sf_dir, config), config).select("doc_id", F.md5("text").alias("redacted"))


@query(_OVERLAP + "SELECT eval_source, n AS docs_checked, count(*)::BIGINT AS docs_contaminated, round(count(*)::DOUBLE / n, 6) AS contamination_rate, count(*)::BIGINT AS dropped, 0::BIGINT AS tagged FROM o, (SELECT count(*)::BIGINT AS n FROM documents) WHERE overlap_score >= 0.05 GROUP BY GROUPING SETS ((eval_source, n), (n))")
def decontam_stats(spark, sf_dir):
    out = decontam.contamination_stats(_docs(spark, sf_dir), _index(spark, sf_dir, _TEN), _TEN)
    return out.select("eval_source", "docs_checked", "docs_contaminated", F.round("contamination_rate", 6).alias("contamination_rate"), "dropped", "tagged")


@query(_OVERLAP + "SELECT doc_id, eval_source, round(overlap_score, 6) AS overlap_score, matched, array_to_string(grams, '|') AS grams, left(text, 200) AS doc_preview, 'drop' AS action_taken FROM o JOIN documents USING (doc_id) WHERE overlap_score >= 0.05")
def decontam_audit(spark, sf_dir):
    return decontam.audit(_docs(spark, sf_dir), _index(spark, sf_dir, _TEN), _TEN).select(
        "doc_id", "eval_source", F.round("overlap_score", 6).alias("overlap_score"), "matched", F.array_join("matched_ngrams", "|").alias("grams"), "doc_preview", "action_taken"
    )


@query(
    f"SELECT doc_id, item_id FROM (SELECT doc_id, array_to_string({_LOW}, ' ') AS b FROM documents) d JOIN (SELECT item_id, array_to_string({_LOW.replace('text', 'question')}, ' ') AS q, len({_LOW.replace('text', 'question')}) AS n FROM eval_items) i ON n >= 8 AND contains(' ' || b || ' ', ' ' || q || ' ')"
)
def decontam_contains(spark, sf_dir):
    return decontam.contains_item(_docs(spark, sf_dir), _evaluation(spark, sf_dir))


# --- budgets and samples ---------------------------------------------------------------------------------

_COUNTED = f"(SELECT doc_id, source, len({_WORDS})::BIGINT AS n FROM documents)"


def _counted(spark, sf_dir):
    docs = annotate.with_token_count(_docs(spark, sf_dir)).select("doc_id", "source", "token_count")
    return docs.withColumn("slice_tags", F.when(F.col("source").isNotNull(), F.array(F.concat(F.lit("source="), "source"))).otherwise(F.array().cast("array<string>")))


@query(f"SELECT doc_id FROM (SELECT doc_id, sum(n) OVER (ORDER BY doc_id) AS t FROM {_COUNTED}) WHERE t <= 100000")
def token_budget(spark, sf_dir):
    return budget.within_budget(_counted(spark, sf_dir), 100_000).select("doc_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, sum(n) OVER (ORDER BY doc_id) - n AS t FROM {_COUNTED}) WHERE t < 100000")
def until_target(spark, sf_dir):
    return budget.until_target(_counted(spark, sf_dir), 100_000).select("doc_id")


_CAPS = {"source=crawl_main": 20_000, "source=web_arkadulo": 5_000, "source=wiki_ondrith": 0}
_CAP_SQL = "CASE source WHEN 'crawl_main' THEN 20000 WHEN 'web_arkadulo' THEN 5000 WHEN 'wiki_ondrith' THEN 0 ELSE 1e18 END"


@query(f"SELECT doc_id FROM (SELECT doc_id, source, sum(n) OVER (PARTITION BY source ORDER BY doc_id) - n AS t FROM {_COUNTED}) WHERE t < {_CAP_SQL}")
def slice_caps(spark, sf_dir):
    return budget.capped(_counted(spark, sf_dir), _CAPS).select("doc_id")


@query(f"""WITH a AS (SELECT doc_id, n, coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id) - n < {_CAP_SQL}, true) AS ok FROM {_COUNTED}),
b AS (SELECT *, coalesce(sum(CASE WHEN ok THEN n ELSE 0 END) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM a)
SELECT doc_id FROM b WHERE ok AND doc_id < (SELECT coalesce(min(doc_id), 9223372036854775807) FROM b WHERE t + n > 150000)""")
def caps_and_budget(spark, sf_dir):
    return budget.capped_within_budget(_counted(spark, sf_dir), _CAPS, 150_000).select("doc_id")


@query("""SELECT doc_id FROM documents WHERE source IS NOT NULL ORDER BY -ln((('0x' || substr(md5('42:' || doc_id), 1, 12))::BIGINT + 1) / (281474976710656.0::DOUBLE + 1)) /
  CASE source WHEN 'crawl_main' THEN 3.0 WHEN 'web_arkadulo' THEN 0.5 ELSE 1.0 END, doc_id LIMIT 200""")
def weighted_sample(spark, sf_dir):
    """The number of documents drawn is the operator's argument."""
    return budget.weighted_sample(_counted(spark, sf_dir), 200, {"source=crawl_main": 3.0, "source=web_arkadulo": 0.5}).select("doc_id")


@query("""WITH u AS (SELECT doc_id, split_part(source, '_', 1) AS domain, (('0x' || substr(md5('42:' || doc_id), 1, 12))::BIGINT + 1) / (281474976710656.0::DOUBLE + 1) AS u FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY u, doc_id) AS k FROM u)
SELECT doc_id, domain FROM r WHERE k <= CASE domain WHEN 'web' THEN 150 WHEN 'wiki' THEN 90 WHEN 'code' THEN 60 ELSE 0 END ORDER BY u, doc_id LIMIT 300""")
def ratio_mix(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", F.split("source", "_")[0].alias("domain"))
    return budget.ratio_mix(docs, {"web": 0.5, "wiki": 0.3, "code": 0.2}, 300).select("doc_id", "domain")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS position FROM documents")
def training_order(spark, sf_dir):
    """The position of each document in the shuffled order."""
    return tables.training_order(_docs(spark, sf_dir), 7, "doc_id").select("doc_id", "position")


@query("""SELECT s.shard_id, s.stated::BIGINT AS stated, coalesce(d.n, 0)::BIGINT AS actual FROM (SELECT shard_id, max(doc_count) AS stated FROM shards GROUP BY shard_id) s LEFT JOIN (SELECT shard_id, count(*) AS n FROM documents GROUP BY shard_id) d USING (shard_id)""")
def shard_counts(spark, sf_dir):
    """Documents of each registered shard against its manifest entry."""
    stated = table(spark, sf_dir, "shards").groupBy("shard_id").agg(F.max("doc_count").alias("stated"))
    actual = _docs(spark, sf_dir).groupBy("shard_id").agg(F.count("*").alias("n"))
    return stated.join(actual, "shard_id", "left").select("shard_id", "stated", F.coalesce("n", F.lit(0)).alias("actual"))


# --- evaluation, search, attribution ---------------------------------------------------------------------

_EVAL = """(SELECT l_suppkey % 50 AS run_id, l_returnflag || l_linestatus AS task, avg(l_discount) * 10 AS score, avg(l_discount) * 10 - stddev_samp(l_discount) AS ci_low, avg(l_discount) * 10 + stddev_samp(l_discount) AS ci_high FROM lineitem GROUP BY 1, 2)"""


def _scores(spark, sf_dir):
    d = F.avg("l_discount") * 10
    by = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("run_id"), F.concat("l_returnflag", "l_linestatus").alias("task"))
    return by.agg(d.alias("score"), (d - F.stddev_samp("l_discount")).alias("ci_low"), (d + F.stddev_samp("l_discount")).alias("ci_high"))


@query(f"""SELECT run_id, round(sum(score * w) / sum(w), 6) AS score_total, round(sum(score * w) / sum(w) - 1.96 * sqrt(sum(power(w * (ci_high - ci_low) / 3.92, 2))) / sum(w), 6) AS ci_low,
  round(sum(score * w) / sum(w) + 1.96 * sqrt(sum(power(w * (ci_high - ci_low) / 3.92, 2))) / sum(w), 6) AS ci_high, count(*)::BIGINT AS num_tasks
FROM (SELECT *, CASE task WHEN 'AF' THEN 2.0 WHEN 'NO' THEN 0.5 ELSE 1.0 END AS w FROM {_EVAL}) GROUP BY run_id""")
def eval_weighted_mean(spark, sf_dir):
    weights = spark.createDataFrame([("AF", 2.0), ("NO", 0.5)], "task string, weight double")
    out = evals.aggregate_scores(_scores(spark, sf_dir), weights)
    return out.select("run_id", F.round("score_total", 6).alias("score_total"), F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"), "num_tasks")


@query(f"SELECT run_id, round(exp(avg(ln(greatest(score, 1e-10)))), 6) AS score_total FROM {_EVAL} GROUP BY run_id")
def eval_geometric_mean(spark, sf_dir):
    return evals.aggregate_scores(_scores(spark, sf_dir), method="geometric_mean").select("run_id", F.round("score_total", 6).alias("score_total"))


_TRIALS = "(SELECT p_partkey AS trial_id, p_retailprice AS score, p_size::DOUBLE AS compute_cost, (p_partkey * 7919 % 1000) * 1000000 AS dataset_tokens, (p_partkey % 13) / 1000.0 AS contamination_rate, (p_partkey % 10) / 10.0 AS diversity_score FROM part)"


def _trials(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("trial_id"), F.col("p_retailprice").alias("score"), F.col("p_size").cast("double").alias("compute_cost"), (k * 7919 % 1000 * 1_000_000).alias("dataset_tokens"),
        (k % 13 / 1000.0).alias("contamination_rate"), (k % 10 / 10.0).alias("diversity_score"),
    )


_LIMITS = search.Constraints(30.0, 0.01, 200_000_000, 0.3)
_VIOLATION = "greatest(compute_cost - 30, 0) + greatest(contamination_rate - 0.01, 0) + greatest(200000000 - dataset_tokens, 0) + greatest(0.3 - diversity_score, 0)"


_NORMALIZED = "greatest(compute_cost - 30, 0) / 30 + greatest(contamination_rate - 0.01, 0) / 0.01 + greatest(200000000 - dataset_tokens, 0) / 200000000 + greatest(0.3 - diversity_score, 0) / 0.3"
_NAMES = "array_to_string(list_filter([CASE WHEN compute_cost > 30 THEN 'compute_hours' END, CASE WHEN contamination_rate > 0.01 THEN 'contamination_rate' END, CASE WHEN dataset_tokens < 200000000 THEN 'dataset_tokens' END, CASE WHEN diversity_score < 0.3 THEN 'diversity_score' END], lambda x: x IS NOT NULL), '|')"


@query(f"SELECT trial_id, {_VIOLATION} = 0 AS is_feasible, round({_VIOLATION}, 4) AS total_violation, round(score - 2 * ({_NORMALIZED}), 4) AS penalized_score, {_NAMES} AS violated FROM {_TRIALS}")
def trial_constraints(spark, sf_dir):
    out = search.penalized(_trials(spark, sf_dir), _LIMITS, 2.0)
    names = F.array_join(F.transform("violations", lambda v: v["constraint"]), "|")
    return out.select("trial_id", "is_feasible", F.round("total_violation", 4).alias("total_violation"), F.round("penalized_score", 4).alias("penalized_score"), names.alias("violated"))


@query(f"SELECT trial_id FROM {_TRIALS} ORDER BY score DESC, trial_id LIMIT 25")
def trial_top(spark, sf_dir):
    """The number of trials is the operator's argument."""
    return search.top_trials(_trials(spark, sf_dir), 25).select("trial_id")


@query(f"SELECT trial_id FROM {_TRIALS} WHERE {_VIOLATION} = 0")
def trial_feasible(spark, sf_dir):
    return search.feasible(_trials(spark, sf_dir), _LIMITS).select("trial_id")


@query(f"SELECT trial_id FROM {_TRIALS} ORDER BY ({_VIOLATION} = 0) DESC, CASE WHEN {_VIOLATION} = 0 THEN -score ELSE {_VIOLATION} END, trial_id LIMIT 50")
def trial_ranking(spark, sf_dir):
    """The first trials of the ranking."""
    return search.feasibility_first(_trials(spark, sf_dir), _LIMITS).limit(50).select("trial_id")


@query(f"SELECT a.trial_id, NOT EXISTS (SELECT 1 FROM {_TRIALS} b WHERE b.score >= a.score AND b.compute_cost <= a.compute_cost AND b.dataset_tokens >= a.dataset_tokens AND (b.score > a.score OR b.compute_cost < a.compute_cost OR b.dataset_tokens > a.dataset_tokens)) AS is_pareto FROM {_TRIALS} a")
def trial_pareto(spark, sf_dir):
    return search.pareto(_trials(spark, sf_dir))


@query(f"SELECT trial_id, level FROM (SELECT *, compute_cost::INT % 7 AS level FROM {_TRIALS}) QUALIFY row_number() OVER (PARTITION BY level ORDER BY score DESC, trial_id) <= greatest(1, floor(count(*) OVER (PARTITION BY level) * 0.3 + 1e-9))")
def trial_promotion(spark, sf_dir):
    trials = _trials(spark, sf_dir).withColumn("level", F.col("compute_cost").cast("int") % 7)
    return search.promote(trials, 0.3).select("trial_id", "level")


@query("""SELECT event_id AS report_ord, prune FROM (SELECT event_id, (event_id % 1000 >= 100 AND value < 0.5 * max(value) OVER (ORDER BY event_id)) AS prune FROM events)""")
def trial_pruning(spark, sf_dir):
    reports = table(spark, sf_dir, "events").select(F.col("event_id").alias("report_ord"), F.col("user_id").alias("trial_id"), (F.col("event_id") % 1000).alias("step"), F.col("value").alias("score"))
    return search.pruned(reports).select("report_ord", "prune")


@query("""WITH l AS (SELECT user_id AS trial_id, list({'s': event_id, 'x': value} ORDER BY event_id, value) AS rows FROM events GROUP BY user_id)
SELECT trial_id, list_reduce(list_prepend({'best': 1e308::DOUBLE, 'bad': 0, 'stop': NULL::BIGINT}, list_transform(rows, lambda r: {'best': r.x, 'bad': 0, 'stop': r.s})),
  lambda a, r: CASE WHEN a.stop IS NOT NULL THEN a WHEN r.best < a.best - 0.01 THEN {'best': r.best, 'bad': 0, 'stop': NULL::BIGINT}
    ELSE {'best': a.best, 'bad': a.bad + 1, 'stop': CASE WHEN a.bad + 1 >= 3 THEN r.stop END} END).stop AS stop_step FROM l""")
def early_stopping(spark, sf_dir):
    reports = table(spark, sf_dir, "events").select(F.col("user_id").alias("trial_id"), F.col("event_id").alias("step"), F.col("value").alias("loss"))
    return search.early_stops(reports)


_COMP = "(SELECT run_id, slice, n::DOUBLE / sum(n) OVER (PARTITION BY run_id) AS token_fraction FROM (SELECT l_suppkey % 40 AS run_id, l_returnflag || l_linestatus AS slice, count(*) AS n FROM lineitem GROUP BY 1, 2))"
_RUNS = "(SELECT l_suppkey % 40 AS run_id, l_linestatus AS benchmark, avg(l_tax) AS score FROM lineitem GROUP BY 1, 2)"


def _compositions(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("run_id"), F.concat("l_returnflag", "l_linestatus").alias("slice")).agg(F.count("*").alias("n"))
    return n.select("run_id", "slice", (F.col("n") / F.sum("n").over(Window.partitionBy("run_id"))).alias("token_fraction"))


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("run_id"), F.col("l_linestatus").alias("benchmark")).agg(F.avg("l_tax").alias("score"))


@query(f"SELECT benchmark, slice, round(coalesce(corr(token_fraction, score), 0), 4) AS correlation FROM {_COMP} JOIN {_RUNS} USING (run_id) GROUP BY benchmark, slice HAVING count(*) > 1")
def correlations(spark, sf_dir):
    return attribution.correlations(_compositions(spark, sf_dir), _runs(spark, sf_dir))


@query()
def ridge_attribution(spark, sf_dir):
    return attribution.ridge_attribution(materialize(_compositions(spark, sf_dir)), materialize(_runs(spark, sf_dir)), n=200)


@query(f"SELECT run_id, " + ", ".join(f"round(coalesce(sum(CASE WHEN slice = '{s}' THEN token_fraction END), 0), 6) AS {s}" for s in ("AF", "NF", "NO", "RF")) + f" FROM {_COMP} GROUP BY run_id")
def feature_matrix(spark, sf_dir):
    wide = slices.feature_matrix(materialize(_compositions(spark, sf_dir)))
    return wide.select("run_id", *[(F.round(c, 6) if c in wide.columns else F.lit(0.0)).alias(c) for c in ("AF", "NF", "NO", "RF")])


# --- whole policies and streams --------------------------------------------------------------------------


@query(f"""WITH d AS (SELECT doc_id, lang, len({_WORDS}) AS n, sha256({_NORM}) AS h, length(coalesce(text, '')) AS size, length(regexp_replace(coalesce(text, ''), '[^\\p{{L}}]', '', 'g')) AS letters FROM documents),
k AS (SELECT * FROM d WHERE n >= 50 AND n <= 100000 AND letters::DOUBLE / size >= 0.6 QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1),
t AS (SELECT n, unnest(list_filter([CASE WHEN coalesce(lang, '') <> '' THEN 'lang=' || lang END, CASE WHEN n < 128 THEN 'token_bin=tiny' WHEN n < 512 THEN 'token_bin=small' WHEN n < 2048 THEN 'token_bin=medium' ELSE 'token_bin=large' END], lambda x: x IS NOT NULL)) AS slice FROM k)
SELECT slice, count(*)::BIGINT AS doc_count, sum(n)::BIGINT AS token_count FROM t GROUP BY slice""")
def flagship(spark, sf_dir):
    """Word count and letter filter, exact deduplication, tags, statistics per slice."""
    docs = _docs(spark, sf_dir).select("doc_id", "text", F.col("lang").alias("language"))
    good = quality.quality_filter(annotate.with_token_count(docs), quality.QualityConfig(rules=("min_words", "max_words", "alpha_ratio")))
    kept = dedup.exact_dedup(good)
    return slices.slice_stats(slices.assign_slices(kept)).select("slice", "doc_count", "token_count")


def _policy(method: str) -> policy.Policy:
    return policy.Policy("check", language="en", quality=policy.QualityPolicy(min_words=20), dedup=policy.DedupPolicy(method, "global"), decontam=policy.DecontamPolicy(ngram_size=8, overlap_threshold=0.05), max_tokens=10**12)


def _policy_sql(scope: str, first: str, caps: str = "", most: int | None = None) -> str:
    """CTEs f (documents that pass the filters), k (with what became of them) and x (those that statistics count)."""
    bins = "CASE WHEN n < 128 THEN 'token_bin=tiny' WHEN n < 512 THEN 'token_bin=small' WHEN n < 2048 THEN 'token_bin=medium' ELSE 'token_bin=large' END"
    certain = "CASE WHEN language_score >= 0.95 THEN 'lang_score_bin=very_high' WHEN language_score >= 0.85 THEN 'lang_score_bin=high' WHEN language_score >= 0.7 THEN 'lang_score_bin=medium' ELSE 'lang_score_bin=low' END"
    grade = "CASE WHEN q >= 0.8 THEN 'quality_bin=high' WHEN q >= 0.5 THEN 'quality_bin=medium' ELSE 'quality_bin=low' END"
    ok = f"sum(CASE WHEN live THEN n ELSE 0 END) OVER (PARTITION BY live, {bins} ORDER BY doc_id) - n < CASE {bins} {caps} ELSE 1e18 END" if caps else "true"
    end = f"(SELECT coalesce(min(doc_id), 9223372036854775807) FROM c WHERE live AND t + n > {most})" if most else "9223372036854775807"
    return f"""f AS MATERIALIZED (SELECT * REPLACE ({_all_masked_sql("text")} AS text), ['lang=en', {bins}, {certain}, {grade}] || CASE WHEN coalesce(dump, '') <> '' THEN ['dump=' || dump] ELSE [] END AS tags
  FROM (SELECT *, (word_rep + n + n + alpha) / 4 AS q FROM (SELECT *, len(w) AS n, CASE WHEN len(w) < 10 THEN 0.0 ELSE list_max(map_values(list_aggregate(w, 'histogram')))::DOUBLE / len(w) END AS word_rep,
    length(regexp_replace(text, '[^\\p{{L}}]', '', 'g'))::DOUBLE / length(text) AS alpha FROM (SELECT *, {_WORDS} AS w FROM {_language_sql("documents")} WHERE language = 'en' AND language_score >= 0.65)))
  WHERE n BETWEEN 20 AND 100000 AND word_rep <= 0.2 AND alpha >= 0.6),
g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {scope}, sha256({_NORM}) ORDER BY {first}) > 1 AS dedup_dropped FROM f),
{_overlap_sql(8, "(SELECT * FROM g WHERE NOT dedup_dropped)")},
k AS (SELECT g.*, coalesce(overlap_score, 0) >= 0.05 AS decontam_dropped FROM g LEFT JOIN o USING (doc_id)),
a AS (SELECT *, NOT dedup_dropped AND NOT decontam_dropped AS live FROM k), b AS (SELECT *, live AND {ok} AS chosen FROM a),
c AS (SELECT *, coalesce(sum(CASE WHEN chosen THEN n ELSE 0 END) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM b),
x AS (SELECT * FROM c WHERE (chosen OR NOT live) AND doc_id < {end})"""


_POLICY_STATS = """SELECT slice, count(*) FILTER (chosen)::BIGINT AS doc_count, coalesce(sum(n) FILTER (chosen), 0)::BIGINT AS token_count,
  round(coalesce(avg(q) FILTER (chosen), 0), 2) AS avg_quality_score, count(*) FILTER (dedup_dropped)::BIGINT AS dedup_dropped, count(*) FILTER (decontam_dropped)::BIGINT AS decontam_dropped
FROM (SELECT *, unnest(tags) AS slice FROM x) GROUP BY slice"""


def _policy(method: str, scope: str = "global", keep: str = "first", **more) -> policy.Policy:
    return policy.Policy(
        "check", language="en", quality=policy.QualityPolicy(min_words=20), dedup=policy.DedupPolicy(method, scope, keep_rule=keep), decontam=policy.DecontamPolicy(ngram_size=8, overlap_threshold=0.05),
        **{"max_tokens": 10**12, **more},
    )


def _policy_stats(done: policy.Curated) -> DataFrame:
    return done.slice_stats().select("slice", "doc_count", "token_count", F.round("avg_quality_score", 2).alias("avg_quality_score"), "dedup_dropped", "decontam_dropped")


@query()
def execute_policy(spark, sf_dir):
    """G5 with MinHash: the documents kept."""
    done = policy.execute(_docs(spark, sf_dir).drop("lang"), _policy("minhash"), _evaluation(spark, sf_dir))
    return done.documents.select("doc_id", "token_count", "language", F.array_join("slice_tags", "|").alias("tags"))


@query("WITH " + _policy_sql("1", "doc_id") + _POLICY_STATS)
def execute_policy_stats(spark, sf_dir):
    """G5 with exact deduplication: statistics per slice."""
    return _policy_stats(policy.execute(_docs(spark, sf_dir).drop("lang"), _policy("exact"), _evaluation(spark, sf_dir)))


@query("WITH " + _policy_sql("coalesce(nullif(dump, ''), 'unknown')", "length(text) DESC, doc_id DESC") + "SELECT doc_id, n::BIGINT AS token_count, md5(text) AS text, array_to_string(list_sort(tags), '|') AS tags FROM x WHERE chosen")
def policy_longest_per_dump(spark, sf_dir):
    """Within each dump the longest of equal texts, the last of ties."""
    done = policy.execute(_docs(spark, sf_dir).drop("lang"), _policy("exact", "per_dump", "longest"), _evaluation(spark, sf_dir))
    return done.documents.select("doc_id", "token_count", F.md5("text").alias("text"), F.array_join("slice_tags", "|").alias("tags"))


_SLICE_CAPS = {"token_bin=tiny": 2_000, "token_bin=medium": 30_000}


@query("WITH " + _policy_sql("1", "doc_id", "WHEN 'token_bin=tiny' THEN 2000 WHEN 'token_bin=medium' THEN 30000", 60_000) + _POLICY_STATS)
def policy_caps_stats(spark, sf_dir):
    """G5 with caps and a budget: documents after the one that ends the selection count nowhere."""
    done = policy.execute(_docs(spark, sf_dir).drop("lang"), _policy("exact", max_tokens=60_000, max_tokens_per_slice=_SLICE_CAPS), _evaluation(spark, sf_dir))
    return _policy_stats(done)


_SPOKEN = "repeat('the and of is was to in that it with for are ', (1 + vec_id % 5)::INT)"
_NEAR = "SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND a.vec_id % 3 = b.vec_id % 3 WHERE list_cosine_similarity(a.e, b.e) >= 0.9 - 1e-12"


@query(
    "WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN i <= 3 THEN x ELSE 0 END) AS e FROM embeddings), g AS MATERIALIZED (WITH RECURSIVE "
    + _greedy_sql("SELECT vec_id AS node FROM v", _NEAR)
    + f"""), p AS ({_NEAR}), c AS (SELECT node, CASE WHEN kept THEN node ELSE (SELECT min(a) FROM p JOIN g k ON k.node = p.a AND k.kept WHERE p.b = g.node) END AS cluster FROM g)
SELECT node AS doc_id, cluster::VARCHAR AS dedup_cluster_id, (12 * (1 + node % 5))::BIGINT AS token_count FROM c QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY length({_SPOKEN.replace('vec_id', 'node')}) DESC, node DESC) = 1"""
)
def policy_semantic_longest(spark, sf_dir):
    """Of each greedy cluster of a dump the longest text. Documents are made of the ids, vectors are the first three dimensions."""
    v = table(spark, sf_dir, "embeddings")
    made = v.select(F.col("vec_id").alias("doc_id"), F.expr(_SPOKEN).alias("text"), (F.col("vec_id") % 3).cast("string").alias("dump"), F.lit("en").alias("language"), F.lit(1.0).alias("language_score"))
    p = _policy("semantic", "per_dump", "longest")
    p.quality.enabled_rules, p.quality.min_words, p.decontam.enabled = ["min_words"], 1, False
    short = v.select(F.col("vec_id").alias("doc_id"), F.slice(F.col("embedding").cast("array<double>"), 1, 3).alias("embedding"))
    return policy.execute(made, p, embeddings=short).documents.select("doc_id", "dedup_cluster_id", "token_count")


@query(f"""WITH d AS (SELECT *, {_WORDS} AS w FROM {_language_sql("(SELECT * FROM documents ORDER BY doc_id LIMIT 1000)")}),
s AS (SELECT *, language = 'en' AND language_score >= 0.65 AS spoken, language = 'en' AND language_score >= 0.65 AND len(w) BETWEEN 20 AND 100000 AND (len(w) < 10 OR list_max(map_values(list_aggregate(w, 'histogram')))::DOUBLE / len(w) <= 0.2)
  AND length(regexp_replace(text, '[^\\p{{L}}]', '', 'g'))::DOUBLE / length(text) >= 0.6 AS good FROM d)
SELECT count(*)::BIGINT AS docs, count(*) FILTER (spoken)::BIGINT AS after_language, count(*) FILTER (good)::BIGINT AS after_quality, round(avg(len(w)) FILTER (good), 4) AS mean_tokens,
  round(count(*) FILTER (good)::DOUBLE / count(*), 4) AS retention, floor(count(*) FILTER (good)::DOUBLE / count(*) * 1e12 / (avg(len(w)) FILTER (good)))::BIGINT AS projected_tokens FROM s""")
def policy_dry_run(spark, sf_dir):
    """The first 1,000 documents are the operator's argument."""
    out = policy.dry_run(_docs(spark, sf_dir).drop("lang"), _policy("exact"), 1000)
    return out.withColumn("mean_tokens", F.round("mean_tokens", 4)).withColumn("projected_tokens", F.col("projected_tokens").cast("bigint"))


@query(f"SELECT count(*)::BIGINT AS n FROM (SELECT DISTINCT sha256({_NORM}) FROM documents)")
def stream_exact_dedup(spark, sf_dir):
    """Streaming deduplication, run to its end: the number of texts that passed."""
    from loamworks.streaming import stream_exact_dedup as dedup_stream

    source = _docs(spark, sf_dir)
    src, out, mark = (step_path(spark, f"stream-{k}") for k in ("in", "out", "mark"))
    # the rows without a time get one, so that the watermark keeps them
    source.select("doc_id", "text", F.coalesce("crawled_at", F.timestamp_seconds(F.lit(0))).alias("crawled_at")).write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema("doc_id bigint, text string, crawled_at timestamp").parquet(src)
    # the whole table is one batch of any age, so the watermark spans all of it
    run = dedup_stream(stream, delay="36500 days").writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out)
    run.awaitTermination()
    return spark.read.schema("doc_id bigint, text string, crawled_at timestamp, content_hash string").parquet(out).agg(F.count("*").alias("n"))
