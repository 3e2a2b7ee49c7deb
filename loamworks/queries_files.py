"""Registered queries of readers, writers, files and reports, with their SQL counterparts. Each writes what it reads to new paths of the shared folder."""

from __future__ import annotations

import json

from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from loamworks import storage
from loamworks.operators import annotate, budget, decontam, minhash, slices
from loamworks.plans import attribution, evals, pipeline, policy, release, search
from loamworks.queries import _COMP, _NWS, _OVERLAP, _TAGS, _TEN, _TRIALS, _WORDS, _WS, _compositions, _docs, _index, _sliced, _trials, query
from loamworks.session import materialize, step_path, table
from loamworks.sources import html, tables, warc
from loamworks.streaming import stream_minhash_dedup, stream_slice_stats, stream_within_caps

_STRIPPED = f"regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g')"
_FILLED = f"regexp_matches(coalesce(text, ''), '{_NWS}')"


# --- readers ---------------------------------------------------------------------------------------------


def _records(df, kind: str, headers: str, body):
    """Archive records as lines of a text file; a text may hold line ends itself."""
    head = F.concat(
        F.lit(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://site.example/"), F.col("doc_id").cast("string"), F.lit("\r\nWARC-Record-ID: <urn:doc:"), F.col("doc_id").cast("string"),
        F.lit(">\r\nContent-Length: "), F.octet_length(F.concat(F.lit(headers), body)).cast("string"), F.lit("\r\n\r\n" + headers),
    )
    return df.select(F.concat(head, body, F.lit("\r\n")).alias("value"))


@query(f"SELECT 'urn:doc:' || doc_id AS id, 'http://site.example/' || doc_id AS url, md5({_STRIPPED}) AS text, 'commoncrawl' AS source, 'wet' AS file_type, 'CC-MAIN-2024-10' AS dump FROM documents WHERE {_FILLED}")
def read_wet(spark, sf_dir):
    """Gzipped text archives."""
    path = step_path(spark, "CC-MAIN-2024-10")
    _records(_docs(spark, sf_dir).where("text IS NOT NULL"), "conversion", "", F.col("text")).write.option("compression", "gzip").text(path)
    return warc.read_warc(spark, path).select("id", "url", F.md5("text").alias("text"), "source", "file_type", "dump")


_PAGE = f"trim(regexp_replace(text, '{_WS}+', ' ', 'g'))"


@query(f"SELECT 'urn:doc:' || doc_id AS id, CASE WHEN length(t) >= 100 THEN md5(t) END AS text, CASE WHEN length(t) >= 100 THEN length(t) ELSE 0 END::INT AS text_length FROM (SELECT doc_id, {_PAGE} AS t FROM documents WHERE text IS NOT NULL)")
def read_warc_pages(spark, sf_dir):
    """Archived pages and their main text, without links of the menu."""
    path = step_path(spark, "pages")
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><head><title>t</title></head><body><nav><a href='/'>menu</a></nav><p>"), escaped, F.lit("</p><p><a href='/next'>the next page</a></p></body></html>"))
    _records(_docs(spark, sf_dir).where("text IS NOT NULL"), "response", "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n", page).write.text(path)
    pages = warc.read_warc(spark, path, "warc").withColumnRenamed("text", "html")
    return html.extract_text(pages).select("id", F.md5("text").alias("text"), "text_length")


@query("SELECT doc_id::VARCHAR AS id, md5(text) AS text, 'given' AS source, lang FROM documents")
def read_jsonl(spark, sf_dir):
    """JSON lines with names of their own for id and text."""
    path = step_path(spark, "jsonl")
    _docs(spark, sf_dir).select(F.col("doc_id").alias("key"), F.col("text").alias("content"), "lang").write.json(path)
    out = tables.read_documents(spark, path, "json", "content", "key", "given", schema="key bigint, content string, lang string")
    return out.select("id", F.md5("text").alias("text"), "source", "lang")


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, doc_id FROM documents")
def read_numbered(spark, sf_dir):
    """S1 without an id: the number of the row in the dataset."""
    path = step_path(spark, "sorted")
    _docs(spark, sf_dir).select("doc_id", "text").coalesce(1).sortWithinPartitions("doc_id").write.parquet(path)
    return tables.read_documents(spark, path).select(F.col("id").cast("bigint").alias("id"), "doc_id")


@query("SELECT least(count(*), 37)::BIGINT AS n, count(*) >= 37 AS enough FROM documents")
def read_limit(spark, sf_dir):
    """The limit is the reader's argument."""
    got = tables.read_documents(spark, f"{sf_dir}/documents.parquet", id_field="doc_id", limit=37).agg(F.count("*").alias("n"))
    return got.withColumn("enough", F.col("n") >= 37)


@query("SELECT DISTINCT lower(trim(source)) || '.example' AS domain FROM documents WHERE coalesce(trim(source), '') <> ''")
def blocklist_file(spark, sf_dir):
    """Lists in several files, with comments."""
    path = step_path(spark, "lists")
    names = _docs(spark, sf_dir).where("trim(source) <> ''").select(F.concat(F.trim("source"), F.lit(".EXAMPLE   # a source")).alias("value"), (F.col("doc_id") % 2).alias("k")).distinct()
    for k in (0, 1):
        names.where(F.col("k") == k).select("value").union(spark.createDataFrame([("# a comment",), ("",)], "value string")).write.text(f"{path}/part={k}")
    parts = [tables.load_blocklist(spark, f"{path}/part={k}") for k in (0, 1)]
    return parts[0].union(parts[1]).distinct()


# --- shards and manifests --------------------------------------------------------------------------------


def _dataset(spark, sf_dir, name: str = "dataset"):
    path = step_path(spark, name)
    tables.write_shards(_docs(spark, sf_dir).select("doc_id", "text"), storage.join(path, "data"), 300)
    return path


@query("SELECT count(*)::BIGINT AS documents, true AS small, true AS summed, true AS sized FROM documents")
def manifest_shards(spark, sf_dir):
    """Shards of at most 300 documents, their counts and checksums."""
    path = _dataset(spark, sf_dir)
    shards = tables.shard_manifest(spark, storage.join(path, "data"))
    return shards.agg(F.sum("doc_count").alias("documents"), (F.max("doc_count") <= 300).alias("small"), F.every(F.length("checksum") == 64).alias("summed"), F.every(F.col("size_bytes") > 0).alias("sized"))


@query("SELECT doc_id, md5(text) AS text FROM documents")
def manifest_documents(spark, sf_dir):
    """The documents of a saved manifest."""
    path = _dataset(spark, sf_dir)
    shards = tables.shard_manifest(spark, storage.join(path, "data"))
    named = shards.withColumn("path", F.concat(F.lit("data/"), "path"))
    tables.save_manifest(tables.make_manifest("d", named), storage.join(path, "manifest.json"))
    return tables.read_manifest(spark, storage.join(path, "manifest.json")).select("doc_id", F.md5("text").alias("text"))


@query("SELECT 'none' AS problem, 0::BIGINT AS n UNION ALL SELECT 'count', count(*) FROM (SELECT 1)")
def verify_shards(spark, sf_dir):
    """No problem in a release as written, one after a count in the manifest is changed."""
    path = _dataset(spark, sf_dir)
    shards = tables.shard_manifest(spark, storage.join(path, "data"))
    manifest = tables.make_manifest("d", shards)
    tables.save_manifest(manifest, storage.join(path, "manifest.json"))
    before = materialize(release.verify_release(spark, path))
    manifest["shards"][0]["doc_count"] += 1
    tables.save_manifest(manifest, storage.join(path, "manifest.json"))
    after = release.verify_release(spark, path)
    return before.agg(F.lit("none").alias("problem"), F.count("*").alias("n")).union(after.groupBy("problem").agg(F.count("*").alias("n")))


def _broken(spark, sf_dir):
    """JSON shards by source, in which every seventh document is cut off."""
    path = step_path(spark, "broken")
    line = F.to_json(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    rows = _docs(spark, sf_dir).select((F.col("doc_id") % 4).alias("k"), F.when(F.col("doc_id") % 7 == 0, F.left(line, F.length(line) - 2)).otherwise(line).alias("value"))
    rows.repartition(4, "k").select("value").write.text(path)
    return path


@query("SELECT count(*)::BIGINT AS rows, count(*) FILTER (doc_id % 7 = 0)::BIGINT AS corrupt FROM documents")
def validate_shards(spark, sf_dir):
    """S18."""
    out = tables.validate_shards(spark, _broken(spark, sf_dir), "doc_id bigint, text string")
    return out.where("problem = 'corrupt' OR problem IS NULL").agg(F.sum("rows").alias("rows"), F.sum("corrupt").alias("corrupt"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS text FROM documents WHERE doc_id % 7 <> 0")
def recover_shards(spark, sf_dir):
    """The rows that parse."""
    return tables.recover_shards(spark, _broken(spark, sf_dir), "doc_id bigint, text string").select("doc_id", F.md5("text").alias("text"))


@query("SELECT count(*) FILTER (doc_id % 7 <> 0)::BIGINT AS recovered, count(*) FILTER (doc_id % 7 = 0)::BIGINT AS lost FROM documents")
def recovered_counts(spark, sf_dir):
    return tables.recovered_counts(spark, _broken(spark, sf_dir), "doc_id bigint, text string").agg(F.sum("recovered").alias("recovered"), F.sum("lost").alias("lost"))


@query("SELECT true AS before, true AS kept, count(*)::BIGINT AS documents, false AS deleted FROM documents")
def artifact_store(spark, sf_dir):
    """An artifact exists once its manifest does, until it is deleted."""
    store = tables.ArtifactStore(step_path(spark, "store"))
    key = store.key("p", "c", "i")
    before = not store.exists(key)
    store.put(key, _docs(spark, sf_dir).select("doc_id", "text"))
    kept = store.list() == [key]
    n = spark.read.json(storage.join(store.path(key), "data")).count()
    store.delete(key)
    return spark.createDataFrame([(before, kept, n, store.exists(key))], "before boolean, kept boolean, documents bigint, deleted boolean")


@query("SELECT doc_id, length(text)::INT AS size, CASE WHEN doc_id % 2 = 0 THEN 'known' ELSE 'new' END AS told FROM documents")
def feature_cache(spark, sf_dir):
    """The second call computes only what the first one did not."""
    cache = tables.FeatureCache(spark, step_path(spark, "cache"))
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    # the cache holds size and who computed it
    feature = lambda told: lambda df: df.select("doc_id", F.struct(F.length("text").alias("size"), F.lit(told).alias("told")).alias("f"))
    cache.get_or_compute(docs.where("doc_id % 2 = 0"), "f", feature("known")).count()
    return cache.get_or_compute(docs, "f", feature("new")).select("doc_id", "f.size", "f.told")


@query("SELECT 'config' AS event, 1::BIGINT AS n UNION ALL SELECT 'metric', 2 UNION ALL SELECT 'artifact', 1")
def run_log(spark, sf_dir):
    """S17."""
    log = tables.RunLog(step_path(spark, "log"), "r")
    log.config({"path": sf_dir})
    log.metric("loss", 1.0, 1)
    log.metric("loss", 0.5, 2)
    log.artifact("data", sf_dir)
    return tables.RunLog.read(spark, log.path).groupBy("event").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, row_number() OVER (ORDER BY md5('5:' || doc_id), doc_id) - 1 AS position, array_to_string(list_slice({_WORDS}, 1, 512), ' ') AS tokens FROM documents")
def training_batches(spark, sf_dir):
    """S21 with the first 512 words of each document."""
    out = tables.training_order(_docs(spark, sf_dir), 5, "doc_id", 512)
    return out.select("doc_id", "position", F.array_join("tokens", " ").alias("tokens"))


@query("""SELECT doc_id, shard_id, md5('3:' || shard_id || ':' || doc_id) < coalesce(lead(md5('3:' || shard_id || ':' || doc_id)) OVER (PARTITION BY shard_id ORDER BY md5('3:' || shard_id || ':' || doc_id)), 'z') AS rising FROM documents WHERE shard_id IS NOT NULL""")
def streaming_order(spark, sf_dir):
    """Within each shard documents come in the order of a hash."""
    docs = _docs(spark, sf_dir).where("shard_id IS NOT NULL").select("doc_id", "shard_id")
    placed = materialize(tables.streaming_order(docs, 3, key="doc_id").withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    h = F.md5(F.concat_ws(":", F.lit("3"), F.col("shard_id").cast("string"), F.col("doc_id").cast("string")))
    after = F.lead(h).over(Window.partitionBy("shard_id").orderBy("_p", "_m"))
    return placed.select("doc_id", "shard_id", (h < F.coalesce(after, F.lit("z"))).alias("rising"))


# --- annotators and filters ------------------------------------------------------------------------------


@query("SELECT doc_id::VARCHAR AS id, md5(text) AS text, lang, source, n_chars FROM documents")
def document_round_trip(spark, sf_dir):
    """To id, text and metadata and back."""
    docs = annotate.to_document(_docs(spark, sf_dir).select("doc_id", "text", "lang", "source", "n_chars"), "doc_id")
    return annotate.from_document(docs, "lang string, source string, n_chars bigint").select("id", F.md5("text").alias("text"), "lang", "source", "n_chars")


@query(f"SELECT doc_id, len({_WORDS})::BIGINT AS token_count, upper(lang) AS language FROM documents WHERE source IS NOT NULL AND length(text) > 100")
def callables(spark, sf_dir):
    """P17, F21, 2.11: filters and maps given as functions, and a counter of tokens."""
    docs = annotate.apply_filter(annotate.apply_filter(_docs(spark, sf_dir), lambda df: F.length(df["text"]) > 100), F.col("source").isNotNull())
    return annotate.apply_map(annotate.with_token_count(docs), lambda df: df.withColumn("language", F.upper("lang"))).select("doc_id", "token_count", "language")


@query("SELECT doc_id, array_to_string(list_sort(list_filter(['size=' || (length(text) // 1000), CASE WHEN coalesce(lang, '') <> '' THEN 'language=' || lang END], lambda x: x IS NOT NULL)), '|') AS tags FROM documents")
def custom_slices(spark, sf_dir):
    """Rules registered by the user."""
    r = slices.SliceRegistry()
    r.register("size", lambda columns: F.array(F.concat(F.lit("size="), F.floor(F.length("text") / 1000).cast("string"))))
    r.register("language", lambda columns: F.array(F.when(F.coalesce("lang", F.lit("")) != "", F.concat(F.lit("language="), "lang"))))
    return slices.assign_slices(_docs(spark, sf_dir), r).select("doc_id", F.array_join("slice_tags", "|").alias("tags"))


@query("SELECT count(*)::BIGINT AS n FROM documents")
def observed_rows(spark, sf_dir):
    """Rows counted on the way through."""
    seen = Observation("seen")
    _docs(spark, sf_dir).select("doc_id", "text").observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"],)], "n bigint")


@query(_OVERLAP + "SELECT doc_id FROM o WHERE overlap_score >= 0.05")
def flagged_ids(spark, sf_dir):
    """Ids of flagged documents as a text file."""
    path = step_path(spark, "flagged")
    found = decontam.overlaps(_docs(spark, sf_dir), _index(spark, sf_dir, _TEN), _TEN).where(F.col("overlap_score") >= _TEN.threshold)
    decontam.flagged_ids(found, path)
    return spark.read.text(path).select(F.col("value").cast("bigint").alias("doc_id"))


@query(f"SELECT doc_id, len(w)::BIGINT AS token_count FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) BETWEEN 20 AND 500")
def pipeline_blocks(spark, sf_dir):
    """G7 and 2.11: blocks from a configuration; the last one writes JSON lines."""
    path = step_path(spark, "piped")
    blocks = [
        {"type": "reader", "name": "parquet", "params": {"path": f"{sf_dir}/documents.parquet", "id_field": "doc_id"}}, {"type": "filter", "name": "length", "params": {"low": 20, "high": 500}},
        {"type": "mapper", "name": "token_count"}, {"type": "writer", "name": "jsonl", "params": {"path": path}},
    ]
    pipeline.run_pipeline(spark, {"pipeline": {"blocks": blocks}})
    return spark.read.schema("id string, token_count bigint").json(path).select(F.col("id").cast("bigint").alias("doc_id"), "token_count")


@query("SELECT count(*) FILTER (shard_id % 3 = 0)::BIGINT AS documents, 'done, skipped' AS states FROM documents")
def resumed_shards(spark, sf_dir):
    """A second run leaves what the first one wrote."""
    path, out = step_path(spark, "input"), step_path(spark, "output")
    _docs(spark, sf_dir).where("shard_id % 3 = 0").select("doc_id", "text").write.parquet(path)
    states = [pipeline.run_shards(spark, {"s": path}, lambda df: df.select("doc_id"), out)["s"] for _ in range(2)]
    return spark.read.parquet(f"{out}/s").agg(F.count("*").alias("documents"), F.lit(", ".join(states)).alias("states"))


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de') UNION ALL SELECT doc_id, NULL FROM documents WHERE lang = 'fr'")
def union_readers(spark, sf_dir):
    """A second reader adds its rows; columns that it lacks are null."""
    paths = [step_path(spark, "u") for _ in range(2)]
    docs = _docs(spark, sf_dir)
    docs.where("lang IN ('en', 'de')").select("doc_id", "text", "lang").write.parquet(paths[0])
    docs.where("lang = 'fr'").select("doc_id", "text").write.parquet(paths[1])
    blocks = [{"type": "reader", "name": "parquet", "params": {"path": p, "id_field": "doc_id"}} for p in paths]
    return pipeline.run_pipeline(spark, {"pipeline": {"blocks": blocks}}).select(F.col("id").cast("bigint").alias("doc_id"), "lang")


# --- statistics, samples, evaluation ---------------------------------------------------------------------

_HALVES = "CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END"


@query(f"""WITH t AS (SELECT {_HALVES} AS run_id, unnest(tags) AS slice, token_count FROM {_TAGS}), a AS (SELECT {_HALVES} AS run_id, sum(token_count) AS n, count(*) AS d FROM {_TAGS} GROUP BY 1)
SELECT run_id, slice, round(coalesce(sum(token_count), 0)::DOUBLE / any_value(n), 6) AS token_fraction, round(count(*)::DOUBLE / any_value(d), 6) AS doc_fraction FROM t JOIN a USING (run_id) GROUP BY run_id, slice""")
def collected_compositions(spark, sf_dir):
    """Compositions from the statistics saved beside the manifests of two runs; a folder without a manifest is passed over."""
    rows = materialize(_sliced(spark, sf_dir))
    folders = [step_path(spark, "run") for _ in range(3)]
    for folder, half, k in zip(folders, ("even", "odd"), (0, 1), strict=False):
        part = rows.where(F.col("doc_id") % 2 == k)
        slices.save_stats(slices.slice_stats(part), slices.total_stats(part), storage.join(folder, "slice_stats.json"))
        tables.save_manifest({"dataset_id": half, "shards": []}, storage.join(folder, "manifest.json"))
    out = slices.collect_compositions(spark, folders)
    return out.select("run_id", "slice", F.round("token_fraction", 6).alias("token_fraction"), F.round("doc_fraction", 6).alias("doc_fraction"))


@query(f"""WITH s AS (SELECT slice, coalesce(sum(token_count), 0) AS n FROM (SELECT unnest(tags) AS slice, token_count FROM {_TAGS}) GROUP BY slice), t AS (SELECT *, n / sum(n) OVER () AS share FROM s)
SELECT CASE WHEN share < 0.02 THEN 'other' ELSE slice END AS slice, sum(n)::BIGINT AS token_count, round(sum(n)::DOUBLE / (SELECT sum(n) FROM s), 6) AS share FROM t GROUP BY 1""")
def small_slices(spark, sf_dir):
    """Slices of little weight together."""
    return release.slices_for_plot(slices.slice_stats(_sliced(spark, sf_dir))).withColumn("share", F.round("share", 6))


@query("""SELECT doc_id FROM documents WHERE source IS NOT NULL ORDER BY -ln((('0x' || substr(md5('42:' || doc_id), 1, 12))::BIGINT + 1) / (281474976710656.0::DOUBLE + 1)) /
  CASE source WHEN 'crawl_main' THEN sqrt(9.0) WHEN 'web_arkadulo' THEN sqrt(0.25) ELSE 1.0 END, doc_id LIMIT 150""")
def tempered_sample(spark, sf_dir):
    """A temperature of 2 takes the square roots of the weights."""
    docs = _docs(spark, sf_dir).select("doc_id", F.when(F.col("source").isNotNull(), F.array(F.concat(F.lit("source="), "source"))).otherwise(F.array().cast("array<string>")).alias("slice_tags"))
    return budget.weighted_sample(docs, 150, {"source=crawl_main": 9.0, "source=web_arkadulo": 0.25}, temperature=2.0).select("doc_id")


@query("""SELECT run_id, task, round(score, 6) AS score, round(score - 1.96 * err, 6) AS ci_low, round(score + 1.96 * err, 6) AS ci_high FROM (
SELECT l_suppkey % 20 AS run_id, l_returnflag AS task, avg(l_discount) AS score, avg(l_tax) AS err FROM lineitem GROUP BY 1, 2)""")
def harness_results(spark, sf_dir):
    """A10: results in the JSON of a harness; of several metrics the preferred one counts."""
    by = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("run_id"), F.col("l_returnflag").alias("task")).agg(F.avg("l_discount").cast("double").alias("acc_norm"), F.avg("l_tax").cast("double").alias("acc_norm_stderr"))
    one = F.map_from_entries(F.collect_list(F.struct("task", F.struct(F.lit(0.5).alias("acc"), "acc_norm", "acc_norm_stderr"))))
    results = by.groupBy("run_id").agg(F.to_json(F.struct(one.alias("results"))).alias("results"))
    out = evals.parse_harness(results)
    return out.select("run_id", "task", *[F.round(c, 6).alias(c) for c in ("score", "ci_low", "ci_high")])


@query("""SELECT run_id, tokens, steps, (6.0 * 1000000 * tokens)::DOUBLE AS flops, round(tokens / seconds, 4) AS tokens_per_second, round(seconds / 3600, 6) AS hours, seconds / 3600 <= 1.5 AS within_budget
FROM (SELECT l_suppkey % 20 AS run_id, sum(l_orderkey)::BIGINT AS tokens, count(*)::BIGINT AS steps, sum(l_quantity)::DOUBLE AS seconds FROM lineitem GROUP BY 1)""")
def compute_summary(spark, sf_dir):
    """A15."""
    steps = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("run_id"), F.col("l_orderkey").alias("tokens"), F.col("l_quantity").cast("double").alias("seconds"))
    out = evals.compute_summary(steps, 1_000_000, 1.5)
    return out.select("run_id", "tokens", "steps", "flops", F.round("tokens_per_second", 4).alias("tokens_per_second"), F.round("hours", 6).alias("hours"), "within_budget")


@query("SELECT name, round(sum(s), 4) AS total_s, round(avg(s), 4) AS mean_s, count(*)::BIGINT AS calls, max(m) AS max_memory_mb FROM (SELECT l_returnflag || l_linestatus AS name, l_quantity::DOUBLE AS s, l_extendedprice::DOUBLE AS m FROM lineitem) GROUP BY name")
def section_profile(spark, sf_dir):
    """A14 and G31."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("name"), F.col("l_quantity").cast("double").alias("seconds"), F.col("l_extendedprice").cast("double").alias("memory_mb"))
    return evals.section_profile(rows).withColumn("total_s", F.round("total_s", 4)).withColumn("mean_s", F.round("mean_s", 4))


@query(f"SELECT run_id, round(max(token_fraction), 6) AS score_total FROM {_COMP} GROUP BY run_id")
def registered_aggregator(spark, sf_dir):
    """2.11: an aggregate of the user's."""
    evals.register_aggregator("greatest", lambda score, weight: F.max(score))
    scores = _compositions(spark, sf_dir).select("run_id", F.col("slice").alias("task"), F.col("token_fraction").alias("score"), F.lit(None).cast("double").alias("ci_low"), F.lit(None).cast("double").alias("ci_high"))
    return evals.aggregate_scores(scores, method="greatest").select("run_id", F.round("score_total", 6).alias("score_total"))


@query(f"SELECT trial_id, is_pareto, score FROM (SELECT a.trial_id, score, NOT EXISTS (SELECT 1 FROM {_TRIALS} b WHERE b.score >= a.score AND b.compute_cost <= a.compute_cost AND b.dataset_tokens >= a.dataset_tokens AND (b.score > a.score OR b.compute_cost < a.compute_cost OR b.dataset_tokens > a.dataset_tokens)) AS is_pareto FROM {_TRIALS} a)")
def saved_frontier(spark, sf_dir):
    """A frontier written as JSON and read again."""
    path = step_path(spark, "frontier")
    search.save_frontier(_trials(spark, sf_dir).withColumn("score", F.col("score").cast("double")), path)
    return search.load_frontier(spark, path).select("trial_id", "is_pareto", "score")


@query("""WITH w AS (SELECT l_returnflag || l_linestatus AS slice, sum(l_quantity)::DOUBLE AS w FROM lineitem GROUP BY 1), t AS (SELECT sum(w) AS t, sum(w * w) AS q FROM w)
SELECT slice, round(q / t, 4) AS baseline, round((q - w * w) / (t - w), 4) AS score, round((q - w * w) / (t - w) - q / t, 4) AS delta FROM w, t""")
def ablations(spark, sf_dir):
    """Each slice left out in turn, scored by a function."""
    w = {r["s"]: float(r["w"]) for r in table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("s")).agg(F.sum("l_quantity").alias("w")).collect()}
    rows = attribution.ablation_study(w, lambda x: sum(v * v for v in x.values()) / sum(x.values()))
    return spark.createDataFrame([(r["slice"], round(r["baseline"], 4), round(r["score"], 4), round(r["delta"], 4)) for r in rows], "slice string, baseline double, score double, delta double")


@query("SELECT benchmark, row_number() OVER (ORDER BY s DESC, benchmark) AS place FROM (SELECT l_returnflag || l_linestatus AS benchmark, round(avg(l_discount), 10) AS s FROM lineitem GROUP BY 1)")
def report_order(spark, sf_dir):
    """The report lists benchmarks best first."""
    scores = table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("benchmark")).agg(F.round(F.avg("l_discount"), 10).alias("score"))
    lines = [x.split("|")[1].strip() for x in release.experiment_report("t", scores).splitlines() if x.startswith("| ") and "---" not in x]
    return spark.createDataFrame([(b, k) for k, b in enumerate(lines[1:], 1)], "benchmark string, place bigint")


@query("SELECT 'max_tokens' AS path, 'changed' AS change UNION ALL SELECT 'slice_weights.a', 'removed' UNION ALL SELECT 'slice_weights.c', 'added' UNION ALL SELECT 'dedup.method', 'changed'")
def policy_differences(spark, sf_dir):
    """Fields of two policies, after a round trip through YAML."""
    a = policy.Policy("p", slice_weights={"a": 1.0, "b": 2.0}, max_tokens=10)
    b = policy.Policy("p", slice_weights={"b": 2.0 + 1e-9, "c": 1.0}, max_tokens=20, dedup=policy.DedupPolicy("exact"))
    paths = [step_path(spark, "policy") for _ in (a, b)]
    for p, path in zip((a, b), paths, strict=True):
        policy.save_policy(p, path)
    a, b = (policy.load_policy(p) for p in paths)
    return spark.createDataFrame([(d["path"], d["change"]) for d in release.policy_diff(a, b)], "path string, change string")


@query("SELECT true AS same, true AS other, true AS keyed")
def policy_hashes(spark, sf_dir):
    """Equal content has one hash whatever the order of keys."""
    a, b = policy.Policy("p", slice_weights={"x": 1.0, "y": 2.0}), policy.Policy("p", slice_weights={"y": 2.0, "x": 1.0})
    other, keyed = not policy.same_policy(a, policy.Policy("q")), policy.reproducibility_key(a, "i", "c") != policy.reproducibility_key(a, "i", "d")
    return spark.createDataFrame([(policy.same_policy(a, b), other, keyed)], "same boolean, other boolean, keyed boolean")


@query()
def random_search(spark, sf_dir):
    """The trials drawn, best first."""
    space = [search.Parameter("n", "int", low=1, high=1000, log=True), search.Parameter("k", "categorical", choices=("a", "b"))]
    found = search.random_search(space, lambda c: {"score": float(c["n"]), "dataset_tokens": 10**10}, 30)
    return spark.createDataFrame([(t.trial_id, t.score, json.dumps(t.config), k) for k, t in enumerate(found)], "trial_id bigint, score double, config string, place int")


# --- streams ---------------------------------------------------------------------------------------------


def _stream(spark, df, schema: str):
    path = step_path(spark, "stream")
    df.write.parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)


@query(f"SELECT slice, count(*)::BIGINT AS doc_count, coalesce(sum(token_count), 0)::BIGINT AS token_count FROM (SELECT unnest(tags) AS slice, token_count FROM {_TAGS}) GROUP BY slice")
def stream_stats(spark, sf_dir):
    """2.10: running statistics, as they stand at the end of the stream."""
    rows = _stream(spark, _sliced(spark, sf_dir).select("doc_id", "slice_tags", "token_count"), "doc_id bigint, slice_tags array<string>, token_count bigint")
    run = stream_slice_stats(rows).writeStream.format("memory").queryName(name := "s" + step_path(spark, "q").rsplit("-", 1)[1]).outputMode("complete").option("checkpointLocation", step_path(spark, "mark")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select("slice", "doc_count", "token_count")


@query(f"""WITH c AS (SELECT coalesce(source, '') AS source, len({_WORDS}) AS n FROM documents), s AS (SELECT source, sum(n) AS total, max(n) AS largest FROM c GROUP BY source)
SELECT source, true AS capped, true AS filled FROM s WHERE total > 0""")
def stream_caps(spark, sf_dir):
    """2.10: documents of a stream up to a cap of tokens for each source; which ones depends on their arrival, their total does not."""
    docs = annotate.with_token_count(_docs(spark, sf_dir)).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "token_count").repartition(6)
    rows, out = _stream(spark, docs, "doc_id bigint, source string, token_count bigint"), step_path(spark, "out")
    run = stream_within_caps(rows, "source", 5000).writeStream.format("parquet").outputMode("append").option("checkpointLocation", step_path(spark, "mark")).trigger(availableNow=True).start(out)
    run.awaitTermination()
    got = spark.read.schema("source string, doc_id bigint, token_count bigint, tokens_before bigint").parquet(out).groupBy("source").agg(F.sum("token_count").alias("t"), F.max("tokens_before").alias("b"))
    whole = docs.groupBy("source").agg(F.sum("token_count").alias("total")).where("total > 0")
    # a document is let through while the total before it is below the cap
    return whole.join(got, "source").select("source", (F.col("b") < 5000).alias("capped"), (F.col("t") >= F.least(F.lit(5000), F.col("total"))).alias("filled"))


@query("SELECT true AS some_kept, true AS some_dropped, true AS no_two_share")
def stream_minhash(spark, sf_dir):
    """2.10: MinHash of a stream with the bands seen as state: no two documents let through share a band."""
    docs = materialize(_docs(spark, sf_dir).select("doc_id", "text"))
    rows, out = _stream(spark, docs.repartition(6), "doc_id bigint, text string"), step_path(spark, "out")
    write = lambda batch, epoch: batch.select("doc_id").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
    stream_minhash_dedup(rows, step_path(spark, "bands"), write).option("checkpointLocation", step_path(spark, "mark")).trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.schema("doc_id bigint").parquet(f"{out}/*")
    bands = minhash.band_hashes(docs.join(kept, "doc_id", "left_semi"), "doc_id")
    most = bands.groupBy("band", "band_hash").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"), F.sum("n").alias("all"))
    n = F.lit(docs.count() * minhash.MinHashConfig().bands)
    return most.select((F.col("all") > 0).alias("some_kept"), (F.col("all") < n).alias("some_dropped"), (F.col("n") <= 1).alias("no_two_share"))
