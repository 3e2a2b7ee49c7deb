import gzip
import math
import pathlib
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamworks.operators import annotate, budget, decontam, dedup, masking, minhash, quality, semantic, slices, urls
from loamworks.operators.components import connected_components, follow_parents
from loamworks.operators.prefix import running_total_by_order
from loamworks.plans import attribution, evals, pipeline, policy, release, search
from loamworks.sources import html, tables, warc

DOCS = "doc_id bigint, text string, dump string"


def docs(spark, *texts, dump=None):
    return spark.createDataFrame([(i, t, dump) for i, t in enumerate(texts)], DOCS)


def ids(df, c="doc_id"):
    return sorted(r[c] for r in df.select(c).collect())


# quality


def scores(spark, text):
    r = quality.with_quality(docs(spark, text)).first()
    return r["quality_scores"].asDict(), r["quality_failed"]


def test_quality_edges(spark):
    s, failed = scores(spark, "")
    assert s["min_words"] == 0 and failed == ["min_words"]
    assert scores(spark, None)[1] == ["min_words"]
    assert scores(spark, "a " * 9)[0]["word_rep"] == 0 and scores(spark, "a " * 10)[0]["word_rep"] == 1
    assert scores(spark, "x\nx")[0]["line_rep"] == 0 and scores(spark, "x\nx\nx")[0]["line_rep"] == pytest.approx(2 / 3)
    assert scores(spark, "a" * 99)[0]["char_rep"] == 0
    assert scores(spark, "a" * 500)[0]["char_rep"] == pytest.approx(10 / 500)
    s, _ = scores(spark, "One line.\nno end\n* item…\n{12}")
    assert (s["sentence_end"], s["ellipsis"], s["bullet"]) == (0.25, 0.25, 0.25)
    assert s["curly_brace"] == pytest.approx(2 / 29) and s["digit_ratio"] == pytest.approx(2 / 29)


def test_quality_rules_can_be_chosen_and_unknown_ones_fail(spark):
    df = docs(spark, "short text")
    assert quality.quality_filter(df, quality.QualityConfig(rules=("alpha_ratio",))).count() == 1
    with pytest.raises(ValueError):
        quality.with_quality(df, quality.QualityConfig(rules=("nope",)))
    assert quality.length_filter(docs(spark, "a b", "a b c", None), 2, 2).count() == 1


def test_masks(spark):
    df = docs(spark, "mail a.b@c.example and 8.8.8.8, 10.0.0.1, 192.168.1.1, 172.16.0.1, 172.32.0.1", None)
    r = masking.mask_addresses(df).orderBy("doc_id").collect()
    assert r[0]["pii_emails_masked"] == 1 and r[0]["text"].startswith("mail [EMAIL] and [IP_ADDRESS], ")
    assert r[1]["text"] is None and r[1]["pii_emails_masked"] == 0
    assert "b@c.example" in masking.mask_addresses(df, emails=False).orderBy("doc_id").first()["text"]
    assert masking.mask_totals(masking.mask_addresses(df)).first()["emails_masked"] == 1


def test_language(spark):
    df = docs(spark, "the cat and the dog is in the house", "der Hund und die Katze ist nicht mit im Haus", "", None)
    got = [r["language"] for r in annotate.with_language(df).orderBy("doc_id").collect()]
    assert got == ["en", "de", "unknown", "unknown"]
    assert ids(annotate.language_filter(annotate.with_language(df), "de", 0.5)) == [1]


def test_urls(spark):
    rows = [("http://a.bad.example/x",), ("http://bad.example:80/",), ("http://ok.example/casino",), ("http://ok.example/",), ("",), (None,), ("not a url",)]
    df = spark.createDataFrame(rows, "url string")
    block = spark.createDataFrame([("Bad.example",), ("bad.example:80",)], "domain string")
    got = {r["url"]: r["reject_reason"] for r in urls.with_url_reason(df, block).collect()}
    assert got["http://a.bad.example/x"] == "blocklist_parent_domain" and got["http://bad.example:80/"] == "blocklist_domain"
    assert got["http://ok.example/casino"] == "pattern:casino" and got["http://ok.example/"] is None and got[""] is None and got[None] is None
    assert urls.url_filter(df, block).count() == 4


# deduplication


def test_exact_dedup(spark):
    df = docs(spark, "Same  text", "same text ", "other", None, "")
    assert ids(dedup.exact_dedup(df)) == [0, 2, 3]
    assert ids(dedup.exact_dedup(df, normalize=False)) == [0, 1, 2, 3]
    assert dedup.exact_dedup(df.limit(0)).count() == 0
    scoped = df.withColumn("dump", F.when(F.col("doc_id") == 1, "d2").otherwise("d1"))
    assert ids(dedup.exact_dedup(scoped, scope="per_dump")) == [0, 1, 2, 3]
    stats = dedup.dedup_stats(dedup.mark_exact(df)).first()
    assert (stats["n_docs"], stats["kept"], stats["dropped"]) == (5, 3, 2)


def test_keep_rules_take_the_last_of_ties(spark):
    df = spark.createDataFrame([(1, "c", "aa", 5), (2, "c", "bb", 5), (3, None, "x", 1)], "doc_id bigint, dedup_cluster_id string, text string, token_count bigint")
    kept = {r["kept_id"]: r["cluster_size"] for r in dedup.keep_one(df, "longest").collect()}
    assert kept == {2: 2, 3: 1}
    assert ids(dedup.keep_one(df, "first")) == [1, 3]
    with pytest.raises(ValueError):
        dedup.keep_one(df, "best")


def test_minhash_rule_equals_a_sequential_model(spark):
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(30)]
    texts = []
    for _ in range(60):
        if texts and rng.random() < 0.5:
            words = rng.choice(texts).split()
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(40)))
    df = docs(spark, *texts)
    bands = {}
    for r in minhash.band_hashes(df, "doc_id").collect():
        bands.setdefault(r["doc_id"], {})[r["band"]] = r["band_hash"]
    first, want, cluster = {}, {}, {}
    for i in range(len(texts)):
        met = [(b, first[b, h]) for b, h in sorted(bands[i].items()) if (b, h) in first]
        want[i] = bool(met)
        cluster[i] = cluster[met[0][1]] if met else i
        for b, h in bands[i].items():
            first.setdefault((b, h), i)
    got = minhash.minhash_marks(df).collect()
    assert {r["doc_id"]: r["dedup_dropped"] for r in got} == want and any(want.values()) and not all(want.values())
    assert {r["doc_id"]: r["dedup_cluster_id"] for r in got} == cluster
    assert ids(minhash.minhash_dedup(df)) == [i for i in want if not want[i]]


def test_minhash_signatures_equal_one_by_one_and_estimate_similarity():
    config = minhash.MinHashConfig(bands=50, rows=4)
    texts = ["", "ab", "a long text " * 50, "other", None, "x" * 30, "a long text " * 50]
    whole = minhash.signatures(texts, config)
    assert (whole == np.vstack([minhash.signatures([t], config) for t in texts])).all() and (whole[2] == whole[6]).all() and (whole[0] == whole[4]).all()
    assert (whole == minhash.signatures(texts, config, most=100)).all()
    a, b = [f"{k:05d}" for k in range(400)], [f"{k:05d}" for k in range(100, 500)]
    runs = lambda ws: {"".join(ws)[i : i + 5] for i in range(5 * len(ws) - 4)}
    s = minhash.signatures(["".join(a), "".join(b)], config)
    want = len(runs(a) & runs(b)) / len(runs(a) | runs(b))
    assert abs((s[0] == s[1]).mean() - want) < 0.12


def test_components_and_parents(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, 7: 7}
    chain = spark.createDataFrame([(k + 1, k) for k in range(20)], "node bigint, parent bigint")
    assert {r["root"] for r in follow_parents(chain).collect()} == {0}


def test_greedy_keep_equals_the_sequential_rule(spark):
    rng = random.Random(3)
    for _ in range(3):
        n = 30
        edges = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.08}
        kept = {}
        for b in range(n):
            kept[b] = not any(kept[a] for a in range(b) if (a, b) in edges)
        df = spark.createDataFrame([(k,) for k in range(n)], "node bigint")
        got = semantic.greedy_keep(df, spark.createDataFrame(sorted(edges), "a bigint, b bigint"))
        assert {r["node"]: r["kept"] for r in got.collect()} == kept


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((60, 8))
    v[10:20] = v[:10] + 0.05 * rng.standard_normal((10, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(60, None), (61, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if u[a] @ u[b] >= 0.9}
    assert {(r["a"], r["b"]) for r in semantic.similar_embeddings(df, 0.9).collect()} == want
    found = {(r["a"], r["b"]) for r in semantic.hyperplane_candidates(df, 0.9, bits=6, most=7).collect()}
    assert found <= want and len(found) >= 0.9 * len(want)


def test_index_recall_with_the_parameters_of_the_query(spark):
    from loamworks.session import table

    for threshold in (0.2, 0.4, 0.7, 0.9, 0.99):
        for rows in (100, 10_000, 10**6):
            t, b = semantic.index_size(rows, threshold)
            assert 1 - (1 - (1 - math.acos(threshold) / math.pi) ** b) ** t >= 0.99 - 1e-9
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        df = table(spark, f"/root/testdata/{sf}", "embeddings")
        exact = {(r["a"], r["b"]) for r in semantic.similar_embeddings(df, 0.4).collect()}
        found = {(r["a"], r["b"]) for r in semantic.hyperplane_candidates(df, 0.4).collect()}
        assert found <= exact and len(found) >= 0.9 * len(exact), (sf, len(found), len(exact))


def test_shingle_links(spark):
    a = " ".join(f"w{k}" for k in range(40))
    df = docs(spark, a, a + " x", a, "tiny", None)
    got = {(r["a"], r["b"]) for r in semantic.shingle_links(df, 0.8).collect()}
    assert (0, 2) in got and any(1 in p for p in got)
    kept = {r["node"]: r["kept"] for r in semantic.shingle_dedup(df, 0.8).collect()}
    assert kept == {0: True, 1: False, 2: False, 3: True, 4: True}


def block_files(spark):
    """Sizes of the files in the session's local folders, most of them shuffled."""
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    sizes = {}
    for top in dirs:
        for path in pathlib.Path(top).rglob("*"):
            try:
                if path.is_file():
                    sizes[path] = path.stat().st_size
            except OSError:  # deleted meanwhile
                pass
    return sizes


def test_materialize_leaves_nothing_shuffled(spark):
    from loamworks.session import materialize

    before = block_files(spark)
    df = materialize(spark.range(100_000).repartition(3))
    assert not [p for p in block_files(spark).keys() - before.keys() if p.name.startswith("shuffle_")] and df.count() == 100_000


def test_shingle_dedup_on_little_disk(spark):
    path = "/root/testdata/sf0.1/documents.parquet"
    before, most, over = block_files(spark), [0], threading.Event()

    def watch():
        while not over.wait(0.1):
            most[0] = max(most[0], sum(n for p, n in block_files(spark).items() if p not in before))

    thread = threading.Thread(target=watch)
    thread.start()
    try:
        rows = semantic.shingle_dedup(spark.read.parquet(path).limit(4000)).count()
    finally:
        over.set()
        thread.join()
    assert rows == 4000 and most[0] < 2 * pathlib.Path(path).stat().st_size


# decontamination

ITEM = "one two three four five six seven eight nine ten"


def test_decontamination_modes(spark):
    items = spark.createDataFrame([(1, "quiz", ITEM), (2, "other", ITEM)], "item_id bigint, source string, text string")
    df = docs(spark, "One two three four five six seven eight", "nothing like it at all in here my friend", None)
    c = decontam.DecontamConfig(n=5, threshold=0.5)
    index = decontam.build_index(items, c)
    got = decontam.overlaps(df, index, c).first()
    assert got["overlap_score"] == 1.0 and got["eval_source"] == "quiz" and len(got["matched_ngrams"]) == 4
    assert ids(decontam.decontaminate(df, index, c)) == [1, 2]
    tagged = decontam.decontaminate(df, index, decontam.DecontamConfig(5, 0.5, "tag")).orderBy("doc_id").collect()
    assert tagged[0]["contamination"]["action"] == "tag" and tagged[1]["contamination"] is None
    assert decontam.decontaminate(df, index, decontam.DecontamConfig(5, 0.5, "downweight")).orderBy("doc_id").first()["sample_weight"] == pytest.approx(0.1)
    low = docs(spark, "one two three four five six seven eight")
    assert "[REDACTED]" in decontam.decontaminate(low, index, decontam.DecontamConfig(5, 0.5, "redact")).first()["text"]
    assert decontam.overlaps(df, decontam.build_index(items, decontam.DecontamConfig(n=10)), decontam.DecontamConfig(n=10)).count() == 0
    assert decontam.decontaminate(df, decontam.build_index(items.limit(0), c), c).count() == 3
    stats = {r["eval_source"]: r["docs_contaminated"] for r in decontam.contamination_stats(df, index, c).collect()}
    assert stats == {None: 1, "quiz": 1}
    assert decontam.audit(df, index, c, preview=3).first()["doc_preview"] == "One"
    assert decontam.contains_item(docs(spark, "x " + ITEM + " y", "xone two"), items).count() == 2


# slices, budgets


def test_slices(spark):
    df = spark.createDataFrame(
        [(1, "d1", "en", "http://u@Ex.edu:80/p", 100, 0.9), (2, None, "", None, 600, 0.2)], "doc_id bigint, dump string, language string, url string, token_count bigint, mean_quality double"
    )
    got = {r["doc_id"]: r["slice_tags"] for r in slices.assign_slices(df).collect()}
    assert got[1] == ["domain=u@Ex.edu:80", "dump=d1", "lang=en", "quality_bin=high", "token_bin=tiny"]
    assert got[2] == ["quality_bin=low", "token_bin=medium"]
    r = slices.default_registry()
    r.register("size", lambda columns: F.array(F.lit("size=any")))
    assert "size=any" in slices.assign_slices(df, r).first()["slice_tags"]
    with pytest.raises(ValueError):
        r.register("size", lambda columns: None)


def test_slice_stats_and_composition(spark, tmp_path):
    rows = [(1, ["a", "b"], 10, False), (2, ["a"], 30, False), (3, ["a"], 5, True)]
    df = spark.createDataFrame(rows, "doc_id bigint, slice_tags array<string>, token_count bigint, dedup_dropped boolean")
    stats, total = slices.slice_stats(df), slices.total_stats(df)
    got = {r["slice"]: (r["doc_count"], r["token_count"], r["dedup_drop_rate"]) for r in stats.collect()}
    assert got == {"a": (2, 40, 0.3333), "b": (1, 10, 0.0)} and total.first()["doc_count"] == 2
    parts = {r["slice"]: r["token_fraction"] for r in slices.composition(stats, total).collect()}
    assert parts == {"a": 1.0, "b": 0.25}
    slices.save_stats(stats, total, str(tmp_path / "s.json"))
    back, whole = slices.load_stats(spark, str(tmp_path / "s.json"))
    assert sorted(back.collect()) == sorted(stats.select(back.columns).collect()) and whole["token_count"] == 40
    assert slices.composition(stats.limit(0), slices.total_stats(df.limit(0))).count() == 0


def sequential(rows, caps, most):
    used, total, out = dict.fromkeys(caps, 0), 0, []
    for i, n, tags in rows:
        if total + n > most:
            break
        if any(used[t] >= caps[t] for t in tags if t in caps):
            continue
        out.append(i)
        total += n
        for t in tags:
            if t in caps:
                used[t] += n
    return out


def test_budgets_and_caps_equal_a_sequential_model(spark):
    rng = random.Random(5)
    for _ in range(4):
        rows = [(i, rng.randrange(0, 20), rng.sample(["a", "b", "c", "d"], rng.randrange(0, 4))) for i in range(40)]
        caps, most = {"a": rng.randrange(0, 90), "b": rng.randrange(0, 90), "c": 60}, rng.randrange(50, 400)
        df = spark.createDataFrame(rows, "doc_id bigint, token_count bigint, slice_tags array<string>")
        assert ids(budget.capped(df, caps)) == sequential(rows, caps, 10**9)
        assert ids(budget.capped_within_budget(df, caps, most)) == sequential(rows, caps, most)
        assert ids(budget.within_budget(df, most)) == sequential(rows, {}, most)


def test_until_target_and_running_total(spark):
    df = spark.createDataFrame([(i, 10) for i in range(10)], "doc_id bigint, token_count bigint")
    assert ids(budget.until_target(df, 25)) == [0, 1, 2] and budget.until_target(df, 0).count() == 0
    got = {r["doc_id"]: r["t"] for r in running_total_by_order(df, ["doc_id"], F.col("token_count"), "t").collect()}
    assert got == {i: 10 * i for i in range(10)}
    assert running_total_by_order(df.limit(0), ["doc_id"], F.col("token_count"), "t").count() == 0


def test_weighted_sample_follows_weights(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.array(F.when(F.col("id") % 2 == 0, "a").otherwise("b")).alias("slice_tags"))
    got = budget.weighted_sample(df, 400, {"a": 3.0, "b": 1.0})
    n = got.where("doc_id % 2 = 0").count()
    assert got.count() == 400 and 270 <= n <= 330
    assert budget.weighted_sample(df, 400, {"a": 0.0}).where("doc_id % 2 = 0").count() == 0
    mixed = budget.ratio_mix(df.withColumn("domain", F.element_at("slice_tags", 1)), {"a": 0.25}, 100)
    assert mixed.count() == 25


# sources


def test_warc(spark, tmp_path):
    def record(kind, ident, body, uri=True):
        b = body.encode("utf-8", "surrogateescape")
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\n" + (f"WARC-Target-URI: http://x.example/{ident}\r\n" if uri else "") + f"WARC-Record-ID: <urn:{ident}>\r\nContent-Length: {len(b)}\r\n\r\n"
        return head.encode() + b + b"\r\n\r\n"

    data = record("conversion", "a", "first\nWARC/1.0 is a line\nContent-Type: text") + record("conversion", "b", "") + record("conversion", "c", "caf\udce9", uri=False)
    (tmp_path / "CC-MAIN-2024-10.wet.gz").write_bytes(gzip.compress(data))
    rows = {r["id"]: r for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert set(rows) == {"urn:a", "urn:c"} and "WARC/1.0 is a line" in rows["urn:a"]["text"] and rows["urn:a"]["dump"] == "CC-MAIN-2024-10"
    assert rows["urn:c"]["url"] is None and rows["urn:c"]["text"] == "caf�"
    assert warc.read_warc(spark, str(tmp_path), limit=1).count() == 1
    page = record("response", "p", "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nServer: s\r\n\r\n<p>hi</p>")
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.warc").write_bytes(page)
    assert warc.read_warc(spark, str(tmp_path / "w"), "warc").first()["text"] == "<p>hi</p>"


def test_shards_manifest_and_recovery(spark, tmp_path):
    df = spark.createDataFrame([(str(i), f"text {i}") for i in range(25)], "id string, text string")
    path = str(tmp_path / "data")
    tables.write_shards(df.coalesce(1), path, 10)
    shards = tables.shard_manifest(spark, path)
    assert sorted(r["doc_count"] for r in shards.collect()) == [5, 10, 10]
    tables.save_manifest(tables.make_manifest("d", shards), str(tmp_path / "manifest.json"))
    assert tables.load_manifest(str(tmp_path / "manifest.json"))["dataset_id"] == "d"
    assert release.verify_release(spark, str(tmp_path)).count() == 0
    assert "| a |" not in release.dataset_card(tables.load_manifest(str(tmp_path / "manifest.json")), policy.Policy("p"))
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "x.json").write_text('{"id": "1", "text": "a"}\n{broken\n')
    assert tables.validate_shards(spark, str(bad), "id string, text string").first()["corrupt"] == 1
    assert tables.recover_shards(spark, str(bad), "id string, text string").where("id IS NOT NULL").count() == 1
    read = tables.read_documents(spark, path, "json", limit=0)
    assert read.count() == 25 and {r["id"] for r in tables.read_documents(spark, path, "json").collect()} == {str(i) for i in range(25)}


def test_cache_store_log_blocklist(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "bb")], "doc_id bigint, text string")
    cache, seen = tables.FeatureCache(spark, str(tmp_path / "c")), []

    def compute(x):
        seen.append(x.count())
        return x.select("doc_id", F.length("text").alias("size"))

    cache.get_or_compute(df.limit(1), "size", compute)
    assert {r["doc_id"]: r["size"] for r in cache.get_or_compute(df, "size", compute).collect()} == {1: 1, 2: 2} and seen == [1, 1]
    store = tables.ArtifactStore(str(tmp_path / "s"))
    key = store.key("p", "c", "i")
    assert not store.exists(key)
    store.put(key, df)
    assert store.list() == [key]
    store.delete(key)
    assert store.list() == []
    log = tables.RunLog(str(tmp_path / "log.jsonl"), "r1")
    log.metric("loss", 0.5, 1)
    log.config({"a": 1})
    assert tables.RunLog.read(spark, str(tmp_path / "log.jsonl")).count() == 2
    (tmp_path / "b.txt").write_text("# list\nBad.example  # why\n\n")
    assert [r["domain"] for r in tables.load_blocklist(spark, str(tmp_path / "b.txt")).collect()] == ["bad.example"]
    assert tables.load_blocklist(spark, str(tmp_path / "none")).count() == 0


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><a href='x'>menu</a></nav><p>" + "real words " * 20 + "</p><p><a href='y'>only a link here</a></p><script>x()</script></body></html>"
    df = html.extract_text(spark.createDataFrame([(page,), ("<p>short</p>",), (None,)], "html string")).collect()
    assert df[0]["text"].startswith("real words") and "link" not in df[0]["text"] and df[1]["text"] is None and df[2]["text"] is None


# plans


def test_policy_hash_and_files(spark, tmp_path):
    a, b = policy.Policy("p", slice_weights={"x": 1.0, "y": 2.0}), policy.Policy("p", slice_weights={"y": 2.0, "x": 1.0})
    assert policy.same_policy(a, b) and not policy.same_policy(a, policy.Policy("q"))
    policy.save_policy(a, str(tmp_path / "p.yaml"))
    assert policy.load_policy(str(tmp_path / "p.yaml")) == a
    with pytest.raises(ValueError):
        policy.Policy.from_dict({"name": "p", "filters": []})
    assert policy.reproducibility_key(a, "i", "c") != policy.reproducibility_key(a, "i", "d")
    changed = release.policy_diff(a, policy.Policy("p", max_tokens=5, slice_weights={"x": 1.0 + 1e-9, "z": 1.0}))
    assert {(d["path"], d["change"]) for d in changed} == {("max_tokens", "changed"), ("slice_weights.y", "removed"), ("slice_weights.z", "added")}


def test_execute_policy(spark):
    text = "the cat and the dog is in the house with it for this and that day number {}"
    rows = [(i, text.format(i % 4) + " " + " ".join(f"w{i % 4}{k}" for k in range(30)), "d") for i in range(8)] + [(8, "kurz", "d"), (9, None, "d")]
    df = spark.createDataFrame(rows, DOCS)
    p = policy.Policy("p", min_language_score=0.5, quality=policy.QualityPolicy(min_words=10, enabled_rules=["min_words"]), dedup=policy.DedupPolicy("exact", "global"), decontam=policy.DecontamPolicy(ngram_size=5, overlap_threshold=0.5, targets=["Quiz"]))
    items = spark.createDataFrame([(1, "quiz", rows[3][1]), (2, "else", rows[0][1])], "item_id bigint, source string, text string")
    done = policy.execute(df, p, items)
    assert ids(done.documents) == [0, 1, 2]
    total = done.total_stats().first()
    assert (total["doc_count"], total["dedup_dropped"], total["decontam_dropped"]) == (3, 4, 1)
    p.max_tokens = done.documents.agg(F.max("token_count")).first()[0]
    assert ids(policy.execute(df, p, items).documents) == [0]
    assert policy.execute(df.limit(0), p, items).documents.count() == 0
    assert policy.dry_run(df, p, 10).first()["after_quality"] == 8
    p.dedup.method = "nope"
    with pytest.raises(ValueError):
        policy.execute(df, p)


def test_policy_keep_rules_respect_scope_and_semantic_clusters(spark):
    plain = dict(min_language_score=0.0, quality=policy.QualityPolicy(enabled_rules=["max_words"]), decontam=policy.DecontamPolicy(enabled=False))
    rows = [(1, "the same text", "d1", "en", 1.0), (2, "The  same text", "d2", "en", 1.0), (3, "the same  text", "d2", "en", 1.0)]
    df = spark.createDataFrame(rows, DOCS + ", language string, language_score double")
    run = lambda d, **k: policy.execute(df, policy.Policy("p", dedup=d, **{**plain, **k}), embeddings=v)
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])], "doc_id bigint, embedding array<double>")
    assert ids(run(policy.DedupPolicy("exact", "per_dump", keep_rule="longest")).documents) == [1, 3]
    assert ids(run(policy.DedupPolicy("exact", "per_dump")).documents) == [1, 2]
    assert ids(run(policy.DedupPolicy("exact", "global", keep_rule="longest")).documents) == [3]
    assert ids(run(policy.DedupPolicy("semantic", "global", keep_rule="longest")).documents) == [2, 3]
    assert ids(run(policy.DedupPolicy("semantic", "global")).documents) == [1, 3]
    assert ids(run(policy.DedupPolicy("semantic", "per_dump")).documents) == [1, 2, 3]
    for rule in dedup.KEEP_RULES:
        assert len(ids(run(policy.DedupPolicy("exact", "global", keep_rule=rule)).documents)) == 1
        assert len(ids(run(policy.DedupPolicy("minhash", "global", num_bands=100, rows_per_band=1, keep_rule=rule)).documents)) == 1
    # with caps too, drops after the end of the selection count nowhere
    done = run(policy.DedupPolicy("exact", "global"), max_tokens=2, max_tokens_per_slice={"dump=d1": 100})
    assert ids(done.documents) == [] and done.total_stats().first()["dedup_dropped"] == 0
    with pytest.raises(ValueError, match="keep rule"):
        run(policy.DedupPolicy("exact", keep_rule="best"))


def test_policy_modes_that_keep_documents(spark):
    items = spark.createDataFrame([(1, "q", "one two three four five six")], "item_id bigint, source string, text string")
    df = spark.createDataFrame([(1, "one two three four five six seven", "d", "en", 1.0), (2, "other words", "d", "en", 1.0)], DOCS + ", language string, language_score double")
    for mode, want in (("tag", 1.0), ("downweight", 0.1), ("redact", 1.0)):
        p = policy.Policy("p", min_language_score=0.0, quality=policy.QualityPolicy(enabled_rules=["max_words"]), dedup=policy.DedupPolicy("exact"), decontam=policy.DecontamPolicy(mode=mode, ngram_size=3, overlap_threshold=0.5))
        got = {r["doc_id"]: r for r in policy.execute(df, p, items).documents.collect()}
        assert got[1]["contamination"]["action"] == mode and got[2]["contamination"] is None
        assert got[1]["sample_weight"] == pytest.approx(want if mode != "downweight" else 0.2) and ("[REDACTED]" in got[1]["text"]) == (mode == "redact")


def test_steps_are_deleted_and_clusters_need_a_shared_folder(spark, monkeypatch):
    from loamworks import session, storage

    with session.scratch():
        path = session.step_path(spark)
        spark.range(3).write.parquet(path)
        assert session.materialize(spark.range(4)).count() == 4 and storage.exists(path)
    assert not storage.exists(path)
    assert session.is_local("local[4]") and not session.is_local("local-cluster[2,1,512]") and not session.is_local("spark://x")

    class Bare:
        class sparkContext:
            master = "spark://x:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Bare)
    sample = session.bounded_texts(spark.createDataFrame([(i, "x" * 100) for i in range(1000)] + [(5000, "y" * 10**5)], "k bigint, t string"), "k", "t", 50_000)
    assert 300 < sample.count() < 700 and not sample.where("k = 5000").count()


def test_first_rows_and_skylines(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101) for i in range(101)], "doc_id bigint, v bigint")
    assert ids(budget.first_rows(df, {"v": F.col("v")}, 10), "v") == list(range(10))
    assert budget.first_rows(df, {"v": F.col("v")}, 500).count() == 101 and budget.first_rows(df, {"v": F.col("v")}, 0).count() == 0
    points = np.random.default_rng(0).integers(0, 6, (200, 3)).astype(float)
    want = {tuple(p) for p in points if not any((q >= p).all() and (q != p).any() for q in points)}
    assert {tuple(p) for p in search.skyline(points)} == want and len(search.skyline(points)) == len(want)


def test_feature_matrix_is_bounded(spark):
    df = spark.createDataFrame([(1, f"s{k}", 0.1) for k in range(5)], "run_id int, slice string, token_fraction double")
    assert len(slices.feature_matrix(df).columns) == 6
    with pytest.raises(ValueError, match="slices"):
        slices.feature_matrix(df, most=4)


def leaking(spark, tmp_path):
    """Paths of a policy, documents of which one leaks, and evaluation items."""
    text = "the cat and the dog is in the house with it for this and that day number {}"
    rows = [(i, text.format(i) + " " + " ".join(f"w{i}{k}" for k in range(30)), "d") for i in range(4)]
    where = [str(tmp_path / x) for x in ("p.yaml", "docs", "items")]
    p = policy.Policy("p", min_language_score=0.5, quality=policy.QualityPolicy(min_words=10, enabled_rules=["min_words"]), dedup=policy.DedupPolicy("exact", "global"), decontam=policy.DecontamPolicy(ngram_size=5, overlap_threshold=0.5, targets=["Quiz"]))
    policy.save_policy(p, where[0])
    spark.createDataFrame(rows, DOCS).write.parquet(where[1])
    spark.createDataFrame([(1, "quiz", rows[3][1])], "item_id bigint, source string, text string").write.parquet(where[2])
    return where


def test_cli_decontaminates(spark, tmp_path):
    from loamworks import cli

    p, d, e = leaking(spark, tmp_path)
    for args in (["run", p, d, str(tmp_path / "none")], ["run", p, d, str(tmp_path / "none"), "--evaluation", d.replace("docs", "other")]):
        spark.createDataFrame([(1, "else", "x y z")], "item_id bigint, source string, text string").write.mode("overwrite").parquet(str(tmp_path / "other"))
        with pytest.raises(ValueError, match="evaluation"):
            cli.main(args)
    assert not (tmp_path / "none").exists()
    out = str(tmp_path / "out")
    assert cli.main(["run", p, d, out, "--evaluation", e]) == 0
    assert ids(spark.read.json(f"{out}/data")) == [0, 1, 2]
    with pytest.raises(ValueError, match="evaluation"):
        cli.main(["reproduce", f"{out}/manifest.json", d, str(tmp_path / "again")])
    assert cli.main(["reproduce", f"{out}/manifest.json", d, str(tmp_path / "again"), "--evaluation", e]) == 0
    assert ids(spark.read.json(str(tmp_path / "again"))) == [0, 1, 2]


def test_rebuild_compares_contents(spark, tmp_path):
    p = policy.Policy("p", min_language_score=0.5, quality=policy.QualityPolicy(min_words=10, enabled_rules=["min_words"]), dedup=policy.DedupPolicy("exact", "global"), decontam=policy.DecontamPolicy(enabled=False))
    text = "the cat and the dog is in the house with it for this and that day number"
    texts = [text + " " + " ".join(f"w{i}{k}" for k in range(30)) for i in range(3)]
    df = docs(spark, *texts, dump="d")
    data = str(tmp_path / "data")
    tables.write_shards(policy.execute(df, p).documents.drop("quality_scores"), data, per_shard=1)
    manifest = tables.make_manifest("p", tables.shard_manifest(spark, data), p.to_dict(), content=tables.content_hash(spark, data))
    same = release.rebuild(spark, manifest, lambda s, _: df, str(tmp_path / "same"))
    other = release.rebuild(spark, manifest, lambda s, _: docs(spark, *texts[:2], texts[2] + " more", dump="d"), str(tmp_path / "other"))
    assert same["contents_match"] is True and other["contents_match"] is False
    assert same["documents"] == other["documents"] == same["expected"] == 3
    del manifest["content_hash"]
    assert release.rebuild(spark, manifest, lambda s, _: df, str(tmp_path / "old"))["contents_match"] is None


def test_pipeline(spark, tmp_path):
    for bad in ({}, {"pipeline": {}}, {"pipeline": {"blocks": [{"type": "x", "name": "y"}]}}, {"pipeline": {"blocks": [{"type": "filter", "name": "y"}]}}):
        with pytest.raises(ValueError):
            pipeline.validate(bad)
    docs(spark, "a b c", "a").write.parquet(str(tmp_path / "d"))
    config = {"pipeline": {"blocks": [{"type": "reader", "name": "parquet", "params": {"path": str(tmp_path / "d"), "id_field": "doc_id"}}, {"type": "filter", "name": "length", "params": {"low": 2}}, {"type": "mapper", "name": "token_count"}]}}
    assert [r["token_count"] for r in pipeline.run_pipeline(spark, config).collect()] == [3]


def test_pipeline_blocks_with_tables(spark, tmp_path):
    page = "<html><body><p>{} " + "real words " * 20 + "</p></body></html>"
    leak = "one two three four five six seven eight"
    spark.createDataFrame([(0, page.format("a")), (1, page.format("b")), (2, page.format(leak)), (3, page.format("d"))], "doc_id bigint, page string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<double>").write.parquet(str(tmp_path / "v"))
    spark.createDataFrame([(1, "quiz", leak)], "item_id bigint, source string, text string").write.parquet(str(tmp_path / "e"))
    overlap = {"type": "decontam", "name": "ngram_overlap", "params": {"evaluation": str(tmp_path / "e"), "n": 5, "threshold": 0.05}}
    blocks = [{"type": "mapper", "name": "extract_text", "params": {"html": "page"}}, {"type": "dedup", "name": "semantic", "params": {"embeddings": str(tmp_path / "v"), "embedding_id": "vec_id"}}, overlap]
    df = spark.read.parquet(str(tmp_path / "d"))
    assert ids(pipeline.run_pipeline(spark, {"pipeline": {"blocks": blocks[:2]}}, df)) == [0, 2, 3]
    got = pipeline.run_pipeline(spark, {"pipeline": {"blocks": blocks}}, df)
    assert ids(got) == [0, 3] and all("real words" in r["text"] for r in got.collect())
    overlap["params"] = {"n": 5}
    with pytest.raises(ValueError):
        pipeline.run_pipeline(spark, {"pipeline": {"blocks": blocks}}, df)


def trials(spark, rows):
    return spark.createDataFrame(rows, "trial_id bigint, score double, compute_cost double, dataset_tokens bigint, contamination_rate double, diversity_score double")


def test_search(spark):
    c = search.Constraints(10, 0.1, 100, 0.5)
    df = trials(spark, [(1, 0.5, 5.0, 200, 0.0, 0.9), (2, 0.9, 50.0, 200, 0.0, 0.9), (3, 0.7, 5.0, 200, 0.0, None), (4, 0.7, 5.0, 200, None, 0.9), (5, 1.0, 11.0, 200, 0.0, 0.9)])
    assert [r["trial_id"] for r in search.feasibility_first(df, c).collect()] == [3, 4, 1, 5, 2]
    assert search.feasible(df, c).count() == 3
    assert search.penalized(df, c).where("trial_id = 2").first()["penalized_score"] == pytest.approx(0.9 - 4)
    assert {r["trial_id"] for r in search.pareto(df).where("is_pareto").collect()} == {3, 4, 5}
    assert [r["trial_id"] for r in search.top_trials(df, 1).collect()] == [5]
    assert search.promote(df.withColumn("level", F.lit(0)), 0.1).count() == 1
    losses = spark.createDataFrame([(1, s, x) for s, x in enumerate([1.0, 0.5, 0.495, 0.5, 0.6, 0.1])] + [(2, 0, 1.0)], "trial_id bigint, step bigint, loss double")
    assert {r["trial_id"]: r["stop_step"] for r in search.early_stops(losses).collect()} == {1: 4, 2: None}
    space = [search.Parameter("n", "int", low=1, high=1000, log=True), search.Parameter("k", "categorical", choices=("a", "b"))]
    best = search.random_search(space, lambda cfg: {"score": cfg["n"], "dataset_tokens": 10**10}, 20)
    assert best[0].score == max(t.score for t in best) and all(1 <= t.config["n"] <= 1000 for t in best)
    raised = search.random_search(space, lambda cfg: 1 / 0, 3)
    assert not any(t.is_feasible for t in raised)
    assert len(search.successive_halving(space, lambda cfg, b: cfg["n"] * b, 10)) == 1


def test_evals(spark):
    scores_ = spark.createDataFrame([(1, "a", 0.5, 0.4, 0.6), (1, "b", 1.0, None, None)], "run_id bigint, task string, score double, ci_low double, ci_high double")
    w = spark.createDataFrame([("a", 3.0)], "task string, weight double")
    r = evals.aggregate_scores(scores_, w).first()
    assert r["score_total"] == pytest.approx(0.625) and r["ci_high"] - r["score_total"] == pytest.approx(0.75 * 0.1)
    assert evals.aggregate_scores(scores_, method="geometric_mean").first()["score_total"] == pytest.approx(math.sqrt(0.5))
    raw = spark.createDataFrame([(1, '{"results": {"t": {"acc": 0.5, "acc_stderr": 0.1, "acc_norm": 0.6}, "u": {"f1": 0.2}, "v": {"x": 1}}}')], "run_id bigint, results string")
    got = {r["task"]: r["score"] for r in evals.parse_harness(raw).collect()}
    assert got == {"t": 0.6, "u": 0.2}


def test_attribution(spark):
    rng = np.random.default_rng(0)
    x = rng.dirichlet([1, 1, 1], 40)
    y = x @ np.array([1.0, 0.0, -1.0]) + 0.01 * rng.standard_normal(40)
    comp = spark.createDataFrame([(i, s, float(x[i, k])) for i in range(40) for k, s in enumerate("abc")], "run_id int, slice string, token_fraction double")
    sc = spark.createDataFrame([(i, "bench", float(v)) for i, v in enumerate(y)], "run_id int, benchmark string, score double")
    got = {r["slice"]: r for r in attribution.ridge_attribution(comp, sc, n=50).collect()}
    assert got["a"]["significant"] and got["a"]["value"] > 0 > got["c"]["value"] and got["a"]["n_runs"] == 40
    coef, _, r2 = attribution.solve_ridge(x, y)
    assert got["a"]["value"] == pytest.approx(coef[0]) and r2 > 0.8
    assert attribution.permutation_test(spark, x, y, n=50) < 0.05
    rows = attribution.ablation_study({"a": 1.0, "b": 2.0}, lambda w: w["a"] * 2 + w["b"])
    assert [r["slice"] for r in rows] == ["a", "b"] and rows[0]["delta"] == -2.0
    assert "bench" in release.experiment_report("t", sc.groupBy("benchmark").agg(F.avg("score").alias("score")), as_html=True)


def test_streaming(spark, tmp_path):
    from loamworks import streaming

    rows = spark.createDataFrame([(1, "A b", "2024-01-01 00:00:00"), (2, "a  B", "2024-01-01 00:01:00"), (3, "c", "2024-01-01 00:02:00")], "doc_id bigint, text string, t string")
    rows.select("doc_id", "text", F.col("t").cast("timestamp").alias("crawled_at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id bigint, text string, crawled_at timestamp").parquet(str(tmp_path / "in"))
    items = spark.createDataFrame([(1, "q", "c")], "item_id bigint, source string, text string")
    c = decontam.DecontamConfig(n=3, threshold=0.5)
    got = []
    run = streaming.curate_stream(stream, decontam.build_index(items, c), lambda b, e: got.extend(r["doc_id"] for r in b.collect()), c).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    run.awaitTermination()
    assert len(got) == 1 and got[0] in (1, 2)
    with pytest.raises(ValueError):
        streaming.stream_decontaminate(stream, items, c)


def test_run_shards_resumes(spark, tmp_path):
    for k in ("a", "b"):
        docs(spark, k).write.parquet(str(tmp_path / k))
    shards, out = {"a": str(tmp_path / "a"), "b": str(tmp_path / "b"), "c": str(tmp_path / "missing")}, str(tmp_path / "out")
    first = pipeline.run_shards(spark, shards, lambda df: df, out)
    assert first["a"] == first["b"] == "done" and first["c"].startswith("failed")
    assert pipeline.run_shards(spark, shards, lambda df: df, out)["a"] == "skipped"


def test_queries_and_sql_have_the_same_names():
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) >= 100
