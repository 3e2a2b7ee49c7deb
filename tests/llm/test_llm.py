import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamworks.llm import fm_index, leaks, mixing, packing, personal, quality, reading, representatives, setjoin, shingles, tokens
from loamworks.llm import near_duplicates as near
from loamworks.llm.boosting import fit_boosted
from loamworks.llm import language

DOCS = "doc_id bigint, text string, lang string, source string, extra string"


def docs(spark, *texts, lang="en", source="web_a"):
    return spark.createDataFrame([(i, t, lang, source, "x") for i, t in enumerate(texts)], DOCS)


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# 1 leaks


def test_fm_index_equals_scanning():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 400):
        text = rng.integers(1, 5, n)
        index = fm_index.FMIndex(text)
        for k in (1, 3):
            patterns = rng.integers(1, 7, (30, k))
            low, high = index.search(patterns)
            for p, a, b in zip(patterns, low, high, strict=True):
                want = [i for i in range(n - k + 1) if (text[i : i + k] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


QUESTION = "In the quiet northern archive the seven librarians counted more than six hundred bridge entries before the long winter season had ended again"


def items(spark):
    rows = [(1, "test", QUESTION), (2, " Validation ", QUESTION.upper()), (3, "train", QUESTION), (4, "test", None), (5, None, "a b c d e f g h i j")]
    return spark.createDataFrame(rows, "item_id bigint, split string, question string")


def test_leaks(spark):
    w = QUESTION.split()
    changed = w[:]
    changed[5] = "eight"
    texts = [
        "Before. " + QUESTION + " After.",
        "x " + " ".join(w[:13]).upper() + " y",
        "<b>In</b> the *quiet* nor­thern archive,\nthe seven <i>librarians</i> counted more than six hundred bridge",
        " ".join(changed),
        " ".join(w[:8]) + " and nothing more of it here",
        " ".join(w[:8]) + " filler" * 30 + " " + " ".join(w[14:20]),
        " ".join(random.Random(1).sample(w, len(w))),
        None,
        "",
    ]
    found = leaks.find_leaks(docs(spark, *texts), items(spark))
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(found).collect()}
    assert got == {(d, i) for d in (0, 1, 2, 3) for i in (1, 2)}
    where = {(r["doc_id"], r["item_id"]): (r["start"], r["end"]) for r in found.collect()}
    a, b = where[0, 1]
    assert texts[0][a:b] == QUESTION
    a, b = where[2, 1]
    assert texts[2][a:b].startswith("In") and texts[2][a:b].endswith("bridge")
    spans = {r["doc_id"]: r for r in leaks.removal_spans(found).collect()}
    assert spans[0]["items"] == [1, 2] and len(spans[0]["spans"]) == 1
    assert leaks.find_leaks(docs(spark, *texts), items(spark).limit(0)).count() == 0


def test_half_a_question_with_a_replaced_word_at_any_place():
    config = leaks.LeakConfig()
    for m in (16, 18, 24, 32, 33, 40, 48, 64):
        q = [f"q{k}" for k in range(m)]
        questions = leaks.Questions([(1, " ".join(q))], config)
        half = -(-m // 2)
        texts, wanted = [], []
        for first in (0, m // 4, m - half):
            faults = half // config.tolerance
            for at in range(half):
                # as many words replaced as the rule allows, the first at each place
                passage = q[first : first + half]
                gone = sorted({(at + k * half // faults) % half for k in range(faults)})
                for k in gone:
                    passage[k] = "other"
                left = [k for k in range(half) if k not in gone]
                texts.append(" ".join(["before", *passage, "after", "it"]))
                wanted.append((len(texts) - 1, 0, 1 + left[0], 2 + left[-1]))
        assert sorted(leaks.search_shard(texts, questions)) == wanted


def test_tags_of_any_length_and_prose_between_brackets(spark):
    w = QUESTION.split()
    for size in (100, 400, 5000):
        tag = '<i data-x="' + "k9 " * (size // 3) + '">'
        marked = " ".join(f"{tag}{x}" if k % 4 == 0 else x for k, x in enumerate(w))
        between = "if a <b " + QUESTION + " " + "more words " * (size // 10) + "> c"
        found = leaks.find_leaks(docs(spark, marked, between, "<!-- " * 2000 + marked), items(spark))
        assert {r["doc_id"] for r in leaks.leaked_items(found).collect()} == {0, 1, 2} - ({1} if size == 100 else set())
    assert leaks.words("a <!-- b --> c <!-- d") == ["a", "c", "d"]
    with pytest.raises(ValueError, match="bytes"):
        leaks.find_leaks(docs(spark, QUESTION), items(spark), leaks.LeakConfig(most_question_bytes=10))


def test_a_common_run_of_a_short_question():
    questions = leaks.Questions([(1, "one of the"), (2, "one of the two or three")], leaks.LeakConfig())
    got = leaks.search_shard(["one of the " * 3000, "one of two or three"], questions)
    assert {(t, q) for t, q, *_ in got} == {(0, 0), (0, 1), (1, 1)} or {(t, q) for t, q, *_ in got} >= {(0, 0), (1, 1)}


def test_local_alignment():
    q = np.arange(2, 22)
    assert leaks.align(q, np.concatenate([[1, 1], q[3:9], [1], q[10:15], [1]])) == (11, 1, 2, 14)
    assert leaks.align(q, np.concatenate([q[:5], q[6:12]]))[:2] == (11, 1) and leaks.align(q, np.array([1, 1]))[0] == 0


def test_best_window_equals_trying_all():
    def most(q, p, faults):
        rows = {(i, j): 0 for i in range(len(q) + 1) for j in range(len(p) + 1)}
        table = []
        for e in range(faults + 1):
            new = {}
            for i, j in rows:
                x = 0
                if i and j and q[i - 1] == p[j - 1]:
                    x = new[i - 1, j - 1] + 1
                if e:
                    x = max([x, *(table[-1][a] for a in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if a in table[-1])])
                new[i, j] = x
            table.append(new)
        return [max(t.values()) for t in table]

    rng, config = np.random.default_rng(5), leaks.LeakConfig()
    for _ in range(150):
        m = int(rng.integers(1, 33))
        q = rng.integers(0, 12, m)
        p = q[m // 4 :].copy()
        p[rng.random(len(p)) < 0.15] = 99
        p = np.concatenate([rng.integers(0, 12, 4), p[rng.random(len(p)) > 0.05]])
        found = most(q.tolist(), p.tolist(), m // 7)
        good = [h for e, h in enumerate(found) if h >= 7 * e and h * 8 >= 3.5 * m and h]
        got = leaks.best_window(q, p, config)
        assert (got[0] if got else None) == (max(good) if good else None)
        if got:
            assert 0 <= got[2] < got[3] <= len(p) and q.tolist().count(p[got[2]]) and q.tolist().count(p[got[3] - 1])


def test_seeds_suffice_for_every_window():
    config = leaks.LeakConfig()
    for m in range(1, 2001):
        runs = [-(-max(7 * e, -(-7 * m // 16), 1) // (e + 1)) for e in range(m // 7 + 1)]
        assert min(m, leaks.seed_length(m, config)) <= min(runs), m


# 2 tokens


def test_tokens(spark):
    texts = ["Hello world", "", None, "a" * 5000]
    records = spark.createDataFrame([(1, 1, " Web_B ", "2024-01-01")], "record_id bigint, doc_id bigint, source string, fetched_at string")
    catalog = spark.createDataFrame([("web_a", "web"), ("WEB_B", "Web"), (None, "x")], "source string, domain string")
    df = docs(spark, *texts).withColumn("source", F.when(F.col("doc_id") != 1, F.col("source")))
    got = {r["doc_id"]: r for r in tokens.document_tokens(df, records, catalog).collect()}
    enc = tokens.encoding(tokens.TOKENIZER)
    assert [got[i]["token_count"] for i in range(4)] == [2, 0, None, len(enc.encode_ordinary("a" * 5000))]
    assert got[1]["source"] == "web_b" and got[1]["domain"] == "web" and got[2]["language"] == "en"
    cube = {(r["source"], r["language"], r["domain"]): r for r in tokens.token_budget(tokens.document_tokens(df, records, catalog)).collect()}
    assert cube["all", "all", "all"]["n_docs"] == 4 and cube["all", "all", "all"]["n_texts"] == 3
    assert enc.decode(enc.encode_ordinary("Ünïcode\n\ttext ")) == "Ünïcode\n\ttext "
    assert tokens.count_tokens(["a b", None, "", "c" * 300], tokens.TOKENIZER) == [2, None, 0, len(enc.encode_ordinary("c" * 300))]


def test_languages_by_trigrams(spark):
    rng = random.Random(4)
    words = {"en": "the quick brown fox and this house with thing water".split(), "de": "der schnelle braune fuchs und dieses haus wasser nicht ich".split(), "it": "questo gatto della casa acqua perche sono molto bello".split()}
    say = lambda code, n: " ".join(rng.choice(words[code]) for _ in range(n))
    texts = [say(c, 60) for c in ("en", "de") for _ in range(40)]
    # one stored code in ten is wrong
    codes = [c if k % 10 else {"en": "de", "de": "en"}[c] for k, c in enumerate(["en"] * 40 + ["de"] * 40)]
    model = language.train(texts, codes)
    assert set(model.names) == {"en", "de"}
    assert model.guess([say("en", 30), say("de", 30), say("it", 60), "", None, "123 | 456", texts[0] + " " + say("de", 3)]) == ["en", "de", None, None, None, None, "en"]
    assert language.train([], []).guess(["a", None]) == [None, None]
    got = language.fit_language_model(docs(spark, *texts, lang=" EN-us "))
    assert got.names == ("en",) and got.guess([texts[0]]) == ["en"]
    assert language.fit_language_model(docs(spark, "a").limit(0)).names == ()


# 3 personal data


def test_boosting_learns_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = fit_boosted(x[:400], y[:400])
    p = model.probability(x[400:])
    assert ((p > 0.5) == y[400:]).mean() > 0.9 and 0 <= p.min() and p.max() <= 1


GIVEN = [a + b for a in ("Brix", "Drel", "Fenn", "Kaph", "Jorv", "Oshr") for b in ("or", "ka", "wen", "is", "in", "ume")]
FAMILY = [a + b for a in ("Garv", "Hulv", "Osk", "Velm", "Tarsk", "Morv") for b in ("mire", "sby", "etti", "ulis", "ov", "lund")]


def personal_texts(n):
    rng = random.Random(2)
    out = []
    for k in range(n):
        g, f = rng.choice(GIVEN), rng.choice(FAMILY)
        out.append(
            f"Write to {rng.choice([g.lower() + '.' + f.lower(), g[:3].lower(), f.lower() + '_x'])}{rng.choice(['@', ' (at) ', '[at]', '@'])}{rng.choice(['mail.', ''])}quarr.{rng.choice(['example', 'test'])} please. Signed, {g} {f}. The number is +1 415 555 {rng.randrange(1000, 9999)} and the tax id is {rng.randrange(100, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}. "
            f"She is living at {rng.randrange(1, 300)} Larkmoor Street. Install thing@{k}.2.1 now. Shard {rng.randrange(10**9, 10**10)} was written in 1999 by the quiet editors of Stavhurst Institute."
        )
    return out


@pytest.fixture(scope="module")
def personal_model():
    lexicon = [(t, "given") for t in GIVEN] + [(t, "family") for t in FAMILY] + [("Stavhurst", "place"), ("Quarr", "brand")]
    return personal.train(personal_texts(80), lexicon)


def test_personal_data(spark, personal_model):
    text = "Mail drelka_x (at) gar.example or call +1 415 555 2671. Dr Jorvin T. Velmulis lives at 12b N. Hill Road, Stavhurst. Her tax id is 912-45-6789."
    df = docs(spark, text, None, "", "Version 1.2.3.4 and 5 @ 1.05 each, 2020-02-17 15:31:21 took 3261")
    got = {(r["kind"], r["value"]) for r in personal.find_personal_data(df, personal_model).where("doc_id = 0").collect()}
    assert {("email", "drelka_x (at) gar.example"), ("phone", "+1 415 555 2671"), ("name", "Jorvin T. Velmulis"), ("address", "12b N. Hill Road"), ("id_number", "912-45-6789")} == got
    assert personal.find_personal_data(df, personal_model).where("doc_id > 0").count() == 0
    red = {r["doc_id"]: r for r in personal.redact(df, personal_model).collect()}
    assert red[0]["text"].startswith("Mail [EMAIL] or call [PHONE]. Dr [NAME] lives at [ADDRESS], Stavhurst.") and red[0]["n_replaced"] == 5
    assert red[1]["text"] is None and red[2]["text"] == "" and red[3]["n_replaced"] == 0


def test_spans_of_any_length(personal_model):
    local = "drelka." + "very_long_part." * 30 + "garvmire"
    text = f"Write to {local}@mail.quarr.example please.  Signed,   {GIVEN[0]}     {FAMILY[0]}.\nShe is living at 12345 Larkmoor{' ' * 3}Street. {GIVEN[1]} {FAMILY[1]}-{FAMILY[2]} came."
    got = {text[a:b] for a, b, _ in personal_model.spans([text])[0]}
    assert f"{local}@mail.quarr.example" in got and f"{GIVEN[1]} {FAMILY[1]}-{FAMILY[2]}" in got
    assert len(personal_model.spans(["1 " * 200_000 + "@ " * 1000])) == 1


def test_personal_data_in_sentences_that_training_has_not_seen(personal_model):
    rng = random.Random(8)
    want, found = [], []
    for _ in range(60):
        g, f = rng.choice(GIVEN), rng.choice(FAMILY)
        facts = [("name", f"{g} {f}"), ("email", f"{g.lower()}{rng.randrange(99)}@shop.velm.test"), ("phone", f"+1 415 555 {rng.randrange(1000, 9999)}"), ("id_number", f"{rng.randrange(100, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"), ("address", f"{rng.randrange(1, 300)} Osterbrook Road")]
        lines = ["It was {} who found the old key.", "All mail goes through {} since May.", "Ring {} after noon.", "The clerk wrote {} on the form.", "The shop at {} is closed."]
        text = " ".join(x.format(v) for x, (_, v) in zip(lines, facts, strict=True)) + f" Build {rng.randrange(10**8, 10**9)}.{rng.randrange(99)} took {rng.randrange(10**4)} seconds in 1999."
        want += facts
        found += [(k, text[a:b]) for a, b, k in personal_model.spans([text])[0]]
    hits = sum((Counter(want) & Counter(found)).values())
    assert hits >= 0.95 * len(want) and hits >= 0.95 * len(found), (hits, len(want), len(found), [x for x in found if x not in want][:5])


def test_scorers_follow_the_surroundings_where_the_format_leaves_open():
    rng = random.Random(3)
    rows = []
    for i in range(400):
        kind = i % 4  # settled yes, settled no, open yes, open no
        around = (("^", "call", "now") if kind in (0, 2) else ("^", "seed", "of"), "and")
        rows.append((i // 4, 0, 1, [float(kind >= 2), rng.random()], {0: 1, 1: 0}.get(kind), (*around[0], around[1]), (0.0, rng.random())))
    label = personal.view_labels(rows, personal.TrainConfig())
    assert all(label[i] in (-1, int(i % 4 == 2)) for i in range(400) if i % 4 >= 2) and (label[2::4] == 1).mean() > 0.9
    p = personal.fit_scorer(rows, label, personal.TrainConfig()).probability(rows)
    assert (p[2::4] > 0.5).all() and (p[3::4] < 0.5).all()
    seed = [(0, 0, 1, [1.0], None, ("^", "^", "seed", "of"), (0.0,))] * 6 + [(0, 0, 1, [1.0], 1, ("^", "^", "tel", "$"), (0.0,)), (0, 0, 1, [1.0], None, ("^", "^", "tel", "$"), (0.0,))]
    assert personal.untold(seed, personal.first_labels(seed), 5).tolist() == [0] * 6 + [1, -1]
    none = personal.fit_scorer(rows[:4], personal.first_labels(rows[:4]), personal.TrainConfig())
    assert none.trees is None and none.probability(rows[:4]).tolist() == [1.0, 0.0, 0.0, 0.0]


def test_spans_never_overlap(personal_model):
    for found in personal_model.spans(personal_texts(20)):
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False)) and {k for *_, k in found} >= {"email", "phone", "name"}


# 4 representatives

RECORD = "record_id bigint, dedup_cluster_id string, source string, url string, dump string, language string, language_score double, token_count bigint, toxicity_score double, dedup_method string, quality_scores map<string,double>, fetched_at string, ingested_at string, extra string"


def record(i, cluster, source="s1", url="u", tokens=5, overall=0.5, fetched="2024-01-01", ingested="2024-02-01"):
    return (i, cluster, source, url, "d", "en", 0.9, tokens, 0.1, "exact", {"overall": overall} if overall is not None else None, fetched, ingested, "x")


def catalog(spark):
    return spark.createDataFrame([("S1", 3), ("s2", 5), (None, 1)], "source string, trust int")


def test_dominant_records(spark):
    rows = [
        record(1, "A ", tokens=9), record(2, "a"), record(2, "a", ingested="2024-03-01"),
        record(3, "b", tokens=9), record(4, "b", overall=0.9),  # neither is best in all
        record(5, "c"), record(6, "c"),  # a tie
        record(7, "d"),  # alone
        record(8, None), record(9, " "), record(None, "a"),
        record(10, "e", overall=float("nan")), record(11, "e"), record(12, "f", source=" S2 ", url=""), record(13, "f", source="s2"),
    ]
    df = spark.createDataFrame(rows, RECORD)
    got = {(r["cluster_id"], r["record_id"]) for r in representatives.dominant_records(df, catalog(spark)).collect()}
    assert got == {("a", 1), ("e", 11), ("f", 13)}
    assert representatives.dominant_records(df.limit(0), catalog(spark)).count() == 0


def test_dominant_records_against_brute_force(spark):
    rng = random.Random(4)
    rows = [record(i, f"c{rng.randrange(30) if rng.random() < 0.7 else 0}", rng.choice(["s1", "s2", "zz"]), rng.choice(["u", "", None]), rng.choice([None, 1, 2]), rng.choice([None, 0.1, 0.2]), f"2024-01-0{rng.randrange(1, 4)}") for i in range(300)]
    trust = {"s1": 3, "s2": 5}
    groups = {}
    for r in rows:
        value = lambda x: -1 if x is None else x
        key = (sum(1 for x in (r[3],) if x), r[11], trust.get(r[2], -1), value(r[7]), value((r[10] or {}).get("overall")), (r[7] is not None))
        groups.setdefault(r[1], []).append((r[0], (key[0] + key[5], *key[1:5])))
    want = set()
    for c, members in groups.items():
        for i, v in members:
            others = [u for j, u in members if j != i]
            if others and all(all(x >= y for x, y in zip(v, u, strict=True)) and v != u for u in others):
                want.add((c, i))
    got = {(r["cluster_id"], r["record_id"]) for r in representatives.dominant_records(spark.createDataFrame(rows, RECORD), catalog(spark)).collect()}
    assert got == want


def test_survivor_is_built_field_by_field(spark):
    df = spark.createDataFrame([record(1, "a", url=None, tokens=9), record(2, "a", url="u2", tokens=None)], RECORD)
    r = representatives.surviving_records(df, catalog(spark)).first()
    assert (r["url"], r["token_count"], r["n_records"]) == ("u2", 9, 2)


# 5 near duplicates


def brute_pairs(texts, n, t):
    sets = {}
    for i, x in enumerate(texts):
        w = re.findall(r"[^\W_]+", (x or "").lower())
        if s := {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}:
            sets[i] = s
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


def edited(rng, text):
    w = text.split()
    for _ in range(rng.randrange(1, 6)):
        k = rng.randrange(len(w))
        w[k : k + rng.randrange(0, 2)] = [f"n{rng.randrange(10**6)}"] if rng.random() < 0.7 else []
    return " ".join(w)


@pytest.mark.parametrize(("n", "t"), [(3, 0.7), (5, 0.8)])
def test_near_duplicates_against_brute_force(spark, n, t):
    rng = random.Random(7)
    texts = [None, "", "one two", "A b c", "a B, c!"]
    for _ in range(60):
        base = sentence(rng, rng.choice([6, 20, 60, 200]), 50 if rng.random() < 0.3 else 4000)
        texts += [base] + [edited(rng, base) for _ in range(rng.randrange(0, 3))]
    texts += [texts[10]] * 40
    df = docs(spark, *texts)
    found = near.near_duplicates(df.union(df.limit(5)), near.NearDuplicateConfig(n, t))
    got = [tuple(r) for r in near.pairs(found).select("doc_id_a", "doc_id_b").collect()]
    assert set(got) == brute_pairs(texts, n, t) and len(got) == len(set(got))
    few = near.NearDuplicates(found.classes, found.links, near.NearDuplicateConfig(n, t, expand_copies=5))
    star = {tuple(r) for r in near.pairs(few).select("doc_id_a", "doc_id_b").collect()}
    assert star < set(got) and {b for a, b in star if a == 10} >= set(range(len(texts) - 40, len(texts)))
    g = {r["doc_id"]: r for r in near.groups(found).collect()}
    assert all(g[a]["cluster_id"] == g[b]["cluster_id"] for a, b in got) and g[10]["copies"] == 41


def test_hot_segments_are_split(spark):
    rng = random.Random(11)
    base = sentence(rng, 60, 4000).split()
    texts = [" ".join([*base[:k % 60], f"n{k}", *base[k % 60 + 1 :]]) for k in range(150)] + [sentence(rng, 60, 4000) for _ in range(50)]
    want = brute_pairs(texts, 3, 0.7)
    small = near.NearDuplicateConfig(3, 0.7, bucket_entries=500, hot_entries=20)
    found = near.near_duplicates(docs(spark, *texts), small)
    got = [tuple(r) for r in near.pairs(found).collect()]
    assert set(got) == want and len(got) == len(want)
    m = {r["doc_id"]: r for r in near.members(found).collect()}
    assert len(m) == 200 and all(m[i]["links"] == sum(i in p for p in want) for i in range(200)) and m[0]["expanded"]


def test_signatures_take_few_bytes_in_many_buckets(spark):
    from loamworks.operators import similar_sets

    rng = random.Random(3)
    sets, bounds = shingles.shingle_sets([sentence(rng, 200, 4000) for _ in range(1000)], 3)
    sig, owner, flags = setjoin.signatures(sets, bounds, setjoin.Bands(0.7), (np.empty(0, np.uint64), np.empty(0, np.float32)))
    short = similar_sets.short_names(similar_sets.fingerprints(sets, bounds), np.diff(bounds))
    total = 0
    for k in range(650):
        here = (sig >> np.uint64(40)) % np.uint64(650) == k
        # as many bits as the signatures of some 6 GB of documents ask for
        key = sig[here] & np.uint64(2 ** similar_sets._key_bits(3_000_000_000, 650) - 1)
        blob = similar_sets._pack(key, owner[here], flags[here], short)
        total += len(blob)
        got = zip(*(x.tolist() for x in similar_sets._unpack(blob)), strict=True)
        assert sorted(got) == sorted(zip(key.tolist(), short[owner[here]].tolist(), flags[here].tolist(), strict=True))
    assert total < 11 * len(sig)


def test_sets_of_one_short_name_are_compared(spark, monkeypatch):
    from loamworks.operators import similar_sets

    rng = random.Random(4)
    base = sentence(rng, 60, 4000).split()
    texts = [" ".join([*base[:k], f"n{k}", *base[k + 1 :]]) for k in range(10, 50, 5)]
    monkeypatch.setattr(similar_sets, "_short_name", lambda: F.col("n"))
    monkeypatch.setattr(similar_sets, "_candidates", lambda *x: spark.createDataFrame([], "a long, b long"))
    found = near.near_duplicates(docs(spark, *texts), near.NearDuplicateConfig(3, 0.7))
    assert {tuple(r) for r in near.pairs(found).collect()} == brute_pairs(texts, 3, 0.7) != set()


def test_setjoin_finds_all_pairs_at_every_size():
    rng = np.random.default_rng(5)
    sets = []
    for size in [1, 2, 3, 5, 9, 17, 33, 48, 49, 80, 200, 500] * 6:
        a = rng.integers(0, 2**63, size).astype(np.uint64)
        cut = int(size * rng.uniform(0, 0.2))
        b = np.concatenate([a[cut:], rng.integers(0, 2**63, int(size * rng.uniform(0, 0.15))).astype(np.uint64)])
        sets += [np.unique(a), np.unique(b)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    bands = setjoin.Bands(0.7)
    sig, owner, flags = setjoin.signatures(np.concatenate(sets), bounds, bands, (np.empty(0, np.uint64), np.empty(0, np.float32)))
    a, b, n = setjoin.matches(sig, owner, flags, np.diff(bounds), bands)
    got = {(min(x, y), max(x, y)) for x, y, k in zip(a.tolist(), b.tolist(), n.tolist(), strict=True) if k >= bands.shared}
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if common >= 0.7 * (len(sets[i]) + len(sets[j]) - common):
                assert (j, i) in got


def test_shingles():
    sets, bounds = shingles.shingle_sets(["a b c a b c", None, "A, b; C", "x"], 3)
    assert np.diff(bounds).tolist() == [3, 0, 1, 0] and sets[bounds[2]] in sets[: bounds[1]]


# 6 quality


def quality_texts():
    rng = random.Random(9)
    pick = lambda n: "".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(n))
    nouns, verbs = [pick(2) + "er" for _ in range(150)], [pick(2) + "ed" for _ in range(80)]

    def say() -> str:
        n, v = lambda: rng.choice(nouns), lambda: rng.choice(verbs)
        return rng.choice([f"The {n()} {v()} a {n()} when they {v()} it in the {n()}.", f"We {v()} and {v()} with the {n()}, but not for the {n()}.", f"There was a {n()} by the {n()} that had {v()} us."])

    prose = [" ".join(say() for _ in range(6)) + "\n\n" + " ".join(say() for _ in range(4)) for _ in range(40)]
    table = ["\n".join(f"Qarn{rng.randrange(99)} | {rng.randrange(9999)} | {rng.random():.3f} | zib" for _ in range(15)) for _ in range(20)]
    markup = ["\n".join(f'<td class="c-{rng.randrange(99)}" id="{rng.randrange(10**6):x}"></td>' for _ in range(15)) for _ in range(20)]
    lists = ["\n".join(f"{k}. blor{rng.randrange(99)} Varn, tup" for k in range(15)) for _ in range(20)]
    return prose, table + markup + lists


def test_line_model():
    prose, other = quality_texts()
    texts = prose[:30] + other[::2]
    rated = [True] * 30 + [False] * len(other[::2])
    model = quality.train(texts, rated)
    held = prose[30:] + other[1::2] + ["just some words from a post that they wrote without any stops because they were in a hurry"]
    lines = quality.line_statistics(held, model.vocabulary)
    share = quality.shares(lines, model.label(lines), len(held))
    said = (1 - share[:, quality.PROSE]) > model.threshold
    assert not said[:10].any() and said[10:-1].all() and not said[-1]
    echo = quality.line_statistics(["The same old line is said again in the evening.\n" * 12], model.vocabulary)
    assert quality.shares(echo, model.label(echo), 1)[0, quality.JUNK] == 1


def test_text_statistics(spark):
    prose, other = quality_texts()
    model = quality.train(prose[:30] + other[::2], [True] * 30 + [False] * len(other[::2]))
    df = docs(spark, "One two, three.\n\n- four", None, "", " \n ", "word " * 20000, other[1])
    r = {x["doc_id"]: x for x in quality.text_statistics(df, model).collect()}
    assert r[0]["n_words"] == 5 and r[0]["n_lines"] == 2 and r[0]["lines_ending_in_punctuation"] == 0.5
    assert r[1]["n_words"] is None and r[2]["n_words"] == 0 and r[2]["is_prose"] is None and r[3]["is_prose"] is None and r[4]["n_words"] == 20000
    assert 5 in {x["doc_id"] for x in quality.not_prose(quality.text_statistics(df, model)).collect()}


def test_line_model_with_hardly_any_data(spark):
    empty = spark.createDataFrame([], "doc_id bigint, aspect string, rating string")
    model = quality.fit_line_model(docs(spark, "A short text with some words in it."), empty)
    assert quality.text_statistics(docs(spark, "a", None), model).count() == 2
    assert quality.text_statistics(docs(spark).limit(0) if False else docs(spark, "a").limit(0), model).count() == 0


# 7 packing


def check_plan(counts, capacity, plan):
    used = Counter()
    for parts, k in plan:
        assert k > 0 and sum(s * m for s, m in parts.items()) <= capacity
        for s, m in parts.items():
            used[s] += m * k
    assert used == Counter({s: n for s, n in counts.items() if n})


def least_packs(sizes, capacity):
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for r in {*rooms}:
            if r >= sizes[i]:
                k = rooms.index(r)
                go(i + 1, rooms[:k] + [r - sizes[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


def test_packing_plans():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([10, 12, 20])
        sizes = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))), reverse=True)
        counts = dict(Counter(sizes))
        fixed, rest = packing.reduce_dominated(counts, capacity)
        check_plan(counts, capacity, fixed + packing.best_fit(rest, capacity))
        # fixing the dominating sets must leave a best packing within reach
        left = sorted((s for s, k in rest.items() for _ in range(k)), reverse=True)
        assert sum(k for _, k in fixed) + (least_packs(left, capacity) if left else 0) == least_packs(sizes, capacity)
    big = {s: rng.randrange(1, 10_000) for s in range(1, 513)}
    plan = packing.plan_packs(big, 512)
    check_plan(big, 512, plan)
    assert sum(k for _, k in plan) <= 1.01 * sum(s * n for s, n in big.items()) / 512 + 1


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(1, 300)) for i in range(400)] + [(400, 1000), (401, 0), (402, None), (403, 512)] + [(500 + i, 7) for i in range(300)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, token_count bigint, pack string")
    packs = spark.createDataFrame([("s", 256), ("s", 256), ("l", 1024), ("none", None)], "pack string, capacity_tokens bigint")
    got = packing.pack(df.drop("pack"), packs).collect()
    cap, filled, parts = {"s": 256, "l": 1024}, Counter(), Counter()
    for r in got:
        filled[r["pack"], r["pack_id"]] += r["n_tokens"]
        parts[r["pack"], r["doc_id"]] += r["n_tokens"]
    assert all(n <= cap[p] for (p, _), n in filled.items())
    assert parts == Counter({(p, i): n for p in cap for i, n in rows if n})
    assert sum(1 for r in got if r["pack"] == "l" and r["doc_id"] == 400) == 1
    report = {r["pack"]: r for r in packing.pack_report(packing.pack(df.drop("pack"), packs), packs).collect()}
    assert all(r["fill"] > 0.97 for r in report.values())
    assert packing.pack(df.drop("pack").limit(0), packs).count() == 0 and packing.pack(df.drop("pack"), packs.limit(0)).count() == 0


# 8 mixing

PLAN = "plan string, source string, weight double, max_repeats int, budget_tokens bigint"


def test_mix(spark):
    rows = [(i, ["A ", "b", "c"][i % 3], 10 + i % 7) for i in range(900)] + [(900, None, 5), (901, "a", None), (902, "a", 0)]
    counted = spark.createDataFrame(rows, "doc_id bigint, source string, token_count bigint")
    plans = spark.createDataFrame(
        [("p", "a", 2.0, 1, 3000), ("p", "a", 2.0, 1, 3000), ("p", "B", 1.0, 1, 3000), ("p", "zz", 5.0, 1, 3000), ("p", "c", None, 1, 3000), ("q", "a", 9.0, None, None), ("q", "b", 1.0, 3, None), ("r", "a", 1.0, 4, None), (None, "a", 1.0, 1, 1)], PLAN
    )
    report = {(r["plan"], r["source"]): r for r in mixing.mix_report(counted, plans).collect()}
    assert set(report) == {("p", "a"), ("p", "b"), ("q", "a"), ("q", "b"), ("r", "a")}
    assert report["p", "a"]["target_tokens"] == 2000 and 2000 - 17 < report["p", "a"]["actual_tokens"] <= 2000
    whole = sum(n for i, s, n in rows if s == "A " or (s == "a" and n))
    assert report["r", "a"]["actual_tokens"] == 4 * whole and report["r", "a"]["most_repeats"] == 4
    assert abs(report["q", "a"]["actual_share"] - 0.9) < 0.01 and report["q", "a"]["actual_tokens"] == whole
    got = mixing.mix(counted, plans)
    assert got.groupBy("plan", "doc_id").count().where("count > 1").count() == 0
    assert sorted(got.collect()) == sorted(mixing.mix(counted.repartition(7), plans).collect())
    assert mixing.mix(counted.limit(0), plans).count() == 0 and mixing.mix(counted, plans.limit(0)).count() == 0


# 9 reading level


def test_every_trained_gram_keeps_its_values():
    rng = np.random.default_rng(2)
    for n in (0, 1, 300, 20_000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        if n:
            keys = np.unique(np.concatenate([keys, keys[:100] ^ np.uint64(1 << 40), np.array([0, 1 << 63], np.uint64)]))
        values = rng.random((len(keys), 3)).astype(np.float32)
        table = reading.Table(keys, values)
        assert (table(keys) == values).all()
        # neither the slot nor the upper bits alone make a hit
        strange = np.setdiff1d(np.concatenate([keys ^ np.uint64(1 << 41), rng.integers(0, 2**64, 1000, dtype=np.uint64)]), keys)
        assert not table(strange).any()


def test_isotonic():
    x, y = reading.isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]))
    assert y.tolist() == [1.0, 2.5, 4.0] and x.tolist() == [1.0, 2.5, 4.0]


def level_text(rng, level, n=12):
    words = {0: "cat dog sun red big run see the a on", 1: "committee archive reviewed editors weekly season because several original the", 2: "epistemic notwithstanding jurisprudence whereas heterogeneous provenance ostensibly covariance of the"}[level].split()
    return " ".join(" ".join(rng.choice(words) for _ in range(9)) + "." for _ in range(n))


def test_reading_levels(spark):
    rng = random.Random(6)
    texts = [level_text(rng, k % 3) for k in range(120)]
    model = reading.train(texts, [k % 3 for k in range(120)])
    held = [level_text(rng, k % 3) for k in range(60)]
    grade = model.grade(model.difficulty(held)[0])
    assert ((grade >= 0.5).astype(int) + (grade >= 1.5) == np.arange(60) % 3).mean() > 0.95
    mixed = level_text(rng, 0, 20) + " " + level_text(rng, 2, 2)
    assert model.grade(model.difficulty([mixed])[0])[0] < 0.5
    prose, other = quality_texts()
    lines = quality.train(prose[:30] + other[::2], [True] * 30 + [False] * len(other[::2]))
    df = docs(spark, held[0] + " and then they were in it with the", None, "", other[1], "one")
    got = {r["doc_id"]: r for r in reading.reading_levels(df, model, lines).collect()}
    assert len(got) == 5 and got[1]["band"] is None and got[2]["band"] is None and got[4]["band"] is not None
    assert {r["doc_id"] for r in reading.prose_levels(reading.reading_levels(df, model, lines)).collect()} <= {0}


def test_reading_model_from_tables(spark):
    rng = random.Random(8)
    df = docs(spark, *[level_text(rng, k % 3) for k in range(60)])
    rows = [(k, "reading_level", [" Elementary", "INTERMEDIATE", "advanced "][k % 3]) for k in range(60)] + [(0, "reading_level", None), (1, "text_kind", "prose"), (2, "reading_level", "elementary")]
    ratings = spark.createDataFrame(rows, "doc_id bigint, aspect string, rating string")
    model = reading.fit_reading_model(df, ratings)
    assert model.grade(model.difficulty([level_text(rng, 2)])[0])[0] > 1.5
    empty = reading.fit_reading_model(df, ratings.limit(0))
    assert len(empty.difficulty(["a b", None])[0]) == 2


def test_reading_model_counts_every_rated_document(spark):
    rng = random.Random(9)
    texts = [level_text(rng, k % 3) + f" rare{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k // 100 % 10]}{'abcdefghij'[k // 1000]} word" for k in range(4500)]
    texts[7] += " longest" + " of all" * 70_000
    ratings = spark.createDataFrame([(k, "reading_level", reading.BANDS[k % 3]) for k in range(4500)], "doc_id bigint, aspect string, rating string")
    model = reading.fit_reading_model(docs(spark, *texts), ratings)
    known = reading._language_models(texts, np.arange(4500) % 3, model.config)
    ids, counts = reading.word_sequence(texts)
    for got, want in zip(model.parts(ids, counts), known.parts(ids, counts), strict=True):
        assert np.allclose(got, want, rtol=1e-5)
    assert (model.tables[0](reading._grams(ids, counts)[0]).max(axis=1) > 0).all()


# batches


def test_pieces():
    import pyarrow as pa

    from loamworks.llm.batches import pieces

    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["a" * 5, None, "b" * 30, "", "c" * 4, "d" * 4, "é"])], names=["i", "t"])
    cut = [p.column(0).to_pylist() for p in pieces(batch, 1, 3, 10)]
    assert [i for p in cut for i in p] == list(range(7)) and [2] in [p[:1] for p in cut] and max(map(len, cut)) <= 3
    assert list(pieces(batch.slice(0, 0), 1, 3)) == []


def test_initials_titles_and_trailing_house_numbers(personal_model):
    text = "Thanks to T. Hulvmire and Ms O. Garvlund. Post an Ambrelstr. 127, Stavscombe. Correo: Avenida de Mallin, 219, Dunholt. Am Grentz 200-202 ist zu. El paquete espera en Avda. Rondel nº 127."
    got = {text[a:b] for a, b, _ in personal_model.spans([text])[0]}
    assert {"T. Hulvmire", "O. Garvlund", "Ambrelstr. 127", "Avenida de Mallin, 219", "Avda. Rondel nº 127"} <= got
