"""Rare languages, containers of pages, rare-shingle anchors and bounded training rows."""

import math
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heliodrift.llm import decontamination, language, linear, main_text, quality, toxicity

SMALL = "/root/testdata/sf0.001"
GREEK = [
    "Το καλοκαίρι οι ψαράδες γύριζαν αργά στο λιμάνι και κάθονταν κάτω από τα πεύκα για να ξεκουραστούν.",
    "Η πόλη ήταν μικρή, αλλά οι δρόμοι της γέμιζαν κάθε βράδυ με ανθρώπους που μιλούσαν για τη θάλασσα.",
    "Κανείς δεν ήξερε πότε θα φύγει το πλοίο, γιατί ο καιρός άλλαζε από τη μια ώρα στην άλλη.",
    "Στο τέλος του δρόμου υπήρχε ένα παλιό σπίτι με μπλε παράθυρα και μια μεγάλη αυλή.",
]
POLISH = [
    "Zażółcone liście spadały na ścieżkę, a rybak wracał powoli do domu nad jeziorem.",
    "Wieczorem wszyscy siadali przy oknie i opowiadali sobie historie o dawnych czasach.",
    "Nikt nie wiedział, kiedy odpłynie statek, ponieważ pogoda zmieniała się z godziny na godzinę.",
    "Na końcu ulicy stał stary dom z niebieskimi okiennicami i dużym podwórzem.",
]


def test_rare_languages_are_kept(spark):
    """Four documents of each among a thousand, none of which shares their language."""
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    rare = [(10_000 + k, t, "el" if t in GREEK else "pl", "src1") for k, t in enumerate(GREEK + POLISH)]
    docs = given.unionByName(spark.createDataFrame(rare, given.schema))
    found = {r.doc_id: r for r in language.languages(docs, host=docs["source"]).collect()}
    for key, _, lang, _ in rare:
        assert found[key].kept and found[key].language == lang
    same = Counter(found[r.doc_id].language == r.lang for r in given.collect() if found[r.doc_id].kept)
    assert same[False] == 0


def test_many_languages_are_scored_in_pieces(spark, monkeypatch):
    rows = [(k, f"{'abcdefghij'[k % 10] * 3} {'klmnopqrst'[k % 10] * 4} " * 5, f"x{'abcdefghij'[k % 10]}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = sorted(map(tuple, language.languages(docs).collect()))
    assert all(lang == rows[key][2] for key, _, lang, _, _ in whole)
    model = language.train(language.evidence(docs, "text", "lang", F.lit(None).cast("string")), "doc_id")
    texts = [t.encode() for _, t, _ in rows]
    _, means = model.means(texts)
    monkeypatch.setattr(language, "DENSE", 3)
    language._kept.clear()
    assert np.array_equal(means, model.means(texts)[1])
    language._kept.clear()


def plain_languages(rows):
    """The fused probabilities of rows (id, text, declared, host), evidence by evidence."""
    def grams(text):
        return language.trigrams([(text or "").encode()])[0].tolist()

    declared = Counter(d for _, _, d, _ in rows if d)
    names = sorted(d for d, n in declared.items() if n >= language.MIN_ROWS)
    models = {}
    for name in names:
        counts = Counter(b for _, t, d, _ in rows if d == name for b in grams(t))
        if counts:
            total = sum(counts.values()) + 0.5 * language.BUCKETS
            models[name] = (counts, total)
    names = [*models, "und"]
    logs = []
    for _, text, _, _ in rows:
        found = grams(text)
        weight = min(len(found), language.TEXT_WEIGHT)
        means = [sum(math.log((c[b] + 0.5) / t) for b in found) / max(1, len(found)) for c, t in models.values()]
        logs.append([weight * m for m in [*means, -math.log(language.BUCKETS)]])
    guesses = [names[max(range(len(names)), key=lambda k: (x[k], -k))] for x in logs]
    parts = [(h, ".".join(h.split(".")[-2:]) if h and "." in h else None, h.split(".")[-1] if h and "." in h else None) for *_, h in rows]

    def given(values, bonus):
        kept = [(v, g) for v, g in zip(values, guesses, strict=True) if v is not None]
        counts, sums, kinds = Counter(kept), Counter(g for _, g in kept), len({v for v, _ in kept})
        return {v: [math.log((counts[v, m] + bonus * (m == v) + 1) / (sums[m] + bonus + kinds + 1)) for m in names] for v, _ in kept}

    by_declared = given([d for _, _, d, _ in rows], language.HOST_STRENGTH)
    by_suffix = given([s for _, _, s in parts], 0.0)
    whole = Counter(guesses)
    total = sum(whole[n] for n in names[:-1])
    corpus = {n: 0.99 * (whole[n] + 1) / (total + len(names) - 1) for n in names[:-1]} | {"und": 0.01}
    out = []
    for (key, text, lang, host), x, (_, domain, suffix) in zip(rows, logs, parts, strict=True):
        if domain:
            around = Counter(g for g, p in zip(guesses, parts, strict=True) if p[1] == domain)
            own = Counter(g for g, p in zip(guesses, parts, strict=True) if p[0] == host)
            s = language.HOST_STRENGTH
            middle = {n: (around[n] + s * corpus[n]) / (sum(around.values()) + s) for n in names}
            prior = [math.log((own[n] + s * middle[n]) / (sum(own.values()) + s)) for n in names]
        elif host:
            own, s = Counter(g for g, p in zip(guesses, parts, strict=True) if p[0] == host), language.HOST_STRENGTH
            prior = [math.log((own[n] + s * corpus[n]) / (sum(own.values()) + s)) for n in names]
        else:
            prior = [math.log(corpus[n]) for n in names]
        nothing = [0.0] * len(names)
        sums = [sum(v) for v in zip(x, prior, by_declared.get(lang, nothing), by_suffix.get(suffix, nothing), strict=True)]
        best = max(range(len(names)), key=lambda k: (sums[k], -k))
        some = bool(grams(text))
        out.append((key, names[best] if some else "und", 1 / sum(math.exp(v - sums[best]) for v in sums) if some else 0.0))
    return out


def test_fused_evidence_equals_a_plain_version(spark):
    """Text, declaration, suffix, and hosts smoothed by domains, all of which matter for some row."""
    rng = np.random.default_rng(4)
    base = {"en": "the river and the town were quiet", "fr": "la rivière et la ville étaient calmes", "nl": "de rivier en de stad waren stil"}
    rows = []
    for k in range(90):
        lang = str(rng.choice(list(base)))
        words = base[lang].split() + (base["en"].split() if k % 4 == 0 else [])
        text = " ".join(rng.choice(words, int(rng.integers(1, 9))))
        host = [f"www.{lang}site.{ {'en': 'com', 'fr': 'fr', 'nl': 'nl'}[lang]}", f"blog.shared{k % 3}.org", "local", None][k % 4]
        rows.append((k, text, [lang, None, "en", "xx" if k == 7 else lang][k % 4], host))
    rows += [(900, None, "en", "www.ensite.com"), (901, "", None, None), (902, "12 34", "fr", "x.fr"), (903, "de stad " * 400, None, "deep.a.b.nl"), (5, rows[5][1], "nl", "new.host.nl")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string").repartition(4)
    found = sorted((r.doc_id, r.language, r.probability) for r in language.languages(docs, host=docs["host"]).collect())
    wanted = sorted(plain_languages(rows))
    assert [f[:2] for f in found] == [w[:2] for w in wanted]
    assert [f[2] for f in found] == pytest.approx([w[2] for w in wanted], abs=1e-5)


ARTICLE = "The story of the town is that it was built by the people who came with the boats and they had to work for all of it in the end."


@pytest.mark.parametrize(
    "page",
    [
        '<body class="page with-menu"><article><p>{}</p></article></body>',
        '<body id="sidebar-left" class="has-sidebar no-comments"><p>{}</p></body>',
        '<main class="has-sidebar"><p>{}</p></main>',
        '<div class="legal-article"><p>{}</p></div>',
        '<article id="comment-policy"><p>{}</p></article>',
        '<div id="comments"><p>{}</p></div>',
        '<div class="menu"><p>Home</p></div><div class="notice-wrap"><p>{}</p></div>',
    ],
)
def test_names_of_containers_do_not_lose_a_page(page):
    assert ARTICLE in main_text.main_blocks(page.format(ARTICLE))


def test_names_still_rule_out_what_stands_beside():
    other = "I do not like it at all and it is not what the people of the town want to be in the end of it, as they say."
    for beside in (
        '<div id="comments"><article class="comment"><p>{}</p></article></div>',
        '<div class="post-comments"><p>{}</p></div>',
        '<div class="widget-area has-text"><p>{}</p></div>',
        '<article class="comment reply"><p>{}</p></article>',
    ):
        inside = f"<article><p>{ARTICLE}</p>{beside.format(other)}</article>"
        after = f"<article><p>{ARTICLE}</p></article>" + beside.replace("<article class", "<div class").format(other)
        assert main_text.main_blocks(inside) == main_text.main_blocks(after) == [ARTICLE]


def test_sparse_blocks_go_by_the_language_of_the_page():
    polish = " ".join(POLISH)
    for page in ('<html lang="pl">', '<html class="x" lang=pl-PL>', "<html>"):
        assert main_text.main_blocks(f"{page}<body><p>{polish}</p><p>{ARTICLE}</p><p>{polish}</p>") == [polish, ARTICLE, polish]
    assert main_text.main_blocks(f'<html lang="en"><body><p>{ARTICLE}</p><p>{polish}</p>') == [ARTICLE]


def test_built_pages_give_their_articles_back(spark):
    """Known texts inside pages of several builds: almost all of each, and almost nothing else."""
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect() if r.text and len(r.text) > 400]
    builds = [
        "<html><body class='home has-sidebar'><div class=nav><a href=/>Home</a> <a href=/a>About the house</a></div><main>{}</main><div class='sidebar'><p>Read more of the stories that the others of us wrote for you in the days before.</p></div></body></html>",
        "<html><body><header><h1>Site</h1></header><article class='post'>{}<div class='share'><p>Share</p></div></article><footer><p>All rights are reserved and it is not for you to copy any of this text of ours.</p></footer></body></html>",
        "<div id=wrap><ul class='menu'><li><a href=/>One</a><li><a href=/>Two</a></ul><div class='content'>{}</div><div id='comments'><p>I think that this is not what they said it was, but it is as good as it can be for us.</p></div></div>",
    ]
    kept = held = given = 0
    for k, text in enumerate(texts):
        paragraphs = [" ".join(p.split()) for p in text.split("\n") if p.split()]
        page = builds[k % 3].format("".join(f"<p>{p.replace('&', '&amp;').replace('<', '&lt;')}</p>" for p in paragraphs))
        found = "\n".join(main_text.main_blocks(page)).split()
        wanted = " ".join(paragraphs).split()
        kept += sum((Counter(found) & Counter(wanted)).values())
        held, given = held + len(wanted), given + len(found)
    assert kept >= 0.95 * held and kept >= 0.95 * given


def windows(texts, items):
    """All pairs by a full scan of every window: the best similarity and its first place."""
    out = set()
    for row, text in enumerate(texts):
        shingles = next(iter(decontamination.row_shingles(*decontamination.word_hashes([text]))))
        for k, item in enumerate(items):
            bag = next(iter(decontamination.row_shingles(*decontamination.word_hashes([item]))))
            best = (0.0, 0)
            for start in range(max(1, len(shingles) - len(bag) + 1)):
                part = shingles[start : start + len(bag)]
                if len(part) and len(bag):
                    best = max(best, (decontamination.weighted_similarity(part, bag), -start))
            if best[0] >= 0.75:
                out.add((row, k, -best[1], round(best[0], 9)))
    return out


def test_rare_shingles_find_every_pair_that_a_full_scan_finds():
    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(60)]
    opening = " ".join(rng.choice(vocabulary, 14))
    items = [f"{opening} {' '.join(rng.choice(vocabulary, int(rng.integers(4, 30))))}" for _ in range(60)]
    items += ["a b " * 12, "a b a b c", items[3], " ".join(rng.choice(vocabulary, 5))]
    texts = []
    for k in range(60):
        words = items[k].split()
        for at in rng.choice(len(words), int(rng.integers(0, 1 + len(words) // 24)), replace=False):
            words[at] = "changed"
        cut = words[: len(words) - int(rng.integers(0, 4))] if k % 3 == 0 else words
        around = list(rng.choice(vocabulary, 40)) if k % 2 else []
        texts.append(" ".join([*around, *cut, *around]))
    texts += [" ".join([opening, "x y z", opening] * 30), "a b " * 40, items[5] + " " + items[5], ""]
    texts = [t.encode() for t in texts]
    found = decontamination.Items(list(range(len(items))), items).matches(texts)
    wanted = windows(texts, [i.encode() for i in items])
    assert {(r, k, p, round(v, 9)) for r, k, p, v, _ in found} == wanted and len(wanted) > 40


def test_items_that_share_nothing_rare_cost_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{k}" for k in range(5_000)]
    opening = " ".join(rng.choice(vocabulary, 12))
    text = " ".join(f"{opening} {' '.join(rng.choice(vocabulary, 8))}" for _ in range(100)).encode()
    compared = []
    real = decontamination.Items._compare
    monkeypatch.setattr(decontamination.Items, "_compare", lambda *a: compared.append(len(a[2])) or real(*a))
    for size in (500, 5_000):
        items = [f"{opening} {' '.join(rng.choice(vocabulary, 8))}" for _ in range(size)]
        compared.clear()
        list(decontamination.Items(list(range(size)), items).matches([text]))
        # A full comparison would be of some 2,000 windows with each item.
        assert sum(compared) < size


def test_an_id_of_many_rows_is_one_row_of_the_sample(spark):
    rows = [(1, f"text {k}") for k in range(3_000)] + [(k, f"word {k}") for k in range(2, 40)] + [(None, "x"), (50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 60)] + [(1, 1), (None, 1)], "doc_id long, quality int")
    sample = linear.labelled_sample(docs, labels, ["quality"], quality.FEATURES, 30)
    found = [r.doc_id for r in sample.collect()]
    assert len(found) == len(set(found)) <= 30 and None not in found
    whole = linear.labelled_sample(docs, labels, ["quality"], quality.FEATURES, 100)
    assert whole.count() == 40 and whole.where("doc_id = 1").first()["quality"] == 1


def test_toxicity_without_a_signal_or_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, "plain"), (None, ""), (2, "plain")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    found = toxicity.toxicity_scores(docs, labels).collect()
    assert [(r.p_toxic, r.predicted) for r in found] == [(0.5, 0)] * 4
    assert toxicity.toxicity_scores(docs.limit(0), labels).collect() == []
    assert quality.quality_scores(docs.limit(0), labels.withColumnRenamed("toxic", "quality")).collect() == []


def test_the_pipeline_on_an_empty_table_and_with_clashing_columns(spark, tmp_path):
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    given.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    odd = given.withColumns({c: F.lit(1) for c in ("key", "id", "row", "hub", "bucket", "items", "mark", "kept", "ids")})
    (tmp_path / "more").mkdir()
    odd.write.parquet(f"{tmp_path}/more/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/more/benchmark.parquet")
    found = corpus_pipeline.run(spark, f"{tmp_path}/more").collect()
    assert 0 < len(found) <= given.count() and len({r.doc_id for r in found}) == len(found)


def test_a_chain_over_the_slots_that_occur_has_the_same_weights_in_less_memory():
    rng = np.random.default_rng(4)
    bits = 20
    slots = [np.unique(rng.integers(0, 200, 60)).astype(np.int32) * 4096 for _ in range(300)]
    rows = [(s, np.ones(len(s), np.float32)) for s in slots]
    labels = np.array([[float(4096 * k in s) for k in (3, 7, 11)] for s in slots])
    folds = np.arange(300) % toxicity.FOLDS
    plain = toxicity.fit_chain(rows, labels, folds, bits=bits)
    found = toxicity.fit_compact(rows, labels, folds, bits=bits).to_pylist()
    tracemalloc.start()
    toxicity.fit_compact(rows, labels, folds, bits=bits)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for weights, row in zip(plain, found, strict=True):
        assert np.flatnonzero(weights).tolist() == row["slots"]
        assert weights[row["slots"]].tolist() == row["weights"] and len(row["slots"]) > 2
    assert peak < 8 << bits  # two arrays of doubles over all slots would take twice that
