"""Personal data, byte tokens, main text, language and the fitted classifiers."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from brute import base_spans
from pyspark.sql import functions as F

from heliodrift.llm import bpe, language, linear, main_text, pii, quality, toxicity
from heliodrift.llm.queries import RANKS

SMALL = "/root/testdata/sf0.01"


def docs(spark, texts):
    return spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, key int, ids string")


def random_texts(seed, signs, count=150, size=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(size))) for _ in range(count)]


def test_base_spans_equal_the_stated_expressions():
    texts = [
        "mail me at a.b+c@x-y.example.org. or +1 (212) 555-0100, card 4111 1111 1111 1111",
        "4111-1111-1111-1112 1.2.3.4.5 256.1.1.1 001.002.003.0004 ++12 345-678 901", "a@b@c.d@e.f", "9" * 5000, "a" * 5000 + "@",
    ]
    signs = ["1", "2", "9", "0", ".", "-", " ", "+", "(", "@", "a", "_", "4111111111111111", "1.1.1.1", "a@b.c", "\n", "é"]
    for text in [*texts, *random_texts(1, signs, 3000)]:
        found = [f"{k}:{s}:{e}" for k, s, e, _ in pii.find_spans(text) if k in pii.BASE_KINDS]
        assert found == base_spans(text), text


def test_numbers_of_accounts_need_their_remainder_and_context_moves_scores():
    good = "GB82 WEST 1234 5698 7654 32"
    assert [s[0] for s in pii.find_spans(f"pay to {good} now") if s[0] == "iban"] == ["iban"]
    assert not [s for s in pii.find_spans("GB82 WEST 1234 5698 7654 33") if s[0] == "iban"]
    plain, near = (pii.find_spans(t + "10.0.0.1")[0][3] for t in ("", "server "))
    assert near > plain > pii.find_spans("version 10.0.0.1")[0][3]


def test_span_digests_and_masking(spark):
    texts = ["a@b.co +49 30 1234567", None, "", "plain", "ü a@b.co"]
    rows = pii.span_digests(docs(spark, texts)).orderBy("doc_id").collect()
    for row, text in zip(rows, texts, strict=True):
        joined = ",".join(base_spans(text))
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    assert (rows[0].n_email, rows[0].n_phone, rows[3].n_email) == (1, 1, 0)
    masked = pii.masked_documents(docs(spark, texts).withColumn("n_chars", F.lit(99).cast("long")))
    assert [r.text for r in masked.orderBy("doc_id").collect()] == ["[EMAIL] [PHONE]", None, "", "plain", "ü [EMAIL]"]
    assert [r.n_chars for r in masked.orderBy("doc_id").collect()] == [15, 99, 0, 5, 9]
    assert pii.span_digests(docs(spark, [])).count() == 0


@pytest.fixture(scope="module")
def encoding():
    lines = open(RANKS, "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


SIGNS = ["a", "the ", " ", "  ", "\n", "'s", "1", "12", "é", "日本", "🙂", ".", "!?", "　", "\x1c", "\x85", "L'", "\t"]


def test_ids_and_bytes_equal_the_library(spark, encoding, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 40)
    monkeypatch.setattr(bpe, "OVERLAP_CHARS", 9)
    texts = [None, "", "short", "<|endoftext|>", "x" * 300, " " * 200 + "a", *random_texts(7, SIGNS, 80, 150)]
    rows = bpe.encode(docs(spark, texts), RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: r.ids for r in rows.collect()} == {k: encoding.encode_ordinary(t or "") for k, t in enumerate(texts)}
    rows = bpe.token_digests(docs(spark, texts), RANKS, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    for row, text in zip(rows, texts, strict=True):
        ids = encoding.encode_ordinary(text or "")
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_any_chunking_stitches_to_the_same_pieces():
    words = bpe.Vocabulary(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    rng = random.Random(4)
    for text in [t for t in random_texts(9, SIGNS, 600, 120) if t]:
        parts = list(bpe.cut(text, rng.choice((20, 33)), rng.choice((3, 8))))
        chunks = ((a, text[a:b], bpe.bounds(words.split, text[a:b])) for a, b in parts)
        assert [x for y in bpe.stitched(words.split, chunks) for x in y] == words.split.findall(text)


def test_long_texts_and_empty_tables_of_tokens(spark, encoding):
    text = " ".join(random_texts(11, SIGNS, 900, 80))
    assert len(text) > bpe.CHUNK_CHARS
    (row,) = bpe.encode(docs(spark, [text]), RANKS, public_tokenizers.PATTERN).collect()
    assert row.ids == encoding.encode_ordinary(text)
    assert bpe.token_digests(docs(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


DENSE = "the man was in the house and it was for the others that were on the hill with a dog"


def test_main_text_of_pages(spark):
    page = (
        f"<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><a href=x>Home</a></nav>"
        f"<article><header><h1>Head &amp; line</h1></header><p><b>{DENSE}<br>x&nbsp;y<p>Short.</p><script>if (a<b) '</p>'</script>"
        f"<p>zork blub quux flob grunt wibble wobble snark frob plugh xyzzy thud corge grault waldo</p>"
        f"<form><button>Send</button></form><section class='comments'><p>{DENSE}</p></section></article>"
        f"<aside>{DENSE}</aside><div class='cookie-notice'>{DENSE}</div><footer>&copy; me</footer></body></html>"
    )
    assert main_text.main_blocks(page) == [
        "Head & line", f"{DENSE} x y", "Short.", "zork blub quux flob grunt wibble wobble snark frob plugh xyzzy thud corge grault waldo",
    ]
    plain = f"<div>{DENSE}</div><div>near</div><div>{'blub ' * 40}</div><div>far</div><div><a href=y>{DENSE}</a></div>"
    assert main_text.main_blocks(plain) == [DENSE, "near"]
    rows = [(1, "u", page, "t"), (2, None, None, "t"), (None, "v", "", "t"), (4, "w", "<!-- open", "t"), (4, "w", "a < b", "t"), (4, "w", "a < b", "t")]
    found = main_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    texts = [(r.page_id, r.text, r.n_chars) for r in found.collect()]
    assert texts[1:] == [(2, "", 0), (None, "", 0), (4, "", 0), (4, "a < b", 5), (4, "a < b", 5)]
    assert found.limit(0).count() == 0


def test_pages_in_languages_without_stop_words_keep_their_text():
    polish = "Wczoraj wieczorem nad jeziorem zebrali się mieszkańcy wioski, żeby wspólnie obejrzeć zachód słońca"
    chinese = "昨天晚上村民们聚集在湖边一起观看日落" * 5
    for text in (polish, chinese):
        page = f"<nav>{text}</nav><div><a href=x>{text}</a></div><div>{text}</div><p>{text}</p><p>x</p><footer>{text}</footer>"
        assert main_text.main_blocks(page) == [text, text, "x"]


def test_given_pages_keep_their_articles(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").limit(40).collect()
    for page in pages:
        text = "\n".join(main_text.main_blocks(page.html))
        assert text and "track(" not in text and "©" not in text


def test_languages_of_given_documents(spark):
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    wrong = given.withColumn("lang", F.when(F.col("doc_id") % 250 == 0, "xx-YY").otherwise(F.col("lang")))
    found = language.languages(wrong, host=wrong["source"])
    both = found.join(given.select("doc_id", "lang"), "doc_id")
    assert both.where("language <> lang OR NOT kept").count() == 0


def test_rejected_languages_and_odd_rows(spark):
    given = spark.read.parquet(f"{SMALL}/documents.parquet").drop("n_chars").limit(200)
    odd = [(5000, None, "en", "src0"), (5001, "", None, None), (5002, "12 | 34", "en", "src0"), (None, "", None, "src1")]
    kind = "doc_id long, text string, lang string, source string"
    rows = given.unionByName(spark.createDataFrame(odd, kind)).unionByName(given.limit(1)).withColumn("key", F.lit(1))
    found = {r.doc_id: r for r in language.languages(rows, host=rows["source"]).collect()}
    assert all(not found[k].kept and found[k].language == "und" for k in (5000, 5001, 5002, None))
    left = language.known_language(rows, host=rows["source"])
    assert left.columns == rows.columns and left.count() == 201
    assert language.languages(rows.limit(0), host=F.col("source")).count() == 0


def test_host_priors_equal_plain_smoothing(spark):
    rows = [("a.x.org", "x.org", "en")] * 30 + [("b.x.org", "x.org", "fr")] * 3 + [("c.y.org", "y.org", "fr")] + [(None, None, "en")] * 6
    frame = spark.createDataFrame(rows, "__host string, __domain string, guess string")
    found, _ = language.host_priors(frame, ["en", "fr", "und"])
    got = {r[0]: np.exp(r[1]) for r in found.collect()}
    top = np.array([0.99 * 37 / 42, 0.99 * 5 / 42, 0.01])
    for host, own, domain in (("a.x.org", (30, 0, 0), (30, 3, 0)), ("b.x.org", (0, 3, 0), (30, 3, 0)), ("c.y.org", (0, 1, 0), (0, 1, 0))):
        middle = (np.array(domain) + 20 * top) / (sum(domain) + 20)
        assert np.allclose(got[host], (np.array(own) + 20 * middle) / (sum(own) + 20))


def test_sparse_dots_equal_dense_products():
    texts = [b"a b b c", b"", b"x !! x", b"b"]
    features = linear.Features(bits=10)
    slots, values, at = features.rows(texts)
    weights = np.random.default_rng(1).normal(size=1025).astype(np.float32)
    dense = np.zeros((4, 1024))
    for row in range(4):
        dense[row, slots[at[row] : at[row + 1]]] = values[at[row] : at[row + 1]]
    assert np.allclose(linear.sparse_dots(weights, slots, values, at), dense @ weights[:-1] + weights[-1], atol=1e-5)


def test_updates_equal_the_closed_form_of_the_leader():
    """Each weight minimises what it has seen: gradients, proximal terms and both penalties."""
    rates = linear.Rates(alpha=0.3, l1=0.2, l2=0.1)
    learner = linear.FollowTheLeader(1, rates)
    for label in (1, 0, 1, 1, 1, 0, 1):
        before = learner.weights()[0]
        gradient = float(linear.sigmoid(np.array(before))) - label
        n, z = learner.n[0], learner.z[0]
        learner.update(np.array([0]), np.ones(1), label)
        step = (np.sqrt(n + gradient**2) - np.sqrt(n)) / rates.alpha
        assert np.isclose(learner.z[0], z + gradient - step * before)
        grid = np.linspace(-3, 3, 60_001)
        scale = (rates.beta + np.sqrt(learner.n[0])) / rates.alpha + rates.l2
        cost = learner.z[0] * grid + rates.l1 * np.abs(grid) + scale * grid**2 / 2
        assert abs(grid[cost.argmin()] - learner.weights()[0]) < 1e-3


def _held_out(found, truth, label, predicted):
    both = found.where("held_out").join(truth, "doc_id").select(label, predicted).collect()
    return np.array([[r[0], r[1]] for r in both])


def test_quality_on_held_out_rows(spark):
    given, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = _held_out(quality.quality_scores(given, labels), labels, "quality", "predicted")
    assert (rows[:, 0] == rows[:, 1]).mean() > 0.98


def test_toxicity_on_held_out_rows(spark):
    given, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = _held_out(toxicity.toxicity_scores(given, labels), labels, "toxic", "predicted")
    toxic = rows[:, 0] == 1
    assert rows[toxic, 1].mean() > 0.8 and rows[~toxic, 1].mean() < 0.01


def test_scores_of_odd_rows_and_without_labels(spark):
    rows = docs(spark, [None, "", "some text", "some text"])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.quality_scores(rows, labels).collect()} == {0.5}
    assert [r.p_toxic for r in toxicity.toxicity_scores(rows, labels).collect()] == [0.5] * 4
    assert quality.quality_scores(rows.limit(0), labels).count() == 0


def test_chain_learns_from_out_of_fold_predictions():
    rng = np.random.default_rng(3)
    truth = rng.integers(0, 2, 400)
    rows = [(np.array([t, 2 + k % 5]), np.ones(2, np.float32)) for k, t in enumerate(truth)]
    labels = np.column_stack((truth, truth)).astype(float)
    chain = toxicity.fit_chain(rows, labels, np.arange(400) % toxicity.FOLDS, bits=4)
    assert len(chain) == 2 and chain[0][16:18].tolist() == [0, 0]
    # The second model leans on the first one's probability, which its own rows did not teach.
    assert chain[1][16] > 0 and chain[1][17] == 0
