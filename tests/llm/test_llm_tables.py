"""Top-k search, revisits, the registered SQL, and the pipeline."""

import base64
import datetime
import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from brute import groups, passages

import corpus_pipeline
from heliodrift.llm import pii, revisits, topk
from heliodrift.llm.queries import RANKS

SMALL = "/root/testdata/sf0.001"


def plain_top(rows, queries, k):
    out = []
    usable = {i: np.floor(1024 * np.array(v, float)).astype(int) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in queries:
        if q in usable:
            scores = sorted((-int(v @ usable[q]), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_top_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(300)]
    rows += [(300 + k, rows[5][1]) for k in range(60)]  # ties
    rows += [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] + [0.0] * 7), (None, rows[0][1])]
    rows += [(500, [1.0, 2.0]), (501, [3.0, 4.0]), (502, []), (503, rows[1][1]), (503, rows[1][1])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, shard int")
    singles = [(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    queries = [*range(0, 40), 301, 400, 402, 500, 503]
    wanted = table.where(table.vec_id.isin(queries))
    found = sorted(map(tuple, topk.search(topk.build_index(table), wanted).collect()))
    assert found == plain_top(singles, queries, 10)
    assert topk.search(topk.build_index(table.limit(0)), wanted.limit(0)).count() == 0


def test_visits_stop_before_the_end_only_on_proof():
    rng = np.random.default_rng(4)
    values = (rng.normal(size=(500, 6)) * np.array([900, 500, 9, 5, 2, 1])).astype(np.int64)
    shard = topk.Shard.__new__(topk.Shard)
    shard.ids, shard.values, shard.largest = np.arange(500), values, int(np.abs(values).max())
    order = [np.argsort(values[:, d]) for d in range(6)]
    shard.members = [part for o in order for part in np.array_split(o, 16)]
    shard.dims = np.repeat(np.arange(6), 16)
    shard.low = np.array([values[m, d].min() for m, d in zip(shard.members, shard.dims, strict=True)])
    shard.high = np.array([values[m, d].max() for m, d in zip(shard.members, shard.dims, strict=True)])
    for query in values[:40]:
        scores = values @ query
        best = sorted((-int(s), k) for k, s in enumerate(scores))[:10]
        assert shard.top(-1, query, 10) == [(-s, k) for s, k in best]


def at(second):
    return datetime.datetime(2024, 5, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=second)


def test_revisits_of_every_kind(spark):
    etag = lambda x: {"ETag": x, "Date": x, "Server": "s" + x}
    rows = [
        (1, "response", "http://www.A.org/p/?b=2&a=1&utm_x=3#top", at(0), 200, etag("one")),
        (2, "response", "https://a.org:443/p?a=1&b=2", at(100), 200, etag("two")),
        (3, "response", "https://a.org/p?a=1&b=2", at(100), 404, etag("bad")),
        (4, "response", "https://a.org/p?a=1&b=2", at(100), 200, etag("tie")),
        (10, "revisit", "//a.org/p?a=1&b=2", at(100), 304, etag("W/one")),  # not the one of its own second
        (11, "revisit", "//a.org/p?a=1&b=2", at(9_999_999), 304, etag("tie")),  # from a segment long before
        (12, "revisit", "//a.org/p?a=1&b=2", at(101), 304, etag("one")),
        (13, "revisit", "//a.org/p?a=1&b=2", at(102), 304, None),
        (14, "revisit", "//a.org/other", at(102), 304, etag("one")),
        (15, "revisit", None, at(102), 304, etag("one")),
        (16, "revisit", "//a.org/p?a=1&b=2", None, 304, etag("one")),
        (None, "revisit", "//a.org/p?a=1&b=2", at(0), 304, etag("one")),
    ]
    kind = "record_id long, kind string, uri string, captured timestamp, status int, headers map<string,string>"
    records = spark.createDataFrame(rows, kind).selectExpr("*", "1 AS segment", "2 AS address")
    found = {r.record_id: r for r in revisits.resolve_revisits(records).collect()}
    assert {k: (r.response_id, r.outcome) for k, r in found.items()} == {
        10: (1, "resolved"), 11: (4, "resolved"), 12: (None, "validator_mismatch"), 13: (None, "no_validator"),
        14: (None, "no_earlier_response"), 15: (None, "no_address"), 16: (None, "no_address"), None: (None, "no_earlier_response"),
    }
    assert found[10].headers == {"etag": "W/one", "date": "W/one", "server": "sone"}
    assert found[10].canonical_uri == "a.org/p?a=1&b=2" and found[12].headers is None
    assert revisits.resolve_revisits(records.limit(0)).count() == 0


def test_pipeline_equals_its_plain_version(spark, tmp_path):
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = [(9000, None, "en", "src0", 0), (9001, "", "en", "src0", 0), (9002, "12 !", "en", "src0", 4)]
    more = given.unionByName(spark.createDataFrame(extra, given.schema)).unionByName(given.limit(2))
    more.write.parquet(f"{tmp_path}/documents.parquet")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = sorted({(r.doc_id, r.text) for r in given.collect()})
    kept = {i for i, _, _, k in groups(rows) if k}
    dirty = {d for d, *_ in passages(rows, [tuple(r) for r in bench.collect()])}
    lines = open(RANKS, "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = []
    for i, text in rows:
        if i in kept - dirty:
            masked = pii.mask(text, pii.find_spans(text))
            ids = plain.encode_ordinary(masked)
            digests = (hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), masked.encode()))
            wanted.append((i, len(ids), *digests))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == wanted
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near duplicates", "benchmark passages", "personal data", "byte tokens"]
