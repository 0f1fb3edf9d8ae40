"""Conversation repair, exact duplicates and resampling against plain versions."""

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from heliodrift.llm import conversations, exact_dedup, resampling
from heliodrift.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
CONVERSATION = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """Uniform-cost search over edits: rows are (initial, must go, more if it stays)."""
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, last = heapq.heappop(heap)
        if (at, last) in done:
            continue
        done.add((at, last))
        if at == len(rows) and last in ("", "a"):
            return cost, audit
        ahead = []
        if at < len(rows):
            initial, gone, more = rows[at]
            ahead.append((4, "D", at + 1, last))
            if not gone:
                if (last, initial) in steps:
                    ahead.append((more, "K", at + 1, steps[last, initial]))
                ahead += [(3 + more, "R", at + 1, r) for r in "ua" if (last, r) in steps]
        ahead += [(3, "I", at, r) for r in "ua" if (last, r) in steps]
        for c, edit, *state in ahead:
            heapq.heappush(heap, (cost + c, audit + edit, *state))


def plain_repair(conv):
    """Counts, cost, audit and digest of rows (turn, role, text) in their order."""
    seen, facts, counts = set(), [], Counter()
    for _, role, text in conv:
        inner = re.sub(r"[\x20\x09-\x0d]", "", text)
        fault = "blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        facts.append((role[:1], fault in ("blank", "duplicate"), 3 * (fault == "truncated")))
    cost, audit = cheapest(facts)
    size = len(audit) - audit.count("D")
    lines, at = [], 0
    for edit in audit:
        role = ("user", "assistant")[(len(lines) - size % 2) % 2]
        if edit == "I":
            lines.append(f"{role}:")
            continue
        _, own, text = conv[at]
        at += 1
        if edit != "D":
            lines.append(f"{own if edit == 'K' else role}:{text}")
    turns = [t for t, _, _ in conv if t is not None]
    initials = [r[:1] for _, r, _ in conv]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest


def plain_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        kept = out[conv]
        if case == 1:
            text = ""
        if case == 2:
            text = re.sub("[.!?]", "", text)
        if case == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def by_key(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:] and str(r[1:])))


def test_a_span_of_rows_is_parsed_like_a_search_of_all_edits():
    rng = np.random.default_rng(5)
    spans = [rng.integers(0, 9, n).tolist() for n in range(13) for _ in range(40)]
    facts = [("s", 0), ("s", 3), ("u", 0), ("u", 3), ("a", 0), ("a", 3), ("x", 0), ("x", 3), ("u", None)]
    for kinds, cells in zip(spans, conversations.parse(spans), strict=True):
        rows = [(facts[k][0], facts[k][1] is None, facts[k][1] or 0) for k in kinds]
        assert conversations.whole(cells) == cheapest(rows)


def test_neighbouring_spans_combine_to_the_whole():
    rng = np.random.default_rng(6)
    for size in (13, 20, 24):
        kinds = rng.integers(0, 9, size).tolist()
        facts = [("s", 0), ("s", 3), ("u", 0), ("u", 3), ("a", 0), ("a", 3), ("x", 0), ("x", 3), ("u", None)]
        cut = int(rng.integers(size - 12, 13))
        left, right = conversations.parse([kinds[:cut], kinds[cut:]])
        rows = [(facts[k][0], facts[k][1] is None, facts[k][1] or 0) for k in kinds]
        assert conversations.whole(conversations.joined(left, right)) == cheapest(rows)


def test_an_audit_is_cut_where_spans_begin():
    # Rows K D | K D | K; insertions stay with the row before them.
    assert list(conversations.pieces("IKDKIIDK", 2)) == [("IKD", 0), ("KIID", 2), ("K", 5)]
    assert list(conversations.pieces("", 2)) == [("", 0)]
    assert list(conversations.pieces("II", 2)) == [("II", 0)]


def conversation_rows():
    rng = np.random.default_rng(3)
    words = ["Yes.", "No", "Why?", " ", "", "Yes.", "a\x0b", "Well! \t"]
    rows = []
    for conv in range(60):
        for turn in range(int(rng.integers(1, 9))):
            rows.append((conv, turn * int(rng.integers(1, 3)), str(rng.choice(["user", "assistant", "system", "tool", "ugly", ""])), str(rng.choice(words))))
    for conv, size in ((100, 13), (101, 40), (None, 90)):  # longer than a span
        for turn in range(size):
            rows.append((conv, turn, str(rng.choice(["user", "assistant", "system"])), f"{rng.choice(words)} {rng.integers(0, 20)}."))
    rows += [(200, None, None, None), (200, None, "user", "Hi."), (201, 5, None, "x" * 100_000), (202, -(2**63), "user", "a."), (202, 2**63 - 1, "assistant", "b.")]
    rows += rows[:30]  # repeated rows
    return rows + [(300 + k, 0, "user", "Gone?") for k in range(200)]  # some lose their only row


@pytest.mark.parametrize("fold", [2, 256])
def test_repair_equals_a_plain_version(spark, monkeypatch, fold):
    monkeypatch.setattr(conversations, "FOLD", fold)
    rows = conversation_rows()
    table = spark.createDataFrame([(*r, "other", 1) for r in rows], f"{CONVERSATION}, span string, spans int").repartition(5)
    damaged = conversations.damage(table)
    found = [tuple(r) for r in conversations.digests(conversations.repair(damaged, damaged["present"])).collect()]
    wanted = []
    for conv, kept in plain_damage(rows).items():
        gaps, *rest = plain_repair(kept)
        wanted.append((conv, gaps if gaps < 2**63 else None, *rest))
    assert by_key(found) == by_key(wanted)
    empty = hashlib.sha256(b"").hexdigest()
    assert any(r[1:] == (0, 0, 0, 0, 0, 0, "", empty) for r in found)


def test_repaired_turns_read_as_wanted(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    found = conversations.repair(conversations.damage(table).where("present")).collect()
    for row in found:
        assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in row["turns"]))
        assert "".join(t["edit"] for t in row["turns"]) == row["audit"].replace("D", "")


def test_repair_of_an_empty_table(spark):
    table = spark.createDataFrame([], CONVERSATION)
    damaged = conversations.damage(table)
    assert conversations.digests(conversations.repair(damaged, damaged["present"])).collect() == []


def test_repair_of_the_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    wanted = [(c, *plain_repair(kept)) for c, kept in plain_damage(rows).items()]
    assert by_key(map(tuple, QUERIES["op11_conversation_repair"](spark, SMALL).collect())) == by_key(wanted)


def plain_groups(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), key is None, key or 0, key))
    out = []
    for plain, members in groups.items():
        members.sort()
        for k, (size, _, _, key) in enumerate(members):
            out.append((key, members[0][3], len(members), k == 0, hashlib.sha256(plain.encode()).hexdigest(), -size))
    return out


def texts():
    long = "".join(chr(97 + k % 26) * 50 for k in range(1_000))
    rows = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r"), (7, "\x1f"), (8, " "), (9, "é"), (10, "é")]
    rows += [(20, long), (21, long[:-1]), (22, long + " "), (23, long[:4096]), (24, long[:4096] + "x"), (25, long[:8192]), (26, long[:12288])]
    rows += [(30 + k, "the same") for k in range(50)]
    return rows + [(30, "the same"), (None, "the same"), (None, "the same  "), (2, "ab")]


def rows_of(found):
    return sorted((tuple(r) for r in found), key=str)


def test_exact_groups_equal_a_plain_version(spark):
    table = spark.createDataFrame([(i, t, 7, "x") for i, t in texts()], "doc_id long, text string, row int, name string")
    found = exact_dedup.exact_groups(table.repartition(6)).collect()
    assert rows_of(found) == rows_of(plain_groups(texts()))


def test_digests_that_clash_are_replaced(spark):
    """Under the first seed the digests of all blocks are equal."""
    table = spark.createDataFrame(texts(), "doc_id long, text string")
    found = exact_dedup.exact_groups(table, digest=lambda block, seed: xxhash.xxh3_128_digest(block, seed) if seed else b"x")
    assert rows_of(found.collect()) == rows_of(plain_groups(texts()))


def test_names_do_not_depend_on_partitions(spark):
    table = spark.createDataFrame([(t or "",) for _, t in texts()], "text string")
    names = [sorted(map(tuple, exact_dedup.block_names(table.repartition(n)).collect())) for n in (1, 7)]
    assert names[0] == names[1]
    assert len({n for _, n, _ in names[0]}) == len(names[0])


def test_exact_groups_of_an_empty_table(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rows_without_copies_keep_their_columns(spark):
    table = spark.createDataFrame([(1, "a", 5), (2, "a ", 6), (3, "b", 7)], "doc_id long, text string, kept int")
    assert sorted(map(tuple, exact_dedup.without_copies(table).collect())) == [(2, "a ", 6), (3, "b", 7)]


WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text, sizes):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[k : k + n]) for n in range(1, sizes + 1) for k in range(len(words) - n + 1)]


def plain_resample(docs, target, sizes, buckets, percent, least):
    def bucket(x):
        return zlib.crc32(x.encode()) % buckets

    s = Counter(bucket(f) for _, x in docs for f in plain_features(x, sizes)[1])
    t = Counter(bucket(f) for x in target for f in plain_features(x, sizes)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    out = []
    for key, text in docs:
        words, found = plain_features(text, sizes)
        gain = sum(
            math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
            for b in map(bucket, found)
        )
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(found), gain, gain + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, row in enumerate(fit[: percent * len(fit) // 100], 1):
        row[4] = rank
    return out


def corpus():
    rng = np.random.default_rng(9)
    vocabulary = ["Sun", "moon", "é", "日本語", "x1", "Über", "a" * 40, "a" * 39 + "b", "b" * 300, "42"]
    docs = [(k, " -".join(rng.choice(vocabulary, int(rng.integers(0, 60))))) for k in range(120)]
    docs += [(200, None), (201, ""), (202, "..."), (203, "word " * 3_000), (204, "\x00q\x7fq"), (None, "sun " * 30), (5, docs[5][1]), (5, docs[5][1])]
    return docs, [" ".join(rng.choice(vocabulary[:3], 40)) for _ in range(5)] + [None, ""]


@pytest.mark.parametrize("sizes", [1, 3])
def test_resampling_equals_a_plain_version(spark, sizes):
    docs, target = corpus()
    table = spark.createDataFrame([(i, t, "x", 3) for i, t in docs], "doc_id long, text string, rank string, fall int").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    found = resampling.resample(table, wanted, sizes=sizes, buckets=50, percent=30)
    assert rows_of(found.collect()) == rows_of(map(tuple, plain_resample(docs, target, sizes, 50, 30, 20)))


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).collect() == []
    one = resampling.resample(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), none).collect()
    assert [(r.n_features, r["rank"]) for r in one] == [(2, None)]


def test_xxh64_and_equality_of_ranges():
    words = [b"a" * k + bytes([97 + k % 26]) for k in range(80)] * 2
    ends = np.cumsum([len(w) for w in words])
    ranges = resampling.Ranges(b"".join(words), ends - [len(w) for w in words], ends)
    assert ranges.hashes().tolist() == [xxhash.xxh64_intdigest(w) for w in words]
    left, right = (x.ravel() for x in np.meshgrid(np.arange(160), np.arange(160)))
    assert ranges.equal(left, right).tolist() == [words[a] == words[b] for a, b in zip(left, right, strict=True)]


def test_features_whose_keys_collide_are_told_apart_by_their_bytes():
    found = next(resampling.features([b"a b c a b d e f a"]))
    for hashes in (None, np.zeros(9, np.uint64), np.array([5, 5, 9, 5, 5, 9, 5, 9, 5], np.uint64)):
        table = resampling.intern(found.ranges, 100, hashes)
        names = [found.ranges[k] for k in range(9)]
        assert [found.ranges[table.first[p]] for p in table.places] == names
        assert [table.counts[p] for p in table.places] == [names.count(n) for n in names]
        assert [table.buckets[p] for p in table.places] == [zlib.crc32(n) % 100 for n in names]


def test_long_texts_are_cut_without_losing_features(monkeypatch):
    monkeypatch.setattr(resampling, "STEP_BYTES", 9)
    texts = ["One two three, four five six seven", "", "a b", "x" * 50 + " y " + "z" * 20]
    for sizes in (1, 2, 4):
        found, words = [], 0
        for part in resampling.features([t.encode() for t in texts], sizes):
            found += [(int(r), part.ranges[k].decode()) for k, r in enumerate(part.rows)]
            words = words + part.words
        assert sorted(found) == sorted((k, f) for k, t in enumerate(texts) for f in plain_features(t, sizes)[1])
        assert words.tolist() == [7, 0, 2, 3]


def test_resampling_of_the_given_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    wanted = [tuple(r[:5]) for r in plain_resample(docs, target, 1, 10_000, 10, 20)]
    assert rows_of(QUERIES["op13_target_resampling"](spark, SMALL).collect()) == rows_of(wanted)
