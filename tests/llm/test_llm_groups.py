"""Near duplicates, components and benchmark passages against plain versions."""

import random

import numpy as np
import pytest
from brute import groups, passages

from heliodrift.llm import decontamination, minhash
from heliodrift.llm.components import components
from heliodrift.llm.words import row_shingles, word_hashes

DOCS = "doc_id long, text string, id string, mark string, bucket int, component int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in rows], DOCS)


def corpus(seed=3):
    """Bases with copies of all degrees, common passages, short, empty and repeated rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    shared = " ".join(rng.choices(vocabulary, k=25))
    rows = []
    for _ in range(8):
        base = rng.choices(vocabulary, k=rng.choice((4, 7, 30, 90)))
        for changes in (0, 0, 1, 1, 2, 3, 5, 9):
            copy = list(base)
            for _ in range(changes):
                place = rng.randrange(len(copy))
                rng.choice((lambda: copy.insert(place, rng.choice(vocabulary)), lambda: copy.__setitem__(place, "new")))()
            rows.append((len(rows) + 10, " ".join(copy).title() if changes == 1 else "\t".join(copy)))
    rows += [(len(rows) + 10 + k, shared + f" tail{k} " * 30) for k in range(5)]
    rows += [(1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "ONE  two"), (6, rows[2][1]), (6, rows[2][1]), (None, rows[2][1])]
    return rows


def test_shingle_hashes_tell_texts_apart():
    texts = ["a b c d e f", "A  B\tc d e f", "b c d e f", "a b", "a b", "", "a b c d e", "É a", "é a"]
    sets = [set(x.tolist()) for x in row_shingles(*word_hashes([t.encode() for t in texts]))]
    assert sets[0] == sets[1] and sets[2] < sets[0] and len(sets[0]) == 2
    assert sets[3] != sets[4] and not sets[5] and sets[6] < sets[0] and sets[7] != sets[8]


@pytest.mark.parametrize("seed", [3, 4])
def test_groups_equal_brute_force(spark, seed):
    rows = corpus(seed)
    found = minhash.near_duplicates(frame(spark, rows)).drop("mark").collect()
    null_first = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, found), key=null_first) == sorted(groups(rows), key=null_first)


def test_short_texts_at_the_threshold_are_linked(spark):
    """Few shingles fill many bins each, so a sketch of the bins would lose 2 % of these pairs."""
    rows = []
    for k in range(300):
        text = [f"v{k}x{n}" for n in range(8)]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(text[:7]))]
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert [i for i, _ in rows if found[i] != i - i % 2] == []


def test_one_row_of_each_group_stays(spark):
    rows = corpus()
    left = minhash.without_duplicates(frame(spark, rows))
    assert left.columns == [c.split()[0] for c in DOCS.split(", ")]
    kept = {i for i, _, _, k in groups(rows) if k}
    assert sorted(r.doc_id or -1 for r in left.collect()) == sorted(i or -1 for i in kept)


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.without_duplicates(empty).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(frame(spark, corpus()), bench).count() == 0
    assert decontamination.clean_documents(empty, bench).count() == 0


def test_densified_bins_estimate_similarity():
    rng = np.random.default_rng(1)
    for size in (3, 40, 4000):
        common = rng.integers(0, 2**63, size, np.uint64)
        errors = []
        for _ in range(60):
            a, b = (np.unique(np.concatenate((common, rng.integers(0, 2**63, max(1, size // 3), np.uint64)))) for _ in "ab")
            rows = minhash.one_permutation([a << np.uint64(1), b << np.uint64(1)])
            errors.append((rows[0] == rows[1]).mean() - size / len(np.union1d(a, b)))
        assert abs(np.mean(errors)) < 0.05


def test_components_of_a_long_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (100, 139)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()))
    assert found == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}}


def test_passages_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(200)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice((5, 9, 20, 40))))) for k in range(12)]
    items += [(20, "the the the the the the the the"), (21, None), (22, ""), (23, items[0][1])]
    rows = []
    for k in range(60):
        text = rng.choices(vocabulary, k=rng.randrange(0, 80))
        passage = rng.choice(items[:13])[1].split()
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
            passage[rng.randrange(len(passage))] = "edited"
        passage = passage[rng.choice((0, 0, 1, 4)) :]
        place = rng.randrange(len(text) + 1)
        rows.append((k, " ".join(text[:place] + passage + text[place:]).upper()))
    rows += [(100, None), (101, ""), (102, items[1][1]), (102, items[1][1]), (None, items[2][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contaminated(frame(spark, rows), bench).drop("differing_bits")
    wanted = passages(rows, items)
    assert {tuple(r) for r in found.collect()} == wanted
    dirty = {d for d, *_ in wanted}
    clean = decontamination.clean_documents(frame(spark, rows), bench)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _ in rows if i not in dirty)


def test_short_items_are_found_by_their_words(spark):
    bench = spark.createDataFrame([(1, "alpha beta"), (2, "beta alpha"), (3, "gamma")], "item_id long, text string")
    docs = frame(spark, [(1, "x ALPHA beta gamma"), (2, "alpha x beta"), (3, "alpha")])
    found = decontamination.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.first_word) for r in found} == {(1, 1, 1), (1, 3, 3)}


def test_distances_of_similar_bags_stay_within_the_radius():
    rng = np.random.default_rng(2)
    far = 0
    for _ in range(300):
        bag = rng.integers(0, 2**63, 40, np.uint64)
        other = bag.copy()
        other[:5] = rng.integers(0, 2**63, 5, np.uint64)
        a, b = (decontamination._blocks(decontamination._votes(x).sum(axis=0)[None]) for x in (bag, other))
        far += decontamination._COUNTS[a ^ b].sum() > decontamination.RADIUS
    assert far == 0
