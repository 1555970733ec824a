"""The pipeline's near-dedup against brute force: five-word shingles, Jaccard similarity of 0.8 or more."""

import random
import re

import pytest

import corpus_pipeline
from gridlineage.llm import near_copies, simhash
from gridlineage.llm.common import cut, table

SF = "/root/testdata/sf0.001"


def plain_kept(texts):
    sets = {}
    for d, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {d: d for d in texts}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[a] > label[b] and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                    label[a], changed = label[b], True
    return set(label.values())


@pytest.mark.parametrize("block", [400, near_copies.BLOCK])
def test_near_copies_of_many_degrees(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    random.seed(7)
    texts = {}
    for k in range(12):
        words = [f"w{random.randrange(400)}" for _ in range(random.choice([3, 6, 30, 150]))]
        for n in range(6):
            edited = list(words)
            for _ in range(n * len(words) // 60):
                edited[random.randrange(len(words))] = f"e{random.randrange(9999)}"
            texts[10 * k + n] = " ".join(edited)
    rows = [*texts.items(), (None, texts[0])]
    got = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None) == sorted(plain_kept(texts))
    assert got.where("doc_id IS NULL").count() == 1


def test_pipeline_keeps_one_of_each_near_copy_group(spark):
    kept = cut(corpus_pipeline.quality(spark, table(spark, SF, "documents"), SF), "q")
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, kept, SF).collect()}
    assert got == plain_kept({r["doc_id"]: r["text"] for r in kept.collect()})


def test_near_copies_defined_cases(odd, none):
    kept = near_copies.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 0), (True, 1), (True, 3), (True, 6), (True, 7), (True, 8)]
    assert near_copies.one_of_each(none).count() == 0


@pytest.mark.parametrize("share", [0, 3])
def test_prefixes_meet_in_any_order(share):
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (1, 4, 5, 9, 10, 100, 199, 201, 3000, 12_900, 60_000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: -(-8 * n // 9)], rng.integers(0, 2**63, n - -(-8 * n // 9)).astype(np.uint64)]))
        common = a[:share]
        both = len(np.intersect1d(a, b))
        if 9 * both >= 4 * (len(a) + len(b)):
            assert len(np.intersect1d(*(near_copies.prefix(x, common, np.arange(1, len(common) + 1)) for x in (a, b))))
            assert near_copies.candidates(np.array([len(a), len(b)]), near_copies.unpacked([near_copies.sketch(a), near_copies.sketch(b)]))
            assert near_copies.true_links([a, b], common, np.arange(1, len(common) + 1)) == [(0, 1)]


def test_sketches_rule_out_what_shares_little():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (160, 290, 400, 3400, 13_000):
        sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for _ in range(60)]
        sizes, counts = np.array([len(x) for x in sets]), near_copies.unpacked([near_copies.sketch(x) for x in sets])
        # some pairs pass by chance, and are told apart by their exact overlaps
        assert sum(len(near_copies.candidates(sizes[k : k + 2], counts[k : k + 2])) for k in range(59)) <= 2


def test_texts_under_a_repeated_id_are_kept_or_dropped_each(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    for keep in (near_copies.one_of_each, simhash.one_of_each):
        got = keep(spark.createDataFrame([(1, a), (5, a), (5, b), (7, c), (7, c)], "doc_id long, text string"))
        assert sorted(map(tuple, got.collect())) == [(1, a), (5, b), (7, c), (7, c)]


def test_simhash_alone_finds_nine_of_ten(spark, monkeypatch):
    """The named method's share: fingerprints, one-wildcard variants, equality join and verification, without the exact index of the rest."""
    monkeypatch.setattr(near_copies, "candidates", lambda sizes, counts: [])
    random.seed(11)
    texts = {}
    for k in range(120):
        words = [f"w{random.randrange(3000)}" for _ in range(random.choice([60, 150, 400]))]
        edited = list(words)
        for _ in range(random.randint(1, max(1, len(words) // 55))):
            edited[random.randrange(len(words))] = f"e{random.randrange(9999)}"
        texts[2 * k], texts[2 * k + 1] = " ".join(words), " ".join(edited)
    want = set(texts) - plain_kept(texts)
    assert len(want) > 100
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame([*texts.items()], "doc_id long, text string"), SF).collect()}
    gone = set(texts) - kept
    assert gone <= want and len(gone) >= 0.9 * len(want)


@pytest.mark.parametrize("most", [1, 8, simhash.AT_ONCE])
def test_buckets_of_any_size_span_what_is_near(most):
    import numpy as np

    rng = np.random.default_rng(5)
    keys, sizes = np.array(sorted(zip(rng.integers(0, 12, 150).tolist(), rng.integers(1, 12, 150).tolist()))).T
    values = rng.integers(0, 80, 150)

    def near(i, j):
        return np.abs(values[i] - values[j]) <= 6

    def classes(links):
        label = list(range(len(keys)))
        for a, b in links:
            label = [label[a] if x == label[b] else x for x in label]
        return {frozenset(k for k, x in enumerate(label) if x == y) for y in label}

    brute = [(i, j) for i in range(len(keys)) for j in range(i) if keys[i] == keys[j] and abs(values[i] - values[j]) <= 6 and near_copies.sizes_fit(sizes[i], sizes[j])]
    assert 20 < len(brute)
    links = simhash.bucket_links(keys, sizes, near, most)
    assert classes(links) == classes(brute) and len(links) < len(keys)


def test_wide_links_need_a_segment_a_size_and_a_radius(spark):
    rows = [
        (1, 40, 0, 0),
        (2, 40, 0x0003000300030001, 7),  # 10 bits from 1, the last segments equal
        (3, 50, 0x0003000300030007, -1 << 40),  # 33 bits from 1, 29 from 2
        (4, 51, 0, 0),  # too large for 1 and 2, 33 bits from 3
        (5, 40, -1, -1),
        (6, 40, 0x0300030003000300, 0x0300030003000300),  # 16 bits from 1, two in each segment
        (7, 40, -1, 2**63 - 1),  # one bit from 5, the sign
    ]
    prints = spark.createDataFrame(rows, "print long, size long, w0 long, w1 long")
    links = simhash.wide_links(prints)
    assert {(r["node"], r["root"]) for r in near_copies.components(links).collect()} == {(2, 1), (3, 1), (7, 5)}
