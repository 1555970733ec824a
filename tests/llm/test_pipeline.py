"""The pipeline's stages against brute force, each on the rows that the stage before it kept."""

from collections import Counter

import pytest

import corpus_pipeline
from gridlineage.llm import mixing, quality_model, secret_scan
from gridlineage.llm.common import cut, table
from tests.llm.test_near_copies import plain_kept

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = [table(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(cut(stage(spark, docs[-1], SF), name))
    return docs


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_stay(stages):
    assert all(d.columns == stages[0].columns for d in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secrets", "mix", "pack"]


def test_quality_rejects_what_the_model_rejects(spark, stages):
    verdict = quality_model.classify(stages[0], table(spark, SF, "labels"))
    assert set(rows(stages[1])) == {r["doc_id"] for r in verdict.collect() if r["kept"]}
    labels = {r["doc_id"]: r for r in table(spark, SF, "labels").collect()}
    kept = set(rows(stages[1]))
    good = [d for d, r in labels.items() if r["quality"] == 1]
    assert sum(d in kept for d in good) >= 0.95 * len(good)


def test_one_document_of_each_group_stays(stages):
    before, after = rows(stages[1]), rows(stages[2])
    assert set(after) == plain_kept({d: r["text"] for d, r in before.items()})
    assert all(after[d] == before[d] for d in after)


def test_secrets_are_masked_and_nothing_is_lost(stages):
    before, after = rows(stages[2]), rows(stages[3])
    assert set(before) == set(after)
    for d, r in before.items():
        found = secret_scan.spans(r["text"])
        assert after[d]["text"] == secret_scan.masked(r["text"])
        assert (after[d]["text"] == r["text"]) == (not found)
        for s, _, e in found:
            assert r["text"][s:e] not in after[d]["text"]
        assert after[d]["n_chars"] == len(after[d]["text"]) or after[d]["text"] == r["text"]


def test_mix_takes_what_it_says(stages):
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(stages[3]).collect()}
    words = Counter()
    times = Counter()
    for r in stages[4].collect():
        words[r["doc_id"]] += len(r["text"].encode().split())
        times[r["doc_id"]] += 1
    assert words == {d: n for d, n in taken.items() if n} and max(times.values()) <= 3


def test_every_token_is_packed(stages):
    from gridlineage.llm.tokens import encoder

    want = sum(len(encoder().encode(r["text"])) // 4 + 1 for r in stages[4].collect())
    got = stages[5].collect()
    assert sum(r["length"] for r in got) == want
    sizes = Counter()
    for r in got:
        sizes[r["sequence_id"]] += r["length"]
    assert max(sizes.values()) <= 4096 and len(sizes) <= -(-want // 4096) + 1


def test_run_is_the_stages_in_a_row(spark, stages):
    assert Counter(corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect()) == Counter(stages[5].drop("sequence_id", "offset").collect())
