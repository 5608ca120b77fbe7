"""The corpus pipeline stage by stage against plain Python versions."""

from collections import Counter

import pytest

import corpus_pipeline
from kestrel.llm import bag_minhash, mixing, packing, secret_ledger

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The input of the first stage and the output of every stage, each reread."""
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(str(base / name))
        out.append(spark.read.parquet(str(base / name)))
    return out


def test_stages_and_columns(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "secrets", "mix", "pack"]
    assert all(sorted(d.columns) == sorted(kept[0].columns) for d in kept[:-1])


def test_only_texts_without_language_go(kept):
    before = {r.doc_id: r.text or "" for r in kept[0].collect()}
    after = {r.doc_id for r in kept[1].collect()}
    assert after == {i for i, t in before.items() if any(c.isalpha() for c in t)}


def test_one_of_each_class_stays(kept):
    classes = {r.doc_id: r.class_id for r in bag_minhash.digest(kept[1]).collect()}
    assert sorted(r.doc_id for r in kept[2].collect()) == sorted(set(classes.values()))


def test_secrets_are_gone_and_the_rest_is_kept(kept):
    found = {r.doc_id: r.spans for r in secret_ledger.digest(kept[2]).collect()}
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in kept[2:4])
    assert set(before) == set(after)
    for i, text in before.items():
        assert (after[i] == text) == (found[i] == "")
    assert all(r.spans == "" for r in secret_ledger.digest(kept[3]).collect())


def test_mix_repeats_documents(kept):
    want = {r.doc_id: r.taken // r.size for r in mixing.digest(kept[3]).collect() if r.size and r.taken}
    assert Counter(r.doc_id for r in kept[4].collect()) == Counter(want)


def test_all_tokens_are_packed(kept):
    encode = packing.encoder()
    want = sum(len(encode(r.text or "")) + 1 for r in kept[4].collect())
    rows = kept[5].collect()
    assert sum(r.length for r in rows) == want
    by = Counter()
    for r in rows:
        by[r.sequence_id] += r.length
    assert max(by.values()) <= 1024 and len(by) <= -(-want // 1024) * 1.02 + 2


def test_run_gives_the_last_stage(spark, kept):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == kept[5].columns and got.count() == kept[5].count()


def test_empty_documents(spark, kept):
    docs = kept[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
