"""Rank-order language profiles against their SQL; the factorization machine by held-out accuracy."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from siltstone.llm import langid, queries, toxicity

from ..conftest import SF
from .conftest import ROWS


def test_same_as_sql(same_as_sql):
    same_as_sql(queries.op9_language_id, queries.ORACLE_SQL["op9_language_id"])


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.identify(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["language"] == r["lang"] for r in found if r["language"]]) > 0.97
    assert np.mean([r["language"] is None for r in found]) < 0.05


@pytest.fixture(scope="module")
def profiles(spark):
    return langid.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_odd_languages(odd, profiles):
    got = langid.identify(odd, profiles).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    for i in (4, 5, 6, 11):
        assert by[i]["language"] is None and by[i]["distance"] == 1.0
    kept = langid.keep_identified(odd, profiles)
    assert kept.schema == odd.schema
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["language"])


def test_no_languages(odd, none):
    empty = langid.train(none)
    assert {r["language"] for r in langid.identify(odd, empty).collect()} == {None}
    assert langid.identify(none, empty).collect() == [] and langid.keep_identified(odd, empty).collect() == []


def test_an_unknown_script_is_rejected(profiles):
    assert profiles.identify("東京都は日本の首都であり世界最大の都市のひとつである" * 5)[0] is None


def test_ties_take_the_first_name():
    code = np.array([1, 2, 3])
    assert langid.Profiles({"b": code, "a": code}, 1.0).names == ["a", "b"]


def test_held_out_toxicity():
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pandas()
    labelled = docs.merge(pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pandas(), on="doc_id")
    held = np.arange(len(labelled)) % 4 == 0
    model = toxicity.fit(pa.array(labelled.text[~held]), labelled.toxic[~held].to_numpy() > 0)
    _, found = model.apply(pa.array(labelled.text[held]))
    want = labelled.toxic[held].to_numpy() > 0
    assert (found == want).mean() > 0.9 and (found & want).sum() >= 0.7 * want.sum()


def test_pairs_matter():
    """Two terms are toxic together and harmless alone: no additive weights can say so."""
    rng = np.random.default_rng(0)
    texts, y = [], []
    for i in range(1200):
        filler = " ".join(f"w{rng.integers(40)}" for _ in range(6))
        insult, group = bool(i & 1), bool(i & 2)
        texts.append(f"{filler} {'dreadful' if insult else 'pleasant'} {'strangers' if group else 'weather'}")
        y.append(insult != group)  # exclusive or
    y = np.array(y)
    toxicity_terms, chi = toxicity.CHI2, toxicity.LEAST
    assert chi <= 4 and toxicity_terms > 0
    y2 = np.array([bool(i & 1) and bool(i & 2) for i in range(1200)])
    model = toxicity.fit(pa.array(texts), y2)
    p, _ = model.apply(pa.array(["w1 dreadful strangers", "w1 dreadful weather", "w1 pleasant strangers", "w1 pleasant weather"]))
    assert p[0] > 0.5 > max(p[1:])
    row, term, value, _ = toxicity.hashed_terms(pa.array(["dreadful strangers"]), model.used)
    at = model.place[term]
    v = model.factors[at] * value[:, None]
    pair = 0.5 * ((v.sum(0) ** 2) - (v**2).sum(0)).sum()
    linear = model.bias + (model.linear[at] * value).sum()
    assert p.shape == (4,) and 1 / (1 + np.exp(-(linear + pair))) == pytest.approx(model.apply(pa.array(["dreadful strangers"]))[0][0], rel=1e-4)


def test_odd_toxicity(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(ROWS)
    assert not any(r["is_toxic"] for r in got if r["doc_id"] in (4, 5, 6, 11))
    left = toxicity.drop_toxic(odd, model)
    assert left.schema == odd.schema and left.count() == sum(not r["is_toxic"] for r in got)
    assert toxicity.score(none, model).collect() == [] and toxicity.drop_toxic(none, model).collect() == []
    unlabelled = toxicity.train(docs, labels.where("false"))
    assert not any(r["is_toxic"] for r in toxicity.score(odd, unlabelled).collect())
    empty = toxicity.train(none, labels)
    assert not any(r["is_toxic"] for r in toxicity.score(odd, empty).collect())


def exclusive():
    """Texts that are toxic by exclusive or of two words, each of which says nothing alone."""
    rng = np.random.default_rng(0)
    texts = [f"{' '.join(f'w{rng.integers(40)}' for _ in range(6))} {'dreadful' if i & 1 else 'pleasant'} {'strangers' if i & 2 else 'weather'}" for i in range(1200)]
    return texts, np.array([bool(i & 1) != bool(i & 2) for i in range(1200)])


def test_exclusive_or_is_learned():
    texts, y = exclusive()
    p, found = toxicity.fit(pa.array(texts), y).apply(pa.array(["w1 dreadful strangers", "w1 dreadful weather", "w1 pleasant strangers", "w1 pleasant weather"]))
    assert found.tolist() == [False, True, True, False] and (np.abs(p - 0.5) > 0.3).all()


def test_exclusive_or_is_learned_from_tables(spark):
    texts, y = exclusive()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(y)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert np.mean([r["is_toxic"] == y[r["doc_id"]] for r in rows]) > 0.95


def test_pairs_of_unrelated_words_take_no_part():
    """Nor does a word that is only often beside an insult."""
    rng = np.random.default_rng(2)
    toxic = rng.random(2000) < 0.2
    texts = [" ".join([*(f"w{i}" for i in rng.integers(0, 60, 12)), *(["awful"] if t else [])]) for t in toxic]
    row, term, _, _ = toxicity.hashed_terms(pa.array(texts))
    pairs = toxicity.Pairs(np.bincount(term, minlength=1 << toxicity.BITS).astype(float))
    pairs.add(row, term, toxic)
    assert len(pairs.terms) > 60 and not len(pairs.admitted())


def test_junk_is_rejected_and_clean_text_stays(spark, profiles):
    import random

    rng = random.Random(4)
    junk = ["".join(rng.choice(kind) if rng.random() > 0.15 else " " for _ in range(n)) for kind in ("abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz", "0123456789abcdef", "абвгдежзиклмнопрст") for n in (150, 600, 6000)]
    clean = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars >= 20").select("text").collect()]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(junk + clean)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in langid.keep_identified(docs, profiles).collect()) == list(range(len(junk), len(junk) + len(clean)))


def test_only_the_most_frequent_languages_have_profiles(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    docs = spark.createDataFrame([(i, "abc def", lang) for i, lang in enumerate(["a", "a", "b", "b", "c", None])], "doc_id long, text string, lang string")
    assert langid.train(docs).names == ["a", "b"]
