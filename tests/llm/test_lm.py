"""The self-attention model: gradients, masks, windows, and scores against one token at a time."""

import numpy as np
import pytest

from siltstone.llm import lm_scoring as lm
from siltstone.llm import queries

from ..conftest import SF
from .conftest import ROWS


@pytest.fixture(scope="module")
def v():
    rng = np.random.default_rng(0)
    return lm.Vocabulary((rng.pareto(1.0, 400) * 20).astype(np.int64), classes=16, inputs=50)


def test_classes_are_a_distribution(v):
    assert np.logaddexp.reduce(v.within + np.log(np.bincount(v.cls, np.exp(v.unigram), v.classes))[v.cls]) == pytest.approx(0, abs=1e-4)
    assert np.bincount(v.cls, minlength=v.classes).min() > 0


def test_gradient(v):
    rng = np.random.default_rng(1)
    flat = lm.initial(v) + rng.standard_normal(len(lm.initial(v))).astype(np.float32) * 0.05
    x, y = rng.integers(0, v.inputs, (3, lm.CONTEXT)), rng.integers(0, v.classes, (3, lm.CONTEXT))
    on = rng.random((3, lm.CONTEXT)) < 0.7
    _, g = lm.gradient(lm.unpack(flat, v), x, y, on)
    grad = np.concatenate([g[n].reshape(-1) for n in lm.layout(v)])
    for i in rng.choice(np.flatnonzero(np.abs(grad) > 1e-3), 25, replace=False):
        step = np.float32(1e-2)
        up, down = flat.copy(), flat.copy()
        up[i] += step
        down[i] -= step
        numeric = (lm.gradient(lm.unpack(up, v), x, y, on)[0] - lm.gradient(lm.unpack(down, v), x, y, on)[0]) / (2 * step)
        assert grad[i] == pytest.approx(numeric, rel=0.1, abs=5e-4)


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 112, 113, 500])
def test_windows_score_each_token_once(v, n):
    ids = np.arange(n) % 400
    x, y, first = lm.windows(ids, v)
    on = (y >= 0) & (np.arange(lm.CONTEXT) >= first[:, None])
    at = (np.arange(len(x))[:, None] * lm.STRIDE + np.arange(lm.CONTEXT))[on]
    assert sorted(at.tolist()) == list(range(n))
    assert all(c >= lm.CONTEXT - lm.STRIDE or w == 0 for w, c in zip(*np.nonzero(on)))


def slow(flat, v, ids):
    """Log-probability of a document, attention computed for one position at a time without a mask."""
    p = lm.unpack(flat.astype(np.float64), v)
    x, y, first = lm.windows(ids, v)
    total = 0.0
    for w in range(len(x)):
        h0 = p["emb"][x[w]] + p["pos"]
        for i in range(lm.CONTEXT):
            if y[w, i] < 0 or i < first[w]:
                continue
            q = h0[i] @ p["q"]
            a = np.exp((h0[: i + 1] @ p["k"]) @ q / np.sqrt(lm.WIDTH))
            h = h0[i] + (a / a.sum()) @ (h0[: i + 1] @ p["v"]) @ p["o"]
            z = h @ p["out"] + p["bias"]
            c = v.cls[y[w, i]]
            total += z[c] - np.log(np.exp(z).sum()) + v.within[y[w, i]]
    return total


def test_scores_are_those_of_a_loop(v):
    rng = np.random.default_rng(5)
    flat = lm.initial(v) + rng.standard_normal(len(lm.initial(v))).astype(np.float32) * 0.1
    scorer = lm.Scorer(flat, v)
    for n in (1, 70, 200):
        ids = rng.integers(0, 400, n).astype(np.uint16)
        got, _ = scorer.logprobs(*lm.windows(ids, v))
        assert len(got) == n and got.sum() == pytest.approx(slow(flat, v, ids), rel=1e-4)


def test_training_beats_the_unigram_model(v):
    rng = np.random.default_rng(3)
    model = lm.Adam(lm.initial(v), v)
    ids = np.tile(np.arange(40), 30)  # each token follows from the one before
    x, y, first = lm.windows(ids, v)
    losses = []
    for _ in range(60):
        pick = rng.integers(0, len(x), 16)
        losses.append(model.step(x[pick], np.where(y[pick] >= 0, v.cls[y[pick]], 0), y[pick] >= 0))
    assert losses[-1] < 0.6 * losses[0]


def test_query(spark):
    rows = queries.op1_lm_scoring(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    enc = lm.tokenizer()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["n_tokens"] == len(enc.encode_ordinary(docs[r["doc_id"]])) and r["logprob"] < 0
        assert r["perplexity"] == pytest.approx(np.exp(-r["logprob"] / r["n_tokens"]))


def test_query_is_a_loop_over_its_model(spark, monkeypatch):
    kept = []
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda *args: kept.append(train(*args)) or kept[-1])
    rows = queries.op1_lm_scoring(spark, SF).collect()
    (v, flat), enc = kept[0], lm.tokenizer()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    compared = 0
    for r in rows:
        if r["n_tokens"] <= 300:
            compared += 1
            assert r["logprob"] == pytest.approx(slow(flat, v, enc.encode_to_numpy(docs[r["doc_id"]]).astype(np.uint16)), rel=1e-3)
    assert compared > 20


def test_better_than_the_unigram_model(spark):
    sf, enc = "/root/testdata/sf0.01", lm.tokenizer()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op1_lm_scoring(spark, sf).collect()
    counts = np.zeros(enc.n_vocab, np.int64)
    for t in docs.values():
        counts += np.bincount(enc.encode_ordinary(t), minlength=enc.n_vocab)
    unigram = (counts[counts > 0] * np.log(counts[counts > 0] / counts.sum())).sum()
    assert sum(r["logprob"] for r in rows) > 0.95 * unigram  # of the same counts


def test_odd_documents(odd, none):
    assert lm.score(none).collect() == []
    rows = lm.score(odd).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows}
    for i in (4, 5):
        assert (by[i]["n_tokens"], by[i]["logprob"], by[i]["perplexity"]) == (0, 0.0, None)
    assert by[1]["logprob"] == pytest.approx(by[2]["logprob"]) and by[7]["logprob"] == pytest.approx(by[8]["logprob"])
    assert by[9]["n_tokens"] == 1 and by[9]["logprob"] < 0


def test_every_token_trains_once(v, monkeypatch):
    """Also those of documents of one window, and of documents of many: no step takes more than a batch."""
    import pyarrow as pa
    from pyspark import TaskContext

    trained, sizes = [], []

    def step(self, x, y, on):
        sizes.append(len(x))
        trained.extend(y[on].tolist())
        self.t += 1

    monkeypatch.setattr(lm.Adam, "step", step)
    monkeypatch.setattr(TaskContext, "get", lambda: type("T", (), {"partitionId": lambda _: 0})())
    rng = np.random.default_rng(7)
    docs = [rng.integers(0, 400, n).astype(np.uint16) for n in (0, 1, 5, 63, 64, 65, 113, 400, 4000, *range(20, 40))]
    batch = pa.RecordBatch.from_arrays([pa.array([d.tobytes() for d in docs], pa.binary())], names=["ids"])
    shared = type("S", (), {"value": (v, lm.initial(v))})
    for turn in range(lm.ROUNDS):
        assert list(lm._train(shared, turn)([batch]))
    assert sorted(trained) == sorted(v.cls[np.concatenate(docs)].tolist())
    assert max(sizes) <= lm.BATCH


def plain(p, x, y, on):
    """The mean loss, from whole softmaxes in double precision."""
    p = {n: a.astype(np.float64) for n, a in p.items()}
    h0 = p["emb"][x] + p["pos"]
    a = (h0 @ p["q"]) @ (h0 @ p["k"]).transpose(0, 2, 1) / np.sqrt(lm.WIDTH) + np.triu(np.full((lm.CONTEXT, lm.CONTEXT), -np.inf), 1)
    a = np.exp(a - a.max(-1, keepdims=True))
    z = (h0 + (a / a.sum(-1, keepdims=True)) @ (h0 @ p["v"]) @ p["o"]) @ p["out"] + p["bias"]
    top = z.max(-1)
    z = np.log(np.exp(z - top[..., None]).sum(-1)) + top - np.take_along_axis(z, y[..., None], 2)[..., 0]
    return z[on].mean()


@pytest.mark.parametrize("n, first, stretch, bias", [(3, 0, 1, 0), (5, 16, 1, 0), (40, 16, 1, 0), (40, 16, 4, 0), (17, 0, 4, 90), (8, 16, 1, -90)])
def test_gradient_of_any_size(v, n, first, stretch, bias):
    """With and without context, in whole groups or not, and where exponentials overflow or vanish."""
    rng = np.random.default_rng(n)
    flat = (lm.initial(v) + rng.standard_normal(len(lm.initial(v))).astype(np.float32) * 0.1) * np.float32(stretch)
    p = {name: a.astype(np.float64) for name, a in lm.unpack(flat, v).items()}
    p["bias"][0] += bias
    x, y = rng.integers(0, v.inputs, (n, lm.CONTEXT)), rng.integers(1, v.classes, (n, lm.CONTEXT))
    on = (rng.random((n, lm.CONTEXT)) < 0.9) & (np.arange(lm.CONTEXT) >= first)
    loss, g = lm.gradient({name: a.astype(np.float32) for name, a in p.items()}, x, y, on)
    assert loss == pytest.approx(plain(p, x, y, on), rel=1e-3)
    _, exact = lm.gradient(p, x, y, on)
    for name in p:
        assert np.abs(g[name] - exact[name]).max() <= 1e-3 * np.abs(exact[name]).max()
        way = rng.standard_normal(p[name].shape) * 1e-6
        up, down = ({**p, name: p[name] + s * way} for s in (1, -1))
        assert (way * exact[name]).sum() == pytest.approx((plain(up, x, y, on) - plain(down, x, y, on)) / 2, rel=1e-3, abs=1e-12)


def test_scores_of_great_logits_are_those_of_a_loop(v):
    rng = np.random.default_rng(6)
    flat = lm.initial(v) * np.float32(4)
    lm.unpack(flat, v)["bias"][:] += rng.standard_normal(v.classes).astype(np.float32) * 60
    ids = rng.integers(0, 400, 700).astype(np.uint16)
    got, owner = lm.Scorer(flat, v).logprobs(*lm.windows(ids, v))
    assert len(got) == 700 and np.isfinite(got).all() and got.sum() == pytest.approx(slow(flat, v, ids), rel=1e-3)
    assert owner.tolist() == sorted(owner.tolist())


def test_openings_train_apart(v, monkeypatch):
    """So that the positions which are only context cost no attention: but for a copy's last step, none is mixed."""
    import pyarrow as pa
    from pyspark import TaskContext

    mixed = []

    def step(self, x, y, on):
        opens = on[:, 0]
        mixed.append(opens.any() and not opens.all())
        self.t += 1

    monkeypatch.setattr(lm.Adam, "step", step)
    monkeypatch.setattr(TaskContext, "get", lambda: type("T", (), {"partitionId": lambda _: 0})())
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, 400, n).astype(np.uint16).tobytes() for n in rng.integers(1, 1500, 200)]
    shared = type("S", (), {"value": (v, lm.initial(v))})
    assert list(lm._train(shared, 0)([pa.RecordBatch.from_arrays([pa.array(docs, pa.binary())], names=["ids"])]))
    assert len(mixed) > 30 and sum(mixed) <= 2


@pytest.mark.parametrize("text", ["x", " a  b\n\n c\t", "it's 12,5 \u00e9\u4e00\U0001f600 <|endoftext|>", "ab " * 30000, " " * 70000 + "z"])
def test_packed_ids(text):
    assert np.frombuffer(lm.packed_ids(lm.tokenizer(), text), np.uint16).tolist() == lm.token_ids(lm.tokenizer(), text).tolist()
