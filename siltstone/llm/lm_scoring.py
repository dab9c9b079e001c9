"""Language-model scores from a causal self-attention model trained in numpy.

The model reads the subword ids of a public byte-level vocabulary. Its output
is a distribution over classes of subwords times the subword's share of its
class; classes hold about equal parts of the corpus' subwords, frequent
subwords are classes of their own. Class shares come from the counts over all
documents.

Training is local stochastic gradient descent: every run of ``REPLICA`` tokens
trains a copy of the model on the windows of the round, the copies are averaged
by a tree of small groups, and the average starts the next round. A document is
cut into overlapping windows; each window is in one round. Training and scoring
take each token once, in the first window that gives it at least ``CONTEXT -
STRIDE`` tokens of context, or all there are.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import narrow
from .kernels import slices
from .scratch import Scratch, small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CONTEXT, STRIDE = 64, 48
WIDTH, CLASSES, INPUTS = 16, 128, 2048
#: Tokens that train one copy; every window of every document trains in one of the ``ROUNDS``, in batches of ``BATCH``.
REPLICA, ROUNDS, BATCH = 1 << 20, 2, 32
RATE = 0.02
#: Copies averaged in one group.
FAN_IN = 64
BLOCK = 4096


@cache
def tokenizer(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: White space as the pattern means it, in runs that are too long for its way back over them.
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{65536,}")


def token_ids(enc, text: str) -> np.ndarray:
    """The ids of a text of any kind.

    The pattern takes all of a run of white space but its last character, and
    that one too at the end of the text. It gives up on runs of a million; from
    65,536 on they are cut here in the same place, so the ids are the same.
    """
    parts, at = [], 0
    for m in _RUN.finditer(text) if len(text) >= 65536 else ():
        end = m.end() - (m.end() < len(text))
        if at < m.start():
            parts.append(enc.encode_to_numpy(text[at : m.start()]))
        parts.append(np.array(enc._encode_single_piece(text[m.start() : end]), np.uint32))
        at = end
    if at < len(text):
        parts.append(enc.encode_to_numpy(text[at:]))
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint32), *parts])


class Vocabulary:
    """Classes and input rows of subwords, from their counts over the corpus; a count of 0 is taken as 1."""

    def __init__(self, counts: np.ndarray, classes: int = CLASSES, inputs: int = INPUTS):
        n = np.maximum(counts, 1).astype(float)
        order = np.argsort(-n, kind="stable")
        share = n[order] / n.sum()
        # A new class starts as soon as the last one has its part of what is left.
        label, left, mass, k = np.empty(len(n), np.int64), 1.0, 0.0, 0
        for i, s in enumerate(share):
            label[i] = k
            mass += s
            if k < classes - 1 and mass >= left / (classes - k):
                left, mass, k = left - mass, 0.0, k + 1
        self.cls = np.empty(len(n), np.int32)
        self.cls[order] = label
        total = np.bincount(self.cls, n, classes)
        self.within = (np.log(n) - np.log(total[self.cls])).astype(np.float32)
        self.prior = np.log(np.maximum(total, 1e-9) / n.sum()).astype(np.float32)
        self.unigram = np.log(n / n.sum())
        # Frequent subwords have an input row each, others share that of their class; the last row begins a document.
        self.row = np.empty(len(n) + 1, np.int32)
        rank = np.empty(len(n), np.int64)
        rank[order] = np.arange(len(n))
        self.row[:-1] = np.where(rank < inputs, rank, inputs + self.cls)
        self.row[-1] = inputs + classes
        self.start = len(n)
        self.inputs, self.classes = inputs + classes + 1, classes


SHAPES = {"q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH), "pos": (CONTEXT, WIDTH)}


def layout(v: Vocabulary) -> dict[str, tuple[int, ...]]:
    return {"emb": (v.inputs, WIDTH), **SHAPES, "out": (WIDTH, v.classes), "bias": (v.classes,)}


def unpack(flat: np.ndarray, v: Vocabulary) -> dict[str, np.ndarray]:
    parts, at = {}, 0
    for name, shape in layout(v).items():
        size = int(np.prod(shape))
        parts[name] = flat[at : at + size].reshape(shape)
        at += size
    return parts


def initial(v: Vocabulary, seed: int = 1) -> np.ndarray:
    """Starts as the unigram model: small weights, class priors as the bias."""
    rng = np.random.default_rng(seed)
    size = sum(int(np.prod(s)) for s in layout(v).values())
    flat = (rng.standard_normal(size) * 0.1).astype(np.float32)
    p = unpack(flat, v)
    for name in "qkvo":
        p[name] *= 2.5
    p["out"] *= 0.1
    p["bias"][:] = v.prior
    return flat


_MASK = np.triu(np.full((CONTEXT, CONTEXT), -1e9, np.float32), 1)
_LOWER = np.tril(np.ones((CONTEXT, CONTEXT), np.float32))

#: Windows that are worked on at a time, small enough for a core's cache, and in one product with the classes: products of up to a million steps are the fastest.
CHUNK, GROUP = 32, 8


def _fits(sums: np.ndarray) -> bool:
    """Whether sums of exponentials neither overflowed nor vanished."""
    return bool(1e-15 < sums.min() and sums.max() < 1e15)


class _Attention:
    """Causal attention of the positions from ``lo`` on; the exponentials are taken as they are if their sums fit.

    One head is as wide as the model, so queries and keys meet in one square
    matrix (``qk``), and what is mixed are the inputs themselves.
    """

    def __init__(self, lo: int, size: int, dtype: np.dtype):
        self.lo, self.lower, self.wide = lo, _LOWER[lo:], np.ones(CONTEXT, dtype)
        self.buffer = np.empty((size, CONTEXT - lo, CONTEXT), dtype)

    def __call__(self, f0: np.ndarray, qk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(queries, inputs by column, weights before division by their sums, the sums' inverses)."""
        q, across = f0[:, self.lo :] @ qk, f0.transpose(0, 2, 1).copy()
        a = np.matmul(q, across, out=self.buffer[: len(f0)])
        np.exp(a, out=a)
        a *= self.lower
        s = a @ self.wide
        if not _fits(s):
            np.matmul(q, across, out=a)
            a += _MASK[self.lo :]
            a -= a.max(-1, keepdims=True)
            np.exp(a, out=a)
            s = a @ self.wide
        np.divide(1, s, out=s)
        return q, across, a, s


class _Output:
    """Exponentials of the classes' logits, a row a position; ``each`` is a factor that a class has besides."""

    def __init__(self, out: np.ndarray, bias: np.ndarray, most: int):
        self.out, self.bias, self.prior = np.ascontiguousarray(out), None, bias
        with np.errstate(over="ignore"):
            self.each = np.exp(bias)
        if not _fits(self.each):
            self.bias, self.prior, self.each = bias, np.zeros_like(bias), np.ones_like(bias)
        self.buffer = np.empty((most, len(bias)), out.dtype)

    def logits(self, h: np.ndarray) -> np.ndarray:
        z = self.buffer[: h.shape[0] * h.shape[1]]
        np.matmul(h, self.out, out=z.reshape(*h.shape[:2], -1))
        if self.bias is not None:
            z += self.bias
        return z

    def __call__(self, h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(exponentials, their sums over the classes with the factors, logits at the places ``target``) of positions in groups."""
        z = self.logits(h)
        mine = z.reshape(-1).take(target)
        np.exp(z, out=z)
        s = z @ self.each
        if not _fits(s):
            z = self.logits(h)
            z -= z.max(-1, keepdims=True)
            mine = z.reshape(-1).take(target)
            np.exp(z, out=z)
            s = z @ self.each
        return z, s, mine


def _grouped(h: np.ndarray, n: int) -> np.ndarray:
    """Positions of ``n`` windows in groups."""
    return h.reshape(n if n % GROUP else n // GROUP, -1, h.shape[-1])


def _gather(rows: np.ndarray, values: np.ndarray, out: np.ndarray) -> None:
    """Sums of ``values`` by their row of ``out``."""
    order = np.argsort(rows.astype(np.uint16) if len(out) <= 1 << 16 else rows, kind="stable")
    ordered = rows.take(order)
    start = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
    out[:] = 0
    out[ordered[start]] = np.add.reduceat(values.take(order, 0), start, axis=0)


@np.errstate(over="ignore", invalid="ignore")
def gradient(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, on: np.ndarray, into: dict[str, np.ndarray] | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the positions ``on`` of windows of input rows ``x`` and classes ``y``, and its gradient (written to ``into``)."""
    b, d, dtype = len(x), WIDTH, p["emb"].dtype
    g = into or {name: np.empty_like(part) for name, part in p.items()}
    share, scale = dtype.type(1 / max(1, np.count_nonzero(on))), dtype.type(1 / np.sqrt(d))
    lo = int(on.any(0).argmax())  # no position before it is scored
    r = CONTEXT - lo
    qk, vo = p["q"] @ p["k"].T * scale, p["v"] @ p["o"]
    qk_back, vo_back, short = qk.T.copy(), vo.T.copy(), np.ones(d, dtype)
    attention, output = _Attention(lo, CHUNK, dtype), _Output(p["out"], p["bias"], CHUNK * r)
    out_back, index = (output.out * output.each).T.copy(), np.arange(0, CHUNK * r * len(output.each), len(output.each))
    gqk, gvo, gout, gbias = np.zeros_like(qk), np.zeros_like(vo), np.zeros_like(output.out), np.zeros_like(output.each)
    df0, buffer = np.empty((b, CONTEXT, d), dtype), np.empty((CHUNK, r, CONTEXT), dtype)
    found = np.empty((b, r), dtype)
    for at in range(0, b, CHUNK):
        now = slice(at, at + CHUNK)
        f0 = p["emb"].take(x[now], 0)
        f0 += p["pos"]
        n = len(f0)
        q, across, a, s = attention(f0, qk)
        a *= s[..., None]
        mixed = (a @ f0).reshape(-1, d)
        h = mixed @ vo
        h.reshape(n, r, d)[:] += f0[:, lo:]
        h = _grouped(h, n)
        label = y[now, lo:].reshape(-1)
        target = index[: n * r] + label
        z, s, mine = output(h, target)
        found[now] = (mine + output.prior.take(label) - np.log(s)).reshape(n, r)
        z.reshape(-1)[target] = np.exp(mine) - s / output.each.take(label)
        np.divide(share, s, out=s)
        s *= on[now, lo:].reshape(-1)
        z *= s[:, None]
        gbias += np.ones(n * r, dtype) @ z
        z = _grouped(z, n)
        gout += (h.transpose(0, 2, 1) @ z).sum(0)
        dh = (z @ out_back).reshape(-1, d)
        gvo += mixed.T @ dh
        dm = dh @ vo_back
        mixed *= dm
        # The mean of a row of da under its row of a is the product of dm and what was mixed.
        mean = (mixed @ short).reshape(n, r, 1)
        dm = dm.reshape(n, r, d)
        da = np.matmul(dm, across, out=buffer[:n])
        da -= mean
        da *= a
        dq = (da @ f0).reshape(-1, d)
        gqk += f0[:, lo:].reshape(-1, d).T @ dq
        df = np.matmul(a.transpose(0, 2, 1), dm, out=df0[now])
        df += da.transpose(0, 2, 1) @ q
        dh += dq @ qk_back
        df[:, lo:] += dh.reshape(n, r, d)
    gqk *= scale
    np.matmul(gqk, p["k"], out=g["q"])
    np.matmul(gqk.T, p["q"], out=g["k"])
    np.matmul(gvo, p["o"].T, out=g["v"])
    np.matmul(p["v"].T, gvo, out=g["o"])
    np.multiply(gout, output.each, out=g["out"])
    np.multiply(gbias, output.each, out=g["bias"])
    df0.reshape(b, -1).sum(0, out=g["pos"].reshape(-1))
    _gather(x.reshape(-1), df0.reshape(-1, d), g["emb"])
    return -float(found[on[:, lo:]].sum() * share), g


class Adam:
    def __init__(self, flat: np.ndarray, v: Vocabulary, rate: float = RATE):
        self.flat, self.v, self.rate, self.t = flat, v, rate, 0
        # Ten times the mean of gradients and a hundred times that of their squares.
        self.m, self.s = np.zeros_like(flat), np.zeros_like(flat)
        self.grad, self.move = np.empty_like(flat), np.empty_like(flat)
        self.parts, self.into = unpack(flat, v), unpack(self.grad, v)

    def step(self, x: np.ndarray, y: np.ndarray, on: np.ndarray) -> float:
        loss, _ = gradient(self.parts, x, y, on, self.into)
        grad, move = self.grad, self.move
        self.t += 1
        self.m *= 0.9
        self.m += grad
        grad *= grad
        self.s *= 0.99
        self.s += grad
        unit = 10 * np.sqrt(1 - 0.99**self.t)
        np.sqrt(self.s, out=move)
        move += 1e-6 * unit
        np.divide(self.m, move, out=move)
        move *= self.rate * 0.1 * unit / (1 - 0.9**self.t)
        self.flat -= move
        return loss


def window_count(n: int) -> int:
    """The number of windows of a document of ``n`` tokens."""
    return 1 + max(0, -(-(n - CONTEXT) // STRIDE))


def windows(ids: np.ndarray, v: Vocabulary, pick: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, first position scored) of a document's windows, or of those picked; a target of -1 is past its end."""
    n = len(ids)
    count = window_count(n)
    size = (count - 1) * STRIDE + CONTEXT
    x = np.full(size, v.row[v.start], np.int32)
    x[1 : min(n, size)] = v.row[ids[: min(n, size) - 1]]
    y = np.full(size, -1, np.int32)
    y[:n] = ids
    pick = np.arange(count) if pick is None else pick
    at = pick[:, None] * STRIDE + np.arange(CONTEXT)
    return x.take(at), y.take(at), np.where(pick, CONTEXT - STRIDE, 0)


class Scorer:
    """Scores windows in batches, with the projections folded into one."""

    def __init__(self, flat: np.ndarray, v: Vocabulary):
        self.p, self.v = unpack(flat, v), v
        self.qk = self.p["q"] @ self.p["k"].T * np.float32(1 / np.sqrt(WIDTH))
        self.vo = self.p["v"] @ self.p["o"]
        self.output = _Output(self.p["out"], self.p["bias"], CHUNK * CONTEXT)
        self.within = v.within + self.output.prior[v.cls]
        self.attention, self.index = {}, np.arange(0, CHUNK * CONTEXT * v.classes, v.classes)

    @np.errstate(over="ignore", invalid="ignore")
    def logprobs(self, x: np.ndarray, y: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities of the scored targets, and their windows."""
        on = (y >= 0) & (np.arange(CONTEXT) >= first[:, None])
        lo, found = int(on.any(0).argmax()), np.empty(on.shape, np.float32)
        if lo not in self.attention:
            self.attention[lo] = _Attention(lo, CHUNK, np.dtype(np.float32))
        attention, r = self.attention[lo], CONTEXT - lo
        for at in range(0, len(x), CHUNK):
            now = slice(at, at + CHUNK)
            f0 = self.p["emb"].take(x[now], 0)
            f0 += self.p["pos"]
            n = len(f0)
            _, _, a, s = attention(f0, self.qk)
            mixed = a @ f0
            mixed *= s[..., None]
            h = mixed.reshape(-1, WIDTH) @ self.vo
            h.reshape(n, r, WIDTH)[:] += f0[:, lo:]
            target = self.index[: n * r] + self.v.cls.take(np.maximum(y[now, lo:], 0).reshape(-1))
            _, s, mine = self.output(_grouped(h, n), target)
            found[now, lo:] = (mine - np.log(s)).reshape(n, r)
        return found[on] + self.within[y[on]], np.nonzero(on)[0]


def packed_ids(enc, text: str) -> bytes:
    """The ids of a text in two bytes each."""
    return array("H", enc.encode_ordinary(text)).tobytes() if len(text) < 65536 else token_ids(enc, text).astype(np.uint16).tobytes()


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(path)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 21):
                data = [packed_ids(enc, t) if t else b"" for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "ids"])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for data in batch.column("ids"):
            total += np.bincount(np.frombuffer(data.as_buffer(), np.uint16), minlength=1 << 16)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["token", "n"])


def _concat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch's documents, and each one's offsets."""
    column = batch.column("ids")
    size = np.array([len(b.as_buffer()) // 2 for b in column], np.int64)
    return np.frombuffer(b"".join(b.as_buffer() for b in column), np.uint16), np.concatenate([[0], np.cumsum(size)])


def turn_windows(ids: np.ndarray, count: int, turn: int) -> np.ndarray:
    """Which of a document's ``count`` windows train in a round; each does in one.

    The document's content decides, so partitions don't matter.
    """
    mark = int(ids[: CONTEXT * 2].astype(np.int64).sum()) * 31 + len(ids) + turn
    return np.arange((-mark) % ROUNDS, count, ROUNDS)


def _train(shared, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, flat = shared.value
        part = TaskContext.get().partitionId()
        # Windows that begin a document wait apart: in the others' batches no context is scored.
        copy, tokens, number, held, waiting = Adam(flat.copy(), v), 0, 0, ([], []), [0, 0]

        def flush() -> pa.RecordBatch:
            nonlocal copy, tokens, number, held, waiting
            held, waiting = ([], held[1] + held[0]), [0, sum(waiting)]
            steps(1, 1)
            blocks = [copy.flat[i : i + BLOCK] for i in range(0, len(copy.flat), BLOCK)]
            out = pa.RecordBatch.from_arrays([pa.array([(part << 20) + number] * len(blocks), pa.int64()), pa.array(range(len(blocks)), pa.int32()), pa.array([float(copy.t)] * len(blocks)), pa.array([b.astype(np.float32).tobytes() for b in blocks], pa.binary())], names=["copy", "block", "weight", "data"])
            copy, tokens, number, held, waiting = Adam(flat.copy(), v), 0, number + 1, ([], []), [0, 0]
            return out

        def steps(kind: int, least: int) -> None:
            """Steps of ``BATCH`` windows; fewer than ``least`` are held."""
            if waiting[kind] < least:
                return
            x, y = (np.concatenate([w[k] for w in held[kind]]) for k in range(2))
            at = 0
            while len(x) - at >= least:
                now = y[at : at + BATCH]
                copy.step(x[at : at + BATCH], np.where(now >= 0, v.cls[now], 0), now >= 0)
                at += BATCH
            held[kind][:], waiting[kind] = [(x[at:], y[at:])] if at < len(x) else [], max(0, len(x) - at)

        for batch in batches:
            ids, offsets = _concat(batch)
            for i in range(batch.num_rows):
                mine = ids[offsets[i] : offsets[i + 1]]
                if not len(mine):
                    continue
                pick = turn_windows(mine, window_count(len(mine)), turn)
                for kind, some in enumerate((pick[pick == 0], pick[pick > 0])):
                    if len(some):
                        x, y, first = windows(mine, v, some)
                        y[:, : first[0]] = -1
                        held[kind].append((x, y))
                        waiting[kind] += len(some)
                        steps(kind, BATCH)
                tokens += len(mine)
                if tokens >= REPLICA:
                    yield flush()
        if tokens:
            yield flush()

    return run


def _average(table: pa.Table) -> pa.Table:
    weight = np.maximum(np.array(table.column("weight").to_pylist()), 1e-9)
    total = sum(w * np.frombuffer(b.as_buffer(), np.float32).astype(np.float64) for w, b in zip(weight, table.column("data").combine_chunks(), strict=True))
    return pa.table({"copy": [table.column("copy")[0].as_py()], "block": pa.array([table.column("block")[0].as_py()], pa.int32()), "weight": [float(weight.sum())], "data": pa.array([(total / weight.sum()).astype(np.float32).tobytes()], pa.binary())})


def _tree(copies: DataFrame, scratch: Scratch, name: str) -> np.ndarray | None:
    """The weighted average of all copies, in groups of about ``FAN_IN`` of a block at a time."""
    schema = copies.schema
    now = scratch.write(copies, f"{name}-0")
    level, count = 0, now.select("copy").distinct().count()
    while True:
        groups = -(-count // FAN_IN)
        level += 1
        now = scratch.write(now.groupBy("block", F.pmod(F.xxhash64("copy"), F.lit(groups))).applyInArrow(_average, schema), f"{name}-{level}")
        scratch.drop(f"{name}-{level - 1}")
        if groups <= 1:
            break
        count = groups
    rows = now.select("block", "data").orderBy("block").collect()  # one model: 200 KB
    return np.concatenate([np.frombuffer(r.data, np.float32) for r in rows]) if rows else None


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, flat = shared.value
        scorer = Scorer(flat, v)
        for batch in batches:
            ids, offsets = _concat(batch)
            total, doc, held = np.zeros(batch.num_rows), [], []

            def flush() -> None:
                x, y, first = (np.concatenate([w[k] for w in held]) for k in range(3))  # noqa: B023
                owner = np.concatenate(doc)  # noqa: B023
                order = np.argsort(first, kind="stable")  # those that begin a document are scored together
                x, y, first, owner = x[order], y[order], first[order], owner[order]
                for at in range(0, len(x), 64):
                    p, w = scorer.logprobs(x[at : at + 64], y[at : at + 64], first[at : at + 64])
                    total[:] += np.bincount(owner[at : at + 64][w], p, len(total))  # noqa: B023
                held.clear()  # noqa: B023
                doc.clear()  # noqa: B023

            waiting = 0
            for i in range(batch.num_rows):
                mine = ids[offsets[i] : offsets[i + 1]]
                if len(mine):
                    held.append(windows(mine, v))
                    doc.append(np.full(len(held[-1][0]), i))
                    waiting += len(held[-1][0])
                    if waiting >= 512:
                        flush()
                        waiting = 0
            if held:
                flush()
            size = np.diff(offsets)
            perplexity = np.exp(-total / np.maximum(size, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(total), pa.array(perplexity, mask=size == 0)], names=["doc_id", "n_tokens", "logprob", "perplexity"])

    return run


def train(tokens: DataFrame, scratch: Scratch, size: int) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary's classes and the model, from a table of ``ids``."""
    found = tokens.select("ids").mapInArrow(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()  # at most a row a subword
    counts = np.zeros(size, np.int64)
    counts[found["token"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    v = Vocabulary(counts)
    flat = initial(v)
    for turn in range(ROUNDS):
        shared = tokens.sparkSession.sparkContext.broadcast((v, flat))  # 1 MB, fixed by the vocabulary
        copies = tokens.select("ids").mapInArrow(_train(shared, turn), "copy long, block int, weight double, data binary")
        got = _tree(copies, scratch, f"round-{turn}")
        flat = flat if got is None else got
    return v, flat


def score(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens, logprob, perplexity)`` for each row of ``docs``, by a model of ``docs`` itself.

    ``logprob`` is the sum of the natural log-probabilities of all tokens. A
    null or empty text has no tokens, a logprob of 0 and a null perplexity. A
    null doc_id keeps its row, repeated rows have equal scores. No documents: no
    rows. Other columns aren't read, whatever their names. Texts of any length
    are scored whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "lm")
    tokens = scratch.write(narrow(docs, "doc_id", "text").mapInArrow(_encode(vocabulary), "doc_id long, ids binary"), "tokens")
    v, flat = train(tokens, scratch, tokenizer(vocabulary).n_vocab)
    shared = spark.sparkContext.broadcast((v, flat))
    return tokens.mapInArrow(_score(shared), "doc_id long, n_tokens long, logprob double, perplexity double")
