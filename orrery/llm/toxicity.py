"""Operator 5: toxicity by a bidirectional GRU with attention pooling, in numpy.

A word enters as its hashed embedding next to the mean of its hashed character
3- and 4-gram embeddings. Two GRUs read a window of ``WINDOW`` words in both
directions; attention weights pool their states into one logit. A document is
scored on all its windows, which start every ``STRIDE`` words and so overlap
(the last one ends with the text), and keeps the greatest.

Labels are of documents while toxicity is local, so training is by multiple
instances: the first windows are picked by smoothed log-odds of their words and
character grams, later ones by the network itself; of positives that stay
unconvincing the lowest share, ``noise``, is left out of training. Training uses a
bounded sample (``per_class`` documents) in one task; the decision threshold is the one of
best F1 over *all* labelled documents. Scoring is one map without a shuffle; the
model broadcast has a fixed size.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import spread
from ._store import released, staged
from ._text import words

WINDOW, STRIDE = 32, 16
H, DW, DC = 12, 12, 12
WORD_ROWS, CHAR_ROWS = 1 << 15, 1 << 14
BLOCK = 2048
CACHE_WORDS = 120_000


def window_starts(n: int) -> np.ndarray:
    """Starts of the windows of a text of n > 0 words."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def word_inputs(ws: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word row of each, flat char rows, start of each word's char rows)."""
    text = "".join(f"<{w}>" for w in ws)
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in ws])
    starts = np.cumsum(size) - size
    k = np.uint64(0x9E3779B97F4A7C15)
    # whole word: a polynomial hash by prefix sums of products
    power = np.cumprod(np.full(int(size.max()), k, np.uint64))
    local = np.arange(len(c)) - np.repeat(starts, size)
    with np.errstate(over="ignore"):
        whole = np.add.reduceat((c + np.uint64(1)) * power[local], starts)
        whole = (whole ^ (whole >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        rows = (whole >> np.uint64(64 - 15)).astype(np.int64)
        pad = np.concatenate([c, np.zeros(3, np.uint64)])
        tri = ((pad[:-3] * k + pad[1:-2]) * k + pad[2:-1]) * k
        four = (tri + pad[3:]) * np.uint64(0x94D049BB133111EB)
        tri = (tri ^ (tri >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    left = np.repeat(size, size) - local
    grams = np.concatenate([tri[left >= 3], four[left >= 4]])
    owner = np.concatenate([np.repeat(np.arange(len(ws)), size)[left >= 3], np.repeat(np.arange(len(ws)), size)[left >= 4]])
    order = np.argsort(owner, kind="stable")
    flat = (grams[order] >> np.uint64(64 - 14)).astype(np.int64)
    return rows, flat, np.searchsorted(owner[order], np.arange(len(ws)))


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    return rows[first], np.add.reduceat(values[order], first, axis=0)


class Net:
    """Parameters, scores and gradients."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        u = lambda *s: (rng.standard_normal(s) * (1 / np.sqrt(s[0]))).astype(np.float32)
        self.p = {
            "ew": (rng.standard_normal((WORD_ROWS, DW)) * 0.1).astype(np.float32),
            "ec": (rng.standard_normal((CHAR_ROWS, DC)) * 0.1).astype(np.float32),
            "wx": u(DW + DC, 6 * H), "bx": np.zeros(6 * H, np.float32),
            "uf": u(H, 3 * H), "ub": u(H, 3 * H),
            "wa": u(2 * H, 2 * H), "ba": np.zeros(2 * H, np.float32), "va": u(2 * H, 1)[:, 0],
            "wo": u(2 * H, 1)[:, 0], "bo": np.full(1, -1.0, np.float32),
        }
        self.p["bx"][:H] = self.p["bx"][3 * H : 4 * H] = 1.0  # keep state at first

    def embed(self, rows: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        n = np.diff(np.append(starts, len(flat)))
        chars = np.add.reduceat(self.p["ec"][flat], starts, axis=0) / n[:, None]
        return np.concatenate([self.p["ew"][rows], chars], 1).astype(np.float32)

    def project(self, ws: list[str]) -> np.ndarray:
        """Gate inputs of words, both directions."""
        return self.embed(*word_inputs(ws)) @ self.p["wx"] + self.p["bx"]

    def logits(self, table: np.ndarray, at: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Of windows: ``at`` (WINDOW x n) indexes ``table``; mask is 0 beyond a short text."""
        t, n = at.shape
        states = np.empty((t, n, 2 * H), np.float32)
        buf, ru = np.empty((n, 3 * H), np.float32), np.empty((n, 3 * H), np.float32)
        for base, u, order in ((0, self.p["uf"], range(t)), (3 * H, self.p["ub"], range(t - 1, -1, -1))):
            side = np.ascontiguousarray(table[:, base : base + 3 * H])
            side[:, : 2 * H] *= 0.5  # sigmoid(x) = (1 + tanh(x / 2)) / 2
            u = u.copy()
            u[:, : 2 * H] *= 0.5
            h = np.zeros((n, H), np.float32)
            for s in order:
                np.take(side, at[s], axis=0, out=buf)
                np.matmul(h, u, out=ru)
                gates = buf[:, : 2 * H] + ru[:, : 2 * H]
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                c = ru[:, 2 * H :] * gates[:, H:]
                c += buf[:, 2 * H :]
                np.tanh(c, out=c)
                new = h - c
                new *= gates[:, :H]
                new += c
                h = new if mask is None else np.where(mask[s][:, None], new, h)
                states[s, :, base // 3 : base // 3 + H] = h
        flat = states.reshape(t * n, 2 * H)
        e = (np.tanh(flat @ self.p["wa"] + self.p["ba"]) @ self.p["va"]).reshape(t, n)
        if mask is not None:
            e = np.where(mask, e, -1e9)
        e -= e.max(0)
        np.exp(e, out=e)
        e /= e.sum(0)
        return np.einsum("tn,tn->n", e, (flat @ self.p["wo"]).reshape(t, n)) + self.p["bo"][0]

    def gradients(self, inputs, at: np.ndarray, mask: np.ndarray, y: np.ndarray, keep: np.ndarray) -> tuple[float, dict]:
        """Mean logistic loss and its gradients; ``keep`` blanks word embeddings of some words."""
        p, (rows, flat, starts) = self.p, inputs
        x = self.embed(rows, flat, starts)
        x[:, :DW] *= keep[:, None]
        table = x @ p["wx"] + p["bx"]
        t, n = at.shape
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("ew", "ec")}
        saved, states = {}, np.zeros((t, n, 2 * H), np.float32)
        sides = ((0, "uf", list(range(t))), (3 * H, "ub", list(range(t - 1, -1, -1))))
        for base, un, order in sides:
            h = np.zeros((n, H), np.float32)
            for s in order:
                v, r = table[at[s]][:, base : base + 3 * H], h @ p[un]
                z = 1 / (1 + np.exp(-(v[:, :H] + r[:, :H])))
                q = 1 / (1 + np.exp(-(v[:, H : 2 * H] + r[:, H : 2 * H])))
                c = np.tanh(v[:, 2 * H :] + q * r[:, 2 * H :])
                new = z * h + (1 - z) * c
                saved[base, s] = (h, z, q, c, r[:, 2 * H :])
                h = np.where(mask[s][:, None], new, h)
                states[s, :, base // 3 : base // 3 + H] = h
        a = np.tanh(states @ p["wa"] + p["ba"])
        e = np.where(mask, a @ p["va"], -1e9)
        e = np.exp(e - e.max(0))
        e /= e.sum(0)
        val = states @ p["wo"]
        out = (e * val).sum(0) + p["bo"][0]
        prob = 1 / (1 + np.exp(-out))
        loss = float(-np.mean(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)))
        d = (prob - y) / n
        g["bo"][0] = d.sum()
        g["wo"] = np.einsum("tn,tnh->h", e * d, states)
        ds = (e * d)[:, :, None] * p["wo"]
        de = e * (val - (e * val).sum(0)) * d
        g["va"] = np.einsum("tn,tnh->h", de, a)
        da = de[:, :, None] * p["va"] * (1 - a * a)
        g["wa"] = np.einsum("tnh,tnk->hk", states, da)
        g["ba"] = da.sum((0, 1))
        ds += da @ p["wa"].T
        dtab = np.zeros((t, n, 6 * H), np.float32)
        for base, un, order in sides:
            dh = np.zeros((n, H), np.float32)
            for s in reversed(order):
                h, z, q, c, rn = saved[base, s]
                dh = dh + ds[s, :, base // 3 : base // 3 + H]
                dn = np.where(mask[s][:, None], dh, 0)
                dc = dn * (1 - z) * (1 - c * c)
                dz = dn * (h - c) * z * (1 - z)
                dq = dc * rn * q * (1 - q)
                dr = np.concatenate([dz, dq, dc * q], 1)
                g[un] += h.T @ dr
                dtab[s, :, base : base + 2 * H] = dr[:, : 2 * H]
                dtab[s, :, base + 2 * H : base + 3 * H] = dc
                dh = dh - dn + dn * z + dr @ p[un].T
        used, total = _summed(at.ravel(), dtab.reshape(t * n, 6 * H))
        dtable = np.zeros_like(table)
        dtable[used] = total
        g["wx"], g["bx"] = x.T @ dtable, dtable.sum(0)
        dx = dtable @ p["wx"].T
        size = np.diff(np.append(starts, len(flat)))
        g["ew"] = (rows, dx[:, :DW] * keep[:, None])
        g["ec"] = (flat, np.repeat(dx[:, DW:] / size[:, None], size, axis=0))
        return loss, g


class Adam:
    def __init__(self, net: Net, rate: float) -> None:
        self.net, self.rate, self.n = net, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.p.items()}

    def step(self, g: dict) -> None:
        self.n += 1
        c1, c2 = 1 - 0.9**self.n, 1 - 0.999**self.n
        for k, p in self.net.p.items():
            own, at = g[k], slice(None)
            if isinstance(own, tuple):
                at, own = _summed(*own)
            own = np.clip(own, -1, 1)
            self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * own
            self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * own * own
            p[at] -= self.rate * (self.m[k][at] / c1) / (np.sqrt(self.v[k][at] / c2) + 1e-7)


def _windows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(WINDOW x n ids, WINDOW x n mask) of the windows of one text."""
    starts = window_starts(len(ids))
    at = starts[None, :] + np.arange(WINDOW)[:, None]
    mask = at < len(ids)
    return np.where(mask, ids[np.minimum(at, len(ids) - 1)], 0), mask


class Scorer:
    """Scores texts in blocks of windows; gate inputs of words are cached."""

    def __init__(self, net: Net) -> None:
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.table = np.zeros((1024, 6 * H), np.float32)

    def lookup(self, ws: list[str]) -> np.ndarray:
        get = self.ids.get
        at = [get(w, -1) for w in ws]
        if -1 in at:
            new = list(dict.fromkeys(w for w, i in zip(ws, at) if i < 0))
            n = len(self.ids)
            if n + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(len(self.table), len(new)), 6 * H), np.float32)])
            for k in range(0, len(new), 20_000):
                part = new[k : k + 20_000]
                self.table[n + k : n + k + len(part)] = self.net.project(part)
            self.ids.update(zip(new, range(n, n + len(new))))
            at = [self.ids[w] for w in ws]
        return np.array(at, np.int64)

    def scores(self, texts) -> list[np.ndarray]:
        """Probabilities of all windows of each text; none for a text without words."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(texts)
        k = 0
        while k < len(texts):
            if len(self.ids) > CACHE_WORDS:
                self.forget()
            held, total = [], 0
            while k < len(texts) and total < 100_000:
                ws = words(texts[k])
                if ws:
                    held.append((k, ws))
                    total += len(ws)
                k += 1
            if not held:
                continue
            flat = self.lookup([w for _, ws in held for w in ws])
            end = 0
            full, short = [], []
            for i, ws in held:
                ids, end = flat[end : end + len(ws)], end + len(ws)
                (full if len(ws) >= WINDOW else short).append((i, *_windows(ids)))
            for group, masked in ((full, False), (short, True)):
                if not group:
                    continue
                at = np.concatenate([g[1] for g in group], 1)
                mask = np.concatenate([g[2] for g in group], 1) if masked else None
                logit = np.concatenate([self.net.logits(self.table, at[:, b : b + BLOCK], mask[:, b : b + BLOCK] if masked else None) for b in range(0, at.shape[1], BLOCK)])
                prob, b = 1 / (1 + np.exp(-logit)), 0
                for i, w, _ in group:
                    out[i] = prob[b : b + w.shape[1]]
                    b += w.shape[1]
        return out


def train(texts: list[str], toxic: np.ndarray, rounds: int = 3, epochs: int = 4, rate: float = 0.01, seed: int = 5, noise: float = 0.12) -> Net | None:
    """A network from labelled texts; None without words of both classes."""
    docs = [words(t) for t in texts]
    keep = [i for i, d in enumerate(docs) if d]
    docs, y = [docs[i] for i in keep], np.asarray(toxic)[keep].astype(np.float32)
    if not len(y) or y.min() == y.max():
        return None
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for d in docs for w in d))}
    rows, flat, starts = word_inputs(list(vocabulary))
    size = np.diff(np.append(starts, len(flat)))
    ids = [np.array([vocabulary[w] for w in d], np.int64) for d in docs]
    wins = [_windows(i) for i in ids]
    # log-odds of the presence of words and character grams
    odds = np.zeros((2, len(vocabulary)), np.float32)
    for own, doc_rows in ((0, [np.unique(i) for i in ids]), (1, None)):
        if own == 0:
            pos = np.bincount(np.concatenate([d for d, t in zip(doc_rows, y) if t]), minlength=len(vocabulary))
            neg = np.bincount(np.concatenate([d for d, t in zip(doc_rows, y) if not t]), minlength=len(vocabulary))
            odds[0] = np.log((pos + 1) / (y.sum() + 2)) - np.log((neg + 1) / (len(y) - y.sum() + 2))
        else:
            gp, gn = np.zeros(CHAR_ROWS), np.zeros(CHAR_ROWS)
            for i, t in zip(ids, y):
                u = np.unique(i)
                grams = np.unique(np.concatenate([flat[starts[w] : starts[w] + size[w]] for w in u]))
                (gp if t else gn)[grams] += 1
            o = np.log((gp + 1) / (y.sum() + 2)) - np.log((gn + 1) / (len(y) - y.sum() + 2))
            odds[1] = np.add.reduceat(o[flat], starts) / size
    score = odds.sum(0)
    rank = [np.where(m, score[w], -9).max(0) for w, m in wins]
    rng, net = np.random.default_rng(seed), Net(seed)
    adam, hard = Adam(net, rate), set()
    for round_ in range(rounds):
        if round_:
            rank = Scorer(net).scores([" ".join(d) for d in docs])
        best = np.array([r.max() for r in rank])
        floor = np.quantile(best[y > 0], noise) if round_ else -np.inf
        pick = []
        for i, r in enumerate(rank):
            if y[i]:
                if best[i] >= floor:
                    pick.append((i, int(r.argmax()), 1.0))
            else:
                hard |= {(i, int(k)) for k in np.argsort(-r, kind="stable")[:3]}
                pick += [(i, int(k), 0.0) for k in rng.integers(0, len(r), 3)]
        pick += [(i, k, 0.0) for i, k in sorted(hard)]
        at = np.stack([wins[i][0][:, k] for i, k, _ in pick], 1)
        mask = np.stack([wins[i][1][:, k] for i, k, _ in pick], 1)
        label = np.array([v for _, _, v in pick], np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(label))
            for b in range(0, len(order), 128):
                own = order[b : b + 128]
                used, local = np.unique(at[:, own], return_inverse=True)
                n = size[used]
                ends = np.cumsum(n)
                sub = np.repeat(starts[used] - (ends - n), n) + np.arange(ends[-1])
                blank = (rng.random(len(used)) > 0.3).astype(np.float32)
                _, g = net.gradients((rows[used], flat[sub], ends - n), local.reshape(WINDOW, -1), mask[:, own], label[own], blank)
                adam.step(g)
    return net


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1000, seed: int = 5, noise: float = 0.12) -> Net | None:
    """A network from at most ``per_class`` documents of either label, of least id hash.

    It is trained in a task that gathers those documents; the driver gets the
    network only. Rows that repeat a doc_id are one, of the text that sorts first.
    ``noise`` is the share of the toxic documents in the sample that later rounds
    of training may take for wrongly labelled, those of least score; 0 keeps all.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    ranked = marked.distinct().withColumn("r", F.row_number().over(W.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")))
    chosen = ranked.where(F.col("r") <= per_class).select("doc_id", "toxic")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def trained(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text", "toxic"])
        net = train(pdf["text"].tolist(), pdf["toxic"].to_numpy(), seed=seed, noise=noise)
        return pd.DataFrame({"net": [pickle.dumps(net)]})

    got = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(trained, "net binary").collect()
    return pickle.loads(got[0][0]) if got else None


def score(docs: DataFrame, net: Net | None) -> DataFrame:
    """(doc_id, n_windows, score, worst_window) of every row; see ``detect``."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value) if shared.value is not None else None
        for pdf in batches:
            got = scorer.scores(pdf["text"].tolist()) if scorer else [np.zeros(0)] * len(pdf)
            best = [int(g.argmax()) if len(g) else None for g in got]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "n_windows": [len(g) for g in got],
                "score": [float(g[b]) if b is not None else 0.0 for g, b in zip(got, best)],
                "worst_window": pd.array(best, "Int32"),
            })
        released()

    rows = spread(docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text"))
    out = rows.mapInPandas(run, "doc_id string, n_windows int, score double, worst_window int")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def threshold(scored: DataFrame, labels: DataFrame) -> float:
    """The cut of best F1 over all labelled documents, by thousandths; 0.5 without positives."""
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").distinct()
    bins = scored.join(marked, "doc_id").groupBy(F.floor(F.col("score") * 1000).cast("int").alias("b"), "toxic").count().collect()
    table = np.zeros((1001, 2))
    for b, t, n in bins:
        table[min(b, 1000), t] += n
    tail = table[::-1].cumsum(0)[::-1]
    if not tail[0, 1]:
        return 0.5
    f1 = 2 * tail[:, 1] / (tail.sum(1) + tail[0, 1])
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(best[len(best) // 2] / 1000)


def detect(docs: DataFrame, labels: DataFrame, per_class: int = 1000, noise: float = 0.12) -> DataFrame:
    """(doc_id, n_windows, score, worst_window, toxic) of every row of ``docs``.

    ``score`` is the greatest probability of a window, ``worst_window`` its number.
    NULL, empty and wordless texts have no window, score 0 and are not toxic;
    repeated rows are scored each; NULL ids are kept; texts shorter than a window
    are one. Ties go to the first window. Without labels of both kinds there is
    no network: all scores are 0 and nothing is toxic. ``per_class`` and ``noise`` are
    those of ``fit``.
    """
    net = fit(docs, labels, per_class, noise=noise)
    scored = staged(score(docs, net), "toxicity")
    cut = threshold(scored, labels) if net is not None else 2.0
    return scored.withColumn("toxic", F.col("score") >= F.lit(cut))
