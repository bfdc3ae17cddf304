"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time. Every byte position gets a label
distribution from the forward and the backward state; a document's probabilities are the mean over the
positions that belong to letters. Texts are read in whole: a text is cut into windows of ``WINDOW`` bytes at
whose ends the states start anew; the last window is moved back so that it is full, and positions that two
windows cover count once.

Training uses a bounded sample: at most about ``PER_LANG`` documents of each language are drawn by a hash of
their id and text, and ``CUTS`` windows of ``CUT`` characters of each, spread over the whole text. Every label is learned.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

HIDDEN, WINDOW, PER_LANG, CUTS, CUT, STEPS = 12, 128, 400, 2, 160, 260
PAD = 256
_LETTER = np.zeros(257, np.float32)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGRU:
    """Two gated recurrent layers (left to right, right to left) and a softmax over both states."""

    def __init__(self, labels: list[str], params: dict[str, np.ndarray]):
        self.labels, self.p = labels, params

    @staticmethod
    def fresh(labels: list[str], hidden: int = HIDDEN, seed: int = 7) -> ByteGRU:
        rng = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p[f"x{d}"] = (rng.standard_normal((257, 3 * hidden)) * 0.3).astype(np.float32)
            p[f"u{d}"] = (rng.standard_normal((hidden, 2 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            p[f"c{d}"] = (rng.standard_normal((hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)
        p["w"] = (rng.standard_normal((2 * hidden, len(labels))) / np.sqrt(hidden)).astype(np.float32)
        p["o"] = np.zeros(len(labels), np.float32)
        return ByteGRU(labels, p)

    def _pass(self, ids: np.ndarray, d: str, keep: bool):
        """States of one direction, time first; with ``keep`` also what backpropagation needs."""
        steps, n = ids.shape
        x, u, c = self.p[f"x{d}"], self.p[f"u{d}"], self.p[f"c{d}"]
        k = c.shape[0]
        live = (ids != PAD).astype(np.float32)[:, :, None]
        padded = not live.all()
        h = np.zeros((n, k), np.float32)
        states = np.empty((steps, n, k), np.float32)
        kept = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = x[ids[t]]
            zr = _sigmoid(g[:, : 2 * k] + h @ u)
            z, r = zr[:, :k], zr[:, k:]
            rh = r * h
            a = np.tanh(g[:, 2 * k :] + rh @ c)
            if keep:
                kept.append((t, h, z, r, rh, a))
            h = h + z * (a - h)
            if padded:
                h = h * live[t]
            states[t] = h
        return states, kept, live

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        """``ids``: windows by bytes. Label probabilities of every position: windows, bytes, labels."""
        t = np.ascontiguousarray(ids.T)
        both = np.concatenate([self._pass(t, "f", False)[0], self._pass(t, "b", False)[0]], axis=2)
        logits = both @ self.p["w"] + self.p["o"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits.transpose(1, 0, 2)

    def gradients(self, ids: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over letter positions and its gradient, by backpropagation through time."""
        p, t_ids = self.p, np.ascontiguousarray(ids.T)
        runs = {d: self._pass(t_ids, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        logits = both @ p["w"] + p["o"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        weight = _LETTER[t_ids]
        weight = weight / max(weight.sum(), 1)
        loss = float(-(np.log(prob[:, np.arange(len(y)), y] + 1e-9) * weight).sum())
        dl = prob
        dl[:, np.arange(len(y)), y] -= 1
        dl *= weight[:, :, None]
        flat = both.reshape(-1, both.shape[2])
        grad = {"w": flat.T @ dl.reshape(-1, dl.shape[2]), "o": dl.sum(axis=(0, 1))}
        dboth = dl @ p["w"].T
        k = p["cf"].shape[0]
        for i, d in enumerate("fb"):
            states, kept, live = runs[d]
            u, c = p[f"u{d}"], p[f"c{d}"]
            gx, gu, gc = np.zeros_like(p[f"x{d}"]), np.zeros_like(u), np.zeros_like(c)
            dh = np.zeros_like(states[0])
            for t, h, z, r, rh, a in reversed(kept):
                dh = (dh + dboth[t, :, i * k : (i + 1) * k]) * live[t]
                da = dh * z * (1 - a * a)
                drh = da @ c.T
                dzr = np.concatenate([dh * (a - h) * z * (1 - z), drh * h * r * (1 - r)], axis=1)
                gc += rh.T @ da
                gu += h.T @ dzr
                np.add.at(gx, t_ids[t], np.concatenate([dzr, da], axis=1))
                dh = dh * (1 - z) + drh * r + dzr @ u.T
            grad |= {f"x{d}": gx, f"u{d}": gu, f"c{d}": gc}
        return loss, grad


def fit(windows: list[tuple[bytes, str]], hidden: int = HIDDEN, steps: int = STEPS, batch: int = 192, seed: int = 7) -> ByteGRU:
    """Train by Adam on ``(bytes, label)``, languages drawn alike often."""
    labels = sorted({y for _, y in windows})
    model = ByteGRU.fresh(labels, hidden, seed)
    rng = np.random.default_rng(seed)
    by = {y: [b for b, z in windows if z == y] for y in labels}
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in model.p.items()}
    for step in range(1, steps + 1):
        y = rng.integers(len(labels), size=batch)
        span = 64
        ids = np.full((batch, span), PAD, np.int64)
        for i, j in enumerate(y):
            own = by[labels[j]]
            b = own[rng.integers(len(own))]
            at = rng.integers(max(1, len(b) - span + 1))
            cut = np.frombuffer(b[at : at + int(rng.integers(span // 3, span + 1))], np.uint8)
            ids[i, : len(cut)] = cut
        _, grad = model.gradients(ids, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.02 * min(1, (steps - step + 1) / (0.5 * steps)) * min(1, 1 / (norm + 1e-9))
        for k, g in grad.items():
            m[k] += 0.1 * (g - m[k])
            v2[k] += 0.01 * (g * g - v2[k])
            model.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def predict(model: ByteGRU, texts: list[bytes], window: int = WINDOW, rows: int = 1024) -> np.ndarray:
    """Pooled label probabilities of each text: texts by labels; zeros for a text without letter bytes.

    Windows run in blocks of about ``rows``, across texts and within them, so that memory doesn't grow with a text.
    """
    total = np.zeros((len(texts), len(model.labels)), np.float64)
    weight = np.zeros(len(texts), np.float64)

    def run(ids, fresh, owner):
        use = _LETTER[ids] * fresh
        pooled = (model.probabilities(ids) * use[:, :, None]).sum(axis=1)
        np.add.at(total, owner, pooled)
        np.add.at(weight, owner, use.sum(axis=1))

    full: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0
    short: list[tuple[int, bytes]] = []
    for i, b in enumerate(texts):
        n = len(b)
        if n < window:
            if n:
                short.append((i, b))
            continue
        data = np.frombuffer(b, np.uint8)
        for first in range(0, -(-n // window), rows):
            starts = np.arange(first, min(first + rows, -(-n // window))) * window
            moved = np.minimum(starts, n - window)
            at = moved[:, None] + np.arange(window)
            full.append((data[at], (at >= starts[:, None]).astype(np.float32), np.full(len(starts), i)))
            held += len(starts)
            if held >= rows:
                run(*(np.concatenate(x) for x in zip(*full)))
                full, held = [], 0
    if full:
        run(*(np.concatenate(x) for x in zip(*full)))
    short.sort(key=lambda x: len(x[1]))
    for lo in range(0, len(short), rows):
        part = short[lo : lo + rows]
        ids = np.full((len(part), len(part[-1][1])), PAD, np.int64)
        for j, (_, b) in enumerate(part):
            ids[j, : len(b)] = np.frombuffer(b, np.uint8)
        run(ids, np.float32(1), np.array([i for i, _ in part]))
    return total / np.maximum(weight, 1e-9)[:, None]


def train(docs: DataFrame, learn=None, per_lang: int = PER_LANG, cuts: int | None = CUTS) -> ByteGRU | None:
    """Fit on a bounded sample of ``docs(doc_id, text, lang)``; ``learn`` tells which rows may teach.

    ``cuts``: windows taken of each sampled text; None takes the whole text. Rows with a null language or without text don't
    teach; rows that repeat id and text teach once; a null ``doc_id`` is an id like any other. Labels and the sample come to
    the driver, the sample some ``per_lang`` documents a label. None if there is nothing to learn.
    """
    docs = C.spread(docs, "doc_id", "text", "lang").where("lang is not null and text is not null and length(text) > 0")
    docs = docs.where(learn) if learn is not None else docs
    counts = docs.groupBy("lang").count().collect()
    if not counts:
        return None
    # one pass picks each language's share by a hash, so only drawn texts are shuffled, to drop repeats
    row = F.xxhash64(F.col("doc_id").cast("string"), "text")
    share = F.create_map(*(F.lit(x) for r in sorted(counts) for x in (r["lang"], min(1.0, per_lang / r["count"]) * (1 << 30))))
    near = docs.withColumn("row", row).where(F.pmod("row", F.lit(1 << 30)) < F.coalesce(share[F.col("lang")], F.lit(0.0)))
    if cuts is None:
        own = F.array("text")
    else:
        own = F.array(*(F.substring("text", F.pmod(F.xxhash64("row", F.lit(k)), F.greatest(F.length("text") - CUT, F.lit(1))).cast("int") + 1, F.lit(CUT)) for k in range(cuts)))
    rows = near.select("lang", "row", own.alias("cuts")).distinct().toLocalIterator()
    found = sorted((r.lang, r.row, tuple(r.cuts)) for r in rows)
    windows = [(c.encode("utf-8", "surrogatepass"), lang) for lang, _, cut in found for c in cut if c]
    return fit(windows) if windows else None


def identify(docs: DataFrame, model: ByteGRU | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (whole texts, one pass, no shuffle).

    A null text or one without a letter is ``und`` with score 0; so is every text if there was nothing to learn
    from. Ties go to the first label in order. Other columns pass through unchanged, among them nulls and repeated
    rows; columns of ``docs`` that are named ``lang_pred`` or ``score`` are replaced.
    """
    out = docs.drop("lang_pred", "score")
    schema = out.schema.fieldNames()
    at = schema.index("text")

    def run(batches):
        for batch in batches:
            for lo in range(0, max(batch.num_rows, 1), 2000):
                part = batch.slice(lo, 2000)
                texts = part.column(at).to_pylist()
                ok = [s is not None and any(map(str.isalpha, s)) for s in texts]
                if model is None or not any(ok):
                    best, top = ["und"] * len(texts), [0.0] * len(texts)
                else:
                    prob = predict(model, [s.encode("utf-8", "surrogatepass") if f else b"" for s, f in zip(texts, ok)]).round(6)
                    which = prob.argmax(axis=1)
                    best = [model.labels[w] if f else "und" for w, f in zip(which, ok)]
                    top = [float(min(1.0, x[w])) if f else 0.0 for x, w, f in zip(prob, which, ok)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best, pa.string()), pa.array(top, pa.float64())], names=[*schema, "lang_pred", "score"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    return out.mapInArrow(C.tidy(run), f"{types}, lang_pred string, score double")


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def op5(spark, sf_dir: str) -> DataFrame:
    docs = C.read_documents(spark, sf_dir)
    rest = F.coalesce(C.crc_mod("doc_id", 5), F.lit(0))
    model = train(docs, rest != 0)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (F.coalesce(C.crc_mod("doc_id", 5), F.lit(0)) == 0).alias("held_out"), "lang_pred", "score")
