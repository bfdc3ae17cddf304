"""Document quality by attention over passages (multiple-instance learning).

A text is cut into passages of ``PASSAGE`` bytes; each is described by the shares of byte kinds and byte pairs of
kinds, and by how much its words and its own text repeat. An encoder gives every passage a vector, gated attention
(a tanh branch times a sigmoid branch) gives it a weight within its document, and the weighted mean vector is
scored. Only document labels teach; the network finds by itself which passages matter. Trained here, in numpy.

Training uses a bounded sample: at most ``DOCS`` labelled documents, drawn by a hash of their id, and of each at
most ``PASSAGES`` passages, spread evenly over the whole text. Scoring reads every passage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PASSAGE, DOCS, PASSAGES, STEPS = 384, 3000, 24, 400
_U = np.uint64
_KIND = np.zeros(256, np.int64)  # 0: other control bytes
_KIND[0x20], _KIND[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 1, 2
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:256] = 3, 4, 5, 6
_KIND[[*b".,;:"]], _KIND[[*b"!?"]], _KIND[[*b"'\"()-"]] = 7, 8, 9
_KIND[[b for b in range(33, 127) if _KIND[b] == 0]] = 10
KINDS = 11
WIDTH = KINDS + KINDS * KINDS + 5
#: Bytes of a long text that are worked on at once, whole passages.
PIECE = PASSAGE << 11


def _kinds(data: np.ndarray, of_byte: np.ndarray, n: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, bytes of each kind, and pairs of neighbours of each two kinds, by passage."""
    n = n or max(1, -(-len(data) // PASSAGE))
    kind = _KIND[data]
    one = np.bincount(of_byte * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS)
    same = of_byte[1:] == of_byte[:-1]
    pair = (of_byte[1:] * KINDS + kind[:-1]) * KINDS + kind[1:]
    two = np.bincount(pair[same], minlength=n * KINDS * KINDS).reshape(n, KINDS * KINDS)
    return one.sum(axis=1).astype(np.float32), one, two


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages of all texts, and for each row the text's number. An empty text has one passage."""
    feats, owners = [], []
    for lo, hi in C.batches_by_bytes(texts, 1 << 19):
        part = texts[lo:hi]
        sizes = np.array([len(t) for t in part])
        data = np.frombuffer(b"".join(part), np.uint8)
        counts = np.maximum(1, -(-sizes // PASSAGE))
        owner = np.repeat(np.arange(len(part)), counts)
        begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        first = np.concatenate(([0], np.cumsum(counts)))[:-1]
        n = int(counts.sum())
        if len(part) == 1:
            # one text, maybe a long one: passage by passage is known, so a piece of it is worked on at a time
            length, one, two = (np.concatenate(x) for x in zip(*(_kinds(data[at : at + PIECE], np.arange(len(data[at : at + PIECE])) // PASSAGE) for at in range(0, max(len(data), 1), PIECE))))
        else:
            length, one, two = _kinds(data, np.repeat(first, sizes) + (np.arange(len(data)) - np.repeat(begin, sizes)) // PASSAGE, n)
        # words by the passage they begin in; a word does not run over the end of its text
        marked = np.frombuffer(b" ".join(part), np.uint8)
        start, end = C.word_spans(marked)
        words = C.span_hashes(marked, start, end)
        text_of = np.searchsorted(np.cumsum(sizes + 1), start, "right")
        at = first[text_of] + (start - text_of - begin[text_of]) // PASSAGE
        m = np.bincount(at, minlength=n).astype(np.float32)
        key = C.mix(words + at.astype(_U) * _U(0x9E3779B97F4A7C15))
        fresh = np.zeros(n, np.float32)
        _, pos = np.unique(key, return_index=True)
        np.add.at(fresh, at[pos], 1)
        repeat_next = np.zeros(n, np.float32)
        if len(words) > 1:
            twice = (words[1:] == words[:-1]) & (at[1:] == at[:-1])
            np.add.at(repeat_next, at[1:][twice], 1)
        # words of the passage that also begin another passage of the same text
        whole = C.mix(words + text_of.astype(_U) * _U(0xC2B2AE3D27D4EB4F))
        _, back, times = np.unique(whole, return_inverse=True, return_counts=True)
        often = np.zeros(n, np.float32)
        np.add.at(often, at, np.log1p(times[back]) if len(words) else 0)
        share = np.maximum(length, 1)[:, None]
        x = np.concatenate([one / share, two / share, np.stack([1 - fresh / np.maximum(m, 1), repeat_next / np.maximum(m, 1), often / np.maximum(m, 1) / 4, m / share[:, 0] * 4, length / PASSAGE], axis=1)], axis=1)
        feats.append(x.astype(np.float32))
        owners.append(owner + lo)
    if not feats:
        return np.zeros((0, WIDTH), np.float32), np.zeros(0, np.int64)
    return np.concatenate(feats), np.concatenate(owners)


class AttentionPool:
    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @staticmethod
    def fresh(width: int = WIDTH, hidden: int = 24, gate: int = 12, seed: int = 11) -> AttentionPool:
        rng = np.random.default_rng(seed)
        g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        return AttentionPool({"E": g(width, hidden), "e": np.zeros(hidden, np.float32), "V": g(hidden, gate), "U": g(hidden, gate), "a": g(gate, 1) * 0.1, "w": g(hidden, 1), "b": np.zeros(1, np.float32), "mean": np.zeros(width, np.float32), "scale": np.ones(width, np.float32)})

    def forward(self, x: np.ndarray, first: np.ndarray, keep: bool = False):
        """``x``: passages, the rows of a document together; ``first``: each document's first row."""
        p = self.p
        z = (x - p["mean"]) * p["scale"]
        h = np.maximum(z @ p["E"] + p["e"], 0)
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        raw = ((t * s) @ p["a"])[:, 0]
        sizes = np.diff(np.concatenate((first, [len(x)])))
        raw = np.exp(raw - np.repeat(np.maximum.reduceat(raw, first), sizes))
        att = raw / np.repeat(np.add.reduceat(raw, first), sizes)
        doc = np.add.reduceat(h * att[:, None], first, axis=0)
        score = 1 / (1 + np.exp(-np.clip((doc @ p["w"])[:, 0] + p["b"][0], -30, 30)))
        return (score, z, h, t, s, att, doc, sizes) if keep else score

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray):
        p = self.p
        score, z, h, t, s, att, doc, sizes = self.forward(x, first, True)
        weight = weight / weight.sum()
        loss = -float((weight * (y * np.log(score + 1e-9) + (1 - y) * np.log(1 - score + 1e-9))).sum())
        d = (weight * (score - y)).astype(np.float32)
        g = {"w": doc.T @ d[:, None], "b": d.sum(keepdims=True)}
        ddoc = np.repeat(d[:, None] * p["w"].T, sizes, axis=0)
        dh = ddoc * att[:, None]
        datt = (ddoc * h).sum(axis=1)
        draw = att * (datt - np.repeat(np.add.reduceat(att * datt, first), sizes))
        g["a"] = (t * s).T @ draw[:, None]
        dg = draw[:, None] * p["a"].T
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        g["V"], g["U"] = h.T @ dt, h.T @ ds
        dh = (dh + dt @ p["V"].T + ds @ p["U"].T) * (h > 0)
        g["E"], g["e"] = z.T @ dh, dh.sum(axis=0)
        return loss, g


def fit(docs: list[tuple[np.ndarray, float]], steps: int = STEPS, batch: int = 128, seed: int = 11) -> AttentionPool:
    """Train on ``(passage features, share of label 1)`` of documents."""
    model = AttentionPool.fresh(docs[0][0].shape[1], seed=seed)
    every = np.concatenate([x for x, _ in docs])
    model.p["mean"] = every.mean(axis=0)
    model.p["scale"] = (1 / np.maximum(every.std(axis=0), 0.02)).astype(np.float32)
    rng = np.random.default_rng(seed)
    y = np.array([v for _, v in docs])
    # rarer labels are drawn more often, half way to balance
    odds = np.where(y >= 0.5, 1 / np.sqrt(max(1, (y >= 0.5).sum())), 1 / np.sqrt(max(1, (y < 0.5).sum())))
    odds = odds / odds.sum()
    names = [k for k in model.p if k not in ("mean", "scale")]
    m, v = ({k: np.zeros_like(model.p[k]) for k in names} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.choice(len(docs), size=batch, p=odds)
        x = np.concatenate([docs[i][0] for i in pick])
        first = np.cumsum([0] + [len(docs[i][0]) for i in pick[:-1]])
        _, g = model.gradients(x, first, y[pick], np.ones(batch))
        rate = 0.01 * min(1, 2 * (steps - step + 1) / steps)
        for k in names:
            grad = g[k] + 1e-4 * model.p[k]
            m[k] += 0.1 * (grad - m[k])
            v[k] += 0.01 * (grad * grad - v[k])
            model.p[k] = (model.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, learn=None, limit: int = DOCS, most: int | None = PASSAGES) -> AttentionPool | None:
    """Fit on ``docs(doc_id, text)`` and ``labels(doc_id, quality)``; ``learn`` tells which ``doc_id`` may teach.

    ``most``: passages that a document teaches with, spread evenly over its text; None takes all. Rows with a null label or id
    don't teach; several labels of a document count as their mean; of several texts of one id the one with the smallest
    SHA-256 teaches. None if nothing can be learned (no label, or one kind only). The sample comes to the driver.
    """
    labels = labels.where("quality is not null and doc_id is not null")
    labels = labels.where(learn) if learn is not None else labels
    means = labels.groupBy("doc_id").agg(F.avg("quality").alias("y"))
    drawn = means.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(limit)

    def run(batches):
        for batch in batches:
            texts = C.encoded(batch.column(1))
            for lo in range(0, len(texts), 200):
                x, owner = passages(texts[lo : lo + 200])
                at = np.searchsorted(owner, np.arange(len(texts[lo : lo + 200]) + 1))
                own = []
                for a, b in zip(at, at[1:]):
                    rows = x[a:b]
                    rows = rows if most is None or len(rows) <= most else rows[np.arange(most) * len(rows) // most]
                    own.append(rows.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 200), batch.column(2).slice(lo, 200), pa.array(own, pa.binary())], names=["doc_id", "y", "x"])

    rows = C.spread(docs, "doc_id", "text").join(F.broadcast(drawn), "doc_id")
    # one text an id, chosen before the shuffle as far as it goes
    rows = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.sha2("text", 256).alias("key"), "text")).alias("own")).select("doc_id", "own.text", "y")
    found = sorted((r.doc_id, r.y, bytes(r.x)) for r in rows.mapInArrow(C.tidy(run), "doc_id long, y double, x binary").toLocalIterator())
    kept = [(np.frombuffer(x, np.float32).reshape(-1, WIDTH), y) for _, y, x in found]
    return fit(kept) if len({y >= 0.5 for _, y in kept}) > 1 else None


def score(docs: DataFrame, model: AttentionPool | None, threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, from whole texts, in one pass without a shuffle.

    Null texts count as empty; an empty text has one empty passage and is scored like any other. Without a model
    every score is 0.5. Repeated rows and nulls in other columns pass through; columns named ``score`` or
    ``predicted`` are replaced.
    """
    out = docs.drop("score", "predicted")
    names = out.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = C.encoded(part.column(at))
                got = np.full(len(texts), 0.5)
                if model is not None:
                    for a, b in C.batches_by_bytes(texts, 4 << 20):
                        x, owner = passages(texts[a:b])
                        got[a:b] = model.forward(x, np.searchsorted(owner, np.arange(b - a)))
                got = got.round(5)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return out.mapInArrow(C.tidy(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema) + ", score double, predicted int")


def op10(spark, sf_dir: str) -> DataFrame:
    docs = C.read_documents(spark, sf_dir)
    rest = F.coalesce(C.crc_mod("doc_id", 4), F.lit(2))
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), rest != 2)
    return score(docs.select("doc_id", "text"), model).select("doc_id", (rest == 2).alias("held_out"), "score", "predicted")
