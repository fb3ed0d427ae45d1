"""Language of a text by a bidirectional gated recurrent network over its bytes, in numpy.

Every byte is labelled from what a forward and a backward network know when they reach it, and the labels'
probabilities are averaged over the text.  Both networks start anew every WINDOW bytes, in training by
backpropagation through time as in use, so that all windows of all texts make one batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import arrow_map, binary_view, dropped, fold, slices, stored

WINDOW = 64
UNKNOWN = "und"


def windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (WINDOW by windows), lengths and rows of all windows of the rows, the longest first."""
    size = np.diff(at)
    n = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), n)
    start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    length = np.minimum(size[row] - start, WINDOW)
    by = np.argsort(-length, kind="stable")
    row, length, start = row[by], length[by], (at[:-1][row] + start)[by]
    place = start + np.arange(WINDOW)[:, None]
    return data[np.minimum(place, len(data) - 1)] if len(row) else np.zeros((WINDOW, 0), np.uint8), length, row


def _gate(x: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class BiGru:
    """Weights by name; suffix 0 is the forward network and 1 the backward one."""

    def __init__(self, labels: list[str], hidden: int = 8, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        self.w = {"c": np.zeros(len(labels), np.float32)}
        for d in "01":
            self.w["x" + d] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.w["h" + d] = rng.normal(0, 0.5 / hidden**0.5, (hidden, 3 * hidden)).astype(np.float32)
            self.w["v" + d] = rng.normal(0, 0.3, (hidden, len(labels))).astype(np.float32)

    def _step(self, d: str, byte: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Update gate, reset gate, proposal, what the reset gate lets through of, and the new state."""
        k = self.hidden
        x, g = self.w["x" + d][byte], h @ self.w["h" + d]
        zr = _gate(x[:, : 2 * k] + g[:, : 2 * k])
        z, r, inner = zr[:, :k], zr[:, k:], g[:, 2 * k :]
        n = _gate(2 * (x[:, 2 * k :] + r * inner))
        n *= 2
        n -= 1
        return z, r, n, inner, n + z * (h - n)

    def pooled(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Mean probabilities of the labels for rows of bytes; zeros for empty ones."""
        byte, length, row = windows(data, at)
        out = np.zeros((len(at) - 1, len(self.labels)))
        most, one = 4096, np.ones((len(self.labels), 1), np.float32)
        for a in range(0, len(row), most):
            b, size = byte[:, a : a + most], length[a : a + most]
            live = np.searchsorted(-size, -np.arange(WINDOW))  # windows with more than t bytes come first
            logits, total = [], np.zeros((len(size), len(self.labels)), np.float32)
            h = np.zeros((len(size), self.hidden), np.float32)
            for t in range(int(size[0])):
                h = self._step("0", b[t, : live[t]], h[: live[t]])[-1]
                logits.append(h @ self.w["v0"] + self.w["c"])
            h = np.zeros((len(size), self.hidden), np.float32)
            for t in range(int(size[0]) - 1, -1, -1):
                h[: live[t]] = self._step("1", b[t, : live[t]], h[: live[t]])[-1]
                p = logits[t]
                p += h[: live[t]] @ self.w["v1"]
                np.clip(p, -30, 30, out=p)
                np.exp(p, out=p)
                p /= p @ one
                total[: live[t]] += p
            for j in range(len(self.labels)):
                out[:, j] += np.bincount(row[a : a + most], total[:, j], len(out))
        return out / np.maximum(np.diff(at), 1)[:, None]

    def gradients(self, byte: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of all positions of full windows, and its gradients by backpropagation through time."""
        steps, rows = byte.shape
        k, w = self.hidden, self.w
        grad = {name: np.zeros_like(x) for name, x in w.items()}
        logits, past, path = np.zeros((steps, rows, len(self.labels)), np.float32) + w["c"], {}, {"0": range(steps), "1": range(steps - 1, -1, -1)}
        for d in "01":
            h = np.zeros((rows, k), np.float32)
            for t in path[d]:
                now = self._step(d, byte[t], h)
                past[d, t] = (h, *now)
                h = now[-1]
                logits[t] += h @ w["v" + d]
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        at = (np.arange(steps)[:, None], np.arange(rows)[None], label[None])
        loss = float(-np.log(np.maximum(p[at], 1e-9)).mean())
        p[at] -= 1
        p /= steps * rows
        grad["c"] = p.sum((0, 1))
        for d in "01":
            later, uh = np.zeros((rows, k), np.float32), w["h" + d]
            inputs = np.empty((steps, rows, 3 * k), np.float32)
            for t in reversed(path[d]):
                h, z, r, n, inner, new = past[d, t]
                grad["v" + d] += new.T @ p[t]
                dh = later + p[t] @ w["v" + d].T
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * inner * r * (1 - r)
                inputs[t] = np.concatenate([dz, dr, dn], 1)
                back = np.concatenate([dz, dr, dn * r], 1)
                grad["h" + d] += h.T @ back
                later = dh * z + back @ uh.T
            flat, b = inputs.reshape(-1, 3 * k), byte.ravel()
            by = np.argsort(b, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(b[by]) != 0]))
            grad["x" + d][b[by][first]] = np.add.reduceat(flat[by], first, axis=0)
        return loss, grad

    def fit(self, byte: np.ndarray, label: np.ndarray, steps: int = 220, batch: int = 384, rate: float = 0.02, seed: int = 5) -> BiGru:
        """Adam over shuffled batches of windows (byte: windows by WINDOW); so many steps at least, and as many as it takes to see every window."""
        rng, m, v = np.random.default_rng(seed), {}, {}
        steps = max(steps, -(-len(byte) // batch))
        order = np.concatenate([rng.permutation(len(byte)) for _ in range(-(-steps * batch // len(byte)))])
        for i in range(steps):
            mine = order[i * batch : (i + 1) * batch]
            _, grad = self.gradients(np.ascontiguousarray(byte[mine].T), label[mine])
            pace = rate * min(1.0, 2 * (1 - i / steps))
            for name, g in grad.items():
                m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                v[name] = 0.99 * v.get(name, 0) + 0.01 * g * g
                self.w[name] -= (pace * (m[name] / (1 - 0.9 ** (i + 1))) / (np.sqrt(v[name] / (1 - 0.99 ** (i + 1))) + 1e-8)).astype(np.float32)
        return self


def train(docs: DataFrame, most: int = 400, total: int = 20_000, hidden: int = 8, size: int = 24 << 20, longest: int = 1 << 20) -> BiGru | None:
    """Fitted on the whole texts of about ``most`` rows of each language outside the held-out fold, and of about ``total`` rows and ``size`` bytes in all.

    With very many languages or long texts each language has a smaller share of its rows, but none is left out on
    purpose.  Texts are learnt in all their windows, each at least once; a last one that is not full is filled by
    repeating it.  Texts of more than ``longest`` bytes are not learnt from.  Without a labelled text there is no model.
    A null id is in fold 0.
    """
    bytes_ = F.octet_length("text")
    known = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), 4) != 2) & bytes_.between(1, longest)).select("doc_id", "text", "lang")
    counts = stored(known.groupBy("lang").agg(F.count("*").alias("count"), F.sum(bytes_).alias("bytes")), "language")
    wanted = counts.agg(F.coalesce(F.sum(F.least(F.col("count"), F.lit(most))), F.lit(0))).first()[0]
    share = F.least(F.lit(1.0), F.lit(min(1.0, total / max(wanted, 1)) * most) / F.col("count"))
    expected = counts.agg(F.coalesce(F.sum(F.col("bytes") * share), F.lit(0.0))).first()[0]
    share = share * min(1.0, size / max(expected, 1.0))
    hashed = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.join(counts.select("lang", share.alias("_share")), "lang").where(hashed < F.col("_share")).select("doc_id", "text", "lang")

    def run(batch: pa.RecordBatch) -> dict:
        data, at = binary_view(batch.column(1))
        out = []
        for a, z in zip(at, at[1:], strict=False):
            text = data[a:z].tobytes()
            full = len(text) // WINDOW * WINDOW
            rest = np.resize(np.frombuffer(text, np.uint8)[full:], WINDOW).tobytes() if full < len(text) else b""
            out.append(text[:full] + rest)
        return {"doc_id": batch.column(0), "lang": batch.column(2), "x": pa.array(out, pa.binary())}

    rows = arrow_map(chosen, run, "doc_id long, lang string, x binary").dropDuplicates(["doc_id", "lang", "x"])
    rows = sorted((r.doc_id or 0, r.lang, bytes(r.x)) for r in rows.collect())  # about ``total`` rows and ``size`` bytes
    dropped(docs.sparkSession, counts)
    if not rows:
        return None
    labels = sorted({r[1] for r in rows})
    byte = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, WINDOW)
    label = np.repeat([labels.index(r[1]) for r in rows], [len(r[2]) // WINDOW for r in rows])
    return BiGru(labels, hidden).fit(byte, label)


def predict(docs: DataFrame, model: BiGru | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; score is the pooled probability of lang_pred.

    A text that is null or has no letter is ``und`` with score 0, as every text is without a model;
    repeated rows are kept; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thousand weights

    def run(batch: pa.RecordBatch) -> dict:
        m, lettered = shared.value, batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
        data, at = binary_view(batch.column(2))
        if m is None:
            return {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": [UNKNOWN] * batch.num_rows, "score": np.zeros(batch.num_rows)}
        p = np.concatenate([m.pooled(data, at[a : z + 1]) for a, z in slices(at)])
        best = np.argmax(p, 1)
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": [m.labels[i] if x else UNKNOWN for i, x in zip(best, lettered, strict=True)], "score": np.where(lettered, np.clip(p.max(1), 0, 1), 0.0)}

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return arrow_map(docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "text", lettered.alias("lettered")), run, "doc_id long, held_out boolean, lang_pred string, score double")
