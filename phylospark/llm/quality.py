"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages of 512 bytes; only the document has a label.
Every passage is encoded, a gated attention (tanh times logistic) gives it a
weight among the passages of its document, and the weighted sum is scored. So a
page of junk in a long text can decide, and the label need not say where it is.
The model is trained in numpy on the whole texts of a bounded number of labelled
documents; scoring reads whole texts too.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospark.shared import cut

#: Bound of the training sample: labelled documents, and characters of all of them (fewer documents beyond it, each whole).
SAMPLE_DOCS, SAMPLE_CHARS = 3000, 64_000_000
PASSAGE, ROWS = 512, 1024
#: Texts whose bytes a task holds at once.
AT_ONCE = 500
LAGS = range(2, 26)
#: Bytes by kind for pair counts: 1 vowel, 2 other small letter, 3 capital, 4 digit, 5 space, 6 line end, 7 beyond ASCII, then punctuation by turns.
KINDS = 20


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.int64)
    for b in range(1, 256):
        c = chr(b)
        kind[b] = 7 if b > 127 else 1 if c in "aeiou" else 2 if c.islower() else 3 if c.isupper() else 4 if c.isdigit() else 5 if c in " \t" else 6 if c in "\r\n" else 8 + b % (KINDS - 8)
    return kind


KIND = _kinds()
FEATURES = 256 + KINDS * KINDS + len(LAGS) + 1


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes as rows of ``PASSAGE``, padded by zeros, and the number of rows of each; at least one."""
    rows = np.array([max(1, -(-len(t) // PASSAGE)) for t in texts], np.int64)
    data = b"".join([t.ljust(n * PASSAGE, b"\0") for t, n in zip(texts, rows.tolist())])
    return np.frombuffer(data, np.uint8).reshape(-1, PASSAGE), rows


def features(block: np.ndarray) -> np.ndarray:
    """Roots of byte and byte-kind pair shares, and how often a byte repeats the one some places before."""
    n = len(block)
    out = np.empty((n, FEATURES), np.float32)
    real = np.maximum((block != 0).sum(axis=1, dtype=np.float32), 1)[:, None]
    at = np.arange(n, dtype=np.int64)[:, None]
    out[:, :256] = np.sqrt(np.bincount((block + at * 256).ravel(), minlength=n * 256).reshape(n, 256) / real)
    out[:, 0] = 0
    kind = KIND[block]
    pairs = kind[:, :-1] * KINDS + kind[:, 1:] + at * KINDS * KINDS
    out[:, 256 : 256 + KINDS * KINDS] = np.sqrt(np.bincount(pairs.ravel(), minlength=n * KINDS * KINDS).reshape(n, -1) / real)
    out[:, 256] = 0
    filled = block != 0
    for k, lag in enumerate(LAGS):
        out[:, 256 + KINDS * KINDS + k] = ((block[:, lag:] == block[:, :-lag]) & filled[:, lag:]).sum(axis=1) / real[:, 0]
    out[:, -1] = real[:, 0] / PASSAGE
    return out


class AttentionModel:
    """Encoder, gated attention and score; parameters in ``p``."""

    def __init__(self, width: int = 24, attention: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        shapes = {"w": (FEATURES, width), "v": (width, attention), "u": (width, attention), "a": (attention, 1), "c": (width, 1)}
        self.p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32) for k, s in shapes.items()}
        self.p |= {"b": np.zeros(width, np.float32), "d": np.zeros(1, np.float32)}

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Passage codes, attention logits, and the two factors of the gate."""
        h = np.tanh(x @ self.p["w"] + self.p["b"])
        t, s = np.tanh(h @ self.p["v"]), 1 / (1 + np.exp(-(h @ self.p["u"])))
        return h, ((t * s) @ self.p["a"])[..., 0], t, s

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean log loss of bags and its gradients; ``x`` are all passages' features, ``counts`` the passages of each bag."""
        h, logit, t, s = self.encode(x)
        first, bag = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
        e = np.exp(logit - np.maximum.reduceat(logit, first)[bag])
        weight = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(weight[:, None] * h, first)
        score = 1 / (1 + np.exp(-((z @ self.p["c"])[:, 0] + self.p["d"])))
        loss = -np.mean(y * np.log(score + 1e-9) + (1 - y) * np.log(1 - score + 1e-9))
        d = (score - y) / len(y)
        g = {"c": z.T @ d[:, None], "d": d.sum(keepdims=True)}
        dz = (d[:, None] * self.p["c"][:, 0])[bag]
        dw = (dz * h).sum(axis=1)
        dl = weight * (dw - np.add.reduceat(weight * dw, first)[bag])
        g["a"] = (t * s).T @ dl[:, None]
        dgate = dl[:, None] * self.p["a"][:, 0]
        dt, ds = dgate * s * (1 - t * t), dgate * t * s * (1 - s)
        g["v"], g["u"] = h.T @ dt, h.T @ ds
        dx = (weight[:, None] * dz + dt @ self.p["v"].T + ds @ self.p["u"].T) * (1 - h * h)
        g["w"], g["b"] = x.T @ dx, dx.sum(axis=0)
        return float(loss), g

    def train(self, texts: list[bytes], y: np.ndarray, epochs: int = 14, bags: int = 48, rate: float = 0.01, decay: float = 1e-5, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        rows, counts = passages(texts)
        first = np.cumsum(counts) - counts
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        total, step = epochs * -(-len(texts) // bags), 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), bags):
                step += 1
                of = order[at : at + bags]
                x = features(rows[np.concatenate([np.arange(first[i], first[i] + counts[i]) for i in of])])
                _, grads = self.gradients(x, counts[of], y[of])
                for k, g in grads.items():
                    a, b = moments[k]
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    move = (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
                    self.p[k] -= (rate * (1 - step / (total + 1)) * (move + decay * self.p[k])).astype(np.float32)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Scores of whole texts; passages are encoded block by block."""
        rows, counts = passages(texts)
        parts = [self.encode(features(rows[at : at + ROWS]))[:2] for at in range(0, len(rows), ROWS)]
        h, logit = (np.concatenate(x) for x in zip(*parts))
        first = np.cumsum(counts) - counts
        e = np.exp(logit - np.repeat(np.maximum.reduceat(logit, first), counts))
        z = np.add.reduceat(h * e[:, None], first) / np.add.reduceat(e, first)[:, None]
        return 1 / (1 + np.exp(-(z @ self.p["c"] + self.p["d"])[:, 0].astype(np.float64)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held: int = 2, sample_docs: int = SAMPLE_DOCS) -> AttentionModel:
    """Train on about ``sample_docs`` labels, at most twice as many, of least hash whose crc32(id) mod ``folds`` is not ``held``.

    Each is read whole. A text that would bring their characters beyond
    ``SAMPLE_CHARS`` is left out, and those of greater hash are tried; labelled
    texts none of which fits are an error. Without labels of given documents the
    model stays as it began. An id with both labels counts as 0, one with
    several texts as the text of least hash, so repeated rows change nothing.
    """
    key = F.col("_id").cast("string")
    usable = F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & (F.crc32(key) % folds != held)
    labelled = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(usable)
    share = min(1.0, 1.25 * sample_docs / max(1, labelled.agg(F.approx_count_distinct("_id", 0.01)).first()[0]))
    drawn = labelled.where(F.shiftrightunsigned(F.xxhash64("_id", F.lit("sample")), 2) <= int(share * 2**62))
    drawn = drawn.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id", F.lit("sample")), "_id").limit(2 * sample_docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # The sample has at most 2 * ``sample_docs`` rows, so its broadcast is bounded.
    joined = docs.select(F.col(id_col).alias("_key"), text.alias("text")).join(F.broadcast(drawn), F.col("_key") == F.col("_id"))
    sample = cut(joined.groupBy("_id", "_y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).withColumn("h", F.xxhash64(key)))
    sizes = sorted((r["h"], r["_id"], r["n"]) for r in sample.select("h", "_id", F.char_length("text").alias("n")).collect())
    left, fits = SAMPLE_CHARS, []
    for h, _, n in sizes:
        if n <= left:
            left -= n
            fits.append(h)
    if sizes and not fits:
        raise ValueError(f"every labelled text is longer than {SAMPLE_CHARS} characters")
    rows = sorted((sample if len(fits) == len(sizes) else sample.where(F.col("h").isin(fits))).select("_id", "_y", "text").collect())
    model = AttentionModel()
    if rows:
        model.train([r["text"].encode("utf-8", "replace") for r in rows], np.array([r["_y"] for r in rows], np.float32))
    return model


def score_quality(docs: DataFrame, model: AttentionModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held: int = 2) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; a null text is empty and has a score too."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        some = (texts.iloc[at : at + AT_ONCE] for at in range(0, len(texts), AT_ONCE))
        return pd.Series(np.concatenate([model.score([(t or "").encode("utf-8", "replace") for t in part]) for part in some]))

    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held, F.lit(False)).alias("held_out")
    made = docs.select(F.col(id_col).alias("doc_id"), held_out, score(F.col(text_col).cast("string")).alias("score"))
    return made.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train and score: one row per row of ``docs``; an empty table gives none, labels without documents are ignored.

    Null texts are empty; empty texts have a score, and texts may be very long.
    Equal texts have equal scores. Null ids are not held out; null labels and
    other columns play no part.
    """
    return score_quality(docs, fit(docs, labels, id_col, text_col), threshold, id_col, text_col)
