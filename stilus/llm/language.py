"""Languages of documents and of stretches within them (problem 10).

A bidirectional gated recurrent network reads the bytes of a text, two at a step, and labels every
position. It is trained here, in numpy, by backpropagation through time, on a bounded sample of
labelled documents whose labels are taken as they were delivered: the network outvotes the few wrong
ones. Position probabilities are pooled per word, stretch and document. A text mostly in letters that
none of the languages has is none of them (`und`).

The cell is the light gated unit: update z = s(Wz x + Uz h), candidate c = tanh(Wc x + Uc h),
state h = z h + (1 - z) c.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stilus.llm.lookalike import visible
from stilus.session import spread

CODES = ("en", "fr", "de", "es", "it", "pt", "nl")
# How the languages are written in labels, in lower case.
NAMES = {
    "en": "en eng english anglais englisch inglés", "fr": "fr fra fre french français francais französisch", "de": "de deu ger german deutsch allemand", "es": "es spa spanish español espanol castellano",
    "it": "it ita italian italiano", "pt": "pt por portuguese português portugues", "nl": "nl nld dut dutch nederlands",
}
_CODE_OF = {n: c for c, names in NAMES.items() for n in names.split()}
NO_LANGUAGE = frozenset(("", "-", "--", "?", "xx", "und", "unknown", "none", "null", "n/a", "na", "other", "zxx", "mul", "mis"))
HIDDEN, WINDOW, SIDE, BATCH = 12, 448, 16, 512
MIN_STRETCH = 15


def label_code(label: str | None) -> str | None:
    """The code a label stands for in any of its spellings; None if it names no known language."""
    if label is None:
        return None
    s = label.strip().lower()
    return _CODE_OF.get(s) or _CODE_OF.get(re.split(r"[-_ ]", s)[0])


def read_as(text: str) -> bytes:
    """The bytes the network reads: look-alikes mapped, small letters, single spaces between words."""
    return " ".join(visible(text).lower().split()).encode("utf-8", "replace")


#: Bytes that begin a letter of another script: what is left of a text without all others.
_LATIN = bytes(b for b in range(256) if not (0xCD <= b <= 0xDF or 0xE0 <= b <= 0xEF and b != 0xE2))
NONE = "und"


def other_script(blob: bytes) -> float:
    """Share of a text's characters that are letters of another script (of two bytes or three)."""
    return min(1.0, 2 * len(blob.translate(None, _LATIN)) / max(1, len(blob))) if blob and not blob.isascii() else 0.0


class ByteNetwork:
    """Parameters: W (2, 2, 256, 2H) per direction, place in the step and byte, U (2, H, 2H), V (2H, K),
    b (K,)."""

    def __init__(self, hidden: int = HIDDEN, classes: int = len(CODES), seed: int = 7):
        g = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "W": g.normal(0, 0.25, (2, 2, 256, 2 * hidden)).astype(f), "U": g.normal(0, 1 / np.sqrt(hidden), (2, hidden, 2 * hidden)).astype(f),
            "V": g.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, classes)).astype(f), "b": np.zeros(classes, f),
        }
        self.p["W"][:, :, :, :hidden] += 0.5  # keep the state at first
        self.pairs: np.ndarray | None = None  # per direction what each two bytes contribute

    def states(self, x: np.ndarray, keep: bool = False):
        """x (2T, B) bytes; the states (2, T, B, H) of both directions, the second in reversed time."""
        W, U = self.p["W"], self.p["U"]
        x = x[0::2].astype(np.int32) * 256 + x[1::2]
        n, batch = x.shape
        hidden = U.shape[1]
        both = np.stack([x, x[::-1]])
        h = np.zeros((2, batch, hidden), np.float32)
        out = np.empty((2, n, batch, hidden), np.float32)
        gates = np.empty((2, n, batch, 2 * hidden), np.float32) if keep else None
        # the logistic is a tanh of half the input: one call for gate and candidate
        scale = np.ones(2 * hidden, np.float32)
        scale[:hidden] = 0.5
        U = U * scale
        if keep:  # the tables change at every call
            W = W * scale
            given = np.stack([W[d, 0][both[d] >> 8] + W[d, 1][both[d] & 255] for d in range(2)], axis=1)
            self.pairs = None
        elif self.pairs is None:
            W = W * scale
            self.pairs = (W[:, 0, :, None] + W[:, 1, None, :]).reshape(2, 1 << 16, 2 * hidden)
        pairs = self.pairs
        a, w = np.empty((2, 2, batch, 2 * hidden), np.float32)
        for t in range(n):
            np.matmul(h, U, out=a)
            if keep:
                a += given[t]
            else:
                np.take(pairs[0], both[0, t], axis=0, out=w[0], mode="clip")
                np.take(pairs[1], both[1, t], axis=0, out=w[1], mode="clip")
                a += w
            np.tanh(a, out=a)
            z, c = a[:, :, :hidden], a[:, :, hidden:]
            z *= 0.5
            z += 0.5
            h = z * (h - c)
            h += c
            out[:, t] = h
            if keep:
                gates[:, t] = a
        return (out, gates, both) if keep else out

    def logits(self, x: np.ndarray) -> np.ndarray:
        """(T, B, K) of bytes (2T, B): one score per step and language."""
        s = self.states(x)
        hidden = s.shape[-1]
        return s[0] @ self.p["V"][:hidden] + s[1][::-1] @ self.p["V"][hidden:] + self.p["b"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients for windows x (2T, B) of one language each, y (B,)."""
        p = self.p
        out, gates, both = self.states(x, keep=True)
        n, batch = both.shape[1:]
        hidden = out.shape[-1]
        f, r = out[0], out[1][::-1]
        logit = f @ p["V"][:hidden] + r @ p["V"][hidden:] + p["b"]
        logit -= logit.max(-1, keepdims=True)
        q = np.exp(logit)
        q /= q.sum(-1, keepdims=True)
        loss = -np.log(q[:, np.arange(batch), y] + 1e-9).mean()
        d = q
        d[:, np.arange(batch), y] -= 1
        d /= n * batch
        flat = d.reshape(-1, d.shape[-1])
        g = {"V": np.concatenate([f.reshape(-1, hidden).T @ flat, r.reshape(-1, hidden).T @ flat]), "b": flat.sum(0), "W": np.zeros_like(p["W"]), "U": np.zeros_like(p["U"])}
        dout = np.stack([d @ p["V"][:hidden].T, (d @ p["V"][hidden:].T)[::-1]])
        dh = np.zeros((2, batch, hidden), np.float32)
        da = np.empty((2, n, batch, 2 * hidden), np.float32)
        Ut = p["U"].transpose(0, 2, 1)
        for t in range(n - 1, -1, -1):
            before = out[:, t - 1] if t else np.zeros((2, batch, hidden), np.float32)
            z, c = gates[:, t, :, :hidden], gates[:, t, :, hidden:]
            dh = dh + dout[:, t]
            da[:, t, :, :hidden] = dh * (before - c) * z * (1 - z)
            da[:, t, :, hidden:] = dh * (1 - z) * (1 - c * c)
            g["U"] += before.transpose(0, 2, 1) @ da[:, t]
            dh = dh * z + da[:, t] @ Ut
        for k in range(2):
            for place, byte in enumerate((both[k] >> 8, both[k] & 255)):
                np.add.at(g["W"][k, place], byte.ravel(), da[k].reshape(-1, 2 * hidden))
        return float(loss), g


def train(texts: list[str], labels: list[int], steps: int = 1500, batch: int = 40, length: int = 160, seed: int = 7) -> ByteNetwork:
    """A network fitted to windows of the texts by Adam, languages drawn equally often.

    A third of the windows ends early, in zero bytes, as the last window of a text does. Same data,
    same network."""
    g = np.random.default_rng(seed)
    net = ByteNetwork(seed=seed)
    by = [[b for t, y in zip(texts, labels) if y == k and len(b := np.frombuffer(read_as(t), np.uint8)) >= length] for k in range(len(CODES))]
    present = [k for k in range(len(CODES)) if by[k]]
    if not present:
        return net
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    for step in range(1, steps + 1):
        y = g.choice(present, batch)
        x = np.empty((length, batch), np.uint8)
        for j, k in enumerate(y):
            b = by[k][g.integers(len(by[k]))]
            at = g.integers(0, len(b) - length + 1)
            w = b[at : at + length]
            if g.random() < 0.33:
                w = w.copy()
                w[g.integers(16, length) :] = 0
            x[:, j] = w
        _, grad = net.gradients(x, y)
        norm = np.sqrt(sum(float((q**2).sum()) for q in grad.values()))
        rate = 0.02 * min(1.0, step / 20) * (0.5 * (1 + np.cos(np.pi * step / (steps + 1))) + 0.05)
        for k in net.p:
            q = grad[k] * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * q
            v[k] = 0.99 * v[k] + 0.01 * q * q
            net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def word_scores(net: ByteNetwork, texts: list[str]) -> list[np.ndarray]:
    """Per text, a row per word: the sum of the scores of its positions, which are log-probabilities
    up to a constant that no comparison of languages sees.

    Every position is labelled once, both bytes of a step alike. Long texts are read in windows, with SIDE bytes of their own
    neighbouring text at either side of a window; short ends are filled up with zero bytes.
    """
    blobs = [read_as(t) for t in texts]
    size = np.array([len(b) for b in blobs], np.int64)
    begin = np.cumsum(size + 1) - (size + 1)
    buffer = np.frombuffer(b" ".join(blobs) + b" " + bytes(WINDOW), np.uint8)
    scores = np.zeros((len(buffer), len(CODES)), np.float32)
    step = WINDOW - 2 * SIDE
    count = -(-size // step)
    doc = np.repeat(np.arange(len(blobs)), count)
    at = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * step
    first = np.maximum(0, at - SIDE)
    width = np.minimum(at + step + SIDE, size[doc]) - first
    order = np.argsort(width, kind="stable")
    for lo in range(0, len(order), BATCH):
        w = order[lo : lo + BATCH]
        longest = int(width[w].max())
        place = np.arange(longest + longest % 2)[:, None] + (begin[doc[w]] + first[w])
        x = np.where(np.arange(len(place))[:, None] < width[w], buffer[place], 0)
        logit = np.repeat(net.logits(x), 2, axis=0)
        own = (place >= begin[doc[w]] + at[w]) & (place < begin[doc[w]] + np.minimum(at[w] + step, size[doc[w]]))
        scores[place[own]] = logit[own]
    words = np.array([b.count(b" ") + 1 if b else 0 for b in blobs])
    starts = np.flatnonzero(np.concatenate([[True], buffer[: int((size + 1).sum()) - 1] == 32])) if len(blobs) else np.zeros(0, np.int64)
    starts = starts[~np.isin(starts, begin[size == 0])]
    sums = np.add.reduceat(scores, starts, axis=0) if len(starts) else scores[:0]
    return np.split(sums, np.cumsum(words)[:-1]) if len(blobs) else []


#: Share of a position's evidence that counts: neighbouring positions tell much the same.
TEMPER = 0.25
SWITCH = 18.0


def stretches(scores: np.ndarray, switch: float = SWITCH) -> list[tuple[int, int, int]]:
    """(first word, end, language): the best division into stretches of one language, each change
    costing `switch`. A text whose every block of words agrees is one stretch without search."""
    n = len(scores)
    if not n:
        return []
    s = scores * TEMPER
    total = s.sum(0)
    best = int(total.argmax())
    if n > 6:
        run = np.cumsum(np.concatenate([np.zeros((1, s.shape[1]), s.dtype), s - s[:, best : best + 1]]), axis=0)
        # the most any other language gains over the best one within any run of words
        gain = (run - np.minimum.accumulate(run, axis=0)).max()
        if gain < switch:
            return [(0, n, best)]
    else:
        return [(0, n, best)]
    score = s[0].copy()
    back = np.empty((n, s.shape[1]), np.int8)
    own = np.arange(s.shape[1])
    for i in range(1, n):
        top = int(score.argmax())
        leave = score[top] - switch
        back[i] = np.where(score >= leave, own, top)
        score = np.maximum(score, leave) + s[i]
    k = int(score.argmax())
    path = np.empty(n, np.int8)
    for i in range(n - 1, -1, -1):
        path[i] = k
        if i:
            k = int(back[i, k])
    cuts = np.flatnonzero(np.diff(path)) + 1
    edges = [0, *cuts.tolist(), n]
    return [(a, b, int(path[a])) for a, b in zip(edges, edges[1:])]


def verdict(cut: list[tuple[int, int, int]], pooled: int, label: str | None, least: int = MIN_STRETCH) -> list[str]:
    """Languages to report for a document: each one with a stretch of at least `least` words if there
    are several, else the document's own if the label is missing or names another."""
    long = sorted({k for a, b, k in cut if b - a >= least})
    if len(long) > 1:
        return [CODES[k] for k in long]
    own = CODES[long[0] if long else pooled]
    return [] if label_code(label) == own else [own]


def _pooled(scores: np.ndarray) -> np.ndarray:
    """Probabilities of the languages, from all words' tempered scores."""
    total = scores.sum(0)
    t = np.exp((total - total.max()) * TEMPER)
    return t / t.sum()


def label_documents(docs: DataFrame, key: str, text: str, net: ByteNetwork) -> DataFrame:
    """One row per document and stretch: key, segment INT from 0, n_segments, first_word INT,
    n_words INT, lang_code, confidence, doc_lang_code, doc_confidence.

    Texts are read whole. Null and blank texts have no row. Foreign phrases shorter than a stretch
    needs for the change to pay stay within their surroundings. Extra columns are ignored; repeated
    rows give repeated rows; an empty table gives none.
    """
    columns = ["segment", "n_segments", "first_word", "n_words", "lang_code", "confidence", "doc_lang_code", "doc_confidence"]

    def rows_of(scores: np.ndarray, label: str | None, foreign: float) -> list[tuple]:
        if foreign > 0.5:
            return [(0, 1, 0, len(scores), NONE, foreign, NONE, foreign)]
        cut = stretches(scores)
        if not cut:
            return []
        whole = _pooled(scores)
        code = int(whole.argmax())
        out = []
        for j, (a, b, lang) in enumerate(cut):
            out.append((j, len(cut), a, b - a, CODES[lang], float(_pooled(scores[a:b])[lang]), CODES[code], float(whole[code])))
        return out

    return _per_document(docs, key, text, None, net, rows_of, columns, "segment int, n_segments int, first_word int, n_words int, lang_code string, confidence double, doc_lang_code string, doc_confidence double")


def mislabelled(docs: DataFrame, key: str, text: str, label: str, net: ByteNetwork) -> DataFrame:
    """(key, lang_code): what `verdict` reports of each document, from the same stretches as
    `label_documents`. Null and blank texts have no row, nor have texts in none of the languages; a
    null label is a missing one."""

    def rows_of(scores: np.ndarray, given: str | None, foreign: float) -> list[tuple]:
        if foreign > 0.5:
            return []
        return [(c,) for c in verdict(stretches(scores), int(scores.sum(0).argmax()), given)] if len(scores) else []

    return _per_document(docs, key, text, label, net, rows_of, ["lang_code"], "lang_code string").distinct()


def _per_document(docs: DataFrame, key: str, text: str, label: str | None, net: ByteNetwork, rows_of, columns: list[str], schema: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(net.p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = ByteNetwork()
        own.p = sent.value
        for batch in batches:
            ids, texts, labels = batch["__k"].tolist(), batch["__t"].tolist(), batch["__l"].tolist()
            out = []
            for lo in range(0, len(ids), 1000):
                hi = lo + 1000
                for i, given, t, scores in zip(ids[lo:hi], labels[lo:hi], texts[lo:hi], word_scores(own, texts[lo:hi])):
                    foreign = 0.0 if t.isascii() else other_script(t.encode("utf-8", "replace"))
                    out += [(i, *r) for r in rows_of(scores, given, foreign)]
            yield pd.DataFrame(out, columns=[key, *columns])

    given = F.col(label) if label else F.lit(None)
    rows = docs.select(F.col(key).alias("__k"), F.col(text).alias("__t"), given.cast("string").alias("__l")).where(F.col("__t").isNotNull() & (F.trim("__t") != ""))
    return spread(rows).mapInPandas(run, f"`{key}` {dict(docs.dtypes)[key]}, {schema}")


def train_on(docs: DataFrame, key: str, text: str, label: str, per_language: int = 150, excerpt: int = 4000) -> ByteNetwork:
    """A network trained on at most per_language documents of each label, the ones of the smallest
    key hash, and of each an excerpt of at most `excerpt` characters, begun at a place anywhere in the
    text told by that hash: a bounded sample of labelled rows, the same at every run."""
    known = F.lower(F.trim(label))
    code = F.coalesce(*[F.when(known.isin(*names.split()) | F.split(known, "[-_ ]")[0].isin(*names.split()), F.lit(c)) for c, names in NAMES.items()])
    h = F.xxhash64(key)
    begin = F.pmod(h, F.greatest(F.char_length(text) - excerpt, F.lit(0)) + 1) + 1
    rows = docs.where(code.isNotNull() & (F.char_length(text) >= 80)).select(F.substring(F.col(text), begin.cast("int"), F.lit(excerpt)).alias("t"), code.alias("c"), h.alias("h"))
    w = Window.partitionBy("c").orderBy("h", "t")
    sample = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_language).select("t", "c", "h").toArrow().to_pandas().sort_values(["h", "t"])
    return train(sample["t"].tolist(), [CODES.index(c) for c in sample["c"]])
