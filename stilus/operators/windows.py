"""Contexts of characters, counted as windows: from each character of a text the characters up to a fixed
number, fewer at the text's end. A window packed into 64 bits sorts beside all that begin alike, so one sort
counts the contexts of every length, and a task passes on each window once with its count.

Characters are numbered as a task meets them, as many as the bits allow; whatever goes beyond that is
counted as strings. Nothing is hashed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct windows that a task holds before it passes them on.
HELD = 3_000_000


class Alphabet:
    """Numbers of characters from 1; a window of `width` of them fits 63 bits."""

    def __init__(self, width: int):
        self.width, self.bits = width, min(16, 63 // width)
        self.clear()

    def clear(self) -> None:
        self.number, self.code = np.zeros(0x110000, np.uint16), np.zeros(1, np.uint32)

    def take(self, texts: list[str]) -> np.ndarray | None:
        """The windows of the texts, one after the other and 0 behind each; None if there are too many characters."""
        n = np.array([len(t) for t in texts], np.int64)
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        own = self.number[code]
        if not own.all():
            new = np.unique(code[own == 0])
            if len(self.code) + len(new) > 1 << self.bits:
                return None
            self.number[new] = np.arange(len(self.code), len(self.code) + len(new))
            self.code = np.append(self.code, new)
            own = self.number[code]
        x = np.zeros(len(code) + len(n) + self.width, np.uint64)
        x[np.arange(len(code)) + np.repeat(np.arange(len(n)), n)] = own
        out, rest, size = x[: len(code) + len(n)].copy(), x, len(code) + len(n)
        alive = out != 0
        for j in range(1, self.width):
            rest = x[j : j + size]
            alive &= rest != 0
            out <<= np.uint64(self.bits)
            out |= rest * alive
        return out

    def strings(self, windows: np.ndarray) -> list[str]:
        shifts = np.arange(self.width - 1, -1, -1, dtype=np.uint64) * np.uint64(self.bits)
        own = (windows[:, None] >> shifts) & np.uint64((1 << self.bits) - 1)
        some = own > 0
        s = self.code[own[some].astype(np.int64)].tobytes().decode("utf-32-le", "surrogatepass")
        end = np.cumsum(some.sum(axis=1)).tolist()
        return [s[a:b] for a, b in zip([0, *end], end)]


def _counted(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(windows[windows > 0])
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[at], np.diff(np.append(at, len(s)))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    key, n = (np.concatenate(x) for x in zip(*parts))
    o = np.argsort(key, kind="stable")  # sorted stretches, merged
    key, n = key[o], n[o]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(n, at) if len(at) else n


def _spelled(t: str, width: int) -> list[str]:
    return [t[i : i + width] for i in range(len(t))]


def window_counts(df: DataFrame, author: str, text: str, width: int) -> DataFrame:
    """(author, gram, n): how often each window stands in the texts of each author, added up within the
    tasks before the shuffle. Null texts have none; a null author is one of its own."""
    kind = dict(df.dtypes)[author]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        alphabet = Alphabet(width)
        held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def passed_on() -> Iterator[pd.DataFrame]:
            for name, parts in held.items():
                key, n = _merged(parts)
                for lo in range(0, len(key), 100_000):
                    yield pd.DataFrame({"c": name, "gram": alphabet.strings(key[lo : lo + 100_000]), "n": n[lo : lo + 100_000]}).astype({"c": object})
            held.clear()

        def piece(names: list, texts: list[str]) -> Iterator[pd.DataFrame]:
            nonlocal size
            own, uniques = pd.factorize(np.array(names, object), use_na_sentinel=False)
            order = np.argsort(own, kind="stable")
            texts, own = [texts[i] for i in order], own[order]
            windows = alphabet.take(texts)
            if windows is None and len(alphabet.code) > 1:
                yield from passed_on()
                size = 0
                alphabet.clear()
                windows = alphabet.take(texts)
            if windows is None and len(texts) > 1:
                half = len(texts) // 2
                back = [None if pd.isna(uniques[i]) else uniques[i] for i in own]
                yield from piece(back[:half], texts[:half])
                yield from piece(back[half:], texts[half:])
                return
            if windows is None:
                grams = Counter(_spelled(texts[0], width))
                yield pd.DataFrame({"c": names, "gram": "", "n": 0}).iloc[[0] * len(grams)].assign(gram=list(grams), n=list(grams.values()))
                return
            ends = np.cumsum([len(t) + 1 for t in texts])
            cut = np.flatnonzero(np.diff(own)).tolist()
            for a, b, i in zip([0, *ends[cut]], [*ends[cut], len(windows)], [*own[cut], own[-1]]):
                part = _counted(windows[a:b])
                held.setdefault(None if pd.isna(uniques[i]) else uniques[i], []).append(part)
                size += len(part[0])
            if size > 2 * HELD:
                for name, parts in held.items():
                    held[name] = [_merged(parts)]
                size = sum(len(p[0][0]) for p in held.values())
                if size > HELD:
                    yield from passed_on()
                    size = 0

        for batch in batches:
            for lo in range(0, len(batch), 5000):
                part = batch.iloc[lo : lo + 5000]
                if len(part):
                    yield from piece(part["c"].tolist(), part["t"].tolist())
        yield from passed_on()

    rows = df.where(F.col(text).isNotNull()).select(F.col(author).cast("string").alias("c"), F.col(text).alias("t"))
    each = rows.mapInPandas(count, "c string, gram string, n long")
    return each.groupBy("c", "gram").agg(F.sum("n").alias("n")).select(F.col("c").cast(kind).alias(author), "gram", "n")


def context_counts(df: DataFrame, author: str, text: str, order: int) -> DataFrame:
    """(author, k, ctx, ch, n): how often each character stands under each context of k = 0 to `order`
    characters in the author's texts."""
    windows = window_counts(df, author, text, order + 1)
    begun = F.transform(F.sequence(F.lit(1), F.length("gram")), lambda k: F.substring(F.col("gram"), F.lit(1), k))
    each = windows.select(author, F.explode(begun).alias("g"), "n").groupBy(author, "g").agg(F.sum("n").alias("n"))
    k = F.length("g") - 1
    return each.select(author, k.alias("k"), F.substring(F.col("g"), F.lit(1), k).alias("ctx"), F.substring(F.col("g"), k + 1, F.lit(1)).alias("ch"), "n")


def context_sizes(df: DataFrame, author: str, text: str, order: int) -> DataFrame:
    """(c, k INT, n_entries, n): the distinct entries of each author's model by context length, and the
    characters counted in them. Texts and not entries are shuffled; an author's rows pass one task in
    batches, which holds the author's distinct windows. Null texts and authors don't count."""
    kind, width = dict(df.dtypes)[author], order + 1

    class Own:
        """What is known of one author."""

        def __init__(self, name: str):
            self.name, self.parts, self.new, self.total, self.spelled = name, [], 0, np.zeros(width, np.int64), None

        def add(self, alphabet: Alphabet, texts: list[str]) -> None:
            n = np.array([len(t) for t in texts], np.int64)
            self.total += [int(np.maximum(n - k, 0).sum()) for k in range(width)]
            windows = None if self.spelled is not None else alphabet.take(texts)
            if windows is None:
                if self.spelled is None:
                    self.spelled = {s for key in self.parts for s in alphabet.strings(key)}
                    self.parts = []
                self.spelled.update(s for t in texts for s in _spelled(t, width))
                return
            key = _counted(windows)[0]
            self.parts.append(key)
            self.new += len(key)
            if self.new > HELD:
                self.parts, self.new = [_counted(np.concatenate(self.parts))[0]], 0

        def rows(self, alphabet: Alphabet) -> list[tuple]:
            if self.spelled is not None:
                each = [len({s[: k + 1] for s in self.spelled if len(s) > k}) for k in range(width)]
            else:
                key = self.parts[0] if len(self.parts) == 1 else _counted(np.concatenate(self.parts))[0]
                each = []
                for k in range(width):
                    begun = key >> np.uint64(alphabet.bits * (width - 1 - k))
                    begun = begun[begun & np.uint64((1 << alphabet.bits) - 1) > 0]
                    each.append(int((begun[1:] != begun[:-1]).sum()) + 1 if len(begun) else 0)
            return [(self.name, k, e, int(self.total[k])) for k, e in enumerate(each) if e]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        alphabet, own = Alphabet(width), None
        for batch in batches:
            out: list[tuple] = []
            names, texts = batch["c"].to_numpy(object), batch["t"].tolist()
            cut = np.flatnonzero(names[1:] != names[:-1]) + 1 if len(names) else []
            for a, b in zip([0, *cut], [*cut, len(names)]):
                if a == b:
                    continue
                if own is None or own.name != names[a]:
                    if own is not None:
                        out += own.rows(alphabet)
                    if own is not None and (own.spelled is not None or len(alphabet.code) > 1 << (alphabet.bits - 1)):
                        alphabet.clear()
                    own = Own(names[a])
                own.add(alphabet, texts[a:b])
            if out:
                yield pd.DataFrame(out, columns=["c", "k", "n_entries", "n"])
        if own is not None:
            yield pd.DataFrame(own.rows(alphabet), columns=["c", "k", "n_entries", "n"])

    rows = df.where(F.col(text).isNotNull() & F.col(author).isNotNull()).select(F.col(author).cast("string").alias("c"), F.col(text).alias("t"))
    each = rows.repartition("c").sortWithinPartitions("c").mapInPandas(count, "c string, k int, n_entries long, n long")
    return each.select(F.col("c").cast(kind).alias("c"), "k", "n_entries", "n")
