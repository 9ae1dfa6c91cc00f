"""n-grams of many texts at once, in numpy. A text is cut into symbols (characters or words); a gram is a
run of n of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stilus.functions import text as t

#: Bytes of text looked at at once, in a task: memory and not results depend on it.
SLICE = 1 << 20
#: Distinct values are told by a table of as many places, beyond it by sorting.
TABLE = 1 << 24
CODES = 0x110000
#: What a kind of n-gram model reads: characters after `normal_base` or `distort`, or the `word_tokens`
#: after `only_words`, and what stands between a gram's symbols.
KINDS = {"char": "", "dist_char": "", "word": " "}

#: (texts' symbols as places in the alphabet, the text of each, the alphabet)
Symbols = tuple[np.ndarray, np.ndarray, list[str]]


def word_classes(spark: SparkSession) -> np.ndarray:
    """Of each code point whether `only_words` drops it (0), it stands in words (1) or between them (2), as
    Spark's own patterns have it."""
    blocks = [("".join(chr(c) for c in range(i, i + 256) if not 0xD800 <= c < 0xE000),) for i in range(0, CODES, 256)]
    kept = spark.createDataFrame(blocks, "b string").select(t.only_words(F.col("b")).alias("k")).select("k", F.regexp_replace("k", r"(?U)[^\w]", "").alias("w")).collect()  # 4,352 rows
    out = np.zeros(CODES, np.uint8)
    for i, value in (("k", 2), ("w", 1)):
        out[np.frombuffer("".join(r[i] for r in kept).encode("utf-32-le"), np.uint32)] = value
    return out


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Neighbouring texts of at most SLICE bytes in all, or one text."""
    upto, start = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while start < len(texts):
        most = (upto[start - 1] if start else 0) + SLICE
        stop = max(start + 1, int(np.searchsorted(upto, most, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def _normal(text: str) -> str:
    """`normal_base` but for its digits."""
    if " \n" in text or " \t" in text:
        text = re.sub("( \n| \t)+", "", text)
    return re.sub(r"https:\\+([a-zA-Z0-9.]+)?", "@", text) if "https:\\" in text else text


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts after `normal_base`, and the text of each; null texts are empty."""
    strings = [_normal(b.decode("utf-8", "replace")) if b else "" for b in texts.cast(pa.binary()).to_pylist()]
    codes = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
    return np.where(codes - 48 < 10, np.uint32(48), codes), np.repeat(np.arange(len(strings), dtype=np.int32), np.fromiter(map(len, strings), np.int64, len(strings)))


def _first(there: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where a run of a text's symbols that are `there` begins."""
    out = there.copy()
    out[1:] &= ~(there[:-1] & (doc[:-1] == doc[1:]))
    return out


def _characters(codes: np.ndarray, doc: np.ndarray) -> Symbols:
    table = np.zeros(CODES, np.int32)
    table[codes] = 1
    seen = np.flatnonzero(table)
    table[seen] = np.arange(len(seen))
    return table[codes], doc, [chr(c) for c in seen.tolist()]


def _distorted(codes: np.ndarray, doc: np.ndarray) -> Symbols:
    letter = (codes | 32) - 97 < 26
    kept = ~letter | _first(letter, doc)
    return _characters(np.where(letter, np.uint32(42), codes)[kept], doc[kept])


def _words(codes: np.ndarray, doc: np.ndarray, classes: np.ndarray) -> Symbols:
    of = classes[codes]
    kept = of > 0
    codes, doc, inside = codes[kept], doc[kept], of[kept] == 1
    begins = np.flatnonzero(_first(inside, doc)[inside])
    codes, doc = codes[inside], doc[inside]
    size = np.diff(begins, append=len(codes))
    codes, doc, size = codes[np.repeat(size > 1, size)], doc[begins[size > 1]], size[size > 1]
    places = np.zeros(len(codes) + 1, np.int32)
    np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), out=places[1:])
    ends = np.concatenate([[0], np.cumsum(size)])
    data = codes.tobytes().decode("utf-32-le").encode()
    words = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(places[ends]), pa.py_buffer(data)]).dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False), doc, words.dictionary.to_pylist()


def symbols(texts: pa.Array, kinds: list[str], classes: np.ndarray | None) -> list[Symbols]:
    """The texts' symbols for each kind. classes: `word_classes`, for words."""
    codes, doc = _codes(texts)
    return [_characters(codes, doc) if k == "char" else _distorted(codes, doc) if k == "dist_char" else _words(codes, doc, classes) for k in kinds]


def _numbered(values: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values from 0 to bound - 1 in their order, and each value's place among them."""
    if bound > TABLE:
        return np.unique(values, return_inverse=True)
    table = np.zeros(bound, np.int32)
    table[values] = 1
    distinct = np.flatnonzero(table)
    table[distinct] = np.arange(len(distinct))
    return distinct, table[values]


def _holding(code: np.ndarray, doc: np.ndarray, width: int, texts: int) -> np.ndarray:
    """How many texts hold each of `width` grams."""
    if texts * width <= 8 * len(code):
        held = np.zeros(texts * width, bool)
        held[doc.astype(np.int64) * width + code] = True
        return held.reshape(texts, width).sum(axis=0)
    held = doc.astype(np.int32 if texts * width < 2**31 else np.int64) * width + code
    held.sort()
    return np.bincount(held[np.flatnonzero(np.diff(held, prepend=-1))] % width, minlength=width)


def count(cut: Symbols, texts: int, low: int, high: int, joiner: str) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Of each n from low to high the grams, their occurrences and the texts that hold them."""
    ids, doc, alphabet = cut
    grams, code, at = alphabet, ids, np.arange(len(ids))  # `code` is the gram that begins at symbol `at`
    for n in range(1, high + 1):
        if n > 1:
            whole = at + n - 1 < len(ids)
            at, code = at[whole], code[whole]
            whole = doc[at] == doc[at + n - 1]
            at, code = at[whole], code[whole]
            distinct, code = _numbered(code.astype(np.int64) * len(alphabet) + ids[at + n - 1], len(grams) * len(alphabet))
            grams = [grams[i // len(alphabet)] + joiner + alphabet[i % len(alphabet)] for i in distinct.tolist()]
        if n >= low and grams:
            yield grams, np.bincount(code, minlength=len(grams)), _holding(code, doc[at], len(grams), texts)


class Vocabulary:
    """Grams by their places: a tree of their symbols, followed from each symbol of a text."""

    def __init__(self, grams: list[list[str]]):
        self.width, self.high = len(grams), max(map(len, grams), default=0)
        self.places = {s: i for i, s in enumerate(sorted({s for g in grams for s in g}), 1)}
        nodes: dict[tuple, int] = {(): 1}
        for g in grams:
            for k in range(1, len(g) + 1):
                nodes.setdefault(tuple(g[:k]), len(nodes) + 1)
        self.next = np.zeros((len(nodes) + 1, len(self.places) + 1), np.int32)  # node 0: no gram begins so; symbol 0: in no gram
        self.gram = np.full(len(nodes) + 1, -1, np.int64)
        for path, node in nodes.items():
            if path:
                self.next[nodes[path[:-1]], self.places[path[-1]]] = node
        for i, g in enumerate(grams):
            self.gram[nodes[tuple(g)]] = i

    def counts(self, cut: Symbols, texts: int) -> np.ndarray:
        """A row for each text, a column for each gram: how often it stands there."""
        ids, doc, alphabet = cut
        symbol = np.array([self.places.get(a, 0) for a in alphabet], np.int32)[ids]
        node, out = np.ones(len(ids), np.int32), np.zeros(texts * self.width, np.int64)
        for n in range(1, self.high + 1):
            m = max(0, len(ids) - n + 1)
            node = self.next[node[:m], symbol[n - 1 :]]
            gram = self.gram[node]
            hit = np.flatnonzero((gram >= 0) & (doc[:m] == doc[n - 1 :]))
            out += np.bincount(doc[hit].astype(np.int64) * self.width + gram[hit], minlength=len(out))
        return out.reshape(texts, self.width).astype(np.int32)


def counts(texts: pa.Array, kinds: list[str], vocabularies: list[Vocabulary], classes: np.ndarray | None) -> list[np.ndarray]:
    """For each kind and its vocabulary the texts' counts."""
    parts = [[v.counts(cut, len(part)) for cut, v in zip(symbols(part, kinds, classes), vocabularies)] for part in _slices(texts)]
    return [np.concatenate([np.zeros((0, v.width), np.int32), *(p[i] for p in parts)]) for i, v in enumerate(vocabularies)]


def gram_counts(df: DataFrame, text: str, kinds: list[str], low: int, high: int, classes: np.ndarray | None) -> DataFrame:
    """(kind, gram, n, n_docs): occurrences and texts of each kind's grams of `low` to `high` symbols."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch.column(0)):
                for k, cut in zip(kinds, symbols(part, kinds, classes)):
                    for grams, n, docs in count(cut, len(part), low, high, KINDS[k]):
                        yield pa.RecordBatch.from_arrays([pa.array([k] * len(grams)), pa.array(grams, pa.string()), pa.array(n), pa.array(docs)], ["kind", "gram", "n", "n_docs"])

    each = df.select(text).mapInArrow(partial, "kind string, gram string, n long, n_docs long")
    return each.groupBy("kind", "gram").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def weights(counts: np.ndarray, docs: np.ndarray, total: int) -> np.ndarray:
    """TF-IDF (1 + ln n) (ln((1 + total) / (1 + docs)) + 1), rows of length 1; a row without grams stays 0."""
    by_count = 1 + np.log(np.maximum(1, np.arange(counts.max(initial=0) + 1)))
    by_count[0] = 0
    x = by_count[counts] * (np.log((1.0 + total) / (1 + docs)) + 1)
    size = np.sqrt((x * x).sum(axis=1))
    return x / np.where(size > 0, size, 1.0)[:, None]


def packed(counts: np.ndarray) -> pa.Array:
    """Rows of counts as binary values."""
    n, width = counts.shape
    upto = np.arange(n + 1, dtype=np.int32) * (4 * width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(upto), pa.py_buffer(np.ascontiguousarray(counts, "<i4"))])


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), width)


def lists(x: np.ndarray) -> pa.Array:
    """Rows of doubles as arrays."""
    n, width = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(x.ravel()))
