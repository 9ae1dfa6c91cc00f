"""Held-out passages inside a training corpus (problem 8).

Each task builds suffix arrays over shards of its training documents, binary-searches every suffix
of the held-out items in them, and gets the longest verbatim matches with their places. A match of
SEED words starts an exact check of the passage's definition: at least MIN_WORDS successive words
of an item with at most one word in ten changed, added or left out. A passage of m words with m/10
edits falls into m/10 + 1 verbatim runs, the longest of at least SEED words for any m up to 56, and
a longer passage holds one of at most 56 words, so the seeds lose none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stilus.llm.lookalike import words_text
from stilus.session import spread

SEED, MIN_WORDS, EDITS_PER_WORD = 7, 28, 10
#: Words in one shard's suffix array at most, unless a single document is longer.
SHARD_WORDS = 2_000_000
#: Bytes of held-out text sent to every task at once; more are gone over in rounds.
ROUND_BYTES = 8 << 20
_MARKUP = re.compile(r"<[^<>]{0,300}>|&(?:[a-zA-Z]{2,8}|#\d{1,7});")


def words(text: str) -> list[str]:
    """Words without case, punctuation, markup, accents' encoding and look-alike characters."""
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    return words_text(text).split(" ")


class SuffixArray:
    """The suffixes of a word sequence that begin with `depth` words of the vocabulary, sorted.

    Words are ids from 1; 0 is any other word and matches nothing. Order is decided by the first
    `depth` words, packed by rank doubling, which is all that seeds need; longer matches are
    measured by comparing on.
    """

    def __init__(self, ids: np.ndarray, depth: int = SEED):
        self.ids, self.depth = ids, depth
        known = np.concatenate([[0], np.cumsum(ids == 0)])
        n = max(0, len(ids) - depth + 1)
        self.at = np.flatnonzero(known[depth : depth + n] == known[:n]) if n else np.zeros(0, np.int64)
        keys = [ids[self.at + k] for k in range(depth - 1, -1, -1)]
        self.at = self.at[np.lexsort(keys)] if len(self.at) else self.at

    def _less(self, rows: np.ndarray, query: np.ndarray, or_equal: bool) -> np.ndarray:
        state = np.zeros(len(rows), np.int8)  # -1 less, 0 equal so far, 1 greater
        for k in range(self.depth):
            x, y = self.ids[self.at[rows] + k], query[:, k]
            state = np.where(state == 0, np.sign(x.astype(np.int64) - y), state)
        return (state < 0) | ((state == 0) & or_equal)

    def ranges(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end row of the suffixes beginning with each row of `query` (n, depth)."""
        ends = []
        for or_equal in (False, True):
            lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(self.at), np.int64)
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                less = np.zeros(len(query), bool)
                less[open_] = self._less(mid[open_], query[open_], or_equal)
                lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
            ends.append(lo)
        return ends[0], ends[1]


def holds_passage(item: np.ndarray, doc: np.ndarray, min_words: int = MIN_WORDS, per: int = EDITS_PER_WORD) -> bool:
    """Whether some window of at least min_words words of `item` stands in `doc` with at most one
    edit per `per` words. reach[j]: the earliest start of a window ending at the current item word
    and at word j of doc with exactly e edits; all ends j are computed at once."""
    n, m, most = len(item), len(doc), (2 * min_words - 1) // per
    if n < min_words:
        return False
    far = n + 1
    last = np.full((most + 1, m + 1), far)
    last[0] = 0
    for i in range(1, n + 1):
        equal = doc == item[i - 1]
        now = np.full((most + 1, m + 1), far)
        now[0] = i
        now[0, 1:] = np.where(equal, np.minimum(last[0, :-1], i), i)
        for e in range(1, most + 1):
            row = np.minimum(last[e - 1], now[e])  # a word left out
            row[1:] = np.minimum(row[1:], np.minimum(last[e - 1, :-1], now[e - 1, :-1]))  # changed, added
            row[1:] = np.minimum(row[1:], np.where(equal, last[e, :-1], far))
            now[e] = row
        for e in range(most + 1):
            if i - now[e].min() >= max(min_words, per * e):
                return True
        last = now
    return False


class Items:
    """A round's held-out items as word ids. Its size is bounded by the caller."""

    def __init__(self, rows: list[tuple[int, str]], depth: int = SEED):
        self.vocabulary: dict[str, int] = {}
        self.item: list[np.ndarray] = []
        self.id: list[int] = []
        for i, text in rows:
            self.id.append(i)
            self.item.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.int32))
        starts = [(k, p) for k, x in enumerate(self.item) for p in range(len(x) - depth + 1)]
        self.owner = np.array([k for k, _ in starts], np.int64)
        self.place = np.array([p for _, p in starts], np.int64)
        self.query = np.array([self.item[k][p : p + depth] for k, p in starts], np.int32).reshape(-1, depth)

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text number, item number, longest verbatim match in words, its first word in the text)
        of every text that holds a passage of an item."""
        get, out = self.vocabulary.get, []
        shard, starts, size = [], [], 0
        for number, text in enumerate(texts):
            ids = [get(w, 0) for w in words(text)]
            shard.append(np.array([*ids, 0], np.int32))
            starts.append(number)
            size += len(ids) + 1
            if size >= SHARD_WORDS:
                out += self._shard(shard, starts)
                shard, starts, size = [], [], 0
        return out + (self._shard(shard, starts) if shard else [])

    def _likely(self, ids: np.ndarray, item: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Which (item, base) can hold a passage where the item's first word would stand at `base`.

        A least passage has up to 55 words and 5 edits, so all its words lie within 5 diagonals of
        any of its seeds. A word of the item that stands on none of these is an edit; no window of
        MIN_WORDS or more words with few enough of those, no passage.
        """
        shift = (2 * MIN_WORDS - 1) // EDITS_PER_WORD
        met, item = np.unique(item, return_inverse=True)  # only the items that the shard has seeds of
        width = max(len(self.item[k]) for k in met) if len(met) else MIN_WORDS
        padded = np.full((len(met), width), -1, np.int32)
        for k, x in enumerate(met):
            padded[k, : len(self.item[x])] = self.item[x]
        room = np.concatenate([np.zeros(width + shift, np.int32), ids, np.zeros(width + shift, np.int32)])
        near = np.arange(width + 2 * shift)
        out = np.zeros(len(item), bool)
        for lo in range(0, len(item), 4096):
            words_, at = padded[item[lo : lo + 4096]], base[lo : lo + 4096]
            window = room[(at + width)[:, None] + near]
            hit = np.zeros(words_.shape, bool)
            for s in range(2 * shift + 1):
                hit |= words_ == window[:, s : s + width]
            gain = np.zeros((len(at), width + 1), np.int32)
            np.cumsum(np.where(hit, 1, 1 - EDITS_PER_WORD), axis=1, out=gain[:, 1:])
            if width >= MIN_WORDS:
                least = np.minimum.accumulate(gain[:, :-MIN_WORDS], axis=1)
                out[lo : lo + 4096] = (gain[:, MIN_WORDS:] >= least).any(axis=1)
        return out

    def _shard(self, docs: list[np.ndarray], numbers: list[int]) -> list[tuple[int, int, int, int]]:
        array = SuffixArray(np.concatenate(docs))
        if not len(array.at) or not len(self.query):
            return []
        begin = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        lo, hi = array.ranges(self.query)
        counts = hi - lo
        which = np.repeat(np.arange(len(counts)), counts)
        at = array.at[lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)]
        if not len(at):
            return []
        item, base = self.owner[which], at - self.place[which]
        # successive seeds on one diagonal are one longer verbatim match
        order = np.lexsort((at, base, item))
        item, base, at = item[order], base[order], at[order]
        turn = (np.diff(item) != 0) | (np.diff(base) != 0)
        run = np.flatnonzero(np.concatenate([[True], turn | (np.diff(at) != 1)]))
        length = np.diff([*run, len(at)]) + SEED - 1
        item, base, at = item[run], base[run], at[run]
        fresh = np.flatnonzero(np.concatenate([[True], (np.diff(item) != 0) | (np.diff(base) != 0)]))
        likely = np.repeat(self._likely(array.ids, item[fresh], base[fresh]), np.diff([*fresh, len(item)]))
        doc = np.searchsorted(begin, at, "right") - 1
        pair = doc * len(self.item) + item
        by_pair = np.argsort(pair, kind="stable")
        found = []
        certain = set(np.unique(pair[length >= MIN_WORDS]).tolist())
        open_ = np.setdiff1d(pair[likely], list(certain))
        for p in [*sorted(certain), *open_.tolist()]:
            d, i = divmod(int(p), len(self.item))
            mine = by_pair[slice(*np.searchsorted(pair[by_pair], [p, p + 1]))]
            words_, text = self.item[i], docs[d]
            slack = len(words_) // EDITS_PER_WORD + 1
            ok = p in certain or any(
                holds_passage(words_, text[max(0, b - slack) : max(0, b) + len(words_) + slack]) for b in np.unique(base[mine[likely[mine]]]) - begin[d]
            )
            if ok:
                best = mine[np.argmax(length[mine])]
                found.append((numbers[d], i, int(length[best]), int(at[best] - begin[d])))
        return found


def find_leaks(corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(item_key, key, longest_match INT, word_offset INT): documents holding a passage of an item.

    One row per pair: the longest verbatim match in words and where it begins in the document. Items are
    sent whole to every task, in rounds of about round_bytes, however many they are; each round reads the
    corpus once, in place: nothing of it is shuffled but the pairs found. Suffix arrays are built over
    shards of up to SHARD_WORDS words, whatever the size of the batches that the texts come in.

    Null texts hold nothing; items under 28 words can't leak by this definition; repeated ids and
    rows give one row, with the longest of their matches. Extra columns are ignored.
    """
    spark = corpus.sparkSession
    held = items.where(F.col(item_text).isNotNull()).select(item_key, item_text).distinct()
    size = held.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    rounds = max(1, -(-size // round_bytes))
    docs = spread(corpus.select(F.col(key), F.col(text).alias("__t")).where(F.col("__t").isNotNull() & (F.char_length("__t") >= MIN_WORDS)))
    schema = f"`{item_key}` {dict(items.dtypes)[item_key]}, `{key}` {dict(corpus.dtypes)[key]}, longest_match int, word_offset int"

    def one_round(r: int) -> DataFrame:
        own = held.where(F.pmod(F.xxhash64(item_key, item_text), F.lit(rounds)) == r) if rounds > 1 else held
        sent = spark.sparkContext.broadcast(Items(sorted((x[0], x[1]) for x in own.collect())))  # about round_bytes

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, ids, texts, words_held = sent.value, [], [], 0

            def found() -> pd.DataFrame:
                out = [(own.id[i], ids[d], n, at) for d, i, n, at in own.matches(texts)]
                return pd.DataFrame(out, columns=[item_key, key, "longest_match", "word_offset"])

            for batch in batches:
                ids += batch[key].tolist()
                texts += batch["__t"].tolist()
                words_held += int(sum(map(len, batch["__t"]))) // 6  # a word takes about as many characters
                if words_held >= SHARD_WORDS:
                    yield found()
                    ids, texts, words_held = [], [], 0
            if texts:
                yield found()

        return docs.mapInPandas(search, schema)

    pairs = one_round(0)
    for r in range(1, rounds):
        pairs = pairs.unionByName(one_round(r))
    best = F.max(F.struct("longest_match", F.negate("word_offset").alias("at"))).alias("b")
    return pairs.groupBy(item_key, key).agg(best).select(item_key, key, F.col("b.longest_match").alias("longest_match"), F.negate("b.at").alias("word_offset"))


def without_leaks(corpus: DataFrame, key: str, leaks: DataFrame) -> DataFrame:
    """The rows of `corpus` whose key holds no passage; rows without a key stay."""
    return corpus.join(leaks.select(key).distinct(), key, "left_anti")
