"""The same or nearly the same records across splits (problem 1): a weighted cosine join.

A pair counts if at least 80 % of the words of the longer text stand in the other in the same order.
A text is a vector over words, a word weighing as often as it occurs, and a vector over its runs of
two words. From the condition alone follow, for two texts of m <= n words and L = 80 % of n:

- lengths: m >= L, which bounds the weight one text can add to the other;
- words: the dot product is at least L, so the norm of the difference is at most m + n - 2 L;
- runs: the L common words break at most m + n - 2 L times, so at least `shared_runs` runs of two
  stand in both at places that the common order pairs. Put the runs in one order, rare before common:
  once the rest of a text's runs is smaller than that number, the rest alone can't make a pair, so
  only the runs before it enter the inverted lists (the residual of the vector isn't indexed);
- places: paired words have moved by no more than the words that either text may lack.

Texts of the two sides that meet in a list pass these bounds in turn; the norm of the difference is
bounded from below by the differing bits of two parity sketches. Then come the exact dot product of
the words and the exact common order. No bound is a guess: no pair of the condition is lost,
whatever the counts, which touch the order of the runs and so the cost alone.

Copies of one text are one class throughout; ids come back only at the end.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stilus.llm.lookalike import words_text
from stilus.session import materialize, spread

MIN_WORDS = 10
#: Slots of the table of run counts, one byte each where it is sent to every task: a fixed size.
#: Runs that share a slot share a place in the order, which costs time and loses nothing.
SLOTS, BLOCK = 1 << 22, 1 << 16
#: Bytes of the inverted lists in one group of rows, and the count from which a run's list is split on
#: either side. A task's arrays and their sorts take about five times the bytes.
GROUP_BYTES, HOT = 80_000_000, 1 << 17
#: Bytes of an entry, and of its text's record where it stands; entries of a text.
ENTRY, RECORD, PER_TEXT = 8, 56, 24
#: Bits of a sketch, in words of 64.
SKETCH = 320
#: Class ids are sent to every task up to this many; beyond it they are joined by shuffle.
MAX_SENT = 1_000_000
#: Ids of a class expanded by one row of work at most.
EXPAND = 1000
#: Rows for each distinct text from which copies are told by digest before anything else is done.
REPEATED = 2
_ROWS, _CELLS = 1 << 13, 1 << 20


def least_common(n):
    """80 % of n words, rounded up."""
    return -(-4 * n // 5)


def shared_runs(n):
    """Runs of two words that a text of n words shares with any text it makes a pair with, at least:
    the smallest of 3 L - m - n - 1, found where the other text is as long or one word longer."""
    return np.minimum(3 * least_common(n) - 2 * n - 1, 3 * least_common(n + 1) - 2 * n - 2)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class _Codes(dict):
    """Word to a fixed number; equal numbers of different words can only add candidates."""

    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode("utf-8", "replace"))
        if len(self) < 1_000_000:
            self[word] = h
        return h


class Runs:
    """The runs of two words of a batch of texts. n: words of each text; per run its text `row`, its
    place `at` and its number `run`; words: the number of each word, `word_row` its text."""

    def __init__(self, texts: list[str], codes: _Codes):
        flat: list[int] = []
        lengths = []
        get = codes.__getitem__
        for t in texts:
            w = t.split(" ")
            flat += map(get, w)
            lengths.append(len(w))
        self.n = np.array(lengths, np.int64)
        self.words = _mixed(np.array(flat, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        self.word_row = np.repeat(np.arange(len(texts)), self.n)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        first = np.flatnonzero(at < self.n[self.word_row] - 1) if len(flat) else np.zeros(0, np.int64)
        self.row, self.at = self.word_row[first], at[first]
        self.run = _mixed(self.words[first] * np.uint64(0xBF58476D1CE4E5B9) + self.words[first + 1]) if len(first) else np.zeros(0, np.uint64)

    def slots(self) -> np.ndarray:
        return (self.run >> np.uint64(42)).astype(np.int64)

    def sketches(self) -> np.ndarray:
        """(texts, SKETCH / 64): which of SKETCH groups of words hold an odd number of the text's."""
        cell = self.word_row * SKETCH + (self.words % np.uint64(SKETCH)).astype(np.int64)
        odd = np.bincount(cell, minlength=len(self.n) * SKETCH).astype(np.uint8) & 1
        return np.packbits(odd.reshape(len(self.n), SKETCH), axis=1).view(np.uint64)

    def indexed(self, place: np.ndarray) -> np.ndarray:
        """Numbers of the runs that enter the lists, by text. place: per slot the runs' place in the
        order, 0 for runs of one side only, which come first and meet nothing."""
        order_of = place[self.slots()]
        key = (self.row.astype(np.uint64) << np.uint64(50)) | (order_of.astype(np.uint64) << np.uint64(42)) | (self.run >> np.uint64(22))
        order = np.argsort(key)
        row = self.row[order]
        runs = np.maximum(self.n - 1, 0)
        first = np.cumsum(runs) - runs
        last = np.maximum(runs - np.maximum(shared_runs(self.n), 1), 0)  # the last run before the residual
        key = key[order]
        # all of the last run's repetitions are taken, so that the paired one is among them
        end = key[np.minimum(first + last, len(key) - 1)]
        return order[(key <= end[row]) & (order_of[order] > 0)]


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(a.tobytes() for a in arrays)


class Postings:
    """A part of the inverted lists: texts (class, words, side, sketch) and entries (run, text, place)."""

    def __init__(self, own, n, left, sketch, run, text, at):
        self.own, self.n, self.left, self.sketch, self.run, self.text, self.at = own, n, left, sketch, run, text, at
        self.common = least_common(n)

    def to_bytes(self) -> bytes:
        size = np.array([len(self.own), len(self.run)], np.int64)
        per = np.bincount(self.text, minlength=len(self.own)).astype(np.uint32)  # entries are by text
        at = self.at.astype(np.uint32)
        return _pack(size, self.own, (self.n * 2 + self.left).astype(np.uint32), self.sketch, per, self.run, at.astype(np.uint16), (at >> np.uint32(16)).astype(np.uint16))

    @staticmethod
    def of(blobs: list[bytes]) -> Postings:
        parts: list[list[np.ndarray]] = [[] for _ in range(6)]
        begin = 0
        for b in blobs:
            texts, entries = np.frombuffer(b, np.int64, 2)
            at = 16
            own = []
            for kind, count in ((np.int64, texts), (np.uint32, texts), (np.uint64, texts * SKETCH // 64), (np.uint32, texts), (np.uint32, entries), (np.uint16, entries), (np.uint16, entries)):
                own.append(np.frombuffer(b, kind, int(count), at))
                at += int(count) * np.dtype(kind).itemsize
            parts[0].append(own[0])
            parts[1].append(own[1])
            parts[2].append(own[2].reshape(-1, SKETCH // 64))
            parts[3].append(own[4])
            parts[4].append(np.repeat(np.arange(begin, begin + texts, dtype=np.int32), own[3]))
            parts[5].append(own[5] | own[6].astype(np.uint32) << np.uint32(16))
            begin += int(texts)
        own, meta, sketch, run, text, at = (np.concatenate(p) for p in parts)
        return Postings(own, (meta >> np.uint32(1)).astype(np.int32), (meta & np.uint32(1)).astype(bool), sketch, run, text, at.astype(np.int32))

    def one_per_class(self) -> Postings:
        """Of the copies of a text on a side, one takes part; its class id stays."""
        order = np.lexsort((self.own, self.left))
        new = np.concatenate([[True], (np.diff(self.own[order]) != 0) | (np.diff(self.left[order]) != 0)])
        keep = np.zeros(len(self.own), bool)
        keep[order[new]] = True
        inside = keep[self.text]
        return Postings(self.own, self.n, self.left, self.sketch, self.run[inside], self.text[inside], self.at[inside])


def _close(p: Postings, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) of texts whose words can be near enough, by length and whole sketch."""
    differ = np.zeros(len(a), np.int32)
    for k in range(p.sketch.shape[1]):
        word = p.sketch[:, k]
        differ = differ + np.bitwise_count(word[a] ^ word[b])
        keep = np.flatnonzero(differ <= p.n[a] + p.n[b] - 2 * p.common[np.where(p.n[a] > p.n[b], a, b)])
        a, b, differ = a[keep], b[keep], differ[keep]
    keep = np.flatnonzero((np.minimum(p.n[a], p.n[b]) >= np.maximum(p.common[a], p.common[b])) & (p.own[a] != p.own[b]))
    return a[keep], b[keep]


def meetings(p: Postings) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left text, right text) that meet in a list and pass the bounds, each once."""
    found: list[np.ndarray] = []

    def take(a: np.ndarray, b: np.ndarray) -> None:
        a, b = _close(p, a, b)
        if len(a):
            found.append(np.unique(a.astype(np.int64) << 32 | b))

    side = p.left[p.text]
    lists = []
    for own in (side, ~side):
        i = np.flatnonzero(own)
        key = p.run[i].astype(np.uint64) << np.uint64(31) | p.n[p.text[i]].astype(np.uint64)
        order = np.argsort(key)
        lists.append((key[order], p.text[i[order]], p.at[i[order]]))
    (lkey, ltext, lat), (rkey, rtext, rat) = lists
    if not len(lkey) or not len(rkey):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = p.n[ltext].astype(np.int64)
    base = lkey >> np.uint64(31) << np.uint64(31)
    lo = np.searchsorted(rkey, base | least_common(n).astype(np.uint64))
    hi = np.searchsorted(rkey, base | (5 * n // 4).astype(np.uint64), "right")
    # what the places allow: -(n_a - L) <= place_b - place_a <= n_b - L
    nl, nr = p.n[ltext], p.n[rtext]
    cl, cr = least_common(nl), least_common(nr)
    kind = np.int16 if int(p.n.max(initial=0)) < 1 << 13 else np.int32
    cl_, cr_, la, ra, lb, rb, nl_, nr_ = (x.astype(kind) for x in (cl, cr, lat - nl, rat - nr, lat, rat, nl, nr))
    sl, sr = ([np.ascontiguousarray(p.sketch[t, k]) for k in range(SKETCH // 64)] for t in (ltext, rtext))
    telling = np.clip(-(-nl // 24), 2, SKETCH // 64)

    # lists where many meet: blocks of one side against the stretch of the other of near length
    starts = np.flatnonzero(np.concatenate([[True], base[1:] != base[:-1]]))
    ends = np.append(starts[1:], len(base))
    total = np.add.reduceat(hi - lo, starts)
    dense = (total >= 4096) & (total >= 16 * (ends - starts))
    flat = np.ones(len(base), bool)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for s, e in zip(starts[dense].tolist(), ends[dense].tolist()):
        flat[s:e] = False
        for x in range(s, e, 64):
            y = min(x + 64, e)
            begin, stop = int(lo[x]), int(hi[y - 1])
            for u in range(begin, stop, _CELLS // 64):
                v = min(u + _CELLS // 64, stop)
                least = np.maximum(cl_[x:y, None], cr_[None, u:v])
                # rb - rn + L <= lb and lb - ln + L <= rb
                ok = (least + ra[None, u:v]) <= lb[x:y, None]
                ok &= (least + la[x:y, None]) <= rb[None, u:v]
                differ = np.bitwise_count(sl[0][x:y, None] ^ sr[0][None, u:v]).astype(kind)
                for k in range(1, telling[y - 1]):  # longer texts are told apart by more of the sketch
                    differ += np.bitwise_count(sl[k][x:y, None] ^ sr[k][None, u:v])
                least += least
                ok &= differ + least <= nl_[x:y, None] + nr_[None, u:v]
                hit = np.flatnonzero(ok)
                if len(hit):
                    i, j = np.divmod(hit, v - u)
                    waiting.append((ltext[x + i], rtext[u + j]))
                    held += len(hit)
            if held > _CELLS:
                take(*(np.concatenate(z) for z in zip(*waiting)))
                waiting, held = [], 0
    if waiting:
        take(*(np.concatenate(z) for z in zip(*waiting)))
    # the others: every entry against its own stretch
    one = np.flatnonzero(flat & (hi > lo))
    count = (hi - lo)[one]
    step = np.cumsum(count)
    cuts = np.searchsorted(step, np.arange(_CELLS, int(step[-1]) + _CELLS, _CELLS)) if len(step) else []
    begin = 0
    for c in cuts:
        i, k = one[begin : c + 1], count[begin : c + 1]
        begin = c + 1
        if not len(i):
            continue
        a = np.repeat(i, k)
        b = np.repeat(lo[i] - (np.cumsum(k) - k), k) + np.arange(len(a))
        least = np.maximum(cl_[a], cr_[b])
        ok = np.flatnonzero(((least + ra[b]) <= lb[a]) & ((least + la[a]) <= rb[b]))
        a, b, least = a[ok], b[ok], least[ok]
        most = nl_[a] + nr_[b] - 2 * least
        differ = np.zeros(len(a), kind)
        for x, y in zip(sl, sr):
            differ += np.bitwise_count(x[a] ^ y[b])
            ok = np.flatnonzero(differ <= most)
            a, b, differ, most = a[ok], b[ok], differ[ok], most[ok]
        take(ltext[a], rtext[b])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> 32, pairs & 0xFFFFFFFF


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two word lists, a bit per word of `a`."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = state = (1 << len(a)) - 1
    for w in b:
        hit = state & at.get(w, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def mostly_same(a: str, b: str, share: float = 0.8) -> bool:
    """At least `share` of the words of the longer text stand in the other in the same order."""
    x, y = a.split(" "), b.split(" ")
    least = share * max(len(x), len(y))
    if min(len(x), len(y)) < least:
        return False
    counts = Counter(x)
    if sum(min(k, counts[w]) for w, k in Counter(y).items() if w in counts) < least:  # the dot product
        return False
    return common_words(x, y) >= least


def classes(records: DataFrame, key: str, text: str, is_left, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(rows, counts), written: rows (id, is_left, class, words) of the records of at least min_words
    words, where equal words are an equal class; and partial counts (block, blob) of these rows' runs
    on the two sides, taken while the texts are at hand."""
    rows = spread(records.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.coalesce(is_left, F.lit(False)).alias("is_left"), F.col(text).alias("words")))

    def normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, counts = _Codes(), None
        for batch in batches:
            batch["words"] = [words_text(t) for t in batch["words"]]
            batch = batch[[w.count(" ") >= min_words - 1 for w in batch["words"]]].reset_index(drop=True)
            if not len(batch):
                continue
            counts = np.zeros((2, SLOTS), np.uint32) if counts is None else counts
            left = batch["is_left"].to_numpy(bool)
            for lo in range(0, len(batch), _ROWS):
                runs = Runs(batch["words"].iloc[lo : lo + _ROWS].tolist(), codes)
                slot, own = runs.slots(), left[lo : lo + _ROWS][runs.row]
                for side in (0, 1):
                    s = slot[own == side]
                    if len(s) > SLOTS // 8:
                        counts[side] += np.bincount(s, minlength=SLOTS).astype(np.uint32)
                    else:
                        np.add.at(counts[side], s, np.uint32(1))
            yield batch.assign(block=-1, blob=None)
        if counts is not None:
            small = np.minimum(counts, 0xFFFF).astype(np.uint16).reshape(2, -1, BLOCK).transpose(1, 0, 2)
            for block in np.flatnonzero(small.any(axis=(1, 2))):
                yield pd.DataFrame({"id": [None], "is_left": [None], "words": [None], "block": [int(block)], "blob": [zlib.compress(small[block].tobytes(), 1)]})

    schema = f"id {dict(rows.dtypes)['id']}, is_left boolean, words string, block int, blob binary"
    both = materialize(rows.mapInPandas(normal, schema).withColumn("class", F.xxhash64("words")), "classes")
    return both.where("block < 0").select("id", "is_left", "class", "words"), both.where("block >= 0").select("block", "blob")


def _step(n: np.ndarray) -> np.ndarray:
    """A byte that grows with the count; 0 for none."""
    return np.where(n > 0, np.minimum(1 + 8 * np.log2(np.maximum(n, 1)), 255), 0).astype(np.uint8)


def _places(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(per slot the place of its runs in the order, per side and slot the parts their lists are cut into,
    all runs). A place is a byte, growing with the count; 0 for runs found on one side only. A slot that
    isn't hot on a side is one part there."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((2, BLOCK), np.int64)
        for b in group["blob"]:
            total += np.frombuffer(zlib.decompress(b), np.uint16).reshape(2, BLOCK)
        place = np.where(total.min(axis=0) > 0, _step(total.sum(axis=0)), 0)
        parts = np.where(total.min(axis=0) > 0, -(-total // hot), 1).clip(1, 0xFFFF)
        packed = [zlib.compress(x.tobytes(), 1) for x in (place.astype(np.uint8), parts.astype(np.uint16))]
        return pd.DataFrame({"block": group["block"].iloc[:1], "place": packed[:1], "parts": packed[1:], "n": [int(total.sum())]})

    hot = HOT
    rows = counts.groupBy("block").applyInPandas(add, "block int, place binary, parts binary, n long").collect()
    out = np.zeros((SLOTS // BLOCK, BLOCK), np.uint8)
    parts = np.ones((2, SLOTS // BLOCK, BLOCK), np.uint16)
    for r in rows:
        out[r["block"]] = np.frombuffer(zlib.decompress(r["place"]), np.uint8)
        parts[:, r["block"]] = np.frombuffer(zlib.decompress(r["parts"]), np.uint16).reshape(2, BLOCK)
    return out.ravel(), parts.reshape(2, SLOTS), sum(r["n"] for r in rows)


def dealt(text: np.ndarray, run: np.ndarray, own: np.ndarray, left: np.ndarray, parts: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, group) of every entry in each group that it goes to. text, run: of the entries; own, left: of
    the texts; parts: per entry the parts of its run's list on the (right, left) side.

    The lists of a hot run make a grid of left parts by right parts: a left entry goes to its own part
    beside every right part and a right entry likewise, so that each pair of entries meets in one cell."""
    base = ((run >> np.uint64(20)) % np.uint64(groups)).astype(np.int64)
    right_parts, left_parts = parts.astype(np.int64)
    one = left[text]
    again = np.where(one, right_parts, left_parts)
    entry = np.repeat(np.arange(len(text)), again)
    other = np.arange(len(entry)) - np.repeat(np.cumsum(again) - again, again)
    one, wide, mine = one[entry], right_parts[entry], own[text[entry]]
    cell = np.where(one, mine % left_parts[entry] * wide + other, other * wide + mine % wide)
    group = (base[entry] + cell) % groups
    if len(entry) and int((right_parts * left_parts).max()) > groups:  # cells share groups: each entry once
        entry, group = np.divmod(np.unique(entry * groups + group), groups)
    return entry, group


def _group_count(spark, runs: int) -> int:
    """Groups of the inverted lists: as many as their size asks for, of which about six runs in ten
    make up; of a small input as many as run side by side.

    A group holds a record of each text that has an entry in it: with a few groups a text's entries share
    one, with many each entry has its own."""
    entries, groups = runs * 6 // 10, max(1, min(spark.sparkContext.defaultParallelism, runs // 250_000))
    while True:
        records = groups * (1 - (1 - 1 / groups) ** PER_TEXT) / PER_TEXT
        need = int(-(-entries * (ENTRY + RECORD * records) // GROUP_BYTES))
        if need <= groups:
            return groups
        groups = need


def _labels(spark, groups: int) -> np.ndarray:
    """A number for each group such that a few groups fall into as many partitions of a shuffle."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if groups > 4 * parts:
        return np.arange(groups)
    rows = spark.range(40 * max(groups, parts)).select(F.col("id").cast("int").alias("g"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("p")).collect()
    by: list[list[int]] = [[] for _ in range(parts)]
    for g, part in rows:
        by[part].append(g)
    spare = iter(range(1 << 30, 1 << 31))
    return np.array([by[i % parts].pop() if by[i % parts] else next(spare) for i in range(groups)])


def candidates(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(left, right): pairs of different classes of the two sides that no bound excludes."""
    spark = rows.sparkSession
    place, parts, total = _places(counts)
    groups = _group_count(spark, total)
    labels = _labels(spark, groups)
    # few slots are hot: their numbers and parts, behind one that none has
    hot = np.flatnonzero(parts.max(axis=0) > 1)
    sent = spark.sparkContext.broadcast((place, np.append(hot, SLOTS), np.concatenate([parts[:, hot], [[1], [1]]], axis=1)))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, seen = _Codes(), set()
        place, hot, parts = sent.value
        for batch in batches:
            fresh = []
            for c in zip(batch["class"].tolist(), batch["is_left"].tolist()):
                fresh.append(c not in seen)
                if len(seen) < 2_000_000:
                    seen.add(c)
            batch = batch[fresh]
            for lo in range(0, len(batch), _ROWS):
                part = batch.iloc[lo : lo + _ROWS]
                runs = Runs(part["words"].tolist(), codes)
                pick = runs.indexed(place)
                own, left = part["class"].to_numpy(np.int64), part["is_left"].to_numpy(bool)
                text, run, at = runs.row[pick], runs.run[pick], runs.at[pick]
                slot = (run >> np.uint64(42)).astype(np.int64)
                i = np.searchsorted(hot, slot)
                entry, group = dealt(text, run, own, left, parts[:, np.where(hot[i] == slot, i, len(hot) - 1)], groups)
                text, run, at = text[entry], run[entry], at[entry]
                order = np.lexsort((text, group))
                text, run, at, group = text[order], run[order].astype(np.uint32), at[order], group[order]
                sketch = runs.sketches()
                cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
                out = []
                for x, y in zip(cuts, [*cuts[1:], len(group)]):
                    inside, local = np.unique(text[x:y], return_inverse=True)
                    out.append((int(labels[group[x]]), Postings(own[inside], runs.n[inside], left[inside], sketch[inside], run[x:y], local, at[x:y]).to_bytes()))
                if out:
                    yield pd.DataFrame(out, columns=["g", "blob"])

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        p = Postings.of(group["blob"].tolist()).one_per_class()
        a, b = meetings(p)
        return pd.DataFrame({"left": p.own[a], "right": p.own[b]})

    lists = rows.select("class", "is_left", "words").mapInPandas(index, "g int, blob binary")
    return lists.groupBy("g").applyInPandas(meet, "left long, right long").distinct()


def near_pairs(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(left, right): all pairs of different classes of the two sides that are mostly the same.
    rows, counts: as from `classes`."""
    met = materialize(candidates(rows, counts), "candidates")
    # the words of each class once, then both sides of each candidate
    needed = met.select(F.explode(F.array("left", "right")).alias("class")).distinct()
    if met.count() <= MAX_SENT:
        needed = F.broadcast(needed)
    texts = rows.select("class", "words").join(needed, "class", "left_semi").groupBy("class").agg(F.first("words").alias("words"))
    both = met.join(texts.withColumnsRenamed({"class": "left", "words": "a"}), "left").join(texts.withColumnsRenamed({"class": "right", "words": "b"}), "right")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = np.fromiter((mostly_same(x, y) for x, y in zip(batch["a"], batch["b"])), bool, len(batch))
            yield batch.loc[keep, ["left", "right"]]

    return both.select("left", "right", "a", "b").mapInPandas(verify, "left long, right long")


def _repeated(records: DataFrame, text: str) -> bool:
    """Whether the texts as stored recur so often that a shuffle of them pays: it costs about the input on
    disk, the inverted lists twice that for texts that don't recur. Either way gives the same pairs."""
    n = records.where(F.col(text).isNotNull()).agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(text))).first()
    return n[0] >= REPEATED * max(1, n[1])


def cross_split_classes(records: DataFrame, key: str, text: str, is_left) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, is_left, class) of every record long enough, and links
    (left, right) between classes of the two sides, a class linked to itself where it has
    members on both. Copies aren't expanded; join members to either end for pairs of ids.

    Null texts and texts under MIN_WORDS words have no row; a null split counts as the right side;
    ties and repeated rows fall into one class; an empty table gives two empty results.
    """
    if not _repeated(records, text):
        rows, counts = classes(records, key, text, is_left)
        members = rows.select("id", "is_left", "class").distinct()
    else:
        # each stored text once for each side is put into words, counted and indexed; the ids follow by digest
        each = records.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.coalesce(is_left, F.lit(False)).alias("is_left"), F.unhex(F.md5(text)).alias("digest"), F.col(text).alias("text"))
        once = each.groupBy("digest").agg(F.first("text").alias("text"), F.collect_set("is_left").alias("sides"))
        once = materialize(once.select("digest", "text", F.explode("sides").alias("is_left")), "texts")
        rows, counts = classes(once, "digest", "text", F.col("is_left"))
        own = rows.select(F.col("id").alias("digest"), "is_left", "class")
        members = materialize(each.drop("text").join(own, ["digest", "is_left"]).select("id", "is_left", "class").distinct(), "members")
    shared = rows.groupBy("class").agg(F.max("is_left").alias("l"), F.min("is_left").alias("r")).where("l AND NOT r")
    same = shared.select(F.col("class").alias("left"), F.col("class").alias("right"))
    return members, materialize(near_pairs(rows, counts).unionByName(same), "links")


def linked_ids(members: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of ids (the smaller first) of every link, one row per pair.

    A class's ids are cut into sets of about EXPAND, and a link into one row of work per two sets,
    so that a stock text with many copies on both sides is expanded by many tasks."""
    size = members.groupBy("class", "is_left").agg(F.count(F.lit(1)).alias("n")).withColumn("sets", F.ceil(F.col("n") / EXPAND).cast("int")).where("sets > 1").drop("n")
    cut = members.join(size, ["class", "is_left"], "left").withColumn("set", F.when(F.col("sets").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("sets"))).cast("int"))
    sets = cut.groupBy("class", "is_left", "set").agg(F.collect_list("id").alias("ids"))
    left = sets.where("is_left").select(F.col("class").alias("left"), F.col("set").alias("ls"), F.col("ids").alias("xs"))
    right = sets.where("NOT is_left").select(F.col("class").alias("right"), F.col("set").alias("rs"), F.col("ids").alias("ys"))

    def with_sets(df: DataFrame, side: str, is_left: str, name: str) -> DataFrame:
        many = size.where(is_left).select(F.col("class").alias(side), "sets")
        every = F.sequence(F.lit(0), F.coalesce("sets", F.lit(1)) - 1)
        return df.join(many, side, "left").withColumn(name, F.explode(every)).drop("sets")

    work = with_sets(with_sets(links.select("left", "right"), "left", "is_left", "ls"), "right", "NOT is_left", "rs")
    work = work.join(left, ["left", "ls"]).join(right, ["right", "rs"]).repartition("left", "ls", "right", "rs")
    pairs = work.select(F.explode("xs").alias("x"), "ys").select("x", F.explode("ys").alias("y")).where("x <> y")
    return pairs.select(F.least("x", "y").alias(a), F.greatest("x", "y").alias(b)).distinct()
