"""Mixing sources to target weights (problem 9).

A source's quota of tokens is met by whole passes over its texts and a last partial pass over a random
part of them. Every use of a text is dealt by hash into one of its source's blocks, whose number follows
the quota, so that blocks keep their size at any size of the corpus; the hash is the blocks'
permutation. A splitting tree divides the blocks of each source among groups of output shards, and
within a group among its shards: each node halves its shards and draws from the multivariate
hypergeometric law how many of its blocks of each source go left. So every shard is an exact random
sample of the mixture. Shards take disjoint ranges of each source's blocks and are shuffled locally.

The driver holds sums per source and 4096 hash bins, and one row of the tree per group of shards; the
rest of the tree is drawn where the group's texts lie.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stilus.session import materialize, spread

BLOCK_TOKENS, SHARD_TOKENS = 20_000, 1_000_000
#: Shards of one group at most, where there are more than GROUPS of them.
GROUP_SHARDS, GROUPS, BINS = 256, 1024, 4096
#: Where the public tokenizers' vocabulary files lie, unless a path is given; where that folder is
#: missing, the installed module `public_tokenizers` is asked.
TOKENIZERS = "/opt/tokenizers"
#: Word pieces of the byte-level vocabulary (the public pattern of that vocabulary).
VOCABULARY = "byte_bpe_50k.tiktoken"


#: Fixed value: the pattern by which that vocabulary's tokenizer parts a text before merging bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer(path: str | None = None):
    """A tiktoken encoding from a vocabulary file of the public tokenizers that the executors have."""
    import tiktoken

    path = path or f"{TOKENIZERS}/{VOCABULARY}"
    if not os.path.exists(path):
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized_texts(docs: DataFrame, key: str, text: str, source: str, path: str | None = None) -> DataFrame:
    """(doc, source, copies, n_tokens): each distinct text once, under its smallest id and that row's
    source, with the number of rows that hold it. Null and blank texts have no row."""
    rows = docs.where(F.col(text).isNotNull() & (F.trim(text) != "") & F.col(source).isNotNull())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokenizer(path)
        for batch in batches:
            batch["n_tokens"] = [len(t) for t in enc.encode_ordinary_batch(batch["t"].tolist(), num_threads=1)]
            yield batch[["doc", "source", "d", "n_tokens"]]

    slim = rows.select(F.col(key).cast("long").alias("doc"), F.col(source).alias("source"), F.unhex(F.sha2(F.col(text), 256)).alias("d"), F.col(text).alias("t"))
    each = spread(slim).mapInPandas(count, "doc long, source string, d binary, n_tokens long")
    return each.groupBy("d").agg(F.min(F.struct("doc", "source")).alias("s"), F.count(F.lit(1)).alias("copies"), F.max("n_tokens").alias("n_tokens")).select("s.doc", "s.source", "copies", "n_tokens")


def quotas(supply: dict[str, int], share: dict[str, float], repeats: dict[str, int], total: int) -> dict[str, float]:
    """Tokens to take of each source: its share of `total`, at most supply x repeats; what a short
    source can't give goes to the others in proportion to their shares, while any has room."""
    out = {s: 0.0 for s in share}
    open_ = {s for s in share if share[s] > 0 and supply.get(s, 0) > 0}
    left = float(total)
    while open_ and left > 1e-9:
        weight = sum(share[s] for s in open_)
        full = {s for s in open_ if left * share[s] / weight >= supply[s] * repeats[s]}
        if not full:
            for s in open_:
                out[s] = left * share[s] / weight
            break
        for s in full:
            out[s] = float(supply[s] * repeats[s])
            left -= out[s]
        open_ -= full
    return out


def splitting_tree(counts: np.ndarray, shards: int | np.ndarray, seed: int | tuple[int, ...] = 17) -> np.ndarray:
    """(leaves, sources): how many of counts[s] blocks of each source each leaf gets. shards: the number
    of leaves, or for each leaf the shards it stands for. Columns add up to counts; leaf sizes differ
    from their share by at most the rounding of the halvings."""
    g = np.random.default_rng(seed)
    weight = np.cumsum(np.concatenate([[0], np.ones(shards, np.int64) if np.isscalar(shards) else np.asarray(shards, np.int64)]))
    leaves = len(weight) - 1
    out = np.zeros((leaves, len(counts)), np.int64)
    stack = [(0, leaves, np.asarray(counts, np.int64))]
    while stack:
        lo, hi, have = stack.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        size = int(have.sum())
        go = int(round(size * (int(weight[mid]) - int(weight[lo])) / (int(weight[hi]) - int(weight[lo]))))
        left = g.multivariate_hypergeometric(have, go, method="marginals") if size else have
        stack += [(lo, mid, left), (mid, hi, have - left)]
    return out


def group_sizes(shards: int) -> np.ndarray:
    """Shards of each group: one each up to GROUPS groups, beyond that about as many in each."""
    groups = min(shards, max(GROUPS, -(-shards // GROUP_SHARDS)))
    return np.full(groups, shards // groups, np.int64) + (np.arange(groups) < shards % groups)


def shard_of(blocks: dict[str, np.ndarray], counts: np.ndarray, sources: list[str], shards: int, seed: int, group: int) -> dict[str, np.ndarray]:
    """For each source the shard, from 0 within the group, of each of its blocks, numbered from 0."""
    cut = np.cumsum(splitting_tree(counts, shards, (seed, group)), axis=0)
    return {s: np.searchsorted(cut[:, j], blocks[s], "right") for j, s in enumerate(sources) if s in blocks}


def _last_pass(sized: DataFrame, part: dict[str, float], seed: int) -> DataFrame:
    """The rows of each source's partial pass: texts in random order up to `part` tokens, to within half
    a text. The order's hash is cut into BINS bins and the bin of the cut into as many again; only the
    texts of the last cell, a BINS x BINS-th of a source, are put in order."""
    spark = sized.sparkSession
    h = sized.withColumn("__h", F.xxhash64("doc", F.lit(seed + 1))).withColumn("__1", F.shiftrightunsigned("__h", 52).cast("int")).withColumn("__2", F.shiftrightunsigned("__h", 40).bitwiseAND(BINS - 1).cast("int"))

    def cut_of(df: DataFrame, column: str, left: dict[str, float]) -> dict[str, tuple[int, float]]:
        sums = df.groupBy("source", column).agg(F.sum("n_tokens").alias("t")).toArrow().to_pandas()  # at most BINS per source
        out = {}
        for s, own in sums[sums["source"].isin(list(left))].groupby("source"):
            own = own.sort_values(column)
            before = own["t"].cumsum() - own["t"]
            at = int(np.searchsorted((before + own["t"]).to_numpy(), left[s]))
            at = min(at, len(own) - 1)
            out[s] = (int(own[column].iloc[at]), float(left[s] - before.iloc[at]))
        return out

    def frame(cuts: dict[str, tuple[int, float]], name: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame([(s, c, r) for s, (c, r) in cuts.items()] or [("", -1, 0.0)], f"source string, __c{name} int, __r{name} double"))  # a row per source

    if not part:
        return sized.limit(0)
    first = cut_of(h, "__1", part)
    h = h.join(frame(first, "1"), "source")
    inside = h.where("__1 = __c1")
    second = cut_of(inside, "__2", {s: r for s, (_, r) in first.items()})
    cell = inside.join(frame(second, "2"), "source")
    run = Window.partitionBy("source").orderBy("__h", "doc").rowsBetween(Window.unboundedPreceding, 0)
    edge = cell.where("__2 = __c2").withColumn("__at", F.sum("n_tokens").over(run)).where("__at - n_tokens / 2.0 <= __r2")
    out = h.where("__1 < __c1").select(*sized.columns)
    return out.unionByName(cell.where("__2 < __c2").select(*sized.columns)).unionByName(edge.select(*sized.columns))


def mix(docs: DataFrame, targets: DataFrame, key: str, text: str, source: str, path: str | None = None, seed: int = 17, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    mixture: shard INT, position BIGINT from 1 in a shard, doc BIGINT, source, copy INT, n_tokens
    BIGINT: one row per use of a text. report: source, target_share, wanted_tokens, supply_tokens,
    max_repeats, actual_tokens, actual_share.

    The mixture has the tokens of all rows with text, to within a text per source, unless all sources
    together can't give that. max_repeats null or below 1 counts as 1. Sources without a target are
    left out, targets without documents get nothing; a text held by several sources belongs to the
    one of its smallest id. Targets must be few: one row per source.
    """
    spark = docs.sparkSession
    sized = materialize(sized_texts(docs, key, text, source, path), "sized")
    want = {r[0]: (float(r[1] or 0), max(1, int(r[2] or 1))) for r in targets.where(F.col(source).isNotNull()).select(source, "target_share", "max_repeats").collect()}
    sums = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("copies")).alias("whole")).collect()
    total, supply = sum(r["whole"] for r in sums), {r["source"]: int(r["tokens"]) for r in sums}
    share, repeats = {s: v[0] for s, v in want.items()}, {s: v[1] for s, v in want.items()}
    quota = {s: q for s, q in quotas(supply, share, repeats, total).items() if q > 0.5}
    full = {s: min(repeats[s], int(q // supply[s])) for s, q in quota.items()}
    part = {s: q - full[s] * supply[s] for s, q in quota.items() if full[s] < repeats[s] and q - full[s] * supply[s] > 0.5}

    passes = spark.createDataFrame([(s, n) for s, n in full.items() if n] or [("", 0)], "source string, passes int")
    whole = sized.join(F.broadcast(passes), "source").select("doc", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.greatest("passes", F.lit(1)))).alias("copy"))  # a row per source
    upto = spark.createDataFrame([(s, full[s] + 1) for s in part] or [("", 0)], "source string, copy int")
    rest = _last_pass(sized, part, seed).join(F.broadcast(upto), "source").select("doc", "source", "n_tokens", "copy")
    uses = materialize(whole.unionByName(rest), "uses")

    sources = sorted(quota)
    n_blocks = np.array([max(1, -(-int(quota[s]) // BLOCK_TOKENS)) for s in sources], np.int64)
    shards = max(1, -(-int(sum(quota.values())) // shard_tokens))
    sizes = group_sizes(shards)
    tree = splitting_tree(n_blocks, sizes, seed) if sources else np.zeros((len(sizes), 0), np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.cumsum(tree, axis=0)
    sent = spark.sparkContext.broadcast((sources, n_blocks, sizes, first, tree, ends))  # groups x sources numbers

    def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, blocks, _, _, _, ends = sent.value
        place = {s: j for j, s in enumerate(names)}
        for batch in batches:
            j = batch["source"].map(place).to_numpy(np.int64)
            block = batch["h"].to_numpy(np.int64) % blocks[j]
            group = np.zeros(len(batch), np.int64)
            for k in np.unique(j):
                own = j == k
                group[own] = np.searchsorted(ends[:, k], block[own], "right")
            before = np.where(group > 0, ends[np.maximum(group - 1, 0), j], 0)
            yield batch.drop(columns="h").assign(g=group, block=block - before)

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        names, _, sizes, first, tree, _ = sent.value
        g = int(rows["g"].iloc[0])
        own = rows.groupby("source").indices
        where = shard_of({s: rows["block"].to_numpy()[i] for s, i in own.items()}, tree[g], names, int(sizes[g]), seed, g)
        shard = np.zeros(len(rows), np.int64)
        for s, i in own.items():
            shard[i] = where[s]
        order = np.lexsort((rows["copy"], rows["doc"], rows["spot"], shard))
        shard = shard[order]
        begin = np.flatnonzero(np.concatenate([[True], np.diff(shard) != 0]))
        position = np.arange(len(shard)) - np.repeat(begin, np.diff([*begin, len(shard)])) + 1
        out = rows.iloc[order]
        return out[["doc", "source", "copy", "n_tokens"]].assign(shard=shard + first[g], position=position)[["shard", "position", "doc", "source", "copy", "n_tokens"]]

    marked = uses.select("doc", "source", "copy", "n_tokens", F.pmod(F.xxhash64("doc", "copy", F.lit(seed)), F.lit(1 << 62)).alias("h"), F.xxhash64("doc", "copy", F.lit(seed + 2)).alias("spot"))
    placed = marked.mapInPandas(grouped, "doc long, source string, copy int, n_tokens long, spot long, g long, block long")
    mixture = placed.groupBy("g").applyInPandas(deal, "shard int, position long, doc long, source string, copy int, n_tokens long")

    wanted = spark.createDataFrame([(s, share[s], share[s] * total, supply.get(s, 0), repeats[s]) for s in want], "source string, target_share double, wanted_tokens double, supply_tokens long, max_repeats int")
    got = uses.groupBy("source").agg(F.sum("n_tokens").alias("actual_tokens"))
    report = wanted.join(got, "source", "left").fillna(0, ["actual_tokens"])
    all_ = uses.agg(F.sum("n_tokens").alias("t"))
    report = report.crossJoin(F.broadcast(all_)).withColumn("actual_share", F.col("actual_tokens") / F.col("t")).drop("t")  # one row
    return mixture, report
