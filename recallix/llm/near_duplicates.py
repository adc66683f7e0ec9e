"""Groups of records whose word sets are similar: an LSH forest, an exact check, and components."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallix.operators.components import components
from recallix.session import checkpoint


def words(text: str):
    """The distinct lower-cased runs of letters and digits of a text column, sorted; empty for null."""
    return F.coalesce(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))), F.array().cast("array<string>"))


@functools.lru_cache(100_000)
def trees_by_depth(depth: int, least: float, recall: float, words: int, rare: int = 0) -> list[int]:
    """For labels of 1 to `depth` common words: how many plain MinHash orders find a pair at `least` with this chance.

    One record has so many words, `rare` of them rare and not shared. If s common words are shared of u common words
    of both, labels of d words are the same with a chance of s(s-1).../u(u-1)...; u is s / least - rare at most.
    Labels of more than four words are used only as far as 300 trees are enough.
    """
    common, limit = words - rare, 300
    cases = [(s, u) for s in range(math.ceil(least * words - 1e-9), common + 1) if (u := int(s / least + 1e-9) - rare) >= common]
    same = [min((math.prod(max(0, s - k) / max(1, u - k) for k in range(min(d, s))) for s, u in cases), default=1.0) for d in range(1, depth + 1)]
    trees = [math.ceil(math.log(1 - recall) / math.log(1 - p)) if 0 < p < 1 else 1 for p in same]
    return trees[: max(4, sum(t <= limit for t in trees))]


def word_table(counts: DataFrame, leaf: int, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(leaf, hashes, counts) of the words (w, count) in more than `leaf` records, sorted by hash.

    leaf is the one given, or, if more than `most` words have more, the least power of two that leaves `most` at most.
    """
    counts = checkpoint(counts.where(F.col("count") > leaf))
    sizes = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2(F.col("count") - 0.5)).cast("int").alias("k")).count().collect()}  # a row a power of two
    # Bucket k holds the counts of more than 2 ** k, up to 2 ** (k + 1).
    if sum(sizes.values()) > most:
        leaf = next(2**k for k in range(64) if 2**k > leaf and sum(n for j, n in sizes.items() if j >= k) <= most)
    t = counts.where(F.col("count") > leaf).select("w", F.col("count").cast("double").alias("n")).toArrow()
    h = pd.util.hash_array(np.array(t.column("w").to_pylist(), dtype=object), categorize=False)
    order = np.argsort(h)
    return leaf, h[order], t.column("n").to_numpy()[order]


def _among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted values."""
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x if len(values) else np.zeros(len(x), bool)


def _ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    return np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())


def _labels(table, total: int, leaf: int, room: int, least: float, recall: float, depth: int, seed: int, hot=None):
    """Turns (src, id, words) into a row for each region the record is in: its key, and what the comparison there needs.

    table is a broadcast of the hashes and counts of the common words, hot one of the sorted keys of hot regions: only
    their rows carry the hashes of the words.
    """

    max_trees = 512  # trees_by_depth goes no deeper than that allows

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = table.value
        rng = np.random.default_rng(seed)
        odd, add = (rng.integers(1, 2**63, max_trees, dtype="u8") | np.uint64(1) for _ in range(2))
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("words")
            starts = texts.offsets.to_numpy()
            base, size = starts[:-1] - starts[0], np.diff(starts)
            flat = texts.values.slice(starts[0], starts[-1] - starts[0])
            coded = pa.array(flat).dictionary_encode()
            which = coded.indices.to_numpy()
            vocabulary = coded.dictionary.to_pylist()
            h = pd.util.hash_array(np.array(vocabulary, dtype=object), categorize=False)
            at = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
            df = np.where(hashes[at] == h, counts[at], 1.0) if len(hashes) else np.ones(len(h))
            # Each word flips one of 128 bits: the bits in which two records differ never outnumber the words.
            bit = (h >> np.uint64(57)).astype("u8")[which]
            one = np.uint64(1) << (bit & np.uint64(63))
            s1 = np.bitwise_xor.reduceat(np.where(bit < 64, one, np.uint64(0)), base)
            s2 = np.bitwise_xor.reduceat(np.where(bit >= 64, one, np.uint64(0)), base)
            src = pd.util.hash_array(np.array(batch.column("src").to_pylist(), dtype=object), categorize=False)
            owner = np.repeat(np.arange(len(size)), size)
            need = np.ceil(least * size - 1e-9).astype("i8")  # words that a linked record shares at least
            full = h[which]

            def rows(key: np.ndarray, at: np.ndarray, tree: int) -> pa.RecordBatch:
                key = (key ^ src[at]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(tree)
                key = key.view("i8")
                i = pa.array(at)
                many = np.where(_among(key, hot.value), size[at], 0) if hot is not None else np.zeros(len(at), "i8")
                offsets = np.r_[0, np.cumsum(8 * many)].astype("i4")
                held = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(full[_ranges(base[at], many)])])
                return pa.RecordBatch.from_arrays([pa.array(key), batch.column("src").take(i), batch.column("id").take(i), pa.array(s1[at].view("i8")), pa.array(s2[at].view("i8")), pa.array(size[at].astype("i4")), held], names=["key", "src", "id", "s1", "s2", "n", "held"])

            # Exact for pairs that share a rare word: rare words first, one is in the first n - need + 1 of both.
            rare = (df <= leaf)[which]
            order = np.lexsort((h[which], ~rare, owner))
            prefix = order[rare[order] & (np.arange(len(order)) - base[owner] < (size - need + 1)[owner])]
            if len(prefix):
                yield rows(h[which[prefix]], owner[prefix], 0)

            # All else a linked pair shares is common: plain MinHash orders of the common words alone.
            held = np.bincount(owner[~rare], minlength=len(size))
            keep = ~rare & (held >= need)[owner]
            w, own = which[keep], owner[keep]
            kinds, kind = np.unique(np.stack([size, held], 1), axis=0, return_inverse=True)
            lists = [trees_by_depth(depth, least, recall, int(n), int(n - c)) if c >= math.ceil(least * n - 1e-9) else [0] * depth for n, c in kinds]
            deepest = np.array([len(x) for x in lists])[kind.ravel()]
            trees = np.array([[0, *x, *[x[-1]] * (depth - len(x))] for x in lists])[kind.ravel()]
            share = np.log(df / total)
            enough = np.log(room / total)

            def prefixes(rank: np.ndarray, w: np.ndarray, own: np.ndarray, value: np.ndarray):
                """Records, the depth of each one's label in this order, and the label."""
                order = np.lexsort((rank, own))
                at, begin, many = np.unique(own, return_index=True, return_counts=True)
                deep, key, here, on = np.zeros(len(at), "i8"), np.zeros(len(at), "u8"), np.zeros(len(at)), np.ones(len(at), bool)
                for k in range(depth):
                    on &= (many > k) & (deepest[at] > k)
                    x = w[order[begin[on] + k]]
                    key[on] = key[on] * np.uint64(0x100000001B3) ^ value[x]
                    here[on] += share[x]
                    deep[on] += 1
                    on &= here > enough
                return at, deep, key

            t = 0
            if len(w):
                at, deep, _ = prefixes(-df[w], w, own, h)
                most = np.zeros(len(size), "i8")
                most[at] = trees[at, deep]  # no label of the record is deeper than this
            while len(w) and t < max_trees:
                on = most[own] > t
                w, own = w[on], own[on]
                if not len(w):
                    break
                mixed = (h ^ add[t]) * odd[t]
                mixed ^= mixed >> np.uint64(31)
                mixed *= np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
                at, deep, key = prefixes(mixed[w], w, own, mixed)
                on = trees[at, deep] > t
                t += 1
                if on.any():
                    yield rows(key[on], at[on], t)

    return label


def _pairs(least: float):
    """Pairs of one region whose sketches don't rule the similarity out; batches come sorted by key.

    In a hot region, the rows of which hold their words, the pairs are checked exactly, and those linked already
    through others there are left out, so a hot group gives about a pair a member. Only links that hold join groups:
    a sketch can't show that two records are similar, as words that meet in a bit hide each other.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = (1 - least) / (1 + least)
        held: pa.Table | None = None

        def linked(n: np.ndarray, s1: np.ndarray, s2: np.ndarray, block: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            group, left, right = np.arange(len(n)), [np.zeros(0, "i8")], [np.zeros(0, "i8")]
            values, code = np.unique(np.frombuffer(b"".join(words.to_pylist()), "u8"), return_inverse=True)
            many = n.astype("i8")
            start, mine = np.cumsum(many) - many, np.zeros(len(values), bool)
            across = block[0] != block[-1]  # sorted by block: two blocks are compared with each other only
            begin = int(np.searchsorted(block, block[-1])) if across else 0
            for i in range(begin if across else len(n) - 1):
                after = max(i + 1, begin)
                to = after + np.flatnonzero(group[after:] != group[i])
                differ = np.bitwise_count(s1[i] ^ s1[to]).astype("f8") + np.bitwise_count(s2[i] ^ s2[to])
                to = to[(differ <= share * (n[i] + n[to]) + 1e-9) & (np.minimum(n[i], n[to]) >= least * np.maximum(n[i], n[to]) - 1e-9)]
                if not len(to):
                    continue
                own = code[start[i] : start[i] + many[i]]
                mine[own] = True
                shared = np.add.reduceat(mine[code[_ranges(start[to], many[to])]], np.cumsum(many[to]) - many[to], dtype="i8")
                mine[own] = False
                to = to[shared >= least * (n[i] + n[to] - shared) - 1e-9]
                if len(to):
                    one, at = np.unique(group[to], return_index=True)
                    to = to[at]  # a link to each group is enough
                    left.append(np.full(len(to), i))
                    right.append(to)
                    group[group == one[0] if len(one) == 1 else np.isin(group, one)] = group[i]
            return np.concatenate(left), np.concatenate(right)

        def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.combine_chunks()
            key, n, block = t.column("key").to_numpy(), t.column("n").to_numpy().astype("f8"), t.column("block").to_numpy()
            s = [t.column(c).to_numpy().view("u8") for c in ("s1", "s2")]
            src, ids = t.column("src").combine_chunks(), t.column("id").combine_chunks()
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            words = t.column("held").combine_chunks()
            big = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
            for a, z in zip(cuts[:-1], cuts[1:]):
                if big[a]:
                    left, right = linked(n[a:z], s[0][a:z], s[1][a:z], block[a:z], words[a:z])
                    i, j = pa.array(left + a), pa.array(right + a)
                    yield pa.RecordBatch.from_arrays([src.take(i), ids.take(i), ids.take(j)], names=["src", "a", "b"])
            at, step = np.flatnonzero(~big), 1
            while len(at):
                at = at[at + step < len(key)]
                at = at[key[at] == key[at + step]]
                to = at + step
                differ = np.bitwise_count(s[0][at] ^ s[0][to]).astype("f8") + np.bitwise_count(s[1][at] ^ s[1][to])
                keep = (differ <= share * (n[at] + n[to]) + 1e-9) & (np.minimum(n[at], n[to]) >= least * np.maximum(n[at], n[to]) - 1e-9)
                if keep.any():
                    i, j = pa.array(at[keep]), pa.array(to[keep])
                    yield pa.RecordBatch.from_arrays([src.take(i), ids.take(i), ids.take(j)], names=["src", "a", "b"])
                step += 1

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            if not t.num_rows:
                continue
            key = t.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from compare(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None:
            yield from compare(held)

    return pairs


def _hot_regions(sampled: DataFrame, every: int, large: int, block: int) -> DataFrame:
    """(key, blocks) of the regions with more than about `large` rows, by those of a sample of one in `every`.

    One of more than about `block` rows has blocks of half as many. At most rows / large regions are hot.
    """
    rows = F.col("count") * every
    blocks = F.when(rows > block, F.ceil(2 * rows / block)).otherwise(1).cast("int")
    return checkpoint(sampled.groupBy("key").count().where(rows > min(large, block)).select("key", blocks.alias("blocks")))


def _in_blocks(forest: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows of forest with `block`; those of a region in blocks once for each pair of blocks their block is in.

    The region is dealt into its blocks, and each pair of blocks is a region of its own, so a task holds as many rows
    as two blocks have. Nothing is left out, and a region is the same whether the sample shows it or not.
    """
    rows = forest.join(F.broadcast(hot.where("blocks > 1")), "key", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")), F.lit(0)).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
    key = F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("block", "with"), F.greatest("block", "with")))
    return rows.select(key.alias("key"), "block", "src", "id", "s1", "s2", "n", "held")


def near_duplicates(df: DataFrame, least: float = 0.6, fewest: int = 6, recall: float = 0.99, leaf: int = 48, most_common: int = 2_000_000, depth: int = 4, block: int = 32_000, every: int = 32, seed: int = 5, large: int = 1000) -> DataFrame:
    """(src, id, group): the records that have a near-duplicate, with the smallest id of their group.

    df has src, id (bigint) and text. Within one src two records are linked if the Jaccard similarity of their
    word sets is at least `least`; linked records, also through others, form a group. Records with fewer than
    `fewest` distinct words have no group.

    A word of at most `leaf` records is rare. Linked records that share a rare word meet for sure: with rare words
    first, they share one of the first n - ceil(least * n) + 1. All the others share common words only, so at least
    ceil(least * n) of each one's words are common: an LSH forest over the common words alone, each tree a plain
    MinHash order. Records whose labels share the longest useful prefix are a region: the prefix goes on until the
    expected region is at most about 4 * `leaf` records, up to `depth` words (more would take hundreds of trees). The deeper a label, the more trees
    have it, so that a pair at `least` meets with a chance of `recall` at any depth (trees_by_depth). In a
    region pairs are ruled out by a 128-bit odd sketch (it never rules out a true link), the rest is checked exactly.
    No region is cut. In one of more than about `large` records pairs are checked by the words at once, and those
    linked through others are left out; one of more than about `block` records, fewer if they have many words, is
    compared in pairs of blocks, a task each.

    The word counts cover all records. Words in more than `leaf` records are broadcast as hashes with their counts,
    `most_common` (of 16 bytes each) at most: only if there are more does leaf grow (word_table). Equal word sets are
    one record until the end, so copies make no pairs.

    Defined cases: null and empty texts and null ids have no group; repeated (src, id) rows count as one record if
    their text is the same; an empty table gives no rows; other columns play no part.
    """
    rows = df.select(F.col("src").cast("string"), F.col("id").cast("bigint"), words("text").alias("words")).where(F.col("id").isNotNull() & F.col("src").isNotNull() & (F.size("words") >= fewest))
    one = F.struct(F.xxhash64("words").alias("h"), F.hash("words").alias("g"))
    rows = rows.withColumn("h", one)
    sets = checkpoint(rows.groupBy("src", "h").agg(F.min("id").alias("id"), F.first("words").alias("words"), F.count(F.lit(1)).alias("copies")))
    total = max(1, sets.count())
    leaf, hashes, counts = word_table(sets.select(F.explode("words").alias("w")).groupBy("w").count(), leaf, most_common)
    table = df.sparkSession.sparkContext.broadcast((hashes, counts))
    mean = sets.agg(F.avg(F.size("words"))).first()[0] or 1
    block = max(2, min(block, int(8_000_000 / mean)))  # 64 MB of hashes
    regions = lambda some, keys=None: some.select("src", "id", "words").mapInArrow(_labels(table, total, leaf, 4 * leaf, least, recall, depth, seed, keys), "key bigint, src string, id bigint, s1 bigint, s2 bigint, n int, held binary")
    hot = _hot_regions(regions(sets.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)), every, large, block)
    keys = df.sparkSession.sparkContext.broadcast(np.sort(hot.select("key").toArrow().column("key").to_numpy()))
    forest = _in_blocks(regions(sets, keys), hot)
    near = forest.repartition("key").sortWithinPartitions("key", "block").mapInArrow(_pairs(least), "src string, a bigint, b bigint")
    near = near.select("src", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    left = sets.select("src", F.col("id").alias("a"), F.col("words").alias("wa"))
    right = sets.select("src", F.col("id").alias("b"), F.col("words").alias("wb"))
    shared = F.size(F.array_intersect("wa", "wb"))
    linked = near.join(left, ["src", "a"]).join(right, ["src", "b"]).where(shared >= F.lit(least) * (F.size("wa") + F.size("wb") - shared) - 1e-9)
    node = lambda c: F.concat(F.col("src"), F.lit(":"), F.lpad(F.col(c).cast("string"), 20, "0"))
    labels = components(linked.select(node("a").alias("a"), node("b").alias("b")), "a", "b")
    grouped = sets.where("id >= 0").join(labels, node("id") == F.col("node"), "left").where("component is not null or copies > 1")
    group = F.coalesce(F.regexp_extract("component", r":(\d+)$", 1).cast("bigint"), F.col("id"))
    grouped = grouped.select("src", "h", group.alias("group"))
    return rows.select("src", "h", "id").join(grouped, ["src", "h"]).select("src", "id", "group").distinct()


def group_pairs(groups: DataFrame) -> DataFrame:
    """Every pair (src, id_a, id_b) within a group, id_a < id_b."""
    a = groups.select("src", "group", F.col("id").alias("id_a"))
    b = groups.select("src", "group", F.col("id").alias("id_b"))
    return a.join(b, ["src", "group"]).where("id_a < id_b").select("src", "id_a", "id_b")
