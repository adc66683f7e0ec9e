"""The most similar vectors for every vector: multi-index hashing over learned binary codes."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallix.session import checkpoint

#: Bits of a code.
BITS = 128


def usable(lists: pa.ChunkedArray | pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and float32 matrix of the lists that hold `dims` finite values that aren't all zero."""
    arr = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    if not len(arr):
        return np.zeros(0, "i8"), np.zeros((0, dims), "f4")
    offsets = arr.offsets.to_numpy()
    length = np.where(arr.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), -1)
    rows = np.flatnonzero(length == dims)
    flat = arr.values.cast(pa.float32()).to_numpy(zero_copy_only=False)  # null values become NaN
    m = flat[offsets[rows][:, None] + np.arange(dims)] if len(rows) else np.zeros((0, dims), "f4")
    sound = np.isfinite(m).all(1) & (m != 0).any(1)
    return rows[sound], m[sound]


def learn_rotation(sample: np.ndarray, bits: int = BITS, rounds: int = 20, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Centre and projection (dims x bits) of codes `x @ projection > 0` fitted to unit vectors.

    Iterative quantisation: each block of `dims` bits has its own rotation, turned until the rotated sample lies
    close to the corners of a cube. Without a sample the rotations are random.
    """
    dims = sample.shape[1]
    rng = np.random.default_rng(seed)
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True) if len(sample) else sample
    centre = x.mean(0) if len(x) else np.zeros(dims)
    blocks = []
    for _ in range(-(-bits // dims)):
        r, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
        for _ in range(rounds if len(x) > dims else 0):
            v = (x - centre) @ r
            u, _, w = np.linalg.svd(np.where(v > 0, 1.0, -1.0).T @ (x - centre))
            r = (u @ w).T
        blocks.append(r)
    return centre.astype("f4"), np.hstack(blocks)[:, :bits].astype("f4")


def _encoder(dims: int, centre: np.ndarray, projection: np.ndarray):
    """Turns (src, id, embedding) into the codes of usable vectors, with two hashes that tell equal vectors."""
    schema = pa.schema([("src", pa.string()), ("id", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = np.random.default_rng(11).integers(1, 2**63, (2, dims), dtype="u8") | np.uint64(1)
        for batch in batches:
            rows, m = usable(batch.column("embedding"), dims)
            if not len(rows):
                continue
            codes = np.packbits((_units(m) - centre) @ projection > 0, axis=1).view("i8")
            raw = (m + np.float32(0)).view("u4").astype("u8")  # + 0: minus zero equals zero
            raw ^= raw >> np.uint64(15)
            h = [(((raw * k) ^ ((raw * k) >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)).sum(1, dtype="u8").view("i8") for k in mix]
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column("src").take(take), batch.column("id").take(take), h[0], h[1], codes[:, 0].copy(), codes[:, 1].copy()], schema=schema)

    return encode


def _units(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m.astype("f8"), axis=1, keepdims=True).astype("f4")


def _unit_rows(dims: int):
    """Turns (src, id, embedding) into (src, id, unit) of the usable vectors."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, m = usable(batch.column("embedding"), dims)
            flat = pa.ListArray.from_arrays(np.arange(0, m.size + 1, dims, dtype="i4"), _units(m).astype("f4").ravel())
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column("src").take(take), batch.column("id").take(take), flat], names=["src", "id", "unit"])

    return units


def radius_for(held: np.ndarray, centre: np.ndarray, projection: np.ndarray, least: float, recall: float = 0.995, pairs: int = 8192, seed: int = 13) -> int:
    """The bits within which the codes of this share of pairs with cosine `least` lie.

    One of each pair is of `held`, vectors the rotation wasn't fitted to (the fit flatters those it has seen).
    """
    rng = np.random.default_rng(seed)
    x = held[rng.integers(0, len(held), pairs)] if len(held) else rng.standard_normal((pairs, len(projection)))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal(x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y = least * x + np.sqrt(1 - least**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    return int(np.quantile((((x - centre) @ projection > 0) != ((y - centre) @ projection > 0)).sum(1), recall, method="higher"))


# --- multi-index hashing -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Substrings:
    """A code cut into substrings: where each starts, its bits, and how many bits a probe of it may be off.

    Pigeonhole: if the limits plus one sum to more than the radius, two codes within the radius are within the limit
    in one substring at least. region holds the bits of a substring whose values tell the task (0: one task each).
    """

    starts: tuple[int, ...]
    widths: tuple[int, ...]
    limits: tuple[int, ...]
    region: int = 0

    def value(self, c1: np.ndarray, c2: np.ndarray, p: int) -> np.ndarray:
        """The values of substring p of codes c1 (bits 0 to 63) and c2 (64 to 127)."""
        a, w = self.starts[p], self.widths[p]
        if a >= 64:
            v = c2 >> np.uint64(a - 64)
        elif a + w <= 64:
            v = c1 >> np.uint64(a)
        else:
            v = (c1 >> np.uint64(a)) | (c2 << np.uint64(64 - a))
        return (v & np.uint64((1 << w) - 1)).astype("i8")


def masks(width: int, most: int) -> np.ndarray:
    """All numbers of `width` bits with at most `most` bits set, 0 first."""
    return np.array([sum(1 << b for b in c) for n in range(most + 1) for c in itertools.combinations(range(width), n)], "i8")


def cut_code(radius: int, n: int, load: int, bits: int = BITS) -> Substrings:
    """The cut of a code that makes the search among n codes cheapest; substrings get longer as n grows.

    m substrings share a radius r as m * s + a: s bits off in the first a + 1, s - 1 in the others. What is reckoned
    with: nanoseconds for each pair of codes that meets, microseconds for each value that is looked up.
    """
    best = None
    for m in range(6, 17):
        widths = [bits // m + (i < bits % m) for i in range(m)]
        s, a = divmod(radius, m)
        limits = [s if i <= a else s - 1 for i in range(m)]
        meet = sum(sum(math.comb(w, k) for k in range(t + 1)) / 2**w for w, t in zip(widths, limits))
        cost = meet * n * n * 1e-9 + sum(min(2**w, n) for w in widths) * 4e-5
        if best is None or cost < best[0]:
            best = cost, widths, limits
    _, widths, limits = best
    region = max(0, math.ceil(math.log2(max(1, n) / load)))
    return Substrings(tuple(itertools.accumulate([0, *widths[:-1]])), tuple(widths), tuple(limits), min(region, min(widths) - 1))


def _spreader(cut: Substrings):
    """Turns (src, id, c1, c2) into a row for each task that is to see the code: spot tells substring and region.

    home is 1 in the region of the code's own value. Where a region has several bits, a code also visits the regions
    whose values may be within the limit; of two such regions one is visited, by a coin tossed once for both.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = [batch.column(x).to_numpy().view("u8") for x in ("c1", "c2")]
            for p, (w, t) in enumerate(zip(cut.widths, cut.limits)):
                if t < 0:
                    continue
                at = cut.value(*c, p) >> (w - cut.region)
                for k in masks(cut.region, min(t, cut.region)):
                    to = at ^ k
                    low, high = np.minimum(at, to), np.maximum(at, to)
                    coin = ((low * 0x9E3779B1 + high * 0x85EBCA77) >> 13) & 1
                    go = np.flatnonzero((k == 0) | (coin == (at < to)))
                    if len(go):
                        i = pa.array(go)
                        yield pa.RecordBatch.from_arrays([pa.array(((p << cut.region) + to[go]).astype("i4")), pa.array(np.full(len(go), int(k == 0), "i4")), *[batch.column(x).take(i) for x in ("src", "id", "c1", "c2")]], names=["spot", "home", "src", "id", "c1", "c2"])

    return spread


def near_codes(c1: np.ndarray, c2: np.ndarray, home: np.ndarray, cut: Substrings, p: int, radius: int, block: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of codes within the radius whose substring p is the first within its limit.

    Codes at home are indexed by their value; every value probes all values at most `limit` bits off that are there.
    A pair has two codes at home or one of them. Codes that differ in no bit are pairs, too.
    """
    value, near = cut.value(c1, c2, p), masks(cut.widths[p], cut.limits[p])
    own, guests = (np.flatnonzero(home == h) for h in (1, 0))
    own, guests = own[np.argsort(value[own], kind="stable")], guests[np.argsort(value[guests], kind="stable")]
    base = value[own[0]] >> (cut.widths[p] - cut.region) << (cut.widths[p] - cut.region) if len(own) else 0
    span = 1 << (cut.widths[p] - cut.region)
    start = np.searchsorted(value[own] - base, np.arange(span + 1))
    x1, x2 = c1[own], c2[own]

    def compare(rows: np.ndarray, first: int, cols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows (indices of codes, at home from place `first` on if that isn't -1) and places cols of own."""
        y1, y2 = x1[cols], x2[cols]
        step = max(1, block // max(1, len(cols)))
        for a in range(0, len(rows), step):
            r = rows[a : a + step]
            far = np.bitwise_count(c1[r][:, None] ^ y1)
            far += np.bitwise_count(c2[r][:, None] ^ y2)
            hit = np.flatnonzero(far.ravel() <= radius)
            if len(hit):
                i, j = np.divmod(hit, len(cols))
                if first >= 0:
                    keep = cols[j] > first + a + i
                    i, j = i[keep], j[keep]
                i, j = r[i], own[cols[j]]
                d1, d2 = c1[i] ^ c1[j], c2[i] ^ c2[j]
                keep = np.ones(len(i), bool)
                for q in range(p):
                    keep &= np.bitwise_count(cut.value(d1, d2, q).view("u8")) > cut.limits[q]
                yield i[keep], j[keep]

    for rows, at_home in ((own, True), (guests, False)):
        v = value[rows]
        cuts = np.flatnonzero(np.r_[True, v[1:] != v[:-1], True]) if len(v) else [0]
        for a, z in zip(cuts[:-1], cuts[1:]):
            probe = (v[a] ^ near) - base
            probe = probe[(probe >= (v[a] - base + 1 if at_home else 0)) & (probe < span)]
            low, many = start[probe], start[probe + 1] - start[probe]
            low, many = low[many > 0], many[many > 0]
            cols = np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum()) if len(many) else np.zeros(0, "i8")
            if at_home and z - a > 1:
                cols = np.r_[np.arange(a, z), cols]
            if len(cols):
                yield from compare(rows[a:z], a if at_home else -1, cols)


def _matcher(cut: Substrings, radius: int):
    """Turns rows sorted by src and spot into the pairs (src, a, b) of codes within the radius."""

    def search(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        c1, c2 = (t.column(c).to_numpy().view("u8") for c in ("c1", "c2"))
        src, ids, p = t.column("src").combine_chunks(), t.column("id").combine_chunks(), t.column("spot")[0].as_py() >> cut.region
        left, right, held = [], [], 0
        for i, j in itertools.chain(near_codes(c1, c2, t.column("home").to_numpy(), cut, p, radius), [(None, None)]):
            if i is not None and len(i):
                left.append(i)
                right.append(j)
                held += len(i)
            if held and (i is None or held > 100_000):
                a, b = pa.array(np.concatenate(left)), pa.array(np.concatenate(right))
                left, right, held = [], [], 0
                yield pa.RecordBatch.from_arrays([src.take(a), ids.take(a), ids.take(b)], names=["src", "a", "b"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            spot, src = batch.column("spot").to_numpy(), batch.column("src").dictionary_encode()
            code = src.indices.fill_null(-1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, (spot[1:] != spot[:-1]) | (code[1:] != code[:-1]), True])
            for a, z in zip(cuts[:-1], cuts[1:]):
                here = batch.column("src")[a].as_py(), int(spot[a])
                if held and here != last:
                    yield from search(held)
                    held = []
                held.append(batch.slice(a, z - a))
                last = here
        if held:
            yield from search(held)

    return match


def similar_vectors(df: DataFrame, k: int = 5, least: float = 0.85, dims: int = 64, radius: int | None = None, sample: int = 8192, load: int = 1_000_000) -> DataFrame:
    """Pairs (src, id_a, id_b, cosine) of rows of one src with cosine >= least, one among the k nearest of the other.

    df has src, id (string) and embedding (array<float>); other columns play no part. Only usable vectors count:
    `dims` finite values that aren't all zero. id_a < id_b as text.

    Multi-index hashing. A rotation learned from half of about `sample` vectors (by a hash of the id) gives each
    vector a 128-bit code, cut into 6 to 16 substrings, longer ones for more rows (cut_code). Every vector is indexed
    by each substring. Every value probes all values so few bits off that no code within `radius` bits can be
    missed (pigeonhole); each pair is found once, at the first substring that shows it, and reranked by its floats.
    Without a given radius it is the one that holds 0.995 of pairs at `least` (radius_for, on the other half), which
    is all that can be lost. A substring of more than `load` codes is cut into regions by its first bits, a task each;
    codes also visit the regions their probes reach, so nothing is lost there either.

    Copies of a vector are one class: only its smallest id is indexed. Each of the copies has the others (by id)
    before all else among its k nearest, then the nearest classes, the members of each by id.

    Defined cases: null, short, zero, NaN or infinite vectors have no pairs; equal similarities go by id; an
    empty table gives no rows; repeated (src, id) rows count as one.
    """
    rows = df.select(F.col("src").cast("string"), F.col("id").cast("string"), F.col("embedding").cast("array<float>")).where("id is not null and size(embedding) = %d" % dims)
    counts = rows.groupBy("src").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0)), F.count(F.lit(1))).first()
    total, largest, sources = (int(x) for x in counts)
    every = max(1, total // sample)
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("embedding").limit(4 * sample).toArrow()
    _, train = usable(drawn.column(0), dims)
    rotation = learn_rotation(train[::2])
    radius = radius_for(train[1::2], *rotation, least) if radius is None else radius
    cut = cut_code(radius, largest, load)
    coded = checkpoint(rows.mapInArrow(_encoder(dims, *rotation), "src string, id string, h1 bigint, h2 bigint, c1 bigint, c2 bigint"))

    same = ["src", "h1", "h2"]
    ranked = coded.withColumn("rn", F.dense_rank().over(Window.partitionBy(*same).orderBy("id"))).where(F.col("rn") <= k + 1)
    classes = ranked.groupBy(*same).agg(F.array_sort(F.collect_set("id")).alias("ids"), F.first("c1").alias("c1"), F.first("c2").alias("c2"))
    classes = checkpoint(classes.withColumn("id", F.get("ids", F.lit(0))))

    spread = classes.select("src", "id", "c1", "c2").mapInArrow(_spreader(cut), "spot int, home int, src string, id string, c1 bigint, c2 bigint")
    # As many tasks as spots, and some more: AQE would judge these by their few bytes and make them one.
    tasks = min(5000, max(2 * df.sparkSession.sparkContext.defaultParallelism, 3 * max(1, sources) * len(cut.widths) << cut.region))
    near = spread.repartition(tasks, "src", "spot").sortWithinPartitions("src", "spot").mapInArrow(_matcher(cut, radius), "src string, a string, b string")

    # The floats are read again where they are compared: no copy of them is kept.
    units = rows.mapInArrow(_unit_rows(dims), "src string, id string, unit array<float>")
    left = units.select(F.col("src"), F.col("id").alias("a"), F.col("unit").alias("ua"))
    right = units.select(F.col("src"), F.col("id").alias("b"), F.col("unit").alias("ub"))
    dot = F.aggregate(F.zip_with("ua", "ub", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    rated = near.join(left, ["src", "a"]).join(right, ["src", "b"]).select("src", "a", "b", dot.alias("cosine")).where(F.col("cosine") >= least)
    both = rated.select("src", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"), "cosine").select("src", "x.a", "x.b", "cosine")
    top = both.withColumn("rank", F.dense_rank().over(Window.partitionBy("src", "a").orderBy(F.desc("cosine"), "b"))).where(F.col("rank") <= k)

    own = classes.select("src", F.col("id").alias("a"), F.col("ids").alias("own"))
    other = classes.select("src", F.col("id").alias("b"), F.slice("ids", 1, k).alias("ids"))
    lists = top.join(other, ["src", "b"]).groupBy("src", "a").agg(F.array_sort(F.collect_set(F.struct("rank", "cosine", "ids"))).alias("near"))
    flat = F.expr("flatten(transform(near, n -> transform(n.ids, i -> named_struct('id', i, 'cosine', n.cosine))))")
    free = F.lit(k + 1) - F.size("own")
    out = lists.join(own, ["src", "a"]).where(free > 0).select("src", F.explode("own").alias("x"), F.slice(flat, F.lit(1), free).alias("near")).select("src", "x", F.explode("near").alias("n")).select("src", "x", F.col("n.id").alias("y"), "n.cosine")
    twins = classes.where(F.size("ids") > 1).select(*same, F.col("ids").alias("own"))
    copies = coded.select(*same, F.col("id").alias("x")).join(twins, same).select("src", "x", F.explode(F.slice(F.array_remove("own", F.col("x")), 1, k)).alias("y"), F.lit(1.0).alias("cosine"))
    pairs = out.unionByName(copies)
    return pairs.groupBy("src", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).agg(F.max("cosine").alias("cosine")).where("id_a < id_b")
