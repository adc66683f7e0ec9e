"""A public byte-level BPE tokenizer as Spark expressions: merges folded over the bytes of distinct words."""

from __future__ import annotations

import base64
import importlib.util
import json
import os
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallix.session import checkpoint

#: Where the vocabulary files are, unless a caller says otherwise.
FOLDER = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

#: White space of Unicode, which Java's \s isn't.
_SPACE = r"\t-\r \x85\xa0  -     　"
#: The tokenizer's pattern that splits text before the merges.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

#: Shards of the literal rank map: a map's lookup is a scan, so each shard is short.
SHARDS = 4096
NONE = 2**31 - 1
#: Words of more bytes are merged by a heap in Python; folding them would take time with the square of their length.
LONG = 1024


def _place(folder: str | None, vocabulary: str) -> str:
    if folder:
        return os.path.join(folder, vocabulary)
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.join(os.path.dirname(spec.origin) if spec else FOLDER, vocabulary)


def load_ranks(folder: str | None = None, vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes -> rank (its id), of a rank file."""
    with open(_place(folder, vocabulary), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _rank_map(ranks: dict[bytes, int]) -> Column:
    """The literal map token -> rank, as an array of short maps. A byte is written as the character of its number."""
    shards: list[dict[str, int]] = [{} for _ in range(SHARDS)]
    for token, rank in ranks.items():
        text = token.decode("latin-1")
        shards[zlib.crc32(text.encode()) % SHARDS][text] = rank
    return F.from_json(F.lit(json.dumps(shards)), "array<map<string,int>>")


def _fold() -> str:
    """SQL: the ids of column __b (one character a byte), merged lowest rank first, leftmost on ties.

    a.p are the pieces so far, a.r the ranks of each with the next, x.new the pairs whose ranks are yet to be
    looked up: all pairs in step 0, then those on both sides of the last merge.
    """
    rank = f"coalesce(try_element_at(get(__ranks, cast(crc32(encode(s, 'UTF-8')) % {SHARDS} as int)), s), {NONE})"
    start = "named_struct('p', split(__b, ''), 'r', cast(array() as array<int>))"
    least = "cast(array_position(a.r, array_min(a.r)) as int)"
    found = f"named_struct('i', if(n = 0, 0, {least}), 'm', if(n = 0, '', concat(a.p[{least} - 1], a.p[{least}])))"
    pairs = "if(n = 0, transform(sequence(1, length(__b) - 1), i -> substring(__b, i, 2)), filter(array(if(x.i > 1, concat(a.p[x.i - 2], x.m), null), if(x.i < size(a.r), concat(x.m, a.p[x.i + 1]), null)), s -> s is not null))"
    merged = f"""named_struct(
        'p', if(n = 0, a.p, concat(slice(a.p, 1, greatest(x.i - 1, 0)), array(x.m), slice(a.p, x.i + 2, size(a.p)))),
        'r', concat(slice(a.r, 1, greatest(x.i - 2, 0)), transform({pairs}, s -> {rank}), slice(a.r, x.i + 2, size(a.r))))"""
    step = f"get(transform(array({found}), x -> {merged}), 0)"
    return f"aggregate(if(length(__b) > 1, sequence(0, length(__b) - 1), cast(array() as array<int>)), {start}, (a, n) -> if(n > 0 and coalesce(array_min(a.r), {NONE}) = {NONE}, a, {step})).p"


def split_words(text: Column) -> Column:
    """The words that are merged by themselves, in order; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def encode_words(words: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(word, ids) of distinct words, checkpointed.

    The rank map is a literal of the plan, some megabytes long; while the fold runs, plans are kept from being
    written out in full by each of their many readers (event log, UI, AQE). Words are few bytes and much work, so
    they are dealt to a given number of tasks: AQE would make them one or two.
    """
    tasks = max(2 * words.sparkSession.sparkContext.defaultParallelism, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    words = words.repartition(tasks, "word")
    ranks = load_ranks(folder, vocabulary)
    coded = words.select("word", F.decode(F.encode("word", "UTF-8"), "ISO-8859-1").alias("__b")).withColumn("__long", F.length("__b") > LONG)
    pieces = coded.where("not __long").select("word", "__b", _rank_map(ranks).alias("__ranks")).select("word", F.expr(_fold()).alias("p"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = None
        for b in batches:
            if len(b) and encoding is None:
                import tiktoken

                encoding = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=load_ranks(folder, vocabulary), special_tokens={})
            yield pd.DataFrame({"word": b["word"], "ids": [encoding.encode_ordinary(w) for w in b["word"]]})

    conf, limit = words.sparkSession.conf, "spark.sql.maxPlanStringLength"
    before = conf.get(limit)
    conf.set(limit, "10000")
    try:
        pieces = checkpoint(pieces)
        ids = pieces.select("word", F.transform("p", lambda s: F.element_at(_rank_map(ranks)[F.crc32(F.encode(s, "UTF-8")) % SHARDS], s)).alias("ids"))
        return checkpoint(ids.unionByName(coded.where("__long").select("word").mapInPandas(merge, "word string, ids array<int>")))
    finally:
        conf.set(limit, before)


def encode(df: DataFrame, key: list[str], text: str, folder: str | None = None, vocabulary: str = VOCABULARY, hot: int = 20_000) -> DataFrame:
    """(key columns, ids): the token ids of each text, without special tokens; null and empty texts give [].

    Texts are split into words; every distinct word is merged once, by Spark's higher-order functions: a fold
    over the array of its bytes that joins the pair of the least rank, with the ranks in a literal map. Words in
    more than total / `hot` places (at most `hot` by that bound, of at most 64 bytes each) reach the texts by a
    broadcast, so no common word is a hot key; the rest by a shuffle.

    Defined cases: strings that look like special tokens are plain text; rows that are equal in key and text come
    out as one; a null key is a key like any other; a very long word is merged exactly, too; an empty table gives
    none; other columns play no part.
    """
    k = [f"__k{i}" for i in range(len(key))]
    docs = df.select(*[F.col(x).alias(y) for x, y in zip(key, k)], F.col(text).cast("string").alias("__t"))
    places = docs.select(*k, F.xxhash64("__t").alias("__h"), F.posexplode_outer(split_words(F.col("__t"))).alias("pos", "word"))
    counts = checkpoint(places.where("word is not null").groupBy("word").count())
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    often = (F.col("count") > max(1, total // hot)) & (F.octet_length("word") <= 64)
    dictionary = encode_words(counts.select("word"), folder, vocabulary)
    common = dictionary.join(counts.where(often).select("word"), "word").withColumnRenamed("ids", "common")
    here = places.join(F.broadcast(common), "word", "left")
    known = here.where("common is not null or word is null").select(*k, "__h", "pos", F.col("common").alias("ids"))
    rest = here.where("common is null and word is not null").drop("common").join(dictionary, "word").select(*k, "__h", "pos", "ids")
    lists = known.unionByName(rest).groupBy(*k, "__h").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "ids")))).alias("x"))
    # A repeated row has each of its places twice; equal places are one.
    return lists.select(*[F.col(y).alias(x) for x, y in zip(key, k)], F.flatten(F.transform(F.array_distinct("x"), lambda s: s["ids"])).alias("ids"))


def decode(ids: Column, folder: str | None = None, vocabulary: str = VOCABULARY) -> Column:
    """The text of token ids: the binary pieces of a literal array, joined."""
    ranks = load_ranks(folder, vocabulary)
    pieces: list[str] = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.decode("latin-1")
    literal = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return F.decode(F.encode(F.array_join(F.transform(ids, lambda i: F.get(literal, i)), ""), "ISO-8859-1"), "UTF-8")


def token_counts(df: DataFrame, keys: list[str], text: str, folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(keys, tokens): the tokens of all texts of each key. Words are counted by key before they are shuffled."""
    words = df.select(*keys, F.explode(split_words(F.col(text).cast("string"))).alias("word")).groupBy(*keys, "word").count()
    sizes = encode_words(words.select("word").distinct(), folder, vocabulary).select("word", F.size("ids").alias("n"))
    return words.join(sizes, "word").groupBy(*keys).agg(F.sum(F.col("count") * F.col("n")).alias("tokens"))
