"""Conversation memory: context under a token budget, tiers, extractive compression, adaptive weights.

Folds over the messages of one conversation read them as they come, sorted, from a shuffle by conversation: what is held
is the state of the fold, never a conversation as one row. What can be summed or ranked is done by aggregates.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallix.functions import text as X
from recallix.operators.hot import running_totals

_PERSONAL = re.compile(X.PERSONAL_HINT)
_CODE = re.compile(r"```[\s\S]*?```")


@dataclass(frozen=True)
class Segment:
    """A message as memory keeps it; at is its time, pos its place."""

    pos: int
    role: str
    text: str
    importance: float
    tokens: int
    at: float


def fill_context(messages: DataFrame, keys: list[str], order: str, tokens: str, budget: int, base: int = 50_000) -> DataFrame:
    """The messages from the first on whose tokens fit the budget together, with `used`, the running sum.

    It stops at the first message that doesn't fit; running sums only grow, so that is a filter. order is a bigint.
    """
    return running_totals(messages, keys, order, {"used": tokens}, base).where(F.col("used") <= budget)


def _folded(rows: DataFrame, key: str, order: str, fold: Callable[[Iterator[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """Runs fold over the rows of each key, in order, and gives what it yields with the key in front.

    Rows are shuffled by key and sorted, and reach the fold batch by batch.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    size = 5_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = (r for b in batches for r in b.to_dict("records"))
        out: list[tuple] = []
        for k, group in itertools.groupby(stream, key=lambda r: r[key]):
            for made in fold(group):
                out.append((k, *made))
                if len(out) >= size:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return rows.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def truncated(text: str, ratio: float) -> str:
    return text if ratio >= 1 else text[: int(len(text) * ratio)] + "..."


def extract(text: str, ratio: float, most: int = 10) -> str:
    """The sentences with most of the key words, best first, until the first that doesn't fit the ratio."""
    if not text or ratio >= 1:
        return text
    words = [w for w in re.findall(r"\b\w+\b", _CODE.sub("", text).lower()) if w not in X.KEYWORD_STOPS and len(w) > 2]
    keys = [w for w, _ in Counter(words).most_common(most)]  # ties in order of appearance
    kept_whole = _CODE.findall(text) + re.findall(r"\$\$[\s\S]*?\$\$", text)

    def score(sentence: str) -> float:
        if any(k in sentence for k in kept_whole) or _PERSONAL.search(sentence):
            return 10.0
        return float(sum(k in sentence.lower() for k in keys))

    out, room = [], int(len(text) * ratio)
    for s in sorted(re.split(r"(?<=[.!?])\s+", text), key=score, reverse=True):
        if len(s) > room:
            break
        out.append(s)
        room -= len(s)
    return " ".join(out) if out else truncated(text, ratio)


def compress(s: Segment, ratio: float) -> Segment:
    """A shorter segment: important ones keep nine tenths; code and short ones are cut, others extracted."""
    ratio = max(0.9, ratio) if s.importance >= 8 else ratio
    text = truncated(s.text, ratio) if s.role == "code" or len(s.text.split()) < 30 else extract(s.text, ratio)
    return replace(s, text=text, tokens=int(s.tokens * len(text) / len(s.text)) if s.text else 0)


class Tiers:
    """Active, working and archive tiers with token limits; the least important and oldest go down first."""

    NAMES = ("active", "working", "archive")

    def __init__(self, limits: tuple[int, int, int]):
        self.limits = limits
        self.tiers: list[list[Segment]] = [[], [], []]
        self.sums = [0, 0, 0]
        self.dropped: list[Segment] = []

    def used(self, i: int) -> int:
        return self.sums[i]

    def _full(self, i: int) -> bool:
        return self.used(i) >= self.limits[i]

    def _put(self, i: int, s: Segment) -> bool:
        fits = self.used(i) + s.tokens <= self.limits[i]
        if fits:
            self.tiers[i].append(s)
            self.sums[i] += s.tokens
        return fits

    def _least(self, i: int) -> Segment | None:
        """The segment that goes next; system messages and those of importance 9 or more never do."""
        free = [s for s in self.tiers[i] if s.role != "system" and s.importance < 9]
        if not free:
            return None
        s = min(free, key=lambda s: (s.importance, s.at, s.pos))
        self.tiers[i].remove(s)
        self.sums[i] -= s.tokens
        return s

    def _tidy(self, i: int) -> None:
        """Moves segments of a full tier down; of the last, drops them."""
        while self._full(i) and (s := self._least(i)):
            if i == 2:
                self.dropped.append(s)
            else:
                small = compress(s, 0.3)
                if not self._put(2, small):
                    self._tidy(2)
                    if not self._put(2, small):
                        self.dropped.append(s)

    def add(self, s: Segment) -> None:
        """Adds a message; makes room in the active tier for it by compressing others down."""
        while (self._full(0) or self.limits[0] - self.used(0) < s.tokens) and (old := self._least(0)):
            small = compress(old, 0.5)
            if not self._put(1, small):
                self._tidy(1)
                if not self._put(1, small):
                    small = compress(small, 0.5)
                    if not self._put(1, small) and not self._put(2, compress(small, 0.3)):
                        self.dropped.append(old)
        if not self._put(0, s):
            self.dropped.append(s)
        self._tidy(1)


def _segment(m: dict) -> Segment:
    at = m["at"]
    return Segment(int(m["pos"]), m["role"] or "", m["content"] or "", float(m["importance"]), int(m["tokens"]), 0.0 if at is None or at != at else float(at))


def conversations(messages: DataFrame) -> DataFrame:
    """(episode, pos, role, content, importance, tokens, at): messages as the folds take them."""
    return messages.select("episode", F.col("pos").cast("int").alias("pos"), "role", "content", X.message_importance(F.col("role"), F.col("content")).alias("importance"), X.token_estimate(F.col("content")).alias("tokens"), "at")


def tier_cascade(talks: DataFrame, limits: tuple[int, int, int] = (512, 1024, 2048)) -> DataFrame:
    """(episode, pos, tier, tokens, text): where each message ends up; tier is `dropped` for those that fit nowhere.

    What the tiers hold is bounded by their limits; dropped messages leave the fold at once.
    """

    def run(messages: Iterator[dict]) -> Iterator[tuple]:
        memory = Tiers(limits)
        for m in messages:
            memory.add(_segment(m))
            for s in memory.dropped:
                yield s.pos, "dropped", s.tokens, s.text
            memory.dropped.clear()
        for name, tier in zip(Tiers.NAMES, memory.tiers):
            for s in tier:
                yield s.pos, name, s.tokens, s.text

    return _folded(talks, "episode", "pos", run, "episode bigint, pos int, tier string, tokens int, text string")


def compress_to_budget(segments: list[Segment], budget: int, now: float) -> list[Segment]:
    """Segments made shorter, the least important and oldest first, until they fit the budget; then once more."""
    total = sum(s.tokens for s in segments)
    if total <= budget:
        return list(segments)
    ratio, out = budget / total, list(segments)
    order = sorted(range(len(segments)), key=lambda i: (segments[i].importance, segments[i].at, segments[i].pos))
    for again in (False, True):
        for i in order:
            if total <= budget:
                return out
            if again and out[i] is not segments[i]:
                continue
            s = segments[i]
            share = min(1.0, max(0.2, ratio * 0.7)) if again else min(1.0, max(0.3, ratio + s.importance / 20)) * (0.8 if now - s.at > 3600 else 1.0)
            out[i] = compress(s, share)
            total -= s.tokens - out[i].tokens
    return out


def progressive(talks: DataFrame, budget: int = 60) -> DataFrame:
    """(episode, before, after): tokens of each conversation before and after compression to the budget."""

    def run(messages: Iterator[dict]) -> Iterator[tuple]:
        s = [_segment(m) for m in messages]
        now = max((x.at for x in s), default=0.0)
        yield sum(x.tokens for x in s), sum(x.tokens for x in compress_to_budget(s, budget, now))

    return _folded(talks, "episode", "pos", run, "episode bigint, before bigint, after bigint")


#: Shares of the tiers, and of conversations of a kind.
SHARES = (0.25, 0.35, 0.40)
PATTERNS = {"code_heavy": (0.35, 0.35, 0.30), "data_heavy": (0.20, 0.50, 0.30), "qa_conversation": (0.30, 0.30, 0.40), "complex_reasoning": (0.40, 0.40, 0.20)}


#: What a complex or plain query, the kind of a document and sustained complexity move the shares by.
COMPLEX, PLAIN, SUSTAINED = (0.10, 0.05, -0.15), (-0.05, 0.0, 0.05), (0.05, 0.05, -0.10)
KINDS = {"code": (0.05, 0.05, -0.10), "mixed": (0.05, 0.05, -0.10), "data": (-0.05, 0.10, -0.05)}


def optimal_shares(complexity: float, kind: str, sustained: bool) -> tuple[float, ...]:
    """Shares of the tiers for a query's complexity and a document's kind, none below 0.1, summing to 1."""
    moves = [COMPLEX] * (complexity > 0.7) + [PLAIN] * (complexity < 0.3) + ([KINDS[kind]] if kind in KINDS else []) + [SUSTAINED] * sustained
    total = [max(0.1, x + sum(m[i] for m in moves)) for i, x in enumerate(SHARES)]
    return tuple(x / sum(total) for x in total)


def allocate(shares: tuple[float, ...], budget: int, least: int = 1000) -> tuple[int, ...]:
    """Token limits of the tiers: their shares, at least `least` each, scaled down to the budget."""
    out = [max(least, int(budget * s)) for s in shares]
    return tuple(int(x * budget / sum(out)) for x in out) if sum(out) > budget else tuple(out)


def weight_fold(queries: Iterable[tuple[float, str]], rate: float = 0.1) -> tuple[int, tuple[float, ...], str]:
    """The number of (complexity, kind) queries, and the shares and pattern after them: each moves the shares by `rate` to its optimum.

    From the tenth on, every fifth query mixes in the shares of the pattern the history shows.
    """
    shares, kinds, seen, pattern, n = SHARES, Counter(), deque(maxlen=50), "general", 0
    for n, (complexity, kind) in enumerate(queries, 1):
        seen.append(complexity)
        kinds[kind] += 1
        mean = sum(seen) / len(seen)
        best = optimal_shares(complexity, kind, len(seen) > 5 and mean > 0.6)
        shares = tuple(s + rate * (b - s) for s, b in zip(shares, best))
        if n >= 10 and n % 5 == 0:
            total = sum(kinds.values())
            pattern = "code_heavy" if kinds["code"] / total > 0.3 else "data_heavy" if kinds["data"] / total > 0.3 else "complex_reasoning" if mean > 0.7 else "qa_conversation" if mean < 0.4 else "general"
            if pattern in PATTERNS:
                shares = tuple(s + rate * (p - s) for s, p in zip(shares, PATTERNS[pattern]))
    return n, shares, pattern


def dynamic_weights(queries: DataFrame, budget: int = 10_000) -> DataFrame:
    """(episode, queries, active, working, archive, pattern): the tier limits after the queries (episode, pos, complexity, kind)."""

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        n, shares, pattern = weight_fold((float(r["complexity"]), r["kind"]) for r in rows)
        yield n, *allocate(shares, budget), pattern

    return _folded(queries.select("episode", "pos", "complexity", "kind"), "episode", "pos", run, "episode bigint, queries int, active int, working int, archive int, pattern string")


def limits_updated(limits: DataFrame, used: DataFrame, asked: DataFrame, least: int = 1000) -> DataFrame:
    """(key, tier, limit_tokens, accepted): limits (key, tier, limit_tokens) after the asked ones, refused below what is used or `least`."""
    rows = limits.join(used.select("key", "tier", F.col("tokens").alias("used")), ["key", "tier"], "left").join(asked.select("key", "tier", F.col("limit_tokens").alias("new")), ["key", "tier"], "left")
    fine = F.col("new") >= F.greatest(F.coalesce("used", F.lit(0)), F.lit(least))
    return rows.select("key", "tier", F.when(fine, F.col("new")).otherwise(F.col("limit_tokens")).alias("limit_tokens"), F.when(F.col("new").isNotNull(), fine).alias("accepted"))
