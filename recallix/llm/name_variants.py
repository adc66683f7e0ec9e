"""Variant spellings of persons' and organisations' names: suffix blocking and subsequence ratios."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallix.functions.similarity import common_subsequence, ratio
from recallix.operators.components import components
from recallix.session import checkpoint

#: What types of entities are called.
PERSON_TYPES = {"person", "per", "people", "human", "individual", "persons"}
FIRM_TYPES = {"organization", "organisation", "org", "company", "firm", "corporation", "organizations", "organisations", "business"}
#: Titles and name suffixes of persons.
TITLES = {"dr", "prof", "professor", "doctor", "mr", "mrs", "ms", "miss", "mx", "sir", "dame", "lord", "lady", "herr", "frau", "jr", "sr", "ii", "iii", "phd", "md", "ing", "dipl", "rev", "hon", "capt", "sra", "mme", "mlle"}
#: Legal forms and words without weight in firms' names.
LEGAL = {"inc", "incorporated", "ltd", "limited", "corp", "corporation", "company", "co", "gmbh", "mbh", "ag", "group", "plc", "llc", "llp", "lp", "sa", "spa", "srl", "bv", "nv", "kg", "ohg", "se", "oy", "ab", "as", "holding", "holdings", "the", "and"}
#: Legal forms written in several ways; `group` and `holding` say nothing of the form.
FORMS = {"incorporated": "inc", "limited": "ltd", "corporation": "corp", "co": "company", "mbh": "gmbh"}
#: What firms do, with common abbreviations that are no prefix of the word.
TRADES = {
    "university": "univ", "publishing": "publ", "consulting": "cons", "foundation": "fdn", "development": "dev", "telecommunications": "telecom", "ceramics": "cer", "construction": "constr", "association": "assoc",
    "management": "mgmt", "brothers": "bros", "shipping": "shpg", "instruments": "instr", "chemicals": "chem", "breweries": "brew", "engineering": "eng", "furniture": "furn", "museum": "mus", "technologies": "tech",
    "textiles": "text", "laboratories": "labs", "logistics": "log", "railways": "rlwys", "services": "svcs", "institute": "inst", "hospital": "hosp", "insurance": "ins", "electronics": "elec", "international": "intl",
    "manufacturing": "mfg", "foods": "fds", "pharmaceuticals": "pharma", "industries": "ind", "systems": "sys", "bank": "bk", "partners": "ptnrs", "media": "med", "energy": "enrg", "motors": "mtrs", "airlines": "airl",
}
SHORT_TRADES = {short: word for word, short in TRADES.items()}
#: Words that tell places, concepts, products, awards and events from persons and firms.
OTHERS = {"port", "junction", "bay", "heights", "valley", "fair", "effect", "theory", "method", "medal", "prize", "award", "festival", "conference", "summit", "lake", "mount", "river", "island", "principle", "law", "paradox"}
#: The least subsequence ratio of two spellings of one name; of a surname that comes with an initial only; of a word.
NAME, BARE, WORD = 0.83, 0.88, 0.78


def plain(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c)).replace("ß", "ss").replace("ł", "l").replace("ø", "o").replace("đ", "d")


class Reader:
    """Reads names with a list of given names and their short forms."""

    def __init__(self, names: list[tuple[str, str]], more: list[str] = ()):
        self.full: set[str] = set(more)
        self.short: dict[str, set[str]] = {}
        for given, short in names:
            if given:
                g = plain(given)
                self.full.add(g)
                if short and plain(short) != g:
                    self.short.setdefault(plain(short), set()).add(g)
        self.seen: dict[str, tuple[str, bool]] = {}

    def given(self, token: str) -> tuple[str, bool]:
        """The full given name(s) a token stands for, joined by |, and whether it is known; itself if it isn't."""
        if token not in self.seen:
            if token in self.full:
                found = token, True
            elif token in self.short:
                found = "|".join(sorted(self.short[token])), True
            elif len(token) >= 3 and any(f.startswith(token) and len(f) - len(token) > 1 for f in self.full):
                found = token, False
            else:
                best = max(((ratio(token, f), f) for f in self.full if abs(len(f) - len(token)) <= 2), default=(0.0, ""))
                near = max(((ratio(token, f), f) for f in self.short if len(f) > 3 and abs(len(f) - len(token)) <= 1), default=(0.0, ""))
                found = (best[1], True) if len(token) >= 4 and best[0] >= WORD and best[0] >= near[0] else ("|".join(sorted(self.short[near[1]])), True) if len(token) >= 4 and near[0] >= 0.85 else (token, False)
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[token] = found
        return self.seen[token]

    def trade(self, token: str) -> str:
        """What a firm does, if the token says so."""
        if token in TRADES:
            return token
        if token in SHORT_TRADES:
            return SHORT_TRADES[token]
        begun = [w for w in TRADES if w.startswith(token)]
        if len(begun) == 1 and len(token) >= 3:
            return begun[0]
        if len(token) < 5:
            return ""
        best = max((ratio(token, w), w) for w in TRADES)
        return best[1] if best[0] >= 0.8 else ""

    def read(self, entity: str | None, kind: str | None) -> tuple[str, str, str, str, str] | None:
        """(kind P or O, name, field, how, form) of a name; None if it names neither a person nor a firm.

        name is the surname or the firm's own word, field the given name or the trade; how is `full` or `part` (an
        initial, an unlisted given name, or no trade); form is the legal form of a firm.
        """
        if not entity:
            return None
        k = plain(kind or "").strip()
        if k and k not in PERSON_TYPES and k not in FIRM_TYPES:
            return None
        text = re.sub(r"\b([a-z])\.? ?([a-z])\.? ?([a-z])\.? ?([a-z])\b\.?", lambda m: "".join(m.groups()) if "".join(m.groups()) == "gmbh" else m[0], plain(re.sub(r"(?<=[a-z]{3})(?=[A-Z][a-z]{3})", " ", entity)))
        text = re.sub(r"\b(a\.? ?g\b\.?|m\.? b\.? h\b\.?)(?=\s*$)", lambda m: re.sub(r"[. ]", "", m[0]), text) if k in FIRM_TYPES or not k else text
        comma = "," in text
        tokens = re.findall(r"[^\W_]+", text.replace("'", "").replace("’", ""))
        if not tokens:
            return None
        firm = k in FIRM_TYPES
        if not k:
            if any(t in OTHERS for t in tokens) or any(re.search(r"\d", t) for t in tokens):
                return None
            firm = any(t in LEGAL for t in tokens[1:]) or any(t in TRADES or t in SHORT_TRADES for t in tokens)
        return self._firm(tokens) if firm else self._person(tokens, comma)

    def _firm(self, tokens: list[str]) -> tuple[str, str, str, str, str] | None:
        trades, rest, legal = [], [], []
        for t in tokens:
            if t in LEGAL:
                legal.append(t)
            elif w := self.trade(t):
                trades.append(w)
            else:
                rest.append(t)
        name = "".join(rest) or "".join(tokens)
        form = next((FORMS.get(t, t) for t in legal if t not in ("the", "and", "group", "holding", "holdings")), "")
        return ("O", name, trades[0] if trades else "", "full" if trades else "part", form)

    def _person(self, tokens: list[str], comma: bool) -> tuple[str, str, str, str, str] | None:
        tokens = [t for t in tokens if t not in TITLES]
        long = [t for t in tokens if len(t) > 1]
        if not long:
            return None
        initials = [t for t in tokens if len(t) == 1]
        known = [(i, self.given(t)[0]) for i, t in enumerate(long) if self.given(t)[1]]
        if known and len(long) > 1:
            # A comma puts the surname first; else an exact given name wins over a likeness.
            exact = [x for x in known if long[x[0]] in self.full or long[x[0]] in self.short]
            i, given = (exact or known)[-1 if comma else 0]
            return ("P", "".join(t for j, t in enumerate(long) if j != i), given, "full", "")
        if len(long) == 1:
            return ("P", long[0], initials[0], "part", "") if initials else None
        first, last = (long[-1], long[:-1]) if comma else (long[0], long[1:])
        if len(first) > 8 and len(last) == 1 and len(last[0]) < 8:
            first, last = last[0], [first]
        return ("P", "".join(last), first, "part", "")


def same_name(kind: str, a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> int:
    """4 if two (name, field, how, form) surely name the same one, 3 to 1 if they may (the better the more), else 0.

    What may be one: an initial or short form and a given name (3 if it begins with it, 2 if it begins alike, 1 if
    most letters are in it), a firm without and with its trade (3 if the legal forms are equal, 1 if they differ).
    """
    (name, field, how, form), (name2, field2, how2, form2) = a, b
    if how == how2 == "full":
        return 4 * bool(set(field.split("|")) & set(field2.split("|")) and ratio(name, name2) >= NAME)
    if ratio(name, name2) < BARE:
        return 0
    if kind == "O":
        return 2 if not form or not form2 else 3 if form == form2 else 1
    if how == how2:
        return 4 * (field[0] == field2[0] and (len(field) == 1 or len(field2) == 1 or ratio(field, field2) >= WORD))
    part, wholes = (field, field2.split("|")) if how == "part" else (field2, field.split("|"))
    if any(w.startswith(part) for w in wholes):
        return 3
    if len(part) > 1 and any(w[0] == part[0] for w in wholes):
        return 2
    return int(len(part) > 1 and any(common_subsequence(part, w) >= 0.5 * len(part) for w in wholes))


def block_keys(kind: str, name: str, deep: int = 2, longest: int = 16) -> list[str]:
    """Suffixes of the name and of its reverse (its starts), and the name without some of its letters.

    Names with a ratio of NAME at least lose at most n * (1 - NAME / (2 - NAME)) of their n letters to the common
    subsequence: one letter from 4 on, two from 7, three from 11. A name of up to `longest` letters is put under all
    it becomes without that many letters, `deep` at most; so names of up to 10 letters meet for sure, and up to
    `longest` if neither loses more than two. Suffixes and starts have six letters, shortened by 0, 1, 2, ... letters.
    """
    keys = {f"{kind}s:{name[max(0, z - 6) : z]}" for z in range(max(5, len(name) - 6), len(name) + 1)} | {f"{kind}r:{name[a : a + 6]}" for a in range(max(1, min(7, len(name) - 4)))}
    if len(name) <= longest:
        for gone in range(min(deep, int(len(name) * (1 - NAME / (2 - NAME)) + 1e-9)) + 1):
            keys.update(f"{kind}d:{''.join(c)}" for c in itertools.combinations(name, len(name) - gone))
    return sorted(keys)


def likeness(name: str, others: list[str]) -> np.ndarray:
    """The subsequence ratio of a name of at most 64 letters to each of the others, by one bit-parallel addition for all."""
    letters = np.array([ord(c) for c in name], "i8")
    width = max(map(len, others), default=0)
    text = np.array(others, dtype=f"U{max(1, width)}").view("u4").reshape(len(others), -1) if others else np.zeros((0, 1), "u4")
    kinds, at = np.unique(text, return_inverse=True)
    masks = np.zeros(len(kinds), "u8")
    for i, c in enumerate(letters):
        masks[kinds == c] |= np.uint64(1) << np.uint64(i)
    at, full = at.reshape(text.shape), np.uint64((1 << len(name)) - 1)
    left = np.full(len(others), full, "u8")
    for p in range(width):
        u = left & masks[at[:, p]]
        left = (left + u) | (left - u)
    common = len(name) - np.bitwise_count(left & full).astype("i8")
    return 2 * common / (len(name) + np.array([len(o) for o in others], "i8"))


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns rows (key, block, kind, name) sorted by key and block into the pairs (kind, name, name2) that are close enough."""
    seen: dict[tuple[str, str], bool] = {}

    def close(x: str, y: str) -> bool:
        if (x, y) not in seen:
            if len(seen) > 500_000:
                seen.clear()
            seen[x, y] = 2 * min(len(x), len(y)) >= NAME * (len(x) + len(y)) - 1e-9 and ratio(x, y) >= NAME
        return seen[x, y]

    def pairs(names: list[str], first: int) -> Iterator[tuple[str, str]]:
        """first names of one block against the rest, of another one; all against all if first is 0."""
        if len(names) <= 24:
            for i, x in enumerate(names[: first or None]):
                yield from ((x, y) for y in names[max(i + 1, first) :] if (close(x, y) if x < y else close(y, x)))
            return
        if not first:
            names = sorted(names, key=len)
        size = np.array([len(n) for n in names])
        for i, x in enumerate(names[: first or None]):
            to = np.arange(max(i + 1, first), len(names))
            to = to[2 * np.minimum(size[to], len(x)) >= NAME * (size[to] + len(x)) - 1e-9]
            if len(to) and len(x) <= 64:
                to = to[likeness(x, [names[j] for j in to]) >= NAME - 1e-12]
            else:
                to = [j for j in to if ratio(x, names[j]) >= NAME]
            yield from ((x, names[j]) for j in to)

    def flush(kind: str, names: list[str], blocks: list[int]) -> Iterator[pa.RecordBatch]:
        first = blocks.index(blocks[-1]) if blocks[0] != blocks[-1] else 0
        out = [(x, y) if x < y else (y, x) for x, y in pairs(names, first)]
        for i in range(0, len(out), 50_000):
            part = out[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(part)), pa.array([x for x, _ in part]), pa.array([y for _, y in part])], names=["kind", "name", "name2"])

    last, held = None, ("", [], [])
    for batch in batches:
        for key, block, kind, name in zip(*(batch.column(c).to_pylist() for c in ("key", "block", "kind", "name"))):
            if key != last:
                if len(held[1]) > 1:
                    yield from flush(*held)
                last, held = key, (kind, [], [])
            held[1].append(name)
            held[2].append(block)
    if len(held[1]) > 1:
        yield from flush(*held)


def common_given_names(df: DataFrame, listed: list[str], share: float = 0.35, most: int = 50_000) -> list[str]:
    """Given names the list lacks: words that stand first in persons' names about as often as the listed ones.

    What counts is with how many different last words: those with at least `share` times the median of the listed
    names, 3 at least (more than `most` such words are an error). Spelling errors, short forms and surnames have far
    fewer.
    """
    person = F.lower(F.trim("entity_type")).isin(*PERSON_TYPES) & ~F.col("entity").contains(",")
    words = F.filter(F.regexp_extract_all(F.lower("entity"), F.lit(r"(\p{L}{3,})"), F.lit(1)), lambda w: ~w.isin(*TITLES))
    pairs = df.where(person).select(words.alias("w")).where(F.size("w") >= 2).select(F.get("w", F.lit(0)).alias("token"), F.element_at("w", -1).alias("last"))
    tokens = pairs.groupBy("token").agg(F.count_distinct("last").alias("count"))
    own = sorted(r[0] for r in tokens.where(F.col("token").isin([g.lower() for g in listed])).select("count").collect())
    if not own:
        return []
    least = max(3.0, share * own[len(own) // 2])
    more = tokens.where(F.col("count") >= least).select("token").limit(most + 1).collect()
    if len(more) > most:
        raise ValueError(f"more than {most} given names")
    return sorted(plain(r[0]) for r in more)


def name_variants(df: DataFrame, names: DataFrame, most: int = 2000) -> DataFrame:
    """(id, group): the rows that name the same person or organisation, with the smallest id of their group.

    df has id (bigint), entity and entity_type; names has given and short_form (a bounded dictionary of given
    names: more than 50,000 are an error). Rows of other types than persons and organisations have no group.

    A name is read into a surname and a given name (in full, by a listed short form, or as a likeness of one), or
    a firm's own word and its trade; case, accents, titles, order, legal forms and middle initials don't count.
    Equal readings are one node. Suffix blocking: suffixes of the distinct surnames or own words and of
    their reverse, of at least 5 letters, are indexed, and what names of up to 16 letters are without one or two of
    their letters (block_keys); those of one block are compared by the ratio of their longest common subsequence. A block
    of more than `most` names is compared in pairs of smaller blocks, so no task holds more than about `most`; none is
    discarded. Of close names, nodes with a full given name or trade are
    compared if they share one of its readings, all others with every node. Full names that agree are linked; a name with an initial, an unlisted given name or no
    trade joins the group it fits best, if that is one alone.

    Defined cases: null or empty entities and null ids have no group; a null type is read from the name; repeated
    rows come out as one; an empty table gives no rows; other columns play no part.
    """
    known = [(r[0], r[1]) for r in names.select("given", "short_form").where("given is not null").distinct().limit(50_001).collect()]
    if len(known) > 50_000:
        raise ValueError("more than 50,000 given names")

    more = common_given_names(df, [g for g, _ in known])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(known, more)
        for b in batches:
            got = [(i, *r) for i, e, t in zip(b["id"], b["entity"], b["entity_type"]) if (r := reader.read(e, t))]
            yield pd.DataFrame(got, columns=["id", "kind", "name", "field", "how", "form"])

    rows = df.select(F.col("id").cast("bigint"), F.col("entity").cast("string"), F.col("entity_type").cast("string")).where("id is not null and entity is not null")
    rows = rows.mapInPandas(read, "id bigint, kind string, name string, field string, how string, form string")
    rows = checkpoint(rows.select("id", F.struct("kind", "name", "field", "how", "form").alias("read")))
    nodes = checkpoint(rows.groupBy("read").agg(F.min("id").alias("node")))

    @F.pandas_udf("array<string>")
    def keys(kind: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([block_keys(*x) for x in zip(kind, name)])

    # Names are few bytes and much work: they are dealt to a given number of tasks. The index is shuffled once; what is
    # left of it are the keys of two names or more.
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    index = nodes.select("read.kind", "read.name").distinct().repartition(tasks, "name").select("kind", "name", F.explode(keys("kind", "name")).alias("key"))
    index = index.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    index = checkpoint(index.select("kind", "name", "key", F.when(F.col("n") <= most, 1).otherwise(F.ceil(2 * F.col("n") / most)).cast("int").alias("parts")))
    # A large block is dealt into blocks of about half `most` names, and each pair of blocks is a group of its own.
    block = F.pmod(F.hash("name"), F.col("parts"))
    spread = index.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    group = F.xxhash64("key", F.least("block", "with"), F.greatest("block", "with"))
    spread = spread.select(group.alias("key"), "block", "kind", "name").repartition(2 * tasks, "key").sortWithinPartitions("key", "block")
    near = spread.mapInArrow(_alike, "kind string, name string, name2 string").distinct()
    near = near.select("kind", F.explode(F.array(F.struct("name", "name2"), F.struct(F.col("name2").alias("name"), F.col("name").alias("name2")))).alias("x")).select("kind", "x.name", "x.name2")
    near = checkpoint(near.unionByName(nodes.select("read.kind", "read.name", F.col("read.name").alias("name2")).distinct()))

    left = nodes.select("node", "read", "read.kind", "read.name")
    right = nodes.select(F.col("node").alias("node2"), F.col("read").alias("read2"), "read.kind", F.col("read.name").alias("name2"))
    of = lambda read: F.explode(F.array_distinct(F.split(F.col(read)["field"], r"\|"))).alias("of")
    full = left.where("read.how = 'full'").select("*", of("read")).join(near, ["kind", "name"]).join(right.where("read2.how = 'full'").select("*", of("read2")), ["kind", "name2", "of"]).where("node < node2").select("node", "node2", "read", "read2")
    part = left.where("read.how = 'part'").join(near, ["kind", "name"]).join(right, ["kind", "name2"]).where("node < node2 or node > node2 and read2.how = 'full'").select("node", "node2", "read", "read2")
    close = full.unionByName(part).dropDuplicates(["node", "node2"])

    @F.pandas_udf("int")
    def judge(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        both = (zip(x["name"], x["field"], x["how"], x["form"]) for x in (a, b))
        return pd.Series([same_name(k, x, y) for k, x, y in zip(a["kind"], *both)], dtype="int32")

    judged = checkpoint(close.withColumn("same", judge("read", "read2")).where("same > 0").select("node", "node2", "same", F.col("read.how").alias("how"), F.col("read2.how").alias("how2")))
    strong = components(judged.where("same = 4"), "node", "node2")
    group = nodes.join(strong.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("node", F.coalesce("component", "node").alias("component"))
    # A part goes with what it fits best: full names before parts, then the better likeness. Parts that are linked
    # among themselves go together.
    weak = judged.where("same < 4")
    rank = lambda of: F.when(F.col(of) == "full", 10).otherwise(0) + F.col("same")
    either = weak.where("how = 'part'").select(F.col("node").alias("part"), F.col("node2").alias("whole"), rank("how2").alias("rank")).unionByName(weak.where("how2 = 'part'").select(F.col("node2").alias("part"), F.col("node").alias("whole"), rank("how").alias("rank")))
    fits = either.join(group.select(F.col("node").alias("whole"), "component"), "whole").join(group.select(F.col("node").alias("part"), F.col("component").alias("mine")), "part").where("component <> mine")
    best = fits.groupBy("mine", "rank").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    one = best.groupBy("mine").agg(F.max_by(F.struct("least", "most"), "rank").alias("b")).where("b.least = b.most").select("mine", F.col("b.least").alias("to"))
    joined = components(one, "mine", "to")
    final = group.join(joined.select(F.col("node").alias("j"), F.col("component").alias("top")), F.col("component") == F.col("j"), "left").select("node", F.coalesce("top", "component").alias("group"))
    forms = nodes.join(final, "node").select("read", "group")
    out = rows.join(forms, "read").select("id", "group").distinct()
    return out.join(out.groupBy("group").count().where("count > 1").select("group"), "group").select("id", "group")
