"""Entities, entity pairs, goals and replies read from text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of entity types in the order in which they claim a place, and two gazetteers.
ENTITY_PATTERNS = [
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"), ("URL", r"https?://\S+"), ("DATE", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"), ("TIME", r"\b\d{1,2}:\d{2}\b"), ("PHONE", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"),
    ("PERCENTAGE", r"\b\d+(?:\.\d+)?%"), ("MONEY", r"\$\d+(?:\.\d+)?\b"), ("NUMBER", r"\b\d+(?:\.\d+)?\b"), ("HASHTAG", r"#[A-Za-z][A-Za-z0-9_]*"), ("MENTION", r"@[A-Za-z][A-Za-z0-9_]*"),
]
LANGUAGES = ["Python", "JavaScript", "TypeScript", "Java", "C++", "C#", "Go", "Rust", "Swift", "Kotlin", "Ruby", "PHP", "SQL", "R", "MATLAB", "Scala", "Perl", "Haskell", "Clojure", "Erlang", "Elixir", "Julia"]
TECHNIQUES = ["Neural Network", "Deep Learning", "Machine Learning", "Natural Language Processing", "Computer Vision", "Reinforcement Learning", "Transformer", "BERT", "GPT", "CNN", "RNN", "LSTM", "GAN", "Decision Tree", "Random Forest", "SVM", "K-means", "PCA", "t-SNE", "XGBoost"]
PAIR = r"(?i)(?:connection|relationship|relation)\s+between\s+([^,]+?)\s+and\s+([^?.]+)"
PAIR_AGAIN = r"(?i)(?:how\s+are|what\s+connects|is\s+there\s+a\s+connection\s+between)\s+([^,]+?)\s+and\s+([^?.]+)"


def entities(text: Column) -> Column:
    """An array of (type, value). A type gets what no type before it has taken: taken text is blanked first."""
    rest, out = F.coalesce(text, F.lit("")), []

    def typed(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))

    for kind, p in ENTITY_PATTERNS:
        out.append(typed(kind, F.regexp_extract_all(rest, F.lit(p), F.lit(0))))
        rest = F.regexp_replace(rest, p, " ")
    return F.concat(*out)


def _quoted(word: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != " " else c for c in word)


def domain_terms(text: Column) -> Column:
    """An array of (type, value): programming languages (in their own case) and machine-learning terms (in any)."""
    languages = r"(?<![\p{L}\p{N}_])(" + "|".join(map(_quoted, sorted(LANGUAGES, key=len, reverse=True))) + r")(?![\p{L}\p{N}_+#])"
    techniques = r"(?i)(?<![\p{L}\p{N}_])(" + "|".join(map(_quoted, sorted(TECHNIQUES, key=len, reverse=True))) + r")(?![\p{L}\p{N}_])"
    t = F.coalesce(text, F.lit(""))
    one = F.transform(F.regexp_extract_all(t, F.lit(languages), F.lit(1)), lambda v: F.struct(F.lit("PROGRAMMING_LANGUAGE").alias("type"), v.alias("value")))
    two = F.transform(F.regexp_extract_all(t, F.lit(techniques), F.lit(1)), lambda v: F.struct(F.lit("AI_ML_TERM").alias("type"), v.alias("value")))
    return F.concat(one, two)


def entity_pair(query: Column) -> Column:
    """A struct (start, goal) that a question asks to connect; null if it names no two."""
    both = [F.when(query.rlike(p), F.struct(F.trim(F.regexp_extract(query, p, 1)).alias("start"), F.trim(F.regexp_extract(query, p, 2)).alias("goal"))) for p in (PAIR, PAIR_AGAIN)]
    return F.coalesce(*both)


def fact_of_question(question: Column) -> Column:
    """A struct (s, r, o) that a why-question takes for true: `X is Y`, `X has Y`, else its first three words."""
    t = F.trim(F.replace(F.replace(F.lower(question), F.lit("why "), F.lit("")), F.lit("?"), F.lit("")))
    words = F.split(t, r"\s+")

    def fact(p: str, r: str) -> Column:
        return F.when(t.rlike("^" + p), F.struct(F.regexp_extract(t, "^" + p, 1).alias("s"), F.lit(r).alias("r"), F.regexp_extract(t, "^" + p, 2).alias("o")))

    rest = F.when(F.size(words) >= 3, F.struct(F.get(words, F.lit(0)).alias("s"), F.get(words, F.lit(1)).alias("r"), F.get(words, F.lit(2)).alias("o")))
    return F.coalesce(fact(r"(\w+)\s+is\s+(\w+)", "is_a"), fact(r"(\w+)\s+has\s+(\w+)", "has_property"), rest)


def marked_facts(text: Column, marker: str) -> Column:
    """An array of (s, r, o): the first three words of each line that begins with the marker."""
    lines = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), "\n"), lambda x: x.startswith(marker))
    words = F.transform(lines, lambda x: F.split(F.trim(F.substring(x, len(marker) + 1, 2**31 - 1)), r"\s+"))
    return F.transform(F.filter(words, lambda w: F.size(w) >= 3), lambda w: F.struct(F.get(w, F.lit(0)).alias("s"), F.get(w, F.lit(1)).alias("r"), F.get(w, F.lit(2)).alias("o")))


def reply_importance(reply: Column) -> Column:
    """The first number like 0.7 in a model's reply, 0.5 without one."""
    return F.coalesce(F.regexp_extract(reply, r"(0\.\d+)", 1).try_cast("double"), F.lit(0.5))


def reply_scores(reply: Column) -> Column:
    """An array of (item, score) of a JSON list in a model's reply; null where it isn't one."""
    return F.from_json(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), "array<struct<item: int, score: double>>")


def reply_emotion(reply: Column, other: Column) -> Column:
    """A struct like `other` (an emotion) from the JSON object of a model's reply, fenced or not; other where it has none.

    Fields the reply leaves out are 0, confidence 0.5.
    """
    plain = F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    told = F.from_json(plain, "primary_emotion string, intensity double, valence double, arousal double, confidence double")
    part = lambda name, empty=0.0: F.coalesce(told[name], F.lit(empty)).alias(name)
    own = F.struct(told["primary_emotion"].alias("primary"), part("intensity"), part("valence"), part("arousal"), part("confidence", 0.5))
    return F.when(told["primary_emotion"].isNotNull(), own).otherwise(other)


def reply_or(reply: Column, other: Column, most: float = 1.1) -> Column:
    """A model's summary if it is there and at most 1.1 times as long as the other one, else the other one."""
    return F.when(reply.isNotNull() & (F.trim(reply) != "") & (F.length(reply) <= F.length(other) * most), reply).otherwise(other)


def persona_prompt(parts: list[Column]) -> Column:
    """Sections of a system prompt, those that are there, apart by a blank line."""
    return F.concat_ws("\n\n", *[F.when(F.trim(p) != "", p) for p in parts])


def boundary_crossed(text: Column, boundary: Column) -> Column:
    """`exact`, `keyword_overlap` or null: whether a text touches a boundary of at most two words, or of more."""
    low, words = F.lower(boundary), F.array_distinct(F.split(F.lower(F.trim(boundary)), r"\s+"))
    share = F.size(F.array_intersect(words, F.split(F.lower(text), r"\s+"))) / F.size(words)
    return F.when((F.size(words) <= 2) & F.lower(text).contains(low), "exact").when((F.size(words) > 2) & (share > 0.5), "keyword_overlap")


def trigger_met(stage: Column, trust: Column, valence: Column, least_stage: Column, least_trust: Column, least_valence: Column) -> Column:
    """Whether a persona's rule fires: every limit that is set is met; stages by their order."""
    order = F.array(*map(F.lit, ["introduction", "acquaintance", "developing", "established", "deep"]))
    at = lambda s: F.array_position(order, F.lower(s))
    return (least_stage.isNull() | (at(stage) >= at(least_stage))) & (least_trust.isNull() | (F.coalesce(trust, F.lit(0.0)) >= least_trust)) & (least_valence.isNull() | valence.isNull() | (valence >= least_valence))


def pattern_key(types: Column, path: Column) -> Column:
    """The md5 of a reasoning pattern: its distinct types in order, then its path."""
    return F.md5(F.concat_ws("|", F.array_join(F.array_sort(F.array_distinct(types)), ","), F.array_join(path, ">")))


def hit_rate(hits: Column, misses: Column) -> Column:
    """Hits in a hundred; 0 without any."""
    return F.when(hits + misses > 0, hits * 100.0 / (hits + misses)).otherwise(0.0)


def profile_summary(name: Column, interests: Column, preferences: Column, routines: Column, boundaries: Column) -> Column:
    """A profile in words: at most ten interests and five preferences and routines, the number of boundaries."""
    line = lambda label, c, n: F.when(F.size(c) > 0, F.concat(F.lit(label + ": "), F.array_join(F.slice(c, 1, n), ", ")))
    text = F.concat_ws("\n", F.when(name.isNotNull(), F.concat(F.lit("Name: "), name)), line("Interests", interests, 10), line("Preferences", preferences, 5), line("Routines", routines, 5), F.when(F.size(boundaries) > 0, F.concat(F.lit("Boundaries: "), F.size(boundaries).cast("string"), F.lit(" recorded"))))
    return F.when(text == "", "No profile information yet.").otherwise(text)
