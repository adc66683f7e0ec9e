"""A rule engine over facts (s, r, o): patterns with ?variables, forward and backward chaining, abduction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallix.session import checkpoint

Pattern = tuple[str, str, str]


@dataclass(frozen=True)
class Rule:
    """Premises and a conclusion; every variable of the conclusion must occur in a premise."""

    name: str
    premises: tuple[Pattern, ...]
    conclusion: Pattern
    confidence: float = 0.8


def transitive(relation: str, confidence: float = 0.85) -> Rule:
    return Rule(f"{relation}_transitivity", (("?x", relation, "?y"), ("?y", relation, "?z")), ("?x", relation, "?z"), confidence)


def inherited(relation: str, along: str, confidence: float = 0.8) -> Rule:
    return Rule(f"{relation}_inheritance", (("?x", along, "?y"), ("?y", relation, "?p")), ("?x", relation, "?p"), confidence)


def match(facts: DataFrame, pattern: Pattern) -> DataFrame:
    """One column for each variable of the pattern; constants filter, a repeated variable must match itself."""
    out, seen = facts, {}
    for column, term in zip(("s", "r", "o"), pattern):
        if not term.startswith("?"):
            out = out.where(F.col(column) == term)
        elif term in seen:
            out = out.where(F.col(column) == F.col(seen[term]))
        else:
            seen[term] = column
    return out.select(*[F.col(c).alias(v[1:]) for v, c in seen.items()]).distinct()


def match_all(facts: DataFrame, patterns: tuple[Pattern, ...] | list[Pattern]) -> DataFrame:
    """The bindings of a conjunction: a natural join of its patterns on their common variables."""
    out = match(facts, patterns[0])
    for p in patterns[1:]:
        more = match(facts, p)
        shared = [c for c in more.columns if c in out.columns]
        if not shared:
            raise ValueError(f"pattern {p} shares no variable with those before it")
        out = out.join(more, shared)
    return out


def _conclude(bindings: DataFrame, rule: Rule) -> DataFrame:
    term = lambda t: F.col(t[1:]) if t.startswith("?") else F.lit(t)
    s, r, o = map(term, rule.conclusion)
    return bindings.select(s.alias("s"), r.alias("r"), o.alias("o"), F.lit(rule.name).alias("rule"), F.lit(rule.confidence).alias("confidence"))


def forward_chain(facts: DataFrame, rules: list[Rule], rounds: int = 10) -> DataFrame:
    """(s, r, o, rule, confidence, round): facts the rules add, until none is new or `rounds` are over.

    Semi-naive: a rule is tried with each of its premises over the facts of the last round only, the others over
    all. A fact several rules give in one round takes the surest, then the first by name. s = o is left out.
    """
    known = checkpoint(facts.select("s", "r", "o").where("s is not null and r is not null and o is not null").distinct())
    fresh, added = known, None
    for n in range(1, rounds + 1):
        given = None
        for rule in rules:
            for k, new in enumerate(rule.premises):
                if n == 1 and k:
                    break
                bindings = match(fresh, new)
                for i, p in enumerate(rule.premises):
                    if i != k:
                        more = match(known, p)
                        bindings = bindings.join(more, [c for c in more.columns if c in bindings.columns])
                one = _conclude(bindings, rule).where("s <> o")
                given = one if given is None else given.unionByName(one)
        best = given.groupBy("s", "r", "o").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "rule")).alias("b"))
        fresh = checkpoint(best.join(known, ["s", "r", "o"], "left_anti").select("s", "r", "o", F.col("b.rule").alias("rule"), (-F.col("b.c")).alias("confidence"), F.lit(n).alias("round")))
        if fresh.isEmpty():
            break
        added = fresh if added is None else added.unionByName(fresh)
        known = checkpoint(known.unionByName(fresh.select("s", "r", "o")))
    return added if added is not None else fresh


def backward_chain(facts: DataFrame, goals: DataFrame, relation: str, depth: int = 3) -> DataFrame:
    """(s, r, o, proved, steps): whether each goal follows from facts of a transitive relation, in at most `depth` steps.

    steps is the least number of facts a proof takes; null if there is none.
    """
    step = facts.where((F.col("r") == relation) & (F.col("s") != F.col("o"))).select(F.col("s").alias("a"), F.col("o").alias("b")).distinct()
    front = goals.select("s").distinct().withColumn("at", F.col("s")).withColumn("steps", F.lit(0))
    seen = None
    for n in range(1, depth + 1):
        front = front.join(step, front["at"] == step["a"]).select("s", F.col("b").alias("at"), F.lit(n).alias("steps")).distinct()
        seen = front if seen is None else seen.unionByName(front)
    reached = seen.groupBy("s", F.col("at").alias("o")).agg(F.min("steps").alias("steps"))
    out = goals.select("s", "o").distinct().join(reached, ["s", "o"], "left")
    return out.select("s", F.lit(relation).alias("r"), "o", F.col("steps").isNotNull().alias("proved"), "steps")


def abduce(facts: DataFrame, observations: DataFrame, rules: list[Rule], top: int = 3) -> DataFrame:
    """(s, r, o, hypothesis, rule, known, confidence): for each observed fact the premises that would explain it.

    A premise all of whose variables the observation binds is a hypothesis; its confidence is that of the rule
    times 0.9 if it is a known fact, else times 0.5. The best `top` of each observation, by confidence and text.
    """
    out = None
    known = facts.select(F.col("s").alias("ks"), F.col("r").alias("kr"), F.col("o").alias("ko")).distinct()
    for rule in rules:
        bound = {t: c for c, t in zip(("s", "r", "o"), rule.conclusion) if t.startswith("?")}
        seen = observations
        for c, t in zip(("s", "r", "o"), rule.conclusion):
            if not t.startswith("?"):
                seen = seen.where(F.col(c) == t)
        for premise in rule.premises:
            fixed = [t for t in premise if not t.startswith("?") or t in bound]
            if len(fixed) < 2:
                continue
            # A variable the observation leaves open is answered by the facts.
            term = lambda t: F.col(bound[t]) if t in bound else F.lit(t)
            on = [F.col(k) == term(t) for k, t in zip(("ks", "kr", "ko"), premise) if not t.startswith("?") or t in bound]
            cond = on[0]
            for c in on[1:]:
                cond = cond & c
            hit = seen.join(known, cond, "left")
            shown = F.concat_ws(" ", *[(F.coalesce(k, F.lit("?")) if t.startswith("?") and t not in bound else term(t)) for k, t in zip((F.col("ks"), F.col("kr"), F.col("ko")), premise)])
            one = hit.select("s", "r", "o", shown.alias("hypothesis"), F.lit(rule.name).alias("rule"), F.col("ks").isNotNull().alias("known"), F.round(F.when(F.col("ks").isNotNull(), 0.9).otherwise(0.5) * rule.confidence, 6).alias("confidence")).distinct()
            out = one if out is None else out.unionByName(one)
    w = Window.partitionBy("s", "r", "o").orderBy(F.desc("confidence"), "hypothesis", "rule")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def descendants(parents: DataFrame, itself: bool = False) -> DataFrame:
    """(ancestor, node, steps) of a hierarchy (child, parent), direct and indirect, with the fewest steps.

    Goes on until no pair is new, so cycles end by themselves. With itself every node is its own in 0 steps.
    """
    step = checkpoint(parents.where("child <> parent").select("child", "parent").distinct())
    level = step.select(F.col("parent").alias("ancestor"), F.col("child").alias("node"), F.lit(1).alias("steps"))
    seen, n = level, 1
    while not level.isEmpty():
        n += 1
        level = level.join(step, level["node"] == step["parent"]).select("ancestor", F.col("child").alias("node"), F.lit(n).alias("steps")).where("ancestor <> node")
        level = checkpoint(level.join(seen, ["ancestor", "node"], "left_anti").distinct())
        seen = checkpoint(seen.unionByName(level))
    own = parents.select(F.explode(F.array("child", "parent")).alias("node")).where("node is not null").distinct().select(F.col("node").alias("ancestor"), "node", F.lit(0).alias("steps"))
    return seen.unionByName(own) if itself else seen


def answer_why(facts: DataFrame, questions: DataFrame, rules: list[Rule], relation: str = "is_a", depth: int = 3, top: int = 3) -> DataFrame:
    """(qid, s, r, o, how, support): why-questions (qid, s, r, o) answered by proof, else by hypotheses.

    A goal of the transitive relation that is proved in at most `depth` steps says `proved` and in how many; any other
    gets its best hypotheses with their confidence.
    """
    proofs = backward_chain(facts, questions.where(F.col("r") == relation), relation, depth).where("proved")
    proved = questions.join(proofs.select("s", "r", "o", "steps"), ["s", "r", "o"]).select("qid", "s", "r", "o", F.lit("proved").alias("how"), F.concat(F.col("steps").cast("string"), F.lit(" steps")).alias("support"))
    rest = questions.join(proved.select("qid"), "qid", "left_anti")
    ideas = abduce(facts, rest.select("s", "r", "o").distinct(), rules, top)
    guessed = rest.join(ideas, ["s", "r", "o"]).select("qid", "s", "r", "o", F.lit("hypothesis").alias("how"), F.concat(F.col("hypothesis"), F.lit(" ("), F.col("confidence").cast("string"), F.lit(")")).alias("support"))
    return proved.unionByName(guessed)
