"""Queries of the text functions over knowledge_items, messages and documents; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallix.functions import text as X
from recallix.sources.messages import messages
from recallix.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def items(spark, folder) -> DataFrame:
    return table(spark, folder, "knowledge_items").select("id", F.coalesce("text", F.lit("")).alias("text"))


def said(spark, folder) -> DataFrame:
    return messages(table(spark, folder, "episodes"))


def written(spark, folder) -> DataFrame:
    """(src, row_id, pos, text): the texts of knowledge_items and of each message."""
    one = items(spark, folder).select(F.lit("knowledge_items").alias("src"), F.col("id").alias("row_id"), F.lit(0).cast("long").alias("pos"), "text")
    return one.unionByName(said(spark, folder).select(F.lit("episodes").alias("src"), F.col("episode").alias("row_id"), F.col("pos").cast("long").alias("pos"), F.col("content").alias("text")))


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ITEMS = "k AS (SELECT id, coalesce(text, '') AS text FROM knowledge_items)"
MESSAGES = """mm AS (SELECT id AS episode, user_id, session_id, unnest(from_json(messages, '[{"id":"INTEGER","role":"VARCHAR","content":"VARCHAR","timestamp":"DOUBLE"}]')) AS m, generate_subscripts(from_json(messages, '[{"id":"INTEGER"}]'), 1) - 1 AS pos FROM episodes WHERE json_valid(messages)),
msg AS (SELECT episode, user_id, session_id, pos, m.role AS role, m.content AS content, m.timestamp AS moment FROM mm WHERE m.content IS NOT NULL)"""


def words_sql(t: str) -> str:
    return f"(CASE WHEN trim(regexp_replace({t}, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace({t}, '\\s+', ' ', 'g')), ' ')) END)"


def any_sql(t: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, {q(w)})" for w in words) + ")"


def count_sql(t: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({t}, {q(w)})::INT" for w in words) + ")"


@query("text_ngram_entities", f"WITH {ITEMS}, w AS (SELECT id, list_filter(string_split(trim(regexp_replace(translate(lower(text), {q(',.:;!?()[]{}<>' + chr(34) + chr(39) + '`~/' + chr(92) + '|@#$%^&*_+-=')}, repeat(' ', 35)), '\\s+', ' ', 'g')), ' '), lambda x: length(x) > 1 AND x NOT IN ({', '.join(q(x) for x in X.ENTITY_STOPS)})) AS w FROM k) SELECT id, md5(array_to_string(list_sort(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))), ',')) AS digest FROM w")
def text_ngram_entities(spark, folder):
    return items(spark, folder).select("id", F.md5(F.array_join(X.ngram_entities(F.col("text")), ",")).alias("digest"))


CUSTOM_RULES = {"add": [("shouting", r"[A-Z]{6,}", "warning", None), ("digits", r"\d{4,}", "warning", "[NUMBER]")], "remove": ["phone", "credit_card"], "blocked": [r"\bcomplaint\b"]}


def _custom_safety_sql() -> str:
    rules = X.safety_rules(**CUSTOM_RULES)
    fired = ", ".join(f"CASE WHEN regexp_matches(text, {q(p)}) THEN '{n}' END" for n, p, _, _ in rules)
    shown = "text"
    for _, p, _, r in rules:
        shown = f"regexp_replace({shown}, {q(p)}, {q(r)}, 'g')" if r else shown
    blocked = ", ".join(f"'{n}'" for n, _, level, _ in rules if level == "blocked")
    return f"WITH {ITEMS}, f AS (SELECT id, list_filter([{fired}], lambda x: x IS NOT NULL) AS rules, {shown} AS text FROM k) SELECT id, CASE WHEN list_has_any(rules, [{blocked}]) THEN 'blocked' WHEN len(rules) > 0 THEN 'warning' ELSE 'safe' END AS level, array_to_string(rules, ',') AS rules, md5(text) AS redacted FROM f"


@query("text_safety_custom", _custom_safety_sql())
def text_safety_custom(spark, folder):
    safe = X.safety(F.col("text"), X.safety_rules(**CUSTOM_RULES))
    return items(spark, folder).select("id", safe.alias("s")).select("id", "s.level", F.array_join("s.rules", ",").alias("rules"), F.md5("s.text").alias("redacted"))


@query("text_safety_condition", f"WITH {ITEMS} SELECT id, CASE WHEN length(text) > 120 THEN 'blocked' ELSE 'safe' END AS level FROM k")
def text_safety_condition(spark, folder):
    """A rule that is a condition instead of a pattern."""
    rules = X.safety_rules(base=[], add=[("too_long", F.length("text") > 120, "blocked", None)])
    return items(spark, folder).select("id", X.safety(F.col("text"), rules)["level"].alias("level"))


@query("text_tokens", f"WITH {ITEMS} SELECT id, {words_sql('text')}::INT AS words, greatest(1, {words_sql('text')} * 13 // 10)::INT AS tokens FROM k")
def text_tokens(spark, folder):
    return items(spark, folder).select("id", X.word_count(F.col("text")).alias("words"), X.token_estimate(F.col("text")).alias("tokens"))


@query(
    "text_importance",
    f"""WITH {MESSAGES} SELECT episode, pos, CASE WHEN role = 'system' THEN 9.0 WHEN regexp_matches(content, {q(X.PERSONAL_HINT)}) THEN 8.0 WHEN {words_sql("content")} < 10 THEN 3.0
  WHEN role = 'user' THEN CASE WHEN contains(content, '?') OR {any_sql("lower(content)", X.IMPORTANT_WORDS)} THEN 7.0 ELSE 6.0 END ELSE 5.0 END::DOUBLE AS importance FROM msg""",
)
def text_importance(spark, folder):
    return said(spark, folder).select("episode", F.col("pos").cast("long").alias("pos"), X.message_importance(F.col("role"), F.col("content")).alias("importance"))


def _rule_sql() -> str:
    t = "lower(content)"
    score = "CASE role " + " ".join(f"WHEN '{r}' THEN {w}" for r, w in X.TYPE_WEIGHTS.items()) + " ELSE 0.5 END::DOUBLE"
    score += "".join(f" + CASE WHEN regexp_matches({t}, {q(p)}) THEN 0.1 ELSE 0 END" for p in X.IMPORTANT_PATTERNS)
    score += "".join(f" - CASE WHEN regexp_matches({t}, {q(p)}) THEN 0.1 ELSE 0 END" for p in X.UNIMPORTANT_PATTERNS)
    score += "".join(f" + CASE WHEN regexp_matches({t}, {q(chr(92) + 'b' + w + chr(92) + 'b')}) THEN {v} ELSE 0 END" for v, words in X.KEYWORDS.items() for w in words)
    return f"WITH {MESSAGES} SELECT episode, pos, CASE WHEN content = '' THEN 0.0 ELSE round(greatest(0.0, least(1.0, {score} + least({words_sql('content')} / 100.0, 0.2))), 6) END::DOUBLE AS importance FROM msg"


@query("text_rule_importance", _rule_sql())
def text_rule_importance(spark, folder):
    return said(spark, folder).select("episode", F.col("pos").cast("long").alias("pos"), F.round(X.rule_importance(F.col("role"), F.col("content")), 6).alias("importance"))


def _category_sql() -> str:
    t = "lower(trim(content))"
    scores = ", ".join(f"[least(1.0, round({count_sql(t, w)} * 0.2, 1))::DOUBLE, {-i}]" for i, w in enumerate(X.CATEGORIES.values()))
    names = "[" + ", ".join(q(c) for c in X.CATEGORIES) + "]"
    return f"""WITH {MESSAGES}, b AS (SELECT *, list_max([{scores}]) AS best, {count_sql(t, X.POSITIVE)} AS good, {count_sql(t, X.NEGATIVE)} AS bad FROM msg)
SELECT episode, pos, CASE WHEN length(content) >= 3 AND best[1] > 0.2 THEN {names}[(1 - best[2])::INT] END AS category, CASE WHEN length(content) >= 3 AND best[1] > 0.2 THEN best[1] ELSE 0.0 END AS score,
  length(content) >= 3 AND (ends_with({t}, '?') OR {any_sql(t, X.CATEGORIES["question"][:-1])}) AS is_question, CASE WHEN length(content) < 3 OR good = bad THEN 'neutral' WHEN good > bad THEN 'positive' ELSE 'negative' END AS sentiment FROM b"""


@query("text_categories", _category_sql())
def text_categories(spark, folder):
    return said(spark, folder).select("episode", F.col("pos").cast("long").alias("pos"), X.categories(F.col("content")).alias("c")).select("episode", "pos", "c.*")


def _complexity_sql() -> str:
    low, n = "lower(content)", "(len(content) - len(replace(content, '?', '')))"
    kind = f"CASE WHEN {n} < 1 THEN 0.0 WHEN contains({low}, 'why') THEN 0.9 WHEN contains({low}, 'how') THEN 0.8 WHEN {any_sql(low, ['what is the relationship', 'connection between'])} THEN 0.9 WHEN {any_sql(low, ['compare', 'difference between'])} THEN 0.8 WHEN {any_sql(low, ['define', 'what is'])} THEN 0.5 ELSE 0.6 END"
    score = rf"0.1 * least(len(content) / 500.0, 1.0) + 0.15 * least({words_sql('content')} / 100.0, 1.0) + 0.1 * CASE WHEN {n} > 0 THEN 1.0 ELSE 0.0 END + 0.25 * {kind} + 0.1 * least(len(regexp_extract_all(regexp_replace(content, '[^\x00-\x7F]', '_', 'g'), '\b[A-Z][a-z]+\b')) / 5.0, 1.0) + 0.05 * least(len(regexp_extract_all(content, '\b\d+(?:\.\d+)?\b')) / 5.0, 1.0) + 0.15 * least({count_sql(low, X.CODE_WORDS)} * 0.2, 1.0) + 0.1 * CASE WHEN {n} > 1 THEN least({n} / 3.0, 1.0) ELSE 0.0 END"
    return f"WITH {MESSAGES} SELECT episode, pos, CASE WHEN content = '' THEN 0.0 ELSE round(({score})::DOUBLE, 4) END AS complexity FROM msg"


@query("text_complexity", _complexity_sql())
def text_complexity(spark, folder):
    return said(spark, folder).select("episode", F.col("pos").cast("long").alias("pos"), F.round(X.query_complexity(F.col("content")), 4).alias("complexity"))


@query(
    "text_document_type",
    f"""WITH d AS (SELECT id, coalesce(messages, '') AS t FROM episodes), n AS (SELECT id, {count_sql("t", X.CODE_MARKS)} + CASE WHEN regexp_matches(t, '```(python|java|js|c|cpp|html|css)') THEN 5 ELSE 0 END AS code,
  {count_sql("t", X.DATA_MARKS)} + CASE WHEN regexp_matches(t, '\\b\\w+,\\w+,\\w+,\\w+\\b') OR regexp_matches(t, '\\|\\s*\\w+\\s*\\|\\s*\\w+\\s*\\|') THEN 3 ELSE 0 END AS data FROM d)
SELECT id, CASE WHEN code > 5 AND data > 5 THEN 'mixed' WHEN code > 5 THEN 'code' WHEN data > 5 THEN 'data' ELSE 'text' END AS doc_type FROM n""",
)
def text_document_type(spark, folder):
    return table(spark, folder, "episodes").select("id", X.document_type(F.coalesce("messages", F.lit(""))).alias("doc_type"))


def _safety_sql() -> str:
    fired = ", ".join(f"CASE WHEN regexp_matches(text, {q(p)}) THEN '{n}' END" for n, p, _, _ in X.SAFETY_RULES)
    shown = "text"
    for _, p, _, r in X.SAFETY_RULES:
        if r:
            shown = f"regexp_replace({shown}, {q(p)}, {q(r)}, 'g')"
    return f"""WITH {ITEMS}, f AS (SELECT id, list_filter([{fired}], lambda x: x IS NOT NULL) AS rules, {shown} AS text FROM k)
SELECT id, CASE WHEN list_contains(rules, 'ssn') OR list_contains(rules, 'credit_card') THEN 'blocked' WHEN len(rules) > 0 THEN 'warning' ELSE 'safe' END AS level, array_to_string(rules, ',') AS rules, md5(text) AS redacted FROM f"""


@query("text_safety", _safety_sql())
def text_safety(spark, folder):
    return items(spark, folder).select("id", X.safety(F.col("text")).alias("s")).select("id", "s.level", F.array_join("s.rules", ",").alias("rules"), F.md5("s.text").alias("redacted"))


WRITTEN = f"{ITEMS}, {MESSAGES}, wr AS (SELECT 'knowledge_items' AS src, id AS row_id, 0 AS pos, text FROM k UNION ALL SELECT 'episodes', episode, pos, content FROM msg)"


def _personal_facts_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT src, row_id, pos, {i * 10 + j} AS o, '{kind}' AS type, unnest(regexp_extract_all(text, {q('(?i)' + p)}, 1)) AS v FROM wr" for i, (kind, patterns) in enumerate(X.PERSONAL_FACTS) for j, p in enumerate(patterns))
    return f"WITH {WRITTEN}, f AS ({parts}) SELECT src, row_id, pos, type, trim(v) AS value FROM f WHERE trim(v) <> '' QUALIFY row_number() OVER (PARTITION BY src, row_id, pos, lower(trim(v)) ORDER BY o) = 1"


@query("text_personal_facts", _personal_facts_sql())
def text_personal_facts(spark, folder):
    return written(spark, folder).select("src", "row_id", "pos", F.explode(X.personal_facts(F.col("text"))).alias("f")).select("src", "row_id", "pos", "f.type", "f.value")


@query("text_personal_hint", f"WITH {MESSAGES} SELECT episode, pos, regexp_matches(content, {q(X.PERSONAL_HINT)}) AS personal FROM msg")
def text_personal_hint(spark, folder):
    return said(spark, folder).select("episode", F.col("pos").cast("long").alias("pos"), X.contains_personal_fact(F.col("content")).alias("personal"))


def emotion_sql(rows: str) -> str:
    """SQL: CTEs up to emo (rid, primary_emotion, intensity, valence, arousal, confidence) of rows, a query for (rid, t)."""
    lexicon = ", ".join(f"({q(w)}, '{e}', {v}::DOUBLE)" for e, words in X.EMOTION_WORDS.items() for w, v in words.items())
    case = lambda k: "CASE of_ " + " ".join(f"WHEN '{e}' THEN {va[k]}" for e, va in X.VALENCE_AROUSAL.items()) + " END"
    times = {m: f"((length(t) - length(replace(t, {q(m)}, ''))) // {len(m)})" for m in X.EMOJI}
    totals = ", ".join(f"coalesce(sum(v) FILTER (e = '{e}'), 0.0) AS v_{e}" for e in X.EMOTIONS)
    scores = []
    for e in X.EMOTIONS:
        flipped = "(v_joy + v_trust + v_anticipation) * 0.5" if e == "sadness" else "0.0"
        damped = "0.0" if e in ("joy", "trust", "anticipation") else f"v_{e} * 0.3"
        score = f"CASE WHEN neg THEN {damped} + {flipped} ELSE v_{e} END * boost"
        score += "".join(f" + contains(low, {q(p)})::INT * {v} * boost" for p, (of, v) in X.EMOTION_PHRASES.items() if of == e)
        score += "".join(f" + {v} * least({times[m]}, 3)" for m, (of, v) in X.EMOJI.items() if of == e)
        scores.append(f"({score}{' + loud * 0.3' if e == 'surprise' else ''})::DOUBLE")
    top = ", ".join(f"{{'v': round({x}, 9), 'i': {-i}, 'e': '{e}'}}" for i, (x, e) in enumerate(zip(scores, X.EMOTIONS)))
    count = " + ".join(["hits", *times.values(), "loud", *[f"contains(low, {q(p)})::INT" for p in X.EMOTION_PHRASES]])
    return f"""lex(w, e, v) AS (VALUES {lexicon}), er AS ({rows}), e0 AS (SELECT rid, coalesce(t, '') AS t, lower(coalesce(t, '')) AS low FROM er),
e1 AS (SELECT rid, unnest(regexp_extract_all(low, '[a-z0-9_\'\']+')) AS w FROM e0), e2 AS (SELECT rid, count(*) AS hits, {totals} FROM e1 JOIN lex USING (w) GROUP BY rid),
e3 AS (SELECT e0.*, coalesce(hits, 0) AS hits, {", ".join(f"coalesce(v_{e}, 0.0) AS v_{e}" for e in X.EMOTIONS)}, regexp_matches(low, {q(X.NEGATORS)}) AS neg, 1.0 + 0.15 * len(regexp_extract_all(low, {q(X.INTENSIFIERS)})) AS boost, (length(t) - length(replace(t, '!', '')) >= 3)::INT AS loud FROM e0 LEFT JOIN e2 USING (rid)),
e4 AS (SELECT rid, list_max([{top}]) AS top, {count} AS n, length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) / greatest(length(t), 1)::DOUBLE > 0.5 AND length(t) > 5 AS shouted FROM e3),
e5 AS (SELECT rid, n, CASE WHEN shouted AND top.v > 0 THEN top.v * 1.3 WHEN shouted THEN 0.3 ELSE top.v END AS value, CASE WHEN shouted AND top.v <= 0 THEN 'anger' ELSE top.e END AS of_ FROM e4),
emo AS (SELECT rid, CASE WHEN n > 0 AND value > 0 THEN of_ ELSE 'neutral' END AS primary_emotion, CASE WHEN n > 0 AND value > 0 THEN round(least(value / 3.0, 1.0), 6) ELSE 0.0 END AS intensity,
  CASE WHEN n > 0 AND value > 0 THEN round({case(0)} * least(value / 3.0, 1.0), 6) ELSE 0.0 END AS valence, CASE WHEN n > 0 AND value > 0 THEN round({case(1)} * least(value / 3.0, 1.0), 6) ELSE 0.0 END AS arousal, CASE WHEN n > 0 AND value > 0 THEN round(least(0.5 + n * 0.1, 0.9), 6) ELSE 0.5 END::DOUBLE AS confidence FROM e5)"""


@query("text_emotion", f"WITH {emotion_sql('SELECT doc_id AS rid, text AS t FROM documents')} SELECT rid AS doc_id, primary_emotion, intensity, valence, arousal, confidence FROM emo")
def text_emotion(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "text")
    return X.with_emotion(d, "text").select("doc_id", F.col("emotion.primary").alias("primary_emotion"), "emotion.intensity", "emotion.valence", "emotion.arousal", "emotion.confidence")


MESSAGE_MOODS = f"{MESSAGES}, {emotion_sql('SELECT episode * 1000 + pos AS rid, content AS t FROM msg')}, mood AS (SELECT msg.*, emo.* FROM msg JOIN emo ON rid = episode * 1000 + pos)"


@query("text_emotion_messages", f"WITH {MESSAGE_MOODS} SELECT episode, pos, primary_emotion AS \"primary\", intensity, valence, arousal, confidence FROM mood")
def text_emotion_messages(spark, folder):
    return X.with_emotion(said(spark, folder).select("episode", F.col("pos").cast("long").alias("pos"), "content"), "content").select("episode", "pos", "emotion.*")


SENTENCES = r"unnest(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))"


@query("text_claims", rf"WITH {ITEMS}, s AS (SELECT id, trim({SENTENCES}) AS claim FROM k) SELECT id, count(*) AS claims FROM s WHERE len(regexp_split_to_array(claim, '\s+')) >= 4 AND NOT regexp_matches(claim, '^(I |Let me|Here)') GROUP BY ALL")
def text_claims(spark, folder):
    return items(spark, folder).select("id", F.size(X.claims(F.col("text"))).cast("long").alias("claims")).where("claims > 0")


def _relations_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT id, '{n}' AS relation, unnest(regexp_extract_all(text, {q('(?i)' + p)}, {2 if turned else 1})) AS subject, unnest(regexp_extract_all(text, {q('(?i)' + p)}, {1 if turned else 2})) AS object FROM k" for n, p, turned in X.RELATION_PATTERNS)
    return f"WITH {ITEMS}, x AS ({parts}) SELECT id, subject, relation, object, count(*) AS n FROM x GROUP BY ALL"


@query("text_relations", _relations_sql())
def text_relations(spark, folder):
    return items(spark, folder).select("id", F.explode(X.relations(F.col("text"))).alias("x")).groupBy("id", "x.subject", "x.relation", "x.object").agg(F.count(F.lit(1)).alias("n"))


@query(
    "text_trigram_facts",
    rf"""WITH {ITEMS}, s AS (SELECT id, list_filter(regexp_split_to_array(unnest(string_split(replace(replace(text, '! ', '. '), '? ', '. '), '. ')), '\s+'), lambda w: w <> '') AS w FROM k), i AS (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM s WHERE len(w) >= 5)
SELECT id, w[i] AS subject, w[i + 1] AS predicate, w[i + 2] AS object, count(*) AS n FROM i WHERE len(w[i]) > 3 AND len(w[i + 1]) > 3 AND len(w[i + 2]) > 3 AND w[i] NOT IN ('this', 'that', 'these', 'those') AND w[i + 2] NOT IN ('this', 'that', 'these', 'those') GROUP BY ALL""",
)
def text_trigram_facts(spark, folder):
    return items(spark, folder).select("id", F.explode(X.trigram_facts(F.col("text"))).alias("x")).groupBy("id", "x.subject", "x.predicate", "x.object").agg(F.count(F.lit(1)).alias("n"))


@query("text_query_plans", f"WITH {MESSAGES} SELECT episode, pos, CASE " + " ".join(f"WHEN {any_sql('lower(content)', w)} THEN '{n}'" for n, w in X.PLANS) + f" ELSE 'generic' END AS template, regexp_matches(content, {q(X.MULTI_HOP)}) AS multi_hop FROM msg")
def text_query_plans(spark, folder):
    return said(spark, folder).select("episode", F.col("pos").cast("long").alias("pos"), X.query_plan(F.col("content")).alias("template"), X.is_multi_hop(F.col("content")).alias("multi_hop"))


@query(
    "text_complex_queries",
    rf"""WITH {MESSAGES}, w AS (SELECT *, regexp_split_to_array(lower(trim(content)), '\s+') AS w, {words_sql("content")} AS n FROM msg)
SELECT episode, pos, n > 15 OR (list_has_any(w, ['and', 'but', 'however', 'because', 'therefore', 'while', 'although']) AND n > 8) OR list_has_any(w, ['compare', 'contrast', 'analyze', 'explain', 'evaluate', 'why', 'how']) AS is_complex FROM w""",
)
def text_complex_queries(spark, folder):
    return said(spark, folder).select("episode", F.col("pos").cast("long").alias("pos"), X.is_complex(F.col("content")).alias("is_complex"))


@query(
    "text_keywords",
    rf"""WITH {ITEMS}, t AS (SELECT id, w, i FROM (SELECT id, unnest(regexp_extract_all(lower(regexp_replace(text, '```[\s\S]*?```', '', 'g')), '[a-z0-9_]+')) AS w, generate_subscripts(regexp_extract_all(lower(regexp_replace(text, '```[\s\S]*?```', '', 'g')), '[a-z0-9_]+'), 1) AS i FROM k) WHERE len(w) > 2 AND w NOT IN ({", ".join(q(w) for w in X.KEYWORD_STOPS)})),
c AS (SELECT id, w, count(*) AS n, min(i) AS first FROM t GROUP BY ALL) SELECT id, w AS keyword, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, first) AS place FROM c QUALIFY place <= 10""",
)
def text_keywords(spark, folder):
    tokens = F.regexp_extract_all(F.lower(F.regexp_replace("text", r"```[\s\S]*?```", "")), F.lit("([a-z0-9_]+)"), F.lit(1))
    rows = items(spark, folder).select("id", F.posexplode(tokens).alias("i", "w")).where((F.length("w") > 2) & ~F.col("w").isin(X.KEYWORD_STOPS))
    counts = rows.groupBy("id", "w").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))
    w = Window.partitionBy("id").orderBy(F.desc("n"), "first")
    return counts.withColumn("place", F.row_number().over(w)).where("place <= 10").select("id", F.col("w").alias("keyword"), "n", "place")


@query("text_normalised", f"WITH {ITEMS} SELECT id, md5(trim(regexp_replace(translate(lower(text), {q(',.:;!?()[]{}<>' + chr(34) + chr(39) + '`~/' + chr(92) + '|@#$%^&*_+-=')}, repeat(' ', 35)), '\\s+', ' ', 'g'))) AS digest FROM k")
def text_normalised(spark, folder):
    return items(spark, folder).select("id", F.md5(X.normalised(F.col("text"))).alias("digest"))


@query("text_truncated", f"WITH {ITEMS} SELECT id, md5(left(text, floor(length(text) * 0.5)::INT) || '...') AS digest FROM k")
def text_truncated(spark, folder):
    return items(spark, folder).select("id", F.md5(X.truncate(F.col("text"), 0.5)).alias("digest"))
