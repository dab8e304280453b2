"""Queries of confidence, calibration, routing and moving averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as s
from ..functions import text as x
from ..operators import series
from .registry import Tables, query
from .text_queries import array_sql, words_sql


def weights_sql(col: str, table: tuple[tuple[str, float], ...]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(lower({col}), '{p.replace(chr(39), chr(39) * 2)}') THEN {w} ELSE 0 END" for p, w in table) + ")"


def any_sql(col: str, keys: tuple[str, ...]) -> str:
    return f"len(list_filter({array_sql(keys)}, lambda k: contains(lower({col}), k))) > 0"


def count_sql(col: str, keys: tuple[str, ...]) -> str:
    return f"len(list_filter({array_sql(keys)}, lambda k: contains(lower({col}), k)))"


@query("t23_text_confidence", f"SELECT conv_id, turn, round(greatest(0.1, least(0.9, 0.65 - {weights_sql('text', s.HEDGES)} + {weights_sql('text', s.BOOSTS)})), 3)::DOUBLE AS confidence FROM conversations")
def text_confidence(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", s.text_confidence(F.col("text"), "code").alias("confidence"))


@query("t25_combine_verification", "SELECT event_id, round(greatest(0.05, least(0.99, least(value / 50, 1) + CASE WHEN event_id % 3 = 0 THEN 0.15 WHEN event_id % 3 = 1 THEN -0.4 ELSE 0 END)), 3) AS score FROM events")
def combine_verification(t: Tables) -> DataFrame:
    return t.events.select("event_id", s.combine_verification(F.least(F.col("value") / 50, F.lit(1.0)), F.col("event_id") % 3 == 0, F.col("event_id") % 3 == 1).alias("score"))


@query("t24_logprob_confidence", "WITH g AS (SELECT user_id, avg(-value / 40) AS m, avg(CASE WHEN value > 30 THEN 1 ELSE 0 END) AS r, avg(value / 20) AS e FROM events GROUP BY user_id) SELECT user_id, round(greatest(0.05, least(0.98, 1 / (1 + exp(-(m * 0.35 + 0.85))) - least(e / 10, 0.3) - r * 0.3)), 3) AS confidence FROM g")
def logprob_confidence(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id").agg(F.avg(-F.col("value") / 40).alias("m"), F.avg(F.when(F.col("value") > 30, 1).otherwise(0)).alias("r"), F.avg(F.col("value") / 20).alias("e"))
    return g.select("user_id", s.logprob_confidence(F.col("m"), F.col("e"), F.col("r")).alias("confidence"))


_CAL = " + ".join(f"regexp_matches(trim(lower(text)), '{p.replace(chr(39), chr(39) * 2)}')::INT" for p in s.UNCERTAIN)
_SURE = " + ".join(f"regexp_matches(trim(lower(text)), '{p}')::INT" for p in s.CERTAIN)


@query("t26_calibrate", f"SELECT conv_id, turn, round(greatest(0, least(1, CASE WHEN conv_id % 7 = 0 THEN 0.95 WHEN conv_id % 5 = 0 THEN 0.96 WHEN {_CAL} > 0 THEN greatest(0.25, 0.5 - ({_CAL}) * 0.1) WHEN {_SURE} > 0 THEN least(0.9, 0.72 + ({_SURE}) * 0.06) WHEN len({words_sql('text')}) < 15 AND NOT {any_sql('text', ('think', 'believe', 'maybe'))} THEN 0.78 ELSE greatest(0.5, 0.72) END)), 3)::DOUBLE AS score FROM conversations")
def calibrate(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", s.calibrate(F.lit(0.5), F.col("text"), F.when(F.col("conv_id") % 7 == 0, "memory").otherwise("small"), F.col("conv_id") % 5 == 0).alias("score"))


@query("t27_watchdog_sim", f"SELECT conv_id, turn, round(greatest(0.5, least(4.5, 2.0 + {count_sql('text', s.WATCH_HEDGES)} * 0.4 - {count_sql('text', s.WATCH_CERTAIN)} * 0.3)), 6)::DOUBLE AS entropy FROM conversations")
def watchdog_sim(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.round(s.watchdog_entropy(F.col("text")), 6).alias("entropy"))


_WORDS = words_sql("text")
_FEAT = f"f AS (SELECT conv_id, turn, len({_WORDS}) AS n, list_has_any({_WORDS}, {array_sql(s.CODE_WORDS)}) AS code, list_has_any({_WORDS}, {array_sql(s.MATH_WORDS)}) AS math, trim(lower(text)) IN ({array_sql(s.GREETINGS)[1:-1]}) OR (len({_WORDS}) <= 3 AND list_has_any({_WORDS}, ['hello', 'hi', 'hey'])) AS greeting, {any_sql('text', s.MEMORY_PHRASES)} AS memory, coalesce(list_sum(list_transform({_WORDS}, lambda w: length(w))), 0) / greatest(len({_WORDS}), 1) AS avglen FROM conversations), g AS (SELECT *, least(1.0, n / 30 * 0.3 + CASE WHEN code THEN 0.3 ELSE 0 END + avglen / 8 * 0.2 + CASE WHEN greeting THEN 0 ELSE 0.2 END) AS complexity FROM f), b AS (SELECT *, CASE WHEN code THEN 'code' ELSE 'nocode' END || '|' || CASE WHEN math THEN 'math' ELSE 'nomath' END || '|' || CASE WHEN greeting THEN 'greet' ELSE 'nogreet' END || '|' || CASE WHEN memory THEN 'mem' ELSE 'nomem' END || '|' || CASE WHEN n < 5 THEN 'short' WHEN n < 20 THEN 'med' ELSE 'long' END AS bin FROM g)"


@query("t17_route_features", f"WITH {_FEAT} SELECT conv_id, turn, n::INT AS word_count, code, math, greeting, memory, round(avglen, 6) AS average_length, round(complexity, 6)::DOUBLE AS complexity FROM b")
def route_features(t: Tables) -> DataFrame:
    f = s.features(F.col("text"))
    return t.conversations.select("conv_id", "turn", f["word_count"].alias("word_count"), f["code"].alias("code"), f["math"].alias("math"), f["greeting"].alias("greeting"), f["memory"].alias("memory"), F.round(f["average_length"], 6).alias("average_length"), F.round(f["complexity"], 6).alias("complexity"))


@query("t18_feature_bin", f"WITH {_FEAT} SELECT conv_id, turn, bin FROM b")
def feature_bin(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", s.feature_bin(s.features(F.col("text"))).alias("bin"))


@query("t19_liquid_route", f"WITH {_FEAT}, s AS (SELECT *, 0.5 + 0.0 + CASE WHEN complexity <= 0.4 THEN 0.2 ELSE 0 END AS tiny, 0.5 + 0.05 + CASE WHEN complexity > 0.4 AND complexity <= 0.7 THEN 0.2 ELSE 0 END AS small, 0.5 + 0.1 + CASE WHEN complexity > 0.7 THEN 0.3 ELSE 0 END + CASE WHEN code THEN 0.2 ELSE 0 END AS medium, 0.5 + 0.15 - 0.1 AS swarm FROM b) SELECT conv_id, turn, CASE WHEN greeting OR memory OR (math AND n < 10) THEN 'tiny' WHEN tiny >= greatest(small, medium, swarm) THEN 'tiny' WHEN small >= greatest(medium, swarm) THEN 'small' WHEN medium >= swarm THEN 'medium' ELSE 'swarm' END AS tier FROM s")
def liquid_route(t: Tables) -> DataFrame:
    f = s.features(F.col("text"))
    route = s.liquid_route(f, dict.fromkeys(s.TIERS, F.lit(0.5)), {"tiny": 0.5, "small": 0.6, "medium": 0.7, "swarm": 0.8}, {"tiny": 1.0, "small": 100.0, "medium": 1000.0, "swarm": 10_000.0})
    return t.conversations.select("conv_id", "turn", route.alias("tier"))


_TASK = f"q AS (SELECT conv_id, turn, trim(lower(text)) AS q, len({_WORDS}) AS n FROM conversations), c AS (SELECT *, least(n / 60, 0.3) + CASE WHEN {any_sql('q', s.EXPLAIN_WORDS)} THEN 0.1 ELSE 0 END + least((length(q) - length(translate(q, '.?!', ''))) * 0.05, 0.15) + CASE WHEN {any_sql('q', ('`', 'def ', 'class ', 'import '))} THEN 0.15 ELSE 0 END AS sc FROM q)"


@query("t20_task_route", f"WITH {_TASK} SELECT conv_id, turn, CASE WHEN regexp_matches(q, '^(hi|hello|hey|yo|sup|howdy)\\b|^(thanks|thank you|thx|ty)\\b|^(bye|goodbye|see you|cya)\\b|^\\s*\\d[\\d\\s+\\-*/^().]+=?\\s*$') THEN 'tiny' WHEN {any_sql('q', s.HEAVY_WORDS)} THEN 'heavy' WHEN sc < 0.2 THEN 'small' WHEN sc < 0.5 THEN 'medium' ELSE 'full' END AS tier FROM c")
def task_route(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", s.task_route(F.col("text")).alias("tier"))


@query("t21_classify_complexity", f"SELECT conv_id, turn, CASE WHEN {any_sql('text', s.COMPLEX_WORDS)} THEN 'complex' WHEN len({_WORDS}) <= 5 THEN 'simple' WHEN length(text) - length(replace(text, chr(10), '')) > 5 OR len({_WORDS}) > 50 THEN 'complex' WHEN {any_sql('text', s.SIMPLE_WORDS)} THEN 'simple' ELSE 'medium' END AS class FROM conversations")
def classify_complexity(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", s.complexity_class(F.col("text")).alias("class"))


@query("t22_max_tokens", f"SELECT conv_id, turn, CASE WHEN {any_sql('text', s.TOKEN_CODE)} OR {any_sql('text', s.TOKEN_REASON)} THEN 2048 WHEN {any_sql('text', s.TOKEN_PROJECT)} THEN 1536 WHEN len({_WORDS}) <= 5 THEN 384 WHEN regexp_matches(lower(text), '^(is|are|does|do|can|will|should) ') THEN 384 WHEN regexp_matches(lower(text), '^(what is|what are|define|meaning of) ') THEN 512 ELSE 768 END AS tokens FROM conversations")
def max_tokens(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", s.max_tokens(F.col("text")).alias("tokens"))


@query("t48_follow_ups", f"SELECT conv_id, turn, (CASE WHEN {any_sql('text', ('error', 'bug', 'fix', 'broken', 'crash', 'fail'))} THEN 3 ELSE 0 END + CASE WHEN {any_sql('text', ('what does', 'describe', 'explain', 'about'))} THEN 3 ELSE 0 END)::INT AS predicted FROM conversations")
def follow_ups(t: Tables) -> DataFrame:
    q = F.lower("text")
    three = lambda keys: F.when(x.contains_any(q, keys), 3).otherwise(0)
    return t.conversations.select("conv_id", "turn", (three(("error", "bug", "fix", "broken", "crash", "fail")) + three(("what does", "describe", "explain", "about"))).alias("predicted"))


@query("t51_persona_select", f"SELECT conv_id, turn, list_filter([CASE WHEN {any_sql('text', ('secure', 'auth', 'password'))} THEN 'security' END, CASE WHEN {any_sql('text', ('fast', 'slow', 'optimize'))} THEN 'performance' END, 'generalist'], lambda p: p IS NOT NULL)[1:2] AS personas FROM conversations")
def persona_select(t: Tables) -> DataFrame:
    q = F.lower("text")
    p = F.array(F.when(x.contains_any(q, ("secure", "auth", "password")), "security"), F.when(x.contains_any(q, ("fast", "slow", "optimize")), "performance"), F.lit("generalist"))
    return t.conversations.select("conv_id", "turn", F.slice(F.filter(p, lambda v: v.isNotNull()), 1, 2).alias("personas"))


#: Themes by their keywords; fixed values.
THEMES = {
    "database": ("database", "sql", "query", "table", "migration", "schema", "orm", "model", "postgres", "mysql", "sqlite", "mongo", "index", "join", "transaction"),
    "authentication": ("auth", "login", "password", "token", "jwt", "session", "oauth", "permission", "role", "security", "credential"),
    "api": ("api", "endpoint", "rest", "graphql", "route", "controller", "request", "response", "middleware", "cors", "rate limit"),
    "testing": ("test", "pytest", "unittest", "mock", "fixture", "coverage", "assert", "tdd", "integration test", "e2e"),
    "deployment": ("deploy", "docker", "kubernetes", "ci/cd", "pipeline", "nginx", "aws", "cloud", "terraform", "ansible", "helm"),
    "caching": ("cache", "redis", "memcached", "ttl", "invalidation", "lru", "cdn", "memoize", "in-memory"),
    "architecture": ("architecture", "design pattern", "microservice", "monolith", "event driven", "message queue", "pub sub", "clean architecture"),
}
_THEME = " UNION ALL ".join(f"SELECT conv_id, turn, '{name}' AS theme, {count_sql('text', keys)} AS hits FROM conversations" for name, keys in THEMES.items())


def themes(t: Tables) -> DataFrame:
    q = F.lower("text")
    found = F.array(*[F.struct(F.lit(name).alias("theme"), x.hits(q, keys).alias("hits")) for name, keys in THEMES.items()])
    return t.conversations.select("conv_id", "turn", "text", F.explode(found).alias("m")).select("conv_id", "turn", "text", "m.*").where("hits > 0")


@query("t52_theme_match", f"SELECT conv_id, turn, theme, round(least(hits * 0.3, 1.0), 6)::DOUBLE AS confidence FROM ({_THEME}) WHERE hits > 0")
def theme_match(t: Tables) -> DataFrame:
    return themes(t).select("conv_id", "turn", "theme", F.round(F.least(F.col("hits") * 0.3, F.lit(1.0)), 6).alias("confidence"))


@query("a24_theme_stats", f"SELECT theme, count(*) AS frequency, count(DISTINCT conv_id) AS sessions, min(turn) AS first_seen, max(turn) AS last_seen FROM ({_THEME}) WHERE hits > 0 GROUP BY theme")
def theme_stats(t: Tables) -> DataFrame:
    return themes(t).groupBy("theme").agg(F.count("*").alias("frequency"), F.count_distinct("conv_id").alias("sessions"), F.min("turn").alias("first_seen"), F.max("turn").alias("last_seen"))


@query("l18_insights", f"SELECT theme, count(*) AS support FROM ({_THEME}) WHERE hits > 0 GROUP BY theme ORDER BY 2 DESC, 1 LIMIT 3")
def insights(t: Tables) -> DataFrame:
    return themes(t).groupBy("theme").agg(F.count("*").alias("support")).orderBy(F.desc("support"), "theme").limit(3)


_STAGE = f"m AS (SELECT t.*, CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END AS b, CASE WHEN contains(lower(text), 'of') THEN 1 ELSE 0 END AS e FROM ({_THEME}) t JOIN conversations USING (conv_id, turn) WHERE hits > 0)"


@query("w9_theme_stage", f"WITH {_STAGE}, s AS (SELECT conv_id, turn, theme, sum(b) OVER w + 2 * b AS building, sum(e) OVER w + 2 * e AS exploring FROM m WINDOW w AS (PARTITION BY theme ORDER BY conv_id, turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT conv_id, turn, theme, last_value(CASE WHEN building + exploring = 0 THEN NULL WHEN exploring >= building THEN 'exploring' ELSE 'building' END IGNORE NULLS) OVER (PARTITION BY theme ORDER BY conv_id, turn) AS stage FROM s")
def theme_stage(t: Tables) -> DataFrame:
    """The stage of a theme by its last five mentions, the present one counting thrice; without a sign the stage stays."""
    m = themes(t).withColumn("b", F.contains(F.lower("text"), F.lit("the")).cast("int")).withColumn("e", F.contains(F.lower("text"), F.lit("of")).cast("int"))
    by = Window.partitionBy("theme").orderBy("conv_id", "turn")
    five = by.rowsBetween(-4, 0)
    m = m.withColumn("building", F.sum("b").over(five) + 2 * F.col("b")).withColumn("exploring", F.sum("e").over(five) + 2 * F.col("e"))
    sign = F.when(F.col("building") + F.col("exploring") == 0, F.lit(None)).when(F.col("exploring") >= F.col("building"), "exploring").otherwise("building")
    return m.withColumn("sign", sign).select("conv_id", "turn", "theme", F.last("sign", ignorenulls=True).over(by).alias("stage"))


_EMA = "list_reduce(list_prepend(0.5::DOUBLE, list(({x})::DOUBLE ORDER BY event_id)), lambda e, v: 0.1 * v + 0.9 * e)"


@query("w3_ema", f"SELECT event_type, round({_EMA.format(x='least(value / 50, 1)')}, 9) AS ema FROM events GROUP BY event_type")
def ema(t: Tables) -> DataFrame:
    rows = t.events.withColumn("v", F.least(F.col("value") / 50, F.lit(1.0)))
    return series.ema(rows, ["event_type"], [F.col("event_id")], "v", 0.5).select("event_type", F.round("ema", 9).alias("ema"))


_REWARD = "CASE WHEN value > 25 AND event_id % 2 = 0 THEN 1.0 WHEN value > 25 THEN 0.7 WHEN event_id % 2 = 0 THEN 0.3 ELSE 0.1 END"


@query("w4_feature_bin_ema", f"SELECT event_type, user_id % 5 AS bin, round({_EMA.format(x=_REWARD)}, 9) AS ema FROM events GROUP BY ALL")
def feature_bin_ema(t: Tables) -> DataFrame:
    good, fast = F.col("value") > 25, F.col("event_id") % 2 == 0
    r = F.when(good & fast, 1.0).when(good, 0.7).when(fast, 0.3).otherwise(0.1)
    rows = t.events.withColumn("r", r).withColumn("bin", F.col("user_id") % 5)
    return series.ema(rows, ["event_type", "bin"], [F.col("event_id")], "r", 0.5).select("event_type", "bin", F.round("ema", 9).alias("ema"))


_LP = "[-value / 10, -value / 10 - 1, -value / 10 - 2.5, -3.0]"


@query("w6_token_entropy", f"WITH p AS (SELECT event_id, list_transform({_LP}, lambda v: exp(v - list_max({_LP}))) AS p FROM events), e AS (SELECT event_id, -list_sum(list_transform(p, lambda v: CASE WHEN v / list_sum(p) > 1e-10 THEN v / list_sum(p) * ln(v / list_sum(p)) ELSE 0 END)) AS h FROM p) SELECT event_id, round(abs(h), 6) AS entropy, h > 3.5 AS spike, h > 4.2 AS pause FROM e")
def token_entropy(t: Tables) -> DataFrame:
    v = -F.col("value") / 10
    h = s.entropy(F.array(v, v - 1, v - 2.5, F.lit(-3.0)))
    return t.events.select("event_id", h.alias("h")).select("event_id", F.round(F.abs("h"), 6).alias("entropy"), (F.col("h") > 3.5).alias("spike"), (F.col("h") > 4.2).alias("pause"))


@query("w7_entropy_summary", "SELECT user_id, round(avg(value / 10), 6) AS mean, max(value / 10) AS most, count(*) FILTER (value / 10 > 3.5) AS spikes, round(greatest(0.05, 1 - avg(value / 10) / 5), 6) AS confidence FROM events GROUP BY user_id")
def entropy_summary(t: Tables) -> DataFrame:
    h = F.col("value") / 10
    return t.events.groupBy("user_id").agg(F.round(F.avg(h), 6).alias("mean"), F.max(h).alias("most"), F.count_if(h > 3.5).alias("spikes"), F.round(F.greatest(F.lit(0.05), 1 - F.avg(h) / 5), 6).alias("confidence"))


@query("w16_running_mean", "SELECT event_id, sum(round(value * 100)::BIGINT) OVER w / count(*) OVER w / 100 AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_mean(t: Tables) -> DataFrame:
    """Over whole hundredths, so that the sum does not depend on its order."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", (F.sum(F.round(F.col("value") * 100).cast("long")).over(by) / F.count("*").over(by) / 100).alias("mean"))


@query("a21_majority_vote", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, arg_max(event_type, (n, event_type)) AS answer, round(max(n) / sum(n), 6) AS agreement FROM c GROUP BY user_id")
def majority_vote(t: Tables) -> DataFrame:
    c = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", "event_type")).alias("answer"), F.round(F.max("n") / F.sum("n"), 6).alias("agreement"))


@query("m24_decide_by_consensus", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, CASE WHEN max(n) / sum(n) < 0.3 THEN NULL ELSE arg_max(event_type, (n, event_type)) END AS answer FROM c GROUP BY user_id")
def decide_by_consensus(t: Tables) -> DataFrame:
    v = majority_vote(t)
    return v.select("user_id", F.when(F.col("agreement") >= 0.3, F.col("answer")).alias("answer"))


@query("a26_hit_rate", "SELECT event_type, round(avg((value > 20)::INT), 6) AS rate FROM events GROUP BY event_type")
def hit_rate(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(F.avg((F.col("value") > 20).cast("int")), 6).alias("rate"))


@query("a30_recovery_stats", "SELECT event_type, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last_event FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) GROUP BY event_type")
def recovery_stats(t: Tables) -> DataFrame:
    newest = t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    return newest.groupBy("event_type").agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))


@query("m29_keyword_classes", f"SELECT doc_id, CASE WHEN {any_sql('text', ('license', 'copyright'))} THEN 'legal' WHEN {any_sql('text', ('error', 'exception'))} THEN 'report' ELSE 'prose' END AS class FROM documents")
def keyword_classes(t: Tables) -> DataFrame:
    q = F.lower("text")
    return t.documents.select("doc_id", F.when(x.contains_any(q, ("license", "copyright")), "legal").when(x.contains_any(q, ("error", "exception")), "report").otherwise("prose").alias("class"))
