"""Queries of curation: conversations are exchanges, documents are examples."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as s
from ..functions.text import words
from ..operators import curate, store
from .registry import Tables, query
from .text_queries import words_sql

_PAIRS = "p AS (SELECT conv_id, turn, text AS instruction, response FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS response FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')"
_Q = f"{_PAIRS}, q AS (SELECT *, (conv_id % 3 = 0) AS verified, (conv_id % 100) / 100 AS confidence, (turn % 5 + 1)::INT AS feedback, CASE WHEN conv_id % 4 = 0 THEN 'self_play' ELSE 'small' END AS tier, (conv_id % 50) * 100.0 AS latency FROM p), z AS (SELECT *, round(greatest(0, least(1, CASE WHEN contains(lower(response), 'demo mode') THEN 0 ELSE CASE WHEN verified THEN 0.4 ELSE 0 END + CASE WHEN confidence >= 0.85 THEN 0.25 WHEN confidence >= 0.7 THEN 0.15 ELSE 0 END + CASE feedback WHEN 5 THEN 0.2 WHEN 4 THEN 0.1 WHEN 1 THEN -0.5 ELSE 0 END + CASE WHEN tier = 'self_play' THEN 0.35 ELSE 0 END + CASE WHEN latency < 3000 AND latency > 0 THEN 0.05 ELSE 0 END + CASE WHEN length(response) > 50 AND length(response) < 800 THEN 0.05 ELSE 0 END - CASE WHEN confidence < 0.35 THEN 0.2 ELSE 0 END - CASE WHEN length(response) < 20 THEN 0.15 ELSE 0 END - CASE WHEN length(response) > 2000 THEN 0.1 ELSE 0 END END)), 3)::DOUBLE AS score FROM q)"


def scored(t: Tables) -> DataFrame:
    p = curate.pairs(t.conversations)
    p = p.withColumns({"verified": F.col("conv_id") % 3 == 0, "confidence": F.col("conv_id") % 100 / 100, "feedback": (F.col("turn") % 5 + 1).cast("int"), "tier": F.when(F.col("conv_id") % 4 == 0, "self_play").otherwise("small"), "latency": (F.col("conv_id") % 50 * 100).cast("double")})
    score, reasons, against = s.quality_points(*(F.col(c) for c in ("response", "verified", "confidence", "feedback", "tier", "latency")))
    return p.withColumns({"score": score, "reasons": reasons, "against": against})


@query("s12_load_sessions", f"WITH {_PAIRS} SELECT conv_id, count(*) AS exchanges, max(turn) AS last_turn FROM p GROUP BY conv_id")
def load_sessions(t: Tables) -> DataFrame:
    return curate.pairs(t.conversations).groupBy("conv_id").agg(F.count("*").alias("exchanges"), F.max("turn").alias("last_turn"))


@query("k6_export_sharegpt", f"""WITH {_PAIRS} SELECT conv_id, turn, to_json({{'conversations': [{{'from': 'human', 'value': instruction}}, {{'from': 'gpt', 'value': response}}]}})::VARCHAR AS line FROM p""")
def export_sharegpt(t: Tables) -> DataFrame:
    return curate.pairs(t.conversations).select("conv_id", "turn", curate.sharegpt().alias("line"))


@query("k7_export_alpaca", f"""WITH {_PAIRS} SELECT conv_id, turn, to_json({{'instruction': instruction, 'input': '', 'output': response}})::VARCHAR AS line FROM p""")
def export_alpaca(t: Tables) -> DataFrame:
    return curate.pairs(t.conversations).select("conv_id", "turn", curate.alpaca().alias("line"))


@query("k8_export_chatml", f"WITH {_PAIRS} SELECT conv_id, turn, '<|im_start|>user' || chr(10) || instruction || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || response || '<|im_end|>' AS line FROM p")
def export_chatml(t: Tables) -> DataFrame:
    return curate.pairs(t.conversations).select("conv_id", "turn", curate.chatml().alias("line"))


@query("m28_prompt_to_messages", f"WITH {_PAIRS} SELECT conv_id, turn, 2 AS messages, instruction AS first, response AS second FROM p")
def prompt_to_messages(t: Tables) -> DataFrame:
    p = curate.pairs(t.conversations).withColumn("line", curate.chatml())
    m = curate.parse_chatml("line")
    return p.select("conv_id", "turn", F.size(m).alias("messages"), m[0]["content"].alias("first"), m[1]["content"].alias("second"))


@query("k9_export_quality_jsonl", f"WITH {_Q} SELECT conv_id, turn, round(score, 2)::DOUBLE AS quality, tier FROM z WHERE score >= 0.65")
def export_quality(t: Tables) -> DataFrame:
    return scored(t).where("score >= 0.65").select("conv_id", "turn", F.round("score", 2).alias("quality"), "tier")


@query("k10_export_security_trainset", "SELECT doc_id, 'Review this ' || coalesce(nullif(source, ''), 'code') || ' (' || coalesce(nullif(lang, ''), 'unknown') || ')' AS instruction, text AS input, CASE WHEN quality = 0 THEN 'finding' ELSE 'clean' END AS output FROM documents JOIN labels USING (doc_id)")
def export_security(t: Tables) -> DataFrame:
    pick = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    return t.documents.join(t.labels, "doc_id").select("doc_id", F.concat(F.lit("Review this "), pick("source", "code"), F.lit(" ("), pick("lang", "unknown"), F.lit(")")).alias("instruction"), F.col("text").alias("input"), F.when(F.col("quality") == 0, "finding").otherwise("clean").alias("output"))


@query("t13_quality_points", f"WITH {_Q} SELECT conv_id, turn, score FROM z")
def quality_points(t: Tables) -> DataFrame:
    return scored(t).select("conv_id", "turn", "score")


@query("f13_filter_quality", f"WITH {_Q} SELECT conv_id, turn, CASE WHEN score >= 0.65 THEN 'accepted' ELSE 'rejected' END AS verdict FROM z")
def filter_quality(t: Tables) -> DataFrame:
    return scored(t).select("conv_id", "turn", F.when(F.col("score") >= 0.65, "accepted").otherwise("rejected").alias("verdict"))


@query("t14_pair_quality", f"WITH {_Q} SELECT conv_id, turn, round(least(1.0, feedback / 5 + confidence * 0.1 + CASE WHEN verified THEN 0.1 ELSE 0 END + least(0.05, 500 / greatest(latency, 1.0))), 6)::DOUBLE AS quality FROM q")
def pair_quality(t: Tables) -> DataFrame:
    return scored(t).select("conv_id", "turn", F.round(s.pair_quality(*(F.col(c) for c in ("feedback", "confidence", "verified", "latency"))), 6).alias("quality"))


@query("t15_verified_boost", f"WITH {_Q} SELECT conv_id, turn, CASE WHEN verified THEN greatest(score, 0.85) ELSE score END AS boosted FROM z")
def verified_boost(t: Tables) -> DataFrame:
    return scored(t).select("conv_id", "turn", F.when(F.col("verified"), F.greatest("score", F.lit(0.85))).otherwise(F.col("score")).alias("boosted"))


@query("t16_importance", f"WITH {_PAIRS} SELECT conv_id, turn, round(least(1.0, 0.4 + CASE WHEN length(response) > 300 THEN 0.1 ELSE 0 END + CASE WHEN contains(instruction, '?') THEN 0.1 ELSE 0 END + CASE WHEN len(list_filter(['my name', 'i am', 'i work', 'i live', 'i have', 'i like', 'i want', 'i need', 'remember'], lambda k: contains(lower(instruction), k))) > 0 THEN 0.3 ELSE 0 END), 6)::DOUBLE AS importance FROM p")
def importance(t: Tables) -> DataFrame:
    return curate.pairs(t.conversations).select("conv_id", "turn", F.round(s.importance(F.col("instruction"), F.col("response")), 6).alias("importance"))


@query("a5_dataset_stats", f"SELECT source, count(*) AS n, count(*) FILTER (n_chars >= 700) AS long, round(avg(n_chars), 6) AS mean, sum(len({words_sql('text')}))::BIGINT AS words FROM documents GROUP BY source")
def dataset_stats(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") >= 700).alias("long"), F.round(F.avg("n_chars"), 6).alias("mean"), F.sum(F.size(words(F.col("text")))).alias("words"))


@query("a6_pair_stats", f"WITH {_Q} SELECT feedback, count(*) AS n, count(*) FILTER (score >= 0.7) AS high, count(*) FILTER (verified) AS verified, round(avg(score), 3) AS mean FROM z GROUP BY feedback")
def pair_stats(t: Tables) -> DataFrame:
    return scored(t).groupBy("feedback").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.7).alias("high"), F.count_if("verified").alias("verified"), F.round(F.avg("score"), 3).alias("mean"))


@query("a7_filter_stats", f"WITH {_Q} SELECT count(*) AS n, round(avg((score >= 0.65)::INT), 6) AS pass_rate, round(avg(score), 6) AS mean FROM z")
def filter_stats(t: Tables) -> DataFrame:
    return scored(t).agg(F.count("*").alias("n"), F.round(F.avg((F.col("score") >= 0.65).cast("int")), 6).alias("pass_rate"), F.round(F.avg("score"), 6).alias("mean"))


@query("u3_dedup_examples", "SELECT md5(lower(trim(source)) || '|' || lower(trim(substring(text, 1, 100)))) AS hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedup_examples(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", curate.content_hash("source", "text").alias("hash"))
    return d.groupBy("hash").agg(F.min("doc_id").alias("doc_id"))


@query("w2_round_robin_balance", "WITH r AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents), f AS (SELECT lang, max(n_chars) AS best, min(doc_id) FILTER (k = 1) AS lead FROM r GROUP BY lang) SELECT doc_id, lang FROM r JOIN f USING (lang) ORDER BY k, best DESC, lead, doc_id LIMIT 50")
def round_robin_balance(t: Tables) -> DataFrame:
    return curate.round_robin(t.documents.select("doc_id", "lang", "n_chars"), "lang", "n_chars", "doc_id", 50).select("doc_id", "lang")


@query("l8_curate", f"WITH {_Q}, n AS (SELECT count(*) FILTER (score >= 0.9) AS n FROM z) SELECT conv_id, turn, score FROM z, n WHERE score >= CASE WHEN n.n >= 100000 THEN 0.9 ELSE 0.9 * 0.7 END ORDER BY verified DESC, score DESC, conv_id, turn")
def curate_best(t: Tables) -> DataFrame:
    return curate.curate(scored(t), "score", "verified", "conv_id", 0.9, 100_000).select("conv_id", "turn", "score")


@query("m39_import_sessions", f"WITH {_PAIRS} SELECT md5(lower(trim(instruction)) || '|' || lower(trim(substring(response, 1, 100)))) AS hash, min(conv_id) AS conv_id FROM p GROUP BY 1")
def import_sessions(t: Tables) -> DataFrame:
    p = curate.pairs(t.conversations).withColumn("hash", curate.content_hash())
    return store.first_of(p, ["hash"], [F.col("conv_id"), F.col("turn")]).select("hash", "conv_id")


@query("m25_should_train", f"WITH {_Q} SELECT count(*) FILTER (score >= 0.7) >= 100 AS enough FROM z")
def should_train(t: Tables) -> DataFrame:
    return scored(t).agg((F.count_if(F.col("score") >= 0.7) >= 100).alias("enough"))


@query("x12_trainer_gate", f"WITH {_Q} SELECT tier, count(*) FILTER (score >= 0.65) AS good, count(*) FILTER (score >= 0.65) >= 50 AND count(*) FILTER (score >= 0.65 AND turn > 2) >= 20 AS train FROM z GROUP BY tier")
def trainer_gate(t: Tables) -> DataFrame:
    good = F.col("score") >= 0.65
    return scored(t).groupBy("tier").agg(F.count_if(good).alias("good"), ((F.count_if(good) >= 50) & (F.count_if(good & (F.col("turn") > 2)) >= 20)).alias("train"))


@query("w5_context_window", "WITH r AS (SELECT conv_id, turn, sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM conversations) SELECT conv_id, turn, used::BIGINT AS used FROM r WHERE used <= 300")
def context_window(t: Tables) -> DataFrame:
    """The newest turns of a conversation that fit a budget of tokens."""
    by = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return t.conversations.select("conv_id", "turn", F.sum(F.floor(F.length("text") / 4)).over(by).alias("used")).where("used <= 300")


@query("w8_session_recent_n", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 3")
def session_recent_n(t: Tables) -> DataFrame:
    return t.conversations.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("k <= 3").select("conv_id", "turn")


@query("w11_auto_title", "SELECT conv_id, substring(arg_min(text, turn), 1, 50) AS title FROM conversations GROUP BY conv_id")
def auto_title(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, 50).alias("title"))


@query("l10_session_search_topk", "WITH q AS (SELECT unnest(['the', 'error', 'of']) AS w), s AS (SELECT conv_id, sum(CASE WHEN contains(lower(text), w) THEN CASE role WHEN 'user' THEN 2 WHEN 'assistant' THEN 1 ELSE 0 END ELSE 0 END) AS score FROM conversations, q GROUP BY conv_id) SELECT conv_id, score::BIGINT AS score FROM s WHERE score > 0 ORDER BY 2 DESC, 1 LIMIT 10")
def session_search(t: Tables) -> DataFrame:
    from ..functions.text import hits

    weight = F.when(F.col("role") == "user", 2).when(F.col("role") == "assistant", 1).otherwise(0)
    return t.conversations.groupBy("conv_id").agg(F.sum(hits(F.lower("text"), ["the", "error", "of"]) * weight).alias("score")).where("score > 0").orderBy(F.desc("score"), "conv_id").limit(10)


@query("a22_swarm_consensus")
def swarm_consensus(t: Tables) -> DataFrame:
    """Per conversation the answer that agrees most with the others, by sequence similarity."""
    def agree(group: pd.DataFrame) -> pd.DataFrame:
        texts = [" ".join(str(x).lower().split()) for x in group["text"]]
        score = [sum(difflib.SequenceMatcher(None, a, b).ratio() for j, b in enumerate(texts) if j != i) / max(1, len(texts) - 1) for i, a in enumerate(texts)]
        best = max(range(len(texts)), key=lambda i: (score[i], -group["turn"].iloc[i]))
        mean = sum(score) / len(score)
        level = 95 if mean >= 0.9 else 85 if mean >= 0.7 else 75 if mean >= 0.5 else 60
        return pd.DataFrame({"conv_id": [group["conv_id"].iloc[0]], "turn": [group["turn"].iloc[best]], "agreement": [mean], "confidence": [level]})

    answers = t.conversations.where("role = 'assistant'").select("conv_id", "turn", "text")
    return answers.groupBy("conv_id").applyInPandas(agree, "conv_id long, turn long, agreement double, confidence int")


_JAC = "len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))"


@query("j21_doc_pair_self_join", f"WITH w AS (SELECT conv_id, turn, list_distinct({words_sql('text')}) AS w FROM conversations) SELECT a.conv_id, a.turn AS a, b.turn AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS similarity FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn <> b.turn")
def doc_pair_self_join(t: Tables) -> DataFrame:
    from ..functions.text import jaccard

    w = t.conversations.select("conv_id", "turn", F.array_distinct(words(F.col("text"))).alias("w"))
    a, b = w.select("conv_id", F.col("turn").alias("a"), F.col("w").alias("x")), w.select("conv_id", F.col("turn").alias("b"), F.col("w").alias("y"))
    return a.join(b, "conv_id").where("a <> b").select("conv_id", "a", "b", F.round(jaccard(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("m23_consensus_mean", "SELECT conv_id, round(avg(length(text)), 6) AS mean FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def consensus_mean(t: Tables) -> DataFrame:
    return t.conversations.where("role = 'assistant'").groupBy("conv_id").agg(F.round(F.avg(F.length("text")), 6).alias("mean"))
