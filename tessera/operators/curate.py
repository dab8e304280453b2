"""Curation of training data: pairs, exports, balancing and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, instruction, response): a user's turn and the assistant's next one."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    n = turns.withColumn("next_role", F.lead("role").over(by)).withColumn("response", F.lead("text").over(by))
    return n.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("instruction"), "response")


def content_hash(instruction: str = "instruction", response: str = "response"):
    return F.md5(F.concat(F.lower(F.trim(instruction)), F.lit("|"), F.lower(F.trim(F.substring(response, 1, 100)))).cast("binary"))


def sharegpt(instruction: str = "instruction", response: str = "response"):
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), F.col(c).alias("value"))
    return F.to_json(F.struct(F.array(turn("human", instruction), turn("gpt", response)).alias("conversations")))


def alpaca(instruction: str = "instruction", response: str = "response"):
    return F.to_json(F.struct(F.col(instruction).alias("instruction"), F.lit("").alias("input"), F.col(response).alias("output")))


def chatml(instruction: str = "instruction", response: str = "response"):
    return F.concat(F.lit("<|im_start|>user\n"), instruction, F.lit("<|im_end|>\n<|im_start|>assistant\n"), response, F.lit("<|im_end|>"))


def parse_chatml(text: str):
    """The (role, content) messages of a ChatML text."""
    roles = F.regexp_extract_all(text, F.lit(r"(?s)<\|im_start\|>(\w+)\n.*?<\|im_end\|>"), F.lit(1))
    bodies = F.regexp_extract_all(text, F.lit(r"(?s)<\|im_start\|>\w+\n(.*?)<\|im_end\|>"), F.lit(1))
    return F.zip_with(roles, bodies, lambda r, b: F.struct(r.alias("role"), b.alias("content")))


def round_robin(rows: DataFrame, group: str, score: str, key: str, most: int) -> DataFrame:
    """Rows taken in turns from groups, best first; groups in the order of their best rows."""
    by = Window.partitionBy(group).orderBy(F.desc(score), key)
    ranked = rows.withColumn("turn_no", F.row_number().over(by)).where(F.col("turn_no") <= most)
    first = rows.groupBy(group).agg(F.max(F.struct(F.col(score), -F.col(key))).alias("best"))
    return ranked.join(first, group).orderBy("turn_no", F.desc("best"), key).limit(most).drop("best")


def curate(rows: DataFrame, score: str, verified: str, key: str, least: float, want: int) -> DataFrame:
    """The best rows, verified first; with fewer than `want` above the threshold it is relaxed to 0.7 of it."""
    enough = rows.agg(F.count_if(F.col(score) >= least).alias("n"))
    limit = F.when(F.col("n") >= want, least).otherwise(least * 0.7)
    return rows.crossJoin(F.broadcast(enough)).where(F.col(score) >= limit).drop("n").orderBy(F.desc(verified), F.desc(score), key)  # one row
