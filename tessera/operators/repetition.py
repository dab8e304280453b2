"""Answers that repeat themselves, cut where the repetition begins."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame

from ..sources.readers import rows_of

#: Characters and words that an answer has to have, times that a word may follow itself, characters that have to be left.  Fixed values.
LEAST, WORDS, RUNS, LEFT = 100, 20, 4, 50
#: Lengths of patterns, characters at the end that are searched, and occurrences there that are too many.  Fixed values.
SHORTEST, LONGEST, TAIL, TIMES = 5, 29, 500, 8
NOTE = "\n\n*[Response truncated — repetition detected]*"


def _word_run(words: list[str], runs: int) -> int | None:
    """The first word of the first run of one word that is too long."""
    times = 1
    for i in range(1, len(words)):
        times = times + 1 if words[i] == words[i - 1] else 1
        if times >= runs:
            return i - runs + 1
    return None


def _pattern_place(text: str) -> int | None:
    """Where the first pattern begins that the end of the text repeats, of the shortest length for which enough stands before it.

    A pattern that is there often begins with five letters that are there as
    often; where no five letters are, no pattern is.
    """
    tail = text[-TAIL:]
    starts = Counter(tail[i : i + SHORTEST] for i in range(len(tail) - SHORTEST + 1))
    often = {s for s, n in starts.items() if n >= TIMES}
    if not often:
        return None
    for length in range(SHORTEST, LONGEST + 1):
        if len(text) < length * 5:
            continue
        for i in range(len(tail) - length * 4):
            if tail[i : i + SHORTEST] in often:
                pattern = tail[i : i + length]
                if pattern.strip() and tail.count(pattern) >= TIMES:
                    place = text.find(pattern)
                    if place > LEFT:
                        return place
                    break
    return None


def without_repetition(text: str | None, runs: int = RUNS) -> str | None:
    """The text up to a word that follows itself too often, or up to a pattern that its end repeats; else as it is."""
    if text is None or len(text) < LEAST:
        return text
    words = text.split()
    if len(words) < WORDS:
        return text
    first = _word_run(words, runs)
    if first is not None:
        kept = " ".join(words[:first]).rstrip()
        return kept + NOTE if len(kept) > LEFT else text
    place = _pattern_place(text)
    return text if place is None else text[:place].rstrip() + NOTE


def truncated(answers: DataFrame, key: str, text: str) -> DataFrame:
    """key, kept (the text without its repetition) and cut (whether something was left out)."""
    return rows_of(answers, key, text, lambda x: [(k := without_repetition(x), k != x)], "array<struct<kept:string,cut:boolean>>")
