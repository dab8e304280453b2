"""Scores and routes of texts and answers as Column expressions.

The word lists and weights are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, hits, literal, words

HEDGES = (
    ("i'm not sure", 0.25), ("i'm not certain", 0.25), ("i think", 0.10), ("i believe", 0.10), ("might be", 0.10), ("could be", 0.08), ("possibly", 0.08), ("probably", 0.07), ("approximately", 0.05), ("roughly", 0.05),
    ("you may want to verify", 0.20), ("please verify", 0.15), ("i'm not 100%", 0.20), ("not entirely sure", 0.20), ("as far as i know", 0.15), ("to the best of my knowledge", 0.15), ("this may be incorrect", 0.30), ("double-check", 0.15),
)
BOOSTS = (("the answer is", 0.05), ("definitively", 0.05), ("proven", 0.08), ("therefore", 0.03), ("thus", 0.03), ("equals", 0.05), ("it is known that", 0.08), ("formally", 0.08))
DOMAINS = {"math": 0.60, "code": 0.65, "factual": 0.55, "general": 0.50}
TIER_SCORES = {"tiny": 0.99, "memory": 0.95, "self_play": 0.93}
CERTAIN = (r"^\w+\s+is\s+\w+\.", r"^the\s+\w+\s+of\s+\w+\s+is", r"^yes[,\.]", r"^no[,\.]", r"^\d+$", r"^the answer is")
UNCERTAIN = (r"i('m| am) not (sure|certain)", r"i (think|believe|suppose)", r"it (might|could|may) be", r"possibly|probably|perhaps", r"i('m| am) unsure", r"you (should|may want to) verify")
CODE_WORDS = ("code", "function", "class", "implement", "debug", "algorithm", "python", "script")
MATH_WORDS = ("calculate", "compute", "sum", "multiply", "divide", "add", "subtract", "integral", "derivative", "equation", "solve", "math", "algebra", "factorial", "prime", "sqrt", "root", "percentage", "average")
GREETINGS = ("hello", "hi", "hey", "good morning", "good evening", "good afternoon", "howdy", "greetings", "what's up", "sup")
MEMORY_PHRASES = ("my name", "my job", "my work", "where do i", "where am i", "what do i", "who am i", "remember", "you know about me")
PERSONAL = ("my name", "i am", "i work", "i live", "i have", "i like", "i want", "i need", "remember")
TIERS = ("tiny", "small", "medium", "swarm")
WATCH_HEDGES = ("i think", "i believe", "i'm not sure", "might be", "could be", "possibly", "probably", "i'm not certain", "you should verify", "approximately", "roughly")
WATCH_CERTAIN = ("the answer is", "equals", "=", "therefore", "thus", "definitively", "confirmed", "proven")
COMPLEX_WORDS = ("architecture", "refactor", "design", "debug", "optimize", "security", "concurrency", "what is wrong")
SIMPLE_WORDS = ("what is", "who is", "define", "meaning of", "hello world", "print", "for loop", "if else", "simple function", "basic script", "my name", "remember", "you know", "syntax", "typo", "rename")
EXPLAIN_WORDS = ("explain", "describe", "what is", "how does", "why does", "compare", "difference between", "pros and cons", "step by step", "walk me through")
HEAVY_WORDS = ("prove", "formal proof", "theorem", "hypothesis", "simulate", "generate dataset", "train a model", "write a full", "entire codebase", "complete system", "research paper", "literature review")
TOKEN_CODE = ("implement", "write", "code", "function", "class", "create", "build", "design", "develop", "refactor", "complete", "full")
TOKEN_REASON = ("explain", "detail", "comprehensive", "thorough", "compare", "analyze", "reason", "plan", "decompose", "evaluate", "why", "how does", "describe", "architecture", "trade-off")
TOKEN_PROJECT = ("file", "module", "engine", "brain", "router", "what does")


def low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def clamp(x: Column, a: float, b: float) -> Column:
    return F.greatest(F.lit(a), F.least(F.lit(b), x))


def weighted(text: Column, table: tuple[tuple[str, float], ...]) -> Column:
    """The sum of the weights of the phrases in text."""
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(w).alias("w")) for p, w in table])
    return F.aggregate(F.filter(pairs, lambda s: F.contains(text, s["p"])), F.lit(0.0), lambda a, s: a + s["w"])


def label(score: Column) -> Column:
    return F.when(score >= 0.85, "High").when(score >= 0.65, "Moderate").when(score >= 0.40, "Low").otherwise("Very low")


def text_confidence(text: Column, domain: str = "general") -> Column:
    """Confidence from an answer's hedges and assertions, 0.1 to 0.9."""
    t = low(text)
    return F.round(clamp(F.lit(DOMAINS.get(domain, 0.5)) - weighted(t, HEDGES) + weighted(t, BOOSTS), 0.1, 0.9), 3)


def combine_verification(score: Column, verified: Column, refuted: Column) -> Column:
    return F.round(clamp(score + F.when(verified, 0.15).when(refuted, -0.40).otherwise(0.0), 0.05, 0.99), 3)


def calibrate(raw: Column, answer: Column, tier: Column, verified: Column) -> Column:
    """A raw score corrected by tier, verification and the answer's wording, in that order."""
    t = F.trim(low(answer))
    count = lambda patterns: sum((F.when(t.rlike(p), 1).otherwise(0) for p in patterns), F.lit(0))
    unsure, sure = count(UNCERTAIN), count(CERTAIN)
    by_tier = F.element_at(F.create_map(*[F.lit(x) for k, v in TIER_SCORES.items() for x in (k, v)]), tier)
    short = (F.size(words(answer)) < 15) & ~contains_any(t, ("think", "believe", "maybe"))
    score = F.when(by_tier.isNotNull(), by_tier).when(verified, F.lit(0.96)).when(unsure > 0, F.greatest(F.lit(0.25), raw - unsure * 0.10)).when(sure > 0, F.least(F.lit(0.90), 0.72 + sure * 0.06)).when(short, F.lit(0.78)).otherwise(F.greatest(raw, F.lit(0.72)))
    return F.round(clamp(score, 0.0, 1.0), 3)


def watchdog_entropy(text: Column) -> Column:
    t = low(text)
    return clamp(2.0 + hits(t, WATCH_HEDGES) * 0.4 - hits(t, WATCH_CERTAIN) * 0.3, 0.5, 4.5)


def entropy(logprobs: Column) -> Column:
    """Shannon entropy of the normalized probabilities of top-k alternatives."""
    top = F.array_max(logprobs)
    p = F.transform(logprobs, lambda x: F.exp(x - top))
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x / total > 1e-10, (x / total) * F.ln(x / total)).otherwise(0.0))


def logprob_confidence(mean: Column, mean_entropy: Column, spike_rate: Column) -> Column:
    """A sigmoid of the mean log probability less penalties for entropy and spikes."""
    base = 1 / (1 + F.exp(-(mean * 0.35 + 0.85)))
    return F.round(clamp(base - F.least(mean_entropy / 10.0, F.lit(0.3)) - spike_rate * 0.3, 0.05, 0.98), 3)


def features(query: Column) -> dict[str, Column]:
    """What a route is chosen by."""
    w, t = words(query), F.trim(low(query))
    n = F.size(w)
    code, math = F.arrays_overlap(w, literal(CODE_WORDS)), F.arrays_overlap(w, literal(MATH_WORDS))
    greeting = t.isin(*GREETINGS) | ((n <= 3) & F.arrays_overlap(w, literal(("hello", "hi", "hey"))))
    average = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)) / F.greatest(n, F.lit(1))
    complexity = F.least(F.lit(1.0), n / 30.0 * 0.3 + F.when(code, 0.3).otherwise(0.0) + average / 8.0 * 0.2 + F.when(greeting, 0.0).otherwise(0.2))
    return {"word_count": n, "code": F.coalesce(code, F.lit(False)), "math": F.coalesce(math, F.lit(False)), "question": F.contains(F.coalesce(query, F.lit("")), F.lit("?")), "greeting": F.coalesce(greeting, F.lit(False)), "memory": contains_any(t, MEMORY_PHRASES), "average_length": average, "complexity": complexity}


def feature_bin(f: dict[str, Column]) -> Column:
    part = lambda c, yes, no: F.when(c, yes).otherwise(no)
    return F.concat_ws("|", part(f["code"], "code", "nocode"), part(f["math"], "math", "nomath"), part(f["greeting"], "greet", "nogreet"), part(f["memory"], "mem", "nomem"), F.when(f["word_count"] < 5, "short").when(f["word_count"] < 20, "med").otherwise("long"))


def liquid_route(f: dict[str, Column], bins: dict[str, Column], confidence: dict[str, float], latency: dict[str, float], limit: float = 5000.0) -> Column:
    """The tier of the best learned score; the first of equals in the order of tiers."""
    bonus = {"medium": F.when(f["complexity"] > 0.7, 0.3).otherwise(0.0) + F.when(f["code"], 0.2).otherwise(0.0), "small": F.when((f["complexity"] > 0.4) & (f["complexity"] <= 0.7), 0.2).otherwise(0.0), "tiny": F.when(f["complexity"] <= 0.4, 0.2).otherwise(0.0), "swarm": F.lit(0.0)}
    scored = [F.struct((bins[t] + (confidence[t] - 0.5) * 0.5 - max(0.0, (latency[t] - limit) / 10000) * 0.2 + bonus[t]).alias("s"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, t in enumerate(TIERS)]
    return F.when(f["greeting"] | f["memory"] | (f["math"] & (f["word_count"] < 10)), "tiny").otherwise(F.greatest(*scored)["t"])


def task_route(query: Column) -> Column:
    """tiny, heavy, small, medium or full."""
    q = F.trim(low(query))
    n = F.size(words(query))
    marks = F.length(q) - F.length(F.translate(q, ".?!", ""))
    score = F.least(n / 60.0, F.lit(0.3)) + F.when(contains_any(q, EXPLAIN_WORDS), 0.1).otherwise(0.0) + F.least(marks * 0.05, F.lit(0.15)) + F.when(contains_any(q, ("`", "def ", "class ", "import ")), 0.15).otherwise(0.0)
    tiny = q.rlike(r"^(hi|hello|hey|yo|sup|howdy)\b|^(thanks|thank you|thx|ty)\b|^(bye|goodbye|see you|cya)\b|^\s*\d[\d\s+\-*/^().]+=?\s*$")
    return F.when(tiny, "tiny").when(contains_any(q, HEAVY_WORDS), "heavy").when(score < 0.2, "small").when(score < 0.5, "medium").otherwise("full")


def complexity_class(query: Column) -> Column:
    q, n = low(query), F.size(words(query))
    lines = F.length(q) - F.length(F.translate(q, "\n", ""))
    return F.when(contains_any(q, COMPLEX_WORDS), "complex").when(n <= 5, "simple").when((lines > 5) | (n > 50), "complex").when(contains_any(q, SIMPLE_WORDS), "simple").otherwise("medium")


def max_tokens(query: Column) -> Column:
    q, n = low(query), F.size(words(query))
    return F.when(contains_any(q, TOKEN_CODE), 2048).when(contains_any(q, TOKEN_REASON), 2048).when(contains_any(q, TOKEN_PROJECT), 1536).when(n <= 5, 384).when(q.rlike("^(is|are|does|do|can|will|should) "), 384).when(q.rlike("^(what is|what are|define|meaning of) "), 512).otherwise(768)


def importance(user: Column, answer: Column) -> Column:
    """How much an exchange is worth remembering."""
    return F.least(F.lit(1.0), 0.4 + F.when(F.length(answer) > 300, 0.1).otherwise(0.0) + F.when(F.contains(user, F.lit("?")), 0.1).otherwise(0.0) + F.when(contains_any(low(user), PERSONAL), 0.3).otherwise(0.0))


def pair_quality(feedback: Column, confidence: Column, verified: Column, latency: Column) -> Column:
    return F.least(F.lit(1.0), feedback / 5 + confidence * 0.1 + F.when(verified, 0.1).otherwise(0.0) + F.least(F.lit(0.05), 500 / F.greatest(latency, F.lit(1.0))))


def quality_points(answer: Column, verified: Column, confidence: Column, feedback: Column, tier: Column, latency: Column) -> tuple[Column, Column, Column]:
    """(score of 0 to 1, reasons, disqualifiers) of a training pair."""
    n = F.length(answer)
    good = ((verified, 0.40, "verified"), (confidence >= 0.85, 0.25, "high confidence"), ((confidence >= 0.70) & (confidence < 0.85), 0.15, "good confidence"), (feedback == 5, 0.20, "marked excellent"), (feedback == 4, 0.10, "marked good"), (tier == "self_play", 0.35, "self-play"), ((latency < 3000) & (latency > 0), 0.05, "fast"), ((n > 50) & (n < 800), 0.05, "good length"))
    bad = ((feedback == 1, -0.50, "marked wrong"), (confidence < 0.35, -0.20, "low confidence"), (n < 20, -0.15, "too short"), (n > 2000, -0.10, "too long"))
    total = sum((F.when(c, w).otherwise(0.0) for c, w, _ in (*good, *bad)), F.lit(0.0))
    demo = F.contains(low(answer), F.lit("demo mode"))
    names = lambda table: F.filter(F.array(*[F.when(c, name) for c, _, name in table]), lambda x: x.isNotNull())
    return F.round(clamp(F.when(demo, 0.0).otherwise(total), 0.0, 1.0), 3), names(good), F.concat(names(bad), F.when(demo, F.array(F.lit("demo mode"))).otherwise(F.array().cast("array<string>")))
