"""Scores of a chunk for a query, as column expressions; ``as_of`` stands for now."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpusql.functions import lexicon
from corpusql.functions.text import contains_any, words


class Content:
    """A text with its words and its lower-case form, as columns where they have been made before."""

    def __init__(self, text: Column, words_: Column | None = None, low: Column | None = None):
        self.text = text
        self.words = words(text) if words_ is None else words_
        self.low = F.lower(text) if low is None else low


def _of(content: Column | Content) -> Content:
    return content if isinstance(content, Content) else Content(content)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def semantic(similarity: Column, a: Column) -> Column:
    by_complexity = F.when(a["complexity"] == "Moderate", 1.05).when(a["complexity"] == "Complex", 1.1).when(a["complexity"] == "Expert", 1.15).otherwise(1.0)
    by_type = F.when(a["type"] == "Factual", 1.1).when(a["type"] == "Analytical", 1.05).when(a["type"] == "Procedural", 0.95).otherwise(1.0)
    return clamp(similarity * by_complexity * by_type)


def keyword(base: Column, a: Column, content: Column | Content) -> Column:
    low = _of(content).low
    terms = a["key_terms"]
    found = F.size(F.filter(terms, lambda t: low.contains(t)))
    boost = F.when(found > 0, 1 + 0.2 * found / F.size(terms)).otherwise(1.0)
    by_type = F.when(a["type"] == "Procedural", 1.2).when(a["type"] == "Navigational", 1.25).when(a["type"] == "Comparative", 1.1).otherwise(1.0)
    return clamp(base * boost * by_type)


def readability(content: Column | Content) -> Column:
    content = _of(content)
    n = F.size(content.words)
    sentences = F.size(F.split(content.text, r"\."))
    return F.when(n == 0, 0.5).otherwise(clamp((206.835 - 1.015 * n / sentences) / 100))


def completeness(content: Column | Content) -> Column:
    n = F.size(_of(content).words)
    return F.when(n <= 20, 0.3).when(n <= 50, 0.6).when(n <= 200, 1.0).when(n <= 500, 0.9).otherwise(0.7)


def structure(content: Column | Content) -> Column:
    content = _of(content).text
    colons = F.length(content) - F.length(F.replace(content, F.lit(":"), F.lit("")))
    return clamp(
        0.5
        + F.when(content.contains("\n"), 0.1).otherwise(0.0)
        + F.when(content.contains("- ") | content.contains("* "), 0.1).otherwise(0.0)
        + F.when(content.contains("#"), 0.1).otherwise(0.0)
        + F.when(colons > 2, 0.1).otherwise(0.0)
    )


def depth(content: Column | Content) -> Column:
    content = _of(content)
    w, low = content.words, content.low
    hints = sum((F.when(low.contains(x), 1).otherwise(0) for x in lexicon.INFORMATIVE), F.lit(0))
    return F.when(F.size(w) == 0, 0.0).otherwise(clamp(F.size(F.array_distinct(w)) / F.size(w) + hints / 10.0))


def document_quality(content: Column | Content, authority: Column | None = None) -> Column:
    authority = F.lit(0.5) if authority is None else authority
    return readability(content) * 0.2 + completeness(content) * 0.3 + F.coalesce(authority, F.lit(0.5)) * 0.3 + structure(content) * 0.1 + depth(content) * 0.1


def days_old(created_at: Column, as_of: Column) -> Column:
    return F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(created_at)) / 86400)


def freshness(created_at: Column, as_of: Column, a: Column) -> Column:
    d = days_old(created_at, as_of)
    factor = F.when(a["temporal"], F.lit(0.8) * F.when(d <= 30, 1.2).otherwise(1.0)).otherwise(1.0)
    return clamp(F.exp(-d / 365.0) * factor)


def context(a: Column, topic: Column, source_type: Column) -> Column:
    low = F.lower(topic)
    by_topic = F.when(topic.isNull(), 0.0).otherwise(F.when(F.exists(a["key_terms"], lambda t: low.contains(F.lower(t))), 0.8).otherwise(0.2) * 0.3)
    fits = (
        ((a["intent"] == "Learning") & source_type.isin("tutorial", "guide"))
        | ((a["intent"] == "ProblemSolving") & source_type.isin("solution", "troubleshooting"))
        | ((a["intent"] == "InformationSeeking") & source_type.isin("reference", "documentation"))
    )
    by_source = F.when(source_type.isNull(), 0.0).otherwise(F.when(fits, 0.9).otherwise(0.5) * 0.2)
    return clamp(0.5 + by_topic + by_source)


def boost(a: Column, content: Column | Content) -> Column:
    low = _of(content).low
    out = F.lit(1.0)
    for intent, (factor, hints) in lexicon.BOOSTS.items():
        out = F.when((a["intent"] == intent) & contains_any(low, hints), factor).otherwise(out)
    return out


def overall(semantic_: Column, keyword_: Column, quality_: Column, freshness_: Column, context_: Column, boost_: Column, weights: tuple[float, ...] = lexicon.PRESETS["general"]) -> Column:
    parts = (semantic_, keyword_, quality_, freshness_, context_)
    return sum((p * w for p, w in zip(parts, weights)), F.lit(0.0)) * boost_


def confidence(*scores: Column) -> Column:
    """1 less the population standard deviation."""
    n = len(scores)
    mean = sum(scores, F.lit(0.0)) / n
    return clamp(1 - F.sqrt(sum(((x - mean) * (x - mean) for x in scores), F.lit(0.0)) / n))


def rerank_quality(content: Column, has_title: Column | None = None, has_author: Column | None = None, least: int = 100) -> Column:
    has_title, has_author = (F.lit(False) if x is None else x for x in (has_title, has_author))
    n, sentences = F.size(words(content)), F.size(F.split(content, r"\."))
    return clamp(
        0.5
        + F.when(F.octet_length(content) >= least, 0.2).otherwise(-0.2)
        + F.when((n > 10) & (sentences > 1), 0.2).otherwise(0.0)
        + F.when(content.contains("\n") | content.contains("- ") | content.contains("1. "), 0.1).otherwise(0.0)
        + F.when(has_title, 0.1).otherwise(0.0)
        + F.when(has_author, 0.1).otherwise(0.0)
    )


def recency(created_at: Column, as_of: Column, recent_days: int = 7, recent: float = 1.1, decay: float = 0.999) -> Column:
    d = days_old(created_at, as_of)
    return F.when(d <= recent_days, recent).otherwise(F.greatest(F.pow(F.lit(decay), d), F.lit(0.1)))


FACTORS = ("semantic similarity", "keyword relevance", "document quality", "content freshness", "context alignment")


def signals(semantic_: Column, keyword_: Column, quality_: Column, boost_: Column, freshness_: Column | None = None) -> Column:
    """Struct of what speaks for and against a result.

    Scores are sums that can land on a threshold; they are rounded to 9 digits first.
    """
    semantic_, keyword_, quality_, boost_ = (F.round(x, 9) for x in (semantic_, keyword_, quality_, boost_))
    good = [F.when(semantic_ > 0.7, "high semantic similarity"), F.when(keyword_ > 0.6, "strong keyword match"), F.when(quality_ > 0.7, "high quality"), F.when(boost_ > 1.1, "fits the intent")]
    bad = [F.when(semantic_ < 0.3, "low semantic similarity"), F.when(keyword_ < 0.2, "weak keyword match")]
    if freshness_ is not None:
        bad.append(F.when(F.round(freshness_, 9) < 0.3, "may be outdated"))
    return F.struct(F.array_compact(F.array(*good)).alias("positive"), F.array_compact(F.array(*bad)).alias("negative"))


def top_factors(named: dict[str, Column], n: int = 3) -> Column:
    """The ``n`` largest factors, as ``name: value``; of equal ones that named first."""
    pairs = F.array(*[F.struct((-v).alias("v"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, v) in enumerate(named.items())])
    return F.transform(F.slice(F.array_sort(pairs), 1, n), lambda x: F.format_string("%s: %.3f", x["k"], F.round(-x["v"], 3)))


def recommended(a: Column, content: Column, quality_: Column, positive: Column) -> Column:
    """What may give better results."""
    return F.array_compact(
        F.array(
            F.when((a["type"] == "Procedural") & ~F.lower(content).contains("step"), "look for step-by-step instructions"),
            F.when((a["type"] == "Factual") & (F.round(quality_, 9) < 0.5), "look for more authoritative sources"),
            F.when(F.size(positive) == 0, "refine the query terms"),
        )
    )


def explanation(a: Column, content: Column, semantic_: Column, keyword_: Column, quality_: Column, freshness_: Column, context_: Column, boost_: Column) -> Column:
    """Struct of factors, signals for and against, recommendations, and all scores by name."""
    five = (semantic_, keyword_, quality_, freshness_, context_)
    s = signals(semantic_, keyword_, quality_, boost_, freshness_)
    names = ("semantic_score", "keyword_score", "quality_score", "freshness_score", "context_score", "boost_multiplier")
    return F.struct(
        top_factors(dict(zip(FACTORS, five))).alias("factors"),
        s["positive"].alias("positive"),
        s["negative"].alias("negative"),
        recommended(a, content, quality_, s["positive"]).alias("recommendations"),
        F.create_map(*[x for k, v in zip(names, (*five, boost_)) for x in (F.lit(k), v)]).alias("debug"),
    )


def explained(rank: Column, overall_: Column, confidence_: Column, factors: Column, positive: Column, content: Column | Content) -> Column:
    """Lines that tell a reader why a result stands where it does."""
    return F.format_string(
        "Rank %d: overall %.3f (confidence %.3f)\n- factors: %s\n- for it: %s\n- %s...", rank, F.round(overall_, 3), F.round(confidence_, 3), F.array_join(factors, ", "), F.array_join(positive, ", "), F.substring(content, 1, 100)
    )
