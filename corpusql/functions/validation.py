"""Content validation, sanitising and quality, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from corpusql.functions import lexicon
from corpusql.functions.text import words

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


@dataclass(frozen=True)
class Limits:
    min_bytes: int = 10
    max_bytes: int = 10 * 1024 * 1024
    max_line_bytes: int = 10_000
    max_control: float = 0.1
    max_repetition: int = 50
    file_types: tuple[str, ...] = tuple(lexicon.FILE_TYPES)
    blocked: tuple[str, ...] = tuple(lexicon.BLOCKED)
    sensitive: tuple[str, ...] = field(default_factory=lambda: tuple(lexicon.SENSITIVE))


_THREE_DIGITS = ("like", "[0-9]{3}")
#: Of patterns, what every match contains; nearly all texts have none of it, and it is found sooner.
#: No replacement brings it in, so it is looked for in the text as it came.
NEEDS = {
    lexicon.SENSITIVE[0]: _THREE_DIGITS,
    lexicon.SENSITIVE[1]: _THREE_DIGITS,
    lexicon.SENSITIVE[2]: _THREE_DIGITS,
    lexicon.SENSITIVE[3]: ("has", "@"),
    lexicon.SENSITIVE[4]: _THREE_DIGITS,
    lexicon.SENSITIVE[5]: ("like", r"[0-9]\.[0-9]"),
    lexicon.SENSITIVE[6]: ("has", "://"),
    lexicon.BLOCKED[0]: ("has", "<script"),
    lexicon.BLOCKED[1]: ("has", "javascript:"),
    lexicon.BLOCKED[2]: ("has", "vbscript:"),
    lexicon.BLOCKED[3]: ("has", "="),
}


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _with_needs(text: Column, patterns: tuple[str, ...], f: Callable[[Column, dict], Column]) -> Column:
    """``f`` of a text and, by pattern, of whether it has what the pattern needs; each need is looked for once."""
    kinds = sorted({NEEDS[p] for p in patterns if p in NEEDS})
    found = lambda t: [(t.contains(what) if how == "has" else t.rlike(what)).alias(f"n{i}") for i, (how, what) in enumerate(kinds)]
    own = lambda x: {p: x[f"n{kinds.index(NEEDS[p])}"] if p in NEEDS else F.lit(True) for p in patterns}
    return once(text, lambda t: once(F.struct(t.alias("t"), *found(t)), lambda x: f(x["t"], own(x))))


def some(*issues: Column) -> Column:
    """Array of the issues that apply."""
    return F.array_compact(F.array(*issues))


def control_ratio(text: Column) -> Column:
    n = F.length(text)
    return F.when(n == 0, 0.0).otherwise((n - F.length(F.regexp_replace(text, CONTROL, ""))) / n)


def _matches(text: Column, pattern: str) -> Column:
    how, what = NEEDS.get(pattern, ("", ""))
    return text.contains(what) & text.rlike(pattern) if how == "has" else text.rlike(pattern)


def errors(text: Column, file_type: Column | None = None, limits: Limits = Limits()) -> Column:
    """What makes content invalid."""
    size = F.octet_length(text)
    found = [
        F.when(F.trim(text) == "", "empty"),
        F.when(size < limits.min_bytes, "too small"),
        F.when(size > limits.max_bytes, "too large"),
        F.when(control_ratio(text) > limits.max_control, "control characters"),
        *[F.when(_matches(text, p), f"blocked {i}") for i, p in enumerate(limits.blocked)],
    ]
    if file_type is not None:
        found.append(F.when(~F.lower(file_type).isin(list(limits.file_types)), "file type"))
    return some(*found)


def long_lines(text: Column, limits: Limits = Limits()) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.octet_length(x) > limits.max_line_bytes)).cast("long")


def sensitive_hits(text: Column, limits: Limits = Limits()) -> Column:
    """Numbers of the sensitive patterns that occur, from 0."""
    return _with_needs(text, limits.sensitive, lambda t, need: some(*[F.when(need[p] & t.rlike(p), F.lit(i)) for i, p in enumerate(limits.sensitive)]))


def sanitise(text: Column, limits: Limits = Limits()) -> Column:
    """Control characters out, white space to one space, sensitive data and then blocked patterns replaced, in order."""
    text = F.trim(F.regexp_replace(F.regexp_replace(text, CONTROL, ""), r"\s+", " "))
    patterns = [(p, "[REDACTED]") for p in limits.sensitive] + [(p, "[REMOVED]") for p in limits.blocked]

    def replaced(t: Column, need: dict) -> Column:
        any_ = F.lit(False)
        for p, _ in patterns:
            any_ = any_ | need[p]
        out = t
        for p, to in patterns:
            out = F.regexp_replace(out, p, to)
        return F.when(any_, out).otherwise(t)

    return _with_needs(text, (*limits.sensitive, *limits.blocked), replaced)


def repeats(w: Column, most: int) -> Column:
    """Whether some word of an array occurs more than ``most`` times: once sorted, it stands ``most`` places apart.

    Such a word covers two neighbours among the places that are ``most // 2`` apart, so only
    those are compared, and the places before them where they are equal.
    """
    step = max(most // 2, 1)

    def far(s: Column) -> Column:
        # Of a long enough run that holds places j and j + step, the first is among the step places up to j.
        j = F.sequence(F.lit(0), F.size(s) - 1, F.lit(step))
        begins = lambda j: F.exists(F.sequence(F.greatest(j - step + 1, F.lit(0)), j), lambda i: F.coalesce(F.get(s, i) == F.get(s, i + most), F.lit(False)))
        return F.exists(j, lambda j: F.coalesce(F.get(s, j) == F.get(s, j + step), F.lit(False)) & begins(j))

    # That many words have to be equal to others.
    return F.when(F.size(w) - F.size(F.array_distinct(w)) >= most, once(F.sort_array(w), far)).otherwise(False) if most > 0 else F.size(w) > 0


def quality(text: Column, limits: Limits = Limits()) -> Column:
    """100 less what repetition, poor vocabulary, sentence length and few letters cost; 0 at least."""
    # One element, so that the text is split once.
    w = once(words(F.lower(text)), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"), repeats(w, limits.max_repetition).alias("repeats")))
    pieces = F.size(F.split(text, "[.!?]"))
    average = F.floor(F.octet_length(text) / pieces)
    chars = F.length(text)
    letters = chars - F.length(F.regexp_replace(text, r"\p{L}+", ""))

    def score(w: Column) -> Column:
        return (
            F.lit(100.0)
            - F.when(w["repeats"], 20.0).otherwise(0.0)
            - F.when((w["n"] > 0) & (w["distinct"] / w["n"] < 0.3), 15.0).otherwise(0.0)
            - F.when(average > 500, 10.0).when(average < 10, 5.0).otherwise(0.0)
            - F.when((chars > 0) & (letters / chars < 0.3), 20.0).otherwise(0.0)
        )

    return F.greatest(F.get(F.transform(F.array(w), score), F.lit(0)), F.lit(0.0))


def quick_valid(text: Column, limits: Limits = Limits()) -> Column:
    size = F.octet_length(text)
    ok = (F.trim(text) != "") & size.between(limits.min_bytes, limits.max_bytes)
    for p in limits.blocked:
        ok = ok & ~_matches(text, p)
    return ok


def validate(text: Column, file_type: Column | None = None, limits: Limits = Limits()) -> Column:
    """Struct of valid, errors, warnings, sanitised (null where invalid) and quality."""
    bad = errors(text, file_type, limits)
    hits = sensitive_hits(text, limits)
    warnings = some(F.when(F.size(hits) > 0, "sensitive data"), F.when(long_lines(text, limits) > 0, "long lines"))
    return F.struct(
        (F.size(bad) == 0).alias("valid"),
        bad.alias("errors"),
        warnings.alias("warnings"),
        F.when(F.size(bad) == 0, sanitise(text, limits)).alias("sanitised"),
        quality(text, limits).alias("quality"),
    )
