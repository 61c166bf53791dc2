"""Understanding query texts: validity, type, intent, expansion."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpusql.functions import lexicon
from corpusql.functions.text import contains_any, strings, words
from corpusql.functions.validation import some


def tokens(text: Column) -> Column:
    """Of query processing: letters, digits, ``'`` and ``-``, without its stop words."""
    kept = F.transform(words(F.lower(text)), lambda w: F.regexp_replace(w, r"[^a-z0-9'-]", ""))
    return F.filter(kept, lambda w: (w != "") & ~w.isin(lexicon.PROCESSOR_STOP_WORDS))


def issues(text: Column, least: int = 3, most: int = 2000, max_terms: int = 50) -> Column:
    """What makes a query invalid; a double space does."""
    t = F.trim(text)
    bad = F.lit(False)
    for p in lexicon.MALICIOUS:
        bad = bad | t.rlike(p)
    full = t != ""
    return some(
        F.when(~full, "EmptyQuery"),
        F.when(full & (F.octet_length(t) < least), "TooShort"),
        F.when(full & (F.octet_length(t) > most), "TooLong"),
        F.when(full & (F.size(words(t)) > max_terms), "TooManyTerms"),
        F.when(full & bad, "MaliciousContent"),
        F.when(full & t.contains("  "), "ExcessiveWhitespace"),
    )


def classify(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(contains_any(low, lexicon.COMMANDS), "Command")
        .when(contains_any(low, lexicon.QUESTIONS) | text.endswith("?"), "Question")
        .when(contains_any(low, lexicon.TECHNICAL), "Technical")
        .when(contains_any(low, lexicon.CONVERSATIONAL), "Conversational")
        .when(F.size(words(text)) >= 2, "Search")
        .otherwise("Unknown")
    )


def class_confidence(text: Column, kind: Column) -> Column:
    low = F.lower(text)
    more = (
        F.when((kind == "Question") & text.endswith("?"), 0.3)
        .when((kind == "Command") & low.startswith("show"), 0.2)
        .when((kind == "Technical") & low.contains("api"), 0.2)
        .otherwise(0.0)
    )
    return F.least(F.lit(1.0), F.lit(0.5) + F.when(F.octet_length(text) > 20, 0.2).otherwise(0.0) + more)


def search_options(kind: Column) -> Column:
    """Threshold and number of chunks for a type of query."""
    return F.struct(
        F.when(kind == "Technical", 0.8).when(kind == "Search", 0.6).otherwise(0.7).alias("threshold"),
        F.when(kind == "Technical", 5).when(kind == "Search", 15).otherwise(10).alias("chunks"),
    )


def analysis(text: Column) -> Column:
    """Struct of type, intent, complexity, key_terms, temporal (bool) as relevance scoring reads a query."""
    low = F.lower(text)
    n = F.size(words(low))
    kind = (
        F.when(low.startswith("what is") | low.startswith("define"), "Factual")
        .when(low.startswith("how to") | low.startswith("how do"), "Procedural")
        .when(low.contains(" vs ") | low.contains(" versus ") | low.contains("compare"), "Comparative")
        .when(low.startswith("why") | low.startswith("explain"), "Analytical")
        .when(low.startswith("find") | low.contains("document") | low.contains("page"), "Navigational")
        .when((n <= 5) & ~low.contains("?"), "Conversational")
        .otherwise("Factual")
    )
    intent = (
        F.when(kind == "Procedural", "ProblemSolving")
        .when(kind == "Comparative", "Decision")
        .when(kind == "Analytical", "Learning")
        .when((kind == "Factual") & (n <= 5), "Exploration")
        .otherwise("InformationSeeking")
    )
    complexity = F.when(n.between(1, 3), "Simple").when(n.between(4, 7), "Moderate").when(n.between(8, 15), "Complex").otherwise("Expert")
    return F.struct(kind.alias("type"), intent.alias("intent"), complexity.alias("complexity"), key_terms(low).alias("key_terms"), contains_any(low, lexicon.TEMPORAL).alias("temporal"))


def key_terms(low: Column) -> Column:
    return F.filter(words(low), lambda w: ~w.isin(lexicon.KEY_TERM_STOP_WORDS) & (F.octet_length(w) > 2))


def entities(text: Column) -> Column:
    """Adjacent pairs of capitalised words of the text as it was written."""
    w = words(text)
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.filter(pairs, lambda p: p.rlike(r"^\p{Lu}\S* \p{Lu}"))


def strategy(a: Column) -> Column:
    """Retrieval strategy for an ``analysis``."""
    return (
        F.when(a["type"].isin("Procedural", "Navigational"), "Keyword")
        .when(a["intent"] == "Learning", "Quality")
        .when(a["temporal"], "Fresh")
        .when(a["type"] == "Analytical", "Semantic")
        .otherwise("Balanced")
    )


def lookup(w: Column, *tables: dict[str, list[str]], most: int = 10) -> Column:
    """Ordered, distinct expansions of words, table after table for each word."""
    def one(x: Column) -> Column:
        parts = []
        for t in tables:
            m = F.create_map(*[c for k, v in t.items() for c in (F.lit(k), strings(v))])
            parts.append(F.coalesce(F.try_element_at(m, x), F.array().cast("array<string>")))
        return F.concat(*parts)

    return F.slice(F.array_distinct(F.flatten(F.transform(w, one))), 1, most)


def synonyms(text: Column, most: int = 10) -> Column:
    return lookup(words(F.lower(text)), lexicon.GENERAL_SYNONYMS, lexicon.TECHNICAL_SYNONYMS, most=most)


def semantic_terms(text: Column, most: int = 10) -> Column:
    return lookup(words(F.lower(text)), lexicon.HYPERNYMS, lexicon.RELATED, most=most)


def domain_terms(text: Column, most: int = 10) -> Column:
    return lookup(words(F.lower(text)), lexicon.DOMAIN, lexicon.HIERARCHIES, most=most)


def spelled(text: Column) -> Column:
    for wrong, right in lexicon.SPELLINGS.items():
        text = F.regexp_replace(text, rf"\b{wrong}\b", right)
    return text


def acronyms(text: Column) -> Column:
    """Each acronym followed by what it stands for; in one pass, so no expansion is expanded."""
    for short, long in lexicon.ACRONYMS.items():
        text = F.regexp_replace(text, rf"\b{short}\b", f"{short} {long}")
    return text


def negations(text: Column) -> Column:
    """Array of (term, place, handling): the first occurrence of each negation that a word and a space follow."""
    low = F.lower(text)
    found = []
    for p in lexicon.NEGATIONS:
        at = F.instr(low, p)
        rest = F.substring(low, at + len(p), F.length(low))
        term = F.substring_index(rest, " ", 1)
        handling = F.when(F.octet_length(term) < 3, "keep").when(term == "error", "success").when(term == "problem", "solution").otherwise("exclude")
        found.append(F.when((at > 0) & rest.contains(" ") & (term != ""), F.struct(term.alias("term"), (at - 1).alias("place"), handling.alias("handling"))))
    return some(*found)


def _handled(by: str):
    return lambda x: x["handling"] == by


def without_negations(text: Column) -> Column:
    """Negated errors and problems put the other way, all else kept; single spaces."""
    def put(found: Column) -> Column:
        out = text
        for wrong, right in (("error", "success"), ("problem", "solution")):
            out = F.replace(out, F.lit(wrong), F.when(F.exists(found, _handled(right)), right).otherwise(wrong))
        return F.trim(F.regexp_replace(out, r"\s+", " "))

    return once(negations(text), put)


def alternatives(text: Column) -> Column:
    low = F.lower(text)
    asks = text.contains("?")
    plain = F.trim(F.replace(text, F.lit("?"), F.lit("")))
    return some(
        F.when(asks & (plain != ""), plain),
        F.when(contains_any(low, ["implement", "create", "build", "make"]) & ~low.startswith("how to"), F.concat(F.lit("how to "), text)),
        F.when(~low.startswith("what is") & ~asks, F.concat(F.lit("what is "), text)),
    )


def term_weights(text: Column) -> Column:
    """Map of term to weight: the query's words 1.0, synonyms 0.6, semantic terms 0.48; later ones count."""
    w, s, m = F.array_distinct(words(F.lower(text))), synonyms(text), semantic_terms(text)
    s = F.array_except(s, m)
    w = F.array_except(F.array_except(w, s), m)
    of = lambda a, x: F.transform(a, lambda t: F.struct(t.alias("key"), F.lit(x).alias("value")))
    return F.map_from_entries(F.concat(of(w, 1.0), of(s, 0.6), of(m, 0.48)))


def expansion_confidence(text: Column, most: int = 10) -> Column:
    n = F.size(synonyms(text)) + F.size(semantic_terms(text))
    return F.least(F.lit(1.0), 0.5 + 0.2 * n / most + F.when(F.size(negations(text)) > 0, 0.1).otherwise(0.0) + F.when(F.size(alternatives(text)) > 0, 0.1).otherwise(0.0))


def complexity_score(text: Column) -> Column:
    kind = classify(text)
    return F.least(F.lit(1.0), 0.1 * F.size(tokens(text)) + F.when(kind == "Technical", 0.3).otherwise(0.0) + 0.2 * F.size(negations(text)) + 0.1 * F.size(alternatives(text)))


def enhanced(text: Column, kind: Column) -> Column:
    """Fixed words for technical queries about functions and errors and for how-to questions."""
    low = F.lower(text)
    return (
        F.when((kind == "Technical") & low.contains("function"), F.concat(text, F.lit(" method procedure routine")))
        .when((kind == "Technical") & low.contains("error"), F.concat(text, F.lit(" exception bug issue problem")))
        .when((kind == "Question") & low.contains("how to"), F.concat(text, F.lit(" tutorial guide instructions steps")))
        .otherwise(text)
    )


def once(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def processing_stats(text: Column) -> Column:
    """Struct of how many words a query has, how many are left as terms, and how many distinct ones."""
    t = tokens(text)
    return F.struct(F.size(words(text)).alias("original_terms"), F.size(t).alias("processed_terms"), F.size(F.array_distinct(t)).alias("distinct_terms"))


def add_terms(text: Column, terms: Column) -> Column:
    """The query with further terms after it."""
    return F.trim(F.concat_ws(" ", text, F.array_join(terms, " ")))


#: What a request may set for its own expansion; null or absent is the default.
EXPANSION = {"synonyms": True, "semantic": True, "domain": True, "negation": True, "refinement": True, "most": 10}


def expanded(text: Column, **overrides: Column) -> Column:
    """Struct of ``refined``, ``synonyms``, ``semantic``, ``domain`` and ``query`` (the words asked and all that was found), as a request's own options say.

    Options are columns (``EXPANSION`` names them and their defaults), so each row has its own.
    ``refinement`` puts spelling and acronyms right; words are looked up in the refined text.
    """
    unknown = set(overrides) - set(EXPANSION)
    if unknown:
        raise ValueError(f"no options {sorted(unknown)}")
    o = {k: F.coalesce(overrides.get(k, F.lit(None)), F.lit(v)) for k, v in EXPANSION.items()}
    none = F.array().cast("array<string>")

    def found(better: Column) -> Column:
        w = words(F.lower(better))
        parts = {
            "synonyms": lookup(w, lexicon.GENERAL_SYNONYMS, lexicon.TECHNICAL_SYNONYMS, most=o["most"]),
            "semantic": lookup(w, lexicon.HYPERNYMS, lexicon.RELATED, most=o["most"]),
            "domain": lookup(w, lexicon.DOMAIN, lexicon.HIERARCHIES, most=o["most"]),
        }
        parts = {k: F.when(o[k], v).otherwise(none) for k, v in parts.items()}
        return F.struct(better.alias("refined"), *[v.alias(k) for k, v in parts.items()], add_terms(text, F.concat(*parts.values())).alias("query"))

    positive = F.when(o["negation"], without_negations(text)).otherwise(text)
    return once(F.when(o["refinement"], acronyms(spelled(positive))).otherwise(positive), found)


def sanitised(text: Column) -> Column:
    """Without control characters but white space, which becomes single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]", ""), r"\s+", " "))


def refined(text: Column) -> Column:
    """Spelling, acronyms and negations put right."""
    return once(acronyms(spelled(text)), without_negations)


def facts(text: Column) -> Column:
    """What the functions below need of a query, as a struct to compute once (as a column of its own)."""
    return F.struct(
        text.alias("text"),
        classify(text).alias("kind"),
        F.size(tokens(text)).alias("tokens"),
        synonyms(text).alias("synonyms"),
        semantic_terms(text).alias("semantic"),
        F.size(negations(text)).alias("negations"),
        F.size(alternatives(text)).alias("alternatives"),
        refined(text).alias("refined"),
    )


def confidences(f: Column, most: int = 10) -> Column:
    """Struct of the expansion's confidence and of the whole's, for ``facts``."""
    n = F.size(f["synonyms"]) + F.size(f["semantic"])
    e = F.least(F.lit(1.0), 0.5 + 0.2 * n / most + F.when(f["negations"] > 0, 0.1).otherwise(0.0) + F.when(f["alternatives"] > 0, 0.1).otherwise(0.0))
    return F.struct(e.alias("expansion"), (0.6 * class_confidence(f["text"], f["kind"]) + 0.4 * e).alias("overall"))


def final_query(f: Column, c: Column) -> Column:
    """The expanded query where expansion is sure, the refined one where it is half sure, else the enhanced one."""
    expanded = F.trim(F.concat_ws(" ", f["refined"], F.array_join(F.concat(f["synonyms"], f["semantic"]), " ")))
    return F.when(c["expansion"] > 0.6, expanded).when(c["expansion"] > 0.4, f["refined"]).otherwise(enhanced(f["text"], f["kind"]))


def tuned_options(f: Column, c: Column) -> Column:
    """Threshold, chunks and citations for a query: by its type, then its expansion, then the confidence in it."""
    technical, whole = f["kind"] == "Technical", c["overall"]
    threshold, chunks = F.when(technical, 0.8).otherwise(0.7), F.when(technical, 5).otherwise(10)
    grow = F.least(F.lit(0.3), 0.1 * F.size(f["synonyms"])) + F.least(F.lit(0.2), 0.05 * F.size(f["semantic"]))
    chunks = F.when(grow > 0, F.least(F.lit(20), F.floor(chunks * (1 + grow)).cast("int"))).otherwise(chunks)
    threshold = F.when(f["negations"] > 0, F.least(F.lit(0.9), threshold + 0.1)).otherwise(threshold)
    threshold = F.when(c["expansion"] < 0.5, F.least(F.lit(0.85), threshold + 0.05)).otherwise(threshold)
    threshold = F.when(whole < 0.5, F.greatest(F.lit(0.5), threshold - 0.1)).when(whole > 0.8, F.least(F.lit(0.9), threshold + 0.05)).otherwise(threshold)
    chunks = F.when(whole < 0.5, F.least(F.lit(20), chunks + 3)).otherwise(chunks)
    return F.struct(F.round(threshold, 6).alias("threshold"), chunks.alias("chunks"), (f["kind"] == "Question").alias("citations"))


def recommendations(f: Column, c: Column) -> Column:
    """What would make a query better; never empty."""
    found = some(
        F.when(c["overall"] < 0.5, "rephrase"),
        F.when(f["tokens"] < 3, "add terms"),
        F.when(F.size(f["synonyms"]) + F.size(f["semantic"]) == 0, "expand with synonyms"),
        F.when(f["negations"] > 0, "check negations"),
        F.when(f["kind"] == "Unknown", "state the intent"),
    )
    return F.when(F.size(found) == 0, F.array(F.lit("good"))).otherwise(found)
