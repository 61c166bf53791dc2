"""Words, cleaning and metadata of texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpusql.functions import lexicon

#: What is neither of a term nor white space; the Unicode form keeps letters and digits of all scripts.
#: The ASCII form, all but ``a-z 0-9 _ -`` and white space, is written as ranges: Java takes a quarter of the time for them.
ASCII_TERM, UNICODE_TERM = r"[\x00-\x08\x0e-\x1f!-,./:-^`{-\x{10ffff}]+", r"[^\p{L}\p{N}_\s-]+"


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def terms(text: Column, stop_words: list[str] | None = None, unicode: bool = False) -> Column:
    """Lower-case terms; with ``stop_words`` as a query is read, without as a chunk is."""
    # Cleaned as a whole, then split: one pass over the text and none over each word.
    kept = F.filter(F.split(F.regexp_replace(F.lower(text), UNICODE_TERM if unicode else ASCII_TERM, ""), r"\s+"), lambda w: w != "")
    return F.filter(kept, lambda w: ~w.isin(stop_words)) if stop_words else kept


def contains_any(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def preprocess(text: Column) -> Column:
    """Trimmed, lower-case, letters, digits, white space and ``.,!?-`` only, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9\s.,!?-]", ""), r"\s+", " "))


def clean(text: Column) -> Column:
    """White space to single spaces, control characters dropped, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"[\x00-\x1f\x7f]", ""))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def language_sample(text: Column, sample: int = 1000) -> Column:
    return F.lower(F.substring(text, 1, sample))


def counts_by_language(s: Column) -> dict[str, Column]:
    """How often the words of each language occur as substrings of ``language_sample``."""
    return {k: sum((occurrences(s, w) for w in v), F.lit(0)) for k, v in lexicon.LANGUAGES.items()}


def language_counts(text: Column, sample: int = 1000) -> Column:
    """How often the words of each language occur as substrings of the first ``sample`` characters: a struct by language."""
    return F.struct(*[n.alias(k) for k, n in counts_by_language(language_sample(text, sample)).items()])


def language_of(n: Column | dict[str, Column]) -> Column:
    """The language by ``language_counts``; where those are a column of their own, each is made once."""
    return F.when((n["en"] > n["es"]) & (n["en"] > n["fr"]), "en").when(n["es"] > n["fr"], "es").when(n["fr"] > 0, "fr").otherwise("unknown")


def language(text: Column, sample: int = 1000) -> Column:
    """By substrings of the first ``sample`` characters: en, es, fr or unknown."""
    return language_of(language_counts(text, sample))


def _quoted(x: Column) -> Column:
    """Without spaces and then quotation marks at the ends."""
    return F.regexp_replace(F.regexp_replace(F.trim(x), r'^"+|"+$', ""), r"^'+|'+$", "")


def last_wins(entries: Column) -> Column:
    """A map from an array of (key, value): of several entries with one key the last counts."""
    keys = F.transform(entries, lambda e: e["key"])
    kept = F.filter(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), (F.array_position(F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), e["key"]) == 0).alias("last"))), lambda e: e["last"])
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], e["value"])))


def front_matter(text: Column) -> Column:
    """Map of the ``key: value`` lines between leading ``---`` lines, the last line of a key counting; null without them."""
    block = F.regexp_extract(text, r"^---\n(?s:(.*?))\n---\n", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.contains(":"))
    entry = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), _quoted(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("value"))
    return F.when(block != "", last_wins(F.transform(pairs, entry)))


def _tags(values: Column) -> Column:
    return F.when(values.isNotNull(), F.transform(F.split(values, ","), lambda x: F.trim(x))).otherwise(F.array().cast("array<string>"))


def record(title: Column | None = None, author: Column | None = None, created: Column | None = None, tags: Column | None = None, category: Column | None = None, n_words: Column | None = None, fields: Column | None = None) -> Column:
    """The metadata of a document, whatever its format."""
    null = F.lit(None).cast("string")
    return F.struct(
        F.coalesce(title, null).alias("title") if title is not None else null.alias("title"),
        (author if author is not None else null).alias("author"),
        (created if created is not None else F.lit(None).cast("timestamp")).alias("created_date"),
        (tags if tags is not None else F.array().cast("array<string>")).alias("tags"),
        (category if category is not None else null).alias("category"),
        (n_words if n_words is not None else F.lit(None).cast("long")).alias("word_count"),
        (fields if fields is not None else F.create_map().cast("map<string,string>")).alias("custom_fields"),
    )


_KNOWN = ("title", "author", "date", "tags", "category")


def markdown_record(text: Column) -> Column:
    """From front matter: title, author, date (RFC 3339), tags and category by name, all others as custom fields."""
    m = F.coalesce(front_matter(text), F.create_map().cast("map<string,string>"))
    low = F.transform_keys(F.map_filter(m, lambda k, v: F.lower(k).isin(list(_KNOWN))), lambda k, v: F.lower(k))
    get = lambda k: F.try_element_at(low, F.lit(k))
    title = F.coalesce(get("title"), markdown_title(text))
    return record(title, get("author"), F.try_to_timestamp(get("date")), _tags(get("tags")), get("category"), word_count(text), F.map_filter(m, lambda k, v: ~F.lower(k).isin(list(_KNOWN))))


_META = r"""(?is)<meta\b((?:[^>"']|"[^"]*"|'[^']*')*)>"""


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in whatever order and quotes; null if it isn't there."""
    pattern = rf"""(?is)(?:^|[\s"']){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    parts = [F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)]
    return F.when(tag.rlike(pattern), F.concat(*parts))


def html_metas(html: Column) -> Column:
    """Map of all ``meta`` elements with name and content, names in lower case, the last of a name counting."""
    tags = F.regexp_extract_all(html, F.lit(_META), F.lit(1))
    entries = F.transform(tags, lambda t: F.struct(F.lower(_attribute(t, "name")).alias("key"), _attribute(t, "content").alias("value")))
    return last_wins(F.filter(entries, lambda e: e["key"].isNotNull() & e["value"].isNotNull()))


def html_record(html: Column) -> Column:
    """From the title and the meta elements: author, keywords as tags, the others as custom fields; words of the text."""
    m = html_metas(html)
    get = lambda k: F.try_element_at(m, F.lit(k))
    return record(F.nullif(html_title(html), F.lit("")), get("author"), None, _tags(get("keywords")), None, word_count(html_text(html)), F.map_filter(m, lambda k, v: ~k.isin("author", "keywords")))


def plain_record(text: Column) -> Column:
    return record(inferred_title(text), n_words=word_count(text))


def metadata_record(text: Column, file_type: Column) -> Column:
    """One record for every format, from the format's own places."""
    kind = F.lower(file_type)
    return F.when(kind.isin("md", "markdown"), markdown_record(text)).when(kind.isin("html", "htm"), html_record(text)).otherwise(plain_record(text))


def merged_record(a: Column, b: Column) -> Column:
    """The first's values, where it has none the second's; tags if it has none; custom fields of both, the first's before."""
    pick = lambda c: F.coalesce(a[c], b[c]).alias(c)
    fields = F.map_concat(a["custom_fields"], F.map_filter(b["custom_fields"], lambda k, v: ~F.map_contains_key(a["custom_fields"], k)))
    return F.struct(pick("title"), pick("author"), pick("created_date"), F.when(F.size(a["tags"]) > 0, a["tags"]).otherwise(b["tags"]).alias("tags"), pick("category"), pick("word_count"), fields.alias("custom_fields"))


def basic_record(text: Column) -> Column:
    """Words, and English as the language, for extractors that know no more."""
    return F.struct(word_count(text).alias("word_count"), F.lit("en").alias("language"))


def word_pairs(text: Column) -> Column:
    """Neighbouring words."""
    w = words(text)
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def named_entities(text: Column) -> Column:
    """Neighbouring words that both begin with a capital letter, as (text, type, confidence)."""
    pairs = F.filter(word_pairs(text), lambda p: p["a"].rlike(r"^\p{Lu}") & p["b"].rlike(r"^\p{Lu}"))
    return F.transform(pairs, lambda p: F.struct(F.concat_ws(" ", p["a"], p["b"]).alias("text"), F.lit("Organization").alias("type"), F.lit(0.7).alias("confidence")))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_text(html: Column) -> Column:
    """All text without scripts, styles and mark-up, in single spaces."""
    no_code = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(no_code, r"(?s)<[^>]*>", " "), r"\s+", " "))


def markdown_title(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?m)^# (.*)$", 1), F.lit(""))


def markdown_text(text: Column) -> Column:
    for pattern, to in ((r"(?m)^#{1,6}\s+", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"[*_`]{1,3}([^*_`]+)[*_`]{1,3}", "$1")):
        text = F.regexp_replace(text, pattern, to)
    return text


def rtf_text(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\[^\s]*", ""), r"[{}]", "")


def inferred_title(text: Column) -> Column:
    """The first line, if it has more than 3 and fewer than 100 bytes."""
    line = F.trim(F.substring_index(text, "\n", 1))
    return F.when((F.octet_length(line) > 3) & (F.octet_length(line) < 100), line)


def pdf_date(text: Column) -> Column:
    return F.try_to_timestamp(F.substring(text, 3, 14), F.lit("yyyyMMddHHmmss"))


def pages_estimate(n_words: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n_words / 275)).cast("long")


def truncate(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut at the last space."""
    head = F.substring(text, 1, most)
    cut = F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)
    return F.when(F.length(text) <= most, text).otherwise(F.when(cut == "", head).otherwise(cut))


def excerpt(text: Column, most: int = 200) -> Column:
    return F.concat(F.trim(F.substring(text, 1, most)), F.when(F.octet_length(text) > most, "...").otherwise(""))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def mime(path: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in lexicon.MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(kinds, extension(path)), F.lit("application/octet-stream"))


def safe_name(path: Column, document_id: Column) -> Column:
    ext = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    return F.concat(document_id, F.lit("."), F.when(ext == "", "bin").otherwise(ext))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of words; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


# What windows-1252 has where ISO 8859-1 has control characters.
_LATIN = [(bytes([b]).decode("latin-1"), bytes([b]).decode("cp1252", "replace")) for b in range(0x80, 0xA0)]


def decode(content: Column) -> Column:
    """Bytes as UTF-8 if they are, else as windows-1252."""
    latin = F.translate(F.decode(content, "ISO-8859-1"), "".join(a for a, _ in _LATIN), "".join(b for _, b in _LATIN))
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(latin)


def likely_text(text: Column) -> Column:
    """Fewer than 5 control characters in 100 bytes."""
    control = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x1f\x7f]", ""))
    return control / F.greatest(F.octet_length(text), F.lit(1)) < 0.05
