"""Rule-based understanding of a column of questions: what is asked for, when, how, and along which route."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# These patterns and word lists decide results and must be as they are.
CODE = r"\b[A-Z]{2,6}[-_]\d+(?:[-_.]\d+)*\b"
SECTION = r"\b\d+\.\d+(?:\.\d+)*\b"
QUOTED = '["“]([^"”]{3,})["”]'
FIELD = r'\b(author|type|doc_type|source|system)\s*:\s*("[^"]+"|\S+)'
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
HISTORICAL = ["was", "were", "used", "previous", "previously", "historical", "historically", "former", "formerly", "old", "older", "prior", "before", "superseded", "withdrawn"]
OPENERS = ["what", "and", "but", "how", "why", "when", "where", "who", "ok", "okay", "also", "then"]
PRONOUNS = ["it", "its", "that", "this", "these", "those", "they", "them", "their", "he", "she", "him", "her"]
ASKING = ["what", "which", "who", "whom", "whose", "when", "where", "why", "how", "explain", "summarise", "summarize", "describe", "compare"]
INJECTION = {
    "instruction_override": r"\bignore\s+(?:all\s+|any\s+)?(?:previous|prior|above)\b",
    "role_override": r"\byou\s+are\s+now\b|\bact\s+as\s+(?:a|an)\b",
    "prompt_exfiltration": r"\b(?:system\s+prompt|your\s+instructions|initial\s+prompt)\b",
    "guardrail_bypass": r"\b(?:disregard|bypass|override)\s+(?:the\s+)?(?:rules|policy|guardrails|safety)\b",
    "data_exfiltration": r"\b(?:list|dump|show)\s+(?:all\s+)?(?:documents|tenants|users)\b",
}
MULTIPART = [r"\?\s*\S.*\?", r"\b(?:and|also)\s+(?:what|how|when|where|who|why|can|do|does|is|are)\b", r"\bcompare\b.*\b(?:and|with|to|versus|vs)\b", r"\bdifference between\b.*\band\b"]
TIME = ["recent", "recently", "latest", "current", "now", "today", "yesterday", "ago", "since", "until", "last", "next", "this year", "upcoming"]
FAST_WORDS, OPENER_WORDS, SHORT_WORDS = 6, 8, 4


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _any_word(words: Column, these: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in these]))


def letters(text: Column) -> Column:
    return _all(F.lower(text), "([a-z]+)")


def word_count(text: Column) -> Column:
    return F.size(_all(text, r"(\S+)"))


def identifiers(text: Column) -> Column:
    """Codes, section numbers outside of codes, and quoted phrases, each once, in that order."""
    sections = _all(F.regexp_replace(text, CODE, " "), f"({SECTION})")
    quoted = F.transform(_all(text, QUOTED), lambda q: F.trim(q))
    return F.array_distinct(F.concat(_all(text, f"({CODE})"), sections, quoted))


def field_values(text: Column, *names: str) -> Column:
    """Lower-cased values of the field operators with one of these names, each once."""
    pairs = F.arrays_zip(_all(text, "(?i)" + FIELD, 1).alias("k"), _all(text, "(?i)" + FIELD, 2).alias("v"))
    mine = F.filter(pairs, lambda p: F.lower(p["k"]).isin(*names))
    return F.array_distinct(F.transform(mine, lambda p: F.lower(F.regexp_replace(p["v"], '^"+|"+$', ""))))


@dataclass(frozen=True)
class Published:
    after: Column
    before: Column


def published(text: Column, today: Column) -> Published:
    """The days a question is about: an ISO day, a month, a quarter, the last quarter, or a year outside of any code."""
    part = lambda p, g: F.nullif(F.regexp_extract(text, p, g), F.lit(""))
    day = F.try_to_date(part(r"\b(\d{4}-\d{2}-\d{2})\b", 1), "yyyy-MM-dd")
    named = rf"(?i)\b({'|'.join(MONTHS)})\s+((?:19|20)\d{{2}})\b"
    month = F.make_date(part(named, 2).cast("int"), F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(part(named, 1))).cast("int"), F.lit(1))
    three = r"(?i)\bq([1-4])\s*((?:19|20)\d{2})\b"
    quarter = F.make_date(part(three, 2).cast("int"), part(three, 1).cast("int") * 3 - 2, F.lit(1))
    last = F.when(text.rlike(r"(?i)\blast quarter\b"), F.add_months(F.trunc(today, "quarter"), -3))
    found = part(r"\b((?:19|20)\d{2})\b", 1)
    year = F.when(~F.exists(identifiers(text), lambda i: F.contains(i, found)), F.make_date(found.cast("int"), F.lit(1), F.lit(1)))
    return Published(
        F.coalesce(day, month, quarter, last, year),
        F.coalesce(day, F.last_day(month), F.last_day(F.add_months(quarter, 2)), F.last_day(F.add_months(last, 2)), F.date_sub(F.add_months(year, 12), 1)),
    )


def is_historical(text: Column) -> Column:
    return _any_word(letters(text), HISTORICAL)


def flags(text: Column) -> Column:
    """Names of the suspicious wordings a question has."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(n)) for n, p in INJECTION.items()]))


def is_follow_up(text: Column, has_history: Column) -> Column:
    """With something said before: a short question with an opener, one with a pronoun, or a very short one."""
    words = _all(F.lower(text), "([a-z']+)")
    n = F.size(words)
    opened = F.get(words, F.lit(0)).isin(OPENERS) & (n <= OPENER_WORDS)
    return has_history & (n > 0) & (opened | _any_word(words, PRONOUNS) | (n <= SHORT_WORDS))


def is_multipart(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike("(?i)" + p) for p in MULTIPART])


def is_question(text: Column) -> Column:
    words = letters(text)
    return (F.size(words) > 0) & (F.get(words, F.lit(0)).isin(ASKING) | F.contains(text, F.lit("?")))


def route(text: Column, follow_up: Column) -> Column:
    fast = (F.size(identifiers(text)) > 0) & ~follow_up & (word_count(text) <= FAST_WORDS) & ~is_question(text)
    return F.when(fast, "fast_exact").when(is_multipart(text), "decomposed").otherwise("standard")


def legs(route_: Column) -> Column:
    return F.when(route_ == "fast_exact", F.array(F.lit("exact"))).otherwise(F.array(*[F.lit(x) for x in ("bm25", "dense", "exact", "parent")]))


def merge(own: Column, proposed: Column, most: int | None = None) -> Column:
    """What a model proposes is added to what the rules found, never the other way round; the first ``most`` count."""
    both = F.array_distinct(F.concat(own, F.coalesce(proposed, F.array().cast("array<string>"))))
    return both if most is None else F.slice(both, 1, most)


def asks_model(text: Column, route_: Column, follow_up: Column, dated: Column) -> Column:
    """Whether a model could add what the rules cannot: never on the fast path, always where a question leans on the one
    before or has several parts, else where it mentions a time that no rule could date."""
    timed = reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w)) for w in TIME])
    return (route_ != "fast_exact") & (follow_up | (route_ == "decomposed") | (~dated & timed))


def _named(values: Column) -> Column:
    """Trimmed, lower-cased, without blanks; null is none."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.lower(F.trim(v))), lambda v: v != "")


def merged(own: dict[str, Column], proposed: Column, most: int = 3) -> dict[str, Column]:
    """A plan with what a model proposes for it; a null proposal leaves it as it is.

    own: ``route, identifiers, historical, authors, doc_types, sources``; proposed: a struct ``exact_tokens, sub_queries,
    historical, authors, doc_types, sources``. Lists grow and historical intent can only be added. Two or more
    sub-queries make a question one of several parts; none turn such a question back into one.
    """
    asked = proposed.isNotNull()
    parts = F.slice(_named(proposed["sub_queries"]), 1, most)
    tokens_ = F.filter(F.coalesce(proposed["exact_tokens"], F.array().cast("array<string>")), lambda v: F.trim(v) != "")
    route_ = F.when(asked & (F.size(parts) > 1), "decomposed").when(asked & (F.size(parts) == 0) & (own["route"] == "decomposed"), "standard").otherwise(own["route"])
    out = {"route": route_, "identifiers": merge(own["identifiers"], tokens_), "historical": own["historical"] | F.coalesce(proposed["historical"], F.lit(False)), "sub_queries": parts}
    return out | {n: merge(own[n], _named(proposed[n])) for n in ("authors", "doc_types", "sources")}
