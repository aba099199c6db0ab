"""Analyzers as column expressions: English words with positions, codes with their parts, folded keywords.

Each has a twin for DuckDB (``*_sql``) in the same module, since both must cut texts in the same way.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic marks and what they are read as, letters that fold to two, stop words, and words that end
# like plurals without being any.
SMART, PLAIN = "’‘“”–— ", "''\"\"-- "
DOUBLE = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}
SINGLE = {"ø": "o", "đ": "d", "ł": "l", "ð": "d", "ı": "i"}
STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
KEEP = "premises series species news always perhaps whereas besides".split()
#: A run of letters, digits and underscores; an apostrophe or a full stop between two runs joins them.
WORD = r"[\p{L}\p{N}_]+(?:['.][\p{L}\p{N}_]+)*"


def _letters() -> dict[str, str]:
    """Lower-case letters with marks and the plain letters under them."""
    plain = {}
    for c in map(chr, range(0xDF, 0x250)):
        base, *marks = unicodedata.normalize("NFKD", c)
        if c.islower() and base.isascii() and base.isalpha() and marks and all(map(unicodedata.combining, marks)):
            plain[c] = base
    return plain | SINGLE


MARKED = _letters()
FROM, TO = "".join(MARKED), "".join(MARKED.values())


def fold(text: Column) -> Column:
    """Typographic marks as typed, lower case, letters without marks."""
    low = F.lower(F.translate(text, SMART, PLAIN))
    plain = F.translate(low, FROM, TO)
    for a, b in DOUBLE.items():
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return F.when(low.rlike(r"[^\x00-\x7F]"), plain).otherwise(low)


def stem(word: Column) -> Column:
    """A plural without its ending; other words stay as they are."""
    n, cut = F.length(word), lambda k: F.substring(word, F.lit(1), F.length(word) - k)
    ends = lambda *these: word.rlike(f"(?:{'|'.join(these)})$")
    whole = (n < 4) | ~F.endswith(word, F.lit("s")) | ends("ss", "us", "is") | word.isin(KEEP)
    return (
        F.when(whole, word).when(ends("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(ends("sses", "shes", "ches", "xes") | (ends("[tnrp]uses") & (n > 6)) | (ends("oes") & (n > 5)), cut(2)).otherwise(cut(1))
    )


def english_words(text: Column) -> Column:
    """The words of a text in order, folded."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def english_stem(word: str) -> str:
    """What ``english_positions`` makes of a folded word, for code that runs inside a task anyway."""
    word = word.removesuffix("'s")
    if word in STOP:
        return ""
    if len(word) < 4 or not word.endswith("s") or word.endswith(("ss", "us", "is")) or word in KEEP:
        return word
    if word.endswith("ies") and len(word) > 4:
        return word[:-3] + "y"
    n = len(word)
    two = word.endswith(("sses", "shes", "ches", "xes")) or (word.endswith(("tuses", "nuses", "ruses", "puses")) and n > 6) or (word.endswith("oes") and n > 5)
    return word[: -2 if two else -1]


def english_positions(text: Column) -> Column:
    """Stems of a text's words in order, an empty one where a stop word stands."""
    words = english_words(text)
    plain = F.transform(words, lambda w: F.when(F.endswith(w, F.lit("'s")), F.substring(w, F.lit(1), F.length(w) - 2)).otherwise(w))
    return F.transform(plain, lambda w: F.when(w.isin(STOP), F.lit("")).otherwise(stem(w)))


def english_terms(text: Column) -> Column:
    return F.filter(english_positions(text), lambda t: t != "")


def code_parts(token: Column) -> Column:
    """A code as it is, its runs of letters and of digits, those runs across its marks, and all of it in one, each once."""
    runs = lambda t: F.regexp_extract_all(t, F.lit(r"(\p{L}+|\p{N}+)"), F.lit(1))
    bare = F.regexp_replace(token, r"[^\p{L}\p{N}]+", "")
    return F.filter(F.array_distinct(F.concat(F.array(token), runs(token), runs(bare), F.array(bare))), lambda t: t != "")


def code_runs(text: Column) -> Column:
    """All runs of letters and of digits of a text, in order."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"(\p{L}+|\p{N}+)"), F.lit(1))


def exact_tokens(text: Column) -> Column:
    """The tokens of a text between blanks, in order."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"(\S+)"), F.lit(1))


def exact_positions(text: Column) -> Column:
    """``position, term`` of a whole text: its tokens between blanks, each with all parts at its position."""
    return F.flatten(F.transform(exact_tokens(text), lambda t, i: F.transform(code_parts(t), lambda p: F.struct(i.alias("position"), p.alias("term")))))


def keyword(text: Column) -> Column:
    """One value to compare as a whole."""
    return fold(text)


def _words(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def fold_sql(text: str) -> str:
    smart, plain = (x.replace("'", "''") for x in (SMART, PLAIN))
    out = f"translate(lower(translate({text}, '{smart}', '{plain}')), '{FROM}', '{TO}')"
    for a, b in DOUBLE.items():
        out = f"replace({out}, '{a}', '{b}')"
    return out


def english_sql(text: str) -> str:
    """The list of ``english_positions`` in DuckDB."""
    words = f"regexp_extract_all({fold_sql(f'coalesce({text}, {chr(39) * 2})')}, '{WORD.replace(chr(39), chr(39) * 2)}')"
    plain = f"list_transform({words}, lambda w: CASE WHEN w LIKE '%''s' THEN w[:-3] ELSE w END)"
    return f"""list_transform({plain}, lambda w: CASE WHEN list_contains({_words(STOP)}, w) THEN ''
 WHEN length(w) < 4 OR w NOT LIKE '%s' OR regexp_matches(w, '(ss|us|is)$') OR list_contains({_words(KEEP)}, w) THEN w
 WHEN w LIKE '%ies' AND length(w) > 4 THEN w[:-4] || 'y'
 WHEN regexp_matches(w, '(sses|shes|ches|xes)$') OR (regexp_matches(w, '[tnrp]uses$') AND length(w) > 6) OR (w LIKE '%oes' AND length(w) > 5) THEN w[:-3]
 ELSE w[:-2] END)"""
