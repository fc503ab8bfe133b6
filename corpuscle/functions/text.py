"""Query terms, filters and text shaping: on the driver for a query, as columns for rows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import fixed

#: Identifiers with ASCII boundaries; Java's \b would count letters beyond ASCII as words.
IDENTIFIER = r"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]*(?![A-Za-z0-9_])"


def search_terms(query: str) -> list[str]:
    """Lower-case words of three letters or more that aren't stop words."""
    words = (w.lower() for w in re.findall(r"[A-Za-z0-9_$]+", query))
    return [w for w in words if len(w) >= 3 and w not in fixed.SEARCH_STOP_WORDS]


#: Endings of plurals: what a longer word ends in, what it must not end in, letters to drop, letters to add.
_PLURALS = (
    (re.compile(r"ies$"), 3, "y"),
    (re.compile(r"(?:ch|sh|x|z|s)es$"), 2, ""),
    (re.compile(r"(?<![siu])s$"), 1, ""),
)


def term_variants(term: str) -> list[str]:
    """A term's label (its singular) and, where they differ, the term itself; words of four letters stay."""
    rule = next((r for r in _PLURALS if len(term) >= 5 and r[0].search(term)), None)
    return [term] if rule is None else [term[: -rule[1]] + rule[2], term]


def query_terms(query: str) -> dict[str, list[str]]:
    """Variants by label, in order; a label counts once."""
    out: dict[str, list[str]] = {}
    for term in search_terms(query):
        out.setdefault(term_variants(term)[0], term_variants(term))
    return out


def definition_symbols(query: str) -> list[str]:
    """What a query may be declared as: an identifier as it is, up to six terms of a phrase in camel, Pascal and snake case."""
    if re.fullmatch(r"[A-Za-z_$][\w$]*", query, re.ASCII):
        return [query]
    snake = "_".join(search_terms(query)[:6])
    pascal = re.sub(r"(?:^|_)(.)", lambda m: m[1].upper(), snake)
    return [snake[0] + pascal[1:], pascal, snake] if "_" in snake else []


def compact(text: Column, most: int = 240) -> Column:
    """White space as single spaces; longer texts end in three dots."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(one) > most, F.concat(F.rtrim(F.substring(one, 1, most - 3)), F.lit("..."))).otherwise(one)


def contains_any(text: Column, variants: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(v)) for v in variants])


def _compiles(pattern: str) -> bool:
    """Whether the engine that runs patterns takes this one: Java's, where a session is there to ask."""
    session = SparkSession.getActiveSession()
    try:
        if session is None or not hasattr(session, "_jvm"):
            re.compile(pattern)
        else:
            session._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # re.error, or the JVM's of the same kind
        return False
    return True


def text_filter(value: Column, pattern: str | None) -> Column:
    """No pattern takes all; null never matches; a broken pattern is searched as plain text."""
    if pattern is None:
        return F.lit(True)
    return F.coalesce(value.rlike(pattern) if _compiles(pattern) else F.contains(value, F.lit(pattern)), F.lit(False))


def glob_filter(value: Column, pattern: str | None) -> Column:
    """The whole value matches; only * is special, and it crosses slashes."""
    if pattern is None:
        return F.lit(True)
    return F.coalesce(value.rlike("^(?s:" + ".*".join(re.escape(p) for p in pattern.split("*")) + ")$"), F.lit(False))


def identifier_tokens(value: Column) -> Column:
    """Lower-case parts of a name, split at case changes and signs."""
    return F.filter(F.split(F.lower(F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+"), lambda t: t != "")


def symbol_name(qualified: Column) -> Column:
    return F.substring_index(qualified, ".", -1)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common beginning, in one pass over both."""
    letters = lambda x: F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))
    same = F.zip_with(letters(a), letters(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def line_span(value: Column) -> Column:
    """(start, end) of "212-219"; nulls of anything else."""
    return F.struct(F.try_to_number(F.nullif(F.regexp_extract(value, r"^(\d+)-(\d+)$", 1), F.lit("")), F.lit("9999999999")).cast("long").alias("start"), F.try_to_number(F.nullif(F.regexp_extract(value, r"^(\d+)-(\d+)$", 2), F.lit("")), F.lit("9999999999")).cast("long").alias("end"))


def extent_sample(values: Column) -> Column:
    """First, middle and last of a sorted list; up to three pass."""
    n = F.size(values)
    return F.when(n <= 3, values).otherwise(F.array_distinct(F.array(F.get(values, F.lit(0)), F.get(values, F.floor((n - 1) / 2).cast("int")), F.get(values, n - 1))))


def preview(doc: Column, most: int = 1000) -> Column:
    """The first line that isn't blank, cut at a word."""
    first = F.get(F.filter(F.transform(F.split(doc, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    cut = F.regexp_replace(F.substring(first, 1, most - 3), r"\s+\S*$", "")
    return F.coalesce(F.when(F.length(first) > most, F.concat(F.rtrim(cut), F.lit("..."))).otherwise(first), F.lit("none"))


def first_sentence(doc: Column) -> Column:
    """The first sentence of the first paragraph."""
    paragraph = F.trim(F.regexp_replace(F.get(F.split(F.trim(doc), r"\n\s*\n"), F.lit(0)), r"\s+", " "))
    return F.nullif(F.coalesce(F.nullif(F.regexp_extract(paragraph, r"^(.*?[.!?])(\s|$)", 1), F.lit("")), paragraph), F.lit(""))


def read_only(query: str) -> bool:
    """Whether a query text names no statement that changes data."""
    return not re.search(r"\b(create|merge|set|delete|detach|remove|drop|insert|update|alter|truncate|load|copy|replace|grant|revoke|call)\b", query, re.IGNORECASE)
