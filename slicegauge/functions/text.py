"""Regular expressions over text columns, all evaluated JVM-side with `rlike`."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# The patterns below decide which texts count as hits, so they
# are part of the result contract.
TOXIC_TERMS = r"\b(hate|kill|stupid|idiot|slur1|slur2)\b"

PII_PATTERNS = {
    "email": r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    "ssn_like": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone_like": r"\b\+?\d{1,3}?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
}

DUAL_USE_PATTERNS = {
    "explosives_synthesis": [
        r"\bdetonator\b", r"\bblast(ing)? cap\b", r"\bammonium nitrate.*fuel oil\b",
    ],
    "cbrn_agents": [
        r"\bweaponiz(?:e|ed|ing)\b", r"\baerosolized.*pathogen\b",
        r"\bnerve agent\b", r"\bbinary chemical weapon\b",
    ],
    "attack_planning": [
        r"\bmass casualt(?:y|ies)\b", r"\bsoft target\b", r"\bingress/egress.*facility\b",
    ],
}

# A character that every match of a costly pattern contains.
NEEDED = {PII_PATTERNS["email"]: "@"}

# Categories of a toxicity classifier whose maximum is compared to the threshold.
TOXICITY_CATEGORIES = ("toxicity", "severe_toxicity", "obscene", "threat", "insult", "identity_attack")

# What a url of each kind contains.
URL_CATEGORIES = {
    "news": [r"\bnews\b", r"\.com/news/", r"reuters", r"bbc", r"nytimes",
             r"washingtonpost", r"theguardian", r"foxnews"],
    "blog": [r"blogspot\.com", r"medium\.com", r"wordpress\.com", r"substack\.com", r"\bblog\b"],
    "forum": [r"reddit\.com", r"stackexchange", r"stackoverflow", r"\bforum\b",
              r"discuss\.", r"news\.ycombinator"],
    "ecommerce": [r"amazon\.com/dp", r"ebay", r"shopify", r"\bproduct\b/", r"\bshop\b", r"alibaba"],
    "academic": [r"arxiv\.org", r"\.edu/", r"semanticscholar", r"researchgate", r"sciencedirect"],
    "gov": [r"\.gov/", r"\.gov$", r"whitehouse", r"congress\.gov"],
    "wiki": [r"wikipedia\.org", r"wikia\.com", r"fandom\.com"],
}


# A plain word, or a group of plain words, right after a leading word boundary.
_WORD = re.compile(r"\\b([A-Za-z])(?![?*{|])")
_WORDS = re.compile(r"\\b\((?:\?:)?((?:[A-Za-z][A-Za-z0-9]*\|)*[A-Za-z][A-Za-z0-9]*)\)(?![?*{|])")


def _top_level_choice(pattern: str) -> bool:
    """Whether a `|` stands outside every group (or the nesting is unclear)."""
    if "[" in pattern or "\\(" in pattern or "\\)" in pattern:
        return "|" in pattern
    depth = 0
    for ch in pattern:
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and depth == 0:
            return True
    return False


def _first_letters(pattern: str) -> str | None:
    """Letters a match must start with, if the pattern opens with `\\b` and plain words."""
    if _top_level_choice(pattern):
        return None
    one, many = _WORD.match(pattern), _WORDS.match(pattern)
    if one:
        return one.group(1)
    return "".join(w[0] for w in many.group(1).split("|")) if many else None


def _any_of(patterns: str | Sequence[str], ignore_case: bool) -> str:
    """One pattern for several.

    Word boundaries are costly to test at every position of a long text, so
    where all patterns open with one and a plain letter, the letter is tested
    first and the boundary once. The matches are the same.
    """
    parts = [patterns] if isinstance(patterns, str) else list(patterns)
    # U: word classes and boundaries are Unicode-aware
    flags = "(?iU)" if ignore_case else "(?U)"
    heads = [_first_letters(p) for p in parts]
    if all(heads):
        letters = "".join(sorted(set("".join(heads))))
        return f"{flags}(?=[{letters}])\\b(?:" + "|".join(p[2:] for p in parts) + ")"
    return flags + "|".join(f"(?:{p})" for p in parts)


def matches(c: Column, patterns: str | Sequence[str], ignore_case: bool = False) -> Column:
    """True when the text contains a hit for any of the patterns."""
    hit = c.rlike(_any_of(patterns, ignore_case))
    needed = NEEDED.get(patterns) if isinstance(patterns, str) else None
    # a plain search for a character every match contains spares most texts the pattern
    return F.contains(c, F.lit(needed)) & hit if needed else hit


def is_text(c: Column) -> Column:
    """A non-missing text with at least one non-space character."""
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def any_hit(c: Column, patterns: Mapping[str, str | Sequence[str]], ignore_case: bool = False) -> Column:
    hit = F.lit(False)
    for p in patterns.values():
        hit = hit | matches(c, p, ignore_case)
    return hit


def first_category(c: Column, categories: Mapping[str, Sequence[str]], default: str = "other") -> Column:
    """Label of the first category, in order, with a hit; lower-cased input."""
    low, out = F.lower(c), None
    for label, pats in categories.items():
        cond = matches(low, pats)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def url_category(c: Column, categories: Mapping[str, Sequence[str]] | None = None) -> Column:
    return first_category(c, URL_CATEGORIES if categories is None else categories)


def keyword_category(c: Column, keywords: Mapping[str, Sequence[str]],
                     default: str = "OTHER", missing: str = "UNKNOWN") -> Column:
    """Label of the first entry with a keyword inside the upper-cased text."""
    up = F.upper(c)
    out = F.when(c.isNull(), F.lit(missing))
    for label, words in keywords.items():
        cond = F.lit(False)
        for w in words:
            cond = cond | F.contains(up, F.lit(w))
        out = out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))
