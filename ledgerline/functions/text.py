"""Tokenisation and language hints for the text index."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token rule: maximal runs of ASCII letters and digits of the lower-cased text.
TOKEN_PATTERN = "[a-z0-9]+"


def tokens(text: Column) -> Column:
    """Array of tokens of a text column (JVM regex, whole text)."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)


def query_terms(query: str) -> list[str]:
    """Distinct tokens of a search string, in first-seen order (driver side;
    the query string is a request parameter, not data)."""
    seen: dict[str, None] = {}
    for t in re.findall(TOKEN_PATTERN, (query or "").lower()):
        seen.setdefault(t, None)
    return list(seen)


# Common function words per language, used to tag the language
# of a text (a text is tagged with the language whose words it uses most).
STOP_WORDS = {
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "den",
           "mit", "sich", "auf", "dem", "des", "von", "auch", "es"],
    "en": ["the", "and", "of", "to", "is", "in", "that", "it", "with", "for",
           "as", "was", "on", "this", "are", "by", "be", "at", "from"],
    "es": ["el", "los", "las", "y", "que", "del", "por", "con", "una", "para",
           "es", "se", "no", "un", "al", "como", "lo"],
    "fr": ["le", "les", "et", "des", "du", "un", "une", "est", "que", "qui",
           "dans", "pour", "pas", "sur", "au", "avec", "il", "elle"],
}
