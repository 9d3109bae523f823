"""X11, X23-X26 and the count-vectoriser analyser, as native array expressions.

Segmentation is a regex alternation: lexicon words (longest first, so an
overlapping shorter entry never wins), then runs of ASCII letters/digits, then
any single character.  Text outside the lexicon is kept, one token per
character, as a dictionary segmenter does.  The vectoriser analyser lower-cases
and keeps runs of two or more letters/digits/underscores.

``location_terms`` is the chain and the analyser in one.  A single character of a text is never a term nor part of one, as
the chain sets spaces around it; so only lexicon words and runs are extracted.
"""

from __future__ import annotations

import re
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"


def _quote(word: str) -> str:
    return r"\Q" + word + r"\E"


def segment_pattern(lexicon: Iterable[str]) -> str:
    words = sorted(set(lexicon), key=lambda w: (-len(w), w))
    alternatives = [_quote(w) for w in words] + ["[A-Za-z0-9]+", "."]
    return "(?s)(" + "|".join(alternatives) + ")"


def replace_text(text: Column, old: str, new: str) -> Column:
    """X11: literal substring replacement."""
    return F.replace(text, F.lit(old), F.lit(new))


def segment(text: Column, lexicon: Iterable[str]) -> Column:
    """Text -> array of tokens."""
    return F.regexp_extract_all(text, F.lit(segment_pattern(lexicon)), 1)


def remove_stop_words(tokens: Column, stop_words: Iterable[str]) -> Column:
    """Drop stop words, keeping duplicates and order (unlike array_except)."""
    stop = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(tokens, lambda t: ~F.array_contains(stop, t))


def strip_tokens(tokens: Column, fragment: str) -> Column:
    """Remove a fragment inside every token (may leave empty tokens)."""
    return F.transform(tokens, lambda t: F.replace(t, F.lit(fragment), F.lit("")))


def join_tokens(tokens: Column) -> Column:
    """Tokens -> one space-separated document string."""
    return F.array_join(tokens, " ")


def analyse(document: Column) -> Column:
    """Vectoriser analyser: lower-case, words of two or more word characters."""
    return F.regexp_extract_all(F.lower(document), F.lit(WORD_PATTERN), 0)


def location_document(text: Column, dash: str, lexicon: Iterable[str], stop_words: Iterable[str],
                      fragment: str) -> Column:
    """X11 + X23-X26 chained: raw location text -> cleaned token document."""
    tokens = segment(replace_text(text, dash, " "), lexicon)
    return join_tokens(strip_tokens(remove_stop_words(tokens, stop_words), fragment))


def location_terms(text: Column, dash: str, lexicon: Iterable[str], stop_words: Iterable[str], fragment: str) -> Column:
    """``analyse(location_document(...))`` without a token for each other character."""
    words, stop = sorted(set(lexicon), key=lambda w: (-len(w), w)), list(stop_words)
    pattern = "(?s)(" + "|".join([_quote(w) for w in words] + ["[A-Za-z0-9]{2,}"]) + ")"
    tokens = F.regexp_extract_all(replace_text(text, dash, " "), F.lit(pattern), 1)
    if stop:
        tokens = F.filter(tokens, lambda t: ~t.isin(stop))
    if re.fullmatch("[A-Za-z0-9]+", fragment) or any(fragment in w for w in words):      # else no token holds it
        tokens = strip_tokens(tokens, fragment)
    return analyse(join_tokens(tokens))
