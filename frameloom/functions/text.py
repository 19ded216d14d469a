"""Column expressions over text: cleaning, tokens, query expansion, suffix stripping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: English stop words.
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have having he her here hers "
    "herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs "
    "them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves"
).split()


def clean_text(c: Column, stopwords: list[str] | tuple[str, ...] = tuple(STOPWORDS)) -> Column:
    """Lower case, ASCII punctuation deleted, then stop words dropped, joined by single blanks.

    Punctuation goes first, so ``don't`` becomes ``dont`` and stays. Null and blank give ''.
    """
    t = F.split(F.trim(F.translate(F.lower(F.coalesce(c, F.lit(""))), PUNCTUATION, "")), r"\s+")
    stop = F.array(*[F.lit(w) for w in stopwords]) if stopwords else F.array().cast("array<string>")
    return F.array_join(F.filter(t, lambda w: (w != "") & ~F.array_contains(stop, w)), " ")


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; null has none. The dotted capital I counts as an I."""
    return F.regexp_extract_all(F.lower(F.translate(F.coalesce(c, F.lit("")), "\u0130", "I")), F.lit("[a-z0-9]+"), 0)


def words(c: Column) -> Column:
    """Like tokens, with the letters, marks and digits of any script."""
    return F.regexp_extract_all(F.lower(F.translate(F.coalesce(c, F.lit("")), "\u0130", "I")), F.lit(r"[\p{L}\p{M}\p{N}]+"), 0)


def stemmed(c: Column) -> Column:
    """Like tokens, without English stop words and each reduced to its stem by Porter's rules (see stem.py)."""
    from .stem import stem_all

    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return stem_all(F.filter(tokens(c), lambda w: ~F.array_contains(stop, w)))


#: Ways of cutting a text into terms, by name; the plain one is the default.
TOKENIZERS = {"plain": tokens, "words": words, "stemmed": stemmed}


def word_count(c: Column) -> Column:
    """White-space separated words; null and blank have 0."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def expand_query(raw: Column, *extra: Column) -> Column:
    """Raw text and the extra terms as white-space tokens, the first of each spelling kept in its own case."""
    none = F.array().cast("array<string>")
    words = F.concat_ws(" ", F.coalesce(raw, F.lit("")), *[F.concat_ws(" ", F.coalesce(x, none)) for x in extra])
    t = F.filter(F.split(words, r"\s+"), lambda w: w != "")
    lower = F.transform(t, F.lower)
    return F.array_join(F.filter(t, lambda w, i: F.array_position(lower, F.lower(w)) == i + 1), " ")


def strip_suffix(text: Column, suffix: Column) -> Column:
    """Cut ``text`` at the last occurrence of ``suffix`` in any case, then trailing ``blank . , ; : - |``.

    An empty suffix, one that isn't found, or one that leaves nothing keeps the text. Null text stays null.
    """
    s = F.coalesce(suffix, F.lit(""))
    place = F.instr(F.reverse(F.lower(text)), F.reverse(F.lower(s)))
    at = F.length(text) - F.length(s) - place + 1
    cut = F.rtrim(F.substring(text, F.lit(1), at), F.lit(" .,;:-|"))
    return F.when((s == "") | (place == 0) | (cut == ""), text).otherwise(cut)


def contains_any(c: Column, words: list[str] | tuple[str, ...]) -> Column:
    """True if any of the words stands in the text, in any case; null text holds none."""
    low = F.lower(F.coalesce(c, F.lit("")))
    hit = F.lit(False)
    for w in words:
        hit = hit | low.contains(w.lower())
    return hit


def keyword_tier(c: Column, tiers: list[list[str]]) -> Column:
    """Number of the strongest tier with a keyword in the text: len(tiers) for the first, down to 1; 0 for none."""
    out = F.lit(0)
    for k, words in reversed(list(enumerate(tiers))):
        out = F.when(contains_any(c, words), len(tiers) - k).otherwise(out)
    return out
