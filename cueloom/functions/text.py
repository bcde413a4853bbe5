"""Text predicates and clean-ups as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes.
CJK = "[㐀-䶿一-鿿⺀-⿟豈-﫿]"
HAN_BASIC = "[一-鿿]"
SENTENCE_ENDS_ZH = "。？！…"
# Abbreviations, without their last dot, that end no sentence, and fillers that do.
ABBREVIATIONS = "dr mr mrs ms prof st jr sr capt gen e.g i.e etc vs inc ltd dept est ph.d ll.b ll.m b.a b.s m.a m.s".split()
SPOKEN_FILLERS = "hmm um uh mm er ah oh".split()


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def cjk_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CJK))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def chars(text: Column) -> Column:
    """Characters other than line ends."""
    return F.length(F.regexp_replace(text, "\n", ""))


def last_line(text: Column) -> Column:
    return strip(F.element_at(lines(strip(text)), -1))


def ends_sentence(text: Column) -> Column:
    """Ends like a sentence in either script, and not in the dot of an abbreviation: of a listed one, of
    capitals with dots between ("U.S."), or of a short word with a capital ("Mr."). Nothing ends one."""
    bare = strip(text)
    word = F.regexp_extract(bare, r"(\p{L}+(?:\.\p{L}+)*)\.$", 1)
    letters = F.regexp_replace(word, r"\.", "")
    dotted = F.contains(word, F.lit(".")) & (letters == F.upper(letters)) & (letters != F.lower(letters))
    short = (F.length(word) <= 3) & word.rlike(r"^\p{Lu}")
    abbreviation = (word != "") & ~F.lower(word).isin(SPOKEN_FILLERS) & (F.lower(word).isin(ABBREVIATIONS) | dotted | short)
    return (bare == "") | (bare.rlike("[.!?。？！…]$") & ~abbreviation)


def unescape_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\\[Nn]", "\n")


def slugify(text: Column, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(strip(F.regexp_replace(text, r"(?U)[^\w\s]", "")), r"(?U)\s+", "_"), 1, most)


def strip_punctuation_zh(text: Column) -> Column:
    """The minimal-punctuation convention: clause marks become one space, full stops go."""
    spaced = F.regexp_replace(text, "[，；：]", " ")
    no_stop = F.regexp_replace(F.regexp_replace(spaced, "(?m)。+$", ""), "。", " ")
    return F.regexp_replace(F.regexp_replace(no_stop, " +", " "), "(?m)^ | $", "")


def normalise_token(word: Column) -> Column:
    """Lower case, without ASCII and curly punctuation at either end."""
    return F.regexp_replace(F.lower(word), r"^[\p{Punct}“”‘’]+|[\p{Punct}“”‘’]+$", "")


def annotation_term(text: Column) -> Column:
    """The term of an annotation: what stands before a colon, without its marker."""
    return strip(F.regexp_extract(F.regexp_replace(text, "^[※*\\s]+", ""), "^([^：:]*)", 1))


def smart_join(words: Column) -> Column:
    """Words joined without spaces where more than 30 % of the first ten words' characters are CJK."""
    sample = F.concat_ws("", F.slice(words, 1, 10))
    dense = cjk_count(sample) > 0.3 * F.length(sample)
    return F.when(dense, F.concat_ws("", words)).otherwise(F.concat_ws(" ", words))
