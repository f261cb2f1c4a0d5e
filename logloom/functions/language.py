"""Sentences, plain text and readability as columns: regular expressions that go through a text once, so time grows with its length."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.expr import strip

#: Abbreviations whose full stop ends no sentence, and those that end none before a number (fixed values).
ABBREVIATIONS = (
    "e.g. i.e. etc. vs. mr. mrs. ms. dr. prof. fig. approx. cf. al. a.m. p.m. u.k. u.s. ph.d. inc. ltd. co. corp. st.".split()
)
NUMBER_ABBREVIATIONS = ("no.", "nos.")

_CUT = "\x01"
_CLOSERS, _OPENERS = "[)\\]}\"'’”»]*+", "[(\\[{\"'‘“«]*+"
_STOPS = "[.!?…]"


def _one_of(words) -> str:
    """A lookbehind's body: one of the words (without their last full stop) as a word of its own."""
    return r"(?<![\p{L}\p{N}_.])(?i:" + "|".join(w[:-1].replace(".", r"\.") for w in words) + ")"


_END = (
    f"(?={_STOPS})(?<!{_STOPS})"  # the first of a run of stops
    rf"(?!(?:\.{{2,}}|…+)(?!{_STOPS}))"  # that is no ellipsis
    rf"(?:(?!\.(?!{_STOPS}))|(?<!{_one_of(ABBREVIATIONS)}))"  # nor the full stop of an abbreviation
    rf"(?!(?<={_one_of(NUMBER_ABBREVIATIONS)})\.\s+{_OPENERS}\p{{N}})"
    rf"{_STOPS}++{_CLOSERS}(?=\s+{_OPENERS}[\p{{Lu}}\p{{N}}])"
)
#: What markdown adds to its words, in order: texts that hold it, the pattern, and what it leaves. None looks further than to the next mark of its kind or the end of its line, but for blocks that run to their end.
_MARKS = (
    ("\r", r"\r\n?", "\n"),
    ("``` ~~~", r"(?ms)^ {0,3}(```|~~~).*?(?:^ {0,3}\1[`~]*[ \t]*$|\z)", "\n\n"),
    ("<!--", r"(?s)<!--.*?(?:-->|\z)", " "),
    ("|", r"(?m)^[ \t]*\|.*\|[ \t]*$", "\n"),
    ("-- ** __ - *", r"(?m)^ {0,3}[-*_][-*_ \t]{2,}$", "\n"),
    ("#", r"(?m)^ {0,3}#{1,6}[ \t]+(.*)$", "\n\n$1\n\n"),
    ("#", r"(?m)(?<![ \t])[ \t]+#+[ \t]*$", ""),
    (">", r"(?m)^[ \t]*>[> \t]*", ""),
    ("- * + . )", r"(?m)^[ \t]*(?:[-*+]|[0-9]{1,9}[.)])[ \t]+", "\n\n"),
    ("](", r"!?\[([^\[\]\n]*)\]\([^()\n]*\)", "$1"),
    ("* _", r"(?=[*_])(?<![\p{L}\p{N}_*])[*_]{1,3}(?=[^\s*_])", ""),
    ("* _", r"(?=[*_])(?<=[^\s*_])[*_]{1,3}(?![\p{L}\p{N}_*])", ""),
    ("`", r"`([^`\n]*)`", "$1"),
)


def plain_text(text: Column) -> Column:
    """Markdown without its marks: fenced code, tables and rules go, words stay. An unclosed fence or comment runs to the end."""

    def step(signs: str, mark: str, into: str):
        return lambda t: F.when(reduce(or_, [t.contains(s) for s in signs.split(" ")]), F.regexp_replace(t, mark, into)).otherwise(t)

    one = F.array(text)  # a list of one text, so that each step names the last one's result without repeating it
    for signs, mark, into in _MARKS:
        one = F.transform(one, step(signs, mark, into))
    return F.get(one, F.lit(0))


def sentences(text: Column) -> Column:
    """The sentences of a plain text, in order; a blank line ends one, too. Null has none."""
    x = F.regexp_replace(F.translate(text, _CUT, " "), _END, f"$0{_CUT}")
    x = F.regexp_replace(x, r"\r?\n[ \t]*\r?\n\s*", _CUT)
    return F.coalesce(F.filter(F.transform(F.split(x, _CUT), strip), lambda s: s != ""), F.array().cast("array<string>"))


#: Words whose vowels are not heard as they are grouped here, counted by ear.
BY_EAR = {
    "actual": 3, "apostrophe": 4, "arguable": 4, "arguing": 3, "being": 2, "cafe": 2, "catastrophe": 4, "client": 2, "create": 2, "created": 3, "creates": 2, "cruel": 2,
    "diet": 2, "doing": 2, "epitome": 4, "finale": 3, "giant": 2, "going": 2, "guess": 1, "hyperbole": 4, "idea": 2 + 1, "area": 3, "leopard": 2, "quiet": 2, "recipe": 3, "reliable": 4,
    "ruin": 2, "saying": 2, "science": 2, "seeing": 2, "video": 3, "virtuous": 3,
}
_PLAIN, _ACCENTED = "aaaaaaeeeeiiiiooooouuuuyyncs", "áàâäãåéèêëíìîïóòôöõúùûüýÿñçš"


_KNOWN = "(?<![a-z])(?:" + "|".join(BY_EAR) + ")(?![a-z])"
_SILENT = "(?=e(?![a-z]))(?:(?<=[aeiouy][a-z]{0,30}[^aeiouy ])(?<![^aeiouy ]l)|(?<=[aeiouy]))e"


def syllables(words: Column) -> Column:
    """Syllables of a text of words: groups of vowels in each hyphenated part, one at least where it has letters. A last e is silent but for consonant + le, i or
    u before a, o or u is heard by itself unless its consonant softens, and words known by ear count as heard. Each rule is one pass over the text."""
    text = F.regexp_replace(F.translate(F.lower(words), _ACCENTED + "-", _PLAIN + " "), "[^a-z ]", "")
    known = F.create_map(*[F.lit(x) for kv in BY_EAR.items() for x in kv])
    heard = F.aggregate(F.regexp_extract_all(text, F.lit(_KNOWN), F.lit(0)), F.lit(0), lambda n, w: n + F.element_at(known, w))
    count = lambda s, p: F.regexp_count(s, F.lit(p))

    def ruled(s: Column) -> Column:
        return count(s, "[aeiouy]+") + count(s, "(?<![tcsgxq])[iu](?=[aou])") + count(s, "(?<![a-z])[^aeiouy ]+(?![a-z])")

    rest = F.array(F.regexp_replace(F.regexp_replace(text, _KNOWN, ""), _SILENT, ""))  # named once, used by three counts
    return heard + F.get(F.transform(rest, ruled), F.lit(0))


_WORD = r"(?:\p{Lu}?[\p{Ll}\p{M}]+|\p{Lu}+|[\p{Lo}\p{M}]+)"
_PROSE = rf"(?<!\S)[(\[\"'“‘«*]*({_WORD}(?:['’-]{_WORD})*)(?=[)\]\"'”’».,;:!?…*]*(?:\s|\z))"


def prose_words(text: Column) -> Column:
    """The words of a text that are prose: letters with hyphens or apostrophes inside, lower-cased; code, paths and numbers are none."""
    return F.coalesce(F.regexp_extract_all(F.lower(F.regexp_replace(text, r"(?<!\S)\S*\p{Ll}\p{Lu}\S*", "")), F.lit(_PROSE), F.lit(1)), F.array().cast("array<string>"))
