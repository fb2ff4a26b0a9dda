"""Stemming as column expressions: a chain of rewriting steps, the same text for both engines.

Each step looks at a word once and rewrites its longest ending that a rule knows, if the stem before it is
long enough. Lengths are patterns: a stem is consonants, then groups of vowels and consonants. At its start
``y`` is a consonant and is written ``Y`` until the last step. Words that are not stemmed carry a ``.`` at their
end meanwhile, which no ending has.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffix rules of steps 2, 3 and 4 of Porter (1980).
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
)

_C, _V1 = "[^aeiou][^aeiouy]*", "[aeiouy]"
_V = _V1 + "[aeiou]*"
#: What a stem begins with if it has a vowel, or at least one or two groups of vowels and consonants.
_VOWEL, _ONE, _TWO = f"(?:{_C})?{_V1}", f"(?:{_C})?{_V}{_C}", f"(?:{_C})?{_V}{_C}{_V}{_C}"
#: A stem of one group whose only vowel is between single consonants, the last not w, x or y.
_SHORT = f"^{_C}{_V1}[^aeiouwxy]"
_TWINS = "(" + "|".join(c * 2 for c in "bcdfghjkmnpqrtvwx") + "|[^aeiouy](yy)+|[aeiou]y(yy)+)[|]$"


@dataclass(frozen=True)
class Rule:
    """Words that end in one of ``ends`` and are ``like`` but not ``unlike`` the patterns have ``old`` replaced by ``new``.

    ``new`` begins with ``{1}`` where it keeps what the group of ``old`` has found. Without ``old`` the word stays.
    """

    ends: tuple[str, ...] = ()
    like: str = ""
    unlike: str = ""
    old: str = ""
    new: str = ""

    def column(self, x: Column) -> tuple[Column, Column]:
        tests = [reduce(or_, (F.endswith(x, F.lit(e)) for e in self.ends))] if self.ends else []
        tests += [x.rlike(self.like)] if self.like else []
        tests += [~x.rlike(self.unlike)] if self.unlike else []
        return reduce(and_, tests, F.lit(True)), F.regexp_replace(x, self.old, self.new.replace("{1}", "$1")) if self.old else x

    def sql(self) -> str:
        tests = ["(" + " OR ".join(f"suffix(x, '{e}')" for e in self.ends) + ")"] if self.ends else []
        tests += [f"regexp_matches(x, '{self.like}')"] if self.like else []
        tests += [f"NOT regexp_matches(x, '{self.unlike}')"] if self.unlike else []
        then = f"regexp_replace(x, '{self.old}', '{self.new.replace('{1}', chr(92) + '1')}')" if self.old else "x"
        return f"WHEN {' AND '.join(tests) or 'true'} THEN {then}"


def _ending(suffix: str, stem: str, new: str = "") -> Rule:
    """Words in ``suffix`` whose stem is long enough get the ending ``new``."""
    return Rule((suffix,), old=f"^({stem}.*){suffix}$", new="{1}" + new)


def _endings(table: dict[str, str], stem: str) -> list[Rule]:
    return [_ending(s, stem, table[s]) for s in sorted(table, key=len, reverse=True)]


#: The steps; in each the first rule that knows a word decides.
STEPS: list[list[Rule]] = [
    [Rule(like="^[a-z]{3,}$", old="^y", new="Y"), Rule(old="(?s)^(.*)$", new="{1}.")],
    [Rule(("sses", "ies"), old="es$"), Rule(("ss",)), Rule(("s",), old="s$")],
    [_ending("eed", _ONE, "ee"), _ending("ed", _VOWEL, "|"), _ending("ing", _VOWEL, "|")],
    [
        Rule(unlike="[|]$"),
        Rule(("at|", "bl|", "iz|"), old="[|]$", new="e"),
        Rule(like=_TWINS, old=".[|]$"),
        Rule(like=_SHORT + "[|]$", old="[|]$", new="e"),
        Rule(old="[|]$"),
    ],
    [_ending("y", _VOWEL, "i")],
    _endings(STEP2, _ONE),
    _endings(STEP3, _ONE),
    [Rule(("ion",), unlike="[st]ion$"), *_endings(dict.fromkeys(STEP4, ""), _TWO)],
    [Rule(("e",), like=f"^{_TWO}.*e$", old="e$"), Rule(("e",), like=_SHORT + "e$"), _ending("e", _ONE)],
    [Rule(("ll",), old=f"^({_TWO}.*)l$", new="{1}")],
    [Rule((".",), old="[.]$"), Rule(old="^Y", new="y")],
]


def _rewriting(step: list[Rule]) -> Callable[[Column], Column]:
    def rewrite(x: Column) -> Column:
        first, *rest = [rule.column(x) for rule in step]
        return reduce(lambda case, rule: case.when(*rule), rest, F.when(*first)).otherwise(x)

    return rewrite


def stem_words(words: Column) -> Column:
    """Stems of an array of words.

    Only words of three or more letters a to z are stemmed, so links, mentions, hashtags, numbers and words
    in other scripts keep their form.
    """
    return reduce(lambda found, step: F.transform(found, _rewriting(step)), STEPS, words)


def stem_sql(words: str) -> str:
    """The same as DuckDB's SQL over ``words``, an array expression."""
    for step in STEPS:
        words = f"list_transform({words}, lambda x: CASE {' '.join(rule.sql() for rule in step)} ELSE x END)"
    return words


def stem_terms(terms: DataFrame) -> DataFrame:
    """``(term, stem)`` for the distinct terms of ``terms``."""
    return terms.select("term").distinct().withColumn("stem", stem_words(F.array("term"))[0])


def stem_column(df: DataFrame) -> DataFrame:
    """Replace column ``term`` by its stem."""
    return df.withColumn("term", stem_words(F.array("term"))[0])
