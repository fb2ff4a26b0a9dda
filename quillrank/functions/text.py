"""Text functions as Spark columns. All of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._cols import as_col

# The default English stop words.
ENGLISH_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it",
    "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these",
    "they", "this", "to", "was", "will", "with",
)

# Characters that end a word of a status but never start an entity.
STATUS_DELIMITERS = "[]!\"$%()*+,/:;<=>?\\^`{|}~-…¬·"
# Characters that start a mention or a hashtag, and the underscore.
ENTITY_DELIMITERS = "@＠#＃_"
# Host endings accepted for a link without a scheme.
LINK_ENDINGS = ("com", "org", "net", "edu", "gov", "mil", "info", "biz", "int", "co", "io", "me", "tv", "uk", "us", "ca", "de", "fr", "es", "jp", "eu")

TOKEN = "([a-z0-9]+)"
URL_TOKEN = (
    r"(?i)^(https?://([a-z0-9_-]+\.)+[a-z]{2,}|([a-z0-9-]+\.)+(" + "|".join(LINK_ENDINGS) + r"))(:\d+)?([/?#]\S*)?$"
)
MENTION_TOKEN = r"(?i)^[@＠][a-z0-9_]{1,20}(/[a-z][a-z0-9_-]{0,24})?$"
HASHTAG_TOKEN = r"(?i)^[#＃][a-z0-9_]*[a-z_][a-z0-9_]*$"


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of ASCII letters and digits, in text order."""
    return F.regexp_extract_all(F.lower(as_col(text)), F.lit(TOKEN), F.lit(1))


def without(words: Column, stop: Sequence[str]) -> Column:
    """Token array without the given words. More than ten words become a hash-set lookup."""
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def english_tokens(text: Column | str) -> Column:
    """Tokens without the English stop words (no stemming; see ``stemming.stem_words``)."""
    return without(tokens(text), ENGLISH_STOPWORDS)


def remove_stopwords(text: Column | str, stop: Sequence[str]) -> Column:
    """Text with the words of ``stop`` taken out, words joined by one space."""
    words = F.filter(F.split(as_col(text), r"\s+"), lambda w: w != "")
    return F.array_join(without(words, stop), " ")


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "[]\\^-" else c for c in chars) + "]"


def status_tokens(text: Column | str) -> Column:
    """Tokens of a status text.

    Words are cut at white space. Links stay as they are. Other words are cut at the
    delimiters; mentions and hashtags are lower-cased and kept whole; the remaining pieces are
    cut at ``@ # _``, lower-cased and stripped of everything but letters and digits. A period
    cuts only if the character two places before or after it is not a period (``U.S.`` gives
    ``us``); an ampersand does not cut between two letters that are not lower case (``AT&T``).
    """
    words = F.filter(F.split(as_col(text), r"\s+"), lambda w: w != "")
    # Most words are plain; only the others go through the rules.
    plain = r"^[\p{L}\p{Nd}]+$"
    return F.flatten(F.transform(words, lambda w: F.when(w.rlike(plain), F.array(F.lower(w))).otherwise(_word_tokens(w))))


def _word_tokens(word: Column) -> Column:
    # A delimiter may stand before a link, so links are looked for before and after the cut.
    cut = F.regexp_replace(word, r"(?i)([" + _class(STATUS_DELIMITERS)[1:-1] + r"])(?=https?://)", "$1 ")
    parts = F.filter(F.split(cut, " "), lambda p: p != "")
    return F.flatten(
        F.transform(parts, lambda p: F.when(p.rlike(URL_TOKEN), F.array(p)).otherwise(_piece_tokens(p)))
    )


def _piece_tokens(word: Column) -> Column:
    pieces = F.split(F.regexp_replace(word, _class(STATUS_DELIMITERS), " "), " ")
    # Rules for the period and the ampersand look at neighbours inside one piece.
    pieces = F.flatten(
        F.transform(
            pieces,
            lambda p: F.split(
                F.regexp_replace(p, r"(?<=[^.].)\.|\.(?=.[^.])|^&|&$|(?<=\p{Ll})&|&(?=\p{Ll})", " "), " "
            ),
        )
    )
    kept = F.flatten(
        F.transform(
            pieces,
            lambda p: F.when(p.rlike(MENTION_TOKEN) | p.rlike(HASHTAG_TOKEN), F.array(F.lower(p))).otherwise(
                F.transform(
                    F.split(F.regexp_replace(F.lower(p), _class(ENTITY_DELIMITERS), " "), " "),
                    lambda w: F.regexp_replace(w, r"[^\p{L}\p{Nd}]", ""),
                )
            ),
        )
    )
    return F.filter(kept, lambda t: t != "")


def is_entity(term: Column | str) -> Column:
    """True for links, mentions and hashtags, which are never stemmed."""
    t = as_col(term)
    return t.rlike(URL_TOKEN) | t.rlike(MENTION_TOKEN) | t.rlike(HASHTAG_TOKEN)


# Forms of a character reference after "&", and the code points that are no characters.
DECIMAL_REFERENCE, HEX_REFERENCE = "^#[0-9]{1,7};", "^#[xX][0-9a-fA-F]{1,6};"
SURROGATES, LAST_CODE_POINT = (0xD800, 0xDFFF), 0x10FFFF


@cache
def named_characters() -> dict[str, str]:
    """Characters of all named references that the HTML standard publishes; a no-break space is a space here."""
    return {name: " " if char == "\xa0" else char for name, char in html5.items() if name.endswith(";")}


def references(text: Column) -> Column:
    """Text with references such as ``&eacute;``, ``&#8217;`` and ``&#x2019;`` as the characters they name, in one pass.

    What a reference makes begins no further one; ampersands that begin none stay.
    """
    # One map a row: inside the function that resolves a part it would be made for each part.
    table = F.str_to_map(F.lit("\x01".join(f"{name}\x02{char}" for name, char in named_characters().items())), F.lit("\x01"), F.lit("\x02"))

    def resolve(part: Column, names: Column) -> Column:
        head = F.concat(F.split_part(part, F.lit(";"), F.lit(1)), F.lit(";"))
        decimal, hexadecimal = part.rlike(DECIMAL_REFERENCE), part.rlike(HEX_REFERENCE)
        digits = F.regexp_replace(head, "[#xX;]", "")
        code = F.when(decimal, digits.try_cast("int")).when(hexadecimal, F.conv(digits, 16, 10).try_cast("int"))
        valid = code.between(1, LAST_CODE_POINT) & ~code.between(*SURROGATES)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(F.lit(32))), 8, "0")), "UTF-32")
        found = F.when(valid, char).when(F.contains(part, F.lit(";")), F.try_element_at(names, head))
        return F.coalesce(F.concat(found, F.substr(part, F.length(head) + 1)), F.concat(F.lit("&"), part))

    def whole(names: Column) -> Column:
        return F.array_join(F.transform(F.split(text, "&"), lambda p, i: F.when(i == 0, p).otherwise(resolve(p, names))), "")

    return F.transform(F.array(table), whole)[0]


def html_to_text(html: Column | str) -> Column:
    """Text of a page: comments, scripts, styles and tags dropped, character references resolved."""
    out = F.regexp_replace(as_col(html), r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?is)<script\b.*?</script\s*>", " ")
    out = F.regexp_replace(out, r"(?is)<style\b.*?</style\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    out = F.when(F.contains(out, F.lit("&")), references(out)).otherwise(out)
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def url_domain(url: Column | str) -> Column:
    """Host of a URL without a leading ``www.``; NULL when there is none or the URL is bad."""
    host = F.try_parse_url(as_col(url), F.lit("HOST"))
    return F.regexp_replace(host, r"^www\.", "")


def fold_newlines(text: Column | str) -> Column:
    """Each run of line ends becomes one space."""
    return F.regexp_replace(as_col(text), r"[\r\n]+", " ")


def count_substr(text: Column | str, part: str) -> Column:
    """Number of non-overlapping occurrences of ``part``."""
    t = as_col(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("int")


def to_epoch(created_at: Column | str) -> Column:
    """Seconds since 1970 of ``EEE MMM d HH:mm:ss Z yyyy`` text; NULL when it does not parse."""
    return F.unix_timestamp(F.try_to_timestamp(F.substring(as_col(created_at), 5, 64), F.lit("MMM d HH:mm:ss Z yyyy")))


def parse_count(text: Column | str) -> Column:
    """Count text such as ``100+`` as a number; NULL when it is none."""
    return F.replace(as_col(text), F.lit("+"), F.lit("")).try_cast("int")


def get_json(json: Column | str, path: str, default: str | None = None) -> Column:
    """A field of a JSON text column, or the default when it is missing."""
    found = F.get_json_object(as_col(json), path)
    return found if default is None else F.coalesce(found, F.lit(default))
