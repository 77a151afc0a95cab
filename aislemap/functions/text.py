"""Product text normalisation as column expressions.

Every pattern carries ``(?U)`` so that digits and spaces follow Unicode. Word characters
are letters, numbers of any kind and the underscore, as in Python: ``²`` and ``½`` are word
characters, combining marks are not.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from aislemap.functions.price import price_band

# Lithuanian letters, stop words and term rewrites, in the order they apply.
LITHUANIAN_LETTERS = "ąčęėįšųūžĄČĘĖĮŠŲŪŽ"
LITHUANIAN_STOPWORDS = ["ir", "su", "be", "ar", "bet", "tik", "nei", "o", "kaip", "kad", "už", "ant"]
ENGLISH_STOPWORDS_SHORT = ["the", "and", "with", "for", "from", "by", "on", "at", "to", "in", "of"]
TERM_REWRITES = [
    (r"brand\s+new|brand-new", "new"),
    (r"genuine|authentic|original", "original"),
    (r"inch(?:es)?|colių", "in"),
    (r"centimeters|centimetrai|centimeter|cm", "cm"),
    (r"millimeters|milimetrai|millimeter|mm", "mm"),
    (r"professional|profesionalus", "pro"),
    (r"cover|shell|dėklas|dėkliukas", "case"),
    (r"genuine\s+leather|натуральная\s+кожа|tikra\s+oda", "leather"),
    (r"silicon|silikoninis", "silicone"),
    (r"water\s*resistant|water\s*proof|atsparus\s*vandeniui", "waterproof"),
    (r"cordless|bevielis", "wireless"),
]
DESCRIPTION_SNIPPET = 200
DESCRIPTION_MINIMUM = 10

# Size patterns.
INCH_UNIT = r'\s*(?:inch|in|")'
INCHES, INCHES_DECIMAL = r"(\d+)" + INCH_UNIT, r"(\d+)[.,](\d+)" + INCH_UNIT
DIMENSIONS = r"(\d+)[xX×](\d+)(?:[xX×](\d+))?"
# In every text that has a size of the three kinds.
MEASURES = r'\d(?:\s*(?:in|"|gb|tb|mb)|[xX×]\d)'
# Punctuation and spaces together: all that is no word character and no hyphen.
BETWEEN_WORDS = r"[^a-z\p{L}\p{N}_-]+"

_WORD = r"[\p{L}\p{N}_]"

# Storage size classes as digit patterns (over 128, over 32, the rest).
_OVER_128 = r"0*(?:129|1[3-9][0-9]|[2-9][0-9]{2}|[1-9][0-9]{3,})"
_OVER_32 = r"0*(?:3[3-9]|[4-9][0-9]|1[01][0-9]|12[0-8])"
_STORAGE_UNIT = r"\s*(?:gb|tb|mb)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sub(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, "(?U)" + pattern, replacement)


def _whole_words(words) -> str:
    """The words between other characters. What stands before is only looked at where a word can start."""
    firsts = "".join(sorted({option[0] for word in words for option in word.split("|")}))
    return f"(?=[{firsts}])(?<!{_WORD})(?:{'|'.join(words)})(?!{_WORD})"


def _where_found(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """``change`` of texts in which ``pattern`` is found; it must leave all others as they are. One search stands for its many."""
    changed = F.transform(F.array(text), lambda t: F.when(t.rlike("(?U)" + pattern), change(t)).otherwise(t))
    return changed[0]


def strip_punct_squeeze(c) -> Column:
    """Everything but word characters, spaces and hyphens becomes a space; runs shrink to one."""
    return F.trim(_sub(_col(c), BETWEEN_WORDS, " "))


def basic_preprocess(c) -> Column:
    return strip_punct_squeeze(F.lower(F.coalesce(_col(c), F.lit(""))))


def tag_language(c) -> Column:
    """``lt`` when a Lithuanian letter occurs, otherwise ``en``."""
    # one range tells most characters apart
    marked = F.coalesce(_col(c), F.lit("")).rlike(f"[{min(LITHUANIAN_LETTERS)}-{max(LITHUANIAN_LETTERS)}&&[{LITHUANIAN_LETTERS}]]")
    return F.when(marked, "lt").otherwise("en")


def norm_inches(c) -> Column:
    return _sub(_sub(_col(c), INCHES, "$1in"), INCHES_DECIMAL, "$1_$2in")


def norm_dimensions(c) -> Column:
    return _sub(_col(c), DIMENSIONS, "dim_$1_$2$3")


def norm_storage(c) -> Column:
    """Sizes with a unit become ``storage_large``, ``storage_medium`` or ``storage_small``."""
    text = _col(c)
    for size, name in ((_OVER_128, "large"), (_OVER_32, "medium"), (r"\d+", "small")):
        text = _sub(text, r"(?=\d)(?<!\d)" + size + _STORAGE_UNIT, "storage_" + name)
    return text


def remove_stopwords_by_lang(c, lang: Column) -> Column:
    text = _col(c)
    return (
        F.when(lang == "lt", _sub(text, _whole_words(LITHUANIAN_STOPWORDS), " "))
        .otherwise(_sub(text, _whole_words(ENGLISH_STOPWORDS_SHORT), " "))
    )


def norm_terms(c) -> Column:
    # the first rule that changes a text finds its match in the text as it came
    return _where_found(
        _col(c), _whole_words([term for term, _ in TERM_REWRITES]),
        lambda t: reduce(lambda text, rule: _sub(text, _whole_words([rule[0]]), rule[1]), TERM_REWRITES, t),
    )


def norm_measures(c) -> Column:
    """Inches, dimensions and storage sizes, in this order."""
    return _where_found(_col(c), MEASURES, lambda t: norm_storage(norm_dimensions(norm_inches(t))))


def robust_preprocess(c) -> Column:
    # the one-element transform lowers the text once
    def steps(text: Column) -> Column:
        return strip_punct_squeeze(norm_terms(remove_stopwords_by_lang(norm_measures(text), tag_language(text))))

    return F.transform(F.array(F.lower(F.coalesce(_col(c), F.lit("")))), steps)[0]


def text_features(title="title", seller="seller", price="price", description="description") -> Column:
    """Title, seller, price band and the start of the description as one text."""
    description = _col(description)
    snippet = F.trim(_sub(F.substring(description, 1, DESCRIPTION_SNIPPET), r"\s+", " "))
    return F.concat_ws(
        " ",
        _col(title),
        F.concat(F.lit("Seller: "), _col(seller)),
        price_band(price),
        F.when(F.char_length(description) > DESCRIPTION_MINIMUM, snippet),
    )


def tokenize(c) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(_WORD + "{2,}"), F.lit(0))


def remove_stopwords(tokens, words) -> Column:
    return F.filter(_col(tokens), lambda t: ~t.isin(*words))


def ngrams(tokens, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` neighbouring tokens, joined by a space."""

    def of_length(t: Column, n: int) -> Column:
        if n == 1:
            return t
        runs = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, runs).otherwise(F.array().cast("array<string>"))

    # the outer one-element transform computes the tokens once instead of once per run
    bound = F.transform(F.array(_col(tokens)), lambda t: F.concat(*[of_length(t, n) for n in range(low, high + 1)]))
    return bound[0]
