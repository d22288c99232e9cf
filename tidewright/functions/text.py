"""Text functions as column builders: nothing here leaves the JVM."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
STRIP_CHARS = " -_.,'?!"
PUNCTUATION = r"[\{\}\[\](),.\"';:!?&^/*-]"
STOP_WORDS = (
    "a", "au", "aux", "de", "des", "du", "par", "pour", "sur", "chez", "dans", "sous", "vers", "le", "la", "les", "l", "c", "ce", "ca",
    "mais", "et", "ou", "donc", "or", "ni", "car",
)
STOP_WORDS_EN = ("and", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")
ACCENTS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
ASCII = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
LIGATURES = (("œ", "oe"), ("æ", "ae"), ("ß", "ss"), ("Œ", "OE"), ("Æ", "AE"))
# end of fixed values


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_of(c: Column | str, chars: str) -> Column:
    return F.btrim(col(c), F.lit(chars))


def stripped(c: Column | str) -> Column:
    """Without punctuation, then quotes, then white space around it."""
    return F.trim(trim_of(trim_of(c, STRIP_CHARS), '"'))


def pre_split(c: Column | str) -> Column:
    """A space on each side and one for each sign that separates words."""
    return F.regexp_replace(F.concat(F.lit(" "), F.trim(col(c)), F.lit(" ")), PUNCTUATION, " ")


def to_ascii(c: Column | str) -> Column:
    out = F.translate(col(c), ACCENTS, ASCII)
    for sign, letters in LIGATURES:
        out = F.replace(out, F.lit(sign), F.lit(letters))
    return out


def case_phrase(c: Column | str, keep_acronyms: bool = False) -> Column:
    """ASCII, lower case, separators blanked; inner runs of spaces stay. keep_acronyms: words of 3 to 6 capitals and
    digits keep their case."""
    plain = to_ascii(F.trim(pre_split(c)))
    if not keep_acronyms:
        return F.lower(plain)
    words = F.split(plain, " ")
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike("^[A-Z0-9]{3,6}$"), w).otherwise(F.lower(w))), " ")


def is_valid_token(t: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Not empty, not only digits, longer than two (or an upper-case word), no stop word."""
    s = stripped(t)
    long = (F.length(s) > 2) | (s.rlike(r"^\p{L}+$") & (s == F.upper(s)))
    return (s != "") & ~s.rlike("^[0-9]+$") & long & ~s.isin(*stop_words)


def tokens(c: Column | str, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Valid tokens of the normalized phrase; none if all of them are single digits."""
    words = F.filter(F.split(F.trim(case_phrase(c)), r"\s+"), lambda w: w != "")
    kept = F.filter(words, lambda w: is_valid_token(w, stop_words))
    return F.when(F.size(F.filter(kept, lambda w: ~w.rlike("^[0-9]$"))) > 0, kept).otherwise(F.array().cast("array<string>"))


def valid_phrase(c: Column | str, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """The valid tokens joined by spaces, null if there is none."""
    return F.nullif(F.array_join(tokens(c, stop_words), " "), F.lit(""))


def normalized(c: Column | str, tokenize: bool = False, stop_words: tuple[str, ...] | None = None) -> Column:
    return valid_phrase(c, stop_words or STOP_WORDS) if tokenize or stop_words else case_phrase(c)


def dehyphenate(c: Column | str) -> Column:
    """Hyphens go, but those next to a part of digits only and one at the end."""
    return F.regexp_replace(col(c), r"(?<=[^0-9\W])-(?=\w*[^\W0-9]\w*)", "")


def char_template(c: Column | str) -> Column:
    """Digits as D, letters as L, other signs as ?, and a final $; null unless 5 to 16 long with a digit."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(col(c), "[^0-9A-Za-z]", "?"), "[A-Za-z]", "L"), "[0-9]", "D")
    return F.when(F.length(col(c)).between(5, 16) & col(c).rlike("[0-9]"), F.concat(shape, F.lit("$")))


def distinct_chars(c: Column | str) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(col(c), ""), lambda x: x != "")))


def cover_score(a: Column | str, b: Column | str) -> Column:
    """100 times the shorter length over the longer."""
    x, y = F.length(col(a)), F.length(col(b))
    return F.when(F.greatest(x, y) == 0, F.lit(0.0)).otherwise(100.0 * F.least(x, y) / F.greatest(x, y))


def fast_similarity(distance: Column | str, length: Column | str) -> Column:
    """Score of an edit distance of up to two by the length of the label."""
    d, n = col(distance), col(length)
    return (
        F.when(d == 0, 100).when((d == 1) & (n > 8), 50).when((d == 2) & (n > 8), 20).when((d == 1) & (n > 4), 20)
        .when((d == 2) & (n > 4), 10).when(d == 1, 5).otherwise(0)
    )


def token_score(n_source: Column, n_matched: Column, source_chars: Column, matched_chars: Column, ref_chars: Column) -> Column:
    """100 * matched characters of the reference phrase if enough of both sides is matched, else 0."""
    enough = (100 * n_matched >= 80 * n_source) & (100 * matched_chars >= 70 * source_chars) & (100 * matched_chars >= 60 * ref_chars)
    return F.when(enough, 100.0 * matched_chars / ref_chars).otherwise(0.0)


def acronym(words: Column) -> Column:
    """Upper-case initials of three to seven tokens, else null."""
    return F.when(F.size(words).between(3, 7), F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), ""))


def inner_acronyms(words: Column) -> Column:
    """Initials of the windows of four and five tokens that end before the last token."""
    starts = F.when(F.size(words) > 4, F.sequence(F.lit(0), F.size(words) - 5)).otherwise(F.array().cast("array<int>"))

    def window(i: Column, k: int) -> Column:
        return F.when(i + k < F.size(words), F.array_join(F.transform(F.slice(words, i + 1, k), lambda w: F.upper(F.substring(w, 1, 1))), ""))

    return F.array_distinct(F.filter(F.flatten(F.transform(starts, lambda i: F.array(window(i, 4), window(i, 5)))), lambda x: x.isNotNull()))


def char_ngrams(c: Column | str, n: int = 3) -> Column:
    s = col(c)
    at = F.when(F.length(s) >= n, F.sequence(F.lit(1), F.length(s) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substr(s, i, F.lit(n)))


def is_punctuation(c: Column | str) -> Column:
    """Only punctuation and spaces; the empty text counts."""
    return col(c).rlike(r"^[!-/:-@\[-`{-~ ]*$")


def is_numeric(c: Column | str) -> Column:
    """Digits once commas and points are out; the empty text doesn't count."""
    return F.translate(col(c), ",.", "").rlike("^[0-9]+$")


def code_chars(c: Column | str) -> Column:
    return F.translate(col(c), "-’", "–'")


def joined_unique(values: Column, sep: str = "; ") -> Column:
    return F.array_join(F.array_distinct(values), sep)


def replace_synonyms(c: Column | str, pairs: list[tuple[str, str]]) -> Column:
    """Each (found, put) in order, over all places."""
    return functools.reduce(lambda out, p: F.replace(out, F.lit(p[0]), F.lit(p[1])), pairs, col(c))


def translate_words(c: Column | str, forms: dict[str, tuple[str, ...]]) -> Column:
    """Whole words to their main form: {main: (variant, ...)}, values in lower case."""
    out = F.lower(col(c))
    for main, variants in forms.items():
        out = F.regexp_replace(out, rf"\b({'|'.join(variants)})\b", main)
    return out


def category(c: Column | str, rules: list[tuple[str, str]]) -> Column:
    """The first (pattern, name) whose pattern is found."""
    return F.coalesce(*[F.when(F.lower(col(c)).rlike(p), F.lit(n)) for p, n in rules])


def research_unit(c: Column | str) -> Column:
    """`KIND id` of a research unit: its kind, then letters or digits and a digit."""
    kind, number = F.regexp_extract(F.upper(to_ascii(c)), r"\b(UMR|UPR|UMS|USR|EA|ERL|FRE|GDR)[ _-]*([A-Z]?[0-9]{2,4})\b", 1), F.regexp_extract(F.upper(to_ascii(c)), r"\b(UMR|UPR|UMS|USR|EA|ERL|FRE|GDR)[ _-]*([A-Z]?[0-9]{2,4})\b", 2)
    return F.when(kind != "", F.concat(kind, F.lit(" "), number))


def bracketed_acronym(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(c), r"[\[(]([A-Z0-9]{3,6})[\])]", 1), F.lit(""))


def prefix_code(c: Column | str) -> Column:
    """(code, rest): the first five digits and what follows them, both null without them."""
    v = col(c)
    has = F.substring(v, 1, 5).rlike("^[0-9]{5}$")
    return F.struct(F.when(has, F.substring(v, 1, 5)).alias("code"), F.when(has, F.trim(F.substr(v, F.lit(6)))).alias("rest"))


def key_of(cols: list[str], sep: str = " ") -> Column:
    """Columns joined (null: empty), separators at the ends off, empty to null, then normalized."""
    joined = F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.nullif(F.trim(case_phrase(trim_of(joined, sep))), F.lit(""))
