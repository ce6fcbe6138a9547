"""Column builders on terms, features and scores: filters, bins, keys, phrases and pairwise measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_TERMS = ("end", "none", "untitled")
MAX_TERM = 75


def _letters(term: Column) -> Column:
    return F.length(F.regexp_replace(term, r"[^\p{L}]", ""))


def bad_term(term: Column, stop_terms: tuple[str, ...] = STOP_TERMS, max_length: int = MAX_TERM) -> Column:
    """True for blank terms, a first character that is no letter or digit, rulers, mostly non-letters, stop terms and overlong terms."""
    bad = (F.trim(term) == "") | ~term.rlike(r"^[\p{L}\p{N}]") | term.contains("---") | term.contains("___") | (_letters(term) * 2 < F.length(term)) | (F.length(term) > max_length)
    return bad | F.lower(term).isin(*stop_terms) if stop_terms else bad


def bad_joined_term(term: Column, max_length: int = MAX_TERM) -> Column:
    """The filter for underscore-joined terms."""
    return term.contains(" ") | term.contains("---") | term.contains("___") | (F.length(term) > max_length)


def mostly_symbols(term: Column, max_length: int = MAX_TERM) -> Column:
    return (F.length(term) > max_length) | (_letters(term) < F.length(term) - _letters(term))


def alphabetic(term: Column) -> Column:
    """Lower-case letters and blanks, two at least."""
    return term.rlike("^[a-z ]{2,}$")


def has_long_word(phrase: Column, longest: int) -> Column:
    return F.exists(F.split(phrase, " "), lambda w: F.length(w) > longest)


def illegal_phrase(phrase: Column, stop_words: tuple[str, ...], longest: int = 30) -> Column:
    """First character no letter, an overlong word, noise punctuation, a bibliographic pattern, or a stop word."""
    stop = F.array(*[F.lit(w) for w in stop_words])
    return ~phrase.rlike(r"^\p{L}") | has_long_word(phrase, longest) | phrase.rlike(r"[\[\]{}<>|=%$#@*\\]") | phrase.rlike(r"\bet al\b|\bvol\b|\bpp\b|\b(19|20)\d\d\b") | F.arrays_overlap(F.split(F.lower(phrase), " "), stop)


def legal_feature(feature: Column) -> Column:
    """Exactly one ``=``."""
    return F.size(F.split(feature, "=")) == 2


def share_word(a: Column, b: Column) -> Column:
    return F.arrays_overlap(F.split(a, " "), F.split(b, " "))


def variant(a: Column, b: Column) -> Column:
    """b begins with a without its last two characters."""
    return F.startswith(b, F.expr("''") if a is None else F.substring(a, F.lit(1), F.greatest(F.length(a) - 2, F.lit(0))))


def keep_features(features: Column, prefixes: tuple[str, ...]) -> Column:
    """Features whose name is listed; an empty list keeps all."""
    if not prefixes:
        return features
    keep = F.array(*[F.lit(p) for p in prefixes])
    return F.filter(features, lambda f: F.array_contains(keep, F.element_at(F.split(f, "="), 1)))


def bin_right_closed(x: Column) -> Column:
    """0..9: above .9 is 9, up to .1 is 0."""
    out = F.lit(0)
    for k in range(1, 10):
        out = F.when(x > k / 10, k).otherwise(out)
    return out


def bin_left_closed(x: Column) -> Column:
    """0..9: from .9 is 9, 1.0 too; null above 1."""
    return F.when(x <= 1, F.least(F.floor(x * 10), F.lit(9))).cast("int")


def bin_twenty(x: Column) -> Column:
    """20 bins of .05, the top one closed."""
    return F.least(F.floor(x * 20), F.lit(19)).cast("int")


def rising(first: Column, last: Column, floor: float = 0.1, factor: float = 3.0) -> Column:
    """A score that was above zero, ends above a floor and has grown by more than a factor."""
    return (first > 0) & (last > floor) & (last > factor * first)


def ternary(x: Column, low: float = 0.5, high: float = 2.0) -> Column:
    return F.when(x < low, 0).when(x < high, 1).otherwise(2)


def label_by_range(x: Column) -> Column:
    """y for [.6, 1], n for [0, .2], else null."""
    return F.when(x.between(0.6, 1), "y").when(x.between(0, 0.2), "n")


def feature(name: str, value: Column) -> Column:
    """name=value with blanks as underscores; null for an empty value."""
    return F.when(value != "", F.concat(F.lit(name + "="), F.regexp_replace(value, " ", "_")))


def instance_key(chunk: Column, year: Column, phrase: Column) -> Column:
    return F.concat_ws("|", year.cast("string"), chunk.cast("string"), F.regexp_replace(phrase, " ", "_"))


def separated(phrase: Column) -> Column:
    """``[ a | b ]``: words with boundary marks."""
    return F.concat(F.lit("[ "), F.array_join(F.split(phrase, " "), " | "), F.lit(" ]"))


def boundary_pattern(phrase: Column, subset: str) -> Column:
    """What a full, left, right or middle match of a phrase looks like in :func:`separated` form."""
    inner = F.array_join(F.split(phrase, " "), " | ")
    left, right = ("[ ", " ]")
    return {
        "f": F.concat(F.lit(left), inner, F.lit(right)),
        "l": F.concat(F.lit(left), inner, F.lit(" |")),
        "r": F.concat(F.lit("| "), inner, F.lit(right)),
        "m": F.concat(F.lit("| "), inner, F.lit(" |")),
    }[subset]


def subphrases(words: Column) -> Column:
    """All contiguous word n-grams of a word array, the whole included."""
    n = F.size(words)
    return F.flatten(F.transform(F.sequence(F.lit(1), n), lambda s: F.transform(F.sequence(F.lit(1), n - s + 1), lambda k: F.array_join(F.slice(words, s, k), " "))))


def tfidf(tf: Column, df: Column, corpus: Column) -> Column:
    """tf * log2(corpus / (df + 1)) with a whole quotient, as the statistic has always been computed."""
    return tf * F.log2(F.floor(corpus / (df + 1)))


def kl(p: Column, q: Column) -> Column:
    """Sum of p * ln(p / q) over two arrays; terms with p = 0 count 0."""
    return F.aggregate(F.zip_with(p, q, lambda a, b: F.when(a == 0, 0.0).otherwise(a * F.log(a / b))), F.lit(0.0), lambda s, x: s + x)


def npmi(joint: Column, a: Column, b: Column, n: Column) -> Column:
    """Normalised pointwise mutual information of document counts; null where the pair is in every document."""
    p = joint / n
    return F.when(p < 1, F.log2(p / ((a / n) * (b / n))) / -F.log2(p))


def entropy(p: Column) -> Column:
    """Aggregate: Shannon entropy in bits of probabilities."""
    return -F.sum(F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def chinese(text: Column) -> Column:
    """More than half of the characters are Chinese."""
    return F.length(F.regexp_replace(text, r"[^\x{4e00}-\x{9fa5}]", "")) * 2 > F.length(text)


def short_patent_id(value: Column) -> Column:
    """Without a leading country code CN and one trailing letter."""
    return F.regexp_replace(F.regexp_replace(value, "^CN", ""), "[A-Z]$", "")


def year_of_path(path: Column) -> Column:
    """The parent directory if it is a year, else 9999."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"(?:^|/)(\d{4})/[^/]*$", 1), F.lit("")).cast("int"), F.lit(9999))


def singular(word: Column) -> Column:
    """Compact suffix rules for English plurals."""
    return (
        F.when(word.rlike("(ss|us|is)$") | (F.length(word) < 4), word)
        .when(word.rlike("ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(ch|sh|x|s|z)es$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("s$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def canonical_phrase(phrase: Column) -> Column:
    return F.array_join(F.transform(F.split(F.lower(phrase), " "), singular), " ")
