"""Column builders for ids, tags, dates, split texts and formatted numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that place a passage in time, in the order in which classes are tried.
TIME_FRAMES = (
    ("F", ("family", "father", "mother", "brother", "sister", "siblings")),
    ("C", ("present", "current", "presenting", "chief")),
    ("P", ("past", "history", "previous", "prior")),
    ("D", ("discharge", "disposition")),
    ("I", ("instructions", "followup", "follow-up")),
    ("A", ("allergies", "allergy", "habits")),
    ("E", ("examination", "exam", "laboratory", "studies", "data")),
)
MONTHS = "january february march april may june july august september october november december".split()


def words_with_tag(tagged: Column, prefix: str = "N") -> Column:
    """Lower-cased tokens of a token_TAG string whose tag begins so."""
    pairs = F.filter(F.split(tagged, " "), lambda x: F.startswith(F.substring_index(x, "_", -1), F.lit(prefix)))
    return F.transform(pairs, lambda x: F.lower(F.left(x, F.length(x) - F.length(F.substring_index(x, "_", -1)) - 1)))


def tag_acronym(tags: Column, legal: tuple[str, ...] = ()) -> Column:
    """First letters of blank-separated tags; null if one isn't legal (no list: all are)."""
    first = F.transform(F.split(tags, " "), lambda t: F.left(t, F.lit(1)))
    joined = F.array_join(first, "")
    return F.when(F.size(F.array_except(first, F.array(*[F.lit(x) for x in legal]))) == 0, joined) if legal else joined


def patent_id(path: Column) -> Column:
    """Letters and digits of a file name, without a leading country code."""
    return F.nullif(F.regexp_extract(F.substring_index(path, "/", -1), r"^(?:US)?(\D*\d+)", 1), F.lit(""))


def patent_parts(name: Column) -> Column:
    """(prefix, kind, number) of a file name without directories; prefix and kind may be empty."""
    bare = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "^US", "")
    get = lambda k: F.regexp_extract(bare, r"^([A-Z]*)(\d+)([A-Z]\d?)?$", k)
    return F.struct(get(1).alias("prefix"), get(3).alias("kind"), get(2).alias("number"))


def patent_path(number: Column) -> Column:
    """Two directories that hold at most a hundred patents: the year, letters or two digits, and the rest without its last two digits.

    Applications alone begin with a year, and have more than eight digits; patents 1,900,000 to 2,099,999 don't."""
    head = F.when(number.rlike(r"^(19|20)\d{7}"), 4).when(number.rlike("^[A-Za-z]{2}"), 2).when(number.rlike("^[A-Za-z]"), 1).otherwise(2)
    return F.concat_ws("/", F.left(number, head), F.substring(number, head + 1, F.greatest(F.length(number) - head - 2, F.lit(0))))


def section_of(feature_line: Column) -> Column:
    """The section of a ``section_loc=`` feature, without the part after its last underscore."""
    return F.nullif(F.regexp_extract(feature_line, r"section_loc=(\S+?)(?:_sent\d+|_later)?(?:\s|$)", 1), F.lit(""))


def section_location(section: Column, sentence_in_section: Column) -> Column:
    """SECTION_sent1 for a section's first sentence, SECTION_later for others."""
    return F.concat(section, F.when(sentence_in_section == 0, "_sent1").otherwise("_later"))


def offsets_of(text: Column, needle: str) -> Column:
    """All offsets of a string, overlapping ones too, from 0; one search through each text, as a substring at every place costs the square of its length."""

    def places(t: str | None) -> list[int]:
        out, i = [], t.find(needle) if t is not None else -1
        while i >= 0:
            out.append(i)
            i = t.find(needle, i + 1)
        return out

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([places(t) for t in b], dtype=object)

    return run(text)


def two_decimals(x: Column) -> Column:
    """Two decimals as text, ``None`` for null."""
    return F.when(x.isNull(), "None").otherwise(F.format_string("%.2f", x))


def lookup_score(x: Column) -> Column:
    """-1 as it is, else four decimals."""
    return F.when(x == -1, "-1").otherwise(F.format_string("%.4f", x))


def ratio(count: Column, total: Column) -> Column:
    return F.when(total != 0, F.format_string("%.2f", count / total)).otherwise("0.00")


def after_word(text: Column, word: str) -> Column:
    """(word, what follows its first occurrence between blanks, what precedes it), or null."""
    mark = f" {word} "
    parts = F.split(text, f" {word} ".replace(".", r"\."))
    return F.when(text.contains(mark), F.struct(F.lit(word).alias("word"), F.get(parts, F.lit(1)).alias("after"), F.get(parts, F.lit(0)).alias("before")))


def counted_line(line: Column) -> Column:
    """``  count value`` as count TAB value."""
    return F.regexp_replace(F.ltrim(line), r"^(\S+) ", "$1\t")


def fragments(text: Column) -> Column:
    """Parts of a text, cut after end marks, commas and tabs and at blank lines; trimmed, without empty ones."""
    cut = F.split(F.regexp_replace(text, r"([.?!;:,\t])", "$1\u0001"), r"\u0001|[\r\n]{2,}")
    return F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: x != "")


def chinese_fragments(text: Column) -> Column:
    """Parts of a text cut after the Chinese full stop alone; white space goes."""
    cut = F.split(F.regexp_replace(F.regexp_replace(text, r"\s+", ""), "。", "。\u0001"), "\u0001")
    return F.filter(cut, lambda x: x != "")


def without_controls(text: Column) -> Column:
    """No control characters but tab, line feed and carriage return."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def all_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def numeric_date(date: Column) -> Column:
    """``Month day, year`` with a month's name or its first three letters as mm-dd-yyyy; one word stays as it is."""
    parts = F.filter(F.split(F.regexp_replace(date, ",", " "), r"\s+"), lambda x: x != "")
    month = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.lower(F.left(F.element_at(parts, 1), F.lit(3))))
    whole = F.array_contains(F.array(*[F.lit(x) for m in MONTHS for x in (m, m[:3])]), F.lower(F.element_at(parts, 1)))
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x))
    return F.when((F.size(parts) > 1) & whole, F.concat_ws("-", F.lpad(month.cast("string"), 2, "0"), F.array_join(rest, "-"))).otherwise(date)


def time_frame(tokens: Column) -> Column:
    """Class of the first list that shares a word with the tokens, U if none does."""
    out = F.lit("U")
    for name, words in reversed(TIME_FRAMES):
        out = F.when(F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words])), name).otherwise(out)
    return out


def shared_terms(a: Column, b: Column, longer_than: int) -> Column:
    """Words of both lists, in lower case, that are longer than a minimum, sorted."""
    low = lambda x: F.transform(F.filter(x, lambda w: F.length(w) > longer_than), lambda w: F.lower(w))
    return F.array_sort(F.array_intersect(low(a), low(b)))


def shared_stems(a: Column, b: Column, size: int) -> Column:
    """First letters that longer words of both lists share, in lower case, sorted."""
    cut = lambda x: F.transform(F.filter(x, lambda w: F.length(w) > size), lambda w: F.left(F.lower(w), F.lit(size)))
    return F.array_sort(F.array_intersect(cut(a), cut(b)))


def affixes_in(tokens: Column, affixes: tuple[str, ...]) -> Column:
    """Known affixes that a token contains which is at least three characters longer, sorted."""
    known = F.array(*[F.lit(a) for a in affixes])
    return F.array_sort(F.filter(known, lambda a: F.exists(tokens, lambda t: (F.length(t) - F.length(a) > 2) & F.contains(F.lower(t), a))))


def value_of_label(row: Column, label: str) -> Column:
    """The score after a label in a blank-separated row of alternating labels and scores, and its place from 1 (null if it isn't there)."""
    parts = F.split(row, " ")
    at = F.array_position(parts, F.lit(label)).cast("int")
    return F.when(at > 0, F.struct((at + 1).alias("place"), F.get(parts, at).cast("double").alias("score")))


def highlighted(tokens: Column, start: Column, end: Column) -> Column:
    """A sentence with ``<np>`` marks around the words from start to end (exclusive, from 0); markup characters are escaped."""
    safe = F.transform(tokens, lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")))
    part = lambda a, n: F.array_join(F.slice(safe, a + 1, n), " ")
    return F.trim(F.concat(part(start * 0, start), F.lit(" <np> "), part(start, end - start), F.lit(" </np> "), part(end, F.size(tokens) - end)))


def domain_of_class(classname: Column, domains: Column) -> Column:
    """(key, domain) of a hyphenated class: section and class if the map has them, else with the subclass."""
    parts = F.split(classname, "-")
    short, long = F.array_join(F.slice(parts, 1, 2), ""), F.array_join(parts, "")
    return F.when(domains[short].isNotNull(), F.struct(short.alias("key"), domains[short].alias("domain"))).otherwise(F.struct(long.alias("key"), domains[long].alias("domain")))


def first_keyword(text: Column, keywords: tuple[str, ...]) -> Column:
    """The keyword that comes first in a text, the longest of those at one place."""
    return F.nullif(F.regexp_extract(F.lower(text), "(" + "|".join(sorted(keywords, key=lambda k: (-len(k), k))) + ")", 1), F.lit(""))


def rest_of_description(text: Column, ends: list[Column], start: Column, stop: Column) -> Column:
    """The description from the end of the first section that there is (in the order given) to its own end; all of it without any."""
    begin = F.coalesce(*ends, start)
    return F.when(stop.isNotNull(), F.trim(F.substring(text, begin + 1, F.greatest(stop - begin, F.lit(0)))))
