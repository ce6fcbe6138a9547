"""Text to rows: sentences, function-word chunks, windows, dictionary lookup, feature patterns, and the tag-driven phrase chunker."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FUNCTION_WORDS = tuple("a an the of in on at to for from by with and or nor but is are was were be been it its this that these those as not no he she they we you i his her their our your which who whom what when where why how if then than so such can could may might must shall should will would do does did has have had".split())


def sentences(text: Column) -> Column:
    """Split after . ? or ! and white space."""
    return F.split(text, r"(?<=[.?!])\s+")


def chunk_by_function_words(text: Column, words: tuple[str, ...] = FUNCTION_WORDS) -> Column:
    """Maximal runs of tokens that are neither function words nor punctuation, lower-cased."""
    edge = r"\s.,;:!?|()\""
    cut = rf"[.,;:!?|()\"]|(?<![^{edge}])(?:{'|'.join(re.escape(w) for w in words)}|[^\p{{L}}\p{{N}}\s]+)(?![^{edge}])"
    parts = F.transform(F.split(F.lower(text), cut), lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.filter(parts, lambda c: c != "")


def context_window(docs: DataFrame, targets: DataFrame, size: int = 3) -> DataFrame:
    """(target, neighbour, tf, df) of the tokens within ``size`` places of a target word; docs (doc, tokens), targets (target).

    Targets are met by an equi-join of exploded tokens; the window is a slice of the document's own array.
    """
    at = docs.select("doc", "tokens", F.posexplode("tokens").alias("pos", "target")).join(targets, "target")
    lo = F.greatest(F.col("pos") - size, F.lit(0))
    near = at.select("target", "doc", F.explode(F.concat(F.slice("tokens", lo + 1, F.col("pos") - lo), F.slice("tokens", F.col("pos") + 2, size))).alias("neighbour"))
    return near.groupBy("target", "neighbour").agg(F.count("*").alias("tf"), F.countDistinct("doc").alias("df"))


def dictionary_lookup(docs: DataFrame, dictionary: DataFrame, longest: int = 10) -> DataFrame:
    """(doc, start, end, term): dictionary terms in token arrays, longest first, then later ends, never overlapping.

    Tokens meet the dictionary (term) on a term's first two words (its only word), with the words that follow; the whole term is compared there. Hits that overlap, directly or through others,
    are one group, within which a fold picks them; so a document of many hits makes many small groups.
    """
    size = F.size("tokens")
    words = F.split("term", " ")
    known = dictionary.select("term").distinct().where(F.size(words) <= longest).select("term", F.size(words).alias("n"), F.array_join(F.slice(words, 1, 2), " ").alias("first"))
    at = docs.where(size > 0).select("doc", "tokens", F.posexplode("tokens").alias("start", "word"))
    pair = F.array_join(F.slice("tokens", F.col("start") + 1, 2), " ")
    at = at.select("doc", "start", "tokens", F.explode(F.array_distinct(F.array("word", pair))).alias("first"))
    at = at.join(known.select("first").distinct(), "first", "left_semi").select("doc", "start", "first", F.slice("tokens", F.col("start") + 1, longest).alias("next"))
    hits = at.join(known, "first").where((F.size("next") >= F.col("n")) & (F.array_join(F.slice("next", F.lit(1), F.col("n")), " ") == F.col("term")))
    hits = hits.select("doc", "start", (F.col("start") + F.col("n")).alias("end"), "term")
    sofar = F.max("end").over(Window.partitionBy("doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("new", (F.coalesce(sofar, F.lit(-1)) <= F.col("start")).cast("int"))
    hits = hits.withColumn("run", F.sum("new").over(Window.partitionBy("doc").orderBy("start", "end", "term").rowsBetween(Window.unboundedPreceding, 0)))
    order = F.array_sort(F.collect_list(F.struct((F.col("start") - F.col("end")).alias("o"), (-F.col("end")).alias("e"), "start", "end", "term")))
    free = lambda kept, x: ~F.exists(kept, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"]))
    pick = F.aggregate("h", F.slice("h", 1, 0), lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return hits.groupBy("doc", "run").agg(order.alias("h")).select("doc", F.explode(pick).alias("k")).select("doc", "k.start", "k.end", "k.term")


def feature_matches(rows: DataFrame, patterns: dict[str, dict[str, list[str]]]) -> DataFrame:
    """One row per row and pattern whose every named feature (of the map ``feats``) has one of its values."""
    found = [F.when(_all([F.array_contains(F.array(*[F.lit(v) for v in values]), F.col("feats")[name]) for name, values in p.items()]), F.lit(k)) for k, p in patterns.items()]
    return rows.withColumn("pattern", F.explode(F.array_compact(F.array(*found))))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def parse_feature_row(line: Column) -> Column:
    """Tab-separated id, year, term, name=value... as a struct with a map."""
    parts = F.split(line, "\t")
    pairs = F.filter(F.slice(parts, 4, 100_000), lambda x: x.contains("="))
    feats = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.split(x, "=", 2)[0].alias("k"), F.split(x, "=", 2)[1].alias("v"))))
    return F.struct(parts[0].alias("chunk_id"), parts[1].cast("int").alias("year"), parts[2].alias("term"), feats.alias("feats"))


# Tagged sentences.

SCHEMAS = {
    "en": {"start": {"JJ", "JJR", "NN", "NNS", "NNP", "NNPS", "VBN", "FW"}, "go": {"JJ", "JJR", "NN", "NNS", "NNP", "NNPS", "VBN", "VBG", "CD", "FW", "POS"}, "end": {"NN", "NNS", "NNP", "NNPS", "FW"}},
    "en_w_of": {"start": {"JJ", "NN", "NNS", "NNP", "NNPS", "VBN"}, "go": {"JJ", "NN", "NNS", "NNP", "NNPS", "VBN", "VBG", "CD", "of/IN"}, "end": {"NN", "NNS", "NNP", "NNPS"}},
}


def parse_chart(tagged: str) -> list[tuple[str, str]]:
    """token_TAG pairs; the tag follows the last underscore."""
    return [(t, g) for t, _, g in (x.rpartition("_") for x in tagged.split()) if t]


def _fits(tok: str, tag: str, allowed) -> bool:
    if not isinstance(allowed, set):
        return allowed.fits(tok, tag)
    return tag in allowed or f"{tok.lower()}/{tag}" in allowed


def chunk_chart(chart: list[tuple[str, str]], schema) -> list[tuple[int, int]]:
    """Spans of noun phrases (schema: sets of tags by place, or rules): begun by a start tag, continued, rolled back to the last legal end.

    A chunk still open at the end of the sentence isn't rolled back, and the token that closes a chunk is not tried as a start again.
    """
    out: list[tuple[int, int]] = []
    begin = legal = -1
    for i, (tok, tag) in enumerate(chart):
        if begin < 0:
            if _fits(tok, tag, schema["start"]):
                begin, legal = i, i if _fits(tok, tag, schema["end"]) else -1
        elif _fits(tok, tag, schema["go"]):
            if _fits(tok, tag, schema["end"]):
                legal = i
        else:
            if legal >= 0:
                out.append((begin, legal + 1))
            begin = legal = -1
    if begin >= 0:
        out.append((begin, len(chart)))
    return out


def phrase_features(chart: list[tuple[str, str]], start: int, end: int) -> dict[str, str]:
    """Context features of a phrase; leftward searches never see token 0."""
    toks, tags = [t for t, _ in chart], [g for _, g in chart]
    f: dict[str, str] = {}

    def put(name, value):
        if value:
            f[name] = value.lower().replace(" ", "_")

    pad = lambda i: toks[i] if 0 <= i < len(toks) else "^"
    for n in (1, 2, 3):
        put(f"prev_n{n}", "_".join(pad(i) for i in range(start - n, start)))
        put(f"next_n{n}", "_".join(pad(i) for i in range(end, end + n)))
    put("next2_tags", "_".join(tags[end : end + 2]))
    put("last_word", toks[end - 1])
    if end - start > 1:
        put("first_word", toks[start])
    for n, least in ((3, 6), (4, 7), (5, 8)):
        if len(toks[end - 1]) >= least:
            put(f"suffix{n}", toks[end - 1][-n:])
    put("plen", str(end - start))
    put("tag_sig", "_".join(tags[start:end]))
    i, prepositions = start - 1, []
    while i > 0:  # the governing verb, with up to two prepositions on the way
        if tags[i].startswith("VB"):
            put("prev_V", " ".join([toks[i], *reversed(prepositions)]))
            break
        if tags[i] in ("IN", "TO") and len(prepositions) < 2:
            prepositions.append(toks[i])
        elif tags[i].startswith("NN") or toks[i] == "," or (tags[i].startswith("JJ") and prepositions):
            break
        i -= 1
    for name, kind in (("prev_Npr", "NN"), ("prev_Jpr", "JJ")):
        for i in range(start - 1, max(0, start - 4), -1):
            if tags[i] == "IN" and i - 1 > 0 and tags[i - 1].startswith(kind):
                put(name, f"{toks[i - 1]} {toks[i]}")
                break
    for i in range(start - 1, max(0, start - 4), -1):
        if tags[i] == "IN" and i - 2 > 0 and tags[i - 1].startswith("NN") and tags[i - 2].startswith("VB"):
            put("prev_VNP", f"{toks[i - 2]} {toks[i - 1]} {toks[i]}")
            break
    if start > 1 and tags[start - 1].startswith("JJ"):
        put("prev_J", toks[start - 1])
    return f


_SUFFIX_TAGS = ((r"^\d[\d.,]*$", "CD"), (r"^[^\w]+$", "."), (r"ly$", "RB"), (r"ing$", "VBG"), (r"ed$", "VBN"), (r"(ous|ful|able|ible|ive|al|ic|ent|ant)$", "JJ"), (r"s$", "NNS"))
_CLOSED = {w: "DT" for w in "a an the this that these those".split()} | {w: "IN" for w in "of in on at for from by with as than".split()} | {"to": "TO"} | {w: "CC" for w in "and or but".split()} | {w: "VBZ" for w in "is are was were be has have had do does".split()} | {w: "PRP" for w in "it he she they we you i".split()}


def rule_tags(sentence: str) -> str:
    """A stand-in tagger: closed-class words, then suffixes, else a noun. Trained taggers fit in its place."""
    out = []
    for w in re.findall(r"\w+(?:[-']\w+)*|[^\w\s]", sentence):
        tag = _CLOSED.get(w.lower()) or next((t for p, t in _SUFFIX_TAGS if re.search(p, w.lower())), "NN")
        out.append(f"{w}_{tag}")
    return " ".join(out)


def parts(batches: Iterator[pd.DataFrame], rows: int = 128) -> Iterator[pd.DataFrame]:
    """Batches in parts of so many rows, so that what is made of a part stays small."""
    for b in batches:
        for a in range(0, len(b), rows):
            yield b.iloc[a : a + rows]


def phrase_occurrences(docs: DataFrame, schema: str = "en", tagger=rule_tags) -> DataFrame:
    """(doc, sentence, start, end, term, feats): noun phrases of docs (doc, text) with their context features; Arrow batches of whole documents."""
    rules = SCHEMAS[schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts(batches):
            rows = []
            for doc, text in zip(b["doc"], b["text"]):
                for k, s in enumerate(re.split(r"(?<=[.?!])\s+", text or "")):
                    chart = parse_chart(tagger(s))
                    for a, e in chunk_chart(chart, rules):
                        rows.append((doc, k, a, e, " ".join(t for t, _ in chart[a:e]).lower(), phrase_features(chart, a, e)))
            yield pd.DataFrame(rows, columns=["doc", "sentence", "start", "end", "term", "feats"])

    return docs.select("doc", "text").mapInPandas(run, "doc long, sentence int, start int, end int, term string, feats map<string,string>")


_ABBREVIATIONS = {"e.g", "i.e", "fig", "figs", "no", "nos", "dr", "mr", "mrs", "vs", "etc", "al", "inc", "co", "ltd", "pat", "ref", "vol"}
_CONTRACTION = re.compile(r"^(.+?)(n't|'(?:t|d|s|m|re|ll|ve))$", re.IGNORECASE)


def tokenize(text: str) -> list[tuple[int, int, str]]:
    """(start, end, token) with punctuation apart, abbreviations kept and contractions split."""
    out = []
    for m in re.finditer(r"\S+", text):
        a, b = m.span()
        tail = []
        while a < b and not text[a].isalnum() and text[a] not in "-+#":
            out.append((a, a + 1, text[a]))
            a += 1
        while b > a and not text[b - 1].isalnum() and text[b - 1] not in "-+#%":
            core = text[a : b - 1]
            if text[b - 1] == "." and (core.lower() in _ABBREVIATIONS or re.fullmatch(r"(?:[A-Za-z]\.)*[A-Za-z]", core)):
                break
            tail.append((b - 1, b, text[b - 1]))
            b -= 1
        if a < b:
            c = _CONTRACTION.match(text[a:b])
            if c:
                out += [(a, a + len(c[1]), c[1]), (a + len(c[1]), b, c[2])]
            else:
                out.append((a, b, text[a:b]))
        out += reversed(tail)
    return out


def token_rows(docs: DataFrame) -> DataFrame:
    """(doc, start, end, token) of docs (doc, text)."""

    def run(batches):
        for b in parts(batches):
            rows = [(doc, *t) for doc, text in zip(b["doc"], b["text"]) for t in tokenize(text or "")]
            yield pd.DataFrame(rows, columns=["doc", "start", "end", "token"])

    return docs.select("doc", "text").mapInPandas(run, "doc long, start int, end int, token string")


def context_matches(rows: DataFrame, left: Column, right: Column, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per row and pattern (side, expression) that a word of its context on that side fits; patterns are a short list of expressions."""
    fits = lambda words, expression: F.exists(words, lambda w: w.rlike(expression))
    found = [F.when(fits(left if side == "l" else right, expression), F.lit(name)) for name, (side, expression) in patterns.items()]
    return rows.withColumn("pattern", F.explode(F.array_compact(F.array(*found))))


def phrase_patterns(phrase: Column, patterns: dict[str, list[str]]) -> Column:
    """Names of the patterns all of whose expressions a phrase fits, with the parts that fit."""
    one = lambda name, parts: F.when(_all([phrase.rlike(p) for p in parts]), F.struct(F.lit(name).alias("pattern"), F.array(*[F.regexp_extract(phrase, p, 0) for p in parts]).alias("parts")))
    return F.array_compact(F.array(*[one(n, p) for n, p in patterns.items()]))


def running_groups(lines: DataFrame, file: str, order: str, begins: Column) -> DataFrame:
    """Lines with ``g``, the number of group heads up to each line of its file."""
    return lines.withColumn("g", F.sum(begins.cast("int")).over(Window.partitionBy(file).orderBy(order)).cast("int"))


# Chunk rules of several languages.


class Rules:
    """Tags that a chunk may begin with, go on with or end with; a tag may be bound to words (+), barred from words (-), or from a list of noise words (n)."""

    def __init__(self, rows: list[tuple[str, str, str, tuple[str, ...]]], noise: frozenset[str] = frozenset()):
        self.by_place: dict[str, dict[str, list[tuple[str, tuple[str, ...]]]]] = {"start": {}, "go": {}, "end": {}}
        self.noise = noise
        for place, tag, kind, words in rows:
            self.by_place[place].setdefault(tag, []).append((kind, words))

    def fits(self, place: str, tok: str, tag: str) -> bool:
        low = tok.lower()
        for kind, words in self.by_place[place].get(tag, ()):
            if kind == "" or kind == "+" and low in words or kind == "-" and low not in words or kind == "n" and low not in self.noise:
                return True
        return False

    def __getitem__(self, place: str):
        return _Place(self, place)


class _Place:
    def __init__(self, rules: Rules, place: str):
        self.rules, self.place = rules, place

    def fits(self, tok: str, tag: str) -> bool:
        return self.rules.fits(self.place, tok, tag)


_PLACES = {"start_pat": ("start",), "cont_pat": ("go",), "end_pat": ("end",)}


def parse_rules(lines: list[str], noise: frozenset[str] = frozenset()) -> Rules:
    """Rules of lines ``place TAB tag [kind word ...]``; blank lines go, an unknown place is an error."""
    rows = []
    for line in lines:
        if not line.strip():
            continue
        place, _, rest = line.strip().partition("\t")
        if place not in _PLACES:
            raise ValueError(f"no such place in a rule: {place}")
        tag, *constraint = rest.split()
        rows += [(p, tag, constraint[0] if constraint else "", tuple(constraint[1:])) for p in _PLACES[place]]
    return Rules(rows, noise)


def _rows(places: str, tags: str, kind: str = "", words: tuple[str, ...] = ()) -> list[tuple[str, str, str, tuple[str, ...]]]:
    return [(p, t, kind, words) for p in places.split() for t in tags.split()]


_NOUNS = "NN NNS NNP NNPS"
_ENGLISH = [*_rows("start go", "NNS NNPS POS"), *_rows("start go", "NN NNP", "-", ("fig", "figure")), *_rows("start go", "JJ", "n"), *_rows("start go", "JJR", "-", ("more",)), *_rows("start go", "JJS", "-", ("most",)), *_rows("start go", "FW", "-", ("e.g.", "i.e")), *_rows("end", _NOUNS)]
_VERBS = [*_rows("start end", "VBG", "n"), *_rows("go", "VBG", "n"), *_rows("go", "VBN DT RP")]


def rule_sets(noise: frozenset[str] = frozenset()) -> dict[str, Rules]:
    """Rule sets by name; ``noise`` are adjectives and verbs that don't belong to terms (a word list of the caller)."""
    return {
        "en": Rules([*_ENGLISH, *_rows("go", "NN")], noise),
        "en_with_of": Rules([*_ENGLISH, *_rows("go", "NN VBN DT RP"), *_rows("go", "IN", "+", ("of",))], noise),
        "en_with_verbs": Rules([*_ENGLISH, *_rows("go", "NN"), *_VERBS], noise),
        "en_with_lists": Rules([*_rows("start go", _NOUNS + " POS"), *_rows("start go", "JJ", "n"), *_rows("start go", "JJR", "-", ("more",)), *_rows("start go", "JJS", "-", ("most",)), *_rows("start go", "FW", "-", ("e.g.", "i.e")), *_rows("end", _NOUNS), *_VERBS], noise),
        "en_with_of_and_lists": Rules([*_rows("start go", _NOUNS + " POS JJS"), *_rows("start go", "JJ", "n"), *_rows("start go", "JJR", "-", ("more",)), *_rows("start go", "FW", "-", ("e.g.", "i.e")), *_rows("end", _NOUNS), *_VERBS, *_rows("go", "CC"), *_rows("go", "IN", "+", ("of",))], noise),
        "de": Rules([*_rows("start go", "NN NE ADJA"), *_rows("go", "APPR", "+", ("von",)), *_rows("go", "ART", "+", ("des", "der")), *_rows("end", "NN NE")], noise),
        "cn": Rules([*_rows("start go", "NN NR NT JJ VA"), *_rows("go", "DEG DEC"), *_rows("end", "NN")], noise),
    }


def _common(chart, start, end):
    f = phrase_features(chart, start, end)
    return {k: v for k, v in f.items() if not k.startswith("prev_V") and k not in ("prev_Npr", "prev_Jpr", "prev_J")}


def _left(chart, start, stop, limit, barred=lambda g: False):
    """The nearest token left of a phrase (never token 0) whose tag ``stop`` takes, within a distance and up to a barred tag."""
    for i in range(start - 1, max(0, start - 1 - limit), -1):
        if stop(chart[i][1]):
            return chart[i][0].lower()
        if barred(chart[i][1]):
            break
    return ""


def german_features(chart: list[tuple[str, str]], start: int, end: int) -> dict[str, str]:
    """Features of a German phrase: nearest verb (no copula, none beyond a noun), noun within three words, leading adjective or verb, adjective before, head before a preposition, preposition after."""
    tags, low = [g for _, g in chart], [t.lower() for t, _ in chart]
    f = _common(chart, start, end)
    preposition = next((i for i in range(start, end) if tags[i] == "APPR"), -1)
    lead = low[start] if tags[start] == "ADJA" else ""
    own = {
        "prev_V": _left(chart, start, lambda g: g.startswith("V") and g != "VAINF", len(chart), lambda g: g.startswith("N")),
        "prev_N": _left(chart, start, lambda g: g.startswith("N"), 3),
        "chunk_lead_J": lead,
        "initial_J": lead,
        "initial_V": low[start] if tags[start].startswith("V") else "",
        "prev_J": low[start - 1] if start > 0 and tags[start - 1] == "ADJA" else "",
        "von_head": low[preposition - 1] if preposition > 0 else "",
        "following_prep": low[end] if end < len(chart) and tags[end] == "IN" else "",
    }
    return f | {k: v for k, v in own.items() if v}


def chinese_features(chart: list[tuple[str, str]], start: int, end: int) -> dict[str, str]:
    """Features of a Chinese phrase: noun within three words, nearest verb before a noun, first and last adjective in it (the last one under the name prev_J), measure word and determiner before it."""
    tags, low = [g for _, g in chart], [t.lower() for t, _ in chart]
    adjectives = [low[i] for i in range(start, end) if tags[i] in ("JJ", "VA")]
    measure = next((i for i in range(start - 1, 0, -1) if tags[i] == "M"), -1)
    own = {
        "prev_N": _left(chart, start, lambda g: g == "NN", 3),
        "prev_V": _left(chart, start, lambda g: g.startswith("V"), len(chart), lambda g: g.startswith("N")),
        "first_Adj": adjectives[0] if adjectives else "",
        "prev_J": adjectives[-1] if adjectives else "",
        "prev_CD_M": "" if measure < 0 else low[measure] + ("_" + low[measure - 1] if measure > 1 else ""),
        "prev_DT": _left(chart, start, lambda g: g == "DT", 3),
    }
    return _common(chart, start, end) | {k: v for k, v in own.items() if v}


def head_index(chart: list[tuple[str, str]], start: int, end: int) -> int:
    """Place of a phrase's head: the word before the first preposition, article or conjunction in it, else its last."""
    return next((i for i in range(start, end) if chart[i][1] in ("IN", "DT", "CC") and i > start), end) - 1


def prepositional_head(chart: list[tuple[str, str]], start: int, end: int) -> int:
    """Place of the head of the prepositional phrase inside a phrase: its last word; -1 without a preposition."""
    return end - 1 if any(chart[i][1] in ("IN", "APPR") for i in range(start + 1, end)) else -1


#: What each language needs: rules and features.
LANGUAGES = {"en": ("en", phrase_features), "de": ("de", german_features), "cn": ("cn", chinese_features)}


def tagged_phrases(sentences: DataFrame, lang: str = "en", noise: frozenset[str] = frozenset(), sections: tuple[str, ...] = ()) -> DataFrame:
    """The document driver: feature rows (chunk_id, doc, year, section, sent_no, term, feats) of tagged sentences.

    Sentences are (doc, year, section, sent_no, sent_in_section, tokens array<struct<tok,tag>>). Sentences are cut independently of each other; chunk ids number the phrases
    of a sentence. Features are those of the language, with the section's place as ``section_loc``.
    """
    rules, features = LANGUAGES[lang]
    schema = rule_sets(noise)[rules]
    own = sentences.where(F.col("section").isin(*sections)) if sections else sentences

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts(batches, 4096):
            rows = []
            for doc, year, section, no, at, tokens in zip(b["doc"], b["year"], b["section"], b["sent_no"], b["sent_in_section"], b["tokens"]):
                chart = [(t["tok"], t["tag"]) for t in (tokens if tokens is not None else ()) if t["tok"]]
                for k, (a, e) in enumerate(chunk_chart(chart, schema)):
                    feats = features(chart, a, e) | {"section_loc": f"{section}_{'sent1' if at == 0 else 'later'}"}
                    rows.append((f"{doc}_{no}_{k}", doc, year, section, no, " ".join(t for t, _ in chart[a:e]).lower(), feats))
            yield pd.DataFrame(rows, columns=["chunk_id", "doc", "year", "section", "sent_no", "term", "feats"])

    return own.select("doc", "year", "section", "sent_no", "sent_in_section", "tokens").mapInPandas(run, "chunk_id string, doc string, year int, section string, sent_no int, term string, feats map<string,string>")


def chinese_pieces(text: Column, longest: int = 500) -> Column:
    """What a segmenter gets of a section: its lines joined, cut at the full stop, without wide and hard blanks; pieces that are too long go."""
    joined = F.regexp_replace(F.regexp_replace(text, r"[\r\n]+", ""), "[　 ]", "")
    return F.filter(F.split(F.regexp_replace(joined, "。", "。\n"), "\n"), lambda p: (p != "") & (F.length(p) <= longest))


def fixed_parens(tagged: Column) -> Column:
    """Parentheses of a tagged line get the tag of punctuation."""
    return F.regexp_replace(tagged, r"(^|\s)([()（）])_[A-Z]+(?=\s|$)", "$1$2_PU")


def external_tagger(command: list[str]):
    """A tagger that pipes each sentence through a program which answers line by line; started once a worker process."""
    import subprocess

    held: list = []

    def tag(sentence: str) -> str:
        if not held:
            held.append(subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, bufsize=1))
        p = held[0]
        p.stdin.write(sentence.replace("\n", " ") + "\n")
        p.stdin.flush()
        return p.stdout.readline().rstrip("\n")

    return tag


def sentence_ends(tokens: list[str], openers: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """(start, end) of sentences of a token list: they end at . ? or ! with the closing marks behind it, or at an abbreviation before a known first token; what follows the last is none."""
    out, begin, i = [], 0, 0
    while i < len(tokens):
        t = tokens[i]
        if t in (".", "?", "!") or (t.endswith(".") and len(t) > 1 and i + 1 < len(tokens) and tokens[i + 1] in openers):
            i += 1
            while i < len(tokens) and tokens[i] in (")", "]", '"', "'", "”", "’"):
                i += 1
            out.append((begin, i))
            begin = i
        else:
            i += 1
    return out


def trie_lookup(docs: DataFrame, terms: list[str], boundaries: bool = True) -> DataFrame:
    """(doc, term, n): the longest terms found from left to right in fragments of texts, at word boundaries unless told otherwise.

    ``terms`` is a list that fits a worker (a trie is built from it once a process); larger dictionaries go through :func:`dictionary_lookup`."""
    from termloom.functions.forms import fragments

    held: list = []

    def run(batches):
        import ahocorasick

        if not held:
            a = ahocorasick.Automaton()
            for t in terms:
                a.add_word(t, t)
            a.make_automaton()
            held.append(a)
        for b in batches:
            rows = []
            for doc, parts in zip(b["doc"], b["parts"]):
                counts: dict[str, int] = {}
                for text in parts if parts is not None else ():
                    at: dict[int, str] = {}
                    for e, t in held[0].iter(text):
                        s = e + 1 - len(t)
                        if boundaries and (s > 0 and text[s - 1].isalnum() or e + 1 < len(text) and text[e + 1].isalnum()):
                            continue
                        if len(t) > len(at.get(s, "")):
                            at[s] = t
                    free = 0
                    for s in sorted(at):
                        if s >= free:
                            counts[at[s]] = counts.get(at[s], 0) + 1
                            free = s + len(at[s])
                rows += [(doc, t, n) for t, n in counts.items()]
            yield pd.DataFrame(rows, columns=["doc", "term", "n"])

    return docs.select("doc", fragments(F.col("text")).alias("parts")).mapInPandas(run, "doc long, term string, n long")
