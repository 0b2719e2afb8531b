"""Text expressions: tokenizers, rendering, reply parsing and question classes. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once: a lambda's variable is a value, an expression repeated in f would run again."""
    return F.transform(F.array(x), lambda v: f(v))[0]


def strip(x: Column | str) -> Column:
    """Trim white space of any kind, not spaces alone."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def metric_tokens(x: Column | str) -> Column:
    """Lower-cased words; . , ! ? count as spaces and nothing else is taken off."""
    return F.filter(F.split(F.translate(F.lower(_c(x)), ".,!?", "    "), r"\s+"), lambda t: t != "")


def index_tokens(x: Column | str) -> Column:
    """Runs of letters, digits and underscores, case kept."""
    return F.regexp_extract_all(_c(x), F.lit(f"({WORD})"), 1)


#: What the published Treebank rules split, in their order. A period ends a sentence at the text's end and before a
#: capital, so no sentence splitter is needed; those inside (U.S., 3.88) stay.
TREEBANK = (
    (r'\A"', "`` "), (r'([ (\[{<])"', "$1`` "), (r"(\.{2,})", " $1 "),
    (r"""([^. \t\n\f\r])\.([\])}>"'»”’]*)([ \t\n\f\r]+[\p{Lu}"'“(]|[ \t\n\f\r]*\z)""", "$1 . $2$3"),
    (r"([:,])([^0-9])", " $1 $2"), (r"([:,])\z", " $1 "), (r"([;@#$%&*?!\[\](){}<>])", " $1 "), (r"--", " -- "), (r"\A|\z", " "),
    (r'"', " '' "), (r"([«»“”„‘’])", " $1 "), (r"([^' ])('[sSmMdD]|') ", "$1 $2 "), (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "), (r" ", "  "),
    (r"(?i) (can)(not) ", " $1 $2 "), (r"(?i) (d)('ye) ", " $1 $2 "), (r"(?i) (gim|lem)(me) ", " $1 $2 "), (r"(?i) (gon|wan)(na) ", " $1 $2 "), (r"(?i) (got)(ta) ", " $1 $2 "),
    (r"(?i) (more)('n) ", " $1 $2 "), (r"(?i) ('t)(is|was) ", " $1 $2 "),
)


def treebank_tokens(x: Column | str) -> Column:
    """Treebank words: contractions, quotes, brackets and final periods are tokens. Null gives null, no word an empty array."""
    out = _c(x)
    for pattern, new in TREEBANK:
        out = F.regexp_replace(out, pattern, new)
    return F.filter(F.split(out, r"[ \t\n\f\r]+"), lambda t: t != "")


def utterance(speaker: Column | str, text: Column | str) -> Column:
    return F.concat(F.lit("Speaker "), _c(speaker), F.lit(" says: "), _c(text))


def joined(x: Column | str) -> Column:
    return F.array_join(F.coalesce(_c(x), F.array().cast("array<string>")), ", ")


def index_document(content: Column | str, context: Column | str, keywords: Column | str, tags: Column | str) -> Column:
    """What the index holds of a node; missing parts are empty, the labels stay."""
    part = lambda x: F.coalesce(_c(x), F.lit(""))
    return F.concat(F.lit("content: "), part(content), F.lit(" context: "), part(context), F.lit(" keywords: "), joined(keywords), F.lit(" tags: "), joined(tags))


def note_document(content: Column | str, context: Column | str, keywords: Column | str, tags: Column | str) -> Column:
    """The shorter rendering used when an index is made from notes in memory."""
    return F.concat(_c(content), F.lit(" , "), _c(context), F.lit(" "), joined(keywords), F.lit(" "), joined(tags))


def top_terms(x: Column | str, n: int) -> Column:
    """The n most frequent lower-cased index tokens, ties by name."""

    def best(words: Column) -> Column:
        counted = F.transform(F.array_distinct(words), lambda t: F.struct((-F.size(F.filter(words, lambda w: w == t))).alias("n"), t.alias("t")))
        return F.transform(F.slice(F.array_sort(counted), 1, n), lambda s: s["t"])

    return let(index_tokens(F.lower(_c(x))), best)


def first_sentence(x: Column | str) -> Column:
    return F.regexp_extract(_c(x), r"^([^.]*)", 1)


def hash_embedding(x: Column | str, dims: int = 16) -> Column:
    """The offline embedder: how many index tokens fall to each of 16 buckets, by the first hex digit of their md5."""

    def count(hexes: Column, digit: str) -> Column:
        return F.size(F.filter(hexes, lambda h: h == digit)).cast("double")

    hexes = F.transform(index_tokens(x), lambda t: F.substring(F.md5(t), 1, 1))
    return let(hexes, lambda h: F.array(*[count(h, d) for d in "0123456789abcdef"[:dims]]))


# -- replies ---------------------------------------------------------------------------------------------------------

# Fences a reply may wrap its JSON in, answer fields and prefixes, and leading auxiliaries.
FENCED_JSON = r"(?s)```json\s*(\{.*\})\s*```"
FENCED = r"(?s)```\s*(\{.*\})\s*```"
BRACES = r"(?s)\{.*\}"
ANSWER_FIELDS = ("answer", "short_answer", "prediction", "result", "content")
ANSWER_PREFIX = "(?i)^(Answer:|Short answer:|The answer is|Prediction:)"
AUXILIARIES = ("is ", "are ", "do ", "does ", "did ", "can ", "could ", "would ", "will ", "should ")


def _found(x: Column, pattern: str, group: int) -> Column:
    got = F.regexp_extract(x, pattern, group)
    return F.when(got != "", got)


def json_text(x: Column | str, otherwise: Column | None = None) -> Column:
    """The JSON object in a reply: fenced as json, fenced, else from the first to the last brace, else `otherwise`
    (default: the reply itself)."""
    x = _c(x)
    return F.coalesce(_found(x, FENCED_JSON, 1), _found(x, FENCED, 1), _found(x, BRACES, 0), x if otherwise is None else otherwise)


def json_object(x: Column | str) -> Column:
    """json_text() if it parses, else the empty object."""
    got = json_text(x)
    return F.when(F.try_parse_json(got).isNotNull(), got).otherwise(F.lit("{}"))


def literal_repair(x: Column | str) -> Column:
    """Python's literals after a colon turned into JSON's."""
    out = _c(x)
    for a, b in ((": True", ": true"), (": False", ": false"), (": None", ": null")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unfenced(x: Column | str) -> Column:
    x = strip(x)
    return F.coalesce(_found(x, FENCED_JSON, 1), _found(x, FENCED, 1), x)


def answer_pick(x: Column | str) -> Column:
    """The answer in a reply: its first present answer field, else its first value, else the whole; bad JSON as it is."""
    body = unfenced(x)
    ok = F.try_parse_json(body).isNotNull()
    values = F.map_values(F.from_json(body, "map<string,string>"))
    named = F.coalesce(*[F.get_json_object(body, f"$.{k}") for k in ANSWER_FIELDS], F.get(values, F.lit(0)))
    return F.when(ok & body.startswith("{"), F.when(F.coalesce(named, F.lit("")) != "", named).otherwise(body)).when(ok, body).otherwise(strip(x))


def answer_clean(x: Column | str) -> Column:
    """Without the first matching prefix and a pair of quotes around; what becomes empty stays as it was."""
    x = _c(x)
    cut = F.when(x.rlike(ANSWER_PREFIX), strip(F.regexp_replace(x, ANSWER_PREFIX, ""))).otherwise(x)
    bare = F.when((F.length(cut) >= 2) & cut.startswith('"') & cut.endswith('"'), F.substring(cut, F.lit(2), F.length(cut) - 2)).otherwise(cut)
    return F.when(bare == "", strip(x)).otherwise(bare)


def unwrap_answer(x: Column | str) -> Column:
    """A prediction that is a JSON object itself gives its answer field."""
    x = _c(x)
    return F.when(strip(x).startswith("{"), F.coalesce(F.get_json_object(strip(x), "$.answer"), x)).otherwise(x)


def question_class(question: Column | str, category: Column | str) -> Column:
    """choice, yes_no, count or open; which are told apart, and in what order, depends on the category."""
    q, c = F.lower(_c(question)), _c(category)
    yes_no = q.rlike("^(" + "|".join(AUXILIARIES) + ")")
    choice, count = q.contains(" or ") & q.contains("?"), q.rlike("^how (many|much)")
    return (
        F.when((c == 3) & choice, "choice").when(c.isin(1, 3) & yes_no, "yes_no").when((c == 1) & count, "count").otherwise("open")
    )


def category_k(category: Column | str) -> Column:
    """How many memories a question of each category is answered from."""
    c = _c(category)
    return F.when(c.isin(2, 4), 25).when(c == 3, 30).otherwise(35)


def dimension_label(x: Column | str) -> Column:
    return F.initcap(F.replace(_c(x), F.lit("_"), F.lit(" ")))


def model_slug(x: Column | str) -> Column:
    return F.translate(_c(x), "/:", "__")


def preview(x: Column | str, n: int = 60) -> Column:
    x = _c(x)
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def context_line(index: Column | str, level: Column | str, time: Column | str, tags: Column | str, content: Column | str) -> Column:
    """One memory as prompts show it."""
    return F.concat(
        F.lit("[Index: "), _c(index).cast("string"), F.lit("] ["), F.upper(_c(level)), F.lit("] [Time: "), F.coalesce(_c(time), F.lit("Unknown Time")), F.lit("] ["), joined(tags), F.lit("]\n"), F.coalesce(_c(content), F.lit("")), F.lit("\n\n")
    )
