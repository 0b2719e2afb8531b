"""Porter's stemmer over arrays of words, as column expressions.

Each step is one transform() over the array, so nothing is shuffled and no Python worker is used. Inside, a consonant y is
written Y: whether a y is a vowel depends on what stands before it alone, so it is settled once and every condition on a
stem's measure is a regular expression. Null arrays give null, null words null; words are taken as lower-cased.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The published suffix rules of steps 2 to 4, with the usual later additions (bli, fulli, logi).
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
#: Words with a stem of their own.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning",
    "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

_V, _C = "[aeiouy]", "[^aeiouy]"
VOWEL = _V
OVER_0 = f"^{_C}*{_V}+{_C}"
OVER_1 = f"^{_C}*{_V}+{_C}+{_V}+{_C}"
IS_1 = f"^{_C}*{_V}+{_C}+{_V}*$"
#: Consonant, vowel, consonant but w, x and y; or a word of a vowel and a consonant.
SHORT = f"({_C}{_V}[^aeiouywxY]|^{_V}{_C})$"


def _cut(w: Column, n: int | Column) -> Column:
    return F.substring(w, F.lit(1), F.greatest(F.length(w) - n, F.lit(0)))


def _marked(w: Column) -> Column:
    return F.replace(F.regexp_replace(F.lower(w), "(^|[aeiou])y", "$1Y"), F.lit("yy"), F.lit("yY"))


def _plurals(w: Column) -> Column:
    return F.when(w.rlike("^.ies$"), _cut(w, 1)).when(w.rlike("(ss|i)es$"), _cut(w, 2)).when(w.endswith("ss"), w).when(w.endswith("s"), _cut(w, 1)).otherwise(w)


def _restored(x: Column) -> Column:
    """What is left after -ed or -ing, with its e or without its second consonant."""
    last = F.right(x, F.lit(1))
    double = x.rlike(f"{_C}$") & (F.length(x) > 1) & (F.lower(last) == F.lower(F.right(_cut(x, 1), F.lit(1))))
    return F.when(x.rlike("(at|bl|iz)$"), F.concat(x, F.lit("e"))).when(double, F.when(last.isin("l", "s", "z"), x).otherwise(_cut(x, 1))).when(x.rlike(IS_1) & x.rlike(SHORT), F.concat(x, F.lit("e"))).otherwise(x)


def _past(w: Column) -> Column:
    ied = F.when(F.length(w) == 4, _cut(w, 1)).otherwise(_cut(w, 2))
    eed = F.when(_cut(w, 3).rlike(OVER_0), _cut(w, 1)).otherwise(w)
    out = F.when(w.endswith("ied"), ied).when(w.endswith("eed"), eed)
    for suffix in ("ed", "ing"):
        stem = _cut(w, len(suffix))
        out = out.when(w.endswith(suffix) & stem.rlike(VOWEL), _restored(stem))
    return out.otherwise(w)


def _last_y(w: Column) -> Column:
    return F.when(w.rlike("^..+y$"), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _ally(w: Column) -> Column:
    return F.when(w.endswith("alli") & _cut(w, 4).rlike(OVER_0), _cut(w, 2)).otherwise(w)


def _by_suffix(rules: dict[str, str], measure: str):
    """The longest suffix of the rules is replaced if what stands before it has the measure."""
    ends = F.create_map(*[F.lit(x) for rule in rules.items() for x in rule])

    def step(w: Column) -> Column:
        suffix = F.regexp_extract(w, f"({'|'.join(rules)})$", 1)
        stem = _cut(w, F.length(suffix))
        ok = F.when(suffix == "logi", _cut(w, 3)).otherwise(stem).rlike(measure) & ((suffix != "ion") | stem.rlike("[st]$"))
        return F.when((suffix != "") & ok, F.concat(stem, ends[suffix])).otherwise(w)

    return step


def _last_e(w: Column) -> Column:
    x = _cut(w, 1)
    return F.when(w.endswith("e") & (x.rlike(OVER_1) | (x.rlike(IS_1) & ~x.rlike(SHORT))), x).otherwise(w)


def _last_l(w: Column) -> Column:
    return F.when(w.endswith("ll") & _cut(w, 1).rlike(OVER_1), _cut(w, 1)).otherwise(w)


def stems(words: Column, longer_than: int = 2) -> Column:
    """The stem of each word of an array; words of `longer_than` letters or fewer stay."""
    steps = (_marked, _plurals, _past, _last_y, _ally, _by_suffix(STEP2, OVER_0), _by_suffix(STEP3, OVER_0), _by_suffix(dict.fromkeys(STEP4, ""), OVER_1), _last_e, _last_l)
    cut = reduce(lambda array, step: F.transform(array, step), steps, words)
    own = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    return F.zip_with(words, cut, lambda w, s: F.when(F.length(w) <= longer_than, w).otherwise(F.coalesce(own[F.lower(w)], F.lower(s))))


def rouge_tokens(x: Column | str) -> Column:
    """Lower-cased runs of ASCII letters and digits, those of over three letters by their stem."""
    return stems(F.regexp_extract_all(F.lower(F.col(x) if isinstance(x, str) else x), F.lit("([a-z0-9]+)"), 1), 3)
