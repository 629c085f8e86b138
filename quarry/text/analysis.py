"""Text analysis as Column expressions: character filters, a tokenizer, token filters. Only stemming needs Python, Arrow-batched."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words. Fixed values.
STOP = frozenset(
    "a an and are as at be but by can could did do does for had has have he her him his how i if in into is it its may me my no nor not of on or our own she should so some such than that the their then there these they this to too us very was we were what when which who whom why will with would you your".split()
)


# --- character filters -------------------------------------------------------------------------------------------------------


def html_strip(c: Column) -> Column:
    out = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for name, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(ch))
    return out


def mapping(pairs: dict[str, str]) -> Callable[[Column], Column]:
    def apply(c: Column) -> Column:
        for a, b in pairs.items():
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    return apply


def pattern_replace(pattern: str, to: str = "") -> Callable[[Column], Column]:
    return lambda c: F.regexp_replace(c, pattern, to)


# --- tokenizers: text -> array<string> ------------------------------------------------------------------------------------------


def whitespace(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def standard(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+)"), 1)


def letter(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"([a-zA-Z]+)"), 1)


def pattern(regex: str = r"\W+") -> Callable[[Column], Column]:
    return lambda c: F.filter(F.split(c, regex), lambda t: t != "")


def keyword(c: Column) -> Column:
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.array(c))


def ngrams(token: Column, lo: int, hi: int) -> Column:
    """All substrings of lo..hi characters, shorter first, in order."""
    n = F.char_length(token)
    sizes = F.filter(F.sequence(F.lit(lo), F.lit(hi)), lambda k: k <= n)
    return F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(token, i, k))))


def ngram(lo: int = 1, hi: int = 2) -> Callable[[Column], Column]:
    return lambda c: F.flatten(F.transform(whitespace(c), lambda t: ngrams(t, lo, hi)))


# --- token filters: array<string> -> array<string> ---------------------------------------------------------------------------


def lowercase(c: Column) -> Column:
    return F.transform(c, F.lower)


def stop(words: Iterable[str] = STOP) -> Callable[[Column], Column]:
    own = sorted(words)
    return lambda c: F.filter(c, lambda t: ~t.isin(own))


def length(lo: int = 0, hi: int = 0) -> Callable[[Column], Column]:
    return lambda c: F.filter(c, lambda t: (F.char_length(t) >= lo) & (F.lit(True) if hi <= 0 else F.char_length(t) <= hi))


def edge_ngram(lo: int = 1, hi: int = 20) -> Callable[[Column], Column]:
    one = lambda t: F.transform(F.filter(F.sequence(F.lit(lo), F.lit(hi)), lambda k: k <= F.char_length(t)), lambda k: F.substring(t, F.lit(1), k))
    return lambda c: F.flatten(F.transform(c, one))


def ngram_filter(lo: int = 2, hi: int = 3, keep_short: bool = False) -> Callable[[Column], Column]:
    def one(t: Column) -> Column:
        grams = ngrams(t, lo, hi)
        return F.when(F.char_length(t) < lo, F.array(t)).otherwise(grams) if keep_short else grams

    return lambda c: F.flatten(F.transform(c, one))


def synonyms(groups: dict[str, list[str]]) -> Callable[[Column], Column]:
    """Each token, then its synonyms."""
    if not groups:
        return lambda c: c
    table = F.create_map(*[x for k, v in groups.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return lambda c: F.flatten(F.transform(c, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>")))))


def parse_synonyms(text: str) -> dict[str, list[str]]:
    """Lines ``a, b, c`` (each stands for all) and ``a, b => c`` (left becomes right beside itself); # starts a comment."""
    out: dict[str, list[str]] = {}
    for line in (x.split("#")[0].strip() for x in text.splitlines()):
        if not line:
            continue
        left, arrow, right = line.partition("=>")
        own = [w.strip() for w in left.split(",") if w.strip()]
        to = [w.strip() for w in right.split(",") if w.strip()] if arrow else own
        for w in own:
            out.setdefault(w, []).extend(x for x in to if x != w and x not in out.get(w, []))
    return out


def _plain(t: str) -> str:
    return t if t.isascii() else "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch))


def _folded(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda ts: None if ts is None else [None if t is None else _plain(t) for t in ts])


def ascii_fold(c: Column) -> Column:
    """Compatibility decomposition without marks; letters that have no plain form stay. Tokens that are ASCII already stay in the JVM."""
    return F.when(F.exists(c, lambda t: t.rlike("[^\\x00-\\x7f]")), F.pandas_udf(_folded, "array<string>")(c)).otherwise(c)


_VOWEL = re.compile(r"[aeiou]|(?<=[^aeiou])y")
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"]


def _shape(w: str) -> str:
    """v for vowels and c for consonants; y is a vowel after a consonant."""
    out = ""
    for k, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _cvc(w: str) -> bool:
    return _shape(w).endswith("cvc") and w[-1] not in "wxy"


def porter(w: str) -> str:
    """Porter's stemmer of 1980."""
    if len(w) <= 2 or not re.fullmatch(r"[a-z]+", w):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = ""
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        cut = w[:-3]
    if cut:
        if cut.endswith(("at", "bl", "iz")):
            w = cut + "e"
        elif len(cut) > 1 and cut[-1] == cut[-2] and cut[-1] not in "aeioulsz":
            w = cut[:-1]
        else:
            w = cut + "e" if _measure(cut) == 1 and _cvc(cut) else cut
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, to in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                w = w[: -len(end)] + to if _measure(w[: -len(end)]) > 0 else w
                break
    for end in _STEP4:
        if w.endswith(end):
            rest = w[: -len(end)]
            if _measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
                w = rest
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def _stem(tokens: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return tokens.map(lambda ts: None if ts is None else [known[t] if t in known else known.setdefault(t, porter(t)) for t in ts])


def porter_stem(c: Column) -> Column:
    # Made at use: the workers import this module without a session.
    return F.pandas_udf(_stem, "array<string>")(c)


@dataclass(frozen=True)
class Analyzer:
    tokenizer: Callable[[Column], Column] = standard
    filters: tuple[Callable[[Column], Column], ...] = ()
    chars: tuple[Callable[[Column], Column], ...] = field(default=())

    def __call__(self, c: Column) -> Column:
        c = F.coalesce(c, F.lit(""))
        for f in self.chars:
            c = f(c)
        c = self.tokenizer(c)
        for f in self.filters:
            c = f(c)
        return c


ANALYZERS: dict[str, Analyzer] = {
    "whitespace": Analyzer(whitespace, (lowercase,)),
    "simple": Analyzer(standard, (lowercase,)),
    "standard": Analyzer(standard, (lowercase, ascii_fold, stop(), porter_stem)),
    "standard_cjk": Analyzer(standard, (lowercase, ascii_fold, stop(), porter_stem, ngram_filter(2, 3, True))),
    "keyword": Analyzer(keyword),
}
BUILTIN = frozenset(ANALYZERS)
_TOKENIZERS = {"whitespace": whitespace, "standard": standard, "letter": letter, "keyword": keyword}
_FILTERS: dict[str, Callable[..., Callable[[Column], Column]]] = {
    "lowercase": lambda **_: lowercase,
    "stop": lambda words=None, **_: stop(words or STOP),
    "porter_stem": lambda **_: porter_stem,
    "ascii_folding": lambda **_: ascii_fold,
    "synonym": lambda synonyms_map=None, **_: synonyms(synonyms_map or {}),
    "ngram": lambda min_gram=2, max_gram=3, keep_short=False, **_: ngram_filter(min_gram, max_gram, keep_short),
    "edge_ngram": lambda min_gram=1, max_gram=20, **_: edge_ngram(min_gram, max_gram),
    "length": lambda min_length=0, max_length=0, **_: length(min_length, max_length),
}
_CHARS: dict[str, Callable[..., Callable[[Column], Column]]] = {
    "html_strip": lambda **_: html_strip,
    "mapping": lambda mapping_table=None, **_: mapping(mapping_table or {}),
    "pattern_replace": lambda pattern="", replacement="", **_: pattern_replace(pattern, replacement),
}


def from_config(config: dict) -> Analyzer:
    """{"tokenizer": {"type": ..}, "token_filters": [{"type": ..}], "char_filters": [..]}"""
    tok = dict(config.get("tokenizer") or {"type": "standard"})
    kind = tok.pop("type")
    if kind == "ngram":
        tokenizer = ngram(tok.get("min_gram", 1), tok.get("max_gram", 2))
    elif kind == "pattern":
        tokenizer = pattern(tok.get("pattern", r"\W+"))
    else:
        tokenizer = _TOKENIZERS[kind]
    made = lambda table, items: tuple(table[x["type"]](**{k: v for k, v in x.items() if k != "type"}) for x in items or ())
    return Analyzer(tokenizer, made(_FILTERS, config.get("token_filters")), made(_CHARS, config.get("char_filters")))


def create_analyzer(name: str, config: dict) -> None:
    if name in ANALYZERS:
        raise ValueError(f"there is an analyzer {name}")
    ANALYZERS[name] = from_config(config)


def drop_analyzer(name: str) -> None:
    if name in BUILTIN:
        raise ValueError(f"{name} is built in")
    ANALYZERS.pop(name)


def list_analyzers() -> list[str]:
    return sorted(ANALYZERS)
