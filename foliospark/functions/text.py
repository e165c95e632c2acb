"""Text functions. Native expressions, and Arrow functions where Unicode rules have no built-in."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The blocks of ideographs that count as CJK.
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}"
#: Ideographs that word_tokens takes one by one.
CJK_WORDS = r"\x{3400}-\x{9FFF}\x{20000}-\x{3134F}"
#: Latin words and numbers, joined by hyphens and underscores.
LATIN_WORD = "[a-z0-9]+(?:[_-][a-z0-9]+)*"
_ASCII = r"^[\x00-\x7F]*$"


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(str.casefold, na_action="ignore")


def nfkc(x: Column) -> Column:
    """NFKC form; null stays null."""
    return _nfkc(x)


def nfc(x: Column) -> Column:
    """NFC form; null stays null."""
    return _nfc(x)


def casefold(x: Column) -> Column:
    """Full case folding (ß to ss); null stays null."""
    return _casefold(x)


def folded_key(x: Column) -> Column:
    """The key by which concepts and relations compare: NFKC, trimmed, case folded."""
    return _casefold(F.trim(_nfkc(x)))


def is_ascii(x: Column) -> Column:
    return x.rlike(_ASCII)


def cjk_only(x: Column) -> Column:
    """The CJK characters of a text, in order; an empty text for none."""
    return F.regexp_replace(x, f"[^{CJK}]", "")


def without_space(x: Column) -> Column:
    """A text without any Unicode white space."""
    return F.regexp_replace(x, r"(?U)\s", "")


def lexical_tokens(x: Column) -> Column:
    """Tokens of a text for lexical search: of each CJK run its characters, then its pairs; then Latin words.

    The text should be in NFKC form. Null gives null, a text without tokens an empty array.
    """
    low = F.lower(x)
    runs = F.regexp_extract_all(low, F.lit(f"([{CJK}]+)"), F.lit(1))

    def grams(run: Column) -> Column:
        one = F.split(run, "")
        pairs = F.when(
            F.length(run) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
        ).otherwise(F.array().cast("array<string>"))
        return F.concat(one, pairs)

    return F.concat(F.flatten(F.transform(runs, grams)), F.regexp_extract_all(low, F.lit(f"({LATIN_WORD})"), F.lit(1)))


def word_tokens(x: Column) -> Column:
    """Tokens for token error rates: each ideograph, each run of ASCII letters and digits, each other visible character."""
    return F.regexp_extract_all(x, F.lit(rf"([{CJK_WORDS}]|[A-Za-z0-9]+|(?U)[^\s])"), F.lit(1))


def as_code_points(tokens: Column, vocabulary: Column) -> Column:
    """A string of one character a token, so that ``levenshtein`` counts tokens. ``vocabulary``: the distinct tokens of
    both sides; Unicode has room for a million of them beside the surrogates, which are passed over."""

    def character(t: Column) -> Column:
        code = F.array_position(vocabulary, t).cast("int") + 0x4E00
        code = F.when(code >= 0xD800, code + 0x800).otherwise(code)
        return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    return F.array_join(F.transform(tokens, character), "")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; 1 for two empty texts, null if either is null."""
    return pd.Series(
        [
            None if x is None or y is None else 1.0 if not x and not y else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()
            for x, y in zip(a, b, strict=True)
        ],
        dtype="float64",
    )


# Terms that mark a line as the noise of a scanned collection.
NOISE_TERMS = ("kodak", "gray scale", "national archives", "国立公文書館", "内閣文庫", "番號", "冊數", "函號")


def has_known_noise(x: Column, terms: tuple[str, ...] = NOISE_TERMS) -> Column:
    """Whether a text holds one of the terms in any case, or the replacement character."""
    low = F.lower(x)
    test = F.contains(x, F.lit("\ufffd"))
    for t in terms:
        test = test | F.contains(low, F.lit(t.lower()))
    return test


_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")


@F.pandas_udf(T.StringType())
def _without_templates(s: pd.Series) -> pd.Series:
    def of(x: str) -> str:
        before = None
        while before != x:
            before, x = x, _TEMPLATE.sub("", x)
        return x

    return s.map(of, na_action="ignore")


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def clean_markup(x: Column) -> Column:
    """Text of wiki markup: the part in onlyinclude if there is one; comments, references and templates gone, links
    unwrapped, tags and quotes stripped, entities unescaped, lines trimmed, empty ones dropped. Null stays null.

    Templates go from the innermost out, to any depth. Only texts that still have one after the first level, or an
    entity, have work to do in Python.
    """
    body = F.regexp_extract(x, r"(?is)<onlyinclude>(.*?)</onlyinclude>", 1)
    out = F.when(x.rlike(r"(?is)<onlyinclude>.*?</onlyinclude>"), body).otherwise(x)
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?is)<ref\b.*?</ref>", "")
    out = F.regexp_replace(out, r"(?i)<ref\b[^>]*/>", "")
    out = F.regexp_replace(out, r"\[\[(?:[^\]|]+\|)?([^\]]+)\]\]", "$1")
    out = F.regexp_replace(out, _TEMPLATE.pattern, "")
    out = F.coalesce(_without_templates(F.when(out.rlike(_TEMPLATE.pattern), out)), out)
    out = F.regexp_replace(F.regexp_replace(out, r"<[^>]+>", ""), "'{2,}", "")
    out = F.coalesce(_unescape(F.when(F.contains(out, F.lit("&")), out)), out)
    lines = F.transform(F.split(out, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda s: (s != "") & ~F.startswith(s, F.lit("{{"))), "\n")


def truncated(x: Column, most: int) -> Column:
    """The first ``most`` characters of a text. Null stays null."""
    return F.left(x, F.lit(most))


def table_cell(x: Column) -> Column:
    """A text as a cell of a Markdown table: bars escaped, line breaks as spaces; null is an empty cell."""
    return F.replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s*\R\s*", " "), F.lit("|"), F.lit("\\|"))


def label_with_role(label: Column, role: Column) -> Column:
    """``label（role）``, or the label alone where there is no role."""
    return F.concat(label, F.when(F.trim(role) != "", F.concat(F.lit("（"), role, F.lit("）"))).otherwise(""))


def clean_path(x: Column) -> Column:
    """A relative path with forward slashes; null if a part is empty, a dot or two, or names a drive."""
    path = F.translate(x, "\\", "/")
    fine = F.forall(F.split(path, "/"), lambda p: ~p.isin("", ".", "..") & ~F.contains(p, F.lit(":")))
    return F.when(fine, path)


def zoned_timestamp(x: Column) -> Column:
    """An ISO time that names its zone; null for any other text."""
    return F.when(x.rlike(r"(?:Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(x))
