"""Symbol, name, amount, date and payload text rules as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .scalar import col, finite

# Exchange suffixes, legal-form suffixes, blocked tokens.
GLUED_SUFFIXES = ["DE", "MU", "SG", "PA", "AS", "SW", "VI", "IL", "L", "HK", "BK", "F"]
ALIAS_SUFFIXES = [" CORP", " CORPORATION", " INC", " INC.", " CO", " COMPANY", " LTD", " PLC"]
CASH_TOKENS = ["선물", "현금", "cash", "deposit", "futures", "future", "treasury bill", "t-bill", "usd ", "krw ", "jpy "]
FUND_NAME_TOKENS = [" ETF", " ETN", "인버스", "레버리지"]
PAYLOAD_ERROR_KEYS = ["note", "information", "error message", "error", "message"]
PAYLOAD_ERROR_WORDS = ["rate", "limit", "premium", "error", "invalid", "thank you"]


def any_of(tokens) -> str:
    """Regex alternation of literal tokens."""
    return "|".join(map(re.escape, tokens))


def asset_symbol(token) -> Column:
    """Upper-case code without the leading A; codes without an exchange get .KS."""
    c = F.regexp_replace(F.upper(F.trim(col(token))), "^A", "")
    return F.when(F.contains(c, F.lit(".")), c).otherwise(F.concat(c, F.lit(".KS")))


def plain_code(value) -> Column:
    """Letters and digits only, leading A dropped."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(col(value))), "^A", ""), "[^0-9A-Z]", "")


def component_code(value) -> Column:
    """Exchange-suffix rules for component codes; anything else keeps its text with / as -."""
    t = F.upper(F.trim(F.coalesce(col(value), F.lit(""))))
    return (F.when((t == "") | (t == "NAN"), F.lit(""))
            .when(t.rlike("^A[0-9]{6}$"), F.substring(t, 2, 6))
            .when(t.rlike("^[0-9]{6}(KS|KQ|SZ|SS)$"), F.concat(F.substring(t, 1, 6), F.lit("."), F.substring(t, 7, 2)))
            .when(t.rlike("^[0-9]{4,5}HK$"), F.concat(F.regexp_extract(t, "^([0-9]+)HK$", 1), F.lit(".HK")))
            .when(t.rlike("^[0-9]{4}T$"), F.concat(F.substring(t, 1, 4), F.lit(".T")))
            .otherwise(F.when(t.rlike("^[0-9]{4,6}[.](KS|KQ|SZ|SS|HK|T)$"), t).otherwise(F.regexp_replace(t, "/", "-"))))


def component_ticker(value, suffix=None) -> Column:
    """Six-digit codes get the registered exchange suffix (KS when unknown)."""
    c = component_code(value)
    s = F.coalesce(col(suffix), F.lit("KS")) if suffix is not None else F.lit("KS")
    return F.when(c.rlike("^[0-9]{6}$"), F.concat(c, F.lit("."), s)).otherwise(c)


def flip_suffix(ticker) -> Column:
    t = col(ticker)
    return (F.when(t.endswith(".KS"), F.concat(F.regexp_replace(t, "[.]KS$", ""), F.lit(".KQ")))
            .when(t.endswith(".KQ"), F.concat(F.regexp_replace(t, "[.]KQ$", ""), F.lit(".KS"))).otherwise(t))


def implied_candidates(ticker) -> Column:
    """Alternative symbols: glued exchange suffixes split off, Korean boards flipped."""
    t = F.trim(col(ticker))
    glued = [F.when(t.endswith(s) & (F.length(t) > len(s) + 1),
                    F.concat(F.regexp_extract(t, f"^(.*){s}$", 1), F.lit(f".{s}"))) for s in GLUED_SUFFIXES]
    boards = F.when(t.rlike("^[0-9]{6}[.]K[SQ]$"), flip_suffix(t))
    return F.array_compact(F.array(*glued, boards))


def match_name(name) -> Column:
    """Name for matching: bracketed parts and spaces dropped, upper case."""
    # The pattern defines which names match.
    return F.upper(F.regexp_replace(col(name), r"\s+|\(.*?\)|\[.*?\]", ""))


def search_name(name) -> Column:
    """Name for a search: leading markers, share class and repeated spaces dropped."""
    # The markers that are dropped.
    q = F.trim(F.regexp_replace(col(name), r"(?i)^\((dup|선|합성|현물)\)\s*", ""))
    q = F.trim(F.regexp_replace(q, r"(?i)^\s*dup\s+", ""))
    q = F.trim(F.regexp_replace(q, r"\s+-[A-Z]$", ""))
    return F.trim(F.regexp_replace(q, r"\s+", " "))


def latin_only(name) -> Column:
    """Latin letters and no Hangul."""
    n = col(name)
    return n.rlike("[A-Za-z]") & ~n.rlike("[가-힣]")


def match_score(item, name, other=None) -> Column:
    """3 equal, 2 contained in the alternative text, 1 contained either way, 0 otherwise."""
    a, b = match_name(item), match_name(name)
    alt = match_name(other) if other is not None else F.lit("")
    return (F.when(a == b, 3).when((b != "") & F.contains(alt, b), 2)
            .when(F.contains(b, a) | F.contains(a, b), 1).otherwise(0))


def name_aliases(name) -> Column:
    """Sorted distinct spellings of a company name: class and legal form dropped or replaced."""
    # Legal forms and the spellings made of a name.
    base = F.trim(F.regexp_replace(col(name), r"\s+", " "))
    plain = F.trim(F.regexp_replace(base, r"(?i)\s+Class\s+[A-Z]$", ""))
    bare = F.regexp_replace(plain, "[.,]", "")
    stem = F.trim(F.regexp_replace(bare, r"(?i)\b(CORPORATION|CORP|INC|COMPANY|CO|LTD|PLC)[.]?$", ""))
    forms = [base, F.upper(base), plain, F.upper(plain), F.upper(bare)]
    stems = [F.when(stem != "", F.upper(F.concat(stem, F.lit(s)))) for s in ["", *ALIAS_SUFFIXES]]
    return F.array_sort(F.filter(F.array_distinct(F.array_compact(F.array(*forms, *stems))), lambda a: a != ""))


def fund_name(name, prefixes: list[str]) -> Column:
    n = F.upper(col(name))
    return n.rlike("^(" + any_of(prefixes) + ")") | n.rlike(any_of(FUND_NAME_TOKENS))


def cash_or_future(name) -> Column:
    return F.lower(col(name)).rlike(any_of(CASH_TOKENS))


def amount(text) -> Column:
    """Localized amounts: thousands commas, (negative) brackets, dash and blanks as null."""
    t = F.regexp_replace(F.trim(col(text).cast("string")), ",", "")
    t = F.when(~t.isin("", "-", "nan", "None"), F.regexp_replace(F.regexp_replace(t, r"\(", "-"), r"\)", ""))
    return finite(t.try_cast("double"))


def weight(value) -> Column:
    """Values above one are percent; unreadable is 0."""
    w = F.coalesce(col(value).try_cast("double"), F.lit(0.0))
    return F.when(w > 1, w / 100).otherwise(w)


def iso_date(value) -> Column:
    """yyyymmdd or ISO text to ISO text."""
    t = F.trim(col(value))
    return F.when(t.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2))).otherwise(
        F.substring(t, 1, 10))


def usable_payload(text) -> Column:
    """JSON text that is neither empty nor an error or rate-limit notice."""
    t = F.lower(F.trim(F.coalesce(col(text), F.lit(""))))
    empty = t.isin("", "{}", "[]", "null")
    notice = t.rlike('"(' + "|".join(PAYLOAD_ERROR_KEYS) + ')"\\s*:') & t.rlike("|".join(PAYLOAD_ERROR_WORDS))
    return ~empty & ~notice
