"""String functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def left(s, n: int) -> Column:
    """The first ``n`` characters; for a negative ``n`` all but the last ``-n``."""
    s = _c(s)
    return F.substring(s, F.lit(1), F.lit(n)) if n >= 0 else F.substring(s, F.lit(1), F.greatest(F.length(s) + n, F.lit(0)))


def right(s, n: int) -> Column:
    """The last ``n`` characters; for a negative ``n`` all but the first ``-n``."""
    s = _c(s)
    keep = F.least(F.lit(n), F.length(s)) if n >= 0 else F.greatest(F.length(s) + n, F.lit(0))
    return F.substring(s, F.length(s) - keep + 1, keep)


def concat(*parts) -> Column:
    """Joins what isn't null."""
    return F.concat_ws("", *(p.cast("string") for p in map(_c, parts)))


def regexp_replace(s, pattern: str, to: str, flags: str = "") -> Column:
    """Only the first match is replaced unless ``flags`` has ``g``; ``i`` ignores case."""
    pattern = ("(?i)" if "i" in flags else "") + pattern
    if "g" in flags:
        return F.regexp_replace(_c(s), pattern, to)
    return F.regexp_replace(_c(s), f"^((?s:.*?)){_grouped(pattern)}", "$1" + to)


def _grouped(pattern: str) -> str:
    return f"(?i:{pattern[4:]})" if pattern.startswith("(?i)") else f"(?:{pattern})"


def regexp_match(s, pattern: str) -> Column:
    """Groups of the first match as an array (the whole match if there are none); null without a match."""
    s = _c(s)
    import re

    n = re.compile(pattern).groups
    found = F.array(*(F.regexp_extract(s, pattern, i) for i in (range(1, n + 1) if n else [0])))
    return F.when(s.rlike(pattern), found)


def similar_to(pattern: str) -> str:
    """The regular expression, for the whole string, of a SIMILAR TO pattern."""
    out = "".join({"%": "(?s:.*)", "_": "(?s:.)", ".": r"\.", "^": r"\^", "$": r"\$"}.get(c, c) for c in pattern)
    return f"^(?:{out})$"


def quote_literal(s) -> Column:
    s = _c(s)
    body = F.concat(F.lit("'"), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(s.contains("\\"), F.concat(F.lit(" E"), body)).otherwise(body)


def quote_nullable(s) -> Column:
    return F.coalesce(quote_literal(s), F.lit("NULL"))


#: Words that must be quoted as identifiers.
RESERVED = (
    "all analyse analyze and any array as asc asymmetric both case cast check collate column constraint create current_date current_role current_time "
    "current_timestamp current_user default deferrable desc distinct do else end except false fetch for foreign from grant group having in initially intersect "
    "into lateral leading limit localtime localtimestamp not null offset on only or order placing primary references returning select session_user some "
    "symmetric table then to trailing true union unique user using variadic when where window with"
).split()


def quote_ident(s) -> Column:
    s = _c(s)
    plain = s.rlike(r"^[a-z_][a-z0-9_]*$") & ~s.isin(RESERVED)
    return F.when(plain, s).otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


@F.udf(K.StringType(), useArrow=True)
def format_text(template, args):
    """``%s``, ``%I``, ``%L``, ``%n$s`` and widths."""
    import re

    if template is None:
        return None
    at = [0]

    def one(m):
        if m[0] == "%%":
            return "%"
        if m[1]:
            at[0] = int(m[1][:-1])
        else:
            at[0] += 1
        v = args[at[0] - 1]
        if m[4] == "I":
            v = v if re.fullmatch(r"[a-z_][a-z0-9_]*", v) and v not in RESERVED else '"' + v.replace('"', '""') + '"'
        elif m[4] == "L":
            v = "NULL" if v is None else "'" + v.replace("'", "''") + "'"
        v = "" if v is None else v
        width = int(m[3] or 0)
        return v.ljust(width) if m[2] else v.rjust(width)

    return re.sub(r"%%|%(\d+\$)?(-)?(\d+)?([sIL])", one, template)


@F.pandas_udf(K.StringType())
def normalize(s: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else unicodedata.normalize(f, x) for x, f in zip(s, form)], dtype=object)


@F.pandas_udf(K.BooleanType())
def is_normalized(s: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else unicodedata.is_normalized(f, x) for x, f in zip(s, form)], dtype=object)


@F.pandas_udf(K.StringType())
def unaccent(s: pd.Series) -> pd.Series:
    """Letters without their marks."""
    strip = lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c))
    return pd.Series([None if x is None else strip(x) for x in s], dtype=object)


def to_hex(n) -> Column:
    return F.lower(F.hex(_c(n)))


def encode(b, form: str) -> Column:
    b = _c(b).cast("binary")
    return {"hex": lambda: F.lower(F.hex(b)), "base64": lambda: F.base64(b)}[form]()


def decode(s, form: str) -> Column:
    return {"hex": F.unhex, "base64": F.unbase64}[form](_c(s))


def get_byte(b, i: int) -> Column:
    return F.conv(F.hex(F.substring(_c(b).cast("binary"), i + 1, 1)), 16, 10).cast("int")


def set_byte(b, i: int, v: int) -> Column:
    b = _c(b).cast("binary")
    return F.concat(F.substring(b, 1, i), F.unhex(F.lit(f"{v:02X}")), F.substring(b, F.lit(i + 2), F.octet_length(b)))


def string_to_array(s, sep: str, null: str | None = None) -> Column:
    parts = F.split(_c(s), "\\Q" + sep + "\\E", -1)
    return parts if null is None else F.transform(parts, lambda x: F.nullif(x, F.lit(null)))


def array_to_string(a, sep: str, null: str | None = None) -> Column:
    return F.array_join(_c(a), sep, null) if null is not None else F.array_join(_c(a), sep)


def initcap(s) -> Column:
    """Capital after anything that isn't a letter or digit, small elsewhere."""
    parts = F.regexp_extract_all(_c(s), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))), "")


@F.udf(K.ArrayType(K.StringType()), useArrow=True)
def parse_ident(s):
    import re

    if s is None:
        return None
    return [a.replace('""', '"') if q else b.lower() for q, a, b in re.findall(r'("((?:[^"]|"")+)")|([A-Za-z_][\w$]*)', s)]


@F.udf(K.StringType(), useArrow=True)
def unistr(s):
    import re

    return None if s is None else re.sub(r"\\(?:u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|\+([0-9a-fA-F]{6})|([0-9a-fA-F]{4})|(\\))", lambda m: "\\" if m[5] else chr(int(m[1] or m[2] or m[3] or m[4], 16)), s)


def char_trim(s) -> Column:
    """Blank-padded comparison form."""
    return F.rtrim(_c(s))


def levenshtein(a, b) -> Column:
    return F.levenshtein(_c(a), _c(b))


@F.udf(K.IntegerType(), useArrow=True)
def levenshtein_costs(a, b, ins, dele, sub):
    if a is None or b is None:
        return None
    row = [j * ins for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i * dele
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + dele, row[j - 1] + ins, prev + (0 if x == y else sub))
    return row[-1]


def levenshtein_less_equal(a, b, most: int) -> Column:
    """The distance if it is ``most`` or less, else a number above ``most``."""
    d = F.levenshtein(_c(a), _c(b), most)
    return F.when(d < 0, F.lit(most + 1)).otherwise(d)


def difference(a, b) -> Column:
    """Places in which two Soundex codes agree, 0 to 4."""
    x, y = F.soundex(_c(a)), F.soundex(_c(b))
    return sum(((F.substring(x, i, 1) == F.substring(y, i, 1)).cast("int") for i in range(1, 5)), F.lit(0))


def trigrams(s) -> Column:
    """Distinct trigrams of a text's words, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(_c(s)), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_sort(F.array_distinct(F.flatten(grams)))


def similarity(a, b) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0))


def word_similarity(a, b) -> Column:
    """The share of ``a``'s trigrams that ``b`` has."""
    x = trigrams(a)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, trigrams(b))).cast("double"), F.size(x)), F.lit(0.0))


@F.udf(K.StringType(), useArrow=True)
def metaphone(s):
    """A consonant skeleton by common English spelling rules."""
    import re

    if s is None:
        return None
    s = re.sub(r"[^A-Z]", "", s.upper())
    s = re.sub(r"^(?:KN|GN|PN|AE|WR)", lambda m: m[0][1], s)
    s = re.sub(r"([BDFGHJKLMNPQRSTVWXYZ])\1+", r"\1", s)
    rules = [(r"MB$", "M"), (r"SCH", "SK"), (r"CIA|TIA|TIO|CH|SH", "X"), (r"C(?=[IEY])", "S"), (r"CK|C|Q", "K"), (r"DG(?=[EIY])", "J"), (r"D", "T"), (r"GH(?![AEIOU])", ""), (r"GN$", "N"), (r"G(?=[IEY])", "J"), (r"G", "K"), (r"PH|V", "F"), (r"TH", "0"), (r"X", "KS"), (r"Z", "S"), (r"WH", "W"), (r"[WY](?![AEIOU])", ""), (r"(?<=[AEIOU])H(?![AEIOU])", "")]
    for a, b in rules:
        s = re.sub(a, b, s)
    return s[:1] + re.sub(r"[AEIOU]", "", s[1:])


def strict_word_similarity(a, b) -> Column:
    """The best similarity of ``a`` to a run of whole words of ``b``."""
    words = F.filter(F.split(F.lower(_c(b)), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    n = F.size(words)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.array_join(F.slice(words, i, j - i + 1), " "))))
    return F.when(n == 0, 0.0).otherwise(F.coalesce(F.array_max(F.transform(runs, lambda r: similarity(a, r))), F.lit(0.0)))


def to_ascii(s) -> Column:
    """Latin letters without their marks; what has no plain form is dropped."""
    return F.regexp_replace(unaccent(_c(s)), r"[^\x00-\x7F]", "")
