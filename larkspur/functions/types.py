"""Types without a peer in Spark: parsing, ordering and formatting."""

from __future__ import annotations

import uuid as _uuid

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def boolean(s) -> Column:
    """Text to boolean: 0, 1, on, off (2 letters for ``of``) and unique prefixes of true, false, yes, no; null if it is none."""
    t = F.lower(F.trim(_c(s)))
    yes = t.isin("1", "on") | ((F.length(t) > 0) & (F.lit("true").startswith(t) | F.lit("yes").startswith(t)))
    no = t.isin("0", "off", "of") | ((F.length(t) > 0) & (F.lit("false").startswith(t) | F.lit("no").startswith(t)))
    return F.when(yes, True).when(no, False)


def input_is_valid(s, kind: str) -> Column:
    """``pg_input_is_valid``."""
    return _c(s).try_cast(kind).isNotNull() if kind != "boolean" else boolean(s).isNotNull()


def typeof(x) -> Column:
    return F.typeof(_c(x))


def num_nulls(*xs) -> Column:
    return sum((_c(x).isNull().cast("int") for x in xs), F.lit(0))


def num_nonnulls(*xs) -> Column:
    return sum((_c(x).isNotNull().cast("int") for x in xs), F.lit(0))


def uuid(s) -> Column:
    """Canonical form of a uuid with or without braces and hyphens; null if it is none."""
    h = F.lower(F.regexp_replace(_c(s), r"[{}-]", ""))
    form = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.when(h.rlike(r"^[0-9a-f]{32}$"), form)


def _named(space, name, digest, version: str) -> Column:
    raw = F.concat(F.unhex(F.regexp_replace(_c(space), "-", "")), F.encode(_c(name), "UTF-8"))
    h = digest(raw)
    variant = F.substring(F.lit("89ab" * 4), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-" + version), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def uuid_v5(space, name) -> Column:
    """A name's uuid in a name space, by SHA-1."""
    return _named(space, name, F.sha1, "5")


def uuid_v3(space, name) -> Column:
    """A name's uuid in a name space, by MD5."""
    return _named(space, name, F.md5, "3")


def money(x) -> Column:
    x = _c(x).cast("decimal(18,2)")
    return F.concat(F.when(x < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(x), 2))


def enum_rank(x, labels: list[str]) -> Column:
    """The place of an enum's label, for ordering."""
    return F.nullif(F.array_position(F.array(*map(F.lit, labels)), _c(x)), F.lit(0).cast("long"))


@F.udf(K.StringType(), useArrow=True)
def cash_words(amount):
    """An amount of money in words."""
    if amount is None:
        return None
    small = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
    tens = "twenty thirty forty fifty sixty seventy eighty ninety".split()

    def words(n):
        if n < 20:
            return small[n]
        if n < 100:
            return tens[n // 10 - 2] + (" " + small[n % 10] if n % 10 else "")
        if n < 1000:
            return small[n // 100] + " hundred" + (" " + words(n % 100) if n % 100 else "")
        for size, name in ((10**15, "quadrillion"), (10**12, "trillion"), (10**9, "billion"), (10**6, "million"), (10**3, "thousand")):
            if n >= size:
                return words(n // size) + " " + name + (" " + words(n % size) if n % size else "")

    cents = int(round(abs(float(amount)) * 100))
    d, c = divmod(cents, 100)
    text = f"{'minus ' if amount < 0 else ''}{words(d)} dollar{'' if d == 1 else 's'} and {words(c)} cent{'' if c == 1 else 's'}"
    return text[0].upper() + text[1:]


# ---------------------------------------------------------------- IPv4 networks


def inet_long(s) -> Column:
    parts = F.split(F.split(_c(s), "/")[0], r"\.")
    return sum((F.element_at(parts, i + 1).cast("long") * (256 ** (3 - i)) for i in range(4)), F.lit(0).cast("long"))


def masklen(s) -> Column:
    return F.coalesce(F.get(F.split(_c(s), "/"), F.lit(1)).cast("int"), F.lit(32))


def host(s) -> Column:
    return F.split(_c(s), "/")[0]


def _dotted(n: Column) -> Column:
    return F.concat_ws(".", *((F.pmod(F.floor(n / 256**k), F.lit(256))).cast("string") for k in (3, 2, 1, 0)))


def network(s) -> Column:
    size = F.pow(F.lit(2.0), 32 - masklen(s)).cast("long")
    n = inet_long(s)
    return F.concat(_dotted(n - n % size), F.lit("/"), masklen(s).cast("string"))


def inet_within(a, b) -> Column:
    """``a <<= b``."""
    size = F.pow(F.lit(2.0), 32 - masklen(b)).cast("long")
    x, y = inet_long(a), inet_long(b)
    return (masklen(a) >= masklen(b)) & (x - x % size == y - y % size)


# ---------------------------------------------------------------- bit strings


def bit_set(bits, i: int, v: int) -> Column:
    """``set_bit`` on a string of 0 and 1."""
    b = _c(bits)
    return F.concat(F.substring(b, 1, i), F.lit(str(v)), F.substring(b, F.lit(i + 2), F.length(b)))


def bit_count(bits) -> Column:
    return F.length(F.translate(_c(bits), "0", ""))


def input_error_info(s, kind: str) -> Column:
    """``pg_input_error_info``: ``message`` and ``sql_error_code`` of a text that is no value of the type, else nulls."""
    x = _c(s)
    bad = x.isNotNull() & ~F.coalesce(input_is_valid(x, kind), F.lit(False))
    number = x.rlike(r"^\s*[+-]?\d+\s*$") if kind in ("int", "bigint", "smallint", "tinyint") else F.lit(False)
    message = F.when(number, F.format_string(f'value "%s" is out of range for type {kind}', x)).otherwise(F.format_string(f'invalid input syntax for type {kind}: "%s"', x))
    return F.when(bad, F.struct(message.alias("message"), F.when(number, "22003").otherwise("22P02").alias("sql_error_code")))


def trunc_macaddr(m) -> Column:
    """The maker's three bytes of a hardware address, the rest zero; addresses in any usual spelling."""
    h = F.lower(F.regexp_replace(_c(m), "[:.-]", ""))
    return F.when(h.rlike("^[0-9a-f]{12}$"), F.concat(*(F.concat(F.substring(h, i, 2), F.lit(":")) for i in (1, 3, 5)), F.lit("00:00:00")))


def satisfies_hash_partition(modulus: int, remainder: int, *columns) -> Column:
    """Whether a row's hash falls into a partition; each row is in one of ``modulus``."""
    return F.pmod(F.xxhash64(*map(_c, columns)), F.lit(modulus)) == remainder


def strict(fn):
    """A function that is null where any argument is, as functions marked STRICT are."""

    def run(*xs):
        some = F.lit(True)
        for x in xs:
            some = some & _c(x).isNotNull()
        return F.when(some, fn(*map(_c, xs)))

    return run


def domain(kind: str, *checks, not_null: bool = False):
    """``CREATE DOMAIN``: a cast that refuses values for which a check (a function of the value) is false; nulls pass unless ``not_null``."""

    def run(x) -> Column:
        v = _c(x).cast(kind)
        bad = v.isNull() if not_null else F.lit(False)
        for check in checks:
            bad = bad | ~F.coalesce(check(v), F.lit(True))
        return F.when(bad, F.raise_error(F.lit("value violates the domain's constraints")).cast(kind)).otherwise(v)

    return run
