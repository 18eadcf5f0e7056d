"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Each validated value is permuted by a keyed Feistel network over exactly the
values of its format, so the same value gets the same pseudonym in every
document and different values get different ones:

======== ==================================================== =============================
kind     validated by                                         permuted over
======== ==================================================== =============================
card     13 to 19 digits with a right Luhn digit              the other digits; the check
                                                              digit is worked out anew
phone    ten digits behind a country code or in groups; bare  such numbers; with +1 or no
         ones only if area and exchange start with 2 to 9     code, those whose area and
                                                              exchange lie on the same side
                                                              of 200
ssn      nnn-nn-nnnn, no part zero, area neither 666 nor 9nn  such numbers
ip       four parts up to 255                                 all addresses
date     a day from 1600 to 2399, as yyyy-mm-dd, dd.mm.yyyy   those days (292,194 of them)
         or mm/dd/yyyy
email    a local part, @ and a domain with a dot              letters and digits of the local
                                                              part, each within its class
======== ==================================================== =============================

Separators, signs and domains stay. What isn't valid isn't personal data and stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import need_columns, unused

ROUNDS = 10
# Forms of personal data. A value never starts or ends within a longer run of letters or digits.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])|[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9])|[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9])"
IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z])"
CARD = r"[0-9]{13,19}(?![0-9A-Za-z])|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z])|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}(?![0-9A-Za-z])"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|\+[0-9]{1,3}[ .-]?[0-9]{10}(?![0-9A-Za-z])"
PATTERN = rf"{EMAIL}|(?<![0-9A-Za-z])(?:{CARD}|{DATE}|{SSN}|(?<![0-9]\.){IP}|{PHONE})"
QUICK = r"@|[0-9][ ./()-]{0,2}[0-9]"


def _number(x: Column) -> Column:
    return F.coalesce(x.cast("bigint"), F.lit(0).cast("bigint"))


def _keyed(key: str, *parts: Column) -> Column:
    """56 bits of a keyed hash."""
    mixed = F.sha2(F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts), F.lit(key)), 256)
    return F.conv(F.substring(mixed, 1, 14), 16, 10).cast("bigint")


def feistel(left: Column, right: Column, n_left: int | Column, n_right: int | Column, key: str, tag: str) -> Column:
    """struct(l, r): a keyed permutation of the pairs with 0 <= l < n_left and 0 <= r < n_right."""
    nl, nr = (F.lit(n).cast("bigint") if isinstance(n, int) else n.cast("bigint") for n in (n_left, n_right))

    def step(s: Column, i: Column) -> Column:
        shift = _keyed(key, F.lit(tag), nl, nr, i, F.when(i % 2 == 1, s["r"]).otherwise(s["l"]))
        return F.struct(
            F.when(i % 2 == 1, F.pmod(s["l"] + F.pmod(shift, nl), nl)).otherwise(s["l"]).cast("bigint").alias("l"),
            F.when(i % 2 == 0, F.pmod(s["r"] + F.pmod(shift, nr), nr)).otherwise(s["r"]).cast("bigint").alias("r"),
        )

    start = F.struct(_number(left).alias("l"), _number(right).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _padded(x: Column, width: Column) -> Column:
    return F.lpad(x.cast("string"), width, F.lit("0"))


def _filled(v: Column, digits: Column) -> Column:
    """v with its digits replaced, in order, by these."""
    chars = F.split(v, "")
    one = lambda c, i: F.when(c.rlike("[0-9]"), digits.substr(F.length(_digits(v.substr(F.lit(1), i + 1))), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(chars, one), "")


def _luhn_sum(digits: Column, last_counts_once: bool) -> Column:
    """Luhn's sum; the last digit counts once in a whole number, twice in one that lacks its check digit."""
    n = F.length(digits)
    value = lambda c, i: F.when((n - i) % 2 == (1 if last_counts_once else 0), c.cast("int")).otherwise((c.cast("int") * 2) % 10 + (c.cast("int") / 5).cast("int"))
    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, x: a + x)


def _card(v: Column, key: str) -> Column:
    d = _digits(v)
    n = F.length(d) - 1
    half = (n / 2).cast("int")
    p = feistel(d.substr(F.lit(1), half), d.substr(half + 1, n - half), F.pow(F.lit(10), half), F.pow(F.lit(10), n - half), key, "card")
    payload = F.concat(_padded(p["l"], half), _padded(p["r"], n - half))
    whole = F.concat(payload, F.pmod(-_luhn_sum(payload, False), F.lit(10)).cast("string"))
    return F.when(_luhn_sum(d, True) % 10 == 0, _filled(v, whole)).otherwise(v)


def _phone(v: Column, key: str) -> Column:
    """The country code's digits stay; the last ten are permuted."""
    d = _digits(v)
    code, own = d.substr(F.lit(1), F.length(d) - 10), F.right(d, F.lit(10))
    part = lambda i, n: _number(own.substr(F.lit(i), F.lit(n)))
    north = code.isin("", "1")
    area, exchange = part(1, 3), part(4, 3)
    side = lambda x: (F.when(x >= 200, 200).otherwise(0), F.when(x >= 200, 800).otherwise(200))
    (a0, na), (e0, ne) = side(area), side(exchange)
    p = feistel((area - a0) * ne + exchange - e0, part(7, 4), na * ne, 10_000, key, "phone")
    american = F.concat(_padded(a0 + F.floor(p["l"] / ne), F.lit(3)), _padded(e0 + p["l"] % ne, F.lit(3)), _padded(p["r"], F.lit(4)))
    q = feistel(part(1, 5), part(6, 5), 100_000, 100_000, key, "phone")
    other = F.concat(_padded(q["l"], F.lit(5)), _padded(q["r"], F.lit(5)))
    return (
        F.when(north & (v.startswith("+") | ((area >= 200) & (exchange >= 200))), _filled(v, F.concat(code, american)))
        .when(~north, _filled(v, F.concat(code, other)))
        .otherwise(v)
    )


def _ssn(v: Column, key: str) -> Column:
    area, group, serial = (_number(F.element_at(F.split(v, "-"), i)) for i in (1, 2, 3))
    good = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    p = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
    back = p["l"] + F.when(p["l"] >= 665, 2).otherwise(1)
    out = F.concat_ws("-", _padded(back, F.lit(3)), _padded(1 + F.floor(p["r"] / 9999), F.lit(2)), _padded(1 + p["r"] % 9999, F.lit(4)))
    return F.when(good, out).otherwise(v)


def _ip(v: Column, key: str) -> Column:
    o = [_number(F.element_at(F.split(v, r"\."), i)) for i in (1, 2, 3, 4)]
    p = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65_536, 65_536, key, "ip")
    out = F.concat_ws(".", *(f(p[s]).cast("string") for s in "lr" for f in (lambda x: F.floor(x / 256), lambda x: x % 256)))
    return F.when(F.greatest(*o) <= 255, out).otherwise(v)


def _date(v: Column, key: str) -> Column:
    iso = F.when(v.contains("-"), v).when(v.contains("."), F.concat_ws("-", v.substr(7, 4), v.substr(4, 2), v.substr(1, 2)))
    iso = iso.otherwise(F.concat_ws("-", v.substr(7, 4), v.substr(1, 2), v.substr(4, 2)))
    day = iso.try_cast("date")
    first = F.lit("1600-01-01").cast("date")
    n = F.datediff(day, first).cast("bigint")
    good = F.coalesce(n.between(0, 292_193), F.lit(False))
    p = feistel(F.floor(n / 5411), n % 5411, 54, 5411, key, "date")
    new = F.date_add(first, (p["l"] * 5411 + p["r"]).cast("int"))
    form = F.when(v.contains("-"), F.date_format(new, "yyyy-MM-dd")).when(v.contains("."), F.date_format(new, "dd.MM.yyyy"))
    return F.when(good, form.otherwise(F.date_format(new, "MM/dd/yyyy"))).otherwise(v)


def _email(v: Column, key: str) -> Column:
    """Letters and digits of the local part: each half is shifted by a keyed hash of the other, in turn."""
    local, domain = F.substring_index(v, "@", 1), F.concat(F.lit("@"), F.substring_index(v, "@", -1))
    half = ((F.length(local) + 1) / 2).cast("int")

    def shifted(s: Column, other: Column, i: Column) -> Column:
        def one(c: Column, at: Column) -> Column:
            by = _keyed(key, F.lit("email"), i, at, other)
            turn = lambda first, n: F.chr((F.lit(first) + F.pmod(F.ascii(c) - first + by, F.lit(n))).cast("bigint"))
            return F.when(c.rlike("[0-9]"), turn(48, 10)).when(c.rlike("[a-z]"), turn(97, 26)).when(c.rlike("[A-Z]"), turn(65, 26)).otherwise(c)

        return F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), one), "")

    def step(s: Column, i: Column) -> Column:
        return F.struct(
            F.when(i % 2 == 1, shifted(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"),
            F.when(i % 2 == 0, shifted(s["r"], s["l"], i)).otherwise(s["r"]).alias("r"),
        )

    start = F.struct(local.substr(F.lit(1), half).alias("l"), local.substr(half + 1, F.length(local)).alias("r"))
    p = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return F.concat(p["l"], p["r"], domain)


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one value that PATTERN matches whole; itself if it isn't valid."""
    return (
        F.when(value.contains("@"), _email(value, key))
        .when(value.rlike(f"^(?:{CARD})$"), _card(value, key))
        .when(value.rlike(f"^(?:{DATE})$"), _date(value, key))
        .when(value.rlike(f"^(?:{SSN})$"), _ssn(value, key))
        .when(value.rlike(f"^(?:{IP})$"), _ip(value, key))
        .otherwise(_phone(value, key))
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with every valid piece of personal data in text_col replaced by its pseudonym.

    Null and empty texts stay as they are, and so does everything else of a
    text, whatever its length. With count_col, that column tells how many values
    were replaced (0 for null texts). Columns keep their order. Each row stands
    alone: repeated rows get equal results, an empty table stays empty. A text's
    matches are found from left to right and don't overlap.
    """
    need_columns(docs, text_col)
    if not key:
        raise ValueError("a key is needed")
    text = F.col(text_col)
    some = text.rlike(QUICK)
    values, pseudonyms, told = unused(docs, "_values", "_pseudonyms", "_new")
    held = docs.withColumn(values, F.when(some, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))))
    held = held.withColumn(pseudonyms, F.transform(values, lambda v: pseudonym(v, key)))
    found = F.size(F.coalesce(values, F.array().cast("array<string>"))) > 0
    gaps = F.split(text, PATTERN, -1)
    ends = F.concat(F.col(pseudonyms), F.array(F.lit("")))
    new = F.array_join(F.zip_with(gaps, ends, lambda g, p: F.concat(g, p)), "")
    changed = F.size(F.filter(F.zip_with(values, pseudonyms, lambda a, b: a != b), lambda x: x))
    held = held.withColumn(told, F.when(found, new).otherwise(text))
    if count_col:
        held = held.withColumn(count_col, F.when(found, changed).otherwise(0).cast("bigint"))
    names = [c for c in docs.columns if c != count_col]
    out = [F.col(told).alias(c) if c == text_col else F.col(c) for c in names]
    return held.select(*out, *([count_col] if count_col else []))
