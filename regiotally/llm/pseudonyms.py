"""Format-preserving pseudonyms: a keyed Feistel network permutes validated values within their own format.

A found value is a list of components, each with a size (a digit has 10 values, a letter 26, an octet of three digits
156, a year of two centuries 200). Even rounds add a keyed hash of the second half to every component of the first
half, modulo its size; odd rounds do it the other way round. Each round can be undone, so equal values get equal
pseudonyms in every document and different values stay different. Everything is built from Spark SQL functions.

=========  =====================================================  ==========================================
format     validated by                                           what is permuted
=========  =====================================================  ==========================================
email      a name, ``@`` and a domain with a top level            letters and digits of the name
card       13 to 19 digits, plain or in card groups, that pass the  all but first and last; the last is the
           Luhn test                                              check digit of the others
phone      ``+`` and country code, or area code and two groups     the national digits
social     ``AAA-GG-SSSS`` in the ranges that are given out        area, group and serial number
address    four octets                                            each octet among those of its width
date       a calendar day of 1900-2099, ISO or day/month order    year and day of the year; 29 February
                                                                  moves among leap years
=========  =====================================================  ==========================================
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from regiotally.llm.rows import fresh

ROUNDS = 6
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![\p{L}\p{N}-])"
ADDRESS = r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\p{L}\p{N}]|\.\d)"
DATE = r"(?<![\p{L}\p{N}./-])(?:(?:19|20)\d\d-\d\d-\d\d|\d\d([./])\d\d\1(?:19|20)\d\d)(?![\p{L}\p{N}]|[./-]\d)"
SOCIAL = r"(?<![\p{L}\p{N}-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\p{L}\p{N}]|-\d)"
CARD = r"(?<![\p{L}\p{N}.+-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\p{L}\p{N}]|[.-]\d)"
PHONE = (
    r"(?<![\p{L}\p{N}+])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\(?[2-9]\d\d\)?[ .-][2-9]\d\d[ .-]\d{4}"
    r"|\+(?!1)\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,4})(?![\p{L}\p{N}]|[.-]\d)"
)
#: Any of the above. DATE has the one group, so it comes first.
ANY = "|".join((DATE, EMAIL, ADDRESS, SOCIAL, PHONE, CARD))
#: Where none of these is, nothing can be found; a cheap first test.
SIGNS = r"\d"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def permuted(values: Column, sizes: Column, key: str, label: str, rounds: int = ROUNDS) -> Column:
    """An array of components, permuted. A single component is shifted by a keyed constant."""
    half = F.ceil(F.size(values) / 2).cast("int")

    def rounded(state: Column, k: Column) -> Column:
        first, second = F.slice(state, F.lit(1), half), F.slice(state, half + 1, F.size(state) - half)
        other = F.array_join(F.when(k % 2 == 0, second).otherwise(first).cast("array<string>"), ",")

        def add(value: Column, i: Column) -> Column:
            digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(label), F.size(state), k, i, other).cast("binary"), 256)
            step = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
            size = F.element_at(sizes, i + 1)
            return F.when((i < half) == (k % 2 == 0), F.pmod(value + step, size).cast("int")).otherwise(value)

        return F.transform(state, add)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), values.cast("array<int>"), rounded)


def _characters(text: Column, key: str, label: str, bases: Callable[[Column, Column], Column], size: Callable[[Column, Column], Column]) -> Column:
    """Permute characters of ``text``. bases: the lowest code of a character's class; size: of the class, 1 to keep it."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c))
    return bound(
        codes,
        lambda own: bound(
            F.transform(own, lambda c, i: F.struct(bases(c, i).alias("base"), size(c, i).alias("size"))),
            lambda kinds: F.array_join(
                F.transform(
                    permuted(F.transform(own, lambda c, i: c - F.element_at(kinds, i + 1)["base"]), F.transform(kinds, lambda x: x["size"]), key, label),
                    lambda v, i: F.when(F.element_at(kinds, i + 1)["size"] == 1, F.substring(text, i + 1, F.lit(1))).otherwise(F.char(v + F.element_at(kinds, i + 1)["base"])),
                ),
                "",
            ),
        ),
    )


def _among(code: Column, ranges: list[tuple[int, int]], field: int, otherwise: Column) -> Column:
    found = None
    for low, high in ranges:
        value = F.lit(low if field == 0 else high - low + 1)
        found = F.when(code.between(low, high), value) if found is None else found.when(code.between(low, high), value)
    return found.otherwise(otherwise)


def email(value: Column, key: str) -> Column:
    name = F.substring_index(value, "@", 1)
    classes = [(48, 57), (97, 122), (65, 90), (224, 246), (248, 255), (192, 214), (216, 222)]  # digits, Latin letters, Latin-1 letters
    new = _characters(name, key, "email", lambda c, i: _among(c, classes, 0, c), lambda c, i: _among(c, classes, 1, F.lit(1)))
    return F.concat(new, F.lit("@"), F.substring_index(value, "@", -1))


def phone(value: Column, key: str) -> Column:
    """Country code and punctuation stay; a first digit of area or exchange stays valid if it was (2 to 9)."""
    american = ~value.rlike(r"^\+(?!1)")
    code = F.length(F.regexp_extract(value, r"^\+(?:1|[27]|\d{2}|)", 0))

    def place(i: Column) -> Column:
        return F.length(F.regexp_replace(F.substring(value, code + 1, i + 1 - code), "[^0-9]", ""))  # 1 for the first national digit

    def digit(c: Column, i: Column) -> Column:
        return c.between(48, 57) & (i >= code)

    def low(c: Column, i: Column) -> Column:
        leading = F.when(american, place(i).isin(1, 4) & (c >= 50)).otherwise((place(i) == 1) & (c > 48))
        return F.when(digit(c, i), F.when(leading, F.when(american, 50).otherwise(49)).otherwise(48)).otherwise(c)

    def size(c: Column, i: Column) -> Column:
        unused = american & place(i).isin(1, 4) & (c < 50)  # 0 and 1 start no area: they change places with each other
        return F.when(digit(c, i), F.when(unused, 2).otherwise(F.lit(58) - low(c, i))).otherwise(1)

    return _characters(value, key, "phone", low, size)


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of the Luhn test over a digit string; places counted from the right, every second one from ``doubled``."""
    return F.aggregate(
        F.transform(
            F.split(F.reverse(digits), ""),
            lambda d, i: F.when(i % 2 == doubled, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")).otherwise(d.cast("int")),
        ),
        F.lit(0),
        lambda a, x: a + F.coalesce(x, F.lit(0)),
    )


def card(value: Column, key: str) -> Column:
    """A number that passes the Luhn test, or ``value`` itself where it does not pass."""
    digits = F.regexp_replace(value, "[^0-9]", "")

    def changed(d: Column) -> Column:
        middle = F.transform(F.split(F.substring(d, F.lit(2), F.length(d) - 2), ""), lambda c: c.cast("int"))
        body = F.concat(F.substring(d, 1, 1), F.array_join(permuted(middle, F.array_repeat(F.lit(10), F.size(middle)), key, "card").cast("array<string>"), ""))
        return bound(body, lambda b: F.concat(b, F.pmod(F.lit(10) - luhn_sum(b, 0) % 10, F.lit(10)).cast("string")))

    def rebuilt(new: Column) -> Column:
        place = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), "[^0-9]", ""))
        return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(new, place(i), F.lit(1))).otherwise(c)), "")

    return bound(digits, lambda d: F.when(luhn_sum(d, 1) % 10 == 0, bound(changed(d), rebuilt)).otherwise(value))


def address(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("int"))
    low = lambda o: F.when(o < 10, 0).when(o < 100, 10).otherwise(100)
    size = lambda o: F.when(o < 10, 10).when(o < 100, 90).otherwise(156)
    return bound(
        octets,
        lambda own: F.array_join(
            F.transform(
                permuted(F.transform(own, lambda o: o - low(o)), F.transform(own, size), key, "address"),
                lambda v, i: (v + low(F.element_at(own, i + 1))).cast("string"),
            ),
            ".",
        ),
    )


def social(value: Column, key: str) -> Column:
    area = F.substring(value, 1, 3).cast("int")
    own = F.array(F.when(area > 666, area - 2).otherwise(area - 1), F.substring(value, 5, 2).cast("int") - 1, F.substring(value, 8, 4).cast("int") - 1)
    new = permuted(own, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "social")
    return bound(
        new,
        lambda n: F.format_string("%03d-%02d-%04d", F.when(n[0] >= 665, n[0] + 2).otherwise(n[0] + 1), n[1] + 1, n[2] + 1),
    )


def date(value: Column, key: str) -> Column:
    """A calendar day of the same notation, or ``value`` where it is none. ``/`` and ``.`` put the day first if that is a day."""
    iso = value.rlike(r"^\d{4}-")
    mark = F.substring(value, 3, 1)
    a, b = F.substring(value, 1, 2), F.substring(value, 4, 2)
    year = F.substring(value, 7, 4)
    day_first = F.try_to_timestamp(F.concat_ws("-", year, b, a), F.lit("yyyy-MM-dd")).isNotNull()
    text = F.when(iso, value).when(day_first, F.concat_ws("-", year, b, a)).otherwise(F.concat_ws("-", year, a, b))
    day = F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")

    def moved(own: Column) -> Column:
        leap_day = F.date_format(own, "MM-dd") == "02-29"
        # days are counted in a year without 29 February
        place = F.dayofyear(F.make_date(F.lit(2001), F.month(own), F.when(leap_day, 28).otherwise(F.dayofmonth(own)))) - 1
        usual = permuted(F.array(F.year(own) - 1900, place), F.array(F.lit(200), F.lit(365)), key, "date")
        leap = permuted(F.array(F.floor((F.year(own) - 1904) / 4).cast("int")), F.array(F.lit(49)), key, "date")
        new = bound(usual, lambda n: F.struct((n[0] + 1900).alias("y"), F.date_add(F.lit("2001-01-01").cast("date"), n[1]).alias("d")))
        whole = F.when(leap_day, F.concat((F.element_at(leap, 1) * 4 + 1904).cast("string"), F.lit("-02-29"))).otherwise(
            bound(new, lambda n: F.concat_ws("-", n["y"].cast("string"), F.date_format(n["d"], "MM-dd")))
        )
        return bound(
            whole,
            lambda w: F.when(iso, w)
            .when(day_first, F.concat(F.substring(w, 9, 2), mark, F.substring(w, 6, 2), mark, F.substring(w, 1, 4)))
            .otherwise(F.concat(F.substring(w, 6, 2), mark, F.substring(w, 9, 2), mark, F.substring(w, 1, 4))),
        )

    return F.when(day.isNull(), value).otherwise(bound(day, moved))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value; values that fail their test come back unchanged."""
    return (
        F.when(value.contains("@"), email(value, key))
        .when(value.rlike(f"^(?:{DATE})$"), date(value, key))
        .when(value.rlike(f"^(?:{ADDRESS})$"), address(value, key))
        .when(value.rlike(f"^(?:{SOCIAL})$"), social(value, key))
        .when(value.rlike(f"^(?:{PHONE})$"), phone(value, key))
        .otherwise(card(value, key))
    )


def replaced(text: Column, key: str) -> Column:
    """A struct ``text, n_replaced``. A null text stays null with 0; texts without findings stay as they are."""
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    between = F.split(text, ANY, -1)

    def whole(values: Column) -> Column:
        return bound(
            F.transform(values, lambda v: pseudonym(v, key)),
            lambda new: F.struct(
                F.concat(F.array_join(F.zip_with(F.slice(between, F.lit(1), F.size(values)), new, lambda t, v: F.concat(t, v)), ""), F.element_at(between, -1)).alias("text"),
                F.size(F.filter(F.zip_with(values, new, lambda a, b: a != b), lambda x: x)).alias("n_replaced"),
            ),
        )

    same = F.struct(text.alias("text"), F.lit(0).alias("n_replaced"))
    return F.when(text.rlike(ANY), bound(found, whole)).otherwise(same)


def pseudonymise(docs: DataFrame, key: str, text_column: str = "text", count_column: str | None = "n_replaced") -> DataFrame:
    """``docs`` with pseudonyms in ``text_column``; no shuffle, all other columns as they are.

    ``count_column`` (None: none) gets the number of values that changed and replaces a column of that name. Null and
    empty texts stay; repeated rows get the same text.
    """
    own = fresh(docs, "_pseudonyms")
    out = docs.withColumn(own, replaced(F.col(text_column).cast("string"), key)).withColumn(text_column, F.col(own)["text"])
    if count_column:
        out = out.withColumn(count_column, F.col(own)["n_replaced"].cast("long"))
    return out.drop(own)
