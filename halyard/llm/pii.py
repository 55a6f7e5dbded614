"""Format-preserving pseudonyms: a keyed Feistel permutation within a format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
# Characters permuted at most in a half: 26 ** 12 fits a long with room.
HALF = 12
# The dates permuted among each other: 17 * 4297 days, 1900-01-01 to 2099-12-31.
FIRST_DAY, DAY_LEFT, DAY_RIGHT, MONTHS = "1900-01-01", 17, 4297, 2400
# Steps a walk may take to come back to the dates it permutes; each ends it by about 0.6.
WALK = 64
_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November",
           "December")
# Lengths of the countries' account numbers.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_COUNTRY_CODE = r"\+(?:7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
_YEAR = "(?:19|20)[0-9]{2}"
_MONTH = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in _MONTHS) + ")"
# Bounded, since the matcher takes a stack frame for each repeat of a group: no
# address has a name of over 320 characters or a domain of over 126 labels.
_EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,320}+@(?:[A-Za-z0-9\-]+\.){1,126}[A-Za-z]{2,}"
_IBAN = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(
    f"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in _IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"
_PHONE_1 = r"\+1[ .\-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-]?)[0-9]{3}[ .\-]?[0-9]{4}(?![0-9])"
_PHONE_INT = (r"(?<![0-9A-Za-z])" + _COUNTRY_CODE
              + r"(?:[ .\-]?\([0-9]{1,4}\))?(?:[ .\-]?[0-9]{2,}){1,6}(?![0-9])")
_PHONE_US = (r"(?<![0-9.\-/])(?:1[ .\-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9\-/])(?!\.[0-9])")
_SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
_DATE = "|".join([
    rf"(?<![0-9\-]){_YEAR}-[01][0-9]-[0-3][0-9](?![0-9\-])",
    *[rf"(?<![0-9/.\-]){_YEAR}{c}[01][0-9]{c}[0-3][0-9](?![0-9/\-])(?!\.[0-9])" for c in ("/", r"\.")],
    *[rf"(?<![0-9/.\-])[0-3]?[0-9]{c}[0-3]?[0-9]{c}{_YEAR}(?![0-9/\-])(?!\.[0-9])" for c in ("/", r"\.", r"\-")],
    rf"(?<![A-Za-z0-9]){_MONTH}\.? [0-3]?[0-9],? {_YEAR}(?![0-9])",
    rf"(?<![A-Za-z0-9.,])[0-3]?[0-9] {_MONTH}\.? {_YEAR}(?![0-9])"])
_IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
_CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{4,5})(?![0-9])"
PATTERN = "|".join((_EMAIL, _IBAN, _PHONE_1, _PHONE_INT, _DATE, _SSN, _IPV4, _CARD, _PHONE_US))


def _round(key: str, kind: str, i: Column, half: Column) -> Column:
    """The round function: 52 bits of a keyed SHA-256."""
    said = F.concat_ws("/", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(said, 256), 1, 13), 16, 10).cast("bigint")


def feistel(left: Column, right: Column, n_left: Column, n_right: Column, key: str, kind: str) -> Column:
    """struct(a, b): the permuted pair, a in [0, n_left), b in [0, n_right)."""
    start = F.struct(left.cast("bigint").alias("a"), right.cast("bigint").alias("b"))

    def step(s: Column, i: Column) -> Column:
        n = F.when(i % 2 == 0, n_left).otherwise(n_right).cast("bigint")
        return F.struct(s["b"].alias("a"), ((s["a"] + _round(key, kind, i, s["b"]) % n) % n).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _radix(c: Column) -> Column:
    return F.when(c.between("0", "9"), 10).otherwise(26).cast("bigint")


def _zero(c: Column) -> Column:
    return F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).otherwise(65)


def _number(chars: Column) -> Column:
    return F.aggregate(chars, F.lit(0).cast("bigint"), lambda n, c: n * _radix(c) + (F.ascii(c) - _zero(c)))


def _space(chars: Column) -> Column:
    return F.aggregate(chars, F.lit(1).cast("bigint"), lambda n, c: n * _radix(c))


def _spelled(number: Column, chars: Column) -> Column:
    """``number`` in the places of ``chars``: digits stay digits, letters
    letters of the same case."""
    start = F.struct(number.alias("n"), F.lit("").alias("s"))

    def step(a: Column, c: Column) -> Column:
        return F.struct(F.call_function("div", a["n"], _radix(c)).alias("n"),
                        F.concat(F.char(_zero(c) + a["n"] % _radix(c)), a["s"]).alias("s"))

    return F.aggregate(F.reverse(chars), start, step)["s"]


def _let(value: Column, then) -> Column:
    """``then(value)``, with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _alnum(c: Column) -> Column:
    return c.rlike("^[A-Za-z0-9]$")


def _filled(s: Column, new: Column, at: str = "^[A-Za-z0-9]$") -> Column:
    """``s`` with the characters of ``new`` in its places that match ``at``."""
    start = F.struct(F.lit(1).alias("i"), F.lit("").alias("s"))
    end = F.aggregate(F.split(s, ""), start, lambda a, c: F.when(
        c.rlike(at) & (a["i"] <= F.length(new)),
        F.struct((a["i"] + 1).alias("i"), F.concat(a["s"], F.substr(new, a["i"], F.lit(1))).alias("s")))
        .otherwise(F.struct(a["i"].alias("i"), F.concat(a["s"], c).alias("s"))))
    return end["s"]


def permuted(s: Column, key: str, kind: str) -> Column:
    """``s`` with its letters and digits permuted within their kind and
    everything else in place, in successive blocks of 2 * HALF of them."""
    def both(c: Column) -> Column:
        n = F.floor(F.size(c) / 2).cast("int")
        left, right = F.slice(c, F.lit(1), n), F.slice(c, n + 1, F.size(c))
        pair = feistel(_number(left), _number(right), _space(left), _space(right), key, kind)
        return _let(pair, lambda p: F.concat(_spelled(p["a"], left), _spelled(p["b"], right)))

    def blocks(chars: Column) -> Column:
        last = F.greatest(F.ceil(F.size(chars) / (2 * HALF)).cast("int"), F.lit(1)) - 1
        return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: _let(
            F.slice(chars, i * (2 * HALF) + 1, F.lit(2 * HALF)), both)), "")

    return _let(_let(F.filter(F.split(s, ""), _alnum), blocks), lambda new: _filled(s, new))


def _luhn(s: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(s, "[^0-9]", ""))


def _card(s: Column, key: str) -> Column:
    """Luhn-valid numbers among each other: all digits but the last are
    permuted, and the last is the one that makes the new number valid."""
    body = permuted(F.substr(s, F.lit(1), F.length(s) - 1), key, "card")
    digits = F.array(*[F.lit(str(d)) for d in range(10)])
    return F.when(_luhn(s), _let(body, lambda b: F.concat(
        b, F.filter(digits, lambda d: _luhn(F.concat(b, d)))[0])))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _int(s: Column, at: int, n: int) -> Column:
    return F.substring(s, at, n).cast("bigint")


def _padded(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _phone_us(s: Column, key: str) -> Column:
    """Ten digits after an optional 1. Area codes from 200 on are permuted
    among each other; others pass only after +1, and stay others."""
    lead = F.regexp_extract(s, r"^(?:\+1[ .\-]?|1[ .\-])?", 0)
    body = F.substr(s, F.length(lead) + 1)

    def new(d: Column) -> Column:
        base = F.when(d < "2", 0).otherwise(20_000)
        pair = feistel(_int(d, 1, 5) - base, _int(d, 6, 5), F.when(d < "2", 20_000).otherwise(80_000), F.lit(100_000),
                       key, "phone")
        return F.when(s.startswith("+") | (d >= "2"), _let(
            pair, lambda p: F.concat(_padded(p["a"] + base, 5), _padded(p["b"], 5))))

    return F.concat(lead, _let(_let(_digits(body), new), lambda n: _filled(body, n, "^[0-9]$")))


def _phone_int(s: Column, key: str) -> Column:
    """The digits after the country code, 8 to 15 digits in all."""
    lead = F.regexp_extract(s, "^" + _COUNTRY_CODE, 0)
    return F.when(F.length(_digits(s)).between(8, 15),
                  F.concat(lead, permuted(F.substr(s, F.length(lead) + 1), key, "phone abroad")))


def _ssn(s: Column, key: str) -> Column:
    """Numbers that may be issued: area 001 to 899 without 666, no part 0."""
    area, group, serial = _int(s, 1, 3), _int(s, 5, 2), _int(s, 8, 4)
    at = area - F.when(area > 666, 2).otherwise(1)
    pair = feistel(at * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")

    def spell(p: Column) -> Column:
        n = F.call_function("div", p["a"], F.lit(99))
        return F.concat_ws("-", _padded(n + F.when(n >= 665, 2).otherwise(1), 3), _padded(p["a"] % 99 + 1, 2),
                           _padded(p["b"] + 1, 4))

    good = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(good, _let(pair, spell))


def _iban_check(country: Column, body: Column) -> Column:
    """The two check digits: 98 less the remainder by 97."""
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(F.concat(body, country, F.lit("00")), ""), F.lit(0), lambda n, c: (
        n * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97)
    return _padded(98 - rest, 2)


def _iban(s: Column, key: str) -> Column:
    """All but the country is permuted, with new check digits."""
    plain = F.replace(s, F.lit(" "))
    country, body = F.substring(plain, 1, 2), F.substr(plain, F.lit(5))
    new = _let(permuted(body, key, "iban"), lambda b: F.concat(country, _iban_check(country, b), b))
    return F.when(_iban_check(country, body) == F.substring(plain, 3, 2), _let(new, lambda n: _filled(s, n)))


def _new_day(day: Column, key: str) -> Column:
    """The date for ``day``, in whatever form it is written; null outside the
    dates that are permuted. Dates up to a month's 12th and later ones are
    permuted among themselves, so that a date written day first is still read
    so (or month first, where both are dates)."""
    first = F.lit(FIRST_DAY).cast("date")
    days = F.datediff(day, first)
    month = (F.year(day) - int(FIRST_DAY[:4])) * 12 + F.month(day) - 1
    pair = feistel(month, F.dayofmonth(day) - 1, F.lit(MONTHS), F.lit(12), key, "early date")
    early = _let(pair, lambda p: F.date_add(F.add_months(first, p["a"].cast("int")), p["b"].cast("int")))
    return F.when(days.between(0, DAY_LEFT * DAY_RIGHT - 1), F.when(F.dayofmonth(day) <= 12, early).otherwise(
        _late_day(day, key)))


def _late_day(day: Column, key: str) -> Column:
    """A date after a month's 12th for such a ``day``: a permutation of all
    dates is applied until it comes back to those."""
    def new(n: Column) -> Column:
        pair = feistel(F.floor(n / DAY_RIGHT), n % DAY_RIGHT, F.lit(DAY_LEFT), F.lit(DAY_RIGHT), key, "late date")
        return _let(pair, lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["a"] * DAY_RIGHT + p["b"]).cast("int")))

    start = F.struct(day.alias("day"), F.lit(True).alias("on"))

    def step(s: Column, _: Column) -> Column:
        return F.when(s["on"], _let(_let(F.datediff(s["day"], F.lit(FIRST_DAY).cast("date")), new), lambda d: F.struct(
            d.alias("day"), (F.dayofmonth(d) <= 12).alias("on")))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, step)["day"]


def _day(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")


def _date_iso(s: Column, key: str) -> Column:
    c = F.substring(s, 5, 1)
    new = _new_day(F.translate(s, "/.", "--").try_cast("date"), key)
    return F.replace(new.cast("string"), F.lit("-"), c)


def _date_numbers(s: Column, key: str) -> Column:
    """Two numbers and a year: with dots day first; else month first, or day
    first where only that is a date. Zeros are written as they were."""
    c = F.regexp_extract(s, "[^0-9]", 0)
    part = F.split(s, r"[/.\-]")
    full = F.length(s) == 10

    def spell(new: Column, first: str, second: str) -> Column:
        one = lambda p: F.when(full, F.date_format(new, p * 2)).otherwise(F.date_format(new, p))
        return F.concat(one(first), c, one(second), c, F.date_format(new, "yyyy"))

    by_day, by_month = _day(part[2], part[1], part[0]), _day(part[2], part[0], part[1])
    dots = _let(_new_day(by_day, key), lambda n: spell(n, "d", "M"))
    month = _let(_new_day(by_month, key), lambda n: spell(n, "M", "d"))
    day = F.when(by_day.isNotNull(), _let(_new_day(by_day, key), lambda n: spell(n, "d", "M")))
    return F.when(c == ".", dots).otherwise(F.when(by_month.isNotNull(), month).when(part[0].cast("int") > 12, day))


def _date_words(s: Column, key: str) -> Column:
    """A month by its English name, day before or after it."""
    name = F.regexp_extract(s, "[A-Za-z]+", 0)
    names = F.array(*[F.lit(m) for m in _MONTHS])
    short = F.transform(names, lambda m: F.substring(m, 1, 3))
    day = F.regexp_extract(s, "(?:^| )([0-9]{1,2})(?:,| )", 1)
    old = _day(F.substring(s, -4, 4), F.array_position(short, F.substring(name, 1, 3)).cast("string"), day)

    def spell(new: Column) -> Column:
        month = F.element_at(F.when((F.length(name) == 3) & (name != "May"), short).otherwise(names), F.month(new))
        number = F.when(day.startswith("0"), F.date_format(new, "dd")).otherwise(F.date_format(new, "d"))
        named = F.replace(F.substr(s, F.lit(1), F.length(s) - 4), name, month)
        return F.concat(F.regexp_replace(named, F.lit("[0-9]+"), number), F.date_format(new, "yyyy"))

    return _let(_new_day(old, key), spell)


def _ipv4(s: Column, key: str) -> Column:
    o = F.transform(F.split(s, "[.]"), lambda x: x.cast("int"))
    plain = F.array_join(F.transform(o, lambda x: x.cast("string")), ".")
    pair = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ipv4")

    def spell(p: Column) -> Column:
        high = lambda n: F.call_function("div", n, F.lit(256))
        return F.concat_ws(".", *[x.cast("string") for x in (high(p["a"]), p["a"] % 256, high(p["b"]), p["b"] % 256)])

    return F.when((F.array_max(o) <= 255) & (plain == s), _let(pair, spell))


def _email(s: Column, key: str) -> Column:
    return F.concat(permuted(F.substring_index(s, "@", 1), key, "email"), F.lit("@"), F.substring_index(s, "@", -1))


def pseudonym(s: Column, key: str) -> Column:
    """The pseudonym of one matched value; the value itself if it does not
    pass its format's check (Luhn sum, calendar, octets, area, remainder)."""
    new = (F.when(s.contains("@"), _email(s, key))
           .when(s.startswith("+1"), _phone_us(s, key))
           .when(s.startswith("+"), _phone_int(s, key))
           .when(s.rlike("^[A-Z]{2}[0-9]"), _iban(s, key))
           .when(s.rlike("[A-Za-z]"), _date_words(s, key))
           .when(s.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), _ssn(s, key))
           .when(s.rlike(r"^[0-9]{4}([/.\-])[0-9]{2}\1[0-9]{2}$"), _date_iso(s, key))
           .when(s.rlike(r"^[0-9]{1,2}([/.\-])[0-9]{1,2}\1[0-9]{4}$"), _date_numbers(s, key))
           .when(s.rlike(r"^(?:1[ .\-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}$"), _phone_us(s, key))
           .when(s.contains("."), _ipv4(s, key))
           .otherwise(_card(s, key)))
    return F.coalesce(new, s)


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text, n_found, n_replaced.

    Card numbers (13 to 19 digits, also in groups of four or 4-6-5), calendar
    dates from 1900 to 2099 (as numbers in the usual orders, or with an English
    month), US phone numbers with or without +1, others with a country code,
    social security numbers, IBANs, IPv4 addresses and e-mail names are found
    by pattern and checked; those that pass are replaced by a value of the same format. Each
    format is permuted by its own Feistel network under ``key``: equal values
    get equal pseudonyms in all documents, different values different ones,
    and whoever has the key can go back. Everything else stays byte for byte.
    Built-in functions only; no row meets another, so there is no shuffle.

    Defined results: a null text stays null with 0 found; a text without a
    match comes back unchanged; repeated rows get equal results; rows with a
    null id are treated alike; an empty table gives an empty table.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("found", F.regexp_extract_all("text", F.lit(PATTERN), 0))
    rows = rows.withColumn("new", F.transform("found", lambda m: pseudonym(m, key)))
    # n matches leave n + 1 gaps
    filled = F.zip_with(F.split("text", PATTERN, -1), F.concat("new", F.array(F.lit(""))), lambda gap, m: F.concat(gap, m))
    changed = F.size(F.filter(F.arrays_zip("found", "new"), lambda p: p["found"] != p["new"]))
    some = F.size("found") > 0
    return rows.select("doc_id", F.when(some, F.array_join(filled, "")).otherwise(text).alias("text"),
                       F.when(text.isNull(), 0).otherwise(F.size("found")).cast("bigint").alias("n_found"),
                       F.when(some, changed).otherwise(0).cast("bigint").alias("n_replaced"))
