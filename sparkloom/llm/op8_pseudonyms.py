"""Format-preserving Feistel pseudonyms, with SQL functions alone.

Personal values are found by one pattern, validated, and replaced by a keyed permutation of
their own format: a card number becomes another number of that length with a right check digit,
a date another date, an address another address.  The permutation depends on the key and the
value, not on the document, so equal values stay equal everywhere and different ones stay
different; who has the key can turn it back (``invert``).

The cipher is a Feistel network of ``ROUNDS`` rounds: the value is cut into two halves; in turn
each half is added to a keyed SHA-512 of the other, character by character, modulo the size of
the character's class (digits 10, letters 26, hexadecimal letters 6, characters beyond ASCII
within their aligned block of 64, characters of the format not at all).  A *mask* says which class
each character belongs to.  Values of which not all strings of their format are valid are
numbered: the network runs on the two parts of the number, each modulo its own size (``SIZES``), so
that a date of 1900 to 2099 becomes another one and a valid national number a valid one.

A secret is the whole run up to a blank, quote or angle bracket, however long, after a name (in quotes or not) and a
sign, or after "bearer" if it has a digit.  Mail addresses are those of ASCII characters: others are left as they are.

A text is cut at its matches (``split``) and put together again around the pseudonyms, which
reads it a fixed number of times however many matches it has; texts without a match pass as they
are.  No shuffle, no state.

Values that fail validation (check digits, days that do not exist, national numbers with a part
that is never given out, telephone numbers of fewer than 8 or more than 15 digits) are not personal
values and stay.  Null texts stay null (op8's query counts no values there), empty ones empty;
repeated rows and ties give equal rows; other columns pass through ``pseudonymised`` untouched,
whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import documents, free_names

KEY = "sparkloom-demonstration-key"
ROUNDS = 8
DAYS = 73049  # 1900-01-01 to 2099-12-31
#: Kind -> sizes of the two parts of its values' numbers; their product is the number of valid values.
SIZES = {"ipv4": (65536, 65536), "date": (17, DAYS // 17), "national_id": (998 * 99, 9999)}
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_B, _E = "(?<![0-9A-Za-z])", "(?![0-9A-Za-z])"
#: Kind -> pattern, in order of precedence. Java syntax; possessive where a long run could be retried.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,6}(?![A-Za-z0-9-])",
    "access_key": _B + "(?:AKIA|ASIA)[0-9A-Z]{16}" + _E,
    "secret": r"(?i:(?<![a-z])(?:(?:password|passwd|secret|token|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?|bearer\s{1,3}(?=[^\s\"'<>]*[0-9])))[^\s\"'<>]{6,}+",
    "iban": _B + "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _E,
    "iso_date": _B + "(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]" + _E,
    "day_date": _B + "[0-3][0-9][./][01][0-9][./](?:19|20)[0-9]{2}" + _E,
    "ipv4": r"(?<![0-9A-Za-z.])" + _OCTET + r"(?:\." + _OCTET + r"){3}(?![0-9A-Za-z]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
    r"|\+[1-9][0-9]{0,2}[ .-]?\(?[0-9]{1,4}\)?(?:(?:[ -]?[0-9]{2,4}){2,4}|(?:\.?[0-9]{2,4}){2,4})(?!\.[0-9])"
    r"|\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4})" + _E,
    "national_id": _B + "[0-9]{3}-[0-9]{2}-[0-9]{4}" + _E,
    "card": _B + "(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + _E,
}
ANY = "|".join(PATTERNS.values())
#: What every match of a pattern holds: a digit, an @, the head of an access key or the name of a secret.
HINT = "[0-9@]|AKIA|ASIA|(?i:password|passwd|secret|token|key)"
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chars(n: Column) -> Column:
    """1 to n; for n = 0 an empty array."""
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _shift(c: Column, m: Column, by: Column) -> Column:
    """Character c moved by ``by`` within the class that mask character m names."""

    def within(first: str, size: int) -> Column:
        return F.char(F.lit(ord(first)) + F.pmod(F.ascii(c) - ord(first) + by, F.lit(size)))

    return (
        F.when(m == "d", within("0", 10))
        .when(m == "n", within("2", 8))
        .when(m == "l", within("a", 26))
        .when(m == "u", within("A", 26))
        .when(m == "h", within("a", 6))
        .when(m == "w", _beyond_ascii(c, by))
        .otherwise(c)
    )


def _beyond_ascii(c: Column, by: Column) -> Column:
    """Character c moved within its aligned block of 64 code points (U+00A0 to U+00BF: of 32)."""

    def moved(n: Column) -> Column:
        low = F.when(n < 0xC0, F.lit(0xA0)).otherwise(n - F.pmod(n, F.lit(64)))
        to = low + F.pmod(n - low + by, F.when(n < 0xC0, F.lit(32)).otherwise(F.lit(64)))
        return F.decode(F.unhex(F.lpad(F.hex(to), 8, "0")), "UTF-32")

    return _let(F.ascii(c), moved)


def _characters(text: Column) -> Column:
    """The characters of a string, those beyond 16 bits whole."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _round(half: Column, mask: Column, other: Column, number: Column, key: str, invert: bool) -> Column:
    hashed = F.sha2(F.concat_ws("\x1f", F.lit(key), number.cast("string"), mask, other), 512)

    def moved(s: Column) -> Column:
        def one(c: Column, i: Column) -> Column:  # arrays, as finding a string's i-th character reads all before it
            by = F.conv(F.substr(s["h"], F.pmod(4 * i, F.lit(128)) + 1, F.lit(4)), 16, 10).cast("int")
            return _shift(c, F.get(s["m"], i), -by if invert else by)

        return F.array_join(F.transform(_characters(half), one), "")

    return _let(F.struct(hashed.alias("h"), _characters(mask).alias("m")), moved)


def feistel(value: Column, mask: Column, key: str = KEY, invert: bool = False) -> Column:
    """The keyed permutation of ``value`` within the format of ``mask``, a string as long as the value."""
    cut = (F.length(value) / 2).cast("int")

    def split(s: Column, left: bool) -> Column:
        return F.substr(s, F.lit(1), cut) if left else F.substr(s, cut + 1, F.length(s))

    start = F.struct(split(value, True).alias("a"), split(value, False).alias("b"), split(mask, True).alias("ma"), split(mask, False).alias("mb"))

    def step(s: Column, r: Column) -> Column:
        even = F.pmod(r, F.lit(2)) == 0
        a = F.when(even, _round(s["a"], s["ma"], s["b"], r, key, invert)).otherwise(s["a"])
        b = F.when(~even, _round(s["b"], s["mb"], s["a"], r, key, invert)).otherwise(s["b"])
        return F.struct(a.alias("a"), b.alias("b"), s["ma"].alias("ma"), s["mb"].alias("mb"))

    order = list(range(ROUNDS))[:: -1 if invert else 1]
    return F.aggregate(F.array(*map(F.lit, order)), start, step, lambda s: F.concat(s["a"], s["b"]))


def _by_class(value: Column) -> Column:
    """The mask of a value of which every letter and digit moves within its class."""
    return F.regexp_replace(F.translate(value, _DIGITS + _LOWER + _UPPER, "d" * 10 + "l" * 26 + "u" * 26), r"[^\x00-\x9F]", "w")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refilled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, in order, by ``digits``."""

    def step(s: Column, i: Column) -> Column:
        c = F.substr(form, i, F.lit(1))
        digit = c.rlike("[0-9]")
        return F.struct(F.concat(s["o"], F.when(digit, F.substr(digits, s["k"], F.lit(1))).otherwise(c)).alias("o"), (s["k"] + digit.cast("int")).alias("k"))

    return F.aggregate(_chars(F.length(form)), F.struct(F.lit("").alias("o"), F.lit(1).alias("k")), step, lambda s: s["o"])


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum; every second digit from the right counts double, starting with the last if ``doubled`` is 0."""

    def step(total: Column, i: Column) -> Column:
        d = F.substr(digits, -i, F.lit(1)).cast("int")
        twice = 2 * d - F.when(d > 4, F.lit(9)).otherwise(F.lit(0))
        return total + F.when(F.pmod(i, F.lit(2)) == (1 - doubled), twice).otherwise(d)

    return F.aggregate(_chars(F.length(digits)), F.lit(0), step)


def _card(value: Column, key: str, invert: bool) -> Column:
    """The first digit stays, the check digit follows from the others; None if the number is not valid."""

    def body(digits: Column) -> Column:
        inner = F.substr(digits, F.lit(2), F.length(digits) - 2)
        moved = F.concat(F.substr(digits, F.lit(1), F.lit(1)), feistel(inner, F.repeat(F.lit("d"), F.length(inner)), key, invert))
        full = _let(moved, lambda m: F.concat(m, F.pmod(10 - F.pmod(luhn_sum(m, 0), F.lit(10)), F.lit(10)).cast("string")))
        return F.when(F.pmod(luhn_sum(digits, 1), F.lit(10)) == 0, _refilled(value, full))

    return _let(_digits(value), body)


def _phone(value: Column, key: str, invert: bool) -> Column:
    """The first digit stays.  With country code 1 (or none) area and exchange codes that start with 2 to 9,
    as the plan has it, get such ones, and others keep their first digits; None for less than 8 or more than 15 digits."""

    def body(digits: Column) -> Column:
        plan = F.when(digits.rlike("^1[2-9][0-9]{2}[2-9][0-9]{6}$"), F.lit("-nddndddddd")).when(digits.rlike("^1[0-9]{10}$"), F.lit("--dd-dddddd"))
        plan = plan.when(~value.startswith("+"), F.lit("nddndddddd"))
        mask = F.coalesce(plan, F.concat(F.lit("-"), F.repeat(F.lit("d"), F.length(digits) - 1)))
        return F.when(F.length(digits).between(8, 15), _refilled(value, feistel(digits, mask, key, invert)))

    return _let(_digits(value), body)


def _ipv4(value: Column, key: str, invert: bool) -> Column:
    """Four octets as two halves of 16 bits."""
    octets = F.split(value, r"\.")

    def pair(i: int) -> Column:
        return F.element_at(octets, i).cast("int") * 256 + F.element_at(octets, i + 1).cast("int")

    def done(s: Column) -> Column:
        return F.concat_ws(".", *((F.floor(x / 256) if high else F.pmod(x, F.lit(256))).cast("string") for x in (s["a"], s["b"]) for high in (True, False)))

    return _two_numbers(pair(1), pair(3), "ipv4", key, invert, done)


def _two_numbers(a: Column, b: Column, kind: str, key: str, invert: bool, done) -> Column:
    """The Feistel network on two numbers below the kind's sizes."""

    def moved(x: Column, other: Column, r: Column, size: int) -> Column:
        h = F.conv(F.substr(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(kind), r.cast("string"), other.cast("string")), 256), F.lit(1), F.lit(12)), 16, 10).cast("long")
        return F.pmod(x - h if invert else x + h, F.lit(size)).cast("long")

    first, second = SIZES[kind]

    def step(s: Column, r: Column) -> Column:
        even = F.pmod(r, F.lit(2)) == 0
        return F.struct(F.when(even, moved(s["a"], s["b"], r, first)).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(moved(s["b"], s["a"], r, second)).alias("b"))

    order = list(range(ROUNDS))[:: -1 if invert else 1]
    return F.aggregate(F.array(*map(F.lit, order)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step, done)


def _date(value: Column, form: Column, key: str, invert: bool) -> Column:
    """Another day of 1900 to 2099 in the same format; None for a day that does not exist."""
    day = F.datediff(F.to_date(F.try_to_timestamp(value, form)), F.lit("1900-01-01").cast("date"))
    size = SIZES["date"][1]

    def back(s: Column) -> Column:
        return F.date_add(F.lit("1900-01-01").cast("date"), (s["a"] * size + s["b"]).cast("int"))

    def body(n: Column) -> Column:
        moved = _two_numbers(F.floor(n / size), F.pmod(n, F.lit(size)), "date", key, invert, back)
        return F.when(n.between(0, DAYS - 1), F.date_format(moved, "yyyy-MM-dd"))

    return _let(day, body)


def _iso_date(value: Column, key: str, invert: bool) -> Column:
    return _date(value, F.lit("yyyy-MM-dd"), key, invert)


def _day_date(value: Column, key: str, invert: bool) -> Column:
    mark = F.substr(value, F.lit(3), F.lit(1))
    plain = F.concat(F.substr(value, F.lit(7), F.lit(4)), F.lit("-"), F.substr(value, F.lit(4), F.lit(2)), F.lit("-"), F.substr(value, F.lit(1), F.lit(2)))
    even = mark == F.substr(value, F.lit(6), F.lit(1))
    moved = F.when(even, _date(plain, F.lit("yyyy-MM-dd"), key, invert))
    return _let(moved, lambda d: F.concat(F.substr(d, F.lit(9), F.lit(2)), mark, F.substr(d, F.lit(6), F.lit(2)), mark, F.substr(d, F.lit(1), F.lit(4))))


def _mod97(text: Column) -> Column:
    """The remainder by 97 of letters and digits read as a number (A is 10)."""

    def step(n: Column, i: Column) -> Column:
        c = F.substr(text, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.pmod(n * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(n * 100 + F.ascii(c) - 55, F.lit(97)))

    return F.aggregate(_chars(F.length(text)), F.lit(0), step)


def _iban(value: Column, key: str, invert: bool) -> Column:
    """Country stays, account moves, check digits follow; None if the check digits are wrong. Blanks are laid out in fours."""

    def body(plain: Column) -> Column:
        country, account = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5), F.length(plain))
        valid = _mod97(F.concat(account, F.substr(plain, F.lit(1), F.lit(4)))) == 1
        moved = feistel(account, _by_class(account), key, invert)
        full = _let(moved, lambda m: F.concat(country, F.lpad((98 - _mod97(F.concat(m, country, F.lit("00")))).cast("string"), 2, "0"), m))
        spaced = F.when(F.contains(value, F.lit(" ")), F.rtrim(F.regexp_replace(full, "(.{4})", "$1 "))).otherwise(full)
        return F.when(valid, spaced)

    return _let(F.replace(value, F.lit(" "), F.lit("")), body)


def _email(value: Column, key: str, invert: bool) -> Column:
    """All but the last label of the host moves."""
    stop = F.length(value) - F.length(F.substring_index(value, ".", -1)) - 1
    head = F.substr(value, F.lit(1), stop)
    return F.concat(feistel(head, _by_class(head), key, invert), F.substr(value, stop + 1, F.length(value)))


def _access_key(value: Column, key: str, invert: bool) -> Column:
    body = F.substr(value, F.lit(5), F.length(value))
    return F.concat(F.substr(value, F.lit(1), F.lit(4)), feistel(body, _by_class(body), key, invert))


def _secret(value: Column, key: str, invert: bool) -> Column:
    """What stands after the name; hexadecimal values stay hexadecimal."""
    name = F.regexp_extract(value, "^[A-Za-z_-]+(?:[\"']?\\s*[=:]\\s*[\"']?|\\s+)", 0)
    body = F.substr(value, F.length(name) + 1, F.length(value))
    mask = F.when(body.rlike("^[0-9a-f]+$"), F.translate(body, _DIGITS + "abcdef", "d" * 10 + "h" * 6)).otherwise(_by_class(body))
    return F.concat(name, feistel(body, mask, key, invert))


def _national_id(value: Column, key: str, invert: bool) -> Column:
    """Area 001 to 999 but 666, group 01 to 99, serial 0001 to 9999; None for any other."""
    area, group, serial = (F.substr(value, F.lit(at), F.lit(n)).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (group > 0) & (serial > 0)
    place = area - F.when(area > 666, F.lit(2)).otherwise(F.lit(1))

    def done(s: Column) -> Column:
        nth, last = F.floor(s["a"] / 99).cast("int"), F.pmod(s["a"], F.lit(99)) + 1
        shown = nth + F.when(nth >= 665, F.lit(2)).otherwise(F.lit(1))
        return F.concat_ws("-", *(F.lpad(x.cast("string"), n, "0") for x, n in ((shown, 3), (last, 2), (s["b"] + 1, 4))))

    return F.when(valid, _two_numbers(place * 99 + group - 1, serial - 1, "national_id", key, invert, done))


_KINDS = {"email": _email, "access_key": _access_key, "secret": _secret, "iban": _iban, "iso_date": _iso_date, "day_date": _day_date, "ipv4": _ipv4, "phone": _phone, "national_id": _national_id, "card": _card}


def pseudonym(value: Column, key: str = KEY, invert: bool = False) -> Column:
    """The pseudonym of one value, or the value itself where validation fails."""
    tests = [(value.rlike(f"^(?:{pattern})$"), _KINDS[kind](value, key, invert)) for kind, pattern in PATTERNS.items()]
    chosen = reduce(lambda c, t: c.when(*t), tests[1:], F.when(*tests[0]))
    return F.coalesce(chosen, value)


def _found(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def pseudonymised(docs: DataFrame, key: str = KEY, column: str = "text", found: str | None = None) -> DataFrame:
    """The frame with its personal values replaced in ``column``; with ``found`` also their array under that name."""
    values, fresh, parts, n = free_names(docs, "values", "fresh", "parts", "n")
    text = F.col(f"`{column}`").cast("string")
    near = docs.withColumn(values, F.when(text.rlike(HINT), _found(text)))
    near = near.withColumn(n, F.coalesce(F.size(values), F.lit(0)))
    near = near.withColumn(fresh, F.when(F.col(n) > 0, F.transform(values, lambda v: pseudonym(v, key))))
    near = near.withColumn(parts, F.when(F.col(n) > 0, F.split(text, ANY, -1)))
    woven = F.array_join(F.flatten(F.zip_with(F.col(parts), F.col(fresh), lambda p, v: F.array(p, F.coalesce(v, F.lit(""))))), "")
    out = near.withColumn(column, F.when(F.col(n) > 0, woven).otherwise(text))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(*kept, *([F.col(values).alias(found), F.col(fresh).alias(f"{found}_fresh")] if found else []))


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = pseudonymised(docs, found="values")
    n = F.coalesce(F.size("values"), F.lit(0))
    changed = F.when(n > 0, F.size(F.filter(F.zip_with("values", "values_fresh", lambda a, b: a != b), lambda x: x))).otherwise(0)
    return out.select("doc_id", "text", n.alias("n_found"), changed.alias("n_replaced"), F.coalesce("values_fresh", F.array().cast("array<string>")).alias("pseudonyms"))
