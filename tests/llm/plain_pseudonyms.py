"""Format-preserving pseudonyms in plain Python, value by value."""

import datetime
import hashlib
import re

import regex

from sparkloom.llm.op8_pseudonyms import KEY, PATTERNS, ROUNDS

CLASSES = {"d": ("0", 10), "n": ("2", 8), "l": ("a", 26), "u": ("A", 26), "h": ("a", 6)}
FIRST = datetime.date(1900, 1, 1)
#: The patterns are Java's; its white space is ASCII's.
PLAIN = {kind: regex.compile(p, regex.A) for kind, p in PATTERNS.items()}
ANY = regex.compile("|".join(PATTERNS.values()), regex.A)


def moved(c, m, by):
    if m == "w":
        n = ord(c)
        low, size = (0xA0, 32) if n < 0xC0 else (n // 64 * 64, 64)
        return chr(low + (n - low + by) % size)
    if m not in CLASSES:
        return c
    first, size = CLASSES[m]
    return chr(ord(first) + (ord(c) - ord(first) + by) % size)


def network(value, mask):
    cut = len(value) // 2
    half = [value[:cut], value[cut:]]
    masks = [mask[:cut], mask[cut:]]
    for r in range(ROUNDS):
        at = r % 2
        h = hashlib.sha512("\x1f".join([KEY, str(r), masks[at], half[1 - at]]).encode()).hexdigest()
        steps = [int(h[4 * i % 128 : 4 * i % 128 + 4], 16) for i in range(len(half[at]))]
        half[at] = "".join(map(moved, half[at], masks[at], steps))
    return "".join(half)


def numbers(a, b, kind, first, second):
    parts, sizes = [a, b], (first, second)
    for r in range(ROUNDS):
        at = r % 2
        h = hashlib.sha256("\x1f".join([KEY, kind, str(r), str(parts[1 - at])]).encode()).hexdigest()
        parts[at] = (parts[at] + int(h[:12], 16)) % sizes[at]
    return parts


def by_class(value):
    return "".join("d" if "0" <= c <= "9" else "l" if "a" <= c <= "z" else "u" if "A" <= c <= "Z" else "w" if ord(c) >= 160 else c for c in value)


def refilled(form, digits):
    rest = iter(digits)
    return "".join(next(rest) if "0" <= c <= "9" else c for c in form)


def digits_of(value):
    return re.sub("[^0-9]", "", value)


def check_digit(digits):
    d = [int(c) for c in digits][::-1]
    total = sum(x * 2 - 9 * (x > 4) for x in d[0::2]) + sum(d[1::2])
    return str(-total % 10)


def card(value):
    d = digits_of(value)
    if check_digit(d[:-1]) != d[-1]:
        return value
    body = d[0] + network(d[1:-1], "d" * (len(d) - 2))
    return refilled(value, body + check_digit(body))


def phone(value):
    d = digits_of(value)
    if not 8 <= len(d) <= 15:
        return value
    if re.fullmatch("1[2-9]..[2-9].{6}", d):
        mask = "-nddndddddd"
    elif re.fullmatch("1.{10}", d):
        mask = "--dd-dddddd"
    else:
        mask = "-" + "d" * (len(d) - 1) if value[0] == "+" else "nddndddddd"
    return refilled(value, network(d, mask))


def ipv4(value):
    o = [int(x) for x in value.split(".")]
    a, b = numbers(o[0] * 256 + o[1], o[2] * 256 + o[3], "ipv4", 65536, 65536)
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def date(y, m, d):
    try:
        n = (datetime.date(int(y), int(m), int(d)) - FIRST).days
    except ValueError:
        return None
    a, b = numbers(n // 4297, n % 4297, "date", 17, 4297)
    return FIRST + datetime.timedelta(a * 4297 + b)


def iso_date(value):
    return str(date(*value.split("-")) or value)


def day_date(value):
    if value[2] != value[5] or (new := date(value[6:], value[3:5], value[:2])) is None:
        return value
    return f"{new.day:02}{value[2]}{new.month:02}{value[2]}{new.year}"


def as_number(text):
    return int("".join(str(int(c, 36)) for c in text))


def iban(value):
    plain = value.replace(" ", "")
    if as_number(plain[4:] + plain[:4]) % 97 != 1:
        return value
    body = network(plain[4:], by_class(plain[4:]))
    new = f"{plain[:2]}{98 - as_number(body + plain[:2] + '00') % 97:02}{body}"
    return " ".join(new[k : k + 4] for k in range(0, len(new), 4)) if " " in value else new


def email(value):
    head, _, last = value.rpartition(".")
    return f"{network(head, by_class(head))}.{last}"


def access_key(value):
    return value[:4] + network(value[4:], by_class(value[4:]))


def secret(value):
    name = re.match("[A-Za-z_-]+(?:[\"']?\\s*[=:]\\s*[\"']?|\\s+)", value, re.A)[0]
    body = value[len(name) :]
    mask = re.sub("[0-9]", "d", re.sub("[a-f]", "h", body)) if re.fullmatch("[0-9a-f]+", body) else by_class(body)
    return name + network(body, mask)


def national_id(value):
    area, group, serial = map(int, value.split("-"))
    valid = [x for x in range(1, 1000) if x != 666]
    if area not in valid or not group or not serial:
        return value
    a, b = numbers(valid.index(area) * 99 + group - 1, serial - 1, "national_id", 998 * 99, 9999)
    return f"{valid[a // 99]:03}-{a % 99 + 1:02}-{b + 1:04}"


KINDS = {f.__name__: f for f in (email, access_key, secret, iban, iso_date, day_date, ipv4, phone, national_id, card)}


def pseudonym(value):
    """By the first kind whose pattern the whole value has."""
    return next((KINDS[kind](value) for kind, p in PLAIN.items() if p.fullmatch(value)), value)


def replaced(text):
    """Values, pseudonyms and the text with them."""
    found = ANY.findall(text or "")
    fresh = [pseudonym(v) for v in found]
    rest = iter(fresh)
    return found, fresh, text if not found else ANY.sub(lambda m: next(rest), text)
