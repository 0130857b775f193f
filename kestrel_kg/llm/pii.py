"""Format-preserving pseudonyms for personal numbers and dates, by keyed Feistel permutations in SQL functions only.

Values are found by one pattern, validated (Luhn, mod 97, octets, calendar, number plans) and replaced by a permutation of the set of
all valid values of their own form: a card number becomes another of equal length, grouping and valid check digit, a date another date
of the same century and notation (order, widths), a letter of an address another one, large or small as it was, and so on. A permutation maps equal values to equal pseudonyms in every document, and no two to one,
so links stay. With the key it can be undone (``decrypt=True``). What fails validation stays as it is.

A permutation splits a value into two numbers below ``a`` and ``b`` and adds, modulo ``a`` and ``b`` in turn, a keyed SHA-256 of the
other one: ``ROUNDS`` rounds, a bijection of ``a * b`` values whatever the two sizes. Where the form needs it the sizes multiply to
the number of valid values exactly, so no walk and no rejection is needed.

Kinds: card, iban, ssn, phone, ip, date, email (the letters and digits before the @; the domain stays).

Cases: null texts stay null with zero counts; empty texts stay empty. Repeated rows give repeated results. Empty tables give no rows.
Extra columns pass through and give way to results of the same name. The rows aren't shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date")

#: The usual groupings of a card: four by four, 4-6-5 or 4-6-4, unbroken. Other digits may stand before or after them.
FOURS = r"[0-9]{4}(?:[ \-][0-9]{4}){3}"
CARD = rf"(?:{FOURS}|[0-9]{{4}}[ \-][0-9]{{6}}[ \-][0-9]{{4,5}}|[0-9]{{13,19}})"
#: A group after four by four: the end of a card of 17 to 19 digits, or another number; not the beginning of a longer one.
TAIL = r"[ \-][0-9]{1,3}(?![A-Za-z0-9_])(?:(?![ ./\-][0-9])|(?= [0-9]{2}/[0-9]{2}(?![0-9/])))"
#: Characters of an IBAN by country (fixed values).
IBANS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

#: International numbers in groups parted alike.
GROUPED = r"\+[0-9]{1,3}([ .\-])[0-9]{1,7}(?:\1(?![0-9]+(?!\1)[/.\-][0-9])[0-9]{1,7}){1,4}"

#: Java patterns; tried in this order at each place.
FORMS = {
    # neither the local part nor the number of labels is bounded: both are read without going back, and only from their beginning
    "email": r"(?<![\p{L}\p{M}\p{N}._%+\-])[\p{L}\p{M}\p{N}._%+\-]++@(?:[A-Za-z0-9\-]{1,63}\.(?=[A-Za-z]{2}|[A-Za-z0-9\-]{1,63}\.[A-Za-z0-9\-]))++[A-Za-z]{2,24}",
    "iban": r"(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{8,31}(?![A-Za-z0-9_])|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)",
    "date": r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})",
    "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\)[ .\-]?|[0-9]{3}[.\- ])[0-9]{3}[.\- ][0-9]{4}|\+[0-9]{1,3}[ .\-]?[0-9]{6,12}|" + GROUPED,
    "card": rf"(?:{FOURS}{TAIL}|{CARD}(?![A-Za-z0-9_])|(?!(?:[0-9]{{1,12}}[ \-]){{1,12}}{CARD}(?![A-Za-z0-9_]))[0-9](?:[ \-]?[0-9]){{12,18}})",
}
PATTERN = r"(?<![A-Za-z0-9_])(?:" + "|".join(FORMS.values()) + r")(?![A-Za-z0-9_])(?!\.[0-9])"

#: Letters beyond ASCII that addresses may hold; others stay.
ALPHABETS = tuple(
    "".join(chr(c) for first, last in spans for c in range(first, last + 1))
    for spans in (
        ((0xDF, 0xF6), (0xF8, 0xFF)), ((0xC0, 0xD6), (0xD8, 0xDE)), ((0x100, 0x17F),), ((0x3B1, 0x3C9),), ((0x391, 0x3A1), (0x3A3, 0x3A9)), ((0x430, 0x44F), (0x451, 0x451)), ((0x410, 0x42F), (0x401, 0x401)), ((0x5D0, 0x5EA),),
    )
)

#: Steps of a walk; letters and the digits that stand for them in base 26.
WALK = 200
ALPHABET, BASE26 = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"

long = lambda x: F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")


def keyed(key: str, kind: str | Column, step: Column, value: Column) -> Column:
    """A 60-bit number from the key, the form, the round and the other half."""
    text = F.concat_ws("|", F.lit(key), kind if isinstance(kind, Column) else F.lit(kind), step.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str, decrypt: bool) -> Column:
    """struct(l, r) after the rounds; left < a and right < b."""
    sign = -1 if decrypt else 1
    steps = F.sequence(F.lit(ROUNDS), F.lit(1)) if decrypt else F.sequence(F.lit(1), F.lit(ROUNDS))

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        one = F.pmod(s["l"] + sign * F.pmod(keyed(key, kind, i, s["r"]), a), a)
        two = F.pmod(s["r"] + sign * F.pmod(keyed(key, kind, i, s["l"]), b), b)
        return F.struct(F.when(odd, one).otherwise(s["l"]).alias("l"), F.when(odd, s["r"]).otherwise(two).alias("r"))

    return F.aggregate(steps, F.struct(long(left).alias("l"), long(right).alias("r")), step)


def once(value: Column, function) -> Column:
    """``function`` of a value that is computed once, though it occurs often in the result."""
    return F.element_at(F.transform(F.array(value), function), 1)


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def permuted_digits(digits: Column, key: str, kind: str, decrypt: bool) -> Column:
    """A string of 2 to 36 digits, permuted among those of its length; the length is part of the key."""
    size = F.length(digits)
    half = F.floor(size / 2).cast("int")
    a, b = F.pow(F.lit(10.0), half).cast("long"), F.pow(F.lit(10.0), size - half).cast("long")
    mixed = feistel(F.substring(digits, F.lit(1), half).cast("long"), F.substring(digits, half + 1, size - half).cast("long"), a, b, key, kind, decrypt)
    return once(mixed, lambda s: F.concat(F.lpad(s["l"].cast("string"), half, "0"), F.lpad(s["r"].cast("string"), size - half, "0")))


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn's sum; ``doubled``: 1 doubles every second digit from the right, 0 those between."""
    size = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, size - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == doubled, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), add)


def into_shape(shape: Column, chars: Column, kind: str = "[0-9]") -> Column:
    """``chars`` put one by one in the places where ``shape`` has characters of ``kind``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(s: Column, c: Column) -> Column:
        here = c.rlike(kind)
        return F.struct(F.concat(s["out"], F.when(here, F.substring(chars, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + here.cast("int")).alias("at"))

    return F.aggregate(F.split(shape, ""), start, put, lambda s: s["out"])


def prefixes(match: Column, least: int) -> Column:
    """The match and its prefixes that end before a space or hyphen and have ``least`` letters and digits, longest first."""
    ends = F.filter(F.sequence(F.length(match), F.lit(1), F.lit(-1)), lambda i: (i == F.length(match)) | F.substring(match, i + 1, F.lit(1)).isin(" ", "-"))
    return F.filter(F.transform(ends, lambda i: F.substring(match, F.lit(1), i)), lambda x: F.length(F.regexp_replace(x, "[^A-Z0-9]", "")) >= least)


def first_valid(candidates: Column, valid, made) -> Column:
    """``made`` of the first valid candidate; null without one."""
    return once(F.try_element_at(F.filter(candidates, valid), F.lit(1)), lambda x: F.when(x.isNotNull(), made(x)))


def card(match: Column, key: str, decrypt: bool) -> Column:
    """The first valid of: the match's four by four, the match, its prefixes. Longer numbers that start four by four are permuted among
    those that are no valid card up to there (by going on to the next one), so that the same digits are found again."""

    def other(found: Column) -> Column:
        digits = digits_of(found)
        longer = found.rlike(f"^{FOURS}[ \\-]")

        def permuted(d: Column) -> Column:
            body = permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card", decrypt)
            return once(body, lambda x: F.concat(x, F.pmod(-luhn_sum(x, 0), F.lit(10)).cast("string")))

        again = lambda d: longer & (luhn_sum(F.substring(d, 1, 16), 1) % 10 == 0)
        walked = once(permuted(digits), lambda one: F.when(again(one), F.aggregate(F.sequence(F.lit(1), F.lit(16)), one, lambda d, _: F.when(again(d), permuted(d)).otherwise(d))).otherwise(one))
        return once(walked, lambda x: F.concat(into_shape(found, x), F.substring(match, F.length(found) + 1, F.length(match))))

    valid = lambda x: (luhn_sum(digits_of(x), 1) % 10 == 0) & ~digits_of(x).rlike("^0+$")
    fours = F.regexp_extract(match, f"^{FOURS}(?![0-9])", 0)
    return first_valid(F.concat(F.filter(F.array(fours), lambda x: x != ""), prefixes(match, 13)), valid, other)


def mod97(text: Column) -> Column:
    """An IBAN's remainder, of its characters moved and turned to numbers."""
    moved = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))

    def add(r: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        return F.when(letter, (r * 100 + F.ascii(c) - 55) % 97).otherwise((r * 10 + F.try_element_at(F.array(*[F.lit(i) for i in range(10)]), F.ascii(c) - 47)) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), add)


def iban(match: Column, key: str, decrypt: bool) -> Column:
    """The digits of the account part are permuted, letters stay, the check number is made anew. A match is read up to the length of its
    country if a group ends there, else whole, else up to a space."""

    def other(found: Column) -> Column:
        text = F.regexp_replace(found, " ", "")
        body = F.substring(text, F.lit(5), F.length(text))
        fresh = once(permuted_digits(digits_of(body), key, "iban", decrypt), lambda x: into_shape(body, x))
        country = F.substring(text, 1, 2)
        checked = once(fresh, lambda x: F.concat(country, F.lpad((98 - mod97(F.concat(country, F.lit("00"), x))).cast("string"), 2, "0"), x))
        return once(checked, lambda x: F.concat(into_shape(found, x, "[A-Z0-9]"), F.substring(match, F.length(found) + 1, F.length(match))))

    def valid(found: Column) -> Column:
        text = F.regexp_replace(found, " ", "")
        digits = F.length(digits_of(F.substring(text, F.lit(5), F.length(text))))
        return (mod97(text) == 1) & (digits > 1) & F.substring(text, 3, 2).cast("int").between(2, 98)

    lengths = F.create_map(*[F.lit(x) for pair in IBANS.items() for x in pair])
    size = F.try_element_at(lengths, F.substring(match, 1, 2))
    every = prefixes(match, 12)
    usual = F.filter(every, lambda x: F.length(F.regexp_replace(x, " ", "")).eqNullSafe(size))
    return first_valid(F.concat(usual, every), valid, other)


def ssn(match: Column, key: str, decrypt: bool) -> Column:
    """898 areas (001 to 899 without 666) times 99 groups, times 9999 serials."""
    area, group, serial = (F.substring(match, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    index = area - F.when(area > 666, 2).otherwise(1)
    mixed = feistel(index * 99 + group - 1, serial - 1, long(898 * 99), long(9999), key, "ssn", decrypt)

    def shape(s: Column) -> Column:
        at = F.floor(s["l"] / 99)
        parts = (at + F.when(at >= 665, 2).otherwise(1), 3), (s["l"] % 99 + 1, 2), (s["r"] + 1, 4)
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in parts])

    good = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(good, once(mixed, shape))


def phone(match: Column, key: str, decrypt: bool) -> Column:
    """Country code and the first digits of area and exchange stay, so that the number stays in its plan; other digits are permuted.
    Without a country code the area must be of the plan. Numbers of other plans keep their country code only."""
    planned = match.rlike(r"^(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\)[ .\-]?|[0-9]{3}[.\- ])[0-9]{3}[.\- ][0-9]{4}$")
    grouped = match.rlike(f"^{GROUPED}$") & ~planned & (F.length(digits_of(match)) >= 8)
    international = match.rlike(r"^\+[0-9]{1,3}[ .\-]?[0-9]{6,12}$") | grouped
    digits = digits_of(match)

    def plan(d: Column) -> Column:
        head = F.length(d) - 10
        kept = F.concat(F.substring(d, F.lit(1), head + 1))
        free = F.concat(F.substring(d, head + 2, F.lit(2)), F.substring(d, head + 5, F.lit(6)))
        fresh = once(permuted_digits(free, key, "phone", decrypt), lambda x: F.concat(kept, F.substring(x, 1, 2), F.substring(d, head + 4, F.lit(1)), F.substring(x, 3, 6)))
        return F.when(match.startswith("+") | F.substring(d, head + 1, F.lit(1)).rlike("[2-9]"), once(fresh, lambda x: into_shape(match, x)))

    def free_form(d: Column) -> Column:
        head = F.greatest(F.length(F.regexp_extract(match, r"^\+([0-9]{1,3})(?:[ .\-])", 1)), F.lit(1))
        fresh = once(permuted_digits(F.substring(d, head + 1, F.length(d)), key, "line", decrypt), lambda x: F.concat(F.substring(d, F.lit(1), head), x))
        return once(fresh, lambda x: into_shape(match, x))

    return F.when(international, once(digits, free_form)).when(planned, once(digits, plan))


def ip(match: Column, key: str, decrypt: bool) -> Column:
    def other(p: Column) -> Column:
        q = [F.try_element_at(p, F.lit(i)).cast("long") for i in (1, 2, 3, 4)]
        mixed = feistel(q[0] * 256 + q[1], q[2] * 256 + q[3], long(65536), long(65536), key, "ip", decrypt)
        made = once(mixed, lambda s: F.concat_ws(".", *[x.cast("long").cast("string") for x in (F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256)]))
        return F.when(F.greatest(*q) < 256, made)

    return F.when(~match.rlike(r"(^|\.)0[0-9]"), once(F.split(match, r"\."), other))


def date(match: Column, key: str, decrypt: bool) -> Column:
    """The days of each century (from its year 01 to its year 00; 36525 = 75 * 487 of them or 36524 = 92 * 397, and 36159 = 51 * 709 in the
    last one, which ends with 9999) are permuted. Numbers between slashes are read day first where that is a date, else month first.

    A notation is the order and the widths of day and month. Where it can't write every day (``1.3.1987``; a day over 12 after the month)
    the permutation goes on until it meets a day that it can, which permutes those days. ``WALK`` steps leave less than one in 1e21 out."""
    iso = match.rlike("^[0-9]{4}")
    n = F.split(match, "[-./]")
    p = [F.try_element_at(n, F.lit(i)) for i in (1, 2, 3)]
    number = [x.cast("int") for x in p]
    text = lambda y, m, d: F.when(y > 0, F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd"))
    day_first = text(number[2], number[1], number[0])
    month_first = F.when(match.contains("/") & (number[1] > 12), text(number[2], number[0], number[1]))
    american = day_first.isNull() & ~iso

    def permute(day: Column) -> Column:
        from_year = F.floor((F.year(day) - 1) / 100) * 100 + 1
        first = F.make_date(from_year.cast("int"), F.lit(1), F.lit(1))
        size = F.when(from_year == 9901, 2).when((from_year + 99) % 400 == 0, 1).otherwise(0)
        a, b = (F.when(size == 2, long(x)).when(size == 1, long(y)).otherwise(long(z)) for x, y, z in ((51, 75, 92), (709, 487, 397)))
        at = F.datediff(day, first).cast("long")
        mixed = feistel(F.floor(at / b), at % b, a, b, key, F.concat(F.lit("date"), from_year.cast("string")), decrypt)
        return once(mixed, lambda s: F.date_add(first, (s["l"] * b + s["r"]).cast("int")))

    def writable(day: Column) -> Column:
        """Can the match's notation write the day, and is it read back?"""
        d, m = F.when(american, F.length(p[1])).otherwise(F.length(p[0])), F.when(american, F.length(p[0])).otherwise(F.length(p[1]))
        return iso | (((d > 1) | (F.dayofmonth(day) < 10)) & ((m > 1) | (F.month(day) < 10)) & (~american | (F.dayofmonth(day) > 12)))

    def walked(day: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), permute(day), lambda d, _: F.when(writable(d), d).otherwise(permute(d)))

    mark = F.regexp_extract(match, "[-./]", 0)
    wide = lambda x, like: F.lpad(x.cast("string"), F.greatest(F.length(x.cast("string")), F.length(like)), "0")

    def written(day: Column) -> Column:
        d, m, y = F.dayofmonth(day), F.month(day), F.lpad(F.year(day).cast("string"), 4, "0")
        forms = (y, mark, wide(m, p[1]), mark, wide(d, p[2])), (wide(m, p[0]), mark, wide(d, p[1]), mark, y), (wide(d, p[0]), mark, wide(m, p[1]), mark, y)
        return F.when(iso, F.concat(*forms[0])).when(american, F.concat(*forms[1])).otherwise(F.concat(*forms[2]))

    start = F.when(iso, text(number[0], number[1], number[2])).otherwise(F.coalesce(day_first, month_first))
    return once(start, lambda day: F.when(day.isNotNull(), once(walked(day), lambda found: F.when(writable(found), written(found)))))


def email(match: Column, key: str, decrypt: bool) -> Column:
    """The letters of the local part, in blocks of 22, each as two numbers of base 26 with the blocks before it in the key, and its
    digits in blocks of 36 likewise. A letter stays as large or small as it is; equal addresses differing in that alone stay linked."""

    def letters(chars: Column, kind: Column) -> Column:
        size = F.length(chars)
        half = F.floor(size / 2).cast("int")
        number = lambda x: F.conv(F.translate(x, ALPHABET, BASE26), 26, 10).cast("long")
        a, b = F.pow(F.lit(26.0), half).cast("long"), F.pow(F.lit(26.0), size - half).cast("long")
        left = F.when(half > 0, number(F.substring(chars, F.lit(1), half))).otherwise(long(0))
        mixed = feistel(left, number(F.substring(chars, half + 1, size - half)), a, b, key, kind, decrypt)
        base26 = lambda x, n: F.translate(F.lower(F.lpad(F.conv(x.cast("string"), 10, 26), n, "0")), BASE26, ALPHABET)
        return once(mixed, lambda s: F.concat(F.when(half > 0, base26(s["l"], half)).otherwise(F.lit("")), base26(s["r"], size - half)))

    def digits(chars: Column, kind: Column) -> Column:
        one = feistel(long(0), chars.cast("long"), long(1), long(10), key, kind, decrypt)
        return F.when(F.length(chars) > 1, permuted_digits(chars, key, kind, decrypt)).otherwise(one["r"].cast("string"))

    def in_blocks(chars: Column, function, size: int, kind: str) -> Column:
        def add(out: Column, i: Column) -> Column:
            before = out if decrypt else F.substring(chars, F.lit(1), i)
            return F.concat(out, once(F.substring(chars, i + 1, F.lit(size)), lambda x: function(x, F.concat(F.lit(kind), before))))

        return F.when(F.length(chars) > 0, F.aggregate(F.sequence(F.lit(0), F.length(chars) - 1, F.lit(size)), F.lit(""), add)).otherwise("")

    def others(local: Column, sent: Column) -> Column:
        """Letters beyond ASCII, each moved within its alphabet by a number from the key, what the ASCII part is written as, and the letters
        written before it."""

        def add(s: Column, c: Column) -> Column:
            number = lambda size: F.pmod(keyed(key, "email+", F.length(s["done"]), F.concat(sent, F.lit("|"), s["done"])), F.lit(size))
            new = c
            for letters in ALPHABETS:
                at = F.instr(F.lit(letters), c) - 1 + (-1 if decrypt else 1) * number(len(letters))
                new = F.when(F.instr(F.lit(letters), c) > 0, F.substring(F.lit(letters), F.pmod(at, F.lit(len(letters))).cast("int") + 1, F.lit(1))).otherwise(new)
            new = F.when(c > "\x7f", new).otherwise(c)
            return once(new, lambda x: F.struct(F.concat(s["out"], x).alias("out"), F.concat(s["done"], F.when(c > "\x7f", c if decrypt else x).otherwise("")).alias("done")))

        return F.aggregate(F.split(local, ""), F.struct(F.lit("").alias("out"), F.lit("").alias("done")), add, lambda s: s["out"])

    local = F.substring_index(match, "@", 1)
    found = [F.lower(F.regexp_replace(local, "[^A-Za-z]", "")), F.regexp_replace(local, "[^0-9]", "")]
    fresh = F.struct(in_blocks(found[0], letters, 22, "email").alias("a"), in_blocks(found[1], digits, 36, "email9").alias("n"))

    def put(x: Column) -> Column:
        plain = into_shape(into_shape(local, x["a"], "[A-Za-z]"), x["n"])
        return F.array_join(F.zip_with(F.split(local, ""), F.split(plain, ""), lambda a, b: F.when(a.rlike("[A-Z]"), F.upper(b)).otherwise(b)), "")

    def whole(made: Column) -> Column:
        ascii_ = F.regexp_replace(local if decrypt else made, r"[^\x00-\x7F]", "")
        return F.when(local.rlike(r"[^\x00-\x7F]"), others(made, ascii_)).otherwise(made)

    return F.when(local.rlike(r"[\p{L}\p{N}]"), F.concat(once(once(fresh, put), whole), F.lit("@"), F.substring_index(match, "@", -1)))


def replaced(match: Column, key: str, decrypt: bool) -> Column:
    """struct(kind, text) of a match: its pseudonym, or kind null and itself if nothing validates."""
    made = {"email": email, "iban": iban, "card": card, "ssn": ssn, "phone": phone, "ip": ip, "date": date}
    out = None
    for kind in KINDS:
        value = F.struct(F.lit(kind).alias("kind"), made[kind](match, key, decrypt).alias("text"))
        test = match.rlike(f"^(?:{FORMS[kind]})$")
        out = F.when(test, value) if out is None else out.when(test, value)
    out = once(out, lambda s: F.struct(F.when(s["text"].isNotNull(), s["kind"]).alias("kind"), F.coalesce(s["text"], match).alias("text")))
    return out


def pseudonymise(docs: DataFrame, key: str, *, decrypt: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and n_email, n_iban ... the values of each kind replaced."""
    fresh = {f"n_{k}" for k in KINDS} | {"_found", "_new"}
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in fresh])
    some = F.col("text").rlike(r"[0-9@]")
    rows = rows.withColumn("_found", F.when(some, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))))
    rows = rows.withColumn("_new", F.when(F.size("_found") > 0, F.transform("_found", lambda m: replaced(m, key, decrypt))))
    gaps = F.split("text", PATTERN, -1)
    joined = F.array_join(F.zip_with(gaps, F.concat(F.transform("_new", lambda s: s["text"]), F.array(F.lit(""))), lambda g, m: F.concat(g, m)), "")
    text = F.when(F.col("_new").isNotNull(), joined).otherwise(F.col("text"))
    count = lambda k: F.coalesce(F.size(F.filter("_new", lambda s: s["kind"].eqNullSafe(F.lit(k)))), F.lit(0)).cast("long")
    counts = [F.when(F.col("_new").isNotNull(), count(k)).otherwise(F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in rows.columns if c not in ("_found", "_new")], *counts)
