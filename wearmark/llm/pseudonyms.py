"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Values are found by pattern and validated (check digits, calendar, ranges); a
value that fails stays. Valid ones are permuted by a keyed Feistel network
inside their format: digits stay digits, letters stay letters of their case,
separators stay, check digits are computed anew, dates stay dates. Each format
is permuted one to one, so equal values stay linked across documents and
different ones stay apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
# Formats, in the order in which they are tried at a place.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,30}+"
# Lengths of IBANs without spaces, by country; another country's number ends where letters and digits end.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI NL", 19: "SI", 20: "AT EE LT LU", 21: "CH HR LI LV", 22: "BG DE GB IE",
    24: "CZ ES RO SE SK", 25: "PT", 26: "IS", 27: "FR GR IT MC SM", 28: "CY HU PL", 31: "MT",
}
_IBANS = [f"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()]
IBAN = rf"(?<![A-Za-z0-9])(?:{'|'.join(_IBANS)}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-]|\.[0-9])"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
PHONE = (
    r"(?<![0-9+])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?<![0-9+])\+[1-9][0-9]{7,14}(?![0-9])"
)
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
# The usual groups first: a month or a code may follow the number after a blank.
CARD = (
    r"(?<![0-9])(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19}"
    r"|[0-9](?:[ -]?[0-9]){12,18})(?![0-9])"
)
KINDS = {"email": EMAIL, "iban": IBAN, "date": DATE, "ip": IP, "phone": PHONE, "ssn": SSN, "card": CARD}
ANY = "|".join(KINDS.values())

# Dates from 1900 to 2099: 73049 days = 17 * 4297, so a two-part network covers them exactly.
FIRST_DAY, DAYS, DAY_PART = "1900-01-01", 73_049, 4_297
# Tried in turn: with slashes the month comes first only where the day cannot.
DATE_FORMATS = (("-", "yyyy-MM-dd"), ("/", "MM/dd/yyyy"), ("/", "dd/MM/yyyy"), (".", "dd.MM.yyyy"))
# Repeats of a permutation until its result is valid again; one in eight needs another, so this never runs out.
WALK = 24

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _number(key: str, kind: str, round_: Column, value: Column, modulus: Column | int) -> Column:
    """Keyed pseudo-random number below ``modulus``."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), value.cast("string")), 256)
    n = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
    return F.pmod(n, F.lit(modulus) if isinstance(modulus, int) else modulus)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _template(value: Column) -> Column:
    """One class letter per character: d digit, a lower, A upper, anything else stays fixed."""
    return F.translate(value, _DIGITS + _UPPER + _LOWER, "d" * 10 + "A" * 26 + "a" * 26)


def permuted(value: Column, template: Column, key: str | Column, kind: str | Column) -> Column:
    """Feistel network over characters: in turn the odd and the even places move by a function of the others.

    Places whose template letter is d, A or a move inside their class.
    """
    return _let(template, lambda t: _network(value, t, key, kind))


def _network(value: Column, template: Column, key: str | Column, kind: str | Column) -> Column:

    def others(text: Column, r: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: F.pmod(i + r, F.lit(2)) == 0)
        return F.array_join(F.transform(at, lambda i: F.substring(text, i, F.lit(1))), "")

    def moved(text: Column, stream: Column, r: Column) -> Column:
        def one(i: Column) -> Column:
            c, t = F.substring(text, i, F.lit(1)), F.substring(template, i, F.lit(1))
            by = F.conv(F.substring(stream, F.pmod(i * 6, F.lit(120)) + 1, F.lit(6)), 16, 10).cast("long")
            out = c
            for letter, alphabet in (("d", _DIGITS), ("A", _UPPER), ("a", _LOWER)):
                place = F.pmod(F.instr(F.lit(alphabet), c) - 1 + by, F.lit(len(alphabet))) + 1
                out = F.when(t == letter, F.substring(F.lit(alphabet), place.cast("int"), F.lit(1))).otherwise(out)
            return F.when(F.pmod(i + r, F.lit(2)) == 1, out).otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")

    def step(acc: Column, s: Column) -> Column:
        r = F.floor(s / 2).cast("int")
        source = F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), template, others(acc["text"], r))
        hashing = F.pmod(s, F.lit(2)) == 0
        return F.struct(
            F.when(hashing, acc["text"]).otherwise(moved(acc["text"], acc["stream"], r)).alias("text"),
            F.when(hashing, F.sha2(source, 512)).otherwise(acc["stream"]).alias("stream"),
        )

    start = F.struct(value.alias("text"), F.lit("").alias("stream"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS - 1)), start, step, lambda acc: acc["text"])


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, its last digit counted as the check digit."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(F.pmod(F.length(digits) - i, F.lit(2)) == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _last_replaced(value: Column, digit: Column) -> Column:
    return F.concat(F.substring(value, F.lit(1), F.length(value) - 1), digit.cast("string"))


def _compact(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9A-Za-z]", "")


def laid(value: Column, compact: Column) -> Column:
    """``value`` with its letters and digits replaced, in order, by those of ``compact``; what separates them stays."""

    def one(new: Column, i: Column) -> Column:
        c = F.substring(value, i, F.lit(1))
        at = F.length(_compact(F.substring(value, F.lit(1), i)))
        return F.when(c.rlike("[0-9A-Za-z]"), F.substring(new, at, F.lit(1))).otherwise(c)

    places = F.sequence(F.lit(1), F.length(value))
    return _let(compact, lambda new: F.array_join(F.transform(places, lambda i: one(new, i)), ""))


def card(value: Column, key: str) -> Column:
    """All digits but the check digit move, alike however the number is spaced."""

    def moved(digits: Column) -> Column:
        template = _last_replaced(_template(digits), F.lit("x"))
        new = permuted(_last_replaced(digits, F.lit(0)), template, key, "card")
        closed = _let(new, lambda n: _last_replaced(n, F.pmod(-luhn_sum(n), F.lit(10))))
        return F.when(F.pmod(luhn_sum(digits), F.lit(10)) == 0, laid(value, closed)).otherwise(value)

    return _let(_compact(value), moved)


def _iban_rest(compact: Column) -> Column:
    """Remainder modulo 97 of an IBAN without spaces."""
    back = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, F.lit(1), F.lit(4)))

    def add(acc: Column, c: Column) -> Column:
        v = F.instr(F.lit(_DIGITS + _UPPER), c) - 1
        return F.pmod(F.when(v > 9, acc * 100 + v).otherwise(acc * 10 + v), F.lit(97))

    def rest(turned: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(turned))
        return F.aggregate(places, F.lit(0), lambda acc, i: add(acc, F.substring(turned, i, F.lit(1))))

    return _let(back, rest)


def iban(value: Column, key: str) -> Column:
    """The account moves, alike however the number is spaced; country and length stay, check digits are new."""

    def closed(new: Column) -> Column:
        check = F.lpad((98 - _iban_rest(new)).cast("string"), 2, "0")
        return F.concat(F.substring(new, 1, 2), check, F.substring(new, F.lit(5), F.length(new)))

    def moved(compact: Column) -> Column:
        open_ = F.concat(F.substring(compact, 1, 2), F.lit("00"), F.substring(compact, F.lit(5), F.length(compact)))
        template = F.concat(F.lit("xxxx"), F.substring(_template(compact), F.lit(5), F.length(compact)))
        new = _let(permuted(open_, template, key, "iban"), closed)
        return F.when(_iban_rest(compact) == 1, laid(value, new)).otherwise(value)

    return _let(_compact(value), moved)


def ip(value: Column, key: str) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    valid = F.forall(parts, lambda x: x < 256)
    start = F.struct(
        (F.get(parts, 0) * 256 + F.get(parts, 1)).cast("long").alias("l"),
        (F.get(parts, 2) * 256 + F.get(parts, 3)).cast("long").alias("r"),
    )

    def step(acc: Column, i: Column) -> Column:
        return F.struct(
            acc["r"].alias("l"), F.pmod(acc["l"] + _number(key, "ip", i, acc["r"], 65_536), F.lit(65_536)).alias("r")
        )

    def shown(acc: Column) -> Column:
        halves = [F.floor(acc[h] / 256) if high else F.pmod(acc[h], F.lit(256)) for h in "lr" for high in (True, False)]
        return F.concat_ws(".", *[h.cast("string") for h in halves])

    moved = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, shown)
    return F.when(valid, moved).otherwise(value)


def date(value: Column, key: str) -> Column:
    out = value
    for mark, form in DATE_FORMATS:
        day = F.try_to_timestamp(value, F.lit(form)).cast("date")
        n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        start = F.struct(F.floor(n / DAY_PART).cast("long").alias("a"), F.pmod(n, F.lit(DAY_PART)).cast("long").alias("b"))
        top = DAYS // DAY_PART

        def step(acc: Column, i: Column) -> Column:
            odd = F.pmod(i, F.lit(2)) == 1
            a = F.pmod(acc["a"] + _number(key, "date", i, acc["b"], top), F.lit(top))
            b = F.pmod(acc["b"] + _number(key, "date", i, acc["a"], DAY_PART), F.lit(DAY_PART))
            return F.struct(F.when(odd, a).otherwise(acc["a"]).alias("a"), F.when(odd, acc["b"]).otherwise(b).alias("b"))

        moved = F.aggregate(
            F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: (acc["a"] * DAY_PART + acc["b"]).cast("int")
        )
        shown = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), moved), form)
        inside = (F.instr(value, mark) > 0) & n.between(0, DAYS - 1)
        out = F.when(inside, shown).otherwise(out)
    return out


def email(value: Column, key: str) -> Column:
    """The local part moves; the domain stays."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    return F.concat(permuted(local, _template(local), key, "email"), F.lit("@"), domain)


def phone(value: Column, key: str) -> Column:
    """All digits but those of the country move, alike however the number is written, with or without +1."""
    abroad = F.startswith(value, F.lit("+"))

    def moved(digits: Column) -> Column:
        head = F.when(abroad & F.startswith(digits, F.lit("1")), 1).when(abroad, 2).otherwise(0)
        country = F.substring(digits, F.lit(1), head)
        # the country of other numbers counts; +1 is what numbers without one are taken for
        kind = F.concat(F.lit("phone"), F.when(head == 2, country).otherwise(""))
        new = _let(
            F.substring(digits, head + 1, F.length(digits)),
            lambda rest: permuted(rest, _template(rest), F.lit(key), kind),
        )
        return laid(value, F.concat(country, new))

    return _let(_compact(value), moved)


def ssn(value: Column, key: str) -> Column:
    """Moves among valid numbers: the permutation is repeated until its result is one."""
    valid = lambda v: ~v.rlike(r"^(?:000|666|9)|-00-|-0000$")
    moved = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        value,
        lambda acc, i: F.when((i > 1) & valid(acc), acc).otherwise(permuted(acc, _template(acc), key, "ssn")),
    )
    return F.when(valid(value), moved).otherwise(value)


_MAKERS = {"email": email, "iban": iban, "date": date, "ip": ip, "phone": phone, "ssn": ssn, "card": card}


def kind_of(match: Column) -> Column:
    """The first kind whose format is the whole match."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(match.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def pseudonym(match: Column, key: str) -> Column:
    kind, out = kind_of(match), match
    for name, make in _MAKERS.items():
        out = F.when(kind == name, make(match, key)).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str, text: str = "text", count: str = "n_replaced") -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and their number in ``count`` (an input column of that name is replaced).

    ``key`` is the caller's secret. A null text stays null and counts 0, an empty
    one stays empty; repeated rows get equal texts. Values that fail validation
    stay and are not counted.
    """
    c = F.col(text)
    found = F.when(c.rlike("[0-9@]"), F.regexp_extract_all(c, F.lit(ANY), F.lit(0)))
    rows = docs.select(*[x for x in docs.columns if x != count], F.coalesce(found, F.array().cast("array<string>")).alias("__found"))
    rows = rows.withColumn("__new", F.transform("__found", lambda m: pseudonym(m, key)))
    pieces = F.split(c, ANY, -1)
    joined = F.array_join(
        F.flatten(F.zip_with(pieces, "__new", lambda p, m: F.array(p, F.coalesce(m, F.lit(""))))), ""
    )
    changed = F.size(F.filter(F.zip_with("__found", "__new", lambda a, b: a != b), lambda x: x)).cast("long")
    return rows.withColumns(
        {count: changed, text: F.when(F.size("__found") > 0, joined).otherwise(c)}
    ).drop("__found", "__new")
