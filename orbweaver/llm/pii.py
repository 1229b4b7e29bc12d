"""Format-preserving pseudonyms by a keyed Feistel network, in DataFrame functions only.

Personal numbers, dates, addresses and secrets are found in texts and replaced by others of the same format. Each format
is a set of values with two parts; ten Feistel rounds add to either part, in turn, a keyed SHA-512 value of the other
part, modulo the part's size. So the map is a permutation of the format, depends on the key alone, and gives equal values
equal pseudonyms in all documents; with the key, restore() turns it round. A pseudonym is valid wherever a value must be:

- card: 13 to 19 digits whose Luhn sum is right; the first digit stays, the last is computed anew;
- iban: whose remainder by 97 is right, with check digits 02 to 98, the only ones that are computed (others would come
  back as these); country and the kind of each character stay, the check digits are computed anew;
- ipv4: four numbers up to 255; ipv6: eight groups of hexadecimal digits, or fewer about a double colon,
  letter for letter and digit for digit;
- phone: ten North American digits, perhaps after +1; area and exchange start with 2 to 9, or else keep their first
  digits; without separators only those that start with 2 to 9; intl: other numbers after +, whose first two digits stay;
- ssn: nine digits in groups 3-2-4 that can be issued;
- date: year-month-day, day.month.year or month/day/year that exists, within its century;
- email: letters and digits before the @, letter for letter and digit for digit; addresses that differ in case alone have
  pseudonyms that do;
- key: access keys, and the value after password, token, secret or api key and = or : if it has a digit or stands in
  quotes or after =, each character as a lower-case letter, upper-case letter or digit.

Separators stay as they are. Numbers and dates that fail their check stay as they are, too, and so does all other text.
The key is the caller's; it comes from a table of one row, so that no plan shows it.

A null text stays null, an empty one empty. Rows are independent: repeated rows, ties and other columns, whatever their
names, change nothing, and an empty table gives an empty result. Texts are read whole, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import local_table

ROUNDS = 10

_HEX = "[0-9A-Fa-f]{1,4}"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_MONTH, _DAY, _YEAR = "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])", "(?:19|20)[0-9]{2}"

#: Countries whose IBANs have that many characters.
_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_REST = lambda n: rf"(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + rf"(?: ?[A-Z0-9]{{{n % 4}}})" * (n % 4 > 0)
#: By the country's length, so that a word in capitals after an IBAN is none of it; any length where that finds nothing.
_CHECK = "(?:0[2-9]|[1-8][0-9]|9[0-8])"
_IBAN = "|".join(f"(?:{c.replace(' ', '|')}){_CHECK}{_REST(n)}(?![0-9A-Za-z])" for n, c in _LENGTHS.items())

#: Formats in the order in which they are tried at a place of the text.
FORMATS = {
    "key": r"(?<![0-9A-Za-z])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    "secret": r"(?i:(?<![0-9A-Za-z])(?:password|passwd|secret|token|api[_-]?key)[ ]{0,3}(?:=[ ]{0,3}[\"']?|:[ ]{0,3}[\"']|:[ ]{0,3}(?=[A-Za-z/+_-]*[0-9])))[0-9A-Za-z/+_-]{8,}+",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": rf"(?<![0-9A-Za-z])(?:{_IBAN}|[A-Z]{{2}}{_CHECK}(?:(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![0-9A-Za-z]))",
    "ipv4": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:])",
    "date": rf"(?<![0-9./-])(?:{_YEAR}-{_MONTH}-{_DAY}|{_DAY}\.{_MONTH}\.{_YEAR}|{_MONTH}/{_DAY}/{_YEAR})(?![./-]?[0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z.,_+-])[2-9][0-9]{2}[2-9][0-9]{6}(?![0-9A-Za-z_]|[.,-][0-9])",
    "intl": r"(?<![0-9A-Za-z+])\+(?=(?:[ .-]?[0-9]){9,15}(?![0-9]))[2-9][0-9]{1,2}(?:[ .-]?[0-9]{2,})+(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{13,19})(?![0-9])",
}
_ANY = "|".join(FORMATS.values())
#: Every format has one of these; texts without any are not searched further.
_MAYBE = "[0-9@]|AKIA|ASIA|(?i:passw|secret|token|api)"

_HEXADECIMAL = ("abcdef", "0123456789")
_KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")


def _chars(s: Column) -> Column:
    return F.split(s, "")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _modulo97(s: Column) -> Column:
    """Remainder of the number that the digits and letters (A is 10) of s spell."""
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(_chars(s), F.lit(0), lambda r, c: ((r * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97).cast("int"))


def _luhn(s: Column) -> Column:
    """Sum of the digits of s, from the right, every second one (the last is the first) doubled."""
    digits = F.transform(F.reverse(_chars(s)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(digits, F.lit(0), lambda a, x: a + x)


def _keyed(key: Column, kind: Column, r: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, kind, r.cast("string"), half), 512)


def _numbers(key: Column, s: Column, sign: int) -> Column:
    """The two numbers of s after all rounds."""

    def step(a: Column, i: Column) -> Column:
        r = i if sign > 0 else F.lit(ROUNDS - 1) - i
        add = lambda other, size: F.conv(F.substring(_keyed(key, s["kind"], r, other.cast("string")), 1, 15), 16, 10).cast("long") % size
        return F.struct(
            F.when(r % 2 == 0, F.pmod(a["l"] + sign * add(a["r"], s["size_l"]), s["size_l"])).otherwise(a["l"]).alias("l"),
            F.when(r % 2 == 1, F.pmod(a["r"] + sign * add(a["l"], s["size_r"]), s["size_r"])).otherwise(a["r"]).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(s["l"].alias("l"), s["r"].alias("r")), step)


def _shifted(text: Column, stream: Column, sign: int, kinds: tuple[str, ...] = _KINDS) -> Column:
    """Each character of text that is of a kind moved within it by the stream's bytes; other characters stay."""

    def moved(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(stream, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        out = c
        for kind in kinds:
            at = F.instr(F.lit(kind), c)
            out = F.when(at > 0, F.substring(F.lit(kind), F.pmod(at - 1 + sign * by, F.lit(len(kind))).cast("int") + 1, F.lit(1))).otherwise(out)
        return out

    return F.when(text == "", text).otherwise(F.array_join(F.transform(_chars(text), moved), ""))


def _letters(key: Column, s: Column, sign: int) -> Column:
    """The characters of s after all rounds; the halves are strings."""

    def moved(half: Column, stream: Column) -> Column:
        return F.when(s["kind"] == "ipv6", _shifted(half, stream, sign, _HEXADECIMAL)).otherwise(_shifted(half, stream, sign))

    def step(a: Column, i: Column) -> Column:
        r = i if sign > 0 else F.lit(ROUNDS - 1) - i
        return F.struct(
            F.when(r % 2 == 0, moved(a["l"], _keyed(key, s["kind"], r, a["r"]))).otherwise(a["l"]).alias("l"),
            F.when(r % 2 == 1, moved(a["r"], _keyed(key, s["kind"], r, a["l"]))).otherwise(a["r"]).alias("r"),
        )

    body = F.when(s["kind"].isin("email", "ipv6"), F.lower(s["body"])).otherwise(s["body"])
    cut = F.floor(F.length(body) / 2).cast("int")
    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(F.substring(body, F.lit(1), cut).alias("l"), F.substring(body, cut + 1, F.length(body)).alias("r")), step)
    # the case of each character stays, where it does not count
    cased = F.array_join(F.zip_with(_chars(F.concat(done["l"], done["r"])), _chars(s["body"]), lambda c, old: F.when(old.rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")
    return F.when(s["kind"].isin("email", "ipv6"), cased).otherwise(F.concat(done["l"], done["r"]))


def _filled(mask: Column, characters: Column, what: str) -> Column:
    """mask with its characters of the class `what` replaced, in order, by those of `characters`."""
    step = lambda a, c: F.struct(
        F.concat(a["out"], F.when(c.rlike(what), F.substring(characters, a["k"], F.lit(1))).otherwise(c)).alias("out"), (a["k"] + c.rlike(what).cast("int")).alias("k")
    )
    return F.aggregate(_chars(mask), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step)["out"]


def _date(m: Column) -> Column:
    """The day that a date of any of the three forms names; null if there is none."""
    iso = F.when(m.contains("-"), m).when(m.contains("."), F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2)))
    return F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")


def _kind(m: Column) -> Column:
    """The format that the whole match has; null if it fails the format's check."""
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(FORMATS.items()):
        # what looks before or behind a match holds at its edges
        good = {"card": _luhn(_digits(m)) % 10 == 0, "iban": _modulo97(F.concat(F.substring(F.replace(m, F.lit(" "), F.lit("")), F.lit(5), F.length(m)), F.substring(m, 1, 4))) == 1, "date": _date(m).isNotNull()}.get(kind, F.lit(True))
        found = F.when(m.rlike(f"^(?:{pattern})$"), F.when(good, F.lit(kind))).otherwise(found)
    # numbers outside the North American plan keep the digits that put them outside
    return F.when((found == "phone") & ~F.substring(_digits(m), -10, 10).rlike("^[2-9][0-9]{2}[2-9]"), F.lit("digits")).otherwise(found)


def _parts(s: Column) -> Column:
    """kind, match, the parts that the rounds work on, their sizes, and the text part (`body`) between prefix and suffix."""
    m, kind, d = s["m"], s["kind"], _digits(s["m"])
    number = lambda at, n: F.substring(d, at, n).cast("long")
    half = F.floor((F.length(d) - 2) / 2).cast("int")
    octet = lambda n: F.split_part(m, F.lit("."), F.lit(n)).cast("long")
    p = F.substring(d, -10, 10)
    pn = lambda at, n: F.substring(p, at, n).cast("long")
    late = _date(m) >= F.lit("2000-01-01").cast("date")
    day = F.datediff(_date(m), F.when(late, F.lit("2000-01-01")).otherwise(F.lit("1900-01-01")).cast("date"))
    area = number(1, 3)
    power = lambda n: F.pow(F.lit(10.0), n).cast("long")
    rest = F.length(d) - 2
    cases = {
        "intl": (F.substring(d, F.lit(3), half).cast("long"), F.substring(d, half + 3, rest - half).cast("long"), power(half), power(rest - half)),
        "card": (F.substring(d, F.lit(2), half).cast("long"), F.substring(d, half + 2, F.length(d) - 2 - half).cast("long"), power(half), power(F.length(d) - 2 - half)),
        "ipv4": (octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), F.lit(65536), F.lit(65536)),
        "digits": (pn(2, 2) * 100 + pn(7, 2), pn(5, 2) * 100 + pn(9, 2), F.lit(10000), F.lit(10000)),
        "phone": ((pn(1, 3) - 200) * 100 + pn(7, 2), (pn(4, 3) - 200) * 100 + pn(9, 2), F.lit(80000), F.lit(80000)),
        "ssn": ((area - F.when(area < 666, 1).otherwise(2)) * 99 + number(4, 2) - 1, number(6, 4) - 1, F.lit(898 * 99), F.lit(9999)),
        # a century has 92 x 397 days, or 75 x 487
        "date": (F.floor(day / F.when(late, 487).otherwise(397)), day % F.when(late, 487).otherwise(397), F.when(late, F.lit(75)).otherwise(92), F.when(late, F.lit(487)).otherwise(397)),
    }
    out = []
    for n, name in enumerate(("l", "r", "size_l", "size_r")):
        column = F.lit(0).cast("long")
        for k, v in cases.items():
            column = F.when(kind == k, v[n].cast("long")).otherwise(column)
        out.append(column.alias(name))
    prefix = F.when(kind == "key", F.substring(m, 1, 4)).when(kind == "secret", F.regexp_extract(m, r"^(?i:[a-z_-]+ *[:=] *[\"']?)", 0)).otherwise(F.lit(""))
    body = F.when(kind == "iban", F.substring(F.replace(m, F.lit(" "), F.lit("")), F.lit(5), F.length(m))).when(kind == "email", F.substring_index(m, "@", 1)).otherwise(F.substring(m, F.length(prefix) + 1, F.length(m)))
    return F.struct(m.alias("m"), kind.alias("kind"), *out, late.alias("late"), prefix.alias("prefix"), body.alias("body"))


def _written(s: Column) -> Column:
    """The pseudonym of one match."""
    m, kind, t = s["m"], s["kind"], s["t"]
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    size = F.length(_digits(m))
    half = F.floor((size - 2) / 2).cast("int")
    payload = F.concat(F.substring(_digits(m), 1, 1), F.lpad(t["l"].cast("string"), half, F.lit("0")), F.lpad(t["r"].cast("string"), size - 2 - half, F.lit("0")))
    card = _filled(m, F.concat(payload, F.pmod(-_luhn(F.concat(payload, F.lit("0"))), F.lit(10)).cast("string")), "[0-9]")
    intl = _filled(m, F.concat(F.substring(_digits(m), 1, 2), F.lpad(t["l"].cast("string"), half, F.lit("0")), F.lpad(t["r"].cast("string"), size - 2 - half, F.lit("0"))), "[0-9]")
    ipv4 = F.concat_ws(".", F.floor(t["l"] / 256), t["l"] % 256, F.floor(t["r"] / 256), t["r"] % 256)
    head = F.substring(_digits(m), F.lit(1), size - 10)
    phone = _filled(m, F.concat(head, pad(F.floor(t["l"] / 100) + 200, 3), pad(F.floor(t["r"] / 100) + 200, 3), pad(t["l"] % 100, 2), pad(t["r"] % 100, 2)), "[0-9]")
    first = lambda n: F.substring(F.substring(_digits(m), -10, 10), n, 1)
    digits = _filled(m, F.concat(head, first(1), pad(F.floor(t["l"] / 100), 2), first(4), pad(F.floor(t["r"] / 100), 2), pad(t["l"] % 100, 2), pad(t["r"] % 100, 2)), "[0-9]")
    area = F.floor(t["l"] / 99)
    ssn = F.concat_ws("-", pad(area + F.when(area < 665, 1).otherwise(2), 3), pad(t["l"] % 99 + 1, 2), pad(t["r"] + 1, 4))
    day = F.date_add(F.when(s["late"], F.lit("2000-01-01")).otherwise(F.lit("1900-01-01")).cast("date"), (t["l"] * F.when(s["late"], 487).otherwise(397) + t["r"]).cast("int"))
    date = F.date_format(day, "yyyy-MM-dd")
    date = F.when(m.contains("-"), date).when(m.contains("."), F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "MM/dd/yyyy"))
    check = F.lpad((98 - _modulo97(F.concat(s["moved"], F.substring(m, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    iban = _filled(m, F.concat(F.substring(m, 1, 2), check, s["moved"]), "[A-Z0-9]")
    email = F.concat(s["moved"], F.substring(m, F.length(s["moved"]) + 1, F.length(m)))
    out = F.coalesce(F.concat(s["prefix"], s["moved"]), m)
    for k, v in {"card": card, "intl": intl, "ipv4": ipv4, "phone": phone, "digits": digits, "ssn": ssn, "date": date, "iban": iban, "email": email}.items():
        out = F.when(kind == k, v).otherwise(out)
    return F.when(kind.isNull(), m).otherwise(out)


def _replaced(df: DataFrame, secret: str, text: str, sign: int, count: str | None) -> DataFrame:
    if not secret:
        raise ValueError("pseudonyms need a key")
    key = F.col("__key")
    names = [c for c in df.columns if c != count]
    df = df.withColumn("__key", local_table(df.sparkSession, [(secret,)], "key string").scalar())
    t = F.col(f"`{text}`")
    found = F.when(t.rlike(_MAYBE), F.regexp_extract_all(t, F.lit(f"({_ANY})"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    kinds = F.transform(found, lambda m: F.struct(m.alias("m"), _kind(m).alias("kind")))
    parts = F.transform(kinds, _parts)
    fields = ("m", "kind", "late", "prefix")
    rounds = F.transform(
        parts,
        lambda s: F.struct(
            *(s[x].alias(x) for x in fields),
            F.when(s["size_l"] > 0, _numbers(key, s, sign)).alias("t"),
            F.when(s["kind"].isin("iban", "ipv6", "email", "key", "secret"), _letters(key, s, sign)).alias("moved"),
        ),
    )
    made = F.transform(rounds, lambda s: F.struct(_written(s).alias("new"), s["kind"].alias("kind")))
    staged = df.select(*(F.col(f"`{c}`") for c in names), made.alias("__made"))
    new = F.array_join(F.zip_with(F.split(t, _ANY), F.col("__made"), lambda piece, x: F.concat(piece, F.coalesce(x["new"], F.lit("")))), "")
    out = [F.when(F.size("__made") > 0, new).otherwise(t).alias(c) if c == text else F.col(f"`{c}`") for c in names]
    if count:
        out.append(F.size(F.filter("__made", lambda x: x["kind"].isNotNull())).cast("long").alias(count))
    return staged.select(*out)


def pseudonymize(df: DataFrame, key: str, text: str = "text", count: str | None = "n_replaced") -> DataFrame:
    """df with pseudonyms in its texts, and with the number of values replaced."""
    return _replaced(df, key, text, 1, count)


def restore(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """df with the values that pseudonymize() replaced under the same key."""
    return _replaced(df, key, text, -1, None)
