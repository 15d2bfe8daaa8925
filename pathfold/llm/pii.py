"""Format-preserving pseudonyms for personal data, in built-in column functions only.

Spans are found by one alternation of patterns, validated, and replaced by a keyed permutation of their own format:
a Feistel network over two residues (a, b), whose rounds add an HMAC-SHA-256 of (kind, round, other half) under the key to one
of them. It is a bijection of each format, so equal values stay equal in all documents and different ones stay
different, and nobody without the key can go back.

    kind    validated by                            permuted
    card    13-19 digits, Luhn                      all digits but the last, which becomes the new check digit
    iban    country, length, mod 97 = 1             the digits after the check digits, which are computed anew
    ssn     area, group and serial in use           (area, group and serial), again in use
    phone   its layout                              all digits after the country prefix
    ip      four numbers up to 255                  all 32 bits
    date    a real day of the years 1900-2099       the day's number among all of these
    email   its layout                              ASCII letters and digits of the local part, each among their own

Separators, brackets, the domain and everything else keep their places. Values that fail their validation stay. Long
local parts are permuted whole: in parts of PART characters, whose letters go in pieces of 20 and digits of 30.
Defined results: a null text stays null with no finds; null ids are kept; an empty table stays one; an empty text stays empty; rows are changed in place, one
for one, without a shuffle, so repeated rows stay equal; other columns stay as they are, whatever their names; texts of
any length, and addresses of any length in them, are handled in linear time.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "iban", "date", "ip", "ssn", "card", "phone")
ROUNDS = 8

#: Fixed patterns, in the order in which they are tried at a place of the text. All repeats of groups are possessive or
#: bounded, so the matcher's stack does not grow with the text. An address ends with its domain's labels; one of them,
#: after the first, begins with two letters.
LABEL = "[A-Za-z0-9-]"
EMAIL = rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]++@(?={LABEL}(?:{LABEL}++|\.(?={LABEL})(?![A-Za-z]{{2}}))*+\.[A-Za-z]{{2}}){LABEL}++(?:\.{LABEL}++)*+"
#: Lengths of the registered countries' IBANs, so that the next word of the text is not taken for a tail.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|CR|HR|LI|LV", 22: "BG|BH|DE|GB|GE|IE|ME|RS|VA",
    23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM",
    28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}


def _iban_of(length: int, countries: str) -> str:
    fours, rest = divmod(length - 4, 4)
    return f"(?:{countries})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


#: What is not of its country's length is tried in the general form.
IBAN = (
    r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(_iban_of(n, c) for n, c in IBAN_LENGTHS.items())
    + r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
)
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9])"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
PHONE = r"(?<![0-9+])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5})(?![0-9])"
ANY = "(?:" + "|".join((EMAIL, IBAN, DATE, IP, SSN, CARD, PHONE)) + ")"
#: Every pattern needs one of these, so a text without them is not searched.
HINT = "[0-9@]"

FIRST_DAY, DAYS = "1900-01-01", (17, 4297)  # 17 * 4297 = 73049 days up to 2099-12-31
PART = 64  # what an address's local part is at most by the mail standard
AREAS, SERIALS = 898, 99 * 9999  # areas 001-899 without 666; groups 01-99 and serials 0001-9999


def _long(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("bigint")


def keyed(rows: DataFrame, key: str) -> DataFrame:
    """rows with `_mac`, the two padded blocks of an HMAC under the key (UTF-8; hashed where it is longer than a block). The blocks
    are the one row of a table, so neither they nor the key stand in a plan, its JSON, the UI or an event log; they are in the
    closure of the tasks that read that row, and in memory."""
    secret = key.encode()
    block = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    pads = [bytearray(x ^ y for x in block) for y in (0x36, 0x5C)]
    table = rows.sparkSession.createDataFrame([(pads,)], "_mac struct<inner: binary, outer: binary>")
    return rows.crossJoin(F.broadcast(table))  # one row


def mac(key: Column, text: Column) -> Column:
    """HMAC-SHA-256 of text in hexadecimal; key is the column `_mac`."""
    return F.sha2(F.concat(key["outer"], F.unhex(F.sha2(F.concat(key["inner"], F.encode(text, "UTF-8")), 256))), 256)


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, kind: str, key: Column) -> Column:
    """Keyed permutation of the pairs (a, b) with a < size_a, b < size_b, as a struct (a, b)."""

    def digest(half: Column, turn: Column) -> Column:
        text = F.concat_ws("|", F.lit(kind), size_a.cast("string"), size_b.cast("string"), turn.cast("string"), half.cast("string"))
        return F.conv(F.substring(mac(key, text), 1, 13), 16, 10).cast("bigint")

    def turn(acc: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, F.pmod(acc["a"] + digest(acc["b"], i), size_a)).otherwise(acc["a"])
        right = F.when(i % 2 == 1, F.pmod(acc["b"] + digest(acc["a"], i), size_b)).otherwise(acc["b"])
        return F.struct(left.alias("a"), right.alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(_long(a).alias("a"), _long(b).alias("b")), turn)


def _with(value: Column, use) -> Column:
    """use(x) with x bound to value, so that value is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _power(base: int, n: Column) -> Column:
    return F.pow(F.lit(float(base)), n).cast("bigint")


def permute_digits(digits: Column, kind: str, key: Column) -> Column:
    """A string of digits (up to 30), permuted among those of its length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    a, b = F.substring(digits, F.lit(1), u), F.substring(digits, u + 1, n - u)
    mixed = feistel(F.when(u > 0, a).otherwise("0"), b, _power(10, u), _power(10, n - u), kind, key)
    return _with(mixed, lambda m: F.concat(F.when(u > 0, F.lpad(m["a"].cast("string"), u, "0")).otherwise(F.lit("")), F.lpad(m["b"].cast("string"), n - u, "0")))


def _letters_number(letters: Column) -> Column:
    return F.aggregate(F.split(letters, ""), _long(0), lambda acc, c: F.when(c == "", acc).otherwise(acc * 26 + F.ascii(c) - 97))


def _number_letters(number: Column, n: Column) -> Column:
    spelled = F.aggregate(
        F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit("").alias("s"), _long(number).alias("x")),
        lambda acc, i: F.struct(F.concat(F.char(acc["x"] % 26 + 97), acc["s"]).alias("s"), F.floor(acc["x"] / F.lit(26)).cast("bigint").alias("x")),
        lambda acc: acc["s"],
    )
    return spelled


def permute_letters(letters: Column, key: Column) -> Column:
    """Lower-case ASCII letters, permuted among those of their number, in pieces of 20."""

    def permuted(piece: Column) -> Column:
        n = F.length(piece)
        u = F.floor(n / 2).cast("int")
        a, b = F.substring(piece, F.lit(1), u), F.substring(piece, u + 1, n - u)
        mixed = feistel(_letters_number(a), _letters_number(b), _power(26, u), _power(26, n - u), "letters", key)
        return _with(mixed, lambda m: F.concat(_number_letters(m["a"], u), _number_letters(m["b"], n - u)))

    return F.array_join(F.transform(F.regexp_extract_all(letters, F.lit("[a-z]{1,20}"), F.lit(0)), permuted), "")


def _fill(shape: Column, chars: Column, kind: str) -> Column:
    """shape with the characters that match `kind` replaced by those of chars, in order."""
    return F.aggregate(
        F.split(shape, ""),
        F.struct(F.lit("").alias("s"), F.lit(1).alias("k")),
        lambda acc, c: F.when(c.rlike(kind), F.struct(F.concat(acc["s"], F.substring(chars, acc["k"], F.lit(1))).alias("s"), (acc["k"] + 1).alias("k"))).otherwise(
            F.struct(F.concat(acc["s"], c).alias("s"), acc["k"].alias("k"))
        ),
        lambda acc: acc["s"],
    )


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of all digits, the last one counted once."""

    def add(acc: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((acc["t"] + F.when(acc["o"], twice).otherwise(d)).alias("t"), (~acc["o"]).alias("o"))

    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(chars, F.struct(F.lit(0).alias("t"), F.lit(False).alias("o")), add, lambda acc: acc["t"])


def mod97(text: Column) -> Column:
    """Remainder of the number that digits and letters (A = 10) spell."""

    def add(acc: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(c == "", acc).otherwise((acc * F.when(v > 9, 100).otherwise(10) + v) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _in_years(iso: Column) -> Column:
    day = F.try_to_date(iso, "yyyy-MM-dd")
    return F.when(day.between(F.lit(FIRST_DAY).cast("date"), F.lit("2099-12-31").cast("date")), day)


def _day_first(s: Column) -> Column:
    """The day of a date in any of the layouts, or null; where the year is last, day and month are read in that order."""
    year_first = F.translate(F.substring(s, 1, 10), "/", "-")
    return _in_years(F.when(s.rlike("^[0-9]{4}[-/]"), year_first).otherwise(F.concat_ws("-", F.substring(s, 7, 4), F.substring(s, 4, 2), F.substring(s, 1, 2))))


def _month_first(s: Column) -> Column:
    return F.when(s.rlike("^[0-9]{2}[./]"), _in_years(F.concat_ws("-", F.substring(s, 7, 4), F.substring(s, 1, 2), F.substring(s, 4, 2))))


def _valid_date(s: Column) -> Column:
    """The day, or null. A year-last date is read month first where day first it is none."""
    return F.coalesce(_day_first(s), _month_first(s))


def kind_of(s: Column) -> Column:
    """Kind of a found string, or null where it fails its validation."""
    octets = F.transform(F.split(s, r"\."), lambda x: x.cast("int"))
    flat = F.regexp_replace(s, "[ -]", "")
    return (
        F.when(F.contains(s, F.lit("@")), "email")
        .when(s.rlike("^[A-Z]{2}"), F.when(F.length(flat).between(15, 34) & (mod97(F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, 1, 4))) == 1), "iban"))
        .when(s.rlike(f"^(?:{DATE})$"), F.when(_valid_date(s).isNotNull(), "date"))
        .when(s.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), F.when(F.forall(octets, lambda x: x <= 255), "ip"))
        .when(
            s.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
            F.when(~F.substring(s, 1, 3).isin("000", "666") & (F.substring(s, 1, 1) != "9") & (F.substring(s, 5, 2) != "00") & (F.substring(s, 8, 4) != "0000"), "ssn"),
        )
        .when(s.rlike(f"^(?:{CARD})$"), F.when(luhn_sum(_digits(s)) % 10 == 0, "card"))
        .otherwise("phone")
    )


def _card(s: Column, key: Column) -> Column:
    digits = _digits(s)
    payload = permute_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), "card", key)
    return _with(payload, lambda p: _fill(s, F.concat(p, ((10 - luhn_sum(F.concat(p, F.lit("0"))) % 10) % 10).cast("string")), "[0-9]"))


def _iban(s: Column, key: Column) -> Column:
    flat = F.regexp_replace(s, " ", "")
    country, rest = F.substring(flat, 1, 2), F.substring(flat, F.lit(5), F.length(flat))
    numbers = _digits(rest)
    account = F.when(F.length(numbers) > 0, _fill(rest, permute_digits(numbers, "iban", key), "[0-9]")).otherwise(rest)

    def build(account: Column) -> Column:
        check = F.lpad((98 - mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
        return _fill(s, F.concat(country, check, account), "[A-Z0-9]")

    return _with(account, build)


def _ssn(s: Column, key: Column) -> Column:
    area = F.substring(s, 1, 3).cast("int")
    serial = (F.substring(s, 5, 2).cast("int") - 1) * 9999 + F.substring(s, 8, 4).cast("int") - 1
    mixed = feistel(area - 1 - (area > 666).cast("int"), serial, _long(AREAS), _long(SERIALS), "ssn", key)

    def build(m: Column) -> Column:
        place = m["a"] + 1
        return F.concat_ws("-", F.lpad((place + (place >= 666).cast("int")).cast("string"), 3, "0"), F.lpad((F.floor(m["b"] / F.lit(9999)) + 1).cast("string"), 2, "0"), F.lpad((m["b"] % 9999 + 1).cast("string"), 4, "0"))

    return _with(mixed, build)


def _ip(s: Column, key: Column) -> Column:
    part = lambda i: F.element_at(F.split(s, r"\."), i).cast("bigint")
    mixed = feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), _long(65536), _long(65536), "ip", key)
    octet = lambda x: (F.floor(x / F.lit(256)).cast("string"), (x % 256).cast("string"))
    return _with(mixed, lambda m: F.concat_ws(".", *octet(m["a"]), *octet(m["b"])))


def _date(s: Column, key: Column) -> Column:
    first = F.lit(FIRST_DAY).cast("date")

    def moved(day: Column) -> Column:
        number = F.datediff(day, first)
        mixed = feistel(F.floor(number / F.lit(DAYS[1])), number % DAYS[1], _long(DAYS[0]), _long(DAYS[1]), "date", key)
        return _with(mixed, lambda m: F.date_add(first, (m["a"] * DAYS[1] + m["b"]).cast("int")))

    def text(day: Column) -> Column:
        layout = lambda p: F.date_format(day, p)
        return F.when(s.rlike("^[0-9]{4}-"), layout("yyyy-MM-dd")).when(s.rlike("^[0-9]{4}/"), layout("yyyy/MM/dd")).when(s.rlike("/"), layout("dd/MM/yyyy")).otherwise(layout("dd.MM.yyyy"))

    # Days after the 12th can only be month first: they are moved until they are such a day again, so both readings stay apart.
    again = F.aggregate(F.sequence(F.lit(1), F.lit(64)), moved(_month_first(s)), lambda day, _: F.when(F.dayofmonth(day) > 12, day).otherwise(moved(day)))
    american = _with(again, lambda day: F.when(s.rlike("/"), F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "MM.dd.yyyy")))
    return F.when(_day_first(s).isNotNull(), _with(moved(_day_first(s)), text)).otherwise(american)


def _phone(s: Column, key: Column) -> Column:
    prefix = F.regexp_extract(s, r"^(\+[0-9]{1,3}(?=[ .(-])|\+[0-9]{2})?", 0)
    rest = F.substring(s, F.length(prefix) + 1, F.length(s))
    return F.concat(prefix, _fill(rest, permute_digits(_digits(rest), "phone", key), "[0-9]"))


def _local_part(part: Column, key: Column) -> Column:
    """Letters are permuted as lower-case ones and keep the case of their places, so different parts stay different."""
    letters, numbers = F.regexp_replace(part, "[^A-Za-z]", ""), _digits(part)
    cased = _with(permute_letters(F.lower(letters), key), lambda new: F.array_join(F.zip_with(F.split(letters, ""), F.split(new, ""), lambda old, c: F.when(old.rlike("[A-Z]"), F.upper(c)).otherwise(c)), ""))
    spelled = F.when(F.length(letters) > 0, _fill(part, cased, "[A-Za-z]")).otherwise(part)
    moved = F.array_join(F.transform(F.regexp_extract_all(numbers, F.lit("[0-9]{1,30}"), F.lit(0)), lambda x: permute_digits(x, "email", key)), "")
    return F.when(F.length(numbers) > 0, _fill(spelled, moved, "[0-9]")).otherwise(spelled)


def _email(s: Column, key: Column) -> Column:
    local = F.substring_index(s, "@", 1)
    parts = F.regexp_extract_all(local, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    new = F.array_join(F.transform(parts, lambda x: _local_part(x, key)), "")
    # A local part that is all other letters, or that the permutation maps to itself, gets digits of its digest.
    digest = F.conv(F.substring(mac(key, F.concat(F.lit("email|"), s)), 1, 10), 16, 10)
    return F.concat(_with(new, lambda n: F.when(n == local, F.concat(F.lit("u"), digest)).otherwise(n)), F.lit("@"), F.substring_index(s, "@", -1))


def pseudonym(s: Column, kind: Column, key: Column) -> Column:
    made = F.when(kind == "email", _email(s, key))
    for name, make in (("iban", _iban), ("date", _date), ("ip", _ip), ("ssn", _ssn), ("card", _card), ("phone", _phone)):
        made = made.when(kind == name, make(s, key))
    return made.otherwise(s)


def _is(kind: str):
    return lambda x: x["kind"] == kind


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", counts: bool = True) -> DataFrame:
    """docs with its text pseudonymised; if asked for, also pii_count and pii_kinds (n_<kind> fields in a struct)."""
    text = F.col(text_col)
    names = docs.columns
    searched = F.coalesce(text.rlike(HINT), F.lit(False))
    empty = F.array().cast("array<string>")
    held = docs.select(F.struct("*").alias("_row"), text.alias("_text"), F.when(searched, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(empty).alias("_found"))
    typed = keyed(held, key).withColumn("_found", F.transform("_found", lambda s: F.struct(s.alias("old"), kind_of(s).alias("kind"))))
    made = typed.withColumn("_found", F.transform("_found", lambda x: F.struct(x["kind"].alias("kind"), pseudonym(x["old"], x["kind"], F.col("_mac")).alias("new"))))
    between = F.split("_text", ANY, -1)
    pieces = F.zip_with(between, F.col("_found"), lambda a, b: F.concat(a, F.coalesce(b["new"], F.lit(""))))
    new = F.when(F.size("_found") > 0, F.array_join(pieces, "")).otherwise(F.col("_text"))
    columns = [new.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in names]
    if counts:
        columns.append(F.size(F.filter("_found", lambda x: x["kind"].isNotNull())).cast("bigint").alias("pii_count"))
        columns.append(F.struct(*[F.size(F.filter("_found", _is(k))).cast("bigint").alias(f"n_{k}") for k in KINDS]).alias("pii_kinds"))
    return made.select(*columns)
