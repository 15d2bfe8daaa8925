"""Forms of personal data that the given tables do not hold."""

import datetime
import hmac
import random
import re

from pyspark.sql import functions as F

from pathfold.llm import pii


def changed(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {texts[r.doc_id]: (r.text, r.pii_count) for r in pii.pseudonymize(df, "k").collect()}


def test_pii_iban_before_a_word(spark):
    ibans = {"ES91 2100 0418 4502 0005 1332": " EUR", "ES9121000418450200051332": " 2024", "AT61 1904 3002 3457 3201": " 12", "DE89 3704 0044 0532 0130 00": " EUR"}
    for text, (new, n) in changed(spark, *[a + b for a, b in ibans.items()]).items():
        tail = next(b for a, b in ibans.items() if a + b == text)
        assert n == 1 and new.endswith(tail) and new != text and new[:2] == text[:2]


def test_pii_month_first(spark):
    days = spark.range(0, 73049).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d")).where("day(d) > 12 AND id % 5 = 0")
    old = days.select(F.date_format("d", "MM/dd/yyyy").alias("s"))
    new = pii.keyed(old, "k").select("s", pii._date(F.col("s"), F.col("_mac")).alias("t"), pii.kind_of(F.col("s")).alias("kind")).collect()
    assert {r.kind for r in new} == {"date"} and len({r.t for r in new}) == len(new)
    assert all(int(r.t[:2]) <= 12 < int(r.t[3:5]) for r in new)
    (text, n), = changed(spark, "on 03.25.2021 it").values()
    assert n == 1 and text != "on 03.25.2021 it"


def test_pii_long_local_part(spark):
    local = "abcdefghijklmnopqrst" + "uvwxyzabcdefghijklmnop" + "qrs"
    (text, n), = changed(spark, local + "@example.org").values()
    assert n == 1 and len(text) == len(local) + 12 and local[20:40] not in text and not text.split("@")[0].endswith(local[40:])


def test_pii_extreme_addresses(spark):
    domain = "x@" + "a." * 500_000 + "com"
    local, digits = "abcdefghij" * 6 + "." + "k" * 40, "1" * 40
    out = changed(spark, domain, local + "@example.org", digits + "@a.org", "mail bob@example.com. Next", "a@192.168.0.1 b", "a@b..com", "say bob@example.com.1 now")
    assert out[domain][1] == 1 and out[domain][0].endswith(domain[2:]) and len(out[domain][0]) == len(domain)
    new = out[local + "@example.org"][0].split("@")[0]
    assert len(new) == len(local) and not any(new[i : i + 10] == local[i : i + 10] for i in range(len(local) - 9))
    assert out[digits + "@a.org"][1] == 1 and "111111" not in out[digits + "@a.org"][0]
    assert out["mail bob@example.com. Next"][0].endswith("@example.com. Next") and out["a@b..com"] == ("a@b..com", 0)
    assert out["say bob@example.com.1 now"][0].endswith("@example.com.1 now") and out["say bob@example.com.1 now"][0] != "say bob@example.com.1 now"
    assert out["a@192.168.0.1 b"][1] == 1 and "192.168.0.1" not in out["a@192.168.0.1 b"][0]


# -- a plain version of the permutations ------------------------------------------------------------------------------


def feistel(a, b, size_a, size_b, kind, key="k"):
    for i in range(pii.ROUNDS):
        half = b if i % 2 == 0 else a
        d = int(hmac.new(key.encode(), "|".join([kind, str(size_a), str(size_b), str(i), str(half)]).encode(), "sha256").hexdigest()[:13], 16)
        a, b = ((a + d) % size_a, b) if i % 2 == 0 else (a, (b + d) % size_b)
    return a, b


def digits_of(s, kind):
    u, w = len(s) // 2, len(s) - len(s) // 2
    a, b = feistel(int(s[:u] or 0), int(s[u:]), 10**u, 10**w, kind)
    return (f"{a:0{u}d}" if u else "") + f"{b:0{w}d}"


def letters_of(s):
    number = lambda t: int("".join("0123456789abcdefghijklmnop"[ord(c) - 97] for c in t) or "0", 26)

    def spell(x, n):
        return "".join(chr(97 + x // 26 ** (n - 1 - i) % 26) for i in range(n))

    u = len(s) // 2
    a, b = feistel(number(s[:u]), number(s[u:]), 26**u, 26 ** (len(s) - u), "letters")
    return spell(a, u) + spell(b, len(s) - u)


def filled(shape, new, kind):
    it = iter(new)
    return "".join(next(it) if re.match(kind, c) else c for c in shape)


def cut(s, n):
    return [s[i : i + n] for i in range(0, len(s), n)]


def check_digit(payload):
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(payload)))
    return str(-total % 10)


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def plain(kind, s):
    if kind == "card":
        p = digits_of(re.sub("[^0-9]", "", s)[:-1], "card")
        return filled(s, p + check_digit(p), "[0-9]")
    if kind == "ssn":
        area, serial = int(s[:3]), (int(s[4:6]) - 1) * 9999 + int(s[7:]) - 1
        a, b = feistel(area - 1 - (area > 666), serial, 898, 99 * 9999, "ssn")
        return f"{a + 1 + (a + 1 >= 666):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    if kind == "ip":
        w = [int(x) for x in s.split(".")]
        a, b = feistel(w[0] * 256 + w[1], w[2] * 256 + w[3], 65536, 65536, "ip")
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if kind == "date":
        first = datetime.date(1900, 1, 1)
        n = (datetime.date.fromisoformat(s) - first).days
        a, b = feistel(n // 4297, n % 4297, 17, 4297, "date")
        return str(first + datetime.timedelta(days=a * 4297 + b))
    if kind == "phone":
        prefix = re.match(r"(\+[0-9]{1,3}(?=[ .(-])|\+[0-9]{2})?", s).group()
        rest = s[len(prefix) :]
        return prefix + filled(rest, digits_of(re.sub("[^0-9]", "", rest), "phone"), "[0-9]")
    if kind == "iban":
        flat = s.replace(" ", "")
        account = filled(flat[4:], digits_of(re.sub("[^0-9]", "", flat[4:]), "iban"), "[0-9]")
        return filled(s, f"{flat[:2]}{98 - mod97(account + flat[:2] + '00'):02d}{account}", "[A-Z0-9]")
    local, domain = s.split("@")
    out = ""
    for part in cut(local, 64):
        letters = re.sub("[^A-Za-z]", "", part)
        moved = "".join(map(letters_of, cut(letters.lower(), 20)))
        part = filled(part, "".join(n.upper() if o.isupper() else n for o, n in zip(letters, moved, strict=True)), "[A-Za-z]")
        out += filled(part, "".join(digits_of(x, "email") for x in cut(re.sub("[^0-9]", "", part), 30)), "[0-9]")
    return f"{out}@{domain}"


def test_pii_equals_a_plain_version(spark):
    """Ten thousand values of all kinds, each alone in its text."""
    r = random.Random(5)
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    values = []
    for i in range(10_000):
        kind = pii.KINDS[i % 7]
        if kind == "card":
            p = some("0123456789", r.randint(12, 18))
            v = p + check_digit(p)
            v = "-".join(cut(v, 4)) if len(v) == 16 and r.random() < 0.5 else v
        elif kind == "ssn":
            v = f"{r.choice([1, 123, 665, 667, 899]):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"
        elif kind == "ip":
            v = ".".join(str(r.randrange(256)) for _ in range(4))
        elif kind == "date":
            v = str(datetime.date(1900, 1, 1) + datetime.timedelta(days=r.randrange(73049)))
        elif kind == "phone":
            v = r.choice([f"({some('23456789', 3)}) {some('0123456789', 3)}-{some('0123456789', 4)}", f"+{r.randint(1, 99)} {some('23456789', 3)} {some('0123456789', 3)} {some('0123456789', 4)}"])
        elif kind == "iban":
            account = some("0123456789", 18)
            v = f"DE{98 - mod97(account + 'DE00'):02d}{account}"
            v = " ".join(cut(v, 4)) if r.random() < 0.5 else v
        else:
            v = some("abcdefghijklmNOPqrstuvwxyz0123456789._+-", r.randint(3, 90)).replace("..", "xy") + "q@" + some("abcdefgh", 6) + ".org"
        values.append((i, kind, v))
    df = spark.createDataFrame([(i, v) for i, _, v in values], "doc_id long, text string")
    got = {x.doc_id: x for x in pii.pseudonymize(df, "k").collect()}
    wrong = [(kind, v, got[i].text, plain(kind, v)) for i, kind, v in values if got[i].text != plain(kind, v) or got[i].pii_kinds[f"n_{kind}"] != 1]
    assert not wrong, wrong[:5]
