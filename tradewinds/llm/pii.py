"""Personal data to format-preserving pseudonyms, in Column expressions only.

Validated numbers (payment cards, IBANs, social security numbers, telephone numbers, IP addresses) and dates are permuted
within their format by a keyed Feistel network, so a value has the same pseudonym in every document and keeps its separators
and check digits; a date or social security number stays a possible one. E-mail addresses and secrets become keyed hashes of
the same kind of characters. A number that fails its check (a card's last digit, an octet over 255, a 31st of June) is left
alone. The key is the caller's; nothing here has a default one.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns

ROUNDS = 8
#: The dates that are permuted among themselves: 1900 to 2099.
FIRST_DAY, DAYS = "1900-01-01", 73049

# The length of an IBAN by country, and the months.
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FO=18, FR=27, GB=22, GE=22,
    GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27, MD=24, ME=22, MK=19, MR=27,
    MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, SA=24, SC=31, SE=24, SI=19, SK=24, SM=27, ST=25, SV=28, TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20,
)
MONTHS = "January February March April May June July August September October November December".split()


def _iban_form() -> str:
    by_length = defaultdict(list)
    for country, n in IBAN_LENGTHS.items():
        by_length[n].append(country)
    # each country's own length, so that what follows is not taken in; letters of either case
    known = "|".join(rf"(?:{'|'.join(of)})\d{{2}}(?:[ -]?[A-Z0-9]){{{n - 4}}}" for n, of in sorted(by_length.items()))
    return rf"(?<![\p{{L}}\p{{N}}])(?i:{known})(?![\p{{L}}\p{{N}}])"


EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.){1,64}\p{L}{2,}(?![\p{L}\p{N}])"
#: A named secret: in quotes, or a run of eight characters with a digit or of sixteen; web tokens and cloud keys by their form.
SECRET = (
    r"(?<![\p{L}\p{N}])(?i:token|secret|password|passwd|passphrase|bearer|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key)\s{0,3}[=:]\s{0,3}"
    r"(?:\"[^\"\r\n]{8,}+\"|'[^'\r\n]{8,}+'|(?=[A-Za-z0-9_./+=~-]{16}|[A-Za-z_./+=~-]{0,15}[0-9])[A-Za-z0-9_./+=~-]{7,}[A-Za-z0-9_/+=~-])"
    r"|(?<![\p{L}\p{N}])(?i:bearer)\s{1,3}(?=[A-Za-z0-9_./+=~-]{16}|[A-Za-z_./+=~-]{0,15}[0-9])[A-Za-z0-9_./+=~-]{7,}[A-Za-z0-9_/+=~-]"
    r"|(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9_-]{20,}+|gh[pousr]_[A-Za-z0-9]{20,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++)(?![\p{L}\p{N}])"
)
#: A name and a password before a host; the password is hidden.
LOGIN = r"(?<![\p{L}\p{N}])[A-Za-z][A-Za-z0-9+.-]{1,20}+://[^\s:/@]{1,}+:[^\s/@]{1,}+@"
IBAN = _iban_form()
PHONE = r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\p{L}\p{N}])"
WORLD_PHONE = r"(?<![\p{L}\p{N}+])\+[1-9](?:\d{7,14}|\d{0,2}(?:[ .-]\(?\d{1,10}\)?){1,5})(?![\p{L}\p{N}])|(?<![\p{L}\p{N}+])00[1-9]\d{0,2}(?:[ .-]\(?\d{1,10}\)?){2,5}(?![\p{L}\p{N}])"
SSN = r"(?<![\p{L}\p{N}-])\d{3}(?:-\d{2}-| \d{2} )\d{4}(?![\p{L}\p{N}-])"
IP = r"(?<![\p{L}\p{N}.])\d{1,3}(?:\.\d{1,3}){3}(?![\p{L}\p{N}])(?!\.\d)"
#: Either all eight groups or a double colon, at least two groups, one of them with a digit.
IP6 = r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}|(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4}:){0,5})[0-9A-Fa-f]{1,4}(?![\p{L}\p{N}:])(?!\.\d)"
_MONTH = "(?i:" + "|".join(f"{m}|{m[:3]}" if len(m) > 3 else m for m in MONTHS) + r")\b"
_NAMED_DATE = rf"(?<![\p{{L}}\p{{N}}]){_MONTH}\.? \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}}(?![\p{{L}}\p{{N}}])"
DATE = (
    r"(?<![\p{L}\p{N}./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4}|\d{1,2}(?:st|nd|rd|th)?\.? (?:of )?" + _MONTH
    + r"\.?,? \d{4})(?!(?!T\d\d)[\p{L}\p{N}])(?![./-]\d)"
)
#: Groups of digits in which cards are looked for, up to where another kind of number begins; a card has 13 to 19 digits. A
#: run is ended after 200 digits, as Java's matcher recurs for each.
CARD = (
    r"(?<![\p{L}\p{N}])(?<!\d[.-])\d(?:\d|[ -](?!(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4}|\d{3}-\d{2}-\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4}|\d{1,3}(?:\.\d{1,3}){3})(?![\p{L}\p{N}]))\d){12,200}"
    r"(?![\p{L}\p{N}])(?![.-]\d)|(?<![\p{L}\p{N}.])\d{4}\.\d{4}\.\d{4}\.\d{4}(?![\p{L}\p{N}])(?!\.\d)"
)
#: In this order: at one place the first that fits is taken.
KINDS = {
    "email": EMAIL, "login": LOGIN, "secret": SECRET, "ip6": IP6, "ip": IP, "date": f"{DATE}|{_NAMED_DATE}", "ssn": SSN, "phone": PHONE, "card": CARD, "iban": IBAN, "world_phone": WORLD_PHONE
}
_NUMBERS = [IP, DATE, SSN, PHONE, CARD, WORLD_PHONE]
ANY = (
    f"{EMAIL}|{LOGIN}|(?=[TtSsPpAaBbeg])(?:{SECRET})|(?=[0-9A-Fa-f]{{1,4}}:)(?:{IP6})|(?=[0-9+(])(?:{'|'.join(_NUMBERS)})"
    f"|(?=[A-Za-z]{{2}}[0-9])(?:{IBAN})|(?=[JFMASONDjfmasond])(?:{_NAMED_DATE})"
)


def digest(key: str, *parts: Column) -> Column:
    """SHA-256 of the key and the parts, in hex."""
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)


def mixed(key: str, *parts: Column) -> Column:
    """60 bits of :func:`digest` as a long."""
    return F.conv(F.substring(digest(key, *parts), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, wide: Column, high: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of the pairs (left below ``wide``, right below ``high``), as a struct l, r."""

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        f = mixed(key, tweak, i, F.when(even, s["r"]).otherwise(s["l"]))
        return F.struct(
            F.when(even, (s["l"] + f % wide) % wide).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise((s["r"] + f % high) % high).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings of 2 to 34 digits of the same length."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    pair = feistel(
        F.substring(digits, F.lit(1), a).cast("long"), F.substring(digits, a + 1, n - a).cast("long"),
        F.pow(F.lit(10.0), a).cast("long"), F.pow(F.lit(10.0), n - a).cast("long"), key, F.concat(F.lit(kind), n.cast("string")),
    )
    return F.concat(F.lpad(pair["l"].cast("string"), a, "0"), F.lpad(pair["r"].cast("string"), n - a, "0"))


def refill(form: Column, digits: Column, of: str = "[0-9]") -> Column:
    """``form`` with its digits (characters ``of``) replaced, in order, by those of ``digits``."""

    def put(s: Column, c: Column) -> Column:
        isdigit = c.rlike(of)
        return F.struct(
            F.concat(s["t"], F.when(isdigit, F.substring(digits, s["k"], F.lit(1))).otherwise(c)).alias("t"), (s["k"] + isdigit.cast("int")).alias("k")
        )

    return F.aggregate(F.split(form, ""), F.struct(F.lit("").alias("t"), F.lit(1).alias("k")), put)["t"]


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits whose last is the check digit, modulo 10."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(d, F.lit(0), lambda s, x: s + x) % 10


def mod97(letters: Column) -> Column:
    """An IBAN's remainder: its first four characters moved to the end, letters as 10 to 35."""
    moved = F.concat(F.substring(letters, F.lit(5), F.length(letters)), F.substring(letters, 1, 4))

    def step(s: Column, c: Column) -> Column:
        v = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (s * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _cards(run: Column) -> Column:
    """The cards in a run of groups of digits, as structs (from, n: which digits of the run; d: these), none overlapping.

    All stretches of whole groups with 13 to 19 digits are tried; the longest that meet the check go first, among these
    those that begin like a card (3 to 6), then the first.
    """

    def tried(d: Column, ends: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), ends)
        some = lambda a: F.transform(
            F.filter(ends, lambda b: (b - a).between(13, 19)), lambda b: F.struct((a - b).alias("less"), (~F.substring(d, a + 1, F.lit(1)).between("3", "6")).alias("other"), a.alias("from"), F.substring(d, a + 1, b - a).alias("d"))
        )
        return F.array_sort(F.filter(F.flatten(F.transform(starts, some)), lambda x: (luhn(x["d"]) == 0) & x["d"].rlike("[1-9]")))

    def take(s: Column, x: Column) -> Column:
        free = ~F.exists(s, lambda y: (x["from"] < y["from"] - y["less"]) & (y["from"] < x["from"] - x["less"]))
        return F.when(free, F.array_append(s, x)).otherwise(s)

    sizes = F.transform(F.regexp_extract_all(run, F.lit(r"(\d+)"), 1), F.length)
    none = F.array().cast("array<struct<less:int,other:boolean,from:int,d:string>>")
    ends = F.aggregate(sizes, F.array().cast("array<int>"), lambda s, n: F.array_append(s, F.coalesce(F.element_at(s, F.when(F.size(s) > 0, -1)), F.lit(0)) + n))
    return _let(ends, lambda e: F.aggregate(tried(_digits(run), e), none, take))


def _card(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        body = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        return F.concat(body, ((10 - luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))

    def all_new(cards: Column) -> Column:
        return F.aggregate(cards, _digits(m), lambda s, x: F.overlay(s, new(x["d"]), x["from"] + 1))

    return _let(_cards(m), lambda cards: F.when(F.size(cards) > 0, refill(m, all_new(cards))))


def _let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), f)[0]


def _iban(m: Column, key: str) -> Column:
    def new(x: Column) -> Column:
        body = F.substring(x, F.lit(5), F.length(x))
        n = F.length(_digits(body))
        other = F.when(n >= 2, refill(body, permute_digits(_digits(body), key, "iban"))).otherwise(body)

        def checked(b: Column) -> Column:
            check = 98 - mod97(F.concat(F.substring(x, 1, 2), F.lit("00"), b))
            return F.concat(F.substring(x, 1, 2), F.lpad(check.cast("string"), 2, "0"), b)

        return _let(other, checked)

    # letters stay as they are, so in m's spacing and case only digits are new
    plain = F.upper(F.translate(m, " -", ""))
    return _let(plain, lambda x: F.when(mod97(x) == 1, refill(m, _digits(new(x)))))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups from 01, serials from 0001: numbered without gaps and permuted."""
    part = lambda a, n: F.substring(m, a, n).cast("int")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    fits = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    left = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1

    def written(p: Column) -> Column:
        a = F.floor(p["l"] / 99).cast("int")
        a = a + F.when(a >= 665, 2).otherwise(1)
        parts = [F.lpad(x.cast("string"), n, "0") for x, n in ((a, 3), (p["l"] % 99 + 1, 2), (p["r"] + 1, 4))]
        return F.concat(parts[0], F.substring(m, 4, 1), parts[1], F.substring(m, 4, 1), parts[2])

    return F.when(fits, _let(feistel(left, serial - 1, F.lit(898 * 99), F.lit(9999), key, F.lit("ssn")), written))


def _phone(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        return F.concat(F.substring(d, F.lit(1), F.length(d) - 10), permute_digits(F.substring(d, F.length(d) - 9, F.lit(10)), key, "phone"))

    return _let(_digits(m), lambda d: F.when(F.length(d) >= 10, refill(m, new(d))))


def _world_phone(m: Column, key: str) -> Column:
    def new(d: Column, code: Column) -> Column:
        return F.concat(F.substring(d, F.lit(1), code), permute_digits(F.substring(d, code + 1, F.length(d)), key, "phone"))

    # without separators the code's length isn't known; one digit for 1 and 7, else two
    plus = F.regexp_replace(m, "^00", "+")  # 00 is the plus sign of a dial
    code = F.length(F.regexp_extract(plus, r"^\+(\d{1,3}(?!\d)|[17]|\d{2})", 1))
    return _let(_digits(plus), lambda d: F.when(F.length(d).between(8, 15), refill(m, F.concat(F.when(m.startswith("00"), "00").otherwise(""), new(d, code)))))


def _ip(m: Column, key: str) -> Column:
    def new(o: Column) -> Column:
        pair = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, F.lit("ip"))
        part = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
        return _let(pair, lambda p: F.concat_ws(".", part(p["l"]), part(p["r"])))

    return _let(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), lambda o: F.when(F.forall(o, lambda x: x <= 255), new(o)))


def _ip6(m: Column, key: str) -> Column:
    """The hex digits permuted in their places (but for the first two of 31 or 32); notations of one address aren't linked."""
    hexes = F.replace(F.lower(m), F.lit(":"), F.lit(""))

    def new(d: Column) -> Column:
        fixed = F.greatest(F.length(d) - 30, F.lit(0))
        own = F.substring(d, fixed + 1, F.length(d))
        n = F.length(d) - fixed
        a = F.floor(n / 2).cast("int")
        number = lambda x: F.conv(x, 16, 10).cast("long")
        pair = feistel(number(F.substring(own, F.lit(1), a)), number(F.substring(own, a + 1, n - a)), F.pow(F.lit(16.0), a).cast("long"), F.pow(F.lit(16.0), n - a).cast("long"), key, F.concat(F.lit("ip6"), n.cast("string")))
        text = lambda x, k: F.lpad(F.lower(F.hex(x)), k, "0")
        return _let(pair, lambda p: F.concat(F.substring(d, F.lit(1), fixed), text(p["l"], a), text(p["r"], n - a)))

    return _let(hexes, lambda d: F.when(F.length(d) >= 2, refill(m, new(d), "[0-9A-Fa-f]")))


def _date(m: Column, key: str) -> Column:
    """A date in any of the forms, in the same form; one without leading zeros gets none. 31/12 is day first, 12/31 month
    first; where both fit, day first."""
    iso = m.rlike("^[0-9]{4}[-/]")
    numbers = F.transform(F.regexp_extract_all(m, F.lit("[0-9]+"), 0), lambda x: x.cast("int"))
    name = F.regexp_extract(m, "([A-Za-z]{3,})", 1)
    named = name != ""
    month = F.array_position(F.array(*[F.lit(x[:3].lower()) for x in MONTHS]), F.lower(F.substring(name, 1, 3))).cast("int")
    wide, high = 270, 271

    def step(s: Column) -> Column:
        pair = feistel(F.floor(s / high), s % high, F.lit(wide), F.lit(high), key, F.lit("date"))
        return _let(pair, lambda p: p["l"] * high + p["r"])

    def new(n: Column) -> Column:  # again while the result is no date; two in a thousand steps are not
        return F.aggregate(F.sequence(F.lit(1), F.lit(8)), step(n), lambda s, _: F.when(s >= DAYS, step(s)).otherwise(s))

    def parts(n: Column) -> Column:
        flip = ~iso & ~named & (n[1] > 12)
        day = F.when(iso, n[2]).when(named | ~flip, n[0]).otherwise(n[1])
        mon = F.when(iso | (~named & ~flip), n[1]).when(named, month).otherwise(n[0])
        year = F.when(iso, n[0]).when(named, n[1]).otherwise(n[2])
        text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(mon.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
        return F.struct(F.datediff(text.try_cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long").alias("n"), flip.alias("flip"))

    def written(day: Column, flip: Column) -> Column:
        d = F.date_add(F.lit(FIRST_DAY).cast("date"), day.cast("int"))
        padded = ~m.rlike(r"(?<![0-9])[1-9](?![0-9])")
        digits = lambda x: F.when(padded, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
        dd, mm, yyyy = digits(F.dayofmonth(d)), digits(F.month(d)), F.year(d).cast("string")
        sep = F.regexp_extract(m, "([./-])", 1)
        full = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(d))
        spelt = F.when((F.length(name) > 3) | (F.lower(name) == "may"), full).otherwise(F.substring(full, 1, 3))
        spelt = F.when(name == F.upper(name), F.upper(spelt)).when(name == F.lower(name), F.lower(spelt)).otherwise(spelt)
        # the day and the year in m's place, then the month: the replacement holds no digit that would be met again
        in_words = F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "[0-9]{4}$", F.lit("\u0001")), r"[0-9]{1,2}(?:st|nd|rd|th)?", F.lit("\u0002")), "[A-Za-z]{3,}", F.lit("\u0003"))
        in_words = F.replace(F.replace(F.replace(in_words, F.lit("\u0001"), yyyy), F.lit("\u0002"), dd), F.lit("\u0003"), spelt)
        plain = F.when(flip, F.concat(mm, sep, dd, sep, yyyy)).otherwise(F.concat(dd, sep, mm, sep, yyyy))
        return F.when(named, in_words).when(iso, F.concat(yyyy, sep, mm, sep, dd)).otherwise(plain)

    return _let(_let(numbers, parts), lambda x: F.when(x["n"].between(0, DAYS - 1), _let(new(x["n"]), lambda day: written(day, x["flip"]))))


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("user-"), F.substring(digest(key, F.lit("email"), F.lower(m)), 1, 16), F.lit("@example.invalid"))


def _hidden(v: Column, key: str) -> Column:
    long = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(v) / 64).cast("int")), lambda k: digest(key, F.lit("secret"), k, v)), "")
    return F.substring(long, F.lit(1), F.length(v))


def _login(m: Column, key: str) -> Column:
    """The password before the last character as a hash of the same length."""
    form = r"(?s)^([^:]*://[^:]*:)(.*)@$"
    return F.concat(F.regexp_extract(m, form, 1), _let(F.regexp_extract(m, form, 2), lambda v: _hidden(v, key)), F.lit("@"))


def _secret(m: Column, key: str) -> Column:
    """What follows the name and its quotation mark as a hash of the same length; a token without a name is hashed whole."""
    form = r"(?s)^((?i:bearer)\s+(?![=:])|[^=:]*[=:]\s*[\"']?)(.*?)([\"']?)$"
    bare = m.rlike(r"^(?:AKIA[0-9A-Z]{16}$|eyJ|sk-|gh[pousr]_)")
    value = F.when(bare, m).otherwise(F.regexp_extract(m, form, 2))
    hashed = lambda v: _hidden(v, key)

    around = lambda k: F.when(bare, F.lit("")).otherwise(F.regexp_extract(m, form, k))
    return F.concat(around(1), _let(value, hashed), around(3))


_MAKE = {"email": _email, "login": _login, "secret": _secret, "ip6": _ip6, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card, "iban": _iban, "world_phone": _world_phone}


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match by the first kind whose form and check it meets; null if it meets none."""
    whole = lambda p: m.rlike(f"^(?:{_bare(p)})$")
    return F.coalesce(*[F.when(whole(KINDS[k]), _MAKE[k](m, key)) for k in KINDS])


def _bare(pattern: str) -> str:
    """A pattern without what it asks of its surroundings."""
    out, depth, at = [], 0, 0
    while at < len(pattern):
        if depth == 0 and pattern.startswith(("(?<!", "(?<=", "(?!"), at):
            depth, at = 1, at + 3
            while depth:
                c = pattern[at]
                at += 2 if c == "\\" else 1
                if c == "[":
                    at = _after_set(pattern, at)
                depth += (c == "(") - (c == ")")
            continue
        if pattern[at] == "[":
            end = _after_set(pattern, at + 1)
            out.append(pattern[at:end])
            at = end
            continue
        step = 2 if pattern[at] == "\\" else 1
        out.append(pattern[at : at + step])
        at += step
    return "".join(out)


def _after_set(pattern: str, at: int) -> int:
    while pattern[at] != "]":
        at += 2 if pattern[at] == "\\" else 1
    return at + 1


def pseudonymise(text: Column, key: str) -> Column:
    """(text, found): the text with pseudonyms, and how many values were replaced. Null stays null."""
    def made(values: Column) -> Column:
        return F.transform(values, lambda m: F.struct(m.alias("m"), pseudonym(m, key).alias("p"), F.when(m.rlike(f"^(?:{_bare(CARD)})$"), F.greatest(F.size(_cards(m)), F.lit(1))).otherwise(1).alias("n")))

    def join(x: Column) -> Column:
        whole = F.zip_with(F.split(text, ANY), x, lambda g, v: F.concat(g, F.coalesce(v["p"], v["m"], F.lit(""))))
        return F.struct(F.array_join(whole, "").alias("text"), F.aggregate(x, F.lit(0), lambda s, v: s + F.when(v["p"].isNotNull(), v["n"]).otherwise(0)).cast("long").alias("found"))

    same = F.struct(text.alias("text"), F.lit(0).cast("long").alias("found"))
    changed = _let(F.regexp_extract_all(text, F.lit(ANY), 0), lambda values: F.when(F.size(values) > 0, _let(made(values), join)).otherwise(same))
    return F.when(text.isNotNull(), changed).otherwise(same)


def mask(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; ``n_chars``, if there, is counted anew. Other columns stay as they are.

    A null or empty text stays so; repeated rows give repeated results; an empty table gives none.
    """
    new = pseudonymise(F.col("text"), key)["text"]
    spare = "_" * (1 + max(map(len, docs.columns)))  # longer than any other name
    out = docs.select(*columns(docs), new.alias(spare))
    made = {"text": F.col(spare)} | ({"n_chars": F.length(spare).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*(made[c].alias(c) if c in made else x for c, x in zip(docs.columns, columns(docs))))


def find(docs: DataFrame, key: str) -> DataFrame:
    """Return doc_id, text (with pseudonyms), n_found for every row of ``docs``; other columns are ignored."""
    done = docs.select("doc_id", pseudonymise(F.col("text"), key).alias("_done"))
    return done.select("doc_id", F.col("_done.text").alias("text"), F.coalesce("_done.found", F.lit(0)).cast("long").alias("n_found"))
