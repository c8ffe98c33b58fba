"""Format-preserving pseudonyms for personal data, with DataFrame functions alone.

Values are found by one pattern, validated, and replaced by a keyed Feistel permutation of their own format: a card number
becomes another number of its length that passes the Luhn test, a date another date, an address another address, with
separators where they were.  Equal values become equal pseudonyms in every document, whatever their separators, and
different ones stay different, so links survive and the values don't.

A Feistel network over two number ranges a and b adds to each half, in turn, a keyed hash of the other, modulo its range.
That is one-to-one on a * b whatever the ranges, so each format needs only a split into two.  The hash is 60 bits of the
SHA-256 of key, kind, format, round and half; ranges stay below 2^60, so no sum leaves 64 bits.

  card   the digits but the last, which is the Luhn digit and worked out anew
  iban   the digits, and the letters, behind the country and check digits, each within their kind; the check digits are
         worked out anew (modulo 97, letters counting 10 to 35)
  ssn    898 areas by 99 * 9999 numbers, the ones that are ever given out
  phone  the digits behind a country code
  date   the 146097 = 189 * 773 days of 1700 to 2099, in year-month-day, day-month-year or month-day-year order
  ip     two halves of 16 bits
  email  the letters and digits before the @, PIECE at a time, as numbers to the base 36

Values that fail their test stay as they are (a number that fails Luhn may still be a phone number).  Defined results:
null text stays null with no values; text without values comes back unchanged; repeated rows get equal results; other
columns are left out.  The key has no default: whoever knows it can undo the permutation, so it must come from outside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import prepare

ROUNDS = 8
#: Letters and digits of an e-mail name that are permuted together: halves of ten, 36^10 < 2^52.
PIECE = 20
KINDS = ("email", "date", "ip", "ssn", "iban", "card", "phone")
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DAY, _MONTH, _YEAR = "(?:0[1-9]|[12][0-9]|3[01])", "(?:0[1-9]|1[0-2])", "(?:1[789]|20)[0-9]{2}"
# The lengths of account numbers by country; those of other countries are looked for with digits only.
_IBANS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
    23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM",
    28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(rf"(?:{c})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![A-Za-z0-9])" for n, c in _IBANS.items())
# What each kind looks like.  Runs are bounded and don't start inside a run, so no text takes long to scan.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "date": rf"(?<![0-9]){_YEAR}([-/.]){_MONTH}\1{_DAY}(?![0-9])|(?<![0-9])[0-3][0-9]([-/.])[0-3][0-9]\2{_YEAR}(?![0-9])",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN}|[A-Z]{{2}}[0-9]{{2}}(?: ?[0-9]{{4}}){{2,6}}(?: ?[0-9]{{1,4}})?(?![A-Za-z0-9]))",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])",
}


def _joined() -> str:
    """All patterns as one, with back-references counted on."""
    parts, groups = [], 0
    for kind in KINDS:
        p = PATTERNS[kind]
        if kind == "date":
            p = p.replace(r"\2", rf"\{groups + 2}").replace(r"\1", rf"\{groups + 1}")
            groups += 2
        parts.append(p)
    return "|".join(parts)


def _feistel(left: Column, right: Column, a: Column, b: Column, *salt: Column) -> Column:
    """struct(l, r): the permuted halves, l of range a and r of range b; salt begins with the key."""

    def hashed(i: Column, half: Column) -> Column:
        digest = F.sha2(F.concat_ws(":", *[x.cast("string") for x in salt], i.cast("string"), half.cast("string")).cast("binary"), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    def both(s: Column, i: Column) -> Column:
        into_left = F.pmod(s["l"] + F.pmod(hashed(i, s["r"]), a), a)
        into_right = F.pmod(s["r"] + F.pmod(hashed(i, s["l"]), b), b)
        return F.struct(F.when(i % 2 == 0, into_left).otherwise(s["l"]).alias("l"), F.when(i % 2 == 1, into_right).otherwise(s["r"]).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, both)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _power(base: int, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(base**i) for i in range(PIECE // 2 + 1 if base == 36 else 19)]), (n + 1).cast("int"))


def _permute_string(x: Column, base: int, kind: str, key: str, *more: Column) -> Column:
    """A string of digits to the base, permuted among those of its length (up to PIECE long for base 36, 36 for base 10)."""
    n = F.length(x)
    half = F.floor(n / 2).cast("int")
    left, right = F.substring(x, F.lit(1), half), F.substring(x, half + 1, n - half)
    number = (lambda s: F.coalesce(F.conv(s, base, 10).cast("long"), F.lit(0).cast("long"))) if base != 10 else (lambda s: F.coalesce(s.try_cast("long"), F.lit(0).cast("long")))
    text = (lambda v, size: F.lpad(F.lower(F.conv(v.cast("string"), 10, base)), size, "0")) if base != 10 else (lambda v, size: F.lpad(v.cast("string"), size, "0"))
    mixed = _feistel(number(left), number(right), _power(base, half), _power(base, n - half), F.lit(key), F.lit(kind), n, *more)
    return _let(mixed, lambda s: F.concat(F.when(half > 0, text(s["l"], half)).otherwise(""), text(s["r"], n - half)))


def _refill(form: Column, fill: Column, which: str = "[0-9]") -> Column:
    """form with its characters of the kind `which` replaced, in turn, by those of fill."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        take = c.rlike(which)
        return F.struct(F.concat(s["out"], F.when(take, F.substring(fill, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + F.when(take, 1).otherwise(0)).alias("at"))

    return F.aggregate(F.split(form, ""), start, step)["out"]


def _luhn(digits: Column, shift: int) -> Column:
    """The Luhn sum of a string of digits; shift 0: its last digit counts once, 1: twice."""
    order = F.reverse(F.split(digits, ""))
    twice = F.transform(order, lambda c, i: F.when((i + shift) % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(twice, F.lit(0), lambda a, x: a + x)


def _mod97(digits: Column) -> Column:
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda a, c: (a * 10 + c.cast("int")) % 97)


def _numbers(x: Column) -> Column:
    """Digits as they are and letters A to Z as 10 to 35."""
    return F.array_join(F.transform(F.split(x, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")


def _date(m: Column) -> Column:
    """struct(form, day): day null if m is no date of 1700 to 2099."""
    d = _digits(m)
    first = m.rlike("^[0-9]{4}")
    part = lambda at, n: F.substring(d, at, n)
    ymd = F.try_to_date(F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2)), "yyyy-MM-dd")
    dmy = F.try_to_date(F.concat_ws("-", part(5, 4), part(3, 2), part(1, 2)), "yyyy-MM-dd")
    mdy = F.try_to_date(F.concat_ws("-", part(5, 4), part(1, 2), part(3, 2)), "yyyy-MM-dd")
    form = F.when(first & ymd.isNotNull(), "yyyyMMdd").when(~first & dmy.isNotNull(), "ddMMyyyy").when(~first & mdy.isNotNull(), "MMddyyyy")
    return F.struct(form.alias("form"), F.when(first, ymd).otherwise(F.coalesce(dmy, mdy)).alias("day"))


def kind_of(m: Column) -> Column:
    """The kind of a match that passes its test, else null."""
    d = _digits(m)
    whole = lambda k: m.rlike(f"^(?:{PATTERNS[k]})$")
    ssn = whole("ssn") & ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    card = whole("card") & (_luhn(d, 0) % 10 == 0)
    x = F.replace(m, F.lit(" "), F.lit(""))
    iban = whole("iban") & F.length(x).between(15, 34) & (_mod97(_numbers(F.concat(F.substring(x, 5, 30), F.substring(x, 1, 4)))) == 1)
    return F.when(whole("email"), "email").when(whole("date") & _date(m)["day"].isNotNull(), "date").when(whole("ip"), "ip").when(ssn, "ssn").when(iban, "iban").when(card, "card").when(whole("phone"), "phone")


def _card(m: Column, key: str) -> Column:
    def swap(d: Column) -> Column:
        body = _permute_string(F.substring(d, F.lit(1), F.length(d) - 1), 10, "card", key)
        return _refill(m, _let(body, lambda x: F.concat(x, F.pmod(10 - _luhn(x, 1) % 10, F.lit(10)).cast("string"))))

    return _let(_digits(m), swap)


def _letters(x: Column, key: str, *more: Column) -> Column:
    """A string of letters A to Z, permuted 12 at a time among those of its length."""

    def swap(piece: Column, i: Column) -> Column:
        n = F.length(piece)
        half = F.floor(n / 2).cast("int")
        number = lambda s: F.aggregate(F.split(s, ""), F.lit(0).cast("long"), lambda a, c: a * 26 + F.when(c == "", 0).otherwise(F.ascii(c) - 65))
        power = lambda k: F.element_at(F.array(*[F.lit(26**j) for j in range(7)]), k + 1)
        text = lambda v, k: F.array_join(F.transform(F.slice(F.array(*[F.lit(j) for j in range(5, -1, -1)]), 7 - k, k), lambda j: F.char(F.floor(v / power(j)) % 26 + 65)), "")
        left, right = F.substring(piece, F.lit(1), half), F.substring(piece, half + 1, n - half)
        mixed = _feistel(number(left), number(right), power(half), power(n - half), F.lit(key), F.lit("iban letters"), n, i, *more)
        return _let(mixed, lambda s: F.concat(F.when(half > 0, text(s["l"], F.greatest(half, F.lit(1)))).otherwise(""), text(s["r"], n - half)))

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / 12).cast("int")), lambda i: swap(F.substring(x, i * 12 + 1, F.lit(12)), i))
    return F.when(x == "", x).otherwise(F.array_join(pieces, ""))


def _iban(m: Column, key: str) -> Column:
    land, tail = F.substring(m, 1, 2), F.substring(m, F.lit(5), F.length(m))

    def swap(d: Column) -> Column:
        digits = F.when(d == "", d).otherwise(_permute_string(d, 10, "iban", key, land))
        return _refill(_refill(tail, digits), _letters(F.regexp_replace(tail, "[^A-Z]", ""), key, land), "[A-Z]")

    def write(x: Column) -> Column:
        left = _mod97(_numbers(F.concat(F.replace(x, F.lit(" "), F.lit("")), land, F.lit("00"))))
        return F.concat(land, F.lpad((98 - left).cast("string"), 2, "0"), x)

    return _let(_let(_digits(tail), swap), write)


def _ssn(m: Column, key: str) -> Column:
    area = F.substring(m, 1, 3).cast("long")
    left = area - 1 - F.when(area > 666, 1).otherwise(0)
    right = (F.substring(m, 5, 2).cast("long") - 1) * 9999 + F.substring(m, 8, 4).cast("long") - 1

    def write(s: Column) -> Column:
        given = s["l"] + 1 + F.when(s["l"] >= 665, 1).otherwise(0)
        pad = lambda v, n: F.lpad(v.cast("string"), n, "0")
        return F.concat(pad(given, 3), F.lit("-"), pad(F.floor(s["r"] / 9999) + 1, 2), F.lit("-"), pad(s["r"] % 9999 + 1, 4))

    return _let(_feistel(left, right, F.lit(898), F.lit(99 * 9999), F.lit(key), F.lit("ssn")), write)


def _phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .-])|^\+[0-9]", 0)  # the country code stays
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return F.concat(code, _refill(rest, _permute_string(_digits(rest), 10, "phone", key, code)))


def _day(m: Column, key: str) -> Column:
    def swap(x: Column) -> Column:
        n = F.datediff(x["day"], F.to_date(F.lit("1700-01-01"))).cast("long")
        mixed = _feistel(F.floor(n / 773), n % 773, F.lit(189), F.lit(773), F.lit(key), F.lit("date"))

        def write(s: Column) -> Column:
            day = F.date_add(F.to_date(F.lit("1700-01-01")), (s["l"] * 773 + s["r"]).cast("int"))
            in_form = F.when(x["form"] == "yyyyMMdd", F.date_format(day, "yyyyMMdd")).when(x["form"] == "ddMMyyyy", F.date_format(day, "ddMMyyyy")).otherwise(F.date_format(day, "MMddyyyy"))
            return _refill(m, in_form)

        return _let(mixed, write)

    return _let(_date(m), swap)


def _ip(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda c: c.cast("long"))
    mixed = _feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), F.lit(key), F.lit("ip"))
    return _let(mixed, lambda s: F.concat_ws(".", F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256))


def _email(m: Column, key: str) -> Column:
    """The part before the @, permuted PIECE letters and digits at a time; the host stays."""
    at = F.instr(m, "@")
    local = F.lower(F.substring(m, F.lit(1), at - 1))

    def swap(plain: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(plain) - 1) / PIECE).cast("int")), lambda i: _permute_string(F.substring(plain, i * PIECE + 1, F.lit(PIECE)), 36, "email", key, i))
        return F.when(plain == "", local).otherwise(_refill(local, F.array_join(pieces, ""), "[a-z0-9]"))

    return F.concat(_let(F.regexp_replace(local, "[^a-z0-9]", ""), swap), F.substring(m, at, F.length(m)))


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """What a match becomes; itself where its kind is null."""
    swaps = {"email": _email, "date": _day, "ip": _ip, "ssn": _ssn, "iban": _iban, "card": _card, "phone": _phone}
    out = None
    for k, f in swaps.items():
        out = (F if out is None else out).when(kind == k, f(m, key))
    return out.otherwise(m)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, n_values, and n_<kind> of each kind, for each row of docs."""
    if not key:
        raise ValueError("pseudonyms need a key")
    prepare(docs.sparkSession)
    pattern = _joined()
    t = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    matches = F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    rows = rows.withColumn("found", matches)
    rows = rows.withColumn("found", F.when(F.size("found") > 0, F.transform("found", lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))))
    swapped = F.transform("found", lambda x: pseudonym(x["m"], x["kind"], key))
    gaps = F.split(t, pattern, -1)
    text = F.concat(gaps[0], F.array_join(F.zip_with(swapped, F.slice(gaps, 2, F.size(gaps)), lambda v, g: F.concat(v, g)), ""))
    count = lambda k: F.coalesce(F.size(F.filter("found", lambda x: x["kind"] == k if k else x["kind"].isNotNull())), F.lit(0))
    counts = {f"n_{k or 'values'}": F.greatest(count(k), F.lit(0)).cast("long") for k in ("", *KINDS)}
    return rows.select("doc_id", F.when(F.col("found").isNotNull(), text).otherwise(t).alias("text"), *[c.alias(n) for n, c in counts.items()])
