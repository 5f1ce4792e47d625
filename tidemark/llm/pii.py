"""Format-preserving pseudonyms of personal data, in DataFrame functions alone.

Numbers and dates that pass validation are permuted by a keyed Feistel network inside their format, so equal values
get equal pseudonyms in all documents, different values different ones, and the key's owner can undo it:

- cards (13 to 19 digits, Luhn): the first digit and the separators stay, the check digit is made anew;
- telephone numbers of ten digits, with or without +1: area and exchange keep to 2-9 first digits where they had them;
  other numbers of 8 to 15 digits behind a +: the first two digits stay;
- IPv4 addresses; IPv6 addresses, the digits of each group staying as many;
- dates (1900-01-01 to 2099-08-05) as 2024-12-31, 31.12.2024, 12/31/2024 or 31/12/2024. A day has one pseudonym in all
  formats but one: a date that can only be read as dd/MM goes on through the permutation until it is such a date again;
- social security numbers with valid area, group and serial; IBANs (mod 97): letters stay, check digits are made anew.

Mail addresses, passwords, tokens and access keys have no number to permute: they become keyed hashes (HMAC) of the same
shape, which link equal values and can't be undone. A Feistel round adds to one half, modulo its size, the SHA-256 of
key, kind, round and the other half; halves of different sizes are allowed, so any domain of size a * b is permuted.

Numbers that stand side by side, a space or hyphen between them, are one run: inside it every span of whole groups is
tried (``parts``), so a card keeps being found beside a quantity, an expiry date or another card.

Cases: null text is empty; a null doc_id stays null; repeated rows are treated each; an empty table gives an empty
result; only doc_id and text are read. Numbers that fail validation stay as they are. An empty key is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import text_or_empty

ROUNDS = 10
WALK = 100  # a walk through the dates that doesn't end in so many steps has a chance of 10^-40
DAYS = 270  # dates are DAYS * DAYS days from 1900-01-01
# Loops over groups of several signs are possessive: Java's matcher runs those as a loop and any other by recursion, which
# overflows on long texts. Each round ends where the whole could end, so nothing has to be given back.
_LABELS = r"[A-Za-z0-9-]++\."
_DOMAIN = rf"(?:(?:{_LABELS}(?![A-Za-z]{{2}}))*+{_LABELS}(?=[A-Za-z]{{2}}))++[A-Za-z]{{2,24}}"  # up to the last dot before two letters
# The shapes that are looked for, in order.
SHAPES = {
    "password": r"(?<=\b(?:[Pp]assword|PASSWORD|[Pp]asswd|PASSWD|pwd|PWD)[\"']?\s{0,2}[=:]\s{0,2}[\"']?)[^\s\"',;]{6,}",
    "token": r"(?<=\b(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY)[\"']?\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9_-]{16,}",
    "access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "email": rf"[A-Za-z0-9._%+-]{{1,64}}@{_DOMAIN}",
    "iban_letters": r"\b[A-Z]{2}\d{2}(?=(?: ?\d{4}){0,6} ?\d{0,3}[A-Z])(?: ?(?!\d{4} ?[A-Z]{2}\d{2})[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?\d{4}){2,6}(?: ?\d{1,4})?\b",
    "date": r"(?<![\d.-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d-])",
    "ip6": r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d-])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])",
    "abroad": r"(?<![\d+])\+[2-9]\d{0,2}(?:[ -]?\(?\d{1,4}\)?){2,6}(?![\d-])",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
}
# What starts with digits and goes on with other signs than a run has: a run ends before it.
_OTHER = r"(?!\d{2}[./]\d{2}[./]\d{4}|(?:\d{1,3}\.){3}\d|\d{3}(?:[ -]\d{3}\.|\.\d{3}[ .-])\d{4}|[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+\.)"
_CHAIN = rf"\d++(?:-{_OTHER}\d++)*+(?!-)"  # groups with hyphens between them: a run may not end before a hyphen
RUNS = {
    "iban": rf"\b[A-Z]{{2}}(?=\d{{2}}(?: ?\d{{4}}){{2}})\d++\b(?:[ -]{_OTHER}\d++\b)*+",
    "card": rf"(?<![\d-])(?=\d(?:[ -]?\d){{12}}){_CHAIN}(?: {_OTHER}{_CHAIN})*+",
}
ANY = "|".join({**SHAPES, **RUNS}.values())
RUN = r"^(?:[A-Z]{2})?\d++(?:[ -]\d++)*+$"
LONGEST = 36  # signs and groups behind the first one of a card of 19 groups
SECRETS = ("password", "token", "access_key")
DATE_FORMATS = ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def part(text: Column, start: int, length: int | Column) -> Column:
    return F.substr(text, F.lit(start), F.lit(length) if isinstance(length, int) else length)


def power_of_ten(n: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("long")


def permute(left: Column, right: Column, a: Column, b: Column, key: str, kind: str, finish: Callable, inverse: bool = False) -> Column:
    """finish(left, right) of the pair permuted in Z_a x Z_b."""

    def noise(number: Column, value: Column, size: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), F.lit(kind), number.cast("string"), value.cast("string"))
        return F.pmod(F.conv(part(F.sha2(text, 256), 1, 15), 16, 10).cast("long"), size)

    def step(pair: Column, number: Column) -> Column:
        l, r, sign = pair["l"], pair["r"], F.lit(-1 if inverse else 1)
        odd = F.struct(F.pmod(l + sign * noise(number, r, a), a).alias("l"), r.alias("r"))
        even = F.struct(l.alias("l"), F.pmod(r + sign * noise(number, l, b), b).alias("r"))
        return F.when(number % 2 == 1, odd).otherwise(even)

    first, last, by = (ROUNDS, 1, -1) if inverse else (1, ROUNDS, 1)
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(first), F.lit(last), F.lit(by)), start, step, lambda p: finish(p["l"], p["r"]))


def permute_digits(number: Column, key: str, kind: str, inverse: bool = False) -> Column:
    """Digits to as many digits, of 2 to 30."""
    n = F.length(number)
    half = F.floor(n / 2).cast("int")
    rest = n - half
    pad = lambda l, r: F.concat(F.lpad(l.cast("string"), half, F.lit("0")), F.lpad(r.cast("string"), rest, F.lit("0")))
    return permute(part(number, 1, half), F.substr(number, half + 1), power_of_ten(half), power_of_ten(rest), key, kind, pad, inverse)


def refill(shape: Column, number: Column) -> Column:
    """shape with its digits replaced in order by those of number."""
    at = F.sequence(F.lit(1), F.length(shape))
    one = lambda i: F.when(F.substr(shape, i, F.lit(1)).rlike("[0-9]"), F.substr(number, F.length(digits(part(shape, 1, i))), F.lit(1))).otherwise(F.substr(shape, i, F.lit(1)))
    return F.array_join(F.transform(at, one), "")


def luhn_sum(number: Column) -> Column:
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(number, i, F.lit(1)).cast("int") * (1 + (n - i) % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _card(m: Column, key: str, inverse: bool) -> Column:
    def make(d: Column) -> Column:
        body = F.concat(part(d, 1, 1), permute_digits(F.substr(d, F.lit(2), F.length(d) - 2), key, "card", inverse))
        return let(body, lambda p: F.concat(p, ((10 - luhn_sum(F.concat(p, F.lit("0"))) % 10) % 10).cast("string")))

    return refill(m, let(digits(m), make))


def _phone(m: Column, key: str, inverse: bool) -> Column:
    def make(d: Column) -> Column:
        ten = F.right(d, F.lit(10))
        area, exchange, line = (part(ten, s, n).cast("long") for s, n in ((1, 3), (4, 3), (7, 4)))
        text = lambda l, r: F.concat((l + 200).cast("string"), (F.floor(r / 10_000) + 200).cast("string"), F.lpad((r % 10_000).cast("string"), 4, "0"))
        good = permute(area - 200, (exchange - 200) * 10_000 + line, F.lit(800), F.lit(8_000_000), key, "phone", text, inverse)
        other = let(permute_digits(F.concat(part(ten, 2, 2), part(ten, 5, 6)), key, "phone8", inverse), lambda p: F.concat(part(ten, 1, 1), part(p, 1, 2), part(ten, 4, 1), part(p, 3, 6)))
        return F.concat(F.substr(d, F.lit(1), F.length(d) - 10), F.when(ten.rlike("^[2-9][0-9]{2}[2-9]"), good).otherwise(other))

    return refill(m, let(digits(m), make))


def _ip(m: Column, key: str, inverse: bool) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    text = lambda l, r: F.concat_ws(".", F.floor(l / 256).cast("string"), (l % 256).cast("string"), F.floor(r / 256).cast("string"), (r % 256).cast("string"))
    return permute(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65_536), F.lit(65_536), key, "ip", text, inverse)


def _day(m: Column, form: str) -> Column:
    return F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit("1900-01-01").cast("date"))


def _as_day(number: Column) -> Column:
    return F.date_add(F.lit("1900-01-01").cast("date"), number.cast("int"))


def _date(m: Column, key: str, inverse: bool) -> Column:
    def moved(day: Column) -> Column:
        return permute(F.floor(day / DAYS), day % DAYS, F.lit(DAYS), F.lit(DAYS), key, "date", lambda l, r: l * DAYS + r, inverse)

    def walked(day: Column) -> Column:
        """The next day of the permutation whose number in its month is no month; three in five are."""
        ends = lambda d: F.dayofmonth(_as_day(d)) > 12
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), moved(day), lambda d, _: F.when(ends(d), d).otherwise(moved(d)))

    out = F.lit(None).cast("string")
    for form in DATE_FORMATS:
        day = _dates(m, form)
        new = let(day, walked if form == "dd/MM/yyyy" else moved)
        out = F.when(day.isNotNull(), F.date_format(_as_day(new), form)).otherwise(out)
    return out


def _dates(m: Column, form: str) -> Column:
    """The day that is meant, null outside the domain. With slashes the month is first wherever that is a date."""
    day = _day(m, form)
    read = day.between(0, DAYS * DAYS - 1)
    return F.when(read & _day(m, "MM/dd/yyyy").isNull() if form == "dd/MM/yyyy" else read, day)


def _is_date(m: Column) -> Column:
    return F.coalesce(*[_dates(m, form) for form in DATE_FORMATS]).isNotNull()


def _ssn(m: Column, key: str, inverse: bool) -> Column:
    area, group, serial = part(m, 1, 3).cast("long"), part(m, 5, 2).cast("long"), part(m, 8, 4).cast("long")
    place = F.when(area < 666, area - 1).otherwise(area - 2)

    def text(l: Column, r: Column) -> Column:
        back = F.when(l < 665, l + 1).otherwise(l + 2)
        three, two, four = back, F.floor(r / 9999) + 1, r % 9999 + 1
        return F.concat_ws("-", F.lpad(three.cast("string"), 3, "0"), F.lpad(two.cast("string"), 2, "0"), F.lpad(four.cast("string"), 4, "0"))

    return permute(place, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn", text, inverse)


def _iban_rest(country: Column, check: str | Column, account: Column) -> Column:
    """The number mod 97, letters as 10 to 35, sign by sign."""
    signs = F.split(F.concat(account, country, F.lit(check) if isinstance(check, str) else check), "")

    def add(rest: Column, sign: Column) -> Column:
        digit = sign.rlike("[0-9]")
        return (rest * F.when(digit, 10).otherwise(100) + F.when(digit, F.ascii(sign) - 48).otherwise(F.ascii(sign) - 55)) % 97

    return F.aggregate(F.filter(signs, lambda x: x != ""), F.lit(0), add)


def _iban(m: Column, key: str, inverse: bool) -> Column:
    country, plain = part(m, 1, 2), F.replace(m, F.lit(" "), F.lit(""))

    def make(account: Column) -> Column:
        return F.concat(F.lpad((98 - _iban_rest(country, "00", account)).cast("int").cast("string"), 2, "0"), account)

    account = F.substr(plain, F.lit(5))
    number = permute_digits(digits(account), key, "iban", inverse)
    new = let(let(number, lambda d: refill(account, d)), make)
    return F.concat(country, refill(F.substr(m, F.lit(3)), let(new, digits)))


def _abroad(m: Column, key: str, inverse: bool) -> Column:
    return refill(m, let(digits(m), lambda d: F.concat(part(d, 1, 2), permute_digits(F.substr(d, F.lit(3)), key, "abroad", inverse))))


def _ip6(m: Column, key: str, inverse: bool) -> Column:
    """Groups two by two, a last one by itself; each keeps how many digits it has, and the address its case."""
    groups = F.split(m, ":")
    some = F.filter(groups, lambda g: g != "")
    size = lambda g: F.when(F.length(g) == 0, 1).otherwise(F.pow(F.lit(16), F.length(g)).cast("long"))
    value = lambda g: F.coalesce(F.conv(F.when(g != "", g), 16, 10).cast("long"), F.lit(0))

    def pair(i: Column) -> Column:
        a, b = F.get(some, 2 * i), F.coalesce(F.get(some, 2 * i + 1), F.lit(""))
        text = lambda l, r: F.array(F.lpad(F.hex(l), F.length(a), F.lit("0")), F.lpad(F.hex(r), F.length(b), F.lit("0")))
        return permute(value(a), value(b), size(a), size(b), key, "ip6", text, inverse)

    new = F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(some) - 1) / 2).cast("int")), pair))

    def place(state: Column, group: Column) -> Column:
        own = F.when(group == "", "").otherwise(F.get(new, state["n"]))
        return F.struct(F.concat(state["text"], F.lit(":"), own).alias("text"), (state["n"] + F.when(group == "", 0).otherwise(1)).alias("n"))

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"))
    return let(F.aggregate(groups, start, place, lambda s: F.substr(s["text"], F.lit(2))), lambda t: F.when(m.rlike("[A-F]"), t).otherwise(F.lower(t)))


def _letters(m: Column, key: str, kind: str) -> Column:
    """128 hexadecimal digits of two HMACs with SHA-256."""
    inner, outer = (F.lit(bytes(x ^ c for x in hashlib.sha256(key.encode()).digest().ljust(64, b"\0"))) for c in (0x36, 0x5C))
    mac = lambda text: F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 256))), 256)
    return F.concat(*[mac(F.concat(F.lit(f"{kind}{k}|"), m)) for k in (1, 2)])


def _stretch(text: Column, n: Column) -> Column:
    return F.rpad(F.substr(text, F.lit(1), n), n, text)


def _email(m: Column, key: str) -> Column:
    def make(hashed: Column) -> Column:
        local = _stretch(hashed, F.length(F.substring_index(m, "@", 1)))
        return F.concat(local, F.lit("@"), part(F.reverse(hashed), 1, 8), F.lit("."), F.lower(F.substring_index(m, ".", -1)))

    return let(F.translate(_letters(F.lower(m), key, "email"), "0123456789", "ghijklmnop"), make)


def _secret(m: Column, key: str) -> Column:
    kept = F.when(m.rlike("^A[KS]IA[A-Z0-9]{16}$"), part(m, 1, 4)).otherwise("")
    upper = F.translate(F.upper(_letters(m, key, "secret")), "0189", "WXYZ")
    return F.when(kept != "", F.concat(kept, part(upper, 1, 16))).otherwise(_stretch(_letters(m, key, "secret"), F.length(m)))


def kind_of(m: Column) -> Column:
    """Kind of a found text, null where it fails validation. Passwords and tokens are what has no other shape."""
    whole = lambda name: m.rlike(f"^(?:{SHAPES[name]})$")
    d = digits(m)
    n = F.length(d)
    account = F.substr(F.replace(m, F.lit(" "), F.lit("")), F.lit(5))
    iban = F.when(F.length(account).between(8, 30) & (n >= 4), F.when(_iban_rest(part(m, 1, 2), part(m, 3, 2), account) == 1, "iban"))
    return (
        F.when(m.contains("@") & whole("email"), "email")
        .when(whole("access_key"), "access_key")
        .when(whole("iban") | whole("iban_letters"), iban)
        .when(whole("ip6"), F.when(F.size(F.filter(F.split(m, ":"), lambda g: g != "")) <= 8, "ip6"))
        .when(whole("date"), F.when(_is_date(m), "date"))
        .when(whole("ip"), F.when(F.forall(F.split(m, r"\."), lambda x: (x.cast("int") <= 255) & ~x.rlike("^0[0-9]")), "ip"))
        .when(whole("ssn"), F.when(~m.rlike("^(000|666|9)|-00-|-0000$"), "ssn"))
        .when(whole("phone"), "phone")
        .when(whole("abroad"), F.when(n.between(8, 15), "abroad"))
        .when(whole("card"), F.when(luhn_sum(d) % 10 == 0, "card"))
        .otherwise("secret")
    )


def _cut(m: Column, good: Callable[[Column, Column, Column], Column]) -> Column:
    """(m, kind) pieces of a run. Left to right, the longest span of groups for which ``good`` gives a kind is taken.

    good: of the span and the signs before and behind it, null at the run's ends.
    """

    def scan(t: Column) -> Column:
        join = lambda i, j: F.array_join(F.slice(t, i, j - i + 1), "")
        piece = lambda text, kind: F.array(F.struct(text.alias("m"), kind.alias("kind")))
        none = F.lit(None).cast("string")

        def step(state: Column, i: Column) -> Column:
            ends = F.sequence(F.least(i + LONGEST, F.size(t)), i, F.lit(-1))
            kind = lambda j: let(join(i, j), lambda text: good(text, F.get(t, i - 2), F.get(t, j)))
            tried = F.transform(ends, lambda j: F.struct(j.alias("j"), kind(j).alias("kind")))

            def take(best: Column) -> Column:
                gap = F.when(i > state["next"], piece(join(state["next"], i - 1), none)).otherwise(F.slice(state["out"], 1, 0))
                taken = F.struct((best["j"] + 1).alias("next"), F.concat(state["out"], gap, piece(join(i, best["j"]), best["kind"])).alias("out"))
                return F.when(best.isNotNull(), taken).otherwise(state)

            return F.when((i < state["next"]) | F.get(t, i - 1).isin(" ", "-"), state).otherwise(let(F.get(F.filter(tried, lambda x: x["kind"].isNotNull()), F.lit(0)), take))

        def finish(state: Column) -> Column:
            rest = piece(join(state["next"], F.size(t)), none)
            return F.when(state["next"] <= F.size(t), F.concat(state["out"], rest)).otherwise(state["out"])

        start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<m:string,kind:string>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.size(t)), start, step, finish)

    return let(F.regexp_extract_all(m, F.lit("[ -]|[A-Z]+|[0-9]+"), F.lit(0)), scan)


def parts(m: Column) -> Column:
    """(m, kind) pieces of a run of numbers, in order, kind null for what stays.

    IBANs and cards in one group or in four groups of four come first, then what has a shape of its own, then cards
    grouped in any other way; so what neighbours happen to add up to takes nothing from a common notation.
    """
    whole = lambda text, name: text.rlike(f"^(?:{SHAPES[name]})$")
    card = lambda text: F.when(whole(text, "card"), F.when(luhn_sum(digits(text)) % 10 == 0, "card"))

    def common(text: Column, before: Column, behind: Column) -> Column:
        iban = F.when(F.length(text) < 45, F.when(kind_of(text) == "iban", "iban"))
        return F.when(text.rlike("^[A-Z]"), F.when(whole(text, "iban"), iban)).when(text.rlike("^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4})$"), card(text))

    def shaped(text: Column, before: Column, behind: Column) -> Column:
        free = (F.coalesce(before, F.lit("")) != "-") & (F.coalesce(behind, F.lit("")) != "-")
        fits = whole(text, "date") | whole(text, "ssn") | whole(text, "phone")
        return F.when(free & F.length(text).between(10, 12), F.when(fits, kind_of(text)))

    def grouped(text: Column, before: Column, behind: Column) -> Column:
        return F.when(F.length(text).between(13, 37), card(text))

    def again(pieces: Column, good: Callable) -> Column:
        return F.flatten(F.transform(pieces, lambda x: F.when(x["kind"].isNull(), _cut(x["m"], good)).otherwise(F.array(x))))

    return again(again(_cut(m, common), shaped), grouped)


def pseudonym(m: Column, kind: Column, key: str, inverse: bool = False) -> Column:
    """The text that takes a found text's place; ``inverse`` undoes permutations and leaves hashes."""
    out = F.when(kind.isNull(), m)
    for name, make in (("card", _card), ("phone", _phone), ("ip", _ip), ("date", _date), ("ssn", _ssn), ("iban", _iban), ("abroad", _abroad), ("ip6", _ip6)):
        out = out.when(kind == name, make(m, key, inverse))
    if inverse:
        return out.otherwise(m)
    return out.when(kind == "email", _email(m, key)).otherwise(_secret(m, key))


def pseudonymise(docs: DataFrame, key: str, inverse: bool = False) -> DataFrame:
    """doc_id, n_found, a count for each kind, and the text with pseudonyms, of each row."""
    if not key:
        raise ValueError("pseudonyms need a key")
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    some = F.col("text").rlike("[0-9@=:]|AKIA|ASIA")
    rows = rows.withColumn("found", F.when(some, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    one = lambda m: F.array(F.struct(m.alias("m"), kind_of(m).alias("kind")))
    is_run = lambda m: m.rlike(RUN) & ~m.rlike(f"^(?:{SHAPES['date']}|{SHAPES['ssn']}|{SHAPES['phone']})$")
    rows = rows.withColumn("found", F.transform("found", lambda m: F.when(is_run(m), parts(m)).otherwise(one(m))))
    put = F.transform("found", lambda pieces: F.array_join(F.transform(pieces, lambda x: pseudonym(x["m"], x["kind"], key, inverse)), ""))
    text = F.array_join(F.zip_with(F.split("text", ANY, -1), put, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    text = F.when(F.size("found") > 0, text).otherwise(F.col("text"))
    found = F.flatten("found")
    count = lambda name: F.size(F.filter(found, lambda x: x["kind"] == name))
    names = ("card", "phone", "abroad", "ip", "ip6", "date", "ssn", "iban", "email", "access_key", "secret")
    return rows.select("doc_id", F.size(F.filter(found, lambda x: x["kind"].isNotNull())).alias("n_found"), *[count(n).alias(f"n_{n}") for n in names], text.alias("text"))
