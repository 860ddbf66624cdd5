r"""Format-preserving pseudonyms by keyed Feistel permutation, with Spark expressions only.

Values that pass validation are permuted within their format, so equal values get
equal pseudonyms in every document and no two values of a format share one:

- card: 13 to 19 digits with a right Luhn digit; the first digit stays, the Luhn digit is made anew
- social: three, two and four digits in the issued ranges (areas 001 to 899 but 666, groups from 01, serials from 0001), permuted within these
- phone: ten digits in the usual grouping, with or without country code, which stays
- ip: four octets, as one 32-bit number
- date: a calendar day from 1800 to 2199 (400 years, 146097 = 189 * 773 days), year first or last
- email: letters and digits of the local part within their kind; the domain stays
- secret: 32 or more hexadecimal digits, as a number: letters count without case, and the pseudonym has capital letters
  where the value has no small ones

Cards are validated before the cut: at each start of a digit run, every length from 19
to 13 digits is tried. A text is then cut by one pattern, with its own valid cards in
it, into gaps and candidates, so numbers that are no card hide no values beside or
inside them; candidates that fail validation stay as they are. A null text stays null, an empty one empty. Every row
is rewritten by itself: nothing is shuffled, and repeated rows stay repeated; an empty table gives no rows.
All columns stay as they are but ``text`` and the one that ``counts`` names, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrade.llm.common import fresh

ROUNDS = 10
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}([-./])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-./])[0-9]{2}\2[0-9]{4})(?![0-9A-Za-z]|[-./][0-9])",
    "ip": rf"(?<![0-9A-Za-z]|[0-9]\.)(?:{OCTET}\.){{3}}{OCTET}(?![0-9A-Za-z]|\.[0-9])",
    "social": r"(?<![0-9A-Za-z]|[0-9]-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "card": r"(?<![0-9A-Za-z]|[0-9]-)[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|-[0-9])",
}
#: Candidates of each card length, overlapping ones too, longest first.
CARD_TRIES = [rf"(?<![0-9A-Za-z])(?=([0-9](?:[ -]?[0-9]){{{n - 1}}})(?![0-9A-Za-z]))" for n in range(19, 12, -1)]
FIRST, REST = ("|".join(f"(?:{PATTERNS[k]})" for k in kinds) for kinds in (("email", "secret"), ("date", "ip", "social", "phone")))
DAY_ONE = "1800-01-01"


def let(value: Column, use) -> Column:
    """Evaluates ``value`` once, however often ``use`` takes it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _number(key: str, *parts: Column) -> Column:
    """60 keyed pseudo-random bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, m: Column, n: Column, key: str, tweak: Column) -> Column:
    """Permutes pairs of 0 <= a < m and 0 <= b < n: alternating rounds add a keyed number of one half to the other."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")),
        lambda s, i: F.when(i % 2 == 1, F.struct(((s["a"] + _number(key, tweak, i, s["b"])) % m).alias("a"), s["b"].alias("b"))).otherwise(
            F.struct(s["a"].alias("a"), ((s["b"] + _number(key, tweak, i, s["a"])) % n).alias("b"))
        ),
    )


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """Permutes digit strings of one length, 2 to 34 digits long, among themselves."""
    u = F.floor(F.length(digits) / 2).cast("int")
    v = F.length(digits) - u
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    tweak = F.concat(F.lit(kind), F.length(digits).cast("string"))
    mixed = feistel(F.substring(digits, F.lit(1), u).cast("long"), F.substring(digits, u + 1, v).cast("long"), power(u), power(v), key, tweak)
    return let(mixed, lambda s: F.concat(F.lpad(s["a"].cast("string"), u, "0"), F.lpad(s["b"].cast("string"), v, "0")))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def put_digits(value: Column, digits: Column) -> Column:
    """The value with its digits replaced in order."""
    chars = F.transform(
        F.sequence(F.lit(1), F.length(value)),
        lambda i: F.when(F.substring(value, i, F.lit(1)).rlike("[0-9]"), F.substring(digits, F.length(digits_of(F.substring(value, F.lit(1), i))), F.lit(1))).otherwise(F.substring(value, i, F.lit(1))),
    )
    return F.array_join(chars, "")


def luhn_sum(digits: Column) -> Column:
    """Sum with every second digit from the right doubled, the rightmost counting once."""
    n = F.length(digits)

    def add(acc, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return acc + F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _card(value: Column, key: str) -> Column:
    def made(d):
        body = F.concat(F.substring(d, F.lit(1), F.lit(1)), permute_digits(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))
        full = let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when(luhn_sum(d) % 10 == 0, let(full, lambda f: put_digits(value, f)))

    return let(digits_of(value), made)


def _social(value: Column, key: str) -> Column:
    valid = value.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    number = lambda at, n: F.substring(value, at, n).cast("long")
    area = number(1, 3) - 1 - (number(1, 3) > 666).cast("long")
    mixed = feistel(area * 99 + number(5, 2) - 1, number(8, 4) - 1, F.lit(898 * 99), F.lit(9999), key, F.lit("social"))
    told = lambda x, n: F.lpad(x.cast("string"), n, "0")
    back = lambda s: let(F.floor(s["a"] / 99), lambda i: F.concat_ws("-", told(i + 1 + (i >= 665).cast("long"), 3), told(s["a"] % 99 + 1, 2), told(s["b"] + 1, 4)))
    return F.when(valid, let(mixed, back))


def _phone(value: Column, key: str) -> Column:
    def made(d):
        own = F.concat(F.substring(d, F.lit(1), F.length(d) - 10), permute_digits(F.right(d, F.lit(10)), key, "phone"))
        return let(own, lambda f: put_digits(value, f))

    return let(digits_of(value), made)


def _ip(value: Column, key: str) -> Column:
    def made(o):
        k = lambda i: F.element_at(o, i).cast("long")
        mixed = feistel(k(1) * 256 + k(2), k(3) * 256 + k(4), F.lit(65536), F.lit(65536), key, F.lit("ip"))
        part = lambda x: F.concat(F.floor(x / 256).cast("string"), F.lit("."), (x % 256).cast("string"))
        return let(mixed, lambda s: F.concat(part(s["a"]), F.lit("."), part(s["b"])))

    return let(F.split(value, r"\."), made)


def _date(value: Column, key: str) -> Column:
    year_first = value.rlike("^[0-9]{4}")
    mark = F.when(year_first, F.substring(value, 5, 1)).otherwise(F.substring(value, 3, 1))
    iso = lambda y, m, d: F.concat_ws("-", F.substring(value, y, 4), F.substring(value, m, 2), F.substring(value, d, 2)).try_cast("date")
    day_first, month_first = iso(7, 4, 1), iso(7, 1, 4)
    as_day = F.when(year_first, iso(1, 6, 9)).when(mark == "/", F.coalesce(month_first, day_first)).otherwise(F.coalesce(day_first, month_first))
    style = F.when(year_first, "y").when(F.when(mark == "/", month_first.isNull()).otherwise(day_first.isNotNull()), "d").otherwise("m")

    def made(day):
        at = F.datediff(day, F.lit(DAY_ONE).cast("date"))
        mixed = feistel(F.floor(at / 773), at % 773, F.lit(189), F.lit(773), key, F.lit("date"))
        new = let(mixed, lambda s: F.date_add(F.lit(DAY_ONE).cast("date"), (s["a"] * 773 + s["b"]).cast("int")))
        y, m, d = (lambda p: lambda x: F.date_format(x, p))("yyyy"), (lambda p: lambda x: F.date_format(x, p))("MM"), (lambda p: lambda x: F.date_format(x, p))("dd")
        told = let(new, lambda x: F.when(style == "y", F.concat_ws("-", y(x), m(x), d(x))).when(style == "d", F.concat_ws("-", d(x), m(x), y(x))).otherwise(F.concat_ws("-", m(x), d(x), y(x))))
        return F.when((F.year(day) >= 1800) & (F.year(day) <= 2199), F.replace(told, F.lit("-"), mark))

    return let(as_day, made)


def _mixed(value: Column, key: str, kind: str, hexadecimal: bool) -> Column:
    """Permutes strings of one shape: each character moves within its alphabet, halves alternating."""
    code = lambda i: F.ascii(F.substring(value, i, F.lit(1)))
    places = F.sequence(F.lit(1), F.length(value))
    if hexadecimal:
        to_value = lambda c: F.when(c <= 57, c - 48).otherwise(c % 32 + 9)
        base = lambda c: F.lit(16)
    else:
        to_value = lambda c: F.when((c >= 48) & (c <= 57), c - 48).when((c >= 97) & (c <= 122), c - 97).when((c >= 65) & (c <= 90), c - 65).otherwise(F.lit(0))
        base = lambda c: F.when((c >= 48) & (c <= 57), F.lit(10)).when(((c >= 97) & (c <= 122)) | ((c >= 65) & (c <= 90)), F.lit(26)).otherwise(F.lit(1))
    half = F.floor(F.length(value) / 2).cast("int")
    values = F.transform(places, lambda i: to_value(code(i)).cast("int"))
    bases = F.transform(places, lambda i: base(code(i)).cast("int"))
    shape = F.concat(F.lit(kind), F.length(value).cast("string")) if hexadecimal else F.concat(F.lit(kind), F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A"))

    def step(s, i):
        x, y, r = s["x"], s["y"], s["r"]
        moved = let(
            F.sha2(F.concat_ws("|", F.lit(key), shape, i.cast("string"), F.array_join(F.transform(y, lambda v: v.cast("string")), ",")).cast("binary"), 512),
            lambda h: F.transform(x, lambda v, j: ((v + F.conv(F.substring(h, (j % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")) % F.element_at(r, j + 1)).cast("int")),
        )
        return F.struct(y.alias("x"), moved.alias("y"), s["q"].alias("r"), r.alias("q"))

    start = F.struct(
        F.slice(values, F.lit(1), half).alias("x"),
        F.slice(values, half + 1, F.length(value) - half).alias("y"),
        F.slice(bases, F.lit(1), half).alias("r"),
        F.slice(bases, half + 1, F.length(value) - half).alias("q"),
    )
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s["x"], s["y"]))
    if hexadecimal:
        letter = F.when(value.rlike("[A-F]") & ~value.rlike("[a-f]"), F.lit(65)).otherwise(F.lit(97))
        spell = lambda v, j: F.chr(F.when(v < 10, v + 48).otherwise(v - 10 + letter))
    else:
        spell = lambda v, j: let(code(j + 1), lambda c: F.when((c >= 48) & (c <= 57), F.chr(v + 48)).when((c >= 97) & (c <= 122), F.chr(v + 97)).when((c >= 65) & (c <= 90), F.chr(v + 65)).otherwise(F.chr(c)))
    return F.array_join(F.transform(done, spell), "")


def _email(value: Column, key: str) -> Column:
    local = F.substring_index(value, "@", 1)
    return F.concat(let(local, lambda s: _mixed(s, key, "email", False)), F.lit("@"), F.substring_index(value, "@", -1))


MAKERS = {"email": _email, "secret": lambda v, k: _mixed(v, k, "secret", True), "date": _date, "ip": _ip, "social": _social, "phone": _phone, "card": _card}


def pseudonym(value: Column, key: str) -> Column:
    """Kind and pseudonym of one candidate; both null where no format validates it."""
    out = None
    for kind, pattern in PATTERNS.items():
        whole = value.rlike(f"^(?:{pattern})$")
        hit = F.when(whole, F.struct(F.lit(kind).alias("kind"), MAKERS[kind](value, key).alias("value")))
        out = hit if out is None else F.coalesce(out, hit)
    return out


def _cut(text: Column) -> Column:
    """The pattern of one text's candidates: all kinds, with cards by their valid values."""
    tried = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), 1) for p in CARD_TRIES]))
    valid = F.array_distinct(F.filter(tried, lambda c: luhn_sum(digits_of(c)) % 10 == 0))
    some = F.when(text.rlike("[0-9](?:[ -]?[0-9]){12}"), let(valid, lambda v: F.when(F.size(v) > 0, F.array_join(v, "|"))))
    return F.coalesce(F.concat(F.lit(rf"{FIRST}|(?<![0-9A-Za-z])(?:"), some, F.lit(rf")(?![0-9A-Za-z])|{REST}")), F.lit(f"{FIRST}|{REST}"))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", counts: str | None = None) -> DataFrame:
    """Rewrites ``text``; ``counts`` names a column for the number of values replaced, by kind."""
    column, own, new, cut = F.col(text), fresh(docs, "found"), fresh(docs, "rebuilt"), fresh(docs, "cut")
    gaps = F.split(column, F.col(cut), -1)
    found = F.transform(F.regexp_extract_all(column, F.col(cut), 0), lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new")))
    some = docs.withColumn(cut, _cut(column)).withColumn(own, F.when(column.rlike("[0-9@]|[A-Fa-f]{32}"), found))
    told = F.transform(own, lambda p: F.coalesce(p["new"]["value"], p["old"]))
    rebuilt = F.array_join(F.zip_with(gaps, F.concat(told, F.array(F.lit(""))), lambda g, m: F.concat(g, m)), "")
    out = some.withColumn(new, F.when(F.size(own) > 0, rebuilt).otherwise(column))
    if counts:
        kinds = F.filter(F.transform(own, lambda p: F.when(p["new"]["value"].isNotNull(), p["new"]["kind"])), lambda k: k.isNotNull())
        out = out.withColumn(counts, F.coalesce(kinds, F.array().cast("array<string>")))
    return out.withColumn(text, F.col(new)).drop(own, new, cut)
