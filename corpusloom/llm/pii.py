"""Format-preserving pseudonyms for private values, in DataFrame functions only.

Numbers and dates that pass their format's validation are permuted within the format by a
keyed Feistel network, so equal values get equal pseudonyms in every document and distinct
values stay distinct:

* payment cards (13 to 19 digits, or four groups of four, that pass the Luhn test): all
  digits but the last are permuted, the check digit is computed anew;
* telephone numbers (+1 (ddd) ddd-dddd, ddd-ddd-dddd): those whose area and exchange start
  with 2 to 9 are permuted among themselves, and so are the others;
* social-security numbers (ddd-dd-dddd, area 001 to 899 but not 666, no all-zero group)
  are permuted by their rank among all such numbers;
* IPv4 addresses (octets up to 255): the 32 bits are permuted;
* dates of the years 1800 to 2199 (yyyy-mm-dd, dd/mm/yyyy): the day is permuted within
  these 400 years, 146,097 = 189 * 773 days, on the two residues.

E-mail addresses and hexadecimal secrets (32 digits or more) have no validated number:
they take keyed hashes in their alphabet. Values that fail validation stay as they are.

Feistel rounds add SHA-256 of (key, format, round, other half) to one half, modulo the
size of that half's range; adding is invertible, so each format is permuted onto itself,
and a pseudonym passes the validation that its value passed.

The key is required. It is a literal of the plan: whoever may read plans and event logs of
the job may read the key.

Defined results: a null text stays null, an empty one empty, both with no value found.
Repeated rows are rewritten alike. All other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import unused

ROUNDS = 8

# every alternative starts only where a run of its characters starts: linear time
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
SECRET = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])"
DATE = r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})(?![\d/-])"
PHONE = r"(?<![\d-])(?:\+1 ?\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?![\d-])"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
ADDRESS = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{4} \d{4} \d{4})(?!\d)"
#: What every text with a match of ANY has, in patterns that fail fast on prose.
LIKELY = (r"[0-9A-Fa-f]{32}", r"\d[\d ./()-]{5,}\d")
ANY = "|".join(f"(?:{p})" for p in (EMAIL, SECRET, DATE, PHONE, SOCIAL, ADDRESS, CARD))

#: Days from 1970-01-01 to 1800-01-01, and the residues whose product is 400 years.
FIRST_DAY, RESIDUES = -62091, (189, 773)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def keyed(key: str, *parts: Column | str) -> Column:
    """SHA-256 of the key and the parts, in hexadecimal."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *(p if isinstance(p, Column) else F.lit(p) for p in parts)), 256)


def feistel(key: str, kind: Column | str, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """A keyed permutation of pairs with 0 <= left < left_size, 0 <= right < right_size
    (both at most 10**10), as struct(left, right)."""

    def add(half: Column, other: Column, size: Column, turn: Column) -> Column:
        noise = F.conv(F.substring(keyed(key, kind, turn.cast("string"), other.cast("string")), 1, 14), 16, 10).cast("long")
        return (half + noise) % size

    def step(pair: Column, turn: Column) -> Column:
        a = add(pair["left"], pair["right"], left_size, turn)
        return F.struct(a.alias("left"), pair["right"].alias("right"), turn.alias("turn"))

    def back(pair: Column) -> Column:
        b = add(pair["right"], pair["left"], right_size, pair["turn"])
        return F.struct(pair["left"].alias("left"), b.alias("right"), pair["turn"].alias("turn"))

    start = F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"), F.lit(0).alias("turn"))
    turns = F.sequence(F.lit(1), F.lit(2 * ROUNDS))
    return F.aggregate(turns, start, lambda pair, turn: F.when(turn % 2 == 1, step(pair, turn)).otherwise(back(F.struct(pair["left"].alias("left"), pair["right"].alias("right"), turn.alias("turn")))))


def digits_only(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def permute_digits(key: str, kind: str, digits: Column) -> Column:
    """A keyed permutation of digit strings of one length (2 to 20)."""
    size = lambda k: F.pow(F.lit(10.0), k).cast("long")

    def permuted(parts: Column) -> Column:
        d, n, a = parts["digits"], parts["n"], parts["a"]
        left, right = F.substring(d, F.lit(1), a), F.substring(d, a + 1, n)
        pair = feistel(key, F.concat(F.lit(kind), n.cast("string")), left.cast("long"), right.cast("long"), size(a), size(n - a))
        return let(pair, lambda p: F.concat(F.lpad(p["left"].cast("string"), a, F.lit("0")), F.lpad(p["right"].cast("string"), n - a, F.lit("0"))))

    n = F.length(digits)
    return let(F.struct(digits.alias("digits"), n.alias("n"), F.floor(n / 2).cast("int").alias("a")), permuted)


def padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def permute_social(key: str, digits: Column) -> Column:
    """A keyed permutation of the valid nine-digit numbers: 898 areas, 99 groups, 9,999
    serials."""
    part = lambda at, n: F.substring(digits, at, n).cast("long")
    area = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)
    pair = feistel(key, "social", area, (part(4, 2) - 1) * 9999 + part(6, 4) - 1, F.lit(898), F.lit(99 * 9999))
    back = lambda a: a + F.when(a >= 665, 2).otherwise(1)
    return let(pair, lambda p: F.concat(padded(back(p["left"]), 3), padded(F.floor(p["right"] / 9999) + 1, 2), padded(p["right"] % 9999 + 1, 4)))


def permute_phone(key: str, digits: Column) -> Column:
    """A keyed permutation of ten-digit numbers: of the 800 * 800 * 10**4 whose area and
    exchange are at least 200, and of the 60,000**2 others."""
    area, exchange, line = (F.substring(digits, at, n).cast("long") for at, n in ((1, 3), (4, 3), (7, 4)))
    dialled = feistel(key, "phone", area - 200, (exchange - 200) * 10_000 + line, F.lit(800), F.lit(8_000_000))
    valid = let(dialled, lambda p: F.concat(padded(p["left"] + 200, 3), padded(p["right"] + 2_000_000, 7)))
    # the others in order: areas below 200, then exchanges below 200 of the other areas
    low = 200 * 1000 * 10_000
    rank = F.when(area < 200, (area * 1000 + exchange) * 10_000 + line).otherwise(low + ((area - 200) * 200 + exchange) * 10_000 + line)
    moved = let(rank, lambda r: feistel(key, "other phone", F.floor(r / 60_000), r % 60_000, F.lit(60_000), F.lit(60_000)))
    number = let(let(moved, lambda p: p["left"] * 60_000 + p["right"]), lambda r: F.when(r < low, r).otherwise(F.floor((r - low) / 2_000_000 + 200) * 10_000_000 + (r - low) % 2_000_000))
    return F.when((area >= 200) & (exchange >= 200), valid).otherwise(padded(number, 10))


def refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced, in order, by ``digits``."""
    one = lambda i: F.substring(value, i, F.lit(1))
    nth = lambda i: F.length(digits_only(F.substring(value, F.lit(1), i)))

    def filled(d: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.when(one(i).between("0", "9"), F.substring(d, nth(i), F.lit(1))).otherwise(one(i))), "")

    return let(digits, filled)


def luhn_sum(digits: Column, odd: int) -> Column:
    """Luhn sum from the right; the rightmost digit is doubled if ``odd`` is 1."""
    n = F.length(digits)

    def term(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1 - odd, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), term)


def pseudonym(key: str, value: Column) -> Column:
    """The pseudonym of one matched value; null where it fails its format's validation."""
    whole = lambda p: value.rlike(f"^(?:{p})$")
    digits = digits_only(value)
    body = permute_digits(key, "card", F.substring(digits, F.lit(1), F.length(digits) - 1))
    card = refill(value, let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(b, 1), F.lit(10)).cast("string"))))
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("int"))
    spread = lambda pair: F.concat_ws(".", *(x.cast("string") for half in (pair["left"], pair["right"]) for x in (F.shiftright(half.cast("int"), 8), half % 256)))
    address = let(octets, lambda o: let(feistel(key, "address", o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536)), spread))
    iso = F.substring(value, 5, 1) == "-"
    read = F.when(iso, F.try_to_timestamp(value, F.lit("yyyy-MM-dd"))).otherwise(F.try_to_timestamp(value, F.lit("dd/MM/yyyy"))).cast("date")
    u, v = RESIDUES

    def moved(day: Column) -> Column:
        pair = feistel(key, "date", F.floor(day / v), day % v, F.lit(u), F.lit(v))
        date = let(pair, lambda p: F.date_add(F.lit("1970-01-01").cast("date"), (p["left"] * v + p["right"] + FIRST_DAY).cast("int")))
        return F.when(day.between(0, u * v - 1), let(date, lambda d: F.when(iso, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "dd/MM/yyyy"))))

    name = keyed(key, "mail", F.lower(value))
    secret = F.array_join(F.transform(F.sequence(F.lit(0), F.ceil(F.length(value) / 64).cast("int") - 1), lambda i: keyed(key, "secret", F.lower(value), i.cast("string"))), "")
    secret = F.substring(secret, F.lit(1), F.length(value))
    return (
        F.when(value.contains("@"), let(name, lambda n: F.concat(F.lit("u"), F.substring(n, 1, 12), F.lit("@m"), F.substring(n, 13, 8), F.lit(".invalid"))))
        .when(whole(DATE), let(F.unix_date(read) - FIRST_DAY, moved))
        .when(whole(ADDRESS), F.when(F.forall(octets, lambda o: o <= 255), address))
        .when(whole(SOCIAL), F.when(~value.rlike("^(?:000|666|9)|-00-|-0000$"), refill(value, permute_social(key, digits))))
        .when(whole(PHONE), F.when(value.startswith("+"), refill(value, F.concat(F.lit("1"), permute_phone(key, F.substring(digits, 2, 10))))).otherwise(refill(value, permute_phone(key, digits))))
        .when(whole(CARD), F.when(luhn_sum(digits, 0) % 10 == 0, card))
        .otherwise(let(secret, lambda s: F.when(value == F.upper(value), F.upper(s)).otherwise(s)))
    )


def pseudonymise(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """``docs`` with private values in ``text`` replaced; all other columns stay.

    ``count`` names a column to add: the number of values replaced (long). Texts without
    a match are passed through. No shuffle."""
    if not key:
        raise ValueError("pseudonyms need a key")
    text = F.col("text")
    at = unused(docs, "found")
    found = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("value"), pseudonym(key, m).alias("to")))
    hit = F.coalesce(text.contains("@") | text.rlike(LIKELY[0]) | text.rlike(LIKELY[1]), F.lit(False))
    rows = docs.withColumn(at, F.when(hit, found))
    filled = F.concat(F.transform(F.col(at), lambda m: F.coalesce(m["to"], m["value"])), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(F.split(text, ANY, -1), filled, lambda between, value: F.concat(between, value)), "")
    rows = rows.withColumn("text", F.when(F.col(at).isNotNull(), joined).otherwise(text))
    if count:
        rows = rows.withColumn(count, F.when(F.col(at).isNull(), F.lit(0)).otherwise(F.size(F.filter(at, lambda m: m["to"].isNotNull()))).cast("long"))
    return rows.drop(at)


def session_key(spark: SparkSession) -> str:
    """The key named by ``corpusloom.pii.key`` in the session. The registered queries run
    over synthetic values; only for them a session without a key takes a public one."""
    return spark.conf.get("corpusloom.pii.key", "public key for synthetic tables")
