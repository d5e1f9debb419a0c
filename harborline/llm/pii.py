"""Format-preserving pseudonyms: personal numbers, dates and addresses are permuted by keyed Feistel rounds.

Every kind has a domain of valid values, written as pairs (a, b) with a < A and b < B. A round adds a keyed hash of one
part to the other, modulo its size, so the rounds are a permutation of the domain whatever A and B are: valid values
become valid values of the same format, equal values equal ones, and no two values meet. Expressions only; nothing runs
in Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bind_value
from .common import hidden

KEY = "pseudonym-key"
ROUNDS = 8

# Bounds of the mail standard: 64 characters before the @, 63 a label. No pattern here repeats a group without a bound,
# so that unbroken text of any length neither fills the stack nor is read again from each of its characters.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,32}[A-Za-z]{2,63}"
DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"
ADDRESS = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
SECURITY = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
# Ten digits with any area and exchange, in parts or plain; plain ones do not touch letters, points or commas.
PHONE = (r"(?<![\d-])(?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]?\d{4}(?!\d)"
         r"|(?<![\w.,-])(?:\+?1[ .-]?)?\d{10}(?![.,]?\w)")
# Numbers behind + or 00 with a country code, up to a card standing behind.
CARD_BEHIND = r"[ -](?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
ABROAD = (r"(?<![\w.+-])(?:\+ ?[1-9]|00(?=[1-9]\d{0,2}[ ./(-])[1-9])"
          rf"(?:(?!{CARD_BEHIND})[ .()/-]{{0,2}}\d){{6,14}}(?!\d)")
COUNTRY = r"^0*(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
# A run of digit groups, in parts of 120 digits; the cards in it are found by their groups.
RUN = r"(?:(?<!\d)|\G)\d(?:[ -]?\d){12,119}+"
CARD = r"\d(?:[ -]?\d){12,18}"
OTHER = "|".join((EMAIL, DATE, ADDRESS, SECURITY, PHONE, ABROAD))
ANY = f"{OTHER}|{RUN}"
# Most digits of a card, and the usual group lengths; an unbroken card is one group of 13 to 19.
CARD_DIGITS, CARD_GROUPS = 19, ("4 4 4 4", "4 6 5", "4 6 4", "4 4 4 4 3")
# Days in the 400 years from FIRST_DAY, in two factors.
FIRST_DAY, DATE_A, DATE_B = "1800-01-01", 189, 773


def keyed(key: Column | str, limit: Column | int, *parts: Column) -> Column:
    """A number below `limit` from SHA-256 of the key and the parts."""
    text = F.concat_ws("|", key if isinstance(key, Column) else F.lit(key), *[p.cast("string") for p in parts])
    digits = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")
    return F.pmod(digits, limit if isinstance(limit, Column) else F.lit(limit).cast("long"))


def feistel(key: Column | str, kind: str, a: Column, b: Column, size_a: Column | int, size_b: Column | int) -> Column:
    """Permute the pairs (a, b) with a < size_a and b < size_b; gives a struct of both."""

    size_a, size_b = (n if isinstance(n, Column) else F.lit(n).cast("long") for n in (size_a, size_b))

    def turn(s: Column, i: Column) -> Column:
        to_a = F.pmod(s["a"] + keyed(key, size_a, F.lit(kind), i, s["b"]), size_a)
        to_b = F.pmod(s["b"] + keyed(key, size_b, F.lit(kind), i, s["a"]), size_b)
        return F.when(i % 2 == 0, F.struct(to_a.alias("a"), s["b"].alias("b"))).otherwise(
            F.struct(s["a"].alias("a"), to_b.alias("b")))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def part(value: Column, start: int, length: int) -> Column:
    return F.substring(value, start, length).try_cast("long")


def fill(template: Column, digits: Column) -> Column:
    """The template with its digits replaced, in order, by the given ones."""
    return F.array_join(F.transform(
        F.sequence(F.lit(1), F.length(template)),
        lambda i: bind_value(F.substr(template, i, F.lit(1)), lambda c: F.when(
            c.rlike("[0-9]"), F.substr(digits, F.length(digits_of(F.substr(template, F.lit(1), i))), F.lit(1))).otherwise(c))), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last of them undoubled."""
    n = F.length(digits)
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda total, i: total + bind_value(
        F.substr(digits, i, F.lit(1)).cast("int"), lambda d: F.when((n - i) % 2 == 1, doubled(d)).otherwise(d)))


def _email(key: str, value: Column) -> Column:
    """The part before the @ with letters and digits moved within their class; the two halves key each other."""
    local = F.substring_index(value, "@", 1)
    half = F.floor(F.length(local) / 2).cast("int")

    def moved(own: Column, other: Column, i: Column) -> Column:
        def one(c: Column, k: Column) -> Column:
            def within(first: str, size: int) -> Column:
                base = F.lit(ord(first))
                return F.char(base + F.pmod(F.ascii(c) - base + keyed(key, size, F.lit("email"), i, k, other), F.lit(size)))

            return (F.when(c.rlike("[a-z]"), within("a", 26)).when(c.rlike("[A-Z]"), within("A", 26))
                    .when(c.rlike("[0-9]"), within("0", 10)).otherwise(c))

        chars = F.filter(F.split(own, ""), lambda c: c != "")
        return F.array_join(F.transform(chars, one), "")

    def turn(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(moved(s["l"], s["r"], i).alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), moved(s["r"], s["l"], i).alias("r")))

    start = F.struct(F.substr(local, F.lit(1), half).alias("l"), F.substr(local, half + 1, F.length(local)).alias("r"))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    return bind_value(done, lambda d: F.concat(d["l"], d["r"], F.lit("@"), F.substring_index(value, "@", -1)))


def _date(key: str, value: Column) -> Column:
    def moved(day: Column) -> Column:
        new = feistel(key, "date", F.floor(day / DATE_B), day % DATE_B, DATE_A, DATE_B)
        return bind_value(new, lambda d: F.date_format(
            F.date_add(F.lit(FIRST_DAY).cast("date"), (d["a"] * DATE_B + d["b"]).cast("int")), "yyyy-MM-dd"))

    day = F.datediff(F.try_to_date(value, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))
    return bind_value(day, lambda n: F.when((n >= 0) & (n < DATE_A * DATE_B), moved(n)))


def _address(key: str, value: Column) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))

    def moved(o: Column) -> Column:
        new = feistel(key, "address", (F.get(o, F.lit(0)) - 1) * 256 + F.get(o, F.lit(1)),
                      F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)), 255 * 256, 256 * 256)
        return bind_value(new, lambda d: F.concat_ws(
            ".", F.floor(d["a"] / 256) + 1, d["a"] % 256, F.floor(d["b"] / 256), d["b"] % 256))

    return bind_value(octets, lambda o: F.when(~F.exists(o, lambda x: x > 255) & (F.get(o, F.lit(0)) >= 1), moved(o)))


def _security(key: str, value: Column) -> Column:
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999."""

    def moved(d: Column) -> Column:
        area = part(d, 1, 3)
        new = feistel(key, "security", area - F.when(area > 666, 2).otherwise(1),
                      (part(d, 4, 2) - 1) * 9999 + part(d, 6, 4) - 1, 898, 99 * 9999)
        return bind_value(new, lambda x: fill(value, F.concat(
            F.lpad((x["a"] + F.when(x["a"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
            F.lpad((F.floor(x["b"] / 9999) + 1).cast("string"), 2, "0"),
            F.lpad((x["b"] % 9999 + 1).cast("string"), 4, "0"))))

    return bind_value(digits_of(value), lambda d: F.when(
        part(d, 1, 3).between(1, 899) & (part(d, 1, 3) != 666) & (part(d, 4, 2) > 0) & (part(d, 6, 4) > 0), moved(d)))


def _phone(key: str, value: Column) -> Column:
    """The last ten digits: any area, exchange and line."""

    def moved(d: Column) -> Column:
        ten = F.right(d, F.lit(10))
        new = feistel(key, "phone", part(ten, 1, 3), part(ten, 4, 7), 1000, 10_000_000)
        return bind_value(new, lambda x: fill(value, F.concat(
            F.substr(d, F.lit(1), F.length(d) - 10), F.lpad(x["a"].cast("string"), 3, "0"),
            F.lpad(x["b"].cast("string"), 7, "0"))))

    return bind_value(digits_of(value), moved)


def _abroad(key: str, value: Column) -> Column:
    """The digits behind the country code, which keys them."""

    def moved(d: Column, head: Column) -> Column:
        code = F.regexp_extract(d, COUNTRY, 1)
        n = F.length(d) - head
        high = F.floor(n / 2).cast("int")
        size = lambda k: F.pow(F.lit(10), k).cast("long")
        new = feistel(F.concat_ws("|", F.lit(key), code, n), "abroad", F.substr(d, head + 1, high).cast("long"),
                      F.substr(d, head + high + 1, n - high).cast("long"), size(high), size(n - high))
        return bind_value(new, lambda x: fill(value, F.concat(
            F.substr(d, F.lit(1), head), F.lpad(x["a"].cast("string"), high, "0"),
            F.lpad(x["b"].cast("string"), n - high, "0"))))

    return bind_value(digits_of(value), lambda d: bind_value(
        F.length(F.regexp_extract(d, COUNTRY, 0)), lambda head: moved(d, head)))


def _card(key: str, value: Column) -> Column:
    """All digits but the first; the check digit is made anew, so a valid number becomes a valid one."""

    def moved(d: Column) -> Column:
        n = F.length(d)
        low = F.substr(d, n - 6, F.lit(6))
        high = F.substr(d, F.lit(2), n - 8)
        size = F.pow(F.lit(10), n - 8).cast("long")

        def turn(s: Column, i: Column) -> Column:
            to_a = F.pmod(s["a"] + keyed(key, size, F.lit("card"), n, i, s["b"]), size)
            to_b = F.pmod(s["b"] + keyed(key, 1_000_000, F.lit("card"), n, i, s["a"]), F.lit(1_000_000).cast("long"))
            return F.when(i % 2 == 0, F.struct(to_a.alias("a"), s["b"].alias("b"))).otherwise(
                F.struct(s["a"].alias("a"), to_b.alias("b")))

        start = F.struct(high.cast("long").alias("a"), low.cast("long").alias("b"))
        new = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
        payload = bind_value(new, lambda x: F.concat(
            F.substr(d, F.lit(1), F.lit(1)), F.lpad(x["a"].cast("string"), n - 8, "0"), F.lpad(x["b"].cast("string"), 6, "0")))
        return bind_value(payload, lambda p: fill(value, F.concat(
            p, F.pmod(-luhn_sum(F.concat(p, F.lit("0"))), F.lit(10)).cast("string"))))

    return bind_value(digits_of(value), lambda d: F.when(luhn_sum(d) % 10 == 0, moved(d)))


KINDS: tuple[tuple[str, str, Callable[[str, Column], Column]], ...] = (
    ("email", EMAIL, _email), ("date", DATE, _date), ("address", ADDRESS, _address), ("security", SECURITY, _security),
    ("phone", PHONE, _phone), ("abroad", ABROAD, _abroad),
    ("card", "<.*>", lambda key, value: _card(key, F.regexp_replace(value, "[<>]", ""))),
)


def pseudonym(value: Column, key: str = KEY) -> Column:
    """The pseudonym of one found value, or the value itself where it is not valid in any kind."""
    out = None
    for _, pattern, make in KINDS:
        test = value.rlike(f"^(?:{pattern})$")
        made = make(key, value)
        out = F.when(test, made) if out is None else out.when(test, made)
    return F.coalesce(out, value)


def marked(run: Column) -> Column:
    """A run of digit groups with < and > around every card in it.

    Cards in the usual groups come first. Otherwise the longest valid sequence of whole groups, from the left, that does
    not reach into a card in the usual groups.
    """

    def numbers(groups: Column) -> Column:
        last = F.size(groups) - 1

        def joined(i: Column, k: Column) -> Column:
            return F.array_join(F.slice(groups, i + 1, k), "")

        def usual(i: Column) -> Column:
            shape = lambda k: F.array_join(F.transform(F.slice(groups, i + 1, k), lambda g: F.length(g).cast("string")), " ")
            out = F.when(F.length(F.get(groups, i)).between(13, CARD_DIGITS) & (luhn_sum(F.get(groups, i)) % 10 == 0), 1)
            for form in CARD_GROUPS:
                k = F.lit(len(form.split()))
                out = out.when((shape(k) == form) & (luhn_sum(joined(i, k)) % 10 == 0), k)
            return out.otherwise(0)

        def any_(i: Column, cards: Column) -> Column:
            """Number of groups of the longest valid sequence from group i, or NULL."""
            room = F.least(last - i + 1, F.lit(CARD_DIGITS))
            free = F.array_position(F.transform(F.slice(cards, i + 1, room), lambda n: n > 0), True)
            ends = F.sequence(F.when(free > 0, free.cast("int") - 1).otherwise(room), F.lit(1), F.lit(-1))
            return F.get(F.filter(ends, lambda k: bind_value(joined(i, k), lambda d: (
                F.length(d).between(13, CARD_DIGITS) & F.coalesce(luhn_sum(d) % 10 == 0, F.lit(False))))), F.lit(0))

        def walk(cards: Column) -> Column:
            def step(s: Column, i: Column) -> Column:
                n = F.when(F.get(cards, i) > 0, F.get(cards, i)).otherwise(F.coalesce(any_(i, cards), F.lit(0)))
                return F.when(i < s["next"], s).otherwise(bind_value(n, lambda k: F.struct(
                    (i + F.greatest(k, F.lit(1))).alias("next"),
                    F.when(k > 0, F.concat(s["cards"], F.array(F.struct(i.alias("from"), k.alias("n")))))
                    .otherwise(s["cards"]).alias("cards"))))

            start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<from:int,n:int>>").alias("cards"))
            return F.aggregate(F.sequence(F.lit(0), last), start, step)["cards"]

        def write(cards: Column) -> Column:
            opened = F.transform(cards, lambda c: c["from"])
            closed = F.transform(cards, lambda c: c["from"] + c["n"] - 1)
            marks = F.split(F.regexp_replace(run, "[0-9]", ""), "")
            return F.array_join(F.transform(groups, lambda g, i: F.concat(
                F.when(F.array_contains(opened, i), "<").otherwise(""), g,
                F.when(F.array_contains(closed, i), ">").otherwise(""),
                F.when(i < last, F.get(marks, i)).otherwise(""))), "")

        usuals = F.transform(F.sequence(F.lit(0), last), usual)
        return bind_value(usuals, lambda cards: bind_value(walk(cards), write))

    return bind_value(F.split(run, "[ -]"), numbers)


def values_of(found: Column) -> Column:
    """What was found, in parts: the cards (in < and >), other values and single characters of a run, else itself."""
    run = found.rlike(f"^(?:{RUN})$") & ~found.rlike(f"^(?:{OTHER})$")
    return F.when(run, F.regexp_extract_all(marked(found), F.lit(f"<[^>]*>|{OTHER}|[0-9 -]"), F.lit(0))).otherwise(F.array(found))


def pseudonymise(text: Column, key: str = KEY) -> Column:
    """A whole text with every valid personal value replaced. NULL stays NULL, a text without any stays as it is."""
    gaps = F.split(text, ANY, -1)
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    new = F.transform(found, lambda v: F.array_join(F.transform(values_of(v), lambda x: pseudonym(x, key)), ""))
    joined = F.array_join(F.zip_with(gaps, new, lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
    return F.when(text.rlike(ANY), joined).otherwise(text)


def values_in(text: Column) -> Column:
    """Number of values found; a run of digits no longer than a card is one at least."""
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    each = F.transform(found, lambda v: F.greatest(
        F.size(F.filter(values_of(v), lambda x: F.length(x) > 1)), F.when(v.rlike(f"^{CARD}$"), 1).otherwise(0)))
    return F.when(text.rlike(ANY), F.aggregate(each, F.lit(0), lambda n, k: n + k)).otherwise(0)


def pseudonymise_documents(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", key: str = KEY
) -> DataFrame:
    """The id, `text` with pseudonyms, and `n_values`, the number of values found.

    Digits that go on for more than 120, with single blanks or hyphens between, are read in parts; a card across two of
    them is not found. NULL text stays NULL with 0 values, an empty text stays empty. Repeated rows and NULL ids are rows like any other. An
    empty table gives no rows; extra columns are not read.
    """
    text = F.col(text_column)
    count = F.coalesce(values_in(text), F.lit(0))
    return docs.select(F.col(id_column), pseudonymise(text, key).alias("text"), count.cast("int").alias("n_values"))


def with_pseudonyms(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The documents with pseudonyms in `text` and `n_chars` brought in line; all columns stay."""
    old = hidden(docs, "text_before")
    changed = docs.withColumnRenamed("text", old).withColumn("text", pseudonymise(F.col(old), key))
    if "n_chars" in docs.columns:
        same = F.col(old).eqNullSafe(F.col("text"))
        changed = changed.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return changed.select(*docs.columns)
