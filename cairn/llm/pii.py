"""Format-preserving pseudonyms for personal numbers and dates, in SQL functions only.

Values that pass their check (Luhn, mod 97, octets, calendar) are permuted by a keyed Feistel network within their
format: digits stay digits, letters letters, a card keeps a valid check digit, a date is another valid date in the same
layout. Blanks and other separators take no part: they are put back where they stood. So equal values get equal
pseudonyms in every document and every layout, different values different ones.

A value may stand next to other words and numbers. Addresses and account numbers are sought first, then telephone numbers, then
cards, which may begin and end at any group of a run of digits, then dates and the rest. What has been replaced is done; what only
looked like a value, and what is left before and behind one, is text again for the next search.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import let

ROUNDS = 10
#: Days of 400 Gregorian years, after which the calendar repeats, as a product for the two halves of a date.
CYCLE, HALVES = 146_097, (189, 773)
#: Dates have four-digit years: the years from 200 to 9799 are 24 times 400, and the days before and after them are one more set.
EDGE_HALVES, BEFORE = (93, 1567), 72_683
#: The telephone country codes of one and two digits; all others have three.
COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

#: Lengths of account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Digits after the country code, where a country's telephone numbers all have as many.
NATIONAL = {"1": 10, "7": 10, "30": 10, "31": 9, "32": 9, "33": 9, "34": 9, "36": 9, "40": 9, "41": 9, "44": 10, "45": 8, "47": 8, "48": 9, "61": 9, "91": 10, "351": 9, "380": 9, "420": 9, "421": 9}

EMAIL = r"(?<![\p{L}\p{N}.+_%-])[\p{L}\p{N}][\p{L}\p{N}.+_%-]{0,63}@[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9][A-Za-z0-9-]{0,62})+"
#: An account number has its country's length; one of a country that isn't known may end with any of its groups.
KNOWN = "|".join(f"(?:{'|'.join(codes.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
OTHER = rf"(?!{'|'.join(c for codes in IBAN_LENGTHS.values() for c in codes.split())})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?"
IBAN, OTHER_IBAN = (rf"(?<![A-Za-z0-9])(?:{p})(?![A-Za-z0-9])" for p in (KNOWN, OTHER))
ISO_DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
DATE = r"(?<![0-9./])(?:[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9/])"
IPV4 = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"
PHONE = r"(?<![\p{L}\p{N}+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
LOCAL_PHONE = r"(?<![\p{L}\p{N}.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![\p{L}\p{N}-])"
SSN = r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])"
#: Thirteen digits or more in groups, and what is joined to the last of them: letters, or more digits behind a dot or a slash.
TAIL = r"[./][0-9./]*+"
RUN = rf"(?<![\p{{L}}\p{{N}}])(?<![0-9]\.)[0-9](?:[ -]?[0-9]){{12,}}+(?:[\p{{L}}\p{{N}}]++|{TAIL})?+"
ADDRESS = f"{EMAIL}|{IBAN}"
SMALL = f"{ISO_DATE}|{DATE}|{IPV4}|{LOCAL_PHONE}|{SSN}"
#: Stands around matches while a text is cut; texts that have it are cut more slowly.
MARK = "\ue000"
#: Lengths of the groups in which cards are printed.
CARD_GROUPS = "^(?:1[3-9]|4-4-4-[1-4]|4-4-4-4-[1-3]|4-6-[45])$"


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def feistel(values: Column, radices: Column, key: Column) -> Column:
    """Permutes an array of int, each from 0 to below its radix: in turn the even and the odd places are moved on by one keyed
    hash of the others."""

    def one(now: Column, r: Column) -> Column:
        turn = lambda i: i % 2 == r % 2
        others = F.array_join(F.filter(now, lambda _, j: ~turn(j)).cast("array<string>"), ",")
        number = lambda h, i: F.conv(F.substr(h, 4 * F.pmod((i / 2).cast("int"), F.lit(32)) + 1, F.lit(4)), 16, 10).cast("int")
        return let(
            F.sha2(F.concat_ws("|", key, r, others), 512),  # four of its 128 digits for each place
            lambda h: F.transform(now, lambda v, i: F.when(turn(i), F.pmod(v + number(h, i), F.get(radices, i)).cast("int")).otherwise(v)),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, one)


def moves(c: Column) -> Column:
    """Whether a character takes part: ASCII digits and letters do."""
    return c.between("0", "9") | c.between("a", "z") | c.between("A", "Z")


def bare(text: Column) -> Column:
    """The characters of text that take part."""
    return F.filter(chars(text), moves)


def relaid(text: Column, new: Column) -> Column:
    """text with the characters that take part replaced by those of the array `new`, one by one."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def put(done: Column, c: Column) -> Column:
        return F.struct(
            F.concat(done["out"], F.when(moves(c), F.get(new, done["at"])).otherwise(c)).alias("out"), (done["at"] + moves(c).cast("int")).alias("at")
        )

    return F.aggregate(chars(text), start, put, lambda done: done["out"])


def moved(letters: Column, key: Column) -> Column:
    """An array of ASCII digits and letters permuted within their kinds."""
    base = lambda c: F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).otherwise(65)
    radices = F.transform(letters, lambda c: F.when(c.between("0", "9"), 10).otherwise(26))
    values = feistel(F.transform(letters, lambda c: F.ascii(c) - base(c)), radices, key)
    return F.zip_with(letters, values, lambda c, v: F.char(base(c) + v))


def permuted(text: Column, key: Column) -> Column:
    """ASCII digits and letters permuted within their kind; every other character stays, and takes no part."""
    return let(bare(text), lambda letters: relaid(text, moved(letters, key)))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a text of digits whose last digit counts once."""
    return F.aggregate(
        F.transform(
            F.reverse(chars(digits)).cast("array<int>"),
            lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d),
        ),
        F.lit(0),
        lambda a, d: a + d,
    )


def mod97(text: Column) -> Column:
    """The number that digits and letters (A = 10) spell, modulo 97."""
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars(text), F.lit(0), lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97)


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def joined(letters: Column) -> Column:
    return F.array_join(letters, "")


def cut(text: Column, pattern: str) -> Column:
    """text in pieces: those at odd places match, and all of them, joined, are the text."""
    by_marks = F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)
    pair = lambda gap, m: F.when(m.isNull(), F.array(gap)).otherwise(F.array(gap, m))
    one_by_one = F.flatten(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), pair))
    return F.when(text.contains(MARK), one_by_one).otherwise(by_marks)


def _new_card(card: Column, key: Column) -> Column:
    """All but the last digit are moved; the last makes the Luhn sum a multiple of ten."""
    letters = bare(card)
    body = moved(F.slice(letters, F.lit(1), F.size(letters) - 1), key)
    last = lambda x: F.pmod(-luhn_sum(F.concat(joined(x), F.lit("0"))), F.lit(10)).cast("string")
    return let(body, lambda x: relaid(card, F.concat(x, F.array(last(x)))))


def piece(text: Column, done: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(done).alias("done"))


PIECES = "array<struct<text:string,done:boolean>>"


def after(pieces: Column, sign: str, pattern: str, replaced: Callable[[Column], Column]) -> Column:
    """Pieces (text, done) after a search in those that aren't done: replaced(match) gives the pieces that stand for a match. Neighbours that
    aren't done become one piece, so that the next search sees them whole. Every match holds a sign, which is sought faster."""

    def found(p: Column) -> Column:
        def parts(xs: Column) -> Column:
            each = F.transform(xs, lambda x, i: F.when(i % 2 == 1, replaced(x)).otherwise(F.array(piece(x, False))))
            return F.when(F.size(xs) > 1, F.flatten(each)).otherwise(F.array(p))

        return F.when(p["done"] | ~p["text"].rlike(sign), F.array(p)).otherwise(let(cut(p["text"], pattern), parts))

    def join(kept: Column, p: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        longer = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(F.struct(F.concat(last["text"], p["text"]).alias("text"), F.lit(False).alias("done"))))
        return F.when((F.size(kept) > 0) & ~p["done"] & ~F.coalesce(last["done"], F.lit(True)), longer).otherwise(F.concat(kept, F.array(p)))

    return F.aggregate(F.flatten(F.transform(pieces, found)), F.array().cast(PIECES), join)


def cards_in(groups: Column, gaps: Column) -> Column:
    """Cards in an array of groups, gaps[i] being what stands before group i, as structs (at, n) of the first group's place, from 0, and the
    number of groups, in order: 13 to 19 digits with a good Luhn sum. Those in groups as cards are printed go before others, which
    need the same separator throughout and no hyphen to a neighbour; then of those that overlap the one that begins first, then the
    longest."""

    def found(at: Column) -> Column:
        def one(n: Column) -> Column:
            part = F.slice(groups, at + 1, n)
            inside = F.array_distinct(F.slice(gaps, at + 2, n - 1))
            loose = (F.size(inside) > 1) | (F.get(gaps, at) == "-") | (F.get(gaps, at + n) == "-")
            digits, sizes = F.array_join(part, ""), F.array_join(F.transform(part, lambda g: F.length(g).cast("string")), "-")
            odd = ~sizes.rlike(CARD_GROUPS)
            fits = F.length(digits).between(13, 19) & ~(odd & loose) & F.forall(part, lambda g: g.rlike("^[0-9]+$"))
            good = F.when(fits, luhn_sum(digits) % 10 == 0).otherwise(False)
            return F.when(good, F.struct(odd.alias("odd"), at.alias("at"), (-n).alias("less")))

        return F.transform(F.sequence(F.lit(1), F.least(F.lit(19), F.size(groups) - at)), one)

    ranked = F.array_sort(F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.size(groups) - 1), found))))
    none = F.array().cast("array<struct<at:int,n:int>>")

    def take(kept: Column, c: Column) -> Column:
        clash = F.exists(kept, lambda k: (k["at"] < c["at"] - c["less"]) & (c["at"] < k["at"] + k["n"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(F.struct(c["at"].alias("at"), (-c["less"]).alias("n")))))

    return F.array_sort(F.aggregate(ranked, none, take))


def _run(m: Column, key: Column) -> Column:
    """The pieces of a run of groups: its cards are done."""
    body = F.substr(m, F.lit(1), F.length(m) - F.length(F.regexp_extract(m, f"{TAIL}$", 0)))

    def parts(groups: Column, gaps: Column, cards: Column) -> Column:
        def text(first: Column, n: Column) -> Column:
            """Groups from `first` on, with what stands between them."""
            return F.array_join(F.transform(F.slice(groups, first + 1, n), lambda g, i: F.concat(F.when(i > 0, F.get(gaps, first + i)).otherwise(""), g)), "")

        def card(c: Column, i: Column) -> Column:
            last = F.get(cards, i - 1)
            begin = F.when(i > 0, last["at"] + last["n"]).otherwise(0)
            between = F.concat(text(begin, c["at"] - begin), F.when(c["at"] > 0, F.get(gaps, c["at"])).otherwise(""))
            lead = F.when((i > 0) & (c["at"] > begin), F.get(gaps, begin)).otherwise("")
            return F.array(piece(F.concat(lead, between), False), piece(_new_card(text(c["at"], c["n"]), key), True))

        last = F.get(cards, F.size(cards) - 1)
        end = F.length(text(F.lit(0), last["at"] + last["n"]))
        rest = piece(F.substr(m, end + 1), False)
        return F.when(F.size(cards) > 0, F.concat(F.flatten(F.transform(cards, card)), F.array(rest))).otherwise(F.array(piece(m, False)))

    groups, gaps = F.regexp_extract_all(body, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.split(body, r"[\p{L}\p{N}]+", -1)
    return let(groups, lambda g: let(gaps, lambda x: let(cards_in(g, x), lambda c: parts(g, x, c))))


def _iban(m: Column, key: Column, known: bool) -> Column:
    """The pieces of what may be an account number: all of m if its length is known, else the longest part of m from its start to the end
    of a group, must pass mod 97."""

    def good(end: Column) -> Column:
        letters = F.regexp_replace(F.substr(m, F.lit(1), end), " ", "")
        ends = (end == F.length(m)) | (F.substr(m, end + 1, F.lit(1)) == " ")
        return F.when(ends & F.length(letters).between(15, 34), mod97(F.concat(F.substr(letters, F.lit(5)), F.substr(letters, F.lit(1), F.lit(4)))) == 1).otherwise(False)

    def new(iban: Column) -> Column:
        def put(letters: Column) -> Column:
            country, rest = F.slice(letters, 1, 2), F.slice(letters, F.lit(5), F.size(letters) - 4)
            check = lambda x: chars(F.lpad((98 - mod97(F.concat(joined(x), joined(country), F.lit("00")))).cast("string"), 2, "0"))
            return let(moved(rest, key), lambda x: relaid(iban, F.concat(country, check(x), x)))

        return let(bare(iban), put)

    ends = F.filter(F.array(F.length(m)) if known else F.sequence(F.lit(1), F.length(m)), good)
    split = lambda end: F.array(piece(new(F.substr(m, F.lit(1), end)), True), piece(F.substr(m, end + 1), False))
    return let(F.array_max(ends), lambda end: F.when(end.isNotNull(), split(end)).otherwise(F.array(piece(m, False))))


def _ip(m: Column, key: Column) -> Column:
    return F.array_join(feistel(F.split(m, r"\.").cast("array<int>"), F.array(*[F.lit(256)] * 4), key).cast("array<string>"), ".")


def moved_day(day: Column, key: Column) -> Column:
    """Another day of the same 400 years, counted from the year 200; days of the years before 200 and from 9800 on change places
    with each other."""
    first, last = F.lit("0001-01-01").cast("date"), F.lit("9799-12-31").cast("date")
    n = F.date_diff(day, first)
    inner = (n >= BEFORE) & (day <= last)
    since = n - BEFORE
    place = F.when(inner, F.pmod(since, F.lit(CYCLE))).when(day > last, since - 24 * CYCLE + BEFORE).otherwise(n)

    halves = F.when(inner, F.array(*map(F.lit, HALVES))).otherwise(F.array(*map(F.lit, EDGE_HALVES)))

    def placed(p: Column) -> Column:
        def back(h: Column) -> Column:
            q = F.get(h, 0) * F.get(halves, 1) + F.get(h, 1)
            edge = F.when(q < BEFORE, q).otherwise(q + 24 * CYCLE)
            return F.date_add(first, F.when(inner, n - p + q).otherwise(edge).cast("int"))

        pair = F.array((p / F.get(halves, 1)).cast("int"), F.pmod(p, F.get(halves, 1)).cast("int"))
        return let(feistel(pair, halves, key), back)

    return let(place, placed)


def _date(m: Column, key: Column) -> Column:
    """year-month-day; day/month/year, or month/day/year where only that is a date; single digits stay unpadded if the first two numbers fit."""
    mark = F.regexp_extract(m, "([./-])", 1)

    def parts(p: Column) -> Column:
        iso = F.length(F.get(p, 0)) == 4
        a, b, year = F.get(p, F.when(iso, 2).otherwise(0)), F.get(p, 1), F.get(p, F.when(iso, 0).otherwise(2))
        day = lambda d, mo: F.concat_ws("-", year, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")
        padded = (F.length(a) == 2) & (F.length(b) == 2)

        def laid(new: Column) -> Column:
            one = lambda f: F.when(padded, F.date_format(new, f)).otherwise(F.date_format(new, f[0]))
            dated = day(a, b).isNotNull()
            d, mo = one("dd"), one("MM")
            text = F.concat(F.when(dated, d).otherwise(mo), mark, F.when(dated, mo).otherwise(d), mark, F.date_format(new, "yyyy"))
            return F.when(new.isNull(), m).when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(text)

        known = F.coalesce(day(a, b), F.when(~iso, day(b, a)))
        return let(F.when(known.isNotNull(), moved_day(known, key)), laid)

    return let(F.split(m, "[./-]"), parts)


def _email(m: Column, key: Column) -> Column:
    return F.concat(permuted(F.substring_index(m, "@", 1), key), F.lit("@"), F.substring_index(m, "@", -1))


def _phone(m: Column, key: Column) -> Column:
    """The pieces of what may be a telephone number. The country code stays; which digits it has follows from the digits alone. Where a
    country's numbers all have one length, what follows that is no part of the number; else 8 to 15 digits are one."""

    def parts(letters: Column) -> Column:
        code = F.length(F.regexp_extract(joined(letters), COUNTRY, 0))
        length = F.element_at(F.create_map(*[F.lit(x) for pair in NATIONAL.items() for x in pair]), joined(F.slice(letters, F.lit(1), code))) + code
        end = F.get(F.filter(F.sequence(F.lit(1), F.length(m)), lambda i: F.substr(m, i, F.lit(1)).between("0", "9")), length - 1)
        ends_there = (F.size(letters) > length) & ~F.substr(m, end + 1, F.lit(1)).between("0", "9")
        upto = F.when(ends_there, end).when(F.size(letters).between(8, 15), F.length(m))

        def put(upto: Column) -> Column:
            text = F.substr(m, F.lit(1), upto)
            own = bare(text)
            new = let(own, lambda x: relaid(text, F.concat(F.slice(x, F.lit(1), code), moved(F.slice(x, code + 1, F.size(x) - code), key))))
            return F.when(upto.isNotNull(), F.array(piece(new, True), piece(F.substr(m, upto + 1), False))).otherwise(F.array(piece(m, False)))

        return let(upto, put)

    return let(bare(m), parts)


def _address(m: Column, key: Column) -> Column:
    named = lambda k: F.concat_ws("|", key, F.lit(k))
    return F.when(m.contains("@"), F.array(piece(_email(m, named("email")), True))).otherwise(_iban(m, named("iban"), True))


def _small(m: Column, key: Column) -> Column:
    """A date, address of a computer, local telephone number or social security number. One day gets one pseudonym in any layout."""
    named = lambda k: F.concat_ws("|", key, F.lit(k))
    number = F.when(m.rlike(f"^(?:{SSN})$"), "ssn").otherwise("local_phone")
    new = F.when(m.rlike(f"^(?:{ISO_DATE}|{DATE})$"), _date(m, named("date"))).when(m.rlike(f"^(?:{IPV4})$"), _ip(m, named("ip")))
    return F.array(piece(new.otherwise(permuted(m, F.concat_ws("|", key, number))), True))


def pseudonymised(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text with pseudonyms, changed (whether any value in it was replaced).

    A null text stays null, an empty one empty, both unchanged; null identifiers stay null, repeated rows are repeated.
    Whoever knows the key can compute pseudonyms, so keep it secret. Other columns are ignored.
    """
    text, secret = F.col(f"`{text_col}`"), F.lit(key)
    named = lambda k: F.lit(f"{key}|{k}")
    t = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("given"), F.array(piece(text, False)).alias("pieces"))
    for sign, pattern, replaced in (
        ("@|[A-Z]{2}[0-9]{2}", ADDRESS, lambda m: _address(m, secret)),
        ("[A-Z]{2}[0-9]{2}", OTHER_IBAN, lambda m: _iban(m, named("iban"), False)),
        (r"\+[0-9]", PHONE, lambda m: _phone(m, named("phone"))),
        ("[0-9](?:[ -]?[0-9]){12}", RUN, lambda m: _run(m, named("card"))),
        ("[0-9][./-][0-9]", SMALL, lambda m: _small(m, secret)),
    ):
        t = t.withColumn("pieces", after(F.col("pieces"), sign, pattern, replaced))
    new = F.when(F.col("given").isNotNull(), F.array_join(F.transform("pieces", lambda p: p["text"]), ""))
    out = t.select("doc_id", "given", new.alias("text"))
    return out.select("doc_id", "text", F.coalesce(F.col("text") != F.col("given"), F.lit(False)).alias("changed"))
