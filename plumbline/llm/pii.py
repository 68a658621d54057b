"""Format-preserving Feistel pseudonyms for validated numbers and dates, as SQL expressions.

A text is searched once for runs of digits and what may stand between them, and for e-mail addresses. Inside a run every
form is tried at every start and length, and checked (Luhn, mod 97, calendar, ranges). A value's digits become two numbers, which a
keyed alternating Feistel network permutes modulo the sizes of their ranges. The product of the two ranges is exactly
the number of values of the form, so the map is one to one, needs no walk, and a pseudonym passes the same check.
Equal values have equal pseudonyms under one key, so they stay linked across documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import unused

#: Forms of personal data. What must not stand before and after a form is beside it.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){%d}"
DATE_ISO = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
DATE_DOT = r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}"
DATE_SLASH = r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
IPV4 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
PHONE = r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
PHONE_ABROAD = r"\+[2-9](?:[ .-]?\(?[0-9]\)?){%d}"
CARD = r"[0-9](?:[ -]?[0-9]){%d}"
#: Where a number may begin, and all that may belong to one. Between letters and digits there is none.
RUN = r"(?=[0-9+(]|[A-Z]{2}[0-9]{2})(?<![0-9A-Za-z])[A-Z+(]{0,3}[0-9][0-9A-Z .()/+-]{5,}(?![0-9A-Za-z])"

ROUNDS = 8
#: Days of a 400-year calendar cycle, 146097 = 773 * 189; the cycle used begins on 1700-01-01.
CYCLE = (773, 189)
ORIGIN = "1700-01-01"


def digits_of(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def number(digits: Column, start: int | Column, size: int | Column) -> Column:
    return F.coalesce(F.substr(digits, F.lit(start) if isinstance(start, int) else start, F.lit(size) if isinstance(size, int) else size).try_cast("bigint"), F.lit(0).cast("bigint"))


def feistel(left: Column, right: Column, lefts: Column | int, rights: Column | int, key: str, tweak: str) -> Column:
    """The pair (l, r) permuted within [0, lefts) x [0, rights). Odd rounds add to l a keyed hash of r, even rounds
    the other way."""
    lefts, rights = (F.lit(x).cast("bigint") if isinstance(x, int) else x.cast("bigint") for x in (lefts, rights))

    def noise(i: Column, x: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(f"{key}:{tweak}"), i.cast("string"), x.cast("string")), 256), 1, 14), 16, 10).cast("bigint")

    def step(pair: Column, i: Column) -> Column:
        l, r = pair["l"], pair["r"]
        odd = i % 2 == 1
        return F.struct(F.when(odd, (l + noise(i, r)) % lefts).otherwise(l).alias("l"), F.when(odd, r).otherwise((r + noise(i, l)) % rights).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r")), step)


def padded(x: Column, size: Column | int) -> Column:
    return F.lpad(x.cast("string"), size, "0")


def power10(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("bigint")


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """A digit string of 2 to 34 digits within its length; a shorter one is permuted as one number."""
    n = F.length(digits)
    first = n - F.floor(n / 2).cast("int")
    rest = n - first
    pair = feistel(number(digits, 1, first), number(digits, first + 1, rest), power10(first), power10(rest), key, tweak)
    return F.concat(padded(pair["l"], first), F.when(rest > 0, padded(pair["r"], rest)).otherwise(F.lit("")))


def refill(form: Column, digits: Column) -> Column:
    """The form with its digits replaced, in order; all else stays in place."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(acc: Column, ch: Column) -> Column:
        is_digit = ch.between("0", "9")
        return F.struct(F.concat(acc["out"], F.when(is_digit, F.substr(digits, acc["k"] + 1, F.lit(1))).otherwise(ch)).alias("out"), (acc["k"] + is_digit.cast("int")).alias("k"))

    return F.aggregate(F.split(form, ""), start, step)["out"]


def luhn_sum(digits: Column) -> Column:
    """Sum over a digit string whose last digit is the check digit."""
    marks = F.transform(F.split(F.reverse(digits), ""), lambda ch, i: F.when(i % 2 == 0, ch.try_cast("int")).otherwise((ch.try_cast("int") * 2) % 10 + F.floor(ch.try_cast("int") / 5).cast("int")))
    return F.aggregate(marks, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _card(v: Column, key: str) -> Column:
    d = digits_of(v)
    inner = permute_digits(F.substr(d, F.lit(2), F.length(d) - 2), key, "card")
    body = F.concat(F.substring(d, 1, 1), inner)
    check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    return refill(v, F.concat(body, check.cast("string")))


def _mod97(text: Column) -> Column:
    moved = F.concat(F.substr(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))

    def step(acc: Column, ch: Column) -> Column:
        code = F.ascii(ch)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _iban(v: Column, key: str) -> Column:
    compact = F.regexp_replace(v, " ", "")
    bban = F.substr(compact, F.lit(5), F.length(compact))
    new = F.when(F.length(digits_of(bban)) > 1, refill(bban, permute_digits(digits_of(bban), key, "iban"))).otherwise(bban)
    country = F.substring(compact, 1, 2)
    check = 98 - _mod97(F.concat(country, F.lit("00"), new))
    whole = F.concat(country, padded(check, 2), new)
    # only digits change, so refilling the form keeps letters and blanks
    return refill(v, digits_of(whole))


def _phone(v: Column, key: str) -> Column:
    d = digits_of(v)
    ten = F.right(d, F.lit(10))
    area, exchange, line = number(ten, 1, 3) - 200, number(ten, 4, 3) - 200, number(ten, 7, 4)
    n = area * 8_000_000 + exchange * 10_000 + line
    pair = feistel(F.floor(n / 80_000), n % 80_000, 80_000, 80_000, key, "phone")
    m = pair["l"] * 80_000 + pair["r"]
    new = F.concat((F.floor(m / 8_000_000) + 200).cast("string"), (F.floor(m / 10_000) % 800 + 200).cast("string"), padded(m % 10_000, 4))
    return refill(v, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), new))


def _abroad(v: Column, key: str) -> Column:
    """The country code up to the first mark stays; without a mark, the first two digits."""
    code = F.when(v.rlike(r"^\+[0-9]{1,3}[ .(-]"), F.regexp_extract(v, r"^\+([0-9]{1,3})[ .(-]", 1)).otherwise(F.substring(v, 2, 2))
    d = digits_of(v)
    return refill(v, F.concat(code, permute_digits(F.substr(d, F.length(code) + 1, F.length(d)), key, "abroad")))


def _ip(v: Column, key: str) -> Column:
    p = F.split(v, r"\.")
    part = [F.coalesce(F.get(p, i).try_cast("bigint"), F.lit(0).cast("bigint")) for i in range(4)]
    pair = feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], 65_536, 65_536, key, "ip")
    return F.concat_ws(".", *[x.cast("string") for x in (F.floor(pair["l"] / 256), pair["l"] % 256, F.floor(pair["r"] / 256), pair["r"] % 256)])


def _ssn(v: Column, key: str) -> Column:
    area, group, serial = number(v, 1, 3), number(v, 5, 2), number(v, 8, 4)
    place = F.when(area > 666, area - 2).otherwise(area - 1)  # 1 to 899 without 666
    pair = feistel(place * 99 + group - 1, serial - 1, 898 * 99, 9_999, key, "ssn")
    at = F.floor(pair["l"] / 99)
    return F.concat_ws("-", padded(F.when(at >= 665, at + 2).otherwise(at + 1), 3), padded(pair["l"] % 99 + 1, 2), padded(pair["r"] + 1, 4))


def _new_day(day: Column, key: str) -> Column:
    at = F.datediff(day, F.lit(ORIGIN).cast("date"))
    pair = feistel(F.floor(at / CYCLE[1]), at % CYCLE[1], CYCLE[0], CYCLE[1], key, "date")
    return F.date_add(F.lit(ORIGIN).cast("date"), (pair["l"] * CYCLE[1] + pair["r"]).cast("int"))


def _day(year: Column, month: Column, day: Column) -> Column:
    made = F.try_to_date(F.concat_ws("-", padded(year, 4), padded(month, 2), padded(day, 2)), "yyyy-MM-dd")
    return F.when(made.between(F.lit(ORIGIN).cast("date"), F.lit("2099-12-31").cast("date")), made)


def _iso_day(v: Column) -> Column:
    return _day(F.substring(v, 1, 4), F.substring(v, 6, 2), F.substring(v, 9, 2))


def _split_day(v: Column, mark: str, day: int) -> Column:
    p = F.split(v, f"[{mark}]")
    return _day(F.get(p, 2), F.get(p, 1 - day), F.get(p, day))


def _dated(v: Column, mark: str, day: int, key: str) -> Column:
    new = _new_day(_split_day(v, mark, day), key)
    full = F.regexp_extract(v, f"^[0-9]{{2}}[{mark}][0-9]{{2}}[{mark}]", 0) != ""
    parts = [F.date_format(new, "dd"), F.date_format(new, "MM")] if day == 0 else [F.date_format(new, "MM"), F.date_format(new, "dd")]
    plain = [p.cast("int").cast("string") for p in parts]
    return F.concat_ws(mark, *[F.when(full, a).otherwise(b) for a, b in zip(parts, plain)], F.date_format(new, "yyyy"))


def _email(v: Column, key: str) -> Column:
    """Letters and digits of the part before the @ are shifted within their kind, half by half, each half by a keyed
    hash of the other in small letters; the rest stays, and so do capitals, so that spellings of one address stay
    linked."""
    local, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    first = F.ceil(F.length(local) / 2).cast("int")

    def shifted(text: Column, i: Column, other: Column) -> Column:
        noise = F.sha2(F.concat_ws(":", F.lit(f"{key}:email"), i.cast("string"), F.lower(other)), 256)

        def one(ch: Column, k: Column) -> Column:
            by = F.conv(F.substr(noise, k * 2 + 1, F.lit(2)), 16, 10).cast("int")
            turn = lambda low, size: F.chr((F.ascii(ch) - low + by) % size + low)
            return F.when(ch.between("0", "9"), turn(48, 10)).when(ch.between("a", "z"), turn(97, 26)).when(ch.between("A", "Z"), turn(65, 26)).otherwise(ch)

        return F.array_join(F.transform(F.split(text, ""), one), "")

    def step(pair: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(F.when(odd, shifted(pair["l"], i, pair["r"])).otherwise(pair["l"]).alias("l"), F.when(odd, pair["r"]).otherwise(shifted(pair["r"], i, pair["l"])).alias("r"))

    start = F.struct(F.substr(local, F.lit(1), first).alias("l"), F.substr(local, first + 1, F.length(local)).alias("r"))
    pair = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return F.concat(pair["l"], pair["r"], F.lit("@"), domain)


@dataclass(frozen=True)
class Kind:
    """forms: the form at each length it can have. before, after: what must not stand around it. hint: a cheap sign that
    a run may hold one."""

    name: str
    forms: tuple[str, ...]
    before: str
    after: str
    hint: str
    valid: Callable[[Column], Column]
    new: Callable[[Column, str], Column]


def _nanp(v: Column) -> Column:
    ten = F.right(digits_of(v), F.lit(10))
    return (F.substring(ten, 1, 1) >= "2") & (F.substring(ten, 4, 1) >= "2")


_LONE = r"[0-9A-Za-z]"
_SSN_VALID = lambda v: ~F.substring(v, 1, 3).isin("000", "666") & (F.substring(v, 1, 1) < "9") & (F.substring(v, 5, 2) != "00") & (F.substring(v, 8, 4) != "0000")
KINDS = (
    Kind("iban", tuple(IBAN % n + tail for n in range(7, 1, -1) for tail in ("(?: ?[A-Z0-9]{1,3})", "")), _LONE, _LONE, "[A-Z]{2}[0-9]{2}", lambda v: (F.length(F.regexp_replace(v, " ", "")) >= 15) & (_mod97(F.regexp_replace(v, " ", "")) == 1), _iban),
    Kind("date_iso", (DATE_ISO,), "[0-9-]", "[0-9-]", "-", lambda v: _iso_day(v).isNotNull(), lambda v, key: F.date_format(_new_day(_iso_day(v), key), "yyyy-MM-dd")),
    Kind("date_dot", (DATE_DOT,), "[0-9.]", r"[0-9]|\.[0-9]", r"\.", lambda v: _split_day(v, ".", 0).isNotNull(), lambda v, key: _dated(v, ".", 0, key)),
    Kind("date_slash", (DATE_SLASH,), "[0-9/]", "[0-9/]", "/", lambda v: _split_day(v, "/", 1).isNotNull(), lambda v, key: _dated(v, "/", 1, key)),
    Kind("date_slash_day_first", (DATE_SLASH,), "[0-9/]", "[0-9/]", "/", lambda v: _split_day(v, "/", 0).isNotNull(), lambda v, key: _dated(v, "/", 0, key)),
    Kind("ssn", (SSN,), "[0-9-]", "[0-9-]", "-", _SSN_VALID, _ssn),
    Kind("ip", (IPV4,), "[0-9.]", r"[0-9]|\.[0-9]", r"\.", lambda v: F.forall(F.split(v, r"\."), lambda x: x.try_cast("int") <= 255), _ip),
    Kind("phone", (r"\+1[ .-]?" + PHONE, PHONE), r"[0-9A-Za-z+]", "[0-9]", "[0-9]{3}[ .-][0-9]{4}", _nanp, _phone),
    Kind("phone_abroad", tuple(PHONE_ABROAD % (n - 1) for n in range(15, 7, -1)), r"[0-9A-Za-z+]", rf"{_LONE}|(?<=[0-9])\)", r"\+[2-9]", lambda v: F.length(digits_of(v)) >= 8, _abroad),
    Kind("card", tuple(CARD % (n - 1) for n in range(19, 12, -1)), rf"{_LONE}|[0-9]\.", _LONE, "(?:[0-9][ -]?){12}[0-9]", lambda v: (luhn_sum(digits_of(v)) % 10 == 0) & (digits_of(v).rlike("[1-9]")), _card),
)


def candidates(run: Column) -> Column:
    """All values in a run that pass their kind's check, at every start and of every length, as (at, shorter, kind,
    value): by place, the longest first, then in the order of the kinds."""
    def placed(kind: int):
        return lambda v, rest: F.struct((F.length(run) - F.length(rest) - F.length(v)).alias("at"), (-F.length(v)).alias("shorter"), F.lit(kind).alias("kind"), v.alias("value"))

    def passing(k: Kind):
        return lambda c: F.coalesce(k.valid(c["value"]), F.lit(False))

    found = []
    for i, k in enumerate(KINDS):
        each = []
        for form in k.forms:
            around = rf"(?s)(?<!{k.before})(?=({form})(?!{k.after})(.*))"
            each.append(F.zip_with(F.regexp_extract_all(run, F.lit(around), F.lit(1)), F.regexp_extract_all(run, F.lit(around), F.lit(2)), placed(i)))
        found.append(F.when(run.rlike(k.hint), F.filter(F.concat(*each), passing(k))))
    none = F.array().cast("array<struct<at:int,shorter:int,kind:int,value:string>>")
    return F.array_sort(F.concat(*[F.coalesce(x, none) for x in found]))


def replaced(match: Column, key: str) -> Column:
    """A match of the whole pattern -> (v, kinds): its pseudonym and the kinds found in it. In a run the first valid
    value counts, the longest of those that begin there, then the first that begins after its end."""
    start = F.struct(F.lit(0).alias("end"), F.lit("").alias("out"), F.array().cast("array<string>").alias("kinds"))

    def step(acc: Column, c: Column) -> Column:
        new, name = None, None
        for i, k in enumerate(KINDS):
            new = F.when(c["kind"] == i, k.new(c["value"], key)) if new is None else new.when(c["kind"] == i, k.new(c["value"], key))
            name = F.when(c["kind"] == i, k.name) if name is None else name.when(c["kind"] == i, k.name)
        taken = F.struct(
            (c["at"] - c["shorter"]).alias("end"), F.concat(acc["out"], F.substr(match, acc["end"] + 1, c["at"] - acc["end"]), new).alias("out"), F.concat(acc["kinds"], F.array(name)).alias("kinds")
        )
        return F.when(c["at"] >= acc["end"], taken).otherwise(acc)

    def finish(acc: Column) -> Column:
        return F.struct(F.concat(acc["out"], F.substr(match, acc["end"] + 1, F.length(match))).alias("v"), acc["kinds"].alias("kinds"))

    numbers = F.aggregate(candidates(match), start, step, finish)
    return F.when(match.contains("@"), F.struct(_email(match, key).alias("v"), F.array(F.lit("email")).alias("kinds"))).otherwise(numbers)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Adds to docs: n_found, kinds (sorted, comma-joined, distinct) and replaces the text column.

    Every text is read whole. Null texts stay null with n_found 0; empty texts, repeated rows and an empty table need
    no special case. What has the form but fails the check (a 16-digit number that is no card) stays as it is, and what
    lies inside it is tried. Columns of docs that are named n_found or kinds give way to those of the result; any
    other column stays, whatever its name. No row is shuffled: a document's pieces and matches are put together again in
    the row that holds it.
    """
    whole = F.col(text)
    names = [c for c in docs.columns if c.lower() not in ("n_found", "kinds")]
    found_, new_ = unused(docs, "found", "new")
    both = rf"(?:{EMAIL})|(?:{RUN})"
    has_email = whole.contains("@")
    found = F.when(has_email, F.regexp_extract_all(whole, F.lit(both), F.lit(0))).otherwise(F.regexp_extract_all(whole, F.lit(RUN), F.lit(0)))
    rows = docs.select(*names, found.alias(found_))
    rows = rows.withColumn(new_, F.when(F.size(found_) > 0, F.transform(found_, lambda v: replaced(v, key))))
    kinds = F.flatten(F.transform(F.col(new_), lambda x: x["kinds"]))
    n = F.greatest(F.coalesce(F.size(kinds), F.lit(0)), F.lit(0))
    # splitting at the same pattern gives one piece more than there are matches; most texts have no value and stay
    pieces = F.when(has_email, F.split(whole, both)).otherwise(F.split(whole, RUN))
    joined = F.array_join(F.flatten(F.zip_with(pieces, F.col(new_), lambda piece, x: F.array(piece, F.coalesce(x["v"], F.lit(""))))), "")
    out = [F.when(n > 0, joined).otherwise(whole).alias(c) if c == text else F.col(f"`{c}`") for c in names]
    return rows.select(*out, n.cast("long").alias("n_found"), F.coalesce(F.array_join(F.array_sort(F.array_distinct(kinds)), ","), F.lit("")).alias("kinds"))
