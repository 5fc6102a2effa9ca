"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Numbers and dates that pass their format's check are permuted inside that format by a keyed
Feistel network, so equal values get equal pseudonyms in every document and different values stay
different:

- long numbers (13 to 19 digits, card style) whose last digit is their Luhn digit: the body is
  permuted and the Luhn digit follows, so valid numbers stay valid. A number printed as a card
  (four groups of four, first digit 3 to 6) passes by its print alone; where its last digit is
  wrong, it stays as far from the Luhn digit. In a row of digit groups every number is found:
  a group that is valid alone, else the longest valid part from each group on, of groups of three
  digits or more, or the whole row;
- dates (year first, or dotted or slashed with the year last): a permutation of the days of
  1800..2199, a full Gregorian cycle of 146,097 = 189 x 773 days. A slashed date with the year last
  is read month first where it can be; one that cannot (day 13 to 31 first) keeps to its kind: the
  88,497 = 9 x 9833 days after the twelfth of a month are permuted among themselves;
- social security numbers: a permutation of the valid ones (898 x 99 x 9999);
- international bank account numbers whose check digits hold (remainder 1 modulo 97): the digits of
  the account part are permuted, letters stay, and new check digits follow;
- telephone numbers: the ten national digits; with + and a country code, the 7 to 14 digits behind
  it; of five pairs with a leading 0, the four last pairs. IPv4 addresses: the 2**32 addresses, but
  not a version's or section's number;
- e-mail addresses: letters and digits of the local part, each in its own alphabet.

Separators, lengths and country codes stay. A value that fails its check is left as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import unused

ROUNDS = 8
_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_DATE = r"(?<![\p{L}\p{N}])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\p{L}\p{N}]|[-./]\d)"
_IP = r"(?<![\p{L}\p{N}.])(?<!(?:[Vv]ersion|[Vv]er\.?|[Rr]elease|[Bb]uild|[Ss]ection|[Cc]hapter|§)[ :]{0,2})(?:\d{1,3}\.){3}\d{1,3}(?![\p{L}\p{N}]|\.\d)"
_SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)"
_PHONE = r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\p{L}\p{N}])"
_IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![\p{L}\p{N}])"
# Country codes of one digit, and of two; all others have three.
_CODE = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_WORLD = rf"(?<![\p{{L}}\p{{N}}+])\+(?=(?:[ .()-]{{0,2}}\d){{8,15}}(?![\p{{L}}\p{{N}}]|[ .()-]\d)){_CODE}(?:[ .-]?\(?\d{{1,8}}\)?){{1,7}}(?![\p{{L}}\p{{N}}]|[ .-]\d)"
_PAIRS = r"(?<![\p{L}\p{N}+]|\d[ .-])0[1-9](?:(?: \d{2}){4}|(?:\.\d{2}){4}|(?:-\d{2}){4})(?![\p{L}\p{N}]|[ .-]\d)"
_OTHER = "|".join([_EMAIL, _DATE, _IP, _SSN, _IBAN, _WORLD, _PHONE, _PAIRS])
# a whole row of digit groups, up to the next value of another format
_NUMBER = rf"(?<![\p{{L}}\p{{N}}])(?=\d(?:[ -]?\d){{12}})\d++(?![\p{{L}}\p{{N}}])(?:[ -](?!{_OTHER})\d++(?![\p{{L}}\p{{N}}]))*+"
_PRINTED = r"^[3-6]\d{3}([ -])\d{4}\1\d{4}\1\d{4}$"
PATTERN = f"{_OTHER}|{_NUMBER}"
_FIRST_DAY, _DAYS, _LATE = "1800-01-01", (189, 773), (9, 9833)


def _round_number(key: str, kind: str, i: Column, value: Column) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{key}|{kind}|"), i.cast("string"), F.lit("|"), value.cast("string"), F.lit(f"|{key}")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: str, left: Column, right: Column, left_radix: Column, right_radix: Column) -> Column:
    """Struct (l, r): a keyed permutation of the pairs left < left_radix, right < right_radix."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"), left_radix.cast("long").alias("a"), right_radix.cast("long").alias("b"))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        start,
        lambda s, i: F.struct(s.r.alias("l"), F.pmod(s.l + F.pmod(_round_number(key, kind, i, s.r), s.a), s.a).alias("r"), s.b.alias("a"), s.a.alias("b")),
    )


def _once(value: Column, use) -> Column:  # noqa: ANN001
    """Name an expression inside a lambda so that it is evaluated once."""
    return F.transform(F.array(value), use)[0]


def permute_digits(key: str, kind: str, digits: Column) -> Column:
    """A keyed permutation of the digit strings of one length (2 to 30)."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    ten = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    part = lambda frm, size: F.substring(digits, frm, size).cast("long")
    return _once(
        feistel(key, kind, part(F.lit(1), half), part(half + 1, n - half), ten(half), ten(n - half)),
        lambda s: F.concat(F.lpad(s.l.cast("string"), half, "0"), F.lpad(s.r.cast("string"), n - half, "0")),
    )


def luhn_digit(body: Column) -> Column:
    """The check digit that follows a digit string."""
    digits = F.filter(F.split(F.reverse(body), ""), lambda c: c != "")
    value = lambda c, i: F.when(i % 2 == 0, 2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))
    return F.pmod(-F.aggregate(F.transform(digits, value), F.lit(0), lambda a, x: a + x), F.lit(10))


def _refill(shape: Column, digits: Column) -> Column:
    """Put digits into the places of shape's digits."""
    return F.array_join(F.zip_with(F.split(shape, "[0-9]", -1), F.filter(F.split(digits, ""), lambda c: c != ""), lambda s, d: F.concat(s, F.coalesce(d, F.lit("")))), "")


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _number(key: str, m: Column) -> Column:
    """Struct (text, n): a row of digit groups with its n valid numbers renewed."""

    def renewed(shape: Column) -> Column:
        def new(digits: Column) -> Column:
            body, n = F.substring(digits, F.lit(1), F.length(digits) - 1), F.length(digits)
            offset = F.substring(digits, n, F.lit(1)).cast("int") - luhn_digit(body)
            return _once(permute_digits(key, "number", body), lambda b: _refill(shape, F.concat(b, F.pmod(luhn_digit(b) + offset, F.lit(10)).cast("string"))))

        return _once(_only_digits(shape), new)

    def row(groups: Column) -> Column:
        size, joined = F.size(groups), lambda first, n: F.array_join(F.slice(groups, first + 1, n), "")

        def valid(first: Column, n: Column) -> Column:
            def passes(digits: Column) -> Column:
                long = F.length(digits)
                whole = (n == size) | F.forall(F.slice(groups, first + 1, n), lambda g: g.rlike(r"^\d{3}"))
                luhn = F.substring(digits, long, F.lit(1)).cast("int") == luhn_digit(F.substring(digits, F.lit(1), long - 1))
                return long.between(13, 19) & whole & (luhn | ((n == size) & m.rlike(_PRINTED)))

            return _once(_only_digits(joined(first, n)), passes)

        def step(state: Column, first: Column) -> Column:
            longest = F.coalesce(F.when(valid(first, F.lit(1)), 1), F.array_max(F.filter(F.sequence(F.lit(1), F.least(F.lit(19), size - first)), lambda n: valid(first, n))))
            more = _once(longest, lambda n: F.when(n.isNotNull(), F.struct((first + n).alias("end"), F.concat(state.found, F.array(F.struct(first.alias("first"), n.alias("n")))).alias("found"))))
            return F.when(first >= state.end, F.coalesce(more, state)).otherwise(state)

        start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<first: int, n: int>>").alias("found"))

        def text(found: Column) -> Column:
            end = lambda k: F.coalesce(F.try_element_at(found, k).first + F.try_element_at(found, k).n, F.lit(0))
            parts = F.transform(found, lambda x, k: _once(F.when(k > 0, end(F.greatest(k, F.lit(1)))).otherwise(0), lambda e: F.concat(joined(e, x.first - e), renewed(joined(x.first, x.n)))))
            rest = _once(end(F.lit(-1)), lambda e: joined(e, size - e))
            return F.when(F.size(found) > 0, F.struct(F.concat(F.array_join(parts, ""), rest).alias("text"), F.size(found).alias("n")))

        return _once(F.aggregate(F.sequence(F.lit(0), size - 1), start, step).found, text)

    return _once(F.regexp_extract_all(m, F.lit("[0-9]+[ -]?"), F.lit(0)), row)


def _ip(key: str, m: Column) -> Column:
    def renewed(o: Column) -> Column:
        out = _once(feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536)), lambda s: F.concat_ws(".", F.floor(s.l / 256).cast("string"), (s.l % 256).cast("string"), F.floor(s.r / 256).cast("string"), (s.r % 256).cast("string")))
        return F.when(F.forall(o, lambda x: x < 256), out)

    return _once(F.transform(F.split(m, "\\."), lambda x: x.cast("int")), renewed)


def _ssn(key: str, m: Column) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    rank = F.when(area > 666, area - 2).otherwise(area - 1)
    out = _once(
        feistel(key, "ssn", rank, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999)),
        lambda s: F.format_string("%03d-%02d-%04d", F.when(s.l >= 665, s.l + 2).otherwise(s.l + 1), F.floor(s.r / 9999).cast("long") + 1, s.r % 9999 + 1),
    )
    return F.when(valid, out)


def _phone(key: str, m: Column) -> Column:
    head = F.regexp_extract(m, r"^(\+\d{1,3}[ .-]?)?", 0)
    return _once(F.substring(m, F.length(head) + 1, F.length(m)), lambda rest: F.concat(head, _refill(rest, permute_digits(key, "phone", _only_digits(rest)))))


def _world_phone(key: str, m: Column) -> Column:
    head = F.regexp_extract(m, rf"^\+{_CODE}", 0)
    return _once(F.substring(m, F.length(head) + 1, F.length(m)), lambda rest: F.concat(head, _refill(rest, permute_digits(key, "phone", _only_digits(rest)))))


def _pair_phone(key: str, m: Column) -> Column:
    return _once(F.substring(m, F.lit(3), F.length(m)), lambda rest: F.concat(F.substring(m, 1, 2), _refill(rest, permute_digits(key, "phone", _only_digits(rest)))))


def mod97(text: Column) -> Column:
    """Remainder modulo 97 of digits and letters, letters as 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    characters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(characters, F.lit(0), lambda a, c: _once(value(c), lambda v: F.pmod(a * F.when(v > 9, 100).otherwise(10) + v, F.lit(97))))


def _iban(key: str, m: Column) -> Column:
    def renewed(plain: Column) -> Column:
        country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
        digits = _only_digits(account)
        checked = (mod97(F.concat(account, F.substring(plain, 1, 4))) == 1) & F.length(plain).between(15, 34) & F.length(digits).between(2, 30)

        def new(body: Column) -> Column:
            check = _once(mod97(F.concat(body, country, F.lit("00"))), lambda r: F.lpad((98 - r).cast("string"), 2, "0"))
            return F.concat(country, check, body)

        def spaced(out: Column) -> Column:
            return F.when(m.contains(" "), F.array_join(F.filter(F.regexp_extract_all(out, F.lit(".{1,4}"), F.lit(0)), lambda g: g != ""), " ")).otherwise(out)

        return F.when(checked, _once(_once(_refill(account, permute_digits(key, "iban", digits)), new), spaced))

    return _once(F.regexp_replace(m, " ", ""), renewed)


def _late_day(rank: Column) -> Column:
    """The date of a rank among the days 13 and later of each month since the first day."""
    first = F.lit(_FIRST_DAY).cast("date")
    start = lambda month: F.datediff(F.add_months(first, month), first) - 12 * month  # noqa: E731  ranks before a month
    near = F.floor(rank / (_LATE[0] * _LATE[1] / 4800)).cast("int")
    month = F.array_max(F.filter(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda k: F.greatest(near + k, F.lit(0))), lambda month: start(month) <= rank))
    return _once(month, lambda month: F.date_add(F.add_months(first, month), (rank - start(month) + 12).cast("int")))


def _date(key: str, m: Column) -> Column:
    def day_first(write) -> Column:  # noqa: ANN001
        """A slashed date that cannot be read month first, permuted among those."""
        fields = F.split(m, "/")
        day = F.try_to_date(F.concat_ws("-", fields[2], fields[1], fields[0]), "yyyy-MM-dd")

        def new(day: Column) -> Column:
            first = F.lit(_FIRST_DAY).cast("date")
            past = F.datediff(day, first)
            month = 12 * (F.year(day) - F.year(first)) + F.month(day) - 1
            rank = past - 12 * (month + 1)
            s = feistel(key, "late-date", F.floor(rank / _LATE[1]), rank % _LATE[1], F.lit(_LATE[0]), F.lit(_LATE[1]))
            return F.when(past.between(0, _DAYS[0] * _DAYS[1] - 1), _once(_once(s, lambda x: _once((x.l * _LATE[1] + x.r).cast("int"), _late_day)), write))

        return F.when((fields[0].cast("int") > 12) & day.isNotNull(), _once(day, new))

    def permuted(day: Column, write) -> Column:  # noqa: ANN001
        past = F.datediff(day, F.lit(_FIRST_DAY).cast("date"))
        s = feistel(key, "date", F.floor(past / _DAYS[1]), past % _DAYS[1], F.lit(_DAYS[0]), F.lit(_DAYS[1]))
        new = _once(s, lambda x: F.date_add(F.lit(_FIRST_DAY).cast("date"), (x.l * _DAYS[1] + x.r).cast("int")))
        return F.when(past.between(0, _DAYS[0] * _DAYS[1] - 1), _once(new, write))

    def by(order: tuple[int, int, int], sep: str) -> Column:
        fields = F.split(m, "[-/.]")
        y, mo, d = (fields[i] for i in order)
        names = [""] * 3
        for place, pattern in zip(order, ("yyyy", "MM", "dd"), strict=True):
            names[place] = pattern
        return permuted(F.try_to_date(F.concat_ws("-", y, mo, d), "yyyy-MM-dd"), lambda x: F.date_format(x, sep.join(names)))

    return (
        F.when(m.rlike(r"^\d{4}-"), by((0, 1, 2), "-"))
        .when(m.rlike(r"^\d{4}/"), by((0, 1, 2), "/"))
        .when(m.contains("."), by((2, 1, 0), "."))
        .otherwise(F.coalesce(by((2, 0, 1), "/"), day_first(lambda x: F.date_format(x, "dd/MM/yyyy"))))
    )


def _email(key: str, m: Column) -> Column:
    """Feistel over the local part: each half's letters and digits are shifted by a digest of the other half."""
    local, domain = F.substring_index(m, "@", 1), F.substring(m, F.instr(m, "@"), F.length(m))

    def shifted(text: Column, digest: Column) -> Column:
        def turn(c: Column, i: Column) -> Column:
            by = F.conv(F.substring(digest, 1 + (i % 16) * 4, F.lit(4)), 16, 10).cast("int")
            code = F.ascii(c)
            move = lambda first, size: F.char(F.lit(first) + F.pmod(code - first + by, F.lit(size)))
            return F.when(c.rlike("^[a-z]$"), move(97, 26)).when(c.rlike("^[A-Z]$"), move(65, 26)).when(c.rlike("^[0-9]$"), move(48, 10)).otherwise(c)

        return F.array_join(F.transform(F.split(text, ""), turn), "")

    half = F.floor(F.length(local) / 2).cast("int")
    start = F.struct(F.substring(local, F.lit(1), half).alias("l"), F.substring(local, half + 1, F.length(local)).alias("r"))
    mixed = F.aggregate(
        F.sequence(F.lit(0), F.lit(3)),
        start,
        lambda s, i: F.struct(s.r.alias("l"), shifted(s.l, F.sha2(F.concat(F.lit(f"{key}|email|"), i.cast("string"), F.lit("|"), s.r, F.lit(f"|{key}")), 256)).alias("r")),
    )
    return _once(mixed, lambda s: F.concat(s.l, s.r, domain))


def pseudonym(key: str, m: Column) -> Column:
    """Struct (text, n): one found value's pseudonym and the values in it, or itself and 0 where it fails its check."""
    new = (
        F.when(m.contains("@"), _email(key, m))
        .when(m.rlike(rf"^(?:{_DATE})$"), _date(key, m))
        .when(m.rlike(rf"^(?:{_IP})$"), _ip(key, m))
        .when(m.rlike(rf"^(?:{_SSN})$"), _ssn(key, m))
        .when(m.rlike(rf"^(?:{_IBAN})$"), _iban(key, m))
        .when(m.rlike(rf"^(?:{_PHONE})$"), _phone(key, m))
        .when(m.rlike(rf"^(?:{_WORLD})$"), _world_phone(key, m))
        .when(m.rlike(rf"^(?:{_PAIRS})$"), _pair_phone(key, m))
    )
    one = _once(F.coalesce(new, m), lambda x: F.struct(x.alias("text"), (x != m).cast("int").alias("n")))
    return F.when(m.rlike(r"^[0-9 -]+$") & ~m.rlike(rf"^(?:{_OTHER})$"), F.coalesce(_number(key, m), F.struct(m.alias("text"), F.lit(0).alias("n")))).otherwise(one)


def pseudonymise(docs: DataFrame, *, key: str, text: str = "text") -> DataFrame:
    """Replace personal values in the text column and add n_private, the number of values replaced.

    One pass over each row without a shuffle, so repeated rows and ties have no bearing on it. A null
    text stays null with n_private 0; other columns pass through, a column named n_private is replaced.
    """
    if not key:
        raise ValueError("a secret key is needed")
    rows = docs.drop("n_private") if text != "n_private" else docs
    found, new = unused("_found", rows.columns), unused("_new", rows.columns)
    may = F.col(text).rlike("[0-9@]") & F.col(text).rlike(PATTERN)
    named = rows.withColumn(found, F.when(may, F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0)))).withColumn(new, F.transform(found, lambda m: pseudonym(key, m)))
    joined = F.array_join(F.zip_with(F.split(F.col(text), PATTERN, -1), F.col(new), lambda a, b: F.concat(a, F.coalesce(b.text, F.lit("")))), "")
    changed = F.aggregate(new, F.lit(0), lambda total, x: total + x.n)
    out = {"n_private": F.when(F.col(found).isNull(), 0).otherwise(changed).cast("long"), text: F.when(F.col(found).isNull(), F.col(text)).otherwise(joined)}
    return named.withColumns(out).select(*rows.columns, "n_private")
