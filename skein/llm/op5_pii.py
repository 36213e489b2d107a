"""Format-preserving pseudonyms for personal numbers and dates, by keyed Feistel permutations.

What is found, and what makes it valid:

* payment card numbers: 13 to 19 digits, alone or in blocks parted by blanks or hyphens, with a right
  Luhn digit. The digits before it are permuted, the Luhn digit is computed anew: still a valid card.
  In a longer run of blocks every sequence of whole blocks is tried: first those written like cards
  (one block, 4-4-4-4, 4-6-5, 4-6-4), then the longest, and again beside them. Part of a block is no card.
* telephone numbers: ``+C (AAA) BBB-DDDD`` and the like, ``(AAA) BBB-DDDD``, ``AAA-BBB-DDDD`` and
  ``AAA.BBB.DDDD``, also after ``1``; the ten digits are permuted, country code and marks stay.
* social security numbers ``AAA-BB-CCCC`` with area, group and serial in their ranges.
* IPv4 addresses with octets up to 255: the 32 bits are permuted.
* e-mail addresses: letters of the local part are permuted as letters, digits as digits; its other
  characters and the domain stay.
* dates ``YYYY-MM-DD`` (also with / or .), ``DD.MM.YYYY`` and ``MM/DD/YYYY`` of a real day in the years 1900 to
  2099: the day's number is permuted within these 73,049 days, in the same format.

A Feistel network over two parts of a value adds to one part, in turn, a keyed digest of the other.
Every step can be undone with the key, so values of one kind and format are permuted one to one:
equal values get equal pseudonyms in all documents, different values different ones, and the holder
of the key can reverse them (``reverse=True``). Values that aren't valid stay as they are.

Everything is a column expression: the text is split at the matches, the matches are transformed,
and both are joined again. Null text stays null, empty text empty; texts are read whole; the other
columns, whatever their names, are passed on as they are.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: session setting of the key (its name keeps it out of Spark's logs of settings)
SECRET = "spark.skein.pii.secret"

#: one pattern for everything that may be personal; which kind a match is, is decided per match
PHONE = r"\+\d{1,3}[ -]?\(?\d{3}\)?[ -]?\d{3}[ -]\d{4}(?!\d)"
SSN = r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
#: a match can only begin at a run's start and has RFC lengths, so long runs without an @ cost one look each
EMAIL = (r"(?<![\p{L}\d._%+-])[\p{L}\d](?:[\p{L}\d._%+-]{0,62}[\p{L}\d_%+-])?@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
         r"(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?){1,8}")
_MM, _DD = r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
DATE = (rf"(?<![\d./-])(?:(?:19|20)\d{{2}}(?:-{_MM}-|/{_MM}/|\.{_MM}\.){_DD}|{_DD}\.{_MM}\.(?:19|20)\d{{2}}|{_MM}/{_DD}/(?:19|20)\d{{2}})"
        r"(?![\d/-]|\.\d)")
LOCAL_PHONE = r"(?<![\d.+-])(?:1[ -])?(?:\(\d{3}\)[ -]?\d{3}[ .-]|\d{3}-\d{3}-|\d{3}\.\d{3}\.)\d{4}(?![\d-]|\.\d)"
#: a run of digit blocks that ends before any other kind, a decimal or a name with @; its tail bars the last block
_OTHER = "|".join(p.replace(r"(?<![\d.+-])", "").replace(r"(?<![\d-])", "").replace(r"(?<![\d./-])", "") for p in (SSN, DATE, LOCAL_PHONE))
CARD = rf"(?<![\d.+-])\d(?:(?:[ -](?!{_OTHER}|\d++\.\d|\d[\p{{L}}\d._%+-]{{0,63}}@))?\d){{12,}}+(?:-|\.\d)?"
_ANY = "|".join([EMAIL, PHONE, SSN, IPV4, DATE, LOCAL_PHONE, CARD])
_FIRST_DAY, _DAYS, _ROWS = "1900-01-01", 73049, 17  # 73,049 days = 17 x 4,297


def _digest(key: str, tag: str, turn: int, half: Column) -> Column:
    """A keyed number of 60 bits for the other half."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}|{tag}|{turn}|"), half.cast("string")).cast("binary"), 256), 1, 15), 16, 10).cast("bigint")


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), lambda x: then(x)), 1)


def feistel(a: Column, b: Column, a_size: Column, b_size: Column, key: str, tag: str, reverse: bool, join) -> Column:
    """Permute the pairs (a, b) with 0 <= a < a_size, 0 <= b < b_size; ``join(a, b)`` makes the result.

    Rounds add to a and b in turn; both keep their ranges, whatever these are.
    """
    state = F.array(F.struct(a.alias("a"), b.alias("b"), a_size.alias("m"), b_size.alias("n")))
    sign = -1 if reverse else 1

    def step(turn):
        def left(x):
            new = F.pmod(x["a"] + F.lit(sign) * F.pmod(_digest(key, tag, turn, x["b"]), x["m"]), x["m"])
            return F.struct(new.alias("a"), x["b"].alias("b"), x["m"].alias("m"), x["n"].alias("n"))

        def right(x):
            new = F.pmod(x["b"] + F.lit(sign) * F.pmod(_digest(key, tag, turn, x["a"]), x["n"]), x["n"])
            return F.struct(x["a"].alias("a"), new.alias("b"), x["m"].alias("m"), x["n"].alias("n"))

        return left if turn % 2 == 0 else right

    for turn in (reversed(range(ROUNDS)) if reverse else range(ROUNDS)):
        state = F.transform(state, step(turn))
    return F.element_at(F.transform(state, lambda x: join(x["a"], x["b"])), 1)


def permute_digits(digits: Column, key: str, tag: str, reverse: bool = False) -> Column:
    """Another digit string of the same length (up to 36 digits). Values of each length are permuted by themselves."""
    return let(digits, lambda d: _permute_digits(d, key, tag, reverse))


def _permute_digits(digits: Column, key: str, tag: str, reverse: bool) -> Column:
    n = F.length(digits)
    left = (n / 2).cast("int")
    a = F.coalesce(F.substring(digits, F.lit(1), left).try_cast("bigint"), F.lit(0).cast("bigint"))
    b = F.coalesce(F.substring(digits, left + 1, n - left).try_cast("bigint"), F.lit(0).cast("bigint"))

    def power(k):
        return F.concat(F.lit("1"), F.repeat(F.lit("0"), k)).cast("bigint")

    def join(x, y):
        return F.concat(F.when(left > 0, F.lpad(x.cast("string"), left, "0")).otherwise(F.lit("")), F.lpad(y.cast("string"), n - left, "0"))

    return feistel(a, b, power(left), power(n - left), key, tag, reverse, join)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def refill(pattern: Column, digits: Column) -> Column:
    """``pattern`` with its digits replaced, one by one, by ``digits``."""
    def place(new):
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(pattern)), lambda i: F.when(
            F.substring(pattern, i, F.lit(1)).rlike("[0-9]"),
            F.substring(new, F.length(digits_of(F.substring(pattern, F.lit(1), i))), F.lit(1))).otherwise(F.substring(pattern, i, F.lit(1)))), "")

    return let(digits, place)


def luhn_digit(payload: Column) -> Column:
    """The digit that makes payload + digit pass the Luhn check."""
    n = F.length(payload)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + _luhn_part(F.substring(payload, i, F.lit(1)).cast("int"), (n - i) % 2 == 0))
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _luhn_part(d: Column, double: Column) -> Column:
    return F.when(double, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)


def _card(x: Column, key: str, reverse: bool) -> Column:
    """All cards in a run of digit blocks; blocks of no card stay."""
    tail = F.regexp_extract(x, r"(-|\.\d)$", 1)
    core = F.substring(x, F.lit(1), F.length(x) - F.length(tail))
    return let(F.struct(core.alias("core"), tail.alias("tail"), F.split(core, "[ -]").alias("blocks"), digits_of(core).alias("digits")),
               lambda r: F.concat(_cards(r, key, reverse), r["tail"]))


def _cards(r: Column, key: str, reverse: bool) -> Column:
    digits, n = r["digits"], F.size(r["blocks"])
    # where each block begins, and where the last ends
    ends = F.aggregate(r["blocks"], F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(b))))

    def of(start, size):
        return F.substring(digits, start + 1, size)

    def whole(at):
        def ending(i):
            # the sequences of 1 to 19 blocks from block i on, as (order, start, size)
            def one(e, k):
                start = F.element_at(at, i)
                size = e - start
                widths = F.array_join(F.transform(F.slice(r["blocks"], i, k + 1), lambda b: F.length(b).cast("string")), "-")
                shaped = (k == 0) | widths.isin("4-4-4-4", "4-6-5", "4-6-4")
                return F.struct(F.when(shaped, 0).otherwise(1).alias("order"), (-size).alias("less"), start.alias("start"), size.alias("size"),
                                (i + k == n).alias("last"))

            return F.filter(F.transform(F.slice(at, i + 1, F.lit(19)), one), lambda c: c["size"].between(13, 19) & ~(c["last"] & (r["tail"] != "")))

        found = F.flatten(F.transform(F.sequence(F.lit(1), n), ending))
        return F.filter(found, lambda c: luhn_digit(of(c["start"], c["size"] - 1)) == of(c["start"] + c["size"] - 1, F.lit(1)))

    def apart(chosen, c):
        clash = F.exists(chosen, lambda o: (o["start"] < c["start"] + c["size"]) & (c["start"] < o["start"] + o["size"]))
        return F.when(clash, chosen).otherwise(F.concat(chosen, F.array(F.struct(c["start"].alias("start"), c["size"].alias("size")))))

    def replaced(chosen):
        def put(acc, c):
            payload = of(c["start"], c["size"] - 1)
            new = let(permute_digits(payload, key, "card", reverse), lambda v: F.concat(v, luhn_digit(v)))
            return F.struct((c["start"] + c["size"]).alias("at"), F.concat(acc["out"], of(acc["at"], c["start"] - acc["at"]), new).alias("out"))

        return F.aggregate(F.array_sort(chosen), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put,
                           lambda acc: F.concat(acc["out"], of(acc["at"], F.length(digits))))

    def marked(new):
        """The new digits in the old blocks, with the old marks."""
        return let(ends, lambda at: F.array_join(F.zip_with(
            F.transform(r["blocks"], lambda b, k: F.substring(new, F.get(at, k) + 1, F.length(b))),
            F.regexp_extract_all(r["core"], F.lit("[ -]"), F.lit(0)), lambda b, mark: F.concat(b, F.coalesce(mark, F.lit("")))), ""))

    none = F.array().cast("array<struct<start:int,size:int>>")
    valid = let(ends, whole)
    chosen = F.aggregate(F.array_sort(valid), none, apart)
    return let(chosen, lambda c: F.when(F.size(c) > 0, let(replaced(c), marked)).otherwise(r["core"]))


def _phone(x: Column, key: str, reverse: bool) -> Column:
    digits = digits_of(x)
    code = F.substring(digits, F.lit(1), F.length(digits) - 10)
    number = F.substring(digits, F.length(digits) - 9, F.lit(10))
    return refill(x, F.concat(code, permute_digits(number, key, "phone", reverse)))


def _ssn(x: Column, key: str, reverse: bool) -> Column:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999: permuted within these ranges."""
    area, group, serial = (F.substring(x, a, n).cast("bigint") for a, n in ((1, 3), (5, 2), (8, 4)))
    ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    a = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1
    b = serial - 1

    def join(p, q):
        area = F.floor(p / 99) + 1
        return F.concat(F.lpad((area + F.when(area >= 666, 1).otherwise(0)).cast("string"), 3, "0"), F.lit("-"),
                        F.lpad((F.pmod(p, F.lit(99)) + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((q + 1).cast("string"), 4, "0"))

    return F.when(ok, feistel(a, b, F.lit(898 * 99).cast("bigint"), F.lit(9999).cast("bigint"), key, "ssn", reverse, join)).otherwise(x)


def _ipv4(x: Column, key: str, reverse: bool) -> Column:
    octet = [F.substring_index(F.substring_index(x, ".", k + 1), ".", -1).cast("bigint") for k in range(4)]
    ok = (octet[0] <= 255) & (octet[1] <= 255) & (octet[2] <= 255) & (octet[3] <= 255)

    def join(p, q):
        return F.concat_ws(".", *((F.floor(v / 256)).cast("string") if k == 0 else F.pmod(v, F.lit(256)).cast("string") for v in (p, q) for k in (0, 1)))

    size = F.lit(65536).cast("bigint")
    return F.when(ok, feistel(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], size, size, key, "ipv4", reverse, join)).otherwise(x)


def _date(x: Column, key: str, reverse: bool) -> Column:
    shape = F.when(x.rlike(r"^\d{4}"), 0).when(x.contains("/"), 2).otherwise(1)
    parts = {0: ((1, 4), (6, 2), (9, 2)), 1: ((7, 4), (4, 2), (1, 2)), 2: ((7, 4), (1, 2), (4, 2))}

    def iso(k):
        return F.concat_ws("-", *(F.substring(x, a, n) for a, n in parts[k]))

    day = F.when(shape == 0, iso(0)).when(shape == 1, iso(1)).otherwise(iso(2)).try_cast("date")
    index = F.datediff(day, F.lit(_FIRST_DAY).cast("date")).cast("bigint")

    def join(p, q):
        new = F.date_add(F.lit(_FIRST_DAY).cast("date"), (p * (_DAYS // _ROWS) + q).cast("int"))
        mark = F.substring(x, 5, 1)
        return F.when(shape == 0, F.concat(F.date_format(new, "yyyy"), mark, F.date_format(new, "MM"), mark, F.date_format(new, "dd"))) \
            .when(shape == 1, F.date_format(new, "dd.MM.yyyy")).otherwise(F.date_format(new, "MM/dd/yyyy"))

    width = _DAYS // _ROWS
    ok = day.isNotNull() & index.between(0, _DAYS - 1)
    new = feistel(F.floor(index / width), F.pmod(index, F.lit(width)), F.lit(_ROWS).cast("bigint"), F.lit(width).cast("bigint"), key, "date", reverse, join)
    return F.when(ok, new).otherwise(x)


def _shifted(part: Column, other: Column, key: str, turn: int, sign: int) -> Column:
    """Each letter or digit of ``part`` moved within its alphabet by a keyed digest of ``other``."""
    long = F.concat(*(F.sha2(F.concat(F.lit(f"{key}|mail|{turn}|{k}|"), other).cast("binary"), 512) for k in (0, 1)))
    return let(long, lambda digest: _moved(part, digest, sign))


def _moved(part: Column, digest: Column, sign: int) -> Column:
    def move(c, i):
        by = F.conv(F.substring(digest, F.pmod(i, F.lit(64)) * 4 + 1, F.lit(4)), 16, 10).cast("int") * sign

        def within(first, n):
            return F.chr((F.lit(ord(first)) + F.pmod(F.ascii(c) - ord(first) + by, F.lit(n))).cast("bigint"))

        return F.when(c.rlike("[a-z]"), within("a", 26)).when(c.rlike("[A-Z]"), within("A", 26)).when(c.rlike("[0-9]"), within("0", 10)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(part, ""), lambda c: c != ""), move), "")


def _email(x: Column, key: str, reverse: bool) -> Column:
    local, domain = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)
    half = F.greatest(F.lit(1), (F.length(local) / 2).cast("int"))
    state = F.array(F.struct(F.substring(local, F.lit(1), half).alias("a"), F.substring(local, half + 1, F.length(local)).alias("b")))
    sign = -1 if reverse else 1

    def step(turn):
        if turn % 2 == 0:
            return lambda s: F.struct(_shifted(s["a"], s["b"], key, turn, sign).alias("a"), s["b"].alias("b"))
        return lambda s: F.struct(s["a"].alias("a"), _shifted(s["b"], s["a"], key, turn, sign).alias("b"))

    for turn in (reversed(range(4)) if reverse else range(4)):
        state = F.transform(state, step(turn))
    return F.element_at(F.transform(state, lambda s: F.concat(s["a"], s["b"], F.lit("@"), domain)), 1)


def _kind(x: Column) -> Column:
    def only(p):
        return x.rlike("^(?:" + p.replace(r"(?<![\d.+-])", "").replace(r"(?<![\d-])", "").replace(r"(?<![\d.])", "").replace(r"(?<![\d./-])", "") + ")$")

    return F.when(x.contains("@"), "email").when(x.startswith("+") | only(LOCAL_PHONE), "phone").when(only(SSN), "ssn").when(only(IPV4), "ipv4") \
        .when(only(DATE), "date").otherwise("card")


def pseudonym(x: Column, key: str, reverse: bool = False) -> Column:
    """The pseudonym of one match."""
    kind = _kind(x)
    return F.when(kind == "email", _email(x, key, reverse)).when(kind == "phone", _phone(x, key, reverse)).when(kind == "ssn", _ssn(x, key, reverse)) \
        .when(kind == "ipv4", _ipv4(x, key, reverse)).when(kind == "date", _date(x, key, reverse)).otherwise(_card(x, key, reverse))


def matches(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))


def secret_key(spark) -> str:
    """The key named by the session setting SECRET; where it is unset a random one, kept in the session.

    Whoever has the key can reverse the pseudonyms, so there is none in the code. Documents keep their
    links across runs only under the same key: set it for data that is pseudonymised in several runs.
    """
    key = spark.conf.get(SECRET, None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(SECRET, key)
    return key


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", reverse: bool = False, count_col: str | None = None) -> DataFrame:
    """``docs`` with all personal values in ``text_col`` replaced under ``key``; ``count_col`` gets the number of
    replaced matches."""
    if not key:
        raise ValueError("pseudonyms need a key")
    held = "found"
    while held in docs.columns:
        held += "_"
    text = F.col(f"`{text_col}`")
    # most texts have nothing that could match: they are passed on as they are
    may = text.rlike(r"@|\d[\d ./()-]{5}")
    found = F.when(may, F.transform(matches(text), lambda x: F.struct(x.alias("old"), pseudonym(x, key, reverse).alias("new"))))
    step = docs.withColumn(held, found)
    pieces = F.zip_with(F.split(text, _ANY, -1), held, lambda a, b: F.concat(a, F.coalesce(b["new"], F.lit(""))))
    new = F.when(F.size(held) > 0, F.array_join(pieces, "")).otherwise(text)
    columns = [new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if count_col:
        columns.append(F.coalesce(F.size(F.filter(held, lambda x: x["old"] != x["new"])), F.lit(0)).alias(count_col))
    return step.select(*columns)
