"""Format-preserving pseudonyms of personal data by a keyed Feistel network, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import table, unused

ROUNDS = 8

#: What is looked for, in this order where two could start at one place. The kinds are told apart again by KIND. An address has labels of 63 signs
#: and 127 labels at most, as names of hosts have; what follows in a longer row of labels is not a part of it. Every repeat is bounded or
#: possessive, so no text makes the matcher recurse.
LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?![A-Za-z0-9])"
EMAIL = rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}@{LABEL}(?:\.{LABEL}){{1,126}}"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DAY = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Ten digits in the form of North America, whatever the first ones are; then numbers with a + and a country code, 8 to 15 digits
#: in one piece or in groups. A group that starts a find of another kind is not part of a number that has 8 digits already.
LOCAL = r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
OTHER = r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])|" + LOCAL + r"|[A-Za-z0-9._%+-]{1,64}@)"
FOUR = r"(?:[0-9]{13,19}(?![0-9])|[0-9]{4}(?:[ -][0-9]{4}){3}(?![ -]?[0-9]))"
ONE = r"[ .-]?\(?[0-9]\)?"
PHONE = rf"(?<![0-9+])(?:(?:\+1[ .-]?)?{LOCAL}|\+1[ .-]?[0-9]{{10}}(?![0-9])|\+[1-9][0-9]{{7,14}}(?![0-9])|\+[1-9](?:{ONE}){{7}}(?:(?![ .-](?:{OTHER}|{FOUR})){ONE}){{0,7}}(?![0-9])(?<![ .-][0-9]))"
#: A run of 13 digits or more with single blanks or hyphens, to its end or to where a find of another kind starts. The cards in it: cards_in().
CARD = rf"(?<![0-9])[0-9](?:[ -]?[0-9]){{12}}(?:(?![ -]{OTHER})[ -]?[0-9])*+(?![0-9])"
ANY = "|".join((EMAIL, ADDRESS, DAY, SOCIAL, PHONE, CARD))
KINDS = {"email": f"^(?:{EMAIL})$", "ip": f"^(?:{ADDRESS})$", "date": f"^(?:{DAY})$", "ssn": f"^(?:{SOCIAL})$", "phone": f"^(?:{PHONE})$", "card": f"^(?:{CARD})$"}


def _noise(key: str, tag: str, i: Column, x: Column) -> Column:
    """52 keyed bits of a round and a half."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), i.cast("string"), x.cast("string")), 256), 1, 13), 16, 10).cast("long")


def permute(key: str, tag: str, left: Column, right: Column, a: int | Column, b: int | Column) -> Column:
    """A keyed permutation of pairs (left, right) with left below a and right below b, as a struct of both.

    Each round adds a keyed hash of one half to the other half, modulo its range, so it can be undone and no two
    pairs meet. Equal pairs of one tag have equal pseudonyms everywhere.
    """
    a, b = (x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(acc: Column, i: Column) -> Column:
        l = F.pmod(acc["l"] + _noise(key, tag, i, acc["r"]), a)  # noqa: E741
        return F.struct(F.when(i % 2 == 0, l).otherwise(acc["l"]).alias("l"), F.when(i % 2 == 1, F.pmod(acc["r"] + _noise(key, tag, i, acc["l"]), b)).otherwise(acc["r"]).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _number(x: Column, start: int | Column, length: int | Column) -> Column:
    return F.substr(x, start if isinstance(start, Column) else F.lit(start), length if isinstance(length, Column) else F.lit(length)).try_cast("long")


def _padded(x: Column, width: int | Column) -> Column:
    return F.lpad(x.cast("string"), width, "0")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last counted once; 0 modulo 10 for a valid number."""
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).try_cast("int")
        twice = d * 2
        return s + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _dressed(pattern: Column, digits: Column, kind: str = "^[0-9]$") -> Column:
    """The signs in the places that the signs of that kind have in pattern, with its other signs as they are."""
    taken = F.aggregate(
        F.split(pattern, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, c: F.when(c.rlike(kind), F.struct(F.concat(acc["out"], F.substr(digits, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))),
    )
    return taken["out"]


def _card(key: str, x: Column) -> Column:
    """A card keeps its length, its signs and a right check digit; the digits before that are permuted as two halves."""
    d = _digits(x)
    body = F.length(d) - 1
    half = F.floor(body / 2).cast("int")
    ten = lambda n: F.pow(F.lit(10), n).cast("long")
    new = permute(key, "card", _number(d, 1, half), _number(d, half + 1, body - half), ten(half), ten(body - half))
    text = F.transform(F.array(new), lambda p: F.concat(F.lpad(p["l"].cast("string"), half, "0"), F.lpad(p["r"].cast("string"), body - half, "0")))
    closed = F.transform(text, lambda t: F.concat(t, F.pmod(-luhn_sum(F.concat(t, F.lit("0"))), F.lit(10)).cast("string")))
    return F.element_at(F.transform(closed, lambda t: _dressed(x, t)), 1)


#: Country codes; those that are not listed have three digits.
COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _halves(key: str, tag: str, d: Column) -> Column:
    """A string of 2 to 36 digits, permuted as two halves, in an array of one."""
    n = F.length(d)
    half = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10), k).cast("long")
    new = permute(key, tag, _number(d, 1, half), _number(d, half + 1, n - half), ten(half), ten(n - half))
    return F.transform(F.array(new), lambda p: F.concat(_padded(p["l"], half), _padded(p["r"], n - half)))


def _phone(key: str, x: Column) -> Column:
    """The signs and the country code stay. Of a North American number, the first digits of area and exchange stay below 2, or
    from 2 up, as they were."""
    every = _digits(x)
    d = F.right(every, F.lit(10))
    low = [F.when(_number(d, i, 1) < 2, F.lit(0)).otherwise(F.lit(200)) for i in (1, 4)]
    wide = [F.when(k == 0, F.lit(200)).otherwise(F.lit(800)) for k in low]
    new = permute(key, "phone", (_number(d, 1, 3) - low[0]) * wide[1] + _number(d, 4, 3) - low[1], _number(d, 7, 4), wide[0] * wide[1], 10_000)
    country = F.when(x.startswith("+"), F.lit("1")).otherwise(F.lit(""))
    home = F.transform(F.array(new), lambda p: F.concat(country, _padded(F.floor(p["l"] / wide[1]) + low[0], 3), _padded(p["l"] % wide[1] + low[1], 3), _padded(p["r"], 4)))
    code = F.regexp_extract(every, COUNTRY, 0)
    abroad = F.transform(_halves(key, "phone abroad", F.substr(every, F.length(code) + 1)), lambda t: F.concat(code, t))
    at_home = ~x.startswith("+") | (every.startswith("1") & (F.length(every) == 11))
    return F.element_at(F.transform(F.when(at_home, home).otherwise(abroad), lambda t: _dressed(x, t)), 1)


def _ip(key: str, x: Column) -> Column:
    o = [F.split_part(x, F.lit("."), F.lit(i)).try_cast("int") for i in (1, 2, 3, 4)]
    new = permute(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65_536, 65_536)
    return F.element_at(F.transform(F.array(new), lambda p: F.concat_ws(".", *[y.cast("string") for y in (F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256)])), 1)


#: A span of 400 years has 146,097 days, which is 189 * 773, wherever it starts.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)


def _date(key: str, x: Column) -> Column:
    day = F.datediff(F.try_to_date(x), F.lit(FIRST_DAY).cast("date"))
    new = permute(key, "date", F.floor(day / DAYS[1]), day % DAYS[1], *DAYS)
    return F.element_at(F.transform(F.array(new), lambda p: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (p["l"] * DAYS[1] + p["r"]).cast("int")), "yyyy-MM-dd")), 1)


def _social(key: str, x: Column) -> Column:
    area = _number(x, 1, 3)
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    new = permute(key, "ssn", index * 99 + _number(x, 5, 2) - 1, _number(x, 8, 4) - 1, 898 * 99, 9_999)
    back = lambda i: F.when(i >= 665, i + 2).otherwise(i + 1)
    return F.element_at(F.transform(F.array(new), lambda p: F.concat_ws("-", _padded(back(F.floor(p["l"] / 99)), 3), _padded(p["l"] % 99 + 1, 2), _padded(p["r"] + 1, 4))), 1)


#: Signs of an address that stand for each other.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")


def _email(key: str, x: Column) -> Column:
    """The letters and digits of the local part in two halves; other signs and the domain stay.

    Each round moves the signs of one half inside their class by a keyed hash of the other half and the place: small
    letters stay small letters, capitals capitals, digits digits, so the round can be undone.
    """
    local, domain = F.split_part(x, F.lit("@"), F.lit(1)), F.split_part(x, F.lit("@"), F.lit(2))
    plain = F.regexp_replace(local, "[^A-Za-z0-9]", "")
    n = F.length(plain)
    half = F.floor(n / 2).cast("int")

    def moved(c: Column, noise: Column) -> Column:
        out = F.lit(None).cast("string")
        for signs in CLASSES:
            at = F.position(c, F.lit(signs))
            out = F.when(at > 0, F.substr(F.lit(signs), F.pmod(at - 1 + noise, F.lit(len(signs))).cast("int") + 1, F.lit(1))).otherwise(out)
        return out

    def shifted(part: Column, i: Column, other: Column) -> Column:
        return F.array_join(F.transform(F.filter(F.split(part, ""), lambda c: c != ""), lambda c, at: moved(c, _noise(key, "email", i, F.concat_ws("|", other, at.cast("string"))))), "")

    def step(acc: Column, i: Column) -> Column:
        return F.struct(F.when(i % 2 == 0, shifted(acc["l"], i, acc["r"])).otherwise(acc["l"]).alias("l"), F.when(i % 2 == 1, shifted(acc["r"], i, acc["l"])).otherwise(acc["r"]).alias("r"))

    start = F.struct(F.substr(plain, F.lit(1), half).alias("l"), F.substr(plain, half + 1, n - half).alias("r"))
    new = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    text = F.transform(F.array(new), lambda p: F.concat(p["l"], p["r"]))
    return F.concat(F.element_at(F.transform(text, lambda t: _dressed(local, t, "^[A-Za-z0-9]$")), 1), F.lit("@"), domain)


def kind_of(x: Column) -> Column:
    """The kind of a find if it is valid, else null: octets to 255, dates of the calendar from 1800 to 2199, numbers that were
    given out as social security numbers can be, phones in the form of the North American plan or with a country code, cards that pass the Luhn check."""
    octets = F.forall(F.split(x, r"\."), lambda o: o.try_cast("int") <= 255)
    day = F.try_to_date(x)
    dated = day.isNotNull() & (F.date_format(day, "yyyy-MM-dd") == x) & day.between(F.lit("1800-01-01").cast("date"), F.lit("2199-12-31").cast("date"))
    social = (_number(x, 1, 3).between(1, 899)) & (_number(x, 1, 3) != 666) & (_number(x, 5, 2) > 0) & (_number(x, 8, 4) > 0)
    d = _digits(x)
    return (
        F.when(x.rlike(KINDS["email"]) & x.rlike("^[^@]*[A-Za-z0-9]"), "email")
        .when(x.rlike(KINDS["ip"]), F.when(octets, F.lit("ip")))
        .when(x.rlike(KINDS["date"]), F.when(dated, F.lit("date")))
        .when(x.rlike(KINDS["ssn"]), F.when(social, F.lit("ssn")))
        .when(x.rlike(KINDS["phone"]), "phone")
        .when(x.rlike(KINDS["card"]), F.when(F.length(d).between(13, 19) & (F.pmod(luhn_sum(d), F.lit(10)) == 0), F.lit("card")))
    )


def cards_in(x: Column) -> Column:
    """A run of digits as pieces (x, kind) that make it up: the cards in it, and what stands around them with a null kind.

    A card is 13 to 19 digits that pass the Luhn check, from the start of a group of digits to the end of one. From left to right, the
    longest that starts at a group is taken, unless one with more digits starts inside it. A run of any length takes time in proportion.
    """
    bound = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  a value is computed once, not for each element
    pieces = F.regexp_extract_all(x, F.lit("[0-9]+|[^0-9]+"), 0)  # groups at odd places, one sign between each two

    def longest(b: Column) -> Column:
        """For each group the card with most digits that starts with it: (n digits, k groups), or null."""

        def of(g: Column, i: Column) -> Column:
            sums = F.aggregate(
                F.slice(b["lengths"], i + 1, F.lit(19)),
                F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), F.array().cast("array<struct<n:int,k:int>>").alias("out")),
                lambda acc, m: F.struct((acc["n"] + m).alias("n"), (acc["k"] + 1).alias("k"), F.when((acc["n"] + m).between(13, 19), F.concat(acc["out"], F.array(F.struct((acc["n"] + m).alias("n"), (acc["k"] + 1).alias("k"))))).otherwise(acc["out"]).alias("out")),
                lambda acc: acc["out"],
            )
            valid = F.filter(sums, lambda c: bound(F.array_join(F.slice(b["groups"], i + 1, c["k"]), ""), lambda d: F.pmod(luhn_sum(d), F.lit(10)) == 0))
            return F.array_max(valid)

        return F.transform(b["groups"], of)

    def taken(b: Column) -> Column:
        """(first group, groups) of each card, in order."""

        def step(acc: Column, c: Column, i: Column) -> Column:
            beaten = F.exists(F.slice(b["best"], i + 1, c["k"] - 1), lambda o: F.coalesce(o["n"] > c["n"], F.lit(False)))
            take = c.isNotNull() & (i >= acc["free"]) & ~beaten
            return F.when(take, F.struct((i + c["k"]).alias("free"), F.concat(acc["out"], F.array(F.struct(i.alias("s"), c["k"].alias("k")))).alias("out"))).otherwise(acc)

        start = F.struct(F.lit(1).alias("free"), F.array().cast("array<struct<s:int,k:int>>").alias("out"))
        placed = F.transform(b["best"], lambda c, i: F.struct(c.alias("c"), (i + 1).alias("i")))
        return F.aggregate(placed, start, lambda acc, p: step(acc, p["c"], p["i"]), lambda acc: acc["out"])

    def cut(b: Column) -> Column:
        text = lambda start, n: F.array_join(F.slice(b["pieces"], start, F.greatest(n, F.lit(0))), "")
        piece = lambda t, kind: F.struct(t.alias("x"), F.lit(kind).cast("string").alias("kind"))
        return F.aggregate(
            b["cards"],
            F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<x:string,kind:string>>").alias("out")),
            lambda acc, c: F.struct((2 * (c["s"] + c["k"] - 1)).alias("at"), F.concat(acc["out"], F.array(piece(text(acc["at"], 2 * c["s"] - 1 - acc["at"]), None), piece(text(2 * c["s"] - 1, 2 * c["k"] - 1), "card"))).alias("out")),
            lambda acc: F.concat(acc["out"], F.array(piece(text(acc["at"], F.size(b["pieces"]) + 1 - acc["at"]), None))),
        )

    groups = lambda p: F.filter(p, lambda t, i: i % 2 == 0)
    with_groups = lambda p: F.struct(p.alias("pieces"), groups(p).alias("groups"), F.transform(groups(p), lambda g: F.length(g)).alias("lengths"))
    with_best = lambda b: F.struct(b["pieces"].alias("pieces"), longest(b).alias("best"))
    with_cards = lambda b: F.struct(b["pieces"].alias("pieces"), taken(b).alias("cards"))
    return bound(bound(bound(bound(pieces, with_groups), with_best), with_cards), cut)


def pseudonymize(df: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """df with the text's valid personal data replaced, and n_<kind> longs for email, ip, date, ssn, phone and card.

    Found are e-mail addresses, IPv4 addresses, ISO dates, social security numbers, phone numbers and cards; what fails its
    check is left as it is, but cards are looked for inside a run of digits that is none as a whole. A pseudonym has the format of what it stands for and passes the same check; equal values have
    equal pseudonyms in all documents, and a permutation under the secret gives each, so different values stay different.
    Null texts stay null and empty ones empty, with counts of 0; columns named like an added one are replaced, all others stay. No
    shuffle; rows are independent, and only texts with a find are taken apart. Texts may be of any length, and of any signs.
    """
    held = unused(df, "_named")
    t = F.col(text)
    finds = F.regexp_extract_all(t, F.lit(ANY), 0)
    one = lambda x, kind: F.array(F.struct(x.alias("x"), kind.alias("kind")))
    taken = lambda p: F.when(p["kind"].isNull() & p["x"].rlike(KINDS["card"]), cards_in(p["x"])).otherwise(one(p["x"], p["kind"]))
    named = F.transform(F.transform(finds, lambda x: F.struct(x.alias("x"), kind_of(x).alias("kind"))), taken)
    new = lambda x, kind: F.when(kind == "email", _email(secret, x)).when(kind == "ip", _ip(secret, x)).when(kind == "date", _date(secret, x)).when(kind == "ssn", _social(secret, x)).when(kind == "phone", _phone(secret, x)).when(kind == "card", _card(secret, x)).otherwise(x)
    out = df.withColumn(held, F.when(t.rlike("[0-9]|@"), named))
    parts = F.split(t, ANY, -1)
    swapped = F.transform(F.col(held), lambda pieces: F.array_join(F.transform(pieces, lambda p: new(p["x"], p["kind"])), ""))
    joined = F.array_join(F.zip_with(parts, swapped, lambda part, s: F.concat(part, F.coalesce(s, F.lit("")))), "")
    of = lambda k: F.size(F.filter(F.flatten(held), lambda p: p["kind"] == k))
    counts = {f"n_{k}": F.coalesce(of(k), F.lit(0)).cast("long") for k in KINDS}
    return out.withColumns({**{k: F.greatest(v, F.lit(0)) for k, v in counts.items()}, text: F.when(F.size(held) > 0, joined).otherwise(t)}).drop(held)


#: The setting of the session that holds the secret. Without it the value below is taken, which is public: for tests only.
SECRET, TEST_SECRET = "spark.ledgerline.pseudonyms.secret", "for tests only"


def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, spark.conf.get(SECRET, TEST_SECRET))
