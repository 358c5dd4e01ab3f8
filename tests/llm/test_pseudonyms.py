import hashlib
import re
from collections import Counter
from datetime import date, timedelta

from pyspark.sql import functions as F

from ledgerline.llm import pseudonyms as p


def swap(spark, texts, secret="k"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r for r in p.pseudonymize(df, secret).orderBy("doc_id").collect()]


def luhn(x):
    d = [int(c) for c in re.sub("[^0-9]", "", x)][::-1]
    return sum(d[0::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])


def test_formats_and_checks_stay(spark):
    texts = ["card 4111 1111 1111 1111.", "call +1 (743) 555-3824 or 212-555-0100", "host 152.143.123.131,", "born 1987-02-28!", "ssn 123-45-6789", "to Ann.19@mail5.example.com now"]
    got = [r["text"] for r in swap(spark, texts)]
    assert re.fullmatch(r"card \d{4} \d{4} \d{4} \d{4}\.", got[0]) and luhn(got[0]) % 10 == 0
    assert re.fullmatch(r"call \+1 \([2-9]\d\d\) [2-9]\d\d-\d{4} or [2-9]\d\d-[2-9]\d\d-\d{4}", got[1])
    assert re.fullmatch(r"host \d{1,3}(\.\d{1,3}){3},", got[2]) and all(int(x) < 256 for x in re.findall(r"\d+", got[2]))
    assert re.fullmatch(r"born \d{4}-\d\d-\d\d!", got[3]) and 1800 <= int(got[3][5:9]) < 2200
    assert re.fullmatch(r"ssn \d{3}-\d\d-\d{4}", got[4]) and got[4][4:7] not in ("000", "666")
    assert re.fullmatch(r"to [A-Z][a-z]{2}\.[0-9]{2}@mail5\.example\.com now", got[5])
    assert all(a != b for a, b in zip(texts, got, strict=True))


def test_equal_values_stay_linked_and_invalid_ones_stay(spark):
    texts = ["4111111111111111 x 4111111111111111", "y 4111111111111111", "4111111111111112", "300.1.1.1", "1987-02-30", "000-12-3456", None, "", "no data", "a@b"]
    rows = swap(spark, texts)
    one = rows[0]["text"].split()
    assert one[0] == one[2] == rows[1]["text"].split()[1] != "4111111111111111"
    assert [r["text"] for r in rows[2:]] == texts[2:]
    assert rows[0]["n_card"] == 2 and rows[6]["n_card"] == 0
    assert swap(spark, texts, "other")[0]["text"] != rows[0]["text"]


def test_permutations_are_whole(spark):
    """Every pair of a small domain has a pseudonym of its own, for even and uneven ranges."""
    for a, b in ((10, 10), (7, 13), (1, 5)):
        df = spark.range(a * b).select(p.permute("k", "t", (F.col("id") / b).cast("long"), F.col("id") % b, a, b).alias("x"))
        got = Counter((r["x"]["l"], r["x"]["r"]) for r in df.collect())
        assert len(got) == a * b and all(0 <= x < a and 0 <= y < b for x, y in got)


def test_dates_are_permuted(spark):
    days = spark.range(2000).select(F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    got = [r["text"] for r in p.pseudonymize(days, "k").collect()]
    assert len(set(got)) == 2000


def test_native(docs_of):
    df = p.pseudonymize(docs_of([(1, "4111111111111111")]).withColumn("n_card", F.lit("clash")), "k")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and df.first()["n_card"] == 1


def test_addresses_are_permuted(spark):
    names = [f"{a}{b}.{d}@x.org" for a in "abcdefghijklmnopqrstuvwxyz" for b in "aBq" for d in range(10)]
    got = [r["text"] for r in swap(spark, names)]
    assert len(set(got)) == len(names) and all(re.fullmatch(r"[a-z][A-Za-z]\.[0-9]@x\.org", x) for x in got)


def test_phones_of_all_forms(spark):
    """Area codes that documents hold, + forms in one piece, and other countries; the neighbours of a number stay what they are."""
    texts = ["call +1 (017) 555-7713 now", "call +1 (132) 555-1352", "017-155-7713", "+12125551234", "+44 20 7946 0958 2 times", "+442079460958", "+33 1 23 45 67 89", "+44 20 7946 0958 1987-02-28", "+49 (30) 1234567, +1 (212) 555-1234"]
    rows = swap(spark, texts)
    got = [r["text"] for r in rows]
    shape = lambda t: re.sub("[0-9]", "d", t)
    assert [shape(t) for t in got] == [shape(t) for t in texts] and all(a != b for a, b in zip(texts, got, strict=True))
    assert [r["n_phone"] for r in rows] == [1, 1, 1, 1, 1, 1, 1, 1, 2] and rows[7]["n_date"] == 1
    assert re.fullmatch(r"call \+1 \([01]\d\d\) [2-9]\d\d-\d{4} now", got[0]) and re.fullmatch(r"[01]\d\d-[01]\d\d-\d{4}", got[2])
    assert got[4].startswith("+44 ") and got[4].endswith(" 2 times") and got[6].startswith("+33 ")
    digits = lambda t: re.sub("[^0-9]", "", t)
    assert digits(got[4])[:-1] == digits(got[5]) and digits(got[3]) == digits(got[8].split(", ")[1])


def test_phones_are_permuted(spark):
    for form in ("+1 (0%02d) 1%02d-0000", "(9%02d) 0%02d-0000", "+44 20 79%02d 00%02d"):
        got = [r["text"] for r in swap(spark, [form % (i, j) for i in range(40) for j in range(20)])]
        assert len(set(got)) == 800


def test_cards_beside_other_numbers(spark):
    card = "4111 1111 1111 1111"
    texts = [f"{card} 123", f"paid 12 {card}", "4111111111111111 12/25", f"{card} 1987-02-28", f"11 22 33 {card} 5", f"{card} 5500 0000 0000 0004", f"{card} 212-555-0100", f"{card} 10.0.0.1", "1 2 3 4 5 6 7 8 9 1 2 3 5", card]
    rows = swap(spark, texts)
    got = [r["text"] for r in rows]
    new = got[-1]
    assert new != card and luhn(new) % 10 == 0
    assert got[:3] == [f"{new} 123", f"paid 12 {new}", re.sub(" ", "", new) + " 12/25"]
    assert got[4] == f"11 22 33 {new} 5" and got[5].startswith(f"{new} ") and luhn(got[5][20:]) % 10 == 0 and got[5][20:] != texts[5][20:]
    assert all(got[i].startswith(f"{new} ") and got[i] != f"{new}{texts[i][19:]}" for i in (3, 5, 6, 7))
    assert [r["n_card"] for r in rows] == [1, 1, 1, 1, 1, 2, 1, 1, 0, 1]
    assert (rows[3]["n_date"], rows[6]["n_phone"], rows[7]["n_ip"]) == (1, 1, 1) and got[8] == texts[8]


class Plain:
    """The operator in plain Python, a find at a time."""

    def __init__(self, secret):
        self.secret = secret

    def noise(self, tag, i, x):
        return int(hashlib.sha256(f"{self.secret}|{tag}|{i}|{x}".encode()).hexdigest()[:13], 16)

    def permute(self, tag, left, right, a, b):
        for i in range(8):
            if i % 2 == 0:
                left = (left + self.noise(tag, i, right)) % a
            else:
                right = (right + self.noise(tag, i, left)) % b
        return left, right

    def halves(self, tag, d):
        k = len(d) // 2
        left, right = self.permute(tag, int(d[:k]), int(d[k:]), 10**k, 10 ** (len(d) - k))
        return f"{left:0{k}}{right:0{len(d) - k}}"

    @staticmethod
    def dressed(pattern, signs, kind="[0-9]"):
        signs = iter(signs)
        return re.sub(kind, lambda _: next(signs), pattern)

    def email(self, x):
        local, _, domain = x.partition("@")
        plain = re.sub("[^A-Za-z0-9]", "", local)
        parts = [plain[: len(plain) // 2], plain[len(plain) // 2 :]]
        for i in range(8):
            own, other = parts[i % 2], parts[1 - i % 2]
            moved = ""
            for at, c in enumerate(own):
                signs = next(k for k in p.CLASSES if c in k)
                moved += signs[(signs.index(c) + self.noise("email", i, f"{other}|{at}")) % len(signs)]
            parts[i % 2] = moved
        return self.dressed(local, "".join(parts), "[A-Za-z0-9]") + "@" + domain

    def ip(self, x):
        o = [int(k) for k in x.split(".")]
        a, b = self.permute("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"

    def day(self, x):
        n = (date.fromisoformat(x) - date(1800, 1, 1)).days
        a, b = self.permute("date", n // 773, n % 773, 189, 773)
        return str(date(1800, 1, 1) + timedelta(a * 773 + b))

    def ssn(self, x):
        area = int(x[:3])
        a, b = self.permute("ssn", (area - 2 if area > 666 else area - 1) * 99 + int(x[4:6]) - 1, int(x[7:]) - 1, 898 * 99, 9999)
        i = a // 99
        return f"{i + 2 if i >= 665 else i + 1:03}-{a % 99 + 1:02}-{b + 1:04}"

    def phone(self, x):
        every = re.sub("[^0-9]", "", x)
        if x.startswith("+") and not (every[0] == "1" and len(every) == 11):
            code = re.match(p.COUNTRY, every)[0]
            return self.dressed(x, code + self.halves("phone abroad", every[len(code) :]))
        d = every[-10:]
        low = [0 if d[i] in "01" else 200 for i in (0, 3)]
        wide = [200 if k == 0 else 800 for k in low]
        a, b = self.permute("phone", (int(d[:3]) - low[0]) * wide[1] + int(d[3:6]) - low[1], int(d[6:]), wide[0] * wide[1], 10_000)
        return self.dressed(x, ("1" if x.startswith("+") else "") + f"{a // wide[1] + low[0]:03}{a % wide[1] + low[1]:03}{b:04}")

    def card(self, x):
        d = re.sub("[^0-9]", "", x)
        body = self.halves("card", d[:-1])
        return self.dressed(x, body + str(-luhn(body + "0") % 10))

    def cards(self, x):
        """A run of digits with the cards in it replaced, and their number."""
        groups = [(m.start(), m.end()) for m in re.finditer("[0-9]+", x)]
        best = []
        for i in range(len(groups)):
            fits = []
            for j in range(i, min(i + 19, len(groups))):
                d = re.sub("[^0-9]", "", x[groups[i][0] : groups[j][1]])
                if 13 <= len(d) <= 19 and luhn(d) % 10 == 0:
                    fits.append((len(d), j))
            best.append(max(fits, default=None))
        out, at, free, n = "", 0, 0, 0
        for i, c in enumerate(best):
            if c and i >= free and not any(best[j] and best[j][0] > c[0] for j in range(i + 1, c[1] + 1)):
                start, end = groups[i][0], groups[c[1]][1]
                out, at, free, n = out + x[at:start] + self.card(x[start:end]), end, c[1] + 1, n + 1
        return out + x[at:], n

    def __call__(self, text):
        n = Counter()

        def one(m):
            x = m[0]
            kind = next((k for k in ("email", "ip", "date", "ssn", "phone", "card") if re.fullmatch(p.KINDS[k][4:-2], x, re.A)), None)
            try:
                ok = {
                    "email": lambda: re.search("^[^@]*[A-Za-z0-9]", x),
                    "ip": lambda: all(int(k) <= 255 for k in x.split(".")),
                    "date": lambda: 1800 <= date.fromisoformat(x).year <= 2199,
                    "ssn": lambda: 1 <= int(x[:3]) <= 899 and x[:3] != "666" and x[4:6] != "00" and x[7:] != "0000",
                    "phone": lambda: True,
                    "card": lambda: 13 <= len(re.sub("[^0-9]", "", x)) <= 19 and luhn(x) % 10 == 0,
                }[kind]()
            except ValueError:
                ok = False
            if not ok:
                if kind != "card":
                    return x
                new, k = self.cards(x)
                n["card"] += k
                return new
            n[kind] += 1
            return {"email": self.email, "ip": self.ip, "date": self.day, "ssn": self.ssn, "phone": self.phone, "card": self.card}[kind](x)

        return (None if text is None else re.sub(p.ANY, one, text, flags=re.A)), *(n[k] for k in p.KINDS)


ODD = ["a@b" + ".c" * 200, "x a@b.co-.uk z", "%+-@a.b", "._@a.b", "1.2.3.4.5", "01.002.3.4", "2199-12-31 2200-01-01 1799-12-31 0000-00-00", "899-99-9999 900-01-0001 666-01-0001", "+1 212 555 0100 4111 1111 1111 1111 12-34", "9 " * 40, "49 9273 9871 6 " * 9, None, "", "é@é.é ä@b.de", "4111-1111-1111-1111-4111-1111-1111-1111"]


def test_equals_plain_python(spark):
    """Row by row, over the driver's documents and odd texts."""
    from oracle import DATA

    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()] + ODD
    plain, got = Plain("k"), swap(spark, texts)
    assert sum(sum(r[2:]) for r in got) > 20
    for t, r in zip(texts, got, strict=True):
        assert (r["text"], *(r[f"n_{k}"] for k in p.KINDS)) == plain(t)


def test_texts_of_any_length(spark):
    """What made a matcher recurse, or work in the square of the length: labels, digits, groups of digits and signs by the hundred thousand."""
    k = 100_000
    texts = ["a@b" + ".c" * k, "a@" + "b" * k + ".c", "7" * 10 * k, "@" * 10 * k, "1 " * k, "4111 1111 1111 1111 " * (k // 40), "+" * 10 * k, "%" * 10 * k, "1." * k, "1-" * k, "a@" * k, "-".join(["2001-02-03"] * (k // 10)), "(" * k, "+1 " * k]
    rows = swap(spark, texts)
    assert rows[0]["n_email"] == 1 and rows[0]["text"][1:] == texts[0][1:]
    assert [rows[i]["text"] for i in (1, 2, 3, 6, 7)] == [texts[i] for i in (1, 2, 3, 6, 7)]
    assert rows[5]["n_card"] == k // 40 and "4111 1111" not in rows[5]["text"]
    assert all(len(r["text"]) == len(t) for r, t in zip(rows, texts, strict=True))


def test_clashing_columns_and_keys(spark):
    df = spark.createDataFrame([("k", "4111111111111111", 7)], "id string, text string, _named int")
    got = p.pseudonymize(df, "k").first()
    assert got["id"] == "k" and got["_named"] == 7 and got["n_card"] == 1


def test_the_secret_comes_from_the_session(spark):
    from oracle import DATA

    before = sorted(map(tuple, p.op9(spark, DATA).collect()), key=str)
    spark.conf.set(p.SECRET, "another")
    try:
        assert sorted(map(tuple, p.op9(spark, DATA).collect()), key=str) != before
    finally:
        spark.conf.unset(p.SECRET)
