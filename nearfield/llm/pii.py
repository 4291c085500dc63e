"""Format-preserving pseudonyms for personal data, with DataFrame operations only.

Values are found by pattern and validated: payment cards (Luhn), international telephone numbers, IPv4 addresses,
US social security numbers, calendar dates, e-mail addresses and long hexadecimal secrets. Each is carried through a
keyed Feistel permutation of its own format: a card stays a card with a right check digit, a date a date. Equal
values get equal pseudonyms in all documents, different values of a format different ones. Numbers that fail
validation stay as they are.

A day has one pseudonym however it is written. Days up to the 12th go to such days, later ones to later ones: so a date whose
order is US only (its day is above 12) gets one that is US only, and no two dates of a format get the same.

Round functions take SHA-256 of the key, format, round and other half. The key is part of the plan: where plans or event logs
are kept, set spark.sql.redaction.string.regex to hide it. Null texts stay null; empty texts and texts without a
candidate are returned unchanged. Repeated rows and equal values in them are treated alike. A very long text is one row, whose
matches are replaced one by one. An empty table gives an empty result. Columns named n_found and n_replaced are replaced; others
stay, but for _nf_found and _nf_new, which raise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "date": r"(?<![0-9A-Za-z.,/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})(?![0-9A-Za-z]|[.,/-][0-9])",
    "phone": r"(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,5}(?![0-9])",
    "ssn": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|[.-][0-9])",
    "card": r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|[.-][0-9])",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without a match of this has nothing to find.
HINT = "[0-9@]|[a-fA-F]{32}"
#: Dates lie in the 400 years from this day on, so that every day of a range of 27 * 5411 stands for a date. Among them are
#: 240 * 240 days up to the 12th of a month.
FIRST_DAY, DAYS, EARLY = "1700-01-01", (27, 5411), (240, 240)
#: Steps of a walk to a day after the 12th: one in 10 ** 25 does not end.
WALK = 62


def _prf(key: Column, kind: str, turn: Column, half: Column) -> Column:
    """A number in [0, 2**56) from SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, F.lit(kind), turn.cast("string"), half.cast("string")), 256), 1, 14), 16, 10).cast("long")


def pair(l: Column, r: Column, a: Column, b: Column, key: Column, kind: str) -> Column:
    """Feistel permutation of [0, a) x [0, b); a struct of l and r."""

    def turn(s: Column, i: Column) -> Column:
        return F.struct(
            F.when(i % 2 == 0, (s["l"] + _prf(key, kind, i, s["r"])) % a).otherwise(s["l"]).alias("l"),
            F.when(i % 2 == 1, (s["r"] + _prf(key, kind, i, s["l"])) % b).otherwise(s["r"]).alias("r"),
        )

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), F.struct(l.cast("long").alias("l"), r.cast("long").alias("r")), turn)


def digits(value: Column, key: Column, kind: str) -> Column:
    """Permutes strings of 2 to 36 decimal digits of one length."""
    n = F.length(value)
    a, b = F.floor(n / 2).cast("int"), (n - F.floor(n / 2)).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    out = pair(F.substring(value, F.lit(1), a), F.substring(value, a + 1, b), power(a), power(b), key, kind)
    return F.concat(F.lpad(out["l"].cast("string"), a, "0"), F.lpad(out["r"].cast("string"), b, "0"))


def fill(shape: Column, value: Column) -> Column:
    """shape with its decimal digits replaced, in order, by those of value."""
    marks = F.split(shape, "(?<=.)(?=.)", -1)
    step = lambda s, c: F.struct(
        F.concat(s["out"], F.when(c.rlike("^[0-9]$"), F.substring(value, s["at"] + 1, F.lit(1))).otherwise(c)).alias("out"),
        (s["at"] + F.when(c.rlike("^[0-9]$"), 1).otherwise(0)).alias("at"),
    )
    return F.aggregate(marks, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)["out"]


def luhn(body: Column) -> Column:
    """The check digit for a string of digits."""
    chars = F.reverse(F.split(body, "(?<=.)(?=.)", -1))
    each = F.transform(chars, lambda c, i: F.when(i % 2 == 0, F.floor(c.cast("int") * 2 / 10) + c.cast("int") * 2 % 10).otherwise(c.cast("int")))
    total = F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    return F.pmod(-total, F.lit(10)).cast("string")


def letters(value: Column, key: Column, kind: str, alphabet: bool = False) -> Column:
    """Permutes strings position by position: halves in turn shift the other's digits and letters within their own kind
    (alphabet: hexadecimal digits among themselves). Other characters stay."""
    n = F.length(value)
    cut = F.floor((n + 1) / 2).cast("int")
    sets = ["0123456789abcdef", "0123456789ABCDEF"] if alphabet else ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]

    def shifted(half: Column, other: Column, i: Column) -> Column:
        stream = lambda j: F.conv(F.substring(F.sha2(F.concat_ws("|", key, F.lit(kind), i.cast("string"), j.cast("string"), other), 256), 1, 8), 16, 10).cast("long")

        def one(c: Column, j: Column) -> Column:
            out = c
            for s in sets:
                if alphabet:
                    s_is = value.rlike(f"^[{s}]+$") & c.rlike(f"^[{s}]$")
                else:
                    s_is = c.rlike(f"^[{s[0]}-{s[-1]}]$")
                at = F.instr(F.lit(s), c) - 1
                out = F.when(s_is, F.substring(F.lit(s), ((at + stream(j)) % len(s) + 1).cast("int"), F.lit(1))).otherwise(out)
            return out

        return F.array_join(F.transform(F.split(half, "(?<=.)(?=.)", -1), one), "")

    def turn(s: Column, i: Column) -> Column:
        return F.struct(
            F.when(i % 2 == 0, shifted(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"),
            F.when(i % 2 == 1, shifted(s["r"], s["l"], i)).otherwise(s["r"]).alias("r"),
        )

    start = F.struct(F.substring(value, F.lit(1), cut).alias("l"), F.substring(value, cut + 1, n - cut).alias("r"))
    out = F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, turn)
    return F.concat(out["l"], out["r"])


def _date(m: Column, key: Column) -> Column:
    """ISO dates, and DD/MM/YYYY or, where only that is a date, MM/DD/YYYY; null if it is no date of the range."""
    sep = F.substring(m, 3, 1)
    iso = m.rlike("^[0-9]{4}-")
    part = lambda a, n: F.substring(m, a, n)
    parsed = F.when(iso, F.try_to_date(m, "yyyy-MM-dd")).otherwise(
        F.coalesce(F.try_to_date(F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2)), "yyyy-MM-dd"), F.try_to_date(F.concat_ws("-", part(7, 4), part(1, 2), part(4, 2)), "yyyy-MM-dd"))
    )
    us = ~iso & F.try_to_date(F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2)), "yyyy-MM-dd").isNull()
    first = F.lit(FIRST_DAY).cast("date")
    at = F.date_diff(parsed, first).cast("long")
    inside = (at >= 0) & (at < DAYS[0] * DAYS[1])
    # up to the 12th: months from the first and the day, as one number
    months = (F.year(parsed) - int(FIRST_DAY[:4])) * 12 + F.month(parsed) - 1
    number = months * 12 + F.dayofmonth(parsed) - 1
    low = pair(F.floor(number / EARLY[1]), number % EARLY[1], F.lit(EARLY[0]), F.lit(EARLY[1]), key, "early date")
    low = low["l"] * EARLY[1] + low["r"]
    early = F.date_add(F.add_months(first, F.floor(low / 12).cast("int")), (low % 12).cast("int"))

    # later: the permutation of all days, again and again until the day is a later one
    def step(x: Column) -> Column:
        out = pair(F.floor(x / DAYS[1]), x % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), key, "date")
        return out["l"] * DAYS[1] + out["r"]

    day_of = lambda x: F.date_add(first, x.cast("int"))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), step(at), lambda x, i: F.when(F.dayofmonth(day_of(x)) > 12, x).otherwise(step(x)))
    late = F.when(F.dayofmonth(day_of(walk)) > 12, day_of(walk)).otherwise(F.raise_error(F.lit("the walk did not end")).cast("date"))
    day = F.when(F.dayofmonth(parsed) <= 12, early).otherwise(late)
    other = F.concat(F.date_format(day, "dd"), sep, F.date_format(day, "MM"), sep, F.date_format(day, "yyyy"))
    american = F.concat(F.date_format(day, "MM"), sep, F.date_format(day, "dd"), sep, F.date_format(day, "yyyy"))
    return F.when(inside, F.when(iso, F.date_format(day, "yyyy-MM-dd")).when(us, american).otherwise(other))


def _ip(m: Column, key: Column) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    out = pair(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip")
    back = F.concat_ws(".", F.floor(out["l"] / 256), out["l"] % 256, F.floor(out["r"] / 256), out["r"] % 256)
    return F.when(F.forall(o, lambda x: x < 256), back)


def _ssn(m: Column, key: Column) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    right = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    a = F.when(area > 666, area - 2).otherwise(area - 1)
    out = pair(a * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")
    na, ng = F.floor(out["l"] / 99), out["l"] % 99 + 1
    na = F.when(na >= 665, na + 2).otherwise(na + 1)
    pad = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
    return F.when(right, F.concat_ws("-", pad(na, 3), pad(ng, 2), pad(out["r"] + 1, 4)))


def _card(m: Column, key: Column) -> Column:
    """The longest run of whole groups with 13 to 19 digits and a right check digit, as an expiry or a code may stand
    before or after the card; null if there is none."""
    cut = lambda p: F.substring(m, p, F.lit(1)).isin(" ", "-")
    places = F.sequence(F.lit(1), F.length(m))
    starts = F.filter(places, lambda p: (p == 1) | cut(p - 1))
    ends = F.filter(places, lambda p: (p == F.length(m)) | cut(p + 1))
    plain = lambda x: F.regexp_replace(x, "[ -]", "")

    def run(s: Column, e: Column) -> Column:
        text = F.substring(m, s, e - s + 1)
        return F.struct((-F.length(plain(text))).alias("order"), s.alias("start"), text.alias("text"))

    runs = F.flatten(F.transform(starts, lambda s: F.transform(F.filter(ends, lambda e: e - s >= 12), lambda e: run(s, e))))
    valid = lambda r: r["order"].between(-19, -13) & (luhn(F.substring(plain(r["text"]), F.lit(1), -r["order"] - 1)) == F.substring(plain(r["text"]), -1, 1))

    def put(r: Column) -> Column:
        new = digits(F.substring(plain(r["text"]), F.lit(1), -r["order"] - 1), key, "card")
        after = r["start"] + F.length(r["text"])
        return F.concat(F.substring(m, F.lit(1), r["start"] - 1), fill(r["text"], F.concat(new, luhn(new))), F.substring(m, after, F.length(m)))

    return F.get(F.transform(F.slice(F.array_sort(F.filter(runs, valid)), 1, 1), put), 0)


def _phone(m: Column, key: Column) -> Column:
    """The country code stays: what stands before the first separator, else the first digit."""
    code = F.when(m.rlike(r"^\+[0-9]{1,3}[ .(-]"), F.regexp_extract(m, r"^\+[0-9]{1,3}", 0)).otherwise(F.substring(m, 1, 2))
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    plain = F.regexp_replace(rest, "[^0-9]", "")
    total = F.length(plain) + F.length(code) - 1
    return F.when((total >= 8) & (total <= 15) & (F.length(plain) >= 6), F.concat(code, fill(rest, digits(plain, key, "phone"))))


def _email(m: Column, key: Column) -> Column:
    """Name and domain; the part after the last dot stays."""
    top = F.regexp_extract(m, r"\.[A-Za-z]+$", 0)
    return F.concat(letters(F.substring(m, F.lit(1), F.length(m) - F.length(top)), key, "email"), top)


def pseudonym(m: Column, key: Column) -> Column:
    """The pseudonym of one match of ANY; null if it isn't valid."""
    whole = lambda kind: m.rlike(f"^(?:{PATTERNS[kind]})$")
    return (
        F.when(F.contains(m, F.lit("@")), _email(m, key))
        .when(F.startswith(m, F.lit("+")), _phone(m, key))
        .when(whole("date"), _date(m, key))
        .when(whole("ssn"), _ssn(m, key))
        .when(whole("ip"), _ip(m, key))
        .when(whole("secret"), letters(m, key, "secret", alphabet=True))
        .when(whole("card"), _card(m, key))
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replaces text by the text with pseudonyms and adds n_found and n_replaced (ints), replacing columns of these names."""
    k = F.lit(key)
    found = F.when(F.col(text).rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    rows = docs.withColumn("_nf_found", found)
    rows = rows.withColumn("_nf_new", F.when(F.size("_nf_found") > 0, F.transform("_nf_found", lambda m: pseudonym(m, k))))
    between = F.split(text, ANY, -1)
    put = F.array_join(F.zip_with(between, F.zip_with("_nf_found", "_nf_new", lambda m, n: F.coalesce(n, m)), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return rows.withColumns({
        text: F.when(F.size("_nf_new") > 0, put).otherwise(F.col(text)),
        "n_found": F.coalesce(F.nullif(F.size("_nf_found"), F.lit(-1)), F.lit(0)),
        "n_replaced": F.when(F.size("_nf_new") > 0, F.size(F.filter("_nf_new", lambda x: x.isNotNull()))).otherwise(0),
    }).drop("_nf_found", "_nf_new")
