"""Canonical value tokens: pct:, money:CUR:, num:, date:, month:, quarter:, fy: and year: strings.

Currencies and attached magnitude letters need a word border here, so "engineers 412" holds no
rupees and "19th" no trillions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

# Magnitudes, currencies, months, ordinals and number words.
MAGNITUDES = {"k": 10**3, "thousand": 10**3, "m": 10**6, "mm": 10**6, "million": 10**6, "mn": 10**6, "b": 10**9, "bn": 10**9, "billion": 10**9, "t": 10**12, "tn": 10**12, "trillion": 10**12, "lakh": 10**5, "lac": 10**5, "crore": 10**7}
CURRENCIES = {"$": "USD", "us$": "USD", "usd": "USD", "€": "EUR", "eur": "EUR", "euro": "EUR", "euros": "EUR", "£": "GBP", "gbp": "GBP", "¥": "JPY", "jpy": "JPY", "₹": "INR", "inr": "INR", "rs": "INR", "rs.": "INR"}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
ORDINALS = {"first": 1, "1st": 1, "second": 2, "2nd": 2, "third": 3, "3rd": 3, "fourth": 4, "4th": 4}
NUMBER_WORDS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100}

_MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
# The forms of quantities, dates and identifiers.
_SIGN = r"us\$|[$€£¥₹]|(?<![a-z])(?:usd|eur|euros?|gbp|jpy|inr|rs\.?)"
_AFTER = r"[$€£¥₹]|(?:usd|eur|euros?|gbp|jpy|inr|rs\.?)(?![a-z])"
_QUANTITY = rf"(?i)({_SIGN})?\s*((?<![\w-])-?\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|(?<![\w-])-?\d+(?:\.\d+)?)(?:\s*(thousand|million|billion|trillion|lakh|lac|crore)(?![a-z])|(mm|mn|bn|tn|[kmbt])(?![a-z]))?\s*(%|percent|per\s+cent|{_AFTER})?"
_DATES = {
    "iso": r"\b(\d{4})-(\d{2})-(\d{2})\b",
    "mdy": rf"(?i)\b({_MONTH})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})\b",
    "dmy": rf"(?i)\b(\d{{1,2}})\s+({_MONTH})\.?,?\s+(\d{{4}})\b",
    "my": rf"(?i)\b({_MONTH})\.?\s+(\d{{4}})\b",
    "quarter": r"(?i)\bQ([1-4])\s*(?:FY)?\s*(\d{4})\b",
    "year_quarter": r"(?i)\b(?:FY)?\s*(\d{4})\s*Q([1-4])\b",
    "quarter_words": r"(?i)\b(first|1st|second|2nd|third|3rd|fourth|4th)\s+quarter\s*(?:of|,|in)?\s*(?:FY)?\s*(\d{4})\b",
    "fiscal": r"(?i)\b(?:FY|fiscal\s+year|fiscal)\s*(\d{4})\b",
}
_BARE_QUARTER = r"(?i)\bQ([1-4])\b(?!\s*(?:FY)?\s*\d{4})"
_IDENTIFIER = r"(?i)\b(?:[a-z]{2,}[-‑]?\d+(?:\.\d+)*|(?:PEP|RFC|ISO|IEEE|ANSI|BS|EN|DIN|NIST|CVE|SP)\s+\d+(?:[-.]\d+)*|(?:section|chapter|figure|table|appendix|part|clause|article|item|step)\s+\d+(?:\.\d+)*|[QH]\d\b)"


def _all(text, pattern, group):
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def let(value, body):
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _lookup(key, table):
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def number(value):
    """Integral values as integers, others with six significant digits and no trailing zeros."""
    short = F.regexp_replace(F.format_string("%.6g", value), r"(\.\d*?)0+(e|$)", "$1$2")
    return F.when((value == F.floor(value)) & (F.abs(value) < 1e18), value.cast("decimal(20,0)").cast("string")).otherwise(F.regexp_replace(short, r"\.(e|$)", "$1"))


def _masked(text):
    for pattern in _DATES.values():
        text = F.regexp_replace(text, pattern, " ")
    return F.regexp_replace(text, _IDENTIFIER, " ")


def _none():
    return F.array().cast("array<string>")


def _where(text, cheap, found):
    """found(text) where the cheap pattern occurs at all, else nothing: most sentences hold no value."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(cheap), found(text)).otherwise(_none())


def _matches(text, pattern, names):
    """Structs of a pattern's groups, one a match. The text is searched once; groups are read from the short matches."""
    return F.transform(_all(text, pattern, 0), lambda m: F.named_struct(*[x for i, n in enumerate(names, 1) for x in (F.lit(n), F.regexp_extract(m, pattern, i))]))


def quantities(text):
    """One canonical token for each quantity, in order."""
    return _where(text, r"\d", lambda t: let(_masked(t), _quantities))


def _quantities(text):
    found = _matches(text, _QUANTITY, ("pre", "num", "word", "letter", "post"))

    def token(q):
        scale = F.coalesce(_lookup(F.nullif(F.lower(F.concat(q["word"], q["letter"])), F.lit("")), {k: float(v) for k, v in MAGNITUDES.items()}), F.lit(1.0))
        value = let(F.regexp_replace(q["num"], ",", "").cast("double") * scale, number)
        post = F.lower(F.trim(q["post"]))
        money = F.coalesce(_lookup(F.nullif(F.lower(F.trim(q["pre"])), F.lit("")), CURRENCIES), _lookup(F.nullif(post, F.lit("")), CURRENCIES))
        return F.when(post.rlike(r"^(%|percent|per\s+cent)$"), F.concat(F.lit("pct:"), value)).when(money.isNotNull(), F.concat(F.lit("money:"), money, F.lit(":"), value)).otherwise(F.concat(F.lit("num:"), value))

    return F.transform(found, token)


def _month_number(name):
    short = F.lower(F.substring(name, 1, 3))
    return _lookup(short, {m[:3]: f"{i:02d}" for i, m in enumerate(MONTHS, 1)})


def dates(text):
    """Distinct date tokens at every granularity that the text supports; impossible days are left out,
    their month and year kept unless the form was ISO."""
    return _where(text, r"(?i)\d{4}|\bQ[1-4]", _dates)


def _dates(text):
    def parts(name, groups):
        return _matches(text, _DATES[name], groups)

    def days(found, keep_month):
        def tokens(x):
            day = F.try_to_date(F.concat(x["y"], F.lit("-"), x["m"], F.lit("-"), F.lpad(x["d"], 2, "0")), "yyyy-MM-dd")
            rest = F.array(F.concat(F.lit("month:"), x["y"], F.lit("-"), x["m"]), F.concat(F.lit("year:"), x["y"]))
            return F.when(day.isNotNull(), F.concat(F.array(F.concat(F.lit("date:"), day.cast("string"))), rest)).otherwise(rest if keep_month else F.array().cast("array<string>"))

        return F.flatten(F.transform(found, tokens))

    def iso(x):
        return F.named_struct(F.lit("y"), x["y"], F.lit("m"), x["m"], F.lit("d"), x["d"])

    def named(x):
        return F.named_struct(F.lit("y"), x["y"], F.lit("m"), _month_number(x["m"]), F.lit("d"), x["d"])

    def quarter(q, y):
        return F.array(F.concat(F.lit("quarter:"), y, F.lit("-Q"), q), F.concat(F.lit("year:"), y))

    out = [
        days(F.transform(parts("iso", "ymd"), iso), False),
        days(F.transform(parts("mdy", "mdy"), named), True),
        days(F.transform(parts("dmy", "dmy"), named), True),
        F.flatten(F.transform(parts("my", "my"), lambda x: F.array(F.concat(F.lit("month:"), x["y"], F.lit("-"), _month_number(x["m"])), F.concat(F.lit("year:"), x["y"])))),
        F.flatten(F.transform(parts("quarter", "qy"), lambda x: quarter(x["q"], x["y"]))),
        F.flatten(F.transform(parts("year_quarter", "yq"), lambda x: quarter(x["q"], x["y"]))),
        F.flatten(F.transform(parts("quarter_words", "wy"), lambda x: quarter(_lookup(F.lower(x["w"]), {k: str(v) for k, v in ORDINALS.items()}), x["y"]))),
        F.flatten(F.transform(_all(text, _DATES["fiscal"], 1), lambda y: F.array(F.concat(F.lit("fy:"), y), F.concat(F.lit("year:"), y)))),
        F.transform(_all(text, _BARE_QUARTER, 1), lambda q: F.concat(F.lit("quarter:Q"), q)),
        F.transform(_all(text, r"\b(19\d{2}|20\d{2})\b", 1), lambda y: F.concat(F.lit("year:"), y)),
    ]
    return F.array_distinct(F.concat(*out))


def word_numbers(text):
    """Numbers written as words; a percent sign behind one adds pct:, a magnitude behind one num: of both."""
    words = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))
    pattern = rf"(?i)\b({words})\b(?:\s*(%|percent\b|per\s+cent\b)|\s+(hundred|thousand|million|billion|trillion)\b)?"
    def tokens(x):
        n = _lookup(F.lower(x["w"]), NUMBER_WORDS).cast("long")
        scale = _lookup(F.nullif(F.lower(x["s"]), F.lit("")), {"hundred": 100, "thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}).cast("long")
        return F.filter(F.array(F.concat(F.lit("num:"), n.cast("string")), F.when(x["p"] != "", F.concat(F.lit("pct:"), n.cast("string"))), F.concat(F.lit("num:"), (n * scale).cast("string"))), lambda t: t.isNotNull())

    return _where(text, rf"(?i)\b(?:{words})\b", lambda t: F.flatten(F.transform(_matches(t, pattern, ("w", "p", "s")), tokens)))


def source_values(text):
    """All values that a source is understood to hold."""
    return F.array_distinct(F.concat(quantities(text), dates(text), word_numbers(text)))


def required_values(text):
    """All values that a claim asserts; number words assert nothing."""
    return F.array_distinct(F.concat(quantities(text), dates(text)))


def unsupported(required, available):
    """Required values that are not available. Money is also met by an unlabelled number of the same
    amount, unless the source labels that amount with another currency."""

    return let(available, lambda have: _unmet(required, have))


def _unmet(required, available):
    def amount(v):
        return F.element_at(F.split(v, ":"), -1)

    def rival(v):
        return F.exists(available, lambda a: a.startswith("money:") & (amount(a) == amount(v)))

    def met(v):
        return F.array_contains(available, v) | (v.startswith("money:") & F.array_contains(available, F.concat(F.lit("num:"), amount(v))) & ~rival(v))

    return F.array_sort(F.filter(required, lambda v: ~met(v)))
