"""Personal data and secrets: patterns propose spans, checksums and context confirm them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let, running

# The possessive quantifiers and look-behinds change no match of the base
# patterns (a run that fails at its first character fails at all of them); they
# keep the search linear in long runs of one class.
_LOCAL = r"[A-Za-z0-9._%+-]"
BASE_PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Countries by the length of their account numbers.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST",
    26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA",
    30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
_FIXED = "|".join(rf"(?:{codes})[0-9]{{2}}(?:[\x20]?+[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
# Only codes without a known length take the whole run.
_OPEN = rf"(?!{'|'.join(IBAN_LENGTHS.values())})[A-Z]{{2}}[0-9]{{2}}(?:[\x20]?+[A-Z0-9]){{11,30}}+"
_SECRET_NAME = r"(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth[_-]?key)"
_VALUE = r"A-Za-z0-9+/_.~-"
#: Spans that the method adds to the base ones.
ADDED_PATTERNS = {
    # The number is looked ahead at and only its first letter consumed, so that
    # a failing one hides none that begins inside it.
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{_FIXED}|{_OPEN})(?![A-Za-z0-9])))[A-Z]",
    "local_phone": r"(?<![0-9A-Za-z+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "access_key": r"(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,60}|sk-[0-9A-Za-z]{32,64})(?![0-9A-Za-z])",
    # A value that is assigned to a secret's name.
    "secret": rf"(?<![{_VALUE}])(?<=(?i:{_SECRET_NAME})[\"']?[\x20]{{0,3}}[:=][\x20]{{0,3}}[\"']?)[{_VALUE}]{{8,200}}+",
}
#: Words near a span that raise its score, by kind.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write)\b",
    "ip": r"(?i)\b(?:ip|host|server|address)\b",
    "card": r"(?i)\b(?:card|visa|credit|debit|payment)\b",
    "phone": r"(?i)\b(?:phone|call|tel|mobile|fax)\b",
    "iban": r"(?i)\b(?:iban|bank|account|transfer)\b",
    "local_phone": r"(?i)\b(?:phone|call|tel|mobile|fax|telefon|t[eé]l[eé]fono?)\b",
    "national_id": r"(?i)\b(?:ssn|social|security|tax|id)\b",
    "access_key": r"(?i)\b(?:key|access|token|credentials?)\b",
    "secret": r"(?i)\b(?:login|user|key|credentials?)\b",
}
#: Score of a confirmed span without context words, and what these add.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.8, "iban": 0.8, "local_phone": 0.4, "national_id": 0.4, "access_key": 0.9, "secret": 0.7}
CONTEXT_GAIN = 0.3
KEEP_SCORE = 0.5
WINDOW = 40
#: What a text must contain before a pattern is tried on it.
_NEEDS = {"email": ["@"], "phone": ["+"], "access_key": ["AKIA", "ASIA", "ghp_", "gho_", "ghs_", "ghu_", "xox", "sk-"]}
_DIGIT_NEEDS = {
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"(?:[0-9][\x20-]?+){13}",
    "iban": r"[A-Z]{2}[0-9]{2}",
    "local_phone": r"[0-9]{3}[\x20.-][0-9]{4}",
    "national_id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    # Looks back only from the sign, which is rare.
    "secret": rf"[:=](?<=(?i:{_SECRET_NAME})[\"']?[\x20]{{0,3}}[:=])",
}
#: Bits per character of a secret's value, at least; it also has a digit.
SECRET_ENTROPY = 2.5
#: Context is cut from pieces of so many code points, not from the whole text.
_PIECE = 1024
_SPAN = "struct<start:int,end:int,score:double>"


def _any(tests) -> Column:
    return reduce(Column.__or__, tests)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(found: Column) -> Column:
    """13 to 19 digits whose Luhn sum, every second digit from the right doubled, ends in 0."""

    def summed(digits: Column) -> Column:
        n = F.length(digits)

        def part(i: Column) -> Column:
            digit = F.substring(digits, n - i, F.lit(1)).cast("int")
            twice = F.when(i % 2 == 1, digit * 2).otherwise(digit)
            return F.when(twice > 9, twice - 9).otherwise(twice)

        total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), part), F.lit(0), lambda a, x: a + x)
        return F.when(n.between(13, 19), total % 10 == 0).otherwise(F.lit(False))

    return let(_digits(found), summed)


def _mod97(found: Column) -> Column:
    """The account number with its head moved to the end, letters as 10 to 35, leaves 1 modulo 97."""

    def checked(dense: Column) -> Column:
        turned = F.concat(F.substring(dense, F.lit(5), F.length(dense)), F.substring(dense, F.lit(1), F.lit(4)))

        def fold(rest: Column, char: Column) -> Column:
            value = F.when(char.between("0", "9"), F.ascii(char) - 48).otherwise(F.ascii(char) - 55)
            return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

        chars = F.filter(F.split(turned, ""), lambda c: c != "")
        return F.length(dense).between(15, 34) & (F.aggregate(chars, F.lit(0), fold) == 1)

    return let(F.replace(found, F.lit(" "), F.lit("")), checked)


def _confirmed(kind: str, found: Column) -> Column:
    if kind == "ip":
        # Without leading zeros a part has three digits at most; only such ones are compared as numbers.
        def small(part: Column) -> Column:
            bare = F.regexp_replace(part, "^0+", "")
            return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

        return F.forall(F.split(found, r"\."), small)
    if kind == "card":
        return _luhn(found)
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    if kind == "iban":
        return _mod97(found)
    if kind == "secret":
        return F.rlike(found, F.lit("[0-9]")) & (_entropy(found) >= SECRET_ENTROPY)
    return F.lit(True)


def _entropy(found: Column) -> Column:
    """Bits per character of a short string, by how often its characters occur in it."""
    chars = F.filter(F.split(found, ""), lambda c: c != "")

    def share(c: Column) -> Column:
        return (F.length(found) - F.length(F.replace(found, c, F.lit("")))) / F.length(found)

    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda bits, c: bits - share(c) * F.log2(share(c)))


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """Confirmed spans of one kind: (start, end, score) in code points, in order.

    The pieces between matches give the places: a match starts after all
    earlier pieces and what earlier matches consumed. All steps are linear in
    the text and its matches.
    """
    none = F.array().cast(f"array<{_SPAN}>")
    ahead = kind == "iban"

    def consumed(x: Column) -> Column:
        return F.length(x["piece"]) + (F.lit(1) if ahead else F.length(x["match"]))

    def placed(items: Column) -> Column:
        begins = running(items, F.lit(0), lambda at, x: at + consumed(x))
        spans = F.transform(
            F.arrays_zip(items.alias("x"), begins.alias("at")),
            lambda p: F.struct(
                (p["at"] + F.length(p["x"]["piece"])).alias("start"),
                (p["at"] + F.length(p["x"]["piece"]) + F.length(p["x"]["match"])).alias("end"),
                p["x"]["match"].alias("match"),
            ),
        )
        good = F.filter(spans, lambda m: _confirmed(kind, m["match"]))
        return let(good, apart) if ahead else good

    def apart(good: Column) -> Column:
        # Numbers that were looked ahead at may overlap: the first one stays.
        ends = running(good, F.lit(0), lambda end, m: F.when(m["start"] >= end, m["end"]).otherwise(end))
        zipped = F.filter(F.arrays_zip(good.alias("m"), ends.alias("end")), lambda p: p["m"]["start"] >= p["end"])
        return F.transform(zipped, lambda p: p["m"])

    def scored(good: Column) -> Column:
        def with_pieces(pieces: Column) -> Column:
            def cut(begin: Column, n: Column) -> Column:
                at = F.floor(begin / _PIECE).cast("int")
                two = F.concat_ws("", F.try_element_at(pieces, at + 1), F.try_element_at(pieces, at + 2))
                return F.substring(two, begin - at * _PIECE + 1, n)

            def score(m: Column) -> Column:
                begin = F.greatest(m["start"] - WINDOW, F.lit(0))
                near = F.concat(cut(begin, m["start"] - begin), F.lit(" "), cut(m["end"], F.lit(WINDOW)))
                gain = F.when(F.rlike(near, F.lit(CONTEXT[kind])), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
                return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.least(F.lit(PRIOR[kind]) + gain, F.lit(1.0)).alias("score"))

            return F.transform(good, score)

        pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
        return F.when(F.size(good) == 0, none).otherwise(let(pieces, with_pieces).cast(f"array<{_SPAN}>"))

    def found_in(found: Column) -> Column:
        items = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("piece"), found.alias("match"))
        return F.when(F.size(found) == 0, none).otherwise(let(let(items, placed), scored))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(int(ahead))), found_in)
    possible = _any(F.contains(text, F.lit(x)) for x in _NEEDS[kind]) if kind in _NEEDS else F.rlike(text, F.lit(_DIGIT_NEEDS[kind]))
    return F.when(possible, found).otherwise(none)


def _clear_of_base(base: Column, added: Column) -> Column:
    """Each added kind's spans that reach ``KEEP_SCORE`` and overlap no base span.

    All spans are laid in one order; the farthest end of the base spans before
    a span and the nearest start of those after it tell whether one overlaps.
    """
    kinds = list(ADDED_PATTERNS)
    tagged = "array<struct<start:int,end:int,kind:int,score:double>>"

    def tag(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["score"].alias("score"))).cast(tagged)

    def judged(spans: Column) -> Column:
        farthest = running(spans, F.lit(0), lambda end, s: F.when(s["kind"] < 0, F.greatest(end, s["end"])).otherwise(end))
        nearest = F.reverse(running(F.reverse(spans), F.lit(2**31 - 1), lambda start, s: F.when(s["kind"] < 0, F.least(start, s["start"])).otherwise(start)))
        zipped = F.arrays_zip(spans.alias("s"), farthest.alias("before"), nearest.alias("after"))
        kept = F.filter(
            zipped, lambda z: (z["s"]["kind"] >= 0) & (z["s"]["score"] >= KEEP_SCORE) & (z["before"] <= z["s"]["start"]) & (z["after"] >= z["s"]["end"])
        )
        return F.transform(kept, lambda z: z["s"])

    def by_kind(kept: Column) -> Column:
        def one(kind: int) -> Column:
            mine = F.filter(kept, lambda s: s["kind"] == kind)
            return F.transform(mine, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))

        return F.struct(*[one(i).alias(k) for i, k in enumerate(kinds)])

    every = F.array_sort(F.concat(*[tag(added[k], i) for i, k in enumerate(kinds)], *[tag(base[k], -1) for k in BASE_PATTERNS]))
    some = sum((F.size(added[k]) for k in kinds), F.lit(0)) > 0
    none = F.array().cast(tagged)
    return let(F.when(some, let(every, judged)).otherwise(none), by_kind)


def find_personal_data(documents: DataFrame, text: str = "text", name: str = "personal") -> DataFrame:
    """Add the struct ``name`` with one array of (start, end, score) per kind.

    The base kinds hold every leftmost, non-overlapping match of their pattern
    that its check confirms (parts of an address at most 255, Luhn, number of
    digits); context words only change their scores. The added kinds are bank
    accounts of their country's length (any, where the code is not listed)
    confirmed modulo 97; numbers written like national phones or ids, which
    need a context word nearby to reach ``KEEP_SCORE``; access keys with a
    known head; and values assigned to a secret's name, which need a digit and
    ``SECRET_ENTROPY`` bits a character. Added spans are left out where they
    overlap a base span. Ends are exclusive, in code points; spans are in order
    of their starts, which differ within a kind.

    Null and empty texts have no spans. Each row is searched by itself and
    whole: repeated rows give the same spans, an empty table gives no rows, and
    the work is linear in a text's length and matches. An input column called
    ``name``, in any case of letters, is replaced.
    """
    body, base, added = (free_name(documents, x) for x in ("body", "base", "added"))
    frame = documents.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    frame = frame.withColumns(
        {
            base: F.struct(*[_spans(F.col(body), k, p).alias(k) for k, p in BASE_PATTERNS.items()]),
            added: F.struct(*[_spans(F.col(body), k, p).alias(k) for k, p in ADDED_PATTERNS.items()]),
        }
    )
    both = let(
        _clear_of_base(F.col(base), F.col(added)),
        lambda clear: F.struct(*[F.col(base)[k].alias(k) for k in BASE_PATTERNS], *[clear[k].alias(k) for k in ADDED_PATTERNS]),
    )
    return frame.withColumn(name, both).drop(body, base, added)


def span_list(personal: Column, kinds) -> Column:
    """``kind:start:end`` of all spans by kind and start, comma-joined."""

    def listed(kind: str) -> Column:
        return F.transform(
            personal[kind], lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))
        )

    parts = [listed(kind) for kind in kinds]
    return F.array_join(F.concat(*parts), ",")


def op2_query(documents: DataFrame) -> DataFrame:
    """The contract's counts and digest of the base spans; then all spans, and their number in all and of secrets."""
    rows = find_personal_data(documents.select("doc_id", "text"))
    p = F.col("personal")

    def number(kinds) -> Column:
        return sum((F.size(p[k]) for k in kinds), F.lit(0)).cast("long")

    return rows.select(
        "doc_id",
        *[F.size(p[k]).cast("long").alias(f"n_{k}") for k in BASE_PATTERNS],
        F.sha2(span_list(p, BASE_PATTERNS).cast("binary"), 256).alias("base_sha256"),
        span_list(p, [*BASE_PATTERNS, *ADDED_PATTERNS]).alias("spans"),
        number([*BASE_PATTERNS, *ADDED_PATTERNS]).alias("n_spans"),
        number(["access_key", "secret"]).alias("n_secrets"),
    )
