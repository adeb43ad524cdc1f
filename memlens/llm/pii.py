"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.  Column functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.  The look-behinds only skip start points that cannot change what the leftmost match is, and the
# possessive loops never need to give back: both keep long runs of digits or letters linear.  A run of under 12 digits is no
# card, so the card pattern asks for 12 at once; the match is still the whole run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# An IBAN's pattern is its first four characters; a group looks ahead over all it can be and its context.  Its lengths are tried by
# mod-97, each end that no letter or digit follows; the country's own length is preferred, then the longest.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11}[\s\S]{0,90}))"
IBAN_REACH = r"^[A-Z0-9]{4}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?"
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
                23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM",
                28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC"}
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CONTEXT = {
    "email": "mail|contact|write|adresse|correo|courriel",
    "ip": "ip|host|server|address|adresse|client|login",
    "card": "card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|fax|telefon|appel|llame",
    "iban": "iban|bank|account|konto|compte|cuenta|transfer",
    "ssn": "ssn|social|security|insurance",
}
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
CONTEXT_CHARS = 40
BLOCK = 256
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
CONTEXT_BONUS = 0.3
EXTRA_MIN_SCORE = 0.5


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True when the digit string passes the Luhn test."""
    turned = F.reverse(digits)
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def step(total: Column, i: Column) -> Column:
        digit = F.try_to_number(F.substr(turned, i, F.lit(1)), F.lit("9")).cast("int")
        twice = F.when(i % 2 == 0, digit * 2).otherwise(digit)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(places, F.lit(0), step) % 10 == 0


def mod97(value: Column) -> Column:
    """True when the account number, first four characters moved to the end and letters as 10-35, leaves 1."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    places = F.sequence(F.lit(1), F.greatest(F.length(turned), F.lit(1)))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(places, F.lit(0), step) == 1


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == "card":
        return F.length(_digits(value)).between(12, 19) & luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _ibans(proposed: Column) -> Column:
    """The proposed starts that begin an account number, with its whole value and the text after it; none overlaps the one before."""
    plain = lambda v: F.replace(v, F.lit(" "), F.lit(""))
    own = F.create_map(*[F.lit(v) for n, names in IBAN_LENGTHS.items() for name in names.split() for v in (name, n)])
    ahead = F.transform(proposed, lambda x: F.struct(x["start"].alias("start"), x["before"].alias("before"), F.concat(x["value"], x["after"]).alias("whole")))
    words = F.transform(ahead, lambda x: F.struct(x["start"].alias("start"), x["before"].alias("before"), x["whole"].alias("whole"),
                                                  F.split(F.regexp_extract(x["whole"], IBAN_REACH, 0), " ").alias("words")))

    def valid(x: Column) -> Column:
        ends = F.transform(F.sequence(F.lit(1), F.size(x["words"])), lambda n: F.array_join(F.slice(x["words"], F.lit(1), n), " "))
        good = F.filter(ends, lambda v: F.length(plain(v)).between(15, 34) & v.rlike("^[A-Z0-9 ]+$") & mod97(v))
        return F.struct(x["start"].alias("start"), x["before"].alias("before"), x["whole"].alias("whole"), good.alias("good"))

    def chosen(x: Column) -> Column:
        of_country = F.filter(x["good"], lambda v: F.length(plain(v)) == F.try_element_at(own, F.left(v, F.lit(2))))
        value = F.coalesce(F.get(of_country, F.lit(0)), F.try_element_at(x["good"], F.lit(-1)))
        return F.struct(x["start"].alias("start"), value.alias("value"), x["before"].alias("before"), x["whole"].alias("whole"))

    def placed(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end"), x["value"].alias("value"), x["before"].alias("before"),
                        F.substr(x["whole"], F.length(x["value"]) + 1, F.lit(CONTEXT_CHARS)).alias("after"))

    found = F.transform(F.transform(F.filter(F.transform(words, valid), lambda x: F.size(x["good"]) > 0), chosen), placed)
    item = "struct<start:int,end:int,value:string,before:string,after:string>"

    def step(state: Column, x: Column) -> Column:
        free = x["start"] >= state["at"]
        return F.struct(F.when(free, x["end"]).otherwise(state["at"]).alias("at"), F.when(free, F.array_append(state["out"], x)).otherwise(state["out"]).alias("out"))

    def blockwise(state: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(state["at"].alias("at"), F.array().cast(f"array<{item}>").alias("out")), step)
        return _once(inner, lambda i: F.struct(i["at"].alias("at"), F.array_append(state["out"], i["out"]).alias("out")))

    def apart(spans: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size(spans) - 1) / BLOCK), F.lit(0)).cast("int"))
        blocks = F.transform(starts, lambda b: F.slice(spans, b * BLOCK + 1, F.lit(BLOCK)))
        return F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{item}>>").alias("out")), blockwise, lambda s: s["out"]))

    return _once(found, apart)


def _spans(text: Column, kind: str, pattern: str, mark: str) -> Column:
    """Valid spans of one kind as array<struct<start, rank, end, kind, score>>, starts in code points.

    The pieces between matches come from a split by the same pattern; running lengths of pieces and matches give the
    starts; the context is the text up to the next match of the kind (after an IBAN: whatever follows), CONTEXT_CHARS at most.  ``mark`` is a character that every match holds: texts without it skip the pattern.
    """
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    between = F.split(text, pattern, -1)
    beyond = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(2)) if kind == "iban" else None
    rank = KINDS.index(kind)
    item = "struct<start:int,end:int,value:string,before:string,after:string>"

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["before"])
        end = start + F.length(x["value"])
        placed = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), F.right(x["before"], F.lit(CONTEXT_CHARS)).alias("before"),
                          (F.left(x["after"], F.lit(CONTEXT_CHARS)) if beyond is None else x["after"]).alias("after"))
        return F.struct(end.alias("at"), F.array_append(state["out"], placed).alias("out"))

    def shifted(state: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda x: F.struct((x["start"] + state["at"]).alias("start"), (x["end"] + state["at"]).alias("end"), x["value"].alias("value"),
                                                             x["before"].alias("before"), x["after"].alias("after")))
        return F.struct((state["at"] + block["at"]).alias("at"), F.array_append(state["out"], moved).alias("out"))

    # running lengths inside blocks of BLOCK matches, then over blocks: appending never copies a long array per match
    pairs = F.transform(found, lambda v, i: F.struct(v.alias("value"), F.get(between, i).alias("before"), F.get(between if beyond is None else beyond, i + 1 if beyond is None else i).alias("after")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{item}>").alias("out"))
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size(found) - 1) / BLOCK), F.lit(0)).cast("int"))
    blocks = _once(pairs, lambda p: F.transform(starts, lambda b: F.aggregate(F.slice(p, b * BLOCK + 1, F.lit(BLOCK)), zero, step)))
    whole = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{item}>>").alias("out"))
    placed = F.flatten(F.aggregate(blocks, whole, shifted, lambda s: s["out"]))
    good = _ibans(placed) if kind == "iban" else F.filter(placed, lambda x: _valid(kind, x["value"]))

    def scored(x: Column) -> Column:
        near = F.lower(F.concat_ws(" ", x["before"], x["after"])).rlike(rf"\b(?:{CONTEXT[kind]})")
        score = F.lit(BASE_SCORE[kind]) + F.when(near, F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.least(score, F.lit(1.0)).alias("score"))

    spans = F.transform(good, scored)
    if kind not in BASE_KINDS:
        spans = F.filter(spans, lambda x: x["score"] >= EXTRA_MIN_SCORE)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double>>")
    return F.when(text.contains(mark) & (F.size(found) > 0), spans).otherwise(none)


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) of every row; spans: array<struct<start, rank, end, kind, score>> ordered by start, then kind.

    Kinds: email, ip (parts at most 255), card (12 to 19 digits, Luhn), phone (9 to 15 digits); these stay whatever
    their score.  Added kinds: iban (mod-97) and ssn, kept from a score of 0.5, which an ssn reaches only beside a
    context word.  Matches of one kind do not overlap; spans of different kinds may.  Null and empty texts have none.
    """
    source = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    t = F.col("_text")
    patterns = {"email": (EMAIL, "@"), "ip": (IP, "."), "card": (CARD, ""), "phone": (PHONE, "+"), "iban": (IBAN, ""), "ssn": (SSN, "-")}
    found = source.select(key, *[_spans(t, k, *patterns[k]).alias(f"_{k}") for k in KINDS])
    return found.select(key, F.array_sort(F.concat(*[F.col(f"_{k}") for k in KINDS])).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by <KIND>; of overlapping spans the earliest is named."""
    def step(state: Column, x: Column) -> Column:
        gap = F.substr(text, state["at"] + 1, F.greatest(x["start"] - state["at"], F.lit(0)))
        piece = F.when(x["start"] >= state["at"], F.concat(state["out"], gap, F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), piece.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, zero, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1)))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the SHA-256 of the base spans, and all spans as text."""
    as_text = lambda x: F.concat(x["kind"], F.lit(":"), x["start"], F.lit(":"), x["end"])
    base = F.filter("spans", lambda x: x["rank"] < len(BASE_KINDS))
    count = lambda i: F.size(F.filter("spans", lambda x: x["rank"] == i)).cast("long")
    return found.select(key, *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)],
                        F.sha2(F.array_join(F.transform(base, as_text), ","), 256).alias("base_sha256"),
                        F.array_join(F.transform("spans", as_text), ",").alias("spans"))
