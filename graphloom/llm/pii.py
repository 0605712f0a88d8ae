"""Surrogates for personal data, in built-in functions only.

Detected entities get keyed replacements of their own type and format: digits become digits and letters letters of the
same case; names keep gender (from the form of address) and script and are made of syllables; card and account numbers
keep their issuer or country and get right check digits; phone numbers keep country code and trunk zero; addresses stay
in their range (private, loopback, link-local, public). One canonical value has one surrogate in the whole corpus, and a
name found after a form of address is replaced wherever the same document mentions it. Surrogates that meet each other
or a real value are drawn again until none does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import field, written

FEMALE, MALE = "Mrs|Ms|Miss|Frau|Mme|Madame|Sra|Señora|г-жа|κα", "Mr|Herr|Monsieur|Sr|Señor|г-н|κος"
NEUTRAL = "Dr|Prof|Professor|Doctor"
_TITLE = f"{FEMALE}|{MALE}|{NEUTRAL}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,126}\.[A-Za-z]{2,63}"
IP = rf"(?=\d)(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?=[0-9A-Fa-f:])(?<![\w:.])(?=[A-Fa-f:]{{0,30}}\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|(?:{_HEX}:){{1,7}}:)(?![\w:])"
SSN = r"(?=\d)(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
IBAN = r"(?=[A-Z]{2}\d)(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])"
#: 16 digits, or 13 to 19 that pass the check sum (others are left as they are).
CARD = r"(?=\d)(?<![\d+])\d(?:[ \-]?\d){12,18}(?!\d)"
#: The groups that cards are printed in, or none. These go before phones, which could take a part of them.
CARD_GROUPS = r"(?=[1-9])(?<![\d+])(?:\d{4}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{1,4}(?:[ \-]\d{1,3})?|\d{4}[ \-]\d{6}[ \-]\d{4,5})(?![ \-]?\d)"
CARD16 = r"\d{4}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{4}"
#: With a country code 8 to 15 digits in groups; with a trunk zero 9 to 12 in groups; or groups as in North America.
PHONE = (
    r"(?=\+\d)(?<![\d+])\+(?=(?:[ .\-()/]{0,2}\d){8,15}(?!\d))\d{1,3}(?:[ .\-/]{0,1}\(?\d{1,12}\)?){1,6}(?!\d)"
    r"|(?=0\d)(?<![\d+.])(?!\d\d[.\-/]\d\d[.\-/]\d{4})(?=\d(?:[ .\-/]?\d){8,11}(?!\d))0\d{1,4}[ .\-/]\d{2,8}(?:[ .\-]\d{2,4}){0,4}(?!\d)"
    r"|(?=[\d(])(?<![\d+])(?:\(\d{2,4}\)|\d{2,4})[ .\-]\d{3,4}[ .\-]?\d{4}(?!\d|[ \-]\d{4}(?!\d))"
)
NAME = rf"(?=\p{{Lu}})(?<= )(?<=\b(?:{_TITLE})\.? )\p{{Lu}}[\p{{L}}'\-]{{1,40}}+(?: \p{{Lu}}[\p{{L}}'\-]{{1,40}}+)?"
#: The order decides where patterns overlap.
PATTERNS = {"email": EMAIL, "ipv6": IPV6, "ip": IP, "ssn": SSN, "iban": IBAN, "printed card": CARD_GROUPS, "phone": PHONE, "card": CARD, "name": NAME}
ENTITY = "|".join(PATTERNS.values())
#: What every text with an entity holds; texts without it need no further look.
HINT = rf"[0-9@]|\b(?:{_TITLE})\b"
NAMES = ("given_f", "given_m", "given_n", "surname")

#: Country calling codes of one and two digits; the others have three (fixed values of the numbering plan).
COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: First octets of public unicast addresses, without those that hold a private, shared or special range.
PUBLIC = [n for n in range(1, 224) if n not in (10, 100, 127, 169, 172, 192, 198, 203)]

_LATIN_V, _LATIN_C = "aeiou", "bcdfghjklmnprstvz"
_CYR_V, _CYR_C = "аеиоу", "бвгдзклмнпрст"
_GREEK_V, _GREEK_C = "αεηιο", "βγδκλμνπρστ"
#: Endings of given names by gender and of surnames, by script.
_ENDINGS = {
    "latin": {"given_f": "a ina ela", "given_m": "an us ik", "given_n": "el is en", "surname": "er man son ell ow ard"},
    "cyrillic": {"given_f": "а ина ела", "given_m": "ан ор ик", "given_n": "ен ис", "surname": "ов ин енко ский"},
    "greek": {"given_f": "α ινα ελη", "given_m": "ος ων ης", "given_n": "ις ια", "surname": "ου ης ακης ιδης"},
}
MAX_ATTEMPTS = 24


def luhn_digit(digits: Column) -> Column:
    """The check digit for the digits before it."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    terms = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, doubled(d.cast("int"))).otherwise(d.cast("int")))
    return ((10 - F.aggregate(terms, F.lit(0), lambda a, b: a + b) % 10) % 10).cast("string")


def iban_check(country: Column, rest: Column) -> Column:
    """The two check digits of an account number."""
    step = lambda m, c: F.when(c.between("0", "9"), (m * 10 + c.cast("int")) % 97).otherwise((m * 100 + F.ascii(c) - 55) % 97)
    chars = F.split(F.concat(rest, country, F.lit("00")), "")
    return F.lpad((98 - F.aggregate(chars, F.lit(0), step)).cast("string"), 2, "0")


def _digits(column: str = "surface") -> Column:
    return F.regexp_replace(column, r"\D", "")


def _national(surface: Column) -> Column:
    """The digits of a phone number without country code and trunk zeros."""
    digits = F.regexp_replace(surface, r"\D", "")
    return F.regexp_replace(F.when(surface.startswith("+"), F.regexp_replace(digits, COUNTRY, "")).otherwise(digits), "^0{1,2}", "")


def split_texts(text: Column) -> tuple[Column, Column]:
    """All matches of a text, and what lies between them where there is any: the text is matched whole, once or twice."""
    none = F.array().cast("array<string>")
    hits = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(none)
    return hits.alias("hits"), F.when(F.size(hits) > 0, F.split(text, ENTITY, -1)).alias("between")


def find_entities(texts: DataFrame) -> DataFrame:
    """`rid`, `pos`, `part`, `surface`, `type`, `canon` of all entities of texts with `hits` and `between`.

    A name of two words has two parts. `canon` is what coreferent mentions share: lower-case addresses and names, bare
    digits, a phone number's national digits. Numbers that fail a card's check sum are no entity and have no row.
    """
    each = texts.where(F.size("hits") > 0).select("rid", "between", F.posexplode("hits").alias("pos", "surface"))
    before = F.substring(F.element_at("between", F.col("pos") + 1), -12, 12)
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        if name != "name":
            kind = F.when(F.col("surface").rlike(f"^(?:{pattern})$"), name.split()[-1]).otherwise(kind)
    called = lambda titles: before.rlike(rf"\b(?:{titles})\.? $")
    gender = F.when(called(FEMALE), "given_f").when(called(MALE), "given_m").otherwise("given_n")
    each = each.select("rid", "pos", "surface", kind.alias("type"), gender.alias("gender"))
    body = F.substring(_digits(), F.lit(1), F.length(_digits()) - 1)
    sound = F.col("surface").rlike(f"^{CARD16}$") | (luhn_digit(body) == F.substring(_digits(), -1, 1))
    each = each.where((F.coalesce("type", F.lit("")) != "card") | sound)
    parts = F.when(F.col("type").isNull(), F.split("surface", " ")).otherwise(F.array("surface"))
    each = each.select("rid", "pos", "type", "gender", F.size(parts).alias("n"), F.posexplode(parts).alias("part", "surface"))
    kind = F.coalesce("type", F.when((F.col("n") > 1) & (F.col("part") == 0), F.col("gender")).otherwise("surname"))
    canon = F.when(kind.isin("ssn", "card"), _digits()).when(kind == "phone", _national(F.col("surface")))
    canon = canon.when(kind == "iban", F.regexp_replace("surface", " ", "")).otherwise(F.lower("surface"))
    return each.select("rid", "pos", "part", "surface", kind.alias("type"), canon.alias("canon"))


def _pick(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), (n % len(alphabet) + 1).cast("int"), F.lit(1))


def _pick_of(values: list, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def surrogate(key: str) -> Column:
    """The surrogate of `type`, `canon` at `attempt`, from a keyed digest."""
    seed = F.concat_ws("\u001f", F.lit(key), "type", F.col("attempt").cast("string"), "canon")
    stream = F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("+")), 512))
    number = lambda i: F.conv(F.substring(stream, (i % 120 * 2 + 1).cast("int"), F.lit(3)), 16, 10).cast("int")
    canon, kind = F.col("canon"), F.col("type")

    def same_class(c: Column, i: Column) -> Column:
        out = F.when(c.between("0", "9"), _pick("0123456789", number(i)))
        out = out.when(F.instr(F.lit(_LATIN_V), c) > 0, _pick(_LATIN_V, number(i))).when(c.between("a", "z"), _pick(_LATIN_C, number(i)))
        return out.when(c.between("A", "Z"), F.upper(_pick(_LATIN_C, number(i)))).otherwise(c)

    mapped = F.array_join(F.transform(F.split(canon, ""), same_class), "")
    # Short values may run out of surrogates of their length; later attempts are longer.
    more = F.greatest(F.lit(0), F.col("attempt") - 7)
    longer = F.substring(F.translate(stream, "0123456789", "ghijklmnop"), F.lit(1), more.cast("int"))

    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    host = F.substring_index(F.substring_index(mapped, "@", -1), ".", 1)
    tail = F.regexp_replace(domain, r"^[^.]*\.", "")
    tail = F.when(F.size(F.split(domain, r"\.")) > 2, tail).otherwise(F.substring_index(domain, ".", -1))
    email = F.concat(F.substring(mapped, F.lit(1), F.length(local)), longer, F.lit("@"), host, F.lit("."), tail)

    octet = lambda k: (number(F.lit(k)) % 254 + 1).cast("string")
    fixed = F.regexp_extract(canon, r"^(?:10|127|192\.168|169\.254)(?=\.)", 0)
    fixed = F.when(canon.rlike(r"^172\.(?:1[6-9]|2\d|3[01])\."), F.concat(F.lit("172."), (number(F.lit(9)) % 16 + 16).cast("string"))).otherwise(fixed)
    head = F.when(fixed == "", F.concat(_pick_of(PUBLIC, number(F.lit(0))).cast("string"), F.lit("."), octet(1))).when(F.instr(fixed, ".") > 0, fixed)
    ip = F.concat_ws(".", F.coalesce(head, F.concat(fixed, F.lit("."), octet(1))), octet(2), octet(3))
    hexed = F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when(c == ":", c).otherwise(_pick("123456789abcdef", number(i)))), "")
    scope = F.regexp_extract(canon, r"^(?:fe80::?|fe[89ab]|f[cd])", 0)
    ipv6 = F.when(canon == "::1", canon).otherwise(F.concat(scope, F.substring(hexed, F.length(scope) + 1, F.length(canon))))

    kept = F.concat(F.substring(canon, 1, 1), F.substring(mapped, F.lit(2), F.length(canon)))
    body = F.substring(kept, F.lit(1), F.length(canon) - 1)
    valid = luhn_digit(F.substring(canon, F.lit(1), F.length(canon) - 1)) == F.substring(canon, -1, 1)
    card = F.when(valid, F.concat(body, luhn_digit(body))).otherwise(kept)
    country, account = F.substring(canon, 1, 2), F.substring(mapped, F.lit(5), F.length(canon))
    iban = F.concat(country, iban_check(country, account), account)

    script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").when(canon.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    count = F.greatest(F.lit(1), F.least(F.lit(3), F.length(canon) / 2 - 1)).cast("int") + more
    syllables = F.sequence(F.lit(0), count - 1)
    stem, ending = F.lit(None).cast("string"), F.lit(None).cast("string")

    def syllable(consonants: str, vowels: str):
        return lambda i: F.concat(_pick(consonants, number(i * 2)), F.when(i < count - 1, _pick(vowels, number(i * 2 + 1))).otherwise(""))

    for name, consonants, vowels in (("latin", _LATIN_C, _LATIN_V), ("cyrillic", _CYR_C, _CYR_V), ("greek", _GREEK_C, _GREEK_V)):
        stem = F.when(script == name, F.array_join(F.transform(syllables, syllable(consonants, vowels)), "")).otherwise(stem)
        for role, ends in _ENDINGS[name].items():
            ending = F.when((script == name) & (kind == role), _pick_of(ends.split(), number(F.lit(60)))).otherwise(ending)
    named = F.concat(stem, ending)
    out = {"email": email, "ip": ip, "ipv6": ipv6, "card": card, "phone": kept, "iban": iban}
    return reduce(lambda c, n: c.when(kind == n, out[n]), list(out)[1:], F.when(kind == "email", email)).when(kind.isin(*NAMES), named).otherwise(mapped)


def assign_surrogates(entities: DataFrame, key: str, draw=surrogate, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """`type`, `canon`, `surrogate` for distinct (type, canon): distinct within a type, and none a real value of its kind.

    Given names and surnames are one kind: a surrogate of either is no real name, so that bare mentions stay apart.
    """
    kind = F.when(F.col("type").isin(*NAMES), "name").otherwise(F.col("type"))
    real = entities.select(kind.alias("kind"), F.col("canon").alias("surrogate")).distinct()
    now = written(entities.select("type", "canon", F.lit(0).alias("attempt")).withColumn("surrogate", draw(key)), "surrogates")
    for _ in range(max_attempts):
        first = now.groupBy("type", "surrogate").agg(F.min(F.struct(-F.col("attempt"), "canon")).alias("first"), F.count("*").alias("n"))
        clash = now.join(first.where("n > 1"), ["type", "surrogate"]).where(F.col("canon") != F.col("first.canon")).select("type", "canon")
        taken = now.withColumn("kind", kind).join(real, ["kind", "surrogate"], "left_semi").select("type", "canon")
        again = written(clash.unionByName(taken).distinct().withColumn("again", F.lit(1)), "again")
        if again.isEmpty():
            return now.select("type", "canon", "surrogate")
        more = now.join(again, ["type", "canon"], "left").select("type", "canon", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))
        now = written(more.withColumn("surrogate", draw(key)), "surrogates")
    raise RuntimeError(f"surrogates still collide after {max_attempts} attempts")


def _in_format(surface: Column, kind: Column, canon: Column, value: Column) -> Column:
    """The surrogate in the mention's own format: separators of numbers, leading digits that are no part of the canonical
    number (country code, trunk zero), case of letters."""
    lead = F.when(kind == "phone", F.length(F.regexp_replace(surface, r"\D", "")) - F.length(canon)).otherwise(0)
    start = F.struct(F.lit("").alias("o"), (1 - lead).alias("i"))

    def step(s: Column, c: Column) -> Column:
        put = F.when(s.i < 1, c).otherwise(F.substring(value, s.i, F.lit(1)))
        return F.when(c.rlike("[0-9A-Z]"), F.struct(F.concat(s.o, put).alias("o"), (s.i + 1).alias("i"))).otherwise(F.struct(F.concat(s.o, c).alias("o"), s.i.alias("i")))

    filled = F.aggregate(F.split(surface, ""), start, step, lambda s: s.o)
    first = F.concat(F.upper(F.substring(value, 1, 1)), F.substring(value, F.lit(2), F.length(value)))
    shaped = F.when(kind.isin("ssn", "card", "phone", "iban"), filled).when(kind == "ip", value)
    shaped = shaped.when((F.length(surface) > 1) & (surface == F.upper(surface)) & (surface != F.lower(surface)), F.upper(value))
    return shaped.when(kind.isin(*NAMES), first).otherwise(value)


def _bare(text: Column, names: Column) -> Column:
    """A stretch of text with the further mentions of `names` (surface, s) replaced as whole words, as found or in capitals."""
    word = lambda w: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), w, F.lit(r"\E(?![\p{L}\p{N}])"))

    def put(t: Column, n: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(t, word(n.surface), n.s), word(F.upper(n.surface)), F.upper(n.s))

    return F.aggregate(names, text, put)


def replace_pii(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The rows of `docs` with all their columns, entities of `text` replaced, and `n_entities`.

    `key` is secret: who has it can draw the same surrogates. Null texts stay null, empty ones empty. Rows without an
    entity, repeated or not, are passed through as they are; an empty table gives an empty result. A column of `docs`
    that is named `n_entities` gives way to the count; other names do not matter. Texts may be very long: no pattern
    recurses with their length. `n_entities` counts what was found by a pattern, not the bare mentions of its names.

    Rows, matches and what lies between them are written once; only numbers and short values are shuffled, and the texts
    that hold a match: rows without one go past the join. A popular entity is no hot spot: distinct values come from a partial aggregation, and the join
    back can split it. A document's replacements are one list, which is no longer than the document.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*columns).alias("row"))
    rows = written(rows.select("rid", "row", *split_texts(F.coalesce(field(text), F.lit("")))), "rows")
    found = written(find_entities(rows.select("rid", "hits", "between")), "entities")
    drawn = written(assign_surrogates(found.select("type", "canon").distinct(), key), "drawn")
    named = found.join(drawn, ["type", "canon"]).select("rid", "pos", "part", "surface", "type", _in_format(F.col("surface"), F.col("type"), F.col("canon"), F.col("surrogate")).alias("s"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "s"))), lambda x: x.s), " ")
    people = F.collect_set(F.when(F.col("type").isin(*NAMES) & (F.length("surface") > 1), F.struct("surface", "s")))
    each = named.groupBy("rid", "pos").agg(whole.alias("s"), people.alias("people"))
    lists = each.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("pos", "s"))).alias("new"), F.array_distinct(F.flatten(F.collect_list("people"))).alias("people"))
    lists = written(lists.withColumn("people", F.array_sort("people")), "replacements")
    pieces = F.when(F.size("people") > 0, F.transform("between", lambda b: _bare(b, F.col("people")))).otherwise(F.col("between"))
    put = F.transform("hits", lambda h, i: F.coalesce(F.try_element_at("new", i), h))
    joined = F.array_join(F.zip_with(pieces, put, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    result = F.when(F.col("new").isNotNull(), joined).otherwise(field(text)).alias(text)
    kept = [c for c in docs.columns if c != "n_entities"]
    hit = rows.where(F.size("hits") > 0).join(lists, "rid", "left")
    hit = hit.select(*[result if c == text else field(c).alias(c) for c in kept], F.when(F.col("new").isNull(), 0).otherwise(F.size("new")).alias("n_entities"))
    return hit.unionAll(rows.where(F.size("hits") == 0).select(*[field(c).alias(c) for c in kept], F.lit(0).alias("n_entities")))
