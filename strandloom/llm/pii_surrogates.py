"""PII: detected entities get keyed surrogates of the same type, script and format.

A surrogate is a keyed permutation of the values of one format, so distinct values stay distinct
and equal values (however they are written: case, separators) get equal surrogates in every document,
without a table of what has been seen. The permutation is a three-round Feistel network Q over the
units of a value (digits, letters by class, octets), a step of one, and Q undone: a step of one leaves
no value in place, so neither does the whole, and no surrogate equals its original.

Names are replaced word by word. A listed given name rotates within the list of its gender and script;
any other word is permuted by its letters, and where that would land on a listed name it goes on to
the first that isn't listed. Both are one bijection over all words. A name that was found with a title
or by its given name is also replaced where one of its words stands alone in the same text, capitals included.

Letters of scripts without an alphabet here are exchanged within their script's range of code points. What has
no letter or digit to exchange is no entity. Patterns have no star over a group and start where a word starts, so
searching takes time in proportion to the text, whatever stands in it; so does exchanging a value's units.

All of it is built-in expressions. Documents without a digit, an "@", a title, a listed name or a word
that announces a secret skip the search. ``collisions`` counts surrogates that stand for more than one value
over a whole table; the query fails if there are any.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_rules import let

# Classes of characters that are exchanged among themselves. Those of a to f are apart, so
# hexadecimal values stay hexadecimal.
ALPHABETS = (
    "0123456789",
    "ae",
    "iou",
    "bcdf",
    "ghjklmnpqrstvwxyz",
    "àâäáãåāăąèéêëēĕėęěìíîïīĭįòóôöõōŏőùúûüūŭůűųýÿŷ",
    "çćĉċčďđĝğġģĥħĵķĺļľłñńņňŕŗřśŝşšťţŧŵźżžþð",
    "аеёиоуыэюя",
    "бвгджзйклмнпрстфхцчшщіїєґў",
    "αεηιουω",
    "άέήίόύώ",
    "βγδζθκλμνξπρστφχψ",
)
# First and last code points of the letters of other scripts, which have no case.
RANGES = (
    (0x05D0, 0x05EA),  # Hebrew
    (0x0621, 0x063A),  # Arabic
    (0x0641, 0x064A),
    (0x0905, 0x0939),  # Devanagari
    (0x0985, 0x098C),  # Bengali
    (0x0995, 0x09A8),
    (0x0E01, 0x0E2E),  # Thai
    (0x10D0, 0x10F0),  # Georgian
    (0x3041, 0x3096),  # Hiragana
    (0x30A1, 0x30FA),  # Katakana
    (0x4E00, 0x9FA5),  # Han
    (0xAC00, 0xD7A3),  # Hangul
)
# Country codes of two digits; +1 and +7 have one, all others three.
TWO_DIGIT_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
# Titles, and given names by gender and script.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Г-жа"),
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Г-н"),
    "any": ("Dr", "Prof", "Professor", "Mx"),
}
NAMES = {
    ("f", "latin"): ("Alice", "Anna", "Carmen", "Clara", "Claire", "Elena", "Emma", "Eva", "Hannah", "Ida", "Julia", "Laura", "Lucia", "Maria", "Marta", "Nina", "Nora", "Olivia", "Rosa", "Sophie"),
    ("m", "latin"): ("Adam", "Anton", "Carlos", "David", "Diego", "Emil", "Felix", "Henry", "Hugo", "Jakob", "James", "Jean", "John", "Karl", "Louis", "Lukas", "Mark", "Oscar", "Paul", "Pedro"),
    ("f", "cyrillic"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Дмитрий", "Иван", "Максим", "Олег", "Павел"),
}
_ALL_TITLES = "|".join(sorted((t for own in TITLES.values() for t in own), key=len, reverse=True))
_ALL_NAMES = "|".join(sorted((n for own in NAMES.values() for n in own), key=len, reverse=True))
#: Neither a letter nor a digit before, or after, in any script.
_START, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_NAME = r"\p{Lu}[\p{L}'-]+"
#: What stands before a name that a title announces.
_TITLED = rf"{_START}(?:{_ALL_TITLES})\.?\s{{1,2}}"

#: Kinds of entities and their patterns, in the order in which they are tried at a place.
KINDS = (
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++){0,126}\.\p{L}{2,}"),
    ("secret", r"""(?<=(?i:token|secret|password|passwd|api_key|apikey|access_key)\s?[=:]\s?["']?)[A-Za-z0-9+/_-]{12,}"""),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("card", r"(?<![\d-])(?:\d{4}[ -]?){3}\d{1,7}(?![\d-])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d+])\+\d{8,15}(?!\d)"),
    ("name", rf"(?=\p{{Lu}})(?:(?<={_TITLED}){_NAME}(?: {_NAME})?|{_START}(?:{_ALL_NAMES}) {_NAME})"),
)
PATTERN = "|".join(f"(?:{p})" for _, p in KINDS)
#: With names known, every word that could be one.
WITH_WORDS = rf"{PATTERN}|{_START}{_NAME}{_END}"
#: What a text must have for the search to find anything.
HINT = rf"[0-9@]|(?i:token|secret|passw|api_?key|access_key)|{_START}(?:{_ALL_TITLES}|{_ALL_NAMES}){_END}"


def _code(char: Column) -> Column:
    return F.conv(F.hex(F.encode(char, "UTF-16BE")), 16, 10).cast("int")


def _unit(char: Column) -> Column:
    """struct(v, m, a, low): place in its alphabet, or in the range from low; the size of either; the alphabet."""
    lower, found = F.lower(char), F.lit(None).cast("string")
    for alphabet in ALPHABETS:
        found = F.when(F.contains(F.lit(alphabet), lower), F.lit(alphabet)).otherwise(found)

    def ranged(code: Column) -> Column:
        low, high = F.lit(0), F.lit(0)
        for first, last in RANGES:
            own = code.between(first, last)
            low, high = F.when(own, first).otherwise(low), F.when(own, last).otherwise(high)
        return F.struct((code - low).alias("v"), (high - low + 1).alias("m"), F.lit("").alias("a"), low.alias("low"))

    listed = lambda a: F.struct((F.instr(a, lower) - 1).alias("v"), F.length(a).alias("m"), a.alias("a"), F.lit(0).alias("low"))
    return let(found, lambda a: F.when(a.isNotNull(), listed(a)).otherwise(let(_code(char), ranged)))


#: A character that is exchanged, as a pattern.
UNIT = "[" + "".join(ALPHABETS) + "".join(a.upper() for a in ALPHABETS if a != a.upper()) + "".join(f"\\x{{{first:X}}}-\\x{{{last:X}}}" for first, last in RANGES) + "]"


def _moved(units: Column, by: Column, sign: int, tag: str, key: str) -> Column:
    """units with each v moved by a keyed stream that the values of the other half determine."""
    digest = F.sha2(F.concat(F.lit(f"{key}|{tag}|"), F.array_join(F.transform(by, lambda u: F.concat_ws(":", u["v"], u["m"])), ",")), 256)

    def shifted(stream: Column) -> Column:
        def one(u: Column, i: Column) -> Column:
            step = F.conv(F.substr(stream, 1 + (i * 4) % 60, F.lit(4)), 16, 10).cast("int")
            return F.struct(F.pmod(u["v"] + sign * step, u["m"]).cast("int").alias("v"), u["m"].alias("m"), u["a"].alias("a"), u["low"].alias("low"))

        return F.transform(units, one)

    return let(digest, shifted)


def permuted(units: Column, key: str) -> Column:
    """Units of a value after the keyed permutation of its format."""
    half = lambda u: F.floor((F.size(u) + 1) / 2).cast("int")
    move = lambda side, by, sign, turn: _moved(side, by, sign, str(turn), key)

    def next_of(left: Column) -> Column:
        return F.transform(left, lambda u, i: F.struct(F.when(i == 0, F.pmod(u["v"] + 1, u["m"])).otherwise(u["v"]).cast("int").alias("v"), u["m"].alias("m"), u["a"].alias("a"), u["low"].alias("low")))

    def rounds(left: Column, right: Column) -> Column:
        return let(
            move(right, left, 1, 1),
            lambda r1: let(
                move(left, r1, 1, 2),
                lambda l1: let(
                    move(r1, l1, 1, 3),
                    lambda r2: let(next_of(l1), lambda m1: let(move(r2, m1, -1, 3), lambda q1: let(move(m1, q1, -1, 2), lambda m0: F.concat(m0, move(q1, m0, -1, 1))))),
                ),
            ),
        )

    return let(units, lambda u: F.when(F.size(u) == 0, u).otherwise(rounds(F.slice(u, 1, half(u)), F.slice(u, half(u) + 1, F.size(u)))))


def _written(unit: Column, like: Column) -> Column:
    """The character of a unit, in the case of the one it replaces."""
    ranged = F.decode(F.unhex(F.lpad(F.hex(unit["low"] + unit["v"]), 4, "0")), "UTF-16BE")
    char = F.when(unit["a"] == "", ranged).otherwise(F.substr(unit["a"], unit["v"] + 1, F.lit(1)))
    return F.when((like != F.lower(like)), F.upper(char)).otherwise(char)


def _replaced(text: Column, fixed: Column, kind: str, key: str) -> Column:
    """text with its units permuted, but for the first ``fixed`` characters."""

    def of(rest: Column) -> Column:
        chars, gaps = F.regexp_extract_all(rest, F.lit(UNIT), F.lit(0)), F.split(rest, UNIT)

        def put(old: Column) -> Column:
            new = permuted(F.transform(old, _unit), f"{key}|{kind}")
            return F.array_join(F.zip_with(gaps, F.zip_with(new, old, _written), lambda g, c: F.concat(g, F.coalesce(c, F.lit("")))), "")

        return let(chars, put)

    return F.concat(F.left(text, fixed), let(F.substr(text, fixed + 1), of))


def _luhn(digits: Column) -> Column:
    """The check digit that Luhn's rule asks for after these digits (array of digit strings)."""
    total = F.aggregate(
        F.transform(F.reverse(digits), lambda d, i: let(d.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x))),
        F.lit(0),
        lambda s, x: s + x,
    )
    return F.pmod(10 - total % 10, F.lit(10))


def _email(m: Column, key: str) -> Column:
    """Local part and domain labels change; the last label stays."""
    end = F.regexp_extract(m, r"(\.\p{L}{2,})$", 1)
    return F.concat(_replaced(F.substr(m, F.lit(1), F.length(m) - F.length(end)), F.lit(0), "email", key), end)


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda o: F.struct(o.cast("int").alias("v"), F.lit(256).alias("m"), F.lit("").alias("a"), F.lit(0).alias("low")))
    return F.array_join(F.transform(permuted(octets, f"{key}|ip"), lambda u: u["v"].cast("string")), ".")


def _card(m: Column, key: str) -> Column:
    """All digits but the last change; the last is as far from Luhn's check digit as it was."""
    digits = lambda t: F.regexp_extract_all(t, F.lit("[0-9]"), F.lit(0))
    body, last = F.substr(m, F.lit(1), F.length(m) - 1), F.right(m, F.lit(1)).cast("int")
    return let(_replaced(body, F.lit(0), "card", key), lambda new: F.concat(new, F.pmod(last - _luhn(digits(body)) + _luhn(digits(new)), F.lit(10)).cast("string")))


def _phone(m: Column, key: str) -> Column:
    """All digits but those of a country code after "+" change."""
    two = "|".join(TWO_DIGIT_CODES.split())
    return _replaced(m, F.length(F.regexp_extract(m, rf"^(\+(?:[17]|{two}|\d{{3}}))", 1)), "phone", key)


@dataclass(frozen=True)
class NameKey:
    """A key for the permutation of words, and where words go that it would put on listed names."""

    key: str
    landings: dict[str, str]


def name_key(spark: SparkSession, key: str) -> NameKey:
    """The key of words, with the words that follow where the permutation comes to a listed name.

    The permutation moves words in rings. After a listed name comes the next word of its ring that
    isn't listed; words that are the only such ones of their rings follow one another. Only the rings
    of listed names (a few dozen) are looked at, with the same expressions.
    """
    listed = {n.lower(): letters for (_, letters), own in NAMES.items() for n in own}

    def permuted_by(salted: str, words: list[str]) -> dict[str, str]:
        rows = spark.range(1).select(F.explode(F.array(*map(F.lit, words))).alias("word"))
        return {r["word"]: r["new"] for r in rows.select("word", _replaced(F.col("word"), F.lit(0), "name", salted).alias("new")).collect()}

    for salt in itertools.count():
        salted = f"{key}|{salt}"
        step, landings = permuted_by(salted, list(listed)), {}
        for name in listed:
            end, seen = step[name], {name}
            while end in step and end not in seen:
                seen.add(end)
                end = step[end]
            if end not in step:  # else a ring of listed names, where no other word can arrive
                landings[name] = end
        again = permuted_by(salted, sorted(set(landings.values()))) if landings else {}
        alone = {letters: sorted({end for name, end in landings.items() if listed[name] == letters and landings.get(again[end]) == end}) for letters in sorted(set(listed.values()))}
        if all(len(own) != 1 for own in alone.values()):
            return NameKey(salted, landings | {again[word]: own[(i + 1) % len(own)] for own in alone.values() for i, word in enumerate(own)})


def _word(word: Column, key: NameKey) -> Column:
    """The surrogate of one word of a name."""
    styled = lambda new: F.when(word == F.upper(word), F.upper(new)).otherwise(F.initcap(new))
    rotated = {}
    for (of, letters), names in NAMES.items():
        turn = int(hashlib.sha256(f"{key.key}|{of}|{letters}".encode()).hexdigest()[:6], 16) % (len(names) - 1) + 1
        rotated |= {name.lower(): names[(i + turn) % len(names)] for i, name in enumerate(names)}
    as_map = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair]) if d else F.create_map().cast("map<string,string>")
    listed = F.try_element_at(as_map(rotated), F.lower(word))
    return F.coalesce(styled(listed), let(_replaced(word, F.lit(0), "name", key.key), lambda new: F.coalesce(styled(F.try_element_at(as_map(key.landings), F.lower(new))), new)))


def _name(m: Column, key: NameKey) -> Column:
    return F.array_join(F.transform(F.split(m, " "), lambda w: _word(w, key)), " ")


def kind_of(m: Column, before: Column, names: Column) -> Column:
    """Kind of a match, from its form and what stands before it; null for a word that is no known name's.

    names: words of the names found in the text, lower-cased.
    """
    secret = F.rlike(before, F.lit(r"""(?is)(?:token|secret|password|passwd|api_key|apikey|access_key)\s?[=:]\s?["']?$"""))
    found = F.when(F.contains(m, F.lit("@")), "email").when((F.length(m) >= 12) & secret & F.rlike(m, F.lit(r"^[A-Za-z0-9+/_-]{12,}+$")), "secret")
    is_name = F.rlike(m, F.lit(rf"^{_NAME}(?: {_NAME})?$"))
    found = found.when(is_name & F.exists(F.split(F.lower(m), " "), lambda w: F.array_contains(names, w)), "name").when(is_name, F.lit(None))
    for kind, pattern in KINDS[2:-1]:
        found = found.when(F.rlike(m, F.lit(f"^(?:{pattern})$")), kind)
    return found


def surrogate_of(m: Column, kind: Column, key: str, names: NameKey) -> Column:
    """The keyed surrogate of one match."""
    found = F.when(kind == "email", _email(m, key)).when(kind == "ip", _ip(m, key)).when(kind == "card", _card(m, key)).when(kind == "name", _name(m, names)).when(kind == "phone", _phone(m, key))
    for other in ("secret", "iban", "ssn"):
        found = found.when(kind == other, _replaced(m, F.lit(0), other, key))
    return found


def replace(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the entities in their texts replaced, and with entities: an array of
    (kind, start, original, surrogate), start in code points of the original text.

    The key is the caller's secret. Null texts stay null and have no entities; texts without entities stay
    as they are; repeated rows are replaced alike. A column that has the name "entities" is replaced. An
    empty table gives an empty one. Narrow: no shuffle.
    """
    if not key:
        raise ValueError("surrogates need a key")
    value, names = F.col(text), name_key(docs.sparkSession, key)
    found = docs.withColumn("__first", F.when(F.rlike(value, F.lit(HINT)), F.regexp_extract_all(value, F.lit(PATTERN), F.lit(0))))
    # words of the names found so far are looked for as well
    known = F.filter("__first", lambda m: F.rlike(m, F.lit(rf"^{_NAME}(?: {_NAME})?$")))
    found = found.withColumn("__names", F.array_distinct(F.flatten(F.transform(known, lambda m: F.split(F.lower(m), " ")))))
    named = F.size("__names") > 0
    found = found.withColumn("entities", F.when(named, F.regexp_extract_all(value, F.lit(WITH_WORDS), F.lit(0))).otherwise(F.col("__first")))
    found = found.withColumn("__gaps", F.when(F.size("entities") > 0, F.when(named, F.split(value, WITH_WORDS)).otherwise(F.split(value, PATTERN))))

    def entity(m: Column, i: Column) -> Column:
        before = F.right(F.get("__gaps", i), F.lit(40))
        kind = F.when(F.rlike(m, F.lit(UNIT)), kind_of(m, before, F.col("__names")))
        made = lambda k: F.struct(k.alias("kind"), m.alias("original"), F.coalesce(surrogate_of(m, k, key, names), m).alias("surrogate"), F.length(F.get("__gaps", i)).alias("gap"))
        return let(kind, made)

    made = found.withColumn("__made", F.when(F.size("entities") > 0, F.transform("entities", entity)))
    new_text = F.when(
        F.col("__made").isNotNull(),
        F.concat(F.array_join(F.zip_with(F.slice("__gaps", 1, F.size("__made")), "__made", lambda g, e: F.concat(g, e["surrogate"])), ""), F.element_at("__gaps", -1)),
    ).otherwise(value)
    # where each starts: running sums of the gaps and matches before it
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    add = lambda s, x: F.struct((s["at"] + x["gap"] + F.length(x["original"])).alias("at"), F.array_append(s["all"], s["at"] + x["gap"]).alias("all"))
    placed = lambda at: F.zip_with("__made", at, lambda e, a: F.struct(e["kind"].alias("kind"), a.alias("start"), e["original"].alias("original"), e["surrogate"].alias("surrogate")))
    starts = F.filter(let(F.aggregate("__made", zero, add)["all"], placed), lambda e: e["kind"].isNotNull())
    empty = F.array().cast("array<struct<kind:string,start:int,original:string,surrogate:string>>")
    return made.withColumn(text, new_text).withColumn("entities", F.coalesce(starts, empty)).drop("__first", "__names", "__gaps", "__made")


def canonical(kind: Column, value: Column) -> Column:
    """What all spellings of one entity have in common: letters, digits and a leading plus, lower-cased; of
    emails and names all of it, of secrets as it is written."""
    octets = F.array_join(F.transform(F.split(value, r"\."), lambda o: o.cast("int").cast("string")), ".")
    bare = F.lower(F.regexp_replace(value, r"(?!^\+)[^\p{L}\p{N}]", ""))
    return F.when(kind == "secret", value).when(kind == "ip", octets).when(kind.isin("email", "name"), F.lower(value)).otherwise(bare)


def collisions(replaced: DataFrame) -> DataFrame:
    """(kind, surrogate, n_values) of surrogates that stand for several values; to be empty.

    entities hold each original, or in its place a digest of its canonical form, named value.
    """
    entities = replaced.select(F.explode("entities").alias("e")).select("e.*")
    value = F.col("value") if "value" in entities.columns else canonical(F.col("kind"), F.col("original"))
    pairs = entities.select("kind", value.alias("value"), canonical(F.col("kind"), F.col("surrogate")).alias("surrogate")).distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n_values")).filter("n_values > 1")
