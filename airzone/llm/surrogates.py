"""Personal data replaced by keyed surrogates of the same type and format, without collisions.

Entities are found by patterns and reduced to a canonical form, so spellings of one entity share a surrogate in every
document. A surrogate is read off a keyed digest of kind, canonical form and attempt number. All entities of the
corpus are compared as a distributed table: where two share a surrogate, or a surrogate is itself an entity of the corpus,
all but one take the next attempt. Documents without entities are never shuffled. All of it is column expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from airzone.llm.common import let
from airzone.sources.tables import stage

#: Titles that come before a person's name, by gender; and name syllables by script.
MALE, FEMALE, OTHER = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин"), ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа"), ("Dr", "Prof")
SYLLABLES = {"latin": ("ba", "de", "fi", "go", "ku", "la", "me", "ni", "ro", "su", "ta", "ve", "wi", "yo", "za", "he"),
             "cyrillic": ("ба", "де", "фи", "го", "ку", "ла", "ме", "ни", "ро", "су", "та", "ве", "ми", "до", "за", "не")}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = "|".join((*MALE, *FEMALE, *OTHER))
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}",
    "secret": r'(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<=token = ")[0-9A-Za-z]{16,}|(?<=password=)[0-9A-Za-z]{8,}',
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ -]?\(?\d{2,4}\)?(?:[ -]?\d{2,4}){2,3}?(?!\d)",
    "card": r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)",
    "person": rf"(?<!\p{{L}})(?:{_TITLE})\.? \p{{Lu}}\p{{Ll}}++(?: \p{{Lu}}\p{{Ll}}++)?",
}
#: Every pattern; secrets, which only their context tells from other runs of digits, are a group of their own.
ANY = "|".join(f"({p})" if name == "secret" else p for name, p in PATTERNS.items())
SECRET_HINT = 'AKIA|token = "|password='
#: No entity is without one of these.
HINT = rf"[0-9@]|{SECRET_HINT}|(?:{_TITLE})\.? \p{{Lu}}"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def matches(text: Column) -> Column:
    """Every match of a pattern, in order, after "!" if it is a secret and "-" if not; an array without elements for most texts, after one cheap scan."""
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(0))
    secrets = F.when(text.rlike(SECRET_HINT), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(2))).otherwise(none)
    return F.when(text.rlike(HINT), F.zip_with(found, secrets, lambda hit, secret: F.concat(F.when(secret != "", "!").otherwise("-"), hit))).otherwise(none)


def surface_of(hit: Column) -> Column:
    return F.substring(hit, F.lit(2), F.length(hit))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def kind_of(hit: Column) -> Column:
    """Type of a match; null for a run of digits that is neither a secret nor a card number."""
    surface = surface_of(hit)
    whole = lambda p: surface.rlike(f"^(?:{PATTERNS[p]})$")
    return (F.when(hit.startswith("!"), "secret").when(whole("email"), "email").when(whole("ip"), "ip").when(surface.rlike(r"^\+"), "phone")
            .when(surface.rlike(r"^[\d -]+$"), F.when(F.call_function("luhn_check", _digits(surface)), "card"))
            .when(surface.rlike(rf"^(?:{_TITLE})\.? "), "person"))


def canonical(kind: Column, surface: Column) -> Column:
    name = F.lower(F.regexp_replace(surface, rf"^(?:{_TITLE})\.? ", ""))
    gender = (F.when(surface.rlike(rf"^(?:{'|'.join(MALE)})\.? "), "m").when(surface.rlike(rf"^(?:{'|'.join(FEMALE)})\.? "), "f").otherwise("x"))
    return (F.when(kind == "email", F.lower(surface)).when(kind == "phone", F.concat(F.lit("+"), _digits(surface)))
            .when(kind == "card", _digits(surface)).when(kind == "person", F.concat(gender, F.lit(":"), name)).otherwise(surface))


def _luhn_digit(body: Column) -> Column:
    """The digit that makes ``body`` and it a valid card number."""
    doubled = lambda v: F.when(v * 2 > 9, v * 2 - 9).otherwise(v * 2)
    total = F.aggregate(F.transform(F.split(F.reverse(body), ""), lambda d, i: F.when(i % 2 == 0, doubled(d.cast("int"))).otherwise(d.cast("int"))),
                        F.lit(0), lambda a, b: a + b)
    return ((10 - total % 10) % 10).cast("string")


def _redrawn(value: Column, numbers, hexadecimal: Column | None = None) -> Column:
    """Every ASCII letter and digit drawn anew from its own class, other characters kept."""
    def drawn(ch: Column, i: Column) -> Column:
        n = numbers(i)
        low = F.when(hexadecimal, F.substring(F.lit("abcdef"), (n % 6 + 1).cast("int"), F.lit(1))) if hexadecimal is not None else None
        lower = F.substring(F.lit(LETTERS), (n % 26 + 1).cast("int"), F.lit(1))
        return (F.when(ch.rlike("[0-9]"), (n % 10).cast("string")).when(ch.rlike("[a-z]"), F.coalesce(low, lower) if low is not None else lower)
                .when(ch.rlike("[A-Z]"), F.upper(lower)).otherwise(ch))
    return F.array_join(F.transform(F.split(value, ""), drawn), "")


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical surrogate of an entity: two hexadecimal digits of a keyed digest for each of its characters.

    From the third attempt on mail names get a letter and persons a syllable more each time, from the sixth on phone numbers a digit
    and secrets a character, so no number of entities uses up the surrogates. IP addresses, card numbers and AKIA keys keep their length.
    """
    seed = F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.length(canon) + attempt) / 64).cast("int") + 1), lambda b: F.sha2(F.concat_ws("|", seed, b.cast("string")), 512))

    longer, late = (F.greatest(attempt - n, F.lit(0)).cast("int") for n in (1, 4))

    def made(stream: Column) -> Column:
        number = lambda i: F.conv(F.substring(stream, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
        more = lambda ch, n, hexadecimal=None: _redrawn(F.repeat(ch, n), lambda i: number(F.length(canon) + i), hexadecimal)
        local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
        labels = F.split(domain, r"\.")
        host = F.array_join(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))), ".")
        email = F.concat(_redrawn(local, number), more(F.lit("a"), longer), F.lit("@"), _redrawn(host, lambda i: number(F.length(local) + 1 + i)), F.when(host != "", ".").otherwise(""),
                         F.lit("example."), F.element_at(labels, -1))
        ip = F.concat_ws(".", *[(1 + number(F.lit(i)) % 254).cast("string") for i in range(4)])
        phone = F.concat(F.left(canon, F.when(canon.rlike(r"^\+[17]"), 2).otherwise(3)),
                         _redrawn(F.substring(canon, F.when(canon.rlike(r"^\+[17]"), 3).otherwise(4), F.length(canon)), number), more(F.lit("0"), late))
        body = F.concat(F.left(canon, F.lit(1)), _redrawn(F.substring(canon, F.lit(2), F.length(canon) - 2), number))
        card = F.concat(body, _luhn_digit(body))
        low_hex = canon.rlike("^[0-9a-f]+$")
        secret = F.concat(F.when(canon.startswith("AKIA"), "AKIA").otherwise(""), _redrawn(F.regexp_replace(canon, "^AKIA", ""), number, low_hex),
                          more(F.right(canon, F.lit(1)), F.when(canon.rlike("^AKIA[0-9A-Z]{16}$"), 0).otherwise(late), low_hex))
        script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
        gender, names = F.substring(canon, 1, 1), F.split(F.substring(canon, F.lit(3), F.length(canon)), " ")

        def named(place: Column) -> Column:
            parts = [F.when(script == s, F.array_join(F.transform(F.sequence(F.lit(0), longer + 2), lambda j: F.element_at(
                F.array(*map(F.lit, syllables)), number(place * (longer + 3) + j) % len(syllables) + 1)), "")) for s, syllables in SYLLABLES.items()]
            ending = F.when(place == F.size(names) - 1, F.when(script == "cyrillic", F.when(gender == "f", "ова").otherwise("ов")).otherwise("n")).otherwise(
                F.when(gender == "f", F.when(script == "cyrillic", "на").otherwise("na")).otherwise(F.when(script == "cyrillic", "р").otherwise("r")))
            return F.concat(F.coalesce(*parts), ending)

        person = F.concat(gender, F.lit(":"), F.array_join(F.transform(F.sequence(F.lit(0), F.size(names) - 1), named), " "))
        return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card)
                .when(kind == "person", person).otherwise(secret))

    return let(F.array_join(blocks, ""), made)


def rendered(kind: Column, surface: Column, made: Column) -> Column:
    """A canonical surrogate in the format of one spelling: its separators, its capitals, its title."""
    spelled = F.array_join(F.transform(F.split(surface, ""), lambda ch, i: F.when(ch.rlike("[0-9]"), F.substring(
        _digits(made), F.length(_digits(F.left(surface, i + 1))), F.lit(1))).otherwise(ch)), "")
    spelled = F.concat(spelled, F.substring(_digits(made), F.length(_digits(surface)) + 1, F.length(made)))
    cased = F.when(surface == F.upper(surface), F.upper(made)).otherwise(made)
    title = F.regexp_extract(surface, rf"^((?:{_TITLE})\.? )", 1)
    name = F.initcap(F.substring(made, F.lit(3), F.length(made)))
    return (F.when(kind.isin("phone", "card"), spelled).when(kind == "email", cased).when(kind == "person", F.concat(title, name)).otherwise(made))


def distinct_surrogates(entities: DataFrame, key: str, most: int = 30) -> DataFrame:
    """(kind, canon, made) of every distinct (kind, canon), each ``made`` unique in its kind and no entity of the corpus."""
    named = stage(entities.select("kind", "canon").distinct().withColumn("attempt", F.lit(0)), "entities")
    taken = named.select("kind", F.col("canon").alias("made"), F.lit(True).alias("real"))
    for _ in range(most):
        made = stage(named.withColumn("made", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key)), "surrogates")
        owners = made.groupBy("kind", "made").agg(F.min(F.struct("attempt", "canon")).alias("owner"), F.count(F.lit(1)).alias("n"))
        clash = owners.join(taken, ["kind", "made"], "left").where("n > 1 OR real").select("kind", "made", F.when(F.col("real"), F.lit(None)).otherwise(F.col("owner.canon")).alias("stays"))
        clash = stage(clash, "clashes")
        if clash.isEmpty():
            return made.select("kind", "canon", "made")
        named = (made.join(clash.withColumn("hit", F.lit(True)), ["kind", "made"], "left")
                 .select("kind", "canon", (F.col("attempt") + F.when(F.col("hit") & ~F.col("canon").eqNullSafe(F.col("stays")), 1).otherwise(0)).alias("attempt")))
    raise RuntimeError(f"surrogates still collide after {most} attempts")


def surrogated(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """``docs`` with surrogates in ``text_col``, and the number of replacements as ``count_col``.

    E-mail addresses, IP addresses, phone numbers with a country code, card numbers that pass the Luhn test, keys and
    passwords in assignments, and persons behind a title are replaced; other text stays as it is. One entity
    has one surrogate in all documents, spelled in the format found (separators, capitals, title, gender, script);
    different entities never share one.

    Null text stays null with 0 replacements, repeated rows stay repeated, other columns (also such named like ours) pass
    unchanged (the count's name then gets underscores behind it until it is free), an empty table stays empty. Texts with entities meet their surrogates by a digest of the text, so ids play no part.
    """
    while count_col in docs.columns:
        count_col += "_"
    row = docs.select(F.struct("*").alias("r")).withColumn("t", F.col(f"r.`{text_col}`")).withColumn("m", matches(F.coalesce("t", F.lit(""))))
    clean = row.where("size(m) = 0").select("r", F.lit(0).alias("n"))
    dirty = row.where("size(m) > 0").withColumn("k", F.md5("t"))
    hits = stage(dirty.select("k", F.explode(F.array_distinct("m")).alias("hit")).distinct()
                 .withColumn("kind", kind_of(F.col("hit"))).where("kind IS NOT NULL").withColumn("surface", surface_of(F.col("hit")))
                 .withColumn("canon", canonical(F.col("kind"), F.col("surface"))), "hits")
    made = distinct_surrogates(hits, key)
    maps = (hits.join(made, ["kind", "canon"]).select("k", F.struct("hit", rendered(F.col("kind"), F.col("surface"), F.col("made")).alias("s")).alias("e"))
            .groupBy("k").agg(F.map_from_entries(F.collect_list("e")).alias("of")))
    # split and regexp_extract_all find the same matches, so pieces and replacements alternate
    swapped = F.array_join(F.flatten(F.zip_with(F.split("t", f"({ANY})", -1), F.col("m"), lambda piece, hit: F.array(
        piece, F.coalesce(F.element_at(F.col("of"), hit), surface_of(hit), F.lit(""))))), "")
    replaced = dirty.join(maps, "k", "left").select(
        F.col("r").withField(f"`{text_col}`", F.when(F.col("of").isNull(), F.col("t")).otherwise(swapped)).alias("r"),
        F.when(F.col("of").isNull(), F.lit(0)).otherwise(F.size(F.filter("m", lambda x: F.map_contains_key("of", x)))).alias("n"))
    return clean.unionByName(replaced).select("r.*", F.col("n").alias(count_col))
