"""Surrogates for personal data (DataFrame and SQL functions only).

Detected entities are replaced by keyed surrogates of the same type and format. An entity's canonical form (case
and separators removed) decides its surrogate, so every mention of it, in any writing, gets the same one; a check
over the distinct entities keeps different entities apart and surrogates away from real values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import masked, quoted, stray_columns, write_table

#: What an entity looks like, by type; in a text the first type that fits is taken.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.)+\p{L}{2,24}(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![\p{L}\p{N}])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "card": r"(?<![\d+])(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}|\d{4}[ -]?\d{6}[ -]?\d{5})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?:(?<![\p{L}\p{N}])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "name": r"(?<![\p{L}\p{N}])(?:Mr|MR|Mrs|MRS|Ms|MS|Miss|MISS|Dr|DR|Prof|PROF|Herr|HERR|Frau|FRAU|Mme|MME|Mlle|MLLE|Sr|SR|Sra|SRA|Srta|SRTA|г-н|г-жа)\.? \p{Lu}\p{L}++(?:[ -]\p{Lu}\p{L}++){0,2}",
}
#: Titles that tell a gender, and first names to choose from, by script and gender.
TITLES = {"m": "Mr Herr Sr г-н".split(), "f": "Mrs Ms Miss Frau Mme Mlle Sra Srta г-жа".split()}
FIRST = {"latin": {"m": "adam bruno carlos daniel erik felix hugo ivan jonas karl leo martin".split(),
                   "f": "alice bella clara diana elena fiona greta helena iris julia laura marta".split()},
         "cyrillic": {"m": "антон борис виктор глеб денис егор иван кирилл лев максим олег павел".split(),
                      "f": "алла вера галина дарья елена жанна ирина кира лидия мария нина ольга".split()}}
LAST = {"latin": "ber dor fen gal hal kor lin mar nor pel ros sal tan ver wil zan".split(),
        "cyrillic": "бер вол гор дан зор кал лев мир нов пет рос сав тар уль фед чер".split()}
EVERY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def kind_of(surface: Column) -> Column:
    """Type of a found entity: the first pattern that matches it whole."""
    out = F.lit("name")
    for kind, pattern in reversed(list(PATTERNS.items())[:-1]):
        out = F.when(surface.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def canonical(kind: Column, surface: Column) -> Column:
    """What mentions of one entity share: lower case, no separators (dots and the like stay in e-mails and addresses)."""
    low = F.lower(surface)
    country = F.regexp_extract(surface, r"^\+(\d{1,3})", 1)
    return (F.when(kind.isin("email", "ip", "secret"), low)
            .when((kind == "phone") & (country != ""), F.concat(F.lit("+"), F.regexp_replace(surface, r"\D", "")))
            .when(kind == "name", F.regexp_replace(low, r"\.? +", " "))
            .otherwise(F.regexp_replace(low, r"[^\p{L}\p{N}]", "")))


def _pick(digest: Column, at: Column | int, modulus: Column | int) -> Column:
    """A number below ``modulus`` from the ``at``-th of the digest's 16-bit groups, which repeat."""
    start = (F.lit(at) % 30) * 4 + 1
    return F.pmod(F.conv(F.substr(digest, start.cast("int"), F.lit(4)), 16, 10).cast("long") + F.lit(at) * 7919, F.lit(modulus))


def _char(letters: str, index: Column) -> Column:
    return F.substr(F.lit(letters), (index + 1).cast("int"), F.lit(1))


def _shuffled(value: Column, digest: Column, keep: Column) -> Column:
    """Every digit replaced by a digit and every letter by a letter of its script, from position ``keep`` (0-based) on."""
    def one(c: Column, i: Column) -> Column:
        cyrillic, digit = c.rlike(r"\p{IsCyrillic}"), c.rlike(r"\d")
        return (F.when(i < keep, c).when(digit, _char("0123456789", _pick(digest, i, 10)))
                .when(cyrillic, _char("абвгдежзиклмнопрстуфхцчшэюя", _pick(digest, i, 27)))
                .when(c.rlike(r"\p{L}"), _char("abcdefghijklmnopqrstuvwxyz", _pick(digest, i, 26))).otherwise(c))

    return F.array_join(F.transform(F.split(value, ""), one), "")


def luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a digit string."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.when(c.cast("int") >= 5, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(values, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10


def _name(value: Column, digest: Column, attempt: Column) -> Column:
    """Title kept; first and last names of the title's gender (either, if it tells none) and the name's script."""
    title = F.substring_index(value, " ", 1)
    parts = F.size(F.split(value, " ")) - 1

    def of(script: str) -> Column:
        both = FIRST[script]["m"] + FIRST[script]["f"]
        firsts = F.when(title.isin(*[t.lower() for t in TITLES["m"]]), F.array(*map(F.lit, FIRST[script]["m"])))
        firsts = firsts.when(title.isin(*[t.lower() for t in TITLES["f"]]), F.array(*map(F.lit, FIRST[script]["f"]))).otherwise(F.array(*map(F.lit, both)))
        first = F.get(firsts, _pick(digest, 0, F.size(firsts)).cast("int"))
        last = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3) + F.floor(attempt / 4).cast("int")),
                                        lambda i: F.get(F.array(*map(F.lit, LAST[script])), _pick(digest, i, 16).cast("int"))), "")
        return F.when(parts > 1, F.concat(title, F.lit(" "), first, F.lit(" "), last)).otherwise(F.concat(title, F.lit(" "), last))

    return F.when(value.rlike(r"\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))


def surrogate(kind: Column, value: Column, key: str, attempt: Column) -> Column:
    """The ``attempt``-th keyed surrogate of a canonical value."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string")), 512)
    octets = [_pick(digest, i, 254 - 30 * (i == 0)) + 1 for i in range(4)]
    country = F.length(F.regexp_extract(value, r"^\+(1|7|\d{2})", 0))
    plain = _shuffled(value, digest, F.when(kind == "phone", country).when(kind == "iban", F.lit(2)).otherwise(F.lit(0)))
    body = F.substr(plain, F.lit(1), F.length(value) - 1)
    card = F.concat(body, ((10 - luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))
    ending = F.regexp_extract(value, r"\.\p{L}+$", 0)
    mail = F.concat(F.substr(plain, F.lit(1), F.length(value) - F.length(ending)), ending)
    # hexadecimal secrets stay hexadecimal: 64-bit groups of further digests
    longer = F.concat(digest, F.sha2(F.concat(digest, value), 256))
    return (F.when(kind == "ip", F.concat_ws(".", *[o.cast("string") for o in octets]))
            .when(kind == "card", F.when(luhn(value) == 0, card).otherwise(plain))
            .when(kind == "email", mail).when(kind == "secret", F.substr(longer, F.lit(1), F.length(value)))
            .when(kind == "name", _name(value, digest, attempt)).otherwise(plain))


def written(kind: Column, surface: Column, value: Column) -> Column:
    """A surrogate in the writing of a mention: its separators and, letter by letter or word by word, its case."""
    chars = F.split(surface, "")
    index = F.transform(chars, lambda c, i: F.length(F.regexp_replace(F.substr(surface, F.lit(1), i + 1), r"[^\p{L}\p{N}]", "")))
    bare = F.regexp_replace(value, r"[^\p{L}\p{N}]", "")
    same = F.array_join(F.zip_with(chars, index, lambda c, n: F.when(~c.rlike(r"[\p{L}\p{N}]"), c).otherwise(
        # a digit may stand where a letter comes (secrets): the mention's own case decides
        F.when(F.when(c.rlike(r"\p{L}"), c == F.upper(c)).otherwise(surface == F.upper(surface)), F.upper(F.substr(bare, n, F.lit(1)))).otherwise(F.substr(bare, n, F.lit(1))))), "")
    title = F.substring_index(surface, " ", 1)
    rest = F.substr(value, F.length(F.substring_index(value, " ", 1)) + 1, F.length(value))
    shout = F.substr(surface, F.length(title) + 1, F.length(surface))
    name = F.concat(title, F.when(shout == F.upper(shout), F.upper(rest)).otherwise(F.initcap(rest)))
    return F.when(kind == "name", name).when(kind == "ip", value).otherwise(same)


def assign(entities: DataFrame, key: str, max_attempts: int = 24) -> DataFrame:
    """(kind, value, surrogate) for distinct ``entities`` (kind, value): no two alike within a type, none a real value.

    In every round an open entity proposes its next surrogate; one proposed twice goes to the smallest value, one
    that is taken or is a real value to nobody. Raises if some are still open after ``max_attempts``.
    """
    real = entities.select("kind", F.col("value").alias("proposed"))
    pending, done = entities, None
    for attempt in range(max_attempts):
        offer = pending.withColumn("proposed", surrogate(F.col("kind"), F.col("value"), key, F.lit(attempt)))
        free = offer.join(real, ["kind", "proposed"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", F.col("surrogate").alias("proposed")), ["kind", "proposed"], "left_anti")
        won = free.groupBy("kind", "proposed").agg(F.min("value").alias("value"))
        got, _ = write_table(won.select("kind", "value", F.col("proposed").alias("surrogate")), "surrogates")
        done = got if done is None else done.unionByName(got)
        pending, _ = write_table(pending.join(got, ["kind", "value"], "left_anti"), "open-entities")
        if not pending.take(1):
            return done
    raise RuntimeError(f"entities without a distinct surrogate after {max_attempts} rounds")


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Replace personal data in every whole text.

    Types: e-mail and IP addresses, IBANs, card and social security numbers, phone numbers, hexadecimal secrets and
    names after a title. One entity has one surrogate in all documents; two entities of a type never share one. Formats
    are kept: length and separators (IP addresses: a valid address), case, script, the country code of a phone number
    and of an IBAN, the ending of a mail address, a card's check digit if it had a valid one, the title and its gender.

    Returns every row of ``docs`` with ``text`` replaced and ``n_entities`` (mentions replaced) added or replaced; other
    columns pass through. Null texts stay null, with 0 mentions; empty ones stay empty, very long ones are read whole. Rows that repeat an id are replaced alike; rows
    without id too, through their text. An empty table gives an empty result.
    """
    text = F.col(quoted(text_col))
    # a row is known by its id and text together, so copies of one text spread over their ids
    who = F.col(quoted(id_col)).cast("string")
    row_key = [F.xxhash64(who, text), F.xxhash64(text, F.lit("t"), who)]
    found = docs.select(row_key[0].alias("t1"), row_key[1].alias("t2"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(EVERY), 0))).alias("surface"))
    kinds = found.select("t1", "t2", "surface", kind_of(F.col("surface")).alias("kind"))
    mentions, _ = write_table(kinds.withColumn("value", canonical(F.col("kind"), F.col("surface"))), "mentions")
    chosen, _ = write_table(assign(mentions.select("kind", "value").distinct(), key), "entity-surrogates")
    texts = mentions.join(chosen, ["kind", "value"]).select("t1", "t2", "surface", written(F.col("kind"), F.col("surface"), F.col("surrogate")).alias("written"))
    # one map per row: its own mentions
    maps = texts.groupBy("t1", "t2").agg(F.map_from_entries(F.collect_set(F.struct("surface", "written"))).alias("__map"))

    through = stray_columns(docs, {text_col, "n_entities"})
    inside, outside = masked(docs, through)
    rows = docs.select(*inside, text.alias("__text"), row_key[0].alias("__t1"), row_key[1].alias("__t2"))
    joined = rows.join(maps.hint("shuffle_hash"), (F.col("__t1") == F.col("t1")) & (F.col("__t2") == F.col("t2")), "left")
    finds = F.regexp_extract_all("__text", F.lit(EVERY), 0)
    gaps = F.split("__text", EVERY, -1)
    swapped = F.array_join(F.flatten(F.zip_with(gaps, finds, lambda g, e: F.array(g, F.when(e.isNull(), "").otherwise(
        F.coalesce(F.try_element_at("__map", e), F.raise_error(F.lit("an entity without a surrogate")).cast("string")))))), "")
    here = F.col("__map").isNotNull()
    done = joined.select(*[f"__in{i}" for i in range(len(through))], F.when(here, swapped).otherwise(F.col("__text")).alias("__new"), F.when(here, F.size(finds)).otherwise(0).cast("long").alias("__n"))
    return done.select(*outside, F.col("__new").alias(text_col), F.col("__n").alias("n_entities"))
