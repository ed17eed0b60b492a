"""Text scalars: normalization, document keys and number fingerprints.

All are native Catalyst expressions (no Python UDF), so they stay inside
whole-stage codegen and run where the scan runs.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's ``\s`` is Unicode-aware (it also covers the information separators
# U+001C..U+001F). Spelled out as a class: Java's Unicode mode is much slower.
WHITESPACE_CLASS = (r"[\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
WHITESPACE_RUN = WHITESPACE_CLASS + "+"
#: The characters of that class.
WHITESPACE_CHARS = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"
# Numbers inside documents: 1,234.56 / 1234.56 / 42 (fixed value).
NUMBER_PATTERN = r"\d[\d,]*(?:\.\d+)?"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use) -> Column:
    """``use(value)``, with the value named by a lambda's argument: it is computed once for all its uses, also inside
    lambdas, where Spark shares no common expressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Beyond these characters (the first of which lower-casing settles, but for the micro sign) a text is looked at closely.
UNSETTLED = r"[^\x{0}-\x{b4}\x{b6}-\x{148}]"


@cache
def _folds() -> tuple[str, str, tuple[tuple[str, str], ...], str]:
    """What full case folding changes in any text, from the language's own folding: characters and those that one of them
    becomes, characters that become several, and a class of few ranges that holds all that lower-casing leaves."""
    folds = {ch: ch.casefold() for code in range(0x110000) if not 0xD800 <= code < 0xE000 and (ch := chr(code)).casefold() != ch and ch != "ß"}
    single = [ch for ch, f in folds.items() if len(f) == 1]
    # after lower-casing only these are left, besides capitals too new for the lower-casing, which are above U+2C00
    left = [ord(ch) for ch in folds if ch.lower() == ch or ord(ch) >= 0x2C00]
    ranges: list[list[int]] = []
    for code in sorted(left):  # few wide ranges: a class of many is slow to look for
        if ranges and code - ranges[-1][1] <= 64:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    letters = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)
    return "".join(single), "".join(folds[ch] for ch in single), tuple((ch, f) for ch, f in folds.items() if len(f) > 1), f"[{letters}]"


def casefold(c) -> Column:
    """Full Unicode case folding.

    Lower case and the sharp s settle nearly every text. What they leave (a final sigma, ligatures, letters that fold to
    others or to several) is looked for only in texts that are not plain ASCII, and mapped where it is found.
    """
    single, folded, several, letters = _folds()
    pairs = F.array(*[F.array(F.lit(ch), F.lit(f)) for ch, f in several])

    def rest(low: Column) -> Column:
        full = F.aggregate(pairs, F.translate(low, single, folded), lambda text, pair: F.replace(text, pair[0], pair[1]))
        return F.when((F.octet_length(low) != F.char_length(low)) & low.rlike(UNSETTLED) & low.rlike(letters), full).otherwise(low)

    return once(F.replace(F.lower(_col(c)), F.lit("ß"), F.lit("ss")), rest)


def collapse_whitespace(c) -> Column:
    """Whitespace runs -> one space, then strip the ends."""
    return F.trim(F.regexp_replace(_col(c), WHITESPACE_RUN, " "))


def normalize_text(c) -> Column:
    """strip -> collapse whitespace runs -> casefold."""
    return casefold(collapse_whitespace(c))


def exact_key(c) -> Column:
    """SHA-256 hex digest of the normalized text."""
    return F.sha2(normalize_text(c), 256)


def numeric_tokens(c) -> Column:
    """Every number in the text, commas dropped, printed with at most four
    decimals (trailing zeros and dot stripped), sorted as strings, duplicates
    kept."""
    raw = F.regexp_extract_all(_col(c), F.lit(NUMBER_PATTERN), 0)
    printed = F.transform(
        raw,
        lambda t: F.regexp_replace(
            F.replace(t, F.lit(","), F.lit("")).try_cast("double")
            .try_cast("decimal(38,4)").cast("string"),
            r"\.?0*$", ""),
    )
    return F.array_sort(F.filter(printed, lambda t: t.isNotNull()))


def numeric_fingerprint(c) -> Column:
    """First 32 hex chars of SHA-256 over the pipe-joined number tokens."""
    return F.substring(F.sha2(F.array_join(numeric_tokens(c), "|"), 256), 1, 32)
