"""Script detection: native expressions over a text column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters of the Roman scholarly transliteration beyond ASCII.
DIACRITICS = "āīūṛṝḷḹṃḥṅñṭḍṇśṣĀĪŪṚṜḶḸṂḤṄÑṬḌṆŚṢ"
#: A class of these that looks at ranges first: most characters are in none, and a class of single letters beyond Latin-1 tries one after the other.
DIACRITIC = rf"[\x{{00D1}}\x{{00F1}}\x{{0100}}-\x{{016B}}\x{{1E00}}-\x{{1E7F}}&&[{DIACRITICS}]]"
DEVANAGARI = r"\x{0900}-\x{097F}"
OTHER_LETTERS = rf"\p{{L}}&&[^{DEVANAGARI}]"
SPACE = r"[\s\x{0085}\x{001C}-\x{001F}\p{Z}]"
#: The same, one by one.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def count_of(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("bigint")


def is_blank(text: Column) -> Column:
    """Null, or nothing but white space."""
    return ~F.coalesce(text.rlike(f"[^{SPACE[1:]}"), F.lit(False))


def strip(text: Column) -> Column:
    """Without white space (Unicode) at either end. Only the ends are compared with its characters; an expression would try its classes at every place."""
    return F.btrim(text, F.lit(SPACES))


def beyond_ascii(text: Column) -> Column:
    """A character beyond ASCII, told from the sizes alone; null for null."""
    return F.octet_length(text) != F.length(text)


def ranges(chars: str) -> str:
    """What stands between brackets for a class of these characters, by runs of neighbours."""
    runs: list[list[int]] = []
    for x in sorted({ord(c) for c in chars}):
        if runs and x == runs[-1][1] + 1:
            runs[-1][1] = x
        else:
            runs.append([x, x])
    return "".join(rf"\x{{{a:04X}}}" if a == z else rf"\x{{{a:04X}}}-\x{{{z:04X}}}" for a, z in runs)


def chars_in(text: Column, chars: str) -> Column:
    """How many characters of a class (what stands between brackets) there are; null has none. Whole runs are taken out at once, so no match is an object of its own."""
    return F.coalesce(F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", "")), F.lit(0)).cast("bigint")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x evaluated once, wherever body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(items: Column, first: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str, chunk: int = 256) -> Column:
    """Struct of state and out: a state carried over an array's items, and what was given out on the way.

    step(state, item) is the next state (of first's type) and an element (of type kind) to give out, null for none. An array grows by being copied, so elements are gathered in chunks of items and these are put together once: the work is linear in the items. Null items give null.
    """
    none, nones = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(a: Column, x: Column) -> Column:
        state, out = step(a["state"], x)
        return F.struct(state.alias("state"), let(out, lambda o: F.when(o.isNull(), a["out"]).otherwise(F.array_append(a["out"], o))).alias("out"))

    def over(all_: Column) -> Column:
        def some(a: Column, i: Column) -> Column:
            own = F.aggregate(F.slice(all_, i * chunk + 1, chunk), F.struct(a["state"].alias("state"), none.alias("out")), one)
            return let(own, lambda r: F.struct(r["state"].alias("state"), F.array_append(a["out"], r["out"]).alias("out")))

        n = F.size(all_)
        chunks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(chunks, F.struct(first.alias("state"), nones.alias("out")), some, lambda a: F.struct(a["state"].alias("state"), F.flatten(a["out"]).alias("out")))

    return F.when(items.isNotNull(), let(items, over))


def devanagari_count(text: Column) -> Column:
    return chars_in(text, DEVANAGARI)


def other_letters(text: Column) -> Column:
    return chars_in(text, OTHER_LETTERS)


def is_devanagari(text: Column, majority: float = 0.5) -> Column:
    """More than majority of the letters are in the block (its signs and digits count); false without letters or for null."""
    d = devanagari_count(text)
    return F.coalesce(beyond_ascii(text) & text.rlike(f"[{DEVANAGARI}]"), F.lit(False)) & (d / (d + other_letters(text)) > majority)


def is_iast(text: Column) -> Column:
    return F.coalesce(beyond_ascii(text) & text.rlike(DIACRITIC), F.lit(False))


def has_mixed_scripts(text: Column) -> Column:
    """A character of the block, and a letter outside it."""
    return F.coalesce(text.rlike(f"[{DEVANAGARI}]") & text.rlike(f"[{OTHER_LETTERS}]"), F.lit(False))


def detect_script(text: Column) -> Column:
    """devanagari, iast or loose_roman; blank and null: loose_roman."""
    return F.when(is_devanagari(text), "devanagari").when(is_iast(text), "iast").otherwise("loose_roman")


def script_stats(text: Column) -> Column:
    """Struct of disjoint counts (the block, diacritics, other letters, the rest but white space), script and mixed flag. Each count is one pass, and script and flag follow from the counts."""
    counts = F.struct(
        F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("total_chars"),
        devanagari_count(text).alias("devanagari_chars"),
        F.when(text.rlike(r"[^\x00-\x7F]"), chars_in(text, DIACRITIC[1:-1])).otherwise(F.lit(0).cast("bigint")).alias("iast_chars"),
        other_letters(text).alias("letters"),
        chars_in(text, f"^\\p{{L}}\\s{DEVANAGARI}\\x{{0085}}\\x{{001C}}-\\x{{001F}}\\p{{Z}}").alias("other_chars"),
    )

    def judged(c: Column) -> Column:
        d, i, other = c["devanagari_chars"], c["iast_chars"], c["letters"]
        script = F.when((d > 0) & (d / (d + other) > 0.5), "devanagari").when(i > 0, "iast").otherwise("loose_roman")
        return F.struct(c["total_chars"].alias("total_chars"), d.alias("devanagari_chars"), i.alias("iast_chars"), (other - i).alias("roman_chars"), c["other_chars"].alias("other_chars"), script.alias("script_type"), ((d > 0) & (other > 0)).alias("is_mixed"))

    return let(counts, judged)
