"""Normal forms for search: Unicode composition, nasals, vowel length, white space, punctuation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .script import detect_script, has_mixed_scripts, is_blank, is_devanagari, is_iast, script_stats, strip
from .translit import devanagari_to_slp1, final_h, hk_to_slp1, iast_to_slp1, loose_roman, to_slp1

# Each class of consonants with the nasal that an anusvara before it stands for, in the order in which they are applied.
NASALS = (("N", "kKgG"), ("Y", "cCjJ"), ("R", "wWqQ"), ("n", "tTdD"), ("m", "pPbB"), ("[nRYNm]", "Szsh"), ("n", "kKgG"))
# What composition may change: all but Latin-1, Latin Extended-A and Additional, general punctuation, and Devanagari without nuktas, accents and what they compose. None of these changes, moves or joins with another of them; a test tries all pairs.
STABLE = r"\x{0000}-\x{017F}\x{0900}-\x{093B}\x{093D}-\x{0950}\x{0955}-\x{0957}\x{0960}-\x{097F}\x{1E00}-\x{1EFF}\x{2010}-\x{2027}"
UNSTABLE = rf"[\x{{0080}}-\x{{10FFFF}}&&[^{STABLE}]]"
LONG, SHORT = "AIUFX", "aiufx"


@F.pandas_udf(StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFC")


def nfc(text: Column) -> Column:
    """Unicode composition. Spark has no built-in; a text of characters that composition leaves alone whatever stands beside them doesn't leave the JVM."""
    # the test is in the function's input alone, where it is made once, however often the result is named
    return F.coalesce(_compose(F.when(text.rlike(UNSTABLE), text)), text)


def anusvara(text: Column) -> Column:
    """NASALS in one pass: no nasal is what another stands before, and none stands before M, so no rule sees another's output."""
    before = {n: "".join(b for nasals, b in NASALS if n in nasals) for nasals, _ in NASALS[:5] for n in nasals}
    each = "|".join(f"(?<={n})[{b}]" for n, b in before.items())
    return F.regexp_replace(text, f"[{''.join(before)}](?={each})", "M")


def fold_vowels(text: Column) -> Column:
    return F.translate(text, LONG, SHORT)


def clean_text(text: Column) -> Column:
    """One kind of line break, single spaces, at most one blank line, no white space around lines or the text."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t](?:[ \t]+|(?<=\t))", " ")
    text = F.regexp_replace(text, r"\n\s*\n\s*\n+", "\n\n")
    return strip(F.array_join(F.transform(F.split(text, "\n", -1), strip), "\n"))


def remove_punctuation(text: Column, keep_dandas: bool = True) -> Column:
    """Keeps letters, numbers, underscores, white space (and dandas and bars). Combining marks go too."""
    return F.regexp_replace(text, "[^\\p{L}\\p{N}_\\s" + ("।॥|" if keep_dandas else "") + "]", "")


def preprocess(text: Column, for_indexing: bool = True, nasals: bool = True, compose: bool = True) -> Column:
    """The search form: composed, SLP1, nasals as anusvara and vowels short (for_indexing), clean; blank and null: ''."""
    t = nfc(text) if compose else text

    # each script's test is named once; the loose spelling is read with final visargas before and after its long vowels
    loose = hk_to_slp1(final_h(loose_roman(final_h(t))))
    out = F.when(is_devanagari(t), devanagari_to_slp1(t)).when(is_iast(t), iast_to_slp1(t)).otherwise(loose)
    if for_indexing:
        out = fold_vowels(anusvara(out) if nasals else out)
    return F.when(is_blank(text), "").otherwise(clean_text(out))


def process(text: Column, nasals: bool = True, script: str | None = None) -> Column:
    """Struct of original, script ('unknown' if blank), slp1, mixed flag and stats (of the text as it is). script: taken instead of the detected one."""
    t = nfc(text)
    found = F.lit(script) if script else detect_script(t)
    if script:
        form = clean_text(fold_vowels(anusvara(to_slp1(final_h(t) if script == "loose_roman" else t, found)) if nasals else to_slp1(final_h(t) if script == "loose_roman" else t, found)))
        form = F.when(is_blank(text), "").otherwise(form)
    else:
        form = preprocess(text, nasals=nasals)
    return F.struct(text.alias("original"), F.when(is_blank(text), "unknown").otherwise(found).alias("script"), form.alias("slp1"), has_mixed_scripts(text).alias("is_mixed_script"), script_stats(text).alias("stats"))


def equivalent(a: Column, b: Column, folded: bool = True) -> Column:
    """Same search form; not folded: same SLP1."""
    return preprocess(a).eqNullSafe(preprocess(b)) if folded else to_slp1(a).eqNullSafe(to_slp1(b))
