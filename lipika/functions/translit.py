"""Transliteration between Devanagari, Roman scholarly spelling, ASCII spellings and the one-letter-a-phoneme code SLP1.

All native: regular expressions and translate(). Multi-letter phonemes go through private-use characters, longest first, so no rule sees another's output.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .script import is_blank, is_devanagari, is_iast, ranges

# The published schemes, in the order of the alphabet.
VOWELS = "अआइईउऊऋॠऌॡएऐओऔ"
VOWELS_SLP1 = "aAiIuUfFxXeEoO"
SIGNS = "ािीुूृॄॢॣेैोौ"
SIGNS_SLP1 = "AiIuUfFxXeEoO"
CONSONANTS = "कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसहळ"
CONSONANTS_SLP1 = "kKgGNcCjJYwWqQRtTdDnpPbBmyrlvSzshL"
MARKS = "ंःँऽ।॥०१२३४५६७८९"
MARKS_SLP1 = "MH~'.." + "0123456789"
VIRAMA = "्"
IAST_PAIRS = (("ai", "E"), ("au", "O"), ("kh", "K"), ("gh", "G"), ("ch", "C"), ("jh", "J"), ("ṭh", "W"), ("ḍh", "Q"), ("th", "T"), ("dh", "D"), ("ph", "P"), ("bh", "B"))
IAST_SINGLES = ("āīūṛṝḷḹṃḥṅñṭḍṇśṣĀĪŪṚṜḶḸṂḤṄÑṬḌṆŚṢ", "AIUfFxXMHNYwqRSzAIUfFxXMHNYwqRSz")
HK_GROUPS = (("lRR", "X"), ("lR", "x"), ("RR", "F"), ("kh", "K"), ("gh", "G"), ("ch", "C"), ("jh", "J"), ("Th", "W"), ("Dh", "Q"), ("th", "T"), ("dh", "D"), ("ph", "P"), ("bh", "B"), ("ai", "E"), ("au", "O"))
HK_SINGLES = ("RGJTDNzS", "fNYwqRSz")
LOOSE = (("aa", "A"), ("ee", "I"), ("oo", "U"), ("sh", "z"))
FINAL_H_AFTER = "aAiIuUeEoORLÁáÍíÚú"
FINAL_H_BEFORE = ".,;:!?।॥'\""
PRIVATE = 0xE000
MARKED = "\uFDD0"  # no character, so hardly a text has it


def loose_roman(text: Column) -> Column:
    """Everyday spellings of long vowels and of sh, replaced in order."""
    for a, b in LOOSE:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def final_h(text: Column) -> Column:
    """h after a vowel at a word's end is a visarga."""
    return F.regexp_replace(text, f"(?<=[{FINAL_H_AFTER}])h(?=\\s|$|[{FINAL_H_BEFORE}])", "H")


def devanagari_to_slp1(text: Column) -> Column:
    text = F.regexp_replace(text, f"([{ranges(CONSONANTS)}])(?![{ranges(SIGNS + VIRAMA)}])", "$1अ")
    text = F.replace(text, F.lit("॥"), F.lit(".."))
    marks, codes = MARKS.replace("॥", ""), MARKS_SLP1.replace("..", ".", 1)
    return F.translate(text, VOWELS + SIGNS + CONSONANTS + marks + VIRAMA, VOWELS_SLP1 + SIGNS_SLP1 + CONSONANTS_SLP1 + codes)


def iast_to_slp1(text: Column) -> Column:
    for a, b in IAST_PAIRS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.translate(text, *IAST_SINGLES)


def hk_to_slp1(text: Column) -> Column:
    places = "".join(chr(PRIVATE + i) for i in range(len(HK_GROUPS)))
    for (a, _), p in zip(HK_GROUPS, places, strict=True):
        text = F.replace(text, F.lit(a), F.lit(p))
    return F.translate(text, places + HK_SINGLES[0], "".join(b for _, b in HK_GROUPS) + HK_SINGLES[1])


def to_slp1(text: Column, script: Column | None = None) -> Column:
    """SLP1 of a text in the given or detected script; blank and null stay."""
    devanagari, iast = (is_devanagari(text), is_iast(text)) if script is None else (script == "devanagari", script == "iast")
    out = F.when(devanagari, devanagari_to_slp1(text)).when(iast, iast_to_slp1(text)).otherwise(hk_to_slp1(final_h(loose_roman(text))))
    return F.when(is_blank(text), text).otherwise(out)


def slp1_to_iast(text: Column) -> Column:
    wide = [("K", "kh"), ("G", "gh"), ("C", "ch"), ("J", "jh"), ("W", "ṭh"), ("Q", "ḍh"), ("T", "th"), ("D", "dh"), ("P", "ph"), ("B", "bh"), ("E", "ai"), ("O", "au")]
    single = ("AIUfFxXMHNYwqRSz", "āīūṛṝḷḹṃḥṅñṭḍṇśṣ")
    places = "".join(chr(PRIVATE + i) for i in range(len(wide)))
    text = F.translate(text, single[0] + "".join(a for a, _ in wide), single[1] + places)
    for (_, b), p in zip(wide, places, strict=True):
        text = F.replace(text, F.lit(p), F.lit(b))
    return text


def slp1_to_devanagari(text: Column) -> Column:
    """A consonant before a vowel takes its sign, before a none, else a virama; any other vowel is a letter of its own."""
    vowels = VOWELS_SLP1
    has_mark = F.contains(text, F.lit(MARKED))
    text = F.regexp_replace(text, f"([{CONSONANTS_SLP1}])(?![{vowels}])", f"$1{VIRAMA}")
    # one pass says which vowels follow a consonant; these are then replaced as they are
    slow, quick = text, F.regexp_replace(text, f"([{CONSONANTS_SLP1}])(?=[{vowels}])", f"$1{MARKED}")
    for v, sign in (("a", chr(PRIVATE)), *zip(SIGNS_SLP1, SIGNS, strict=True)):
        slow, quick = F.regexp_replace(slow, f"([{CONSONANTS_SLP1}]){v}", "$1" + sign), F.replace(quick, F.lit(MARKED + v), F.lit(sign))
    text = F.when(has_mark, slow).otherwise(quick)
    text = F.replace(F.replace(text, F.lit(".."), F.lit("॥")), F.lit("."), F.lit("।"))
    digits = "0123456789"
    return F.translate(text, CONSONANTS_SLP1 + vowels + "MH~'" + digits + chr(PRIVATE), CONSONANTS + VOWELS + "ंःँऽ" + "०१२३४५६७८९")


def from_slp1(text: Column, target: str = "devanagari") -> Column:
    return slp1_to_iast(text) if target == "iast" else slp1_to_devanagari(text)
