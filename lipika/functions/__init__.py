"""Scripts, transliteration and normal forms: Column -> Column."""

from .normalize import anusvara, clean_text, equivalent, fold_vowels, nfc, preprocess, process, remove_punctuation
from .script import detect_script, has_mixed_scripts, is_devanagari, is_iast, script_stats
from .translit import final_h, from_slp1, loose_roman, slp1_to_devanagari, slp1_to_iast, to_slp1

__all__ = ["anusvara", "clean_text", "detect_script", "equivalent", "final_h", "fold_vowels", "from_slp1", "has_mixed_scripts", "is_devanagari", "is_iast", "loose_roman", "nfc", "preprocess", "process", "remove_punctuation", "script_stats", "slp1_to_devanagari", "slp1_to_iast", "to_slp1"]
