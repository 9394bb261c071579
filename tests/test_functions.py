import itertools
import random

import pytest
from pyspark.sql import functions as F

from lipika.functions import normalize as N
from lipika.functions import script as S
from lipika.functions import translit as X


def apply(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i long, t string").select("i", f(F.col("t")).alias("o")).orderBy("i").collect()
    return [r.o for r in rows]


@pytest.mark.parametrize(
    "f, pairs",
    [
        (N.preprocess, {"धर्मः": "DarmaH", "dharmaḥ": "DarmaH", "dharmah": "DarmaH", "संस्कृतम्": "saMskftam", "शंखनादः कः आसीत्?": "SaMKanadaH kaH asit?", "śaṅkhanādaḥ kaḥ āsīt?": "SaMKanadaH kaH asit?", "shankhanaadah kah aseet?": "SaMKanadaH kaH asit?", "कुरुक्षेत्र": "kurukzetra", "kurukṣetra": "kurukzetra", "kurukshetra": "kurukSetra", "": "", "  ": "", None: ""}),
        (N.anusvara, {"saNkara": "saMkara", "saNga": "saMga", "sankara": "saMkara", "saYcaya": "saMcaya", "maYju": "maMju", "santa": "saMta", "vanda": "vaMda", "sampanna": "saMpanna", "kambala": "kaMbala", "saMskfta": "saMskfta", None: None}),
        (N.fold_vowels, {"kAlIdAsaH": "kalidasaH"}),
        (X.final_h, {"dharmah": "dharmaH", "narah gacchati": "naraH gacchati", "saha": "saha", "path": "path", None: None}),
        (S.detect_script, {"धर्मक्षेत्रे": "devanagari", "dharmakṣetre": "iast", "dharmakshetre": "loose_roman", "": "loose_roman", "धर्म a": "devanagari", None: "loose_roman"}),
        (S.has_mixed_scripts, {"dharma धर्म": True, "धर्मक्षेत्रे": False, "dharma yoga": False, "धर्म α": True, None: False}),
        (N.clean_text, {"hello   world": "hello world", "  hello  ": "hello", "a\r\nb\rc": "a\nb\nc", "a\n \n \n\nb": "a\n\nb", None: None}),
        (N.remove_punctuation, {"धर्मः। x!": "धरम। x"}),
        (N.nfc, {"é": "é", "ascii": "ascii", None: None}),
        (X.slp1_to_devanagari, {"Darma": "धर्म", "rAmaH": "रामः", "kfzRa": "कृष्ण", "Esa": "ऐस", "saMskftam": "संस्कृतम्"}),
        (X.slp1_to_iast, {"kfzRaH": "kṛṣṇaḥ", "BAratI": "bhāratī"}),
    ],
)
def test_pairs(spark, f, pairs):
    assert apply(spark, f, list(pairs)) == list(pairs.values())


def test_round_trip(spark):
    words = ["धर्मक्षेत्रे", "कुरुक्षेत्रे", "रामायणम्", "गीता", "ऋषिः", "अहम्"]
    assert apply(spark, lambda t: X.slp1_to_devanagari(X.devanagari_to_slp1(t)), words) == words


def test_stats_are_disjoint(spark):
    s = apply(spark, S.script_stats, ["धर्म ā a1!", None])
    assert (s[0].devanagari_chars, s[0].iast_chars, s[0].roman_chars, s[0].other_chars) == (4, 1, 1, 2)
    assert s[1].total_chars == 0


def test_no_python_in_native_functions(spark):
    plan = spark.createDataFrame([("x",)], "t string").select(N.clean_text(X.to_slp1(F.col("t"))))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_equivalent(spark):
    d = spark.createDataFrame([("धर्मः", "dharmaḥ"), ("धर्मः", "karma"), (None, "")], "a string, b string")
    assert [r[0] for r in d.select(N.equivalent(F.col("a"), F.col("b"))).collect()] == [True, False, True]


def test_composition_leaves_stable_characters_alone_in_all_pairs():
    """Texts of these alone don't leave the JVM."""
    import re
    import unicodedata

    from lipika.functions import normalize

    stable = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{m[1]}", normalize.STABLE) + "]")
    own = [chr(i) for i in range(0x3000) if stable.match(chr(i))]
    assert {"न", "र", "ā", "ṭ", "é", "्"} <= set(own) and not {"\u093c", "\u0301", "क़"} & set(own)
    assert [x for x in own if unicodedata.combining(x)] == ["्"]
    assert not [a + b for a in own for b in own if unicodedata.normalize("NFC", a + b) != a + b]


def test_texts_beyond_ascii_are_composed_and_read_as_before(spark):
    import unicodedata

    from pyspark.sql import functions as F

    from lipika.functions import normalize, script, translit

    texts = ["नर क\u093cलम", "e\u0301té", "ā ḍ ñ", "\u0951\u0952\u093c", "한\u1100\u1161", "\ufdd0a k\ufdd0a", "kA\ue000 ki kaM", None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", normalize.nfc(F.col("t")).alias("n"), script.is_iast(F.col("t")).alias("d"), translit.slp1_to_devanagari(F.col("t")).alias("v")).orderBy("i").collect()
    assert [r.n for r in rows] == [None if t is None else unicodedata.normalize("NFC", t) for t in texts]
    assert [r.d for r in rows] == [any(c in script.DIACRITICS for c in t or "") for t in texts]
    assert [r.v for r in rows][5:7] == ["\ufdd0अ क्\ufdd0अ", "का कि कं"]


def test_cheaper_forms_equal_the_expressions(spark):
    """Ends, lines' ends, anusvara and final h against the rules as regular expressions, over every blank and break and all pairs of letters."""
    from lipika.functions.script import SPACE, SPACES, strip

    every = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    d = spark.createDataFrame([(c,) for c in every], "t string")
    assert {r.t for r in d.where(F.col("t").rlike(f"^{SPACE}$")).collect()} == set(SPACES)
    r = random.Random(5)
    letters = "NYRnmkKgGcCjJwWqQtTdDpPbBSzshaAiU .,?ÁM"
    texts = ["".join(x) for n in (2, 3) for x in itertools.product("NYRnmkgszSha. ", repeat=n)] + ["".join(r.choice(letters) for _ in range(30)) for _ in range(300)]
    texts += ["".join(r.choice(SPACES + "ab\n\n\t ") for _ in range(r.randint(0, 12))) for _ in range(2000)] + [None, ""]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.col("t")
    for nasal, before in N.NASALS:
        old = F.regexp_replace(old, f"{nasal}([{before}])", "M$1")
    ends = lambda t: F.regexp_replace(t, f"^{SPACE}+|{SPACE}+$", "")
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", r"\r\n?", "\n"), r"[ \t]{2,}|\t", " "), r"\n\s*\n\s*\n+", "\n\n")
    clean = ends(F.regexp_replace(clean, f"[{SPACE}&&[^\n]]*\n[{SPACE}&&[^\n]]*", "\n"))
    h = F.regexp_replace("t", f"([{X.FINAL_H_AFTER}])h(?=\\s|$|[{X.FINAL_H_BEFORE}])", "$1H")
    for a, b in ((N.anusvara(F.col("t")), old), (strip(F.col("t")), ends(F.col("t"))), (N.clean_text(F.col("t")), clean), (X.final_h(F.col("t")), h)):
        assert d.select("t", a.alias("a"), b.alias("b")).where("not a <=> b").collect() == []
