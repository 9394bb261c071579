"""Every function of one text, with its SQL, over odd texts that the given tables lack."""

import math

import pytest
from pyspark.sql import functions as F

from lipika import queries
from lipika.operators import segment

#: Odd texts in all scripts, and SLP1.
FIXTURE = [
    (1, "धर्मः"), (2, "dharmaḥ"), (3, "dharmah"), (4, "संस्कृतम्"), (5, "शंखनादः कः आसीत्?"), (6, "śaṅkhanādaḥ kaḥ āsīt?"), (7, "shankhanaadah kah aseet?"),
    (8, "कुरुक्षेत्र"), (9, "kurukṣetra"), (10, "kurukshetra"), (11, "dharma धर्म"), (12, "धर्म a"), (13, ""), (14, "   "), (15, None), (16, "narah gacchati"), (17, "saha"), (18, "path"),
    (19, "रामः वनं गच्छति। सीता॥"), (20, "hello   world  \r\n\r\n\r\n x"), (21, "धर्मः। x!"), (22, "café ā"), (23, "ऋषिः ॐ १२३"), (24, "El niño"), (25, "Ωmega"), (26, "AI Rāma ṝ"),
]
SLP1 = [(1, "Darma"), (2, "saNkara"), (3, "saNga"), (4, "sankara"), (5, "saYcaya"), (6, "maYju"), (7, "santa"), (8, "vanda"), (9, "sampanna"), (10, "kambala"), (11, "saMskfta"), (12, "kAlIdAsaH"), (13, "rAmo gacCati . sItA .."), (14, "fzi Esa Ozadi"), (15, "kfzRa"), (16, "haMsa"), (17, None), (18, "")]
#: Bytes in hex: valid texts, and such as no text has.
BYTES = [(1, "c3a9"), (2, "ff"), (3, ""), (4, "e0a4"), (5, "e0a4a7"), (6, "616263"), (7, "c080"), (8, "f09f9880"), (9, "61c3"), (10, None)]
TITLES = [(1, "शीतं बहु बाधति । The cold hurts by: A B"), (2, "मूर्खभृत्यस्य (The servant) "), (3, "कथा । x । y"), (4, "BY: nobody"), (5, None)]


def values(rows):
    return "(VALUES " + ", ".join(f"({i}::BIGINT, {queries.quoted(s)}{'::VARCHAR' if s is None else ''})" for i, s in rows) + ") AS f(id, t)"


def shown(v):
    return ("nan" if math.isnan(v) else f"{v:.8g}") if isinstance(v, float) else str(v)


def same(spark, rows, out, sql):
    import duckdb

    df = spark.createDataFrame(rows, "id long, t string").select("id", *out(F.col("t")))
    r = duckdb.connect().execute(sql)
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(tuple(map(shown, x)) for x in df.select(cols).collect()) == sorted(tuple(map(shown, x)) for x in r.fetchall())


@pytest.mark.parametrize("name", list(queries.SCALARS))
def test_scalars(spark, name):
    out, sql = queries.SCALARS[name]
    rows = SLP1 if name in ("anusvara", "vowel_fold", "from_slp1_iast", "from_slp1_devanagari") else FIXTURE
    same(spark, rows, out, f"SELECT id, {sql} FROM {values(rows)}")


def test_titles_and_bytes(spark):
    same(spark, TITLES, lambda t: [segment.clean_title(t).alias("out")], queries.SQL_CLEAN_TITLE.format(k="id", source=values(TITLES)))
    same(spark, BYTES, lambda t: [F.coalesce(F.is_valid_utf8(F.unhex(t).cast("string")), F.lit(False)).alias("valid")], f"SELECT id, {queries.SQL_VALID} AS valid FROM {values(BYTES)}")
