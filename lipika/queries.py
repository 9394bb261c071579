"""Queries over the driver's tables, one an operator, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.functions import normalize as N
from lipika.functions import script as S
from lipika.functions import translit as X
from lipika.operators import blockmax, chunk, encode, evaluate, fusion, knn, lexical, lsa, prompt, segment, store, vector
from lipika.sources import files, pdf

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CHUNKS = chunk.ChunkConfig(delimiters=".", ending=" .")
TITLES = segment.TitleRule(min_len=2, max_len=60, min_script_chars=1, script="[A-Z]", starters=("It ", "The "))
K = 50


def quoted(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents", *columns) -> DataFrame:
    """A table's columns for work by the text, over all cores even if it is one small file."""
    return files.spread(table(spark, sf_dir, name).select(*columns) if columns else table(spark, sf_dir, name))


def query(name: str, sql: str | None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


#: Name -> (column expressions of t, SQL of the same) of every function of one text; tests run them over odd texts too.
SCALARS: dict[str, tuple[Callable, str]] = {}
#: Letters that have both a composed and a decomposed form.
COMPOSED = [("é", "e\u0301"), ("ö", "o\u0308"), ("ü", "u\u0308"), ("ñ", "n\u0303"), ("ó", "o\u0301")]
#: Spellings of a turn, which the table has in Roman letters only.
SPELLINGS = ("as written", "devanagari", "scholarly", "both scripts, decomposed")


def spelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, spelling (a place in SPELLINGS), t: every conversation turn as it is, read as SLP1 and written in Devanagari and in scholarly Roman, and decomposed with Devanagari behind it."""
    text = F.col("text")
    loose = text
    for a, b in COMPOSED:
        loose = F.replace(loose, F.lit(a), F.lit(b))
    written = S.let(X.slp1_to_devanagari(text), lambda d: F.array(text, d, X.slp1_to_iast(text), F.concat(loose, F.lit(" "), d)))
    return texts(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", F.posexplode(written).alias("spelling", "t"))


def sql_spelt() -> str:
    loose = sql_replace("t", COMPOSED)
    return f"(SELECT conv_id, turn, v::INTEGER AS spelling, CASE v WHEN 0 THEN t WHEN 1 THEN d WHEN 2 THEN {sql_from_slp1()} ELSE {loose} || ' ' || d END AS t FROM (SELECT conv_id, turn, text AS t, {_sql_to_dev('text')} AS d FROM conversations) x, (SELECT unnest(range(0, 4)) AS v) y) s"


def on_texts(name: str, out: Callable, sql: str) -> None:
    """A query over all spelt() turns: what out gives of t."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spelt(spark, sf_dir).select("conv_id", "turn", "spelling", *out(F.col("t")))

    SCALARS[name] = (out, sql)
    QUERIES[name] = run
    ORACLES[name] = f"SELECT conv_id, turn, spelling, {sql} FROM {sql_spelt()}"


# --- SQL of the scalar functions -------------------------------------------------------------------------------------

LETTERS_IN_BLOCK = r"[\x{0904}-\x{0939}\x{093D}\x{0950}\x{0958}-\x{0961}\x{0971}-\x{097F}]"
DIACRITICS = f"[{S.DIACRITICS}]"


def sql_count(t: str, pattern: str) -> str:
    return f"coalesce(len(regexp_extract_all({t}, '{pattern}')), 0)::BIGINT"


def sql_dev(t: str) -> str:
    return sql_count(t, r"[\x{0900}-\x{097F}]")


def sql_other(t: str) -> str:
    return f"({sql_count(t, r'\p{L}')} - {sql_count(t, LETTERS_IN_BLOCK)})"


def sql_script(t: str) -> str:
    return f"CASE WHEN {sql_dev(t)} + {sql_other(t)} > 0 AND {sql_dev(t)} * 2 > {sql_dev(t)} + {sql_other(t)} THEN 'devanagari' WHEN coalesce(regexp_matches({t}, '{DIACRITICS}'), false) THEN 'iast' ELSE 'loose_roman' END"


def sql_mixed(t: str) -> str:
    return f"({sql_dev(t)} > 0 AND {sql_other(t)} > 0)"


def sql_replace(t: str, pairs) -> str:
    for a, b in pairs:
        t = f"replace({t}, {quoted(a)}, {quoted(b)})"
    return t


def sql_final_h(t: str) -> str:
    return f"regexp_replace({t}, '([{X.FINAL_H_AFTER}])h(\\s|$|[{X.FINAL_H_BEFORE.replace(chr(39), chr(39) * 2)}])', '\\1H\\2', 'g')"


def sql_dev_to_slp1(t: str) -> str:
    t = f"regexp_replace({t}, '([{X.CONSONANTS}])', '\\1अ', 'g')"
    t = f"regexp_replace({t}, 'अ([{X.SIGNS}{X.VIRAMA}])', '\\1', 'g')"
    t = f"replace(replace({t}, '॥', '..'), '।', '.')"
    marks = "ंःँऽ०१२३४५६७८९"
    return f"replace(translate({t}, '{X.VOWELS}{X.SIGNS}{X.CONSONANTS}{marks}', {quoted(X.VOWELS_SLP1 + X.SIGNS_SLP1 + X.CONSONANTS_SLP1 + 'MH~' + chr(39) + '0123456789')}), '{X.VIRAMA}', '')"


def sql_iast_to_slp1(t: str) -> str:
    return f"translate({sql_replace(t, X.IAST_PAIRS)}, '{X.IAST_SINGLES[0]}', '{X.IAST_SINGLES[1]}')"


def sql_hk_to_slp1(t: str) -> str:
    places = "".join(chr(X.PRIVATE + i) for i in range(len(X.HK_GROUPS)))
    t = sql_replace(t, [(a, p) for (a, _), p in zip(X.HK_GROUPS, places, strict=True)])
    return f"translate({t}, '{places}{X.HK_SINGLES[0]}', '{''.join(b for _, b in X.HK_GROUPS)}{X.HK_SINGLES[1]}')"


def sql_loose(t: str) -> str:
    return sql_replace(t, X.LOOSE)


def sql_strip(t: str) -> str:
    return f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


def sql_to_slp1(t: str) -> str:
    return f"CASE WHEN {sql_strip(t)} = '' THEN {t} WHEN {sql_script(t)} = 'devanagari' THEN {sql_dev_to_slp1(t)} WHEN {sql_script(t)} = 'iast' THEN {sql_iast_to_slp1(t)} ELSE {sql_hk_to_slp1(sql_final_h(sql_loose(t)))} END"


def sql_anusvara(t: str) -> str:
    for nasal, before in N.NASALS:
        t = f"regexp_replace({t}, '{nasal}([{before}])', 'M\\1', 'g')"
    return t


def sql_fold(t: str) -> str:
    return f"translate({t}, '{N.LONG}', '{N.SHORT}')"


def sql_clean(t: str) -> str:
    t = f"replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    t = f"regexp_replace(regexp_replace({t}, '[ \\t]+', ' ', 'g'), '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g')"
    return sql_strip(f"array_to_string(list_transform(string_split({t}, chr(10)), lambda x: {sql_strip('x')}), chr(10))")


def sql_preprocess(t: str) -> str:
    """Over a subquery, as the text is used many times."""
    body = f"CASE WHEN s = 'devanagari' THEN {sql_dev_to_slp1('u')} WHEN s = 'iast' THEN {sql_iast_to_slp1('u')} ELSE {sql_hk_to_slp1(sql_final_h(sql_loose(sql_final_h('u'))))} END"
    return f"CASE WHEN coalesce({sql_strip(t)}, '') = '' THEN '' ELSE (SELECT {sql_clean('z')} FROM (SELECT {sql_fold(sql_anusvara('y'))} AS z FROM (SELECT {body} AS y FROM (SELECT u, {sql_script('u')} AS s FROM (SELECT nfc_normalize({t}) AS u))))) END"


def sql_from_slp1(t: str = "t") -> str:
    pairs = [("K", "kh"), ("G", "gh"), ("C", "ch"), ("J", "jh"), ("W", "ṭh"), ("Q", "ḍh"), ("T", "th"), ("D", "dh"), ("P", "ph"), ("B", "bh"), ("E", "ai"), ("O", "au")]
    return sql_replace(f"translate({t}, 'AIUfFxXMHNYwqRSz', 'āīūṛṝḷḹṃḥṅñṭḍṇśṣ')", pairs)


def _sql_to_dev(t: str = "t") -> str:
    t, hole = f"regexp_replace({t}, '([{X.CONSONANTS_SLP1}])a', '\\1{chr(X.PRIVATE)}', 'g')", chr(X.PRIVATE)
    for v, sign in zip(X.SIGNS_SLP1, X.SIGNS, strict=True):
        t = f"regexp_replace({t}, '([{X.CONSONANTS_SLP1}]){v}', '\\1{sign}', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '([{X.CONSONANTS_SLP1}])', '\\1{X.VIRAMA}', 'g'), '{X.VIRAMA}([{X.SIGNS}{hole}])', '\\1', 'g')"
    t = f"replace(replace(replace({t}, '..', '॥'), '.', '।'), '{hole}', '')"
    return f"translate({t}, {quoted(X.CONSONANTS_SLP1 + X.VOWELS_SLP1 + 'MH~' + chr(39) + '0123456789')}, '{X.CONSONANTS}{X.VOWELS}ंःँऽ०१२३४५६७८९')"


# --- scalar functions ------------------------------------------------------------------------------------------------

on_texts("script_detect_fixture", lambda t: [S.detect_script(t).alias("script"), S.is_devanagari(t).alias("devanagari"), S.is_iast(t).alias("iast")], f"{sql_script('t')} AS script, CASE WHEN {sql_dev('t')} + {sql_other('t')} = 0 THEN false ELSE {sql_dev('t')} * 2 > {sql_dev('t')} + {sql_other('t')} END AS devanagari, coalesce(regexp_matches(t, '{DIACRITICS}'), false) AS iast")
on_texts("mixed_scripts", lambda t: [S.has_mixed_scripts(t).alias("mixed")], f"{sql_mixed('t')} AS mixed")
on_texts("final_h", lambda t: [X.final_h(t).alias("out")], f"{sql_final_h('t')} AS out")
on_texts("loose_roman", lambda t: [X.loose_roman(t).alias("out")], f"{sql_loose('t')} AS out")
on_texts("to_slp1_devanagari", lambda t: [X.devanagari_to_slp1(t).alias("out")], f"{sql_dev_to_slp1('t')} AS out")
on_texts("to_slp1_iast", lambda t: [X.iast_to_slp1(t).alias("out")], f"{sql_iast_to_slp1('t')} AS out")
on_texts("to_slp1_loose", lambda t: [X.hk_to_slp1(X.final_h(X.loose_roman(t))).alias("out")], f"{sql_hk_to_slp1(sql_final_h(sql_loose('t')))} AS out")
on_texts("to_slp1_auto", lambda t: [X.to_slp1(t).alias("out")], f"{sql_to_slp1('t')} AS out")
on_texts("anusvara", lambda t: [N.anusvara(t).alias("out")], f"{sql_anusvara('t')} AS out")
on_texts("vowel_fold", lambda t: [N.fold_vowels(t).alias("out")], f"{sql_fold('t')} AS out")
on_texts("clean_text", lambda t: [N.clean_text(t).alias("out")], f"{sql_clean('t')} AS out")
on_texts("remove_punctuation", lambda t: [N.remove_punctuation(t).alias("out"), N.remove_punctuation(t, False).alias("bare")], "regexp_replace(t, '[^\\p{L}\\p{N}_\\s।॥|]', '', 'g') AS out, regexp_replace(t, '[^\\p{L}\\p{N}_\\s]', '', 'g') AS bare")
on_texts("nfc", lambda t: [N.nfc(t).alias("out")], "nfc_normalize(t) AS out")
on_texts("preprocess_fixture", lambda t: [N.preprocess(t).alias("out")], f"{sql_preprocess('t')} AS out")
on_texts("process_fixture", lambda t: [N.process(t)["script"].alias("script"), N.process(t)["is_mixed_script"].alias("mixed")], f"CASE WHEN coalesce({sql_strip('t')}, '') = '' THEN 'unknown' ELSE {sql_script('nfc_normalize(t)')} END AS script, {sql_mixed('t')} AS mixed")
on_texts("process_stats", lambda t: [N.process(t)["stats"]["devanagari_chars"].alias("devanagari"), N.process(t)["stats"]["total_chars"].alias("total"), N.process(t, script="iast")["script"].alias("forced")], f"{sql_dev('t')} AS devanagari, coalesce(length(t), 0)::BIGINT AS total, CASE WHEN coalesce({sql_strip('t')}, '') = '' THEN 'unknown' ELSE 'iast' END AS forced")
on_texts("equivalent_strict", lambda t: [N.equivalent(t, F.lit("dharmaḥ"), folded=False).alias("same")], f"coalesce({sql_to_slp1('t')}, '-') = 'DarmaH' AS same")
on_texts("from_slp1_iast", lambda t: [X.slp1_to_iast(t).alias("out")], f"{sql_from_slp1()} AS out")


on_texts("from_slp1_devanagari", lambda t: [X.slp1_to_devanagari(t).alias("out")], f"{_sql_to_dev()} AS out")
SQL_CLEAN_TITLE = "SELECT {k}, CASE WHEN strpos(u, '।') > 0 THEN regexp_replace(string_split(u, '।')[1] || '।', '^\\s+|\\s+$', '', 'g') ELSE regexp_replace(u, '^\\s+|\\s+$', '', 'g') END AS out FROM (SELECT {k}, regexp_replace(regexp_replace(t, '(?i)\\s*by:.*$', ''), '\\(.*?\\)', '', 'g') AS u FROM {source})"


@query("clean_title", SQL_CLEAN_TITLE.format(k="doc_id, form", source="(SELECT doc_id, v::INTEGER AS form, CASE v WHEN 0 THEN h WHEN 1 THEN h || ' (' || lang || ') by: ' || source ELSE replace(h, '.', ' ।') || ' ' || lang END AS t FROM (SELECT doc_id, lang, source, string_split(text, chr(10))[1] AS h FROM documents) x, (SELECT unnest(range(0, 3)) AS v) y)"))
def clean_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of documents as titles: plain, with a note and an author, and with dandas."""
    head = F.substring_index("text", "\n", 1)
    forms = F.array(head, F.concat(head, F.lit(" ("), "lang", F.lit(") by: "), "source"), F.concat(F.replace(head, F.lit("."), F.lit(" ।")), F.lit(" "), "lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(forms).alias("form", "t")).select("doc_id", "form", segment.clean_title(F.col("t")).alias("out"))


@query("cross_script_equivalence", f"WITH p AS (SELECT conv_id, turn, spelling, {sql_preprocess('t')} AS x FROM {sql_spelt()}) SELECT a.conv_id, a.turn, a.spelling, a.x = b.x AS same FROM p a JOIN p b ON b.conv_id = a.conv_id AND b.turn = a.turn AND b.spelling = 1 AND a.spelling <> 1")
def cross_script_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each spelling of a turn has the search form of its Devanagari."""
    f = spelt(spark, sf_dir).select("conv_id", "turn", "spelling", N.preprocess(F.col("t")).alias("form"))
    other = f.where("spelling = 1").select("conv_id", "turn", F.col("form").alias("other"))
    return f.where("spelling <> 1").join(other, ["conv_id", "turn"]).select("conv_id", "turn", "spelling", F.col("form").eqNullSafe(F.col("other")).alias("same"))


@query("script_stats", f"SELECT doc_id, length(text)::BIGINT AS total_chars, {sql_dev('text')} AS devanagari_chars, {sql_count('text', DIACRITICS)} AS iast_chars, ({sql_other('text')} - {sql_count('text', DIACRITICS)})::BIGINT AS roman_chars, {sql_count('text', '[^\\p{L}\\s\\x{0900}-\\x{097F}\\x{0085}\\p{Z}]')} AS other_chars, {sql_script('text')} AS script_type, {sql_mixed('text')} AS is_mixed FROM documents")
def script_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", S.script_stats(F.col("text")).alias("s")).select("doc_id", "s.*")


@query("script_detect", f"SELECT {sql_script('text')} AS script, lang, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def script_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents", "text", "lang").groupBy(S.detect_script(F.col("text")).alias("script"), "lang").agg(F.count("*").alias("n"))


@query("preprocess_documents", f"SELECT doc_id, md5({sql_preprocess('text')}) AS digest FROM documents")
def preprocess_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5(N.preprocess(F.col("text"))).alias("digest"))


@query("clean_conversations", f"SELECT conv_id, turn, md5({sql_clean('text')}) AS digest, md5(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')) AS bare FROM conversations")
def clean_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(N.clean_text(t)).alias("digest"), F.md5(N.remove_punctuation(t, False)).alias("bare"))


SQL_VALID = "t IS NOT NULL AND coalesce(try(decode(unhex(t))) IS NOT NULL, false)"


@query("valid_utf8", f"SELECT doc_id, cut::INTEGER AS cut, {SQL_VALID} AS valid FROM (SELECT doc_id, cut, CASE WHEN cut = 0 THEN h WHEN cut = 1 THEN substr(h, 3) ELSE substr(h, 1, length(h) // 4 * 2) END AS t FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents) x, (SELECT unnest(range(0, 3)) AS cut) y)")
def valid_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes: whole, without the first one, and the first half, which may end within a character."""
    h = F.hex(F.encode("text", "UTF-8"))
    cuts = F.array(h, F.substring(h, F.lit(3), F.length(h)), F.substring(h, F.lit(1), (F.floor(F.length(h) / 4) * 2).cast("int")))
    f = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(cuts).alias("cut", "t"))
    return f.select("doc_id", "cut", F.coalesce(F.is_valid_utf8(F.unhex("t").cast("string")), F.lit(False)).alias("valid"))


@query("documents_valid", "SELECT count(*)::BIGINT AS n, count(try(decode(encode(text))))::BIGINT AS valid FROM documents")
def documents_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.count(F.when(F.is_valid_utf8("text"), 1)).alias("valid"))


@query("ingest_totals", "SELECT sum(length(text))::BIGINT AS total_chars, count(*)::BIGINT AS total_files FROM documents")
def ingest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.totals(table(spark, sf_dir, "documents"))


@query("page_documents", "WITH p AS (SELECT conv_id, turn, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\\s+$', '')), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM conversations) SELECT conv_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY turn) FILTER (t <> '')) AS digest, count(*)::BIGINT AS page_count FROM p GROUP BY conv_id")
def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = files.documents_of_pages(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return out.select("conv_id", F.md5("text").alias("digest"), "page_count")


@query("pdf_documents", ORACLES["page_documents"])
def pdf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation written as a PDF file with a page a turn, and all files read back as documents."""
    at = f"{files.shared_dir(spark)}/lipika-pdf-{uuid.uuid4().hex}"
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    made = F.udf(lambda pages: pdf.ascii_pdf(pages), "string")
    turns.select("conv_id", made(F.transform("t", lambda x: x["text"])).alias("value")).write.partitionBy("conv_id").text(at)
    pages = files.page_rows(spark, at, pdf.extractor, "*.txt").where("error is null")
    out = files.documents_of_pages(pages.withColumn("conv_id", F.regexp_extract("source_path", r"conv_id=(\d+)", 1).cast("long")), "conv_id", "page_no")
    return out.select("conv_id", F.md5("text").alias("digest"), "page_count")


# --- stories and chunks ----------------------------------------------------------------------------------------------

SQL_TITLES = """lines AS (SELECT doc_id, i - 1 AS line_no, l, length(text) AS text_len, coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, regexp_replace(l, '^\\s+|\\s+$', '', 'g') AS title FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
titles AS (SELECT doc_id, line_no, start, title, text_len FROM lines WHERE length(title) BETWEEN 2 AND 60 AND len(regexp_extract_all(title, '[A-Z]')) >= 1 AND NOT starts_with(title, 'It ') AND NOT starts_with(title, 'The '))"""
SQL_STORIES = f"""{SQL_TITLES}, spans AS (SELECT doc_id, row_number() OVER w AS story, title AS raw, start, coalesce(lead(start) OVER w, text_len)::BIGINT AS stop FROM titles WINDOW w AS (PARTITION BY doc_id ORDER BY start)),
cut AS (SELECT d.doc_id, story, raw, start, stop, text, regexp_replace(substr(text, (start + 1)::BIGINT, stop - start), '\\*\\*(.+?)\\*\\*', '\\1', 'g') AS body FROM documents d LEFT JOIN spans s USING (doc_id)),
stories AS (SELECT doc_id, coalesce(story, 1)::BIGINT AS story, coalesce(regexp_replace(regexp_replace(regexp_replace(raw, '(?i)\\s*by:.*$', ''), '\\(.*?\\)', '', 'g'), '^\\s+|\\s+$', '', 'g'), 'Untitled Story') AS title, coalesce(start, 0)::BIGINT AS start_char, coalesce(stop, length(text))::BIGINT AS end_char,
regexp_replace(CASE WHEN raw IS NULL THEN text ELSE regexp_replace(CASE WHEN strpos(body, raw) = 0 THEN body ELSE substr(body, 1, strpos(body, raw) - 1) || substr(body, strpos(body, raw) + length(raw)) END, '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g') END, '^\\s+|\\s+$', '', 'g') AS story_text FROM cut)"""


def _stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.stories(texts(spark, sf_dir, "documents", "doc_id", "text"), TITLES, blank_before=False)


@query("title_lines", f"WITH {SQL_TITLES} SELECT doc_id, line_no::BIGINT AS line_no, start, title FROM titles")
def title_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.title_lines(texts(spark, sf_dir, "documents", "doc_id", "text"), TITLES, blank_before=False)


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with other line breaks than the table has: \\r\\n after commas, a line separator after stops, a form feed in place of \\n."""
    t = F.replace(F.replace("text", F.lit("\n"), F.lit("\f")), F.lit(", "), F.lit(",\r\n"))
    return texts(spark, sf_dir, "documents", "doc_id", F.replace(t, F.lit(". "), F.lit(".\u2028")).alias("text"))


SQL_BREAKS = "\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{0085}\\x{2028}\\x{2029}"


@query("broken_title_lines", f"WITH b AS (SELECT doc_id, replace(replace(replace(text, chr(10), chr(12)), ', ', ',' || chr(13) || chr(10)), '. ', '.' || chr(8232)) AS t FROM documents), l AS (SELECT doc_id, unnest(a) AS piece, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, regexp_extract_all(t, '[^{SQL_BREAKS}]*(?:\\r\\n|[{SQL_BREAKS}])|[^{SQL_BREAKS}]+') AS a FROM b)), p AS (SELECT doc_id, (i - 1)::BIGINT AS line_no, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, regexp_replace(piece, '^[\\s\\x{{2028}}]+|[\\s\\x{{2028}}]+$', '', 'g') AS title FROM l) SELECT doc_id, line_no, start, title FROM p WHERE length(title) BETWEEN 2 AND 60 AND len(regexp_extract_all(title, '[A-Z]')) >= 1 AND NOT starts_with(title, 'It ') AND NOT starts_with(title, 'The ')")
def broken_title_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.title_lines(_broken(spark, sf_dir), TITLES, blank_before=False)


@query("story_spans", f"WITH {SQL_STORIES} SELECT doc_id, story, title, start_char, end_char, md5(story_text) AS digest FROM stories")
def story_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stories(spark, sf_dir).withColumn("digest", F.md5("story_text")).drop("story_text")


@query("story_report", f"WITH {SQL_STORIES}, r AS (SELECT doc_id, title, length(story_text)::BIGINT AS chars, len(regexp_extract_all(story_text, '[^\\s]+'))::BIGINT AS words, (length(story_text) - length(replace(story_text, chr(10), '')) + 1)::BIGINT AS lines, 1::BIGINT AS stories FROM stories) SELECT * FROM r UNION ALL SELECT NULL, NULL, coalesce(sum(chars), 0)::BIGINT, coalesce(sum(words), 0)::BIGINT, coalesce(sum(lines), 0)::BIGINT, coalesce(sum(stories), 0)::BIGINT FROM r")
def story_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.story_report(_stories(spark, sf_dir))


@query("story_metadata", "WITH m AS (SELECT doc_id, length(text) AS n, (length(text) - length(replace(text, '.', '')))::BIGINT AS danda_count, (length(text) - length(replace(text, ',', '')))::BIGINT AS double_danda_count, (length(text) - length(replace(text, '\"', '')))::BIGINT AS dialogue_markers, CASE WHEN regexp_matches(text, '[a-zA-Z@.:]*@[a-zA-Z@.:]*') THEN true END AS has_english_metadata FROM documents) SELECT doc_id, danda_count, double_danda_count, dialogue_markers, double_danda_count AS verse_count, CASE WHEN n > 0 THEN danda_count / n ELSE 0.0 END AS danda_density, CASE WHEN n > 0 THEN double_danda_count / n ELSE 0.0 END AS double_danda_density, CASE WHEN n > 0 AND double_danda_count / n > 0.02 THEN 'verse_conclusion' WHEN n > 0 AND danda_count / n > 0.08 AND dialogue_markers > 5 THEN 'dialogue_prose' ELSE 'narrative_prose' END AS content_type, has_english_metadata FROM m")
def story_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", segment.story_metadata(F.col("text"), ".", ",").alias("m")).select("doc_id", "m.*")


SQL_SENT = "list_transform(list_filter(list_transform(string_split({t}, '.'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), lambda x: x || ' .')"


def sql_packed(source: str, key: str, text: str, most: int, out: str, extra: str = "") -> str:
    """CTEs that pack the sentences of each row of source into groups."""
    return f"""{out}_s AS (SELECT {key} AS key, i, s, length(s) // 4 AS tok FROM (SELECT {key}, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT {key}, {SQL_SENT.format(t=text)} AS l FROM {source}))),
{out}_p AS (SELECT key, i, 1 AS g, tok AS cur FROM {out}_s WHERE i = 1 UNION ALL SELECT s.key, s.i, CASE WHEN p.cur + s.tok > {most} THEN p.g + 1 ELSE p.g END, CASE WHEN p.cur + s.tok > {most} THEN s.tok ELSE p.cur + s.tok END FROM {out}_p p JOIN {out}_s s ON s.key = p.key AND s.i = p.i + 1),
{out} AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY key ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM (SELECT p.key, p.g::BIGINT AS g, string_agg(s.s, ' ' ORDER BY s.i) AS text FROM {out}_p p JOIN {out}_s s ON s.key = p.key AND s.i = p.i GROUP BY p.key, p.g))"""


SQL_PARENTS = f"""{sql_packed('documents', 'doc_id', 'text', 800, 'par')}, parents AS (SELECT key AS story_id, g AS parent_index, key || '_p' || g AS parent_id, text, length(text) // 4 AS token_count, before AS start_char, before + length(text) AS end_char FROM par)"""
SQL_CHILDREN = f"""{SQL_PARENTS}, {sql_packed('parents', 'parent_id', 'text', 200, 'chi')}, children AS (SELECT c.key AS parent_id, c.g AS child_index, count(*) OVER (PARTITION BY c.key) AS total_children, c.key || '_c' || c.g AS chunk_id, c.text, length(c.text) // 4 AS token_count, p.start_char + c.before AS start_char, p.start_char + c.before + length(c.text) AS end_char FROM chi c JOIN parents p ON p.parent_id = c.key)"""


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.parents(texts(spark, sf_dir, "documents", F.col("doc_id").alias("story_id"), F.col("text").alias("story_text")), c=CHUNKS)


@query("sentences", f"SELECT doc_id, len(l)::BIGINT AS n, md5(array_to_string(l, '|')) AS digest FROM (SELECT doc_id, {SQL_SENT.format(t='text')} AS l FROM documents)")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", chunk.sentences(F.col("text"), CHUNKS).alias("l")).select("doc_id", F.size("l").cast("bigint").alias("n"), F.md5(F.array_join("l", "|")).alias("digest"))


@query("parent_chunks", f"WITH RECURSIVE {SQL_PARENTS} SELECT story_id, parent_index, parent_id, md5(text) AS digest, token_count::BIGINT AS token_count, start_char::BIGINT AS start_char, end_char::BIGINT AS end_char FROM parents")
def parent_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parents(spark, sf_dir).withColumn("digest", F.md5("text")).drop("text")


@query("child_chunks", f"WITH RECURSIVE {SQL_CHILDREN} SELECT parent_id, child_index, total_children::BIGINT AS total_children, chunk_id, md5(text) AS digest, token_count::BIGINT AS token_count, start_char::BIGINT AS start_char, end_char::BIGINT AS end_char FROM children")
def child_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.children(_parents(spark, sf_dir), c=CHUNKS).withColumn("digest", F.md5("text")).drop("text")


@query("chunk_statistics", f"WITH RECURSIVE {SQL_CHILDREN} SELECT 'parent' AS kind, count(*)::BIGINT AS n, min(token_count)::BIGINT AS min_tokens, max(token_count)::BIGINT AS max_tokens, round(avg(token_count), 6) AS avg_tokens FROM parents UNION ALL SELECT 'child', count(*), min(token_count), max(token_count), round(avg(token_count), 6) FROM children")
def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parents(spark, sf_dir)
    return store.token_statistics(p, "parent").unionByName(store.token_statistics(chunk.children(p, c=CHUNKS), "child"))


# --- tokens and lexical search ---------------------------------------------------------------------------------------


def sql_words(t: str) -> str:
    edges = lexical.EDGES.replace("'", "''")
    return f"list_filter(list_transform(string_split_regex(regexp_replace({t}, '^\\s+|\\s+$', '', 'g'), '\\s+'), lambda w: regexp_replace(w, '^[{edges}]+|[{edges}]+$', '', 'g')), lambda w: w <> '')"


def sql_grams(t: str) -> str:
    return f"CASE WHEN length({t}) < 3 THEN [{t}] ELSE list_transform(range(1, length({t}) - 1), lambda i: substr({t}, i, 3)) END"


def sql_tokens(source: str, key: str) -> str:
    """A row (key, l) each row of source."""
    return f"(SELECT {key}, CASE WHEN coalesce(t, '') = '' THEN []::VARCHAR[] ELSE list_distinct(list_concat(list_concat({sql_words('t')}, {sql_grams('s')}), list_concat({sql_words('f')}, {sql_grams('fs')}))) END AS l FROM (SELECT {key}, text AS t, replace(text, ' ', '') AS s, {sql_fold('text')} AS f, {sql_fold(chr(114) + 'eplace(text, ' + quoted(' ') + ', ' + quoted('') + ')')} AS fs FROM {source}))"


SQL_BM25 = f"""post AS (SELECT doc_id, greatest(len(l), 1) AS dl, unnest(CASE WHEN len(l) = 0 THEN ['<EMPTY>'] ELSE l END) AS token FROM {sql_tokens('documents', 'doc_id')}),
facts AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) / count(DISTINCT doc_id) FROM post) AS avgdl),
df AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT token, count(*) AS df FROM post GROUP BY token), facts),
asked AS (SELECT item_id, unnest(l) AS token FROM {sql_tokens('benchmark', 'item_id')}),
bm AS (SELECT item_id AS query_id, doc_id AS ix, round(sum(CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM df) ELSE idf END * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM asked JOIN post USING (token) JOIN df USING (token), facts GROUP BY ALL),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ix) AS rank FROM bm WHERE score > 0) WHERE rank <= {K})"""


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = texts(spark, sf_dir, "documents", F.col("doc_id").alias("ix"), "text")
    return lexical.bm25(queries, docs, "query_id", "ix", c=lexical.Bm25Config(k=K), digits=6)


@query("char_ngrams", f"SELECT item_id, gram, count(*)::BIGINT AS n FROM (SELECT item_id, unnest({sql_grams('text')}) AS gram FROM benchmark) GROUP BY ALL")
def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(lexical.char_ngrams(F.col("text"))).alias("gram")).groupBy("item_id", "gram").agg(F.count("*").alias("n"))


@query("hybrid_tokens", f"SELECT item_id, unnest(l) AS token FROM {sql_tokens('benchmark', 'item_id')}")
def hybrid_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(lexical.tokens(F.col("text"))).alias("token"))


@query("term_df", f"SELECT token, count(*)::BIGINT AS df FROM (SELECT unnest(l) AS token FROM {sql_tokens('documents', 'doc_id')}) GROUP BY token")
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25_index(texts(spark, sf_dir, "documents", "doc_id", "text"), "doc_id").terms.where(F.col("token") != lexical.EMPTY)


@query("bm25_topk", f"WITH {SQL_BM25} SELECT query_id, ix, score, rank FROM lex")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir).withColumn("rank", F.col("rank").cast("bigint"))


@query("bm25_blockmax", f"WITH {SQL_BM25} SELECT query_id, ix, score, rank FROM lex")
def bm25_blockmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hits by an index that skips what can't be among them."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ix"), "text")
    return blockmax.bm25_blockmax(queries, docs, "query_id", "ix", c=lexical.Bm25Config(k=K), digits=6).withColumn("rank", F.col("rank").cast("bigint"))


# --- vectors, fusion, hybrid search ----------------------------------------------------------------------------------

SQL_DIST = "round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 6)"


def sql_vec(queries: str, k: int) -> str:
    return f"vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, ix) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS ix, {SQL_DIST} AS dist FROM {queries} a, embeddings b)) WHERE rank <= {k})"


def _vectors(spark: SparkSession, sf_dir: str, queries: DataFrame, k: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ix"), "embedding")
    return vector.l2_topk(e, queries, k, key="ix")


@query("vector_topk", f"WITH {sql_vec('(SELECT * FROM embeddings WHERE vec_id % 50 = 0)', 10)} SELECT query_id, ix, dist, rank::INTEGER AS rank FROM vec")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return _vectors(spark, sf_dir, q, 10)


@query("vector_pivots", f"WITH {sql_vec('(SELECT * FROM embeddings WHERE vec_id % 50 = 0)', 10)} SELECT query_id, ix, dist, rank::INTEGER AS rank FROM vec")
def vector_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same neighbours, where the triangle inequality decides which cells a query meets."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ix"), "embedding")
    return knn.pivot_topk(e, e.where("ix % 50 = 0").withColumnRenamed("ix", "query_id"), 10, key="ix")


@query("vector_normalized", "SELECT vec_id, i::INTEGER AS i, round(x / n, 6) AS x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i, sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) AS n FROM embeddings)")
def vector_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vector.normalized(F.col("embedding"))).alias("i", "x")).withColumn("x", F.round("x", 6))


def _letters():
    """An encoder of three counts, which SQL can check."""
    return lambda batch: [[t.count("a"), t.count("e"), len(t)] for t in batch]


def sql_letters(prefix: str, table_: str, key: str) -> str:
    parts = [f"(length(t) - length(replace(t, '{x}', '')))::DOUBLE" for x in "ae"] + ["length(t)::DOUBLE"]
    v = f"SELECT {key}, unnest([{', '.join(parts)}]) AS x, unnest(range(0, 3)) AS i, sqrt({' + '.join(f'{p} * {p}' for p in parts)}) AS n FROM (SELECT {key}, '{prefix}' || coalesce(text, '') AS t FROM {table_})"
    return f"SELECT {key}, i::INTEGER AS i, round((CASE WHEN n > 0 THEN x / n ELSE x END)::FLOAT, 5)::FLOAT AS x FROM ({v})"


@query("embed_passages", sql_letters("passage: ", "conversations", "conv_id, turn"))
def embed_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    out = encode.embed(rows, _letters, config=encode.EncoderConfig(model="some-e5-model"))
    return out.select("conv_id", "turn", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round("x", 5))


@query("embed_queries", sql_letters("query: ", "benchmark", "item_id"))
def embed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode.embed_queries(table(spark, sf_dir, "benchmark").select("item_id", "text"), _letters, config=encode.EncoderConfig(model="e5"))
    return out.select("item_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round("x", 5))


@query("fitted_embeddings", None)
def fitted_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under an encoder fitted on all of them; SQL has no singular vectors (tests compare with numpy)."""
    rows = files.stash(lsa.hashed(texts(spark, sf_dir, "documents", "doc_id", "text"), "text", lsa.LsaConfig()))
    return lsa.embed_hashed(rows, lsa.fit_hashed(rows)).select("doc_id", "embedding")


@query("ivf_topk", None)
def ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector.ivf_topk(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10, nprobe=None)


SQL_FUSED = f"""{SQL_BM25}, {sql_vec('(SELECT e.* FROM embeddings e JOIN benchmark ON item_id = vec_id)', K)},
fused AS (SELECT query_id, ix, round(0.7 * coalesce(a, 0) + 0.3 * coalesce(b, 0), 6) AS score FROM (SELECT query_id, ix, score / greatest(max(score) OVER (PARTITION BY query_id), 0.001) AS a FROM lex) FULL JOIN (SELECT query_id, ix, 1 - dist / greatest(max(dist) OVER (PARTITION BY query_id), 0.001) AS b FROM vec) USING (query_id, ix))"""


def _fused(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    q = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding").join(items, "query_id")
    lex, vec = _lexical(spark, sf_dir), _vectors(spark, sf_dir, q, K)
    return lex, vec, fusion.weighted_fusion(lex, vec, digits=6)


@query("fusion", f"WITH {SQL_FUSED} SELECT * FROM fused")
def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir)[2]


@query("hybrid_search", f"WITH {SQL_FUSED}, best AS (SELECT * FROM (SELECT f.*, d.source AS parent_id, row_number() OVER (PARTITION BY query_id, d.source ORDER BY score DESC, ix) AS n FROM fused f JOIN documents d ON d.doc_id = f.ix WHERE score >= 0.1) WHERE n = 1) SELECT query_id, ix, parent_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ix) AS rank FROM best) WHERE rank <= 2")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ix"), F.col("source").alias("parent_id"))
    return fusion.best_of_parents(_fused(spark, sf_dir)[2], children).withColumn("rank", F.col("rank").cast("bigint"))


@query("recall_at_k", f"WITH {SQL_BM25}, {sql_vec('(SELECT e.* FROM embeddings e JOIN benchmark ON item_id = vec_id)', K)}, r AS (SELECT query_id, list(ix ORDER BY rank) AS r FROM lex GROUP BY 1), t AS (SELECT query_id, list(ix ORDER BY rank) AS t FROM vec GROUP BY 1) SELECT query_id, round(len(list_intersect(r[1:5], t)) / len(list_distinct(t)), 6) AS recall, len(list_intersect(r[1:5], t)) > 0 AS found FROM r JOIN t USING (query_id)")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex, vec, _ = _fused(spark, sf_dir)
    listed = lambda d, name: d.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "ix"))), lambda x: x["ix"]).alias(name))
    both = listed(lex, "r").join(listed(vec, "t"), "query_id")
    return both.select("query_id", F.round(evaluate.recall_at_k(F.col("r"), F.col("t")), 6).alias("recall"), evaluate.found(F.col("r"), F.col("t")).alias("found"))


SQL_EVALUATED = f"""WITH {SQL_BM25}, hits AS (SELECT query_id, d.source AS title, min(rank) AS rank FROM lex JOIN documents d ON d.doc_id = lex.ix GROUP BY ALL),
q AS (SELECT item_id AS query_id, 'c' || item_id % 3 AS category, CASE WHEN item_id % 4 = 0 THEN NULL ELSE (SELECT list(DISTINCT source) FROM documents WHERE doc_id % 7 = item_id % 7) END AS truth FROM benchmark),
r AS (SELECT query_id, category, truth, coalesce((SELECT list(title ORDER BY rank, title) FROM hits h WHERE h.query_id = q.query_id), []) AS retrieved FROM q),
evaluated AS (SELECT query_id, category, retrieved, CASE WHEN truth IS NOT NULL THEN len(list_intersect(retrieved[1:5], truth)) / len(truth) END AS recall, CASE WHEN truth IS NOT NULL THEN len(list_intersect(retrieved[1:5], truth)) > 0 END AS found FROM r)"""


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    hits = _lexical(spark, sf_dir).join(docs.select(F.col("doc_id").alias("ix"), F.col("source").alias("title")), "ix")
    truth = docs.groupBy((F.col("doc_id") % 7).alias("part")).agg(F.collect_set("source").alias("truth"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("c"), (F.col("item_id") % 3).cast("string")).alias("category"), (F.col("item_id") % 7).alias("part"))
    queries = asked.join(truth, "part").withColumn("truth", F.when(F.col("query_id") % 4 != 0, F.col("truth"))).drop("part")
    return evaluate.run_evaluation(queries, hits)


@query("run_evaluation", f"{SQL_EVALUATED} SELECT query_id, category, array_to_string(retrieved, ',') AS retrieved, round(recall, 6) AS recall, found FROM evaluated")
def run_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).select("query_id", "category", F.array_join("retrieved", ",").alias("retrieved"), F.round("recall", 6).alias("recall"), "found")


@query("evaluation_report", f"{SQL_EVALUATED} SELECT 'overall' AS kind, NULL AS name, count(*)::BIGINT AS n, count(recall)::BIGINT AS judged, round(avg(recall), 6) AS mean_recall, min(recall) AS min_recall, max(recall) AS max_recall, coalesce(sum(found::INT), 0)::BIGINT AS found FROM evaluated UNION ALL SELECT 'category', category, count(*), count(recall), round(avg(recall), 6), min(recall), max(recall), coalesce(sum(found::INT), 0)::BIGINT FROM evaluated GROUP BY category")
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.evaluation_report(_evaluated(spark, sf_dir))


@query("eval_summary", f"{SQL_EVALUATED} SELECT category AS component, round(avg(recall), 6) AS mean, min(recall) AS min, max(recall) AS max, count(recall)::BIGINT AS n FROM evaluated GROUP BY category")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(_evaluated(spark, sf_dir), "category", "recall").withColumnRenamed("category", "component")


@query("evaluation_components", f"WITH {SQL_FUSED} SELECT 'lexical' AS component, (SELECT count(*) FROM lex)::BIGINT AS rows, true AS timed UNION ALL SELECT 'vector', (SELECT count(*) FROM vec)::BIGINT, true UNION ALL SELECT 'fusion', (SELECT count(*) FROM fused)::BIGINT, true")
def evaluation_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each part of hybrid retrieval gave over all of benchmark, and whether its time was taken (the milliseconds differ from run to run)."""
    parts = evaluate.Components()
    lex, vec, _ = _fused(spark, sf_dir)
    lex, vec = parts.measured("lexical", lex), parts.measured("vector", vec)
    parts.measured("fusion", fusion.weighted_fusion(lex, vec, digits=6))
    return parts.report(spark).select("component", "rows", (F.col("milliseconds") > 0).alias("timed"))


@query("category_breakdown", "SELECT lang, count(*)::BIGINT AS n, round(avg(quality), 6) AS avg_quality, round(avg(toxic), 6) AS avg_toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def category_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.breakdown(table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left"), "lang", ["quality", "toxic"])


@query("failure_cases", f"{SQL_EVALUATED} SELECT query_id, category, round(recall, 6) AS recall FROM evaluated WHERE recall < 1")
def failure_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.failures(_evaluated(spark, sf_dir)).select("query_id", "category", F.round("recall", 6).alias("recall"))


# --- the chunk store -------------------------------------------------------------------------------------------------


@query("upsert_latest", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(0).alias("seq"))
    changed = old.where("o_orderkey % 2 = 0")
    new = changed.select("o_orderkey", F.lit("T").alias("o_orderstatus"), "o_totalprice", F.lit(1).alias("seq")).unionByName(changed.select("o_orderkey", F.lit("U").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(2).alias("seq")))
    return store.upsert(old, new, ["o_orderkey"], [F.col("seq")]).drop("seq")


@query("upsert_buckets", "SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 8 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders UNION ALL SELECT -o_orderkey, 'N', o_totalprice FROM orders WHERE o_orderkey % 100 = 0 AND o_orderkey > 0")
def upsert_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in a clustered table; some changed twice and some added by one upsert."""
    at = f"{files.shared_dir(spark)}/lipika-orders-{uuid.uuid4().hex}"
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(0).alias("seq"))
    store.save_clustered(old, at, "o_orderkey")
    changed = old.where("o_orderkey % 8 = 0")
    new = changed.withColumns({"o_orderstatus": F.lit("T"), "seq": F.lit(1)}).unionByName(changed.withColumns({"o_orderstatus": F.lit("U"), "o_totalprice": F.col("o_totalprice") + 1, "seq": F.lit(2)}))
    added = old.where("o_orderkey % 100 = 0 and o_orderkey > 0").withColumns({"o_orderkey": -F.col("o_orderkey"), "o_orderstatus": F.lit("N")})
    store.upsert_buckets(spark, at, new.unionByName(added), "o_orderkey", [F.col("seq")])
    return spark.read.parquet(at).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("lookup_many", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100)")
def lookup_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the 100 dearest orders, looked up by a batch of keys in all lines."""
    at = f"{files.shared_dir(spark)}/lipika-lines-{uuid.uuid4().hex}"
    store.save_clustered(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), at, "l_orderkey")
    dearest = table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey").collect()
    return store.lookup_many(spark, at, "l_orderkey", [r[0] for r in dearest])


@query("vector_index", "SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS vector_index FROM conversations")
def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.numbered(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id", "turn"])


@query("child_count_left", "SELECT o_orderkey, count(l_orderkey)::BIGINT AS child_count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def child_count_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.child_counts(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("store_statistics", "SELECT p.*, c.*, CASE WHEN total_parents > 0 THEN round(total_children / total_parents, 6) ELSE 0.0 END AS avg_children_per_parent FROM (SELECT count(*)::BIGINT AS total_parents, count(DISTINCT o_custkey)::BIGINT AS total_stories FROM orders) p, (SELECT count(*)::BIGINT AS total_children FROM lineitem) c")
def store_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.statistics(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_custkey")


@query("chunk_lookup", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations WHERE conv_id = 7")
def chunk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.lookup(table(spark, sf_dir, "conversations"), "conv_id", 7).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("children_by_parent", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, turn, role FROM conversations")
def children_by_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.children_of(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@query("children_of_some", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, turn, role FROM conversations WHERE conv_id IN (3, 7)")
def children_of_some(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.children_of(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", [3, 7])


@query("orphan_semi", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def orphan_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return store.with_parent(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), kept, "l_orderkey")


# --- prompts ---------------------------------------------------------------------------------------------------------


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), F.col("role").alias("title"), F.lit(None).cast("string").alias("parent_text"), "text")


@query("prompt_context", "SELECT conv_id AS query_id, md5('<|im_start|>system' || chr(10) || 'Answer.' || chr(10) || '<|im_end|>' || chr(10) || chr(10) || '<|im_start|>user' || chr(10) || '" + prompt.LEAD + "' || chr(10) || chr(10) || string_agg('[Passage ' || (turn + 1) || ' - ' || role || ']' || chr(10) || CASE WHEN length(text) > 1200 THEN substr(text, 1, 1200) || '...' ELSE text END, chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || 'Question: ' || 'Why?' || chr(10) || chr(10) || 'Be brief.' || chr(10) || '<|im_end|>' || chr(10) || chr(10) || '<|im_start|>assistant' || chr(10) || 'So, ') AS digest FROM conversations GROUP BY conv_id")
def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = prompt.contexts(_hits(spark, sf_dir))
    return c.select("query_id", F.md5(prompt.prompt(F.lit("Why?"), F.col("context"), "Answer.", "Be brief.", "So, ")).alias("digest"))


@query("citations", "SELECT conv_id AS query_id, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn), role) AS position, role AS title FROM conversations GROUP BY conv_id, role")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt.citations(_hits(spark, sf_dir)).select("query_id", F.col("position").cast("bigint").alias("position"), "title")


@query("snippets", "SELECT doc_id, CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END AS snippet FROM documents")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", prompt.snippet(F.col("text")).alias("snippet"))
