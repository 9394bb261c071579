"""Stories: title lines start them, spans and metadata follow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lipika.functions.script import chars_in, count_of, devanagari_count, fold, is_blank, let, strip

# Words that open prose, never a title.
PROSE_STARTERS = ("एकः", "एका", "एकस्मिन्", "अथ", "कदाचित्", "तदा", "ततः", "सः", "सा", "तेन", "इदानीम्", "अपि", "यदा", "किंचित्")


@dataclass(frozen=True)
class TitleRule:
    min_len: int = 2
    max_len: int = 120
    min_script_chars: int = 5
    script: str | None = None  # a character class (with brackets) counted instead of Devanagari
    starters: tuple[str, ...] = PROSE_STARTERS


def is_title(line: Column, rule: TitleRule = TitleRule()) -> Column:
    n = F.length(line)
    found = chars_in(line, rule.script[1:-1]) if rule.script else devanagari_count(line)
    prose = F.lit(False)
    for s in rule.starters:
        prose = prose | line.startswith(s)
    return n.between(rule.min_len, rule.max_len) & ~prose & (found >= rule.min_script_chars)


# Fixed value: what ends a line, besides \r\n as one.
BREAKS = r"\n-\r\x1C-\x1E\x{0085}\x{2028}-\x{2029}"
OTHER_BREAKS = "\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"


def lines(text: Column) -> Column:
    """The text's lines, each with the break that ends it; together they are the text."""
    found = F.regexp_extract_all(text, F.lit(rf"[^{BREAKS}]*+(?:\r\n|[{BREAKS}])|[^{BREAKS}]++"), F.lit(0))
    # most texts have no break but \n, and a cut at one character needs no expression
    other = F.lit(False)
    for x in OTHER_BREAKS:
        other = other | F.contains(text, F.lit(x))

    def ended(parts: Column) -> Column:
        n = F.size(parts)
        whole = F.transform(F.slice(parts, F.lit(1), n - 1), lambda x: F.concat(x, F.lit("\n")))
        return F.when(F.element_at(parts, -1) == "", whole).otherwise(F.array_append(whole, F.element_at(parts, -1)))

    return F.when(other, found).otherwise(let(F.split(text, "\n", -1), ended))


def titles_of(all_: Column, rule: TitleRule = TitleRule(), blank_before: bool = True) -> Column:
    """Array of line_no, start (characters before the line), title of lines(): each line that passes the rule, at the text's start or after a blank line. One fold over the text's own lines."""
    first = F.struct(F.lit(0).cast("bigint").alias("line_no"), F.lit(0).cast("bigint").alias("start"), F.lit(True).alias("blank"))

    def step(a: Column, line: Column) -> tuple[Column, Column]:
        def named(title: Column) -> Column:
            return F.when(is_title(title, rule), F.struct(a["line_no"].alias("line_no"), a["start"].alias("start"), title.alias("title")))

        # the line's ends are looked at once, however often the rule names them
        out = let(strip(line), named)
        out = F.when(a["blank"], out) if blank_before else out
        return F.struct((a["line_no"] + 1).alias("line_no"), (a["start"] + F.length(line)).alias("start"), is_blank(line).alias("blank")), out

    return fold(all_, first, step, "struct<line_no:bigint,start:bigint,title:string>")["out"]


def titles(text: Column, rule: TitleRule = TitleRule(), blank_before: bool = True) -> Column:
    """titles_of() a text's lines; null has none."""
    return titles_of(lines(text), rule, blank_before)


def title_lines(docs: DataFrame, rule: TitleRule = TitleRule(), key: str = "doc_id", text: str = "text", blank_before: bool = True) -> DataFrame:
    """key, line_no, start, title of each title."""
    return docs.select(key, F.explode_outer(titles(F.col(text), rule, blank_before)).alias("_t")).where("_t is not null").select(key, "_t.line_no", "_t.start", "_t.title")


def clean_title(title: Column) -> Column:
    """Without an author note, parentheses, and what follows the first danda (which stays)."""
    t = F.regexp_replace(F.regexp_replace(title, r"(?i)\s*by:.*$", ""), r"\(.*?\)", "")
    return strip(F.when(F.instr(t, "।") > 0, F.concat(F.substring_index(t, "।", 1), F.lit("।"))).otherwise(t))


def clean_story(text: Column, title: Column) -> Column:
    """Without bold marks, the first occurrence of the title, and more than one blank line."""
    t = F.regexp_replace(text, r"\*\*(.+?)\*\*", "$1")
    at = F.position(title, t)
    t = F.when((at > 0) & (F.length(title) > 0), F.concat(F.substring(t, F.lit(1), at - 1), F.substring(t, at + F.length(title), F.length(t)))).otherwise(t)
    return strip(F.regexp_replace(t, r"\n\s*\n\s*\n+", "\n\n"))


def stories(docs: DataFrame, rule: TitleRule = TitleRule(), key: str = "doc_id", text: str = "text", blank_before: bool = True, untitled: str = "Untitled Story") -> DataFrame:
    """key, story (from 1), title, start_char, end_char, story_text. Text before the first title is dropped; a text without titles is one untitled story, and a null text none. A document's stories follow from its own row: nothing is shuffled."""
    whole = F.col(text)
    size = F.length(whole).cast("bigint")
    alone = F.array(F.struct(F.lit(1).cast("bigint").alias("story"), F.lit(untitled).alias("title"), F.lit(0).cast("bigint").alias("start_char"), size.alias("end_char"), strip(whole).alias("story_text")))

    def cut(all_: Column) -> Column:
        def stories_of(found: Column) -> Column:
            def story(t: Column, i: Column) -> Column:
                next_ = F.get(found, i + 1)
                n = (F.coalesce(next_["line_no"], F.size(all_).cast("bigint")) - t["line_no"]).cast("int")
                # from lines, as a part of the text by its place would be looked for from the text's start
                body = F.array_join(F.slice(all_, (t["line_no"] + 1).cast("int"), n), "")
                return F.struct((i + 1).cast("bigint").alias("story"), clean_title(t["title"]).alias("title"), t["start"].alias("start_char"), F.coalesce(next_["start"], size).alias("end_char"), clean_story(body, t["title"]).alias("story_text"))

            return F.when(F.size(found) > 0, F.transform(found, story)).otherwise(alone)

        return let(titles_of(all_, rule, blank_before), stories_of)

    rows = docs.select(key, F.explode_outer(F.when(whole.isNotNull(), let(lines(whole), cut))).alias("_s"))
    return rows.where("_s is not null").select(key, "_s.*")


def content_type(danda_density: Column, double_density: Column, markers: Column, verse: float = 0.02, dialogue: float = 0.08, least_markers: int = 5) -> Column:
    return F.when(double_density > verse, "verse_conclusion").when((danda_density > dialogue) & (markers > least_markers), "dialogue_prose").otherwise("narrative_prose")


def story_metadata(text: Column, danda: str = "।", double: str = "॥") -> Column:
    """Struct of counts, densities, content type and whether an e-mail address is there."""
    import re

    n = F.length(text)
    d, dd = count_of(text, re.escape(danda)), count_of(text, re.escape(double))
    markers = count_of(text, "इति") + count_of(text, '"')
    density = lambda x: F.when(n > 0, x / n).otherwise(0.0)
    return F.struct(
        d.alias("danda_count"),
        dd.alias("double_danda_count"),
        markers.alias("dialogue_markers"),
        dd.alias("verse_count"),
        density(d).alias("danda_density"),
        density(dd).alias("double_danda_density"),
        content_type(density(d), density(dd), markers).alias("content_type"),
        F.when(text.rlike("[a-zA-Z@.:]*@[a-zA-Z@.:]*"), True).alias("has_english_metadata"),
    )
