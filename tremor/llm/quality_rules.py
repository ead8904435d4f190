"""Line-first cleaning, in SQL functions only.

Every line with a word is tried against punctuation, navigation and
boilerplate rules; lines that fail go, and a document that loses more than
half of its word characters goes as a whole.  All of it is per document, so
there is no shuffle and a row is never larger than a few times its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.common import park, table

# Fixed values of the contract: words, symbols, windows and base limits.
BLANK = " \t\n\x0b\x0c\r"
BLANK_RE = r"[ \t-\r]+"
SYMBOLS = "#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PCT = 8, 20, 30

# Rules of a line.
MAX_SYMBOL_PCT = 10  # symbols among a line's word characters
SHOUTS = 3  # so many exclamation marks, and more than one for two words
SEPARATORS, WORDS_PER_SEPARATOR = 3, 6
SIGNS = ["|", "·", "•", "›", "»", "→", "▸", "/", ">"]  # that separate the items of a menu where they stand between blanks
SIGN_WORDS, WORDS_PER_SIGN = 2, 3  # so many such signs, with so many words (themselves included) for each
TEASER_WORDS = 12  # a line of so many words that ends in dots is the beginning of a text on another page
BOILERPLATE_CHARS = 200
# Notices of web pages in the languages of the corpus.
BOILERPLATE = [
    "all rights reserved", "licensed under", "released under the", "privacy policy", "cookie policy", "terms of service",
    "terms of use", "enable javascript", "click here", "sign up for our newsletter", "skip to content", "back to top",
    "alle rechte vorbehalten", "datenschutzerklärung", "allgemeine geschäftsbedingungen", "nutzungsbedingungen", "newsletter abonnieren", "zum seitenanfang",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "mentions légales", "cliquez ici", "haut de page",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "términos y condiciones", "haga clic aquí", "volver arriba",
]
MAX_LOST_PCT = 50


def _n(text: Column, chars: str) -> Column:
    """How many characters of ``chars`` the text has."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _word_chars(line: Column) -> Column:
    return F.length(F.translate(line, BLANK, ""))


def _words(line: Column) -> Column:
    return F.split(F.btrim(line, F.lit(BLANK)), BLANK_RE)


def _n_words(line: Column) -> Column:
    return F.size(_words(line))


def _holds_phrase(text: Column) -> Column:
    def any_of(lower: Column) -> Column:
        found = F.lit(False)
        for x in BOILERPLATE:
            found = found | F.contains(lower, F.lit(x))
        return found

    return F.exists(F.array(F.lower(text)), any_of)  # lower case is made once


def _menu(line: Column) -> Column:
    signs = F.size(F.filter(_words(line), lambda w: w.isin(SIGNS)))
    return (signs >= SIGN_WORDS) & (_n_words(line) <= WORDS_PER_SIGN * signs)


def _teaser(line: Column) -> Column:
    end = F.btrim(line, F.lit(BLANK))
    return (F.endswith(end, F.lit("...")) | F.endswith(end, F.lit("…"))) & (_n_words(line) <= TEASER_WORDS)


def _may_fail(text: Column, n_symbols: Column, n_shouts: Column) -> Column:
    """Whether the text has anything that a line can fail for; it costs less than a look at each line."""
    dots = F.contains(text, F.lit("...")) | F.contains(text, F.lit("…"))
    return (n_symbols > 0) | (n_shouts >= SHOUTS) | (_n(text, "".join(SIGNS)) >= SIGN_WORDS) | dots | _holds_phrase(text)


def line_passes(line: Column) -> Column:
    """The verdict on a line with a word."""
    symbols = 100 * _n(line, SYMBOLS) > MAX_SYMBOL_PCT * _word_chars(line)
    shouting = (_n(line, "!") >= SHOUTS) & (2 * _n(line, "!") > _n_words(line))
    navigation = (_n(line, "|") >= SEPARATORS) & (_n_words(line) <= WORDS_PER_SEPARATOR * _n(line, "|"))
    boilerplate = (F.length(line) <= BOILERPLATE_CHARS) & _holds_phrase(line)
    return ~(symbols | shouting | _teaser(line) | navigation | _menu(line) | boilerplate)


def _with_repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words from the window hashes h: sort (hash, place), keep
    places with an equal neighbour, and add the gaps between them up to a window.

    One column for each step, as each reads the one before twice."""
    pair = "array<struct<h:bigint,i:int>>"
    ordered = F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))).cast(pair)
    df = df.withColumn("_o", F.when(F.size(F.array_distinct("h")) < F.size("h"), ordered).otherwise(F.array().cast(pair)))
    n = F.size("_o")
    as_next = F.zip_with("_o", F.slice("_o", F.lit(2), n), lambda x, y: F.struct(x["h"].alias("h"), x["i"].alias("i"), F.coalesce(x["h"] == y["h"], F.lit(False)).alias("e")))
    df = df.withColumn("_e", as_next)
    none = F.array(F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(0).alias("i"), F.lit(False).alias("e")))
    before = F.slice(F.concat(none, F.col("_e")), F.lit(1), F.size("_e"))
    df = df.withColumn("_p", F.array_sort(F.array_compact(F.zip_with("_e", before, lambda x, y: F.when(x["e"] | y["e"], x["i"])))))
    gaps = F.zip_with("_p", F.slice("_p", F.lit(2), F.size("_p")), lambda x, y: F.least(F.lit(WINDOW), F.coalesce(y - x, F.lit(WINDOW))))
    return df.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0), lambda x, y: x + y).cast("bigint"))


def judged(documents: DataFrame) -> DataFrame:
    """Columns row (the whole input row), n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, lost_chars, clean and kept."""
    text = F.coalesce("text", F.lit("")) if "text" in documents.columns else F.lit("")
    df = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), text.alias("t"))
    df = df.withColumn("w", F.split(F.btrim("t", F.lit(BLANK)), BLANK_RE)).withColumn("l", F.split("t", "\n"))
    df = df.select(
        "row", "w",
        F.when(F.element_at("w", 1) == "", 0).otherwise(F.size("w")).alias("n"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        _n(F.col("t"), SYMBOLS).alias("n_symbols"),
        _may_fail(F.col("t"), _n(F.col("t"), SYMBOLS), _n(F.col("t"), "!")).alias("may_fail"),
        F.filter("l", lambda x: F.btrim(x, F.lit(BLANK)) != "").alias("l"),
    )
    windows = F.transform(F.sequence(F.lit(1), F.col("n") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("w"), i, F.lit(WINDOW))))
    df = df.withColumn("h", F.when(F.col("n") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("passed", F.when(F.col("may_fail"), F.filter("l", line_passes)).otherwise(F.col("l")))
    df = _with_repeat_words(df)
    df = df.select(
        "row", F.col("n").cast("bigint").alias("n_words"), F.col("word_chars").cast("bigint").alias("word_chars"), F.col("n_symbols").cast("bigint").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        F.array_join("passed", "\n").alias("clean"),
    )
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))
    df = df.withColumn("lost_chars", (F.col("word_chars") - _word_chars(F.col("clean"))).cast("bigint"))
    return df.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST_PCT * F.col("word_chars")))


def quality_rules(documents: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, lost_chars, and the cleaned text.

    A null or empty text has no words and fails; a null doc_id and repeated
    rows are judged like others; other columns are not read; an empty table
    gives an empty result.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")
    return judged(documents.select("doc_id", "text")).select("row.doc_id", *names, F.col("clean").alias("text"))


def clean_documents(documents: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns; text without the
    lines that failed, n_chars (where there is such a column) to match.

    Documents with a null, empty or short text go; a null doc_id is no reason.
    Repeated rows and ties are judged one by one; columns may have any name; an
    empty table stays empty.
    """
    df = judged(documents)
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("bigint")}
    columns = [new.get(c, F.col("row")[c]).alias(f"c{i}") for i, c in enumerate(documents.columns)]
    # a number for each row in the condition keeps it above the columns that it reads: the optimizer would move it
    # below them, with all that it is made of, and work them out again for each word
    row = F.monotonically_increasing_id()
    judgement = df.select(*columns, F.col("kept").alias("stays"), row.alias("place")).where("stays and place >= 0")
    return judgement.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(documents.columns)])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("text")


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _sql_n(text: str, chars: str) -> str:
    return f"(length({text}) - length(translate({text}, '{chars}', '')))"


def _quoted(phrase: str) -> str:
    return phrase.replace("'", "''")


_LINE_N = r"len(regexp_extract_all(x, '[^ \t-\r]+'))"
_SIGNS = f"len(list_filter(regexp_extract_all(x, '[^ \t-\r]+'), lambda w: w in ({', '.join(map(repr, SIGNS))})))"
_LINE_CHARS = r"length(regexp_replace(x, '[ \t-\r]+', '', 'g'))"
ORACLE = f"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as t from documents),
w as (select k, doc_id, t, regexp_extract_all(t, '[^ \\t-\\r]+') as w, string_split(t, chr(10)) as ls from d),
win as (select k, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as s from (select k, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from w) t),
again as (select k, i from win qualify count(*) over (partition by k, s) > 1),
gaps as (select k, least({WINDOW}, coalesce(lead(i) over (partition by k order by i) - i, {WINDOW})) as g from again),
rep as (select k, cast(sum(g) as bigint) as r from gaps group by k),
lines as (select k, list_filter(ls, lambda x: trim(x, {_WS}) <> '') as l from w),
lost as (select k, len(l) - len(list_distinct(l)) as n_dup,
  list_sum(list_transform(list_filter(l, lambda x: 100 * {_sql_n("x", SYMBOLS)} > {MAX_SYMBOL_PCT} * {_LINE_CHARS}
    or ({_sql_n("x", "!")} >= {SHOUTS} and 2 * {_sql_n("x", "!")} > {_LINE_N})
    or ({_sql_n("x", "|")} >= {SEPARATORS} and {_LINE_N} <= {WORDS_PER_SEPARATOR} * {_sql_n("x", "|")})
    or ({_SIGNS} >= {SIGN_WORDS} and {_LINE_N} <= {WORDS_PER_SIGN} * {_SIGNS})
    or ((ends_with(trim(x, {_WS}), '...') or ends_with(trim(x, {_WS}), '…')) and {_LINE_N} <= {TEASER_WORDS})
    or (length(x) <= {BOILERPLATE_CHARS} and ({" or ".join(f"contains(lower(x), '{_quoted(p)}')" for p in BOILERPLATE)}))), lambda x: {_LINE_CHARS})) as lost from lines),
c as (select w.doc_id, cast(len(w.w) as bigint) as n_words, cast(length(array_to_string(w.w, '')) as bigint) as word_chars,
  cast({_sql_n("w.t", SYMBOLS)} as bigint) as n_symbols, cast(n_dup as bigint) as n_dup_lines, coalesce(r, 0) as n_repeat_words, cast(coalesce(lost, 0) as bigint) as lost_chars
  from w join lost using (k) left join rep using (k)),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words as base_failed from c)
select *, not base_failed and 100 * lost_chars <= {MAX_LOST_PCT} * word_chars as kept from b
"""
