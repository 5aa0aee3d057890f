"""Line-first cleaning with DataFrame functions only: rules judge lines, failing lines go, then documents that lose too much.

Every expression works on one row, so nothing is shuffled and a document costs n log n of its own words at most. Values
that are used again (words, window hashes) are bound once as a lambda's variable.

Defined results: a null or empty text has no words and no lines, fails the base rules and keeps no text; very long texts
are read whole; repeated rows are judged each for itself; an empty table gives no rows; extra columns are ignored. Windows
are compared by a 64-bit hash of their five words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table, unused

SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Runs of shouting marks, symbols that stand for nothing, and list separators.
SHOUT = r"[!?]{2,}"
SEPARATED = r"(?:^|[\x20\x09-\x0D])(?:\||»|›|·|•|>>?|/)(?=[\x20\x09-\x0D]|$)"
MENU = r"(?i)^\W*(?:home|menu|log ?in|sign ?(?:in|up|out)|register|search|contact(?: us)?|about(?: us)?|help|faq|next|previous|back(?: to top)?|share|tweet|print|subscribe|read more|click here|skip to (?:main )?content)(?:\W+(?:home|menu|login|register|search|contact|about|help|faq|next|previous|back|share|print|subscribe))*\W*$"
BOILERPLATE = r"(?i)all rights reserved|\(c\) ?\d{4}|©|copyright \d{4}|licen[sc]ed under|released under the|general public license|creative commons|terms (?:of (?:use|service)|and conditions)|privacy policy|cookie (?:policy|settings)|accept (?:all )?cookies|we use cookies|enable javascript|powered by|lorem ipsum"


def quote(pattern: str) -> str:
    """A pattern as a SQL string literal."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def words_of(text: str) -> str:
    return f"array_remove(split({text}, {quote(SEPARATORS)}), '')"


#: Words that lie in a five-word window found twice: windows with an equal neighbour after sorting, then the union of their places.
_COVERED = """
transform(array(array_sort(transform(filter(s, (e, j) -> (j > 0 and s[greatest(j - 1, 0)].h = e.h) or (j < size(s) - 1 and s[least(j + 1, size(s) - 1)].h = e.h)), e -> e.i))),
  p -> aggregate(transform(p, (x, j) -> if(j = size(p) - 1, 5, least(5, p[least(j + 1, size(p) - 1)] - x))), 0, (a, x) -> a + x))[0]
"""
_REPEATS = f"""
if(size(array_distinct(h)) = size(h), 0, transform(array(array_sort(transform(h, (x, i) -> named_struct('h', x, 'i', i)))), s -> {_COVERED})[0])
"""


def word_counts(text: str) -> Column:
    """A struct of n (words) and repeats (words in repeated five-word windows)."""
    return F.expr(
        f"""transform(array({words_of(text)}), w -> named_struct('n', size(w), 'repeats',
              transform(array(if(size(w) < 5, cast(array() as array<bigint>), transform(sequence(0, greatest(size(w) - 5, 0)), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])))), h -> {_REPEATS})[0]))[0]"""
    )


def line_fails(line: str, symbol_share: float, shout_share: float, separator_share: float) -> str:
    """SQL for the verdict on one line with words: punctuation, navigation, boilerplate."""

    def too_many(pattern: str, share: float) -> str:
        return f"({line} rlike {quote(pattern)} and regexp_count({line}, {quote(pattern)}) >= {share} * regexp_count({line}, {quote(WORD)}))"

    return f"({too_many(SYMBOLS, symbol_share)} or {too_many(SHOUT, shout_share)} or {too_many(SEPARATED, separator_share)} or {line} rlike {quote(MENU)} or {line} rlike {quote(BOILERPLATE)})"


def clean_documents(docs: DataFrame, text: str = "text", max_lost: float = 0.5, symbol_share: float = 0.25, shout_share: float = 0.25, separator_share: float = 0.2) -> DataFrame:
    """`docs` with the base counts, base_failed, kept, n_lines, n_lost_lines, n_lost_words and clean_text.

    A document is kept if it passes the base rules and its failing lines hold at most `max_lost` of its words.
    """
    t = f"coalesce(`{text}`, '')"
    fails = line_fails("l", symbol_share, shout_share, separator_share)
    lines = F.expr(
        f"""transform(array(filter(split({t}, '\\n'), x -> x rlike {quote("[^" + SEPARATORS[1:-2] + "]")})),
              ls -> transform(array(transform(ls, l -> {fails})), bad -> named_struct(
                'n', size(ls), 'dup', size(ls) - size(array_distinct(ls)), 'lost', size(filter(bad, b -> b)),
                'lost_words', aggregate(transform(ls, (l, i) -> if(bad[i], regexp_count(l, {quote(WORD)}), 0)), 0, (a, x) -> a + x),
                'clean', array_join(filter(ls, (l, i) -> not bad[i]), '\\n')))[0])[0]"""
    )
    about, by_line = unused(docs.columns, "about_words", "about_lines")
    judged = docs.withColumns({about: word_counts(t), by_line: lines, "word_chars": F.expr(f"length(regexp_replace({t}, {quote(SEPARATORS)}, ''))").cast("long"), "n_symbols": F.expr(f"regexp_count({t}, {quote(SYMBOLS)})").cast("long")})
    n, repeats = F.col(f"{about}.n").cast("long"), F.col(f"{about}.repeats").cast("long")
    base_failed = (n < 10) | (100 * repeats > 20 * n)
    return judged.withColumns(
        {
            "n_words": n,
            "n_dup_lines": F.col(f"{by_line}.dup").cast("long"),
            "n_repeat_words": repeats,
            "n_lines": F.col(f"{by_line}.n").cast("long"),
            "n_lost_lines": F.col(f"{by_line}.lost").cast("long"),
            "n_lost_words": F.col(f"{by_line}.lost_words").cast("long"),
            "base_failed": base_failed,
            "kept": ~base_failed & (F.col(f"{by_line}.lost_words") <= F.lit(max_lost) * n),
            "clean_text": F.col(f"{by_line}.clean"),
        }
    ).drop(about, by_line)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean_documents(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lost_lines", "n_lost_words")


_W = r"'[^\x20\x09-\x0D]+'"


def _duck_fails(line: str) -> str:
    def too_many(pattern: str, share: float) -> str:
        p = pattern.replace("'", "''")
        return f"(regexp_matches({line}, '{p}') and len(regexp_extract_all({line}, '{p}')) >= {share} * len(regexp_extract_all({line}, {_W})))"

    # RE2 has no look-ahead: separators that share a blank are told apart by doubling white space first
    separators = r"(?:^|[\x20\x09-\x0D])(?:\||»|›|·|•|>>?|/)(?:[\x20\x09-\x0D]|$)"
    doubled = f"regexp_replace({line}, '[\\x20\\x09-\\x0D]', '  ', 'g')"
    separated = f"(regexp_matches({doubled}, '{separators}') and len(regexp_extract_all({doubled}, '{separators}')) >= 0.2 * len(regexp_extract_all({line}, {_W})))"
    return f"({too_many(SYMBOLS, 0.25)} or {too_many(SHOUT, 0.25)} or {separated} or regexp_matches({line}, '{MENU}') or regexp_matches({line}, '{BOILERPLATE}'))"


OP3_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), {_W}) as w from documents),
l as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
b as (select doc_id, list_transform(ls, lambda x: {_duck_fails("x")}) as bad, ls from l),
f as (select doc_id, len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, len(list_filter(bad, lambda x: x)) as n_lost_lines,
        coalesce(list_sum(list_transform(range(1, len(ls) + 1), lambda i: case when bad[i] then len(regexp_extract_all(ls[i], {_W})) else 0 end)), 0) as n_lost_words from b),
g as (select doc_id, unnest(range(1, len(w) - 3)) as i, w from d where len(w) >= 5),
h as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) as n from g),
r as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest(range(i, i + 5)) as p from h where n > 1) group by doc_id),
a as (select d.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, len(regexp_extract_all(t, '{SYMBOLS}'))::bigint as n_symbols,
        n_dup_lines::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, n_lines::bigint as n_lines, n_lost_lines::bigint as n_lost_lines, n_lost_words::bigint as n_lost_words
      from d join f using (doc_id) left join r using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and n_lost_words <= 0.5 * n_words as kept, n_lines, n_lost_lines, n_lost_words
from a
"""
