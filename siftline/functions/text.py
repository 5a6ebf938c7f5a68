"""Text columns: Unicode-aware cleanup, truncation, price lines and query shaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from siftline import constants as K

# White space and line breaks as a Unicode-aware reader sees them (file, group, record and unit separators too).
WS = r"[\s\x1c-\x1f]"
WS_CHARS = "".join(
    chr(n) for n in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
BREAK = r"[\n\x0b\f\r\x1c-\x1e\x85\x{2028}\x{2029}]"
_PRICE_LINE = "(?iU)" + "|".join(f"(?:{p})" for p in K.PRICE_LINE_PATTERNS)


def utrim(c: Column) -> Column:
    """Trim all Unicode white space (``trim`` alone keeps no-break spaces).

    Given the characters, ``trim`` only looks at the ends; a pattern would read the whole text.
    """
    return F.trim(c, F.lit(WS_CHARS))


def is_blank(c: Column) -> Column:
    return F.coalesce(utrim(c), F.lit("")) == ""


def visible_text(c: Column) -> Column:
    """Stripped non-blank lines joined by newlines.

    Every white-space run that holds a line break becomes one newline, so one regex pass does it.
    """
    return utrim(F.regexp_replace(c, f"(?U)(?<!{WS}){WS}*{BREAK}{WS}*", "\n"))


def cut_page(c: Column, max_chars: int = K.PAGE_MAX_CHARS) -> Column:
    marker = f"\n\n...[truncated at {max_chars} chars]"
    return F.when(F.length(c) > max_chars, F.concat(F.substring(c, 1, max_chars), F.lit(marker))).otherwise(c)


def cut_body(c: Column, budget: Column) -> Column:
    """Page body for a prompt: cut with a marker that states both lengths."""
    marker = F.concat(
        F.lit("\n...[truncated "),
        F.length(c).cast("string"),
        F.lit(" -> "),
        budget.cast("string"),
        F.lit(" chars; scroll or open a more specific URL if you need lower content]"),
    )
    return F.when(F.length(c) > budget, F.concat(F.substring(c, F.lit(1), budget), marker)).otherwise(c)


def cut_other(c: Column, max_chars: int = K.CONTEXT_CHARS) -> Column:
    """Any other tool output (already serialized) for a prompt."""
    marker = F.concat(F.lit("...[truncated "), F.length(c).cast("string"), F.lit(" chars]"))
    return F.when(F.length(c) > max_chars, F.concat(F.substring(c, 1, max_chars), marker)).otherwise(c)


def preview(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def price_hints(text: Column, limit: int = 15) -> Column:
    """First distinct (ignoring case) price-like lines of 4 to 180 characters."""
    lines = F.filter(
        F.split(visible_text(F.coalesce(text, F.lit(""))), "\n"),
        lambda s: (F.length(s) >= 4) & (F.length(s) <= 180) & s.rlike(_PRICE_LINE),
    )

    def first_of_each(found: Column) -> Column:
        return _let(
            F.transform(found, F.lower),
            lambda low: F.transform(
                F.slice(F.array_distinct(low), 1, limit),
                lambda key: F.element_at(found, F.array_position(low, key).cast("int")),
            ),
        )

    return _let(lines, first_of_each)


def price_number(price: Column) -> Column:
    """First number of a price text, comma read as decimal point; NULL when there is none."""
    digits = F.regexp_extract(F.replace(price, F.lit(" "), F.lit("")), r"(\d+[.,]?\d*)", 1)
    return F.replace(digits, F.lit(","), F.lit(".")).try_cast("double")


def name_key(name: Column) -> Column:
    """Merge key of a candidate name: generic tokens cut out in list order, then letters and digits only."""
    low = F.lower(F.coalesce(name, F.lit("")))
    bare = reduce(lambda s, t: F.replace(s, F.lit(t), F.lit(" ")), K.NAME_TOKENS, low)
    return F.regexp_replace(bare, "[^a-z0-9]+", "")


def clean_list(items: Column) -> Column:
    """Trimmed non-blank items; NULL is an empty list."""
    return F.coalesce(
        F.filter(F.transform(items, utrim), lambda x: x != ""), F.array().cast("array<string>")
    )


def clean_list_json(value: Column) -> Column:
    """:func:`clean_list` for a JSON text holding a list or one string; anything else is an empty list."""
    as_array = F.from_json(value, "array<string>")
    as_text = F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"]
    is_text = F.ltrim(value).startswith('"')
    return clean_list(F.coalesce(as_array, F.when(is_text, F.array(as_text))))


def python_repr(c: Column) -> Column:
    """Quoted form of a one-line text: single quotes unless only single quotes occur inside."""
    escaped = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    double = c.contains("'") & ~c.contains('"')
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def search_query(query: Column) -> Column:
    """Keyword form of a search query and the warning that goes with it, as ``struct<query, warning>``."""
    q = utrim(F.coalesce(query, F.lit("")))
    words = F.split(q, f"(?U){WS}+")
    n_words = F.size(words)
    long = (n_words > K.QUERY_MAX_WORDS) | (F.length(q) > K.QUERY_MAX_CHARS) | (
        (n_words >= 8) & q.rlike(r"[?.!]$")
    )
    head = F.array_join(F.slice(words, 1, K.QUERY_MAX_WORDS), " ")
    short = F.when(
        F.length(head) > K.QUERY_MAX_CHARS,
        F.regexp_replace(F.substring(head, 1, K.QUERY_MAX_CHARS), " [^ ]*$", ""),
    ).otherwise(head)
    notice = F.concat(
        F.lit("Query was long/sentence-like ("), n_words.cast("string"), F.lit(" words, "),
        F.length(q).cast("string"),
        F.lit(" chars). Truncated for search engines. Prefer 2–8 keywords next time. Used: "),
        python_repr(short),
    )
    return F.struct(
        F.when(long, short).otherwise(q).alias("query"),
        F.when(q == "", F.lit("empty query")).when(long, notice).alias("warning"),
    )


def run_slug(started: Column, task: Column) -> Column:
    """Run id: UTC start time and the sanitized first 40 characters of the task name."""
    return F.concat(
        F.date_format(started, "yyyy-MM-dd'T'HH-mm-ss"),
        F.lit("_"),
        F.regexp_replace(F.substring(task, 1, 40), r"[^\p{L}\p{N}_\-]", "_"),
    )
