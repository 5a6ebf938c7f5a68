"""Stored HTML to title and visible text.

Plain pages need no tree: where no end tag stands inside a dropped element but its own, and no quoted value holds an angle
bracket, expressions cut the blocks and tags. A test that errs on the safe side sends all other pages through a tokenizer with
a stack of open elements, so both ways give what the tree gives.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from siftline import constants as K
from siftline.functions.text import utrim, visible_text

_DROPPED = "|".join(K.DROPPED_TAGS)
_BLOCKS = rf"(?is)<({_DROPPED})\b[^>]*>.*?</\1\s*>|<!--.*?-->"
_TAGS = r"(?s)<[!/a-zA-Z][^>]*>"
#: Signs of a page that needs the tree: a bracket after an opened quote or inside a tag, instructions, longer names,
#: self-closed or odd forms of dropped elements, elements whose content is text, a title with tags or without an end.
_AWKWARD = (
    rf"""(?is)=\s*"[^"<>]*[<>]|=\s*'[^'<>]*[<>]|<[/a-z][^<>]*<|<\?|<!--?-?>|<(?:{_DROPPED})(?:[^\s>]|\s[^>]*/>)|</(?:{_DROPPED})(?!\s*>)"""
    r"""|<textarea|<title(?:[^\s>]|\s[^>]*/>)|<title\b[^>]*>[^<]*(?:<(?!/title\s*>)|\z)"""
)
#: The first end tag after the start of an element that is not raw text is not its own: it may close an element around it.
_CROSSED = rf"(?is)<({'|'.join(t for t in K.DROPPED_TAGS if t not in ('script', 'style'))})\b[^>]*>(?>.*?</)(?!\1\s*>)"
#: What is left of blocks that the expressions did not cut whole.
_LEFT_BLOCKS = rf"(?i)</?(?:{_DROPPED})\b|<!--"
_LEFT_TAGS = r"<[!/a-zA-Z]"

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: A comment, a tag or any other markup. A quote counts after an equals sign only; markup that does not end goes on to the end of the page.
_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:-->|\Z))|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|))*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""",
    re.S,
)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in ("script", "style", "title", "textarea")}


def parse_page(source: str) -> tuple[str, str]:
    """Title and text nodes, one per line, of a page, without the dropped elements and what they hold.

    An end tag closes the nearest open element of its name and all inside it; without one it means nothing. What is open at
    the end of the page, or when an element around it closes, ends there. ``<x/>`` is empty. The title is that of the first title element.
    """
    title, nodes = None, []
    path: list[str] = []  # open elements
    count: dict[str, int] = {}  # how many of each name are open
    dropped = 0  # how many of them are dropped
    at = 0
    while True:
        token = _TOKEN.search(source, at)
        if not dropped:
            nodes.append(html.unescape(source[at : token.start() if token else len(source)]))
        if token is None:
            return (title or "").strip(), "\n".join(nodes)
        at = token.end()
        name = (token["name"] or "").lower()
        if not name:
            continue
        if token["end"]:
            while count.get(name):
                last = path.pop()
                count[last] -= 1
                dropped -= last in K.DROPPED_TAGS
                if last == name:
                    break
        elif name in _RAW_END:
            if token["rest"].endswith("/"):
                continue
            end = _RAW_END[name].search(source, at)
            inside = html.unescape(source[at : end.start() if end else len(source)])
            at = end.start() if end else len(source)
            if not dropped and name not in K.DROPPED_TAGS:
                nodes.append(inside)
                if name == "title" and title is None:
                    title = inside
        elif name not in _VOID and not token["rest"].endswith("/"):
            path.append(name)
            count[name] = count.get(name, 0) + 1
            dropped += name in K.DROPPED_TAGS


@F.pandas_udf(StructType([StructField("title", StringType()), StructField("text", StringType())]))
def _parsed(pages: pd.Series) -> pd.DataFrame:
    found = [(None, None) if page is None else parse_page(page) for page in pages]
    return pd.DataFrame(found, columns=["title", "text"])


@F.pandas_udf(StringType())
def _decode_entities(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def _decoded(text: Column) -> Column:
    """Entities decoded; only texts that may hold one go through Python."""
    return F.when(text.contains("&"), _decode_entities(F.when(text.contains("&"), text))).otherwise(text)


def _cut(source: Column) -> tuple[Column, Column]:
    blocks = F.regexp_replace(source, _BLOCKS, "\n")
    return blocks, F.regexp_replace(blocks, _TAGS, "\n")


def needs_tree(source: Column) -> Column:
    """Whether expressions may give another text than the page's tree."""
    blocks, nodes = _cut(source)
    opened, closed = (F.regexp_count(source, F.lit(rf"(?i)<{sign}(?:{_DROPPED})\b")) for sign in ("", "/"))
    # The counts, which are linear, keep pages that open an element very often from the searches for its end. Branches and
    # not an OR, both sides of which Spark may evaluate.
    return (
        F.when(opened != closed, True).when(source.rlike(_AWKWARD), True).when(source.rlike(_CROSSED), True)
        .otherwise(blocks.rlike(_LEFT_BLOCKS) | nodes.rlike(_LEFT_TAGS))
    )


def _ways(source: Column) -> tuple[Column, Column]:
    """Title and text by the tree where the page needs it, else null; the page where it does not, else null."""
    awkward = needs_tree(source)
    return _parsed(F.when(awkward, source)), F.when(~awkward, source)


def page_title(source: Column) -> Column:
    tree, simple = _ways(source)
    inner = F.regexp_extract(_cut(simple)[0], r"(?is)<title[^>]*>(.*?)</title\s*>", 1)
    return utrim(F.coalesce(tree["title"], _decoded(inner)))


def page_text(source: Column) -> Column:
    """Visible text, one text node per line; entities are decoded after the tags are cut."""
    tree, simple = _ways(source)
    return visible_text(F.coalesce(tree["text"], _decoded(_cut(simple)[1])))
