"""Styled text spans out of HTML pages."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.schemas import SPAN

# Elements with a meaning for styling and line breaks.
_BLOCK = {"div", "li", "p"}
_BOLD, _ITALIC = {"b", "strong"}, {"i", "em"}
_HIDDEN = {"script", "style"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

_TOKEN = r"(?s)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<![^>]*>|[^<]+|<"


def _declared(tag: str, prop: str) -> str | None:
    style = re.search(r"style\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", tag, re.I)
    if not style:
        return None
    found = re.search(rf"(?:^|;)\s*{prop}\s*:\s*([\w-]+)", (style.group(1) or style.group(2) or ""), re.I)
    return found.group(1).lower() if found else None


def _flags(tag: str) -> tuple[bool | None, bool | None]:
    """Bold and italic that the tag's inline style switches on or off."""
    weight, slant = _declared(tag, "font-weight"), _declared(tag, "font-style")
    bold = (True if weight == "bold" or re.fullmatch(r"[6-9]00", weight or "") else
            False if weight == "normal" or re.fullmatch(r"[1-5]00", weight or "") else None)
    italic = True if slant in ("italic", "oblique") else False if slant == "normal" else None
    return bold, italic


def _spans(tokens) -> list[dict]:
    """Fold one page's tokens; formatting tags stay open until closed, as browsers do."""
    out: list[dict] = []
    opened: list[tuple[str, bool | None, bool | None]] = []
    ends_line, started = False, False

    def put(text: str) -> None:
        nonlocal ends_line, started
        if text:
            flags = {"bold": False, "italic": False}
            for _, b, i in opened:
                flags["bold"] = flags["bold"] if b is None else b
                flags["italic"] = flags["italic"] if i is None else i
            out.append({"text": text, **flags})
            started, ends_line = True, text.endswith("\n")

    for token in tokens:
        if not token.startswith("<") or token == "<":
            put(html.unescape(token))
            continue
        name = re.match(r"</?\s*([a-zA-Z][a-zA-Z0-9]*)", token)
        tag = name.group(1).lower() if name else ""
        if not tag or tag in _HIDDEN:
            continue
        if token.startswith("</"):
            for k in range(len(opened) - 1, -1, -1):
                if opened[k][0] == tag:
                    del opened[k]
                    break
            continue
        if tag == "br":
            put("\n")
            continue
        if tag in _BLOCK and started and not ends_line:
            put("\n")
        bold, italic = _flags(token)
        if bold is None and tag in _BOLD:
            bold = True
        if italic is None and tag in _ITALIC:
            italic = True
        if tag not in _VOID and (bold is not None or italic is not None or tag in _BOLD | _ITALIC):
            opened.append((tag, bold, italic))
        elif tag not in _VOID and any(o[0] == tag for o in opened):
            opened.append((tag, None, None))
    return out


def _fold_tokens(tokens: pd.Series) -> pd.Series:
    return tokens.map(_spans)


def styled_spans(pages: DataFrame) -> DataFrame:
    """``(page_id, spans)`` of each page; the page is one row, so nothing is shuffled.

    Tokenising runs in the JVM; only the nesting of styles is folded in Arrow batches.
    """
    tokens = F.regexp_extract_all(F.col("html"), F.lit(_TOKEN), F.lit(0))
    fold = F.pandas_udf(_fold_tokens, T.ArrayType(SPAN))
    return pages.select("page_id", fold(tokens).alias("spans"))


def span_rows(spans: DataFrame) -> DataFrame:
    """One row per span: ``(page_id, ord, text, bold, italic)``."""
    # An outer explode keeps the optimiser from repeating the fold as a filter.
    rows = spans.select("page_id", F.posexplode_outer("spans").alias("ord", "_s")).where(F.col("_s").isNotNull())
    return rows.select("page_id", "ord", "_s.*")
