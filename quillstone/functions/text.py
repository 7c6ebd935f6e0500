"""Text expressions that stay in the JVM: words, windows, HTML, URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Case-folded runs of letters, digits and underscore; an empty array for null."""
    folded = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def windows(tokens: Column, size: int, stride: int) -> Column:
    """Windows of ``size`` tokens every ``stride``; the last one reaches the end, an empty text has one empty window."""
    n = F.size(tokens)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(stride)))).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(tokens, i * stride + 1, size))


def plain_text(html: Column) -> Column:
    """Markup without scripts, styles, navigation and tags, common entities resolved, blanks collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer)\b.*?</(script|style|nav|header|footer)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"</?[A-Za-z][^<>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&#39;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def url_parts(url: Column) -> Column:
    """scheme, host, path and the day or month in the path; null parts where the URL lacks them."""
    part = lambda pattern: F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))
    return F.struct(
        F.lower(part(r"^([A-Za-z][A-Za-z0-9+.-]*)://")).alias("scheme"), F.lower(part(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)")).alias("host"),
        part(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)").alias("path"), part(r"/([0-9]{4}/[0-9]{2})/").alias("month"),
    )
