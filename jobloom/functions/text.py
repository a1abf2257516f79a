"""Search predicates, encodings and label escaping."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = r"[\p{L}\p{N}]+"


def like_escape(q: str) -> str:
    """Make backslash, percent and underscore literal."""
    return re.sub(r"([\\%_])", r"\\\1", q)


def contains_ci(cols: list[str], q: str) -> Column:
    """Whether any column holds ``q``, without regard to case."""
    pattern = f"%{like_escape(q)}%"
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return out


def fold_marks(text: Column) -> Column:
    """Lower case without the usual diacritics of Latin letters."""
    marked = [chr(c) for c in range(0xC0, 0x180)]
    plain = [unicodedata.normalize("NFD", c)[0] for c in marked]
    pairs = [(m.lower(), p.lower()) for m, p in zip(marked, plain) if p != m and len(m.lower()) == 1]
    return F.translate(F.lower(text), "".join(m for m, _ in pairs), "".join(p for _, p in pairs))


def token_text(text: Column) -> Column:
    """The tokens of a text, each between spaces: `` t1 t2 ``."""
    tokens = F.regexp_extract_all(fold_marks(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(0))
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def parse_query(q: str) -> list[tuple[str, bool]]:
    """(phrase, is_prefix) of each white-space separated term.

    Trailing stars make a prefix; a term of quotes only is dropped.
    """
    out = []
    for term in q.split():
        body = term.rstrip("*")
        is_prefix = body != term
        if body.replace('"', ""):
            out.append((body, is_prefix))
    return out


def query_tokens(phrase: str) -> list[str]:
    folded = "".join(c for c in unicodedata.normalize("NFD", phrase.lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", folded)


def match_terms(cols: list[str], q: str) -> Column:
    """Full-text match: every term in some column, a phrase's tokens adjacent.

    Terms without token characters are ignored beside others; alone they match nothing.
    """
    terms = [(query_tokens(p), prefix) for p, prefix in parse_query(q)]
    terms = [t for t in terms if t[0]]
    if not terms:
        return F.lit(False)
    out = F.lit(True)
    for tokens, prefix in terms:
        needle = " " + " ".join(tokens) + ("" if prefix else " ")
        hit = F.lit(False)
        for c in cols:
            hit = hit | token_text(F.col(c)).contains(needle)
        out = out & hit
    return out


def truthy(text: str | None) -> bool:
    return (text or "").strip().lower() in ("1", "true", "yes")


def blob_view(blob: Column) -> tuple[Column, Column]:
    """(text, encoding) of a blob: JSON text where it is valid UTF-8 JSON, else base64."""
    text = F.try_validate_utf8(blob.cast("string"))
    is_json = text.isNotNull() & F.try_parse_json(text).isNotNull()
    return F.when(is_json, text).otherwise(F.regexp_replace(F.base64(blob), "[\r\n]", "")), F.when(blob.isNull(), None).when(is_json, "json").otherwise("base64")


def escape_label(text: Column) -> Column:
    """A label value of the text exposition format."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))
