"""Functions that need Unicode tables, nested walks or byte cuts: Python over Arrow batches."""

from __future__ import annotations

import html
import json
import re
import string
import unicodedata
from collections.abc import Iterator
from urllib.parse import parse_qs, unquote, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ENTRY_LINES, ENTRY_BYTES, NAME_CHARS, PRINTABLE_SHARE, PREVIEW_CHARS = 200, 25_000, 128, 0.9, 900
ENTRY_WARNING = "\n\n> WARNING: MEMORY.md is {}. Only part of it was loaded. Keep index entries one line and move detail into topic notes.\n"
#: What ends a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
MENTION = ("key", "name", "open_id", "user_id", "union_id")
ANCHOR = re.compile(r'<a[^>]*class="[^"]*result__a[^"]*"[^>]*href="([^"]*)"[^>]*>(.*?)</a>', re.DOTALL)
SNIPPET = re.compile(r'class="[^"]*result__snippet[^"]*"[^>]*>(.*?)</(?:a|div|span)>', re.DOTALL)


def _udf(f, kind: str):
    @F.pandas_udf(kind)
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda x: f(x or ""), na_action=None)

    return apply


def filename(name: str, most: int = NAME_CHARS) -> str:
    """A safe file name: the last part of a path, NFKC, runs of other than ASCII letters, digits, . _ - to one _, without
    those at its ends, at most `most` characters; empty if nothing is left."""
    parts = [x for x in name.split("/") if x not in ("", ".")]
    plain = unicodedata.normalize("NFKC", parts[-1] if parts else "")
    return re.sub("[^A-Za-z0-9._-]+", "_", plain).strip("._-")[:most]


def mentions(payload: str, given: str = "") -> list[tuple[str, ...]]:
    """MENTION records of a message: of a JSON list beside it, of its own list "mentions", and of every element with the
    tag "at" at any depth; distinct, in that order. An id may stand in the record itself or in its object "id"."""

    def parsed(text: str) -> object:
        try:
            return json.loads(text)
        except ValueError:
            return None

    def tagged(x: object) -> Iterator[dict]:
        if isinstance(x, dict) and x.get("tag") == "at":
            yield x
        for child in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            yield from tagged(child)

    def record(x: dict) -> tuple[str, ...]:
        inner = x["id"] if isinstance(x.get("id"), dict) else {}
        values = (x.get("key"), x.get("name") or x.get("user_name"), *(x.get(k) or inner.get(k) for k in MENTION[2:]))
        return tuple("" if v is None else str(v).strip() for v in values)

    beside, root = parsed(given), parsed(payload)
    own = root.get("mentions") if isinstance(root, dict) else None
    listed = [x for some in (beside, own) if isinstance(some, list) for x in some if isinstance(x, dict)]
    return [r for r in dict.fromkeys(map(record, (*listed, *tagged(root)))) if any(r)]


def text_preview(data: bytes) -> str | None:
    """A short form of what looks like text, null for what doesn't: UTF-8 of which nine tenths can be printed. White space
    is squeezed; empty data gives an empty preview."""
    try:
        text = bytes(data).decode()
    except UnicodeDecodeError:
        return None
    good = sum(c.isprintable() or c in string.printable for c in text)
    if text and good < PRINTABLE_SHARE * len(text):
        return None
    plain = " ".join(text.split())
    return plain if len(plain) <= PREVIEW_CHARS else plain[: PREVIEW_CHARS - 3] + "..."


def search_results(page: str) -> list[tuple[str, str, str]]:
    """(title, url, snippet) of result anchors, with redirects unwrapped and snippets by position."""
    plain = lambda x: " ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split())
    snippets = [plain(m) for m in SNIPPET.findall(page)]
    out = []
    for k, (href, title) in enumerate(ANCHOR.findall(page)):
        url = html.unescape(href)
        target = parse_qs(urlparse(url).query).get("uddg")
        out.append((plain(title), unquote(target[0]) if target else url, snippets[k] if k < len(snippets) else ""))
    return out


def safe_filename(c: Column) -> Column:
    return _udf(filename, "string")(c)


def truncated_entrypoint(c: Column) -> Column:
    """struct(content, truncated) of an index file: at most ENTRY_LINES lines, then at most ENTRY_BYTES bytes of UTF-8 that
    end with a line where they can. A cut one ends with a warning that names the limit it broke; a whole one keeps its line end."""
    text = F.coalesce(c, F.lit(""))
    ended = F.split(text, LINE_END, -1)
    lines = F.when(F.element_at(ended, -1) == "", F.slice(ended, 1, F.size(ended) - 1)).otherwise(ended)
    head = F.array_join(F.slice(lines, 1, ENTRY_LINES), "\n")
    big, long = F.octet_length(head) > ENTRY_BYTES, F.size(lines) > ENTRY_LINES
    # the first byte that is cut off must begin a character: of four in a row one does
    raw = F.encode(head, "UTF-8")
    begins = lambda n: ~F.hex(F.substring(raw, n + 1, 1)).between("80", "BF")
    fits = F.coalesce(*[F.when(begins(n), F.substring(raw, 1, n)) for n in range(ENTRY_BYTES, ENTRY_BYTES - 4, -1)])
    kept = F.when(big, F.regexp_replace(F.decode(fits, "UTF-8"), r"(?s)\A(.+)\n[^\n]*\z", "$1")).otherwise(head)
    broken = F.when(big, F.format_string(f"%d bytes (limit: {ENTRY_BYTES})", F.octet_length(text))).otherwise(F.format_string(f"%d lines (limit: {ENTRY_LINES})", F.size(lines)))
    before, after = ENTRY_WARNING.split("{}")
    cut = F.concat(F.regexp_replace(kept, r"(?U)[\s\x1c-\x1f]+\z", ""), F.lit(before), broken, F.lit(after))
    whole = F.when(text.endswith("\n") & ~head.endswith("\n"), F.concat(head, F.lit("\n"))).otherwise(head)
    return F.struct(F.when(big | long, cut).otherwise(whole).alias("content"), (big | long).alias("truncated"))


def mention_records(payload: Column, given: Column | None = None) -> Column:
    """array<struct> of MENTION."""
    kind = "array<struct<" + ",".join(f"{k}:string" for k in MENTION) + ">>"

    @F.pandas_udf(kind)
    def read(own: pd.Series, beside: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(MENTION, r, strict=True)) for r in mentions(p or "", g or "")] for p, g in zip(own, beside, strict=True)])

    return read(payload, F.lit("") if given is None else given)


def previews(data: Column) -> Column:
    """The preview of binary data, null where it doesn't look like text; null data counts as empty."""

    @F.pandas_udf("string")
    def read(s: pd.Series) -> pd.Series:
        return s.map(lambda x: text_preview(x if x is not None else b""), na_action=None)

    return read(data)


def is_text(data: Column) -> Column:
    return previews(data).isNotNull()
