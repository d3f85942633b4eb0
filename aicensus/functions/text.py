"""Column functions over text, paths and confidences."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used; for use inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def is_set(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Parent directory, '' at the root of a scan."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension of the last path segment with its dot, or ''."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def fold(c: Column) -> Column:
    """ASCII lower case, white-space runs collapsed: the keyword gate's view of a text."""
    spaced = F.regexp_replace(c, r"[ \t\n\r\f\x0B]+", " ")
    return F.translate(spaced, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_literal(keyword: str) -> str:
    """The same folding for a keyword known on the driver."""
    out = re.sub(r"[ \t\n\r\f\x0b]+", " ", keyword)
    return "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in out)


def snippet(line: Column, max_bytes: int | None = None) -> Column:
    """One matched line: tabs to blanks, control bytes dropped, trimmed.

    Whole lines by default; with ``max_bytes`` the cut is by bytes, and a character split by it is dropped.
    """
    if max_bytes is not None:
        raw = F.encode(line, "UTF-8")
        line = F.when(F.length(raw) > max_bytes, F.regexp_replace(
            F.make_valid_utf8(F.substring(raw, 1, max_bytes).cast("string")), r"\x{FFFD}+$", "")).otherwise(line)
    return strip(F.regexp_replace(F.translate(line, "\t", " "), r"[\x00-\x1f\x7f]", ""))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, the unit of column numbers."""
    return (F.length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def lines_of(text: Column) -> Column:
    """Lines of a text, CRLF accepted; element ``i`` is line ``i + 1``."""
    return F.split(F.regexp_replace(text, "\r\n", "\n"), "\n")


def json_object(text: Column) -> Column:
    """Whether the text is a JSON object; a text cut short is none. Keys may repeat, which the variant parser refuses."""
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    return F.from_json(text, "map<string,string>", strict).isNotNull()


def pep503(name: Column) -> Column:
    """Python distribution-name normalization."""
    return F.regexp_replace(F.lower(name), r"[-_.]+", "-")


def clean_version(spec: Column) -> Column:
    """First concrete version of a specifier: '>=2,<3' -> '2', '*' -> ''."""
    body = F.regexp_replace(strip(spec), r"^[=<>!~^* \t]+", "")
    return strip(F.regexp_extract(body, r"^([^,; \t#|()]*)", 1))


def confidence_text(c: Column) -> Column:
    """Half-even to four digits, trailing zeros trimmed."""
    fixed = (F.rint(c * 10000) / 10000).cast("decimal(10,4)").cast("string")
    return F.regexp_replace(fixed, r"\.?0+$", "")


def confidence_number(c: Column) -> Column:
    return F.rint(c * 10000) / 10000


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.9, "high").when(c >= 0.6, "medium").otherwise("low")


def camel_case(c: Column) -> Column:
    """'risk/pickle-import' -> 'RiskPickleImport'."""
    parts = F.filter(F.split(c, r"[^A-Za-z0-9]+"), lambda p: p != "")
    return F.array_join(
        F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), ""
    )


def slug(c: Column) -> Column:
    """Slug-safe form of an identifier outside the catalog; 'x' when nothing is left."""
    body = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(body == "", "x").otherwise(body)


def markdown_cell(c: Column) -> Column:
    return F.regexp_replace(c, r"\|", r"\\\\|")


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a path glob: ``**`` spans segments, the rest does not."""
    out: list[str] = []
    segments = [s for i, s in enumerate(pattern.split("/"))]
    collapsed: list[str] = []
    for seg in segments:
        if seg == "**" and collapsed and collapsed[-1] == "**":
            continue
        collapsed.append(seg)
    last = len(collapsed) - 1
    for i, seg in enumerate(collapsed):
        if seg == "**":
            if i == last:
                # A trailing ** also matches the bare prefix.
                if out:
                    out[-1] = out[-1].removesuffix("/")
                    out.append("(?:/.*)?")
                else:
                    out.append(".*")
            else:
                out.append("(?:[^/]+/)*")
        else:
            out.append(_segment_regex(seg) + ("" if i == last else "/"))
    return "^" + "".join(out) + "$"


def _segment_regex(seg: str) -> str:
    out, i = [], 0
    while i < len(seg):
        ch = seg[i]
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "[":
            end = seg.find("]", i + 2)
            if end < 0:
                raise ValueError(f"bad glob segment {seg!r}")
            body = seg[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[{body}]")
            i = end
        elif ch == "\\" and i + 1 < len(seg):
            i += 1
            out.append(re.escape(seg[i]))
        else:
            out.append(re.escape(ch))
        i += 1
    return "".join(out)


def matches_glob(path: Column, *patterns: str) -> Column:
    """Path matches any of the globs."""
    return path.rlike("|".join(glob_regex(p) for p in patterns))
