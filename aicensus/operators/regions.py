"""Code, string and comment regions of source text, one alternation pattern per language."""

from __future__ import annotations

import re

_ESC = rb"\\(?s:.|\Z)"
_LINE_SLASH = rb"(?P<comment>//[^\n\r]*|/\*(?s:.*?)(?:\*/|\Z))"
_NEST_SLASH = rb"(?P<comment>//[^\n\r]*)|(?P<nested>/\*)"
_DQ = rb'"(?:' + _ESC + rb'|[^"\\\n\r])*+"?'
_SQ = rb"'(?:" + _ESC + rb"|[^'\\\n\r])*+'?"
_DQ_MULTI = rb'"(?:' + _ESC + rb'|[^"\\])*+(?:"|\Z)'
_TRIPLE_RAW = rb'"""(?s:.*?)(?:"""|\Z)'
_TRIPLE = rb'"""(?:' + _ESC + rb'|(?!""")[^\\])*+(?:"""|\Z)'
_TRIPLE_SQ = _TRIPLE.replace(b'"', b"'")
_BACKTICK = rb"`(?:" + _ESC + rb"|[^`\\])*+(?:`|\Z)"


def _strings(*forms: bytes) -> bytes:
    return b"(?P<string>" + b"|".join(forms) + b")"


_RAW_PREFIX = rb"(?:[rR][rRbBfFuU]?|[bBfFuU][rR])"
_PYTHON = b"|".join([
    rb"(?P<comment>#[^\n\r]*)",
    _strings(
        _RAW_PREFIX + _TRIPLE_RAW,
        _RAW_PREFIX + _TRIPLE_RAW.replace(b'"', b"'"),
        _RAW_PREFIX + rb'"[^"\n\r]*"?',
        _RAW_PREFIX + rb"'[^'\n\r]*'?",
        rb"[bBfFuU]{0,2}" + _TRIPLE,
        rb"[bBfFuU]{0,2}" + _TRIPLE_SQ,
        rb"[bBfFuU]{0,2}" + _DQ,
        rb"[bBfFuU]{0,2}" + _SQ,
    ),
])
_JS = _LINE_SLASH + b"|" + _strings(_DQ, _SQ, _BACKTICK)

PATTERNS = {
    "python": re.compile(_PYTHON),
    "javascript": re.compile(_JS),
    "typescript": re.compile(_JS),
    "go": re.compile(_LINE_SLASH + b"|" + _strings(_DQ, rb"`[^`]*(?:`|\Z)", _SQ)),
    "java": re.compile(_LINE_SLASH + b"|" + _strings(_TRIPLE, _DQ, _SQ)),
    "rust": re.compile(_NEST_SLASH + b"|" + _strings(
        rb'b?r(?P<hash>#{0,8})"(?s:.*?)(?:"(?P=hash)|\Z)',
        b"b?" + _DQ_MULTI,
        rb"'\\(?s:.)[^'\n]{0,8}'",
        rb"'(?s:[^'\\])'",
    )),
    "csharp": re.compile(_LINE_SLASH + b"|" + _strings(
        rb'(?:@[$@]?|\$@)"(?:""|[^"])*+(?:"|\Z)',
        rb"\${0,2}" + _TRIPLE_RAW,
        rb"\${0,2}" + _DQ,
        _SQ,
    )),
    "kotlin": re.compile(_NEST_SLASH + b"|" + _strings(_TRIPLE_RAW, _DQ, _SQ)),
}

_BLANK = bytes(b if b in b"\n\r" else 0x20 for b in range(256))
_BLOCK_EDGE = re.compile(rb"/\*|\*/")


def _block_end(src: bytes, pos: int) -> int:
    """End of a nesting block comment opened just before ``pos``."""
    depth = 1
    for edge in _BLOCK_EDGE.finditer(src, pos):
        depth += 1 if edge[0] == b"/*" else -1
        if depth == 0:
            return edge.end()
    return len(src)


def regions(language: str, src: bytes) -> list[tuple[int, int, str]]:
    """(start, end, 'string' or 'comment') spans; everything else is code."""
    pattern = PATTERNS.get(language)
    if pattern is None:
        return []
    out, pos = [], 0
    while (m := pattern.search(src, pos)) is not None:
        if m.lastgroup == "nested":
            pos = _block_end(src, m.end())
            out.append((m.start(), pos, "comment"))
        else:
            pos = m.end()
            out.append((m.start(), pos, m.lastgroup))
    return out


def mask(src: bytes, spans: list[tuple[int, int, str]], keep: frozenset[str]) -> bytes:
    """Blank out rejected regions; line ends stay, so every offset survives."""
    out, pos = [], 0
    for start, end, kind in spans:
        code = src[pos:start]
        out.append(code if "code" in keep else code.translate(_BLANK))
        part = src[start:end]
        out.append(part if kind in keep else part.translate(_BLANK))
        pos = end
    tail = src[pos:]
    out.append(tail if "code" in keep else tail.translate(_BLANK))
    return b"".join(out)
