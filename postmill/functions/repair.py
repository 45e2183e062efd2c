"""Repair of JSON that a model wrote almost right.

One walk over the text with a stack of open brackets and the state of the string it is in. A quote ends a
string only where what follows can follow a string; any other quote belongs to the text and is
escaped, and so are raw line breaks. Closing brackets first close what still stands open inside; at the
end of a text that was cut off everything open is closed, a key without a value getting null.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_VALUE = re.compile(r'\s*(?:["{\[\d-]|true|false|null)')
_NEXT_KEY = re.compile(r'\s*"(?:[^"\\]|\\.)*"\s*:')
_BARE = re.compile(r"[^\s,:\[\]{}\"]+")
_ESCAPE = re.compile(r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})')
_CUT_ESCAPE = re.compile(r"\\(?:u[0-9a-fA-F]{0,3})?\Z")
_END = re.compile(r"[\s,\]}]*\Z")
_RAW = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}


def _ends_string(text: str, after: int, inside: str | None, key: bool) -> bool:
    """Whether a quote just before `after` ends its string, given the bracket around it."""
    rest = after
    while rest < len(text) and text[rest].isspace():
        rest += 1
    if rest == len(text):
        return True
    mark = text[rest]
    if key:
        return mark == ":"
    if mark == ",":
        # A comma inside prose looks the same; after a real one the next key or value begins, or the end.
        follows = _NEXT_KEY if inside == "{" else _VALUE
        return bool(follows.match(text, rest + 1) or _END.match(text, rest + 1))
    if mark in "]}":
        return inside == ("[" if mark == "]" else "{") or bool(_END.match(text, rest + 1))
    return mark == '"' and inside == "{" and bool(_NEXT_KEY.match(text, rest))


def repaired(text: str | None) -> str | None:
    """The text as JSON as far as it can be told, null where no bracket opens."""
    if text is None or not re.match(r"\s*[\[{]", text):
        return None
    out: list[str] = []
    stack: list[str] = []
    key = [False]  # for each open bracket whether a key comes next
    state = "value"  # what is due: value, or more (a comma or an end)
    at = 0

    def drop_comma() -> None:
        if out and out[-1] == ",":
            out.pop()

    def close() -> None:
        drop_comma()
        if stack[-1] == "{" and out and out[-1] == ":":
            out.append("null")
        out.append("}" if stack.pop() == "{" else "]")
        key.pop()

    while at < len(text):
        c = text[at]
        if c.isspace():
            at += 1
            continue
        if c in "}]":
            wanted = "{" if c == "}" else "["
            if wanted in stack:
                while stack[-1] != wanted:
                    close()
                close()
                state = "more"
                if not stack:
                    break
            at += 1
            continue
        if c == "," or c == ":":
            if out and out[-1] not in (",", ":", "{", "["):
                out.append(c)
                key[-1] = c == "," and bool(stack) and stack[-1] == "{"
                state = "value"
            at += 1
            continue
        if state == "more":
            # Two values in a row lack a comma.
            out.append(",")
            key[-1] = stack[-1] == "{"
        if c in "{[":
            out.append(c)
            stack.append(c)
            key.append(c == "{")
            state = "value"
            at += 1
            continue
        naming = key[-1]
        if c == '"':
            piece, at = ['"'], at + 1
            while at < len(text):
                c = text[at]
                if c == "\\":
                    escape = _ESCAPE.match(text, at)
                    if not escape and not _CUT_ESCAPE.match(text, at):
                        piece.append("\\\\")
                    elif escape:
                        piece.append(escape[0])
                    at = escape.end() if escape else at + 1 if not _CUT_ESCAPE.match(text, at) else len(text)
                    continue
                at += 1
                if c == '"':
                    if _ends_string(text, at, stack[-1] if stack else None, naming):
                        break
                    piece.append('\\"')
                else:
                    piece.append(_RAW.get(c, c) if c >= " " else _RAW.get(c, " "))
            out.append("".join(piece) + '"')
        else:
            word = _BARE.match(text, at)
            at = word.end()
            known = re.fullmatch(r"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?|true|false|null", word[0])
            cut_off = {"t": "true", "f": "false", "n": "null"}.get(word[0][0]) if at == len(text) else None
            plain = {"None": "null", "True": "true", "False": "false"}.get(word[0])
            if naming or not (known or plain or (cut_off and cut_off.startswith(word[0]))):
                out.append('"' + word[0].replace("\\", "\\\\") + '"')
            else:
                out.append(plain or (word[0] if known else cut_off))
        if naming:
            key[-1] = False
            state = "value"
            rest = text[at:].lstrip()
            if not rest.startswith(":"):
                out.append(":")
                if not rest or rest[0] in ",}":
                    out.append("null")
                    state = "more"
        else:
            state = "more"
    while stack:
        close()
    return "".join(out)


@F.pandas_udf(StringType())
def repair_json(text: pd.Series) -> pd.Series:
    return text.map(repaired, na_action="ignore")
