"""Globs to regular expressions that Java's engine and RE2 both read."""

from __future__ import annotations

import re


class GlobError(ValueError):
    """A pattern that can't be used."""


def to_regex(glob: str) -> str:
    """``*`` and ``?`` stay in a component, ``**`` crosses, ``[..]`` is a class, ``{a,b}`` a choice; ``\\`` is read as
    ``/``.  Case counts.  Empty patterns, a leading ``/`` and unclosed brackets are refused."""
    text = glob.replace("\\", "/")
    if not text or text.startswith("/"):
        raise GlobError(f"pattern {glob!r} is empty or absolute")
    out, at, open_choices = [], 0, 0
    while at < len(text):
        if text.startswith("**/", at) and (at == 0 or text[at - 1] == "/"):
            out.append("(?:[^/]+/)*")
            at += 3
        elif text.startswith("/**", at) and at + 3 == len(text):
            out.append("/.+")
            at += 3
        elif text.startswith("**", at):
            out.append(".*")
            at += 2
        elif text[at] == "*":
            out.append("[^/]*")
            at += 1
        elif text[at] == "?":
            out.append("[^/]")
            at += 1
        elif text[at] == "[":
            end = text.find("]", at + 2)
            if end < 0:
                raise GlobError(f"pattern {glob!r} has an unclosed class")
            inner = text[at + 1 : end]
            turned = inner[0] in "!^"
            inner = inner[1:] if turned else inner
            body = re.sub(r"([\\\[\]&~^])", r"\\\1", inner)
            out.append(f"[^/{body}]" if turned else f"[{body}]")
            at = end + 1
        elif text[at] == "{":
            open_choices += 1
            out.append("(?:")
            at += 1
        elif text[at] == "}" and open_choices:
            open_choices -= 1
            out.append(")")
            at += 1
        elif text[at] == "," and open_choices:
            out.append("|")
            at += 1
        else:
            out.append(re.escape(text[at]).replace("\\/", "/"))
            at += 1
    if open_choices:
        raise GlobError(f"pattern {glob!r} has an unclosed choice")
    return "(?s)^" + "".join(out) + "$"
