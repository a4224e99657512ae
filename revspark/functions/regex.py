"""RE2 patterns in Java's dialect."""

from __future__ import annotations

_WORD = "(?-iu:[A-Za-z0-9_])"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_SPACE = r"\t\n\f\r "


def java_pattern(pattern: str) -> str:
    """The same matches from java.util.regex as RE2 finds on single lines.

    Only \\n ends a line, case folds beyond ASCII, white space and word boundaries are ASCII, and $ is the
    end of the text.
    """
    out, at, in_class = ["(?d)"], 0, False
    while at < len(pattern):
        two = pattern[at : at + 2]
        if pattern.startswith("(?i)", at) and not in_class:
            out.append("(?iu)")
            at += 4
        elif two[0] == "\\" and len(two) == 2:
            if two == r"\s":
                out.append(_SPACE if in_class else f"[{_SPACE}]")
            elif two == r"\b" and not in_class:
                out.append(_BOUNDARY)
            else:
                out.append(two)
            at += 2
        else:
            c = pattern[at]
            if c == "[":
                if in_class:
                    c = r"\["  # RE2 takes it literally, Java opens a nested class
                else:
                    in_class = True
                    if pattern[at + 1 : at + 2] == "]":
                        out.append(r"[\]")
                        at += 2
                        continue
            elif c == "]" and in_class:
                in_class = False
            elif c == "$" and not in_class:
                c = r"\z"
            out.append(c)
            at += 1
    return "".join(out)
