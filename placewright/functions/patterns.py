"""Checks user regular expressions and rewrites them for the JVM's engine.

Patterns follow the common linear-time dialect: Unicode classes, no lookaround, no back-references,
no word boundaries beyond ASCII. Whatever the JVM would read differently is rewritten or refused.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# POSIX class members, ASCII only.
_POSIX = {
    "alnum": r"0-9A-Za-z",
    "alpha": r"A-Za-z",
    "ascii": r"\x00-\x7F",
    "blank": r"\t ",
    "cntrl": r"\x00-\x1F\x7F",
    "digit": r"0-9",
    "graph": r"!-~",
    "lower": r"a-z",
    "print": r" -~",
    "punct": r"!-/:-@\[-`{-~",
    "space": r"\t\n\x0B\f\r ",
    "upper": r"A-Z",
    "word": r"0-9A-Za-z_",
    "xdigit": r"0-9A-Fa-f",
}

_TOKEN = re.compile(
    r"""
      (?P<property>\\[pP](?:\{[^}]*\}|.))
    | (?P<wide>\\[xuU]\{[0-9A-Fa-f]+\} | \\U[0-9A-Fa-f]{8})
    | (?P<escape>\\(?:.|\Z))
    | (?P<posix>\[:\^?[a-z]+:\])
    | (?P<group>\(\?P?<[A-Za-z_][\w.\[\]]*>)
    | (?P<flags>\(\?[a-zA-Z-]*[:)])
    | (?P<special>\(\?)
    | (?P<repeat>(?:[*+?]|\{(?:[0-9]+(?:,[0-9]*)?|,[0-9]+)\})[+?]?)
    | (?P<other>.)
    """,
    re.VERBOSE | re.DOTALL,
)
_PLAIN_ESCAPES = set("afntrxuAzdDsSwW")


def _property(token: str) -> str:
    name = token[2:].strip("{}")
    negated = token[1] == "P"
    if name.startswith("^"):
        name, negated = name[1:], not negated
    if len(name) > 2 and "=" not in name:
        name = f"Is{name}"
    return rf"\{'P' if negated else 'p'}{{{name}}}"


def _escape(token: str) -> str:
    char = token[1:]
    if char == "v":
        return r"\x0B"
    if not char or (char.isalnum() and char not in _PLAIN_ESCAPES) or char in "<>":
        raise ValueError(f"unsupported escape {token!r} in regular expression")
    return token


def translate(pattern: str) -> str:
    """The JVM form of ``pattern``, or ``ValueError``."""
    out: list[str] = []
    depth = 0  # of nested character classes
    class_start = False
    multi_line = False
    for match in _TOKEN.finditer(pattern):
        kind, token = match.lastgroup, match.group()
        at_start, class_start = class_start, False
        if kind == "property":
            out.append(_property(token))
        elif kind == "wide":
            out.append(rf"\x{{{token[2:].strip('{}')}}}")
        elif kind == "escape":
            out.append(_escape(token))
        elif depth:
            if kind == "posix":
                name = token[2:-2]
                members = _POSIX.get(name.lstrip("^"))
                if members is None:
                    raise ValueError(f"unknown class {token!r} in regular expression")
                out.append(f"[^{members}]" if name.startswith("^") else members)
                continue
            for char in token:
                if char == "[":
                    depth, class_start = depth + 1, True
                    out.append(char)
                elif char == "]" and at_start:
                    out.append(r"\]")
                elif char == "]":
                    depth -= 1
                    out.append(char)
                elif char == "^" and at_start:
                    class_start = True
                    out.append(char)
                elif char in "-~" and pattern[match.start() : match.start() + 2] == char * 2:
                    raise ValueError(f"unsupported class operator {char * 2!r} in regular expression")
                else:
                    out.append(char)
                at_start = False
        elif kind == "group":
            out.append("(?:")
        elif kind == "flags":
            if set(token) & set("uUR"):
                raise ValueError(f"unsupported flags {token!r} in regular expression")
            multi_line = multi_line or "m" in token.split("-")[0]
            out.append(token)
        elif kind == "special":
            raise ValueError("lookaround and atomic groups are not supported")
        elif kind == "repeat":
            if len(token) > 1 and token.endswith("+"):
                raise ValueError(f"unsupported repetition {token!r} in regular expression")
            out.append(token.replace("{,", "{0,"))
        elif token == "{":
            raise ValueError("unescaped { in regular expression")
        elif token == "$":
            out.append(token if multi_line else r"\z")
        else:
            if token == "[" or kind == "posix":
                depth, class_start = depth + 1, True
            if kind == "posix":  # `[:x:]` outside a class is a class of those characters
                depth, class_start = depth - 1, False
            out.append(token)
    if depth:
        raise ValueError("unclosed character class in regular expression")
    return "".join(out)


def required_literals(pattern: str) -> tuple[str, list[str]]:
    """What every match begins with, and texts that it contains besides, as far as that is plain to see.

    Looked at are characters outside groups and classes, which have to be there unless the repetition after
    them allows none; not if the pattern has alternatives outside groups, or flags, which may change what characters mean.
    """
    if "[]" in pattern or "[^]" in pattern:  # a bracket that does not close its class
        return "", []
    runs: list[str] = [""]  # of literals that follow each other
    anchored, only_prefix = False, True  # whether the first run is all there is so far
    classes = groups = 0
    last = False  # whether the last token was a literal
    for match in _TOKEN.finditer(pattern):
        kind, token = match.lastgroup, match.group()
        literal = ""
        if (kind == "flags" and token != "(?:") or (kind == "other" and token == "|" and not classes and not groups):
            return "", []
        if classes or kind == "posix":
            if kind == "other":
                classes += {"[": 1, "]": -1}.get(token, 0)
        elif kind in ("group", "special", "flags"):
            groups += 1
        elif kind == "other" and token in "[()":
            classes += token == "["
            groups += {"(": 1, ")": -1}.get(token, 0)
        elif groups:
            pass
        elif kind == "repeat":
            if last and not re.match(r"\+|\{0*[1-9]", token):  # the character before may be missing
                runs[-1] = runs[-1][:-1]
        elif kind == "other" and token == "^" and match.start() == 0:
            anchored = True
            continue
        elif kind == "other" and token not in ".^$":
            literal = token
        elif kind == "escape" and len(token) == 2 and not token[1].isalnum() and token[1] not in "<>":
            literal = token[1]
        if literal:
            runs[-1] += literal
        elif runs[-1] or only_prefix:
            runs.append("")
            only_prefix = False
        last = bool(literal)
    if classes or groups:
        return "", []
    prefix = runs[0] if anchored else ""
    return prefix, [run for run in runs[1 if anchored else 0 :] if run]


def checked(spark: SparkSession, pattern: str) -> str:
    """``pattern`` itself, after the JVM's engine has accepted its translation."""
    probe = spark.range(1).select(F.lit("").rlike(translate(pattern)))
    try:
        probe.head()
    except Exception as problem:
        if "regex" not in str(problem).lower():
            raise
        raise ValueError(f"invalid regular expression {pattern!r}") from problem
    return pattern
