"""Regular expressions of the prose rules, for Spark (Java), and for helpers in Python.

White space and word boundaries are those of the rules' own dialect: ``\\b`` and ``\\w`` are ASCII, white
space includes no-break and other Unicode spaces. Offsets are code points.
"""

from __future__ import annotations

import re

#: White space of the rules' dialect, as the inside of a character class.
SPACES = "\t\n\x0b\x0c\r    -     　﻿"
WS = f"[{SPACES}]"
#: The same one by one.
BLANKS = "".join(c for c in map(chr, range(0x10000)) if re.match(WS, c))
NOT_WS = f"[^{SPACES}]"
#: A word, and the abbreviations that end no sentence.
WORD = "[A-Za-z0-9'’-]+"
ABBREVIATIONS = r"e\.g|i\.e|etc|vs|Mr|Mrs|Ms|Dr|Inc|Ltd|St|No|Fig"
GUARD = "\x01"
#: ASCII word boundary; Java's own is a Unicode one.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
BEFORE_WORD, AFTER_WORD = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: Characters that count as emoji, and the joiners that go with them.
EMOJI = "[\U0001F000-\U0001FAFF☀-➿⬀-⯿\U0001F1E6-\U0001F1FF️‍❤]"
#: What no rule may touch, in the order in which it is looked for; terms come after.
PROTECTED = [
    ("code", r"```[\s\S]*?```"),
    ("inline", r"`[^`\n]+`"),
    ("url", rf"\bhttps?://(?:(?!{WS})[^)>\]])+"),
    ("email", r"\b[\w.+-]+@[\w-]+\.[\w.]+\b"),
]
#: Any of these in a text means that it may hold something protected.
PROTECTED_HINT = "`|https?://|@"

#: What a heading, a passive and a vague connective look like.
HEADING = rf"^#{{1,6}}{WS}"
HEADING_LINE = rf"(?m)^#{{1,6}}{WS}+.*$"
PASSIVE = rf"\b(am|is|are|was|were|been|being|be){WS}+(\w+(?:ed|wn|en))\b({WS}+by\b)?"
#: States that read like a passive and hide nobody.
BENIGN = rf"\b(is|are|was|were){WS}+(based|located|named|called|designed|used|expected|required|needed|allowed|limited)\b"
CONNECTIVE = rf"(?:^|[.!?]{WS}+)(?:Also|However|So),?{WS}"


def java(pattern: str) -> str:
    """A pattern with ``\\b`` in it, for Spark: ASCII boundaries, as Python's re.ASCII has them."""
    return pattern.replace(r"\b", EDGE)


def literal(find: str) -> str:
    """A rule's phrase as a pattern; a straight apostrophe also stands for a curly one."""
    return rf"\b{re.escape(find)}\b".replace("'", "['’]")
