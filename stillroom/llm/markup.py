"""What in a text is markup and not words."""

from __future__ import annotations

import re

# Attributes that stand without a value.
BARE = "async|autofocus|autoplay|checked|controls|defer|disabled|hidden|loop|multiple|muted|nowrap|open|readonly|required|reversed|selected"
VALUE = r"""\s*+=\s*+(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'<>]++)"""
# A tag is, at any length: a name or link in angles without a blank; a closing one; one with an equals sign on its line; one over several lines all of whose parts are
# attributes with values or bare ones. Words between a stray < and a quoting sign have no such form and stay.
TAG = re.compile(
    r"</?[a-zA-Z][^<>\s]*+>|</[a-zA-Z][^<>\n]*+>|<[a-zA-Z][\w:-]*+\s(?=[^<>=\n]*+=)[^<>\n]*+>"
    rf"|<[a-zA-Z][\w:-]*+(?:\s++(?:[\w:@.-]++{VALUE}|(?:{BARE})\b))*+\s*+/?>|<!--|-->",
    re.I,
)
