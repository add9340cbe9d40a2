"""Substrings a regular expression cannot match without.

A substring test costs a small fraction of a case-insensitive regex. ``needed`` names, for a
pattern, a set of lower-case strings of which every matching text holds at least one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from re import _constants as C
    from re import _parser as parser
except ImportError:  # Python before 3.11
    import sre_constants as C
    import sre_parse as parser

# Letters outside ASCII that match an ASCII letter when case is ignored.
FOLDED, INTO = "ſıİK", "siik"
CLASS_LIMIT = 4


def folded(text: Column) -> Column:
    """Lower case such that ASCII literals are found wherever a case-insensitive regex finds them."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.lower(F.translate(text, FOLDED, INTO)))


def _worth(options: set[str]) -> int:
    """Long and unusual strings filter best; a letter or digit on its own filters nothing."""
    return min(len(o) + 2 * sum(not c.isalnum() and c != " " for c in o) for o in options) if all(options) else 0


def _options(op, arg) -> set[str] | None:
    if op is C.SUBPATTERN:
        return _best(arg[-1])
    if op is C.BRANCH:
        each = [_best(b) for b in arg[1]]
        return set().union(*each) if all(each) else None
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
        return _best(arg[2])
    if op is C.IN and len(arg) <= CLASS_LIMIT and all(o is C.LITERAL for o, _ in arg):
        return {chr(c).lower() for _, c in arg}
    return None


def _best(sequence) -> set[str] | None:
    found, run = [], ""
    for op, arg in [*sequence, (None, None)]:
        if op is C.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        if run:
            found.append({run})
            run = ""
        more = _options(op, arg)
        if more:
            found.append(more)
    found = [f for f in found if _worth(f) > 1]
    return max(found, key=lambda f: (_worth(f), min(map(len, f)))) if found else None


def needed(pattern: str) -> set[str] | None:
    """None where no such set is known, as for patterns this reader does not understand."""
    try:
        return _best(parser.parse(pattern, re.IGNORECASE))
    except re.error:
        return None
