"""Word classes shared by the text operators, with one meaning in Java and in Python."""

from __future__ import annotations

import re
import sys
import unicodedata

#: Every Unicode White_Space character, no-break spaces included.
SPACES = "\t-\r \x85\xa0" + chr(0x2000) + "-" + chr(0x200A) + "".join(map(chr, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
NON_SPACE = re.compile(f"[^{SPACES}]+")
JAVA_NON_SPACE = r"[^\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _ranges(keep) -> str:
    """A character class of the code points for which ``keep`` holds."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        ok = c <= sys.maxunicode and keep(chr(c))
        if ok and start is None:
            start = c
        elif not ok and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


#: Numeric characters that are no decimal digits (fractions, superscripts) count as separators.
_OTHER_NUMERIC = _ranges(lambda c: c.isalnum() and unicodedata.category(c)[0] != "L" and unicodedata.category(c) != "Nd")
#: Runs of letters and decimal digits.
ALNUM = re.compile(f"[^\\W_{_OTHER_NUMERIC}]+")
