"""Code point classes of the byte-level pre-tokenizer: letters, numbers and white space.

The tokenizers library carries Unicode tables of its own. They are those of Python's unicodedata with what a later version
of the standard adds; a test asks the library's pre-tokenizer about every code point.
"""

import functools
import unicodedata

import numpy as np

OTHER, LETTER, NUMBER, WHITE, SPACE = range(5)

# Ranges, both ends included, that Unicode 16.0 added to the letters and numbers of 15.1.
_ADDED_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
_ADDED_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Separators of files, groups, records and units: white space to Python alone.
_NO_WHITE = (0x1C, 0x1F)
#: No letter or number stands from here on.
_END = 0x40000


@functools.cache
def table() -> np.ndarray:
    """Class of every code point, as uint8."""
    out = np.zeros(0x110000, np.uint8)
    category = unicodedata.category
    kinds = {"L": LETTER, "N": NUMBER, "Z": WHITE}
    out[:_END] = np.fromiter((kinds.get(category(chr(i))[0], OTHER) for i in range(_END)), np.uint8, _END)
    out[[i for i in range(256) if chr(i).isspace()]] = WHITE
    out[_NO_WHITE[0] : _NO_WHITE[1] + 1] = OTHER
    for kind, ranges in ((LETTER, _ADDED_LETTERS), (NUMBER, _ADDED_NUMBERS)):
        for a, b in ranges:
            out[a : b + 1] = kind
    out[32] = SPACE
    return out
