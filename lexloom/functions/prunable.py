"""Rules that keep a vocabulary entry from being given up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.text import NOT_BLANK, strip

# Character classes of the rules.
BYTE_TOKEN = r"^<0x[0-9A-Fa-f]{2}>\z"
CONTROL_CHARACTER = r"[\x00-\x1f]"
KEPT_SCRIPT = r"[a-zA-Z0-9가-힣]"
SPACE_MARKERS = ("Ġ", "▁")
SHORT_WORD = r"^[\p{L}\p{N}]{1,2}$"


# Code points of digits, superscripts, circled digits and the like (Unicode 15.1).
DIGIT_RANGES = (
    "30-39 b2-b3 b9 660-669 6f0-6f9 7c0-7c9 966-96f 9e6-9ef a66-a6f ae6-aef b66-b6f be6-bef c66-c6f "
    "ce6-cef d66-d6f de6-def e50-e59 ed0-ed9 f20-f29 1040-1049 1090-1099 1369-1371 17e0-17e9 1810-1819 "
    "1946-194f 19d0-19da 1a80-1a89 1a90-1a99 1b50-1b59 1bb0-1bb9 1c40-1c49 1c50-1c59 2070 2074-2079 "
    "2080-2089 2460-2468 2474-247c 2488-2490 24ea 24f5-24fd 24ff 2776-277e 2780-2788 278a-2792 a620-a629 "
    "a8d0-a8d9 a900-a909 a9d0-a9d9 a9f0-a9f9 aa50-aa59 abf0-abf9 ff10-ff19 104a0-104a9 10a40-10a43 "
    "10d30-10d39 10e60-10e68 11052-1105a 11066-1106f 110f0-110f9 11136-1113f 111d0-111d9 112f0-112f9 "
    "11450-11459 114d0-114d9 11650-11659 116c0-116c9 11730-11739 118e0-118e9 11950-11959 11c50-11c59 "
    "11d50-11d59 11da0-11da9 11f50-11f59 16a60-16a69 16ac0-16ac9 16b50-16b59 1d7ce-1d7ff 1e140-1e149 "
    "1e2f0-1e2f9 1e4f0-1e4f9 1e950-1e959 1f100-1f10a 1fbf0-1fbf9 "
)


def character_class(ranges: str) -> str:
    """The regular-expression class of code points given as hexadecimal ranges."""
    ends = [part.partition("-")[::2] for part in ranges.split()]
    return "[" + "".join(f"\\x{{{start}}}-\\x{{{end or start}}}" for start, end in ends) + "]"


DIGITS_ONLY = f"^{character_class(DIGIT_RANGES)}+$"


def keep_rules(token: Column, is_special: Column) -> dict[str, Column]:
    """The rules by name; each is true for tokens that must stay."""
    bare = strip(token)
    return {
        "special": F.coalesce(is_special, F.lit(False)),
        "blank": ~token.rlike(NOT_BLANK),
        "byte": token.rlike(BYTE_TOKEN),
        "control": token.rlike(CONTROL_CHARACTER),
        "digits": bare.rlike(DIGITS_ONLY),
        "symbols": ~bare.rlike(KEPT_SCRIPT),
        "space_marker": reduce(lambda a, b: a | b, [token.contains(mark) for mark in SPACE_MARKERS]),
        "short": bare.rlike(SHORT_WORD),
    }


def is_prunable(token: Column, is_special: Column) -> Column:
    rules = keep_rules(F.coalesce(token, F.lit("")), is_special)
    return ~reduce(lambda a, b: a | b, rules.values())
