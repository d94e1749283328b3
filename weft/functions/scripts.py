"""One Brahmic script into another: their Unicode blocks are laid out alike, so most letters move by the distance of the blocks."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first code point of each script's block of 128.
BLOCKS = {"Deva": 0x0900, "Beng": 0x0980, "Guru": 0x0A00, "Gujr": 0x0A80, "Orya": 0x0B00, "Taml": 0x0B80, "Telu": 0x0C00, "Knda": 0x0C80, "Mlym": 0x0D00}

# Letters outside the common layout and the letter of the common layout that stands for them, by its place in a block.
# Assamese ra and va, Gurmukhi tippi (as a nasal mark) and Oriya va.
EXCEPTIONS = {"Beng": {0x09F0: 0x30, 0x09F1: 0x35}, "Guru": {0x0A70: 0x02}, "Orya": {0x0B71: 0x35}}

#: Places in a block that all scripts share (the dandas) stay as they are; the last sixteen are each script's own.
SHARED, COMMON = (0x64, 0x65), range(0x00, 0x70)


def has(script: str, place: int) -> bool:
    """Whether a script has a letter at a place of its block."""
    return unicodedata.category(chr(BLOCKS[script] + place)) != "Cn"


def moves(src: str, tgt: str) -> dict[str, str]:
    """Each letter of one script that the other one has, and what it becomes."""
    if src == tgt:
        return {}
    out = {chr(BLOCKS[src] + p): chr(BLOCKS[tgt] + p) for p in COMMON if p not in SHARED and has(src, p) and has(tgt, p)}
    own = {chr(c): chr(BLOCKS[tgt] + p) for c, p in EXCEPTIONS.get(src, {}).items() if has(tgt, p)}
    return out | own


def to_script(x: Column, src: str, tgt: str) -> Column:
    """x with the letters of one script in another; letters that the other lacks, and all else, stay."""
    told = moves(src, tgt)
    return F.translate(x, "".join(told), "".join(told.values())) if told else x


def to_common(x: Column, code: Column, common: str = "Deva") -> Column:
    """x in the common script, by its full language code (as hin_Deva); other scripts stay."""
    script = F.substring_index(code, "_", -1)
    out = None
    for s in BLOCKS:
        own = to_script(x, s, common)
        out = F.when(script == s, own) if out is None else out.when(script == s, own)
    return out.otherwise(x)


def from_common(x: Column, code: Column, common: str = "Deva") -> Column:
    """x out of the common script into that of its language code."""
    script = F.substring_index(code, "_", -1)
    out = None
    for s in BLOCKS:
        own = to_script(x, common, s)
        out = F.when(script == s, own) if out is None else out.when(script == s, own)
    return out.otherwise(x)
