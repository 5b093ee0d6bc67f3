"""How texts fall apart into pieces that a byte-pair tokenizer treats on their own.

A lump is a stretch without white space, with the space before it where the
tokenizer keeps spaces. No pre-token reaches across a lump's edge, so a text's
tokens are its lumps' tokens in a row. White space is that of Unicode; Python's
own rule has U+001C to U+001F besides, which texts with these characters avoid.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache

SPACE = r"\x09-\x0d\x20\x85\xa0  -     　"
RUN = re.compile(f"[^{SPACE}]+")
SPACED = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Spaces that open a lump whatever stands elsewhere.
APART = re.compile(f"(?<![{SPACE}]) ")
ODD = re.compile("[\x1c-\x1f]")
#: ASCII signs, which are neither letters, digits nor space.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Patterns for Arrow: where a text has other spaces than those before a lump, white space or nothing, and the end that `stem` takes off.
_SPACE = SPACE.replace(r"\x85", "\u0085").replace(r"\xa0", "\u00a0")
DOUBLE = f"(?:^|[{_SPACE}]) "
EMPTY_OR_ANY = f"^$|[{_SPACE}]"
ENDS = f"(?s)^(?P<core>.*[A-Za-z0-9])(?P<tail>[{re.escape(SIGNS)}]+)$"


def bare(text: str) -> list[str]:
    """Lumps without white space."""
    return RUN.findall(text) if ODD.search(text) else text.split()


def spaced(text: str) -> list[str]:
    """Lumps with the space before them, and runs of other white space."""
    return SPACED.findall(text)


def stem(lump: str) -> str:
    """The lump without the signs at its end, if they make pre-tokens of their own; else the lump.

    They do after an ASCII letter or digit, whatever normal form and lower case make of
    the text; other letters may end in a mark then, which goes with the signs."""
    core = lump.rstrip(SIGNS)
    return core if core and core is not lump and core[-1].isascii() and core[-1].isalnum() else lump


def lowered(text: str) -> str | None:
    """The text in lower case where it has Latin-1 characters alone, which the Unicode normal form leaves as they are; else None."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return text.lower()


class Cache(dict):
    """What `make` gives for a lump, made when it is first asked for.

    Beyond `most` entries all become old; those asked for again are taken over from
    there, the others go when it happens next. So what occurs often is made once."""

    def __init__(self, make: Callable[[str], object], most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, lump: str):
        known = self.old.get(lump)
        if known is None:
            known = self.make(lump)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[lump] = known
        return known


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The library's tokenizer, loaded once in a process, without threads of its own: each core has a task already."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t
