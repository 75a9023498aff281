"""Parts of texts that byte-level BPE codes on their own."""

from __future__ import annotations

import re

#: A space beside another white space or at the end.
_ODD = re.compile(r" \s|[^\S ] | \Z")
_CUT = re.compile(r"(?<=\S)(?= \S)")


def parts(text: str) -> list[str]:
    """The text, cut before each single space between two solid characters: there the pre-tokenizer always cuts too."""
    if _ODD.search(text):
        return _CUT.split(text)
    head, *rest = text.split(" ")
    out = [" " + p for p in rest]
    return [head, *out] if head else out
