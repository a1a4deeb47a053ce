"""Reader of rich text files: control words, groups and escapes to plain text."""

from __future__ import annotations

import re

from textloom.sources import formats

#: Groups that hold no text, words that stand for characters; fixed values.
HIDDEN = frozenset("fonttbl colortbl stylesheet info pict object header footer headerl headerr footerl footerr listtable listoverridetable rsidtbl generator themedata datastore xmlnstbl fldinst filetbl revtbl".split())
SIGNS = {"par": "\n", "line": "\n", "sect": "\n\n", "page": "\n\n", "tab": "\t", "cell": "|", "row": "\n", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "emspace": " ", "enspace": " "}
_TOKEN = re.compile(r"\\([a-zA-Z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")


def read_rtf(data: bytes, **_) -> tuple[str, str | None]:
    """The text of a rich text file in its declared code page; hidden groups and unknown optional ones are left out."""
    text = data.decode("latin-1")
    if not text.startswith("{\\rtf"):
        raise ValueError("not a rich text file")
    page = re.search(r"\\ansicpg(\d+)", text)
    codec = f"cp{page[1]}" if page else "cp1252"
    out: list[str] = []
    raw = bytearray()
    stack: list[tuple[bool, int]] = []
    hidden, width, skip, starred = False, 1, 0, False

    def flush():
        if raw:
            out.append(bytes(raw).decode(codec, "replace"))
            raw.clear()

    for m in _TOKEN.finditer(text):
        word, number, byte, sign, brace, run = m.groups()
        if brace == "{":
            stack.append((hidden, width))
            starred = False
        elif brace == "}":
            hidden, width = stack.pop() if stack else (False, 1)
        elif word:
            if word in HIDDEN or starred:
                hidden = True
            starred = False
            if word == "uc":
                width = int(number or 1)
            elif hidden:
                continue
            elif word == "u" and number:
                flush()
                out.append(chr(int(number) % 65536))
                skip = width
            elif word in SIGNS:
                flush()
                out.append(SIGNS[word])
        elif sign:
            starred = sign == "*"
            if not hidden and sign in "\\{}":
                raw += sign.encode()
            elif not hidden and sign == "~":
                flush()
                out.append("\u00a0")
        elif byte and not hidden:
            if skip:
                skip -= 1
            else:
                raw.append(int(byte, 16))
        elif run and not hidden:
            cut = run[skip:]
            skip = max(0, skip - len(run))
            raw += cut.encode("latin-1")
    flush()
    joined = "".join(out)
    return joined.encode("utf-16", "surrogatepass").decode("utf-16", "replace"), None


formats.register([".rtf"], read_rtf)
