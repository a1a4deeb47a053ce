"""Office equations as LaTeX: one recursive walk, a template for each kind of element."""

from __future__ import annotations

import unicodedata
import xml.etree.ElementTree as ET

M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"

#: Accents and group marks by character; fixed values.
MARKS = {
    "̀": "grave", "́": "acute", "̂": "hat", "̃": "tilde", "̄": "bar", "̅": "overbar", "̆": "breve", "̇": "dot", "̈": "ddot", "̉": "ovhook",
    "̊": "ocirc", "̌": "check", "̐": "candra", "̒": "oturnedcomma", "̕": "ocommatopright", "̚": "droang", "̸": "not", "⃐": "leftharpoonaccent",
    "⃑": "rightharpoonaccent", "⃒": "vertoverlay", "⃖": "overleftarrow", "⃗": "vec", "⃛": "dddot", "⃜": "ddddot", "⃡": "overleftrightarrow", "⃧": "annuity",
    "⃩": "widebridgeabove", "⃰": "asteraccent", "̰": "wideutilde", "̱": "underbar", "⃨": "threeunderdot", "⃬": "underrightharpoondown", "⃭": "underleftharpoondown",
    "⃮": "underleftarrow", "⃯": "underrightarrow", "⎴": "overbracket", "⏜": "overparen", "⏞": "overbrace", "⎵": "underbracket", "⏝": "underparen", "⏟": "underbrace",
}
#: Large operators and symbols by character; fixed values.
LARGE = {"⅀": "Bbbsum", "∏": "prod", "∐": "coprod", "∑": "sum", "∫": "int", "⋀": "bigwedge", "⋁": "bigvee", "⋂": "bigcap", "⋃": "bigcup", "⨀": "bigodot", "⨁": "bigoplus", "⨂": "bigotimes"}
SYMBOLS = {
    "←": "leftarrow", "↑": "uparrow", "→": "rightarrow", "↓": "downarrow", "↔": "leftrightarrow", "↕": "updownarrow", "↖": "nwarrow", "↗": "nearrow", "↘": "searrow", "↙": "swarrow",
    "⋮": "vdots", "⋯": "cdots", "⋰": "adots", "⋱": "ddots", "≠": "ne", "≤": "leq", "≥": "geq", "≦": "leqq", "≧": "geqq", "≨": "lneqq", "≩": "gneqq", "≪": "ll", "≫": "gg", "∈": "in", "∉": "notin",
    "∋": "ni", "∌": "nni", "∞": "infty", "±": "pm", "∓": "mp",
}
#: Variant letters of the italic alphabet, whose names do not follow from their letters; fixed values.
VARIANTS = {"\U0001d70d": "varsigma", "\U0001d715": "partial", "\U0001d716": "varepsilon", "\U0001d717": "vartheta", "\U0001d718": "varkappa", "\U0001d719": "varphi", "\U0001d71a": "varrho", "\U0001d71b": "varpi"}
#: Function names LaTeX has commands for; those it has none for are operators.
FUNCTIONS = "sin cos tan arcsin arccos arctan sinh cosh tanh coth sec csc log ln exp det gcd lim max min sup inf dim ker hom deg arg".split()
LIMITS = ("lim", "max", "min")
_SPECIAL = "{}_^#&$%~"


def _letter(c: str) -> str:
    """A character of a run: italic letters plain, Greek ones and symbols as commands with a space behind."""
    if c in SYMBOLS:
        return f"\\{SYMBOLS[c]} "
    if c in VARIANTS:
        return f"\\{VARIANTS[c]} "
    if c == "ℎ" or "\U0001d434" <= c <= "\U0001d467":
        return unicodedata.normalize("NFKC", c)
    if "\U0001d6fc" <= c <= "\U0001d714":
        return "\\" + unicodedata.name(unicodedata.normalize("NFKC", c)).rsplit(" ", 1)[-1].lower().replace("lamda", "lambda") + " "
    return c


def _escaped(text: str) -> str:
    out = ""
    for c in text.replace("\\\\", "\\"):
        out += "\\" + c if c in _SPECIAL and not out.endswith("\\") else c
    return out


def _value(e: ET.Element, pr: str, name: str) -> str | None:
    found = e.find(f"{M}{pr}/{M}{name}")
    return found.get(M + "val") if found is not None else None


def _has(e: ET.Element, pr: str, name: str) -> bool:
    return e.find(f"{M}{pr}/{M}{name}") is not None


def _kids(e: ET.Element, *only: str) -> list[str]:
    return [latex(k) for k in e if not only or k.tag in {M + x for x in only}]


def _part(e: ET.Element, name: str) -> str:
    return "".join(latex(k) for k in e if k.tag == M + name)


def _mark(char: str | None, other: str, body: str) -> str:
    return f"\\{MARKS[char]}{{{body}}}" if char in MARKS else f"\\{other}{{{body}}}" if char is None else f"{char}{{{body}}}"


def _name(e: ET.Element) -> str:
    """A function's name with {fe} where its argument goes; neighbouring runs are one name."""
    out, run = "", ""

    def close() -> str:
        return "" if not run else f"\\{run}({{fe}})" if run in FUNCTIONS else f"\\operatorname{{{run}}}({{fe}})"

    for k in e:
        if k.tag == M + "r":
            run += latex(k)
        else:
            out, run = out + close() + latex(k), ""
    out += close()
    return out if "{fe}" in out else out + "{fe}"


def _fence(char: str | None, given: bool, other: str) -> str:
    if not given:
        return other
    return _escaped(_letter(char)) if char else "."


def latex(e: ET.Element) -> str:
    """LaTeX of an equation's element; property elements and unknown ones are empty."""
    tag = e.tag.removeprefix(M) if e.tag.startswith(M) else ""
    body = lambda: "".join(_kids(e))
    if tag == "r":
        return _escaped("".join(_letter(c) for c in (e.findtext(M + "t") or "")))
    if tag in ("oMath", "oMathPara", "box", "sSub", "sSup", "sSubSup", "num", "den", "deg", "e"):
        return body()
    if tag in ("sub", "sup"):
        return ("_" if tag == "sub" else "^") + f"{{{body()}}}"
    if tag == "acc":
        return _mark(_value(e, "accPr", "chr"), "hat", _part(e, "e"))
    if tag == "groupChr":
        return _mark(_value(e, "groupChrPr", "chr"), "underbrace", _part(e, "e"))
    if tag == "bar":
        return f"\\{'underline' if _value(e, 'barPr', 'pos') == 'bot' else 'overline'}{{{_part(e, 'e')}}}"
    if tag == "f":
        top, bottom = _part(e, "num"), _part(e, "den")
        kind = _value(e, "fPr", "type")
        return {"skw": f"^{{{top}}}/_{{{bottom}}}", "lin": f"{{{top}}}/{{{bottom}}}", "noBar": f"\\genfrac{{}}{{}}{{0pt}}{{}}{{{top}}}{{{bottom}}}"}.get(kind, f"\\frac{{{top}}}{{{bottom}}}")
    if tag == "d":
        left, right = (_fence(_value(e, "dPr", n), _has(e, "dPr", n), other) for n, other in (("begChr", "("), ("endChr", ")")))
        return f"\\left{left}{_part(e, 'e')}\\right{right}"
    if tag == "rad":
        deg = _part(e, "deg")
        return f"\\sqrt[{deg}]{{{_part(e, 'e')}}}" if deg else f"\\sqrt{{{_part(e, 'e')}}}"
    if tag == "func":
        return "".join(_name(k) for k in e if k.tag == M + "fName").replace("{fe}", _part(e, "e"))
    if tag == "fName":
        return _name(e)
    if tag == "eqArr":
        return f"\\begin{{array}}{{c}}{'\\\\'.join(_kids(e, 'e'))}\\end{{array}}"
    if tag == "limLow":
        base, limit = _part(e, "e"), _part(e, "lim")
        if base not in LIMITS:
            raise ValueError(f"no limit form of {base}")
        return f"\\{base}_{{{limit}}}"
    if tag == "limUpp":
        return f"\\overset{{{_part(e, 'lim')}}}{{{_part(e, 'e')}}}"
    if tag == "lim":
        return body().replace("\\rightarrow", "\\to")
    if tag == "m":
        return f"\\begin{{matrix}}{'\\\\'.join(_kids(e, 'mr'))}\\end{{matrix}}"
    if tag == "mr":
        return "&".join(_kids(e, "e"))
    if tag == "nary":
        char = _value(e, "naryPr", "chr")
        return (f"\\{LARGE[char]}" if char in LARGE else char or "") + "".join(_kids(e, "sub", "sup", "e"))
    return ""
