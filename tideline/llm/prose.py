"""The prose of an article in LaTeX, piece by piece.

Pieces are what blank lines separate; they keep their number although parts are
taken out. Out go: what stands before the document begins and after it ends,
comments, parts switched off, formulas, floats, tables, headings, captions,
references, bibliography and all commands. Accents become letters.
"""

from __future__ import annotations

import re
import unicodedata

#: Separates pieces in the text worked on.
GAP = "\x1d"

_EDGES = re.compile(r"\A(?:[^\S\n]*\n)+|(?:\n[^\S\n]*)+\Z")
_BEGIN = re.compile(r"(?:^|(?<=\x1d))[^%\n\x1d]*?\\begin\{document\}", re.M)
_END = re.compile(r"(?:^|(?<=\x1d))[^%\n\x1d]*?\\end\{document\}", re.M)
_SPLIT = re.compile(r"\n(?:[^\S\n]*\n)+")

_OUT = (
    "comment|figure|table|tabular|tabularx|longtable|array|equation|align|alignat|gather|multline|eqnarray|displaymath|math|flalign|"
    "thebibliography|verbatim|lstlisting|tikzpicture|filecontents|algorithm|algorithmic|titlepage|subequations"
)
_ARGUMENT = (
    "title|author|date|thanks|affiliation|email|address|part|chapter|(?:sub)*section|(?:sub)?paragraph|caption|label|ref|eqref|pageref|autoref|cref|Cref|"
    "cite|citep|citet|citealp|citeauthor|nocite|input|include|includegraphics|bibliography|bibliographystyle|addbibresource|usepackage|documentclass|"
    "selectlanguage|url|href|hypersetup|graphicspath|pagestyle|thispagestyle|vspace|hspace|setlength|setcounter|newcommand|renewcommand|providecommand|"
    "DeclareMathOperator|def|let|theoremstyle|newtheorem|newenvironment|begin|end|bibitem|keywords|pacs|markboth|index|ensuremath"
)
_NESTED = r"\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}"
_MASK = re.compile(
    r"%[^\n\x1d]*"
    r"|\$\$.*?(?:\$\$|\Z)|\$(?:\\.|[^$\\\x1d])*\$?"
    rf"|\\begin\{{({_OUT})(\*?)\}}.*?(?:\\end\{{\1\2\}}|\Z)"
    r"|\\iffalse(?![A-Za-z]).*?(?:\\fi(?![A-Za-z])|\Z)"
    r"|\\\[.*?(?:\\\]|\Z)|\\\(.*?(?:\\\)|\Z)"
    rf"|\\(?:{_ARGUMENT})\*?(?![A-Za-z])(?:\\[A-Za-z]+|[^\S\n]*(?:\[[^\]\x1d]*\][^\S\n]*)*)(?:{_NESTED})*"
    r"|\\[%$&#_{}\\ ,;:!/>-]",
    re.S,
)
_ACCENT = re.compile(
    r"\\(?:([\"'`^~=.])\s*(?:\{\\?([A-Za-z])\}|\\?([A-Za-z]))|([cvuHkr])(?:\s*\{([A-Za-z])\}|\s+([A-Za-z])(?![A-Za-z]))|(ss|ae|oe|aa|AE|OE|AA|o|O|l|L|i|j)(?![A-Za-z])(?:\{\}|[^\S\n]+)?)"
)
_COMMAND = re.compile(r"\\[A-Za-z@]+\*?|\\")
_BRACES = str.maketrans("", "", "{}")

#: The combining mark of an accent command, and the letters that have a command.
MARKS = {'"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "u": "\u0306", "H": "\u030b", "k": "\u0328", "r": "\u030a"}
LETTERS = {"ss": "ß", "ae": "æ", "oe": "œ", "aa": "å", "AE": "Æ", "OE": "Œ", "AA": "Å", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "i": "i", "j": "j"}


def pieces(text: str) -> list[str]:
    """What one or more lines of white space separate, those at both ends left out."""
    return _SPLIT.split(_EDGES.sub("", text.replace("\r\n", "\n").replace("\r", "\n").replace(GAP, " ")))


def _hidden(m: re.Match) -> str:
    s = m[0]
    if GAP in s:
        return " " + GAP * s.count(GAP)
    return "" if s in ("\\-", "\\/") else " "


def _letter(m: re.Match) -> str:
    a, x, y, b, u, v, name = m.groups()
    return LETTERS[name] if name else (x or y or u or v) + MARKS[a or b]


def prose(text: str) -> tuple[int, str]:
    """Number of the first piece kept, and the prose with ``GAP`` between pieces."""
    t = GAP.join(pieces(text))
    first = 1
    if (m := _BEGIN.search(t)) is not None:
        first += t.count(GAP, 0, m.end())
        t = t[m.end() :]
        if (m := _END.search(t)) is not None:
            t = t[: m.start()]
    t = _MASK.sub(_hidden, t)
    if "\\" in t:
        t = _COMMAND.sub(" ", _ACCENT.sub(_letter, t))
    t = t.translate(_BRACES) if "{" in t or "}" in t else t
    if not t.isascii() and not unicodedata.is_normalized("NFKC", t):
        t = unicodedata.normalize("NFKC", t)
    return first, t
