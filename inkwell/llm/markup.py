"""Clean text from HTML, wiki, Markdown and LaTeX markup, with its structure kept (problem 1).

The method named for this problem aligns pages of one host into wrappers. The articles have no host and every one has
its own mix of leftovers, so no two token streams share a template; this operator parses the four languages instead.
Code and formulas are set aside first, so that signs in them are not taken for markup. Every construct that is taken
away or rewritten counts as a mark; a sign in its ordinary meaning (2 * 3, a < b, $5, snake_case, [sic]) isn't one.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names that make <...> a tag.
TAGS = (
    "a abbr article aside b bdi bdo big blockquote body br caption center cite code col colgroup dd del details dfn div dl dt em figcaption figure font footer "
    "gallery h1 h2 h3 h4 h5 h6 head header hr html i iframe img includeonly input ins kbd li link main mark math meta nav noinclude nowiki ol onlyinclude p poem pre q "
    "ref references s samp script section small source span strike strong style sub summary sup syntaxhighlight table tbody td templatestyles tfoot th thead time title tr tt u ul var video"
).split()
# Wiki namespaces whose links are not text, and options of media links.
MEDIA = "file image datei bild fichier archivo ficheiro plik файл media".split()
CATEGORIES = "category kategorie catégorie categoría categoria kategoria категория".split()
OPTIONS = r"(?:thumb|thumbnail|frame|framed|frameless|border|left|right|center|centre|none|mini|miniatur|upright(?:=[\d.]+)?|\d*x?\d+ ?px|alt=[^|\n]*|link=[^|\n]*|baseline|sub|super|top|middle|bottom)"
# LaTeX commands that need no argument, as signs of text.
SYMBOLS = {
    "le": "≤", "leq": "≤", "ge": "≥", "geq": "≥", "ne": "≠", "neq": "≠", "times": "×", "cdot": "·", "div": "÷", "pm": "±", "mp": "∓", "sum": "∑", "prod": "∏", "int": "∫", "infty": "∞",
    "in": "∈", "notin": "∉", "subset": "⊂", "cup": "∪", "cap": "∩", "to": "→", "rightarrow": "→", "leftarrow": "←", "Rightarrow": "⇒", "approx": "≈", "equiv": "≡", "sim": "∼", "partial": "∂",
    "nabla": "∇", "forall": "∀", "exists": "∃", "ldots": "…", "dots": "…", "cdots": "⋯", "sqrt": "√", "circ": "∘", "propto": "∝", "emptyset": "∅", "langle": "⟨", "rangle": "⟩", "prime": "′",
}
GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
BARE = "displaystyle textstyle left right quad qquad item maketitle tableofcontents newpage noindent par centering hline toprule midrule bottomrule bigskip medskip smallskip limits mathrm mathbf log ln sin cos tan exp min max lim".split()
#: Commands whose argument is no text.
DROPPED = "cite citep citet citeauthor ref eqref pageref label index bibliography bibliographystyle usepackage documentclass includegraphics vspace hspace input include footnotemark pagestyle".split()
HEADINGS = "part chapter section subsection subsubsection paragraph subparagraph".split()
FORMULAS = "equation align gather multline eqnarray displaymath math alignat flalign".split()

for _g in GREEK:
    SYMBOLS[_g] = unicodedata.lookup(f"GREEK SMALL LETTER {_g.upper().replace('LAMBDA', 'LAMDA')}")
    SYMBOLS[_g.capitalize()] = unicodedata.lookup(f"GREEK CAPITAL LETTER {_g.upper().replace('LAMBDA', 'LAMDA')}")
SYMBOLS |= {"varphi": "φ", "varepsilon": "ε", "vartheta": "ϑ"}

_I, _S, _M = re.I, re.S, re.M
_TAG = rf"</?(?:{'|'.join(sorted(TAGS, key=len, reverse=True))})(?:\s[^<>]*|/)?\s*/?>"
_BARE_COMMAND = re.compile(r"(?<![\w:\\/])\\(" + "|".join(sorted([*SYMBOLS, *BARE], key=len, reverse=True)) + r")(?![A-Za-z\\])")
_COMMAND = re.compile(r"\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])*\{((?:[^{}]|\{[^{}]*\})*)\}")
_ENTITY = re.compile(r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
#: Texts without any of these have no markup. Rules match after leading blanks and after clean() dropped \ue000 and \ue001.
SIGNS = r"[<>&\[\]{}*_`~\\$#|\ue000\ue001]|''|(?m)^[ \t]*[=\-+:;!]|(?m)==\s*$"


def tex_to_text(tex: str) -> str:
    """A formula as plain text: named signs as characters, fractions with a slash, groups in brackets."""
    t = re.sub(r"\\(?:begin|end)\{[a-z]+\*?\}", "", tex)
    t = re.sub(r"\\[,;:!> ]|\\(?:left|right|displaystyle|textstyle|limits|quad|qquad)(?![A-Za-z])", " ", t)
    while True:
        before = t
        t = re.sub(r"\\[dt]?frac\{([^{}]*)\}\{([^{}]*)\}", r"(\1)/(\2)", t)
        t = re.sub(r"\\sqrt\{([^{}]*)\}", r"√(\1)", t)
        t = re.sub(r"\\(?:bar|overline)\{([^{}])\}", "\\1\u0304", t)
        t = re.sub(r"\\(?:hat|widehat)\{([^{}])\}", "\\1\u0302", t)
        t = re.sub(r"([\^_])\{([^{}]*)\}", lambda m: m[1] + (m[2] if re.fullmatch(r"\w", m[2]) else f"({m[2]})"), t)
        t = re.sub(r"\\[A-Za-z]+\{([^{}]*)\}", r"\1", t)
        if t == before:
            break
    t = re.sub(r"\\([A-Za-z]+)", lambda m: SYMBOLS.get(m[1], m[1]), t)
    return re.sub(r"[ \t]+", " ", t.replace("{", "").replace("}", "").replace("\\\\", "\n").replace("\\", "").replace("&", "")).strip()


class _Text:
    """A text under conversion: how many marks were found, and what is set aside."""

    def __init__(self, text: str) -> None:
        self.text, self.marks, self.aside = text, 0, []

    def sub(self, pattern: str, into: str | Callable[[re.Match], str], flags: int = 0, deep: bool = False) -> None:
        """Replace and count; deep: until nothing is left to replace, for nested constructs."""
        while True:
            self.text, n = re.subn(pattern, into, self.text, flags=flags)
            self.marks += n
            if not n or not deep:
                return

    def span(self, left: str, right: str, into: Callable[[str], str], flags: int = _I) -> None:
        """Replace what is from an opening to the next closing sign, in one pass; what isn't closed stays."""
        out, at, start = [], 0, None
        for m in re.finditer(f"({left})|({right})", self.text, flags):
            if m[1] is not None and start is None:
                start = m
            elif m[1] is None and start is not None:
                out += [self.text[at : start.start()], into(self.text[start.end() : m.start()])]
                at, start = m.end(), None
                self.marks += 1
        self.text = "".join([*out, self.text[at:]])

    def unwrap(self, sign: str, lengths: str, words: str) -> None:
        """Drop pairs of equal emphasis signs of one line: the first before a non-blank and not after a word sign, the
        last after a non-blank and not before one. Signs are paired with the nearest open one, in one pass."""
        gone: list[tuple[int, int]] = []
        open_: dict[int, re.Match] = {}
        line = 0
        for m in re.finditer(rf"(?<!{re.escape(sign)}){re.escape(sign)}{lengths}(?!{re.escape(sign)})", self.text):
            a, b = m.span()
            if "\n" in self.text[line:a]:
                open_.clear()
            line = a
            before, after = self.text[a - 1 : a], self.text[b : b + 1]
            first = open_.get(b - a)
            if first is not None and before.strip() and not re.match(words, after) and first.end() < a:
                gone += [first.span(), m.span()]
                # what was opened inside the pair can't close outside of it
                open_ = {n: o for n, o in open_.items() if o.start() < first.start()}
            elif after.strip() and not re.match(words, before):
                open_[b - a] = m
        if gone:
            self.marks += len(gone) // 2
            out, at = [], 0
            for a, b in sorted(gone):
                out.append(self.text[at:a])
                at = b
            self.text = "".join([*out, self.text[at:]])

    def keep(self, kind: str, content: str, block: bool) -> str:
        """A placeholder of private characters for code or a formula."""
        self.aside.append((kind, content, block))
        mark = f"\ue000{chr(0xE100 + len(self.aside) % 0x1700)}{chr(0xE100 + len(self.aside) // 0x1700)}\ue001"
        return f"\n\n{mark}\n\n" if block else mark

    def restore(self) -> None:
        def back(m: re.Match) -> str:
            kind, content, block = self.aside[(ord(m[1]) - 0xE100) + 0x1700 * (ord(m[2]) - 0xE100) - 1]
            return "\n".join("    " + x for x in content.split("\n")) if block and kind == "code" else content

        # code may hold formulas' placeholders
        for _ in range(3):
            self.text = re.sub("\ue000([\ue100-\uf7ff])([\ue100-\uf7ff])\ue001", back, self.text)


def _plain_code(code: str) -> str:
    return html.unescape(re.sub(_TAG, "", code, flags=_I)).strip("\n")


def _unescaped(m: re.Match) -> str:
    name = m[1]
    if name[0] != "#" and name + ";" not in html5:
        return m[0]
    return html.unescape(m[0])


def _is_formula(m: re.Match) -> bool:
    return bool(re.search(r"[\\^_{}=<>+]", m[1]) or re.fullmatch(r"[A-Za-z]\w?", m[1]))


def _unmatched(text: str, left: str, right: str) -> Iterator[int]:
    """Positions of double closers without two openers before them, and of double openers never closed."""
    stack: list[int] = []
    for m in re.finditer(f"[{re.escape(left)}{re.escape(right)}]", text):
        if m[0] == left:
            stack.append(m.start())
        elif stack:
            stack.pop()
        elif text[m.start() : m.start() + 2] == right * 2 or text[m.start() - 1 : m.start() + 1] == right * 2:
            yield m.start()
    for a in stack:
        if text[a : a + 2] == left * 2 or (a and text[a - 1 : a + 1] == left * 2):
            yield a


def _code(t: _Text) -> None:
    for fence in ("```", "~~~"):
        t.span(rf"^[ \t]*{fence}+[ \t]*[\w+#.-]*[ \t]*\n(?:(?=[ \t]*{fence}+[ \t]*$))?", rf"\n?^[ \t]*{fence}+[ \t]*$\n?", lambda x: t.keep("code", x, True), _M)
    t.sub(r"^[ \t]*```+[ \t]*[\w+#.-]*[ \t]*$", "", _M)
    for name in ("pre", "syntaxhighlight", "source"):
        t.span(rf"<{name}\b[^<>]*>", rf"</{name}\s*>", lambda x: t.keep("code", _plain_code(x), True))
    for name in ("code", "kbd", "samp", "tt", "nowiki"):
        t.span(rf"<{name}\b[^<>]*>", rf"</{name}\s*>", lambda x: t.keep("code", _plain_code(x), False))
    t.sub(r"(?<![\w`\\])(`{1,2})(?=[^\s`])([^`\n]*[^\s`])\1(?![\w`])", lambda m: t.keep("code", m[2], False))


def _formulas(t: _Text) -> None:
    block = lambda x: t.keep("formula", tex_to_text(x), True)
    inline = lambda x: t.keep("formula", tex_to_text(x), False)
    t.span(r"<math\b[^<>]*>", r"</math\s*>", lambda x: inline(html.unescape(x)))
    for name in FORMULAS:
        t.span(rf"\\begin\{{{name}\*?\}}", rf"\\end\{{{name}\*?\}}", block, 0)
    for name in ("verbatim", "lstlisting"):
        t.span(rf"\\begin\{{{name}\*?\}}", rf"\\end\{{{name}\*?\}}", lambda x: t.keep("code", x.strip("\n"), True), 0)
    t.span(r"\\\[", r"\\\]", block, 0)
    t.span(r"\\\(", r"\\\)", inline, 0)
    t.sub(r"(?<![\\$])\$\$([^$]+)\$\$", lambda m: block(m[1]), _S)
    t.sub(r"\{\\(?:display|text)style((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}", lambda m: inline(m[1]))
    found = re.sub(r"(?<![\\$\w])\$(?=[^\s$])([^$\n]*?[^\s$\\])\$(?![\w$])", lambda m: inline(m[1]) if _is_formula(m) else m[0], t.text)
    t.marks += found != t.text
    t.text = found


def _wiki(t: _Text) -> None:
    t.sub(r"<!--.*?(?:-->|\Z)", "", _S)
    t.sub(r"<ref\b[^<>]*/\s*>", "", _I)
    for name in ("ref", "script", "style", "gallery"):
        t.span(rf"<{name}\b[^<>]*>", rf"</{name}\s*>", lambda _: "")
    t.sub(r"\{\{(?:[^{}]|\{[^{}]\})*\}\}", "", deep=True)
    # media links may hold links; innermost first
    media, categories = "|".join(MEDIA), "|".join(CATEGORIES)
    while True:
        n = t.marks
        t.sub(rf"\[\[\s*:?(?:{categories})\s*:[^\[\]]*\]\]", "", _I)
        t.sub(rf"\[\[\s*(?:{media})\s*:[^\[\]|]*\]\]", "", _I)
        t.sub(rf"\[\[\s*(?:{media})\s*:[^\[\]|]*((?:\|[^\[\]|]*)+)\]\]", lambda m: _caption(m[1]), _I)
        t.sub(r"\[\[(?!\d+\]\])([^\[\]|\n]*)\|([^\[\]\n]*)\]\]", lambda m: m[2] or m[1])
        t.sub(r"\[\[(?!\d+\]\])([^\[\]|\n]+)\]\]", r"\1")
        if t.marks == n:
            break
    t.sub(rf"\[\[\s*(?:{media})\s*:[^\[\]|\n]*\|(?:\s*{OPTIONS}\s*\|)*", "", _I)
    t.sub(rf"^[ \t]*(?:{OPTIONS}\s*\|\s*)+(?=[^|\s])", "", _I | _M)
    for left, right in ("[]", "{}"):
        loose = list(_unmatched(t.text, left, right)) if left * 2 in t.text or right * 2 in t.text else []
        if loose:
            t.marks += 1
            gone = set(loose)
            t.text = "".join(c for i, c in enumerate(t.text) if i not in gone)
    t.sub(r"\[(?:https?|ftp)://[^\s\]]+\s+([^\]\n]+)\]", r"\1", _I)
    t.sub(r"\[(?:https?|ftp)://[^\s\]]+\]", "", _I)
    t.sub(r"(?<![A-Za-z0-9_])__(?:[A-Z]{3,})__(?![A-Za-z0-9_])", "")
    t.sub(r"^\s*#\s?(?:REDIRECT|WEITERLEITUNG|REDIRECTION|PATRZ|ПЕРЕНАПРАВЛЕНИЕ)\b:?[ \t]*", "Redirect: ", _I | _M)
    t.sub(r"(?<!~)~{3,5}(?!~)", "")
    while True:
        n = t.marks
        t.unwrap("'", "(?:'{4}|'{1,2})", r"\w")
        if t.marks == n:
            break
    t.sub(r"^(?:\{\|.*|\|\}.*|\|-.*)$\n?", "", _M)
    t.sub(r"^\|\+[ \t]*", "", _M)
    t.sub(r"^!(?=[^\n]*!!)[ \t]*(.*)$", lambda m: re.sub(r"\s*!!\s*", "\t", m[1]), _M)


def _caption(parts: str) -> str:
    """The last part of a media link that is no option."""
    texts = [x.strip() for x in parts.split("|")[1:] if not re.fullmatch(rf"\s*{OPTIONS}\s*", x, _I)]
    return texts[-1] if texts else ""


def _markdown(t: _Text) -> None:
    t.sub(r"!\[([^\[\]\n]*)\]\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)", r"\1")
    t.sub(r"(?<![\w\]])\[([^\[\]\n]+)\]\((?:[^()\s]|\([^()\s]*\))+(?:\s+(?:\"[^\"\n]*\"|'[^'\n]*'))?\)", r"\1")
    t.sub(r"^\[\^[^\]\n]+\]:[ \t]*", "", _M)
    t.sub(r"\[\^[^\]\s]+\]", "")
    t.sub(r"^\[[^\]\n]+\]:[ \t]+\S+[ \t]*(?:\"[^\"\n]*\")?$", "", _M)
    # tables: the line of dashes goes, cells stay apart by tabs
    t.sub(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$\n?", "", _M)
    t.sub(r"^[ \t]*\|[^\n]*$", lambda m: re.sub(r"[ \t]*\|\|?[ \t]*", "\t", m[0].strip().removeprefix("|").removesuffix("|").strip()), _M)
    while True:
        n = t.marks
        t.unwrap("*", r"\*{0,2}", r"\w")
        t.unwrap("_", "_{0,2}", r"\w")
        if t.marks == n:
            break
    t.sub(r"(?<![~\w])~~(?=[^\s~])([^\n~]*?[^\s~])~~(?![~\w])", r"\1")


def _latex(t: _Text) -> None:
    t.sub(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?", "")
    t.sub(rf"~?\\(?:{'|'.join(DROPPED)})\*?(?:\[[^\]\n]*\])*\{{[^{{}}]*\}}", "")
    t.sub(rf"\\(?:{'|'.join(HEADINGS)})\*?(?:\[[^\]\n]*\])?\{{([^{{}}]*)\}}", r"\n\n\1\n\n")
    t.sub(r"^[ \t]*\\item(?:\[([^\]\n]*)\])?[ \t]*", "• ", _M)
    while True:
        n = t.marks
        t.sub(_COMMAND.pattern, r"\2")
        if t.marks == n:
            break
    t.sub(_BARE_COMMAND.pattern, lambda m: SYMBOLS.get(m[1], "• " if m[1] == "item" else ""))


def _html(t: _Text) -> None:
    t.sub(r"<h([1-6])\b[^<>]*>(.*?)</h[1-6]\s*>", lambda m: f"\n\n{m[2].strip()}\n\n", _S | _I)
    t.sub(r"\s*<li\b[^<>]*>\s*", "\n• ", _I)
    t.sub(r"</li\s*>", "", _I)
    t.sub(r"<(?:td|th)\b[^<>]*>", "\t", _I)
    t.sub(r"</?(?:p|div|ul|ol|dl|dt|dd|tr|table|br|hr|blockquote|h[1-6]|section|article|caption|center|li|tbody|thead)\b[^<>]*>", "\n", _I)
    t.sub(_TAG, "", _I)
    while True:
        n = t.marks
        found = _ENTITY.sub(_unescaped, t.text)
        t.marks += found != t.text
        t.text = found
        # what was escaped more than once or was an escaped tag
        t.sub(_TAG, "", _I)
        if t.marks == n:
            break


def _lines(t: _Text) -> None:
    """Headings, lists and quotes by their line starts."""
    t.sub(r"^[ \t]*(={2,6})[ \t]*([^=\n](?:[^\n]*?[^=\n])?)[ \t]*={2,6}[ \t]*$", r"\n\2\n", _M)
    t.sub(r"^(?=[^\n]*\w)([^\n]+)\n[ \t]*(?:={3,}|-{3,})[ \t]*$", r"\n\1\n", _M)
    t.sub(r"^[ \t]*(?:={3,}|-{3,}|\*{3,}|_{3,}|(?:\* ){2,}\*|(?:- ){2,}-)[ \t]*$", "", _M)
    t.sub(r"^[ \t]*>+[ \t]?(?=\S|$)", "", _M)
    t.sub(r"^[ \t]{0,3}#{2,6}[ \t]+([^\n]*?\S)[ \t]*#*[ \t]*$", lambda m: f"\n{m[1]}\n" if not re.search(r"[.!?]$", m[1]) else f"  1. {m[1]}", _M)
    t.sub(r"^[ \t]{0,3}#[ \t]+([^\n]*?\S)[ \t]*#*[ \t]*$", lambda m: f"1. {m[1]}" if re.search(r"[.!?:;]['”\")]*$", m[1]) else f"\n{m[1]}\n", _M)
    t.sub(r"^([ \t]*)[-+*][ \t]+(?=\S)", lambda m: m[1].replace("\t", "    ") + "• ", _M)
    t.sub(r"^([*#:;]*)([*#:;])[ \t]+(?=\S)", lambda m: "  " * len(m[1]) + ("• " if m[2] == "*" else "1. " if m[2] == "#" else ""), _M)
    t.sub(r"^(?::+|;)(?=[^\W\d_])", "", _M)


def clean(text: str) -> tuple[str, int]:
    """Clean text and how many marks were found; a text without any comes out as it is."""
    t = _Text(re.sub("[\ue000\ue001]", "", text.replace("\r\n", "\n")))
    for step in (_code, _formulas, _wiki, _markdown, _latex, _html, _lines):
        step(t)
    if not t.marks:
        return text, 0
    t.restore()
    out = re.sub(r"[ \t]+$", "", t.text, flags=_M)
    return re.sub(r"\n{3,}", "\n\n", out).strip("\n"), t.marks


def cleaned(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, clean, marks of every row: null stays null, texts without markup stay as they are, with 0 marks.

    Headings stand on lines of their own between blank ones, list items begin with • or a number, code blocks are
    indented by four blanks, formulas are plain text, cells of a table are apart by tabs. Texts without a sign that
    markup needs don't leave the JVM; whole texts are converted.
    """
    rows = df.select(F.col(key), F.col(text).cast("string").alias("clean"))
    maybe = F.coalesce(F.col("clean").rlike(SIGNS), F.lit(False))
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [clean(t) for t in b.column("clean").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([c for c, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())], [key, "clean", "marks"])

    converted = rows.where(maybe).mapInArrow(run, f"`{key}` {kind}, clean string, marks int")
    return converted.unionByName(rows.where(~maybe).select(key, "clean", F.lit(0).alias("marks")))
