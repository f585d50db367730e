"""Wrappers of marked-up text: union-free regular expressions over token streams, inferred by alignment (problem 1).

A text is a list of units (paragraphs, and what a construct spans over several of them). A unit becomes a stream of
tokens: markup signs as they are, text between them as slots of a few classes. Articles name no host, so streams are
brought together by their structural signature, the set of markup tokens in them. Within a signature streams are aligned
one after the other: tandem repeats become repeated groups, what one side lacks becomes an optional group, differing text
becomes a slot. A wrapper also holds what its slots turn into: the markup parser reads example streams of it, and the
characters it puts between two slots are kept for every pair of slots that may follow each other. Rows are then matched
with the wrappers; only units that fit none, or with a pair of slots never seen, are parsed.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.markup import CATEGORIES, MEDIA, OPTIONS, SIGNS, TAGS, clean
from inkwell.operators.order import cumulated
from inkwell.session import cut, drop_cut

_NAMES = "|".join(sorted(TAGS, key=len, reverse=True))
_PREFIXES = "|".join([*MEDIA, *CATEGORIES])
_PLAIN = r"(?P<plain>(?:[^<>&\\\[\]{}|!*_`~$#'=^+\"()\n-]++|'(?!')|!(?![!\[])|-(?!->))++)"
_REDIRECT = r"\#[ ]?(?:REDIRECT|WEITERLEITUNG|REDIRECTION|PATRZ|ПЕРЕНАПРАВЛЕНИЕ)\b"
_TOKENS = rf"""(?P<tag></?(?:{_NAMES})(?:\s[^<>]*|/)?\s*/?>)
    |<!--|-->|&(?:\#\d{{1,7}}|\#[xX][0-9a-fA-F]{{1,6}}|[A-Za-z][A-Za-z0-9]{{1,31}});
    |\\(?:begin|end)\{{[A-Za-z]+\*?\}}|\\[A-Za-z]+\*?|\\[^A-Za-z\s]|\\
    |\[\[\s*:?(?:{_PREFIXES})\s*:|(?<![A-Za-z0-9_])__[A-Z]{{3,}}__(?![A-Za-z0-9_])
    |\]\((?:https?://)?|\]:(?=\s)|\n[ \t]*(?:\n[ \t]*)*(?:{_REDIRECT}|[-+:;!>=|*\#]+[ \t]*)?
    |\{{\||\|[-+}}]?|!!|!\[|\[+|\]+|\{{+|\}}+|\*+|_+|`+|~+|\$+|\#+|'{{2,}}|={{2,}}|[<>&^=+"()]"""
_START = rf"\A[ \t]*(?:{_REDIRECT}|[-+:;!>=|*\#]+[ \t]*)"
_TOKEN = re.compile(f"{_START}|{_PLAIN}|{_TOKENS}", re.X | re.I)
_URL_TOKEN = re.compile(f"{_START}|(?:https?|ftp)://|{_TOKENS}", re.X | re.I)
#: Slots of words and of digits; signs beside the former tell how the words begin and end.
WORDS, DIGITS = "\U00013000", "\U000104a0"
_URL = re.compile(r"[^\s\[\]<>|{}()\"]+")
_OPTION = re.compile(OPTIONS, re.I)
_SIZED = re.compile(r"(\d*x?)(\d+)( ?px)")
_NAMED = re.compile(r"(?i)(alt=|link=|upright=)(.+)", re.S)
_ENDS = re.compile(r"[.!?:;]['”\")]*$")
_SIGNS = re.compile(SIGNS.replace("(?m)", ""), re.M)
_BLANK_LINES = re.compile(r"\n[ \t]*(?:\n[ \t]*)+")
#: What stands for the slots of a stream when it is parsed: letters and digits of scripts that texts hardly have.
_LETTERS = [chr(c) for c in range(0x13000, 0x13400)]
_NUMERALS = [chr(c) for c in range(0x104A0, 0x20000) if unicodedata.category(chr(c)) == "Nd"][:300]
_PLACE = re.compile(f"[,]?[{_LETTERS[0]}-{_LETTERS[-1]}][,.]?|[{''.join(_NUMERALS)}]")
PRIVATE = re.compile(f"[{_LETTERS[0]}-{_LETTERS[-1]}{''.join(_NUMERALS)}]")
#: What opens (o) and closes (c) over several paragraphs, or does either by turns (t).
_SPANNING = (
    ("o", "{{", r"\{\{"), ("c", "{{", r"\}\}"), ("o", "{|", r"\{\|"), ("c", "{|", r"\|\}"), ("o", "[[", r"\[\["), ("c", "[[", r"\]\]"), ("t", "```", "```+"), ("t", "~~~", "~~~+"),
    ("o", "<!--", "<!--"), ("c", "<!--", "-->"), ("t", "$$", r"\$\$"), ("o", "begin", r"\\begin\{"), ("c", "begin", r"\\end\{"), ("o", "[", r"\\\["), ("c", "[", r"\\\]"),
    *[(side, name, rf"<{'/' * (side == 'c')}{name}\b[^<>]*(?<!/)>") for name in ("pre", "syntaxhighlight", "source", "code", "math", "ref", "gallery", "script", "style", "nowiki", "h1", "h2", "h3", "h4", "h5", "h6") for side in "oc"],
)
_SPANS = re.compile(r"[^{}|\[\]`~<\-$\\]++|" + "|".join(f"({p})" for _, _, p in _SPANNING), re.I)
_OPENS = re.compile(r"\{[{|]|\[\[|```|~~~|<(?:!--|[pscmrgnh])|\$\$|\\(?:begin|\[)", re.I)

#: Streams of a host that one task aligns with each other, as that is quadratic; and tokens of the longest stream that is
#: aligned, longer ones are parsed.
HOST_STREAMS, STREAM_TOKENS = 300, 512

Stream = tuple[str, ...]
#: How alike two streams must be to share a wrapper, and the longest run of tokens that is looked for as a repeat.
ALIKE, LONGEST_REPEAT = 0.5, 24


def units(text: str) -> list[tuple[str, str]]:
    """The paragraphs of a text, each with the blank lines before it; those that one construct spans are one unit."""
    parts, gaps = _BLANK_LINES.split(text), ["", *_BLANK_LINES.findall(text)]
    glued: set[int] = set()
    open_: list[tuple[str, int]] = []
    if len(parts) > 1 and _OPENS.search(text):
        for i, p in enumerate(parts):
            for m in _SPANS.finditer(p):
                if not m.lastindex:
                    continue
                side, kind, _ = _SPANNING[m.lastindex - 1]
                at = next((j for j in range(len(open_) - 1, -1, -1) if open_[j][0] == kind), None) if side != "o" else None
                if at is not None:
                    glued.update(range(open_[at][1] + 1, i + 1))
                    del open_[at:]
                elif side != "c":
                    open_.append((kind, i))
    out: list[tuple[str, str]] = []
    for i, (gap, p) in enumerate(zip(gaps, parts, strict=True)):
        if i in glued:
            out[-1] = (out[-1][0], out[-1][1] + gap + p)
        else:
            out.append((gap, p))
    return out


def _slot(text: str, stream: list[str], filled: list[str]) -> None:
    """Tokens of a run without signs: blanks at its ends stay, what is between is a slot unless it is a fixed word."""
    core = text.strip(" \t")
    if not core:
        stream.append(text)
        return
    at = text.index(core)
    if at:
        stream.append(text[:at])
    if core.isdigit() and core.isascii():
        stream.append(DIGITS)
        filled.append(core)
    elif len(core) < 3 or (not _SIZED.fullmatch(core) and _OPTION.fullmatch(core) and "=" not in core):
        stream.append(core)
    elif m := _SIZED.fullmatch(core):
        stream += [DIGITS, m[3]]
        filled.append(m[1] + m[2])
    else:
        if m := _NAMED.fullmatch(core):
            stream.append(m[1])
            core = m[2]
        first = "" if core[0].isalnum() else ","
        last = "" if core[-1].isalnum() else "." if _ENDS.search(core) else ","
        stream.append(first + WORDS + last)
        filled.append(core)
    if at + len(core) < len(text) and text[-1] in " \t":
        stream.append(text[len(text.rstrip(" \t")) :])


def tokens(unit: str) -> tuple[Stream, list[str]]:
    """The token stream of a unit and what stands in its slots, in order."""
    stream: list[str] = []
    filled: list[str] = []
    at = 0
    dollar, link = "$" in unit, "](" in unit
    for m in (_URL_TOKEN if "://" in unit else _TOKEN).finditer(unit):
        a, b = m.span()
        if a < at or m.lastgroup == "plain":
            continue
        t = m[0]
        if (t in "=+" and not dollar) or (t in '"()' and not link):
            continue
        if a > at:
            _slot(unit[at:a], stream, filled)
        at = b
        if m["tag"]:
            name = re.match(r"</?\w+", t)[0].lower()
            stream.append(name + ("/>" if t.endswith("/>") and len(name) + 2 < len(t) + 1 else ">"))
        elif t.endswith("://"):
            stream.append(t.lower())
            if u := _URL.match(unit, b):
                stream.append(WORDS)
                filled.append(u[0])
                at = u.end()
        else:
            stream.append(t)
    if at < len(unit):
        _slot(unit[at:], stream, filled)
    return tuple(stream), filled


def is_slot(token: str) -> bool:
    return WORDS in token or token == DIGITS


def host(stream: Stream) -> str:
    """What streams are brought together by: the first markup token, without blanks."""
    return next((t.strip(" \t") for t in stream if not is_slot(t) and not t.strip(" \t").isalnum() and t.strip(" \t")), "")


def parse_stream(stream: Stream) -> tuple[list[str | int] | None, int]:
    """What the markup parser makes of a stream: literal text and numbers of slots, and the marks it found.

    None instead of the former where slots don't come out whole, in order and once at most.
    """
    letters, numerals = iter(_LETTERS), iter(_NUMERALS)
    number: dict[str, tuple[int, str]] = {}
    text, n = [], 0
    for t in stream:
        if is_slot(t):
            c = next(numerals, None) if t == DIGITS else next(letters, None)
            if c is None:
                return None, -1
            number[c] = (n, t)
            t, n = t.replace(WORDS, c) if t != DIGITS else c, n + 1
        text.append(t)
    out, marks = clean("".join(text))
    parts: list[str | int] = []
    at, last = 0, -1
    for m in PRIVATE.finditer(out):
        i, t = number[m[0]]
        before, after = t.partition(WORDS)[::2] if t != DIGITS else ("", "")
        a, b = m.start() - len(before), m.end() + len(after)
        if i <= last or a < at or out[a : m.start()] != before or out[m.end() : b] != after:
            return None, marks
        parts += [out[at:a], i]
        at, last = b, i
    return [*parts, out[at:]], marks


# ---- inference. Elements of a wrapper: a token; ("#", classes) a slot; ("+", elements) repeated; ("?", elements) optional.


def _key(e: object) -> object:
    return e if isinstance(e, str) else ("#",) if e[0] == "#" else (e[0], *map(_key, e[1]))


def folded(elements: list) -> list:
    """Tandem repeats as repeated groups, short ones first, so that groups may hold groups."""
    for size in range(1, LONGEST_REPEAT + 1):
        i = 0
        while i + 2 * size <= len(elements):
            body = elements[i : i + size]
            keys = [_key(e) for e in body]
            n = 1
            while [_key(e) for e in elements[i + n * size : i + (n + 1) * size]] == keys:
                body = [_united(a, b) for a, b in zip(body, elements[i + n * size : i + (n + 1) * size], strict=True)]
                n += 1
            if n > 1 and any(not isinstance(e, str) for e in body):
                elements = [*elements[:i], ("+", tuple(body)), *elements[i + n * size :]]
            i += 1
    return elements


def _united(a: object, b: object) -> object:
    """Two elements of equal keys as one: their slots take the classes of both."""
    if isinstance(a, str):
        return a
    if a[0] == "#":
        return ("#", tuple(sorted({*a[1], *b[1]})))
    return (a[0], tuple(_united(x, y) for x, y in zip(a[1], b[1], strict=True)))


def _single_as_repeat(elements: list, groups: Iterable[tuple]) -> list:
    """Where a run of elements is one turn of a group that the other side repeats, it becomes the group."""
    for g in groups:
        keys, size = [_key(e) for e in g[1]], len(g[1])
        i = 0
        while i + size <= len(elements):
            if [_key(e) for e in elements[i : i + size]] == keys:
                elements = [*elements[:i], ("+", tuple(_united(a, b) for a, b in zip(elements[i : i + size], g[1], strict=True))), *elements[i + size :]]
            i += 1
    return elements


def aligned(a: list, b: list) -> list | None:
    """One wrapper for two: equal elements stay, what only one side has is optional; None if they are too different."""
    b = _single_as_repeat(b, [e for e in a if e[0] == "+" and not isinstance(e, str)])
    a = _single_as_repeat(a, [e for e in b if e[0] == "+" and not isinstance(e, str)])
    bare = lambda e: _key(e) if isinstance(e, str) or e[0] != "?" else ("?", *map(_key, e[1]))
    match = SequenceMatcher(None, [bare(e) for e in a], [bare(e) for e in b], autojunk=False)
    if match.ratio() < ALIKE:
        return None
    out: list = []
    for kind, i, j, k, m in match.get_opcodes():
        if kind == "equal":
            out += [_united(x, y) for x, y in zip(a[i:j], b[k:m], strict=True)]
            continue
        for part in (a[i:j], b[k:m]):
            rest = [e for e in part if isinstance(e, str) or e[0] != "?"]
            if len(rest) == len(part) and part:
                out.append(("?", tuple(part)))
            else:
                out += [e if not isinstance(e, str) and e[0] == "?" else ("?", (e,)) for e in part]
    return out


@dataclass
class Wrapper:
    """A union-free regular expression over tokens, and what its slots turn into."""

    elements: list
    #: (element before, its class, tokens between, element, its class) -> characters between two kept slots.
    between: dict[tuple, str] = field(default_factory=dict)
    #: a slot with the slots and tokens around it -> whether it stays; the target of [[a|b]] goes, that of [[a]] doesn't.
    kept: dict[tuple, bool] = field(default_factory=dict)
    marked: bool = False
    streams: int = 0

    def __post_init__(self) -> None:
        self.code: list[tuple] = []
        self._compile(self.elements)
        self.code.append(("end",))

    def _compile(self, elements: Iterable) -> None:
        for e in elements:
            if isinstance(e, str):
                self.code.append(("token", (e,), len(self.code)))
            elif e[0] == "#":
                self.code.append(("token", tuple(e[1]), len(self.code)))
            elif e[0] == "?":
                at = len(self.code)
                self.code.append(())
                self._compile(e[1])
                self.code[at] = ("split", at + 1, len(self.code))
            else:
                at = len(self.code)
                self._compile(e[1])
                self.code.append(("split", at, len(self.code) + 1))

    def match(self, stream: Stream) -> list[int] | None:
        """The element that each token is, or None; every state (instruction, token) is tried once."""
        came: dict[tuple[int, int], tuple[int, int] | None] = {(0, 0): None}
        stack = [(0, 0)]
        while stack:
            pc, i = state = stack.pop()
            op = self.code[pc]
            if op[0] == "end":
                if i < len(stream):
                    continue
                out = []
                while (before := came[state]) is not None:
                    if before[1] < state[1]:
                        out.append(before[0])
                    state = before
                return out[::-1]
            # later ones are tried first: the body of a group before what follows it
            then = [(op[2], i), (op[1], i)] if op[0] == "split" else [(pc + 1, i + 1)] if i < len(stream) and stream[i] in op[1] else []
            for s in then:
                if s not in came:
                    came[s] = state
                    stack.append(s)
        return None

    def learn(self, stream: Stream, parsed: list[str | int]) -> bool:
        """Take over what the parser made of a stream; False if that contradicts what is known."""
        at = self.match(stream)
        if at is None:
            return False
        slots = [i for i, t in enumerate(stream) if is_slot(t)]
        kept = [slots[x] for x in parsed if isinstance(x, int)]
        stays = set(kept)
        for n, i in enumerate(slots):
            if self.kept.setdefault(self._around(stream, at, slots, n), i in stays) != (i in stays):
                return False
        literals = [x for x in parsed if isinstance(x, str)]
        for a, b, literal in zip([-1, *kept], [*kept, len(stream)], literals, strict=True):
            if self.between.setdefault(self._gap(stream, at, a, b), literal) != literal:
                return False
        return True

    @classmethod
    def _around(cls, stream: Stream, at: list[int], slots: list[int], n: int) -> tuple:
        before, after = slots[n - 1] if n else -1, slots[n + 1] if n + 1 < len(slots) else len(stream)
        return cls._gap(stream, at, before, slots[n]) + cls._gap(stream, at, slots[n], after)

    @staticmethod
    def _gap(stream: Stream, at: list[int], a: int, b: int) -> tuple:
        return (at[a] if a >= 0 else -1, stream[a] if a >= 0 else "", stream[a + 1 : b], at[b] if b < len(stream) else -1, stream[b] if b < len(stream) else "")

    def render(self, stream: Stream) -> list[str | int] | None:
        """Literal text and numbers of slots, or None if the stream doesn't fit or has a gap that was never seen."""
        at = self.match(stream)
        if at is None:
            return None
        out: list[str | int] = []
        last = -1
        slots = [i for i, t in enumerate(stream) if is_slot(t)]
        for n, i in enumerate(slots):
            stays = self.kept.get(self._around(stream, at, slots, n))
            literal = self.between.get(self._gap(stream, at, last, i)) if stays else ""
            if stays is None or literal is None:
                return None
            if stays:
                out += [literal, n]
                last = i
        literal = self.between.get(self._gap(stream, at, last, len(stream)))
        return None if literal is None else [*out, literal]

    def examples(self) -> list[Stream]:
        """Streams that take every group once, and one group at a time left out or repeated."""

        def flat(elements: Iterable, turn: tuple[int, int], count: list[int]) -> list[str]:
            out: list[str] = []
            for e in elements:
                if isinstance(e, str):
                    out.append(e)
                elif e[0] == "#":
                    out.append(e[1][0])
                else:
                    count[0] += 1
                    n = turn[1] if count[0] == turn[0] else 1
                    body = flat(e[1], turn, count)
                    out += body * (min(n, 1) if e[0] == "?" else max(n, 1))
            return out

        groups = [0]
        first = flat(self.elements, (0, 1), groups)
        return [tuple(first), *(tuple(flat(self.elements, (g, n), [0])) for g in range(1, groups[0] + 1) for n in (0, 2, 3))]

    def pattern(self) -> str:
        """The wrapper as text, slots as #."""

        def show(elements: Iterable) -> str:
            return " ".join(e.replace("\n", "¶").strip(" \t") or "·" if isinstance(e, str) else "#" if e[0] == "#" else f"( {show(e[1])} ){e[0]}" for e in elements)

        return show(self.elements)


def _wrapper(elements: list, members: list[tuple[Stream, list[str | int], bool]]) -> Wrapper | None:
    """A wrapper with its rendering, if it renders all members as the parser does."""
    w = Wrapper(elements, marked=members[0][2], streams=len(members))
    if any(m[2] != w.marked for m in members) or not all(w.learn(s, p) for s, p, _ in members):
        return None
    for s in w.examples():
        parsed, marks = parse_stream(s)
        # what the wrapper would take but the parser reads otherwise stays unknown
        if parsed is not None and (marks > 0) == w.marked:
            trial = Wrapper(elements, dict(w.between), dict(w.kept), w.marked, w.streams)
            if trial.learn(s, parsed):
                w = trial
    return w if all(w.render(s) == p for s, p, _ in members) else None


def infer(streams: Iterable[Stream]) -> list[Wrapper]:
    """Wrappers of the streams of one host, in the order given: each stream joins the first wrapper that still renders
    all its streams rightly when it is aligned with it, or begins one. Streams that the parser tears apart have none."""
    groups: list[tuple[Wrapper, list]] = []
    for s in streams:
        parsed, marks = parse_stream(s)
        if parsed is None:
            continue
        member = (s, parsed, marks > 0)
        mine = folded([("#", (t,)) if is_slot(t) else t for t in s])
        for i, (w, members) in enumerate(groups):
            if member[2] == w.marked and w.render(s) == parsed:
                members.append(member)
                w.streams += 1
                break
            both = aligned(w.elements, mine) if member[2] == w.marked else None
            if both is not None and (new := _wrapper(both, [*members, member])):
                groups[i] = (new, [*members, member])
                break
        else:
            if w := _wrapper(mine, [member]) or _wrapper([("#", (t,)) if is_slot(t) else t for t in s], [member]):
                groups.append((w, [member]))
    return [w for w, _ in groups]


class Wrapped:
    """Applies wrappers to texts. Streams met are remembered, at most REMEMBERED of them."""

    REMEMBERED = 50_000

    def __init__(self, wrappers: dict[str, list[Wrapper]]) -> None:
        self.wrappers = wrappers
        self.known: dict[Stream, tuple[list[str | int] | None, bool]] = {}

    def unit(self, text: str) -> tuple[str, bool, bool]:
        """Clean text of a unit, whether it has markup, and whether a wrapper says so (else the parser)."""
        stream, filled = tokens(text)
        if len(stream) > STREAM_TOKENS:
            out, marks = clean(text)
            return out, marks > 0, False
        if (hit := self.known.get(stream)) is None:
            hit = (None, False)
            for w in self.wrappers.get(host(stream), ()):
                if (program := w.render(stream)) is not None:
                    hit = (program, w.marked)
                    break
            if len(self.known) >= self.REMEMBERED:
                self.known.clear()
            self.known[stream] = hit
        program, marked = hit
        if program is None:
            out, marks = clean(text)
            return out, marks > 0, False
        return "".join([filled[x] if isinstance(x, int) else x for x in program]) if marked else text, marked, True

    def text(self, text: str) -> tuple[str, int, int]:
        """Clean text, units with markup, and how many units no wrapper fits; a text without markup stays as it is."""
        if max(text, default="") >= _NUMERALS[0] and PRIVATE.search(text):
            out, marks = clean(text)
            return out, int(marks > 0), 1
        out, marked, parsed = [], 0, 0
        for gap, u in units(text.replace("\r\n", "\n")):
            if _SIGNS.search(u):
                u, hit, fits = self.unit(u)
                marked, parsed = marked + hit, parsed + (not fits)
            out += [gap, u]
        if not marked:
            return text, 0, parsed
        joined = re.sub(r"[ \t]+$", "", "".join(out), flags=re.M)
        return re.sub(r"\n{3,}", "\n\n", joined).strip("\n"), marked, parsed


def merged(wrappers: Iterable[Wrapper]) -> list[Wrapper]:
    """Wrappers of one host with equal ones as one, unless what they know contradicts each other."""
    out: dict[tuple, list[Wrapper]] = {}
    for w in wrappers:
        same = out.setdefault((repr(w.elements), w.marked), [])
        for v in same:
            if all(v.kept.get(k, x) == x for k, x in w.kept.items()) and all(v.between.get(k, x) == x for k, x in w.between.items()):
                v.kept, v.between, v.streams = v.kept | w.kept, v.between | w.between, v.streams + w.streams
                break
        else:
            same.append(w)
    return [w for same in out.values() for w in same]


def learn_wrappers(df: DataFrame, text: str, fit_rows: int | None = None) -> list[tuple[str, Wrapper]]:
    """(host, wrapper) of all of a table's texts; fit_rows: only of about so many, chosen by a hash of the text.

    Streams are counted before they are brought together by host, so what a third of all texts share is one stream. The
    HOST_STREAMS most frequent ones of a host are aligned first. All others are matched with what came of them; those that
    no wrapper renders as the parser does are aligned in blocks of as many, so that every stream has its part.
    """
    rows = df.select(F.col(text).cast("string").alias("text")).where(F.col("text").rlike(SIGNS))
    if fit_rows:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(max(1, -(-df.count() // fit_rows)))) == 0)

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter[Stream] = Counter()
            for t in b.column("text").to_pylist():
                seen.update(s for _, u in units(t.replace("\r\n", "\n")) if _SIGNS.search(u) and (u.isascii() or not PRIVATE.search(u)) and len(s := tokens(u)[0]) <= STREAM_TOKENS)
            yield pa.RecordBatch.from_arrays([pa.array([host(s) for s in seen], pa.string()), pa.array([list(s) for s in seen], pa.list_(pa.string())), pa.array(seen.values(), pa.int64())], ["host", "stream", "n"])

    def aligned_streams(pdf: pd.DataFrame) -> pd.DataFrame:
        found = infer(tuple(s) for s in pdf.sort_values("at")["stream"])
        return pd.DataFrame({"host": pdf["host"].iloc[0], "wrapper": [pickle.dumps(w) for w in found]})

    def inferred(groups: DataFrame, blocks: int, *by: str) -> dict[str, list[Wrapper]]:
        out: dict[str, list[Wrapper]] = {}
        # few bytes but much work: with a number of partitions of its own, blocks aren't put together into one task;
        # a wrapper is some kilobytes, so what the driver sees grows with the kinds of markup, not with the rows
        rows = groups.repartition(2 * max(blocks, 1), *by).groupBy(*by).applyInPandas(aligned_streams, "host string, wrapper binary").collect()
        for h, w in sorted((r["host"], bytes(r["wrapper"])) for r in rows):
            out.setdefault(h, []).append(pickle.loads(w))
        return out

    counted = cut(rows.mapInArrow(streams, "host string, stream array<string>, n bigint").groupBy("host", "stream").agg(F.sum("n").alias("n")), "streams")
    most = counted.withColumn("at", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "stream"))).where(F.col("at") <= HOST_STREAMS)
    aligned_first = F.sum(F.least("count", F.lit(HOST_STREAMS)))
    largest, first = counted.groupBy("host").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(aligned_first, F.lit(0))).first()
    found = inferred(most, -(-first // HOST_STREAMS), "host")
    if largest > HOST_STREAMS:
        shared = df.sparkSession.sparkContext.broadcast(found)

        def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                fits: list[int | None] = []
                whole: list[bool] = []
                for h, s in zip(b.column("host").to_pylist(), map(tuple, b.column("stream").to_pylist()), strict=True):
                    parsed, marks = parse_stream(s)
                    whole.append(parsed is not None)
                    fits.append(next((i for i, w in enumerate(shared.value.get(h, ())) if w.marked == (marks > 0) and w.render(s) == parsed), None) if whole[-1] else None)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fits, pa.int32())], [*b.schema.names, "fits"]).filter(pa.array(whole, pa.bool_()))

        others = counted.join(most.select("host", "stream"), ["host", "stream"], "left_anti").select("host", "stream", "n")
        tried = cut(others.mapInArrow(fitting, "host string, stream array<string>, n bigint, fits int"), "fitting")
        for r in tried.where("fits IS NOT NULL").groupBy("host", "fits").count().collect():
            found[r["host"]][r["fits"]].streams += r["count"]
        left = tried.where("fits IS NULL").drop("fits")
        blocks = left.groupBy("host").count().agg(F.coalesce(F.sum(F.ceil(F.col("count") / HOST_STREAMS)), F.lit(0))).first()[0]
        placed = cumulated(left, ["host"], [F.desc("n"), F.col("stream")]).withColumnRenamed("upto", "at")
        for h, ws in inferred(placed.withColumn("block", F.floor((F.col("at") - 1) / HOST_STREAMS)), blocks, "host", "block").items():
            found[h] = merged([*found.get(h, ()), *ws])
        drop_cut(tried)
    drop_cut(counted)
    return sorted(((h, w) for h, ws in found.items() for w in ws), key=lambda x: (-x[1].streams, x[0], pickle.dumps(x[1])))


def wrapped_texts(df: DataFrame, key: str, text: str, fit_rows: int | None = None) -> DataFrame:
    """key, clean, marks, parsed of every row: texts made clean by the wrappers inferred from them, all unless fit_rows says
    otherwise.

    marks: units of the text that hold markup; parsed: units that no wrapper fits, which the markup parser reads. Null
    and empty texts, and those without markup, stay as they are with 0 marks; repeated rows stay; other columns don't
    matter; an empty table gives an empty one. Headings stand on lines of their own, list items begin with • or a
    number, code blocks are indented by four blanks, formulas are plain text, cells of a table are apart by tabs.
    Texts without a sign that markup needs don't leave the JVM; whole texts are matched, whatever their length.
    """
    rows = df.select(F.col(key), F.col(text).cast("string").alias("clean"))
    maybe = F.coalesce(F.col("clean").rlike(SIGNS), F.lit(False))
    kind = dict(rows.dtypes)[key]
    found: dict[str, list[Wrapper]] = {}
    for h, w in learn_wrappers(df, text, fit_rows):
        found.setdefault(h, []).append(w)
    shared = df.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = Wrapped(shared.value)
        for b in batches:
            done = [apply.text(t) for t in b.column("clean").to_pylist()]
            columns = [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(key), *columns], [key, "clean", "marks", "parsed"])

    converted = rows.where(maybe).mapInArrow(run, f"`{key}` {kind}, clean string, marks int, parsed int")
    return converted.unionByName(rows.where(~maybe).select(key, "clean", F.lit(0).alias("marks"), F.lit(0).alias("parsed")))


def tag_counts(df: DataFrame, text: str) -> DataFrame:
    """tag, n: tokens that are tags (<name or </name), over all rows; null and empty texts have none."""
    rows = df.select(F.col(text).cast("string").alias("text")).where(F.col("text").contains("<"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = Counter(t.rstrip("/>") for x in b.column("text").to_pylist() for _, u in units(x) for t in tokens(u)[0] if len(t) > 2 and t[0] == "<" and t[-1] == ">" and (t[1].isalpha() or t[1] == "/"))
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["tag", "n"])

    return rows.mapInArrow(count, "tag string, n bigint").groupBy("tag").agg(F.sum("n").alias("n"))
