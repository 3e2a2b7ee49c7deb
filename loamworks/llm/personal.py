"""Personal data in free text: found by boosted trees over candidate spans, and replaced by typed placeholders.

Generous patterns and name tables propose spans that may overlap. Each kind has boosted trees over features of a span's
format and of the text around it; their calibrated probability decides, and of overlapping spans the more probable, then
the longer one stays. A name inside an email address is part of the address.

There are no labelled spans, so the trees learn by two views of a bounded sample of documents (``TrainConfig``). Candidates that their own
format settles (an international number, a control letter that fits, a street with its type, both names in the name table) are
the first labels. What stands around them (the words before and after, separators, an at sign in the row) teaches trees that see nothing of
the format; where these are sure, they label candidates that the format leaves open. The final trees see both views and are
fitted on all labels; their probabilities are calibrated on candidates held out, and so is each kind's threshold. No rule takes part in scoring. The
words that speak for or against a kind are learnt, not listed. Whether a word is like a given or a family name is scored by the letters it is made of, learnt
from the table of names, so names that the table lacks are found too. A kind of which the sample teaches nothing (fewer than ``least`` labels of
either sort) takes the candidates that their format settles.

Null and empty texts have no spans. Whole texts are read, every row on its own; columns not named are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamworks.llm.batches import pieces
from loamworks.llm.boosting import Boosted, fit_boosted, fit_held
from loamworks.session import bounded_sample, bounded_texts

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}


@dataclass(frozen=True)
class TrainConfig:
    """``documents`` and ``text_bytes``: the most that candidates are taken from for training (texts of over a hundredth of the bytes are not used).

    ``common``: how many of the sample's most frequent words may count as common ones. ``least``: labels of either sort that trees need.
    ``sure``: from which probability on the trees of the surroundings label a candidate. ``names_bytes``: the most that the name table may hold.
    """

    documents: int = 4000
    text_bytes: int = 40_000_000
    common: int = 20_000
    least: int = 10
    sure: float = 0.9
    names_bytes: int = 32_000_000


# --- surroundings ----------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W\d_]+|\d+|@|＠")


def _back(text: str, at: int, tokens: int, stop: int = 0) -> int:
    """Where the last ``tokens`` parts between blanks before ``at`` begin, or the blanks before them; not before ``stop``."""
    parts = text[stop:at].rsplit(None, tokens)
    return stop + len(parts[0]) if len(parts) > tokens else stop


def _words_of(piece: str) -> list[str]:
    return ["0" if w[0].isdigit() else w.lower() for w in _TOKEN.findall(piece)]


class _Rows:
    """The rows of a text: where the one of a place begins and ends, and what it holds, found once each."""

    def __init__(self, text: str):
        self.text, self.known = text, (-1, -1, ())

    def at(self, place: int) -> tuple[int, int, tuple[float, ...]]:
        a, b, facts = self.known
        if not a <= place <= b or a < 0:
            a = self.text.rfind("\n", 0, place) + 1
            b = self.text.find("\n", place)
            b = len(self.text) if b < 0 else b
            row = self.text[a:b]
            marks = row.count("|") + row.count(";") + row.count("\t")
            facts = (float(marks > 0), float("@" in row or "＠" in row or "[at]" in row or "(at)" in row), sum(map(str.isdigit, row)) / max(1, len(row)))
            self.known = a, b, facts
        return a, b, facts


def surroundings(text: str, rows: _Rows, start: int, end: int) -> tuple[tuple[str, ...], tuple[float, ...]]:
    """The three words before a span and the one after it, and figures of its row; nothing of the span itself. A row's end is a word of its own."""
    a, b, facts = rows.at(start)
    head = text[_back(text, start, 4, a) : start]
    before = ["^", "^", "^", *_words_of(head)][-3:]
    tail = text[end : end + 24]
    after = _words_of(tail.partition("\n")[0])[:1] or ["$"]
    left, right = head.rstrip(" ")[-1:], tail.lstrip(" ")[:1]
    return (*before, after[0]), (*facts, float(left in ("|", ";", "\t", "")), float(right in ("|", ";", "\t", "\n", "")), float(left in (":", ",")), float(right in (",", ".", ":")))


@dataclass
class Cues:
    """How much a word at each place speaks for a kind; learnt from labelled candidates."""

    weights: tuple[dict[str, float], ...] = ({}, {}, {}, {})

    @classmethod
    def learn(cls, words: list[tuple[str, ...]], labels: list[int]) -> Cues:
        share = (sum(labels) + 0.5) / (len(labels) + 1)
        out = []
        for k in range(4):
            counts: dict[str, list[int]] = {}
            for w, c in zip(words, labels, strict=True):
                counts.setdefault(w[k], [0, 0])[c] += 1
            # four more candidates of the usual share: a word seen once says little
            out.append({w: float(np.log((n[1] + 4 * share) / (n[0] + 4 * (1 - share))) - np.log(share / (1 - share))) for w, n in counts.items()})
        return cls(tuple(out))

    def __call__(self, words: tuple[str, ...]) -> list[float]:
        x = [weights.get(w, 0.0) for weights, w in zip(self.weights, words, strict=True)]
        return [*x, sum(x[:3])]


# --- email -----------------------------------------------------------------------------------------------

_OPEN, _CLOSE = r"[\(\[\{<]\s?", r"\s?[\)\]\}>]"
_AT = re.compile(rf"\s?(?:[@＠]|&#64;)\s?|\s?{_OPEN}(?:at|arroba|ät)\s?{_CLOSE[3:]}\s?|\s(?:at|arroba)\s(?=[\w\-]+\s(?:dot|punto)\s)", re.I)
_DOT = rf"(?:\.|\s?{_OPEN}(?:dot|punkt|point|punto)\s?{_CLOSE[3:]}\s?|\s(?:dot|punkt|punto)\s)"
_DOMAIN = re.compile(rf"\w+(?:-+\w+)*(?:{_DOT}\w+(?:-+\w+)*)*", re.I)
_LAST = re.compile(r"([^\W_]+)$")


def _emails(text: str) -> list[tuple[int, int, list[float], int | None]]:
    out = []
    low = text.lower()
    if not any(x in low for x in ("@", "＠", "&#64;", "at)", "at]", "at}", "at>", "at )", "at ]", "ät)", "arroba", " dot ", " punto ")):
        return out
    for m in _AT.finditer(text):
        start = m.start()
        while start and (text[start - 1].isalnum() or text[start - 1] in "_.+-"):
            start -= 1
        local = text[start : m.start()]
        right = _DOMAIN.match(text, m.end())
        if not local or not right or not (local[-1].isalnum() or local[-1] == "_"):
            continue
        domain, at = right.group(), m.group()
        end = right.end()
        if local.lower().startswith("mailto"):
            continue
        dots = len(re.findall(_DOT, domain, re.I))
        last = _LAST.search(domain)
        tld = last.group(1) if last else ""
        plain = at in ("@", "＠", "&#64;")
        word_at, spaced = float("@" not in at and "＠" not in at and "&" not in at), float(at != at.strip())
        x = [len(local), dots, float(tld.isalpha()), len(tld), word_at, spaced, float(any(c.isalpha() for c in local)), float(domain[0].isdigit()), float("." in domain),
             float(text[start - 1 : start] in ("@", "/")), len(domain)]
        # an at sign without blanks between a name and a domain with letters at its end; a sign between numbers or with nothing after a dot
        clear = 1 if plain and dots and tld.isalpha() and len(tld) >= 2 and x[6] else 0 if not dots or not tld.isalpha() or not x[6] else None
        out.append((start, end, x, clear))
    return out


# --- phone and identity numbers --------------------------------------------------------------------------

_SEP = r"(?:[ .\-/   ‐‑–]|[  ][–\-][  ])"
_NUMBER = re.compile(
    rf"(?<![\w=@#&])(?<!\d[.,:/\-])(?:\(?(?:\+|00)\s?\d{{1,3}}\)?{_SEP}?|\d{{1,3}}{_SEP}(?=\())?(?:\(0\){_SEP}?)?(?:\(\d{{2,5}}\){_SEP}?)?\d{{1,15}}(?:{_SEP}\d{{1,9}}){{0,7}}(?!\w)(?![.,:/\-]\d)"
)
_RUN = re.compile(r"[+(\d][\d+().\-/ \u00a0\u2007\u2009\u202f‐‑–]{6,}\d\)?")
_DECIMALS = re.compile(r"\d+\.\d{1,3}(?: \d+\.\d{1,3})+")
_LETTERED = re.compile(
    r"(?<![\w=@#&+/])(?:[A-Za-z]{2}[ .\-/]?\d{2}[ .\-/]?\d{2}[ .\-/]?\d{2}[ .\-/]?[A-Za-z]|\d{2}\.?\d{3}\.?\d{3}[ \-]?[A-Za-z]|[XYZxyz][ \-]?\d{7}[ \-]?[A-Za-z])(?![\w=+/])"
)
#: What every one of these ends with.
_LETTER_ENDS = re.compile(r"\d[\d .\-/]{5,12}[A-Za-z](?![\w=+/])")
_GROUP = re.compile(r"\d+")


def _plan(groups: list[int], digits: str, foreign: bool, paren: bool) -> float:
    """Shapes of numbering plans: 1 three-three-four, 2 pairs after a first digit, 3 leading zero, 4 nine digits from 6 up."""
    n = len(digits)
    if foreign:
        return 5.0
    if n == 10 and (groups[-1] == 4 and groups[-2:-1] in ([3], []) or n == groups[0]) and digits[0] in "23456789":
        return 1.0
    if n == 11 and digits[0] == "1" and groups[-1] == 4:
        return 1.0
    if n == 10 and digits[0] == "0" and (groups[-4:] == [2, 2, 2, 2] or len(groups) == 1):
        return 2.0
    if digits[0] == "0" and 9 <= n <= 12:
        return 3.0
    if n == 9 and digits[0] in "6789":
        return 4.0
    return 0.0


#: Fixed value: the control letters of Spanish identity numbers by the number's remainder.
_CONTROL = "TRWAGMYFPDXBNJZSQVHLCKE"


def _control_fits(s: str) -> bool | None:
    """Whether the control letter of eight digits (or a letter and seven) fits; None for other formats."""
    bare = "".join(c for c in s if c.isalnum()).upper()
    if len(bare) != 9 or not bare[-1].isalpha() or not (bare[0] in "XYZ" or bare[0].isdigit()) or not bare[1:8].isdigit():
        return None
    return _CONTROL[int(str("XYZ".find(bare[0])) + bare[1:8] if bare[0] in "XYZ" else bare[:8]) % 23] == bare[-1]


def _numbers(text: str, dates: bool = False) -> list[tuple[int, int, list[float], int | None, int | None]]:
    """Spans with features of their format and, where it settles them, whether they are a phone number and an identity number.

    Dates are neither; with ``dates`` they are given as examples of that, in all the surroundings that numbers have.
    """
    out = []
    runs = [m for run in _RUN.finditer(text) for m in _NUMBER.finditer(text, run.start(), min(len(text), run.end() + 1))]
    for pattern, found in ((_NUMBER, runs), (_LETTERED, _LETTERED.finditer(text) if _LETTER_ENDS.search(text) else ())):
        for m in found:
            s = m.group()
            groups = [len(g) for g in _GROUP.findall(s)]
            digits = "".join(c for c in s if c.isdigit())
            n = len(digits)
            lettered = pattern is _LETTERED
            if not lettered and not 8 <= n <= 15:
                continue
            start, end = m.span()
            if s.count("(") != s.count(")") or _DECIMALS.fullmatch(s):
                continue
            date = bool(_DATE.match(s))
            if date and not dates:
                continue
            foreign = bool(re.match(r"\(?(?:\+\s?|00)[1-9]", s)) and n > 9
            paren = "(" in s
            plan = _plan(groups, digits, foreign, paren)
            seps = {c for c in s if not c.isalnum()}
            shape = groups + [0] * 8
            x = [float(n), float(len(groups)), *map(float, shape[:4]), float(groups[-1]), float(max(groups)), float(foreign), float(paren), plan, float(lettered), float("/" in seps), float("." in seps),
                 float("-" in seps), float(digits[0] == "0"), float(text[end : end + 1] in (*".,;:)|\t\n ", "")), float("." in seps and " " in seps), float(s[0].isalpha())]
            is_phone = is_id = None
            if date or "." in seps and " " in seps and not foreign and not paren:
                is_phone = is_id = 0
            elif lettered:
                # two letters, six digits and a letter up to D are written so in one country's insurance numbers
                fits = s[-1] in "ABCDabcd" if s[:2].isalpha() else _control_fits(s)
                is_phone, is_id = 0, 1 if fits else 0 if fits is False else None
            elif (foreign or paren) and plan:
                is_phone, is_id = 1, 0
            elif groups in _ID_GROUPS:
                is_phone, is_id = 0, 1
            elif not plan:
                is_phone = 0
            if is_id is None and groups not in _BARE_GROUPS:
                is_id = 0
            out.append((start, end, x, is_phone, is_id))
    return out


#: The groups in which identity numbers of three countries are written, and only those.
_ID_GROUPS = ([3, 2, 4], [2, 3, 3, 3], [1, 2, 2, 2, 3, 3, 2])
#: Other groups in which identity numbers may be written, as many other numbers are.
_BARE_GROUPS = ([9], [3, 3, 3], [11], [13], [15])
_DATE = re.compile(r"(?:19|20)\d\d[-/.](?:0?[1-9]|1[0-2])[-/.](?:0?[1-9]|[12]\d|3[01])\b")


# --- addresses -------------------------------------------------------------------------------------------

_HOUSE_REST = r"\d{0,5}(?:\s?[\-–/]\s?\d{1,6}|\s?(?:bis|ter|quater)\b|\s?[a-h]\b)?"
_NAME = r"[^\W\d_][\w'’]*(?:-[^\W\d_][\w'’]*)?"
_STREET_EN = r"(?:street|st\.?|road|rd\.?|lane|ln\.?|avenue|ave\.?|drive|dr\.?|close|way|court|ct\.?|crescent|boulevard|blvd\.?|place|pl\.?|terrace|square|sq\.?|row|grove|gardens|walk|hill|mews|parade)"
_STREET_FR = r"(?:rue|avenue|av\.?|boulevard|bd\.?|bld\.?|impasse|chemin|place|pl\.|allée|allées|quai|cours|route|ruelle|square|passage|villa)"
_STREET_ES = r"(?:calle|c/|cl\.|avenida|avda\.?|av\.|plaza|pza\.?|plza\.?|paseo|pº|camino|ronda|travesía|carrera|carretera|callejón)"
_GAP = r"[ \u00a0\u202f\n]"
#: A house number before the street, and one after it, each with the street on that side.
#: Both begin with a digit and look back from there, which lets the search leap from digit to digit.
_NUMBER_FIRST = re.compile(rf"(\d(?<![\w.,/\-]\d){_HOUSE_REST}),?{_GAP}(?=[^\W\d_])", re.I)
_NUMBER_LAST = re.compile(rf"(\d(?<=[^\s\d|;:]{_GAP}\d){_HOUSE_REST})(?![\w,.]\d|\w)", re.I)
_RIGHT = tuple(
    re.compile(p.replace(r"\s", _GAP), re.I)
    for p in (
        rf"((?:[NSEW]\.?|north|south|east|west|ne|nw|se|sw)\s)?({_NAME})(?:\s{_NAME})?\s{_STREET_EN}(?!\w)",
        rf"{_STREET_FR}\s((?:du|des|de\sla|de\sl['’]|de|d['’])\s?)?({_NAME})(?!\w)",
    )
)
_LEFT = tuple(
    re.compile(p.replace(r"\s", _GAP), re.I)
    for p in (
        rf"(?<!\w)()({_NAME}(?:straße|strasse|str\.|weg|allee|platz|gasse|ring|damm|ufer|steig|stieg|chaussee))\s$",
        r"(?<!\w)((?:am|im|an\sder|auf\sder|auf\sdem|zum|zur|unter\sden|hinter\sder)\s)([^\W\d_]\w*)\s$",
        rf"(?<!\w){_STREET_ES}\s?((?:del|de\slas?|de\slos|de)\s)?({_NAME})(?:\s{_NAME})?,?\s(?:n[º°o]\.?\s?|núm\.?\s)?$",
    )
)
_LEFT_HINT = re.compile(r"(?:stra(?:ß|ss)e|str\.|weg|allee|platz|gasse|ring|damm|ufer|stei?g|stieg|chaussee)\W$|\b(?:am|im|an der|auf de[rm]|zu[mr]|unter den|hinter der)\W\w+\W$|\b(?:c/|calle|avenida|avda|av\b|plaza|pza|plza|paseo|camino|ronda|traves|carrer|callej|cl\.|pº)", re.I)


def _streets(text: str):
    """kind, start, end, prefix word and name of each span that has a street and a house number."""
    for m in _NUMBER_FIRST.finditer(text):
        for k, pattern in enumerate(_RIGHT):
            if r := pattern.match(text, m.end()):
                yield k, m.start(), r.end(), r.group(1), r.group(2)
    for m in _NUMBER_LAST.finditer(text):
        # a street's words before its number: its type, up to two small words, up to two names, and a sign for number
        begin = _back(text, m.start(), 7)
        if not _LEFT_HINT.search(text, begin, m.start()):
            continue
        for k, pattern in enumerate(_LEFT):
            if r := pattern.search(text, begin, m.start()):
                yield 2 + k, r.start(), m.end(), r.group(1), r.group(2)


def _addresses(text: str) -> list[tuple[int, int, list[float], int | None]]:
    out = []
    if not _GROUP.search(text):
        return out
    for k, start, end, prefix, name in _streets(text):
        s = text[start:end]
        house = _GROUP.findall(s)
        begin, stop = _back(text, start, 6), min(len(text), end + 60)
        lone = s.upper() == s or text[begin:stop].lower() == text[begin:stop]
        year = len(house[0]) == 4 and house[0][:2] in ("18", "19", "20")
        proper = name[:1].isupper()
        x = [float(k), float(proper), float(lone), float(int(house[0][:6])), float(len(house)), float("\n" in s), float(len(s.split())),
             float(bool(re.search(r"[a-h]\b|bis|ter", s[-6:] + s[:8], re.I))), float(len(name)), float(bool(prefix)), float(year)]
        # a capital name with the type of street and a number that is no year; a year after small words, and numbers of another row
        clear = 1 if k != 3 and proper and not year and "\n" not in s else 0 if year and (k == 3 or not proper) or "\n" in s and not proper else None
        out.append((start, end, x, clear))
    return out


# --- names -----------------------------------------------------------------------------------------------


class _Likely(dict):
    """Whether a word, or the first part of a hyphenated one, scores as a candidate; remembers what it was asked."""

    def __init__(self, score: Letters):
        super().__init__()
        self.score = score

    def __missing__(self, word: str) -> bool:
        if len(self) > 1_000_000:
            self.clear()
        first = word.partition("-")[0]
        got = self[word] = len(first) > 2 and self.score(first) > _LIKELY
        return got


@dataclass
class Letters:
    """How much likelier the letters of a word are in one list of words than in another."""

    weights: dict[str, float] = field(default_factory=dict)
    memory: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.likely = _Likely(self)

    @staticmethod
    def parts(word: str) -> list[str]:
        w = f"^{word}$"
        return [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]

    @classmethod
    def learn(cls, yes: list[str], no: list[str]) -> Letters:
        a, b = (Counter(p for w in ws for p in cls.parts(w)) for ws in (yes, no))
        ta, tb = sum(a.values()) + 1000, sum(b.values()) + 1000
        return cls({p: float(np.log((a[p] + 0.5) / ta) - np.log((b[p] + 0.5) / tb)) for p in a.keys() | b.keys()})

    @classmethod
    def held_out(cls, yes: list[str], no: list[str]) -> Letters:
        """As learnt from all words, but each listed word scores as if its half of the list were unknown: the way that unlisted names will score."""
        whole = cls.learn(yes, no)
        for h in (0, 1):
            rest = cls.learn([w for k, w in enumerate(yes) if k % 2 != h], no)
            whole.memory.update({w: rest(w) for k, w in enumerate(yes) if k % 2 == h})
        return whole

    def __call__(self, word: str) -> float:
        got = self.memory.get(word)
        if got is None:
            if len(self.memory) > 1_000_000:
                self.memory.clear()
            parts = self.parts(word)
            got = self.memory[word] = sum(self.weights.get(p, 0.0) for p in parts) / max(1, len(parts))
        return got

    def __getstate__(self):
        return {"weights": self.weights}

    def __setstate__(self, state):
        self.__init__(state["weights"])


_WORDS = re.compile(r"[^\W\d_]+(?:[-‐][^\W\d_]+)?")
_BEFORE = re.compile(r"(?<![\w@.+\-])([^\W\d_]{2,}|[^\W\d_]\.)((?:\s[^\W\d_]\.)?)\s$")
_AFTER = re.compile(r",\s([^\W\d_]{2,}|[^\W\d_]\.)((?:\s[^\W\d_]\.)?)(?![\w@])")
#: The least score of letters that makes a word a candidate; names that the table lacks score above 1.5, most other words below 0.5.
_LIKELY = 1.1
_TITLES = frozenset("mr mrs ms miss dr prof herr herrn frau m mme mlle sr sra srta don doña señor señora señorita monsieur madame".split())
_TITLE = re.compile(rf"\b(?:{'|'.join(sorted(_TITLES))})\.?\s$", re.I)


def _places(low: str, words: list[str]) -> list[tuple[int, int]]:
    """Where the words stand as whole words, hyphenated ones as a whole."""
    out = []
    for w in words:
        at = low.find(w)
        while at >= 0:
            end = at + len(w)
            if not (at and (low[at - 1].isalpha() or low[at - 1] in "-‐" and low[at - 2 : at - 1].isalpha())) and not (
                low[end : end + 1].isalpha() or low[end : end + 1] in ("-", "‐") and low[end + 1 : end + 2].isalpha()
            ):
                out.append((at, end))
            at = low.find(w, end)
    return out


def _names(text: str, given: Letters, family: Letters, common: frozenset) -> list[tuple[int, int, list[float], int | None]]:
    out = []
    low = text.lower()
    if len(low) != len(text):  # a character whose lower case is several
        low = text
    judged = family.likely
    likely = [w for w in set(_WORDS.findall(low)) if judged[w]]
    if not likely:
        return out
    for start, end in sorted(_places(low, likely)):
        parts = re.split("[-‐]", low[start:end])
        score, last = family(parts[0]), family(parts[-1])
        if start and text[start - 1] in "@.+-_" or text[end : end + 1] in ("@", "_", "＠"):
            continue
        found = []
        ahead = low[_back(low, start, 1) : start].split()
        near = bool(ahead) and low[start - 1].isspace() and (ahead[-1].endswith(".") or given(ahead[-1].lstrip("(\"'“«")) > _LIKELY / 2)
        if near and (b := _BEFORE.search(text, max(0, _back(text, start, 2) - 1), start)):
            title = b.group(1).rstrip(".").lower() in _TITLES
            if b.group(2) and (title or not b.group(1).endswith(".") and given(b.group(1).lower()) < _LIKELY / 2):
                found.append((b.start(2) + 1, end, b.group(2)[1:], "", 0.0))
            else:
                found.append((b.start(), end, b.group(1), b.group(2), 0.0))
        if text[end : end + 1] == "," and (a := _AFTER.match(text, end)):
            found.append((start, a.end(), a.group(1), a.group(2), 1.0))
        for s, e, first, middle, turned in found:
            initial = float(first.endswith("."))
            like = given(first.lower()) if not initial else 0.0
            if like < _LIKELY / 2 and not initial:
                continue
            whole = text[s:e]
            title = float(bool(_TITLE.search(text, max(0, _back(text, s, 1) - 1), s)))
            upper = float(first[:1].isupper()), float(text[start].isupper())
            lower = float(whole.lower() == whole and (around := text[_back(text, s, 4) : e + 40]).lower() == around)
            x = [score, last, like, initial, turned, title, *upper, float(whole.upper() == whole), lower, float(bool(middle)), float(len(parts)), float("\n" in whole),
                 float(text[e : e + 1] in " .,;|\t\n" or e == len(text)), float(len(parts[0])), float(len(first)), float(parts[0] in common), float(first.lower() in common)]
            out.append((s, e, x, None))
    return out


# --- model -----------------------------------------------------------------------------------------------


@dataclass
class Scorer:
    """Trees of a kind over its format and its surroundings, the words that speak for it, and its threshold; without trees the format alone decides."""

    trees: Boosted | None
    cues: Cues
    threshold: float = 0.5

    def features(self, rows: list[tuple]) -> np.ndarray:
        return np.array([[*r[3], *self.cues(r[5]), *r[6]] for r in rows], float)

    def probability(self, rows: list[tuple]) -> np.ndarray:
        if self.trees is None:
            return np.array([float(r[4] == 1) for r in rows])
        return self.trees.probability(self.features(rows))


@dataclass
class PersonalModel:
    given: Letters
    family: Letters
    common: frozenset
    scorers: dict[str, Scorer]
    roles: dict[str, set[str]]

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """The chosen spans of each text, in order."""
        found: dict[str, list] = {k: [] for k in KINDS}
        for i, text in enumerate(texts):
            if text:
                for kind, *c in propose(text, self.given, self.family, self.common, self.roles):
                    found[kind].append((i, *c))
        chosen: list[list[tuple[float, int, int, str]]] = [[] for _ in texts]
        for kind, rows in found.items():
            if rows:
                p, least = self.scorers[kind].probability(rows), self.scorers[kind].threshold
                for (i, s, e, *_), q in zip(rows, p.tolist(), strict=True):
                    if q >= least:
                        chosen[i].append((q, s, e, kind))
        return [_apart(c) for c in chosen]


def _apart(spans: list[tuple[float, int, int, str]]) -> list[tuple[int, int, str]]:
    """Of overlapping spans the more probable, then the longer, then the earlier one; a name inside an address of email is part of that."""
    if len(spans) < 2:
        return [s[1:] for s in spans]
    mails = [(s, e) for _, s, e, kind in spans if kind == "email"]
    spans = [x for x in spans if x[3] != "name" or not any(s <= x[1] and x[2] <= e for s, e in mails)]
    kept: list[tuple[int, int, str]] = []
    for _, s, e, kind in sorted(spans, key=lambda x: (-round(x[0], 2), x[1] - x[2], x[1])):
        if all(e <= a or s >= b for a, b, _ in kept):
            kept.append((s, e, kind))
    return sorted(kept)


def propose(text: str, given: Letters, family: Letters, common: frozenset, roles: dict[str, set[str]], training: bool = False):
    """kind, start, end, features of the format, its label where the format settles it, words around, and figures of the row of each candidate."""
    rows = _Rows(text)
    for s, e, x, clear in _emails(text):
        yield "email", s, e, x, clear, *surroundings(text, rows, s, e)
    for s, e, x, phone, person in _numbers(text, training):
        around = surroundings(text, rows, s, e)
        yield "phone", s, e, x, phone, *around
        yield "id_number", s, e, x, person, *around
    for s, e, x, clear in _addresses(text):
        yield "address", s, e, x, clear, *surroundings(text, rows, s, e)
    for s, e, x, _ in _names(text, given, family, common):
        yield "name", s, e, x, _clear_name(text[s:e], x, roles), *surroundings(text, rows, s, e)


def first_labels(rows: list[tuple]) -> np.ndarray:
    """What the format settles, -1 for the rest. ``rows``: text, start, end, format, label by format, words, row."""
    return np.array([-1 if r[4] is None else r[4] for r in rows], np.int64) if rows else np.empty(0, np.int64)


def _enough(label: np.ndarray, least: int) -> bool:
    return min((label == 0).sum(), (label == 1).sum()) >= least


def _described(rows: list[tuple], label: np.ndarray) -> np.ndarray:
    """The surroundings of each candidate, by words learnt from the labels of the other half of the texts."""
    half = np.array([r[0] for r in rows]) % 2
    out = np.zeros((len(rows), 5 + len(rows[0][6])))
    for h in (0, 1):
        use = np.flatnonzero((half != h) & (label >= 0))
        cues = Cues.learn([rows[k][5] for k in use], label[use].tolist())
        for k in np.flatnonzero(half == h):
            out[k] = [*cues(rows[k][5]), *rows[k][6]]
    return out


def view_labels(rows: list[tuple], config: TrainConfig) -> np.ndarray:
    """The first labels, and those of candidates of which trees that see only the surroundings, fitted on the other half of the texts, are sure."""
    label = first = first_labels(rows)
    if not _enough(first, config.least):
        return label
    label = first.copy()
    half, context = np.array([r[0] for r in rows]) % 2, _described(rows, first)
    for h in (0, 1):
        use = (half != h) & (first >= 0)
        if _enough(first[use], config.least):
            p = fit_boosted(context[use], first[use]).probability(context)
            rest = (half == h) & (first < 0)
            label[rest & (p >= config.sure)] = 1
            # most candidates are none, so it must speak against one, not merely fail to speak for it
            usual = first[use].mean()
            label[rest & (p / (1 - p + 1e-9) <= (1 - config.sure) * usual / (1 - usual))] = 0
    return label


def fit_scorer(rows: list[tuple], label: np.ndarray, config: TrainConfig) -> Scorer:
    """Trees over both views of all labelled candidates, and the threshold at which most of them, held out, are told right."""
    if not _enough(label, config.least):
        return Scorer(None, Cues())
    use = label >= 0
    x, y = np.hstack([np.array([r[3] for r in rows], float), _described(rows, label)])[use], label[use]
    trees, held = fit_held(x, y)
    grid = np.arange(0.05, 0.96, 0.05)
    right = np.array([((held >= g) == (y == 1)).sum() for g in grid])
    best = grid[right == right.max()]
    cues = Cues.learn([r[5] for r, u in zip(rows, use, strict=True) if u], y.tolist())
    return Scorer(trees, cues, float(best[np.argmin(np.abs(best - 0.5))]))


def untold(rows: list[tuple], label: np.ndarray, least: int) -> np.ndarray:
    """The labels, with none for open candidates after a word that stands before ``least`` of them and before no settled one.

    About half of the numbers of a kind are written in a format that settles them, so a word that announces the kind stands before some of these.
    """
    first = first_labels(rows)
    opened = Counter(r[5][2] for r, c in zip(rows, first.tolist(), strict=True) if c < 0)
    settled = {r[5][2] for r, c in zip(rows, first.tolist(), strict=True) if c == 1}
    against = {w for w, n in opened.items() if n >= least and w not in settled}
    return np.array([0 if c < 0 and r[5][2] in against else x for r, c, x in zip(rows, first.tolist(), label.tolist(), strict=True)], np.int64)


def fit_scorers(rows: dict[str, list[tuple]], config: TrainConfig) -> dict[str, Scorer]:
    labels = {k: view_labels(r, config) for k, r in rows.items()}
    for k in ("phone", "id_number"):
        if _enough(first_labels(rows[k]), config.least):
            labels[k] = untold(rows[k], labels[k], config.least // 2)
    # the same numbers are candidates of both kinds: what is one is not the other, and what the views call both counts for neither
    phone, person = labels["phone"], labels["id_number"]
    both = (phone == 1) & (person == 1)
    labels["phone"], labels["id_number"] = np.where(both, -1, np.where(person == 1, 0, phone)), np.where(both, -1, np.where(phone == 1, 0, person))
    return {k: fit_scorer(r, labels[k], config) for k, r in rows.items()}


def train(texts: list[str], lexicon: list[tuple[str, str]], config: TrainConfig = TrainConfig()) -> PersonalModel:
    """``lexicon``: term and role (given, family, place, brand)."""
    roles: dict[str, set[str]] = {r: set() for r in ("given", "family", "place", "brand")}
    for term, role in lexicon:
        if term and role and role.strip().lower() in roles:
            roles[role.strip().lower()].update(w for w in re.split(r"\W+", term.strip().lower()) if w)
    small, all_ = Counter(), Counter()
    for t in texts:
        for w in _WORDS.findall(t):
            all_[w.lower()] += 1
            small[w.lower()] += w.islower()
    common = [w for w, n in all_.most_common(config.common) if small[w] >= 0.8 * n and w not in roles["given"] | roles["family"]]
    elsewhere = common + 8 * sorted(roles["place"] | roles["brand"])
    lists = (sorted(roles["given"]), elsewhere + sorted(roles["family"])), (sorted(roles["family"]), elsewhere + sorted(roles["given"]))
    given, family = (Letters.learn(*x) for x in lists)
    given_held, family_held = (Letters.held_out(*x) for x in lists)
    # five times in a sample of the greatest size
    usual = frozenset(w for w in common if all_[w] >= max(2, 5 * len(texts) / config.documents))
    rows: dict[str, list] = {k: [] for k in KINDS}
    for i, t in enumerate(texts):
        for kind, *c in propose(t, given_held, family_held, usual, roles, training=True):
            rows[kind].append((i, *c))
    return PersonalModel(given, family, usual, fit_scorers(rows, config), roles)


def _clear_name(text: str, x: list[float], roles: dict[str, set[str]]) -> int | None:
    """Names made of words of the table are clear, as are words that the table gives another role or no capitals."""
    turned, initial, title = x[4], x[3], x[5]
    words = [w for w in re.split(r"[\W\d_]+", text.lower()) if len(w) > 1]
    families = [w for w in words if w in roles["family"]]
    givens = [w for w in words if w in roles["given"]]
    proper = x[6] and x[7] or x[9]
    if x[-1] or x[-2]:
        return 0
    if families and (givens or initial) and proper:
        return 1
    if title and families and proper:
        return 1
    if any(w in roles["place"] or w in roles["brand"] for w in words) or not proper:
        return 0
    if x[0] < 1.0 and not families or x[2] < 0.5 and not initial and not givens:
        return 0
    return None


def fit_personal_model(documents: DataFrame, lexicon: DataFrame, config: TrainConfig = TrainConfig()) -> PersonalModel:
    """Train on about ``config.documents`` documents and ``config.text_bytes`` of text at most, chosen by hashes of their id. The name table's size is checked."""
    texts = bounded_sample(documents.select("doc_id", "text"), "doc_id", config.documents, documents.count())
    rows = bounded_texts(texts.where("length(trim(text)) > 0"), "doc_id", "text", config.text_bytes).toPandas().sort_values("doc_id")
    terms = lexicon.select("term", "role").distinct()
    if (size := terms.agg(F.sum(F.octet_length("term"))).first()[0] or 0) > config.names_bytes:
        raise ValueError(f"the name table has {size} bytes, more than the {config.names_bytes} that travel with the code")
    return train(rows.text.tolist(), [(r["term"], r["role"]) for r in terms.collect()], config)


def _map(documents: DataFrame, schema: str, names: list[str], model: PersonalModel, rows: Callable) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1, 2048):
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                out = rows(ids, texts, model.spans(texts))
                yield pa.RecordBatch.from_pylist(out, schema=arrow) if out else pa.RecordBatch.from_pylist([], schema=arrow)

    kinds = {"bigint": pa.int64(), "string": pa.string()}
    arrow = pa.schema([(n, kinds[t.split()[-1]]) for n, t in zip(names, schema.split(","), strict=True)])
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def find_personal_data(documents: DataFrame, model: PersonalModel) -> DataFrame:
    """doc_id, kind, value, start, end (characters) of each piece."""

    def rows(ids, texts, spans):
        return [
            {"doc_id": i, "kind": kind, "value": t[s:e], "start": s, "end": e} for i, t, found in zip(ids, texts, spans, strict=True) for s, e, kind in found
        ]

    return _map(documents, "doc_id bigint, kind string, value string, start bigint, end bigint", ["doc_id", "kind", "value", "start", "end"], model, rows)


def redact(documents: DataFrame, model: PersonalModel) -> DataFrame:
    """doc_id, text with typed placeholders, and the number of pieces replaced; all else is unchanged."""

    def rows(ids, texts, spans):
        out = []
        for i, t, found in zip(ids, texts, spans, strict=True):
            pieces, at = [], 0
            for s, e, kind in found:
                pieces += [t[at:s], PLACEHOLDERS[kind]]
                at = e
            out.append({"doc_id": i, "text": None if t is None else "".join(pieces) + t[at:], "n_replaced": len(found)})
        return out

    return _map(documents, "doc_id bigint, text string, n_replaced bigint", ["doc_id", "text", "n_replaced"], model, rows)
