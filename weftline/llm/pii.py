"""Personal information in free text: a skip-chain conditional random field.

Candidates are found first: e-mail addresses, phone numbers, identity numbers and street addresses by patterns over the
whole text (several spellings each), names as words that start with a capital or are in a list of name parts, leaving
out words that are common as other than names. Each candidate is a binary variable (its type or nothing). Its own potential
comes from features: the pattern, the words around it, endings, the list. Neighbouring name words share a potential,
and so do distant candidates of one document with the same or a similar word (the skip edges), so that a name that is plain in
one sentence is also found where the sentence says nothing. Labels come from loopy belief propagation over each
document, vectorised over a batch of documents.

Weights are fitted by pseudo-likelihood on a bounded sample of texts (``train_texts``) labelled by what is certain: list
names and strong patterns against common words and number-like decoys; a second round adds what the first is sure of.
All documents are searched whole, whatever their length.

Edge cases: null and blank contents hold nothing; repeated deliveries of an id count once; a null id is skipped; the
same value twice is two occurrences; empty tables give empty results; with an empty name list, names are found by context only as far
as the sample teaches it.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import parallelism

TYPES = ["NAME", "EMAIL", "PHONE", "ID_NUMBER", "ADDRESS"]
# Words and formats of the languages the texts are written in.
TITLES = {"mr", "mrs", "ms", "miss", "mx", "dr", "prof", "sir", "dame", "herr", "frau", "mme", "mlle", "m", "monsieur", "madame", "señor", "señora", "srta", "sr", "sra", "senhor", "senhora", "dona", "don", "doña", "pan", "pani", "fräulein", "rev"}
PARTICLES = "von|van|de|der|den|da|do|dos|di|du|del|della|la|le|ter|zu|zum|zur|af|av|el|al|ibn|bin|mac|mc|st"
ID_LABELS = r"ssn|social security(?: number| no\.?)?|national insurance(?: number| no\.?)?|ni(?: number| no\.?)|nino|pass(?:port|eport)(?: number| no\.?| n[°º])?|reisepass(?:nummer)?|pasaporte|passaporte|paszport|tax(?: ?payer)? (?:id|number|no\.?)|tin|itin|steuer-?(?:id|nummer|identifikationsnummer)|nif|nie|dni|cpf|pesel|identity (?:card|number|no\.?)|id(?: card| number| no\.?)|personalausweis(?:nummer)?|ausweis(?:nummer)?|carte d[’']identité|s[ée]cu(?:rit[ée] sociale)?|num[ée]ro de s[ée]cu\w*|insee|n[ií]?ss|cédula|curp"
STREETS = r"Street|St\b\.?|Road|Rd\b\.?|Lane|Ln\b\.?|Avenue|Ave\b\.?|Close|Crescent|Cres\b\.?|Terrace|Court|Ct\b\.?|Way|Drive|Dr\b\.?|Square|Sq\b\.?|Place|Pl\b\.?|Boulevard|Blvd\b\.?|Row|Mews|Hill|Gardens|Grove|Walk|Wharf|Quay|Parade|Rise|Path|Parkway|Highway"
UP = "A-ZÀ-ÖØ-ÞĆČŁŃŚŠŹŻŽ"

#: an address never runs over the end of a line
_S = r"[ \t\u00a0]"
_DOT = rf"(?:\.|{_S}?[\[({{]{_S}?(?:dot|punkt|point|punto){_S}?[\])}}]{_S}?|{_S}(?:dot|punkt){_S})"
_LABEL = r"[\w\-]+"
EMAIL = re.compile(
    rf"(?:mailto:)?(?<![\w.+\-@])[\w+\-](?:[\w.+\-]|%2[bBdDeE])*(?:(?:{_S}(?:dot|punkt){_S}|{_S}?[\[({{]dot[\])}}]{_S}?)[\w+\-]+)*"
    rf"(?:{_S}?@{_S}?|{_S}?[\[({{]{_S}?(?:at|AT|ät){_S}?[\])}}]{_S}?|%40|&#64;|{_S}(?:at|AT){_S}(?={_LABEL}(?:{_S}(?:dot|punkt){_S}|{_S}?[\[({{]dot)))"
    rf"{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,24}}(?![\w@]|-\w)",
)
_DIGIT = "zero|oh|one|two|three|four|five|six|seven|eight|nine|null|eins|zwei|zwo|drei|vier|fünf|sechs|sieben|acht|neun|zéro|un|deux|trois|quatre|cinq|sept|huit|neuf|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve"
_EXT = r"(?:,?\s?(?:ext\.?|extension|x|Durchwahl|DW|poste|anexo|int\.?)\s?\d{1,6})?"
PHONE = re.compile(
    r"(?<![\w.+@/\-–%])(?:(?<!\d[ ])|(?=\())"
    r"(?:"
    rf"(?P<plus>\+\s?\d{{1,3}}(?:[ .\-–/]?\(0\))?(?:[ .\-–/]?(?:\(\d{{1,5}}\)|\d{{1,5}})){{2,6}}){_EXT}"
    rf"|(?P<zeros>00\d{{2}}(?:[ .\-–/]?\d{{1,8}}){{2,6}}){_EXT}"
    rf"|(?P<nanp>(?:1[ .\-–])?(?:\([2-9]\d\d\)\s?|[2-9]\d\d[.\-– ])[2-9]\d\d[.\-– ]\d{{4}}){_EXT}"
    rf"|(?P<plain>[2-9]\d\d[2-9]\d{{6}}){_EXT}"
    rf"|(?P<nat>\(0\d{{1,4}}\)\s?\d{{3,4}}[ \-]?\d{{3,5}}|0\d{{1,4}}[ /]\d{{3,8}}(?:[ \-]\d{{2,6}})?(?:[ \-]\d{{2,4}})?|0\d(?:[. \-]\d\d){{4}}){_EXT}"
    r")(?![\w@%]|[.\-–/]\d)",
    re.I,
)
PHONE_WORDS = re.compile(rf"(?<!\w)(?:(?:{_DIGIT}|double|triple)(?:,? |-)){{6,}}(?:{_DIGIT})(?!\w)", re.I)
DIGIT_WORDS = [w + " " for w in _DIGIT.split("|")]
#: where numbers of some length are; the patterns below are tried only there
DIGITS = re.compile(r"\d[\d ().\-–/]{3,}\d")
ID_LABEL = re.compile(rf"(?<!\w)(?:{ID_LABELS})(?:\s?(?:number|no\.?|nr\.?|n[°º]|is|:|=|#))*\s?:?\s?$", re.I)
ID_VALUE = re.compile(r"(?=(?:[^\d\n]{0,3}\d){5})[A-Z]{0,3} ?\d[\d .\-/]*\d(?: ?[A-Z]\d?(?![a-z\w]))?")
ID_SHAPE = re.compile(
    r"(?P<ssn>(?<![\w.\-/+])\d{3}[-. ]\d{2}[-. ]\d{4}(?![\w\-/]|\.\d))"
    r"|(?P<nino>(?<![\w\-])[A-CEGHJ-PQR-TW-Z]{2}\s?\d\d\s?\d\d\s?\d\d\s?[A-D](?![\w\-]))"
    r"|(?P<card>(?<![\w.\-])\d{4} \d{4} [A-Z](?![\w\-]))"
    r"|(?P<secu>(?<![\w.\-])[12] \d\d (?:0[1-9]|1[0-2]|[2-9]\d) \d[\dAB] \d{3} \d{3}(?: \d\d)?(?![\w\-]))"
    r"|(?P<letters>(?<![\w.\-/=])[A-Z]{1,2}\d{7,8}(?![\w\-]))"
)
NEW_NUMBER = re.compile(r"(?:[/(]|\D )\Z")
BEFORE_DIGITS = re.compile(r"(?:(?<![\w\-])[A-Z]{1,3} ?)?$")
_NAMEWORD = rf"(?:[{UP}](?:[^\W\d_]|[’'\-])+(?!\w))"
_POST = r"[A-Z]{1,2}\d[\dA-Z]? \d[A-Z]{2}|[A-Z]{2} \d{5}|\d{5}"
#: flat, town, post code; a town on a line of its own is one only with its post code
_TOWN = rf"(?:,?[ \n] ?(?:Apt\.? ?\w+|Flat ?\w+|Unit ?\w+|\d{{1,2}}[º°] ?\w))?(?:(?:,\s?(?:\d{{4,5}} )?|\n\d{{4,5}} |\n(?={_NAMEWORD}(?: {_NAMEWORD}){{0,2}},?[ \n](?:{_POST})(?!\w))){_NAMEWORD}(?: {_NAMEWORD}){{0,2}})?(?:,?[ \n](?:{_POST})(?!\w))?"
_VIA_FR = r"rue|avenue|place|boulevard|chemin|quai|allée|impasse|cours|route|square|passage|av\.|bd\.?"
#: house number first: tried where NUMBER_FIRST is
NUMBER_FIRST = re.compile(rf"(?<![\w/.\-])\d{{1,5}}(?:[A-Z]?(?= [{UP}])|(?: (?:bis|ter|quater))?(?=,? (?:{_VIA_FR}) ))")
ADDRESS_FIRST = re.compile(
    rf"(?P<en>\d{{1,5}}[A-Z]? (?:{_NAMEWORD} ){{1,3}}(?:{STREETS})(?:{_TOWN})(?![\w]))"
    rf"|(?P<fr>\d{{1,4}}(?: (?:bis|ter|quater))?,? (?:{_VIA_FR}) (?:(?:de la|de l[’']|des|du|de|d[’']|la|le|les|aux?) ?)*[{UP}][\w’'\-]+(?: (?:(?:de|du|des|la|le) )?[{UP}][\w’'\-]+)*(?:{_TOWN}))"
)
FLAT = re.compile(r"(?:Flat|Apt\.?|Unit|Suite) ?\w{1,4}, ?$")
VIA_ES = ["Calle", "C/", "Avenida", "Avda", "Av.", "Plaza", "Pza", "Paseo", "Pº", "P°", "Camino", "Ronda", "Travesía", "Carrera", "Rua ", "Travessa", "Praça", "Largo ", "Via ", "Viale ", "Piazza", "Corso "]
ADDRESS_ES = re.compile(rf"(?P<es>(?<!\w)(?:{'|'.join(re.escape(v.strip()) for v in VIA_ES)})\.? ?(?:(?:de la|de los|de las|del|de|do|da|dos|das|la|el|los|las) )*[{UP}][\w’'\-]+(?: (?:(?:de|del|la|el|do|da) )*[{UP}][\w’'\-]+)*,? (?:n[º°.] ?)?\d{{1,4}}[a-z]?(?:{_TOWN})(?!\w))")
VIA_DE = "straße|strasse|str\\.|weg|gasse|platz|pfad|allee|ring|damm|ufer|steig|stieg|markt|hof|chaussee"
DE_END = re.compile(rf"(?:{VIA_DE}) \d")
ADDRESS_DE = re.compile(rf"(?P<de>(?<!\w)[{UP}][\w\-]*(?:{VIA_DE}) \d{{1,4}} ?[a-h]?(?:{_TOWN})(?![\w/%]))")
AM_START = ["Am ", "An der ", "An den ", "Auf de", "Im ", "In de", "Zur ", "Zum ", "Unter den ", "Hinter der ", "Bei der "]
ADDRESS_AM = re.compile(rf"(?P<am>(?<!\w)(?:Am|An der|An den|Auf dem|Auf der|Im|In der|In den|Zur|Zum|Unter den|Hinter der|Bei der) (?:[{UP}][^\W\d_]+ ){{1,3}}\d{{1,4}} ?[a-h]?(?:{_TOWN})(?![\w/%-]))")
ADDRESS_PL = re.compile(r"(?P<pl>(?<!\w)(?:ul\.|ulica|al\.|aleja|os\.|pl\.) (?:\w+ )?[A-ZŁŚŻ]\w+ \d{1,4}[a-z]?(?:/\d+)?(?!\w))")
WORD = re.compile(rf"(?<![\w.@/#\\+])[{UP}][^\W\d_]*(?:[’'][{UP}][^\W\d_]*)?(?!\w|-\d|[@+/=]|://)")
DECOY = re.compile(r"(?<![\w.\-/])\d[\d.\-–/]{5,}\d(?:[a-z]{1,2})?(?!\w)")
LEFT = re.compile(r"(?:[^\W_]+|[^\w\s])(?=\s*$)")
GAP = re.compile(rf"\.?(?:[ \-]|, |(?:[A-Za-zÀ-ÿ]\.|{PARTICLES}) )+", re.I)
#: patterns that say what they are wherever they stand; the others ("nanp", "plain", "letters", "am") are read by their places
STRONG = {"email", "plus", "nat", "zeros", "words", "ssn", "nino", "card", "secu", "label", "en", "fr", "es", "de"}


@dataclass
class Candidate:
    start: int
    end: int
    kind: str
    pattern: str
    word: str
    prior: float = 0.0
    features: list[str] = field(default_factory=list)


def _context(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """Up to three words or signs before and after."""
    left = re.findall(r"[^\W_]+|[^\w\s]|\n", text[max(0, start - 36) : start])[-3:]
    right = re.findall(r"[^\W_]+|[^\w\s]|\n", text[end : end + 30])[:2]
    return ["9" if w.isdigit() else w.lower() for w in left], ["9" if w.isdigit() else w.lower() for w in right]


class Finder:
    """Candidates with their features. ``common``: log odds, as a name, of capitalised words that are mostly something else."""

    def __init__(self, given: Iterable[str], family: Iterable[str], common: dict[str, float] | None = None, ambiguous: frozenset[str] = frozenset(), counts: dict[str, int] | None = None):
        self.given, self.family = {w.lower() for w in given}, {w.lower() for w in family}
        self.lexicon, self.common, self.ambiguous, self.counts = self.given | self.family, common or {}, ambiguous, counts or {}

    def structured(self, text: str) -> list[Candidate]:
        out: list[Candidate] = []
        add = lambda m, kind, start=None: out.append(Candidate(m.start() if start is None else start, m.end(), kind, m.lastgroup or kind.lower(), m.group().lower()))
        end = 0
        for at in self._ats(text):
            if at >= end and (m := EMAIL.search(text, max(end, at - 90))) and m.start() <= at < m.end():
                add(m, "EMAIL")
                end = m.end()
        for d in DIGITS.finditer(text):
            s, e = d.span()
            b = BEFORE_DIGITS.search(text[max(0, s - 4) : s])
            v = max(0, s - 4) + b.start()
            n = sum(c.isdigit() for c in d.group())
            if n < 5:
                continue
            begin = max(0, v - 2)
            at = next((x for x in (v, s) if ID_LABEL.search(text[max(0, x - 44) : x])), -1)
            if at >= 0 and (m := ID_VALUE.match(text, at)):
                out.append(Candidate(at, m.end(), "ID_NUMBER", "label", m.group().lower()))
                begin = m.end()
            phones: list[tuple[int, int]] = []
            if 7 <= n:  # several numbers may stand in one stretch
                while begin < e and (m := PHONE.search(text, begin, e + 40)) and m.start() < e:
                    if 9 <= sum(c.isdigit() for c in m.group()) <= 18:
                        add(m, "PHONE")
                        phones.append(m.span())
                    begin = max(m.end(), begin + 1)
            for m in ID_SHAPE.finditer(text, v, e + 8):
                first = at < 0 and m.start() in (v, s)
                later = m.start() > s and NEW_NUMBER.search(text, m.start() - 2, m.start()) and all(m.end() <= a or m.start() >= b for a, b in phones)
                if first or later:
                    add(m, "ID_NUMBER")
        if sum(w in text for w in DIGIT_WORDS) >= 3:
            for m in PHONE_WORDS.finditer(text):
                out.append(Candidate(*m.span(), "PHONE", "words", m.group().lower()))
        for d in NUMBER_FIRST.finditer(text):
            if m := ADDRESS_FIRST.match(text, d.start()):
                f = FLAT.search(text[max(0, m.start() - 14) : m.start()])
                add(m, "ADDRESS", m.start() - (len(f.group()) if f else 0))
        if any(w in text for w in VIA_ES):
            for m in ADDRESS_ES.finditer(text):
                add(m, "ADDRESS")
        if DE_END.search(text):
            for m in ADDRESS_DE.finditer(text):
                add(m, "ADDRESS")
        if any(w in text for w in AM_START):
            for m in ADDRESS_AM.finditer(text):
                add(m, "ADDRESS")
        if "ul." in text or "ulica" in text or "al. " in text or "aleja " in text or "os. " in text:
            for m in ADDRESS_PL.finditer(text):
                add(m, "ADDRESS")
        if len(out) < 2:
            return out
        rank = {"EMAIL": 0, "ID_NUMBER": 1, "PHONE": 2, "ADDRESS": 3}
        out.sort(key=lambda c: (rank[c.kind] + (5 if c.pattern in ("letters", "plain", "am") else 0), c.start, -c.end))
        kept: list[Candidate] = []
        for c in out:
            if all(c.end <= k.start or c.start >= k.end for k in kept):
                kept.append(c)
        kept.sort(key=lambda c: c.start)
        return kept

    @staticmethod
    def _ats(text: str) -> list[int]:
        """Where an at-sign, or what stands for one in EMAIL, is."""
        out = []
        for sign in ("@", "%40", "&#64;"):
            i = text.find(sign)
            while i >= 0:
                out.append(i)
                i = text.find(sign, i + 1)
        if BRACKET.search(text):
            out += [m.start() for m in AT_BRACKET.finditer(text)]
        if "dot" in text or "punkt" in text:
            out += [m.start() + 1 for m in AT_WORD.finditer(text)]
        return sorted(out)

    def names(self, text: str, taken: list[Candidate]) -> list[Candidate]:
        common, counts, lexicon = self.common, self.counts, self.lexicon
        spans = []
        for m in WORD.finditer(text):
            w = m.group()
            s, e = m.span()
            if e - s == 1 or w.lower() in TITLES or (w in common and w.lower() in SMALL):  # they belong to the word after them
                continue
            spans.append((s, e))
        # names in small letters: list words, and unknown words beside one or beside each other
        before = (-9, -9, False)
        for m in LOW.finditer(text):
            w = m.group()
            listed = w in lexicon
            if not listed and w in counts:
                continue
            s, e = m.span()
            if listed:
                spans.append((s, e))
            if s - before[1] == 1 and text[before[1]] in " -":
                if not listed:
                    spans.append((s, e))
                if not before[2]:
                    spans.append(before[:2])
            before = (s, e, listed)
        if not spans:
            return []
        spans = sorted(set(spans))
        out, k = [], 0
        for s, e in spans:
            while k < len(taken) and taken[k].end <= s:
                k += 1
            if k < len(taken) and taken[k].start < e:
                continue
            out.append(Candidate(s, e, "NAME", "word", text[s:e].lower(), common.get(text[s:e], 0.0)))
        return out

    def find(self, text: str) -> list[Candidate]:
        fixed = self.structured(text)
        all_ = fixed + self.names(text, fixed)
        all_.sort(key=lambda c: c.start)
        for c in all_:
            self.describe(text, c)
        for a, b in zip(all_, all_[1:], strict=False):
            if a.kind == b.kind == "NAME" and b.start - a.end <= 14 and self.listed(a.word) and joins(text, a, b):
                if kind := self.listed(a.word):
                    b.features.append(f"Nafter={kind}")
        return all_

    def listed(self, w: str) -> str:
        return "" if w in self.ambiguous else "given" if w in self.given else "family" if w in self.family else ""

    def describe(self, text: str, c: Candidate) -> None:
        left, right = _context(text, c.start, c.end)
        l1 = left[-1] if left else "^"
        l2 = left[-2] if len(left) > 1 else "^"
        l3 = left[-3] if len(left) > 2 else "^"
        r1 = right[0] if right else "$"
        r2 = right[1] if len(right) > 1 else "$"
        k = c.kind[0] if c.kind != "NAME" else "N"
        f = [f"{k}b", f"{k}l1={l1}", f"{k}l2={l2} {l1}", f"{k}l3={l3} {l2} {l1}", f"{k}r1={r1}", f"{k}r2={r1} {r2}", f"{k}lr={l1}|{r1}"]
        if c.kind == "NAME":
            w, raw = c.word, text[c.start : c.end]
            known = w in self.lexicon
            f.append("Nlex" if known and w not in self.ambiguous else "Namb" if known else "Nunk")
            f += [f"Ns3={w[-3:]}", f"Ns4={w[-4:]}", f"Np2={w[:2]}", "Ncap" if raw[0].isupper() and not raw.isupper() else "Nall" if raw.isupper() and len(raw) > 1 else "Nlow"]
            n = self.counts.get(raw, 0)
            f.append("Nc0" if n == 0 else "Nc1" if n < 3 else "Nc2" if n < 10 else "Nc3")
            if l1 in TITLES or (l1 == "." and l2 in TITLES):
                f.append("Ntitle")
            if l1 == "." and len(l2) == 1 and l2.isalpha():
                f.append("Ninitial")
        else:
            f.append(f"pat={c.pattern}")
        c.features = f


SMALL = frozenset(PARTICLES.split("|"))
LOW = re.compile(r"(?<![\w.@/\-=+])[a-zà-öø-ÿćčłńśšźż]{3,}(?![\w@/=+]|\.\w)")
AT_WORD = re.compile(r"[ \t\u00a0](?:at|AT)[ \t\u00a0]")
BRACKET = re.compile(r"[\[({][ \t\u00a0]?[aAä]")
AT_BRACKET = re.compile(rf"[\[({{]{_S}?(?:at|AT|ät){_S}?[\])}}]")


def joins(text: str, a: Candidate, b: Candidate) -> bool:
    """Do two name words belong to one unbroken stretch?"""
    if text[a.end] == "." and len(a.word) > 1:
        return False
    return GAP.fullmatch(text, a.end, b.start) is not None


# ---------------------------------------------------------------- the model


def edges_of(cands: list[Candidate], text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(neighbour edges, skip edges) as pairs of indices into the candidates of a document."""
    near, far = [], []
    for i in range(len(cands) - 1):
        a, b = cands[i], cands[i + 1]
        if a.kind == b.kind == "NAME" and b.start - a.end <= 14 and not a.prior and not b.prior and joins(text, a, b):
            near.append((i, i + 1))
    last: dict[tuple[str, str], int] = {}
    for i, c in enumerate(cands):
        keys = [(c.kind, c.word)]
        if c.kind == "NAME" and len(c.word) > 5:
            keys.append((c.kind, c.word[:5] + "~"))
        for key in keys:
            j = last.get(key)
            if j is not None and (j, i) not in near and (not far or far[-1] != (j, i)):
                far.append((j, i))
            last[key] = i
    return near, far


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    near: float
    far: float

    def unary(self, features: list[str]) -> float:
        w, index = self.weights, self.index
        return sum(w[k] for x in features if (k := index.get(x)) is not None)


def propagate(h: np.ndarray, edges: np.ndarray, strength: np.ndarray, rounds: int = 12, damping: float = 0.3) -> np.ndarray:
    """Beliefs (half log odds) of binary variables by loopy belief propagation; h: half log odds, edges: pairs of variables."""
    if not len(edges):
        return h
    src = np.concatenate([edges[:, 0], edges[:, 1]])
    dst = np.concatenate([edges[:, 1], edges[:, 0]])
    t = np.tanh(np.concatenate([strength, strength]))
    m = len(edges)
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    u = np.zeros(2 * m)
    for _ in range(rounds):
        total = h + np.bincount(dst, weights=u, minlength=len(h))
        new = np.arctanh(np.clip(t * np.tanh(total[src] - u[back]), -0.999999, 0.999999))
        u = damping * u + (1 - damping) * new
    return h + np.bincount(dst, weights=u, minlength=len(h))


class _Places:
    """Silver labels of structured candidates by the places they stand in.

    A place (the one or two words before) where plain patterns of a type stand is a place for that type, and others there are
    of the type too. Where a share p of a type has plain patterns, a place that has n others and no plain one has it by
    chance with probability (1 - p)^n: below ``chance``, what stands there is something else. A value that keeps coming back
    in one place belongs to nobody.
    """

    def __init__(self, cands: Iterable[Candidate], chance: float = 0.01, again: int = 8):
        self.chance, self.again = chance, again
        self.times: Counter = Counter()
        self.plain: Counter = Counter()
        self.kinds: Counter = Counter()
        self.values: dict[tuple[str, str], set[str]] = defaultdict(set)
        for c in cands:
            self.kinds[c.kind, c.pattern in STRONG] += 1
            for f in c.features[1:3]:
                self.times[c.kind, f] += 1
                self.plain[c.kind, f] += c.pattern in STRONG
                if len(self.values[c.kind, f]) < 2:
                    self.values[c.kind, f].add(c.word)

    def label(self, c: Candidate) -> int:
        keys = [(c.kind, f) for f in c.features[1:3]]
        if any(self.times[k] >= self.again and len(self.values[k]) == 1 for k in keys):
            return -1
        if c.pattern in STRONG or any(self.plain[k] for k in keys):
            return 1
        share = self.kinds[c.kind, True] / (self.kinds[c.kind, True] + self.kinds[c.kind, False])
        if any((1 - share) ** self.times[k] < self.chance for k in keys):
            return -1
        return int(share < 0.05 and c.pattern == "nanp")  # hardly a plain pattern to compare with


def fit(texts: list[str], finder: Finder, rounds: int = 2, steps: int = 80, ridge: float = 2e-5) -> Model:
    """Weights by pseudo-likelihood on silver labels: +1, -1 or 0 (unknown)."""
    feats: list[list[str]] = []
    label: list[int] = []
    near: list[tuple[int, int]] = []
    far: list[tuple[int, int]] = []
    # words that are mostly something else have their log odds already; they would only outnumber all others here
    found = [(t, c) for t in texts if (c := [x for x in finder.find(t) if not x.prior])]
    # a frequent phrase that only ever has the one list word in it is no place for names
    once: Counter = Counter()
    words: dict[str, set] = defaultdict(set)
    total: Counter = Counter()
    near_word: Counter = Counter()
    for text, cands in found:
        for c in cands:
            if c.kind == "NAME":
                total[c.word] += 1
                for f in c.features[1:7]:
                    near_word[c.word, f] += 1
                if c.word in finder.lexicon:
                    for f in c.features[5:7]:
                        once[f + c.word] += 1
                        words[f].add(c.word)
    fixed = {w for (w, _), n in near_word.items() if w not in finder.lexicon and total[w] >= 4 and n >= 0.8 * total[w]}
    # a word that keeps standing before a given name is no name itself
    leads: Counter = Counter()
    for text, cands in found:
        for a, b in zip(cands, cands[1:], strict=False):
            if a.kind == b.kind == "NAME" and b.word in finder.given and a.word not in finder.lexicon and b.word not in finder.ambiguous and text[a.end : b.start] == " ":
                leads[a.word] += 1
    fixed |= {w for w, n in leads.items() if n >= 2 and n * 4 >= total[w]}
    phrase = {k for f, ws in words.items() if len(ws) <= 2 for w in ws if once[k := f + w] >= 4}
    places = _Places(c for _, cands in found for c in cands if c.kind != "NAME")
    for text, cands in found:
        base = len(feats)
        n, f = edges_of(cands, text)
        sure = [c.kind == "NAME" and c.word in finder.lexicon and c.word not in finder.ambiguous for c in cands]
        beside: dict[int, list[int]] = defaultdict(list)
        for a, b in n:
            beside[a].append(b)
            beside[b].append(a)
        for i, c in enumerate(cands):
            if c.kind != "NAME":
                y = places.label(c)
            elif not beside[i] and (c.features[6] + c.word in phrase or c.features[5] + c.word in phrase):
                y = -1
            elif sure[i] or (c.word not in fixed and any(sure[j] for j in beside[i])):
                y = 1
            elif c.word in fixed or finder.counts.get(text[c.start : c.end], 0) >= 20 or any(finder.counts.get(text[cands[j].start : cands[j].end], 0) >= 20 for j in beside[i]):
                y = -1
            else:
                y = 0
            feats.append(c.features)
            label.append(y)
        near += [(a + base, b + base) for a, b in n]
        far += [(a + base, b + base) for a, b in f]
        # number-like things that no pattern takes teach what stands beside numbers of other kinds
        for m in DECOY.finditer(text):
            if all(m.end() <= c.start or m.start() >= c.end for c in cands):
                for kind in ("PHONE", "ID_NUMBER"):
                    d = Candidate(*m.span(), kind, "decoy", m.group())
                    finder.describe(text, d)
                    feats.append([x for x in d.features if not x.startswith("pat=")])
                    label.append(-1)
    seen = Counter(x for f in feats for x in set(f))
    index = {x: i for i, x in enumerate(x for x, n in seen.items() if n >= 3)}
    width = max((len(f) for f in feats), default=1)
    pad = len(index)
    x = np.full((len(feats), width), pad, np.int64)
    for i, f in enumerate(feats):
        cols = [index[v] for v in f if v in index]
        x[i, : len(cols)] = cols
    drop = np.array([index.get("Nlex", pad), index.get("Nunk", pad)])
    y = np.array(label)
    ne, fe = np.array(near, np.int64).reshape(-1, 2), np.array(far, np.int64).reshape(-1, 2)
    w = np.zeros(pad + 1)
    j = np.array([0.5, 0.3])
    rng = np.random.default_rng(5)
    for r in range(rounds):
        half = rng.random(len(y)) < 0.5  # half of the examples do without the list, so that contexts are learned
        xs = np.where(half[:, None] & np.isin(x, drop), pad, x)
        use = np.flatnonzero(y != 0)
        if not len(use):
            break
        s = y.astype(float)
        g2, gj2 = np.full(pad + 1, 1e-8), np.full(2, 1e-8)
        field_ = np.stack([_sum(len(y), ne, s), _sum(len(y), fe, s)], axis=1)
        pos, neg = (y > 0).sum(), (y < 0).sum()
        weight = np.where(y > 0, 1.0, min(1.0, 3.0 * pos / max(1, neg)))[use]
        for _ in range(steps):
            z = w[xs[use]].sum(axis=1) + 2 * field_[use] @ j
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            err = (p - (y[use] > 0)) * weight
            g = np.bincount(xs[use].ravel(), weights=np.repeat(err, width), minlength=pad + 1) / len(use) + ridge * w
            g[pad] = 0
            g2 += g * g
            w -= 0.5 * g / np.sqrt(g2)
            gj = 2 * err @ field_[use] / len(use)
            gj2 += gj * gj
            j = np.clip(j - 0.05 * gj / np.sqrt(gj2), 0.05, 1.5)
        if r + 1 < rounds:
            z = w[x].sum(axis=1) + 2 * field_ @ j
            free = np.array(label) == 0
            y = np.where(free & (z > 3), 1, np.where(free & (z < -3), -1, np.array(label)))
    return Model(index, w[:-1], float(j[0]), float(j[1]))


def _sum(n: int, edges: np.ndarray, s: np.ndarray) -> np.ndarray:
    if not len(edges):
        return np.zeros(n)
    return np.bincount(edges[:, 0], weights=s[edges[:, 1]], minlength=n) + np.bincount(edges[:, 1], weights=s[edges[:, 0]], minlength=n)


def decode(texts: list[str | None], finder: Finder, model: Model) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, type) of each text, in order."""
    docs, h, edges, strength = [], [], [], []
    for text in texts:
        cands = finder.find(text) if text and not text.isspace() else []
        base = len(h)
        if cands:
            h += [(model.unary(c.features) + c.prior) / 2 for c in cands]
            near, far = edges_of(cands, text)
            edges += [(a + base, b + base) for a, b in near] + [(a + base, b + base) for a, b in far]
            strength += [model.near] * len(near) + [model.far] * len(far)
        docs.append((text, cands, base))
    belief = propagate(np.array(h), np.array(edges, np.int64).reshape(-1, 2), np.array(strength))
    return [_spans(text, cands, belief[base : base + len(cands)], finder) for text, cands, base in docs]


def _spans(text: str, cands: list[Candidate], belief: np.ndarray, finder: Finder) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    last: Candidate | None = None
    for c, b in zip(cands, belief.tolist(), strict=True):
        if b <= 0:
            if c.kind == "NAME":
                last = None
            continue
        if c.kind != "NAME":
            out.append((c.start, c.end, c.kind))
            last = None
            continue
        if last is not None and c.start - last.end <= 14 and joins(text, last, c):
            comma = "," in text[last.end : c.start]
            if not comma or (last.word not in finder.given and c.word not in finder.family):
                out[-1] = (out[-1][0], c.end, "NAME")
                last = c
                continue
        start = c.start
        m = TITLE_BEFORE.search(text[max(0, start - 24) : start])
        if m and (not out or out[-1][1] <= max(0, start - 24) + m.start()):
            start = max(0, start - 24) + m.start()
        out.append((start, c.end, "NAME"))
        last = c
    return out


TITLE_BEFORE = re.compile(rf"(?<!\w)(?:(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.? (?:[{UP}]\. ?)*|(?:[{UP}]\. ?)+)\Z", re.I)


# ---------------------------------------------------------------- Spark


def _current(df: DataFrame, src_table: str, version: str | None) -> DataFrame:
    rows = df.where("id is not null").select(F.lower("id").alias("record_id"), (F.col(version) if version else F.lit(0)).alias("version"), "content")
    return rows.select(F.lit(src_table).alias("src_table"), "record_id", "version", "content")


def current_contents(tables: list[tuple[str, DataFrame, str | None]]) -> DataFrame:
    """(src_table, record_id, content) of the current row of each id with a content, of [(name, table, version column)].

    Versions are compared on ids and hashes; contents are shuffled once, by id, into twice as many parts as there are
    cores, since what follows is bound by CPU.
    """
    parts = None
    for name, df, version in tables:
        rows = _current(df, name, version).withColumn("h", F.xxhash64("content"))
        best = rows.groupBy("record_id").agg(F.count("*").alias("times"), F.max(F.struct("version", "h")).alias("best"))
        many = best.where("times > 1").select(F.col("record_id").alias("_r"), F.col("best.version").alias("_v"), F.col("best.h").alias("_h"))
        # one join on the id; dropping repeats afterwards needs no further shuffle
        placed = rows.repartition(2 * parallelism(df.sparkSession), "record_id")
        now = placed.join(many, F.col("record_id") == F.col("_r"), "left").where(F.col("_r").isNull() | (F.col("version").eqNullSafe(F.col("_v")) & F.col("h").eqNullSafe(F.col("_h"))))
        both = now.select("src_table", "record_id", "content").dropDuplicates(["record_id"]).where("content is not null").select("src_table", "record_id", "content")
        parts = both if parts is None else parts.unionByName(both)
    return parts


def train(tables: list[tuple[str, DataFrame, str | None]], known_names: DataFrame, train_texts: int = 9_000, train_chars: int = 20_000) -> tuple[Finder, Model]:
    """Finder and model from all current contents and the fixed list of name parts.

    Words are counted over all current contents. Only what the weights are fitted on is bounded: at most about
    ``train_texts`` texts, chosen by a hash of their ids, of each at most ``train_chars`` characters.
    """
    names = known_names.select("name_part", "part_kind").collect()  # fixed, about 200 rows
    given = [r.name_part for r in names if r.part_kind == "given" and r.name_part]
    family = [r.name_part for r in names if r.part_kind != "given" and r.name_part]
    texts: list[str] = []
    for _, df, _ in tables:
        rows = df.where("content is not null and id is not null")
        n = rows.count()
        every = max(1, n * len(tables) // train_texts)
        texts += [r.content for r in rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select(F.substring("content", 1, train_chars).alias("content")).limit(train_texts).collect()]
    return prepare(texts, given, family, count_words(current_contents(tables), given, family, train_texts))


def words_of(text: str, lexicon: set[str], given: set[str] = frozenset()) -> set[tuple[str, str, str]]:
    """What a text is counted for, once each: capitalised and small words, words beside a list word or before a given name, capitalised pairs."""
    out, prev, end = set(), "", -9
    for m in WORD.finditer(text):
        w = m.group()
        out.add(("cap", w, ""))
        if m.start() - end == 1 and (w.lower() in lexicon) != (prev.lower() in lexicon):
            out.add(("beside", prev if w.lower() in lexicon else w, ""))
            if w.lower() in given and text[end] == " ":
                out.add(("lead", prev, ""))
        prev, end = w, m.end()
    out.update(("low", w, "") for w in LOW.findall(text))
    # pairs tell list words that are ordinary words as well
    out.update(("pair", a, b) for a, b in PAIR.findall(text) if (a.lower() in lexicon) != (b.lower() in lexicon))
    return out


def count_words(contents: DataFrame, given: list[str], family: list[str], per: int) -> Counter:
    """In how many of ``per`` texts each of :func:`words_of` is, by all contents; as it is where there are no more than ``per``.

    What comes to the driver is bounded by the words of ``per`` texts: counts that round to 0 stay away.
    """
    lexicon = {w.lower() for w in given} | {w.lower() for w in family}
    only_given = {w.lower() for w in given} - {w.lower() for w in family}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def rows() -> pa.RecordBatch:
            cols = list(zip(*total, strict=True)) if total else [[]] * 3
            return pa.RecordBatch.from_arrays([*(pa.array(list(c), pa.string()) for c in cols), pa.array(list(total.values()), pa.int64())], names=["kind", "a", "b", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                total.update(words_of(t, lexicon, only_given))
                total["texts", "", ""] += 1
            if len(total) > 500_000:
                yield rows()
                total.clear()
        yield rows()

    from weftline.session import cut

    counted = cut(contents.select("content").mapInArrow(run, "kind string, a string, b string, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")))
    texts = counted.where("kind = 'texts'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = min(1.0, per / max(1, texts))
    return Counter({(r.kind, r.a, r.b): r.n for r in counted.select("kind", "a", "b", F.round(F.col("n") * share).cast("long").alias("n")).where("n > 0").collect()})


def prepare(texts: list[str], given: list[str], family: list[str], counted: Counter | None = None) -> tuple[Finder, Model]:
    """Finder and model fitted on ``texts``; ``counted`` as of :func:`count_words`, else of these texts."""
    lexicon = {w.lower() for w in given} | {w.lower() for w in family}
    if counted is None:
        only_given = {w.lower() for w in given} - {w.lower() for w in family}
        counted = Counter(x for t in texts for x in words_of(t, lexicon, only_given))
    kinds: dict[str, Counter] = {"cap": Counter(), "low": Counter(), "beside": Counter(), "lead": Counter(), "texts": Counter()}
    pairs: Counter = Counter()
    for (kind, a, b), n in counted.items():
        if kind == "pair":
            pairs[a, b] = n
        else:
            kinds[kind][a] = n
    caps, lows, beside = kinds["cap"], kinds["low"], kinds["beside"]
    ambiguous = {w for w in lexicon if lows[w] >= 8 and lows[w] >= caps[w.capitalize()]}
    for (a, b), n in pairs.items():
        for w, o in ((a, b), (b, a)):
            if w.lower() in lexicon and o.lower() not in lexicon and n >= 25 and n * 4 >= caps[w]:
                ambiguous.add(w.lower())
    common = {w for w, n in caps.items() if n >= 25 and w.lower() not in lexicon and (beside[w] * 6 < n or lows[w.lower()] >= 5)}
    keep = {o for (a, b), n in pairs.items() for w, o in ((a, b), (b, a)) if w.lower() in ambiguous and o in common}
    words = dict(caps)
    words.update({w: n for w, n in lows.items() if n >= 2})
    odds = {w: math.log((beside[w] + 0.5) / (2 * max(caps[w], lows[w.lower()]) + 0.5)) for w in common - keep}
    # each time a word stands before a given name speaks against it: another given name hardly ever does
    odds |= {w: max(-6.0, -3.4 * n) for w, n in kinds["lead"].items() if w.lower() not in lexicon and n >= 2 and n * 4 >= caps[w]}
    finder = Finder(given, family, odds, frozenset(ambiguous), words)
    return finder, fit(texts, finder)


PAIR = re.compile(rf"(?<![\w.@/])(?=([{UP}][^\W\d_]+) ([{UP}][^\W\d_]+)(?!\w))")

FOUND = "src_table string, record_id string, pii_type string, nth int, start int, end int"


def find_pii(contents: DataFrame, finder: Finder, model: Model) -> DataFrame:
    """(src_table, record_id, pii_type, nth, start, end): one row for each occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                take, kind, nth, start, end = [], [], [], [], []
                for i, spans in enumerate(decode(part.column(2).to_pylist(), finder, model)):
                    count: Counter = Counter()
                    for s, e, t in spans:
                        count[t] += 1
                        take.append(i)
                        kind.append(t)
                        nth.append(count[t])
                        start.append(s)
                        end.append(e)
                idx = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(idx), part.column(1).take(idx), pa.array(kind, pa.string()), pa.array(nth, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=[x.split()[0] for x in FOUND.split(", ")])

    return contents.select("src_table", "record_id", "content").mapInArrow(run, FOUND)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, t in spans:
        out += [text[at:s], f"[{t}]"]
        at = e
    return "".join(out) + text[at:]


def redact_contents(contents: DataFrame, finder: Finder, model: Model) -> DataFrame:
    """(src_table, record_id, redacted, n): each content with a typed placeholder for each occurrence, all else unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                texts = part.column(2).to_pylist()
                spans = decode(texts, finder, model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([redact(t, s) for t, s in zip(texts, spans, strict=True)], pa.string()), pa.array([len(s) for s in spans], pa.int32())], names=["src_table", "record_id", "redacted", "n"])

    return contents.select("src_table", "record_id", "content").mapInArrow(run, "src_table string, record_id string, redacted string, n int")
