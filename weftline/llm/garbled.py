"""Texts that were decoded with the wrong character encoding: which they are, and what they said.

A swap of code pages is a substitution cipher over the characters outside ASCII. Letters inside ASCII stay, so every
garbled run has readable neighbours, and a language model of character bigrams tells how well a deciphered run fits
between them.

1. *Language.* One pass counts the character pairs with a member outside ASCII over all texts (by clean and doubtful
   documents). The clean ones give bigram probabilities; the tables are bounded by the alphabets.
2. *Scan.* Each run of characters outside ASCII that the language finds surprising is deciphered under every swap
   (wrong decoder x true encoding); its gain is the difference of the log probabilities. The gain of a document under a
   swap is that of its best contiguous passage. The surprising runs are kept with their neighbours.
3. *Expectation maximisation per source.* Weights of the swaps in a source and the letter that each symbol stands for
   are learned in turns: expected letters from the bigrams and the current table, then the table from the expected letters,
   starting from the code pages where a swap is listed. For a source's documents that no listed swap wins, the letters of
   the symbols in their surprising runs are learned from a flat start; these make up one unlisted swap of the source. A symbol
   is one character, or two where one letter became two, whichever explain more.
4. *Decision and repair.* Documents whose gain with the weight of the swap in their source is high enough are garbled;
   the winning passages are rewritten with the learned table by ``str.translate``.

Text between backquotes on a line is an example and is left alone. U+FFFD and C1 controls never occur in proper text
and decide by themselves; what was lost there is not restored.

Edge cases: null, empty and plain ASCII texts are not garbled; null sources form a source; texts of any length are read
whole; repeated texts get the same answer; an empty table gives empty results.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Code pages that texts are commonly read or written in.
WRONG_SINGLE = ["cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866", "cp1250", "iso8859_2", "iso8859_15"]
WRONG_MULTI = ["gb18030", "shift_jis", "euc_jp", "big5"]
TRUE_SINGLE = ["cp1252", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp852", "cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic", "mac_latin2"]
TRUE_MULTI = ["utf_8", "shift_jis", "euc_jp", "gb18030", "big5"]

#: a run of characters outside ASCII, with the spaces that lost continuation bytes left behind a lead byte
RUN = re.compile(r"[^\x00-\x7f�]+(?:(?<=â)  |(?<=Ã) (?= ))?")
CONTEXT = re.compile(r"(?s).?[^\x00-\x7f]+.?.?.?")
LOST = {"â  ": "’“”–—…€", "Ã ": "à"}
QUOTED = re.compile(r"(?<!`)`[^`\n]+`(?!`)")
NEVER = re.compile("[\x80-\x84\x86-\x9f�]")
WIDE = re.compile("[⺀-鿿가-힯豈-﫿\ue000-\uf8ff]")
PLAIN, RARE = "一", "丁"
TAU = 5.0
SURPRISE_BASE, SURPRISE_MEAN, SURPRISE_PAIR = 5.0, 4.6, -10.5


def unquoted(text: str) -> str:
    """The text with backquoted examples blanked, of the same length."""
    return QUOTED.sub(lambda m: " " * len(m.group()), text) if "`" in text else text


def swaps() -> list[tuple[str, str]]:
    out = [(w, t) for w in WRONG_SINGLE for t in TRUE_MULTI + TRUE_SINGLE if w != t]
    return out + [(w, t) for w in WRONG_MULTI for t in ("utf_8", "shift_jis", "euc_jp", "cp1251", "koi8_r") if w != t] + [("lower", "utf_8"), ("lost", "utf_8")]


SWAPS = swaps()
UNLISTED = len(SWAPS)  # the swap of a source that no pair of code pages above makes; its letters are learned


@lru_cache(maxsize=None)
def byte_of(wrong: str) -> dict[str, int]:
    """Character to byte under a single-byte decoder; bytes it leaves undefined pass as C1 controls."""
    out = {chr(b): b for b in range(128, 160)} if wrong.startswith(("cp125", "iso")) else {}
    for b in range(128, 256):
        c = bytes([b]).decode(wrong, "ignore")
        if c:
            out[c] = b
    return out


@lru_cache(maxsize=None)
def table(wrong: str, true: str) -> dict[int, str]:
    """Character to character for a swap of two single-byte code pages, for translate()."""
    return {ord(c): bytes([b]).decode(true, "replace") for c, b in byte_of(wrong).items()}


@lru_cache(maxsize=None)
def _lower_units() -> tuple[re.Pattern, dict[str, str]]:
    """Units of UTF-8 read as cp1252 and then put in lower case."""
    units = {}
    for cp in [*range(0xA0, 0x250), *range(0x2010, 0x2040), 0x20AC]:
        c = chr(cp)
        try:
            u = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in c.encode())
        except UnicodeError:
            continue
        if u.lower() != u and (c.islower() or not c.isalpha()):
            units.setdefault(u.lower(), c)
    return re.compile("|".join(map(re.escape, sorted(units, key=len, reverse=True)))), units


def decipher(run: str, wrong: str, true: str) -> str | None:
    """The run under a swap; None where the swap cannot have made it."""
    if wrong == "lower":
        pattern, units = _lower_units()
        out = pattern.sub(lambda m: units[m.group()], run)
        return out if out != run else None
    if wrong in WRONG_MULTI:
        if not WIDE.search(run):
            return None
        try:
            raw = run.replace("�", "").encode(wrong)
        except UnicodeError:
            return None
        out = raw.decode(true, "replace")
        return out if out.count("�") * 4 <= len(out) else None
    if true in TRUE_SINGLE:
        return run.translate(table(wrong, true))
    codes = byte_of(wrong)
    raw = bytearray()
    for c in run:
        b = codes.get(c)
        if b is None:
            return None
        raw.append(b)
    if true == "utf_8" and len(raw) < 2:
        return None
    out = bytes(raw).decode(true, "replace")
    return out if "�" not in out or len(run) >= 6 else None


def fold(c: str) -> str:
    """Classes of characters for the bigrams: digits, white space and, in Chinese characters, none."""
    if "a" <= c <= "z" or c > "\x7f":
        return PLAIN if "㐀" <= c <= "鿿" else c
    if "A" <= c <= "Z":
        return c.lower()
    if "0" <= c <= "9":
        return "0"
    return " " if c.isspace() else c


# ---------------------------------------------------------------- pass 1: pairs


def _pairs(texts: list[str]) -> Counter:
    """Counts of (x, y) with a member outside ASCII, and of (x, '') for all x, folded."""
    joined = "\n".join(texts) + "\n"
    a = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lower = np.where((a >= 65) & (a <= 90), a + 32, a)
    lower = np.where((a >= 48) & (a <= 57), 48, lower)
    lower = np.where((a == 9) | (a == 10) | (a == 13), 32, lower).astype(np.int64)
    small = lower < 128
    ascii_n = np.bincount(lower[small], minlength=128)
    one, n_one = np.unique(lower[~small], return_counts=True)
    lower[(lower >= 0x3400) & (lower <= 0x9FFF)] = ord(PLAIN)
    hit = np.flatnonzero(lower > 127)
    left = np.unique(np.concatenate([hit - 1, hit]))
    left = left[(left >= 0) & (left < len(lower) - 1)]
    code, n = np.unique(lower[left] << 21 | lower[left + 1], return_counts=True)
    out = Counter({(chr(c >> 21), chr(c & 0x1FFFFF)): int(k) for c, k in zip(code.tolist(), n.tolist(), strict=True)})
    out.update({(chr(c), ""): int(k) for c, k in zip(one.tolist(), n_one.tolist(), strict=True)})
    out.update({(chr(c), ""): int(k) for c, k in enumerate(ascii_n.tolist()) if k})
    return out


@lru_cache(maxsize=None)
def _signs() -> re.Pattern:
    """Sequences that UTF-8 leaves behind under single-byte decoders, for a first guess at doubtful documents."""
    alternatives = ["[\x80-\x84\x86-\x9f�]"]
    cls = lambda b, lo, hi: "[" + "".join(re.escape(c) for c, x in b.items() if lo <= x <= hi) + "]"
    for w in WRONG_SINGLE:
        b = byte_of(w)
        alternatives.append(cls(b, 0xC3, 0xC5) + cls(b, 0x80, 0xBF) if w not in ("cp1251", "koi8_r", "cp866") else cls(b, 0xE2, 0xE2) + cls(b, 0x80, 0x83) + cls(b, 0x80, 0xBF))
        alternatives.append(cls(b, 0xE2, 0xE3) + cls(b, 0x80, 0x82) + cls(b, 0x80, 0xBF))
    # signs of single-byte swaps: a sign inside a word, a capital after a small letter, accents in a row
    alternatives += ["(?<=[a-z])[¡-©«-¶¸-¿×÷‚„†‡•‰€™ˆ˜¬√∆∞≈ﬁﬂ◊](?=[a-z])", "(?<=[a-z])[À-ÖØ-ÞŠŽŸ]", "(?<=[а-яё])[А-ЯЁ]", "[А-ЯЁ]{2}(?=[а-я])", "[À-ÿŠŽšžŸŒœ]{4}", "(?<=[a-z])[\u0400-\u04ff]"]
    alternatives += ["(?<=[a-z])[\u0370-\u03ff\u0590-\u06ff\u0e00-\u0e7f](?=[a-z])"]  # other scripts inside a word
    return re.compile("|".join(alternatives))


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for b in batches:
        texts = [unquoted(t) for t in b.column(0).to_pylist() if t]
        sign = _signs()
        clean = [t for t in texts if t.isascii() or not sign.search(" ".join(set(CONTEXT.findall(t))))]
        if clean:
            total.update(_pairs(clean))
    keys = list(total)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())], names=["x", "y", "n"])


class Language:
    """Bigram probabilities of clean text, with the characters that belong to it."""

    def __init__(self, pairs: dict[tuple[str, str], int]):
        one = Counter({x: n for (x, y), n in pairs.items() if not y})
        total = max(1, sum(one.values()))
        floor = max(3, total // 2_000_000)
        self.known = {x for x, n in one.items() if n >= floor}
        folded: Counter = Counter()
        self.one: Counter = Counter()
        for x, n in one.items():
            self.one[self.fold(x)] += n
        for (x, y), n in pairs.items():
            if y:
                folded[self.fold(x), self.fold(y)] += n
        self.total, self.logp = total, {}
        for (x, y), n in folded.items():
            self.logp[x, y] = float(np.log((n + 0.5 * self.one[y] / total) / (self.one[x] + 0.5)))
        self.back = {x: float(np.log(0.5 * n / total)) for x, n in self.one.items()}
        self.low = float(np.log(0.1 / total))
        self.logn = {x: float(np.log(n + 0.5)) for x, n in self.one.items()}
        self.mark = hash((total, len(self.known), len(self.logp), round(sum(self.logp.values()), 6)))

    def fold(self, c: str) -> str:
        f = fold(c)
        return (PLAIN if c == PLAIN or c in self.known else RARE) if f == PLAIN else f

    def pair(self, x: str, y: str) -> float:
        p = self.logp.get((x, y))
        return p if p is not None else max(self.low, self.back.get(y, self.low) - self.logn.get(x, 0.0))

    def score(self, left: str, run: str, right: str) -> tuple[float, float]:
        """(sum, least) of the log probabilities along left, run, right."""
        total, least, x = 0.0, 0.0, self.fold(left)
        for c in run + right:
            y = self.fold(c)
            p = self.pair(x, y)
            total += p
            if p < least:
                least = p
            x = y
        return total, least


_DECODERS: dict[int, "Decoder"] = {}


def decoder_for(language: Language) -> "Decoder":
    """The decoder of a language in this process; it lives on from task to task, so that runs are deciphered once."""
    if language.mark not in _DECODERS:
        _DECODERS.clear()
        _DECODERS[language.mark] = Decoder(language)
    return _DECODERS[language.mark]


class Decoder:
    """Gains of runs under the swaps, remembered."""

    def __init__(self, language: Language):
        self.lm = language
        self.seen: dict[tuple[str, str, str], dict[int, float] | None] = {}
        self.calm: set[str] = set()

    def quiet(self, context: str) -> bool:
        """Are the runs in this stretch no surprise? Such stretches are remembered."""
        for m in RUN.finditer(context):
            a, b = m.span()
            if self.gains(context[a - 1] if a else " ", m.group(), context[b] if b < len(context) else " ") is not None:
                return False
        if len(self.calm) > 400_000:
            self.calm.clear()
        self.calm.add(context)
        return True

    def gains(self, left: str, run: str, right: str) -> dict[int, float] | None:
        """None for a run that is no surprise; otherwise gain by swap (those that lose nothing much)."""
        key = (left, run, right)
        if key in self.seen:
            return self.seen[key]
        known = self.lm.known
        old, least = self.lm.score(left, run, right)
        n = len(run) + 1
        if old > -SURPRISE_BASE - SURPRISE_MEAN * n and least > SURPRISE_PAIR:
            out = None
        else:
            out = {}
            for k, (w, t) in enumerate(SWAPS):
                said = self.best_lost(left, run, right) if w == "lost" else self.decipher(run, w, t)
                if said is None or said == run:
                    continue
                lost = said.count("�")
                letters = {c for c in said if c > "\x7f"}
                if len(letters - known) * 3 > len(letters):  # not the letters of any text here
                    continue
                new = self.lm.score(left, said.replace("�", ""), right)[0] - 7.0 * lost
                gain = new - old
                if n == 2 and not (left.isalpha() or right.isalpha()):
                    gain = min(gain, 1.0)  # a letter or sign that stands alone says little
                if gain > -4:
                    out[k] = round(gain, 3)
        if len(self.seen) > 400_000:
            self.seen.clear()
        self.seen[key] = out
        return out

    def best_lost(self, left: str, run: str, right: str) -> str | None:
        """The letter whose later bytes were lost, as the language would have it."""
        for end, letters in LOST.items():
            if run.endswith(end):
                return max((run[: -len(end)] + c for c in letters), key=lambda x: self.lm.score(left, x, right)[0])
        return None

    def decipher(self, run: str, w: str, t: str) -> str | None:
        said = decipher(run, w, t)
        if said is None or t != "utf_8":
            return said
        for _ in range(2):  # garbled more than once
            again = decipher(said, w, t) if any(c > "\x7f" for c in said) else None
            if again is None or "�" in again or again == said:
                break
            said = again
        return said

    def scan(self, text: str) -> tuple[bool, list[tuple[int, float, int, int]], list[str]]:
        """(decided by a character that proper text never has, [(swap, gain, from, to)], surprising runs between their neighbours)."""
        text = unquoted(text)
        contexts = set(CONTEXT.findall(text))
        if contexts <= self.calm:
            return False, [], []
        fresh = contexts - self.calm
        sure = any(NEVER.search(c) for c in fresh)
        if not sure and all([self.quiet(c) for c in fresh]):
            return False, [], []
        runs, active, odd = [], set(), []
        for m in RUN.finditer(text):
            a, b = m.span()
            g = self.gains(text[a - 1] if a else "\n", m.group(), text[b] if b < len(text) else "\n")
            runs.append((a, b, g))
            if g is not None:
                active.update(k for k, v in g.items() if v > 0.5)
                odd.append((text[a - 1] if a else "\n") + m.group() + (text[b] if b < len(text) else "\n"))
        found = []
        for k in active:
            best = now = 0.0
            start = lo = hi = -1
            for a, b, g in runs:
                v = -1.0 if g is None else g.get(k, -4.0)
                if now <= 0:
                    now, start = v, a
                else:
                    now += v
                if now > best:
                    best, lo, hi = now, start, b
            if best > 1:
                found.append((k, best, lo, hi))
        found.sort(key=lambda x: -x[1])
        return sure, found, odd  # all: which of them wins depends on the weights of the source


# ---------------------------------------------------------------- Spark

SCAN = "doc_id long, source string, sure boolean, swaps array<int>, gains array<double>, odd array<string>"


def language_of(texts: DataFrame, text: str = "text") -> Language:
    """Bigrams over all texts. What comes to the driver is bounded by the alphabets, not by the texts."""
    pairs = texts.select(F.col(text).alias("t")).where("t is not null").mapInArrow(_count_pairs, "x string, y string, n long")
    rows = pairs.groupBy("x", "y").agg(F.sum("n").alias("n")).toPandas()
    return Language({(x, y): int(n) for x, y, n in zip(rows.x, rows.y, rows.n, strict=True)})


def scan_documents(docs: DataFrame, language: Language, texts: bool = False) -> DataFrame:
    """(doc_id, source, sure, swaps, gains, odd), with ``texts`` also text, of the documents with any doubt about them; all others are proper text."""
    schema = SCAN + ", text string" * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = decoder_for(language)
        for b in batches:
            keep, sure, swap, gain, odds = [], [], [], [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                if t is None or t.isascii():
                    continue
                certain, found, odd = decoder.scan(t)
                if certain or found or odd:
                    keep.append(i)
                    sure.append(certain)
                    swap.append([f[0] for f in found])
                    gain.append([f[1] for f in found])
                    odds.append(odd)
            idx = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(idx), b.column(1).take(idx), pa.array(sure, pa.bool_()), pa.array(swap, pa.list_(pa.int32())), pa.array(gain, pa.list_(pa.float64())), pa.array(odds, pa.list_(pa.string())), *[b.column(2).take(idx)] * texts], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select("doc_id", "source", "text").mapInArrow(run, schema)


def _weighted(flat: DataFrame, best: DataFrame, sizes: DataFrame, total: int, prior: float = 50.0) -> DataFrame:
    """``flat`` with ``weight``: the share of the documents of the source under the swap, drawn towards the share over all."""
    each = best.groupBy("source", "swap").agg(F.count("*").alias("k")).select(F.col("source").alias("_s"), F.col("swap").alias("_w"), "k")
    over = best.groupBy("swap").agg(F.count("*").alias("k_all"))
    out = flat.join(sizes.select(F.col("source").alias("_n"), "n_docs"), F.col("source").eqNullSafe(F.col("_n"))).drop("_n")
    out = out.join(over, "swap", "left").join(each, F.col("source").eqNullSafe(F.col("_s")) & (F.col("swap") == F.col("_w")), "left").drop("_s", "_w")
    share = (F.coalesce("k", F.lit(0)) + prior * F.coalesce("k_all", F.lit(0)) / total) / (F.col("n_docs") + prior)
    return out.withColumn("weight", F.greatest(share, F.lit(1e-9)))


def decide(scanned: DataFrame, sizes: DataFrame, rounds: int = 2, least: float = 1.0) -> DataFrame:
    """(doc_id, source, sure, swap, odds) of the garbled documents. ``sizes``: (source, n_docs).

    Expectation maximisation over the swaps of each source: the weight of a swap is the share of documents it won;
    a document's log odds are its gain plus the log weight, swaps of equal gain (the same reading) counting together.
    """
    total = sizes.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n")).first().n or 1
    flat = scanned.select("doc_id", "source", F.explode(F.arrays_zip("swaps", "gains")).alias("z")).select("doc_id", "source", F.col("z.swaps").alias("swap"), F.col("z.gains").alias("gain"))
    best = flat.groupBy("doc_id", "source").agg(F.max_by("swap", F.struct("gain", -F.col("swap"))).alias("swap"), F.max("gain").alias("gain")).where("gain > 12")
    won = None
    for _ in range(rounds):
        scored = _weighted(flat, best, sizes, total)
        same = scored.groupBy("doc_id", "source", F.round("gain", 2).alias("gain")).agg(F.sum("weight").alias("weight"), F.max_by("swap", F.struct("weight", -F.col("swap"))).alias("swap"))
        odds = F.col("gain") + F.log("weight")
        won = same.groupBy("doc_id", "source").agg(F.max_by("swap", F.struct(odds, -F.col("swap"))).alias("swap"), F.max(odds).alias("odds")).where(F.col("odds") > least)
        best = won
    certain = scanned.where("sure").select(F.col("doc_id").alias("_d"), F.col("source").alias("_src"))
    out = won.join(certain, F.col("doc_id") == F.col("_d"), "full")
    return out.select(F.coalesce("doc_id", "_d").alias("doc_id"), F.coalesce("source", "_src").alias("source"), F.col("_d").isNotNull().alias("sure"), "swap", "odds")


def garbled_documents(docs: DataFrame, language: Language | None = None) -> DataFrame:
    """The garbled documents of (doc_id, source, text): (doc_id, source, sure, swap, odds); swap is null where only lost characters show."""
    docs = place(docs)
    return garbled_with_ciphers(docs, language or language_of(docs))[0]


def place(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text) in twice as many parts as there are cores, once, before the passes over it, which are bound by CPU."""
    from weftline.session import cut, parallelism

    return cut(docs.select("doc_id", "source", "text").repartition(2 * parallelism(docs.sparkSession), "doc_id"))


def restored_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, restored, lost) of the garbled documents. All texts are read twice; the garbled ones are kept from the second time."""
    from weftline.session import cut

    docs = place(docs)
    lm = language_of(docs)
    scanned = cut(scan_documents(docs, lm, texts=True))
    found, unlisted = garbled_with_ciphers(docs, lm, scanned)
    bad = cut(scanned.select("doc_id", "text").join(found, "doc_id"))
    ciphers = cut(learn_ciphers(cipher_statistics(bad, lm), lm).unionByName(unlisted))
    return restore(bad, lm, ciphers)


def garbled_with_ciphers(docs: DataFrame, language: Language, scanned: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The garbled documents, and (source, swap, symbol, letter, share) of the unlisted swaps found among them."""
    from weftline.session import cut

    scanned = cut(scan_documents(docs, language)) if scanned is None else scanned.drop("text")
    sizes = cut(docs.groupBy("source").agg(F.count("*").alias("n_docs")))
    listed = cut(decide(scanned, sizes))
    rest = scanned.join(listed.where("swap is not null").select("doc_id"), "doc_id", "left_anti").where(F.size("odd") > 0)
    ciphers = cut(unlisted_ciphers(rest, language))
    won = decide_unlisted(scanned.where(F.size("odd") > 0), ciphers, sizes, language)
    both = listed.join(won.select(F.col("doc_id").alias("_d"), F.col("source").alias("_src"), F.col("odds").alias("_o")), F.col("doc_id") == F.col("_d"), "full")
    new = F.coalesce(F.col("_o") > F.coalesce("odds", F.lit(float("-inf"))), F.lit(False))
    swap, odds = F.when(new, F.lit(UNLISTED)).otherwise(F.col("swap")).alias("swap"), F.when(new, F.col("_o")).otherwise(F.col("odds")).alias("odds")
    return both.select(F.coalesce("doc_id", "_d").alias("doc_id"), F.coalesce("source", "_src").alias("source"), F.coalesce("sure", F.lit(False)).alias("sure"), swap, odds), ciphers


# ---------------------------------------------------------------- swaps that are not listed


def unlisted_ciphers(rest: DataFrame, language: Language) -> DataFrame:
    """(source, swap, symbol, letter, share) of the symbols in the surprising runs of documents that no listed swap explains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for source, odd in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total.update({(source, *u) for u in odd_units(odd, language)})  # once a document
        rows = list(total)
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(list(c), pa.string()) for c in cols), pa.array([total[r] for r in rows], pa.int64())], names=["source", "symbol", "before", "after", "n"])

    seen = rest.select("source", "odd").mapInArrow(run, "source string, symbol string, before string, after string, n long")
    seen = seen.groupBy("source", "symbol", "before", "after").agg(F.sum("n").alias("n"))
    letters = _letters(language)
    return seen.groupBy("source").applyInPandas(lambda key, pdf: pd.DataFrame([(key[0], UNLISTED, *x) for x in learn_unlisted(pdf, language, letters)], columns=["source", "swap", "symbol", "letter", "share"]), "source string, swap int, symbol string, letter string, share double")


def odd_units(odd: list[str], language: Language) -> set[tuple[str, str, str]]:
    """(symbol, before, after) of surprising runs, each symbol alone and, in runs of even length, two by two: one letter may have become two."""
    out = set()
    for x in odd:
        for size in (1, 2):
            if (len(x) - 2) % size == 0:
                at = [language.fold(x[0]), *(x[i : i + size] for i in range(1, len(x) - 1, size)), language.fold(x[-1])]
                if size == 1:
                    at[1:-1] = [language.fold(c) for c in at[1:-1]]
                out |= {(x[1 + (i - 1) * size : 1 + i * size], at[i - 1], at[i + 1]) for i in range(1, len(at) - 1)}
    return out


def learn_unlisted(pdf: pd.DataFrame, language: Language, letters: list[str]) -> list[tuple[str, str, float]]:
    """Symbols of one character or of two, whichever explain more of what surprises."""
    found = []
    for size in (1, 2):
        part = pdf[pdf.symbol.str.len() == size]
        table = learn_from_nothing(part, language, letters) if len(part) else []
        known = {x[0] for x in table}
        found.append((int(part.n[part.symbol.isin(known)].sum()) * size, table))
    return max(found, key=lambda x: x[0])[1]


def decipher_with(text: str, cipher: dict[str, str]) -> str:
    """By ``translate`` where every symbol is one character."""
    if all(len(k) == 1 for k in cipher):
        return text.translate({ord(k): v for k, v in cipher.items()})
    return re.sub("|".join(map(re.escape, sorted(cipher, key=len, reverse=True))), lambda m: cipher[m.group()], text)


def _letters(language: Language) -> list[str]:
    return sorted(c for c in language.known if c > "\x7f" and (c.isalpha() or unicodedata.category(c)[0] in "PS") and not "㐀" <= c <= "鿿")


def learn_from_nothing(pdf: pd.DataFrame, language: Language, letters: list[str], rounds: int = 25, least_n: int = 8, least_contexts: int = 2) -> list[tuple[str, str, float]]:
    """(symbol, letter, share) by expectation maximisation from a flat start over (symbol, before, after, n).

    A neighbour that is a symbol itself counts with its expected letters. A letter holds if most of the symbol's occurrences
    take it, in several contexts, and it fits there about as well as it fits in proper text; a swap changes several letters,
    each to another symbol.
    """
    many = pdf.groupby("symbol").agg(n=("n", "sum"), contexts=("n", "size"))
    symbols = many.index[(many.n >= least_n) & (many.contexts >= least_contexts)].tolist()
    cand = [c for c in letters if c not in set(symbols)]
    if len(symbols) < 2 or not cand:
        return []
    at = {s: i for i, s in enumerate(symbols)}
    g = pdf[pdf.symbol.isin(at)]
    own, n = g.symbol.map(at).to_numpy(), g.n.to_numpy(float)
    each = [language.fold(c) for c in cand]
    inner = np.array([[language.pair(a, b) for b in each] for a in each])
    plain = sorted({x for x in [*g.before, *g.after] if x not in at})
    place = {x: i for i, x in enumerate([*plain, *symbols])}
    from_plain = np.array([[language.pair(x, c) for c in each] for x in plain]).reshape(len(plain), len(cand))
    to_plain = np.array([[language.pair(c, x) for c in each] for x in plain]).reshape(len(plain), len(cand))
    before, after = g.before.map(place).to_numpy(), g.after.map(place).to_numpy()
    theta = np.full((len(symbols), len(cand)), 1.0 / len(cand))
    for _ in range(rounds):
        fit = np.vstack([from_plain, theta @ inner])[before] + np.vstack([to_plain, theta @ inner.T])[after]
        post = fit + np.log(theta)[own]
        post = np.exp(post - post.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        theta = np.full(theta.shape, 0.01)
        np.add.at(theta, own, n[:, None] * post)
        theta /= theta.sum(axis=1, keepdims=True)
    usual = {c: np.zeros(2) for c in each}  # sum of the log probabilities around a letter in proper text, and its count
    for (x, y), p in language.logp.items():
        k = np.exp(p) * language.one[x]
        if y in usual:
            usual[y] += (p * k, k)
        if x in usual:
            usual[x] += (p * k, 0)
    out: dict[str, tuple[float, str, float]] = {}
    for s, i in at.items():
        mine, best = own == i, int(theta[i].argmax())
        mean = float((fit[mine, best] * n[mine]).sum() / n[mine].sum())
        total, k = usual[each[best]]
        if theta[i, best] < 0.8 or not k or mean < total / k - 2.0:
            continue
        weight = float(n[mine].sum())
        if cand[best] not in out or out[cand[best]][0] < weight:
            out[cand[best]] = (weight, s, float(theta[i, best]))
    return [(s, c, share) for c, (_, s, share) in out.items()] if len(out) >= 2 else []


def decide_unlisted(scanned: DataFrame, ciphers: DataFrame, sizes: DataFrame, language: Language, prior: float = 50.0, least: float = 1.0) -> DataFrame:
    """(doc_id, source, odds) of the documents whose best passage gains enough by the unlisted swap of their source, as in :func:`decide`."""
    tables = ciphers.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "letter"))).alias("cipher")).select(F.col("source").alias("_s"), "cipher")
    joined = scanned.join(tables, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "source", "odd", "cipher")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, gains = [], []
            for i, (odd, cipher) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                gain = unlisted_gain(odd, dict(cipher), language)
                if gain > 1:
                    keep.append(i)
                    gains.append(gain)
            idx = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(idx), b.column(1).take(idx), pa.array(gains, pa.float64())], names=["doc_id", "source", "gain"])

    gained = joined.mapInArrow(run, "doc_id long, source string, gain double")
    k = gained.where("gain > 12").groupBy("source").agg(F.count("*").alias("k")).select(F.col("source").alias("_s"), "k")
    size = sizes.select(F.col("source").alias("_n"), "n_docs")
    weighed = gained.join(k, F.col("source").eqNullSafe(F.col("_s"))).join(size, F.col("source").eqNullSafe(F.col("_n")))
    return weighed.select("doc_id", "source", (F.col("gain") + F.log(F.col("k") / (F.col("n_docs") + prior))).alias("odds")).where(F.col("odds") > least)


def unlisted_gain(odd: list[str], cipher: dict[str, str], language: Language) -> float:
    """Of the best passage of surprising runs; what the cipher leaves as it is counts against it."""
    best = now = 0.0
    for x in odd:
        said = decipher_with(x[1:-1], cipher)
        gain = -4.0 if said == x[1:-1] else language.score(x[0], said, x[-1])[0] - language.score(x[0], x[1:-1], x[-1])[0]
        now = max(now, 0.0) + gain
        best = max(best, now)
    return best


# ---------------------------------------------------------------- learning and applying the cipher

UNITS = "source string, swap int, symbol string, letter string, before string, after string, n long"


def units_of(run: str, said: str, w: str, t: str) -> list[tuple[str, str]] | None:
    """The run as (symbol, letter) pairs under a swap."""
    if t in TRUE_SINGLE and w in WRONG_SINGLE:
        return list(zip(run, said, strict=True)) if len(run) == len(said) else None
    if t == "utf_8" and w in WRONG_SINGLE:
        codes, out, cur = byte_of(w), [], ""
        for c in run:
            b = codes.get(c)
            if b is None:
                return None
            if (b & 0xC0) != 0x80 and cur:
                out.append(cur)
                cur = ""
            cur += c
        out.append(cur)
        return list(zip(out, said, strict=True)) if len(out) == len(said) else None
    return None


def cipher_statistics(garbled: DataFrame, language: Language) -> DataFrame:
    """How often each symbol of a swap stands between which neighbours, by source, in (source, swap, text)."""
    joined = garbled.where(F.col("swap") < UNLISTED).select("source", "swap", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = decoder_for(language)
        total: Counter = Counter()
        for b in batches:
            for source, swap, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                w, t = SWAPS[swap]
                text = unquoted(text)
                for m in RUN.finditer(text):
                    a, e = m.span()
                    left, right = text[a - 1] if a else "\n", text[e] if e < len(text) else "\n"
                    g = decoder.gains(left, m.group(), right)
                    if not g or g.get(swap, 0) <= 0.5 or w == "lost":
                        continue
                    said = decoder.decipher(m.group(), w, t)
                    units = units_of(m.group(), said, w, t) if said else None
                    for i, (u, x) in enumerate(units or ()):
                        before = units[i - 1][1] if i else left
                        after = units[i + 1][1] if i + 1 < len(units) else right
                        total[source, swap, u, x, language.fold(before), language.fold(after)] += 1
        rows = list(total)
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.string(), pa.int32(), *[pa.string()] * 4]
        yield pa.RecordBatch.from_arrays([*(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)), pa.array([total[r] for r in rows], pa.int64())], names=[x.split()[0] for x in UNITS.split(", ")])

    out = joined.mapInArrow(run, UNITS)
    return out.groupBy("source", "swap", "symbol", "letter", "before", "after").agg(F.sum("n").alias("n"))


def learn_ciphers(statistics: DataFrame, language: Language, rounds: int = 6, faith: float = 4.0) -> DataFrame:
    """(source, swap, symbol, letter, share): the letter each symbol stands for, by expectation maximisation.

    Expected letters come from the bigrams on both sides times the current table; the table is re-estimated from them,
    with ``faith`` counts on the code page's own letter.
    """
    letters = _letters(language)

    def learn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for symbol, g in pdf.groupby("symbol"):
            own = g.groupby("letter").n.sum().idxmax()
            cand = letters if own in letters else [*letters, own]
            index = {c: i for i, c in enumerate(cand)}
            fit = np.array([[language.pair(a, language.fold(c)) + language.pair(language.fold(c), b) for c in cand] for a, b in zip(g.before, g.after, strict=True)])
            n = g.n.to_numpy(float)
            prior = np.full(len(cand), 0.01)
            prior[index[own]] += faith
            theta = prior / prior.sum()
            for _ in range(rounds):
                post = fit + np.log(theta)
                post = np.exp(post - post.max(axis=1, keepdims=True))
                post /= post.sum(axis=1, keepdims=True)
                theta = prior + n @ post
                theta /= theta.sum()
            # another letter than the code page's must win clearly
            best = int(theta.argmax())
            if cand[best] != own and theta[best] < 0.9:
                best = index[own]
            rows.append((key[0], int(key[1]), symbol, cand[best], float(theta[best])))
        return pd.DataFrame(rows, columns=["source", "swap", "symbol", "letter", "share"])

    return statistics.groupBy("source", "swap").applyInPandas(learn, "source string, swap int, symbol string, letter string, share double")


def restore(garbled: DataFrame, language: Language, ciphers: DataFrame) -> DataFrame:
    """(doc_id, restored, lost) of (doc_id, source, swap, text): the text with the garbled runs replaced; ``lost`` counts characters that cannot be had back."""
    tables = ciphers.groupBy("source", "swap").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "letter"))).alias("cipher")).select(F.col("source").alias("_s"), F.col("swap").alias("_w"), "cipher")
    joined = garbled.join(tables, F.col("source").eqNullSafe(F.col("_s")) & (F.col("swap") == F.col("_w")), "left").select("doc_id", "text", "swap", "cipher")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = decoder_for(language)
        for b in batches:
            out, lost = [], []
            for text, swap, cipher in zip(*(b.column(i).to_pylist() for i in range(1, 4)), strict=True):
                new = text if swap is None else rewrite(text, swap, dict(cipher or []), decoder)
                out.append(new)
                lost.append(len(NEVER.findall(unquoted(new))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(lost, pa.int32())], names=["doc_id", "restored", "lost"])

    return joined.mapInArrow(run, "doc_id long, restored string, lost int")


def rewrite(text: str, swap: int, cipher: dict[str, str], decoder: Decoder) -> str:
    """The text with the runs that gain by the swap deciphered: by the learned table where it covers a run, else by the code page."""
    shown, out, at = unquoted(text), [], 0
    for m in RUN.finditer(shown):
        a, e = m.span()
        left, right = shown[a - 1] if a else "\n", shown[e] if e < len(shown) else "\n"
        g = decoder.gains(left, m.group(), right)
        if g is None:
            continue
        if swap == UNLISTED:
            out.append(text[at:a] + decipher_with(m.group(), cipher))
            at = e
            continue
        w, t = SWAPS[swap]
        if g.get(swap, -1.0) < 0:  # parts of such a text may also have lost their case or some bytes
            other = max(((v, k) for k, v in g.items() if SWAPS[k][0] in ("lower", "lost")), default=(0.0, 0))
            if other[0] < 3:
                continue
            w, t = SWAPS[other[1]]
        if w == "lost":
            said = decoder.best_lost(left, m.group(), right)
        else:
            said = decoder.decipher(m.group(), w, t)
            if said is not None and units_of(m.group(), said, w, t):
                said = decipher_with(m.group(), cipher)
                again = decoder.decipher(said, w, t) if t == "utf_8" and said else None
                said = again if again and again != said and "�" not in again else said
        if said is not None:
            out.append(text[at:a] + said)
            at = e
    return "".join(out) + text[at:]
