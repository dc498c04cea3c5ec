"""Texts that were decoded with the wrong character encoding: found and restored as substitution ciphers.

Each wrong pair of encodings is a cipher from true text to garbled text. Which ciphers a source suffers from, and what
each byte stands for under them, is learned by expectation-maximization against a bigram model of letters, itself
learned from the corpus: the E-step weighs, for every word with letters beyond ASCII, its readings under all ciphers;
the M-step re-estimates the ciphers' weights for each source, the letter behind each byte, and the bigrams of the words
as read. The letters start from the pages: at each byte the E-step weighs, beside the letter of the page, every letter
that its neighbours allow. Where others win in a source, the source gets a cipher of its own (named with ``*``), whose
letters the next round starts from. Tables are applied with ``translate``; ciphers of several bytes a letter are read by
their bytes and have no letters to learn.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavemill.llm.mixture import normal_source
from wavemill.sources.tables import materialise

#: Single-byte encodings of the languages of the corpus, as read and as written.
PAGES = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "iso8859-5", "cp866", "mac-roman", "cp437", "cp850")
#: Encodings of several bytes a letter, as written.
WIDE = ("utf-8", "shift_jis", "euc_jp")
#: Sources fall into so many groups, each with weights of its own; that bounds what is sent to the workers.
GROUPS = 1024
#: Words' worth of belief that the weights of the whole corpus have in each source group.
BACKED = 500.0
#: Share of a cipher's bytes that may stand for another letter than its table says, and how many letters share it.
ODD, LETTERS = 5e-2, 128
#: Different words' worth of belief that a table has in each of its letters; how likely a cipher must be for a word to
#: count for its letters (many clean words that are a little likely under a cipher would add up to wrong ones).
LETTER_BACKED, SURE = 5.0, 0.5
#: How many times likelier than any other a letter must be to replace that of the table.
CLEAR = 2.0
#: How many times more of a source's letters must be those that the table has already than others, for a cipher of its own.
PAGES_KEPT = 3.0
#: Rounds of expectation-maximization, and how many more at most as long as the letters change.
ROUNDS = 2
MORE_ROUNDS = 4
#: Prior odds of a cipher in a source before anything is learned, and the log odds a document needs to be reported.
PRIOR, ENOUGH = 1e-4, -2.6
#: Shares of a document's words that may be garbled, tried in turn.
PARTS = (0.02, 0.07, 0.25, 0.8)
#: Rounds of the same or another cipher, one over the other, that are undone.
DEPTH = 3
#: Words that one task of the learning weighs, and words (or pairs of text and word) that are weighed at a time.
WORDS_PER_TASK, CHUNK = 10_000, 20_000
#: Words a worker remembers.
REMEMBERED = 1 << 17
#: Readings less likely than the word by more than this are left out of a document's odds, of which each is 10 ** -6.
HOPELESS = -16.0
#: Least probability of a reading for it to count in the bigrams.
SEEN = 1e-2

#: Code points that stand for whole categories in folded words, and the cost (log odds) of one character of such.
FIRST_CLASS, RARE = 0xE000, math.log(1000)

_SPACES = re.compile(r"[ \t\r\n\f\v]+")
_BEYOND = re.compile(r"[^\x00-\x7f]")
#: Only words with one of these are weighed: a no-break space alone tells nothing.
_SUSPECT = re.compile(r"[^\x00-\x7f\xa0]")
#: What no true text has, and what a Japanese one has.
_NO_TEXT = re.compile("[\x80-\x9f\ufffd]")
_JAPANESE = re.compile("[\u3041-\u30ff\u4e00-\u9fff]")


def _page(name: str) -> dict[str, int]:
    """Letter to byte of a page's upper half; bytes without a letter count as control characters, as is usual."""
    return {bytes([b]).decode(name, "ignore") or chr(b): b for b in range(128, 256)}


_OF = {p: _page(p) for p in PAGES}
_LETTER = {p: {b: c for c, b in t.items()} for p, t in _OF.items()}
_KNOWN = {x for t in _OF.values() for c in t for x in (c, c.lower()) if len(x) == 1 and unicodedata.category(c)[0] != "C"}


def folded(word: str) -> str:
    """The word over the bounded alphabet of the bigram model: lower case, one digit, one ideograph, letters outside
    the pages and kana by their category."""
    out = []
    for c in unicodedata.normalize("NFC", word.lower()):
        o = ord(c)
        if o < 128:
            out.append("0" if c.isdigit() else c)
        elif c in _KNOWN or 0x3041 <= o <= 0x30FF:
            out.append(c)
        elif 0x4E00 <= o <= 0x9FFF:
            out.append("一")
        elif 0x80 <= o < 0xA0 or o == 0xFFFD:
            out.append("\x80")
        else:
            out.append(chr(FIRST_CLASS + "LMNPSZC".index(unicodedata.category(c)[0])))
    return "^" + "".join(out) + "$"


def ideographs(word: str) -> list[str]:
    """The characters that the folded word holds only by their class."""
    return [c for c in unicodedata.normalize("NFC", word) if 0x4E00 <= ord(c) <= 0x9FFF]


class _Steps(dict):
    """Log probability of the second letter of a pair after the first, kept once computed."""

    def __init__(self, lm: Bigrams):
        super().__init__()
        self.lm = lm

    def __missing__(self, pair: str) -> float:
        lm, (a, b) = self.lm, pair
        q = (lm.letter.get(b, 0.0) + 0.01) / lm.total
        s = math.log((lm.pair.get(pair, 0.0) + 2.0 * q) / (lm.first.get(a, 0.0) + 2.0))
        self[pair] = s = s - RARE if FIRST_CLASS <= ord(b) < FIRST_CLASS + 7 else s
        return s


class Bigrams:
    """Smoothed log probabilities of words. An ideograph counts as its class in the bigrams, then by its own share of
    the class; counts under a single character are those of ideographs."""

    def __init__(self, counts: dict[str, float]):
        self.pair = {p: n for p, n in counts.items() if len(p) == 2}
        self.sign = {p: n for p, n in counts.items() if len(p) == 1}
        self.signs = sum(self.sign.values()) + 0.1 * 20992
        self.first, self.letter = defaultdict(float), defaultdict(float)
        self.after, self.before = defaultdict(set), defaultdict(set)  # letters of the pages beside a letter
        for p, n in self.pair.items():
            self.first[p[0]] += n
            self.letter[p[1]] += n
            if p[1] > "\x7f" and p[1] in _KNOWN:
                self.after[p[0]].add(p[1])
            if p[0] > "\x7f" and p[0] in _KNOWN:
                self.before[p[1]].add(p[0])
        self.total = sum(self.pair.values()) + 1.0
        self.step = _Steps(self)
        self.weighed: dict[tuple[str, str, str, str], tuple[float, list[tuple[str, float]]]] = {}

    def log(self, word: str) -> float:
        w, s, step = folded(word), 0.0, self.step
        for a, b in zip(w, w[1:]):
            s += step[a + b]
        if "一" in w:
            s += sum(math.log((self.sign.get(c, 0.0) + 0.1) / self.signs) for c in ideographs(word))
        return s


    def letters(self, a: str, d: str, b: str, c: str) -> tuple[float, list[tuple[str, float]]]:
        """For the letter ``d`` read from ``c`` between ``a`` and ``b``: what the word's log probability gains if ``c`` may
        stand for other letters, and the shares of the others."""
        key = a, d, b, c
        got = self.weighed.get(key)
        if got is None:
            if len(self.weighed) > REMEMBERED:
                self.weighed.clear()
            here, most = self.step[a + d] + self.step[d + b], []
            for x in self.after.get(a, set()) & self.before.get(b, set()):
                if x != d and x != c:
                    most.append((x, ODD / LETTERS * math.exp(min(self.step[a + x] + self.step[x + b] - here, 200.0))))
            total = 1 - ODD + sum(n for _, n in most)
            got = self.weighed[key] = math.log(total), [(x, n / total) for x, n in most if n > 1e-2 * total]
        return got


def ciphers() -> list[str]:
    """Names of all ciphers, 'read as>written as'."""
    narrow = [f"{r}>{w}" for r in PAGES for w in PAGES if r != w and _LETTER[r] != _LETTER[w] and {r, w} != {"cp1252", "latin-1"}]
    return [f"{r}>{w}" for r in PAGES for w in WIDE] + narrow


def _utf8_pattern(page: str) -> re.Pattern:
    low = {b: re.escape(c) for b, c in _LETTER[page].items()}
    rest = "[" + "".join(low[b] for b in range(0x80, 0xC0)) + "]"
    lead = lambda a, b: "[" + "".join(low[x] for x in range(a, b)) + "]"
    return re.compile(f"{lead(0xC2, 0xE0)}{rest}|{lead(0xE0, 0xF0)}{rest}{{2}}|{lead(0xF0, 0xF5)}{rest}{{3}}")


class Reader:
    """Readings of a word under each cipher."""

    def __init__(self, names: list[str] | None = None, tables: dict[str, dict[str, str]] | None = None):
        self.names = ciphers() if names is None else names
        tables = tables or {}
        self.pages: dict[str, list[str]] = defaultdict(list)  # ciphers by the page they were read as
        self.narrow, self.patterns = {}, {}
        for name in self.names:
            read, written = name.rstrip("*").split(">")
            self.pages[read].append(name)
            if written in PAGES:
                self.narrow[name] = str.maketrans({c: _LETTER[written][b] for c, b in _OF[read].items()} | tables.get(name, {}))
            elif written == "utf-8":
                self.patterns[name] = _utf8_pattern(read)

    def once(self, word: str, name: str) -> str | None:
        """The word under a cipher; None if it can't be read so. For single bytes, all its letters are of the page."""
        if name in self.narrow:
            return word.translate(self.narrow[name])
        read, written = name.split(">")
        page = _OF[read]
        if name in self.patterns:
            return self.patterns[name].sub(lambda m: bytes(page[c] for c in m[0]).decode("utf-8", "replace"), word)
        try:
            return bytes(page[c] if c > "\x7f" else ord(c) for c in word).decode(written)
        except (UnicodeDecodeError, KeyError):
            return None

    def readings(self, word: str, log, depth: int = DEPTH) -> dict[str, str]:
        """Cipher to what it makes of the word, ciphers that change nothing or make no text left out. A cipher of several bytes a
        letter is undone again, ``depth`` times in all, as long as ``log`` finds the result more likely."""
        out, beyond = {}, set(_BEYOND.findall(word))
        for read, names in self.pages.items():
            whole = beyond <= _OF[read].keys()
            for name in names:
                if not whole and name not in self.patterns:
                    continue
                was, now = word, self.once(word, name)
                for _ in range(depth - 1 if name not in self.narrow else 0):
                    again = None if now is None or now == was else self.once(now, name)
                    if again is None or again == now or log(again) <= log(now):
                        break
                    was, now = now, again
                now = was if now is None else now
                if now != word and not _NO_TEXT.search(now) and (name in self.narrow or name in self.patterns or _JAPANESE.search(now)):
                    out[name] = now
        return out


@cache
def _symbols() -> tuple[list[str], np.ndarray]:
    """The bounded alphabet of folded words, and the symbol of each code point up to 0xFFFF."""
    symbols = [chr(i) for i in range(128)] + sorted(c for c in _KNOWN if c > "\x7f") + [chr(o) for o in range(0x3041, 0x3100)] + ["一", "\x80"] + [chr(FIRST_CLASS + i) for i in range(7)]
    code = {c: i for i, c in enumerate(symbols)}
    return symbols, np.fromiter((code[folded(chr(o))[1:2]] for o in range(0x10000)), np.int16, 0x10000)


def _spread(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, each between '^' and '$', where each begins and how many it has."""
    points = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return points, np.cumsum(sizes) - sizes, sizes


def _codes(points: np.ndarray) -> np.ndarray:
    """The symbol of each code point."""
    out = _symbols()[1][np.minimum(points, 0xFFFF)]
    for o in np.unique(points[points > 0xFFFF]):
        out[points == o] = len(_symbols()[0]) - 7 + "LMNPSZC".index(unicodedata.category(chr(o))[0])
    return out


class Matrix:
    """The bigrams as arrays: log probabilities of whole lists of words at once."""

    def __init__(self, lm: Bigrams):
        symbols = _symbols()[0]
        n, code = len(symbols), {c: i for i, c in enumerate(symbols)}
        counts = np.zeros((n, n))
        for p, x in lm.pair.items():
            counts[code[p[0]], code[p[1]]] = x
        share = (counts.sum(0) + 0.01) / lm.total
        self.n = n
        self.step = np.log((counts + 2.0 * share) / (counts.sum(1)[:, None] + 2.0))
        self.step[:, n - 7 :] -= RARE
        # pairs with a letter of the pages after and before, and what all such letters between two symbols weigh together
        letter = np.array([c > "\x7f" and c in _KNOWN for c in symbols])
        odds = np.exp(self.step)
        self.after, self.before = odds * (counts > 0) * letter, odds * (counts > 0) * letter[:, None]
        self.between = self.after @ self.before
        signs = np.full(20992, 0.1)
        for c, x in lm.sign.items():
            signs[ord(c) - 0x4E00] += x
        self.sign = np.log(signs / lm.signs)

    def sums(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        steps = np.append(self.step.ravel()[codes[:-1].astype(np.int32) * self.n + codes[1:]], 0.0)
        steps[starts[1:] - 1] = 0.0
        return np.add.reduceat(steps, starts)

    def log(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        points, starts, _ = _spread([unicodedata.normalize("NFC", w) for w in words])
        out = self.sums(_codes(points), starts)
        ideographs_ = (points >= 0x4E00) & (points <= 0x9FFF)
        if ideographs_.any():
            extra = np.zeros(len(points))
            extra[ideographs_] = self.sign[points[ideographs_] - 0x4E00]
            out += np.add.reduceat(extra, starts)
        return out

    def gain(self, a: np.ndarray, d: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """As ``Bigrams.letters``, without the shares."""
        others = self.between[a, b] - self.after[a, d] * self.before[d, b] - np.where(c == d, 0.0, self.after[a, c] * self.before[c, b])
        return np.log(1 - ODD + ODD / LETTERS * np.maximum(others, 0.0) * np.exp(np.minimum(-self.step[a, d] - self.step[d, b], 200.0)))


@cache
def _bytes_of(page: str) -> np.ndarray:
    """The byte of each code point up to 0xFFFF, -1 for those that the page doesn't have."""
    out = np.full(0x10000, -1, np.int16)
    out[:128] = np.arange(128)
    for c, b in _OF[page].items():
        out[ord(c)] = b
    return out


class Weigher:
    """Readings of whole lists of words under all ciphers of a reader, as arrays."""

    def __init__(self, reader: Reader, lm: Matrix):
        self.reader, self.lm = reader, lm
        fold, bad = _symbols()[1], _symbols()[1][0x80]
        self.narrow = defaultdict(list)  # by page: cipher, symbol of each byte, flags (1: another letter, 2: no text)
        for name, table in reader.narrow.items():
            read = name.rstrip("*").split(">")[0]
            letters = [chr(b) if b < 128 else _LETTER[read][b].translate(table) for b in range(256)]
            codes = np.array([fold[ord(c[:1])] for c in letters], np.int16)
            moved = np.array([b > 127 and c != _LETTER[read][b] for b, c in enumerate(letters)])
            self.narrow[read].append((name, codes, (moved | ((codes == bad) & (np.arange(256) > 127)) * 2).astype(np.uint8)))
        self.wide = defaultdict(list)
        for name in reader.names:
            if name not in reader.narrow:
                self.wide[name.split(">")[0]].append(name)

    def readings(self, words: list[str], letters: bool) -> Iterator[tuple[str, np.ndarray, np.ndarray, list[str] | None]]:
        """Cipher, which words it reads, log probabilities of the readings, and the readings themselves where a cipher
        has several bytes a letter. With ``letters`` a reading by single bytes gains by another letter (``_weighed``)."""
        points, starts, sizes = _spread(words)
        low, codes = np.minimum(points, 0xFFFF), _codes(points) if letters else None
        for read in self.reader.pages:
            data = _bytes_of(read)[low]
            whole = np.minimum.reduceat(data, starts) >= 0
            rows = np.flatnonzero(whole)
            if len(rows) and self.narrow[read]:
                inside = np.repeat(whole, sizes)
                b, n = data[inside].astype(np.uint8), sizes[rows]
                at = np.cumsum(n) - n
                if letters:
                    beyond = np.flatnonzero(b > 127)
                    c = codes[inside][beyond]
                    first = np.searchsorted(beyond, at)
                for name, table, flags in self.narrow[read]:
                    ok = np.bitwise_or.reduceat(flags[b], at) == 1
                    if not ok.any():
                        continue
                    code = table[b]
                    score = self.lm.sums(code, at)
                    if letters:
                        g = self.lm.gain(code[beyond - 1], code[beyond], code[beyond + 1], c)
                        score = score + np.maximum(np.maximum.reduceat(g, first), 0.0)
                    yield name, rows[ok], score[ok], None
            for name in self.wide[read]:
                if name in self.reader.patterns:  # a lead byte and one that continues it
                    met = np.zeros(len(points), bool)
                    met[:-1] = (data[:-1] >= 0xC2) & (data[:-1] < 0xF5) & (data[1:] >= 0x80) & (data[1:] < 0xC0)
                    some = np.flatnonzero(np.logical_or.reduceat(met, starts))
                    got = [(i, words[i], self.reader.once(words[i], name)) for i in some.tolist()]
                else:
                    ends = np.cumsum(sizes[rows])
                    got = self._decoded(data[np.repeat(whole, sizes)].astype(np.uint8).tobytes(), name.split(">")[1], rows, ends, words)
                yield from self._wide(name, got)

    def _decoded(self, data: bytes, written: str, rows: np.ndarray, ends: np.ndarray, words: list[str]) -> list[tuple[int, str, str]]:
        """What the bytes of words mean in a Japanese encoding, of those that are text in it."""
        got, at = [], 0
        for i, end in zip(rows.tolist(), ends.tolist()):
            try:
                text = data[at + 1 : end - 1].decode(written)
                if _JAPANESE.search(text):
                    got.append((i, words[i], text))
            except UnicodeDecodeError:
                pass
            at = end
        return got

    def _wide(self, name: str, got: list[tuple[int, str, str]]) -> Iterator[tuple[str, np.ndarray, np.ndarray, list[str]]]:
        """A cipher of several bytes a letter, undone again as long as the result is more likely (what was Japanese isn't of
        any page, so only UTF-8 comes again)."""
        once, again_ = self.reader.once, name in self.reader.patterns
        got = [x for x in got if x[2] != x[1]]
        texts, open_ = [t for *_, t in got], list(range(len(got))) if again_ else []
        scores = self.lm.log(texts)
        for _ in range(DEPTH - 1):
            again = [(k, t) for k in open_ if (t := once(texts[k], name)) is not None and t != texts[k]]
            better = self.lm.log([t for _, t in again])
            open_ = []
            for (k, t), x in zip(again, better):
                if x > scores[k]:
                    texts[k], scores[k] = t, x
                    open_.append(k)
        kept = [k for k, t in enumerate(texts) if t != got[k][1] and not _NO_TEXT.search(t)]
        if kept:
            yield name, np.array([got[k][0] for k in kept]), scores[kept], [texts[k] for k in kept]


def _bigram_counts(words: list[str], n: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Bigrams of folded words and how often they occur; single characters are ideographs."""
    if not words:
        return [], np.zeros(0)
    symbols = _symbols()[0]
    points, starts, sizes = _spread([unicodedata.normalize("NFC", w) for w in words])
    codes, weight = _codes(points).astype(np.int64), np.repeat(n, sizes)
    pairs = codes[:-1] * len(symbols) + codes[1:]
    inside = np.ones(len(pairs), bool)
    inside[starts[1:] - 1] = False
    keys, back = np.unique(pairs[inside], return_inverse=True)
    sums = np.bincount(back, weights=weight[:-1][inside])
    signs, back = np.unique(points[(points >= 0x4E00) & (points <= 0x9FFF)], return_inverse=True)
    more = np.bincount(back, weights=weight[(points >= 0x4E00) & (points <= 0x9FFF)], minlength=len(signs))
    return [symbols[k // len(symbols)] + symbols[k % len(symbols)] for k in keys.tolist()] + [chr(o) for o in signs], np.r_[sums, more]


def _suspects(text: bytes) -> list[str]:
    """The words of a text in UTF-8 that are weighed, as often as they stand there."""
    return [w for x in text.split() if not x.isascii() and _SUSPECT.search(w := x.decode())]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suspect words by source group; of all others only their bigrams, under the group -1."""
    for batch in batches:
        plain: Counter = Counter()
        counts: dict[int, Counter] = defaultdict(Counter)
        for group, text in zip(batch.column("grp").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            plain.update(text.split())
            if not text.isascii():
                counts[group].update(_suspects(text))
        others = {w: n for x, n in plain.items() if not _SUSPECT.search(w := x.decode())}
        keys, sums = _bigram_counts(list(others), np.fromiter(others.values(), float, len(others)))
        rows = [(-1, k, int(x)) for k, x in zip(keys, sums)] + [(g, w, n) for g, c in counts.items() for w, n in c.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.int64()))], names=["grp", "word", "n"])


def _add_bigrams(counts: dict, word: str, n: float) -> None:
    w = folded(word)
    for a, b in zip(w, w[1:]):
        counts[a + b] += n
    for c in ideographs(word) if "一" in w else ():
        counts[c] += n


def _bigrams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sums = _bigram_counts(batch.column("word").to_pylist(), batch.column("n").to_numpy().astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sums)], names=["k", "x"])


def _weighed(word: str, text: str, lm: Bigrams) -> tuple[float, list[tuple[str, str, list[tuple[str, float]], bool]]]:
    """What a reading by single bytes gains by another letter behind one of its bytes; byte, letter, the others' shares,
    and whether it follows a small letter. Only the best byte counts: with all of them free, clean words would do as well."""
    w, gain, out = folded(text), 0.0, []
    if len(text) != len(word) or len(w) != len(text) + 2:
        return gain, out
    for i, c in enumerate(word):
        if c > "\x7f":
            g, others = lm.letters(w[i], w[i + 1], w[i + 2], c.lower())
            gain = max(gain, g)
            out.append((c, w[i + 1], others, i > 0 and text[i - 1].islower()))
    return gain, out


def _likeliest(text: str, letters: list[tuple[str, str, list[tuple[str, float]], bool]], word: str) -> str:
    """The text with those letters replaced that are more likely others."""
    if not any(others for _, _, others, _ in letters):
        return text
    out, at = list(text), iter(letters)
    for i, c in enumerate(word):
        if c > "\x7f":
            out[i] = next((x for x, share in next(at)[2] if share > 0.5), out[i])
    return "".join(out)


def _expected(words: list[str], groups: np.ndarray, n: np.ndarray, lm: Bigrams, matrix: Matrix, reader: Reader, own: dict[int, Reader], weights: dict[tuple[int, str], float], out: dict[tuple[str, str], float]) -> None:
    """Adds to ``out`` what is expected of some words: see ``_expect``."""
    names = [*reader.names, *sorted({name for r in own.values() for name in r.names})]
    column = {name: i + 1 for i, name in enumerate(names)}
    there, at = np.unique(groups, return_inverse=True)
    weigh = np.log([[weights.get((g, c), PRIOR) for c in names] for g in there.tolist()])
    score = np.full((len(words), len(names) + 1), -np.inf)
    score[:, 0] = matrix.log(words)
    texts: dict[tuple[int, int], str] = {}
    readers = [(reader, np.arange(len(words)))] + [(own[g], np.flatnonzero(groups == g)) for g in there.tolist() if g in own]
    for r, some in readers:
        mine = words if len(some) == len(words) else [words[i] for i in some]
        for name, rows, s, read in Weigher(r, matrix).readings(mine, True):
            k, rows_ = column[name], some[rows]
            if name.endswith("*"):  # where both read the same, the words are those of the source's own
                base = r.narrow[name], reader.narrow.get(name.rstrip("*"), {})
                same = [i for i in rows_.tolist() if words[i].translate(base[0]) == words[i].translate(base[1])]
                score[same, column.get(name.rstrip("*"), k)] = -np.inf
            score[rows_, k] = s + weigh[at[rows_], k - 1]
            if read is not None:
                texts.update(((i, k), t) for i, t in zip(rows_.tolist(), read))
    p = np.exp(score - score.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    for g, x in zip(there.tolist(), np.bincount(at, weights=n)):
        out["words", str(g)] += x
    for k, x in zip(*_bigram_counts(words, p[:, 0] * n)):
        out["bigram", k] += x
    for k in np.flatnonzero((p[:, 1:] > 1e-6).any(0)).tolist():
        for g, x in zip(there.tolist(), np.bincount(at, weights=p[:, k + 1] * n, minlength=len(there))):
            if x > 0:
                out["cipher", f"{g}|{names[k]}"] += x
    for i, k in zip(*(x.tolist() for x in np.nonzero(p[:, 1:] > SEEN))):
        word, name, group, x = words[i], names[k], int(groups[i]), float(p[i, k + 1])
        text, letters = texts.get((i, k + 1)), []
        if text is None:
            text = (own[group] if name.endswith("*") else reader).once(word, name)
            letters = _weighed(word, text, lm)[1]
        read: dict[str, float] = defaultdict(float)
        _add_bigrams(read, _likeliest(text, letters, word), x * float(n[i]))
        for key, y in read.items():
            out["bigram", key] += y
        for c, d, others, inside in letters if x > SURE else ():
            out["letter", f"{group}|{name}|{c}{d}"] += x * (1 - sum(share for _, share in others))
            for y, share in others:
                out["letter", f"{group}|{name}|{c}{y}"] += x * share
            if inside:
                out["inside", f"{group}|{name}|{c}"] += x


def _expect(shared):
    """E-step over words: expected counts of ciphers by source group, of bigrams as read, of letters by byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, weights, tables = shared.value
        lm, reader = Bigrams(counts), Reader()
        matrix = Matrix(lm)
        own = {group: Reader(list(t), t) for group, t in tables.items()}
        out: dict[tuple[str, str], float] = defaultdict(float)
        for batch in batches:
            for k in range(0, len(batch), CHUNK):
                part = batch.slice(k, CHUNK)
                _expected(part.column("word").to_pylist(), part.column("grp").to_numpy(), part.column("n").to_numpy().astype(float), lm, matrix, reader, own, weights, out)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([v for _, v in out], pa.string()), pa.array(list(out.values()), pa.float64())], names=["kind", "k", "x"])

    return run


def _own_tables(letters: dict[tuple[int, str], dict[str, Counter]], inside: dict[tuple[int, str], Counter], tables: dict[int, dict[str, dict[str, str]]]) -> dict[int, dict[str, dict[str, str]]]:
    """M-step of the letters: by source group, its own ciphers with the letters in which they differ from the pages.

    ``letters`` has the expected counts by group and cipher, byte and letter. A group believes in the letters of the whole
    corpus, and the corpus in the tables of the last round. The bigrams know no case: a byte that mostly follows small
    letters (``inside``) is a small letter, one that hardly does so is the capital of a letter that has a byte already.
    """
    everywhere: dict[tuple[str, str], Counter] = defaultdict(Counter)
    for (_, name), by in letters.items():
        for c, n in by.items():
            everywhere[name, c].update(n)
    out: dict[int, dict[str, dict[str, str]]] = {g: {name: dict(t) for name, t in own.items()} for g, own in tables.items()}
    for (group, name), by in sorted(letters.items()):
        last = tables.get(group, {}).get(name, {})
        start = Reader([name], {name: last}).narrow[name]
        letter = {c: chr(x) if isinstance(x := start.get(ord(c), c), int) else x for c in by}
        own, changed = {c: folded(d)[1:-1] for c, d in letter.items()}, {}
        for c, n in by.items():
            of_all = everywhere[name, c]
            backed = LETTER_BACKED / (sum(of_all.values()) + LETTER_BACKED)
            likely = lambda d: n[d] + backed * (of_all[d] + LETTER_BACKED * (d == own[c]))  # noqa: B023, E731
            best, *rest = sorted(sorted({*n, own[c]}), key=likely, reverse=True)
            if rest and likely(best) < CLEAR * likely(rest[0]):
                best = own[c]
            often = inside[group, name][c] / max(sum(n.values()), 1e-9)
            if best != own[c]:
                changed[c] = best if often > 0.05 else best.upper()
            elif letter[c].isupper() and often > 0.5 and sum(n.values()) > LETTER_BACKED:
                changed[c] = best
        taken = {folded(d)[1:-1] for c, d in letter.items() if c not in changed and by[c][own[c]] > 1}
        changed = {c: d if d.lower() in taken and len(d) == 1 else d.lower() for c, d in changed.items()}
        kept = sum(n[own[c]] for c, n in by.items() if changed.get(c, own[c]).lower() == own[c])
        moved = sum(sum(by[c].values()) for c, d in changed.items() if d.lower() != own[c])
        if changed and kept > PAGES_KEPT * moved:
            mine = name if name.endswith("*") else f"{name}*"
            if mine == name or mine not in tables.get(group, {}):  # what was added is changed by its own counts only
                out.setdefault(group, {})[mine] = last | changed
    return out


class Model:
    """What was learned: bigrams, weights of ciphers by source group, and each group's own ciphers with their letters."""

    def __init__(self, bigrams: dict[str, float], weights: dict[tuple[int, str], float], tables: dict[int, dict[str, dict[str, str]]]):
        self.bigrams, self.weights, self.tables = bigrams, weights, tables


def _prepared(df: DataFrame, id_col: str, text_col: str, source_col: str | None) -> DataFrame:
    source = F.coalesce(normal_source(F.col(source_col)), F.lit("")) if source_col else F.lit("")
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(source), F.lit(GROUPS)).cast("int").alias("grp")).where(F.col("text").isNotNull())


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source") -> Model:
    """Fit the ciphers on the words of all texts. What comes to the driver is bounded by the alphabet squared and by
    the number of source groups times ciphers and their bytes, not by the corpus."""
    spark = df.sparkSession
    counts = _prepared(df, id_col, text_col, source_col).mapInArrow(_word_counts, "grp int, word string, n long")
    words = materialise(counts.groupBy("grp", "word").agg(F.sum("n").alias("n")), "words")
    plain = words.where("grp < 0").select(F.col("word").alias("k"), F.col("n").cast("double").alias("x")).collect()
    suspects = words.where("grp >= 0")
    # a word takes far more time than bytes, so tasks are cut by words
    suspects = suspects.repartition(max(spark.sparkContext.defaultParallelism, suspects.count() // WORDS_PER_TASK))
    first = suspects.mapInArrow(_bigrams_of, "k string, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
    base = {r.k: r.x for r in plain}
    bigrams = defaultdict(float, base)
    for r in first:
        bigrams[r.k] += r.x
    weights: dict[tuple[int, str], float] = {}
    tables: dict[int, dict[str, dict[str, str]]] = {}
    for round_ in range(ROUNDS + MORE_ROUNDS):
        shared = spark.sparkContext.broadcast((dict(bigrams), weights, tables))
        got = suspects.mapInArrow(_expect(shared), "kind string, k string, x double").groupBy("kind", "k").agg(F.sum("x").alias("x")).collect()
        bigrams, totals = defaultdict(float, base), {}
        letters: dict[tuple[int, str], dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        inside: dict[tuple[int, str], Counter] = defaultdict(Counter)
        seen: dict[tuple[int, str], float] = {}
        everywhere: dict[str, float] = defaultdict(float)
        for r in got:
            if r.kind == "words":
                totals[int(r.k)] = r.x
            elif r.kind == "bigram":
                bigrams[r.k] += r.x
            elif r.kind == "cipher":
                group, name = r.k.split("|", 1)
                seen[int(group), name] = r.x
                everywhere[name] += r.x
            elif r.kind == "inside":
                group, name, c = r.k.split("|", 2)
                inside[int(group), name][c] = r.x
            else:
                group, name, pair = r.k.split("|", 2)
                letters[int(group), name][pair[0]][pair[1]] += r.x
        all_words = sum(totals.values()) + 1
        weights = {(g, c): max((seen.get((g, c), 0.0) + BACKED * everywhere[c] / all_words) / (totals[g] + BACKED), 1e-12) for g in totals for c in everywhere if not c.endswith("*") or c in tables.get(g, {})}
        before, tables = tables, _own_tables(letters, inside, tables)
        for g, own in tables.items():  # a cipher just added begins with the weight of that it comes from
            weights |= {(g, c): weights.get((g, c), weights.get((g, c.rstrip("*")), PRIOR)) for c in own}
        if round_ + 1 >= ROUNDS and tables == before:
            break
    return Model(dict(bigrams), weights, tables)


class Judge:
    """Finds the cipher of a text and undoes it."""

    def __init__(self, model: Model):
        self.m = model
        self.lm = Bigrams(model.bigrams)
        active = {c for _, c in model.weights}
        self.reader = Reader([c for c in ciphers() if c in active])
        self.own = {group: Reader(list(t), t) for group, t in model.tables.items()}
        self.known: dict[tuple[int, str, int], list[tuple[str, str, float]]] = {}
        self.near: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]] = {}
        self.number: dict[str, int] = {}
        self.matrix: Matrix | None = None
        self.weighers: dict[int, list[Weigher]] = {}

    def gains(self, word: str, group: int, depth: int = DEPTH) -> list[tuple[str, str, float]]:
        """Ciphers, what they make of the word, and by how much that is more likely; with the group's own ciphers."""
        return self._gains(word, -1, self.reader, depth) + (self._gains(word, group, self.own[group], depth) if group in self.own else [])

    def _gains(self, word: str, group: int, reader: Reader, depth: int) -> list[tuple[str, str, float]]:
        got = self.known.get((group, word, depth))
        if got is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            readings = reader.readings(word, self.lm.log, depth)
            score = {text: self.lm.log(text) for text in {word, *readings.values()}}
            got = self.known[group, word, depth] = [(n, t, score[t] - score[word]) for n, t in readings.items()]
        return got

    def odds(self, suspects: list[str], group: int) -> dict[str, float]:
        """Log odds of each cipher that reads one of the words, at the likeliest share of garbled words, without its prior."""
        by: dict[str, list[float]] = defaultdict(list)
        for w in suspects:
            for name, _, gain in self.gains(w, group):
                by[name].append(gain)
        return {
            name: max((len(suspects) - len(gains)) * math.log1p(-share) + sum(math.log1p(share * math.expm1(min(g, 50.0))) for g in gains) for share in PARTS)
            for name, gains in by.items()
        }

    def prior(self, name: str, group: int) -> float:
        return math.log(max(self.m.weights.get((group, name), 0.0), PRIOR))

    def weigh(self, texts: Iterable[tuple[int, list[str]]]) -> Iterator[tuple[str | None, float]]:
        """The likeliest cipher of each text (source group and suspect words) and its log odds, prior included.

        The different words of some texts are weighed at once and their gains remembered.
        """
        held: list[tuple[int, list[str]]] = []
        size = 0
        for text in texts:
            held.append(text)
            size += len(text[1])
            if size > 10 * CHUNK:
                yield from self._weigh(held)
                held, size = [], 0
        yield from self._weigh(held)

    def _gains_of(self, words: list[str], readers: list[Weigher], group: int) -> None:
        """Remember of each word the ciphers (by number) that read it, and their gains."""
        for k in range(0, len(words), CHUNK):
            part = words[k : k + CHUNK]
            base, rows, ciphers_, gains = self.matrix.log(part), [], [], []
            for weigher in readers:
                for name, some, score, _ in weigher.readings(part, False):
                    gain = score - base[some]
                    near = gain > HOPELESS
                    rows.append(some[near]), gains.append(gain[near])
                    ciphers_.append(np.full(near.sum(), self.number.setdefault(name, len(self.number))))
            rows_, c, g = (np.concatenate(x) if x else np.zeros(0, int) for x in (rows, ciphers_, gains))
            order = np.argsort(rows_, kind="stable")
            ends = np.cumsum(np.bincount(rows_, minlength=len(part)))
            for w, c_, g_ in zip(part, np.split(c[order], ends[:-1]), np.split(g[order], ends[:-1])):
                self.near[group, w] = c_, g_

    def _weigh(self, texts: list[tuple[int, list[str]]]) -> Iterator[tuple[str | None, float]]:
        if len(self.near) > REMEMBERED:
            self.near.clear()
        if not self.weighers:
            self.matrix = Matrix(self.lm)
            self.weighers[-1] = [Weigher(self.reader, self.matrix)]
            self.weighers |= {g: [*self.weighers[-1], Weigher(r, self.matrix)] for g, r in self.own.items()}
        lists = []
        for group in {g if g in self.own else -1 for g, _ in texts}:
            new = {w for g, words in texts if (g if g in self.own else -1) == group for w in words if (group, w) not in self.near}
            if new:
                self._gains_of(sorted(new), self.weighers[group], group)
        for k, (g, words) in enumerate(texts):
            group = g if g in self.own else -1
            lists += [(k, *self.near[group, w]) for w in words if len(self.near[group, w][0])]
        if not lists:
            yield from ((None, -math.inf) for _ in texts)
            return
        n = [len(c) for _, c, _ in lists]
        key = np.repeat([k for k, *_ in lists], n) * len(self.number) + np.concatenate([c for _, c, _ in lists])
        gain = np.minimum(np.concatenate([g for *_, g in lists]), 50.0)
        keys, back = np.unique(key, return_inverse=True)
        doc, cipher = keys // len(self.number), keys % len(self.number)
        sizes = np.array([len(words) for _, words in texts], float)[doc]
        odds = np.max([sizes * math.log1p(-share) + np.bincount(back, weights=np.log1p(share * np.expm1(gain)) - math.log1p(-share)) for share in PARTS], 0)
        names = list(self.number)
        odds = odds + [self.prior(names[c], texts[k][0]) for k, c in zip(doc.tolist(), cipher.tolist())]
        best: dict[int, tuple[float, str]] = {}
        for k, c, x in zip(doc.tolist(), cipher.tolist(), odds.tolist()):
            if k not in best or x > best[k][0]:
                best[k] = x, names[c]
        for k in range(len(texts)):
            yield (best[k][1], best[k][0]) if k in best else (None, -math.inf)

    def judge(self, text: str, group: int) -> tuple[str | None, float, str]:
        """The ciphers or None, the log odds of the likeliest in the whole text, and the text restored."""
        ((name, odds),) = self.weigh([(group, _suspects(text.encode()))])
        if name is None or odds < ENOUGH:
            return None, odds, text
        names, restored = self.restoration(text, group, name)
        return names, odds, restored

    def restoration(self, text: str, group: int, of_text: str) -> tuple[str, str]:
        """The ciphers undone in the paragraphs of a text, and the text restored."""
        used: dict[str, None] = {}
        restored = "\n".join(self.restored(part, group, of_text, used) for part in text.split("\n"))
        return ", ".join(used) or of_text, restored

    def undone(self, word: str, text: str, name: str, group: int) -> str:
        """``text``, the word under the cipher, repeated if need be; or undone only once if another cipher then does better."""
        once = next((t for n, t, _ in self.gains(word, group, 1) if n == name), text)
        if once != text and any(n != name and self.lm.log(t) + self.prior(n, group) > self.lm.log(text) for n, t, _ in self.gains(once, group)):
            return once
        return text

    def restored(self, part: str, group: int, of_text: str, used: dict[str, None]) -> str:
        """A paragraph under the cipher of its text or a likelier one, then under any that makes the result likelier still."""
        here = {of_text}  # as likely as not to be met, and to be met again
        for k in range(DEPTH):
            suspects = [w for w in _SPACES.split(part) if _SUSPECT.search(w)]
            odds = {name: s + (math.log(0.5) if name in here else self.prior(name, group)) for name, s in self.odds(suspects, group).items()}
            name = max(odds, key=odds.get, default=None)
            if name is None or (odds[name] <= 0 and k > 0):
                break
            if odds[name] <= 0:
                name = of_text
            fix = {w: self.undone(w, t, name, group) for w in set(suspects) for n, t, gain in self.gains(w, group) if n == name and gain > 0}
            if not fix:
                break
            here.add(name)
            used[name] = None
            part = re.sub(r"[^ \t\r\n\f\v]+", lambda m: fix.get(m[0], m[0]), part)  # noqa: B023
        return part


def garbled(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", *, model: Model | None = None, restore: bool = True) -> DataFrame:
    """Affected rows only: ``(id, cipher, score, restored)``.

    ``cipher`` names the encodings as 'read as>written as', with ``*`` if the source's own letters differ from them, and with
    commas between if paragraphs or rounds differ in it, in the order in which they are undone; it is 'lost' for a text with
    replacement characters (U+FFFD) and no other cipher, whose bytes can't be had back, and ``restored`` is null then. Words
    that read better under the cipher of their paragraph are replaced in ``restored``, all else stays as it is. Without
    ``restore`` the same rows come with the likeliest cipher of the whole text and a null in ``restored``.

    Null and empty texts are not affected; repeated rows stay; other columns are ignored. Without ``model`` it is
    learned from the same rows first.
    """
    model = learn(df, id_col, text_col, source_col) if model is None else model
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType
    out = T.StructType([T.StructField("id", kind), T.StructField("cipher", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("restored", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = Judge(shared.value)
        for batch in batches:
            rows, names, scores, texts = [], [], [], []
            data, groups = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("grp").to_pylist()
            beyond = [i for i, text in enumerate(data) if not text.isascii()]
            for i, (name, score) in zip(beyond, j.weigh((groups[i], _suspects(data[i])) for i in beyond)):
                restored = None
                if score < ENOUGH:
                    name, score = ("lost" if b"\xef\xbf\xbd" in data[i] else None), score
                elif restore:
                    name, restored = j.restoration(data[i].decode(), groups[i], name)
                if name is not None:
                    rows.append(i), names.append(name), scores.append(score), texts.append(restored)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(texts, pa.string())], names=["id", "cipher", "score", "restored"])

    return _prepared(df, id_col, text_col, source_col).mapInArrow(run, out)
