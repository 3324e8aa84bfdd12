"""Finding and restoring text that was decoded with a wrong character encoding.

Method: a text is cut into passages; for a passage every chain of
(wrong decoding, right decoding) steps that could have produced it is undone,
and each candidate is compressed with one zstandard dictionary per language.
The chain of minimum description length wins - the candidate's compressed size, an
escape for every unknown pair of characters, and the chain's own cost - and otherwise the passage stays as it is.  Sizes
gained are summed over a document's passages per chain, so one short garbled
word needs support and a whole garbled report has it.

Nothing is known of any language beforehand: dictionaries, pairs of adjacent
characters and letters all come from the labelled documents, every one of them.  A passage
whose adjacent characters are all known pairs has nothing to gain and is not
compressed at all, and a candidate counts only if it has fewer unknown pairs than
the passage and brings in no letter that the documents' languages don't write
(``Restorer(prune=False)`` compresses every candidate).

A passage is restored wholly or not at all: where a chain wins but leaves
letters behind that can't be right, the passage is reported and stays as it is.
A passage that holds U+FFFD was decoded wrongly for certain, but what stood there
is lost; it is reported too.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.session import materialize

GROUP_DOCS = 2_000  #: documents of a language that one task trains a dictionary on
GROUP_DICTS = 64  #: dictionaries that one task makes one of
DICT_BYTES = 32_768  #: size of a dictionary
STEP_COST = 1.0  #: bytes a step of a chain costs: the index of one of about 250 steps
SWITCH_COST = 3.0  #: bytes it costs to name another chain for one passage: its place and the chain
PAIR_COST = 2.0  #: bytes an adjacent pair costs that no two clean labelled documents hold, as an escape symbol would
RARE = 0.03  #: a labelled document with a non-ASCII letter found in fewer of its language's documents isn't trained on
LARGE = 150  #: different letters of one script in a language's documents from which its rare letters are no hint
MAIN = 0.2  #: share of a language's documents that hold letters of a script it is written in
LEAST_GAIN = 0.5  #: bytes a document must gain by a chain beyond its cost

# Signs that texts of any language may hold.
SIGNS = "’‘“”„«»–—…€£§°·²³½¼¾×±•®™©¡¿ªº№ 。，、；：（）！？《》“”％"

# Encodings by the way they are undone.
SINGLE = ["cp1252", "latin_1", "iso8859_15", "cp1250", "iso8859_2", "cp1254", "cp1257", "cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic", "mac_roman", "mac_latin2", "cp437", "cp850", "cp852", "cp1253", "iso8859_7", "cp1256"]
PAIRED = ["gbk", "big5", "cp932", "euc_jp", "cp949"]
ASCII_SECOND = ["big5", "cp932"]
READ_PAIRED = ["latin_1", "cp1252", "cp1250", "cp1251", "koi8_r", "mac_roman", "cp437", "cp866"]


@lru_cache(maxsize=100_000)
def script(c: str) -> str:
    """The script of a letter by its name, such as LATIN or CJK; empty for what is no letter."""
    return unicodedata.name(c, "").partition(" ")[0] if c.isalpha() else ""


class Alphabet:
    """The characters that texts of the documents' languages may hold.

    ``holds``: signs, letters of clean labelled texts, and all letters of scripts
    other than Latin that a language is written in.  ``may``: also any Latin
    letter of a single-byte encoding.
    """

    def __init__(self, letters: str, scripts: list[str]):
        self.known = frozenset(letters + SIGNS)
        self.scripts = frozenset(scripts)
        self.holds = lru_cache(maxsize=100_000)(self._holds)
        self.may = lru_cache(maxsize=100_000)(lambda c: self._holds(c) or script(c) == "LATIN" and any(c in _bytes_of(e) for e in SINGLE))

    def _holds(self, c: str) -> bool:
        return c.isascii() or c in self.known or script(c) in self.scripts


@lru_cache(maxsize=None)
def _bytes_of(enc: str) -> dict[str, int]:
    """Non-ASCII character -> byte; bytes that the encoding leaves open stand for their C1 control, as decoders do."""
    out = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(enc)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


def _class(chars: list[str]) -> str:
    return "[" + "".join(re.escape(c) for c in chars) + "]"


@lru_cache(maxsize=None)
def _utf8_pattern(enc: str) -> re.Pattern | None:
    """Matches characters whose bytes in ``enc`` form a UTF-8 sequence."""
    m = _bytes_of(enc)
    of = lambda lo, hi: _class([c for c, b in m.items() if lo <= b <= hi])
    try:
        tail = of(0x80, 0xBF)
        return re.compile(f"{of(0xC2, 0xDF)}{tail}|{of(0xE0, 0xEF)}{tail}{{2}}|{of(0xF0, 0xF4)}{tail}{{3}}")
    except re.error:
        return None


@lru_cache(maxsize=200_000)
def _utf8_char(enc: str, seq: str) -> str | None:
    m = _bytes_of(enc)
    try:
        return bytes(m[c] for c in seq).decode("utf-8")
    except UnicodeDecodeError:
        return None


_RUN = re.compile(r"[^\x00-\x7f]+")


def undo_utf8(text: str, enc: str) -> str:
    """UTF-8 that was read as ``enc``, sequence by sequence; what forms no sequence stays."""
    if enc in PAIRED:

        def run(m: re.Match) -> str:
            try:
                return m[0].encode(enc).decode("utf-8")
            except UnicodeError:
                return m[0]

        return _RUN.sub(run, text)
    p = _utf8_pattern(enc)
    return p.sub(lambda m: _utf8_char(enc, m[0]) or m[0], text) if p else text


@lru_cache(maxsize=None)
def _high_run(enc: str, least: int) -> re.Pattern:
    return re.compile(_class(list(_bytes_of(enc))) + f"{{{least},}}")


def undo_paired(text: str, wrong: str, right: str, usual: Callable[[str], bool] | None = None) -> str:
    """A two-byte encoding that was read as the single-byte ``wrong``, in runs of at least four characters.

    With ``usual`` also in runs of two and three, if that makes usual characters:
    a clean pair of signs may look like one character.
    """
    m = _bytes_of(wrong)

    def run(x: re.Match) -> str:
        try:
            t = bytes(m[c] for c in x[0]).decode(right)
        except UnicodeError:
            return x[0]
        return t if len(x[0]) > 3 or all(map(usual, t)) else x[0]

    return _high_run(wrong, 2 if usual else 4).sub(run, text)


def undo_whole(text: str, wrong: str, right: str) -> str:
    """As ``undo_paired`` for encodings whose second byte may be an ASCII one: the text as a whole, or not at all."""
    m = _bytes_of(wrong)
    try:
        return bytes(m[c] if c > "\x7f" else ord(c) for c in text).decode(right)
    except (KeyError, UnicodeError):
        return text


def _paired_for(high: list[str]) -> list[str]:
    """The two-byte encodings as which UTF-8 may have been read: its first byte, C2 or above, begins a character beyond U+3000 in all of them."""
    return PAIRED if high and high[-1] >= "\u3000" else []


class Chains:
    """The ways in which a text may have been decoded wrongly, given the characters that texts hold."""

    def __init__(self, alphabet: Alphabet):
        """Pairs of single-byte encodings, their translation tables, and per character a bit mask of the pairs that make it one that texts hold."""
        self.pairs, self.tables, self.mask = [], [], {}
        self.usual = lambda c: c.isascii() or c in alphabet.known
        seen = set()
        for wrong in SINGLE:
            for right in SINGLE:
                if wrong == right:
                    continue
                table = {}
                for c, b in _bytes_of(wrong).items():
                    try:
                        table[ord(c)] = bytes([b]).decode(right)
                    except UnicodeDecodeError:
                        pass
                good = {c: x for c, x in table.items() if alphabet.holds(x) and not (x != chr(c) and x == " ")}
                sign = tuple(sorted(good.items()))
                if sign in seen or all(chr(c) == x for c, x in good.items()):
                    continue
                seen.add(sign)
                bit = 1 << len(self.pairs)
                self.pairs.append((wrong, right))
                self.tables.append(good)
                for c in good:
                    self.mask[chr(c)] = self.mask.get(chr(c), 0) | bit

    @staticmethod
    def _utf8(text: str, high: list[str]) -> dict[str, str]:
        """UTF-8 undone by encoding; of encodings that give the same text the first.  Only where a sequence can be: a first byte's character and a further one's."""
        out: dict[str, str] = {}
        tried = set()
        for enc in SINGLE:
            m = _bytes_of(enc)
            seen = tuple(m.get(c, 0) for c in high)
            if seen in tried or not any(0xC2 <= b <= 0xF4 for b in seen) or not any(0x80 <= b <= 0xBF for b in seen):
                continue
            tried.add(seen)
            t = undo_utf8(text, enc)
            if t != text and t not in out.values():
                out[enc] = t
        for enc in _paired_for(high):
            t = undo_utf8(text, enc)
            if t != text and t not in out.values():
                out[enc] = t
        return out

    def undone(self, text: str) -> Iterator[tuple[tuple[str, ...], str]]:
        """(chain, text) for every chain that changes ``text``; for single-byte steps only those that make characters that texts hold.

        A chain of a two-byte encoding comes in several ways where they differ.
        """
        runs = _RUN.findall(text)
        high = sorted(set("".join(runs)))
        first = self._utf8(text, high)
        for enc, t in first.items():
            yield (f"{enc}>utf_8",), t
        for enc, t in first.items():
            rest = sorted(set("".join(_RUN.findall(t))))
            once: dict[tuple, str] = {}
            for again in [*SINGLE, *_paired_for(rest)]:
                m = _bytes_of(again) if again in SINGLE else {}
                seen = tuple(m.get(c, 0) for c in rest) if m else (again,)
                if m and not (any(0xC2 <= b <= 0xF4 for b in seen) and any(0x80 <= b <= 0xBF for b in seen)):
                    continue
                if seen not in once:
                    once[seen] = undo_utf8(t, again)
                if once[seen] != t:
                    yield (f"{enc}>utf_8", f"{again}>utf_8"), once[seen]
        long = any(len(r) > 1 for r in runs)
        made: dict[tuple, list[str]] = {}
        for wrong in READ_PAIRED:
            m = _bytes_of(wrong)
            seen = tuple(m.get(c) for c in high)  # what the passage's characters are in this encoding: equal ones give equal texts
            if not any(seen):
                continue
            for right in PAIRED:
                if (seen, right) not in made:
                    ways = [undo_paired(text, wrong, right, self.usual), undo_paired(text, wrong, right)] if long else []
                    if right in ASCII_SECOND:
                        ways.append(undo_whole(text, wrong, right))
                    made[seen, right] = [t for t in dict.fromkeys(ways) if t != text]
                for t in made[seen, right]:
                    yield (f"{wrong}>{right}",), t
        bits = -1
        for c in high:
            bits &= self.mask.get(c, 0)
            if not bits:
                break
        n = 0
        while bits > 0:
            if bits & 1:
                t = text.translate(self.tables[n])
                if t != text:
                    yield (f"{self.pairs[n][0]}>{self.pairs[n][1]}",), t
            bits >>= 1
            n += 1


_CUT = re.compile(r"(?<=[.!?])(?=\s)|(?<=[。！？])|(?<=\n)")


def passages(text: str) -> list[str]:
    """Sentences and lines; joined they are the text."""
    return [p for p in _CUT.split(text) if p]


_ASCII = [chr(i) for i in range(128)]


def pairs_of(text: str) -> set[tuple[str, str]]:
    """The adjacent characters of a text, with a blank around it."""
    return set(zip(f" {text}", f"{text} "))


class Restorer:
    """Undoes wrong decodings with what ``learn`` gives: dictionaries (language -> bytes), known pairs, letters, and scripts."""

    def __init__(self, dictionaries: dict[str, bytes], known: list[str], letters: str, scripts: list[str], prune: bool = True):
        self.squeeze = []
        for _, d in sorted(dictionaries.items()):
            z = zstandard.ZstdCompressionDict(d)
            z.precompute_compress(level=3)
            self.squeeze.append(zstandard.ZstdCompressor(level=3, dict_data=z, write_content_size=False, write_dict_id=False).compress)
        if not self.squeeze:
            self.squeeze.append(zstandard.ZstdCompressor(level=3, write_content_size=False).compress)
        self.known = {(k[0], k[1]) for k in known} | {(a, b) for a in _ASCII for b in _ASCII}
        self.alphabet = Alphabet(letters, scripts)
        self.chains = Chains(self.alphabet)
        self.prune = prune
        self.cost = lru_cache(maxsize=20_000)(self._cost)
        self.options = lru_cache(maxsize=20_000)(self._options)

    def _cost(self, text: str) -> int:
        b = text.encode("utf-8", "surrogatepass")
        return min(len(f(b)) for f in self.squeeze)

    def _options(self, passage: str) -> list[tuple[tuple[str, ...], str, float, bool]]:
        """Chains by which the passage gets shorter: (chain, text, gain, weak).

        ``weak``: other letters for the same bytes prove nothing by themselves, as
        UTF-8 does.  So a chain without UTF-8 is weak if it makes more than one odd
        pair for two usual ones, or any at all where all it undoes is single
        characters of a two-byte encoding: two accented capitals look like that.  It
        isn't where it removes all C1 controls, as no clean text holds any.  The
        text is the passage itself where undoing the chain leaves some of it garbled.
        """
        odd = pairs_of(passage) - self.known
        unknown = len(odd)
        if not unknown and self.prune:
            return []
        may, had = self.alphabet.may, set(passage)
        plain = self.cost(passage)
        out: dict[tuple[str, ...], tuple[str, float, bool]] = {}
        for chain, t in self.chains.undone(passage):
            if not all(map(may, set(t) - had)):
                continue
            still = pairs_of(t) - self.known
            left = len(still)
            if self.prune and left >= unknown:
                continue
            wrong, right = chain[0].split(">")
            gain = plain - self.cost(t) + PAIR_COST * (unknown - left)
            if gain > 0 and (chain not in out or gain > out[chain][1]):
                new = len(still - odd)
                weak = right != "utf_8" and 2 * new > len(odd - still) or new > 0 and right in PAIRED and not _high_run(wrong, 4).search(passage)
                weak = weak and not (_CONTROL.search(passage) and not _CONTROL.search(t))
                out[chain] = t, float(gain), weak
        return [(chain, t if self._whole(chain, t, had) else passage, gain, weak) for chain, (t, gain, weak) in out.items()]

    def _whole(self, chain: tuple[str, ...], text: str, had: set[str]) -> bool:
        """Undoing the chain left nothing garbled behind.

        Left are characters of the passage that the wrong encoding has: none may be
        one that the languages don't write, nor a letter that begins sequences of
        UTF-8 and makes an odd pair.
        """
        wrong, right = chain[-1].split(">")
        if right in SINGLE:
            return True  # a table covers all of a passage's characters
        made = _bytes_of(wrong) if wrong not in PAIRED else {}
        left = {c for c in set(text) & had if c in made}
        if not all(map(self.alphabet.holds, left)):
            return False
        first = {c for c in left if made[c] >= 0xC2}
        return not first or not any(p not in self.known and (p[0] in first or p[1] in first) for p in pairs_of(text))

    def restore(self, text: str) -> tuple[str, list[str], float]:
        """(text, chains undone, bytes gained)."""
        if text.isascii() or self.prune and pairs_of(text) <= self.known:
            return text, [], 0.0
        parts = passages(text)
        options = [[] if p.isascii() else self.options(p) for p in parts]
        # a weak option waits until its chain has won elsewhere in the document
        waiting = [[x for x in o if x[3]] for o in options]
        options = [[x for x in o if not x[3]] for o in options]
        used: list[str] = []
        won: set[tuple[str, ...]] = set()
        total = 0.0
        while True:
            sums: dict[tuple[str, ...], float] = {}
            for o in options:
                for chain, _, gain, _ in o:
                    sums[chain] = sums.get(chain, 0.0) + gain
            worth = {c: g - STEP_COST * len(c) for c, g in sums.items()}
            if not worth or max(worth.values()) < LEAST_GAIN:
                break
            best = min(worth, key=lambda c: (-worth[c], len(c), c))
            used.append("|".join(best))
            won.add(best)
            total += worth[best]
            for i, o in enumerate(options):
                mine = next((x for x in o if x[0] == best), None)
                if mine:
                    # a passage takes the chain unless another serves it better by more than naming it costs
                    if mine[2] - STEP_COST * len(best) >= max(x[2] - STEP_COST * len(x[0]) for x in o) - SWITCH_COST:
                        parts[i], options[i], waiting[i] = mine[1], [], []
                    else:
                        options[i] = [x for x in o if x[0] != best]
        for i, w in enumerate(waiting):
            if mine := max((x for x in w if x[0] in won), key=lambda x: x[2], default=None):
                parts[i] = mine[1]
                total += mine[2]
        return "".join(parts), used, total


def _train(samples: list[bytes]) -> bytes:
    """A dictionary from samples; too few for training serve as they are."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


def _trained(texts: list[str]) -> bytes:
    return _train([p.encode() for t in texts for p in passages(t)])


def _merged(dictionaries: list[bytes]) -> bytes:
    """One dictionary from several, of other documents each: trained on what they hold behind their tables, which end with the first offsets."""
    if len(dictionaries) == 1:
        return dictionaries[0]
    held = [d.rpartition(b"\1\0\0\0\4\0\0\0\10\0\0\0")[2].decode("utf-8", "ignore") for d in dictionaries]
    return _trained(held)


_DOUBTED = ["cp1252", "latin_1", "cp1251", "cp1250", "mac_roman", "gbk"]  # encodings UTF-8 is most often read as


_CONTROL = re.compile(r"[\x80-\x9f]")


@lru_cache(maxsize=1)
def _all_tables() -> list[dict[str, str]]:
    """What each pair of single-byte encodings makes of a character, in whatever language."""
    out = []
    for wrong in SINGLE:
        for right in SINGLE:
            table = {}
            for c, b in _bytes_of(wrong).items():
                try:
                    table[c] = bytes([b]).decode(right)
                except UnicodeDecodeError:
                    pass
            if wrong != right and any(c != x for c, x in table.items()) and table not in out:
                out.append(table)
    return out


def _doubts(text: str) -> set[frozenset[str]]:
    """The scripts of what each run of non-ASCII characters is as UTF-8, byte for byte, signs left out; the empty set where the text holds C1 controls."""
    out = {frozenset()} if _CONTROL.search(text) else set()
    for run in set(_RUN.findall(text)):
        for enc in _DOUBTED if len(run) > 1 else ():
            try:
                raw = run.encode(enc) if enc in PAIRED else bytes(_bytes_of(enc)[c] for c in run)
                made = raw.decode("utf-8")
            except (KeyError, UnicodeError):
                continue
            out.add(frozenset(script(c) for c in made if c not in SIGNS))
    return out


def _foreign(count: Counter) -> dict[str, int]:
    """Per character a bit mask of the pairs of single-byte encodings that make of it one found in twice as many of the language's texts."""
    out = {}
    for c, n in count.items():
        if mask := sum(1 << i for i, t in enumerate(_all_tables()) if count[t.get(c, "")] >= 2 * n):
            out[c] = mask
    return out


class _Text:
    """What the passes of ``Learner`` ask of a text."""

    def __init__(self, text: str | None, packed: str | None = None):
        """From the text, or from ``packed``."""
        if packed is not None:
            self.chars, doubts, letters = packed.split("\n")
            self.doubts = {frozenset(filter(None, x.split("|"))) for x in doubts.split(";")[1:]}
            self.letters = {x.split(":")[0]: int(x.split(":")[1]) for x in letters.split(";") if x}
            return
        runs = "".join(_RUN.findall(text))
        self.chars = "".join(sorted(set(runs)))
        self.doubts = _doubts(text) if runs else set()
        self.letters = Counter(filter(None, map(script, runs)))

    def packed(self) -> str:
        return "\n".join([self.chars, "".join(";" + "|".join(sorted(x)) for x in sorted(self.doubts, key=sorted)), ";".join(f"{x}:{n}" for x, n in sorted(self.letters.items()))])


class Learner:
    """Which labelled texts are clean, told in four passes of counting over all of them.

    Labelled texts may be garbled themselves.  One is clean if none of its runs is
    UTF-8 byte for byte, if no other encoding makes commoner characters of all of
    its own, if it is in its language's script, and all its characters are common
    in its language.  ``count`` makes a pass over some texts; ``tell`` takes the
    sum of a pass's counts.  Counts are (language, what, item), as many as there are
    different characters and scripts in a language.
    """

    PASSES = 4

    def __init__(self) -> None:
        self.done, self.written, self.all_doubtful, self.foreign, self.own, self.rare, self.docs = 0, frozenset(), set(), {}, {}, {}, {}

    def keeps(self, lang: str, x: _Text, tests: int) -> bool:
        if tests > 0 and lang not in self.all_doubtful and any(d <= self.written for d in x.doubts):
            return False
        if tests > 1 and (masks := self.foreign.get(lang)):
            both = -1 if x.chars else 0
            for c in x.chars:
                both &= masks.get(c, 0)
            if both:
                return False
        # in a language of another script, texts of mostly Latin letters beyond ASCII are another decoding of its bytes
        if tests > 2 and (own := self.own.get(lang)) and 2 * sum(n for s, n in x.letters.items() if s in own) < sum(x.letters.values()):
            return False
        return tests < 4 or self.rare.get(lang, frozenset()).isdisjoint(x.chars)

    def count(self, texts: Iterator[tuple[str, _Text]]) -> Counter:
        out: Counter = Counter()
        for lang, x in texts:
            if not self.keeps(lang, x, max(0, self.done - 1)):
                continue
            items = x.chars if self.done in (1, 3) else x.letters
            # a test that no text of a language passes is left out there, so both counts are needed
            for what in ("all", "kept") if self.done and self.keeps(lang, x, self.done) else ("all",):
                out[lang, what, ""] += 1
                for i in items:
                    out[lang, what, i] += 1
        return out

    def tell(self, counts: dict[tuple[str, str, str], int]) -> None:
        of: dict[str, dict[str, Counter]] = {}
        for (lang, what, item), n in counts.items():
            of.setdefault(lang, {}).setdefault(what, Counter())[item] += n
        if self.done == 0:
            self.written = frozenset({"LATIN"} | {x for c in of.values() for x, n in c["all"].items() if x and n >= max(2, RARE * c["all"][""])})
        for lang, c in of.items():
            kept = c.get("kept", Counter())
            if self.done == 1:
                if not kept:
                    self.all_doubtful.add(lang)
                self.foreign[lang] = _foreign(Counter({x: n for x, n in (kept or c["all"]).items() if x}))
            elif self.done == 2:
                if not kept:
                    self.foreign.pop(lang, None)
                kept = kept or c["all"]
                self.own[lang] = frozenset(x for x, n in kept.items() if x and x != "LATIN" and n >= MAIN * kept[""])
            elif self.done == 3:
                n_docs = self.docs[lang] = kept.pop("", 0)
                large = {x for x, n in Counter(filter(None, map(script, kept))).items() if n >= LARGE}
                self.rare[lang] = frozenset(c for c, n in kept.items() if n < RARE * n_docs and script(c) not in large and c not in SIGNS)
        self.done += 1


def _facts(texts: list[str]) -> Iterator[tuple[str, str, int]]:
    """(what, item, in how many) of different clean texts: non-ASCII pairs, letters, scripts, and all of them."""
    pairs, letters, scripts = Counter(), Counter(), Counter()
    for t in texts:
        pairs.update(a + b for a, b in pairs_of(t) if not (a.isascii() and b.isascii()))
        mine = {c for c in set(t) if c.isalpha() and not c.isascii()}
        letters.update(mine)
        scripts.update(set(filter(None, map(script, mine))))
    for what, c in (("pair", pairs), ("letter", letters), ("script", scripts)):
        for item, n in c.items():
            yield what, item, n
    yield "texts", "", len(texts)


def _learned(trained: dict[str, bytes], pairs: dict[str, int], letters: dict[str, int], scripts: dict[str, Counter]) -> tuple[dict[str, bytes], list[str], str, list[str]]:
    both = {x for c, n in letters.items() if n > 1 for x in (c, c.upper(), c.lower()) if len(x) == 1}
    own = {x for c in scripts.values() for x, n in c.items() if x and x != "LATIN" and n >= MAIN * c[""]}
    return trained, sorted(p for p, n in pairs.items() if n > 1), "".join(sorted(both)), sorted(own)


def learn(by: dict[str, list[str]]) -> tuple[dict[str, bytes], list[str], str, list[str]]:
    """From texts by language: a dictionary per language, the non-ASCII pairs of at least two clean texts, the letters of clean texts, and the scripts other than Latin that a language is written in.  See ``Learner``; ``fit`` does the same on a table."""
    m = Learner()
    seen = [(lang, t, _Text(t)) for lang, texts in sorted(by.items()) for t in texts]
    for _ in range(m.PASSES):
        m.tell(m.count((lang, x) for lang, _, x in seen))
    trained, found, scripts = {}, {"pair": Counter(), "letter": Counter()}, {}
    for lang in by:
        if clean := sorted({t for at, t, x in seen if at == lang and m.keeps(lang, x, m.PASSES)}):
            trained[lang] = _trained(clean)
            for what, item, n in _facts(clean):
                (found[what] if what in found else scripts.setdefault(lang, Counter()))[item] += n
    return _learned(trained, found["pair"], found["letter"], scripts)


def fit(df: DataFrame, key: str, text: str, lang: str) -> tuple[dict[str, bytes], list[str], str, list[str]]:
    """``learn`` on all labelled documents of all languages.

    To the driver come counts, of different characters and pairs, and one
    dictionary a language.  Clean texts are shuffled once, in groups of about
    ``GROUP_DOCS`` by their hash, so that equal texts meet and count once; a group's
    dictionary is trained on all of it, and groups' dictionaries are merged, ``GROUP_DICTS``
    at a time.
    """
    src = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"lang": pdf["lang"], "x": ["\n\n" if t.isascii() else _Text(t).packed() for t in pdf["text"]]})

    seen = materialize(src.mapInPandas(pack, "lang string, x string"), "labelled")
    m = Learner()
    for _ in range(m.PASSES):

        def count(batches: Iterator[pd.DataFrame], m: Learner = m) -> Iterator[pd.DataFrame]:
            out: Counter = Counter()
            for pdf in batches:
                out.update(m.count((a, _Text(None, x)) for a, x in zip(pdf["lang"], pdf["x"])))
            yield pd.DataFrame([(*k, n) for k, n in out.items()], columns=["lang", "what", "item", "n"])

        sums = seen.mapInPandas(count, "lang string, what string, item string, n bigint").groupBy("lang", "what", "item").agg(F.sum("n").alias("n"))
        m.tell({(r[0], r[1], r[2]): r[3] for r in sums.collect()})

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for pdf in batches:
            pdf = pdf[[m.keeps(a, _Text(t), m.PASSES) for a, t in zip(pdf["lang"], pdf["text"])]]
            groups = [-(-m.docs[a] // GROUP_DOCS) for a in pdf["lang"]]
            yield pdf.assign(part=[zlib.crc32(t.encode()) % n for t, n in zip(pdf["text"], groups)])

    def facts(pdf: pd.DataFrame) -> pd.DataFrame:
        texts, a, part = sorted(set(pdf["text"])), pdf["lang"].iloc[0], int(pdf["part"].iloc[0])
        rows = [(a, part, what, item, n, None) for what, item, n in _facts(texts)]
        return pd.DataFrame([*rows, (a, part, "dictionary", "", len(texts), _trained(texts))], columns=["lang", "part", "what", "item", "n", "held"])

    schema = "lang string, part bigint, what string, item string, n bigint, held binary"
    got = materialize(src.mapInPandas(clean, "lang string, text string, part bigint").groupBy("lang", "part").applyInPandas(facts, schema), "learned")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        return pd.DataFrame([(pdf["lang"].iloc[0], int(pdf["part"].iloc[0]) // GROUP_DICTS, _merged(list(pdf["held"])))], columns=["lang", "part", "held"])

    dictionaries, most = got.where("what = 'dictionary'").select("lang", "part", "held"), max([1, *(-(-n // GROUP_DOCS) for n in m.docs.values())])
    while most > 1:
        dictionaries = dictionaries.groupBy("lang", F.floor(F.col("part") / GROUP_DICTS)).applyInPandas(merge, "lang string, part bigint, held binary")
        most = -(-most // GROUP_DICTS)
    trained = {r["lang"]: bytes(r["held"]) for r in dictionaries.select("lang", "held").collect()}
    sums = {what: {r[0]: r[1] for r in got.where(F.col("what") == what).groupBy("item").agg(F.sum("n").alias("n")).where("n > 1").collect()} for what in ("pair", "letter")}
    scripts: dict[str, Counter] = {}
    for r in got.where("what in ('script', 'texts')").groupBy("lang", "item").agg(F.sum("n")).collect():
        scripts.setdefault(r[0], Counter())[r[1]] = r[2]
    return _learned(trained, sums["pair"], sums["letter"], scripts)


def restore(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, text, restored, garbled, lost, chains, gain), one row per input row.

    ``garbled``: a passage was decoded wrongly; ``lost``: characters cannot be
    restored; ``chains``: the wrong>right steps undone; ``gain``: bytes saved.
    A null text stays null and is not garbled; ASCII texts never leave the JVM.
    Repeated rows stay repeated; other columns are ignored.
    """
    learned = fit(df, key, text, lang)
    src = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    odd = F.coalesce(F.col("text").rlike(r"[^\x00-\x7F]"), F.lit(False))
    schema = f"key {src.schema['key'].dataType.simpleString()}, text string, restored string, garbled boolean, lost boolean, chains array<string>, gain double"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Restorer(*learned)
        for pdf in batches:
            done = [r.restore(t) for t in pdf["text"]]
            lost = ["�" in x[0] or "�" in t for x, t in zip(done, pdf["text"])]
            yield pd.DataFrame({
                "key": pdf["key"], "text": pdf["text"], "restored": [x[0] for x in done], "garbled": [bool(x[1]) or y for x, y in zip(done, lost)],
                "lost": lost, "chains": [x[1] for x in done], "gain": [x[2] for x in done],
            })

    changed = src.where(odd).mapInPandas(work, schema)
    same = src.where(~odd).select("key", "text", F.col("text").alias("restored"), F.lit(False).alias("garbled"), F.lit(False).alias("lost"), F.expr("cast(array() as array<string>)").alias("chains"), F.lit(0.0).alias("gain"))
    return same.unionByName(changed).withColumnRenamed("key", key)
