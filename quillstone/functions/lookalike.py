"""Bringing text that looks alike to one form (pure Python, for use inside Arrow batches)."""

from __future__ import annotations

import unicodedata

import regex

# Letters of other scripts that look like a Latin one.
CYRILLIC = dict(zip("аеорсухіјѕԁһԛԝӏѵАВЕКМНОРСТУХІЈЅԌԚԜӀѴ", "aeopcyxijsdhqwlvABEKMHOPCTYXIJSGQWIV"))
GREEK = dict(zip("αγεικνορτυχηωςΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ayeikvoptuxnwcABEZHIKMNOPTYX"))

TO_LATIN = {ord(k): v for k, v in (CYRILLIC | GREEK).items()}
_BACK_CYRILLIC = {ord(v): k for k, v in reversed(CYRILLIC.items())}
_BACK_GREEK = {ord(v): k for k, v in reversed(GREEK.items())}

FORMAT = regex.compile(r"\p{Cf}")
SPACES = regex.compile(r"[\p{Zs}--[ ]]", regex.V1)
FULL = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
MARKED = regex.compile(r"\p{L}\p{M}+")
WORD = regex.compile(r"[\p{L}\p{M}]+")
LATIN, OTHER = regex.compile(r"\p{Latin}"), regex.compile(r"[\p{Cyrillic}\p{Greek}]")


def _joined() -> dict[int, str]:
    """Letters that stand for several Latin letters joined, from their compatibility decomposition."""
    out = {}
    for c in range(0x80, 0x10000):
        d = unicodedata.decomposition(chr(c))
        if d.startswith("<compat>") and unicodedata.category(chr(c))[0] == "L":
            plain = unicodedata.normalize("NFKC", chr(c))
            if len(plain) > 1 and all(unicodedata.name(x, "").startswith("LATIN") for x in plain):
                out[c] = plain
    return out


JOINED = _joined()


def unmix(word: str) -> str:
    """A word of Latin letters and look-alikes of another script in one script; other words unchanged."""
    if not (LATIN.search(word) and OTHER.search(word)):
        return word
    if all(ord(c) in TO_LATIN for c in OTHER.findall(word)):
        return word.translate(TO_LATIN)
    for back in (_BACK_CYRILLIC, _BACK_GREEK):
        if all(ord(c) in back for c in LATIN.findall(word)):
            return word.translate(back)
    return word.translate(TO_LATIN)


def composed(text: str) -> str:
    """Letters with their accents in one character where one exists."""
    return MARKED.sub(lambda m: unicodedata.normalize("NFC", m[0]), text)


def one_form(text: str) -> str:
    """Full-width forms, spaces, joined letters and hyphens in their plain form, no invisible characters, accents composed, mixed words in one script."""
    if text.isascii():
        return text
    t = SPACES.sub(" ", FORMAT.sub("", text.translate(FULL).translate(JOINED).replace("‑", "-")))
    return WORD.sub(lambda m: unmix(m[0]), composed(t))
