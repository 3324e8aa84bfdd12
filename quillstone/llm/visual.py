"""Visually identical text with different characters, in one consistent form.

Method: every different value gets its look-alike-mapped form; values are
grouped by that form under Spark's accent- and case-sensitive ``UNICODE``
collation; each group's canonical member is chosen deterministically and joined
back.  A group whose members all hold variants gets the mapped form itself, so
the result never holds one.

Distribution: a value of common characters only is its own form, and no other
such value equals it under the collation, so it is canonical in its class.  Such
rows are never shuffled with their text; they are counted by hash, to learn
which classes hold one.  Only the different values with an uncommon character
are mapped, grouped and joined back.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import lookalike
from quillstone.session import materialize

#: Characters of which no two different sequences are equal under the collation, and none of which is or makes a variant.
_ASCII = "\\t\\n\\r -~"
_BEYOND = "¡-¬®-ıĴ-ňŊ-žḀ-ẙ‒-―‘-•…‰′-″‹-›€№™∂-∿一-龥、-〆〈-】ぁ-ゖァ-ヺ가-힣"
#: The long class is asked only for what the short one leaves.
_UNCOMMON = f"[^{_ASCII}](?<![{_BEYOND}])"
_IGNORED = regex.compile(r"[\p{Cc}--[\t\n\v\f\r\u0085]]", regex.V1)

HOT = 100  #: a value of more than 1/HOT of the rows joined back is hot, so there are fewer than HOT of them
HOT_CHARS = 32_000_000  #: most characters of the hot values together that are broadcast


def has_variant(text: str) -> bool:
    """Does the text hold a full-width ASCII form, an invisible format character, a space other than U+0020, an
    accent stored apart from its letter though one character exists, joined Latin letters, a non-breaking hyphen,
    or a word that mixes Latin with Cyrillic or Greek letters?"""
    if text.isascii():
        return False
    if lookalike.FORMAT.search(text) or lookalike.SPACES.search(text) or any(ord(c) in lookalike.FULL or ord(c) in lookalike.JOINED or c == "‑" for c in text):
        return True
    if any(len(unicodedata.normalize("NFC", m)) < len(m) for m in lookalike.MARKED.findall(text)):
        return True
    return any(lookalike.LATIN.search(w) and lookalike.OTHER.search(w) for w in lookalike.WORD.findall(text))


def _map(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        form = pdf["value"].map(lookalike.one_form)
        plain = form.map(lambda x: unicodedata.normalize("NFC", _IGNORED.sub("", x)))
        yield pdf.assign(form=form, plain=plain, variant=pdf["value"].map(has_variant).astype(bool))


def _hashes(c: str) -> list[Column]:
    return [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit("b"), c).alias("h2")]


def one_form(df: DataFrame, keys: list[str], text: str = "text", dedupe: bool = True) -> DataFrame:
    """(keys, text, canonical, has_variant), one row per key.

    The canonical member of a class is its value of common characters, else the
    most frequent, then smallest value without a variant, else the form.  With
    ``dedupe`` a key delivered again comes out once (should its texts differ, with
    an uncommon one); without it the caller removes repeats from the (much smaller) result.  A null text stays null and has no
    variant, an empty one stays empty.  Equal values are folded before any
    shuffle; a value of common characters may fill any share of the rows, and an
    uncommon one that fills more than 1/``HOT`` of theirs is joined by broadcast.
    Other columns are ignored.
    """
    src = df.select(*keys, F.col(text).alias("value__"))
    uncommon = F.coalesce(F.col("value__").rlike(_UNCOMMON), F.lit(False))
    rows = materialize(src.where(uncommon).select(*keys, "value__", *(h.alias(f"{n}__") for h, n in zip(_hashes("value__"), ("h1", "h2")))), "uncommon")
    odd = rows.select(F.col("value__").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    forms = materialize(odd.mapInPandas(_map, "value string, n bigint, form string, plain string, variant boolean"), "forms")
    # hashes of uncommon values meet none of those wanted below
    common = src.where(F.col("value__").isNotNull()).select(*_hashes("value__")).groupBy("h1", "h2").agg(F.count("*").alias("n"))
    wanted = forms.where(~F.col("plain").rlike(_UNCOMMON)).select("plain").distinct().select(F.col("plain").alias("value"), *_hashes("plain"))
    own = wanted.join(common, ["h1", "h2"]).select("value", "n", F.col("value").alias("form"), F.lit(0).alias("v"))
    members = own.unionByName(forms.select("value", "n", "form", F.when(F.col("variant"), 2).otherwise(1).alias("v")))
    cls = F.collate("form", "UNICODE").alias("class")
    rank = F.struct("v", (-F.col("n")).alias("n"), "value")
    best = members.groupBy(cls).agg(F.min(rank).alias("best"), F.min("form").alias("least"))
    canonical = F.when(F.col("best.v") < 2, F.col("best.value")).otherwise(F.col("least"))
    changes = forms.select("value", "n", "variant", cls).join(best.select("class", canonical.alias("to")), "class").where((F.col("to") != F.col("value")) | F.col("variant"))
    changes = materialize(changes.select(*_hashes("value"), "n", "to", "variant"), "changes")

    same = src.where(~uncommon)
    if dedupe:
        same = same.join(rows.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)
        rows = rows.dropDuplicates(keys)
    same = same.select(*keys, F.col("value__").alias(text), F.col("value__").alias("canonical"), F.lit(False).alias("has_variant"))
    total = forms.agg(F.sum("n")).first()[0] or 0
    return same.unionByName(_joined(rows, changes, total).select(*keys, F.col("value__").alias(text), F.coalesce("to__", "value__").alias("canonical"), F.coalesce("variant__", F.lit(False)).alias("has_variant")))


def _joined(rows: DataFrame, changes: DataFrame, total: int) -> DataFrame:
    """``rows`` with to__ and variant__ of their value, by hash; hot values by broadcast, their number and size being checked."""
    by = ["h1__", "h2__"]
    c = changes.select(F.col("h1").alias("h1__"), F.col("h2").alias("h2__"), F.col("to").alias("to__"), F.col("variant").alias("variant__"), F.col("n").alias("n__"))
    hot = F.col("n__") * HOT > total
    count, chars = c.where(hot).agg(F.count("*"), F.coalesce(F.sum(F.length("to__")), F.lit(0))).first()
    if not count or chars > HOT_CHARS:
        return rows.join(c.drop("n__"), by, "left")
    seen = rows.join(F.broadcast(c.where(hot).drop("n__").withColumn("hot__", F.lit(True))), by, "left")
    rest = seen.where("hot__ is null").select(*rows.columns).join(c.where(~hot).drop("n__"), by, "left")
    return seen.where("hot__").drop("hot__").unionByName(rest)
