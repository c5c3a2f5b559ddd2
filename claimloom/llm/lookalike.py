"""Problem 1: text that looks the same but is made of different characters.

``one_form`` brings a text to one spelling, such that two texts have the same
look exactly if their forms are equal strings. Form, width, joined letters,
make-up of accented letters, invisible signs and the kinds of blank and hyphen
are settled character by character. Letters of several scripts are settled per
token: the sets of scripts in which each letter can be spelt (its own and those
of its look-alikes) are intersected over the token. One script left: a mixed
token is respelt in it. Several left: a whole-script look-alike, spelt in the
script that prevails among the line's letters that have no look-alike. None
left: every letter that has one takes its Latin look-alike. All three choices
depend on the look only, never on the code points met.

Letter case, raised and lowered signs, fractions, other accents, digits and
punctuation are kept.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.sources.tables import small, written

# Letters that look alike, one class per word, its Latin letter first.
CLASSES = (
    "AАΑᎪ BВΒᏴ CСϹᏟ EЕΕᎬ HНΗᎻ IІΙ JЈᎫ KКΚᏦK MМΜᎷ NΝ OОΟՕ PРΡᏢ SЅՏᏚ TТΤᎢ XХΧ YҮΥ ZΖᏃ "
    "aаα cсϲ dԁ eе gցɡ hһհ iіι jјϳ lӏ nո oоοօ pрρ qԛզ sѕ uυս vνѵ wԝѡ xх yуγ ʙв ᴋкκ ᴍм ᴛтτ"
).split()
SAME_SIGN = {"µ": "μ", "Ω": "Ω", "ϐ": "β", "ϑ": "θ", "ϕ": "φ", "ϖ": "π", "ϰ": "κ", "ϱ": "ρ", "ſ": "s"}
USUAL = "АВСЕНІЈКМОРЅТХУасеіјорѕухгквмтΑΒΕΗΙΚΜΝΟΡΤΧΥΖαγικνορυτ"
HYPHENS = "‐‑﹣－"
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ"
JOINED = "ĲĳǄǅǆǇǈǉǊǋǌǱǲǳ"
WORDS = ("verbatim", "whitespace_normalised")
# End of the fixed values.

SPLIT = 10_000  # rows of one look in one task
SCRIPTS = ("Latin", "Greek", "Cyrillic", "Armenian", "Cherokee")
FOREIGN = regex.compile(r"[\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}ɡʙᴋᴍᴛ]")
TOKEN = regex.compile(r"[\p{L}\p{M}]+")


def _signs() -> dict[int, str | None]:
    """What each sign alone becomes, from its Unicode properties."""
    to: dict[int, str | None] = {}
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        kind, made = unicodedata.category(ch), unicodedata.decomposition(ch)
        if kind == "Cf" or ch in INVISIBLE or 0xFE00 <= cp <= 0xFE0F or 0x180B <= cp <= 0x180F or 0xE0100 <= cp <= 0xE01EF:
            to[cp] = None
        elif kind == "Zs":
            to[cp] = " "
        elif ch in HYPHENS:
            to[cp] = "-"
        elif made.startswith(("<wide>", "<narrow>")) or 0xFB00 <= cp <= 0xFB17 or ch in JOINED:
            to[cp] = unicodedata.normalize("NFKC", ch)
    return to | {ord(a): b for a, b in SAME_SIGN.items()} | {9: " "}


@lru_cache(maxsize=None)
def _tables() -> tuple[dict[int, str | None], dict[str, dict[str, str]]]:
    """Sign table, and for each letter with look-alikes its spelling in each script."""
    spelt: dict[str, dict[str, str]] = {}
    for word in CLASSES:
        by: dict[str, str] = {}
        for ch in word:
            by.setdefault(script(ch), ch)
        for ch in word:
            spelt[ch] = by
    return _signs(), spelt


@lru_cache(maxsize=None)
def script(ch: str) -> str:
    return next((s for s in SCRIPTS if regex.match(rf"\p{{{s}}}", ch)), "Other")


def _respell(line: str) -> str:
    """The decomposed ``line`` with each token in the script that fits it."""
    spelt = _tables()[1]
    sure = Counter(script(ch) for ch in line if ch not in spelt and ch.isalpha())
    order = sorted(SCRIPTS, key=lambda s: (-sure[s], SCRIPTS.index(s)))

    def token(m: regex.Match) -> str:
        letters = m[0]
        if letters.isascii() and order[0] == "Latin":
            return letters
        fits, usual = set(SCRIPTS), set(SCRIPTS)
        for ch in letters:
            if ch.isalpha():
                fits &= spelt[ch].keys() if ch in spelt else {script(ch)}
                usual &= {s for s, x in spelt[ch].items() if s == "Latin" or x in USUAL} if ch in spelt else {script(ch)}
        to = next((s for s in order if s in fits and (s in usual or "Latin" not in fits)), "")
        return "".join(spelt[ch].get(to) or spelt[ch].get("Latin", ch) if ch in spelt else ch for ch in letters)

    return TOKEN.sub(token, line)


def one_form(text: str | None) -> str | None:
    """``text`` in the one form of its look; null stays null, "" stays "".

    The context of a token is its line.
    """
    if text is None:
        return None
    if text.isascii():
        return text.replace("\t", " ")
    text = unicodedata.normalize("NFD", text.translate(_tables()[0]))
    if FOREIGN.search(text):
        text = "\n".join(map(_respell, text.split("\n")))
    return unicodedata.normalize("NFC", text)


def skeleton(text: str | None) -> str | None:
    """As ``one_form``, but with every look-alike letter as its Latin one.

    Not meant for reading: words of any language compare equal in any context.
    """
    if text is None or text.isascii():
        return one_form(text)
    text = unicodedata.normalize("NFD", text.translate(_tables()[0]))
    return unicodedata.normalize("NFC", text.translate(_latin()))


@lru_cache(maxsize=None)
def _latin() -> dict[int, str]:
    return {ord(ch): by.get("Latin", ch) for ch, by in _tables()[1].items()}


@F.pandas_udf(T.StringType())
def _one_form(texts: pd.Series) -> pd.Series:
    return texts.map(one_form, na_action="ignore")


@F.pandas_udf(T.StringType())
def _skeleton(texts: pd.Series) -> pd.Series:
    return texts.map(skeleton, na_action="ignore")


def looks(text: Column, bare: bool = False) -> Column:
    """``one_form``, or if ``bare`` ``skeleton``, as a column.

    Texts of ASCII only never leave the JVM.
    """
    plain = text.rlike(r"^\p{ASCII}*$")
    rest = F.when(~plain, text)
    return F.when(plain, F.translate(text, "\t", " ")).otherwise(_skeleton(rest) if bare else _one_form(rest))


def normalise(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the string ``columns`` in one form each.

    Null and empty strings stay as they are; repeated rows stay repeated; other
    columns pass through; an empty table gives an empty table.
    """
    return df.withColumns({c: looks(F.col(c)) for c in columns})


def same_look_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (key_a < key_b) of keys whose texts differ but look the same.

    Null keys and texts take no part; repeated rows count once; two texts under
    one key make no pair with each other. The looks that occur in two spellings
    are found by an aggregate of one row per look and task; only rows of such
    looks are joined, so a text copied without change costs no pair. The rows of
    a look that has more than ``SPLIT`` are spread over several tasks.
    """
    digest = lambda c: F.unhex(F.md5(c))
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    rows = written(rows.select("k", digest(looks(F.col("t"))).alias("look"), digest("t").alias("spelling")), "looks")
    twice = rows.groupBy("look").agg(F.min("spelling").alias("a"), F.max("spelling").alias("b")).where("a <> b").select("look")
    rows = written(rows.join(twice, "look", "left_semi").distinct(), "looks-in-two-spellings")
    hot = rows.groupBy("look").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT)
    rows = rows.join(small(hot), "look", "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / SPLIT), F.lit(1)).cast("int"))
    one = rows.select("look", F.col("k").alias("key_a"), "spelling", F.pmod(F.xxhash64("k"), "parts").cast("int").alias("part"))
    other = rows.select("look", F.col("k").alias("key_b"), F.col("spelling").alias("s"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = one.join(other, ["look", "part"]).where("key_a < key_b and spelling <> s")
    return pairs.select("key_a", "key_b").distinct()


def meant_words(df: DataFrame, key: str, word: str, words: tuple[str, ...] = WORDS) -> DataFrame:
    """(key_a, key_b): keys whose ``word`` is none of ``words`` but looks like one.

    Blanks at the ends do not show. Null words, and words that look like none of
    ``words``, give no row.
    """
    rows = df.select(F.col(key).alias("key_a"), F.col(word).alias("w")).where(F.col("w").isNotNull() & ~F.col("w").isin(*words))
    return rows.select("key_a", F.trim(looks(F.col("w"))).alias("key_b")).where(F.col("key_b").isin(*words)).distinct()
