"""Text normalisation and tokenizers as column expressions, all in the JVM."""

from __future__ import annotations

import os
import unicodedata
import zipfile
from functools import cache
from pathlib import Path

import pyspark
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[a-z]+(?:[-'][a-z]+)*"
#: The 49 letters of the language identifier.
ALPHABET = "".join(map(chr, range(97, 123))) + "àâäçèéêëìíîïòóôöùúûüÿæœ"


@cache
def stop_words(language: str = "english") -> tuple[str, ...]:
    """Spark ML's default list, read from its jar, so that no session is needed."""
    homes = (pyspark.__path__[0], os.environ.get("SPARK_HOME", ""))
    jar = next(j for home in homes for j in Path(home, "jars").glob("spark-mllib_*.jar"))
    with zipfile.ZipFile(jar) as z:
        text = z.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt").decode()
    return tuple(sorted({w.strip().lower() for w in text.splitlines() if w.strip()}))


@cache
def _fold_map() -> tuple[str, str]:
    src, dst = [], []
    for cp in range(128, 0x2FFFF):
        kept = "".join(c for c in unicodedata.normalize("NFD", chr(cp)) if ord(c) < 128)
        if len(kept) == 1:
            src.append(chr(cp))
            dst.append(kept)
    return "".join(src), "".join(dst)


def ascii_fold(text: Column) -> Column:
    """Canonical decomposition, then only ASCII stays: accents go, other letters and spaces vanish."""
    src, dst = _fold_map()
    folded = F.regexp_replace(F.translate(text, src, dst), r"[^\x00-\x7F]", "")
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(folded)  # ASCII stays as it is


def tokens_split(text: Column) -> Column:
    """Signs are deleted before folding ('foo-bar' is one token), then white space splits."""
    bare = ascii_fold(F.lower(F.regexp_replace(text, r"(?U)[^\w\s]|_", "")))
    return F.filter(F.split(F.trim(bare), r"\s+"), lambda x: x != "")


def tokens_words(text: Column) -> Column:
    """Runs of a-z with inner hyphens and apostrophes, after lower case and folding."""
    return F.regexp_extract_all(ascii_fold(F.lower(text)), F.lit(WORD), F.lit(0))


def tokens_trec(text: Column) -> Column:
    """Like tokens_words, without folding."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def clean_query(text: Column, stop: tuple[str, ...]) -> Column:
    """Lower case, runs of a-z and 0-9 of two or more, no stopwords, joined by blanks."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_join(F.filter(words, lambda x: (F.length(x) > 1) & ~x.isin(*stop)), " ")


def letters_only(text: Column, alphabet: str = ALPHABET) -> Column:
    """Lower case, only the letters of an alphabet; words run together."""
    return F.regexp_replace(F.lower(text), f"[^{alphabet}]", "")


def is_valid_term(term: Column, stop: tuple[str, ...], low: int = 2, high: int = 25) -> Column:
    return F.length(term).between(low, high) & ~term.isin(*stop)


def is_valid_typed(term: Column, ty: Column, stop: tuple[str, ...], low: int = 2, high: int = 25) -> Column:
    """Addresses and names of any length from low, other types up to high; no stopwords."""
    return (F.length(term) >= low) & (ty.isin("url", "email", "proper") | (F.length(term) <= high)) & ~term.isin(*stop)


_UP, _LOW = "A-ZÁÉÍÓÚÜÑ", "a-záéíóúüñ"
_LETTER, _GAP = f"[{_UP}{_LOW}]", r"[\t ]{1,3}"
_NAME = f"[{_UP}][{_LOW}]+"
#: Types of the typed tokenizer in the order in which their matches are taken and masked; words come last.
TYPED = {
    "url": r"""(?iuU)(?:www\.|(?:s?ftp|https?)://)[^<>'"\s]+""",
    "email": r"(?U)\b[-+%._0-9A-Za-z]+@[-.0-9A-Za-z]+\.[A-Za-z]{2,}\b",
    "date": r"(?U)\b(?:\d{1,2}[-/]){2}\d{2,4}\b",
    "number": r"(?U)\b(?:\+?\d{1,3}[-\s]?)?\d(?:[.,:/-]?\d)*[.,:/-]?%?\b",
    "abbrev": rf"(?U)(?:{_LETTER}{{1,4}}\.){{2,}}{_LETTER}{{0,4}}|\b[{_UP}][A-Z{_LOW}]{{1,5}}\.|\b[A-Za-z]\.(?=\S)",
    "proper": rf"(?U)\b{_NAME}(?:{_GAP}(?:(?:de|del|la|las|los|e|y){_GAP})?{_NAME})+",
}


def tokens_typed(text: Column) -> Column:
    """array<struct<ty, tok>>: url, email, date, number, abbrev, proper, then word.

    Each type's matches are replaced by blanks before the next is searched. A match of one, two or three
    characters leaves as many blanks, a longer one four, since a name may bridge up to three. Abbreviations and
    names are folded but keep their case; words are in lower case. The order within a type is that of the text.
    """
    return _typed(F.regexp_replace(text, "[\x01\x02]", ""), list(TYPED.items()))


#: What every match of a type holds, as a cheaper test of the text.
_NEEDED = {
    "url": lambda t: F.contains(t, F.lit("://")) | F.contains(F.lower(t), F.lit("www.")), "email": lambda t: F.contains(t, F.lit("@")),
    "date": lambda t: F.rlike(t, F.lit(r"(?U)\d[-/]\d")), "number": lambda t: F.rlike(t, F.lit(r"(?U)\d")),
}


def _once(value: Column, f) -> Column:
    """f(value), with value computed once however often f names it; a plain column would be computed at each place."""
    return F.transform(F.array(value), f)[0]


def _typed(rest: Column, types: list[tuple[str, str]]) -> Column:
    """Tokens of the types, then words. A type's expression is searched once, to mark its matches; they are taken from between the marks."""
    if not types:
        return _of_type(F.regexp_extract_all(ascii_fold(F.lower(rest)), F.lit(rf"\b{WORD}\b"), F.lit(0)), "word")
    (ty, rx), more = types[0], types[1:]
    flags, body = rx[: rx.index(")") + 1], rx[rx.index(")") + 1 :]

    def taken(marked: Column) -> Column:
        found = F.regexp_extract_all(marked, F.lit("\x01([^\x02]*)\x02"), F.lit(1))
        if ty in ("abbrev", "proper"):
            found = F.transform(found, lambda x: F.trim(ascii_fold(x)))
        blank = marked
        for width in (1, 2, 3):
            blank = F.regexp_replace(blank, f"(?s)\x01.{{{width}}}\x02", " " * width)
        blank = F.when(F.contains(marked, F.lit("\x01")), F.regexp_replace(blank, "\x01[^\x02]*\x02", "    ")).otherwise(marked)
        return F.concat(_of_type(found, ty), _once(blank, lambda x: _typed(x, more)))

    marked = F.regexp_replace(rest, f"{flags}({body})", "\x01$1\x02")
    return _once(F.when(_NEEDED[ty](rest), marked).otherwise(rest) if ty in _NEEDED else marked, taken)


def _of_type(tokens: Column, ty: str) -> Column:
    return F.transform(tokens, lambda x: F.struct(F.lit(ty).alias("ty"), x.alias("tok")))


#: Markup that has no text of its own.
_DROPPED = "(?is)" + "|".join([rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in ("script", "style", "noscript")] + [r"<!--.*?-->", r"<(?:meta|link)\b[^>]*>"])


def without_scripts(html: Column) -> Column:
    return F.regexp_replace(html, _DROPPED, " ")


def decoded(text: Column) -> Column:
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def html_text(html: Column) -> Column:
    """Text of a page without scripts, styles and tags, five entities decoded, white space collapsed."""
    bare = decoded(F.regexp_replace(without_scripts(html), r"(?s)<[^>]*>", " "))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def html_title(html: Column, otherwise: Column) -> Column:
    """The title, else the first heading, else another name; up to 250 characters."""
    head = [html_text(F.regexp_extract(html, rf"(?is)<{t}\b[^>]*>(.*?)</{t}\s*>", 1)) for t in ("title", "h1")]
    return F.substring(F.coalesce(*[F.when(h != "", h) for h in head], otherwise), 1, 250)
