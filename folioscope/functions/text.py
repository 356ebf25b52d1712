"""Text-cleaning and token expressions: Column in, Column out, all in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of lexical scoring: ASCII letters and digits, joined by single dots or commas.
TOKEN = r"[a-zA-Z0-9]+(?:[.,][a-zA-Z0-9]+)*"
_WORD = r"[\p{L}\p{N}_]"
#: Unicode white space, as ``(?U)\s`` has it.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without Unicode white space at either end (``trim`` knows spaces only)."""
    return F.btrim(c, F.lit(_SPACES))


def _let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``c``, which is worked out once however often ``f`` reads it."""
    return F.transform(F.array(c), f)[0]


def _replace_in(c: Column, held: tuple[str, ...], regex: str, by: str) -> Column:
    """``regexp_replace``, of texts alone that hold one of ``held``: no other can match, and bytes are compared far faster."""
    found = lambda x: reduce(or_, [F.contains(x, F.lit(h)) for h in held])
    return _let(c, lambda x: F.when(found(x), F.regexp_replace(x, regex, by)).otherwise(x))


def _line_ends(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def _single_blanks(c: Column) -> Column:
    return _replace_in(c, ("  ", "\t"), r"[ \t]{2,}|\t", " ")


def _paragraphs(c: Column) -> Column:
    return _replace_in(c, ("\n\n\n",), r"\n{3,}", "\n\n")


def clean_ingest(c: Column) -> Column:
    """Page text: line ends, hyphenated line breaks (one word character a side), runs of blanks."""
    c = _line_ends(F.coalesce(c, F.lit("")))
    c = _replace_in(c, ("-\n",), rf"({_WORD})-\n({_WORD})", "$1$2")
    return strip(_paragraphs(_single_blanks(c)))


def clean_chunk(c: Column) -> Column:
    """Chunk text: as above in another order; hyphens join whole words, line ends come last."""
    c = _paragraphs(_single_blanks(F.coalesce(c, F.lit(""))))
    c = _replace_in(c, ("-\n",), rf"(?<!{_WORD})({_WORD}++)-\n({_WORD}++)", "$1$2")
    return strip(_line_ends(c))


def normalize_ws(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def normalize_eval(c: Column) -> Column:
    """Lower case; underscores and backslashes are blanks."""
    return normalize_ws(F.translate(F.lower(c), "_\\", "  "))


def sentences(c: Column) -> Column:
    """Sentences: blanks after . ! ? part them, decimals and abbreviations do not."""
    # Only a period before white space can part sentences, so decimals and the
    # inner dots of abbreviations need no protection; what precedes it is looked at only there.
    end = r"(?iU)([.!?])(?=\s)(?<!\b(?:e\.g|i\.e|etc|Dr|Mr|Mrs|Ms|Fig|Eq|approx|vs)\.)\s+"
    parts = F.split(F.regexp_replace(clean_chunk(c), end, "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, lambda s: strip(F.replace(s, F.lit("<DOT>"), F.lit(".")))), lambda s: s != "")


def words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


_SCRIPTS = {"latin": "A-Za-z", "hindi": "ऀ-ॿ", "kannada": "ಀ-೿", "digits": "0-9"}


#: What stands for a character of a script in :func:`_signs`.
_SIGNS = {"hindi": "h", "kannada": "k", "digits": "d"}


def _signs(c: Column) -> Column:
    """``c`` without latin, which is most of a text, with a blank for white space and the sign of its script for any other character that has one."""
    members = {k: "".join(chr(i) for a, b in zip(v[::3], v[2::3]) for i in range(ord(a), ord(b) + 1)) for k, v in _SCRIPTS.items()}
    by = "".join(s * len(members[k]) for k, s in _SIGNS.items()) + " " * len(_SPACES)
    return F.translate(c, "".join(members[k] for k in _SIGNS) + _SPACES + members["latin"], by)


Counts = dict[str, Column]


def _counted(c: Column, signs: Column) -> Counts:
    held = {k: F.length(signs) - F.length(F.replace(signs, F.lit(s), F.lit(""))) for k, s in _SIGNS.items()}
    seen = F.replace(signs, F.lit(" "), F.lit(""))
    return {"latin": F.length(c) - F.length(signs)} | held | {"other": F.length(seen) - F.length(F.regexp_replace(seen, "[^A-Za-z]+", ""))}


def script_counts(c: Column) -> Counts:
    """Characters of each script; white space counts nowhere, accented letters are other."""
    c = F.coalesce(c, F.lit(""))
    return _counted(c, _signs(c))


def once(df: DataFrame, c: Column, name: str) -> DataFrame:
    """``df`` with ``c`` in a column ``name`` that is generated: a plain one is copied into each
    expression and each pushed filter that reads it, and every copy would work it out again."""
    return df.select("*", F.explode(F.array(c)).alias(name))


def with_script_counts(df: DataFrame, c: Column, name: str = "_n") -> tuple[DataFrame, Counts]:
    """``df`` with the counts of ``c`` in a column ``name``, worked out once, and those counts as columns."""
    c = F.coalesce(c, F.lit(""))
    signs = f"{name}_signs"
    counts = _counted(c, F.col(signs))
    counted = once(once(df, _signs(c), signs), F.struct(*[v.alias(k) for k, v in counts.items()]), name)
    return counted.drop(signs), {k: F.col(name)[k] for k in counts}


def dominant_script(c: Column, counts: Counts | None = None) -> Column:
    """The script with most characters; ``counts`` are those of ``c`` where they are known."""
    n = counts or script_counts(c)
    top = F.greatest(n["latin"], n["hindi"], n["kannada"])
    return (
        F.when(top == 0, F.when(n["digits"] > 0, "latin").otherwise("unknown"))
        .when(n["latin"] == top, "latin")
        .when(n["hindi"] == top, "hindi")
        .otherwise("kannada")
    )


def script_characters(c: Column, language: Column, counts: Counts | None = None) -> Column:
    n = counts or script_counts(c)
    return F.when(language == "hindi", n["hindi"]).when(language == "kannada", n["kannada"]).otherwise(n["latin"] + n["digits"])


def script_purity(c: Column, language: Column, counts: Counts | None = None) -> Column:
    n = counts or script_counts(c)
    return F.coalesce(F.try_divide(script_characters(c, language, n), sum(n.values(), F.lit(0))), F.lit(0.0))


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def file_stem(name: Column) -> Column:
    """A name fit for files: other characters than A-Z a-z 0-9 _ . - become _."""
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"[^A-Za-z0-9_.\-]", "_")


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    return F.coalesce(F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p)), F.lit(False))
