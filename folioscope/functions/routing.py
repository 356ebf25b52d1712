"""Question routing, intents and expansion: expressions over the question's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lex
from .text import contains_any, strip


def intent(question: Column, pack: lex.DomainPack = lex.NO_PACK) -> Column:
    """header, abstract, body or general; the first list that matches wins."""
    q = F.lower(question)
    out = None
    for name, region, phrases in lex.INTENTS:
        found = contains_any(q, phrases + (pack.technical if name == "technical" else ()))
        out = F.when(found, region) if out is None else out.when(found, region)
    return out.otherwise("general")


def is_objective(question: Column) -> Column:
    return contains_any(F.lower(question), lex.OBJECTIVE_QUERY)


def is_table(question: Column) -> Column:
    return contains_any(F.lower(question), lex.TABLE_WORDS)


def is_visual(question: Column) -> Column:
    return contains_any(F.lower(question), lex.VISUAL_WORDS)


def is_fusion(question: Column) -> Column:
    return contains_any(F.lower(question), lex.FUSION_WORDS)


def is_comparison(question: Column) -> Column:
    return contains_any(strip(F.lower(question)), lex.COMPARISON_PHRASES)


def route(question: Column) -> Column:
    """comparison, fusion, table, visual or text, in this order of precedence."""
    return (
        F.when(is_comparison(question), "comparison").when(is_fusion(question), "fusion").when(is_table(question), "table").when(is_visual(question), "visual").otherwise("text")
    )


def expand(question: Column, pack: lex.DomainPack = lex.NO_PACK) -> Column:
    """The question with the pack's phrases appended, in the pack's order."""
    q, parts = F.lower(question), [F.coalesce(question, F.lit(""))]
    for triggers, phrase in pack.expansions:
        on = is_objective(question) if triggers is None else contains_any(q, triggers)
        parts.append(F.when(on, phrase).otherwise(""))
    return F.concat(*parts)


# How a question names a page or a table, here and below.
def requested_page(question: Column) -> Column:
    found = [F.nullif(F.regexp_extract(question, p, 1), F.lit("")) for p in (r"(?i)\bpage\s*(\d+)\b", r"(?i)\bp\.\s*(\d+)\b", r"(?i)\bpg\.?\s*(\d+)\b")]
    return F.coalesce(*found).try_cast("int")


def table_number(question: Column) -> Column:
    found = [F.nullif(F.regexp_extract(question, p, 1), F.lit("")) for p in (r"(?i)\btable\s*([IVXLCDM]+)\b", r"(?i)\btable\s*(\d+)\b")]
    return F.upper(F.coalesce(*found))


def region_adjustment(region: Column, wanted: Column) -> Column:
    """What the intent ``wanted`` adds to a chunk of that region."""
    out = None
    for (i, r), value in lex.REGION_ADJUSTMENT.items():
        fits = (wanted == i) & (region == r)
        out = F.when(fits, F.lit(value)) if out is None else out.when(fits, F.lit(value))
    return out.otherwise(0.0)


def objective_of(text: Column, pack: lex.DomainPack = lex.NO_PACK) -> Column:
    """How much a text speaks of its purpose."""
    t = F.lower(F.coalesce(text, F.lit("")))
    terms = lex.OBJECTIVE_TERMS + pack.objective_terms
    hits = F.size(F.filter(F.array(*map(F.lit, terms)), lambda p: F.contains(t, p)))
    every = F.forall(F.array(*map(F.lit, lex.OBJECTIVE_TRIPLE)), lambda p: F.contains(t, p))
    return hits * 0.05 + F.when(contains_any(t, lex.OBJECTIVE_PHRASES), 0.25).otherwise(0.0) + F.when(every, 0.20).otherwise(0.0)


def objective_score(question: Column, text: Column, pack: lex.DomainPack = lex.NO_PACK) -> Column:
    return F.when(is_objective(question), objective_of(text, pack)).otherwise(0.0)
