"""Word lists of routing and ranking.

Phrases that only make sense for one subject are no part of it: they form a
``DomainPack``, which callers pass; without one there are none.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Lower-case phrases, matched as substrings.
INTENTS = (
    ("author", "header", ("author", "authors", "who wrote", "researcher", "researchers", "written by")),
    ("metadata", "header", ("title", "paper title", "department", "affiliation", "email")),
    ("abstract", "abstract", ("abstract", "summary", "main objective", "objective", "purpose", "aim", "goal", "what is the paper about")),
    ("technical", "body", ("architecture", "method", "methodology", "implementation", "experiment", "experimental", "model", "algorithm", "classification", "prediction", "result", "results", "performance", "dataset", "sensor", "sensors", "system", "how does", "which model", "why", "score", "accuracy", "cross-validation", "cross validation")),
)
OBJECTIVE_QUERY = ("main objective", "objective", "purpose", "aim", "goal", "what does the system", "why was the system developed", "why was the system proposed", "what is the purpose")
OBJECTIVE_TERMS = ("objective", "purpose", "aim", "goal", "integrat", "framework", "monitoring", "prediction")
OBJECTIVE_PHRASES = ("this paper proposes", "this paper presents", "the main objective", "objective of", "aims to", "aim of")
OBJECTIVE_TRIPLE = ("integrat", "monitor", "predict")
TABLE_WORDS = ("table", "tables", "tabular", "row", "rows", "column", "columns", "precision", "recall", "f1-score", "f1 score", "confusion matrix", "confusion matrices")
VISUAL_WORDS = ("image", "images", "picture", "pictures", "photo", "photos", "figure", "figures", "diagram", "diagrams", "chart", "charts", "graph", "graphs", "visual", "shown", "shows", "visible", "look", "see", "handwritten", "illustration")
FUSION_WORDS = (
    "compare", "comparison", "compared", "best", "better", "worst", "performance", "perform", "why", "how", "explain", "according to the document", "according to document", "discuss", "relate", "relationship", "difference", "differences",
    "which model", "which models", "what does this mean", "what does it show", "what does the table show", "how does", "impact", "result", "results", "even though", "despite", "selected", "selection", "deployment", "deploy",
    "cross-validation", "cross validation", "independent test", "test set", "accuracy", "macro f1", "macro f1-score",
)
COMPARISON_PHRASES = (
    "compare the documents", "compare these documents", "compare the two documents", "compare documents", "what documents are available", "which documents are available", "what is each document about", "what are the documents about",
    "what is each pdf about", "what are the pdfs about", "compare the pdfs", "compare the two pdfs", "compare these files", "difference between the documents", "differences between the documents", "difference between the two documents", "differences between the two documents",
)
#: (intent, region) -> adjustment; other pairs 0.
REGION_ADJUSTMENT = {
    ("header", "header"): 0.08, ("header", "abstract"): -0.02, ("header", "body"): -0.03,
    ("abstract", "abstract"): 0.04, ("abstract", "body"): 0.01, ("abstract", "header"): -0.08,
    ("body", "body"): 0.03, ("body", "abstract"): 0.01, ("body", "header"): -0.08,
    ("general", "header"): -0.05, ("general", "abstract"): 0.01, ("general", "body"): 0.02,
}


@dataclass(frozen=True)
class DomainPack:
    """Phrases of one subject: more technical intents and objective terms, and
    expansions (triggers, or None for objective questions; what is appended)."""

    technical: tuple[str, ...] = ()
    objective_terms: tuple[str, ...] = ()
    expansions: tuple[tuple[tuple[str, ...] | None, str], ...] = field(default_factory=tuple)


#: No subject of its own; packs are opt-in.
NO_PACK = DomainPack()
