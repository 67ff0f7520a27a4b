"""Keyword and structure coverage of a prediction against its reference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions.overlap import ratio_or_zero

# The keyword lists and patterns scores are defined by.
CRM_KEYWORDS = {
    "customer_service": "apologize sorry understand help assist resolve".split(),
    "sales": "value benefit offer discount price cost investment".split(),
    "support": "technical issue problem solution fix troubleshoot".split(),
    "retention": "keep stay continue loyalty relationship satisfaction".split(),
}
ANALYSIS_WORDS = (
    "because therefore however although consider analyze recommend suggest approach strategy "
    "solution trade-off advantage disadvantage benefit risk factor aspect"
).split()
STRUCTURE_PATTERNS = [
    r"\p{Nd}+\)",
    r"\p{Nd}+\.",
    r"[•\-\*]",
    r"first|second|third|finally",
]


def _keyword_hits(lowered: str, keywords: list[str]) -> str:
    """How many of the keywords occur anywhere in the text."""
    return " + ".join(f"CAST(contains({lowered}, '{word}') AS INT)" for word in keywords)


def _structure_hits(lowered: str) -> str:
    return " + ".join(f"CAST({lowered} RLIKE r'{p}' AS INT)" for p in STRUCTURE_PATTERNS)


def covered(predicted: str, expected: str) -> str:
    """Share of the reference's hits that the prediction has, cut at 1; NULL stays NULL."""
    ratio = ratio_or_zero(predicted, expected)
    return f"CASE WHEN {predicted} > {expected} AND {expected} > 0 THEN 1D ELSE {ratio} END"


def _lower(text: str, lowered: bool) -> str:
    return text if lowered else f"lower({text})"


def crm_hits(text: str, lowered: bool = False) -> Column:
    """Keywords of each family found in raw text, or in its lower case. The families share no keyword."""
    fields = (f"{_keyword_hits('t', ws)} AS {name}" for name, ws in CRM_KEYWORDS.items())
    return F.expr(f"transform(array({_lower(text, lowered)}), t -> struct({', '.join(fields)}))[0]")


def crm_coverage(predicted: str, expected: str) -> dict[str, Column]:
    """Coverage per keyword family and over all, from :func:`crm_hits` of both texts."""
    scores = {
        f"{family}_coverage": F.expr(covered(f"{predicted}.{family}", f"{expected}.{family}"))
        for family in CRM_KEYWORDS
    }
    totals = (
        "(" + " + ".join(f"{side}.{family}" for family in CRM_KEYWORDS) + ")"
        for side in (predicted, expected)
    )
    scores["overall_keyword_coverage"] = F.expr(covered(*totals))
    return scores


def worf_hits(text: str, lowered: bool = False) -> Column:
    """Reasoning words and kinds of list structure found in raw text, or in its lower case."""
    return F.expr(
        f"transform(array({_lower(text, lowered)}), t -> struct("
        f"{_keyword_hits('t', ANALYSIS_WORDS)} AS analytical, "
        f"{_structure_hits('t')} AS structure))[0]"
    )


def worf_coverage(predicted: str, expected: str) -> dict[str, Column]:
    """Coverage of reasoning words and of structure, and their mean, from :func:`worf_hits`."""
    analytical, structure = (
        covered(f"{predicted}.{kind}", f"{expected}.{kind}") for kind in ("analytical", "structure")
    )
    return {
        "analytical_coverage": F.expr(analytical),
        "structure_coverage": F.expr(structure),
        "reasoning_depth": F.expr(f"(({analytical}) + ({structure})) / 2"),
    }
