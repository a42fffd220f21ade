"""How much state a fit and a model hold, whatever the number of rows."""

from __future__ import annotations

from ..schema import MAX_TERMS

DOUBLE = 8


def fit_bytes(p: int) -> int:
    """State of one group of p terms in a fit with diagnostics: p squared plus 19 p plus 29 doubles, and 216 bytes that don't depend on p."""
    return DOUBLE * (p * p + 19 * p + 29) + 216


def model_bytes() -> int:
    """A loaded model's group: intercept, trim addition and room for all terms there may be."""
    return DOUBLE * (MAX_TERMS + 2)


def buffer_bytes(p: int, solver: str = "normal") -> int:
    """What this engine's own state of a group takes between tasks: means, co-moments, least and greatest values, and the factor with its norms."""
    w = p + 1
    return DOUBLE * (3 * w + w * w + 4 + (w + (w + 1) ** 2 if solver == "qr" else 0))


def footprint(p: int, groups: int = 1) -> dict[str, int]:
    return {"terms": p, "groups": groups, "fit_bytes": fit_bytes(p) * groups, "model_bytes": model_bytes() * groups, "buffer_bytes": buffer_bytes(p) * groups}
