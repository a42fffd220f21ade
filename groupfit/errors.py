"""One exception for every refusal; its code says which."""

from __future__ import annotations


class FitError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message


#: What a solve can fail with, and what to do about it.
SOLVE_FAILURES = {
    "COLUMN_OVERFLOW": "a column's sum of products is beyond a double; rescale that column, or use the QR solver",
    "RESPONSE_OVERFLOW": "the response's sum of squares is beyond a double; rescale the response",
    "NOT_FINITE": "a value or a coefficient is not a finite number",
}
