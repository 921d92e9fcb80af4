"""Which of several settings holds."""

from __future__ import annotations


def first_given(*values: str | None) -> str | None:
    """The first value that is given and not blank: argument, source, config, environment."""
    return next((v for v in values if v and v.strip()), None)
