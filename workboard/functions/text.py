"""Text rules of the reference's JavaScript layer, as native Column expressions.

JavaScript's ``String.prototype.trim`` strips more than Spark's ``trim`` (which
strips spaces only), so ``ws_trim`` uses an explicit character class that both
Java regex and RE2 (DuckDB) read the same way.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace set of ECMAScript trim() (WhiteSpace + LineTerminator).
JS_WHITESPACE_CLASS = (
    r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
# ``\z`` (absolute end), not ``$``: in Java ``$`` also matches before a final
# line terminator such as U+0085, which JavaScript does not treat as whitespace.
JS_TRIM_PATTERN = f"^{JS_WHITESPACE_CLASS}+|{JS_WHITESPACE_CLASS}+\\z"

# The canonical job roles, in the reference's order.
JOB_ROLES = [
    "Full Stack Developer",
    "Frontend Developer",
    "Backend Developer",
    "QA Engineer",
    "UI/UX Designer",
    "DevOps Engineer",
    "Product Manager",
    "Business Analyst",
    "Support Engineer",
    "Team Member",
]
# Fixed value: display text for a missing job role.
DEFAULT_JOB_ROLE = "Team Member"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ws_trim(c) -> Column:
    """JavaScript ``trim()``: strip leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(c), JS_TRIM_PATTERN, "")


def role_key(c) -> Column:
    """Lookup key of a job role: trim, lower-case, runs of non [a-z0-9] -> one space."""
    return F.regexp_replace(F.lower(ws_trim(c)), "[^a-z0-9]+", " ")


def _role_key_py(role: str) -> str:
    return re.sub("[^a-z0-9]+", " ", role.strip().lower())


JOB_ROLE_LOOKUP = {_role_key_py(r): r for r in JOB_ROLES}


def normalize_job_role(c) -> Column:
    """Canonical job role or NULL (H1). NULL input gives NULL."""
    lookup = F.create_map(*[F.lit(x) for kv in JOB_ROLE_LOOKUP.items() for x in kv])
    return F.try_element_at(lookup, role_key(c))


def normalize_email(c) -> Column:
    """lower + trim (H2)."""
    return ws_trim(F.lower(_c(c)))


def looks_like_email(c) -> Column:
    """A non-empty string containing '@' (H3); NULL -> false."""
    return F.coalesce(_c(c).contains("@"), F.lit(False))


def is_blank(c) -> Column:
    """Missing, or trims to '' (H4)."""
    return F.coalesce(ws_trim(c) == "", F.lit(True))


def trim_to_null(c) -> Column:
    """``x?.trim() || null`` (H5)."""
    return F.nullif(ws_trim(c), F.lit(""))


def display_job_role(c) -> Column:
    """``COALESCE(job_role, 'Team Member')`` (H6); '' stays ''."""
    return F.coalesce(_c(c), F.lit(DEFAULT_JOB_ROLE))


def or_text(c, text: str) -> Column:
    """JavaScript ``c || text``: NULL and '' both fall back."""
    return F.coalesce(F.nullif(_c(c), F.lit("")), F.lit(text))


def display_date(c, missing: str = "Not set", fmt: str = "dd MMM yyyy") -> Column:
    """Formatted date or a fallback text."""
    return F.coalesce(F.date_format(_c(c), fmt), F.lit(missing))
