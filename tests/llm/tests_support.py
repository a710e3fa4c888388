"""Brute-force versions that several tests share."""

from test_linededup import by_sql as line_sql  # noqa: F401
from test_neardup import brute as near_duplicate_rows  # noqa: F401
