"""Fixtures that several test modules share."""

from test_audit import EVENTS, ROWS, fold  # noqa: F401
from test_ledger import random_commands, replay  # noqa: F401
