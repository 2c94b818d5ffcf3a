"""Operators of a training-data pipeline; nothing else in the package imports them."""

from postledger.shared import ship_with_tasks

# Python tasks of these modules travel with the job, so executors need no install.
ship_with_tasks(__name__)
