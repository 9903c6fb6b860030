"""All registered queries of the library and their SQL."""

from __future__ import annotations

from formline.plans import audits, betting, datasets, features, history, tickets

QUERIES = features.QUERIES | betting.QUERIES | audits.QUERIES | tickets.QUERIES | history.QUERIES | datasets.QUERIES
ORACLE = features.ORACLE | betting.ORACLE | audits.ORACLE | tickets.ORACLE | history.ORACLE | datasets.ORACLE
