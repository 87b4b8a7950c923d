"""All queries of the library's own operators by name, and the SQL that an oracle runs for them."""

from __future__ import annotations

from tarnwick.plans import digests, facets, guards, inbox, matching, phrases, postings, posts, purges, reports, rules, structured, texts


def queries() -> dict:
    return reports.QUERIES | texts.QUERIES | postings.QUERIES | matching.QUERIES | rules.QUERIES | posts.QUERIES | guards.QUERIES | inbox.QUERIES | structured.QUERIES | facets.QUERIES | digests.QUERIES | purges.QUERIES | phrases.QUERIES


def oracle_sql() -> dict[str, str]:
    return reports.SQL | texts.SQL | postings.SQL | matching.SQL | rules.SQL | posts.SQL | guards.SQL | inbox.SQL | structured.SQL | facets.SQL | digests.SQL | purges.SQL | phrases.SQL
