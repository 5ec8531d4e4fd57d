"""Queries by name; importing this package registers all of them."""

from . import case_queries, flagship, host_queries, mail_queries, policy_queries, state_queries, text_queries, url_queries  # noqa: F401
