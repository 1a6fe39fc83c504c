"""Landed shop feeds: layouts, flattening, quarantine."""
