"""DataFrame operators: table maintenance, categories, matching, catalogue and deals."""
