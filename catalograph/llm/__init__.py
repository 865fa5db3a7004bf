"""Training-data pipeline operators: mixing, secrets, media, dedup, licences, toxicity, tokens.

Nothing else in the library imports this subpackage.
"""
