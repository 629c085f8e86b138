"""Operators of a training-data pipeline: mixing, licences, deduplication, extraction, filters, tokens, media and chat.

Each module holds one operator with its own general interface; ``queries`` holds the thin ``opN_<name>`` queries over the
supplied tables and ``oracles`` their SQL. Nothing outside this subpackage imports it.
"""
