"""Operators for preparing training data: tokens, licences, secrets, quality, near copies, packing, search, mixing, scoring, personal data."""
