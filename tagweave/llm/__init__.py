"""Operators for preparing training text: scans, models, tokens and near duplicates."""
