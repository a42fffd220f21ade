"""Comma-separated text with refusals instead of guesses."""
