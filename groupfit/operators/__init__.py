"""Fits, residuals, diagnostics and scores as DataFrame operations."""
