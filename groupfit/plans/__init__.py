"""What a fit reports, writes and costs."""
