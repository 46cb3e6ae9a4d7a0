"""Reading preference tables and run artifacts, writing results."""
