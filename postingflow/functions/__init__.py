"""Column-level building blocks: regex dialect, salary, text, scoring, HTML."""
