"""Column expressions: date-time parsing, text helpers, encodings, path patterns."""
