"""Reading log files as tables of lines, and storing items and extracts."""
