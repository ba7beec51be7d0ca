"""Relational operators over lines, items, timelines, ranges, profiles and snapshots."""
