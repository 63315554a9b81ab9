"""Relational operators over link graphs, titles, postings, sections and documents."""
