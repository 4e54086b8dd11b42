"""Fact extraction from tables of files, line by line."""
