"""Fact store, graph patterns, closures and rule materialisation."""
