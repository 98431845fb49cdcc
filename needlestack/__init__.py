"""Rare-class classification over large tables, written as Spark jobs."""
