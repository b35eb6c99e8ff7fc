"""Whole plans: registered queries, image conversion, contact sheets."""
