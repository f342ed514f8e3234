"""Inputs: html, fetch logs, sitemaps, robots files."""
