"""Readers: subtitles, reports, file catalogs, and frames derived from event tables."""
