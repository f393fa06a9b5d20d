"""Readers: URL lists, sitemaps, downloads, HTML node tables."""
