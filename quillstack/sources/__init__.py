"""Readers and writers: pages, sitemaps, feeds, robots files, archives, Markdown."""
