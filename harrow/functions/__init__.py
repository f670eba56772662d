"""Part of the crawl analytics package."""
