"""Source registry, crawl planning and recorded fetches."""
