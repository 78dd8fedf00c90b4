"""Explicit schemas of every table; nothing is inferred from data."""

from __future__ import annotations

PAGES = "page_id bigint, url string, html string"
EVENTS = (
    "event_id bigint, ts timestamp, user_id bigint, event_type string, "
    "value double, props string"
)
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"

SOURCES = (
    "source_id string, name string, url string, type string, parser string, "
    "enabled boolean, priority int, tags array<string>, rpm int, respect_robots boolean, "
    "selectors map<string,string>, mappings map<string,string>, headers map<string,string>, "
    "pagination struct<enabled:boolean,start_page:int,max_pages:int,param_name:string>, "
    "sitemap struct<enabled:boolean,process_all:boolean,max_urls:int,pattern:string>, "
    "schedule string, timeout_ms bigint, metadata map<string,string>, pos bigint"
)

FETCHES = (
    "page_id bigint, source_id string, url string, status int, content_type string, "
    "headers map<string,array<string>>, body string, submitted_at timestamp, "
    "fetched_at timestamp, error string"
)

# The item fields that have a column of their own; other mapped keys go to `extra`.
ITEM_FIELDS = ("title", "content", "url", "date", "author", "category")

ITEM = ", ".join(f"{f}: string" for f in ITEM_FIELDS) + ", extra: map<string,string>"

PARSERS = ("html", "json", "xml", "rss")

RESULT_TYPES = ("article", "news", "blog_post", "product", "event", "media", "other")
