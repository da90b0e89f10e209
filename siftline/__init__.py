"""Web-traffic, search-performance and site-audit evidence as Spark DataFrames."""

from siftline.functions.agents import classify_user_agent, is_ai_assistant
from siftline.functions.periods import acquisition_periods, period_of
from siftline.functions.urls import document_url, is_public_address, normalize_url, page_key, property_covers
from siftline.operators import acquisition, changes, compare, coverage, crawl, html_facts, page_rules, priority, queue_state, search, traffic
from siftline.plans.capabilities import REGISTRY, Capability, CapabilityError, describe, listed_option
from siftline.sources import logs, reports, robots, runs, sitemaps
from siftline.streaming import logs as log_stream
from siftline.streaming import queue as queue_stream

__all__ = [
    "REGISTRY", "Capability", "CapabilityError", "acquisition", "acquisition_periods", "changes", "classify_user_agent", "compare", "coverage", "crawl", "describe", "document_url", "html_facts", "is_ai_assistant", "is_public_address",
    "listed_option", "log_stream", "logs", "normalize_url", "page_key", "page_rules", "period_of", "priority", "property_covers", "queue_state", "queue_stream", "reports", "robots", "runs", "search", "sitemaps", "traffic",
]
