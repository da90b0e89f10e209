"""Claimed crawlers and AI agents, by user agent; AI assistants, by traffic source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The registry in match order (id, display name, operator, behavior, pattern).
AGENTS = [
    ("openai-oai-searchbot", "OAI-SearchBot", "OpenAI", "search", "OAI-SearchBot"),
    ("openai-oai-adsbot", "OAI-AdsBot", "OpenAI", "ads", "OAI-AdsBot"),
    ("openai-chatgpt-user", "ChatGPT-User", "OpenAI", "agent", "ChatGPT-User"),
    ("openai-gptbot", "GPTBot", "OpenAI", "training", "GPTBot"),
    ("anthropic-claude-searchbot", "Claude-SearchBot", "Anthropic", "search", "Claude-SearchBot"),
    ("anthropic-claude-user", "Claude-User", "Anthropic", "agent", "Claude-User"),
    ("anthropic-claudebot", "ClaudeBot", "Anthropic", "training", "ClaudeBot"),
    ("perplexity-user", "Perplexity-User", "Perplexity", "agent", "Perplexity-User"),
    ("perplexity-bot", "PerplexityBot", "Perplexity", "search", "PerplexityBot"),
    ("google-googlebot", "Googlebot", "Google", "search", "Googlebot(?:-Image|-Video|-News)?"),
    ("microsoft-bingbot", "bingbot", "Microsoft", "search", "bingbot"),
]
# Domains of AI assistants.
AI_DOMAINS = [
    "chatgpt.com", "openai.com", "perplexity.ai", "claude.ai", "anthropic.com", "gemini.google.com", "bard.google.com",
    "copilot.microsoft.com", "you.com", "phind.com", "poe.com", "grok.com", "x.ai", "mistral.ai", "chat.deepseek.com", "meta.ai",
    "kimi.com", "qwen.ai",
]
# What a user agent alone supports.
CLAIMED_CONFIDENCE = 0.35

AGENT_TYPE = "struct<matched:boolean,agent_id:string,display_name:string,operator:string,behavior:string,verification:string,confidence:double>"


def classify_user_agent(user_agent: Column) -> Column:
    """The first agent whose pattern stands between characters outside [A-Za-z0-9_], as a struct."""
    which, lower = None, F.lower(user_agent)
    for i, agent in enumerate(AGENTS, 1):
        # most agents name none of these: a plain search comes before the pattern
        hit = F.contains(lower, F.lit(agent[1].lower())) & lower.rlike(f"(?<![a-z0-9_]){agent[4].lower()}(?![a-z0-9_])")
        which = F.when(hit, i) if which is None else which.when(hit, i)
    none = [False, None, None, None, "unknown", "unknown", 0.0]
    rows = [none, *([True, *agent[:4], "user_agent_only", CLAIMED_CONFIDENCE] for agent in AGENTS)]
    names = [f.split(":")[0] for f in AGENT_TYPE[7:-1].split(",")]
    known = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]).cast(AGENT_TYPE) for row in rows])
    return F.get(known, F.coalesce(which, F.lit(0)))


def is_ai_assistant(channel_group: Column, source: Column) -> Column:
    host = F.split(F.regexp_replace(F.trim(source), "(?i)^https?://", ""), "/")[0]
    domains = "|".join(d.replace(".", r"\.") for d in AI_DOMAINS)
    return F.coalesce((F.lower(F.trim(channel_group)) == "ai assistants") | host.rlike(rf"(?i)(^|\.)({domains})$"), F.lit(False))
