"""Fixed values of the curation domain: states, transitions, categories, word lists and limits.

These must equal what the curated feeds and their reviewers use, so they are stated plainly.
"""

from __future__ import annotations

# --- states and error stages -------------------------------------------------
STATUSES = (
    "DISCOVERED", "ANALYZING", "REJECTED", "APPROVED", "IMAGE_CREATED", "READY_FOR_REVIEW",
    "PUBLISHING", "POST_CREATED", "COMMENT_PENDING", "PUBLISHED", "FAILED",
)
STAGES = ("analyze", "image", "publish_photo", "publish_unknown", "publish_comment", "comment_unknown")

#: (from, to, stage that must have failed or None)
TRANSITIONS = (
    ("DISCOVERED", "ANALYZING", None), ("DISCOVERED", "REJECTED", None),
    ("ANALYZING", "APPROVED", None), ("ANALYZING", "REJECTED", None), ("ANALYZING", "FAILED", None), ("ANALYZING", "DISCOVERED", None),
    ("APPROVED", "IMAGE_CREATED", None), ("APPROVED", "FAILED", None),
    ("IMAGE_CREATED", "READY_FOR_REVIEW", None), ("IMAGE_CREATED", "FAILED", None),
    ("READY_FOR_REVIEW", "PUBLISHING", None),
    ("PUBLISHING", "POST_CREATED", None), ("PUBLISHING", "FAILED", None),
    ("POST_CREATED", "COMMENT_PENDING", None), ("POST_CREATED", "PUBLISHED", None),
    ("COMMENT_PENDING", "COMMENT_PENDING", None), ("COMMENT_PENDING", "PUBLISHED", None),
    ("FAILED", "ANALYZING", "analyze"), ("FAILED", "APPROVED", "image"), ("FAILED", "PUBLISHING", "publish_photo"),
)
OPERATOR_TRANSITIONS = (("FAILED", "POST_CREATED"), ("FAILED", "FAILED"))
RESETS_BUDGET = ("APPROVED", "READY_FOR_REVIEW", "POST_CREATED")
POSTED = ("POST_CREATED", "COMMENT_PENDING", "PUBLISHED")
NEEDS_CONTENT = ("APPROVED", "IMAGE_CREATED", "READY_FOR_REVIEW", "PUBLISHING", "POST_CREATED", "COMMENT_PENDING", "PUBLISHED")
NEEDS_IMAGE = ("IMAGE_CREATED", "READY_FOR_REVIEW", "PUBLISHING", "POST_CREATED", "COMMENT_PENDING", "PUBLISHED")

# --- categories ----------------------------------------------------------------
CATEGORY_ALIASES = {
    "TECHNOLOGY": (
        "TECH", "AI", "A I", "ARTIFICIAL INTELLIGENCE", "GENERATIVE AI", "MACHINE LEARNING", "CYBERSECURITY", "CYBER SECURITY",
        "SECURITY", "SOFTWARE", "SOFTWARE AND DEVELOPMENT", "SOFTWARE DEVELOPMENT", "HARDWARE", "HARDWARE AND GADGETS", "GADGETS",
        "TECH INDUSTRY", "EMERGING TECHNOLOGY", "CLOUD", "CLOUD AND INFRASTRUCTURE", "SCIENCE AND TECHNOLOGY",
    ),
    "BUSINESS": ("BUSINESS NEWS", "COMPANIES", "CORPORATE", "CORPORATES", "INDUSTRY", "TRADE"),
    "FINANCE": (
        "FINANCIAL", "MARKETS", "STOCKS", "ECONOMY", "ECONOMICS", "PERSONAL FINANCE", "INVESTING", "BANKING", "FINTECH", "CRYPTO",
        "CRYPTOCURRENCY", "MONEY",
    ),
    "CAREER DEVELOPMENT": (
        "CAREER DEV", "CAREERS", "CAREER", "JOBS", "WORK", "WORKPLACE", "EMPLOYMENT", "PROFESSIONAL DEVELOPMENT", "SKILLS",
    ),
    "ENTREPRENEURSHIP": (
        "ENTREPRENEURS", "ENTREPRENEURSHIP AND STARTUPS", "STARTUPS", "STARTUP", "STARTUPS AND FUNDING", "FUNDING", "VENTURE CAPITAL",
        "SMALL BUSINESS", "FOUNDERS",
    ),
}

# --- urls --------------------------------------------------------------------------
TRACKING_PARAMS = (
    "fbclid", "gclid", "dclid", "gbraid", "wbraid", "msclkid", "yclid", "igshid", "mc_cid", "mc_eid", "_hsenc", "_hsmi", "mkt_tok",
)
MAX_URL_CHARS = 2048

# --- texts ---------------------------------------------------------------------------
SUMMARY_CHARS, RAW_HTML_CHARS, TITLE_CHARS, FINGERPRINT_WORDS, GUID_CHARS = 1200, 20_000, 300, 6, 500
DROP_TAGS = ("script", "style", "noscript", "iframe", "template", "svg", "object", "embed", "form", "head")
TRAILING_BOILERPLATE = (
    r"(?is)\s*The post .{1,300}? appeared first on .{1,200}?\.?\s*$",
    r"(?i)\s*(continue reading|read more|read the full story)\s*(»|›|→|\.\.\.|…)?\s*$",
    r"\s*\[(…|\.\.\.)\]\s*$",
)
#: (pattern, replacement) in order
SECRET_PATTERNS = (
    (r"""(?i)\b(access_token|api_key|apikey|key|token|client_secret|password)("?'?\s*(?:=|:|%3D)\s*"?'?)([^&\s"',;}]+)""", r"\1\2[REDACTED]"),
    (r"(?i)\b(bearer|oauth)\s+[A-Za-z0-9._~+/=-]{8,}", r"\1 [REDACTED]"),
    (r"\bEAA[A-Za-z0-9]{20,}", "[REDACTED]"),
    (r"\bAIza[0-9A-Za-z_-]{30,}", "[REDACTED]"),
    (r"\bAQ\.[0-9A-Za-z_-]{30,}", "[REDACTED]"),
    (r"\bsk-[A-Za-z0-9_-]{20,}", "[REDACTED]"),
)

# --- answer rules ----------------------------------------------------------------------
HEADLINE_WORDS, HEADLINE_CHARS = (5, 18), 120
CAPTION_CHARS, CAPTION_HASHTAGS, REASON_CHARS = (60, 500), (2, 7), 300
LEAK = (
    r"(?i)(system prompt|system instruction|article_data|untrusted (content|data|article)|editorial policy|"
    r"ignore (all |any )?(previous|prior|above) instructions|as an ai (assistant|model|language model))"
)
REFUSAL = r"(?i)^\s*(i cannot|i can't|i'm sorry|i am sorry|sorry,|as an ai\b)"
ADVICE = (
    r"(?i)(\b(guaranteed (returns?|profits?|income|jobs?)|risk[- ]free (returns?|profits?|investments?)|"
    r"you should (buy|sell|invest)|get rich|can'?t lose|to the moon|double your money)\b"
    r"|(?:^|[.!?]\s+)(buy|sell) (now|today)\b)"
)
ANSWER_KEYS = ("is_relevant", "category", "catchy_headline", "facebook_caption", "original_url", "rejection_reason")

# --- publishing ----------------------------------------------------------------------------
COMMENT_PREFIX = "Read full story: "
RATE_LIMIT_CODES = (4, 17, 32, 613, 80001)
TRANSIENT_CODES = (1, 2)
AUTH_CODES = (102, 190)
PERMISSION_CODES = (10, *range(200, 300))

# --- card layout -----------------------------------------------------------------------------
CARD_WIDTH, HEADLINE_MARGIN, LINE_SPACING = 1200, 90, 1.16
HEADLINE_SIZES = (76, 50, 34)  # largest, smallest with three lines, smallest with four
BAD_BREAK_PENALTY, BAD_BREAK_SHRINK = 1200, 6
DANGLING = ("a", "an", "the", "to", "of", "and", "or", "for", "in", "on", "at", "by", "with", "as", "from", "into", "its")
MAGNITUDES = ("thousand", "million", "billion", "trillion", "percent")

SAME_STORY_DAYS, MAX_AGE_HOURS, LEASE_MINUTES, MAX_ERROR_CHARS = 7, 48, 30, 1000
