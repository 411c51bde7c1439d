"""Word lists, lookup tables and patterns used by the extraction functions.

Fixed values: they decide results, so they equal the published lists entry by entry.
Every function that uses one takes it as a parameter and has it as the default.
"""

# Fixed values -----------------------------------------------------------------

TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "utm_id",
    "ref", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid",
]

HOST_PREFIXES = [
    "www.", "mail.", "app.", "jobs.", "careers.", "blog.", "shop.", "help.",
    "support.", "api.",
]

JUNK_HOSTS = ["youtube.com"]

SKIP_DOMAINS = [
    "youtube.com", "twitter.com", "x.com", "facebook.com", "instagram.com",
    "tiktok.com", "reddit.com", "wikipedia.org", "linkedin.com",
]

PREFER_DOMAINS = [
    "crunchbase.com", "glassdoor.com", "builtwith.com", "stackshare.io", "techcrunch.com",
]

SIGNAL_PATHS = ["/", "/about", "/careers", "/technology"]

FUNDING_KEYWORDS = [
    "series a", "series b", "series c", "seed round", "funding round", "raised $",
    "raised funding", "venture capital", "vc backed", "investors led", "pre-ipo",
]

OUTSOURCING_KEYWORDS = [
    "staff augmentation", "dedicated team", "outsource", "outsourcing", "managed services",
    "contract developers", "vendor", "offshore", "nearshore", "third-party",
    "agency partner", "software partner", "external team",
]

HIRING_KEYWORDS = [
    "software engineer", "backend engineer", "frontend engineer", "full stack",
    "devops engineer", "platform engineer", "sre", "data engineer", "ml engineer",
    "mobile engineer", "cloud architect", "solutions architect", "engineering manager",
    "cto", "vp engineering", "head of engineering", "chief technology officer",
]

BUSINESS_EVENT_KEYWORDS = [
    "digital transformation", "modernization", "cloud migration", "new product", "launched",
    "expansion", "new office", "acquired", "merger", "acquisition", "partnership",
]

# company size class -> words on a page that point to it
SIZE_WORDS = {
    "startup": ["startup", "founded", "early stage", "seed"],
    "mid_market": ["mid-size", "scale-up", "100 employees", "500 employees", "series"],
    "enterprise": ["enterprise", "fortune", "10,000 employees", "global company"],
}

TECH_KEYWORDS = [
    "kubernetes", "k8s", "docker", "terraform", "ansible", "aws", "gcp", "azure",
    "cloudflare", "digitalocean", "heroku",
    "python", "golang", "go", "rust", "java", "node.js", "nodejs", "ruby on rails", "rails",
    "django", "fastapi", "flask", "spring", ".net", "c#", "php", "scala", "kotlin",
    "react", "vue", "angular", "next.js", "nextjs", "nuxt", "typescript", "graphql",
    "tailwind",
    "postgresql", "mysql", "mongodb", "redis", "elasticsearch", "snowflake", "databricks",
    "airflow", "spark", "kafka", "dbt", "bigquery", "redshift",
    "pytorch", "tensorflow", "openai", "langchain", "llm", "machine learning", "mlops",
    "hugging face",
    "github actions", "gitlab", "jenkins", "argocd", "helm", "prometheus", "grafana",
    "datadog", "sentry", "pagerduty",
    "react native", "flutter", "swift", "android", "ios",
]

DISPOSABLE_EMAIL_HOSTS = [
    "mailinator.com", "guerrillamail.com", "10minutemail.com", "throwam.com",
    "trashmail.com", "yopmail.com", "temp-mail.org", "sharklasers.com",
    "guerrillamailblock.com", "grr.la", "spam4.me", "maildrop.cc", "dispostable.com",
]

EMAIL_PATTERN = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE_PATTERN = r"(?:\+?\d{1,3}[\s\-])?(?:\(?\d{2,4}\)?[\s\-])?\d{3,4}[\s\-]\d{3,4}"

# matched against the part after the @
JUNK_EMAIL_HOST_PATTERNS = [
    r"\.(png|jpg|gif|css|js|svg|ico)$",
    r"example\.(com|org|net)$",
    r"@sentry\.io$",
    r"@.*\.(woff|ttf|eot)$",
]

SOCIAL_PATTERNS = {
    "linkedin": r"linkedin\.com/(?:company|in)/[^\"'\s>]+",
    "github": r"github\.com/[^\"'\s>]+",
    "twitter": r"(?:twitter|x)\.com/[^\"'\s>]+",
    "crunchbase": r"crunchbase\.com/organization/[^\"'\s>]+",
    "angellist": r"angel\.co/company/[^\"'\s>]+",
}

TITLE_SEPARATORS = [" | ", " - ", " – ", " — ", " :: "]

MAX_QUERY_CHARS = 2000

INJECTION_PATTERNS = [
    r"ignore\s+(?:all\s+)?(?:previous|above)\s+instructions",
    r"forget\s+everything",
    r"you\s+are\s+now\s+",
    r"<script[\s>]",
    r"<!--",
    r"\bdrop\s+table\b",
    r"\bdelete\s+from\b",
    r"\binsert\s+into\b",
    r"\bexec\s*\(",
]

BLOCKED_STATUS_CODES = [403, 407, 429, 503]
BLOCKED_ERROR_HINTS = [
    "proxyerror", "407", "proxy", "tunnel", "captcha", "blocked", "banned",
    "access denied", "cloudflare",
]

QUERY_LOCATIONS = [
    "us", "usa", "united states", "uk", "united kingdom", "india", "europe", "canada",
    "australia", "germany", "france", "singapore", "uae", "middle east", "latam",
]

QUERY_TECH = [
    "kubernetes", "k8s", "docker", "terraform", "aws", "gcp", "azure", "react", "vue",
    "angular", "next.js", "nextjs", "python", "golang", "go", "rust", "java", "node.js",
    "nodejs", "fastapi", "django", "flask", "rails", "spring", "postgresql", "mysql",
    "mongodb", "redis", "kafka", "elasticsearch", "snowflake", "databricks", "airflow",
    "spark", "dbt", "pytorch", "tensorflow", "openai", "langchain", "llm", "typescript",
    "graphql", "tailwind", "flutter", "react native",
]

QUERY_TITLES = [
    "cto", "vp engineering", "vp of engineering", "head of engineering",
    "chief technology officer", "cpo", "coo", "ciso", "engineering manager",
    "director of engineering", "head of product", "vp product",
]

QUERY_SIZE_WORDS = {
    "startup": ["startup", "seed", "early stage", "series a"],
    "mid_market": [
        "mid-market", "scale-up", "series b", "series c", "100 employees", "500 employees",
        "50-500",
    ],
    "enterprise": [
        "enterprise", "fortune 500", "large company", "10000 employees", "publicly traded",
    ],
}

QUERY_INDUSTRIES = [
    "saas", "fintech", "healthtech", "edtech", "proptech", "insurtech", "martech",
    "ecommerce", "logistics", "supply chain", "hr tech", "legaltech", "cybersecurity",
    "gaming", "media", "retail", "healthcare", "finance", "banking", "real estate",
    "manufacturing",
]

QUERY_STOP_WORDS = [
    "find", "the", "and", "for", "with", "that", "are", "in", "of", "a", "an",
]

# planner texts
PLAN_SIZE_TERMS = {
    "startup": "startup",
    "mid_market": "mid-size company 100-1000 employees",
    "enterprise": "enterprise large company",
}
PLAN_EVENT_TEMPLATES = {
    "funding": "{industry} startup funding Series",
    "merger": "{industry} company merger acquisition",
    "expansion": "{industry} company expansion {location}",
    "new_office": "{industry} company new office {location}",
    "new_product": "{industry} company new product launch",
    "digital_transformation": "digital transformation {industry} {location}",
}
PLAN_OTHER_EVENT_TEMPLATE = "{industry} company {event}"
STACK_DOMAINS = ["stackshare.io", "builtwith.com"]
JOB_BOARD_DOMAINS = ["lever.co", "greenhouse.io", "jobs.ashbyhq.com", "jobs.workable.com"]

SPEAKERS = {"user": "Human", "assistant": "Assistant", "system": "System"}

TIER_HOT = 0.65
TIER_WARM = 0.35
MIN_LEAD_SCORE = 0.15

# what of a page is kept as tokens: tags and their attributes
HTML_ENCLOSING_TAGS = ("title", "script", "style")
HTML_SCRIPT_TAGS = ("script", "style")
HTML_TOKEN_ATTRIBUTES = {
    "title": (),
    "script": ("type",),
    "style": ("type",),
    "meta": ("name", "property", "content"),
    "link": ("rel", "href"),
    "a": ("href",),
}
UNFOLLOWED_LINKS = ("#", "javascript:", "mailto:", "tel:")
JSON_LD_TYPE = "application/ld+json"
