"""Fixed values. They decide results and therefore must equal the published behaviour."""

# Link filter: suffixes of static assets, then terms that mark utility, ad and video pages.
ASSET_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".css", ".js", ".pdf", ".zip", ".mp4")
UTILITY_TERMS = (
    "login", "register", "signin", "signup", "contact", "cart", "checkout", "account", "#",
    "javascript:", "/ads/", "/redirect/", "/banner/", "/click/", "youtube.com", "youtu.be",
    "vimeo.com", "dailymotion.com",
)

# Link classes.
INDEX_KEYWORDS = ("blog", "news", "article", "post", "story", "feed", "tag", "category", "archive")
YEAR_IN_PATH = r"/20[0-9]{2}/"
MONTH_IN_PATH = r"/(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)/"
ID_AT_END = r"[-/]\d{4,}(\.html)?$"

# Sitemap scores.
NEWS_SITEMAP_TERMS = ("sitemap-news", "news-sitemap")
PRIORITY_TERMS = ("news", "en-us", "uk", "world", "front-page", "top")
SKIP_TERMS = (
    "gahuza", "arabic", "hindi", "urdu", "pashto", "mundo", "brasil", "russian", "turkish",
    "vietnamese", "bengali", "tamil", "nepali", "zhongwen", "indonesia",
)
NEWS_SCORE, PRIORITY_SCORE, SKIP_SCORE, SITEMAP_CUT = 100, 10, -1000, -500
COMMON_SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-news.xml")

# Job types by url: marker, then (interval in seconds, label).
FEED_MARKERS = (".xml", ".rss", "/feed", "feeds.")
DATE_IN_URL = r"/\d{4}/\d{2}/"
ID_IN_URL = r"[-/]\d{6,}"
SOURCE_TYPES = {
    "rss": (600, "RSS Feed"),
    "single": (0, "Single Article"),
    "discovery": (3600, "Site Discovery"),
}

# Domains the first search provider leaves out.
EXCLUDED_SEARCH_DOMAINS = ("youtube.com", "facebook.com", "twitter.com", "tiktok.com")

# Text cuts, in characters.
SUMMARY_CHARS, ANALYSIS_CHARS, EMBEDDING_CHARS, DRAFT_CHARS, LOG_CHARS = 200, 3000, 2000, 5000, 500

# Adaptive interval.
HOT_URGENCY, HOT_INTERVAL = 8, 300
WARM_URGENCY, WARM_INTERVAL = 5, 1800
MIN_INTERVAL, SHRINK = 3600, 0.95
MAX_INTERVAL, GROW = 86400, 1.5

# Dashboard.
NEWEST, PRIORITY_URGENCY, PRIORITY_CARDS = 200, 7, 4

# Research.
AUDIT_HITS, WRITER_HITS, URLS_PER_QUERY, AUDIT_QUERIES = 5, 10, 3, 3
GAP_POLLS_PARTIAL, GAP_POLLS_MAX, GAP_POLL_SECONDS = 20, 40, 3
PROMOTED_INTERVAL, PROMOTED_ITEMS = 86400, 5
EMBEDDING_DIM = 768
BOT_AGENT = "MyBot/1.0"

# Texts stored or shown as they are.
NO_ANALYSIS = "AI returned no data"
NO_CONTEXT = "No info."
NO_TITLE = "No Title"
HUNTING, SYNTHESIZING = "Hunting for new data...", "Analyzing & Synthesizing..."
BLOCKED, FETCH_FAILED = "Blocked by robots.txt: ", "Network Error: "
PROMOTED_NAME = "Auto-Discovery: "
