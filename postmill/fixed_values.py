"""Values that results depend on literally: patterns, word lists, limits, labels."""

# --- fixed values: markup -------------------------------------------------
BLOCK_TAG = r"(?i)</?(?:br|p|div|li|ul|ol|tr|td|th|h[1-6]|section|article|header|footer)[^>]*>"
ANY_TAG = r"<[^>]+>"
ANCHOR = r"""(?is)<a\b[^>]*?href=["'](.*?)["'][^>]*>(.*?)</a>"""
PAGE_TITLE = r"(?is)<title[^>]*>(.*?)</title>"
JSON_LD_SCRIPT = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
PUBLIC_JOB_MARKUP = r'(?is)class="show-more-less-html__markup[^"]*"[^>]*>(.*?)</div>'
BOILERPLATE_LINES = ("cookie", "privacy policy", "terms of service", "sign in", "log in")
FALLBACK_LINE_LIMIT = 250
PREVIEW_CHARS = 1200
POST_BODY_CHARS = 20000

# --- fixed values: urls ---------------------------------------------------
REDIRECT_KEYS = ("url", "u", "dest", "destination", "redirect", "redir", "redirect_url")
DEAD_SCHEMES = ("mailto:", "javascript:", "#")

# --- fixed values: geography ----------------------------------------------
US_TOKEN = r"\b(?:united\s+states|u\.?s\.?a\.?|us)\b"
VAGUE_LOCATION = r"^(?:united\s+states|usa?|n/?a|\d+\s+locations?)$"

# --- fixed values: title matching -----------------------------------------
GENERIC_ROLE_TOKENS = (
    "engineer", "engineering", "manager", "lead", "staff", "principal", "senior",
    "sr", "ii", "iii", "iv", "technical",
)
MATCH_GATE = 8
MIN_DESCRIPTION_CHARS = 200

# --- fixed values: candidate scoring --------------------------------------
BAD_RESULT_HOSTS = (
    "youtube.com", "www.youtube.com", "facebook.com", "www.facebook.com",
    "instagram.com", "www.instagram.com", "reddit.com", "www.reddit.com",
    "zhihu.com", "www.zhihu.com", "finance.yahoo.com",
)
SEARCH_ENGINE_HOSTS = ("bing.com", "www.bing.com")
BAD_PAGE_HINTS = ("/docs/", "/documentation/", "/blog/", "/news/", "/article", "learn.microsoft.com")
BAD_TITLE_HINTS = ("documentation", "docs", "news", "blog", "article")
JOB_HOST_HINTS = (
    "greenhouse", "lever", "ashby", "smartrecruiters", "myworkdayjobs", "workday",
    "icims", "jobvite", "careers", "jobs",
)
JOB_TEXT_HINTS = (
    "responsibilities", "requirements", "qualifications", "preferred qualifications",
    "minimum qualifications", "what you will do", "what you'll do", "about the role",
    "about the team", "benefits", "compensation", "salary range", "job description",
)
DEFAULT_SEARCH_DOMAINS = (
    "greenhouse.io", "lever.co", "ashbyhq.com", "myworkdayjobs.com", "smartrecruiters.com",
)
MIN_SEARCH_SCORE = 6
MAX_SEARCH_CANDIDATES = 8
MAX_SEARCH_QUERIES = 10
MAX_COMPANY_ALIASES = 4
COMPANY_SUFFIX = (
    r"\b(?:inc|inc\.|llc|l\.l\.c\.|corp|corporation|co|company|ltd|limited|group|"
    r"holdings?|technologies|technology)\b"
)

# --- fixed values: statuses -----------------------------------------------
RESOLVED_STATUSES = ("resolved", "linkedin_public", "ats_api", "user_supplied")
RESOLVED_STATUSES_ENRICH = ("resolved", "linkedin_public")
RESOLVED_STATUSES_REPORT = ("resolved", "linkedin_public", "ats_api")

# --- fixed values: alert mails --------------------------------------------
GENERIC_LINK_TEXT = (
    "apply", "apply now", "view job", "view jobs", "see jobs", "see all jobs",
    "linkedin", "learn more", "read more", "details", "open", "view",
    "manage recommendations", "remote jobs", "view all jobs", "gen ai jobs",
)
ROLE_TOKENS = (
    "engineer", "engineering", "developer", "developers", "manager", "lead", "leader",
    "architect", "director", "scientist", "analyst", "designer", "consultant",
    "technician", "officer", "president", "vp", "administrator", "specialist",
    "strategist", "researcher", "programmer", "head", "chief", "founder", "apprentice",
    "intern", "representative", "coordinator", "advisor", "partner", "advocate",
    "associate", "owner",
)
BUTTON_SUFFIX = r"(?i)\s*(easy apply|apply now|apply|view job|view jobs|view|save|promoted|see more)\s*$"
SALARY_SUFFIX = (
    r"(?i)\s*\$[\d.,KkMm]+\s*[-–—]\s*\$[\d.,KkMm]*(?:\s*/\s*(?:yr|hr|year|hour))?[\s.]*$"
)
SALARY_TAIL = r"\s*\$[\d.,KkMm][^·]*$"
MODALITY = r"(?i)\((on[- ]site|hybrid|remote)\)"
CONTINUATION_END_CHARS = (",", "-", "–", "—", "&", "/", ":")
CONTINUATION_WORDS = ("-", "–", "—", "&", "/", "and", "of", "for", "in", "to", "with", "at", "the")
KNOWN_COMPANIES = (
    "TikTok", "TikTok USDS Joint Venture", "ByteDance", "Amazon", "Apple", "Google", "Meta",
    "Microsoft", "Netflix", "Uber", "Airbnb", "Snap Inc.", "Snap", "Salesforce", "Stripe",
    "Walmart", "Carta", "GitHub", "F5", "Siemens", "JPMorganChase", "OpenAI", "Anthropic",
    "Cursor", "Perplexity", "Scale AI", "Databricks", "Snowflake", "Reddit",
)
CARD_SEPARATOR = " · "
CARD_SECTION = 'id="job-section"'
CARD_FIELD_TAIL = r'"[^>]*>(.*?)</(?:p|span|td|div)'
CARD_TITLE_LINK = r'(?s)id="job-title"[^>]*>.*?<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
CARD_CANONICAL = r"jobright\.ai/jobs/info/([a-f0-9]{24})"
CARD_REFERRALS = r"(?i)^\d+\+\s*referrals?"

# --- fixed values: pending inbox ------------------------------------------
INBOX_HEADER = "# Pending JDs\n\n> Paste each description under its marker; the next run scores it.\n"
INBOX_PLACEHOLDER = "<!-- paste JD body below this line, then save -->"
INBOX_SECTION = (
    r"(?s)<!--\s*JOB-START\s+id=(\S+?)(?:\s+first_seen=(\S+?))?\s*-->(.*?)<!--\s*JOB-END\s+id=\1\s*-->"
)

# --- fixed values: scoring bands ------------------------------------------
STRONG_MIN = 91
MEDIUM_MIN = 71

# --- fixed values: handbook -----------------------------------------------
QUESTION_TYPE_LABELS = {
    "coding": "Coding", "sd": "System Design", "ml-coding": "ML Coding",
    "prompt": "Prompt Coding", "math": "Math / Reasoning", "behavioral": "Behavioral / 流程",
}
QUESTION_SECTION_ORDER = ("coding", "sd", "ml-coding", "prompt", "math", "behavioral")
LEADERBOARD_SIZE = 50
LEADERBOARD_MIN_FREQUENCY = 2
LINKS_SHOWN = 8
POSTS_PER_BATCH = 8
STAGE_BODY_CHARS = 10000
TRUNCATION_MARK = " …(truncated)"
LOCK_PATTERNS = (
    r"本帖隐藏.{0,30}需要", r"本帖隐藏.{0,30}回复",
    r"购买.{0,10}大米.{0,10}查看", r"查看此.{0,10}需要.{0,10}大米",
)
ROUND_UNSTATED = "未注明"
# fixed values: wording of the handbook
HANDBOOK_TITLE = "# {company} 面试复习手册"
HANDBOOK_SOURCE = "> **来源**：[1point3acres {company} 面试经验](https://jobs.1point3acres.com/companies/{slug}/interview)"
HANDBOOK_RANGE = ("> **数据范围**：", " 帖（前 20 页，约 2025–2026）")
HANDBOOK_DAY = "> **抓取日期**："
HANDBOOK_SIZE = "> **聚合后题目数**："
HANDBOOK_BOARD = "## 速览：高频题榜（≥{minimum} 次）"
HANDBOOK_BOARD_ALL = ("## 速览：题目总览（全部 ", " 题，按频次降序）")
HANDBOOK_BOARD_HEAD = ("| # | 题目 | 类型 | 频次 | 难度 | 主要场次 |", "|---|---|---|---|---|---|")
HANDBOOK_BOARD_NONE = "（暂无频次 ≥{minimum} 的题——数据可能太少）"
HANDBOOK_ALIASES, HANDBOOK_POINTS, HANDBOOK_SOURCES = "**别名**：", "**考查点**：", "**来源**："
HANDBOOK_TASK = ("**题面**", "：")
HANDBOOK_BADGES = {"medium": " _(题面综合自有限描述)_", "low": " ⚠️ _(楼主未给题面，仅题名记录)_"}
HANDBOOK_SOLUTIONS, HANDBOOK_PITFALLS, HANDBOOK_FOLLOW_UPS = "**主要解法**：", "**踩坑**：", "**Follow-up**："
QUESTION_UNTOLD = "楼主仅提及题名，未公开具体题面/约束。建议直接查阅 thread_ids 中的原帖与楼下回复。"
HANDBOOK_RARE = ("## 罕见题（频次 = 1，共 ", " 道）")
HANDBOOK_RARE_NOTE = "_仅出现过一次，复习时可略过；准备充分后再扫一遍。_"
HANDBOOK_META = ("## 元信息", "- 帖子总数：", "- 抽出原始题数：", "- 聚合后不同题数：")
HANDBOOK_SCRIPT = ("- 抓取脚本：`", "`")
HANDBOOK_MODEL = ("- 模型：`", "`（两阶段：map + reduce）")
HANDBOOK_FAILED = ("- ⚠️ Stage1 LLM 失败：", " 帖")
# fixed values: places in a question page
QUESTION_STATEMENT = (
    r'data-track-load="description_content"', r'class="(?:[^"]*\s)?elfjS[\s"]',
    r'class="(?:[^"]*\s)?(?:content__u3I1|css-pre|question-content__JfgR)[\s"]',
)
QUESTION_DIFFICULTY = r'class="[^"]*text-difficulty-'
DIFFICULTY_LABELS = {"Easy": "Easy", "Med.": "Medium", "Medium": "Medium", "Hard": "Hard"}

# --- fixed values: course archive -----------------------------------------
FIGURE_LINE = r"^Figure\s+(\d+)\b\s*(.*)$"
CONTENT_IMAGE_MARKS = ("/images/courses/", "/images/lessons/")
UNPARSEABLE_SECTION_INDEX = 999
EXTENSION_BY_CONTENT_TYPE = {
    "image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png", "image/gif": ".gif",
    "image/webp": ".webp", "image/svg+xml": ".svg", "image/avif": ".avif",
    "audio/mpeg": ".mp3", "audio/mp4": ".m4a", "video/mp4": ".mp4", "application/pdf": ".pdf",
}

# --- fixed values: an opening in a board's page state ------------------------
ASHBY_OPENING = (
    r'(?s)\{"id":"([0-9a-f-]{36})","title":"((?:\\.|[^"])*)","updatedAt":"[^"]*".*?"locationName":"((?:\\.|[^"])*)"'
    r'.*?"workplaceType":(?:"[^"]*"|null).*?"secondaryLocations":(\[[^\]]*\])'
)

# --- fixed values: counts of the daily report ---------------------------------
REPORT_COUNTS = (
    ("raw_count", "Raw jobs from LinkedIn alerts"), ("unique_count", "After dedupe (unique roles)"), ("filtered_count", "Filtered out (rules + LLM)"),
    ("passes_count", "Passing → Pending Inbox"), ("resolved_count", "Resolved by ATS resolver"),
    ("awaiting_count", "Awaiting JD (in Pending JDs.md)"), ("scored_count", "Scored today (incl. manual JD fills)"),
)

# --- fixed values: places in forum pages ---------------------------------------
LISTING_MARK = r'(?s)(?:<time[^>]*title="([^"]*)"[^>]*>|<a\b[^>]*href="(https?://www\.1point3acres\.com/bbs/thread-(\d+)-1-1\.html)[^"]*"[^>]*>(.*?)</a>)'
LISTING_TITLE = r'(?s)<div[^>]*class="[^"]*\bflex-1\b[^"]*"[^>]*>(.*?)</div>'
LISTING_TAGS = r'(?s)<div[^>]*class="[^"]*\btext-primary\b[^"]*"[^>]*>(.*?)</div>'
THREAD_OWNER = r'(?s)class="[^"]*\bauthi\b[^"]*"[^>]*>(.*?)</div>'
THREAD_PROFILE = r'(?s)<a[^>]*href="[^"]*space-uid-\d+[^"]*"[^>]*>(.*?)</a>'
THREAD_OWNER_DATED = r"^(.+?)\s+(?:\d{4}-\d{1,2}-\d{1,2}|\d+\s*(?:小时|分钟|天|秒)\s*前|昨天|前天|刚刚)"
THREAD_POSTED = r'(?s)<em[^>]*id="authorposton[^"]*"[^>]*>(.*?)</em>'
THREAD_CLOCK = r"(\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{2}(?::\d{2})?)"
