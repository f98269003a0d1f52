"""Word lists, patterns and formats that decide results and so must not drift.

Patterns are written with placeholders that `java_pattern` fills in:
  ~s  one blank character of the whitespace set below
  ~S  the inside of that set, for use within a character class
  ~b  a word boundary that only knows ASCII letters, digits and underscore
  ~<  the same before a word character, ~> after one (cheaper, as one side is known)
"""

# --- whitespace -------------------------------------------------------------
WHITESPACE = (
    "\t\n\x0b\f\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WHITESPACE_CLASS = (
    r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
)
ASCII_WORD = "[A-Za-z0-9_]"
ASCII_WORD_BOUNDARY = f"(?:(?<!{ASCII_WORD})(?={ASCII_WORD})|(?<={ASCII_WORD})(?!{ASCII_WORD}))"

# --- sections ---------------------------------------------------------------
SECTION_HEADERS = {
    "experience": [
        r"(?:work~s+)?(?:professional~s+)?experience~>",
        r"employment(?:~s+history)?~>",
        r"work~s+history~>",
    ],
    "skills": [
        r"(?:technical~s+|core~s+)?skills~>",
        r"technologies~>",
        r"(?:tech~s+)?stack~>",
        r"competencies~>",
    ],
    "education": [
        r"education~>",
        r"academic(?:~s+background)?~>",
        r"degrees?~>",
        r"qualifications?~>",
    ],
    "summary": [
        r"summary~>",
        r"about(?:~s+me)?~>",
        r"profile~>",
        r"objective~>",
    ],
}
SECTION_HEADER_PREFIX = r"(?i)(?:^|\n)~s*"
SECTION_NAMES = ["experience", "skills", "education", "summary", "other"]
SECTION_DISPLAY_ORDER = ["summary", "experience", "skills", "education", "other"]

# --- sentences --------------------------------------------------------------
SENTENCE_BREAK = r"(?![\x21-\x7e])(?:(?<=[.!?])~s+|\n+|[•▪·●◦∙►])"  # no break begins with a printable ASCII character
MIN_SENTENCE_LENGTH = 3

# --- entities ---------------------------------------------------------------
YEARS_PATTERNS = [
    r"(?i)(\d+)\+?~s*years?~s+(?:of~s+)?experience",
    r"(?i)experience:?~s*(\d+)\+?~s*years?",
    r"(?i)(\d+)\+?~s*years?~s+in",
]
TECHNOLOGIES = [
    "javascript", "typescript", "python", "java", "go", "rust", "c++", "c#",
    "ruby", "php", "kotlin", "swift",
    "react", "vue", "angular", "svelte", "next.js", "nuxt",
    "node.js", "nodejs", "express", "nestjs", "django", "flask", "spring",
    "rails", "fastapi",
    "kubernetes", "k8s", "docker", "terraform", "ansible", "jenkins",
    "gitlab ci", "github actions", "circleci",
    "aws", "gcp", "azure", "amazon web services", "google cloud",
    "postgres", "postgresql", "mysql", "mongodb", "redis", "elasticsearch",
    "dynamodb", "cassandra",
    "graphql", "rest", "grpc", "kafka", "rabbitmq",
]
DEGREE_PATTERNS = [
    r"(?i)~<(b\.?sc\.?|bachelor(?:'s)?|bs)~b[^\n\r\u2028\u2029]*?"
    r"(?:computer~s+science|cs|engineering|mathematics|physics|[a-z]+)",
    r"(?i)~<(m\.?sc\.?|master(?:'s)?|ms)~b[^\n\r\u2028\u2029]*?"
    r"(?:computer~s+science|cs|engineering|mathematics|[a-z]+)",
    r"(?i)~<(ph\.?d\.?|doctorate)~b[^\n\r\u2028\u2029]*?"
    r"(?:computer~s+science|cs|engineering|[a-z]+)",
]
COMPANY_PATTERN = (
    r"(?:(?<![^\n\r\u2028\u2029])|\n)~s*([A-Z][A-Za-z0-9&.~S]{2,40}?)"
    r"(?:~s+[-–|]|~s+\d{4}|\n)"
)
MAX_COMPANIES = 10
ROLE_PATTERN = (
    r"(?i)~b(senior|lead|staff|principal|junior|mid)?~s*"
    r"(?:software|backend|frontend|fullstack|full-stack|devops|platform|data|ml|ai)?~s*"
    r"(engineer|developer|architect|manager|director|lead)~b"
)
MAX_ROLES = 5

# --- personal data ----------------------------------------------------------
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
_LOCAL = "[a-zA-Z0-9._%+-]"
# The same matches: no run of local characters is tried twice.
EMAIL_SEARCH = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}"
PHONE_PATTERN = (
    r"(?:\+?\d{1,3}[-.~S]?)?\(?\d{2,4}\)?[-.~S]?\d{3,4}[-.~S]?\d{3,4}"
)
URL_PATTERN = r"https?://[^~S]+"
ADDRESS_PATTERNS = [
    r"(?i)~<address[:~S]+[^\n]+",
    r"(?i)~<\d+~s+[A-Z][a-z]+~s+(?:st|street|ave|avenue|rd|road|blvd)~>[^\n]*",
]
BIRTH_PATTERNS = [  # case-insensitive
    r"~<date of birth[:~S]+[\d/.-]+",
    r"~<dob[:~S]+[\d/.-]+",
    r"~<born(?:~s+on)?[:~S]+\d[\d/.-]+",
    r"~<age[:~S]+\d{1,2}~>",
]
BIRTH_WORDS = ["date of birth", "dob", "born", "age"]  # each is in every match of the pattern in its place
PRONOUN_TAGS = ["he/him", "she/her", "they/them", "he/they", "she/they"]
NAME_LINE = (  # first non-blank line: 2-4 words of letters, ' and -, under 60 characters
    r"\A((?:[~S&&[^\n]]*+\n)*+)"
    r"(?=[~S&&[^\n]]*+[^\n]{1,59}?[~S&&[^\n]]*+(?:\n|\z))"
    r"[~S&&[^\n]]*+[A-Za-z'-]+(?:[~S&&[^\n]]+[A-Za-z'-]+){1,3}[~S&&[^\n]]*+(?=\n|\z)"
)

# --- file intake ------------------------------------------------------------
MIME_BY_FORMAT = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "txt": "text/plain",
}
MAX_UPLOAD_FILES = 500
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
REASON_NO_FILES = "No files uploaded"
REASON_TOO_MANY = "Too many files in a single upload."
REASON_TOO_LARGE = "One or more files exceed the per-file size limit (10 MB)."
MIN_TEXT_LENGTH = 50
MIN_LETTER_RATIO = 0.6
PDF_NO_TEXT = (
    "PDF parsed but no meaningful text was extracted. "
    "This is usually an image-only/scanned PDF; OCR is not available."
)
DOCX_NO_TEXT = "DOCX parsed but no meaningful text was extracted."
NO_TEXT_DEFAULT = "Could not extract any text from this file."
LAYOUT_START_HEIGHT = 12.0
LAYOUT_PARAGRAPH_GAP = 1.8
LAYOUT_LINE_GAP = 0.4

# --- scoring ----------------------------------------------------------------
REQUIRED_WEIGHT_MULTIPLIER = 2.0
WEAK_MATCH_SCORE = 0.6
STRONG_MATCH_COUNT = 3
KEYWORD_THRESHOLDS = {"great": 70.0, "good": 40.0, "missing_ratio": 0.6}
FINAL_THRESHOLDS = {"great": 85.0, "good": 60.0, "missing_ratio": 0.5}
AI_MISSING_BELOW = 0.5
AI_SCORE_SCALE = [0.0, 0.3, 0.6, 1.0]

# --- requirements and jobs --------------------------------------------------
REQUIREMENT_TYPES = ["technology", "experience", "education", "softSkill"]
WEIGHT_RANGE = (1, 10)
REQUIRED_WEIGHT_BAND = (6, 10)
OPTIONAL_WEIGHT_BAND = (1, 6)
SYNONYM_COUNT_BAND = (4, 10)
TITLE_LENGTH_BAND = (3, 200)
DESCRIPTION_LENGTH_BAND = (50, 20000)
JOB_STATUSES = [
    "CREATED", "EXTRACTING_REQUIREMENTS", "REQUIREMENTS_EXTRACTED",
    "PROCESSING", "COMPLETED", "FAILED",
]
STALE_MINUTES = 15
GATE_OK = "ok"
NO_REQUIREMENTS = "no requirements"
MALFORMED = "malformed"
HEARTBEAT_SECONDS = 15
TIER_RANKS = {"great": 3, "good": 2, "no-match": 1}

# --- models -----------------------------------------------------------------
CHEAP_MODEL = "gpt-5-mini"
PREMIUM_MODEL = "gpt-5.1"
PRICE_PER_MILLION = {
    "gpt-5-mini": (0.25, 2.0),
    "gpt-5.1": (1.25, 10.0),
    "gpt-5": (0.625, 5.0),
}
INVALID_JSON_ERROR = "AI response was not valid JSON"
MAX_RETRIES = 2
CALLS_IN_FLIGHT = 5
GENERATIONS_IN_FLIGHT = 10

# --- generated CVs ----------------------------------------------------------
FIRST_YEAR = 1990
DEFAULT_NAME = "Candidate"
DEFAULT_EMAIL = "candidate@example.com"
DEFAULT_COMPANY = "Unknown Company"
DEFAULT_ROLE = "Engineer"


def java_pattern(pattern: str) -> str:
    """Fill in the placeholders of this module's patterns."""
    return (
        pattern.replace("~s", f"[{WHITESPACE_CLASS}]")
        .replace("~S", WHITESPACE_CLASS)
        .replace("~b", ASCII_WORD_BOUNDARY)
        .replace("~<", f"(?<!{ASCII_WORD})")
        .replace("~>", f"(?!{ASCII_WORD})")
    )

# What a prompt says where there is nothing to list.
NO_TECHNOLOGIES = "(none detected)"
NO_KEYWORD_MATCHES = "(no keyword matches found — read the full CV below)"
