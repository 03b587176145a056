"""Fixed values of the question rules, written out once more for the SQL forms.

Nothing here is read from the package under test: a phrase that is missing there turns a query red.
"""

PERSON_TERMS = (
    "who", "which consultant", "which consultants", "which employee", "which employees", "find someone",
    "find a consultant", "find consultants", "find an employee", "find employees", "show people",
    "show consultants", "show employees", "looking for someone", "need someone", "need a consultant",
)
SKILL_TERMS = (
    "know", "knows", "has experience", "have experience", "experience in", "experienced in", "experience with",
    "experienced with", "knowledge of", "knowledge in", "skilled in", "skilled with", "skills in", "worked with",
    "familiar with", "expert in", "expertise in", "qualified in", "certified in",
)
EXPERIENCE_PATTERNS = (r"\bhas\s+.+?\s+experience\b", r"\bhave\s+.+?\s+experience\b")
SKILL_PATTERNS = (
    r"\bhas\s+.+?\s+experience\b", r"\bhave\s+.+?\s+experience\b", r"\bknows?\s+.+", r"\bexperienced\s+(?:in|with)\s+.+",
    r"\bskilled\s+(?:in|with)\s+.+", r"\bexpert\s+in\s+.+", r"\bcertified\s+in\s+.+", r"\bqualified\s+in\s+.+",
)
GENERIC_SKILL_TERMS = ("skill", "skills", "technology", "technologies", "qualified in", "certified in")
PROFILE_TERMS = (
    "profile", "cv", "résumé", "resume", "professional experience", "project experience", "career history",
    "employment history", "background", "tell me about", "summarise", "summarize",
)
DOCUMENT_TERMS = ("policy", "document", "pdf", "handbook", "guideline", "procedure")
REPORT_ROUTES = (
    ("bench", 0.99, ("bench", "on bench", "boşta")),
    ("consultant_tracker", 0.99, ("consultant tracker",)),
    ("partial_assignments", 0.98, ("partial assignment", "partial assignments", "partly assigned", "partially assigned")),
    (
        "utilisation_detailed", 0.98,
        ("utilisation detailed", "detailed utilisation", "utilization detailed", "detailed utilization"),
    ),
    ("utilisation", 0.97, ("utilisation", "utilization")),
    ("project_tracker", 0.90, ("project tracker", "show projects", "list projects", "client assignments")),
)
SKILL_QUERY_PATTERNS = (
    r"\b(?:who|which consultant|which consultants|which employee|which employees)\s+(?:has|have)\s+(.+?)\s+experience\b",
    r"\b(?:who|which consultant|which consultants|which employee|which employees)\s+knows?\s+(.+?)(?:\s+and\b|\?|$)",
    r"\bexperience\s+(?:in|with)\s+(.+?)(?:\s+and\b|\?|$)",
    r"\bexperienced\s+(?:in|with)\s+(.+?)(?:\s+and\b|\?|$)",
    r"\bskilled\s+(?:in|with)\s+(.+?)(?:\s+and\b|\?|$)",
    r"\bexpert(?:ise)?\s+in\s+(.+?)(?:\s+and\b|\?|$)",
    r"\bknowledge\s+(?:of|in)\s+(.+?)(?:\s+and\b|\?|$)",
    r"\bworked\s+with\s+(.+?)(?:\s+and\b|\?|$)",
    r"\bfamiliar\s+with\s+(.+?)(?:\s+and\b|\?|$)",
    r"\b(?:qualified|certified)\s+in\s+(.+?)(?:\s+and\b|\?|$)",
)
GROUP_PATTERNS = (
    r"\bin\s+the\s+(.+?)\s+group\b", r"\bfrom\s+the\s+(.+?)\s+group\b", r"\bgroup\s+(?:is|=|called)\s+(.+?)(?:\?|$)",
)
NEXT_MONTH_TERMS = (
    "available next month", "availability next month", "free next month", "on bench next month", "bench next month",
)
ON_BENCH_TERMS = ("on bench", "currently on bench", "is on bench", "are on bench", "benched")
FEWER_PROJECTS_PATTERNS = (
    r"(?:less than|fewer than|under)\s+(\d+)\s+active projects?", r"active projects?\s+(?:less than|fewer than|under)\s+(\d+)",
)
NO_PROJECT_TERMS = ("no active projects", "without active projects", "zero active projects")
EXPERIENCE_KEYWORDS = (
    "banking", "finance", "insurance", "retail", "telecom", "pharma", "healthcare", "energy", "customer", "migration",
    "cloud", "data warehouse", "manufacturing", "public sector", "allianz",
)
SKILL_KEYWORDS = (
    "aws", "azure", "python", "sql", "power bi", "tableau", "databricks", "snowflake", "java", "sap", "oracle", "dbt",
    "spark", "machine learning", "ai", "genai", "data engineering",
)
