"""Word lists, phrases, patterns and weights that results depend on."""

from __future__ import annotations

# Stop words of keyword search.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "will", "with", "would", "i", "you", "we", "they", "them", "their", "this", "these", "those", "what", "which", "who", "when", "where", "why", "how", "do", "does", "did", "can", "could", "should", "may", "might", "must", "shall", "have", "had", "been", "being"]
# Stop words of query processing.
PROCESSOR_STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "will", "with", "this", "but", "they", "have", "had", "what", "said", "each", "which", "she", "do", "how", "their", "if", "up", "out", "many", "then", "them", "these", "so", "some"]
# Stop words of key terms.
KEY_TERM_STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "will", "with", "would", "what", "how", "why", "when", "where", "who"]

# Phrases that tell the type of a query.
COMMANDS = ["show me", "give me", "search for", "tell me about", "help me", "find", "list", "display", "explain", "describe"]
QUESTIONS = ["what", "how", "why", "when", "where", "who", "which", "whose", "can you", "could you", "would you", "do you", "did you", "will you", "is there", "are there", "does", "doesn't", "did", "didn't"]
TECHNICAL = ["api", "function", "method", "class", "variable", "error", "exception", "algorithm", "implementation", "code", "syntax", "debug"]
CONVERSATIONAL = ["hello", "hi", "thanks", "thank you", "please", "sorry", "i need", "i want", "i would like", "could you help"]
TEMPORAL = ["recent", "latest", "new", "current", "today", "now"]
INFORMATIVE = ["because", "therefore", "however", "although", "example", "specifically"]
BOOSTS = {
    "ProblemSolving": (1.15, ["solution", "solve", "fix"]),
    "Learning": (1.1, ["example", "tutorial", "guide"]),
    "Decision": (1.12, ["compare", "versus", "pros and cons"]),
}
# Negations in the order in which they are looked for.
NEGATIONS = ["not ", "don't ", "doesn't ", "didn't ", "won't ", "wouldn't ", "can't ", "cannot ", "shouldn't ", "isn't ", "aren't ", "wasn't ", "weren't ", "without ", "exclude ", "except ", "no "]

# Words that tell the language; each counts as a substring.
LANGUAGES = {
    "en": ["the", "and", "to", "of", "a", "in", "for", "is", "on", "that"],
    "es": ["el", "de", "que", "y", "a", "en", "un", "es", "se", "no"],
    "fr": ["le", "de", "et", "à", "un", "il", "être", "et", "en", "avoir"],
}

GENERAL_SYNONYMS = {"big": ["large", "huge", "massive"], "small": ["tiny", "little", "minor"], "fast": ["quick", "rapid", "speedy"], "slow": ["gradual", "leisurely"]}
TECHNICAL_SYNONYMS = {
    "function": ["method", "procedure", "routine"],
    "error": ["exception", "bug", "issue"],
    "database": ["db", "datastore", "repository"],
    "algorithm": ["procedure", "method", "approach"],
    "api": ["interface", "endpoint", "service"],
}
HYPERNYMS = {"python": ["programming language", "language"], "algorithm": ["method", "approach"], "database": ["storage", "system"]}
RELATED = {"api": ["rest", "graphql", "endpoint"]}
DOMAIN = {
    "react": ["javascript", "frontend", "component", "jsx"],
    "python": ["programming", "language", "script"],
    "rust": ["systems programming", "memory safe", "performance"],
    "docker": ["container", "containerization", "deployment"],
}
HIERARCHIES = {
    "ml": ["machine learning", "artificial intelligence", "algorithms"],
    "ai": ["artificial intelligence", "machine learning", "neural networks"],
    "db": ["database", "data storage", "sql"],
}
ACRONYMS = {
    "ML": "machine learning",
    "AI": "artificial intelligence",
    "API": "application programming interface",
    "REST": "representational state transfer",
    "CRUD": "create read update delete",
    "SQL": "structured query language",
    "HTTP": "hypertext transfer protocol",
    "JSON": "javascript object notation",
}
SPELLINGS = {"algoritm": "algorithm", "machien": "machine", "leanring": "learning", "databse": "database", "progrmming": "programming"}

# Patterns of content that is not accepted, and of what is redacted, in order.
BLOCKED = [r"<script[^>]*>.*?</script>", r"javascript:", r"vbscript:", r"on\w+\s*="]
SENSITIVE = [
    r"\b\d{3}-\d{2}-\d{4}\b",
    r"\b\d{9}\b",
    r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    r"\b\+?1?[- ]?\(?[0-9]{3}\)?[- ]?[0-9]{3}[- ]?[0-9]{4}\b",
    r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    r"https?://[^\s]+[?&](password|token|key|secret)=[^\s&]+",
]
MALICIOUS = [r"<script[^>]*>.*?</script>", r"javascript:", r"data:text/html", r"vbscript:", r"onload\s*=", r"onerror\s*=", r"eval\s*\(", r"document\s*\.\s*write"]
FILE_TYPES = ["pdf", "txt", "md", "docx", "html", "htm", "rtf"]

# Weights of (semantic, keyword, quality, freshness, context).
PRESETS = {
    "general": (0.4, 0.3, 0.15, 0.05, 0.1),
    "semantic": (0.6, 0.2, 0.1, 0.05, 0.05),
    "keyword": (0.2, 0.5, 0.15, 0.05, 0.1),
    "quality": (0.3, 0.25, 0.3, 0.05, 0.1),
    "time": (0.3, 0.3, 0.1, 0.25, 0.05),
}
# Rerank weights of (quality, diversity, recency) by query type.
ADAPTIVE = {
    "Factual": (0.25, 0.25, 0.15),
    "Navigational": (0.20, 0.10, 0.20),
    "Procedural": (0.30, 0.15, 0.25),
    "Analytical": (0.35, 0.30, 0.10),
    "Comparative": (0.28, 0.35, 0.12),
    "Conversational": (0.20, 0.20, 0.18),
}
# Ranks of severities, retention days by data type, permissions by role.
SEVERITIES = {"Critical": 4, "High": 3, "Medium": 2, "Info": 1, "Debug": 0}
RETENTION_DAYS = {"Document": 2555, "Query": 365, "Audit": 2555, "Account": 90, "System": 90, "Other": 365}
MIME = {
    "pdf": "application/pdf",
    "txt": "text/plain",
    "md": "text/markdown",
    "markdown": "text/markdown",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "html": "text/html",
    "htm": "text/html",
    "rtf": "application/rtf",
}
#: Requests an hour.
CLIENT_LIMITS = {"ip": 100, "key": 1000, "admin": 10000}
HISTOGRAM_BOUNDS = [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0]
