"""Prompt-safety patterns and what follows from their matches."""

# Fixed values: (threat, severity, pattern), in order. A leading (?i) ignores case.
THREATS = [
    ("instruction_injection", 0.9, r"(?i)ignore\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|commands?|directives?)"),
    ("instruction_injection", 0.9, r"(?i)disregard\s+(all\s+|everything\s+|the\s+)?(previous|prior|above|earlier)"),
    ("instruction_injection", 0.85, r"(?i)forget\s+(everything|all|what)\s+(you|was|were|that)"),
    ("role_manipulation", 0.8, r"(?i)(you\s+are\s+now|from\s+now\s+on|act\s+as|pretend\s+to\s+be|roleplay\s+as)\s+(a|an|the)?\s*\w+"),
    ("role_manipulation", 0.85, r"(?i)your\s+new\s+(role|task|objective|purpose)\s+is"),
    ("system_prompt_leak", 0.7, r"(?i)(print|show|display|reveal|output|repeat|tell\s+me)\s+(me\s+)?(your\s+)?(system\s+prompt|initial\s+instructions|original\s+instructions)"),
    ("system_prompt_leak", 0.7, r"(?i)what\s+(are\s+)?your\s+(initial|original|system)\s+(instructions|prompts|rules)"),
    ("delimiters", 0.5, r"```[\s\S]*?```"),
    ("delimiters", 0.8, r"(?i)\[SYSTEM\]|\[/SYSTEM\]|\[USER\]|\[/USER\]|\[ASSISTANT\]|\[/ASSISTANT\]"),
    ("delimiters", 0.8, r"(?i)<\|system\|>|<\|user\|>|<\|assistant\|>|<\|end\|>"),
    ("html_comment_injection", 0.75, r"(?i)<!--[\s\S]*?(ignore|disregard|instead|override)[\s\S]*?-->"),
    ("encoding_attack", 0.6, r"(?i)\\x[0-9a-f]{2}"),
    ("encoding_attack", 0.6, r"(?i)\\u[0-9a-f]{4}"),
    ("encoding_attack", 0.4, r"[A-Za-z0-9+/]{20,}={0,2}"),
    ("jailbreak_attempt", 0.95, r"(?i)DAN\s+mode|do\s+anything\s+now"),
    ("jailbreak_attempt", 0.9, r"(?i)developer\s+mode|dev\s+mode|bypass\s+restrictions"),
    ("control_characters", 0.6, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"),
    ("control_characters", 0.5, r"\x1b\[[0-9;]*m"),
    ("sql_like_injection", 0.5, r"--\s*[\r\n]|/\*[\s\S]*?\*/"),
    ("sql_like_injection", 0.7, r"(?i);\s*(drop|delete|truncate|insert|update)\s+"),
]
MAX_LENGTH = 100_000
OVERFLOW = ("context_overflow", 0.8)
