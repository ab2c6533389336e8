"""Fixed values of the data model: names, labels, rates, thresholds, patterns."""

# Hook log file stem -> event type.
HOOK_LOGS = {
    "pretooluse": "PreToolUse",
    "posttooluse": "PostToolUse",
    "sessionstart": "SessionStart",
    "sessionend": "SessionEnd",
    "precompact": "PreCompact",
    "notification": "Notification",
    "userpromptsubmit": "UserPromptSubmit",
    "subagentstop": "SubagentStop",
    "adversarial-session-start": "AdversarialSessionStart",
    "adversarial-spawn": "AdversarialSpawn",
    "adversarial-stop-hook": "AdversarialStop",
    "ensure-stop": "EnsureStop",
    "retry-until-stop": "RetryUntilStop",
}

# Most used tool -> developer type.
DEVELOPER_TYPES = {
    "Edit": "The Surgeon",
    "Read": "The Scholar",
    "Bash": "The Hacker",
    "Write": "The Architect",
    "Grep": "The Detective",
    "Glob": "The Explorer",
    "Task": "The Orchestrator",
    "WebSearch": "The Researcher",
}
DEFAULT_DEVELOPER_TYPE = "The Polyglot"

WRITE_TOOLS = ("Edit", "MultiEdit", "Write")
READ_TOOLS = ("Read",)

# Dollars per million tokens: (input, output). The fixed reports use FLAT_RATE for every model.
FLAT_RATE = (3.0, 15.0)
MODEL_RATES = {
    "sonnet": (3.0, 15.0),
    "opus": (15.0, 75.0),
    "haiku": (0.25, 1.25),
}
CACHE_DISCOUNT = 0.9  # share of the input rate that a cache read saves

# Bucket thresholds.
MESSAGE_BUCKETS = (3, 10, 30)
PROMPT_BUCKETS = (50, 200)
ABANDONED_MESSAGES = 3
ABANDONED_TOKENS = 10000

PURGE_AGE_DAYS = 7

# Patterns.
HOOK_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) (.+)$"
HISTORY_NAME = r"^(\d{8}T\d{6})_(\w+)_(\w+)_(.+)\.md$"
DEBUG_TIME = r"^(\d{4}-\d{2}-\d{2}T[\d:.]+Z?)"
