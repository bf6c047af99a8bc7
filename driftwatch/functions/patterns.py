"""Fixed values of the threat scan: patterns, labels, field names, limits.

The order of the patterns matters: per text and label the first match counts.
"""

from __future__ import annotations

# Fixed values: (label, pattern without flags, what it is about).
INJECTION_PATTERNS = [
    (
        "INSTRUCTION_OVERRIDE",
        r"ignore\s+(previous|above|prior|all)\s+(instructions?|prompt|context|directives?)",
        "Tells the reader to drop the instructions it was given.",
    ),
    (
        "CONTEXT_WIPE",
        r"forget\s+(everything|all)\s+(you|I|we)\s+(know|said|told|learned|were told)",
        "Tells the reader to drop what was said before.",
    ),
    (
        "TRAINING_BYPASS",
        r"disregard\s+(your|all|previous|any)\s+(training|instructions?|guidelines?|rules?|constraints?)",
        "Tells the reader to set its training or rules aside.",
    ),
    (
        "SYSTEM_PROMPT_INJECTION",
        r"\[system\s*\]|\[sys\]|<\|system\|>|<system>|<\|im_start\|>\s*system",
        "Carries a chat-template marker of the system role.",
    ),
    (
        "SYSTEM_PROMPT_INJECTION",
        r"###\s*(system|instruction|context)\s*:|SYSTEM\s*PROMPT\s*:|NEW\s*INSTRUCTIONS?\s*:",
        "Carries a heading that poses as a system prompt.",
    ),
    (
        "SYSTEM_PROMPT_INJECTION",
        r"###\s*system\s+(override|injection|bypass|prompt|manipulation)",
        "Carries a block marker that poses as a system override.",
    ),
    (
        "PERSONA_INJECTION",
        r"act\s+as\s+(if\s+you\s+are|a|an)\s+(different|evil|unrestricted|jailbroken|unfiltered)",
        "Asks the reader to play an unrestricted persona.",
    ),
    (
        "IDENTITY_OVERRIDE",
        r"you\s+(are\s+)?(now|henceforth)\s+(free|unrestricted|liberated|DAN|GPT|Claude|Gemini)",
        "Tells the reader that it is now something else.",
    ),
    (
        "JAILBREAK_ATTEMPT",
        r"do\s+anything\s+now|DAN\s+mode|developer\s+mode\s+enabled|jailbreak(\s+mode)?",
        "Uses a known jailbreak phrase.",
    ),
    (
        "PROMPT_EXFILTRATION",
        r"(print|repeat|output|return|show|reveal|display)\s+(back\s+)?(verbatim|exactly|all\s+of)?\s*(the\s+)?"
        r"(system|initial|hidden|original|first)\s+(prompt|instructions?|context|message)",
        "Asks for the hidden prompt to be repeated.",
    ),
    (
        "DEFERRED_INJECTION",
        r"when\s+(you|the\s+(AI|assistant|model|agent))\s+(is\s+asked|receives|processes|answers)",
        "Plants an instruction for a later occasion.",
    ),
    (
        "DEFERRED_INJECTION",
        r"(next|from now on|whenever|every time)\s+(time\s+)?(you|the\s+(AI|agent))\s+(is\s+asked|respond)",
        "Plants an instruction for all later occasions.",
    ),
    (
        "TOOL_INJECTION",
        r"""call\s+(the\s+)?(tool|function|api|endpoint)\s+["']?(create_index|drop_collection|delete)""",
        "Tries to set off a destructive tool call.",
    ),
    (
        "CODE_INJECTION_ATTEMPT",
        r"(execute|run|invoke)\s+(this\s+)?(code|command|query|script)\s*:",
        "Tries to have code run.",
    ),
]

# The pattern of the scan of request texts.
REQUEST_PATTERN = (
    r"(ignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions?"
    r"|forget\s+(?:everything|all|your|the)\s+"
    r"|you\s+are\s+now\s+(?:a|an|the)\s+\w+"
    r"|<\|im_start\|>\s*system"
    r"|###\s*system\s+override"
    r"|\[\s*system\s*\]"
    r"|disregard\s+(?:all\s+)?(?:previous|your|the)\s+(?:instructions?|context|rules?)"
    r"|new\s+instructions?:\s*(?:you\s+must|always|never)"
    r"|jailbreak\s*[:=]"
    r"|<\s*inject\s*>)"
)

# Top-level field names that are suspicious as such.
SUSPICIOUS_FIELDS = [
    "system_prompt", "prompt_override", "llm_instruction", "ai_context",
    "hidden_instruction", "__prompt__", "_system", "override_context",
    "inject", "jailbreak", "adversarial", "bypass", "override",
    "llm_context", "agent_instruction", "rag_injection",
]

# Depth and length limits of the shorter walk, text kept per
# match, weights and limits of the confidence.
SHORT_DEPTH = 5
SHORT_CHARS = 10
MATCH_CHARS = 120
MATCH_WEIGHT, FIELD_WEIGHT = 0.35, 0.2
CRITICAL_MATCHES, CRITICAL_CONFIDENCE = 2, 0.7

# Literals implied by each pattern, in lower case: a matching text contains at
# least one of every inner list. They only save regex work on clean texts. The
# short lists come first: they settle most texts with one search.
REQUIRED_LITERALS = [
    [["ignore"]],
    [["forget"], ["everything", "all"]],
    [["disregard"]],
    [["[sys", "<|", "<system>"]],
    [[":"], ["###", "prompt", "instruction"]],
    [["###"], ["system"]],
    [["act"], ["different", "evil", "unrestricted", "jailbroken", "unfiltered"]],
    [["you"], ["now", "henceforth"], ["free", "unrestricted", "liberated", "dan", "gpt", "claude", "gemini"]],
    [["now", "mode", "jailbreak"], ["anything", "dan", "developer", "jailbreak"]],
    [["prompt", "instruction", "context", "message"], ["system", "initial", "hidden", "original", "first"]],
    [["when"], ["asked", "receives", "processes", "answers"]],
    [["asked", "respond"], ["next", "from now on", "whenever", "every time"]],
    [["call"], ["create_index", "drop_collection", "delete"]],
    [[":"], ["execute", "run", "invoke"], ["code", "command", "query", "script"]],
]
# The four non-ASCII letters that match an ASCII letter when case is ignored.
FOLDED_FROM, FOLDED_TO = "\u017f\u212a\u0131\u0130", "skii"
