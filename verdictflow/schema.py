"""Record types of the engine, and the order of severities."""

from __future__ import annotations

VIOLATION = "struct<signature: string, type: string, severity: string, description: string, evidence: string, remediation: string>"
VIOLATIONS = f"array<{VIOLATION}>"

#: Fields of a mandate that requests may carry, with their types. allow_destructive and disallowed_paths are kept but decide nothing.
MANDATE_FIELDS = {
    "task_description": "string",
    "allowed_tools": "array<string>",
    "disallowed_tools": "array<string>",
    "allowed_paths": "array<string>",
    "disallowed_paths": "array<string>",
    "allow_write": "boolean",
    "allow_destructive": "boolean",
    "allow_network": "boolean",
    "allow_loopback": "boolean",
    "allow_subshells": "boolean",
    "risk_tolerance": "string",
    "operator_secret": "string",
    "is_locked": "boolean",
}
MANDATE = "struct<" + ", ".join(f"{k}: {v}" for k, v in MANDATE_FIELDS.items()) + ">"

#: Names by which JSON requests call the fields.
JSON_NAMES = {
    "taskDescription": "task_description",
    "allowedTools": "allowed_tools",
    "disallowedTools": "disallowed_tools",
    "allowedPaths": "allowed_paths",
    "disallowedPaths": "disallowed_paths",
    "allowWrite": "allow_write",
    "allowDestructive": "allow_destructive",
    "allowNetwork": "allow_network",
    "allowLoopback": "allow_loopback",
    "allowSubshells": "allow_subshells",
    "riskTolerance": "risk_tolerance",
    "operatorSecret": "operator_secret",
    "isLocked": "is_locked",
}

SEVERITIES = ("NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL")  # ascending
SIGNATURES = ("S3", "S2b", "S5")
TOLERANCES = ("low", "medium", "high")


def default_mandate(cwd: str = "/workspace") -> dict:
    """Read-only, offline, locked, confined to `cwd`."""
    return {
        "task_description": "Tool calls within safe bounds",
        "allowed_tools": ["*"],
        "disallowed_tools": None,
        "allowed_paths": [cwd],
        "disallowed_paths": None,
        "allow_write": False,
        "allow_destructive": False,
        "allow_network": False,
        "allow_loopback": False,
        "allow_subshells": False,
        "risk_tolerance": "low",
        "operator_secret": None,
        "is_locked": True,
    }
