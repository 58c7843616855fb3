"""Settings of an engine from flags, an environment and a mandate file.

Booleans hold if a flag or the environment says so; a secret's flag comes before its variable; what a mandate file names comes before both.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from ..functions.evaluate import requested
from ..schema import default_mandate

#: Flags and the ends of variables; fixed values.
SWITCHES = {"--allow-write": "allow_write", "--allow-network": "allow_network", "--allow-loopback": "allow_loopback"}
SEPARATOR = "--proxy"


@dataclass(frozen=True)
class Settings:
    mandate: dict[str, Any]
    secret: str | None


def settings(flags: Sequence[str] = (), environment: Mapping[str, str] | None = None, mandate_file: str | None = None, prefix: str = "VERDICTFLOW", cwd: str = "/workspace", strict_parity: bool = False) -> Settings:
    """The mandate that sessions start with, and the operators' secret.

    `mandate_file` is the text of the file; one that is no JSON object changes nothing. Flags behind SEPARATOR belong to another program and are not read, unless `strict_parity`.
    """
    env = environment or {}
    own = list(flags) if strict_parity or SEPARATOR not in flags else list(flags)[: list(flags).index(SEPARATOR)]
    after = lambda flag: next((b for a, b in zip(own, own[1:]) if a == flag), None)
    chosen: dict[str, Any] = {field: flag in own or env.get(f"{prefix}_{field.upper()}") == "true" for flag, field in SWITCHES.items()}
    if secret := after("--secret") or env.get(f"{prefix}_OPERATOR_SECRET"):
        chosen["operator_secret"] = secret
    if paths := after("--allowed-paths"):
        chosen["allowed_paths"] = [p.strip() for p in paths.split(",")]
    chosen |= requested(mandate_file)
    return Settings(default_mandate(cwd) | chosen, chosen.get("operator_secret"))
