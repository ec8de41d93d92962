"""The frozen evaluation protocol and run configuration, validated on the driver."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, fields


# 15 references and 5 targets of a 20-item window.
@dataclass(frozen=True)
class Protocol:
    window: int = 20
    references: int = 15
    targets: int = 5
    seed: int = 42

    def validate(self, config: Mapping[str, object], allow_override: bool = False) -> Protocol:
        """The protocol, or with ``allow_override`` the one that the config asks for; else any other value is an
        error that names it."""
        given = {f.name: int(config[f.name]) for f in fields(self) if f.name in config}
        drift = {k: v for k, v in given.items() if v != getattr(self, k)}
        if drift and not allow_override:
            raise ValueError(f"the protocol is frozen; the configuration changes {drift}")
        out = Protocol(**(asdict(self) | given))
        if out.references + out.targets != out.window or min(out.references, out.targets) < 1:
            raise ValueError("references and targets make up the window")
        return out


def cue_counts(values: Iterable[str]) -> dict[str, int]:
    """``system=n`` entries; a repeated system, a missing number or a negative one is an error."""
    out: dict[str, int] = {}
    for value in values:
        system, sign, number = value.partition("=")
        if not sign or not system or not number.isdigit() or system in out:
            raise ValueError(f"not a cue count: {value!r}")
        out[system] = int(number)
    return out


def thresholds(value: str) -> tuple[int | None, ...]:
    """``0,5,all`` as (0, 5, None): ascending, each once."""
    out: list[int | None] = []
    for part in value.split(","):
        part = part.strip()
        number = None if part == "all" else int(part)
        if number is not None and number < 0 or number in out:
            raise ValueError(f"not a list of thresholds: {value!r}")
        out.append(number)
    return tuple(sorted(out, key=lambda x: (x is None, x or 0)))


def expected_counts(card: Mapping[str, object] | None, default: Mapping[str, int]) -> dict[str, int]:
    """Rows per split: those of a dataset card where it names them."""
    named = dict((card or {}).get("splits", {}))
    return {k: int(named.get(k, v)) for k, v in default.items()}


def identity(config: Mapping[str, object], ignore: Iterable[str] = ("created", "host")) -> str:
    """Hash of what makes two runs the same, whatever the order of keys; a resumed run must have the same."""
    kept = {k: v for k, v in config.items() if k not in set(ignore)}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


def registry(artifacts: dict[str, str], required: set[str]) -> dict[str, str]:
    """Paths of the named artifacts that exist. A required one that is missing is an error, another is left out."""
    from pathlib import Path

    there = {name: path for name, path in artifacts.items() if Path(path).exists()}
    missing = sorted(required - set(there))
    if missing:
        raise FileNotFoundError(f"missing artifacts: {', '.join(missing)}")
    return there
