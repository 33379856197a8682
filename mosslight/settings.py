"""Settings from the environment; arguments take precedence."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

PREFIX = "MOSSLIGHT_"


@dataclass(frozen=True)
class Settings:
    """``roots`` and ``excludes`` are lists, separated in the environment like search paths."""

    index: str = ".mosslight"
    workspace: str | None = None
    roots: list[str] = field(default_factory=list)
    knowledge: str | None = None
    excludes: list[str] = field(default_factory=list)
    registry: str | None = None
    embed_host: str | None = None
    embed_model: str | None = None

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Settings:
        def listed(name: str) -> list[str]:
            return [x for x in env.get(PREFIX + name, "").split(os.pathsep) if x]

        return cls(env.get(PREFIX + "INDEX") or ".mosslight", env.get(PREFIX + "WORKSPACE"), listed("ROOTS"), env.get(PREFIX + "KNOWLEDGE") or None, listed("EXCLUDES"), *(env.get(PREFIX + x) or None for x in ("REGISTRY", "EMBED_HOST", "EMBED_MODEL")))
