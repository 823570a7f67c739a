"""Configuration: defaults with a project's own values laid over them."""

from __future__ import annotations

import os

import yaml

#: Fixed values.
DEFAULTS = {
    "weights": {"quality": 1.0, "contract": 1.5, "operational": 1.0, "security": 2.0},
    "severity": {"low": 1, "medium": 3, "high": 6, "critical": 10},
    "hub_fanin_threshold": 3,
    "runtime": {"p95_ms_threshold": 1000, "error_rate_threshold": 0.02},
}


def load_config(path: str) -> dict:
    """The defaults under the mappings and the threshold of a YAML file, where there is one."""
    own = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            own = yaml.safe_load(f) or {}
    merged = {k: v | own.get(k, {}) if isinstance(v, dict) else own.get(k, v) for k, v in DEFAULTS.items()}
    return merged


def guess_folders(root: str) -> tuple[str | None, str | None]:
    """(backend, frontend): the first of the usual names that exists."""
    first = lambda names: next((d for d in names if os.path.isdir(os.path.join(root, d))), None)
    return first(("backend", "server", "api", "app")), first(("frontend", "client", "web", "ui"))


def parse_tokens(many: str | None, single: str | None) -> dict[str, str]:
    """token -> label from ``label:token,...``; bare tokens are numbered users, a single token is the default one."""
    named: dict[str, str] = {}
    for place, entry in enumerate((many or "").split(","), 1):
        if entry := entry.strip():
            label, colon, token = entry.partition(":")
            key = token.strip() if colon else entry
            named[key] = (label.strip() if colon else "") or f"user{place}"
    return ({single: "default"} if single else {}) | named
