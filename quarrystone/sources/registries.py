"""Small registries from JSON or YAML files; a missing or broken file is an empty registry."""

from __future__ import annotations

import json
from pathlib import Path

from ..operators.lookup import TRUSTED

#: Trust where no file is given.
FALLBACK_TRUST = {k: TRUSTED[k] for k in ("sec.gov", "law.cornell.edu", "supremecourt.gov", "congress.gov")}


def load(path: str) -> dict:
    try:
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith((".yaml", ".yml")):
            import yaml

            return yaml.safe_load(text) or {}
        return json.loads(text)
    except Exception:
        return {}


def trusted_sources(path: str) -> dict[str, float]:
    """Domains and their trust; a missing file gives the fallback, a broken one nothing."""
    if not Path(path).exists():
        return dict(FALLBACK_TRUST)
    return {k: float(v) for k, v in load(path).get("trusted_sources", {}).items()}


def aliases(path: str, kind: str) -> dict[str, list[str]]:
    return load(path).get(kind, {})
