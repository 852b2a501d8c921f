"""Deterministic functions that stand in for models."""

from __future__ import annotations

import json

from timeloom.operators.models import BatchFn


def hash_embedding(dimensions: int = 16) -> BatchFn:
    """A deterministic stand-in for an embedding model, for tests: character counts by hash."""

    def fn(rows: list[dict]) -> list[dict]:
        out = []
        for r in rows:
            v = [0.0] * dimensions
            for ch in r["text"]:
                v[ord(ch) * 2654435761 % 2**32 % dimensions] += 1.0
            out.append({"vector": v, "cost_usd": len(r["text"]) * 1e-8})
        return out

    return fn


def echo_json(rows: list[dict]) -> list[dict]:
    """A stand-in for a document model: the material's first line as the only step."""
    return [{"document_json": json.dumps({"doc_type": "sop", "overview": (r["material"] or "")[:40], "sections": [], "uncovered": []}), "cost_usd": 0.001} for r in rows]
